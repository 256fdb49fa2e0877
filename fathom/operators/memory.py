"""The append-only memory log: folding it, recall, staleness, and its place in a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KINDS = ("note", "decision", "constraint")


def fold(log: DataFrame, key: tuple[str, ...] = ("repo", "id")) -> DataFrame:
    """The live entries: of an id the latest line counts, a deleted one ends it; ``first_line`` is its place.

    Lines of another kind, without text or without an id are not entries and are skipped; a tombstone needs
    an id alone. The place is the first line after the last deletion.
    """
    one = log.dropDuplicates(["line_no"])
    ok = F.col("id").isNotNull() & (F.coalesce("deleted", F.lit(False)) | (F.col("kind").isin(*KINDS) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)))
    one = one.filter(ok).withColumn("gone", F.coalesce("deleted", F.lit(False)))
    w = Window.partitionBy(*key).orderBy(F.desc("line_no"))
    back = Window.partitionBy(*key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = one.withColumns({"n": F.row_number().over(w), "dead": F.max(F.col("gone").cast("int")).over(back)})
    place = r.filter("dead = 0").groupBy(*key).agg(F.min("line_no").alias("first_line"))
    return r.filter("n = 1 AND NOT gone").drop("n", "dead", "gone", "deleted").join(place, list(key))


def staleness(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, id, stale): whether any linked file is gone or has another hash."""
    f = files.select("repo", "path", "content_hash").dropDuplicates(["repo", "path"])
    linked = entries.select("repo", "id", F.explode("files").alias("path", "given"))
    bad = F.coalesce(~F.lower(F.col("content_hash")).startswith(F.lower(F.col("given"))), F.lit(True))
    s = linked.join(f, ["repo", "path"], "left").groupBy("repo", "id").agg(F.max(bad.cast("int")).alias("bad"))
    return entries.select("repo", "id").join(s, ["repo", "id"], "left").select("repo", "id", (F.coalesce("bad", F.lit(0)) == 1).alias("stale"))


def match(entries: DataFrame, terms: list[str]) -> DataFrame:
    """Entries with ``score`` and ``reasons``: per term 1 for its text or a tag, .5 for a linked path, by terms."""
    toks = S.words(F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    tags, paths = F.coalesce("tags", none), F.coalesce(F.map_keys("files"), none)

    def one(t: str) -> Column:
        return F.when(F.array_contains(toks, t), F.struct(F.lit(1.0).alias("g"), F.lit(f"term:{t}").alias("r"))).when(F.array_contains(tags, t), F.struct(F.lit(1.0).alias("g"), F.lit(f"tag:{t}").alias("r"))).when(
            F.exists(paths, lambda p: F.lower(p).contains(t)), F.struct(F.lit(0.5).alias("g"), F.lit(f"file:{t}").alias("r"))
        )

    parts = F.filter(F.array(*map(one, terms)), lambda x: x.isNotNull())
    return entries.withColumn("parts", parts).withColumns({"score": F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["g"]) / len(terms), "reasons": F.transform("parts", lambda x: x["r"])}).drop("parts")


def search(entries: DataFrame, files: DataFrame, terms: list[str] | None = None, top: int = 10, kind: str | None = None, file: str | None = None, session: str | None = None, stale_only: bool = False) -> DataFrame:
    """Recall: with terms by score, created and id; without them the newest first.

    Entries of a session are visible to that session only.
    """
    e = entries.filter(F.col("session").isNull() | (F.col("session") == session) if session is not None else F.col("session").isNull())
    if kind:
        e = e.filter(F.col("kind") == kind)
    if file:
        e = e.filter(F.array_contains(F.map_keys("files"), file))
    e = match(e, terms).filter("score > 0") if terms else e.withColumns({"score": F.lit(0.0), "reasons": F.array().cast("array<string>")})
    e = e.join(staleness(entries, files), ["repo", "id"])
    if stale_only:
        e = e.filter("stale")
    order = [F.desc("score")] if terms else []
    return e.orderBy(*order, F.desc("created"), "id", "repo").limit(top)


def overlap(entries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(repo, id, overlap, path): the best linked candidate's adjusted score over the greatest one."""
    top = ranked.agg(F.max("adjusted").alias("m")).first()["m"] or 0.0
    linked = entries.select("repo", "id", F.explode(F.map_keys("files")).alias("path"))
    j = linked.join(ranked.select("path", "adjusted"), "path").filter(F.lit(top) > 0)
    return j.groupBy("repo", "id").agg(F.max(F.col("adjusted") / F.lit(top or 1.0)).alias("overlap"), F.max_by("path", F.struct("adjusted", "path")).alias("path"))


def for_bundle(entries: DataFrame, ranked: DataFrame, terms: list[str], top: int = 3) -> DataFrame:
    """Memories for a bundle: .7 of the term score and .3 of the overlap, best first."""
    m = match(entries.filter("session IS NULL"), terms).join(overlap(entries, ranked), ["repo", "id"], "left")
    s = 0.7 * F.col("score") + 0.3 * F.coalesce("overlap", F.lit(0.0))
    why = F.when(F.col("path").isNotNull(), F.concat("reasons", F.array(F.concat(F.lit("linked:"), "path")))).otherwise(F.col("reasons"))
    return m.withColumns({"bundle_score": F.floor(s * 1e9 + 0.5) / 1e9, "reasons": why}).filter("bundle_score > 0").orderBy(F.desc("bundle_score"), "id", "repo").limit(top)
