"""Mixing sources to target weights (problem 9).

Weights are tempered: w(a) is proportional to share * (target / share)^a, from the natural shares at
a = 0 to the targets at a = 1; or, for a wanted entropy, to share^a. The exponent is bisected: to the
largest at which the repetition limits hold, or to the wanted entropy. Where that would be too small,
sources are set to the caps that bind, and the rest is spread over the others. Without a wanted total, the largest total is taken at which the targets hold exactly and no
cap is exceeded.

The weights are realised as budgeted block permutations: a seeded hash puts each record of a source at a
place of a random order that is cut into blocks; whole passes are taken first, then whole blocks, then
records of the one block in which the budget ends. What then is left of a source's budget, less than the
record that did not fit, is filled with smaller records that the pass has not reached.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokenize import count_tokens

BLOCKS = 1 << 16
#: Below this exponent a cap would drag all sources towards their natural shares; its source is set to the cap instead.
LEAST_EXPONENT = 0.25


def tempered(shares: dict[str, float], targets: dict[str, float], a: float) -> dict[str, float]:
    raw = {s: q * (targets[s] / q) ** a if q > 0 and targets[s] > 0 else 0.0 for s, q in shares.items()}
    total = sum(raw.values())
    return {s: x / total if total else 0.0 for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(ok, steps: int = 60) -> float:
    """The largest a in [0, 1] with ok(a), if ok holds up to some a; 1 where it always holds."""
    if ok(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def flatten_to_entropy(shares: dict[str, float], wanted: float) -> dict[str, float]:
    """share^a, normalised, with a bisected so that the entropy is ``wanted`` (a = 0 is uniform)."""
    live = {s: q for s, q in shares.items() if q > 0}
    power = lambda a: {s: q**a / sum(x**a for x in live.values()) for s, q in live.items()}
    return power(bisect_exponent(lambda a: entropy(power(a)) >= wanted))


def between(available: dict[str, int], wanted, part: float) -> float:
    """The entropy that is so much of the way from the natural shares of the wanted sources to equal ones."""
    live = [n for s, n in available.items() if s in wanted and n > 0]
    if not live:
        return 0.0
    natural = entropy({str(i): n / sum(live) for i, n in enumerate(live)})
    return natural + part * (math.log(len(live)) - natural)


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, wanted_entropy: float | None = None) -> tuple[dict[str, int], float]:
    """Tokens to take from each source, and the exponent.

    Sources without tokens, without a target or with a cap of 0 get nothing, and the targets of the
    others are scaled to 1. With ``wanted_entropy`` the natural shares are flattened (or sharpened) to it
    and the targets only say which sources are wanted and how often. A total that all caps together don't
    allow is cut to what they allow.
    """
    live = {s: n for s, n in available.items() if n > 0 and s in targets and (targets[s][0] or 0) > 0 and (targets[s][1] or 0) > 0}
    if not live:
        return {}, 1.0
    have_sum = sum(live.values())
    share = {s: n / have_sum for s, n in live.items()}
    room = {s: targets[s][1] * n for s, n in live.items()}
    if wanted_entropy is not None:
        want = flatten_to_entropy(share, wanted_entropy)
    else:
        want_sum = sum(targets[s][0] for s in live)
        want = {s: targets[s][0] / want_sum for s in live}
    if total is None:
        return {s: min(room[s], round(w * min(room[t] / want[t] for t in live))) for s, w in want.items()}, 1.0
    total = min(total, sum(room.values()))
    fixed: dict[str, int] = {}
    while True:
        # the caps that bind at the targets are met; what they leave is for the others
        rest = {s: share[s] for s in live if s not in fixed}
        left = total - sum(fixed.values())
        weights = tempered(rest, want, 1.0)
        over = [s for s, w in weights.items() if w * left > room[s]]
        if not over:
            break
        # tempering helps where all caps hold at an exponent not far from the targets; else those that bind are met
        a = bisect_exponent(lambda a: all(w * left <= room[s] for s, w in tempered(rest, want, a).items()))
        if a >= LEAST_EXPONENT:
            weights = tempered(rest, want, a)
            return fixed | {s: min(room[s], round(w * left)) for s, w in weights.items()}, a
        fixed |= {s: room[s] for s in over}
        if len(fixed) == len(live):
            return fixed, 1.0
    return fixed | {s: min(room[s], round(w * left)) for s, w in weights.items()}, 1.0


def sizes(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, written to the shared folder."""
    return cut_lineage(count_tokens(docs.select("doc_id", "source", "text"), ranks=ranks))


#: Records of each size class (by powers of two) that a rest is filled from.
FILLERS = 64


def _wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """A row for each source that the parameter table names; of repeated rows the larger values count."""
    rows = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()
    return {r["source"]: (r["s"], r["m"]) for r in rows}


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None, wanted_entropy: float | None = None) -> tuple[dict[str, int], dict[str, int], float]:
    """(tokens to take, tokens there are, exponent) by source."""
    want = _wanted(targets)
    live = sized.filter((F.col("n_tokens") > 0) & F.col("source").isin(*want)) if want else sized.limit(0)
    have = {r["source"]: r["n"] for r in live.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    budget, a = plan(have, want, total, wanted_entropy)
    return budget, have, a


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, wanted_entropy: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every chosen record.

    ``targets`` is a parameter table with a row per source: target_share and max_repeats (of repeated
    rows the larger values count). Records without tokens and records of a null or unwanted source are
    never chosen. A source misses its tokens by less than its smallest record that is left, or by what
    ``FILLERS`` records of each size can't make up.
    """
    spark = sized.sparkSession
    budget, have, _ = budgets(sized, targets, total, wanted_entropy)
    live = sized.select("doc_id", "source", "n_tokens").filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    place = F.xxhash64(F.lit(seed), "doc_id")
    # records of one id (repeated rows) share a place and follow one another
    live = live.withColumn("place", place).withColumn("block", F.pmod(F.shiftrightunsigned("place", 40), F.lit(BLOCKS)).cast("int"))
    by_block = live.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    todo = [(s, *divmod(tokens, have[s])) for s, tokens in budget.items()]
    passes = F.broadcast(spark.createDataFrame(todo, "source string, passes long, left long"))
    # of at most BLOCKS rows a source: the block in which the budget ends, and what is left of it there
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    over = by_block.join(passes, "source").withColumn("upto", F.sum("tokens").over(upto)).filter("upto > left")
    ends = over.groupBy("source").agg(F.min(F.struct("block", (F.col("left") - F.col("upto") + F.col("tokens")).alias("room"))).alias("e"))
    cut = passes.join(ends, "source", "left").select("source", "passes", F.coalesce("e.block", F.lit(BLOCKS)).alias("end_block"), F.coalesce("e.room", F.lit(0)).alias("room"))
    joined = live.join(F.broadcast(cut), "source")  # a row per source of the parameter table
    run = Window.partitionBy("source").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = joined.filter(F.col("block") == F.col("end_block")).withColumn("upto", F.sum("n_tokens").over(run))
    extra = _fill(joined, inside)
    key = ["source", "doc_id", "n_tokens"]
    taken = inside.withColumn("repeats", F.col("passes") + (F.col("upto") <= F.col("room")).cast("long"))
    rest = joined.filter(F.col("block") != F.col("end_block")).withColumn("repeats", F.col("passes") + (F.col("block") < F.col("end_block")).cast("long"))
    every = rest.select(*key, "repeats", "passes").unionByName(taken.select(*key, "repeats", "passes"))
    # of repeated rows of a record that are not taken, as many as fill
    n = Window.partitionBy(*key).orderBy(F.desc("repeats"))
    filled = every.join(F.broadcast(extra), key).withColumn("n", F.row_number().over(n)).withColumn("repeats", F.when((F.col("n") > F.col("upper")) & (F.col("n") <= F.col("upper") + F.col("more")), F.col("repeats") + 1).otherwise(F.col("repeats")))
    cols = ["doc_id", "source", "n_tokens", "repeats"]
    out = every.join(F.broadcast(extra), key, "left_anti").select(*cols).unionByName(filled.select(*cols))
    return out.filter(F.col("repeats") > 0)


def _fill(joined: DataFrame, inside: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, upper, more): records that fill the rest of each source's budget.

    Candidates are the records that the last pass has not reached and that are no larger than the rest, of
    each source and size class the ``FILLERS`` first ones in the order of the pass: at most a few thousand rows a
    source of the parameter table. The largest that fits is taken again and again. ``upper`` is how many
    rows of the same record the pass has taken, ``more`` how many fill.
    """
    spark = joined.sparkSession
    left = inside.groupBy("source").agg((F.max("room") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))), F.lit(0))).alias("free"))
    behind = joined.filter(F.col("block") > F.col("end_block")).select("source", "doc_id", "n_tokens", "place")
    behind = behind.unionByName(inside.filter(F.col("upto") > F.col("room")).select("source", "doc_id", "n_tokens", "place"))
    some = behind.join(F.broadcast(left), "source").filter(F.col("n_tokens") <= F.col("free"))
    size = F.floor(F.log2(F.col("n_tokens").cast("double")) * 2)
    w = Window.partitionBy("source", "class").orderBy("place", "doc_id", "n_tokens")
    few = some.withColumn("class", size).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= FILLERS)
    chosen: dict[tuple, int] = {}
    room: dict[str, int] = {}
    for r in sorted(few.collect(), key=lambda r: (r["source"], -r["n_tokens"], r["place"])):
        free = room.setdefault(r["source"], r["free"])
        if r["n_tokens"] <= free:
            room[r["source"]] = free - r["n_tokens"]
            key = (r["source"], r["doc_id"], r["n_tokens"])
            chosen[key] = chosen.get(key, 0) + 1
    kind = joined.schema["doc_id"].dataType.simpleString()
    fill = spark.createDataFrame([(*k, n) for k, n in chosen.items()], f"source string, doc_id {kind}, n_tokens long, more int")
    # rows of these records that are taken already come first
    before = inside.filter(F.col("upto") <= F.col("room")).join(F.broadcast(fill), ["source", "doc_id", "n_tokens"]).groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("upper"))
    return fill.join(F.broadcast(before), ["source", "doc_id", "n_tokens"], "left").fillna(0, ["upper"])


def shares(sized: DataFrame, mixed: DataFrame, targets: DataFrame, planned: dict[str, int] | None = None) -> DataFrame:
    """Per source of the targets or the data: what was wanted, available and reached, what stays unused, and why.

    ``reason`` is 'no target', 'no data', 'cap of 0', 'as wanted' (within a hundredth of the target share),
    'cap' (all repeats that the cap allows are used), 'record sizes' (no record is left that fits into what is
    missing from ``planned_tokens``) or 'others' (the caps of others, the wanted total or entropy leave it
    another share). ``planned`` gives the tokens that each source was to give.
    """
    want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("n_tokens").alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    out = have.join(want, "source", "full_outer").join(got, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("documents", "available_tokens", "mixed_tokens", "used_tokens", "most_repeats")}
    # a row a source, of which there are few
    out = out.withColumns(zero).withColumn("reached_share", F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy()))
    wanted_sum = F.sum(F.when((F.col("available_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))).over(Window.partitionBy())
    off = F.abs(F.col("reached_share") / (F.col("target_share") / wanted_sum) - 1)
    reason = (
        F.when(F.coalesce("target_share", F.lit(0.0)) <= 0, "no target").when(F.col("available_tokens") == 0, "no data").when(F.coalesce("max_repeats", F.lit(0)) <= 0, "cap of 0")
        .when(off <= 0.01, "as wanted").when(F.col("mixed_tokens") >= 0.99 * F.col("available_tokens") * F.col("max_repeats"), "cap")
        .when(F.col("mixed_tokens") < 0.99 * F.col("planned_tokens"), "record sizes").otherwise("others")
    )
    plan_rows = sized.sparkSession.createDataFrame(list((planned or {}).items()), "source string, planned_tokens long")
    out = out.join(F.broadcast(plan_rows), "source", "left")
    return out.select("source", "target_share", "max_repeats", "documents", "available_tokens", "planned_tokens", "mixed_tokens", "most_repeats", "reached_share", (F.col("available_tokens") - F.col("used_tokens")).alias("unused_tokens"), reason.alias("reason"))
