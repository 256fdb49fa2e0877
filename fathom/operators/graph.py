"""The link graph of files: building its edges, neighbours, and bounded expansion.

Edges are (src, dst, kind) with kind import or test. Everything is joins on paths; hub files are left to
AQE's skew handling, as a join result has one row for each link in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Endings and relations.
#: Endings tried for an import, in this order.
PROBED = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
RELATIONS = ["imports", "imported_by", "tests", "tested_by"]


def dedupe(edges: DataFrame) -> DataFrame:
    """Links between different files, each once."""
    return edges.filter("src <> dst").dropDuplicates(["src", "dst", "kind"])


#: (kind, outgoing) -> relation of a file to its neighbour, why, and how an expansion names the step
FORMS = {("import", True): ("imports", "import-edge", "imported-by:"), ("import", False): ("imported_by", "reverse-import-edge", "imports:"), ("test", True): ("tests", "test-link", "tested-by:"), ("test", False): ("tested_by", "test-link", "test-of:")}


def both_ways(edges: DataFrame) -> DataFrame:
    """(from, to, relation, why, how): each edge as a step in either direction, in one pass over the edges."""

    def pick(outgoing: bool, i: int) -> Column:
        return F.when(F.col("kind") == "import", FORMS["import", outgoing][i]).when(F.col("kind") == "test", FORMS["test", outgoing][i])

    def step(a: str, b: str, outgoing: bool) -> Column:
        return F.struct(F.col(a).alias("from"), F.col(b).alias("to"), pick(outgoing, 0).alias("relation"), pick(outgoing, 1).alias("why"), pick(outgoing, 2).alias("how"))

    e = edges.filter("kind IN ('import', 'test')").select("src", "dst", "kind").distinct()
    return e.select(F.explode(F.array(step("src", "dst", True), step("dst", "src", False))).alias("s")).select("s.*")


def _known(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    return df.join(files.select(F.col("path").alias(column)).distinct(), column, "left_semi")


def related(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, relation, neighbor, reason) of every file in all four relations; neighbours are known files."""
    steps = both_ways(edges).select(F.col("from").alias("path"), "relation", F.col("to").alias("neighbor"), F.col("why").alias("reason"))
    return _known(steps, files, "neighbor").select("path", "relation", "neighbor", "reason")


def links(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to, how): every link in both directions, as a step of the expansion takes it."""
    return _known(both_ways(edges).select("from", "to", "how"), files, "to").select("from", "to", "how")


def expand(seeds: DataFrame, edges: DataFrame, files: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(path, reason, hop, gain) of every link taken from ``seeds`` (path, strength).

    A file is expanded once, in the first round that reaches it, with the greatest strength that reaches
    it in that round; each round's strength is the one before times ``decay``. Known files are looked up
    after a round's join, for what the frontier reaches only.
    """
    step = both_ways(edges).select("from", "to", "how")
    frontier = _known(seeds.select("path", "strength"), files, "path").select("path", "strength")
    done, out = frontier.select("path"), None
    for hop in range(1, hops + 1):
        taken = frontier.join(step, frontier["path"] == step["from"]).select(
            F.col("to").alias("path"), F.concat("how", "from").alias("reason"), F.lit(hop).alias("hop"), (F.col("strength") * decay).alias("gain")
        )
        taken = _known(taken, files, "path").select("path", "reason", "hop", "gain")
        out = taken if out is None else out.unionByName(taken)
        if hop < hops:
            frontier = taken.groupBy("path").agg(F.max("gain").alias("strength")).join(done, "path", "left_anti")
            done = done.unionByName(frontier.select("path"))
    return out


def import_specifiers(sources: DataFrame) -> DataFrame:
    """(path, spec) of static imports and re-exports in TypeScript and JavaScript texts."""
    lang = S.detect_language(F.col("path"))
    src = sources.filter(lang.isin("typescript", "tsx", "javascript") & F.col("text").isNotNull())
    spec = F.regexp_extract_all("text", F.lit(r"""(?m)^[ \t\ufeff]*(?:import|export)\s(?:[\w$*{},\s]*\sfrom\s*)?["']([^"'\n]+)["']"""), 1)
    return src.select("path", F.explode(F.array_distinct(spec)).alias("spec"))


def script_edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges of relative specifiers: the path with each probed ending, as it is, then its index file."""
    s = import_specifiers(sources).filter(F.col("spec").startswith("."))
    base = S.resolve_dots(F.concat_ws("/", S.dirname(F.col("path")), "spec"))
    s = s.select("path", base.alias("base"))
    tries = [F.concat("base", F.lit(e)) for e in PROBED] + [F.col("base")] + [F.concat("base", F.lit("/index" + e)) for e in PROBED]
    t = s.select("path", "base", F.posexplode(F.array(*tries)).alias("pos", "dst"))
    hit = t.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return dedupe(hit.groupBy("path", "base").agg(F.min_by("dst", "pos").alias("dst")).select(F.col("path").alias("src"), "dst", F.lit("import").alias("kind")))


def _with_repo(df: DataFrame) -> DataFrame:
    return df if "repo" in df.columns else df.withColumn("repo", F.lit(""))


def csharp_edges(sources: DataFrame, types: DataFrame) -> DataFrame:
    """Import edges from a C# file to the nearest file of its repository that defines a type it names.

    ``types`` is (path, name); both sides may have a column repo. Of several definitions the one with the
    smallest directory distance counts, then the smallest path. Uses and definitions of a name are never
    paired: under each directory only the shallowest definition is kept, and a use looks that up for each
    directory above it, as the nearest definition is the shallowest one below some common directory.
    """
    src = _with_repo(sources).filter((S.detect_language(F.col("path")) == "csharp") & F.col("text").isNotNull())
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)))
    t = _with_repo(types).select("repo", "path", "name").distinct()
    used = src.select("repo", "path", names.alias("name")).join(t.select("repo", "name").distinct(), ["repo", "name"], "left_semi").join(t, ["repo", "path", "name"], "left_anti")
    up = S.ancestors(F.col("path"))
    depth = F.size(up) - 1
    below = t.select("repo", "name", depth.alias("deep"), F.col("path").alias("dst"), F.explode(up).alias("dir")).groupBy("repo", "name", "dir").agg(F.min(F.struct("deep", "dst")).alias("d"))
    above = used.select("repo", "path", "name", depth.alias("mine"), F.posexplode(up).alias("level", "dir"))
    far = F.col("mine") + F.col("d.deep") - 2 * F.col("level")
    near = above.join(below, ["repo", "name", "dir"]).groupBy("repo", "path", "name").agg(F.min(F.struct(far.alias("far"), F.col("d.dst").alias("dst"))).alias("x"))
    return dedupe(near.select(F.col("path").alias("src"), F.col("x.dst").alias("dst"), F.lit("import").alias("kind")))


def test_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Test edges by name (login.test.ts tests login.ts, FooTests.cs tests Foo.cs) and by imports of non-tests."""
    t = files.filter("kind = 'test'").select("path")
    stem, e, folder = S.stem(F.col("path")), S.ext(F.col("path")), S.dirname(F.col("path"))
    bases = F.array(*(F.when(cond, F.expr(f"substring(stem, 1, length(stem) - {n})")) for cond, n in [(F.lower(stem).endswith(".test"), 5), (F.lower(stem).endswith(".spec"), 5), (stem.endswith("Tests"), 5), (stem.endswith("Test"), 4)]))
    named = t.withColumn("stem", stem).select("path", e.alias("e"), folder.alias("folder"), F.explode(F.filter(bases, lambda b: b.isNotNull())).alias("base"))
    up = F.when(F.col("folder").endswith("/__tests__"), F.regexp_replace("folder", "/__tests__$", ""))
    named = named.select("path", F.explode(F.array("folder", up)).alias("folder"), F.concat("base", "e").alias("name")).filter("folder IS NOT NULL")
    named = named.select("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")).alias("dst"))
    by_name = named.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    plain = files.filter("kind <> 'test'").select(F.col("path").alias("dst")).distinct()
    by_import = imports.filter("kind = 'import'").select(F.col("src").alias("path"), "dst").join(t, "path", "left_semi").join(plain, "dst", "left_semi")
    return dedupe(by_name.select("path", "dst").unionByName(by_import.select("path", "dst")).select(F.col("path").alias("src"), "dst", F.lit("test").alias("kind")))


def centrality(edges: DataFrame, top: int | None = None) -> DataFrame:
    """(path, n): files by the number of imports that lead to them."""
    c = edges.filter("kind = 'import'").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    return c if top is None else c.orderBy(F.desc("n"), "path").limit(top)


def without_dependents(files: DataFrame, edges: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(edges.filter("kind = 'import'").select(F.col("dst").alias("path")), "path", "left_anti")


def with_outgoing(files: DataFrame, edges: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(edges.filter("kind = 'import'").select(F.col("src").alias("path")), "path", "left_semi")
