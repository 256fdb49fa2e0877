"""Queries of the operators in this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import budget, credentials, docpairs, mixture, pieces, provenance, syntax, terms, tokenize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_token_budget(spark, d):
    return budget.token_budget(p1_document_tokens(spark, d))


@query
def p1_document_tokens(spark, d):
    return budget.document_tokens(table(spark, d, "documents"), table(spark, d, "files"), table(spark, d, "repos"))


@query
def p1_holdout(spark, d):
    """How far the models are off, by language, on documents that they were not fitted on."""
    return budget.holdout_errors(table(spark, d, "documents"))


@query
def p8_ids(spark, d):
    return tokenize.encode_ids(table(spark, d, "documents"))


@query
def p8_decoded(spark, d):
    return tokenize.decode_ids(p8_ids(spark, d)).selectExpr("doc_id", "decode(raw, 'UTF-8') AS text")


SQL["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p9_mix(spark, d):
    return mixture.mix(mixture.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@query
def p9_shares(spark, d):
    sized, targets = mixture.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixture.shares(sized, mixture.mix(sized, targets), targets, mixture.budgets(sized, targets)[0])


@query
def p10_pieces(spark, d):
    limits = [(r["profile"], r["max_tokens"], r["overlap_tokens"]) for r in table(spark, d, "split_limits").collect()]
    return pieces.split_documents(table(spark, d, "documents"), limits)


@query
def p2_found(spark, d):
    """The cases among the rows of the operator: exact counts decide, the score (in p2_scores) does not."""
    return terms.score_terms(table(spark, d, "chunks")).filter("tf >= 3 AND records BETWEEN 2 AND 6").select("chunk_id", "term")


SQL["p2_found"] = r"""
WITH one AS (SELECT DISTINCT chunk_id, heading, content FROM chunks),
runs AS (SELECT chunk_id, unnest(regexp_extract_all(coalesce(heading, '') || chr(10) || coalesce(content, ''), '[A-Z]+[a-z]*|[a-z]+')) AS t FROM one),
tf AS (SELECT chunk_id, lower(t) AS term, count(*) AS n FROM runs WHERE length(t) >= 5 GROUP BY ALL),
df AS (SELECT term, count(*) AS records FROM tf GROUP BY term HAVING count(*) BETWEEN 2 AND 6)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE n >= 3
"""


@query
def p2_scores(spark, d):
    """Every term of every chunk with its score; p2_top_terms is a report on it."""
    return terms.score_terms(table(spark, d, "chunks"))


@query
def p2_top_terms(spark, d):
    return terms.score_terms(table(spark, d, "chunks"), top=10)


@query
def p5_found(spark, d):
    return syntax.check_syntax(table(spark, d, "documents")).filter("NOT valid").select("path")


@query
def p5_rates(spark, d):
    return syntax.failure_rates(syntax.check_syntax(table(spark, d, "documents")), budget.newest_files(table(spark, d, "files")))


@query
def p3_found(spark, d):
    return docpairs.symbol_pairs(table(spark, d, "symbols"), table(spark, d, "documents")).select("symbol_id")


@query
def p3_source_pairs(spark, d):
    return docpairs.source_pairs(table(spark, d, "documents"))


@query
def p6_found(spark, d):
    chunks = credentials.find_credentials(table(spark, d, "chunks"), "chunks", "chunk_id", "content")
    return chunks.unionByName(credentials.find_credentials(table(spark, d, "appsettings"), "appsettings", "settings_id", "body"))


@query
def p6_redacted_chunks(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "path", "start_line", "content")
    return credentials.redact_credentials(chunks, "content")


@query
def p6_redacted_settings(spark, d):
    return credentials.redact_credentials(table(spark, d, "appsettings").select("settings_id", "path", "environment", "body"), "body")


@query
def p7_found(spark, d):
    return provenance.machine_made(table(spark, d, "documents"), table(spark, d, "thirdparty")).select("path").distinct()


@query
def p7_reasons(spark, d):
    made = provenance.machine_made(table(spark, d, "documents"), table(spark, d, "thirdparty"))
    return made.groupBy("source", "reason").count()


@query
def p7_mined_patterns(spark, d):
    return provenance.mine_patterns(provenance.classify_files(table(spark, d, "documents"), table(spark, d, "thirdparty")))


def _all_wanted(sized, targets) -> int:
    wanted = sized.join(targets.filter("target_share > 0").select("source").distinct(), "source", "left_semi")
    return wanted.selectExpr("coalesce(sum(n_tokens), 0) AS n").first()["n"]


@query
def p9_shares_of_everything(spark, d):
    """Shares where the mix is as large as all wanted sources: sources at their cap are fixed, the others share the rest."""
    sized, targets = mixture.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    total = _all_wanted(sized, targets)
    return mixture.shares(sized, mixture.mix(sized, targets, total=total), targets, mixture.budgets(sized, targets, total)[0])


@query
def p9_shares_by_entropy(spark, d):
    """Natural shares of the wanted sources, flattened half of the way to the entropy of equal shares, as large as the caps allow."""
    sized, targets = mixture.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    budget, have, _ = mixture.budgets(sized, targets)
    entropy = mixture.between(have, budget, 0.5)
    return mixture.shares(sized, mixture.mix(sized, targets, wanted_entropy=entropy), targets, mixture.budgets(sized, targets, None, entropy)[0])


# -- properties that SQL can state where it can't state the rows


@query
def p1_documents(spark, d):
    """Documents by source in the budget, and those among them without a token."""
    t = p1_document_tokens(spark, d)
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("est_tokens") == 0).cast("long")).alias("empty"))


SQL["p1_documents"] = "SELECT source, count(*) AS documents, sum((coalesce(text, '') = '')::BIGINT)::BIGINT AS empty FROM documents GROUP BY source"


@query
def p5_checked(spark, d):
    """Files by the language of their ending: all, and those with a text to parse."""
    c = syntax.check_syntax(table(spark, d, "documents"))
    return c.groupBy("language").agg(F.count("*").alias("files"), F.count("valid").alias("checked"))


SQL["p5_checked"] = r"""
WITH x AS (SELECT regexp_extract(lower(path), '\.(tsx?|js|cs|json)$', 1) AS e, text FROM documents)
SELECT CASE e WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'cs' THEN 'csharp' ELSE 'json' END AS language,
  count(*) AS files, count(*) FILTER (WHERE regexp_matches(text, '[^\s]')) AS checked FROM x WHERE e <> '' GROUP BY ALL
"""


@query
def p6_left(spark, d):
    """Credentials that are found in the redacted texts, and rows whose number of lines has changed."""
    out = None
    for name, key, col in (("chunks", "chunk_id", "content"), ("appsettings", "settings_id", "body")):
        t = table(spark, d, name).select(key, col, F.length(F.regexp_replace(col, "[^\n]", "")).alias("lines"))
        clean = credentials.redact_credentials(t, col)
        again = credentials.redact_credentials(clean.drop("n_credentials"), col)
        one = again.select(F.lit(name).alias("tab"), F.col("n_credentials").cast("long").alias("n"), (F.length(F.regexp_replace(col, "[^\n]", "")) != F.col("lines")).cast("long").alias("moved"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tab").agg(F.sum("n").alias("found"), F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))


SQL["p6_left"] = "SELECT unnest(['chunks', 'appsettings']) AS tab, 0::BIGINT AS found, 0::BIGINT AS moved"


@query
def p7_judged(spark, d):
    """Code files with a text that were judged, by source."""
    return provenance.classify_files(table(spark, d, "documents"), table(spark, d, "thirdparty")).groupBy("source").agg(F.count("*").alias("files"))


SQL["p7_judged"] = r"SELECT source, count(*) AS files FROM documents WHERE regexp_matches(path, '\.(tsx?|js|cs)\s*$') AND length(trim(text)) > 0 GROUP BY source"


@query
def p9_violations(spark, d):
    """Records of the mix that are repeated more often than their source's cap, unwanted, or chosen twice."""
    sized, targets = mixture.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    m = mixture.mix(sized, targets).join(targets.groupBy("source").agg(F.max("max_repeats").alias("cap"), F.max("target_share").alias("share")), "source", "left")
    many = F.count("*") - F.count_distinct("doc_id")
    return m.agg(F.coalesce(F.sum((F.col("repeats") > F.col("cap")).cast("long")), F.lit(0)).alias("over_cap"), F.coalesce(F.sum((F.coalesce("share", F.lit(0.0)) <= 0).cast("long")), F.lit(0)).alias("unwanted"), many.alias("twice"))


SQL["p9_violations"] = "SELECT 0::BIGINT AS over_cap, 0::BIGINT AS unwanted, 0::BIGINT AS twice"


@query
def p10_violations(spark, d):
    """Pieces above their limit or overlap, gaps between pieces, and texts that the pieces don't give again."""
    limits = table(spark, d, "split_limits").select("profile", "max_tokens", F.col("overlap_tokens").alias("most"))
    w = Window.partitionBy("doc_id", "profile").orderBy("piece")
    p = p10_pieces(spark, d).join(F.broadcast(limits), "profile").withColumn("done", F.coalesce(F.lag("end").over(w), F.lit(0)))
    whole = p.groupBy("doc_id", "profile").agg(
        F.sum((F.col("n_tokens") > F.col("max_tokens")).cast("long")).alias("large"), F.sum((F.col("overlap_tokens") > F.col("most")).cast("long")).alias("shared"), F.sum((F.col("start") > F.col("done")).cast("long")).alias("gaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, done - start + 1)").alias("t")))), lambda x: x["t"]), "").alias("again"),
    )
    j = whole.join(table(spark, d, "documents").select("doc_id", F.col("text").alias("given")), "doc_id")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(zero("large").alias("over_limit"), zero("shared").alias("over_overlap"), zero("gaps").alias("gaps"), zero((F.col("again") != F.col("given")).cast("long")).alias("other_text"))


SQL["p10_violations"] = "SELECT 0::BIGINT AS over_limit, 0::BIGINT AS over_overlap, 0::BIGINT AS gaps, 0::BIGINT AS other_text"
