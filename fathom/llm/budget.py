"""Token budget of every slice (problem 1).

Tokenizing everything only to count is wasteful, so the count is predicted: bytes are classified with
a lookup table, a batch of texts at a time, and per language a linear model of the classes is fitted
on a bounded sample of documents that is also tokenized. Half of the sample is held out; the ratio of
its real to its predicted tokens corrects the bias of the language, also where the language has too few
documents for a model of its own and the model of all languages serves. Tokenized documents keep their count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_path
from ..session import cut_lineage, tune, widen
from .tokenize import encode, vocabulary

FEATURES = ["n_bytes", "letters", "words", "humps", "digits", "numbers", "punctuation", "signs", "spaces", "gaps", "lines", "two_byte", "three_byte", "four_byte", "scripts"]

_LOWER, _UPPER, _DIGIT, _PUNCT, _SPACE, _LINE, _TWO, _THREE, _FOUR, _TAIL = range(10)
_CLASS = np.full(256, _PUNCT, np.uint8)
for _lo, _hi, _k in (("a", "z", _LOWER), ("A", "Z", _UPPER), ("0", "9", _DIGIT)):
    _CLASS[ord(_lo) : ord(_hi) + 1] = _k
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = _TAIL, _TWO, _THREE, _FOUR


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow string array; zeros for null and empty texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi]
    at, k = offsets - lo, _CLASS[data]
    before = np.concatenate([[255], k[:-1]]) if len(k) else k
    if len(k):
        before[at[:-1][at[:-1] < len(k)]] = 255

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    letter, was_letter = k <= _UPPER, before <= _UPPER
    wide, was_wide = (k >= _TWO) & (k < _TAIL), (before >= _TWO) & (before <= _TAIL)
    return np.column_stack([
        np.diff(at), per_text(letter), per_text(letter & ~was_letter), per_text((k == _UPPER) & (before == _LOWER)),
        per_text(k == _DIGIT), per_text((k == _DIGIT) & (before != _DIGIT)), per_text(k == _PUNCT), per_text((k == _PUNCT) & (before != _PUNCT)),
        per_text(k == _SPACE), per_text((k == _SPACE) & (before != _SPACE)), per_text(k == _LINE),
        per_text(k == _TWO), per_text(k == _THREE), per_text(k == _FOUR), per_text(wide & ~was_wide),
    ]).astype(np.float64)


def language_of(path: Column, lang: Column) -> Column:
    """One spelling per language: by the ending of the path, else by the stated language, else 'none'."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\s*$", 1))
    said = F.lower(F.trim(lang))
    name = F.when(ext == "tsx", "tsx")
    for endings, language in ((("ts", "mts", "cts"), "typescript"), (("js", "jsx", "mjs", "cjs"), "javascript"), (("cs",), "csharp"), (("md", "mdx", "markdown"), "markdown"), (("json",), "json")):
        name = name.when(ext.isin(*endings), language)
    for spellings, language in ((("typescript", "ts"), "typescript"), (("tsx",), "tsx"), (("javascript", "js"), "javascript"), (("csharp", "cs", "c#"), "csharp"), (("markdown", "md"), "markdown"), (("json",), "json")):
        name = name.when((ext == "") & said.isin(*spellings), language)
    return F.coalesce(name, F.lit("none"))


def features(docs: DataFrame, sample: Column, ranks: str | None = None) -> DataFrame:
    """Per document its FEATURES and, where ``sample`` holds, its real number of tokens."""
    path = ranks or vocabulary()
    tune(docs.sparkSession)
    keep = ["doc_id", "source", "path", "language"]

    def run(batches):
        for b in batches:
            texts = b.column(0)
            n = [len(encode(t, path)) if s else None for t, s in zip(texts.to_pylist(), b.column(1).to_pylist())] if any(b.column(1).to_pylist()) else [None] * len(texts)
            m = text_features(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(m[:, i]) for i in range(len(FEATURES))), pa.array(n, pa.int64())], names=[*keep, *FEATURES, "n_tokens"])

    schema = "doc_id bigint, source string, path string, language string, " + ", ".join(f"{f} double" for f in FEATURES) + ", n_tokens bigint"
    return widen(docs.select(F.col("text").cast("string"), F.coalesce(sample, F.lit(False)).alias("sampled"), *keep)).mapInArrow(run, schema)


def fit(rows, holdout: float = 0.5) -> tuple[dict[str, tuple[np.ndarray, float]], list[tuple[str, int, float, float]]]:
    """(models, holdouts) from sampled rows in a random order.

    models: per language (and '' for all) the coefficients and the bias correction. holdouts: (language,
    documents, tokens, predicted tokens before the correction) of what no model was fitted on.
    """
    by: dict[str, list] = {}
    for r in rows:
        if r["n_bytes"]:
            by.setdefault(r["language"], []).append(r)
            by.setdefault("", []).append(r)
    models, holdouts = {}, []
    # the model of all languages leaves out the same documents as those of the single ones
    held = {id(r) for language, own in by.items() if language for r in own[max(1, int(len(own) * (1 - holdout))) :]}
    for language in sorted(by):
        own = by[language]
        x = np.array([[r[f] for f in FEATURES] for r in own])
        y = np.array([r["n_tokens"] for r in own], float)
        test = np.array([id(r) in held for r in own])
        train = ~test
        if train.sum() < 4 * len(FEATURES) and language:
            coef = models[""][0]  # too few of this language
        else:
            w = 1 / np.sqrt(x[:, :1])
            scale = np.maximum(x[train].std(0), 1)
            a = np.vstack([(x * w / scale)[train], np.sqrt(1e-3) * np.eye(len(FEATURES))])
            coef = np.linalg.lstsq(a, np.concatenate([(y * w[:, 0])[train], np.zeros(len(FEATURES))]), rcond=None)[0] / scale
        use = test if test.any() else train
        said = np.maximum(x[use] @ coef, 1).sum()
        models[language] = coef, float(y[use].sum() / said)
        holdouts.append((language or "*", int(use.sum()), float(y[use].sum()), float(said)))
    return models, holdouts


def _sampled(docs: DataFrame, per_language: int, seed: int, ranks: str | None) -> tuple[DataFrame, list]:
    """Features of all documents with the tokens of the sample, and the sample's rows in a random order."""
    docs = docs.withColumn("language", language_of(F.col("path"), F.col("lang")))
    counts = {r["language"]: r["n"] for r in docs.filter(F.col("text").isNotNull()).groupBy("language").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "path", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col("language") == language, min(1.0, per_language / n)).otherwise(rate)
    feats = cut_lineage(features(docs, draw < rate, ranks))
    rows = feats.filter(F.col("n_tokens").isNotNull()).select("doc_id", "language", "n_tokens", *FEATURES).collect()
    return feats, sorted(rows, key=lambda r: hash((seed, r["doc_id"], r["n_tokens"])))


def estimate_tokens(docs: DataFrame, per_language: int = 400, seed: int = 42, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, path, language, est_tokens) of every document.

    ``docs`` has doc_id, text, lang, source and path. About ``per_language`` documents of each language
    are tokenized, chosen by a seeded hash of the path and id: this bounds what reaches the driver. For
    those the number is exact. Null and empty texts have 0 tokens; any other text at least 1. Rows are
    kept as they come.
    """
    feats, rows = _sampled(docs, per_language, seed, ranks)
    models, _ = fit(rows)

    def value(coef, ratio) -> Column:
        total = F.lit(0.0)
        for f, c in zip(FEATURES, coef):
            total = total + F.col(f) * float(c)
        return F.greatest(F.round(total * ratio), F.lit(1.0)).cast("long")

    est = value(*models[""]) if "" in models else F.greatest(F.round(F.col("n_bytes") / 4), F.lit(1.0)).cast("long")
    for language, model in models.items():
        if language:
            est = F.when(F.col("language") == language, value(*model)).otherwise(est)
    return feats.select("doc_id", "source", "path", "language", F.when(F.col("n_bytes") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("n_tokens", est)).alias("est_tokens"))


def holdout_errors(docs: DataFrame, per_language: int = 400, seed: int = 42, ranks: str | None = None) -> DataFrame:
    """(language, documents, tokens, predicted_tokens, ratio) on the documents that no model was fitted on; '*' is the model of all.

    ``ratio`` is the bias that the estimate is corrected by.
    """
    _, rows = _sampled(docs, per_language, seed, ranks)
    found = [(language, n, int(real), said, real / said) for language, n, real, said in fit(rows)[1]]
    return docs.sparkSession.createDataFrame(found, "language string, documents long, tokens long, predicted_tokens double, ratio double")


def newest_files(files: DataFrame) -> DataFrame:
    """The newest row of each file: latest snapshot, then latest indexed_at; paths in normal form."""
    order = F.struct(F.col("snapshot_id"), F.col("indexed_at"), F.xxhash64("language", "kind", "token_count"))
    return files.withColumn("path", norm_path(F.col("path"))).groupBy("path").agg(F.max_by(F.struct("language", "kind", "token_count"), order).alias("f")).select("path", "f.*")


def document_tokens(docs: DataFrame, files: DataFrame, repos: DataFrame, **options) -> DataFrame:
    """One row per document: its slice, estimate, and the stored count with a verdict on it.

    A stored count is trusted where it lies between half and twice the estimate; the estimate is what
    counts in any case. Language and kind come from the file's newest row; a missing language is
    derived from the path, a missing kind is 'unknown'. Sources without a domain have 'unknown'.
    """
    est = estimate_tokens(docs, **options)
    f = newest_files(files).select("path", F.nullif(F.lower(F.trim("language")), F.lit("")).alias("f_language"), "kind", F.col("token_count").alias("stored_tokens"))
    r = repos.groupBy(F.col("repo").alias("source")).agg(F.max("domain").alias("domain"))
    stored = F.col("stored_tokens")
    return (
        est.join(f, "path", "left").join(r, "source", "left")
        .select("doc_id", "source", F.coalesce("f_language", "language").alias("language"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "est_tokens", F.col("stored_tokens").cast("long").alias("stored_tokens"), F.coalesce((stored >= F.col("est_tokens") / 2) & (stored <= F.col("est_tokens") * 2), F.lit(False)).alias("stored_trusted"))
    )


def token_budget(doc_tokens: DataFrame) -> DataFrame:
    """Totals for each full slice, each single dimension and all; a dimension not grouped by is '*'."""
    dims = ["source", "language", "domain", "kind"]
    cols = [F.col(d) for d in dims]
    sets = [cols, *([c] for c in cols), []]
    out = doc_tokens.groupingSets(sets, *cols).agg(
        F.count("*").alias("documents"), F.sum("est_tokens").alias("est_tokens"), F.sum(F.col("stored_trusted").cast("long")).alias("trusted_counts"), *(F.grouping(d).alias(f"g_{d}") for d in dims)
    )
    return out.select(*(F.when(F.col(f"g_{d}") == 1, "*").otherwise(F.coalesce(d, F.lit("unknown"))).alias(d) for d in dims), "documents", "est_tokens", "trusted_counts")
