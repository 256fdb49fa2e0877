import pytest
from pyspark.sql import functions as F

from fathom.functions import scalars as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'bigint'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, parts", [
    ("loginUser", ["login", "user"]), ("APIController", ["api", "controller"]), ("IUserService", ["i", "user", "service"]),
    ("parseJSON2Object", ["parse", "json", "2", "object"]), ("create_session", ["create", "session"]), ("", []), (None, None),
])
def test_split_identifier(spark, name, parts):
    assert one(spark, S.split_identifier(F.col("n")), n=name) == parts


@pytest.mark.parametrize("n, want", [(75, 75), (99, 99), (123, 120), (150, 150), (9934, 9900), (9950, 10000), (999499, 1000000)])
def test_quantize(spark, n, want):
    assert one(spark, S.quantize(F.col("n")), n=n) == want


@pytest.mark.parametrize("n, rate, currency, want", [(1_000_000, 5.0, "USD", "$5.00"), (73_358, 5.0, "USD", "$0.37"), (-100_000, 5.0, "USD", "-$0.50"), (-79, 5.0, "USD", "$0.00"), (1_000_000, 4.0, "EUR", "EUR 4.00"), (5, 0.0, "USD", None)])
def test_price(spark, n, rate, currency, want):
    assert one(spark, S.price(F.col("n"), rate, currency), n=n) == want


@pytest.mark.parametrize("path, rules, want", [
    ("a/node_modules/x.js", ["node_modules"], True), ("a/b.min.js", ["*.min.js"], True), ("a/.env.local", [".env*"], True), ("build/x", ["/build"], True), ("a/build/x", ["/build"], False),
    ("a/dist/x", ["dist/"], True), ("a/dist", ["dist/"], False), ("keep.log", ["*.log", "!keep.log"], False), ("other.log", ["*.log", "!keep.log"], True), ("docs/tmp/a", ["docs/**/tmp"], True), ("docs/x/y/tmp/a", ["docs/**/tmp"], True), ("x", ["# x", ""], False),
])
def test_ignore(spark, path, rules, want):
    assert one(spark, S.is_ignored(F.col("p"), S.ignore_rules(rules)), p=path) is want


@pytest.mark.parametrize("raw, want", [("./a//b", "a/b"), (" a\\b ", "a/b"), ("/a/b", "a/b"), ("a/b", "a/b"), ("", ""), (None, None), (".github/x", ".github/x")])
def test_norm_path(spark, raw, want):
    assert one(spark, S.norm_path(F.col("p")), p=raw) == want


@pytest.mark.parametrize("raw, want", [("a/./b/../c", "a/c"), ("../x", "x"), ("", ""), ("a//b", "a/b")])
def test_resolve_dots(spark, raw, want):
    assert one(spark, S.resolve_dots(F.col("p")), p=raw) == want


@pytest.mark.parametrize("a, b, want", [("a/b", "a/c", 2), ("a", "a", 0), ("", "a/b", 2), ("a/b/c", "a", 2), ("x/b", "y/b", 4)])
def test_dir_distance(spark, a, b, want):
    assert one(spark, S.dir_distance(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize("text, n, count", [("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\r\nb\r", 2, 2 - 0), ("\n\n", 2, 2)])
def test_lines(spark, text, n, count):
    assert one(spark, F.size(S.lines(F.col("t"))), t=text) == n


@pytest.mark.parametrize("reasons, want", [
    (["fts", "fts"], ["fts"]), (["imports:a", "imports:b", "imports:c", "test-of:d", "x"], ["imports:a", "imports:b", "graph:+2", "x"]), ([], []), (["a", "imports:x"], ["a", "imports:x"]),
])
def test_compress_reasons(spark, reasons, want):
    df = spark.createDataFrame([(reasons,)], "r array<string>")
    assert df.select(S.compress_reasons(F.col("r")).alias("x")).first()["x"] == want


def test_kinds(spark):
    df = spark.createDataFrame([(p,) for p in ["a/x.test.ts", "Tests/A.cs", "README", "a.md", "tsconfig.json", "x/appsettings.txt", "a.cs", "a.go", "a.bin"]], "p string")
    assert [r["k"] for r in df.select(S.classify_kind(F.col("p")).alias("k")).collect()] == ["test", "test", "doc", "doc", "config", "config", "source", "source", "other"]


def test_receipt_is_the_same_on_both_sides(spark):
    from fathom.operators import identity

    want = identity.canonical("r1", "src/é.ts", "ab")
    got = one(spark, S.canonical_hash(F.lit("r1"), F.col("p"), F.lit("ab")), p="src/é.ts")
    assert got == want
    assert len(one(spark, S.receipt(F.lit(want)), p="x")) == 43
