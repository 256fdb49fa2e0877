import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import budget, mixture, pieces, tokenize
from fathom.llm.tokenize import encode, vocabulary

PATH = vocabulary()
TEXTS = [None, "", " ", "a", "héllo wörld\r\n\tx  y\n\n", "日本語のテキスト", "👩‍🔧 ok", "x" * 3000, "word " * 30_000, "\n" * 5000, "<|endoftext|>"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")


def test_ids_round_trip(spark):
    df = frame(spark, [*TEXTS, "a"])
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_ids(df).collect()}
    assert len(got) == len(TEXTS) + 1 and got[0] == got[1] == []
    assert all(bytes(tokenize.decode(got[i], PATH)) == (t or "").encode() for i, t in enumerate(TEXTS))
    raw = {r["doc_id"]: r["raw"] for r in tokenize.decode_ids(tokenize.encode_ids(df)).collect()}
    assert bytes(raw[5]).decode() == TEXTS[5]
    assert tokenize.encode_ids(df.limit(0)).count() == 0
    counts = tokenize.count_tokens(df).collect()
    assert sorted(counts[0].asDict()) == ["doc_id", "ids", "n_tokens"] and all(r["n_tokens"] == len(got[r["doc_id"]]) for r in counts)


@given(st.text(alphabet=st.sampled_from("ab1.' \n\té日👩"), max_size=400), st.integers(5, 50))
@settings(max_examples=300, deadline=None)
def test_blocks_do_not_change_the_ids(text, size):
    whole = tokenize.encoding(PATH).encode_ordinary(text)
    parts = [i for b in tokenize.blocks(text, size) for i in tokenize.encoding(PATH).encode_ordinary(b)]
    assert parts == whole


def check_pieces(text, most, overlap):
    cut = pieces.split_text(text, most, overlap, PATH)
    total = len(encode(text, PATH))
    assert bool(cut) == (total > most)
    done = 0
    for s, e, n, shared, _ in cut:
        assert n == len(encode(text[s:e], PATH)) <= most
        assert s <= done < e and shared == len(encode(text[s:done], PATH)) <= overlap
        done = e
    assert done == (len(text) if cut else 0)


@given(st.text(alphabet=st.sampled_from("abcdefgh ().;\n\t é日👩"), min_size=1, max_size=900), st.sampled_from([(16, 0), (16, 4), (32, 8), (64, 32)]))
@settings(max_examples=200, deadline=None)
def test_pieces(text, limit):
    check_pieces(text, *limit)


@pytest.mark.parametrize("text", ["x" * 5000, "abc " * 3000, "日本語" * 500, "a\n\n\n   b  \n\tc " * 300, " " * 2000 + "x", "\n" * 1500, "q\r\n\r\n  z" * 300, "日本 　\n　語" * 200])
def test_pieces_of_odd_texts(text):
    for limit in ((256, 32), (512, 64), (1024, 0)):
        check_pieces(text, *limit)


@pytest.mark.parametrize("unit", ["x", "日本語", "ab1!", " ", "👩‍🔧", "日本語のテキスト。", "word "])
def test_pieces_take_time_in_proportion(unit):
    import time

    text = unit * (1_000_000 // len(unit.encode()))
    began = time.time()
    cut = pieces.split_text(text, 512, 64, PATH)
    assert time.time() - began < 10
    done = 0
    for s, e, n, shared, _ in cut:
        assert s <= done < e and n <= 512 and shared <= 64
        done = e
    assert done == len(text)
    assert tokenize.decode(encode(text, PATH), PATH) == text.encode()


def test_natural_boundaries():
    para = "One sentence here. Another one follows it. And a third.\n"
    kinds = lambda text, most: [k for *_, k in pieces.split_text(text, most, 0, PATH)]
    assert kinds((para * 2 + "\n") * 40, 32)[0] == "paragraph"
    assert set(kinds("Some words make a sentence. " * 60, 64)) == {"sentence", "end"}
    assert set(kinds("再試行は七百十三回までです。" * 60, 128)) == {"sentence", "end"}
    assert set(kinds("ab12" * 600, 64)) == {"joint", "end"} and set(kinds("x" * 6000, 64)) == {"hard", "end"}


def test_long_white_space():
    for n in (70_000, 140_000):
        for text in (" " * n + "x", "a" + " " * n, "a" + "\n" * n + " b", "é" + "\u3000" * n + "é"):
            assert list(encode(text, PATH)) == tokenize.encoding(PATH).encode_ordinary(text)
    assert len(encode(" " * 2_000_000 + "x", PATH)) == 2_000_000


@given(st.text(alphabet=st.sampled_from("ab1.' \n\té日👩sdt!?-。\u0301\u200b\xa0\x1c٣²'"), max_size=40))
@settings(max_examples=500, deadline=None)
def test_joints_do_not_change_the_ids(text):
    whole = tokenize.encoding(PATH).encode_ordinary(text)
    for j in tokenize.joints(text):
        assert tokenize.encoding(PATH).encode_ordinary(text[:j]) + tokenize.encoding(PATH).encode_ordinary(text[j:]) == whole


def test_pieces_end_at_lines(spark):
    text = "\n".join(f"line number {i} has some words" for i in range(200))
    df = frame(spark, [None, "", "short", text, text])
    got = pieces.split_documents(df, [("s", 64, 8), ("l", 100_000, 0)]).collect()
    assert {r["doc_id"] for r in got} == {3, 4} and {r["profile"] for r in got} == {"s"}
    assert all(r["text"] == text[r["start"] : r["end"]] and r["cut"] in ("line", "end") for r in got)
    assert pieces.split_documents(df.limit(0), [("s", 64, 8)]).count() == 0
    assert pieces.split_documents(df, []).count() == 0
    with pytest.raises(ValueError):
        pieces.split_text("x y " * 100, 10, 6, PATH)


TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, spec):
    rows, i = [], 0
    rnd = random.Random(3)
    for source, n in spec.items():
        for _ in range(n):
            rows.append((i, source, rnd.randint(1, 40), "clash"))
            i += 1
    return spark.createDataFrame([*rows, (-1, "a", 0, ""), (-2, None, 5, "")], "doc_id long, source string, n_tokens long, passes string")


def test_mix_reaches_shares_within_caps(spark):
    s = sized(spark, {"a": 4000, "b": 300, "c": 60, "unwanted": 50, "zero": 20})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 8), ("c", 0.1, 2), ("absent", 0.1, 3), ("zero", 0.0, 3), (None, 0.1, 1)], TARGETS)
    m = mixture.mix(s, t)
    got = {r["source"]: r for r in mixture.shares(s, m, t).collect()}
    assert got["unwanted"]["mixed_tokens"] == got["zero"]["mixed_tokens"] == got["absent"]["mixed_tokens"] == 0
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[source]["reached_share"] - share) < 0.005
        assert got[source]["most_repeats"] <= {"a": 1, "b": 4, "c": 8}[source]
    # the largest total at which no cap is exceeded: one source is at its cap
    assert any(got[x]["mixed_tokens"] > 0.99 * got[x]["available_tokens"] * k for x, k in (("a", 1), ("b", 4), ("c", 8)))
    assert m.filter("doc_id < 0").count() == 0
    assert m.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixture.mix(s.repartition(7), t).collect()))


def test_mix_with_a_wanted_total(spark):
    available, targets = {"a": 1000, "b": 100}, {"a": (0.5, 2), "b": (0.5, 2)}
    plan, a = mixture.plan(available, targets, 1000)
    assert 0 < a < 1 and abs(plan["b"] - 200) <= 1 and abs(sum(plan.values()) - 1000) <= 2
    assert mixture.plan(available, targets, 300) == ({"a": 150, "b": 150}, 1.0)
    assert mixture.plan({}, targets) == ({}, 1.0)
    w = mixture.flatten_to_entropy({"a": 0.9, "b": 0.1}, 0.6)
    assert abs(mixture.entropy(w) - 0.6) < 1e-6


def test_caps_that_bind_leave_the_rest_to_the_others():
    available = {"a": 1000, "b": 1000, "c": 10}
    targets = {"a": (0.4, 1), "b": (0.4, 3), "c": (0.2, 1)}
    plan, a = mixture.plan(available, targets, 2000)
    assert plan == {"a": 990 + 5, "b": 995, "c": 10} or plan["c"] == 10 and plan["a"] <= 1000 and abs(sum(plan.values()) - 2000) <= 2
    plan, _ = mixture.plan(available, targets, 10**9)
    assert plan == {"a": 1000, "b": 3000, "c": 10}
    want = mixture.between(available, targets, 0.5)
    plan, _ = mixture.plan(available, targets, wanted_entropy=want)
    total = sum(plan.values())
    assert abs(mixture.entropy({s: n / total for s, n in plan.items()}) - want) < 0.05 and all(plan[s] <= available[s] * targets[s][1] for s in plan)


def test_rests_are_filled_with_smaller_records(spark):
    rows = [(i, "a", 100) for i in range(40)] + [(100 + i, "a", 7) for i in range(60)] + [(200 + i, "b", 50) for i in range(30)] + [(300, "b", 50), (300, "b", 50)]
    s = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    for total in (777, 1500, 2003):
        m = mixture.mix(s, t, total=total)
        got = {r["source"]: r["n"] for r in m.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
        assert 0 <= round(total / 2) - got["a"] < 7 and 0 <= round(total / 2) - got["b"] < 50
        assert m.agg(F.max("repeats")).first()[0] == 1 and m.count() == m.join(s.distinct(), ["doc_id", "source", "n_tokens"]).count()
    why = {r["source"]: r["reason"] for r in mixture.shares(s, mixture.mix(s, t, total=40), t, mixture.budgets(s, t, 40)[0]).collect()}
    assert why["b"] == "record sizes"


def test_mix_of_nothing(spark):
    s = sized(spark, {"a": 3})
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixture.mix(s, t.limit(0)).count() == 0
    assert mixture.mix(s.limit(0), t).count() == 0


def test_token_estimates(spark, tiny):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id = 1").withColumn("text", F.lit("")))
    assert {"*", "csharp"} <= {r["language"] for r in budget.holdout_errors(docs, per_language=60).filter("abs(ratio - 1) < 0.5").collect()}
    est = budget.estimate_tokens(docs, per_language=150)
    real = tokenize.count_tokens(docs.select("doc_id", "text", F.length("text").alias("len")))
    assert est.count() == docs.count()
    e, r = est.agg(F.sum("est_tokens")).first()[0], real.agg(F.sum("n_tokens")).first()[0]
    assert abs(e / r - 1) < 0.03
    assert est.filter("est_tokens = 0").count() == docs.filter("coalesce(text, '') = ''").count()


def test_token_estimates_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "s", "a.ts"), (2, "", "x", None, "b"), (3, "tok " * 50_000, "C#", "s", "c"), (3, "tok", "C#", "s", "c"), (4, "x", None, "s", None)], "doc_id long, text string, lang string, source string, path string")
    got = {(r["doc_id"], r["language"]): r["est_tokens"] for r in budget.estimate_tokens(docs).collect()}
    assert got[1, "typescript"] == got[2, "none"] == 0 and got[4, "none"] >= 1
    assert budget.estimate_tokens(docs.limit(0)).count() == 0
    files = spark.createDataFrame([(1, "./a.ts", None, "source", 9, None), (2, "a.ts ", "TypeScript", None, -4, None)], "snapshot_id int, path string, language string, kind string, token_count int, indexed_at timestamp_ntz")
    repos = spark.createDataFrame([("s", "d")], "repo string, domain string")
    t = budget.document_tokens(docs, files, repos)
    one = t.filter("doc_id = 1").first()
    assert (one["language"], one["kind"], one["domain"], one["stored_trusted"]) == ("typescript", "unknown", "d", False)
    b = budget.token_budget(t)
    assert b.filter("source = '*' AND language = '*' AND domain = '*' AND kind = '*'").first()["documents"] == 5


def test_features_match_a_plain_count():
    import pyarrow as pa

    texts = ["aB1 x_é\n", None, "", "日本 1234"]
    m = budget.text_features(pa.array(texts))
    first = dict(zip(budget.FEATURES, m[0]))
    assert (first["n_bytes"], first["letters"], first["humps"], first["digits"], first["lines"], first["two_byte"]) == (9, 3, 1, 1, 1, 1)
    assert not m[1].any() and not m[2].any() and dict(zip(budget.FEATURES, m[3]))["three_byte"] == 2
    sliced = budget.text_features(pa.array(texts)[3:])
    assert (sliced[0] == m[3]).all()
