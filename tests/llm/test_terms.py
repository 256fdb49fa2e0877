import random
from collections import Counter

from fathom.llm import terms

SCHEMA = "chunk_id long, heading string, content string, term string, records long"


def brute(rows):
    one = {}
    for r in rows:
        key = ((r[2] is not None, r[2] or ""), (r[1] is not None, r[1] or ""))
        if r[0] not in one or key > one[r[0]][0]:
            one[r[0]] = key, terms.terms(r[1], r[2])
    tf = {(i, t): n for i, (_, seq) in one.items() for t, n in Counter(seq).items()}
    df = Counter(t for _, t in tf)
    return one, tf, df


def test_terms():
    assert terms.terms("loginUser", "HTTPServer parseJSONFile x_retry1again über") == ["login", "httpserver", "parse", "jsonfile", "retry", "again"]
    assert terms.terms(None, None) == terms.terms("", "1 ab cd") == []


def test_degree():
    seq = "alpha bravo charl alpha delta".split()
    assert terms.degrees_of(seq) == {t: terms.degree(seq, t) for t in seq}
    assert terms.degree(seq, "alpha") == 3 and terms.degree(["alpha", "alpha"], "alpha") == 0


def test_rare_terms_by_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(6)]
    rows = []
    for i in range(400):
        body = " ".join(rnd.choice(vocab[: 3 if i % 3 == 0 else 156]) for _ in range(rnd.randint(0, 25)))
        rows.append((i, rnd.choice([None, "", "wordaa wordab"]), rnd.choice([None, body, body, body]), "x", 1))
    rows += [(r[0], r[1], r[2], "y", 2) for r in rows[:50]] + [(3, None, "other other other thing", "z", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, tf, freq = brute(rows)
    want = {(i, t) for (i, t), n in tf.items() if n >= 3 and 2 <= freq[t] <= 6}
    for d in (df, df.repartition(9)):
        got = terms.rare_terms(d, 3, 2, 6).collect()
        assert len(got) == len(want) and {(r["chunk_id"], r["term"]) for r in got} == want
        assert all(r["tf"] == tf[r["chunk_id"], r["term"]] and r["records"] == freq[r["term"]] for r in got)
    scored = terms.score_terms(df).collect()
    assert {(r["chunk_id"], r["term"]): r["records"] for r in scored} == {k: freq[k[1]] for k in tf}
    assert len(scored) == len(tf) and all(r["score"] >= 0 for r in scored)
    top = terms.score_terms(df, top=2)
    assert top.groupBy("chunk_id").count().filter("count > 2").count() == 0


def test_rare_beats_common(spark):
    rows = [(i, None, "common words everywhere " * 3 + ("zebra zebra zebra" if i in (4, 5) else ""), "", 0) for i in range(60)]
    top = {r["chunk_id"]: r["term"] for r in terms.score_terms(spark.createDataFrame(rows, SCHEMA), top=1).collect()}
    assert top[4] == top[5] == "zebra"


def test_nothing(spark):
    df = spark.createDataFrame([(1, None, None, "", 0), (None, "a", "b", "", 0)], SCHEMA)
    assert terms.rare_terms(df, 1, 1, 9).count() == 0
    assert terms.rare_terms(df.limit(0), 1, 1, 9).count() == terms.score_terms(df.limit(0)).count() == 0


def test_found_rows_are_rows_of_the_operator(spark, tiny, monkeypatch):
    from fathom.llm import queries

    whole, rare = terms.score_terms, terms.rare_terms
    want = {(r["chunk_id"], r["term"]) for r in rare(queries.table(spark, tiny, "chunks"), 3, 2, 6).collect()}
    assert want and {tuple(r) for r in queries.p2_found(spark, tiny).collect()} == want
    # without the operator's rows of a term there is no case of it
    gone = min(t for _, t in want)
    monkeypatch.setattr(terms, "score_terms", lambda *a, **k: whole(*a, **k).filter(f"term <> '{gone}'"))
    assert {tuple(r) for r in queries.p2_found(spark, tiny).collect()} == {x for x in want if x[1] != gone}


def test_scores_of_every_term(spark, tiny):
    from fathom.llm import queries

    rows = [(r["chunk_id"], r["heading"], r["content"]) for r in queries.table(spark, tiny, "chunks").select("chunk_id", "heading", "content").collect()]
    _, tf, freq = brute(rows)
    got = queries.QUERIES["p2_scores"](spark, tiny).collect()
    assert len(got) == len(tf) and {(r["chunk_id"], r["term"]): (r["tf"], r["records"]) for r in got} == {k: (n, freq[k[1]]) for k, n in tf.items()}
