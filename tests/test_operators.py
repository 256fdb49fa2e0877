import json
import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import changes, chunking, context, graph, memory, packing, search, snapshots, usage


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(d, *cols):
    return sorted((tuple(r[c] for c in cols) for c_ in [0] for r in d.collect()), key=repr)


FILES = "snapshot_id int, repo string, path string, content_hash string, indexed_at timestamp_ntz, extra string"
SNAPS = "snapshot_id int, repo string"


def test_snapshot_changes(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in range(1, 9)]
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    f = df(spark, [
        (1, "r", "p", a, t[0], ""), (1, "r", "q", a, t[0], ""), (1, "r", "n", None, t[0], ""),
        (2, "r", "p", a, t[1], ""), (2, "r", " ./p ", "sha256:" + b.upper(), t[2], ""), (2, "r", "p", b, t[2], ""), (2, "r", "n", a, t[1], ""), (2, "r", None, a, t[1], ""),
        (3, "r", "q", c, t[3], "not listed"),
        (4, "r", "p", b, t[4], ""), (4, "r", "new\\file", a, t[4], ""), (4, "s", "x", a, t[4], ""),
    ], FILES)
    s = df(spark, [(1, "r"), (2, "r"), (4, "r"), (4, "r"), (4, "s"), (None, "r")], SNAPS)
    got = rows(snapshots.snapshot_changes(f, s), "snapshot_id", "path", "change_kind")
    assert got == [(2, "p", "changed"), (2, "q", "removed"), (4, "n", "removed"), (4, "new/file", "added")]
    assert snapshots.snapshot_changes(f.limit(0), s).count() == 0
    assert snapshots.snapshot_changes(f, s.limit(0)).count() == 0


def test_snapshot_changes_by_brute_force(spark):
    import datetime as dt
    import random

    rnd = random.Random(7)
    data, state = [], {}
    for sid in range(1, 6):
        for p in range(300):
            if rnd.random() < 0.7:
                h = rnd.choice("abc") * 64
                for k in range(rnd.choice([1, 1, 2])):
                    data.append((sid, "r", f"p{p}", rnd.choice("abc") * 64 if k == 0 else h, dt.datetime(2025, sid, 1 + k), ""))
                    state[sid, f"p{p}"] = data[-1][3]
    got = set(rows(snapshots.snapshot_changes(df(spark, data, FILES), df(spark, [(i, "r") for i in (1, 2, 4, 5)], SNAPS)), "snapshot_id", "path", "change_kind"))
    want = set()
    for old, new in ((1, 2), (2, 4), (4, 5)):
        for p in {p for _, p in state}:
            x, y = state.get((old, p)), state.get((new, p))
            if x != y:
                want.add((new, p, "added" if x is None else "removed" if y is None else "changed"))
    assert got == want


def test_chunks(spark):
    t = df(spark, [("a.ts", "\n".join(map(str, range(150)))), ("b.ts", "1\n2\n3"), ("c.ts", ""), ("d.ts", None), ("e.md", "intro\n# T\nx\n## A\n"), ("f.md", "# only")], "path string, text string")
    assert rows(chunking.chunk(t), "path", "kind", "start_line", "end_line") == sorted([
        ("a.ts", "preamble", 1, 20), ("a.ts", "block", 21, 80), ("a.ts", "block", 81, 140), ("a.ts", "block", 141, 150), ("b.ts", "preamble", 1, 3),
        ("e.md", "preamble", 1, 1), ("e.md", "markdownheading", 2, 3), ("e.md", "markdownheading", 4, 4), ("f.md", "markdownheading", 1, 1)], key=repr)


def test_pack_skips_but_goes_on(spark):
    items = df(spark, [("a", 50, 1), ("b", 60, 2), ("c", 40, 3), ("d", 10, 4), ("e", 0, 5)], "path string, cost long, pos int")
    p = packing.pack(items, 100, 3)
    assert rows(p.filter("chosen"), "path") == [("a",), ("c",), ("d",)]
    assert {r["outcome"]: r["items"] for r in packing.omissions(p).collect()} == {"selected": 3, "budget_tokens": 1, "top": 1}
    assert packing.pack(items.limit(0), 100, 3).count() == 0


def greedy(items, budget, top):
    used, chosen, out = 0, [], {}
    for path, cost, pos in sorted(items, key=lambda x: x[2]):
        full = len(chosen) >= top
        if not full and used + cost <= budget:
            used += cost
            chosen.append(path)
        how = "selected" if path in chosen[-1:] else "top" if full else "budget_tokens"
        n, t = out.get(how, (0, 0))
        out[how] = n + 1, t + cost
    return chosen, out


@pytest.mark.parametrize("budget, top, high", [(3000, 8, 900), (100, 30, 60), (90, 4, 200), (50, 0, 9), (0, 3, 2)])
def test_pack_any_number_of_items(spark, budget, top, high):
    import random

    rnd = random.Random(budget)
    items = [(f"p{i}", rnd.randint(0, high), i) for i in range(1, 20_051)]
    chosen, want = greedy(items, budget, top)
    d = df(spark, items, "path string, cost long, pos int").repartition(5)
    p = packing.pack(d, budget, top)
    assert {r["outcome"]: (r["items"], r["tokens"]) for r in packing.omissions(p).collect()} == want
    assert [r["path"] for r in packing.taken(d, budget, top).orderBy("pos").collect()] == chosen


def test_packer_and_its_limits():
    price = lambda v: v | {"estimated_tokens": v["cost"] if not v.get("spans") else sum(len(u["text"]) for u in v["spans"]), "projected_read_tokens": v.get("read", 0)}
    measure = lambda items: len(packing.render(items))

    def run(items, top, *limits):
        p = packing.Packer(packing.Budgets(*limits), top, measure, price)
        for x in items:
            p.offer(x)
        return [c["path"] for c in p.chosen], {k: v for k, v in p.omitted.items() if v}

    items = [{"path": "a", "cost": 60}, {"path": "b", "cost": 50, "read": 5}, {"path": "c", "cost": 30, "read": 9}, {"path": "d", "cost": 10, "read": 1}, {"path": "e", "cost": 0}]
    assert run(items, 9) == (["a", "b", "c", "d", "e"], {})
    assert run(items, 2) == (["a", "b"], {"top": 3})
    assert run(items, 0) == ([], {"top": 5})
    assert run(items, 9, 100) == (["a", "c", "d", "e"], {"budget_tokens": 1})
    assert run(items, 3, 100) == (["a", "c", "d"], {"budget_tokens": 1, "top": 1})
    assert run(items, 9, None, 6) == (["a", "b", "d", "e"], {"projected_read_budget": 1})
    assert run(items, 9, 90, 5) == (["a", "d", "e"], {"budget_tokens": 1, "projected_read_budget": 1})
    got, out = run(items, 9, None, None, 160)
    assert got and out["response_budget"] == 5 - len(got)
    spans = [{"path": "s", "cost": 0, "spans": [{"text": "x" * 300}, {"text": "y" * 20}]}]
    p = packing.Packer(packing.Budgets(40), 5, measure, price)
    assert p.offer(spans[0]) and p.chosen[0]["spans"] == [{"text": "y" * 20}]
    p = packing.Packer(packing.Budgets(None, None, 10), 5, measure, price)
    assert not p.offer(spans[0]) and p.smallest["spans"] == [{"text": "y" * 20}]


def test_fitting_budget():
    assert packing.fitting_budget(lambda b: 500 + len(str(b)), 10) == 503
    assert packing.fitting_budget(lambda b: b + 1 if b < 3000 else 100, 1) >= 3000  # creeps, then doubles
    with pytest.raises(RuntimeError):
        packing.fitting_budget(lambda b: b + 1, 1)


def test_costs():
    """A word is a token here."""
    count = lambda t: len(t.split())
    base = {"path": "a b", "reasons": ["x y", "z"], "tokens": 77}
    assert packing.costs(base, count)["estimated_tokens"] == packing.costs(base, count)["projected_read_tokens"] == 77
    spans = packing.costs(base | {"spans": [{"text": "one two"}, {"text": "three"}]}, count, lambda n: 2 * n)
    assert (spans["estimated_tokens"], spans["projected_read_tokens"]) == (2 * (3 + 40 + 2 + 2), 0)
    lines = packing.costs(base | {"symbols": [{"signature": "f ( )", "doc": "Does it."}, {"signature": "g", "doc": None}]}, count)
    assert lines["estimated_tokens"] == 2 * 26 + 6 + 44
    assert packing.costs(base | {"duplicate_of": "c"}, count)["estimated_tokens"] == 0
    assert packing.memory_cost("a b c", ["r"], ["p q"], count) == 3 + 24 + 1 + 2 + 8
    notes = [{"id": i, "text": "w " * n, "reasons": [], "files": None} for i, n in enumerate((60, 6, 10, 1, 1))]
    assert [m["id"] for m in packing.reserve_memories(notes, 450, count)] == [0] and [m["id"] for m in packing.reserve_memories(notes, 325, count)] == [1, 2]
    assert [m["id"] for m in packing.reserve_memories(notes, None, count)] == [0, 1, 2]


def test_merges():
    assert packing.merge_seen(["x" * 43, "bad"], ["x" * 43]) == ["x" * 43]
    assert packing.merge_known({"a": "1"}, {"a": "2"}) == {"a": "2"}


def test_spans(spark):
    r = df(spark, [("p", 1, 10, 20), ("p", 2, 15, 30), ("p", 3, 100, 300), ("p", 4, 40, 41), ("p", 5, 50, 51)], "path string, rank int, start_line int, end_line int")
    assert rows(context.select_spans(r), "start_line", "end_line") == [(10, 20), (100, 179), (40, 41)]


def test_memory_fold(spark):
    log = df(spark, [
        (1, "r", "a", "note", "one", None), (2, "r", "a", "note", "two", None), (3, "r", "b", "note", "x", None), (4, "r", "b", None, None, True), (5, "r", "b", "note", "again", None),
        (6, "r", "c", "odd", "x", None), (7, "r", "d", "note", "  ", None), (2, "r", "a", "note", "two", None), (8, "r", "e", "note", "x", None), (9, "r", "e", None, None, True),
    ], "line_no long, repo string, id string, kind string, text string, deleted boolean")
    assert rows(memory.fold(log), "id", "text", "first_line") == [("a", "two", 1), ("b", "again", 5)]
    assert memory.fold(log.limit(0)).count() == 0


def test_memory_match_and_staleness(spark):
    e = df(spark, [("r", "1", "note", "login session", ["db"], {"src/auth/login.ts": "aaaaaaaaaaaa"}, None, "2025-01-01"), ("r", "2", "note", "other", None, None, None, "2025-01-02"), ("r", "3", "note", "login", None, {"gone": "x"}, "s1", "2025-01-03")], "repo string, id string, kind string, text string, tags array<string>, files map<string,string>, session string, created string")
    f = df(spark, [("r", "src/auth/login.ts", "a" * 64)], "repo string, path string, content_hash string")
    assert rows(memory.match(e, ["login", "session"]), "id", "score") == [("1", 1.0), ("2", 0.0), ("3", 0.5)]
    assert rows(memory.match(e, ["db"]), "id", "score") == [("1", 1.0), ("2", 0.0), ("3", 0.0)]
    assert rows(memory.match(e, ["auth"]), "id", "score")[0] == ("1", 0.5)
    assert rows(memory.staleness(e, f), "id", "stale") == [("1", False), ("2", False), ("3", True)]
    assert [r["id"] for r in memory.search(e, f).collect()] == ["2", "1"]
    assert [r["id"] for r in memory.search(e, f, session="s1").collect()] == ["3", "2", "1"]


def test_expand(spark):
    edges = df(spark, [("b", "a", "import"), ("c", "b", "import"), ("d", "c", "import"), ("a", "a", "import")], "src string, dst string, kind string")
    files = df(spark, [("a",), ("b",), ("c",), ("d",)], "path string")
    steps = graph.expand(df(spark, [("a", 1.0)], "path string, strength double"), graph.dedupe(edges), files)
    assert rows(steps, "path", "reason", "hop", "gain") == [("a", "imported-by:b", 2, 0.25), ("b", "imports:a", 1, 0.5), ("c", "imports:b", 2, 0.25)]


def test_edges_from_sources(spark):
    src = df(spark, [
        ("s/a.ts", 'import { x } from "./b";\nexport * from "../t/c.js";\nimport "pkg";\nconst s = "./no";'), ("s/b.ts", ""), ("t/c.js", None), ("t/a.test.ts", "import type { X } from\n  '../s/a'"),
        ("c/Foo.cs", "class Foo { Bar b; }"), ("c/Bar.cs", "class Bar {}"), ("c/FooTests.cs", "class FooTests { Foo f; }")], "path string, text string")
    files = src.select("path", F.when(F.col("path").rlike("est"), "test").otherwise("source").alias("kind"))
    assert rows(graph.script_edges(src, files), "src", "dst") == [("s/a.ts", "s/b.ts"), ("s/a.ts", "t/c.js"), ("t/a.test.ts", "s/a.ts")]
    types = df(spark, [("c/Foo.cs", "Foo"), ("c/Bar.cs", "Bar"), ("z/Bar.cs", "Bar"), ("c/FooTests.cs", "FooTests")], "path string, name string")
    cs = graph.csharp_edges(src, types)
    assert rows(cs, "src", "dst") == [("c/Foo.cs", "c/Bar.cs"), ("c/FooTests.cs", "c/Foo.cs")]
    assert ("c/FooTests.cs", "c/Foo.cs") in rows(graph.test_edges(files, cs), "src", "dst")


def test_changes(spark):
    s = "path string, content_hash string"
    d = changes.diff(df(spark, [("a", "1"), ("b", "1"), ("c", "1"), ("n", None)], s), df(spark, [("a", "2"), ("b", "1"), ("d", "1"), ("n", None)], s))
    assert rows(d, "path", "status") == [("a", "modified"), ("b", "unchanged"), ("c", "deleted"), ("d", "added"), ("n", "unchanged")]
    e = df(spark, [("b", "a", "import"), ("n", "c", "test"), ("d", "a", "import")], "src string, dst string, kind string")
    assert rows(changes.impacted(d, e), "path", "reasons") == [("b", ["imports:a"]), ("n", ["test-of:c"])]


def test_usage(spark):
    import datetime as dt

    r = [(i, 1, dt.datetime(2025, 1, 1 + i), "search", "cli", 100, 300, None) for i in range(20)] + [(0, 1, dt.datetime(2025, 1, 1), "search", "cli", 100, 300, None), (99, None, dt.datetime(2025, 1, 1), "x", "cli", 1, 1, None), (98, 1, dt.datetime(2025, 1, 1), "x", "cli", -1, 1, None)]
    u = usage.valid(df(spark, r, "usage_id long, v int, ts timestamp_ntz, command string, source string, served int, replaced int, files int"))
    assert usage.totals(u).first()["saved"] == 4000 and usage.by_day(u).count() == 14
    assert usage.by_day(u).first()["day"] == "2025-01-07"


def test_search_without_terms_or_rows(spark):
    c = df(spark, [(1, "p", "block", 1, 2, None, "some text here"), (2, "p", "block", 3, 4, None, None)], "chunk_id long, path string, kind string, start_line int, end_line int, heading string, content string")
    assert search.search(c, []).count() == 0
    assert search.search(c.limit(0), ["text"]).count() == 0
    assert [r["start_line"] for r in search.search(c, ["text"]).collect()] == [1]
    assert search.analyze("Please find the login", {"login": ["sign in"]}) == ["find", "login", "sign", "in"]


def test_stream(spark, tmp_path):
    from fathom.streaming import usage_stream

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        for i, day in enumerate(["01", "01", "02", "28"]):
            f.write(json.dumps({"v": 1, "ts": f"2025-03-{day}T10:00:00Z", "command": "search", "source": "cli", "served": 1, "replaced": 3, "usage_id": i}) + "\n")
        f.write(json.dumps({"v": 1, "ts": "2025-03-01T10:00:00Z", "command": "search", "source": "cli", "served": 1, "replaced": 3, "usage_id": 0}) + "\nnot json\n")
    usage_stream.start(usage_stream.daily(usage_stream.records(spark, src)), out, ck).awaitTermination()
    got = {(r["day"], r["calls"]) for r in spark.read.parquet(out).collect()}
    assert got == {("2025-03-01", 2), ("2025-03-02", 1)}


@pytest.fixture
def repo(tmp_path):
    def put(path, text):
        p = tmp_path / "repo" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("src/auth/login.ts", 'import { createSession } from "./session";\n/** Logs a user in. */\nexport function loginUser(name: string) {\n  return createSession(name);\n}\n')
    put("src/auth/session.ts", "export interface Session { id: string }\n/** Creates a session. */\nexport function createSession(user: string): Session {\n  return { id: user };\n}\n")
    put("src/auth/login.test.ts", 'import { loginUser } from "./login";\nloginUser("x");\n')
    put("docs/auth.md", "# Login\nHow a session is made.\n## Tokens\nNone.\n")
    put(".env.local", "SECRET=1\n")
    put("node_modules/x/index.js", "x")
    put("src/app.ts", 'import { loginUser } from "./auth/login";\nloginUser("a");\n')
    return tmp_path / "repo"


def test_commands(spark, repo, tmp_path):
    from fathom.api import Repository

    r = Repository(spark, str(repo), str(tmp_path / "home"))
    r.init()
    with pytest.raises(FileExistsError):
        r.init()
    first = r.index()
    assert first["added"] == 5 and first["files_count"] == 5
    paths = {x["path"] for x in r.tables.files.collect()}
    assert not any(".env" in p or "node_modules" in p for p in paths)
    assert r.search("login").first()["path"].endswith(("login.ts", "auth.md"))
    assert ("imported_by", "src/app.ts") in [(x["relation"], x["neighbor"]) for x in r.related("src/auth/login.ts").collect()]
    assert [x["name"] for x in r.outline("src/auth/session.ts").collect()] == ["Session", "createSession"]
    got = r.context("fix the login session", top=2, session="s1")
    assert len(got["results"]) == 2 and all(x["reasons"] for x in got["results"])
    again = r.context("fix the login session", top=2, session="s1")
    assert {x["path"] for x in again["reused"]} >= {x["path"] for x in got["results"]}
    small = r.context("login", budget=30)
    assert small["retry_budget_tokens"] > 30 and not small["results"]
    enough = r.context("login", budget=small["retry_budget_tokens"] + 200)
    assert enough["results"] and r.counter.count(packing.dumps(enough)) <= small["retry_budget_tokens"] + 200
    tight = r.context("login session", budget_tokens=1)
    assert not tight["results"] and tight["omitted"]["budget_tokens"] and tight["projected_read_tokens"] == 0
    assert r.context("login session", projected_read_budget=0)["omitted"]["projected_read_budget"]
    assert r.context("login session", top=1)["omitted"]["top"] and len(r.context("login")["evidence_id"]) == 64
    assert small["results"] == [] and small["retry_budget_tokens"] > 30
    cut = r.context("login session", detail="slices", budget=1500, session="s2")
    assert cut["results"] and any(x.get("spans") for x in cut["results"])
    more = r.context("login session", detail="slices", budget=1500, session="s2")
    assert {u["receipt"] for u in more["reused"]} & {s["receipt"] for x in cut["results"] for s in x.get("spans") or []}
    lines = r.context("login session", detail="outline")
    assert any(s["signature"] for x in lines["results"] for s in x.get("symbols") or [])
    assert r.context("the")["results"] == []
    mid = r.remember("login uses sessions", "decision", ["src/auth/login.ts"], ["auth"])
    assert [x["id"] for x in r.recall("login").collect()] == [mid]
    (repo / "src/auth/login.ts").write_text("export function loginUser() { return 1; }\n")
    delta, hit = r.changed()
    assert [(x["path"], x["status"]) for x in delta.collect()] == [("src/auth/login.ts", "modified")]
    assert {x["path"] for x in hit.collect()} == {"src/app.ts", "src/auth/login.test.ts"}
    assert r.patch().count() == 1
    second = r.index()
    assert second["modified"] == 1 and second["unchanged"] == 4
    assert [x["stale"] for x in r.recall("login").collect()] == [True]
    r.forget(mid)
    assert r.recall("login").count() == 0
    a = r.architecture()
    assert "src/app.ts" in a["entrypoints"] and a["tree"][0]["files"] == 5
    assert r.prime() == r.prime()
    r.record("search", 100, 400)
    assert r.stats()["totals"]["saved"] == 300
    assert json.loads(r.render("search", r.search("login")))["results"]
    assert r.render("search", r.search("login"), "md").startswith("# search")
    r.cfg.max_file_kb = 1
    with pytest.raises(ValueError):
        r.tables


def test_architecture_lists_all_entrypoints(spark):
    from types import SimpleNamespace

    from fathom.api import Repository

    class Given(Repository):
        def __init__(self):
            pass

        tables = SimpleNamespace(
            files=df(spark, [(f"p{i:04}/main.ts", "typescript", "source", 1, "h") for i in range(1005)], "path string, language string, kind string, line_count int, content_hash string"),
            edges=df(spark, [], "src string, dst string, kind string"),
        )

    assert Given().architecture()["entrypoints"] == [f"p{i:04}/main.ts" for i in range(1005)]


def test_evaluation(spark):
    from fathom.operators import evaluation

    ranked = df(spark, [("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query string, path string, rank int")
    labels = df(spark, [("q", "a", 0, False), ("q", "b", 1, False), ("q", "x", 0, True)], "query string, path string, place int, forbidden boolean")
    m = evaluation.metrics(ranked, labels).first()
    assert (m["recall_1"], m["recall_3"], m["leaked"]) == (0.5, 1.0, True) and 0.9 < m["ndcg_8"] < 1.0
    spans = df(spark, [("q", "a", 1, 10), ("q", "a", 5, 12)], "query string, path string, start int, end int")
    assert evaluation.line_density(spans, df(spark, [("q", "a", 10, 30)], "query string, path string, start int, end int")).first()["density"] == 3 / 12


def test_log_compaction(spark, tmp_path, monkeypatch):
    from fathom.sources import logs

    folder = str(tmp_path / "log")
    for i in range(6):
        logs.append(folder, [{"id": "a", "kind": "note", "text": f"t{i}", "line_no": i, "repo": ""}])
    live = lambda: memory.fold(logs.read(spark, folder, logs.MEMORY_SCHEMA))
    assert not logs.compact(spark, live().drop("first_line"), folder)
    monkeypatch.setattr(logs, "SLACK", 3)
    assert logs.compact(spark, live().drop("first_line"), folder)
    assert len(logs.read(spark, folder, logs.MEMORY_SCHEMA).collect()) == 1 and live().first()["text"] == "t5"


def test_command_line_and_server(spark, repo, tmp_path, capsys):
    import io

    from fathom import cli
    from fathom.api import Repository

    where = ["--root", str(repo), "--home", str(tmp_path / "h")]
    assert cli.main([*where, "search", "login"], spark) == 3
    assert cli.main([*where, "index"], spark) == 0
    assert cli.main([*where, "search", "login"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["kind"] == "search"
    assert cli.main([*where, "search", "nothinglikethis"], spark) == 1
    assert cli.main([*where, "memory", "add", " "], spark) == 2
    out = io.StringIO()
    asks = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "login"}}}, {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "x"}]
    cli.serve(Repository(spark, str(repo), str(tmp_path / "h")), [json.dumps(a) for a in asks] + ["", "not json"], out)
    got = [json.loads(x) for x in out.getvalue().strip().split("\n")]
    assert len(got[1]["result"]["tools"]) == 7 and not got[2]["result"]["isError"] and got[3]["result"]["isError"] and got[4]["error"]


def test_nearest_types_by_brute_force(spark):
    import random

    rnd = random.Random(5)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f"]
    paths = [f"{f}/F{i}.cs".lstrip("/") for i, f in enumerate(rnd.choices(folders, k=40))]
    types = [(p, rnd.choice(["Tx", "Ty", "Tz"])) for p in paths[:20]]
    src = [(p, "uses Tx Ty and Tz") for p in paths]
    got = {(r["src"], r["dst"]) for r in graph.csharp_edges(df(spark, src, "path string, text string"), df(spark, types, "path string, name string")).collect()}

    def far(a, b):
        x, y = a.split("/")[:-1], b.split("/")[:-1]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return len(x) + len(y) - 2 * n

    want = set()
    for p, _ in src:
        for name in ("Tx", "Ty", "Tz"):
            at = [q for q, n in types if n == name]
            if p not in at and at:
                want.add((p, min(at, key=lambda q: (far(p, q), q))))
    assert got == want


def test_content_state(spark):
    from fathom.operators import identity

    f = df(spark, [("r", f"p{i}", f"{i:064x}") for i in range(500)] + [("s", "p1", "a" * 64)], "repo string, path string, content_hash string")
    a = {r["repo"]: r["state"] for r in identity.content_state(f).collect()}
    assert a == {r["repo"]: r["state"] for r in identity.content_state(f.repartition(7)).collect()}
    b = {r["repo"]: r["state"] for r in identity.content_state(f.filter("path <> 'p7'")).collect()}
    assert a["s"] == b["s"] and a["r"] != b["r"]
    assert identity.flat_content_state([("b", "2"), ("a", "1")]) == identity.flat_content_state([("a", "1"), ("b", "2")])


def test_discovery(tmp_path):
    from fathom import api

    (tmp_path / "r/.index").mkdir(parents=True)
    (tmp_path / "r/.index/config.json").write_text("{}")
    (tmp_path / "r/a/b").mkdir(parents=True)
    root = str(tmp_path / "r")
    assert api.discover(str(tmp_path / "r/a/b")) == root and api.discover(str(tmp_path)) is None
    assert api.to_relative(root, "../x.ts", str(tmp_path / "r/a/b")) == "a/x.ts"
    assert api.to_relative(root, "../../../x", str(tmp_path / "r/a/b")) is None
    assert [api.valid_session(n) for n in ("a-1", "..", "", "a/b", "x" * 65)] == [True, False, False, False, False]


def test_receipts():
    """Receipts of known units under this form."""
    from fathom.operators import identity as i

    login = "4cc4440f076b0550de341a7c9831513a1b332b61787381d40de7b954961a91ef"
    session = "073c7177b93912ba82b2ca2c374e453342621f0037b9a761c23659667a3ba303"
    assert i.unit_receipt("src/auth/login.ts", login, "paths", "pointer") == "Db-cluQLInxMNskR0CdKcFi_UrhbEF00ei9mF999d3w"
    assert i.unit_receipt("src\\auth\\session.ts", session, "paths", "pointer") == "GNoqHyipiM7JDtmH2YaJxEfsS5vdPPufKDifJ_cN6oE"
    shown = i.join_records(["function createSession(userId: string, ttlSeconds: number): Session", "Creates a session for a user with a fixed lifetime."])
    assert i.unit_receipt("src/auth/session.ts", session, "outline", "symbol", 9, 11, "createSession", shown) == "X8OnTHbsnWJtu2HiRj8EAyUWPZcQWTfq-qpsUPawZYM"
    text = "export function isSessionValid(session: Session, now: number): boolean {\n  return session.expiresAt > now;\n}"
    assert i.unit_receipt("src/auth/session.ts", session, "slices", "span", 16, 18, "isSessionValid", text) == "CrzXyjrMb4m4Y_l-AvHEhB6EfvJhfb5-Y9k6CKgDNt4"
    same = [i.representation_id("e", "json", "p", "utf-8", "cli", b) for b in ("x", "x", "y")]
    assert same[0] == same[1] != same[2]
    assert i.worktree_state("s", [("a", "x", "1"), ("d", "b", None)]) == i.worktree_state("s", [("d", "b", None), ("a", "x", "1")])
