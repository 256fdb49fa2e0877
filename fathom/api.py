"""The commands: one object for an indexed repository or an index over many.

Each method composes lazily evaluated operators; what reaches the driver is bounded by a top or a budget.
"""

from __future__ import annotations

import datetime
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import scalars as S
from .functions import textops
from .operators import architecture, changes, context, graph, identity, index, memory, packing, search, usage
from .session import cut_lineage
from .sources import files as scanning
from .sources import logs

MAX_ENTRIES, MAX_TEXT, MAX_LINKS, MAX_TAGS = 500, 2000, 8, 8


class Repository:
    """A source tree with its index folder; ``home`` must be shared by all executors."""

    def __init__(self, spark: SparkSession, root: str, home: str | None = None, cfg: scanning.Config | None = None, counter: textops.TokenCounter | None = None):
        self.spark, self.root, self.home = spark, root.rstrip("/"), home or os.path.join(root, ".index")
        self.cfg, self.counter = cfg or scanning.Config(), counter or textops.PatternTokens()
        self.cfg.exclude = [*self.cfg.exclude, os.path.basename(self.home.rstrip("/"))]

    # -- index

    def init(self, force: bool = False) -> str:
        """Write the configuration; an existing one is kept unless forced."""
        path = os.path.join(self.home, "config.json")
        if os.path.exists(path) and not force:
            raise FileExistsError(path)
        os.makedirs(self.home, exist_ok=True)
        with open(path, "w") as f:
            json.dump(vars(self.cfg), f, indent=2)
        inside = to_relative(self.root, self.home)
        if inside and os.path.isdir(self.root):  # the index itself is not for version control
            ignore, line = os.path.join(self.root, ".gitignore"), f"/{inside}/"
            old = open(ignore).read() if os.path.exists(ignore) else ""
            if line not in old.splitlines():
                with open(ignore, "a") as f:
                    f.write(("" if not old or old.endswith("\n") else "\n") + line + "\n")
        return path

    def scan(self) -> DataFrame:
        return scanning.scan(self.spark, self.root, self.cfg)

    def index(self, full: bool = False) -> dict:
        """Build the index, or bring it up to date; counts of what changed."""
        old = None
        if not full and index.current(self.home) is not None:
            try:
                index.ensure_usable(self.home, self.cfg)
                old = index.load(self.spark, self.home)
            except (ValueError, OSError):
                old = None
        tables, delta = index.build(self.scan(), old, self.counter)
        counts = {r["status"]: r["n"] for r in delta.groupBy("status").agg(F.count("*").alias("n")).collect()}
        index.write(tables, self.home, self.cfg)
        return counts | index.meta(self.home)

    @property
    def tables(self) -> index.Tables:
        index.ensure_usable(self.home, self.cfg)
        return index.load(self.spark, self.home)

    # -- queries

    def search(self, query: str, top: int = 10, symbols: bool = False) -> DataFrame:
        return search.search(self.tables.chunks, search.analyze(query, stop=False), top, symbols)

    def related(self, path: str) -> DataFrame:
        t = self.tables
        place = F.array_position(F.array(*map(F.lit, graph.RELATIONS)), F.col("relation"))
        return graph.related(t.edges, t.files).filter(F.col("path") == path).orderBy(place, "neighbor")

    def rank(self, query: str) -> DataFrame:
        t = self.tables
        return context.rank(t.chunks, t.files, t.edges, search.analyze(query, self.cfg.synonyms), self.cfg.weights)

    def context(
        self, query: str, top: int = 8, budget: int | None = None, detail: str = "paths", known: dict[str, str] | None = None, seen: list[str] = (), session: str | None = None, memories: bool = True,
        budget_tokens: int | None = None, projected_read_budget: int | None = None, strip_comments: bool = False,
    ) -> dict:
        """A bundle of ranked files with evidence and reasons.

        ``budget`` limits the tokens of the response as it is returned, ``budget_tokens`` the estimates of its
        items, ``projected_read_budget`` what will be read after it. ``omitted`` counts what is left out by
        the limit that kept it out. Candidates come to the driver a page at a time, until ``top`` are taken.
        """
        t, terms = self.tables, search.analyze(query, self.cfg.synonyms)
        state = self.load_session(session)
        known, seen = packing.merge_known(state["known"], known or {}), packing.merge_seen(state["seen"], seen)
        if not terms:
            return {"results": [], "reused": [], "memories": [], "omitted": {}}
        signals, text, syms = context.candidates(t.chunks, t.files, terms)
        scored = context.diversify(context.score(signals, graph.expand(context.seeds(signals), t.edges, t.files), self.cfg.weights))
        ranked = cut_lineage(scored.select("path", "adjusted", "reasons").join(t.files.select("path", "content_hash", "token_count"), "path"))
        counts = ranked.agg(F.count("*").alias("all"), F.coalesce(F.sum((F.col("adjusted") > 0).cast("long")), F.lit(0)).alias("good")).first()
        scale = lambda n: textops_scale(n, self.cfg.token_factor)
        count, price = self.counter.count, lambda item: packing.costs(item, self.counter.count, scale, textops.json_escaped)
        notes = packing.reserve_memories([x.asDict() for x in self._bundle_memories(ranked, terms)] if memories else [], budget_tokens, count, scale)
        reused: list[dict] = []

        def document(items: list[dict], kept: list[dict], omitted: dict, **more) -> dict:
            first = sorted(reused, key=lambda u: (u["path"], u.get("start_line") or 0, u.get("receipt") or ""))[:20]
            body = {"query": query, "analysis_id": self._analysis_id, "results": items, "reused": first, "memories": kept, "omitted": omitted, "estimated_tokens": sum(x["estimated_tokens"] for x in (*items, *kept)), "projected_read_tokens": sum(x["projected_read_tokens"] for x in items)}
            body["evidence_id"] = identity.evidence_id(self._analysis_id, " ".join(terms), f"{detail}:{top}", [x["receipt"] for x in items])
            return body | {k: v for k, v in more.items() if v is not None}

        tokens = lambda doc: scale(count(packing.dumps(doc)))
        most = {k: counts["all"] for k in ("top", "budget_tokens", "projected_read_budget", "response_budget", "nonpositive")}  # no number in it will be longer
        kept: list[dict] = []
        for m in notes:
            if budget is None or tokens(document([], [*kept, m], most)) <= budget:
                kept.append(m)
        while True:
            reused.clear()
            left = None if budget_tokens is None else max(budget_tokens - sum(m["estimated_tokens"] for m in kept), 0)
            packer = packing.Packer(packing.Budgets(left, projected_read_budget, budget), top, lambda items: tokens(document(items, kept, most)), price)
            gone = self._offer(packer, ranked, t, text, syms, detail, known, seen, reused, strip_comments)
            if packer.chosen or not kept or not counts["good"]:
                break
            kept.pop()  # notes never stand in for all evidence
        omitted = packer.omitted | {"top": packer.omitted["top"] + max(counts["good"] - gone, 0) * packer.full, "nonpositive": counts["all"] - counts["good"]}
        chosen = packer.chosen
        out = document(chosen, kept, omitted)
        while budget is not None and tokens(out) > budget and (chosen or kept or reused):
            (reused if reused else chosen if len(chosen) > 1 or not kept else kept).pop()
            out = document(chosen, kept, omitted)
        if budget is not None and not chosen and packer.smallest:
            need = packing.fitting_budget(lambda b: tokens(document([packer.smallest], [], omitted, requested_budget_tokens=budget, retry_budget_tokens=b)), budget)
            out = document([], kept, omitted, requested_budget_tokens=budget, retry_budget_tokens=need)
        if session:
            # what the caller says it knows, and what was delivered or acknowledged; a file is never known by itself
            own = [u["receipt"] for x in chosen for u in (x.get("spans") or x.get("symbols") or [x])]
            self.save_session(session, known, [*seen, *own, *(u["receipt"] for u in reused if "receipt" in u)])
        return out

    @property
    def _analysis_id(self) -> str:
        m = index.meta(self.home)
        return identity.analysis_state(m["state_hash"], m["producer"], m["schema_version"], m["config_hash"])

    def _pages(self, ranked: DataFrame, size: int = 200):
        """Rows of the ranking in order, a bounded page at a time."""
        rows = ranked.filter("adjusted > 0")
        last = None
        while True:
            more = rows if last is None else rows.filter((F.col("adjusted") < last["adjusted"]) | (F.col("adjusted") == last["adjusted"]) & (F.col("path") > last["path"]))
            page = more.orderBy(F.desc("adjusted"), "path").limit(size).collect()
            if page:
                yield page
            if len(page) < size:
                return
            last = page[-1]

    def _offer(self, packer: packing.Packer, ranked: DataFrame, t: index.Tables, text: DataFrame, syms: DataFrame, detail: str, known: dict, seen: list[str], reused: list, strip: bool) -> int:
        """Offer the candidates to the packer until it is full; returns how many were looked at."""
        first: dict[str, str] = {}
        looked = 0
        for page in self._pages(ranked):
            if packer.full:
                break
            spans, outline = self._evidence(t, text, syms, [r["path"] for r in page], detail)
            for r in page:
                if packer.full:
                    break
                looked += 1
                item = self._item(r, spans, outline, detail, known, seen, reused, first, strip)
                if item is not None and packer.offer(item):
                    first.setdefault(r["content_hash"], r["path"])
        return looked

    def _item(self, r, spans: dict, outline: dict, detail: str, known: dict, seen: list[str], reused: list, first: dict, strip: bool) -> dict | None:
        """The item of a ranked file, None if all of it was delivered before."""
        h = r["content_hash"] or ""
        if any(p == r["path"] and len(k) >= 8 and h.lower().startswith(k.lower()) for p, k in known.items()):
            reused.append({"path": r["path"], "why": "known"})
            return None
        receipt = identity.unit_receipt(r["path"], h, detail, "pointer")
        if receipt in seen:
            reused.append({"path": r["path"], "receipt": receipt, "why": "seen"})
            return None
        item = {"path": r["path"], "score": round(r["adjusted"], 4), "reasons": r["reasons"], "tokens": textops_scale(r["token_count"], self.cfg.token_factor), "receipt": receipt}
        if h in first:
            own = identity.join_records(["duplicate_of", first[h]])
            return item | {"duplicate_of": first[h], "tokens": 0, "receipt": identity.unit_receipt(r["path"], h, detail, "pointer", evidence=own)}
        if detail == "paths":
            return item
        units, old = [], 0
        for u in (spans if detail == "slices" else outline).get(r["path"], []):
            u = dict(u)
            if detail == "slices":
                if strip:
                    u["text"] = textops.strip_comment_lines(u["text"])[0]
                u["receipt"] = identity.unit_receipt(r["path"], h, detail, "span", u["start_line"], u["end_line"], u.get("symbol") or "", u["text"])
            else:
                shown = identity.join_records([u["signature"] or "", u["doc"] or ""])
                u["receipt"] = identity.unit_receipt(r["path"], h, detail, "symbol", u["start_line"], u["end_line"], u["name"], shown)
            if u["receipt"] in seen:
                old += 1
                reused.append({"path": r["path"], "start_line": u["start_line"], "end_line": u["end_line"], "receipt": u["receipt"], "why": "seen"})
            else:
                units.append(u)
        if old and not units:
            return None
        return item | {"spans" if detail == "slices" else "symbols": units or None}

    def _evidence(self, t: index.Tables, text: DataFrame, syms: DataFrame, paths: list[str], detail: str) -> tuple[dict, dict]:
        """Spans or symbols of a page of files by path, each kind in one job."""
        spans: dict[str, list] = {}
        outline: dict[str, list] = {}
        if detail == "slices" and paths:
            s = context.drop_containers(syms.filter(F.col("path").isin(paths)).select("path", "start_line", "end_line", "score"))
            r = s.select("path", F.lit(0).alias("g"), -F.col("score"), "start_line", "end_line").toDF("path", "g", "s", "start_line", "end_line")
            r = r.unionByName(text.filter(F.col("path").isin(paths)).select("path", F.lit(1).alias("g"), (-F.col("score")).alias("s"), "start_line", "end_line"))
            ranges = r.select("path", F.struct("g", "s", "start_line").alias("rank"), "start_line", "end_line")
            names = syms.filter(F.col("path").isin(paths)).groupBy("path", "start_line", "end_line").agg(F.min("heading").alias("symbol"))
            cut = search.source_slices(t.chunks, context.select_spans(ranges)).join(names, ["path", "start_line", "end_line"], "left")
            for x in cut.orderBy("path", "start_line").collect():
                spans.setdefault(x["path"], []).append({k: x[k] for k in ("start_line", "end_line", "symbol", "text")})
        if detail == "outline" and paths:
            m = syms.filter(F.col("path").isin(paths)).select("path", F.col("heading").alias("name"))
            o = context.outline_symbols(t.symbols.filter(F.col("path").isin(paths)), m).orderBy("path", "start_line", "name")
            for x in o.select("path", "name", "kind", "start_line", "end_line", "signature", S.doc_summary(F.col("doc")).alias("doc")).collect():
                outline.setdefault(x["path"], []).append({k: v for k, v in x.asDict().items() if k != "path"})
        return spans, outline

    def outline(self, path: str) -> DataFrame:
        s = self.tables.symbols.filter(F.col("path") == path)
        return context.outline_symbols(s, None, None).orderBy("start_line", "name").select("name", "kind", "start_line", "end_line", "signature", S.doc_summary(F.col("doc")).alias("doc"))

    def changed(self) -> tuple[DataFrame, DataFrame]:
        """(paths with their status, impacted files) of the tree against the index."""
        t = self.tables
        delta = changes.diff(t.files, self.scan())
        return delta.filter("status <> 'unchanged'").orderBy("path"), changes.impacted(delta, t.edges).orderBy("path")

    def worktree_id(self, delta: DataFrame) -> str:
        """The state of the tree: that of the index and the local changes, of which there are few."""
        now = delta.join(self.scan().select("path", "content_hash"), "path", "left").select("status", "path", "content_hash").collect()
        return identity.worktree_state(index.meta(self.home)["state_hash"], [tuple(r) for r in now])

    def patch(self) -> DataFrame:
        """Hunks of modified files against the indexed lines."""
        t, now = self.tables, self.scan()
        mod = changes.diff(t.files, now).filter("status = 'modified'").select("path")
        old = t.chunks.filter("kind <> 'symbol'").join(mod, "path", "left_semi").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x["content"]), "\n").alias("old"))
        return textops.hunks(old.join(now.select("path", F.col("text").alias("new")), "path"))

    def architecture(self, depth: int = 3, top: int = 10) -> dict:
        t = self.tables
        return {
            "languages": [r.asDict() for r in architecture.languages(t.files).collect()],
            "tree": [r.asDict() for r in architecture.tree(t.files, depth).orderBy("dir").collect()],
            "central": [r.asDict() for r in graph.centrality(t.edges, top).collect()],
            "entrypoints": [r["path"] for r in architecture.entrypoints(t.files, t.edges).orderBy("path").collect()],
        }

    def prime(self, files: int = 5) -> dict:
        """A short primer that is the same byte for byte while the index is; its numbers have two digits, so small changes leave it alone."""
        t, m = self.tables, index.meta(self.home)
        a = self.architecture(depth=1)
        keys = architecture.key_files(t.files, t.edges, files).collect()
        paths = [r["path"] for r in keys]
        o = context.outline_symbols(t.symbols.filter(F.col("path").isin(paths))).orderBy("path", "start_line", "name").collect()
        size = {r["path"]: r["token_count"] for r in t.files.filter(F.col("path").isin(paths)).select("path", "token_count").collect()}
        total = t.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("loc"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).first()
        return {
            "state": m["state_hash"][:12], "files": round2(total["files"]), "loc": round2(total["loc"]), "read_tokens": round2(textops_scale(total["tokens"], self.cfg.token_factor)),
            "languages": sorted(({"language": x["language"], "loc": round2(x["loc"])} for x in a["languages"]), key=lambda x: x["language"]),
            "tree": sorted(({"dir": x["dir"], "files": round2(x["files"]), "loc": round2(x["loc"])} for x in a["tree"]), key=lambda x: x["dir"]),
            "entrypoints": a["entrypoints"],
            "key_files": [r.asDict() | {"read_tokens": round2(textops_scale(size.get(r["path"]), self.cfg.token_factor)), "symbols": [s["name"] for s in o if s["path"] == r["path"]]} for r in keys],
        }

    # -- memory

    @property
    def _memory_log(self) -> str:
        return os.path.join(self.home, "memory")

    def memories(self) -> DataFrame:
        if not os.path.isdir(self._memory_log):
            return self.spark.createDataFrame([], logs.MEMORY_SCHEMA.replace("deleted boolean, ", "")).withColumn("first_line", F.lit(0).cast("long"))
        log = logs.read(self.spark, self._memory_log, logs.MEMORY_SCHEMA)
        return memory.fold(log.withColumn("repo", F.coalesce("repo", F.lit(""))))

    def remember(self, text: str, kind: str = "note", files: list[str] = (), tags: list[str] = (), session: str | None = None, created: str | None = None) -> str:
        tags = [t.strip().lower() for t in tags]
        if kind not in memory.KINDS or not text.strip() or len(text) > MAX_TEXT or len(files) > MAX_LINKS or len(tags) > MAX_TAGS:
            raise ValueError("kind, text, files or tags are out of bounds")
        if any(not re.fullmatch(r"[a-z0-9_-]{1,32}", t) for t in tags) or session is not None and not valid_session(session):
            raise ValueError("a tag or the session has another form")
        if self.memories().count() >= MAX_ENTRIES:
            raise ValueError(f"there are {MAX_ENTRIES} entries already")
        linked = {r["path"]: r["content_hash"][:12] for r in self.tables.files.filter(F.col("path").isin(list(files))).select("path", "content_hash").collect()} if files else {}
        if len(linked) != len(set(files)):
            raise ValueError("a linked file is not in the index")
        import hashlib

        mid = hashlib.sha256("\x1f".join([kind, text, session or "", "\x1f".join(sorted(linked))]).encode()).hexdigest()[:8]
        logs.append(self._memory_log, [{"id": mid, "kind": kind, "text": text, "files": linked or None, "tags": tags or None, "session": session, "created": created or datetime.date.today().isoformat(), "line_no": self._next_line()}])
        logs.compact(self.spark, self.memories().drop("first_line"), self._memory_log)
        return mid

    def _next_line(self) -> int:
        import time

        return time.time_ns()

    def forget(self, mid: str) -> None:
        logs.append(self._memory_log, [{"id": mid, "deleted": True, "line_no": self._next_line()}])

    def recall(self, query: str | None = None, **options) -> DataFrame:
        files = self.tables.files.withColumn("repo", F.lit(""))
        return memory.search(self.memories(), files, search.analyze(query, self.cfg.synonyms) if query else None, **options)

    def _bundle_memories(self, ranked: DataFrame, terms: list[str]):
        if not os.path.isdir(self._memory_log):
            return []
        return memory.for_bundle(self.memories(), ranked, terms, packing.MAX_MEMORIES).select("id", "kind", "text", "reasons", F.map_keys("files").alias("files")).collect()

    # -- sessions

    def load_session(self, name: str | None) -> dict:
        if name is None:
            return {"known": {}, "seen": []}
        if not valid_session(name):
            raise ValueError("the session's name has another form")
        try:
            with open(os.path.join(self.home, "sessions", name + ".json")) as f:
                s = json.load(f)
            return {"known": s["known"], "seen": s["seen"]} if s.get("v") == 2 else {"known": {}, "seen": []}
        except (OSError, ValueError, KeyError):
            return {"known": {}, "seen": []}

    def save_session(self, name: str, known: dict[str, str], seen: list[str]) -> None:
        old = self.load_session(name)
        path = os.path.join(self.home, "sessions", name + ".json")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".tmp", "w") as f:
            json.dump({"v": 2, "known": packing.merge_known(old["known"], known), "seen": packing.merge_seen(old["seen"], seen)}, f)
        os.replace(path + ".tmp", path)

    # -- usage

    def replaced(self, kind: str, doc, path: str | None = None) -> int:
        """Tokens of the files that a response stands in for: those it gives content of, an outline's file, patched files."""
        if kind == "context":
            return sum(x["tokens"] for x in doc["results"] if x.get("spans") or x.get("symbols"))
        paths = [path] if kind == "outline" and doc else sorted({h["path"] for h in doc.get("hunks", [])}) if kind == "changed" else []
        if not paths:
            return 0
        return self.tables.files.filter(F.col("path").isin(paths)).agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("n")).first()["n"]

    def record(self, command: str, served: int, replaced: int, source: str = "cli", files: int | None = None) -> None:
        """Best effort: a call that can't be recorded is not an error."""
        try:
            now = datetime.datetime.now(datetime.timezone.utc).isoformat()
            logs.append(os.path.join(self.home, "usage"), [{"v": 1, "ts": now, "command": command, "source": source, "served": served, "replaced": replaced, "files": files}])
        except OSError:
            pass

    def stats(self) -> dict:
        folder = os.path.join(self.home, "usage")
        if not os.path.isdir(folder):
            return {"totals": None, "commands": [], "days": []}
        r = usage.valid(logs.read(self.spark, folder, logs.USAGE_SCHEMA).drop("usage_id"))
        money = S.price(F.col("saved"), self.cfg.price_rate, self.cfg.currency).alias("price")
        return {"totals": usage.totals(r).select("*", money).first().asDict(), "commands": [x.asDict() for x in usage.by_command(r).collect()], "days": [x.asDict() for x in usage.by_day(r).collect()]}

    def render(self, kind: str, rows, fmt: str = "json") -> str:
        items = rows.collect() if isinstance(rows, DataFrame) else rows
        if kind == "architecture" and fmt == "text":
            return render.tree_text(items[0]["tree"])
        return {"json": lambda: render.to_json(kind, items), "text": lambda: render.to_text(items), "md": lambda: render.to_markdown(kind, items), "html": lambda: render.to_html(kind, items)}[fmt]()


def discover(start: str, marker: str = os.path.join(".index", "config.json")) -> str | None:
    """The nearest directory at or above ``start`` that holds a configuration, None without one."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, marker)):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def to_relative(root: str, path: str, cwd: str = ".") -> str | None:
    """A path with forward slashes relative to the root, None outside it."""
    full = os.path.normpath(os.path.join(os.path.abspath(cwd), path))
    rel = os.path.relpath(full, os.path.abspath(root)).replace(os.sep, "/")
    return None if rel == ".." or rel.startswith("../") else rel


def valid_session(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9._-]{1,64}", name)) and name not in (".", "..")


def textops_scale(tokens: int | None, factor: float) -> int:
    import math

    return min(math.ceil((tokens or 0) * factor), 2**31 - 1)


def round2(n: int) -> int:
    if n < 100:
        return n
    m = 10 ** (len(str(n)) - 2)
    return (n + m // 2) // m * m
