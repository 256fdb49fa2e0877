"""The commands on a command line, and the same over stdio as JSON-RPC tools.

    python -m fathom.cli --root DIR [--home DIR] COMMAND ...

Exit codes: 0 done, 1 nothing found, 2 wrong use, 3 no usable index.
"""

from __future__ import annotations

import argparse
import json
import sys

from .api import Repository
from .session import build_session

# The tools of the server, their names and parameters.
#: Tools of the server: name -> (method, parameters with their JSON types).
TOOLS = {
    "search": {"query": "string", "top": "integer", "symbols": "boolean"},
    "get_context": {"query": "string", "top": "integer", "budget": "integer", "detail": "string", "known": "object", "seen": "array", "session": "string", "memories": "boolean", "budget_tokens": "integer", "projected_read_budget": "integer", "strip_comments": "boolean"},
    "get_related_files": {"path": "string"},
    "get_outline": {"path": "string"},
    "get_changes": {"patch": "boolean"},
    "get_architecture": {"depth": "integer"},
    "memory_search": {"query": "string", "top": "integer", "kind": "string", "file": "string", "session": "string"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathom")
    p.add_argument("--root", default=".")
    p.add_argument("--home")
    p.add_argument("--format", choices=["json", "text", "md", "html"], default="json")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    sub.add_parser("index").add_argument("--full", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--symbols", action="store_true")
    sub.add_parser("related").add_argument("path")
    sub.add_parser("outline").add_argument("path")
    c = sub.add_parser("context")
    c.add_argument("query")
    c.add_argument("--top", type=int, default=8)
    c.add_argument("--budget", type=int)
    c.add_argument("--detail", choices=["paths", "outline", "slices"], default="paths")
    c.add_argument("--session")
    c.add_argument("--budget-tokens", type=int)
    c.add_argument("--projected-read-budget", type=int)
    c.add_argument("--known", action="append", default=[], metavar="PATH@HASH")
    c.add_argument("--seen", action="append", default=[], metavar="RECEIPT")
    c.add_argument("--strip-comments", action="store_true")
    c.add_argument("--no-memory", action="store_true")
    sub.add_parser("changed").add_argument("--patch", action="store_true")
    sub.add_parser("architecture").add_argument("--depth", type=int, default=3)
    sub.add_parser("prime").add_argument("--files", type=int, default=5)
    m = sub.add_parser("memory").add_subparsers(dest="action", required=True)
    c = m.add_parser("add")
    c.add_argument("text")
    c.add_argument("--kind", default="note")
    c.add_argument("--file", action="append", default=[])
    c.add_argument("--tag", action="append", default=[])
    c.add_argument("--session")
    c = m.add_parser("search")
    c.add_argument("query", nargs="?")
    c.add_argument("--top", type=int, default=10)
    m.add_parser("rm").add_argument("id")
    sub.add_parser("stats")
    sub.add_parser("serve")
    return p


def run(repo: Repository, a: argparse.Namespace):
    """(kind, rows or a document) of one command."""
    k = a.command
    if k == "init":
        return k, [{"config": repo.init(a.force)}]
    if k == "index":
        return k, [repo.index(a.full)]
    if k == "search":
        return k, repo.search(a.query, a.top, a.symbols)
    if k == "related":
        return k, repo.related(a.path)
    if k == "outline":
        return k, repo.outline(a.path)
    if k == "context":
        known = dict(x.rsplit("@", 1) for x in a.known if "@" in x)
        return k, [repo.context(a.query, a.top, a.budget, a.detail, known, a.seen, a.session, not a.no_memory, a.budget_tokens, a.projected_read_budget, a.strip_comments)]
    if k == "changed":
        delta, hit = repo.changed()
        doc = {"worktree_id": repo.worktree_id(delta), "changed": [r.asDict() for r in delta.collect()], "impacted": [r.asDict() for r in hit.collect()]}
        return k, [doc | ({"hunks": [r.asDict() for r in repo.patch().collect()]} if a.patch else {})]
    if k == "architecture":
        return k, [repo.architecture(a.depth)]
    if k == "prime":
        return k, [repo.prime(a.files)]
    if k == "memory":
        if a.action == "add":
            return k, [{"id": repo.remember(a.text, a.kind, a.file, a.tag, a.session)}]
        if a.action == "rm":
            repo.forget(a.id)
            return k, [{"removed": a.id}]
        return k, repo.recall(a.query, top=a.top)
    return k, [repo.stats()]


def call(repo: Repository, tool: str, args: dict):
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if tool == "search":
        return rows(repo.search(args["query"], args.get("top", 10), args.get("symbols", False)))
    if tool == "get_context":
        return repo.context(**args)
    if tool == "get_related_files":
        return rows(repo.related(args["path"]))
    if tool == "get_outline":
        return rows(repo.outline(args["path"]))
    if tool == "get_changes":
        delta, hit = repo.changed()
        return {"worktree_id": repo.worktree_id(delta), "changed": rows(delta), "impacted": rows(hit)} | ({"hunks": rows(repo.patch())} if args.get("patch") else {})
    if tool == "get_architecture":
        return repo.architecture(args.get("depth", 3))
    if tool == "memory_search":
        return rows(repo.recall(args.pop("query", None), **args))
    raise KeyError(tool)


def serve(repo: Repository, lines, out) -> None:
    """Answer JSON-RPC requests, one a line; an error of a tool is a result that says so."""
    for line in lines:
        if not line.strip():
            continue
        try:
            req = json.loads(line)
        except ValueError:
            out.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}) + "\n")
            continue
        method, params, answer = req.get("method"), req.get("params") or {}, None
        if method == "initialize":
            answer = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "fathom", "version": "1"}}
        elif method == "tools/list":
            answer = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, p in TOOLS.items()]}
        elif method == "tools/call":
            try:
                body, bad = call(repo, params["name"], dict(params.get("arguments") or {})), False
            except Exception as e:  # the caller gets it as a result
                body, bad = {"error": str(e)[:500]}, True
            answer = {"content": [{"type": "text", "text": json.dumps(body, ensure_ascii=False, default=str)}], "isError": bad}
        if "id" in req:
            reply = {"result": answer} if answer is not None else {"error": {"code": -32601, "message": "no such method"}}
            out.write(json.dumps({"jsonrpc": "2.0", "id": req["id"], **reply}) + "\n")
            out.flush()


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    repo = Repository(spark or build_session("fathom", "local[*]"), a.root, a.home)
    if a.command == "serve":
        serve(repo, sys.stdin, sys.stdout)
        return 0
    try:
        kind, rows = run(repo, a)
        body = repo.render(kind, rows, a.format)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 3
    except (ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 3 if "out of date" in str(e) else 2
    print(body)
    if kind in ("search", "context", "outline", "changed"):
        doc = [r.asDict() for r in rows.collect()] if kind == "outline" else rows[0] if kind in ("context", "changed") else None
        repo.record(kind, repo.counter.count(body), repo.replaced(kind, doc, getattr(a, "path", None)) if doc else 0)
    return 1 if kind in ("search", "related", "outline") and '"results":[]' in body else 0


if __name__ == "__main__":
    sys.exit(main())
