"""Results as text, compact JSON, Markdown and HTML, from rows already bounded by a top or a budget."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import Row


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items() if v is not None}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x if isinstance(x, (str, int, float, bool)) or x is None else str(x)


def to_json(kind: str, rows: Iterable, **meta) -> str:
    """One compact document, nulls left out, keys in the order of the columns."""
    return json.dumps({"schema_version": 3, "kind": kind, **_plain(meta), "results": _plain(list(rows))}, ensure_ascii=False, separators=(",", ":"))


def to_text(rows: Iterable) -> str:
    return "\n".join("  ".join(str(v) for v in (_plain(r) or {}).values()) for r in rows)


def to_markdown(title: str, rows: Iterable) -> str:
    items = [_plain(r) for r in rows]
    cols = list(dict.fromkeys(k for r in items for k in r))
    cell = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols), *("| " + " | ".join(cell(r.get(c)) for c in cols) + " |" for r in items)])


def to_html(title: str, rows: Iterable) -> str:
    items = [_plain(r) for r in rows]
    cols = list(dict.fromkeys(k for r in items for k in r))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in cols)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in cols) + "</tr>" for r in items)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def tree_text(rows: Iterable) -> str:
    """An indented directory tree of (dir, depth, files, loc) rows."""
    out = []
    for r in sorted((_plain(r) for r in rows), key=lambda r: r["dir"].split("/") if r["dir"] else []):
        out.append("  " * r["depth"] + f"{r['dir'].rsplit('/', 1)[-1] or '.'}  {r['files']} files, {r['loc']} lines")
    return "\n".join(out)
