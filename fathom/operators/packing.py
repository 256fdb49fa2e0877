"""Packing ranked items into budgets: greedy and exact, for any number of items.

``taken`` folds only items that can be taken, whose number depends on ``budget`` and ``top`` alone; all others are
classified by where they stand. The functions that depend on the rendered text of a response run on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# What a frame costs besides its texts, the part of a budget that notes may take, and their number.
ITEM_OVERHEAD, SYMBOL_OVERHEAD, MEMORY_OVERHEAD, MEMORY_SHARE, MAX_MEMORIES = 40, 26, 24, 5, 3


def _item() -> Column:
    return F.struct(F.col("pos").cast("long").alias("pos"), "path", F.col("cost").cast("long").alias("cost"))


def _fold(items: DataFrame, budget: int, top: int) -> DataFrame:
    """One row: ``out``, the items taken in rank order. Costs are not negative and each ``pos`` occurs once.

    As the room only shrinks, an item that is taken has only taken ones of its cost before it: so the first
    ``top`` items of each cost are enough, at most ``top * (budget + 1)`` of them.
    """
    w = Window.partitionBy("cost").orderBy("pos", "path")
    possible = items.filter(F.col("cost") <= budget).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top)
    one = possible.agg(F.array_sort(F.collect_list(_item())).alias("r"))
    kind = "struct<used:bigint,out:array<struct<pos:bigint,path:string,cost:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,path:string,cost:bigint>>").alias("out")).cast(kind)

    def step(acc, x):
        ok = (F.size(acc["out"]) < top) & (acc["used"] + x["cost"] <= budget)
        return F.when(ok, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["out"], F.array(x)).alias("out")).cast(kind)).otherwise(acc)

    return one.select(F.aggregate("r", start, step, lambda a: a["out"]).alias("out"))


def taken(items: DataFrame, budget: int, top: int) -> DataFrame:
    """(pos, path, cost) of the items taken: in rank order, an item that does not fit is skipped, not the end."""
    return _fold(items, budget, top).select(F.explode("out").alias("x")).select("x.*")


def pack(items: DataFrame, budget: int, top: int) -> DataFrame:
    """(pos, path, cost, chosen, full) of every item of (path, cost, pos), chosen as ``taken`` does.

    ``full`` says that ``top`` items had been taken before.
    """
    items = cut_lineage(items.select(_item().alias("x")).select("x.*"))  # read twice
    one = _fold(items, budget, top)
    chosen = one.select(F.explode("out").alias("x")).select("x.*", F.lit(True).alias("chosen"))
    # where the last of ``top`` items stands; null while there is room for more
    end = one.select(F.when(F.size("out") >= top, F.coalesce(F.array_max(F.transform("out", lambda x: x["pos"])), F.lit(-(2**63)))).alias("last"))
    every = items.join(F.broadcast(chosen), ["pos", "path", "cost"], "left").crossJoin(F.broadcast(end))
    return every.select("pos", "path", "cost", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.coalesce(F.col("pos") > F.col("last"), F.lit(False)).alias("full"))


def omissions(packed: DataFrame) -> DataFrame:
    """Items and tokens by outcome: selected, left out behind ``top``, or too large for what was left."""
    outcome = F.when(F.col("chosen"), "selected").when(F.col("full"), "top").otherwise("budget_tokens")
    return packed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items"), F.sum("cost").alias("tokens"))


def duplicates(items: DataFrame) -> DataFrame:
    """(path, duplicate_of): items with the content of a better ranked one."""
    w = Window.partitionBy("content_hash").orderBy("pos")
    d = items.filter("content_hash IS NOT NULL").withColumns({"first": F.first("path").over(w), "n": F.row_number().over(w)})
    return d.filter("n > 1").select("path", F.col("first").alias("duplicate_of"))


# -- driver side: what depends on the rendered response


def envelope(path: str, reasons: Iterable[str], count: Callable[[str], int]) -> int:
    """Estimated tokens of an item's frame."""
    return ITEM_OVERHEAD + count(path) + count(",".join(reasons))


def outline_cost(symbols: Iterable[dict], count: Callable[[str], int]) -> int:
    """Estimated tokens of an outline: a frame for each symbol, and all signatures with their docs."""
    shown = [f"{s.get('signature') or ''} {s['doc']}" if s.get("doc") else s.get("signature") or "" for s in symbols]
    return SYMBOL_OVERHEAD * len(shown) + count("\n".join(shown)) if shown else 0


def memory_cost(text: str, reasons: Iterable[str], files: Iterable[str], count: Callable[[str], int]) -> int:
    """Estimated tokens of a note: its text, its frame and the links in it."""
    return count(text) + MEMORY_OVERHEAD + count(",".join(reasons)) + sum(count(f) + 8 for f in files)


def costs(item: dict, count: Callable[[str], int], scale: Callable[[int], int] = int, escape: Callable[[str], str] = str) -> dict:
    """The item with estimated_tokens and projected_read_tokens.

    A pointer costs its whole file, as that is what will be read; delivered content costs itself as it is
    escaped in a response, and its frame, and nothing is read after it; a duplicate costs nothing.
    """
    if item.get("duplicate_of"):
        return item | {"estimated_tokens": 0, "projected_read_tokens": 0}
    if item.get("spans"):
        n = sum(count(escape(u["text"])) for u in item["spans"])
    elif item.get("symbols"):
        n = outline_cost(item["symbols"], count)
    else:
        return item | {"estimated_tokens": item["tokens"], "projected_read_tokens": item["tokens"]}
    return item | {"estimated_tokens": scale(n + envelope(item["path"], item["reasons"], count)), "projected_read_tokens": 0}


def reserve_memories(notes: Iterable[dict], budget: int | None, count: Callable[[str], int], scale: Callable[[int], int] = int, most: int = MAX_MEMORIES) -> list[dict]:
    """The best notes, ``most`` at most, whose costs stay within a fifth of a token budget; one that is too large is skipped."""
    left = budget // MEMORY_SHARE if budget is not None else None
    out: list[dict] = []
    for m in notes:
        if len(out) == most:
            break
        cost = scale(memory_cost(m["text"] or "", m["reasons"], m.get("files") or (), count))
        if left is None or cost <= left:
            left = None if left is None else left - cost
            out.append({k: v for k, v in m.items() if k != "files"} | {"estimated_tokens": cost})
    return out


@dataclass
class Budgets:
    """Limits in tokens, each None for none: of the estimates, of what is read afterwards, and of the rendered response."""

    tokens: int | None = None
    read: int | None = None
    response: int | None = None


class Packer:
    """Takes ranked items one after the other; what is not taken is counted by the limit that kept it out.

    ``measure`` gives the tokens of the response that would be delivered with these items.
    """

    def __init__(self, limits: Budgets, top: int, measure: Callable[[list[dict]], int], price: Callable[[dict], dict]):
        self.limits, self.top, self.measure, self.price = limits, top, measure, price
        self.chosen: list[dict] = []
        self.used = self.read = 0
        self.omitted = {"top": 0, "budget_tokens": 0, "projected_read_budget": 0, "response_budget": 0}
        #: Among the items that only the response budget kept out, the form with the shortest text.
        self.smallest: dict | None = None

    @property
    def full(self) -> bool:
        return len(self.chosen) >= self.top

    def offer(self, item: dict) -> bool:
        if self.full:
            self.omitted["top"] += 1
            return False
        forms = [self.price(v) for v in variants(item)]
        within = [v for v in forms if self.limits.tokens is None or self.used + v["estimated_tokens"] <= self.limits.tokens]
        readable = [v for v in within if self.limits.read is None or self.read + v["projected_read_tokens"] <= self.limits.read]
        for v in readable:
            if self.limits.response is None or self.measure([*self.chosen, v]) <= self.limits.response:
                self.chosen.append(v)
                self.used += v["estimated_tokens"]
                self.read += v["projected_read_tokens"]
                return True
        self.omitted["budget_tokens" if not within else "projected_read_budget" if not readable else "response_budget"] += 1
        if readable:
            least = min([*readable, *([self.smallest] if self.smallest else [])], key=lambda v: len(render([v])))
            self.smallest = least
        return False


def fitting_budget(measure: Callable[[int], int], asked: int) -> int:
    """The first budget above ``asked`` under which a response fits that states its own budget.

    What is measured is proposed next, 64 times at most, then it is doubled, 16 times at most.
    """
    proposed = max(asked, 1)
    for grow in (lambda said, now: said, lambda said, now: 2 * now):
        for _ in range(64 if grow(1, 1) == 1 else 16):
            said = measure(proposed)
            if said <= proposed:
                return proposed
            proposed = grow(said, proposed)
    raise RuntimeError("no budget was found that the response fits into")


def variants(item: dict) -> Iterable[dict]:
    """An item and its smaller forms: fewer spans by rank down to two, then each span alone; symbols likewise."""
    yield item
    for key in ("spans", "symbols"):
        parts = item.get(key) or []
        for n in range(len(parts) - 1, 1, -1):
            yield item | {key: parts[:n]}
        if len(parts) > 1:
            for p in parts:
                yield item | {key: [p]}


def dumps(doc: dict) -> str:
    """Compact JSON of a response, nulls left out: the text that is delivered and that budgets are measured on."""
    prune = lambda x: {k: prune(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [prune(v) for v in x] if isinstance(x, (list, tuple)) else x
    return json.dumps(prune(doc), ensure_ascii=False, separators=(",", ":"))


def render(items: list[dict], memories: list[dict] = (), **meta) -> str:
    """The items and notes alone, as they stand in a response."""
    return dumps({"schema_version": 3, **meta, "memories": list(memories) or None, "results": items})


def merge_seen(session: Iterable[str], given: Iterable[str]) -> list[str]:
    """Well-formed receipts of a session and of a call, each once, sorted."""
    import re

    return sorted({r for r in [*session, *given] if re.fullmatch(r"[A-Za-z0-9_-]{43}", r)})


def merge_known(session: dict[str, str], given: dict[str, str]) -> dict[str, str]:
    return {**session, **given}
