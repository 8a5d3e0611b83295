"""Deeply nested JSON records taken apart into flat tables that keep their parents.

A schema of nodes names the paths wanted. A batch of records is shredded into columns, node after node for all its records at
once, one column per leaf path, each entry with a repetition level (at which repeated ancestor it continues) and a
definition level (how much of its path is there). The table of a repeated ancestor is then rebuilt from the level sequences
of its leaves alone: ordinals are running counts of repetition levels, missing values are entries whose definition level
stays below the leaf's. Paths that a table doesn't need aren't shredded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import arrow_map


@dataclass(frozen=True)
class Node:
    """A field of the nested schema.

    repeated: a list; a lone value in its place is a list of one. names: the keys it may stand under, the first that is
    there counts; a name that begins with ``*`` stands for the first key with
    the rest as its ending, which a leaf called ``kind`` keeps. wrapped: the value may sit in an object as its ``value``.
    """

    name: str
    names: tuple[str, ...] = ()
    rest: bool = False  # a leaf that keeps, as JSON, all fields of its parent that no other node names
    repeated: bool = False
    wrapped: bool = True
    children: tuple[Node, ...] = field(default=())


@dataclass
class Leaf:
    """A shredded column: values where defined, levels everywhere."""

    path: tuple[str, ...]
    max_rep: int
    max_def: int
    values: list = field(default_factory=list)
    reps: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    defs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _unwrap(v):
    while type(v) is dict and len(v) == 1 and "value" in v:
        v = v["value"]
    return v


def _unwrapped(column: list) -> list:
    return [_unwrap(v) if type(v) is dict and len(v) == 1 else v for v in column]


def _text(v) -> str:
    return v if type(v) is str else json.dumps(v, ensure_ascii=False)


class Shredder:
    """Shreds records by a schema. root is the record itself; if repeated, a record may be a list. wanted: the leaf paths, of all
    if none are named."""

    def __init__(self, root: Node, wanted: set[tuple[str, ...]] | None = None):
        self.root = root
        self.leaves: dict[tuple[str, ...], Leaf] = {}
        self._plan(root, (), 0, 0, wanted)
        self.nodes = {path[:k] for path in self.leaves for k in range(1, len(path) + 1)}

    def _plan(self, node: Node, path: tuple[str, ...], rep: int, deep: int, wanted: set[tuple[str, ...]] | None) -> None:
        path = (*path, node.name)
        rep, deep = rep + node.repeated, deep + 1
        if not node.children and (wanted is None or path in wanted):
            self.leaves[path] = Leaf(path, rep, deep)
        for c in node.children:
            self._plan(c, path, rep, deep, wanted)

    def shred(self, records: list) -> None:
        """A batch of records, in the place of any before it."""
        self._emit(self.root, (), records, np.zeros(len(records), np.int64), np.zeros(len(records), np.int64), 0, [None] * len(records))

    def _emit(self, node: Node, path: tuple[str, ...], column: list, reps: np.ndarray, defs: np.ndarray, level: int, kinds: list) -> None:
        """A node's column: what stands there in every entry of its parent, None if nothing does."""
        path = (*path, node.name)
        if node.wrapped:
            column = _unwrapped(column)
        if node.repeated:
            level += 1
            sizes = np.array([len(v) if type(v) is list else 1 for v in column], np.int64)
            lists, sizes = column, np.maximum(sizes, 1)  # an empty list has one entry, with nothing in it
            column = [x for v in lists for x in (v or (None,) if type(v) is list else (v,))]
            first = np.cumsum(sizes) - sizes
            reps, at = np.repeat(reps, sizes), np.ones(int(sizes.sum()), bool)
            at[first] = False
            reps[at] = level
            defs = np.repeat(defs, sizes)
            kinds = [k for k, n in zip(kinds, sizes.tolist()) for _ in range(n)] if any(k is not None for k in kinds) else [None] * len(column)
            if node.wrapped:
                column = _unwrapped(column)
        defs = defs + np.array([v is not None for v in column], bool)
        if not node.children:
            leaf = self.leaves[path]
            leaf.reps, leaf.defs, leaf.values = reps, defs, [_text(v) for v in column if v is not None]
            return
        for c in node.children:
            if (*path, c.name) in self.nodes:
                sub, own = self._column(node, column, c, kinds)
                self._emit(c, path, sub, reps, defs, level, own)

    @staticmethod
    def _column(node: Node, column: list, c: Node, kinds: list) -> tuple[list, list]:
        if c.name == "kind":
            return [k if v is not None else None for k, v in zip(kinds, column)], kinds
        if c.rest:
            named = {n for x in node.children if not x.rest for n in x.names or (x.name,)}
            return [({k: x for k, x in v.items() if k not in named} or None) if type(v) is dict else None for v in column], kinds
        names = c.names or (c.name,)
        if len(names) == 1 and not names[0].startswith("*"):
            name = names[0]
            return [v.get(name) if type(v) is dict else None for v in column], kinds
        found = [_find(v, c, k) if type(v) is dict else (None, k) for v, k in zip(column, kinds)]
        return [x for x, _ in found], [k for _, k in found]


def _find(item: dict, c: Node, kind):
    """The first of the node's names that isn't null, and the key that stands for an open one."""
    for name in c.names:
        open_end = name.startswith("*")
        for k in [k for k in item if k.endswith(name[1:])] if open_end else [name] if name in item else []:
            if (_unwrap(item[k]) if c.wrapped else item[k]) is not None:
                return item[k], k if open_end else kind
    return None, kind


def ordinals(reps: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The record of each entry, and its place within its parent at repeated levels 1 to depth, from 0."""
    record = np.cumsum(reps == 0) - 1
    places, n = [], np.arange(len(reps))
    for k in range(1, depth + 1):
        count = np.cumsum(reps == k)
        start = np.maximum.accumulate(np.where(reps < k, n, -1)) if len(reps) else n
        places.append(count - count[start] if len(reps) else count)
    return record, places


def rebuild(leaves: list[Leaf], at: Leaf, depth: int, defined: int) -> dict[str, object]:
    """The table of a repeated ancestor at repeated level depth: record, ordinals, and the columns of its own leaves.

    One row per entry of the ancestor that is there, that is whose definition level reaches defined.
    """
    out: dict[str, object] = {}
    for leaf in leaves:
        defs = leaf.defs
        if leaf is at:
            record, places = ordinals(leaf.reps, depth)
            out["record"], out["places"], out["there"] = record, places, defs >= defined
        values = np.full(len(defs), None, object)
        full = defs == leaf.max_def
        values[full] = leaf.values
        out["/".join(leaf.path)] = values
    return out


#: The wanted part of a viewport message: events, their elements and campaigns.
_CAMPAIGN = Node("campaign", children=(Node("assetId"), Node("flightId")))
VIEWPORT = Node(
    "event",
    repeated=True,
    wrapped=False,
    children=(
        Node(
            "channel",
            ("engagementEventValueValue", "impressionEventValueValue", "*EventValueValue"),
            children=(
                Node(
                    "version",
                    ("v1EventValueValue",),
                    children=(
                        Node(
                            "body",
                            ("*ValueValue",),
                            children=(
                                Node("kind", wrapped=False),
                                Node("deviceId"),
                                Node("platform"),
                                Node("appVersion"),
                                Node("sessionId"),
                                Node("pageViewId"),
                                Node("interactionId"),
                                Node("containerViewId"),
                                _CAMPAIGN,
                                Node("elements", repeated=True, children=(Node("elementId"), Node("elementIdType"), Node("elementIndex"), Node("browseItemId"), _CAMPAIGN, Node("rest", rest=True, wrapped=False))),
                                Node("rest", rest=True, wrapped=False),
                            ),
                        ),
                    ),
                ),
            ),
        ),
    ),
)


def readable(text: str | None):
    """The JSON value of a payload encoded once or twice, or None."""
    if text is None:
        return None
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except (ValueError, RecursionError):
        return None


#: The three flat tables. Every table has row_id, event_pos; elements and campaigns have element_pos, -1 for the event's own.
SCHEMAS = {
    "events": "row_id bigint, event_pos int, kind string, deviceId string, platform string, appVersion string, sessionId string, pageViewId string, interactionId string, containerViewId string, rest string",
    "elements": "row_id bigint, event_pos int, element_pos int, elementId string, elementIdType string, elementIndex string, browseItemId string, rest string",
    "campaigns": "row_id bigint, event_pos int, element_pos int, assetId string, flightId string",
}
_BODY = "event/channel/version/body"


def _batch(ids: list, payloads: list, which: str) -> pa.RecordBatch:
    columns = [c.split()[0] for c in SCHEMAS[which].split(", ")]
    holders = {"events": [_BODY], "elements": [f"{_BODY}/elements"], "campaigns": [f"{_BODY}/campaign", f"{_BODY}/elements/campaign"]}[which]
    shredder = Shredder(VIEWPORT, {(*h.split("/"), c) for h in holders for c in columns})
    records = [(i, v) for i, v in zip(ids, map(readable, payloads)) if isinstance(v, (dict, list)) and v]
    kept = [i for i, _ in records]
    shredder.shred([v for _, v in records])
    # all records of the batch are rebuilt at once, from levels
    leaf = {"/".join(k): x for k, x in shredder.leaves.items()}
    parts: list[dict[str, np.ndarray]] = []
    own = np.array(kept, object)
    there = 1

    def part(prefix: str, names: list[str], depth: int, defined: int) -> None:
        leaves = [leaf[f"{prefix}/{n}"] for n in names]
        t = rebuild(leaves, leaves[0], depth, defined)
        keep = np.flatnonzero(t["there"])
        if len(keep):
            row = {"row_id": own[t["record"][keep]], "event_pos": t["places"][0][keep], "element_pos": t["places"][1][keep] if depth > 1 else np.full(len(keep), -1)}
            parts.append(row | {n: t[f"{prefix}/{n}"][keep] for n in names})

    if which == "events":
        part(_BODY, columns[2:], 1, there)
    elif which == "elements":
        part(f"{_BODY}/elements", columns[3:], 2, 5)
    else:
        part(f"{_BODY}/campaign", columns[3:], 1, 5)
        part(f"{_BODY}/elements/campaign", columns[3:], 2, 6)
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrays = []
    for c in SCHEMAS[which].split(", "):
        name, kind = c.split()
        arrays.append(pa.array(np.concatenate([p[name] for p in parts]).tolist() if parts else [], types[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=columns)


def shred_viewport(df: DataFrame, which: str, *, row_id: str = "row_id", payload: str = "payload") -> DataFrame:
    """The flat table ``events``, ``elements`` or ``campaigns`` of JSON viewport messages, one per row of df.

    event_pos is the event's place in the payload (0 if it holds one), element_pos the element's place in its list, from 0,
    -1 for the campaign of the event itself; rest holds, as JSON, the fields that have no column of their own. A lone object in the place of a list is a list of one; ``{"value": x}`` and x
    are the same; an element that is null keeps its place but gives no row. All values are text, absent ones null. Payloads
    that are null, no JSON after one or two decodings, or neither object nor list give no rows; repeated rows come out
    repeated; empty tables give none; other columns aren't read. No shuffle.
    """
    src = df.select(F.col(f"`{row_id}`").cast("bigint").alias("id"), F.col(f"`{payload}`").cast("string").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                yield _batch(s["id"].to_pylist(), s["p"].to_pylist(), which)

    return arrow_map(src, run, SCHEMAS[which])


def unreadable_payloads(df: DataFrame, *, row_id: str = "row_id", payload: str = "payload") -> DataFrame:
    """row_id of rows whose payload can't be read, so that they can be kept aside: null, no JSON, or no object or list."""
    src = df.select(F.col(f"`{row_id}`").cast("bigint").alias(row_id), F.col(f"`{payload}`").cast("string").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [i for i, p in enumerate(b["p"].to_pylist()) if not isinstance(readable(p), (dict, list))]
            yield pa.RecordBatch.from_arrays([b[row_id].take(pa.array(bad, pa.int64()))], names=[row_id])

    return arrow_map(src, run, f"{row_id} bigint")
