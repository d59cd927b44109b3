"""Per-graph dense linear algebra on small graphs, many graphs per Arrow batch.

Rows are shuffled once by graph and sorted, so each task streams whole graphs. Graphs of equal size
are stacked and solved together. These are the forms for corpora of small graphs: a task holds a few matrices
of n x n entries for a graph of n nodes. For large graphs the callers have forms by joins under their own
names; no size decides between the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.keys import FINE, Key, names, spread_by
from .tables import GRAPH

STACK_CELLS = 1 << 22
FRAME_ROWS = 50_000


def _changes(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """True where a row starts another group than the row before it."""
    fresh = np.zeros(len(frame), bool)
    for c in by:
        values = frame[c].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return fresh


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str], rows: int = 1) -> Iterator[pd.DataFrame]:
    """Re-cut a key-sorted stream into frames of at least ``rows`` rows that split no group."""
    held: list[pd.DataFrame] = []
    count = 0
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        count += len(frame)
        if count < rows:
            continue
        joined = pd.concat(held, ignore_index=True) if len(held) > 1 else frame
        starts = np.flatnonzero(_changes(joined, by))
        if len(starts):
            yield joined.iloc[: starts[-1]].reset_index(drop=True)
            joined = joined.iloc[starts[-1] :]
        held, count = [joined], len(joined)
    if held:
        yield pd.concat(held, ignore_index=True)


def smallest_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number among all that links ``a``-``b`` join to each of 0..n-1."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above


class Numbered:
    """The whole graphs of a frame, their nodes numbered by graph, component and id.

    ``keys`` has a row per graph; ``graph``, ``component`` and ``ids`` an entry per node; ``first`` the first node of each
    component; ``a``, ``b`` and ``weight`` an entry per edge. With ``split`` false a graph is one component.
    """

    def __init__(self, frame: pd.DataFrame, by: list[str], split: bool = True):
        fresh = _changes(frame, by)
        graph = np.cumsum(fresh)
        src, dst = frame["src"].to_numpy(), frame["dst"].to_numpy()
        self.weight = frame["weight"].to_numpy(float) if "weight" in frame else np.ones(len(frame))
        # number the nodes of each graph in order of their id
        owner, ends = np.concatenate([graph, graph]), np.concatenate([src, dst])
        order = np.lexsort((ends, owner))
        g_sorted, v_sorted = owner[order], ends[order]
        unseen = np.ones(len(order), bool)
        unseen[1:] = (g_sorted[1:] != g_sorted[:-1]) | (v_sorted[1:] != v_sorted[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(unseen) - 1
        self.ids, self.graph = v_sorted[unseen], g_sorted[unseen]
        self.a, self.b = number[: len(frame)], number[len(frame) :]
        fresh[:1] = True
        self.keys = frame.loc[fresh, by].reset_index(drop=True)
        self.component = self.graph
        if split:
            label = smallest_joined(len(self.ids), self.a, self.b)
            self.component = (np.cumsum(label == np.arange(len(label))) - 1)[label]
            order = np.argsort(self.component, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.ids, self.graph, self.component = self.ids[order], self.graph[order], self.component[order]
            self.a, self.b = place[self.a], place[self.b]
        self.size = np.bincount(self.component)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)


class Stack:
    """Graphs, or components, of one size: key rows, sorted node ids ``(k, n)`` and adjacency ``(k, n, n)``.

    ``parts`` is each one's number among the components of the frame.
    """

    def __init__(self, keys: pd.DataFrame, nodes: np.ndarray, adjacency: np.ndarray, parts: np.ndarray | None = None):
        self.keys, self.nodes, self.adjacency, self.parts = keys, nodes, adjacency, parts

    def laplacian(self) -> np.ndarray:
        off = self.adjacency.copy()
        n = off.shape[1]
        off[:, range(n), range(n)] = 0.0
        lap = -off
        lap[:, range(n), range(n)] = off.sum(axis=2)
        return lap


def stacks(frame: pd.DataFrame, by: list[str]) -> Iterator[Stack]:
    """Group the whole graphs of ``frame`` by size and build their matrices."""
    yield from stacked(Numbered(frame, by, split=False))


def stacked(graphs: Numbered, parts: np.ndarray | None = None) -> Iterator[Stack]:
    """The matrices of the components, or of the numbered ones among them, those of equal size together."""
    # edges by component, so that a stack finds its own without a pass over all
    order = np.argsort(graphs.component[graphs.a], kind="stable")
    a, b, weight = graphs.a[order], graphs.b[order], graphs.weight[order]
    edges = np.concatenate([[0], np.cumsum(np.bincount(graphs.component[a], minlength=len(graphs.size)))])
    by_size = np.argsort(graphs.size, kind="stable") if parts is None else parts[np.argsort(graphs.size[parts], kind="stable")]
    sizes, begins = np.unique(graphs.size[by_size], return_index=True)
    for n, members in zip(sizes, np.split(by_size, begins[1:])):
        step = max(1, STACK_CELLS // int(n * n))
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            count = edges[part + 1] - edges[part]
            s = np.repeat(np.arange(len(part)), count)
            rows = np.arange(len(s)) + np.repeat(edges[part] - np.cumsum(count) + count, count)
            i, j, w = a[rows] - graphs.first[part][s], b[rows] - graphs.first[part][s], weight[rows]
            adj = np.zeros((len(part), n, n))
            np.add.at(adj, (s, i, j), w)
            mirror = i != j
            np.add.at(adj, (s[mirror], j[mirror], i[mirror]), w[mirror])
            ids = graphs.ids[graphs.first[part][:, None] + np.arange(n)[None, :]]
            graph = graphs.graph[graphs.first[part]]
            yield Stack(graphs.keys.iloc[graph].reset_index(drop=True), ids, adj, part)


def map_blocks(
    edges: DataFrame, solve: Callable[[Stack], pd.DataFrame], schema: str, key: Key = GRAPH
) -> DataFrame:
    """Apply ``solve`` to stacks of whole graphs."""
    by = names(key)
    cols = [*by, "src", "dst"] + (["weight"] if "weight" in edges.columns else [])

    def run(frames):
        for frame in whole_groups(frames, by, FRAME_ROWS):
            for stack in stacks(frame, by):
                yield solve(stack)

    return spread_by(edges.select(*cols), by).mapInPandas(run, schema)


def map_components(
    edges: DataFrame, solve: Callable[[Numbered], Iterator[pd.DataFrame]], schema: str, key: Key = GRAPH
) -> DataFrame:
    """Apply ``solve`` to frames of whole graphs that are numbered by component."""
    by = names(key)
    cols = [*by, "src", "dst"] + (["weight"] if "weight" in edges.columns else [])

    def run(frames):
        for frame in whole_groups(frames, by, FRAME_ROWS):
            yield from solve(Numbered(frame, by))

    return spread_by(edges.select(*cols), by, times=FINE).mapInPandas(run, schema)


def key_schema(df: DataFrame, key: Key) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in names(key))


def spread(stack: Stack, **columns) -> pd.DataFrame:
    """One row per node of the stack; each value is a ``(k, n)`` array."""
    k, n = stack.nodes.shape
    out = stack.keys.loc[stack.keys.index.repeat(n)].reset_index(drop=True)
    for name, values in columns.items():
        out[name] = list(values.reshape(k * n, -1)) if values.ndim == 3 else values.reshape(-1)
    return out
