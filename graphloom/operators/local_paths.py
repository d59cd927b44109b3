"""Path kernels on the whole graphs of a frame: hops by bit-parallel search, dependencies by path counting.

All components of all graphs of a frame advance together. Their sources go in rounds of a bounded number of entries,
so that a task holds the edges of a few graphs and no matrix of n x n entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from .blocks import Numbered

#: Entries of a round: words of a search, or (source, node) cells of path counts.
ROUND_CELLS = 1 << 22
WORDS = 32
#: Neighbours of a node that have a slab.
SLABS = 32
#: Entries of a block of columns, and the work per link and term of a column, in entries of eigenvectors.
BLOCK_CELLS = 1 << 17
TERM_COST = 4.5


def _links(graphs: Numbered, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(node, peer) in both directions, sorted by node, parallel edges once; with weights, only sums other than zero."""
    a, b = np.minimum(graphs.a, graphs.b), np.maximum(graphs.a, graphs.b)
    loose = np.flatnonzero(a != b)
    order = loose[np.lexsort((b[loose], a[loose]))]
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if weighted and len(a):
        total = np.add.reduceat(graphs.weight[order], np.flatnonzero(new))
        a, b = a[new][total != 0], b[new][total != 0]
    else:
        a, b = a[new], b[new]
    node, peer = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((peer, node))
    return node[order], peer[order]


def _own_blocks(graphs: Numbered, local: np.ndarray, size: int) -> np.ndarray:
    """Whether a node's block of ``size`` sources of its component is one of this share of its graph."""
    if "_share" not in graphs.keys:
        return np.ones(len(local), bool)
    share, shares = (graphs.keys[c].to_numpy(np.int64)[graphs.graph] for c in ("_share", "_shares"))
    return (local // size) % shares == share


class Slabs:
    """Neighbours in slabs: nodes stand by falling degree, and slab k holds the k-th neighbours of all that have so many.

    A slab covers the first rows only, so that a product with the links is a gather and an addition in place per slab. What
    a hub has beyond ``SLABS`` neighbours is summed by runs. ``order`` has the node of each row, ``place`` the row of each node.
    """

    def __init__(self, n: int, node: np.ndarray, peer: np.ndarray, weight: np.ndarray | None = None):
        degree = np.bincount(node, minlength=n)
        self.order = np.argsort(-degree, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        at = self.place[node]
        order = np.argsort(at, kind="stable")
        #: links as rows, by the row they lead to
        self.tail, self.head = at[order], self.place[peer[order]]
        weight = None if weight is None else weight[order][:, None]
        rank = np.arange(len(order)) - np.repeat(np.cumsum(degree[self.order]) - degree[self.order], degree[self.order])
        near, far = np.flatnonzero(rank < SLABS), np.flatnonzero(rank >= SLABS)
        near = near[np.argsort(rank[near], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[near])) + 1
        self.slabs = np.split(near, cuts) if len(near) else []
        self.weights = [None if weight is None else weight[s] for s in self.slabs]
        self.slabs = [self.head[s] for s in self.slabs]
        self.far, self.far_weight = self.head[far], None if weight is None else weight[far]
        self.far_begins = np.flatnonzero(np.diff(self.tail[far], prepend=-1))

    def pull(self, x: np.ndarray, out: np.ndarray, buffer: np.ndarray, add: np.ufunc = np.add) -> None:
        """Each row's neighbours' rows of ``x``, added up by ``add``, to ``out``; ``buffer`` is overwritten."""
        out[len(self.slabs[0]) if self.slabs else 0 :] = 0
        for k, (rows, weight) in enumerate(zip(self.slabs, self.weights)):
            got, sums = (buffer if k else out)[: len(rows)], out[: len(rows)]
            # in mode "raise" take would go through a copy of its own
            np.take(x, rows, axis=0, out=got, mode="clip")
            if weight is not None:
                got *= weight
            if k:
                add(sums, got, out=sums)
        if len(self.far):
            got = x[self.far]
            if self.far_weight is not None:
                got *= self.far_weight
            sums = out[: len(self.far_begins)]
            add(sums, add.reduceat(got, self.far_begins, axis=0), out=sums)


def hops_of(graphs: Numbered) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Per node number the sums over the share's sources, and ordered pairs per graph number and hop count.

    Levels that touch few links go by these links alone, all others by slabs.
    """
    node, peer = _links(graphs)
    n = len(graphs.ids)
    reached, total, farthest = (np.zeros(n, np.int64) for _ in range(3))
    own = _own_blocks(graphs, np.arange(n) - graphs.first[graphs.component], 64)
    met, count = np.unique(graphs.graph[own], return_counts=True)
    pairs = [np.stack([met, np.zeros(len(met), np.int64), count])]
    # the share's sources of a component, counted from zero
    seat = np.cumsum(own) - 1
    seat -= (seat - own + 1)[graphs.first][graphs.component]
    longest = int(seat[own].max()) + 1 if own.any() else 0
    words = max(1, min(WORDS, -(-longest // 64), ROUND_CELLS // max(n, 1)))
    size = 64 * words
    linked = np.zeros(n, bool)
    linked[node] = True
    at = None
    for turn in range(-(-longest // size)):
        start = own & (seat // size == turn)
        busy = np.zeros(len(graphs.first), bool)
        busy[graphs.component[start]] = True
        part = np.flatnonzero(busy[graphs.component] & linked)
        if not len(part):
            break
        if at is None or len(part) != len(at):
            at = part
            to = np.full(n, -1)
            to[at] = np.arange(len(at))
            held = to[node] >= 0
            links = Slabs(len(at), to[node[held]], to[peer[held]])
            of_row = at[links.order]
            front, unseen, stepped, buffer = (np.empty((len(at), words), np.uint64) for _ in range(4))
        front[:] = 0
        mine = np.flatnonzero(start[of_row])
        bit = seat[of_row[mine]] % size
        front[mine, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        np.bitwise_not(front, out=unseen)
        lit, open_ = start[of_row], np.ones(len(at), bool)
        level = 0
        while True:
            level += 1
            few = np.flatnonzero(lit[links.head] & open_[links.tail])
            if not len(few):
                break
            if 4 * len(few) < len(links.tail):
                begins = np.flatnonzero(np.diff(links.tail[few], prepend=-1))
                rows = links.tail[few[begins]]
                fresh = np.bitwise_or.reduceat(front[links.head[few]], begins, axis=0) & unseen[rows]
                unseen[rows] ^= fresh
                count = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64)
                hit = count > 0
                front[lit] = 0
                rows, count = rows[hit], count[hit]
                front[rows] = fresh[hit]
                lit[:] = False
                lit[rows] = True
                open_[rows] = unseen[rows].any(axis=1)
            else:
                links.pull(front, stepped, buffer, np.bitwise_or)
                stepped &= unseen
                unseen ^= stepped
                front, stepped = stepped, front
                count = np.bitwise_count(front).sum(axis=1, dtype=np.int64)
                lit = count > 0
                rows, open_ = np.flatnonzero(lit), unseen.any(axis=1)
                count = count[rows]
            if not len(rows):
                break
            found = of_row[rows]
            reached[found] += count
            total[found] += level * count
            farthest[found] = np.maximum(farthest[found], level)
            met, back = np.unique(graphs.graph[found], return_inverse=True)
            sums = np.zeros(len(met), np.int64)
            np.add.at(sums, back, count)
            pairs.append(np.stack([met, np.full(len(met), level), sums]))
    sums = pd.DataFrame({"reached": reached, "total_hops": total, "eccentricity": farthest})
    table = np.concatenate(pairs, axis=1)
    return sums, pd.DataFrame({"graph": table[0], "hops": table[1], "pairs": table[2]})


def dependencies_of(graphs: Numbered, weighted: bool = False) -> np.ndarray:
    """Per node number the summed dependencies of the share's sources on it (Brandes, 2001)."""
    node, peer = _links(graphs, weighted)
    n = len(graphs.ids)
    degree = np.bincount(node, minlength=n)
    begin = np.concatenate([[0], np.cumsum(degree)])[:-1]
    shift = peer - node
    out = np.zeros(n)
    local = np.arange(n) - graphs.first[graphs.component]
    width = np.bincount(graphs.component, minlength=len(graphs.first))[graphs.component]
    # a component of two nodes has no inner node
    sources = np.flatnonzero(_own_blocks(graphs, local, 64) & (width > 2) & (degree > 0))
    ends = np.cumsum(width[sources])
    lo = 0
    while lo < len(sources):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + ROUND_CELLS, side="right")))
        chosen = sources[lo:hi]
        base = ends[lo:hi] - width[chosen] - before
        cells = int(ends[hi - 1] - before)
        paths, level = np.zeros(cells), np.full(cells, -1, np.int32)
        cell, at = base + local[chosen], chosen
        paths[cell], level[cell] = 1.0, 0
        mark = np.empty(cells, np.int64)
        steps = []
        while True:
            fan = degree[at]
            row = np.repeat(np.arange(len(at)), fan)
            arc = np.arange(len(row)) + np.repeat(begin[at] - np.cumsum(fan) + fan, fan)
            source, target = cell[row], cell[row] + shift[arc]
            fresh = np.flatnonzero(level[target] < 0)
            if not len(fresh):
                break
            source, target, arc = source[fresh], target[fresh], arc[fresh]
            np.add.at(paths, target, paths[source])
            level[target] = len(steps) + 1
            mark[target] = np.arange(len(target))
            once = np.flatnonzero(mark[target] == np.arange(len(target)))
            # (cells of the level before, cells they lead to, distinct cells reached, their nodes)
            steps.append((source, target, target[once], peer[arc[once]]))
            cell, at = steps[-1][2], steps[-1][3]
        delta = np.zeros(cells)
        for depth in range(len(steps) - 1, -1, -1):
            source, target, _, _ = steps[depth]
            np.add.at(delta, source, (1.0 + delta[target]) / paths[target] * paths[source])
        # the sources' own cells are of level zero and stay out
        for _, _, cell, at in steps:
            out += np.bincount(at, delta[cell], minlength=n)
        lo = hi
    return out


def heat_of(graphs: Numbered, sources: np.ndarray, expand: Callable[[float], list[float]], tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, node, value) of the rows of e^(-tau L), over the nodes of each source's component; numbers of nodes.

    ``expand`` gives the Chebyshev coefficients of e^(-a (1 + x)) for half of tau times the bound on the eigenvalues.
    """
    n = len(graphs.ids)
    loose = graphs.a != graphs.b
    a, b, w = graphs.a[loose], graphs.b[loose], graphs.weight[loose]
    node, peer, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(graphs.component[node], kind="stable")
    node, peer, w = node[order], peer[order], w[order]
    degree = np.bincount(node, w, minlength=n)
    top = float((degree[node] + degree[peer]).max()) if len(node) else 0.0
    scale = 2.0 / top if top else 0.0
    coefficients = expand(tau * top / 2)
    fan = np.bincount(graphs.component[node], minlength=len(graphs.first))
    begin = np.cumsum(fan) - fan
    part = graphs.component[sources]
    ends = np.cumsum(np.maximum(graphs.size[part], fan[part]))
    found, lo = [], 0
    while lo < len(sources):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + ROUND_CELLS, side="right")))
        own, at = part[lo:hi], sources[lo:hi]
        width = graphs.size[own]
        base = np.cumsum(width) - width
        # cell of a source and a node: the source's base and the node's place in the component
        offset = base - graphs.first[own]
        cells = np.arange(int(width.sum())) - np.repeat(offset, width)
        arc = np.arange(int(fan[own].sum())) + np.repeat(begin[own] - np.cumsum(fan[own]) + fan[own], fan[own])
        here, there = (x[arc] + np.repeat(offset, fan[own]) for x in (node, peer))
        off, diagonal = -scale * w[arc], scale * degree[cells] - 1.0
        t, last = np.zeros(len(cells)), np.zeros(len(cells))
        t[offset + at] = 1.0
        value = coefficients[0] * t
        for k, c in enumerate(coefficients[1:]):
            pulled = np.bincount(here, off * t[there], minlength=len(cells)) + diagonal * t
            t, last = pulled if k == 0 else 2.0 * pulled - last, t
            value += c * t
        found.append((np.repeat(at, width), cells, value))
        lo = hi
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty.astype(float))


class HeatBlock:
    """Columns of e^(-tau L) of one component by Chebyshev terms, a block of them at a time and no matrix.

    ``node``, ``peer`` and ``weight`` are the links in both directions, numbered from zero; weights are not negative.
    """

    def __init__(self, n: int, node: np.ndarray, peer: np.ndarray, weight: np.ndarray, coefficients: list[float], top: float):
        scale = 2.0 / top
        even = bool((weight == weight[0]).all())
        self.n, self.coefficients = n, coefficients
        self.links = Slabs(n, node, peer, None if even else -scale * weight)
        self.factor = -scale * weight[0] if even else 1.0
        self.diagonal = (scale * np.bincount(node, weight, minlength=n) - 1.0)[self.links.order][:, None]
        self.columns = max(1, min(n, BLOCK_CELLS // n))

    def _terms(self, lo: int, hi: int, count: int) -> Iterator[np.ndarray]:
        """The first ``count`` Chebyshev polynomials of the scaled Laplacian on the unit vectors of nodes ``lo`` to ``hi``."""
        last, t, step, buffer = (np.zeros((self.n, hi - lo)) for _ in range(4))
        t[self.links.place[lo:hi], np.arange(hi - lo)] = 1.0
        yield t
        for k in range(1, count):
            self.links.pull(t, step, buffer)
            step *= self.factor
            np.multiply(t, self.diagonal, out=buffer)
            step += buffer
            if k > 1:
                step *= 2.0
                step -= last
            last, t, step = t, step, last
            yield t

    def trace(self) -> float:
        """Products of two terms give those of twice the degree, so half of the terms will do."""
        whole = len(self.coefficients)
        moments = np.zeros(whole + 2)
        for lo in range(0, self.n, self.columns):
            before = None
            for k, t in enumerate(self._terms(lo, min(lo + self.columns, self.n), whole // 2 + 1)):
                if k:
                    moments[2 * k - 1] += np.vdot(before, t)
                moments[2 * k] += np.vdot(t, t)
                before = t
        # 2 T_j T_k = T_(j + k) + T_(j - k)
        moments[2::2] = 2 * moments[2::2] - moments[0]
        moments[3::2] = 2 * moments[3::2] - moments[1]
        return float(np.dot(self.coefficients, moments[:whole]))

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first node, values) of blocks of rows, which are the columns."""
        for lo in range(0, self.n, self.columns):
            hi = min(lo + self.columns, self.n)
            value, buffer = np.zeros((self.n, hi - lo)), np.empty((self.n, hi - lo))
            for c, t in zip(self.coefficients, self._terms(lo, hi, len(self.coefficients))):
                np.multiply(t, c, out=buffer)
                value += buffer
            yield lo, np.ascontiguousarray(value[self.links.place].T)


def heat_blocks(graphs: Numbered, tau: float, expand: Callable[[float], list[float]]) -> dict[int, HeatBlock]:
    """By number, the components whose columns of e^(-tau L) take less work by terms than by eigenvectors."""
    if not tau > 0 or not (graphs.weight >= 0).all() or not np.isfinite(graphs.weight).all():
        return {}
    live = (graphs.a != graphs.b) & (graphs.weight > 0)
    a, b, w = graphs.a[live], graphs.b[live], graphs.weight[live]
    node, peer, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    degree = np.bincount(node, w, minlength=len(graphs.ids))
    order = np.argsort(graphs.component[node], kind="stable")
    node, peer, w = node[order], peer[order], w[order]
    links = np.bincount(graphs.component[node], minlength=len(graphs.size))
    ends = np.cumsum(links)
    out = {}
    for part in np.flatnonzero((links > 0) & (TERM_COST * links < graphs.size.astype(float) ** 2)):
        rows = slice(ends[part] - links[part], ends[part])
        top = float((degree[node[rows]] + degree[peer[rows]]).max())
        coefficients = expand(tau * top / 2)
        n = int(graphs.size[part])
        if TERM_COST * len(coefficients) * links[part] < n * n:
            out[int(part)] = HeatBlock(n, node[rows] - graphs.first[part], peer[rows] - graphs.first[part], w[rows], coefficients, top)
    return out


def triangles_of(graphs: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Degree and triangles per node number: wedges of arcs from lower to higher degree that an edge closes."""
    n = len(graphs.ids)
    a, b = graphs.a, graphs.b
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    forward = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
    u, v = np.where(forward, a, b), np.where(forward, b, a)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    closing = np.sort(a * n + b)
    fan = np.cumsum(np.bincount(u, minlength=n))[u] - np.arange(len(u)) - 1
    ends = np.cumsum(fan)
    out, lo = np.zeros(n, np.int64), 0
    while lo < len(u):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + ROUND_CELLS, side="right")))
        first = np.repeat(np.arange(lo, hi), fan[lo:hi])
        second = first + 1 + np.arange(len(first)) - np.repeat(ends[lo:hi] - fan[lo:hi] - before, fan[lo:hi])
        apart = v[first] < v[second]
        first, second = first[apart], second[apart]
        code = v[first] * n + v[second]
        times = np.searchsorted(closing, code, side="right") - np.searchsorted(closing, code)
        hit = np.flatnonzero(times)
        for node in (u[first], v[first], v[second]):
            out += np.bincount(node[hit], times[hit], n).astype(np.int64)
        lo = hi
    return degree, out


def core_of(graphs: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Whether each node, and each edge, is left when nodes of degree one go until there are none.

    A node holds the exclusive or of its edges' numbers, which for a leaf is that of its only edge.
    """
    n = len(graphs.ids)
    a, b = graphs.a, graphs.b
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    held = np.zeros(n, np.int64)
    for end in (a, b):
        np.bitwise_xor.at(held, end, np.arange(len(a)))
    node, edge = np.ones(n, bool), np.ones(len(a), bool)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        node[leaves] = False
        cut = np.unique(held[leaves])
        edge[cut] = False
        for end in (a[cut], b[cut]):
            np.subtract.at(degree, end, 1)
            np.bitwise_xor.at(held, end, cut)
        ends = np.unique(np.concatenate([a[cut], b[cut]]))
        leaves = ends[degree[ends] == 1]
    return node, edge


def rows_of(graphs: Numbered, by: list[str], columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per node: key, node id and the given columns."""
    out = graphs.keys[by].iloc[graphs.graph].reset_index(drop=True)
    out["node"] = graphs.ids
    for name, values in columns.items():
        out[name] = values
    return out
