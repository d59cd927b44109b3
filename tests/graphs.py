"""Small graphs with known answers, and brute-force forms to compare with."""

from __future__ import annotations

import itertools
import random
from collections import deque

import numpy as np

EDGE = "graph_id long, src long, dst long"


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def star(n):
    return [(0, i) for i in range(1, n)]


def clique(n):
    return list(itertools.combinations(range(n), 2))


def lattice(w, h):
    right = [(y * w + x, y * w + x + 1) for y in range(h) for x in range(w - 1)]
    down = [(y * w + x, y * w + x + w) for y in range(h - 1) for x in range(w)]
    return right + down


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


GRAPHS = {
    1: path(6),
    2: star(7),
    3: clique(5),
    4: lattice(4, 3),
    5: random_graph(20, 26, 1),
    6: random_graph(30, 24, 2),
}


def frame(spark, graphs=None):
    rows = [(g, a, b) for g, edges in (graphs or GRAPHS).items() for a, b in edges]
    return spark.createDataFrame(rows, EDGE)


def neighbours(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def bfs(near, start):
    hops, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in hops:
                hops[v] = hops[u] + 1
                queue.append(v)
    return hops


def all_hops(edges):
    near = neighbours(edges)
    return {s: bfs(near, s) for s in near}


def components(edges):
    return {s: min(h) for s, h in all_hops(edges).items()}


def laplacian(edges):
    nodes = sorted(neighbours(edges))
    at = {v: i for i, v in enumerate(nodes)}
    lap = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        i, j = at[a], at[b]
        lap[i, i] += 1
        lap[j, j] += 1
        lap[i, j] -= 1
        lap[j, i] -= 1
    return nodes, lap


def betweenness(edges):
    near, hops = neighbours(edges), all_hops(edges)
    n = len(near)

    def count(s, t, memo):
        if s == t:
            return 1
        if (s, t) not in memo:
            memo[s, t] = sum(count(s, u, memo) for u in near[t] if hops[s].get(u) == hops[s][t] - 1)
        return memo[s, t]

    memo, total = {}, dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        if t not in hops[s]:
            continue
        for v in near:
            if v not in (s, t) and v in hops[s] and hops[s][v] + hops[v].get(t, 1 << 30) == hops[s][t]:
                total[v] += count(s, v, memo) * count(v, t, memo) / count(s, t, memo)
    return {v: b / ((n - 1) * (n - 2)) for v, b in total.items()}
