"""Iterations on tables against dense matrices."""

import numpy as np
import pandas as pd
import pytest

from graphloom.operators.iterative import chebyshev_coefficients, heat_kernel_rows, pair_resistance
from graphloom.operators import local_paths, multi_source, paths
from graphloom.operators.blocks import Numbered, stacked
from graphloom.operators.multi_source import by_size, hop_histogram, hop_sums
from graphloom.operators.paths import betweenness, betweenness_joins, path_length_histogram, path_sums
from graphloom.operators.spectral import edge_resistance

EDGES = "graph_id long, src long, dst long, weight double"


def random_graphs(seed=1, sizes=(2, 9, 20), loops=True):
    """Connected and unconnected graphs, parallel edges, loops, and a long path beside them."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        for _ in range(2 * n):
            a, b = rng.integers(0, n, 2).tolist()
            if a != b or loops:
                rows.append((g, a * 7, b * 7, float(rng.integers(1, 6))))
    rows += [(99, i, i + 1, 1.0 + i % 3) for i in range(7)] + [(99, 100, 101, 2.0)]
    return rows


def laplacians(rows):
    """graph -> (node ids, Laplacian without loops)."""
    out = {}
    for g in {r[0] for r in rows}:
        ids = sorted({x for r in rows if r[0] == g for x in r[1:3]})
        at = {x: i for i, x in enumerate(ids)}
        adj = np.zeros((len(ids), len(ids)))
        for _, a, b, w in (r for r in rows if r[0] == g and r[1] != r[2]):
            adj[at[a], at[b]] += w
            adj[at[b], at[a]] += w
        out[g] = ids, np.diag(adj.sum(1)) - adj
    return out


@pytest.fixture(scope="module")
def rows():
    return random_graphs()


@pytest.fixture(scope="module")
def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES).cache()


def test_coefficients_add_up_to_the_exponential():
    for a in (0.0, 0.01, 0.7, 5.0, 60.0, 900.0):
        c = chebyshev_coefficients(a, 1e-12)
        for x in (-1.0, -0.3, 0.4, 1.0):
            assert abs(np.polynomial.chebyshev.chebval(x, c) - np.exp(-a * (1 + x))) < 1e-10, (a, x)


def test_heat_rows_against_matrices(spark, rows, edges):
    dense = laplacians(rows)
    sources = [(g, ids[k]) for g, (ids, _) in dense.items() for k in (0, len(ids) // 2)] + [(5, 77)]
    got = heat_kernel_rows(edges, spark.createDataFrame(sources, "graph_id long, source long"), 0.3).collect()
    found = {(r.graph_id, r.source, r.node): r.value for r in got}
    assert found[5, 77, 77] == pytest.approx(1.0)
    for g, s in sources[:-1]:
        ids, lap = dense[g]
        lam, vec = np.linalg.eigh(lap)
        row = (vec * np.exp(-0.3 * lam)) @ vec[ids.index(s)]
        for node, value in zip(ids, row):
            assert found.get((g, s, node), 0.0) == pytest.approx(value, abs=1e-9)


def test_resistances_against_matrices(spark, rows, edges):
    dense = laplacians(rows)
    pairs, want = [], {}
    for g, (ids, lap) in dense.items():
        plus = np.linalg.pinv(lap)
        joined = np.abs(np.linalg.matrix_power((np.abs(lap) > 0).astype(float) + np.eye(len(ids)), len(ids))) > 0
        for a in range(0, len(ids), 3):
            for b in range(0, len(ids), 5):
                pairs.append((g, ids[a], ids[b]))
                far = plus[a, a] + plus[b, b] - 2 * plus[a, b]
                want[pairs[-1]] = far if joined[a, b] else (0.0 if a == b else None)
    pairs.append((2, -5, 7))
    want[2, -5, 7] = None
    df = spark.createDataFrame(pairs + pairs[:2], "graph_id long, a long, b long")
    got = pair_resistance(edges, df).collect()
    assert len(got) == len(want)
    for r in got:
        value = want[r.graph_id, r.a, r.b]
        assert (r.resistance is None) == (value is None)
        assert value is None or r.resistance == pytest.approx(value, abs=1e-7)


def test_foster_sum_of_a_larger_graph(spark):
    """Over all edges, conductance times resistance adds up to nodes less components."""
    rng = np.random.default_rng(5)
    n = 40
    rows = [(1, i, (i * i + 1) % n, 1.0 + i % 4) for i in range(n)] + [(1, *sorted(rng.integers(0, n, 2).tolist()), 2.0) for _ in range(50)]
    rows = [r for r in rows if r[1] != r[2]] + [(2, 0, 1, 3.0)]
    df = spark.createDataFrame(rows, EDGES)
    got = pair_resistance(df, df.selectExpr("graph_id", "src as a", "dst as b"))
    total = {}
    values = {(r.graph_id, r.a, r.b): r.resistance for r in got.collect()}
    for g, a, b, w in rows:
        total[g] = total.get(g, 0.0) + w * values[g, a, b]
    dense = laplacians(rows)
    for g, (ids, lap) in dense.items():
        assert total[g] == pytest.approx(np.linalg.matrix_rank(lap), abs=1e-5)


def test_hops_in_batches_against_matrices(spark, edges):
    dense = {tuple(r) for r in path_sums(edges).collect()}
    for batch_rows in (10**9, 40):
        assert {tuple(r) for r in hop_sums(edges, batch_rows=batch_rows).collect()} == dense
        assert {tuple(r) for r in hop_histogram(edges, batch_rows=batch_rows).collect()} == {tuple(r) for r in path_length_histogram(edges).collect()}
    alone = spark.createDataFrame([(7, 1), (0, 7)], "graph_id long, node long")
    more = {tuple(r) for r in hop_sums(edges, nodes=alone).collect()}
    assert (7, 1, 0, 0, 0) in more and dense <= more


def test_betweenness_in_batches_against_matrices(spark, edges):
    dense = {(r.graph_id, r.node): r.betweenness for r in betweenness(edges).collect()}
    got = {(r.graph_id, r.node): r.betweenness for r in betweenness_joins(edges, batch_rows=400).collect()}
    assert got.keys() == dense.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in dense.items())


def test_empty_tables(spark):
    none = spark.createDataFrame([], EDGES)
    assert hop_sums(none).collect() == [] and hop_histogram(none).collect() == []
    assert pair_resistance(none, spark.createDataFrame([], "graph_id long, a long, b long")).collect() == []
    assert heat_kernel_rows(none, spark.createDataFrame([], "graph_id long, source long"), 1.0).collect() == []


def test_graphs_by_joins_and_in_tasks_give_the_same(spark, edges):
    """A mix of the form by joins and the form in tasks, against matrices."""
    more = edges.unionByName(spark.createDataFrame([(50, i, (i * i + 3) % 150, 1.0) for i in range(150)], EDGES)).cache()
    sums = {tuple(r) for r in path_sums(more).collect()}
    pairs = {tuple(r) for r in path_length_histogram(more).collect()}
    dense = {(r.graph_id, r.node): r.betweenness for r in betweenness(more).collect()}
    for edges_, task_edges in ((more, 1 << 20), (edges, 30)):
        graphs = {r.graph_id for r in edges_.select("graph_id").distinct().collect()}
        assert {tuple(r) for r in hop_sums(edges_, task_edges=task_edges).collect()} == {r for r in sums if r[0] in graphs}
        assert {tuple(r) for r in hop_histogram(edges_, task_edges=task_edges).collect()} == {r for r in pairs if r[0] in graphs}
        got = {(r.graph_id, r.node): r.betweenness for r in betweenness_joins(edges_, task_edges=task_edges).collect()}
        assert got.keys() == {k for k in dense if k[0] in graphs}
        assert all(got[k] == pytest.approx(dense[k], abs=1e-9) for k in got)


def test_sources_shared_by_tasks(spark, edges, monkeypatch):
    more = edges.unionByName(spark.createDataFrame([(50, i, (i * i + 3) % 150, 1.0) for i in range(150)], EDGES)).cache()
    small, large = by_size(more, "graph_id", 1 << 20, 20)
    assert large is None and small.count() > more.count()
    monkeypatch.setattr(local_paths, "ROUND_CELLS", 64)
    monkeypatch.setattr(multi_source, "by_size", lambda *a: (small, None))
    monkeypatch.setattr(paths, "by_size", lambda *a: (small, None))
    assert {tuple(r) for r in hop_sums(more).collect()} == {tuple(r) for r in path_sums(more).collect()}
    assert {tuple(r) for r in hop_histogram(more).collect()} == {tuple(r) for r in path_length_histogram(more).collect()}
    dense = {(r.graph_id, r.node): r.betweenness for r in betweenness(more).collect()}
    got = {(r.graph_id, r.node): r.betweenness for r in betweenness_joins(more).collect()}
    assert got.keys() == dense.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in dense.items())


def test_many_graphs_are_not_copied(spark):
    """Shares are for few large graphs: where there are more graphs than tasks, each edge is dealt once."""
    many = spark.range(64 * 300).selectExpr("id % 64 AS graph_id", "id AS src", "id + 64 AS dst")
    small, large = by_size(many, "graph_id", 1 << 20, 20)
    assert large is None and small.count() == many.count()
    one, _ = by_size(many.where("graph_id = 0"), "graph_id", 1 << 20, 20)
    assert one.count() == 300 * 15


def test_many_components_make_no_matrix(spark):
    """Three thousand stars in one graph: n x n entries would be 1.8 GB."""
    star = [(1, 10 * c, 10 * c + i) for c in range(3000) for i in range(1, 5)]
    df = spark.createDataFrame(star, "graph_id long, src long, dst long")
    far = {r.node: (r.reached, r.total_hops, r.eccentricity) for r in hop_sums(df).collect()}
    assert far[0] == (4, 4, 1) and far[29991] == (4, 7, 2) and len(far) == 15000
    hub = 12 / (14999 * 14998)
    for got in (betweenness(df), betweenness_joins(df)):
        value = {r.node: r.betweenness for r in got.collect()}
        assert value[0] == pytest.approx(hub) and value[1] == 0.0 and len(value) == 15000


def test_no_key_and_null_key(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")
    assert {tuple(r) for r in hop_sums(df, key=None).collect()} == {(1, 2, 3, 2), (2, 2, 2, 1), (3, 2, 3, 2), (4, 1, 1, 1), (5, 1, 1, 1)}
    null = spark.createDataFrame([(None, 1, 2), (7, 1, 2)], "graph_id long, src long, dst long")
    assert {tuple(r) for r in hop_sums(null).collect()} == {(None, 1, 0, 0, 0), (None, 2, 0, 0, 0), (7, 1, 1, 1, 1), (7, 2, 1, 1, 1)}
    assert {tuple(r)[:2] for r in betweenness_joins(null).collect()} == {(7, 1), (7, 2)}


def test_heat_rows_by_joins_and_in_tasks(spark, rows, edges):
    """Graphs above the limit by joins, the others in the tasks, both against matrices."""
    dense = laplacians(rows)
    sources = [(g, ids[k]) for g, (ids, _) in dense.items() for k in (0, len(ids) // 2)] + [(5, 77)]
    df = spark.createDataFrame(sources, "graph_id long, source long")
    got = heat_kernel_rows(edges, df, 0.3, task_edges=20).collect()
    found = {(r.graph_id, r.source, r.node): r.value for r in got}
    assert len(found) == len(got) and found[5, 77, 77] == pytest.approx(1.0)
    for g, s in sources[:-1]:
        ids, lap = dense[g]
        lam, vec = np.linalg.eigh(lap)
        row = (vec * np.exp(-0.3 * lam)) @ vec[ids.index(s)]
        for node, value in zip(ids, row):
            assert found.get((g, s, node), 0.0) == pytest.approx(value, abs=1e-9)


def test_null_nodes_stand_alone(spark):
    """A null for a node is a node without links, as in the form by joins; other graphs are not touched."""
    df = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, None), (2, 0, 1), (2, 0, 2)], "graph_id long, src long, dst long")
    got = {(r.graph_id, r.node): r.betweenness for r in betweenness_joins(df).collect()}
    assert got == {(1, 0): pytest.approx(1 / 3), (1, 1): 0.0, (1, 2): 0.0, (1, None): 0.0, (2, 0): 1.0, (2, 1): 0.0, (2, 2): 0.0}
    rows = heat_kernel_rows(df, spark.createDataFrame([(1, 0), (2, 0)], "graph_id long, source long"), 0.5).collect()
    found = {(r.graph_id, r.node): r.value for r in rows}
    assert found.keys() == {(g, n) for g in (1, 2) for n in (0, 1, 2)}
    assert all(found[1, n] == pytest.approx(found[2, n], abs=1e-9) for n in range(3))


def test_resistances_of_a_graph_with_a_null_weight_are_null(spark):
    df = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 2, None), (2, 0, 1, 2.0), (2, 5, 6, 4.0)], EDGES)
    got = {(r.graph_id, r.src): r.resistance for r in edge_resistance(df).collect()}
    assert got[1, 0] is None and got[1, 1] is None
    assert got[2, 0] == pytest.approx(0.5) and got[2, 5] == pytest.approx(0.25)


def _numbered(*links, **keys):
    frame = pd.concat([pd.DataFrame({"graph_id": g, "src": a, "dst": b}) for g, a, b in links], ignore_index=True)
    return Numbered(frame.assign(**keys), ["graph_id", *keys])


def test_shares_do_not_depend_on_the_frame(monkeypatch):
    """A share's sources are the same whatever other graphs its task holds."""
    monkeypatch.setattr(local_paths, "ROUND_CELLS", 20_000)
    path, other = (1, np.arange(1499), np.arange(1, 1500)), (2, np.arange(3000), np.arange(1, 3001))
    whole, table = local_paths.hops_of(_numbered(path))
    first, some = local_paths.hops_of(_numbered(path, _share=0, _shares=2))
    second, more = local_paths.hops_of(_numbered(path, other, _share=1, _shares=2))
    for c in ("reached", "total_hops"):
        assert (first[c] + second[c][:1500] == whole[c]).all()
    pairs = pd.concat([some, more[more["graph"] == 0]]).groupby("hops")["pairs"].sum()
    assert pairs.to_dict() == table.groupby("hops")["pairs"].sum().to_dict()


def test_hops_past_the_slabs():
    """Hubs of more neighbours than slabs, levels of few and of many links, loops, and components of all sizes."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 700), rng.integers(0, 400, 700)
    a[:80] = 0
    graphs = _numbered((1, a, b), (2, np.arange(90), np.arange(1, 91)), (3, np.array([5]), np.array([5])))
    sums, table = local_paths.hops_of(graphs)
    n = len(graphs.ids)
    link = np.eye(n)
    link[graphs.a, graphs.b] = link[graphs.b, graphs.a] = 1
    hops, reach = np.where(np.eye(n) > 0, 0, -1), np.eye(n)
    for level in range(1, n):
        reach = (reach @ link > 0).astype(float)
        if not ((reach > 0) & (hops < 0)).any():
            break
        hops[(reach > 0) & (hops < 0)] = level
    assert (sums["reached"] == (hops > 0).sum(axis=1)).all() and (sums["eccentricity"] == hops.max(axis=1)).all()
    assert (sums["total_hops"] == np.maximum(hops, 0).sum(axis=1)).all()
    for (graph, level), pairs in table.groupby(["graph", "hops"])["pairs"].sum().items():
        assert pairs == (hops[graphs.graph == graph] == level).sum()


def test_density_of_a_large_component_by_terms(monkeypatch):
    """Columns and trace of a sparse component without eigenvectors, in several blocks."""
    monkeypatch.setattr(local_paths, "BLOCK_CELLS", 5000)
    rng = np.random.default_rng(4)
    a, b = np.concatenate([np.arange(599), rng.integers(0, 600, 60)]), np.concatenate([np.arange(1, 600), rng.integers(0, 600, 60)])
    a[600:650] = 0
    for weight in (np.ones(659), rng.random(659) * 2):
        graphs = _numbered((1, a, b), (2, np.array([1]), np.array([2])))
        graphs.weight[:659] = weight
        blocks = local_paths.heat_blocks(graphs, 0.5, lambda x: chebyshev_coefficients(x, 1e-14))
        assert list(blocks) == [0]
        lap = next(s for s in stacked(graphs, np.array([0]))).laplacian()[0]
        lam, vec = np.linalg.eigh(lap)
        heat = (vec * np.exp(-0.5 * lam)) @ vec.T
        assert np.abs(np.concatenate([rows for _, rows in blocks[0].rows()]) - heat).max() < 1e-12
        assert blocks[0].trace() == pytest.approx(np.trace(heat), rel=1e-12)
