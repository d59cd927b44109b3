import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, components, paths, spectral, structure, tables
from graphloom.operators.blocks import whole_groups

from . import graphs as g


def by_graph(df, value):
    out = {}
    for row in df.collect():
        out.setdefault(row["graph_id"], {})[row["node"]] = row[value]
    return out


def test_sizes_and_degrees(spark):
    df = g.frame(spark)
    sizes = {r["graph_id"]: (r["n"], r["m"]) for r in tables.graph_size(df).collect()}
    for k, edges in g.GRAPHS.items():
        assert sizes[k] == (len(g.neighbours(edges)), len(edges))
    degrees = by_graph(tables.degree(df), "degree")
    assert degrees == {k: {v: len(n) for v, n in g.neighbours(e).items()} for k, e in g.GRAPHS.items()}


def test_self_loop_counts_twice(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], g.EDGE)
    assert by_graph(tables.degree(df), "degree") == {1: {0: 3, 1: 1}}
    assert tables.graph_size(df).first()["m"] == 2


def test_isolated_nodes_have_degree_zero(spark):
    df = spark.createDataFrame([(1, 0, 1)], g.EDGE)
    nodes = spark.createDataFrame([(1, 0), (1, 1), (1, 9)], "graph_id long, node long")
    assert by_graph(tables.degree(df, nodes=nodes), "degree") == {1: {0: 1, 1: 1, 9: 0}}


def test_degree_rank_splits_long_runs(spark):
    df = g.frame(spark, {1: g.star(40)})
    ranked = tables.degree_rank(tables.degree(df), chunk=7).orderBy("rank").collect()
    assert [r["degree"] for r in ranked] == [39] + [1] * 39
    assert [r["rank"] for r in ranked] == list(range(1, 41))


def test_two_core(spark):
    tailed = g.clique(4) + [(3, 10), (10, 11), (11, 12)]
    nodes, core = tables.two_core(g.frame(spark, {1: tailed, 2: g.path(5), 3: g.star(5)}))
    assert {(r["graph_id"], r["src"], r["dst"]) for r in core.collect()} == {(1, a, b) for a, b in g.clique(4)}
    left = {(r["graph_id"], r["node"]) for r in nodes.collect()}
    # the middle of an odd path and the hub of a star end up with degree 0 and stay
    assert left == {(1, v) for v in range(4)} | {(2, 2), (3, 0)}


def test_components(spark):
    long = {7: g.path(300), 8: [(a + 500, b + 500) for a, b in g.lattice(9, 9)] + [(1, 2)]}
    every = {**g.GRAPHS, **long}
    labels = by_graph(components.connected_components(g.frame(spark, every)), "component")
    assert labels == {k: g.components(e) for k, e in every.items()}


def test_components_in_tasks_and_by_joins(spark):
    """Graphs up to the limit need no rounds; larger ones, and those with nulls, have the same rows as ever."""
    every = {**g.GRAPHS, 7: g.path(60), 8: [(5, 5), (1, 2), (2, 1), (9, 1)]}
    df = g.frame(spark, every)
    nulls = spark.createDataFrame([(90, 1, None), (90, 1, 2), (None, 1, 2), (91, -3, 4)], g.EDGE)
    whole = {(k, v, c) for k, e in every.items() for v, c in g.components(e).items()}
    given = df.unionByName(nulls)
    by_joins = {tuple(r) for r in components.connected_components(given, task_edges=0).collect()}
    assert whole < by_joins
    for limit in (20, 1 << 20):
        got = components.connected_components(given, task_edges=limit)
        assert {tuple(r) for r in got.collect()} == by_joins and got.count() == len(by_joins)
    lone = spark.createDataFrame([(7, 1000), (500, 3)], "graph_id long, node long")
    more = {tuple(r) for r in components.connected_components(df, nodes=lone).collect()}
    assert more == whole | {(7, 1000, 1000), (500, 3, 3)}


def test_contracted_edges_join_the_same_nodes(spark):
    every = {1: g.path(300), 2: g.lattice(9, 9), 3: [(5, 5), (1, 2), (2, 1)]}
    for rows in (7, 1000):
        df = components.contract_edges(g.frame(spark, every).coalesce(1), rows=rows)
        got = {}
        for r in df.collect():
            got.setdefault(r["graph_id"], []).append((r["src"], r["dst"]))
        assert {k: g.components(e) for k, e in got.items()} == {1: g.components(every[1]), 2: g.components(every[2]), 3: {1: 1, 2: 1}}
        assert sum(map(len, got.values())) < sum(map(len, every.values()))
    no_key = spark.createDataFrame([(3, 4), (4, 5), (None, 4), (8, 9), (9, 3)], "src long, dst long")
    assert sorted(tuple(r) for r in components.contract_edges(no_key.coalesce(1), None).collect())[:1] == [(3, 4)]
    two = spark.createDataFrame([("a", 1, 3, 4), ("a", None, 4, 5), ("b", 1, 4, 3)], "c string, k long, src long, dst long")
    assert sorted(tuple(r) for r in components.contract_edges(two, ["c", "k"]).collect()) == [("a", 1, 3, 4), ("b", 1, 3, 4)]
    labels = {(r["c"], r["k"], r["node"]): r["component"] for r in components.connected_components(two, ["c", "k"]).collect()}
    assert labels == {("a", 1, 3): 3, ("a", 1, 4): 3, ("b", 1, 3): 3, ("b", 1, 4): 3}


def test_component_of_loop_only_node(spark):
    df = spark.createDataFrame([(1, 5, 5), (1, 1, 2)], g.EDGE)
    labels = by_graph(components.connected_components(df), "component")
    assert labels == {1: {1: 1, 2: 1, 5: 5}}
    assert components.component_count(components.connected_components(df)).first()["n_components"] == 1


def test_largest_component(spark):
    df = g.frame(spark, {1: g.path(3) + [(10, 11), (11, 12), (12, 13)]})
    kept = {(r["src"], r["dst"]) for r in components.largest_component_edges(df).collect()}
    assert kept == {(10, 11), (11, 12), (12, 13)}


def test_triangles_and_clustering(spark):
    df = g.frame(spark)
    got = by_graph(structure.clustering_coefficient(df), "clustering")
    for k, edges in g.GRAPHS.items():
        near = g.neighbours(edges)
        for v, n in near.items():
            links = sum(1 for a in n for b in n if a < b and b in near[a])
            want = 2 * links / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0
            assert got[k][v] == pytest.approx(want)


def test_hop_counts_match_bfs(spark):
    df = g.frame(spark)
    sources = tables.endpoints(df).select("graph_id", F.col("node").alias("source")).distinct()
    got = {}
    for r in paths.hop_counts(df, sources).collect():
        got.setdefault(r["graph_id"], {}).setdefault(r["source"], {})[r["node"]] = r["hops"]
    assert got == {k: g.all_hops(e) for k, e in g.GRAPHS.items()}


@pytest.mark.parametrize("form", ["", "_joins"])
def test_path_statistics(spark, form):
    df = g.frame(spark)
    sums, histogram = getattr(paths, f"path_sums{form}"), getattr(paths, f"path_length_histogram{form}")
    avg = {r["graph_id"]: r for r in paths.average_shortest_path(sums(df)).collect()}
    for k, edges in g.GRAPHS.items():
        hops = g.all_hops(edges)
        shares = [sum(h.values()) / (len(h) - 1) for h in hops.values() if len(h) > 1]
        assert avg[k]["avg_path"] == pytest.approx(sum(shares) / len(shares))
        assert avg[k]["diameter"] == max(max(h.values()) for h in hops.values())
    hist = {}
    for r in histogram(df).collect():
        hist.setdefault(r["graph_id"], {})[r["hops"]] = r["pairs"]
    for k, edges in g.GRAPHS.items():
        want = {}
        for h in g.all_hops(edges).values():
            for d in h.values():
                want[d] = want.get(d, 0) + 1
        assert hist[k] == want


@pytest.mark.parametrize("form", ["betweenness", "betweenness_joins"])
def test_betweenness(spark, form):
    got = by_graph(getattr(paths, form)(g.frame(spark)), "betweenness")
    for k, edges in g.GRAPHS.items():
        want = g.betweenness(edges)
        assert got[k].keys() == want.keys()
        for v, b in want.items():
            assert got[k][v] == pytest.approx(b, abs=1e-12)


def test_spectrum(spark):
    got = {r["graph_id"]: r["lambdas"] for r in spectral.laplacian_spectrum(g.frame(spark)).collect()}
    for k, edges in g.GRAPHS.items():
        assert np.allclose(got[k], np.linalg.eigvalsh(g.laplacian(edges)[1]), atol=1e-9)


def test_entropy_limits(spark):
    spec = spectral.laplacian_spectrum(g.frame(spark))
    rows = spectral.spectral_entropy(spec, [0.0, 0.1, 1.0, 10.0, 1e6]).collect()
    for r in rows:
        edges = g.GRAPHS[r["graph_id"]]
        parts = len(set(g.components(edges).values()))
        assert r["s"][0] == pytest.approx(math.log(r["n"]))
        assert r["s"][-1] == pytest.approx(math.log(parts), abs=1e-6)
        assert all(a >= b - 1e-9 for a, b in zip(r["s"], r["s"][1:]))


def test_quadrature_agrees_with_exact_curve(spark):
    edges = g.lattice(20, 15)
    df = g.frame(spark, {1: edges})
    betas = [0.05, 0.3, 1.0]
    exact = spectral.spectral_entropy(spectral.laplacian_spectrum(df), betas).first()["s"]
    large = spectral.quadrature_spectrum(df, steps=12, probes=6)
    row = large.first()
    assert sum(row["weights"]) == pytest.approx(300)
    approx = spectral.spectral_entropy(large, betas).first()["s"]
    assert np.allclose(exact, approx, atol=0.1)


def test_density_matrix_is_heat_kernel(spark):
    rows = spectral.density_matrix(g.frame(spark, {1: g.lattice(3, 3)}), 0.7).orderBy("place").collect()
    lam, vec = np.linalg.eigh(g.laplacian(g.lattice(3, 3))[1])
    heat = vec @ np.diag(np.exp(-0.7 * lam)) @ vec.T
    assert np.allclose([r["rho"] for r in rows], heat / np.trace(heat))


def test_effective_resistance(spark):
    rows = [(1, 0, 1, 2.0), (1, 1, 2, 3.0), (1, 5, 6, 1.0), (2, 0, 1, 2.0), (2, 1, 2, 2.0), (2, 0, 2, 4.0)]
    df = spark.createDataFrame(rows, f"{g.EDGE}, weight double")
    got = by_graph(spectral.effective_resistance(df, 0), "resistance")
    assert got[1][2] == pytest.approx(5.0) and got[1][5] is None
    # two resistors of 2 in a row beside one of 4
    assert got[2][2] == pytest.approx(2.0)


def test_log_likelihood_of_equal_graphs_is_negative_entropy(spark):
    spec = spectral.laplacian_spectrum(g.frame(spark))
    betas = [0.2, 1.0]
    pairs = spec.select("graph_id", F.col("lambdas").alias("observed"), F.col("lambdas").alias("model"))
    like = {r["graph_id"]: r["log_likelihood"] for r in spectral.log_likelihood(pairs, betas).collect()}
    for r in spec.collect():
        lam = np.array(r["lambdas"])
        for b, value in zip(betas, like[r["graph_id"]]):
            e = np.exp(-b * lam)
            assert value == pytest.approx(-(e * lam).sum() / e.sum() - math.log(e.sum()))


def test_knn_of_star(spark):
    matrix = structure.degree_correlation_matrix(g.frame(spark, {1: g.star(6)}))
    knn = {r["degree"]: r["knn"] for r in structure.degree_correlation_function(matrix).collect()}
    assert knn == {5: 1.0, 1: 5.0}
    dense = structure.degree_correlation_dense(matrix).collect()
    assert len(dense) == 36 and sum(r["p"] for r in dense) == pytest.approx(1.0)


def test_community_detection_finds_cliques(spark):
    two = g.clique(6) + [(a + 6, b + 6) for a, b in g.clique(6)] + [(0, 6)]
    df = g.frame(spark, {1: two, 2: g.random_graph(40, 70, 3)})
    part = community.community_detection(df)
    q = {r["graph_id"]: r["modularity"] for r in structure.modularity(df, part).collect()}
    alone = tables.degree(df).withColumn("community", F.col("node"))
    q0 = {r["graph_id"]: r["modularity"] for r in structure.modularity(df, alone).collect()}
    labels = by_graph(part, "community")[1]
    assert len({labels[v] for v in range(6)}) == 1 and len({labels[v] for v in range(6, 12)}) == 1
    assert q[1] > 0.4 and all(-0.5 <= q[k] <= 1 and q[k] > q0[k] for k in q)


def odd_graphs(spark):
    rows = [(k, *e) for k, edges in g.GRAPHS.items() for e in edges] + [(5, 3, 3), (3, 0, 1), (None, 0, 1), (None, 1, 2), (None, 0, 2), (7, 1, 2)]
    return spark.createDataFrame(rows, g.EDGE)


def test_cores_of_tasks_and_joins_agree(spark):
    df = odd_graphs(spark)
    given = tables.degree(df).select("graph_id", "node").union(spark.sql("select 9L, 1L"))
    for nodes in (None, given):
        inside, mixed = ([sorted(map(str, x.collect())) for x in tables.two_core(df, nodes=nodes, task_edges=m)] for m in (1000, 12))
        assert inside == mixed and len(inside[0]) > 10 and len(inside[1]) > 10


def test_triangles_of_tasks_and_joins_agree(spark):
    inside, mixed = (sorted(map(str, structure.clustering_coefficient(odd_graphs(spark), task_edges=m).collect())) for m in (1000, 12))
    assert inside == mixed and len(inside) > 70
    found = structure.triangles(g.frame(spark, {1: g.clique(5), 2: g.path(4)})).collect()
    assert sorted((r["node"], r["triangles"]) for r in found) == [(v, 6) for v in range(5)]


def test_degree_pairs_of_tasks_and_joins_agree(spark):
    df = odd_graphs(spark).withColumn("corpus", F.col("graph_id") % 2)
    for pool in ("corpus", "graph_id", None):
        inside, mixed = (sorted(map(str, structure.degree_pairs(df, pool=pool, task_edges=m).collect())) for m in (1000, 12))
        assert inside == mixed and len(inside) > 5


def test_link_rows_are_dealt_finer_than_the_shuffle(spark):
    links = spark.range(4000).selectExpr("id div 100000 as graph_id", "id as a", "id + 1 as b", "1.0 as q")
    used = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for weight in (None, F.sum("q")):
        edges = tables.edges_from_table(links, "a", "b", weight=weight)
        assert edges.count() == 4000
        assert edges.select(F.spark_partition_id().alias("p")).distinct().count() > 2 * used


def test_communities_of_tasks_and_joins_agree(spark):
    rows = [(k, a, b, float(1 + (a * b) % 3)) for k, edges in g.GRAPHS.items() for a, b in edges]
    rows += [(5, 3, 3, 2.0), (6, 1, 1, 1.0), (7, 0, 1, None), (None, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "graph_id long, src long, dst long, weight double")
    inside, mixed = (sorted(community.community_detection(df, levels=2, rounds=3, task_edges=m).dropna().collect()) for m in (1000, 12))
    assert len(inside) > 70
    assert inside == mixed


def test_whole_groups_rejoins_batches():
    import pandas as pd

    rows = pd.DataFrame({"k": [1] * 3 + [2] * 5 + [3] + [4] * 4, "v": range(13)})
    for step in (1, 2, 3, 5, 13):
        for least in (1, 4, 100):
            cuts = [rows.iloc[i : i + step] for i in range(0, 13, step)]
            out = list(whole_groups(iter(cuts), ["k"], least))
            assert pd.concat(out)["v"].tolist() == list(range(13))
            assert sum(len(set(f["k"])) for f in out) == 4


def test_large_graph_beside_small_ones(spark):
    star = [(0, i) for i in range(1, 2500)]
    rows = spectral.laplacian_spectrum(g.frame(spark, {1: g.path(9), 2: star})).collect()
    got = {r["graph_id"]: (len(r["lambdas"]), round(sum(r["lambdas"]), 6), round(r["lambdas"][-1], 6)) for r in rows}
    assert got[2] == (2500, 2 * 2499, 2500) and got[1][:2] == (9, 16)


def test_isolated_nodes_add_zeros(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 77), (1, 78), (5, 3)], "graph_id long, node long")
    rows = spectral.laplacian_spectrum(g.frame(spark, {1: g.path(3)}), nodes=nodes).collect()
    got = {r["graph_id"]: (r["n"], [round(x, 6) for x in r["lambdas"]], list(r["weights"])) for r in rows}
    assert got == {1: (5, [0, 0, 0, 1, 3], [1.0] * 5), 5: (1, [0], [1.0])}


def test_centrality_of_a_disconnected_graph_is_null(spark):
    rows = spectral.information_centrality(g.frame(spark, {1: [(0, 1), (2, 3)], 2: g.path(3)})).collect()
    assert all((r["centrality"] is None) == (r["graph_id"] == 1) for r in rows)


def test_candidates_against_the_whole_grid(spark):
    from graphloom.operators.curves import score_candidates

    reference = spark.createDataFrame([(i, float(i)) for i in range(4)], "beta_idx int, s double")
    curves = [("same", i, float(i)) for i in range(4)] + [("part", 1, 1.0)] + [("shifted", i, i + 1.0) for i in range(4)]
    df = spark.createDataFrame(curves, "candidate_id string, beta_idx int, s double")
    every = spark.createDataFrame([("same",), ("part",), ("shifted",), ("none",)], "candidate_id string")
    got = {r[0]: r[1] for r in score_candidates(df, reference, every).collect()}
    assert got == {"same": math.inf, "part": 1 / 13, "shifted": 0.25, "none": 0.0}
    got = {r[0]: r[1] for r in score_candidates(df, reference, every, gradient=True).collect()}
    assert got["same"] == got["shifted"] == math.inf and got["part"] < 1


def test_histogram_of_a_group_outside_the_range(spark):
    from graphloom.operators.histogram import empirical_pdf_cdf

    df = spark.createDataFrame([(1, 0.5), (1, 1.5), (2, 9.0)], "k int, v double")
    rows = empirical_pdf_cdf(df, "v", 2, "k", (0.0, 2.0)).collect()
    assert sorted((r["k"], r["bin"], r["pdf"]) for r in rows) == [(1, 0, 0.5), (1, 1, 0.5), (2, 0, None), (2, 1, None)]


def test_matrices_are_no_larger_than_a_component(spark):
    """Six thousand nodes in components of four: n x n entries would be 288 MB a matrix."""
    rows = [(1, 10 * c, 10 * c + i) for c in range(1500) for i in range(1, 4)]
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long")
    lam = spectral.laplacian_spectrum(edges).first()["lambdas"]
    assert np.allclose(lam, [0.0] * 1500 + [1.0] * 3000 + [4.0] * 1500, atol=1e-9)
    z = 1500 * (1 + 2 * np.exp(-0.5) + np.exp(-2.0))
    rho = spectral.density_matrix(edges, 0.5).collect()
    assert len(rho) == 6000 and all(len(r["rho"]) == 4 and r["component"] == r["node"] // 10 * 10 for r in rho)
    assert all(abs(r["z"] / z - 1) < 1e-9 and abs(sum(r["rho"]) * z - 1) < 1e-6 for r in rho)
    assert abs(sum(r["rho"][r["place"]] for r in rho) - 1) < 1e-9
    res = spectral.edge_resistance(edges.selectExpr("*", "2.0D as weight")).collect()
    assert len(res) == 4500 and all(abs(r["resistance"] - 0.5) < 1e-9 for r in res)


def test_specific_heat_of_graphs_of_several_sizes(spark):
    spec = spectral.laplacian_spectrum(g.frame(spark))
    taus = [0.1, 0.3, 0.4, 1.0, 3.0]
    got = {r["graph_id"]: r["c"] for r in spectral.specific_heat_from_spectrum(spec, taus).collect()}
    for graph, edges in g.GRAPHS.items():
        lam = np.linalg.eigvalsh(g.laplacian(edges)[1])
        mean = [(lam * np.exp(-t * lam)).sum() / np.exp(-t * lam).sum() for t in taus]
        assert np.allclose(got[graph], -np.gradient(mean, taus, edge_order=2) * np.square(taus), atol=1e-9)
