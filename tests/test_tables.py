import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import curves, features, histogram, runs, scaling
from graphloom.sources import files, graphml, paths
from graphloom.staging import with_row_index
from graphloom.streaming.incremental import process_new_files


def column(spark, values, key=None):
    if key is None:
        return spark.createDataFrame([(float(v),) for v in values], "v double")
    return spark.createDataFrame([(key, float(v)) for v in values], "k long, v double")


@pytest.mark.parametrize("bins", [1, 7, 100])
def test_histogram_is_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    values = np.round(rng.normal(size=400), 1)  # many values on bin edges
    rows = histogram.empirical_pdf_cdf(column(spark, values), "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n"] for r in rows] == counts.tolist()
    assert np.allclose([r["left_edge"] for r in rows] + [rows[-1]["right_edge"]], edges)
    assert rows[0]["cdf_left"] == 0 and rows[-1]["cdf"] == pytest.approx(1)


def test_histogram_of_one_value(spark):
    rows = histogram.empirical_pdf_cdf(column(spark, [3, 3, 3]), "v", 4).orderBy("bin").collect()
    counts, edges = np.histogram([3, 3, 3], bins=4)
    assert [r["n"] for r in rows] == counts.tolist() and rows[0]["left_edge"] == edges[0]


def test_percentiles_by_window_and_by_narrowing(spark):
    rng = random.Random(2)
    rows = [(1, rng.expovariate(1)) for _ in range(3000)] + [(2, float(rng.randint(0, 5))) for _ in range(400)] + [(3, 8.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    shares = [0.0, 0.02, 0.5, 0.99, 1.0]
    for limit in (1_000_000, 20):
        got = {
            (r["k"], r["share"]): r["value"]
            for r in scaling.exact_percentiles(df, "v", shares, "k", window_rows=limit, buckets=8).collect()
        }
        for k in (1, 2, 3):
            data = [v for g, v in rows if g == k]
            for s in shares:
                assert got[k, s] == pytest.approx(np.percentile(data, 100 * s), abs=1e-12)


def test_scale_and_uint8(spark):
    values = [3.0, 7.0, 11.5]
    out = scaling.minmax_scale(column(spark, values), "v", -1, 1).orderBy("v").collect()
    assert [r["v"] for r in out] == pytest.approx([-1, 2 * (4 / 8.5) - 1, 1])
    gray = [r["v"] for r in scaling.to_uint8(column(spark, values), "v").orderBy(F.desc("v")).collect()]
    assert gray == [255, 255 - int(4 / 8.5 * 255.9), 0]


def test_gradient_is_numpy(spark):
    rng = random.Random(3)
    x = sorted(rng.uniform(0, 9) for _ in range(25))
    y = [math.sin(v) for v in x]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(x, y))], "k long, i long, x double, y double")
    for order in (1, 2):
        got = [r["gradient"] for r in curves.gradient(df, "y", "i", "k", "x", order).orderBy("i").collect()]
        assert np.allclose(got, np.gradient(y, x, edge_order=order))
        got = [r["gradient"] for r in curves.gradient(df, "y", "i", "k", edge_order=order).orderBy("i").collect()]
        assert np.allclose(got, np.gradient(y, edge_order=order))


def test_prune_threshold(spark):
    rng = np.random.default_rng(6)
    w = rng.exponential(size=300)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(w)], "graph_id long, src long, dst long, weight double")
    shares = [0.0, 0.3, 0.8]
    kept = {r["share"]: r["n"] for r in histogram.prune_edges(df, shares).groupBy("share").agg(F.count("*").alias("n")).collect()}
    counts, edges = np.histogram(w, bins=100)
    cdf = np.concatenate([[0], np.cumsum(counts / counts.sum())])
    for s in shares:
        below = edges[cdf < s]
        assert kept[s] == (w > (below[-1] if len(below) else 0)).sum()


def test_otsu_splits_two_levels(spark):
    df = spark.createDataFrame([(1, v) for v in [10] * 50 + [12] * 40 + [200] * 30 + [210] * 10], "image_id long, v long")
    assert histogram.otsu_threshold(df, "v", "image_id").first()["threshold"] == 12


def test_reduce_spikes(spark):
    a = [0.1, 0.9, 0.2, 0.3]
    want = list(a)
    for _ in range(2):
        i = int(np.argmax(want))
        want[i] = (want[-2] + want[0]) / 2 if i == len(want) - 1 else (want[i - 1] + want[i + 1]) / 2
    df = spark.createDataFrame([(a,)], "a array<double>")
    assert df.select(scalars.reduce_spikes(F.col("a"), 2)).first()[0] == pytest.approx(want)


def test_chi2_of_arrays(spark):
    df = spark.createDataFrame([([0.2, 0.8, 0.0], [0.5, 0.5, 0.0])], "p array<double>, q array<double>")
    want = 0.5 * (0.09 / 0.7 + 0.09 / 1.3)
    assert df.select(scalars.chi2_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(want)


def test_moving_average_array(spark):
    a = [1.0, 2.0, 6.0, 4.0, 9.0]
    df = spark.createDataFrame([(a,)], "a array<double>")
    got = df.select(scalars.moving_average_array(F.col("a"), 3)).first()[0]
    assert got == pytest.approx(np.convolve([a[-1], *a, a[0]], np.ones(3) / 3, mode="valid"))


def test_mixture_recovers_two_peaks(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 800), rng.normal(9, 0.5, 400)])
    rows = runs.gaussian_mixture_1d(column(spark, values, 1), "v", 2, "k").orderBy("peak").collect()
    assert [r["mean"] for r in rows] == pytest.approx([0, 9], abs=0.2)
    assert [r["weight"] for r in rows] == pytest.approx([2 / 3, 1 / 3], abs=0.05)
    assert [math.sqrt(r["variance"]) for r in rows] == pytest.approx([1, 0.5], abs=0.1)


def test_saturation(spark):
    best = [(1, g, f) for g, f in enumerate([1, 5, 5, 5, 5, 9])] + [(2, g, float(g)) for g in range(6)]
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in best], "run_id long, generation long, fitness double")
    got = {r["run_id"]: r["saturated_at"] for r in runs.saturation(df, 3).collect()}
    assert got == {1: 4, 2: None}


def test_pearson_p_value(spark):
    # values of the two-sided t-test known in closed form: df = 1 and df = 2
    df = spark.createDataFrame(
        [(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 0.5)] + [(2, 0.0, 0.0), (2, 1.0, 2.0), (2, 2.0, 1.0), (2, 3.0, 3.0)],
        "k long, x double, y double",
    )
    for r in features.pearson(df, "x", "y", "k").collect():
        c = r["corr"]
        t = abs(c) * math.sqrt((r["n"] - 2) / (1 - c * c))
        want = 1 - 2 / math.pi * math.atan(t) if r["n"] == 3 else 1 - t / math.sqrt(2 + t * t)
        assert r["p_value"] == pytest.approx(want, rel=1e-8)


def test_row_index_is_dense_and_sorted(spark):
    df = spark.range(997).select((F.col("id") * 7919 % 997).alias("v"))
    rows = with_row_index(df, ["v"]).collect()
    assert {(r["idx"], r["v"]) for r in rows} == {(i, i) for i in range(997)}


def test_boxcox_normalises(spark):
    rng = np.random.default_rng(4)
    w = rng.lognormal(0, 0.8, 400)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(w)], "graph_id long, src long, dst long, weight double")
    out = np.array([r["weight"] for r in scaling.boxcox_rescale(df).collect()])
    skew = lambda a: (((a - a.mean()) / a.std()) ** 3).mean()
    assert out.min() == pytest.approx(1e-4) and out.max() == pytest.approx(1)
    assert abs(skew(out)) < 0.3 < abs(skew(w))


def test_random_walks_follow_edges(spark):
    from . import graphs as g

    walks = features.random_walks(g.frame(spark, {1: g.lattice(4, 3), 2: g.star(6)}), length=8, walks=3)
    rows = walks.collect()
    assert len(rows) == 3 * (12 + 6)
    near = {1: g.neighbours(g.lattice(4, 3)), 2: g.neighbours(g.star(6))}
    for r in rows:
        assert len(r["path"]) == 8 and r["path"][0] == r["start"]
        assert all(b in near[r["graph_id"]][a] for a, b in zip(r["path"], r["path"][1:]))


def test_random_walks_of_tasks_and_joins_agree(spark):
    from . import graphs as g

    rows = [(k, *e) for k, edges in g.GRAPHS.items() for e in edges] + [(1, 0, 1), (2, 3, 3), (None, 0, 1), (2, None, 1)]
    df = spark.createDataFrame(rows, g.EDGE)
    inside, joined, mixed = (features.random_walks(df, length=6, walks=2, task_edges=m).collect() for m in (1000, 0, 12))
    assert len(inside) == 2 * sum(len(g.neighbours(e)) for e in g.GRAPHS.values())
    assert sorted(inside) == sorted(joined) == sorted(mixed)


def test_shares_of_a_graph_walk_from_every_node_once():
    import pandas as pd

    from graphloom.operators.blocks import Numbered
    from graphloom.operators.local_walks import walks_of

    def starts(share, shares):
        edges = pd.DataFrame({"k": 1, "_share": share, "_shares": shares, "_text": "1-", "src": range(699), "dst": range(1, 700)})
        graphs = Numbered(edges, ["k", "_share", "_shares", "_text"], split=False)
        return [tuple(r.values()) for b in walks_of(graphs, ["k"], 4, 2, 1) for r in b.to_pylist()]

    whole = starts(0, 1)
    assert len(whole) == 1400
    assert sorted(map(str, starts(0, 2) + starts(1, 2))) == sorted(map(str, whole))


def test_walk_embeddings_of_tasks_and_joins_agree(spark):
    from . import graphs as g

    graphs = {1: g.clique(5) + [(4, 5)], 2: g.lattice(4, 3), 3: g.random_graph(30, 24, 2)}
    walks = features.random_walks(g.frame(spark, graphs), length=7, walks=3)
    odd = spark.createDataFrame([(None, 0, 0, [1, 2, 1]), (2, 9, 0, [0, None, 1])], "graph_id long, walk int, start long, path array<long>")
    walks = walks.unionByName(odd)

    def rows(pairs):
        out = features.walk_embedding(walks, window=3, rounds=3, task_pairs=pairs).collect()
        return {(r["graph_id"], r["node"]): r["embedding"] for r in out}

    inside, joined = rows(10_000), rows(0)
    assert inside.keys() == joined.keys() and len(inside) > 30
    for k in inside:
        assert inside[k] == pytest.approx(joined[k], abs=1e-9)


def test_walk_embedding_separates_cliques(spark):
    from . import graphs as g

    two = g.clique(6) + [(a + 6, b + 6) for a, b in g.clique(6)] + [(0, 6)]
    walks = features.random_walks(g.frame(spark, {1: two}), length=10, walks=6)
    rows = {r["node"]: np.array(r["embedding"]) for r in features.walk_embedding(walks, window=3, rounds=8).collect()}
    assert set(rows) == set(range(12))
    left = np.mean([rows[v] for v in range(1, 6)], axis=0)
    right = np.mean([rows[v] for v in range(7, 12)], axis=0)
    spread = max(np.linalg.norm(rows[v] - left) for v in range(1, 6))
    assert np.linalg.norm(left - right) > spread


def test_path_params(spark):
    df = spark.createDataFrame([("Net128_d0.32_p0.20/graphml",), ("other",)], "path string")
    rows = paths.path_params(df, "path", {"d": r"_d([0-9.]+)", "p": r"_p([0-9.]+)"}).collect()
    assert (rows[0]["d"], rows[0]["p"]) == (0.32, 0.2) and rows[1]["d"] is None


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d3" for="edge" attr.name="length" attr.type="long" />
  <key id="d2" for="edge" attr.name="length" attr.type="double" />
  <key id="d1" for="node" attr.name="y" attr.type="long" />
  <key id="d0" for="node" attr.name="x" attr.type="long" />
  <graph edgedefault="undirected">
    <node id="(7, 4)"><data key="d0">4</data><data key="d1">7</data></node>
    <node id="(9, 5)"><data key="d0">5</data><data key="d1">9</data></node>
    <edge source="(9, 5)" target="(7, 4)">{data}</edge>
  </graph>
</graphml>
"""


def test_scan_graphml(spark, tmp_path):
    for corpus, data in (("a", '<data key="d2">2.5</data><data key="d3">2</data>'), ("b", '<data key="d3">3</data>')):
        folder = tmp_path / corpus / "graphml"
        folder.mkdir(parents=True)
        (folder / "0_128.graphml").write_text(GRAPHML.format(data=data))
    nodes, edges = graphml.scan_graphml(spark, f"{tmp_path}/*/graphml")
    assert {(r["corpus"], r["graph_id"], r["node_id"], r["x"], r["y"]) for r in nodes.collect()} == {
        (c, "0_128", n, x, y) for c in "ab" for n, x, y in (("(7, 4)", 4, 7), ("(9, 5)", 5, 9))
    }
    assert {(r["corpus"], r["src"], r["dst"], r["length"]) for r in edges.collect()} == {
        ("a", "(7, 4)", "(9, 5)", 2.5), ("b", "(7, 4)", "(9, 5)", 3.0)
    }


def test_scan_annotations(spark, tmp_path):
    (tmp_path / "0_0.json").write_text('{"nodes": [[1, 2],\n[3, 4]],\n"edges": [[[3, 4], [1, 2]], [[1, 2], [3, 4]]]}')
    nodes, edges = graphml.scan_annotations(spark, str(tmp_path))
    assert nodes.count() == 2
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("(1, 2)", "(3, 4)")]


def png(width, height, rows, channels):
    kind = {1: 0, 3: 2}[channels]
    raw = b"".join(b"\0" + bytes(r) for r in rows)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_raster(spark, tmp_path):
    (tmp_path / "gray.png").write_bytes(png(3, 2, [[0, 10, 20], [30, 40, 255]], 1))
    (tmp_path / "colour.png").write_bytes(png(2, 1, [[255, 0, 0, 0, 255, 0]], 3))
    rows = {(r["image_id"], r["x"], r["y"]): r["v"] for r in files.scan_raster(spark, str(tmp_path)).collect()}
    assert rows["gray", 0, 1] == 30 and rows["gray", 2, 1] == 255 and rows["gray", 1, 0] == 10
    assert rows["colour", 0, 0] == int(0.2125 * 255) and rows["colour", 1, 0] == int(0.7154 * 255)


def test_incremental_stream(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(10).write.parquet(source)
    double = lambda df: df.select((F.col("id") * 2).alias("id"))
    process_new_files(spark, source, "id long", double, sink, mark)
    assert process_new_files(spark, source, "id long", double, sink, mark) == 0
    spark.range(10, 15).write.mode("append").parquet(source)
    process_new_files(spark, source, "id long", double, sink, mark)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [2 * i for i in range(15)]
