import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import rasters, spatial

NODE = "graph_id long, node long, x double, y double"


def random_points(n, side, seed, key=1):
    rng = random.Random(seed)
    return [(key, i, rng.uniform(0, side), rng.uniform(0, side)) for i in range(n)]


def test_merge_keeps_survivors_apart(spark):
    # one dense clump holds most points
    rng = random.Random(5)
    pts = random_points(120, 40, 4) + [(1, 1000 + i, 10 + rng.random(), 10 + rng.random()) for i in range(300)]
    nodes = spark.createDataFrame(pts, NODE)
    mapping = {r["node"]: r["survivor"] for r in spatial.close_node_map(nodes, 3.0).collect()}
    at = {p[1]: p[2:] for p in pts}
    kept = sorted(set(mapping.values()))
    assert set(mapping) == set(at)
    assert all(math.dist(at[a], at[b]) >= 3.0 for i, a in enumerate(kept) for b in kept[:i])
    assert all(math.dist(at[n], at[s]) < 3.0 for n, s in mapping.items() if n != s)


def test_merge_is_strict_and_rewires(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 4.4, 0.0)], NODE)
    edges = spark.createDataFrame(
        [(1, 0, 1, 5.0), (1, 1, 2, 6.0), (1, 2, 3, 7.0)], "graph_id long, src long, dst long, length double"
    )
    kept, merged, removed = spatial.merge_close_nodes(nodes, edges, 1.4)
    survivors = {r["node"] for r in kept.collect()}
    assert len(survivors) == 3 and {2, 3} <= survivors  # 1.4 apart is not closer than 1.4
    assert removed.count() == 1
    s = (survivors - {2, 3}).pop()
    got = {(r["src"], r["dst"]): r["length"] for r in merged.collect()}
    # the edge between the merged nodes is a self-loop; only untouched edges keep attributes
    assert got == {(s, s): None, (min(s, 2), max(s, 2)): 6.0 if s == 1 else None, (2, 3): 7.0}


def test_proximity_pairs_brute_force(spark):
    pts = random_points(150, 25, 8)
    got = {(r["src"], r["dst"]) for r in spatial.proximity_pairs(spark.createDataFrame(pts, NODE), 2.5).collect()}
    want = {
        (a[1], b[1]) for i, a in enumerate(pts) for b in pts[i + 1 :] if math.dist(a[2:], b[2:]) < 2.5
    }
    assert got == want


@pytest.mark.parametrize("metric", ["chebyshev", "l2"])
def test_nearest_site_brute_force(spark, metric):
    rng = random.Random(11)
    # sites crowd in one corner, so far points need wide cells
    sites = [(1, i, rng.uniform(0, 8), rng.uniform(0, 8), rng.choice([0.5, 1.0, 2.5])) for i in range(30)]
    points = [(1, i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)]
    got = {
        r["point"]: r["site"]
        for r in spatial.nearest_site(
            spark.createDataFrame(points, "set_id long, point long, x double, y double"),
            spark.createDataFrame(sites, "set_id long, site long, x double, y double, beta double"),
            metric=metric,
        ).collect()
    }
    for _, p, x, y in points:
        def gap(s):
            dx, dy = abs(x - s[2]) * s[4], abs(y - s[3]) / s[4]
            return max(dx, dy) if metric == "chebyshev" else math.hypot(dx, dy)

        assert gap(sites[got[p]]) == pytest.approx(min(gap(s) for s in sites))
    assert len(got) == 200


def test_copied_rows_are_not_broadcast(spark):
    # a copy per cell around a node: the estimated size leaves the copies out
    pts = spark.createDataFrame(random_points(60, 25, 3), NODE)
    plan = spatial.proximity_pairs(pts, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    _kept, merged, _removed = spatial.merge_close_nodes(pts, spark.createDataFrame([(1, 0, 1)], "graph_id long, src long, dst long"), 2.0)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lloyd_reports_empty_region(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0)], "set_id long, point long, x double, y double")
    sites = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 1.0), (1, 1, 5.0, 5.0, 1.0)], "set_id long, site long, x double, y double, beta double"
    )
    with pytest.raises(spatial.EmptyRegionError):
        spatial.lloyd_relaxation(points, sites, 1)


def test_lloyd_drops_sites_without_points(spark):
    # two sites at one place: the lower one owns all points
    points = spark.createDataFrame(
        [(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 1.0, 1.0), (1, 3, 1.0, -1.0), (2, 0, 4.0, 4.0)], "set_id long, point long, x double, y double"
    )
    sites = spark.createDataFrame(
        [(1, 0, 1.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 1.0), (1, 2, 9.0, 9.0, 1.0), (2, 5, 0.0, 0.0, 1.0)],
        "set_id long, site long, x double, y double, beta double",
    )
    got = sorted(tuple(r) for r in spatial.lloyd_relaxation(points, sites, 2, drop_empty=True).collect())
    assert got == [(1, 0, 1.0, 0.0, 1.0), (2, 5, 4.0, 4.0, 1.0)]


def test_segment_intersections(spark):
    segs = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 40.0, 40.0), (1, 1, 0.0, 40.0, 40.0, 0.0), (1, 2, 0.0, 1.0, 40.0, 41.0), (1, 3, 50.0, 0.0, 50.0, 9.0)],
        "graph_id long, seg long, x1 double, y1 double, x2 double, y2 double",
    )
    got = {(r["seg_a"], r["seg_b"]): (r["x"], r["y"]) for r in spatial.segment_intersections(segs).collect()}
    assert got == {(0, 1): (20.0, 20.0), (1, 2): (19.5, 20.5)}


def test_segment_intersections_in_tasks_and_by_cells(spark):
    """Small graphs in the tasks and large ones by cells: the same crossings, with copies, nulls, points and parallels."""
    rng = random.Random(5)
    whole = "graph_id long, seg long, x1 long, y1 long, x2 long, y2 long"
    for schema, draw in ((whole, lambda: rng.randrange(60)), (whole.replace("1 long", "1 double"), lambda: rng.randrange(60) / 2)):
        rows = [(k, s % 37, *(draw() for _ in range(4))) for k, n in ((1, 40), (2, 5), (3, 15)) for s in range(n)]
        rows = [r if "double" not in schema else (*r[:4], int(r[4]), int(r[5])) for r in rows]
        rows += [(3, 50, *rows[-1][2:]), (3, 51, *rows[-1][2:4], int(rows[-1][2]), int(rows[-1][3])), (4, 1, None, *rows[0][3:]), (4, 2, *rows[0][2:])]
        rows += [(None, 1, *rows[0][2:]), (None, 2, *rows[1][2:]), (4, 3, *rows[1][2:]), (3, None, *rows[2][2:])]
        segs = spark.createDataFrame(rows, schema)
        by_cells = sorted(tuple(r) for r in spatial.segment_intersections(segs, task_segs=0).collect())
        assert len(by_cells) > 100
        for limit in (16, 1 << 12):
            assert sorted(tuple(r) for r in spatial.segment_intersections(segs, task_segs=limit).collect()) == by_cells


def test_crossings_block_by_block(monkeypatch):
    """Candidates in blocks of any size give all crossings of a key's segments, and none between keys."""
    rng = np.random.default_rng(6)
    table = pa.table({"k": np.repeat([1, 2, 5], [30, 1, 20]), "seg": rng.permutation(51)} | {c: rng.integers(0, 30, 51) for c in ("x1", "y1", "x2", "y2")})

    def found():
        return sorted((a, b, x, y) for block in spatial._crossings(table, ["k"]) for a, b, x, y in zip(*block))

    whole = found()
    monkeypatch.setattr(spatial, "CROSS_CELLS", 7)
    assert found() == whole and len(whole) > 20
    keys, segs = table.column("k").to_numpy(), table.column("seg").to_numpy()
    assert all(keys[a] == keys[b] and segs[a] < segs[b] for a, b, _, _ in whole)


def test_clip_segment(spark):
    segs = spark.createDataFrame(
        [(0, 50.0, 50.0, 0.0, 200.0), (1, 50.0, 50.0, 90.0, 10.0), (2, 50.0, 50.0, 225.0, 500.0)],
        "id long, x double, y double, angle double, length double",
    )
    got = {r["id"]: (r["clipped"], r["length"]) for r in spatial.clip_segment(segs, 100, 100).collect()}
    assert got[0] == (True, pytest.approx(49.0)) and got[1] == (False, 10.0)
    assert got[2] == (True, pytest.approx(50 * math.sqrt(2)))


def image(spark, array, image_id=0):
    h, w = array.shape
    rows = [(image_id, x, y, float(array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, x long, y long, v double")


def test_sobel_matches_direct_sum(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 255, (7, 9)).astype(float)
    padded = np.pad(a, 1, mode="reflect")
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = {}
    for y in range(7):
        for x in range(9):
            block = padded[y : y + 3, x : x + 3]
            gx, gy = (block * kx).sum(), (block * kx.T).sum()
            if gx or gy:
                want[x, y] = math.degrees(math.atan2(gx, gy)) + 180
    got = {(r["x"], r["y"]): r["angle"] for r in rasters.gradient_angles_sobel(image(spark, a)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_square_segments_of_wide_image(spark):
    labels = rasters.square_segments(image(spark, np.zeros((5, 8))), 3)
    grid = {(r["x"], r["y"]): r["label"] for r in labels.collect()}
    assert grid[0, 0] == 1 and grid[7, 0] == 3 and grid[0, 3] == 4 and grid[7, 4] == 6
    assert set(grid.values()) == set(range(1, 7))


def test_array_split(spark):
    a = np.arange(11 * 10).reshape(11, 10).astype(float)
    tiles = rasters.array_split_tiles(image(spark, a), 3, 4).collect()
    want = {}
    for i, rows in enumerate(np.array_split(a, 3, axis=0)):
        for j, part in enumerate(np.array_split(rows, 4, axis=1)):
            for v in part.ravel():
                want[v] = i * 4 + j
    assert {r["v"]: r["tile"] for r in tiles} == want


def test_random_tiles_are_unique_and_whole(spark):
    pix = image(spark, np.zeros((12, 12)))
    taken = spark.createDataFrame([(0, 0, 0)], "image_id long, tile_x long, tile_y long")
    origins = rasters.random_tile_origins(pix, 4, 5, 20, seed=2, exclude=taken)
    rows = {(r["tile_x"], r["tile_y"]) for r in origins.collect()}
    assert len(rows) == 20 and (0, 0) not in rows
    assert all(0 <= x <= 7 and 0 <= y <= 8 for x, y in rows)
    assert rasters.cut_tiles(pix, origins, 4, 5).count() == 20 * 20


def lzw(symbols):
    known, prefix, codes = {(s,) for s in symbols}, (), 0
    for s in symbols:
        if prefix + (s,) in known:
            prefix += (s,)
        else:
            known.add(prefix + (s,))
            codes += 1
            prefix = (s,)
    return codes + 1


def test_sequence_complexity(spark):
    rng = random.Random(1)
    groups = {k: [rng.choice("abc") for _ in range(n)] for k, n in ((1, 500), (2, 1), (3, 37))}
    groups[4] = ["a"] * 64
    rows = [(k, i, s) for k, seq in groups.items() for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "k long, i long, s string")
    got = {r["k"]: (r["codes"], r["length"]) for r in rasters.sequence_complexity(df, ["i"], "s", "k").collect()}
    assert got == {k: (lzw(seq), len(seq)) for k, seq in groups.items()}


def test_crossing_numbers(spark):
    # a T: three ends and one branching pixel
    a = np.zeros((9, 9))
    a[2, 1:8] = 255
    a[2:8, 4] = 255
    got = {(r["x"], r["y"]): r["crossings"] for r in rasters.crossing_number_nodes(image(spark, a)).collect()}
    assert {(1, 2), (7, 2), (4, 7)} <= set(got) and got[1, 2] == 1
    assert got[4, 2] == 3


def test_region_adjacency_includes_diagonals(spark):
    a = np.array([[1, 1, 2], [1, 3, 3]])
    labels = image(spark, a).withColumn("label", F.col("v").cast("long"))
    got = {(r["src"], r["dst"]) for r in rasters.region_adjacency(labels).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
