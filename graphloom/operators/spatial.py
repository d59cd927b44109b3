"""Range joins and planar geometry on keyed point tables, as equi-joins on grid cells; small sets of segments in the tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import FINE, Key, join_stats, names, spread_by
from ..functions.scalars import euclid, scaled_chebyshev
from ..staging import Staged, release, stage, stage_counting
from .blocks import FRAME_ROWS, _changes, key_schema
from .local_walks import whole_tables
from .multi_source import by_size
from .tables import GRAPH, canonical

#: Segments of a graph that a task crosses, and pairs of them that it holds at a time.
TASK_SEGMENTS = 1 << 12
CROSS_CELLS = 1 << 18


def _cell(col, side) -> Column:
    return F.floor(F.col(col) / side).cast("long")


def _reach(df: DataFrame, rings: int, cx: str = "_cx", cy: str = "_cy") -> DataFrame:
    """Copy each row to the cells within ``rings`` of its own.

    The estimated size of an exploded table leaves the copies out, so that it may be sent whole to every task; the
    hint keeps the join of the copies in shuffled partitions.
    """
    span = range(-rings, rings + 1)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span])
    return (
        df.withColumn("_o", F.explode(offsets))
        .withColumn(cx, F.col(cx) + F.col("_o.i"))
        .withColumn(cy, F.col(cy) + F.col("_o.j"))
        .drop("_o")
        .hint("merge")
    )


def proximity_pairs(nodes: DataFrame, eps, key: Key = GRAPH) -> DataFrame:
    """Node pairs strictly closer than ``eps`` (a number or a column), each pair once."""
    by = names(key)
    side = F.lit(float(eps)) if isinstance(eps, (int, float)) else eps
    placed = nodes.select(
        *by, "node", "x", "y", side.alias("_eps"), _cell("x", side).alias("_cx"), _cell("y", side).alias("_cy")
    )
    left = placed.select(
        *by, F.col("node").alias("src"), F.col("x").alias("_x1"), F.col("y").alias("_y1"), "_cx", "_cy", "_eps"
    )
    right = _reach(
        placed.select(*by, F.col("node").alias("dst"), F.col("x").alias("_x2"), F.col("y").alias("_y2"), "_cx", "_cy"), 1
    )
    gap = euclid(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"))
    return (
        left.join(right, [*by, "_cx", "_cy"])
        .where(F.col("src") < F.col("dst"))
        .withColumn("distance", gap)
        .where(F.col("distance") < F.col("_eps"))
        .select(*by, "src", "dst", "distance")
    )


def radius_neighbors(regions: DataFrame, key: Key = "image_id", factor: float = math.sqrt(2)) -> DataFrame:
    """Region pairs closer than sqrt(2) times the mean equivalent diameter of their image."""
    by = names(key)
    reach = regions.groupBy(*by).agg((F.avg("equivalent_diameter") * factor).alias("_r"))
    return proximity_pairs(join_stats(regions, reach, by), F.col("_r"), key)


def close_node_map(nodes: DataFrame, eps: float, key: Key = GRAPH) -> DataFrame:
    """Survivor of every node: ``(key, node, survivor)``.

    Survivors are at least ``eps`` apart and every other node goes to a survivor nearer than ``eps``.
    Cells of side eps/sqrt(2) hold nodes that are all within ``eps`` of each other, so at most one of
    them survives: a cell offers only its node of lowest hash, and the offers that beat all offers
    around them win the round. A dense cell is thus reduced before anything is joined, and a node
    meets at most the 25 winners around it. Hash order makes the number of rounds logarithmic.
    """
    spark = nodes.sparkSession
    by = names(key)
    side = eps / math.sqrt(2)
    cells = [*by, "_cx", "_cy"]
    open_nodes = stage(
        nodes.select(
            *by,
            "node",
            F.col("x").cast("double").alias("x"),
            F.col("y").cast("double").alias("y"),
            F.xxhash64(*by, "node").alias("_h"),
            _cell("x", side).alias("_cx"),
            _cell("y", side).alias("_cy"),
        )
    )
    done: list[Staged] = []
    while True:
        offers = stage(
            open_nodes.df.groupBy(*cells)
            .agg(F.min(F.struct("_h", "node", "x", "y")).alias("_m"))
            .select(*cells, "_m.*")
        )
        rivals = _reach(
            offers.df.select(
                *cells,
                F.col("x").alias("_x2"),
                F.col("y").alias("_y2"),
                F.struct("_h", "node").alias("_rank2"),
            ),
            2,
        )
        gap = euclid(F.col("x"), F.col("y"), F.col("_x2"), F.col("_y2"))
        beaten = (
            offers.df.join(rivals, cells)
            .where((F.col("_rank2") < F.struct("_h", "node")) & (gap < eps))
            .select(*by, "node")
        )
        winners = offers.df.join(beaten.hint("merge"), [*by, "node"], "left_anti").select(
            *cells, F.col("node").alias("survivor"), F.col("x").alias("_x2"), F.col("y").alias("_y2")
        )
        near = open_nodes.df.join(_reach(winners, 2), cells).where(gap < eps)
        taken = stage(
            near.groupBy(*by, "node").agg(F.min_by("survivor", F.struct(gap, F.col("survivor"))).alias("survivor"))
        )
        rest, seen = stage_counting(
            open_nodes.df.join(taken.df.hint("merge"), [*by, "node"], "left_anti").select(*open_nodes.df.columns),
            left=F.count(F.lit(1)),
        )
        done.append(taken)
        release(spark, open_nodes, offers)
        open_nodes = rest
        if not seen["left"]:
            break
    out = done[0].df
    for part in done[1:]:
        out = out.unionByName(part.df)
    return out


def merge_close_nodes(
    nodes: DataFrame, edges: DataFrame, eps: float, key: Key = GRAPH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge nodes closer than ``eps``: surviving nodes, rewired edges and the removed nodes.

    Survivors keep their own attributes. A rewired edge has null attributes unless it falls on an edge
    that was there before; merging two linked nodes leaves a self-loop on the survivor.
    """
    by = names(key)
    # a row per node: far larger as a hash table than as the files that its size is read from
    mapping = close_node_map(nodes, eps, key).hint("merge")
    kept = nodes.join(mapping.where("node = survivor").select(*by, "node"), [*by, "node"], "left_semi")
    removed = mapping.where("node <> survivor")
    attrs = [c for c in edges.columns if c not in (*by, "src", "dst")]
    moved = edges.withColumn("_same", F.lit(True))
    for end in ("src", "dst"):
        side = mapping.select(*by, F.col("node").alias(end), F.col("survivor").alias("_new"))
        moved = (
            moved.join(side, [*by, end])
            .withColumn("_same", F.col("_same") & (F.col("_new") == F.col(end)))
            .withColumn(end, F.col("_new"))
            .drop("_new")
        )
    flat = canonical(moved, key)
    if not attrs:
        return kept, flat.select(*by, "src", "dst").distinct(), removed
    merged = flat.groupBy(*by, "src", "dst").agg(
        *[F.max(F.when(F.col("_same"), F.col(a))).alias(a) for a in attrs]
    )
    return kept, merged, removed


def drop_near_duplicates(points: DataFrame, limit: float = 3.0, key: Key = GRAPH) -> DataFrame:
    """Drop every point that has an earlier one (lower id) at a city-block distance below ``limit``."""
    by = names(key)
    placed = points.withColumns({"_cx": _cell("x", limit), "_cy": _cell("y", limit)})
    # one row per position: the earliest id there decides for all later points
    spots = placed.groupBy(*by, "x", "y", "_cx", "_cy").agg(F.min("node").alias("_first"))
    earlier = _reach(
        spots.select(*by, F.col("x").alias("_x2"), F.col("y").alias("_y2"), "_first", "_cx", "_cy"), 1
    )
    gap = F.abs(F.col("x") - F.col("_x2")) + F.abs(F.col("y") - F.col("_y2"))
    hit = (
        placed.select(*by, "node", "x", "y", "_cx", "_cy")
        .join(earlier, [*by, "_cx", "_cy"])
        .where((F.col("_first") < F.col("node")) & (gap < limit))
        .select(*by, "node")
    )
    return points.join(hit, [*by, "node"], "left_anti")


def snap_to_node(clicks: DataFrame, nodes: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Node hit by each click: the exact position, else the smallest ``(x, y)`` in the 3x3 area."""
    by = names(key)
    spots = nodes.select(*by, F.col("x").alias("node_x"), F.col("y").alias("node_y")).distinct()
    tried = _reach(clicks.select(*by, "click", "x", "y", F.col("x").alias("node_x"), F.col("y").alias("node_y")), 1, "node_x", "node_y")
    miss = ((F.col("x") != F.col("node_x")) | (F.col("y") != F.col("node_y"))).cast("int")
    best = (
        tried.join(spots, [*by, "node_x", "node_y"])
        .groupBy(*by, "click")
        .agg(F.min(F.struct(miss.alias("_miss"), "node_x", "node_y")).alias("_b"))
        .select(*by, "click", "_b.node_x", "_b.node_y")
    )
    return clicks.select(*by, "click").join(best, [*by, "click"], "left")


def nearest_site(points: DataFrame, sites: DataFrame, key: Key = "set_id", metric: str = "chebyshev") -> DataFrame:
    """Nearest site of every point under the site-scaled metric; ties go to the lowest site id.

    Points look at the 3x3 cells around them. A hit is final once nothing outside those cells can be
    nearer; the other points try again on cells twice as wide. Few points are left after the first
    rounds, and no point is ever compared with all sites.
    """
    spark = points.sparkSession
    by = names(key)
    beta = F.col("beta")
    stretch = F.greatest(beta, 1.0 / beta)
    frame = stage(
        sites.groupBy(*by).agg(
            F.max(stretch).alias("_stretch"),
            F.sqrt(
                (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1) / F.count(F.lit(1))
            ).alias("_h0"),
        )
    )
    site_rows = stage(
        sites.join(frame.df, by).select(
            *by, F.col("site").alias("site"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), "beta", "_h0", "_stretch"
        )
    )
    todo = stage(
        points.join(frame.df.select(*by, "_h0"), by).select(*by, "point", "x", "y", "_h0")
    )
    found: list[Staged] = []
    level = 0
    px, py, sx, sy = F.col("x"), F.col("y"), F.col("_sx"), F.col("_sy")
    if metric == "chebyshev":
        gap = scaled_chebyshev(px, py, sx, sy, beta)
    else:
        gap = F.sqrt(F.pow((px - sx) * beta, 2) + F.pow((py - sy) / beta, 2))
    while True:
        wide = F.col("_h0") * float(2**level)
        cells = {"_cx": F.floor(F.col("x") / wide), "_cy": F.floor(F.col("y") / wide)}
        site_cells = {"_cx": F.floor(sx / wide), "_cy": F.floor(sy / wide)}
        here = _reach(site_rows.df.withColumns(site_cells), 1).drop("_h0")
        best = (
            todo.df.withColumns(cells)
            .join(here, [*by, "_cx", "_cy"])
            .groupBy(*by, "point")
            .agg(
                F.min(F.struct(gap.alias("distance"), F.col("site"))).alias("_b"),
                F.max(wide / F.col("_stretch")).alias("_safe"),
            )
            .where(F.col("_b.distance") <= F.col("_safe"))
            .select(*by, "point", "_b.site", "_b.distance")
        )
        hits = stage(best)
        rest, seen = stage_counting(
            todo.df.join(hits.df.hint("merge"), [*by, "point"], "left_anti").select(*todo.df.columns), left=F.count(F.lit(1))
        )
        found.append(hits)
        release(spark, todo)
        todo = rest
        if not seen["left"]:
            break
        level += 1
    release(spark, frame, site_rows, todo)
    out = found[0].df
    for part in found[1:]:
        out = out.unionByName(part.df)
    return out


class EmptyRegionError(RuntimeError):
    """A site owns no point, so its centroid is undefined."""


def lloyd_relaxation(points: DataFrame, sites: DataFrame, iterations: int, key: Key = "set_id", drop_empty: bool = False) -> DataFrame:
    """Move every site to the centroid of the points nearest to it, ``iterations`` times.

    A site may lose all its points, as where two centroids coincide. It then has no centroid: an error, or with
    ``drop_empty`` the site leaves the iteration.
    """
    by = names(key)
    current = sites
    for _ in range(iterations):
        owner = nearest_site(points, current, key)
        centroids = (
            points.join(owner.select(*by, "point", "site"), [*by, "point"])
            .groupBy(*by, "site")
            .agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
        )
        moved, seen = stage_counting(
            current.join(centroids, [*by, "site"], "inner" if drop_empty else "left").select(
                *by, "site", F.col("_x").alias("x"), F.col("_y").alias("y"), "beta"
            ),
            empty=F.count_if(F.col("x").isNull()),
        )
        if seen["empty"]:
            raise EmptyRegionError(f"{seen['empty']} sites own no point")
        current = moved.df
    return current


def clip_segment(segs: DataFrame, width: float, height: float) -> DataFrame:
    """Shorten segments that leave the frame to their first hit on its border.

    Segments are ``x, y, angle, length``; one whose end lies strictly inside stays as it is.
    """
    rad = F.radians("angle")
    dx, dy = F.col("length") * F.cos(rad), F.col("length") * F.sin(rad)
    x, y = F.col("x"), F.col("y")
    ex, ey = x + dx, y + dy
    inside = (ex > 0) & (ex < width) & (ey > 0) & (ey < height)
    tiny = 1e-9
    hits = []
    for at, base, run, other, other_run, top in (
        (0.0, x, dx, y, dy, height - 1),
        (width - 1.0, x, dx, y, dy, height - 1),
        (0.0, y, dy, x, dx, width - 1),
        (height - 1.0, y, dy, x, dx, width - 1),
    ):
        t = F.try_divide(F.lit(at) - base, run)
        side = other + t * other_run
        ok = (F.abs(run) > tiny) & (t >= 0) & (t <= 1) & (side >= -tiny) & (side <= top + tiny)
        hits.append(F.when(ok, t))
    first = F.least(*hits)
    share = F.when(inside, F.lit(1.0)).otherwise(F.coalesce(first, F.lit(1.0)))
    return segs.withColumn("clipped", ~inside & first.isNotNull()).withColumn("length", F.col("length") * share)


def segment_intersections(
    segs: DataFrame, key: Key = GRAPH, side: float = 16.0, task_segs: int = TASK_SEGMENTS
) -> DataFrame:
    """Crossing points of segments ``(key, seg, x1, y1, x2, y2)``, each pair once.

    Under a key, graphs of at most ``task_segs`` segments are crossed in the tasks after one shuffle. In larger ones, and those
    with a null or a coordinate that is not finite or beyond 2^29, segments meet in the cells their boxes cover.
    """
    by = names(key)
    types = dict(segs.dtypes)
    corners = ["x1", "y1", "x2", "y2"]
    if not by or types["seg"] != "bigint" or any(types[c] not in ("bigint", "double") for c in corners):
        return _crossings_by_cells(segs, key, side)
    held = stage(segs.select(*by, "seg", *corners)).df
    # a whole number up to this bound has products that do not overflow
    sound = F.lit(True)
    for c in corners:
        sound = sound & F.coalesce(F.abs(F.col(c)) <= F.lit(1 << 29), F.lit(False))
    small, large = by_size(held.withColumns({"src": F.col("seg"), "dst": F.col("seg")}), key, task_segs, max(task_segs, 1), ~sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, by, FRAME_ROWS):
            for a, b, x, y in _crossings(table, by):
                columns = {c: table.column(c).combine_chunks().take(pa.array(a)) for c in by}
                seg = table.column("seg").to_numpy()
                columns |= {"seg_a": pa.array(seg[a]), "seg_b": pa.array(seg[b]), "x": pa.array(x), "y": pa.array(y)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"{key_schema(segs, key)}, seg_a long, seg_b long, x double, y double"
    out = spread_by(small.select(*by, "seg", *corners), by, times=FINE).mapInArrow(run, schema)
    return out if large is None else out.unionByName(_crossings_by_cells(large.select(*held.columns), key, side))


def _crossings(table: pa.Table, by: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the smaller seg, row of the larger, x, y) of the crossings in the whole groups of ``table``, in blocks."""
    group = np.cumsum(_changes(table.select(by).to_pandas(), by))
    seg, x1, y1, x2, y2 = (table.column(c).to_numpy() for c in ("seg", "x1", "y1", "x2", "y2"))
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    order = np.lexsort((left, group))
    ends = np.flatnonzero(np.append(np.diff(group), 1)) + 1
    # segments stand by their left end: those that start before one's right end are its candidates
    last = np.concatenate([lo + np.searchsorted(left[order[lo:hi]], right[order[lo:hi]], side="right") for lo, hi in zip(np.append(0, ends[:-1]), ends)])
    seg, x1, y1, x2, y2 = (v[order] for v in (seg, x1, y1, x2, y2))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    fan = last - np.arange(len(order)) - 1
    total = np.cumsum(fan)
    lo = 0
    while lo < len(order):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + CROSS_CELLS, side="right")))
        a = np.repeat(np.arange(lo, hi), fan[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - fan[lo:hi] - before, fan[lo:hi])
        near = np.flatnonzero((low[a] <= high[b]) & (low[b] <= high[a]) & (seg[a] != seg[b]))
        a, b = a[near], b[near]
        turned = seg[a] > seg[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        # the same products in the same order as by cells
        rx, ry, sx, sy = x2[a] - x1[a], y2[a] - y1[a], x2[b] - x1[b], y2[b] - y1[b]
        area = rx * sy - ry * sx
        apart = np.flatnonzero(area != 0)
        a, b, rx, ry, sx, sy, area = (v[apart] for v in (a, b, rx, ry, sx, sy, area))
        gx, gy = x1[b] - x1[a], y1[b] - y1[a]
        t, u = (gx * sy - gy * sx) / area, (gx * ry - gy * rx) / area
        met = np.flatnonzero((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        a, b, t = a[met], b[met], t[met]
        yield order[a], order[b], x1[a] + t * rx[met], y1[a] + t * ry[met]
        lo = hi


def _crossings_by_cells(segs: DataFrame, key: Key, side: float) -> DataFrame:
    """Pairs meet in cells; a pair is tested only in the first cell both share."""
    by = names(key)
    box = {
        "_ax": F.least("x1", "x2"), "_bx": F.greatest("x1", "x2"),
        "_ay": F.least("y1", "y2"), "_by": F.greatest("y1", "y2"),
    }
    placed = segs.select(*by, "seg", "x1", "y1", "x2", "y2").withColumns(box)
    placed = placed.withColumns({"_i0": _cell("_ax", side), "_j0": _cell("_ay", side)})
    spread = placed.withColumn("_cx", F.explode(F.sequence(F.col("_i0"), _cell("_bx", side)))).withColumn(
        "_cy", F.explode(F.sequence(F.col("_j0"), _cell("_by", side)))
    )
    keep = [c for c in spread.columns if c not in (*by, "_cx", "_cy")]
    a = spread.select(*by, "_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in keep])
    b = spread.select(*by, "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in keep])
    c = F.col
    first_shared = (c("_cx") == F.greatest("a__i0", "b__i0")) & (c("_cy") == F.greatest("a__j0", "b__j0"))
    overlap = (
        (c("a__ax") <= c("b__bx")) & (c("b__ax") <= c("a__bx")) & (c("a__ay") <= c("b__by")) & (c("b__ay") <= c("a__by"))
    )
    pairs = a.join(b, [*by, "_cx", "_cy"]).where((c("a_seg") < c("b_seg")) & first_shared & overlap)
    # p + t * r = q + u * s: the cross product with s leaves t alone, the one with r leaves u
    p, q = ((c(f"{k}_x1"), c(f"{k}_y1")) for k in "ab")
    r, s = ((c(f"{k}_x2") - c(f"{k}_x1"), c(f"{k}_y2") - c(f"{k}_y1")) for k in "ab")
    gap = (q[0] - p[0], q[1] - p[1])

    def cross(v, w):
        return v[0] * w[1] - v[1] * w[0]

    inside = [F.col(k).between(0, 1) for k in ("t", "u")]
    met = (
        pairs.withColumn("area", cross(r, s))
        .where("area <> 0")
        .withColumns({"t": cross(gap, s) / c("area"), "u": cross(gap, r) / c("area")})
        .where(inside[0] & inside[1])
    )
    x, y = (p[i] + c("t") * r[i] for i in (0, 1))
    return met.select(*by, c("a_seg").alias("seg_a"), c("b_seg").alias("seg_b"), x.alias("x"), y.alias("y"))


def exclude_existing(candidates: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return candidates.join(existing, on, "left_anti")
