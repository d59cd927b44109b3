"""Queries on point graphs, sites and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import gravity_weight
from ..operators import spatial as spt
from .inputs import point_edges, points, r, rd, raster, table, with_views
from .registry import query


def nodes(spark, sf):
    return points(spark, sf).select("graph_id", F.col("node_id").alias("node"), "x", "y")


@query(
    "proximity_pairs",
    with_views(
        f"""SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, {rd('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} AS distance
            FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.node_id < b.node_id
            WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 16""",
        "points",
    ),
)
def _(spark, sf):
    return spt.proximity_pairs(nodes(spark, sf), 4.0).withColumn("distance", r("distance"))


@query(
    "merge_close_nodes",
    with_views(
        """SELECT graph_id, count(*) AS n_nodes, CAST(0 AS BIGINT) AS close_survivors, CAST(0 AS BIGINT) AS far_removed, CAST(0 AS BIGINT) AS lost_edges
           FROM points GROUP BY ALL""",
        "points",
    ),
)
def _(spark, sf):
    """Invariants of the merge per graph, next to the number of nodes it accounts for."""
    pts, edges = nodes(spark, sf), point_edges(spark, sf)
    kept, merged, removed = spt.merge_close_nodes(pts, edges, 4.0)
    close = spt.proximity_pairs(kept, 4.0).groupBy("graph_id").agg(F.count(F.lit(1)).alias("c"))
    place = pts.select("graph_id", F.col("node").alias("survivor"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    far = (
        removed.join(pts, ["graph_id", "node"])
        .join(place, ["graph_id", "survivor"])
        .groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("gone"), F.count_if(gap >= 4.0).alias("far"))
    )
    loose = (
        merged.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
        .join(kept, ["graph_id", "node"], "left_anti")
        .groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("lost"))
    )
    zero = F.lit(0).cast("long")
    return (
        kept.groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(close, "graph_id", "left")
        .join(far, "graph_id", "left")
        .join(loose, "graph_id", "left")
        .select(
            "graph_id",
            (F.col("n") + F.coalesce("gone", zero)).alias("n_nodes"),
            F.coalesce("c", zero).alias("close_survivors"),
            F.coalesce("far", zero).alias("far_removed"),
            F.coalesce("lost", zero).alias("lost_edges"),
        )
    )


@query("merged_graph")
def _(spark, sf):
    _kept, merged, _removed = spt.merge_close_nodes(nodes(spark, sf), point_edges(spark, sf), 1.4)
    return merged


@query(
    "drop_near_duplicates",
    with_views(
        """SELECT graph_id, node_id AS node, x, y FROM points p WHERE NOT EXISTS (
             SELECT 1 FROM points q WHERE q.graph_id = p.graph_id AND q.node_id < p.node_id
               AND abs(p.x - q.x) + abs(p.y - q.y) < 3)""",
        "points",
    ),
)
def _(spark, sf):
    return spt.drop_near_duplicates(nodes(spark, sf), 3.0)


@query(
    "snap_to_node",
    with_views(
        """WITH clicks AS (SELECT graph_id, node_id AS click, (x + 1) % 128 AS x, (y + CAST(floor(value) AS BIGINT)) % 128 AS y FROM points),
           hits AS (SELECT c.graph_id, click, p.x AS node_x, p.y AS node_y,
               row_number() OVER (PARTITION BY c.graph_id, click ORDER BY (p.x <> c.x OR p.y <> c.y), p.x, p.y) AS rn
             FROM clicks c JOIN points p ON p.graph_id = c.graph_id AND abs(p.x - c.x) <= 1 AND abs(p.y - c.y) <= 1)
           SELECT c.graph_id, c.click, h.node_x, h.node_y FROM clicks c
           LEFT JOIN hits h ON h.graph_id = c.graph_id AND h.click = c.click AND h.rn = 1""",
        "points",
    ),
)
def _(spark, sf):
    p = points(spark, sf)
    clicks = p.select(
        "graph_id",
        F.col("node_id").alias("click"),
        F.pmod(F.col("x") + 1, F.lit(128)).alias("x"),
        F.pmod(F.col("y") + F.floor("value"), F.lit(128)).alias("y"),
    )
    return spt.snap_to_node(clicks, nodes(spark, sf))


def pixel_points(spark, sf):
    return raster(spark, sf).select(
        F.col("image_id").alias("set_id"), (F.col("y") * 100 + F.col("x")).alias("point"), "x", "y"
    )


def pixel_sites(spark, sf, stretched=True):
    """Bright pixels; the brightness class sets the stretch."""
    v = F.floor("v")
    beta = 1 + F.pmod(v, F.lit(3)) / 2 if stretched else F.lit(1.0)
    return raster(spark, sf).where("v > 60").select(
        F.col("image_id").alias("set_id"),
        (F.col("y") * 100 + F.col("x")).alias("site"),
        "x",
        "y",
        beta.alias("beta"),
    )


SITE_SQL = """WITH pts AS (SELECT image_id AS set_id, y * 100 + x AS point, x, y FROM raster),
    sites AS (SELECT image_id AS set_id, y * 100 + x AS site, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y,
      1 + CAST(floor(v) AS BIGINT) % 3 / 2 AS beta FROM raster WHERE v > 60)"""


def owner_sql(name, sites, metric):
    return f"""{name} AS (SELECT p.set_id, p.point, min(({metric}, s.site)) AS b FROM pts p JOIN {sites} s
        ON s.set_id = p.set_id GROUP BY ALL)"""


CHEB = "greatest(abs(p.x - s.x) * s.beta, abs(p.y - s.y) / s.beta)"
L2 = "sqrt(((p.x - s.x) * s.beta) ** 2 + ((p.y - s.y) / s.beta) ** 2)"


@query(
    "nearest_site",
    with_views(
        f"{SITE_SQL}, {owner_sql('o', 'sites', CHEB)} SELECT set_id, point, b[2] AS site, {rd('b[1]')} AS distance FROM o",
        "raster",
    ),
)
def _(spark, sf):
    out = spt.nearest_site(pixel_points(spark, sf), pixel_sites(spark, sf))
    return out.withColumn("distance", r("distance"))


@query(
    "nearest_site_l2",
    with_views(
        f"{SITE_SQL}, {owner_sql('o', 'sites', L2)} SELECT set_id, count(*) AS n, {rd('sum(b[1])', 4)} AS total FROM o GROUP BY ALL",
        "raster",
    ),
)
def _(spark, sf):
    out = spt.nearest_site(pixel_points(spark, sf), pixel_sites(spark, sf), metric="l2")
    return out.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("distance"), 4).alias("total"))


@query(
    "lloyd_relaxation",
    with_views(
        f"""{SITE_SQL}, even AS (SELECT set_id, site, x, y, 1 AS beta FROM sites), {owner_sql('o1', 'even', CHEB)},
            s1 AS (SELECT o.set_id, b[2] AS site, avg(p.x) AS x, avg(p.y) AS y FROM o1 o JOIN pts p USING (set_id, point) GROUP BY ALL),
            t1 AS (SELECT s1.*, 1 AS beta FROM s1),
            {owner_sql('o2', 't1', CHEB)},
            s2 AS (SELECT o.set_id, b[2] AS site, avg(p.x) AS x, avg(p.y) AS y FROM o2 o JOIN pts p USING (set_id, point) GROUP BY ALL)
            SELECT set_id, site, {rd('x')} AS x, {rd('y')} AS y FROM s2""",
        "raster",
    ),
)
def _(spark, sf):
    out = spt.lloyd_relaxation(pixel_points(spark, sf), pixel_sites(spark, sf, stretched=False), 2, drop_empty=True)
    return out.select("set_id", "site", r("x").alias("x"), r("y").alias("y"))


@query(
    "clip_segment",
    f"""WITH s AS (SELECT event_id, CAST(1 + event_id % 98 AS DOUBLE) AS x, CAST(1 + user_id % 98 AS DOUBLE) AS y,
            radians(event_id * 37 % 360) AS a, value AS len FROM events),
        e AS (SELECT *, len * cos(a) AS dx, len * sin(a) AS dy FROM s),
        t AS (SELECT *, x + dx > 0 AND x + dx < 100 AND y + dy > 0 AND y + dy < 100 AS inside,
            least(CASE WHEN dx < -1e-9 AND y - x / dx * dy BETWEEN -1e-9 AND 99.000000001 AND -x / dx <= 1 THEN -x / dx END,
                  CASE WHEN dx > 1e-9 AND y + (99 - x) / dx * dy BETWEEN -1e-9 AND 99.000000001 AND (99 - x) / dx <= 1 THEN (99 - x) / dx END,
                  CASE WHEN dy < -1e-9 AND x - y / dy * dx BETWEEN -1e-9 AND 99.000000001 AND -y / dy <= 1 THEN -y / dy END,
                  CASE WHEN dy > 1e-9 AND x + (99 - y) / dy * dx BETWEEN -1e-9 AND 99.000000001 AND (99 - y) / dy <= 1 THEN (99 - y) / dy END) AS t FROM e)
        SELECT event_id, NOT inside AND t IS NOT NULL AS clipped, {rd('len * CASE WHEN inside THEN 1 ELSE coalesce(t, 1) END')} AS length FROM t""",
)
def _(spark, sf):
    segs = table(spark, sf, "events").select(
        "event_id",
        (1.0 + F.pmod("event_id", F.lit(98))).alias("x"),
        (1.0 + F.pmod("user_id", F.lit(98))).alias("y"),
        F.pmod(F.col("event_id") * 37, F.lit(360)).alias("angle"),
        F.col("value").alias("length"),
    )
    return spt.clip_segment(segs, 100, 100).select("event_id", "clipped", r("length").alias("length"))


@query(
    "segment_intersections",
    with_views(
        f"""WITH s AS (SELECT e.graph_id, e.src * 1000003 + e.dst AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
              FROM point_edges e JOIN points a ON a.node_id = src JOIN points b ON b.node_id = dst),
            d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s),
            p AS (SELECT a.graph_id, a.seg AS seg_a, b.seg AS seg_b, b.x1, b.y1, b.dx, b.dy,
                a.dx * b.dy - b.dx * a.dy AS area,
                (b.x1 - a.x1) * b.dy - b.dx * (b.y1 - a.y1) AS along_a,
                (b.x1 - a.x1) * a.dy - a.dx * (b.y1 - a.y1) AS along_b
              FROM d a JOIN d b ON a.graph_id = b.graph_id AND a.seg < b.seg)
            SELECT graph_id, count(*) AS n, {rd('sum(x1 + along_b / area * dx)', 4)} AS sum_x, {rd('sum(y1 + along_b / area * dy)', 4)} AS sum_y FROM p
            WHERE area <> 0 AND along_a / area BETWEEN 0 AND 1 AND along_b / area BETWEEN 0 AND 1 GROUP BY ALL""",
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    from ..operators.tables import attach_node_attrs

    e = attach_node_attrs(point_edges(spark, sf), nodes(spark, sf), ["x", "y"])
    segs = e.select(
        "graph_id",
        (F.col("src") * 1000003 + F.col("dst")).alias("seg"),
        F.col("src_x").alias("x1"),
        F.col("src_y").alias("y1"),
        F.col("dst_x").alias("x2"),
        F.col("dst_y").alias("y2"),
    )
    hits = spt.segment_intersections(segs)
    return hits.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("x"), 4).alias("sum_x"), r(F.sum("y"), 4).alias("sum_y")
    )


@query(
    "gravity_weight",
    with_views(
        f"""SELECT e.graph_id, src, dst, {rd('a.value * b.value / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} AS weight
            FROM point_edges e JOIN points a ON a.node_id = src JOIN points b ON b.node_id = dst
            WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 > 0""",
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    from ..operators.tables import attach_node_attrs

    n = points(spark, sf).withColumnRenamed("node_id", "node")
    e = attach_node_attrs(point_edges(spark, sf), n, ["x", "y", "value"])
    d2 = F.pow(F.col("src_x") - F.col("dst_x"), 2) + F.pow(F.col("src_y") - F.col("dst_y"), 2)
    w = gravity_weight(F.col("src_value"), F.col("dst_value"), d2)
    return e.where(d2 > 0).select("graph_id", "src", "dst", F.round(w, 6).alias("weight"))


@query(
    "exclude_existing",
    with_views(
        "SELECT graph_id, node_id AS node FROM points EXCEPT SELECT graph_id, dst FROM point_edges", "points", "point_edges"
    ),
)
def _(spark, sf):
    candidates = nodes(spark, sf).select("graph_id", "node")
    used = point_edges(spark, sf).select("graph_id", F.col("dst").alias("node"))
    return spt.exclude_existing(candidates, used, ["graph_id", "node"])
