"""Queries on rasters of event values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import histogram as hg
from ..operators import rasters as rs
from ..operators import scaling as sl
from ..operators import spatial as spt
from .inputs import r, rd, raster, table, with_views
from .registry import query

OFFSETS = "(SELECT dx, dy FROM (SELECT UNNEST([-1, 0, 1]) AS dx), (SELECT UNNEST([-1, 0, 1]) AS dy))"
# image sizes, and the mirrored, repeated or missing neighbour of every pixel
NEAR = """dims AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY ALL),
    pos AS (SELECT r.image_id, r.x, r.y, o.dx, o.dy, r.x + o.dx AS ax, r.y + o.dy AS ay, mx, my
      FROM raster r JOIN dims USING (image_id), {o} o),
    mir AS (SELECT image_id, x, y, dx, dy, CASE WHEN ax < 0 THEN 1 WHEN ax > mx THEN mx - 1 ELSE ax END AS sx,
      CASE WHEN ay < 0 THEN 1 WHEN ay > my THEN my - 1 ELSE ay END AS sy FROM pos),
    rep AS (SELECT image_id, x, y, dx, dy, greatest(0, least(ax, mx)) AS sx, greatest(0, least(ay, my)) AS sy FROM pos),
    cut AS (SELECT image_id, x, y, dx, dy, ax AS sx, ay AS sy FROM pos WHERE ax BETWEEN 0 AND mx AND ay BETWEEN 0 AND my)""".format(
    o=OFFSETS
)
KX = "dx * (2 - abs(dy))"
KY = "dy * (2 - abs(dx))"


def clean_angle(gx, gy):
    """Direction from the two parts, tiny ones set to zero."""
    cx = f"CASE WHEN abs({gx}) > 1e-10 THEN {gx} ELSE 0 END"
    cy = f"CASE WHEN abs({gy}) > 1e-10 THEN {gy} ELSE 0 END"
    return f"degrees(atan2({cy}, {cx})) + 180"


def classes(spark, sf):
    """Label map of the brightness classes, and a binary map of the bright pixels."""
    return raster(spark, sf).select(
        "image_id", "x", "y", F.floor(F.col("v") / 20).alias("label"), F.when(F.col("v") > 15, 255).otherwise(0).alias("b")
    )


@query(
    "gradient_angles_sobel",
    with_views(
        f"""WITH {NEAR}, g AS (SELECT m.image_id, m.x, m.y, sum({KX} * v) AS gx, sum({KY} * v) AS gy
              FROM mir m JOIN raster r ON r.image_id = m.image_id AND r.x = m.sx AND r.y = m.sy GROUP BY ALL)
            SELECT image_id, x, y, {rd(clean_angle('gy', 'gx'), 5)} AS angle FROM g WHERE abs(gx) > 1e-10 OR abs(gy) > 1e-10""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.gradient_angles_sobel(raster(spark, sf)).select("image_id", "x", "y", r("angle", 5).alias("angle"))


G5, D5 = rs.gaussian_line(5, 1.0)


@query(
    "gradient_angles_gaussian",
    with_views(
        f"""WITH dims AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY ALL),
            k AS (SELECT UNNEST([-2, -1, 0, 1, 2]) AS o, UNNEST({G5}) AS g, UNNEST({D5}) AS d),
            c AS (SELECT p.image_id, p.x, p.y, sum(ky.d * kx.g * s.v) AS cx, sum(ky.g * kx.d * s.v) AS cy
              FROM raster p JOIN dims USING (image_id) CROSS JOIN k kx CROSS JOIN k ky
              JOIN raster s ON s.image_id = p.image_id AND s.x = greatest(0, least(mx, p.x - kx.o)) AND s.y = greatest(0, least(my, p.y - ky.o))
              GROUP BY ALL)
            SELECT image_id, x, y, {rd(clean_angle('cx', 'cy'), 5)} AS angle FROM c WHERE abs(cx) > 1e-10 OR abs(cy) > 1e-10""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.gradient_angles_gaussian(raster(spark, sf)).select("image_id", "x", "y", r("angle", 5).alias("angle"))


@query(
    "region_angle_histogram",
    with_views(
        f"""WITH {NEAR}, lab AS (SELECT image_id, x, y, v, 1 + y // 20 * CAST(ceil((mx + 1) / 20) AS BIGINT) + x // 20 AS label FROM raster JOIN dims USING (image_id)),
            g AS (SELECT m.image_id, l.label, m.x, m.y, sum({KX} * v) AS gx, sum({KY} * v) AS gy
              FROM mir m JOIN lab l ON l.image_id = m.image_id AND l.x = m.sx AND l.y = m.sy GROUP BY ALL),
            a AS (SELECT image_id, label, {clean_angle('gy', 'gx')} AS angle FROM g WHERE abs(gx) > 1e-10 OR abs(gy) > 1e-10),
            c AS (SELECT image_id, label, CAST(least(floor(angle / 3 + 1e-9), 119) AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY ALL)
            SELECT image_id, label, bin, {rd('n / sum(n) OVER (PARTITION BY image_id, label)')} AS pdf FROM c""",
        "raster",
    ),
)
def _(spark, sf):
    angles = rs.region_angles(rs.square_segments(raster(spark, sf), 20))
    # directions of exact multiples of the bin width differ in the last digit between engines
    h = rs.angle_histogram(angles.withColumn("angle", F.round("angle", 9)))
    return h.select("image_id", "label", F.posexplode("pdf").alias("bin", "pdf")).where("pdf > 0").withColumn("pdf", r("pdf"))


@query(
    "boundary_pixels",
    with_views(
        f"""WITH {NEAR}, lab AS (SELECT image_id, x, y, floor(v / 20) AS l FROM raster)
            SELECT m.image_id, m.x, m.y, CASE WHEN sum({KX} * l) <> 0 OR sum({KY} * l) <> 0 THEN 255 ELSE 0 END AS boundary
            FROM rep m JOIN lab l ON l.image_id = m.image_id AND l.x = m.sx AND l.y = m.sy GROUP BY m.image_id, m.x, m.y""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.boundary_pixels(classes(spark, sf)).select("image_id", "x", "y", "boundary")


@query(
    "grid_neighbors",
    with_views(
        f"""WITH {NEAR} SELECT m.image_id, m.x, m.y, a.v, m.sx AS nx, m.sy AS ny, b.v AS nv FROM cut m
            JOIN raster a ON a.image_id = m.image_id AND a.x = m.x AND a.y = m.y
            JOIN raster b ON b.image_id = m.image_id AND b.x = m.sx AND b.y = m.sy WHERE abs(dx) + abs(dy) = 1""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.grid_neighbors(raster(spark, sf), 4)


@query(
    "region_adjacency",
    with_views(
        f"""WITH {NEAR}, lab AS (SELECT image_id, x, y, CAST(floor(v / 20) AS BIGINT) AS l FROM raster)
            SELECT DISTINCT m.image_id, a.l AS src, b.l AS dst FROM cut m
            JOIN lab a ON a.image_id = m.image_id AND a.x = m.x AND a.y = m.y
            JOIN lab b ON b.image_id = m.image_id AND b.x = m.sx AND b.y = m.sy WHERE a.l < b.l""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.region_adjacency(classes(spark, sf))


@query(
    "crossing_number_nodes",
    with_views(
        f"""WITH {NEAR}, bin AS (SELECT image_id, x, y, CASE WHEN v > 15 THEN 1 ELSE 0 END AS b FROM raster),
            ring AS (SELECT * FROM (VALUES (0, -1, 0), (1, -1, 1), (1, 0, 2), (1, 1, 3), (0, 1, 4), (-1, 1, 5), (-1, 0, 6), (-1, -1, 7)) t(dx, dy, k)),
            n AS (SELECT m.image_id, m.x, m.y, k, b FROM cut m JOIN ring USING (dx, dy)
              JOIN bin b ON b.image_id = m.image_id AND b.x = m.sx AND b.y = m.sy),
            c AS (SELECT a.image_id, a.x, a.y, count(*) AS seen, sum(CASE WHEN a.b = 0 AND z.b = 1 THEN 1 ELSE 0 END) AS crossings
              FROM n a JOIN n z ON z.image_id = a.image_id AND z.x = a.x AND z.y = a.y AND z.k = (a.k + 1) % 8 GROUP BY ALL)
            SELECT c.image_id, c.x, c.y, CAST(crossings AS INTEGER) AS crossings FROM c JOIN bin USING (image_id, x, y)
            WHERE seen = 8 AND bin.b = 1 AND (crossings = 1 OR crossings >= 3)""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.crossing_number_nodes(classes(spark, sf), value="b").select("image_id", "x", "y", "crossings")


@query("nonzero_pixels", with_views("SELECT DISTINCT image_id, x, y FROM raster WHERE v > 15", "raster"))
def _(spark, sf):
    return rs.nonzero_pixels(classes(spark, sf), value="b")


@query(
    "bilinear_resample",
    with_views(
        f"""WITH dims AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY ALL),
            o AS (SELECT image_id, i, j, mx / 149.0 * i AS px, my / 39.0 * j AS py FROM dims,
              (SELECT UNNEST(range(150)) AS i), (SELECT UNNEST(range(40)) AS j))
            SELECT o.image_id, CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y,
              {rd('a.v * (1 - (px - floor(px))) * (1 - (py - floor(py))) + b.v * (px - floor(px)) * (1 - (py - floor(py))) + c.v * (py - floor(py)) * (1 - (px - floor(px))) + d.v * (px - floor(px)) * (py - floor(py))')} AS v
            FROM o JOIN raster a ON a.image_id = o.image_id AND a.x = floor(px) AND a.y = floor(py)
            JOIN raster b ON b.image_id = o.image_id AND b.x = ceil(px) AND b.y = floor(py)
            JOIN raster c ON c.image_id = o.image_id AND c.x = floor(px) AND c.y = ceil(py)
            JOIN raster d ON d.image_id = o.image_id AND d.x = ceil(px) AND d.y = ceil(py)""",
        "raster",
    ),
)
def _(spark, sf):
    return rs.bilinear_resample(raster(spark, sf), 40, 150).withColumn("v", r("v"))


@query(
    "tile_grid",
    with_views(
        f"""SELECT image_id, x // 32 * 32 AS tile_x, y // 32 * 32 AS tile_y, (x // 32 * 32) || '_' || (y // 32 * 32) AS tile,
              count(*) AS n, {rd('sum(v)', 4)} AS total FROM raster GROUP BY ALL""",
        "raster",
    ),
)
def _(spark, sf):
    t = rs.tile_grid(raster(spark, sf), 32, 32)
    return t.groupBy("image_id", "tile_x", "tile_y", "tile").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 4).alias("total"))


@query(
    "tile_grid_shifted",
    with_views(
        f"""WITH d AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, (max(y) + 1) // 8 AS t FROM raster GROUP BY ALL)
            SELECT image_id, (x - t) // 32 * 32 + t AS tile_x, (y - t) // 32 * 32 + t AS tile_y, count(*) AS n, {rd('sum(v)', 4)} AS total
            FROM raster JOIN d USING (image_id) WHERE x >= t AND x < w - t AND y >= t AND y < h - t GROUP BY ALL""",
        "raster",
    ),
)
def _(spark, sf):
    t = rs.tile_grid_shifted(raster(spark, sf), 32, 32)
    return t.groupBy("image_id", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 4).alias("total"))


@query(
    "array_split_tiles",
    with_views(
        f"""WITH d AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM raster GROUP BY ALL),
            s AS (SELECT image_id, v, CASE WHEN x < (w // 7 + 1) * (w % 7) THEN x // (w // 7 + 1) ELSE w % 7 + (x - (w // 7 + 1) * (w % 7)) // (w // 7) END AS cx,
                CASE WHEN y < (h // 3 + 1) * (h % 3) THEN y // (h // 3 + 1) ELSE h % 3 + (y - (h // 3 + 1) * (h % 3)) // (h // 3) END AS cy
              FROM raster JOIN d USING (image_id))
            SELECT image_id, cy * 7 + cx AS tile, count(*) AS n, {rd('sum(v)', 4)} AS total FROM s GROUP BY ALL""",
        "raster",
    ),
)
def _(spark, sf):
    t = rs.array_split_tiles(raster(spark, sf), 3, 7)
    return t.groupBy("image_id", "tile").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 4).alias("total"))


@query(
    "random_tiles",
    with_views(
        """WITH d AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM raster GROUP BY ALL),
           o AS (SELECT image_id, x AS tile_x, y AS tile_y FROM raster JOIN d USING (image_id)
             WHERE x <= w - 8 AND y <= h - 8 AND NOT (x % 8 = 0 AND y % 8 = 0)
             QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('3-' || image_id || '-' || x || '-' || y), x, y) <= 15)
           SELECT r.image_id, x, y, v, tile_x, tile_y, tile_x || '_' || tile_y AS tile FROM raster r JOIN o USING (image_id)
           WHERE x >= tile_x AND x < tile_x + 8 AND y >= tile_y AND y < tile_y + 8""",
        "raster",
    ),
)
def _(spark, sf):
    pix = raster(spark, sf)
    fixed = rs.tile_grid(pix, 8, 8).select("image_id", "tile_x", "tile_y").distinct()
    origins = rs.random_tile_origins(pix, 8, 8, 15, seed=3, exclude=fixed)
    return rs.cut_tiles(pix, origins, 8, 8)


LAB = """lab AS (SELECT image_id, x, y, v, 1 + y // 12 * CAST(ceil(w / 12) AS BIGINT) + x // 12 AS label
    FROM raster JOIN (SELECT image_id, max(x) + 1 AS w FROM raster GROUP BY ALL) USING (image_id))"""


@query("square_segments", with_views(f"WITH {LAB} SELECT image_id, x, y, label FROM lab", "raster"))
def _(spark, sf):
    return rs.square_segments(raster(spark, sf), 12).select("image_id", "x", "y", "label")


@query(
    "region_props",
    with_views(
        f"""WITH {LAB} SELECT image_id, label, {rd('avg(x)')} AS coord_x, {rd('avg(y)')} AS coord_y, {rd('avg(v)')} AS mean_intensity,
            max(v) AS intensity_max, count(*) AS area, {rd('sqrt(4 * count(*) / pi())')} AS equivalent_diameter FROM lab GROUP BY ALL""",
        "raster",
    ),
)
def _(spark, sf):
    p = rs.region_props(rs.square_segments(raster(spark, sf), 12))
    cols = ("coord_x", "coord_y", "mean_intensity", "equivalent_diameter")
    return p.withColumns({c: r(c) for c in cols})


@query(
    "mask_outside",
    with_views(
        f"WITH {LAB} SELECT image_id, x, y, CASE WHEN label = 5 THEN v ELSE CAST(0 AS DOUBLE) END AS v FROM lab", "raster"
    ),
)
def _(spark, sf):
    m = rs.mask_outside(rs.square_segments(raster(spark, sf), 12), 5)
    return m.select("image_id", "x", "y", "v")


@query(
    "otsu_threshold",
    with_views(
        f"""WITH g AS (SELECT image_id, 255 - CAST(trunc((v - min(v) OVER i) / (max(v) OVER i - min(v) OVER i) * CAST(255.9 AS DOUBLE)) AS BIGINT) AS level
              FROM raster WINDOW i AS (PARTITION BY image_id)),
            c AS (SELECT image_id, level, count(*) AS n FROM g GROUP BY ALL),
            k AS (SELECT a.image_id, a.level, sum(CASE WHEN b.level <= a.level THEN b.n ELSE 0 END) AS w0, sum(CASE WHEN b.level <= a.level THEN b.n * b.level ELSE 0 END) AS s0,
                sum(b.n) AS w, sum(b.n * b.level) AS s FROM c a JOIN c b USING (image_id) GROUP BY ALL),
            v AS (SELECT image_id, level, w0 / w * (w - w0) / w * power(s0 / w0 - (s - s0) / (w - w0), 2) AS bv FROM k WHERE w0 < w)
            SELECT image_id, level AS threshold, {rd('bv', 4)} AS between_variance FROM v
            QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY bv DESC, level) = 1""",
        "raster",
    ),
)
def _(spark, sf):
    gray = sl.to_uint8(raster(spark, sf), "v", "image_id")
    return hg.otsu_threshold(gray, "v", "image_id").withColumn("between_variance", r("between_variance", 4))


def regions(spark, sf, size=10):
    pix = rs.square_segments(raster(spark, sf), size)
    pdf = rs.angle_histogram(rs.region_angles(pix))
    return rs.region_props(pix).join(pdf, ["image_id", "label"])


@query(
    "radius_neighbors",
    with_views(
        f"""WITH lab AS (SELECT image_id, x, y, v, 1 + y // 10 * 10 + x // 10 AS label FROM raster),
            p AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy, sqrt(4 * count(*) / pi()) AS d FROM lab GROUP BY ALL),
            m AS (SELECT image_id, sqrt(2) * avg(d) AS r FROM p GROUP BY ALL)
            SELECT a.image_id, a.label AS src, b.label AS dst, {rd('sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)')} AS distance
            FROM p a JOIN p b ON a.image_id = b.image_id AND a.label < b.label JOIN m ON m.image_id = a.image_id
            WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < r""",
        "raster",
    ),
)
def _(spark, sf):
    p = rs.region_props(rs.square_segments(raster(spark, sf), 10))
    nodes = p.select("image_id", F.col("label").alias("node"), F.col("coord_x").alias("x"), F.col("coord_y").alias("y"), "equivalent_diameter")
    return spt.radius_neighbors(nodes).withColumn("distance", r("distance"))


def region_graph(spark, sf):
    props = regions(spark, sf)
    nodes = props.select("image_id", F.col("label").alias("node"), F.col("coord_x").alias("x"), F.col("coord_y").alias("y"), "equivalent_diameter")
    return props, rs.angular_edge_weights(props, spt.radius_neighbors(nodes))


@query(
    "angular_edge_weights",
    with_views(
        f"""WITH {NEAR}, lab AS (SELECT image_id, x, y, v, 1 + y // 10 * 10 + x // 10 AS label FROM raster),
            p AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy, sqrt(4 * count(*) / pi()) AS d FROM lab GROUP BY ALL),
            m AS (SELECT image_id, sqrt(2) * avg(d) AS r FROM p GROUP BY ALL),
            g AS (SELECT m.image_id, l.label, m.x, m.y, sum({KX} * v) AS gx, sum({KY} * v) AS gy
              FROM mir m JOIN lab l ON l.image_id = m.image_id AND l.x = m.sx AND l.y = m.sy GROUP BY ALL),
            a AS (SELECT image_id, label, round({clean_angle('gy', 'gx')}, 9) AS angle FROM g WHERE abs(gx) > 1e-10 OR abs(gy) > 1e-10),
            c AS (SELECT image_id, label, CAST(least(floor(angle / 3), 119) AS BIGINT) AS bin, count(*) AS n FROM a GROUP BY ALL),
            h AS (SELECT image_id, label, (bin + 1) * 3 AS edge, n / sum(n) OVER (PARTITION BY image_id, label) AS q FROM c),
            pairs AS (SELECT a.image_id, a.label AS s, b.label AS t, degrees(atan2(b.cy - a.cy, b.cx - a.cx)) + 180 AS g,
                degrees(atan2(a.cy - b.cy, a.cx - b.cx)) + 180 AS k, degrees(atan(0.5)) AS al
              FROM p a JOIN p b ON a.image_id = b.image_id AND a.label < b.label JOIN m ON m.image_id = a.image_id
              WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < r),
            dirs AS (SELECT image_id, s, t, 0 AS way, t AS label, g AS gam, al FROM pairs UNION ALL SELECT image_id, s, t, 1, s, k, al FROM pairs),
            mass AS (SELECT d.image_id, s, t, way, coalesce(sum(q) FILTER (WHERE CASE WHEN gam + al > 360 THEN edge < gam + al - 360 OR edge >= gam - al
                WHEN gam - al < 3 THEN edge <= gam + al OR edge > 360 - (al - gam) ELSE edge < gam + al AND edge >= gam - al END), 0) AS w
              FROM dirs d LEFT JOIN h USING (image_id, label) GROUP BY ALL)
            SELECT image_id, s AS src, t AS dst, {rd('sum(CASE WHEN w <= 0 THEN 0 ELSE -1 / ln(w) END)')} AS weight FROM mass GROUP BY ALL""",
        "raster",
    ),
)
def _(spark, sf):
    pix = rs.square_segments(raster(spark, sf), 10)
    angles = rs.region_angles(pix).withColumn("angle", F.round("angle", 9))
    props = rs.region_props(pix).join(rs.angle_histogram(angles), ["image_id", "label"])
    nodes = props.select("image_id", F.col("label").alias("node"), F.col("coord_x").alias("x"), F.col("coord_y").alias("y"), "equivalent_diameter")
    out = rs.angular_edge_weights(props, spt.radius_neighbors(nodes))
    return out.select("image_id", "src", "dst", r("weight").alias("weight"))


@query("sequence_complexity")
def _(spark, sf):
    return rs.sequence_complexity(table(spark, sf, "events"), ["ts", "event_id"], "event_type", "user_id")


@query("region_complexity")
def _(spark, sf):
    gray = sl.to_uint8(raster(spark, sf), "v", "image_id")
    return rs.sequence_complexity(rs.square_segments(gray, 10), ["y", "x"], "v", ["image_id", "label"])
