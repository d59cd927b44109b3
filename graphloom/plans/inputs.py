"""Graphs, points, rasters, run logs and curves derived from the given tables.

Each view has a Spark form and the same definition as SQL. All but the curve view are row-wise
projections of one table, so they add no shuffle of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 400  # events per point graph
SIDE = 100  # raster width and height
STEPS_PER_DAY_RANGE = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(col: str) -> Column:
    return F.datediff(F.to_date(F.col(col)), F.to_date(F.lit("1970-01-01")))


def r(col, digits: int = 6) -> Column:
    """Round for comparison; a string names a column."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def weekly_links(spark, sf_dir) -> DataFrame:
    """One row per shipped line: supplier to the supplier whose block holds the part."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(days("l_shipdate") / 7).alias("graph_id"),
        F.col("l_suppkey").alias("a"),
        F.floor(F.col("l_partkey") / 20).alias("b"),
        F.col("l_quantity").alias("q"),
    )


def order_items(spark, sf_dir) -> DataFrame:
    """Star graphs: the hub -1 of an order and one leaf per distinct part."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("graph_id"),
            F.lit(-1).cast("long").alias("src"),
            F.col("l_partkey").alias("dst"),
        )
        .distinct()
    )


def points(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / BLOCK).alias("graph_id"),
        e.alias("node_id"),
        F.pmod(e * 7919, F.lit(128)).alias("x"),
        F.pmod(e * 104729 + F.col("user_id"), F.lit(128)).alias("y"),
        "value",
        "event_type",
    )


def point_edges(spark, sf_dir) -> DataFrame:
    """Links of an event to its predecessor and to one a few steps further back."""
    e = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.floor(e / BLOCK).alias("graph_id"),
            e.alias("dst"),
            F.explode(
                F.array(F.lit(1).cast("long"), 2 + F.pmod("user_id", F.lit(7)))
            ).alias("step"),
        )
        .where(F.pmod("dst", F.lit(BLOCK)) >= F.col("step"))
        .select("graph_id", (F.col("dst") - F.col("step")).alias("src"), "dst")
    )


def raster(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    area = SIDE * SIDE
    return table(spark, sf_dir, "events").select(
        F.floor(e / area).alias("image_id"),
        F.pmod(e, F.lit(SIDE)).alias("x"),
        F.floor(F.pmod(e, F.lit(area)) / SIDE).alias("y"),
        F.col("value").alias("v"),
    )


def run_log(spark, sf_dir) -> DataFrame:
    """Runs by supplier, generations by month of shipping."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        (month - 1995 * 12 - 1).alias("generation"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("p"),
        (F.col("l_quantity") / 50).alias("beta"),
        F.col("l_extendedprice").alias("fitness"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def curves(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select("user_id", days("ts").alias("d"), "value")
        .groupBy(
            F.col("user_id").alias("curve_id"),
            (F.col("d") - days_literal("2024-01-01")).cast("long").alias("beta_idx"),
        )
        .agg(F.avg("value").alias("s"))
    )


def days_literal(day: str) -> Column:
    return F.datediff(F.to_date(F.lit(day)), F.to_date(F.lit("1970-01-01")))


VIEWS: dict[str, str] = {
    "weekly_links": """
        SELECT datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) // 7 AS graph_id,
               l_suppkey AS a, l_partkey // 20 AS b, l_quantity AS q FROM lineitem""",
    "weekly_edges": """
        SELECT DISTINCT graph_id, least(a, b) AS src, greatest(a, b) AS dst FROM weekly_links""",
    "simple_edges": """
        SELECT * FROM weekly_edges WHERE src <> dst""",
    "weighted_edges": """
        SELECT graph_id, least(a, b) AS src, greatest(a, b) AS dst, sum(q) AS weight
        FROM weekly_links WHERE a <> b GROUP BY ALL""",
    "ends": """
        SELECT graph_id, src AS node FROM simple_edges
        UNION ALL SELECT graph_id, dst FROM simple_edges""",
    "both_ways": """
        SELECT graph_id, src AS u, dst AS w FROM simple_edges
        UNION ALL SELECT graph_id, dst, src FROM simple_edges""",
    "degrees": """
        SELECT graph_id, node, CAST(count(*) AS BIGINT) AS degree FROM ends GROUP BY ALL""",
    "order_items": """
        SELECT DISTINCT l_orderkey AS graph_id, -1 AS src, l_partkey AS dst FROM lineitem""",
    "stars": """
        SELECT l_orderkey AS graph_id, CAST(count(DISTINCT l_partkey) AS BIGINT) AS leaves
        FROM lineitem GROUP BY ALL""",
    "star_spectrum": """
        SELECT graph_id, 0 AS rank, CAST(0 AS DOUBLE) AS lam, leaves FROM stars
        UNION ALL
        SELECT graph_id, UNNEST(range(1, leaves)) AS rank, CAST(1 AS DOUBLE), leaves FROM stars
        UNION ALL
        SELECT graph_id, leaves, CAST(leaves + 1 AS DOUBLE), leaves FROM stars""",
    "points": f"""
        SELECT event_id // {BLOCK} AS graph_id, event_id AS node_id,
               event_id * 7919 % 128 AS x, (event_id * 104729 + user_id) % 128 AS y,
               value, event_type FROM events""",
    "point_edges": f"""
        SELECT graph_id, dst - step AS src, dst FROM (
          SELECT event_id // {BLOCK} AS graph_id, event_id AS dst,
                 UNNEST([1, 2 + user_id % 7]) AS step FROM events)
        WHERE dst % {BLOCK} >= step""",
    "raster": f"""
        SELECT event_id // {SIDE * SIDE} AS image_id, event_id % {SIDE} AS x,
               (event_id % {SIDE * SIDE}) // {SIDE} AS y, value AS v FROM events""",
    "run_log": """
        SELECT l_suppkey AS run_id,
               CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1995 * 12 - 1 AS BIGINT) AS generation,
               l_discount AS d, l_tax AS p, l_quantity / 50 AS beta, l_extendedprice AS fitness,
               l_orderkey AS order_id, l_partkey AS part_id, CAST(l_linenumber AS BIGINT) AS line
        FROM lineitem""",
    "top10": """
        SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY run_id, generation
          ORDER BY fitness DESC, d, p, beta, order_id, part_id, line) <= 10""",
    "curves": """
        SELECT user_id AS curve_id,
               CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS beta_idx,
               avg(value) AS s FROM events GROUP BY ALL""",
}

NEEDS: dict[str, list[str]] = {
    "weekly_edges": ["weekly_links"],
    "simple_edges": ["weekly_edges"],
    "weighted_edges": ["weekly_links"],
    "ends": ["simple_edges"],
    "both_ways": ["simple_edges"],
    "degrees": ["ends"],
    "star_spectrum": ["stars"],
    "top10": ["run_log"],
}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the named views and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in views:
        visit(name)
    ctes = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def rd(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r``: rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
