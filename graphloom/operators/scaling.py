"""Per-group scaling of a column, and exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, attach_stats, join_stats, names
from ..functions.scalars import mapped, order_of_magnitude
from ..staging import release, stage


def minmax_scale(df: DataFrame, col: str, lo: float = -1.0, hi: float = 1.0, key: Key = None, out: str | None = None):
    """Affine map of each group's range onto [lo, hi]; null where a group has a single value."""
    both = attach_stats(df, key, [F.min(col).alias("_lo"), F.max(col).alias("_hi")])
    scaled = mapped(F.col(col), F.col("_lo"), F.col("_hi"), F.lit(lo), F.lit(hi))
    return both.withColumn(out or col, scaled).drop("_lo", "_hi")


def sum_normalize(df: DataFrame, col: str, key: Key = None, out: str | None = None) -> DataFrame:
    both = attach_stats(df, key, [F.sum(col).alias("_t")])
    return both.withColumn(out or col, F.try_divide(F.col(col), F.col("_t"))).drop("_t")


def standardize(df: DataFrame, cols: list[str], key: Key = None) -> DataFrame:
    """Zero mean and unit population std, column by column; constant columns become zero."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    both = attach_stats(df, key, aggs)
    for c in cols:
        spread = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        both = both.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / spread)
    return both.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def softmax(df: DataFrame, col: str, key: Key = None, out: str | None = None) -> DataFrame:
    """exp(x - max) over its sum."""
    lifted = attach_stats(df, key, [F.max(col).alias("_top")]).withColumn(
        "_e", F.exp(F.col(col) - F.col("_top"))
    )
    both = attach_stats(lifted, key, [F.sum("_e").alias("_t")])
    return both.withColumn(out or col, F.col("_e") / F.col("_t")).drop("_top", "_e", "_t")


def to_uint8(df: DataFrame, col: str, key: Key = None, invert: bool = True, out: str | None = None) -> DataFrame:
    """Gray levels from the range of each group: 255.9 times the share, truncated, inverted."""
    both = attach_stats(df, key, [F.min(col).alias("_lo"), F.max(col).alias("_hi")])
    share = F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    level = (share * 255.9).cast("int")
    return both.withColumn(out or col, (255 - level) if invert else level).drop("_lo", "_hi")


def order_of_magnitude_range(df: DataFrame, col: str, key: Key = None) -> DataFrame:
    order = order_of_magnitude(F.col(col))
    return df.groupBy(*names(key)).agg(F.min(order).alias("min_order"), F.max(order).alias("max_order"))


def exact_percentiles(
    df: DataFrame, col: str, shares: list[float], key: Key = None, window_rows: int = 1_000_000, buckets: int = 1024
) -> DataFrame:
    """Linear-interpolated percentiles ``(key, share, value)`` of any group size.

    Values are first counted, which combines before the exchange. Groups with few distinct values
    are ranked in a window. In larger ones the two order statistics of each share are closed in on by
    counting over ever finer buckets until few distinct values are left, so no task sorts a group.
    """
    by = names(key)
    spark = df.sparkSession
    counted = stage(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    totals = counted.df.groupBy(*by).agg(F.sum("c").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    spot = (F.col("_n") - 1) * F.col("share")
    targets = (
        totals.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("_pos", spot)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .select(*by, "share", "rank", F.lit(0).cast("long").alias("below"), "_lo", "_hi", "_pos")
    )
    hunt = stage(targets)
    while True:
        inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
        near = (
            hunt.df.join(counted.df, by) if by else hunt.df.withColumn("_1", F.lit(1)).join(
                counted.df.withColumn("_1", F.lit(1)), "_1"
            ).drop("_1")
        ).where(inside)
        load = near.groupBy(*by, "share", "rank").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0]
        if load is None or load <= window_rows:
            break
        width = (F.col("_hi") - F.col("_lo")) / buckets
        # a hunt that has closed in on one value has no width left and stays in slot 0
        step = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_lo"), width)), F.lit(0).cast("long"))
        slot = F.least(step, F.lit(buckets - 1))
        held = ["share", "rank", "below", "_pos"]
        per = near.groupBy(*by, *held, slot.alias("slot")).agg(
            F.sum("c").alias("c"), F.min("v").alias("_lo"), F.max("v").alias("_hi")
        )
        run = Window.partitionBy(*by, "share", "rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.col("below") + F.sum("c").over(run)
        narrowed = per.withColumn("_end", seen).where(
            (F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("c") <= F.col("rank"))
        )
        following = stage(
            narrowed.select(*by, "share", "rank", (F.col("_end") - F.col("c")).alias("below"), "_lo", "_hi", "_pos")
        )
        release(spark, hunt)
        hunt = following
    run = Window.partitionBy(*by, "share", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        near.withColumn("_end", F.col("below") + F.sum("c").over(run))
        .where((F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("c") <= F.col("rank")))
        .select(*by, "share", "rank", "v", "_pos")
    )
    low = F.min_by("v", "rank")
    high = F.max_by("v", "rank")
    part = F.max("_pos") - F.floor(F.max("_pos"))
    return found.groupBy(*by, "share").agg((low + (high - low) * part).alias("value"))


def percentile_stretch(df: DataFrame, col: str, low: float, high: float, key: Key) -> DataFrame:
    """Clip to the two percentiles of each group and map them to 0 and 1."""
    by = names(key)
    limits = exact_percentiles(df, col, [low / 100.0, high / 100.0], key)
    wide = limits.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    a, b = F.col("_lo"), F.col("_hi")
    clipped = F.greatest(F.least(F.col(col), b), a)
    return join_stats(df, wide, by).withColumn(col, F.try_divide(clipped - a, b - a)).drop("_lo", "_hi")


def moving_average(
    df: DataFrame, col: str, order: str, width: int, key: Key, length: int, circular: bool = True
) -> DataFrame:
    """Box filter along ``order`` (0 .. length-1) inside short sequences; wraps round or drops ends.

    Each row sends its share to the ``width`` positions it touches, and the sums combine before the
    exchange, so a sequence need not be sorted.
    """
    by = names(key)
    half = width // 2
    shifts = F.explode(F.array(*[F.lit(s) for s in range(-half, half + 1)]))
    moved = df.select(*by, F.col(order), F.col(col), shifts.alias("_s")).withColumn(
        order, F.col(order) + F.col("_s")
    )
    if circular:
        moved = moved.withColumn(order, F.pmod(order, F.lit(length)))
    else:
        moved = moved.where((F.col(order) >= half) & (F.col(order) < length - half))
    return moved.groupBy(*by, order).agg((F.sum(col) / float(width)).alias(col))


def boxcox_rescale(
    edges: DataFrame, key: Key = "graph_id", lo: float = 1e-4, hi: float = 1.0, passes: int = 3, points: int = 17
) -> DataFrame:
    """Min-max, Box-Cox with the maximum-likelihood exponent, standardise, min-max again.

    The exponent is found on a grid that narrows around the best point; every pass is one
    aggregation over all groups.
    """
    by = names(key)
    base = minmax_scale(edges, "weight", lo, hi, key)
    rows = stage(base)
    moments = rows.df.withColumn("_l", F.log("weight"))
    logs = moments.groupBy(*by).agg(F.sum("_l").alias("_sl"), F.count(F.lit(1)).alias("_n"))
    found = logs.select(*by, F.lit(0.0).alias("lam"), F.lit(4.0).alias("_span"))
    for _ in range(passes):
        grid = [i / (points // 2) - 1.0 for i in range(points)]
        trial = rows.df.select(*by, F.log("weight").alias("_l")).join(found, by)
        spread = trial.select(
            *by,
            "_l",
            "_span",
            F.explode(F.array(*[F.col("lam") + F.lit(g) * F.col("_span") for g in grid])).alias("t"),
        )
        y = F.when(F.abs("t") < 1e-12, F.col("_l")).otherwise((F.exp(F.col("t") * F.col("_l")) - 1) / F.col("t"))
        var = spread.groupBy(*by, "t").agg(F.var_pop(y).alias("_v"), F.max("_span").alias("_span"))
        scored = var.join(logs, by).withColumn(
            "_ll", -F.col("_n") / 2 * F.log("_v") + (F.col("t") - 1) * F.col("_sl")
        )
        found = stage(
            scored.groupBy(*by).agg(
                F.max_by("t", F.struct("_ll", "t")).alias("lam"), (F.max("_span") / (points // 2)).alias("_span")
            )
        ).df
    lam, log = F.col("lam"), F.log("weight")
    bent = rows.df.join(found.select(*by, "lam"), by).withColumn(
        "weight", F.when(F.abs(lam) < 1e-12, log).otherwise((F.exp(lam * log) - 1) / lam)
    )
    return minmax_scale(standardize(bent, ["weight"], key), "weight", lo, hi, key)
