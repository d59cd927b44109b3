"""Corpus means of curves, distances between them, and derivatives along the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, names


def ensemble_mean_curve(curves: DataFrame, key: Key = None, value: str = "s") -> DataFrame:
    """Mean and population std per grid point over the curves of ``key`` (array or long form)."""
    by = names(key)
    if dict(curves.dtypes)[value].startswith("array"):
        curves = curves.select(*by, F.posexplode(value).alias("beta_idx", value))
    return curves.groupBy(*by, "beta_idx").agg(
        F.avg(value).alias("mean_s"), F.stddev_pop(value).alias("std_s"), F.count(value).alias("n_curves")
    )


def pair_curves(a: DataFrame, b: DataFrame, on: Key, value: str = "s") -> DataFrame:
    """Two sets of curves side by side on the same keys and grid."""
    keys = names(on)
    left = a.select(*keys, F.col(value).alias("a"))
    return left.join(b.select(*keys, F.col(value).alias("b")), keys)


def curve_sse(paired: DataFrame, key: Key = None) -> DataFrame:
    """Sum of squared differences and fitness 1 / sse, infinite for a perfect match."""
    gap = F.col("a") - F.col("b")
    return (
        paired.groupBy(*names(key))
        .agg(F.sum(gap * gap).alias("sse"))
        .withColumn(
            "fitness", F.when(F.col("sse") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("sse")))
        )
    )


def curve_functional(curves: DataFrame, key: Key, value: str = "s") -> DataFrame:
    """X = sum of the curve over the grid."""
    return curves.groupBy(*names(key)).agg(F.sum(value).alias("x"))


def ensemble_fitness_summary(fitness: DataFrame, key: Key = None) -> DataFrame:
    return fitness.groupBy(*names(key)).agg(
        F.max("fitness").alias("max_fitness"),
        F.min("fitness").alias("min_fitness"),
        F.avg("fitness").alias("mean_fitness"),
        F.stddev_pop("fitness").alias("std_fitness"),
    )


def gradient(
    df: DataFrame, value: str, order: str, key: Key = None, x: str | None = None, edge_order: int = 1
) -> DataFrame:
    """Finite differences along ``order`` inside each curve, on index or uneven spacing.

    Interior points use the second-order formula for uneven steps; the ends are one-sided, of first
    or second order. A curve is as long as its grid, so the window stays small.
    """
    w = Window.partitionBy(*names(key)).orderBy(order)
    y = F.col(value)
    pos = F.col(x) if x else F.col(order)

    def at(col: Column, k: int) -> Column:
        return F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w)

    prev_y, next_y = at(y, 1), at(y, -1)
    hd, hs = (pos - at(pos, 1), at(pos, -1) - pos) if x else (F.lit(1.0), F.lit(1.0))
    inner = (hd * hd * next_y + (hs * hs - hd * hd) * y - hs * hs * prev_y) / (hs * hd * (hd + hs))
    if edge_order == 1:
        first, last = (next_y - y) / hs, (y - prev_y) / hd
    else:
        h1, h2 = (at(pos, -1) - pos, at(pos, -2) - at(pos, -1)) if x else (F.lit(1.0), F.lit(1.0))
        first = (
            -(2 * h1 + h2) / (h1 * (h1 + h2)) * y
            + (h1 + h2) / (h1 * h2) * next_y
            - h1 / (h2 * (h1 + h2)) * at(y, -2)
        )
        g1, g2 = (at(pos, 1) - at(pos, 2), pos - at(pos, 1)) if x else (F.lit(1.0), F.lit(1.0))
        last = (
            g2 / (g1 * (g1 + g2)) * at(y, 2)
            - (g2 + g1) / (g1 * g2) * prev_y
            + (2 * g2 + g1) / (g2 * (g1 + g2)) * y
        )
    slope = F.when(prev_y.isNull(), first).when(next_y.isNull(), last).otherwise(inner)
    return df.withColumn("gradient", slope)


def specific_heat(df: DataFrame, value: str, order: str, x: str, key: Key = None) -> DataFrame:
    """-dS/dtau * tau, with negative parts set to zero."""
    slope = gradient(df, value, order, key, x, edge_order=2)
    return slope.withColumn("heat", F.greatest(-F.col("gradient") * F.col(x), F.lit(0.0))).drop("gradient")


def specific_heat_logdiff(df: DataFrame, value: str, order: str, x: str, key: Key = None) -> DataFrame:
    """-(S[i+1] - S[i]) / (ln tau[i+1] - ln tau[i]); the last grid point has none."""
    w = Window.partitionBy(*names(key)).orderBy(order)
    rise = F.lead(value).over(w) - F.col(value)
    return df.withColumn(
        "heat", -rise / (F.lead(F.log(x)).over(w) - F.log(x))
    ).where(F.col("heat").isNotNull())


def score_candidates(
    curves: DataFrame, reference: DataFrame, candidates: DataFrame, key: Key = "candidate_id", gradient: bool = False
) -> DataFrame:
    """Fitness of every candidate's mean curve against the whole grid of the reference.

    A grid point that a candidate lacks counts as a curve of zero there; a candidate without any curve has
    fitness 0. ``gradient`` compares the slopes of both curves along the grid instead of their values.
    """
    by = names(key)
    means = ensemble_mean_curve(curves, key).select(*by, "beta_idx", F.col("mean_s").alias("a"))
    grid = reference.select("beta_idx", F.col("s").alias("b"))
    known = means.select(*by).distinct()
    # the grid has one row a point, fixed by the caller
    full = known.withColumn("_grid", F.lit(1)).join(grid.withColumn("_grid", F.lit(1)), "_grid").drop("_grid")
    paired = full.join(means, [*by, "beta_idx"], "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    if gradient:
        order = Window.partitionBy(*by).orderBy("beta_idx")
        paired = paired.withColumns({c: F.col(c) - F.lag(c).over(order) for c in ("a", "b")}).where("a IS NOT NULL")
    scored = curve_sse(paired, key)
    return candidates.select(*by).distinct().join(scored, by, "left").select(
        *by, F.coalesce("fitness", F.lit(0.0)).alias("fitness")
    )


def nan_stats(df: DataFrame, value: str, key: Key = None) -> DataFrame:
    """Mean, population std and standard error that skip NaN; groups of only NaN give NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    nan = F.lit(float("nan"))
    count = F.count(v)
    return df.groupBy(*names(key)).agg(
        F.coalesce(F.avg(v), nan).alias("mean"),
        F.coalesce(F.stddev_pop(v), nan).alias("std"),
        F.coalesce(F.stddev_pop(v) / F.sqrt(count), nan).alias("sem"),
        count.alias("n_valid"),
    )


def cumulative_offsets(df: DataFrame, value: str, order: str, key: Key = None) -> DataFrame:
    """Running totals down the rows of a small table, column by column."""
    w = Window.partitionBy(*names(key)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset", F.sum(value).over(w))


