"""Equal-width histograms, mass functions and cumulative functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, join_stats, names


def with_bin(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Add ``bin`` of ``col`` among equal bins of ``[_lo, _hi]``, closed on the left, the last one on
    both sides; null outside.

    The position from the division is corrected against the edges themselves, as rounding can put
    a value that lies on an edge one bin off. The steps are columns of their own: as one expression
    they would repeat the value dozens of times.
    """
    x, lo, hi = F.col(col), F.col("_lo"), F.col("_hi")
    step = (hi - lo) / bins
    raw, low = F.col("_raw"), F.col("_low")
    inside = (x >= lo) & (x <= hi)
    return (
        df.withColumn("_raw", F.when(inside, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))))
        .withColumn("_low", F.when(x < lo + raw * step, raw - 1).otherwise(raw))
        .withColumn("bin", F.when((x >= lo + (low + 1) * step) & (low < bins - 1), low + 1).otherwise(low).cast("long"))
        .drop("_raw", "_low")
    )


def _fill(counts: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    """All bins of every range with their counts, mass and cumulative mass."""
    step = (F.col("_hi") - F.col("_lo")) / bins
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")))
    joined = grid.join(counts, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * step).alias("left_edge"),
        F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * step).alias("right_edge"),
        n.alias("n"),
        F.try_divide(n, F.sum(n).over(whole)).alias("pdf"),
        F.try_divide(F.sum(n).over(upto) - n, F.sum(n).over(whole)).alias("cdf_left"),
        F.try_divide(F.sum(n).over(upto), F.sum(n).over(whole)).alias("cdf"),
    )


def ranges_of(df: DataFrame, col: str, key: Key = None) -> DataFrame:
    """Smallest and largest value per group; a single value is widened by a half on each side."""
    lo, hi = F.min(col).cast("double"), F.max(col).cast("double")
    return df.groupBy(*names(key)).agg(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("_lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("_hi"),
    )


def empirical_pdf_cdf(
    df: DataFrame,
    col: str,
    bins: int = 100,
    key: Key = None,
    limits: tuple[float, float] | DataFrame | None = None,
) -> DataFrame:
    """Mass per bin (sums to one) and cumulative mass at both edges of the bin, per group.

    ``limits`` fixes the range: a pair of numbers, or a table ``(_lo, _hi)`` with all or none of the
    key columns; by default each group spans its own values. Rows are counted per bin before any
    exchange, so only ``bins`` rows per group and task are shuffled. Masses of a group without a value in
    its range are null.
    """
    by = names(key)
    if limits is None:
        limits = ranges_of(df, col, key)
    if isinstance(limits, DataFrame):
        shared = [c for c in by if c in limits.columns]
        if shared:
            ranged = join_stats(df, limits, shared)
        else:
            ranged = df.withColumn("_one", F.lit(1)).join(
                F.broadcast(limits.withColumn("_one", F.lit(1))), "_one"
            )
    else:
        ranged = df.withColumns({"_lo": F.lit(float(limits[0])), "_hi": F.lit(float(limits[1]))})
    binned = with_bin(ranged, col, bins)
    counts = binned.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    inside = counts.where(F.col("bin").isNotNull()).select(*by, "bin", "n")
    if not by:
        ranges, inside = ranges.withColumn("_g", F.lit(0)), inside.withColumn("_g", F.lit(0))
        return _fill(inside, ranges, ["_g"], bins).drop("_g")
    return _fill(inside, ranges, by, bins)


def shared_range(df: DataFrame, col: str, low_margin: float = 0.0) -> DataFrame:
    """One range for all groups, from min - margin to max."""
    return df.agg(
        (F.min(col).cast("double") - low_margin).alias("_lo"), F.max(col).cast("double").alias("_hi")
    )


def histogram_compare(df: DataFrame, col: str, edges: int, key: Key) -> tuple[DataFrame, DataFrame]:
    """Histograms of several corpora on shared edges from min - 3 to max, and their mean and std."""
    by = names(key)
    hist = empirical_pdf_cdf(df, col, edges - 1, key, shared_range(df, col, 3.0))
    moments = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    return hist, moments


def histogram_array(df: DataFrame, col: str, lo: float, hi: float, bins: int, key: Key) -> DataFrame:
    """Mass per bin as one array per group."""
    hist = empirical_pdf_cdf(df, col, bins, key, (lo, hi))
    return hist.groupBy(*names(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "pdf"))), lambda s: s["pdf"]).alias("pdf")
    )


def chi2_between(a: DataFrame, b: DataFrame, key: Key = None) -> DataFrame:
    """Half chi-square distance of long histograms ``(key, bin, pdf)`` on the same bins.

    Key columns that ``b`` lacks are matched to all of it, bin by bin.
    """
    by = names(key)
    shared = [c for c in by if c in b.columns]
    eps = F.lit(2.220446049250313e-16)
    pair = a.select(*by, "bin", F.col("pdf").alias("p")).join(
        b.select(*shared, "bin", F.col("pdf").alias("q")), [*shared, "bin"]
    )
    p, q = F.col("p") + eps, F.col("q") + eps
    return pair.groupBy(*by).agg((0.5 * F.sum((p - q) * (p - q) / (p + q))).alias("chi2"))


def otsu_threshold(df: DataFrame, col: str, key: Key) -> DataFrame:
    """Gray level 0..255 that maximises the variance between the two classes it separates.

    Works on the 256 counts per image, so pixels are combined before the exchange. The class up to
    and including the threshold is the lower one; ties go to the smallest level.
    """
    by = names(key)
    counts = df.groupBy(*by, F.col(col).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    n, level = F.col("n"), F.col("level")
    cumulated = counts.select(
        *by,
        "level",
        F.sum(n).over(upto).alias("_w0"),
        F.sum(n * level).over(upto).alias("_s0"),
        F.sum(n).over(whole).alias("_w"),
        F.sum(n * level).over(whole).alias("_s"),
    ).where(F.col("_w0") < F.col("_w"))
    w1 = F.col("_w") - F.col("_w0")
    gap = F.col("_s0") / F.col("_w0") - (F.col("_s") - F.col("_s0")) / w1
    between = (F.col("_w0") / F.col("_w")) * (w1 / F.col("_w")) * gap * gap
    return (
        cumulated.withColumn("between", between)
        .groupBy(*by)
        .agg(
            F.max_by("level", F.struct(F.col("between"), -F.col("level"))).alias("threshold"),
            F.max("between").alias("between_variance"),
        )
    )


def prune_thresholds(edges: DataFrame, shares: list[float], key: Key, bins: int = 100) -> DataFrame:
    """Weight below which an edge is pruned, per group and share: the last bin edge whose cumulative
    mass stays below the share, or 0 where there is none."""
    by = names(key)
    cdf = empirical_pdf_cdf(edges, "weight", bins, key)
    points = cdf.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("left_edge").alias("edge"), F.col("cdf_left").alias("mass")),
                F.struct(F.col("right_edge").alias("edge"), F.col("cdf").alias("mass")),
            )
        ).alias("_p"),
    ).select(*by, "_p.*")
    grid = points.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    best = F.max(F.when(F.col("mass") < F.col("share"), F.col("edge")))
    return grid.groupBy(*by, "share").agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def prune_edges(edges: DataFrame, shares: list[float], key: Key = "graph_id", bins: int = 100) -> DataFrame:
    """Edges heavier than the threshold, for every share of the sweep in one job."""
    by = names(key)
    limits = prune_thresholds(edges, shares, key, bins)
    # one row per group holding its thresholds: the edges are joined once and copied only if kept
    packed = limits.groupBy(*by).agg(F.collect_list(F.struct("share", "threshold")).alias("_limits"))
    kept = F.filter("_limits", lambda t: F.col("weight") > t["threshold"])
    return (
        join_stats(edges, packed, by)
        .withColumn("_kept", F.explode(kept))
        .withColumn("share", F.col("_kept.share"))
        .drop("_limits", "_kept")
    )


