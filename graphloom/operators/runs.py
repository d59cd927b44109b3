"""Optimizer run logs ``(run_id, generation, d, p, beta, fitness)``: top solutions, trajectories,
convergence and mixtures of fitness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, attach_stats, join_stats, names
from ..staging import stage

RUN = "run_id"
GENERATION = "generation"


def top_k_per_group(df: DataFrame, order: list[Column], k: int, key: Key) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    A rank limit is pushed below the exchange, so at most ``k`` rows per group and task are shuffled.
    """
    w = Window.partitionBy(*names(key)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_group(df: DataFrame, order: list[Column], keep: list[str], key: Key) -> DataFrame:
    """Columns ``keep`` of the row that is largest in ``order``."""
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("_b")
    return df.groupBy(*names(key)).agg(best).select(*names(key), "_b.*")


def trajectory(top: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """One value per run and generation: mean or max over its solutions."""
    agg = F.avg(value) if how == "mean" else F.max(value)
    return top.groupBy(RUN, GENERATION).agg(agg.alias(value))


def trajectory_summary(curves: DataFrame, value: str) -> DataFrame:
    """Mean, population std and standard error over runs, per generation."""
    n = F.count(value)
    return curves.groupBy(GENERATION).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (F.stddev_pop(value) / F.sqrt(n)).alias("sem"),
        n.alias("n_runs"),
    )


def last_n(df: DataFrame, n: int, key: Key = RUN, order: str = GENERATION) -> DataFrame:
    return top_k_per_group(df, [F.desc(order)], n, key)


def converged_runs(curves: DataFrame, value: str, threshold: float, n: int = 5, below: bool = True) -> DataFrame:
    """Runs whose last ``n`` generation means all lie on one side of the threshold."""
    ok = F.col(value) < threshold if below else F.col(value) > threshold
    return last_n(curves, n).groupBy(RUN).agg(F.bool_and(ok).alias("ok")).where("ok").select(RUN)


def keep_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    return join_stats(df, runs, [RUN], "left_semi")


def conditional_trajectory(top: DataFrame, mask: Column, value: str) -> DataFrame:
    """Means per run and generation over the masked solutions, then mean and SEM over runs.

    A generation without a masked solution is missing for its run and does not count.
    """
    per = top.groupBy(RUN, GENERATION).agg(F.avg(F.when(mask, F.col(value))).alias(value))
    n = F.count(value)
    return per.groupBy(GENERATION).agg(
        F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.sqrt(n)).alias("sem"), n.alias("n_runs")
    )


def saturation(best: DataFrame, n: int, value: str = "fitness") -> DataFrame:
    """First generation at which a run's best value has not risen for ``n`` generations.

    The running best splits a run into stretches without gain; a stretch of ``n`` generations after
    its first one saturates the run. Runs that never saturate get null.
    """
    upto = Window.partitionBy(RUN).orderBy(GENERATION)
    runmax = best.withColumn("_best", F.max(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = runmax.groupBy(RUN, "_best").agg(F.min(GENERATION).alias("_from"), F.max(GENERATION).alias("_to"))
    hit = F.when(F.col("_to") - F.col("_from") >= n, F.col("_from") + n)
    return stretch.groupBy(RUN).agg(F.min(hit).alias("saturated_at"), F.max("_best").alias("best"))


def where_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def select_symmetry(df: DataFrame, col: str = "p", threshold: float = 0.5, below: bool = True) -> DataFrame:
    """One of the two equivalent halves of the solutions."""
    return df.where(F.col(col) <= threshold) if below else df.where(F.col(col) >= threshold)


def global_top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def every_kth(df: DataFrame, order: list[str], first: int, step: int) -> DataFrame:
    """Every ``step``-th of the ``first`` rows in order."""
    head = df.orderBy(*order).limit(first)
    numbered = head.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("_i") % step == 0).drop("_i")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def result_filters(df: DataFrame, size: float = 90.0, p_value: float = 0.1, size_col="size_percentage", p_col="p_value"):
    return df.where((F.col(size_col) > size) & (F.col(p_col) < p_value))


def pivot_results(df: DataFrame, rows: list[str], across: str, values: list, cell: str) -> DataFrame:
    """Grid of ``cell`` with one column per listed value of ``across``."""
    return df.groupBy(*rows).pivot(across, values).agg(F.first(cell))


def error_summary(df: DataFrame, predicted: str, truth: str, key: Key = None) -> DataFrame:
    """Scale both columns to [0, 1] per group; mean, population std and mean size of the error."""
    a, b = F.col(predicted), F.col(truth)
    wide = attach_stats(
        df, key, [F.min(a).alias("_pa"), F.max(a).alias("_pb"), F.min(b).alias("_ta"), F.max(b).alias("_tb")]
    )
    err = F.try_divide(a - F.col("_pa"), F.col("_pb") - F.col("_pa")) - F.try_divide(
        b - F.col("_ta"), F.col("_tb") - F.col("_ta")
    )
    return wide.withColumn("_e", err).groupBy(*names(key)).agg(
        F.avg("_e").alias("mean_error"), F.stddev_pop("_e").alias("std_error"), F.avg(F.abs("_e")).alias("mean_abs_error")
    )


def gaussian_mixture_1d(
    df: DataFrame, col: str, k: int, key: Key = None, max_iter: int = 60, tol: float = 1e-4, floor: float = 1e-6
) -> DataFrame:
    """Mixture of ``k`` normals per group, peaks in rising order of their mean.

    Expectation-maximisation with the parameters as a small table: one pass computes the
    responsibilities row by row and combines the moments before the exchange. Values are counted
    first, so repeated ones cost one row. Starts from means spread over one std around the mean.
    """
    by = names(key)
    counted = stage(df.groupBy(*by, F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))).df
    v, c = F.col("v"), F.col("c")
    base = counted.groupBy(*by).agg(
        F.sum(c).alias("_n"), (F.sum(v * c) / F.sum(c)).alias("_m"), (F.sum(v * v * c) / F.sum(c)).alias("_q")
    )
    var = F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(floor))
    spots = [0.0] if k == 1 else [-1.5 + 3.0 * j / (k - 1) for j in range(k)]
    params = base.select(
        *by,
        F.lit(float("-inf")).alias("ll"),
        F.array(
            *[
                F.struct(
                    F.lit(1.0 / k).alias("w"),
                    (F.col("_m") + s * F.sqrt(var)).alias("m"),
                    (var if k == 1 else var / (k * k)).alias("s2"),
                )
                for s in spots
            ]
        ).alias("peaks"),
    )
    params = stage(params).df
    joint = _with_params(counted, params, by)
    previous = None
    for _ in range(max_iter):
        dens = [
            F.col("peaks")[j]["w"]
            * F.exp(-F.pow(v - F.col("peaks")[j]["m"], 2) / (2 * F.col("peaks")[j]["s2"]))
            / F.sqrt(2 * F.pi() * F.col("peaks")[j]["s2"])
            for j in range(k)
        ]
        rows = joint.select(*by, "v", "c", *[d.alias(f"_d{j}") for j, d in enumerate(dens)])
        total = sum((F.col(f"_d{j}") for j in range(k)), F.lit(0.0)) + F.lit(1e-300)
        aggs = [(F.sum(c * F.log(total)) / F.sum(c)).alias("ll"), F.sum(c).alias("_n")]
        for j in range(k):
            resp = c * F.col(f"_d{j}") / total
            aggs += [F.sum(resp).alias(f"_r{j}"), F.sum(resp * v).alias(f"_x{j}"), F.sum(resp * v * v).alias(f"_y{j}")]
        stats = rows.groupBy(*by).agg(*aggs)
        peaks = []
        for j in range(k):
            mass = F.greatest(F.col(f"_r{j}"), F.lit(1e-12))
            mean = F.col(f"_x{j}") / mass
            peaks.append(
                F.struct(
                    (F.col(f"_r{j}") / F.col("_n")).alias("w"),
                    mean.alias("m"),
                    F.greatest(F.col(f"_y{j}") / mass - mean * mean, F.lit(floor)).alias("s2"),
                )
            )
        params = stage(stats.select(*by, "ll", F.array(*peaks).alias("peaks"))).df
        gain = params.agg(F.sum("ll").alias("ll")).first()["ll"]
        if k == 1 or (previous is not None and abs(gain - previous) < tol):
            break
        previous = gain
        joint = _with_params(counted, params, by)
    return params.select(*by, "ll", F.posexplode(F.array_sort("peaks", _by_mean)).alias("peak", "_p")).select(
        *by, "peak", F.col("_p.w").alias("weight"), F.col("_p.m").alias("mean"), F.col("_p.s2").alias("variance"), "ll"
    )


def _by_mean(a: Column, b: Column) -> Column:
    return F.when(a["m"] < b["m"], -1).when(a["m"] > b["m"], 1).otherwise(0)


def _with_params(counted: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return counted.join(params.drop("ll"), by)
    one = F.lit(1)
    return counted.withColumn("_one", one).join(F.broadcast(params.drop("ll").withColumn("_one", one)), "_one").drop("_one")


def mixture_density(params: DataFrame, grid: list[float], key: Key = None) -> DataFrame:
    """Sum of the weighted normals on a grid of points; null where no component has a spread."""
    by = names(key)
    x = F.col("x")
    spread = params.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    part = (
        F.col("weight")
        * F.exp(-F.pow(x - F.col("mean"), 2) / (2 * F.col("variance")))
        / F.sqrt(2 * F.pi() * F.col("variance"))
    )
    # a component without spread has no density
    part = F.when(F.col("variance") > 0, part)
    return spread.groupBy(*by, "x").agg(F.sum(part).alias("density"))


def select_peak_solutions(df: DataFrame, peaks: DataFrame, value: str = "fitness", key: Key = None) -> DataFrame:
    """Solutions within one std of each peak. The few peaks travel as one array per group."""
    by = names(key)
    bands = peaks.groupBy(*by).agg(F.collect_list(F.struct("peak", "mean", "variance")).alias("_peaks"))
    hit = F.filter(
        "_peaks",
        lambda p: F.col(value).between(p["mean"] - F.sqrt(p["variance"]), p["mean"] + F.sqrt(p["variance"])),
    )
    if by:
        both = join_stats(df, bands, by)
    else:
        both = df.withColumn("_one", F.lit(1)).join(F.broadcast(bands.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.withColumn("peak", F.explode(F.transform(hit, lambda p: p["peak"]))).drop("_peaks")


def peak_parameter_summary(selected: DataFrame, params: list[str], value: str = "fitness", key: Key = "peak") -> DataFrame:
    """Mean and population std of each parameter, rounded to four digits, and of the fitness."""
    aggs = []
    for p in params:
        aggs += [F.round(F.avg(p), 4).alias(p), F.round(F.stddev_pop(p), 4).alias(f"{p}_std")]
    return selected.groupBy(*names(key)).agg(
        *aggs,
        F.avg(value).alias("mean_fit"),
        F.stddev_pop(value).alias("std_fit"),
        F.count(F.lit(1)).alias("number_of_samples"),
    )


def bootstrap_draws(spark, sizes: list[int], reps: int, population: int, seed: int = 1) -> DataFrame:
    """Draws with replacement ``(size, rep, draw, idx)`` from a hash of their coordinates."""
    from ..functions.scalars import modular_hash

    per = spark.range(len(sizes) * reps).select(
        F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.floor(F.col("id") / reps) + 1).cast("int")).alias("size"),
        (F.col("id") % reps).cast("int").alias("rep"),
    )
    return per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn(
        "idx", modular_hash([F.lit(seed), F.col("size"), F.col("rep"), F.col("draw")], F.lit(population))
    )


def bootstrap_means(indexed: DataFrame, draws: DataFrame, value: str, extra: Key = None) -> DataFrame:
    """Mean of ``value`` per drawn sample; ``indexed`` carries the 0-based ``idx``.

    Only the drawn rows can matter, so the population is cut to them by the join on ``idx``.
    """
    by = ["size", "rep", *names(extra)]
    counts = draws.groupBy("size", "rep", "idx").agg(F.count(F.lit(1)).alias("_k"))
    return counts.join(indexed, "idx").groupBy(*by).agg(
        (F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("mean")
    )


def bootstrap_var_of_mean(means: DataFrame) -> DataFrame:
    """Sample variance of the repeated means, divided by the sample size."""
    return means.groupBy("size").agg((F.var_samp("mean") / F.col("size")).alias("var_of_mean"))


def bootstrap_curve_mse(mean_curves: DataFrame, population: DataFrame, grid: str = "beta_idx") -> DataFrame:
    """Mean squared gap between every sample's mean curve and the population's, a row per grid point."""
    gap = F.col("mean") - F.col("pop")
    return (
        mean_curves.join(population.select(grid, "pop"), grid)
        .groupBy("size", "rep")
        .agg(F.avg(gap * gap).alias("mse"))
    )


def variance_of_sample_mean(indexed: DataFrame, draws: DataFrame, value: str) -> DataFrame:
    """Squared standard error of one drawn sample per size."""
    return (
        draws.where("rep = 0")
        .join(indexed, "idx")
        .groupBy("size")
        .agg((F.var_samp(value) / F.col("size")).alias("sem2"))
    )
