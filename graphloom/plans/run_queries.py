"""Queries on run logs, mixtures and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as cv
from ..operators import runs as rn
from ..staging import with_row_index
from .inputs import curves, r, rd, run_log, table, with_views
from .registry import query

def order_cols():
    """Best fitness first; all other columns break ties, as no smaller key is unique."""
    return [F.desc("fitness"), *[F.col(c) for c in ("d", "p", "beta", "order_id", "part_id", "line")]]


def top10(spark, sf):
    return rn.top_k_per_group(run_log(spark, sf), order_cols(), 10, ["run_id", "generation"])


@query(
    "top_k_per_group",
    with_views("SELECT run_id, generation, d, p, beta, fitness FROM top10", "top10"),
)
def _(spark, sf):
    return top10(spark, sf).select("run_id", "generation", "d", "p", "beta", "fitness")


@query(
    "best_per_generation",
    with_views(
        """SELECT run_id, generation, d, p, beta, fitness FROM run_log QUALIFY row_number() OVER (
             PARTITION BY run_id, generation ORDER BY fitness DESC, d DESC, p DESC, beta DESC) = 1""",
        "run_log",
    ),
)
def _(spark, sf):
    cols = ["fitness", "d", "p", "beta"]
    return rn.best_per_group(run_log(spark, sf), [F.col(c) for c in cols], cols, ["run_id", "generation"])


def summary_sql(value, how):
    return with_views(
        f"""WITH t AS (SELECT run_id, generation, {how}({value}) AS v FROM top10 GROUP BY ALL)
            SELECT generation, {rd('avg(v)', 7)} AS mean, {rd('stddev_pop(v)', 7)} AS std, {rd('stddev_pop(v) / sqrt(count(*))', 7)} AS sem,
              count(*) AS n_runs FROM t GROUP BY ALL""",
        "top10",
    )


def summary(spark, sf, value, how):
    t = rn.trajectory(top10(spark, sf), value, how)
    return rn.trajectory_summary(t, value).select(
        "generation", *[r(c, 7).alias(c) for c in ("mean", "std", "sem")], "n_runs"
    )


@query("trajectory_nbest", summary_sql("fitness", "avg"))
def _(spark, sf):
    return summary(spark, sf, "fitness", "mean")


@query("trajectory_max", summary_sql("fitness", "max"))
def _(spark, sf):
    return summary(spark, sf, "fitness", "max")


CONV_SQL = """WITH t AS (SELECT run_id, generation, avg(p) AS v FROM top10 GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY generation DESC) AS rn FROM t),
    c AS (SELECT run_id FROM l WHERE rn <= 5 GROUP BY run_id HAVING bool_and(v < 0.05))"""


@query("converged_runs", with_views(f"{CONV_SQL} SELECT run_id FROM c", "top10"))
def _(spark, sf):
    return rn.converged_runs(rn.trajectory(top10(spark, sf), "p"), "p", 0.05)


@query(
    "conditional_trajectory",
    with_views(
        f"""WITH t AS (SELECT run_id, generation, avg(CASE WHEN p < 0.04 THEN d END) AS v FROM top10 GROUP BY ALL)
            SELECT generation, {rd('avg(v)')} AS mean, {rd('stddev_pop(v) / sqrt(count(v))')} AS sem, count(v) AS n_runs FROM t GROUP BY ALL""",
        "top10",
    ),
)
def _(spark, sf):
    out = rn.conditional_trajectory(top10(spark, sf), F.col("p") < 0.04, "d")
    return out.select("generation", r("mean").alias("mean"), r("sem").alias("sem"), "n_runs")


@query(
    "last_n_values",
    with_views(
        f"""WITH t AS (SELECT run_id, generation, avg(fitness) AS v FROM top10 GROUP BY ALL)
            SELECT run_id, generation, {rd('v')} AS fitness FROM t
            QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY generation DESC) <= 3""",
        "top10",
    ),
)
def _(spark, sf):
    t = rn.trajectory(top10(spark, sf), "fitness")
    return rn.last_n(t, 3).select("run_id", "generation", r("fitness").alias("fitness"))


@query(
    "saturation",
    with_views(
        """WITH b AS (SELECT run_id, generation, max(fitness) AS f FROM run_log GROUP BY ALL),
           m AS (SELECT run_id, generation, max(f) OVER (PARTITION BY run_id ORDER BY generation) AS best FROM b),
           s AS (SELECT run_id, best, min(generation) AS a, max(generation) AS z FROM m GROUP BY ALL)
           SELECT run_id, min(CASE WHEN z - a >= 20 THEN a + 20 END) AS saturated_at, max(best) AS best FROM s GROUP BY ALL""",
        "run_log",
    ),
)
def _(spark, sf):
    best = run_log(spark, sf).groupBy("run_id", "generation").agg(F.max("fitness").alias("fitness"))
    return rn.saturation(best, 20)


@query(
    "where_range",
    with_views("SELECT run_id, generation, beta FROM run_log WHERE beta BETWEEN 0.3 AND 0.6", "run_log"),
)
def _(spark, sf):
    return rn.where_range(run_log(spark, sf), "beta", 0.3, 0.6).select("run_id", "generation", "beta")


@query(
    "select_symmetry",
    with_views("SELECT run_id, generation, beta, fitness FROM run_log WHERE beta <= 0.5", "run_log"),
)
def _(spark, sf):
    return rn.select_symmetry(run_log(spark, sf), "beta").select("run_id", "generation", "beta", "fitness")


@query(
    "global_top_n",
    with_views(
        "SELECT run_id, fitness FROM run_log ORDER BY fitness DESC, d, p, beta, order_id, part_id, line LIMIT 100", "run_log"
    ),
)
def _(spark, sf):
    return rn.global_top_n(run_log(spark, sf), order_cols(), 100).select("run_id", "fitness")


@query(
    "every_kth",
    """SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer)
       WHERE i < 100 AND i % 7 = 0""",
)
def _(spark, sf):
    return rn.every_kth(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], 100, 7).select("c_custkey")


@query("distinct_values", with_views("SELECT DISTINCT d FROM run_log", "run_log"))
def _(spark, sf):
    return rn.distinct_values(run_log(spark, sf), "d")


@query(
    "result_filters",
    with_views(
        "SELECT run_id, generation, fitness FROM run_log WHERE beta * 100 > 90 AND d < 0.1", "run_log"
    ),
)
def _(spark, sf):
    df = run_log(spark, sf).withColumn("size_percentage", F.col("beta") * 100)
    return rn.result_filters(df, p_col="d").select("run_id", "generation", "fitness")


PIVOT = [i / 100 for i in range(9)]


@query(
    "pivot_table",
    with_views(
        "SELECT run_id, generation, "
        + ", ".join(f"max(CASE WHEN p = {p} THEN f END) AS p_{int(p * 100)}" for p in PIVOT)
        + " FROM (SELECT run_id, generation, p, max(fitness) AS f FROM run_log GROUP BY ALL) GROUP BY run_id, generation",
        "run_log",
    ),
)
def _(spark, sf):
    best = run_log(spark, sf).groupBy("run_id", "generation", "p").agg(F.max("fitness").alias("f"))
    out = rn.pivot_results(best, ["run_id", "generation"], "p", PIVOT, "f")
    return out.select("run_id", "generation", *[F.col(f"`{p}`").alias(f"p_{int(p * 100)}") for p in PIVOT])


@query(
    "error_summary",
    with_views(
        f"""WITH s AS (SELECT run_id, (beta - min(beta) OVER g) / (max(beta) OVER g - min(beta) OVER g)
                - (fitness - min(fitness) OVER g) / (max(fitness) OVER g - min(fitness) OVER g) AS e
              FROM run_log WINDOW g AS (PARTITION BY run_id))
            SELECT run_id, {rd('avg(e)')} AS mean_error, {rd('stddev_pop(e)')} AS std_error, {rd('avg(abs(e))')} AS mean_abs_error
            FROM s GROUP BY ALL""",
        "run_log",
    ),
)
def _(spark, sf):
    out = rn.error_summary(run_log(spark, sf), "beta", "fitness", "run_id")
    return out.select("run_id", *[r(c).alias(c) for c in ("mean_error", "std_error", "mean_abs_error")])


@query(
    "gaussian_single",
    with_views(
        f"SELECT generation, CAST(0 AS INTEGER) AS peak, CAST(1 AS DOUBLE) AS weight, {rd('avg(beta)', 9)} AS mean, {rd('var_pop(beta)', 12)} AS variance FROM run_log GROUP BY ALL",
        "run_log",
    ),
)
def _(spark, sf):
    out = rn.gaussian_mixture_1d(run_log(spark, sf), "beta", 1, "generation", floor=0.0)
    return out.select("generation", "peak", r("weight").alias("weight"), r("mean", 9).alias("mean"), r("variance", 12).alias("variance"))


@query("gaussian_mixture")
def _(spark, sf):
    return rn.gaussian_mixture_1d(run_log(spark, sf), "fitness", 3, max_iter=25, floor=1.0)


PEAKS_SQL = """peaks AS (SELECT p AS peak, avg(fitness) AS mean, var_pop(fitness) AS variance, count(*) / sum(count(*)) OVER () AS weight
    FROM run_log GROUP BY p)"""


def peaks(spark, sf):
    """Groups of equal tax stand for the peaks of a mixture."""
    log = run_log(spark, sf)
    per = log.groupBy(F.col("p").alias("peak")).agg(
        F.avg("fitness").alias("mean"), F.var_pop("fitness").alias("variance"), F.count(F.lit(1)).alias("n")
    )
    total = per.agg(F.sum("n").alias("t")).withColumn("_one", F.lit(1))
    return (
        per.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .withColumn("weight", F.col("n") / F.col("t"))
        .drop("_one", "n", "t")
    )


@query(
    "mixture_density",
    with_views(
        f"""WITH {PEAKS_SQL} SELECT CAST(x AS DOUBLE) AS x,
              {rd('sum(weight * exp(-power(x - mean, 2) / (2 * variance)) / sqrt(2 * pi() * variance))', 10)} AS density
            FROM peaks, (SELECT UNNEST(range(0, (SELECT CAST(floor(max(fitness) / 1000) AS BIGINT) + 2 FROM run_log) * 1000, 1000)) AS x) GROUP BY ALL""",
        "run_log",
    ),
)
def _(spark, sf):
    top = run_log(spark, sf).agg(F.max("fitness")).first()[0]
    grid = [1000.0 * i for i in range(int(top // 1000) + 2)]
    return rn.mixture_density(peaks(spark, sf), grid).withColumn("density", r("density", 10))


@query(
    "peak_parameter_summary",
    with_views(
        f"""WITH {PEAKS_SQL}, s AS (SELECT peak, d, p, beta, fitness FROM run_log, peaks
              WHERE fitness BETWEEN mean - sqrt(variance) AND mean + sqrt(variance))
            SELECT peak, {rd('avg(d)', 4)} AS d, {rd('stddev_pop(d)', 4)} AS d_std, {rd('avg(p)', 4)} AS p, {rd('stddev_pop(p)', 4)} AS p_std,
              {rd('avg(beta)', 4)} AS beta, {rd('stddev_pop(beta)', 4)} AS beta_std, {rd('avg(fitness)', 4)} AS mean_fit,
              {rd('stddev_pop(fitness)', 4)} AS std_fit, count(*) AS number_of_samples FROM s GROUP BY ALL""",
        "run_log",
    ),
)
def _(spark, sf):
    chosen = rn.select_peak_solutions(run_log(spark, sf), peaks(spark, sf))
    out = rn.peak_parameter_summary(chosen, ["d", "p", "beta"])
    return out.withColumns({"mean_fit": r("mean_fit", 4), "std_fit": r("std_fit", 4)})


SIZES = list(range(10, 100, 2))
REPS = 50


def indexed_x(spark, sf):
    """Curve sums with a dense index in order of the curve id."""
    x = cv.curve_functional(curves(spark, sf), "curve_id")
    return with_row_index(x, ["curve_id"])


def population(indexed):
    return indexed.agg((F.max("idx") + 1).alias("n")).first()["n"]


DRAW_SQL = f"""x AS (SELECT *, row_number() OVER (ORDER BY curve_id) - 1 AS idx FROM (
      SELECT curve_id, sum(s) AS x FROM curves GROUP BY ALL)),
    dr AS (SELECT size, rep, draw, CAST('0x' || substr(md5('1-' || size || '-' || rep || '-' || draw), 1, 8) AS BIGINT)
        % (SELECT count(*) FROM x) AS idx
      FROM (SELECT size, rep, UNNEST(range(size)) AS draw FROM (SELECT UNNEST(range(10, 100, 2)) AS size), (SELECT UNNEST(range({REPS})) AS rep)))"""


@query(
    "bootstrap_var_of_mean",
    with_views(
        f"""WITH {DRAW_SQL}, m AS (SELECT size, rep, avg(x) AS mean FROM dr JOIN x USING (idx) GROUP BY ALL)
            SELECT CAST(size AS INTEGER) AS size, {rd('var_samp(mean) / size', 5)} AS var_of_mean FROM m GROUP BY size""",
        "curves",
    ),
)
def _(spark, sf):
    x = indexed_x(spark, sf)
    draws = rn.bootstrap_draws(spark, SIZES, REPS, population(x))
    return rn.bootstrap_var_of_mean(rn.bootstrap_means(x, draws, "x")).withColumn("var_of_mean", r("var_of_mean", 5))


@query(
    "bootstrap_mean_curves",
    with_views(
        f"""WITH {DRAW_SQL}, full_grid AS (SELECT curve_id, beta_idx, coalesce(s, 0) AS s FROM (SELECT DISTINCT curve_id FROM curves)
              CROSS JOIN (SELECT UNNEST(range((SELECT max(beta_idx) FROM curves) + 1)) AS beta_idx) LEFT JOIN curves USING (curve_id, beta_idx)),
            ix AS (SELECT f.*, x.idx FROM full_grid f JOIN x USING (curve_id)),
            pop AS (SELECT beta_idx, avg(s) AS pop FROM full_grid GROUP BY ALL),
            m AS (SELECT size, rep, beta_idx, avg(s) AS mean FROM dr JOIN ix USING (idx) GROUP BY ALL)
            SELECT CAST(size AS INTEGER) AS size, CAST(rep AS INTEGER) AS rep, {rd('avg((mean - pop) * (mean - pop))', 5)} AS mse
            FROM m JOIN pop USING (beta_idx) GROUP BY ALL""",
        "curves",
    ),
)
def _(spark, sf):
    x = indexed_x(spark, sf).select("curve_id", "idx")
    last = curves(spark, sf).agg(F.max("beta_idx").cast("long")).first()[0]
    grid = x.withColumn("beta_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last))))
    full = grid.join(curves(spark, sf), ["curve_id", "beta_idx"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    pop = full.groupBy("beta_idx").agg(F.avg("s").alias("pop"))
    draws = rn.bootstrap_draws(spark, SIZES, REPS, population(x))
    means = rn.bootstrap_means(full, draws, "s", "beta_idx")
    return rn.bootstrap_curve_mse(means, pop).withColumn("mse", r("mse", 5))


@query(
    "variance_of_sample_mean",
    with_views(
        f"""WITH {DRAW_SQL} SELECT CAST(size AS INTEGER) AS size, {rd('var_samp(x) / size', 5)} AS sem2
            FROM dr JOIN x USING (idx) WHERE rep = 0 GROUP BY size""",
        "curves",
    ),
)
def _(spark, sf):
    x = indexed_x(spark, sf)
    draws = rn.bootstrap_draws(spark, SIZES, REPS, population(x))
    return rn.variance_of_sample_mean(x, draws, "x").withColumn("sem2", r("sem2", 5))


@query(
    "sort_by_param",
    """SELECT DISTINCT 'run_p' || CAST(l_tax AS VARCHAR) AS path, CAST(l_tax AS DOUBLE) AS p FROM lineitem""",
)
def _(spark, sf):
    from ..sources.paths import path_params, sort_by_param

    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("run_p"), F.col("l_tax").cast("string")).alias("path")).distinct()
    return sort_by_param(path_params(rows, "path", {"p": r"_p([0-9.]+)"}), "p")
