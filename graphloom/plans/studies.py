"""End-to-end studies: the tables behind the published figures, as plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, names
from ..operators import components as comp
from ..operators import curves as cv
from ..operators import features as ft
from ..operators import histogram as hg
from ..operators import runs as rn
from ..operators import scaling as sl
from ..operators import spatial as spt
from ..operators import spectral as sp
from ..operators import tables as tb
from ..staging import stage

MAX_REFERENCES = 256  # mean curves sent along in one broadcast row


def clean_corpus(
    nodes: DataFrame, edges: DataFrame, eps: float, key: Key = "graph_id", drop_loops: bool = True, component_first: bool = False
) -> DataFrame:
    """Edges of the cleaned graphs: near nodes merged, largest component, loops dropped.

    Synthetic graphs merge before the component is taken; ground truth takes the component first.
    """
    by = names(key)
    if component_first:
        edges = stage(comp.largest_component_edges(edges, key)).df
        ends = tb.endpoints(edges, key).select(*by, "node")
        nodes = nodes.join(ends, [*by, "node"], "left_semi")
    _kept, merged, _removed = spt.merge_close_nodes(nodes, edges, eps, key)
    merged = stage(merged).df
    if not component_first:
        merged = stage(comp.largest_component_edges(merged, key)).df
    return tb.remove_self_loops(merged) if drop_loops else merged


def entropy_comparison(edges: DataFrame, corpus: str = "corpus", key: Key = "graph_id", form: str = "plain") -> DataFrame:
    """Mean entropy curve and its std per corpus. ``corpus`` is a column of the edges."""
    by = [corpus, *[k for k in names(key) if k != corpus]]
    curves = sp.clip_curve(sp.spectral_entropy(sp.laplacian_spectrum(edges, by), form=form))
    return cv.ensemble_mean_curve(curves, corpus)


def size_distribution(edges: DataFrame, corpus: str, grid: list[float], key: Key = "graph_id") -> tuple[DataFrame, DataFrame]:
    """Normal fit of the graph sizes per corpus and its density on a grid."""
    by = [corpus, *names(key)]
    fit = rn.gaussian_mixture_1d(tb.graph_size(edges, by), "n", 1, corpus, floor=0.0)
    return fit, rn.mixture_density(fit, grid, corpus)


def degree_comparison(edges: DataFrame, threshold: int, corpus: str, key: Key = "graph_id") -> DataFrame:
    """Degree law per corpus over the graphs below the degree threshold."""
    by = [corpus, *names(key)]
    kept, _removed = tb.filter_by_max_degree(edges, threshold, by)
    return tb.degree_distribution(tb.degree(kept, by), corpus)


def converged_trajectories(top: DataFrame, params: list[str], by_param: str, threshold: float, below: bool = True) -> DataFrame:
    """Mean and SEM per generation of every parameter over the converged runs."""
    runs = rn.converged_runs(rn.trajectory(top, by_param), by_param, threshold, below=below)
    kept = rn.keep_runs(top, runs)
    wide = kept.groupBy("run_id", "generation").agg(*[F.avg(p).alias(p) for p in params])
    long = wide.select(
        "generation", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("v")) for p in params])).alias("_p")
    ).select("generation", "_p.*")
    return long.groupBy("param", "generation").agg(
        F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("sem")
    )


def selected_parameters(top: DataFrame, k: int, params: list[str], fold: str = "p", at: float = 0.5, max_iter: int = 25, floor: float = 1e-6):
    """Mixture of the fitness of one symmetric half, and the parameters within one std of each peak."""
    half = rn.select_symmetry(top, fold, at)
    peaks = rn.gaussian_mixture_1d(half, "fitness", k, max_iter=max_iter, floor=floor)
    return rn.peak_parameter_summary(rn.select_peak_solutions(half, peaks), params)


def corpus_size_effect(edges: DataFrame, sizes: list[int], reps: int, key: Key = "graph_id") -> DataFrame:
    """Variance of the mean of X, the summed entropy curve, for samples of growing size."""
    from ..staging import with_row_index

    by = names(key)
    curves = sp.spectral_entropy(sp.laplacian_spectrum(edges, key))
    x = curves.select(*by, F.aggregate("s", F.lit(0.0), lambda a, v: a + v).alias("x"))
    indexed = stage(with_row_index(x, by)).df
    population = indexed.agg((F.max("idx") + 1).alias("n")).first()["n"]
    draws = rn.bootstrap_draws(edges.sparkSession, sizes, reps, population)
    return rn.bootstrap_var_of_mean(rn.bootstrap_means(indexed, draws, "x"))


def network_against_intensity(
    edges: DataFrame, intensity: DataFrame, shares: list[float], key: Key = "image_id", min_weight: float = 1e-4
) -> DataFrame:
    """Prune at every share, keep the largest component, and correlate the measured intensity with
    the stationary law and with the inverse effective resistance to the brightest node.

    All shares run in one job: the share joins the key.
    """
    by = names(key)
    per = [*by, "share"]
    edges, intensity = stage(edges).df, stage(intensity).df
    base = tb.graph_size(edges, key)
    pruned = stage(hg.prune_edges(edges, shares, key)).df
    core = stage(comp.largest_component_edges(pruned, per)).df
    scaled = sl.minmax_scale(core, "weight", min_weight, 1.0, per).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    law = tb.stationary_distribution(scaled, per)
    size = tb.size_percentage(tb.graph_size(core, per), base, by)
    measured = sl.minmax_scale(intensity, "mean_intensity", 0.0, 1.0, key)
    joined = law.join(measured, [*by, "node"])
    first = ft.pearson(joined, "mean_intensity", "probability", per).select(
        *per, F.col("corr").alias("corr_inv_proba"), F.col("p_value").alias("p_val_inv_proba")
    )
    grounded = joined.groupBy(*per).agg(F.max_by("node", F.struct("mean_intensity", "node")).alias("_brightest"))
    marked = scaled.join(grounded, per)
    # the ground is a further node wired to the brightest one with weight 1
    wire = grounded.select(*per, F.lit(-1).cast("long").alias("src"), F.col("_brightest").alias("dst"), F.lit(1.0).alias("weight"))
    wired = marked.select(*per, "src", "dst", "weight").unionByName(wire)
    res = sp.effective_resistance(wired, -1, per).where((F.col("node") >= 0) & (F.col("resistance") > 0))
    inverse = res.withColumn("conductance", 1.0 / F.col("resistance")).join(measured, [*by, "node"])
    second = ft.pearson(inverse, "mean_intensity", "conductance", per).select(
        *per, F.col("corr").alias("corr_eff_res"), F.col("p_value").alias("p_val_eff_res")
    )
    return size.join(first, per).join(second, per)


def closest_corpus(curves: DataFrame, references: DataFrame, key: Key = "graph_id") -> DataFrame:
    """Corpus whose mean curve has the smallest squared distance to each graph's curve.

    ``curves`` is ``(key, s array)``; ``references`` is ``(corpus, s array)``, one row per corpus. Few
    references travel as one array beside the curves; many are matched grid point by grid point.
    """
    by = names(key)
    references = stage(references).df
    if references.count() > MAX_REFERENCES:
        long = references.select("corpus", F.posexplode("s").alias("beta_idx", "b"))
        gaps = curves.select(*by, F.posexplode("s").alias("beta_idx", "a")).join(long, "beta_idx")
        gap = F.col("a") - F.col("b")
        each = gaps.groupBy(*by, "corpus").agg(F.sum(gap * gap).alias("sse"))
        best = F.min(F.struct("sse", "corpus"))
        return each.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.corpus", "_b.sse")
    packed = references.agg(F.collect_list(F.struct("corpus", "s")).alias("_refs")).withColumn("_one", F.lit(1))
    both = curves.withColumn("_one", F.lit(1)).join(F.broadcast(packed), "_one")

    def sse(ref):
        gaps = F.zip_with("s", ref["s"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda t, v: t + v)

    best = F.array_min(F.transform("_refs", lambda ref: F.struct(sse(ref).alias("sse"), ref["corpus"].alias("corpus"))))
    return both.select(*by, best.alias("_b")).select(*by, "_b.corpus", "_b.sse")
