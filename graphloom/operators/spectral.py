"""Laplacian spectra and what follows from them: entropy curves, densities, likelihoods.

A spectrum is one row per graph: ``lambdas`` ascending, with ``weights`` that say how many
eigenvalues each entry stands for. Exact spectra have weight one throughout; the quadrature of a
large graph has a few dozen entries. The same entropy operator serves both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import Key, names
from ..functions.scalars import literal_array, log_grid
from ..staging import release, stage
from .blocks import Numbered, Stack, key_schema, map_blocks, map_components, spread, stacked
from .iterative import chebyshev_coefficients
from .local_paths import heat_blocks
from .tables import GRAPH, degree, endpoints

CELLS = 1 << 22  # matrix entries held at a time
BETA_GRID = (-3.0, 4.0, 300)  # fixed values: exponents and number of points


def beta_grid(spark, lo: float = BETA_GRID[0], hi: float = BETA_GRID[1], n: int = BETA_GRID[2]) -> DataFrame:
    """Log-spaced grid as a table ``(beta_idx, beta)``."""
    step = (hi - lo) / (n - 1)
    return spark.range(n).select(
        F.col("id").alias("beta_idx"), F.pow(F.lit(10.0), F.lit(lo) + F.col("id") * step).alias("beta")
    )


def laplacian_spectrum(edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None) -> DataFrame:
    """Exact Laplacian spectrum of every graph, whatever its size; a task holds n x n entries of a component.

    ``nodes`` (key, node) may name isolated nodes: each adds an eigenvalue of zero. For single large graphs there
    is :func:`quadrature_spectrum`, whose entries are not eigenvalues and must not be ranked.
    """

    def solve(graphs: Numbered) -> Iterator[pd.DataFrame]:
        values = _eigenvalues(graphs)
        values = values[np.lexsort((values, graphs.graph))]
        n = np.bincount(graphs.graph)
        out = graphs.keys.copy()
        out["n"] = n
        out["lambdas"] = np.split(values, np.cumsum(n)[:-1])
        yield out

    by = names(key)
    spectrum = map_components(edges, solve, f"{key_schema(edges, key)}, n long, lambdas array<double>", key)
    if nodes is not None:
        ends = endpoints(edges, key).select(*by, "node").distinct()
        lone = nodes.select(*by, "node").distinct().join(ends, [*by, "node"], "left_anti")
        counts = lone.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("_lone"))
        more = F.coalesce("_lone", F.lit(0))
        zeros = F.array_repeat(F.lit(0.0), more)
        spectrum = spectrum.join(counts, by, "full").select(
            *by,
            (F.coalesce("n", F.lit(0)) + more).alias("n"),
            F.array_sort(F.concat(zeros, F.coalesce("lambdas", F.array().cast("array<double>")))).alias("lambdas"),
        )
    return spectrum.withColumn("weights", F.array_repeat(F.lit(1.0), F.col("n").cast("int")))


def _eigenvalues(graphs: Numbered) -> np.ndarray:
    """Laplacian eigenvalues of all components, in the places of their nodes."""
    values = np.empty(len(graphs.ids))
    for stack in stacked(graphs):
        values[graphs.first[stack.parts][:, None] + np.arange(stack.nodes.shape[1])] = np.linalg.eigvalsh(stack.laplacian())
    return values


def rank_spectrum(spectrum: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Long form ``(key, rank, lam)``, ascending from rank 0."""
    return spectrum.select(
        *names(key), F.posexplode(F.array_sort("lambdas")).alias("rank", "lam")
    )


def entropy_column(betas: list[float], lambdas: Column, weights: Column, form: str = "plain") -> Column:
    """S(beta) = ln Z + beta * <lambda> for every beta, as an array; NaN becomes 0."""
    grid = np.asarray(betas, float)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def curve(lams: pa.Array, mults: pa.Array) -> pa.Array:
        ends = np.asarray(lams.offsets, np.int64)
        lam = np.asarray(lams.flatten(), float)
        mult = np.asarray(mults.flatten(), float)
        ends = ends - ends[0]
        parts = []
        for lo, hi in _row_chunks(ends, CELLS // len(grid)):
            cut = slice(ends[lo], ends[hi])
            starts = ends[lo:hi] - ends[lo]
            boltz = np.exp(np.multiply.outer(-grid, lam[cut])) * mult[cut]
            z = np.add.reduceat(boltz, starts, axis=1)
            energy = np.add.reduceat(boltz * lam[cut], starts, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.log(z) + grid[:, None] * energy / z
                if form != "plain":
                    s = s / np.log(np.add.reduceat(mult[cut], starts))
            s = np.nan_to_num(s, nan=0.0)
            parts.append((1.0 - s if form == "complement" else s).T.ravel())
        values = np.concatenate(parts) if parts else np.empty(0)
        offsets = np.arange(len(lams) + 1, dtype=np.int32) * len(grid)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    # explode adds a filter on its input, which would run a deterministic function twice
    return curve.asNondeterministic()(lambdas, weights)


def _row_chunks(ends: np.ndarray, cells: int):
    """Ranges of rows that hold about ``cells`` values together, one row at least."""
    lo, rows = 0, len(ends) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + cells, side="right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def spectral_entropy(spectrum: DataFrame, betas: list[float] | None = None, form: str = "plain") -> DataFrame:
    """Entropy curve per graph in column ``s`` (an array along the grid), without a shuffle.

    ``form``: ``plain`` S, ``ratio`` S / ln n, or ``complement`` 1 - S / ln n.
    """
    betas = betas or log_grid(*BETA_GRID)
    curve = entropy_column(betas, F.col("lambdas"), F.col("weights"), form)
    return spectrum.withColumn("s", curve).drop("lambdas", "weights")


def clip_curve(curves: DataFrame, top: float = 1e16) -> DataFrame:
    return curves.withColumn("s", F.transform("s", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(top))))


def long_curve(curves: DataFrame, key: Key = GRAPH, betas: list[float] | None = None) -> DataFrame:
    """``(key, beta_idx, beta, s)`` from array curves."""
    betas = betas or log_grid(*BETA_GRID)
    return curves.select(*names(key), F.posexplode("s").alias("beta_idx", "s")).withColumn(
        "beta", F.element_at(literal_array(betas), F.col("beta_idx") + 1)
    )


def log_likelihood(pairs: DataFrame, betas: list[float] | None = None) -> DataFrame:
    """-Tr[rho L'] - ln Z' of observed against model spectra, rank by rank.

    ``pairs`` holds ``observed`` and ``model`` arrays. The longer one is cut to the length of the
    shorter and divided by its last kept eigenvalue.
    """
    grid = np.asarray(betas or log_grid(*BETA_GRID), float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def curve(observed: pd.Series, model: pd.Series) -> pd.Series:
        out = []
        for obs, mod in zip(observed, model):
            obs, mod = np.sort(obs), np.sort(mod)
            n = min(len(obs), len(mod))
            if len(obs) > n:
                obs = obs[:n] / obs[n - 1]
            if len(mod) > n:
                mod = mod[:n] / mod[n - 1]
            e = np.exp(-np.outer(grid, obs))
            trace = (e @ mod) / e.sum(axis=1)
            out.append(-trace - np.log(np.exp(-np.outer(grid, mod)).sum(axis=1)))
        return pd.Series(out)

    return pairs.withColumn("log_likelihood", curve.asNondeterministic()("observed", "model")).drop("observed", "model")


def renormalize_spectrum(spectrum: DataFrame, size: Column | int) -> DataFrame:
    """The ``size`` smallest eigenvalues divided by the last of them."""
    kept = F.slice(F.array_sort("lambdas"), F.lit(1), size if isinstance(size, Column) else F.lit(size))
    return spectrum.withColumn("lambdas", kept).withColumn(
        "lambdas", F.transform("lambdas", lambda v: v / F.element_at("lambdas", -1))
    )


def clipped_eigenvalues(spectrum: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Eigenvalues as rows, clipped to [0, 1e15], ready for the density histogram."""
    top = F.lit(1e15)
    return rank_spectrum(spectrum, key).withColumn("lam", F.least(F.greatest("lam", F.lit(0.0)), top))


def specific_heat_from_spectrum(spectrum: DataFrame, taus: list[float] | None = None) -> DataFrame:
    """-tau^2 d<lambda>/d tau along the grid, by second-order differences on its uneven spacing."""
    grid = np.asarray(taus or log_grid(*BETA_GRID), float)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def heat(lams: pa.Array, mults: pa.Array) -> pa.Array:
        ends = np.asarray(lams.offsets, np.int64)
        lam = np.maximum(np.asarray(lams.flatten(), float), 0.0)
        mult = np.asarray(mults.flatten(), float)
        ends = ends - ends[0]
        parts = []
        for lo, hi in _row_chunks(ends, CELLS // len(grid)):
            cut = slice(ends[lo], ends[hi])
            starts = ends[lo:hi] - ends[lo]
            boltz = np.exp(np.multiply.outer(-grid, lam[cut])) * mult[cut]
            mean = np.add.reduceat(boltz * lam[cut], starts, axis=1) / np.add.reduceat(boltz, starts, axis=1)
            parts.append((-np.gradient(mean, grid, axis=0, edge_order=2) * (grid**2)[:, None]).T.ravel())
        values = np.concatenate(parts) if parts else np.empty(0)
        offsets = np.arange(len(lams) + 1, dtype=np.int32) * len(grid)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return spectrum.withColumn("c", heat.asNondeterministic()("lambdas", "weights")).drop("lambdas", "weights")


def density_matrix(edges: DataFrame, tau: float, key: Key = GRAPH) -> DataFrame:
    """Rows of e^{-tau L} / Z, one row per node with its entries in node order.

    The matrix has no entries between components, so a row holds those of its own ``component`` (the smallest node
    of it), with ``place`` the node's own among them. Z is the trace over the whole graph. Components of many nodes and
    few edges are expanded in Chebyshev terms, block by block of their rows; all others go by eigenvectors.
    """

    def solve(graphs: Numbered) -> Iterator[pd.DataFrame]:
        blocks = heat_blocks(graphs, tau, lambda a: chebyshev_coefficients(a, 1e-14))
        dense = np.setdiff1d(np.arange(len(graphs.size)), list(blocks))
        # the trace first, without eigenvectors: no task holds the matrices of all components
        owner = graphs.graph[graphs.first]
        whole = np.zeros(len(graphs.keys))
        for stack in stacked(graphs, dense):
            np.add.at(whole, owner[stack.parts], np.exp(-tau * np.linalg.eigvalsh(stack.laplacian())).sum(axis=1))
        for part, block in blocks.items():
            whole[owner[part]] += block.trace()
        for stack in stacked(graphs, dense):
            lam, vec = np.linalg.eigh(stack.laplacian())
            trace = whole[owner[stack.parts]]
            rho = (vec * np.exp(-tau * lam)[:, None, :]) @ vec.transpose(0, 2, 1) / trace[:, None, None]
            shape = stack.nodes.shape
            place = np.broadcast_to(np.arange(shape[1]), shape)
            least, z = (np.broadcast_to(x[:, None], shape) for x in (stack.nodes[:, 0], trace))
            yield spread(stack, node=stack.nodes, place=place, component=least, z=z, rho=rho)
        for part, block in blocks.items():
            first = graphs.first[part]
            for lo, rows in block.rows():
                place = np.arange(lo, lo + len(rows))
                out = graphs.keys.iloc[np.full(len(rows), owner[part])].reset_index(drop=True)
                out["node"], out["place"], out["component"] = graphs.ids[first + place], place, graphs.ids[first]
                out["z"], out["rho"] = whole[owner[part]], list(rows / whole[owner[part]])
                yield out

    schema = f"{key_schema(edges, key)}, node long, place long, component long, z double, rho array<double>"
    return map_components(edges, solve, schema, key)


def _pinv_laplacian(stack: Stack) -> np.ndarray:
    lam, vec = np.linalg.eigh(stack.laplacian())
    tiny = lam < 1e-9 * np.maximum(lam[:, -1:], 1.0)
    inverse = np.where(tiny, 0.0, 1.0 / np.where(tiny, 1.0, lam))
    return (vec * inverse[:, None, :]) @ vec.transpose(0, 2, 1)


def effective_resistance(edges: DataFrame, target: int, key: Key = GRAPH) -> DataFrame:
    """Resistance of every node to ``target``; edge weights are resistances.

    Nodes that no path joins to the target come out as null.
    """

    def solve(stack: Stack) -> pd.DataFrame:
        with np.errstate(divide="ignore"):
            adj = np.where(stack.adjacency > 0, 1.0 / stack.adjacency, 0.0)
        wired = Stack(stack.keys, stack.nodes, adj)
        plus = _pinv_laplacian(wired)
        diag = np.diagonal(plus, axis1=1, axis2=2)
        at = (stack.nodes == target).argmax(axis=1)
        pick = np.arange(len(at))
        res = diag + diag[pick, at][:, None] - 2 * plus[pick, at]
        # L L+ projects on the components: its entry is 0 - 1/size only inside a component
        proj = np.eye(adj.shape[1]) - wired.laplacian() @ plus
        joined = (np.abs(proj[pick, at]) > 1e-7) & (stack.nodes == target).any(axis=1)[:, None]
        return spread(stack, node=stack.nodes, resistance=np.where(joined, res, np.nan))

    schema = f"{key_schema(edges, key)}, node long, resistance double"
    out = map_blocks(edges, solve, schema, key)
    return out.withColumn("resistance", F.when(~F.isnan("resistance"), F.col("resistance")))


def edge_resistance(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Effective resistance across every edge; edge weights are conductances. A task holds n x n entries of a component.

    A graph with a null weight has null resistances.
    """

    def solve(graphs: Numbered) -> Iterator[pd.DataFrame]:
        known = np.isfinite(graphs.weight)
        positive = bool((graphs.weight[known] > 0).all())
        unknown = np.zeros(len(graphs.keys), bool)
        unknown[graphs.graph[graphs.a[~known]]] = True
        for stack in stacked(graphs):
            n = stack.nodes.shape[1]
            lost = unknown[graphs.graph[graphs.first[stack.parts]]]
            sound = Stack(stack.keys, stack.nodes, np.where(lost[:, None, None], 1.0, stack.adjacency))
            # L + J/n is definite on a component of positive weights, and its inverse is L+ + J/n
            plus = np.linalg.inv(sound.laplacian() + 1.0 / n) if positive else _pinv_laplacian(sound)
            plus[lost] = np.nan
            diag = np.diagonal(plus, axis1=1, axis2=2)
            g, i, j = np.nonzero(np.triu(stack.adjacency, 1))
            out = stack.keys.iloc[g].reset_index(drop=True)
            out["src"], out["dst"] = stack.nodes[g, i], stack.nodes[g, j]
            out["weight"] = stack.adjacency[g, i, j]
            out["resistance"] = diag[g, i] + diag[g, j] - 2 * plus[g, i, j]
            yield out

    schema = f"{key_schema(edges, key)}, src long, dst long, weight double, resistance double"
    return map_components(edges, solve, schema, key)


def information_centrality(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Inverse of the summed effective resistance to all nodes; null where the graph is not connected."""

    def solve(stack: Stack) -> pd.DataFrame:
        inverse = _pinv_laplacian(stack)
        n = inverse.shape[1]
        diag = np.diagonal(inverse, axis1=1, axis2=2)
        total = n * diag + diag.sum(axis=1)[:, None] - 2 * inverse.sum(axis=2)
        # L L+ is the identity less 1/n everywhere only where all nodes hang together
        apart = np.abs(stack.laplacian() @ inverse - (np.eye(n) - 1.0 / n)).max(axis=(1, 2)) > 1e-7
        with np.errstate(divide="ignore"):
            return spread(stack, node=stack.nodes, centrality=np.where(apart[:, None], np.nan, 1.0 / total))

    out = map_blocks(edges, solve, f"{key_schema(edges, key)}, node long, centrality double", key)
    return out.withColumn("centrality", F.when(~F.isnan("centrality"), F.col("centrality")))


def quadrature_spectrum(
    edges: DataFrame, key: Key = GRAPH, steps: int = 30, probes: int = 8, seed: int = 7
) -> DataFrame:
    """Weighted spectrum of graphs too large for a dense block, by stochastic Lanczos quadrature
    (Ubaru, Chen and Saad, 2017).

    Every node carries one value per probe in fixed columns, so a Lanczos step is one join of the
    edges with the current vectors, one sum per node and two sums per graph. The constant vector, whose
    eigenvalue is zero, is taken out of the probes and added back exactly. The weights add up to n.
    """
    spark = edges.sparkSession
    by = names(key)
    flat = [*by, "node"]
    spans = range(probes)
    loose = edges.where(F.col("src") != F.col("dst"))
    if "weight" not in loose.columns:
        loose = loose.withColumn("weight", F.lit(1.0))
    arcs = stage(endpoints(loose.select(*by, "src", "dst", "weight"), key))
    diagonal = arcs.df.groupBy(*flat).agg(F.sum("weight").alias("_deg"))
    sign = [
        F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(p), *flat), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        for p in spans
    ]
    sizes = stage(
        diagonal.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(s).alias(f"_c{p}") for p, s in zip(spans, sign)]
        )
    )
    state = stage(
        diagonal.join(sizes.df, by).select(
            *flat,
            "_deg",
            *[
                ((s - F.col(f"_c{p}")) / F.sqrt(F.col("_n") * (1 - F.col(f"_c{p}") * F.col(f"_c{p}")))).alias(f"v{p}")
                for p, s in zip(spans, sign)
            ],
            *[F.lit(0.0).alias(f"u{p}") for p in spans],
        )
    )
    coefs = [sizes]
    beta = None
    for step in range(steps):
        pulled = (
            arcs.df.join(
                state.df.select(*by, F.col("node").alias("peer"), *[f"v{p}" for p in spans]), [*by, "peer"]
            )
            .groupBy(*flat)
            .agg(*[F.sum(F.col("weight") * F.col(f"v{p}")).alias(f"a{p}") for p in spans])
        )
        moved = state.df.join(pulled, flat)
        if beta is not None:
            moved = moved.join(beta, by)
        raw = stage(
            moved.select(
                *flat,
                "_deg",
                *[f"v{p}" for p in spans],
                *[
                    (
                        F.col("_deg") * F.col(f"v{p}")
                        - F.col(f"a{p}")
                        - (F.col(f"b{p}") * F.col(f"u{p}") if beta is not None else F.lit(0.0))
                    ).alias(f"w{p}")
                    for p in spans
                ],
            )
        )
        # with w = L v - b u:  a = <w, v>  and  |w - a v|^2 = <w, w> - a^2, as |v| = 1
        alpha = stage(
            raw.df.groupBy(*by).agg(
                *[F.sum(F.col(f"w{p}") * F.col(f"v{p}")).alias(f"a{p}") for p in spans],
                *[F.sum(F.col(f"w{p}") * F.col(f"w{p}")).alias(f"_q{p}") for p in spans],
            ).select(
                *by,
                F.lit(step).alias("step"),
                *[f"a{p}" for p in spans],
                *[
                    F.sqrt(F.greatest(F.col(f"_q{p}") - F.col(f"a{p}") * F.col(f"a{p}"), F.lit(0.0))).alias(f"b{p}")
                    for p in spans
                ],
            )
        )
        coefs.append(alpha)
        beta = alpha.df.select(*by, *[f"b{p}" for p in spans])
        turned = raw.df.join(alpha.df.drop("step"), by).select(
            *flat,
            "_deg",
            *[
                F.when(
                    F.col(f"b{p}") > 1e-10, (F.col(f"w{p}") - F.col(f"a{p}") * F.col(f"v{p}")) / F.col(f"b{p}")
                ).otherwise(0.0).alias(f"v{p}")
                for p in spans
            ],
            *[F.col(f"v{p}").alias(f"u{p}") for p in spans],
        )
        following = stage(turned)
        release(spark, state, raw)
        state = following
    release(spark, state, arcs)
    steps_table = coefs[1].df
    for part in coefs[2:]:
        steps_table = steps_table.unionByName(part.df)
    fields = ["step", *[f"a{p}" for p in spans], *[f"b{p}" for p in spans]]
    per_graph = steps_table.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_steps")
    )
    arrays = per_graph.join(sizes.df, by).select(
        *by,
        F.col("_n").alias("n"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.col(f"_steps.a{p}").alias("alpha"),
                        F.col(f"_steps.b{p}").alias("beta"),
                    )
                    for p in spans
                ]
            )
        ).alias("_t"),
    ).select(*by, "n", "_t.alpha", "_t.beta")

    @F.pandas_udf("struct<theta: array<double>, tau: array<double>>")
    def ritz(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
        theta, tau = [], []
        for a, b in zip(alpha, beta):
            a, b = np.asarray(a), np.asarray(b)
            stop = np.flatnonzero(b[:-1] <= 1e-10)
            k = int(stop[0]) + 1 if len(stop) else len(a)
            tri = np.diag(a[:k]) + np.diag(b[: k - 1], 1) + np.diag(b[: k - 1], -1)
            values, vectors = np.linalg.eigh(tri)
            theta.append(np.maximum(values, 0.0))
            tau.append(vectors[0] ** 2)
        return pd.DataFrame({"theta": theta, "tau": tau})

    return (
        arrays.withColumn("_r", ritz.asNondeterministic()("alpha", "beta"))
        .groupBy(*by, "n")
        .agg(
            F.flatten(F.collect_list("_r.theta")).alias("_theta"),
            F.flatten(F.collect_list("_r.tau")).alias("_tau"),
        )
        .select(
            *by,
            "n",
            F.concat(F.array(F.lit(0.0)), "_theta").alias("lambdas"),
            F.concat(
                F.array(F.lit(1.0)), F.transform("_tau", lambda t: t * (F.col("n") - 1) / F.lit(float(probes)))
            ).alias("weights"),
        )
    )


def spectrum_moments(spectrum: DataFrame) -> DataFrame:
    """Sums of the eigenvalues and of their squares, the traces of L and L^2."""
    def total(f):
        return F.aggregate(F.transform("lambdas", f), F.lit(0.0), lambda a, v: a + v)

    return spectrum.withColumn("trace1", total(lambda v: v)).withColumn("trace2", total(lambda v: v * v)).drop(
        "lambdas", "weights"
    )


def degree_moments(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """The same traces from the degrees: sum d, and sum d^2 + d for simple graphs."""
    d = F.col("degree")
    return degree(edges, key).groupBy(*names(key)).agg(
        F.sum(d).cast("double").alias("trace1"), F.sum(d * d + d).cast("double").alias("trace2")
    )
