"""Queries on spectra. Order stars have the spectrum {0, 1 (leaves - 1 times), leaves + 1}, which
gives SQL an exact closed form; general graphs are checked by the traces of L and L^2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_grid
from ..operators import curves as cv
from ..operators import histogram as hg
from ..operators import iterative as it
from ..operators import spectral as sp
from ..operators import tables as tb
from .graph_queries import COMP_SQL, simple_edges, weighted_edges
from .inputs import order_items, r, rd, table, with_views
from .registry import query

COARSE = log_grid(-1.0, 1.0, 9)


def star_spectra(spark, sf):
    return sp.laplacian_spectrum(order_items(spark, sf))


def parity(df):
    return df.withColumn("corpus", F.pmod("graph_id", F.lit(2)))


def grid_sql(lo, hi, n):
    return f"(SELECT i AS beta_idx, pow(10.0, {lo} + i * ({hi} - ({lo})) / {n - 1}.0) AS beta FROM (SELECT UNNEST(range({n})) AS i))"


def star_curve_sql(lo, hi, n):
    """Entropy per number of leaves and grid point."""
    return f"""zs AS (SELECT leaves, beta_idx, beta,
        1 + (leaves - 1) * exp(-beta) + exp(-beta * (leaves + 1)) AS z,
        (leaves - 1) * exp(-beta) + (leaves + 1) * exp(-beta * (leaves + 1)) AS e
        FROM (SELECT DISTINCT leaves FROM stars), {grid_sql(lo, hi, n)}),
      star_curve AS (SELECT leaves, beta_idx, beta, ln(z) + beta * e / z AS s, e / z AS mean_lam FROM zs)"""


FULL = (-3, 4, 300)


@query(
    "beta_grid",
    with_views(
        f"""WITH {star_curve_sql(*FULL)} SELECT beta_idx, {rd('beta', 8)} AS beta, count(*) AS n_curves
            FROM stars JOIN star_curve USING (leaves) GROUP BY ALL""",
        "stars",
    ),
)
def _(spark, sf):
    """The grid as it stands under the curves of all order graphs."""
    curves = sp.long_curve(sp.spectral_entropy(star_spectra(spark, sf)))
    counted = curves.groupBy("beta_idx").agg(F.count(F.lit(1)).alias("n_curves"))
    grid = sp.beta_grid(spark).withColumn("beta", r("beta", 8))
    return grid.join(counted, "beta_idx").select("beta_idx", "beta", "n_curves")


@query(
    "laplacian_spectrum",
    with_views(f"SELECT graph_id, CAST(rank AS INTEGER) AS rank, {rd('lam')} AS lam FROM star_spectrum", "star_spectrum"),
)
def _(spark, sf):
    return sp.rank_spectrum(star_spectra(spark, sf)).withColumn("lam", r("lam"))


@query(
    "laplacian_traces",
    with_views(
        f"""SELECT graph_id, count(*) AS n, {rd('sum(degree)')} AS trace1, {rd('sum(degree * degree + degree)')} AS trace2
            FROM degrees GROUP BY ALL""",
        "degrees",
    ),
)
def _(spark, sf):
    m = sp.spectrum_moments(sp.laplacian_spectrum(simple_edges(spark, sf)))
    return m.select("graph_id", "n", r("trace1").alias("trace1"), r("trace2").alias("trace2"))


@query(
    "spectral_entropy",
    with_views(
        f"""WITH {star_curve_sql(-1, 1, 9)} SELECT graph_id, CAST(beta_idx AS INTEGER) AS beta_idx, {rd('s')} AS s
            FROM stars JOIN star_curve USING (leaves)""",
        "stars",
    ),
)
def _(spark, sf):
    curves = sp.spectral_entropy(star_spectra(spark, sf), COARSE)
    return sp.long_curve(sp.clip_curve(curves), betas=COARSE).select("graph_id", "beta_idx", r("s").alias("s"))


def mean_form(spark, sf, form):
    curves = sp.spectral_entropy(parity(star_spectra(spark, sf)), form=form)
    return cv.ensemble_mean_curve(curves, "corpus").select(
        "corpus", "beta_idx", r("mean_s").alias("mean_s"), r("std_s").alias("std_s"), "n_curves"
    )


def mean_sql(expr):
    return with_views(
        f"""WITH {star_curve_sql(*FULL)} SELECT graph_id % 2 AS corpus, CAST(beta_idx AS INTEGER) AS beta_idx,
              {rd(f'avg({expr})')} AS mean_s, {rd(f'stddev_pop({expr})')} AS std_s, count(*) AS n_curves
            FROM stars JOIN star_curve USING (leaves) GROUP BY ALL""",
        "stars",
    )


@query("corpus_entropy_curve", mean_sql("1 - s / ln(leaves + 1)"))
def _(spark, sf):
    return mean_form(spark, sf, "complement")


@query("corpus_entropy_ratio", mean_sql("s / ln(leaves + 1)"))
def _(spark, sf):
    return mean_form(spark, sf, "ratio")


@query("corpus_entropy_plain", mean_sql("s"))
def _(spark, sf):
    return mean_form(spark, sf, "plain")


@query(
    "eigenvalue_density",
    with_views(
        f"""WITH lims AS (SELECT min(lam) AS lo, max(lam) AS hi FROM star_spectrum WHERE graph_id % 2 = 0),
            cnt AS (SELECT graph_id % 2 AS corpus, CAST(least(floor((lam - lo) / (hi - lo) * 80 + 1e-9), 79) AS BIGINT) AS bin,
                count(*) AS n FROM star_spectrum, lims WHERE lam BETWEEN lo AND hi GROUP BY ALL),
            grid AS (SELECT c AS corpus, b AS bin FROM (SELECT UNNEST([0, 1]) AS c), (SELECT UNNEST(range(80)) AS b))
            SELECT CAST(corpus AS BIGINT) AS corpus, CAST(bin AS BIGINT) AS bin, coalesce(n, 0) AS n,
              {rd('coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY corpus)')} AS pdf
            FROM grid LEFT JOIN cnt USING (corpus, bin)""",
        "star_spectrum",
    ),
)
def _(spark, sf):
    lam = parity(sp.clipped_eigenvalues(star_spectra(spark, sf)).withColumn("lam", F.round("lam", 9)))
    limits = hg.ranges_of(lam.where("corpus = 0"), "lam")
    return hg.empirical_pdf_cdf(lam, "lam", 80, "corpus", limits).select("corpus", "bin", "n", r("pdf").alias("pdf"))


@query(
    "spectral_log_likelihood",
    with_views(
        f"""WITH pairs AS (SELECT a.graph_id, a.leaves AS lo, b.leaves AS lm FROM stars a JOIN stars b ON b.graph_id = a.graph_id + 1),
            kinds AS (SELECT DISTINCT lo, lm FROM pairs),
            lam AS (SELECT lo, lm, UNNEST(range(1 + least(lo, lm))) AS rank FROM kinds),
            val AS (SELECT lo, lm, rank,
                CASE WHEN rank = 0 THEN 0 WHEN rank < lo THEN 1 ELSE lo + 1 END AS a,
                CASE WHEN rank = 0 THEN 0 WHEN rank < lm THEN 1 ELSE lm + 1 END AS b FROM lam),
            e AS (SELECT lo, lm, beta_idx, sum(b * exp(-beta * a)) / sum(exp(-beta * a)) AS tr, sum(exp(-beta * b)) AS z
                FROM val, {grid_sql(-1, 1, 9)} GROUP BY ALL)
            SELECT graph_id, CAST(beta_idx AS INTEGER) AS beta_idx, {rd('-tr - ln(z)')} AS log_likelihood
            FROM pairs JOIN e USING (lo, lm)""",
        "stars",
    ),
)
def _(spark, sf):
    s = star_spectra(spark, sf)
    model = s.select((F.col("graph_id") - 1).alias("graph_id"), F.col("lambdas").alias("model"))
    pairs = s.select("graph_id", F.col("lambdas").alias("observed")).join(model, "graph_id")
    out = sp.log_likelihood(pairs, COARSE)
    return out.select("graph_id", F.posexplode("log_likelihood").alias("beta_idx", "v")).select(
        "graph_id", "beta_idx", r("v").alias("log_likelihood")
    )


@query(
    "renormalize_spectrum",
    with_views(
        f"""SELECT graph_id, CAST(rank AS INTEGER) AS rank, {rd('lam')} AS lam FROM star_spectrum
            WHERE leaves > 1 AND rank < leaves""",
        "star_spectrum",
    ),
)
def _(spark, sf):
    s = star_spectra(spark, sf).where("n > 2")
    cut = sp.renormalize_spectrum(s, (F.col("n") - 1).cast("int"))
    return sp.rank_spectrum(cut).withColumn("lam", r("lam"))


def np_gradient_sql(source, cols):
    """Second-order differences on an uneven grid, as SQL windows."""
    return f"""{source}_h AS (SELECT *, lag(beta) OVER w AS x0, lead(beta) OVER w AS x2, lag(beta, 2) OVER w AS xm, lead(beta, 2) OVER w AS xp,
          lag(y) OVER w AS y0, lead(y) OVER w AS y2, lag(y, 2) OVER w AS ym, lead(y, 2) OVER w AS yp
        FROM {source} WINDOW w AS (PARTITION BY {cols} ORDER BY beta_idx)),
      {source}_g AS (SELECT *, CASE
          WHEN x0 IS NULL THEN -(2 * (x2 - beta) + (xp - x2)) / ((x2 - beta) * (xp - beta)) * y
             + (xp - beta) / ((x2 - beta) * (xp - x2)) * y2 - (x2 - beta) / ((xp - x2) * (xp - beta)) * yp
          WHEN x2 IS NULL THEN (beta - x0) / ((x0 - xm) * (beta - xm)) * ym
             - (beta - xm) / ((x0 - xm) * (beta - x0)) * y0 + (2 * (beta - x0) + (x0 - xm)) / ((beta - x0) * (beta - xm)) * y
          ELSE ((beta - x0) ** 2 * y2 + ((x2 - beta) ** 2 - (beta - x0) ** 2) * y - (x2 - beta) ** 2 * y0)
             / ((x2 - beta) * (beta - x0) * (x2 - x0)) END AS slope FROM {source}_h)"""


@query(
    "specific_heat_from_spectrum",
    with_views(
        f"""WITH {star_curve_sql(*FULL)}, c AS (SELECT leaves, beta_idx, beta, mean_lam AS y FROM star_curve),
            {np_gradient_sql('c', 'leaves')}
            SELECT graph_id % 2 AS corpus, CAST(beta_idx AS INTEGER) AS beta_idx, {rd('avg(-slope * beta * beta)', 5)} AS heat
            FROM stars JOIN c_g USING (leaves) GROUP BY ALL""",
        "stars",
    ),
)
def _(spark, sf):
    heat = sp.specific_heat_from_spectrum(parity(star_spectra(spark, sf)))
    mean = cv.ensemble_mean_curve(heat, "corpus", "c")
    return mean.select("corpus", "beta_idx", r("mean_s", 5).alias("heat"))


def star_long_curves(spark, sf):
    """One mean curve per number of leaves, in long form."""
    curves = sp.spectral_entropy(star_spectra(spark, sf))
    mean = cv.ensemble_mean_curve(curves.withColumn("leaves", F.col("n") - 1), "leaves")
    grid = sp.beta_grid(spark)
    return mean.join(F.broadcast(grid), "beta_idx").select("leaves", "beta_idx", "beta", F.col("mean_s").alias("s"))


@query(
    "specific_heat",
    with_views(
        f"""WITH {star_curve_sql(*FULL)}, c AS (SELECT leaves, beta_idx, beta, s AS y FROM star_curve),
            {np_gradient_sql('c', 'leaves')}
            SELECT leaves, CAST(beta_idx AS INTEGER) AS beta_idx, {rd('greatest(-slope * beta, 0)', 5)} AS heat FROM c_g""",
        "stars",
    ),
)
def _(spark, sf):
    heat = cv.specific_heat(star_long_curves(spark, sf), "s", "beta_idx", "beta", "leaves")
    return heat.select("leaves", "beta_idx", r("heat", 5).alias("heat"))


@query(
    "specific_heat_logdiff",
    with_views(
        f"""WITH {star_curve_sql(*FULL)}, d AS (SELECT leaves, beta_idx, -(lead(s) OVER w - s) / (lead(ln(beta)) OVER w - ln(beta)) AS heat
              FROM star_curve WINDOW w AS (PARTITION BY leaves ORDER BY beta_idx))
            SELECT leaves, CAST(beta_idx AS INTEGER) AS beta_idx, {rd('heat')} AS heat FROM d WHERE heat IS NOT NULL""",
        "stars",
    ),
)
def _(spark, sf):
    heat = cv.specific_heat_logdiff(star_long_curves(spark, sf), "s", "beta_idx", "beta", "leaves")
    return heat.select("leaves", "beta_idx", r("heat").alias("heat"))


@query(
    "density_matrix",
    with_views(
        """SELECT graph_id, count(*) AS n, CAST(1 AS DOUBLE) AS trace, CAST(1 AS DOUBLE) AS least_row, CAST(1 AS DOUBLE) AS most_row
           FROM degrees GROUP BY ALL""",
        "degrees",
    ),
)
def _(spark, sf):
    rho = sp.density_matrix(simple_edges(spark, sf), 0.5)
    row = F.aggregate("rho", F.lit(0.0), lambda a, v: a + v) * F.col("z")
    return rho.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.element_at("rho", (F.col("place") + 1).cast("int"))), 6).alias("trace"),
        F.round(F.min(row), 6).alias("least_row"),
        F.round(F.max(row), 6).alias("most_row"),
    )


@query(
    "effective_resistance",
    with_views(
        f"""SELECT l_orderkey AS graph_id, l_partkey AS node, {rd('sum(l_quantity)')} AS resistance FROM lineitem GROUP BY ALL
            UNION ALL SELECT graph_id, -1, CAST(0 AS DOUBLE) FROM stars""",
        "stars",
    ),
)
def _(spark, sf):
    edges = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("weight"))
        .withColumn("src", F.lit(-1).cast("long"))
    )
    return sp.effective_resistance(edges, -1).withColumn("resistance", F.round("resistance", 6) + F.lit(0.0))


@query(
    "foster_sum",
    with_views(
        f"""{COMP_SQL} SELECT graph_id, {rd('sum(size) - count(*)')} AS foster FROM sizes GROUP BY ALL""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    res = sp.edge_resistance(weighted_edges(spark, sf))
    return res.groupBy("graph_id").agg(F.round(F.sum(F.col("weight") * F.col("resistance")), 6).alias("foster"))


@query(
    "information_centrality",
    with_views(
        f"""SELECT graph_id, CAST(-1 AS BIGINT) AS node, {rd('1.0 / leaves')} AS centrality FROM stars
            UNION ALL SELECT graph_id, dst, {rd('1.0 / (2 * leaves - 1)')} FROM order_items JOIN stars USING (graph_id)""",
        "stars",
        "order_items",
    ),
)
def _(spark, sf):
    return sp.information_centrality(order_items(spark, sf)).withColumn("centrality", r("centrality"))


@query("spectral_entropy_large")
def _(spark, sf):
    """Customers and parts of all orders as one large graph."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    edges = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(
            F.lit(0).cast("long").alias("graph_id"),
            (-F.col("o_custkey") - 1).alias("src"),
            F.col("l_partkey").alias("dst"),
        )
        .distinct()
    )
    spectrum = sp.quadrature_spectrum(edges, steps=12, probes=4)
    return sp.long_curve(sp.spectral_entropy(spectrum, COARSE), betas=COARSE)


def odd_even_pairs(spark, sf):
    curves = parity(star_spectra(spark, sf))
    mean = cv.ensemble_mean_curve(sp.spectral_entropy(curves), "corpus")
    a = mean.where("corpus = 0").select("beta_idx", F.col("mean_s").alias("s"))
    b = mean.where("corpus = 1").select("beta_idx", F.col("mean_s").alias("s"))
    return cv.pair_curves(a, b, "beta_idx")


@query(
    "corpus_sse",
    with_views(
        f"""WITH {star_curve_sql(*FULL)}, m AS (SELECT graph_id % 2 AS corpus, beta_idx, avg(s) AS s
              FROM stars JOIN star_curve USING (leaves) GROUP BY ALL),
            d AS (SELECT sum((a.s - b.s) * (a.s - b.s)) AS sse FROM m a JOIN m b USING (beta_idx) WHERE a.corpus = 0 AND b.corpus = 1)
            SELECT {rd('sse', 8)} AS sse, {rd('1.0 / sse', 3)} AS fitness FROM d""",
        "stars",
    ),
)
def _(spark, sf):
    return cv.curve_sse(odd_even_pairs(spark, sf)).select(r("sse", 8).alias("sse"), r("fitness", 3).alias("fitness"))


HUB_ROW = "CASE WHEN node = -1 THEN 1.0 / n + leaves * fast / n ELSE (1 - fast) / n END"
LEAF_ROW = """CASE WHEN node = -1 THEN (1 - fast) / n
    ELSE 1.0 / n + fast / (n * leaves) - slow / leaves + CASE WHEN node = one THEN slow ELSE 0 END END"""


@query(
    "heat_kernel_rows",
    with_views(
        f"""WITH one AS (SELECT graph_id, min(dst) AS one FROM order_items GROUP BY ALL),
            e AS (SELECT *, leaves + 1 AS n, exp(-0.5) AS slow, exp(-0.5 * (leaves + 1)) AS fast FROM stars JOIN one USING (graph_id)),
            ends AS (SELECT graph_id, dst AS node FROM order_items UNION ALL SELECT graph_id, -1 FROM stars)
            SELECT graph_id, CAST(-1 AS BIGINT) AS source, node, {rd(HUB_ROW)} AS value FROM e JOIN ends USING (graph_id)
            UNION ALL SELECT graph_id, one, node, {rd(LEAF_ROW)} FROM e JOIN ends USING (graph_id)""",
        "stars",
        "order_items",
    ),
)
def _(spark, sf):
    """Rows of the hub and of the first leaf of every order."""
    edges = order_items(spark, sf)
    first = edges.groupBy("graph_id").agg(F.min("dst").alias("leaf"))
    sources = first.select("graph_id", F.explode(F.array(F.lit(-1).cast("long"), "leaf")).alias("source"))
    return it.heat_kernel_rows(edges, sources, 0.5).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(
    "pair_resistance",
    f"""WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS graph_id, n_nationkey, min(c_custkey) AS least, max(c_custkey) AS most,
          1.0 / (1 + n_nationkey % 3) AS up
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
        SELECT graph_id, CAST(-2 - n_nationkey AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, {rd('up')} AS resistance FROM c
        UNION ALL SELECT graph_id, most, -1, {rd('1 + up')} FROM c
        UNION ALL SELECT graph_id, least, most, {rd('CASE WHEN least = most THEN 0 ELSE 2 END')} FROM c
        UNION ALL SELECT x.graph_id, x.most, y.most, {rd('2 + x.up + y.up')}
          FROM c x JOIN c y ON x.graph_id = y.graph_id AND x.n_nationkey < y.n_nationkey""",
)
def _(spark, sf):
    """Trees of region, nations and customers: between nations and root, and between customers near and far."""
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("graph_id"), F.col("n_nationkey").cast("long").alias("nation"))
    customer = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").cast("long").alias("customer"))
    below = customer.join(nation, "nation")
    hub = (-2 - F.col("nation")).alias("src")
    down = below.select("graph_id", hub, F.col("customer").alias("dst"), F.lit(1.0).alias("weight"))
    up = below.select("graph_id", "nation").distinct()
    up = up.select("graph_id", hub, F.lit(-1).cast("long").alias("dst"), (1.0 + F.pmod("nation", F.lit(3))).alias("weight"))
    ends = below.groupBy("graph_id", "nation").agg(F.min("customer").alias("least"), F.max("customer").alias("most"))
    root = F.lit(-1).cast("long").alias("b")
    x, y = ends.alias("x"), ends.alias("y")
    far = x.join(y, (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.nation") < F.col("y.nation")))
    pairs = (
        ends.select("graph_id", (-2 - F.col("nation")).alias("a"), root)
        .unionByName(ends.select("graph_id", F.col("most").alias("a"), root))
        .unionByName(ends.select("graph_id", F.col("least").alias("a"), F.col("most").alias("b")))
        .unionByName(far.select(F.col("x.graph_id").alias("graph_id"), F.col("x.most").alias("a"), F.col("y.most").alias("b")))
    )
    found = it.pair_resistance(down.unionByName(up), pairs)
    return found.select("graph_id", "a", "b", (F.round("resistance", 6) + F.lit(0.0)).alias("resistance"))
