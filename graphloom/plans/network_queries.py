"""Queries on paths, communities, correlations, walks and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as cm
from ..operators import features as ft
from ..operators import multi_source as ms
from ..operators import paths as pt
from ..operators import structure as st
from ..operators import tables as tb
from ..sources import files as fs
from ..sources import graphml as gm
from ..staging import checkpoint_root
from .graph_queries import TRI_SQL, labelled, simple_edges, weighted_edges
from .inputs import order_items, point_edges, points, r, rd, run_log, table, with_views
from .registry import query


def first_nodes(edges):
    """Smallest node of every graph."""
    return edges.groupBy("graph_id").agg(F.min("src").alias("source"))


@query(
    "shortest_paths",
    with_views(
        """WITH RECURSIVE walk(graph_id, source, node, hops) AS (
             SELECT graph_id, min(node), min(node), 0 FROM degrees GROUP BY graph_id
             UNION
             SELECT k.graph_id, source, b.w, hops + 1 FROM walk k JOIN both_ways b ON b.graph_id = k.graph_id AND b.u = k.node
             WHERE hops < 25)
           SELECT graph_id, source, node, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY ALL""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    edges = simple_edges(spark, sf)
    return pt.hop_counts(edges, first_nodes(edges))


PAIRS_SQL = """WITH RECURSIVE far(graph_id, s, node, hops) USING KEY (graph_id, s, node) AS (
      SELECT graph_id, node, node, 0 FROM degrees
      UNION
      SELECT f.graph_id, f.s, b.w, min(f.hops + 1) FROM far f JOIN both_ways b ON b.graph_id = f.graph_id AND b.u = f.node
      LEFT JOIN recurring.far o ON o.graph_id = f.graph_id AND o.s = f.s AND o.node = b.w
      WHERE o.hops IS NULL GROUP BY f.graph_id, f.s, b.w),
    per AS (SELECT graph_id, s, count(*) FILTER (WHERE hops > 0) AS reached, sum(hops) AS total, max(hops) AS ecc FROM far GROUP BY ALL)"""


@query(
    "average_shortest_path",
    with_views(
        f"""{PAIRS_SQL} SELECT graph_id, {rd('avg(total / reached)')} AS avg_path, CAST(max(ecc) AS BIGINT) AS diameter
            FROM per WHERE reached > 0 GROUP BY ALL""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    return pt.average_shortest_path(ms.hop_sums(simple_edges(spark, sf))).withColumn("avg_path", r("avg_path"))


@query(
    "diameter",
    with_views(
        f"{PAIRS_SQL} SELECT graph_id, s AS node, CAST(ecc AS BIGINT) AS eccentricity FROM per", "degrees", "both_ways"
    ),
)
def _(spark, sf):
    return ms.hop_sums(simple_edges(spark, sf)).select("graph_id", "node", "eccentricity")


@query(
    "path_length_histogram",
    with_views(
        f"{PAIRS_SQL} SELECT graph_id, CAST(hops AS BIGINT) AS hops, count(*) AS pairs FROM far GROUP BY ALL",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    return ms.hop_histogram(simple_edges(spark, sf))


@query(
    "betweenness_stars",
    with_views(
        """SELECT graph_id, CAST(-1 AS BIGINT) AS node, CAST(CASE WHEN leaves > 1 THEN 1 ELSE 0 END AS DOUBLE) AS betweenness FROM stars
           UNION ALL SELECT graph_id, dst, CAST(0 AS DOUBLE) FROM order_items""",
        "stars",
        "order_items",
    ),
)
def _(spark, sf):
    return pt.betweenness(order_items(spark, sf)).withColumn("betweenness", F.round("betweenness", 9) + F.lit(0.0))


@query(
    "betweenness_joins",
    with_views(
        """SELECT graph_id, CAST(-1 AS BIGINT) AS node, CAST(CASE WHEN leaves > 1 THEN 1 ELSE 0 END AS DOUBLE) AS betweenness FROM stars
           UNION ALL SELECT graph_id, dst, CAST(0 AS DOUBLE) FROM order_items""",
        "stars",
        "order_items",
    ),
)
def _(spark, sf):
    return pt.betweenness_joins(order_items(spark, sf)).withColumn("betweenness", F.round("betweenness", 9) + F.lit(0.0))


@query(
    "betweenness",
    with_views(
        f"""{PAIRS_SQL}, n AS (SELECT graph_id, count(*) AS n FROM degrees GROUP BY ALL)
            SELECT f.graph_id, {rd('sum(hops - 1) / max((n - 1) * (n - 2))')} AS total
            FROM far f JOIN n USING (graph_id) WHERE hops > 0 GROUP BY f.graph_id""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    """Betweenness of a graph adds up to the inner nodes of all its shortest paths."""
    b = pt.betweenness(simple_edges(spark, sf))
    return b.groupBy("graph_id").agg(r(F.sum("betweenness")).alias("total"))


@query(
    "betweenness_nodes",
    with_views(
        f"""WITH RECURSIVE far(graph_id, s, node, hops, paths) USING KEY (graph_id, s, node) AS (
              SELECT graph_id, node, node, 0, CAST(1 AS DOUBLE) FROM degrees
              UNION
              SELECT f.graph_id, f.s, b.w, min(f.hops + 1), sum(f.paths) FROM far f JOIN both_ways b ON b.graph_id = f.graph_id AND b.u = f.node
              LEFT JOIN recurring.far o ON o.graph_id = f.graph_id AND o.s = f.s AND o.node = b.w
              WHERE o.hops IS NULL GROUP BY f.graph_id, f.s, b.w),
            n AS (SELECT graph_id, count(*) AS n FROM degrees GROUP BY ALL),
            inner_paths AS (SELECT x.graph_id, x.node, sum(x.paths * y.paths / z.paths) AS b
              FROM far x JOIN far y ON y.graph_id = x.graph_id AND y.s = x.node
              JOIN far z ON z.graph_id = x.graph_id AND z.s = x.s AND z.node = y.node
              WHERE x.s <> x.node AND y.s <> y.node AND z.hops = x.hops + y.hops GROUP BY x.graph_id, x.node)
            SELECT d.graph_id, d.node, {rd('CASE WHEN n > 2 THEN COALESCE(b, 0) / ((n - 1) * (n - 2)) ELSE 0 END', 8)} AS betweenness
            FROM degrees d JOIN n USING (graph_id) LEFT JOIN inner_paths USING (graph_id, node)""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    return pt.betweenness_joins(simple_edges(spark, sf)).withColumn("betweenness", r("betweenness", 8))


@query("community_detection")
def _(spark, sf):
    return cm.community_detection(weighted_edges(spark, sf))


@query(
    "graph_profile",
    with_views(
        f"""{PAIRS_SQL.replace('WITH RECURSIVE', 'WITH RECURSIVE')}, {TRI_SQL[5:]},
            a AS (SELECT graph_id, count(*) AS n, sum(degree) / power(count(*), 2) AS sparsity, avg(degree) AS avg_degree FROM degrees GROUP BY ALL),
            c AS (SELECT graph_id, avg(clustering) AS cl FROM clu GROUP BY ALL),
            d AS (SELECT graph_id, max(ecc) AS diameter FROM per GROUP BY ALL)
            SELECT graph_id, n, {rd('sparsity')} AS sparsity, {rd('avg_degree')} AS avg_degree, {rd('cl')} AS avg_clustering,
              CAST(diameter AS BIGINT) AS diameter FROM a JOIN c USING (graph_id) JOIN d USING (graph_id)""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    edges = simple_edges(spark, sf)
    size = tb.density_and_sparsity(edges)
    cl = st.average_clustering(st.clustering_coefficient(edges))
    far = pt.average_shortest_path(ms.hop_sums(edges))
    out = size.join(tb.average_degree(edges), "graph_id").join(cl, "graph_id").join(far, "graph_id")
    return out.select(
        "graph_id",
        "n",
        r("sparsity").alias("sparsity"),
        r("avg_degree").alias("avg_degree"),
        r("avg_clustering").alias("avg_clustering"),
        "diameter",
    )


@query(
    "pearson",
    with_views(
        f"SELECT run_id, {rd('corr(beta, fitness)')} AS corr, count(*) AS n FROM run_log GROUP BY ALL", "run_log"
    ),
)
def _(spark, sf):
    out = ft.pearson(run_log(spark, sf), "beta", "fitness", "run_id")
    return out.select("run_id", r("corr").alias("corr"), "n")


# Simpson's rule over the tail of cos^(n - 3), as the correlation's sine substitution gives it
P_VALUE_SQL = f"""WITH c AS (SELECT run_id, corr(beta, fitness) AS corr, count(*) AS n FROM run_log GROUP BY ALL),
    g AS (SELECT *, asin(least(abs(corr), 1)) AS lo, least(pi() / 2, asin(least(abs(corr), 1)) + 40 / sqrt(n - 2)) AS hi FROM c),
    s AS (SELECT run_id, corr, n, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * power(greatest(cos(lo + (hi - lo) * i / 4000.0), 0), n - 3)) * any_value(hi - lo) / 12000 AS tail
      FROM g, (SELECT UNNEST(range(4001)) AS i) GROUP BY run_id, corr, n)
    SELECT run_id, {rd('corr')} AS corr, n, {rd('least(1, tail / (exp(lgamma((n - 2) / 2) - lgamma((n - 1) / 2)) * sqrt(pi()) / 2))', 6)} AS p_value FROM s"""


@query("pearson_p_value", with_views(P_VALUE_SQL, "run_log"))
def _(spark, sf):
    out = ft.pearson(run_log(spark, sf), "beta", "fitness", "run_id")
    return out.select("run_id", r("corr").alias("corr"), "n", r("p_value", 6).alias("p_value"))


@query("kmeans")
def _(spark, sf):
    df = run_log(spark, sf).select("run_id", "generation", "d", "p", "beta")
    return ft.kmeans(df, ["d", "p", "beta"], 4)


@query(
    "assign_clusters",
    with_views(
        """WITH c AS (SELECT CAST(floor(beta * 4.99) AS BIGINT) AS cluster, avg(d) AS cd, avg(beta) AS cb FROM run_log GROUP BY ALL)
           SELECT run_id, generation, order_id, part_id, line, min((power(d - cd, 2) + power(beta - cb, 2), cluster))[2] AS cluster
           FROM run_log, c GROUP BY run_id, generation, order_id, part_id, line, d, beta, p, fitness""",
        "run_log",
    ),
)
def _(spark, sf):
    log = run_log(spark, sf)
    centers = log.groupBy(F.floor(F.col("beta") * 4.99).alias("cluster")).agg(F.avg("d").alias("d"), F.avg("beta").alias("beta"))
    out = ft.assign_clusters(log, centers, ["d", "beta"])
    return out.select("run_id", "generation", "order_id", "part_id", "line", "cluster")


@query(
    "random_walks",
    with_views(
        """WITH RECURSIVE adj AS (SELECT graph_id, u, w, row_number() OVER (PARTITION BY graph_id, u ORDER BY w) - 1 AS i FROM both_ways),
           walk_state(graph_id, walk, start, node, step, path) AS (
             SELECT graph_id, UNNEST(range(10)), node, node, 0, CAST(node AS VARCHAR) FROM degrees
             UNION ALL
             SELECT s.graph_id, s.walk, s.start, a.w, s.step + 1, s.path || '>' || a.w FROM walk_state s
             JOIN degrees d ON d.graph_id = s.graph_id AND d.node = s.node
             JOIN adj a ON a.graph_id = s.graph_id AND a.u = s.node
               AND a.i = CAST('0x' || substr(md5('1-' || (s.step + 1) || '-' || s.graph_id || '-' || s.start || '-' || s.walk), 1, 8) AS BIGINT) % d.degree
             WHERE s.step < 19)
           SELECT graph_id, CAST(walk AS INTEGER) AS walk, start, path FROM walk_state WHERE step = 19""",
        "both_ways",
        "degrees",
    ),
)
def _(spark, sf):
    walks = ft.random_walks(simple_edges(spark, sf), length=20, walks=10)
    return walks.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("walk_embedding")
def _(spark, sf):
    walks = ft.random_walks(simple_edges(spark, sf), length=10, walks=2)
    return ft.walk_embedding(walks)


@query(
    "map_groups",
    f"SELECT event_type, count(*) AS n, {rd('sum(value)', 4)} AS total FROM events GROUP BY ALL",
)
def _(spark, sf):
    def totals(group, batches):
        import pandas as pd

        n, total = 0, 0.0
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        yield pd.DataFrame({"event_type": [group[0]], "n": [n], "total": [total]})

    e = table(spark, sf, "events").select("event_type", "value")
    return ft.map_groups(e, "event_type", totals, "event_type string, n long, total double").withColumn("total", r("total", 4))


@query(
    "map_parameters",
    """SELECT CAST(t AS DOUBLE) AS cut, count(*) AS n FROM events, (SELECT UNNEST([10.0, 20.0, 30.0]) AS t)
       WHERE value > t GROUP BY ALL""",
)
def _(spark, sf):
    swept = ft.map_parameters(table(spark, sf, "events"), "cut", [10.0, 20.0, 30.0])
    return swept.where("value > cut").groupBy("cut").agg(F.count(F.lit(1)).alias("n"))


def fresh_path(spark, name):
    import uuid

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CORPUS_SQL = with_views(
    """SELECT corpus, n, m FROM (SELECT graph_id % 2 AS corpus, count(*) AS n FROM points GROUP BY ALL)
       JOIN (SELECT graph_id % 2 AS corpus, count(*) AS m FROM point_edges GROUP BY ALL) USING (corpus)""",
    "points",
    "point_edges",
)


@query("write_corpus", CORPUS_SQL)
def _(spark, sf):
    path = fresh_path(spark, "corpus")
    fs.write_corpus(labelled(points(spark, sf)), labelled(point_edges(spark, sf)), path)
    nodes, edges = fs.read_corpus(spark, path)
    n = nodes.groupBy(F.col("corpus").cast("long").alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(F.col("corpus").cast("long").alias("corpus")).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "corpus")


@query(
    "write_results",
    with_views("SELECT run_id, generation, max(fitness) AS best FROM run_log GROUP BY ALL", "run_log"),
)
def _(spark, sf):
    best = run_log(spark, sf).groupBy("run_id", "generation").agg(F.max("fitness").alias("best"))
    path = fresh_path(spark, "results")
    fs.write_results(best, path)
    return spark.read.option("header", True).schema("run_id long, generation long, best double").csv(path)


@query(
    "scan_results",
    with_views("SELECT run_id, generation, max(fitness) AS best FROM run_log GROUP BY ALL", "run_log"),
)
def _(spark, sf):
    best = run_log(spark, sf).groupBy("run_id", "generation").agg(F.max("fitness").alias("best"))
    path = fresh_path(spark, "results")
    fs.write_results(best, path, "json")
    return fs.scan_results(spark, path, schema="run_id long, generation long, best double")


@query(
    "write_selected_params",
    with_views(
        f"SELECT CAST(round(p * 100) AS BIGINT) AS peak, {rd('avg(beta)', 4)} AS beta, count(*) AS number_of_samples FROM run_log GROUP BY ALL",
        "run_log",
    ),
)
def _(spark, sf):
    from ..operators.runs import peak_parameter_summary

    log = run_log(spark, sf).withColumn("peak", F.round(F.col("p") * 100).cast("long"))
    path = fresh_path(spark, "params")
    fs.write_selected_params(peak_parameter_summary(log, ["d", "p", "beta"]), path)
    schema = "beta double, number_of_samples long, peak long"
    return spark.read.schema(schema).json(path)


def block_documents(spark, sf):
    """Nodes and edges of each block of events, gathered per block of at most 400."""
    pts = points(spark, sf).groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "x", "y")).alias("ns"))
    links = point_edges(spark, sf).groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("es"))
    return pts.join(links, "graph_id")


@query(
    "scan_graphml",
    with_views(
        """SELECT graph_id, src, dst, a.x AS src_x, b.y AS dst_y, CAST(dst - src AS DOUBLE) / 2 AS length
           FROM point_edges e JOIN points a ON a.node_id = src AND a.graph_id = e.graph_id JOIN points b ON b.node_id = dst""".replace(
            "SELECT graph_id", "SELECT e.graph_id"
        ),
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    def data(key, value):
        return F.concat(F.lit(f'<data key="{key}">'), value.cast("string"), F.lit("</data>"))

    nodes = F.transform(
        "ns",
        lambda n: F.concat(F.lit('<node id="'), n["node_id"].cast("string"), F.lit('">'), data("d0", n["x"]), data("d1", n["y"]), F.lit("</node>")),
    )
    edges = F.transform(
        "es",
        lambda e: F.concat(
            F.lit('<edge source="'), e["dst"].cast("string"), F.lit('" target="'), e["src"].cast("string"), F.lit('">'),
            data("d3", (e["dst"] - e["src"]) / 2), data("d6", F.lit(1)), F.lit("</edge>"),
        ),
    )
    keys = "".join(
        f'<key id="{i}" for="{w}" attr.name="{n}" attr.type="{t}"/>'
        for i, w, n, t in (("d6", "edge", "length", "long"), ("d3", "edge", "length", "double"), ("d1", "node", "y", "long"), ("d0", "node", "x", "long"))
    )
    text = F.concat(
        F.lit(f"<graphml>{keys}<graph edgedefault=\"undirected\">"), F.array_join(nodes, ""), F.array_join(edges, ""), F.lit("</graph></graphml>")
    )
    path = fresh_path(spark, "graphml")
    docs = block_documents(spark, sf).select("graph_id", text.alias("value"))
    docs.write.partitionBy("graph_id").text(path)
    n, e = gm.scan_graphml(spark, path)
    place = n.select(F.col("node_id").cast("long").alias("node"), "x", "y")
    e = e.select(
        F.least(F.col("src").cast("long"), F.col("dst").cast("long")).alias("src"),
        F.greatest(F.col("src").cast("long"), F.col("dst").cast("long")).alias("dst"),
        "length",
    )
    out = tb.attach_node_attrs(e, place, ["x", "y"], key=None)
    return out.select(F.floor(F.col("src") / 400).alias("graph_id"), "src", "dst", "src_x", "dst_y", "length")


@query(
    "scan_annotations",
    with_views(
        """WITH e AS (SELECT DISTINCT e.graph_id, least((a.x, a.y), (b.x, b.y)) AS p, greatest((a.x, a.y), (b.x, b.y)) AS q
             FROM point_edges e JOIN points a ON a.node_id = src JOIN points b ON b.node_id = dst)
           SELECT '(' || p[1] || ', ' || p[2] || ')' AS src, '(' || q[1] || ', ' || q[2] || ')' AS dst, count(*) AS graphs FROM e GROUP BY ALL""",
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    place = points(spark, sf).select("graph_id", F.col("node_id").alias("node"), F.array("x", "y").alias("p"))
    ends = tb.attach_node_attrs(point_edges(spark, sf), place, ["p"])
    docs = (
        ends.groupBy("graph_id").agg(F.collect_list(F.array("dst_p", "src_p")).alias("edges"))
        .join(place.groupBy("graph_id").agg(F.collect_list("p").alias("nodes")), "graph_id")
    )
    path = fresh_path(spark, "annotations")
    docs.select("nodes", "edges", "graph_id").write.partitionBy("graph_id").json(path)
    _nodes, edges = gm.scan_annotations(spark, path, multi_line=False)
    return edges.groupBy("src", "dst").agg(F.countDistinct("corpus").alias("graphs"))


@query(
    "scan_run_log",
    with_views(
        "SELECT generation, rank, count(*) AS n, "
        + rd("sum(fitness)", 2)
        + """ AS fitness FROM (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY generation) - 1 AS INTEGER) AS generation, rank, fitness FROM (
             SELECT run_id, generation, CAST(0 AS INTEGER) AS rank, max(fitness) AS fitness FROM run_log GROUP BY ALL)) GROUP BY ALL""",
        "run_log",
    ),
)
def _(spark, sf):
    best = run_log(spark, sf).groupBy("run_id", "generation").agg(
        F.max("fitness").alias("f"), F.max_by(F.array("d", "p", "beta"), F.struct("fitness", "d", "p", "beta")).alias("s")
    )
    docs = best.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("generation", "f", "s"))).alias("g")).select(
        "run_id",
        F.transform("g", lambda g: F.array(g["f"])).alias("fitness"),
        F.transform("g", lambda g: F.array(g["s"])).alias("solution"),
    )
    path = fresh_path(spark, "runs")
    docs.write.partitionBy("run_id").json(path)
    log = fs.scan_run_log(spark, path)
    return log.groupBy("generation", "rank").agg(F.count(F.lit(1)).alias("n"), r(F.sum("fitness"), 2).alias("fitness"))


@query(
    "scan_region_features",
    f"""SELECT s_suppkey AS label, {rd('s_acctbal')} AS mean_intensity FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_acctbal").alias("mean_intensity"))
    path = fresh_path(spark, "regions")
    fs.write_results(s, path)
    return fs.scan_region_features(spark, path).select("label", r("mean_intensity").alias("mean_intensity"))


@query(
    "incremental_scan",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return fs.incremental_scan(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")
