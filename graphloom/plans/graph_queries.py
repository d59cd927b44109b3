"""Queries on the weekly supplier graphs: cleaning, degrees, structure, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as comp
from ..operators import structure as st
from ..operators import tables as tb
from .inputs import order_items, points, r, rd, table, weekly_links, with_views
from .registry import query


def weekly_edges(spark, sf):
    return tb.edges_from_table(weekly_links(spark, sf), "a", "b")


def simple_edges(spark, sf):
    return tb.remove_self_loops(weekly_edges(spark, sf))


def weighted_edges(spark, sf):
    links = weekly_links(spark, sf).where("a <> b")
    return tb.edges_from_table(links, "a", "b", weight=F.sum("q"))


def labelled(edges):
    """Two corpora: even and odd weeks."""
    return edges.withColumn("corpus", F.pmod("graph_id", F.lit(2)))


@query("edges_from_table", with_views("SELECT * FROM weighted_edges", "weighted_edges"))
def _(spark, sf):
    return weighted_edges(spark, sf)


@query("dedup_edges", with_views("SELECT * FROM weekly_edges", "weekly_edges"))
def _(spark, sf):
    links = weekly_links(spark, sf).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return tb.dedup_edges(links)


@query("remove_self_loops", with_views("SELECT * FROM simple_edges", "simple_edges"))
def _(spark, sf):
    return simple_edges(spark, sf)


@query(
    "filter_nodes_by_attr",
    with_views("SELECT graph_id, node_id, x, y FROM points WHERE event_type = 'error'", "points"),
)
def _(spark, sf):
    nodes = tb.filter_nodes_by_attr(points(spark, sf), "event_type", "error")
    return nodes.select("graph_id", "node_id", "x", "y")


MAX_DEGREE_SQL = """
    , ends_all AS (SELECT graph_id, src AS node FROM weekly_edges
                   UNION ALL SELECT graph_id, dst FROM weekly_edges),
    deg AS (SELECT graph_id, node, count(*) AS degree FROM ends_all GROUP BY ALL),
    flags AS (SELECT graph_id, max(degree) AS max_degree FROM deg GROUP BY ALL)"""


@query(
    "filter_by_max_degree",
    with_views("SELECT 1", "weekly_edges").replace(" SELECT 1", "")
    + MAX_DEGREE_SQL
    + " SELECT e.* FROM weekly_edges e JOIN flags f USING (graph_id) WHERE f.max_degree < 8",
)
def _(spark, sf):
    kept, _removed = tb.filter_by_max_degree(weekly_edges(spark, sf), 8)
    return kept


@query(
    "max_degree_removed_share",
    with_views("SELECT 1", "weekly_edges").replace(" SELECT 1", "")
    + MAX_DEGREE_SQL
    + f" SELECT {rd('avg(CASE WHEN max_degree < 8 THEN 0.0 ELSE 1.0 END) * 100')} AS pct_removed FROM flags",
)
def _(spark, sf):
    _kept, removed = tb.filter_by_max_degree(weekly_edges(spark, sf), 8)
    return removed.select(r("pct_removed").alias("pct_removed"))


@query(
    "drop_isolated",
    with_views(
        """SELECT graph_id, node_id AS node FROM points p WHERE event_id_is_linked
        """.replace(
            "event_id_is_linked",
            "node_id IN (SELECT src FROM heavy UNION ALL SELECT dst FROM heavy)",
        ).replace("SELECT graph_id", "WITH heavy AS (SELECT * FROM point_edges WHERE dst - src > 6) SELECT graph_id", 1),
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    from .inputs import point_edges

    nodes = points(spark, sf).select("graph_id", F.col("node_id").alias("node"))
    heavy = point_edges(spark, sf).where("dst - src > 6")
    return tb.drop_isolated(nodes, heavy)


@query(
    "two_core",
    with_views(
        """WITH RECURSIVE strip(round, graph_id, src, dst) AS (
             SELECT 0, graph_id, src, dst FROM simple_edges
             UNION ALL
             SELECT round + 1, graph_id, src, dst FROM (
               SELECT s.*, count(*) OVER (PARTITION BY graph_id, src) AS as_src,
                 count(*) OVER (PARTITION BY graph_id, dst) AS as_dst,
                 (SELECT count(*) FROM strip t WHERE t.graph_id = s.graph_id AND t.dst = s.src) AS src_in,
                 (SELECT count(*) FROM strip t WHERE t.graph_id = s.graph_id AND t.src = s.dst) AS dst_in
               FROM strip s)
             WHERE as_src + src_in > 1 AND as_dst + dst_in > 1 AND round < 60)
           SELECT graph_id, src, dst FROM strip WHERE round = 60""",
        "simple_edges",
    ),
)
def _(spark, sf):
    _nodes, core = tb.two_core(simple_edges(spark, sf))
    return core


@query(
    "set_weights",
    with_views(
        """SELECT graph_id, src, dst, CASE WHEN (src + dst) % 3 = 0 THEN weight * 2 ELSE weight END AS weight
           FROM weighted_edges""",
        "weighted_edges",
    ),
)
def _(spark, sf):
    edges = weighted_edges(spark, sf)
    new = edges.where("(src + dst) % 3 = 0").withColumn("weight", F.col("weight") * 2)
    return tb.set_weights(edges, new)


@query("remove_attribute", with_views("SELECT graph_id, src, dst FROM weighted_edges", "weighted_edges"))
def _(spark, sf):
    return tb.remove_attribute(weighted_edges(spark, sf), "weight")


@query(
    "attach_node_attrs",
    with_views(
        f"""SELECT e.graph_id, e.src, e.dst, a.s_nationkey AS src_nation, b.s_nationkey AS dst_nation,
              {rd('a.s_acctbal')} AS src_balance, {rd('b.s_acctbal')} AS dst_balance
            FROM simple_edges e JOIN supplier a ON a.s_suppkey = e.src JOIN supplier b ON b.s_suppkey = e.dst""",
        "simple_edges",
    ),
)
def _(spark, sf):
    nodes = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("nation"), r("s_acctbal").alias("balance")
    )
    return tb.attach_node_attrs(simple_edges(spark, sf), nodes, ["nation", "balance"], key=None)


@query(
    "intersect_nodes",
    with_views(
        """SELECT DISTINCT graph_id, src AS node FROM simple_edges INTERSECT
           SELECT DISTINCT graph_id, dst FROM simple_edges""",
        "simple_edges",
    ),
)
def _(spark, sf):
    e = simple_edges(spark, sf)
    return tb.intersect_nodes(
        e.withColumnRenamed("src", "node"), e.withColumnRenamed("dst", "node")
    )


@query(
    "add_ground_node",
    with_views(
        """SELECT graph_id, CAST(-1 AS BIGINT) AS src, node_id AS dst, CAST(1 AS DOUBLE) AS weight
           FROM points WHERE x > 64
           UNION ALL SELECT graph_id, src, dst, CAST(dst - src AS DOUBLE) FROM point_edges""",
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    from .inputs import point_edges

    nodes = points(spark, sf).withColumnRenamed("node_id", "node")
    edges = point_edges(spark, sf).withColumn("weight", (F.col("dst") - F.col("src")).cast("double"))
    return tb.add_ground_node(nodes, edges, 64)[1]


@query(
    "add_self_loops",
    with_views(
        f"""WITH s AS (SELECT graph_id, node_id, value, min(value) OVER g AS lo, max(value) OVER g AS hi
              FROM points WINDOW g AS (PARTITION BY graph_id)),
            l AS (SELECT graph_id, node_id, lo + (value - lo) * (1 - lo) / (hi - lo) AS w FROM s)
            SELECT graph_id, node_id AS src, node_id AS dst, {rd('w')} AS weight FROM l WHERE w > 0.7
            UNION ALL SELECT graph_id, src, dst, CAST(1 AS DOUBLE) FROM point_edges""",
        "points",
        "point_edges",
    ),
)
def _(spark, sf):
    from .inputs import point_edges

    nodes = points(spark, sf).withColumnRenamed("node_id", "node")
    edges = point_edges(spark, sf).withColumn("weight", F.lit(1.0))
    return tb.add_self_loops(nodes, edges, "value").withColumn("weight", r("weight"))


@query(
    "graph_size",
    with_views(
        """SELECT n.graph_id, n, m FROM (SELECT graph_id, count(*) AS n FROM degrees GROUP BY ALL) n
           JOIN (SELECT graph_id, count(*) AS m FROM simple_edges GROUP BY ALL) m USING (graph_id)""",
        "degrees",
    ),
)
def _(spark, sf):
    return tb.graph_size(simple_edges(spark, sf))


@query(
    "degree",
    with_views(
        """SELECT graph_id, node, CAST(count(*) AS BIGINT) AS degree FROM (
             SELECT graph_id, src AS node FROM weekly_edges UNION ALL SELECT graph_id, dst FROM weekly_edges)
           GROUP BY ALL""",
        "weekly_edges",
    ),
)
def _(spark, sf):
    return tb.degree(weekly_edges(spark, sf))


@query(
    "average_degree",
    with_views(
        f"""SELECT graph_id, {rd('avg(degree)')} AS avg_degree, {rd('stddev_pop(degree)')} AS std_degree,
            max(degree) AS max_degree FROM degrees GROUP BY ALL""",
        "degrees",
    ),
)
def _(spark, sf):
    return tb.average_degree(simple_edges(spark, sf)).select(
        "graph_id", r("avg_degree").alias("avg_degree"), r("std_degree").alias("std_degree"), "max_degree"
    )


@query(
    "average_weighted_degree",
    with_views(
        f"""SELECT graph_id, {rd('avg(s)')} AS avg_strength FROM (
              SELECT graph_id, node, sum(weight) AS s FROM (
                SELECT graph_id, src AS node, weight FROM weighted_edges
                UNION ALL SELECT graph_id, dst, weight FROM weighted_edges) GROUP BY ALL) GROUP BY graph_id""",
        "weighted_edges",
    ),
)
def _(spark, sf):
    return tb.average_weighted_degree(weighted_edges(spark, sf)).withColumn("avg_strength", r("avg_strength"))


@query(
    "degree_distribution",
    with_views(
        f"""SELECT graph_id % 2 AS corpus, degree, count(*) AS n,
              {rd('count(*) / sum(count(*)) OVER (PARTITION BY graph_id % 2)')} AS p
            FROM degrees GROUP BY 1, 2""",
        "degrees",
    ),
)
def _(spark, sf):
    deg = labelled(tb.degree(simple_edges(spark, sf)))
    return tb.degree_distribution(deg, "corpus").withColumn("p", r("p"))


@query(
    "degree_rank",
    with_views(
        """SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC) AS rank, degree
           FROM degrees""",
        "degrees",
    ),
)
def _(spark, sf):
    return tb.degree_rank(tb.degree(simple_edges(spark, sf)))


PAIR_SQL = """WITH pairs AS (
      SELECT b.graph_id, d1.degree AS k1, d2.degree AS k2 FROM both_ways b
      JOIN degrees d1 ON d1.graph_id = b.graph_id AND d1.node = b.u
      JOIN degrees d2 ON d2.graph_id = b.graph_id AND d2.node = b.w)"""


@query(
    "degree_correlation_matrix",
    with_views(
        f"""{PAIR_SQL} SELECT graph_id, k1, k2,
              {rd('count(*) / sum(count(*)) OVER (PARTITION BY graph_id)')} AS p FROM pairs GROUP BY graph_id, k1, k2""",
        "both_ways",
        "degrees",
    ),
)
def _(spark, sf):
    return st.degree_correlation_matrix(simple_edges(spark, sf)).withColumn("p", r("p"))


@query(
    "degree_correlation_pooled_dense",
    with_views(
        f"""{PAIR_SQL}, ks AS (SELECT UNNEST(range(0, (SELECT max(k1) + 1 FROM pairs))) AS k),
            grid AS (SELECT c, a.k AS k1, b.k AS k2 FROM ks a, ks b, (SELECT DISTINCT graph_id % 2 AS c FROM pairs)),
            cnt AS (SELECT graph_id % 2 AS c, k1, k2, count(*) AS n FROM pairs GROUP BY ALL),
            tot AS (SELECT c, sum(n) AS t FROM cnt GROUP BY ALL)
            SELECT g.c AS corpus, g.k1, g.k2, {rd('coalesce(n, 0) / t')} AS p
            FROM grid g JOIN tot USING (c) LEFT JOIN cnt USING (c, k1, k2)""",
        "both_ways",
        "degrees",
    ),
)
def _(spark, sf):
    matrix = st.degree_correlation_matrix(labelled(simple_edges(spark, sf)), pool="corpus")
    return st.degree_correlation_dense(matrix, "corpus").withColumn("p", r("p"))


@query(
    "degree_correlation_function",
    with_views(
        f"""{PAIR_SQL} SELECT graph_id, k1 AS degree, {rd('avg(k2)')} AS knn FROM pairs GROUP BY ALL""",
        "both_ways",
        "degrees",
    ),
)
def _(spark, sf):
    matrix = st.degree_correlation_matrix(simple_edges(spark, sf))
    return st.degree_correlation_function(matrix).withColumn("knn", r("knn"))


TRI_SQL = """WITH tri AS (
      SELECT a.graph_id, a.src AS p, a.dst AS q, b.dst AS s FROM simple_edges a
      JOIN simple_edges b ON b.graph_id = a.graph_id AND b.src = a.dst
      JOIN simple_edges c ON c.graph_id = a.graph_id AND c.src = a.src AND c.dst = b.dst),
    tri_per AS (SELECT graph_id, node, count(*) AS triangles FROM (
      SELECT graph_id, p AS node FROM tri UNION ALL SELECT graph_id, q FROM tri
      UNION ALL SELECT graph_id, s FROM tri) GROUP BY ALL),
    clu AS (SELECT d.graph_id, d.node, d.degree, coalesce(triangles, 0) AS triangles,
      CASE WHEN d.degree < 2 THEN CAST(0 AS DOUBLE)
           ELSE 2.0 * coalesce(triangles, 0) / (d.degree * (d.degree - 1)) END AS clustering
      FROM degrees d LEFT JOIN tri_per USING (graph_id, node))"""


@query("triangles", with_views(f"{TRI_SQL} SELECT * FROM tri_per", "simple_edges", "degrees"))
def _(spark, sf):
    return st.triangles(simple_edges(spark, sf))


@query(
    "clustering_coefficient",
    with_views(
        f"{TRI_SQL} SELECT graph_id, node, degree, triangles, {rd('clustering')} AS clustering FROM clu",
        "simple_edges",
        "degrees",
    ),
)
def _(spark, sf):
    return st.clustering_coefficient(simple_edges(spark, sf)).withColumn("clustering", r("clustering"))


@query(
    "average_clustering",
    with_views(
        f"{TRI_SQL} SELECT graph_id, {rd('avg(clustering)')} AS avg_clustering FROM clu GROUP BY ALL",
        "simple_edges",
        "degrees",
    ),
)
def _(spark, sf):
    c = st.clustering_coefficient(simple_edges(spark, sf))
    return st.average_clustering(c).withColumn("avg_clustering", r("avg_clustering"))


@query(
    "clustering_by_degree",
    with_views(
        f"""{TRI_SQL} SELECT graph_id % 2 AS corpus, degree, {rd('avg(clustering)')} AS mean_clustering,
            {rd('stddev_pop(clustering)')} AS std_clustering FROM clu GROUP BY ALL""",
        "simple_edges",
        "degrees",
    ),
)
def _(spark, sf):
    c = labelled(st.clustering_coefficient(simple_edges(spark, sf)))
    return st.clustering_by_degree(c, "corpus").select(
        "corpus", "degree", r("mean_clustering").alias("mean_clustering"), r("std_clustering").alias("std_clustering")
    )


COMP_SQL = """WITH RECURSIVE reach(graph_id, node, root) AS (
      SELECT graph_id, node, node FROM degrees
      UNION
      SELECT b.graph_id, b.w, r.root FROM reach r JOIN both_ways b ON b.graph_id = r.graph_id AND b.u = r.node
      WHERE r.root < b.w),
    lab AS (SELECT graph_id, node, min(root) AS component FROM reach GROUP BY ALL),
    sizes AS (SELECT graph_id, component, count(*) AS size FROM lab GROUP BY ALL)"""


@query(
    "connected_components",
    with_views(f"{COMP_SQL} SELECT graph_id, node, component FROM lab", "degrees", "both_ways"),
)
def _(spark, sf):
    return comp.connected_components(simple_edges(spark, sf))


@query("component_sizes", with_views(f"{COMP_SQL} SELECT * FROM sizes", "degrees", "both_ways"))
def _(spark, sf):
    return comp.component_sizes(comp.connected_components(simple_edges(spark, sf)))


@query(
    "component_count",
    with_views(
        f"""{COMP_SQL} SELECT graph_id, count(*) AS n_components, max(size) AS largest
            FROM sizes WHERE size > 1 GROUP BY ALL""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    return comp.component_count(comp.connected_components(simple_edges(spark, sf)))


@query(
    "largest_component",
    with_views(
        f"""{COMP_SQL}, top AS (SELECT graph_id, component FROM sizes WHERE size > 1
              QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY size DESC, component) = 1)
            SELECT graph_id, node FROM lab JOIN top USING (graph_id, component)""",
        "degrees",
        "both_ways",
    ),
)
def _(spark, sf):
    return comp.largest_component(comp.connected_components(simple_edges(spark, sf)))


@query(
    "subgraph_density",
    with_views(
        f"""WITH chosen AS (SELECT graph_id, node FROM degrees WHERE node % 2 = 0),
            n AS (SELECT graph_id, count(*) AS n FROM chosen GROUP BY ALL),
            m AS (SELECT graph_id, count(*) AS m FROM simple_edges WHERE src % 2 = 0 AND dst % 2 = 0 GROUP BY ALL)
            SELECT n.graph_id, n, coalesce(m, 0) AS m,
              {rd('CASE WHEN n > 1 THEN 2.0 * coalesce(m, 0) / (n * (n - 1)) ELSE 0 END')} AS density
            FROM n LEFT JOIN m USING (graph_id)""",
        "degrees",
    ),
)
def _(spark, sf):
    edges = simple_edges(spark, sf)
    even = tb.degree(edges).where("node % 2 = 0").select("graph_id", "node")
    return tb.subgraph_density(edges, even).withColumn("density", r("density"))


@query(
    "density_and_sparsity",
    with_views(
        f"""WITH n AS (SELECT graph_id, count(*) AS n, sum(degree) // 2 AS m FROM degrees GROUP BY ALL)
            SELECT graph_id, n, CAST(m AS BIGINT) AS m, {rd('2.0 * m / (n * (n - 1))')} AS density,
              {rd('2.0 * m / (n * n)')} AS sparsity FROM n""",
        "degrees",
    ),
)
def _(spark, sf):
    return tb.density_and_sparsity(simple_edges(spark, sf)).select(
        "graph_id", "n", "m", r("density").alias("density"), r("sparsity").alias("sparsity")
    )


@query(
    "modularity",
    with_views(
        f"""WITH part AS (SELECT graph_id, node, node % 4 AS c FROM degrees),
            w AS (SELECT e.graph_id, src % 4 AS cs, dst % 4 AS cd, weight FROM weighted_edges e),
            tot AS (SELECT graph_id, c, sum(weight) AS t FROM (
              SELECT graph_id, cs AS c, weight FROM w UNION ALL SELECT graph_id, cd, weight FROM w) GROUP BY ALL),
            ins AS (SELECT graph_id, cs AS c, 2 * sum(weight) AS i FROM w WHERE cs = cd GROUP BY ALL),
            m AS (SELECT graph_id, sum(t) AS m2 FROM tot GROUP BY ALL)
            SELECT graph_id, {rd('sum(coalesce(i, 0) / m2 - (t / m2) * (t / m2))', 9)} AS modularity
            FROM tot JOIN m USING (graph_id) LEFT JOIN ins USING (graph_id, c) GROUP BY graph_id""",
        "weighted_edges",
        "degrees",
    ),
)
def _(spark, sf):
    edges = weighted_edges(spark, sf)
    part = tb.degree(edges).select("graph_id", "node", F.pmod("node", F.lit(4)).alias("community"))
    return st.modularity(edges, part).withColumn("modularity", r("modularity", 9))


@query(
    "stationary_distribution",
    with_views(
        f"""WITH s AS (SELECT graph_id, node, sum(weight) AS s FROM (
              SELECT graph_id, src AS node, weight FROM weighted_edges
              UNION ALL SELECT graph_id, dst, weight FROM weighted_edges) GROUP BY ALL)
            SELECT graph_id, node, {rd('s / sum(s) OVER (PARTITION BY graph_id)')} AS probability FROM s""",
        "weighted_edges",
    ),
)
def _(spark, sf):
    return tb.stationary_distribution(weighted_edges(spark, sf)).withColumn("probability", r("probability"))


@query(
    "size_percentage",
    with_views(
        f"""WITH big AS (SELECT graph_id, count(DISTINCT node) AS n FROM (
              SELECT graph_id, src AS node FROM weighted_edges WHERE weight > 30
              UNION ALL SELECT graph_id, dst FROM weighted_edges WHERE weight > 30) GROUP BY ALL),
            base AS (SELECT graph_id, count(*) AS n_base FROM degrees GROUP BY ALL)
            SELECT graph_id, n, n_base, {rd('n / n_base * 100')} AS size_percentage FROM big JOIN base USING (graph_id)""",
        "weighted_edges",
        "degrees",
    ),
)
def _(spark, sf):
    edges = weighted_edges(spark, sf)
    part = tb.graph_size(edges.where("weight > 30"))
    return tb.size_percentage(part, tb.graph_size(edges)).withColumn("size_percentage", r("size_percentage"))


@query(
    "union_corpora",
    with_views(
        """SELECT 'weekly' AS corpus, count(*) AS m FROM simple_edges
           UNION ALL SELECT 'orders', count(*) FROM order_items""",
        "simple_edges",
        "order_items",
    ),
)
def _(spark, sf):
    both = tb.union_corpora({"weekly": simple_edges(spark, sf), "orders": order_items(spark, sf)})
    return both.groupBy("corpus").agg(F.count(F.lit(1)).alias("m"))
