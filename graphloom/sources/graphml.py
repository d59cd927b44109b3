"""GraphML and annotation files as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATA = T.ArrayType(
    T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])
)
# one fixed schema: a single <data> child would otherwise be read as a struct, several as an array
GRAPHML = T.StructType(
    [
        T.StructField(
            "key",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_id", T.StringType()),
                        T.StructField("_for", T.StringType()),
                        T.StructField("_attr.name", T.StringType()),
                        T.StructField("_attr.type", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "graph",
            T.StructType(
                [
                    T.StructField(
                        "node",
                        T.ArrayType(T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", _DATA)])),
                    ),
                    T.StructField(
                        "edge",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("_source", T.StringType()),
                                    T.StructField("_target", T.StringType()),
                                    T.StructField("data", _DATA),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

NODE_ATTRS = {"x": "long", "y": "long"}
EDGE_ATTRS = {"pixels": "long", "length": "double", "width": "double", "width_var": "double", "weight": "double"}


def _attr(name: str, kind: str, of: str, data: str) -> Column:
    """First value of the attribute: its key ids differ between files and may occur twice in one.

    Where two keys share the name, the one declared as a floating-point number wins.
    """
    def ids(want_real: bool):
        return F.transform(
            F.filter(
                "key",
                lambda k: (k["_for"] == of)
                & (k["_attr.name"] == name)
                & (k["_attr.type"].isin("double", "float") == F.lit(want_real)),
            ),
            lambda k: k["_id"],
        )

    def value(keys):
        return F.get(
            F.transform(F.filter(data, lambda d: F.array_contains(keys, d["_key"])), lambda d: d["_VALUE"]), 0
        )

    return F.coalesce(value(ids(True)), value(ids(False))).try_cast(kind).alias(name)


def graph_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[A-Za-z0-9]+$", 1)


def corpus_name(path: Column) -> Column:
    """Folder of the file; a last folder called ``graphml`` gives way to the one above it."""
    return F.regexp_extract(path, r"([^/]+)/(?:graphml/)?[^/]+$", 1)


KEYS = ("corpus", "graph_id")


def _keyed(files: DataFrame) -> DataFrame:
    path = F.input_file_name()
    return files.withColumns({"corpus": corpus_name(path), "graph_id": graph_name(path)})


def scan_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(corpus, graph_id, node_id, x, y)`` and edges ``(corpus, graph_id, src, dst, attributes)``.

    ``graph_id`` is the file name and ``corpus`` its folder; edge ends are put in text order, and
    self-loops are kept.
    """
    files = _keyed(spark.read.format("xml").option("rowTag", "graphml").schema(GRAPHML).load(path))
    nodes = files.select(*KEYS, "key", F.explode("graph.node").alias("n")).select(
        *KEYS, F.col("n._id").alias("node_id"), *[_attr(a, t, "node", "n.data") for a, t in NODE_ATTRS.items()]
    )
    ends = (F.col("e._source"), F.col("e._target"))
    edges = files.select(*KEYS, "key", F.explode("graph.edge").alias("e")).select(
        *KEYS,
        F.least(*ends).alias("src"),
        F.greatest(*ends).alias("dst"),
        *[_attr(a, t, "edge", "e.data") for a, t in EDGE_ATTRS.items()],
    )
    return nodes, edges


POINT = "array<long>"
ANNOTATION = f"nodes array<{POINT}>, edges array<array<{POINT}>>"


def point_id(point: Column) -> Column:
    return F.concat(F.lit("("), point[0].cast("string"), F.lit(", "), point[1].cast("string"), F.lit(")"))


def scan_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of annotation files; both are sets, and edges have no direction."""
    files = _keyed(spark.read.option("multiLine", multi_line).schema(ANNOTATION).json(path))
    nodes = files.select(*KEYS, F.explode("nodes").alias("p")).select(
        *KEYS, point_id(F.col("p")).alias("node_id"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y")
    )
    pair = files.select(*KEYS, F.explode("edges").alias("e")).select(
        *KEYS, F.array_sort(F.array(F.col("e")[0], F.col("e")[1])).alias("e")
    )
    edges = pair.select(*KEYS, point_id(F.col("e")[0]).alias("src"), point_id(F.col("e")[1]).alias("dst"))
    return nodes.distinct(), edges.distinct()
