"""Durable staging of loop state in the shared checkpoint folder.

Iterative operators cut their lineage by writing each round as Parquet under the folder the
cluster names in ``spark.checkpoint.dir``. A written table survives the loss of executors, and
its file sizes give the optimizer true statistics for the next round's joins.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class Staged(NamedTuple):
    df: DataFrame
    path: str


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else one in the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


def stage(df: DataFrame) -> Staged:
    """Write ``df`` once and return the table read back, with its path."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def stage_counting(df: DataFrame, **metrics) -> tuple[Staged, dict]:
    """Stage ``df`` and gather aggregate ``metrics`` of its rows during the same write."""
    seen = Observation()
    cols = [expr.alias(name) for name, expr in metrics.items()]
    staged = stage(df.observe(seen, *cols))
    return staged, seen.get


def release(spark: SparkSession, *staged: Staged) -> None:
    """Drop rounds that no later plan reads, so that a long loop keeps a bounded footprint."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for item in staged:
        target = jvm.org.apache.hadoop.fs.Path(item.path)
        target.getFileSystem(conf).delete(target, True)


def with_row_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Add a dense 0-based index in ``order`` without pulling the rows into one task.

    Rows are range-partitioned and sorted, so the partition number and the position inside it
    (both held by ``monotonically_increasing_id``) give the index once the rows of the earlier
    partitions are counted. Only one count per partition is broadcast.
    """
    position = 1 << 33
    sorted_rows = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).df
    split = sorted_rows.withColumn("_part", F.floor(F.col("_mid") / position))
    counts = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition: the running total over them is all that is ordered in one task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        split.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.pmod(F.col("_mid"), F.lit(position)))
        .drop("_part", "_offset", "_mid")
    )
