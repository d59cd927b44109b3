"""Process only files that have not been seen: a file stream with a checkpoint does the bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> int:
    """Run ``transform`` over the files that arrived since the last call and append the results.

    Each batch is written under its own number, so a batch repeated after a failure replaces itself.
    Returns the number of batches run.
    """
    done: list[int] = []

    def handle(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    stream = (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    )
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
