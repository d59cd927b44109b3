"""Scans of run logs, rasters, feature and result files, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import Key, names
from .graphml import graph_name

RUN_LOG = "fitness array<array<double>>, solution array<array<array<double>>>"
REGION_FEATURES = (
    "label long, coord_x double, coord_y double, mean_intensity double, intensity_max double, "
    "equivalent_diameter double, lzw double"
)


def scan_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, generation, rank, d, p, beta, fitness)`` from one JSON document per run."""
    runs = (
        spark.read.option("recursiveFileLookup", True).schema(RUN_LOG).json(path)
        .withColumn("run_id", graph_name(F.input_file_name()))
    )
    generations = runs.select(
        "run_id", F.posexplode(F.arrays_zip("fitness", "solution")).alias("generation", "g")
    )
    ranks = generations.select(
        "run_id",
        "generation",
        F.posexplode(F.arrays_zip(F.col("g.fitness").alias("f"), F.col("g.solution").alias("s"))).alias("rank", "r"),
    )
    return ranks.select(
        "run_id",
        "generation",
        "rank",
        F.col("r.s")[0].alias("d"),
        F.col("r.s")[1].alias("p"),
        F.col("r.s")[2].alias("beta"),
        F.col("r.f").alias("fitness"),
    )


def scan_raster(spark: SparkSession, path: str) -> DataFrame:
    """Gray pixels ``(image_id, x, y, v)`` of image files; colours are weighted by luminance.

    The pixels of an image are written out row by row, after the rows have been spread over tasks.
    """
    # fixed values: luminance weights of red, green and blue
    red, green, blue = 0.2125, 0.7154, 0.0721
    images = spark.read.format("image").load(path).select(
        graph_name(F.col("image.origin")).alias("image_id"),
        F.col("image.width").alias("w"),
        F.col("image.height").alias("h"),
        F.col("image.nChannels").alias("c"),
        F.col("image.data").alias("data"),
    )
    lines = images.select(
        "image_id", "w", "c", "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")
    ).select(
        "image_id", "w", "c", "y", F.expr("substring(data, y * w * c + 1, w * c)").alias("line")
    ).repartition("image_id", "y")
    pixels = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))

    def channel(i: int):
        return F.conv(F.hex(F.expr(f"substring(line, x * c + {i + 1}, 1)")), 16, 10).cast("double")

    # the image source stores colours as blue, green, red, with opacity last
    gray = F.when(F.col("c") == 1, channel(0)).otherwise(
        F.floor(blue * channel(0) + green * channel(1) + red * channel(2))
    )
    return pixels.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), gray.alias("v"))


def scan_region_features(spark: SparkSession, path: str) -> DataFrame:
    """Region table from CSV with a header; a leading index column is ignored."""
    wanted = [part.split()[0] for part in REGION_FEATURES.split(", ")]
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    types = dict(part.split() for part in REGION_FEATURES.split(", "))
    return raw.select(
        graph_name(F.input_file_name()).alias("image_id"),
        *[F.col(c).try_cast(types[c]).alias(c) for c in wanted if c in raw.columns],
    )


def scan_results(spark: SparkSession, path: str, pattern: str = "*.json", schema: str | None = None) -> DataFrame:
    """All result documents below ``path`` whose name matches."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return (reader.schema(schema) if schema else reader).json(path)


def incremental_scan(df: DataFrame, done: DataFrame, key: Key) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(*names(key)), names(key), "left_anti")


def write_corpus(nodes: DataFrame, edges: DataFrame, path: str, by: str = "corpus", mode: str = "errorifexists") -> None:
    nodes.write.mode(mode).partitionBy(by).parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy(by).parquet(f"{path}/edges")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def write_selected_params(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON folder per mixture peak."""
    summary.repartition("peak").write.mode(mode).partitionBy("peak").json(path)
