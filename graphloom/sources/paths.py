"""Parameters held in directory and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_params(df: DataFrame, col: str, patterns: dict[str, str], cast: str = "double") -> DataFrame:
    """One column per pattern from the first capture group, cast; null where it does not occur."""
    found = {
        name: F.expr(f"try_cast(regexp_extract({col}, r'{pattern}', 1) AS {cast})")
        for name, pattern in patterns.items()
    }
    return df.withColumns(found)


def with_file_path(df: DataFrame, col: str = "path") -> DataFrame:
    return df.withColumn(col, F.input_file_name())


def sort_by_param(df: DataFrame, param: str) -> DataFrame:
    return df.orderBy(F.col(param).cast("double"))
