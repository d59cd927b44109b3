"""Helpers for key columns. Every operator takes its grouping key as a name or a list of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

Key = str | list[str] | tuple[str, ...] | None


def names(key: Key) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def join_stats(df: DataFrame, stats: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of aggregates, which is staged first.

    Adaptive execution splits a hot key only where both sides come straight from a shuffle, which an
    aggregate does not; a written table does, and its true size decides whether it is broadcast.
    """
    return df.join(stage(stats).df, on, how)


def attach_stats(df: DataFrame, key: Key, aggs: list[Column]) -> DataFrame:
    """Join per-group aggregates back onto the rows.

    Unlike a window over the group, the aggregate combines map-side and the join can split a hot
    group, so no task ever holds a whole group. Without a key the single stats row is broadcast.
    """
    by = names(key)
    if by:
        return join_stats(df, df.groupBy(*by).agg(*aggs), by)
    one = F.lit(1).alias("_one")
    return (
        df.select("*", one)
        .join(F.broadcast(df.agg(*aggs).select("*", one)), "_one")
        .drop("_one")
    )


def spread_by(df: DataFrame, key: Key, *order: str, times: int = 1) -> DataFrame:
    """Hash rows to all shuffle partitions by key, or to ``times`` as many, and sort them inside.

    The number is explicit so that adaptive execution does not merge small partitions: the work that
    follows is heavy per row, which the size of the rows does not show. With more of them than cores, tasks that got
    few groups make up for those that got many.
    """
    by = names(key)
    parts = times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by).sortWithinPartitions(*by, *order)


#: How many times the shuffle partitions rows are dealt to before an aggregate with about as many groups as rows.
FINE = 4


def spread_fine(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows to ``FINE`` times the shuffle partitions, for an aggregate by ``cols`` that hardly combines them.

    A task then builds its tables of groups, and those of a coarser aggregate that follows in the same stage, for a
    fraction of the rows. Adaptive execution may merge partitions, but never makes more of them.
    """
    return df.repartition(FINE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
