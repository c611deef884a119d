"""Ordered operators: first and last wins, segments, carried state, columns of a page.

Every one partitions by a key and orders by explicit columns, so ties have one
outcome and a task never needs another task's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to that many tasks, or as Spark deals it. A join with it by ``keys`` then has as many tasks, unless Spark broadcasts it."""
    return df if tasks is None else df.repartition(tasks, *keys)


def one_per_key(df: DataFrame, keys: Names, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_wins(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    return one_per_key(df, keys, [F.asc(c) for c in order])


def last_wins(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    return one_per_key(df, keys, [F.desc(c) for c in order])


def longest_wins(df: DataFrame, keys: Names, text: str, order: Names) -> DataFrame:
    """The row with the longest text; of equals the first."""
    return one_per_key(df, keys, [F.length(text).desc_nulls_last(), *map(F.asc, order)])


def numbered(df: DataFrame, keys: Names, order: Names, name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def segmented(df: DataFrame, keys: Names, order: Names, starts: Column, name: str = "segment") -> DataFrame:
    """Number the segments that rows with ``starts`` open; rows before the first have 0."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(upto))


def carried(df: DataFrame, keys: Names, order: Names, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def joined_text(df: DataFrame, keys: Names, order: Names, text: str, name: str = "text", between: str = " ") -> DataFrame:
    """The texts of each key, in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), between).alias(name))


def two_columns(df: DataFrame, page: Names, line: str, text: str) -> DataFrame:
    """Each line of a page as a left and a right half, split at half the widest line; col_no 1 and 2."""
    half = F.floor(F.max(F.length(text)).over(Window.partitionBy(*page)) / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(1).alias("col_no"), F.substring(F.col(text), F.lit(1), F.col("_half")).alias("part")),
        F.struct(F.lit(2).alias("col_no"), F.substring(F.col(text), F.col("_half") + 1, F.length(text)).alias("part")),
    )
    return df.withColumn("_half", half).select("*", F.inline(sides)).drop("_half")


def nearest(df: DataFrame, keys: Names, distance: Column, order: Names, within: float) -> DataFrame:
    """The row of least ``distance`` (at most ``within``) per key; of equals the first."""
    return one_per_key(df.withColumn("distance", distance).where(F.col("distance") <= within), keys, [F.asc("distance"), *map(F.asc, order)])
