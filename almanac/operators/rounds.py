"""The first courses of long lists that pass costly checks, in rounds over growing parts of the lists."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; only in a local session without one is a folder made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="almanac-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as shuffles have, for rows that are costly to work on and small when packed; fewer are not made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_survivors(students: DataFrame, lists: DataFrame, keys: Sequence[str], survive: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(student, course, place) of each student's first ``k`` courses that ``survive`` keeps.

    ``students`` (student, keys) share the ``lists`` (keys, place from 1,
    course). Each round looks at the next courses, four times as many as before, for
    the students who still lack some; so a student meets about as many courses
    as it takes to find ``k``, not the whole list.
    """
    longest = lists.agg(F.max("place")).first()[0] or 0
    found, waiting, seen, size = None, students, 0, 4 * k
    while True:
        part = lists.where((F.col("place") > seen) & (F.col("place") <= seen + size))
        kept = settled(survive(waiting.join(part, list(keys)).select("student", "course", "place")))
        found = kept if found is None else found.unionByName(kept)
        seen, size = seen + size, size * 4
        if seen >= longest:
            break
        served = found.groupBy("student").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        waiting = settled(waiting.join(served, "student", "left_anti"))
        if waiting.isEmpty():
            break
    order = Window.partitionBy("student").orderBy("place")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
