"""Requirement categories: membership of courses and progress of students."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import fixed
from almanac.operators.sequence import spread


def electives_required(programme: Column) -> Column:
    return reduce(lambda rest, p: F.when(programme == p[0], p[1]).otherwise(rest), fixed.ELECTIVES_REQUIRED.items(), F.lit(fixed.ELECTIVES_DEFAULT))


def student_programmes(students: DataFrame) -> DataFrame:
    """(student, programme) of a degree and, if there is one, a dual degree."""
    both = F.array_distinct(F.array_compact(F.array("programme", "dual_programme"))) if "dual_programme" in students.columns else F.array("programme")
    return students.select("student", F.explode(both).alias("programme"))


def progress(students: DataFrame, categories: DataFrame, humanities: DataFrame, taken: DataFrame, open_done: DataFrame | None = None, required: Column | None = None, tasks: int | None = None) -> DataFrame:
    """(student, category, total, completed, remaining) for CDC, DEL, HUEL and OPEL.

    ``categories`` (programme, category, course), ``humanities`` (course),
    ``taken`` (student, course): completed and current courses. A course may
    count in several categories. Programmes without a record count nothing.
    Joins with the taken courses are dealt to ``tasks``.
    """
    required = electives_required(F.col("programme")) if required is None else required
    known = categories.select("programme").distinct()
    programmes = student_programmes(students).join(known, "programme", "left_semi")
    # Totals depend on a student's programmes alone: they are counted once for each set of programmes.
    sets = programmes.groupBy("student").agg(F.sort_array(F.collect_set("programme")).alias("set"))
    core = categories.where("category = 'CDC'").select("programme", "course").distinct()
    core_sizes = sets.select("set").distinct().select("set", F.explode("set").alias("programme")).join(core, "programme").groupBy("set").agg(F.count_distinct("course").alias("total"))
    # What is done comes from the taken courses, a few per student.
    hits = spread(programmes, tasks, "student").join(taken.distinct(), "student")
    hits = spread(hits.join(spread(categories, tasks, "programme", "course"), ["programme", "course"]), tasks, "student")
    per_programme = (
        programmes.join(hits.where("category = 'DEL'").groupBy("student", "programme").agg(F.count_distinct("course").alias("hit")), ["student", "programme"], "left")
        .withColumn("needed", required.cast("long"))
        .groupBy("student").agg(F.sum("needed").alias("total"), F.sum(F.least("needed", F.coalesce("hit", F.lit(0).cast("long")))).alias("completed"))
    )
    done = F.count_distinct("course")
    counts = [
        per_programme.select("student", F.col("total").alias("DEL_total"), F.col("completed").alias("DEL_done")),
        sets.join(core_sizes, "set").select("student", F.col("total").alias("CDC_total")),
        hits.where("category = 'CDC'").groupBy("student").agg(done.alias("CDC_done")),
        taken.distinct().join(spread(humanities.select("course"), tasks, "course").distinct(), "course", "left_semi").groupBy("student").agg(F.count("*").alias("HUEL_done")),
    ]
    if open_done is not None:
        counts.append(open_done.distinct().groupBy("student").agg(F.count("*").alias("OPEL_done")))
    # One aggregate brings a student's counts together; a join for each count and category would sort as often in one task.
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts, students.select("student", F.lit(True).alias("_here")))
    rows = spread(both, tasks, "student").groupBy("student").agg(*(F.max(c).alias(c) for c in both.columns if c != "student")).where("_here")
    constant = {"HUEL": fixed.HUMANITIES_REQUIRED, "OPEL": fixed.OPEN_REQUIRED}

    def count(name: str, otherwise: int) -> Column:
        value = F.lit(otherwise).cast("long")
        return F.coalesce(F.col(name).cast("long"), value) if name in both.columns else value

    kinds = [F.struct(F.lit(c).alias("category"), count(f"{c}_total", constant.get(c, 0)).alias("total"), count(f"{c}_done", 0).alias("completed")) for c in ("DEL", "CDC", "HUEL", "OPEL")]
    rows = rows.select("student", F.inline(F.array(*kinds)))
    return rows.select("student", "category", "total", "completed", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("completed")).alias("remaining"))


def profile_remaining(profiles: DataFrame) -> DataFrame:
    """Remaining counts from the totals and completed counts that a profile states (maps by category)."""
    kinds = F.explode(F.array(*map(F.lit, ["CDC", "DEL", "HUEL", "OPEL"]))).alias("category")

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at(name, F.col("category")), F.lit(0))

    return profiles.select("*", kinds).select("student", "category", F.greatest(F.lit(0), of("requirement_totals") - of("requirement_completed")).alias("remaining"))


def membership(pairs: DataFrame, categories: DataFrame, humanities: DataFrame, progress_rows: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Add is_cdc, is_del, is_huel, known and is_opel to (student, programme, course) pairs.

    A course is an open elective unless it is core, an elective of the
    discipline while such are still due, or in the humanities pool while such
    are still due. What depends on the student is joined first. Joins are dealt
    to ``tasks``.
    """
    marks = spread(categories, tasks, "programme", "course").groupBy("programme", "course").agg(F.max(F.col("category") == "CDC").alias("is_cdc"), F.max(F.col("category") == "DEL").alias("is_del"))
    pool = spread(humanities.select("course"), tasks, "course").distinct().withColumn("is_huel", F.lit(True))
    known = F.broadcast(categories.select("programme").distinct().withColumn("known", F.lit(True)))  # as many rows as there are programmes
    rows = pairs
    if progress_rows is not None:
        due = spread(progress_rows, tasks, "student").groupBy("student").agg(
            F.max(F.when((F.col("category") == "DEL") & (F.col("remaining") > 0), True).otherwise(False)).alias("del_due"),
            F.max(F.when((F.col("category") == "HUEL") & (F.col("remaining") > 0), True).otherwise(False)).alias("huel_due"),
        )
        rows = rows.join(due, "student", "left")
    rows = rows.join(known, "programme", "left")
    rows = rows.join(marks, ["programme", "course"], "left").join(pool, "course", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_cdc", "is_del", "is_huel", "known")})
    if progress_rows is None:
        return rows
    open_elective = ~(F.col("is_cdc") | (F.col("is_del") & F.coalesce("del_due", F.lit(False))) | (F.col("is_huel") & F.coalesce("huel_due", F.lit(False))))
    return rows.withColumn("is_opel", open_elective).drop("del_due", "huel_due")
