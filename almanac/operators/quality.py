"""Checks of extracted evaluation schemes: totals, best-of rules, status, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import fixed
from almanac.functions.text import compact

NUMBER = r"(?:\d+|" + "|".join(fixed.NUMBER_WORDS) + ")"
#: "best N [up to three words] of M", with some text on both sides.
BEST_OF = rf"(?i).{{0,35}}\bbest\s+(?:of\s+)?{NUMBER}\s+(?:[A-Za-z-]+\s+){{0,3}}?(?:out of|of)\s+(?:the\s+)?{NUMBER}\b.{{0,65}}"
BEST_OF_NUMBERS = rf"(?i)\bbest\s+(?:of\s+)?({NUMBER})\s+(?:[A-Za-z-]+\s+){{0,3}}?(?:out of|of)\s+(?:the\s+)?({NUMBER})\b"


def all_or_nothing(value: Column | str) -> Column:
    """Aggregate: the sum if no value is missing and there is one, else null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when((F.count("*") > 0) & (F.count("*") == F.count(value)), F.sum(value))


def near_100(total: Column, tolerance: float = 0.1) -> Column:
    return F.coalesce(F.abs(total - 100) <= tolerance, F.lit(False))


def spelled(word: Column) -> Column:
    """A number in digits or words."""
    names = reduce(lambda rest, n: F.when(F.lower(word) == n[0], n[1]).otherwise(rest), fixed.NUMBER_WORDS.items(), F.lit(None).cast("int"))
    return F.coalesce(word.try_cast("int"), names)


def component_sums(components: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: least mid-semester weight, quizzes, project weight, exam weight, and the totals."""
    kind, weight = F.col("type"), F.col("weight")
    quiz = (kind == "quiz") | F.regexp_like("name", F.lit(r"(?i)\bquiz(?:zes|es|z)?\b"))
    return components.groupBy(key).agg(
        F.count("*").alias("n_components"),
        F.min(F.when(kind == "midsem", weight)).alias("midsem_weight"),
        F.coalesce(F.sum(F.when(quiz, F.coalesce(F.nullif("count", F.lit(0)), F.lit(1)))), F.lit(0)).alias("quiz_count"),
        F.coalesce(F.sum(F.when(kind == "project", weight)), F.lit(0.0)).alias("project_weight"),
        F.coalesce(F.sum(F.when(kind.isin("midsem", "compre"), weight)), F.lit(0.0)).alias("exam_weight"),
        all_or_nothing("weight").alias("listed_weight"),
        all_or_nothing("marks").alias("listed_marks"),
    )


def best_of_rules(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule_no, best_count, offered_count, component_group, supporting_text) of "best N of M" statements about quizzes or tutorials."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(compact(F.col(text)), F.lit(BEST_OF), F.lit(0))).alias("rule_no", "supporting_text"))
    best, offered = (spelled(F.regexp_extract("supporting_text", BEST_OF_NUMBERS, g)) for g in (1, 2))
    group = F.when(F.regexp_like("supporting_text", F.lit("(?i)quiz")), "quiz").when(F.regexp_like("supporting_text", F.lit("(?i)tutorial|tut test")), "tutorial")
    rows = found.withColumns({"best_count": best, "offered_count": offered, "component_group": group})
    rows = rows.where("component_group IS NOT NULL AND best_count > 0 AND best_count < offered_count")
    first = Window.partitionBy(key, "best_count", "offered_count", "component_group").orderBy("rule_no")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def deductions(rules: DataFrame, components: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add applied and deducted to rules.

    A rule applies if its group has exactly the offered number of rows, all of
    one known weight, and no earlier rule of the document has used the group's rows.
    """
    groups = components.withColumn("component_group", F.explode(F.array_compact(F.array(
        F.when(F.regexp_like("name", F.lit("(?i)quiz")), "quiz"), F.when(F.regexp_like("name", F.lit("(?i)tutorial|tut test")), "tutorial"),
    ))))
    per_group = groups.groupBy(key, "component_group").agg(
        F.count("*").alias("n"), F.count("weight").alias("known"), F.count_distinct("weight").alias("kinds"), F.max("weight").alias("each"),
        F.max(F.regexp_like("name", F.lit("(?i)quiz")) & F.regexp_like("name", F.lit("(?i)tutorial|tut test"))).alias("in_both"),
    )
    rows = rules.join(per_group.hint("merge"), [key, "component_group"], "left")  # both grow with the documents
    fits = F.coalesce((F.col("n") == F.col("offered_count")) & (F.col("known") == F.col("n")) & (F.col("kinds") == 1), F.lit(False))
    rows = rows.withColumn("_fits", fits)
    by_group = Window.partitionBy(key, "component_group").orderBy(F.desc("_fits"), "rule_no")
    rows = rows.withColumn("_first", F.row_number().over(by_group) == 1)
    by_doc = Window.partitionBy(key).orderBy("rule_no").rowsBetween(Window.unboundedPreceding, -1)
    shares = F.coalesce(F.max(F.when(F.col("_fits") & F.col("in_both"), True)).over(by_doc), F.lit(False)) & F.coalesce("in_both", F.lit(False))
    applied = F.col("_fits") & F.col("_first") & ~shares
    deducted = F.when(applied, (F.col("offered_count") - F.col("best_count")) * F.col("each")).otherwise(0.0)
    return rows.withColumn("applied", applied).withColumn("deducted", deducted).select(*rules.columns, "applied", "deducted")


def status(length: Column, warnings: Column) -> Column:
    return F.when(length < 50, "needs_ocr").when(F.size(warnings) > 0, "partial").otherwise("extracted_unverified")


def report(records: DataFrame) -> DataFrame:
    """One row of counts over records (error, evaluation_weights_sum_to_100, evaluation_scheme_kind, title, n_components)."""
    good = F.col("error").isNull()
    return records.agg(
        F.count("*").alias("record_count"),
        F.count_if(~good).alias("file_errors"),
        F.count_if(good & F.coalesce("evaluation_weights_sum_to_100", F.lit(False))).alias("evaluation_totals_near_100"),
        F.count_if(good & (F.col("evaluation_scheme_kind") == "pass_fail")).alias("pass_fail_schemes"),
        F.count_if(good & (F.coalesce("title", F.lit("")) == "")).alias("missing_titles"),
        F.count_if(good & (F.coalesce("n_components", F.lit(0)) == 0)).alias("missing_evaluation_components"),
    )


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("extraction_status", F.lit("file_error")).alias("status")).agg(F.count("*").alias("n"))


def warning_counts(records: DataFrame) -> DataFrame:
    return records.where("error IS NULL").select(F.explode("parsing_warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def review_queue(records: DataFrame) -> DataFrame:
    return records.where("error IS NOT NULL OR size(parsing_warnings) > 0").select(
        "source_file", F.coalesce("extraction_status", F.lit("file_error")).alias("status"), "parsing_warnings", "error"
    )
