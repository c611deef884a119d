"""Column functions on text: built-ins only, so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import fixed

ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
CODE = r"\b([A-Z]{2,8})\s+([A-Z])\s*(\d{3}[A-Z]?(?:-\d+)?)\b"


def found(pattern: str, text: Column, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fields(pattern: str, groups: int, text: Column) -> Column:
    """All groups of the match of a pattern that begins at the start of a text that it matches, by one search instead of one for each group."""
    mark = "\x01"
    marked = F.split(F.regexp_replace(text, pattern, mark.join(f"${n}" for n in range(1, groups + 1)) + mark), mark)
    each = F.array(*(F.regexp_extract(text, pattern, n) for n in range(1, groups + 1)))
    return F.when(F.contains(text, F.lit(mark)), each).otherwise(marked)


def compact(text: Column) -> Column:
    """White space runs become one blank; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def code(text: Column) -> Column:
    """The first course code as "DEPT Lnnn", or null."""
    plain = F.upper(F.translate(text, "_", " "))
    first = F.regexp_extract(plain, CODE, 0)  # never empty where there is one
    return F.when(first != "", F.regexp_replace(first, r"^([A-Z]+)\s+([A-Z])\s*", "$1 $2"))


def codes_of(values: Column) -> Column:
    """Distinct codes of an array of texts, in order, without those that hold none."""
    return F.array_distinct(F.filter(F.transform(values, code), lambda c: c.isNotNull()))


def all_codes(text: Column) -> Column:
    """Distinct codes of a (case-sensitive) line in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), code))


def tokens(text: Column) -> Column:
    """Sorted distinct keywords of a text."""
    words = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9+#-]+"), F.lit(0)),
        lambda w: F.regexp_replace(w, "-related$", ""),
    )
    stop = F.array(*map(F.lit, fixed.STOP_WORDS))
    kept = F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))

    def expanded(w: Column) -> Column:
        return reduce(lambda rest, item: F.when(w == item[0], F.array(*map(F.lit, item[1]))).otherwise(rest), fixed.EXPANSIONS.items(), F.array(w))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(kept, expanded))))


def programme(degree: Column) -> Column:
    """A degree's name without its leading B.E. / M.Sc., in capitals.

    The prefix needs a separator after it, so names such as BEHAVIOURAL stay whole.
    """
    bare = F.regexp_replace(F.trim(F.upper(degree)), r"^(?:B\.\s*E\.?|BE(?=\s)|B\s+E(?=\s)|M\.\s*SC\.?|MSC\.?(?=[\s.])|M\s+SC(?=\s))\s*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital and goes on in small letters."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def clean_field(text: Column) -> Column:
    bare = F.regexp_replace(text, ZERO_WIDTH, "")
    return F.nullif(strip(F.regexp_replace(bare, r"(?U)^[\s:\-–]+|[\s:\-–]+$", "")), F.lit(""))


def number(value: Column) -> Column:
    """A double without a trailing .0, as in displayed claims."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def component_kind(name: Column) -> Column:
    """The kind of an assessment by its name."""
    def has(pattern: str) -> Column:
        return F.regexp_like(name, F.lit("(?i)" + pattern))

    report = has(r"\bmid[-. ]*(?:sem|semester|term)\b") & has(r"\b(?:report|seminar|presentation|project)\b") & ~has(r"\b(?:exam|examination|test)\b")
    kind = reduce(lambda rest, item: F.when(has(item[1]), item[0]).otherwise(rest), reversed(fixed.COMPONENT_KINDS), F.lit("other"))
    return F.when(report, F.when(has("seminar|presentation"), "presentation").otherwise("project")).otherwise(kind)


def value_fields(value: Column, header: Column) -> Column:
    """Struct of weight, marks, weight_basis and declared_total_marks for a table's value under its header lines."""
    def has(pattern: str) -> Column:
        return F.regexp_like(header, F.lit("(?i)" + pattern))

    marks_only = has(r"\bMarks\b") & ~has(r"(?:Weight(?:age|ag|s)?|Weitage|Weighatge|Weigh\b|Wt(?:g)?\.?|Percentage)\b|%")
    declared = F.coalesce(
        F.try_to_number(found(r"(?i)\bMarks\s*\((\d+)(?:\.\d+)?\)", header), F.lit("999999999")).cast("double"),
        F.try_to_number(found(r"(?i)\bTotal Marks\s*:\s*(\d+)", header), F.lit("999999999")).cast("double"),
    )
    declared = F.when(marks_only & (declared > 0), declared)
    return F.struct(
        F.when(~marks_only, value).otherwise(F.round(value * 100 / declared, 6)).alias("weight"),
        F.when(marks_only, value).alias("marks"),
        F.when(~marks_only, "weight_column").when(declared.isNotNull(), "declared_marks_total").otherwise("marks_only").alias("weight_basis"),
        declared.alias("declared_total_marks"),
    )


def meeting_slots(text: Column) -> Column:
    """Sorted distinct (day, period) slots of a meeting text such as "M W 5 Th 10".

    Days wait for a number, which closes them; a number above 12 without a zero
    is two periods; a number without waiting days is skipped.
    """
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)Th|Tu|Sa|Su|M|T|W|F|S|\d{1,2}"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in fixed.DAYS.items() for x in pair])
    nothing = F.struct(F.array().cast("array<string>").alias("days"), F.array().cast("array<struct<day:string,period:int>>").alias("slots"))

    def step(state: Column, part: Column) -> Column:
        day = F.try_element_at(names, F.lower(part))
        n = part.try_cast("int")
        two = (F.length(part) == 2) & (n > 12) & ~F.contains(part, F.lit("0"))
        periods = F.when(two, F.array(F.floor(n / 10).cast("int"), (n % 10).cast("int"))).otherwise(F.array(n))
        new = F.flatten(F.transform(state["days"], lambda d: F.transform(periods, lambda p: F.struct(d.alias("day"), p.alias("period")))))
        return F.when(day.isNotNull(), F.struct(F.array_append(state["days"], day).alias("days"), state["slots"].alias("slots"))).otherwise(
            F.struct(nothing["days"].alias("days"), F.concat(state["slots"], new).alias("slots"))
        )

    return F.sort_array(F.array_distinct(F.aggregate(parts, nothing, step)["slots"]))


def evidence(document: Column, pages: Column, section: Column, text: Column, status: Column) -> Column:
    return F.struct(
        document.alias("source_document"), pages.alias("pages"), section.alias("section"),
        compact(text).alias("supporting_text"), status.alias("verification_status"),
    )


def pages_of(document: Column, excerpt: Column) -> Column:
    """Pages (parted by form feeds) that the first occurrence of ``excerpt`` touches; empty if it does not occur."""
    plain = F.translate(document, "\f", "\n")
    at = F.instr(plain, excerpt)
    first = 1 + F.regexp_count(F.substring(document, F.lit(1), at - 1), F.lit("\f"))
    last = first + F.regexp_count(F.substring(document, at, F.length(excerpt)), F.lit("\f"))
    return F.when((at > 0) & (F.length(excerpt) > 0), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
