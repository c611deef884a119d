"""Academic documents as tables: clauses, catalogue, programme categories, timetable, rules, equivalences.

Input everywhere: lines (source_document, page_no, line_no, line). State that
goes on from line to line is a window over the document's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import fixed
from almanac.functions.text import CODE, all_codes, bound, code, compact, fields, found, strip
from almanac.operators.sequence import carried, first_wins, joined_text, longest_wins, segmented, two_columns

DOC, PLACE = ["source_document"], ["page_no", "line_no"]
SPLIT_PLACE = ["page_no", "col_no", "line_no"]
CLAUSE = r"\b(\d+\.\d+(?:\s+[IVX]+|[a-z])?)\s*$"
STATUS = "extracted_unverified"


def cited(section: str | Column, text: Column) -> Column:
    section = F.lit(section) if isinstance(section, str) else section
    return F.struct(
        F.col("source_document"), F.array("page_no").alias("pages"), section.alias("section"), compact(text).alias("supporting_text"), F.lit(STATUS).alias("verification_status"),
    )


def clauses(lines: DataFrame) -> DataFrame:
    """(source_document, ordinal, clause_id, pages, text): a clause id at the right end of a line opens a clause, up to the next."""
    line = F.regexp_replace("line", r"(?U)\s+$", "")
    opened = found(CLAUSE, line)
    rows = segmented(lines.withColumn("_id", opened), DOC, PLACE, F.col("_id").isNotNull(), "ordinal").where("ordinal > 0")
    said = strip(F.when(F.col("_id").isNotNull(), F.regexp_replace(line, CLAUSE, "")).otherwise(line))
    keep = (said != "") & (F.col("_id").isNotNull() | ~F.regexp_like(said, F.lit(r"^\d+$")))
    rows = rows.withColumn("_said", F.when(keep, said))
    text = joined_text(rows, [*DOC, "ordinal"], PLACE, "_said")
    heads = rows.groupBy(*DOC, "ordinal").agg(compact(F.max("_id")).alias("clause_id"), F.sort_array(F.collect_set("page_no")).alias("pages"))
    return heads.join(text, [*DOC, "ordinal"]).select(*DOC, "ordinal", "clause_id", "pages", compact(F.col("text")).alias("text"), F.lit(STATUS).alias("verification_status"))


# How lines of a catalogue look.
TAIL = r"^\s*([A-Za-z][A-Za-z0-9&()/',.\- ]+?)\s{2,}(\d{1,2})(?:\*|\s|$)"
PREREQUISITE = r"(?i)Pre[- ]?requisites?\s*:\s*(.+)"


def entries_of(line: Column) -> Column:
    """(seg_no, course, title, units, segment) of each code of a line that has a title and units to its right, as they stand there."""
    head = "^" + CODE

    def entry(segment: Column, n: Column) -> Column:
        parted = fields(TAIL, 2, F.regexp_replace(segment, head, ""))
        course = code(F.regexp_extract(segment, head, 0))
        return F.when(F.regexp_like(segment, F.lit(head)), bound(parted, lambda p: F.struct(n.alias("seg_no"), course.alias("course"), F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).alias("units"), segment.alias("segment"))))

    return F.filter(F.transform(F.split(line, rf"(?={CODE})"), entry), lambda e: e["units"] != "")


def catalogue(lines: DataFrame) -> DataFrame:
    """(course, title, units, prerequisite_expression, needs, sources).

    First pass: each code with a title and units to its right; the first units
    and the longest title count. A prerequisite line goes to the codes of the
    last line that has any. Second pass: course descriptions in two columns,
    whose prerequisites take precedence. Each pass goes through the lines once,
    and one aggregate brings together what all lines say of a course.
    """
    has_codes = F.regexp_like("line", F.lit(CODE))
    # Only lines with codes and prerequisite lines are put in order.
    rows = lines.where(has_codes | F.regexp_like("line", F.lit(PREREQUISITE))).withColumn("_entries", F.when(has_codes, entries_of(F.col("line"))))
    # A line with codes replaces the waiting codes, by none if none of them parsed.
    rows = carried(rows, DOC, PLACE, F.transform("_entries", lambda e: e["course"]), "_codes").withColumn("_said", compact(found(PREREQUISITE, F.col("line"))))
    kind = "array<struct<seg_no:int,course:string,title:string,units:string,segment:string>>"
    none = F.array().cast(kind)
    asked = F.transform("_codes", lambda c: F.struct(F.lit(0).alias("seg_no"), c.alias("course"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("units"), F.col("line").alias("segment")))
    said = F.concat(F.coalesce(F.col("_entries").cast(kind), none), F.when(F.col("_said").isNotNull() & F.col("_codes").isNotNull(), asked).otherwise(none))
    first = rows.select(*DOC, *PLACE, "_said", F.inline(said)).where("course IS NOT NULL").withColumn("pass", F.when(F.col("units").isNull(), 1).otherwise(0))
    first = first.select(
        "course", "pass", F.struct(*DOC, *PLACE, "seg_no").alias("_at"), F.regexp_replace(compact(F.col("title")), r"^[-– ]+|[-– ]+$", "").alias("title"), F.col("units").cast("int").alias("units"),
        F.when(F.col("pass") == 1, F.col("_said")).alias("said"), cited(F.when(F.col("pass") == 1, "prerequisite").otherwise("course catalogue/programme table"), F.col("segment")).alias("source"),
    )
    second = described_prerequisites(lines).select("course", F.lit(2).alias("pass"), "_at", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("units"), "said", "source")
    facts = first.unionByName(second).groupBy("course").agg(F.array_sort(F.collect_list(F.struct("pass", "_at", "title", "units", "said", "source"))).alias("_facts"))
    opening, closing = F.get("_facts", F.lit(0)), F.element_at("_facts", -1)
    longest = F.array_max(F.transform("_facts", lambda f, n: F.struct(F.length(f["title"]).alias("length"), (-n).alias("n"), f["title"].alias("title"))))
    empty = F.array().cast("array<string>")
    found_all = facts.where(opening["pass"] == 0).select("course", longest["title"].alias("title"), opening["units"].alias("units"), closing["said"].alias("prerequisite_expression"), F.transform("_facts", lambda f: f["source"]).alias("sources"))
    return found_all.select("course", "title", "units", "prerequisite_expression", F.coalesce(all_codes(F.col("prerequisite_expression")), empty).alias("needs"), empty.alias("restrictions"), "sources")


def described_prerequisites(lines: DataFrame) -> DataFrame:
    """(course, said, source, _at) from the two columns of description pages; a statement ends with its course, page or column."""
    page = [*DOC, "page_no"]
    on = F.contains("line", F.lit("Course Description")) | F.regexp_like("line", F.lit(r"(?i)Pre[- ]?requisites?\s*:"))
    concerned = lines.withColumn("_on", F.bool_or(on).over(Window.partitionBy(*page))).where("_on").drop("_on")
    column = [*page, "col_no"]
    parts = two_columns(concerned, page, "line_no", "line").select(*column, "line_no", strip(F.col("part")).alias("_bare")).where("_bare <> ''")
    head = F.nullif(F.regexp_extract("_bare", "^" + CODE, 0), F.lit(""))
    rows = segmented(parts.withColumn("_head", head), column, ["line_no"], F.col("_head").isNotNull(), "_course").where("_course > 0")
    rows = rows.withColumn("_asks", F.when(F.col("_head").isNull(), found(PREREQUISITE, F.col("_bare"))))
    # A second marker in a course starts its statement anew.
    of_course = Window.partitionBy(*column, "_course")
    rows = rows.withColumns({"_latest": F.max(F.when(F.col("_asks").isNotNull(), F.col("line_no"))).over(of_course), "course": F.max("_head").over(of_course)}).where("line_no >= _latest")
    rows = rows.withColumn("_said", F.coalesce("_asks", "_bare"))
    said = joined_text(rows, [*column, "_course", "course"], ["line_no"], "_said", "said").withColumn("said", compact(F.col("said"))).withColumn("course", code(F.col("course")))
    return said.withColumn("_at", F.struct(*DOC, "page_no", F.col("col_no").alias("line_no"), F.col("_course").cast("int").alias("seg_no"))).withColumn("source", cited("course description prerequisite", F.col("said")))


CAPITALS = r"^[A-Z][A-Z &().,/\-]+$"
POOL = "Pool of Humanities courses for first degree"


def programme_categories(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((programme, category, course, source), (course, source) of the humanities pool).

    From the last page that has both list markers on: "CORE COURSES" opens a
    core list of the programme named by the capital lines before it (at most
    four since the last marker), "DISCIPLINE ELECTIVE COURSES" an elective list
    of the same programme, "Project Type Courses" ends the list.
    """
    page = [*DOC, "page_no"]
    marks = lines.groupBy(*page).agg(
        (F.bool_or(F.contains("line", F.lit("List of Courses for B.E. / M.Sc. / B.Pharm."))) & F.bool_or(F.contains("line", F.lit("CORE COURSES")))).alias("_start")
    )
    first = marks.where("_start").groupBy(*DOC).agg(F.max("page_no").alias("_first"))
    parts = two_columns(lines.join(first, DOC).where("page_no >= _first"), page, "line_no", "line")
    text = F.regexp_replace(compact(F.col("part")), r"^\*+|\*+$", "")
    rows = parts.withColumn("_text", text).where("_text <> ''")
    marker = (
        F.when(F.contains("_text", F.lit(POOL)), "pool").when(F.col("_text") == "Other Courses", "other").when(F.startswith("_text", F.lit("CORE COURSES")), "CDC")
        .when(F.startswith("_text", F.lit("DISCIPLINE ELECTIVE COURSES")), "DEL").when(F.startswith("_text", F.lit("Project Type Courses")), "none")
    )
    rows = rows.withColumn("_marker", marker)
    upto = Window.partitionBy(*DOC).orderBy(*SPLIT_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    # The pool opens once and closes at the first "Other Courses" after that.
    rows = rows.withColumn("_opened", F.sum(F.when(F.col("_marker") == "pool", 1).otherwise(0)).over(upto) > 0)
    rows = rows.withColumn("_closed", F.sum(F.when(F.col("_opened") & (F.col("_marker") == "other"), 1).otherwise(0)).over(upto) > 0)
    in_pool = F.col("_opened") & ~F.col("_closed")
    course = code(found(rf"({CODE})", F.col("_text")))
    pool = rows.where(in_pool & course.isNotNull()).select(course.alias("course"), *DOC, *SPLIT_PLACE, cited(f"{POOL} programmes", F.col("part")).alias("source"))
    pool = first_wins(pool, ["course"], [*DOC, *SPLIT_PLACE]).select("course", "source")
    listed = rows.where(~in_pool)
    heading = F.regexp_like("_text", F.lit(CAPITALS)) & F.col("_marker").isNull() & ~F.regexp_like("_text", F.lit(CODE))
    clears = F.col("_marker").isin("CDC", "DEL")
    listed = segmented(listed, DOC, SPLIT_PLACE, clears, "_list")
    # Only the last four headings of a list can name the programme of the next one.
    back = F.row_number().over(Window.partitionBy(*DOC, "_list").orderBy(*(F.desc(c) for c in SPLIT_PLACE)))
    last = listed.where(heading).withColumn("_back", back).where(F.col("_back") <= 4)
    names = last.groupBy(*DOC, (F.col("_list") + 1).alias("_list")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("_text").alias("text")))), lambda x: x["text"]), " ").alias("_before"))
    listed = listed.join(names, [*DOC, "_list"], "left")
    named = F.when(F.col("_marker") == "CDC", compact(F.col("_before")))
    listed = carried(listed, DOC, SPLIT_PLACE, named, "programme")
    category = F.when(F.col("_marker").isin("CDC", "DEL"), F.col("_marker")).when(F.col("_marker").isin("none", "other", "pool"), "none")
    listed = carried(listed, DOC, SPLIT_PLACE, category, "category")
    entries = listed.where(F.col("programme").isNotNull() & F.col("category").isin("CDC", "DEL") & F.col("_marker").isNull() & ~heading & course.isNotNull())
    entries = entries.select("programme", "category", course.alias("course"), *DOC, *SPLIT_PLACE, cited(F.concat_ws(" ", "programme", "category"), F.col("part")).alias("source"))
    return first_wins(entries, ["programme", "category", "course"], [*DOC, *SPLIT_PLACE]).select("programme", "category", "course", "source"), pool


# How lines of a timetable look.
PRIMARY = r"^\s*(\d+)\s+([A-Z]{2,8}\s+[A-Z]\s*\d{3}[A-Z]?(?:-\d+)?)\s+(.*?)\s{2,}(\d+|-)\s+(\d+|-)\s+(\d+|-)\s+(\d+|-)\s+(\d+|-)\s+([LPT]\d+)\s*(.*)$"
EXAM = r"(\d{2}/\d{2})\s+(FN1|FN2|AN1|AN2|FN|AN)\b"
MEETING = r"\b((?:M|T|W|Th|F|S)(?:\s*(?:M|T|W|Th|F|S))*\s+\d{1,2}(?:\s+\d{1,2})*)\b"
CONTINUED = r"^.{70,}?([LPT]\d+)\s+(.+)$"
CANCELLED = r"(?i)CANC?ELLED|CANCLED"


ROOM = r"\b([1-7]\d{3})\b"


def timetable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offerings, sections): primary rows, and further sections in lines that continue the last primary row.

    A primary row is parted once, and every line is gone through once for its sections.
    """
    is_primary = F.regexp_like("line", F.lit(PRIMARY))

    def part(n: int) -> Column:
        return F.get("_p", F.lit(n - 1))

    def hours(n: int) -> Column:
        return F.coalesce(part(n).try_cast("int"), F.lit(0))

    def placed(rows: DataFrame, tail: Column) -> DataFrame:
        """Add what the end of a row says of its room and its meetings; neither is ever empty."""
        return rows.withColumns({"_room": F.regexp_extract(tail, ROOM, 1), "_meeting": F.regexp_extract(tail, MEETING, 1)})

    room, meeting = (F.when(F.col(c) != "", F.col(c)) for c in ("_room", "_meeting"))
    rest, number = part(10), part(1).cast("int")
    # The date of an exam has five letters; its session follows after blanks.
    exams = F.transform(F.regexp_extract_all(rest, F.lit(EXAM), F.lit(0)), lambda e: F.struct(F.substring(e, 1, 5).alias("date"), F.translate(F.substring(e, 6, 1 << 30), " \t\n\x0b\f\r", "").alias("session")))
    primary = placed(lines.where(is_primary).withColumn("_p", fields(PRIMARY, 10, F.col("line"))), rest).withColumn("_exams", exams)
    offerings = primary.select(
        *DOC, *PLACE, number.alias("computer_code"), code(part(2)).alias("course"), compact(part(3)).alias("title"),
        F.struct(*(hours(4 + i).alias(n) for i, n in enumerate("lptsu"))).alias("credits"), part(9).alias("section"), room.alias("room"), meeting.alias("meeting_text"),
        F.regexp_like(rest, F.lit(CANCELLED)).alias("cancelled"), (number >= fixed.RESTRICTED_FROM).alias("restricted"), F.get("_exams", F.lit(0)).alias("midsem"), F.get("_exams", F.lit(1)).alias("compre"),
        compact(rest).alias("raw_tail"), cited("II. Coursewise Timetable", F.col("line")).alias("source"),
    )
    # Only primary rows and lines that can go on from one are put in order.
    rows = lines.where(is_primary | F.regexp_like("line", F.lit(CONTINUED))).withColumn("_p", F.when(is_primary, fields(PRIMARY, 10, F.col("line"))))
    own = F.col("_p").isNotNull()
    rows = carried(rows, DOC, PLACE, F.when(own, F.struct(code(part(2)).alias("course"), number.alias("computer_code"))), "_of").where("_of IS NOT NULL")
    rows = rows.withColumn("_tail", F.when(own, rest).otherwise(compact(F.regexp_extract("line", CONTINUED, 2))))
    name = F.when(own, "II. Coursewise Timetable").otherwise("II. Coursewise Timetable section")
    sections = placed(rows, F.col("_tail")).select(
        *DOC, *PLACE, "_of.course", "_of.computer_code", F.when(own, part(9)).otherwise(F.regexp_extract("line", CONTINUED, 1)).alias("section"), room.alias("room"), meeting.alias("meeting_text"),
        F.regexp_like("_tail", F.lit(CANCELLED)).alias("cancelled"), compact(F.col("_tail")).alias("raw_text"), cited(name, F.col("line")).alias("source"),
    )
    return offerings, sections


def timetable_header(lines: DataFrame) -> DataFrame:
    times = F.create_map(*[F.lit(x) for pair in fixed.SESSION_TIMES.items() for x in pair])
    return lines.select(*DOC).distinct().select(F.lit(fixed.TERM).alias("term"), F.lit(fixed.CAMPUS).alias("campus"), times.alias("session_times"), *DOC)


def registration_rules(lines: DataFrame) -> DataFrame:
    """Numbered items between the heading in capitals and "VIII."; the last item is kept even if that mark is missing."""
    upto = Window.partitionBy(*DOC).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    bare = strip(F.col("line"))
    heading = F.contains("line", F.lit("INSTRUCTIONS REGARDING REGISTRATION")) & (bare == F.upper(bare))
    rows = lines.withColumn("_heading", heading).withColumn("_in", F.sum(F.when(heading, 1).otherwise(0)).over(upto) > 0)
    rows = rows.withColumn("_ended", F.sum(F.when(F.col("_in") & F.regexp_like("line", F.lit(r"^\s*VIII\.")), 1).otherwise(0)).over(upto) > 0)
    rows = rows.where("_in AND NOT _ended AND NOT _heading")
    item = r"^\s*(\d+)\.\s+(.+)"
    rows = segmented(rows.withColumn("_no", found(item, F.col("line"))), DOC, PLACE, F.col("_no").isNotNull(), "_item").where("_item > 0")
    rows = rows.withColumn("_said", F.when(F.col("_no").isNotNull(), found(item, F.col("line"), 2)).otherwise(F.nullif(strip(F.col("line")), F.lit(""))))
    heads = rows.where("_no IS NOT NULL").select(*DOC, "_item", "_no", "page_no")
    text = joined_text(rows, [*DOC, "_item"], PLACE, "_said")
    return heads.join(text, [*DOC, "_item"]).select(
        F.concat(F.lit("timetable_registration_"), "_no").alias("rule_id"), F.lit("registration_instruction").alias("kind"), F.lit("manual_review").alias("automation"), compact(F.col("text")).alias("text"),
        F.struct(*DOC, F.array("page_no").alias("pages"), F.lit("VII. Instructions Regarding Registration").alias("section")).alias("source"),
    )


def equivalence_groups(lines: DataFrame) -> DataFrame:
    """(canonical_course, equivalent_courses, source): lines with two codes or more on the pages of section IX, up to the page of section X."""
    page = [*DOC, "page_no"]
    def on(pattern: str) -> Column:
        return F.bool_or(F.regexp_like("line", F.lit(pattern)))

    marks = lines.groupBy(*page).agg((on(r"\bIX\.") & on("LIST OF EQUIVALENT COURSES")).alias("_start"), (on(r"(?<!I)\bX\.") & on("Library")).alias("_stop"))
    upto = Window.partitionBy(*DOC).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    active = marks.withColumn("_on", F.max("_start").over(upto)).withColumn("_off", F.max(F.col("_stop") & F.col("_on")).over(upto)).where("_on AND NOT _off").select(*page)
    rows = lines.join(active, page).withColumn("codes", all_codes(F.col("line"))).where("size(codes) >= 2")
    return rows.select(F.get("codes", F.lit(0)).alias("canonical_course"), F.col("codes").alias("equivalent_courses"), cited("IX. List of Equivalent Courses", F.col("line")).alias("source"))


def titles_overridden(courses: DataFrame, offerings: DataFrame) -> DataFrame:
    """The longest title of a course's offerings takes the place of its own."""
    best = longest_wins(offerings, ["course"], "title", [*DOC, *PLACE]).select("course", F.col("title").alias("_title"))
    return courses.join(best, "course", "left").withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), "title")).drop("_title")


def build(bulletin: DataFrame, regulations: DataFrame, timetable_lines: DataFrame) -> dict[str, DataFrame]:
    """All tables of the academic build, from the lines of its three documents; the key ``report`` counts them."""
    from almanac.operators.policy import registry, typed_rules

    offerings, sections = timetable(timetable_lines)
    found_clauses = clauses(regulations)
    rules = typed_rules(found_clauses)
    categories, pool = programme_categories(bulletin)
    tables = {
        "catalogue": titles_overridden(catalogue(bulletin), offerings), "programme_categories": categories, "humanities": pool, "regulation_clauses": found_clauses, "machine_rules": rules,
        "rule_registry": registry(found_clauses, rules), "registration_rules": registration_rules(timetable_lines), "equivalent_course_groups": equivalence_groups(timetable_lines),
        "offerings": offerings, "sections": sections, "timetable_header": timetable_header(timetable_lines),
    }
    counts = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in tables.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return tables | {"report": report}
