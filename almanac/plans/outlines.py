"""Extraction queries: outlines written from the tables are read back, and must give the tables' facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import headings
from almanac.operators import evaltable, handouts
from almanac.plans.academic import read
from almanac.sources import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ATTENDANCE = ["Attendance is mandatory. A minimum of 75 % is needed.", "Attendance is not compulsory.", "Attendance is not compulsory. Laboratory attendance is a must."]
MAKEUP = "No make-up for quizzes. Make-ups are granted only for medical reasons with a certificate."
TERMS = ["First Semester 2026-27", "Second Semester 2025-26", "Summer Semester 2025-26"]
TOPICS = ["robotics", "linear algebra", "genetics", "fluid mechanics"]
HEADERS = ["Weightage", "Marks (200)", "Weightage (%)"]

#: Weights of the three rows, which total 100 but for every fifth outline; the second header states marks of 200.
FACTS_SQL = f"""
WITH facts AS (
  SELECT p_partkey AS doc_id, p_name, 10 + p_partkey % 30 AS a, 20 + p_partkey % 7 AS b, 70 - p_partkey % 30 - p_partkey % 7 + CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 0 END AS c,
    CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END AS unit, p_partkey % 3 = 1 AS in_marks FROM part)"""


def pick(values: list[str], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, text): an outline for every part, with weights, policies and term by rules on its key."""
    k = F.col("p_partkey")
    unit = F.when(k % 3 == 1, 2).otherwise(1)
    a, b = (10 + k % 30), (20 + k % 7)
    c = 70 - k % 30 - k % 7 + F.when(k % 5 == 0, 5).otherwise(0)

    def row(name: str, duration: str, value: Column, rest: str) -> Column:
        return F.concat(F.rpad(F.lit(name), 26, " "), F.rpad(F.lit(duration), 14, " "), F.rpad((value * unit).cast("string"), 16, " "), F.lit(rest))

    text = F.concat_ws(
        "\n", F.concat(F.lit("Course No. : CS F"), F.lpad((k % 1000).cast("string"), 3, "0")), F.concat(F.lit("Course Title : "), F.col("p_name")), F.lit("Instructor-in-charge : Prof. A Person (a@b.example)"),
        F.concat(F.lit("1. Course Description: An introduction to "), pick(TOPICS, k), F.lit(".")), F.concat(F.lit("2. Scope and Objective: Covers "), pick(TOPICS, k + 1), F.lit(" in depth.")), F.lit("3. Evaluation Scheme:"),
        F.concat(F.rpad(F.lit("Component"), 26, " "), F.rpad(F.lit("Duration"), 12, " "), F.rpad(pick(HEADERS, k), 18, " "), F.lit("Remarks")),
        row("Mid-Semester Test", "90 min", a, "Closed Book"), row("Surprise Quizzes (2)", "-", b, "Open Book"), row("Comprehensive Exam", "3 h", c, "Closed Book"),
        F.concat(F.lit("\f4. Attendance Policy: "), pick(ATTENDANCE, k)), F.lit(f"5. Make-up Policy: {MAKEUP}"), pick(TERMS, k), F.lit(""),
    )
    return read(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat(k.cast("string"), F.lit("_outline.pdf")).alias("file_name"), text.alias("text"))


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(FACTS_SQL + f"""
SELECT doc_id, 'CS F' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS course_code, p_name AS title, 'Prof. A Person' AS instructor,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS attendance_required, CASE WHEN doc_id % 3 = 0 THEN 75.0::DOUBLE END AS minimum_attendance_percent, true AS has_midsem, true AS has_compre,
  ['2026-27', '2025-26', '2025-26'][doc_id % 3 + 1] AS academic_year, ['1', '2', 'summer'][doc_id % 3 + 1] AS semester, CAST(a + b + c AS DOUBLE) AS total_evaluation_weight, abs(a + b + c - 100) <= 0.1 AS evaluation_weights_sum_to_100,
  CASE WHEN in_marks THEN CAST(200.0 * (a + b + c) / 100 AS DOUBLE) END AS total_extracted_marks, 3::BIGINT AS n_components, CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'extracted_unverified' END AS extraction_status,
  array_to_string(list_sort([{listed(TOPICS)}[doc_id % 4 + 1], {listed(TOPICS)}[(doc_id + 1) % 4 + 1]]), ', ') AS topics,
  CASE WHEN doc_id % 5 = 0 THEN 'Evaluation weights total 105.0, expected 100; verify source and selection rules.' ELSE '' END AS warnings, '2' AS attendance_pages
FROM facts""")
def outline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all outlines: metadata, three-valued facts, totals, topics, warnings and the pages of the evidence."""
    records, _, _ = handouts.parse(outlines(spark, sf_dir))
    return records.select(
        "doc_id", F.get("course_codes", F.lit(0)).alias("course_code"), "title", "instructor", "attendance_required", "minimum_attendance_percent", "has_midsem", "has_compre", "academic_year", "semester",
        "total_evaluation_weight", "evaluation_weights_sum_to_100", "total_extracted_marks", "n_components", "extraction_status", F.array_join(F.sort_array("topics"), ", ").alias("topics"),
        F.array_join("parsing_warnings", "; ").alias("warnings"), F.array_join("source_metadata.attendance_policy.pages", ",").alias("attendance_pages"),
    )


@query(FACTS_SQL + """,
parts AS (SELECT doc_id, unit, in_marks, unnest([{'n': 1, 'name': 'Mid-Semester Test', 'w': a, 'kind': 'midsem', 'cnt': NULL, 'said': NULL, 'book': 'closed'},
  {'n': 2, 'name': 'Surprise Quizzes (2)', 'w': b, 'kind': 'quiz', 'cnt': 2, 'said': 'surprise', 'book': 'open'}, {'n': 3, 'name': 'Comprehensive Exam', 'w': c, 'kind': 'compre', 'cnt': NULL, 'said': NULL, 'book': 'closed'}]) AS p FROM facts)
SELECT doc_id, CAST(p.n AS INT) AS row_number, p.name AS name, CAST(p.w AS DOUBLE) AS weight, CASE WHEN in_marks THEN CAST(p.w * unit AS DOUBLE) END AS marks,
  CASE WHEN in_marks THEN 'declared_marks_total' ELSE 'weight_column' END AS weight_basis, CASE WHEN in_marks THEN 200.0::DOUBLE END AS declared_total_marks, p.kind AS type, CAST(p.cnt AS INT) AS count, CAST(p.said AS VARCHAR) AS announcement, p.book AS book_policy FROM parts""")
def eval_table_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the evaluation tables of all outlines, with marks told from weights, and their details."""
    from almanac.functions.text import component_kind

    rows = evaltable.evaluation_rows(outlines(spark, sf_dir).select("doc_id", F.translate("text", "\f", "\n").alias("text")), "doc_id")
    rows = handouts.component_details(rows, ["doc_id", "row_number"]).withColumn("type", component_kind(F.col("name")))
    return rows.select("doc_id", "row_number", "name", "weight", "marks", "weight_basis", "declared_total_marks", "type", "count", "announcement", "book_policy")


@query(f"""
SELECT p_partkey AS doc_id, {listed(ATTENDANCE)}[p_partkey % 3 + 1] AS attendance, '{MAKEUP}' AS makeup_start, 'An introduction to ' || {listed(TOPICS)}[p_partkey % 4 + 1] || '.' AS description FROM part""")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all outlines by their headings."""
    text = F.translate("text", "\f", "\n")

    def part(heading: str) -> Column:
        return F.trim(F.split_part(handouts.section(text, heading), F.lit("\n"), F.lit(1)))

    return outlines(spark, sf_dir).select("doc_id", part(headings.ATTENDANCE).alias("attendance"), part(headings.MAKEUP).alias("makeup_start"), part(headings.DESCRIPTION).alias("description"))


#: How the evaluation table of an outline is written, by its key, with the reader that must be believed. {a}, {b} and {c} are the
#: weights, {a4} is {a} less 4, and numbers in the other columns are there to mislead.
LAYOUTS = [
    ("columned", "Component                 Duration      Weightage       Remarks\nMid-Semester Test         90 min           {a}          Closed Book\nPilani Campus\nQuizzes                   -                {b}          Open Book\nComprehensive Exam        3 h              {c}          Closed Book\nTotal                                    100\nQuiz                      -                7            Void"),
    ("sequenced", "1. Quiz\n     {a}\n2. Project\n     {b}\n3. Viva\n     {c}\nTotal 100"),
    ("named", "Mid Semester Test 90 minutes {a} 12/10/2026\nQuiz 10 marks {b}%\nComprehensive Exam 3 hours {c} 1/12/2026 at 14:00\nTotal 100"),
    ("aligned", "All work is judged.\n" * 32 + "Component   Weightage   Remarks\nEssay   {a}   closed\nTalk   {b}   open\nDebate   {c}   open\nTotal   100   all\nEssay   9   void"),
    ("loose", "Quiz 30 min {a4}+4\nLab {b}\nProject 3 weeks {c}"),
    ("carried", "Mid Sem Test\n     {a} %\nSeminar\n     {b}\nSeminar 1\nViva\n     {c}"),
    ("bulleted", "● {a}% Viva:\n● {b} % Report\n● {c}% Essay"),
    ("columned", "Component                 Duration      Marks       Weightage (%)       Remarks\nMid-Semester              90 min          {a4}            {a}              Closed\nTest\nLab work /                -               12            {b}              Open\nViva\nProject                   3 weeks         250           {c}              Open\n* The project carries 12 more\nQuiz                      -               9             9              no"),
]
#: Names that each layout states for its three rows.
ROW_NAMES = [
    ["Mid-Semester Test", "Quizzes", "Comprehensive Exam"], ["Quiz", "Project", "Viva"], ["Mid Semester Test", "Quiz", "Comprehensive Exam"], ["Essay", "Talk", "Debate"],
    ["Quiz", "Lab", "Project"], ["Mid Sem Test", "Seminar", "Viva"], ["Viva", "Report", "Essay"], ["Mid-Semester Test", "Lab work / Viva", "Project"],
]
# The third layout is believed if it totals 100; else it goes to the reader that takes the first number of a line.
#: Layouts and the rows of each that state a percentage in the value itself.
SHARES = {2: [2], 6: [1, 2, 3]}
#: Lines before a table, so that its numbers are not at the edge of a page, where they would be page numbers.
PROSE = "1. Course Description: A course.\nIt has lectures.\nIt has exercises.\nIt has a book."
NAMES_SQL = "[" + ", ".join(map(listed, ROW_NAMES)) + "]"


@query(FACTS_SQL + f""",
parts AS (SELECT doc_id, doc_id % {len(LAYOUTS)} AS layout, doc_id % {len(LAYOUTS)} = 2 AND doc_id % 5 = 0 AS astray, unnest([{{'n': 1, 'w': a}}, {{'n': 2, 'w': b}}, {{'n': 3, 'w': c}}]) AS p FROM facts)
SELECT doc_id, CASE WHEN astray THEN 'loose' ELSE {listed([reader for reader, _ in LAYOUTS])}[layout + 1] END AS reader, CAST(p.n AS INT) AS row_number, {NAMES_SQL}[layout + 1][p.n] AS name,
  CASE WHEN astray AND p.n = 2 THEN 10 ELSE CAST(p.w AS DOUBLE) END AS weight, CASE WHEN layout = 6 THEN NULL WHEN astray THEN 'weight_column' WHEN {' OR '.join(f"layout = {i} AND p.n IN ({', '.join(map(str, rows))})" for i, rows in SHARES.items())} THEN 'explicit_percentage' ELSE 'weight_column' END AS weight_basis FROM parts""")
def eval_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of evaluation tables in eight layouts, a table for every part, and the reader that is believed for each."""
    k = F.col("p_partkey")
    a, b = (10 + k % 30), (20 + k % 7)
    c = 70 - k % 30 - k % 7 + F.when(k % 5 == 0, 5).otherwise(0)
    table = pick([text for _, text in LAYOUTS], k)
    for slot, value in {"{a}": a, "{b}": b, "{c}": c, "{a4}": a - 4}.items():
        table = F.replace(table, F.lit(slot), value.cast("string"))
    text = F.concat(F.lit("Course Title : "), F.col("p_name"), F.lit(f"\n{PROSE}\n3. Evaluation Scheme:\n"), table, F.lit("\n4. Attendance Policy: Attendance is not compulsory.\n5. Make-up Policy: None.\nFirst Semester 2026-27\n"))
    lines = ingest.lines_of(read(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text")), "doc_id")
    clean = ingest.pages_joined(ingest.without_furniture(lines, "doc_id"), "doc_id")
    blocks = clean.select("doc_id", evaltable.block_of(F.col("text")).alias("block"))
    rows = evaltable.arbitrated(evaltable.proposals(blocks, "doc_id"), "doc_id")
    return rows.select("doc_id", "reader", "row_number", "name", "weight", "weight_basis")


#: Headers of outlines by their key: {d} and {n} make a code, {t} is the title. Codes stand in a line, in a list of departments, in
#: the file's name or nowhere; titles and instructors may be missing or stand in a running text.
HEADS = [
    "Course No. : {d}/SS F{n}\nCourse Title : {t}\nInstructor-in-charge : Prof. A Person (a@b.example)",
    "Name of the course : {t}\nInstructor : Dr. B Person\n    and Prof. C Person",
    "Course Number : {d}_F{n}\nCourse Title : {t}",
    "Course Code : {d} F{n}\nInstructors : Prof. A Person [a@b.example]",
    "This is the outline of Course No: {d} F{n} Course Title: {t} Instructor-in-charge: Prof. D Person Team of teachers",
    "Course Title : {t}\nInstructor(s) : E Person",
]
#: Evaluation schemes by the key: exams denied in two ways, listed, both listed and denied, graded as passed or failed, and none.
SCHEMES = [
    "No midsem will be held. The comprehensive exam will not be held. Pass or Fail is decided by the committee.",
    "Component                Duration     Weightage     Remarks\nMid-Semester Test        90 min           40         Closed\nComprehensive Exam       3 h              60         Open",
    "Component                Duration     Weightage     Remarks\nQuiz                     30 min           40         Closed\nProject                  -                60         Open\nTotal                                     100\nNo mid-semester test",
    "",
    "Component                Duration     Weightage     Remarks\nMid-Semester Test        90 min           40         Closed\nProject                  -                60         Open\nTotal                                     100\nMid-semester exam is not conducted",
]
DEPARTMENTS = ["BIO", "CHEM", "ECON", "MATH"]


@query(f"""
WITH kinds AS (SELECT p_partkey AS doc_id, p_name AS t, p_partkey % {len(HEADS)} AS head, p_partkey % {len(SCHEMES)} AS scheme, {listed(DEPARTMENTS)}[p_partkey % {len(DEPARTMENTS)} + 1] AS d, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS n FROM part)
SELECT doc_id, CASE head WHEN 0 THEN d || ' F' || n || ', SS F' || n WHEN 1 THEN d || ' F' || n WHEN 5 THEN CASE WHEN doc_id % 4 = 1 THEN d || ' F' || n ELSE '' END ELSE d || ' F' || n END AS course_codes,
  CASE WHEN head <> 3 THEN t END AS title, [ 'Prof. A Person', 'Dr. B Person and Prof. C Person', NULL, 'Prof. A Person', 'Prof. D Person', 'E Person'][head + 1] AS instructor,
  CASE scheme WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false END AS has_midsem, CASE scheme WHEN 0 THEN false WHEN 1 THEN true END AS has_compre,
  CASE scheme WHEN 0 THEN 'pass_fail' WHEN 3 THEN 'unresolved' ELSE 'weighted' END AS evaluation_scheme_kind, CASE WHEN scheme IN (1, 2, 4) THEN 2 ELSE 0 END AS n_components,
  concat_ws(' ', CASE WHEN head = 3 THEN 'Course title was not extracted.' END, CASE WHEN head = 2 THEN 'Course instructor was not extracted.' END, CASE WHEN scheme = 3 THEN 'No evaluation components were extracted.' END) AS warnings,
  CASE WHEN head IN (2, 3) OR scheme = 3 THEN 'partial' ELSE 'extracted_unverified' END AS extraction_status FROM kinds""")
def outline_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of outlines whose headers and schemes differ: cross-listed codes, codes of file names, missing titles, denied exams, furniture and invisible characters."""
    k = F.col("p_partkey")
    department, number = pick(DEPARTMENTS, k), F.lpad((k % 1000).cast("string"), 3, "0")
    head = pick(HEADS, k)
    for slot, value in {"{d}": department, "{n}": number, "{t}": F.col("p_name")}.items():
        head = F.replace(head, F.lit(slot), value)
    named = (k % len(HEADS) != 5) | (k % 4 == 1)  # other files have no code in their names
    file_name = F.concat(k.cast("string"), F.when(named, F.concat(F.lit("_"), department, F.lit("_F"), number)).otherwise("_outline"), F.lit(".pdf"))
    text = F.concat_ws(
        "\n", F.lit("Pilani Campus"), head, F.lit("1. Course Description: An intro\u200bduction to the subject and its methods."), F.lit("7"), F.concat(F.lit("\f3. Evaluation Scheme:\n"), pick(SCHEMES, k)),
        F.lit("4. Attendance Policy: Attendance is optional."), F.lit(""),
    )
    records, _, _ = handouts.parse(read(spark, sf_dir, "part").select(k.alias("doc_id"), file_name.alias("file_name"), text.alias("text")))
    return records.select(
        "doc_id", F.array_join("course_codes", ", ").alias("course_codes"), "title", "instructor", "has_midsem", "has_compre", "evaluation_scheme_kind", F.col("n_components").cast("int").alias("n_components"),
        F.array_join("parsing_warnings", " ").alias("warnings"), "extraction_status",
    )


#: Proposals of three readers for every order: its lines, those with a small quantity, and those that were returned.
@query("""
WITH proposals AS (
  SELECT l_orderkey AS doc_id, 'columned' AS reader, l_quantity AS weight FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT l_orderkey, 'sequenced', l_quantity FROM lineitem WHERE l_quantity < 25
  UNION ALL SELECT l_orderkey, 'loose', l_quantity FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 'named', l_quantity FROM lineitem WHERE l_linestatus = 'O'),
sums AS (SELECT doc_id, count(*) FILTER (WHERE reader = 'columned') AS nc, count(*) FILTER (WHERE reader = 'sequenced') AS ns, count(*) FILTER (WHERE reader = 'loose') AS nl, count(*) FILTER (WHERE reader = 'named') AS nn,
  coalesce(sum(weight) FILTER (WHERE reader = 'columned'), 0) AS sc, coalesce(sum(weight) FILTER (WHERE reader = 'sequenced'), 0) AS ss, coalesce(sum(weight) FILTER (WHERE reader = 'named'), 0) AS sn FROM proposals GROUP BY doc_id),
chosen AS (SELECT doc_id, CASE WHEN nn > 0 AND abs(sn - 100) <= 0.1 AND abs(sc - 100) > 0.1 THEN 'named' WHEN ns > 0 AND (ns > nc OR ns = nc AND ss = 100) THEN 'sequenced' WHEN nc > 0 THEN 'columned' WHEN nl > ns THEN 'loose' ELSE 'sequenced' END AS reader FROM sums)
SELECT doc_id, reader, count(*) AS n, sum(weight) AS total FROM proposals JOIN chosen USING (doc_id, reader) GROUP BY doc_id, reader""")
def eval_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several readers of a table is believed, for proposals made from every order."""
    li = read(spark, sf_dir, "lineitem")
    sets = {"columned": "l_linenumber <= 4", "sequenced": "l_quantity < 25", "loose": "l_returnflag = 'R'", "named": "l_linestatus = 'O'"}
    proposals = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("weight"), F.explode(F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(r)) for r, rule in sets.items())))).alias("reader"))
    return evaltable.arbitrated(proposals, "doc_id").groupBy("doc_id", "reader").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query("SELECT l_orderkey AS doc_id, coalesce(abs(sum(l_quantity) - 100) <= 0.1, false) AS near_100, coalesce(abs(sum(l_quantity) - 100) <= 0.01, false) AS exactly_100 FROM lineitem GROUP BY l_orderkey")
def sum_to_100_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.operators.quality import all_or_nothing, near_100

    total = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(all_or_nothing("l_quantity").alias("total"))
    return total.select("doc_id", near_100(F.col("total")).alias("near_100"), near_100(F.col("total"), 0.01).alias("exactly_100"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS row_number FROM orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.operators import sequence

    return sequence.numbered(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_number")
