"""Extraction queries: catalogues, timetables and regulations written from the tables are read back, and must give the tables' facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import fixed
from almanac.operators import catalog, policy
from almanac.operators.sequence import spread
from almanac.plans.academic import ORDINAL, read, tasks
from almanac.plans.outlines import pick
from almanac.sources.ingest import lines_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Courses that a written document holds; documents stay small however many courses there are.
PER_DOCUMENT = 20
WIDE = 120
MEETING_DAYS = ["M", "T", "W", "Th", "F", "S"]
SESSIONS = ["FN1", "FN2", "AN1", "AN2"]


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


def code_of(k: Column) -> Column:
    """A course code for a number: four letters for its thousands, three digits."""
    thousands = F.floor(k / 1000)
    letters = [F.char((65 + F.floor(thousands / 26**i) % 26).cast("int")) for i in (3, 2, 1, 0)]
    return F.concat(*letters, F.lit(" F"), F.lpad((k % 1000).cast("string"), 3, "0"))


def code_sql(k: str) -> str:
    letters = " || ".join(f"chr(CAST(65 + (({k}) // 1000 // {26**i}) % 26 AS INT))" for i in (3, 2, 1, 0))
    return f"({letters} || ' F' || lpad(CAST(({k}) % 1000 AS VARCHAR), 3, '0'))"


def written(rows: DataFrame, document: Column, order: list[str], pages: list[list[Column | str]], tasks: int | None = None) -> DataFrame:
    """Lines of one document per value of ``document``.

    A page is a list of texts that stand alone and of columns that give, for
    each row of the document in order, its lines or null. Documents are dealt
    to ``tasks``, or as Spark deals them, by the size of their packed rows.
    """
    columns = {f"_{i}_{j}": part for i, page in enumerate(pages) for j, part in enumerate(page) if not isinstance(part, str)}
    rows = rows.select(document.cast("string").alias("source_document"), F.struct(*order, *(c.alias(n) for n, c in columns.items())).alias("_row"))
    docs = spread(rows, tasks, "source_document").groupBy("source_document").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))

    def part(i: int, j: int, value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else F.nullif(F.array_join(F.transform("_rows", lambda r: r[f"_{i}_{j}"]), "\n"), F.lit(""))

    text = F.concat_ws("\f", *(F.concat_ws("\n", *(part(i, j, value) for j, value in enumerate(page))) for i, page in enumerate(pages)))
    return lines_of(docs.select("source_document", text.alias("text")), "source_document")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), (1 + F.col("p_size") % 5).cast("string").alias("units"), F.col("p_brand").alias("brand"))


@query(f"""
SELECT {code_sql("p_partkey")} AS course, p_name AS title, CAST(1 + p_size % 5 AS INT) AS units,
  CASE WHEN p_partkey % 5 = 0 THEN {code_sql("p_partkey + 1")} || ' and ' || {code_sql("p_partkey + 2")} WHEN p_partkey % 3 = 0 THEN 'by consent' END AS prerequisite_expression,
  CASE WHEN p_partkey % 5 = 0 THEN {code_sql("p_partkey + 1")} || ', ' || {code_sql("p_partkey + 2")} ELSE '' END AS needs,
  CAST(1 + CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS INT) AS n_sources
FROM part""")
def catalogue_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of all catalogues: entries, prerequisites below them, and those of the descriptions, which take precedence."""
    k = F.col("k")
    entry = F.concat(F.rpad(F.concat(code_of(k), F.lit("  "), "title"), WIDE, " "), F.lit("  "), "units")
    asks = F.when(k % 3 == 0, F.lit("Pre-requisite: by consent"))
    described = F.when(k % 5 == 0, F.concat(code_of(k), F.lit("  "), "title", F.lit("   "), "units", F.lit("\nPrerequisite: "), code_of(k + 1), F.lit("\nand "), code_of(k + 2)))
    lines = written(parts(spark, sf_dir), F.floor(k / PER_DOCUMENT), ["k"], [[F.concat_ws("\n", entry, asks)], ["Course Description".ljust(WIDE) + ".", described]], tasks(spark, sf_dir, "part"))
    return catalog.catalogue(lines).select("course", "title", "units", "prerequisite_expression", F.array_join("needs", ", ").alias("needs"), F.size("sources").alias("n_sources"))


@query(f"""
SELECT 'SCHOOL ' || chr(CAST(65 + p_partkey % 25 AS INT)) AS programme, 'CDC' AS category, {code_sql("p_partkey")} AS course FROM part
UNION ALL SELECT 'SCHOOL ' || chr(CAST(65 + (p_partkey + 24) % 25 AS INT)), 'DEL', {code_sql("p_partkey")} FROM part
UNION ALL SELECT NULL, 'pool', {code_sql("p_partkey")} FROM part WHERE p_brand = 'Brand#11'""")
def programme_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core and elective lists of all programmes, and the humanities pool, from pages in two columns."""
    k, core = F.col("k"), F.col("category") == "CDC"
    lists = F.array(F.struct(F.lit("CDC").alias("category"), (k % 25).alias("school")), F.struct(F.lit("DEL").alias("category"), ((k + 24) % 25).alias("school")))
    rows = parts(spark, sf_dir).select("*", F.inline(lists))

    def left(text: Column | str) -> Column | str:
        return text.ljust(WIDE // 2) + "." * (WIDE // 2) if isinstance(text, str) else F.concat(F.rpad(text, WIDE // 2, " "), F.lit("." * (WIDE // 2)))

    line = left(F.concat_ws(" ", code_of(k), "title"))
    # The name of the programme stands above its lists, so it is one of the document's keys.
    named = written(
        rows, F.concat(F.char((65 + F.col("school")).cast("int")), F.floor(k / (25 * PER_DOCUMENT))), ["k", "category"],
        [[left("List of Courses for B.E. / M.Sc. / B.Pharm."), left("SCHOOL ?"), left("CORE COURSES"), F.when(core, line), left("DISCIPLINE ELECTIVE COURSES"), F.when(~core, line), left("Project Type Courses"), left("ZZZZ F999 Special"),
          left(f"{catalog.POOL} programmes"), F.when(core & (F.col("brand") == "Brand#11"), line), left("Other Courses"), left("ZZZZ F998 Not in the pool")]], tasks(spark, sf_dir, "part"),
    ).withColumn("line", F.replace("line", F.lit("?"), F.substring("source_document", 1, 1)))
    categories, pool = catalog.programme_categories(named)
    return categories.select("programme", "category", "course").unionByName(pool.select(F.lit(None).cast("string").alias("programme"), F.lit("pool").alias("category"), "course"))


def timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a timetable for every order: a primary row for each of its items, and a further section for every second."""
    n = F.col("l_linenumber")
    exams = F.concat_ws("  ", F.concat_ws(" ", F.date_format("l_shipdate", "dd/MM"), pick(SESSIONS, n)), F.when(F.col("l_linestatus") == "F", F.lit("01/12 FN")))
    room = F.concat(F.lit("51"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"))
    meeting = F.concat_ws(" ", pick(MEETING_DAYS, F.weekday("l_shipdate")), n)
    primary = F.concat(
        (F.col("l_suppkey") % 100 * 61).cast("string"), F.lit(" "), code_of(F.col("l_partkey")), F.lit("  TOPICS IN "), F.col("l_returnflag"), F.lit("   3 - 1 - "), (1 + n % 5).cast("string"), F.lit("  L"), n.cast("string"),
        F.lit("   A PERSON "), exams, F.lit("  "), room, F.lit(" "), meeting, F.when(F.col("l_returnflag") == "R", F.lit("  CANCELLED")).otherwise(F.lit("")),
    )
    further = F.when(n % 2 == 0, F.concat(F.lit(" " * 72 + "T"), n.cast("string"), F.lit("  B PERSON 1204 Th "), n.cast("string")))
    return written(read(spark, sf_dir, "lineitem"), F.col("l_orderkey"), ORDINAL, [[F.concat_ws("\n", primary, further)]])


TIMETABLE_SQL = f"""
WITH rows AS (
  SELECT {code_sql("l_partkey")} AS course, CAST(l_suppkey % 100 * 61 AS INT) AS computer_code, 'TOPICS IN ' || l_returnflag AS title, CAST(1 + l_linenumber % 5 AS INT) AS units, CAST(l_linenumber AS VARCHAR) AS n,
    '51' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS room, {MEETING_DAYS}[(isodow(l_shipdate) - 1) % 6 + 1] || ' ' || l_linenumber AS meeting_text, l_returnflag = 'R' AS cancelled,
    strftime(l_shipdate, '%d/%m') AS midsem_date, {SESSIONS}[l_linenumber % 4 + 1] AS midsem_session, CASE WHEN l_linestatus = 'F' THEN 'FN' END AS compre_session
  FROM lineitem)
"""


@query(TIMETABLE_SQL + f"SELECT course, computer_code, title, units, 'L' || n AS section, room, meeting_text, cancelled, computer_code >= {fixed.RESTRICTED_FROM} AS restricted, midsem_date, midsem_session, compre_session FROM rows")
def timetable_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offerings of all timetables: credits, first section, room, meetings, marks and exams."""
    offerings, _ = catalog.timetable(timetables(spark, sf_dir))
    return offerings.select(
        "course", "computer_code", "title", F.col("credits.u").alias("units"), "section", "room", "meeting_text", "cancelled", "restricted", F.col("midsem.date").alias("midsem_date"),
        F.col("midsem.session").alias("midsem_session"), F.col("compre.session").alias("compre_session"),
    )


@query(TIMETABLE_SQL + """
SELECT course, computer_code, 'L' || n AS section, room, meeting_text, cancelled FROM rows
UNION ALL SELECT course, computer_code, 'T' || n, '1204', 'Th ' || n, false FROM rows WHERE CAST(n AS INT) % 2 = 0""")
def timetable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all timetables: those of the primary rows, and those in lines that go on from them."""
    _, sections = catalog.timetable(timetables(spark, sf_dir))
    return sections.select("course", "computer_code", "section", "room", "meeting_text", "cancelled")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of every customer, numbered by key."""
    of_customer = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate"))).alias("_orders"))
    rows = of_customer.select("o_custkey", F.posexplode("_orders").alias("at", "o"))
    return rows.select("o_custkey", (F.col("at") + 1).alias("n"), F.col("o.o_orderkey").alias("k"), F.date_format("o.o_orderdate", "yyyy-MM-dd").alias("day"))


ORDERS_SQL = """
WITH numbered AS (SELECT CAST(o_custkey AS VARCHAR) AS source_document, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS INT) AS n, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
"""


@query(ORDERS_SQL + """
SELECT source_document, n AS ordinal, (k // 100) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS clause_id, CAST(n // 2 + 1 AS VARCHAR) || CASE WHEN n % 2 = 1 AND n < max(n) OVER (PARTITION BY source_document) THEN ',' || (n // 2 + 2) ELSE '' END AS pages,
  'Rule ' || k || ' binds whoever asks from ' || day || ' on' AS text FROM numbered""")
def regulation_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of all regulations; every second one goes on to the next page, and page numbers are left out."""
    k, n = F.col("k"), F.col("n")
    number = F.concat(F.floor(k / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    rows = orders(spark, sf_dir).withColumn("more", n < F.max("n").over(Window.partitionBy("o_custkey")))
    rest = F.concat(F.lit("from "), F.col("day"), F.lit(" on"))
    lines = F.concat(F.lit("Rule "), k.cast("string"), F.lit(" binds whoever asks     "), number, F.when((n % 2 == 1) & F.col("more"), F.lit("\n17\n\f")).otherwise(F.lit("\n")), rest)
    found = catalog.clauses(written(rows, F.col("o_custkey"), ["n"], [["Regulations", lines]]))
    return found.select("source_document", F.col("ordinal").cast("int").alias("ordinal"), "clause_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "text")


#: Ids of clauses, by their place in a regulation.
CLAUSE_IDS = ["1.01", "1.02", "1.03", "2.05", "2.08", "2.10", "3.13a"]
CLAUSES_SQL = ORDERS_SQL.rstrip() + f""", c AS (SELECT source_document, n, [{', '.join(repr(c) for c in CLAUSE_IDS)}][n % 7 + 1] AS clause_id FROM numbered),
specs AS (SELECT unnest([{', '.join(f"{{'clause_id': '{c}', 'kind': '{k}'}}" for c, k, _ in fixed.TYPED_RULES)}], recursive := true))
"""


def extracted_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses read from regulations written for every customer, a clause for each order."""
    number = F.get(F.array(*map(F.lit, CLAUSE_IDS)), (F.col("n") % 7).cast("int"))
    line = F.concat(F.lit("Rule "), F.col("k").cast("string"), F.lit(" binds whoever asks     "), number)
    return catalog.clauses(written(orders(spark, sf_dir), F.col("o_custkey"), ["n"], [["Regulations", line]]))


@query(CLAUSES_SQL + """SELECT source_document, 'regulation_' || replace(clause_id, '.', '_') || '_' || kind AS rule_id, kind, clause_id FROM (SELECT DISTINCT source_document, clause_id FROM c) JOIN specs USING (clause_id)""")
def typed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with explicit numbers, from the clauses extracted from every regulation."""
    return policy.typed_rules(extracted_clauses(spark, sf_dir), ["source_document"]).select("source_document", "rule_id", "kind", "clause_id")


@query(CLAUSES_SQL + """SELECT source_document, 'regulation_' || replace(replace(clause_id, '.', '_'), ' ', '_') || '_' || n AS rule_id,
  CASE WHEN clause_id IN (SELECT clause_id FROM specs) THEN 'partially_automated' ELSE 'manual_review' END AS automation FROM c""")
def registry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted clause as a registry entry, numbered within its regulation."""
    clauses = extracted_clauses(spark, sf_dir)
    return policy.registry(clauses, policy.typed_rules(clauses, ["source_document"]), ["source_document"]).select("source_document", "rule_id", "automation")


@query(ORDERS_SQL + "SELECT source_document, 'timetable_registration_' || n AS rule_id, 'Order ' || k || ' is due before ' || day AS text FROM numbered")
def registration_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered instructions of all timetables, between their heading and the next part."""
    item = F.concat(F.col("n").cast("string"), F.lit(". Order "), F.col("k").cast("string"), F.lit(" is due\n   before "), F.col("day"))
    pages = [["1. Before the heading", "INSTRUCTIONS REGARDING REGISTRATION", item, "VIII. Other", "99. After the end"]]
    rules = catalog.registration_rules(written(orders(spark, sf_dir), F.col("o_custkey"), ["n"], pages))
    return rules.select("source.source_document", "rule_id", "text")


@query(f"SELECT {code_sql('p_partkey')} AS canonical_course, {code_sql('p_partkey')} || ', ' || {code_sql('p_partkey + 1')} AS equivalent_courses FROM part WHERE p_partkey % 5 = 0")
def equivalence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equivalent courses on the pages of their section; lines with one code, and other pages, give none."""
    k = F.col("k")
    pair, one = F.concat_ws("  ", code_of(k), code_of(k + 1), code_of(k)), code_of(k)
    pages = [["I. Calendar", F.concat_ws(" and ", code_of(k), code_of(k + 1))], ["IX. LIST OF EQUIVALENT COURSES", F.when(k % 5 == 0, pair).when(k % 5 == 1, one)], ["X. Library", pair]]
    groups = catalog.equivalence_groups(written(parts(spark, sf_dir), F.floor(k / PER_DOCUMENT), ["k"], pages))
    return groups.select("canonical_course", F.array_join("equivalent_courses", ", ").alias("equivalent_courses"))
