"""Queries on text, lines, pages and queries in natural language, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import fixed, text
from almanac.operators import policy, sequence
from almanac.operators import query as preferences
from almanac.operators.quality import best_of_rules, deductions
from almanac.plans.academic import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


def token_sql(expression: str) -> str:
    """Sorted distinct keywords as a list."""
    words = f"list_transform(regexp_extract_all(lower({expression}), '[a-z][a-z0-9+#-]+'), lambda w: regexp_replace(w, '-related$', ''))"
    kept = f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))"
    wide = f"flatten(list_transform({kept}, lambda w: CASE w WHEN 'ai' THEN ['artificial', 'intelligence'] WHEN 'ml' THEN ['machine', 'learning'] ELSE [w] END))"
    return f"list_sort(list_distinct({wide}))"


@query(f"SELECT doc_id, array_to_string({token_sql('text')}, ' ') AS tokens, CAST(len({token_sql('text')}) AS INT) AS n FROM documents")
def tokens_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of documents in every language, or in none that is known."""
    return keywords_of(read(spark, sf_dir, "documents"))


def keywords_of(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(f"""
WITH t AS (SELECT p_partkey AS course, {token_sql('p_name')} AS title, {token_sql("p_name || ' ' || p_type || ' ' || p_brand")} AS described, ['red', 'steel', 'part', 'promo', 'economy'] AS wanted FROM part)
SELECT course, CAST(5.0 * len(list_intersect(wanted, title)) + 3.0 * len(list_filter(list_intersect(wanted, described), lambda w: NOT list_contains(title, w))) AS DOUBLE) AS score FROM t""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.operators.recommend import keyword_score as score

    wanted = F.array(*map(F.lit, ["red", "steel", "part", "promo", "economy"]))
    described = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("course"), score(wanted, text.tokens(F.col("p_name")), text.tokens(described)).alias("score"))


PHRASES = [(i, p) for i, p in enumerate(["red", "blue", "large", "promo", "steel", "burnished", "economy", "small", "green"])]


@query(f"""
WITH {values('vocabulary', 'place, phrase', PHRASES)},
sections AS (SELECT p_partkey AS course, unnest([1, 2]) AS ordinal, unnest([p_name, p_type]) AS section FROM part),
found AS (SELECT course, phrase, ordinal FROM sections JOIN vocabulary ON list_contains(regexp_split_to_array(lower(section), '[^a-z]+'), phrase))
SELECT course, phrase, min(ordinal) AS ordinal FROM found GROUP BY course, phrase""")
def topic_vocabulary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.operators.handouts import topics_of

    sections = F.array(F.struct(F.lit(1).alias("ordinal"), F.col("p_name").alias("section")), F.struct(F.lit(2).alias("ordinal"), F.col("p_type").alias("section")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("course"), F.inline(sections))
    return topics_of(rows, "course", [p for _, p in PHRASES]).select("course", F.col("topic").alias("phrase"), "ordinal")


@query("SELECT p_partkey AS course, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("course"), text.title_case(F.col("p_name")).alias("title"))


CODE_SQL = r"([A-Z]{2,8})\s+([A-Z])\s*([0-9]{3}[A-Z]?(?:-[0-9]+)?)"


CODE_LINE = """CASE p_partkey % 6 WHEN 0 THEN 'cs g ' || lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 1 THEN 'CS_F' || lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0') || ' and more'
  WHEN 2 THEN 'see BIO F' || lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0') || 'a-' || CAST(p_size AS VARCHAR(9)) WHEN 3 THEN 'X F' || lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 4 THEN p_name END"""


@query(f"""
WITH raw AS (SELECT p_partkey AS id, {CODE_LINE} AS line FROM part), u AS (SELECT id, upper(replace(line, '_', ' ')) AS line FROM raw)
SELECT id, CASE WHEN regexp_matches(line, '{CODE_SQL}') THEN regexp_extract(line, '{CODE_SQL}', 1) || ' ' || regexp_extract(line, '{CODE_SQL}', 2) || regexp_extract(line, '{CODE_SQL}', 3) END AS code FROM u""")
def code_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first course code of a line for every part; some lines have none."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.code(F.expr(CODE_LINE)).alias("code"))


@query("""
WITH codes AS (SELECT l_orderkey, ['CS', 'MATH', 'BIO'][l_partkey % 3 + 1] || ' F' || lpad(CAST(l_partkey % 500 AS VARCHAR), 3, '0') AS code, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS id, string_agg(code, ',' ORDER BY pos, code) AS codes FROM codes GROUP BY l_orderkey""")
def multi_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes of a line in their order, for the parts of every order, with words between and repeats."""
    dept = F.get(F.array(*map(F.lit, ("CS", "MATH", "BIO"))), (F.col("l_partkey") % 3).cast("int"))
    code = F.concat(dept, F.when(F.col("l_linenumber") % 2 == 0, "  F").otherwise(" F"), F.lpad((F.col("l_partkey") % 500).cast("string"), 3, "0"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", code.alias("code"))))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(listed, lambda x: x["code"]), " with 12 or ").alias("line"))
    return rows.select("id", F.array_join(text.all_codes(F.col("line")), ",").alias("codes"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS line FROM documents")
def compact_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("line"))


#: Names of assessments are two of these, by the key.
NAME_WORDS = ["Mid-Semester", "Compre", "Report", "seminar", "Quizzes", "Lab", "Project", "Case Study", "Class participation", "Attendance", "test", "Viva-voce", "Assignments", "mid term"]
NAME_SQL = f"[{', '.join(repr(w) for w in NAME_WORDS)}]"
#: A report on an exam before the last is no exam.
REPORT_SQL = r"regexp_matches(name, '(?i)\bmid[-. ]*(?:sem|semester|term)\b') AND regexp_matches(name, '(?i)\b(?:report|seminar|presentation|project)\b') AND NOT regexp_matches(name, '(?i)\b(?:exam|examination|test)\b')"
KIND_SQL = f"CASE WHEN {REPORT_SQL} THEN CASE WHEN regexp_matches(name, '(?i)seminar|presentation') THEN 'presentation' ELSE 'project' END " + " ".join(f"WHEN regexp_matches(name, '(?i){pattern}') THEN '{kind}'" for kind, pattern in fixed.COMPONENT_KINDS) + " ELSE 'other' END"


@query(f"""
WITH names AS (SELECT o_orderkey AS id, {NAME_SQL}[o_orderkey % 14 + 1] || ' ' || {NAME_SQL}[o_orderkey // 14 % 14 + 1] AS name FROM orders)
SELECT id, {KIND_SQL} AS kind FROM names""")
def component_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of an assessment from its name, for every order; all pairs of words occur."""
    words, k = F.array(*map(F.lit, NAME_WORDS)), F.col("o_orderkey")
    name = F.concat_ws(" ", F.get(words, (k % 14).cast("int")), F.get(words, (F.floor(k / 14) % 14).cast("int")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), text.component_kind(name).alias("kind"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS form, (o_orderkey // 5 % 20) * 5 AS share, [40, 60, 80, 200][o_orderkey % 4 + 1] AS total FROM orders)
SELECT id, CASE WHEN form <> 2 THEN CAST(share AS DOUBLE) END AS weight, CASE WHEN form IN (1, 2, 3) THEN CAST(share * total / 100 AS DOUBLE) END AS marks,
  CASE WHEN form IN (0, 4) THEN 'weight_column' WHEN form = 2 THEN 'marks_only' ELSE 'declared_marks_total' END AS weight_basis, CASE WHEN form IN (1, 3) THEN CAST(total AS DOUBLE) END AS declared_total_marks FROM o""")
def marks_vs_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks told from weights by five kinds of headers, for every order."""
    k = F.col("o_orderkey")
    share, total = (F.floor(k / 5) % 20) * 5, F.get(F.array(*map(F.lit, (40, 60, 80, 200))), (k % 4).cast("int"))
    value = F.when((k % 5).isin(0, 4), share).otherwise(share * total / 100).cast("double")
    header = F.get(F.array(F.lit("Component  Duration  Weightage"), F.concat(F.lit("Component  Marks ("), total, F.lit(")")), F.lit("Component  Marks"), F.concat(F.lit("Component Marks\nTotal Marks: "), total), F.lit("Marks %")), (k % 5).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), text.value_fields(value, header).alias("v")).select("id", "v.*")


DAY_NAMES = ["M", "T", "W", "Th", "F", "S", "Su"]


@query(f"""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS a, (o_orderkey + 1 + o_orderkey // 7 % 3) % 7 AS b, (o_orderkey + 4 + o_orderkey // 21 % 3) % 7 AS c, 1 + o_orderkey % 9 AS p, 1 + o_orderkey // 9 % 9 AS q FROM orders),
days AS (SELECT *, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'] AS d FROM o)
SELECT id, array_to_string(list_sort(list_distinct([d[a + 1] || p, d[b + 1] || p, d[c + 1] || q])), ' ') AS slots FROM days""")
def meeting_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and periods of a meeting text with two lists, for every order."""
    k, names = F.col("o_orderkey"), F.array(*map(F.lit, DAY_NAMES))

    def day(n) -> Column:
        return F.get(names, (n % 7).cast("int"))

    meeting = F.concat_ws(" ", day(k), day(k + 1 + F.floor(k / 7) % 3), (1 + k % 9).cast("string"), day(k + 4 + F.floor(k / 21) % 3), (1 + F.floor(k / 9) % 9).cast("string"))
    slots = F.transform(text.meeting_slots(meeting), lambda s: F.concat(s["day"], s["period"].cast("string")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(slots, " ").alias("slots"))


#: Requests are made of three of these, by the key.
ASKED = [
    "Suggest AI DELs", "with no midsem", "and no 8 AM classes", "no quizzes please", "with a small midsem", "open-book HUEL", "with projects, Mondays free", "fewer quizzes", "and low exam weight",
    "lenient make-up OPELs", "without compre", "avoid Friday or Tuesday", "project-based machine learning courses", "", "no attendance requirement", "high project weight", "CDCs on robotics",
]
ASKED_SQL = "[" + ", ".join(f"'{a}'" for a in ASKED) + "]"
FLAG_SQL = ",\n".join(f"regexp_matches(lower(q), '{pattern}') AS {name}" for name, pattern in fixed.QUERY_FLAGS.items())
DAY_SQL = "CASE WHEN regexp_matches(lower(q), 'free|avoid|no class') THEN CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{stem}') THEN '{day}'" for day, stem in reversed(list(zip(fixed.WEEKDAYS, fixed.WEEKDAY_STEMS, strict=True)))) + " END END"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '\\b{c}s?\\b') THEN '{c}'" for c in fixed.CATEGORIES) + " END"


@query(f"""
WITH asked AS (SELECT o_orderkey AS id, {ASKED_SQL}[o_orderkey % 17 + 1] || ' ' || {ASKED_SQL}[o_orderkey // 17 % 17 + 1] || ' ' || {ASKED_SQL}[o_custkey % 17 + 1] AS q FROM orders)
SELECT id, {CATEGORY_SQL} AS category, array_to_string({token_sql('q')}, ' ') AS keywords, {FLAG_SQL},
  regexp_matches(lower(q), '{fixed.LENIENT}') AND regexp_matches(lower(q), 'make[- ]?up') AS lenient_makeup, {DAY_SQL} AS free_day FROM asked""")
def query_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests ask for, for every order."""
    k, parts = F.col("o_orderkey"), F.array(*map(F.lit, ASKED))
    q = F.concat_ws(" ", F.get(parts, (k % 17).cast("int")), F.get(parts, (F.floor(k / 17) % 17).cast("int")), F.get(parts, (F.col("o_custkey") % 17).cast("int")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), preferences.preferences(q).alias("p")).select("id", "p.*").withColumn("keywords", F.array_join("keywords", " "))


@query("""
SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, event_type IN ('click', 'view', 'purchase') AS known FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of a JSON column, and an enumeration check."""
    props = F.from_json("props", "map<string,string>")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(props, key).alias("first_value"), F.col("event_type").isin("click", "view", "purchase").alias("known"))


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
marked AS (SELECT *, sum(CASE WHEN line LIKE 'The %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM lines)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, min(line_no) AS first_line FROM marked GROUP BY doc_id, segment""")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sequence.segmented(lines(spark, sf_dir), ["doc_id"], ["line_no"], F.startswith("line", F.lit("The ")))
    return marked.groupBy("doc_id", "segment").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.min("line_no").cast("long").alias("first_line"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.sources.ingest import lines_of

    return lines_of(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "page_no", "line_no", "line")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS row_number FROM conversations""")
def carry_forward_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.carried(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return sequence.numbered(rows, ["conv_id"], ["turn", "role"]).select("conv_id", "turn", "asked_at", "row_number")


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
halves AS (SELECT *, max(length(line)) OVER (PARTITION BY doc_id) // 2 AS half FROM lines)
SELECT doc_id, line_no, 1 AS col_no, substr(line, 1, half) AS part FROM halves UNION ALL SELECT doc_id, line_no, 2, substr(line, half + 1) FROM halves""")
def two_column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.two_columns(lines(spark, sf_dir), ["doc_id", "page_no"], "line_no", "line").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "col_no", "part")


@query("""SELECT l_orderkey AS line, l_linenumber AS pos, CAST(abs(l_quantity - 30) AS DOUBLE) AS distance FROM lineitem WHERE abs(l_quantity - 30) <= 18
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 30), l_linenumber) = 1""")
def nearest_header_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell nearest to a header's place, for the lines of every order."""
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("pos"), "l_quantity")
    return sequence.nearest(cells, ["line"], F.abs(F.col("l_quantity") - 30), ["pos"], 18).select("line", "pos", F.col("distance").cast("double").alias("distance"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, 2 + o_orderkey % 6 AS offered, 1 + o_orderkey // 6 % 5 AS best, CASE WHEN o_orderkey % 2 = 0 THEN 'quiz' ELSE 'tutorial' END AS component_group, 5 + o_orderkey % 7 AS each, o_orderkey % 4 = 3 AS more FROM orders)
SELECT doc_id, CAST(best AS INT) AS best_count, CAST(offered AS INT) AS offered_count, component_group, NOT more AS applied, CASE WHEN more THEN 0.0 ELSE CAST((offered - best) * each AS DOUBLE) END AS deducted FROM o WHERE best < offered""")
def best_n_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-of statements in figures and words and what they take off, for every order; every fourth scheme has a row too many."""
    k = F.col("o_orderkey")
    offered, best = 2 + k % 6, 1 + F.floor(k / 6) % 5
    number = F.array(*map(F.lit, ("zero", "one", "two", "three", "four", "five", "six", "seven")))
    said = F.when(k % 3 == 0, F.get(number, best.cast("int"))).otherwise(best.cast("string"))
    kind = F.when(k % 2 == 0, "quizzes").otherwise("tutorial tests")
    form = F.when(k % 5 == 0, F.concat(F.lit("Best "), said, F.lit(" of the "), F.get(number, offered.cast("int")), F.lit(" "), kind, F.lit(" are taken."))).otherwise(F.concat(F.lit("The best "), said, F.lit(" out of "), offered.cast("string"), F.lit(" "), kind, F.lit(" count.")))
    docs = read(spark, sf_dir, "orders").select(k.alias("doc_id"), form.alias("text"), kind.alias("kind"), (offered + F.when(k % 4 == 3, 1).otherwise(0)).cast("int").alias("n"), (5 + k % 7).cast("double").alias("each"))
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("row_number"), F.concat(F.when(F.col("kind") == "quizzes", "Quiz ").otherwise("Tutorial "), F.col("n").cast("string")).alias("name"), F.col("each").alias("weight"))
    return deductions(best_of_rules(docs.select("doc_id", "text")), rows).select("doc_id", F.col("best_count").cast("int").alias("best_count"), F.col("offered_count").cast("int").alias("offered_count"), "component_group", "applied", "deducted")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '1,2' WHEN 2 THEN '' WHEN 3 THEN '3' ELSE '' END AS pages FROM part""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages on which an excerpt stands, for every part: on one, across two, on none, or an empty one."""
    k = F.col("p_partkey")
    first, second, third = F.concat(F.lit("name "), F.col("p_name")), F.concat(F.lit("brand "), F.col("p_brand")), F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" end"))
    excerpt = F.when(k % 5 == 0, second).when(k % 5 == 1, F.concat(first, F.lit("\n"), second)).when(k % 5 == 2, F.concat(F.lit("no "), second)).when(k % 5 == 3, third).otherwise("")
    return read(spark, sf_dir, "part").select(k.alias("id"), F.array_join(text.pages_of(F.concat_ws("\f", first, second, third), excerpt), ",").alias("pages"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '([.!?]) ', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s) <> '')) AS INT) AS n_sentences
FROM documents""")
def sentence_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents; what follows the last mark counts as one."""
    return sentence_counts(read(spark, sf_dir, "documents"))


def sentence_counts(docs: DataFrame) -> DataFrame:
    from almanac.operators.handouts import sentences

    return docs.select("doc_id", F.size(sentences(text.compact(F.col("text")))).alias("n_sentences"))


@query("""
SELECT page_id, url, try_cast(regexp_extract(url, '([0-9]+)', 1) AS INT) AS number, CASE WHEN try_cast(regexp_extract(url, '([0-9]+)', 1) AS INT) IS NULL THEN 'no number' END AS error FROM pages""")
def quarantine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that goes on past rows which cannot be read, and says why."""
    n = F.regexp_extract("url", "([0-9]+)", 1).try_cast("int")
    return read(spark, sf_dir, "pages").select("page_id", "url", n.alias("number"), F.when(n.isNull(), "no number").alias("error"))


@query("""
SELECT l_orderkey AS doc_id, l_quantity > 25 AS taken, l_linenumber AS line FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity > 25 DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def candidate_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of several candidate readings: the larger class first, then the earliest."""
    li = read(spark, sf_dir, "lineitem").withColumn("taken", F.col("l_quantity") > 25)
    best = sequence.one_per_key(li, ["l_orderkey"], [F.desc("taken"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return best.select(F.col("l_orderkey").alias("doc_id"), "taken", F.col("l_linenumber").alias("line"))


@query("SELECT doc_id, text[:40] AS head, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS candidates FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def ranked_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three longest documents of each source, with the number before the limit."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("head"), "source", "n_chars")
    top = d.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("_n <= 3")
    return top.join(d.groupBy("source").agg(F.count("*").alias("candidates")), "source").select("doc_id", "head", "candidates")
