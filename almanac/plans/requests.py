"""Requests with remote replies, make-up clauses, sources of claims and a scan of files, each from every row of a table."""

from __future__ import annotations

import urllib.error

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import handouts
from almanac.operators import query as preferences
from almanac.operators import recommend
from almanac.plans import academic
from almanac.plans.academic import read, with_view
from almanac.plans.advice import outlines
from almanac.plans.outlines import listed, pick
from almanac.plans.textual import CATEGORY_SQL, DAY_SQL, FLAG_SQL, token_sql
from almanac.sources.ingest import texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PHRASES = [
    "DELs with no midsem and no 8 AM classes", "no quizzes", "a small midsem", "open-book HUEL with projects, Mondays free", "fewer quizzes and low exam weight",
    "lenient make-up OPELs without compre, avoid Friday or Tuesday", "project-based machine learning courses", "", "ÉTUDES naïve 8 a.m.", "no attendance, Saturdays free",
]
#: What a remote parser may reply: nothing, two replies that fit, and five that do not.
FIT = {"category": '"huel"', "keywords": '["AI", "robots"]', "free_day": '"Tue"'} | {f: "true" if f == "open_book" else "false" for f in preferences.FLAGS}


def reply(**changed: str | None) -> str:
    fields = {k: v for k, v in (FIT | changed).items() if v is not None}
    return "{" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + "}"


REPLIES = [None, reply(), reply(category="null", free_day="null", keywords="[]"), reply(category='"xyz"'), reply(free_day='"Sun"'), reply(no_quiz=None), reply(no_quiz='"perhaps"'), "{not json"]


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


@query(f"""
WITH asked AS (SELECT c_custkey AS customer, c_mktsegment || ' ' || {listed(PHRASES)}[c_custkey % {len(PHRASES)} + 1] AS q, c_custkey // {len(PHRASES)} % {len(REPLIES)} AS kind FROM customer),
parsed AS (SELECT *, {token_sql('q')} AS words, {FLAG_SQL}, {CATEGORY_SQL} AS own_category, {DAY_SQL} AS own_day,
  regexp_matches(lower(q), 'lenient|easy\\s+make[- ]?up') AND regexp_matches(lower(q), 'make[- ]?up') AS lenient_makeup FROM asked)
SELECT customer, CASE WHEN kind IN (1, 2) THEN 'remote' ELSE 'deterministic' END AS provider, CASE WHEN kind > 2 THEN 'remote reply does not fit the schema' END AS warning,
  CASE WHEN kind = 1 THEN 'huel' ELSE own_category END AS category, CASE WHEN kind = 1 THEN 'Tue' ELSE own_day END AS free_day,
  CASE kind WHEN 1 THEN 'artificial intelligence robots' WHEN 2 THEN '' ELSE array_to_string(words, ' ') END AS keywords,
  {', '.join(f for f in preferences.FLAGS if f != 'open_book')}, open_book OR kind IN (1, 2) AS open_book, '{' > '.join(preferences.STEPS)}' AS steps FROM parsed""")
def json_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of every customer, merged with what a remote parser replied, and the trace of the answer."""
    k = F.col("c_custkey")
    asked = read(spark, sf_dir, "customer").select(
        k.alias("customer"), F.concat_ws(" ", "c_mktsegment", pick(PHRASES, k)).alias("query"),
        F.get(F.array(*map(F.lit, REPLIES)), (F.floor(k / len(PHRASES)) % len(REPLIES)).cast("int")).alias("reply"), F.lit(None).cast("string").alias("warning"),
    )
    rows = preferences.understood(asked).withColumn("agent", preferences.trace(F.col("provider"), F.col("warning")))
    return rows.select(
        "customer", F.col("agent.intent_provider").alias("provider"), F.col("agent.warning").alias("warning"), "preferences.category", "preferences.free_day",
        F.array_join("preferences.keywords", " ").alias("keywords"), *(f"preferences.{f}" for f in preferences.FLAGS), F.array_join("agent.steps.name", " > ").alias("steps"),
    )


#: Sentences of make-up policies; each policy holds those whose bits its key has set.
CLAUSES = [
    "No make-up for quizzes.", "Make-ups are granted in genuine cases!", "Prior permission of the instructor is needed.", "A medical certificate must be sent?",
    "Makeup tests will never be conducted.", "Bring a book.",
]
SAID = {"permitted_assessments": [1], "excluded_assessments": [0, 4], "approval_requirements": [2], "accepted_grounds": [1, 3], "documentation_requirements": [3]}


def stub(text: str) -> str:
    """A remote parser that answers by the length of the request: well, with too little, with no JSON, or not at all."""
    kind = len(text) % 6
    if kind == 1:
        raise urllib.error.HTTPError("http://stub", 400, "refused", None, None)
    if kind == 2:
        raise TimeoutError("timed out")
    return [reply(), None, None, "{not json", reply(category="null", keywords="[]"), reply(no_quiz=None)][kind]


@query(f"""
WITH asked AS (SELECT o_orderkey AS id, {listed(PHRASES)}[o_custkey % {len(PHRASES)} + 1] || ' ' || (o_custkey % 97) AS q FROM orders),
kinds AS (SELECT *, length(q) % 6 AS kind FROM asked)
SELECT id, CASE WHEN kind IN (0, 4) THEN 'remote' ELSE 'deterministic' END AS provider,
  CASE kind WHEN 1 THEN 'remote parser failed: HTTP Error 400: refused' WHEN 2 THEN 'remote parser failed: timed out' WHEN 3 THEN 'remote reply does not fit the schema' WHEN 5 THEN 'remote reply does not fit the schema' END AS warning,
  CASE WHEN kind = 0 THEN 'huel' ELSE {CATEGORY_SQL} END AS category FROM kinds""")
def remote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of every order, put to a remote parser once for each distinct text; failures are warnings of their rows."""
    requests = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", pick(PHRASES, F.col("o_custkey")), (F.col("o_custkey") % 97).cast("string")).alias("query"))
    rows = preferences.answered(requests, stub, pause=0.0)
    return rows.select("id", "provider", "warning", F.col("preferences.category").alias("category"))


@query("SELECT o_orderkey, " + ", ".join(
    f"nullif(concat_ws(' | ', {', '.join(f'CASE WHEN (o_orderkey >> {i}) & 1 = 1 THEN ' + listed([CLAUSES[i]]) + '[1] END' for i in held)}), '') AS {name}" for name, held in SAID.items()
) + " FROM orders")
def makeup_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a policy for every order, in the five lists that they speak of."""
    held = [F.when(F.shiftright("o_orderkey", i).bitwiseAND(F.lit(1)) == 1, F.lit(c)) for i, c in enumerate(CLAUSES)]
    found = read(spark, sf_dir, "orders").select("o_orderkey", handouts.makeup_conditions(F.concat_ws(" ", *held)).alias("m"))
    return found.select("o_orderkey", *(F.array_join(f"m.{name}", " | ").alias(name) for name in SAID))


@query(with_view("""
SELECT course, CASE WHEN course % 2 = 0 THEN 3 END AS project_row, CASE WHEN course % 7 = 0 THEN CASE WHEN course % 3 = 0 THEN 2 WHEN course % 2 = 0 THEN 3 END END AS open_book_row,
  course % 2 = 0 AS project_listed, course % 7 = 0 AND (course % 3 = 0 OR course % 2 = 0) AS open_book_listed, 'outline ' || course AS source_file
FROM courses WHERE course % 4 <> 0"""))
def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every outlined course, the first rows that support the claims of a project and of an open book."""
    facts = recommend.handout_facts(*outlines(academic.courses(spark, sf_dir)))
    return facts.select("course", "project_row", "open_book_row", "project_listed", "open_book_listed", "source_file")


@query("""
SELECT doc_id || '.pdf' AS source_file, CASE WHEN doc_id % 7 <> 3 THEN CAST(length(text) AS INT) END AS n_chars, CASE WHEN doc_id % 7 = 3 THEN 'UnicodeDecodeError' END AS error
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""")
def file_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a file for every document; those that cannot be decoded give their error, and the scan goes on."""
    broken = F.when(F.col("doc_id") % 7 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.concat(F.lit("folder/"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.concat(F.encode("text", "UTF-8"), broken).alias("content")
    )
    scanned = texts(files, decode=lambda content: content.decode())
    return scanned.select("source_file", F.length("text").alias("n_chars"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))
