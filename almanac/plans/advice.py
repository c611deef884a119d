"""The whole recommender over the academic view: every student asks, with keywords and a preference, or for nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import fixed
from almanac.operators import query as preferences
from almanac.operators import recommend, requirements
from almanac.plans import academic
from almanac.plans.academic import with_view
from almanac.plans.textual import CATEGORY_SQL, DAY_SQL, FLAG_SQL, token_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Courses lie in so many zones, which stand for narrow topics.
ZONES = 61
PHRASES = [
    "", "no midsem", "without any quizzes", "open-book", "Fridays free and no 8 am classes", "DELs", "high project weight", "no attendance", "a small midsem", "fewer quizzes", "low exam weight",
    "without compre", "with projects", "project-based HUELs", "a make-up", "a lenient make-up", "CDCs, Mondays free", "OPELs", "no midsem and no quizzes and open-book",
]
#: Students whose number it divides ask for nothing and have no interests: they get every course.
ASKS_NOTHING = 97
INTERESTS = ["economy", "promo", "widget", "large"]
MEETING_DAYS = ["M", "T", "W", "Th", "F", "S", "Su"]


def outlines(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outline records and components of three of four courses, by rules on the course's number."""
    c = F.col("course")
    some = courses.where("course % 4 <> 0")
    none = F.lit(None)
    records = some.select(
        c.alias("doc_id"), c.alias("ordinal"), F.array(c).alias("course_codes"), F.lower("kind").alias("description"), F.concat(F.lit("zone"), c % ZONES).alias("scope"), F.array().cast("array<string>").alias("topics"),
        F.when(c % 7 > 2, c % 2 == 0).alias("attendance_required"), F.when(c % 5 > 0, c % 5 > 2).alias("has_midsem"), F.when(c % 11 > 2, c % 11 > 5).alias("has_compre"),
        F.when(c % 3 == 0, "Make-ups are given for cause.").when(c % 3 == 1, "").alias("makeup_policy"),
        (c % 2 == 0).alias("sums_to_100"), F.when(c % 13 == 0, "partial").otherwise("extracted_unverified").alias("extraction_status"), F.concat(F.lit("outline "), c).alias("source_file"),
    )

    def row(n: int, name: str, kind: str, weight, book, count=F.lit(1)):
        return F.struct(F.lit(n).alias("row_number"), F.lit(name).alias("name"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"), none.cast("double").alias("marks"), count.cast("int").alias("count"), book.alias("book_policy"), F.lit(name).alias("raw_text"))

    closed, opened = F.lit("closed"), F.when(c % 7 == 0, "open")
    parts = F.array_compact(F.array(row(1, "Mid-Semester Test", "midsem", 10 + c % 31, closed), F.when(c % 3 == 0, row(2, "Quizzes", "quiz", F.lit(20), opened, 1 + F.floor(c / 3) % 3)), F.when(c % 2 == 0, row(3, "Project work", "project", c % 45, opened))))
    return records, some.select(c.alias("doc_id"), F.inline(parts))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = academic
    courses, offerings, enrolment = v.courses(spark, sf_dir), v.offerings(spark, sf_dir), v.enrolment(spark, sf_dir)
    needs = v.prerequisites(spark, sf_dir).groupBy("course").agg(F.collect_set("needs").alias("needs"))
    days = F.array(*map(F.lit, MEETING_DAYS))
    meetings = F.array_join(F.transform(F.sort_array(F.collect_set("slot")), lambda s: F.concat_ws(" ", F.get(days, s["day"]), s["period"])), " ")
    one = F.get(F.array(*map(F.lit, INTERESTS)), (F.col("student") % len(INTERESTS)).cast("int"))
    students = v.students(spark, sf_dir).withColumn("interests", F.when(F.col("student") % ASKS_NOTHING > 0, F.array(one)).otherwise(F.array().cast("array<string>")))
    timed = (F.col("course") % 2 > 0) | (F.col("computer_code") % 4 > 0)  # the other sections have no time yet
    done, now = (enrolment.where(F.col("status") == s).select("student", "course") for s in ("completed", "current"))
    taken = enrolment.select("student", "course")
    categories, humanities = v.categories(spark, sf_dir), v.humanities(spark, sf_dir)
    return {
        "students": students, "completed": done, "current": now, "groups": v.equivalents(spark, sf_dir), "categories": categories, "humanities": humanities,
        "catalogue": courses.join(needs, "course", "left").withColumn("prerequisite_expression", F.when(F.col("course") % 7 == 1, "by consent")),
        "offerings": offerings.join(courses.select("course", F.col("units").alias("u")), "course").withColumn("title", F.lit(None).cast("string")),
        "sections": offerings.groupBy("course", "computer_code").agg(F.when(timed, meetings).alias("meeting_text")).select("course", F.col("computer_code").cast("string").alias("section"), F.lit(None).cast("string").alias("room"), "meeting_text", F.col("computer_code").alias("ordinal")),
        "facts": recommend.handout_facts(*outlines(courses)),
        "progress": requirements.progress(students, categories, humanities, taken, required=F.lit(4)),
    }


PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
ANSWER_SQL = with_view(f""",
asked AS (SELECT *, CASE WHEN student % {ASKS_NOTHING} = 0 THEN '' ELSE 'zone' || (student % {ZONES}) || ' ' || {PHRASE_SQL}[student % {len(PHRASES)} + 1] END AS q,
  CASE WHEN student % {ASKS_NOTHING} = 0 THEN [] ELSE [{INTERESTS}[student % {len(INTERESTS)} + 1]] END AS interests FROM students),
wants AS (SELECT *, {token_sql('q')} AS keywords, {FLAG_SQL}, regexp_matches(lower(q), '{fixed.LENIENT}') AND regexp_matches(lower(q), 'make[- ]?up') AS lenient_makeup, {CATEGORY_SQL} AS category, {DAY_SQL} AS free_day FROM asked),
described AS (SELECT *, {token_sql('title')} AS title_tokens, CASE WHEN course % 4 <> 0 THEN {token_sql(f"title || ' ' || kind || ' zone' || (course % {ZONES})")} ELSE {token_sql('title')} END AS tokens FROM courses),
first_open AS (SELECT * FROM offerings WHERE NOT cancelled QUALIFY row_number() OVER (PARTITION BY course ORDER BY ordinal) = 1),
open_now AS (SELECT course, bool_and(restricted) AS all_restricted FROM offerings WHERE NOT cancelled GROUP BY course),
listed AS (SELECT d.*, f.computer_code, f.exam_date, f.exam_session, f.restricted, o.all_restricted FROM described d JOIN first_open f USING (course) JOIN open_now o USING (course)
  WHERE NOT (course % 7 = 1 AND course % 3 <> 0 AND course % 5 <> 0)),
words AS (SELECT course, unnest(tokens) AS word FROM listed),
pairs AS (SELECT DISTINCT student, course FROM (SELECT student, unnest(keywords) AS word FROM wants) AS k JOIN words USING (word)
  UNION ALL SELECT student, course FROM wants, listed WHERE len(keywords) = 0),
busy AS (SELECT DISTINCT student, exam_date, exam_session FROM current_courses JOIN offerings USING (course)),
missing AS (SELECT DISTINCT p.student, p.course FROM pairs p JOIN prereq q USING (course) WHERE NOT EXISTS (SELECT 1 FROM completed d WHERE d.student = p.student AND d.course = q.needs)),
equivalent AS (SELECT DISTINCT d.student, e2.course FROM completed d JOIN equivalents e1 USING (course) JOIN equivalents e2 ON e1.grp = e2.grp AND e1.course <> e2.course),
electives_done AS (SELECT s.student, count(DISTINCT g.course) AS n FROM students s JOIN taken t USING (student) JOIN categories g ON g.programme = s.programme AND g.course = t.course AND g.category = 'DEL' GROUP BY s.student),
humanities_done AS (SELECT student, count(DISTINCT course) AS n FROM taken JOIN humanities USING (course) GROUP BY student),
kinds AS (
  SELECT p.student, p.course, EXISTS (SELECT 1 FROM categories g WHERE g.programme = s.programme AND g.course = p.course AND g.category = 'CDC') AS is_cdc,
    EXISTS (SELECT 1 FROM categories g WHERE g.programme = s.programme AND g.course = p.course AND g.category = 'DEL') AS is_del,
    p.course IN (SELECT course FROM humanities) AS is_huel, coalesce(e.n, 0) < 4 AS del_due, coalesce(h.n, 0) < {fixed.HUMANITIES_REQUIRED} AS huel_due
  FROM pairs p JOIN students s USING (student) LEFT JOIN electives_done e USING (student) LEFT JOIN humanities_done h USING (student)),
able AS (
  SELECT p.student, p.course FROM kinds p JOIN wants w USING (student) JOIN listed c USING (course)
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.student = p.student AND t.course = p.course) AND NOT EXISTS (SELECT 1 FROM missing m WHERE m.student = p.student AND m.course = p.course)
    AND NOT EXISTS (SELECT 1 FROM equivalent e WHERE e.student = p.student AND e.course = p.course)
    AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.student = p.student AND b.exam_date = c.exam_date AND b.exam_session = c.exam_session)
    AND (NOT (c.all_restricted OR c.restricted) OR w.admission_year = 2026) AND w.existing_units + c.units <= CASE WHEN w.degree_level = 'first_degree' THEN 25 ELSE 20 END
    AND CASE w.category WHEN 'cdc' THEN is_cdc WHEN 'del' THEN is_del WHEN 'huel' THEN is_huel WHEN 'opel' THEN NOT (is_cdc OR is_del AND del_due OR is_huel AND huel_due) ELSE true END),
timed AS (SELECT *, course % 2 > 0 OR computer_code % 4 > 0 AS has_time FROM offerings),
occupied AS (SELECT student, list(DISTINCT day * 100 + period) AS held FROM current_courses JOIN timed USING (course) WHERE has_time GROUP BY student),
slots AS (SELECT course, computer_code AS section, has_time, list(DISTINCT day * 100 + period) AS slots, list(DISTINCT day) AS days, bool_or(period = 1) AS early FROM timed GROUP BY ALL),
placed AS (SELECT a.student, a.course, section, NOT has_time OR NOT coalesce(list_has_any(slots, held), false) AND NOT coalesce(list_contains(days, list_position({fixed.WEEKDAYS}, free_day) - 1), false) AND NOT (w.no_early_classes AND early) AS feasible
  FROM able a JOIN wants w USING (student) JOIN slots USING (course) LEFT JOIN occupied USING (student)),
fitting AS (SELECT student, course, count(*) FILTER (WHERE feasible) AS n_feasible, array_to_string(list(section ORDER BY section) FILTER (WHERE feasible)[1:4], ' ') AS sections FROM placed GROUP BY student, course),
judged AS (
  SELECT w.*, c.course, c.title, c.units, c.computer_code, n_feasible, sections, list_distinct(list_concat(w.keywords, w.interests)) AS wanted, title_tokens, tokens, course % 4 <> 0 AS outlined,
    CASE WHEN course % 4 <> 0 AND course % 7 > 2 THEN course % 2 = 0 END AS attendance, CASE WHEN course % 4 <> 0 AND course % 5 > 0 THEN course % 5 > 2 END AS midsem, CASE WHEN course % 4 <> 0 AND course % 11 > 2 THEN course % 11 > 5 END AS compre,
    course % 4 <> 0 AND course % 2 = 0 AS whole, course % 4 <> 0 AND course % 3 = 0 AS quiz_seen, course % 4 <> 0 AND course % 3 = 0 AS has_policy, 10 + course % 31 AS midsem_weight, CASE WHEN course % 3 = 0 THEN 1 + course // 3 % 3 ELSE 0 END AS quizzes,
    course % 4 <> 0 AND course % 7 = 0 AND (course % 3 = 0 OR course % 2 = 0) AS opens, course % 4 <> 0 AND course % 2 = 0 AS projects, CASE WHEN course % 4 <> 0 AND course % 2 = 0 THEN course % 45 ELSE 0 END AS project, 'outline ' || course AS source
  FROM fitting JOIN wants w USING (student) JOIN listed c USING (course))""")
SQL = ANSWER_SQL + f""",
scored AS (
  SELECT *, 5.0::DOUBLE * len(list_intersect(wanted, title_tokens)) + 3.0 * len(list_filter(list_intersect(wanted, tokens), lambda x: NOT list_contains(title_tokens, x)))
    + 6 * (no_attendance::INT + no_midsem::INT + no_compre::INT + no_quiz::INT) + 5 * project_based::INT + 4 * open_book::INT + (makeup_requested AND has_policy)::INT
    + CASE WHEN low_midsem THEN (40 - midsem_weight) / 4 ELSE 0 END + CASE WHEN fewer_quizzes THEN 5 - quizzes ELSE 0 END + CASE WHEN high_project_weight THEN project / 5 ELSE 0 END + CASE WHEN low_exam_weight THEN (100 - midsem_weight) / 10 ELSE 0 END
    + (len(wanted) = 0 AND NOT (no_attendance OR no_quiz OR no_midsem OR no_compre OR project_based OR open_book))::INT + 2 + ln(6::DOUBLE) / 10 AS points,
    list_sort(list_intersect(wanted, tokens))[1:5] AS hits
  FROM judged WHERE n_feasible > 0 AND NOT lenient_makeup AND (NOT no_attendance OR coalesce(NOT attendance, false)) AND (NOT no_midsem OR coalesce(NOT midsem, false)) AND (NOT no_compre OR coalesce(NOT compre, false))
    AND (NOT no_quiz OR NOT quiz_seen AND whole AND course % 13 <> 0) AND (NOT low_midsem OR outlined) AND (NOT fewer_quizzes OR whole) AND (NOT low_exam_weight OR outlined)
    AND (NOT open_book OR opens) AND (NOT project_based OR projects) AND (NOT high_project_weight OR project > 0)),
ranked AS (SELECT *, round(points, 2) AS score, count(*) OVER (PARTITION BY student) AS eligible_candidates FROM scored)
SELECT student, course, array_to_string(list_transform(string_split(title, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, units, computer_code, score, sections, eligible_candidates,
  CAST(row_number() OVER (PARTITION BY student ORDER BY score DESC, course) AS INT) AS rank, upper(category) AS requirement,
  concat_ws('; ', 'offered this semester', CASE WHEN course % 3 = 0 OR course % 5 = 0 THEN 'explicit prerequisites completed' END, 'verified ' || upper(category) || ' for ' || programme) AS eligibility,
  concat_ws('; ', CASE WHEN len(hits) > 0 THEN 'matches ' || array_to_string(hits, ', ') END, CASE WHEN no_attendance THEN 'no attendance requirement is explicitly supported' END, CASE WHEN no_midsem THEN 'no mid-semester exam is explicitly supported' END,
    CASE WHEN no_compre THEN 'no comprehensive exam is explicitly supported' END, CASE WHEN low_midsem THEN 'midsem weight is ' || midsem_weight || '%' END,
    CASE WHEN fewer_quizzes THEN quizzes || ' listed quiz component' || CASE WHEN quizzes = 1 THEN '' ELSE 's' END END, CASE WHEN high_project_weight THEN 'project weight is ' || project || '%' END,
    CASE WHEN low_exam_weight THEN 'listed exam weight is ' || midsem_weight || '%' END, CASE WHEN no_quiz THEN 'no quiz component is listed in the complete evaluation scheme' END, CASE WHEN project_based THEN 'project evaluation is listed' END,
    CASE WHEN open_book THEN 'an open-book component is listed' END, CASE WHEN makeup_requested AND has_policy THEN 'make-up policy text is available for review' END, 'a clash-free listed section is available') AS matches,
  concat_ws('; ', CASE WHEN no_attendance THEN 'no attendance requirement is explicitly supported [' || source || '#attendance_required]' END, CASE WHEN no_midsem THEN 'no mid-semester exam is explicitly supported [' || source || '#has_midsem]' END,
    CASE WHEN no_compre THEN 'no comprehensive exam is explicitly supported [' || source || '#has_compre]' END, CASE WHEN no_quiz THEN 'no quiz component is listed in the complete evaluation scheme [' || source || '#evaluation_components]' END,
    CASE WHEN project_based THEN 'project evaluation is listed [' || source || '#row 3]' END, CASE WHEN open_book THEN 'an open-book component is listed [' || source || '#row ' || CASE WHEN course % 3 = 0 THEN 2 ELSE 3 END || ']' END,
    'a clash-free listed section is available [timetable]') AS claims,
  CASE WHEN makeup_requested AND NOT has_policy THEN 'make-up policy' ELSE '' END AS manual_review
FROM ranked QUALIFY rank <= {fixed.DEFAULT_RESULTS}"""
UNKNOWN_SQL = ANSWER_SQL + """
SELECT student, label, count(*) AS n FROM (
  SELECT student, unnest([CASE WHEN no_attendance AND attendance IS NULL THEN 'no attendance requirement' END, CASE WHEN no_midsem AND midsem IS NULL THEN 'no mid-semester exam' END, CASE WHEN no_compre AND compre IS NULL THEN 'no comprehensive exam' END,
    CASE WHEN lenient_makeup THEN 'makeup-policy leniency' END, CASE WHEN no_quiz AND NOT quiz_seen AND NOT (whole AND course % 13 <> 0) THEN 'quiz-free evaluation' END]) AS label FROM judged) AS u
WHERE label IS NOT NULL GROUP BY student, label"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The recommender's tables and a request of every student."""
    s = F.col("student")
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (s % len(PHRASES)).cast("int"))
    words = F.when(s % ASKS_NOTHING > 0, F.concat(F.lit("zone"), s % ZONES, F.lit(" "), phrase)).otherwise("")
    requests = academic.students(spark, sf_dir).select("student", words.alias("query"))
    return recommend.prepared(tables(spark, sf_dir), requests.withColumn("p", preferences.preferences(F.col("query"))))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that an answer holds: rank and score, sections, the number before the limit, and the evidence of every preference."""
    best = recommend.best(*asked(spark, sf_dir), tasks=academic.tasks(spark, sf_dir))
    said = F.transform("claims", lambda c: F.concat(c["claim"], F.lit(" ["), c["source"], F.lit("]")))
    return best.select(
        "student", "course", "title", "units", "computer_code", "score", F.array_join("sections.section", " ").alias("sections"), "eligible_candidates", "rank", "requirement",
        F.array_join("eligibility", "; ").alias("eligibility"), F.array_join("matches", "; ").alias("matches"), F.array_join(said, "; ").alias("claims"), F.array_join("manual_review", "; ").alias("manual_review"),
    )


def recommendation_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every student, how many candidates lack each fact that the request asks about."""
    return recommend.unknown_facts(*asked(spark, sf_dir), tasks=academic.tasks(spark, sf_dir))


QUERIES |= {"recommendations": recommendations, "recommendation_unknowns": recommendation_unknowns}
ORACLE_SQL |= {"recommendations": SQL, "recommendation_unknowns": UNKNOWN_SQL}
