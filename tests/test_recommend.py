"""The recommendation fixture: two courses, one outline, several requests."""

import json

import pytest
from pyspark.sql import functions as F

from almanac.operators import policy, query, recommend, requirements


#: student -> (query, completed, current, registered units)
ASKED = {
    "category": ("Suggest machine learning DELs with no midsem", ["CS F111"], [], 0),
    "words": ("Suggest AI courses", ["CS F111"], [], 0),
    "no quiz": ("suggest no quizzes AI DEL", ["CS F111"], [], 0),
    "lenient": ("AI with lenient make-up", ["CS F111"], [], 0),
    "prerequisite": ("AI", [], [], 0),
    "units": ("AI", ["CS F111"], [], 24),  # 27 > 25
    "done": ("AI", ["CS F111", "CS F301"], [], 0),
    "exam": ("AI", ["CS F111"], ["CS F111"], 0),  # the current course's exam is in the same slot
    "monday": ("AI, Mondays free", ["CS F111"], [], 0),
    "tuesday": ("AI, Tuesdays free", ["CS F111"], [], 0),
    "anything": ("", ["CS F111", "CS F211"], [], 0),
}


def tables(spark, asked=ASKED, components=(), sums=True, has_midsem=False):
    def of(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    students = of([(s, "COMPUTER SCIENCE", "first_degree", 2025, a[3], []) for s, a in asked.items()], "student string, programme string, degree_level string, admission_year int, existing_units int, interests array<string>")
    catalogue = of([("CS F301", "Machine Learning", 3, "CS F111", ["CS F111"]), ("CS F302", "Deep Learning", 3, "CS F211", ["CS F211"])], "course string, title string, units int, prerequisite_expression string, needs array<string>")
    exam = "struct<date:string,session:string>"
    offerings = of([("CS F301", 1001, "MACHINE LEARNING", 3, False, False, ("09/10", "AN1"), None, 1), ("CS F302", 1002, "DEEP LEARNING", 3, False, False, None, None, 2), ("CS F111", 1003, "PROGRAMMING", 3, False, False, ("09/10", "AN1"), None, 3)],
        f"course string, computer_code int, title string, u int, cancelled boolean, restricted boolean, midsem {exam}, compre {exam}, ordinal int")
    sections = of([("CS F301", "L1", "A1", "M W F 2", 1), ("CS F302", "L1", "A2", "T Th 3", 2)], "course string, section string, room string, meeting_text string, ordinal int")
    handouts = of([("d", 1, ["CS F301"], "artificial intelligence", None, [], False, has_midsem, True, None, sums, "extracted_unverified", "cs.pdf")],
        "doc_id string, ordinal int, course_codes array<string>, description string, scope string, topics array<string>, attendance_required boolean, has_midsem boolean, has_compre boolean, makeup_policy string, sums_to_100 boolean, extraction_status string, source_file string")
    parts = of(components, "doc_id string, row_number int, name string, type string, weight double, marks double, count int, book_policy string, raw_text string")
    categories = of([("COMPUTER SCIENCE", "DEL", "CS F301")], "programme string, category string, course string")
    humanities = of([], "course string")
    done, now = (of([(s, c) for s, a in asked.items() for c in a[k]], "student string, course string") for k in (1, 2))
    return {
        "students": students, "completed": done, "current": now, "catalogue": catalogue, "offerings": offerings, "sections": sections, "groups": of([], "group string, course string"),
        "categories": categories, "humanities": humanities, "facts": recommend.handout_facts(handouts, parts), "progress": requirements.progress(students, categories, humanities, done.unionByName(now)),
    }


def ask(spark, asked=ASKED, **options):
    requests = spark.createDataFrame([(s, a[0]) for s, a in asked.items()], "student string, query string").withColumn("p", query.preferences(F.col("query")))
    top, unknown = recommend.recommend(tables(spark, asked, **options), requests)
    rows = {s: [] for s in asked}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        rows[r["student"]].append(r)
    return rows, {(r["student"], r["label"]): r["n"] for r in unknown.collect()}


@pytest.fixture(scope="module")
def answers(spark):
    return ask(spark)


def test_category_and_evidence(answers):
    r = answers[0]["category"][0]
    assert r["course"] == "CS F301" and r["title"] == "Machine Learning" and r["requirement"] == "DEL" and r["eligible_candidates"] == 1
    assert "verified DEL for COMPUTER SCIENCE" in r["eligibility"]
    assert r["score"] == pytest.approx(10 + 6 + 2 + 0.18)
    assert {c["claim"] for c in r["claims"]} == {"no mid-semester exam is explicitly supported", "a clash-free listed section is available"}
    assert [s["section"] for s in r["sections"]] == ["L1"]


def test_filters(answers):
    courses = {s: [r["course"] for r in rows] for s, rows in answers[0].items()}
    assert courses == {
        "category": ["CS F301"], "words": ["CS F301"], "no quiz": ["CS F301"], "lenient": [], "prerequisite": [], "units": [], "done": [], "exam": [], "monday": [], "tuesday": ["CS F301"], "anything": ["CS F301", "CS F302"],
    }
    assert answers[0]["words"][0]["matches"][0] == "matches artificial, intelligence"
    assert answers[0]["anything"][0]["score"] == pytest.approx(1 + 2 + 0.18)
    assert answers[1] == {("lenient", "makeup-policy leniency"): 1}


def test_unknown_facts_are_counted_and_reject(spark):
    asked = {s: ASKED[s] for s in ("category", "no quiz")}
    rows, unknown = ask(spark, asked, sums=False, has_midsem=None)
    assert rows == {"category": [], "no quiz": []}
    assert unknown == {("category", "no mid-semester exam"): 1, ("no quiz", "quiz-free evaluation"): 1}


def test_a_listed_quiz_rejects(spark):
    quiz = [("d", 1, "Quiz", "quiz", 10.0, None, None, None, "Quiz 10")]
    assert ask(spark, {"no quiz": ASKED["no quiz"]}, components=quiz) == ({"no quiz": []}, {})


def test_limits():
    assert [recommend.limited(n) for n in (-1, 0, 8, 99)] == [1, 1, 8, 25]


def test_progress(spark):
    asked = {"s": ("", ["CS F301"], [], 0)}
    rows = {r["category"]: r for r in tables(spark, asked)["progress"].collect()}
    assert (rows["DEL"]["total"], rows["DEL"]["completed"], rows["DEL"]["remaining"]) == (4, 1, 3)
    profile = spark.createDataFrame([("s", {"CDC": 4}, {"CDC": 6})], "student string, requirement_totals map<string,int>, requirement_completed map<string,int>")
    assert {r["category"]: r["remaining"] for r in requirements.profile_remaining(profile).collect()}["CDC"] == 0


def test_findings(spark):
    students = spark.createDataFrame([("s", "first_degree", 2025, 0)], "student string, degree_level string, admission_year int, existing_units int")
    planned = spark.createDataFrame([("s", "CS F211", 6000, 30)], "student string, course string, computer_code int, units int")
    catalogue = spark.createDataFrame([("CS F211", "CS F111", ["CS F111"])], "course string, prerequisite_expression string, needs array<string>")
    offerings = spark.createDataFrame([("CS F211", 6000, False, True, 1)], "course string, computer_code int, cancelled boolean, restricted boolean, ordinal int")
    done = spark.createDataFrame([("s", "CS F111")], "student string, course string")
    got = policy.findings(students, planned, catalogue, offerings, done).collect()
    assert {r["rule"] for r in got} == {"semester_unit_limit", "admission_year_restriction"}


def test_remote_parser(spark):
    reply = {"category": "del", "keywords": ["AI"], "free_day": None} | {f: False for f in query.FLAGS}
    row = query.understand(spark, "Suggest ML with no midsem", lambda q: json.dumps(reply)).first()
    assert row["provider"] == "remote" and row["preferences"]["category"] == "del" and row["preferences"]["no_midsem"]
    assert row["preferences"]["keywords"] == ["artificial", "intelligence"]

    def fails(q):
        raise TimeoutError("late")

    row = query.understand(spark, "Suggest ML with no midsem", fails).first()
    assert row["provider"] == "deterministic" and "late" in row["warning"]
    row = query.understand(spark, "AI", lambda q: json.dumps(reply | {"category": "xyz"})).first()
    assert row["provider"] == "deterministic" and row["warning"]
