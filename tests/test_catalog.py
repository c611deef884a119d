"""Academic documents as small inline pages: expected facts only."""

from almanac.operators import catalog
from almanac.sources.ingest import lines_of


def lines(spark, text, name="x.pdf"):
    df = spark.createDataFrame([(name, text)], "source_document string, text string")
    return lines_of(df, "source_document")


def test_clauses(spark):
    text = "preface\nUnits are limited     1.01\nto twenty-five.\n17\n\fmore of it\nSecond rule     1.03a\nend"
    rows = catalog.clauses(lines(spark, text)).orderBy("ordinal").collect()
    assert [(r["clause_id"], r["pages"], r["text"]) for r in rows] == [
        ("1.01", [1, 2], "Units are limited to twenty-five. more of it"), ("1.03a", [2], "Second rule end"),
    ]


def test_catalogue(spark):
    text = (
        "CS F111 Computer Programming   4\n"
        "CS F211 Data Structures   4   CS F111 Programming   3\n"
        "Pre-requisite: MATH F111\n"
        "\f"
        "Course Descriptions                              \n"
        "CS F301 Compilers     3                 CS F302 Networks    3\n"
        "Prerequisite: CS F211                   CS F111 nothing\n"
        "and CS F111\n"
        "CS F301 Compilers   3\n"
    )
    rows = {r["course"]: r for r in catalog.catalogue(lines(spark, text)).collect()}
    assert rows["CS F111"]["title"] == "Computer Programming" and rows["CS F111"]["units"] == 4
    assert rows["CS F211"]["prerequisite_expression"] == "MATH F111" and rows["CS F211"]["needs"] == ["MATH F111"]
    assert rows["CS F301"]["needs"] == ["CS F211", "CS F111"]
    assert rows["CS F301"]["sources"][-1]["section"] == "course description prerequisite"


def test_programme_categories(spark):
    left = [
        "List of Courses for B.E. / M.Sc. / B.Pharm.", "COMPUTER SCIENCE", "CORE COURSES", "CS F111 Programming", "CS F111 again", "DISCIPLINE ELECTIVE COURSES", "CS F407 AI",
        "Project Type Courses", "CS F491 Special", "PHYSICS", "CORE COURSES", "PHY F211 Mechanics", "Pool of Humanities courses for first degree programmes", "HSS F266 Reading", "Other Courses", "HSS F999 Not in pool",
    ]
    text = "\n".join(x.ljust(60) + "." * 60 for x in left)
    categories, pool = catalog.programme_categories(lines(spark, text))
    assert {(r["programme"], r["category"], r["course"]) for r in categories.collect()} == {
        ("COMPUTER SCIENCE", "CDC", "CS F111"), ("COMPUTER SCIENCE", "DEL", "CS F407"), ("PHYSICS", "CDC", "PHY F211"),
    }
    assert [r["course"] for r in pool.collect()] == ["HSS F266"]


def test_timetable(spark):
    text = (
        "1001 AN F314  AERODYNAMICS II   2 - 1 - 3  L1   A PERSON 5101 M W F 2   09/10 AN1  01/12 FN\n"
        + " " * 72 + "T1  B PERSON 1204 Th 3  CANCELLED\n"
        + "6001 BIO F101  LAB   - 1 - - 1  P1   CANCLED\n"
    )
    offerings, sections = catalog.timetable(lines(spark, text))
    rows = {r["course"]: r for r in offerings.collect()}
    a, b = rows["AN F314"], rows["BIO F101"]
    assert a["credits"]["u"] == 3 and a["midsem"]["date"] == "09/10" and a["midsem"]["session"] == "AN1" and a["compre"]["session"] == "FN"
    assert a["room"] == "5101" and a["meeting_text"].startswith("M W F 2") and not a["cancelled"] and not a["restricted"]
    assert b["cancelled"] and b["restricted"] and b["section"] == "P1"
    more = [r for r in sections.collect() if r["section"] == "T1"][0]
    assert more["course"] == "AN F314" and more["cancelled"] and more["room"] == "1204"


def test_registration_rules_and_equivalences(spark):
    text = "INSTRUCTIONS REGARDING REGISTRATION\n1. First rule\n   goes on\n2. At most a maximum of four\nVIII. Other\n3. Not this"
    rows = catalog.registration_rules(lines(spark, text)).orderBy("rule_id").collect()
    assert [r["text"] for r in rows] == ["First rule goes on", "At most a maximum of four"]
    text = "CS F000 and CS F001\fIX. LIST OF EQUIVALENT COURSES\nCS G527  SS G527  CS G527\nCS G528\fX. Library\nCS G1 CS G999 CS G998"
    groups = catalog.equivalence_groups(lines(spark, text)).collect()
    assert [g["equivalent_courses"] for g in groups] == [["CS G527", "SS G527"]]


def test_build_counts_tables(spark):
    tables = catalog.build(lines(spark, "CS F111 Computer Programming   4"), lines(spark, "rule   1.01\nx"), lines(spark, "1001 CS F111  COMPUTER PROGRAMMING I   3 - - - 3  L1   M 2"))
    counts = {r["what"]: r["n"] for r in tables["report"].collect()}
    assert counts["catalogue"] == counts["regulation_clauses"] == counts["machine_rules"] == counts["offerings"] == 1
    assert tables["catalogue"].first()["title"] == "COMPUTER PROGRAMMING I"
