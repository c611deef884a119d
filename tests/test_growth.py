"""What must not grow with the tables: what is broadcast through the driver, and what each row carries."""

from __future__ import annotations

import re

import pytest

from almanac.operators import handouts

OUTLINE = "Course No. : CS F111\nCourse Title : Logic\nInstructor : Dr. A\n3. Evaluation Scheme:\nComponent                Duration     Weightage     Remarks\nQuiz                     30 min           40         Closed\nProject                  -                60         Open\n4. Attendance Policy: Attendance is optional.\n"


def test_tables_of_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"{i}_outline.pdf", OUTLINE) for i in range(20)], "doc_id long, file_name string, text string")
    records, components, _ = handouts.parse(docs)
    assert records.count() == 20 and components.count() == 40
    for df, phrases in ((records, 1), (components, 0)):  # the list of topics is short and goes to every executor
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= phrases, plan


def test_words_are_parted_once_a_text(spark):
    """A text of many words costs its length, not its square."""
    import time

    text = "the test is written in class " * 3000 + "no midsem"
    df = spark.createDataFrame([(text,)], "text string")
    start = time.time()
    assert df.select(handouts.denied("midsem", df["text"]).alias("d")).first()["d"]
    assert time.time() - start < 20


def test_sections_are_counted_without_a_row_for_each(spark):
    from pyspark.sql import functions as F

    from almanac.operators import schedule

    offerings = spark.createDataFrame([(c, s, (s % 7, 1 + s % 6)) for c in (1, 2, 3) for s in range(40)], "course long, computer_code long, slot struct<day:int,period:int>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "student long, course long")
    current = spark.createDataFrame([(1, 9)], "student long, course long")
    held = offerings.unionByName(spark.createDataFrame([(9, 1, (0, 2)), (9, 2, (2, 3))], offerings.schema))
    got = schedule.feasible_counts(pairs, held, current, F.col("slot.day") == 4)
    busy = {1: {(0, 2), (2, 3)}, 2: set()}
    free = {s: sum(x % 7 != 4 and (x % 7, 1 + x % 6) not in busy[s] for x in range(40)) for s in busy}
    assert sorted(map(tuple, got.collect())) == [(1, 1, 40, free[1]), (1, 2, 40, free[1]), (2, 3, 40, free[2])]
    assert "occupied" not in got.columns and "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_exam_slots_of_a_student_are_a_few_words(spark):
    from almanac.operators import schedule

    exam = "struct<date:string,session:string>"
    rows = [(c, (f"{d:02}/05", "AN"), None) for c in (1, 2) for d in range(100)] + [(3, ("07/05", "AN"), ("08/09", None)), (4, ("01/08", None), None), (5, None, ("08/09", None))]
    offerings = spark.createDataFrame(rows, f"course long, midsem {exam}, compre {exam}")
    exams = schedule.Exams(offerings.where("course > 2"), spark.createDataFrame([(1, 1), (2, 3)], "student long, course long"), offerings)
    pairs = spark.createDataFrame([(s, c) for s in (1, 2, 3) for c in (3, 4, 5, 6)], "student long, course long")
    assert sorted(map(tuple, exams.without_clash(pairs).collect())) == [(1, 4), (1, 5), (1, 6), (2, 4), (2, 6), (3, 3), (3, 4), (3, 5), (3, 6)]
    assert len(exams.busy.schema["busy"].dataType) == 1 + 2  # 102 slots


def test_letters_of_a_text_cost_no_matrix_each(monkeypatch):
    from almanac.plans import papers
    from almanac.sources import pdf

    calls, whole = [], pdf.times
    monkeypatch.setattr(pdf, "times", lambda a, b: calls.append(1) or whole(a, b))
    assert len(pdf.words(papers.made(["#1\n" + "word " * 1000]).encode())) == 1001
    assert len(calls) < 20


def test_failures_equal_those_of_documents(spark):
    from almanac.plans import papers
    from almanac.sources import ingest

    files = spark.createDataFrame([("a", bytearray(papers.made(["one"]).encode())), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    assert sorted(ingest.failures(files).collect()) == sorted(ingest.documents(files).select("path", "error").collect())


def test_sections_of_a_request_are_one_row(spark):
    """A pair meets its course's sections as one row; free days, first periods and held slots are bits, and untimed sections always fit."""
    from pyspark.sql import functions as F

    from almanac.operators import schedule

    texts = [None, "M 1", "M 2", "T 3", "F 4", "W 1 2", "Th 5"]
    sections = [(1, f"s{i}", None, texts[i % 7], i) for i in range(21)] + [(2, "a", None, None, 1), (9, "z", None, "T 3 Th 5", 1), (9, "y", None, None, 2)]
    current = spark.createDataFrame([(1, 9), (2, 2)], "student long, course long")
    meetings = schedule.Meetings(spark.createDataFrame(sections, "course long, section string, room string, meeting_text string, ordinal int"), current)
    rows = spark.createDataFrame([(1, 1, None, False), (2, 1, "Mon", False), (3, 1, "Fri", True), (3, 2, None, True), (3, 5, None, True)], "student long, course long, day string, early boolean")
    fitting = meetings.fitting(rows, F.col("day"), F.col("early"))
    got = {(r["student"], r["course"]): (r["n_feasible"], r["n_timed"], r["sections"] and [s["ordinal"] for s in r["sections"]]) for r in fitting.collect()}
    assert got == {(1, 1): (15, 18, [0, 1, 2, 4]), (2, 1): (15, 18, [0, 3, 4, 5]), (3, 1): (12, 18, [0, 2, 3, 6]), (3, 2): (1, 0, [1]), (3, 5): (0, 0, None)}


def test_unknown_facts_pair_no_request_that_asks_for_none(spark, sf_dir):
    from almanac.operators import recommend
    from almanac.plans import advice

    tables, asked = advice.asked(spark, sf_dir)
    quiet = asked.where("NOT (p.no_attendance OR p.no_midsem OR p.no_compre OR p.no_quiz OR p.lenient_makeup)")
    assert quiet.count() > 0 and recommend.unknown_facts(tables | {"sections": None}, quiet).isEmpty()


def test_a_row_of_a_timetable_is_parted_by_one_search(spark):
    from pyspark.sql import functions as F

    from almanac.functions import text
    from almanac.operators import catalog
    from almanac.sources.ingest import lines_of

    row = "1001 AN F314  FLIGHT II   2 - 1 - 3  L1   A PERSON 5101 M W F 2   09/10 AN1  01/12 FN"
    lines = [row, row.replace("FLIGHT", "A\x01B"), row + "\r", "5 CS F111  X   1 1 1 1 1  P1"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select(*(F.get(text.fields(catalog.PRIMARY, 10, F.col("line")), F.lit(n - 1)).alias(f"a{n}") for n in range(1, 11))).collect()
    assert got == df.select(*(F.regexp_extract("line", catalog.PRIMARY, n).alias(f"a{n}") for n in range(1, 11))).collect()
    doc = lines_of(spark.createDataFrame([("x", "\n".join(lines))], "source_document string, text string"), "source_document")
    offerings, sections = catalog.timetable(doc)
    assert offerings.count() == sections.count() == 4
    for table in (offerings, sections):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("([LPT]\\d+)\\s*(.*)$, 9") <= 1  # the way for a line with the mark itself


def test_a_text_of_many_requests_is_parsed_once(spark):
    from almanac.operators import query

    texts = ["no midsem", None, "", "DELs, Mondays free"]
    requests = spark.createDataFrame([(i, texts[i % 4]) for i in range(400)], "id long, query string")
    got = query.answered(requests, lambda q: "{not json", pause=0.0)
    want = query.understood(query.asked(requests, lambda q: "{not json", pause=0.0))
    assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 400
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]


def test_a_policy_is_parted_once(spark):
    from pyspark.sql import functions as F

    policies = ["No make-up for quizzes. Make-ups are granted in genuine cases! A certificate must be sent?", "", None, "Bring a book."]
    df = spark.createDataFrame([(p,) for p in policies], "p string").select(handouts.makeup_conditions(F.col("p")).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    rows = [tuple(r["m"]) for r in df.collect()]
    assert rows[0] == (["Make-ups are granted in genuine cases!"], ["No make-up for quizzes."], None, ["Make-ups are granted in genuine cases!"], ["A certificate must be sent?"]) and rows[1:] == [(None,) * 5] * 3


def test_pairs_are_dealt_by_the_size_of_the_input(spark, sf_dir):
    """Tasks of pairs grow in number with the splits of the input, whatever the number of shuffle partitions, and no further shuffle follows for the join."""
    from almanac.plans import academic, relational

    splits = academic.read(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    assert academic.wishes(spark, sf_dir).rdd.getNumPartitions() == max(4, academic.PER_SPLIT * splits)
    plan = relational.enrolment_anti_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(student" in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["equivalence_anti_join", "category_membership", "open_elective_rule", "requirement_progress"])
def test_joins_of_pairs_are_dealt_by_the_size_of_the_input(spark, sf_dir, name):
    """No join of orders and items, or of pairs of students and courses, has as many tasks as shuffles have by default."""
    from almanac.plans import academic, relational

    n, threshold = academic.tasks(spark, sf_dir), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(relational, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = {(keys, int(k)) for keys, k in re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan) if re.search("student.*(course|group)|^course|orderkey", keys)}
    assert n > 4 and dealt and {k for _, k in dealt} == {n}, dealt


def test_courses_of_one_title_and_department_have_one_name(spark, sf_dir):
    from pyspark.sql import functions as F

    from almanac.plans import academic

    named = academic.equivalents(spark, sf_dir)
    assert dict(named.dtypes)["group"] == "bigint"
    rows = named.join(academic.courses(spark, sf_dir), "course").groupBy("title", "department").agg(F.collect_set("group").alias("names"), F.min("course").alias("least"))
    assert rows.where("names <> array(least)").isEmpty() and rows.count() == named.select("group").distinct().count()


def test_counts_of_a_student_come_together_in_one_aggregate(spark, sf_dir):
    """A join for each count and category sorted more than twenty times in one task."""
    from almanac.plans import relational

    plan = relational.requirement_progress(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Union", 1)[0] and "Aggregate" in plan.split("Union", 1)[0]


def test_offerings_are_put_in_order_once_for_all_findings(spark, sf_dir):
    from almanac.plans import relational

    plan = relational.policy_findings_union(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[row_number", plan)) == 1


def test_a_catalogue_is_gone_through_twice_and_joins_nothing(spark):
    """Once for the codes of its lines, once for its columns; what is said of a course comes together by one aggregate."""
    from almanac.operators import catalog
    from almanac.sources.ingest import lines_of

    text = (
        "CS F111 Logic   3   CS F112 Sets   4*\nPre-requisite: by consent\nCS F113\nPre-requisite: nobody waits\nCS F111 Logic again   5\n\f"
        + "Course Description".ljust(60)
        + ".\nCS F111 Logic   3\nPrerequisite: CS F100\nPrerequisite: CS F112\nor CS F113\nCS F999 Unlisted   2\nPrerequisite: CS F111"
    )
    got = catalog.catalogue(lines_of(spark.createDataFrame([("x", text)], "source_document string, text string"), "source_document"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate posexplode(split(text") == 2 and len(re.findall(r"Aggregate \[course", plan)) == 1, plan
    rows = {r["course"]: (r["title"], r["units"], r["prerequisite_expression"], r["needs"], [s["section"].split()[-1] for s in r["sources"]]) for r in got.collect()}
    assert rows.pop("CS F999") == ("Unlisted", 2, "CS F111", ["CS F111"], ["table", "prerequisite"])
    assert rows == {
        "CS F111": ("Logic again", 3, "CS F112 or CS F113", ["CS F112", "CS F113"], ["table"] * 3 + ["prerequisite"] * 3),
        "CS F112": ("Sets", 4, "by consent", [], ["table", "prerequisite"]),
    }


def test_documents_of_parts_are_dealt_by_number(spark, sf_dir):
    """Spark packs rows of parts into few tasks by their size when compressed; their lines are many times as large."""
    from almanac.plans import academic, bulletins

    n = academic.tasks(spark, sf_dir, "part")
    for name in ("catalogue_courses", "programme_lists"):
        plan = getattr(bulletins, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(source_document#\d+, {n}\), REPARTITION_BY_NUM", plan), name


def test_sections_of_a_course_are_told_by_a_few_masks(spark):
    """Whether a course has a section that fits is the same by its masks as by its sections, whichever way the masks are gone through."""
    import random

    from pyspark.sql import functions as F

    from almanac.operators import schedule

    dice = random.Random(4)
    slot = lambda: f"{dice.choice(['M', 'T', 'W', 'Th', 'F'])} {dice.randint(1, 4)}"
    sections = [(c, f"s{i}", None, dice.choice([None] if c % 9 == 0 else [slot(), f"{slot()} {slot()}", f"{slot()} {slot()} {slot()}"]), i) for c in range(60) for i in range(c % 5)]
    current = spark.createDataFrame([(s, dice.randrange(60)) for s in range(12) for _ in range(s % 4)], "student long, course long")
    meetings = schedule.Meetings(spark.createDataFrame(sections, "course long, section string, room string, meeting_text string, ordinal int"), current)
    students = spark.createDataFrame([(s, [None, "Mon", "Thu"][s % 3], s % 2 == 0) for s in range(12)], "student long, day string, early boolean")
    pairs = students.crossJoin(spark.range(60).withColumnRenamed("id", "course"))
    fitting = meetings.fitting(pairs, F.col("day"), F.col("early"))
    want = {(r["student"], r["course"]): r["n_feasible"] > 0 or r["course"] % 5 == 0 for r in fitting.collect()}
    assert len(set(want.values())) == 2
    rows = meetings.closed(pairs, F.col("day"), F.col("early")).join(meetings.of_courses(), "course", "left")
    most = rows.agg(F.max(F.size("more"))).first()[0]
    assert 1 < most <= 4
    for n in (most, 5):
        assert {(r["student"], r["course"]): r["open"] for r in rows.withColumn("open", meetings.open(n)).collect()} == want


def test_a_pair_is_tested_where_it_is_made(spark, sf_dir):
    """Pairs of students and courses are neither sorted nor dealt again: one join has all tests, and its rows are counted at once."""
    from almanac.operators import recommend
    from almanac.plans import advice

    tables, asked = advice.asked(spark, sf_dir)
    plan = recommend.unknown_facts(tables | {"sections": None}, asked, tasks=6)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    pairs = next(i for i, line in enumerate(lines) if "ShuffledHashJoin [request" in line)
    assert all(test in lines[pairs] for test in ("taken", "done_groups", "met", "exam_word0", "most"))
    above = [line.lstrip(" +-:") for line in lines[:pairs]]
    assert above[-2].startswith("HashAggregate(keys=[student") and "partial_count" in above[-2] and above[-1].startswith("Project"), above
    assert {int(n) for n in re.findall(r"hashpartitioning\(request#\d+L?, part#\d+, (\d+)\)", plan)} == {6}


def test_texts_of_a_pdf_are_gone_through_as_a_whole(monkeypatch):
    """Letter by letter only where they run backwards, come in halves or have no text."""
    from almanac.plans import papers
    from almanac.sources import pdf

    def letters(self, data):
        raise AssertionError("letter by letter")

    monkeypatch.setattr(pdf.Font, "letters", letters)
    found = pdf.words(papers.made(["#1\nab zażółć\n漢字  x"]).encode())
    assert [(w.x, w.y, w.word) for w in found] == [(72, 60, "#1"), (72, 74, "ab"), (90, 74, "zażółć"), (72, 88, "漢字"), (96, 88, "x")]


def test_pages_are_laid_out_by_heights(spark):
    """Lines are the same as word by word, where words of several heights are one line too, and words are dealt by page."""
    import random

    from almanac.sources import ingest

    dice = random.Random(5)
    words = [(p, dice.choice([72.0, 80.5, 90.0, 90.0, 300.25, 1.0]), dice.choice([10.0, 11.0, 12.5, 14.0, 40.0, 41.5, 44.0, 90.0]), dice.choice("abcd") * dice.randint(1, 9)) for p in range(30) for _ in range(p)]
    want: dict[int, list] = {}
    for page, x, y, word in sorted(words, key=lambda w: (w[0], w[2], w[1], w[3])):
        rows = want.setdefault(page, [])
        if rows and y - rows[-1][0] <= ingest.LINE_GAP:
            rows[-1][1].append((x, word))
        else:
            rows.append((y, [(x, word)]))

    def drawn(row):
        line = ""
        for x, word in sorted(row):
            line += " " * max(1, round(x / ingest.POINTS) - len(line)) + word
        return line

    laid = ingest.layout_words(spark.createDataFrame(words, "page int, x double, y double, word string"), ["page"])
    assert {r["page"]: r["text"] for r in laid.collect()} == {p: "\n".join(drawn(row) for _, row in rows) for p, rows in want.items()}
    assert re.search(r"hashpartitioning\(page#\d+, 4\), REPARTITION_BY_NUM", laid._jdf.queryExecution().executedPlan().toString())


def test_a_pdf_is_read_once_and_its_words_are_not_stored(spark, sf_dir):
    from almanac.plans import papers

    plan = papers.pdf_pages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"EvalPython \[read_pdfs", plan.split("== Initial Plan ==")[0])) == 1 and "ExistingRDD" not in plan, plan
