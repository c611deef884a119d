"""Queries over whole tables: no language, ending, student or course is left out."""

from almanac.plans import academic, registry, textual


def ids(rows, column="doc_id"):
    return {r[column] for r in rows.select(column).collect()}


def test_text_queries_take_every_document(spark, sf_dir):
    every = ids(academic.read(spark, sf_dir, "documents"))
    for name in ("tokens_distinct", "two_column_split", "sentence_clauses"):
        assert ids(registry.QUERIES[name](spark, sf_dir)) == every


def test_student_and_course_queries_take_all(spark, sf_dir):
    assert ids(registry.QUERIES["slot_overlap"](spark, sf_dir), "course") == ids(academic.wishes(spark, sf_dir).join(academic.offerings(spark, sf_dir).select("course"), "course", "left_semi"), "course")
    assert ids(registry.QUERIES["set_operations"](spark, sf_dir), "student") == ids(academic.enrolment(spark, sf_dir), "student")
    assert len(ids(registry.QUERIES["missing_lists"](spark, sf_dir), "student")) > 1


def test_texts_with_accents_and_without_a_mark_at_the_end(spark):
    texts = [(1, "Élan vital. Naïve café"), (2, "no mark"), (3, "One. Two! Three?"), (4, ""), (5, "ÜBER Straße.\n\nzwölf"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0]: r[1] for r in textual.sentence_counts(docs).collect()} == {1: 2, 2: 1, 3: 3, 4: 0, 5: 2, 6: None}
    assert {r["doc_id"]: r["tokens"] for r in textual.keywords_of(docs).collect()} == {1: "caf lan na ve vital", 2: "mark", 3: "one three two", 4: "", 5: "ber lf stra zw", 6: None}
