"""Phrases as runs of words, and what the outlines' readers make of them."""

import re

from almanac.operators import handouts
from almanac.operators.phrases import mentions

TEXTS = ["Machine learning and deep-learning; machine  learning", "GROUP projects, groupwork", "a closed / open-book test", "", None, "Äpfel mit dna", "xmachine learningx"]
PHRASES = ["machine learning", "DNA", "learning", "deep-learning", "group project*", "closed/open", "äpfel"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_whole_words_with_their_gaps(spark):
    got = {(r["id"], r["phrase"], r["place"], r["before"], r["after"]) for r in mentions(rows(spark, TEXTS), ["id"], "text", PHRASES).collect()}
    assert got == {
        (0, "machine learning", 0, "", " "), (0, "learning", 1, " ", " "), (0, "deep-learning", 3, " ", "; "), (0, "learning", 4, "-", "; "), (0, "learning", 6, "  ", ""),
        (1, "group project*", 0, "", ", "), (2, "closed/open", 1, " ", "-"), (5, "äpfel", 0, "", " "), (5, "DNA", 2, " ", ""),
    }


def test_table_of_phrases_gives_the_same(spark):
    table = spark.createDataFrame([(p,) for p in [*PHRASES, "DNA"]], "phrase string")
    one, other = (sorted(map(tuple, mentions(rows(spark, TEXTS), ["id"], "text", p).collect())) for p in (PHRASES, table))
    assert one == other
    assert mentions(rows(spark, TEXTS), ["id"], "text", []).count() == 0


def test_plan_has_no_pattern_per_phrase(spark, capsys):
    mentions(rows(spark, TEXTS), ["id"], "text", spark.createDataFrame([(p,) for p in PHRASES], "phrase string")).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


DENIALS = {
    "No midsem will be held": {"midsem"}, "no mid-semester test": {"midsem"}, "the Mid Semester exam will not be held": {"midsem"}, "Comprehensive examination is not conducted; no mid sem": {"midsem", "compre"},
    "compre not be held": {"compre"}, "no quiz, but a midsem": set(), "nomidsem": set(), "the midsem, not be held": set(), "no-midsem": set(), "No.\nmidsem": set(), "midsem will be held": set(), "mid-term not be held": set(),
}


def test_denied_exams(spark):
    told = rows(spark, list(DENIALS)).orderBy("id")
    got = [{kind for kind in handouts.EXAMS if r[kind]} for r in told.select(*(handouts.denied(k, told["text"]).alias(k) for k in handouts.EXAMS)).collect()]
    assert got == list(DENIALS.values())


DETAILS = {
    ("Surprise Quizzes (3)", "closed book"): (3, "surprise", "closed", None),
    ("Quiz", "pre-announced, 2 quizzes out of 4, open-book"): (2, "announced", "open", None),
    ("Quiz", "best 3 out of 5, un-announced"): (5, None, None, None),
    ("Test", "announced and surprise, Closed / Open book"): (None, "mixed", "mixed", None),
    ("Project", "partly open book, group projects"): (None, None, "partly_open", "group"),
    ("Project", "individual work and team work"): (None, None, None, None),
    ("Lab", "close/openness, CB, partial, in groups"): (None, None, "partly_closed", "group"),
    ("projects (2 )", "12 tests"): (12, None, None, None),
    ("", ""): (None, None, None, None),
}


def test_details_of_components(spark):
    given = [(i, *names) for i, names in enumerate(DETAILS)]
    frame = spark.createDataFrame(given, "doc_id long, name string, raw_text string")
    got = handouts.component_details(frame, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r["count"], r["announcement"], r["book_policy"], r["work_mode"]) for r in got] == list(DETAILS.values())


def test_topics_equal_a_pattern_for_each(spark):
    texts = ["Robotics and DNA, recombinant DNA.", "data science; data-science", "dnas", "Probability\nand statistics"]
    frame = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id long, ordinal int, section string")
    got = {(r["id"], r["topic"]) for r in handouts.topics_of(frame, "id").collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in handouts.fixed.TOPICS if re.search(rf"\b{re.escape(p)}\b", t, re.I)}
