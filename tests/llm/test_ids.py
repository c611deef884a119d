"""Ids that repeat or are null, against what the same rows give with ids of their own."""

import pytest

from almanac.llm import decontaminate

A = "one two three four five six seven eight nine ten"
B = "red orange yellow green blue indigo violet black white grey"
C = "north east south west up down left right in out"


@pytest.mark.parametrize("bound", [500_000, 1])
def test_repeated_and_null_ids_of_items_and_documents(spark, bound):
    bench = spark.createDataFrame([(1, A), (1, B), (1, A), (None, C), (2, None)], "item_id long, text string")
    texts = [(None, "x " + A), (5, "y " + B), (5, "nothing of it"), (None, "nor here"), (None, "z " + C), (6, None), (7, C + " " + A), (5, "y " + B)]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, n int")
    rows = sorted(decontaminate.decontaminate(frame, bench, max_broadcast_seeds=bound).collect(), key=lambda r: r["n"])
    assert [r["contaminated"] for r in rows] == [True, True, False, False, True, False, True, True]
    assert [r["items"] for r in rows] == [[1], [1], [], [], [], [], [1], [1]]
    assert [r["coverage"] for r in rows] == [1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
