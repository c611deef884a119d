"""Rows without an id in the collection-wide operators, against brute force."""

import random
from collections import Counter

import pytest

from almanac.llm import nearjoin, repeats
from tests.llm.test_corpus import brute_classes, brute_repeats, docs, words


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_with_null_ids_equal_brute_force(spark, hot):
    rng = random.Random(3)
    passage, long = words(rng, 90), words(rng, 300)
    texts = [None, "", words(rng, 60) + passage + words(rng, 60), passage + words(rng, 40), long, long, long[200:], words(rng, 50) + passage[:420], words(rng, 200), None, long[100:900] + passage]
    ids = [None, None, None, 3, None, None, None, 7, None, 9, 4]
    rows = repeats.remove_repeats(docs(spark, texts, ids=ids), hot=hot).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i, *w) for i, w in zip(ids, brute_repeats(texts), strict=True))


def test_near_duplicates_with_null_ids_equal_brute_force(spark):
    rng = random.Random(5)
    bases = [words(rng, 80).split() for _ in range(4)]
    edit = lambda b, k: " ".join([*b[:k], f"w{k}", *b[k + 1 :]])
    texts = [None, "", *(" ".join(b) for b in bases), *(edit(b, 5) for b in bases), *(edit(b, 6) for b in bases), " ".join(bases[0]), words(rng, 60)]
    ids = [None, None, None, None, 4, 5, None, 7, None, 9, None, None, None, 13, None, None]
    want = brute_classes(texts, range(len(texts)))
    classes = {}
    for (n, c, _), i in zip(want, ids, strict=True):
        classes.setdefault(c, []).append(i)
    least = {c: min((i for i in of if i is not None), default=None) for c, of in classes.items()}
    frame = docs(spark, texts, ids=ids)
    rows = nearjoin.near_duplicates(frame).collect()
    assert Counter(tuple(r) for r in rows) == Counter((ids[n], least[c], links) for n, c, links in want)
    assert nearjoin.stage(spark, frame, "").count() == len(classes)
