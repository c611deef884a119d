"""Ranked lexical search against brute force, with shards and blocks of any size."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from almanac.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, own in counted:
            m = 25 + 75 * sum(own.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item", "1 AS score", "2 AS term"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS block")


@pytest.mark.parametrize(("shard", "block"), [(4096, 200_000), (7, 30)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdéßÄ") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["The", "THE", "ﬁ", "İ", "9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights=range(1, 66), k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(150)]
    docs += [(3, text(20)), (None, text(20)), (None, None), (901, None), (902, ""), (903, "--- !"), (904, "tie tie"), (905, "tie tie"), (906, "tie tie")]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(1, text(9)), (20, "tie"), (20, "tie"), (21, ""), (22, None), (23, "unheard"), (None, "the the")]
    rows, asked = tables(spark, docs, items)
    got = [tuple(r) for r in lexical.ranked(rows, asked, block_terms=block).collect()]
    assert sorted(got, key=str) == brute(docs, [(i, t or "") for i, t in items])


def test_empty_tables(spark):
    some = [(1, "a b")]
    for docs, items in (([], some), (some, []), ([], [])):
        assert lexical.ranked(*tables(spark, docs, items)).count() == 0


def test_long_text_is_read_whole(spark):
    """Terms are counted over all parts of a text and never cut."""
    text = "word " * 300_000 + "é" * 1_200_000 + " last"
    found = [t for part in lexical.terms(text) for t in part]
    assert len(found) == 300_002 and found[-1] == b"last" and found[-2] == "é".encode() * 1_200_000


def test_terms_below_the_bar_are_only_probed():
    """A second shard with nothing good enough leaves the best as they are."""
    good, bad = lexical.ShardBuilder(), lexical.ShardBuilder()
    for i in range(20):
        good.add(i, "rare common")
        bad.add(100 + i, "common " + "filler " * 50)
    best: list = []
    for builder in (good, bad):
        row = builder.row()
        shard = lexical.Shard(row | {"none": [False] * len(row["doc_ids"])}, 40, 1000)
        shard.search([(b"rare", 3000), (b"common", 20)], best, 10)
    assert sorted(-d for _, _, d in best) == list(range(10))


def test_sql_agrees(spark, sf_dir):
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", benchmark.toPandas())
    want = con.sql(lexical.OP11_SQL).fetchall()
    assert sorted(tuple(r) for r in lexical.ranked(documents, benchmark).collect()) == sorted(want) and want
