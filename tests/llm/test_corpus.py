"""Repeats, near duplicates, mixture, top-k search and the pipeline, against brute force or SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import mixing, nearjoin, repeats, topk
from almanac.llm.common import cut


def docs(spark, texts, ids=None, sources=None):
    rows = [((ids or range(len(texts)))[i], t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


# Repeats


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeated_texts():
    rng = random.Random(1)
    passage, long = words(rng, 90), words(rng, 400)
    edited = long[:900] + "X" + long[901:1400] + "Y" + long[1401:]
    return [
        None, "", "short", passage[:399], passage[:400], words(rng, 80) + passage + words(rng, 80), "é" + passage + words(rng, 30), long, edited, long[300:], long, long,
        "ab" * 700, "abc " * 50 + words(rng, 200), passage[:200] + words(rng, 60) + passage[:399], "漢字" * 300, words(rng, 300), passage[100:] + passage[:350], "x" * 401,
    ]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_equal_brute_force(spark, repeated_texts, hot):
    frame = docs(spark, repeated_texts).withColumn("n_removed", F.lit("mine"))
    rows = repeats.remove_repeats(frame, hot=hot, with_text=True).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute_repeats(repeated_texts)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_repeats_with_repeated_ids_and_no_rows(spark, repeated_texts):
    texts = [repeated_texts[7], repeated_texts[7], repeated_texts[16], repeated_texts[8]]
    rows = repeats.remove_repeats(docs(spark, texts, ids=[5, 5, 5, 6])).collect()
    want = Counter((i, *w) for i, w in zip([5, 5, 5, 6], brute_repeats(texts), strict=True))
    assert Counter(tuple(r) for r in rows) == want
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_loser_tree_sorts_and_knows_common_prefixes():
    rng = random.Random(2)
    for runs in (1, 2, 3, 7):
        entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))), b"l", k, k, 1) for k in range(60)]
        coded = [repeats.front_code(sorted(entries[r::runs])) for r in range(runs)]
        got = list(repeats.merge(coded))
        assert [e[0] for _, e in got] == sorted(e[0] for e in entries)
        for (_, a), (c, b) in zip(got, got[1:], strict=False):
            assert c == repeats.common(a[0], b[0], 0)


# Near duplicates


def brute_classes(texts, ids):
    shingler = nearjoin.Shingler()
    sets = [set(shingler(t).tolist()) for t in texts]
    parent, degree = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                degree[a] += 1
                degree[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(ids[i])
    return [(ids[i], min(groups[root(i)]), degree[i]) for i in range(len(texts))]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    base, passage = words(rng, 120).split(), words(rng, 60)
    texts = [None, "", "a b", "a b", "A, b!", "one two three four five", words(rng, 50)]
    for k in range(40):  # a chain of drifting copies
        base = base[:]
        base[rng.randrange(len(base))] = f"w{k}"
        texts.append(" ".join(base))
    texts += [passage + " " + words(rng, 80) for _ in range(30)]  # only a passage in common
    texts += [texts[8]] * 12
    return texts


@pytest.mark.parametrize("limit,depth", [(512, 6), (3, 6), (3, 1)])
def test_near_duplicates_equal_brute_force(spark, near_texts, limit, depth):
    frame = docs(spark, near_texts).withColumn("sid", F.lit("mine"))
    rows = nearjoin.near_duplicates(frame, limit=limit, depth=depth).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute_classes(near_texts, range(len(near_texts)))


def test_one_document_of_each_class_stays(spark, near_texts):
    frame = docs(spark, [*near_texts, near_texts[6]], ids=[*range(len(near_texts)), 6])
    kept = nearjoin.stage(spark, frame, "").collect()
    want = {c for _, c, _ in brute_classes(near_texts, range(len(near_texts)))}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert nearjoin.near_duplicates(docs(spark, [])).count() == 0


def test_runs_reach_the_target():
    one = 1 - (1 - nearjoin.TARGET_RECALL) ** (1 / nearjoin.runs_needed())
    assert 0 < one < 1 and nearjoin.runs_needed(recall=0.9) < nearjoin.runs_needed(recall=0.999)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 100)]
    found = {r["vertex"]: r["root"] for r in nearjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 51)) and found[101] == found[102] == 100
    assert nearjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixture


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


def test_mixture_equals_sql(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.choice([0, 1, 5, 60, 400])) for _ in range(300)] + [None, "", "  x", "same", "same"]
    sources = [rng.choice(["a", "b", "B", "é", None]) for _ in texts]
    frame = docs(spark, texts, ids=[*range(len(texts) - 1), len(texts) - 2], sources=sources).withColumn("size", F.lit("mine"))
    got = mixing.mix(frame).drop("source").toPandas()
    want = sql_rows(mixing.OP5_SQL, documents=frame.toPandas())
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    key = lambda df: sorted(map(tuple, df[columns].values.tolist()))
    assert key(got) == key(want)
    assert (got.taken <= 2 * got["size"]).all()
    sums = mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["goal"]) <= r["most"] for r in sums)
    assert key(mixing.mix(frame.repartition(7)).drop("source").toPandas()) == key(got)


def test_mixture_of_nothing_and_of_blanks(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, ["", None, " "])).collect()] == [0, 0, 0]


def test_longer_documents_are_likelier(spark):
    texts = ["w " * (10 if i % 2 else 1000) for i in range(600)]
    rows = mixing.mix(docs(spark, texts), weights=(1,), share=0.5).collect()
    short, long = ([r["copies"] for r in rows if r["size"] == n] for n in (10, 1000))
    assert np.mean(long) > 3 * np.mean(short) > 0


# Top-k


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % 50 == 0}:
        scored = sorted((-int(a @ b), i) for j, a in good if j == q for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(4096, 512), (16, 2)])
def test_top_k_equals_brute_force(spark, shard, block):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(0, s, 8)).tolist()) for i, s in enumerate(rng.choice([0.01, 1, 3000], 160))]
    rows += [(150 + i, [0.5] * 8) for i in range(12)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (950, [1.0, 2.0]), (951, [1.0, -2.0]), (952, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block).collect()
    assert sorted(tuple(r) for r in got) == brute_top([r for r in rows if r[1] != []])
    assert topk.top_k(frame.where("false"), F.lit(True)).count() == 0


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(0, 1, (300, 4)) * 2.0 ** rng.integers(0, 12, (300, 1)))
    q = np.floor(rng.normal(0, 50, (3, 4)))
    got = topk.search(np.array([-1, -2, -3]), q, np.arange(300), rows, 5)
    for n, r in enumerate((-1, -2, -3)):
        want = sorted((-int(q[n] @ rows[i]), i) for i in range(300))[:5]
        assert [(-s, i) for q_, i, s in got if q_ == r] == want


# Pipeline


def test_pipeline_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    frame, counts = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, d))
        counts.append(frame.count())
        assert frame.columns == columns or name == "mix"
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    whole = corpus_pipeline.run(spark, d)
    assert whole.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, frame.collect()))


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "good words here", "en", None, 15), (3, "good words here", "en", None, 15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in out] == [3]
