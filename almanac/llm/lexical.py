"""Ranked lexical search: MaxScore in each shard of an index of all documents.

The index has a shard for each few thousand documents of a partition, made
where the documents are read: per term the places of the documents that hold it
and how often each does. Nothing is shuffled but the counts of the terms asked
for. Terms of a document are counted over its whole text.

A document's score for an item sums, over the item's terms with repeats,
``w * ((10^9 tf) div (1000 tf + 8 m))``. All is 64-bit integer arithmetic but the
weight ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``, which is taken in doubles.
In a shard, the largest addend of a term bounds what it can add to any document.
An item's terms are put in order of these bounds; those whose bounds together
stay below the item's k-th best score so far are not essential: no document
enters the best by them alone. Only the postings of the essential terms are
read through. The documents met are then probed in the others, from the largest
bound down, while what they have and what the rest can add reaches that score.
A task keeps each item's best over its shards, so later shards start with a high
bar and are skipped for an item if all its bounds together stay below; a task
returns ``k`` rows an item at most.

Items go to the executors in blocks of at most about ``BLOCK_TERMS`` terms, each
broadcast, so a broadcast does not grow with the documents or the items.

Edge cases: null texts and texts without a term are not counted and never
found; an item without a term, or whose terms are in no document, has no rows;
items that share an id but not the text are ranked apart, equal items once;
documents that share an id are ranked each; equal scores go by ascending doc_id,
a null one last; very long texts are read whole, in parts; with fewer than ``k``
documents above score 0 all are returned; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.common import cut, slices, table

K = 10
#: Documents and postings of a shard: it ends with the document that reaches one of them.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
BLOCK_TERMS = 200_000
TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

INDEX = "n_docs long, n_terms long, doc_ids array<long>, sizes array<long>, terms array<binary>, df array<int>, places array<int>, tf array<long>"


class Numbers(dict):
    """Terms to numbers, in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower(), BREAK):  # of bytes, so A-Z only
        yield TERM.findall(part)


class ShardBuilder:
    def __init__(self):
        self.names, self.ids, self.sizes, self.postings = Numbers(), [], [], 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        parts = [np.unique(np.fromiter(map(self.names.__getitem__, found), np.int64, len(found)), return_counts=True) for found in terms(text) if found]
        if not parts:
            return
        numbers, counts = parts[0]
        if len(parts) > 1:
            numbers, at = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        self.ids.append(doc_id)
        self.sizes.append(int(counts.sum()))
        self.found.append((numbers, counts))
        self.postings += len(numbers)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self) -> dict:
        number = np.concatenate([n for n, _ in self.found])
        place = np.repeat(np.arange(len(self.ids)), [len(n) for n, _ in self.found])
        order = np.argsort(number, kind="stable")
        return {
            "n_docs": len(self.ids), "n_terms": sum(self.sizes), "doc_ids": self.ids, "sizes": self.sizes, "terms": list(self.names),
            "df": np.bincount(number, minlength=len(self.names)), "places": place[order], "tf": np.concatenate([c for _, c in self.found])[order],
        }


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per shard, as in ``INDEX``; documents without a term are left out."""
    kinds = {"n_docs": pa.int64(), "n_terms": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()), "df": pa.list_(pa.int32()), "places": pa.list_(pa.int32()), "tf": pa.list_(pa.int64())}

    def packed(shard: ShardBuilder) -> pa.RecordBatch:
        row = shard.row()
        return pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.full():
                    yield packed(shard)
                    shard = ShardBuilder()
        if shard.ids:
            yield packed(shard)

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(run, INDEX)


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """(item, key, term, times): the distinct items, numbered by their content, and how often each holds a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, own, text in zip(*(batch.column(c).to_pylist() for c in ("item", "own", "text")), strict=True):
                times: dict[bytes, int] = defaultdict(int)
                for found in terms(text):
                    for t in found:
                        times[t] += 1
                if times:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(times)), pa.array([own] * len(times), pa.int64()), pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], names=["item", "own", "term", "times"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = items.select(F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("-")), text), 256).alias("item"), F.col(key).cast("long").alias("own"), text.alias("text")).distinct()
    return rows.mapInArrow(run, "item string, own long, term binary, times long")


class Shard:
    """A shard with what each posting adds per unit of weight, and the most that a term can add."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        sizes, self.places, tf, df = (np.asarray(row[c]) for c in ("sizes", "places", "tf", "df"))
        self.ids, self.none = row["doc_ids"], row["none"]
        m = 25 + 75 * sizes.astype(np.int64) * n_docs // n_terms
        self.adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        ends = np.cumsum(df)
        self.starts = ends - df
        self.ends = ends
        self.most = np.maximum.reduceat(self.adds, self.starts)
        self.number = {t: i for i, t in enumerate(row["terms"])}

    def search(self, wanted: list[tuple[bytes, int]], best: list[tuple], k: int) -> None:
        """Put this shard's best documents for (term, weight times repeats) into the heap ``best`` of (score, -null, -id)."""
        here = [(weight * int(self.most[i]), weight, i) for t, weight in wanted if (i := self.number.get(t)) is not None and weight]
        if not here:
            return
        here.sort()
        upto = np.cumsum([bound for bound, _, _ in here])
        bar = best[0][0] if len(best) == k else 1
        optional = int(np.searchsorted(upto, bar))  # terms that stay below the bar together
        if optional == len(here):
            return
        scores = np.zeros(len(self.ids), np.int64)
        for _, weight, i in here[optional:]:
            at = slice(self.starts[i], self.ends[i])
            scores[self.places[at]] += weight * self.adds[at]
        rest = int(upto[optional - 1]) if optional else 0
        open_docs = np.flatnonzero((scores > 0) & (scores + rest >= bar))
        for n in range(optional - 1, -1, -1):
            open_docs = open_docs[scores[open_docs] + upto[n] >= bar]
            if not len(open_docs):
                return
            _, weight, i = here[n]
            at = slice(self.starts[i], self.ends[i])
            places = self.places[at]
            where = np.minimum(np.searchsorted(places, open_docs), len(places) - 1)
            met = places[where] == open_docs
            scores[open_docs[met]] += weight * self.adds[at][where[met]]
        open_docs = open_docs[scores[open_docs] >= bar]
        if len(open_docs) > k:  # ties at the k-th score stay
            own = scores[open_docs]
            open_docs = open_docs[own >= np.partition(own, len(own) - k)[len(own) - k]]
        for d in open_docs.tolist():
            entry = (int(scores[d]), -int(self.none[d]), -int(self.ids[d]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def best_of_block(index: DataFrame, asked: dict[str, list[tuple[bytes, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score): each task's best documents for the items of one block."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple]] = {item: [] for item in sent.value}
        for batch in batches:
            for r in range(batch.num_rows):
                own = {c: batch.column(c)[r].values for c in ("doc_ids", "sizes", "terms", "df", "places", "tf")}
                row = {c: v.to_numpy(zero_copy_only=False) for c, v in own.items() if c not in ("doc_ids", "terms")}
                row |= {"none": own["doc_ids"].is_null().to_numpy(zero_copy_only=False), "doc_ids": own["doc_ids"].fill_null(0).to_numpy(zero_copy_only=False), "terms": own["terms"].to_pylist()}
                shard = Shard(row, n_docs, n_terms)
                for item, wanted in sent.value.items():
                    shard.search(wanted, best[item], k)
        out = [(item, None if none else -doc, score) for item, found in best.items() for score, none, doc in found]
        if out:
            items, docs, scores = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return index.mapInArrow(run, "item string, doc long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_key, rank, key, score): the ``k`` best rows of ``docs`` for each distinct row of ``items`` (item_key, text)."""
    spark = docs.sparkSession
    index = cut(build_index(docs, key))
    asked = cut(item_terms(items, item_key))
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_asked = asked.count()
    out = spark.createDataFrame([], "item string, doc long, score long")
    if n_docs and n_asked:
        # A task may read a shard as a whole, but only its terms that are asked for leave it.
        held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("at")).select(F.col("at.terms").alias("term"), F.col("at.df").cast("long").alias("df"))
        df = held.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        blocks = math.ceil(n_asked / block_terms)
        weighed = cut(asked.join(df, "term").select("item", "term", "times", "df", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")))
        for block in range(blocks):
            wanted: dict[str, list[tuple[bytes, int]]] = defaultdict(list)
            for r in weighed.where(F.col("block") == block).collect():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
                wanted[r["item"]].append((bytes(r["term"]), r["times"] * weight))
            out = out.unionByName(best_of_block(index, dict(wanted), n_docs, n_terms, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "own").distinct(), "item").select(F.col("own").alias(item_key), "rank", F.col("doc").alias(key), "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(ts) AS size FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS terms FROM sized),
q AS (SELECT item, item_id, term, count(*) AS times FROM (
    SELECT item, item_id, unnest(ts) AS term FROM (
      SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)))
  GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
scored AS (
  SELECT item, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN sized USING (r), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
