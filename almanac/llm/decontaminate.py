"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``min_match`` consecutive
tokens) are compared: Running Karp-Rabin matching finds the longest common
runs of unmarked tokens, marks them, and goes on with shorter ones down to
``min_match``. The tiles never overlap and may come in any order, so reordered
passages still count. A document is contaminated by an item of which at least
``threshold`` of the tokens are covered.

Seeds are content hashes of the benchmark. Their table is broadcast only if
its size is within ``max_broadcast_seeds``; beyond it, seeds and documents are
joined by hash with a shuffle, and the tiling runs on the joined pairs. Both
ways give the same rows. A document is compared with an item only where the
item's seeds occur: no tile can lie elsewhere.

Edge cases: null and empty texts and items without a token match nothing; an
item shorter than ``min_match`` tokens must occur as a whole; repeated rows are
judged alike; ids of documents and items may repeat with other texts or be
null: every text is matched, and ``items`` lists the ids that are not null; an
empty benchmark leaves all documents clean. Tokens are lower-cased runs of
letters, digits and underscores. Texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import fresh, map_batches, table

MIN_MATCH = 5
THRESHOLD = 0.5
#: Largest seed table that is sent to every executor; a seed takes about 100 bytes there.
MAX_BROADCAST_SEEDS = 500_000
TOKEN = re.compile(r"\w+")
BASE = 0x100000001B3
MASK = (1 << 61) - 1
ADDED = ("contaminated", "items", "coverage")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def tiles(pattern: list, text: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length), longest first."""
    marked_p, marked_t = bytearray(len(pattern)), bytearray(len(text))
    codes: dict = {}
    p = [codes.setdefault(x, len(codes) + 1) for x in pattern]
    t = [codes.setdefault(x, len(codes) + 1) for x in text]
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(20, len(pattern)))
    while True:
        matches, longest = scan(p, t, marked_p, marked_t, length)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-size, i, j) for size, starts in matches.items() for i, j in starts]
        heapq.heapify(queue)
        while queue:
            size, i, j = heapq.heappop(queue)
            size = -size
            if not any(marked_p[i : i + size]) and not any(marked_t[j : j + size]):
                marked_p[i : i + size] = marked_t[j : j + size] = b"\1" * size
                found.append((i, j, size))
            else:  # a longer tile took part of it; what is left goes back in line
                for a, b, rest in remains(i, j, size, marked_p, marked_t):
                    if rest >= length:
                        heapq.heappush(queue, (-rest, a, b))
        if length <= min_match:
            return found
        length = max(min_match, length // 2)


def remains(i: int, j: int, size: int, marked_p: bytearray, marked_t: bytearray) -> list[tuple[int, int, int]]:
    """The longest run of a match in which neither side is marked yet, if there is one."""
    best, start = (0, 0, 0), None
    for k in range(size + 1):
        free = k < size and not marked_p[i + k] and not marked_t[j + k]
        if free and start is None:
            start = k
        elif not free and start is not None:
            best = max(best, (k - start, -start, start))
            start = None
    return [(i + best[2], j + best[2], best[0])] if best[0] else []


def scan(p: list[int], t: list[int], marked_p: bytearray, marked_t: bytearray, length: int) -> tuple[dict, int]:
    """Maximal matches of at least ``length`` unmarked tokens by rolling hash, grouped by size."""
    at = defaultdict(list)
    for j, h in windows(t, marked_t, length):
        at[h].append(j)
    matches, longest = defaultdict(list), 0
    for i, h in windows(p, marked_p, length):
        for j in at.get(h, ()):
            if p[i : i + length] != t[j : j + length]:
                continue
            if i and j and p[i - 1] == t[j - 1] and not marked_p[i - 1] and not marked_t[j - 1]:
                continue  # part of the match that starts one token earlier
            k = length
            while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not marked_p[i + k] and not marked_t[j + k]:
                k += 1
            longest = max(longest, k)
            matches[k].append((i, j))
    return matches, longest


def windows(x: list[int], marked: bytearray, length: int):
    """(start, hash) of each window of ``length`` unmarked tokens."""
    top, h, run = pow(BASE, length - 1, MASK), 0, 0
    for k, code in enumerate(x):
        if marked[k]:
            h = run = 0
            continue
        if run >= length:
            h = (h - x[k - length] * top) % MASK
        h = (h * BASE + code) % MASK
        run += 1
        if run >= length:
            yield k - length + 1, h


class Seeds:
    """The benchmark's items with a hash table of their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.items = {i: tokens(text) for i, text in items}
        self.vocabulary: dict[str, int] = {}
        self.short: dict[int, list[int]] = {}
        owners: dict[int, set[int]] = defaultdict(set)
        for i, words in self.items.items():
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            n = min(min_match, len(ids))
            if n:
                for h in self.hashes(ids, n).tolist():
                    owners[h].add(i)
        self.lengths = sorted({min(min_match, len(w)) for w in self.items.values() if w})
        self.owners = {h: sorted(of) for h, of in owners.items()}
        self.sorted = np.array(sorted(self.owners), np.uint64)

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of ``n`` ids."""
        m = len(ids) - n + 1
        h = np.full(max(m, 0), n, np.uint64)
        for k in range(n if m > 0 else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + m] + 1).astype(np.uint64)
            h ^= h >> np.uint64(29)
        return h

    def seeded(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Per item, the places (start, end) of its seeds in a document."""
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not len(self.sorted):
            return hits
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n in self.lengths:
            starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if not len(starts):
                continue
            h = np.full(len(starts), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[starts + k] + 1).astype(np.uint64)
                h ^= h >> np.uint64(29)
            place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            for k in np.flatnonzero(self.sorted[place] == h).tolist():
                s = int(starts[k])
                for item in self.owners[int(h[k])]:
                    hits[item].append((s, s + n))
        return hits

    def coverage(self, words: list[str]) -> dict[int, float]:
        """Covered share of each item that shares a seed with the document."""
        out = {}
        for item, places in self.seeded(words).items():
            out[item] = covered(self.items[item], words, places, self.min_match)
        return out


def covered(pattern: list[str], words: list[str], places: list[tuple[int, int]], min_match: int) -> float:
    """Share of ``pattern`` tiled by the regions of ``words`` that hold its seeds."""
    regions: list[list[int]] = []
    for s, e in sorted(places):
        if regions and s <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], e)
        else:
            regions.append([s, e])
    distinct = dict.fromkeys(tuple(words[s:e]) for s, e in regions)
    # Each copy of a region may serve one tile, and a tile is min_match tokens at least (or the whole of a shorter pattern).
    least = max(1, min(min_match, len(pattern)))
    counts = defaultdict(int)
    text: list = []
    for region in (tuple(words[s:e]) for s, e in regions):
        counts[region] += 1
        if counts[region] <= len(pattern) // least + 1:
            text += [*region, (len(text),)]
    if not distinct:
        return 0.0
    return sum(n for _, _, n in tiles(pattern, text, min(min_match, len(pattern)))) / len(pattern)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """Add ``contaminated``, ``items`` (those over the threshold) and ``coverage`` (the largest of any item) to every row of ``docs``."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"(?U)\w+")), F.lit(0))
    size = benchmark.agg(F.sum(words)).first()[0] or 0
    if size > max_broadcast_seeds:
        return by_join(docs, benchmark, min_match, threshold)
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().collect()
    # Items are matched by number: an id may have several texts, or be null.
    ids = [r[0] for r in rows]
    sent = docs.sparkSession.sparkContext.broadcast((ids, Seeds([(n, r[1]) for n, r in enumerate(rows)], min_match)))

    kept = [c for c in docs.columns if c not in ADDED]

    def run(batches):
        ids, seeds = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [seeds.coverage(tokens(t)) for t in batch.column("text").to_pylist()]
            over = [[ids[n] for n, c in f.items() if c >= threshold] for f in found]
            items = [sorted({i for i in x if i is not None}) for x in over]
            new = [
                pa.array([bool(x) for x in over]), pa.array(items, pa.list_(pa.int64())),
                pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *ADDED])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(*kept).mapInArrow(run, ", ".join([*shape, "contaminated boolean", "items array<long>", "coverage double"]))


def by_join(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """The same rows for a benchmark of any size: documents and items meet by a shuffle on seed hashes.

    Both are named by a 128-bit hash of their texts, on which alone a match
    depends; ids may repeat or be null.
    """
    def seed_rows(batch: pa.RecordBatch, name: str) -> dict:
        ids, hashes = [], []
        for i, t in zip(batch.column(name).to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = tokens(t)
            own = {hash_words(words[k : k + n]) for n in range(1, min_match + 1) for k in range(len(words) - n + 1) if n == min_match or name == "doc" or n == len(words)}
            ids += [i] * len(own)
            hashes += own
        return {name: ids, "seed": hashes}

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("text IS NOT NULL").select(F.md5("text").alias(name), "text").dropDuplicates([name])

    texts, items = named(docs, "doc"), named(benchmark, "item")
    left = map_batches(texts, lambda b: seed_rows(b, "doc"), "doc string, seed long")
    right = map_batches(items, lambda b: seed_rows(b, "item"), "item string, seed long")
    pairs = left.join(right, "seed").select("doc", "item").distinct()

    def run(batch: pa.RecordBatch) -> dict:
        shares = []
        for item, t in zip(batch.column("item_text").to_pylist(), batch.column("text").to_pylist(), strict=True):
            shares.append(Seeds([(0, item)], min_match).coverage(tokens(t)).get(0, 0.0))
        return {"doc": batch.column("doc"), "item": batch.column("item"), "share": shares}

    met = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, "doc")
    tiled = map_batches(met, run, "doc string, item string, share double")
    over = F.col("share") >= threshold
    ids = benchmark.where("text IS NOT NULL").groupBy(F.md5("text").alias("item")).agg(F.collect_set(F.col("item_id").cast("long")).alias("ids"))
    found = tiled.join(ids, "item").groupBy("doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(over, F.col("ids")))))).alias("items"), F.max("share").alias("coverage"), F.bool_or(over).alias("contaminated")
    )
    kept = [c for c in docs.columns if c not in ADDED]
    (name,) = fresh([*kept, *ADDED], "doc")
    rows = docs.select(*kept, F.md5("text").alias(name)).join(found.withColumnRenamed("doc", name), name, "left")
    return rows.select(
        *kept, F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def hash_words(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)
