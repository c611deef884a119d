"""N-gram Jaccard join by chosen paths, and its classes of near duplicates.

Texts become sets of hashed five-word shingles, and sets of equal content one
node with a number of copies. Each set has 64 minhash coordinates. In a run,
the root picks coordinates at random (each with probability 1 / (threshold *
64)), and a set follows each picked coordinate into the child that its value
names; only sets that share the value meet there. Buckets with one set end;
small ones are compared by brute force; large ones are split again, by
``PATHS`` random paths of ``STEP`` coordinates. A large bucket whose sets agree
so often that splitting would not thin it (``DENSE``), and what is still large
at ``MAX_DEPTH``, is compared exactly, in blocks, so no bucket is capped. Runs
repeat until the chance that a pair at the threshold never met is below
1 - ``TARGET_RECALL``.

A pair that meets in several buckets is examined in the least of them only,
which both sides can tell from their lists of buckets. It is first held
against its signatures (a pair at the threshold agrees in fewer than
``LEAST_AGREEING`` of 64 coordinates with probability below 1e-8), then
compared exactly on its shingles. Links are counted where they are found and
leave a task as one sum per set plus a spanning forest, never as all pairs.

Edge cases: a text of fewer than five words is one shingle of all its words; a
null text or one without a word is linked to nothing, not even to its like;
repeated rows are copies of each other; rows with a null id are compared like
others, and a class without any id has a null class_id; an empty table gives an
empty result; other columns are ignored by the join and kept by the pipeline stage. Words are
lower-cased runs of letters, digits and underscores. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, fresh, map_batches, table

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
#: Least share of pairs at the threshold that must meet in a bucket.
TARGET_RECALL = 0.9999
MAX_DEPTH = 6
#: Below the root, a bucket is split by so many paths of so many coordinates.
PATHS, STEP = 5, 3
#: A bucket with fewer distinct values in a coordinate, per set, is compared at once.
DENSE = 0.35
#: Buckets up to this size are compared as they are.
BUCKET = 512
#: Shingles that a unit of comparison lays out at once.
SLICE = 1 << 20
LEAST_AGREEING = 30
WORD = re.compile(r"\w+")
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def runs_needed(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs until a pair at the threshold has met with probability ``recall``.

    With a Poisson number of picks (mean 1 / threshold) a pair at the threshold
    shares one child of the root on average; further down it shares each of
    ``PATHS`` children with probability threshold ** STEP.
    """
    p = 1.0
    for _ in range(depth - 1):
        p = 1 - math.exp(-PATHS * threshold**STEP * p)
    p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int = SHINGLE):
        self.words = words
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        known = list(map(self.known.get, words))
        if None in known:
            known = [self.word(w) if h is None else h for w, h in zip(words, known, strict=True)]
        ids = np.array(known, np.uint64)
        n = min(self.words, len(ids))
        m = len(ids) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
            h ^= h >> np.uint64(31)
        return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, key: str) -> DataFrame:
    """(key, text_hash, sid, n, sig): name, size and minhashes of each row's shingle set; a null sid for an empty set."""
    def run(batch: pa.RecordBatch) -> dict:
        shingler = Shingler()
        sets = [shingler(t) for t in batch.column("text").to_pylist()]
        return {
            key: batch.column(key), "text_hash": batch.column("text_hash"), "sid": [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets],
            "n": [len(s) for s in sets], "sig": [signature(s) if len(s) else None for s in sets],
        }

    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, run, f"{key} long, text_hash long, sid binary, n int, sig array<int>")


def root_keys(runs: int, threshold: float, seed: int = 11) -> Column:
    """Names of the buckets that a set enters at the first level of all runs."""
    rng = np.random.default_rng(seed)
    keys = []
    for r in range(runs):
        picked = np.flatnonzero(rng.random(COORDINATES) < 1 / (threshold * COORDINATES))
        keys += [F.xxhash64(F.lit(r), F.lit(int(c)), F.get("sig", F.lit(int(c)))) for c in picked]
    return F.array(*keys)


def child_keys() -> Column:
    """Names of the buckets that a set in bucket ``node`` enters at the next level."""
    def value(path: int, step: int) -> Column:
        return F.get("sig", F.pmod(F.xxhash64("node", F.lit(path), F.lit(step)), F.lit(COORDINATES)).cast("int"))

    return F.array(*(F.xxhash64("node", F.lit(p), *(value(p, k) for k in range(STEP))) for p in range(PATHS)))


def buckets(sets: DataFrame, threshold: float, runs: int, depth: int, limit: int) -> DataFrame:
    """(node, sid, blocks): members of the buckets to compare; more than one block only for large ones."""
    members = sets.select("sid", F.explode(root_keys(runs, threshold)).alias("node"))
    found = None

    def settle(rows: DataFrame) -> None:
        nonlocal found
        rows = rows.select("node", "sid", F.greatest(F.lit(1), F.ceil(F.col("size") / limit)).cast("int").alias("blocks"))
        found = rows if found is None else found.unionByName(rows)

    for level in range(1, depth + 1):
        shared = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        level_members = cut(members.join(shared, "node"))
        if level == depth:
            settle(level_members)
            break
        settle(level_members.where(F.col("size") <= limit))
        large = level_members.where(F.col("size") > limit)
        if large.isEmpty():
            break
        signed_members = cut(large.join(sets.select("sid", "sig"), "sid"))
        kinds = [F.approx_count_distinct(F.get("sig", F.lit(c))) for c in (5, 23, 41, 59)]
        spread = sum(kinds[1:], kinds[0]) / (len(kinds) * F.count("*"))
        dense = signed_members.groupBy("node").agg((spread < DENSE).alias("dense"))
        judged = signed_members.join(dense, "node")
        settle(judged.where("dense"))
        members = judged.where("NOT dense").select("sid", F.explode(child_keys()).alias("node")).distinct()
    return found


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' starts (and the end), from batches sorted by ``key``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        k = t.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        if starts[-1]:
            yield t.slice(0, starts[-1]), starts
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def first_meetings(node: int, own: list, sides: np.ndarray) -> np.ndarray:
    """Pairs (as a square matrix) of members of one unit that meet in no lesser bucket.

    ``sides`` is 0 or 1 where a unit compares two blocks with each other, else -1.
    """
    g = len(own)
    fresh = np.ones((g, g), bool)
    holders: dict[int, list[int]] = {}
    for i, nodes in enumerate(own):
        for v in nodes[: np.searchsorted(nodes, node)].tolist():
            holders.setdefault(v, []).append(i)
    for at in holders.values():
        if len(at) > 1:
            fresh[np.ix_(at, at)] = False
    fresh &= np.triu(np.ones((g, g), bool), 1) if sides[0] < 0 else sides[:, None] < sides[None, :]
    return fresh


def candidates(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(unit, sid, partners): for every unit of comparison, the sets with a pair that may be similar; partners are sids end to end."""
    own = members.groupBy("sid").agg(F.sort_array(F.collect_list("node")).alias("own"), F.collect_list(F.struct("node", "blocks")).alias("in"))
    rows = own.join(sets.select("sid", "sig"), "sid").withColumn("at", F.explode("in")).drop("in")
    rows = rows.select("sid", "sig", "own", F.col("at.node").alias("node"), F.col("at.blocks").alias("blocks"))
    block = F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select("sid", "sig", "own", "node", F.when(F.col("blocks") == 1, F.col("node")).otherwise(F.xxhash64("node", lo, hi)).alias("unit"), F.when(lo == hi, -1).otherwise((F.col("block") > lo).cast("int")).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "unit"):
            sids = t.column("sid").to_pylist()
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            own = t.column("own").combine_chunks()
            values, offsets = own.values.to_numpy(), own.offsets.to_numpy()
            nodes, units, sides = (t.column(c).to_numpy() for c in ("node", "unit", "side"))
            out_unit, out_sid, out_partners = [], [], []
            for a, b in zip(starts[:-1].tolist(), [*starts[1:].tolist(), len(sids)][: len(starts) - 1], strict=True):
                if b - a < 2:
                    continue
                s = sig[a:b]
                if b - a == 2:
                    agree = int((s[0] == s[1]).sum()) >= least
                    if not agree:
                        continue
                lists = [values[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                fresh = first_meetings(nodes[a], lists, sides[a:b])
                partners: dict[int, list[bytes]] = {}
                for i in range(b - a):
                    js = np.flatnonzero(fresh[i])
                    if len(js):
                        js = js[(s[js] == s[i]).sum(axis=1) >= least]
                        if len(js):
                            partners.setdefault(i, []).extend(sids[a + j] for j in js.tolist())
                            for j in js.tolist():
                                partners.setdefault(j, [])
                for i, found in partners.items():
                    out_unit.append(units[a])
                    out_sid.append(sids[a + i])
                    out_partners.append(b"".join(found))
            if out_sid:
                yield pa.RecordBatch.from_arrays([pa.array(out_unit, pa.int64()), pa.array(out_sid, pa.binary()), pa.array(out_partners, pa.binary())], names=["unit", "sid", "partners"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit long, sid binary, partners binary")


def similar_pairs(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ``pairs`` (rows of two positions) have at least the threshold's similarity."""
    sizes = np.array([len(s) for s in sets])
    if len(pairs) <= 12:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    else:
        total = np.zeros((len(sets), len(sets)), np.float32)
        # Shingles are counted by slices of their hashes, so that memory is bounded.
        slices = int(sizes.sum()) // SLICE + 1
        for part in range(slices):
            own = [s[s % np.uint64(slices) == part] for s in sets] if slices > 1 else sets
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in own])
            _, column, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            shared = counts[column] > 1
            owner, column = owner[shared], column[shared]
            names, column = np.unique(column, return_inverse=True)
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            for first in range(0, len(names), 2048):
                lo, hi = np.searchsorted(column, [first, first + 2048])
                m = np.zeros((len(sets), 2048), np.float32)
                m[owner[lo:hi], column[lo:hi] - first] = 1
                total += m @ m.T
        common = total[pairs[:, 0], pairs[:, 1]]
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common
    return common >= threshold * union - 1e-9


def local_pairs(names: np.ndarray, partners: list[bytes]) -> np.ndarray:
    """Distinct pairs of positions in the sorted ``names`` from each name's partners, which are end to end."""
    first = np.repeat(np.arange(len(names)), [len(p) // 16 for p in partners])
    other = np.frombuffer(b"".join(partners), "S16")
    second = np.minimum(np.searchsorted(names, other), len(names) - 1)
    known = names[second] == other
    if not known.any():
        return np.empty((0, 2), np.int64)
    keys = np.unique(first[known] * len(names) + second[known])
    return np.stack([keys // len(names), keys % len(names)], axis=1)


def links(found: DataFrame, sets: DataFrame, docs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, weight): per set the copies of similar sets (b null), and forest edges a - b (weight 0)."""
    # A set of which every copy has a null id is found by its text; of equal texts one is sent.
    at, by_text = F.coalesce("rep", "unnamed").alias("at"), F.col("rep").isNull().alias("by_text")
    wanted = found.groupBy("sid").agg(F.collect_list(F.struct("unit", "partners")).alias("units")).join(sets.select("sid", at, by_text, "copies"), "sid")
    own = F.col(key).cast("long")
    named = docs.where(own.isNotNull()).select(own.alias("at"), F.lit(False).alias("by_text"), "text")
    nameless = docs.where(own.isNull()).select(F.xxhash64("text").alias("at"), F.lit(True).alias("by_text"), "text").distinct()
    texts = named.unionByName(nameless).join(wanted, ["at", "by_text"])

    def shingles(batch: pa.RecordBatch) -> dict:
        shingler = Shingler()
        out: dict[str, list] = {c: [] for c in ("unit", "sid", "copies", "partners", "shingles")}
        for text, sid, copies, units in zip(*(batch.column(c).to_pylist() for c in ("text", "sid", "copies", "units")), strict=True):
            data = shingler(text).tobytes()
            if xxhash.xxh128_digest(data) != sid:
                continue  # another row with the same id
            for u in units:
                for c, v in zip(out, (u["unit"], sid, copies, u["partners"], data), strict=True):
                    out[c].append(v)
        return out

    rows = map_batches(texts, shingles, "unit long, sid binary, copies long, partners binary, shingles binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "unit"):
            sids, copies = t.column("sid").to_pylist(), t.column("copies").to_numpy()
            partners, data = t.column("partners").combine_chunks(), t.column("shingles").combine_chunks()
            out: list[tuple] = []
            for a, b in zip(starts[:-1].tolist(), [*starts[1:].tolist(), len(sids)][: len(starts) - 1], strict=True):
                # A row repeated in the input comes more than once.
                names, at = np.unique(np.array(sids[a:b], "S16"), return_index=True)
                at = (at + a).tolist()
                pairs_array = local_pairs(names, [partners[i].as_py() for i in at])
                if not len(pairs_array):
                    continue
                ok = pairs_array[similar_pairs([np.frombuffer(data[i].as_buffer(), np.uint64) for i in at], pairs_array, threshold)]
                names = [sids[i] for i in at]
                weights = np.zeros(len(names), np.int64)
                count = copies[at]
                np.add.at(weights, ok[:, 0], count[ok[:, 1]])
                np.add.at(weights, ok[:, 1], count[ok[:, 0]])
                out += [(names[i], None, int(w)) for i, w in enumerate(weights.tolist()) if w]
                parent = list(range(len(names)))
                for i, j in ok.tolist():
                    while parent[i] != i:
                        parent[i] = i = parent[parent[i]]
                    while parent[j] != j:
                        parent[j] = j = parent[parent[j]]
                    if i != j:
                        parent[max(i, j)] = min(i, j)
                        out.append((names[i], names[j], 0))
            if out:
                a_, b_, w_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary()), pa.array(w_, pa.int64())], names=["a", "b", "weight"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a binary, b binary, weight long")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b), by alternating large-star and small-star steps."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        mark = now


def classes_of(docs: DataFrame, *, key: str = "doc_id", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, depth: int = MAX_DEPTH, limit: int = BUCKET) -> DataFrame:
    """(key, text_hash, root, class_id, n_links) per row; ``root`` is the class, null for a row without shingles."""
    rows = cut(signed(docs, key))
    sets = cut(rows.where("sid IS NOT NULL").groupBy("sid", "n", "sig").agg(F.min(key).alias("rep"), F.min(F.when(F.col(key).isNull(), F.col("text_hash"))).alias("unnamed"), F.count("*").alias("copies")))
    least = LEAST_AGREEING if threshold >= 0.75 else 0
    members = buckets(sets, threshold, runs_needed(threshold, recall, depth), depth, limit)
    found = cut(links(candidates(members, sets, least), sets, docs, key, threshold))
    weights = found.where("b IS NULL").groupBy(F.col("a").alias("sid")).agg(F.sum("weight").alias("weight"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = sets.select("sid", "rep", "copies").join(roots.withColumnRenamed("vertex", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = placed.join(classes, "root").join(weights, "sid", "left").select("sid", "root", "class_id", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    both = rows.select(key, "text_hash", "sid").join(named, "sid", "left")
    return both.select(key, "text_hash", "root", F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(key, class_id, n_links) per row: the least key of its class, and how many other rows are similar to it."""
    return classes_of(docs, **options).drop("text_hash", "root")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every class; of repeated rows one."""
    placed = classes_of(docs)
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("rows"))
    alone = placed.where("root IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")).distinct()
    own, hashed, rows = fresh(docs.columns, "kept_id", "kept_hash", "rows")
    keep = first.select("first.*", "rows").unionByName(alone).withColumnsRenamed({"doc_id": own, "text_hash": hashed, "rows": rows})
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(hashed))).drop(own, hashed)
    # Only in a class of several rows can the kept row be there twice.
    single = kept.where(F.col(rows) == 1).drop(rows)
    repeated = kept.where(F.col(rows) > 1).drop(rows).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
