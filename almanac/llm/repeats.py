"""Exact removal of long repeated byte strings by a distributed suffix sort.

Every byte covered by a ``WINDOW``-byte string that starts anywhere else in the
collection is removed.

Anchors. Only suffixes at anchors are sorted. An anchor is a position whose
hash is least among ``SPAN`` neighbours, so each window holds one with at least
``PREFIX`` of its bytes to the right, at the same place in equal windows. Two
anchors with equal text of L bytes to the left and R to the right, L + R >=
WINDOW, cover a - L .. a + R, and every repeated window is found at its anchor.

Filter. An anchor whose prefix hash occurs once is dropped. One whose whole
context (up to WINDOW - PREFIX bytes left, WINDOW right) occurs again is
settled: all of the context goes. One anchor stands for each distinct context.

Merge sort. A task sorts its suffixes into runs, front-codes them (bytes shared
with the suffix before are left out) and deals them to ranges by prefix hash.
A range combines its runs with a loser tree that carries each head's known
common prefix with the last winner, so that bytes known to be equal are never
compared again. The common prefixes of neighbours come out with the order, and
groups that share a right side of length R are searched for their longest
common left sides by sorting those.

A prefix in more than ``HOT`` anchors is not merged in one range: the windows
around the anchors that stand for its contexts are counted by a 128-bit hash
with partial sums before the shuffle, which is as exact and spreads over all
tasks. Joins that bring counts back to anchors have plain exchanges on both
sides, so that Spark can split the partition of a hot prefix, context or window.

Edge cases: a null text counts as empty; texts shorter than a window stay
whole; repeated rows are copies of each other; rows that share an id but not
the text are kept apart; a null id is an id like others, as rows are named by
their texts then; an empty table gives an empty result; other columns are
ignored. Texts are treated whole, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, map_batches, release, table
from almanac.llm.nearjoin import groups

WINDOW = 400
PREFIX = 256
#: Start positions that an anchor's hash is compared over.
SPAN = WINDOW - PREFIX + 1
LEFT = WINDOW - PREFIX
#: Anchors with one prefix beyond which windows are counted instead of merged.
HOT = 20_000
#: Bytes of suffixes that a task sorts into one run, and that a range should hold.
RUN_BYTES = 24 << 20
RANGE_BYTES = 12 << 20
TOP = np.uint64(2**64 - 1)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    step = np.minimum if least else np.maximum
    m = len(values)
    blocks = -(-m // width)
    padded = np.full(blocks * width, TOP if least else np.uint64(0))
    padded[:m] = values
    square = padded.reshape(blocks, width)
    ahead = step.accumulate(square, axis=1).ravel()
    back = step.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return step(back[: m - width + 1], ahead[width - 1 : m])


def anchors(data: bytes) -> np.ndarray:
    """Positions of the anchors of all windows of ``data``."""
    m = len(data) - PREFIX + 1
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (m, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = words * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = sliding(h, SPAN, True)
    padded = np.zeros(len(low) + 2 * (SPAN - 1), np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(low)] = low
    return np.flatnonzero(sliding(padded, SPAN, False) == h)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(prefix, context, doc_id, place): an anchor with the hashes of its prefix and context; place = offset << 32 | tag."""
    def run(batch: pa.RecordBatch) -> dict:
        prefixes, contexts, ids, places = [], [], [], []
        digest = xxhash.xxh64_intdigest
        for i, tag, data in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("data").to_pylist(), strict=True):
            at = anchors(data or b"").tolist()
            if at:
                view = memoryview(data)
                prefixes += [digest(view[a : a + PREFIX]) for a in at]
                contexts += [digest(view[max(0, a - LEFT) : a + WINDOW], min(a, LEFT)) for a in at]
                ids += [i] * len(at)
                places += [a << 32 | tag for a in at]
        return {"prefix": np.array(prefixes, np.uint64).view(np.int64), "context": np.array(contexts, np.uint64).view(np.int64), "doc_id": ids, "place": places}

    return map_batches(docs.select("doc_id", "tag", "data"), run, "prefix long, context long, doc_id long, place long")


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    end = min(at + step, n)
    while end - at > 1:
        middle = (at + end) // 2
        if a[at:middle] == b[at:middle]:
            at = middle
        else:
            end = middle
    return at


# An entry: suffix (prefix hash and right side), left side reversed, doc_id, place, wanted.
Entry = tuple[bytes, bytes, int, int, int]


def front_code(entries: list[Entry]) -> bytes:
    """A sorted run without the bytes that each suffix shares with the one before."""
    shared, last = [], b""
    for e in entries:
        shared.append(common(last, e[0], 0))
        last = e[0]
    arrays = [
        np.array(shared, np.uint16), np.array([len(e[0]) for e in entries], np.uint16), np.array([len(e[1]) for e in entries], np.uint16),
        np.array([e[2] for e in entries], np.int64), np.array([e[3] for e in entries], np.int64), np.array([e[4] for e in entries], np.uint8),
    ]
    rests = b"".join(e[0][s:] for e, s in zip(entries, shared, strict=True))
    return b"".join([struct.pack("<q", len(entries)), *(a.tobytes() for a in arrays), rests, *(e[1] for e in entries)])


def decode(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(common prefix with the entry before, entry) of a front-coded run."""
    (n,) = struct.unpack_from("<q", run)
    at, arrays = 8, []
    for kind in (np.uint16, np.uint16, np.uint16, np.int64, np.int64, np.uint8):
        arrays.append(np.frombuffer(run, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    shared, lengths, lefts, ids, places, wanted = arrays
    side = at + sum(lengths) - sum(shared)
    last = b""
    for k in range(n):
        rest = lengths[k] - shared[k]
        last = last[: shared[k]] + run[at : at + rest]
        at += rest
        yield shared[k], (last, run[side : side + lefts[k]], ids[k], places[k], wanted[k])
        side += lefts[k]


def merge(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """Combine front-coded runs by a loser tree; yields (common prefix with the entry before, entry)."""
    sources = [decode(r) for r in runs]
    size = 1
    while size < len(sources):
        size *= 2
    heads: list[Entry | None] = [None] * size
    known = [0] * size  # common prefix of each head with the last winner
    for i, s in enumerate(sources):
        known[i], heads[i] = 0, next(s, (0, None))[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:  # who shares more with the last winner comes first
            return (a, b) if known[a] > known[b] else (b, a)
        c = common(x[0], y[0], known[a])
        if x[0][c : c + 1] < y[0][c : c + 1] or (x[0][c : c + 1] == y[0][c : c + 1] and a < b):
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    losers = [0] * size
    level = list(range(size))
    first = size
    while len(level) > 1:
        first //= 2
        results = [play(level[2 * k], level[2 * k + 1]) for k in range(len(level) // 2)]
        losers[first : 2 * first] = [loser for _, loser in results]
        level = [winner for winner, _ in results]
    winner = level[0]
    while heads[winner] is not None:
        yield known[winner], heads[winner]
        known[winner], heads[winner] = next(sources[winner], (0, None))
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def matched(group: list[Entry], shared: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, place, L, R): maximal matches around wanted anchors of entries that share their prefix.

    ``shared`` holds each entry's common prefix with the one before.
    """
    stack = [(0, len(group))]
    while stack:
        lo, hi = stack.pop()
        inner = shared[lo + 1 : hi]
        depth = min(inner)
        right = depth - 8
        if right + LEFT >= WINDOW:
            order = sorted(range(lo, hi), key=lambda i: group[i][1])
            near = [common(group[a][1], group[b][1], 0) for a, b in zip(order, order[1:], strict=False)]
            for k, i in enumerate(order):
                left = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
                if group[i][4] and left + right >= WINDOW:
                    yield group[i][2], group[i][3], left, right
        start = lo
        for k, c in enumerate(inner, lo + 1):
            if c == depth:
                if k - start > 1:
                    stack.append((start, k))
                start = k
        if start > lo and hi - start > 1:
            stack.append((start, hi))


def sorted_runs(kept: DataFrame, ranges: int) -> DataFrame:
    """(range, run): front-coded sorted runs of the suffixes that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            numbers = sorted(held)
            coded = [front_code(sorted(held[r])) for r in numbers]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(coded, pa.binary())], names=["range", "run"])

        for batch in batches:
            for i, tag, packed, sends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "packed", "sends")), strict=True):
                if not sends:
                    continue
                data = zstandard.decompress(packed)
                for code in sends:
                    a, wanted = code >> 1, code & 1
                    h = xxhash.xxh64_intdigest(data[a : a + PREFIX])
                    held.setdefault(h % ranges, []).append((h.to_bytes(8) + data[a : a + WINDOW], data[max(0, a - LEFT) : a][::-1], i, a << 32 | tag, wanted))
                    size += WINDOW + LEFT
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return kept.mapInArrow(run, "range int, run binary")


def merged_spans(runs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, tag, start, stop) of the matches that the merged ranges show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "range"):
            coded = t.column("run").to_pylist()
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip(starts[:-1].tolist(), [*starts[1:].tolist(), len(coded)][: len(starts) - 1], strict=True):
                group: list[Entry] = []
                shared: list[int] = []
                for c, entry in merge(coded[a:b]):
                    if c < 8 + PREFIX and group:
                        if len(group) > 1:
                            out += spans_of(group, shared)
                        group, shared = [], []
                    group.append(entry)
                    shared.append(c)
                if len(group) > 1:
                    out += spans_of(group, shared)
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "tag", "start", "stop"])

    dealt = runs.repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "doc_id long, tag long, start int, stop int")


def spans_of(group: list[Entry], shared: list[int]) -> list[tuple[int, int, int, int]]:
    return [(i, place & 0xFFFFFFFF, (place >> 32) - left, (place >> 32) + right) for i, place, left, right in matched(group, shared)]


def counted_spans(kept: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop) of the repeated windows around hot anchors; an anchor for each context takes part, which is all that unsettled ones can match."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("low", "high", "doc_id", "tag", "start")}
        for i, tag, packed, hot in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "packed", "hot")), strict=True):
            if hot:
                data = memoryview(zstandard.decompress(packed))
                for p in sorted({p for a in hot for p in range(max(0, a - LEFT), min(a, len(data) - WINDOW) + 1)}):
                    low, high = struct.unpack("<qq", xxhash.xxh128_digest(data[p : p + WINDOW]))
                    for c, v in zip(out, (low, high, i, tag, p), strict=True):
                        out[c].append(v)
        return out

    windows = map_batches(kept.where("size(hot) > 0").select("doc_id", "tag", "packed", "hot"), run, "low long, high long, doc_id long, tag long, start int")
    twice = cut(windows.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return counted(windows, twice, "low", "high").select("doc_id", "tag", "start", (F.col("start") + WINDOW).alias("stop"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def shared_anchors(rows: DataFrame) -> DataFrame:
    """The anchors whose prefix occurs more than once, with how often it does and whether its contexts differ."""
    places = anchor_rows(rows)
    often = cut(places.groupBy("prefix").agg(F.count("*").alias("total"), (F.min("context") != F.max("context")).alias("varied")).where("total > 1"))
    return cut(counted(places, often, "prefix"))


def counted(rows: DataFrame, counts: DataFrame, key: str, *more: str, how: str = "inner") -> DataFrame:
    """Join ``counts`` to ``rows`` on ``key`` and ``more``.

    The complement of the key is joined on, so that counts which are already
    dealt by the key itself get an exchange of their own: only between two
    plain exchanges does Spark split the partition of a hot key.
    """
    other = counts.withColumn("_key", F.bitwise_not(key)).drop(key)
    return rows.withColumn("_key", F.bitwise_not(key)).join(other, ["_key", *more], how).drop("_key")


def marked_texts(rows: DataFrame, hot: int) -> DataFrame:
    """(doc_id, tag, settled, sends, hot, packed) of rows with shared anchors: offsets to settle, to compare, to count, and the text."""
    shared = shared_anchors(rows)
    contexts = shared.groupBy("prefix", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    contexts = cut(contexts.where("n > 1").select("prefix", "context", "first", F.lit(True).alias("settled")))
    marked = counted(shared, contexts, "context", "prefix", how="left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    stands = ~F.col("settled") | (F.col("first") == F.struct("doc_id", "place"))
    offset = F.shiftright("place", 32).cast("int")
    is_hot = F.col("total") > hot
    per_doc = marked.groupBy("doc_id", F.col("place").bitwiseAND(0xFFFFFFFF).alias("tag")).agg(
        F.collect_set(F.when(F.col("settled"), offset)).alias("settled"),
        F.collect_set(F.when(F.col("varied") & stands & ~is_hot, offset * 2 + F.when(F.col("settled"), 0).otherwise(1))).alias("sends"),
        F.collect_set(F.when(F.col("varied") & stands & is_hot, offset)).alias("hot"),
    )
    met = rows.join(per_doc, ["doc_id", "tag"])

    def pack(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return {c: batch.column(c) for c in ("doc_id", "tag", "settled", "sends", "hot")} | {"packed": [squeeze(d) for d in batch.column("data").to_pylist()]}

    return cut(map_batches(met, pack, "doc_id long, tag long, settled array<int>, sends array<int>, hot array<int>, packed binary"))


def repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, tag, settled, spans, packed) of each distinct row with shared anchors; ``tag`` tells rows with one id apart."""
    rows = docs.select(named(key, text).alias("doc_id"), F.col(text).cast("binary").alias("data")).withColumn("tag", tag_of(F.col("data")))
    kept = marked_texts(rows, hot)
    release(docs.sparkSession)
    sent, heated = kept.agg(F.sum(F.size("sends")), F.sum(F.size("hot"))).first()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sent or 0) * (WINDOW + LEFT) // RANGE_BYTES + 1)
    spans = merged_spans(sorted_runs(kept, ranges), ranges)
    if heated:
        spans = spans.unionByName(counted_spans(kept))
    found = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return kept.dropDuplicates(["doc_id", "tag"]).join(found, ["doc_id", "tag"], "left").select("doc_id", "tag", "settled", "spans", "packed")


def named(key: str, text: str) -> Column:
    """The id of a row, or for a null id 60 bits of another hash of its text, so that joins find it."""
    own = F.conv(F.substring(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))), 1, 15), 16, 10).cast("long")
    return F.coalesce(F.col(key).cast("long"), own)


def tag_of(data: Column) -> Column:
    """32 bits of a text's hash."""
    return F.xxhash64(data).bitwiseAND(0xFFFFFFFF)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row; ``kept`` holds the remaining bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "sha", "kept")}
        for packed, settled, spans in zip(*(batch.column(c).to_pylist() for c in ("packed", "settled", "spans")), strict=True):
            data = zstandard.decompress(packed)
            whole = [(max(0, a - LEFT), min(len(data), a + WINDOW)) for a in settled]
            gone = union(whole + [(s["start"], s["stop"]) for s in spans or ()])
            edges = [0, *(e for span in gone for e in span), len(data)]
            left = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            for c, v in zip(out, (len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), **out}

    found = map_batches(repeated(docs, key=key, text=text, hot=hot), run, "doc_id long, tag long, n_removed long, n_spans long, sha string, kept binary")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).cast("long").alias("_key"), named(key, text).alias("doc_id"), tag_of(F.col(text).cast("binary")).alias("tag"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("own"), *([data.alias("all")] if with_text else []))
    out = rows.join(found, ["doc_id", "tag"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"), *([F.coalesce("kept", "all").alias("kept")] if with_text else []),
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
