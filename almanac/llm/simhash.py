"""SimHash near duplicates, found with BK-trees.

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the
hashes of its shingles of ``SHINGLE`` words, repeats included. Texts link where
their fingerprints differ in at most ``RADIUS`` bits.

Only distinct fingerprints are compared. Two that link agree in one of
``RADIUS`` + 1 blocks of their bits, so each fingerprint goes to one shard per
block, with those that have the same bits there. A shard of more than ``LIMIT``
is split again by the bits that are not yet used, in the same way and still
exactly, up to ``DEPTH`` times; what is larger then is compared in pairs of
blocks of ``LIMIT``. So no shard is larger than twice the limit, and none grows
with the data. The trees are not sent to all executors, as their size has no
bound: a shard's queries are its own fingerprints, and meet its tree in one task.

In a shard a BK-tree holds the fingerprints: the children of a node are keyed by
their distance to it, and a query at distance d follows only the edges from
d - radius to d + radius. Fingerprints that a query finds leave the tree and
become the next queries. Thus every fingerprint is found once, and a group of
many near copies costs one query and leaves a tree of links, not all pairs.
Links become components by large-star and small-star steps.

Edge cases: words are what is between ASCII white space, with A-Z lower-cased; a
text of one to three words is one shingle; a null text and one without words has
fingerprint zero, and links like any other; repeated rows and ids come back as
often as they came; rows with a null id take part, and a component of such rows
alone has a null component_id; texts are read whole, in parts; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, map_batches, slices, table
from almanac.llm.nearjoin import components, groups

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Distinct fingerprints that are compared in one tree; at most twice as many where blocks meet.
LIMIT = 2048
DEPTH = 3
BITS = 64
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def hashes(text: str | None, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, part by part."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes, so A-Z only
    rest: list[bytes] = []
    some = False
    for part in slices(data, BLANK):
        found = rest + part.split()
        if len(found) >= words:
            some = True
            ends = list(accumulate(len(w) + 1 for w in found))
            joined = b" ".join(found)
            starts = [0, *ends[: len(found) - words]]
            yield np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)], np.uint64)
        rest = found[-(words - 1) :] if words > 1 else []
    if rest and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(rest), SEED)], np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in hashes(text, words):
        n += len(h)
        for at in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) of each row; fp as a signed long."""
    def run(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(key), "fp": np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, fp long")


class BKTree:
    """Numbers under the Hamming distance; what is found is taken out."""

    def __init__(self, points: list[int]):
        self.points = points
        self.children: list[dict[int, int]] = [{} for _ in points]
        self.above = [-1] * len(points)
        self.inside = [True] * len(points)
        #: How many of a node and those below it are still there.
        self.left = [1] * len(points)
        for new in range(1, len(points)):
            node = 0
            while True:
                self.left[node] += 1
                d = (points[node] ^ points[new]).bit_count()
                below = self.children[node].setdefault(d, new)
                if below == new:
                    self.above[new] = node
                    break
                node = below

    def take(self, query: int, radius: int) -> list[int]:
        """Take out and return the positions of the points within ``radius``."""
        found, open_nodes = [], [0]
        while open_nodes:
            node = open_nodes.pop()
            d = (self.points[node] ^ query).bit_count()
            if d <= radius and self.inside[node]:
                found.append(node)
                self.inside[node] = False
                at = node
                while at >= 0:
                    self.left[at] -= 1
                    at = self.above[at]
            for k, below in self.children[node].items():
                if -radius <= k - d <= radius and self.left[below]:
                    open_nodes.append(below)
        return found


def forest(points: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all distinct ``points`` that are connected by links of up to ``radius``."""
    if len(points) == 2:
        return [(points[0], points[1])] if (points[0] ^ points[1]).bit_count() <= radius else []
    tree, out = BKTree(points), []
    for start in range(len(points)):
        if tree.inside[start]:
            queue = [start]
            while queue:
                p = queue.pop()
                for f in tree.take(points[p], radius):
                    if f != p:
                        out.append((points[p], points[f]))
                        queue.append(f)
    return out


def masks(path: tuple[int, ...], radius: int) -> list[int]:
    """The ``radius`` + 1 blocks of the bits that the blocks of ``path`` leave."""
    bits = list(range(BITS))
    for taken in (*path, None):
        blocks = [bits[k * len(bits) // (radius + 1) : (k + 1) * len(bits) // (radius + 1)] for k in range(radius + 1)]
        if taken is not None:
            bits = [b for k, block in enumerate(blocks) for b in block if k != taken]
    return [sum(1 << b for b in block) for block in blocks]


def block_keys(level: int, radius: int) -> Column:
    """(path, node) of the shards at ``level`` of a fingerprint, below the shard with number ``path`` at the level above."""
    fan = radius + 1
    paths = [()]
    for _ in range(level - 1):
        paths = [(*p, k) for p in paths for k in range(fan)]
    flat = np.array([m for p in paths for m in masks(p, radius)], np.uint64).view(np.int64).tolist()
    number = [F.col("path") * fan + k for k in range(fan)]
    lookup = F.array(*(F.lit(m) for m in flat))
    return F.array(*(F.struct(n.cast("int").alias("path"), F.xxhash64(F.lit(level), n, F.col("fp").bitwiseAND(F.get(lookup, n))).alias("node")) for n in number))


def shards(fps: DataFrame, radius: int, limit: int, depth: int) -> DataFrame:
    """(unit, fp): the distinct fingerprints that are compared together."""
    rows, found = fps.select("fp", F.lit(0).alias("path")), None
    for level in range(1, depth + 1):
        members = rows.withColumn("at", F.explode(block_keys(level, radius))).select("fp", "at.path", "at.node")
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        placed = cut(members.join(sizes, "node"))
        own = placed.where(F.col("size") <= limit).select(F.col("node").alias("unit"), "fp")
        found = own if found is None else found.unionByName(own)
        large = placed.where(F.col("size") > limit)
        if level == depth:
            blocks = F.ceil(F.col("size") / limit).cast("int")
            dealt = large.withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            return found.unionByName(dealt.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "fp"))
        if large.isEmpty():
            return found
        rows = large.select("fp", "path")
    return found


def links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct fingerprints ``fp``, with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "unit"):
            values = (t.column("fp").to_numpy().view(np.uint64)).tolist()
            ends = [*starts[1:].tolist(), len(values)][: len(starts)]
            out: list[tuple[int, int]] = []
            for a, b in zip(starts.tolist(), ends, strict=True):
                if b - a > 1:
                    out += forest(list(dict.fromkeys(values[a:b])), radius)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return shards(fps, radius, limit, depth).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, *, key: str = "doc_id", radius: int = RADIUS, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(key, fp, component_id) per row: the fingerprint and the least key of the component."""
    rows = cut(fingerprints(docs, key))
    fps = cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(fps, radius, limit, depth))
    placed = fps.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(key, "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
