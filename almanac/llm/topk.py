"""Exact top-k search with an impact-ordered index, score at a time.

Vectors become integers floor(scale * x). Rows are dealt into shards of at
most about ``SHARD_ROWS``; a shard's index holds the postings of all
components in segments by quantised impact: segment b has the entries with
2^b <= |value| < 2^(b+1), laid out for the rows and components that have any,
and with it the norm of what each row has in lesser segments. A block of
queries adds the segments to its scores by descending impact. After each, a
query's norm times the norm of what a row still has bounds what is to come;
once the bound proves all but a few rows out of a query's best k, the query
stops, and these possible members are rescored exactly. Ties at the k-th score
are possible members too.

Blocks of queries meet all shards in an equi-join on the shard's number, a
block per row, so a task's memory is one shard and one block. Each meeting
leaves k rows a query, and a window keeps the best k (partial top-k before the
shuffle). A shard is read by every block: the work is queries times rows at
most, less what the bounds save.

Integers are kept exact: scores are sums of products in float64 while their
bound is below 2^53, else in Python integers, without early stops.

Edge cases: null vectors and vectors with null or non-finite components take no
part, nor do vectors whose length differs from the query's; vectors without
components score 0 with each other; a component whose scaled value is beyond
the largest double counts as that, and a score beyond the range of a long as
its end; a query with fewer than k candidates gets all of them; ties go to the
smaller id; repeated ids are separate candidates for other queries and no
candidates of their own id, and query rows that share an id are ranked
together as one query; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.common import table

K = 5
SCALE = 256
SHARD_ROWS = 4096
BLOCK_ROWS = 512


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def packed(rows: DataFrame, key: str, vector: str, counts: DataFrame, name: str) -> DataFrame:
    """(width, name, ids, flat): rows of one width in the blocks that ``counts`` gives it, dealt by a hash of the key."""
    sized = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.size(vector).alias("width"))
    dealt = sized.join(F.broadcast(counts), "width").withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.col(f"{name}s")).cast("int"))
    return dealt.groupBy("width", name).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("width", name, F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def per_width(rows: DataFrame, vector: str, per_block: int, name: str) -> DataFrame:
    """(width, names): how many blocks the rows of each width make; a row per width."""
    return rows.groupBy(F.size(vector).alias("width")).agg(F.ceil(F.count("*") / per_block).cast("int").alias(f"{name}s"))


def whole_numbers(flat: np.ndarray, rows: int, width: int, scale: int) -> np.ndarray:
    largest = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -largest, largest).reshape(rows, width)


def segments(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Posting segments by descending impact: (rows, components, entries, norm of each row's lesser entries)."""
    level = np.frexp(np.abs(x))[1]
    rest = (x * x).sum(axis=1)
    out = []
    for b in sorted(set(level[x != 0].tolist()), reverse=True):
        part = np.where((level == b) & (x != 0), x, 0.0)
        rest = rest - (part * part).sum(axis=1)
        rows, components = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
        out.append((rows, components, np.ascontiguousarray(part[np.ix_(rows, components)].T), np.sqrt(np.maximum(rest, 0))))
    return out


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best ``k`` (query, id, score) of one shard for every query of one block."""
    top = [float(np.abs(m).max(initial=0)) for m in (queries, rows)]
    exact = top[0] * top[1] * max(1, queries.shape[1]) < 2**53
    candidates = query_ids[:, None] != ids[None, :]
    possible = [np.flatnonzero(c) for c in candidates]
    n = min(k, len(rows))
    if exact:
        active, scores = np.arange(len(queries)), np.zeros((len(queries), len(rows)))
        norms = np.sqrt((queries * queries).sum(axis=1))
        for at, components, entries, rest in segments(rows):
            scores[:, at] += queries[np.ix_(active, components)] @ entries
            slack = norms[active, None] * rest[None, :] * (1 + 1e-9) + 1e-6
            low = np.where(candidates[active], scores - slack, -np.inf)
            floor = np.partition(low, len(rows) - n, axis=1)[:, len(rows) - n]
            open_rows = candidates[active] & (scores + slack >= floor[:, None])
            done = open_rows.sum(axis=1) <= 4 * n
            for q in np.flatnonzero(done).tolist():
                possible[active[q]] = np.flatnonzero(open_rows[q])
            active, scores = active[~done], scores[~done]
            if not len(active):
                break
        for q, own in zip(active.tolist(), scores, strict=True):  # many ties: all segments are added, so scores are whole
            near = np.where(candidates[q], own, -np.inf)
            possible[q] = np.flatnonzero(candidates[q] & (near >= np.partition(near, len(rows) - n)[len(rows) - n]))
    out = []
    for q, at in enumerate(possible):
        if exact:
            found = [int(s) for s in rows[at] @ queries[q]]
        else:
            own = [int(v) for v in queries[q]]
            found = [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, rows[r], strict=True)))) for r in at]
        best = sorted(zip([-s for s in found], ids[at].tolist(), strict=True))[:k]
        out += [(int(query_ids[q]), i, -s) for s, i in best]
    return out


def top_k(rows: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, key, score): for each row with ``is_query``, its ``k`` best other rows by integer inner product."""
    valid = rows.where(usable(vector) & F.col(key).isNotNull())
    n_shards = per_width(valid, vector, shard_rows, "shard")
    shards = packed(valid, key, vector, n_shards, "shard")
    asked = valid.where(is_query)
    blocks = packed(asked, key, vector, per_width(asked, vector, block_rows, "block"), "block").withColumnsRenamed({"ids": "query_ids", "flat": "query_flat"})
    sent = blocks.join(F.broadcast(n_shards), "width").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    met = sent.join(shards, ["width", "shard"])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                query_ids, query_flat, ids, flat = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("query_ids", "query_flat", "ids", "flat"))
                found = search(query_ids, whole_numbers(query_flat, len(query_ids), width, scale), ids, whole_numbers(flat, len(ids), width, scale), k)
                columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", key, "score"])

    best = met.select("width", "query_ids", "query_flat", "ids", "flat").mapInArrow(run, f"query_id long, {key} long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
