"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and Spark runs in this very process (tests) is a folder made here.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="almanac-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it from clashing with ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, once the files of finished steps are released."""
    shared_folder(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``function`` (Arrow batch -> columns by name) to each batch of rows."""
    names = [part.split()[0] for part in split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([as_arrow(out[n], kinds[n]) for n in names], names=names)

    kinds = {part.split()[0]: arrow_type(part.split(None, 1)[1]) for part in split_schema(schema)}
    return df.mapInArrow(run, schema)


def split_schema(schema: str) -> list[str]:
    return [part.strip() for part in schema.split(",")]


def arrow_type(name: str) -> pa.DataType:
    name = name.strip().lower()
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[name]


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``labels`` in hash order of ``key``, with the document's text.

    The ids are chosen before any text moves, so that the bounded id table can
    be broadcast and each text is read once. Of labels that repeat an id the
    largest counts, of texts the first in order.
    """
    chosen = labels.groupBy(key).agg(*(F.max(c).alias(c) for c in columns)).orderBy(F.xxhash64(key), key).limit(rows)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    found = docs.select(key, "text").join(F.broadcast(ids), key)
    return found.groupBy(key, *columns).agg(F.min("text").alias("text")).select(key, "text", *columns)


def slices(data: bytes, breaks: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, each cut where ``breaks`` matches, so that no word is split."""
    at = 0
    while at < len(data):
        found = breaks.search(data, at + size)
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end
