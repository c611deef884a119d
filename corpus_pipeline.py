"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``, and works on all that the stage before kept. The last stage
returns the mixture (doc_id, size, source_size, target, taken, copies); its
``taken`` says how many words of a document the mixture takes, 0 if none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import decontaminate, mixing, nearjoin, privacy, quality
from almanac.llm.common import delete, shared_folder, table

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", nearjoin.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", privacy.stage),
    ("mix", mixing.stage),
]

#: The classifier, the join, the tiling and the pseudonyms are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; the next stage's output replaces it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete(spark, before)
        before = out
    return docs
