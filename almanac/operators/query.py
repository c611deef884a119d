"""Natural-language preferences as column expressions, so that a column of queries is parsed in one plan."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import fixed, text

FLAGS = [*fixed.QUERY_FLAGS, "lenient_makeup"]

PREFERENCES = T.StructType(
    [T.StructField("category", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))]
    + [T.StructField(f, T.BooleanType()) for f in FLAGS]
    + [T.StructField("free_day", T.StringType())]
)


def preferences(query: Column) -> Column:
    """A struct of category, keywords, the flags and free_day."""
    low = F.lower(query)

    def has(pattern: str) -> Column:
        return F.coalesce(F.regexp_like(low, F.lit(pattern)), F.lit(False))

    category = reduce(lambda rest, c: F.when(has(rf"\b{c}s?\b"), c).otherwise(rest), reversed(fixed.CATEGORIES), F.lit(None).cast("string"))
    # The last weekday of the week that is named wins.
    day = reduce(lambda rest, d: F.when(has(d[1]), d[0]).otherwise(rest), zip(fixed.WEEKDAYS, fixed.WEEKDAY_STEMS, strict=True), F.lit(None).cast("string"))
    flags = {name: has(pattern) for name, pattern in fixed.QUERY_FLAGS.items()}
    flags["lenient_makeup"] = has(fixed.LENIENT) & has(fixed.QUERY_FLAGS["makeup_requested"])
    return F.struct(
        category.alias("category"), F.coalesce(text.tokens(query), F.array().cast("array<string>")).alias("keywords"),
        *(flags[f].alias(f) for f in FLAGS), F.when(has(fixed.FREE_DAY), day).alias("free_day"),
    )


def from_json(reply: Column) -> Column:
    """Preferences from a JSON reply; null unless all fields are there and the enumerations hold."""
    p = F.from_json(reply, PREFERENCES, {"mode": "PERMISSIVE"})
    known = p["category"].isNull() | p["category"].isin(fixed.CATEGORIES)
    day = p["free_day"].isNull() | p["free_day"].isin(fixed.WEEKDAYS)
    whole = reduce(lambda a, b: a & b, [p[f].isNotNull() for f in FLAGS], p["keywords"].isNotNull())
    return F.when(known & day & whole, p)


def merged(remote: Column, local: Column) -> Column:
    """Flags of either side; category and day of the remote side first; its keywords tokenised once more."""
    words = F.sort_array(F.array_distinct(F.concat(text.tokens(F.array_join(remote["keywords"], " ")), F.array().cast("array<string>"))))
    both = F.struct(
        F.coalesce(remote["category"], local["category"]).alias("category"), words.alias("keywords"),
        *((remote[f] | local[f]).alias(f) for f in FLAGS), F.coalesce(remote["free_day"], local["free_day"]).alias("free_day"),
    )
    return F.when(remote.isNotNull(), both).otherwise(local)


def understood(rows: DataFrame) -> DataFrame:
    """Add preferences, provider and warning to rows with query, reply and warning, both null without a remote parser.

    A reply that does not fit the schema gives a warning, and the local rules answer.
    """
    local, sent = preferences(F.col("query")), from_json(F.col("reply"))
    failed = F.when(F.col("reply").isNotNull() & sent.isNull(), "remote reply does not fit the schema")
    provider = F.when(sent.isNotNull(), "remote").otherwise("deterministic")
    return rows.withColumns({"preferences": merged(sent, local), "provider": provider, "warning": F.coalesce("warning", failed)}).drop("reply")


#: What a remote parser may raise; anything else is a fault of its own and ends the job.
FAILURES = (OSError, ValueError, KeyError, IndexError, TimeoutError)


def answer(remote: Callable[[str], str], query: str | None, tries: int = 1, pause: float = 0.5) -> tuple[str | None, str | None]:
    """(reply, warning) of a remote parser. Time-outs and errors of the server are tried again, after a pause that doubles."""
    for n in range(tries):
        try:
            return remote(query), None
        except FAILURES as e:
            warning = f"remote parser failed: {e}"
            if isinstance(e, urllib.error.HTTPError) and e.code < 500 or not isinstance(e, OSError):
                break
            if n + 1 < tries:
                time.sleep(pause * 2**n)
    return None, warning


def asked(requests: DataFrame, remote: Callable[[str], str], workers: int = 8, tries: int = 2, pause: float = 0.5) -> DataFrame:
    """``requests`` with reply and warning: one call for each distinct query, however many rows share it.

    Every partition has ``workers`` calls in flight. A call that fails is the
    warning of its rows; a null query is not asked. ``remote`` keeps its own time limit.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(lambda q: answer(remote, q, tries, pause), batch["query"]))
                yield pd.DataFrame([(q, *f) for q, f in zip(batch["query"], found, strict=True)], columns=["query", "reply", "warning"])

    known = requests.where("query IS NOT NULL").select("query").distinct().mapInPandas(run, "query string, reply string, warning string")
    return requests.join(known, "query", "left")


def answered(requests: DataFrame, remote: Callable[[str], str], **options) -> DataFrame:
    """``requests`` with preferences, provider and warning: each distinct text is asked (see ``asked``) and parsed once, the null one by the local rules only."""
    texts = understood(asked(requests.select("query").distinct(), remote, **options)).withColumnRenamed("query", "_text")
    return requests.join(texts, F.col("query").eqNullSafe(F.col("_text"))).drop("_text")


def understand(spark: SparkSession, query: str, remote: Callable[[str], str] | None = None) -> DataFrame:
    """One row (query, warning, preferences, provider). ``remote`` maps the query to a JSON reply; any failure falls back to the local rules."""
    reply, warning = (None, None) if remote is None else answer(remote, query)
    return understood(spark.createDataFrame([(query, reply, warning)], "query string, reply string, warning string"))


def http_parser(url: str, body: Callable[[str], dict], pick: Callable[[dict], str], headers: dict[str, str] | None = None, seconds: float = 25) -> Callable[[str], str]:
    """A remote parser that posts ``body(query)`` as JSON and takes the reply's text by ``pick``; it raises what ``understand`` falls back on."""

    def ask(query: str) -> str:
        sent = urllib.request.Request(url, json.dumps(body(query)).encode(), {"Content-Type": "application/json"} | (headers or {}), method="POST")
        with urllib.request.urlopen(sent, timeout=seconds) as got:
            return pick(json.load(got))

    return ask


# Names of the steps of an answer.
STEPS = ["understand_query", "calculate_requirements", "retrieve_current_offerings", "validate_categories_and_policy", "rank_supported_preferences", "attach_claim_evidence"]


def trace(provider: Column, warning: Column) -> Column:
    """How an answer came about: who parsed the request, with which warning, and the steps that followed."""
    steps = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("complete").alias("status")) for name in STEPS))
    return F.struct(provider.alias("intent_provider"), warning.alias("warning"), steps.alias("steps"))
