"""Phrases in texts by an equi-join of word runs, whatever the size of the vocabulary.

A text is a list of words with the gaps between them. Its runs of up to as many
words as the longest phrase has are joined with the phrases by equality, so a
text costs its own length times that number, and a hit is exact. A phrase that
ends in ``*`` matches any last word that begins so; for these, runs are also
offered with their last word cut to the lengths that occur.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def gaps(text: Column) -> Column:
    """What stands before each word and after the last; blanks around a slash do not count."""
    return F.transform(F.split(F.lower(text), WORD, -1), lambda g: F.when(F.contains(g, F.lit("/")), F.trim(g)).otherwise(g))


def mentions(texts: DataFrame, keys: list[str], text: str, phrases: list[str] | DataFrame) -> DataFrame:
    """(keys, phrase, place, n_words, before, after): where each phrase stands as whole words, with the gaps around it.

    ``phrases`` is a short list, which every executor gets, or a table (phrase)
    of any size. Upper and lower case are equal; a phrase comes back as given.
    """
    spark = texts.sparkSession
    if isinstance(phrases, list):
        known = F.broadcast(spark.createDataFrame([(p,) for p in dict.fromkeys(phrases)], "phrase string"))
        longest, cuts = max((len(re.findall(r"\w+", p)) for p in phrases), default=0), sorted({len(re.findall(r"\w+", p)[-1]) for p in phrases if p.endswith("*")})
    else:
        known = phrases.select("phrase").distinct()
        last = F.element_at(words(F.col("phrase")), -1)
        longest, cuts = known.agg(F.max(F.size(words(F.col("phrase")))), F.array_sort(F.collect_set(F.when(F.endswith("phrase", F.lit("*")), F.length(last))))).first()
    offered = known.withColumn("run", F.lower("phrase"))
    split = texts.select(*keys, words(F.col(text)).alias("_w"), gaps(F.col(text)).alias("_g")).where(F.size("_w") > 0)
    placed = split.select(*keys, "_w", "_g", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("place"))

    def word(i: int) -> Column:
        return F.get("_w", F.col("place") + i)

    def runs(n: int) -> list[Column]:
        start = [x for i in range(n - 1) for x in (word(i), F.get("_g", F.col("place") + i + 1))]
        return [F.concat(*start, word(n - 1)), *(F.when(F.length(word(n - 1)) >= c, F.concat(*start, F.substring(word(n - 1), 1, c), F.lit("*"))) for c in cuts)]

    each = F.array(*(F.struct(run.alias("run"), F.lit(n).alias("n_words")) for n in range(1, (longest or 0) + 1) for run in runs(n))) if longest else F.array().cast("array<struct<run:string,n_words:int>>")
    rows = placed.select(*keys, "place", "_g", F.inline(F.filter(each, lambda r: r["run"].isNotNull())))
    found = rows.join(offered, "run")
    return found.select(*keys, "phrase", "place", "n_words", F.get("_g", F.col("place")).alias("before"), F.get("_g", F.col("place") + F.col("n_words")).alias("after"))
