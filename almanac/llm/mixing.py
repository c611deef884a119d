"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, at most ``max_copies``. Its
whole part is allocated for certain; the fraction left over is an inclusion
probability. Documents are ranked by the odds of a random number divided by
the odds of inclusion, and the lowest ranks are taken until the source's
target is met, which gives a sample of fixed size with unequal probabilities.

Expected copies of a document are proportional to floor(16 * sqrt(size)):
long documents are likelier than short ones, but less than in proportion.

Scale: documents are reduced to a few numbers first. A source's cut in the
ranking is found from sums in 4,096 bins of the rank, and only the bin with
the cut is ordered, so a source that holds a third of all rows is never sorted.

Edge cases: a null or blank text has size 0 and is never taken; a null source
is a source of its own, last in order; repeated rows are separate documents;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BINS = 4096


def random_number(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on ``key`` and ``seed`` only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Water filling: with level x, target = min(max_copies * source_size,
    x * weight), where x makes the targets add up to ``share`` of all sizes.
    """
    everything = Window.partitionBy()
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    full = float(max_copies) * F.col("source_size")
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        per_source.withColumn("weight", weight)
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - float(max_copies) * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("fits", F.col("level") * F.col("weight") <= full)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    )
    target = F.least(full, F.coalesce(F.col("level") * F.col("weight"), full))
    return ranked.select("source", "source_size", target.alias("target"))


def copy_rates(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add to ``targets`` the factor by which floor(16 * sqrt(size)) becomes a document's expected copies."""
    exact = "decimal(38,0)"
    grouped = (
        sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
        .withColumn("measure", F.floor(16 * F.sqrt(F.col("size").cast("double"))))
        .withColumn("words", (F.col("size") * F.col("n")).cast(exact))
        .withColumn("mass", (F.col("size").cast(exact) * F.col("measure").cast(exact) * F.col("n").cast("decimal(18,0)")).cast(exact))
    )
    order = Window.partitionBy("source").orderBy("size")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    above = order.rowsBetween(1, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(above), F.lit(0).cast(exact)).cast("double")
    sums = grouped.withColumn("capped", capped).withColumn("mass", F.sum("mass").over(upto).cast("double"))
    goal = targets.select(F.col("source").alias("of"), "target")
    joined = sums.join(goal, F.col("source").eqNullSafe(F.col("of")))
    rate = (F.col("target") - float(max_copies) * F.col("capped")) / F.col("mass")
    solved = (
        joined.withColumn("rate", rate)
        .where(F.col("rate") * F.col("measure") <= float(max_copies) + 1e-9)
        .groupBy("of").agg(F.max(F.struct("size", "rate"))["rate"].alias("rate"))
    )
    return targets.join(solved, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select("doc_id", "source", size.alias("size"), random_number(F.col("doc_id"), seed).alias("u")))
    targets = cut(copy_rates(base, source_targets(base, weights, share, max_copies), max_copies))

    measure = F.floor(16 * F.sqrt(F.col("size").cast("double")))
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.col("rate"), F.lit(0.0)) * measure)
    rows = (
        base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("expected", expected)
        .withColumn("certain", F.floor(F.col("expected") + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("certain")))
        .withColumn("q", F.when(F.col("p") > 0, F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))))
        .withColumn("bin", F.floor(BINS * F.col("q") / (1 + F.col("q"))).cast("int"))
    )
    bins = rows.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("bin").isNotNull(), F.col("size"))).alias("words"),
        F.sum(F.col("certain") * F.col("size")).alias("sure"),
        F.first("target").alias("target"),
    )
    whole = Window.partitionBy("source")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        bins.withColumn("rest", F.col("target") - F.sum("sure").over(whole))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where(F.col("bin").isNotNull() & (F.col("before") + F.col("words") >= F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("bin", "before", "rest")).alias("cut"))
        .select(F.col("source").alias("cut_source"), F.col("cut.bin").alias("cut_bin"), "cut.before", "cut.rest")
    )
    placed = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    early = F.col("bin").isNotNull() & F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(True))
    upto = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    kept = ["doc_id", "source", "size", "source_size", "target"]
    inside = placed.where(at_cut).withColumn("extra", F.when(F.col("before") + F.sum("size").over(upto) - F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0))
    outside = placed.where(~at_cut).withColumn("extra", F.when(early, 1).otherwise(0))
    copies = (F.col("certain") + F.col("extra")).cast("int")
    both = outside.select(*kept, copies.alias("copies")).unionByName(inside.select(*kept, copies.alias("copies")))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what the stages before kept."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = """
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM src),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
     - CAST(2 AS DOUBLE) * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
best AS (SELECT level FROM levels WHERE level * weight <= CAST(2 AS DOUBLE) * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(2 AS DOUBLE) * source_size, coalesce((SELECT level FROM best) * weight, CAST(2 AS DOUBLE) * source_size)) AS target
  FROM levels),
grouped AS (SELECT source, size, CAST(floor(16 * sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS measure, count(*) AS n FROM base WHERE size > 0 GROUP BY ALL),
sums AS (
  SELECT source, size, measure,
    CAST(coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS capped,
    CAST(sum(size * measure * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS mass
  FROM grouped),
rated AS (
  SELECT s.source, s.size, s.measure, (t.target - CAST(2 AS DOUBLE) * s.capped) / s.mass AS rate
  FROM sums s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rates AS (
  SELECT source, rate FROM rated WHERE rate * measure <= 2.000000001::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC) = 1),
expected AS (
  SELECT b.*, t.source_size, t.target, least(CAST(2 AS DOUBLE), coalesce(r.rate, 0) * floor(16 * sqrt(CAST(b.size AS DOUBLE)))) AS e
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),
parts AS (SELECT *, floor(e + 1e-9::DOUBLE) AS certain, greatest(0::DOUBLE, e - floor(e + 1e-9::DOUBLE)) AS p FROM expected),
ranked AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q FROM parts),
summed AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
    sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ranked),
counted AS (SELECT *, CAST(certain + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM summed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
