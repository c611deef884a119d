"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on surface features of the whole text gives each
document's evidence. Documents are grouped by host and by path below the host;
a group's expected share of good documents is a Beta posterior: the path is
shrunk toward its host and the host toward the whole corpus. The prior
strengths are estimated from the spread between groups (method of moments), so
sparse sites rest on the global prior. A document's final log-odds are its own
plus the shift of its path's prior against the corpus.

Every text is scored once. Only sums per group are shuffled, with partial sums
first; a host with a third of all rows costs one row per task. The posteriors
of the paths are sent to the scored rows if there are at most
``MAX_BROADCAST_PATHS`` of them; beyond that, both meet by a shuffle in which
each path is dealt to ``SALTS`` tasks.

Edge cases: a null or blank text has all features 0 and is rejected (score 0);
a null host or path is a group of its own; without labels of both kinds all
texts that have words are kept (score 1); repeated rows get equal scores;
other columns are carried through ``classify`` unless a name clashes with an
added column, which is then replaced. ``documents`` has no URL, so its queries
take the source as host and the language section of the source as path;
``site`` gives host and path of tables with URLs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, fresh, labelled_sample, table

#: Bound of the labelled sample the classifier is fitted on.
SAMPLE_ROWS = 6000
THRESHOLD = 0.5
#: Most paths whose posteriors are sent to every executor, and the tasks each is dealt to beyond that.
MAX_BROADCAST_PATHS = 100_000
SALTS = 32
SYMBOLS = "%&*$#@|~^<>{}[]=_\\+"
NAMES = ("log_words", "symbols", "upper", "bangs", "pipes", "digits", "word_length", "distinct", "run", "lines", "stops", "letters", "short", "dense")
LINE = re.compile(r"\n+")


def surface(text: str | None) -> list[float]:
    """Features of a whole text; all 0 if it has no word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lower = text.lower()
    raised = sum(a != b for a, b in zip(text, lower, strict=False)) if len(lower) == len(text) else 0
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in LINE.split(text) if x]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    bangs, pipes, stops = text.count("!"), words.count("|"), text.count(".")
    digits = sum(map(text.count, "0123456789"))
    short = sum(len(w) < 4 for w in words)
    return [
        float(np.log(n)), symbols / chars, raised / chars, bangs / n, pipes / n, digits / chars, chars / n / 10,
        distinct / n, same / n, repeated, stops / n, (chars - symbols - digits - bangs - stops) / chars, short / n, float(np.log(distinct)),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = expand((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 3])


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> QualityModel | None:
    """Ridge logistic regression by Newton's method; None unless both labels occur."""
    if len(set(y.tolist())) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([expand((x - mean) / scale), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return QualityModel(mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> QualityModel | None:
    known = labels.where("quality IS NOT NULL").select(key, F.when(F.col("quality") > 0, 1).otherwise(0).alias("quality"))
    found = with_features(labelled_sample(docs, known, key, ["quality"], rows)).select(key, "quality", "features").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r[key]).encode()), str(r[key])))
    if not found:
        return None
    return train(np.array([r["features"] for r in found]), np.array([r["quality"] for r in found], float))


def with_features(docs: DataFrame, model: QualityModel | None = None, text: str = "text") -> DataFrame:
    """Add ``features``, or with a model ``doc_score``, to every row."""
    kept = [c for c in docs.columns if c not in ("features", "doc_score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([surface(t) for t in batch.column(text).to_pylist()])
            found = sent.value
            if found is None:
                added = pa.array(list(x), pa.list_(pa.float64()))
            else:
                added = pa.array(np.where(x.any(axis=1), found.probability(x), 0.0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), added], names=[*kept, "features" if found is None else "doc_score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, f"{shape}, {'features array<double>' if model is None else 'doc_score double'}")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def shrunk(groups: DataFrame, keys: list[str], parent: Column, out: str) -> DataFrame:
    """Posterior share of good documents per group (n, good), shrunk toward ``parent``.

    With s the share in a group, E[(s - parent)^2] = parent (1 - parent)
    (1/n + (1 - 1/n) / (strength + 1)) for a Beta prior; sums over groups give
    the strength, kept between 2 and 10,000.
    """
    spread = parent * (1 - parent)
    excess = F.pow(F.col("good") / F.col("n") - parent, 2) - spread / F.col("n")
    over, room = groups.agg(F.sum(F.col("n") * excess), F.sum((F.col("n") - 1) * spread)).first()
    strength = min(1e4, max(2.0, (room or 0.0) / max(over or 0.0, 1e-12) - 1))
    return groups.select(*keys, ((F.col("good") + strength * parent) / (F.col("n") + strength)).alias(out))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL; null where it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.nullif(F.split_part(F.try_parse_url(url, F.lit("PATH")), F.lit("/"), F.lit(2)), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", threshold: float = THRESHOLD, text: str = "text", with_text: bool = True, max_broadcast: int = MAX_BROADCAST_PATHS) -> DataFrame:
    """Add doc_score, host_prior, path_prior, score and keep to every row of ``docs``; ``with_text`` says whether the text is kept."""
    added = ["doc_score", "host_prior", "path_prior", "score", "keep"]
    rows = docs.select(*(c for c in docs.columns if c not in added))
    kept = [c for c in rows.columns if with_text or c != text]
    model = fit(docs, labels, key)
    if model is None:
        words = F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
        one = F.when(words, F.lit(1.0)).otherwise(0.0)
        return rows.select(*kept, *(one.alias(c) for c in added[:-1]), words.alias("keep"))
    h, p, other_h, other_p, salt = fresh([*docs.columns, *added], "host", "path", "of_host", "of_path", "salt")
    scored = cut(with_features(rows.withColumns({h: host.cast("string"), p: path.cast("string")}), model, text).select(*kept, h, p, "doc_score"))
    per_path = cut(scored.groupBy(h, p).agg(F.count("*").alias("n"), F.sum("doc_score").alias("good")))
    n_paths, n, good = per_path.agg(F.count("*"), F.sum("n"), F.sum("good")).first()
    overall = (good or 0.0) / max(n or 0, 1)
    hosts = shrunk(per_path.groupBy(h).agg(F.sum("n").alias("n"), F.sum("good").alias("good")), [h], F.lit(overall), "host_prior").withColumnRenamed(h, other_h)
    joined = per_path.join(hosts, F.col(h).eqNullSafe(F.col(other_h))).drop(other_h)
    paths = shrunk(joined, [h, p, "host_prior"], F.col("host_prior"), "path_prior").withColumnsRenamed({h: other_h, p: other_p})
    same = F.col(h).eqNullSafe(F.col(other_h)) & F.col(p).eqNullSafe(F.col(other_p))
    if n_paths <= max_broadcast:
        both = scored.join(F.broadcast(paths), same)
    else:
        dealt = paths.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left, right = scored.withColumn(f"{salt}_of", F.pmod(F.xxhash64(key, "doc_score"), F.lit(SALTS)).cast("int")), dealt
        both = left.join(right, same & (F.col(f"{salt}_of") == F.col(salt)))
    odds = logit(F.col("doc_score")) + logit(F.col("path_prior")) - logit(F.lit(overall))
    score = F.when(F.col("doc_score") > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return both.withColumn("score", score).withColumn("keep", F.col("score") >= threshold).select(*kept, *added)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = classify(docs, labels, F.col("source"), F.col("lang"), with_text=False)
    return found.select("doc_id", "doc_score", "host_prior", "path_prior", "score", "keep")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    found = classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.where("keep").select(*docs.columns)
