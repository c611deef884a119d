"""Toxicity by weak supervision.

Voters. Each voter looks for one word or word beginning, or for one surface
pattern. The lexicon of words and beginnings is mined from a bounded sample of
labelled training rows: labels say which features are commoner in toxic rows
than chance allows, and so the side that a voter takes. They also give the
class balance to start from. Labels say nothing else: no accuracy is read from
them, and none is a target.

Label model. A voter fires or abstains, and both are evidence. Voters that fire
together more often than chance are correlated and make a group, such as the
insults of one language. A text is clean, or toxic in a sparse or a dense way
of one group; given that, its voters are independent. The shares of these kinds
and the rates at which each voter fires in each kind are estimated by
expectation maximisation over the votes of all documents, from the same start
for all voters. A task sends a fixed number of sums a round.

Classifier. A logistic regression with an L1 penalty on words and word
beginnings is trained on the label model's posteriors of the labelled sample's
texts. It alone scores texts.

Edge cases: null and empty texts get the score of a text without features;
without labelled training rows of both kinds, or without a voter, all texts
score the prior 0.05; repeated rows get equal scores; of labels that repeat an
id the largest counts; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, fold, labelled_sample, map_batches, table

#: Bound of the labelled sample that voters are mined from, drawn in equal parts of both labels.
SAMPLE_ROWS = 4000
VOTERS = 48
#: Rounds of expectation maximisation, and the rates it starts from for dense and sparse kinds.
ROUNDS, START = 25, (0.5, 0.15)
#: Least correlation of two voters of a group.
LEAST_CORRELATION = 0.1
FEATURES = 1024
STEMS = (4, 5, 6, 8)
PRIOR = 0.05
#: Least likelihood ratio statistic (G squared) of a mined voter: beyond what tens of thousands of features show by chance.
LEAST_EVIDENCE = 20.0
WORD = re.compile(r"\w+")
PATTERNS = {
    "shouting": re.compile(r"!{3,}"),
    "you_are": re.compile(r"\byou(?:'re| are) an? \w+"),
    "masked": re.compile(r"\b\w[*#@$]{2,}\w*"),
    "hate": re.compile(r"\b(?:hate|kill|shut) (?:you|them|up)\b"),
}


def features(text: str | None) -> set[str]:
    """The distinct words of a text and their beginnings, marked by ``*``, or ``**`` where two words share one."""
    words = set(WORD.findall((text or "").lower()))
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return words | {s + "*" for s in stems} | {s + "**" for s, c in stems.items() if c > 1}


@dataclass
class LabelModel:
    """The shares of the kinds of texts (clean first), and the rate at which each voter fires in each kind."""

    share: np.ndarray
    rates: np.ndarray

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each kind for texts with these votes."""
        z = np.log(self.share) + votes @ np.log(self.rates / (1 - self.rates)).T + np.log(1 - self.rates).sum(axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 - self.kinds(votes)[:, 0]


def groups_of(n: float, once: np.ndarray, twice: np.ndarray) -> list[list[int]]:
    """Groups of voters that fire together beyond chance, from counts of texts, firings and joint firings."""
    chance = np.outer(once, once) / max(n, 1)
    spread = np.sqrt(np.maximum(once * (1 - once / max(n, 1)), 1e-9))
    linked = (twice - chance > 4 * np.sqrt(np.maximum(chance, 1))) & (twice - chance > LEAST_CORRELATION * np.outer(spread, spread))
    left, out = set(range(len(once))), []
    while left:
        group, queue = [], [left.pop()]
        while queue:
            i = queue.pop()
            group.append(i)
            near = {j for j in left if linked[i, j]}
            left -= near
            queue += near
        out.append(sorted(group))
    return sorted(g for g in out if len(g) > 1)


def fit_label_model(votes: DataFrame, voters: int, balance: float, rounds: int = ROUNDS, start: tuple[float, float] = START) -> LabelModel | None:
    """Fit to ``votes`` (at: the voters that fire, n: texts with these votes); None if no two voters agree.

    ``start`` are the rates of a dense and of a sparse kind's own voters before the first round.
    """
    def laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at = batch.column("at")
        x = np.zeros((batch.num_rows, voters))
        x[np.repeat(np.arange(batch.num_rows), pc.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = 1
        return x, batch.column("n").to_numpy()

    def summed(rows: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
        """The sum over all texts of rows(votes)' times (1, votes), a matrix of ``height`` rows."""
        def run(batches):
            total = np.zeros((height, voters + 1))
            for batch in batches:
                x, n = laid_out(batch)
                total += (rows(x) * n[:, None]).T @ np.column_stack([np.ones(len(x)), x])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        found = votes.mapInArrow(run, "sums array<double>").collect()  # a task sends one row
        return np.sum([r["sums"] for r in found], axis=0).reshape(height, voters + 1) if found else np.zeros((height, voters + 1))

    pairs = summed(lambda x: np.column_stack([np.ones(len(x)), x]), voters + 1)
    groups = groups_of(pairs[0, 0], pairs[0, 1:], pairs[1:, 1:])
    if not groups:
        return None
    rates = np.full((1 + 2 * len(groups), voters), 0.003)
    for k, group in enumerate(groups):
        rates[2 * k + 1, group], rates[2 * k + 2, group] = start
    model = LabelModel(np.r_[1 - balance, np.full(2 * len(groups), balance / len(groups) / 2)], rates)
    for _ in range(rounds):
        sums = summed(model.kinds, len(model.share))
        whole, fired = sums[:, 0], sums[:, 1:]
        model = LabelModel((whole + 1) / (whole + 1).sum(), np.clip((fired + 0.005) / (whole[:, None] + 0.5), 1e-4, 1 - 1e-4))
    return model


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = math.log(PRIOR / (1 - PRIOR))
    voters: list[str] = field(default_factory=list)
    labels: LabelModel | None = None

    def __post_init__(self) -> None:
        self.stems = {n: {s for f in self.weights if "*" in f and len(s := f.rstrip("*")) == n} for n in STEMS}

    def score(self, text: str | None) -> float:
        z, weights = self.bias, self.weights
        if weights and text:
            got = weights.get
            words = set(WORD.findall(text.lower()))
            found = {w for w in words if w in weights}
            for n in STEMS:
                stems = self.stems[n]
                begun = [s for w in words if (s := w[:n]) in stems and len(w) > n]
                for s in begun:
                    (found.add(s + "**") if s + "*" in found else found.add(s + "*"))
            z += math.fsum(got(f, 0.0) for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def vote(text: str | None, voters: list[str]) -> list[int]:
    """Positions of the voters that fire."""
    has = features(text)
    return [i for i, v in enumerate(voters) if (PATTERNS[v[1:]].search((text or "").lower()) if v[0] == ":" else v in has)]


class Rows:
    """The features of texts as arrays of numbers; features in fewer than three texts are left out."""

    def __init__(self, texts: list[str | None]):
        seen = Counter()
        for text in texts:
            seen.update(features(text))
        self.names = sorted(f for f, c in seen.items() if c >= 3)
        place = {f: i for i, f in enumerate(self.names)}
        self.rows = [np.array(sorted(place[f] for f in features(text) if f in place), np.int32) for text in texts]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per feature, the weight of the texts that have it."""
        total = np.zeros(len(self.names))
        for row, w in zip(self.rows, weights.tolist(), strict=True):
            if w:
                total[row] += w
        return total


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Likelihood ratio statistic (G squared) of features against independence of the label."""
    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    n, both = n_bad + n_good, bad + good
    rest = n - both
    return 2 * (part(bad, both * n_bad / n) + part(good, both * n_good / n) + part(n_bad - bad, rest * n_bad / n) + part(n_good - good, rest * n_good / n))


def choose_voters(names: list[str], bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, voters: int = VOTERS) -> list[str]:
    """Features that are much commoner in toxic rows, beyond chance, each new to the ones before by its beginning, then the patterns.

    The sample is drawn by label, so evidence is counted as in a sample of one toxic row in ten.
    """
    weight = min(1.0, n_good / 9 / n_bad)
    strong = evidence(bad * weight, good, n_bad * weight, n_good)
    usual = (bad + 0.5) / n_bad > 4 * (good + 0.5) / n_good
    chosen: list[str] = []
    for i in sorted(np.flatnonzero(usual & (strong >= LEAST_EVIDENCE)).tolist(), key=lambda i: (-strong[i], names[i])):
        if not any(names[i].startswith(c[:4]) for c in chosen):
            chosen.append(names[i])
            if len(chosen) == voters:
                break
    return chosen + [f":{name}" for name in PATTERNS] if chosen else []


def train_classifier(sample: Rows, target: np.ndarray, balance: float, steps: int = 800, penalty: float = 1e-4) -> tuple[dict[str, float], float]:
    """L1-penalised logistic regression (accelerated proximal gradient) on posteriors."""
    bad, good = sample.sums(target), sample.sums(1 - target)
    p, q = (bad + 0.5) / (target.sum() + 1), (good + 0.5) / ((1 - target).sum() + 1)
    gain = (p - q) ** 2 / (p + q)
    best = sorted(range(len(gain)), key=lambda i: (-gain[i], i))[:FEATURES]
    place = np.full(len(gain), -1)
    place[best] = np.arange(len(best))
    x = np.zeros((len(sample.rows), len(best)), np.float32)
    for r, row in enumerate(sample.rows):
        at = place[row]
        x[r, at[at >= 0]] = 1
    # The sample holds more toxic rows than the corpus; weights bring back its balance.
    in_sample = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = target * balance / in_sample + (1 - target) * (1 - balance) / (1 - in_sample)
    weight, target = (weight / weight.sum()).astype(np.float32), target.astype(np.float32)
    w, b = np.zeros(len(best), np.float32), math.log(balance / (1 - balance))
    v, c, t = w.copy(), b, 1.0
    u = np.ones(len(best), np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        u = x.T @ (weight * (x @ (u / max(float(np.linalg.norm(u)), 1e-9))))
    step = np.float32(4.0 / (1.1 * float(np.linalg.norm(u)) + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        g = weight * (p - target)
        new = v - step * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * float(g.sum())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + np.float32((t - 1) / nt) * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return {sample.names[f]: float(w[i]) for i, f in enumerate(best) if abs(w[i]) > 1e-4}, b


def vote_sets(docs: DataFrame, voters: list[str]) -> DataFrame:
    """(at, n): which voters fire together, and in how many of all rows."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"at": [vote(text, voters) for text in batch.column("text").to_pylist()]}

    return map_batches(docs.select("text"), run, "at array<int>").groupBy("at").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on ``labels`` (key, toxic), whose rows all count as training rows, and the votes of all ``docs``."""
    known = labels.where("toxic IS NOT NULL").select(key, F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    balance = known.agg(F.avg("toxic")).first()[0]
    if balance is None:
        return ToxicityModel()
    balance = float(np.clip(balance, 0.005, 0.5))
    chosen = [r for label in (0, 1) for r in labelled_sample(docs, known.where(F.col("toxic") == label), key, ["toxic"], rows // 2).collect()]
    chosen.sort(key=lambda r: (zlib.crc32(str(r[key]).encode()), str(r[key])))
    truth = np.array([int(r["toxic"]) for r in chosen])
    if not 0 < truth.sum() < len(truth):
        return ToxicityModel()
    sample = Rows([r["text"] for r in chosen])
    voters = choose_voters(sample.names, sample.sums(truth), sample.sums(1 - truth), int(truth.sum()), int(len(truth) - truth.sum()))
    if not voters:
        return ToxicityModel()
    model = fit_label_model(cut(vote_sets(docs, voters)), len(voters), balance)
    if model is None:
        return ToxicityModel()
    votes = np.zeros((len(chosen), len(voters)))
    for r, row in enumerate(chosen):
        votes[r, vote(row["text"], voters)] = 1
    weights, bias = train_classifier(sample, model.posterior(votes), balance)
    return ToxicityModel(weights, bias, voters, model)


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = sent.value
        return {key: batch.column(key), "score": [found.score(t) for t in batch.column("text").to_pylist()]}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held))
    return score(docs, model).withColumn("held_out", held).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
