"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (two to
four bytes of the lower-cased UTF-8 text between two spaces), followed by a
linear softmax. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample: labelled texts are cut into pieces where they are
read, and of the pieces of all of them about ``SAMPLE_PIECES`` are drawn by
hash, as many of each language. Averaging and the softmax's linear
part commute, so for prediction the two layers are folded into one table with
a row per hash and a column per language.

The probability is calibrated by a temperature fitted on about
``CALIBRATION_ROWS`` whole texts that give no pieces; their scores, not they,
go to the driver. A prediction below ``reject_below``, which 99 % of them pass,
is marked as rejected; it still names the likeliest language.

Edge cases: a null text and a text without a letter are ``und`` with score 0;
without any labelled row all texts are ``und``; ties go to the first language
by code point; repeated rows get equal answers; other columns are ignored.
Every text is read whole, a long one in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import fold, map_batches, table

#: Bounds of the labelled sample: pieces that are fitted on the driver, and texts that calibrate.
SAMPLE_PIECES = 12_000
CALIBRATION_ROWS = 2000
BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
#: Bytes of the pieces that labelled texts are cut into for training, and of the parts in which a text is read.
PIECE, PART = 240, 1 << 16
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def hashes(data: bytes, first: bool = True, last: bool = True, seen: int = 0) -> np.ndarray:
    """Buckets of the n-grams of ``data`` that end after its first ``seen`` bytes, with a space before the first part of a text and after the last."""
    whole = np.frombuffer(b" " * first + data + b" " * last, np.uint8).astype(np.uint32)
    found = []
    for n in SIZES:
        a = whole[max(0, seen - n + 1) :]
        m = len(a) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ a[i : i + m]
        h *= np.uint32(0x9E3779B1)
        found.append(h >> np.uint32(16))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def sums(model: LanguageModel, data: bytes) -> tuple[np.ndarray, int]:
    """The sum of the table's rows over all n-grams of a text, and how many there are; parts overlap by less than the longest n-gram."""
    total, n, last = np.zeros(len(model.languages)), 0, max(SIZES) - 1
    for at in range(0, max(1, len(data)), PART):
        part = data[max(0, at - last) : at + PART]
        found = hashes(part, at == 0, at + PART >= len(data), 0 if at == 0 else min(at, last))
        total += model.table.take(found, axis=0).sum(axis=0, dtype=np.float64)
        n += len(found)
    return total, n


def logits(model: LanguageModel, text: str) -> np.ndarray:
    total, n = sums(model, encoded(text))
    return total / n + model.bias


def probabilities(model: LanguageModel, text: str) -> np.ndarray:
    z = logits(model, text)
    e = np.exp((z - z.max()) / model.temperature)
    return e / e.sum()


def pieces(text: str) -> list[bytes]:
    """A text's bytes in pieces; the last takes what is left."""
    data = encoded(text)
    return [data[i : i + PIECE] for i in range(0, max(1, len(data)), PIECE)]


def train(rows: list[tuple[bytes, str]], epochs: int = 4, batch: int = 32, rate: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """Fit on (piece, language) rows; None if there are none."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    code = {lang: i for i, lang in enumerate(languages)}
    grams, labels = [hashes(piece) for piece, _ in rows], [code[lang] for _, lang in rows]
    y = np.eye(len(languages), dtype=np.float32)[labels]
    share = y.mean(axis=0)
    weight = 1 / np.maximum(share, 1e-3)
    weight = (weight / (weight * share).sum()).astype(np.float32)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(grams))
        for start in range(0, len(order), batch):
            ids = order[start : start + batch]
            lengths = np.array([len(grams[i]) for i in ids])
            flat = np.concatenate([grams[i] for i in ids])
            begins = np.cumsum(lengths) - lengths
            mean = np.add.reduceat(embed[flat], begins, axis=0) / lengths[:, None].astype(np.float32)
            logits = mean @ linear + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - y[ids]) * (y[ids] @ weight)[:, None] / len(ids)
            back = (g @ linear.T) * (len(ids) / lengths[:, None]).astype(np.float32)
            linear -= step * mean.T @ g
            bias -= step * g.sum(axis=0)
            # Gradients of a bucket are summed before it is written; a sort of 16-bit buckets is much faster than writing each in turn.
            place = np.argsort(flat.astype(np.uint16), kind="stable")
            buckets = flat[place]
            firsts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            owner = np.repeat(np.arange(len(ids)), lengths)[place]
            embed[buckets[firsts]] -= np.add.reduceat((step * 20 * back)[owner], firsts, axis=0)
    return LanguageModel(languages, embed @ linear, bias.astype(np.float64), 1.0, 0.0)


def calibrate(model: LanguageModel, scores: np.ndarray, truth: np.ndarray) -> None:
    """Fit the temperature to texts' scores and languages, and the bound of rejection to what 99 % of them pass."""
    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    if len(scores):
        model.temperature = min((0.1 * 1.15**i for i in range(40)), key=loss)
        z = scores / model.temperature
        model.reject_below = float(np.quantile(1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1), 0.01))


def predict(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, accepted) of each row of ``docs`` (key, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = sent.value
        langs, scores = [], []
        for text in batch.column("text").to_pylist():
            if found is None or not text or not LETTER.search(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                p = probabilities(found, text)
                langs.append(found.languages[int(p.argmax())])
                scores.append(float(p.max()))
        least = found.reject_below if found else 0.0
        return {key: batch.column(key), "lang_pred": langs, "score": scores, "accepted": [lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)]}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, lang_pred string, score double, accepted boolean")


def fit(labelled: DataFrame, pieces_bound: int = SAMPLE_PIECES, rows_bound: int = CALIBRATION_ROWS) -> LanguageModel | None:
    """Fit on the rows of ``labelled`` (text, lang) that have both; None if none has a letter.

    A text's hash decides whether it is learned from or calibrates (one in
    five), so copies stay together, and which of its pieces are drawn.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("checks"))
    size = F.ceil(F.octet_length("text") / PIECE)
    counts = known.groupBy("lang").agg(F.sum(F.when(~F.col("checks"), size)).alias("pieces"), F.count_if("checks").alias("rows")).collect()
    if not counts:
        return None
    share = {r["lang"]: pieces_bound / len(counts) / max(1, r["pieces"] or 0) for r in counts}
    chance = rows_bound / max(1, sum(r["rows"] for r in counts))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if LETTER.search(text):
                    seed = xxhash.xxh32_intdigest(text)
                    out += [(piece, lang) for n, piece in enumerate(pieces(text)) if xxhash.xxh64_intdigest(piece, seed + n) < share[lang] * 2**64]
            if out:
                drawn, langs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.binary()), pa.array(langs)], names=["piece", "lang"])

    learned = known.where("NOT checks").select("text", "lang").mapInArrow(draw, "piece binary, lang string").collect()
    model = train(sorted((bytes(r["piece"]), r["lang"]) for r in learned))
    if model is None:
        return None
    sent = known.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(logits(sent.value, text).tolist(), lang) for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if LETTER.search(text) and lang in sent.value.languages]
            if rows:
                scores, langs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(scores, pa.list_(pa.float64())), pa.array(langs)], names=["scores", "lang"])

    drawn = F.shiftrightunsigned(F.xxhash64("text", F.lit("calibration")), 11) < F.lit(chance * 2**53)
    checked = known.where("checks").where(drawn).select("text", "lang").mapInArrow(score, "scores array<double>, lang string").collect()
    code = {lang: i for i, lang in enumerate(model.languages)}
    calibrate(model, np.array([r["scores"] for r in checked]), np.array([code[r["lang"]] for r in checked], int))
    return model


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held))
    return predict(docs, model).withColumn("held_out", held)
