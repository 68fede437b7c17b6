"""Document quality by logistic regression over hashed word n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.llm.labelled import MAX_LABELLED, held_out, labelled_sample
from echoframe.llm.textbytes import LOWER, WordHasher, byte_class, mix, pieces, raw_bytes, release_worker, word_bounds

_U = np.uint64
_WORD = byte_class(separators=[0x20, *range(0x09, 0x0E)])
_LETTER = byte_class(words=[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGIT = byte_class(words=range(0x30, 0x3A))


@dataclass(frozen=True)
class Settings:
    """Hyper-parameters. ``scale`` is the length of a row before hashing, in features."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    epochs: int = 3
    scale: float = 20.0
    rows_per_learner: int = 2_500


class Features:
    """Hashed 1- and 2-grams of words and of word shapes.

    A shape keeps of a word how many letters, digits and signs it has, its last
    sign, and whether it repeats the word before, so that word n-grams that
    never occurred in training still share features.
    """

    def __init__(self, bits: int) -> None:
        self.shift = _U(64 - bits)
        self.hasher = WordHasher()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Groups of (feature index, row) and the words of every row."""
        low = LOWER[data]
        starts, ends, row = word_bounds(low, offsets, _WORD)
        n_rows = len(offsets) - 1
        counts = np.bincount(row, minlength=n_rows)
        if not len(starts):
            return [], counts
        h = self.hasher(low, starts, ends)
        pair = row[1:] == row[:-1]
        total = lambda flags: np.concatenate([[0], np.cumsum(flags[low], dtype=np.int32)])
        letters, digits = total(_LETTER), total(_DIGIT)
        n_letters, n_digits, size = letters[ends] - letters[starts], digits[ends] - digits[starts], ends - starts
        signs = size - n_letters - n_digits
        last = low[ends - 1].astype(np.int64)
        again = np.zeros(len(h), bool)
        again[1:] = pair & (h[1:] == h[:-1])
        shape = np.minimum(np.log2(size + 1).astype(np.int64), 7)
        for part in (np.minimum(n_letters, 3), np.minimum(n_digits, 3), np.minimum(signs, 4), np.where(_LETTER[last], 0, last), again):
            shape = shape * 257 + part
        s = mix(shape.astype(_U) + _U(0x51ED270B))
        grams = [h, s, (h[:-1] * _U(0x9E3779B1) + h[1:])[pair], (s[:-1] * _U(0x9E3779B1) + s[1:])[pair]]
        rows = [row, row, row[1:][pair], row[1:][pair]]
        return [((mix(g + _U(k + 1)) >> self.shift).astype(np.int64), r) for k, (g, r) in enumerate(zip(grams, rows, strict=True))], counts


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> np.ndarray:
    """Weights after ``epochs`` passes of per-row FTRL-proximal; the last one is the bias."""
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((b + np.sqrt(n[i])) / a + l2))

    for _ in range(settings.epochs):
        for i, x, y in rows:
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
            g = (p - y) * x
            old = n[i]
            z[i] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / a * w
            n[i] = old + g * g
    return weight(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED, settings: Settings = Settings()) -> np.ndarray:
    """Weights fitted on at most ``limit`` labelled rows of the training fold.

    Rows are dealt by a hash of their id to learners of about
    ``rows_per_learner`` rows, at most ``limit / rows_per_learner`` of them;
    each runs FTRL over its rows in a fixed order, and the weights are averaged
    by rows. The driver gets one weight vector per learner. Without labelled
    rows all weights are zero.
    """
    sample = labelled_sample(docs, labels, label, limit)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    learners = max(1, -(-min(known, limit) // settings.rows_per_learner))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"])
        features, rows = Features(settings.bits), []
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            groups, counts = features(data, np.array([0, len(data)]))
            i = np.concatenate([g for g, _ in groups]) if groups else np.zeros(0, np.int64)
            i, x = np.unique(i, return_counts=True)
            x = x * (settings.scale / max(1, counts[0]))
            rows.append((np.append(i, 1 << settings.bits), np.append(x, 1.0), int(y)))
        w = ftrl(rows, settings)
        return pd.DataFrame({"n": [len(rows)], "w": [w.astype(np.float32).tobytes()]})

    parts = (
        sample.withColumn("order", F.xxhash64("doc_id", F.lit(7)))
        .groupBy(F.pmod("order", F.lit(learners)).alias("learner"))
        .applyInPandas(learn, "n long, w binary")
        .collect()
    )
    mean = np.zeros((1 << settings.bits) + 1)
    for part in parts:
        mean += np.frombuffer(part["w"], np.float32) * (part["n"] / sum(p["n"] for p in parts))
    return mean


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, and the columns in ``keep``.

    The score is the logistic function of a sparse dot product over the whole
    text, however long. Null and empty texts get the score of the bias;
    repeated and null ids are rows of their own, an empty table gives no rows.
    The weights are a broadcast of fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c in (keep or [])]
    picked = docs.select(
        F.col("doc_id").cast("long").alias("_id"), held_out(F.col("doc_id")).alias("_held"), F.col("text").alias("_text"), *kept
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        w, features = held.value, Features(settings.bits)
        for batch in pieces(batches, "_text"):
            data, offsets = raw_bytes(batch.column("_text"))
            groups, counts = features(data, offsets)
            dot = np.zeros(batch.num_rows)
            for i, row in groups:
                dot += np.bincount(row, w[i], minlength=batch.num_rows)
            dot = dot * (settings.scale / np.maximum(counts, 1)) + w[-1]
            p = 1.0 / (1.0 + np.exp(-np.clip(dot, -35.0, 35.0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(batch.column(c) for c in kept)],
                names=["doc_id_", "held_out", "score", "predicted", *kept],
            )

    kinds = dict(docs.dtypes)
    schema = "doc_id_ long, held_out boolean, score double, predicted int" + "".join(f", `{c}` {kinds[c]}" for c in kept)
    out = picked.mapInArrow(run, schema)
    return out if kept else out.withColumnRenamed("doc_id_", "doc_id")
