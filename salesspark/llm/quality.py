"""Operator 10: quality classifier, logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A text is cut into words, numbers and runs of punctuation. Its features are hashed runs of one and two of these, and of
one to three of their shapes (lower case, capital first, upper case, number, the punctuation itself, and whether it
repeats the one before), in ``DIMS`` places, weighed by their share of the text. The score is the logistic function of a sparse dot
product; label, lang, source and doc_id are never inputs.

The fit takes the ``max_rows`` training rows with the smallest hash of ``doc_id`` (a documented bound), deals them to
``PARTS`` tasks, each of which runs ``EPOCHS`` passes of follow-the-regularised-leader updates per coordinate, and averages the
models. What reaches the driver are PARTS vectors of DIMS numbers, whatever the input.

Defined results: a null or empty text has no features and gets the score of the bias. Labels other than 0 and 1 and null ones are
left out; a document with several labels counts as its smallest. With no training row at all every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesspark.llm.kept import Kept, done_with, owns, working_for

DIMS = 1 << 18
PARTS, EPOCHS = 8, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
SCALE = 30.0
KEPT_BYTES = 24 << 20
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")


def _hash_and_shape(token: bytes) -> int:
    """Hash and shape of a token in one number."""
    first = token[:1]
    if first.isdigit():
        shape = 1
    elif first.isalpha() or first >= b"\x80":
        shape = 2 if token.islower() else 3 if token[1:].islower() else 4 if len(token) == 1 else 5 if token.isupper() else 6
    else:
        shape = 8 + zlib.crc32(token) % 248
    return (zlib.crc32(token) << 8) | shape


_TOKENS = Kept(_hash_and_shape, KEPT_BYTES, longest=64)
owns("quality", _TOKENS.forget)


def places(text: bytes | None) -> np.ndarray:
    """The place of each n-gram of a text, repeats included."""
    found = _TOKEN.findall(text or b"")
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(_TOKENS.__getitem__, found), np.uint64, n)
    h, shape = both >> np.uint64(8), both & np.uint64(255)
    shape = shape.copy()
    shape[1:] += np.uint64(256) * (h[1:] == h[:-1])
    m = lambda x, salt: ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    grams = [m(h, 1), m(shape, 2 << 40)]
    if n > 1:
        grams += [m(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:], 3), m((shape[:-1] << np.uint64(10)) | shape[1:], 4 << 40)]
    if n > 2:
        grams.append(m((shape[:-2] << np.uint64(20)) | (shape[1:-1] << np.uint64(10)) | shape[2:], 5 << 40))
    return np.concatenate(grams).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """FTRL-proximal over (places, values, label) in order; the weights, with the bias last."""
    z, s = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for _ in range(EPOCHS):
        for at, x, y in rows:
            zi, si = z[at], s[at]
            root = np.sqrt(si)
            w = -np.where(np.abs(zi) <= L1, 0.0, zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
            g = (_sigmoid(float(w @ x)) - y) * x
            z[at] += g - (np.sqrt(si + g * g) - root) / ALPHA * w
            s[at] += g * g
    return -np.where(np.abs(z) <= L1, 0.0, z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2)


def sparse(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values, with the bias as the last place."""
    p = places(text)
    at, n = np.unique(p, return_counts=True)
    return np.append(at, DIMS), np.append(n * (SCALE / max(1, len(p))), 1.0)


def score_text(text: bytes | None, weights: np.ndarray) -> float:
    p = places(text)
    return float(_sigmoid(weights[DIMS] + (weights[p].sum() * SCALE / len(p) if len(p) else 0.0)))


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 16_000) -> np.ndarray:
    """Weights fitted on at most ``max_rows`` rows of ``labels`` (already without those held out)."""
    chosen = (labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("y")).filter("l_id IS NOT NULL AND y IN (0, 1)")
              .groupBy("l_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("binary").alias("text")) \
        .join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")) \
        .select("text", F.col("y").cast("double").alias("y"), F.xxhash64(F.lit(1), "l_id").alias("at"))
    part = F.pmod("at", F.lit(PARTS)).alias("part")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        working_for("quality")
        pdf = pdf.sort_values(["at", "y"], kind="stable")
        made = [(*sparse(t), y) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
        return pd.DataFrame({"w": [follow_leader(made).tobytes()]})

    fitted = rows.groupBy(part).applyInPandas(fit, "w binary").collect()
    if not fitted:
        return np.zeros(DIMS + 1)
    return np.mean([np.frombuffer(r["w"], np.float64) for r in fitted], axis=0)


def scored(docs: DataFrame, weights: np.ndarray, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``out``: the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        working_for("quality")
        w = shared.value
        try:
            for texts in batches:
                yield pd.Series([score_text(t, w) for t in texts], dtype="float64")
        finally:
            done_with("quality")

    return docs.withColumn(out, score(F.col(text_col).cast("binary")))
