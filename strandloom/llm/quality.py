"""Compression classifier: text is scored by which of two zstandard dictionaries compresses it better.

One dictionary is built from text labelled good, one from text labelled bad. A text is cut into blocks, each block is
compressed once with either dictionary, and the normalised difference of the two sizes, with the size itself, is turned
into a probability by a logistic curve fitted on labelled rows that built neither dictionary.

Defined results: a null or empty text has no blocks and gets the score of the empty text (all features 0); text of any
length is read whole, in blocks; rows that repeat get the same score; an empty table gives an empty result; labels that
are null, or that contradict each other for one id, teach nothing, and of rows of one id the smallest text teaches; without labels of both kinds every score is the share
of good labels (0.5 without any). Other columns of the input, whatever their names, are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, lowest_by_hash

if TYPE_CHECKING:  # the pipeline's workers read this module and need none of it
    import pandas as pd

#: Fixed parameters of the production queries.
BLOCK = 1024
LEVEL = 3
DICT_BYTES = 112_640
#: At most so many labelled rows of each class teach the model, each of at most so many characters: the documented
#: bound of the sample that reaches the driver (2 x 1200 x 16,000 characters at the very most, 8 MB as a rule).
SAMPLE_PER_CLASS = 1200
SAMPLE_CHARS = 16_000


def blocks(text: str | None, size: int = BLOCK) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Sizer:
    """Sizes of a text's blocks as compressed with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for data in (good, bad):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if data:
                table = zstd.ZstdCompressionDict(data)
                table.precompute_compress(level=LEVEL)
                options["dict_data"] = table
            self.packers.append(zstd.ZstdCompressor(**options))

    def features(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        good, bad = (p.compress for p in self.packers)
        for i, text in enumerate(texts):
            parts = blocks(text)
            if parts:
                g, b, n = sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts), sum(map(len, parts))
                out[i] = (b - g) / (b + g), 1.0, min(1.5, (b + g) / (2 * n))
        return out


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the difference, its product with the size, the size, the size squared; then the intercept

    def score(self, features: np.ndarray) -> np.ndarray:
        z = design(features) @ np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def design(features: np.ndarray) -> np.ndarray:
    d, there, size = features.T
    return np.stack([10 * d, 10 * d * size, size * there, size * size, np.ones(len(d))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps that are halved until the loss falls."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if new > now:
            break
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-10 * max(now, 1e-12):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from (doc_id, text) and (doc_id, quality), only from ids for which ``learn`` (a condition on doc_id) holds."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("y")).where("low = y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if not counts.get(0) or not counts.get(1):
        odds = np.log(np.clip(prior, 0.01, 0.99) / np.clip(1 - prior, 0.01, 0.99))
        return Model(b"", b"", (0.0, 0.0, 0.0, 0.0, float(odds)))
    picked = lowest_by_hash(known.where("y = 1"), "doc_id", per_class, counts[1]).union(lowest_by_hash(known.where("y = 0"), "doc_id", per_class, counts[0]))
    # at most 2 x per_class rows: bounded by the parameter, so the broadcast is too; of rows of one id the smallest text
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(picked.select("doc_id", "y")), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted({(r["doc_id"], r["y"], r["text"]) for r in rows.collect()}, key=lambda r: (hash_order(r[0]), r[2]))
    texts = {c: [r[2] for r in rows if r[1] == c] for c in (0, 1)}
    teach = {c: texts[c][: max(1, len(texts[c]) // 2)] for c in (0, 1)}
    held = {c: texts[c][len(teach[c]) :] or teach[c] for c in (0, 1)}
    good, bad = (_dictionary([b for t in teach[c] for b in blocks(t)]) for c in (1, 0))
    sizer = Sizer(good, bad)
    x = design(np.concatenate([sizer.features(held[1]), sizer.features(held[0])]))
    y = np.r_[np.ones(len(held[1])), np.zeros(len(held[0]))]
    if not len(held[1]) or not len(held[0]):
        return Model(good, bad, (0.0, 0.0, 0.0, 0.0, float(np.log(prior / (1 - prior)))))
    # rows are weighted back to the shares of the two labels, so that a score is a probability among labelled rows
    weight = np.where(y == 1, prior / len(held[1]), (1 - prior) / len(held[0])) * len(y)
    return Model(good, bad, tuple(float(v) for v in logistic(x, y, weight)))


def hash_order(doc_id: int) -> int:
    """Mixes ids, so that halves of the sample don't follow their order."""
    return (int(doc_id) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1, higher is better) and predicted (1 from 0.5 on). One narrow pass, no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = chosen.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        sizer = Sizer(known.good, known.bad)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch.pop("__text")]
            yield batch.assign(score=known.score(sizer.features(texts)))

    return chosen.mapInPandas(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sizer = Sizer(known.good, known.bad)
        for part in in_slices(batches):
            yield part.filter(pa.array(known.score(sizer.features(part.column("text").to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
