"""Language of text by a linear-chain conditional random field over its words.

Each word (a run of letters) gets a score for each language from hashed features: its first and last letters, its letter
pairs and triples, and the word itself (the lexicon). Learned transition scores tie neighbours, and forward-backward
gives each word's probabilities, so switches inside a text show. A document's language has the largest mean probability
over its words; that mean is its score.

The words of a text are one chain, however many; texts of about one length run in step, and a very long text in segments
that pass their forward and backward sums on. The model learns from chains of CHAIN words spliced from labelled texts of
several languages, by gradient descent on the exact log-likelihood.

Defined results: null texts and texts without a letter get ``und`` and score 0; ties go to the first language in order;
a run of over WORD letters counts as several words; texts of any length are read whole; without any labelled text every
result is ``und``; an empty table gives an empty result. Other columns of the input are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 20
CHAIN = 48
#: Buckets of hashed features, a power of two.
BUCKETS = 1 << 16
#: The documented bound of the sample that teaches: so many texts a language, each of at most so many characters, and so
#: many texts in all (but one of each language at least).
SAMPLE_PER_LANGUAGE = 100
SAMPLE_CHARS = 6_000
SAMPLE_ROWS = 20_000
#: Words that are labelled in one go, of many texts or of a long one.
SEGMENT = 98_304
#: Words whose scores a worker remembers; emptied when full, which changes no result.
MEMORY = 300_000
LETTERS = re.compile(rf"[^\W\d_]{{1,{WORD}}}")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (words x features) and which of them are there. Words are lower case, at most WORD letters."""
    n = len(words)
    if not n:
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), bool)
    letters = np.array(words, dtype=f"U{WORD}").view(np.uint32).reshape(n, WORD).astype(np.uint64)
    length = (letters > 0).sum(1)
    if WORD > (longest := int(length.max())):
        letters = letters[:, :longest]
    width = letters.shape[1]
    keys, there = [], []

    def put(kind: int, value: np.ndarray, ok: np.ndarray) -> None:
        keys.append(mix(value * np.uint64(0x100000001B3) + np.uint64(kind)))
        there.append(ok)

    rows, zero = np.arange(n), np.zeros(n, np.uint64)
    prefix, suffix, whole = zero, zero, zero
    for k in range(1, min(4, width) + 1):
        prefix = mix(prefix + letters[:, k - 1])
        last = np.where(length >= k, letters[rows, np.maximum(length - k, 0)], 0)
        suffix = mix(suffix + last)
        put(10 + k, prefix, length >= k)
        put(20 + k, suffix, length >= k)
    for k in range(width):
        whole = np.where(length > k, mix(whole + letters[:, k]), whole)
    put(1, whole, length > 0)
    for k in range(width):
        put(2, letters[:, k], length > k)
    for k in range(width - 1):
        put(3, letters[:, k] << np.uint64(21) | letters[:, k + 1], length > k + 1)
    for k in range(width - 2):
        put(4, letters[:, k] << np.uint64(42) | letters[:, k + 1] << np.uint64(21) | letters[:, k + 2], length > k + 2)
    return (np.stack(keys, 1) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.stack(there, 1)


def forward_backward(emit: np.ndarray, move: np.ndarray, start: np.ndarray, there: np.ndarray):
    """Word probabilities (chains x words x labels), transition counts and log-likelihood norm of each chain.

    ``emit``: scores (chains x words x labels); ``there``: which words exist, always the first ones of a chain.
    """
    chains, steps, labels = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.where(there[:, :, None], np.exp(emit - top), 1.0)
    m = np.exp(move)
    alpha = np.empty_like(e)
    scale = np.ones((chains, steps))
    a = e[:, 0] * np.exp(start)
    for t in range(steps):
        if t:
            a = np.where(there[:, t, None], (alpha[:, t - 1] @ m) * e[:, t], alpha[:, t - 1])
        s = a.sum(1)
        scale[:, t] = np.where(there[:, t], s, 1.0)
        alpha[:, t] = a / s[:, None]
    beta = np.ones((chains, labels))
    gamma = np.empty_like(e)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        g = alpha[:, t] * beta
        gamma[:, t] = g / g.sum(1, keepdims=True)
        if t:
            on = there[:, t]
            right = e[:, t] * beta
            joint = alpha[:, t - 1][:, :, None] * m[None] * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[on].sum(0)
            back = right @ m.T
            beta = np.where(on[:, None], back / back.sum(1, keepdims=True), beta)
    norm = (np.log(scale) + np.where(there, top[:, :, 0], 0)).sum(1)
    return gamma * there[:, :, None], pairs, norm


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x labels, float32
    move: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        index, there = features(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(index.shape[1]):
            out += self.weights[index[:, k]] * there[:, k, None]
        return out


def train(texts: list[str], labels: list[str], rounds: int = 30, seed: int = 11) -> Model:
    """AdaGrad on the log-likelihood of chains spliced from texts, so that switches of language are learned too."""
    languages = sorted(set(labels))
    k = len(languages)
    rng = np.random.default_rng(seed)
    runs: list[tuple[list[str], int]] = []
    for text, label in zip(texts, labels, strict=True):
        words = LETTERS.findall(text.lower())
        at = 0
        while at < len(words):
            n = int(rng.integers(6, CHAIN))
            runs.append((words[at : at + n], languages.index(label)))
            at += n
    order = rng.permutation(len(runs))
    stream_w = [w for i in order for w in runs[i][0]]
    stream_y = np.array([runs[i][1] for i in order for _ in runs[i][0]], dtype=np.int64)
    n = len(stream_w)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if n == 0 or k < 2:
        return model
    index, there = features(stream_w)
    index = index.astype(np.int32)
    chains = -(-n // CHAIN)
    pad = chains * CHAIN - n
    on = np.r_[np.ones(n, bool), np.zeros(pad, bool)].reshape(chains, CHAIN)
    y = np.r_[stream_y, np.zeros(pad, np.int64)].reshape(chains, CHAIN)
    truth = np.eye(k)[y] * on[:, :, None]
    both = on[:, 1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    flat, row = index[there], np.nonzero(there)[0].astype(np.int32)
    del index, there
    sums, sums_move = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(rounds):
        emit = np.zeros((n, k))
        for c in range(k):
            emit[:, c] = np.bincount(row, model.weights[flat, c], minlength=n)
        emit = np.vstack([emit, np.zeros((pad, k))]).reshape(chains, CHAIN, k)
        gamma, pairs, _ = forward_backward(emit, model.move, model.start, on)
        error = ((truth - gamma).reshape(-1, k)[:n]) / n
        for c in range(k):
            grad = np.bincount(flat, error[row, c], minlength=BUCKETS) - 1e-7 * model.weights[:, c]
            sums[:, c] += (grad * 1e3) ** 2
            model.weights[:, c] += (0.3 * grad * 1e3 / np.sqrt(sums[:, c])).astype(np.float32)
        grad = (seen - pairs) / n * 1e3
        sums_move += grad**2
        model.move += 0.2 * grad / np.sqrt(sums_move)
    return model


def fit(docs: DataFrame, learn: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from (doc_id, text, lang) rows with a language, only where ``learn`` (a condition on doc_id) holds.

    One pass takes the texts whose ids hash lowest in each language, by a window that each task limits before the shuffle;
    texts of over SAMPLE_CHARS characters come after all others of their language, and teach by their first ones.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.withColumn("__long", F.length("text") > SAMPLE_CHARS).withColumn("text", F.left("text", F.lit(SAMPLE_CHARS)))
    if learn is not None:
        known = known.where(learn)
    languages = known.select("lang").distinct().count()
    each = max(1, min(per_language, SAMPLE_ROWS // max(languages, 1)))
    order = Window.partitionBy("lang").orderBy("__long", F.xxhash64("doc_id", F.lit(20)), "doc_id", F.xxhash64("text"))
    rows = known.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= each).drop("__r").collect()
    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]) for r in rows})
    return train([r[3] for r in rows], [r[2] for r in rows])


class Labeller:
    """Documents' languages by a model, with a memory of words."""

    def __init__(self, model: Model, memory: int = MEMORY, segment: int = SEGMENT):
        self.model, self.memory, self.segment = model, memory, segment
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)
        self.move = np.exp(model.move)

    def scores(self, words: list[str]) -> np.ndarray:
        """The words' rows of the table of scores, as factors of at most 1."""
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            if len(known) + len(fresh) > self.memory:
                known.clear()
                fresh = list(dict.fromkeys(words))
            base = len(known)
            while len(self.table) < base + len(fresh):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            for i in range(0, len(fresh), 20_000):
                part = self.model.emissions(fresh[i : i + 20_000])
                self.table[base + i : base + i + len(part)] = np.exp(part - part.max(1, keepdims=True))
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].astype(float)

    def segments(self, words: list[str]) -> Iterator[np.ndarray]:
        """Probabilities (words x labels) of one text's segments, the last segment first.

        The forward sums at the segments' starts are kept; each segment's own are made again on the way back.
        """
        parts = [words[i : i + self.segment] for i in range(0, len(words), self.segment)]
        starts = [np.exp(self.model.start)[None]]
        for part in parts[:-1]:
            last = forward(self.scores(part)[:, None], self.move, starts[-1], np.ones(len(part), np.int64))[-1]
            starts.append(last @ self.move)
        back = np.ones((1, len(self.model.languages)))
        for part in reversed(parts):
            one = np.ones(len(part), np.int64)
            e = self.scores(part)[:, None]
            alpha = forward(e, self.move, starts.pop(), one)
            back = backward(alpha, e, self.move, back, one)
            yield alpha[:, 0]

    def words(self, words: list[str]) -> np.ndarray:
        """Probabilities (words x labels) along the chain of one text."""
        out = list(self.segments(words))[::-1]
        return np.vstack(out) if out else np.zeros((0, len(self.model.languages)))

    def means(self, texts: list[list[str]]) -> np.ndarray:
        """Mean probabilities (texts x labels) over the words of each text; the texts go from the longest to the shortest."""
        k = len(self.model.languages)
        if len(texts) == 1 and len(texts[0]) > self.segment:
            return sum(part.sum(0) for part in self.segments(texts[0]))[None] / len(texts[0])
        length = np.array([len(t) for t in texts])
        count = (length[None] > np.arange(length[0])[:, None]).sum(1)
        e = np.ones((length[0], len(texts), k))
        filled = np.arange(length[0])[:, None] < length[None]
        e.transpose(1, 0, 2)[filled.T] = self.scores([w for t in texts for w in t])
        alpha = forward(e, self.move, np.exp(self.model.start)[None], count)
        backward(alpha, e, self.move, np.ones((len(texts), k)), count)
        return (alpha * filled[:, :, None]).sum(0) / length[:, None]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return names, scores
        todo = []
        for i, text in enumerate(texts):
            words = LETTERS.findall(text.lower()) if text else []
            if any(c.isalpha() for w in words for c in w):  # numerals can look like letters
                todo.append((len(words), i, words))
        todo.sort(key=lambda x: (-x[0], x[1]))
        at = 0
        while at < len(todo):
            # as many texts as fit when each is as long as the first
            group = todo[at : at + max(1, self.segment // todo[at][0])]
            at += len(group)
            for (_, i, _), mean in zip(group, self.means([w for _, _, w in group]), strict=True):
                best = int(mean.argmax())
                names[i], scores[i] = self.model.languages[best], float(min(1.0, max(0.0, mean[best])))
        return names, scores


def forward(e: np.ndarray, move: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Forward sums (steps x texts x labels), each of sum 1. ``e``, ``move``: factors; ``first``: those before the first word;
    ``count``: how many texts, the first ones, have so many words."""
    alpha = np.ones_like(e)
    for t, n in enumerate(count.tolist()):
        a = (alpha[t - 1, :n] @ move if t else first) * e[t, :n]
        alpha[t, :n] = a / a.sum(1, keepdims=True)
    return alpha


def backward(alpha: np.ndarray, e: np.ndarray, move: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Turns forward sums into probabilities; ``back``: the sums behind the last words. Returns those before the first."""
    for t in range(len(count) - 1, -1, -1):
        n = int(count[t])
        a = alpha[t, :n] * back[:n]
        alpha[t, :n] = a / a.sum(1, keepdims=True)
        b = (e[t, :n] * back[:n]) @ move.T
        back[:n] = b / b.sum(1, keepdims=True)
    return back


def posteriors(emit: np.ndarray, move: np.ndarray, start: np.ndarray, there: np.ndarray) -> np.ndarray:
    """As forward_backward, the word probabilities alone."""
    order = np.argsort(-there.sum(1), kind="stable")
    count = there[order].sum(0)
    e = np.exp(emit - emit.max(2, keepdims=True))[order].transpose(1, 0, 2).copy()
    alpha = forward(e, np.exp(move), np.exp(start)[None], count)
    backward(alpha, e, np.exp(move), np.ones((len(order), emit.shape[2])), count)
    out = np.empty_like(emit)
    out[order] = alpha.transpose(1, 0, 2)
    return out * there[:, :, None]


def label_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score. One narrow pass."""
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = chosen.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch.pop("__text")]
            names, scores = labeller.label(texts)
            yield batch.assign(lang_pred=names, score=scores)

    return chosen.mapInPandas(run, schema)
