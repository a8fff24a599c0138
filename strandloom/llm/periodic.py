"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids.

A word is a longest stretch of characters other than blank and U+0009 to U+000D. A run is a stretch of words with smallest
period q (words q apart are equal) and length >= max(6, 4 q), which no neighbouring word extends keeping that period.

The words of many documents stand in one array of interned ids, each document followed by an id of its own, so that nothing
repeats across documents. The array is halved into aligned blocks of 8, 16, 32, ... words. A run crosses the midpoint of
the smallest block that holds it, with two periods at least on one side of it. So for each block and each period up to a
quarter of it, equal words at the midpoint are looked for on either side, all blocks of a size in one comparison; only
where they are found, two Z-functions (of the right half against the block, and of the reversed left half against the
reversed block) give how far each period reaches. A repetition that a word outside its block extends crosses the midpoint
of a larger block and is taken there whole, so each run is taken once; equal intervals keep their smallest period. Time is
O(n log n) for any text, and nothing is shuffled.

Defined results: a null text has no words; a null id has no effect on the search; rows that repeat a document give equal
rows; a document of any length is searched whole (its words are in the memory of one task); extra columns of the input are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words that are searched together; a longer document is searched alone.
BATCH_WORDS = 1 << 19

Run = tuple[int, int, int]


def z_values(t: list[int], starts: list[int]) -> dict[int, int]:
    """The Z-function of ``t`` at ``starts`` (ascending; before the length of the first part, every place whose word equals
    the first, since where words differ the value is 0)."""
    z: dict[int, int] = {}
    left = right = 0
    n = len(t)
    for i in starts:
        k = 0
        if i < right:
            k = min(z.get(i - left, 0), right - i)
            if i + k < right:
                z[i] = k
                continue
        while i + k < n and t[k] == t[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _half_values(near: np.ndarray, far: np.ndarray) -> dict[int, int]:
    """Z-values of near + far + near, with a mark after the first part; starts lie in the first two parts."""
    t = np.concatenate((near, np.array([-1], near.dtype), far, near))
    head = np.flatnonzero(t[: len(near) + 1 + len(far)] == t[0])
    return z_values(t.tolist(), head[1:].tolist())


def crossing(ids: np.ndarray, low: int, high: int, left: list[int], right: list[int]) -> Iterator[Run]:
    """Repetitions (start, end, period) that cross the midpoint of the block [low, high) and end inside it.

    ``left`` and ``right`` are the periods to look at with two periods before, or from, the midpoint on.
    """
    mid = (low + high) // 2
    u, v = ids[low:mid], ids[mid:high]
    ahead, back = _half_values(v, u), _half_values(u[::-1], v[::-1])
    nu, nv = len(u), len(v)
    found = [(mid - p - back.get(p, 0), mid + ahead.get(nv + 1 + nu - p, 0), p) for p in left]
    found += [(mid - back.get(nu + 1 + nv - p, 0), mid + p + ahead.get(p, 0), p) for p in right]
    last = len(ids) - 1
    for start, end, p in found:
        whole = not (start == low and start > 0 and ids[start - 1] == ids[start - 1 + p]) and not (end == high and end <= last and ids[end] == ids[end - p])
        if whole and end - start >= max(LEAST_LENGTH, LEAST_PERIODS * p):
            yield start, end, p


def runs(ids: np.ndarray, longest: int) -> list[Run]:
    """All runs (start, end, period) of ``ids`` (below 0 only once each), where no run is longer than ``longest``.

    From the largest blocks down. In a block inside a run of period r that is known, a repetition of period p >= r / 3 has
    length >= 4 p >= p + r, so it is a part of that run and isn't looked at.
    """
    size = 8
    while size < len(ids):
        size *= 2
    w = np.concatenate((ids, -2 - len(ids) - np.arange(size - len(ids), dtype=ids.dtype)))
    best: dict[tuple[int, int], int] = {}
    while size >= 8:
        blocks, half = w.reshape(-1, size), size // 2
        q = min(size // LEAST_PERIODS, longest // LEAST_PERIODS)
        inside = np.full(len(blocks), np.iinfo(np.int64).max)
        for (start, end), period in best.items():
            first, last = -(-start // size), end // size
            if first < last:
                inside[first:last] = np.minimum(inside[first:last], period)
        base = np.arange(len(blocks)) * size + half
        # a run with two periods before the midpoint has equal words at mid, mid - p and mid - 2 p, and just before them
        b, p = np.nonzero(blocks[:, half - q : half] == blocks[:, half : half + 1])
        p = q - p
        m = base[b]
        ok = (3 * p < inside[b]) & (w[m - 2 * p] == w[m - p]) & (w[m - 1 - p] == w[m - 1]) & (w[m - p - p // 2] == w[m - p // 2])
        sides = [(b[ok], p[ok])]
        # with two periods from the midpoint on: at mid - 1, mid - 1 + p and mid - 1 + 2 p, and just after them
        b, p = np.nonzero(blocks[:, half : half + q] == blocks[:, half - 1 : half])
        p = p + 1
        m = base[b]
        ok = (3 * p < inside[b]) & (w[m - 1 + 2 * p] == w[m - 1 + p]) & (w[m + p] == w[m]) & (w[m + p + p // 2] == w[m + p // 2])
        sides.append((b[ok], p[ok]))
        wanted: dict[int, tuple[list[int], list[int]]] = {}
        for side, (bs, ps) in enumerate(sides):
            for at, period in zip(bs.tolist(), ps.tolist()):
                wanted.setdefault(at, ([], []))[side].append(period)
        for at, (left, right) in wanted.items():
            for start, end, period in crossing(w, at * size, at * size + size, left, right):
                if period < best.get((start, end), period + 1):
                    best[start, end] = period
        size //= 2
    return sorted((s, e, p) for (s, e), p in best.items())


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def search(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document, (start, end, period) by start and period."""
    known: dict[bytes, int] = {}
    offsets = np.cumsum([0] + [len(d) + 1 for d in documents])
    ids = np.empty(offsets[-1], dtype=np.int64)
    for i, words in enumerate(documents):
        ids[offsets[i] : offsets[i + 1] - 1] = [known.setdefault(w, len(known)) for w in words]
    ids[offsets[1:] - 1] = -2 - np.arange(len(documents))
    found: list[list[Run]] = [[] for _ in documents]
    for start, end, period in runs(ids, max(map(len, documents), default=0)):
        i = int(np.searchsorted(offsets, start, side="right")) - 1
        found[i].append((start - int(offsets[i]), end - int(offsets[i]), period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], found: list[Run]) -> str:
    """The words, without those that a run holds after its first period, joined by blanks."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, end, period in found:
        drop[start + period] += 1
        drop[end] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist() if found else range(len(words))
    return b" ".join([words[i] for i in kept]).decode()


def detect(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row for each row of ``docs`` (doc_id, text).

    runs: array of (start, length, period) by start, then period; collapsed: the text with each run cut to its first
    period, words joined by single blanks. ``edit`` may change a document's words before the search.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            begin, documents, n = 0, [], 0
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                documents.append(edit(ids[i].as_py(), words) if edit else words)
                n += len(documents[-1]) + 1
                if n >= BATCH_WORDS or i == batch.num_rows - 1:
                    found = search(documents)
                    columns = [
                        ids.slice(begin, len(documents)),
                        pa.array([len(d) for d in documents], pa.int64()),
                        pa.array([[{"start": s, "length": e - s, "period": p} for s, e, p in f] for f in found], run_type),
                        pa.array([collapsed(d, f) for d, f in zip(documents, found)], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                    begin, documents, n = i + 1, [], 0

    return docs.mapInArrow(step, out)
