"""Byte-level BPE with a hierarchical-bitmap rank queue.

The pairs of neighbouring tokens that can merge wait in buckets, one for each merge rank, and hold the position of the
pair's left token in a linked list. A bitmap of the ranks in use, with a bitmap over its words and one over those, gives
the lowest rank by three find-first-set steps. An entry whose pair has changed meanwhile is stale and skipped. Each
merge touches two neighbours only, so a pre-token of n bytes takes about n log n steps, however long it is.

Defined results: a null text encodes as the empty text (no ids); bytes that no rank covers raise KeyError (byte-level
ranks cover all 256); texts of any length are read whole; rows that repeat get the same ids; an empty table gives an
empty result. Columns other than those asked for are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, which \s stands for in tiktoken's patterns (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
#: Entries of a worker's memory of pre-tokens already encoded, and of chunks of them; emptied when full, which changes no
#: result.
MEMORY = 1_000_000
CHUNKS = 300_000


BIT = [1 << i for i in range(64)]


class RankQueue:
    """Buckets by rank under a three-level bitmap of 64-bit words."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self.low = [0] * words
        self.mid = [0] * ((words + 63) // 64)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        if bucket is None:
            self.buckets[rank] = [position]
        else:
            bucket.append(position)
        word = rank >> 6
        if not self.low[word]:
            high = word >> 6
            self.mid[high] |= BIT[word & 63]
            self.top |= BIT[high]
        self.low[word] |= BIT[rank & 63]

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position, of a queue that isn't empty (``top`` is not 0)."""
        top = self.top
        high = (top & -top).bit_length() - 1
        x = self.mid[high]
        word = high << 6 | (x & -x).bit_length() - 1
        y = self.low[word]
        rank = word << 6 | (y & -y).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        y &= y - 1
        self.low[word] = y
        if not y:
            x &= x - 1
            self.mid[high] = x
            if not x:
                self.top = top & top - 1
        return rank, bucket.pop()


class Encoder:
    """Encodes text by merge ranks (token bytes to id) and a pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        spaces = pattern.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
        self.pattern = regex.compile(spaces)
        # No pre-token runs from another character on into white space, so these chunks can be split alone. Python's
        # own expressions are faster here, and most chunks have been seen before.
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.memory = memory
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            self.tokens[rank] = data
        self.seen: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        ranks, queue = self.ranks, self.queue
        push, pop = queue.push, queue.pop
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ends = list(range(1, n + 1))  # of the token that begins here; 0 where none does
        before = list(range(-1, n - 1))
        waiting = [-1] * n  # the rank under which the pair that begins here waits
        get = ranks.get
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if waiting[i] != rank:
                continue  # stale
            mid = ends[i]
            end = ends[mid]
            ends[i], ends[mid], waiting[mid], waiting[i] = end, 0, -1, -1
            if end < n:
                before[end] = i
                now = get(data[i : ends[end]])
                if now is not None:
                    waiting[i] = now
                    push(now, i)
            left = before[i]
            if left >= 0:
                now = get(data[left:end])
                if now is None:
                    waiting[left] = -1
                elif now != waiting[left]:
                    waiting[left] = now
                    push(now, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pattern.findall(chunk):
            known = self.pieces.get(piece)
            if known is None:
                known = array("I", self.merge(piece.encode())).tobytes()
                if len(piece) <= 64:
                    if len(self.pieces) >= self.memory:
                        self.pieces.clear()
                    self.pieces[piece] = known
            out.append(known)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        seen = self.seen
        parts = self.chunks.findall(text)
        out = list(map(seen.get, parts))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    chunk = parts[i]
                    out[i] = known = seen.get(chunk) or self._chunk(chunk)
                    if len(chunk) <= 64:
                        if len(seen) >= CHUNKS:
                            seen.clear()
                        seen[chunk] = known
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.packed(text)).cast("I"))


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def shared_encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    return Encoder(load_ranks(path), pattern)


def decode(packed: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, memoryview(packed).cast("I")))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the packed ids. One narrow pass.

    ``vocabulary`` is the path of a rank file that every executor has, as part of an installed package.
    """
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    more = [F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), *([F.lit(b"").alias("ids")] if with_ids else [])]
    schema = chosen.select(*keep, F.lit(0).cast("bigint").alias("n_tokens"), *more).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(vocabulary, pattern)
        tokens = encoder.tokens
        for batch in batches:
            packed = [encoder.packed(t) if isinstance(t, str) else b"" for t in batch.pop("__text")]
            out = batch.assign(
                n_tokens=[len(p) // 4 for p in packed],
                ids_sha256=[hashlib.sha256(p).hexdigest() for p in packed],
                decoded_sha256=[hashlib.sha256(decode(p, tokens)).hexdigest() for p in packed],
            )
            yield out.assign(ids=packed) if with_ids else out

    return chosen.mapInPandas(run, schema)
