"""Hierarchical multi-length packing of tokenised documents.

A document goes to the shortest window tier that holds it (a longer one is cut into whole windows of the longest tier
first). Each tier is packed best fit, longest fragment first; the gaps that stay in the long windows are filled from the
fragments of shorter tiers, the last of them cut to fit, so that a window closes only when it is full. What is left at the
end of a task's rows closes in windows of falling tiers; only the rest below the shortest tier is padded, at most one
sequence a task.

Packing is local to a task: no shuffle, no global order, and memory bounded by a block of rows and one window a tier.
The sequence ids carry the task's number, so they are unique. The pieces are written; then a second, small pass counts the
windows of each task and tier, and numbers the windows of a tier through all tasks, so that step groups hold the same number
of tokens of one tier each, but for the last group of a tier.

Defined results: null and empty texts pack as the end id alone; a text of any length is cut, none is dropped; rows that
repeat are packed each; ids of a document lie in exactly one piece each; an empty table gives an empty result. Columns
other than the id are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, written

#: Window lengths of the tiers, ascending; each a power of two.
TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens of a step group.
STEP_TOKENS = 32_768
#: Tokens of documents that wait together for packing.
BLOCK_TOKENS = 1_500_000
#: Entries of each half of the memory of words.
MEMORY = 250_000

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
#: The same within a task: the task, and the window's number of its tier there.
LOCAL = PIECE.replace("step_group bigint", "task int, step bigint")
LOCAL_TYPES = {c.split()[0]: pa.int32() if c.endswith(" int") else pa.int64() for c in LOCAL.split(", ")}


class Lately:
    """What was asked for lately, in two halves of at most ``size`` entries: the newer half, when full, becomes the older, and
    what is found there moves back. So words that come again stay, and those of one text go."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def older(self, key: str) -> bytes | None:
        known = self.old.get(key)
        if known is not None:
            self.put(key, known)
        return known

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordTokens:
    """Packed ids of text by a word-level BPE file of ``tokenizers``, each pre-token encoded once and remembered.

    The file's normaliser (NFC, white space to a space, lower case) and its splitting never look across white space, so
    a chunk between ASCII white space has the same ids alone as in its text.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds one of the file's own marks is encoded whole, as the library does
        self.marks = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what all marks begin with, where that has no case, is looked for first; the empty text is in every text
        begin = os.path.commonprefix(self.marks)
        self.sign = begin if begin == begin.upper() else ""
        self.model = self.tokenizer.model
        # chunks and words in one: a chunk that is one word has that word's ids
        self.known = Lately(memory)
        # The splitter of a chunk of plain letters and marks; anything else goes to the tokenizer as it is.
        self.plain = re.compile(r"[0-9a-zà-öø-ÿœß!-/:-@\[-`{-~]+\Z")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def _raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if not self.plain.match(low):
            return self._raw(chunk)
        memory, out = self.known, []
        for word in self.split.findall(low):
            known = memory.new.get(word)
            if known is None:
                known = memory.older(word)
            if known is None:
                # the pre-token alone, as the file's byte-level step shows it to the model
                shown = word if word.isascii() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
                known = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
                memory.put(word, known)
            out.append(known)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        if self.sign in text:
            low = text.lower()
            if any(mark in low for mark in self.marks):
                return self._raw(text)
        memory = self.known
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(memory.new.get, parts))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    chunk = parts[i]
                    known = memory.new.get(chunk)
                    if known is None:
                        known = memory.older(chunk)
                    if known is None:
                        known = self._chunk(chunk)
                        if len(chunk) <= 64:
                            memory.put(chunk, known)
                    out[i] = known
        return b"".join(out)


#: The letters by which byte-level BPE shows bytes: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


@lru_cache(maxsize=1)
def shared_words(path: str) -> WordTokens:
    """One memory of words for all tasks that a worker process runs."""
    return WordTokens(path)


class Packer:
    """Packs fragments (document, start, length) into full windows; whatever waits stays for the next block."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of each tier (length, number, start), the longest last
        self.steps = {t: 0 for t in tiers}
        self.made = 0
        self.out: list[tuple[int, int, int, int, int, int, int]] = []  # number, start, length, sequence, offset, tier, group

    def route(self, length: int) -> int:
        """The number of the shortest tier whose window holds a fragment."""
        return min(bisect_left(self.tiers, length), len(self.tiers) - 1)

    def wait(self, piece: tuple[int, int, int]) -> None:
        insort(self.waiting[self.route(piece[0])], piece)

    def close(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        offset = 0
        for length, number, start in pieces:
            self.out.append((number, start, length, self.made, offset, tier, self.steps[tier]))
            offset += length
        self.steps[tier] += 1
        self.made += 1

    def add(self, number: int, length: int) -> None:
        start, longest = 0, self.tiers[-1]
        while length - start >= longest:
            self.close([(longest, number, start)], longest)
            start += longest
        if length > start:
            self.wait((length - start, number, start))

    def best_fit(self, gap: int) -> tuple[int, int, int] | None:
        """The longest fragment that fits a gap, of its tier or of the next shorter one that has any."""
        for rows in reversed(self.waiting[: self.route(gap) + 1]):
            if i := bisect_left(rows, (gap + 1,)):
                return rows.pop(i - 1)
        return None

    def cut(self, gap: int) -> tuple[int, int, int]:
        """As much as fits of the shortest fragment; the rest waits on."""
        length, number, start = next(rows for rows in self.waiting if rows).pop(0)
        self.wait((length - gap, number, start + gap))
        return gap, number, start

    def fill(self, window: int) -> None:
        """One full window: its longest fragments first, then the best fits from this and the shorter tiers, the last cut."""
        gap, pieces = window, []
        while gap:
            pieces.append(self.best_fit(gap) or self.cut(gap))
            gap -= pieces[-1][0]
        self.close(pieces, window)

    def pack(self, last: bool) -> None:
        """Close full windows, tier by tier from the longest, while enough waits; ``last``: leave nothing waiting."""
        total = sum(x[0] for rows in self.waiting for x in rows)
        for k in reversed(range(len(self.tiers))):
            # a tier's windows open with its own fragments; shorter ones fill the gaps
            while total >= self.tiers[k] and (last or any(self.waiting[k:])):
                self.fill(self.tiers[k])
                total -= self.tiers[k]
        if last and total:
            self.close([x for rows in reversed(self.waiting) for x in reversed(rows)], self.tiers[-1])
            self.waiting = [[] for _ in self.tiers]


def tokenize_and_pack(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, text: str = "text") -> DataFrame:
    """A row for each piece (see PIECE) of every document (doc_id and ``text``): one narrow pass over the texts.

    ``vocabulary`` is the path of a tokenizer file that every executor has, as part of an installed package.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        base = task << 34
        words, packer, end = shared_words(vocabulary), Packer(tiers), end_id.to_bytes(4, "little")
        held: dict[int, tuple[int | None, bytes]] = {}
        number = waits = 0

        def result() -> pa.RecordBatch:
            rows = []
            for n, start, length, sequence, offset, tier, step in packer.out:
                doc, ids = held[n]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                rows.append((doc, start, length, crc, len(ids) // 4, base + sequence, offset, tier, task, step))
            packer.out.clear()
            alive = {x[1] for rows in packer.waiting for x in rows}
            for n in held.keys() - alive:
                del held[n]
            columns = zip(*rows) if rows else [()] * len(LOCAL.split(", "))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, LOCAL_TYPES.values(), strict=True)], names=list(LOCAL_TYPES))

        for part in in_slices(batches):
            for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = (words.packed(value) if value else b"") + end
                held[number] = (doc, ids)
                packer.add(number, len(ids) // 4)
                number += 1
                waits += len(ids) // 4
                if waits >= BLOCK_TOKENS:
                    packer.pack(last=False)
                    waits = 0
                    yield result()
        packer.pack(last=False)
        packer.pack(last=True)
        yield result()

    return in_steps(written(chosen.mapInArrow(run, LOCAL), "pieces"))


def in_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces with the step groups of their windows, numbered through all tasks; a group holds windows of one tier."""
    windows = pieces.groupBy("task", "tier").agg((F.max("step") + 1).alias("n"))
    # one row a task and tier
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = windows.select("task", "tier", F.coalesce(before, F.lit(0)).alias("first"))
    number = F.floor((F.col("first") + F.col("step")) * F.col("tier") / step_tokens)
    # the tier stands above the numbers, so no two tiers share a group
    group = (F.col("tier").cast("bigint") * (1 << 40) + number).alias("step_group")
    return pieces.join(first, ["task", "tier"]).select(*(group if c.startswith("step_group") else c.split()[0] for c in PIECE.split(", ")))
