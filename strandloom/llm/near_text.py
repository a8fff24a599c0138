"""Near-duplicate documents by DartMinHash signatures, banded candidates and an exact check of the similarity.

A document is the set of its five-word shingles (weight 1 each, or the shingle's count where weights are asked for).
DartMinHash throws darts at the plane of weight and rank of every shingle: the darts of a shingle follow from its hash
alone, each hits one of K coordinates, and a coordinate keeps the dart of least rank among those that lie under the
shingle's weight. Ranks are searched up to a threshold at which about K log K darts are expected in the whole set, and
beyond it only while a coordinate is still empty; so the work is that of K log K + n darts, not K * n.

Copies (equal words in equal order) are folded into the smallest id. The signatures of what stays are banded (BANDS bands
of ROWS coordinates: a pair at similarity 0.8 is missed with probability below 1e-4), and the smallest id of a band bucket
is its centre. Each member is compared, exactly, on the shingles, with the centre that it shares most buckets with, and
linked documents join; then with its other centres that it isn't joined to yet: at most one comparison a band.

Buckets whose members are all joined then need no more. The members of the others are joined on rare shingles: in the order
of their frequency (shingles that one component alone holds first), two sets of similarity t have a common shingle so early
in both that as many as a link needs can follow it. Only such pairs of different components are listed and compared, of
those with one component one first. So near copies that are apart by edits of their own make no pairs, however many stand in
a bucket, and no pair of a bucket that could be a link is left out unless its two documents are joined already.

Defined results: a text of fewer than five words is one shingle of all its words; null texts and texts without a word
are near nothing, each a class of its own; a repeated row counts once, and its rows get the same class; rows of one id
but other text are one document, their smallest text; texts of any length are read whole; an empty table gives an empty
result; extra columns are not carried. A null id stays out of all comparison, with a null class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_slices, perhaps, settled, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 7
#: Words whose hashes a worker remembers; emptied when full, which changes no result.
MEMORY = 50_000

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Distinct shingle hashes (sorted) and their counts, of one text at a time."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        import xxhash

        known, words = self.known, text.lower().split()
        if len(known) > self.memory:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), U64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the text's shingles, in order."""
        words = self.words(text)
        n = len(words)
        if n == 0:
            return words
        width = min(SHINGLE, n)
        out = np.full(n - width + 1, U64(width), U64)
        for k in range(width):
            out = mix(out * GOLD + words[k : n - width + 1 + k])
        return out


def darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """The darts of all elements with rank in [low, high) of their owner: (owner, coordinate, rank).

    The plane is cut into unit cells of weight and rank. A cell's number of darts is Poisson with mean 1, drawn from
    the hash of element and cell; each dart's place and coordinate are drawn from the hash of element, cell and number.
    """
    # all cells of all elements at once: floor(low) .. high of rank, times the unit steps of weight
    first = np.floor(low).astype(np.int64)
    span = np.maximum(np.ceil(high).astype(np.int64) - first, 0)[owner]
    cells = span * np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), cells)
    number = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    v, r = np.divmod(number, span[at]) if len(at) and weight.max() > 1 else (np.zeros(len(at), np.int64), number)
    r += first[owner[at]]
    cell = mix(element[at] ^ mix(r.astype(U64) * GOLD + (v + 1).astype(U64)))
    count = np.searchsorted(POISSON, (cell >> U64(11)).astype(np.float64) * 2.0**-53, side="right")
    # one row for each dart, numbered within its cell
    which = np.repeat(np.arange(len(cell)), count)
    x = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = mix(cell[which] + (x + 1).astype(U64) * GOLD)
    rank = r[which] + (place >> U64(32)).astype(np.float64) * 2.0**-32
    here = at[which]
    own = owner[here]
    good = (rank >= low[own]) & (rank < high[own])
    other = mix(place)
    good &= v[which] + (other >> U64(40)).astype(np.float64) * 2.0**-24 < weight[here]
    coordinate = (((other & U64(0xFFFFFFFF)) * U64(k)) >> U64(32)).astype(np.int64)
    return own[good], coordinate[good], rank[good]


#: Cumulative probabilities of a Poisson variable of mean 1.
POISSON = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(20)])


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """The k least ranks (as 64-bit numbers) of each of ``sets`` weighted sets; ``owner`` says to which an element belongs."""
    total = np.bincount(owner, weight, sets)
    best = np.full(sets * k, np.inf)
    low = np.zeros(sets)
    high = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12), 0.0)
    todo = total > 0
    while todo.any():
        keep = todo[owner]
        own, coordinate, rank = darts(element[keep], weight[keep], owner[keep], low, np.where(todo, high, 0.0), k)
        np.minimum.at(best, own * k + coordinate, rank)
        todo = todo & ~np.isfinite(best.reshape(sets, k)).all(1)
        low, high = high, high * 2
    return best.reshape(sets, k).view(np.uint64)


def sign_batch(texts: list[str], shingler: Shingler, k: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a batch, and the number of distinct shingles of each text."""
    parts, counts = [], []
    for text in texts:
        values, n = np.unique(shingler.shingles(text), return_counts=True)
        parts.append(values)
        counts.append(n)
    sizes = np.array([len(x) for x in parts], np.int64)
    if not sizes.sum():
        return np.full((len(texts), k), np.inf).view(np.uint64), sizes
    weight = np.concatenate(counts).astype(np.float64) if weighted else np.ones(int(sizes.sum()))
    return signatures(np.concatenate(parts), weight, np.repeat(np.arange(len(texts)), sizes), len(texts), k), sizes


def band_keys(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, keys): one 64-bit key for each band of the signature of (doc_id, text). One narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in in_slices(batches, 64):
            signed, sizes = sign_batch(part.column("text").to_pylist(), shingler, bands * rows, weighted)
            keys = np.zeros((part.num_rows, bands), U64)
            for r in range(rows):
                keys = mix((keys + signed[:, r::rows][:, :bands]) * GOLD + U64(r))
            keys = mix(keys + np.arange(1, bands + 1, dtype=U64) * GOLD).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), listed(keys.reshape(-1), np.full(len(keys), bands)), pa.array(sizes.astype(np.int32))], ["doc_id", "keys", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, keys array<bigint>, n int")


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """An Arrow column of lists of ``sizes`` from their values in a row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, s): the sorted distinct shingle hashes of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in in_slices(batches, 64):
            sets = [np.unique(shingler.shingles(t)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), listed(np.concatenate(sets), np.array([len(s) for s in sets]))], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, s array<bigint>")


def scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the pairs' shingle sets, exactly."""
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("jaccard"))


def early(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, n, root, token, p): the shared shingles of (a, n, root, s) that stand early enough for a link, p from 0.

    A set's shingles are in the order of their frequency; those that one component alone holds come first and can't be
    common to sets of two components, so only their number counts.
    """
    tokens = sets.select("a", "n", "root", F.explode("s").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rows = tokens.join(common.select("token", "c"), "token").groupBy("a", "n", "root").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    last = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9)
    rows = rows.withColumn("u", F.col("n") - F.size("t")).where(F.col("u") <= last)
    rows = rows.select("a", "n", "root", "u", F.posexplode(F.slice("t", F.lit(1), (last - F.col("u") + 1).cast("int"))).alias("i", "x"))
    return rows.select("a", "n", "root", F.col("x.token").alias("token"), (F.col("u") + F.col("i")).alias("p"))


def apart(postings: DataFrame, similarity: float) -> DataFrame:
    """(a, b, root): pairs of different components, b not the larger set, that may be as similar; root is that of b."""
    share = similarity / (1.0 + similarity)
    large = postings.select("token", "a", "n", F.col("root").alias("root_a"), "p")
    small = postings.where(F.col("p") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9))
    small = small.select("token", F.col("a").alias("b"), F.col("n").alias("n2"), F.col("root").alias("root"), F.col("p").alias("p2"))
    # as many shingles as a link needs can follow the first common one in either set
    need = F.ceil(share * (F.col("n") + F.col("n2")) - 1e-9)
    ordered = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("b") < F.col("a")))
    follows = (F.col("n") - F.col("p") >= need) & (F.col("n2") - F.col("p2") >= need)
    return large.join(small, "token").where((F.col("root") != F.col("root_a")) & ordered & follows).select("a", "b", "root").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, rep_id, class_id) for each distinct id: the copy that stands for it, and the smallest id of its class."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    keyed = source.where("text IS NOT NULL").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("norm"))
    digest = F.struct(F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(3), "norm").alias("h2"))
    digests = keyed.where("norm <> ''").groupBy("doc_id").agg(F.min(digest).alias("d")).select("doc_id", "d.h1", "d.h2")
    digests = written(digests, "digests")
    # written first, so that the join can split the rows of a text with very many copies
    reps = digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    copies = digests.join(written(reps, "copied"), ["h1", "h2"], "left").select("doc_id", F.coalesce("rep_id", "doc_id").alias("rep_id"))
    copies = written(copies, "copies")
    # signatures are made in the narrow pass over the texts; those of copies go before they are banded
    alone = copies.where("doc_id = rep_id").select("doc_id")
    signed = band_keys(source.where("text IS NOT NULL"), bands, rows, weighted).where("n > 0")
    signed = signed.join(alone, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("keys", "n")).alias("x"))
    signed = written(signed.select("doc_id", "x.keys", "x.n"), "bands")
    exploded = signed.select("doc_id", "n", F.explode("keys").alias("key"))
    centre = exploded.groupBy("key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "b")
    members = written(exploded.join(centre, "key").select("key", F.col("doc_id").alias("a"), "b", "n"), "members")
    # texts move only if they may be those of members
    ids = members.select(F.col("a").alias("doc_id"))
    texts = perhaps(source.where("text IS NOT NULL"), ids, "doc_id").where("__maybe").join(ids.distinct(), "doc_id", "left_semi")
    sets = written(shingle_sets(texts).groupBy("doc_id").agg(F.min("s").alias("s")), "shingles")

    def joined(found: DataFrame) -> DataFrame:
        return components(found.where(F.col("jaccard") >= similarity).select("a", "b"), "classes")

    def with_roots(rows: DataFrame, *names: str) -> DataFrame:
        for name in names:
            rows = rows.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")), name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
        return rows

    asked = members.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"), F.min("n").alias("n"))
    asked = asked.join(signed.select(F.col("doc_id").alias("b"), F.col("n").alias("n2")), "b")
    asked = written(asked.where(F.least("n", "n2") >= (similarity - 1e-9) * F.greatest("n", "n2")).select("a", "b", "votes"), "centres")
    first = asked.groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    stars = written(scored(first, sets), "stars")
    roots = joined(stars)
    # the other centres of what isn't joined to them
    others = with_roots(asked.join(stars, ["a", "b"], "left_anti"), "a", "b").where("root_a <> root_b").select("a", "b")
    links = written(stars.union(written(scored(written(others, "others"), sets), "stars")).where(F.col("jaccard") >= similarity), "links")
    roots = joined(links)
    # members of the buckets that still hold several components
    placed = with_roots(members.select("key", "a", "n"), "a")
    several = placed.groupBy("key").agg(F.min("root_a").alias("low"), F.max("root_a").alias("high")).where("low <> high").select("key")
    unsettled = with_roots(members.join(several, "key").select("a", "n").distinct(), "a").select("a", "n", F.col("root_a").alias("root"))
    unsettled = written(unsettled.join(sets.select(F.col("doc_id").alias("a"), "s"), "a"), "unsettled")
    pairs = written(apart(written(early(unsettled, similarity), "early"), similarity), "pairs")
    if not pairs.isEmpty():
        one = pairs.groupBy("a", "root").agg(F.min("b").alias("b")).select("a", "b")
        tried = written(scored(one, sets), "tried")
        roots = joined(links.union(tried))
        left = with_roots(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "a", "b").where("root_a <> root_b").select("a", "b")
        roots = joined(links.union(tried).union(scored(written(left, "left"), sets)))
    labelled = copies.join(roots.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    labelled = labelled.select("doc_id", "rep_id", F.coalesce("root", "rep_id").alias("class_id"))
    others = source.select("doc_id").join(copies, "doc_id", "left_anti").distinct()
    return labelled.union(others.select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id")))


def mark(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, rep_id, kept): a row for each distinct id, of which the smallest of a class is kept, and for each
    row without an id."""
    found = settled(docs.sparkSession, "near", lambda: classes(docs, **options))
    found = found.select("doc_id", "class_id", "rep_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    none = F.lit(None).cast("bigint")
    return found.union(docs.where("doc_id IS NULL").select(none, none, none, F.lit(True)))
