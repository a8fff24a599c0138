"""Filter interaction audit: which documents each order of five filters removes, step by step.

Filters (failure conditions; words are longest stretches of characters other than blank and U+0009 to U+000D): A under
200 words; B distinct words under half of the words; C over 2 % of the characters in A-Z; D any of # $ % & * |; E the text
is that of a row with a smaller doc_id, anywhere in the table, removed or not.

One pass over the texts makes a mask of A to D and a 64-bit xxhash of each text. Each task first drops what it holds
several times: its rows of one text meet in a chain (full texts under one fingerprint, with the smallest id), larger ids
are known to fail E and go on as small rows without their text, by their own id. So a text that a third of all rows share
moves once a task. The chains' texts go to the partition of their fingerprint, sorted by fingerprint and id; there the
first id of a text in its chain is the smallest, and later ones fail E. A chain holds the different texts of one
fingerprint, which a partition passes one after the other. Texts move and are compared whole, compressed without loss.

Rows (doc_id, part, mask) then meet their labels, and ``combineByKey`` merges one vector of counts a part (by mask; all,
good, toxic), from which all 120 orders follow.

Defined results: a null text is the empty text, a null source the part ''; rows that repeat a doc_id all count, and equal
ids don't make each other fail E; a null doc_id is neither smaller nor larger than another, so it never fails E and makes
no other row fail; a document is good, or toxic, if any of its labels says 1; null labels say nothing; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby, permutations

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
E_BIT = 1 << LETTERS.index("E")
LEAST_WORDS = 200
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Compressed bytes of text that a task gathers before it hands its chains on.
CHAIN_BYTES = 48 << 20
#: Bytes of text that a partition of the chains gets at most, about (compressed, a half or a third of it).
PARTITION_BYTES = 128 << 20

#: A row of the audit, as often as it stands there: doc_id, part, mask, count.
Row = tuple[int | None, str, int, int]


def mask_of(data: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()
    n = len(words)
    fails = (
        n < LEAST_WORDS,
        100 * len(set(words)) < 50 * n,
        100 * (len(data) - len(data.translate(None, CAPITALS))) > 2 * n_chars,
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def same_text(a: bytes, b: bytes) -> bool:
    """Whether two compressed texts are one text."""
    return a == b or zstandard.decompress(a) == zstandard.decompress(b)


def _lookup(chain: list[list], packed: bytes) -> list | None:
    """The link [text, smallest id, counts of the rows of that id by (part, mask)] of a text in its chain."""
    return next((link for link in chain if same_text(link[0], packed)), None)


def _routed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """((fingerprint, id), (text, counts)) for each text of a task and ((anywhere, -1), (None, row)) for rows settled here."""
    press = zstandard.ZstdCompressor(level=1)
    chains: dict[int, list[list]] = {}
    held = passed = 0

    def hand_on() -> Iterator[tuple]:
        for fp, chain in chains.items():
            for packed, least, counts in chain:
                yield (fp, least), (packed, counts)

    def settled(row: Row) -> tuple:
        return (xxhash.xxh64_intdigest(passed.to_bytes(8, "little")), -1), (None, row)

    for doc_id, text, part in rows:
        passed += 1
        data, part = (text or "").encode(), part or ""
        mask = mask_of(data, len(text or ""))
        if doc_id is None:
            yield settled((None, part, mask, 1))
            continue
        fp, packed = fingerprint(data), press.compress(data)
        chain = chains.setdefault(fp, [])
        link = _lookup(chain, packed)
        if link is None:
            chain.append([packed, doc_id, {(part, mask): 1}])
            held += len(packed)
            if held >= CHAIN_BYTES:
                yield from hand_on()
                chains.clear()
                held = 0
        elif doc_id > link[1]:
            yield settled((doc_id, part, mask | E_BIT, 1))
        elif doc_id == link[1]:
            link[2][part, mask] = link[2].get((part, mask), 0) + 1
        else:
            for (part_, mask_), n in link[2].items():
                yield settled((link[1], part_, mask_ | E_BIT, n))
            link[1:] = [doc_id, {(part, mask): 1}]
    yield from hand_on()


def _walked(records: Iterator[tuple]) -> Iterator[Row]:
    """Rows with their E bit, from records sorted by fingerprint and id."""
    for _, group in groupby(records, key=lambda r: r[0][0]):
        chain: list[list] = []
        for (_, doc_id), (packed, found) in group:
            if packed is None:
                yield found
                continue
            link = _lookup(chain, packed)
            if link is None:
                chain.append([packed, doc_id])
            bit = E_BIT if link is not None and doc_id > link[1] else 0
            yield from ((doc_id, part, mask | bit, n) for (part, mask), n in found.items())


def masks(docs: DataFrame) -> RDD:
    """(doc_id, part, mask, count) of the rows of ``docs`` (doc_id, text, source); rows that are equal may be counted in one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(size // PARTITION_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism)
    dealt = docs.select("doc_id", "text", "source").rdd.mapPartitions(_routed).repartitionAndSortWithinPartitions(n, lambda key: key[0], keyfunc=lambda key: key)
    return dealt.mapPartitions(_walked)


def non_minimum_ids(docs: DataFrame) -> DataFrame:
    """(doc_id) of the rows whose text a row with a smaller id has, one row each."""
    spark = docs.sparkSession
    found = masks(docs).filter(lambda r: bool(r[2] & E_BIT)).flatMap(lambda r: ((r[0],) for _ in range(r[3])))
    return spark.createDataFrame(found, docs.select("doc_id").schema, verifySchema=False)


def _counted(row) -> tuple[str, tuple[int, np.ndarray]]:
    part, mask, n, good, toxic = row
    return part, (3 * mask, n * np.array([1, bool(good), bool(toxic)], dtype=np.int64))


def _start(value: tuple[int, np.ndarray]) -> np.ndarray:
    return _add(np.zeros(3 << len(LETTERS), dtype=np.int64), value)


def _add(vector: np.ndarray, value: tuple[int, np.ndarray]) -> np.ndarray:
    at, counts = value
    vector[at : at + 3] += counts
    return vector


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def mask_counts(docs: DataFrame, labels: DataFrame) -> RDD:
    """(part, vector): for each mask the rows of the part, the good and the toxic ones."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, n bigint"
    rows = spark.createDataFrame(masks(docs), schema, verifySchema=False)
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(said, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    return joined.rdd.map(_counted).combineByKey(_start, _add, _merge)


@cache
def _steps() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, step) of every step of every order, the number of its filter, and which masks it keeps, removes here, and
    finds removed already."""
    labels, filters, kept, removed, redundant = [], [], [], [], []
    mask = np.arange(1 << len(LETTERS))
    for order in permutations(LETTERS):
        earlier = mask < 0
        for step, letter in enumerate(order, 1):
            fails = (mask >> LETTERS.index(letter) & 1) == 1
            labels.append(("".join(order), step))
            filters.append(LETTERS.index(letter))
            kept.append(~fails & ~earlier)
            removed.append(fails & ~earlier)
            redundant.append(fails & earlier)
            earlier = earlier | fails
    return labels, np.array(filters), *(np.array(m, dtype=np.int64) for m in (kept, removed, redundant))


def _report(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
    part, vector = item
    counts = vector.reshape(-1, 3)
    labels, filters, kept, removed, redundant = _steps()
    here = removed @ counts
    total = np.bincount(filters, weights=here[:, 0]).astype(np.int64)
    columns = (kept @ counts[:, 0], here[:, 0], redundant @ counts[:, 0], counts[1 << filters, 0], here[:, 1], here[:, 2], total[filters])
    for (order, step), *figures in zip(labels, *(c.tolist() for c in columns)):
        yield (part, order, step, *figures)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (what the step's filter removes, summed over all orders)."""
    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return docs.sparkSession.createDataFrame(mask_counts(docs, labels).flatMap(_report), schema, verifySchema=False)


ORACLE_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS bit,
  coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
