"""Personal data: patterns for the base kinds, and terms that the corpus shows to disclose them.

Base spans come from the four patterns, leftmost and without overlap for each kind, in one pass that is linear in the
text. Each base value is a protected entity, however rare. The terms of all texts that hold it are counted over the
corpus: with N documents, a term t discloses the share

    log2(N / docs(e) * (joint(e, t) + docs(e) / N) / (docs(t) + 1))  /  log2(N / docs(e))

of an entity e's information: P(e | t), smoothed by one document in which e has its corpus share. From DISCLOSURE on the
term is generalised wherever it stands in a text with e, to the class that its shape shows; from REMOVAL on, which a few
documents alone don't reach unless the corpus is very large, it is removed. One text alone says of any rare word that it
goes with the entity, so there only the words count that begin with a capital or stand within NEAR words of a protected
value; other words count where two different texts or more hold both. Entities that only one text holds have the same counts with each of its
terms, so they count as one.

Defined results: null and empty texts have no spans and stay as they are; texts of any length are scanned whole; equal
rows get equal spans; documents of one id but other text are told apart by the text's hash; an empty table gives an
empty result; extra columns of the input are neither read nor carried by ``find``, and ``sanitise`` keeps them as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, written

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
REMOVAL = 0.95
#: Words on either side of a protected value that one text alone may show to disclose it, whatever their shape.
NEAR = 8
#: Terms whose counts a task holds before it passes them on.
HELD_TERMS = 200_000
#: Bits of the filter of the terms that are counted (8 MB).
FILTER_BITS = 1 << 26
#: Bytes of a part of the filter, and tasks that merge the parts.
FILTER_PART, FILTER_TASKS = 1 << 16, 8

# A run of local-part characters is taken whole, with the rest of the address if it follows: a match can begin nowhere
# else but at the run's start, since all later starts of the run meet the same rest. The same holds for runs of digits.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# an email's "@" and the letter after it; seven characters of the others, the first a digit: the least an address has
MAYBE = r"@[A-Za-z0-9-]|[0-9][0-9 ().-]{6}"
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        if "." in text:
            # the parts are compared by length first: a very long run of digits is no number below 256
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if m[1] and all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """The key of a protected value: its kind and its characters, without case and separators."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(filter(str.isdigit, value))}"


def outside_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside all base spans."""
    taken = sorted((s, e) for _, s, e in spans)
    out, k, upto = [], 0, 0
    for m in WORD.finditer(text):
        s, e = m.span()
        # spans of different kinds may overlap: upto is the furthest end of those that start before the word's end
        while k < len(taken) and taken[k][0] < e:
            upto = max(upto, taken[k][1])
            k += 1
        if upto <= s:
            out.append((m[0].lower(), s, e))
    return out


def telling(text: str, words: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each word begins with a capital or stands within NEAR words of a base span."""
    starts = [s for _, s, _ in words]
    near = [0] * (len(words) + 1)
    for _, s, _ in spans:
        at = bisect_left(starts, s)
        near[max(at - NEAR, 0)] += 1
        near[min(at + NEAR, len(words))] -= 1
    return [n > 0 or text[s].isupper() for s, n in zip(starts, accumulate(near))]


def span_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCAN = "doc_id bigint, th bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, entities array<string>, words array<struct<term:string,s:int,e:int,tells:boolean>>"
SCANNED = {
    **dict.fromkeys(("n_email", "n_ip", "n_card", "n_phone"), pa.int64()), "base": pa.string(), "entities": pa.list_(pa.string()),
    "words": pa.list_(pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("tells", pa.bool_())])),
}


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of each row, its entities and, if it has any, its words. One narrow pass; texts aren't carried on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                found = Counter(k for k, _, _ in spans)
                words = outside_words(text, spans) if spans else []
                words = [{"term": w, "s": s, "e": e, "tells": tells} for (w, s, e), tells in zip(words, telling(text, words, spans) if words else ())]
                rows.append((*(found[k] for k in KINDS[:4]), span_text(spans), sorted({entity(k, text[s:e]) for k, s, e in spans}), words))
            more = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), SCANNED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *more], names=["doc_id", "th", *SCANNED])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, SCAN)


def filter_bits(terms: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) % FILTER_BITS for t in terms), np.int64)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each of FILTER_BITS hashes, set where a term has it: of one size whatever the terms.

    A task's bits go on as the parts in which it has any, and a part's rows are merged in one task. The steps are a data frame's, as
    Spark keeps workers of their own, beside those of the data frames, for an RDD's Python steps.
    """
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = filter_bits(batch.column("term").to_pylist())
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield from passed(bits)

    def passed(bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, of in enumerate(bits.reshape(-1, FILTER_PART)):
            if of.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([of.tobytes()], pa.binary())], names=["part", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8).reshape(-1, FILTER_PART)
        for batch in batches:
            for part, of in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                bits[part] |= np.frombuffer(of, np.uint8)
        yield from passed(bits)

    bits = np.zeros((FILTER_BITS // 8 // FILTER_PART, FILTER_PART), np.uint8)
    parts = terms.select("term").mapInArrow(marks, "part int, bits binary").repartition(FILTER_TASKS, "part")
    # each part is whole in one task after the exchange, so a row a part comes back: the filter's size at most
    for row in parts.mapInArrow(merged, "part int, bits binary").collect():
        bits[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs_t): how many rows of ``docs`` hold each of ``terms`` (distinct) anywhere.

    A task passes on only what the filter of the terms lets through; with more terms than the filter can tell apart it lets
    all through, and the join decides as ever.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            at = filter_bits(found)
            let = (wanted.value[at >> 3] >> (at & 7)) & 1
            items = [item for item, x in zip(found.items(), let.tolist()) if x]
            for i in range(0, len(items), 10_000):
                terms, ns = zip(*items[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ns, pa.int64())], names=["term", "n"])
            found.clear()

        for part in in_slices(batches):
            for text in part.column("text").to_pylist():
                if text:
                    found.update({w.lower() for w in set(WORD.findall(text))})
                if len(found) > HELD_TERMS:
                    yield from counted()
        yield from counted()

    each = docs.select("text").mapInArrow(run, "term string, n bigint")
    # added up before they meet the terms: a term's rows become one where they are made, and once more where they meet
    return each.groupBy("term").agg(F.sum("n").cast("bigint").alias("docs_t")).join(terms.hint("merge"), "term", "left_semi")


def disclosures(docs: DataFrame, scanned: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """(th, hits): for each text with entities the terms (term, share) that disclose ``threshold`` of one or more."""
    n = float(scanned.count())
    # the terms that a text alone may show to disclose, and its others
    term = lambda words: F.transform(words, lambda x: x["term"])
    tells = F.array_distinct(term(F.filter("words", lambda x: x["tells"])))
    texts = scanned.where(F.size("entities") > 0).select("th", "entities", tells.alias("tells"), F.array_except(term("words"), tells).alias("others"))
    texts = written(texts.groupBy("th").agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in ("entities", "tells", "others"))), "texts")
    marked = F.concat(*(F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(c == "tells").alias("tells"))) for c in ("tells", "others")))
    each = texts.select("th", "m", F.explode("entities").alias("entity"))
    known = written(each.groupBy("entity").agg(F.sum("m").alias("docs_e"), F.count(F.lit(1)).alias("texts_e")), "entities")
    share = F.log2(n / F.col("docs_e") * (F.col("joint") + F.col("docs_e") / n) / (F.col("docs_t") + 1)) / F.log2(n / F.col("docs_e"))

    alone = each.join(known.where("texts_e = 1"), "entity").select("th").distinct()
    alone = texts.join(alone, "th").select("th", F.col("m").alias("docs_e"), F.col("m").alias("joint"), F.explode("tells").alias("term"))
    shared = each.join(known.where("texts_e > 1"), "entity").select("th", "entity", "docs_e")
    shared = texts.join(shared, "th").select("th", "m", "entity", "docs_e", F.explode(marked).alias("x")).select("th", "m", "entity", "docs_e", "x.term", "x.tells")
    pairs = shared.groupBy("entity", "docs_e", "term").agg(F.sum("m").alias("joint"), F.count(F.lit(1)).alias("both"), F.max("tells").alias("told"))
    pairs = written(pairs.where("both > 1 OR told"), "pairs")
    # only terms that may disclose are counted over the corpus: the texts with entities hold a term at least so often, and
    # the share falls with that number, so where it is too small already no count can bring it back
    held = texts.select("m", F.explode(F.concat("tells", "others")).alias("term")).groupBy("term").agg(F.sum("m").alias("docs_t"))
    asked = alone.select("term", "docs_e", "joint").union(pairs.select("term", "docs_e", "joint")).distinct().where(F.col("docs_e") < n)
    terms = asked.join(held.hint("merge"), "term").where(share >= threshold).select("term").distinct()
    counts = written(term_counts(docs, written(terms, "terms")), "counts")

    def disclosing(joint: DataFrame) -> DataFrame:
        return joint.where(F.col("docs_e") < n).join(counts, "term").withColumn("share", share).where(F.col("share") >= threshold)

    pairs = disclosing(pairs).select("entity", "term", "share")
    found = disclosing(alone).select("th", "term", "share").union(shared.join(pairs, ["entity", "term"]).select("th", "term", "share"))
    best = found.groupBy("th", "term").agg(F.max("share").alias("share"))
    return written(best.groupBy("th").agg(F.collect_list(F.struct("term", "share")).alias("hits")), "disclosures")


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint"


def find(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): base counts, base_sha256, all spans and the number of disclosing terms."""
    scanned = written(scan(docs), "scan")
    hits = disclosures(docs, scanned)
    columns = ("doc_id", *(f"n_{k}" for k in KINDS[:4]), "base")
    import pandas as pd  # here, as the pipeline's workers read this module and need none of it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, words, found in zip(batch["base"], batch.pop("words"), batch.pop("hits"), strict=True):
                known = {x["term"] for x in found} if found is not None else ()
                terms = [("term", x["s"], x["e"]) for x in words if x["term"] in known] if known else []
                rows.append((hashlib.sha256(base.encode()).hexdigest(), ",".join(filter(None, (base, span_text(terms)))), len(terms)))
            yield pd.concat([batch.drop(columns="base"), pd.DataFrame(rows, columns=["base_sha256", "spans", "n_term"], index=batch.index)], axis=1)

    # rows without entities need no join, so copies of their texts don't meet in a task
    rest = scanned.where(F.size("entities") > 0).join(hits.hint("merge"), "th", "left").select(*columns, "words", "hits").mapInPandas(run, FOUND)
    plain = scanned.where(F.size("entities") == 0).select(
        *columns[:-1], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_term")
    )
    return plain.union(rest)


def term_class(word: str) -> str:
    """What a term is generalised to, by its shape."""
    return "CODE" if word.isupper() else "NAME" if word[:1].isupper() else "WORD"


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each (kind, start, end, removed) as its kind in brackets, or gone; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e, removed in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], "" if removed else f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` generalised, disclosing terms generalised or removed; all columns stay."""
    hits = disclosures(docs, written(scan(docs), "scan")).select(F.col("th").alias("__th"), F.col("hits").alias("__hits"))
    # a text without the least that every pattern asks for holds no protected value: it meets nothing and doesn't move, and
    # null texts don't meet under one key
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    source = docs.where(maybe).join(hits.hint("merge"), F.xxhash64("text") == F.col("__th"), "left").select(*docs.columns, "__hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            out = []
            for text, found in zip(part.column("text").to_pylist(), part.column("__hits").to_pylist(), strict=True):
                spans = base_spans(text)
                if spans:
                    known = {x["term"]: x["share"] for x in found} if found is not None else {}
                    terms = [(term_class(text[a:b]), a, b, known[t] >= REMOVAL) for t, a, b in outside_words(text, spans) if t in known] if known else []
                    text = masked(text, [(k, s, e, False) for k, s, e in spans] + terms)
                out.append(text)
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type)).drop_columns("__hits")

    return source.mapInArrow(run, docs.schema).union(docs.where(~maybe))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()
