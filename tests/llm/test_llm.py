"""The corpus operators against brute force, round trips and libraries, and on odd rows: nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import ann, bpe, html, langid, lines, near_text, near_vectors, packing, pii, quality
from strandloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi ne su ta ri po".split() for b in "na de li mo ra tu".split()]


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "a" * 50_000), (6, "x\n\n\n\ny")]


# -- components --------------------------------------------------------------------------------------------------------

def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 130)} == {100}


# -- 1 -----------------------------------------------------------------------------------------------------------------

def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def classes_by_force(rows, limit=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def test_near_text_equals_brute_force(spark):
    rows = [(i, prose(i, 80)) for i in range(0, 40)]
    rows += [(100 + i, edited(rows[i % 5][1], i, [0.005, 0.015, 0.03, 0.08][i % 4])) for i in range(60)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, "too few words"), (301, "Too  few WORDS"), (302, "")]
    got = {r.doc_id: r.class_id for r in near_text.mark(docs_of(spark, rows)).collect()}
    assert got == classes_by_force(rows)


def test_near_text_copies_apart_from_each_other(spark):
    """Many copies of a text that is not there itself, some as near as a link and some not, with edits of their own."""
    base = prose(1, 120)
    rows = [(i, edited(base, 1000 + i, [0.01, 0.02, 0.03, 0.05][i % 4])) for i in range(240)] + [(500, base + " " + prose(2, 10)), (501, prose(3, 100) + " " + base)]
    got = {r.doc_id: r.class_id for r in near_text.mark(docs_of(spark, rows)).collect()}
    want = classes_by_force(rows)
    assert got == want and 20 < len(set(want.values())) < 230


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=7, unique_by=frozenset))
def test_early_shingles_lose_no_pair(spark, sets):
    rows = [(i, len(s), i, sorted(s)) for i, s in enumerate(sets)]
    found = near_text.apart(near_text.early(spark.createDataFrame(rows, "a long, n int, root long, s array<long>"), 0.8), 0.8)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert want <= {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()}


def test_near_text_odd_rows(spark):
    got = near_text.mark(docs_of(spark, ODD).withColumn("key", F.lit(1)).withColumn("rep_id", F.lit(2))).collect()
    assert sorted(r.doc_id for r in got if r.doc_id) == [1, 2, 3, 4, 5, 6] and all(r.kept for r in got)
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert near_text.mark(docs_of(spark, [])).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 5, 300).astype(float)
    v = np.where(rng.random(300) < 0.3, w + 2, w)
    s = near_text.signatures(np.r_[ids, ids], np.r_[w, v], np.repeat([0, 1], 300), 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


# -- 2 and 3 -----------------------------------------------------------------------------------------------------------

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0)).withColumn("v", F.lit("x")).withColumn("g", F.lit(1))


def cluster_rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    rows += [(1000 + i, (base[i % 4] + rng.normal(size=16) * 0.08).tolist(), (i % 4) % 3) for i in range(120)]
    rows += [(2000 + i, base[9].tolist(), 0) for i in range(25)] + [(2100, (base[9] * 3).tolist(), 0)]
    return rows


def test_near_vectors_equal_brute_force(spark):
    rows = cluster_rows()
    bad = [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [1.0, None] + [0.0] * 14, 1), (3004, [1.0] * 16, None), (3005, [], 1), (3006, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in near_vectors.mark(vectors_of(spark, rows + bad + [rows[0]])).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    assert {r[0]: int(n) for r, n in zip(rows, link.sum(1))} == {r[0]: got[r[0]].n_links for r in rows}
    root = {r[0]: r[0] for r in rows}
    for _ in range(20):
        for i, j in zip(*np.nonzero(link)):
            root[rows[i][0]] = min(root[rows[i][0]], root[rows[j][0]])
    assert root == {r[0]: got[r[0]].component_id for r in rows}
    assert all(got[b[0]].n_links == 0 and got[b[0]].kept for b in bad)
    assert near_vectors.mark(vectors_of(spark, [])).count() == 0


def two_tight_groups():
    """Two groups of 40 whose vectors link to all of both groups, and have all their nearest vectors in their own."""
    rng = np.random.default_rng(8)
    base, off = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    sides = (base, 0.95 * base + np.sqrt(1 - 0.95**2) * off)
    return [(i, (sides[i // 40] + rng.normal(size=32) * 0.008).tolist(), 1) for i in range(80)]


def test_near_vectors_links_beyond_saturated_lists(spark, monkeypatch):
    rows = two_tight_groups()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (x @ x.T >= 0.93).all() and all((np.argsort(-s)[:11] // 40 == i // 40).all() for i, s in enumerate(x @ x.T))
    monkeypatch.setattr(near_vectors, "audit", lambda *_: 1.0, raising=False)
    monkeypatch.setattr(near_vectors, "BUCKET", 40)
    monkeypatch.setattr(near_vectors, "WIDE", 30, raising=False)
    got = near_vectors.mark(vectors_of(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(79, 0)}


def test_near_vectors_pairs_that_no_list_holds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, (base * (i + 1)).tolist(), 1) for i, base in enumerate(rng.normal(size=(60, 32)))]
    rows += [(100 + i, (np.array(rows[i][1]) / (i + 1) + rng.normal(size=32) * 0.15).tolist(), 1) for i in range(6)]
    rows += [(200 + i, (np.array(rows[50][1]) / 51 + rng.normal(size=32) * 0.02).tolist(), 1) for i in range(40)]
    monkeypatch.setattr(near_vectors, "WIDE", 25, raising=False)
    monkeypatch.setattr(near_vectors, "AUDIT", 1, raising=False)
    met = near_vectors.descend

    def blind(*given):
        return met(*given).where("(id < 100 OR id >= 200) AND (nb < 100 OR nb >= 200)")

    monkeypatch.setattr(near_vectors, "descend", blind)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.mark(vectors_of(spark, rows)).collect()}
    assert [got[100 + i] for i in range(6)] == [(1, i) for i in range(6)]
    assert {got[i] for i in [50, *range(200, 240)]} == {(40, 50)} and got[20] == (0, 20)


def test_near_vectors_counts_of_large_components(spark, monkeypatch):
    """Components of many blocks, with members inside and outside half the threshold's angle of their mean, and copies."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(2, 16))
    rows = [(i, (base[i % 2] + rng.normal(size=16) * (0.1 if i < 90 else 0.26)).tolist(), 1) for i in range(160)]
    rows += [(500 + i, rows[i][1], 1) for i in range(0, 160, 3)]
    monkeypatch.setattr(near_vectors, "BLOCK", 9)
    monkeypatch.setattr(near_vectors, "GROUP", 20)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors.mark(vectors_of(spark, rows)).collect()}
    assert {r[0]: int(n) for r, n in zip(rows, want)} == got


def test_near_vectors_audit(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 24))
    x[200:] = x[:200] + np.random.default_rng(4).normal(size=(200, 24)) * 0.05
    nodes = spark.createDataFrame([(i, 1, v.tolist(), float(np.linalg.norm(v))) for i, v in enumerate(x)], "id long, g long, v array<double>, norm double")

    def roots(n):
        return spark.createDataFrame([(i + side, i) for i in range(n) for side in (0, 200)], "node long, root long")

    assert near_vectors.audit(nodes, roots(200), 0.93) == 1.0
    # one pair of 200 that no component holds is met, as all vectors are in the sample
    assert near_vectors.audit(nodes, roots(199), 0.93) == 0.0
    # without a link there is nothing to show unless all vectors were seen; few vectors show little
    alone = nodes.where("id < 200")
    assert near_vectors.audit(alone, roots(0), 0.93) == 1.0
    monkeypatch.setattr(near_vectors, "AUDIT", 5)
    assert near_vectors.audit(alone, roots(0), 0.93) == 0.0
    assert near_vectors.audit(nodes, roots(200), 0.93) < 0.5


def test_near_vectors_of_repeated_ids(spark):
    """An id with several vectors counts once, with one of them."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, a, 1), (3, b, 1), (4, [1.0, 0.1, 0.0], 1), (5, [0.1, 1.0, 0.0], 1), (None, a, 1), (6, a, 2)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.mark(vectors_of(spark, rows)).collect()]
    assert len(got) == len(rows) and got.count((None, 0, None, True)) == 1 and (6, 0, 6, True) in got and len({x for x in got if x[0] == 1}) == 1
    links = {x[0]: x[1] for x in got}
    assert sorted([links[2], links[3]]) == [1, 2] and links[1] == 2 and sorted([links[4], links[5]]) == [1, 2]


def test_ann_list_that_all_queries_probe(spark, monkeypatch):
    """One list of equal vectors, cut into blocks of rows and groups of queries; ties go to smaller ids."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "ASKED", 3)
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(200)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0], 1) for i in range(21)] + [(0, [1.0, 2.0, 3.0], 1)]
    got = collections.defaultdict(list)
    for r in ann.every(vectors_of(spark, rows), F.col("id") % 20 == 0, 20).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i in range(21) if i != q][:20] for q in range(0, 200, 20)} | {q: [1000 + i for i in range(21) if 1000 + i != q] for q in (1000, 1020)}


def test_ann_scans_without_the_test_where_it_misses(spark, monkeypatch):
    monkeypatch.setattr(ann, "EPSILON", -0.9)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.random.default_rng(2).normal(size=(300, 40)))]
    got = collections.defaultdict(set)
    for r in ann.every(vectors_of(spark, rows), F.col("id") % 20 == 0, 5).collect():
        got[r.query_id].add(r.vec_id)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s)[:5].tolist())


def test_ann_recall_and_order(spark):
    rows = cluster_rows() + [(4000, None, 1), (4020, [0.0] * 16, 1), (4040, [float("inf")] * 16, 1)]
    got = collections.defaultdict(list)
    for r in sorted(ann.every(vectors_of(spark, rows), F.col("id") % 20 == 0, 20).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    x = np.array([r[1] for r in rows[:-3]], np.float32).astype(float)
    ids = np.array([r[0] for r in rows[:-3]])
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [r.rank for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert np.allclose([r.score for r in found], [s[np.flatnonzero(ids == r.vec_id)[0]] for r in found])
        hits += len({r.vec_id for r in found} & set(ids[best].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.every(vectors_of(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.every(vectors_of(spark, [(20, [1.0], 1), (3, [2.0], 1)]), F.col("id") % 20 == 0).count() == 1


# -- 4 -----------------------------------------------------------------------------------------------------------------

def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", "@", "c.d", ".", "1", "22", "0255", "+", "-", " ", "4111 1111 1111 1111", "x@y.zz", "é", "10.0.0.1", "("]), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"w{i} report by zanzibar lives near ann.lee@mail.example.com and more text {prose(i, 30)}") for i in range(6)] + [(50 + i, f"{prose(50 + i, 40)} and more text near") for i in range(60)]
    found = {r.doc_id: r for r in pii.find(docs_of(spark, rows + ODD[:3]).withColumn("spans", F.lit(1)).withColumn("entity", F.lit(1))).collect()}
    text = rows[0][1]
    at = text.index("zanzibar")
    assert f"term:{at}:{at + 8}" in found[0].spans and found[0].n_email == 1 and found[0].base_sha256 == pii.digest(plain_spans(text))
    assert found[60].n_term == 0 and found[1].spans.startswith("email:")
    assert found[50].spans == "" and found[50].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, rows + ODD[:2])).collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[55] == dict(rows)[55]
    assert pii.find(docs_of(spark, [])).count() == 0


def test_pii_counts_terms_as_it_finds_them(spark, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0, raising=False)
    texts = ["abcⅫdef here", "ABCⅫdef, again abcⅫdef", "plain x²yz only", "İstanbul"]
    terms = {t for x in texts for t, _, _ in pii.outside_words(x, [])} if hasattr(pii, "outside_words") else {"abcⅻdef", "plain"}
    got = {r.term: r.docs_t for r in pii.term_counts(docs_of(spark, list(enumerate(texts))), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got["abcⅻdef"] == 2 and set(got) == terms


def test_pii_terms_of_one_text(spark):
    common = "and then the others also came to this place with more of the same things as before"
    rows = [(i, f"{common} {common}") for i in range(100)]
    rows += [(200, f"Quillandra wrote. {common} {common} Mail: bo.li@one.example.com"), (201, f"{common} call +44 20 7946 0958 or ask vexborough"), (202, "Ask wilhelmina about this")]
    texts = dict(rows)
    found = {r.doc_id: r for r in pii.find(docs_of(spark, rows)).collect()}
    assert "term:0:10" in found[200].spans and found[201].n_term >= 1 and found[202].n_term == found[5].n_term == 0
    at = texts[200].index("others")
    assert f"term:{at}:" not in found[200].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, rows)).collect()}
    assert "Quillandra" not in clean[200] and "others" in clean[200] and "vexborough" not in clean[201] and clean[202] == texts[202]


# -- 5 -----------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    ranks = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Encoder(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "'s", "é", "\u0085", "\x1c", "　", "1", "!!", "aaaa", "the "]), max_size=12).map("".join))
def test_encoding_equals_the_library(tokenizer, text):
    own, reference = tokenizer
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.decode(own.packed(text), own.tokens) == text.encode()


def test_very_long_pre_token(tokenizer):
    own, reference = tokenizer
    assert own.encode("abca" * 3000) == reference.encode_ordinary("abca" * 3000)


def test_bpe_query_digests(spark, tokenizer):
    got = bpe.encode_documents(docs_of(spark, ODD), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    for r, (_, text) in zip(sorted(got.where("doc_id IS NOT NULL").collect(), key=lambda r: r.doc_id), [x for x in ODD if x[0]], strict=True):
        ids = tokenizer[1].encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


# -- 6 -----------------------------------------------------------------------------------------------------------------

def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(0)
    emit, move, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(start[y[0]] + sum(emit[0, t, y[t]] for t in range(4)) + sum(move[y[t], y[t + 1]] for t in range(3)))
        for t in range(4):
            want[t, y[t]] += w
    want /= want.sum(1, keepdims=True)
    there = np.ones((1, 4), bool)
    assert np.allclose(langid.posteriors(emit, move, start, there)[0], want) and np.allclose(langid.forward_backward(emit, move, start, there)[0][0], want)


def test_chains_of_any_length_equal_one_chain():
    """Texts in step, and a long text in segments, against forward-backward over each whole text alone."""
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32) * 0.2, rng.normal(size=(3, 3)), rng.normal(size=3))
    texts = [prose(i, n).translate({ord(c): None for c in "0123456789"}) for i, n in enumerate([1, 7, 300, 2, 61, 0, 180])]

    def alone(text):
        words = text.split()
        return langid.forward_backward(model.emissions(words)[None], model.move, model.start, np.ones((1, len(words)), bool))[0][0]

    for segment in (10**6, 64, 5):
        labeller = langid.Labeller(model, segment=segment)
        names, scores = labeller.label(texts)
        for text, name, score in zip(texts, names, scores):
            if text:
                want = alone(text)
                assert np.allclose(labeller.words(text.split()), want, atol=1e-5)
                assert abs(score - want.mean(0).max()) < 1e-5 and name == "abc"[want.mean(0).argmax()]
            else:
                assert (name, score) == ("und", 0.0)


def test_language_query_learns_from_its_fold_alone(spark, tmp_path):
    """The registered query: held-out rows teach nothing, and every language of the others can be predicted."""
    from strandloom.llm import queries

    def text(lang, i):
        return " ".join(w[::-1] + f"{'xyz'[lang % 3]}{chr(97 + lang // 3)}" if lang else w for w in re.sub(r"\d", "", prose(i, 40)).split())

    held = {i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, text(i % 9, i), f"l{i % 9}", "s", 0) for i in range(400)]
    rows += [(i, text(0, i), "wrong", "s", 0) for i in sorted(held) if i >= 400] + [(None, text(1, 7), None, "s", 0), (5000, None, None, "s", 0)]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id in held) for r in got if r.doc_id is not None and r.doc_id < 2000)
    first = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.lang_pred == f"l{r.doc_id % 9}" for r in first if r.held_out]) > 0.95
    assert "wrong" not in {r.lang_pred for r in got} and {r.lang_pred for r in got if r.doc_id == 5000} == {"und"}


def test_language_odd_tables(spark):
    docs = docs_of(spark, ODD + [(9, "kana lode " * 30_000)]).withColumn("__text", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.label_documents(docs, model).collect()}
    assert got[9].lang_pred == "xx" and abs(got[9].score - 1) < 1e-9 and got[3].lang_pred == "und"
    assert langid.label_documents(docs_of(spark, []), model).count() == 0
    even = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros((2, 2)), np.zeros(2))
    assert langid.Labeller(even).label(["some words"]) == (["a"], [0.5])


def test_language_of_mixed_text(spark):
    one, two = [w for w in WORDS if w[0] in "klmn"], [w[::-1] + "q" for w in WORDS if w[0] in "strp"]
    clean = lambda words, seed: re.sub(r"\d", "", prose(seed, 60, words))
    rows = [(i, clean(one if i % 2 else two, i), "one" if i % 2 else "two", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "one", "s", 0), (2, "12 ½ !", None, "s", 0), (3, clean(one, 99), None, "s", 0), (3, clean(one, 99), None, "s", 0)], DOCS)
    got = langid.label_documents(docs.union(odd), model).collect()
    assert [r.lang_pred for r in got[:40]] == [r[2] for r in rows] and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got[40:]] == ["und", "und", "one", "one"]
    labeller = langid.Labeller(model)
    mixed = clean(one, 5).split()[:20] + clean(two, 6).split()[:20]
    label = labeller.words(mixed).argmax(1)
    assert (label[:18] == 0).all() and (label[22:] == 1).all()
    assert langid.label_documents(docs, langid.fit(docs.where("false"))).first().lang_pred == "und"


# -- 7 -----------------------------------------------------------------------------------------------------------------

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))


def test_html_article(spark):
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav>Menu one</nav><div class='ad'>Buy</div><article><h1>Head &amp;amp; tail</h1><p>a  b\n<b>c</b><br>d<p>e</article><div id=comments>first!</div><footer>F</footer></body></html>"
    got = {r.page_id: r for r in html.extract(pages_of(spark, [(1, "http://a/x", page), (2, None, None), (3, "http://a/y", ""), (1, "http://a/x", page)])).collect()}
    assert got[1].text == "Head &amp; tail\na b c d\ne" and got[1].n_chars == len(got[1].text) and got[2].text == "" and got[3].n_chars == 0
    assert html.extract(pages_of(spark, [])).count() == 0


def test_html_host_boilerplate_across_shards(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD_CHARS", 3500)
    body = lambda i: f"<body><div>Home News Sport Weather Travel Contact Us</div><div>Story {i} alpha{i} beta{i} gamma{i} delta{i} eps{i}</div><div>All rights reserved by the same old firm</div></body>"
    got = html.extract(pages_of(spark, [(i, f"http://h/{i}", body(i)) for i in range(12)] + [(99, "http://other/1", body(99))]))
    for r in got.collect():
        story = f"Story {r.page_id} alpha{r.page_id} beta{r.page_id} gamma{r.page_id} delta{r.page_id} eps{r.page_id}"
        assert r.text == story if r.page_id < 99 else story in r.text and "Home" in r.text


def blocks_of(page, kind=html.KEEP):
    return [t for k, t in html.page_blocks(page) if k == kind]


def test_html_attributes_and_marks_inside_the_article():
    assert blocks_of("<article><p>One <a title=it's href=x>two</a> three</p><p>four's five</p></article>") == ["One two three", "four's five"]
    assert blocks_of("<article><p class='search-tips'>a</p><div class=article-header><p>b</p></div><div class='ad-slot x'>c</div><p id=comments>d</p></article>") == ["a", "b"]
    assert blocks_of("<article><p title='a>b' data-class=ad>x</p><p class = \"q ad\">y</p></article>") == ["x"]
    assert blocks_of("<article>a < b &lt;c&gt; <!-- > <p>no</p> --><!--> d</ x>e<script>'</p>'</script ><p/>f<![CDATA[g]]></article>") == ["a < b <c> de", "f"]
    assert blocks_of("<article><p title=\"never closed href=x>kept</p><p>too</p></article>") == ["kept", "too"]


@pytest.mark.parametrize("part", ['<b c="', "<b c='", "<b c=", "<a b=\"x", "<!--", "</", "<p class=ad ", "<script>", "= '\" <x "])
def test_html_is_linear_in_malformed_pages(part):
    began = time.process_time()
    html.page_blocks("<article>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", "word", " ", "a&amp;b", "<br>", "<img alt='>'>", "<i title=\"<p>\">", "</i>", "<!-- <p> -->"]), max_size=14))
def test_html_text_is_what_stands_outside_tags(parts):
    """Against the standard library's parser: the same characters, whatever the markup."""
    import html.parser

    class Plain(html.parser.HTMLParser):
        def handle_data(self, data):
            seen.append(data)

        def handle_starttag(self, tag, attrs):
            seen.append(" " if tag == "br" else "")

    seen = []
    parser = Plain(convert_charrefs=True)
    parser.feed("<article>" + "".join(parts) + "</article>")
    parser.close()
    found = blocks_of("<article>" + "".join(parts) + "</article>")
    assert re.sub(r"\s", "", "".join(found)) == re.sub(r"\s", "", "".join(seen)) and all(t == " ".join(t.split()) != "" for t in found)


def test_html_runs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD_CHARS", 2500)
    rng = random.Random(5)
    pool = [prose(900 + i, 9) for i in range(5)]
    rows = []
    for i in range(40):
        blocks = [prose(i, 8), *rng.sample(pool, 2), prose(2000 + i % 20, 7)]
        rows.append((i, f"http://h{i % 3}/{i}", "".join(f"<div>{b}</div>" for b in blocks)))
    rows += [rows[0], rows[0]]
    streams = [[b.split() for b in blocks_of(r[2], html.OPEN)] for r in rows]
    have = collections.defaultdict(set)
    for r, blocks in zip(rows, streams):
        for b in blocks:
            for i in range(len(b) - html.RUN + 1):
                # rows that say the same are one page
                have[r[1].split("/")[2], tuple(b[i : i + html.RUN])].add(tuple(map(tuple, blocks)))
    want = collections.Counter()
    for r, blocks in zip(rows, streams):
        kept = []
        for b in blocks:
            gone = {j for i in range(len(b) - html.RUN + 1) if len(have[r[1].split("/")[2], tuple(b[i : i + html.RUN])]) >= html.PAGES for j in range(i, i + html.RUN)}
            if left := [w for j, w in enumerate(b) if j not in gone]:
                kept.append(" ".join(left))
        want[r[0], "\n".join(kept)] += 1
    assert collections.Counter((r.page_id, r.text) for r in html.extract(pages_of(spark, rows)).collect()) == want


def test_suffix_array_order():
    tokens = np.random.default_rng(0).integers(0, 3, 60)
    order = html.suffix_array(tokens)
    keys = [tuple(tokens[i : i + html.RUN]) for i in order]
    assert keys == sorted(keys)


# -- 8 -----------------------------------------------------------------------------------------------------------------

def test_packing_covers_every_id_once(spark):
    rows = [(i, prose(i, n)) for i, n in enumerate([0, 1, 5, 50, 300, 2000, 9000, 40, 41, 42] * 3)] + ODD[:2] + [(77, "İSTANBUL Σς <|endoftext|> \u0085 K 1²"), (78, "a" * 20_000)]
    docs = docs_of(spark, rows).withColumn("start", F.lit(1))
    path = public.path("word_bpe_49k.json")
    again = packing.tokenize_and_pack(docs.where("doc_id = 4"), path).toPandas()
    assert again.length.sum() == 2 * again.doc_tokens.iloc[0] * docs.where("doc_id = 4").count() / 2  # rows that repeat are packed each
    pieces = packing.tokenize_and_pack(docs.dropDuplicates(["doc_id"]), path).toPandas()
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(path)
    seen = {r.doc_id: r.text or "" for r in docs.dropDuplicates(["doc_id"]).collect()}
    assert set(pieces.doc_id) == set(seen)
    for doc, part in pieces.groupby("doc_id"):
        ids, at = [*reference.encode(seen[doc], add_special_tokens=False).ids, 2], 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        size = int(part.length.sum())
        assert size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
    assert padding <= 4096 * docs.rdd.getNumPartitions()
    assert packing.tokenize_and_pack(docs_of(spark, []), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_packer_leaves_nothing(sizes):
    packer = packing.Packer()
    for i, n in enumerate(sizes):
        packer.add(i, n)
    packer.pack(last=False)
    packer.pack(last=True)
    total = collections.Counter()
    for number, _, length, *_ in packer.out:
        total[number] += length
    assert total == {i: n for i, n in enumerate(sizes)} and not any(packer.waiting)
    steps = collections.defaultdict(set)
    for *_, sequence, _, tier, step in packer.out:
        steps[tier].add((step, sequence))
    assert all([step for step, _ in sorted(found)] == list(range(len(found))) for found in steps.values())


# -- 9 -----------------------------------------------------------------------------------------------------------------

def lines_by_force(rows):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        ls = text.split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            key = tuple(ls[p : p + 3])
            if key in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(key)
        out[i] = "\n".join(x for p, x in enumerate(ls) if p not in gone)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=8))
def test_line_dedup_equals_brute_force(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, rows)).collect()} == lines_by_force(rows)


def test_line_dedup_odd_rows(spark):
    docs = docs_of(spark, ODD).withColumn("th", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("starts", F.lit(3))
    got = lines.cleaned(docs)
    assert got.count() == len(ODD) and set(docs.columns) < set(got.columns)
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------------------------

def test_quality_separates_and_stays_calibrated(spark):
    rows = [(i, prose(i, 60) if i % 3 else prose(i, 40).upper().replace(" ", "!! ")) for i in range(240)]
    docs = docs_of(spark, rows + ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(180)] + [(500, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs.select("doc_id", "text"), model).collect()
    new = [r for r in got if r.doc_id is not None and 180 <= r.doc_id < 240]
    assert all(r.predicted == int(bool(r.doc_id % 3)) for r in new) and all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(ODD)
    assert quality.accepted(docs, model).columns == docs.columns
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score(docs_of(spark, []), model).count() == 0


def test_quality_query_learns_from_its_fold_alone(spark, tmp_path):
    from strandloom.llm import queries

    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 40).upper().replace(" ", "!! ")) for i in range(600)] + [(7, "z" * 900)] * 50 + ODD
    docs_of(spark, rows).withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    # the labels of the held-out fold are turned round: whoever learned from them would do badly
    spark.createDataFrame([(i, (i % 2) ^ (i in held), 0) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    mine = [r for r in got if r.doc_id is not None and 10 <= r.doc_id < 600]
    assert all(r.held_out == (r.doc_id in held) for r in mine) and np.mean([r.predicted == r.doc_id % 2 for r in mine]) > 0.97


# -- pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [(i, "\n".join(prose(10 * i + j, 25) for j in range(4))) for i in range(30)]
    rows = base + [(100 + i, base[i][1]) for i in range(5)] + [(200 + i, edited(base[10 + i][1].replace("\n", " "), i, 0.01)) for i in range(3)]
    rows += [(300 + i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(20)] + [(400, base[20][1].split("\n")[0] + " joe.doe@mail.example.com " + prose(9, 30))]
    docs_of(spark, rows + ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(300 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    assert not any(i in kept["quality"] for i in range(300, 320)) and all(i in kept["pii"] for i in range(30))
    assert not any(i in kept["line_dedup"] for i in range(100, 105))
    want = classes_by_force(list(kept["line_dedup"].items()))
    assert set(kept["near_dedup"]) == {i for i, c in want.items() if i == c}
    assert "joe.doe" not in kept["pii"].get(400, "") and "[EMAIL]" in kept["pii"].get(400, "[EMAIL]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("doc_id").length.sum().sub(packed.groupby("doc_id").doc_tokens.first()).eq(0).all()


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Each stage alone: null and empty texts, repeated ids and rows, clashing columns, and an empty table."""
    import corpus_pipeline

    rows = ODD + [(10 + i, "\n".join(prose(10 * i + j, 20) for j in range(4))) for i in range(6)] + [(30, None), (30, "  "), (31, prose(5, 30)), (31, prose(6, 30)), (31, None)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(10, 16)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ("a", "b", "key", "root", "th", "pos", "h1", "hits", "score", "keys", "m", "entity", "row", "count")
    docs = docs_of(spark, rows).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names))).repartition(3)
    ids = lambda frame: collections.Counter(r.doc_id for r in frame.collect())
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns and set(ids(out)) <= set(ids(docs))
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        if name in ("line_dedup", "pii"):
            assert ids(out)[30] == 2 and ids(out)[31] == 3
        if name == "near_dedup":
            again = {(r.doc_id, r.text) for r in out.where("doc_id IN (30, 31)").collect()}
            assert ids(out)[30] == ids(out)[31] == 1 and ids(out)[None] == ids(docs)[None]
            assert again == {(r.doc_id, r.text) for r in stage(spark, docs.repartition(7, "n_chars"), "").where("doc_id IN (30, 31)").collect()} and (30, "  ") in again
        if name == "packing":
            assert set(ids(out)) == set(ids(docs))
