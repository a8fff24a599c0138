"""Filter audit, chat formatting and periodic runs, each against a plain version."""

import array
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import duckdb
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import audit, chat, html, langid, packing, periodic, pii, quality, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# -- periodic runs -----------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p) and i > s:
                out[s, i + p] = min(p, out.get((s, i + p), p))
            i += 1
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=120), max_size=4), st.integers(1, 9))
def test_runs_equal_plain_search(documents, p):
    documents = [*documents, *([d[i % min(p, len(d))] for i in range(len(d))] for d in documents)]
    assert periodic.search(documents) == [plain_runs(d) for d in documents]


def test_runs_of_long_texts():
    same = [b"a"] * 300_000
    assert periodic.search([same]) == [[(0, 300_000, 1)]]
    rng = random.Random(4)
    unit = [b"%d" % rng.randrange(50_000) for _ in range(30_000)]
    assert periodic.search([[b"x", *unit * 5, b"y"]]) == [[(1, 150_001, 30_000)]]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_row(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or "")) if doc_id is not None else (text or "").split()
    found = plain_runs(words)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    figures = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def as_table(tmp_path, df, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def key(row):
    return tuple((v is not None, v) for v in row)


def test_op13_equals_plain_version(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))), None, None, 0) for i in range(150)]
    rows += [(200, None, "x", "y", 1), (201, "", None, None, 0), (202, "a\x1ca\u2003b " * 9, None, None, 0), (None, "k k k k k k k", None, None, 0), (3, rows[3][1], None, None, 0), (3, rows[3][1], None, None, 0)]
    rows += [(300 + i, "z\t\n" * 5000 + "q", None, None, 0) for i in range(3)]
    sf = as_table(tmp_path, spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c")), "documents")
    got = sorted((tuple(r) for r in queries.op13_runs(spark, sf).collect()), key=key)
    assert got == sorted((run_row(r[0], r[1]) for r in rows), key=key)


def test_op13_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_runs(spark, sf).select("doc_id", "n_runs").collect())
    assert [g[0] for g in got] == sorted(r.doc_id for r in docs)
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 6000}
    assert {i: n for i, n in got if i in short} == {i: run_row(i, t)[1] for i, t in short.items()}


def test_op13_of_an_empty_table(spark, tmp_path):
    assert queries.op13_runs(spark, as_table(tmp_path, spark.createDataFrame([], DOCS), "documents")).collect() == []


# -- filter audit ------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [d for d, t, _ in docs if (t or "") == text and d is not None]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(c < doc_id for c in copies),
        }
        good, toxic = (any(d == doc_id and d is not None and v == 1 for d, *ls in labels for v in [ls[k]]) for k in (0, 1))
        rows.append((source or "", fails, good, toxic))
    out, shapley = [], {}
    for part, order in itertools.product({r[0] for r in rows}, map("".join, itertools.permutations("ABCDE"))):
        left = [r for r in rows if r[0] == part]
        every = left
        for step, f in enumerate(order, 1):
            here = [r for r in left if r[1][f]]
            left = [r for r in left if not r[1][f]]
            shapley[part, f] = shapley.get((part, f), 0) + len(here)
            fails = sum(r[1][f] for r in every)
            only = sum(r[1][f] and sum(r[1].values()) == 1 for r in every)
            out.append((part, order, step, len(left), len(here), fails - len(here) - sum(r[1][f] for r in left), only, sum(r[2] for r in here), sum(r[3] for r in here)))
    return sorted((*o, shapley[o[0], o[1][o[2] - 1]]) for o in out)


AUDIT_ROWS = [
    (1, "a b c", "s"), (2, "a b c", "s"), (0, "a b c", "t"), (2, "a b c", "s"), (0, "a b c", "s"), (3, None, None), (4, "", "s"), (5, "", ""), (None, "a b c", "s"), (None, "", None),
    (6, " ".join(map(str, range(250))), "s"), (7, " ".join(map(str, range(250))), "t"), (8, "w " * 300, "t"), (9, "AB " * 210 + "#", "t"), (10, "\u00c9 " + " ".join(f"W{i}" for i in range(300)), "s"),
    (11, "x" * 200_000 + " &", "s"), (12, "x" * 200_000 + " &", "s"),
]
AUDIT_LABELS = [(2, 1, 0), (2, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (12, 1, 1)]


@pytest.mark.parametrize("chain_bytes", [audit.CHAIN_BYTES, 1])
def test_op11_equals_plain_version(spark, tmp_path, monkeypatch, chain_bytes):
    monkeypatch.setattr(audit, "CHAIN_BYTES", chain_bytes)
    docs = spark.createDataFrame(AUDIT_ROWS, "doc_id bigint, text string, source string").withColumn("part", F.lit("p")).withColumn("mask", F.lit(1))
    sf = as_table(tmp_path, docs.repartition(5, F.rand(3)), "documents")
    as_table(tmp_path, spark.createDataFrame(AUDIT_LABELS, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(False)), "labels")
    assert sorted(tuple(r) for r in queries.op11_audit(spark, sf).collect()) == plain_audit(AUDIT_ROWS, AUDIT_LABELS)


def test_op11_keeps_texts_of_one_fingerprint_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 3}", "s") for i in range(30)], "doc_id bigint, text string, source string").repartition(4, "doc_id")
    monkeypatch.setattr(audit, "fingerprint", lambda data: 5)
    records = sorted((r for rows in docs.rdd.glom().collect() for r in audit._routed(iter([tuple(x) for x in rows]))), key=lambda r: r[0])
    found = [r for r in audit._walked(iter(records))]
    assert sorted(i for i, _, mask, _ in found if not mask & audit.E_BIT) == [0, 1, 2]
    assert sum(n for *_, n in found) == 30


def test_non_minimum_ids(spark):
    docs = spark.createDataFrame(AUDIT_ROWS, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in audit.non_minimum_ids(docs).collect()) == [1, 2, 2, 4, 5, 7, 12]


def test_op11_of_empty_tables(spark, tmp_path):
    as_table(tmp_path, spark.createDataFrame([], DOCS), "documents")
    sf = as_table(tmp_path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "labels")
    assert queries.op11_audit(spark, sf).collect() == []


def duck_equal(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'/*.parquet' if '/root/testdata' not in sf else ''}')")
    ours = queries.QUERIES[name](spark, sf)
    theirs = con.execute(queries.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(map(key, theirs)) == sorted(key(tuple(r)) for r in ours.select(columns).collect())


@pytest.mark.parametrize(("name", "tables"), [("op11_audit", ["documents", "labels"]), ("op12_chat", ["conversations"])])
def test_sql(spark, sf, name, tables):
    duck_equal(spark, sf, name, tables)


# -- chat formatting ---------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("#: \\ab\n</turn>", max_size=12), st.text("#\\ </turn>\nx:", max_size=40)), max_size=5))
def test_template_is_reversible(turns):
    text = "".join(chat.header(r) + chat.escaped(t) + chat.END for r, t in turns)
    assert [(r, chat.unescaped(text[a:b])) for r, a, b in chat.read_turns(text)] == turns
    assert text.count("</turn>") == len(turns) and len(re.findall("##+", text)) == len(turns)


RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "user", "content": "## ###"}, None, {"role": "assistant", "content": "x</turn>\n"}]}, "messages", [("user", "## ###"), ("assistant", "x</turn>\n")]),
    ({"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "shares", [("user", "q"), ("assistant", "")]),
    ({"id": 3, "instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\nthis"), ("assistant", "done")]),
    ({"id": 4, "instruction": "do", "output": "done", "system": "sys"}, "instruction", [("system", "sys"), ("user", "do"), ("assistant", "done")]),
    ({"id": 5, "prompt": "p", "completion": "c", "meta": {"deep": {"a": [1, {"b": 3}]}}, "a.b": 1}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"id": 6, "question": "p", "answer": None}, "question", [("user", "p"), ("assistant", "")]),
    ({"conv_id": 7, "turn": 3, "role": "user", "text": None}, "rows", [("user", "")]),
    ({"conv_id": 8, "messages": [{"role": None, "content": "t", "tokens": [1, 2]}], "source": "w"}, "messages", [("", "t")]),
]


def test_layouts_become_canonical_turns(spark):
    records = spark.createDataFrame([(json.dumps(r), i) for i, (r, _, _) in enumerate(RECORDS)], "record string, role int")
    found = chat.canonical_turns(records).orderBy("conv_id", "place").collect()
    for conv_id, (_, layout, turns) in enumerate(RECORDS, 1):
        assert [(r.layout, r.role, r.text) for r in found if r.conv_id == conv_id] == [(layout, *t) for t in turns]


def test_records_without_a_layout(spark):
    bad = ['{"foo": 1}', "[1, 2]", "5", None, "{bad", '{"conv_id": 1, "messages": []}', '{"conv_id": 1, "messages": "text"}']
    found = chat.canonical_turns(spark.createDataFrame([(b,) for b in bad], "record string"))
    assert [tuple(r) for r in found.collect()] == [(None,) * 5] * len(bad)
    assert chat.read_back(chat.format_conversations(found)).collect() == []


def test_loss_mask_covers_what_the_assistant_says(spark):
    turns = spark.createDataFrame([("rows", 1, 2, "assistant", "b\\"), ("rows", 1, 1, "user", "a##"), ("rows", 1, 3, "assistant", "##")], "layout string, conv_id bigint, place bigint, role string, text string")
    (row,) = chat.format_conversations(turns).collect()
    assert row.text == "### user:\na#\\#</turn>\n### assistant:\nb\\\\</turn>\n### assistant:\n#\\#</turn>\n"
    assert [row.text[s.start : s.end] for s in row.loss] == ["b\\\\", "#\\#"]


def test_a_long_conversation_is_written_in_parts(spark, monkeypatch):
    rows = [("rows", 1 + i % 2, i, "assistant" if i % 3 else "user", f"turn {i} " + "y" * 500) for i in range(200)]
    turns = spark.createDataFrame(rows, "layout string, conv_id bigint, place bigint, role string, text string")
    whole = sorted(tuple(r) for r in chat.read_back(chat.format_conversations(turns)).collect())
    batches = [b for b in turns.orderBy("conv_id", "place").select("conv_id", "role", "text").toArrow().to_batches()]
    monkeypatch.setattr(chat, "PART_CHARS", 2000)
    parts = [p for b in chat._format(iter(batches)) for p in b.to_pylist()]
    assert len(parts) > 20 and max(len(p["text"]) for p in parts) <= 2000
    again = chat.read_back(chat.in_order(spark.createDataFrame([tuple(p.values()) for p in parts[::-1]], chat.FORMATTED)))
    assert sorted(tuple(r) for r in again.collect()) == whole


CONV = "conv_id bigint, turn bigint, role string, text string"


def test_op12_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "z"), (1, None, "system", "s"), (None, 1, "user", "u"), (2, 0, None, "no role"), (3, 1, "assistant", "\\### " * 30_000), (3, 0, "x:y\\", "</turn>\n")]
    table = spark.createDataFrame(rows, CONV).withColumn("record", F.lit(1)).withColumn("layout", F.lit("l"))
    duck_equal(spark, as_table(tmp_path, table, "conversations"), "op12_chat", ["conversations"])


def test_op12_of_an_empty_table(spark, tmp_path):
    (row,) = queries.op12_chat(spark, as_table(tmp_path, spark.createDataFrame([], CONV), "conversations")).collect()
    said = queries.MARKED
    assert row.conv_id == -7 and row.n_turns == 2 and row.loss_chars == len(said)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# -- pages and packing -------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def test_rows_that_repeat_a_page_keep_its_text(spark):
    body = " ".join(f"w{i}" for i in range(40))
    notice = "please accept all the cookies of this host now"
    rows = [(1, "http://h/1", f"<div>{body}</div>")] * 3 + [(2, "http://h/copy", f"<div>{body}</div>")]
    rows += [(10 + i, "http://n/1", f"<p>{notice}</p><p>own words {i} of page {i}</p>") for i in range(3)] + [(20 + i, "http://m/1", f"<p>{notice}</p><p>own words {i}</p>") for i in range(2)] * 3
    got = sorted({(r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, PAGE).repartition(4)).collect()})
    assert got == [(1, body), (2, body), *((10 + i, f"own words {i} of page {i}") for i in range(3)), *((20 + i, f"{notice}\nown words {i}") for i in range(2))]


@pytest.mark.parametrize("part", ["<div></p>", "<div>", "</p>", "<p><div></p>", "<ul><li></ol>"])
def test_end_tags_that_match_nothing_are_linear(part):
    began = time.perf_counter()
    html.page_blocks("<article>" + part * 60_000 + "</article>")
    short = time.perf_counter() - began
    html.page_blocks("<article>" + "".join(f"<div>" for _ in range(60_000)) + part * 60_000)
    assert short < 3 and time.perf_counter() - began < 8


def test_nested_ends_close_what_they_should():
    page = "<article>a<div class='ads'>x<p>y</span></div>b</article><div>c<article>d</div>e</article>f"
    assert html.page_blocks(page) == [(html.KEEP, "a"), (html.DROP, "x"), (html.DROP, "y"), (html.KEEP, "b"), (html.OPEN, "c"), (html.KEEP, "d"), (html.OPEN, "e"), (html.OPEN, "f")]


def test_marks_of_the_tokenizer_as_the_library_reads_them(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    words = packing.WordTokens(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>a", "x<|endoftext|>\n<|ENDOFTEXT|> y", "<|endoftext", "plain  text\u00e9 \u0130 < | end", "<|endoftext|>" * 50]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert list(array.array("I", words.packed(text))) == want, text
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, task int, step int")
    for r in packing.tokenize_and_pack(docs, path).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("s")).collect():
        assert r.n == r.s == len(reference.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1


def test_step_groups_hold_the_same_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    pieces = packing.tokenize_and_pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    groups = pieces.select("step_group", "tier", "sequence_id").distinct().groupBy("step_group").agg(F.sum("tier").alias("n"), F.countDistinct("tier").alias("tiers"), F.first("tier").alias("tier")).collect()
    assert all(g.tiers == 1 and g.n <= packing.STEP_TOKENS for g in groups)
    for tier in {g.tier for g in groups}:
        assert sum(g.n < packing.STEP_TOKENS for g in groups if g.tier == tier) <= 1


# -- personal data -----------------------------------------------------------------------------------------------------


def plain_disclosures(rows):
    """{doc: {term: share}} by counting every pair of an entity and a term."""
    spans = {i: pii.base_spans(t) for i, t in rows}
    texts = dict(rows)
    words = {i: pii.outside_words(t or "", spans[i]) for i, t in rows}
    entities = {i: {pii.entity(k, texts[i][s:e]) for k, s, e in spans[i]} for i in texts}
    every = {i: {w.lower() for w in pii.WORD.findall(t or "")} for i, t in rows}
    tells = {i: {w for (w, _, _), x in zip(words[i], pii.telling(texts[i], words[i], spans[i])) if x} if words[i] else set() for i in texts}
    n, out = len(rows), {}
    for i in texts:
        for e in entities[i]:
            holders = [j for j in texts if e in entities[j]]
            for term in {w for w, _, _ in words[i]}:
                both = [j for j in holders if term in {w for w, _, _ in words[j]}]
                if len({texts[j] for j in both}) < 2 and not any(term in tells[j] for j in both):
                    continue
                if len(holders) < n:
                    p = (len(both) + len(holders) / n) / (sum(term in every[j] for j in texts) + 1)
                    share = math.log2(n / len(holders) * p) / math.log2(n / len(holders)) if p else 0
                    if share >= pii.DISCLOSURE - 1e-12:
                        out.setdefault(i, {})[term] = max(share, out.get(i, {}).get(term, 0))
    return out


def test_terms_equal_a_count_over_all_pairs(spark):
    rng = random.Random(11)
    pool = ["Anna", "Brugge", "carpet", "delta", "evening", "FERRO", "garden", "Hollis", "island", "jacket", "kettle", "lemon"]
    rows = []
    for i in range(90):
        words = [rng.choice(pool) if rng.random() < 0.15 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(5, 40))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), f"person{i % 4 if i % 2 else 100 + i}@mail.example.com")
            words.append(f"Name{chr(97 + i % 26)}zz")
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, "")]
    want = plain_disclosures(rows)
    got = {}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        text = dict(rows)[r.doc_id]
        terms = {text[int(s) : int(e)].lower() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
        if terms:
            got[r.doc_id] = terms
    assert got == {i: set(t) for i, t in want.items()} and len(got) > 10


def test_terms_are_generalised_by_class(spark):
    common = "and then the others also came to this place with more of the same things as before "
    rows = [(i, common * 2) for i in range(80)] + [(100, f"Write to Quillandra or the ZORVAX desk, reach brimblewick at bo.li@one.example.com {common}"), (101, None), (102, "no. 7 of 9")]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))).collect()}
    assert clean[100].startswith("[NAME] to [NAME] or the [CODE] ") and "[WORD] at [EMAIL]" in clean[100] and clean[101] is None and clean[102] == "no. 7 of 9" and clean[3] == common * 2


def test_personal_data_in_very_long_texts(spark):
    text = "word " * 200_000 + "x@y.zz " + "word " * 200_000
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.spans.startswith("email:1000000:1000006") and row.n_email == 1


# -- languages ---------------------------------------------------------------------------------------------------------


def test_a_language_of_long_texts_is_learned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 300)
    rng = random.Random(6)
    vocabulary = {"aa": ["kala", "muto", "pisu", "reno", "taki"], "bb": ["zwerg", "schnee", "pflug", "knecht", "strumpf"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text("aa", 30), "aa", None, 0) for i in range(20)] + [(100 + i, text("bb", 200), "bb", None, 0) for i in range(20)] + [(None, text("bb", 20), None, None, 0), (None, None, "aa", None, 0)]
    sf = as_table(tmp_path, spark.createDataFrame(rows, DOCS), "documents")
    got = queries.op6_language(spark, sf).collect()
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id >= 100} == {"bb"} and {r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 100} == {"aa"}
    assert sorted((r.held_out, r.lang_pred) for r in got if r.doc_id is None) == [(False, "bb"), (False, "und")]


def plain_score(model, text):
    """The score of one text by the library and the formula alone."""
    data = (text or "").encode()
    sizes = []
    for dictionary in (model.good, model.bad):
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)))
    if not data:
        z = model.weights[4]
    else:
        g, b = sizes
        d, size = (b - g) / (b + g), min(1.5, (b + g) / (2 * len(data)))
        z = sum(w * x for w, x in zip(model.weights, (10 * d, 10 * d * size, size, size * size, 1.0)))
    return 1 / (1 + math.exp(-z))


def test_scores_equal_sizes_counted_plainly(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    some = [(r.doc_id, r.text) for r in docs.where("doc_id % 4 = 0").collect()] + [(-1, None), (-2, ""), (None, "a b c"), (-3, "\u00e9 " * 30_000)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 9)) for r in quality.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect())
    assert got == sorted((i is not None, i or 0, round(plain_score(model, t), 9)) for i, t in some)
