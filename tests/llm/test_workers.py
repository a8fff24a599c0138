"""What an executor's Python workers hold, in the pipeline's stages."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from strandloom.llm import near_text, packing, pii, quality


def test_filter_of_terms_is_made_without_an_rdd(spark, monkeypatch):
    # an RDD's Python steps start workers beside those of the data frames, which an executor then holds twice
    terms = [f"word{i}" for i in range(500)]
    rows = spark.createDataFrame([(t,) for t in terms], "term string").repartition(3)

    def refused(self):
        raise AssertionError("rdd")

    monkeypatch.setattr(type(rows), "rdd", property(refused))
    want = np.zeros(pii.FILTER_BITS // 8, np.uint8)
    at = pii.filter_bits(terms)
    np.bitwise_or.at(want, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    assert np.array_equal(pii.term_filter(rows), want)
    assert not pii.term_filter(rows.where("term = ''")).any()


def test_workers_read_texts_in_slices(spark, monkeypatch):
    most = []
    seen = lambda self, texts: most.append(len(texts)) or np.zeros((len(texts), 3))
    monkeypatch.setattr(quality.Sizer, "features", seen)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1200)], "doc_id long, text string").coalesce(1)
    taken = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run))
    quality.accepted(docs, quality.Model(b"", b"", (0.0,) * 5))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": [None, *["x"] * 1199]})
    out = list(taken["run"](iter([batch])))
    assert max(most) <= 512 and sum(b.num_rows for b in out) == 1200 and pa.Table.from_batches(out).equals(pa.Table.from_batches([batch]))


def test_a_null_text_beside_a_near_copy_of_one_id(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, None), (2, " ".join([*words, "end"])), (3, "quite another text of six words")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_text.mark(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_words_that_a_packing_worker_remembers_are_bounded_and_frequent_ones_stay():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordTokens(path, memory=50)
    for i in range(300):
        text = f"often Often, q{i}x z{i} w{i}-v{i} 's it's"
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.packed(text), np.uint32).tolist() == want, text
    # every dict of words that the worker keeps, together
    kept = lambda x: [d for x in (x, *vars(x).values()) if hasattr(x, "__dict__") for d in vars(x).values() if isinstance(d, dict)]
    assert sum(map(len, kept(words))) <= 100 and any("often" in d for d in kept(words))
    words = packing.WordTokens(path, memory=50)
    words.packed(" ".join(f"plain{'x' * i}" for i in range(20)))
    assert sum(map(len, kept(words))) == 20  # a chunk that is one word is kept once


def test_packing_and_pii_read_texts_in_slices(spark, monkeypatch):
    taken = []
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run) or docs)
    pii.scan(docs)
    most = []
    monkeypatch.setattr(pii, "span_text", lambda spans: most.append(1) or "")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "th": list(range(1200)), "text": [None, *["a@b.cd Word"] * 1199]})
    out = []
    for part in taken[0](iter([batch])):
        out.append(part)
        assert len(most) <= 512
        most.clear()
    assert sum(b.num_rows for b in out) == 1200 and out[0].column("entities").to_pylist()[:2] == [[], ["email:a@b.cd"]]


def test_modules_that_the_pipelines_workers_read_need_no_pandas():
    # 27 MB in each of an executor's workers
    said = "import sys, corpus_pipeline; print('pandas' in sys.modules)"
    ran = subprocess.run([sys.executable, "-c", said], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=60)
    assert ran.stdout.split() == ["False"], ran.stderr
