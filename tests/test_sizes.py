"""What must not grow with the tables: plans, sizes of tasks, and results beside plain counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.llm import pii
from strandloom.models import matrices
from strandloom.operators import divergence as D
from strandloom.operators import joins as J
from strandloom.operators import mapping
from strandloom.operators import signal as G
from strandloom.plans import catalog


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_pair_distances_send_no_marks_to_every_task(spark):
    texts = {1: "ababababxab", 2: "aaaaaa", 3: "", None: "aaaa"}
    marks = S.explode_pieces(spark.createDataFrame(list(texts.items()), "id int, s string"), ["id"], "s", 2).withColumnRenamed("kmer", "step")
    more = marks.where("id = 1").union(marks.where("id = 2")).union(marks.where("id IS NULL"))
    more = more.union(spark.createDataFrame([(2, 0, "aa"), (2, None, "aa"), (2, 1, None)], "id int, pos int, step string"))
    got = G.pair_distances(more, ["id"], "step", 4)
    held = [(1, p, texts[1][p : p + 2]) for p in range(10)] + [(2, p, "aa") for p in (0, 0, 1, 2, 3, 4)]
    want = Counter((s, q - p) for i, p, s in held for j, q, t in held if i == j and s == t and 1 <= q - p <= 4)
    assert {(r.step, r.lag): r.n for r in got.collect()} == want
    assert "Broadcast" not in plan(got)


def test_mapping_sends_no_piece_of_the_genome_to_every_task(spark, monkeypatch):
    letters = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(3000))
    genome = spark.createDataFrame([("c", letters), ("d", letters[500:900])], "chr string, seq string")
    reads = spark.createDataFrame([(i, letters[i * 37 : i * 37 + 30]) for i in range(60)] + [(99, "A" * 30)], "read_id int, seq string")
    found = mapping.mapped(genome, reads, 10)
    want = {(i, "c" if s in letters else None) for i, s in reads.collect()}
    few = sorted(map(tuple, found.collect()))
    assert {(r[0], r[1]) for r in few} == want
    # only the sequences may be broadcast
    assert plan(found).count("BroadcastExchange") <= 1
    monkeypatch.setattr(mapping, "BESIDE_BYTES", 0)
    many = mapping.mapped(genome, reads, 10)
    assert sorted(map(tuple, many.collect())) == few
    assert "Broadcast" not in plan(many)


def test_silhouette_equals_a_plain_count(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).round(3).tolist(), f"c{i % 3}") for i in range(60)]
    rows += [(60 + i, rows[0][1], "c0") for i in range(5)] + [(70, [1.0, None, 2.0], "c1"), (71, None, "c2"), (72, [1.0, 2.0], "c1"), (73, [4.0, 2.0], None), (None, [1.0, 2.0, 3.0], "c0"), (3, [0.0, 0.5, 0.0], "c1"), (80, [1e9, 1e9, 1e9], "far"), (81, [1e9, 1e9, 1e9 + 1], "far")]

    def gap(x, y):
        return None if x is None or y is None or len(x) != len(y) or None in x or None in y else sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5

    sums = {}
    for i, x, c in rows:
        for j, y, d in rows:
            if i is not None and j is not None and i != j:
                met = sums.setdefault((i, c), {}).setdefault(d, [])
                met += [g for g in [gap(x, y)] if g is not None]
    want = {}
    for (i, c), others in sums.items():
        means = {d: sum(v) / len(v) for d, v in others.items() if v}
        a, b = means.get(c) if c is not None else None, min((m for d, m in means.items() if c is not None and d is not None and d != c), default=None)
        want[i, c] = 0.0 if a is None or b is None else (b - a) / max(a, b)
    frame = spark.createDataFrame(rows, "id int, v array<double>, c string")
    got = D.silhouette(frame, "id", "v", "c")
    found = {(r.id, r.c): r.silhouette for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    # distances are added up where they are made
    assert "Generate explode(array(struct" not in plan(got) and "FlatMapGroupsInArrow" in plan(got)

    # the same sums whatever the rows taken at once
    for p, q in ((0, 1), (0, 0)):
        part = [(k, v, c, i % 2 if p != q else 0, p, q) for i, (k, v, c) in enumerate(rows) if k is not None and (v is None or None not in v)]
        types = [pa.int32(), pa.list_(pa.float64()), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["k", "v", "c", "__i", "__p", "__q"])
        told = []
        for at_once in (3, 256):
            monkeypatch.setattr(D, "AT_ONCE", at_once)
            table = pa.Table.from_batches(list(D.block_sums(iter([batch])))).to_pandas()
            told.append(table.groupby(["k", "own", "other"], dropna=False).sum().sort_index())
        assert told[0].index.equals(told[1].index) and (told[0]["n"] == told[1]["n"]).all() and np.allclose(told[0]["s"], told[1]["s"])


def test_common_terms_of_entity_texts_are_not_counted(spark, monkeypatch):
    common = "alpha beta gamma delta"
    rows = [(i, f"{common} Rare{chr(97 + i % 26)}{chr(97 + i // 26)} user{i}@mail.example {common}") for i in range(60)] + [(100 + i, f"plain words only {i}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked, counts = [], pii.term_counts
    monkeypatch.setattr(pii, "term_counts", lambda d, terms: asked.extend(r.term for r in terms.collect()) or counts(d, terms))
    found = {r.doc_id: r.n_term for r in pii.find(docs).collect()}
    assert len(asked) == len(set(asked)) == 60 and all(t.startswith("rare") for t in asked)
    assert all(found[i] == (1 if i < 60 else 0) for i, _ in rows)


def test_texts_that_may_hold_a_value_are_all_asked(spark):
    texts = ["a@b.c", "x@-.y", "1.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 2345678", "+1).(-  2345678", "+12345678", "no 12 34", "@", "call +1234567", "1.2.3.999", "", None]
    maybe = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(F.col("t").rlike(pii.MAYBE), F.lit(False)).alias("m")).collect()]
    assert all(m for t, m in zip(texts, maybe) if pii.base_spans(t))
    assert maybe[8:10] == [False, False]


def test_nmf_rounds_have_few_tasks_for_a_small_matrix(spark):
    rows = spark.createDataFrame([(i, [float((i * j) % 5 + 1) for j in range(6)]) for i in range(40)], "id int, v array<double>")
    tracker, wide = spark.sparkContext.statusTracker(), []
    for rounds in (2, 7):
        spark.sparkContext.setJobGroup(f"nmf-{rounds}", "")
        matrices.nmf(rows.repartition(40), "id", "v", 2, rounds=rounds)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"nmf-{rounds}") for s in tracker.getJobInfo(j).stageIds]
        wide.append(sum(s.numTasks >= 40 and s.numCompletedTasks > 0 for s in stages if s))
    # the passes before and after the rounds have a task a partition, the rounds have one
    assert wide[0] == wide[1]


def test_pairs_of_repeated_values_take_few_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 300)
    balances = np.random.default_rng(5).uniform(-999, 9999, 600).round(2).tolist()
    rows = [(1 + i + 600 * k, i % 25, x) for k in range(4) for i, x in enumerate(balances)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    catalog.QUERIES["allpairs_similarity"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    n = len(rows) * (len(rows) - 1) // 2
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == n == got.select("id1", "id2").distinct().where("id1 < id2").count()
    # 6 bytes a row and more in the order of all_pairs
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3 * n


def test_pairs_by_value_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 40)
    monkeypatch.setattr(J, "RUN_ROWS", 7)
    rng = np.random.default_rng(6)
    rows = [(i, [float(rng.integers(0, 9)), float(rng.integers(0, 3))]) for i in range(300)] + [(300 + i, [5.0, 1.0]) for i in range(200)]
    rows += [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (700, None), (701, [None, 1.0]), (702, [2.0, None]), (703, []), (None, [1.0, 1.0]), (704, [float("nan"), 0.0]), (-5, [float("inf"), 0.0])]
    given = spark.createDataFrame(rows, "id bigint, v array<double>")
    by = {size: J.euclidean(F.col("x"), F.col("y"), size).cast("string").alias("score") for size in (None, 2)}
    want = Counter(map(tuple, J.all_pairs(given.where("v IS NULL OR size(v) = 2"), "id", "v", by[None]).collect()))
    assert Counter(map(tuple, J.all_pairs_by_value(given.where("v IS NULL OR size(v) = 2"), "id", "v", by[2]).collect())) == want
    assert J.all_pairs_by_value(given, "id", "v", by[2]).count() == J.all_pairs(given, "id", "v", by[2]).count()
    assert J.all_pairs_by_value(given.where("false"), "id", "v", by[2]).count() == 0
