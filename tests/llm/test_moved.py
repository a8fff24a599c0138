"""How much of the texts moves between tasks where only a few of them have to meet something."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandloom.llm import lines, near_text
from strandloom.llm.common import perhaps


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(new(), False, False, sc._gateway.new_array(sc._jvm.double, 0), new())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def large(spark):
    """100 texts of 40 kB in 20 lines; the last of them is the first with another line. Joins are by shuffle, as with large tables."""
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.randbytes(10).hex() for _ in range(95)) for _ in range(20)) for _ in range(99)]
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[0] + "\none line more")], "doc_id int, text string").repartition(3)
    path = corpus_pipeline.written(docs, "large")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield path
    spark.conf.set(key, before)


def test_texts_without_repeated_lines_do_not_move(spark, large):
    before = shuffled(spark)
    got = {r.doc_id: (r.n, r.removed) for r in lines.cleaned(large).select("doc_id", F.length("text").alias("n"), F.col("__n_removed").alias("removed")).collect()}
    assert got[99] == (len("one line more"), 20) and all(removed == 0 for i, (_, removed) in got.items() if i < 99) and len(got) == 100
    assert shuffled(spark) - before < 1_000_000


def test_texts_that_are_near_nothing_do_not_move(spark, large):
    before = shuffled(spark)
    got = {r.doc_id: r.class_id for r in near_text.mark(large).collect()}
    assert got == {i: i for i in range(99)} | {99: 0}
    kept = corpus_pipeline.drop_near_copies(spark, large, "").select("doc_id", F.length("text").alias("n")).collect()
    assert {r.doc_id for r in kept} == set(range(99)) and len(kept) == 99
    assert shuffled(spark) - before < 1_000_000


def test_the_filter_loses_no_key_and_rules_others_out(spark):
    rows = spark.createDataFrame([(i, f"t{i % 7}") for i in range(3000)] + [(None, "a"), (None, None), (5, None)], "id long, t string")
    keys = rows.where("id % 3 = 0").union(rows.where("t IS NULL"))
    got = perhaps(rows, keys, "id", "t")
    assert got.columns == ["id", "t", "__maybe"] and got.count() == rows.count()
    assert got.where("__maybe").join(keys, (rows["id"].eqNullSafe(keys["id"])) & (rows["t"].eqNullSafe(keys["t"])), "left_semi").count() == 1002
    assert got.where("__maybe").count() <= 1010
    assert perhaps(rows, keys.where("false"), "id", "t").where("__maybe").count() == 0
    # a bit at either end of a part
    ends = spark.range(70_000).select(F.col("id"))
    assert perhaps(ends, ends, "id").where("NOT __maybe").count() == 0
