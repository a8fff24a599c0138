"""Joins beyond plain equality: intervals, as-of, lags, all pairs, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import letters_once, pieces
from .sampling import global_rank


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Pairs of a point and an interval that holds it (strictly inside, or ends included), within equal ``on`` columns.

    An interval goes to each bin of ``width`` it touches and a point to its own, so the join is an equality join on the
    bin, with the exact condition checked after: no nested loop, and work in proportion to the matches. ``width`` should
    be about the usual length of an interval. A hot bin is split by the adaptive skew join.
    """
    on = on or []
    a = points.withColumn("__bin", F.floor(F.col(point) / width))
    b = intervals.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = (F.col(point) > F.col(low)) & (F.col(point) < F.col(high)) if strict else F.col(point).between(F.col(low), F.col(high))
    return a.join(b, [*on, "__bin"]).where(inside).drop("__bin")


def window_profile(points: DataFrame, centres: DataFrame, point: str, centre: str, span: int, on: list[str] | None = None) -> DataFrame:
    """(offset, n): how many points lie at each offset -span..span from the centres."""
    both = interval_join(points, centres.withColumn("__lo", F.col(centre) - span).withColumn("__hi", F.col(centre) + span), point, "__lo", "__hi", 2 * span + 1, on, strict=False)
    return both.groupBy((F.col(point) - F.col(centre)).alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def asof_next(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, carry: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the nearest right row at or after it (or strictly after), null where there is none.

    The two sides are laid out as one, latest first, and a running window carries the right row met last: one shuffle by
    key and one sort, O(n log n). Of right rows at one moment the one with the least ``carry`` counts.
    """
    pack = F.struct(F.col(right_at).alias("__at"), *carry)
    rows = left.select(*(F.col(c) for c in left.columns), F.col(at).alias("__t"), F.lit(1 if strict else 0).alias("__o"), F.lit(None).cast(right.select(pack).schema[0].dataType).alias("__next"))
    marks = right.select(*(F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_at).alias("__t"), F.lit(0 if strict else 1).alias("__o"), pack.alias("__next"))
    w = Window.partitionBy(*on).orderBy(F.desc("__t"), F.desc("__o"), F.col("__next").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("__left", F.lit(True)).unionByName(marks.withColumn("__left", F.lit(False)))
    found = both.withColumn("__n", F.last("__next", ignorenulls=True).over(w)).where("__left")
    return found.select(*left.columns, F.col("__n.__at").alias(f"next_{right_at}"), *(F.col(f"__n.{c}").alias(f"next_{c}") for c in carry))


def asof_strand(left: DataFrame, right: DataFrame, on: list[str], at: str, end: str, strand: str, right_at: str, carry: list[str]) -> DataFrame:
    """Each left row with the nearest right row in its direction: the first at or after ``at`` on the strand "+", the last
    at or before it on "-", and no further than ``end``; null where there is none."""
    ahead = asof_next(left.where(F.col(strand) == "+"), right, on, at, right_at, carry)
    behind = asof_last(left.where(F.col(strand) == "-"), right, on, at, right_at, carry)
    names = [right_at, *carry]
    both = ahead.select(*left.columns, *(F.col(f"next_{c}").alias(f"near_{c}") for c in names))
    both = both.union(behind.select(*left.columns, *(F.col(f"last_{c}").alias(f"near_{c}") for c in names)))
    near = F.col(f"near_{right_at}")
    inside = F.when(F.col(strand) == "+", near <= F.col(end)).otherwise(near >= F.col(end))
    return both.select(*left.columns, *(F.when(inside, F.col(f"near_{c}")).alias(f"near_{c}") for c in names))


def interval_order(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, strand: str, by: list[str], width: float, on: list[str] | None = None) -> DataFrame:
    """The pairs of ``interval_join`` with ``order`` from 1 along each interval (``by``): rising on "+", falling on "-"."""
    sign = F.when(F.col(strand) == "-", -1).otherwise(1)
    along = Window.partitionBy(*by).orderBy(F.col(point) * sign)
    return interval_join(points, intervals, point, low, high, width, on).withColumn("order", F.row_number().over(along))


def asof_last(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, carry: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it: the state that holds then."""
    pack = F.struct(F.col(right_at).alias("__at"), *carry)
    rows = left.select(*left.columns, F.col(at).alias("__t"), F.lit(1).alias("__o"), F.lit(None).cast(right.select(pack).schema[0].dataType).alias("__last"), F.lit(True).alias("__left"))
    marks = right.select(*(F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_at).alias("__t"), F.lit(0).alias("__o"), pack.alias("__last"), F.lit(False).alias("__left"))
    w = Window.partitionBy(*on).orderBy("__t", "__o", F.col("__last").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("__n", F.last("__last", ignorenulls=True).over(w)).where("__left")
    return found.select(*left.columns, F.col("__n.__at").alias(f"last_{right_at}"), *(F.col(f"__n.{c}").alias(f"last_{c}") for c in carry))


def interval_mean(spans: DataFrame, start: str, end: str, value: str, by: list[str]) -> DataFrame:
    """(by, pos, value, n): mean of a value over all spans [start, end) that cover a position."""
    grown = spans.where(F.col(end) > F.col(start)).select(*by, value, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("pos"))
    return grown.groupBy(*by, "pos").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def interval_mean_rollup(spans: DataFrame, start: str, end: str, value: str, by: str) -> DataFrame:
    """interval_mean for each ``by`` and, with a null ``by``, over all."""
    grown = spans.where(F.col(end) > F.col(start)).select(by, value, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("pos"))
    return grown.rollup("pos", by).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n")).where("pos IS NOT NULL")


def around_centres(means: DataFrame, centres: list[int], span: int, by: list[str]) -> DataFrame:
    """(by, centre, shift, value): means (by, pos, value) told from each centre, from ``-span`` to ``span``; null where a
    place has none. The centres are a stated list."""
    grid = means.select(*by).distinct().withColumn("centre", F.explode(F.array(*map(F.lit, centres)))).withColumn("shift", F.explode(F.sequence(F.lit(-span), F.lit(span))))
    return grid.withColumn("pos", F.col("centre") + F.col("shift")).join(means, [*by, "pos"], "left").select(*by, "centre", "shift", "value")


#: Rows of a block of all_pairs: a task holds two, and compares about this number squared.
BLOCK_ROWS = 4096


def all_pairs(rows: DataFrame, key: str, values: str, score: Column, least: int = 8) -> DataFrame:
    """(id1, id2, score) for all pairs id1 < id2, with ``score`` over the arrays ``x`` and ``y``.

    This is an n^2 operator by definition, so it is cut into block pairs: each row is sent to the blocks it meets, the
    join is an equality join on the pair of blocks (every task holds two blocks, never all rows), and the vectors are
    compared inside array expressions. The blocks grow in number, not in size, with the rows; there are ``least`` or more.
    """
    named = in_blocks(rows.select(F.col(key).alias("id"), F.col(values).alias("v")), "id", least)
    left = named.select(F.col("id").alias("id1"), F.col("v").alias("x"), F.col("__i").alias("i"), F.explode("__all").alias("j"))
    right = named.select(F.col("id").alias("id2"), F.col("v").alias("y"), F.explode("__all").alias("i"), F.col("__i").alias("j"))
    return left.join(right.hint("shuffle_hash"), ["i", "j"]).where("id1 < id2").select("id1", "id2", score.alias("score"))


#: Rows of a second block that all_pairs_by_value takes through a whole first block at a time.
RUN_ROWS = 64


def all_pairs_by_value(rows: DataFrame, key: str, values: str, score: Column, least: int = 8) -> DataFrame:
    """The rows of ``all_pairs`` in an order that files store in few bytes: what they take is nearly all of this job's disk.

    Blocks follow the order of the values, so that rows of equal values share a block, and where values repeat a pair of
    blocks has few different scores, which a column file holds once each. Blocks are cut by rank, so a value of many rows
    takes several. The rows of a block go by key in short runs, and a run meets each row of the other block in turn: its
    keys come again and again. A task holds a block's rows and ``BLOCK_ROWS`` times ``RUN_ROWS`` pairs.
    Up to ``BLOCK_ROWS`` rows have few pairs, and keep the order of ``all_pairs``.
    """
    n = rows.count()
    if n <= BLOCK_ROWS:
        return all_pairs(rows, key, values, score, least)
    blocks = max(least, -(-n // BLOCK_ROWS))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n * n // BLOCK_ROWS**2)
    placed = rows.select(F.get(values, F.lit(0)).alias("first"), F.struct(F.col(values).alias("v"), F.col(key).alias("id")).alias("row"))
    named = global_rank(placed, "first", "row").select("row", F.floor((F.col("rank") - 1) * blocks / n).cast("int").alias("__i"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = named.groupBy("__i").agg(F.sort_array(F.collect_list(F.struct("row.id", "row.v"))).alias("__rows"))
    runs = block.select("__i", F.explode(F.transform(F.sequence(F.lit(1), F.size("__rows"), F.lit(RUN_ROWS)), lambda at: F.slice("__rows", at, RUN_ROWS))).alias("run"))
    left = named.select("row", F.col("__i").alias("i"), every.alias("j")).repartition(tasks, "i", "j")
    right = runs.select("run", every.alias("i"), F.col("__i").alias("j")).repartition(tasks, "i", "j")
    met = right.join(left.hint("shuffle_hash"), ["i", "j"]).select("row", F.explode("run").alias("other")).where("row.id < other.id")
    return met.select(F.col("row.id").alias("id1"), F.col("other.id").alias("id2"), F.col("row.v").alias("x"), F.col("other.v").alias("y")).select("id1", "id2", score.alias("score"))


def in_blocks(rows: DataFrame, key: str, least: int = 8, size: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with the number __i of a block of about ``size`` rows, by the hash of ``key``, and __all the blocks."""
    blocks = F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) / size)).cast("int")
    sized = rows.crossJoin(F.broadcast(rows.agg(blocks.alias("__b"))))  # one row
    return sized.withColumn("__i", F.pmod(F.xxhash64(key), F.col("__b")).cast("int")).withColumn("__all", F.sequence(F.lit(0), F.col("__b") - 1)).drop("__b")


def euclidean(x: Column, y: Column, size: int | None = None) -> Column:
    """The distance of two arrays; with ``size``, of their first elements, which needs no loop."""
    if size is not None:
        gaps = [F.get(x, F.lit(k)) - F.get(y, F.lit(k)) for k in range(size)]
        return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def similarity(distance: Column, scale: float = 10.0) -> Column:
    """exp(-scale * distance)."""
    return F.exp(-F.lit(scale) * distance)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of a half table of pairs."""
    return pairs.unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), *(c for c in pairs.columns if c not in ("id1", "id2"))))


def by_centre(a: DataFrame, b: DataFrame, seq_a: str, seq_b: str, size: int, side: str) -> DataFrame:
    """Pairs whose ``size`` letters left or right of the centre are equal: an equality join on the substring."""
    def part(seq: str) -> Column:
        mid = F.floor(F.length(seq) / 2).cast("int")
        return F.substring(F.col(seq), mid - size + 1, F.lit(size)) if side == "left" else F.substring(F.col(seq), mid + 1, F.lit(size))

    return a.withColumn("__k", part(seq_a)).where(F.length("__k") == size).join(b.withColumn("__k", part(seq_b)).where(F.length("__k") == size), "__k").drop("__k")


def containment(queries: DataFrame, texts: DataFrame, query_id: str, query: str, text_id: str, text: str, size: int, unique: bool = True) -> DataFrame:
    """(query_id, text_id, pos) of exact occurrences; with ``unique`` only of queries that occur once.

    The first ``size`` letters of a query are an equality key into the texts' overlapping pieces, which carry no text; the
    places so found go back to their texts, where the rest is compared. Queries shorter than ``size`` are not looked up.
    """
    q = queries.where(F.length(query) >= size).select(F.col(query_id), F.col(query).alias("__q"), F.left(query, F.lit(size)).alias("__k"))
    named = texts.where(F.length(text) >= size).select(text_id, F.col(text).alias("__t"), F.xxhash64(text).alias("__h"))
    places = named.select(text_id, "__h", F.posexplode(pieces(F.col("__t"), size)).alias("__p", "__k"))
    found = places.join(q, "__k").groupBy(text_id, "__h", query_id, "__q").agg(F.sort_array(F.collect_set("__p")).alias("__p"))
    # a query's places in one text: as many as the text has letters at most
    hits = named.join(found, [text_id, "__h"]).select(query_id, text_id, letters_once(F.col("__t"), lambda c: F.filter("__p", lambda p: F.array_join(F.slice(c, p + 1, F.length("__q")), "") == F.col("__q"))).alias("__p"))
    hits = hits.select(query_id, text_id, F.explode("__p").alias("pos"))
    once = hits.groupBy(query_id).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(query_id)
    return hits.join(once, query_id, "left_semi") if unique else hits


def shifted(signal: DataFrame, other: DataFrame, key: list[str], shift: int, name: str) -> DataFrame:
    """The signal with the other one's value at pos + shift (null where it has none)."""
    moved = other.select(*key, (F.col("pos") - shift).alias("pos"), F.col("value").alias(name))
    return signal.join(moved, [*key, "pos"], "left")


def membership(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(inside, outside): how many rows of ``a`` have, and have not, a partner in ``b``, by one pass over ``a``."""
    keys = b.select(*on).distinct().withColumn("__in", F.lit(1))
    return a.join(keys, on, "left").agg(F.count("__in").alias("inside"), F.count_if(F.col("__in").isNull()).alias("outside"))
