"""The registered queries of the engine, each over whole tables, and the same results in DuckDB SQL.

Stand-ins: an event is a cut (id = user, side by kind of event, place = seconds of its time modulo the template length);
a brand's signal is its parts' sizes; a customer's signal is its orders by month.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import tables
from ..operators import divergence as D
from ..operators import gibbs as B
from ..operators import impute as I
from ..operators import joins as J
from ..operators import reads as R
from ..operators import sampling as P
from ..operators import signal as G
from ..sources import text as T
from ..sources.memo import passing_folder
from ..sources.partitions import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LENGTH, OFFSET = 225, 53
TEMPLATE = "".join("ACGT"[(i * i + 3 * i + i // 7) % 4] for i in range(LENGTH))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, and no minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


# -- stand-in tables ---------------------------------------------------------------------------------------------------

def event_cuts(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("click", "view"), "L").otherwise("R")
    rows = read(spark, sf, "events").select(F.col("user_id").alias("id"), side.alias("side"), F.pmod(seconds("ts"), F.lit(LENGTH)).cast("int").alias("cut"))
    return rows.withColumn("pos", F.col("cut") + F.when(F.col("side") == "R", OFFSET).otherwise(-OFFSET))


CUTS = f"""cuts AS (SELECT user_id AS id, CASE WHEN event_type IN ('click','view') THEN 'L' ELSE 'R' END AS side, CAST(CAST(floor(epoch(ts)) AS BIGINT) % {LENGTH} AS INT) AS cut FROM events),
dy AS (SELECT id, pos, CAST(count(*) AS DOUBLE) AS value FROM (SELECT id, cut + CASE WHEN side='R' THEN {OFFSET} ELSE -{OFFSET} END AS pos FROM cuts) WHERE pos BETWEEN 0 AND {LENGTH - 1} GROUP BY ALL),
dense AS (SELECT i.id, g.pos, coalesce(dy.value, 0.0) AS value FROM (SELECT DISTINCT id FROM dy) i CROSS JOIN (SELECT CAST(unnest(range(0, {LENGTH})) AS INT) AS pos) g LEFT JOIN dy ON dy.id = i.id AND dy.pos = g.pos)"""


def event_dyads(spark: SparkSession, sf: str) -> DataFrame:
    return R.dyad_histogram(event_cuts(spark, sf).where(F.col("pos").between(0, LENGTH - 1)))


def event_signal(spark: SparkSession, sf: str) -> DataFrame:
    return G.densify(event_dyads(spark, sf), ["id"], 0, LENGTH - 1)


def brand_signal(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "part").groupBy(F.col("p_brand").alias("id"), (F.col("p_size") - 1).alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return G.densify(counts, ["id"], 0, 49)


BRANDS = """bs AS (SELECT i.id, g.pos, coalesce(c.n, 0.0) AS value FROM (SELECT DISTINCT p_brand AS id FROM part) i CROSS JOIN (SELECT CAST(unnest(range(0, 50)) AS INT) AS pos) g
LEFT JOIN (SELECT p_brand AS id, p_size - 1 AS pos, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL) c ON c.id = i.id AND c.pos = g.pos)"""


def month(ts: str) -> Column:
    return (F.year(ts) - 1995) * 12 + F.month(ts) - 1


def customer_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), month("o_orderdate").alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return G.densify(rows, ["id"], 0, 79)


MONTHS = """co AS (SELECT o_custkey AS id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS pos, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
cs AS (SELECT i.id, g.pos, coalesce(co.n, 0.0) AS value FROM (SELECT DISTINCT id FROM co) i CROSS JOIN (SELECT CAST(unnest(range(0, 80)) AS INT) AS pos) g LEFT JOIN co ON co.id = i.id AND co.pos = g.pos)"""


def region_masses(spark: SparkSession, sf: str) -> DataFrame:
    """(id, values): orders by month of each nation's customers."""
    nations = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), month("o_orderdate").alias("pos")).join(nations, "c_custkey")
    return G.to_arrays(G.densify(rows.groupBy("id", "pos").agg(F.count(F.lit(1)).alias("value")), ["id"], 0, 79), ["id"])


NATIONS = """nc AS (SELECT c_nationkey AS id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS pos, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
nm AS (SELECT i.id, g.pos, coalesce(nc.n, 0) / sum(coalesce(nc.n, 0.0)) OVER (PARTITION BY i.id) AS p FROM (SELECT DISTINCT id FROM nc) i CROSS JOIN (SELECT CAST(unnest(range(0, 80)) AS INT) AS pos) g LEFT JOIN nc ON nc.id = i.id AND nc.pos = g.pos)"""


# -- sequence functions ------------------------------------------------------------------------------------------------

@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc FROM part")
def rev_comp_text(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.reverse_complement(F.col("p_name")).alias("rc"))


@query("SELECT lang, round(avg(length(regexp_replace(lower(text), '[^gc]', '', 'g')) * 100.0 / length(text)), 6) AS gc, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY lang")
def gc_content_by_lang(spark, sf):
    rows = read(spark, sf, "documents").where(F.length("text") > 0).select("lang", S.letter_share(F.col("text"), "gc").alias("g"))
    return rows.groupBy("lang").agg(r6(F.avg("g")).alias("gc"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '(a+|t+|o+)'), lambda x: length(x))), 0) AS INT) AS longest FROM documents WHERE text IS NOT NULL")
def longest_run(spark, sf):
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", S.longest_run(F.col("text"), "ato").alias("longest"))


@query("""WITH p AS (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM part) SELECT upper(substr(p_name, i, 2)) AS step, count(*) AS n FROM p GROUP BY ALL""")
def bigram_counts(spark, sf):
    return S.explode_pieces(read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("s")), ["p_partkey"], "s", 2).groupBy(F.col("kmer").alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part)
SELECT CAST(i - 1 AS INT) AS pos, substr(p_name, i, 2) AS step, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY i), 6) AS share FROM p GROUP BY i, step""")
def positional_bigram(spark, sf):
    counts = S.explode_pieces(read(spark, sf, "part"), ["p_partkey"], "p_name", 2).groupBy("pos", F.col("kmer").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("pos"))))


@query("""WITH p AS (SELECT lang, text, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) >= 3)
SELECT lang, substr(text, i, 3) AS kmer, count(*) AS n FROM p GROUP BY ALL""")
def kmer_freq(spark, sf):
    docs = spread(read(spark, sf, "documents").select("lang", "text"))
    return S.explode_pieces(docs, ["lang"], "text", 3).groupBy("lang", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_brand, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part), c AS (SELECT p_brand, substr(p_name, i, 3) AS kmer, count(*) AS n FROM p GROUP BY ALL),
a AS (SELECT kmer, sum(n) / (SELECT sum(n) FROM c) AS f FROM c GROUP BY kmer), g AS (SELECT p_brand, kmer, n / sum(n) OVER (PARTITION BY p_brand) AS f FROM c)
SELECT g.p_brand, g.kmer, round(g.f / a.f, 6) AS fold FROM g JOIN a USING (kmer)""")
def kmer_fold_by_brand(spark, sf):
    counts = S.explode_pieces(read(spark, sf, "part"), ["p_brand"], "p_name", 3).groupBy("p_brand", "kmer").agg(F.count(F.lit(1)).alias("n"))
    own = counts.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")))
    total = counts.agg(F.sum("n").alias("t"))
    whole = counts.groupBy("kmer").agg(F.sum("n").alias("m")).crossJoin(F.broadcast(total)).select("kmer", (F.col("m") / F.col("t")).alias("g"))
    return own.join(whole, "kmer").select("p_brand", "kmer", r6(F.col("f") / F.col("g")).alias("fold"))


STEPS_SQL = ", ".join(f"('{k}', {v})" for k, v in tables.EXTINCTION_STEPS.items())
BASES_SQL = ", ".join(f"('{k}', {v})" for k, v in tables.EXTINCTION_BASES.items())


@query(f"""WITH d(s, v) AS (VALUES {STEPS_SQL}), m(s, v) AS (VALUES {BASES_SQL}), p AS (SELECT p_partkey, upper(p_name) AS s, unnest(range(1, length(p_name))) AS i FROM part),
x AS (SELECT p_partkey, coalesce(d.v, 0) - CASE WHEN i > 1 THEN coalesce(m.v, 0) ELSE 0 END AS v FROM p LEFT JOIN d ON d.s = substr(p.s, i, 2) LEFT JOIN m ON m.s = substr(p.s, i, 1))
SELECT p_partkey, CAST(sum(v) AS DOUBLE) AS extinction FROM x GROUP BY p_partkey""")
def nn_weighted_sum(spark, sf):
    return read(spark, sf, "part").where(F.length("p_name") >= 2).select("p_partkey", S.extinction(F.col("p_name")).alias("extinction"))


@query("SELECT p_partkey, length(p_name) % 2 = 0 AND upper(p_name) = reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS palindrome FROM part")
def palindrome_test(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.is_palindrome(F.col("p_name")).alias("palindrome"))


@query("""WITH k AS (SELECT n_nationkey, translate(upper(substr(n_name, 1, 3)), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS w FROM nation), l AS (SELECT unnest(['A','T','C','G']) AS x)
SELECT n_nationkey, a.x || b.x || c.x AS bubble FROM k, l a, l b, l c WHERE a.x <> substr(w, 1, 1) AND b.x <> substr(w, 2, 1) AND c.x <> substr(w, 3, 1)""")
def mismatched_words(spark, sf):
    rows = read(spark, sf, "nation").select("n_nationkey", F.translate(F.upper(F.substring("n_name", 1, 3)), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC").alias("w"))
    return rows.join(S.mismatched_words(rows.select("w").distinct(), "w"), "w").select("n_nationkey", "bubble")


@query("SELECT p_partkey, substr(p_name, 1, 3) || substr(p_name, 6) AS skipped, substr(p_name, 4, 2) AS inside, substr(p_name, 1, 3) || 'NN' || substr(p_name, 6) AS replaced FROM part")
def masked_names(spark, sf):
    s = F.col("p_name")
    return read(spark, sf, "part").select("p_partkey", S.masked(s, 3, 2).alias("skipped"), S.masked(s, 3, 2, "include").alias("inside"), S.masked(s, 3, 2, "replace").alias("replaced"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 225 AS loc, CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'I' ELSE 'D' END AS k, repeat('A', CAST(o_custkey % 5 + 1 AS INT)) AS nts FROM orders)
SELECT o_orderkey, CAST(loc AS INT) AS loc, k AS mtype, nts, CAST(length(nts) AS INT) AS size, k || '_' || length(nts) || '[' || loc || ':' || (loc + length(nts)) || ']' AS label FROM v""")
def variant_ids(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "M").when(F.col("o_orderkey") % 3 == 1, "I").otherwise("D")
    name = F.concat_ws("-", (F.col("o_orderkey") % 225).cast("string"), kind, F.repeat(F.lit("A"), (F.col("o_custkey") % 5 + 1).cast("int")))
    rows = read(spark, sf, "orders").select("o_orderkey", S.variant(name).alias("v"))
    return rows.select("o_orderkey", "v.loc", "v.mtype", "v.nts", "v.size", S.variant_label(F.col("v")).alias("label"))


@query("""WITH m AS (SELECT p_partkey, p_name, unnest(regexp_extract_all(p_name, '(a+|e+|[^ae]+)')) AS part, generate_subscripts(regexp_extract_all(p_name, '(a+|e+|[^ae]+)'), 1) AS i FROM part),
s AS (SELECT p_partkey, part, coalesce(sum(length(part)) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
SELECT p_partkey, substr(part, 1, 1) AS letter, CAST(start AS INT) AS start, CAST(length(part) AS INT) AS size FROM s WHERE substr(part, 1, 1) IN ('a', 'e')""")
def run_starts(spark, sf):
    return S.run_starts(read(spark, sf, "part"), "p_partkey", "p_name", "ae")


@query("""WITH t AS (SELECT p_partkey, p_name, instr(p_name, 'e') - 1 AS loc FROM part WHERE instr(p_name, 'e') > 0)
SELECT p_partkey, CAST(loc - length(regexp_extract(substr(p_name, 1, loc), '(e*)$', 1)) AS INT) AS start,
CAST(length(regexp_extract(substr(p_name, 1, loc), '(e*)$', 1)) + 1 + length(regexp_extract(substr(p_name, loc + 2), '^(e*)', 1)) AS INT) AS size FROM t""")
def extended_tracts(spark, sf):
    rows = read(spark, sf, "part").where(F.instr("p_name", "e") > 0).select("p_partkey", S.extended_tract(F.col("p_name"), F.instr("p_name", "e") - 1, F.lit(1), "e").alias("x"))
    return rows.select("p_partkey", "x.start", "x.size")


STIFF_SQL = ", ".join(f"('{k}', {v})" for k, v in tables.STIFFNESS.items())


@query(f"""WITH k(s, v) AS (VALUES {STIFF_SQL}), n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM n), w AS (SELECT p_name, i - 1 AS i, k.v FROM p JOIN k ON k.s = upper(substr(p_name, i, 2))),
f AS (SELECT radians(CAST(unnest(range(0, 361, 5)) AS DOUBLE)) AS phi), e AS (SELECT p_name, phi, sum(v * pow(radians(9.0) * pow(sin(pi() / 10.0 * i - (phi - 1.5) * 0.5), 2), 2)) AS e FROM w, f GROUP BY ALL)
SELECT n.p_name, round(coalesce(min(e), 0.0), 6) AS energy FROM n LEFT JOIN e USING (p_name) GROUP BY n.p_name""")
def bending_energy(spark, sf):
    names = read(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", r6(S.least_bending_energy(F.col("p_name"), tables.STIFFNESS)).alias("energy"))


# -- sources -----------------------------------------------------------------------------------------------------------

def event_piece() -> Column:
    """20 to 49 letters of the template, from a place that the user says."""
    return F.substring(F.lit(TEMPLATE), (F.col("user_id") % 150 + 1).cast("int"), (F.col("event_id") % 30 + 20).cast("int"))


def event_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Classified reads: an event is a read whose id says what its reference's variant is."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "M").when(e % 3 == 1, "I").otherwise("D")
    name = F.concat_ws("-", (F.col("user_id") % 225).cast("string"), kind, F.repeat(F.lit("A"), (e % 5 + 1).cast("int")))
    type_ = F.when(F.col("event_type") == "error", "mutant").when(F.col("event_type").isin("view", "click"), "valid").otherwise("unIden")
    cut = F.concat(F.when(e % 2 == 0, "L:").otherwise("R:"), ((e * 7) % 225).cast("string"))
    return read(spark, sf, "events").select(e.cast("string").alias("read_id"), type_.alias("type"), F.when(e % 11 == 0, "BACKBONE").otherwise(name).alias("mapped_id"), cut.alias("cut_loc"), event_piece().alias("read_seq"))


READS = f"""er AS (SELECT event_id AS e, user_id % 225 AS loc, CASE event_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'I' ELSE 'D' END AS k, CAST(event_id % 5 + 1 AS INT) AS n,
CASE WHEN event_type = 'error' THEN 'mutant' WHEN event_type IN ('view', 'click') THEN 'valid' ELSE 'unIden' END AS type, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, (event_id * 7) % 225 AS cut, substr('{TEMPLATE}', CAST(user_id % 150 + 1 AS INT), CAST(event_id % 30 + 20 AS INT)) AS piece FROM events WHERE event_id % 11 <> 0)"""


@query(f"WITH {READS} SELECT CAST(e AS VARCHAR) AS read_id, type, loc || '-' || k || '-' || repeat('A', n) AS mapped_id, side || ':' || cut AS cut_loc FROM er WHERE type <> 'unIden'")
def sorted_scan(spark, sf):
    path = passing_folder(spark, "sorted")
    T.write_sorted(event_reads(spark, sf), path)
    return T.sorted_reads(spark, path, ("valid", "mutant")).select("read_id", "type", "mapped_id", "cut_loc")


@query(f"""WITH {READS}, w AS (SELECT *, loc - CASE WHEN k = 'I' THEN 0 ELSE 1 END AS st, loc + CASE k WHEN 'M' THEN n WHEN 'I' THEN n + 1 ELSE 0 END AS ed FROM er WHERE type = 'valid'),
c AS (SELECT loc, k, n, side, cut - CASE WHEN side = 'L' AND k = 'I' THEN n ELSE 0 END AS cut, 225 - CASE WHEN k = 'D' THEN n ELSE 0 END AS tlen FROM w WHERE (side = 'R' AND cut < st) OR (side = 'L' AND cut > ed)),
d AS (SELECT *, cut + CASE WHEN side = 'R' THEN {OFFSET} ELSE -{OFFSET} END AS pos FROM c)
SELECT loc || '-' || k || '-' || repeat('A', n) AS id, CAST(pos AS INT) AS pos, CAST(count(*) AS DOUBLE) AS value FROM d WHERE pos >= 0 AND pos < tlen GROUP BY ALL""")
def variant_dyads(spark, sf):
    return R.dyad_histogram(R.cuts(event_reads(spark, sf)))


@query("""SELECT CAST(event_id AS VARCHAR) AS read_id, CAST(CASE WHEN event_type = 'error' THEN 4 ELSE 0 END AS INT) AS flag, CAST(event_id % 97 AS INT) AS pos, CAST(event_id % 6 AS INT) AS nm, event_type || ' of user' AS note,
CAST(event_id % 97 + 10 + event_id % 20 + 5 + 1 + event_id % 4 + 7 + event_id % 11 AS INT) AS aligned_end, CAST(event_id % 97 + 10 + event_id % 20 + 5 AS INT) AS gap FROM events""")
def sam_scan(spark, sf):
    e = F.col("event_id")
    cigar = F.concat((e % 20 + 10).cast("string"), F.lit("M"), (e % 3 + 1).cast("string"), F.lit("I5M"), (e % 4 + 1).cast("string"), F.lit("D"), (e % 11 + 7).cast("string"), F.lit("M"))
    size = (e % 20 + 10 + e % 3 + 1 + 5 + e % 11 + 7).cast("int")
    line = F.concat_ws("\t", e.cast("string"), F.when(F.col("event_type") == "error", "4").otherwise("0"), F.lit("ref"), (e % 97 + 1).cast("string"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), size), F.repeat(F.lit("G"), size),
                       F.concat(F.lit("NM:i:"), (e % 6).cast("string")), F.concat(F.lit("XS:Z:"), "event_type", F.lit(" of user")))
    path = passing_folder(spark, "sam")
    read(spark, sf, "events").select(line.alias("value")).write.text(path)
    rows = T.sam(spark, path).withColumn("ops", R.cigar_ops(F.col("cigar"), F.col("pos")))
    gap = F.element_at(F.filter("ops", lambda x: x["op"] == "D"), 1)["ref"]
    return rows.select("read_id", "flag", "pos", "nm", F.col("tags")["XS"].alias("note"), R.aligned_end(F.col("ops"), F.col("pos")).alias("aligned_end"), gap.alias("gap"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ref_id, upper(replace(p_name, ' ', '')) AS seq FROM part")
def fasta_scan(spark, sf):
    path = passing_folder(spark, "fasta")
    T.write_fasta(read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ref_id"), F.col("p_name").alias("seq")), path)
    return T.fasta(spark, path, upper=True)


@query(f"WITH {BRANDS} SELECT id, pos, value, CAST(50 AS INT) AS ref_length, CAST(3 AS INT) AS wst, CAST(9 AS INT) AS wed FROM bs")
def signal_file_scan(spark, sf):
    none, numbers = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    rows = G.to_arrays(brand_signal(spark, sf), ["id"]).select(
        "id", F.lit(50).alias("ref_length"), F.lit(53).alias("left_offset"), F.lit(53).alias("right_offset"), none.alias("seq"), *(numbers.alias(c) for c in ("mgw", "helt", "prot", "roll", "top", "bottom")),
        F.col("values").alias("dyad"), F.lit(3).alias("wst"), F.lit(9).alias("wed"), F.lit("linear").alias("method"),
    )
    path = passing_folder(spark, "signal")
    T.write_signal_file(rows, path)
    return T.signal_file(spark, path).select("id", "ref_length", "wst", "wed", F.posexplode("dyad").alias("pos", "value"))


# -- reads to signals --------------------------------------------------------------------------------------------------

@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def read_type_report(spark, sf):
    return R.type_report(read(spark, sf, "events"), "event_type").select("event_type", "n", r6("percent").alias("percent"))


@query(f"WITH {CUTS} SELECT id, side, cut AS pos, CAST(count(*) AS DOUBLE) AS value FROM cuts GROUP BY ALL")
def cut_histogram(spark, sf):
    return R.cut_histogram(event_cuts(spark, sf))


@query(f"WITH {CUTS} SELECT * FROM dy")
def dyad_map(spark, sf):
    return event_dyads(spark, sf)


@query(f"WITH {CUTS} SELECT * FROM dy QUALIFY sum(value) OVER (PARTITION BY id) > 60")
def dyad_filter(spark, sf):
    return R.enough(event_dyads(spark, sf), ["id"], 60)


@query(f"WITH {CUTS} SELECT * FROM dense")
def dense_signal(spark, sf):
    return event_signal(spark, sf)


@query(f"""WITH {CUTS}, c AS (SELECT id, side, cut, CAST(count(*) AS DOUBLE) AS n FROM cuts GROUP BY ALL), g AS (SELECT i.id, CAST(unnest(range(0, {LENGTH})) AS INT) AS pos FROM (SELECT DISTINCT id FROM cuts) i),
t AS (SELECT g.id, g.pos, coalesce(r.n, 0) AS top, coalesce(l.n, 0) AS bottom FROM g LEFT JOIN c r ON r.id = g.id AND r.cut = g.pos AND r.side = 'R' LEFT JOIN c l ON l.id = g.id AND l.cut = g.pos AND l.side = 'L'),
f AS (SELECT a.id, a.pos, CASE WHEN a.pos >= 110 THEN coalesce(b.bottom, 0) ELSE a.top END AS top, CASE WHEN a.pos <= 115 THEN coalesce(d.top, 0) ELSE a.bottom END AS bottom FROM t a
LEFT JOIN t b ON b.id = a.id AND b.pos = a.pos + {2 * OFFSET} LEFT JOIN t d ON d.id = a.id AND d.pos = a.pos - {2 * OFFSET})
SELECT f.id, f.pos, f.top, f.bottom, CASE WHEN f.pos >= {OFFSET} AND f.pos < {LENGTH - OFFSET} THEN x.top + y.bottom ELSE 0.0 END AS dyad FROM f LEFT JOIN f x ON x.id = f.id AND x.pos = f.pos - {OFFSET} LEFT JOIN f y ON y.id = f.id AND y.pos = f.pos + {OFFSET}""")
def naive_impute(spark, sf):
    return _cells(I.naive(strand_arrays(spark, sf)))


def strand_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """(id, top, bottom, wst, wed) with one window for all ids."""
    cuts = event_cuts(spark, sf)
    side = lambda s: F.sum(F.when(F.col("side") == s, 1.0).otherwise(0.0))
    cells = cuts.groupBy("id", "cut").agg(side("R").alias("top"), side("L").alias("bottom"))
    grid = cells.select("id").distinct().withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))))
    rows = grid.join(cells, ["id", "cut"], "left").fillna(0.0).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("cut", "top", "bottom"))).alias("a"))
    return rows.select("id", F.lit(110).alias("wst"), F.lit(115).alias("wed"), F.transform("a", lambda x: x["top"]).alias("top"), F.transform("a", lambda x: x["bottom"]).alias("bottom"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode(F.arrays_zip("top", "bottom", "dyad")).alias("pos", "x")).select("id", "pos", "x.top", "x.bottom", "x.dyad")


@query()
def linear_impute(spark, sf):
    return _cells(I.linear(strand_arrays(spark, sf).withColumn("g", F.pmod("id", F.lit(3))), ["g"]))


@query()
def bayes_impute(spark, sf):
    return _cells(B.bayesian(strand_arrays(spark, sf).withColumn("g", F.pmod("id", F.lit(16))), ["g"], OFFSET))


@query("SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY user_id")
def valid_fraction(spark, sf):
    return R.valid_fraction(read(spark, sf, "events"), "user_id", F.col("event_type") != "error").select("user_id", r6("share").alias("share"))


@query("SELECT user_id, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY user_id")
def abundance_share(spark, sf):
    return R.abundance(read(spark, sf, "events"), "user_id").select("user_id", F.round("share", 9).alias("share"))


# -- signals -----------------------------------------------------------------------------------------------------------

@query(f"""WITH {CUTS}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM dense WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, pos, value, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos DESC) AS rank FROM l WHERE value > a AND value > b) SELECT id, pos, value, CAST(rank AS INT) AS rank FROM r WHERE rank = 1""")
def top_peaks(spark, sf):
    return G.peaks(event_signal(spark, sf), ["id"], 1)


@query(f"""WITH {CUTS}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM dense WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, pos, value, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos DESC) AS k FROM l WHERE value > a AND value > b),
h AS (SELECT id, pos + d AS pos, sum(value) AS v FROM r, (SELECT unnest([-1, 0, 1]) AS d) WHERE k <= 15 GROUP BY ALL)
SELECT d.id, d.pos, coalesce(h.v, 0.0) AS value FROM dense d LEFT JOIN h ON h.id = d.id AND h.pos = d.pos""")
def highlight_peaks(spark, sf):
    return G.highlight_peaks(event_signal(spark, sf), ["id"])


@query(f"""WITH {BRANDS}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM bs WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, pos, value, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos DESC) AS k FROM l WHERE value > a AND value > b)
SELECT a.id, round(b.value / a.value, 6) AS ratio, abs(b.pos - a.pos) AS distance FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2""")
def peak_ratio(spark, sf):
    return G.peak_ratio(brand_signal(spark, sf), ["id"]).select("id", r6("ratio").alias("ratio"), "distance")


@query(f"WITH {MONTHS} SELECT id, pos, round(value / sum(value) OVER (PARTITION BY id), 6) AS value FROM cs")
def pmf(spark, sf):
    return G.normalise(customer_signal(spark, sf), ["id"]).withColumn("value", r6("value"))


@query(f"WITH {BRANDS} SELECT id, pos, round(greatest(value - (min(value) OVER w + 0.1 * (max(value) OVER w - min(value) OVER w)), 0.0), 6) AS value FROM bs WINDOW w AS (PARTITION BY id)")
def background_subtract(spark, sf):
    return G.subtract_background(brand_signal(spark, sf), ["id"]).withColumn("value", r6("value"))


@query("""WITH s AS (SELECT o_custkey AS id, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS b, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS a FROM orders GROUP BY 1)
SELECT id, round(log2((a + 1.0) / (b + 1.0)), 6) AS fold FROM s""")
def fold_change_log2(spark, sf):
    late = F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    rows = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(~late).alias("b"), F.count_if(late).alias("a"))
    return rows.select("id", r6(S.log2_fold(F.col("a"), F.col("b"))).alias("fold"))


KDE = f"""{BRANDS}, kd AS (SELECT g.id, g.pos, sum(s.value * exp(-pow(s.pos - g.pos, 2) / 2)) / sum(s.value) / sqrt(2 * pi()) AS d FROM bs g JOIN bs s ON s.id = g.id GROUP BY g.id, g.pos)"""


@query(f"WITH {KDE} SELECT id, round(-sum(d * ln(d)), 6) AS entropy FROM kd GROUP BY id")
def kde_entropy(spark, sf):
    return G.entropy(brand_signal(spark, sf), ["id"]).select("id", r6("entropy").alias("entropy"))


@query(f"WITH {KDE} SELECT id, pos, round(-ln(d), 6) AS energy FROM kd")
def energy_profile(spark, sf):
    return G.energy(brand_signal(spark, sf), ["id"]).select("id", "pos", r6("energy").alias("energy"))


@query(f"WITH {KDE}, f AS (SELECT id, pos, ln(lead(d) OVER (PARTITION BY id ORDER BY pos)) - ln(d) AS f FROM kd) SELECT id, pos, round(f, 6) + 0.0 AS force FROM f WHERE f IS NOT NULL")
def force_profile(spark, sf):
    return G.force(G.energy(brand_signal(spark, sf), ["id"]), ["id"]).select("id", "pos", r6("force").alias("force"))


@query(f"""WITH {BRANDS}, x AS (SELECT id, pos, unnest(range(0, CAST(value AS BIGINT))) FROM bs WHERE value >= 1), m AS (SELECT id, median(pos) AS median_pos FROM x GROUP BY id)
SELECT bs.id, sum(value) AS total, round(sum(pos * value) / sum(value), 6) AS mean_pos, median_pos FROM bs JOIN m USING (id) GROUP BY bs.id, median_pos""")
def mean_median_pos(spark, sf):
    return G.location(brand_signal(spark, sf), ["id"]).select("id", "total", r6("mean_pos").alias("mean_pos"), "median_pos")


@query(f"WITH {BRANDS} SELECT id, round(sum(value) FILTER (pos BETWEEN 10 AND 19) / sum(value), 6) AS share FROM bs GROUP BY id")
def bin_share(spark, sf):
    return G.share_of_bin(brand_signal(spark, sf), ["id"], 10, 19).select("id", r6("share").alias("share"))


@query(f"""WITH {BRANDS}, m AS (SELECT id, max(pos) FILTER (value > 0) AS mp, sum(value) FILTER (pos BETWEEN 5 AND 14) / sum(value) AS p FROM bs GROUP BY id), r AS (SELECT min(p) FILTER (id = 'Brand#11') AS p FROM m)
SELECT id, round(1 - m.p / r.p, 6) + 0.0 AS depletion FROM m, r""")
def depletion(spark, sf):
    shares = G.share_of_bin(brand_signal(spark, sf), ["id"], 5, 14)
    control = shares.where("id = 'Brand#11'").select(F.col("share").alias("c"))  # one row: the control
    return shares.crossJoin(F.broadcast(control.limit(1))).select("id", r6(1 - F.col("share") / F.col("c")).alias("depletion"))


@query(f"WITH {CUTS} SELECT id, pos, sum(value) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 146 PRECEDING AND CURRENT ROW) AS value FROM dense")
def occupancy_sum(spark, sf):
    return G.occupancy(event_signal(spark, sf), ["id"])


@query(f"""WITH {BRANDS}, c AS (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS d FROM bs), v AS (SELECT id, avg(d * d) AS v FROM c GROUP BY id),
l AS (SELECT a.id, b.pos - a.pos AS lag, avg(a.d * b.d) AS p FROM c a JOIN c b ON a.id = b.id AND b.pos - a.pos BETWEEN 0 AND 20 GROUP BY ALL) SELECT l.id, CAST(lag AS INT) AS lag, round(p / v, 6) + 0.0 AS acf FROM l JOIN v USING (id)""")
def autocorr_lag(spark, sf):
    return G.autocorrelation(brand_signal(spark, sf), ["id"], 20).select("id", "lag", r6("acf").alias("acf"))


@query(f"""WITH {BRANDS}, {MONTHS.replace('co AS', 'co2 AS').replace('co.', 'co2.').replace('FROM co)', 'FROM co2)').replace('JOIN co ', 'JOIN co2 ')}, d AS (SELECT a.id, a.pos, a.value AS a, b.value AS b FROM bs a JOIN (SELECT pos, avg(value) AS value FROM cs GROUP BY pos) b USING (pos)),
x AS (SELECT p.id, q.pos - p.pos AS lag, corr(p.a, q.b) AS c FROM d p JOIN d q ON p.id = q.id AND q.pos - p.pos BETWEEN 0 AND 5 GROUP BY ALL) SELECT id, CAST(lag AS INT) AS lag, round(c, 6) + 0.0 AS correlation FROM x""")
def cross_correlation(spark, sf):
    mean = G.elementwise(customer_signal(spark, sf)).withColumnRenamed("value", "b")
    both = brand_signal(spark, sf).withColumnRenamed("value", "a").join(F.broadcast(mean), "pos")
    return G.cross_correlation(both, ["id"], 5).select("id", "lag", r6("correlation").alias("correlation"))


@query(f"""WITH {BRANDS}, k AS (SELECT CAST(unnest(range(1, 25)) AS INT) AS k), t AS (SELECT id, k, sum(value * cos(2 * pi() * k * pos / 50)) AS re, -sum(value * sin(2 * pi() * k * pos / 50)) AS im FROM bs, k GROUP BY ALL)
SELECT id, k, round(50.0 / k, 6) AS period, round(sqrt(re * re + im * im) / 50, 6) AS amplitude FROM t""")
def periodogram(spark, sf):
    return G.periodogram(brand_signal(spark, sf), ["id"]).select("id", "k", r6("period").alias("period"), r6("amplitude").alias("amplitude"))


@query(f"""WITH {BRANDS}, p AS (SELECT unnest([2.0::DOUBLE, 5.0, 10.0, 20.0, 40.0]) AS period), y AS (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS y FROM bs),
t AS (SELECT id, period, atan2(sum(sin(4 * pi() / period * pos)), sum(cos(4 * pi() / period * pos))) / (4 * pi() / period) AS tau FROM y, p GROUP BY id, period),
z AS (SELECT y.id, t.period, y.y, 2 * pi() / period * (pos - tau) AS a FROM y JOIN t USING (id))
SELECT id, period, round((pow(sum(y * cos(a)), 2) / sum(pow(cos(a), 2)) + pow(sum(y * sin(a)), 2) / sum(pow(sin(a), 2))) / sum(y * y), 6) AS power FROM z WHERE period > 2 GROUP BY id, period""")
def lomb_scargle(spark, sf):
    return G.lomb_scargle(brand_signal(spark, sf), ["id"], [5.0, 10.0, 20.0, 40.0]).select("id", "period", r6("power").alias("power"))


@query("""WITH p AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part), m AS (SELECT p_partkey, substr(p_name, i, 2) AS step, i FROM p)
SELECT a.step, CAST(b.i - a.i AS INT) AS lag, count(*) AS n FROM m a JOIN m b ON a.p_partkey = b.p_partkey AND a.step = b.step AND b.i - a.i BETWEEN 1 AND 12 GROUP BY ALL""")
def pair_distances(spark, sf):
    marks = S.explode_pieces(read(spark, sf, "part"), ["p_partkey"], "p_name", 2).withColumnRenamed("kmer", "step")
    return G.pair_distances(marks, ["p_partkey"], "step", 12)


@query(f"WITH {MONTHS} SELECT pos, median(value) AS med, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM cs GROUP BY pos")
def elementwise_reps(spark, sf):
    return customer_signal(spark, sf).groupBy("pos").agg(F.median("value").alias("med"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"))


@query(f"WITH {MONTHS} SELECT pos, round(var_pop(value), 6) AS variance FROM cs GROUP BY pos ORDER BY var_pop(value) DESC, pos LIMIT 10")
def variance_topk(spark, sf):
    return G.most_dynamic(customer_signal(spark, sf), 10).select("pos", r6("variance").alias("variance"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events")
def running_mean(spark, sf):
    return G.running_mean(read(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "user_id", F.round("running", 9).alias("running"))


@query("""WITH d AS (SELECT user_id, value, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, value) - ts) AS d FROM events)
SELECT user_id, round(sum(value * d) / sum(d), 4) AS time_average FROM d WHERE d IS NOT NULL GROUP BY user_id HAVING sum(d) > 0""")
def time_weighted_avg(spark, sf):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    found = G.time_average(read(spark, sf, "events").select("user_id", micros.alias("t"), "value"), ["user_id"], "t", "value")
    return found.where("time_average IS NOT NULL").select("user_id", F.round("time_average", 4).alias("time_average"))


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20 AS w FROM customer)
SELECT round(lo + (floor((c_acctbal - lo) / w) + 0.5) * w, 6) AS center, count(*) AS count FROM customer, e GROUP BY 1""")
def histogram(spark, sf):
    return G.histogram(read(spark, sf, "customer"), "c_acctbal", 20).groupBy(r6("center").alias("center")).agg(F.sum("count").alias("count"))


@query("SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY ALL")
def pearson_by_group(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {BRANDS} SELECT id, pos, round(pow(value, 0.5) / sum(pow(value, 0.5)) OVER (PARTITION BY id), 6) AS value FROM bs")
def power_rescale(spark, sf):
    return G.power_rescale(brand_signal(spark, sf), ["id"], 0.5).withColumn("value", r6("value"))


# -- divergences and pairs ---------------------------------------------------------------------------------------------

@query(f"""WITH {NATIONS}, m AS (SELECT a.id AS id1, b.id AS id2, a.p, b.p AS q FROM nm a JOIN nm b ON a.pos = b.pos AND a.id < b.id)
SELECT id1, id2, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) + 0.0 AS kl,
round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) + 0.0 AS js FROM m GROUP BY ALL""")
def kl_js_pairs(spark, sf):
    return D.pair_divergences(region_masses(spark, sf), "id", "values").select("id1", "id2", r6("kl").alias("kl"), r6("js").alias("js"))


@query(f"""WITH {NATIONS}, m AS (SELECT a.id AS id1, b.id AS id2, a.p, b.p AS q FROM nm a JOIN nm b ON a.pos = b.pos),
s AS (SELECT n1.n_regionkey AS set1, n2.n_regionkey AS set2, exp(-10 * sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)) AS s
FROM m JOIN nation n1 ON n1.n_nationkey = id1 JOIN nation n2 ON n2.n_nationkey = id2 WHERE n1.n_regionkey <= n2.n_regionkey GROUP BY set1, set2, id1, id2) SELECT set1, set2, round(avg(s), 6) AS similarity FROM s GROUP BY ALL""")
def reproducibility_matrix(spark, sf):
    rows = region_masses(spark, sf).join(read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey"), "id")
    return D.reproducibility(rows, "n_regionkey", "id", "values").select("set1", "set2", r6("similarity").alias("similarity"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),
p AS (SELECT a.vec_id AS i, a.label AS own, b.label AS other, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT i, own, other, avg(d) AS m FROM p GROUP BY ALL), s AS (SELECT i, own, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM m GROUP BY ALL)
SELECT i AS vec_id, own AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) + 0.0 AS silhouette FROM s""")
def silhouette(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return D.silhouette(rows, "vec_id", "v", "label").select("vec_id", "label", (F.round("silhouette", 5) + 0.0).alias("silhouette"))


@query("""WITH e AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
SELECT a.id AS id1, b.id AS id2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM e a JOIN e b ON a.id < b.id""")
def allpairs_similarity(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("v"))
    return J.all_pairs_by_value(rows, "id", "v", J.euclidean(F.col("x"), F.col("y"), 2)).select("id1", "id2", F.round("score", 4).alias("distance"))


# -- joins -------------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, l_partkey, l_linenumber, CAST(epoch(l_shipdate - o_orderdate) AS BIGINT) AS gap FROM orders JOIN lineitem ON l_orderkey = o_orderkey
AND l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY""")
def interval_join(spark, sf):
    spans = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), seconds("o_orderdate").alias("lo"), (seconds("o_orderdate") + 30 * 86400).alias("hi"))
    points = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber", seconds("l_shipdate").alias("p"))
    return J.interval_join(points, spans, "p", "lo", "hi", 30 * 86400, ["k"]).select(F.col("k").alias("o_orderkey"), "l_partkey", "l_linenumber", (F.col("p") - F.col("lo")).alias("gap"))


@query("""SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal - 100 AND c.c_acctbal < s.s_acctbal + 100""")
def range_join(spark, sf):
    points = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_acctbal")
    spans = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), (F.col("s_acctbal") - 100).alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))
    return J.interval_join(points, spans, "c_acctbal", "lo", "hi", 200.0, ["n"]).select("c_custkey", "s_suppkey")


@query("""WITH a AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS t FROM events WHERE event_type = 'error')
SELECT a.t // 3600 - b.t AS offset, count(*) AS n FROM a JOIN b USING (user_id) WHERE a.t // 3600 BETWEEN b.t - 12 AND b.t + 12 GROUP BY 1""")
def window_profile(spark, sf):
    hours = F.floor(seconds("ts") / 3600)
    rows = read(spark, sf, "events").select("user_id", "event_type", hours.alias("h"))
    return J.window_profile(rows.where("event_type = 'purchase'").select("user_id", F.col("h").alias("p")), rows.where("event_type = 'error'").select("user_id", F.col("h").alias("c")), "p", "c", 12, ["user_id"])


@query("""WITH p AS (SELECT p_brand, unnest(range(p_size, p_size + 5)) AS pos, p_retailprice AS v FROM part) SELECT p_brand, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value, count(*) AS n FROM p GROUP BY ALL""")
def interval_explode_mean(spark, sf):
    spans = read(spark, sf, "part").select("p_brand", "p_size", (F.col("p_size") + 5).alias("e"), F.col("p_retailprice").alias("v"))
    return J.interval_mean(spans, "p_size", "e", "v", ["p_brand"]).select("p_brand", "pos", r6("value").alias("value"), "n")


@query("""WITH p AS (SELECT p_brand, unnest(range(p_size, p_size + 5)) AS pos, p_retailprice AS v FROM part)
SELECT p_brand, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value, count(*) AS n FROM p GROUP BY GROUPING SETS ((pos, p_brand), (pos))""")
def interval_mean_rollup(spark, sf):
    spans = read(spark, sf, "part").select("p_brand", "p_size", (F.col("p_size") + 5).alias("e"), F.col("p_retailprice").alias("v"))
    return J.interval_mean_rollup(spans, "p_size", "e", "v", "p_brand").select("p_brand", "pos", r6("value").alias("value"), "n")


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.event_id AS next_event_id FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts""")
def asof_next(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    left = rows.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = rows.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return J.asof_next(left, right, ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "next_event_id")


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, p.event_id AS last_event_id FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return J.asof_last(rows.where("event_type = 'error'").select("user_id", "event_id", "ts"), rows.where("event_type = 'view'").select("user_id", "event_id", "ts"), ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "last_event_id")


@query("""SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS inside, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS outside FROM customer""")
def semi_anti_counts(spark, sf):
    busy = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.membership(read(spark, sf, "customer").select("c_custkey"), busy, ["c_custkey"])


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def key_intersect(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return rows.where("o_orderstatus = 'P'").select("k").intersect(rows.where("o_orderstatus = 'O'").select("k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_except(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part WHERE length(p_name) // 2 >= 3)
SELECT a.n AS n1, b.n AS n2 FROM n a JOIN n b ON substr(a.n, length(a.n) // 2 - 2, 3) = substr(b.n, length(b.n) // 2 - 2, 3)""")
def substring_join(spark, sf):
    names = read(spark, sf, "part").select("p_name").where(F.floor(F.length("p_name") / 2) >= 3).distinct()
    return J.by_centre(names.select(F.col("p_name").alias("n1")), names.select(F.col("p_name").alias("n2")), "n1", "n2", 3, "left").select("n1", "n2")


@query("""WITH q AS (SELECT item_id, text AS q FROM benchmark WHERE length(text) >= 12), h AS (SELECT item_id, doc_id, q, string_split(text, q) AS parts FROM documents JOIN q ON contains(text, q)),
o AS (SELECT item_id, doc_id, q, parts, unnest(range(1, len(parts))) AS i FROM h) SELECT item_id, doc_id, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(q) AS INT) AS pos FROM o""")
def containment(spark, sf):
    queries = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    return J.containment(queries, spread(read(spark, sf, "documents").select("doc_id", "text")), "item_id", "q", "doc_id", "text", 12, unique=False)


@query("""SELECT c.c_custkey, n.n_name, s.s FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) s ON s.o_custkey = c.c_custkey""")
def annotate_left(spark, sf):
    spent = read(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(names, "c_nationkey", "left").join(spent, "c_custkey", "left").select("c_custkey", "n_name", "s")


@query(f"WITH {BRANDS}, c AS (SELECT pos, value AS c FROM bs WHERE id = 'Brand#11') SELECT id, pos, round(log2((value + 1) / (c + 1)), 6) + 0.0 AS fold FROM bs JOIN c USING (pos)")
def against_control(spark, sf):
    signal = brand_signal(spark, sf)
    control = signal.where("id = 'Brand#11'").select("pos", F.col("value").alias("c"))  # one id: 50 rows
    return signal.join(F.broadcast(control), "pos").select("id", "pos", r6(S.log2_fold(F.col("value"), F.col("c"))).alias("fold"))


# -- choosing ids ------------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS INT) AS grp FROM customer")
def quantile_groups(spark, sf):
    return P.quantile_groups(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5).select("c_custkey", "grp")


@query("""WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), s AS (SELECT *, greatest(n // 4, 20) AS s FROM r), m AS (SELECT *, CAST(ceil(n / s) AS BIGINT) AS m FROM s),
w AS (SELECT *, i // s AS block, (s - 20 + 1) // m AS w FROM m) SELECT block, c_custkey, c_acctbal FROM w WHERE i >= block * s + block * w AND i < block * s + block * w + 20""")
def quantile_blocks(spark, sf):
    return P.quantile_blocks(read(spark, sf, "customer"), "c_custkey", "c_acctbal", 4, 20)


@query("SELECT p_partkey FROM part WHERE p_size = 1 OR p_size BETWEEN 5 AND 8 OR p_size >= 45")
def value_range_pick(spark, sf):
    return P.sample(read(spark, sf, "part"), "p_partkey", "size_of:1,5,..,8,45,..", {"size_of": "p_size"}).select("p_partkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk(spark, sf):
    return P.top(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, "c_custkey")


@query("""SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS INT) AS place FROM part""")
def multi_key_order(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size", F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


@query("SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, sf):
    return P.sample(read(spark, sf, "customer"), "c_custkey", "r:100", seed=7).select("c_custkey")


@query("SELECT p_brand AS cluster, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('3:' || p_partkey), p_partkey) <= 5")
def cluster_sample(spark, sf):
    return P.sample(read(spark, sf, "part"), "p_partkey", "cluster:brand/5", {"brand": "p_brand"}, 3).select("cluster", "p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_3', 'NATION_17')")
def picked_ids(spark, sf):
    return P.sample(read(spark, sf, "nation"), "n_name", "k:nation_3, Nation_17, nowhere").select("n_nationkey", "n_name")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY substr(md5('1:' || c_custkey), 1, 13), c_custkey) - 1) % 10 AS INT) AS fold FROM customer")
def even_folds(spark, sf):
    return P.folds(read(spark, sf, "customer").select("c_custkey"), "c_custkey", 10, 1)


# -- models ------------------------------------------------------------------------------------------------------------

@query("""WITH l AS (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part), c AS (SELECT 1 AS ord, CAST(i - 1 AS INT) AS pos, substr(p_name, i - 1, 1) AS prev, substr(p_name, i, 1) AS cur FROM l WHERE i > 1
UNION ALL SELECT 0, CAST(i - 1 AS INT), '', substr(p_name, i, 1) FROM l) SELECT ord, pos, prev, cur, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER (PARTITION BY ord, pos, prev)), 6) + 0.0 AS logp FROM c GROUP BY ord, pos, prev, cur""")
def markov_table(spark, sf):
    from ..models import markov

    return markov.table(read(spark, sf, "part"), "p_partkey", "p_name", 1).withColumn("logp", r6("logp"))


@query("""WITH l AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part), c AS (SELECT p_partkey, i, CASE WHEN i > 1 THEN substr(p_name, i - 1, 1) ELSE '' END AS prev, substr(p_name, i, 1) AS cur FROM l),
t AS (SELECT i, prev, cur, ln(count(*) / sum(count(*)) OVER (PARTITION BY i, prev)) AS p FROM c GROUP BY i, prev, cur) SELECT p_partkey, round(sum(p), 5) + 0.0 AS score FROM c JOIN t USING (i, prev, cur) GROUP BY p_partkey""")
def markov_score(spark, sf):
    from ..models import markov

    part = read(spark, sf, "part")
    model = markov.table(part, "p_partkey", "p_name", 1)
    return markov.score(part, "p_partkey", "p_name", model, 1).select("p_partkey", (F.round("score", 5) + 0.0).alias("score"))


@query()
def markov_placement(spark, sf):
    from ..models import markov

    scores = event_signal(spark, sf).where(F.col("pos") <= LENGTH - 147).select("id", F.col("pos").alias("start"), F.log(F.col("value") + 1).alias("score"))
    return markov.placement(scores, ["id"], 147)


@query()
def ridge_cv(spark, sf):
    from ..models import regression

    part = read(spark, sf, "part")
    cols = regression.tract_columns(F.upper("p_name"), "AT", 1) | regression.kmer_columns(F.upper("p_name"), ["A", "C", "G", "T"], 1, 40)
    rows = P.folds(part.select("p_partkey", "p_retailprice", *(c.alias(n) for n, c in cols.items())), "p_partkey", 3)
    return regression.cross_validated(rows, list(cols), "p_retailprice", "fold", 3)


@query()
def curve_fit(spark, sf):
    from ..models import regression

    rows = customer_signal(spark, sf).groupBy((F.col("id") % 20).alias("g"), F.col("pos").alias("t")).agg(F.sum("value").alias("v"))
    return regression.curve_fits(rows, "g", "t", "v", "decay", 0.0)


@query()
def pca(spark, sf):
    from ..models import matrices

    return matrices.pca(G.to_arrays(brand_signal(spark, sf), ["id"]), "id", "values")[0]


@query()
def kmeans(spark, sf):
    from ..models import matrices

    return matrices.kmeans(read(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@query()
def nmf(spark, sf):
    from ..models import matrices

    return matrices.nmf(G.to_arrays(brand_signal(spark, sf), ["id"]), "id", "values", 3)[0]


def nation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.pair_divergences(region_masses(spark, sf), "id", "values")


@query()
def spectral(spark, sf):
    from ..models import matrices

    pairs = nation_pairs(spark, sf).withColumn("score", J.similarity(F.col("js")))
    return matrices.spectral_clusters(pairs, 3)


@query()
def power_iteration(spark, sf):
    from ..models import matrices

    return matrices.power_clusters(nation_pairs(spark, sf).select(F.col("id1").cast("long"), F.col("id2").cast("long"), J.similarity(F.col("js")).alias("score")), 3)


@query()
def linkage(spark, sf):
    from ..models import matrices

    return spark.createDataFrame(matrices.average_linkage(nation_pairs(spark, sf), "js", 0.01)[0])


@query()
def diffusion_map(spark, sf):
    from ..models import matrices

    return matrices.diffusion_coordinates(nation_pairs(spark, sf), "js", 0.1)


@query()
def tsne(spark, sf):
    from ..models import matrices

    return spark.createDataFrame(matrices.tsne(nation_pairs(spark, sf), "js"))


@query()
def max_caliber(spark, sf):
    from ..models import simulate

    return simulate.maximum_caliber(G.to_arrays(brand_signal(spark, sf), ["id"]), "id", "values", target=2.0, reach=5)


# -- sequences under weights -------------------------------------------------------------------------------------------


def brand_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(id, n, seq): 50 letters of the template for each brand, from the place of its number."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("id"), number.alias("n")).distinct()
    return rows.withColumn("seq", F.substring(F.lit(TEMPLATE), F.col("n") + 1, F.lit(50)))


NUMBERED = f"""bq AS (SELECT id, n, substr('{TEMPLATE}', n + 1, 50) AS seq FROM (SELECT DISTINCT p_brand AS id, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS n FROM part))"""


@query("""WITH b AS (SELECT upper(p_name) AS s, p_size AS w FROM part UNION ALL SELECT reverse(translate(upper(p_name), 'ACGT', 'TGCA')), p_size FROM part), p AS (SELECT s, w, unnest(range(1, length(s))) AS i FROM b),
c AS (SELECT i - 1 AS pos, substr(s, i, 2) AS kmer, sum(w) AS b, count(*) AS e FROM p GROUP BY ALL), f AS (SELECT pos, kmer, b / sum(b) OVER (PARTITION BY pos) AS b, e / sum(e) OVER (PARTITION BY pos) AS e FROM c)
SELECT CAST(pos AS INT) AS pos, kmer, round(b, 6) AS weighted, round(e, 6) AS even, round(b / e, 6) AS fold FROM f""")
def bias_report(spark, sf):
    from ..models import frequencies

    found = frequencies.bias_report(read(spark, sf, "part"), "p_name", "p_size", 2)
    return found.select("pos", "kmer", *(r6(c).alias(c) for c in ("weighted", "even", "fold")))


@query("""WITH g AS (SELECT p_name, CAST(ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS INT) AS grp FROM part), b AS (SELECT upper(p_name) AS s, grp FROM g UNION ALL SELECT reverse(translate(upper(p_name), 'ACGT', 'TGCA')), grp FROM g),
p AS (SELECT s, grp, unnest(range(1, length(s) - 1)) AS i FROM b), c AS (SELECT grp, substr(s, i, 3) AS kmer, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT kmer, sum(n) / (SELECT sum(n) FROM c) AS f FROM c GROUP BY kmer),
o AS (SELECT grp, kmer, n / sum(n) OVER (PARTITION BY grp) AS f FROM c) SELECT grp, kmer, round(o.f / a.f, 6) AS fold FROM o JOIN a USING (kmer)""")
def quantile_spectrum(spark, sf):
    from ..models import frequencies

    return frequencies.spectrum(read(spark, sf, "part"), "p_partkey", "p_name", "p_retailprice", 4, 3).withColumn("fold", r6("fold"))


def shifted_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(id, seq): the template for each id that is cut, begun at the place of its id."""
    ids = event_cuts(spark, sf).select("id").distinct()
    at = F.pmod("id", F.lit(LENGTH)).cast("int")
    return ids.withColumn("seq", F.concat(F.substring(F.lit(TEMPLATE), at + 1, F.lit(LENGTH)), F.substring(F.lit(TEMPLATE), F.lit(1), at)))


FOLDS = f"""{CUTS}, sq AS (SELECT id, substr('{TEMPLATE}', CAST(id % {LENGTH} AS INT) + 1, {LENGTH}) || substr('{TEMPLATE}', 1, CAST(id % {LENGTH} AS INT)) AS seq FROM (SELECT DISTINCT id FROM cuts)),
pc AS (SELECT CASE WHEN side = 'R' THEN substr(seq, cut, 3) ELSE reverse(translate(substr(seq, cut, 3), 'ACGT', 'TGCA')) END AS kmer FROM cuts JOIN sq USING (id) WHERE cut BETWEEN 1 AND {LENGTH - 2}),
bg AS (SELECT substr(s, i, 3) AS kmer FROM (SELECT s, unnest(range(1, {LENGTH - 1})) AS i FROM (SELECT seq AS s FROM sq UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM sq))),
fo AS (SELECT kmer, a.n / b.n AS fold FROM (SELECT kmer, count(*) / sum(count(*)) OVER () AS n FROM pc GROUP BY kmer) a JOIN (SELECT kmer, count(*) / sum(count(*)) OVER () AS n FROM bg GROUP BY kmer) b USING (kmer))"""


@query(f"WITH {FOLDS} SELECT kmer, round(fold, 6) AS fold FROM fo")
def cut_kmer_folds(spark, sf):
    from ..models import frequencies

    return frequencies.cut_folds(event_cuts(spark, sf), shifted_sequences(spark, sf), "id", 3).withColumn("fold", r6("fold"))


@query(f"""WITH {FOLDS}, cn AS (SELECT id, side, cut, count(*) AS n FROM cuts GROUP BY ALL),
x AS (SELECT c.id, cut + CASE WHEN side = 'R' THEN {OFFSET} ELSE -{OFFSET} END AS pos, n, CASE WHEN side = 'R' THEN substr(seq, cut, 3) ELSE reverse(translate(substr(seq, cut, 3), 'ACGT', 'TGCA')) END AS kmer FROM cn c JOIN sq USING (id)),
y AS (SELECT id, pos, sum(n / fold) AS v FROM x JOIN fo USING (kmer) WHERE pos BETWEEN {OFFSET + 1} AND {LENGTH - OFFSET - 2} GROUP BY ALL),
z AS (SELECT sq.id, g.pos, coalesce(v, 0.0) AS v FROM sq CROSS JOIN (SELECT CAST(unnest(range({OFFSET + 1}, {LENGTH - OFFSET - 1})) AS INT) AS pos) g LEFT JOIN y ON y.id = sq.id AND y.pos = g.pos)
SELECT id, pos, round(CASE WHEN sum(v) OVER (PARTITION BY id) > 0 THEN v / sum(v) OVER (PARTITION BY id) ELSE v END, 6) AS value FROM z""")
def cut_correction(spark, sf):
    from ..models import frequencies

    seqs = shifted_sequences(spark, sf)
    folds = frequencies.cut_folds(event_cuts(spark, sf), seqs, "id", 3)
    return frequencies.corrected(strand_arrays(spark, sf).join(seqs, "id"), folds, "id", OFFSET, 3).withColumn("value", r6("value"))


@query(f"""WITH {BRANDS}, {NUMBERED}, w AS (SELECT bs.id, value / sum(value) OVER (PARTITION BY bs.id) AS v, length(regexp_replace(substr(seq, pos - 9, 21), '[^GC]', '', 'g')) * 100.0 / 21 AS g, pos, length(seq) AS n FROM bs JOIN bq USING (id))
SELECT id, round(sum(v * g), 6) AS gc FROM w WHERE pos BETWEEN 10 AND n - 11 GROUP BY id""")
def weighted_gc(spark, sf):
    from ..models import frequencies

    return frequencies.weighted_gc(brand_signal(spark, sf), brand_sequences(spark, sf), "id", "seq", 21).withColumn("gc", r6("gc"))


DEPLETED = f"""{BRANDS}, {NUMBERED}, ms AS (SELECT id, pos, value / sum(value) OVER (PARTITION BY id) AS v FROM bs),
dp AS (SELECT q.id, n % 5 + 1 AS size, sum(a.v) AS v, sum(c.v) AS c FROM bq q JOIN ms a ON a.id = q.id AND a.pos BETWEEN n % 40 AND n % 40 + n % 5 JOIN ms c ON c.id = 'Brand#11' AND c.pos = a.pos GROUP BY ALL)"""


@query(f"WITH {DEPLETED} SELECT CAST(size AS INT) AS size, count(CASE WHEN c > 0 THEN 1 END) AS n, round(avg(CASE WHEN c > 0 THEN 1 - v / c END), 6) + 0.0 AS mean, round(stddev_pop(CASE WHEN c > 0 THEN 1 - v / c END), 6) + 0.0 AS sd FROM dp GROUP BY size")
def depletion_by_size(spark, sf):
    windows = brand_sequences(spark, sf).select("id", (F.col("n") % 40).alias("loc"), (F.col("n") % 5 + 1).alias("size"))
    found = G.spread_by(G.depletion(brand_signal(spark, sf), windows, "id", "Brand#11"), "size", "depletion")
    return found.select("size", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("""WITH l AS (SELECT DISTINCT upper(p_name) AS seq FROM part UNION SELECT reverse(translate(upper(p_name), 'ACGT', 'TGCA')) FROM part)
SELECT min(seq) AS ref_id, min(seq) AS seq FROM l GROUP BY least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))""")
def reduced_library(spark, sf):
    from ..models import simulate

    names = read(spark, sf, "part").select(F.upper("p_name").alias("seq"))
    both = names.union(names.select(S.reverse_complement(F.col("seq")))).distinct()
    return simulate.reduced_library(both.withColumn("ref_id", F.col("seq"))).select("ref_id", "seq")


@query("""WITH s AS (SELECT p_partkey, p_name AS seq, p_retailprice AS score, p_size AS snr FROM part ORDER BY score DESC, snr DESC, seq LIMIT 600)
SELECT p_partkey, 'AC' || seq || 'GT' AS seq FROM s WHERE seq IN (SELECT p_name FROM part WHERE p_size > 30) ORDER BY score DESC, snr DESC, s.seq LIMIT 500""")
def chosen_library(spark, sf):
    from ..models import simulate

    part = read(spark, sf, "part")
    sites = part.select("p_partkey", F.col("p_name").alias("seq"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("snr"))
    return simulate.chosen_library(sites, part.where("p_size > 30").select(F.col("p_name").alias("seq")), left="AC", right="GT").select("p_partkey", "seq")


@query("SELECT p_partkey, round(length(regexp_replace(right(upper(p_name), length(p_name) // 2), '[^GC]', '', 'g')) * 100.0 / (length(p_name) // 2) - length(regexp_replace(left(upper(p_name), length(p_name) // 2), '[^GC]', '', 'g')) * 100.0 / (length(p_name) // 2), 6) + 0.0 AS gap FROM part WHERE length(p_name) >= 2")
def gc_sides(spark, sf):
    return read(spark, sf, "part").where(F.length("p_name") >= 2).select("p_partkey", r6(S.gc_difference(F.upper("p_name"))).alias("gap"))


@query(f"""WITH d(s, v) AS (VALUES {STEPS_SQL}), m(s, v) AS (VALUES {BASES_SQL}), b AS (SELECT p_partkey, upper(p_name) AS s FROM part UNION ALL SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) FROM part), p AS (SELECT p_partkey, s, unnest(range(1, length(s))) AS i FROM b),
x AS (SELECT p_partkey, coalesce(d.v, 0) - CASE WHEN i > 1 THEN coalesce(m.v, 0) ELSE 0 END AS v FROM p LEFT JOIN d ON d.s = substr(p.s, i, 2) LEFT JOIN m ON m.s = substr(p.s, i, 1)) SELECT p_partkey, CAST(sum(v) AS DOUBLE) AS extinction FROM x GROUP BY p_partkey""")
def duplex_extinction(spark, sf):
    return read(spark, sf, "part").where(F.length("p_name") >= 2).select("p_partkey", S.duplex_extinction(F.col("p_name")).alias("extinction"))


@query("""WITH l AS (SELECT p_partkey, p_name AS a, reverse(p_name) AS b, unnest(range(0, length(p_name))) AS i FROM part), x AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS isle FROM l WHERE substr(a, i + 1, 1) <> substr(b, i + 1, 1))
SELECT p_partkey, CAST(min(i) AS INT) AS start, CAST(count(*) AS INT) AS size FROM x GROUP BY p_partkey, isle""")
def mismatch_runs(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", "p_name", F.reverse("p_name").alias("other"))
    return S.mismatch_runs(rows, "p_partkey", "p_name", "other")


@query("SELECT p_partkey, CAST(s - 1 + 2 AS INT) AS center, substr(p_name, s, 5) AS window FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 3)) AS s FROM part WHERE length(p_name) >= 5)")
def sequence_windows(spark, sf):
    from ..models import regression

    return regression.windows(read(spark, sf, "part"), "p_partkey", "p_name", 5).select("p_partkey", "center", F.col("window").alias("window"))


@query("""SELECT p_partkey, CAST(length(regexp_replace(substr(upper(p_name), 1, 6), '[^E]', '', 'g')) AS DOUBLE) AS k_e_0, CAST(length(regexp_replace(substr(upper(p_name), 7, 6), '[^E]', '', 'g')) AS DOUBLE) AS k_e_1,
CASE WHEN substr(p_name, 3, 1) = 'a' THEN 1.0::DOUBLE ELSE 0.0 END AS third_a FROM part""")
def feature_columns(spark, sf):
    from ..models import regression

    bins = regression.kmer_columns(F.upper("p_name"), ["E"], 2, 12)
    return read(spark, sf, "part").select("p_partkey", *(c.alias(n.lower()) for n, c in bins.items()), regression.markov_columns(F.upper("p_name"), [2])["m_2_A"].alias("third_a"))


@query("""WITH f AS (SELECT CAST(length(p_name) AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, p_retailprice AS y FROM part), m AS (SELECT avg(a) AS a, avg(b) AS b, avg(y) AS y, count(*) AS n FROM f),
s AS (SELECT var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS a_y, covar_pop(b, y) * count(*) AS b_y FROM f),
c AS (SELECT (a_y * bb - ab * b_y) / (aa * bb - ab * ab) AS c1, (aa * b_y - ab * a_y) / (aa * bb - ab * ab) AS c2 FROM s) SELECT round(c1, 5) AS c1, round(c2, 5) AS c2, round(y - c1 * a - c2 * b, 4) AS intercept FROM c, m""")
def ridge_fit(spark, sf):
    from ..models import regression

    rows = read(spark, sf, "part").select(F.length("p_name").cast("double").alias("a"), F.col("p_size").cast("double").alias("b"), "p_retailprice")
    coefficients, intercept = regression.ridge(rows, ["a", "b"], "p_retailprice", 1.0)
    return spark.createDataFrame([(round(coefficients[0], 5), round(coefficients[1], 5), round(intercept, 4))], "c1 double, c2 double, intercept double")


# -- more of signals, reads and joins ----------------------------------------------------------------------------------

@query(f"""WITH {NATIONS}, p AS (SELECT a.id AS id1, b.id AS id2, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM nm a JOIN nm b ON a.pos = b.pos AND a.id < b.id)
SELECT id1, id2, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / m) ELSE 0 END), 0.0)), 6) AS js_distance, round(-ln(sum(sqrt(p * q))), 6) + 0.0 AS bhattacharyya FROM p GROUP BY ALL""")
def mass_distances(spark, sf):
    x, y = F.col("x"), F.col("y")
    masses = region_masses(spark, sf).select("id", D.mass(F.col("values")).alias("m"))
    pairs = J.all_pairs(masses, "id", "m", F.struct(D.js_distance(x, y).alias("js"), D.bhattacharyya(x, y).alias("b")))
    return pairs.select("id1", "id2", r6("score.js").alias("js_distance"), r6("score.b").alias("bhattacharyya"))


@query(f"""WITH {BRANDS}, m AS (SELECT pos, avg(value) AS v FROM bs GROUP BY pos), l AS (SELECT pos, v, lag(v) OVER (ORDER BY pos) AS a, lead(v) OVER (ORDER BY pos) AS b FROM m),
r AS (SELECT pos, CAST(row_number() OVER (ORDER BY v DESC, pos DESC) AS INT) AS rank FROM l WHERE v > a AND v > b) SELECT bs.id, bs.pos, rank, value FROM bs JOIN r USING (pos) WHERE rank <= 5""")
def common_peaks(spark, sf):
    return G.common_peaks(brand_signal(spark, sf), ["id"], 5)


@query(f"WITH {BRANDS} SELECT a.id, a.pos, a.value, b.value AS ahead FROM bs a LEFT JOIN bs b ON b.id = a.id AND b.pos = a.pos + 3")
def shifted_signal(spark, sf):
    signal = brand_signal(spark, sf)
    return J.shifted(signal, signal, ["id"], 3, "ahead")


@query(f"WITH {BRANDS} SELECT id, pos, round((value - min(value) OVER w) * 10.0 / (max(value) OVER w - min(value) OVER w) - 5, 6) + 0.0 AS value FROM bs WINDOW w AS (PARTITION BY id) QUALIFY max(value) OVER w > min(value) OVER w")
def linear_rescale(spark, sf):
    w = Window.partitionBy("id")
    ends = brand_signal(spark, sf).withColumn("lo", F.min("value").over(w)).withColumn("hi", F.max("value").over(w)).where("hi > lo")
    return ends.select("id", "pos", r6(S.rescale(F.col("value"), F.col("lo"), F.col("hi"), -5.0, 5.0)).alias("value"))


@query(f"WITH {KDE} SELECT id, pos, round(d * d / sum(d * d) OVER (PARTITION BY id), 6) AS value FROM kd")
def boltzmann_mass(spark, sf):
    return G.boltzmann(G.energy(brand_signal(spark, sf), ["id"]), ["id"], 2.0).withColumn("value", r6("value"))


@query(f"""WITH {BRANDS}, k AS (SELECT CAST(unnest(range(1, 25)) AS INT) AS k), t AS (SELECT id, k, sum(value * cos(2 * pi() * k * pos / 50)) AS re, -sum(value * sin(2 * pi() * k * pos / 50)) AS im FROM bs, k GROUP BY id, k)
SELECT id, k, round(re / 50, 5) + 0.0 AS real, round(im / 50, 5) + 0.0 AS imaginary FROM t""")
def fourier_phase(spark, sf):
    turn = F.col("phase") * F.lit(math.pi)
    terms = G.periodogram(brand_signal(spark, sf), ["id"])
    return terms.select("id", "k", (F.round(F.col("amplitude") * F.cos(turn), 5) + 0.0).alias("real"), (F.round(F.col("amplitude") * F.sin(turn), 5) + 0.0).alias("imaginary"))


@query("SELECT p_partkey, CAST(round(p_size * 0.5) AS BIGINT) AS copies FROM part WHERE round(p_size * 0.5) > 0")
def weighted_copies(spark, sf):
    return G.weighted_copies(read(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 0.5).select("p_partkey", "copies")


@query("""WITH m AS (SELECT c_nationkey AS k, dense_rank() OVER (ORDER BY avg(c_acctbal)) - 1 AS n FROM customer GROUP BY c_nationkey) SELECT c_custkey, CAST(n AS INT) AS cluster FROM customer JOIN m ON k = c_nationkey""")
def relabelled_clusters(spark, sf):
    from ..models import matrices

    customer = read(spark, sf, "customer")
    return matrices.relabel(customer.select("c_custkey", F.col("c_nationkey").alias("cluster")), "c_custkey", customer, "c_acctbal")


@query("""WITH f AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(length(p_name) AS DOUBLE) AS b FROM part), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM f),
d AS (SELECT p_partkey, sqrt(greatest(((a - ma) * (a - ma) * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) * (b - mb) * aa) / (aa * bb - ab * ab), 0.0)) AS d FROM f, m) SELECT p_partkey, round(d, 6) AS distance FROM d""")
def component_outliers(spark, sf):
    from ..models import matrices

    rows = read(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double")).alias("pcs"))
    return matrices.outliers(rows, "p_partkey").select("p_partkey", r6("distance").alias("distance"))


@query(f"""WITH {READS.replace("WHERE event_id % 11 <> 0", "")} SELECT 'type' AS measure, type AS item, count(*) AS n FROM er GROUP BY 2 UNION ALL SELECT 'length', CAST(length(piece) AS VARCHAR), count(*) FROM er GROUP BY 2
UNION ALL SELECT 'gc', CAST(CAST(floor(length(regexp_replace(piece, '[^GC]', '', 'g')) * 100.0 / length(piece)) AS BIGINT) AS VARCHAR), count(*) FROM er GROUP BY 2
UNION ALL SELECT 'coverage', CASE WHEN e % 11 = 0 THEN 'BACKBONE' ELSE loc || '-' || k || '-' || repeat('A', n) END, count(*) FROM er WHERE type = 'valid' GROUP BY 2""")
def library_report(spark, sf):
    return R.library_report(event_reads(spark, sf))


@query(f"""WITH {READS}, c AS (SELECT loc || '-' || k || '-' || repeat('A', n) AS id, k, n, count(*) AS c FROM er WHERE type = 'valid' GROUP BY ALL)
SELECT 'kind' AS measure, k AS item, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd FROM c GROUP BY k UNION ALL SELECT 'size', CAST(n AS VARCHAR), count(*), round(avg(c), 6), round(stddev_pop(c), 6) FROM c GROUP BY n
UNION ALL (SELECT 'top', id, 1, CAST(c AS DOUBLE), 0.0 FROM c ORDER BY c DESC, id LIMIT 10)""")
def library_coverage(spark, sf):
    found = R.library_coverage(event_reads(spark, sf).where("mapped_id <> 'BACKBONE'"))
    return found.select("measure", "item", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(f"""WITH {CUTS}, c AS (SELECT id, side, cut, CAST(count(*) AS DOUBLE) AS n FROM cuts GROUP BY ALL), g AS (SELECT i.id, CAST(unnest(range(0, {LENGTH})) AS INT) AS pos FROM (SELECT DISTINCT id FROM cuts) i),
t AS (SELECT g.id, g.pos, coalesce(r.n, 0) AS top, coalesce(l.n, 0) AS bottom FROM g LEFT JOIN c r ON r.id = g.id AND r.cut = g.pos AND r.side = 'R' LEFT JOIN c l ON l.id = g.id AND l.cut = g.pos AND l.side = 'L'),
f AS (SELECT CASE WHEN a.pos >= 110 THEN coalesce(b.bottom, 0) ELSE a.top END - a.top AS d FROM t a LEFT JOIN t b ON b.id = a.id AND b.pos = a.pos + {2 * OFFSET}) SELECT count(*) AS n, sum(d * d) AS sum_squares, round(avg(d * d), 6) AS mean_squares FROM f""")
def impute_residuals(spark, sf):
    rows = strand_arrays(spark, sf)
    truth = rows.select("id", F.posexplode("top").alias("pos", "true_top"))
    return I.residuals(_cells(I.naive(rows)), truth, ["id", "pos"], "top", "true_top").withColumn("mean_squares", r6("mean_squares"))


@query("""WITH RECURSIVE t AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
b AS (SELECT child AS node FROM t WHERE parent = 'r1' UNION ALL SELECT t.child FROM t JOIN b ON t.parent = b.node) SELECT node FROM b""")
def tree_descendants(spark, sf):
    from ..models import matrices

    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nations = read(spark, sf, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    customers = read(spark, sf, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    return matrices.descendants(nations.union(customers), "r1")


@query()
def bisection_tree(spark, sf):
    from ..models import matrices

    return spark.createDataFrame(matrices.bisections(nation_pairs(spark, sf).withColumn("score", J.similarity(F.col("js")))))


# the queries that ``extended`` registers
from . import extended  # noqa: E402, F401
