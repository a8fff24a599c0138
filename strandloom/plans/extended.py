"""More registered queries: reading and classifying, mapping, robust and interpolated models, each with its DuckDB SQL.

Stand-ins as in ``catalog``; an aligned read is made of an event: its variant, place and ends follow from its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import impute as I
from ..operators import joins as J
from ..operators import mapping as A
from ..operators import reads as R
from ..operators import signal as G
from ..sources import text as T
from ..sources.memo import passing_folder
from .catalog import BASES_SQL, BRANDS, CUTS, LENGTH, NATIONS, OFFSET, STEPS_SQL, TEMPLATE, brand_signal, event_piece, query, r6, read, strand_arrays

# -- aligned reads -----------------------------------------------------------------------------------------------------


def event_variants(spark: SparkSession, sf: str) -> DataFrame:
    """(e, k, n, loc, nts, token, plain, seq): an event's variant of the template, and the template with it."""
    e, whole = F.col("event_id"), F.lit(TEMPLATE)
    rows = read(spark, sf, "events").select(
        e.alias("e"), (F.col("user_id") % 2).alias("even"), F.when(e % 3 == 0, "M").when(e % 3 == 1, "I").otherwise("D").alias("k"), (e % 5 + 1).cast("int").alias("n"), (F.col("user_id") % 140 + 40).cast("int").alias("loc"),
    )
    own = F.substring(whole, F.col("loc") + 1, F.col("n"))
    rows = rows.withColumn("nts", F.when(F.col("k") == "D", own).otherwise(F.translate(own, "ACGT", "CGTA")))
    at = F.col("loc") - F.when(F.col("k") == "I", 1).otherwise(0)
    after = F.col("loc") + F.when(F.col("k") == "I", 0).otherwise(F.col("n"))
    seq = F.concat(F.substring(whole, F.lit(1), F.col("loc")), F.when(F.col("k") == "D", "").otherwise(F.col("nts")), F.substring(whole, after + 1, F.lit(LENGTH)))
    return rows.select("*", F.concat_ws("-", at.cast("string"), "k", "nts").alias("token"), seq.alias("seq"), (F.col("e") % 13 == 0).alias("plain"))


def aligned(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows (name, flag, rname, start, cigar, seq, nm), written as an alignment file and read again."""
    line = F.concat_ws("\t", F.col("name").cast("string"), F.col("flag").cast("string"), "rname", (F.col("start") + 1).cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    path = passing_folder(spark, "sam")
    rows.select(line.alias("value")).write.text(path)
    return T.sam(spark, path)


def backbone_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of the variants, aligned to the template: from its start, to its end, whole, or a part around the variant."""
    v, whole = event_variants(spark, sf), F.lit(TEMPLATE)
    e, k, n, loc = (F.col(c) for c in ("e", "k", "n", "loc"))
    v = v.withColumn("s", F.when(e % 4 % 2 == 0, 0).otherwise(loc - 20)).withColumn("t", F.when((e % 4 == 0) | (e % 4 == 3), loc + 20).otherwise(LENGTH))
    part = lambda a, b: F.substring(whole, a + 1, b - a)
    after = loc + F.when(k == "I", 0).otherwise(n)
    seq = F.when(F.col("plain"), part(F.col("s"), F.col("t"))).otherwise(F.concat(part(F.col("s"), loc), F.when(k == "D", "").otherwise(F.col("nts")), part(after, F.col("t"))))
    m = lambda c: F.concat(c.cast("string"), F.lit("M"))
    cigar = F.when(F.col("plain") | (k == "M"), m(F.col("t") - F.col("s"))).when(k == "I", F.concat(m(loc - F.col("s")), n.cast("string"), F.lit("I"), m(F.col("t") - loc))).otherwise(F.concat(m(loc - F.col("s")), n.cast("string"), F.lit("D"), m(F.col("t") - loc - n)))
    flag = F.when(e % 17 == 0, 4).otherwise(0)
    rows = v.select(e.alias("name"), flag.alias("flag"), F.when(e % 23 == 0, "*").otherwise("BACKBONE").alias("rname"), F.when(e % 29 == 0, -1).otherwise(F.col("s")).alias("start"), cigar.alias("cigar"), seq.alias("seq"), n.alias("nm"))
    return aligned(rows, spark)


VARIANTS = f"""ev AS (SELECT event_id AS e, user_id % 2 AS even, CASE event_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'I' ELSE 'D' END AS k, CAST(event_id % 5 + 1 AS INT) AS n, CAST(user_id % 140 + 40 AS INT) AS loc, event_id % 13 = 0 AS plain FROM events),
vs AS (SELECT *, CASE WHEN k = 'D' THEN substr('{TEMPLATE}', loc + 1, n) ELSE translate(substr('{TEMPLATE}', loc + 1, n), 'ACGT', 'CGTA') END AS nts FROM ev),
vt AS (SELECT *, (loc - CASE WHEN k = 'I' THEN 1 ELSE 0 END) || '-' || k || '-' || nts AS token, CASE WHEN e % 2 = 0 THEN 0 ELSE loc - 20 END AS s, CASE WHEN e % 4 IN (0, 3) THEN loc + 20 ELSE {LENGTH} END AS t,
{LENGTH} + CASE k WHEN 'I' THEN n WHEN 'D' THEN -n ELSE 0 END AS len, e % 17 = 0 OR e % 23 = 0 OR e % 29 = 0 AS bad FROM vs)"""


@query(f"WITH {VARIANTS} SELECT CAST(e AS VARCHAR) AS read_id, bad AS unmapped FROM vt")
def mapping_filter(spark, sf):
    rows = backbone_reads(spark, sf)
    return rows.select("read_id", R.unmapped(rows).alias("unmapped"))


@query(f"WITH {VARIANTS} SELECT CAST(e AS VARCHAR) AS read_id, CASE WHEN plain THEN NULL ELSE token END AS call, CAST(CASE WHEN e % 29 = 0 THEN -1 + t - s ELSE t END AS INT) AS aligned_end FROM vt WHERE e % 29 <> 0")
def variant_call_tokens(spark, sf):
    found = R.variant_calls(backbone_reads(spark, sf).where("pos >= 0"), TEMPLATE)
    return found.select("read_id", F.explode_outer("calls").alias("call"), "aligned_end")


def variant_library(spark: SparkSession, sf: str) -> DataFrame:
    """(ref_id, seq): the variants of even users."""
    return event_variants(spark, sf).where("even = 0").select(F.col("token").alias("ref_id"), "seq").distinct()


PLACED = """CASE WHEN l AND r THEN 'freeDNA' WHEN l OR r THEN 'valid' ELSE 'frag' END"""
CUT = """CASE WHEN type <> 'valid' THEN 'NA' WHEN l THEN 'L:' || (ed + 1) ELSE 'R:' || (s - 1) END"""


@query(f"""WITH {VARIANTS}, kn AS (SELECT DISTINCT token FROM vt WHERE even = 0), m AS (SELECT vt.*, kn.token IS NOT NULL AND NOT plain AS hit, CAST(t - 1 + len - {LENGTH} AS INT) AS ed FROM vt LEFT JOIN kn USING (token)),
p AS (SELECT *, s < 10 AS l, ed > len - 11 AS r FROM m), c AS (SELECT *, CASE WHEN bad THEN 'mutant' WHEN NOT hit THEN 'unIden' ELSE {PLACED} END AS type FROM p)
SELECT CAST(e AS VARCHAR) AS read_id, type, CASE WHEN type IN ('mutant', 'unIden') THEN 'NA' ELSE token END AS hit, {CUT} AS cut_loc FROM c WHERE e % 29 <> 0""")
def direct_classes(spark, sf):
    return R.classify_direct(backbone_reads(spark, sf).where("pos >= 0"), variant_library(spark, sf), TEMPLATE)


@query(f"""WITH {VARIANTS}, kn AS (SELECT DISTINCT token FROM vt WHERE even = 0), x AS (SELECT vt.e, vt.token, unnest(CASE WHEN plain THEN [''] WHEN e % 7 = 0 THEN [token, '3-M-A'] ELSE [token] END) AS call FROM vt)
SELECT x.e AS read_id, count(kn.token) AS hits, CAST(coalesce(sum(CASE WHEN kn.token IS NULL AND call <> '' THEN length(regexp_extract(call, '-([ACGT]*)$', 1)) END), 0) AS BIGINT) AS edits FROM x LEFT JOIN kn ON kn.token = x.call GROUP BY x.e""")
def dictionary_probe(spark, sf):
    v = event_variants(spark, sf)
    calls = F.when(F.col("plain"), F.array().cast("array<string>")).when(F.col("e") % 7 == 0, F.array("token", F.lit("3-M-A"))).otherwise(F.array("token"))
    return R.probe(v.select(F.col("e").alias("read_id"), calls.alias("calls")), variant_library(spark, sf)).select("read_id", "hits", "edits")


def own_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads aligned to their own variant, some from the plain template, some beside the variant."""
    v = event_variants(spark, sf)
    e, loc, n = F.col("e"), F.col("loc"), F.col("n")
    size = F.length("seq")
    v = v.withColumn("s", F.when(e % 4 == 1, loc - 20).when(e % 4 == 3, loc + 15).otherwise(0)).withColumn("t", F.when(e % 4 == 0, loc + 20 + n).otherwise(size))
    source = F.when((F.col("k") == "M") & F.col("plain"), F.lit(TEMPLATE)).otherwise(F.col("seq"))
    rows = v.select(e.alias("name"), F.lit(0).alias("flag"), F.col("token").alias("rname"), F.col("s").alias("start"), F.concat((F.col("t") - F.col("s")).cast("string"), F.lit("M")).alias("cigar"), F.substring(source, F.col("s") + 1, F.col("t") - F.col("s")).alias("seq"), F.lit(0).alias("nm"))
    return aligned(rows, spark)


@query(f"""WITH {VARIANTS}, q AS (SELECT e, k, token, plain, len, CASE e % 4 WHEN 1 THEN loc - 20 WHEN 3 THEN loc + 15 ELSE 0 END AS s, CASE WHEN e % 4 = 0 THEN loc + 20 + n ELSE len END AS t FROM vt),
p AS (SELECT *, CAST(least(t, len) - 1 AS INT) AS ed, s < 10 AS l, least(t, len) - 1 > len - 11 AS r FROM q), c AS (SELECT *, CASE WHEN e % 4 = 3 OR (k = 'M' AND plain) THEN 'unIden' ELSE {PLACED} END AS type FROM p)
SELECT CAST(e AS VARCHAR) AS read_id, type, token AS hit, {CUT} AS cut_loc FROM c""")
def window_classes(spark, sf):
    library = event_variants(spark, sf).select(F.col("token").alias("ref_id"), "seq").distinct()
    return R.classify(own_reads(spark, sf), library)


# -- record files ------------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(event_id AS VARCHAR) AS read_id, substr('{TEMPLATE}', CAST(user_id % 150 + 1 AS INT), CAST(event_id % 30 + 20 AS INT)) AS seq, repeat(CASE event_id % 3 WHEN 0 THEN '@' WHEN 1 THEN '+' ELSE 'G' END, CAST(event_id % 30 + 20 AS INT)) AS qual FROM events""")
def fastq_scan(spark, sf):
    """Quality lines that begin with the marks of headers; ranges of 64 kB, so that every file is cut."""
    e = F.col("event_id")
    quality = F.expr("repeat(CASE event_id % 3 WHEN 0 THEN '@' WHEN 1 THEN '+' ELSE 'G' END, CAST(event_id % 30 + 20 AS INT))")
    path = passing_folder(spark, "fastq")
    T.write_fastq(read(spark, sf, "events").select(e.cast("string").alias("read_id"), event_piece().alias("seq"), quality.alias("qual")), path)
    return T.fastq(spark, path, split_bytes=1 << 16)


@query("SELECT n_name AS sample, CAST(t AS INT) AS rep, CAST(i AS DOUBLE) AS time, CAST(n_nationkey * 10 + i * 2 + t AS DOUBLE) AS value FROM nation, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 2)) AS t)")
def assay_scan(spark, sf):
    row = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat_ws("\t", i.cast("string"), (F.col("n_nationkey") * 10 + i * 2).cast("string"), (F.col("n_nationkey") * 10 + i * 2 + 1).cast("string")))
    path = passing_folder(spark, "assay")
    named = read(spark, sf, "nation").select(F.concat(F.lit("@"), "n_name", F.lit("\n# minutes and replicates\n"), F.array_join(row, "\n")).alias("value"))
    named.write.text(path)
    return T.assays(spark, path)


@query("SELECT p_brand AS chr, CAST(p_partkey AS INT) AS pos, p_retailprice AS score, CAST(p_size - 25 AS DOUBLE) AS snr FROM part WHERE p_size > 25")
def nucleosome_scan(spark, sf):
    path = passing_folder(spark, "map")
    line = F.concat_ws("\t", "p_brand", (F.col("p_partkey") + 1).cast("string"), F.col("p_retailprice").cast("string"), (F.col("p_size") - 25).cast("string"))
    read(spark, sf, "part").select(line.alias("value")).write.text(path)
    return T.nucleosomes(spark, path)


@query("""WITH g AS (SELECT p_partkey, 'g' || (p_partkey // 2) AS gene, CAST(p_size AS INT) AS c, p_partkey % 3 = 0 AS minus, CAST(p_partkey * 10 AS INT) AS a, CAST(p_partkey * 10 + p_size AS INT) AS b FROM part WHERE p_partkey % 5 <> 0)
SELECT gene || CASE WHEN row_number() OVER (PARTITION BY gene ORDER BY c, a) > 1 THEN '-alt' ELSE '' END AS gene, 'chr' || c AS chr, CASE WHEN minus THEN '-' ELSE '+' END AS strand, CASE WHEN minus THEN b ELSE a END AS tss, CASE WHEN minus THEN a ELSE b END AS tts FROM g""")
def gene_scan(spark, sf):
    path, k = passing_folder(spark, "genes"), F.col("p_partkey")
    kind = F.when(k % 5 == 0, "tRNA").otherwise("ORF-T")
    line = F.concat_ws("\t", k.cast("string"), F.col("p_size").cast("string"), F.when(k % 3 == 0, "-").otherwise("+"), (k * 10).cast("string"), (k * 10 + F.col("p_size")).cast("string"), kind, F.concat(F.lit("g"), F.floor(k / 2).cast("string")))
    read(spark, sf, "part").select(line.alias("value")).write.text(path)
    return T.genes(spark, path)


# -- mapping -----------------------------------------------------------------------------------------------------------

FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")


def folded(c: str) -> Column:
    """A name in four letters."""
    return F.translate(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), *FOLD)


def name_genome(spark: SparkSession, sf: str) -> DataFrame:
    """(chr, seq): a brand's names, one after the other."""
    rows = read(spark, sf, "part").groupBy(F.col("p_brand").alias("chr")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", folded("p_name").alias("s")))).alias("a"))
    return rows.select("chr", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("seq"))


GENOME = f"""ge AS (SELECT p_brand AS chr, string_agg(translate(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{FOLD[0]}', '{FOLD[1]}'), '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1),
re AS (SELECT min(p_partkey) AS read_id, translate(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{FOLD[0]}', '{FOLD[1]}') AS s FROM part GROUP BY 2),
rs AS (SELECT read_id, '+' AS strand, s FROM re UNION ALL SELECT read_id, '-', reverse(translate(s, 'ACGT', 'TGCA')) FROM re),
hi AS (SELECT read_id, chr, CAST(i AS BIGINT) AS pos, strand FROM (SELECT chr, seq, unnest(range(0, length(seq))) AS i FROM ge) g JOIN (SELECT *, substr(s, 1, 4) AS k FROM rs) r ON substr(g.seq, CAST(i + 1 AS BIGINT), 4) = r.k AND substr(g.seq, CAST(i + 1 AS BIGINT), length(s)) = s)"""


def name_reads(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").groupBy(folded("p_name").alias("seq")).agg(F.min("p_partkey").alias("read_id"))


@query(f"WITH {GENOME} SELECT * FROM hi")
def genome_hits(spark, sf):
    return A.hits(name_genome(spark, sf), name_reads(spark, sf), seed=8)


@query(f"WITH {GENOME} SELECT re.read_id, x.chr, x.pos, x.strand, coalesce(n, 0) AS places FROM re LEFT JOIN (SELECT read_id, count(*) AS n, min((chr, pos, strand)) AS m FROM hi GROUP BY 1) h USING (read_id), (SELECT 1) o, LATERAL (SELECT m[1] AS chr, m[2] AS pos, m[3] AS strand) x")
def mapped_names(spark, sf):
    return A.mapped(name_genome(spark, sf), name_reads(spark, sf), seed=8)


# -- imputation --------------------------------------------------------------------------------------------------------


@query(f"""WITH {CUTS}, c AS (SELECT id, side, cut, CAST(count(*) AS DOUBLE) AS n FROM cuts GROUP BY ALL), g AS (SELECT i.id, CAST(unnest(range(10, 110)) AS INT) AS pos FROM (SELECT DISTINCT id FROM cuts) i),
t AS (SELECT g.id % 3 AS g, g.pos, coalesce(r.n, 0) AS x, coalesce(l.n, 0) AS y FROM g LEFT JOIN c r ON r.id = g.id AND r.cut = g.pos AND r.side = 'R' LEFT JOIN c l ON l.id = g.id AND l.cut = g.pos + {2 * OFFSET} AND l.side = 'L')
SELECT g, pos, count(*) AS pairs, CASE WHEN count(*) < 3 OR avg((x = 0)::INT) > 0.7 OR avg((y = 0)::INT) > 0.7 THEN 'none' WHEN var_pop(x) = 0 OR var_pop(y) = 0 OR abs(covar_pop(x, y)) / sqrt(var_pop(x) * var_pop(y)) < 0.2 THEN 'median' ELSE 'line' END AS branch,
median(x) AS x, median(y) AS y FROM t GROUP BY ALL""")
def line_branches(spark, sf):
    rows = strand_arrays(spark, sf).withColumn("g", F.pmod("id", F.lit(3)))
    return I.branches(I.pair_counts(rows, ["g"]), ["g"])


# -- models ------------------------------------------------------------------------------------------------------------

TERMS = f"""sq AS (SELECT p_partkey % 4 AS fold, upper(p_name) AS s FROM part), ps AS (SELECT fold, s, unnest(range(0, length(s))) AS pos FROM sq),
cx AS (SELECT fold, o AS ord, pos, substr(s, pos - o + 1, o) AS prev, substr(s, pos + 1, 1) AS cur FROM ps, (SELECT CAST(unnest(range(0, 2)) AS BIGINT) AS o) WHERE pos >= 1),
cn AS (SELECT fold, ord, pos, prev, cur, count(*) AS n FROM cx GROUP BY ALL),
sh AS (SELECT *, sum(n) OVER (PARTITION BY ord, pos, prev, cur) - n AS other, sum(n) OVER (PARTITION BY ord, pos, prev) - sum(n) OVER (PARTITION BY ord, pos, prev, fold) AS seen FROM cn),
hp AS (SELECT a.n, 1.0 / 26 AS p0, coalesce(b.other / nullif(b.seen, 0), 0) AS p1, coalesce(a.other / nullif(a.seen, 0), 0) AS p2 FROM sh a JOIN sh b ON a.fold = b.fold AND a.pos = b.pos AND a.cur = b.cur AND b.ord = 0 WHERE a.ord = 1),
w0 AS (SELECT 1.0::DOUBLE / 3 AS a, 1.0::DOUBLE / 3 AS b, 1.0::DOUBLE / 3 AS c)"""
ROUNDS = ", ".join(f"w{i} AS (SELECT sum(n * a * p0 / (a * p0 + b * p1 + c * p2)) / sum(n) AS a, sum(n * b * p1 / (a * p0 + b * p1 + c * p2)) / sum(n) AS b, sum(n * c * p2 / (a * p0 + b * p1 + c * p2)) / sum(n) AS c FROM hp, w{i - 1})" for i in range(1, 6))


@query(f"WITH {TERMS}, {ROUNDS} SELECT round(a, 6) AS even, round(b, 6) AS single, round(c, 6) AS pair, round(sum(n * ln(a * p0 + b * p1 + c * p2)) / sum(n), 6) AS likelihood FROM hp, w5 GROUP BY a, b, c")
def markov_weights(spark, sf):
    from ..models import markov

    rows = read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("s"))
    _, weights, said = markov.interpolated(rows, "p_partkey", "s", 1, 26, fold=F.col("p_partkey") % 4, rounds=5)
    return spark.createDataFrame([(*(round(w, 6) for w in weights), round(said[0], 6))], "even double, single double, pair double, likelihood double")


STEPS = ", ".join(f"""c{i} AS (SELECT quantile_disc(greatest((a - ma) * (a - ma) * ia + 2 * (a - ma) * (b - mb) * ib + (b - mb) * (b - mb) * ic, 0), 0.5) AS cut FROM f, m{i}),
m{i + 1} AS (SELECT ma, mb, vb / (va * vb - vab * vab) AS ia, -vab / (va * vb - vab * vab) AS ib, va / (va * vb - vab * vab) AS ic FROM (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab FROM f, (SELECT ma AS oa, mb AS ob, ia, ib, ic FROM m{i}), c{i}
WHERE greatest((a - oa) * (a - oa) * ia + 2 * (a - oa) * (b - ob) * ib + (b - ob) * (b - ob) * ic, 0) <= cut))""" for i in range(3))


@query(f"""WITH f AS (SELECT c_custkey, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) * 100 + c_custkey % 7 AS b FROM customer), z AS (SELECT quantile_disc(a, 0.5) AS ma, quantile_disc(b, 0.5) AS mb FROM f),
m0 AS (SELECT ma, mb, 1 / pow(quantile_disc(abs(a - ma), 0.5), 2) AS ia, 0.0::DOUBLE AS ib, 1 / pow(quantile_disc(abs(b - mb), 0.5), 2) AS ic FROM f, z GROUP BY ma, mb), {STEPS},
d AS (SELECT c_custkey, sqrt(greatest((a - ma) * (a - ma) * ia + 2 * (a - ma) * (b - mb) * ib + (b - mb) * (b - mb) * ic, 0)) AS d FROM f, m3), g AS (SELECT quantile_disc(d * d, 0.5) / (2 * pow(1 - 2.0::DOUBLE / 18, 3)) AS g FROM d)
SELECT c_custkey, round(d / sqrt(g), 5) AS distance FROM d, g""")
def robust_distances(spark, sf):
    from ..models import matrices

    rows = read(spark, sf, "customer").select("c_custkey", F.array("c_acctbal", F.col("c_nationkey").cast("double") * 100 + F.col("c_custkey") % 7).alias("pcs"))
    return matrices.robust_envelope(rows, "c_custkey", rounds=3).select("c_custkey", F.round("distance", 5).alias("distance"))


@query("""WITH v AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS v FROM part), u AS (SELECT p_brand, v, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT p_brand, v, sum(n) OVER w AS n, sum(n * v) OVER w AS s, sum(n * v * v) OVER w AS q, sum(n) OVER b AS an, sum(n * v) OVER b AS a_s, sum(n * v * v) OVER b AS aq FROM u WINDOW w AS (PARTITION BY p_brand ORDER BY v), b AS (PARTITION BY p_brand))
SELECT x.p_brand, round(min(x.q - x.s * x.s / x.n + (y.q - x.q) - pow(y.s - x.s, 2) / (y.n - x.n) + (y.aq - y.q) - pow(y.a_s - y.s, 2) / (y.an - y.n)), 4) + 0.0 AS within FROM c x JOIN c y ON x.p_brand = y.p_brand AND x.v < y.v WHERE y.an > y.n GROUP BY x.p_brand""")
def natural_classes(spark, sf):
    from ..models import matrices

    return matrices.breaks_by(read(spark, sf, "part"), ["p_brand"], "p_size", 3).select("p_brand", (F.round("within", 4) + 0.0).alias("within"))


@query(f"""WITH {NATIONS}, p AS (SELECT a.id AS id1, b.id AS id2, exp(-10 * sum(CASE WHEN a.p > 0 THEN 0.5 * a.p * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN 0.5 * b.p * log2(2 * b.p / (a.p + b.p)) ELSE 0 END)) AS s FROM nm a JOIN nm b ON a.pos = b.pos GROUP BY ALL),
r AS (SELECT id1 AS id, sqrt(sum(s)) AS root FROM p GROUP BY id1) SELECT id, round(root / sqrt(sum(root * root) OVER ()), 6) AS first, 0.0::DOUBLE AS residual FROM r""")
def leading_vector(spark, sf):
    """The first vector, known in closed form, and how far the second is from being multiplied by its eigenvalue."""
    from ..models import matrices
    from .catalog import nation_pairs

    pairs = nation_pairs(spark, sf).withColumn("score", J.similarity(F.col("js"))).select("id1", "id2", "score").persist()
    found, values = matrices.leading_vectors(pairs, "score", 2)
    both = pairs.union(pairs.select("id2", "id1", "score")).union(found.select("id", F.col("id").alias("id2"), F.lit(1.0)))
    other = found.select(F.col("id").alias("id2"), F.col("root").alias("r2"), F.col("vector")[1].alias("y"))
    image = both.join(other, "id2").groupBy(F.col("id1").alias("id")).agg(F.sum(F.col("score") * F.col("y") / F.col("r2")).alias("z"))
    gap = F.abs(F.col("z") / F.col("root") - F.lit(values[1]) * F.col("vector")[1])
    return found.join(image, "id").select("id", r6(F.col("vector")[0]).alias("first"), (F.round(gap, 4) + 0.0).alias("residual"))


@query("""WITH c AS (SELECT p_brand AS k, p_size AS pos, CAST(count(*) AS DOUBLE) AS a, avg(length(p_name)) AS b, avg(p_retailprice) AS y FROM part GROUP BY ALL), r AS (SELECT * FROM c WHERE k = 'Brand#11'),
d AS (SELECT c.a - r.a AS a, c.b - r.b AS b, c.y - r.y AS y FROM c JOIN r USING (pos) WHERE c.k <> 'Brand#11'), s AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS a_y, sum(b * y) AS b_y FROM d)
SELECT round((a_y * bb - ab * b_y) / (aa * bb - ab * ab), 5) AS c1, 0.0::DOUBLE AS dropped, round((aa * b_y - ab * a_y) / (aa * bb - ab * ab), 5) AS c2 FROM s""")
def differenced_ridge(spark, sf):
    """Two families of features, less the reference brand's at the same size; one column is nowhere a number."""
    from ..models import regression

    size = F.avg(F.length("p_name"))
    cells = read(spark, sf, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_size").alias("pos")).agg(F.array(F.count(F.lit(1)).cast("double"), F.lit(float("nan"))).alias("counts"), F.array(size).alias("lengths"), F.avg("p_retailprice").alias("y"))
    less = regression.against_key(cells, "k", "pos", "Brand#11", ["counts", "lengths", "y"])
    b = regression.block_ridge(less, ["counts", "lengths"], "y")
    return spark.createDataFrame([(round(b["counts"][0], 5), b["counts"][1], round(b["lengths"][0], 5))], "c1 double, dropped double, c2 double")


@query("""WITH k AS (SELECT p_brand AS id, p_size * 0.8::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY ALL), l AS (SELECT id, x, y, lag(x) OVER w AS a, lag(y) OVER w AS b, min(x) OVER (PARTITION BY id) AS lo, max(x) OVER (PARTITION BY id) AS hi FROM k WINDOW w AS (PARTITION BY id ORDER BY x)),
g AS (SELECT CAST(unnest(range(8, 25)) AS INT) AS pos), v AS (SELECT id, pos, coalesce(b + (pos - a) / (x - a) * (y - b), y) AS v FROM l JOIN g ON pos <= x AND pos > coalesce(a, x - 1) AND (a IS NOT NULL OR pos = x) WHERE lo <= 8 AND hi >= 24), m AS (SELECT id, pos - 8 AS pos, v - avg(v) OVER (PARTITION BY id) AS v FROM v),
f AS (SELECT CAST(unnest(range(1, 8)) AS INT) AS k), t AS (SELECT id, k, sum(v * cos(2 * pi() * k * pos / 17)) AS re, sum(v * sin(2 * pi() * k * pos / 17)) AS im FROM m, f GROUP BY id, k) SELECT id, k, round(17.0 / k, 6) AS period, round((re * re + im * im) / (17 * 17), 4) + 0.0 AS power FROM t""")
def interpolated_periodogram(spark, sf):
    points = read(spark, sf, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") * F.lit(0.8)).alias("x"), F.col("p_retailprice").alias("y"))
    even = G.resampled(points, ["id"], "x", "y", 8, 24)
    middle = even.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("id"))).withColumn("pos", F.col("pos") - 8)
    return G.periodogram(middle, ["id"]).select("id", "k", r6("period").alias("period"), (F.round(F.col("amplitude") ** 2, 4) + 0.0).alias("power"))


# -- libraries and simulations over the tables -------------------------------------------------------------------------

NAMES = f"""na AS (SELECT DISTINCT translate(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{FOLD[0]}', '{FOLD[1]}') AS s FROM part)"""


def folded_names(spark: SparkSession, sf: str) -> DataFrame:
    """(seq): the different names of parts, in four letters."""
    return read(spark, sf, "part").select(folded("p_name").alias("seq")).distinct()


ALPHABET = "(SELECT unnest(['A','T','C','G']) AS x, unnest(['0','1','2','3']) AS o)"


@query(f"""WITH {NAMES}, w AS (SELECT a.x || b.x || c.x || d.x AS kmer FROM {ALPHABET} a, {ALPHABET} b, {ALPHABET} c, {ALPHABET} d), p AS (SELECT s, unnest(range(1, length(s) - 2)) AS i FROM na)
SELECT kmer, count(s) AS n FROM w LEFT JOIN (SELECT s, substr(s, i, 4) AS k FROM p) ON k = kmer GROUP BY kmer""")
def kmer_words(spark, sf):
    """Every word of four letters and how often it stands in the names, 0 included."""
    counts = S.explode_pieces(folded_names(spark, sf), ["seq"], "seq", 4).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return S.words(spark, 4).join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {NAMES}, w AS (SELECT s, z.size, unnest(range(0, length(s) - z.size + 1)) AS loc FROM na, (SELECT unnest([1, 2, 3]) AS size) z WHERE length(s) > z.size),
m AS (SELECT loc, translate(substr(s, loc + 1, size), 'ACGT', 'TGCA') AS nts, substr(s, 1, loc) || translate(substr(s, loc + 1, size), 'ACGT', 'TGCA') || substr(s, loc + size + 1) AS seq FROM w)
SELECT loc || '-M-' || nts AS ref_id, seq FROM m QUALIFY row_number() OVER (PARTITION BY seq ORDER BY loc, loc || '-M-' || nts) = 1""")
def scanning_library(spark, sf):
    from ..models import simulate

    return simulate.scanning_library(folded_names(spark, sf), [1, 2, 3])


@query(f"""WITH {NAMES}, w AS (SELECT a.x || b.x || c.x AS w, a.o || b.o || c.o AS o FROM {ALPHABET} a, {ALPHABET} b, {ALPHABET} c),
k AS (SELECT *, least(w[1:2], reverse(translate(w[1:2], 'ACGT', 'TGCA'))) || least(w[2:3], reverse(translate(w[2:3], 'ACGT', 'TGCA'))) AS k FROM w), f AS (SELECT w, o FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY o) = 1),
sp AS (SELECT s, unnest(range(0, length(s) - 2, 5)) AS loc FROM na WHERE length(s) >= 3), m AS (SELECT w || '-' || (loc + 4) AS ref_id, 'ACGT' || substr(s, 1, loc) || w || substr(s, loc + 4) || 'TT' AS seq, o, loc FROM f, sp)
SELECT ref_id, seq FROM m QUALIFY row_number() OVER (PARTITION BY seq ORDER BY o, loc) = 1""")
def kmer_library(spark, sf):
    from ..models import simulate

    return simulate.kmer_library(folded_names(spark, sf), 3, 5, "ACGT", "TT")


@query()
def simulated_counts(spark, sf):
    """Cuts drawn from each brand's signal."""
    from ..models import simulate

    return simulate.drawn_cuts(G.to_arrays(brand_signal(spark, sf), ["id"]), "id", "values", 5)


@query()
def classify_simulated(spark, sf):
    """Reads cut from the events' variants, as an aligner would place them, classified and held against the truth."""
    from ..models import simulate

    library = variant_library(spark, sf)
    made = simulate.simulated_reads(library, 2)
    last = F.element_at(F.split("read_id", "/"), -1)
    start = F.when(last.startswith("R"), F.split(last, ":")[1].cast("int") + 1).otherwise(0)
    sam = made.select("read_id", F.lit(0).alias("flag"), F.lit("BACKBONE").alias("rname"), start.alias("pos"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "seq")
    return R.crosstalk(R.classify_direct(sam, library, TEMPLATE))


@query()
def kinetic_mc(spark, sf):
    """Time averages of walks on each brand's energy profile."""
    from ..models import simulate

    profiles = G.to_arrays(G.energy(brand_signal(spark, sf), ["id"]).withColumnRenamed("energy", "value"), ["id"])
    walks = simulate.energy_walks(profiles, "id", "values", 10, 20.0)
    return G.time_average(walks.withColumn("v", F.col("state").cast("double")), ["id", "replica"], "time", "v")


@query(f"""WITH {CUTS}, c AS (SELECT id, side, cut, CAST(count(*) AS DOUBLE) AS n FROM cuts GROUP BY ALL), g AS (SELECT i.id, CAST(unnest(range(0, {LENGTH})) AS INT) AS pos FROM (SELECT DISTINCT id FROM cuts) i),
t AS (SELECT g.id, g.pos, coalesce(r.n, 0) + coalesce(l.n, 0) AS n FROM g LEFT JOIN c r ON r.id = g.id AND r.cut = g.pos - {OFFSET} AND r.side = 'R' LEFT JOIN c l ON l.id = g.id AND l.cut = g.pos + {OFFSET} AND l.side = 'L'),
a AS (SELECT id, pos, n, n / 2 / (1 + 1e-6) AS d FROM t), b AS (SELECT id, pos, n, d * n / 2 / (d + 1e-6) AS d FROM a) SELECT id, pos, round(d * n / 2 / (d + 1e-6), 6) AS dyad FROM b""")
def em_rounds(spark, sf):
    """Three rounds of the update."""
    from ..models import simulate

    found = simulate.deconvolve(strand_arrays(spark, sf), "id", {"R": {-OFFSET: 1.0}, "L": {OFFSET: 1.0}}, rounds=3, tolerance=0.0)
    return found.select("id", F.posexplode("dyad").alias("pos", "dyad")).select("id", "pos", r6("dyad").alias("dyad"))


@query()
def em_deconvolution(spark, sf):
    from ..models import simulate

    return simulate.deconvolve(strand_arrays(spark, sf), "id", {"R": {-OFFSET: 1.0}, "L": {OFFSET: 1.0}})


@query(f"WITH {BRANDS} SELECT id, pos, round(value / sum(value) OVER (PARTITION BY id), 6) AS carried FROM bs")
def driven_walks(spark, sf):
    """Where a step of each brand's driven walk leads from the brand's signal: to the same signal."""
    from ..models import simulate

    rows = G.to_arrays(brand_signal(spark, sf), ["id"])
    walks = simulate.driven(rows, "id", "values", reach=8).join(rows, "id")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    cells = walks.select("id", total.alias("total"), F.explode(F.arrays_zip("values", "transitions")).alias("x")).select("id", "total", F.col("x.values").alias("p"), F.posexplode("x.transitions").alias("pos", "t"))
    return cells.groupBy("id", "pos").agg(r6(F.sum(F.col("p") * F.col("t") / F.col("total"))).alias("carried"))


@query("SELECT round(var_samp(p_size) + var_samp(length(p_name)) + var_samp(p_retailprice), 4) AS variance, CAST(3 AS BIGINT) AS parts FROM part")
def pca_variance(spark, sf):
    """All components together hold the variance of the columns."""
    from ..models import matrices

    rows = read(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double"), "p_retailprice").alias("v"))
    found, shares = matrices.pca(rows, "p_partkey", "v", 3)
    total = sum((F.var_samp(F.get("pcs", F.lit(i))) for i in range(1, 3)), F.var_samp(F.get("pcs", F.lit(0))))
    return found.agg(F.round(total, 4).alias("variance"), F.lit(len(shares)).cast("bigint").alias("parts"))


STRANDS = """ge AS (SELECT p_partkey AS gene, p_brand AS chr, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_partkey * 3 AS INT) AS lo, CAST(p_partkey * 3 + p_size * 10 AS INT) AS hi FROM part),
mk AS (SELECT p_brand AS chr, CAST(p_partkey * 4 AS INT) AS pos FROM part)"""


def strand_spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Spans (gene, chr, strand, lo, hi) and marks (chr, pos) along the parts of a brand."""
    part, k = read(spark, sf, "part"), F.col("p_partkey")
    spans = part.select(k.alias("gene"), F.col("p_brand").alias("chr"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k * 3).cast("int").alias("lo"), (k * 3 + F.col("p_size") * 10).cast("int").alias("hi"))
    return spans, part.select(F.col("p_brand").alias("chr"), (k * 4).cast("int").alias("pos"))


@query(f"""WITH {STRANDS} SELECT gene, CASE WHEN strand = '+' THEN min(pos) ELSE max(pos) END AS near_pos FROM ge LEFT JOIN mk ON mk.chr = ge.chr AND pos BETWEEN lo AND hi GROUP BY gene, strand""")
def nearest_along_strand(spark, sf):
    spans, marks = strand_spans(spark, sf)
    plus = F.col("strand") == "+"
    genes = spans.select("gene", "chr", "strand", F.when(plus, F.col("lo")).otherwise(F.col("hi")).alias("tss"), F.when(plus, F.col("hi")).otherwise(F.col("lo")).alias("tes"))
    return J.asof_strand(genes, marks.withColumn("n", F.lit(1)), ["chr"], "tss", "tes", "strand", "pos", ["n"]).select("gene", "near_pos")


@query(f"""WITH {STRANDS} SELECT gene, pos, CAST(row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '+' THEN pos ELSE -pos END) AS INT) AS "order" FROM ge JOIN mk ON mk.chr = ge.chr AND pos > lo AND pos < hi""")
def order_along_strand(spark, sf):
    spans, marks = strand_spans(spark, sf)
    return J.interval_order(marks, spans, "pos", "lo", "hi", "strand", ["gene"], 510, ["chr"]).select("gene", "pos", "order")


# -- peaks, counts and libraries ---------------------------------------------------------------------------------------

PEAKS = f"""{BRANDS}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM bs WINDOW w AS (PARTITION BY id ORDER BY pos)),
pk AS (SELECT id, pos, value, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos DESC) AS k FROM l WHERE value > a AND value > b QUALIFY k <= 5)"""


@query(f"WITH {PEAKS} SELECT id, CAST(arg_max(pos - 25, (abs(pos - 25), -k)) AS INT) AS distance FROM pk GROUP BY id")
def furthest_peak(spark, sf):
    return G.furthest_peak(brand_signal(spark, sf), ["id"], 25)


@query(f"WITH {PEAKS} SELECT bs.id, bs.pos, coalesce(pk.value, 0.0) AS value FROM bs LEFT JOIN pk ON pk.id = bs.id AND pk.pos = bs.pos")
def peak_reduction(spark, sf):
    return G.highlight_peaks(brand_signal(spark, sf), ["id"], 5, 0)


@query(f"""WITH {BRANDS}, c AS (SELECT id, pos, CAST(round(value * 1000.0 / sum(value) OVER (PARTITION BY id)) AS BIGINT) AS copies FROM bs),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY copies DESC, pos) AS r, count(*) OVER (PARTITION BY id) AS n FROM c WHERE pos BETWEEN 8 AND 41) SELECT id, pos, strand, copies FROM r, (SELECT unnest(['+', '-']) AS strand) WHERE r <= round(n * 0.5)""")
def most_counted(spark, sf):
    return G.most_counted(brand_signal(spark, sf), ["id"], margin=8)


@query(f"""WITH {BRANDS}, e AS (SELECT id, pos, exp(-3.0 * (value / 10.0)) AS w FROM bs WHERE pos BETWEEN 5 AND 44) SELECT bs.id, bs.pos, round(coalesce(w / sum(w) OVER (PARTITION BY bs.id), 0.0), 6) AS value FROM bs LEFT JOIN e ON e.id = bs.id AND e.pos = bs.pos""")
def padded_mass(spark, sf):
    inner = brand_signal(spark, sf).where("pos BETWEEN 5 AND 44").select("id", "pos", (F.col("value") / 10.0).alias("energy"))
    return G.boltzmann_padded(inner, ["id"], 3.0, 0, 49).withColumn("value", r6("value"))


@query("""WITH p AS (SELECT p_brand, unnest(range(p_size, p_size + 5)) AS pos, p_retailprice AS v FROM part), m AS (SELECT p_brand, CAST(pos AS INT) AS pos, avg(v) AS v FROM p GROUP BY ALL),
g AS (SELECT p_brand, c AS centre, CAST(s AS INT) AS shift FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([5, 25, 50]) AS c), (SELECT unnest(range(-8, 9)) AS s)) SELECT g.p_brand, g.centre, g.shift, round(m.v, 6) AS value FROM g LEFT JOIN m ON m.p_brand = g.p_brand AND m.pos = centre + shift""")
def shifted_means(spark, sf):
    spans = read(spark, sf, "part").select("p_brand", "p_size", (F.col("p_size") + 5).alias("e"), F.col("p_retailprice").alias("v"))
    means = J.interval_mean(spans, "p_size", "e", "v", ["p_brand"]).drop("n")
    return J.around_centres(means, [5, 25, 50], 8, ["p_brand"]).withColumn("value", F.round("value", 6))


@query(f"""WITH d(s, v) AS (VALUES {STEPS_SQL}), m(s, v) AS (VALUES {BASES_SQL}), b AS (SELECT p_partkey, upper(p_name) AS s FROM part UNION ALL SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) FROM part), p AS (SELECT p_partkey, s, unnest(range(1, length(s))) AS i FROM b),
x AS (SELECT p_partkey, sum(coalesce(d.v, 0) - CASE WHEN i > 1 THEN coalesce(m.v, 0) ELSE 0 END) AS v FROM p LEFT JOIN d ON d.s = substr(p.s, i, 2) LEFT JOIN m ON m.s = substr(p.s, i, 1) GROUP BY p_partkey)
SELECT p_brand, round(sum(coalesce(v, 0) * p_size), 4) AS total, round(sum(coalesce(v, 0) * p_size) / sum(p_size), 4) AS mean FROM part LEFT JOIN x USING (p_partkey) GROUP BY p_brand""")
def library_extinction(spark, sf):
    found = S.library_extinction(read(spark, sf, "part"), "p_name", "p_size", ["p_brand"])
    return found.select("p_brand", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))
