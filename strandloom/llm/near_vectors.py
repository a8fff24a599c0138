"""Near-duplicate embeddings by NN-descent: vectors of one label whose cosine reaches a threshold.

Equal vectors of a label are folded into the smallest id. The neighbour graph starts from random-hyperplane buckets and is
refined by local joins: the neighbours and reverse neighbours of a vector are compared with each other, and each keeps its
best. Comparisons so far use vectors rounded to bytes. The edges near the threshold are then checked exactly, in double
precision, and joined into components.

A list whose entries all lie in its vector's component is saturated: links may lie beyond it. Those inside the component
are counted anyway, so saturated lists are enlarged by the best neighbours outside it, found by a descent of their own
that passes over pairs of one component, until no list is saturated.

An audit then compares a sample exactly with all vectors of its labels: vectors of large components, of small ones and
without links, AUDIT of each. The graph stands if the audit meets no lost link and is large enough to show, at 95 %, that
at least TARGET of the vectors with links have them all. A sample without links, or too small, shows nothing. Otherwise
every vector is compared exactly, in blocks, with all vectors of its label that are outside its component, which takes
time with the square of a label's vectors.

Inside a component every link counts, without a row for it: members within half the threshold's angle of the component's
mean all link with each other, and only the others are compared, exactly and in blocks, with all members.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing; vectors of other lengths link with nothing of this length; copies are links of each other; rows that
repeat an id count once, with one of its vectors, and get one result each; a null id links with nothing, has a null
component and is kept; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import matrix, usable
from .common import components, lowest_by_hash, written

THRESHOLD = 0.93
#: Entries of a list; tables of buckets; vectors of a bucket's block; rounds of local joins at most.
NEIGHBOURS = 10
TABLES = 6
BUCKET = 96
ROUNDS = 4
#: Members of a component's block; rows of small components a group.
BLOCK = 768
GROUP = 4096
#: Vectors of each kind that the audit compares with their whole label (a documented bound), and the share of vectors with
#: links that it must show to have them all.
AUDIT = 4096
TARGET = 0.98
#: Vectors of a group's block, where vectors are held against their whole group.
WIDE = 8192
#: What rounding to bytes can change in a cosine, by far.
SLACK = 0.03

EDGE = "id bigint, nb bigint, sim float"


def as_bytes(v: np.ndarray) -> list[bytes]:
    """Unit vectors rounded to one byte a component."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return [x.tobytes() for x in np.round(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)]


def unit(column: pd.Series) -> np.ndarray:
    u = np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1).astype(np.float32)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def best_in(ids: np.ndarray, roots: np.ndarray, u: np.ndarray, k: int) -> pd.DataFrame:
    """Each row's k most similar rows of other roots."""
    k = min(k, len(ids) - 1)
    if k <= 0:
        return pd.DataFrame({"id": [], "nb": [], "sim": []}).astype({"id": "int64", "nb": "int64", "sim": "float32"})
    sim = np.where(roots[:, None] == roots[None], np.float32(-2.0), u @ u.T)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    out = pd.DataFrame({"id": np.repeat(ids, k), "nb": ids[top.ravel()], "sim": np.take_along_axis(sim, top, 1).ravel()})
    return out[out["sim"] > -1.5]


def top_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each id."""
    once = edges.groupBy("id", "nb").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nb")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "nb", "sim")


def first_lists(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Neighbours from buckets of random-hyperplane signs; a bucket of many is cut into blocks at random."""
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sized = nodes.join(sizes, "g")

    def sign(batches):
        for batch in batches:
            if not len(batch):
                continue
            out = []
            bits = np.clip(np.ceil(np.log2(np.maximum(batch["n"].to_numpy() / BUCKET, 1.0))), 0, 40).astype(int)
            for size, part in batch.groupby(batch["u"].map(len)):
                u, b = unit(part["u"]), bits[batch.index.get_indexer(part.index)]
                for t in range(TABLES):
                    planes = np.random.default_rng((seed, t, size)).normal(size=(size, 40))
                    signs = (u @ planes > 0) & (np.arange(40)[None] < b[:, None])
                    code = signs @ (1 << np.arange(40, dtype=np.int64))
                    out.append(pd.DataFrame({"g": part["g"], "t": np.full(len(part), t, np.int32), "code": code, "id": part["id"], "root": part["root"], "u": part["u"]}))
            yield pd.concat(out)

    coded = written(sized.mapInPandas(sign, "g bigint, t int, code bigint, id bigint, root bigint, u binary"), "codes")
    counts = coded.groupBy("g", "t", "code").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("blocks"))
    blocked = coded.join(counts, ["g", "t", "code"]).withColumn("block", F.pmod(F.xxhash64("id", "t"), F.col("blocks")))

    def local(group: pd.DataFrame) -> pd.DataFrame:
        return best_in(group["id"].to_numpy(), group["root"].to_numpy(), unit(group["u"]), k)

    return top_lists(blocked.groupBy("g", "t", "code", "block").applyInPandas(local, EDGE), k)


def local_join(lists: DataFrame, nodes: DataFrame, k: int, base: DataFrame | None = None) -> DataFrame:
    """New neighbours, of other roots, among the neighbours and reverse neighbours of each vector and its ``base``."""
    # reverse neighbours are sampled to k a vector, by hash; what that leaves out comes by other ways, or the audit meets it
    order = Window.partitionBy("nb").orderBy(F.xxhash64("id", "nb"))
    back = lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(F.col("nb").alias("w"), F.col("id").alias("m"))
    around = lists.select(F.col("id").alias("w"), F.col("nb").alias("m")).union(back)
    if base is not None:
        around = around.union(base.select(F.col("id").alias("w"), F.col("nb").alias("m")))
    around = around.distinct()
    floor = lists.groupBy("id").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("full"))
    floor = floor.select(F.col("id").alias("m"), F.when(F.col("full") >= k, F.col("low")).otherwise(-2.0).alias("low"))
    rows = around.join(nodes.select(F.col("id").alias("m"), "root", "u"), "m").join(floor, "m", "left").fillna(-2.0, ["low"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = group["u"].map(len)
        for size in sizes.unique():
            part = group[sizes == size].sort_values("w", kind="stable")
            w, m, low, root = (part[c].to_numpy() for c in ("w", "m", "low", "root"))
            u = unit(part["u"])
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            length = np.diff(np.r_[starts, len(w)])
            for i in range(0, len(starts), 512):
                s, n = starts[i : i + 512], length[i : i + 512]
                slot = np.arange(n.max())[None]
                at = np.where(slot < n[:, None], s[:, None] + slot, -1)
                block = np.where(at[:, :, None] >= 0, u[at], 0)
                sim = block @ block.transpose(0, 2, 1)
                ok = (at[:, :, None] >= 0) & (at[:, None, :] >= 0) & (root[at][:, :, None] != root[at][:, None, :])
                ok &= sim > np.where(at >= 0, low[at], 2.0)[:, :, None]
                a, x, y = np.nonzero(ok)
                out.append(pd.DataFrame({"id": m[at[a, x]], "nb": m[at[a, y]], "sim": sim[a, x, y]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "nb": [], "sim": []}).astype({"id": "int64", "nb": "int64"})

    # vectors are dealt to groups of about 2048, each with at most 2 k rows for a vector, or 3 k with a base
    groups = F.broadcast(nodes.agg(F.ceil(F.count(F.lit(1)) / 2048).alias("groups")))
    dealt = rows.crossJoin(groups).withColumn("p", F.pmod(F.xxhash64("w"), F.col("groups"))).select("p", "w", "m", "root", "u", "low")
    return dealt.groupBy("p").applyInPandas(join, EDGE)


def descend(nodes: DataFrame, k: int, seed: int, base: DataFrame | None = None) -> DataFrame:
    """Lists of k neighbours of other roots for the ``nodes`` (id, g, root, u), refined until a round changes few of them."""
    now = written(first_lists(nodes, k, seed), "lists")
    entries = now.count()
    for _ in range(ROUNDS):
        better = written(local_join(now, nodes, k, base).groupBy("id", "nb").agg(F.max("sim").alias("sim")), "better")
        changed = better.join(now, ["id", "nb"], "left_anti").count()
        now = written(top_lists(now.union(better), k), "lists")
        if changed <= 0.01 * max(entries, 1):
            break
    return now


def exact_links(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold, in double precision."""
    a, b = (vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("norm").alias(f"n{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(dot / (F.col("na") * F.col("nb")) >= threshold).select("a", "b")


def outside_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join each vector to all components it has a link to, found by exact comparison with every vector
    of its group. Of several links that join the same components a task gives one."""
    placed = in_components(nodes.select("id", "g", "v", "norm"), roots)
    sizes = nodes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("blocks"))
    placed = placed.join(sizes, "g").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "v", "norm", "root")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        u = matrix(group["v"]) / group["norm"].to_numpy()[:, None]
        ids, part = group["id"].to_numpy(), np.unique(group["root"].to_numpy(), return_inverse=True)[1]
        # one block's rows against the other's; a block with itself is a pair of its own
        low = group["i"].to_numpy() == group["lo"].iloc[0]
        own, across, a, b = np.flatnonzero(low), np.flatnonzero(~low), [], []
        cols = own if not len(across) else across
        for s in range(0, len(own), 256):
            rows = own[s : s + 256]
            near = u[rows] @ u[cols].T >= threshold
            for x in np.flatnonzero((near & (part[rows][:, None] != part[cols][None])).any(1)):
                row = rows[x]
                hit = cols[near[x] & (part[cols] != part[row])]
                found, first = np.unique(part[hit], return_index=True)
                a += [ids[row]] * len(first)
                b += ids[hit[first]].tolist()
                part[np.isin(part, found)] = part[row]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("g", "lo", "hi").applyInPandas(compare, "a bigint, b bigint")


def in_components(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component, or themselves."""
    return nodes.join(roots.withColumnRenamed("root", "r"), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("r", "id")).drop("r", "node")


def enlarged(lists: DataFrame, links: DataFrame, small: DataFrame, nodes: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) found and the components (node, root), once saturated lists have been enlarged until none is."""
    seed = 1
    roots = written(components(links, "classes"), "roots")
    while True:
        a, b = roots.select(F.col("node").alias("id"), "root"), roots.select(F.col("node").alias("nb"), F.col("root").alias("other"))
        inside = lists.join(a, "id").join(b, "nb").where("root = other")
        full = written(inside.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id"), "saturated")
        if full.isEmpty():
            return links, roots
        # links to vectors whose lists are not saturated are in those lists, so saturated ones look among themselves
        seed += 1
        active = written(in_components(small.drop("root").join(full, "id"), roots), "active")
        lists = descend(active, k, seed, lists)
        more = written(exact_links(candidates(lists, threshold), nodes, threshold), "links")
        if more.isEmpty():
            return links, roots
        links = links.union(more)
        roots = written(components(links, "classes"), "roots")


def candidates(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.where(F.col("sim") >= threshold - SLACK).select(F.greatest("id", "nb").alias("a"), F.least("id", "nb").alias("b")).distinct()


def audit(nodes: DataFrame, roots: DataFrame, threshold: float) -> float:
    """A lower bound, at 95 %, of the share of vectors with links that have all of theirs; 0 if a lost link is met, or if no
    link is. At most 3 AUDIT vectors come to the driver, and each is compared with all vectors of its group."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    kinds = nodes.join(roots.join(sizes, "root").withColumnRenamed("node", "id").select("id", "size"), "id", "left")
    kinds = kinds.select("id", F.when(F.col("size").isNull(), 0).when(F.col("size") <= NEIGHBOURS, 1).otherwise(2).alias("kind"))
    kinds = written(kinds, "kinds")
    total = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    placed = written(in_components(nodes.select("id", "g", "v", "norm"), roots), "placed")
    picked = None
    for kind, n in total.items():
        some = lowest_by_hash(kinds.where(F.col("kind") == kind), "id", AUDIT, n)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return 1.0
    sample = placed.join(picked, "id").toPandas()
    groups = {g: (part["id"].to_numpy(), part["root"].to_numpy(), matrix(part["v"]) / part["norm"].to_numpy()[:, None]) for g, part in sample.groupby("g")}

    def compare(batches):
        for batch in batches:
            for g, part in batch.groupby("g"):
                if g not in groups:
                    continue
                ids, own, u = groups[g]
                near = u @ (matrix(part["v"]) / part["norm"].to_numpy()[:, None]).T >= threshold
                near &= ids[:, None] != part["id"].to_numpy()[None]
                same = own[:, None] == part["root"].to_numpy()[None]
                out = pd.DataFrame({"id": ids, "found": (near & same).sum(1), "lost": (near & ~same).sum(1)})
                yield out[(out["found"] > 0) | (out["lost"] > 0)]

    met = placed.mapInPandas(compare, "id bigint, found bigint, lost bigint").groupBy("id").agg(F.sum("found").alias("found"), F.sum("lost").alias("lost")).toPandas()
    if (met["lost"] > 0).any():
        return 0.0
    linked, open_ = 0.0, 0.0
    kind_of = sample.set_index("id")["kind"]
    for kind, n in total.items():
        seen = int((kind_of == kind).sum())
        linked += n * int((kind_of.reindex(met["id"]) == kind).sum()) / seen
        # none of the vectors seen lost a link: at 95 %, at most 3 / seen of the kind's others do
        open_ += min(1.0, 3.0 / seen) * (n - seen)
    return 1.0 - min(1.0, open_ / linked) if linked else float(open_ == 0)


def small_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) in components of one block, several of which share a group."""
    groups = F.broadcast(members.agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")))
    dealt = members.crossJoin(groups).withColumn("k", F.pmod(F.xxhash64("root"), F.col("groups"))).select("k", "root", "id", "m", "v", "norm")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby("root"):
            u = matrix(part["v"]) / part["norm"].to_numpy()[:, None]
            near = (u @ u.T) >= threshold
            np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"id": part["id"], "links": near @ part["m"].to_numpy()}))
        return pd.concat(out)

    return dealt.groupBy("k").applyInPandas(count, "id bigint, links bigint")


def large_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) in components of many blocks (members also hold ``blocks``), in parts to be summed."""

    def sums(batches):
        for batch in batches:
            for root, part in batch.groupby("root"):
                yield pd.DataFrame({"root": [root], "s": [(matrix(part["v"]) / part["norm"].to_numpy()[:, None]).sum(0)]})

    mean = members.select("root", "v", "norm").mapInPandas(sums, "root bigint, s array<double>").select("root", F.posexplode("s"))
    mean = mean.groupBy("root", "pos").agg(F.sum("col").alias("s")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("c"))
    mean = mean.select("root", F.transform("c", lambda x: x["s"]).alias("c"))
    mean = mean.withColumn("c_norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)))
    near_mean = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.col("norm") * F.col("c_norm"))
    # two vectors within half the angle of one direction link; the margin is far above what doubles round
    core = F.coalesce(near_mean >= float(np.sqrt((1 + threshold) / 2)) + 1e-9, F.lit(False))
    placed = members.join(mean, "root").withColumn("core", core).drop("c", "c_norm")
    placed = written(placed.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "placed")
    inner = placed.where("core").groupBy("root").agg(F.sum("m").alias("all"))
    counted = placed.where("core").select("root", "id", "m").join(inner, "root").select("id", (F.col("all") - F.col("m")).alias("links"))

    # the rest, in blocks of its own, meets each block of members
    rest = placed.where("NOT core")
    parts = written(rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    rest = rest.join(parts, "root").withColumn("p", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    asking = rest.select("root", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), F.lit(True).alias("asks"), "core", "id", "m", "v", "norm")
    asked = placed.join(parts, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("i").alias("q"), F.lit(False).alias("asks"), "core", "id", "m", "v", "norm")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        u = matrix(group["v"]) / group["norm"].to_numpy()[:, None]
        asks, core, ids, m = (group[c].to_numpy() for c in ("asks", "core", "id", "m"))
        y, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = (u[y] @ u[x].T >= threshold) & (ids[y][:, None] != ids[x][None])
        # links between two of the rest are met from both sides, those of the core only here
        back = x[core[x]]
        return pd.DataFrame({"id": np.r_[ids[y], ids[back]], "links": np.r_[near @ m[x], m[y] @ near[:, core[x]]]})

    return counted.union(asking.union(asked).groupBy("root", "p", "q").applyInPandas(count, "id bigint, links bigint"))


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) among the members (root, id, m, v, norm) of each component, exactly, each neighbour counted m times."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = written(members.join(sizes, "root"), "members")
    counts = small_counts(placed.where("blocks = 1"), threshold).union(large_counts(placed.where("blocks > 1"), threshold))
    return counts.groupBy("id").agg(F.sum("links").alias("links"))


def mark(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    good = usable(vectors.where("label IS NOT NULL"), carry=("label",))
    keyed = good.select("id", "v", "norm", F.xxhash64("label", F.size("v")).alias("g"), F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(5), "v", "label").alias("h2"))
    keyed = written(keyed, "vectors")
    # rows of one id but several vectors: the id's least vector, by hash, stands for it
    several = keyed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("one"), F.max(F.struct("h1", "h2")).alias("other")).where("one <> other").select("id", "one")
    keyed = keyed.join(several, "id", "left").where("one IS NULL OR (h1 = one.h1 AND h2 = one.h2)").drop("one")
    folded = keyed.groupBy("g", "h1", "h2").agg(F.min("id").alias("node"), F.count_distinct("id").alias("m"), F.min(F.struct("id", "v", "norm")).alias("x"))
    folded = written(folded.select("g", "h1", "h2", "node", "m", "x.v", "x.norm"), "folded")
    place = written(keyed.select("id", "h1", "h2").distinct().join(folded.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"), "place")
    nodes = folded.select(F.col("node").alias("id"), "g", "v", "norm", "m")

    def rounded(batches):
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len)):
                yield pd.DataFrame({"id": part["id"], "g": part["g"], "u": as_bytes(matrix(part["v"]))})

    small = written(nodes.select("id", "g", "v").mapInPandas(rounded, "id bigint, g bigint, u binary").withColumn("root", F.col("id")), "bytes")
    lists = descend(small, NEIGHBOURS, 1)
    links = written(exact_links(candidates(lists, threshold), nodes, threshold), "links")
    links, roots = enlarged(lists, links, small, nodes, NEIGHBOURS, threshold)
    if audit(nodes, roots, threshold) < TARGET:
        more = written(outside_links(nodes, roots, threshold), "more")
        if not more.isEmpty():
            roots = written(components(links.union(more), "classes"), "roots")
    members = roots.withColumnRenamed("node", "id").join(nodes, "id").select("root", "id", "m", "v", "norm")
    counts = link_counts(members, threshold)
    result = place.join(nodes.select(F.col("id").alias("node"), "m"), "node").join(roots, "node", "left").join(counts.withColumnRenamed("id", "node"), "node", "left")
    result = result.select(F.col("id").alias("r_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("root", "node").alias("component"))
    result = written(result, "near")
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = every.join(result, F.col("vec_id") == F.col("r_id"), "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
