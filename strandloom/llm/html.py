"""Main text of web pages: markup structure together with a suffix array of each host's repeated passages.

A page is cut into blocks of visible text. A block is article text if it lies inside ``article`` or ``main``; it is page
furniture if it lies in an element that holds menus, headers, footers, sidebars, notices, adverts, forms or comments;
all other blocks are open. Over the blocks outside the article, each host's token streams are concatenated, their
suffixes sorted, and passages of at least RUN tokens that stand on PAGES distinct pages of the host are found; the open
tokens that such passages cover go, and runs that only one page has stay. On a page with an article, the article is the
main text; on a page without one, the open unique runs are.

The host's stream is sorted in shards of pages, each of bounded size; a shard gives each distinct RUN-token prefix of its
sorted suffixes once, with the number of pages that have it. Those counts are summed over the shards of a host (a page, and
with it its copies, lies in one shard, so the sum is exact), and the prefixes on enough pages go back to the shards that
have them. A large host is thus never in one task, and passages that repeat across its shards are found as well. Each page
is parsed once, and what it says is written.

Defined results: null and empty html give an empty text; character references are decoded once; white space inside a
block becomes one space; malformed nesting closes at the next end tag that matches, or at the end, and a quote that never
closes ends with its tag; pages of a host that say the same outside their articles (rows that repeat, copies under other
addresses) count as one page when passages are counted, and get the same text; a null url is a host of its
own; a page of any length is read whole; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tokens of the shortest passage that counts as repeated, and the pages of a host that must have it.
RUN = 6
PAGES = 3
#: Characters outside the articles of a shard, on average, and what a page counts beside its own.
SHARD_CHARS = 500_000
PAGE_CHARS = 1_000

# Elements by their part in HTML.
ARTICLE = {"article", "main"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "figure-controls"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "textarea"}
RAW = {"script", "style", "textarea", "title", "template", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Words of class, id and role attributes that mark furniture: outside an article anywhere in a name, inside one only as a
#: whole name or with a word for a part of a page after it, so that a name such as "search-tips" leaves a paragraph alone.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|share|social|related|newsletter|subscribe|signup|login|comments?|disqus|replies|reply|navigation|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
INNER_MARKS = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsored|promo|cookies?|consent|popup|modal|nav|navigation|menu|breadcrumbs?|sidebar|share|social|related|newsletter|subscribe|signup|login|comments?|disqus|replies|reply|complementary|contentinfo|search)(?:[_-](?:area|bar|banner|block|box|buttons?|container|form|link|links|list|notice|section|signup|slot|thread|unit|widget|wrapper))*(?=$|\s)", re.I)
CONTENT_MARKS = re.compile(r"(?:^|[\s_-])(?:article|content|post|story|entry|main)(?:$|[\s_-])", re.I)

# Tags as HTML reads them: a name, then attributes whose value is quoted or runs to the next blank or ">". Every part is
# taken whole, so a tag is read once, however long it is.
_VALUE = r"(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))"
_ATTRIBUTE = rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{_VALUE})?+"
_ATTRIBUTES = re.sub(r"\((?!\?)", "(?:", rf"(?:[\s/]*+{_ATTRIBUTE})*+[\s/]*+")
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(_ATTRIBUTE)
NAMING = re.compile(r"class|id|role", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
SPACE = re.compile(r"\s+")

KEEP, OPEN, DROP = 0, 1, 2


def naming(attributes: str) -> str:
    """The values of the class, id and role attributes of a tag."""
    if not NAMING.search(attributes):
        return ""
    return " ".join(x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(attributes) if x[0].lower() in ("class", "id", "role"))


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the visible blocks in page order; kind is KEEP (article), OPEN or DROP (furniture)."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, bool, bool]] = []  # name, then whether it makes its inside hidden, furniture, article
    opened: dict[str, list[int]] = {}  # where each name stands in the stack
    parts: list[str] = []
    hidden = furniture = article = 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((DROP if furniture else KEEP if article else OPEN, text))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            if not hidden:
                parts.append(page[at:])
            break
        if not hidden and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            if opened.get(name):
                for _ in range(len(stack) - opened[name][-1]):
                    closed, h, f, a = stack.pop()
                    opened[closed].pop()
                    hidden, furniture, article = hidden - h, furniture - f, article - a
            continue
        if name in RAW and not m[3].endswith("/"):
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        marks = naming(m[3]) if m[3] else ""
        marked = bool(marks) and name not in ("body", "html", *ARTICLE) and bool((INNER_MARKS if article else MARKS).search(marks))
        h, f = name in HIDDEN, name in FURNITURE or marked
        # a header inside an article holds its title
        if name == "header" and article:
            f = False
        a = name in ARTICLE or (name in ("div", "section") and bool(marks) and not f and bool(CONTENT_MARKS.search(marks)))
        if h or f or a or name not in INLINE:
            flush() if h or f or a else None
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, h, f, a))
            hidden, furniture, article = hidden + h, furniture + f, article + a
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Positions of ``tokens`` (numbers) in the order of their suffixes, compared over the first RUN tokens or more."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) if n else tokens
    order, k = np.argsort(rank, kind="stable"), 1
    while k < RUN and n:
        later = np.full(n, -1, np.int64)
        later[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((later, rank))
        a, b = rank[order], later[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
        k *= 2
    return order


def token_keys(words: list[str]) -> np.ndarray:
    """A 64-bit number of each word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def passages(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of RUN tokens within one block of ``pages`` (token streams; an empty string ends a block).

    (key, page, position): sorted by suffix, so that equal runs stand together.
    """
    words = [w for p in pages for w in (*p, "")]
    owner = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    position = np.concatenate([np.arange(len(p) + 1) for p in pages]) if pages else np.zeros(0, np.int64)
    if not words:
        return np.zeros(0, np.uint64), owner, position
    keys = token_keys(words)
    ends = np.array([w == "" for w in words])
    n = len(keys)
    order = suffix_array(keys)
    clear = np.zeros(n, np.int64)
    clear[: n] = np.cumsum(ends)
    fits = np.zeros(n, bool)
    if n >= RUN:
        before = np.r_[0, clear]
        fits[: n - RUN + 1] = before[RUN:] == before[: n - RUN + 1]
    order = order[fits[order]]
    mixed = np.zeros(len(order), np.uint64)
    for k in range(RUN):
        mixed = (mixed ^ keys[order + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed, owner[order], position[order]


PARSED = "page_id bigint, url string, article string, kinds array<int>, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row for each page: the text of its article, empty without one, and the blocks outside it. One narrow pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_blocks(h) for h in batch.pop("html").tolist()]
            yield batch.assign(
                article=["\n".join(t for k, t in x if k == KEEP) for x in found],
                kinds=[[k for k, _ in x if k != KEEP] for x in found], texts=[[t for k, t in x if k != KEEP] for x in found],
            )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(run, PARSED)


def outside(texts) -> list[str]:
    """Token stream of a page's blocks outside the article; an empty string ends each block."""
    return [w for t in texts for w in (*t.split(" "), "")]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    said = F.to_json(F.struct("kinds", "texts"))
    found = parsed(pages).withColumn("host", host).withColumn("c1", F.xxhash64(said)).withColumn("c2", F.xxhash64(F.lit(7), said))
    found = written(found, "parsed")
    # what pages of a host say outside their articles, once each; copies meet by their hashes before their texts move
    copies = found.groupBy("host", "c1", "c2").agg(F.first("kinds").alias("kinds"), F.first("texts").alias("texts"), F.min(F.col("article") != "").alias("has_article"))
    # hosts are cut into shards of pages by their hash; how many follows from the characters of the host's pages
    size = F.aggregate("texts", F.lit(PAGE_CHARS).cast("bigint"), lambda s, t: s + F.length(t))
    distinct = written(copies, "distinct")
    sizes = distinct.groupBy("host").agg(F.ceil(F.sum(size) / SHARD_CHARS).cast("int").alias("shards"))
    dealt = distinct.join(sizes, "host").withColumn("shard", F.pmod("c1", F.col("shards")))

    def count_runs(group: pd.DataFrame) -> pd.DataFrame:
        keys, owner, _ = passages([outside(t) for t in group["texts"]])
        # equal runs stand together in the suffix order; each counts once a page
        pairs = np.unique(np.stack([keys.view(np.int64), owner]), axis=1) if len(keys) else np.zeros((2, 0), np.int64)
        runs, first, n = np.unique(pairs[0], return_index=True, return_counts=True)
        is_open = ~group["has_article"].to_numpy(bool)[pairs[1]] if len(runs) else np.zeros(0, bool)
        asked = np.add.reduceat(is_open.astype(int), first) > 0 if len(runs) else np.zeros(0, bool)
        head = {c: pd.Series([group[c].iloc[0]] * len(runs), dtype=object) for c in ("host", "shard")}
        return pd.DataFrame({**head, "key": runs, "pages": n, "asked": asked})

    counted = dealt.select("host", "shard", "texts", "has_article").groupBy("host", "shard").applyInPandas(count_runs, "host string, shard bigint, key bigint, pages bigint, asked boolean")
    counted = written(counted, "runs")
    repeated = counted.groupBy("host", "key").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("host", "key")
    # a shard gets the repeated runs that its own pages without an article have
    wanted = counted.where("asked").join(repeated, ["host", "key"], "left_semi").select(F.col("host").alias("r_host"), F.col("shard").alias("r_shard"), "key")
    open_pages = dealt.where("NOT has_article").select("host", "shard", "c1", "c2", "kinds", "texts")

    def cover(group: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        streams = [outside(t) for t in group["texts"]]
        keys, owner, position = passages(streams)
        hit = np.isin(keys.view(np.int64), runs["key"].to_numpy(dtype=np.int64)) if len(runs) else np.zeros(len(keys), bool)
        covered = [np.zeros(len(s), bool) for s in streams]
        for p, i in zip(owner[hit].tolist(), position[hit].tolist(), strict=True):
            covered[p][i : i + RUN] = True
        texts = []
        for kinds, blocks, mask in zip(group["kinds"], group["texts"], covered, strict=True):
            at, kept = 0, []
            for k, t in zip(kinds, blocks, strict=True):
                words = t.split(" ")
                here = mask[at : at + len(words)]
                at += len(words) + 1
                if k == OPEN and (unique := " ".join(w for w, c in zip(words, here, strict=True) if not c)):
                    kept.append(unique)
            texts.append("\n".join(kept))
        return pd.DataFrame({"host": group["host"], "c1": group["c1"], "c2": group["c2"], "text": texts})

    open_texts = open_pages.groupBy("host", "shard").cogroup(wanted.groupBy("r_host", "r_shard")).applyInPandas(cover, "host string, c1 bigint, c2 bigint, text string")
    with_article = found.where("article <> ''").select("page_id", "url", F.col("article").alias("text"))
    both = with_article.unionByName(found.where("article = ''").select("page_id", "url", "host", "c1", "c2").join(open_texts, ["host", "c1", "c2"]).select("page_id", "url", "text"))
    return both.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
