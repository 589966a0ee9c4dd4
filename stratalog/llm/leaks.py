"""p7: passages of held-out items in the corpus.

Q-gram lemma filtering. Texts are read as streams of lower-case letters and digits, so that letter case, punctuation, markup,
spacing and line breaks do not count. Where a text has tags, entities, links or what looks like prefixes of its lines, it is read a second time without
them (unmarked()), as their letters would stand between those of a passage; both readings count. For each document all q-grams that also stand in an item give points (place in the
document, place in the item); points of one passage lie on nearly the same diagonal. Points are counted per document, item and
diagonal band; bands overlap by half, so a region whose diagonals differ by up to half a band's width lies whole in one.

A window of ``WORDS`` item words of which one in ``ONE_IN`` may be altered keeps at least
n - q + 1 - sum(length + q - 1 of each altered word) of its n characters' q-grams, and q - 1 fewer for each run of other characters that stands
between its words. The least value over all windows of an item, with its longest words altered and ``BETWEEN`` such runs, is the number of points
that a band must hold (the edit budget): no passage with so many alterations is lost by it. More runs than that are found as far as unmarked()
takes them out; the README gives the recall by kind of insertion.
Regions that reach it are verified by an alignment of words within the band, and a pair is kept if some window of the
item's words is long enough with few enough words unmatched.

The items are a query set held against all documents: they are sent to the tasks in blocks of at most ``BLOCK`` characters, one
pass over the documents for each block, so what is broadcast is bounded whatever the number of items. Documents
are neither shuffled nor compared with each other.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Length of a q-gram (as eight bytes it is one number), words of a passage, and one in so many may be altered.
Q, WORDS, ONE_IN = 8, 20, 10
#: Runs of inserted characters that the budget allows for.
BETWEEN = 3
#: Width of a band of diagonals in characters; bands overlap by half.
BAND = 128
#: Characters of items that are broadcast at once, and of documents and points that are worked on at once.
BLOCK, SLICE, POINTS = 4_000_000, 1 << 21, 1 << 20
#: An opening sentence that so many items share is an instruction, no part of the passage.
SHARED = 3

_NOT_ALNUM = re.compile(r"[\W_]+")
_FIRST = re.compile(r"\s*(.*?[.?!:])(?=\s)", re.S)
_TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower case; letters without accents and in their usual width."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return t


_TAG = re.compile(r"<!--.{0,4000}?-->|</?[A-Za-z][^<>]{0,400}>", re.S)
#: Elements that part words; others may stand within one.
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|pre|blockquote|hr)\b", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_LINK = re.compile(r"\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)")
#: Shapes of what stands before a line's text: marks of quotes, lists and comments, numbers, times, [tags], names with a colon, > or |.
_PREFIX = re.compile(r"[ \t]*(?:(?:[^\w\s]+|\d[\w:.,/+-]*[^\w\s]*|\(?\w{1,3}[).]|\[[^\]\n]{1,40}\]:?|<[^<>\n]{1,40}>|[\w.@/-]{1,24}[:>|]+)[ \t]+)+")
#: A word begins lines as a prefix (INFO, WARN) if it is among the PREFIXES most frequent beginnings, and these begin at least PREFIX_SHARE of the lines.
PREFIXES, PREFIX_SHARE, PREFIX_LINES, PREFIX_PARTS = 4, 0.8, 4, 4
_WORD = re.compile(r"\S+[ \t]+")


def unmarked(text: str) -> str:
    """The text without tags, entities, the targets of links, and what looks like a prefix of its lines. It may take words of the text for prefixes, so it is a second
    reading, never the only one."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if _BLOCK.match(m[0]) else "", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "](" in text:
        text = _LINK.sub("]", text)
    lines = text.splitlines()
    if len(lines) < 2:
        return text
    # a prefix of several parts may hold words that repeat between others of its shape
    for _ in range(PREFIX_PARTS):
        lines = [x[m.end() :] if (m := _PREFIX.match(x)) else x for x in lines]
        if not _cut_repeated(lines):
            break
    return "\n".join(lines)


def _cut_repeated(lines: list[str]) -> bool:
    """Take the words off with which most lines begin; False if there are none."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    first = Counter(m[0].strip() for i in full if (m := _WORD.match(lines[i])))
    often = {w for w, n in first.most_common(PREFIXES) if n > 1}
    if len(full) < PREFIX_LINES or sum(first[w] for w in often) < PREFIX_SHARE * len(full):
        return False
    for i in full:
        m = _WORD.match(lines[i])
        if m and m[0].strip() in often:
            lines[i] = lines[i][m.end() :]
    return True


def stream_of(text: str) -> bytes:
    return _NOT_ALNUM.sub("", plain(text)).encode("utf-8", "ignore")


def words_of(text: str) -> list[bytes]:
    """Words between white space, as letters and digits only; what has none is no word."""
    return [w for w in (_NOT_ALNUM.sub("", x).encode("utf-8", "ignore") for x in plain(text).split()) if w]


def without_instructions(items: list[tuple[int, str | None]]) -> list[tuple[int, str]]:
    """Items with the opening sentence cut off that SHARED or more of them begin with; null texts are empty."""
    opening = {i: m[1] for i, t in items if t and (m := _FIRST.match(t))}
    often = {o for o, n in Counter(opening.values()).items() if n >= SHARED}
    return [(i, (t or "")[(t or "").index(opening[i]) + len(opening[i]) :] if opening.get(i) in often else t or "") for i, t in items]


def grams(a: np.ndarray) -> np.ndarray:
    """All q-grams of bytes, as numbers."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    x = a.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


@dataclass
class Index:
    """Items as postings of q-grams: gram g stands at (item[k], place[k]) for k in starts[g]..starts[g + 1]."""

    ids: list[int]
    words: list[list[bytes]]
    places: list[np.ndarray]
    needed: np.ndarray
    gram: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


def budget(lengths: list[int]) -> int:
    """Points that a band holds at least if it holds a passage of an item with words of these lengths; 0: it can hold none."""
    least = 0
    altered = WORDS // ONE_IN
    for i in range(len(lengths) - WORDS + 1):
        window = sorted(lengths[i : i + WORDS])
        n = sum(window) - Q + 1 - sum(w + Q - 1 for w in window[-altered:]) - BETWEEN * (Q - 1)
        least = max(1, n) if not least else min(least, max(1, n))
    return least


def build_index(items: list[tuple[int, str]]) -> Index:
    ids, words, places, needed, parts = [], [], [], [], []
    for item_id, text in items:
        w = words_of(text)
        need = budget([len(x) for x in w])
        if not need:
            continue
        lengths = np.array([len(x) for x in w])
        g = grams(np.frombuffer(b"".join(w), np.uint8))
        parts.append((g, np.full(len(g), len(ids)), np.arange(len(g))))
        ids.append(item_id)
        words.append(w)
        places.append(np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        needed.append(need)
    g, item, place = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    order = np.argsort(g, kind="stable")
    gram, starts = np.unique(g[order], return_index=True)
    maybe = np.zeros(1 << _TABLE_BITS, bool)
    gram = gram.astype(np.uint64)
    maybe[(gram * _MIX) >> np.uint64(64 - _TABLE_BITS)] = True
    return Index(ids, words, places, np.array(needed, np.int64), gram, np.append(starts, len(g)), item[order].astype(np.int64), place[order].astype(np.int64), maybe)


def _hits(data: bytes, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``data`` of q-grams that the index has, and which."""
    a = np.frombuffer(data, np.uint8)
    at, which = [], []
    for lo in range(0, len(a), SLICE):
        g = grams(a[lo : lo + SLICE + Q - 1])
        near = np.flatnonzero(index.maybe[(g * _MIX) >> np.uint64(64 - _TABLE_BITS)])
        k = np.searchsorted(index.gram, g[near])
        k[k == len(index.gram)] = 0
        ok = index.gram[k] == g[near]
        at.append(near[ok] + lo)
        which.append(k[ok])
    return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(streams: list[bytes], index: Index) -> list[tuple[int, int, int]]:
    """(document, item, first diagonal of the band) of all bands that hold the points needed. Documents are numbered as given."""
    if not len(index.gram):
        return []
    begins = np.cumsum([0] + [len(s) + 1 for s in streams])
    at, which = _hits(b"\0".join(streams), index)
    doc = np.searchsorted(begins, at, "right") - 1
    enough = np.bincount(doc, minlength=len(streams)) >= index.needed.min()
    keep = enough[doc]
    at, which, doc = at[keep], which[keep], doc[keep]
    keys, counts = [], []
    n = index.starts[which + 1] - index.starts[which]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(at):  # so many points at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POINTS, "right")))
        m = n[lo:hi]
        post = np.repeat(index.starts[which[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        d = np.repeat(doc[lo:hi], m)
        diagonal = np.repeat(at[lo:hi] - begins[doc[lo:hi]], m) - index.place[post]
        pair = (d * len(index.ids) + index.item[post]) << 26
        half = diagonal // (BAND // 2)
        for shift in (0, 1):  # a band is two halves: it begins at this one or at the one before
            k, c = np.unique(pair + (half - shift + (1 << 25)), return_counts=True)
            keys.append(k)
            counts.append(c)
        lo = hi
    if not keys:
        return []
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    pair = k >> 26
    good = total >= index.needed[pair % len(index.ids)]
    return [(int(p) // len(index.ids), int(p) % len(index.ids), (int(x) - (1 << 25)) * (BAND // 2)) for p, x in zip(pair[good], k[good] & ((1 << 26) - 1))]


def aligned(doc_words: list[bytes], doc_places: np.ndarray, words: list[bytes], places: np.ndarray, diagonal: int) -> list[list[bool]]:
    """Which of an item's words are matched within the band from ``diagonal`` (and half a band on either side, as words altered or
    added shift what follows), in several alignments: the longest chain of equal words in order, which follows words added and
    left out, and each word diagonal with enough matches, on which no chance match elsewhere can draw words away."""
    lows = np.searchsorted(doc_places, places + (diagonal - BAND // 2))
    highs = np.searchsorted(doc_places, places + (diagonal + BAND + BAND // 2), "right")
    tails: list[int] = []  # the least last document word of a chain of each length
    at: list[tuple[int, int]] = []  # that chain's last pair
    came: dict[tuple[int, int], tuple[int, int] | None] = {}
    straight: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        for j in range(int(highs[i]) - 1, int(lows[i]) - 1, -1):
            if doc_words[j] == w:
                straight.setdefault(j - i, []).append(i)
                k = bisect_left(tails, j)
                came[i, j] = at[k - 1] if k else None
                if k == len(tails):
                    tails.append(j)
                    at.append((i, j))
                else:
                    tails[k] = j
                    at[k] = (i, j)
    chain = []
    step = at[-1] if at else None
    while step is not None:
        chain.append(step[0])
        step = came[step]
    out = []
    for matched in [chain, *straight.values()]:
        if len(matched) >= WORDS - WORDS // ONE_IN:
            found = [False] * len(words)
            for i in matched:
                found[i] = True
            out.append(found)
    return out


def longest_passage(found: list[bool]) -> int:
    """Words of the longest window of which at most one in ONE_IN is unmatched."""
    total = [0]
    for f in found:
        total.append(total[-1] + (1 if f else 1 - ONE_IN))
    # the longest span whose end is not below its start: starts can only be new minima
    starts = [0]
    for i, t in enumerate(total):
        if t < total[starts[-1]]:
            starts.append(i)
    best = 0
    for end in range(len(found), 0, -1):
        while starts and total[starts[-1]] <= total[end]:
            best = max(best, end - starts.pop())
    return best


def leaked(texts: list[str | None], index: Index) -> list[tuple[int, int, int]]:
    """(number of the text, item_id, words of the longest passage), each pair once."""
    out: dict[tuple[int, int], int] = {}
    words: dict[int, tuple[list[bytes], np.ndarray]] = {}
    streams = [stream_of(t) if t else b"" for t in texts]
    # a second reading stands behind all first ones, with the number of its text
    readings = [(d, t) for d, t in enumerate(texts)]
    for d, t in enumerate(texts):
        if t and (bare := unmarked(t)) != t and (s := stream_of(bare)) != streams[d]:
            readings.append((d, bare))
            streams.append(s)
    for reading, item, diagonal in candidates(streams, index):
        doc, text = readings[reading]
        if reading not in words:
            w = words_of(text)
            words[reading] = w, np.concatenate([[0], np.cumsum([len(x) for x in w])[:-1]])
        n = max(map(longest_passage, aligned(*words[reading], index.words[item], index.places[item], diagonal)), default=0)
        if n >= WORDS:
            out[doc, item] = max(n, out.get((doc, item), 0))
    return [(doc, index.ids[item], n) for (doc, item), n in out.items()]


def find_leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words`` (of the longest passage) for each row of ``docs`` (doc_id, text) and each item (item_id,
    text) of which it holds a passage. Null and empty texts hold none; items shorter than a passage are in none; of items with
    the same item_id each counts. Repeated rows of ``docs`` stay repeated; other columns are ignored."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_words int"
    # shorter texts have no passage; so the number of items in a block is bounded as well
    items = items.select("item_id", "text").where(F.length("text") >= 2 * WORDS - 1)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # what items share is found before they are cut into blocks
    opening = F.regexp_extract("text", r"(?s)^\s*(.*?[.?!:])(?=\s)", 1)
    shared = items.where(opening != "").groupBy(opening.alias("o")).count().where(F.col("count") >= SHARED)
    bodies = items.withColumn("o", opening).join(shared, "o", "left").select("item_id", F.when(F.col("count").isNotNull(), F.expr("substr(ltrim(text), length(o) + 1)")).otherwise(F.col("text")).alias("text"))
    n_blocks = max(1, -(-chars // block))
    parts = []
    for k in range(n_blocks):
        rows = bodies.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(build_index([(r[0], r[1] or "") for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                # about SLICE characters at a time, whole texts
                lo = size = 0
                for i, t in enumerate(texts):
                    size += len(t or "")
                    if size < SLICE and i + 1 < len(texts):
                        continue
                    found = leaked(texts[lo : i + 1], sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[lo + d] for d, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int32())], ["doc_id", "item_id", "n_words"]
                    )
                    lo, size = i + 1, 0

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: documents that hold a passage of it, and the words of the longest."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    per = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))
    return items.join(per, "item_id")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
