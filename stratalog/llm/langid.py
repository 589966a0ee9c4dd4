"""p8: the language of documents and of their passages.

The model is that of averaged hashed subword embeddings with a linear softmax: each word gives hashed character n-grams and itself,
a segment's vector is the mean of their embeddings, its language the softmax of a linear map of it. It is trained here by
stochastic gradient descent in numpy, on a sample of about ``TRAIN_DOCS`` labelled documents (of each at most ``TRAIN_CHARS`` characters), of whose
segments ``TRAIN_SEGMENTS`` are drawn;
labels may be wrong, so segments on which a first model firmly disagrees with their label are left out of the second. A
temperature is fitted on held-out segments, and the confidence from which a language is believed is set there too; segments
under it are of no language.

As the model is linear, a word adds the same eight numbers wherever it stands. They are kept by token in a bounded table, and
whole batches are scored by gathering and adding them up. Within a document the languages of the segments are decoded by
the Viterbi algorithm, in which a change of language costs ``SWITCH``, so that two words between longer segments do not
make a passage of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: The languages, and the names that a label may give them.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "es": "es spa spanish castilian",
    "pt": "pt por portuguese",
    "it": "it ita italian",
    "nl": "nl nld dut dutch flemish",
    "pl": "pl pol polish",
}
LANGS = list(NAMES)
NONE = len(LANGS)
#: The bound of the training sample, and the parts of it.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SEGMENTS = 1200, 4000, 16_000
BUCKETS, DIM, EPOCHS, RATE, BATCH = 1 << 16, 16, 6, 0.3, 128
#: Steps of a training at least, for small samples.
LEAST_STEPS = 400
#: Words of a passage; words from which a segment counts in training; cost of a change of language.
PASSAGE, LEAST_WORDS, SWITCH = 10, 4, 3.0
#: Share of the held-out segments, believed and right, for which the threshold is set.
PRECISION = 0.995
#: What the table of tokens may hold, in tokens and in characters, before it is emptied; characters of texts worked on at once.
MOST_TOKENS, MOST_CHARS, CHARS = 300_000, 1 << 24, 1 << 21

MOST_HASH = (1 << 63) - 1

_TOKENS = re.compile(r"\S+|\n")
_EDGE = "\"'`´’‘“”„«»‚‹›()[]{}<>*_~#|.,;:!?…¡¿-–—+=/\\​‌‍⁠﻿­"
_CODE = re.compile(r"[/\\_@#=<>{}\[\]()|$%^&*+`~\d]|\w[.:]\w|[a-z][A-Z]")
_PARTS = re.compile(r"[^\W\d_]+")
_STOP = tuple(".!?…")


def language_of_label(label: str | None) -> str | None:
    """One of LANGS; None for a label that is missing, names no language or another one."""
    if not label:
        return None
    first = re.split(r"[-_.,;( ]", label.strip().lower(), maxsplit=1)[0]
    return next((k for k, names in NAMES.items() if first in names.split()), None)


@cache
def _label_table() -> dict[str, str]:
    return {n: k for k, names in NAMES.items() for n in names.split()}


def fold(text: str) -> str:
    """Lower case without accents, as some texts come without them."""
    t = text.lower()
    if t.isascii():
        return t
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return t.replace("ß", "ss").replace("ł", "l").replace("æ", "ae").replace("œ", "oe").replace("ø", "o")


def buckets_of(word: str) -> list[int]:
    """The hashed subwords of a word: itself and its n-grams of two to four characters with marked ends."""
    w = f"<{word}>"
    out = [w]
    for n in (2, 3, 4):
        out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in out]


@dataclass
class Token:
    """words: folded words of a token, none for code, identifiers, paths, numbers; stop: it ends a segment."""

    words: list[str]
    stop: bool
    fence: bool = False


def token_of(raw: str) -> Token:
    if raw == "\n":
        return Token([], True)
    if raw[:3] in ("```", "~~~"):
        return Token([], True, True)
    stop = raw.rstrip("\"'`’”»)*_").endswith(_STOP)
    inner = unicodedata.normalize("NFC", raw).strip(_EDGE)
    if not inner or "`" in raw or _CODE.search(inner):
        return Token([], stop)
    return Token(_PARTS.findall(fold(inner)), stop)


@dataclass
class Model:
    scores: np.ndarray  # BUCKETS x languages: what a bucket adds to the logits of a segment's mean
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    #: by token: row of the tables below
    rows: dict[str, int] = field(default_factory=dict)
    tables: list = field(default_factory=list)

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


class Tokens(dict):
    """Raw token to a row of ``sums`` (what it adds), ``counts`` (subwords), ``words`` and ``marks`` (1 segment end, 2 fence)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.sums = np.zeros((1 << 12, len(LANGS)), np.float32)
        self.counts = np.zeros(1 << 12, np.int32)
        self.words = np.zeros(1 << 12, np.int32)
        self.marks = np.zeros(1 << 12, np.int8)

    def __missing__(self, raw: str) -> int:
        n = len(self)
        if n == len(self.counts):
            for name in ("sums", "counts", "words", "marks"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros_like(a)]))
        t = token_of(raw)
        for w in t.words:
            b = buckets_of(w)
            self.sums[n] += self.model.scores[b].sum(axis=0)
            self.counts[n] += len(b)
        self.words[n] = bool(t.words)
        self.marks[n] = 2 if t.fence else t.stop
        self[raw] = n
        self.chars += len(raw)
        return n


# training ------------------------------------------------------------------------------------------------------------
def segments_of(text: str) -> list[list[str]]:
    """Words of each segment: up to a sentence's or a line's end, outside of fenced code."""
    tokens = [token_of(t) for t in _TOKENS.findall(text)]
    fences = sum(t.fence for t in tokens)
    out, now, inside = [], [], False
    for t in tokens:
        if t.fence:
            fences -= 1
            inside = not inside and fences > 0
        if not inside:
            now += t.words
        if t.stop and now:
            out.append(now)
            now = []
    return out + [now] if now else out


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """samples: (language, text). Without any, a model that believes nothing."""
    rng = np.random.default_rng(seed)
    seen: dict[str, list[int]] = {}
    data, label = [], []
    found = [(lang, words) for lang, text in samples for words in segments_of(text) if len(words) >= LEAST_WORDS]
    if len(found) > TRAIN_SEGMENTS:  # drawn from all of them, as languages may come in any order
        found = [found[i] for i in rng.choice(len(found), TRAIN_SEGMENTS, replace=False)]
    for lang, words in found:
        data.append(np.array([b for w in words for b in (seen.get(w) or seen.setdefault(w, buckets_of(w)))], np.int32))
        label.append(LANGS.index(lang))
    if not data:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), threshold=1.1)
    y = np.array(label)
    order = rng.permutation(len(data))
    held, used = order[: len(order) // 10], order[len(order) // 10 :]
    first = _fit(data, y, used, 2, rng)
    p = _predict(first, data, used)
    firm = (p.argmax(axis=1) == y[used]) | (p.max(axis=1) < 0.6)
    model = _fit(data, y, used[firm], EPOCHS, rng)
    # held-out segments with labels that the first model does not firmly deny
    q = _predict(first, data, held)
    held = held[(q.argmax(axis=1) == y[held]) | (q.max(axis=1) < 0.6)]
    if len(held):
        calibrate(model, data, y, held)
    return model


def _sums(model: Model, data: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(data[i]) for i in which])
    flat = np.concatenate([data[i] for i in which])
    return np.add.reduceat(model.scores[flat], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0), counts


def _predict(model: Model, data: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    parts = [model.probabilities(*_sums(model, data, which[i : i + 4096])) for i in range(0, len(which), 4096)]
    return np.concatenate(parts) if parts else np.zeros((0, len(LANGS)))


def _fit(data: list[np.ndarray], y: np.ndarray, used: np.ndarray, epochs: int, rng) -> Model:
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.uniform(-1, 1, (DIM, len(LANGS))).astype(np.float32), np.zeros(len(LANGS), np.float32)
    batches = max(1, -(-len(used) // BATCH))
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    for step in range(epochs * batches):
        if step % batches == 0:
            parts = np.array_split(rng.permutation(used), batches)
        part = parts[step % batches]
        rate = np.float32(RATE * (1 - step / (epochs * batches)))
        counts = np.array([len(data[i]) for i in part])
        own, inverse = np.unique(np.concatenate([data[i] for i in part]), return_inverse=True)
        # the batch as a matrix: shares of the segments' subwords
        at = np.repeat(np.arange(len(part)), counts) * len(own) + inverse
        m = np.bincount(at, minlength=len(part) * len(own)).astype(np.float32).reshape(len(part), len(own)) / counts[:, None].astype(np.float32)
        mean = m @ emb[own]
        z = mean @ w + b
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        g = e / e.sum(axis=1, keepdims=True)
        g[np.arange(len(part)), y[part]] -= 1
        # summed over the batch, as if its segments came one by one
        back = m.T @ (g @ w.T)
        w -= rate * (mean.T @ g)
        b -= rate * g.mean(axis=0)
        emb[own] -= rate * back
    return Model((emb @ w).astype(np.float32), b)


def calibrate(model: Model, data: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> None:
    """The temperature with the least loss on held-out segments, and the least confidence above which PRECISION of them are right."""
    sums, counts = _sums(model, data, held)
    best = np.inf
    # below 1 it would make the model surer of texts unlike those it has seen
    for t in (1.0, 1.2, 1.5, 2.0, 3.0):
        model.temperature, old = t, model.temperature
        p = model.probabilities(sums, counts)
        loss = -np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-9)).mean()
        if loss < best:
            best = loss
        else:
            model.temperature = old
    p = model.probabilities(sums, counts)
    right, sure = p.argmax(axis=1) == y[held], p.max(axis=1)
    model.threshold = next(_levels(right, sure), 0.95)


def _levels(right: np.ndarray, sure: np.ndarray):
    for t in np.arange(0.6, 0.96, 0.05):
        kept = right[sure >= t]
        if len(kept) and kept.mean() >= PRECISION:
            yield float(t)


# use -----------------------------------------------------------------------------------------------------------------
def decode(p: np.ndarray, words: np.ndarray, threshold: float, whole: np.ndarray | None = None) -> np.ndarray:
    """Languages (NONE: none) of a document's segments with these probabilities and words. whole: the probabilities of all segments taken as one,
    which decide where each by itself is short; they are held to the same threshold."""
    best, firm = p.argmax(axis=1), p.max(axis=1) >= threshold
    # short segments too: many of another language in a row are a passage
    if firm.all() and (best == best[0]).all():
        return np.full(len(p), best[0])
    if whole is not None and whole.max() >= threshold and (words < LEAST_WORDS).all() and (best[firm] == whole.argmax()).all():
        return np.full(len(p), whole.argmax())
    emit = np.log(np.maximum(np.concatenate([p, np.full((len(p), 1), threshold)], axis=1), 1e-6)) * np.minimum(words / 4.0, 3.0)[:, None]
    n = len(p)
    score, came = emit[0].copy(), np.zeros((n, NONE + 1), np.int64)
    for i in range(1, n):
        top = int(score.argmax())
        jump = score[top] - SWITCH
        came[i] = np.where(score >= jump, np.arange(NONE + 1), top)
        score = np.maximum(score, jump) + emit[i]
    out = np.zeros(n, np.int64)
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


Run = tuple[int, int, int, float]


def passages(texts: list[str | None], tokens: Tokens) -> list[list[Run]]:
    """For each text its runs of segments of one language: (number, language, words, confidence)."""
    if len(tokens) > MOST_TOKENS or tokens.chars > MOST_CHARS:
        tokens.reset()
    parts = [_TOKENS.findall(t) if t else [] for t in texts]
    sizes = np.array([len(p) for p in parts])
    rows = np.fromiter((tokens[t] for p in parts for t in p), np.int64, sizes.sum())
    if not len(rows):
        return [[] for _ in texts]
    doc = np.repeat(np.arange(len(texts)), sizes)
    marks, words, counts = tokens.marks[rows], tokens.words[rows], tokens.counts[rows]
    # between the first and second fence, the third and fourth, and so on; a last fence without another opens nothing
    fence = marks == 2
    if fence.any():
        nth = np.cumsum(fence)
        before = np.concatenate([[0], nth])[np.concatenate([[0], np.cumsum(sizes)[:-1]])]
        nth = nth - before[doc]
        total = np.bincount(doc[fence], minlength=len(texts))
        code = (nth % 2 == 1) & (nth < total[doc])
        words, counts = np.where(code, 0, words), np.where(code, 0, counts)
    # a segment is named by the number of segment ends and documents before it
    end = (marks > 0).astype(np.int64)
    segment = np.cumsum(end) - end + doc
    keep = words > 0
    doc, segment, rows, words, counts = doc[keep], segment[keep], rows[keep], words[keep], counts[keep]
    if not len(rows):
        return [[] for _ in texts]
    starts = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])]))
    sums, of_segment = np.add.reduceat(tokens.sums[rows], starts, axis=0), np.add.reduceat(counts, starts)
    p = tokens.model.probabilities(sums, of_segment)
    n_words, of = np.add.reduceat(words, starts), doc[starts]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    out: list[list[Run]] = []
    for d in range(len(texts)):
        lo, hi = cuts[d], cuts[d + 1]
        runs: list[Run] = []
        if hi > lo:
            whole = tokens.model.probabilities(sums[lo:hi].sum(axis=0, keepdims=True), of_segment[lo:hi].sum(keepdims=True))[0]
            langs = decode(p[lo:hi], n_words[lo:hi], tokens.model.threshold, whole)
            change = np.flatnonzero(np.diff(langs)) + 1
            for k, (a, z) in enumerate(zip([0, *change], [*change, hi - lo])):
                lang, w = int(langs[a]), n_words[lo + a : lo + z]
                sure = 0.0 if lang == NONE else float((p[lo + a : lo + z, lang] * w).sum() / w.sum())
                runs.append((k, lang, int(w.sum()), round(sure, 6)))
        out.append(runs)
    return out


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The model of a sample of about ``most`` labelled rows of ``docs`` (doc_id, text, lang), chosen by a hash of the row, which has as many values
    as needed for any number of rows. Labelled rows are counted by their labels alone, and the texts are read once. Equal rows are one."""
    known = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]+)(?:[-_.,;( ]|$)", 1)
    labelled = docs.withColumn("l", known).where(F.col("l").isin(*_label_table()))
    n = labelled.select("l").count()
    rows = labelled.where(F.length("text") > 0).select("doc_id", "l", "text")
    # a row more than asked for on average, as none would leave nothing to learn from
    if n > most:
        rows = rows.where(F.xxhash64("doc_id", "l", "text").bitwiseAND(MOST_HASH) <= max(1, (most + 1) * MOST_HASH // n))
    got = rows.select("doc_id", "l", F.substring("text", 1, TRAIN_CHARS).alias("text")).distinct().collect()
    return train([(_label_table()[r["l"]], r["text"]) for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["l"], r["text"]))])


SCHEMA = "doc_id long, label string, runs array<struct<ord:int,lang:string,n_words:int,confidence:double>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``label`` (the language the label names, null if none of LANGS) and ``runs`` of each row of ``docs`` (doc_id, text,
    lang): its passages in order, with language (null: none believed), words and confidence. Null, empty and blank texts, and
    texts of code alone, have no runs. Repeated rows stay repeated, other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(sent.value)
        for b in batches:
            ids, texts, labels = (b.column(i).to_pylist() for i in range(3))
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < CHARS and i + 1 < len(texts):
                    continue
                found = passages(texts[lo : i + 1], tokens)
                runs = [[{"ord": k, "lang": None if lang == NONE else LANGS[lang], "n_words": w, "confidence": c} for k, lang, w, c in r] for r in found]
                kind = pa.list_(pa.struct([("ord", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("confidence", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : i + 1], pa.int64()), pa.array([language_of_label(x) for x in labels[lo : i + 1]], pa.string()), pa.array(runs, kind)], ["doc_id", "label", "runs"])
                lo, size = i + 1, 0

    return docs.select("doc_id", "text", "lang").mapInArrow(run, SCHEMA)


def mislabelled(found: DataFrame, least: int = PASSAGE) -> DataFrame:
    """``doc_id``, ``lang`` for each language in which a document has a passage of ``least`` words, of documents whose label is missing or
    names another language than the text's, or that have passages in several. ``found``: as identify() gives it."""
    long = F.array_distinct(F.transform(F.filter("runs", lambda r: r["lang"].isNotNull() & (r["n_words"] >= least)), lambda r: r["lang"]))
    d = found.select("doc_id", "label", long.alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("langs")[0] != F.col("label")))
    return d.where(wrong).select("doc_id", F.explode("langs").alias("lang")).distinct()


def _identified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return identify(docs, fit(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(_identified(spark, d))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language (that of most words, null if none is believed) and confidence; documents without text have null and 0."""
    words_in = lambda k: F.aggregate(F.filter("runs", lambda r: r["lang"] == k), F.lit(0), lambda a, r: a + r["n_words"])
    best = F.array_max(F.array(*[F.struct(words_in(k).alias("n"), F.lit(k).alias("lang")) for k in LANGS]))
    all_words = F.aggregate("runs", F.lit(0), lambda a, r: a + r["n_words"])
    sure = F.aggregate(F.filter("runs", lambda r: r["lang"] == F.col("best.lang")), F.lit(0.0), lambda a, r: a + r["n_words"] * r["confidence"])
    found = _identified(spark, d).select("doc_id", "runs", best.alias("best"), all_words.alias("n"))
    known = F.col("best.n") > 0
    return found.select("doc_id", F.when(known, F.col("best.lang")).alias("lang"), F.when(known, F.round(sure / F.col("n"), 4)).otherwise(0.0).alias("confidence"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.col("r.ord").alias("ord"), F.col("r.lang").alias("lang"), F.col("r.n_words").alias("n_words"), F.round("r.confidence", 4).alias("confidence"))


QUERIES = {"p8_found": p8_found, "p8_documents": p8_documents, "p8_passages": p8_passages}
SQL: dict[str, str] = {}
