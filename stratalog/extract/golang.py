"""Top-level functions and methods of Go source, with signatures, positions and hashes.

The scan tolerates errors: comments and literals are blanked out, brackets are matched, and each ``func`` outside of all braces
is read as far as it goes. A function whose body does not end before the header of another at the start of a line goes up to there, or to
the end of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import trimmed
from ..operators.entities import ingest, upsert
from ..schemas import FUNCTION, arrow_schema

_BLANKED = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\[^\n]{1,9}?)'", re.S)
_WORD = re.compile(rb"[^\W\d]\w*|[\x80-\xff]+")
_PACKAGE = re.compile(rb"(?m)^[ \t]*package[ \t]+([^\s;]+)")
_TOP = re.compile(rb"[{}]|(?<![\w.])func(?!\w)")
_NEXT = re.compile(rb"\nfunc[ \t]+(?:\([^()\n]*\)[ \t]*)?[^\W\d]\w*[ \t]*[(\[]")
_OPEN, _SHUT = b"([{", b")]}"


def _blank(m: re.Match) -> bytes:
    return re.sub(rb"[^\n]", b" ", m[0])


def _matching(s: bytes, p: int) -> int:
    """Behind the bracket that shuts the one at p; -1 if none does."""
    depth = 0
    for m in re.compile(rb"[()\[\]{}]").finditer(s, p):
        depth += 1 if m[0] in _OPEN else -1
        if not depth:
            return m.end()
    return -1


def _skip(s: bytes, p: int) -> int:
    while p < len(s) and s[p : p + 1] in b" \t\r\n":
        p += 1
    return p


def _receiver(inner: bytes) -> str:
    text = inner.strip().rstrip(b",").strip()
    m = re.match(rb"(?:[^\W\d]\w*\s+)?(.*)\Z", text, re.S)
    return m[1].strip().decode("utf-8", "replace").removeprefix("*") if m else ""


def functions(source: bytes) -> list[dict]:
    """The declarations of a source text, in order; of an empty one none."""
    s = _BLANKED.sub(_blank, source)
    m = _PACKAGE.search(s)
    package = m[1].decode("utf-8", "replace") if m else ""
    out, depth, p = [], 0, 0
    lines_at = lines_to = 0
    while m := _TOP.search(s, p):
        p = m.end()
        if m[0] != b"func":
            depth = max(0, depth + (1 if m[0] == b"{" else -1))
            continue
        if depth:
            continue
        start, q, receiver = m.start(), _skip(s, p), ""
        if s[q : q + 1] == b"(":
            end = _matching(s, q)
            if end < 0:
                continue
            receiver, q = _receiver(source[q + 1 : end - 1]), _skip(s, end)
        name = _WORD.match(s, q)
        if not name:
            continue
        q = _skip(s, name.end())
        if s[q : q + 1] == b"[":
            q = _skip(s, max(q, _matching(s, q)))
        if s[q : q + 1] != b"(" or (end := _matching(s, q)) < 0:
            continue
        signature, q = source[q:end], end
        # the result goes up to the body or the line's end; struct{} and interface{} have brackets of their own
        r = q
        while r < len(s) and s[r : r + 1] not in b"{\n":
            if s[r : r + 1] in b"([":
                r = max(r + 1, _matching(s, r))
                continue
            if (w := re.compile(rb"(?:struct|interface)\s*\{").match(s, r)) and not s[r - 1 : r].isalnum():
                r = max(w.end(), _matching(s, w.end() - 1))
                continue
            r += 1
        result = source[q:r].strip()
        if result:
            signature += b" " + result
        body, stop = b"", q + len(source[q:r].rstrip())
        if s[r : r + 1] == b"{":
            stop = _matching(s, r)
            after = _NEXT.search(s, r)
            if after and (stop < 0 or stop > after.start()):
                stop = len(source[: after.start()].rstrip())
            elif stop < 0:
                stop = len(source.rstrip())
            body = source[r:stop]
        text = lambda b: b.decode("utf-8", "replace")
        own = text(name[0])
        lines_to, lines_at = lines_to + s.count(b"\n", lines_at, start), start
        out.append(
            {
                "qualified_name": ".".join(x for x in (package, receiver, own) if x),
                "receiver": receiver,
                "name": own,
                "signature": text(signature),
                "start_byte": start,
                "end_byte": stop,
                "start_line": lines_to + 1,
                "end_line": lines_to + 1 + s.count(b"\n", start, stop),
                "body_hash": hashlib.sha256(body).hexdigest(),
            }
        )
        p = max(p, stop)
    return out


FOUND = f"key string, functions array<{FUNCTION}>"


def _extract(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [functions(t.encode() if isinstance(t, str) else t) if t is not None else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(found, schema.field(1).type)], schema=schema)


def extract(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key`` and ``functions`` of each row of ``files`` (key, content as text or bytes); null and empty contents have none."""
    return files.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(partial(_extract, schema=arrow_schema(FOUND)), FOUND).withColumnRenamed("key", key)


def parsed(files: DataFrame, language: str = "go") -> DataFrame:
    """Parsed files of (path, content): path, language_id, file_hash, functions, ready for ingest(). Unreadable (null) contents are left out."""
    f = files.where(F.col("content").isNotNull() & trimmed("path").isNotNull())
    e = extract(f.select("path", "content").withColumn("file_id", F.col("path")))
    return f.select("path", F.lit(language).alias("language_id"), F.sha2(F.col("content").cast("binary"), 256).alias("file_hash")).join(e.withColumnRenamed("file_id", "path"), "path")


def index(files: DataFrame, seq: int, language: str = "go") -> DataFrame:
    """The index job as one plan: the entities of source files (path, content), extracted and ingested at ``seq``, one row per id. Contents that
    cannot be read (null) are left out; a text in which nothing is found still is a file."""
    return upsert(ingest(parsed(files, language), seq))


def register_udtf(spark: SparkSession, name: str = "extract_go") -> None:
    """SQL: SELECT f.* FROM files, LATERAL extract_go(content) f."""
    fields = FUNCTION[len("struct<") : -1].replace(":", " ")

    @F.udtf(returnType=", ".join(fields.split(",")), useArrow=True)
    class Extract:
        def eval(self, content):
            for f in functions((content or "").encode() if isinstance(content or "", str) else bytes(content)):
                yield tuple(f.values())

    spark.udtf.register(name, Extract)
