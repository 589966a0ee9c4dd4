"""p6: the whole corpus as token ids.

The transducer of ``bpe`` runs over Arrow batches where the rows are read: no shuffle, whole texts. Each Python worker loads the
vocabulary once, from a path that all executors have (``vocabulary``, or the installed public file), and remembers the ids of
short pieces in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import Bpe, Encoder

VOCABULARY = "byte_bpe_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(Bpe.load(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path).encode
    for b in batches:
        ids, lengths = [], [0]
        for text in b.column(1).to_pylist():
            ids.append(np.array(enc(text), dtype=np.int32))
            lengths.append(lengths[-1] + len(ids[-1]))
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    dec = encoder(path).decode
    for b in batches:
        texts = [None if ids is None else "".join(dec(ids)) for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def _verify(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        n, same = [], []
        for text in b.column(1).to_pylist():
            ids = e.encode(text)
            n.append(len(ids))
            same.append("".join(e.decode(ids)) == (text or ""))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["key", "n_tokens", "same"])


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of each row of ``docs`` (doc_id, text); null and empty texts have an empty list. Repeated rows stay
    repeated, other columns are ignored. vocabulary: the path of a rank file."""
    run = partial(_encode, path=vocabulary or public_path(VOCABULARY))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of each row of ``ids`` (doc_id, ids); null for null, empty for an empty list."""
    run = partial(_decode, path=vocabulary or public_path(VOCABULARY))
    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def verify(docs: DataFrame, key: str, vocabulary: str | None = None) -> DataFrame:
    """``key`` (a string column of ``docs``), the number of tokens of the text, and whether they decode to the same text."""
    run = partial(_verify, path=vocabulary or public_path(VOCABULARY))
    return docs.select(key, "text").mapInArrow(run, "key string, n_tokens long, same boolean").withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and texts that are not the same after decoding, per source."""
    v = verify(table(spark, d, "documents"), "source")
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if(~F.col("same")).alias("n_changed"))


QUERIES = {"p6_ids": p6_ids, "p6_totals": p6_totals}
SQL: dict[str, str] = {}
