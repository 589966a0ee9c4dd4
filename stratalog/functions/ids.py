"""Content-addressed ids, as Column expressions: hashes of parts joined by NUL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(c: Column | str) -> Column:
    """Lower-case hex of a string's UTF-8 or of bytes; null for null."""
    return F.sha2(_col(c).cast("binary"), 256)


def joined(*parts: Column | str) -> Column:
    """Parts as bytes with a NUL between each two; null if any part is null."""
    return reduce(lambda a, b: F.concat(a, F.lit(NUL).cast("binary"), b), [_col(p).cast("binary") for p in parts])


def file_id(path: Column | str) -> Column:
    return sha256_hex(path)


def function_id(language: Column | str, qualified_name: Column | str, signature: Column | str) -> Column:
    return sha256_hex(joined(language, qualified_name, signature))


def method_id(language: Column | str, receiver: Column | str, name: Column | str, signature: Column | str) -> Column:
    """The receiver is the bare type name, so methods of like-named types in different packages share their id."""
    return sha256_hex(joined(language, receiver, name, signature))


def type_id(language: Column | str, qualified_name: Column | str) -> Column:
    return sha256_hex(joined(language, qualified_name))


def diff_sha(diff: Column | str) -> Column:
    return F.substring(sha256_hex(diff), 1, 16)


def finding_id(diff: Column | str, flow: Column | str, qualified_name: Column | str) -> Column:
    return F.concat(F.lit("finding_"), F.substring(sha256_hex(joined(diff, flow, qualified_name)), 1, 8))


def proposal_id(layer: Column | str, kind: Column | str, payload: Column | str) -> Column:
    """The author is no part of it: the same proposal by another author is the same."""
    return F.concat(F.lit("prop_"), F.substring(sha256_hex(joined(layer, kind, payload)), 1, 10))


def snapshot_id(layer: Column | str, seq: Column | str, payload: Column | str) -> Column:
    """The seq goes in as eight bytes, least first."""
    le = F.reverse(F.regexp_replace(F.lpad(F.hex(_col(seq).cast("long")), 16, "0"), "(..)", "$1 "))
    # the hex digits of each byte are turned back after the whole is reversed
    le = F.unhex(F.regexp_replace(F.trim(le), "(.)(.) ?", "$2$1"))
    return F.substring(sha256_hex(joined(layer, le, payload)), 1, 16)


def workspace_id(root: Column | str) -> Column:
    return F.substring(sha256_hex(root), 1, 12)
