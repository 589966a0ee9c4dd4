"""Scalar functions over names, signatures and lists of causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCKING_RISK, OTHER_RISK

#: White space of RE2's \s, which Java's \s exceeds by the vertical tab.
WS = r"[\t\n\f\r ]"


def normalize_signature(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends, behind ( and [ and before ) and ]."""
    t = F.trim(F.regexp_replace(c, WS + "+", " "))
    return F.regexp_replace(F.regexp_replace(t, r"([(\[]) ", "$1"), r" ([)\]])", "$1")


def qualified_name(package: Column | str, receiver: Column | str, name: Column | str) -> Column:
    """package.receiver.name without the parts that are null or empty."""
    part = lambda c: F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat_ws(".", part(package), part(receiver), name)


def bare_receiver(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\*", "")


def signature(params: Column | str, result: Column | str) -> Column:
    """Parameters, and the result behind a space if there is one."""
    p, r = (F.col(c) if isinstance(c, str) else c for c in (params, result))
    return F.when(r.isNull() | (r == ""), p).otherwise(F.concat(p, F.lit(" "), r))


def blocking_risk(freshness: Column | str) -> Column:
    f = F.col(freshness) if isinstance(freshness, str) else freshness
    known = [x for k, v in BLOCKING_RISK.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*known), f), F.lit(OTHER_RISK))


def encode_causes(c: Column | str) -> Column:
    """Numbers with commas between; null for an empty or null list."""
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


def decode_causes(c: Column | str) -> Column:
    """What is no digit is ignored, an empty part is 0; null for null or empty text."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.transform(F.split(c, ","), lambda x: F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(c != "", digits)


def decode_time(c: Column | str, strict: bool = False) -> Column:
    """A time in RFC 3339 with any number of fractional digits and an offset or Z, as a struct: ``micros`` since 1970 (what is beyond a microsecond is cut
    off) and ``nanos`` (0 to 999, of the cut-off rest the first three digits). Null for null and for what is no such time, or with strict an error."""
    c = F.col(c) if isinstance(c, str) else c
    shape = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)$"
    part = lambda i: F.regexp_extract(c, shape, i)
    digits = F.rpad(F.substring(part(3), 1, 9), 9, "0")
    whole = F.concat(part(1), F.lit(" "), part(2), F.upper(part(4))).try_cast("timestamp")
    told = F.struct((F.unix_micros(whole) + F.substring(digits, 1, 6).cast("long")).alias("micros"), F.substring(digits, 7, 3).cast("int").alias("nanos"))
    good = F.rlike(c, F.lit(shape)) & whole.isNotNull()
    out = F.when(good, told)
    return F.when(c.isNotNull() & ~good, F.raise_error(F.concat(F.lit("no time: "), c))).otherwise(out) if strict else out


def diff_path(line: Column | str) -> Column:
    """The path of a +++ line: without the mark and one leading b/."""
    return F.regexp_replace(F.regexp_replace(F.trim(line), r"^\+\+\+ ", ""), r"^b/", "")


def dependency_name(c: Column | str) -> Column:
    """The layer of a dependency, without its version constraint."""
    return F.substring_index(c, "@", 1)


def last_segment(c: Column | str) -> Column:
    return F.substring_index(c, ".", -1)


def glob_regex(glob: Column | str) -> Column:
    """A glob as an anchored regular expression: ** is any text, * and ? are none across /. A str is the glob itself."""
    c = F.lit(glob) if isinstance(glob, str) else glob
    c = F.regexp_replace(c, r"([.+()\[\]{}^$|\\])", r"\\$1")
    for mark, means in ((r"\*\*", "\x01"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", ".*")):
        c = F.regexp_replace(c, mark, means)
    return F.concat(F.lit("^"), c, F.lit("$"))
