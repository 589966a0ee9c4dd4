"""Normal forms of the ids that link tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def norm_id(c: Column | str) -> Column:
    """Lower case without surrounding spaces and tabs; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(t != "", t)


def trimmed(c: Column | str) -> Column:
    """Without surrounding spaces and tabs, letter case kept; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c, F.lit(BLANKS))
    return F.when(t != "", t)
