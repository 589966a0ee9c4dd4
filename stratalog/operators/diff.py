"""Unified diffs: files, added lines, the functions whose headers they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import WS, diff_path

#: Headers of exported Go methods and functions; white space is that of RE2.
METHOD = rf"^{WS}*func{WS}+\([^)]*\){WS}+([A-Z][A-Za-z0-9_]*){WS}*\("
FUNCTION = rf"^{WS}*func{WS}+([A-Z][A-Za-z0-9_]*){WS}*\("


def hunks(diffs: DataFrame) -> DataFrame:
    """Added lines of each diff (diff_id, text): diff_id, hunk_ord (its file, from 1), path, line_ord, line (without the plus).

    A file begins at a line with +++ and a space; lines that begin with another plus are added ones, but for +++; what stands before the
    first file is of none. Null texts have none. The window is over the lines of one diff.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "raw"))
    header = F.col("raw").startswith("+++ ")
    w = W.partitionBy("diff_id").orderBy("line_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.where(F.col("raw").startswith("+")).withColumn("hunk_ord", F.sum(header.cast("int")).over(w)).withColumn("path", F.last(F.when(header, diff_path("raw")), ignorenulls=True).over(w))
    added = marked.where((F.col("hunk_ord") > 0) & ~F.col("raw").startswith("+++"))
    return added.select("diff_id", F.col("hunk_ord").cast("long").alias("hunk_ord"), "path", F.col("line_ord").cast("long").alias("line_ord"), F.substring("raw", 2, 1 << 30).alias("line"))


def function_names(lines: DataFrame) -> DataFrame:
    """``lines`` (line) that are headers of exported methods or functions, with ``name``. Headers with type parameters are missed."""
    found = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    return lines.withColumn("name", F.coalesce(found(METHOD), found(FUNCTION))).where(F.col("name").isNotNull())
