"""p4: source files that do not parse.

Each row's content is parsed in its language by the recursive-descent parsers in ``syntax`` (precedence climbing for
expressions, panic-mode recovery), in Arrow batches, without a shuffle: the table is read once and each row stands for
itself. All errors of a file are kept, with the first one as its cause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .syntax import Errors, check_source, language_of

SCHEMA = "file_id long, repo string, path string, language string, n_errors int, first_line int, first_cause string, errors array<struct<line:int,cause:string>>, too_deep boolean"
#: Errors and files sent on at once, at most, but for a file that has more errors.
SENT_ERRORS, SENT_FILES = 20_000, 10_000


ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))
COLUMNS = {"file_id": pa.int64(), "repo": pa.string(), "path": pa.string(), "language": pa.string(), "n_errors": pa.int32(), "first_line": pa.int32(), "first_cause": pa.string(), "errors": ERRORS, "too_deep": pa.bool_()}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, n_errors = [], 0
        for file_id, repo, path, language_id, content in zip(*(c.to_pylist() for c in b.columns)):
            language = language_of(language_id, path)
            judged = check_source(language, content) if language else Errors()
            found = judged.found
            if rows and (n_errors + len(found) > SENT_ERRORS or len(rows) == SENT_FILES):
                yield _batch(rows)
                rows, n_errors = [], 0
            first = found[0] if found else (None, None)
            rows.append((file_id, repo, path, language, len(found), *first, [{"line": n, "cause": c} for n, c in found], judged.too_deep))
            n_errors += len(found)
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, COLUMNS.values())], list(COLUMNS))


def parse_errors(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (file_id, repo, path, language_id, content): its language, the number of syntax errors,
    line and cause of the first, the errors, and whether one of them is that it is nested too deeply for all of it to be judged.

    ``language`` is language_id in any letter case, or of a null one what the path's extension says; null, and no errors,
    where that is none of the five. Null and blank contents have no errors. Of a file nested too deeply there are
    the errors before that place and of its brackets; JSON is judged whole at any depth.
    Repeated rows stay repeated. Other columns are ignored.
    """
    return files.select("file_id", "repo", "path", "language_id", "content").mapInArrow(_parse, SCHEMA)


def acceptance(parsed: DataFrame) -> DataFrame:
    """Files, files with errors and the accepted share per repository and language; rows delivered twice count once.
    A null repository is a group of its own; rows without a known language are left out."""
    once = parsed.where(F.col("language").isNotNull()).groupBy("repo", "language", "file_id").agg(F.max("n_errors").alias("n"))
    g = once.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum((F.col("n") > 0).cast("long")).alias("n_invalid"))
    return g.withColumn("accepted", F.round(1 - F.col("n_invalid") / F.col("n_files"), 6))


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """One row per error, ``ord`` from 0 in the order of the file; the one of ord 0 is its cause."""
    e = parse_errors(table(spark, d, "parsed_files")).select("file_id", "language", "n_errors", F.posexplode("errors").alias("ord", "e"))
    return e.select("file_id", "language", "n_errors", "ord", "e.line", "e.cause").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return acceptance(parse_errors(table(spark, d, "parsed_files")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors(table(spark, d, "parsed_files")).where("n_errors > 0").select("file_id").distinct()


def p4_deep(spark: SparkSession, d: str) -> DataFrame:
    """Files nested deeper than the parsers' limit, with the errors found all the same."""
    return parse_errors(table(spark, d, "parsed_files")).where("too_deep").select("file_id", "language", "n_errors").distinct()


QUERIES = {"p4_found": p4_found, "p4_errors": p4_errors, "p4_report": p4_report, "p4_deep": p4_deep}
SQL: dict[str, str] = {}
