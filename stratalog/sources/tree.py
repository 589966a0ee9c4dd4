"""Source trees and overlay folders as tables of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a walk passes over, besides those that begin with a dot.
SKIPPED = ("vendor", "node_modules", "bin", "dist")
#: Directories that the driver lists before tasks go on with what lies below.
LISTED = 256


def listed(folder: str, skipped: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Files and directories in ``folder`` by name, without directories that a walk passes over; none if it cannot be listed."""
    try:
        with os.scandir(folder) as it:
            entries = [(e.name, e.is_dir(follow_symlinks=False)) for e in it]
    except OSError:
        return [], []
    return [n for n, is_dir in entries if not is_dir], [n for n, is_dir in entries if is_dir and not n.startswith(".") and n not in skipped]


def walk(root: str, below: str = "", suffix: str = ".go", skipped: tuple[str, ...] = SKIPPED) -> Iterator[str]:
    """Paths with the suffix under ``below`` in ``root``, relative to ``root``. Only names of directories are passed over, the root never."""
    rest = [below]
    while rest:
        at = rest.pop()
        files, dirs = listed(os.path.join(root, at), skipped)
        yield from (os.path.join(at, f) for f in files if f.endswith(suffix))
        rest += [os.path.join(at, d) for d in dirs]


def read_tree(spark: SparkSession, root: str, suffix: str = ".go", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``path``, ``content`` of the files under ``root``, which all executors must see. The driver lists LISTED directories at most, breadth first;
    what lies below the last of them is listed and read in tasks, as are all files. One that cannot be read is left out. (The binaryFile
    source would hide names with _ or .)"""
    files, dirs, n = [], [""], 0
    while dirs and n < LISTED:
        at, n = dirs.pop(0), n + 1
        names, inner = listed(os.path.join(root, at), skipped)
        files += [os.path.join(at, f) for f in names if f.endswith(suffix)]
        dirs += [os.path.join(at, d) for d in inner]

    def names_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"path": pa.array(list(walk(root, d, suffix, skipped)), pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"path": pa.array([p]), "content": pa.array([content], pa.binary())})

    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    found = table(files)
    if dirs:
        found = found.unionByName(table(dirs).repartition(len(dirs)).mapInArrow(names_below, "path string"))
    # spread by a hash of the name, so that a large directory is read by all
    return found.repartition(F.xxhash64("path")).mapInArrow(read, "path string, content binary")


def read_overlay(spark: SparkSession, root: str) -> DataFrame:
    """``source_name``, ``source`` of the declaration files under ``root``; empty if there is no such folder."""
    files = read_tree(spark, root, ".gh", ())
    return files.selectExpr("path AS source_name", "decode(content, 'UTF-8') AS source")


def read_diff(spark: SparkSession, source: str, stdin: str = "") -> DataFrame:
    """``diff_id``, ``text`` of one diff: the file ``source``, or for '' and '-' the text that came by standard input."""
    if source not in ("", "-"):
        with open(source, encoding="utf-8", errors="replace") as f:
            stdin = f.read()
    return spark.createDataFrame([(0, stdin)], "diff_id long, text string")


def find_workspace(start: str, marker: str) -> str | None:
    """The nearest folder from ``start`` upwards that holds the folder ``marker``."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, marker)):
            return at
        parent = os.path.dirname(at)
        if parent == at:
            return None
        at = parent
