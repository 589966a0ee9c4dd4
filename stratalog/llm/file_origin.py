"""p3: generated, minified, vendored source files and data saved as code.

Three kinds of evidence mark a path:

* **Content, one file at a time, of any length**: a generator's or importer's declaration in the leading comment (a sentence about generated
  files elsewhere is none), a minifier's layout (most text stands in very long lines, or in long lines almost without white space), or a file that is
  mostly number and blob literals or a lock file.
* **Merkle hashes**: each file's leaf is the hash of its code without comments and white space; a directory's hash is
  combined from its entries, hash(name, hash of the entry), bottom-up. Subtrees and files of some size that stand in
  unrelated repositories are vendored copies. A subtree that makes up more than half of a repository is a fork of it, not a
  copy within it.
* **The path**: directories in which package managers and people put third-party code, names that generators and
  bundlers give.

Directory hashes are made level by level, from the deepest one up: each node, a file or a directory whose hash is known, gives one row to its
parent, hash(name, hash of the node), and what arrives at a directory is combined by exclusive or, before the shuffle already. So no
task holds a directory's entries, however many there are, and every node is shuffled once.

Files that do not parse give no evidence as copies: the same error page in two places is no source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_join
from ..session import cut, table
from .syntax import check_source, language_of

#: Names of directories for third-party code, in full and in any letter case.
VENDOR_DIRS = "vendor|_vendor|vendored|node_modules|bower_components|jspm_packages|third_party|third-party|thirdparty|3rdparty|3rd_party|deps|external|externals|godeps|site-packages|pods|contrib_vendor"
#: Directories for generated code and bundles.
GENERATED_DIRS = "gen|generated|__generated__|autogen|codegen_out"
#: Names that generators give.
GENERATED_NAMES = r"\.pb\.go|\.pb\.gw\.go|_pb2?(_grpc)?\.(py|js|ts|pyi)|_gen\.go|_generated\.\w+|_string\.go|\.gen\.\w+|\.generated\.\w+|\.g\.\w+|\.d\.stub\.ts|\.designer\.\w+|zz_generated\.[^/]*|mock_[^/]*\.go|moc_[^/]*"
MINIFIED_NAMES = r"[.-]min\.(js|mjs|cjs|css|json)|\.bundle\.js|\.chunk\.js|chunk-[^/]*\.js|\.[0-9a-f]{8,}\.js"
DATA_NAMES = r"package-lock\.json|npm-shrinkwrap\.json|composer\.lock|yarn\.lock|pnpm-lock\.yaml|go\.sum|poetry\.lock|cargo\.lock|bindata\.\w+"

_LEAD = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|--[^\n]*|<!--.*?-->|[\"']use strict[\"'];?|\"\"\".*?\"\"\")*", re.S)
_START = r"^[\s/*#!<>;\"'=-]*"
_GENERATED = re.compile(
    _START
    + r"(?:(?:this (?:file|code|module|source) (?:was|is|has been) )?(?:code |file )?"
    r"(?:auto-?generated|(?:automatically|auto|machine)[ -](?:generated|produced|created|written)|generated)\b"
    r"(?=[^\n]*(?:\bby\b|\bfrom\b|\busing\b|\bwith\b|\bfile\b|do not|don't|edit|modif|\bbuild\b)|\s*$)|@generated\b)",
    re.I | re.M,
)
_VENDORED = re.compile(_START + r"(?:(?:this (?:file|code) (?:was|is|has been) )?(?:copied|imported|vendored|taken|ported|adapted)\b(?: [a-z]+)? from\b|upstream:\s*\S+)", re.I | re.M)
_LITERAL = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)\b,?\s?|[\"'`](?=[^\"'`\n]{0,40}\d)[A-Za-z0-9+/=,;:._-]{40,}[\"'`],?|(?:\\x[0-9a-fA-F]{2}){8,}")
_LOCK = re.compile(r'"lockfileVersion"\s*:|^# (?:yarn lockfile|This file is automatically @generated by Cargo)|"integrity"\s*:\s*"sha\d+-[^"]*"(?:.*?"integrity"\s*:\s*"sha\d+-){2}', re.S | re.M)
_COMMENT = re.compile(r"/\*.*?\*/|^[ \t]*(?://|#)[^\n]*", re.S | re.M)

#: Shares from which a layout counts: text in lines longer than LONG_LINE, and text that is literals.
LONG_LINE, LONG_SHARE, LITERAL_SHARE = 200, 0.6, 0.5
#: Long lines that are not indented, almost without white space: their length, and the share of white space and of text in such lines.
WRAPPED_LINE, WRAPPED_SPACE, WRAPPED_SHARE = 60, 0.06, 0.8
#: Literals that make a file of them, at least.
LITERALS = 8
#: Characters of code from which equal files and subtrees are evidence of copying, unless given: shorter ones, such as an empty module, are
#: written alike by chance.
LEAST_CODE = 150
#: Levels of directories whose hashes are made in one job.
LEVELS = 4

#: Texts whose judgement a task remembers.
MOST_JUDGED = 100_000
FEATURES = "path string, repo string, file_id long, h1 long, h2 long, code long, why string"


def mostly_literals(text: str, size: int) -> bool:
    found = _LITERAL.findall(text)
    return len(found) >= LITERALS and sum(map(len, found)) >= LITERAL_SHARE * size or any(len(x) >= LITERAL_SHARE * size for x in found if x[0] in "\"'`\\")


def content_reason(text: str) -> str | None:
    """generated, vendored, minified or data, by the text alone; None if nothing speaks for any."""
    lead = _LEAD.match(text)[0]
    if _GENERATED.search(lead):
        return "generated"
    if _VENDORED.search(lead):
        return "vendored"
    size = len(text.strip())
    if _LOCK.search(text):
        return "data"
    lines = text.splitlines()
    if len(text) > LONG_LINE:
        long = sum(len(x) for x in lines if len(x) > LONG_LINE and not x.lstrip().startswith(("//", "#", "*")))
        if long >= LONG_SHARE * size:
            return "data" if mostly_literals(text, size) else "minified"
    solid = "".join(text.split())
    # literals are looked for only where there are enough digits or quotes for them
    digits = sum(map(solid.count, "0123456789"))
    if digits >= 0.1 * len(solid) or max(map(len, lines), default=0) >= 120:
        if mostly_literals(text, size):
            return "data"
    # a bundle whose lines were wrapped: too dense to have been written by hand
    wrapped = [x for x in lines if len(x) >= WRAPPED_LINE and not x.startswith((" ", "\t", "//", "#", "*", "--"))]
    if len(wrapped) > 1 and sum(map(len, wrapped)) >= WRAPPED_SHARE * size and size - len(solid) - len(lines) <= WRAPPED_SPACE * size:
        return "minified"
    return None


def leaf_of(text: str) -> tuple[int, int, int]:
    """Two halves of the hash of the code without comments and white space, and the code's length."""
    code = "".join(_COMMENT.sub("", text).split())
    return (*signed(xxhash.xxh3_128_intdigest(code)), len(code))


def signed(h: int) -> tuple[int, int]:
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return (a - (1 << 64) if a >> 63 else a), (b - (1 << 64) if b >> 63 else b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    broken: dict[tuple, bool] = {}
    for b in batches:
        rows = []
        for file_id, path, language_id, text in zip(*(c.to_pylist() for c in b.columns)):
            if path is None:
                continue
            repo = path.partition("/")[0]
            if text is None or not text.strip():
                rows.append((path, repo, file_id, None, None, 0, None))
                continue
            h1, h2, code = leaf_of(text)
            language = language_of(language_id, path)
            # the same text again is not parsed again
            key = (language, h1, h2, len(text))
            if key not in broken:
                if len(broken) > MOST_JUDGED:
                    broken.clear()
                broken[key] = bool(language and check_source(language, text).found)
            rows.append((path, repo, file_id, h1, h2, 0 if broken[key] else code, content_reason(text)))
        yield batch_of(rows, {"path": pa.string(), "repo": pa.string(), "file_id": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "code": pa.int64(), "why": pa.string()})


def batch_of(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    by_column = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(by_column, columns.values())], list(columns))


def features(files: DataFrame) -> DataFrame:
    """FEATURES per row of ``files`` (file_id, path, language_id, content): the leaf hash, the length of its code, and what the
    content says. Null and blank contents have no hash and say nothing; rows without a path are left out."""
    return files.select("file_id", "path", "language_id", "content").mapInArrow(_features, FEATURES)


def tree_of(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees with these leaves (path, repo, h1, h2, code; a path once): node, repo, is_dir, h1, h2, code (characters of code
    below), n_files and the parent's ``up`` (null for a repository). Paths are taken as they are; an empty name is a name."""
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    up = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", ""))
    files = cut(leaves.select("repo", F.col("path").alias("node"), F.lit(False).alias("is_dir"), "h1", "h2", "code", F.lit(1).cast("long").alias("n_files"), up("path").alias("up"), depth.alias("depth")))
    most = files.agg(F.max("depth")).first()[0] or 0
    at, made, waiting = files.where(F.col("depth") == most), files, []
    name = F.substring_index("node", "/", -1)
    for level in range(most - 1, -1, -1):
        entry = at.select("repo", "up", "code", "n_files", *[F.xxhash64(F.lit(seed), name, "h1", "h2").alias(h) for seed, h in ((1, "h1"), (2, "h2"))])
        dirs = entry.groupBy("repo", "up").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("code").alias("code"), F.sum("n_files").alias("n_files"))
        dirs = dirs.select("repo", F.col("up").alias("node"), F.lit(True).alias("is_dir"), "h1", "h2", "code", "n_files", up("up").alias("up"), F.lit(level).alias("depth"))
        waiting.append(dirs)
        at = files.where(F.col("depth") == level).unionByName(dirs)
        if len(waiting) == LEVELS or level == 0:
            # the levels of one job share their shuffles
            some = cut(reduce(DataFrame.unionByName, waiting))
            made, waiting = made.unionByName(some), []
            at = files.where(F.col("depth") == level).unionByName(some.where(F.col("depth") == level))
    return made.drop("depth")


def vendored_by_hash(feats: DataFrame, least_code: int = LEAST_CODE) -> DataFrame:
    """``path`` of the files in files or subtrees that stand in two or more unrelated repositories (the first name of the path).

    Of a path that was parsed several times, the last row (by file_id) counts. Paths without content take no part.
    """
    last = feats.where("h1 is not null").groupBy("path", "repo").agg(F.max_by(F.struct("h1", "h2", "code"), F.struct("file_id", "h1", "h2")).alias("f")).select("path", "repo", "f.*")
    nodes = tree_of(last)
    whole = cut(nodes.where(F.col("node") == F.col("repo")).select("repo", F.col("n_files").alias("of"), F.col("n_files").alias("w")))
    # a repository may hold a third of all files
    part = hot_join(nodes.where(F.col("code") >= least_code), whole, ["repo"], "w").where(~F.col("is_dir") | (F.col("n_files") * 2 <= F.col("of")))
    # two repositories at least: the least and the greatest name differ
    shared = part.groupBy("is_dir", "h1", "h2").agg(F.min("repo").alias("a"), F.max("repo").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").drop("a", "z")
    copies = cut(hot_join(part.select("node", "is_dir", "n_files", "h1", "h2"), cut(shared), ["is_dir", "h1", "h2"], "n", "left_semi"))
    as_files = copies.where("not is_dir").select(F.col("node").alias("path"))
    # each file with each directory above it, made of its path alone
    names = F.split("path", "/")
    above = last.where(F.instr("path", "/") > 0).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))).alias("node"))
    within = hot_join(above, copies.where("is_dir").select("node", "n_files"), ["node"], "n_files", "left_semi").select("path")
    return as_files.unionByName(within).distinct()


def path_reason(path: Column) -> Column:
    """What a path says: vendored, generated, minified or data; null if nothing."""
    p = F.lower(path)
    return (
        F.when(p.rlike(rf"(^|/)({VENDOR_DIRS})/"), "vendored")
        .when(p.rlike(rf"(^|/)({GENERATED_DIRS})/") | p.rlike(rf"({GENERATED_NAMES})$") | p.rlike(r"(^|/)(zz_generated\.|mock_)[^/]*\.go$"), "generated")
        .when(p.rlike(rf"({MINIFIED_NAMES})$"), "minified")
        .when(p.rlike(rf"(^|/)({DATA_NAMES})$"), "data")
    )


def not_handwritten(files: DataFrame, entities: DataFrame, least_code: int = LEAST_CODE) -> DataFrame:
    """``path``, ``reason`` (of several the first in the order of the alphabet), one row for each path of ``files`` or of a File row of
    ``entities`` that is not hand-written source. Null and empty paths are none. least_code: from how much code on equal files and subtrees are
    copies; all other rules are for files of any length."""
    feats = cut(features(files))
    by_content = feats.where("why is not null").select("path", F.col("why").alias("reason"))
    by_hash = vendored_by_hash(feats, least_code).withColumn("reason", F.lit("vendored"))
    paths = feats.select("path").unionByName(entities.where(F.col("kind") == "File").select("path")).where("path <> ''").distinct()
    by_path = paths.withColumn("reason", path_reason(F.col("path"))).where("reason is not null")
    return by_content.unionByName(by_hash).unionByName(by_path).groupBy("path").agg(F.min("reason").alias("reason"))


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "parsed_files"), table(spark, d, "code_entities"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("path")


QUERIES = {"p3_found": p3_found, "p3_reasons": p3_reasons}
SQL: dict[str, str] = {}
