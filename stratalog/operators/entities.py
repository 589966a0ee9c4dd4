"""Code entities and relations: upsert, lookup, ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.keys import norm_id
from ..functions.scalars import glob_regex, last_segment, normalize_signature
from .patterns import literal_join

COLUMNS = ["kind", "language_id", "qualified_name", "receiver", "path", "body_hash"]


def upsert(rows: DataFrame, order: str = "created_seq") -> DataFrame:
    """One row per id: the columns of the last write along ``order`` (ties: the greater values), the created_seq of the first.
    Rows without an id are none."""
    last = F.max_by(F.struct(*COLUMNS), F.struct(order, *COLUMNS)).alias("v")
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(last, F.min("created_seq").alias("created_seq")).select("id", *[F.col(f"v.{c}").alias(c) for c in COLUMNS], "created_seq")


def count_by_kind(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_match(matches: DataFrame, key: str) -> DataFrame:
    """One match per ``key``: the least by (qualified_name, id)."""
    return matches.groupBy(key).agg(F.min(F.struct("qualified_name", "id")).alias("m")).select(key, F.col("m.qualified_name").alias("qualified_name"), F.col("m.id").alias("id"))


def lookup_exact(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``name`` of ``names`` with the entity of exactly that qualified name."""
    n = names.select("name").dropna().distinct()
    e = entities.select("qualified_name", "id")
    return first_match(n.join(e, n["name"] == e["qualified_name"]), "name")


def lookup_suffix(names: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """``name`` of ``names`` with the entity that has it as its qualified name or as its end behind a dot.

    strict: letter case counts, functions and methods only. compat: the end is matched in any letter case, with _ standing for any
    character and % for any text, and against all kinds. Both are equi-joins on the last segment; compat names with _ or %
    in it, for which that key says nothing, are joined on what they end with behind the last such mark (operators/patterns).
    """
    n = names.select("name").dropna().distinct()
    if mode == "strict":
        e = entities.where(F.col("kind").isin("Function", "Method")).select("qualified_name", "id").dropna()
        cond = (last_segment(n["name"]) == last_segment(e["qualified_name"])) & ((e["qualified_name"] == n["name"]) | e["qualified_name"].endswith(F.concat(F.lit("."), n["name"])))
        return first_match(n.join(e, cond), "name")
    if mode != "compat":
        raise ValueError(f"unknown mode: {mode}")
    e = entities.select("qualified_name", "id").dropna()
    ends = F.ilike(e["qualified_name"], F.concat(F.lit("%."), n["name"]))
    plain = ~last_segment(n["name"]).rlike("[_%\\\\]")
    by_key = n.where(plain).join(e, (F.lower(last_segment(n["name"])) == F.lower(last_segment(e["qualified_name"]))) & (ends | (e["qualified_name"] == n["name"])))
    wild = n.where(~plain).withColumn("tail", F.lower(F.regexp_extract("name", r"([^_%\\\\]*)$", 1)))
    near = literal_join(wild, F.lit(""), F.col("tail"), e.withColumn("low", F.lower("qualified_name")), "low")
    by_pattern = near.where(F.ilike("qualified_name", F.concat(F.lit("%."), "name")) | (F.col("qualified_name") == F.col("name")))
    return first_match(by_key.unionByName(by_pattern.select(*by_key.columns)), "name")


def get(keys: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the asked ``keys`` (a column ``key``, repeated ones once); keys that are not there have none."""
    return keys.select(key).dropna().distinct().join(rows, key)


def attribute_filter(entities: DataFrame, field: str, op: str, value: str) -> DataFrame:
    """Entities whose ``field`` is equal to, begins with or matches the glob ``value`` (op eq, prefix or glob)."""
    c = F.col(field)
    tests = {"eq": lambda: c == value, "prefix": lambda: c.startswith(value), "glob": lambda: F.rlike(c, glob_regex(value))}
    if op not in tests:
        raise ValueError(f"unknown operator: {op}")
    return entities.where(tests[op]())


def distinct_edges(relations: DataFrame) -> DataFrame:
    """Relations as a set of (relation, from_id, to_id) with ids in normal form; rows without an end are none."""
    r = relations.select("relation", norm_id("from_id").alias("from_id"), norm_id("to_id").alias("to_id"))
    return r.dropna().distinct()


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows (one of equals) whose keys are not in ``existing``: what an insert that ignores conflicts would add."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def ingest(files: DataFrame, seq: Column | int) -> DataFrame:
    """The entities of parsed files (path, language_id, file_hash, functions): the file, and each function or method."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    f = files.select(
        ids.file_id("path").alias("id"), F.lit("File").alias("kind"), "language_id", F.col("path").alias("qualified_name"), F.lit(None).cast("string").alias("receiver"), "path", F.col("file_hash").alias("body_hash"), seq.cast("long").alias("created_seq")
    )
    d = files.select("language_id", F.explode("functions").alias("f"))
    is_method = F.coalesce(F.col("f.receiver"), F.lit("")) != ""
    sig = normalize_signature(F.col("f.signature"))
    own = F.when(is_method, ids.method_id("language_id", F.col("f.receiver"), F.col("f.name"), sig)).otherwise(ids.function_id("language_id", F.col("f.qualified_name"), sig))
    d = d.select(
        own.alias("id"),
        F.when(is_method, "Method").otherwise("Function").alias("kind"),
        "language_id",
        F.col("f.qualified_name").alias("qualified_name"),
        F.when(is_method, F.col("f.receiver")).alias("receiver"),
        F.lit(None).cast("string").alias("path"),
        F.col("f.body_hash").alias("body_hash"),
        seq.cast("long").alias("created_seq"),
    )
    return f.unionByName(d)
