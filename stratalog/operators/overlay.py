"""The overlay: declarations as tables, selectors resolved against entities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.lexer import DslError
from ..dsl.parser import Anchor, Flow, Selector, parse
from ..dsl.render import describe
from ..functions.scalars import glob_regex
from ..schemas import ANCHOR, EXACT_CONFIDENCE, SELECTORS, arrow_schema
from .patterns import literal_join


def _anchors(anchors: list[Anchor]) -> list[dict]:
    return [{"ord": i, "kind": a.kind, "str": a.value.str if a.value else None, "int": a.value.int if a.value else None, "float": a.value.float if a.value else None} for i, a in enumerate(anchors)]


def _declarations(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for name, source in zip(*(c.to_pylist() for c in b.columns)):
            try:
                decls = parse(source or "")
            except DslError as e:
                rows.append((name, -1, "error", None, None, None, None, None, None, None, str(e)))
                continue
            for i, d in enumerate(decls):
                if isinstance(d, Selector):
                    rows.append((name, i, "selector", d.name, d.unique, _anchors(d.anchors), None, None, None, None, None))
                elif isinstance(d, Flow):
                    steps = [{"ord": j, "name": s.name, "anchors": _anchors(s.anchors)} for j, s in enumerate(d.steps)]
                    rows.append((name, i, "flow", d.name, None, None, d.description, d.scope, d.risk, steps, None))
                else:
                    rows.append((name, i, type(d).__name__.lower(), getattr(d, "name", None), None, None, None, None, None, None, None))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


DECLARATIONS = f"source_name string, ord int, what string, name string, unique boolean, anchors array<{ANCHOR}>, description string, scope string, risk string, steps array<struct<ord:int,name:string,anchors:array<{ANCHOR}>>>, error string"


def declarations(sources: DataFrame) -> DataFrame:
    """The declarations of source texts (source_name, source), one row each, and one row with ``error`` for a text that is none."""
    return sources.select("source_name", "source").mapInArrow(partial(_declarations, schema=arrow_schema(DECLARATIONS)), DECLARATIONS)


DESCRIBED = "source_name string, resolved_at_kernel_seq long, declarations long, canonical string"


def _described(batches: Iterator[pa.RecordBatch], schema: pa.Schema, seq: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [{"source_name": n, **describe(s or "", seq)} for n, s in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def described(sources: DataFrame, seq: int) -> DataFrame:
    """What the query command answers for each source text: its declarations' number and their canonical text. A text that is no source is an error."""
    return sources.select("source_name", "source").mapInArrow(partial(_described, schema=arrow_schema(DESCRIBED), seq=seq), DESCRIBED)


def load(sources: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Selectors and flows of source texts; of the same name the last by (source_name, place) counts. strict: an error in any text is raised."""
    d = declarations(sources)
    if strict and (bad := d.where("what = 'error'").select("source_name", "error").first()):
        raise DslError(f"{bad[0]}: {bad[1]}")
    last = lambda what, cols: d.where(F.col("what") == what).groupBy("name").agg(F.max_by(F.struct(*cols), F.struct("source_name", "ord")).alias("v"))
    s = last("selector", ["unique", "anchors"]).select("name", "v.*")
    f = last("flow", ["description", "scope", "risk", "steps"]).select("name", "v.*")
    return s, f


def resolve(selectors: DataFrame, entities: DataFrame, seq: int | None = None) -> DataFrame:
    """One row per selector: the outcome (bound, unresolved), and of the first anchor in order that is an exact qualified name of some
    entity, that entity (the least id), its name, the confidence and the kind of anchor. The ``unique`` flag is carried, not enforced."""
    a = selectors.select("name", F.explode("anchors").alias("a")).where((F.col("a.kind") == "qualified_name") & F.col("a.str").isNotNull())
    a = a.select("name", F.col("a.ord").alias("ord"), F.col("a.str").alias("qualified_name"))
    e = entities.where(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.min("id").alias("id"))
    hit = a.join(e, "qualified_name").groupBy("name").agg(F.min(F.struct("ord", "qualified_name", "id")).alias("m"))
    bound = F.col("m").isNotNull()
    return (
        selectors.select("name", "unique")
        .join(hit, "name", "left")
        .select(
            "name",
            "unique",
            F.when(bound, "bound").otherwise("unresolved").alias("outcome"),
            F.col("m.id").alias("entity_id"),
            F.col("m.qualified_name").alias("qualified_name"),
            F.when(bound, EXACT_CONFIDENCE).alias("confidence"),
            F.when(bound, "qualified_name").alias("via_anchor"),
            F.when(bound, 1).otherwise(0).alias("n_matches"),
            F.lit(seq).cast("long").alias("resolved_at"),
        )
    )


def resolve_ladder(selectors: DataFrame, entities: DataFrame) -> DataFrame:
    """Extension: all anchors of the kinds qualified_name, signature_id (an entity's id), body_hash and path_glob are tried. Per selector the
    first anchor with a hit, the number of its matches, the least match, and the outcome: bound (the first anchor, one match),
    reanchored (a later one, one match), ambiguous (several matches), unresolved."""
    a = selectors.select("name", F.explode("anchors").alias("a")).select("name", F.col("a.ord").alias("ord"), F.col("a.kind").alias("kind"), F.col("a.str").alias("str")).where("str is not null")
    e = entities.select("id", "qualified_name", "body_hash", "path")
    parts = []
    for kind, column in (("qualified_name", "qualified_name"), ("signature_id", "id"), ("body_hash", "body_hash")):
        parts.append(a.where(F.col("kind") == kind).join(e.select(F.col(column).alias("str"), F.col("id").alias("entity_id")).dropna(), "str").select("name", "ord", "entity_id"))
    globs = a.where("kind = 'path_glob'").select("name", "ord", "str", glob_regex(F.col("str")).alias("pattern"))
    paths = e.where("path is not null").select("path", F.col("id").alias("entity_id"))
    near = literal_join(globs, F.regexp_extract("str", r"^([^*?]*)", 1), F.regexp_extract("str", r"([^*?]*)$", 1), paths, "path")
    parts.append(near.where(F.rlike("path", F.col("pattern"))).select("name", "ord", "entity_id"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    per = hits.distinct().groupBy("name", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id"))
    first = per.groupBy("name").agg(F.min(F.struct("ord", "n", "entity_id")).alias("m"))
    outcome = F.when(F.col("m").isNull(), "unresolved").when(F.col("m.n") > 1, "ambiguous").when(F.col("m.ord") > 0, "reanchored").otherwise("bound")
    return selectors.select("name").join(first, "name", "left").select("name", outcome.alias("outcome"), F.col("m.ord").alias("anchor_ord"), F.coalesce("m.n", F.lit(0)).cast("long").alias("n_matches"), F.col("m.entity_id").alias("entity_id"))


def list_flows(flows: DataFrame) -> DataFrame:
    return flows.select("name", "scope", "risk", F.size("steps").cast("long").alias("n_steps")).orderBy("name")


def overlay_from_table(spark: SparkSession, selectors: list[tuple[str, list[str]]]) -> DataFrame:
    """Selectors of (name, qualified names in order)."""
    rows = [(n, False, [(i, "qualified_name", q, None, None) for i, q in enumerate(qs)]) for n, qs in selectors]
    return spark.createDataFrame(rows, SELECTORS)
