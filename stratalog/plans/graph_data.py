"""Queries p1, p2 and p5 over the tables of the code graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_id, trimmed
from ..operators import changefeed, orphans, skew
from ..session import cut, table

REF = ["ref_table", "ref_field", "ref_key", "ref_value"]


def entity_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to entities: REF, ``at`` (the referring row's seq) and ``seen`` (its time). Null and blank ids stay as nulls."""
    rel = table(spark, d, "code_relations").select(
        F.col("edge_id").cast("string").alias("ref_key"),
        F.col("created_seq").alias("at"),
        F.col("observed_at").alias("seen"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("f"), norm_id(c).alias("v")) for c in ("from_id", "to_id")])).alias("r"),
    )
    rel = rel.select(F.lit("code_relations").alias("ref_table"), F.col("r.f").alias("ref_field"), "ref_key", F.col("r.v").alias("ref_value"), "at", "seen")
    fin = table(spark, d, "findings").select(
        F.lit("findings").alias("ref_table"),
        F.lit("subject.entity_id").alias("ref_field"),
        F.col("id").alias("ref_key"),
        norm_id(F.col("subject.entity_id")).alias("ref_value"),
        F.col("validation_seq").alias("at"),
        F.col("created_at").alias("seen"),
    )
    return rel.unionByName(fin)


def cause_refs(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "kernel_events").select("seq", "ts", F.explode("causes").alias("c"))
    return ev.select(
        F.lit("kernel_events").alias("ref_table"),
        F.lit("causes").alias("ref_field"),
        F.col("seq").cast("string").alias("ref_key"),
        F.col("c").cast("string").alias("ref_value"),
        F.col("seq").alias("at"),
        F.col("ts").alias("seen"),
        F.col("c").alias("cause"),
    )


def _orphans(spark: SparkSession, d: str, first: str | None = None) -> DataFrame:
    ents = table(spark, d, "code_entities").select(norm_id("id").alias("id"), "created_seq")
    a = orphans.find_orphans(entity_refs(spark, d), ents, [("ref_value", "id")], "simple", "at", "created_seq", first=first)
    seqs = table(spark, d, "kernel_events").select("seq", F.col("seq").alias("there_at"))
    b = orphans.find_orphans(cause_refs(spark, d), seqs, [("cause", "seq")], "simple", "at", "there_at", first=first).drop("cause")
    return a.unionByName(b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(*REF).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table, field and month in which the referring row was seen ('unknown' without a time)."""
    month = F.coalesce(F.date_format("seen", "yyyy-MM"), F.lit("unknown")).alias("period")
    refs = entity_refs(spark, d).unionByName(cause_refs(spark, d).drop("cause")).dropna(subset=["ref_value"]).select(*REF, month)
    return orphans.orphan_report(refs, _orphans(spark, d).select(*REF, month), ["ref_table", "ref_field", "period"])


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Per table and field the orphans whose target came later, and those whose target never came."""
    kind = F.when(F.col("came").isNull(), "never").otherwise("later").alias("kind")
    return _orphans(spark, d, "came").select(*REF, kind).distinct().groupBy("ref_table", "ref_field", "kind").agg(F.count(F.lit(1)).alias("n"))


def p1_declared(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods that no parsed file declares: references by the composite key (language_id, receiver, qualified_name), whose blank
    parts are nulls, under each match rule in which partly null keys count."""
    e = table(spark, d, "code_entities").where(F.col("kind").isin("Function", "Method"))
    refs = e.select(norm_id("id").alias("id"), norm_id("language_id").alias("language_id"), trimmed("receiver").alias("receiver"), trimmed("qualified_name").alias("qualified_name")).distinct()
    f = table(spark, d, "parsed_files").select(norm_id("language_id").alias("language_id"), F.explode("functions").alias("f"))
    found = f.select("language_id", trimmed("f.receiver").alias("receiver"), trimmed("f.qualified_name").alias("qualified_name"))
    on = [(c, c) for c in ("language_id", "receiver", "qualified_name")]
    rules = [orphans.find_orphans(refs, found, on, rule).select(F.lit(rule).alias("rule"), "id", "language_id", "receiver", "qualified_name") for rule in ("partial", "full")]
    return rules[0].unionByName(rules[1])


_REFS_SQL = """
  ents AS (SELECT lower(trim(id, e' \\t')) AS id, min(created_seq) AS first FROM code_entities WHERE trim(id, e' \\t') <> '' GROUP BY 1),
  refs AS (
    SELECT 'code_relations' AS ref_table, 'from_id' AS ref_field, CAST(edge_id AS VARCHAR) AS ref_key, lower(trim(from_id, e' \\t')) AS ref_value, created_seq AS at, observed_at AS seen FROM code_relations
    UNION ALL SELECT 'code_relations', 'to_id', CAST(edge_id AS VARCHAR), lower(trim(to_id, e' \\t')), created_seq, observed_at FROM code_relations
    UNION ALL SELECT 'findings', 'subject.entity_id', id, lower(trim(subject.entity_id, e' \\t')), validation_seq, created_at FROM findings),
  erefs AS (SELECT r.*, (e.first IS NULL OR e.first > r.at) AS orphan, CASE WHEN e.first IS NULL THEN 'never' ELSE 'later' END AS kind FROM refs r LEFT JOIN ents e ON e.id = r.ref_value WHERE r.ref_value <> ''),
  seqs AS (SELECT DISTINCT seq FROM kernel_events),
  cr AS (SELECT seq, ts, unnest(causes) AS c FROM kernel_events),
  crefs AS (SELECT 'kernel_events' AS ref_table, 'causes' AS ref_field, CAST(cr.seq AS VARCHAR) AS ref_key, CAST(c AS VARCHAR) AS ref_value, cr.seq AS at, ts AS seen, (s.seq IS NULL OR s.seq > cr.seq) AS orphan, CASE WHEN s.seq IS NULL THEN 'never' ELSE 'later' END AS kind FROM cr LEFT JOIN seqs s ON s.seq = cr.c WHERE c IS NOT NULL),
  every AS (SELECT * FROM erefs UNION ALL SELECT * FROM crefs)"""
P1_FOUND_SQL = f"WITH {_REFS_SQL} SELECT DISTINCT ref_table, ref_field, ref_key, ref_value FROM every WHERE orphan"
P1_REPORT_SQL = f"""WITH {_REFS_SQL},
  m AS (SELECT DISTINCT ref_table, ref_field, ref_key, ref_value, orphan, coalesce(strftime(seen AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period FROM every),
  n AS (SELECT ref_table, ref_field, period, count(DISTINCT (ref_key, ref_value)) AS n_refs, count(DISTINCT (ref_key, ref_value)) FILTER (orphan) AS n_orphans FROM m GROUP BY ALL)
  SELECT ref_table, ref_field, period, n_refs, n_orphans FROM n"""

P1_KINDS_SQL = f"WITH {_REFS_SQL} SELECT ref_table, ref_field, kind, count(DISTINCT (ref_key, ref_value)) AS n FROM every WHERE orphan GROUP BY ALL"

_KEY = lambda p: f"nullif(lower(trim({p}language_id, e' \\t')), '') AS language_id, nullif(trim({p}receiver, e' \\t'), '') AS receiver, nullif(trim({p}qualified_name, e' \\t'), '') AS qualified_name"
P1_DECLARED_SQL = f"""WITH r AS (SELECT DISTINCT nullif(lower(trim(id, e' \\t')), '') AS id, {_KEY('')} FROM code_entities WHERE kind IN ('Function', 'Method')),
  u AS (SELECT language_id, unnest(functions) AS f FROM parsed_files), t AS (SELECT DISTINCT {_KEY('').replace('trim(receiver', 'trim(f.receiver').replace('trim(qualified_name', 'trim(f.qualified_name')} FROM u),
  k AS (SELECT *, language_id IS NULL OR receiver IS NULL OR qualified_name IS NULL AS some_null FROM r WHERE language_id IS NOT NULL OR receiver IS NOT NULL OR qualified_name IS NOT NULL),
  o AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE (k.language_id IS NULL OR t.language_id = k.language_id) AND (k.receiver IS NULL OR t.receiver = k.receiver) AND (k.qualified_name IS NULL OR t.qualified_name = k.qualified_name)))
  SELECT 'partial' AS rule, id, language_id, receiver, qualified_name FROM o UNION ALL SELECT 'full', id, language_id, receiver, qualified_name FROM k WHERE some_null OR id IN (SELECT id FROM o WHERE NOT some_null)"""

#: Kinds of changes, fixed by the data's definition.
OPS = {"EntityMaterialized": "insert", "OverlayItemImported": "insert", "OverlayItemUpdated": "update", "EntitySuperseded": "delete", "OverlayItemRemoved": "delete"}


def subject_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes to overlay items and entities: subject_layer, subject_id, place, op, tx. Ids of entities are in lower case;
    overlay items have names, in which case counts, so only blanks around them go."""
    ev = table(spark, d, "kernel_events").where(F.col("kind").isin(*OPS))
    op = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in OPS.items()])
    is_entity = F.col("kind").startswith("Entity")
    return ev.select(
        trimmed("subject_layer").alias("subject_layer"),
        F.when(is_entity, norm_id("subject_id")).otherwise(trimmed("subject_id")).alias("subject_id"),
        changefeed.change_place(F.col("seq"), F.col("payload")).alias("place"),
        op.alias("op"),
        "tx",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """State at the end of the log: the feed is closed, its gaps never fill."""
    s = changefeed.replay(subject_changes(spark, d), ["subject_layer", "subject_id"], closed_log=True, log=log_places(spark, d))
    return s.withColumnRenamed("last_place", "last_seq")


def p2_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of seq that are missing in the log, counting replays as what they stand for."""
    ev = table(spark, d, "kernel_events")
    return changefeed.gaps(ev.select(changefeed.change_place(F.col("seq"), F.col("payload")).alias("place")))


def log_places(spark: SparkSession, d: str) -> DataFrame:
    """place and tx of all rows of the log, whatever they are about."""
    return cut(table(spark, d, "kernel_events").select(changefeed.change_place(F.col("seq"), F.col("payload")).alias("place"), "tx").distinct())


def p2_contiguous(spark: SparkSession, d: str) -> DataFrame:
    """State of a log that still grows: at the contiguous watermark, without open transactions. No place is declared lost."""
    s = changefeed.replay(subject_changes(spark, d), ["subject_layer", "subject_id"], log=log_places(spark, d))
    return s.withColumnRenamed("last_place", "last_seq")


#: Places that must lie behind a gap in the log before it counts as closed, unless given.
HOLD = 1000


def p2_watermark(spark: SparkSession, d: str, hold: int = HOLD) -> DataFrame:
    """An extension, timed by places: the state at the watermark before the first gap with less than ``hold`` places behind it, without
    transactions of which any row lies behind it. A change that comes later than that is missing; see p2_contiguous."""
    log = log_places(spark, d)
    upto = F.lit(changefeed.held_watermark(log, hold).first()[0]).cast("long")
    state = changefeed.fold_changes(changefeed.visible(subject_changes(spark, d), upto, log=log), ["subject_layer", "subject_id"])
    return state.withColumnRenamed("last_place", "last_seq")


def p2_transactions(spark: SparkSession, d: str, hold: int = HOLD) -> DataFrame:
    """Each transaction of the log: first and last place, rows, whether each place between them is known (complete), and whether it shows at the
    watermark of p2_watermark (visible)."""
    log = log_places(spark, d)
    return changefeed.judged_transactions(log, F.lit(changefeed.held_watermark(log, hold).first()[0]).cast("long"))


_PLACES_SQL = """places AS (SELECT *, coalesce(TRY_CAST(trim(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.replay_of') END) AS BIGINT), seq) AS place FROM kernel_events),
  ch AS (SELECT trim(subject_layer, e' \\t') AS subject_layer, CASE WHEN kind LIKE 'Entity%' THEN lower(trim(subject_id, e' \\t')) ELSE trim(subject_id, e' \\t') END AS subject_id, place, tx,
    CASE WHEN kind IN ('EntityMaterialized', 'OverlayItemImported') THEN 'i' WHEN kind = 'OverlayItemUpdated' THEN 'u' ELSE 'd' END AS op
    FROM places WHERE kind IN ('EntityMaterialized', 'OverlayItemImported', 'OverlayItemUpdated', 'EntitySuperseded', 'OverlayItemRemoved') AND subject_id <> '' AND subject_layer <> '')"""
P2_FOUND_SQL = f"""WITH {_PLACES_SQL},
  o AS (SELECT DISTINCT subject_layer, subject_id, place, op FROM ch),
  w AS (SELECT *, max(CASE WHEN op = 'd' THEN place END) OVER k AS last_del FROM o WINDOW k AS (PARTITION BY subject_layer, subject_id)),
  f AS (SELECT *, min(CASE WHEN op = 'i' THEN place END) OVER k AS first_ins FROM w WHERE place > coalesce(last_del, -1) WINDOW k AS (PARTITION BY subject_layer, subject_id))
  SELECT subject_layer, subject_id, max(place) AS last_seq FROM f WHERE place >= first_ins GROUP BY 1, 2"""
P2_WATERMARK_SQL = f"""WITH {_PLACES_SQL}, p AS (SELECT DISTINCT place FROM places WHERE place IS NOT NULL), n AS (SELECT place, lead(place) OVER (ORDER BY place) AS nx FROM p),
  wm AS (SELECT coalesce((SELECT min(place) FROM n WHERE nx > place + 1 AND nx - 1 > (SELECT max(place) FROM p) - {HOLD}), (SELECT max(place) FROM p)) AS w),
  tr AS (SELECT tx FROM places WHERE tx <> '' GROUP BY tx HAVING min(place) <= (SELECT w FROM wm) AND max(place) > (SELECT w FROM wm)),
  o AS (SELECT DISTINCT subject_layer, subject_id, place, op FROM ch WHERE place <= (SELECT w FROM wm) AND coalesce(tx, '') NOT IN (SELECT tx FROM tr)),
  w AS (SELECT *, max(CASE WHEN op = 'd' THEN place END) OVER k AS last_del FROM o WINDOW k AS (PARTITION BY subject_layer, subject_id)),
  f AS (SELECT *, min(CASE WHEN op = 'i' THEN place END) OVER k AS first_ins FROM w WHERE place > coalesce(last_del, -1) WINDOW k AS (PARTITION BY subject_layer, subject_id))
  SELECT subject_layer, subject_id, max(place) AS last_seq FROM f WHERE place >= first_ins GROUP BY 1, 2"""
P2_TRANSACTIONS_SQL = f"""WITH {_PLACES_SQL}, p AS (SELECT DISTINCT place FROM places WHERE place IS NOT NULL), n AS (SELECT place, lead(place) OVER (ORDER BY place) AS nx, row_number() OVER (ORDER BY place) AS nth FROM p),
  wm AS (SELECT coalesce((SELECT min(place) FROM n WHERE nx > place + 1 AND nx - 1 > (SELECT max(place) FROM p) - {HOLD}), (SELECT max(place) FROM p)) AS w),
  t AS (SELECT tx, min(place) AS first_place, max(place) AS commit_place, count(DISTINCT place) AS n_changes FROM places WHERE tx <> '' GROUP BY tx)
  SELECT tx, first_place, commit_place, n_changes, z.nth - a.nth = commit_place - first_place AS complete, commit_place <= (SELECT w FROM wm) AS visible FROM t JOIN n a ON a.place = first_place JOIN n z ON z.place = commit_place"""
P2_CONTIGUOUS_SQL = f"""WITH {_PLACES_SQL}, p AS (SELECT place FROM places WHERE place >= 1 UNION SELECT 0),
  wm AS (SELECT min(place) AS w FROM p WHERE place + 1 NOT IN (SELECT place FROM p)),
  tr AS (SELECT tx FROM places WHERE tx <> '' GROUP BY tx HAVING min(place) <= (SELECT w FROM wm) AND max(place) > (SELECT w FROM wm)),
  o AS (SELECT DISTINCT subject_layer, subject_id, place, op FROM ch WHERE place <= (SELECT w FROM wm) AND coalesce(tx, '') NOT IN (SELECT tx FROM tr)),
  w AS (SELECT *, max(CASE WHEN op = 'd' THEN place END) OVER k AS last_del FROM o WINDOW k AS (PARTITION BY subject_layer, subject_id)),
  f AS (SELECT *, min(CASE WHEN op = 'i' THEN place END) OVER k AS first_ins FROM w WHERE place > coalesce(last_del, -1) WINDOW k AS (PARTITION BY subject_layer, subject_id))
  SELECT subject_layer, subject_id, max(place) AS last_seq FROM f WHERE place >= first_ins GROUP BY 1, 2"""
P2_GAPS_SQL = f"""WITH {_PLACES_SQL}, p AS (SELECT DISTINCT place FROM places WHERE place IS NOT NULL), n AS (SELECT place, lead(place) OVER (ORDER BY place) AS nx FROM p)
  SELECT place + 1 AS gap_from, nx - 1 AS gap_to FROM n WHERE nx > place + 1"""


def per_target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_relations").select("relation", norm_id("to_id").alias("to_id"), norm_id("from_id").alias("from_id"), "edge_id", "created_seq")


def p5_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per (relation, to_id): rows as they stand, edges (distinct edge_id), distinct callers, first and last created_seq."""
    keys = ["relation", "to_id"]
    n = skew.salted_aggregate(
        per_target(spark, d),
        keys,
        {"n_rows": F.count(F.lit(1)), "first_seq": F.min("created_seq"), "last_seq": F.max("created_seq")},
        {"n_rows": F.sum("n_rows"), "first_seq": F.min("first_seq"), "last_seq": F.max("last_seq")},
        distinct=["from_id", "edge_id"],
    )
    return n.select(*keys, "n_rows", F.col("n_edge_id").alias("edges"), F.col("n_from_id").alias("callers"), "first_seq", "last_seq")


P5_KEYS_SQL = """SELECT relation, lower(trim(to_id, e' \\t')) AS to_id, count(*) AS n_rows, count(DISTINCT edge_id) AS edges,
  count(DISTINCT nullif(lower(trim(from_id, e' \\t')), '')) AS callers, min(created_seq) AS first_seq, max(created_seq) AS last_seq
  FROM code_relations WHERE relation IS NOT NULL AND trim(to_id, e' \\t') <> '' GROUP BY 1, 2"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["relation", "to_id"]
    total = table(spark, d, "code_relations").agg(F.count(F.lit(1))).scalar()
    n = skew.salted_aggregate(per_target(spark, d).select(*keys, "edge_id"), keys, {"n_rows": F.count(F.lit(1))}, {"n_rows": F.sum("n_rows")})
    # in whole numbers: 50 * n >= total is a share of 2 %
    return n.where(F.col("n_rows") * 50 >= total).select(*keys)


P5_FOUND_SQL = """SELECT relation, lower(trim(to_id, e' \\t')) AS to_id FROM code_relations WHERE relation IS NOT NULL AND trim(to_id, e' \\t') <> ''
  GROUP BY 1, 2 HAVING 50 * count(*) >= (SELECT count(*) FROM code_relations)"""

QUERIES = {"p1_declared": p1_declared, "p2_transactions": p2_transactions, "p1_found": p1_found, "p1_report": p1_report, "p1_kinds": p1_kinds, "p2_found": p2_found, "p2_gaps": p2_gaps, "p2_watermark": p2_watermark, "p2_contiguous": p2_contiguous, "p5_found": p5_found, "p5_keys": p5_keys}
SQL = {"p1_declared": P1_DECLARED_SQL, "p2_transactions": P2_TRANSACTIONS_SQL, "p1_found": P1_FOUND_SQL, "p1_report": P1_REPORT_SQL, "p1_kinds": P1_KINDS_SQL, "p2_found": P2_FOUND_SQL, "p2_gaps": P2_GAPS_SQL, "p2_watermark": P2_WATERMARK_SQL, "p2_contiguous": P2_CONTIGUOUS_SQL, "p5_found": P5_FOUND_SQL, "p5_keys": P5_KEYS_SQL}
