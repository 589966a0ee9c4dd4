"""Queries over the event log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, scalars
from ..operators import events as ev
from ..operators import graph, order, provenance, review
from ..plans import registry
from ..schemas import BLOCKING_RISK, EVENTS, MAX_DEPTH, OTHER_RISK
from ..session import scratch, table
from ..streaming import log

#: Parameters of the queries. AS_OF_SHARE: the place, as a share of the last seq, of what is read as of an earlier place.
AS_OF_SHARE, LAST_N = (2, 5), 1000
LAYERS, KINDS = ["code.core", "semantic.overlay"], ["EntityMaterialized", "OverlayItemUpdated"]
SINCE = "2026-06-01 00:00:00"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kernel_events")


def _once(events: DataFrame) -> DataFrame:
    """Without repeated deliveries, which are alike in every column: so filters and projections come first."""
    return events.dropDuplicates(["seq"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _once(_raw(spark, d))


_LOG = "log AS (SELECT DISTINCT ON (seq) * FROM kernel_events)"


def event_last_seq(spark, d):
    return ev.last_seq(table(spark, d, "kernel_events"))


def event_read_all(spark, d):
    return ev.read_all(_log(spark, d).select("seq", "layer", "kind", "subject_id", "produced_by"))


def _end(spark: SparkSession, d: str) -> int:
    """The last seq of the log, as a place that moves with it."""
    return event_last_seq(spark, d).first()["last_seq"]


def _place(spark: SparkSession, d: str) -> int:
    """An earlier place of the log that moves with it. Known when the plan is made, so that the comparison reaches the scan."""
    a, b = AS_OF_SHARE
    return _end(spark, d) * a // b


def _read_as_of(spark, d, seq):
    return _once(ev.as_of(_raw(spark, d), seq)).select("seq", "layer", "kind", "subject_id", "produced_by")


def event_read_as_of(spark, d):
    return _read_as_of(spark, d, _place(spark, d))


def event_read_as_of_end(spark, d):
    return _read_as_of(spark, d, _end(spark, d))


def event_filter_layer_kind(spark, d):
    return _once(ev.matching(_raw(spark, d), LAYERS, KINDS)).select("seq", "layer", "kind", "subject_id")


def event_times(spark, d):
    """The instants that ts_raw names, in microseconds, and the nanoseconds beyond; where ts is there, whether it says the same."""
    e = _log(spark, d).select("seq", "ts", scalars.decode_time("ts_raw").alias("t"))
    return e.select("seq", "t.micros", F.col("t.nanos").cast("long").alias("nanos"), (F.unix_micros("ts") == F.col("t.micros")).alias("same"))


def event_append(spark, d):
    """The rows of ``events`` as new events behind the log, along (ts, event_id)."""
    new = table(spark, d, "events").select(
        "ts", "event_id", F.lit("source.live").alias("layer"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.nullif(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit("user-1")).alias("tx")
    )
    a = ev.append(new, _end(spark, d), ["ts", "event_id"])
    return a.select("seq", "event_id", "layer", "kind", "payload", "tx")


def snapshot_ids(spark, d):
    """Ids of snapshots: of each event's layer and seq, with its payload as what is frozen."""
    e = _log(spark, d).select("seq", "layer", F.coalesce("payload", F.lit("")).alias("payload"))
    return e.select("seq", ids.snapshot_id("layer", "seq", "payload").alias("id"))


def event_ancestors(spark, d):
    """All that the withdrawals in the log (superseded entities, removed items) go back to by their causes, however far: seq and least number of steps."""
    e = _raw(spark, d)
    edges = e.select(F.col("seq").alias("from_id"), F.explode("causes").alias("to_id")).dropna().distinct().join(e.select(F.col("seq").alias("to_id")).distinct(), "to_id").select(F.lit("cause").alias("relation"), "from_id", "to_id")
    starts = e.where(F.col("kind").isin("EntitySuperseded", "OverlayItemRemoved")).select(F.col("seq").alias("id"))
    return graph.bfs(edges, starts).select(F.col("id").alias("seq"), "depth")


def event_seq_assign(spark, d):
    """The rows of ``events`` numbered by (ts, event_id), behind a log that ends at 100."""
    return order.number_rows(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "seq", 100).select("seq", "event_id")


def event_causes_codec(spark, d):
    e = _log(spark, d).select("seq", scalars.encode_causes("causes").alias("encoded"))
    back = scalars.decode_causes("encoded")
    return e.select("seq", "encoded", F.coalesce(F.size(back), F.lit(0)).cast("long").alias("n"), F.coalesce(F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("total"))


def event_payload_get(spark, d):
    return _log(spark, d).select("seq", F.get_json_object("payload", "$.language_id").alias("language_id"), F.get_json_object("payload", "$.rev").alias("rev"))


def event_subjects(spark, d):
    e = _log(spark, d).select("seq", ev.subject().alias("s"))
    return e.select("seq", F.col("s.layer").alias("layer"), F.col("s.kind").alias("kind"), F.col("s.id").alias("id"))


def event_time_order(spark, d):
    """Events that stand no later in time than the one before them in seq."""
    e = _once(_raw(spark, d).where("ts is not null")).select("seq", F.unix_micros("ts").alias("us"))
    return order.monotonic_violations(e, ["seq"], "us").select("seq")


def event_lineage(spark, d):
    return ev.lineage(table(spark, d, "kernel_events"))


def cursor_upsert(spark, d):
    """Each producer as a subscriber whose last write, by seq, is what it has processed."""
    w = _log(spark, d).select(F.col("produced_by").alias("subscriber_id"), "seq", F.size(F.coalesce("causes", F.array())).cast("long").alias("last_processed_seq"))
    return ev.write_cursors(w, "seq")


def cursor_read_default(spark, d):
    subs = table(spark, d, "kernel_events").select(F.col("layer").alias("subscriber_id")).distinct().unionByName(spark.createDataFrame([("nobody",)], "subscriber_id string"))
    w = _once(_raw(spark, d).where(F.col("layer") != "source.live")).select(F.col("layer").alias("subscriber_id"), "seq", F.col("seq").alias("last_processed_seq"))
    return ev.read_cursors(subs, ev.write_cursors(w, "seq"))


def _state_as_of(spark, d, seq):
    return ev.state_as_of(_raw(spark, d), seq, ["subject_layer", "subject_id"], "kind")


def state_as_of(spark, d):
    return _state_as_of(spark, d, _place(spark, d))


def state_as_of_end(spark, d):
    return _state_as_of(spark, d, _end(spark, d))


def _snapshot_layer(spark, d, seq):
    return _once(ev.snapshot(_raw(spark, d), seq, "code.core")).select("seq", "layer", "kind", "subject_id", "tx")


def snapshot_layer(spark, d):
    return _snapshot_layer(spark, d, _place(spark, d))


def snapshot_layer_end(spark, d):
    return _snapshot_layer(spark, d, _end(spark, d))


def _snapshot_roundtrip(spark, d, seq):
    folder = scratch(spark, "snapshots")
    name = ev.create_snapshot(_log(spark, d), folder, seq, "semantic.overlay")
    return ev.load_snapshot(spark, folder, name).select("seq", "kind", "subject_id", "payload", "tx")


def snapshot_roundtrip(spark, d):
    """The events of a snapshot that was written and read again."""
    return _snapshot_roundtrip(spark, d, _place(spark, d))


def snapshot_roundtrip_end(spark, d):
    return _snapshot_roundtrip(spark, d, _end(spark, d))


def retention_floor(spark, d):
    return ev.retain(_log(spark, d), LAST_N, F.lit(SINCE).cast("timestamp")).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def transactions(spark, d):
    from ..operators.changefeed import transactions as assemble

    return assemble(table(spark, d, "kernel_events"), "seq", "tx")


def blocking_risk(spark, d):
    words = spark.createDataFrame([(w,) for w in [*BLOCKING_RISK, "building", "indexed"]], "freshness string")
    return words.select("freshness", scalars.blocking_risk("freshness").cast("long").alias("risk"))


def _facts(spark, d):
    """Events as facts about their subject: a confidence from 0.50 to 0.99, a freshness word, sources and inputs."""
    words = [*BLOCKING_RISK, "building"]
    fresh = F.element_at(F.array(*map(F.lit, words)), (F.col("seq") % len(words) + 1).cast("int"))
    return _once(_raw(spark, d).where("subject_id is not null")).select(
        "subject_layer", "subject_id", "seq", ((F.col("seq") % 50 + 50) / 100).alias("confidence"), fresh.alias("freshness"), F.array("produced_by").alias("source_class"), F.array(F.concat(F.lit("e"), F.col("seq").cast("string"))).alias("inputs"), F.col("seq").alias("produced_seq")
    )


def fold_provenance(spark, d):
    f = _facts(spark, d)
    keys = ["subject_layer", "subject_id"]
    n = provenance.fold_members(f, keys, "source_class").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources"))
    return provenance.fold(f, keys, "seq").join(n, keys).withColumn("confidence", F.round("confidence", 6))


def fold_provenance_members(spark, d):
    """The sorted unions of the fold as rows, (what, member), and its constituents as rows of what 'constituent' with their seq."""
    f, keys = _facts(spark, d), ["subject_layer", "subject_id"]
    unions = [provenance.fold_members(f, keys, c).select(*keys, F.lit(c).alias("what"), F.col(c).alias("member")) for c in ("source_class", "inputs")]
    parts = f.select(*keys, F.lit("constituent").alias("what"), F.col("seq").cast("string").alias("member"))
    return unions[0].unionByName(unions[1]).unionByName(parts)


def source_disagreement(spark, d):
    """Entities for which the deliveries give different body hashes."""
    return provenance.disagreement(table(spark, d, "code_entities"), ["id"], "body_hash")


def trust_route(spark, d):
    rules = spark.createDataFrame(registry.trust_rules(registry.STARTER), "layer string, source string, action string")
    w = _log(spark, d).select("seq", "layer", F.col("produced_by").alias("source"))
    return review.route(w, rules).groupBy("layer", "source", "route").agg(F.count(F.lit(1)).alias("n"))


def stream_tail_filter(spark, d):
    """The log followed as a stream, filtered, until what is there has been read."""
    out = scratch(spark, "tail")
    q = log.follow(log.subscribe(spark, f"{d}/kernel_events.parquet*", LAYERS, KINDS).select("seq", "layer", "kind"), out, scratch(spark, "tail-at"))
    q.awaitTermination()
    return spark.read.schema("seq long, layer string, kind string").parquet(out).distinct()


def stream_followers(spark, d):
    """Two followers of one log, each with its own layers, checkpoint and output. The first is stopped after what is there and started again, and
    gets nothing twice."""
    parts = []
    for name, layers in (("core", ["code.core"]), ("others", ["semantic.overlay", "source.live"])):
        out, at = scratch(spark, name), scratch(spark, f"{name}-at")
        for _ in range(2):
            log.follow(log.subscribe(spark, f"{d}/kernel_events.parquet*", layers).select("seq", "layer"), out, at).awaitTermination()
        parts.append(spark.read.schema("seq long, layer string").parquet(out).select(F.lit(name).alias("follower"), "seq", "layer"))
    return parts[0].unionByName(parts[1]).groupBy("follower", "seq", "layer").agg(F.count(F.lit(1)).alias("n"))


def stream_sequence(spark, d):
    """The log as a stream of new events, numbered by one writer along their former seq and a hash: each row's number and former seq."""
    out = scratch(spark, "sequenced")
    s = spark.readStream.schema(EVENTS).parquet(f"{d}/kernel_events.parquet*").withColumn("payload", F.col("seq").cast("string"))
    s = s.withColumn("key", F.xxhash64("seq", "ts_raw")).withColumnRenamed("seq", "was")
    log.sequence(s, out, scratch(spark, "sequenced-at"), ["was", "key"]).awaitTermination()
    return log.read_log(spark, out).select("seq", F.col("payload").cast("long").alias("was"))


_SUBJECTS = "f AS (SELECT subject_layer, subject_id, seq, (seq % 50 + 50) / 100.0 AS confidence, list_extract(['live','current','possibly_stale','dirty','stale','unknown','unresolved','building'], CAST(seq % 8 AS INT) + 1) AS freshness, produced_by FROM log WHERE subject_id IS NOT NULL)"
_RISK = "CASE freshness " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BLOCKING_RISK.items()) + f" ELSE {OTHER_RISK} END"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_AT = "(SELECT max(seq) * {} // {} FROM kernel_events)".format(*AS_OF_SHARE)
_RULES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in registry.trust_rules(registry.STARTER))

SQL = {
    "event_last_seq": "SELECT coalesce(max(seq), 0) AS last_seq FROM kernel_events",
    "event_read_all": f"WITH {_LOG} SELECT seq, layer, kind, subject_id, produced_by FROM log",
    "event_read_as_of": f"WITH {_LOG} SELECT seq, layer, kind, subject_id, produced_by FROM log WHERE seq <= {_AT}",
    "event_times": f"WITH {_LOG}, e AS (SELECT seq, ts, epoch_us(CAST(ts_raw AS TIMESTAMPTZ)) AS micros, CAST(substr(rpad(regexp_extract(ts_raw, '\\.([0-9]+)', 1), 9, '0'), 7, 3) AS BIGINT) AS nanos FROM log) SELECT seq, micros, nanos, epoch_us(ts) = micros AS same FROM e",
    "event_append": "SELECT (SELECT max(seq) FROM kernel_events) + row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, 'source.live' AS layer, event_type AS kind, props AS payload, CASE WHEN user_id = 1 THEN '' ELSE 'user-' || user_id END AS tx FROM events",
    "snapshot_ids": f"WITH {_LOG}, e AS (SELECT seq, layer, coalesce(payload, '') AS payload, lpad(to_hex(seq), 16, '0') AS h FROM log) SELECT seq, substr(sha256(unhex(hex(layer) || '00' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '00' || hex(payload))), 1, 16) AS id FROM e",
    "event_ancestors": f"WITH RECURSIVE c AS (SELECT DISTINCT seq, unnest(causes) AS cause FROM kernel_events), s AS (SELECT DISTINCT seq FROM kernel_events WHERE kind IN ('EntitySuperseded', 'OverlayItemRemoved')), k AS (SELECT DISTINCT seq FROM kernel_events), w(seq, depth) AS (SELECT seq, 0 FROM s UNION SELECT c.cause, w.depth + 1 FROM w JOIN c ON c.seq = w.seq JOIN k ON k.seq = c.cause WHERE w.depth < {MAX_DEPTH}) SELECT seq, min(depth) AS depth FROM w WHERE seq NOT IN (SELECT seq FROM s) GROUP BY seq",
    "event_filter_layer_kind": f"WITH {_LOG} SELECT seq, layer, kind, subject_id FROM log WHERE layer IN ({_IN(LAYERS)}) AND kind IN ({_IN(KINDS)})",
    "event_seq_assign": "SELECT 100 + row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events",
    "event_causes_codec": f"WITH {_LOG}, e AS (SELECT seq, CASE WHEN len(causes) > 0 THEN array_to_string(causes, ',') END AS encoded FROM log) SELECT seq, encoded, coalesce(len(string_split(encoded, ',')), 0) AS n, CAST(coalesce(list_sum(CAST(string_split(encoded, ',') AS BIGINT[])), 0) AS BIGINT) AS total FROM e",
    "event_payload_get": f"WITH {_LOG} SELECT seq, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.language_id') END AS language_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.rev') END AS rev FROM log",
    "event_subjects": f"WITH {_LOG} SELECT seq, subject_layer AS layer, CASE WHEN subject_layer IS NOT NULL THEN subject_kind END AS kind, CASE WHEN subject_layer IS NOT NULL THEN subject_id END AS id FROM log",
    "event_time_order": f"WITH {_LOG}, w AS (SELECT seq, ts, lag(ts) OVER (ORDER BY seq) AS p FROM log WHERE ts IS NOT NULL) SELECT seq FROM w WHERE ts <= p",
    "event_lineage": f"WITH {_LOG}, c AS (SELECT seq, kind, unnest(causes) AS cause FROM log) SELECT c.seq, c.kind, c.cause, l.kind AS cause_kind FROM c JOIN log l ON l.seq = c.cause",
    "cursor_upsert": f"WITH {_LOG} SELECT produced_by AS subscriber_id, arg_max(CAST(coalesce(len(causes), 0) AS BIGINT), seq) AS last_processed_seq FROM log GROUP BY 1",
    "cursor_read_default": f"WITH {_LOG}, s AS (SELECT DISTINCT layer AS subscriber_id FROM kernel_events UNION ALL SELECT 'nobody'), w AS (SELECT layer, max(seq) AS m FROM log WHERE layer <> 'source.live' GROUP BY 1) SELECT subscriber_id, coalesce(m, 0) AS last_processed_seq FROM s LEFT JOIN w ON w.layer = s.subscriber_id",
    "state_as_of": f"WITH {_LOG} SELECT subject_layer, subject_id, arg_max(kind, seq) AS kind, max(seq) AS last_seq FROM log WHERE seq <= {_AT} AND subject_layer IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1, 2",
    "snapshot_layer": f"WITH {_LOG} SELECT seq, layer, kind, subject_id, tx FROM log WHERE seq <= {_AT} AND layer = 'code.core'",
    "snapshot_roundtrip": f"WITH {_LOG} SELECT seq, kind, subject_id, payload, tx FROM log WHERE seq <= {_AT} AND layer = 'semantic.overlay'",
    "retention_floor": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY seq DESC) AS rn FROM log) SELECT layer, count(*) AS n, min(seq) AS first_seq FROM r WHERE rn <= {LAST_N} OR ts >= TIMESTAMPTZ '{SINCE}+00' GROUP BY layer",
    "transactions": "SELECT tx, min(seq) AS first_place, max(seq) AS commit_place, count(DISTINCT seq) AS n_changes FROM kernel_events WHERE tx <> '' GROUP BY tx",
    "blocking_risk": f"SELECT freshness, CAST({_RISK} AS BIGINT) AS risk FROM (VALUES {', '.join(f"('{w}')" for w in [*BLOCKING_RISK, 'building', 'indexed'])}) t(freshness)",
    "fold_provenance": f"WITH {_LOG}, {_SUBJECTS} SELECT subject_layer, subject_id, round(min(confidence), 6) AS confidence, arg_max(freshness, CAST({_RISK} AS BIGINT) * 1000000000 - seq) AS freshness, max(seq) AS produced_seq, count(*) AS n_constituents, count(DISTINCT produced_by) AS n_sources FROM f GROUP BY 1, 2",
    "fold_provenance_members": f"WITH {_LOG}, {_SUBJECTS} SELECT DISTINCT subject_layer, subject_id, 'source_class' AS what, produced_by AS member FROM f UNION ALL SELECT subject_layer, subject_id, 'inputs', 'e' || seq FROM f UNION ALL SELECT subject_layer, subject_id, 'constituent', CAST(seq AS VARCHAR) FROM f",
    "source_disagreement": "SELECT id, count(DISTINCT body_hash) AS n_values, min(body_hash) AS least, max(body_hash) AS greatest FROM code_entities WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT body_hash) > 1",
    "trust_route": f"""WITH {_LOG}, r(layer, source, action) AS (VALUES {_RULES}),
      w AS (SELECT l.seq, l.layer, l.produced_by AS source, max(CASE r.action WHEN 'forbidden' THEN 3 WHEN 'review' THEN 2 WHEN 'direct' THEN 1 END) AS a
        FROM log l LEFT JOIN r ON r.layer = l.layer AND (r.source = l.produced_by OR r.source = split_part(l.produced_by, ':', 1)) GROUP BY 1, 2, 3)
      SELECT layer, source, CASE a WHEN 3 THEN 'reject' WHEN 1 THEN 'commit' ELSE 'proposal' END AS route, count(*) AS n FROM w GROUP BY 1, 2, 3""",
    "stream_tail_filter": f"SELECT DISTINCT seq, layer, kind FROM kernel_events WHERE layer IN ({_IN(LAYERS)}) AND kind IN ({_IN(KINDS)})",
    "stream_followers": "SELECT CASE layer WHEN 'code.core' THEN 'core' ELSE 'others' END AS follower, seq, layer, count(*) AS n FROM kernel_events WHERE layer IN ('code.core', 'semantic.overlay', 'source.live') GROUP BY 1, 2, 3",
    "stream_sequence": "SELECT row_number() OVER (ORDER BY seq) AS seq, seq AS was FROM kernel_events",
}
#: The same as of the log's last seq, which grow with the log.
AT_END = ["event_read_as_of", "state_as_of", "snapshot_layer", "snapshot_roundtrip"]
SQL |= {f"{k}_end": SQL[k].replace(f"seq <= {_AT}", "seq <= (SELECT max(seq) FROM kernel_events)") for k in AT_END}
QUERIES = {k: globals()[k] for k in SQL}
