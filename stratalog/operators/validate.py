"""Validating a change: what it touches, the flows that cover that, and the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .diff import function_names, hunks
from .entities import lookup_suffix
from .overlay import resolve


#: Fixed values of a finding.
KIND, SEVERITY, ENTITY_KIND, EVIDENCE = "flow_unreviewed", "medium", "code.core:Function", "flow_touched_without_ack"
DETAIL = "touched flow-scoped function %s without acknowledging flow %s"


def touched(diffs: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """Per diff the entities whose headers it adds: diff_id, qualified_name, id."""
    names = function_names(hunks(diffs)).select("diff_id", "name").distinct()
    found = lookup_suffix(names.select("name"), entities, mode)
    t = names.join(found, "name")
    # of one name the greatest id, as the last write would have it
    return t.groupBy("diff_id", "qualified_name").agg(F.max("id").alias("id"))


def findings(touched_by: DataFrame, flows: DataFrame, resolved: DataFrame, diff_text: Column | str = "diff_sha") -> DataFrame:
    """A finding for each flow whose scope is bound to a name that a diff touches. touched_by: diff_id, diff_sha, qualified_name. Flows
    without a scope, or with one that is no selector, are passed over. Sorted by diff, flow and name where order matters."""
    scoped = flows.where(F.coalesce("scope", F.lit("")) != "").select(F.col("name").alias("flow"), F.col("scope").alias("name"))
    bound = resolved.where("outcome = 'bound'").select("name", "qualified_name", "entity_id")
    hit = scoped.join(bound, "name").join(touched_by, "qualified_name")
    detail = F.format_string(DETAIL, "qualified_name", "flow")
    return hit.select(
        "diff_id",
        ids.finding_id(diff_text, "flow", "qualified_name").alias("id"),
        F.lit(KIND).alias("kind"),
        F.lit(SEVERITY).alias("severity"),
        F.struct(F.lit(ENTITY_KIND).alias("entity_kind"), "entity_id", "qualified_name", "flow").alias("subject"),
        F.array(F.struct(F.lit(EVIDENCE).alias("kind"), detail.alias("detail"))).alias("evidence"),
        F.create_map().cast("map<string,string>").alias("repair"),
    )


def validate_diffs(diffs: DataFrame, entities: DataFrame, selectors: DataFrame, flows: DataFrame, mode: str = "strict", seq: int | None = None) -> DataFrame:
    """Diffs (diff_id, text) to findings: parse, map to entities, match flows, emit. Blank diffs have none."""
    sha = diffs.select("diff_id", ids.diff_sha("text").alias("diff_sha")).distinct()
    t = touched(diffs, entities, mode).join(sha, "diff_id").select("diff_id", "diff_sha", "qualified_name")
    return findings(t, flows, resolve(selectors, entities, seq))


def summary(diffs: DataFrame, found: DataFrame) -> DataFrame:
    """Per diff its number of findings as a sentence; blank diffs are called empty. A diff that is there twice counts once; its text is not shuffled."""
    n = found.groupBy("diff_id").agg(F.count(F.lit(1)).alias("n"))
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")) == ""
    d = diffs.select("diff_id", blank.alias("blank"), F.xxhash64("text").alias("h")).distinct()
    line = F.when(F.col("blank"), F.lit("0 findings (empty diff)")).otherwise(F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" findings")))
    return d.join(n, "diff_id", "left").select("diff_id", line.alias("summary"))


def labels(found: DataFrame) -> DataFrame:
    """Each finding with its label, its kind and flow joined by a colon, by which expected and observed ones are told apart."""
    return found.select("*", F.concat_ws(":", "kind", F.col("subject.flow")).alias("label"))


def run_scenario(scenario: str, diffs: DataFrame, entities: DataFrame, selectors: DataFrame, flows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A benchmark scenario as one plan: its diffs validated, and scored against ``expected`` (kind, flow). The labelled findings, and one
    row with the scores of the four axes."""
    found = labels(validate_diffs(diffs, entities, selectors, flows))
    seen = found.select(F.lit(scenario).alias("scenario"), "kind", F.col("subject.flow").alias("flow"))
    every = found.sparkSession.createDataFrame([(scenario,)], "scenario string")
    score = detection_score(expected.select(F.lit(scenario).alias("scenario"), "kind", "flow"), seen, ["scenario"])
    # neither expected nor observed is full detection
    score = every.join(score, "scenario", "left").withColumns({"detection": F.coalesce("detection", F.lit(1.0))} | {c: F.lit(-1.0) for c in ("repair_quality", "repair_execution", "final_clean_patch")})
    return found, score


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``json``: each row as one line of JSON, nulls included, as a sink of findings, envelopes or lists writes it."""
    return rows.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def detection_score(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: the share of expected (kind, flow) pairs that were observed; where none is expected 1 if none was observed, else 0.
    The other axes are not available (-1)."""
    e = expected.select(*by, "kind", "flow").distinct()
    o = observed.select(*by, "kind", "flow").distinct()
    n = e.join(o.withColumn("hit", F.lit(1)), [*by, "kind", "flow"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_matched"))
    seen = o.groupBy(*by).agg(F.count(F.lit(1)).alias("n_observed"))
    score = F.when(F.coalesce("n_expected", F.lit(0)) > 0, F.col("n_matched") / F.col("n_expected")).otherwise(F.when(F.coalesce("n_observed", F.lit(0)) == 0, 1.0).otherwise(0.0))
    gone = F.lit(-1.0)
    return n.join(seen, by, "full").select(*by, F.round(score, 6).alias("detection"), gone.alias("repair_quality"), gone.alias("repair_execution"), gone.alias("final_clean_patch"))
