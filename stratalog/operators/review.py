"""Proposals as an append-only log of submissions and transitions; routing of writes by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def submit(submissions: DataFrame, order: str = "created_at") -> DataFrame:
    """One row per content id (target_layer, kind, payload): the first submission along ``order``, of equals the least author."""
    s = submissions.withColumn("id", ids.proposal_id("target_layer", "kind", "payload"))
    first = F.min(F.struct(order, "author", "target_layer", "kind", "payload")).alias("v")
    return s.groupBy("id").agg(first, F.count(F.lit(1)).alias("n_submissions")).select("id", "v.target_layer", "v.kind", "v.author", "v.payload", F.col(f"v.{order}").alias(order), "n_submissions")


def states(proposals: DataFrame, transitions: DataFrame, default: str = "pending_review") -> DataFrame:
    """Each proposal's state: that of its last transition by seq, the default without any."""
    last = transitions.groupBy("id").agg(F.max_by("state", F.struct("seq", "state")).alias("state"))
    return proposals.join(last, "id", "left").withColumn("state", F.coalesce("state", F.lit(default)))


def unknown(proposals: DataFrame, transitions: DataFrame) -> DataFrame:
    """Ids of transitions without a proposal, which a single write would refuse."""
    return transitions.select("id").distinct().join(proposals.select("id"), "id", "left_anti")


def listed(proposals: DataFrame, state: str = "") -> DataFrame:
    p = proposals.where(F.col("state") == state) if state else proposals
    return p.orderBy("created_at", "id")


def get(proposals: DataFrame, transitions: DataFrame, asked: DataFrame) -> DataFrame:
    """The proposals of the asked ids (a column ``id``) with their states; an id that is not there has no row (see unknown())."""
    return states(proposals.join(asked.select("id").dropna().distinct(), "id", "left_semi"), transitions)


def route(writes: DataFrame, rules: DataFrame) -> DataFrame:
    """``writes`` (layer, source) with ``route``: the action of the rule (layer, source, action) for the source or for its class (what
    stands before the colon); forbidden before review before direct; review where no rule fits."""
    weight = F.when(F.col("action") == "forbidden", 3).when(F.col("action") == "review", 2).otherwise(1)
    r = rules.groupBy("layer", "source").agg(F.max(weight).alias("w"))
    own = r.select("layer", "source", F.col("w").alias("own"))
    group = r.select("layer", F.col("source").alias("class"), F.col("w").alias("of_class"))
    w = writes.withColumn("class", F.substring_index("source", ":", 1)).join(own, ["layer", "source"], "left").join(group, ["layer", "class"], "left")
    best = F.greatest("own", "of_class")
    return w.withColumn("route", F.when(best == 3, "reject").when(best == 1, "commit").otherwise("proposal")).drop("class", "own", "of_class")


def conflicts(proposals: DataFrame, target: str) -> DataFrame:
    """Proposals that share a target: each with the class they form (its least id) and the number of others in it. Pairs are not listed."""
    n = proposals.where(F.col(target).isNotNull()).groupBy(target).agg(F.min("id").alias("class_id"), (F.count_distinct("id") - 1).alias("n_others")).where("n_others > 0")
    return proposals.select("id", target).distinct().join(n, target).select("id", target, "class_id", "n_others")


def promote(proposals: DataFrame, least: float) -> DataFrame:
    """Extension: who decides on a proposal (mode, confidence): human_only always a person; policy_only the confidence alone; hybrid a person below ``least``."""
    sure = F.col("confidence") >= least
    verdict = F.when(F.col("mode") == "human_only", "human").when(sure, "promote").when(F.col("mode") == "policy_only", "reject").otherwise("human")
    return proposals.withColumn("decision", verdict)
