"""Queries over the overlay, diffs, findings and proposals, with their SQL.

The texts in ``documents`` hold declarations and diffs in fenced blocks; items of the overlay stand in the event log with their anchors.
"""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.keys import norm_id
from ..operators import diff, overlay, review, validate, workspace
from ..operators.events import last_seq
from ..session import table
from . import registry
from .graph_data import OPS


def _fenced(spark, d, mark):
    """The fenced blocks of a kind in the documents: source_name, source."""
    t = table(spark, d, "documents").where(F.col("text").contains("```" + mark))
    blocks = t.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)```{mark}\r?\n(.*?)```"), 1)).alias("i", "source"))
    return blocks.select(F.format_string("%012d/%04d", "doc_id", "i").alias("source_name"), "source")


def dsl_declarations(spark, d):
    """Kinds and names of the declarations in documents."""
    return overlay.declarations(_fenced(spark, d, "gh")).select("source_name", "what", "name")


def dsl_selectors(spark, d):
    """The overlay that the documents' declarations form: the last selector of each name with its first anchor."""
    s, _ = overlay.load(_fenced(spark, d, "gh"))
    return s.select("name", "unique", F.col("anchors")[0]["kind"].alias("kind"), F.col("anchors")[0]["str"].alias("anchor"))


def _selectors(spark, d):
    """Selectors in the event log: of each name the anchors of its last import or update that can be read."""
    e = table(spark, d, "kernel_events").where((F.col("subject_kind") == "Selector") & F.col("kind").isin(*[k for k in OPS if k.startswith("Overlay")]))
    p = e.select("subject_id", "seq", F.from_json("payload", "anchors array<string>").alias("p")).where("p.anchors is not null")
    last = p.groupBy("subject_id").agg(F.max_by("p.anchors", F.struct("seq", F.col("p.anchors"))).alias("a"))
    one = lambda x, i: F.struct(i.cast("int").alias("ord"), F.lit("qualified_name").alias("kind"), x.alias("str"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("double").alias("float"))
    return last.select(F.col("subject_id").alias("name"), F.lit(False).alias("unique"), F.transform("a", one).alias("anchors"))


def _entities(spark, d):
    """Entities with, besides their own names, the names without the number that packages carry."""
    e = table(spark, d, "code_entities").where("kind in ('Function', 'Method')")
    return e.withColumn("qualified_name", F.concat_ws(".", F.regexp_replace(F.substring_index("qualified_name", ".", 1), "[0-9].*$", ""), F.substring_index("qualified_name", ".", -1)))


def selector_resolve(spark, d):
    return overlay.resolve(_selectors(spark, d), _entities(spark, d)).select("name", "outcome", "entity_id", "qualified_name", "confidence", "n_matches")


def _anchor(i, kind, value):
    return F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), value.alias("str"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("double").alias("float"))


def selector_outcomes(spark, d):
    """The ladder over the names of the findings, with one anchor of each kind: the name's end, the whole name if its length is even, the subject's
    id in normal form if it ends in a digit, the body's hash of the least entity of that name, and a glob of the files of a package of that name."""
    q = F.col("subject.qualified_name")
    names = table(spark, d, "findings").where(q.isNotNull()).groupBy(q.alias("name")).agg(F.min(norm_id(F.col("subject.entity_id"))).alias("entity"))
    ents = table(spark, d, "code_entities")
    least = ents.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("name")).agg(F.min_by("body_hash", "id").alias("body"))
    n = names.join(least, "name", "left")
    whole = F.when(F.length("name") % 2 == 0, F.col("name"))
    by_id = F.when(F.col("entity").rlike("[0-9]$"), F.col("entity"))
    glob = F.concat(F.lit("*/**/"), F.substring_index("name", ".", 1), F.lit("/*.go"))
    values = [("qualified_name", F.substring_index("name", ".", -1)), ("qualified_name", whole), ("signature_id", by_id), ("body_hash", F.col("body")), ("path_glob", glob)]
    s = n.select("name", F.lit(False).alias("unique"), F.array(*[_anchor(i, k, v) for i, (k, v) in enumerate(values)]).alias("anchors"))
    return overlay.resolve_ladder(s, ents).select("name", "outcome", "anchor_ord", "n_matches", "entity_id")


def selector_tests(spark, d):
    """Each selector of the documents' declarations against the entities, at the log's last seq: which are bound, and uniquely where they must be."""
    s, _ = overlay.load(_fenced(spark, d, "gh"))
    seq = last_seq(table(spark, d, "kernel_events")).first()[0]
    return workspace.check_selectors(s, _entities(spark, d), seq)


def flow_list_steps(spark, d):
    return overlay.list_flows(table(spark, d, "flows"))


def _diffs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("diff_id"), "text")


def diff_added_lines(spark, d):
    return diff.hunks(_diffs(spark, d))


def diff_function_names(spark, d):
    return diff.function_names(diff.hunks(_diffs(spark, d))).select("diff_id", "path", "line_ord", "name")


def _new_files(spark, d):
    """Each parsed file as the diff that adds it."""
    p = table(spark, d, "parsed_files").where("path is not null and content is not null").select("file_id", "path", "content")
    return p.select(F.col("file_id").alias("diff_id"), F.concat(F.lit("+++ b/"), "path", F.lit("\n+"), F.replace("content", F.lit("\n"), F.lit("\n+"))).alias("text"))


def touched_entities(spark, d):
    return validate.touched(_new_files(spark, d), table(spark, d, "code_entities"))


def _covering(spark, d):
    """Selectors for the scopes of flows: the least name under which the findings know a function of the flow."""
    f = table(spark, d, "findings").select(F.col("subject.flow").alias("flow"), F.col("subject.qualified_name").alias("qualified_name")).dropna()
    known = f.join(table(spark, d, "code_entities").where("kind in ('Function', 'Method')").select("qualified_name"), "qualified_name", "left_semi")
    least = known.groupBy("flow").agg(F.min("qualified_name").alias("q"))
    one = F.struct(F.lit(0).alias("ord"), F.lit("qualified_name").alias("kind"), F.col("q").alias("str"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("double").alias("float"))
    flows = table(spark, d, "flows").select(F.col("name").alias("flow"), "scope")
    return flows.join(least, "flow").select(F.col("scope").alias("name"), F.lit(False).alias("unique"), F.array(one).alias("anchors"))


def _validated(spark, d):
    return validate.validate_diffs(_new_files(spark, d), table(spark, d, "code_entities"), _covering(spark, d), table(spark, d, "flows"))


def validate_flow_findings(spark, d):
    """Findings of the diffs that add the parsed files against the flows, the whole pipeline."""
    f = _validated(spark, d)
    return f.select("diff_id", "id", "kind", "severity", F.col("subject.flow").alias("flow"), F.col("subject.qualified_name").alias("qualified_name"), F.col("subject.entity_id").alias("entity_id"), F.col("evidence")[0]["detail"].alias("detail"), F.col("subject.entity_kind").alias("entity_kind"), F.col("evidence")[0]["kind"].alias("evidence"), F.size("repair").cast("long").alias("n_repair"))


def finding_summary(spark, d):
    return validate.summary(_new_files(spark, d), _validated(spark, d))


def findings_json(spark, d):
    """The delivered findings as lines of JSON."""
    f = table(spark, d, "findings").select("id", "kind", "severity", "validation_seq", "subject", "evidence").distinct()
    return validate.as_json(f, "id")


def finding_labels(spark, d):
    """Labels, kind:flow, of the findings that validation gives, and how many there are of each."""
    return validate.labels(_validated(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def bench_scenario(spark, d):
    """The files as a scenario's diffs, of which a finding for each flow of high risk is expected: the four scores."""
    expected = table(spark, d, "flows").where("risk = 'high'").select(F.lit("flow_unreviewed").alias("kind"), F.col("name").alias("flow"))
    return validate.run_scenario("files", _new_files(spark, d), table(spark, d, "code_entities"), _covering(spark, d), table(spark, d, "flows"), expected)[1]


def workspace_status(spark, d):
    s, f = _selectors(spark, d), table(spark, d, "flows")
    return workspace.status(table(spark, d, "kernel_events"), table(spark, d, "code_entities"), s, f, review.states(*_proposals(spark, d)))


def workspace_layers(spark, d):
    return workspace.layers(registry.catalogue(spark, registry.STARTER), table(spark, d, "kernel_events"))


def proposal_get(spark, d):
    """Proposals by the ids that the events at even places of the log name."""
    asked = table(spark, d, "kernel_events").where("subject_kind = 'Proposal' and seq % 2 = 0").select(F.col("subject_id").alias("id"))
    return review.get(*_proposals(spark, d), asked).select("id", "state", "created_at")


def proposal_promote(spark, d):
    """Who decides on each proposal, with a mode and a confidence taken from its place in the log."""
    p, _ = _proposals(spark, d)
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("created_at") % len(MODES) + 1).cast("int"))
    return review.promote(p.select("id", mode.alias("mode"), ((F.col("created_at") % 10) / 10).alias("confidence")), LEAST_SURE).select("id", "mode", "decision")


def _flow_sources(spark, d):
    """Each flow written as a source text, behind an import, a comment and a query, and one text with a rule, which is refused."""
    f = table(spark, d, "flows")
    steps = F.array_join(F.transform("steps", lambda x: F.concat(F.lit('  step '), x["name"], F.lit(' targets selector { qualified_name "'), x["name"], F.lit('" weight '), x["ord"].cast("string"), F.lit(' }\n'))), "")
    text = F.concat(
        F.lit('// of the table\nimport "lib/'), "name", F.lit('.gh" as lib\nflow '), "name", F.lit(' {\n  description "'), "description", F.lit('"\n  scope '), "scope", F.lit("\n"), F.coalesce(F.concat(F.lit("  risk "), "risk", F.lit("\n")), F.lit("")), steps, F.lit('}\nquery "all of '), "name", F.lit('" { match x }\n')
    )
    rule = spark.createDataFrame([("rule", "flow F { }\nrule f(x) :- g(x).")], "source_name string, source string")
    return f.select(F.col("name").alias("source_name"), text.alias("source")).unionByName(rule)


def dsl_flows(spark, d):
    """The flows read back from source texts: a row per step, one with nulls where there is none."""
    _, f = overlay.load(_flow_sources(spark, d))
    s = f.select("name", "description", "scope", F.nullif("risk", F.lit("")).alias("risk"), F.explode_outer("steps").alias("s"))
    return s.select("name", "description", "scope", "risk", F.col("s.ord").alias("ord"), F.col("s.name").alias("step"), F.col("s.anchors")[0]["str"].alias("anchor"), F.col("s.anchors")[1]["int"].alias("weight"))


def dsl_kinds(spark, d):
    """What each source text declares, in order, or why it is refused."""
    return overlay.declarations(_flow_sources(spark, d)).select("source_name", F.col("ord").cast("long").alias("ord"), "what", "error")


def dsl_canonical(spark, d):
    """The canonical text of each source text of the documents and of the flows, and what the query command says about it at the log's last seq."""
    seq = last_seq(table(spark, d, "kernel_events")).first()[0]
    return overlay.described(_fenced(spark, d, "gh").unionByName(_flow_sources(spark, d).where("source_name <> 'rule'")), seq)


MODES, LEAST_SURE = ["human_only", "policy_only", "hybrid"], 0.5


def finding_hits(spark, d):
    """Findings of the findings table whose subject is there, per flow: the join on names that validation uses."""
    f = table(spark, d, "findings").select(F.lit(0).alias("diff_id"), F.lit("0" * 16).alias("diff_sha"), F.col("subject.qualified_name").alias("qualified_name"), F.col("subject.flow").alias("flow")).dropna().distinct()
    flows = f.select(F.col("flow").alias("name"), F.concat("flow", F.lit("/"), "qualified_name").alias("scope"))
    s = f.select(F.concat("flow", F.lit("/"), "qualified_name").alias("name"), F.lit(False).alias("unique"), F.array(F.struct(F.lit(0).alias("ord"), F.lit("qualified_name").alias("kind"), F.col("qualified_name").alias("str"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("double").alias("float"))).alias("anchors"))
    touched = f.select("diff_id", "diff_sha", "qualified_name").distinct()
    out = validate.findings(touched, flows, overlay.resolve(s, table(spark, d, "code_entities")))
    return out.select("id", F.col("subject.flow").alias("flow"), F.col("subject.qualified_name").alias("qualified_name"), F.col("subject.entity_id").alias("entity_id"))


def bench_detection_score(spark, d):
    """Per severity: of the flows, those with a finding."""
    f = table(spark, d, "findings").where("severity is not null and subject.flow is not null")
    observed = f.select("severity", "kind", F.col("subject.flow").alias("flow"))
    expected = f.select("severity", "kind").distinct().join(table(spark, d, "flows").select(F.col("name").alias("flow"), F.col("risk").alias("severity")), "severity")
    return validate.detection_score(expected, observed, ["severity"])


def _submissions(spark, d):
    e = table(spark, d, "kernel_events").where("kind = 'ProposalSubmitted'").dropDuplicates(["seq"])
    return e.select(F.lit("semantic.overlay").alias("target_layer"), F.lit("selector").alias("kind"), F.col("produced_by").alias("author"), F.coalesce("payload", F.lit("")).alias("payload"), F.col("seq").alias("created_at"))


def proposal_submit_dedupe(spark, d):
    return review.submit(_submissions(spark, d)).select("id", "author", "payload", "created_at", "n_submissions")


def _proposals(spark, d):
    e = table(spark, d, "kernel_events").where("subject_kind = 'Proposal'").dropDuplicates(["seq"])
    p = e.where("kind = 'ProposalSubmitted'").groupBy(F.col("subject_id").alias("id")).agg(F.min("seq").alias("created_at"))
    t = e.where("kind <> 'ProposalSubmitted'").select(F.col("subject_id").alias("id"), "seq", F.when(F.col("kind") == "ProposalAccepted", "accepted").otherwise("rejected").alias("state"))
    return p, t


def proposal_state(spark, d):
    return review.states(*_proposals(spark, d)).select("id", "state", "created_at")


def proposal_list_by_state(spark, d):
    return review.listed(review.states(*_proposals(spark, d)), "pending_review").select("id", "created_at")


def proposal_unknown(spark, d):
    return review.unknown(*_proposals(spark, d))


def proposal_conflicts(spark, d):
    """Selectors of the log whose first anchors lie in the same package."""
    s = _selectors(spark, d).select(F.col("name").alias("id"), F.substring_index(F.col("anchors")[0]["str"], ".", 1).alias("target"))
    return review.conflicts(s, "target")


_SEL = """ov AS (SELECT subject_id AS name, arg_max(CAST(json_extract(payload, '$.anchors') AS VARCHAR[]), seq) AS anchors FROM kernel_events
    WHERE subject_kind = 'Selector' AND kind IN ('OverlayItemImported', 'OverlayItemUpdated', 'OverlayItemRemoved') AND json_valid(payload) AND json_extract(payload, '$.anchors') IS NOT NULL GROUP BY 1)"""
_ENT = "ent AS (SELECT id, regexp_replace(split_part(qualified_name, '.', 1), '[0-9].*$', '') || '.' || split_part(qualified_name, '.', -1) AS qn FROM code_entities WHERE kind IN ('Function', 'Method'))"
_LINES = "raw AS (SELECT doc_id AS diff_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_ord FROM documents)"
_HUNKS = f"""{_LINES}, marked AS (SELECT *, sum(CASE WHEN starts_with(raw, '+++ ') THEN 1 ELSE 0 END) OVER w AS hunk_ord,
    last_value(CASE WHEN starts_with(raw, '+++ ') THEN regexp_replace(regexp_replace(trim(raw), '^\\+\\+\\+ ', ''), '^b/', '') END IGNORE NULLS) OVER w AS path
    FROM raw WHERE starts_with(raw, '+') WINDOW w AS (PARTITION BY diff_id ORDER BY line_ord ROWS UNBOUNDED PRECEDING)),
  hunks AS (SELECT diff_id, CAST(hunk_ord AS BIGINT) AS hunk_ord, path, line_ord, substr(raw, 2) AS line FROM marked WHERE hunk_ord > 0 AND NOT starts_with(raw, '+++'))"""
_M, _F = r"^\s*func\s+\([^)]*\)\s+([A-Z][A-Za-z0-9_]*)\s*\(", r"^\s*func\s+([A-Z][A-Za-z0-9_]*)\s*\("
_FUNCS_OF = f"funcs AS (SELECT *, coalesce(nullif(regexp_extract(line, '{_M}', 1), ''), nullif(regexp_extract(line, '{_F}', 1), '')) AS name FROM hunks)"
_FUNCS = f"{_HUNKS}, {_FUNCS_OF}"
_SUFFIX = "fe AS (SELECT DISTINCT qualified_name, id FROM code_entities WHERE kind IN ('Function', 'Method') AND qualified_name IS NOT NULL)"
_MATCH = "(fe.qualified_name = n.name OR ends_with(fe.qualified_name, '.' || n.name))"
_NEW = "nf AS (SELECT DISTINCT file_id AS diff_id, '+++ b/' || path || chr(10) || '+' || replace(content, chr(10), chr(10) || '+') AS text FROM parsed_files WHERE path IS NOT NULL AND content IS NOT NULL)"
_NEW_FUNCS = _NEW + ", " + _FUNCS.replace("SELECT doc_id AS diff_id, unnest", "SELECT diff_id, unnest").replace("FROM documents", "FROM nf")
_TOUCHED = f"{_NEW_FUNCS}, {_SUFFIX}, nm AS (SELECT DISTINCT name FROM funcs WHERE name IS NOT NULL), mt AS (SELECT n.name, fe.qualified_name, fe.id, row_number() OVER (PARTITION BY n.name ORDER BY fe.qualified_name, fe.id) AS r FROM nm n JOIN fe ON {_MATCH}), tch AS (SELECT diff_id, qualified_name, max(id) AS id FROM (SELECT DISTINCT diff_id, name FROM funcs WHERE name IS NOT NULL) JOIN mt USING (name) WHERE r = 1 GROUP BY 1, 2)"
_VALID = f"""{_TOUCHED}, known AS (SELECT subject.flow AS flow, min(subject.qualified_name) AS q FROM findings WHERE subject.flow IS NOT NULL AND subject.qualified_name IN (SELECT qualified_name FROM fe) GROUP BY 1),
  res AS (SELECT f.scope, k.q AS qualified_name, min(e.id) AS entity_id FROM flows f JOIN known k ON k.flow = f.name JOIN code_entities e ON e.qualified_name = k.q GROUP BY 1, 2),
  val AS (SELECT t.diff_id, f.name AS flow, res.qualified_name, res.entity_id, substr(sha256(d.text), 1, 16) AS sha FROM flows f JOIN res ON res.scope = f.scope JOIN tch t ON t.qualified_name = res.qualified_name JOIN nf d ON d.diff_id = t.diff_id)"""

SQL = {
    "selector_resolve": f"""WITH {_SEL}, {_ENT}, a AS (SELECT name, unnest(anchors) AS qn, generate_subscripts(anchors, 1) AS ord FROM ov), e AS (SELECT qn, min(id) AS id FROM ent GROUP BY qn),
      h AS (SELECT a.name, a.qn, e.id, row_number() OVER (PARTITION BY a.name ORDER BY ord) AS r FROM a JOIN e ON e.qn = a.qn)
      SELECT ov.name, CASE WHEN h.id IS NULL THEN 'unresolved' ELSE 'bound' END AS outcome, h.id AS entity_id, h.qn AS qualified_name, CASE WHEN h.id IS NOT NULL THEN CAST(0.97 AS DOUBLE) END AS confidence, CASE WHEN h.id IS NULL THEN 0 ELSE 1 END AS n_matches FROM ov LEFT JOIN h ON h.name = ov.name AND h.r = 1""",
    "selector_outcomes": """WITH n AS (SELECT subject.qualified_name AS name, min(nullif(lower(trim(subject.entity_id, e' \\t')), '')) AS entity FROM findings WHERE subject.qualified_name IS NOT NULL GROUP BY 1), l AS (SELECT qualified_name AS name, arg_min(body_hash, id) AS body FROM code_entities GROUP BY 1),
      h AS (SELECT n.name, 0 AS ord, e.id FROM n JOIN code_entities e ON e.qualified_name = split_part(n.name, '.', -1) UNION SELECT n.name, 1, e.id FROM n JOIN code_entities e ON e.qualified_name = n.name WHERE length(n.name) % 2 = 0
        UNION SELECT n.name, 2, e.id FROM n JOIN code_entities e ON e.id = n.entity WHERE regexp_matches(n.entity, '[0-9]$') UNION SELECT n.name, 3, e.id FROM n JOIN l ON l.name = n.name JOIN code_entities e ON e.body_hash = l.body
        UNION SELECT n.name, 4, e.id FROM n JOIN code_entities e ON regexp_matches(e.path, '^[^/]*/.*/' || split_part(n.name, '.', 1) || '/[^/]*[.]go$')),
      g AS (SELECT name, ord, count(DISTINCT id) AS n, min(id) AS id FROM h GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS r FROM g)
      SELECT n.name, CASE WHEN f.n IS NULL THEN 'unresolved' WHEN f.n > 1 THEN 'ambiguous' WHEN f.ord > 0 THEN 'reanchored' ELSE 'bound' END AS outcome, f.ord AS anchor_ord, coalesce(f.n, 0) AS n_matches, f.id AS entity_id FROM n LEFT JOIN f ON f.name = n.name AND r = 1""",
    "flow_list_steps": "SELECT name, scope, risk, CAST(len(steps) AS BIGINT) AS n_steps FROM flows",
    "diff_added_lines": f"WITH {_HUNKS} SELECT diff_id, hunk_ord, path, line_ord, line FROM hunks",
    "diff_function_names": f"WITH {_FUNCS} SELECT diff_id, path, line_ord, name FROM funcs WHERE name IS NOT NULL",
    "touched_entities": f"WITH {_TOUCHED} SELECT diff_id, qualified_name, id FROM tch",
    "validate_flow_findings": f"WITH {_VALID} SELECT diff_id, 'finding_' || substr(sha256(sha || chr(0) || flow || chr(0) || qualified_name), 1, 8) AS id, 'flow_unreviewed' AS kind, 'medium' AS severity, flow, qualified_name, entity_id, 'touched flow-scoped function ' || qualified_name || ' without acknowledging flow ' || flow AS detail, 'code.core:Function' AS entity_kind, 'flow_touched_without_ack' AS evidence, 0 AS n_repair FROM val",
    "finding_summary": f"WITH {_VALID}, c AS (SELECT diff_id, count(*) AS n FROM val GROUP BY 1) SELECT CASE WHEN trim(coalesce(d.text, ''), e' \\t\\r\\n') = '' THEN '0 findings (empty diff)' ELSE coalesce(c.n, 0) || ' findings' END AS summary, d.diff_id FROM nf d LEFT JOIN c ON c.diff_id = d.diff_id",
    "finding_hits": "WITH f AS (SELECT DISTINCT subject.qualified_name AS q, subject.flow AS flow FROM findings WHERE subject.qualified_name IS NOT NULL AND subject.flow IS NOT NULL), e AS (SELECT qualified_name, min(id) AS id FROM code_entities GROUP BY 1) SELECT 'finding_' || substr(sha256('0000000000000000' || chr(0) || flow || chr(0) || q), 1, 8) AS id, flow, q AS qualified_name, e.id AS entity_id FROM f JOIN e ON e.qualified_name = q",
    "bench_detection_score": """WITH o AS (SELECT DISTINCT severity, kind, subject.flow AS flow FROM findings WHERE severity IS NOT NULL AND subject.flow IS NOT NULL), k AS (SELECT DISTINCT severity, kind FROM o),
      x AS (SELECT DISTINCT k.severity, k.kind, f.name AS flow FROM k JOIN flows f ON f.risk = k.severity), m AS (SELECT x.severity, count(*) AS n, count(o.flow) AS hit FROM x LEFT JOIN o ON o.severity = x.severity AND o.kind = x.kind AND o.flow = x.flow GROUP BY 1),
      s AS (SELECT severity, count(*) AS seen FROM o GROUP BY 1)
      SELECT severity, round(CASE WHEN coalesce(n, 0) > 0 THEN hit / n WHEN coalesce(seen, 0) = 0 THEN 1.0 ELSE 0.0 END, 6) AS detection, CAST(-1 AS DOUBLE) AS repair_quality, CAST(-1 AS DOUBLE) AS repair_execution, CAST(-1 AS DOUBLE) AS final_clean_patch FROM m FULL JOIN s USING (severity)""",
    "proposal_submit_dedupe": "WITH p AS (SELECT DISTINCT seq, produced_by AS author, coalesce(payload, '') AS payload FROM kernel_events WHERE kind = 'ProposalSubmitted') SELECT 'prop_' || substr(sha256('semantic.overlay' || chr(0) || 'selector' || chr(0) || payload), 1, 10) AS id, arg_min(author, seq) AS author, payload, min(seq) AS created_at, count(*) AS n_submissions FROM p GROUP BY payload",
    "proposal_state": "WITH e AS (SELECT DISTINCT ON (seq) * FROM kernel_events WHERE subject_kind = 'Proposal'), p AS (SELECT subject_id AS id, min(seq) AS created_at FROM e WHERE kind = 'ProposalSubmitted' GROUP BY 1), t AS (SELECT subject_id AS id, arg_max(CASE kind WHEN 'ProposalAccepted' THEN 'accepted' ELSE 'rejected' END, seq) AS state FROM e WHERE kind <> 'ProposalSubmitted' GROUP BY 1) SELECT p.id, coalesce(t.state, 'pending_review') AS state, created_at FROM p LEFT JOIN t ON t.id = p.id",
    "proposal_list_by_state": "WITH e AS (SELECT DISTINCT ON (seq) * FROM kernel_events WHERE subject_kind = 'Proposal'), p AS (SELECT subject_id AS id, min(seq) AS created_at FROM e WHERE kind = 'ProposalSubmitted' GROUP BY 1), t AS (SELECT subject_id AS id FROM e WHERE kind <> 'ProposalSubmitted') SELECT id, created_at FROM p WHERE id NOT IN (SELECT id FROM t)",
    "proposal_unknown": "SELECT DISTINCT subject_id AS id FROM kernel_events WHERE subject_kind = 'Proposal' AND kind <> 'ProposalSubmitted' AND subject_id IS NOT NULL AND subject_id NOT IN (SELECT subject_id FROM kernel_events WHERE subject_kind = 'Proposal' AND kind = 'ProposalSubmitted' AND subject_id IS NOT NULL)",
    "proposal_conflicts": f"WITH {_SEL}, s AS (SELECT name AS id, split_part(anchors[1], '.', 1) AS target FROM ov WHERE anchors[1] IS NOT NULL), g AS (SELECT target, min(id) AS class_id, count(*) - 1 AS n_others FROM s GROUP BY 1 HAVING count(*) > 1) SELECT s.id, s.target, g.class_id, g.n_others FROM s JOIN g ON g.target = s.target",
}
_BLOCK = "blk AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)```gh\\r?\\n(.*?)```', 1)) AS source, generate_subscripts(regexp_extract_all(text, '(?s)```gh\\r?\\n(.*?)```', 1), 1) - 1 AS i FROM documents)"
SQL |= {
    "dsl_declarations": f"WITH {_BLOCK} SELECT format('{{:012d}}/{{:04d}}', doc_id, i) AS source_name, 'selector' AS what, regexp_extract(source, 'selector ([A-Za-z_0-9.]+)', 1) AS name FROM blk",
    "dsl_selectors": f"WITH {_BLOCK}, s AS (SELECT format('{{:012d}}/{{:04d}}', doc_id, i) AS src, regexp_extract(source, 'selector ([A-Za-z_0-9.]+)', 1) AS name, source FROM blk) SELECT name, contains(arg_max(source, src), 'unique') AS unique, regexp_extract(arg_max(source, src), 'anchor ([a-z_]+) \"([^\"]*)\"', 1) AS kind, regexp_extract(arg_max(source, src), 'anchor ([a-z_]+) \"([^\"]*)\"', 2) AS anchor FROM s GROUP BY name",
}
_PROPS = "e AS (SELECT DISTINCT ON (seq) * FROM kernel_events WHERE subject_kind = 'Proposal'), p AS (SELECT subject_id AS id, min(seq) AS created_at FROM e WHERE kind = 'ProposalSubmitted' GROUP BY 1), t AS (SELECT subject_id AS id, arg_max(CASE kind WHEN 'ProposalAccepted' THEN 'accepted' ELSE 'rejected' END, seq) AS state FROM e WHERE kind <> 'ProposalSubmitted' GROUP BY 1)"
_SELS = "s AS (SELECT format('{:012d}/{:04d}', doc_id, i) AS src, source, regexp_extract(source, 'selector ([A-Za-z_0-9.]+)', 1) AS name, contains(source, 'unique') AS uniq, regexp_extract(source, 'anchor ([a-z_]+) \"([^\"]*)\"', 1) AS kind, regexp_extract(source, 'anchor ([a-z_]+) \"([^\"]*)\"', 2) AS str FROM blk)"
_STEPS = "list_transform(steps, lambda x: '  step ' || x.name || ' targets selector { qualified_name \"' || x.name || '\" weight ' || x.ord || ' }' || chr(10))"
_LAST = "(SELECT coalesce(max(seq), 0) FROM kernel_events)"
SQL |= {
    "selector_tests": f"WITH {_BLOCK}, {_SELS}, {_ENT}, v AS (SELECT name, arg_max(uniq, src) AS uniq, arg_max(kind, src) AS kind, arg_max(str, src) AS str FROM s GROUP BY 1), c AS (SELECT qn, count(DISTINCT id) AS n FROM ent GROUP BY 1) SELECT name, CASE WHEN c.n IS NULL THEN 'unresolved' ELSE 'bound' END AS outcome, c.qn AS qualified_name, coalesce(c.n, 0) AS n_entities, c.n IS NOT NULL AND (NOT uniq OR c.n = 1) AS passed, {_LAST} AS resolved_at FROM v LEFT JOIN c ON c.qn = v.str AND v.kind = 'qualified_name'",
    "findings_json": "SELECT id, CAST(to_json({'id': id, 'kind': kind, 'severity': severity, 'validation_seq': validation_seq, 'subject': subject, 'evidence': evidence}) AS VARCHAR) AS json FROM (SELECT DISTINCT id, kind, severity, validation_seq, subject, evidence FROM findings)",
    "finding_labels": f"WITH {_VALID} SELECT 'flow_unreviewed:' || flow AS label, count(*) AS n FROM val GROUP BY 1",
    "bench_scenario": f"WITH {_VALID}, x AS (SELECT DISTINCT name AS flow FROM flows WHERE risk = 'high'), m AS (SELECT count(*) AS n, count(*) FILTER (flow IN (SELECT flow FROM val)) AS hit, (SELECT count(*) FROM val) AS seen FROM x) SELECT 'files' AS scenario, round(CASE WHEN n > 0 THEN hit / n WHEN seen = 0 THEN 1.0 ELSE 0.0 END, 6) AS detection, CAST(-1 AS DOUBLE) AS repair_quality, CAST(-1 AS DOUBLE) AS repair_execution, CAST(-1 AS DOUBLE) AS final_clean_patch FROM m",
    "workspace_status": f"WITH {_SEL}, {_PROPS} SELECT {_LAST} AS last_seq, (SELECT count(DISTINCT seq) FROM kernel_events) AS events, (SELECT count(DISTINCT id) FROM code_entities) AS entities, (SELECT count(*) FROM ov) AS selectors, (SELECT count(DISTINCT name) FROM flows) AS flows, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM t)) AS pending",
    "workspace_layers": "SELECT name, '0.1.0' AS version, deps AS depends_on, count(DISTINCT seq) AS n_events, max(seq) AS last_seq FROM (VALUES " + ", ".join(f"('{m.name}', '{','.join(m.depends_on)}')" for m in registry.STARTER) + ") t(name, deps) LEFT JOIN kernel_events e ON e.layer = name GROUP BY ALL",
    "proposal_get": f"WITH {_PROPS} SELECT p.id, coalesce(t.state, 'pending_review') AS state, created_at FROM p LEFT JOIN t ON t.id = p.id WHERE p.id IN (SELECT subject_id FROM e WHERE seq % 2 = 0)",
    "proposal_promote": f"WITH {_PROPS}, m AS (SELECT id, list_extract(['human_only', 'policy_only', 'hybrid'], CAST(created_at % 3 AS INT) + 1) AS mode, (created_at % 10) / 10 AS c FROM p) SELECT id, mode, CASE WHEN mode = 'human_only' THEN 'human' WHEN c >= {LEAST_SURE} THEN 'promote' WHEN mode = 'policy_only' THEN 'reject' ELSE 'human' END AS decision FROM m",
    "dsl_flows": "WITH x AS (SELECT name, description, scope, risk, unnest(steps) AS s FROM flows) SELECT name, description, scope, risk, s.ord, s.name AS step, s.name AS anchor, CAST(s.ord AS BIGINT) AS weight FROM x UNION ALL SELECT name, description, scope, risk, NULL, NULL, NULL, NULL FROM flows WHERE coalesce(len(steps), 0) = 0",
    "dsl_kinds": "SELECT name AS source_name, ord, what, NULL AS error FROM flows, (VALUES (0, 'import'), (1, 'flow'), (2, 'query')) t(ord, what) UNION ALL SELECT 'rule', -1, 'error', 'datalog rules deferred to P3; v0 supports selector/flow/query/import only'",
    "dsl_canonical": f"""WITH {_BLOCK}, {_SELS} SELECT src AS source_name, {_LAST} AS resolved_at_kernel_seq, 1 AS declarations, 'selector ' || name || ' {{' || chr(10) || CASE WHEN uniq THEN '  unique' || chr(10) ELSE '' END || '  anchor ' || kind || ' "' || str || '"' || chr(10) || '}}' || chr(10) AS canonical FROM s
      UNION ALL SELECT name, {_LAST}, 3, 'import "lib/' || name || '.gh" as lib' || chr(10) || chr(10) || 'flow ' || name || ' {{' || chr(10) || CASE WHEN description <> '' THEN '  description "' || description || '"' || chr(10) ELSE '' END || '  scope ' || scope || chr(10) || CASE WHEN risk IS NULL THEN '' ELSE '  risk ' || risk || chr(10) END || coalesce(array_to_string({_STEPS}, ''), '') || '}}' || chr(10) || chr(10) || 'query "all of ' || name || '" {{' || chr(10) || 'match x' || chr(10) || '}}' || chr(10) FROM flows""",
}
QUERIES = {k: globals()[k] for k in SQL}
