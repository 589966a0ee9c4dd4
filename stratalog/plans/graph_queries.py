"""Queries over entities, relations and source files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import golang
from ..functions import ids, scalars
from ..functions.keys import norm_id
from ..operators import entities as en
from ..operators import graph
from ..plans import registry
from ..schemas import MAX_DEPTH
from ..session import table

#: Parameters of the queries.
GLOB, PREFIX, DEPTH = "*/pkg/**/*.go", "tarnwerk/", MAX_DEPTH


def _functions(spark, d):
    """The declared functions of distinct (path, content) with their language."""
    f = table(spark, d, "parsed_files").where("path is not null").select("path", F.coalesce(F.lower("language_id"), F.lit("go")).alias("language_id"), F.explode("functions").alias("f"))
    return f.select("path", "language_id", "f.*").distinct()


_FUN = "fun AS (SELECT DISTINCT path, language_id, f.* FROM (SELECT path, coalesce(lower(language_id), 'go') AS language_id, unnest(functions) AS f FROM parsed_files WHERE path IS NOT NULL))"
_SIG = r"regexp_replace(regexp_replace(trim(regexp_replace(signature, '[\t\n\f\r ]+', ' ', 'g')), '([(\[]) ', '\1', 'g'), ' ([)\]])', '\1', 'g')"


def signature_normalize(spark, d):
    return _functions(spark, d).select("signature", scalars.normalize_signature("signature").alias("normal")).distinct()


def qualified_name_build(spark, d):
    package = F.substring_index("qualified_name", ".", 1)
    return _functions(spark, d).select("qualified_name", scalars.qualified_name(package, "receiver", "name").alias("built")).distinct()


def receiver_strip(spark, d):
    r = _functions(spark, d).select(F.concat(F.lit("*"), "receiver").alias("receiver")).distinct()
    return r.select("receiver", scalars.bare_receiver("receiver").alias("bare"))


def signature_assemble(spark, d):
    f = _functions(spark, d)
    params = F.regexp_extract("signature", r"^(\([^()]*\))", 1)
    result = F.trim(F.regexp_replace("signature", r"^\([^()]*\)", ""))
    return f.select("signature", scalars.signature(params, result).alias("built")).distinct()


def entity_file_id(spark, d):
    return table(spark, d, "parsed_files").where("path is not null").select("path").distinct().select("path", ids.file_id("path").alias("id"))


def entity_function_id(spark, d):
    f = _functions(spark, d).where("receiver is null or receiver = ''")
    return f.select("qualified_name", "signature", ids.function_id("language_id", "qualified_name", "signature").alias("id")).distinct()


def entity_method_id(spark, d):
    f = _functions(spark, d).where("receiver <> ''")
    return f.select("receiver", "name", "signature", ids.method_id("language_id", "receiver", "name", "signature").alias("id")).distinct()


def entity_type_id(spark, d):
    e = table(spark, d, "code_entities").where("kind = 'TypeDecl'")
    return e.select("qualified_name", ids.type_id("language_id", "qualified_name").alias("type_id")).distinct()


def body_hashes(spark, d):
    """Hash of each file's content: its own, and as delivered, where both are there."""
    p = table(spark, d, "parsed_files").where("content is not null")
    return p.select("file_id", ids.sha256_hex("content").alias("own"), "file_hash").distinct()


def entity_upsert(spark, d):
    return en.upsert(table(spark, d, "code_entities")).select("id", "kind", "body_hash", "created_seq")


def entity_count_by_kind(spark, d):
    return en.count_by_kind(table(spark, d, "code_entities"))


def _names(spark, d):
    return table(spark, d, "findings").select(F.col("subject.qualified_name").alias("name"))


def entity_lookup_exact(spark, d):
    return en.lookup_exact(_names(spark, d), table(spark, d, "code_entities"))


def entity_lookup_suffix_strict(spark, d):
    return en.lookup_suffix(_names(spark, d).select(scalars.last_segment("name").alias("name")), table(spark, d, "code_entities"))


def entity_lookup_suffix_compat(spark, d):
    names = _names(spark, d).select(F.lower(scalars.last_segment("name")).alias("name"))
    return en.lookup_suffix(names, table(spark, d, "code_entities"), "compat")


def entity_attribute_filter(spark, d):
    e = table(spark, d, "code_entities")
    parts = [("eq", "kind", "TypeDecl"), ("prefix", "path", PREFIX), ("glob", "path", GLOB)]
    out = [en.attribute_filter(e, f, op, v).select(F.lit(op).alias("op"), "id", "created_seq") for op, f, v in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def entity_get(spark, d):
    """Entities by the ids under which the findings name them."""
    asked = table(spark, d, "findings").select(norm_id(F.col("subject.entity_id")).alias("id"))
    return en.get(asked, en.upsert(table(spark, d, "code_entities"))).select("id", "kind", "qualified_name", "created_seq")


def entity_ingest(spark, d):
    """Entities that the parsed files hold, one row per id."""
    p = table(spark, d, "parsed_files").where("path is not null")
    last = p.groupBy("path").agg(F.max_by(F.struct(F.coalesce(F.lower("language_id"), F.lit("go")).alias("language_id"), "file_hash", "functions"), F.struct("file_id")).alias("v")).select("path", "v.*")
    return en.upsert(en.ingest(last, 1)).select("id", "kind", "language_id", "qualified_name", "receiver", "path", "body_hash")


def _go_files(spark, d):
    return table(spark, d, "parsed_files").where((F.lower("language_id") == "go") | (F.col("language_id").isNull() & F.col("path").endswith(".go"))).where("content is not null")


def entity_index(spark, d):
    """The index job over the Go files' contents: extracted, ingested, one row per id."""
    last = _go_files(spark, d).groupBy("path").agg(F.max_by("content", F.struct("file_id", F.xxhash64("content"))).alias("content"))
    return golang.index(last, 1).select("id", "kind", "qualified_name", "receiver", "path", "body_hash")


def id_collisions(spark, d):
    """Ids that methods in several files would share if all methods were called Run: the package of a receiver is no part of a method's id."""
    f = _functions(spark, d).where("receiver <> ''").select(ids.method_id("language_id", "receiver", F.lit("Run"), "signature").alias("id"), "path").distinct()
    return f.groupBy("id").agg(F.count(F.lit(1)).alias("n_paths")).where("n_paths > 1")


def go_functions(spark, d):
    """What the extractor finds in the Go files; a file that was delivered twice counts once, its text is not shuffled."""
    e = golang.extract(_go_files(spark, d).select("file_id", "content"))
    return e.select("file_id", F.explode("functions").alias("f")).select("file_id", "f.*").distinct()


def go_functions_delivered(spark, d):
    """The functions delivered with the Go files, those that the extractor finds too, alike in every field."""
    told = _go_files(spark, d).select(F.col("file_id").cast("string").alias("file_id"), F.explode("functions").alias("f")).select("file_id", "f.*").distinct()
    found = go_functions(spark, d)
    return told.join(found, told.columns, "left_semi")


def relation_insert_ignore(spark, d):
    return en.distinct_edges(table(spark, d, "code_relations"))


def relation_new(spark, d):
    """Edges written in the later half of the log that were not there before."""
    r = table(spark, d, "code_relations")
    half = r.agg(F.max("created_seq")).first()[0] // 2
    old, new = (en.distinct_edges(r.where(c)) for c in (F.col("created_seq") <= half, F.col("created_seq") > half))
    return en.insert_ignore(old, new, ["relation", "from_id", "to_id"])


def _edges(spark, d):
    return en.distinct_edges(table(spark, d, "code_relations"))


def graph_one_hop(spark, d):
    f = table(spark, d, "findings").select(norm_id(F.col("subject.entity_id")).alias("id")).dropna().distinct()
    return graph.one_hop(_edges(spark, d), f)


def graph_bfs(spark, d):
    """What calls lead to from the subjects of findings, within the default number of hops."""
    f = table(spark, d, "findings").select(norm_id(F.col("subject.entity_id")).alias("id"))
    return graph.bfs(_edges(spark, d), f, ["calls"], DEPTH)


def graph_impacted_set(spark, d):
    f = table(spark, d, "findings").where("severity = 'high'").select(norm_id(F.col("subject.entity_id")).alias("id"))
    return graph.impacted(_edges(spark, d), f, (), DEPTH).select("id", "depth", "reason")


def layer_topo_levels(spark, d):
    m = registry.STARTER
    nodes = spark.createDataFrame([(x.name,) for x in m], "name string")
    edges = spark.createDataFrame([(x.name, y) for x in m for y in x.depends_on], "name string, on string")
    return graph.peel_levels(nodes, edges)


def layer_levels_with_cycle(spark, d):
    """The starter layers beside two that need each other and one that needs them: these have no level."""
    m = [(x.name, y) for x in registry.STARTER for y in x.depends_on] + CYCLE
    names = {x.name for x in registry.STARTER} | {a for a, _ in CYCLE}
    return graph.peel_levels(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), spark.createDataFrame(m, "name string, on string"))


def layer_install_order(spark, d):
    names = registry.install_order(registry.STARTER)
    return spark.createDataFrame(list(enumerate(names)), "ord long, name string")


def layer_attribute_types(spark, d):
    """Attribute types of layers and what they are in Spark; null for what is none."""

    def told(t):
        try:
            return registry.spark_type(t)
        except ValueError:
            return None

    return spark.createDataFrame([(t, told(t)) for t in TYPES], "type string, spark_type string")


def dependency_names(spark, d):
    return spark.createDataFrame([(x,) for x in DEPENDENCIES], "dependency string").select("dependency", scalars.dependency_name("dependency").alias("name"))


def workspace_ids(spark, d):
    """Ids of workspaces at the repositories' names."""
    return table(spark, d, "parsed_files").where("repo is not null").select("repo").distinct().select("repo", ids.workspace_id("repo").alias("id"))


CYCLE = [("x.one", "x.two"), ("x.two", "x.one"), ("x.three", "x.one"), ("x.three", "code.core")]
DEPENDENCIES = ["code.core@^0.1", "code.core", "source.live@>=1@2", "", "@x"]
#: Attribute types with their Spark types.
TYPES = {"string": "string", "int": "bigint", " list<path> ": "array<string>", "map<string, list<float>>": "map<string,array<double>>", "list<map<enum,bool>>": "array<map<string,boolean>>", "entity_ref(self)": "string", "opaque_blob": "binary", "entity_ref(code.core)": None, "map<string>": None, "list<uuid>": None, "map<map<string,int>,int>": None, "string int": None, "": None}
_EDGES = "edges AS (SELECT DISTINCT relation, lower(trim(from_id, e' \\t')) AS from_id, lower(trim(to_id, e' \\t')) AS to_id FROM code_relations WHERE trim(from_id, e' \\t') <> '' AND trim(to_id, e' \\t') <> '' AND relation IS NOT NULL)"
_SUBJ = "subj AS (SELECT DISTINCT lower(trim(subject.entity_id, e' \\t')) AS id, severity FROM findings WHERE trim(subject.entity_id, e' \\t') <> '')"
_NAMES = "names AS (SELECT DISTINCT subject.qualified_name AS name FROM findings WHERE subject.qualified_name IS NOT NULL)"
_DEPS = ", ".join(f"('{x.name}', '{y}')" for x in registry.STARTER for y in x.depends_on)
_LAYERS = ", ".join(f"('{x.name}')" for x in registry.STARTER)


def _bfs_sql(relation: str, seeds: str) -> str:
    return f"""s AS (SELECT DISTINCT id FROM subj WHERE {seeds}),
      walk(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.id WHERE {relation} AND w.depth < {DEPTH})"""


SQL = {
    "signature_normalize": f"WITH {_FUN} SELECT DISTINCT signature, {_SIG} AS normal FROM fun",
    "qualified_name_build": f"WITH {_FUN} SELECT DISTINCT qualified_name, concat_ws('.', nullif(split_part(qualified_name, '.', 1), ''), nullif(receiver, ''), name) AS built FROM fun",
    "receiver_strip": f"WITH {_FUN} SELECT DISTINCT '*' || receiver AS receiver, receiver AS bare FROM fun",
    "signature_assemble": rf"WITH {_FUN}, p AS (SELECT signature, regexp_extract(signature, '^(\([^()]*\))', 1) AS a, trim(regexp_replace(signature, '^\([^()]*\)', '')) AS b FROM fun) SELECT DISTINCT signature, CASE WHEN b = '' THEN a ELSE a || ' ' || b END AS built FROM p",
    "entity_file_id": "SELECT DISTINCT path, sha256(path) AS id FROM parsed_files WHERE path IS NOT NULL",
    "entity_function_id": f"WITH {_FUN} SELECT DISTINCT qualified_name, signature, sha256(language_id || chr(0) || qualified_name || chr(0) || signature) AS id FROM fun WHERE coalesce(receiver, '') = ''",
    "entity_method_id": f"WITH {_FUN} SELECT DISTINCT receiver, name, signature, sha256(language_id || chr(0) || receiver || chr(0) || name || chr(0) || signature) AS id FROM fun WHERE receiver <> ''",
    "entity_type_id": "SELECT DISTINCT qualified_name, sha256(language_id || chr(0) || qualified_name) AS type_id FROM code_entities WHERE kind = 'TypeDecl'",
    "body_hashes": "SELECT DISTINCT file_id, sha256(content) AS own, file_hash FROM parsed_files WHERE content IS NOT NULL",
    "entity_upsert": "WITH u AS (SELECT id, max({'s': created_seq, 'kind': kind, 'l': language_id, 'q': qualified_name, 'r': receiver, 'p': path, 'body_hash': body_hash}) AS v, min(created_seq) AS created_seq FROM code_entities WHERE id IS NOT NULL GROUP BY id) SELECT id, v.kind AS kind, v.body_hash AS body_hash, created_seq FROM u",
    "entity_count_by_kind": "SELECT kind, count(*) AS n FROM code_entities GROUP BY kind",
    "entity_lookup_exact": f"WITH {_NAMES} SELECT name, name AS qualified_name, min(id) AS id FROM names JOIN code_entities e ON e.qualified_name = name GROUP BY name",
    "entity_lookup_suffix_strict": f"WITH {_NAMES}, n AS (SELECT DISTINCT split_part(name, '.', -1) AS name FROM names), e AS (SELECT DISTINCT qualified_name, id FROM code_entities WHERE kind IN ('Function', 'Method')), m AS (SELECT name, qualified_name, id, row_number() OVER (PARTITION BY name ORDER BY qualified_name, id) AS r FROM n JOIN e ON qualified_name = name OR ends_with(qualified_name, '.' || name)) SELECT name, qualified_name, id FROM m WHERE r = 1",
    "entity_lookup_suffix_compat": f"WITH {_NAMES}, n AS (SELECT DISTINCT lower(split_part(name, '.', -1)) AS name FROM names), e AS (SELECT DISTINCT qualified_name, id FROM code_entities WHERE qualified_name IS NOT NULL), m AS (SELECT name, qualified_name, id, row_number() OVER (PARTITION BY name ORDER BY qualified_name, id) AS r FROM n JOIN e ON qualified_name = name OR qualified_name ILIKE '%.' || name) SELECT name, qualified_name, id FROM m WHERE r = 1",
    "entity_attribute_filter": f"SELECT 'eq' AS op, id, created_seq FROM code_entities WHERE kind = 'TypeDecl' UNION ALL SELECT 'prefix', id, created_seq FROM code_entities WHERE starts_with(path, '{PREFIX}') UNION ALL SELECT 'glob', id, created_seq FROM code_entities WHERE regexp_matches(path, '^[^/]*/pkg/.*/[^/]*\\.go$')",
    "entity_ingest": f"""WITH l AS (SELECT path, coalesce(lower(arg_max(language_id, file_id)), 'go') AS language_id, arg_max(file_hash, file_id) AS file_hash, arg_max(functions, file_id) AS functions FROM parsed_files WHERE path IS NOT NULL GROUP BY path),
      u AS (SELECT path, language_id, unnest(functions) AS f FROM l), g AS (SELECT language_id, f.receiver AS receiver, f.name AS name, f.qualified_name AS qualified_name, f.body_hash AS body_hash, {_SIG.replace('signature', 'f.signature')} AS sig FROM u),
      i AS (SELECT DISTINCT CASE WHEN receiver <> '' THEN sha256(language_id || chr(0) || receiver || chr(0) || name || chr(0) || sig) ELSE sha256(language_id || chr(0) || qualified_name || chr(0) || sig) END AS id, CASE WHEN receiver <> '' THEN 'Method' ELSE 'Function' END AS kind, language_id, qualified_name, nullif(receiver, '') AS receiver, body_hash FROM g),
      m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind DESC, language_id DESC, qualified_name DESC, receiver DESC, body_hash DESC) AS r FROM i)
      SELECT sha256(path) AS id, 'File' AS kind, language_id, path AS qualified_name, NULL AS receiver, path, file_hash AS body_hash FROM l UNION ALL SELECT id, kind, language_id, qualified_name, receiver, NULL, body_hash FROM m WHERE r = 1""",
    "id_collisions": f"WITH {_FUN} SELECT sha256(language_id || chr(0) || receiver || chr(0) || 'Run' || chr(0) || signature) AS id, count(DISTINCT path) AS n_paths FROM fun WHERE receiver <> '' GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "relation_insert_ignore": f"WITH {_EDGES} SELECT relation, from_id, to_id FROM edges",
    "relation_new": "WITH h AS (SELECT max(created_seq) // 2 AS h FROM code_relations), e AS (SELECT relation, lower(trim(from_id, e' \\t')) AS from_id, lower(trim(to_id, e' \\t')) AS to_id, created_seq > (SELECT h FROM h) AS late FROM code_relations WHERE trim(from_id, e' \\t') <> '' AND trim(to_id, e' \\t') <> '' AND created_seq IS NOT NULL) SELECT DISTINCT relation, from_id, to_id FROM e WHERE late EXCEPT SELECT relation, from_id, to_id FROM e WHERE NOT late",
    "graph_one_hop": f"WITH {_EDGES}, {_SUBJ} SELECT to_id AS id, min(relation) AS via FROM edges WHERE from_id IN (SELECT id FROM subj) GROUP BY to_id",
    "graph_bfs": f"WITH RECURSIVE {_EDGES}, {_SUBJ}, {_bfs_sql("e.relation = 'calls'", 'true')}, m AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT m.id, m.depth, 'calls' AS via FROM m WHERE depth > 0",
    "graph_impacted_set": f"WITH RECURSIVE {_EDGES}, {_SUBJ}, {_bfs_sql('true', "severity = 'high'")} SELECT id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'direct_touch' ELSE 'impacted_via' END AS reason FROM walk GROUP BY id",
    "layer_topo_levels": f"WITH RECURSIVE d(name, dep) AS (VALUES {_DEPS}), l(name) AS (VALUES {_LAYERS}), w(name, level) AS (SELECT name, 0 FROM l WHERE name NOT IN (SELECT name FROM d) UNION SELECT d.name, w.level + 1 FROM w JOIN d ON d.dep = w.name) SELECT name, max(level) AS level FROM w GROUP BY name",
}
_ALL_DEPS = f"{_DEPS}, " + ", ".join(f"('{a}', '{b}')" for a, b in CYCLE)
_ALL_LAYERS = f"{_LAYERS}, " + ", ".join(f"('{a}')" for a in sorted({a for a, _ in CYCLE}))
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
SQL |= {
    "entity_get": f"WITH {_SUBJ}, u AS (SELECT id, max({{'s': created_seq, 'kind': kind, 'l': language_id, 'q': qualified_name}}) AS v, min(created_seq) AS created_seq FROM code_entities WHERE id IS NOT NULL GROUP BY id) SELECT id, v.kind AS kind, v.q AS qualified_name, created_seq FROM u WHERE id IN (SELECT id FROM subj)",
    "go_functions_delivered": "WITH g AS (SELECT CAST(file_id AS VARCHAR) AS file_id, unnest(functions) AS f FROM parsed_files WHERE (lower(language_id) = 'go' OR language_id IS NULL AND ends_with(path, '.go')) AND content IS NOT NULL) SELECT DISTINCT file_id, f.* FROM g",
    # a layer has a level if all it needs have one; what is never freed has -1
    "layer_levels_with_cycle": f"WITH RECURSIVE d(name, dep) AS (VALUES {_ALL_DEPS}), l(name) AS (VALUES {_ALL_LAYERS}), up(name, dep) AS (SELECT name, dep FROM d UNION SELECT u.name, d.dep FROM up u JOIN d ON d.name = u.dep), bad AS (SELECT name FROM up WHERE name = dep UNION SELECT name FROM up WHERE dep IN (SELECT name FROM up WHERE name = dep)), w(name, level) AS (SELECT name, 0 FROM l WHERE name NOT IN (SELECT name FROM d) UNION SELECT d.name, w.level + 1 FROM w JOIN d ON d.dep = w.name WHERE d.name NOT IN (SELECT name FROM bad)) SELECT name, max(level) AS level FROM w GROUP BY name UNION ALL SELECT DISTINCT name, -1 FROM bad",
    "layer_install_order": f"""WITH RECURSIVE d(name, dep) AS (VALUES {_DEPS}), n(name) AS (VALUES {_LAYERS}), l AS (SELECT n.name, list(d.dep) FILTER (d.dep IS NOT NULL) AS deps FROM n LEFT JOIN d ON d.name = n.name GROUP BY 1),
      s(ord, name, done) AS (SELECT CAST(-1 AS BIGINT), '', CAST([] AS VARCHAR[]) UNION ALL SELECT ord + 1, nx, list_append(done, nx) FROM (SELECT s.ord, s.done, min(l.name) AS nx FROM s JOIN l ON NOT list_contains(s.done, l.name) AND list_has_all(s.done, coalesce(l.deps, CAST([] AS VARCHAR[]))) GROUP BY s.ord, s.done))
      SELECT ord, name FROM s WHERE ord >= 0""",
    "layer_attribute_types": f"SELECT * FROM (VALUES {', '.join(f'({_TEXT(k)}, {_TEXT(v)})' for k, v in TYPES.items())}) t(type, spark_type)",
    "dependency_names": f"SELECT dependency, split_part(dependency, '@', 1) AS name FROM (VALUES {', '.join(f'({_TEXT(x)})' for x in DEPENDENCIES)}) t(dependency)",
    "workspace_ids": "SELECT DISTINCT repo, substr(sha256(repo), 1, 12) AS id FROM parsed_files WHERE repo IS NOT NULL",
}
NO_SQL = ["go_functions", "entity_index"]
QUERIES = {k: globals()[k] for k in [*SQL, *NO_SQL]}
