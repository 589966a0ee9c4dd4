"""Types of the physical tables and the fixed vocabularies."""

from __future__ import annotations

REF = "struct<layer:string,kind:string,id:string>"
EVENTS = "seq long, ts timestamp, ts_raw string, layer string, kind string, subject_layer string, subject_kind string, subject_id string, payload string, causes array<long>, produced_by string, tx string"
ENTITIES = "id string, kind string, language_id string, qualified_name string, receiver string, path string, body_hash string, created_seq long"
RELATIONS = "relation string, from_id string, to_id string"
FUNCTION = "struct<qualified_name:string,receiver:string,name:string,signature:string,start_byte:long,end_byte:long,start_line:long,end_line:long,body_hash:string>"
PARSED = f"path string, language_id string, file_hash string, functions array<{FUNCTION}>"
ANCHOR = "struct<ord:int,kind:string,str:string,int:long,float:double>"
SELECTORS = f"name string, unique boolean, anchors array<{ANCHOR}>"
FLOWS = f"name string, description string, scope string, risk string, steps array<struct<ord:int,name:string,anchors:array<{ANCHOR}>>>"
CURSORS = "subscriber_id string, last_processed_seq long"
PROPOSALS = "id string, target_layer string, kind string, author string, payload binary, created_at timestamp"

#: How strongly a freshness word argues against trusting a fact; other words count as 5.
BLOCKING_RISK = {"live": 0, "current": 1, "possibly_stale": 2, "dirty": 3, "stale": 4, "unknown": 5, "unresolved": 6}
OTHER_RISK = 5
#: Primitive attribute types of a layer's schema; list<T> and map<K,V> are built from them.
PRIMITIVES = ("string", "int", "float", "bool", "timestamp", "enum", "path", "selector", "opaque_blob", "entity_ref(self)")
#: Hops of a traversal, unless given.
MAX_DEPTH = 8
#: Fixed value: confidence of a selector bound through an exact name.
EXACT_CONFIDENCE = 0.97

SPARK_TYPE = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp", "enum": "string", "path": "string", "selector": "string", "opaque_blob": "binary", "entity_ref(self)": "string"}


def arrow_schema(ddl: str):
    """The Arrow schema of a table; for the driver, which sends it to tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
