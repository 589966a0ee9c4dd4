import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.dsl.lexer import DslError
from stratalog.dsl.parser import NO_RULES, Anchor, Flow, Import, Lit, Query, Selector, Step, parse
from stratalog.dsl.render import describe, render
from stratalog.operators import diff, overlay, review, validate
from stratalog.plans import registry
from stratalog.schemas import ENTITIES, FLOWS

from .conftest import rows

SOURCE = """// the overlay
import "lib/pay.gh" as p
selector LedgerBook { unique anchor qualified_name "billing.LedgerBook.Post" }
/* a flow */
flow LedgerPosting {
  description "checks \\"all\\""
  scope LedgerBook
  risk high
  step Check targets selector { qualified_name "a.B" weight 2 share 1.0 }
}
query "q" { match x }
"""


def test_parse_and_render_round_trip():
    d = parse(SOURCE)
    assert [type(x) for x in d] == [Import, Selector, Flow, Query]
    assert d[1].unique and d[1].anchors[0].value.str == "billing.LedgerBook.Post"
    assert d[2].description == 'checks "all"' and d[2].steps[0].anchors[2].value.float == 1.0
    assert parse(render(d)) == d and render(parse(render(d))) == render(d)
    assert describe(SOURCE, 7)["declarations"] == 4


def test_refused():
    with pytest.raises(DslError, match="datalog rules deferred"):
        parse("rule f(x) :- g(x).")
    assert str(pytest.raises(DslError, parse, "rule f(x) :- g(x).").value) == NO_RULES
    assert parse('selector A { anchor x ":-" } // a :- b')
    for bad in ("selector {", "flow F { risk high scope S }", "selector A { anchor }", "x", "selector A { anchor k ; }", 'query "q" { a'):
        with pytest.raises(DslError):
            parse(bad)


names = st.from_regex(r"[a-zA-Z_][a-zA-Z0-9_]{0,6}", fullmatch=True).filter(lambda n: n not in ("unique", "anchor", "step"))
literals = st.one_of(st.text(max_size=8).map(lambda s: Lit(str=s)), st.integers(-999, 999).map(lambda i: Lit(int=i)), st.integers(-99, 99).map(lambda i: Lit(float=i / 4)))
anchors = st.builds(Anchor, names, literals)
selectors = st.builds(Selector, names, st.booleans(), st.lists(anchors, max_size=3))
flows = st.builds(Flow, names, st.text(max_size=8), names, names, st.lists(st.builds(Step, names, st.lists(anchors, min_size=1, max_size=2)), max_size=2))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(selectors, flows), max_size=4))
def test_any_declarations_round_trip(decls):
    assert parse(render(decls)) == decls


ENT = [("e1", "Method", "go", "billing.LedgerBook.Post", "LedgerBook", None, "h1", 1), ("e2", "Function", "go", "billing.helper", None, None, "h2", 1), ("e3", "Function", "go", "other.Post", None, None, "h1", 1)]


def sources(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source_name string, source string")


def test_load_last_wins_and_strict(spark):
    s, f = overlay.load(sources(spark, SOURCE, 'selector LedgerBook { anchor qualified_name "x.Y" }', "nonsense {", None))
    assert rows(s.selectExpr("name", "anchors[0].str")) == [("LedgerBook", "x.Y")]
    assert rows(f.select("name", "risk")) == [("LedgerPosting", "high")]
    with pytest.raises(DslError):
        overlay.load(sources(spark, "nonsense {"), strict=True)


def test_resolution(spark):
    e = spark.createDataFrame(ENT, ENTITIES)
    s = overlay.overlay_from_table(spark, [("a", ["no.Such", "billing.helper"]), ("b", ["no.Such"]), ("c", [])])
    got = {r["name"]: r for r in overlay.resolve(s, e, 9).collect()}
    assert (got["a"]["outcome"], got["a"]["entity_id"], got["a"]["confidence"], got["a"]["n_matches"], got["a"]["resolved_at"]) == ("bound", "e2", 0.97, 1, 9)
    assert got["b"]["outcome"] == got["c"]["outcome"] == "unresolved"
    ladder = 'selector x { anchor qualified_name "nope" anchor body_hash "h1" } selector y { anchor qualified_name "billing.helper" } selector z { anchor qualified_name "no" anchor body_hash "h2" }'
    sel, _ = overlay.load(sources(spark, ladder))
    assert rows(overlay.resolve_ladder(sel, e).select("name", "outcome", "anchor_ord")) == [("x", "ambiguous", 1), ("y", "bound", 0), ("z", "reanchored", 1)]


DIFF = """--- a/billing/ledger.go
+++ b/billing/ledger.go
@@ -1,2 +1,5 @@
+func (b *LedgerBook) Post(entry Entry) (int, error) {
-gone
+	b.n++
+	return b.n, nil
+}
+++ b/other.go
+++counter
+func helper() {}
+func Set[T any]() {}
"""


def test_diff(spark):
    d = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "+no file\n")], "diff_id long, text string")
    h = diff.hunks(d)
    assert rows(h.select("diff_id", "hunk_ord", "path").distinct()) == [(1, 1, "billing/ledger.go"), (1, 2, "other.go")]
    assert h.count() == 6
    assert rows(diff.function_names(h).select("name")) == [("Post",)]


def test_tracer(spark):
    e = spark.createDataFrame(ENT, ENTITIES)
    text = 'selector LedgerBook { anchor qualified_name "billing.LedgerBook.Post" } flow LedgerPosting { scope LedgerBook } flow Loose { scope Nowhere } flow Bare { }'
    s, f = overlay.load(sources(spark, text))
    d = spark.createDataFrame([(1, DIFF), (2, "  \n")], "diff_id long, text string")
    found = validate.validate_diffs(d, e, s, f)
    first = found.collect()
    assert len(first) == 1 and first[0]["kind"] == "flow_unreviewed" and first[0]["severity"] == "medium" and first[0]["subject"]["flow"] == "LedgerPosting"
    assert validate.validate_diffs(d, e, s, f).collect() == first
    assert rows(validate.summary(d, found)) == [(1, "1 findings"), (2, "0 findings (empty diff)")]
    seen = found.selectExpr("1 as scenario", "kind", "subject.flow as flow")
    want = spark.createDataFrame([(1, "flow_unreviewed", "LedgerPosting"), (2, "flow_unreviewed", "Other")], "scenario int, kind string, flow string")
    assert rows(validate.detection_score(want, seen, ["scenario"]).select("scenario", "detection", "repair_quality")) == [(1, 1.0, -1.0), (2, 0.0, -1.0)]
    assert f.count() == 3 and FLOWS


def test_review(spark):
    p = spark.createDataFrame([("semantic.overlay", "selector", "agent:test", "{}", 2), ("semantic.overlay", "selector", "agent:late", "{}", 3)], "target_layer string, kind string, author string, payload string, created_at long")
    s = review.submit(p)
    one = s.first()
    assert s.count() == 1 and one["author"] == "agent:test" and one["id"].startswith("prop_")
    t = spark.createDataFrame([(one["id"], "accepted", 1), (one["id"], "rejected", 2), ("nope", "accepted", 3)], "id string, state string, seq long")
    assert review.states(s, t).first()["state"] == "rejected"
    assert review.states(s, t.limit(0)).first()["state"] == "pending_review"
    assert rows(review.unknown(s, t)) == [("nope",)]


def test_routing_and_conflicts(spark):
    rules = spark.createDataFrame(registry.trust_rules(registry.STARTER), "layer string, source string, action string")
    w = spark.createDataFrame([("source.live", "extractor:lsp"), ("source.live", "agent:x"), ("review.queue", "importer:y"), ("code.core", "stranger"), (None, None)], "layer string, source string")
    assert rows(review.route(w, rules).select("source", "route")) == sorted([("extractor:lsp", "commit"), ("agent:x", "reject"), ("importer:y", "proposal"), ("stranger", "proposal"), (None, "proposal")], key=repr)
    p = spark.createDataFrame([("1", "t"), ("2", "t"), ("2", "t"), ("3", "u"), ("4", None)], "id string, target string")
    assert rows(review.conflicts(p, "target")) == [("1", "t", "1", 1), ("2", "t", "1", 1)]
    m = spark.createDataFrame([("human_only", 0.99), ("policy_only", 0.2), ("hybrid", 0.2), ("hybrid", 0.99)], "mode string, confidence double")
    assert [r["decision"] for r in review.promote(m, 0.9).collect()] == ["human", "reject", "human", "promote"]
