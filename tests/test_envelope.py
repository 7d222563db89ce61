"""Envelopes: order, caps, what is left out, budgets and how to use an answer."""

import pytest

from annalist.operators import envelope

SCHEMA = "section string, entity_type string, id string, label string"


def parts(frame):
    rows = frame.collect()
    items = [(r.section, r.position, r.id) for r in sorted((r for r in rows if r.part == "item"), key=lambda r: (r.section, r.position))]
    return items, {r.section: r.n for r in rows if r.part == "omitted"}, {(r.section, r.position): r.label for r in rows if r.part == "meta"}


def test_caps_and_order(spark):
    rows = [("starting_points", "function", f"f{n:02d}", f"name{n:02d}") for n in range(12)] + [("starting_points", "struct", "s", "zz"), ("starting_points", "DECISION", "d", None), ("relevant_facts", "FACT", "x", "y")]
    rows += [("impacted_areas", "EVENT", f"e{n}", f"e{n}") for n in range(15)] + [rows[0]]
    items, lost, told = parts(envelope.envelope("plan", spark.createDataFrame(rows, SCHEMA)))
    assert [x for x in items if x[0] == "starting_points"] == [("starting_points", n + 1, i) for n, i in enumerate(["s", *[f"f{n:02d}" for n in range(7)]])]
    assert len(items) == 8 + 15 + 1 and lost == {"starting_points": 6}  # a row that comes twice counts once
    assert told[("kind", 1)] == "plan" and told[("completeness", 1)] == "full" and told[("must_use_before_edit", 1)] == "true" and told[("recommended_next_tools", 3)] == "review"


def test_budget(spark):
    """Sections in their order, rows while their tokens fit; all that goes is told."""
    rows = [("starting_points", "function", f"f{n}", "x" * 8) for n in range(3)] + [("impacted_areas", "EVENT", f"e{n}", "y" * 12) for n in range(4)] + [("other", "EVENT", "o", "z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    items, lost, _ = parts(envelope.envelope("plan", frame, budget=13))
    assert [i for *_, i in items] == ["e0", "e1", "f0", "f1", "f2"] and lost == {"impacted_areas": 2, "other": 1}
    assert parts(envelope.envelope("plan", frame, budget=0))[:2] == ([], {"starting_points": 3, "impacted_areas": 4, "other": 1})
    assert len(parts(envelope.envelope("plan", frame, budget=100))[0]) == 8


def test_completeness(spark):
    state = lambda kind, *rows: parts(envelope.envelope(kind, spark.createDataFrame(list(rows), SCHEMA)))[2]
    assert state("unified_explanation")[("completeness", 1)] == "retrieval_only"
    assert state("unified_explanation", ("links", "X", "a", "b"))[("recommended_next_tools", 1)] == "explain_struct"
    both = state("unified_explanation", ("code", "struct", "a", "b"), ("code", "function", "c", "d"))
    assert both[("completeness", 1)] == "full" and envelope.COMPARE in both.values()
    assert state("impact", ("impacted_events", "EVENT", "a", "b"))[("completeness", 1)] == "partial"
    assert state("ship_check", ("ship_blockers", "X", "a", "b"))[("must_use_before_edit", 1)] == "true"
    assert envelope.CHECKS in state("review", ("discipline_checks", "X", "a", "b")).values()
    with pytest.raises(ValueError):
        envelope.envelope("poem", spark.createDataFrame([], SCHEMA))
