"""Shapes of the physical plans."""

import pytest

from mediatimeline.plans import documents
from mediatimeline.plans.bridges import Tables
from mediatimeline.plans.catalog import QUERIES as Q
from mediatimeline.sources import io
from tests.conftest import SMALL, plan_of

# The only queries that may start Python workers.
PYTHON = {"structural_segments", "apply_model"}
EAGER = {n for n in Q if n.startswith("stream_")} | {"merge_similar", "model_errors", "labels_beside_errors", "write_documents", "timeline_files", "index_append"}


@pytest.mark.parametrize("name", sorted(set(Q) - EAGER))
def test_no_products_and_no_python(spark, name):
    plan = plan_of(Q[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "InPandas" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name, shuffles", [
    ("gated_label_change", 1), ("numeric_change", 1), ("label_change", 1), ("adaptive_change", 1), ("label_change_after_filter", 1),
    ("circuit_breaker", 1), ("multi_facet_change", 1), ("sessions", 1), ("timeline_totals", None), ("chunk_by_gap", 1),
])
def test_one_shuffle(spark, name, shuffles):
    """Chained ordered scans of a media share one exchange (a second key needs its own)."""
    plan = plan_of(Q[name](spark, SMALL))
    count = plan.count("Exchange hashpartitioning")
    limit = {"circuit_breaker": 3, "timeline_totals": 1}.get(name, shuffles)
    assert count <= limit, plan


def test_scan_is_pruned(spark):
    plan = plan_of(Q["gated_label_change"](spark, SMALL))
    assert "value" not in plan.split("ReadSchema: ")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["later_span_wins", "later_span_wins_per_event"])
def test_winning_rows_are_moved_once(spark, name):
    """The winner's order is its row: no copy of it travels beside; line items are numbered before their join."""
    plan = plan_of(Q[name](spark, SMALL))
    assert "max_by" not in plan
    join = min(n for n, line in enumerate(plan.splitlines()) if "l_orderkey" in line and "Join" in line)
    assert not any("l_suppkey" in line for line in plan.splitlines()[:join + 1])


def test_whole_media_are_held_once(spark):
    """Rows are moved once and gathered by one aggregate; nothing behind it holds the long text again."""
    plan = plan_of(Q["merge_metadata"](spark, SMALL))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan, plan
    top = plan[:plan.index("Exchange")]
    assert top.count("ObjectHashAggregate") == 1 and "Project" not in top, plan


def test_nested_parts_are_not_moved_again(spark):
    """Spans, events and media of one media meet in the task that packs them."""
    plan = plan_of(documents.nested(Tables(spark, SMALL)))
    assert not [line for line in plan.splitlines() if "Exchange" in line and "part#" in line], plan
    assert plan.count("Exchange hashpartitioning") <= 9, plan


def test_stored_timelines_are_compressed(spark, tmp_path):
    io.write_timelines(documents.nested(Tables(spark, SMALL)), str(tmp_path / "timelines"))
    names = [p.name for p in (tmp_path / "timelines").glob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert io.read_timelines(spark, str(tmp_path / "timelines")).count() > 0
