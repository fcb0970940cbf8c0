"""What is as long as the input never goes through the driver as a broadcast, however well its files are compressed."""

import re

import pytest

from hearsay.operators import components, graph, workflows
from hearsay.plans import catalog
from hearsay.plans import vectors as V


@pytest.mark.parametrize("name", ["unify_graph", "workflow_type_counts", "exploration_prerequisites", "exploration_plan", "workflow_models", "summary_row"])
def test_graph_is_never_broadcast(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    # running numbers are sent by range, crossed tables have one row each
    assert [x for x in re.findall(r"Broadcast\w*Join.*", plan) if "numbered_part" not in x and "NestedLoop" not in x] == []


def test_graph_is_never_broadcast_while_it_is_made(spark, monkeypatch):
    plans, real = [], components.cut

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(components, "cut", lambda df: real(plan(df)))
    nodes, edges = V.frame(spark, V.NODES, graph.NODE), V.frame(spark, V.EDGES, graph.EDGE)
    plan(graph.known_edges(nodes, edges))
    got = {r["id"]: r["component"] for r in plan(graph.components(nodes, edges)).collect()}
    assert len(got) == len(V.NODES) and got["login"] == got["ws"] != got["lone"]
    assert len(plans) > 3 and [x for p in plans for x in re.findall(r"Broadcast\w*Join.*", p)] == []


@pytest.mark.parametrize("name", ["exploration_plan", "workflow_models"])
def test_walks_are_written_before_the_result(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("SortMergeJoin") <= 2


def test_summary_walks_components_once_for_workflows(spark, sf_dir, monkeypatch):
    walks, real = [], graph.per_component

    def counted(nodes, edges, comp, fn, *args, **kwargs):
        walks.append(fn.__name__)
        return real(nodes, edges, comp, fn, *args, **kwargs)

    for module in (graph, workflows):
        monkeypatch.setattr(module, "per_component", counted)
    assert catalog.QUERIES["summary_row"](spark, sf_dir).count() == 1
    assert sorted(walks) == ["auth_chains_of", "walked_of"]
