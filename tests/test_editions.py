"""Queries over built editions: what they read, and that readings are neither shuffled nor made by functions of array elements."""

from __future__ import annotations

import pytest

from variorum import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f21_witness_table", "k06_class_merge", "g02_difference_statistics"])
def test_readings_stay_with_their_document(name, spark, sf_dir):
    """The one shuffle before readings are grouped is of texts; the others are of groups."""
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "hashpartitioning(doc_id" in text and "lambdafunction(struct(i" not in text
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "pos#" in line]


def test_departures_are_compiled(spark, sf_dir):
    """F8: no function of array elements on the way to the readings."""
    assert "lambdafunction" not in plan(catalogue.QUERIES["f22_variant_extraction"](spark, sf_dir))


def test_nodes_count_their_edges(spark, sf_dir):
    """a node has as many children as edges lead from it by the evidence of the documents."""
    edges = catalogue.QUERIES["h04_lineage_edges"](spark, sf_dir).collect()
    nodes = {r.node: r.n_children for r in catalogue.QUERIES["h06_nodes"](spark, sf_dir).collect()}
    assert nodes == {n: sum(e.source == n for e in edges) for n in nodes} and sum(nodes.values()) == len(edges) > 0
