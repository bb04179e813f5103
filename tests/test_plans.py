"""Shapes of physical plans that matter at scale."""

import re

import pytest

from millrace import plans

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_predicate_and_projection_reach_the_scan(spark):
    shown = plan(spark, "table_scan")
    assert "EqualTo(o_orderstatus,F)" in shown and "GreaterThan(o_total" in shown
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>", shown)


@pytest.mark.parametrize("name,columns", [
    ("traffic_counts", {"ts", "event_type"}), ("coin_sliding_30s", {"ts", "event_type", "value"}),
    ("markov_pairs", {"doc_id", "text"}), ("bet_exposure", {"l_orderkey", "l_suppkey", "l_partkey", "l_discount", "l_quantity"}),
    ("winners_multi", {"l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linenumber"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


@pytest.mark.parametrize("name", ["traffic_trend", "coin_sliding_30s", "coin_sliding_5m", "bet_exposure", "bet_settle", "winners_multi"])
def test_no_cross_join_and_no_python_in_the_hot_path(spark, name):
    shown = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert operator not in shown


@pytest.mark.parametrize("name", ["price_journal", "price_journal_small", "horse_resolve", "winners_pages"])
def test_no_limit_gathers_rows_in_one_task(spark, name):
    shown = plan(spark, name)
    assert "GlobalLimit" not in shown and "TakeOrdered" not in shown


def test_bets_aggregate_before_the_shuffle(spark):
    shown = plan(spark, "bet_exposure")
    assert "partial_sum" in shown and "partial_count" in shown and "SortAggregate" not in shown
