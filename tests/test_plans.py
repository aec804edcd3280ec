"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from muster.plans import catalog
from muster.functions.common import spread
from muster.operators import aggregates, leaves, ordered
from muster.plans import records, scans, shapes
from muster.plans.joins import layer_leaves
from muster.plans.registry import table

SF = "/root/testdata/sf0.001"

# These write files or run a stream first; what they return is only a read of the result.
EAGER = ("s2_", "s3_", "s5_", "s7_", "s8_", "s9_", "s10_", "t1_", "t2_", "t3_", "t4_", "t5_")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in catalog.QUERIES if not q.startswith(EAGER)))
def test_no_loop_joins(spark, settings, name):
    """Nothing is joined pair by pair, not even where one side could not be broadcast."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["p4_filter_name_contains"](spark, SF))
    assert "StringContains(p_name,ring)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    plan = plan_of(entry.queries()["w1_tail_per_key"](spark, SF))
    assert "props" not in plan and "value" not in plan


def test_limits_per_key_come_before_the_shuffle(spark):
    polls = shapes.polls(table(spark, SF, "events"))
    plan = plan_of(aggregates.time_to_ready(polls, ["user_id"], ["ts", "event_id"], aggregates.is_ready()))
    before = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before
    assert plan.count("Exchange") == 1


def test_reports_combine_before_the_shuffle(spark):
    lines = table(spark, SF, "documents").select("doc_id", F.col("text").alias("line"))
    plan = plan_of(aggregates.log_ready(lines, ["doc_id"]))
    assert "partial_bool_or" in plan or "partial_max" in plan
    assert plan.count("Exchange") == 1


def test_one_shuffle_for_first_match(spark):
    o = table(spark, SF, "orders")
    plan = plan_of(ordered.first_match(o, ["o_custkey"], "o_orderkey"))
    assert plan.count("Exchange") == 1 and "partial_min_by" in plan


def test_queries_have_names_of_their_own():
    for name in catalog.QUERIES:
        assert name != "pipeline" and not name.startswith("op")


def test_values_cross_one_shuffle_in_a_merge(spark):
    plan = plan_of(leaves.merge_layers(layer_leaves(spark, SF), ["c_custkey"]))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) <= 5
    assert plan.count("partial_max_by(value") == 1


@pytest.mark.parametrize("name", ["flow_resolve_services", "j4_merged_documents", "j9_set_path", "j4_merge_layers"])
def test_no_side_of_a_merge_goes_through_the_driver(spark, name):
    """However small the file is that the leaves were exploded from."""
    joins = [line for line in plan_of(entry.queries()[name](spark, SF)).splitlines() if "Join [" in line]
    merging = [line for line in joins if "_above#" in line or "_under_at#" in line]
    assert merging and not [line for line in merging if "Broadcast" in line]


def test_borders_are_sorted_once(spark):
    drawn = spark.range(1000).select(F.struct("id").alias("_row"))
    picked = ordered._picked_borders(drawn, 10)
    assert "lambda" not in picked._jdf.queryExecution().optimizedPlan().toString()
    assert picked.first()[0] == "[" + ",".join('{"id":%d}' % i for i in range(100, 1000, 100)) + "]"


def test_asked_names_are_the_small_side(spark):
    plan = plan_of(entry.queries()["p2_lookup_settings"](spark, SF))
    asked = [line for line in plan.splitlines() if "HashJoin [_last#" in line]
    assert asked and all("BuildRight" in line for line in asked)


@pytest.mark.parametrize("made", [records._service_leaves, layer_leaves, scans._changed_documents, entry.queries()["j9_set_path"], entry.queries()["flow_list_config"], entry.queries()["flow_resolve_services"]])
def test_small_files_are_opened_in_many_tasks(spark, made):
    """Every read of customers, which become many rows each, is dealt out first."""
    above = ""
    lines = plan_of(made(spark, SF)).splitlines()
    for at, line in enumerate(lines):
        if "FileScan" in line and "c_custkey" in line:
            near = "".join(lines[max(0, at - 5) : at])
            above += "." if "RoundRobinPartitioning(8), REPARTITION_BY_NUM" in near else "x"
    assert above and "x" not in above


def test_tasks_grow_with_the_rows_that_are_opened(spark):
    assert spread(spark.range(900_000)).rdd.getNumPartitions() == 45
