"""Distinct pairs are counted in tasks of their own number, not in one hash table of a file's split or of merged partitions."""

import pytest

from demandlens.plans import registry


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("name, key", [("d2_status_fold", "match_id"), ("d13_skill_demand", "posting_id"), ("c3_skill_status", "match_id"), ("d1_importance_histogram", "posting_id")])
def test_pairs_are_dealt_before_they_are_counted(spark, name, key, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = plan.splitlines()
    pairs = [i for i, line in enumerate(lines) if f", {key}#" in line and "HashAggregate(keys=[skill_id#" in line]
    assert pairs
    for i in pairs:  # what lies below an aggregate by pairs was dealt by the key
        assert f"hashpartitioning({key}#" in "".join(lines[i:]) and f", {parts}), REPARTITION_BY_NUM" in "".join(lines[i:])
