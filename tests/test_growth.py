"""Rows that outgrow what they are made of: never sent whole to all tasks, and no sum or product that overflows on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.plans import byte_queries, queries, rule_queries  # noqa: F401  they register their queries

SMALL = "/root/testdata/sf0.001"


def sent_to_all(df) -> list[str]:
    """What stands below each broadcast of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            found.append("\n".join(lines[k:end]))
    return found


def made_of_runs(plan: str) -> bool:
    return any("explode(sequence" in line or "posexplode" in line for line in plan.splitlines() if "Generate" in line)


@pytest.mark.parametrize("name", ["b1_sample_table_fusion", "b4_presentation_times", "b10_sample_offsets", "a6_samples_of_files", "a15_inspected_tracks"])
def test_rows_made_of_runs_are_not_sent_to_all_tasks(spark, name):
    assert not [p for p in sent_to_all(queries.QUERIES[name](spark, SMALL)) if made_of_runs(p)]


@pytest.mark.parametrize("name", ["b10_sample_offsets", "b1_sample_table_fusion"])
def test_samples_are_not_sent_to_all_tasks_when_plans_change_as_they_run(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and not sent_to_all(found)


def test_retained_bytes_pass_the_greatest_bigint_before_they_stop(spark, tmp_path):
    parts = spark.createDataFrame([("a", 92233), ("b", 92234), ("b", 1), ("c", 1)], "p_brand string, p_partkey long")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = {r.buffer: r.retained for r in queries.QUERIES["e5_retained_bytes"](spark, str(tmp_path)).collect()}
    assert got == {"a": 92233 * 10**14, "b": (1 << 63) - 1, "c": 10**14}


def test_planes_are_made_without_a_loop_over_their_bytes(spark):
    shown = queries.QUERIES["a11_visible_rows"](spark, SMALL)
    assert "transform(" not in shown._jdf.queryExecution().optimizedPlan().toString()


def test_nested_boxes_and_numbers_are_those_of_plain_python(spark):
    values = [0, 1, 255, 256, 65535, (1 << 32) - 1, 1 << 40, (1 << 63) - 1, -1, -300]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    sizes = (1, 2, 3, 4, 7, 8)
    one_by_one = boxes.box("moov", boxes.box("trak", boxes.box("stbl", boxes.number(F.col("v"), 4))))
    got = rows.select("v", *(boxes.number(F.col("v"), n).alias(f"n{n}") for n in sizes), one_by_one.alias("a"), boxes.nested(boxes.number(F.col("v"), 4), "stbl", "trak", "moov").alias("b")).collect()
    for r in got:
        assert [bytes(r[f"n{n}"]) for n in sizes] == [(r.v % (1 << 8 * n)).to_bytes(n, "big") for n in sizes]
        assert r.a == r.b
