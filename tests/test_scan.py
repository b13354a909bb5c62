"""Positions and running sums over groups of any size against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.scan import quantiles, scan


def plain(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (-r[2], r[3]))
        total, run = sum(r[4] for r in g if r[4] is not None), 0
        some = any(r[4] is not None for r in g)
        met = False
        for k, r in enumerate(g, 1):
            met = met or r[4] is not None
            run += r[4] or 0
            out.append((*r, k, len(g), run if met else None, total if some else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions, few", [("1", 0), ("7", 0), ("7", 100_000)])
def test_scan(spark, partitions, few):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), rng.choice([1.5, 2.5]), k, rng.choice([None, 1, 5, -2]))
            for k in range(900)] + [("alone", 3, 1.0, 5000, None)]
    frame = spark.createDataFrame(rows, "g string, h int, score double, id int, value long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scan(frame, ["g", "h"], [F.desc("score"), F.col("id")], {"v": F.col("value")}, few)
        assert found.columns == [*frame.columns, "position", "group_rows", "running_v", "total_v"]
        assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
        whole = scan(frame, [], [F.col("id")], few=few).select("id", "position", "group_rows").collect()
        assert sorted(r["position"] for r in whole) == list(range(1, 902)) and {r["group_rows"] for r in whole} == {901}
        assert scan(frame.limit(0), ["g"], [F.col("id")], few=few).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 0.9995, 1.0])
def test_quantiles(spark, share):
    rng = random.Random(int(share * 100))
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 9000, "ties": [float(rng.randint(0, 3)) for _ in range(6001)],
              "many": [rng.gauss(0, 1) for _ in range(12_000)], None: [0.5, None, 1.5, None], "none": [None]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: (r["n"], r["value"]) for r in quantiles(frame, ["g"], F.col("v"), share).collect()}
    want = {}
    for g, values in groups.items():
        kept = sorted(v for v in values if v is not None)
        if kept:
            at = (len(kept) - 1) * share
            a, b = kept[math.floor(at)], kept[math.ceil(at)]
            want[g] = len(kept), pytest.approx(a + (b - a) * (at - math.floor(at)), abs=1e-12)
    assert found == want
    whole = sorted(v for _, v in rows if v is not None)
    at = (len(whole) - 1) * share
    a, b = whole[math.floor(at)], whole[math.ceil(at)]
    assert quantiles(frame, [], F.col("v"), share).first()["value"] == pytest.approx(a + (b - a) * (at - math.floor(at)), abs=1e-12)


def test_quantiles_gather_no_group(spark):
    frame = spark.range(100).selectExpr("id % 3 AS g", "CAST(id AS double) AS v")
    plan = quantiles(frame, ["g"], F.col("v"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "collect_list" not in plan
