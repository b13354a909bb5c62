"""Checks with the write, parity by digests and slices by number, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.mining import readable as R
from ledgerlens.operators import quality as D
from ledgerlens.operators.checked import ViewChecks, write_checked
from ledgerlens.session import scratch_path

SCHEMA = "k long, part string, price double, day date"


def report(spark, df, checks):
    written, rows = write_checked(df, scratch_path(spark, "checked"), checks)
    return written, {(r.check_name, r.subject): (r.found, r.passed) for r in rows.collect()}


def test_checks_ride_on_the_write(spark):
    import datetime as dt

    rows = [(1, "a", 1.0, dt.date(2020, 1, 1)), (1, "b", None, dt.date(2021, 12, 31)), (2, None, 2.0, None), (None, "z", 3.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rows", F.lit(1))
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    checks = ViewChecks(
        rows=(1, 3), null_share={"price": 0.25, "part": 0.1}, domains={"part": ["a", "b"]}, spans={"day": (1, 3)},
        grains=(("k", "part"), ("k",)), unique=("k", "part"), parents={"k": (parent, "id")})
    written, got = report(spark, df, checks)
    assert written.count() == 4 and written.columns == [*df.columns]
    assert got == {
        ("rows", ""): (4.0, False), ("null_share", "price"): (0.25, True), ("null_share", "part"): (0.25, False),
        ("unexpected", "part"): (1.0, False), ("span_years", "day"): (2.0, True), ("repeated_keys", "k,part"): (0.0, True),
        ("repeated_keys", "k"): (1.0, False), ("duplicates", "k"): (2.0, False), ("duplicates", "part"): (1.0, False),
        ("orphans", "k"): (1.0, False)}


def test_checks_of_no_rows(spark):
    checks = ViewChecks(
        rows=(0, 3), null_share={"price": 0.25}, domains={"part": ["a"]}, spans={"day": (1, 3)}, grains=(("k",),), unique=("k",),
        parents={"k": (spark.createDataFrame([(1,)], "id long"), "id")})
    _, got = report(spark, spark.createDataFrame([], SCHEMA), checks)
    assert got == {
        ("rows", ""): (0.0, True), ("null_share", "price"): (None, None), ("unexpected", "part"): (0.0, True),
        ("span_years", "day"): (None, None), ("repeated_keys", "k"): (0.0, True), ("duplicates", "k"): (0.0, True), ("orphans", "k"): (0.0, True)}


def plain_parity(left, right):
    a, b = ({r[:2]: r[2:] for r in side if None not in r[:2]} for side in (left, right))
    nulls = [sum(None in r[:2] for r in side) for side in (left, right)]
    same = lambda x, y: x == y or (x is not None and y is not None and (x != x and y != y or abs(x - y) <= 1e-6 + 1e-9 * abs(y)))
    both = a.keys() & b.keys()
    return {"v": sum(not same(a[k][0], b[k][0]) for k in both), "w": sum(a[k][1] != b[k][1] for k in both),
            "only_left": len(a.keys() - b.keys()) + nulls[0], "only_right": len(b.keys() - a.keys()) + nulls[1]}


@pytest.mark.parametrize("changes", [0, 1, 40])
def test_parity_equals_plain_loop(spark, changes):
    rng = random.Random(changes)
    nan = float("nan")
    left = [(k, f"g{k % 7}", rng.choice([None, nan, rng.random(), 1e9]), rng.choice([None, "x", "y"])) for k in range(600)] + [(None, "g", 1.0, "x")]
    right = list(left)
    for _ in range(changes):
        i = rng.randrange(len(right))
        k, g, v, w = right[i]
        right[i] = rng.choice([(k, g, None, w), (k, g, 5.0, w), (k, g, v, "other"), (k, "h", v, w), (k, g, v if v is None else v + 1e-9, w)])
    rng.shuffle(right)
    schema = "k long, g string, v double, w string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r.check_name: r.mismatches for r in D.table_parity(a, b, ["k", "g"]).collect()}
    assert got == plain_parity(left, right)
    x, y = D.differing_rows(a, b, ["k", "g"], ["v", "w"])
    assert x.count() <= 1 + 3 * changes and y.count() <= 1 + 3 * changes


def test_null_and_moved_values_are_told_apart(spark):
    a = spark.createDataFrame([(1, None, 5), (2, 5, None)], "k int, v int, w int")
    b = spark.createDataFrame([(1, 5, None), (2, None, 5)], "k int, v int, w int")
    assert {r.check_name: r.mismatches for r in D.table_parity(a, b, ["k"]).collect()} == {"v": 2, "w": 2, "only_left": 0, "only_right": 0}
    assert {r.mismatches for r in D.table_parity(a.limit(0), b.limit(0), ["k"]).collect()} == {0}


def test_slices_by_number(spark, tables):
    from ledgerlens.catalog.mining_queries import mining

    cube = mining(tables, depth=2).cube
    labels = {d: [] for d in cube.config.all_dims}
    for r in cube.domain.collect():
        labels[cube.config.all_dims[r.dim_id]].append(r.label)
    want = []
    for filters in cube.layout.filter_sets:
        for values in itertools.product(*[labels[d] for d in filters]):
            pairs = [*zip(filters, values), ("", ""), ("", "")][:2]
            want.append(tuple(x for p in pairs for x in p))
    got = [tuple(r) for r in R.subspaces(cube).collect()]
    assert sorted(got) == sorted(want) and len(got) == sum(R.set_sizes(cube))
    scopes = R.scope_list(cube)
    assert scopes.count() == scopes.distinct().count() == R.scope_count(cube)
    assert scopes.filter("breakdown IN (filter1_dim, filter2_dim)").count() == 0
    numbers = R.unranked(cube, [3] * len(cube.layout.filter_sets))
    assert numbers.count() == numbers.distinct().count() == 3 * len(want)
