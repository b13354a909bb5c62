"""Registered queries do the whole job that they name."""

import datetime as dt
import random

import pytest

from ledgerlens.catalog import QUERIES


@pytest.fixture(scope="module")
def growing(spark, tmp_path_factory):
    """Orders of four years that grow in number and price, from customers of three regions and segments."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("growing")
    places = [(k, f"R{k}") for k in range(3)]
    nations = [(k, f"N{k}", k // 2) for k in range(6)]
    customers = [(k, k % 6, f"S{k % 3}", float(rng.randrange(1000))) for k in range(60)]
    orders = []
    for month in range(48):
        for _ in range(40 + 4 * month):
            day = dt.date(1995 + month // 12, month % 12 + 1, rng.randrange(1, 28))
            orders.append((len(orders), rng.randrange(60), rng.choice("FOP"), 1000.0 + 50 * month + rng.randrange(50), day,
                           f"{rng.randrange(1, 6)}-P"))
    for name, rows, schema in (
            ("region", places, "r_regionkey long, r_name string"),
            ("nation", nations, "n_nationkey long, n_name string, n_regionkey long"),
            ("customer", customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_seed_rule_is_for_the_whole_view(spark, growing):
    """m24 gives the findings below a filter, for every dimension, time grain and measure of the view."""
    got = sorted(map(tuple, QUERIES["m24_seed_rule"](spark, growing).collect()))
    every = QUERIES["m27_scored_findings"](spark, growing).filter("filter1_dim <> ''").collect()
    assert got == sorted(map(tuple, every))
    assert {r["filter1_dim"] for r in every} == {"r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus"}
    assert "month" in {r["breakdown"] for r in every}
