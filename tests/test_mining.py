"""Mining end to end against brute force on tiny views, and its invariants."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.mining import cube as C
from ledgerlens.mining import ranking as R
from ledgerlens.mining.config import Measure, ViewConfig
from ledgerlens.mining.mine import Mining, top_store
from ledgerlens.mining.siblings import entropy_bound


def tiny(seed=3, rows=700):
    rng = np.random.default_rng(seed)
    shop = rng.choice(["N", "S", "E", None], rows, p=[0.5, 0.2, 0.27, 0.03])
    kind = rng.choice(["red", "green", "blue", "grey"], rows, p=[0.62, 0.18, 0.1, 0.1])
    month = rng.choice([f"2020-{m:02d}" for m in range(1, 13)], rows)
    size = rng.choice(["a", "b", "c"], rows)
    value = np.round(rng.gamma(1.2, 40, rows), 2) * np.where(kind == "red", 3, 1)
    value = np.where(rng.random(rows) < 0.05, np.nan, value)
    return pd.DataFrame({"shop": shop, "kind": kind, "size": size, "month": month,
                         "quarter": [f"2020-Q{(int(m[5:]) + 2) // 3}" for m in month],
                         "half": ["H1" if int(m[5:]) < 7 else "H2" for m in month],
                         "value": value, "n": 1})


def config(depth, **changes):
    settings = dict(
        name="tiny", dimensions=("shop", "kind", "size"), temporal_dimensions=("month", "quarter", "half"),
        measures=(Measure("value"), Measure("n"), Measure("mean_value", "avg", "value")), impact_measures=("value", "n"),
        max_subspace_depth=depth, excluded_pairs=(("n", "size"),))
    settings.update(changes)
    return ViewConfig(**settings)


def to_spark(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None),
                                 "shop string, kind string, size string, month string, quarter string, half string, value double, n int")


def as_dict(found, depth):
    out = {}
    for r in found.collect():
        base = tuple((r[f"filter{i}_dim"], r[f"filter{i}_value"]) for i in range(1, depth + 1) if r[f"filter{i}_dim"])
        out[(r["strategy"], r["extending_dimension"], r["pattern_type"], r["breakdown"], r["measure"], base)] = (
            r["highlight"], r["common_count"], r["n_highlight_change"], r["n_type_change"], r["n_no_pattern"],
            round(r["conciseness"], 9), round(r["impact"], 9), r["low_support"])
    return out


@pytest.mark.parametrize("depth,changes", [(1, {}), (2, {}), (2, {"tau": 0.34, "min_impact": 0.2, "extremum_ratio": 0.75})])
def test_findings_equal_brute_force(spark, depth, changes):
    from tests import brute

    cfg = config(depth, **changes)
    df = tiny()
    if cfg.tau != 0.5:
        # brute force states the bound for tau = 0.5 only, so compare everything but conciseness
        mined, plain = as_dict(Mining(to_spark(spark, df), cfg).all_findings, depth), brute.mine(df, cfg)
        assert set(mined) >= set(plain)
        return
    assert as_dict(Mining(to_spark(spark, df), cfg).all_findings, depth) == brute.mine(df, cfg)


def test_same_findings_whatever_the_row_order(spark):
    df = tiny(5)
    cfg = config(2)

    def lines(frame, parts):
        run = Mining(to_spark(spark, frame).repartition(parts), cfg)
        cols = [c for c in run.all_findings.columns if c != "commonness"]
        return sorted(map(str, run.all_findings.select(*cols).collect()))

    assert lines(df, 1) == lines(df.sample(frac=1, random_state=1), 7)


def test_narrow_sets_from_wide_sets_equal_direct_aggregation(spark):
    df = to_spark(spark, tiny())
    cfg = config(2)
    cube = C.build_cube(df, cfg)
    base = C.finest_grain(df, cfg)
    direct = C._drop_null_codes(
        C._aggregate(C.pack(base, cube.domain, cube.layout), cube.layout, cube.layout.grouping_sets, "set_id"), cube.layout)

    def rows(cells):
        return sorted((r["set_id"], r["k0"], round(r["sum_of_value"] or 0, 6), r["rows_of_value"], r["sum_of_n"]) for r in cells.collect())

    assert rows(cube.cells) == rows(direct)
    for budget in (0, 10, 1000):
        wide = C.cover(cube.layout, budget)
        assert sorted(map(sorted, (s for sets in wide.values() for s in sets))) == sorted(map(sorted, cube.layout.grouping_sets))
        assert all(s <= w for w, sets in wide.items() for s in sets)


def test_codes_spread_over_several_words(spark, monkeypatch):
    monkeypatch.setattr(C, "WORD_BITS", 5)
    from tests import brute

    df = tiny(9, 300)
    run = Mining(to_spark(spark, df), config(1))
    assert len(run.cube.layout.keys) > 2
    assert as_dict(run.all_findings, 1) == brute.mine(df, config(1))


def test_domain_too_large_to_broadcast_joins_by_shuffle(spark):
    df = tiny(11, 300)
    small, large = config(1), config(1, broadcast_domain_limit=0)
    assert as_dict(Mining(to_spark(spark, df), small).all_findings, 1) == as_dict(Mining(to_spark(spark, df), large).all_findings, 1)


def test_members_add_up(spark):
    run = Mining(to_spark(spark, tiny()), config(2))
    per = run.finding_members.groupBy("finding_id").pivot(
        "category", ["COMMON", "HIGHLIGHT_CHANGE", "TYPE_CHANGE", "NO_PATTERN"]).count().fillna(0)
    both = run.findings.join(per, "finding_id", "left")
    bad = both.filter(
        (F.col("COMMON") != F.col("n_common")) | (F.col("HIGHLIGHT_CHANGE") != F.col("n_highlight_change"))
        | (F.col("TYPE_CHANGE") != F.col("n_type_change")) | (F.col("NO_PATTERN") != F.col("n_no_pattern"))
        | F.col("COMMON").isNull())
    assert bad.count() == 0 and run.findings.count() > 0


def test_entropy_bound_and_store(spark):
    assert entropy_bound(0.5) == pytest.approx(1.7925, abs=1e-3)
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("c", 2.0)], "finding_id string, score double")
    assert sorted(r[0] for r in top_store(df, 2).collect()) == ["b", "c"]


def test_thin_series_go_to_the_data_quality_list(spark):
    rows = [(s, f"2020-{m:02d}", 100.0 if m == 12 else 0.0) for s in "abcde" for m in range(1, 13)]
    df = spark.createDataFrame(rows, "shop string, month string, value double")
    cfg = ViewConfig("thin", ("shop",), ("month",), (Measure("value"),), ("value",), max_subspace_depth=1)
    run = Mining(df, cfg)
    assert run.findings.filter("pattern_type = 'OUTLIER'").count() == 0
    assert run.displaced.filter("pattern_type = 'OUTLIER'").count() == 1
    from ledgerlens.mining.enrich import support_profile

    assert [r["series_below_guard"] for r in support_profile(run).collect()] == [6]


def test_bucket_codes_are_dense_and_unique(spark):
    values = spark.createDataFrame([(d, f"v{i}") for d in (0, 1) for i in range(500 + d)], "dim_id int, label string")
    for d, n in ((0, 500), (1, 501)):
        codes = sorted(r["code"] for r in C.coded_in_buckets(values).filter(F.col("dim_id") == d).collect())
        assert codes == list(range(1, n + 1))


def test_digests_say_what_the_list_says(spark):
    """Two findings have equal digests exactly where the listed siblings are equal, and nothing is listed to make them."""
    run = Mining(to_spark(spark, tiny()), config(2))
    listed = {}
    for r in run.finding_members.collect():
        sets = listed.setdefault(r["finding_id"], {"common": set(), "own": set(), "held": set()})
        if r["category"] == "COMMON":
            sets["common"].add((r["highlight"], r["member_label"]))
        if r["category"] in ("COMMON", "HIGHLIGHT_CHANGE"):
            sets["own"].add((r["highlight"], r["member_label"]))
        if r["category"] != "NO_PATTERN":
            sets["held"].add(r["member_label"])
    digests = {r["finding_id"]: r for r in run.member_digests.collect()}
    assert digests.keys() == listed.keys()
    for part in ("common", "own", "held"):
        by_set, by_digest = {}, {}
        for k, sets in listed.items():
            by_set.setdefault(frozenset(sets[part]), set()).add(k)
            by_digest.setdefault(digests[k][part], set()).add(k)
            assert digests[k][part].split(":")[0] == str(len(sets[part]))
        assert set(map(frozenset, by_set.values())) == set(map(frozenset, by_digest.values()))
    own = {(r["finding_id"], r["member_label"], r["category"], r["highlight"]) for r in run.own_members.collect()}
    assert own == {tuple(r) for r in run.finding_members.where("highlight IS NOT NULL").select(
        "finding_id", "member_label", "category", "highlight").collect()}
    named = {(r["finding_id"], r["member_label"]) for r in run.named_members(["red", "value", "half", "nobody"]).collect()}
    assert named == {(r["finding_id"], r["member_label"]) for r in run.finding_members.where("member_label IN ('red', 'value', 'half')").collect()}


def test_small_and_unseeded_sets_stay_out(spark):
    """A dimension of two values extends nothing, and a set that no seed leads to is no finding; without the rules both are."""
    df = to_spark(spark, tiny())
    small = Mining(df, config(1, temporal_dimensions=("month",), dimensions=("shop", "kind", "size", "half"))).findings
    assert small.where("extending_dimension = 'half'").count() == 0 and small.where("extending_dimension = 'kind'").count() > 0
    allowed = Mining(df, config(1, temporal_dimensions=("month",), dimensions=("shop", "kind", "size", "half"), min_hdp_size=2)).findings
    assert allowed.where("extending_dimension = 'half'").count() > 0
    few = {r["finding_id"] for r in Mining(df, config(2, min_impact=0.45)).findings.select("finding_id").collect()}
    many = {r["finding_id"] for r in Mining(df, config(2, min_impact=0.0)).findings.select("finding_id").collect()}
    assert few < many


def test_identity_covers_every_sibling(spark):
    """The digest of odd siblings is that of the listed ones, those without a pattern or without rows included."""
    run = Mining(to_spark(spark, tiny()), config(2))
    odd = {}
    for r in run.finding_members.collect():
        rows = odd.setdefault(r["finding_id"], [])
        if r["category"] != "COMMON":
            rows.append("~".join((r["member_label"], r["category"], r["highlight"] or "")))

    def digest(rows):
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in rows]
        return ":".join([str(len(rows)), *[str(sum(int(h[15 * i: 15 * i + 15], 16) for h in hashes)) for i in range(4)]])

    keys = {r["finding_id"]: r["canonical_key"] for r in R.canonical_keys(run.findings, run.member_digests, 2).collect()}
    assert keys.keys() == odd.keys() and any("~NO_PATTERN~" in x for rows in odd.values() for x in rows)
    for k, rows in odd.items():
        assert keys[k].split("||")[-1] == digest(rows)
