"""Ranking against plain loops over the same findings."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.catalog.ranking_queries import pool
from ledgerlens.mining import ranking as R
from ledgerlens.mining.mine import Mining
from tests.test_mining import config, tiny, to_spark


@pytest.fixture(scope="module")
def run(spark):
    return Mining(to_spark(spark, tiny(21)), config(2))


def filters(r):
    return {(r[f"filter{i}_dim"], r[f"filter{i}_value"]) for i in (1, 2) if f"filter{i}_dim" in r and r[f"filter{i}_dim"]}


def ratio(a, b):
    if a["strategy"] != b["strategy"] or a["pattern_type"] != b["pattern_type"]:
        return 0.0
    fa, fb = filters(a), filters(b)
    m, k = a["measure"] == b["measure"], a["breakdown"] == b["breakdown"]
    if not (m or k or (fa and fb and fa & fb)):
        return 0.0
    sub = 1.0 if not fa and not fb else 0.0 if not fa or not fb else len(fa & fb) / min(len(fa), len(fb))
    e = a["extending_dimension"] == b["extending_dimension"]
    return {"subspace": 0.4 * sub + 0.3 * e + 0.15 * m + 0.15 * k, "measure": 0.6 * sub + 0.4 * k, "breakdown": 0.6 * sub + 0.4 * m}[a["strategy"]]


def greedy(rows, k):
    rows = sorted(rows, key=lambda r: (-round(r["score"], 12), r["finding_id"]))
    picked = [rows[0]]
    while len(picked) < k:
        rest = [r for r in rows if r not in picked]
        gains = [r["score"] - sum(min(r["score"], s["score"]) * ratio(r, s) for s in picked) for r in rest]
        if not rest or round(max(gains), 12) <= 0:
            break
        best = max(range(len(rest)), key=lambda i: (round(gains[i], 12), -i))
        picked.append(rest[best])
    return [r["finding_id"] for r in picked]


def test_greedy_rank(run):
    rows = [r.asDict() for r in run.findings.collect()]
    got = [r["finding_id"] for r in R.rank(run.findings, 2, 12).orderBy("view_rank").collect()]
    assert got == greedy(rows, 12) and len(got) > 3


@pytest.mark.parametrize("fetched", [1, 2, 5])
def test_picks_do_not_depend_on_the_rows_fetched(run, monkeypatch, fetched):
    """Few rows a job mean more jobs and the same picks, gains to the bit; so do several groups that end apart."""
    jobs = []
    first_of = R._first_of
    monkeypatch.setattr(R, "_first_of", lambda *a: jobs.append(1) or first_of(*a))
    group = F.col("pattern_type")
    few = R.rank(run.findings, 2, 12, group, fetched=fetched)
    assert len(jobs) > 1
    assert sorted(few.collect()) == sorted(R.rank(run.findings, 2, 12, group, fetched=10_000).collect())
    rows = [r.asDict() for r in run.findings.collect()]
    for kind in {r["pattern_type"] for r in rows}:
        got = [r["finding_id"] for r in few.where(F.col("group") == kind).orderBy("view_rank").collect()]
        assert got == greedy([r for r in rows if r["pattern_type"] == kind], 12)


def test_no_findings(run):
    none = run.findings.limit(0)
    assert R.rank(none, 2).count() == 0 and R.pair_overlaps(none, 2).count() == 0 and R.total_use(none, 2).count() == 0


def test_overlap_of_collected_rows(run):
    rows = run.findings.select("finding_id", R.filter_array(2).alias("filters"), *R.SLIM).orderBy("finding_id").limit(150)
    a, b = rows.alias("a"), rows.alias("b")
    both = a.crossJoin(b).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    for r in both.withColumn("ratio", R.overlap_ratio("a", "b")).collect():
        assert R.overlap_of(r["a"], r["b"]) == r["ratio"]


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_in_blocks(run, block):
    rows = [r.asDict() for r in run.findings.collect()]
    got = {(r["id_a"], r["id_b"]): (r["ratio"], r["redundancy"]) for r in R.pair_overlaps(run.findings, 2, block).collect()}
    assert R.pair_overlaps(run.findings, 2, block).count() == len(got)
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1:]:
            if v := ratio(x, y):
                want[tuple(sorted((x["finding_id"], y["finding_id"])))] = v, min(x["score"], y["score"]) * v
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_total_use_forms_no_pair(run):
    plan = R.total_use(run.findings, 2)._jdf.queryExecution().executedPlan().toString()
    assert "finding_id" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_total_use_of_all(run):
    rows = [r.asDict() for r in run.findings.collect()]
    plain = sum(r["score"] for r in rows) - sum(min(a["score"], b["score"]) * ratio(a, b) for i, a in enumerate(rows) for b in rows[i + 1:])
    assert R.total_use(run.findings, 2).first()["total_use"] == pytest.approx(plain, rel=1e-9)


def test_total_use(run):
    top = R.prefilter(run.findings, 25)
    rows = [r.asDict() for r in top.collect()]
    plain = sum(r["score"] for r in rows) - sum(
        min(a["score"], b["score"]) * ratio(a, b) for i, a in enumerate(rows) for b in rows[i + 1:])
    assert R.total_use(top, 2).first()["total_use"] == pytest.approx(plain, rel=1e-9)


def test_twins_merge_once(run):
    merged = R.merge_twins(run.findings, run.own_digests, 2).collect()
    lost = run.findings.count() - len(merged)
    assert lost == sum(len(r["merged_twins"]) for r in merged)
    assert lost > 0
    assert len({r["finding_id"] for r in merged}) == len(merged)


def test_gamma_half_changes_nothing(run):
    both = R.gamma_rescored(run.findings, [0.5], 0.5).select("finding_id", F.col("score").alias("again")).join(run.findings, "finding_id")
    assert both.filter(F.abs(F.col("again") - F.col("score")) > 1e-12).count() == 0


def test_gamma_sensitivity(run):
    rows = {r["gamma"]: r for r in R.gamma_sensitivity(run.findings, 2, 0.5, [0.1, 0.5, 0.9], 0.5, 10).collect()}
    assert rows[0.5]["entered"] == 0 and rows[0.5]["exited"] == 0
    for g in (0.1, 0.9):
        scored = [r.asDict() for r in R.gamma_rescored(run.findings, [g], 0.5).filter("score > 0").collect()]
        base = set(greedy([r.asDict() for r in run.findings.collect()], 10))
        mine = greedy(scored, 10)
        assert rows[g]["entered"] == len(set(mine) - base) and rows[g]["exited"] == len(base - set(mine))
        assert rows[g]["universal"] + rows[g]["actionable"] == len(mine)


def test_feed(tables):
    entries = R.lineage_dedup(pool(tables))
    rows = [r.asDict() for r in entries.collect()]
    got = {r["finding_id"]: r for r in R.select_feed(entries, 1, 12).collect()}

    def overlap(a, b):
        if a["view"] == b["view"]:
            return ratio(a, b)
        fa, fb = set(a["c_filters"]), set(b["c_filters"])
        m, k = a["c_measure"] == b["c_measure"], a["c_breakdown"] == b["c_breakdown"]
        if a["pattern_type"] != b["pattern_type"] or not (m or k or (fa and fb and fa & fb)):
            return 0.0
        sub = 1.0 if not fa and not fb else 0.0 if not fa or not fb else len(fa & fb) / min(len(fa), len(fb))
        return 0.4 * sub + 0.3 * (a["c_extending"] == b["c_extending"]) + 0.15 * m + 0.15 * k

    rows.sort(key=lambda r: (-round(r["global_score"], 12), r["view"], r["view_rank"]))
    seeds = [min((r for r in rows if r["view"] == v), key=lambda r: r["view_rank"]) for v in sorted({r["view"] for r in rows})]
    picked = sorted(seeds, key=lambda r: -r["global_score"])

    def gain(r):
        worst = max(min(r["global_score"], s["global_score"]) * overlap(r, s) for s in picked)
        return r["global_score"] - min(r["global_score"], worst)

    while len(picked) < 12:
        rest = [r for r in rows if r not in picked]
        gains = [round(gain(r), 12) for r in rest]
        if not rest or max(gains) <= 0:
            break
        picked.append(rest[gains.index(max(gains))])
    assert sorted(R.select_feed(entries, 1, 12, fetched=2).collect()) == sorted(got.values())
    order = sorted((r for r in got.values() if r["feed_rank"] > 0), key=lambda r: r["feed_rank"])
    assert [r["finding_id"] for r in order] == [r["finding_id"] for r in picked]
    assert {r["finding_id"] for r in order if r["seed"]} == {r["finding_id"] for r in seeds}
    left = R.rejected(R.select_feed(entries, 1, 12), 5).collect()
    assert left == sorted(left, key=lambda r: -r["global_score"])


def test_finding_diff_and_identity(run):
    one, other = run.findings, run.findings.filter("strategy = 'subspace'")
    changed = R.finding_diff(one, other, run.own_digests, run.own_digests)
    assert changed.filter("change = 'exited'").count() == 0
    assert changed.filter("change = 'entered'").count() == one.filter("strategy <> 'subspace'").count()
    keys = R.canonical_keys(run.findings, run.member_digests, 2)
    assert keys.select("canonical_key").distinct().count() == run.findings.count()


def test_sentences_name_their_exceptions(run):
    rows = R.with_sentences(run.findings, run.finding_members).collect()
    for r in rows:
        odd = r["n_highlight_change"] + r["n_type_change"] + r["n_no_pattern"]
        label = ". Not even in: " if r["pattern_type"] == "EVENNESS" else ". Exception: " if odd == 1 else ". Exceptions: "
        assert r["sentence"].startswith("For ") and (label in r["sentence"]) == (odd > 0)
        assert (" more" in r["sentence"].replace("more than half", "")) == (odd > 3)
