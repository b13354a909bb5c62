"""Registered queries: ranking, feed and enrichment of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog import mining_sql as ms
from ledgerlens.catalog.mining_queries import _VIEWS, mining
from ledgerlens.catalog.registry import query
from ledgerlens.mining import enrich as E
from ledgerlens.mining import ranking as R
from ledgerlens.mining.siblings import entropy_bound
from ledgerlens.operators.aggregates import content_hash
from ledgerlens.operators.joins import with_bounds
from ledgerlens.session import cut_lineage
from ledgerlens.tables import Tables

GAMMAS = [0.1, 0.3, 0.5, 0.7, 0.9]
FEED_VIEWS = ("documents", "events", "orders")
# names of one source concept in several views
LINEAGE = {
    ("orders", "orders"): "rows", ("events", "events"): "rows", ("documents", "documents"): "rows",
    ("orders", "price"): "amount", ("events", "value"): "amount",
    ("orders", "mean_price"): "mean amount", ("events", "mean_value"): "mean amount",
}


def cand_ctes(view: str) -> list[str]:
    """The finding CTEs plus cand: findings with their identity and rounded score."""
    _, config, text = _VIEWS[view]
    cfg = config(1)
    return ms.ctes(text, cfg) + ms.hit_ctes(cfg) + ms.finding_ctes(cfg) + [
        f"cand AS (SELECT '{view}' AS view, concat_ws('~', '{view}', strategy, ext, type, gb, gm, g1d, g1v) AS id, *, "
        "round(score, 12) AS rs FROM finds WHERE NOT low_support)",
    ]


def sql(select: str, view: str = "orders", extra: list[str] = ()) -> str:
    return ms.statement(cand_ctes(view) + list(extra), select)


# members of the commonest highlight, as one text per finding
TWIN = """common AS (SELECT c.id, string_agg(m.member, ',' ORDER BY m.member) AS members FROM cand c JOIN mem m
  USING (strategy, g1d, g1v, g2d, g2v, ext, gb, gm, type, highlight) GROUP BY c.id)"""
MERGED = """twin AS (SELECT cand.*, CASE WHEN type IN ('OUTSTANDING_1', 'ATTRIBUTION') THEN '' ELSE id END AS own, members
   FROM cand LEFT JOIN common USING (id)),
 tw AS (SELECT *, row_number() OVER (PARTITION BY own, g1d, g1v, strategy, ext, gb, gm, highlight, members ORDER BY rs DESC, id) AS rn,
   string_agg(type, ',') OVER (PARTITION BY own, g1d, g1v, strategy, ext, gb, gm, highlight, members) AS types FROM twin),
 merged AS (SELECT * FROM tw WHERE rn = 1)"""


def ratio_sql(a: str, b: str) -> str:
    """Overlap ratio at depth 1, where a base slice has at most one filter."""
    shared = f"CASE WHEN {a}.g1d <> '' AND {a}.g1d = {b}.g1d AND {a}.g1v = {b}.g1v THEN 1 ELSE 0 END"
    sub = f"CASE WHEN {a}.g1d = '' AND {b}.g1d = '' THEN 1.0 ELSE {shared} END"
    m, k, e = f"({a}.gm = {b}.gm)::INT", f"({a}.gb = {b}.gb)::INT", f"({a}.ext = {b}.ext)::INT"
    return f"""CASE WHEN {a}.strategy <> {b}.strategy OR {a}.type <> {b}.type OR NOT ({a}.gm = {b}.gm OR {a}.gb = {b}.gb OR {shared} = 1) THEN 0.0
      WHEN {a}.strategy = 'subspace' THEN 0.4 * {sub} + 0.3 * {e} + 0.15 * {m} + 0.15 * {k}
      WHEN {a}.strategy = 'measure' THEN 0.6 * {sub} + 0.4 * {k} ELSE 0.6 * {sub} + 0.4 * {m} END"""


def greedy_ctes(source: str, k: int = 15) -> list[str]:
    """Greedy picks as a recursive statement: each step takes the best score less overlap with the picks so far."""
    return [
        f"ov AS MATERIALIZED (SELECT a.id AS a, b.id AS b, least(a.score, b.score) * ({ratio_sql('a', 'b')}) AS red FROM {source} a, {source} b WHERE a.id <> b.id)",
        f"src AS MATERIALIZED (SELECT id, score, rs FROM {source})",
        f"""picks(step, ids) AS (
          SELECT 1, [(SELECT id FROM src ORDER BY rs DESC, id LIMIT 1)]
          UNION ALL
          SELECT step + 1, list_append(ids, arg_min(id, (-gain, -rs, id))) FROM (
            SELECT p.step, p.ids, s.id, s.rs, round(s.score - coalesce(sum(o.red), 0), 12) AS gain
            FROM picks p JOIN src s ON NOT list_contains(p.ids, s.id)
            LEFT JOIN ov o ON o.a = s.id AND list_contains(p.ids, o.b)
            WHERE p.step < {k} GROUP BY p.step, p.ids, s.id, s.rs, s.score) GROUP BY step, ids HAVING max(gain) > 0)""",
        "ranked AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS view_rank FROM (SELECT ids FROM picks ORDER BY step DESC LIMIT 1))",
    ]


def greedy_sql(select: str, view: str, merged: bool) -> str:
    extra = ([TWIN, MERGED] if merged else []) + greedy_ctes("merged" if merged else "cand")
    return ms.statement(cand_ctes(view) + extra, select).replace("WITH ", "WITH RECURSIVE ", 1)


def _digest_sql(text: str, when: str) -> str:
    pieces = ", ".join(f"coalesce(sum(('0x' || substr(sha256({text}), {1 + 15 * i}, 15))::BIGINT) FILTER ({when}), 0)" for i in range(4))
    return f"concat_ws(':', count(*) FILTER ({when}), {pieces})"


_MEMBERS = ms.member_ctes(_VIEWS["orders"][1](1))


@query("m29_canonical_identity", sql(f"""SELECT id AS finding_id, concat_ws('||', strategy, ext, type, gb, gm, CASE WHEN g1d = '' THEN '' ELSE g1d || '=' || g1v END,
  CAST(size AS VARCHAR), {_digest_sql("concat_ws('~', own_highlight, member)", "category = 'COMMON'")},
  {_digest_sql("concat_ws('~', member, category, coalesce(own_highlight, ''))", "category <> 'COMMON'")}) AS canonical_key
FROM full_members GROUP BY id, strategy, ext, type, gb, gm, g1d, g1v, size""", extra=_MEMBERS))
def m29(t: Tables) -> DataFrame:
    run = mining(t)
    return R.canonical_keys(run.findings, run.member_digests, 1)


@query("r01_twin_merge", sql("""SELECT id AS finding_id, type AS pattern_type, round(score, 6) AS score,
  CASE WHEN own = '' AND contains(types, ',') THEN CASE type WHEN 'ATTRIBUTION' THEN 'OUTSTANDING_1' ELSE 'ATTRIBUTION' END ELSE '' END AS merged_twins
FROM merged""", "documents", [TWIN, MERGED]))
def r01(t: Tables) -> DataFrame:
    run = mining(t, "documents")
    return R.merge_twins(run.findings, run.own_digests, 1).select(
        "finding_id", "pattern_type", F.round("score", 6).alias("score"), F.concat_ws(",", "merged_twins").alias("merged_twins"))


@query("r02_prefilter", sql("SELECT id AS finding_id, round(score, 6) AS score FROM cand ORDER BY rs DESC, id LIMIT 40"))
def r02(t: Tables) -> DataFrame:
    return R.prefilter(mining(t).findings, 40).select("finding_id", F.round("score", 6).alias("score"))


_TOP = "top AS (SELECT * FROM cand)"
_PAIRS = f"SELECT a.id AS id_a, b.id AS id_b, {ratio_sql('a', 'b')} AS ratio, least(a.score, b.score) AS low FROM top a JOIN top b ON a.id < b.id"


@query("r03_overlap_ratio", sql(f"SELECT id_a, id_b, round(ratio, 6) AS ratio FROM ({_PAIRS}) WHERE ratio > 0", extra=[_TOP]))
def r03(t: Tables) -> DataFrame:
    return R.pair_overlaps(mining(t).findings, 1).select("id_a", "id_b", F.round("ratio", 6).alias("ratio"))


@query("r04_pairwise_redundancy", sql(f"SELECT id_a, id_b, round(low * ratio, 6) AS redundancy FROM ({_PAIRS}) WHERE ratio > 0", extra=[_TOP]))
def r04(t: Tables) -> DataFrame:
    return R.pair_overlaps(mining(t).findings, 1).select("id_a", "id_b", F.round("redundancy", 6).alias("redundancy"))


@query("r05_greedy_diversity_top_k", greedy_sql("SELECT id AS finding_id, CAST(view_rank AS INTEGER) AS view_rank FROM ranked", "orders", False))
def r05(t: Tables) -> DataFrame:
    return R.rank(mining(t).findings, 1).select("finding_id", "view_rank")


@query("r06_total_use", sql(f"""SELECT 'orders' AS view, (SELECT count(*) FROM top) AS selected,
  round((SELECT sum(score) FROM top) - (SELECT coalesce(sum(low * ratio), 0) FROM ({_PAIRS})), 6) AS total_use""", extra=[_TOP]))
def r06(t: Tables) -> DataFrame:
    return R.total_use(mining(t).findings, 1).withColumn("total_use", F.round("total_use", 6))


@query("r07_merge_prefilter_rank", greedy_sql("""SELECT r.id AS finding_id, CAST(view_rank AS INTEGER) AS view_rank, round(score, 6) AS score
FROM ranked r JOIN merged USING (id)""", "documents", True))
def r07(t: Tables) -> DataFrame:
    run = mining(t, "documents")
    return R.merge_prefilter_rank(run.findings, run.own_digests, 1).select(
        "finding_id", "view_rank", F.round("score", 6).alias("score"))


_G = "greatest(0.0, 1 - (common_entropy + {e} + CASE WHEN n_hc + n_tc + n_np = 0 THEN gamma ELSE 0.0 END) / " + repr(entropy_bound(0.5)) + ")"
_ENT = " + ".join(f"CASE WHEN {n} > 0 THEN -({n} / size) * log2({n} / size) ELSE 0.0 END" for n in ("n_hc", "n_tc", "n_np"))


@query("r08_gamma_rescore", sql(f"""SELECT id AS finding_id, gamma, round({_G.format(e=_ENT)}, 6) AS conciseness, round({_G.format(e=_ENT)} * impact, 6) AS score
FROM cand, (SELECT unnest({GAMMAS!r}) AS gamma)"""))
def r08(t: Tables) -> DataFrame:
    return R.gamma_rescored(mining(t).findings, GAMMAS, 0.5).select(
        "finding_id", "gamma", F.round("conciseness", 6).alias("conciseness"), F.round("score", 6).alias("score"))


def _gamma_sql(gamma: float, select: str) -> str:
    """Greedy picks of the order view at one gamma."""
    rescored = (
        f"cg AS (SELECT * EXCLUDE (score, rs), sg AS score, round(sg, 12) AS rs FROM (SELECT *, {_G.format(e=_ENT).replace('gamma', str(gamma))} * impact AS sg "
        "FROM cand) WHERE sg > 0)")
    body = ms.statement(cand_ctes("orders") + [rescored] + greedy_ctes("cg"), select)
    return f"SELECT CAST({gamma} AS DOUBLE) AS gamma, * FROM ({body.replace('WITH ', 'WITH RECURSIVE ', 1)})"


def _dual_sql(gamma: float) -> str:
    return _gamma_sql(gamma, "SELECT id AS finding_id, CAST(view_rank AS INTEGER) AS view_rank FROM ranked")


_USE = """SELECT id, n_hc + n_tc + n_np AS odd, score, (SELECT sum(c.score) FROM ranked JOIN cg c USING (id))
  - coalesce((SELECT sum(red) / 2 FROM ov WHERE a IN (SELECT id FROM ranked) AND b IN (SELECT id FROM ranked)), 0) AS use FROM ranked JOIN cg USING (id)"""
_SWEEP = f"""WITH g AS MATERIALIZED ({" UNION ALL ".join(_gamma_sql(x, _USE) for x in GAMMAS)}), base AS (SELECT id FROM g WHERE gamma = 0.5)
SELECT 'orders' AS view, gamma, count(*) FILTER (odd = 0) AS universal, count(*) FILTER (odd > 0) AS actionable, round(max(score), 6) AS top_score,
  round(any_value(use), 6) AS total_use, count(*) FILTER (id NOT IN (SELECT id FROM base)) AS entered,
  (SELECT count(*) FROM base) - count(*) FILTER (id IN (SELECT id FROM base)) AS exited FROM g GROUP BY gamma"""


@query("r09_ranking_sensitivity", _SWEEP)
def r09(t: Tables) -> DataFrame:
    out = R.gamma_sensitivity(mining(t).findings, 1, 0.5, GAMMAS, 0.5)
    return out.withColumns({"top_score": F.round("top_score", 6), "total_use": F.round("total_use", 6)})


@query("r10_dual_ranking", _dual_sql(0.1) + " UNION ALL " + _dual_sql(0.5))
def r10(t: Tables) -> DataFrame:
    scored = R.gamma_rescored(mining(t).findings, [0.1, 0.5], 0.5).filter("score > 0")
    return R.rank(scored, 1, group=F.col("gamma")).select(F.col("group").cast("double").alias("gamma"), "finding_id", "view_rank")


@query("r11_rank_decayed_global_score", greedy_sql("""SELECT id AS finding_id, CAST(view_rank AS INTEGER) AS view_rank,
  round(score * 0.25 * pow(0.85, view_rank - 1), 6) AS global_score FROM ranked JOIN cand USING (id)""", "orders", False))
def r11(t: Tables) -> DataFrame:
    found = mining(t).findings
    ranked = found.join(R.rank(found, 1).drop("group"), ["view", "finding_id"])
    return R.global_scores(ranked, {"orders": 0.25}).select("finding_id", "view_rank", F.round("global_score", 6).alias("global_score"))


@query("r12_coverage_per_view", """
SELECT view, entities, 0.5::DOUBLE AS weight, (SELECT count(DISTINCT o_custkey) FROM orders) <> (SELECT count(DISTINCT user_id) FROM events) AS uneven
FROM (SELECT 'orders' AS view, count(DISTINCT o_custkey) AS entities FROM orders UNION ALL SELECT 'events', count(DISTINCT user_id) FROM events)""")
def r12(t: Tables) -> DataFrame:
    return R.coverage({"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")})


_POOLS: dict[tuple, DataFrame] = {}


def pool(t: Tables) -> DataFrame:
    """Ranked findings of all views with their global scores, in source terms; written once per session and state of the folder."""
    if t.state not in _POOLS:
        _POOLS[t.state] = cut_lineage(_pool(t), "pool")
    return _POOLS[t.state]


def _pool(t: Tables) -> DataFrame:
    parts = []
    for view in FEED_VIEWS:
        run = mining(t, view)
        ranked = R.merge_prefilter_rank(run.findings, run.own_digests, 1)
        parts.append(ranked.withColumn("sentence", R.sentence()).select(
            "view", "finding_id", "sentence", "strategy", "extending_dimension", "pattern_type", "breakdown", "measure", "filter1_dim",
            "filter1_value", "highlight", "score", "view_rank"))
    every = reduce(DataFrame.unionByName, parts)
    weights = {v: 1 / len(FEED_VIEWS) for v in FEED_VIEWS}
    return R.in_source_terms(R.global_scores(every, weights), LINEAGE, 1)


def body_sql(h: str) -> str:
    """The words of a pattern with highlight `h`."""
    named = (f"list_aggregate(list_transform(string_split({h}, '|'), lambda x: string_split(x, ':')[1] || ' (' || lower(string_split(x, ':')[-1]) || ')'), "
             "'string_agg', ', ')")
    two = f"replace({h}, '|', ', ')"
    return f"""CASE type WHEN 'OUTSTANDING_1' THEN gm || ' is by far highest for ' || {h} || ' when split by ' || gb
      WHEN 'OUTSTANDING_LAST' THEN gm || ' is by far lowest for ' || {h} || ' when split by ' || gb
      WHEN 'TOP_TWO' THEN gm || ' is highest for the two of ' || {two} || ' when split by ' || gb
      WHEN 'LAST_TWO' THEN gm || ' is lowest for the two of ' || {two} || ' when split by ' || gb
      WHEN 'EVENNESS' THEN gm || ' differs little by ' || gb
      WHEN 'ATTRIBUTION' THEN 'more than half of ' || gm || ' belongs to ' || {h} || ' when split by ' || gb
      WHEN 'TREND' THEN gm || ' keeps ' || lower({h}) || ' along ' || gb
      WHEN 'OUTLIER' THEN gm || ' is unusual along ' || gb || ' at ' || {named}
      WHEN 'SEASONALITY' THEN gm || ' repeats along ' || gb || ' with ' || {h}
      WHEN 'CHANGE_POINT' THEN gm || ' moves to another level along ' || gb || ' from ' || {h} || ' on'
      ELSE gm || ' has a single ' || lower(string_split({h}, '|')[1]) || ' along ' || gb || ' at ' || string_split({h}, '|')[2] END"""


SENTENCE_SQL = f"""CASE WHEN round(common_count / size, 4) >= 1 THEN 'For every ' || ext || ': '
  WHEN round(common_count / size, 4) >= 0.9 THEN 'For nearly every ' || ext || ' (' || common_count || ' of ' || size || '): '
  ELSE 'For most of ' || ext || ' (' || common_count || ' of ' || size || '): ' END || {body_sql('highlight')}"""


def concept_sql(view: str, x: str) -> str:
    named = " ".join(f"WHEN '{name}' THEN '{concept}'" for (v, name), concept in LINEAGE.items() if v == view)
    return f"CASE {x} {named} ELSE {x} END"


def _pool_sql() -> str:
    """Ranked findings of the feed's views in source terms with their global scores, one finding for each lineage."""
    weight = 1 / len(FEED_VIEWS)
    parts = []
    for view in FEED_VIEWS:
        inner = greedy_sql(f"""SELECT '{view}' AS view, r.id, CAST(view_rank AS INTEGER) AS view_rank, strategy, type, ext, gb, gm, g1d, g1v, highlight,
          score * {weight!r} * pow(0.85, view_rank - 1) AS gs, {concept_sql(view, 'gm')} AS cm, {concept_sql(view, 'gb')} AS cb,
          {concept_sql(view, 'ext')} AS ce, CASE WHEN g1d = '' THEN '' ELSE {concept_sql(view, 'g1d')} || '=' || g1v END AS slice,
          {SENTENCE_SQL} AS sentence FROM ranked r JOIN merged USING (id)""", view, True)
        parts.append(f"SELECT * FROM ({inner})")
    return f"""pool AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)})
      QUALIFY row_number() OVER (PARTITION BY list_sort(list_distinct(list_filter([cm, cb, ce], lambda x: x <> '(varies)'))), type, slice, highlight
        ORDER BY round(gs, 12) DESC, view, view_rank) = 1)"""


def _feed_sql(select: str, k: int) -> str:
    sub = "CASE WHEN a.g1d = '' AND b.g1d = '' THEN 1.0 WHEN a.g1d <> '' AND a.slice = b.slice THEN 1.0 ELSE 0.0 END"
    across = f"""CASE WHEN a.type = b.type AND (a.cm = b.cm OR a.cb = b.cb OR (a.g1d <> '' AND a.slice = b.slice))
      THEN 0.4 * {sub} + 0.3 * (a.ce = b.ce)::INT + 0.15 * (a.cm = b.cm)::INT + 0.15 * (a.cb = b.cb)::INT ELSE 0.0 END"""
    return f"""WITH RECURSIVE {_pool_sql()},
    pov AS MATERIALIZED (SELECT a.id AS a, b.id AS b, least(a.gs, b.gs) * (CASE WHEN a.view = b.view THEN {ratio_sql('a', 'b')} ELSE {across} END) AS red
      FROM pool a, pool b WHERE a.id <> b.id),
    seeds AS (SELECT id, gs, view FROM pool QUALIFY row_number() OVER (PARTITION BY view ORDER BY view_rank) = 1),
    fp(step, ids, worsts, gains) AS (
      SELECT (SELECT count(*) FROM seeds), (SELECT list(id ORDER BY round(gs, 12) DESC, view) FROM seeds), (SELECT list(0.0::DOUBLE) FROM seeds),
        (SELECT list(gs ORDER BY round(gs, 12) DESC, view) FROM seeds)
      UNION ALL
      SELECT step + 1, list_append(ids, arg_min(id, o)), list_append(worsts, arg_min(worst, o)), list_append(gains, arg_min(gain, o)) FROM (
        SELECT *, gs - least(gs, worst) AS gain, (-round(gs - least(gs, worst), 12), -round(gs, 12), view, view_rank) AS o FROM (
          SELECT p.step, p.ids, p.worsts, p.gains, s.id, s.gs, s.view, s.view_rank, greatest(0.0, max(v.red)) AS worst
          FROM fp p JOIN pool s ON NOT list_contains(p.ids, s.id) JOIN pov v ON v.a = s.id AND list_contains(p.ids, v.b)
          WHERE p.step < {k} GROUP BY p.step, p.ids, p.worsts, p.gains, s.id, s.gs, s.view, s.view_rank))
      GROUP BY step, ids, worsts, gains HAVING max(round(gain, 12)) > 0),
    last AS (SELECT * FROM fp ORDER BY step DESC LIMIT 1),
    feed AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS feed_rank, unnest(worsts) AS worst, unnest(gains) AS gain FROM last)
    {select}"""


@query("r13_lineage_dedup", f"WITH {_pool_sql()} SELECT view, id AS finding_id, round(gs, 6) AS global_score FROM pool")
def r13(t: Tables) -> DataFrame:
    return R.lineage_dedup(pool(t)).select("view", "finding_id", F.round("global_score", 6).alias("global_score"))


def _cross_sql() -> str:
    names = {}
    for (view, name), concept in LINEAGE.items():
        names.setdefault(view, []).append(f"WHEN '{name}' THEN '{concept}'")

    def source(view: str) -> str:
        case = "CASE {x} " + " ".join(names[view]) + " ELSE {x} END"
        pick = f"""SELECT view, id, type, g1d || '=' || g1v AS slice, g1d, {case.format(x='gm')} AS cm, {case.format(x='gb')} AS cb,
            {case.format(x='ext')} AS ce FROM cand"""
        return f"SELECT * FROM ({sql(pick, view)})"

    sub = "CASE WHEN a.g1d = '' AND b.g1d = '' THEN 1.0 WHEN a.g1d <> '' AND a.slice = b.slice THEN 1.0 ELSE 0.0 END"
    return f"""WITH a AS ({source('orders')}), b AS ({source('events')})
      SELECT a.id AS id_a, b.id AS id_b, round(0.4 * {sub} + 0.3 * (a.ce = b.ce)::INT + 0.15 * (a.cm = b.cm)::INT + 0.15 * (a.cb = b.cb)::INT, 6) AS ratio
      FROM a JOIN b ON a.type = b.type AND (a.cm = b.cm OR a.cb = b.cb OR (a.g1d <> '' AND a.slice = b.slice))"""


@query("r14_cross_view_overlap", _cross_sql())
def r14(t: Tables) -> DataFrame:
    def side(view: str) -> DataFrame:
        return R.in_source_terms(mining(t, view).findings, LINEAGE, 1)

    return R.cross_view_pairs(side("orders"), side("events")).select("id_a", "id_b", F.round("ratio", 6).alias("ratio"))


@query("r15_seeded_feed_selection", _feed_sql("""SELECT CAST(feed_rank AS INTEGER) AS feed_rank, f.id IN (SELECT id FROM seeds) AS seed, view, f.id AS finding_id,
  round(gs, 6) AS global_score, round(gain, 6) AS gain FROM feed f JOIN pool USING (id)""", 20))
def r15(t: Tables) -> DataFrame:
    feed = R.select_feed(R.lineage_dedup(pool(t)), 1, k=20)
    return feed.filter("feed_rank > 0").select(
        "feed_rank", "seed", "view", "finding_id", F.round("global_score", 6).alias("global_score"), F.round("gain", 6).alias("gain"))


@query("r16_rejection_report", _feed_sql("""SELECT view, view_rank, sentence, round(gs, 6) AS global_score, round(worst, 6) AS worst_overlap, round(gs - least(gs, worst), 6) AS marginal_gain
  FROM (SELECT p.*, greatest(0.0, (SELECT max(red) FROM pov WHERE a = p.id AND b IN (SELECT id FROM feed))) AS worst FROM pool p
    WHERE p.id NOT IN (SELECT id FROM feed)) ORDER BY round(gs, 12) DESC, view, view_rank LIMIT 15""", 20))
def r16(t: Tables) -> DataFrame:
    return R.rejected(R.select_feed(R.lineage_dedup(pool(t)), 1, k=20))


def _hash_sql(table: str, cols: str) -> str:
    pieces = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)" for i in range(4))
    return f"SELECT '{table}' AS name, sha256(concat_ws(':', {pieces})) AS content_hash FROM (SELECT sha256(concat_ws(chr(31), {cols})) AS h FROM {table})"


@query("r17_source_set_identity", f"""WITH f AS ({_hash_sql('nation', 'n_nationkey, n_name, n_regionkey')} UNION ALL {_hash_sql('region', 'r_regionkey, r_name')})
SELECT substr(sha256(string_agg(name || ':' || content_hash || chr(10), '' ORDER BY name)), 1, 16) AS set_id, count(*) AS files FROM f""")
def r17(t: Tables) -> DataFrame:
    hashes = content_hash(t.nation, ["n_nationkey", "n_name", "n_regionkey"]).select(F.lit("nation").alias("name"), "content_hash").unionByName(
        content_hash(t.region, ["r_regionkey", "r_name"]).select(F.lit("region").alias("name"), "content_hash"))
    return R.set_identity(hashes)


@query("r18_finding_diff", sql("""SELECT 'entered' AS change, id AS finding_id FROM cand WHERE rs >= 0.3 AND strategy <> 'subspace'
UNION ALL SELECT 'exited', id FROM cand WHERE rs < 0.3 AND strategy = 'subspace'"""))
def r18(t: Tables) -> DataFrame:
    run = mining(t)
    now, before = run.findings.filter(F.round("score", 12) >= 0.3), run.findings.filter("strategy = 'subspace'")
    return R.finding_diff(now, before, run.own_digests, run.own_digests)


@query("r19_sentences", sql(f"SELECT id AS finding_id, {SENTENCE_SQL} AS sentence FROM cand"))
def r19(t: Tables) -> DataFrame:
    return mining(t).findings.select("finding_id", R.sentence().alias("sentence"))


@query("r19_sentences_with_exceptions", sql(f"""SELECT c.id AS finding_id, {SENTENCE_SQL} || CASE WHEN o.texts IS NULL THEN '' ELSE '. ' ||
  CASE WHEN type = 'EVENNESS' THEN 'Not even in' WHEN o.n = 1 THEN 'Exception' ELSE 'Exceptions' END || ': ' || o.texts ||
  CASE WHEN o.n > 3 THEN ' and ' || (o.n - 3) || ' more' ELSE '' END ||
  CASE WHEN type = 'EVENNESS' THEN '; this is about the spread, not the level' ELSE '' END END AS sentence
FROM cand c LEFT JOIN (SELECT id, max(n) AS n, string_agg(text, '; ' ORDER BY member) AS texts FROM (
  SELECT id, member, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY member) AS rn, member || ' (' || CASE category
    WHEN 'HIGHLIGHT_CHANGE' THEN {body_sql('own_highlight')} WHEN 'TYPE_CHANGE' THEN CASE WHEN type = 'EVENNESS' THEN 'spread in another way' ELSE 'another pattern' END
    ELSE CASE WHEN type = 'EVENNESS' THEN 'uneven' ELSE 'no pattern' END END || ')' AS text
  FROM full_members WHERE category <> 'COMMON') WHERE rn <= 3 GROUP BY id) o ON o.id = c.id""", extra=_MEMBERS))
def r19_exceptions(t: Tables) -> DataFrame:
    run = mining(t)
    return R.with_sentences(run.findings, run.finding_members).select("finding_id", "sentence")


# ---- enrichment ------------------------------------------------------------------------------

_SINGLE = """fp AS (SELECT c.id, c.highlight, p.label, p.value, p.n_rows, c.gm FROM cand c JOIN pts p
  ON p.f1d = c.g1d AND p.f1v = c.g1v AND p.breakdown = c.gb AND p.measure = c.gm),
 rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, label) AS position, count(*) OVER (PARTITION BY id) AS n_values,
  CASE WHEN gm NOT LIKE 'mean%' THEN sum(value) OVER (PARTITION BY id) END AS total,
  list_contains(string_split(highlight, '|'), label) AS highlighted FROM fp)"""


@query("e01_top_values_and_shares", sql("""SELECT id AS finding_id, CAST(position AS INTEGER) AS position, label, n_values, round(total, 2) AS total,
  round(CASE WHEN total > 0 THEN value / total * 100 END, 5) AS share_pct, highlighted FROM rk
WHERE position <= 5 OR position > n_values - 2 OR highlighted""", extra=[_SINGLE]))
def e01(t: Tables) -> DataFrame:
    run = mining(t)
    return E.value_stats(run, run.findings).select(
        "finding_id", "position", "label", "n_values", F.round("total", 2).alias("total"), F.round("share_pct", 5).alias("share_pct"), "highlighted")


@query("e02_rows_behind_averages", sql("""SELECT id AS finding_id, label, CAST(n_rows AS BIGINT) AS n_rows FROM rk
WHERE gm LIKE 'mean%' AND position <= 5""", extra=[_SINGLE]))
def e02(t: Tables) -> DataFrame:
    run = mining(t)
    means = [m.name for m in run.config.measures if m.agg == "avg"]
    return E.value_stats(run, run.findings.filter(F.col("measure").isin(*means))).filter("position <= 5").select(
        "finding_id", "label", "n_rows")


def _beside_sql(measure: str, where: str = "TRUE") -> str:
    return f"""SELECT c.id, c.gm, p.label, p.value, p.n_rows FROM cand c JOIN pts p ON p.f1d = c.g1d AND p.f1v = c.g1v AND p.breakdown = c.gb
      AND p.measure = '{measure}' AND NOT p.temporal WHERE c.gb <> '(varies)' AND {where}"""


@query("e03_volume_share", sql(f"""SELECT id AS finding_id, label, round(value, 2) AS volume,
  round(value / sum(value) OVER (PARTITION BY id) * 100, 5) AS volume_share_pct FROM ({_beside_sql('orders', "c.gm <> 'orders'")})"""))
def e03(t: Tables) -> DataFrame:
    run = mining(t)
    return E.volume_share(run, run.findings, "orders").select(
        "finding_id", "label", F.round("volume", 2).alias("volume"), F.round("volume_share_pct", 5).alias("volume_share_pct"))


@query("e04_intensity_companion", sql(f"""SELECT id AS finding_id, CAST(position AS INTEGER) AS position, label, 'mean_price' AS companion,
  round(value * n_rows, 2) AS total, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, label) AS position FROM ({_beside_sql('mean_price', "c.gm = 'price'")})) WHERE position <= 5"""))
def e04(t: Tables) -> DataFrame:
    run = mining(t)
    return E.intensity_companion(run, run.findings, {"price": "mean_price"}).select(
        "finding_id", "position", "label", "companion", F.round(F.col("mean_value") * F.col("n_rows"), 2).alias("total"), "n_rows")


@query("e05_utilisation_companion", sql(f"""SELECT n.id AS finding_id, n.label, round(n.value / d.value * 100, 4) AS utilisation_pct, 'ratio of sums' AS basis
FROM ({_beside_sql('price')}) n JOIN ({_beside_sql('orders')}) d USING (id, label)"""))
def e05(t: Tables) -> DataFrame:
    run = mining(t)
    return E.utilisation_companion(run, run.findings, "price", "orders", "orders").withColumn(
        "utilisation_pct", F.round("utilisation_pct", 4))


@query("e06_earmark_deviation", """
WITH b AS (SELECT dayname(ts) AS weekday, event_type, sum(value) AS amount FROM events GROUP BY 1, 2),
 w AS (SELECT *, sum(amount) OVER (PARTITION BY weekday) AS total,
   sum(CASE WHEN event_type IN ('purchase', 'signup') THEN amount ELSE 0 END) OVER (PARTITION BY weekday) AS marked FROM b)
SELECT weekday, event_type AS residue_purpose, round(amount, 2) AS residue, round(marked / total * 100, 6) AS earmarked_pct FROM w
WHERE event_type NOT IN ('purchase', 'signup') AND amount > 0""")
def e06(t: Tables) -> DataFrame:
    df = t.events.withColumn("weekday", F.date_format("ts", "EEEE"))
    return E.earmark_deviation(df, "event_type", "value", ["purchase", "signup"], "weekday").select(
        "weekday", "residue_purpose", F.round("residue", 2).alias("residue"), F.round("earmarked_pct", 6).alias("earmarked_pct"))


@query("e07_boundary_caveat", sql("""SELECT id AS finding_id,
  (gm = 'orders' OR gm = '(varies)') AND (gb = 'year' OR strategy = 'breakdown') AND (gm <> '(varies)' OR gb <> 'o_orderstatus')
    AND NOT (strategy = 'measure' AND gb = 'year') AS reporting_caveat FROM cand"""))
def e07(t: Tables) -> DataFrame:
    run = mining(t)
    before, after = ["1995", "1996"], ["1999", "2000"]
    compared = E.finding_points(run, run.findings.filter("breakdown = 'year'")).select("finding_id", "label")
    named = run.named_members(["orders", "year", *before, *after])
    return E.boundary_caveat(run.findings, named, ["orders"], "year", before, after, compared)


_MONTHS = """CASE WHEN regexp_matches(label, '^\\d{4}-\\d{2}$') THEN left(label, 4)::INT * 12 + right(label, 2)::INT - 1
  WHEN regexp_matches(label, '^\\d{4}-Q[1-4]$') THEN left(label, 4)::INT * 12 + (right(label, 1)::INT - 1) * 3
  WHEN regexp_matches(label, '^\\d{4}-\\d{4}$') AND right(label, 4)::INT = left(label, 4)::INT + 1 THEN left(label, 4)::INT * 12 + 3 END"""
_LENGTH = "CASE WHEN length(label) = 7 AND label NOT LIKE '%Q%' THEN 0 WHEN label LIKE '%Q%' THEN 2 ELSE 11 END"


@query("e08_event_citations", sql(f"""
SELECT 'end of the record' AS event, m AS start_month, m AS end_month, '' AS note, what,
  CASE WHEN bool_or(first <= e AND last >= e) THEN 'inside' ELSE 'in the months just after' END AS relation, count(DISTINCT id) AS findings
FROM (SELECT *, {_MONTHS} AS first, {_MONTHS} + {_LENGTH} AS last FROM (
    SELECT id, 'the shift this finding reports' AS what, string_split(unnest(string_split(highlight, '|')), ':')[1] AS label FROM cand
      WHERE type IN ('CHANGE_POINT', 'OUTLIER', 'UNIMODALITY')
    UNION SELECT id, 'an exception in this finding', string_split(unnest(string_split(own_highlight, '|')), ':')[1] FROM full_members
      WHERE type IN ('CHANGE_POINT', 'OUTLIER', 'UNIMODALITY') AND category = 'HIGHLIGHT_CHANGE'
    UNION SELECT id, 'the period this finding is restricted to', g1v FROM cand WHERE g1d <> ''))
  , (SELECT max(month) AS m, left(max(month), 4)::INT * 12 + right(max(month), 2)::INT - 1 AS e FROM v)
WHERE (first <= e AND last >= e) OR (first > e AND first <= e + 3) GROUP BY m, what""", extra=_MEMBERS))
def e08(t: Tables) -> DataFrame:
    run = mining(t)
    periods = E.finding_periods(run.findings, run.own_members, 1)
    bounds = t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("end_month"))
    from ledgerlens.sources.readers import usable_events

    events = usable_events(bounds.select(
        F.lit("end of the record").alias("event"), F.col("end_month").alias("start_month"), "end_month", F.lit("").alias("note")))
    return E.event_citations(periods, events)


@query("e09_period_bounds", """
WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS first, 0 AS len FROM orders
  UNION SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate), year(o_orderdate) * 12 + (quarter(o_orderdate) - 1) * 3, 2 FROM orders
  UNION SELECT year(o_orderdate) || '-' || (year(o_orderdate) + 1), year(o_orderdate) * 12 + 3, 11 FROM orders)
SELECT label, CAST(first AS INTEGER) AS first, CAST(first + len AS INTEGER) AS last FROM p""")
def e09(t: Tables) -> DataFrame:
    from ledgerlens.functions import columns as C

    labels = F.array(C.month_key("o_orderdate"), C.quarter_key("o_orderdate"), C.year_label(F.year("o_orderdate")))
    return with_bounds(t.orders.select(F.explode(labels).alias("label"))).select(
        "label", "b.first", "b.last")


@query("e10_indian_number_text", """
WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 37 AS v FROM orders), s AS (SELECT *, CAST(v AS VARCHAR) AS w FROM n)
SELECT o_orderkey, CASE WHEN length(w) <= 3 THEN w ELSE reverse(regexp_replace(regexp_replace(reverse(left(w, -3)), '(\\d{2})', '\\1,', 'g'), ',$', '')) || ',' || right(w, 3) END AS grouped
FROM s""")
def e10(t: Tables) -> DataFrame:
    from ledgerlens.functions import columns as C

    value = F.floor("o_totalprice").cast("long") * 37
    return t.orders.select("o_orderkey", C.indian_grouping(value.cast("double")).alias("grouped"))


@query("e11_data_quality_list", ms.statement(cand_ctes("events"), """
SELECT 'displaced finding' AS kind, gm AS measure, gb AS breakdown, CAST(n_ok AS BIGINT) AS supported, CAST(size AS BIGINT) AS examined FROM finds WHERE low_support
UNION ALL SELECT 'thin measure', measure, breakdown, count(*) FILTER (ok), count(*) FROM (
  SELECT measure, breakdown, f1d, f1v, count(*) FILTER (value <> 0) >= 4 AND count(*) FILTER (value <> 0) >= count(*) / 3.0 AS ok FROM pts WHERE temporal GROUP BY ALL)
GROUP BY measure, breakdown HAVING count(*) FILTER (NOT ok) * 2 > count(*)"""))
def e11(t: Tables) -> DataFrame:
    return E.data_quality_list(mining(t, "events", 1)).select("kind", "measure", "breakdown", "supported", "examined")
