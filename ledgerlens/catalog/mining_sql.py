"""The mining stages stated as plain SQL, to check the Spark jobs against another engine."""

from __future__ import annotations

from itertools import combinations

from ledgerlens.mining.config import CATEGORICAL_TYPES, TEMPORAL_TYPES, ViewConfig
from ledgerlens.mining.siblings import entropy_bound

F = "f1d, f1v, f2d, f2v"
SCOPE = f"{F}, breakdown, measure"


def filter_sets(cfg: ViewConfig):
    return [c for k in range(cfg.max_subspace_depth + 1) for c in combinations(cfg.dimensions, k)]


def _fcols(filters) -> str:
    out = []
    for i in (1, 2):
        if len(filters) >= i:
            d = filters[i - 1]
            out.append(f"'{d}' AS f{i}d, {d} AS f{i}v")
        else:
            out.append(f"'' AS f{i}d, '' AS f{i}v")
    return ", ".join(out)


def _sums(cfg: ViewConfig) -> str:
    return ", ".join(
        f"sum(CAST({c} AS DOUBLE)) AS s_{c}, count({c}) AS n_{c}" for c in cfg.value_columns
    )


def _present(dims) -> str:
    return " AND ".join(f"{d} IS NOT NULL" for d in dims) or "TRUE"


def settled(v: str) -> str:
    """The value to 12 significant digits."""
    scale = f"pow(10.0, 11 - floor(log10(abs({v}))))"
    return f"CASE WHEN {v} = 0 THEN 0.0 ELSE round_even(({v}) * {scale}, 0) / {scale} END"


def ctes(view_sql: str, cfg: ViewConfig) -> list[str]:
    """Common table expressions: v, slices, shares, pts, hits and findings."""
    cells, slices = [], []
    for filters in filter_sets(cfg):
        group = ", ".join(filters)
        slices.append(
            f"SELECT {_fcols(filters)}, {_sums(cfg)} FROM v WHERE {_present(filters)}"
            + (f" GROUP BY {group}" if group else "")
        )
        for b in cfg.all_dims:
            if b in filters:
                continue
            cells.append(
                f"SELECT {_fcols(filters)}, '{b}' AS breakdown, {cfg.is_temporal(b)} AS temporal, {b} AS label, "
                f"{_sums(cfg)} FROM v WHERE {_present((*filters, b))} GROUP BY {', '.join((*filters, b))}"
            )
    values = []
    for m in cfg.measures:
        value = f"s_{m.source} / n_{m.source}" if m.agg == "avg" else f"coalesce(s_{m.source}, 0.0)"
        keep = f"n_{m.source} > 0" if m.agg == "avg" else "TRUE"
        skip = [b for (name, b) in cfg.excluded_pairs if name == m.name]
        if skip:
            keep += " AND breakdown NOT IN (" + ", ".join(f"'{b}'" for b in skip) + ")"
        values.append(
            f"SELECT {F}, breakdown, temporal, label, '{m.name}' AS measure, {settled(value)} AS value, n_{m.source} AS n_rows "
            f"FROM cells WHERE {keep}"
        )
    share = ", ".join(
        f"CASE WHEN t.s_{m} > 0 THEN round(coalesce(s.s_{m}, 0.0) / t.s_{m}, 12) ELSE 0.0 END AS i_{j}"
        for j, m in enumerate(cfg.impact_measures)
    )
    best = ", ".join(f"i_{j}" for j in range(len(cfg.impact_measures)))
    sizes = " UNION ALL ".join(
        f"SELECT '{d}' AS dim, count(DISTINCT {d}) AS n FROM v" for d in cfg.all_dims
    )
    return [
        f"v AS MATERIALIZED ({view_sql})",
        f"sizes AS ({sizes})",
        "slices AS MATERIALIZED (" + " UNION ALL ".join(slices) + ")",
        f"shares AS (SELECT *, greatest(0.0, {best}) AS max_share FROM (SELECT s.f1d, s.f1v, s.f2d, s.f2v, {share} "
        "FROM slices s, (SELECT * FROM slices WHERE f1d = '') t))",
        "cells AS (" + " UNION ALL ".join(cells) + ")",
        "pts AS (" + " UNION ALL ".join(values) + ")",
    ]


def hit_ctes(cfg: ViewConfig) -> list[str]:
    x = cfg.extremum_ratio
    cat = f"""cat AS (
      SELECT {SCOPE}, count(*) AS n, sum(value) AS total, avg(value) AS mean, stddev_samp(value) AS sd,
        count(*) FILTER (value <> 0) AS nz,
        max(value) FILTER (hi = 1) AS v1, max(value) FILTER (hi = 2) AS v2, max(value) FILTER (hi = 3) AS v3,
        max(value) FILTER (lo = 1) AS b1, max(value) FILTER (lo = 2) AS b2, max(value) FILTER (lo = 3) AS b3,
        max(label) FILTER (hi = 1) AS top1, max(label) FILTER (hi = 2) AS top2,
        max(label) FILTER (lo = 1) AS low1, max(label) FILTER (lo = 2) AS low2,
        avg(value) FILTER (hi > 1) AS mt1, stddev_samp(value) FILTER (hi > 1) AS st1,
        avg(value) FILTER (hi > 2) AS mt2, stddev_samp(value) FILTER (hi > 2) AS st2,
        avg(value) FILTER (lo > 1) AS ml1, stddev_samp(value) FILTER (lo > 1) AS sl1,
        avg(value) FILTER (lo > 2) AS ml2, stddev_samp(value) FILTER (lo > 2) AS sl2
      FROM (SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY value DESC, label) AS hi,
                   row_number() OVER (PARTITION BY {SCOPE} ORDER BY value, label) AS lo
            FROM pts WHERE NOT temporal) GROUP BY {SCOPE})"""
    tem_rows = f"""tr AS (
      SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd,
        max(value) OVER w AS vmax, min(value) OVER w AS vmin,
        row_number() OVER o - 1 AS i, value - lag(value) OVER o AS step,
        rank() OVER (PARTITION BY {SCOPE} ORDER BY value)
          + (count(*) OVER (PARTITION BY {SCOPE}, value) - 1) / 2.0 AS rk,
        avg(value) OVER b AS m1, var_samp(value) OVER b AS s1,
        avg(value) OVER a AS m2, var_samp(value) OVER a AS s2,
        lag(value, 3) OVER o AS l3, lag(value, 4) OVER o AS l4, lag(value, 6) OVER o AS l6, lag(value, 12) OVER o AS l12
      FROM pts WHERE temporal
      WINDOW w AS (PARTITION BY {SCOPE}), o AS (PARTITION BY {SCOPE} ORDER BY label),
        b AS (PARTITION BY {SCOPE} ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY {SCOPE} ORDER BY label ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    tt AS (
      SELECT *, min(i) FILTER (value = vmax) OVER (PARTITION BY {SCOPE}) AS imax,
        min(i) FILTER (value = vmin) OVER (PARTITION BY {SCOPE}) AS imin,
        CASE WHEN i >= 3 AND i <= n - 3 AND s1 / i + s2 / (n - i) > 0
             THEN abs(m1 - m2) / sqrt(s1 / i + s2 / (n - i)) END AS t,
        CASE WHEN i >= 3 AND i <= n - 3 AND s1 / i + s2 / (n - i) > 0
             THEN pow(s1 / i + s2 / (n - i), 2)
                  / (pow(s1 / i, 2) / (i - 1) + pow(s2 / (n - i), 2) / (n - i - 1)) END AS df,
        i >= 3 AND i <= n - 3 AND s1 = 0 AND s2 = 0 AND m1 <> m2 AS flat
      FROM tr),
    tp AS (
      SELECT *, CASE WHEN flat THEN 0.0 WHEN t > 2.5758 THEN {tail('t', 'df')} END AS p FROM tt)"""

    def acf(k):
        return (
            f"(covar_pop(value, l{k}) / nullif(stddev_pop(value) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k}), 0)) AS a{k}"
        )

    tem = f"""tem AS (
      SELECT {SCOPE}, count(*) AS n, count(*) FILTER (value <> 0) AS nz, any_value(vmax) AS vmax, any_value(vmin) AS vmin,
        any_value(imax) AS imax, any_value(imin) AS imin,
        covar_pop(i, rk) / nullif(stddev_pop(i) * stddev_pop(rk), 0) AS rho,
        string_agg(label || ':' || CASE WHEN value > mean THEN 'ABOVE' ELSE 'BELOW' END, '|' ORDER BY label)
          FILTER (sd > 0 AND abs(value - mean) / sd > 3) AS far,
        count(*) FILTER (sd > 0 AND abs(value - mean) / sd > 3) AS n_far,
        {acf(3)}, {acf(4)}, {acf(6)}, {acf(12)},
        arg_min(label, (CASE WHEN p <= 0 THEN -1e9 ELSE round(log10(p), 9) END, i)) FILTER (p < 0.01) AS cp,
        count(*) FILTER (step > 0 AND i <= imax) AS um, count(*) FILTER (step < 0 AND i > imax) AS dm,
        count(*) FILTER (step < 0 AND i <= imin) AS dn, count(*) FILTER (step > 0 AND i > imin) AS un,
        max(label) FILTER (i = imax) AS lmax, max(label) FILTER (i = imin) AS lmin
      FROM tp GROUP BY {SCOPE}),
    te AS (
      SELECT *,
        CASE WHEN round(abs(rho), 12) >= 0.5 AND n >= 4 THEN
          CASE WHEN 1 - rho * rho <= 1e-15 THEN 0.0
               ELSE {tail('abs(rho) * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} END END AS rp,
        CASE WHEN a3 > 0.4 AND 6 <= n THEN a3 END AS q3, CASE WHEN a4 > 0.4 AND 8 <= n THEN a4 END AS q4,
        CASE WHEN a6 > 0.4 AND 12 <= n THEN a6 END AS q6, CASE WHEN a12 > 0.4 AND 24 <= n THEN a12 END AS q12,
        CASE WHEN imax BETWEEN 1 AND n - 2 AND um / imax >= 0.7 AND dm / (n - 1 - imax) >= 0.7
             THEN (um / imax + dm / (n - 1 - imax)) / 2 END AS peak,
        CASE WHEN imin BETWEEN 1 AND n - 2 AND dn / imin >= 0.7 AND un / (n - 1 - imin) >= 0.7
             THEN (dn / imin + un / (n - 1 - imin)) / 2 END AS valley
      FROM tem)"""
    tests = {
        "OUTSTANDING_1": ("cat", f"""CASE WHEN n >= 3 AND total <> 0
            AND CASE WHEN v2 = b1 THEN v1 > v2 ELSE (v1 - mt1) / st1 >= 2.0 END
            AND NOT (v2 > 0 AND v1 / v2 < 1.0 / {x}) THEN top1 END"""),
        "OUTSTANDING_LAST": ("cat", f"""CASE WHEN n >= 3 AND total <> 0
            AND CASE WHEN b2 = v1 THEN b1 < b2 ELSE (b1 - ml1) / sl1 <= -2.0 END
            AND NOT (b2 > 0 AND b1 / b2 > {x}) THEN low1 END"""),
        "TOP_TWO": ("cat", """CASE WHEN n >= 4 AND total <> 0
            AND CASE WHEN v3 = b1 THEN v2 > v3 ELSE (v1 - mt2) / st2 >= 1.5 AND (v2 - mt2) / st2 >= 1.5 END
            AND NOT (v3 > 0 AND v2 / v3 < 1.3) THEN least(top1, top2) || '|' || greatest(top1, top2) END"""),
        "LAST_TWO": ("cat", """CASE WHEN n >= 4 AND total <> 0
            AND CASE WHEN b3 = v1 THEN b2 < b3 ELSE (b1 - ml2) / sl2 <= -1.5 AND (b2 - ml2) / sl2 <= -1.5 END
            AND NOT (b3 > 0 AND b2 / b3 > 0.77) THEN least(low1, low2) || '|' || greatest(low1, low2) END"""),
        "EVENNESS": ("cat", """CASE WHEN n >= 3 AND mean <> 0 AND sd / mean < 0.15
            AND v1 / total <= 2.0 / n THEN 'EVEN' END"""),
        "ATTRIBUTION": ("cat", """CASE WHEN n >= 3 AND total <> 0 AND v1 / total > 0.5
            AND NOT (v2 > 0 AND v1 / v2 < 2.0) THEN top1 END"""),
        "TREND": ("te", "CASE WHEN n >= 4 AND rp < 0.05 THEN CASE WHEN rho > 0 THEN 'INCREASING' ELSE 'DECREASING' END END"),
        "OUTLIER": ("te", "CASE WHEN n >= 5 AND vmax > vmin AND n_far > 0 AND n_far <= 0.2 * n THEN far END"),
        "SEASONALITY": ("te", """CASE WHEN n >= 12 AND vmax > vmin THEN
            CASE greatest(q3, q4, q6, q12) WHEN q3 THEN 'PERIOD_3' WHEN q4 THEN 'PERIOD_4'
                 WHEN q6 THEN 'PERIOD_6' WHEN q12 THEN 'PERIOD_12' END END"""),
        "CHANGE_POINT": ("te", "CASE WHEN n >= 6 THEN cp END"),
        "UNIMODALITY": ("te", """CASE WHEN n >= 5 THEN
            CASE WHEN peak IS NOT NULL AND (valley IS NULL OR peak >= valley) THEN 'PEAK|' || lmax
                 WHEN valley IS NOT NULL THEN 'VALLEY|' || lmin END END"""),
    }
    assert tuple(tests) == CATEGORICAL_TYPES + TEMPORAL_TYPES
    union = " UNION ALL ".join(
        f"SELECT {SCOPE}, '{t}' AS type, {expr} AS highlight, n, nz FROM {src}" for t, (src, expr) in tests.items()
    )
    return [cat, tem_rows, tem, f"hits AS (SELECT * FROM ({union}) WHERE highlight IS NOT NULL)"]


def tail(t: str, df: str, steps: int = 2000) -> str:
    """P(|T| >= t) by Simpson's rule: the t density is cos^(df-1) in the angle atan(t / sqrt(df))."""
    def area(start: str) -> str:
        h = f"((pi() / 2 - {start}) / {steps})"
        weight = f"CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
        return (
            f"({h} * list_sum(list_transform(range({steps + 1}), lambda j: {weight} "
            f"* pow(greatest(cos({start} + j * {h}), 0), ({df}) - 1))))"
        )
    return f"({area(f'atan(({t}) / sqrt({df}))')} / {area('0.0')})"


def finding_ctes(cfg: ViewConfig) -> list[str]:
    tau = cfg.tau
    n_temporal = {
        m.name: sum((m.name, t) not in cfg.excluded_pairs for t in cfg.temporal_dimensions) for m in cfg.measures
    }
    drop1 = f"SELECT *, f2d AS g1d, f2v AS g1v, '' AS g2d, '' AS g2v, f1d AS ext, f1v AS member FROM sh WHERE f1d <> ''"
    drop2 = f"SELECT *, f1d AS g1d, f1v AS g1v, '' AS g2d, '' AS g2v, f2d AS ext, f2v AS member FROM sh WHERE f2d <> ''"
    per_b = " UNION ALL ".join(f"SELECT '{b}' AS breakdown, {len(cfg.measures_for(b))} AS size" for b in cfg.all_dims)
    per_m = " UNION ALL ".join(f"SELECT '{m}' AS measure, {n} AS size" for m, n in n_temporal.items())
    temporal = ", ".join(f"'{t}'" for t in cfg.temporal_dimensions) or "''"
    impacts = range(len(cfg.impact_measures))
    least = ", ".join(f"least(1.0, sum(i_{j})) AS i_{j}" for j in impacts)
    own = ", ".join(f"i_{j}" for j in impacts)
    ent = "CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0.0 END"
    key = "strategy, g1d, g1v, g2d, g2v, ext, gb, gm"
    best = "greatest(0.0, " + ", ".join(f"round(i_{j}, 12)" for j in impacts) + ")"
    name = "CASE " + " ".join(
        f"WHEN round(i_{j}, 12) = {best} AND {best} > 0 THEN '{m}'" for j, m in enumerate(cfg.impact_measures)
    ) + f" ELSE '{cfg.impact_measures[0]}' END"
    alpha = "round(cnt / size, 4)"
    return [
        f"""sh AS (SELECT h.*, s.max_share >= {cfg.min_impact} AS seed,
            (nz >= {cfg.min_temporal_nonzero} AND nz >= {cfg.min_temporal_nonzero_frac} * n) AS ok
            FROM hits h JOIN shares s USING ({F}))""",
        f"""mem AS (
          SELECT 'subspace' AS strategy, g1d, g1v, g2d, g2v, ext, breakdown AS gb, measure AS gm, z.n AS size,
                 member, type, highlight, seed, ok
          FROM ({drop1} UNION ALL {drop2}) JOIN sizes z ON z.dim = ext
          UNION ALL
          SELECT 'measure', f1d, f1v, f2d, f2v, 'measure', breakdown, '(varies)', b.size, measure, type, highlight, seed, ok
          FROM sh JOIN ({per_b}) b USING (breakdown)
          UNION ALL
          SELECT 'breakdown', f1d, f1v, f2d, f2v, 'temporal_grain', '(varies)', measure, b.size, breakdown, type, highlight,
                 seed, ok
          FROM sh JOIN ({per_m}) b USING (measure) WHERE breakdown IN ({temporal}))""",
        f"anyhit AS (SELECT {key}, count(DISTINCT member) AS n_any FROM mem GROUP BY {key})",
        f"""byhl AS (SELECT {key}, size, type, highlight, count(*) AS cnt, bool_or(seed) AS seed,
            count(*) FILTER (ok) AS n_ok FROM mem WHERE size >= {cfg.min_hdp_size} GROUP BY ALL)""",
        f"""bytype AS (SELECT {key}, size, type, sum(cnt) AS n_type, bool_or(seed) AS seed,
            sum(cnt) FILTER (cnt / size > {tau}) AS n_common,
            sum({ent.format(p=alpha)}) FILTER (cnt / size > {tau}) AS common_entropy,
            arg_max(highlight, cnt) AS highlight, max(cnt) AS common_count, arg_max(n_ok, cnt) AS n_ok
            FROM byhl GROUP BY ALL HAVING n_common > 0)""",
        f"""seeded AS (SELECT b.*, a.n_any, b.n_type - b.n_common AS n_hc, a.n_any - b.n_type AS n_tc, b.size - a.n_any AS n_np
            FROM bytype b JOIN anyhit a USING ({key})
            WHERE b.seed OR (strategy = 'subspace' AND EXISTS (SELECT 1 FROM sh WHERE sh.seed AND sh.f1d = b.g1d
              AND sh.f1v = b.g1v AND sh.f2d = b.g2d AND sh.f2v = b.g2v AND sh.breakdown = b.gb AND sh.measure = b.gm
              AND sh.type = b.type)))""",
        f"""imp AS (
          SELECT 'subspace' AS strategy, g1d, g1v, g2d, g2v, ext, {least} FROM (
            SELECT f2d AS g1d, f2v AS g1v, '' AS g2d, '' AS g2v, f1d AS ext, {own} FROM shares WHERE f1d <> ''
            UNION ALL SELECT f1d, f1v, '', '', f2d, {own} FROM shares WHERE f2d <> '') GROUP BY ALL
          UNION ALL SELECT 'measure', {F}, 'measure', {own} FROM shares
          UNION ALL SELECT 'breakdown', {F}, 'temporal_grain', {own} FROM shares)""",
        f"""scored AS (
          SELECT *, conciseness * impact AS score FROM (
            SELECT {key}, type, size, highlight, common_count, n_ok, n_common, common_entropy, n_hc, n_tc, n_np,
              greatest(0.0, 1 - (common_entropy + {ent.format(p='n_hc / size')} + {ent.format(p='n_tc / size')}
                + {ent.format(p='n_np / size')} + CASE WHEN n_hc + n_tc + n_np = 0 THEN 0.5 ELSE 0.0 END)
                / {entropy_bound(tau)!r}) AS conciseness,
              {best} AS impact, {name} AS impact_measure
            FROM seeded JOIN imp USING (strategy, g1d, g1v, g2d, g2v, ext)) WHERE conciseness * impact > 0)""",
        f"""finds AS (SELECT *, (type IN ({', '.join(f"'{t}'" for t in TEMPORAL_TYPES)}) AND n_ok / size <= {tau}) AS low_support
            FROM scored)""",
    ]


def member_ctes(cfg: ViewConfig) -> list[str]:
    """full: every sibling of every finding in cand with its category and own highlight."""
    key = "strategy, g1d, g1v, g2d, g2v, ext, gb, gm"
    none = "CAST(NULL AS VARCHAR)"
    dom = [f"SELECT DISTINCT 'subspace' AS strategy, '{d}' AS dim, {none} AS b, {none} AS m, CAST({d} AS VARCHAR) AS member FROM v WHERE {d} IS NOT NULL"
           for d in cfg.dimensions]
    dom += [f"SELECT 'measure', 'measure', '{b}', {none}, '{cfg.measures[i].name}'" for b in cfg.all_dims for i in cfg.measures_for(b)]
    dom += [f"SELECT 'breakdown', 'temporal_grain', {none}, '{m.name}', '{t}'" for m in cfg.measures for t in cfg.temporal_dimensions
            if (m.name, t) not in cfg.excluded_pairs]
    same = " AND ".join(f"x.{k} = c.{k}" for k in key.split(", "))
    return [
        "dom AS (" + " UNION ALL ".join(dom) + ")",
        f"com AS (SELECT {key}, type, highlight FROM byhl WHERE cnt / size > {cfg.tau})",
        f"""own AS (SELECT c.id, x.member, x.highlight, EXISTS (SELECT 1 FROM com k WHERE {same.replace('x.', 'k.')} AND k.type = c.type AND k.highlight = x.highlight) AS common
            FROM cand c JOIN mem x ON {same} AND x.type = c.type)""",
        f"other AS (SELECT DISTINCT c.id, x.member FROM cand c JOIN mem x ON {same})",
        """full_members AS (SELECT c.*, d.member, o.highlight AS own_highlight, CASE WHEN o.common THEN 'COMMON' WHEN o.id IS NOT NULL THEN 'HIGHLIGHT_CHANGE'
              WHEN t.id IS NOT NULL THEN 'TYPE_CHANGE' ELSE 'NO_PATTERN' END AS category
            FROM cand c JOIN dom d ON d.strategy = c.strategy AND d.dim = c.ext AND (d.b IS NULL OR d.b = c.gb) AND (d.m IS NULL OR d.m = c.gm)
            LEFT JOIN own o ON o.id = c.id AND o.member = d.member LEFT JOIN other t ON t.id = c.id AND t.member = d.member)""",
    ]


def statement(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
