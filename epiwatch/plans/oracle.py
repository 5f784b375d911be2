"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement starts from the raw test tables (lineitem, orders, ... views)
and recomputes landing, ETL and the analytic step in plain SQL, so a Spark
result is compared against a from-scratch derivation.  Shared steps are CTE
blocks; parameters come from the same ``Config`` the Spark queries use.

Conventions mirrored from the Spark side (so values hash equal):
* reported doubles end in ``round_even(x * 1e6, 0) / 1e6 + 0.0``;
* means of 2-decimal rates sum exactly as DECIMAL(18,2), then divide once;
* every divisor is wrapped in ``nullif(.., 0)``;
* ties in rankings and arg-max are broken by the key, ascending.
"""

from __future__ import annotations

import math

from ..config import (ACTION_ALARM, ACTION_EPIDEMIC, ACTION_SAFETY, ACTION_SUCCESS, GLOBAL_SCOPE,
                      HOSPITAL_KEYWORDS, INSIGHT_ALARM, INSIGHT_EPIDEMIC, INSIGHT_SAFETY,
                      INSIGHT_SUCCESS, LEVEL_HOSPITAL, LEVEL_OTHER, LEVEL_PRIMARY, MAPE_BANDS,
                      MAPE_POOR, PRIMARY_KEYWORDS, PSCORE_DEFICIT, PSCORE_EXCESS, RAW_SERIES,
                      SEVERITY_BANDS, SEVERITY_NORMAL, SMOOTH_SERIES, TREND_DOWN, TREND_FLAT,
                      TREND_UP, WEEKS_PER_YEAR, ZONE_ALARM, ZONE_EPIDEMIC, ZONE_SAFETY,
                      ZONE_SUCCESS, Config, driver_defaults)

CFG: Config = driver_defaults()
#: A year of 53 weeks, for the variants over whole years; target years of the variant with several.
WHOLE_YEAR = 1998
SEVERAL_TARGETS = (2001, 2000, 1998)

# Python's str.isspace() set, spelled out for RE2.
_WS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, '{_WS}*')"


def stable(x: str) -> str:
    return f"(round_even(({x}) * CAST(1000000.0 AS DOUBLE), 0) / CAST(1000000.0 AS DOUBLE) + CAST(0.0 AS DOUBLE))"


def exact_mean(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / nullif(COUNT({x}), 0))"


def _spelling(x: str) -> str:
    for pat, rep in CFG.spelling:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return x


def _recode(x: str) -> str:
    if not CFG.cause_labels:
        return x
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CFG.cause_labels)
    return f"(CASE {x} {whens} ELSE {x} END)"


def _care_level(x: str) -> str:
    up = f"upper({x})"
    hosp = " OR ".join(f"coalesce(contains({up}, {q(k)}), false)" for k in HOSPITAL_KEYWORDS)
    prim = " OR ".join(f"coalesce(contains({up}, {q(k)}), false)" for k in PRIMARY_KEYWORDS)
    return (f"(CASE WHEN {hosp} THEN {q(LEVEL_HOSPITAL)} WHEN {prim} THEN {q(LEVEL_PRIMARY)} "
            f"ELSE {q(LEVEL_OTHER)} END)")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
RAW_COLS = ["facility", "area", "region", "cause", "facility_type", "service", "year", "week",
            "n_total"] + [f"n_{s.lower()}" for s in SEGMENTS]
TEXT_COLS = ["facility", "area", "region", "cause", "facility_type", "service"]

RAW = """raw AS (
  SELECT s_name AS facility,
         n_name || CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE '' END AS area,
         r_name AS region,
         CASE WHEN s_suppkey % 2 = 1 THEN '  ' || p_type ELSE p_type END AS cause,
         CASE s_suppkey % 5 WHEN 0 THEN 'Hospital Base' WHEN 1 THEN 'SAPU' WHEN 2 THEN 'SAR'
              WHEN 3 THEN 'Consultorio'
              ELSE CASE WHEN s_suppkey % 10 = 9 THEN '  ' ELSE 'Instituto' END END AS facility_type,
         CASE WHEN s_suppkey % 10 = 3 THEN 'OTHER' ELSE 'MAIN' END AS service,
         CAST(year(o_orderdate) AS INT) AS year,
         CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS INT) AS week,
         CAST(count(*) AS BIGINT) AS n_total,
""" + ",\n".join(
    f"         CAST(sum(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}"
    for s in SEGMENTS) + """
  FROM lineitem
  JOIN orders   ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation   ON s_nationkey = n_nationkey
  JOIN region   ON n_regionkey = r_regionkey
  JOIN part     ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
)"""

POP = """pop AS (
  SELECT area, CAST(unnest(yrs) AS INT) AS year, age_group, population FROM (
    SELECT n_name AS area, c_mktsegment AS age_group, CAST(count(*) AS BIGINT) AS population,
           (SELECT list(DISTINCT CAST(year(o_orderdate) AS INT)) FROM orders) AS yrs
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE NOT (n_nationkey = 24 AND c_mktsegment = 'MACHINERY')
    GROUP BY 1, 2)
)"""


def _excluded() -> str:
    labels = ", ".join(q(x.strip()) for x in CFG.excluded_causes)
    return f"{utrim('cause')} NOT IN ({labels})"


FEED = f"feed AS (SELECT * FROM raw WHERE service = {q(CFG.service)})"
EXCL = f"excl AS (SELECT * FROM feed WHERE {_excluded()})"
FIXED = ("fixed AS (SELECT * REPLACE ("
         + ", ".join(f"{_spelling(c)} AS {c}" for c in ("area", "region", "facility"))
         + ") FROM excl)")
BLANKED = ("blanked AS (SELECT * REPLACE ("
           + ", ".join(f"CASE WHEN {blank(c)} THEN NULL ELSE {c} END AS {c}" for c in TEXT_COLS)
           + ") FROM fixed)")
CLEAN = ("clean AS (SELECT * FROM blanked WHERE "
         + " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLS) + ")")
LONG = "long AS (" + "\n  UNION ALL ".join(
    f"SELECT facility, {utrim('area')} AS area, region, cause, facility_type, service, "
    f"CAST(year AS INT) AS year, week, n_total, CAST(coalesce({col}, 0) AS BIGINT) AS visits, "
    f"{utrim(q(lab))} AS age_group FROM clean"
    for col, lab in CFG.age_columns) + ")"
POPN = (f"popn AS (SELECT {utrim('area')} AS area, CAST(year AS INT) AS year, "
        f"{utrim('age_group')} AS age_group, CAST(population AS DOUBLE) AS population FROM pop)")
JOINED = ("joined AS (SELECT l.*, p.population FROM long l LEFT JOIN popn p "
          "ON l.area = p.area AND l.year = p.year AND l.age_group = p.age_group)")
MASTER = ("master AS (SELECT facility, area, region, cause, facility_type, service, year, week, n_total, "
          "CAST(visits AS DOUBLE) AS visits, age_group, coalesce(population, 0.0) AS population, "
          "CASE WHEN coalesce(population, 0.0) > 0 THEN round_even(CAST(visits AS DOUBLE) / population "
          "* CAST(10000.0 AS DOUBLE) * CAST(100.0 AS DOUBLE), 0) / CAST(100.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS rate "
          "FROM joined)")
M = (f"m AS (SELECT * REPLACE ({_recode(utrim('cause'))} AS cause), "
     f"{_care_level('facility_type')} AS care_level FROM master)")

ETL_BLOCKS = [RAW, POP, FEED, EXCL, FIXED, BLANKED, CLEAN, LONG, POPN, JOINED, MASTER, M]


def _eval_year() -> str:
    return str(CFG.eval_year) if CFG.eval_year is not None else "(SELECT max(year) FROM m)"


def _slice(extra: str = "") -> str:
    lo, hi = CFG.week_window
    return (f"s AS (SELECT * FROM m WHERE year = {_eval_year()} AND week BETWEEN {lo} AND {hi}"
            f"{(' AND ' + extra) if extra else ''})")


def _rate(v: str, p: str) -> str:
    return f"({v} / nullif({p}, 0) * CAST(10000.0 AS DOUBLE))"


SERIES = f"""totals AS (
  SELECT area, year, week, sum(visits) AS visits, sum(population) AS population FROM m GROUP BY area, year, week
), series AS (
  SELECT area AS scope, year, week, visits, population, {_rate('visits', 'population')} AS rate FROM totals
  UNION ALL
  SELECT {q(GLOBAL_SCOPE)} AS scope, year, week, visits, population, {_rate('visits', 'population')} AS rate
  FROM (SELECT year, week, sum(visits) AS visits, sum(population) AS population FROM totals GROUP BY year, week)
)"""

TARGETS = "targets(target) AS (VALUES " + ", ".join(f"({q(t)})" for t in CFG.target_causes) + ")"
SERIES_T = f"""{TARGETS}, tm AS (
  SELECT m.*, targets.target FROM m JOIN targets ON contains(upper(m.cause), upper(targets.target))
), totals AS (
  SELECT area, target, year, week, sum(visits) AS visits, sum(population) AS population
  FROM tm GROUP BY area, target, year, week
), series AS (
  SELECT area AS scope, target, year, week, visits, population, {_rate('visits', 'population')} AS rate FROM totals
  UNION ALL
  SELECT {q(GLOBAL_SCOPE)} AS scope, target, year, week, visits, population, {_rate('visits', 'population')} AS rate
  FROM (SELECT target, year, week, sum(visits) AS visits, sum(population) AS population
        FROM totals GROUP BY target, year, week)
)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(ETL_BLOCKS + list(blocks)) + "\n"


def _baseline() -> str:
    lo, hi = CFG.baseline_years
    return f"year BETWEEN {lo} AND {hi}"


# -- channel ------------------------------------------------------------------

def _interp(col: str) -> str:
    before = "OVER (PARTITION BY scope ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "OVER (PARTITION BY scope ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    pv = f"last_value({col} IGNORE NULLS) {before}"
    pp = f"last_value(CASE WHEN {col} IS NOT NULL THEN week END IGNORE NULLS) {before}"
    nv = f"first_value({col} IGNORE NULLS) {after}"
    np_ = f"first_value(CASE WHEN {col} IS NOT NULL THEN week END IGNORE NULLS) {after}"
    blend = f"(({nv}) - ({pv})) / CAST(({np_}) - ({pp}) AS DOUBLE) * CAST(week - ({pp}) AS DOUBLE) + ({pv})"
    return (f"CASE WHEN {col} IS NOT NULL THEN {col} WHEN ({pv}) IS NULL THEN NULL "
            f"WHEN ({nv}) IS NULL THEN {pv} ELSE {blend} END")


CHANNEL = f"""base AS (SELECT * FROM series WHERE {_baseline()}),
stats AS (
  SELECT scope, week, quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.5) AS q2,
         quantile_cont(rate, 0.75) AS q3
  FROM base GROUP BY scope, week
), spine AS (
  SELECT scope, CAST(unnest(range(1, 54)) AS INT) AS week FROM (SELECT DISTINCT scope FROM base)
), raw_chan AS (
  SELECT spine.scope, spine.week, stats.q1, stats.q2, stats.q3
  FROM spine LEFT JOIN stats ON spine.scope = stats.scope AND spine.week = stats.week
), filled AS (
  SELECT scope, week, {_interp('q1')} AS q1, {_interp('q2')} AS q2, {_interp('q3')} AS q3 FROM raw_chan
), cur AS (
  SELECT scope, week, rate AS current_rate FROM series WHERE year = {_eval_year()}
), chan AS (
  SELECT f.scope, f.week, f.q1, f.q2, f.q3, c.current_rate,
         coalesce(max(CASE WHEN c.current_rate IS NOT NULL THEN f.week END) OVER (PARTITION BY f.scope), 1) AS last_week
  FROM filled f LEFT JOIN cur c ON f.scope = c.scope AND f.week = c.week
)"""


def _fmt1(x: str) -> str:
    return f"coalesce(format('{{:.1f}}', {x}), 'nan')"


def _zone_case(kind: str) -> str:
    texts = {
        "zone": (q(ZONE_SUCCESS), q(ZONE_SAFETY), q(ZONE_ALARM), q(ZONE_EPIDEMIC)),
        "insight": (q(INSIGHT_SUCCESS), q(INSIGHT_SAFETY),
                    f"{q(INSIGHT_ALARM.split('{}')[0])} || {_fmt1('q2')} || {q(INSIGHT_ALARM.split('{}')[1])}",
                    f"{q(INSIGHT_EPIDEMIC.split('{}')[0])} || {_fmt1('q3')} || {q(INSIGHT_EPIDEMIC.split('{}')[1])}"),
        "action": (q(ACTION_SUCCESS), q(ACTION_SAFETY), q(ACTION_ALARM), q(ACTION_EPIDEMIC)),
    }[kind]
    return (f"CASE WHEN current_rate < q1 THEN {texts[0]} WHEN current_rate < q2 THEN {texts[1]} "
            f"WHEN current_rate < q3 THEN {texts[2]} ELSE {texts[3]} END")


ZONES = f"""zoned AS (
  SELECT scope, week, current_rate, q1, q2, q3, last_week,
         {_zone_case('zone')} AS zone, {_zone_case('insight')} AS insight, {_zone_case('action')} AS action,
         lag(current_rate) OVER (PARTITION BY scope ORDER BY week) AS prev
  FROM chan
), zones AS (
  SELECT scope, week, {stable('current_rate')} AS current_rate, {stable('q1')} AS q1, {stable('q2')} AS q2,
         {stable('q3')} AS q3, zone, insight, action,
         CASE WHEN prev IS NULL THEN {q(TREND_FLAT)} WHEN current_rate > prev THEN {q(TREND_UP)}
              WHEN current_rate < prev THEN {q(TREND_DOWN)} ELSE {q(TREND_FLAT)} END AS trend, last_week
  FROM zoned WHERE current_rate IS NOT NULL
)"""

# -- P-Score ------------------------------------------------------------------

PSCORE = f"""pbase AS (
  SELECT scope, week, median(rate) AS q2_hist FROM series WHERE {_baseline()} GROUP BY scope, week
), pcur AS (
  SELECT scope, week, rate AS current_rate FROM series WHERE year = {_eval_year()}
), ps AS (
  SELECT b.scope, b.week, b.q2_hist, c.current_rate,
         (c.current_rate - b.q2_hist) / nullif(b.q2_hist, 0) * CAST(100.0 AS DOUBLE) AS p_score
  FROM pbase b LEFT JOIN pcur c ON b.scope = c.scope AND b.week = c.week
  WHERE b.scope IN (SELECT scope FROM pcur)
), psk AS (
  SELECT *, CASE WHEN current_rate > q2_hist THEN {q(PSCORE_EXCESS)} ELSE {q(PSCORE_DEFICIT)} END AS kind FROM ps
)"""


def _severity(x: str) -> str:
    whens = " ".join(f"WHEN {x} > {dbl(t)} THEN {q(lab)}" for t, lab in SEVERITY_BANDS)
    return f"CASE {whens} ELSE {q(SEVERITY_NORMAL)} END"


# -- forecast -----------------------------------------------------------------

FEATURES = ("intercept", "t", "sin1", "cos1", "sin2", "cos2")


def _harmonic(year: str, week: str) -> dict[str, str]:
    t = f"(CAST({year} - {CFG.base_year} AS DOUBLE) * {dbl(CFG.period)} + CAST({week} AS DOUBLE))"
    a1 = f"({dbl(2 * math.pi)} * {t} / {dbl(CFG.period)})"
    a2 = f"({dbl(4 * math.pi)} * {t} / {dbl(CFG.period)})"
    return {"intercept": dbl(1.0), "t": t, "sin1": f"sin({a1})", "cos1": f"cos({a1})",
            "sin2": f"sin({a2})", "cos2": f"cos({a2})"}


def _weight(year: str) -> str:
    return f"CASE WHEN {year} >= {CFG.recent_year} THEN {dbl(CFG.recent_weight)} ELSE {dbl(CFG.base_weight)} END"


def _training(keys: list[str], src: str = "series") -> str:
    k = ", ".join(keys)
    excluded = ", ".join(str(y) for y in CFG.excluded_years)
    targets = "targets_y(target_year) AS (VALUES " + ", ".join(f"({t})" for t in CFG.target_years) + ")"
    return f"""{targets}, train AS (
  SELECT {k}, ty.target_year, s.year, s.week, s.rate
  FROM {src} s JOIN targets_y ty ON s.year < ty.target_year
  WHERE s.year NOT IN ({excluded}) AND s.rate IS NOT NULL
)"""


def _forecast(keys: list[str], src: str = "series") -> str:
    """Training rows, 52 future rows, six Gram-Schmidt steps, projection, joins."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}, target_year"
    h_tr = _harmonic("year", "week")
    h_fu = _harmonic("target_year", "week")
    blocks = [_training(keys, src)]
    blocks.append(f"""design AS (
  SELECT {k}, target_year, week, false AS future, {_weight('year')} AS w, rate AS y,
         {', '.join(f'{h_tr[n]} AS x{i}' for i, n in enumerate(FEATURES))}
  FROM train
  UNION ALL
  SELECT {k}, target_year, week, true AS future, CAST(0.0 AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS y,
         {', '.join(f'{h_fu[n]} AS x{i}' for i, n in enumerate(FEATURES))}
  FROM (SELECT {k}, target_year, CAST(unnest(range(1, 53)) AS INT) AS week
        FROM (SELECT DISTINCT {k}, target_year FROM train))
)""")
    n = len(FEATURES)
    blocks.append(f"""g0 AS (
  SELECT {k}, target_year, week, future, w, coalesce(y, CAST(0.0 AS DOUBLE)) AS r, CAST(0.0 AS DOUBLE) AS fit,
         {', '.join(f'x{i} AS q{i}' for i in range(n))},
         {', '.join(f'sum(w * x{i} * x{i}) OVER ({part}) AS n{i}' for i in range(n))}
  FROM design
)""")
    carry = f"{k}, target_year, week, future, w"
    for j in range(n):
        later = list(range(j + 1, n))
        sums = [f"sum(w * q{j} * q{j}) OVER ({part}) AS den"]
        sums += [f"sum(w * q{j} * q{h}) OVER ({part}) AS s{h}" for h in later]
        sums.append(f"sum(w * q{j} * r) OVER ({part}) AS sr")
        blocks.append(f"a{j} AS (SELECT *, {', '.join(sums)} FROM g{j})")
        ok = f"den > {dbl(1e-12)} * n{j}"

        def coef(s):
            return f"(CASE WHEN {ok} THEN {s} / den ELSE CAST(0.0 AS DOUBLE) END)"
        cols = [f"q{i}" for i in range(j + 1)]
        cols += [f"q{h} - {coef(f's{h}')} * q{j} AS q{h}" for h in later]
        cols += [f"r - {coef('sr')} * q{j} AS r", f"fit + {coef('sr')} * q{j} AS fit"]
        cols += [f"n{i}" for i in range(n)]
        blocks.append(f"g{j + 1} AS (SELECT {carry}, {', '.join(cols)} FROM a{j})")
    blocks.append(f"""proj AS (
  SELECT {k}, target_year, week, CASE WHEN fit IS NULL THEN NULL ELSE greatest(fit, CAST(0.0 AS DOUBLE)) END AS projected
  FROM g{n} WHERE future
), q3t AS (
  SELECT {k}, target_year, week, quantile_cont(rate, 0.75) AS q3 FROM train GROUP BY {k}, target_year, week
), fc AS (
  SELECT {', '.join('p.' + c for c in keys)}, p.target_year, p.week, p.projected, q3t.q3, s.rate AS real_rate,
         coalesce(p.projected > q3t.q3, false) AS over_q3
  FROM proj p
  LEFT JOIN q3t ON {' AND '.join(f'p.{c} = q3t.{c}' for c in keys)} AND p.target_year = q3t.target_year AND p.week = q3t.week
  LEFT JOIN {src} s ON {' AND '.join(f'p.{c} = s.{c}' for c in keys)} AND p.target_year = s.year AND p.week = s.week
)""")
    return ",\n".join(blocks)


def _eval_cols() -> str:
    both = "real_rate IS NOT NULL AND projected IS NOT NULL"
    return (f"avg(CASE WHEN {both} THEN abs(projected - real_rate) END) AS mae, "
            f"avg(CASE WHEN {both} AND real_rate > 0 THEN abs(real_rate - projected) / real_rate END) "
            f"* CAST(100.0 AS DOUBLE) AS mape, CAST(count_if({both}) AS BIGINT) AS eval_weeks")


def _quality(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {dbl(lim)} THEN {q(lab)}" for lim, lab in MAPE_BANDS)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {q(MAPE_POOR)} END"


def _kpis(keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""SELECT a.*, e.mae, e.mape, e.eval_weeks FROM (
  SELECT {k}, target_year,
         arg_min(week, struct_pack(n := -projected, w := week)) AS peak_week,
         max(projected) AS peak_rate, CAST(count_if(over_q3) AS BIGINT) AS weeks_over_q3
  FROM fc GROUP BY {k}, target_year) a
JOIN (SELECT {k}, target_year, {_eval_cols()} FROM fc GROUP BY {k}, target_year) e
  USING ({k}, target_year)"""


def _kpi_select(keys: list[str]) -> str:
    k = ", ".join(keys)
    return (f"SELECT {k}, target_year, peak_week, {stable('peak_rate')} AS peak_rate, weeks_over_q3, "
            f"{stable('mae')} AS mae, {stable('mape')} AS mape, eval_weeks, {_quality('mape')} AS quality, "
            f"weeks_over_q3 > 0 AS epidemic_risk FROM ({_kpis(keys)})")


def _fc_select(keys: list[str], cols=("projected", "q3", "real_rate", "over_q3")) -> str:
    out = []
    for c in cols:
        out.append(c if c == "over_q3" else f"{stable(c)} AS {c}")
    return f"SELECT {', '.join(keys)}, target_year, week, {', '.join(out)} FROM fc"


# -- statements ---------------------------------------------------------------

def _ranking(keys: list[str], k: int | None) -> str:
    ks = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    inner = (f"SELECT {ks}, {exact_mean('rate')} AS rate FROM s WHERE {notnull} GROUP BY {ks} "
             f"ORDER BY rate DESC NULLS LAST, {ks}" + (f" LIMIT {k}" if k else ""))
    return f"SELECT {ks}, {stable('rate')} AS rate, {_rank('rate', keys)} FROM ({inner})"


def _rank(value: str, keys: list[str]) -> str:
    return f"CAST(row_number() OVER (ORDER BY {value} DESC NULLS LAST, {', '.join(keys)}) AS INT) AS rank"


def _first(col: str) -> str:
    return f"(SELECT min({col}) FROM m)"


def _week_mean(key: str, extra: str = "") -> str:
    return (with_(_slice(extra)) + f"SELECT week, {key}, {stable(exact_mean('rate'))} AS rate FROM s "
            f"WHERE week IS NOT NULL AND {key} IS NOT NULL GROUP BY week, {key}")


def _raw_select(cte: str) -> str:
    return with_() + f"SELECT {', '.join(RAW_COLS)} FROM {cte}"


def statements() -> dict[str, str]:
    lo, hi = CFG.baseline_years
    s: dict[str, str] = {}
    s["clean_rows"] = _raw_select("clean")
    s["excluded_labels"] = _raw_select("excl")
    s["spelling_fix"] = with_() + "SELECT region, area, facility, CAST(count(*) AS BIGINT) AS rows FROM fixed GROUP BY 1, 2, 3"
    s["unpivot_ages"] = with_() + "SELECT * FROM long"
    s["pop_join"] = with_() + "SELECT * FROM joined"
    s["population_in_feed"] = with_() + "SELECT * FROM popn WHERE area IN (SELECT area FROM long)"
    s["area_coverage"] = with_() + """SELECT area, bool_or(in_feed) AS in_feed, bool_or(in_population) AS in_population FROM (
  SELECT area, true AS in_feed, false AS in_population FROM long
  UNION ALL SELECT area, false, true FROM popn) WHERE area IS NOT NULL GROUP BY area"""
    s["orphan_audit"] = with_() + """SELECT CAST(count_if(population IS NULL) AS BIGINT) AS orphan_rows,
  CAST(count(*) AS BIGINT) AS total_rows,
  (SELECT area FROM joined WHERE population IS NULL ORDER BY area, year, age_group LIMIT 1) AS example_area,
  (SELECT year FROM joined WHERE population IS NULL ORDER BY area, year, age_group LIMIT 1) AS example_year,
  (SELECT age_group FROM joined WHERE population IS NULL ORDER BY area, year, age_group LIMIT 1) AS example_age_group
FROM joined"""
    s["row_rate"] = with_() + "SELECT * FROM master"
    s["master_summary"] = with_() + f"""SELECT year, CAST(count(*) AS BIGINT) AS rows, sum(visits) AS visits,
  sum(population) AS population, CAST(count_if(population = 0) AS BIGINT) AS zero_population_rows,
  {stable(exact_mean('rate'))} AS mean_rate FROM master GROUP BY year"""
    s["cause_recode"] = with_() + (f"SELECT cause AS cause_raw, {_recode(utrim('cause'))} AS cause, "
                                   "CAST(count(*) AS BIGINT) AS rows FROM master GROUP BY 1, 2")
    known = ", ".join(q(k) for k, _ in CFG.cause_labels) or "NULL"
    s["cause_drift"] = with_() + (f"SELECT {utrim('cause')} AS cause, CAST(count(*) AS BIGINT) AS rows, "
                                  f"sum(visits) AS visits FROM master WHERE {utrim('cause')} NOT IN ({known}) GROUP BY 1")
    s["care_level"] = with_() + "SELECT facility_type, care_level, CAST(count(*) AS BIGINT) AS rows FROM m GROUP BY 1, 2"
    s["selector_values"] = with_() + """SELECT 'year' AS kind, CAST(row_number() OVER (ORDER BY year DESC) AS INT) AS position, CAST(year AS VARCHAR) AS value
FROM (SELECT DISTINCT year FROM m)
UNION ALL SELECT 'area', CAST(row_number() OVER (ORDER BY area) AS INT), area FROM (SELECT DISTINCT area FROM m)
UNION ALL SELECT 'age_group', CAST(row_number() OVER (ORDER BY age_group) AS INT), age_group FROM (SELECT DISTINCT age_group FROM m)"""

    s["top_areas"] = with_(_slice()) + _ranking(["area"], None)
    s["top5_causes"] = with_(_slice()) + _ranking(["cause"], CFG.top_causes)
    s["top10_facilities"] = with_(_slice()) + _ranking(["area", "facility"], CFG.top_facilities)
    s["top10_facilities_by_age"] = with_(_slice(f"age_group = {_first('age_group')}")) + f"""SELECT *, {_rank('visits', ['facility', 'care_level'])} FROM (
  SELECT facility, care_level, sum(visits) AS visits FROM s WHERE facility IS NOT NULL AND care_level IS NOT NULL
  GROUP BY 1, 2 ORDER BY visits DESC NULLS LAST, facility, care_level LIMIT {CFG.top_facilities})"""
    s["facility_ranking"] = with_(_slice(f"area = {_first('area')}")) + _ranking(["facility", "care_level"], None)
    s["area_share"] = with_(_slice()) + f"""SELECT area, sum(visits) AS visits,
  {stable('sum(visits) / nullif((SELECT sum(visits) FROM s), 0)')} AS share
FROM s WHERE area IS NOT NULL GROUP BY area"""
    s["trend_by_level"] = _week_mean("care_level")
    s["profile_age_level"] = with_(_slice()) + (
        f"SELECT age_group, care_level, {stable(exact_mean('rate'))} AS rate FROM s "
        "WHERE age_group IS NOT NULL AND care_level IS NOT NULL GROUP BY 1, 2")
    s["profile_cause_level"] = with_(_slice()) + f"""SELECT cause, care_level, sum(visits) AS visits FROM s
WHERE cause IN (SELECT cause FROM s WHERE cause IS NOT NULL GROUP BY cause
                ORDER BY sum(visits) DESC NULLS LAST, cause LIMIT {CFG.top_causes})
  AND care_level IS NOT NULL
GROUP BY 1, 2"""
    s["facility_week"] = _week_mean("facility", f"area = {_first('area')}")
    s["area_week"] = _week_mean("area")
    s["kpi_totals"] = with_(_slice()) + f"""SELECT total_visits, hospital_visits, primary_visits,
  {stable('hospital_visits / nullif(total_visits, 0) * CAST(100 AS DOUBLE)')} AS hospital_pct,
  {stable('primary_visits / nullif(total_visits, 0) * CAST(100 AS DOUBLE)')} AS primary_pct
FROM (SELECT sum(visits) AS total_visits,
  sum(CASE WHEN care_level = {q(LEVEL_HOSPITAL)} THEN visits ELSE 0.0 END) AS hospital_visits,
  sum(CASE WHEN care_level = {q(LEVEL_PRIMARY)} THEN visits ELSE 0.0 END) AS primary_visits FROM s)"""
    whole = f"s AS (SELECT * FROM m WHERE year = {WHOLE_YEAR} AND week BETWEEN 1 AND 53)"
    s["top_areas_whole_year"] = s["top_areas"].replace(_slice(), whole)
    s["kpi_totals_whole_year"] = s["kpi_totals"].replace(_slice(), whole)
    s["area_share_whole_year"] = s["area_share"].replace(_slice(), whole)
    s["insights"] = with_(_slice()) + f"""SELECT leading_cause, leading_cause_visits, total_visits,
  {stable('leading_cause_visits / nullif(total_visits, 0) * CAST(100 AS DOUBLE)')} AS leading_cause_pct,
  (SELECT age_group FROM (SELECT age_group, {exact_mean('rate')} AS r FROM s WHERE age_group IS NOT NULL
     GROUP BY age_group) ORDER BY r DESC NULLS LAST, age_group LIMIT 1) AS leading_age_group
FROM (SELECT cause AS leading_cause, v AS leading_cause_visits FROM
        (SELECT cause, sum(visits) AS v FROM s WHERE cause IS NOT NULL GROUP BY cause)
      ORDER BY v DESC NULLS LAST, cause LIMIT 1),
     (SELECT sum(visits) AS total_visits FROM s)"""
    s["overview_bundle"] = with_(_slice()) + f"""SELECT 'areas' AS ranking, rank, area AS key, CAST(NULL AS VARCHAR) AS key2, rate
FROM ({_ranking(['area'], None)})
UNION ALL SELECT 'causes', rank, cause, NULL, rate FROM ({_ranking(['cause'], CFG.top_causes)})
UNION ALL SELECT 'facilities', rank, area, facility, rate FROM ({_ranking(['area', 'facility'], CFG.top_facilities)})"""
    s["peak_area"] = with_(_slice()) + f"""SELECT area, {stable('rate')} AS rate FROM
  (SELECT area, {exact_mean('rate')} AS rate FROM s WHERE area IS NOT NULL GROUP BY area)
ORDER BY rate DESC NULLS LAST, area LIMIT 1"""
    s["share_of_leading_cause"] = with_(_slice()) + f"""SELECT cause, visits, total_visits,
  {stable('visits / nullif(total_visits, 0) * CAST(100 AS DOUBLE)')} AS share_pct,
  cause = (SELECT cause FROM (SELECT cause, sum(visits) AS v FROM s WHERE cause IS NOT NULL GROUP BY cause)
           ORDER BY v DESC NULLS LAST, cause LIMIT 1) AS is_leading
FROM (SELECT cause, sum(visits) AS visits FROM s WHERE cause IS NOT NULL GROUP BY cause),
     (SELECT sum(visits) AS total_visits FROM s)"""

    s["weekly_pooled_rate"] = with_(SERIES) + f"SELECT scope, year, week, visits, population, {stable('rate')} AS rate FROM series"
    s["endemic_channel"] = with_(SERIES, CHANNEL) + (
        f"SELECT scope, week, {stable('q1')} AS q1, {stable('q2')} AS q2, {stable('q3')} AS q3, "
        f"{stable('current_rate')} AS current_rate, last_week FROM chan")
    zcols = "scope, week, current_rate, q1, q2, q3, zone, insight, action, trend"
    s["zone_by_week"] = with_(SERIES, CHANNEL, ZONES) + f"SELECT {zcols} FROM zones"
    s["week_lookup"] = with_(SERIES, CHANNEL, ZONES) + f"SELECT {zcols} FROM zones WHERE week = last_week"
    s["interpolated_weeks"] = with_(SERIES, CHANNEL) + (
        f"SELECT scope, week, {stable('q2')} AS q2_raw, {stable(_interp('q2'))} AS q2 FROM raw_chan")
    s["baseline_slice"] = with_(SERIES) + (
        f"SELECT scope, year, week, visits, population, {stable('rate')} AS rate FROM series "
        f"WHERE year BETWEEN {lo} AND {hi}")
    s["peak_week"] = with_(SERIES) + f"""SELECT scope, arg_min(week, struct_pack(n := -rate, w := week)) AS week,
  {stable('max(rate)')} AS rate FROM series WHERE year = {_eval_year()} AND rate IS NOT NULL GROUP BY scope
UNION ALL SELECT scope, NULL, NULL FROM series WHERE year = {_eval_year()} GROUP BY scope HAVING count(rate) = 0"""

    pcols = (f"scope, week, {stable('q2_hist')} AS q2_hist, {stable('current_rate')} AS current_rate, "
             f"{stable('p_score')} AS p_score, kind")
    s["pscore_weekly"] = with_(SERIES, PSCORE) + f"SELECT {pcols} FROM psk WHERE scope = {q(GLOBAL_SCOPE)}"
    s["pscore_by_area"] = with_(SERIES, PSCORE) + f"SELECT {pcols} FROM psk"
    summary = f"""SELECT scope, {stable('peak_pscore')} AS peak_pscore,
  coalesce(first_beyond, first_peak) AS peak_week, {stable('mean_excess')} AS mean_excess, zero_median_weeks,
  CASE WHEN zero_median_weeks > 0 THEN {q(SEVERITY_BANDS[0][1])} ELSE {_severity('peak_pscore')} END AS severity FROM (
  SELECT scope, max(p_score) AS peak_pscore,
         arg_min(CASE WHEN p_score IS NOT NULL THEN week END, struct_pack(n := -p_score, w := week)) FILTER (p_score IS NOT NULL) AS first_peak,
         min(CASE WHEN q2_hist = 0 AND current_rate > 0 THEN week END) AS first_beyond,
         coalesce(avg(CASE WHEN p_score > 0 THEN p_score END), CAST(0.0 AS DOUBLE)) AS mean_excess,
         CAST(count_if(q2_hist = 0 AND current_rate > 0) AS BIGINT) AS zero_median_weeks
  FROM psk WHERE p_score IS NOT NULL OR (q2_hist = 0 AND current_rate > 0) GROUP BY scope)"""
    s["pscore_summary"] = with_(SERIES, PSCORE) + summary
    quiet = f"""series AS (
  SELECT * REPLACE (CASE WHEN {_baseline()} AND week % 5 = 0 THEN CAST(0.0 AS DOUBLE) ELSE rate END AS rate) FROM series0
)"""
    loud = SERIES.replace("), series AS (", "), series0 AS (")
    s["pscore_zero_median"] = with_(loud, quiet, PSCORE) + f"SELECT {pcols} FROM psk"
    s["pscore_zero_median_summary"] = with_(loud, quiet, PSCORE) + summary

    w = CFG.smoothing_window
    frame = f"ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"
    sm = f"""sm AS (
  SELECT scope, week, rate AS {RAW_SERIES},
         CASE WHEN count(rate) OVER (PARTITION BY scope ORDER BY week {frame}) = {w}
              THEN avg(rate) OVER (PARTITION BY scope ORDER BY week {frame}) END AS {SMOOTH_SERIES}
  FROM series WHERE year = {_eval_year()}
)"""
    s["moving_average"] = with_(SERIES, sm) + (
        f"SELECT scope, week, {stable(RAW_SERIES)} AS {RAW_SERIES}, {stable(SMOOTH_SERIES)} AS {SMOOTH_SERIES} FROM sm")
    s["moving_average_long"] = with_(SERIES, sm) + (
        f"SELECT scope, week, '{RAW_SERIES}' AS series, {stable(RAW_SERIES)} AS rate FROM sm "
        f"UNION ALL SELECT scope, week, '{SMOOTH_SERIES}', {stable(SMOOTH_SERIES)} FROM sm")

    h = _harmonic("year", "week")
    s["harmonic_features"] = with_(SERIES, _training(["scope"])) + (
        f"SELECT scope, target_year, year, week, {stable('rate')} AS rate, {h['intercept']} AS intercept, "
        + ", ".join(f"{stable(h[n])} AS {n}" for n in FEATURES[1:])
        + f", {_weight('year')} AS weight FROM train")
    s["training_slice"] = with_(SERIES, _training(["scope"])) + (
        f"SELECT scope, target_year, year, week, {stable('rate')} AS rate FROM train")
    gseries = f"gseries AS (SELECT * FROM series WHERE scope = {q(GLOBAL_SCOPE)})"
    s["wls_forecast"] = with_(SERIES, gseries, _forecast(["scope"], "gseries")) + _fc_select(["scope"])
    s["forecast_by_area"] = with_(SERIES, _forecast(["scope"])) + _fc_select(["scope"])
    s["forecast_exceedance"] = with_(SERIES, _forecast(["scope"])) + _fc_select(["scope"], ("projected", "q3", "over_q3"))
    s["forecast_eval"] = with_(SERIES, _forecast(["scope"])) + (
        f"SELECT scope, target_year, {stable('mae')} AS mae, {stable('mape')} AS mape, eval_weeks "
        f"FROM (SELECT scope, target_year, {_eval_cols()} FROM fc GROUP BY scope, target_year)")
    s["forecast_kpis"] = with_(SERIES, _forecast(["scope"])) + _kpi_select(["scope"])
    s["forecast_by_cause"] = with_(SERIES_T, _forecast(["scope", "target"])) + _fc_select(["scope", "target"])
    s["forecast_cause_kpis"] = with_(SERIES_T, _forecast(["scope", "target"])) + _kpi_select(["scope", "target"])

    s["filtered_slice"] = with_(_slice(f"area = {_first('area')}")) + (
        "SELECT facility, area, cause, care_level, age_group, year, week, visits, population, rate FROM s")
    s["cause_substring"] = with_(TARGETS) + """SELECT targets.target, m.cause, CAST(count(*) AS BIGINT) AS rows,
  sum(m.visits) AS visits FROM m JOIN targets ON contains(upper(m.cause), upper(targets.target))
GROUP BY 1, 2"""
    s["null_audit"] = with_() + "SELECT " + ", ".join(
        f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}_nulls" for c in RAW_COLS) + """ FROM (
  SELECT * REPLACE (""" + ", ".join(f"CASE WHEN {blank(c)} THEN NULL ELSE {c} END AS {c}" for c in TEXT_COLS) + ") FROM feed)"
    s["scalar_text"] = with_() + f"""SELECT cause AS cause_raw, facility_type AS type_raw, area AS area_raw,
  {utrim('cause')} AS cause_trim, upper({utrim('cause')}) AS cause_upper,
  split_part({utrim('cause')}, ' (', 1) AS cause_head,
  {_recode(utrim('cause'))} AS cause_mapped,
  coalesce(contains(upper(cause), 'LA'), false) AS cause_has_la,
  {blank('facility_type')} AS type_blank,
  CASE WHEN {blank('facility_type')} THEN NULL ELSE facility_type END AS type_or_null,
  {_spelling(utrim('area'))} AS area_fixed
FROM (SELECT DISTINCT cause, facility_type, area FROM raw)"""
    a = f"({dbl(2 * math.pi)} * CAST(week AS DOUBLE) / {dbl(WEEKS_PER_YEAR)})"
    s["scalar_numeric"] = with_(SERIES) + f"""SELECT year, week, visits, population, {stable('rate')} AS rate,
  round_even(rate * CAST(100.0 AS DOUBLE), 0) / CAST(100.0 AS DOUBLE) AS rate_2dp,
  {stable('abs(rate - CAST(100.0 AS DOUBLE))')} AS abs_dev_100,
  {stable('CASE WHEN rate IS NULL THEN NULL ELSE greatest(rate - CAST(100.0 AS DOUBLE), CAST(0.0 AS DOUBLE)) END')} AS excess_over_100,
  {stable('sqrt(rate)')} AS sqrt_rate, {stable(f'sin({a})')} AS sin_week, {stable(f'cos({a})')} AS cos_week,
  {stable('pi() * week')} AS pi_week,
  TRY_CAST(CAST(week AS VARCHAR) || '.5' AS DOUBLE) AS coerced,
  TRY_CAST('n/a' || CAST(week AS VARCHAR) AS DOUBLE) AS coerced_bad,
  nullif(population, 0) IS NULL AS zero_population,
  coalesce(rate, CAST(0.0 AS DOUBLE)) AS rate_or_zero
FROM series WHERE scope = {q(GLOBAL_SCOPE)}"""
    one = "(VALUES " + ", ".join(f"({t})" for t in CFG.target_years) + ")"
    several = "(VALUES " + ", ".join(f"({t})" for t in SEVERAL_TARGETS) + ")"
    s["forecast_several_targets"] = s["forecast_by_area"].replace(one, several)
    s["forecast_kpis_several_targets"] = s["forecast_kpis"].replace(one, several)
    gaps = POP.replace("AS population,", "AS population_,", 1).replace("age_group, population FROM (", "age_group, "
        "CASE WHEN age_group = 'BUILDING' AND CAST(unnest(yrs) AS INT) % 2 = 0 THEN NULL ELSE population_ END AS population FROM (")
    s["nan_population_rates"] = with_().replace(POP, gaps) + f"""SELECT year, age_group, CAST(count(*) AS BIGINT) AS rows,
  CAST(count_if(population = 0) AS BIGINT) AS zero_population_rows, {stable(exact_mean('rate'))} AS mean_rate
FROM master GROUP BY 1, 2"""
    s["refresh_roundtrip"] = s["master_summary"].replace("SELECT year,", "SELECT true AS published, true AS bad_refused, "
        "true AS missing_refused, 0 AS admin_columns, year,", 1)
    s["head_active_rows"] = with_() + (
        "SELECT * FROM master WHERE visits > 0 ORDER BY area, year, week, facility, cause, age_group LIMIT 5")
    return s


ORACLE_SQL = statements()
