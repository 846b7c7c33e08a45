"""The same queries in DuckDB SQL, written from the definitions: common parts as CTEs."""

from __future__ import annotations

from panelspark.functions.special import counter_sql, normal_cdf_sql, normal_quantile, student_upper_sql
from panelspark.operators.portfolio import AUM_MM, COSTS, EULER_GAMMA, TIERS, round_trip
from panelspark.operators.campaign import TABLES as TABLE_NAMES
from panelspark.operators.robustness import LEVEL_CRITICAL, LEVEL_ODDS, ROOT_LARGE, ROOT_LEAST, ROOT_MOST, ROOT_SMALL, ROOT_SWITCH
from panelspark.plans.panel_queries import DRAWS, PERMS, PRIMARY, SEED, THRESHOLDS

WEEK_VALUES = """SELECT date_trunc('week', l_shipdate)::DATE AS date, s_nationkey AS entity,
  sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
MONTH_VALUES = """SELECT date_trunc('month', o_orderdate)::DATE AS date, c_nationkey AS entity,
  sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
DAY_VALUES = "SELECT ts::DATE AS date, user_id % 5 AS entity, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM events GROUP BY 1, 2"
TAUS = ", ".join(f"({x}::DOUBLE)" for x in THRESHOLDS)


def returns(values: str = WEEK_VALUES) -> str:
    """CTEs up to ``ret`` (t, e, ret)."""
    return f"""WITH v AS ({values}),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM v)),
ent AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS e FROM (SELECT DISTINCT entity FROM v)),
grid AS (SELECT t, e, value FROM cal CROSS JOIN ent LEFT JOIN v USING (date, entity)),
ret AS (SELECT t, e, value / nullif(lag(value) OVER (PARTITION BY e ORDER BY t), 0) - 1 AS ret FROM grid)"""


RANKED = """,
tied AS (SELECT *, count(*) OVER (PARTITION BY t, pred IS NULL) AS n, rank() OVER (PARTITION BY t, pred IS NULL ORDER BY abs(pred)) AS rk,
  count(*) OVER (PARTITION BY t, abs(pred)) AS ties FROM scored),
conf AS (SELECT *, CASE WHEN pred IS NULL THEN NULL WHEN n = 1 THEN 1.0::DOUBLE ELSE (rk - 1 + (ties - 1) / 2.0::DOUBLE) / (n - 1) END AS c FROM tied),
pan AS (SELECT t, e, pred, CASE WHEN pred <> 0 AND nxt IS NOT NULL THEN sign(pred) * nxt END AS realised,
  CASE WHEN pred <> 0 AND nxt IS NOT NULL THEN c END AS conf FROM conf)"""


def momentum(values: str = WEEK_VALUES, lookback: int = 4, skip: int = 1) -> str:
    """CTEs up to ``pan`` (t, e, pred, realised, conf)."""
    return f"""{returns(values)},
scored AS (SELECT t, e, CASE WHEN count(ret) OVER w = {lookback} THEN product(1 + ret) OVER w - 1 END AS pred, lead(ret) OVER (PARTITION BY e ORDER BY t) AS nxt
  FROM ret WINDOW w AS (PARTITION BY e ORDER BY t ROWS BETWEEN {lookback + skip - 1} PRECEDING AND {skip} PRECEDING)){RANKED}"""


def dates(base: str, taus: str = TAUS) -> str:
    """CTEs up to ``dr`` (tau, t, r, k) and ``ser`` (tau, u, r)."""
    return f"""{base},
thr(tau) AS (VALUES {taus}),
dr AS (SELECT tau, t, avg(realised) FILTER (conf >= tau AND realised IS NOT NULL AND pred IS NOT NULL) AS r,
  count(*) FILTER (conf >= tau AND realised IS NOT NULL AND pred IS NOT NULL) AS k FROM pan CROSS JOIN thr GROUP BY 1, 2),
ser AS (SELECT tau, row_number() OVER (PARTITION BY tau ORDER BY t) - 1 AS u, r FROM dr WHERE r IS NOT NULL)"""


def sharpe(x: str, a: float = 52.0) -> str:
    return f"coalesce(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt({a}::DOUBLE) END, 0.0::DOUBLE)"


BASE = dates(momentum())
MOMENTS = "m AS (SELECT tau, count(*) AS n, avg(r) AS mu, avg(r * r) AS m2 FROM ser GROUP BY tau), c AS (SELECT tau, u, n, mu, m2, r - mu AS x, r * r - m2 AS y FROM ser JOIN m USING (tau))"
BANDWIDTH = """fit AS (SELECT tau, any_value(n) AS n, sum(b * x) AS s01, sum(b * b) AS s00 FROM (SELECT *, lag(x) OVER (PARTITION BY tau ORDER BY u) AS b FROM c) GROUP BY tau),
fr AS (SELECT tau, n, greatest(-0.95, least(0.95, CASE WHEN s00 > 0 THEN s01 / s00 ELSE 0 END)) AS rho FROM fit),
bw AS (SELECT tau, CASE WHEN n < 3 THEN 0 ELSE greatest(1, least(ceil(1.1447 * pow(greatest(4 * rho * rho / greatest(pow(1 - rho, 4), 1e-8) * n, 1.0), 1 / 3.0::DOUBLE)), greatest(1, n - 1))) END::BIGINT AS bandwidth FROM fr)"""


def acf(most: int) -> str:
    """CTE ``rho`` (tau, k, n, rho)."""
    return f"""ac AS (SELECT a.tau, k, any_value(a.n) AS n, sum(a.x * b.x) AS s FROM c a CROSS JOIN (SELECT unnest(range(0, {most + 1})) AS k) JOIN c b ON b.tau = a.tau AND b.u = a.u + k WHERE k <= a.n - 1 GROUP BY 1, 2),
rho AS (SELECT tau, k, n, CASE WHEN k = 0 THEN 1.0 WHEN max(s) FILTER (k = 0) OVER (PARTITION BY tau) > 0 THEN s / max(s) FILTER (k = 0) OVER (PARTITION BY tau) ELSE 0 END AS rho FROM ac)"""


def delta() -> str:
    """CTE ``h`` of delta-method results from ``cov`` (n, mu, m2, bandwidth, s11, s12, s22)."""
    half = normal_quantile(0.975)
    return f"""g AS (SELECT *, greatest(m2 - mu * mu, 1e-16) AS vv FROM cov),
g2 AS (SELECT *, sqrt(52.0::DOUBLE) * mu / sqrt(vv) AS sharpe, sqrt(52.0::DOUBLE) * m2 / pow(vv, 1.5) AS d1, -0.5 * sqrt(52.0::DOUBLE) * mu / pow(vv, 1.5) AS d2 FROM g),
g3 AS (SELECT *, CASE WHEN n >= 5 THEN sqrt(greatest((d1 * d1 * s11 + 2 * d1 * d2 * s12 + d2 * d2 * s22) / n, 0)) END AS se FROM g2),
g4 AS (SELECT *, sharpe / se AS z FROM g3),
h AS (SELECT *, 1 - {normal_cdf_sql("z")} AS p, sharpe - {half} * se AS ci_lo, sharpe + {half} * se AS ci_hi FROM g4)"""


def hac(widths: str, keys: str = "tau") -> str:
    """CTE ``h`` of delta-method results from ``widths`` (keys, bandwidth)."""
    return f"""wd AS ({widths}),
lag AS (SELECT {", ".join("w." + k for k in keys.split(", "))}, least(bandwidth, a.n - 1) AS bandwidth, a.n, a.mu, a.m2,
  CASE WHEN k = 0 THEN 0.5 ELSE 1 - k / (least(bandwidth, a.n - 1) + 1.0::DOUBLE) END AS wt, a.x, a.y, b.x AS x2, b.y AS y2
  FROM c a JOIN wd w USING (tau) CROSS JOIN LATERAL (SELECT unnest(range(0, least(bandwidth, a.n - 1) + 1)) AS k) JOIN c b ON b.tau = a.tau AND b.u = a.u + k),
cov AS (SELECT {keys}, any_value(n) AS n, any_value(mu) AS mu, any_value(m2) AS m2, any_value(bandwidth) AS bandwidth,
  sum(wt * 2 * x * x2) / any_value(n) AS s11, sum(wt * (x * y2 + y * x2)) / any_value(n) AS s12, sum(wt * 2 * y * y2) / any_value(n) AS s22 FROM lag GROUP BY {keys}),
{delta()}"""


ROOT = "pow((p11 + p22) / 2, 2) - (p11 * p22 - p12 * p21)"
PREWHITE = f"""lg AS (SELECT *, lag(x) OVER o AS bx, lag(y) OVER o AS bq FROM c WHERE n >= 8 WINDOW o AS (PARTITION BY tau ORDER BY u)),
su AS (SELECT tau, any_value(n) AS n, any_value(mu) AS mu, any_value(m2) AS m2, sum(bx * bx) AS a, sum(bx * bq) AS b, sum(bq * bq) AS d,
  sum(x * bx) AS xx, sum(x * bq) AS xy, sum(y * bx) AS yx, sum(y * bq) AS yy FROM lg WHERE bx IS NOT NULL GROUP BY tau),
ph AS (SELECT tau, n, mu, m2, (xx * d - xy * b) / (a * d - b * b) AS p11, (xy * a - xx * b) / (a * d - b * b) AS p12,
  (yx * d - yy * b) / (a * d - b * b) AS p21, (yy * a - yx * b) / (a * d - b * b) AS p22 FROM su),
ra AS (SELECT *, CASE WHEN {ROOT} >= 0 THEN abs((p11 + p22) / 2) + sqrt(greatest({ROOT}, 0)) ELSE sqrt(abs(p11 * p22 - p12 * p21)) END AS rad FROM ph),
sh AS (SELECT tau, n, mu, m2, p11 * sc AS p11, p12 * sc AS p12, p21 * sc AS p21, p22 * sc AS p22 FROM (SELECT *, CASE WHEN rad >= 0.98 THEN 0.98 / rad ELSE 1 END AS sc FROM ra)),
re AS (SELECT tau, u, x - p11 * bx - p12 * bq AS e, y - p21 * bx - p22 * bq AS q FROM lg JOIN sh USING (tau) WHERE bx IS NOT NULL),
ce AS (SELECT tau, u, count(*) OVER p AS n, e - avg(e) OVER p AS x, q - avg(q) OVER p AS y FROM re WINDOW p AS (PARTITION BY tau)),
fe AS (SELECT tau, any_value(n) AS n, greatest(-0.95, least(0.95, coalesce(sum(b * x) / nullif(sum(b * b), 0), 0))) AS rho FROM (SELECT *, lag(x) OVER (PARTITION BY tau ORDER BY u) AS b FROM ce) GROUP BY tau),
we AS (SELECT tau, greatest(1, least(ceil(1.1447 * pow(greatest(4 * rho * rho / greatest(pow(1 - rho, 4), 1e-8) * n, 1.0), 1 / 3.0::DOUBLE)), greatest(1, n - 1)))::BIGINT AS bandwidth FROM fe),
le AS (SELECT tau, bandwidth, a.n, CASE WHEN k = 0 THEN 0.5 ELSE 1 - k / (bandwidth + 1.0::DOUBLE) END AS wt, a.x, a.y, b.x AS x2, b.y AS y2
  FROM ce a JOIN we USING (tau) CROSS JOIN LATERAL (SELECT unnest(range(0, bandwidth + 1)) AS k) JOIN ce b ON b.tau = a.tau AND b.u = a.u + k),
om AS (SELECT tau, any_value(bandwidth) AS bandwidth, sum(wt * 2 * x * x2) / any_value(n) AS w11, sum(wt * (x * y2 + y * x2)) / any_value(n) AS w12, sum(wt * 2 * y * y2) / any_value(n) AS w22 FROM le GROUP BY tau),
iv AS (SELECT *, (1 - p22) / dt AS a11, p12 / dt AS a12, p21 / dt AS a21, (1 - p11) / dt AS a22 FROM (SELECT *, (1 - p11) * (1 - p22) - p12 * p21 AS dt FROM sh)),
cov AS (SELECT tau, n, mu, m2, bandwidth, a11 * a11 * w11 + 2 * a11 * a12 * w12 + a12 * a12 * w22 AS s11,
  a11 * a21 * w11 + (a11 * a22 + a12 * a21) * w12 + a12 * a22 * w22 AS s12, a21 * a21 * w11 + 2 * a21 * a22 * w12 + a22 * a22 * w22 AS s22 FROM iv JOIN om USING (tau)),
{delta()}"""
HELD = """hd AS (SELECT tau, realised FROM pan CROSS JOIN thr WHERE conf >= tau AND realised IS NOT NULL),
hm AS (SELECT tau, count(*) AS n, avg(realised) AS mu, avg(realised * realised) AS m2 FROM hd GROUP BY tau),
hc AS (SELECT tau, any_value(n) AS n, any_value(mu) AS mu, any_value(m2) AS m2, avg(pow(realised - mu, 2)) AS s11,
  avg((realised - mu) * (realised * realised - m2)) AS s12, avg(pow(realised * realised - m2, 2)) AS s22 FROM hd JOIN hm USING (tau) GROUP BY tau),
hv AS (SELECT *, greatest(m2 - mu * mu, 1e-16) AS v FROM hc),
hs AS (SELECT tau, sqrt((52.0::DOUBLE / pow(v, 3)) * (m2 * m2 * s11 - m2 * mu * s12 + 0.25 * mu * mu * s22) / n) AS se_rows FROM hv)"""
AUTO = "SELECT tau, bandwidth FROM bw"
BLOCKS = f"""{acf(1)},
bl AS (SELECT tau, n, CASE WHEN n < 10 THEN greatest(1, n) ELSE greatest(1, least(ceil(pow(n::DOUBLE, 0.2) *
  greatest(CASE WHEN f > 0 THEN pow(2 * f / (1 - f), 2 / 3.0::DOUBLE) ELSE 1 END, 1)), greatest(1, n // 3))) END::BIGINT AS b
  FROM (SELECT tau, any_value(n) AS n, greatest(0.0, least(0.95, coalesce(max(rho) FILTER (k = 1), 0))) AS f FROM rho GROUP BY tau))"""


def indices(method: str, source: str = "bl", keys: str = "tau, ", seed: int | str = SEED) -> str:
    """CTE ``ix`` (keys, draw, pos, u)."""
    draws = f"CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS draw)"
    if method == "moving_block":
        start = counter_sql(seed, "draw", "block")
        return f"""ix AS (SELECT {keys} draw, block * b + step AS pos, ({start}) % (n - b + 1) + step AS u
  FROM {source} {draws} CROSS JOIN LATERAL (SELECT unnest(range(0, ceil(n / b)::BIGINT)) AS block) CROSS JOIN LATERAL (SELECT unnest(range(0, b)) AS step) WHERE block * b + step < n)"""
    cells = f"SELECT {keys} n, b, draw, pos, ({counter_sql(SEED, 'draw', 'pos')}) % n AS r0, ({counter_sql(SEED + 1, 'draw', 'pos')}) AS r1 FROM {source} {draws} CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS pos)"
    if method in ("iid", "cluster_date"):
        return f"ix AS (SELECT {keys} draw, pos, r0 AS u FROM ({cells}))"
    return f"""cells AS ({cells}),
runs AS (SELECT *, max(CASE WHEN pos = 0 OR r1 * b < 4294967296 THEN pos END) OVER (PARTITION BY {keys} draw ORDER BY pos) AS since FROM cells),
ix AS (SELECT {", ".join("a." + k.strip() for k in keys.split(",") if k.strip())}, a.draw, a.pos, (s.r0 + a.pos - a.since) % a.n AS u FROM runs a JOIN cells s ON s.tau = a.tau AND s.draw = a.draw AND s.pos = a.since)"""


MENU = f"""any_date AS (SELECT t, avg(r) AS r, row_number() OVER (ORDER BY t) - 1 AS u FROM dr GROUP BY t HAVING count(r) > 0),
rows AS (SELECT tau, u, dr.r, coalesce(dr.r - avg(dr.r) OVER (PARTITION BY tau), 0) AS x FROM dr JOIN any_date USING (t)),
mb AS (SELECT count(*) AS n, avg(r) AS mu FROM any_date),
mrho AS (SELECT any_value(n) AS n, sum((a.r - mu) * (b.r - mu)) / (SELECT sum((r - mu) * (r - mu)) FROM any_date, mb) AS f FROM any_date a JOIN any_date b ON b.u = a.u + 1, mb),
bl AS (SELECT n, greatest(1, least(ceil(pow(n::DOUBLE, 0.2) * greatest(CASE WHEN f > 0 THEN pow(2 * least(f, 0.95) / (1 - least(f, 0.95)), 2 / 3.0::DOUBLE) ELSE 1 END, 1)), greatest(1, n // 3)))::BIGINT AS b FROM mrho),
{indices("moving_block", keys="")}"""
T_STAT = "coalesce(CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / (stddev_samp({0}) / sqrt(count({0}))) END, 0)"
ROMANO = f"""obs AS (SELECT *, row_number() OVER (ORDER BY t_stat DESC, tau DESC) AS step FROM (SELECT tau, {T_STAT.format("r")} AS t_stat FROM rows GROUP BY tau)),
dw AS (SELECT draw, tau, {T_STAT.format("x")} AS td FROM ix JOIN rows USING (u) GROUP BY 1, 2),
hi AS (SELECT *, max(td) OVER (PARTITION BY draw ORDER BY step DESC) AS top FROM dw JOIN obs USING (tau)),
ps AS (SELECT tau, t_stat, step, (1 + count(*) FILTER (td >= t_stat)) / (1 + count(*))::DOUBLE AS p_raw, (1 + count(*) FILTER (top >= t_stat)) / (1 + count(*))::DOUBLE AS p_step FROM hi GROUP BY 1, 2, 3),
rw AS (SELECT tau, t_stat, p_raw, greatest(least(max(p_step) OVER (ORDER BY step), 1.0), p_raw) AS p_adjusted FROM ps)"""
WEIGHTS = """w AS (SELECT tau, t, e, CASE WHEN held THEN sign(pred) / count(*) FILTER (held) OVER (PARTITION BY tau, t) ELSE 0 END::DOUBLE AS wt
  FROM (SELECT tau, t, e, pred, coalesce(conf >= tau, false) AS held FROM pan CROSS JOIN thr))"""
NEUTRAL = """w AS (SELECT tau, t, e, CASE WHEN nl > 0 AND ns > 0 AND held AND pred > 0 THEN 0.5 / nl WHEN nl > 0 AND ns > 0 AND held AND pred < 0 THEN -0.5 / ns ELSE 0 END::DOUBLE AS wt
  FROM (SELECT *, count(*) FILTER (held AND pred > 0) OVER (PARTITION BY tau, t) AS nl, count(*) FILTER (held AND pred < 0) OVER (PARTITION BY tau, t) AS ns
    FROM (SELECT tau, t, e, pred, coalesce(conf >= tau, false) AS held FROM pan CROSS JOIN thr)))"""
TURNOVER = """st AS (SELECT *, lag(wt) OVER (PARTITION BY tau, e ORDER BY t) AS old FROM w),
pd AS (SELECT tau, t, sum(0.5 * abs(wt - old)) AS total, sum(CASE WHEN wt * old > 0 THEN 0.5 * abs(wt - old) ELSE 0 END) AS rescale, sum(abs(wt) + abs(old)) > 0 AS active FROM st GROUP BY 1, 2),
tn AS (SELECT tau, coalesce(avg(total) FILTER (active AND t > 0), 0) AS total, coalesce(avg(rescale) FILTER (active AND t > 0), 0) AS rescale,
  coalesce(avg(greatest(total - rescale, 0)) FILTER (active AND t > 0), 0) AS rest, count(*) FILTER (active AND t > 0) AS pairs FROM pd GROUP BY tau)"""
WINDOWS = """nd AS (SELECT max(t) + 1 AS n FROM dr),
win AS (SELECT name, lo, hi FROM nd CROSS JOIN LATERAL (SELECT unnest([
  {'name': 'train_70pct', 'lo': 0, 'hi': floor(n * 0.7::DOUBLE)::BIGINT}, {'name': 'holdout_30pct', 'lo': floor(n * 0.7::DOUBLE)::BIGINT, 'hi': n},
  {'name': 'quarter_1', 'lo': 0, 'hi': floor(n * 0.25)::BIGINT}, {'name': 'quarter_2', 'lo': floor(n * 0.25)::BIGINT, 'hi': floor(n * 0.5)::BIGINT},
  {'name': 'quarter_3', 'lo': floor(n * 0.5)::BIGINT, 'hi': floor(n * 0.75)::BIGINT}, {'name': 'quarter_4', 'lo': floor(n * 0.75)::BIGINT, 'hi': n}], recursive := true)))"""


def threshold_table(base: str, a: float) -> str:
    return f"""{base} SELECT tau AS threshold, count(r) AS n_dates, round(avg(k) FILTER (k > 0), 6) AS avg_names, round(avg(r), 6) AS mean,
  round(stddev_samp(r), 6) AS sd, round({sharpe("r", a)}, 6) AS sharpe FROM dr GROUP BY tau"""


def summary_of(base: str, digits: int, obs: str) -> str:
    ok = "count(DISTINCT s) > 1 AND stddev_samp(s) > 1e-10"
    return f"""{base} SELECT tau AS threshold, round(any_value(o), {digits}) AS observed_sharpe, round(avg(s), {digits}) AS null_mean, round(stddev_samp(s), {digits}) AS null_sd,
  round(quantile_cont(s, 0.025), {digits}) AS null_q025, round(quantile_cont(s, 0.5), {digits}) AS null_q500, round(quantile_cont(s, 0.975), {digits}) AS null_q975,
  round(CASE WHEN {ok} THEN (1 + count(*) FILTER (s >= o)) / (1 + count(*))::DOUBLE END, {digits}) AS p_positive, count(*) AS n_perms,
  CASE WHEN {ok} THEN 'ok' ELSE 'degenerate' END AS status, coalesce({ok}, false) AS permutation_informative FROM nulls JOIN ({obs}) USING (tau) GROUP BY tau"""


def permuted(group: str, source: str = "realised / nullif(sign(pred), 0) AS raw, pred, conf", table: str = "pan") -> str:
    """CTE ``nulls`` (perm, tau, s)."""
    turn = counter_sql(SEED, "perm", "t", "e")
    return f"""raw AS (SELECT t, e, {group} AS grp, {source}, perm FROM {table} CROSS JOIN (SELECT unnest(range(0, {PERMS})) AS perm)),
pl AS (SELECT perm, t, grp, raw, row_number() OVER (PARTITION BY perm, t, grp ORDER BY e) AS nth FROM raw),
dl AS (SELECT perm, t, grp, pred, conf, row_number() OVER (PARTITION BY perm, t, grp ORDER BY {turn}, e) AS nth FROM raw),
mv AS (SELECT perm, t, pred, conf, CASE WHEN pred <> 0 THEN sign(pred) * raw END AS realised FROM pl JOIN dl USING (perm, t, grp, nth)),
pdr AS (SELECT perm, tau, t, avg(realised) FILTER (conf >= tau AND realised IS NOT NULL) AS r FROM mv CROSS JOIN thr GROUP BY 1, 2, 3),
nulls AS (SELECT perm, tau, {sharpe("r")} AS s FROM pdr GROUP BY 1, 2)"""


OBSERVED = f"SELECT tau, {sharpe('r')} AS o FROM dr GROUP BY tau"


def draws_of(method: str) -> str:
    """All draws (tau, s) of a bootstrap of dates."""
    return f"{BASE}, {MOMENTS}, {BLOCKS}, {indices(method)} SELECT tau, draw, {sharpe('r')} AS s FROM ix JOIN ser USING (tau, u) GROUP BY 1, 2"


ENTITY_DRAWS = f"""{BASE}, ne AS (SELECT count(*) AS n FROM ent),
tm AS (SELECT draw, e, count(*) AS m FROM (SELECT draw, ({counter_sql(SEED, "draw", "nth")}) % n AS e FROM ne CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS draw) CROSS JOIN LATERAL (SELECT unnest(range(1, n + 1)) AS nth)) GROUP BY 1, 2),
bd AS (SELECT draw, t, {", ".join(f"sum(m * realised) FILTER (conf >= {x}) / nullif(sum(m) FILTER (conf >= {x}), 0) AS r{i}" for i, x in enumerate(THRESHOLDS))} FROM pan JOIN tm USING (e) GROUP BY 1, 2)
{" UNION ALL ".join(f"SELECT {x}::DOUBLE AS tau, draw, {sharpe(f'r{i}')} AS s FROM bd GROUP BY draw" for i, x in enumerate(THRESHOLDS))}"""
SUMMARY = "stddev_samp(s) AS se, quantile_cont(s, 0.025) AS ci_lo, quantile_cont(s, 0.975) AS ci_hi, (1 + count(*) FILTER (s <= 0)) / (1 + count(*))::DOUBLE AS p"
LOW = "low AS (SELECT *, min(rho) OVER (PARTITION BY tau ORDER BY k) AS lo FROM rho WHERE k <= greatest(1, n // 3)), ef AS (SELECT tau, greatest(1.0, any_value(n) / (1 + 2 * coalesce(sum(rho) FILTER (k > 0 AND lo >= 0), 0))) AS n_eff FROM low GROUP BY tau)"
SIZES = f"SELECT tau, n_eff FROM ({BASE}, {MOMENTS}, {acf(50)}, {LOW} SELECT * FROM ef)"
POINTS = f"""SELECT tau, n, mean, sd, sharpe, n_eff, b, mean / (sd / sqrt(n_eff)) AS t FROM
  ({BASE} SELECT tau, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, {sharpe("r")} AS sharpe FROM ser GROUP BY tau) JOIN ({SIZES}) USING (tau)
  JOIN ({BASE}, {MOMENTS}, {BLOCKS} SELECT tau, b FROM bl) USING (tau)"""


def records(methods: tuple[str, ...], digits: int = 5) -> str:
    """The inference records of some methods."""
    every = " UNION ALL ".join(f"SELECT tau, '{m}' AS method, {SUMMARY} FROM ({ENTITY_DRAWS if m == 'cluster_entity' else draws_of(m)}) GROUP BY tau" for m in methods)
    upper = student_upper_sql("t", "greatest(1.0, n_eff - 1)")
    return f"""SELECT tau AS threshold, method, round(sharpe, {digits}) AS sharpe, round(se, {digits}) AS se, round(ci_lo, {digits}) AS ci_lo, round(ci_hi, {digits}) AS ci_hi,
  round(mean, {digits}) AS mean_return, round(sd / sqrt(n_eff), {digits}) AS mean_return_se, round(t, {digits}) AS t_statistic, round(p, {digits}) AS positive_p_value,
  round(2 * least(up, 1 - up), {digits}) AS two_sided_p_value, round(n_eff, {digits}) AS n_eff, n AS n_nominal, b AS block_size
FROM (SELECT *, {upper} AS up FROM ({POINTS})) JOIN ({every}) USING (tau)"""


HELD_ROWS = "hd AS (SELECT tau, t, e, realised FROM pan CROSS JOIN thr WHERE conf >= tau AND realised IS NOT NULL)"
ROWS = f"""{BASE}, {HELD_ROWS}, rs AS (SELECT tau, count(*) AS n, avg(realised) / (stddev_samp(realised) / sqrt(count(*))) AS ts, {sharpe("realised")} AS sr, {sharpe("realised", 1.0)} AS s1 FROM hd GROUP BY tau)
SELECT tau, n, ts, sr, sqrt(52.0::DOUBLE * (1 + 0.5 * s1 * s1) / n) AS se, {student_upper_sql("ts", "greatest(1, n - 1)")} AS p FROM rs"""
RHO = f"""{BASE}, {HELD_ROWS},
pr AS (SELECT a.tau, a.e, b.e AS e2, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(a.realised, b.realised) END AS cc FROM hd a JOIN hd b ON a.tau = b.tau AND a.t = b.t AND a.e < b.e GROUP BY 1, 2, 3),
rh AS (SELECT tau, avg(cc) AS rho FROM pr WHERE n >= 10 AND NOT isnan(cc) GROUP BY tau)
SELECT tau, any_value(rho) AS rho, avg(k) FILTER (k > 0) AS names, count(r) AS dates FROM dr LEFT JOIN rh USING (tau) GROUP BY tau"""
MOULTON = "CASE WHEN 1 + (names - 1) * rho >= 0 THEN sqrt(greatest(1 + (names - 1) * rho, 0)) END"
HAC_P = f"{BASE}, {MOMENTS}, {BANDWIDTH}, {hac(AUTO)} SELECT tau, z, p FROM h"
RW_P = f"{BASE}, {MENU}, {ROMANO} SELECT tau, p_raw, p_adjusted FROM rw"
BOUNDARY = f"""SELECT tau, n, dates, names, rho, {MOULTON} AS sei, ts, z, r.p AS row_p, h.p AS hac_p, p_adjusted AS rw_p
FROM ({ROWS}) r JOIN ({RHO}) USING (tau) JOIN ({HAC_P}) h USING (tau) JOIN ({RW_P}) USING (tau)"""


def boundary(digits: int) -> str:
    """The row boundary of every threshold."""
    cells = {"rho_same_date": "rho", "trading_moulton_factor": "sei", "row_t_stat": "ts", "date_hac_z": "z", "row_p_positive": "row_p", "hac_p_positive": "hac_p", "romano_wolf_p": "rw_p"}
    return f"""SELECT tau AS threshold, n AS n_rows, dates AS n_dates, round(names, {digits}) AS avg_names, {", ".join(f"round({v}, {digits}) AS {k}" for k, v in cells.items())}, 'ok' AS status FROM ({BOUNDARY})"""


FACTORS = f"""{returns()},
fa AS (SELECT t, avg(ret) AS mkt_rf, avg(ret) FILTER (e < 5) - avg(ret) FILTER (e >= 20) AS smb, avg(ret) FILTER (e % 2 = 0) - avg(ret) FILTER (e % 2 = 1) AS hml, 0.0001::DOUBLE AS rf,
  CASE WHEN t >= 10 THEN avg(ret) FILTER (e % 3 = 0) - avg(ret) FILTER (e % 3 = 1) END AS mom FROM ret GROUP BY t)
SELECT date, mkt_rf, smb, hml, rf, mom FROM fa JOIN cal USING (t)"""


def alpha() -> str:
    """tau, n, alpha, se, lag, t and p of each series: normal equations solved a regressor a CTE, then the lagged scores."""
    x, last = ("1.0::DOUBLE", "mkt_rf", "smb", "hml", "mom", "r"), 5
    row = lambda f: ", ".join(f(i, j) for i in range(last) for j in range(last + 2))
    start = lambda i, j: f"{'1.0::DOUBLE' if i == 0 else '0.0::DOUBLE'} AS m_{i}_{j}" if j > last else f"sum({x[i]} * {x[j]}) AS m_{i}_{j}"
    steps = [f"g0 AS (SELECT tau, count(*) AS n, {row(start)}, {', '.join(f'sum({x[i]} * {x[i]}) AS d_{i}' for i in range(last))} FROM al GROUP BY tau)"]
    for k in range(last):
        pivot = f"CASE WHEN m_{k}_{k} > 1e-12 * d_{k} THEN 1 / m_{k}_{k} ELSE 0 END"
        less = lambda i, j, k=k: f"m_{i}_{j} * pv AS m_{i}_{j}" if i == k else f"m_{i}_{j} - m_{i}_{k} * pv * m_{k}_{j} AS m_{i}_{j}"
        steps.append(f"g{k + 1} AS (SELECT tau, n, {row(less)}, {', '.join(f'd_{i}' for i in range(last))} FROM (SELECT *, {pivot} AS pv FROM g{k}))")
    through = lambda c: " + ".join(f"{x[i]} * m_{i}_{c}" for i in range(last))
    return f"""WITH al AS (SELECT tau, date, r, {", ".join(x[1:last])}, row_number() OVER (PARTITION BY tau ORDER BY date) - 1 AS u
  FROM ({BASE} SELECT tau, date, r FROM dr JOIN cal USING (t) WHERE r IS NOT NULL) JOIN ({FACTORS}) USING (date) WHERE mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL),
ser AS (SELECT tau, u, r FROM al), {MOMENTS}, {BANDWIDTH}, {", ".join(steps)},
sc AS (SELECT tau, u, n, m_0_{last} AS alpha, bandwidth, ({through(last + 1)}) * (r - ({through(last)})) AS g FROM al JOIN g{last} USING (tau) JOIN (SELECT tau, bandwidth FROM bw) USING (tau)),
vv AS (SELECT tau, any_value(a.n) AS n, any_value(a.alpha) AS alpha, any_value(a.bandwidth) AS lag, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (a.bandwidth + 1.0::DOUBLE)) END * a.g * b.g) AS v
  FROM sc a CROSS JOIN LATERAL (SELECT unnest(range(0, least(a.bandwidth, a.n - 1) + 1)) AS k) JOIN sc b USING (tau) WHERE b.u = a.u + k GROUP BY tau)
SELECT tau, coalesce(n, 0) AS n, alpha, se, lag, alpha / nullif(se, 0) AS t, coalesce(1 - {normal_cdf_sql("alpha / nullif(se, 0)")}, 1) AS p
FROM (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in THRESHOLDS)}]) AS tau)
  LEFT JOIN (SELECT tau, n, CASE WHEN n >= 30 THEN alpha END AS alpha, CASE WHEN n >= 30 THEN sqrt(greatest(v, 0)) END AS se, CASE WHEN n >= 30 THEN lag END AS lag FROM vv) USING (tau)"""


FACTS = f"""SELECT tau, hs, qs, h.p AS hac_p, b.p AS boot_p, p_adjusted AS rw_p, gross, net, o.p_positive AS perm_p, o.status AS perm_status, o.permutation_informative AS informative, r.p AS row_p,
  al.alpha, al.p AS alpha_p FROM ({BASE}, {WINDOWS}, ws AS (SELECT tau, name, {sharpe("r")} AS s FROM dr JOIN win ON t >= lo AND t < hi GROUP BY 1, 2)
  SELECT tau, max(s) FILTER (name = 'holdout_30pct') AS hs, count(*) FILTER (name LIKE 'quarter%' AND s > 0) AS qs FROM ws GROUP BY tau)
JOIN ({HAC_P}) h USING (tau) JOIN (SELECT tau, {SUMMARY} FROM ({draws_of("moving_block")}) GROUP BY tau) b USING (tau) JOIN ({RW_P}) USING (tau)
JOIN ({BASE}, {WEIGHTS}, {TURNOVER} SELECT tau, {sharpe("r")} AS gross, coalesce((avg(r) - any_value(total) * 5 / 1e4) / nullif(stddev_samp(r), 0) * sqrt(52.0::DOUBLE), 0) AS net FROM dr JOIN tn USING (tau) GROUP BY tau) USING (tau)
JOIN (SELECT threshold AS tau, * EXCLUDE threshold FROM ({summary_of(f"{BASE}, {permuted('0')}", 12, OBSERVED)})) o USING (tau) JOIN ({ROWS}) r USING (tau) JOIN ({alpha()}) al USING (tau)"""
GATED = f"""SELECT *, hs > 0 AS c1, hac_p <= 0.05 AS c2, rw_p <= 0.05 AS c3, informative AND perm_p IS NOT NULL AS c4, coalesce(informative AND perm_p <= 0.05, false) AS c5, coalesce(alpha > 0 AND alpha_p <= 0.05, false) AS c6, net > 0 AS c7, qs >= 3 AS c8 FROM ({FACTS})"""
LABELLED = f"""SELECT *, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8 AS every, c1 AND c2 AND c3 AND (NOT c4 OR c5) AND c6 AND c7 AND c8 AS applicable,
  greatest(hac_p, rw_p, CASE WHEN informative THEN perm_p END) AS audit_p FROM ({GATED})"""
LABEL = """CASE WHEN every THEN 'Passes full evaluation' WHEN perm_status = 'degenerate' AND applicable THEN 'Permutation uninformative; remaining applicable checks pass'
  WHEN row_p <= 0.05 AND audit_p > 0.05 THEN 'Fails permutation check' WHEN audit_p > 0.05 AND net <= 0 THEN 'Fails statistical and cost checks' WHEN net <= 0 THEN 'Fails cost check'
  ELSE 'Does not pass full evaluation' END"""
SENSITIVITY = f"""SELECT tau, 'threshold ' || tau::VARCHAR AS candidate_id, alpha, 'ok' AS status, hac_p <= alpha AS p1, boot_p <= alpha AS p2, rw_p <= alpha AS p3, coalesce(informative AND perm_p <= alpha, false) AS p4,
  perm_status, informative, net > 0 AS p5, boot_p FROM ({FACTS}) CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.01]) AS alpha)
UNION ALL SELECT NULL, 'not loaded', alpha, 'failed', NULL, NULL, NULL, NULL, 'failed', false, NULL, NULL FROM (SELECT unnest([0.05::DOUBLE, 0.01]) AS alpha)"""
JUDGED = f"SELECT *, coalesce(p1 AND p2 AND p3 AND informative AND p4 AND p5, false) AS every, coalesce(p1 AND p2 AND p3 AND (p4 OR NOT informative) AND p5, false) AS applicable FROM ({SENSITIVITY})"

#: The walk's windows: ``ser`` has a series for each threshold and fold, keyed by ``tau`` as fold * 10 + threshold.
FOLDS = f"""{momentum()}, thr(tau) AS (VALUES {TAUS}),
dr AS (SELECT tau, t, date, avg(realised) FILTER (conf >= tau AND realised IS NOT NULL AND pred IS NOT NULL) AS r FROM pan JOIN cal USING (t) CROSS JOIN thr GROUP BY 1, 2, 3),
nd AS (SELECT max(t) + 1 AS n, floor((max(t) + 1) * 0.4::DOUBLE)::BIGINT AS s0 FROM dr),
fo AS (SELECT f, s0 + (f - 1) * ((n - s0) // 5) AS lo, least(s0 + f * ((n - s0) // 5), n) AS hi FROM nd CROSS JOIN (SELECT unnest(range(1, 6)) AS f) WHERE (n - s0) // 5 > 10),
name AS (SELECT f * 10 + tau AS wt, f, tau AS th, lo, hi FROM fo CROSS JOIN thr),
ser AS (SELECT wt AS tau, row_number() OVER (PARTITION BY wt ORDER BY t) - 1 AS u, r FROM dr JOIN name ON dr.tau = th AND t >= lo AND t < hi WHERE r IS NOT NULL)"""
WALKED = f"""SELECT wt, {SUMMARY} FROM (SELECT tau AS wt, draw, s FROM ({FOLDS}, {MOMENTS}, {BLOCKS}, nb AS (SELECT bl.*, floor(tau / 10)::BIGINT AS f FROM bl),
  {indices("moving_block", "nb", seed=f"{SEED - 1} + f")} SELECT tau, draw, {sharpe("r")} AS s FROM ix JOIN ser USING (tau, u) GROUP BY 1, 2)) GROUP BY wt"""



def menu_sql(digits: int) -> str:
    """The menu's inference with Holm's and the joint test's corrections."""
    return f"""WITH base AS (SELECT tau, sharpe, se, ci_lo, ci_hi, n_eff, b, p, n FROM ({POINTS}) JOIN (SELECT tau, {SUMMARY} FROM ({draws_of("moving_block")}) GROUP BY tau) USING (tau)),
names AS ({BASE} SELECT tau, any_value(np) AS np, avg(k) AS av FROM dr JOIN (SELECT tau, count(*) FILTER (conf >= tau) AS np FROM pan CROSS JOIN thr GROUP BY tau) USING (tau) GROUP BY tau),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, tau) AS rk, count(*) OVER () AS m FROM base),
holm AS (SELECT tau, 'holm' AS correction, max(least(1.0, p * (m - rk + 1))) OVER (ORDER BY p, tau) AS pa FROM ranked), every AS (SELECT * FROM holm UNION ALL SELECT tau, 'romano_wolf', p_adjusted FROM ({RW_P}))
SELECT tau AS threshold, round(sharpe, {digits}) AS sharpe, round(se, {digits}) AS se, round(ci_lo, {digits}) AS ci_lo, round(ci_hi, {digits}) AS ci_hi, round(n_eff, {digits}) AS n_eff, b AS block_size, round(p, {digits}) AS p_raw, n AS n_dates, np AS n_predictions,
  round(av, {digits}) AS avg_names, round(pa, {digits}) AS p_adjusted, p < 0.05 AS significant_raw, pa < 0.05 AS significant_adjusted, correction FROM base JOIN names USING (tau) JOIN every USING (tau)"""


def horizon(lookback: int) -> str:
    """One lookback's row of the horizon report."""
    base = dates(momentum(lookback=lookback), f"({PRIMARY}::DOUBLE)")
    both = "SELECT tau, 'hac' AS label, bandwidth FROM bw UNION ALL SELECT tau, 'iid', 0 FROM bw"
    return f"""SELECT '{lookback}' AS lookback, tau AS threshold, n::VARCHAR AS n_dates, round(names, 4) AS avg_names, round(gross, 4) AS gross_sharpe, round(net, 4) AS net_sharpe_5bps, round(total, 4) AS daily_turnover,
  round(pow(sh / nullif(se_rows, 0), 2), 4) AS uvif_sr, round(pow(sh / si, 2), 4) AS serial_uvif_sr, round(hp, 4) AS hac_p
FROM ({base}, {WEIGHTS}, {TURNOVER} SELECT tau, any_value(total) AS total, count(r) AS n, avg(k) FILTER (k > 0) AS names, {sharpe("r")} AS gross, coalesce((avg(r) - any_value(total) * 5 / 1e4) / nullif(stddev_samp(r), 0) * sqrt(52.0::DOUBLE), 0) AS net FROM dr JOIN tn USING (tau) GROUP BY tau)
JOIN ({base}, {MOMENTS}, {BANDWIDTH}, {hac(both, "tau, label")} SELECT tau, max(se) FILTER (label = 'iid') AS si, max(se) FILTER (label = 'hac') AS sh, max(p) FILTER (label = 'hac') AS hp FROM h GROUP BY tau) USING (tau)
JOIN ({base}, {HELD} SELECT tau, se_rows FROM hs) USING (tau)"""


def root_statistic() -> str:
    """tau and t of the unit-root test: products once for the choice of lags, once for the chosen ones, eliminated step by step."""
    def eliminated(name: str, products: str, upto: str) -> str:
        return f"""{name} AS (SELECT tau, 0 AS k, m FROM {products} UNION ALL
  SELECT tau, k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i > k + 1 THEN list_transform(m[i], lambda x, j: x - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) ELSE m[i] END)
  FROM {name} WHERE k < {upto})"""

    def products(name: str, rows: str) -> str:
        return f"""{name} AS (SELECT tau, list(line ORDER BY a) AS m FROM (SELECT tau, a, list(g ORDER BY b) AS line FROM (SELECT tau, a, b, sum(v[a] * v[b]) AS g
  FROM {rows} CROSS JOIN LATERAL (SELECT unnest(range(1, len(v) + 1)) AS a) CROSS JOIN LATERAL (SELECT unnest(range(1, len(v) + 1)) AS b) GROUP BY ALL) GROUP BY tau, a) GROUP BY tau)"""

    lagged = "list_transform(range(1, {0} + 1), lambda k: s[i - k + 1])"
    return f"""WITH RECURSIVE {BASE.removeprefix("WITH ")},
ra AS (SELECT tau, count(*) AS n, list(r ORDER BY u) AS r FROM ser GROUP BY tau HAVING count(*) >= 30),
sa AS (SELECT *, list_transform(range(1, n), lambda i: r[i + 1] - r[i]) AS s, least(ceil(12 * pow(n / 100.0::DOUBLE, 0.25)), n // 2 - 2)::BIGINT AS most FROM ra),
v1 AS (SELECT tau, list_concat([1.0::DOUBLE, r[i + 1]], {lagged.format("most")}, [s[i + 1]]) AS v FROM sa CROSS JOIN LATERAL (SELECT unnest(range(most, n - 1)) AS i)),
{products("p1", "v1")}, {eliminated("e1", "p1", "len(m) - 1")},
ai AS (SELECT tau, k - 2 AS lags, (n - 1 - most) * (ln(2 * pi() * m[len(m)][len(m)] / (n - 1 - most)) + 1) + 2 * k AS aic FROM e1 JOIN sa USING (tau) WHERE k >= 2),
ch AS (SELECT tau, arg_min(lags, aic) AS lags FROM ai GROUP BY tau),
v2 AS (SELECT tau, list_concat([1.0::DOUBLE], {lagged.format("lags")}, [r[i + 1], s[i + 1]]) AS v FROM sa JOIN ch USING (tau) CROSS JOIN LATERAL (SELECT unnest(range(lags, n - 1)) AS i)),
{products("p2", "v2")}, {eliminated("e2", "p2", "len(m) - 2")}
SELECT tau, n, r, m[-1][-2] / m[-2][-2] / sqrt((m[-1][-1] - m[-1][-2] * m[-1][-2] / m[-2][-2]) / (n - 1 - lags - (lags + 2)) / m[-2][-2]) AS t
FROM e2 JOIN sa USING (tau) JOIN ch USING (tau) WHERE k = len(m) - 2"""


def stationarity_sql() -> str:
    """The unit-root and stationarity tests and the rolling extremes."""
    power = lambda powers: " + ".join(f"({c}) * pow(t, {i})" for i, c in enumerate(powers))
    root = f"CASE WHEN t > {ROOT_MOST} THEN 1.0 WHEN t < {ROOT_LEAST} THEN 0.0 ELSE {normal_cdf_sql('inside')} END"
    steps = zip(LEVEL_CRITICAL, LEVEL_CRITICAL[1:], LEVEL_ODDS, LEVEL_ODDS[1:], strict=False)
    level = f"CASE WHEN level <= {LEVEL_CRITICAL[0]} THEN {LEVEL_ODDS[0]} " + " ".join(f"WHEN level <= {h} THEN {a} + ({b} - {a}) * (level - {low}) / ({h} - {low})" for low, h, a, b in steps) + f" ELSE {LEVEL_ODDS[-1]} END"
    product = "list_sum(list_transform(range(k + 1, n + 1), lambda i: x[i] * x[i - k]))"
    each = lambda upto, what: f"coalesce(list_sum(list_transform(range(1, {upto} + 1), lambda k: {what})), 0)"
    rolling = oracle_rolling()
    return f"""WITH rt AS ({root_statistic()}),
xa AS (SELECT *, CASE WHEN t <= {ROOT_SWITCH} THEN {power(ROOT_SMALL)} ELSE {power(ROOT_LARGE)} END AS inside, list_transform(r, lambda v: v - list_avg(r)) AS x FROM rt),
kp AS (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS xx, floor(pow(n::DOUBLE, 2 / 9.0::DOUBLE))::BIGINT AS first FROM xa),
k2 AS (SELECT *, xx / n + {each("first", f"{product} / (n / 2.0::DOUBLE)")} AS s0, {each("first", f"k * {product} / (n / 2.0::DOUBLE)")} AS s1 FROM kp),
k3 AS (SELECT *, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3.0::DOUBLE) * pow(n::DOUBLE, 1 / 3.0::DOUBLE)), n - 1)::BIGINT AS lags FROM k2),
k4 AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: pow(list_sum(x[1:i]), 2))) / n / n / ((xx + 2 * {each("lags", f"(1 - k / (lags + 1.0::DOUBLE)) * {product}")}) / n) AS level FROM k3)
SELECT tau AS threshold, n, round({root}, 5) AS adf_p, round({level}, 5) AS kpss_p, round(lo, 5) AS rolling_sr_min, round(hi, 5) AS rolling_sr_max FROM k4 LEFT JOIN ({rolling}) USING (tau)"""


def oracle_rolling() -> str:
    """tau and the extremes of the rolling Sharpe ratio."""
    return f"""{BASE}, nn AS (SELECT tau, least(252, greatest(30, count(*) // 5)) AS w FROM ser GROUP BY tau),
roll AS (SELECT a.tau, a.u, any_value(w) AS w, coalesce(avg(b.r) / nullif(stddev_samp(b.r), 0) * sqrt(52.0::DOUBLE), 0) AS s
  FROM ser a JOIN nn USING (tau) JOIN ser b ON b.tau = a.tau AND b.u BETWEEN a.u - w + 1 AND a.u WHERE a.u >= w - 1 GROUP BY 1, 2)
SELECT tau, any_value(w) AS w, min(s) AS lo, max(s) AS hi FROM roll GROUP BY tau"""


def oracle() -> dict[str, str]:
    """Name -> SQL."""
    hac_auto = f"{BASE}, {MOMENTS}, {BANDWIDTH}, {hac(AUTO)}"
    mean_of = lambda w, where="true": f"sum({w} * realised) FILTER (conf >= 0.5 AND {where}) / nullif(sum({w}) FILTER (conf >= 0.5 AND {where}), 0)"
    static = f"""{returns()}, scored AS (SELECT t, e, (2 * e - (count(*) OVER (PARTITION BY t) - 1))::DOUBLE AS pred, lead(ret) OVER (PARTITION BY e ORDER BY t) AS nxt FROM ret){RANKED}"""
    star = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / 5) + EULER_GAMMA * normal_quantile(1 - 1 / (5 * 2.718281828459045))
    shown = lambda m: f"SELECT tau AS threshold, '{m}' AS method, draw, round(s, 5) AS sharpe FROM ({draws_of(m)})"
    turn = lambda w, base=BASE: f"{base}, {w}, {TURNOVER} SELECT tau AS threshold, round(total, 6) AS daily_turnover, round(rescale, 6) AS turnover_rescale, round(rest, 6) AS turnover_entry_exit_flip, pairs AS n_turnover_pairs FROM tn"
    tiers = ", ".join(f"('{a}', {v}::DOUBLE, {s}::DOUBLE, {b}::DOUBLE)" for a, v, s, b in TIERS)
    found = {
        "threshold_sharpe": threshold_table(BASE, 52.0),
        "threshold_sharpe_monthly": threshold_table(dates(momentum(MONTH_VALUES, 3, 1)), 12.0),
        "threshold_sharpe_daily": threshold_table(dates(momentum(DAY_VALUES, 2, 0)), 252.0),
        "streamed_sharpe_daily": threshold_table(dates(momentum(DAY_VALUES, 2, 0)), 252.0),
        "streamed_turnover_daily": turn(WEIGHTS, dates(momentum(DAY_VALUES, 2, 0))),
        "streamed_sessions": """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
x AS (SELECT user_id, s, count(*) AS n, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, sum(value::DECIMAL(18,4)) AS v FROM g GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max((epoch_us(b) - epoch_us(a)) // 60000000) AS longest_minutes, round(sum(v::DOUBLE::DECIMAL(18,4))::DOUBLE, 4) AS value FROM x GROUP BY 1""",
        "dense_returns": f"{returns()} SELECT t AS t_idx, e AS e_idx, round(ret, 6) AS ret FROM ret",
        "tail_returns": f"{returns()} SELECT t AS t_idx, e AS e_idx, round(ret, 6) AS ret FROM ret WHERE t > (SELECT max(t) FROM ret) - 20",
        "strategy_panel": f"{momentum()} SELECT t AS t_idx, e AS e_idx, round(pred, 6) AS pred, round(realised, 6) AS realised, round(conf, 6) AS conf FROM pan",
        "static_rank_panel": f"""{static} SELECT tau AS threshold, t AS t_idx,
  round(0.5 * avg(realised) FILTER (conf >= tau AND pred > 0) + 0.5 * avg(realised) FILTER (conf >= tau AND pred < 0), 6) AS ret
  FROM pan CROSS JOIN (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) x(tau) GROUP BY 1, 2""",
        "constant_long_panel": f"{returns()} SELECT t AS t_idx, round(avg(ret), 6) AS ret, count(ret) AS n_sel FROM ret GROUP BY t",
        "weighted_date_returns": f"""{momentum()} SELECT 'equal' AS weighting, 'as_selected' AS exposure, t AS t_idx, round({mean_of("1")}, 6) AS ret FROM pan GROUP BY t
  UNION ALL SELECT 'confidence', 'as_selected', t, round({mean_of("conf")}, 6) FROM pan GROUP BY t
  UNION ALL SELECT 'signal_abs', 'as_selected', t, round({mean_of("abs(pred)")}, 6) FROM pan GROUP BY t
  UNION ALL SELECT 'equal', 'dollar_neutral', t, round(0.5 * {mean_of("1", "pred > 0")} + 0.5 * {mean_of("1", "pred < 0")}, 6) FROM pan GROUP BY t""",
        "selected_counts": f"""{BASE} SELECT tau AS threshold, count(*) AS n_dates, count(*) FILTER (k > 0) AS n_dates_selected, sum(k)::BIGINT AS n_predictions,
  round(avg(k) FILTER (k > 0), 6) AS avg_names, coalesce(min(k) FILTER (k > 0), 0) AS min_names, round(quantile_cont(k, 0.25) FILTER (k > 0), 6) AS p25_names,
  round(quantile_cont(k, 0.5) FILTER (k > 0), 6) AS median_names, round(quantile_cont(k, 0.75) FILTER (k > 0), 6) AS p75_names, coalesce(max(k) FILTER (k > 0), 0) AS max_names FROM dr GROUP BY tau""",
        "autocorrelation": f"{BASE}, {MOMENTS}, {acf(20)} SELECT tau AS threshold, k, round(rho, 6) AS rho FROM rho",
        "effective_size": f"""{BASE}, {MOMENTS}, {acf(50)},
low AS (SELECT *, min(rho) OVER (PARTITION BY tau ORDER BY k) AS lo FROM rho WHERE k <= greatest(1, n // 3))
SELECT tau AS threshold, any_value(n) AS n, round(greatest(1.0, any_value(n) / (1 + 2 * coalesce(sum(rho) FILTER (k > 0 AND lo >= 0), 0))), 4) AS n_eff FROM low GROUP BY tau""",
        "hac_sharpe": f"""{hac_auto} SELECT tau AS threshold, n, round(sharpe, 5) AS sharpe, round(se, 5) AS se, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi, round(z, 5) AS z_statistic,
  round(p, 5) AS positive_p_value, round(2 * least(p, 1 - p), 5) AS two_sided_p_value, round(mu, 5) AS mean_return, round(sqrt(greatest(s11, 0) / n), 5) AS mean_return_se, bandwidth FROM h""",
        "prewhitened_hac": f"""{BASE}, {MOMENTS}, {PREWHITE} SELECT tau AS threshold, n, round(sharpe, 4) AS sharpe, round(se, 4) AS se, round(z, 4) AS z_statistic, round(p, 4) AS positive_p_value, bandwidth FROM h""",
        "sharpe_inflation": f"""{hac_auto}, {HELD} SELECT tau AS threshold, round(se, 5) AS se_dates, round(se_rows, 5) AS se_rows, round(pow(se / nullif(se_rows, 0), 2), 4) AS uvif_sr FROM h JOIN hs USING (tau)""",
        "bandwidth_sweep": f"""{BASE}, {MOMENTS}, {BANDWIDTH},
{hac("SELECT tau, 'auto' AS label, bandwidth FROM bw UNION ALL SELECT tau, l::VARCHAR, l FROM m CROSS JOIN (SELECT unnest([0, 1, 5, 10, 21, 63, 126]) AS l)", "tau, label")}
SELECT tau AS threshold, label AS lag_label, bandwidth AS used_bandwidth, round(sharpe, 5) AS sharpe, round(se, 5) AS se, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi, round(p, 5) AS positive_p_value FROM h""",
        "sharpe_effective_size": f"""{BASE}, {MOMENTS}, {BANDWIDTH}, {hac("SELECT tau, 'hac' AS label, bandwidth FROM bw UNION ALL SELECT tau, 'iid', 0 FROM bw", "tau, label")},
b AS (SELECT tau, any_value(n) AS n, max(se) FILTER (label = 'iid') AS si, max(se) FILTER (label = 'hac') AS sh, max(bandwidth) FILTER (label = 'hac') AS bw FROM h GROUP BY tau)
SELECT tau AS threshold, round(greatest(1.0, least(n::DOUBLE, n * pow(si / sh, 2))), 4) AS n_eff_sr, round(si, 4) AS se_iid_delta, round(sh, 4) AS se_hac_delta, round(sh / si, 4) AS se_inflation, bw AS hac_bandwidth FROM b""",
        "block_lengths": f"{BASE}, {MOMENTS}, {BLOCKS} SELECT tau AS threshold, n, b AS block_size FROM bl",
        "rolling_sharpe": f"SELECT tau AS threshold, w AS rolling_window, round(lo, 4) AS rolling_sr_min, round(hi, 4) AS rolling_sr_max FROM ({oracle_rolling()})",
        "stationarity": stationarity_sql(),
        "bootstrap_iid": shown("iid"),
        "bootstrap_moving_block": shown("moving_block"),
        "bootstrap_stationary": shown("stationary"),
        "bootstrap_summary": f"""SELECT tau AS threshold, 'moving_block' AS method, round(se, 5) AS se, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi, round(p, 5) AS p_positive
FROM (SELECT tau, {SUMMARY} FROM ({draws_of("moving_block")}) GROUP BY tau)""",
        "entity_bootstrap": f"SELECT tau AS threshold, 'cluster_entity' AS method, draw, round(s, 5) AS sharpe FROM ({ENTITY_DRAWS})",
        "romano_wolf": f"{BASE}, {MENU}, {ROMANO} SELECT tau AS threshold, round(t_stat, 5) AS t_stat, round(p_raw, 5) AS p_raw, round(p_adjusted, 5) AS p_adjusted, b AS block_size FROM rw, bl",
        "white_reality_check": f"""{BASE}, {MENU}, best AS (SELECT max(x) AS o FROM (SELECT avg(r) AS x FROM rows GROUP BY tau)),
hi AS (SELECT draw, max(x) AS top FROM (SELECT draw, tau, avg(x) AS x FROM ix JOIN rows USING (u) GROUP BY 1, 2) GROUP BY draw)
SELECT round(any_value(o), 6) AS observed_max_mean, round((1 + count(*) FILTER (top >= o)) / (1 + count(*))::DOUBLE, 6) AS p_value, any_value(b) AS block_size FROM hi, best, bl""",
        "corrections": f"""{hac_auto}, pv AS (SELECT tau, round(p, 6) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p, 6), tau) AS rk FROM h),
q AS (SELECT *, p * m / rk AS scaled, (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) z(i)) AS hm, least(1.0, avg((p > 0.5)::INT) OVER () / 0.5) AS pi0 FROM pv),
s AS (SELECT *, min(scaled) OVER (ORDER BY p DESC, tau DESC ROWS UNBOUNDED PRECEDING) AS lo, min(scaled * hm) OVER (ORDER BY p DESC, tau DESC ROWS UNBOUNDED PRECEDING) AS lby FROM q)
SELECT tau AS threshold, round(p, 5) AS p, round(least(1.0, p * m), 5) AS p_bonferroni, round(max(least(1.0, p * (m - rk + 1))) OVER (ORDER BY p, tau), 5) AS p_holm, round(least(1.0, lo), 5) AS p_bh,
  round(least(1.0, lby), 5) AS p_by, round(least(1.0, lo * pi0), 5) AS q_storey FROM s""",
        "deflated_sharpe": f"""{BASE}, sh AS (SELECT tau, count(*) AS n, skewness(r) AS sk, kurtosis(r) + 3 AS ku, {sharpe("r", 1.0)} AS sr FROM ser GROUP BY tau),
d AS (SELECT *, {star} / sqrt(n - 1.0::DOUBLE) AS st, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS sp FROM sh), z AS (SELECT *, (sr - st) * sqrt(n - 1.0::DOUBLE) / sqrt(sp) AS z FROM d)
SELECT tau AS threshold, round({normal_cdf_sql("z")}, 5) AS dsr, round(st * sqrt(52.0::DOUBLE), 5) AS sr_star, round(sk, 5) AS skew, round(ku, 5) AS kurtosis FROM z""",
        "permutation_draws": f"{BASE}, {permuted('0')} SELECT tau AS threshold, perm, {SEED}::BIGINT AS seed, round(s, 5) AS sharpe FROM nulls",
        "grouped_permutation": summary_of(f"{BASE}, {permuted('e // 5')}", 5, OBSERVED),
        "signal_permutation": summary_of(f"{BASE}, {permuted('0', 'nxt AS raw, pred, c AS conf', 'conf')}", 5, OBSERVED),
        "turnover": turn(WEIGHTS),
        "turnover_neutral": turn(NEUTRAL),
        "cost_sensitivity": f"""{BASE}, {WEIGHTS}, {TURNOVER}, sx AS (SELECT tau, avg(r) AS mean, stddev_samp(r) AS sd, {sharpe("r")} AS gross FROM dr GROUP BY tau)
SELECT tau AS threshold, bps AS cost_bps_per_rebalance, round(total, 4) AS daily_turnover, round(rescale, 4) AS turnover_rescale, round(rest, 4) AS turnover_entry_exit_flip, round(gross, 4) AS gross_sharpe,
  round(coalesce(CASE WHEN sd > 0 THEN (mean - total * bps / 1e4) / sd * sqrt(52.0::DOUBLE) END, 0), 4) AS net_sharpe, round(total * bps / 1e4 * 52, 4) AS annual_cost_drag, round(mean * 1e4 / nullif(total, 0), 4) AS break_even_cost_bps
FROM sx JOIN tn USING (tau) CROSS JOIN (SELECT unnest([0, 1, 5, 10, 25]) AS bps)""",
        "holdout_windows": f"""{BASE}, {WINDOWS} SELECT tau AS threshold, name AS "window", lo AS start_idx, hi AS end_idx, round({sharpe("r")}, 5) AS sharpe, count(r) AS n FROM dr JOIN win ON t >= lo AND t < hi GROUP BY 1, 2, 3, 4""",
        "nested_selection": f"""{BASE}, nd AS (SELECT max(t) + 1 AS n FROM dr),
fo AS (SELECT f, te, least(te + sz, n) AS xe, floor(te * 0.7::DOUBLE)::BIGINT AS i FROM (SELECT n, f, greatest(1, (n - n // 3) // 5) AS sz, n // 3 + (f - 1) * greatest(1, (n - n // 3) // 5) AS te FROM nd CROSS JOIN (SELECT unnest(range(1, 6)) AS f)) WHERE te < n),
sc AS (SELECT tau, f, te, xe, {sharpe("CASE WHEN t >= i AND t < te THEN r END")} AS s, {sharpe("CASE WHEN t < te THEN r END")} AS ins, {sharpe("CASE WHEN t >= te AND t < xe THEN r END")} AS o, count(CASE WHEN t >= te AND t < xe THEN r END) AS k FROM dr CROSS JOIN fo GROUP BY 1, 2, 3, 4),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY f ORDER BY s DESC, tau) = 1), day AS (SELECT t, strftime(date, '%Y-%m-%d') AS d FROM cal)
SELECT f AS fold, d0.d AS train_start, d1.d AS train_end, d2.d AS test_start, d3.d AS test_end, tau AS selected_threshold, round(s, 5) AS inner_val_sharpe, round(ins, 5) AS is_sharpe, round(o, 5) AS oos_sharpe, k AS oos_n_valid
FROM be JOIN day d0 ON d0.t = 0 JOIN day d1 ON d1.t = te - 1 JOIN day d2 ON d2.t = te JOIN day d3 ON d3.t = xe - 1""",
        "walk_forward": f"""WITH st AS ({FOLDS}, day AS (SELECT t, strftime(date, '%Y-%m-%d') AS d FROM cal)
  SELECT wt, th, f, lo, hi, any_value(d0.d) AS d0, any_value(d1.d) AS d1, any_value(d2.d) AS d2, any_value(d3.d) AS d3, {sharpe("CASE WHEN dr.t < lo THEN r END")} AS ins, count(CASE WHEN dr.t >= lo AND dr.t < hi THEN r END) AS n,
    avg(CASE WHEN dr.t >= lo AND dr.t < hi THEN r END) AS mean, stddev_samp(CASE WHEN dr.t >= lo AND dr.t < hi THEN r END) AS sd
  FROM dr JOIN name ON dr.tau = th JOIN day d0 ON d0.t = 0 JOIN day d1 ON d1.t = lo - 1 JOIN day d2 ON d2.t = lo JOIN day d3 ON d3.t = hi - 1 GROUP BY 1, 2, 3, 4, 5 HAVING count(CASE WHEN dr.t >= lo AND dr.t < hi THEN r END) >= 10),
mv AS ({BASE}, {WEIGHTS}, {TURNOVER} SELECT tau, t, total FROM pd WHERE active)
SELECT th AS threshold, f AS fold, d0 AS train_start, d1 AS train_end, d2 AS test_start, d3 AS test_end, lo AS train_days, hi - lo AS test_days, round(ins, 4) AS is_sharpe, round(coalesce(mean / nullif(sd, 0) * sqrt(52.0::DOUBLE), 0), 4) AS oos_sharpe_gross,
  round(mean * 52, 4) AS oos_ann_ret_gross, round(sd * sqrt(52.0::DOUBLE), 4) AS oos_ann_vol, round(ci_lo, 4) AS oos_ci_lo, round(ci_hi, 4) AS oos_ci_hi, round(p, 4) AS oos_p_value, round(n_eff, 4) AS oos_n_effective, round(nw, 4) AS nw_se_daily, round(tn, 4) AS daily_turnover,
  {", ".join(f"round(coalesce((mean - tn * {round_trip(*c)} / 1e4) / nullif(sd, 0) * sqrt(52.0::DOUBLE), 0), 4) AS oos_sharpe_net_{round_trip(*c):.0f}bps, round((mean - tn * {round_trip(*c)} / 1e4) * 52, 4) AS oos_ann_ret_net_{round_trip(*c):.0f}bps" for c in COSTS)}
FROM st JOIN (SELECT wt, coalesce(avg(total), 0) AS tn FROM st LEFT JOIN mv ON mv.tau = th AND t > lo AND t < hi GROUP BY wt) USING (wt) JOIN ({WALKED}) USING (wt)
JOIN (SELECT tau AS wt, n_eff FROM ({FOLDS}, {MOMENTS}, {acf(50)}, {LOW} SELECT * FROM ef)) USING (wt)
JOIN (SELECT tau AS wt, sqrt(greatest(s11, 0) / n) AS nw FROM ({FOLDS}, {MOMENTS}, {BANDWIDTH}, {hac(AUTO)} SELECT * FROM h)) USING (wt)""",
        "capacity": f"""{momentum()}, thr(tau) AS (VALUES {TAUS}), po AS (SELECT tau, t, e, coalesce(conf >= tau, false)::INT AS held, CASE WHEN conf >= tau THEN sign(pred) ELSE 0 END AS p FROM pan CROSS JOIN thr),
ch AS (SELECT tau, t, sum(held) AS held, sum(abs(p - old)) AS moved FROM (SELECT *, lag(p) OVER (PARTITION BY tau, e ORDER BY t) AS old FROM po) GROUP BY 1, 2),
ba AS (SELECT tau, avg(held) AS pos, coalesce(avg(moved / greatest(held, 1)) FILTER (t > 0), 1.0) AS tn FROM ch GROUP BY tau),
ti(tier, adv, vol, sp) AS (VALUES {tiers}),
rt AS (SELECT *, a * 1e6 / greatest(pos, 1.0) / adv AS part FROM ba CROSS JOIN ti CROSS JOIN (SELECT unnest({list(AUM_MM)}) AS a)), im AS (SELECT *, vol * sqrt(part) * 1e4 AS im FROM rt)
SELECT tau AS threshold, a AS aum_mm, tier AS liquidity_tier, round(pos, 5) AS positions, round(part, 5) AS participation_rate, round(im, 5) AS impact_bps, round(2 * (sp + im), 5) AS total_rt_cost_bps,
  round(tn, 5) AS daily_turnover, round(tn * 2 * (sp + im) / 1e4 * 252 * 100, 5) AS annual_cost_drag_pct, (im < 50 AND part < 0.05) AS viable FROM im""",
        "row_boundary": boundary(5),
        "row_naive": f"""SELECT tau AS threshold, n AS n_rows, round(ts, 5) AS row_t_stat, round(p, 5) AS row_p_positive, round(sr, 5) AS row_sharpe, round(se, 5) AS row_sharpe_se, round(sr - 1.96 * se, 5) AS row_ci_lo, round(sr + 1.96 * se, 5) AS row_ci_hi FROM ({ROWS})""",
        "candidate_gates": f"""SELECT tau AS threshold, round(hs, 5) AS holdout_sharpe, qs AS positive_quarters, round(hac_p, 5) AS hac_p, round(rw_p, 5) AS romano_wolf_p, round(perm_p, 5) AS permutation_p, perm_status AS permutation_status,
  round(row_p, 5) AS row_p, round(net, 5) AS net_sharpe_5bps, c1 AS passes_holdout_positive, c2 AS passes_hac, c3 AS passes_romano_wolf, c4 AS passes_informative, c5 AS passes_permutation, c6 AS passes_alpha, c7 AS passes_net_5bps,
  c8 AS passes_quarters, every AS passes_all, applicable AS passes_applicable, round(audit_p, 5) AS audit_p, {LABEL} AS status_label FROM ({LABELLED})""",
        "gate_sensitivity": f"""SELECT candidate_id, alpha, status, p1 AS passes_hac, p2 AS passes_bootstrap, p3 AS passes_romano_wolf, p4 AS passes_permutation, perm_status AS permutation_status, informative AS permutation_informative,
  p5 AS passes_net_5bps, every AS passes_all, applicable AS passes_applicable, round(boot_p, 5) AS bootstrap_p FROM ({JUDGED})""",
        "gate_counts": f"SELECT alpha, count(*) AS candidates, count(*) FILTER (every) AS n_full_passes, count(*) FILTER (applicable) AS n_applicable_passes FROM ({JUDGED}) GROUP BY alpha",
        "inference_methods": records(("iid", "moving_block", "stationary", "cluster_date", "cluster_entity")),
        "menu_table": menu_sql(5),
        "dependence_summary": f"""WITH mr AS ({returns(MONTH_VALUES)} SELECT t, e, ret FROM ret WHERE t > 0), nt AS (SELECT count(DISTINCT t) AS n FROM mr),
fu AS (SELECT e FROM mr, nt GROUP BY e, n HAVING count(ret) = n AND count(ret) >= 10),
pc AS (SELECT corr(a.ret, b.ret) AS c FROM mr a JOIN mr b ON a.t = b.t AND a.e < b.e WHERE a.e IN (SELECT e FROM fu) AND b.e IN (SELECT e FROM fu) GROUP BY a.e, b.e),
ser AS (SELECT 0.5::DOUBLE AS tau, row_number() OVER (ORDER BY t) - 1 AS u, avg(ret) AS r FROM mr GROUP BY t HAVING count(ret) > 0), {MOMENTS}, {acf(50)}, {LOW}
SELECT tau AS threshold, any_value(rho.n) AS n_nominal, round(any_value(n_eff), 5) AS n_effective, round(any_value(n_eff) / any_value(rho.n), 5) AS n_eff_ratio, round(any_value(rho.n) / any_value(n_eff), 5) AS inflation_ratio,
  {", ".join(f"round(coalesce(max(rho) FILTER (k = {k}), 0), 5) AS acf_lag{k}" for k in (1, 5, 10))}, round(coalesce((SELECT avg(c) FROM pc WHERE NOT isnan(c)), 0), 5) AS cross_sectional_corr FROM rho JOIN ef USING (tau) GROUP BY tau""",
        "pairwise_correlation": f"""{returns()}, pc AS (SELECT count(*) AS n, corr(a.ret, b.ret) AS c FROM ret a JOIN ret b ON a.t = b.t AND a.e < b.e WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.e, b.e)
SELECT round(avg(c) FILTER (NOT isnan(c)), 5) AS pairwise_corr FROM pc WHERE n >= 10""",
        "variance_inflation": f"""SELECT tau AS threshold, round(sei, 5) AS sei, round(sei * sei, 5) AS uvif_unclipped, round(CASE WHEN sei IS NOT NULL THEN greatest(1.0, sei * sei) END, 5) AS uvif_displayed, round(1 / nullif(sei * sei, 0), 5) AS erir_unclipped,
  round(CASE WHEN sei IS NOT NULL THEN 1 / greatest(1.0, sei * sei) END, 5) AS erir_displayed FROM (SELECT tau, {MOULTON} AS sei FROM ({RHO}))""",
        "order_size": f"""{BASE}, {WEIGHTS}, {TURNOVER}, mo AS (SELECT tau, coalesce({MOULTON}, 1) AS sei FROM ({RHO})),
sx AS (SELECT tau, avg(r) - 0.5 * any_value(sei) * stddev_samp(r) / sqrt(count(r)) AS edge FROM dr JOIN mo USING (tau) GROUP BY tau)
SELECT tau AS threshold, round(CASE WHEN edge > 0 THEN 1000.0 * pow(edge / (0.1 * total), 2) ELSE 0 END, 4) AS order_size FROM sx JOIN tn USING (tau)""",
        "direct_benchmark": f"""{dates(static)}, ends AS (SELECT t, max(ret) FILTER (e = (SELECT max(e) FROM ret)) - max(ret) FILTER (e = 0) AS d FROM ret GROUP BY t),
bo AS (SELECT tau, r, d, date FROM dr JOIN ends ON ends.t = dr.t + 1 JOIN cal ON cal.t = ends.t WHERE r IS NOT NULL AND d IS NOT NULL)
SELECT tau AS threshold, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS sample_start, strftime(max(date), '%Y-%m-%d') AS sample_end, round({sharpe("r")}, 5) AS panel_sharpe, round({sharpe("d")}, 5) AS direct_sharpe,
  round(abs({sharpe("r")} - {sharpe("d")}), 5) AS sharpe_abs_diff, round(avg(r), 5) AS panel_mean, round(avg(d), 5) AS direct_mean, round(quantile_cont(r / d, 0.5) FILTER (abs(d) > 1e-12), 5) AS median_scale FROM bo GROUP BY tau""",
        "block_returns": f"""{returns()}, kd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ret JOIN cal USING (t) WHERE ret IS NOT NULL)),
ke AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS j FROM (SELECT DISTINCT e FROM ret WHERE ret IS NOT NULL))
SELECT i AS t_idx, j AS e_idx, 'P' || lpad(e::VARCHAR, 2, '0') AS entity, strftime(date, '%Y-%m-%d') AS date, round(ret, 6) AS ret FROM kd CROSS JOIN ke JOIN cal USING (date) JOIN ret USING (t, e) WHERE i > (SELECT max(i) FROM kd) - 100""",
        "price_returns": f"""{returns(f"SELECT date, entity, round(value, 4) AS value FROM ({MONTH_VALUES}) WHERE entity < 5")}, kd AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM ret WHERE ret IS NOT NULL))
SELECT i AS t_idx, e AS e_idx, 'n' || entity::VARCHAR AS entity, round(ret, 6) AS ret FROM ret JOIN kd USING (t) JOIN ent USING (e) WHERE i > (SELECT max(i) FROM kd) - 40""",
        "price_notes": "SELECT 'n5' AS symbol, 'missing Date/Close columns' AS note",
        "factor_series": f"SELECT strftime(date, '%Y-%m-%d') AS date, 'Momentum All' AS entity, round(sum(value) FILTER (entity % 3 = 1) / 100, 4) AS ret FROM ({MONTH_VALUES}) GROUP BY date HAVING sum(value) FILTER (entity % 3 = 1) IS NOT NULL",
        "factor_table": f"SELECT strftime(date, '%Y-%m-%d') AS date, {', '.join(f'round({c}, 6) AS {c}' for c in ('mkt_rf', 'smb', 'hml', 'rf', 'mom'))} FROM ({FACTORS})",
        "factor_alpha": f"""SELECT tau AS threshold, n, round(alpha, 6) AS alpha_period, round(alpha * 52, 6) AS alpha_ann, round(se, 6) AS alpha_se_period, round(t, 6) AS t_alpha, round(p, 6) AS p_positive,
  lag AS hac_lag, 'ok' AS status FROM ({alpha()})""",
        "aligned_factors": f"""SELECT tau AS threshold, count(*) AS n, {", ".join(f"round(corr(r, {c}), 6) AS corr_{c}" for c in ("mkt_rf", "smb", "hml", "mom"))}
FROM ({BASE} SELECT tau, date, r FROM dr JOIN cal USING (t) WHERE r IS NOT NULL) JOIN ({FACTORS}) USING (date) WHERE mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL GROUP BY tau""",
        "report_holdout": f"""WITH ho AS ({BASE}, {WINDOWS} SELECT name, {sharpe("r")} AS s, count(r) AS n FROM dr JOIN win ON t >= lo AND t < hi WHERE tau = {PRIMARY} GROUP BY 1)
SELECT 'ship_week' AS candidate_id, w AS "window", round(s, 5) AS sharpe, n FROM (SELECT name AS w, s, n FROM ho WHERE name NOT LIKE 'quarter%'
  UNION ALL SELECT 'quarter_min', min(s), min_by(n, (s, name)) FROM ho WHERE name LIKE 'quarter%' UNION ALL SELECT 'quarter_max', max(s), max_by(n, (s, -right(name, 1)::INT)) FROM ho WHERE name LIKE 'quarter%')""",
        "report_costs": f"""{BASE}, {WEIGHTS}, {TURNOVER}, sx AS (SELECT tau, avg(r) AS mean, stddev_samp(r) AS sd, {sharpe("r")} AS gross FROM dr GROUP BY tau)
SELECT 'ship_week' AS candidate_id, bps AS cost_bps_per_rebalance, round(total, 4) AS daily_turnover, round(gross, 4) AS gross_sharpe,
  round(coalesce(CASE WHEN sd > 0 THEN (mean - total * bps / 1e4) / sd * sqrt(52.0::DOUBLE) END, 0), 4) AS net_sharpe, round(mean * 1e4 / nullif(total, 0), 4) AS break_even_cost_bps
FROM sx JOIN tn USING (tau) CROSS JOIN (SELECT unnest([0, 1, 5, 10, 25]) AS bps) WHERE tau = {PRIMARY}""",
        "report_inference": f"""SELECT 'ship_week' AS candidate_id, method, round(sharpe, 4) AS sharpe, round(se, 4) AS se, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, round(p, 4) AS p_positive, n FROM (
  SELECT tau, 'block' AS method, sharpe, se, ci_lo, ci_hi, p, n FROM ({POINTS}) JOIN (SELECT tau, {SUMMARY} FROM ({draws_of("moving_block")}) GROUP BY tau) USING (tau)
  UNION ALL SELECT tau, 'HAC', sharpe, se, ci_lo, ci_hi, p, n FROM ({hac_auto} SELECT * FROM h) UNION ALL SELECT tau, 'prewhite', sharpe, se, ci_lo, ci_hi, p, n FROM ({BASE}, {MOMENTS}, {PREWHITE} SELECT * FROM h)) WHERE tau = {PRIMARY}""",
        "report_robustness": f"""SELECT 'ship_week' AS candidate_id, diagnostic, round(sharpe, 4) AS sharpe, round(se, 4) AS se, round(p, 4) AS p_positive FROM (
  SELECT tau, 'HAC K=' || label AS diagnostic, sharpe, se, p FROM ({BASE}, {MOMENTS}, {BANDWIDTH}, {hac("SELECT tau, 'auto' AS label, bandwidth FROM bw UNION ALL SELECT tau, l::VARCHAR, l FROM m CROSS JOIN (SELECT unnest([21, 63]) AS l)", "tau, label")} SELECT * FROM h)
  UNION ALL SELECT tau, 'prewhite', sharpe, se, p FROM ({BASE}, {MOMENTS}, {PREWHITE} SELECT * FROM h)) WHERE tau = {PRIMARY}""",
        "report_comparator": f"""SELECT 'ship_week' AS candidate_id, round(row_p, 4) AS row_naive_p, round(i.p, 4) AS date_iid_p, round(hac_p, 4) AS date_hac_p, round(m.p, 4) AS moving_block_p, round(CASE WHEN sei IS NOT NULL THEN greatest(1.0, sei * sei) END, 4) AS uvif
FROM ({BOUNDARY}) JOIN (SELECT tau, {SUMMARY} FROM ({draws_of("iid")}) GROUP BY tau) i USING (tau) JOIN (SELECT tau, {SUMMARY} FROM ({draws_of("moving_block")}) GROUP BY tau) m USING (tau) WHERE tau = {PRIMARY}""",
        "report_boundary": f"SELECT 'ship_week' AS candidate_id, * REPLACE ('Available' AS status) FROM ({boundary(4)}) WHERE threshold = {PRIMARY}",
        "report_candidates": f"""SELECT candidate_id, 'Available' AS status, round(gross, 4) AS gross_sharpe, round(hac_p, 4) AS hac_p, round(j.boot_p, 4) AS bootstrap_p, round(rw_p, 4) AS romano_wolf_p,
  CASE WHEN f.perm_status = 'ok' THEN format('{{:.4f}}', perm_p) ELSE 'N/A' END AS permutation_p, round(net, 4) AS net_sharpe_5bps, every AS full_rule, applicable AS applicable_checks FROM ({FACTS}) f JOIN ({JUDGED}) j USING (tau) WHERE alpha = 0.05""",
        "report_status": f"""SELECT 'threshold ' || tau::VARCHAR AS candidate_id, round(gross, 4) AS gross_sharpe, j.every AS full_rule, {LABEL.replace("every", "f.every").replace("applicable AND", "f.applicable AND").replace("AND applicable", "AND f.applicable").replace("perm_status", "f.perm_status")} AS status_label
FROM ({LABELLED}) f JOIN ({JUDGED}) j USING (tau) WHERE alpha = 0.05""",
        "report_permutations": f"""SELECT 'ship_week' AS candidate_id, threshold, round(observed_sharpe, 4) AS observed_sharpe, round(null_mean, 4) AS null_mean, round(null_sd, 4) AS null_sd, CASE WHEN status = 'ok' THEN format('{{:.4f}}', p_positive) ELSE 'N/A' END AS p_positive,
  CASE WHEN status = 'ok' THEN 'Available' ELSE 'Permutation null degenerate' END AS status, n_perms FROM ({summary_of(f"{BASE}, {permuted('e // 5')}", 12, OBSERVED)})""",
        "report_thresholds": f"""SELECT 'ship_week' AS candidate_id, threshold, round(sharpe, 4) AS sharpe, round(p_raw, 4) AS p_raw, round(n_eff, 4) AS n_eff, round(avg_names, 4) AS avg_names,
  round(max(p_adjusted) FILTER (correction = 'holm'), 4) AS p_holm, round(max(p_adjusted) FILTER (correction = 'romano_wolf'), 4) AS p_romano_wolf, NULL::DOUBLE AS p_by, NULL::DOUBLE AS q_storey FROM ({menu_sql(12)}) GROUP BY ALL""",
        "report_horizons": " UNION ALL ".join(horizon(x) for x in (1, 4, 13)),
        "head_returns": f"{returns()} SELECT t AS t_idx, e AS e_idx, round(ret, 6) AS ret FROM ret WHERE t < 20",
        "active_span": f"{BASE} SELECT tau AS threshold, strftime(min(date), '%Y-%m-%d') AS sample_start, strftime(max(date), '%Y-%m-%d') AS sample_end FROM dr JOIN cal USING (t) WHERE r IS NOT NULL GROUP BY tau",
        "result_violations": f"""{BASE} SELECT 'dates' AS "table", 'missing ret' AS rule, count(*) AS "rows" FROM dr WHERE r IS NULL HAVING count(*) > 0 UNION ALL SELECT 'permutation', 'n_perms below 10000', {len(THRESHOLDS)}
UNION ALL SELECT unnest({list(TABLE_NAMES)}), 'missing candidate', 1""",
        "shared_months": f"""WITH s AS (SELECT DISTINCT date_trunc('month', date)::DATE AS d FROM ({WEEK_VALUES})), o AS (SELECT DISTINCT date AS d FROM ({MONTH_VALUES}))
SELECT strftime(d, '%Y-%m-%d') AS month, CASE WHEN d IN (SELECT d FROM o) THEN 'both' ELSE 'shipments' END AS found FROM s""",
        "placebo": f"""{returns()}, s0 AS (SELECT t, e, CASE WHEN count(ret) OVER w = 4 THEN product(1 + ret) OVER w - 1 END AS pred, lead(ret) OVER (PARTITION BY e ORDER BY t) AS nxt
  FROM ret WINDOW w AS (PARTITION BY e ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
pl AS (SELECT t, e, row_number() OVER (PARTITION BY t ORDER BY e) AS nth FROM s0 WHERE pred IS NOT NULL),
dl AS (SELECT t, pred, row_number() OVER (PARTITION BY t ORDER BY {counter_sql(SEED, "t", "e")}, e) AS nth FROM s0 WHERE pred IS NOT NULL),
scored AS (SELECT s0.t, s0.e, d.pred, s0.nxt FROM s0 LEFT JOIN (SELECT pl.t, e, pred FROM pl JOIN dl USING (t, nth)) d ON d.t = s0.t AND d.e = s0.e){RANKED},
thr(tau) AS (VALUES {TAUS}), dr AS (SELECT tau, t, avg(realised) FILTER (conf >= tau) AS r, count(*) FILTER (conf >= tau) AS k FROM pan CROSS JOIN thr GROUP BY 1, 2)
SELECT tau AS threshold, count(r) AS n_dates, round(avg(k) FILTER (k > 0), 6) AS avg_names, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round({sharpe("r")}, 6) AS sharpe FROM dr GROUP BY tau""",
        "unfinished_work": f"""SELECT entity::BIGINT AS entity, strftime(m, '%Y-%m-%d') AS month FROM (SELECT DISTINCT entity, date_trunc('month', date)::DATE AS m FROM ({WEEK_VALUES}) EXCEPT SELECT entity, date FROM ({MONTH_VALUES}))""",
        "uniform_counter": f"SELECT n_nationkey::BIGINT AS n_nationkey, {counter_sql(SEED, 'n_nationkey')} AS draw FROM nation",
    }
    # the same rows by other readers
    alike = {"piece_returns": "block_returns", "archive_returns": "block_returns", "workbook_series": "factor_series"}
    return found | {name: found[other] for name, other in alike.items()}
