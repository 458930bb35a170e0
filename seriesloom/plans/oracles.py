"""Plain SQL that recomputes the registered queries from the given tables."""

from __future__ import annotations

from itertools import combinations

from ..functions.permute import round_keys, shuffled_place_sql
from .inputs import PRECISION

EPS = "1e-9"


def total(x: str) -> str:
    """Sum that does not depend on the order of the rows."""
    return f"sum(({x})::DECIMAL(20,6))::DOUBLE"


def shown(c: str) -> str:
    """The precision in which results are shown."""
    steps = " ".join(f"WHEN abs({c}) < {bound:.0f} THEN round({c}, {decimals})" for bound, decimals in PRECISION)
    return f"(CASE {steps} ELSE round({c}, 0) END + 0.0)"


def tidied(sql: str, doubles: str, ctes: str = "") -> str:
    names = doubles.split()
    replaced = ", ".join(f"{shown(c)} AS {c}" for c in names)
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT * REPLACE ({replaced}) FROM ({sql})"


PANEL = f"""
panel AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
    {total('value')} / count(value) AS price, count(*)::DOUBLE AS load,
    {total('CASE WHEN user_id % 3 = 0 THEN value END')} AS wind,
    {total('CASE WHEN user_id % 3 = 1 THEN value END')} AS solar,
    max(value) - min(value) AS net_import,
    max(value) AS up_reserve, min(value) AS down_reserve,
    {total('value')} AS total_gen
  FROM events GROUP BY 1, 2)"""
DAILY = f"""
panel AS (
  SELECT 'orders' AS series_id, o_orderdate::TIMESTAMP AS ts,
    {total('o_totalprice')} / count(o_totalprice) AS price, count(*)::DOUBLE AS load
  FROM orders GROUP BY 2)"""
POSITIONS = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,
    count(*) OVER (PARTITION BY series_id) AS n FROM panel)"""
GRID = """
grid AS (
  SELECT b.series_id, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM panel GROUP BY 1) b)"""
W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


def prior(rows: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def ratio(a: str, b: str) -> str:
    return f"{a} / (nullif({b}, 0) + {EPS})"


def lagged(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER w"


def predictions(horizons: list[int], splits: int, spare: int = 1) -> str:
    """CTEs ending in ``pred``: the three baselines over the walk-forward folds."""
    values = ", ".join(f"({h})" for h in horizons)
    return f"""
{POSITIONS},
lagged AS (SELECT *, lag(price, 1) OVER w AS persistence, lag(price, 24) OVER w AS seasonal_naive,
  avg(price) OVER {prior(24)} AS recent FROM placed {W}),
tested AS (
  SELECT l.*, h.horizon, floor((pos - (n - horizon * {splits})) / horizon)::INTEGER AS fold
  FROM lagged l CROSS JOIN (VALUES {values}) h(horizon)
  WHERE n > horizon * ({splits} + {spare}) AND pos >= n - horizon * {splits}),
wide AS (
  SELECT t.*, s.recent AS mean24 FROM tested t JOIN lagged s
    ON s.series_id = t.series_id AND s.pos = t.n - t.horizon * ({splits} - t.fold)),
pred AS (
  SELECT series_id, horizon, fold, ts, m.model, price AS y,
    CASE m.model WHEN 'persistence' THEN persistence WHEN 'seasonal_naive' THEN seasonal_naive
      ELSE mean24 END AS yhat
  FROM wide CROSS JOIN (VALUES ('persistence'), ('seasonal_naive'), ('mean24')) m(model))"""


STRICT = f"""
avg(abs(y - yhat)) AS MAE, sqrt(avg((y - yhat) ** 2)) AS RMSE,
avg(abs(y - yhat) / greatest(abs(y), {EPS})) * 100 AS MAPE,
sqrt(avg((ln(1 + greatest(yhat, 0) + {EPS}) - ln(1 + greatest(y, 0) + {EPS})) ** 2)) AS RMSLE,
1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS R2"""
METRICS = "MAE RMSE MAPE RMSLE R2"
MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS.split())
E72 = f"{PANEL}, {predictions([72], 5)}"
E24_72 = f"{PANEL}, {predictions([24, 72], 5)}"

PEAKS = f"""
limits AS (
  SELECT series_id, 0.95::DOUBLE AS q, quantile_cont(y, 0.95) AS threshold FROM pred WHERE model = 'mean24' GROUP BY 1
  UNION ALL SELECT series_id, 0.92, quantile_cont(y, 0.92) FROM pred WHERE model = 'mean24' GROUP BY 1
  UNION ALL SELECT series_id, 0.89, quantile_cont(y, 0.89) FROM pred WHERE model = 'mean24' GROUP BY 1),
scored AS (
  SELECT series_id, model, q, threshold,
    count(*) FILTER (y >= threshold) AS n_peaks, count(*) FILTER (y < threshold) AS n_non,
    avg(abs(y - yhat)) FILTER (y >= threshold) AS MAE_peaks,
    avg(abs(y - yhat)) FILTER (y < threshold) AS MAE_nonpeaks,
    sum(CASE WHEN y >= threshold THEN 3 ELSE 1 END * abs(y - yhat))
      / sum(CASE WHEN y >= threshold THEN 3 ELSE 1 END) AS WMAE,
    count(*) FILTER (y >= threshold AND yhat >= threshold) AS hit,
    count(*) FILTER (yhat >= threshold) AS called
  FROM pred JOIN limits USING (series_id) GROUP BY ALL),
peaks AS (
  SELECT series_id, model, q, threshold, n_peaks, n_non, MAE_peaks, MAE_nonpeaks, WMAE,
    hit / nullif(called, 0) AS precision_peak, hit / nullif(n_peaks, 0) AS recall_peak,
    CASE WHEN hit > 0 THEN 2 * (hit / called) * (hit / n_peaks) / (hit / called + hit / n_peaks) END AS f1_peak
  FROM scored)"""


def _simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Simpson's rule on [0, upper]; ``f`` is written in the variable u."""
    g = f.replace("u", f"(({upper}) * k / {steps}.0)")
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({upper}) / {steps}.0 / 3 * list_sum([{weight} * {g} FOR k IN range(0, {steps + 1})]))"


NW_LAGS = "floor(4 * pow(count(*) / 100.0, 2.0 / 9.0))"


def dm(models: list[str], h: int = 1, lags: str = NW_LAGS, corrected: bool = True) -> str:
    """CTEs ending in ``tests``: all pairs of the wide forecasts in ``wide_models``."""
    factor = f"sqrt((n + 1 - 2 * {h} + {h} * ({h} - 1) / n) / n)" if corrected else "1"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in combinations(models, 2))
    p_norm = "greatest(0, 1 - 2 * 0.3989422804014327 * " + _simpson("exp(-u * u / 2)", "least(abs(dm), 9)") + ")"
    density = "pow(cos(u), n - 2)"
    norm = "(sqrt(pi()) / 2 * exp(lgamma((n - 1) / 2.0) - lgamma(n / 2.0)))"
    p_t = f"greatest(0, 1 - {_simpson(density, 'atan(abs(dm) / sqrt(n - 1))')} / {norm})"
    return f"""
pairs AS (SELECT * FROM (VALUES {pairs}) p(a, b)),
losses AS (SELECT * FROM (VALUES ('MAE'), ('MSE')) l(loss)),
err AS (SELECT series_id, ts, model, yhat, y - yhat AS e,
  row_number() OVER (PARTITION BY series_id, model ORDER BY ts) AS t FROM wide_models),
d AS (
  SELECT x.series_id, p.a, p.b, l.loss, x.t,
    CASE WHEN l.loss = 'MAE' THEN abs(x.e) - abs(z.e) ELSE x.e * x.e - z.e * z.e END AS d
  FROM err x JOIN pairs p ON x.model = p.a JOIN err z
    ON z.model = p.b AND z.series_id = x.series_id AND z.t = x.t CROSS JOIN losses l),
stats AS (
  SELECT series_id, a, b, loss, count(*) AS n, count(d) AS full_n, avg(d) AS mean_diff,
    ({lags})::INTEGER AS nw_lags
  FROM d GROUP BY ALL),
dc AS (SELECT d.series_id, d.a, d.b, d.loss, t, d - mean_diff AS dc, n, nw_lags
  FROM d JOIN stats s USING (series_id, a, b, loss)),
cov AS (
  SELECT x.series_id, x.a, x.b, x.loss, sum(CASE WHEN k.k = 0 THEN 1 ELSE 2 * (1 - k.k / (x.nw_lags + 1.0)) END
    * x.dc * z.dc) AS s
  FROM dc x CROSS JOIN range(0, 60) k(k) JOIN dc z
    ON z.series_id = x.series_id AND z.a = x.a AND z.b = x.b AND z.loss = x.loss AND z.t = x.t - k.k
  WHERE k.k <= x.nw_lags GROUP BY ALL),
raw AS (
  SELECT s.*, CASE WHEN full_n = n AND s > 0 THEN mean_diff / sqrt(s / n / n) END AS dm_raw
  FROM stats s JOIN cov USING (series_id, a, b, loss)),
corrected AS (SELECT *, dm_raw * {factor} AS dm FROM raw),
tests AS (
  SELECT series_id, a || ' vs ' || b AS pair, loss, CASE WHEN dm IS NOT NULL THEN n::DOUBLE END AS n,
    {h}::INTEGER AS h, CASE WHEN dm IS NOT NULL THEN nw_lags::DOUBLE END AS nw_lags, dm_raw, dm,
    CASE WHEN dm IS NOT NULL THEN {p_norm} END AS p_norm,
    {f"CASE WHEN dm IS NOT NULL THEN {p_t} END" if corrected else "NULL::DOUBLE"} AS p_t,
    CASE WHEN dm IS NOT NULL THEN mean_diff END AS mean_diff,
    CASE WHEN dm IS NULL THEN 'NA' WHEN mean_diff < 0 THEN a ELSE b END AS better
  FROM corrected)"""


def _phi(z: str) -> str:
    """Distribution function of the standard normal."""
    half = "0.3989422804014327 * " + _simpson("exp(-u * u / 2)", f"least(abs({z}), 9)")
    return f"greatest(0, 0.5 + sign({z}) * {half})"


PRIORITIES = f"""
panel AS (
  SELECT o_orderpriority AS series_id, o_orderdate::TIMESTAMP AS ts,
    {total('o_totalprice')} / count(o_totalprice) AS price
  FROM orders GROUP BY 1, 2)"""

#: Least squares of y on x1 and x2 from covariances (S11, S22, S12, S1y, S2y, Syy) and means.
COVARIANCES = """covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y,
  covar_pop(x2, y) AS s2y, covar_pop(y, y) AS syy, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS rows"""


def adf_sql(lags: int) -> str:
    """Dickey-Fuller regressions with a constant and no lag or one."""
    x2 = "lag(price) OVER w - lag(price, 2) OVER w"
    if lags == 0:
        fit = "s1y / s11 AS b, syy - s1y * s1y / s11 AS ssr, 1 / s11 AS inv"
    else:
        det = "(s11 * s22 - s12 * s12)"
        b1, b2 = f"((s22 * s1y - s12 * s2y) / {det})", f"((s11 * s2y - s12 * s1y) / {det})"
        fit = f"{b1} AS b, syy - {b1} * s1y - {b2} * s2y AS ssr, s22 / {det} AS inv"
    small, large = "2.1659 + 1.4412 * adf + 0.038269 * adf ** 2", "1.7339 + 0.93202 * adf - 0.12745 * adf ** 2 - 0.010368 * adf ** 3"
    return f"""
SELECT series_id, n, adf, CASE WHEN adf > 2.74 THEN 1 WHEN adf < -18.83 THEN 0 ELSE {_phi("z")} END AS adf_p,
  {lags}::INTEGER AS used_lag, rows AS nobs
FROM (SELECT *, CASE WHEN adf <= -1.61 THEN {small} ELSE {large} END AS z
  FROM (SELECT series_id, n, rows, b / sqrt(ssr * inv / (rows - {lags + 2})) AS adf
    FROM (SELECT *, {fit} FROM (
      SELECT series_id, any_value(n) AS n, {COVARIANCES}
      FROM (SELECT series_id, n, pos, lag(price) OVER w AS x1, {x2} AS x2, price - lag(price) OVER w AS y
        FROM placed {W}) WHERE pos > {lags} AND n >= 100 GROUP BY 1))))"""


def shuffled_sql(size: str, first: str, repeats: int = 10, seed: int = 42) -> str:
    """CTEs ``valid`` (placed rows of the window) and ``moved`` (its features by place and repeat), fitted as ``plane``."""
    moves = " UNION ALL ".join(
        f"SELECT series_id, {r} AS repeat, {shuffled_place_sql('place', 'size', round_keys(seed, r))} AS place, load, net_import FROM valid"
        for r in range(1, repeats + 1)
    )
    return f"""
windowed AS (SELECT *, {size} AS size, {first} AS first_ FROM placed),
plane AS (
  SELECT w1, w2, my - w1 * m1 - w2 * m2 AS w0 FROM (
    SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2
    FROM (SELECT {COVARIANCES} FROM (SELECT load AS x1, net_import AS x2, price AS y FROM fitted_rows)))),
valid AS (SELECT series_id, pos - first_ AS place, size, price, load, net_import FROM windowed WHERE pos >= first_),
moved AS (SELECT m.series_id, repeat, v.price, m.load AS load_, m.net_import AS net_import_, v.load, v.net_import
  FROM ({moves}) m JOIN valid v ON m.series_id = v.series_id AND m.place = v.place)"""


def importance_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    tests = " UNION ALL ".join(
        f"SELECT {key}'{c}' AS feature, repeat, avg(abs(price - (w0 + w1 * {a} + w2 * {b}))) AS e FROM moved, plane GROUP BY ALL"
        for c, a, b in (("load", "load_", "net_import"), ("net_import", "load", "net_import_"))
    )
    base = f"SELECT {key}avg(abs(price - (w0 + w1 * load + w2 * net_import))) AS base FROM valid, plane GROUP BY ALL"
    joined = f"JOIN ({base}) USING ({by})" if by else f"CROSS JOIN ({base})"
    return f"SELECT {key}feature, avg(e) - any_value(base) AS importance FROM ({tests}) {joined} GROUP BY {key}feature"


USERS = f"""
sums AS (SELECT event_type AS model, user_id, {total('value')} AS importance FROM events GROUP BY 1, 2),
lists AS (
  SELECT model, pos, user_id::VARCHAR AS feature, importance FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, user_id) AS pos FROM sums))"""
BASELINES = ["persistence", "seasonal_naive", "mean24"]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
WEIGHTS = f"""
errors AS (
  SELECT series_id AS model, {'round(avg(MAE), 6)'} AS e FROM (
    SELECT series_id, fold, avg(abs(y - yhat)) AS MAE FROM pred WHERE model = 'mean24'
    GROUP BY 1, 2) GROUP BY 1),
weights AS (
  SELECT l.model, CASE WHEN e IS NULL THEN 1.0 / count(*) OVER ()
    ELSE (1 / e) / sum(1 / e) OVER () END AS w
  FROM (SELECT DISTINCT model FROM lists) l LEFT JOIN errors USING (model))"""


def fusion(weights: str) -> str:
    return f"""
ranks AS (SELECT model, feature, pos AS rank FROM lists),
scores AS (
  SELECT feature, sum(top + 1 - rank)::BIGINT AS borda, sum(w * (top + 1 - rank)) AS wborda,
    sum(w / (60 + rank)) AS rrf, avg(rank) AS mean_rank, median(rank) AS median_rank,
    count(DISTINCT model) AS models_count, count(DISTINCT model) / any_value(models)::DOUBLE AS models_frac
  FROM ranks JOIN {weights} USING (model),
    (SELECT max(rank) AS top, count(DISTINCT model) AS models FROM ranks) GROUP BY 1),
normed AS (
  SELECT *, (borda - min(borda) OVER ()) / nullif(max(borda) OVER () - min(borda) OVER (), 0)::DOUBLE AS borda_norm,
    (wborda - min(wborda) OVER ()) / nullif(max(wborda) OVER () - min(wborda) OVER (), 0) AS wborda_norm,
    (rrf - min(rrf) OVER ()) / nullif(max(rrf) OVER () - min(rrf) OVER (), 0) AS rrf_norm FROM scores),
fused AS (SELECT *, (wborda_norm + rrf_norm) / 2 AS final_score FROM normed)"""


CALENDAR = """
hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month,
dayofyear(ts)::INTEGER AS day_of_year, (isodow(ts) >= 6)::INTEGER AS weekend,
sin(2 * pi() * hour(ts) / 24) AS sin24, cos(2 * pi() * hour(ts) / 24) AS cos24,
sin(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS sin168,
cos(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS cos168,
quarter(ts)::INTEGER AS quarter,
(month(ts) IN (12, 1, 2))::TINYINT AS season_winter, (month(ts) IN (3, 4, 5))::TINYINT AS season_spring,
(month(ts) IN (6, 7, 8))::TINYINT AS season_summer, (month(ts) IN (9, 10, 11))::TINYINT AS season_autumn"""
RATIOS = f"""
{ratio(lagged('wind'), lagged('load'))} AS wind_share, {ratio(lagged('solar'), lagged('load'))} AS solar_share,
{ratio(lagged('net_import'), lagged('load'))} AS import_share,
lag(up_reserve - down_reserve) OVER w AS sys_margin_MW,
{ratio('lag(up_reserve - down_reserve) OVER w', lagged('load'))} AS imbalance_ratio,
{lagged('price')} * ({ratio('lag(up_reserve - down_reserve) OVER w', lagged('load'))}) AS price_x_imbalance,
({lagged('wind')} + {lagged('solar')}) / (nullif({lagged('total_gen')}, 0) + {EPS}) AS renew_share,
{lagged('price')} * (({lagged('wind')} + {lagged('solar')}) / (nullif({lagged('total_gen')}, 0) + {EPS}))
  AS price_x_renew_share"""
RATIO_NAMES = (
    "wind_share solar_share import_share sys_margin_MW imbalance_ratio price_x_imbalance "
    "renew_share price_x_renew_share"
)
ROLLING = f"""
avg(price) OVER {prior(24)} AS price_roll24_mean, stddev_samp(price) OVER {prior(24)} AS price_roll24_std,
min(price) OVER {prior(24)} AS price_roll24_min, max(price) OVER {prior(24)} AS price_roll24_max"""
ROLLING_NAMES = "price_roll24_mean price_roll24_std price_roll24_min price_roll24_max"
VOLATILITY = f"""
coalesce(abs({lagged('price')} - {lagged('price', 2)}), 0) AS d_price_1h,
coalesce(abs({lagged('price')} - {lagged('price', 25)}), 0) AS d_price_24h,
coalesce(stddev_samp(price) OVER {prior(6)}, 0) AS std_6h,
coalesce(stddev_samp(price) OVER {prior(24)}, 0) AS std_24h"""
VOLATILITY_NAMES = "d_price_1h d_price_24h std_6h std_24h"
ENOUGH = f"count(load) OVER {prior(24)} >= 6"
DEMAND = f"""
{ratio(lagged('price'), lagged('load'))} AS price_over_load,
CASE WHEN {ENOUGH} THEN {lagged('price')} - ({lagged('load')} - median(load) OVER {prior(24)})
  / (mad(load) OVER {prior(24)} + {EPS}) END AS price_minus_norm_load"""
DEMAND_NAMES = "price_over_load price_minus_norm_load"
SHAPE = f"""
CASE WHEN count(price) OVER {prior(24)} >= 6 AND min(price) OVER {prior(24)} < max(price) OVER {prior(24)}
  THEN skewness(price) OVER {prior(24)} END AS skew_24h,
CASE WHEN count(price) OVER {prior(24)} >= 6 AND min(price) OVER {prior(24)} < max(price) OVER {prior(24)}
  THEN kurtosis(price) OVER {prior(24)} END AS kurt_24h"""
SHAPE_NAMES = "skew_24h kurt_24h"
ALL_FEATURES = f"{RATIOS}, {ROLLING}, {VOLATILITY}, {DEMAND}, {SHAPE}"
ALL_NAMES = f"{RATIO_NAMES} {ROLLING_NAMES} {VOLATILITY_NAMES} {DEMAND_NAMES} {SHAPE_NAMES}"


def family(select: str, names: str, where: str = "") -> str:
    return tidied(f"SELECT series_id, ts, {select} FROM panel {W} {where}", names, PANEL)


PRICED = """
priced AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net_price,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross_price, 1.0::DOUBLE AS unit,
    NULL::DOUBLE AS nothing FROM lineitem)"""
PRICED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "gross_price"]
CORRELATIONS = "corrs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS corr FROM priced"
    for (i, a), (j, b) in combinations(enumerate(PRICED_COLUMNS), 2)
) + ")"
PRUNED = """
ends AS (SELECT i AS c, corr FROM corrs UNION ALL SELECT j, corr FROM corrs),
means AS (SELECT c, (sum(corr) + 1) / (count(corr) + 1) AS m FROM ends GROUP BY 1),
groups AS (
  SELECT DISTINCT j AS col, j AS member, -1 AS place FROM corrs WHERE corr >= 0.9
  UNION ALL SELECT j, i, i FROM corrs WHERE corr >= 0.9),
condemned AS (
  SELECT DISTINCT arg_max(member, (m, -place)) AS c FROM groups JOIN means ON means.c = member
  WHERE member <> 1 GROUP BY col)"""


def filled(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS {c}"


def missing_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS missing_pct FROM filled"
        for c in columns
    )


def summary_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
        f"quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, "
        f"quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM lineitem"
        for c in columns
    )


KPSS = """
e AS (SELECT p.series_id, pos, n, price - avg(price) OVER (PARTITION BY series_id) AS e FROM placed p WHERE n >= 100),
acov AS (
  SELECT a.series_id, any_value(a.n) AS n, k.k AS k, sum(a.e * b.e) AS g
  FROM e a CROSS JOIN range(0, 40) k(k) JOIN e b ON b.series_id = a.series_id AND b.pos = a.pos - k.k
  GROUP BY a.series_id, k.k),
choice AS (
  SELECT series_id, n,
    sum(CASE WHEN k = 0 THEN g / n WHEN k <= floor(pow(n, 2.0 / 9.0)) THEN 2 * g / n ELSE 0 END) AS s0,
    sum(CASE WHEN k BETWEEN 1 AND floor(pow(n, 2.0 / 9.0)) THEN 2 * k * g / n ELSE 0 END) AS s1
  FROM acov GROUP BY ALL),
lagged_ AS (
  SELECT series_id, n, least(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3.0) * pow(n, 1.0 / 3.0)), n - 1)::INTEGER
    AS lags FROM choice),
lr AS (
  SELECT a.series_id, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1.0)) * g END) / any_value(l.n) AS s
  FROM acov a JOIN lagged_ l USING (series_id) WHERE k <= lags GROUP BY 1),
eta AS (
  SELECT series_id, sum(c * c) AS eta FROM (
    SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY pos) AS c FROM e) GROUP BY 1),
stat AS (
  SELECT series_id, l.n, lags, eta / l.n / l.n / s AS kpss
  FROM lagged_ l JOIN lr USING (series_id) JOIN eta USING (series_id))"""
KPSS_P = """CASE WHEN kpss <= 0.347 THEN 0.1
  WHEN kpss < 0.463 THEN 0.1 + (kpss - 0.347) * (0.05 - 0.1) / (0.463 - 0.347)
  WHEN kpss < 0.574 THEN 0.05 + (kpss - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
  WHEN kpss < 0.739 THEN 0.025 + (kpss - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END"""

TWO_TABLES = """
first_ AS (SELECT series_id, ts AS timestamp, max(y) AS Observed,
  max(yhat) FILTER (model = 'persistence') AS persistence, max(yhat) FILTER (model = 'mean24') AS mean24
  FROM pred WHERE horizon = 24 GROUP BY 1, 2),
second_ AS (SELECT series_id, ts AS timestamp, max(y) AS Observed,
  max(yhat) FILTER (model = 'seasonal_naive') AS seasonal_naive, max(yhat) FILTER (model = 'mean24') AS mean24
  FROM pred WHERE horizon = 72 GROUP BY 1, 2)"""


def rankings_sql() -> str:
    fold = f"SELECT series_id, model, horizon, fold, {STRICT} FROM pred GROUP BY ALL"
    return f"SELECT series_id, model, horizon, {MEANS} FROM ({fold}) GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    gaps = "SELECT * REPLACE (CASE WHEN hour(ts) % 7 <> 0 THEN yhat - 20 END AS yhat) FROM pred"
    holes = "SELECT * REPLACE (CASE WHEN hour(ts) % 7 <> 0 THEN yhat END AS yhat) FROM pred"
    thin = (
        "SELECT * REPLACE (CASE WHEN hour(ts) >= CASE model WHEN 'persistence' THEN 3 "
        "WHEN 'seasonal_naive' THEN 14 ELSE 20 END THEN yhat END AS yhat) FROM pred"
    )
    safe_fold = f"""SELECT series_id, model, fold, avg(abs(y - yhat)) AS MAE,
      sqrt(avg((y - yhat) ** 2)) AS RMSE,
      avg(abs((y - yhat) / y)) FILTER (abs(y) >= 1e-8) * 100 AS MAPE,
      sqrt(avg((ln(1 + y) - ln(1 + yhat)) ** 2) FILTER (y >= 0 AND yhat >= 0)) AS RMSLE,
      1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS R2
      FROM ({gaps}) WHERE yhat IS NOT NULL GROUP BY ALL"""
    daily_folds = f"""SELECT series_id, horizon, floor((pos - (n - horizon * 5)) / horizon)::INTEGER AS fold, pos, ts
      FROM placed CROSS JOIN (VALUES (24), (168), (336), (744)) h(horizon)
      WHERE n > horizon * 6 AND pos >= n - horizon * 5"""
    return {
        "hourly_grid_ffill": tidied(
            f"""SELECT g.series_id, g.ts, price, load,
              last_value(price IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_ffill,
              row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos
              FROM grid g LEFT JOIN panel p ON p.series_id = g.series_id AND p.ts = g.ts""",
            "price load price_ffill", f"{PANEL}, {GRID}",
        ),
        "dedupe_keep_first": """SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, ts, event_id, user_id, value
            FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts)
              ORDER BY ts, event_id) = 1""",
        "duplicate_hours": """SELECT sum(c - 1)::BIGINT AS duplicate_rows, count(*) AS duplicate_keys,
            0::BIGINT AS duplicate_columns FROM (
              SELECT count(*) AS c FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING count(*) > 1)""",
        "parse_timestamp": """SELECT event_id, date_trunc('second', ts) AS ts FROM events
            WHERE event_id % 50 <> 0 AND event_id % 37 <> 0""",
        "parse_numeric": """SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN value END AS number,
            regexp_extract(props, '(\\d+)', 1)::DOUBLE AS k FROM events""",
        # The files hold six decimals, of which the query shows five.
        "forecast_files": f"""WITH {E72} SELECT ts AS timestamp, series_id, round(round(max(y), 6), 5) AS Observed,
              round(round(max(yhat) FILTER (model = 'persistence'), 6), 5) AS persistence,
              round(round(max(yhat) FILTER (model = 'seasonal_naive'), 6), 5) AS seasonal_naive,
              round(round(max(yhat) FILTER (model = 'mean24'), 6), 5) AS mean24 FROM pred GROUP BY series_id, ts""",
        "complete_rows": tidied(
            "SELECT * FROM panel WHERE wind IS NOT NULL AND solar IS NOT NULL",
            "price load wind solar net_import up_reserve down_reserve total_gen", PANEL,
        ),
        "model_table": tidied(
            f"""SELECT series_id, ts, price, load, {filled('wind')}, {filled('solar')}, net_import, up_reserve,
              down_reserve, total_gen FROM panel""",
            "price load wind solar net_import up_reserve down_reserve total_gen", PANEL,
        ),
        "list_files": f"WITH {USERS} SELECT model, feature, pos::INTEGER AS rank FROM lists",
        "summary_files": tidied(
            f"""SELECT series_id, model, avg(MAE) OVER w AS MAE, fold, RMSE
              FROM (SELECT series_id, model, fold, {STRICT} FROM pred GROUP BY ALL)
              WINDOW w AS (PARTITION BY series_id, model)""",
            "MAE RMSE", E72,
        ),
        "hourly_frames": tidied(
            f"SELECT series_id, ts, {ROLLING}, {VOLATILITY}, {SHAPE} FROM hours {W}",
            f"{ROLLING_NAMES} {VOLATILITY_NAMES} {SHAPE_NAMES}",
            f"""{PANEL}, {GRID}, hours AS (SELECT g.series_id, g.ts, p.price FROM grid g
              LEFT JOIN panel p ON p.series_id = g.series_id AND p.ts = g.ts)""",
        ),
        "calendar_season": tidied(
            f"""SELECT o_orderkey, ts, {CALENDAR}, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter'
              WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season
              FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_hours(o_orderkey % 24) AS ts FROM orders)""",
            "sin24 cos24 sin168 cos168",
        ),
        "lag_ratios": family(RATIOS, RATIO_NAMES),
        "rolling_stats": f"{family(ROLLING, ROLLING_NAMES)}",
        "volatility": family(VOLATILITY, VOLATILITY_NAMES),
        "robust_z": family(DEMAND, DEMAND_NAMES),
        "shape": family(SHAPE, SHAPE_NAMES),
        "feature_rows": tidied(
            f"""SELECT * FROM (SELECT *, {CALENDAR}, {ALL_FEATURES} FROM panel {W}) f WHERE """
            + " AND ".join(
                f"{c} IS NOT NULL"
                for c in f"price load wind solar net_import total_gen {ALL_NAMES}".split()
            ),
            f"price load wind solar net_import up_reserve down_reserve total_gen sin24 cos24 sin168 cos168 {ALL_NAMES}",
            PANEL,
        ),
        "missing_values": f"""WITH {PANEL}, {GRID}, filled AS (
            SELECT g.series_id, g.ts, p.* EXCLUDE (series_id, ts) FROM grid g LEFT JOIN panel p
              ON p.series_id = g.series_id AND p.ts = g.ts) """
        + missing_sql("series_id ts price load wind solar net_import up_reserve down_reserve total_gen".split()),
        "summary_of_numbers": tidied(
            summary_sql(
                "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
            ),
            "mean std min p25 p50 p75 max",
        ),
        "head_tail": tidied(
            """SELECT series_id, part, ts, price FROM (
              SELECT *, 'head' AS part FROM placed WHERE pos < 5 UNION ALL
              SELECT *, 'tail' FROM placed WHERE pos >= n - 5)""",
            "price", f"{PANEL}, {POSITIONS}",
        ),
        "zero_variance": f"WITH {PRICED} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 1 AS constant FROM priced"
            for c in [*PRICED_COLUMNS, "unit", "nothing"]
        ),
        "corr_pairs": tidied(
            "SELECT feature_1, feature_2, corr FROM corrs WHERE corr >= 0.9", "corr",
            f"{PRICED}, {CORRELATIONS}",
        ),
        "corr_prune": f"WITH {PRICED}, {CORRELATIONS}, {PRUNED} "
        + " UNION ALL ".join(
            f"SELECT (SELECT count(*) FROM priced) AS rows, '{c}' AS column_name, "
            f"{i} IN (SELECT c FROM condemned) AS dropped"
            for i, c in enumerate(PRICED_COLUMNS)
        ),
        "signed_log_scale": tidied(
            """SELECT c_custkey, c_acctbal, (lg - m) / s AS scaled, c_acctbal AS restored
              FROM (SELECT *, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS lg FROM customer),
              (SELECT avg(sign(c_acctbal) * ln(1 + abs(c_acctbal))) AS m,
                stddev_pop(sign(c_acctbal) * ln(1 + abs(c_acctbal))) AS s FROM customer WHERE c_custkey % 10 <> 0)""",
            "c_acctbal scaled restored",
        ),
        "fold_assignment": f"""WITH {PANEL}, {POSITIONS}
            SELECT series_id, ts, horizon, fold::INTEGER AS fold,
              CASE WHEN pos < n - horizon * (5 - fold) THEN 'train' ELSE 'test' END AS role,
              pos < n - horizon * (5 - fold) AND pos >= n - horizon * (5 - fold) - 23 AS is_context
            FROM placed CROSS JOIN (VALUES (24), (72)) h(horizon) CROSS JOIN range(0, 5) f(fold)
            WHERE n > horizon * 6 AND pos < n - horizon * (4 - fold)""",
        "fold_ranges": f"""WITH {DAILY}, {POSITIONS} SELECT series_id, horizon, fold, min(pos) AS train_rows,
            count(*) AS test_rows, min(ts) AS test_from, max(ts) AS test_to FROM ({daily_folds}) GROUP BY ALL""",
        "block_bounds": f"""WITH {DAILY}, {POSITIONS} SELECT series_id, floor((pos - (n - 1680)) / 168)::INTEGER AS block,
            min(pos) AS train_rows, min(ts) AS block_from, max(ts) AS block_to, count(*) AS rows
            FROM placed WHERE n > 1680 AND pos >= n - 1680 GROUP BY 1, 2""",
        "holdout_split": f"""WITH {PANEL}, {POSITIONS} SELECT series_id, ts,
            CASE WHEN pos < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'valid' END AS row_role,
            CASE WHEN pos < 23 THEN NULL WHEN pos < n - greatest(1, floor((n - 23) * 0.1::DOUBLE)) THEN 'train'
              ELSE 'valid' END AS window_role FROM placed""",
        "capped_history": tidied(
            """SELECT series_id, ts, price FROM (
              SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM placed WHERE pos >= n - 100)
              WHERE ts > last - INTERVAL 48 HOUR""",
            "price", f"{PANEL}, {POSITIONS}",
        ),
        "lookback": tidied(
            """SELECT series_id, ts, 24 AS length, total,
              array_to_string(hs, ',') AS hours, array_to_string(ds, ',') AS weekdays FROM (
              SELECT series_id, ts, pos,
                sum(price::FLOAT::DOUBLE + load) OVER f AS total,
                list(hour(ts)) OVER f AS hs, list(isodow(ts) - 1) OVER f AS ds
              FROM placed
              WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
              WHERE pos >= 23""",
            "total", f"{PANEL}, {POSITIONS}",
        ),
        "baseline_forecasts": tidied("SELECT * FROM pred", "y yhat", E24_72),
        "walkforward_metrics": tidied(
            f"SELECT series_id, model, horizon, fold, {STRICT} FROM pred GROUP BY ALL", METRICS, E24_72
        ),
        "multi_horizon_metrics": tidied(
            rankings_sql(), METRICS, f"{DAILY}, {predictions([24, 168, 336, 744], 5)}"
        ),
        "null_safe_scores": tidied(
            f"""SELECT series_id, model, {MEANS}, NULL::DOUBLE AS strict_MAE FROM ({safe_fold}) GROUP BY ALL""",
            METRICS, E72,
        ),
        "kfold_summary": tidied(
            f"""SELECT series_id, model, horizon, count(*) OVER w AS n_folds, avg(MAE) OVER w AS MAE,
              avg(RMSE) OVER w AS RMSE, avg(MAPE) OVER w AS MAPE, fold, MAE AS fold_MAE
              FROM (SELECT series_id, model, horizon, fold, {STRICT} FROM pred GROUP BY ALL)
              WINDOW w AS (PARTITION BY series_id, model, horizon)""",
            "MAE RMSE MAPE fold_MAE", f"{PANEL}, {predictions([24, 72], 3)}",
        ),
        "block_backtest_rank": tidied(
            f"""SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY MAE, model)::INTEGER AS rank
              FROM (SELECT series_id, model, count(yhat) AS n_rows, count(*) - count(yhat) AS n_failed, {STRICT} FROM pred GROUP BY ALL)""",
            METRICS, f"{DAILY}, {predictions([168], 10, 0)}",
        ),
        "health_of_predictions": tidied(
            f"""SELECT series_id, model, fold, count(*) AS rows, count(*) - count(yhat) AS missing,
              min(yhat) AS min, max(yhat) AS max, avg(yhat) AS mean FROM ({holes}) GROUP BY ALL""",
            "min max mean", E72,
        ),
        "coverage_filter": tidied(
            f"""SELECT series_id, model, count(yhat) / count(*) AS coverage FROM ({thin}) GROUP BY ALL
              HAVING count(yhat) / count(*) >= 0.5""",
            "coverage", E72,
        ),
        "shared_timestamps_all": tidied(
            """SELECT series_id, ts, model, fold, yhat FROM (
              SELECT *, count(*) OVER (PARTITION BY series_id, ts) AS c FROM pred) WHERE c = 3""",
            "yhat", E72,
        ),
        "shared_timestamps": tidied(
            """SELECT series_id, ts, model, fold, yhat FROM (
              SELECT *, count(*) OVER (PARTITION BY series_id, ts) AS c, bool_or(full_) OVER (PARTITION BY series_id) AS any_
              FROM (SELECT *, count(*) OVER (PARTITION BY series_id, ts) = 3 AS full_ FROM pred
                WHERE NOT (model = 'mean24' AND (hour(ts) % 5 = 0 OR series_id = 'view'))))
              WHERE c = 3 OR NOT any_""",
            "yhat", E72,
        ),
        "merge_forecasts_outer": tidied(
            """SELECT series_id, timestamp, coalesce(a.Observed, b.Observed) AS Observed, a.mean24 AS mean24,
              b.mean24 AS mean24_long, persistence, seasonal_naive
              FROM first_ a FULL JOIN second_ b USING (series_id, timestamp)""",
            "Observed mean24 mean24_long persistence seasonal_naive", f"{E24_72}, {TWO_TABLES}",
        ),
        "merge_blocks_inner": tidied(
            """SELECT series_id, timestamp, coalesce(a.Observed, b.Observed) AS Observed, persistence,
              seasonal_naive, a.mean24 AS mean24 FROM first_ a JOIN second_ b USING (series_id, timestamp)""",
            "Observed persistence seasonal_naive mean24", f"{E24_72}, {TWO_TABLES}",
        ),
        "union_of_rankings": tidied(
            f"""SELECT series_id, model, MAE, RMSE, MAPE, RMSLE, horizon::BIGINT AS HorizonHours,
              CASE WHEN horizon = 72 THEN R2 END AS R2 FROM ({rankings_sql()})""",
            METRICS, E24_72,
        ),
        "peak_limits": tidied("SELECT series_id, q, threshold FROM limits", "q threshold", f"{E72}, {PEAKS}"),
        "peak_scores": tidied(
            "SELECT * FROM peaks",
            "q threshold MAE_peaks MAE_nonpeaks WMAE precision_peak recall_peak f1_peak", f"{E72}, {PEAKS}",
        ),
        "month_peaks_view": tidied(
            """SELECT series_id, ts, model, place::INTEGER AS place, y, yhat, y >= threshold AS is_peak FROM (
              SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM pred)
              JOIN (SELECT series_id, model, threshold, row_number() OVER (PARTITION BY series_id
                ORDER BY recall_peak DESC NULLS LAST, WMAE NULLS LAST, model) AS place FROM peaks WHERE q = 0.95)
              USING (series_id, model) WHERE place <= 2 AND ts > last - INTERVAL 744 HOUR""",
            "y yhat", f"{E72}, {PEAKS}",
        ),
        "dm_pairs": tidied(
            "SELECT * FROM tests", "dm_raw dm p_norm p_t mean_diff",
            f"""{E72}, wide_models AS (SELECT series_id, ts, model, y, yhat FROM pred UNION ALL
              SELECT series_id, ts, 'copy24', y, yhat FROM pred WHERE model = 'mean24'),
              {dm(['persistence', 'seasonal_naive', 'mean24', 'copy24'])}""",
        ),
        "dm_compact": tidied(
            """SELECT series_id, pair, loss, better, mean_diff, dm, p_t, CASE WHEN p_t < 0.001 THEN '***'
              WHEN p_t < 0.01 THEN '**' WHEN p_t < 0.05 THEN '*' ELSE '' END AS sig, n::BIGINT AS n, nw_lags::INTEGER AS nw_lags FROM tests""",
            "mean_diff dm p_t",
            f"{E72}, wide_models AS (SELECT * FROM pred), {dm(['persistence', 'seasonal_naive', 'mean24'])}",
        ),
        "rank_long": f"""WITH {USERS} SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY p)::INTEGER AS rank
            FROM (SELECT model, CASE WHEN feature = '7' THEN '8' ELSE feature END AS feature, min(pos) AS p
              FROM lists WHERE pos % 7 <> 0 GROUP BY 1, 2)""",
        "weights_of_models": tidied("SELECT * FROM weights", "w", f"{E72}, {USERS}, {WEIGHTS}"),
        "rank_fusion": tidied(
            "SELECT * FROM fused",
            "wborda rrf mean_rank median_rank models_frac borda_norm wborda_norm rrf_norm final_score",
            f"{E72}, {USERS}, {WEIGHTS}, {fusion('weights')}",
        ),
        "heatmap_of_ranks": f"""WITH {USERS}, equal_ AS (
              SELECT DISTINCT model, 1.0::DOUBLE / 5 AS w FROM lists), {fusion('equal_')}
            SELECT feature, """
        + ", ".join(
            f"(min(rank) FILTER (model = '{m}'))::DOUBLE AS {m}"
            for m in EVENT_TYPES
        )
        + """ FROM ranks WHERE feature IN (
              SELECT feature FROM fused ORDER BY round(final_score, 9) DESC, feature LIMIT 15) GROUP BY 1""",
        "lists_side_by_side": tidied(
            "SELECT pos, "
            + ", ".join(f"{m}.feature AS {m}_feature, {m}.importance AS {m}_importance" for m in EVENT_TYPES)
            + " FROM "
            + " FULL JOIN ".join(
                f"(SELECT * FROM lists WHERE model = '{m}') {m}" + (" USING (pos)" if i else "")
                for i, m in enumerate(EVENT_TYPES)
            ),
            " ".join(f"{m}_importance" for m in EVENT_TYPES), USERS,
        ),
        "decomposition": tidied(
            """SELECT series_id, ts, price, trend, seasonal, round(price - trend - seasonal, 9) AS resid
              FROM trended JOIN season USING (series_id, place)""",
            "price trend seasonal",
            f"""{PANEL}, {GRID}, filled AS (
              SELECT g.series_id, g.ts, last_value(price IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
                row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos
              FROM grid g LEFT JOIN panel p ON p.series_id = g.series_id AND p.ts = g.ts),
              trended AS (
                SELECT *, pos % 168 AS place, CASE WHEN count(price) OVER c = 169 THEN
                  (sum(price) OVER c - (lag(price, 84) OVER w + lead(price, 84) OVER w) / 2) / 168 END AS trend
                FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts), c AS (PARTITION BY series_id
                  ORDER BY ts ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING)
                QUALIFY count(*) OVER (PARTITION BY series_id) >= 336),
              places AS (SELECT series_id, place, avg(price - trend) AS m FROM trended GROUP BY 1, 2),
              season AS (SELECT series_id, place, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM places)""",
        ),
        "dm_options": tidied(
            " UNION ALL ".join(
                f"SELECT '{v}' AS variant, * FROM (WITH {E72}, wide_models AS (SELECT * FROM pred), {ctes} SELECT * FROM tests)"
                for v, ctes in (
                    ("h24", dm(BASELINES, 24, "23")), ("raw", dm(BASELINES, 1, "3", corrected=False)),
                )
            ),
            "dm_raw dm p_norm p_t mean_diff",
        ),
        "dm_sorted": f"""WITH {E72}, wide_models AS (SELECT * FROM pred), {dm(BASELINES)},
            rounded AS (SELECT series_id, pair, loss, {shown('p_t')} AS p_t, {shown('mean_diff')} AS mean_diff FROM tests)
            SELECT series_id, pair, loss, CASE WHEN p_t < 0.001 THEN '***' WHEN p_t < 0.01 THEN '**' WHEN p_t < 0.05 THEN '*' ELSE '' END AS sig,
              row_number() OVER (ORDER BY series_id, p_t NULLS LAST, abs(mean_diff) DESC NULLS LAST, pair, loss) - 1 AS place FROM rounded""",
        "rankings_sorted": f"""WITH {E24_72} SELECT horizon::BIGINT AS HorizonHours, model || '/' || series_id AS model,
            row_number() OVER (ORDER BY horizon, {shown('MAE')}, model || '/' || series_id) - 1 AS place FROM ({rankings_sql()})""",
        "consolidated_files": f"""WITH {E24_72}, {TWO_TABLES}
            SELECT timestamp, round(round(coalesce(f.Observed, s.Observed), 6), 5) AS Observed,
              round(round(coalesce(f.mean24, s.mean24), 6), 5) AS mean24, round(round(persistence, 6), 5) AS persistence,
              round(round(seasonal_naive, 6), 5) AS seasonal_naive
            FROM (SELECT * FROM first_ WHERE series_id = 'view') f FULL JOIN (SELECT * FROM second_ WHERE series_id = 'view') s
            USING (timestamp)""",
        "peaks_over_fixed": tidied(
            "SELECT * FROM peaks", "q threshold MAE_peaks MAE_nonpeaks WMAE precision_peak recall_peak f1_peak",
            f"""{E72}, limits AS (SELECT series_id, q, 60.0::DOUBLE AS threshold FROM (SELECT DISTINCT series_id FROM pred),
              (VALUES (0.95::DOUBLE), (0.92), (0.89)) v(q)), {PEAKS[PEAKS.index('scored AS'):]}""",
        ),
        "rank_by_importance": f"WITH {USERS} SELECT model, feature, pos::INTEGER AS rank FROM lists",
        "loaded_tables": tidied(
            " UNION ALL ".join(f"SELECT '{k}' AS source, ts, series_id, price, load FROM panel" for k in ("csv", "parquet")),
            "price load", PANEL,
        ),
        "feature_file": tidied(
            "SELECT * FROM panel WHERE wind IS NOT NULL AND solar IS NOT NULL",
            "price load wind solar net_import up_reserve down_reserve total_gen", PANEL,
        ),
        "typed_file": tidied("SELECT series_id, ts, load, wind, solar FROM panel", "load wind solar", PANEL),
        "exogenous_table": f"WITH {PANEL}, filled AS (SELECT * FROM panel) "
        + missing_sql(["wind", "solar", "net_import", "up_reserve", "down_reserve"]),
        "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events",
        "adf_fixed": tidied(
            " UNION ALL ".join(adf_sql(k) for k in (0, 1)), "adf adf_p", f"{PRIORITIES}, {POSITIONS}",
        ),
        "perm_importance_linear": tidied(
            importance_sql("series_id"), "importance",
            f"""{PANEL}, {POSITIONS}, fitted_rows AS (
              SELECT * FROM placed WHERE pos < n - least(168, greatest(24, n - 1))),
              {shuffled_sql("least(168, greatest(24, n - 1))", "n - least(168, greatest(24, n - 1))")}""",
        ),
        "perm_importance_all_rows": tidied(
            importance_sql(""), "importance",
            f"{PANEL}, {POSITIONS}, fitted_rows AS (SELECT * FROM placed), {shuffled_sql('n', '0')}",
        ),
        "ar_one_lag": tidied(
            "SELECT series_id, horizon, fold, ts, 'linear_ar' AS model, yhat FROM rolled JOIN placed USING (series_id, pos)", "yhat",
            f"""RECURSIVE {PANEL}, {POSITIONS},
              gaps AS (SELECT *, price - lag(price, 24) OVER w AS g FROM placed {W}),
              pairs AS (SELECT *, lag(g) OVER w AS g1 FROM gaps {W}),
              folds AS (SELECT DISTINCT series_id, horizon, fold::INTEGER AS fold, n - horizon * (5 - fold) AS start_
                FROM placed, (VALUES (24), (72)) h(horizon), range(0, 5) f(fold) WHERE n > horizon * 6),
              fits AS (SELECT f.series_id, horizon, fold, any_value(start_) AS start_, covar_pop(g1, g) / var_pop(g1) AS b,
                avg(g) - covar_pop(g1, g) / var_pop(g1) * avg(g1) AS a
                FROM folds f JOIN pairs p ON p.series_id = f.series_id AND pos < start_ WHERE g1 IS NOT NULL GROUP BY 1, 2, 3),
              rolled(series_id, horizon, fold, start_, a, b, gap, past, pos, yhat) AS (
                SELECT f.series_id, horizon, fold, start_, a, b, max_by(g, pos), list(price ORDER BY pos), start_ - 1, NULL::DOUBLE
                FROM fits f JOIN gaps p ON p.series_id = f.series_id AND pos >= start_ - 24 AND pos < start_ GROUP BY ALL
                UNION ALL SELECT series_id, horizon, fold, start_, a, b, a + b * gap, list_append(past[2:], past[1] + a + b * gap),
                  pos + 1, past[1] + a + b * gap FROM rolled WHERE pos + 1 < start_ + horizon)""",
        ).replace("FROM rolled JOIN", "FROM (SELECT * FROM rolled WHERE yhat IS NOT NULL) JOIN"),
        "walk_forward_linear": tidied(
            """SELECT series_id, horizon, fold, ts, 'plane' AS model, my + w1 * (load - m1) + w2 * (net_import - m2) AS yhat
              FROM folds JOIN planes USING (horizon, fold) WHERE pos >= start_ AND pos < start_ + horizon""",
            "yhat",
            f"""{PANEL}, {POSITIONS}, folds AS (
              SELECT p.*, horizon, fold::INTEGER AS fold, n - horizon * (5 - fold) AS start_
              FROM placed p, (VALUES (24), (168), (336), (744)) h(horizon), range(0, 5) f(fold) WHERE n > horizon * 6),
              planes AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2
                FROM (SELECT horizon, fold, {COVARIANCES} FROM (
                  SELECT horizon, fold, load AS x1, net_import AS x2, price AS y FROM folds WHERE pos < start_) GROUP BY 1, 2))""",
        ),
        "block_backtest_linear": tidied(
            """SELECT series_id, 168 AS horizon, fold, ts, 'line' AS model, my + s1y / s11 * (load - m1) AS yhat
              FROM folds JOIN (SELECT fold, covar_pop(load, price) AS s1y, covar_pop(load, load) AS s11, avg(load) AS m1,
                avg(price) AS my FROM folds WHERE pos < start_ GROUP BY 1) USING (fold) WHERE pos >= start_ AND pos < start_ + 168""",
            "yhat",
            f"""{DAILY}, {POSITIONS}, folds AS (SELECT p.*, fold::INTEGER AS fold, n - 168 * (10 - fold) AS start_
              FROM placed p, range(0, 10) f(fold) WHERE n > 1680)""",
        ),
        "failed_series": f"""WITH {PANEL}, {POSITIONS}
            SELECT series_id, 'plane' AS model, 48 AS horizon, fold::INTEGER AS fold, 'infinite value of load' AS error, 48::BIGINT AS rows
            FROM (SELECT DISTINCT series_id, n, CASE series_id WHEN 'click' THEN 0 WHEN 'view' THEN n - 200 END AS at_ FROM placed),
              range(0, 5) f(fold) WHERE n > 240 AND at_ < n - 48 * (5 - fold)""",
        "kpss_levels": tidied(
            f"SELECT series_id, n, lags, kpss, {KPSS_P} AS kpss_p FROM stat", "kpss kpss_p",
            f"{PANEL}, {POSITIONS}, {KPSS}",
        ),
    }
