"""Independent SQL for the registered queries: self-joins and recursion where the engine uses windows and arrays."""

from __future__ import annotations

BRANDS = """
bm AS (SELECT last_day(l_shipdate) AS date, p_brand AS asset_id, sum(l_extendedprice * (1 - l_discount)) AS rev
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bm)),
bi AS (SELECT bm.*, i FROM bm JOIN cal USING (date)),
br AS (SELECT a.date, a.asset_id, a.i, a.rev / b.rev - 1 AS value FROM bi a JOIN bi b ON a.asset_id = b.asset_id AND b.i = a.i - 1)"""

SUPPLIERS = """
s AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, last_day(l_shipdate) AS date, sum(l_extendedprice * (1 - l_discount)) / 1000 AS value
      FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2)"""

INDEX = """
x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s WHERE value IS NOT NULL),
xl AS (SELECT *, CAST(floor(4 * power(n / 100e0, 2e0 / 9e0)) AS INTEGER) AS lags FROM x)"""

WEEKS = """
wk AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS date, p_brand AS asset_id, sum(l_extendedprice * (1 - l_discount)) AS rev
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2),
wcal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM wk)),
wi AS (SELECT wk.*, i FROM wk JOIN wcal USING (date)),
wr AS (SELECT a.date, a.asset_id, a.rev / b.rev - 1 AS value FROM wi a JOIN wi b ON a.asset_id = b.asset_id AND b.i = a.i - 1),
lg AS (SELECT date AS formation_date, CASE q WHEN 5 THEN 'long' ELSE 'short' END AS leg, asset_id
       FROM (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY -value, asset_id) AS q FROM br) WHERE q IN (1, 5))"""


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0e0"


def bartlett(name: str, source: str, z: str, key: str = "series_id") -> str:
    """CTE (key, v): Bartlett-weighted sum of products of z, by a lag self-join."""
    return f"""
{name} AS (SELECT a.{key}, sum(CASE WHEN a.i = b.i THEN a.z * b.z ELSE 2e0 * (1e0 - (a.i - b.i) / (a.lags + 1e0)) * a.z * b.z END) AS v
  FROM (SELECT {key}, i, lags, {z} AS z FROM {source}) a JOIN (SELECT {key}, i, {z} AS z FROM {source}) b
    ON a.{key} = b.{key} AND b.i <= a.i AND a.i - b.i <= a.lags GROUP BY 1)"""


def erfc(x: str) -> str:
    return f"CASE WHEN {x} >= 4 THEN 0e0 WHEN {x} IS NOT NULL THEN greatest(0e0, 1e0 - 2e0 / sqrt(pi()) * list_sum([power(-1, k) * power({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) FOR k IN range(0, 101)])) END"


def kolmogorov(x: str) -> str:
    return f"CASE WHEN {x} < 0.04 THEN 1e0 ELSE least(1e0, greatest(0e0, list_sum([CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * {x} * {x}) FOR k IN range(1, 101)]))) END"


def sup_wald_p(stat: str, trim: float = 0.15) -> str:
    from waneline.functions.stats import P_FLOOR, SUP_WALD_LEVELS
    from waneline.functions.supwald import quantiles

    q = quantiles(trim)
    cells = ", ".join(f"({a}e0, {b}e0, {c}e0, {d}e0)" for a, b, c, d in zip(q, q[1:], SUP_WALD_LEVELS, SUP_WALD_LEVELS[1:], strict=False))
    return f"CASE WHEN {stat} <= {q[0]} THEN {1 - SUP_WALD_LEVELS[0]}e0 WHEN {stat} >= {q[-1]} THEN {P_FLOOR}e0 ELSE (SELECT 1e0 - (l0 + (l1 - l0) * ({stat} - q0) / (q1 - q0)) FROM (VALUES {cells}) AS c(q0, q1, l0, l1) WHERE {stat} >= q0 AND {stat} < q1) END"


def fwd(p: int, name: str = "fw") -> str:
    """CTE (date, asset_id, value): p-period forward returns on the calendar of br."""
    joins = " ".join(f"LEFT JOIN br r{k} ON r{k}.asset_id = g.asset_id AND r{k}.i = g.i + {k}" for k in range(1, p + 1))
    product = " * ".join(f"(1 + r{k}.value)" for k in range(1, p + 1))
    have = " AND ".join(f"r{k}.value IS NOT NULL" for k in range(1, p + 1))
    grid = f"(SELECT d.date, d.i, a.asset_id FROM (SELECT DISTINCT date, i FROM br) d, (SELECT DISTINCT asset_id FROM br) a) g"
    own = "LEFT JOIN br o ON o.asset_id = g.asset_id AND o.i = g.i"
    return f"{name} AS (SELECT g.date, g.asset_id, {product} - 1 AS value FROM {grid} {own} {joins} WHERE o.value IS NOT NULL OR ({have}))"


def ic(method: str, source: str = "fw", name: str = "ic") -> str:
    if method == "spearman":
        rank = """, rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY sv) + (count(*) OVER (PARTITION BY date, sv) - 1) / 2e0 AS a,
              rank() OVER (PARTITION BY date ORDER BY fv) + (count(*) OVER (PARTITION BY date, fv) - 1) / 2e0 AS b FROM pr)"""
    else:
        rank = ", rk AS (SELECT date, sv AS a, fv AS b FROM pr)"
    return f"""
pr AS (SELECT br.date, -br.value AS sv, f.value AS fv FROM br JOIN {source} f ON f.date = br.date AND f.asset_id = br.asset_id WHERE f.value IS NOT NULL){rank},
ce AS (SELECT date, a - avg(a) OVER (PARTITION BY date) AS a, b - avg(b) OVER (PARTITION BY date) AS b FROM rk),
cs AS (SELECT date, count(*) AS n, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM ce GROUP BY 1),
{name} AS (SELECT d.date, CASE WHEN n >= 5 AND aa * bb > 0 THEN greatest(-1e0, least(1e0, ab / sqrt(aa * bb))) END AS value, coalesce(n, 0) AS n
       FROM (SELECT DISTINCT date FROM {source}) d LEFT JOIN cs USING (date))"""


def sharpe(periods: int, window: int, least: int, where: str = "s") -> str:
    w = f"(PARTITION BY series_id ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    v = f"CASE WHEN count(value) OVER {w} >= {least} AND max(value) OVER {w} - min(value) OVER {w} > 1e-12 * max(abs(value)) OVER {w} THEN avg(value) OVER {w} / stddev_samp(value) OVER {w} * sqrt({periods}e0) END"
    return f"SELECT series_id, date, {r(v)} AS value FROM {where}"


#: Mean shift at position k of each series in kk (series_id, k), with its robust t.
SHIFT = f"""
sh AS (SELECT xl.series_id, any_value(k) AS k, any_value(n) AS n, avg(CASE WHEN i < k THEN value END) AS mb, avg(CASE WHEN i >= k THEN value END) AS ma,
              max(CASE WHEN i = k THEN date END) AS brk, any_value(lags) AS lags FROM xl JOIN kk USING (series_id) GROUP BY 1),
sz AS (SELECT xl.series_id, xl.i, xl.lags, CASE WHEN i < sh.k THEN -(value - mb) / sh.k ELSE (value - ma) / (sh.n - sh.k) END AS z0 FROM xl JOIN sh USING (series_id)),
{bartlett("sv", "sz", "z0")}"""

def shift_columns(stat: str, p: str, guard: str = "TRUE") -> str:
    t = "(ma - mb) / sqrt(v)"
    return f"""SELECT series_id, brk AS date, {r(stat)} AS stat, {r(p)} AS p_value, {r("mb")} AS mean_before, {r("ma")} AS mean_after,
  {r(f"CASE WHEN {guard} THEN ma - mb END")} AS change, {r(f"CASE WHEN {guard} THEN {t} END")} AS change_t, k AS n_before, n - k AS n_after, lags AS hac_lags"""


LRV = f"""
mx AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM xl),
{bartlett("lv", "mx", "value - m")},
us AS (SELECT series_id FROM xl GROUP BY 1 HAVING count(*) >= 20 AND max(value) > min(value)),
wp AS (SELECT series_id, date, i AS k, power(av - bv, 2) / (greatest(v / n, 1e-300) * (1e0 / i + 1e0 / (n - i))) AS wald FROM (
  SELECT mx.*, v, (sum(value) OVER w - value) / nullif(i, 0) AS bv, (m * n - (sum(value) OVER w - value)) / (n - i) AS av
  FROM mx JOIN lv USING (series_id) JOIN us USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))
  WHERE i BETWEEN greatest(ceil(0.15e0 * n), 5) AND least(floor((1e0 - 0.15e0) * n), n - 5)),
cp AS (SELECT series_id, date, i, n, sum(value - m) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) / (sqrt(greatest(v / n, 1e-300)) * sqrt(n)) AS cusum
       FROM mx JOIN lv USING (series_id) JOIN us USING (series_id))"""

GAP = f"""
pp AS (SELECT *, CASE WHEN date <= DATE '1997-12-31' THEN 0 WHEN date < DATE '1999-01-01' THEN 1 ELSE 2 END AS p FROM xl),
gm AS (SELECT series_id, any_value(lags) AS lags, any_value(n) AS n, count(*) FILTER (p = 0) AS n0, count(*) FILTER (p = 1) AS n1, count(*) FILTER (p = 2) AS n2,
  avg(value) FILTER (p = 0) AS m0, avg(value) FILTER (p = 1) AS m1, avg(value) FILTER (p = 2) AS m2 FROM pp GROUP BY 1 HAVING n0 >= 12 AND n2 >= 1),
gu AS (SELECT pp.*, n0, n1, n2, value - CASE p WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS u FROM pp JOIN gm USING (series_id)),
{bartlett("v01", "gu", "CASE p WHEN 1 THEN u / n1 WHEN 0 THEN -u / n0 ELSE 0 END")},
{bartlett("v02", "gu", "CASE p WHEN 2 THEN u / n2 WHEN 0 THEN -u / n0 ELSE 0 END")},
{bartlett("v12", "gu", "CASE p WHEN 2 THEN u / n2 WHEN 1 THEN -u / n1 ELSE 0 END")}"""


def adjusted(method: str) -> str:
    if method == "holm":
        best = "max(p_value * (m - k + 1)) OVER (ORDER BY k)"
    else:
        best = "min(p_value * m / k) OVER (ORDER BY k DESC)"
    return f"""WITH {SUPPLIERS}, {INDEX}, {CHOW_K}, {SHIFT},
p AS (SELECT series_id, {erfc("sqrt(power((ma - mb) / sqrt(v), 2) / 2)")} AS p_value FROM sh JOIN sv USING (series_id)),
o AS (SELECT *, row_number() OVER (ORDER BY p_value, series_id) AS k, count(*) OVER () AS m FROM p)
SELECT series_id, {r("p_value")} AS p_value, {r(f"least(1e0, {best})")} AS p_adjusted FROM o"""


CHOW_K = """
kk AS (SELECT series_id, count(*) FILTER (date < DATE '1999-01-01') AS k FROM xl GROUP BY 1
       HAVING count(*) >= 20 AND max(value) > min(value) AND k >= 5 AND count(*) - k >= 5)"""

YEARS = "datediff('day', min(date) OVER (PARTITION BY series_id), date) / 365.25e0"

GRID = f"""
ty AS (SELECT series_id, date, value, {YEARS} AS t FROM s),
gp AS (SELECT series_id, t, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS g FROM ty),
bd AS (SELECT series_id, ln(2e0) / greatest(max(t) / 100, 3e0 * median(g)) AS fast, ln(100e0) / max(t) AS slow FROM gp GROUP BY 1),
gr AS (SELECT series_id, j, CASE WHEN j < 60 THEN -slow * power(1e-5, j / 59e0) WHEN j = 60 THEN 0e0 ELSE fast * power(1e-5, (220 - j) / 159e0) END AS rate FROM bd, range(0, 221) AS q(j)),
ss AS (SELECT g.series_id, j, rate, sum(value * value) - power(sum(value * exp(-rate * t)), 2) / sum(exp(-2e0 * rate * t)) AS sse FROM gr g JOIN ty USING (series_id) GROUP BY 1, 2, 3)"""

def _profile(rate: str) -> str:
    """Sum of squared errors at a rate, over the lists ys and ts of a row."""
    along = f"list_sum(list_transform(list_zip(ys, ts), lambda q: q[1] * exp(-({rate}) * q[2])))"
    norm = f"list_sum(list_transform(ts, lambda q: exp(-2e0 * ({rate}) * q)))"
    return f"(yy - power({along}, 2) / {norm})"


GOLDEN = f"""
li AS (SELECT series_id, list(value ORDER BY date) AS ys, list(t ORDER BY date) AS ts, sum(value * value) AS yy, count(*) AS n, avg(value) AS my,
       regr_slope(value, t) AS b1, regr_intercept(value, t) AS b0, min(date) AS a, max(date) AS z FROM ty GROUP BY 1 HAVING count(*) >= 20),
be AS (SELECT series_id, arg_min(j, (sse, j)) AS j FROM ss GROUP BY 1),
g0 AS (SELECT li.*, be.j, lo.rate AS lo, hi.rate AS hi, me.rate AS rate FROM li JOIN be USING (series_id)
  JOIN gr lo ON lo.series_id = li.series_id AND lo.j = greatest(be.j - 1, 0) JOIN gr hi ON hi.series_id = li.series_id AND hi.j = least(be.j + 1, 220) JOIN gr me ON me.series_id = li.series_id AND me.j = be.j),
go AS (
  SELECT series_id, 0 AS step, lo, hi, ys, ts, yy FROM g0
  UNION ALL
  SELECT series_id, step + 1, CASE WHEN fc < fd THEN lo ELSE c END, CASE WHEN fc < fd THEN d ELSE hi END, ys, ts, yy FROM (
    SELECT *, {_profile("c")} AS fc, {_profile("d")} AS fd FROM (
      SELECT *, hi - (sqrt(5e0) - 1) / 2 * (hi - lo) AS c, lo + (sqrt(5e0) - 1) / 2 * (hi - lo) AS d FROM go WHERE step < 30))),
gx AS (SELECT g0.* EXCLUDE (rate, lo, hi), CASE WHEN j IN (0, 220) THEN g0.rate ELSE (go.lo + go.hi) / 2 END AS rate FROM g0 JOIN go ON go.series_id = g0.series_id AND step = 30),
gf AS (SELECT *, {_profile("rate")} AS sse, list_sum(list_transform(list_zip(ys, ts), lambda q: q[1] * exp(-rate * q[2]))) / list_sum(list_transform(ts, lambda q: exp(-2e0 * rate * q))) AS level,
  list_sum(list_transform(list_zip(ys, ts), lambda q: power(q[1] - b0 - b1 * q[2], 2))) AS ssl, list_sum(list_transform(ys, lambda q: power(q - my, 2))) AS sst FROM gx)"""


def _mixed(x: str) -> str:
    """32-bit scramble of a whole number: three shifts and two products."""
    once = "(xor(a, a >> 16) * 73244475 % 4294967296)"
    return f"[xor(a, a >> 16) FOR a IN [{once} FOR a IN [{once} FOR a IN [{x}]]]][1]"


BOOT = f"""WITH {SUPPLIERS}, {INDEX},
tt AS (SELECT series_id, i, n, value, date_diff('day', min(date) OVER (PARTITION BY series_id), date) / 365.25e0 AS t, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi FROM x),
ln AS (SELECT series_id, any_value(n) AS n, regr_slope(value, t) AS slope, avg(t) AS mt, avg(value) AS my, regr_sxx(value, t) AS sxx,
  least(any_value(n), greatest(1, CAST(round_even(1.75 * cbrt(any_value(n)), 0) AS BIGINT))) AS block, CAST('0x' || substr(md5('0:' || series_id), 1, 8) AS BIGINT) AS key FROM tt WHERE n >= 20 AND hi > lo GROUP BY 1),
re AS (SELECT series_id, i, t - mt AS c, value - my - slope * (t - mt) AS u FROM tt JOIN ln USING (series_id)),
bl AS (SELECT series_id, n, block, d, b, ({_mixed("xor(" + _mixed("xor(key, d * 40503 % 4294967296)") + ", b * 60493 % 4294967296)")} * (n - block + 1)) >> 32 AS first
  FROM ln, range(0, 100) AS q(d), range(0, 400) AS p(b) WHERE b * block < n),
dr AS (SELECT series_id, d, b * block + k AS i, first + k AS j FROM bl, range(0, 400) AS o(k) WHERE k < block AND b * block + k < n),
sl AS (SELECT series_id, d, any_value(slope) + sum(a.c * z.u) / any_value(sxx) AS s FROM dr JOIN re a USING (series_id, i) JOIN re z ON z.series_id = dr.series_id AND z.i = dr.j JOIN ln USING (series_id) GROUP BY 1, 2)
SELECT series_id, {r("any_value(slope)", 5)} AS slope, {r("quantile_cont(s, 0.025)", 5)} AS slope_lo, {r("quantile_cont(s, 0.975)", 5)} AS slope_hi FROM sl JOIN ln USING (series_id) GROUP BY 1"""


def crowd(method: str, n_factors: int = 0) -> str:
    """Crowding scores by joins: windows of 52 weeks, 26 returns and 5 stocks at least. Three factors go by Cramer's rule."""
    resid = "value - avg(value) OVER w AS e"
    if n_factors == 3:
        cov = lambda a, b: f"covar_pop({a}, {b}) OVER w"
        x = ["mkt", "odd", "hi"]
        m = [[cov(a, b) for b in x] for a in x]
        det = lambda q: f"({q[0][0]} * ({q[1][1]} * {q[2][2]} - {q[1][2]} * {q[2][1]}) - {q[0][1]} * ({q[1][0]} * {q[2][2]} - {q[1][2]} * {q[2][0]}) + {q[0][2]} * ({q[1][0]} * {q[2][1]} - {q[1][1]} * {q[2][0]}))"
        swapped = lambda j: [[cov("value", a) if k == j else m[i][k] for k in range(3)] for i, a in enumerate(x)]
        fitted = " - ".join(f"{det(swapped(j))} / {det(m)} * ({a} - avg({a}) OVER w)" for j, a in enumerate(x))
        resid = f"value - avg(value) OVER w - {fitted} AS e"
    if n_factors == 1:
        resid = "value - avg(value) OVER w - regr_slope(value, mkt) OVER w * (mkt - avg(mkt) OVER w) AS e"
    if method == "pairwise":
        pair = "cr AS (SELECT a.f, a.leg, a.asset_id AS x, b.asset_id AS y, corr(a.e, b.e) AS c FROM re a JOIN re b ON a.f = b.f AND a.leg = b.leg AND a.date = b.date AND a.asset_id < b.asset_id GROUP BY ALL HAVING count(*) >= 3)"
    else:
        pair = """ot AS (SELECT a.f, a.leg, a.asset_id, a.date, any_value(a.e) AS e, avg(b.e) AS o FROM re a JOIN re b ON a.f = b.f AND a.leg = b.leg AND a.date = b.date AND a.asset_id <> b.asset_id GROUP BY 1, 2, 3, 4),
cr AS (SELECT f, leg, asset_id, corr(e, o) AS c FROM ot GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""
    return f"""WITH {BRANDS}, {WEEKS},
rc AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM wr)),
mk AS (SELECT date, avg(value) AS mkt, coalesce(avg(value) FILTER (k % 2 = 1) - avg(value) FILTER (k % 2 <> 1), 0) AS odd, coalesce(avg(value) FILTER (k > 3) - avg(value) FILTER (k <= 3), 0) AS hi
  FROM (SELECT date, value, CAST(right(asset_id, 1) AS INTEGER) AS k FROM wr) GROUP BY 1),
fo AS (SELECT f.f, max(rc.i) AS en FROM (SELECT DISTINCT formation_date AS f FROM lg) f LEFT JOIN rc ON rc.date <= f.f GROUP BY 1),
ce AS (SELECT fo.f, lg.leg, lg.asset_id, wr.date, wr.value, mkt, odd, hi, count(*) OVER (PARTITION BY fo.f, lg.leg, lg.asset_id) AS k
  FROM fo JOIN lg ON lg.formation_date = fo.f JOIN rc ON rc.i > fo.en - 52 AND rc.i <= fo.en JOIN wr ON wr.date = rc.date AND wr.asset_id = lg.asset_id JOIN mk ON mk.date = rc.date WHERE fo.en >= 52),
ok AS (SELECT * FROM ce WHERE k >= 26),
sz AS (SELECT f, leg, count(DISTINCT asset_id) AS n FROM ok GROUP BY 1, 2),
re AS (SELECT f, leg, asset_id, date, {resid} FROM ok JOIN sz USING (f, leg) WHERE sz.n >= 5 WINDOW w AS (PARTITION BY f, leg, asset_id)),
{pair},
sc AS (SELECT f, leg, avg(c) AS c FROM cr GROUP BY 1, 2),
wd AS (SELECT fo.f AS date, max(c) FILTER (sz.leg = 'long') AS long, max(c) FILTER (sz.leg = 'short') AS short, coalesce(max(n) FILTER (sz.leg = 'long'), 0) AS n_long, coalesce(max(n) FILTER (sz.leg = 'short'), 0) AS n_short
  FROM fo LEFT JOIN sz USING (f) LEFT JOIN sc ON sc.f = fo.f AND sc.leg = sz.leg GROUP BY 1),
cw AS (SELECT date, long, short, CASE WHEN long IS NULL THEN short WHEN short IS NULL THEN long ELSE (long + short) / 2 END AS mean, n_long, n_short FROM wd)"""


CROWD_OUT = f" SELECT date, {r('long')} AS long, {r('short')} AS short, {r('mean')} AS mean, CAST(n_long AS BIGINT) AS n_long, CAST(n_short AS BIGINT) AS n_short FROM cw"

LINK = f"""{crowd("leave_one_out")},
st AS (SELECT r.date, avg(r.value) FILTER (leg = 'long') - avg(r.value) FILTER (leg = 'short') AS value
  FROM lg JOIN cal c ON c.date = lg.formation_date JOIN br r ON r.i = c.i + 1 AND r.asset_id = lg.asset_id GROUP BY 1),
si AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM st),
ft AS (SELECT a.date, (1 + b.value) * (1 + c.value) * (1 + d.value) - 1 AS y FROM si a JOIN si b ON b.k = a.k + 1 JOIN si c ON c.k = a.k + 2 JOIN si d ON d.k = a.k + 3),
jn AS (SELECT 1 AS one, mean AS c, y, row_number() OVER (ORDER BY date) - 1 AS i FROM cw JOIN ft USING (date) WHERE mean IS NOT NULL),
mo AS (SELECT count(*) AS n, avg(c) AS mc, avg(y) AS my, regr_sxx(y, c) AS sxx, regr_slope(y, c) AS b, corr(c, y) AS co FROM jn),
jz AS (SELECT one, i, CAST(greatest(floor(4 * power(n / 100e0, 2e0 / 9e0)), 2) AS INTEGER) AS lags, (c - mc) / sxx * (y - my - b * (c - mc)) AS z0 FROM jn, mo),
{bartlett("jv", "jz", "z0", "one")}
SELECT 3 AS horizon, {r("b * sqrt(sxx / (n - 1))")} AS slope_per_sd, {r("b / sqrt(v)")} AS t_stat, {r("co")} AS correlation, n AS n_obs FROM mo, jv"""


def horizons() -> str:
    parts = []
    for h in (1, 2, 3, 6):
        parts.append(f"h{h} AS (WITH {fwd(h)}, {ic('spearman')} SELECT CAST({h} AS INTEGER) AS horizon, date, value FROM ic WHERE value IS NOT NULL)")
    both = " UNION ALL ".join(f"SELECT * FROM h{h}" for h in (1, 2, 3, 6))
    return f"""WITH {BRANDS}, {", ".join(parts)},
al AS ({both}),
ax AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS n, avg(value) OVER (PARTITION BY horizon) AS m FROM al),
az AS (SELECT horizon, i, n, m, CAST(greatest(floor(4 * power(n / 100e0, 2e0 / 9e0)), least(horizon - 1, n - 1)) AS INTEGER) AS lags, (value - m) / n AS z0 FROM ax),
{bartlett("av", "az", "z0", "horizon")},
hz AS (SELECT horizon, any_value(m) AS mean_ic, any_value(m) / sqrt(any_value(v)) AS t_stat, any_value(n) AS n_dates FROM az JOIN av USING (horizon) GROUP BY 1 HAVING n_dates >= 10)"""


def sql() -> dict[str, str]:
    rate, level = "CASE WHEN j IN (0, 220) THEN -b1 / b0 ELSE rate END", "CASE WHEN j IN (0, 220) THEN b0 ELSE level END"
    return {
        "ic_spearman": f"WITH {BRANDS}, {fwd(1)}, {ic('spearman')} SELECT date, {r('value')} AS value, n FROM ic",
        "ic_pearson": f"WITH {BRANDS}, {fwd(1)}, {ic('pearson')} SELECT date, {r('value')} AS value, n FROM ic",
        "forward_returns_1": f"WITH {BRANDS}, {fwd(1)} SELECT date, asset_id, {r('value')} AS value FROM fw",
        "forward_returns_3": f"WITH {BRANDS}, {fwd(3)} SELECT date, asset_id, {r('value')} AS value FROM fw",
        "rolling_ic": f"WITH {BRANDS}, {fwd(1)}, {ic('spearman')} SELECT date, {r('CASE WHEN count(value) OVER w >= 10 THEN avg(value) OVER w END')} AS value FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
        "rolling_sharpe_m": f"WITH {SUPPLIERS} " + sharpe(12, 24, 24),
        "rolling_sharpe_d": "WITH s AS (SELECT 'day' AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice * (1 - l_discount)) / 1000 AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 2) " + sharpe(252, 252, 200),
        "rolling_sharpe_rf": f"WITH {BRANDS}, e AS (SELECT asset_id AS series_id, date, value - month(date) / 1000e0 AS value FROM br) " + sharpe(12, 12, 6, "e"),
        "infer_freq": f"""WITH {SUPPLIERS}, a AS (SELECT series_id, date FROM s UNION ALL SELECT DISTINCT 'day', CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-01'
  UNION ALL SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events),
g AS (SELECT series_id, CAST(date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS DOUBLE) AS gap FROM a),
m AS (SELECT series_id, count(*) AS n, median(gap) AS median_gap FROM g GROUP BY 1),
b AS (SELECT *, CASE WHEN median_gap BETWEEN 1 AND 5 THEN 'D' WHEN median_gap BETWEEN 5.5 AND 10 THEN 'W' WHEN median_gap BETWEEN 25 AND 35 THEN 'M' WHEN median_gap BETWEEN 80 AND 100 THEN 'Q' WHEN median_gap BETWEEN 350 AND 380 THEN 'A' END AS f FROM m),
o AS (SELECT b.series_id, any_value(f) AS f, any_value(n) AS n, any_value(median_gap) AS median_gap, sum(CASE WHEN NOT CASE f WHEN 'D' THEN gap BETWEEN 1 AND 5 WHEN 'W' THEN gap BETWEEN 5.5 AND 10 WHEN 'M' THEN gap BETWEEN 25 AND 35 WHEN 'Q' THEN gap BETWEEN 80 AND 100 ELSE gap BETWEEN 350 AND 380 END THEN gap ELSE 0 END) / sum(gap) AS share
  FROM b JOIN g USING (series_id) GROUP BY 1)
SELECT series_id, CASE WHEN n >= 3 AND share <= 0.05 THEN f END AS freq, {r("median_gap")} AS median_gap, {r("CASE WHEN f IS NOT NULL THEN share END")} AS off_band_share FROM o""",
        "dropna_trim": f"WITH {SUPPLIERS}, v AS (SELECT series_id, date, CASE WHEN month(date) <> 2 THEN value END AS value FROM s), e AS (SELECT series_id, min(date) AS a, max(date) AS z FROM v WHERE value IS NOT NULL GROUP BY 1) SELECT series_id, 'interior_missing' AS kind, count(*) AS count FROM v JOIN e USING (series_id) WHERE value IS NULL AND date > a AND date < z GROUP BY 1",
        "align_panels": f"WITH {BRANDS}, x AS (SELECT * FROM br WHERE month(date) <> 3), y AS (SELECT * FROM br WHERE right(asset_id, 1) <> '1'), k AS (SELECT date, asset_id FROM x UNION SELECT date, asset_id FROM y) SELECT k.date, count(x.value) AS n_a, count(y.value) AS n_b FROM k LEFT JOIN x ON x.date = k.date AND x.asset_id = k.asset_id LEFT JOIN y ON y.date = k.date AND y.asset_id = k.asset_id WHERE k.date IN (SELECT date FROM x INTERSECT SELECT date FROM y) AND k.asset_id IN (SELECT asset_id FROM x INTERSECT SELECT asset_id FROM y) GROUP BY 1",
        "align_excluded": f"WITH {BRANDS}, x AS (SELECT * FROM br WHERE month(date) <> 3), y AS (SELECT * FROM br WHERE right(asset_id, 1) <> '1') SELECT 'left' AS series_id, 'excluded_date' AS kind, (SELECT count(*) FROM (SELECT date FROM x EXCEPT SELECT date FROM y)) AS count UNION ALL SELECT 'right', 'excluded_date', (SELECT count(*) FROM (SELECT date FROM y EXCEPT SELECT date FROM x)) UNION ALL SELECT 'left', 'excluded_asset_id', (SELECT count(*) FROM (SELECT asset_id FROM x EXCEPT SELECT asset_id FROM y)) UNION ALL SELECT 'right', 'excluded_asset_id', (SELECT count(*) FROM (SELECT asset_id FROM y EXCEPT SELECT asset_id FROM x))",
        "years_axis": f"WITH {SUPPLIERS} SELECT series_id, date, {r(YEARS)} AS t FROM s",
        "hac_mean": f"WITH {SUPPLIERS}, {INDEX}, mz AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM xl), {bartlett('v', 'mz', '(value - m) / n')} SELECT series_id, any_value(n) AS n, {r('any_value(m)')} AS mean, {r('sqrt(any_value(v))')} AS se, {r('any_value(m) / sqrt(any_value(v))')} AS t, any_value(lags) AS lags FROM mz JOIN v USING (series_id) GROUP BY 1",
        "hac_ols_trend": f"""WITH {SUPPLIERS}, {INDEX}, tt AS (SELECT *, {YEARS} AS t FROM xl),
rg AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, avg(t) AS mt, regr_sxx(value, t) AS sxx FROM tt GROUP BY 1),
rz AS (SELECT tt.*, a, b, (t - mt) / sxx * (value - a - b * t) AS zs, (1e0 / n - mt * (t - mt) / sxx) * (value - a - b * t) AS zi FROM tt JOIN rg USING (series_id)),
{bartlett("vs", "rz", "zs")}, {bartlett("vi", "rz", "zi")}
SELECT series_id, any_value(n) AS n, {r("any_value(a)")} AS intercept, {r("any_value(b)")} AS slope, {r("any_value(a) / sqrt(any_value(vi.v))")} AS t_intercept, {r("any_value(b) / sqrt(any_value(vs.v))")} AS t_slope, any_value(lags) AS lags
FROM rz JOIN vs USING (series_id) JOIN vi USING (series_id) GROUP BY 1""",
        "chow_test": f"WITH {SUPPLIERS}, {INDEX}, {CHOW_K}, {SHIFT} " + shift_columns("power((ma - mb) / sqrt(v), 2)", erfc("sqrt(power((ma - mb) / sqrt(v), 2) / 2)")) + " FROM sh JOIN sv USING (series_id)",
        "sup_wald_path": f"WITH {SUPPLIERS}, {INDEX}, {LRV} SELECT series_id, date, CAST(k AS INTEGER) AS k, {r('wald')} AS wald FROM wp",
        "sup_wald": f"WITH {SUPPLIERS}, {INDEX}, {LRV}, kk AS (SELECT series_id, max(wald) AS stat, arg_max(k, (wald, -k)) AS k FROM wp GROUP BY 1), {SHIFT}, al AS (SELECT sh.*, v, stat FROM sh JOIN sv USING (series_id) JOIN kk USING (series_id)) " + shift_columns("stat", sup_wald_p("stat")) + " FROM al",
        "cusum_path": f"WITH {SUPPLIERS}, {INDEX}, {LRV} SELECT series_id, date, CAST(i AS INTEGER) AS i, {r('cusum')} AS cusum FROM cp",
        "cusum": f"WITH {SUPPLIERS}, {INDEX}, {LRV}, kk AS (SELECT series_id, max(abs(cusum)) AS stat, arg_max(i, (abs(cusum), -i)) FILTER (i < n - 1) + 1 AS k FROM cp GROUP BY 1), {SHIFT}, al AS (SELECT sh.*, v, stat FROM sh JOIN sv USING (series_id) JOIN kk USING (series_id)) " + shift_columns("stat", kolmogorov("stat"), "least(k, n - k) >= 2") + " FROM al",
        "p_values": f"SELECT {r('stat')} AS stat, {r(erfc('sqrt(stat / 2)'))} AS chi2_p, {r(kolmogorov('(stat / 4)'))} AS kolmogorov_p, {r(sup_wald_p('stat'))} AS sup_wald_p FROM (SELECT k / 3e0 AS stat FROM range(0, 60) AS q(k))",
        "publication_gap": f"""WITH {SUPPLIERS}, {INDEX}, {GAP}
SELECT series_id, {r("m0")} AS in_sample_mean, {r("m1 - m0")} AS post_sample_change, {r("(m1 - m0) / sqrt(v01.v)")} AS post_sample_t, {r("m2 - m0")} AS post_publication_change, {r("(m2 - m0) / sqrt(v02.v)")} AS post_publication_t,
  {r("(m2 - m1) / sqrt(v12.v)")} AS publication_vs_post_sample_t, {r("CASE WHEN m0 > 0 THEN (m0 - m1) / m0 END")} AS post_sample_decline, {r("CASE WHEN m0 > 0 THEN (m0 - m2) / m0 END")} AS post_publication_decline, lags AS hac_lags
FROM gm JOIN v01 USING (series_id) JOIN v02 USING (series_id) JOIN v12 USING (series_id)""",
        "publication_table": f"""WITH {SUPPLIERS}, {INDEX}, {GAP},
pd AS (SELECT gu.series_id || '/' || p AS key, gu.series_id, p, date, value, row_number() OVER (PARTITION BY gu.series_id, p ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY gu.series_id, p) AS np, avg(value) OVER (PARTITION BY gu.series_id, p) AS m FROM gu),
pz AS (SELECT key, i, CAST(floor(4 * power(np / 100e0, 2e0 / 9e0)) AS INTEGER) AS lags, (value - m) / np AS z0 FROM pd),
{bartlett("pv", "pz", "z0", "key")},
ag AS (SELECT series_id, p, min(date) AS a, max(date) AS z, count(*) AS np, avg(value) AS m, stddev_samp(value) AS sd, any_value(v) AS v FROM pd JOIN pv USING (key) GROUP BY 1, 2)
SELECT gm.series_id, ['in_sample', 'post_sample', 'post_publication'][q.p + 1] AS period, a AS start, z AS "end", coalesce(np, 0) AS n_obs, {r("m")} AS mean, {r("m * 12")} AS ann_mean, {r("CASE WHEN sd > 0 THEN m / sd * sqrt(12e0) END")} AS ann_sharpe,
  {r("CASE WHEN np >= 12 THEN m / sqrt(v) END")} AS t_stat, {r("CASE WHEN q.p = 0 THEN 0e0 WHEN np > 0 AND m0 > 0 THEN (m0 - m) / m0 END")} AS decline
FROM gm CROSS JOIN range(0, 3) AS q(p) LEFT JOIN ag ON ag.series_id = gm.series_id AND ag.p = q.p""",
        "lambda_grid_fit": f"WITH {SUPPLIERS}, {GRID}, b AS (SELECT series_id, arg_min((j, rate, sse), (round(sse, 6), j)) AS x FROM ss GROUP BY 1) SELECT series_id, CAST(x[1] AS INTEGER) AS j, {r('x[2]', 4)} AS rate, {r('x[3]', 1)} AS sse FROM b",
        "decay_boot_hash": BOOT,
        "decay_point": f"""WITH RECURSIVE {SUPPLIERS}, {GRID}, {GOLDEN}
SELECT series_id, CASE WHEN j IN (0, 220) THEN 'linear' ELSE 'exponential' END AS model, {r(rate, 4)} AS decay_rate, {r(level, 2)} AS initial_level, {r("1 - sse / sst", 4)} AS r2_exponential, {r("1 - ssl / sst", 4)} AS r2_linear,
  {r("n * ln(sse / n) + 4", 4)} AS aic_exponential, {r("n * ln(ssl / n) + 4", 4)} AS aic_linear, CASE WHEN n * ln(sse / n) <= n * ln(ssl / n) THEN 'exponential' ELSE 'linear' END AS better_fit, {r("b1", 4)} AS linear_slope,
  n AS n_obs, a AS start, z AS "end", CAST(round_even(1.75 * power(n, 1e0 / 3e0), 0) AS INTEGER) AS block_size, j IN (0, 220) AS fallback FROM gf""",
        "signal_lifetime": f"""WITH {SUPPLIERS}, {INDEX}, tt AS (SELECT *, {YEARS} AS t FROM xl),
rg AS (SELECT series_id, CAST(series_id AS INTEGER) AS q, regr_slope(value, t) AS b, regr_intercept(value, t) AS a0 FROM tt GROUP BY 1),
f AS (SELECT series_id, CASE WHEN q % 2 = 0 THEN 'exponential' ELSE 'linear' END AS model, q % 5 <> 0 AS det, CASE WHEN q % 7 = 0 THEN -a0 ELSE a0 END AS a, abs(b) / 100 + 0.05e0 AS rate, CASE WHEN q % 3 = 0 THEN -0.01e0 ELSE 0.02e0 END AS lo, abs(b) / 50 + 0.1e0 AS hi FROM rg),
g AS (SELECT *, CASE WHEN NOT det THEN 'no decay detected: any date would be invented' WHEN NOT a > 0 THEN 'the starting level is not positive' WHEN 150 >= a THEN 'already at or below the level at the start' END AS reason,
  CASE WHEN a > 150 THEN CASE model WHEN 'exponential' THEN ln(a / 150) ELSE 1 - 150 / a END END AS need FROM f),
h AS (SELECT *, CASE WHEN reason IS NULL THEN need / rate WHEN reason LIKE 'already%' THEN 0e0 END AS y, CASE WHEN reason IS NULL THEN need / hi WHEN reason LIKE 'already%' THEN 0e0 END AS cl, CASE WHEN reason IS NULL THEN CASE WHEN lo <= 0 THEN CAST('inf' AS DOUBLE) ELSE need / lo END WHEN reason LIKE 'already%' THEN 0e0 END AS ch FROM g)
SELECT series_id, model, 150e0 AS level, {r("y", 4)} AS years_from_start, {r("greatest(0e0, y - datediff('day', DATE '1995-01-31', DATE '2001-07-31') / 365.25e0)", 4).replace("round(", "CASE WHEN y IS NOT NULL THEN round(", 1)} END AS years_remaining,
  DATE '1995-01-31' + CAST(floor(y * 365.25e0) AS INTEGER) AS date, {r("cl", 4)} AS ci_low, CASE WHEN isinf(ch) THEN ch ELSE {r("ch", 4)} END AS ci_high, reason FROM h""",
        "holm": adjusted("holm"),
        "bh": adjusted("bh"),
        "ic_by_horizon": f"{horizons()} SELECT horizon, {r('mean_ic')} AS mean_ic, {r('t_stat')} AS t_stat, n_dates, {r('mean_ic / horizon')} AS ic_per_period FROM hz",
        "horizon_half_life": f"""{horizons()}, q AS (SELECT min(mean_ic) AS low, arg_min(t_stat, horizon) AS t0, count(*) AS k, min(horizon) AS h0, regr_slope(ln(CASE WHEN mean_ic > 0 THEN mean_ic END), horizon) AS b, arg_max(horizon, (mean_ic, -horizon)) AS peak FROM hz),
w AS (SELECT *, CASE WHEN low <= 0 THEN 'the mean IC is not positive at every horizon' WHEN t0 < 2 THEN 'the IC at the shortest horizon is not significant' WHEN k < 3 THEN 'fewer than three horizons have a positive mean IC' WHEN b >= 0 THEN 'the mean IC does not fall with the horizon' END AS reason FROM q)
SELECT {r("CASE WHEN reason IS NULL THEN h0 + ln(2e0) / -b END")} AS half_life_periods, reason, peak AS peak_horizon FROM w""",
        "crowding_loo": crowd("leave_one_out") + CROWD_OUT,
        "crowding_pairwise": crowd("pairwise") + CROWD_OUT,
        "crowding_1factor": crowd("leave_one_out", 1) + CROWD_OUT,
        "crowding_kfactor": crowd("leave_one_out", 3) + CROWD_OUT,
        "crowding_link": LINK,
        "factor_csv": "SELECT * FROM (VALUES (DATE '1926-07-31', 0.0296e0, -0.0256e0, -0.0243e0, 0.0022e0), (DATE '1926-08-31', 0.0264e0, NULL, 0.0382e0, 0.0025e0), (DATE '1926-02-28', 0.001e0, 0.002e0, NULL, 0.0025e0)) AS t(date, mkt_rf, smb, hml, rf)",
        "daily_values": f"SELECT event_type AS series_id, CAST(ts AS DATE) AS date, {r('sum(value)', 4)} AS value FROM events GROUP BY 1, 2",
    }
