"""SQL that computes each query's result another way: windows over whole
series, recursive queries and elimination written out, for one machine."""

from __future__ import annotations

from .queries import CALENDARS, MEMORY, MODEL, THIRD, YEARS

Z = "1.959963984540054e0"


def text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def rnd(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"


def query(select: str, *ctes: str) -> str:
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    return ("WITH RECURSIVE " + ",\n".join(seen) + "\n" if seen else "") + select


# ---- stand-ins ------------------------------------------------------------------

HOURLY = """hourly AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS price
  FROM events GROUP BY 1, 2)"""

DAILY_ORDERS = """daily AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day,
         round(sum(o_totalprice), 2) AS price
  FROM orders GROUP BY 1, 2)"""

DAILY_SUPPLIERS = """daily AS (
  SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS day,
         round(sum(l_extendedprice), 2) AS price
  FROM lineitem GROUP BY 1, 2)"""

EDGES = ["2024-01-07 00:00:00", "2024-01-21 03:00:00"]


def shifted(t: str) -> str:
    listed = ", ".join(f"TIMESTAMP '{e}'" for e in EDGES)
    return f"CASE WHEN {t} IN ({listed}) THEN {t} + INTERVAL 30 MINUTE ELSE {t} END"


CLASSIFIED = """typed AS (
  SELECT *, CASE
      WHEN CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-20')
        THEN 'holiday'
      WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type
  FROM hourly),
classified AS (
  SELECT *, CASE
      WHEN hour(ts) < CASE day_type WHEN 'weekday' THEN 7 WHEN 'weekend' THEN 17 ELSE 18 END
        THEN 'light'
      WHEN day_type = 'weekday' AND hour(ts) BETWEEN 17 AND 20 THEN 'heavy'
      ELSE 'medium' END AS load_step,
    CAST(ts AS DATE) - CAST((dayofweek(ts) + 1) % 7 AS INTEGER) AS op_week
  FROM typed)"""

WEEKLY = """weekly AS (
  SELECT series, load_step, op_week + 7 AS op_week, round(avg(price), 4) AS weekly
  FROM classified GROUP BY 1, 2, 3)"""

ALIGNED = """aligned AS (
  SELECT c.series, c.load_step, c.ts, c.op_week, c.price AS hourly, w.weekly
  FROM classified c LEFT JOIN weekly w USING (series, load_step, op_week))"""

DIFFS = """diffs AS (
  SELECT *, hourly - weekly AS diff FROM aligned WHERE weekly IS NOT NULL)"""

WEEK_CTES = (HOURLY, CLASSIFIED, WEEKLY, ALIGNED)

ORACLES: dict[str, str] = {}

ORACLES["scan_series"] = f"""SELECT event_type AS series, count(*) AS n,
  {text('min(ts)')} AS first, {text('max(ts)')} AS last, {rnd('sum(value)', 2)} AS total
FROM events GROUP BY 1"""

ORACLES["series_select"] = query(
    f"SELECT series, {text('ts')} AS ts, {rnd('price', 2)} AS x"
    " FROM classified WHERE load_step = 'light'", HOURLY, CLASSIFIED)

ORACLES["period_filter"] = f"""SELECT o_orderkey, {text('o_orderdate')} AS o_orderdate,
  {rnd('o_totalprice', 2)} AS o_totalprice
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-04-17' AND DATE '1998-11-06'"""

ORACLES["harmonise_union"] = f"""SELECT o_orderkey,
  CASE WHEN year(o_orderdate) > {YEARS[0]} THEN o_orderstatus ELSE 'none' END AS status,
  {rnd('o_totalprice', 2)} AS price
FROM orders WHERE year(o_orderdate) BETWEEN {YEARS[0]} AND {YEARS[-1]}"""

ORACLES["tidy_unpivot"] = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS series, {text('l_shipdate')} AS day, {rnd(f'sum({c})', 2)} AS x"
    f" FROM lineitem GROUP BY l_shipdate"
    for name, c in [("quantity", "l_quantity"), ("price", "l_extendedprice"), ("tax", "l_tax")])

ORACLES["dst_adjust"] = query(
    f"SELECT series, {text(shifted('ts'))} AS ts, {rnd('price', 2)} AS price FROM hourly", HOURLY)

ORACLES["load_step_join"] = query(
    f"SELECT series, day_type, load_step, {text('ts')} AS ts, {rnd('price', 2)} AS price"
    " FROM classified", HOURLY, CLASSIFIED)

ORACLES["weekly_hourly_align"] = query(
    f"SELECT series, load_step, {text('ts')} AS ts, {text('CAST(op_week AS TIMESTAMP)')} AS op_week,"
    f" {rnd('hourly', 2)} AS hourly, {rnd('weekly', 4)} AS weekly FROM aligned", *WEEK_CTES)

ISSUED = text("CAST(CAST(ts AS DATE) - 1 AS TIMESTAMP)")

ORACLES["weekly_hourly_diff"] = query(
    f"SELECT series, load_step, {text('ts')} AS ts, {ISSUED} AS issue_date,"
    f" {rnd('diff', 4)} AS diff FROM diffs", *WEEK_CTES, DIFFS)

ORACLES["prepared_dataset"] = query(
    f"SELECT series, load_step, {text(shifted('ts'))} AS ts,"
    f" {text('CAST(op_week AS TIMESTAMP)')} AS op_week, {ISSUED} AS issue_date,"
    f" {rnd('hourly', 2)} AS hourly, {rnd('weekly', 4)} AS weekly, {rnd('diff', 4)} AS diff"
    " FROM diffs", *WEEK_CTES, DIFFS)

def steps_by_table(t: str) -> str:
    """The step of the table in force at a time."""
    rules = [f"""WHEN {t} >= TIMESTAMP '{first}' THEN CASE WHEN hour({t}) < {light} THEN 'light'
      WHEN hour({t}) BETWEEN {heavy} AND {heavy + 3} THEN 'heavy' ELSE 'medium' END"""
             for first, _, _, light, heavy in reversed(CALENDARS)]
    return f"CASE {' '.join(rules)} END"


CALENDAR = f"""calendar AS (
  SELECT {shifted('ts')} AS ts, {steps_by_table('ts')} AS load_step
  FROM (SELECT DISTINCT ts FROM hourly) WHERE hour(ts) % 3 = 0)"""

STEPPED = """stepped AS (
  SELECT h.*, CAST(h.ts AS DATE) - CAST((dayofweek(h.ts) + 1) % 7 AS INTEGER) AS op_week,
    CASE WHEN c.ts > h.ts + INTERVAL 30 MINUTE - INTERVAL 1 DAY THEN c.load_step END AS load_step
  FROM hourly h ASOF LEFT JOIN calendar c ON h.ts + INTERVAL 30 MINUTE >= c.ts)"""

ORACLES["load_step_calendar"] = query(
    f"SELECT load_step, {text('ts')} AS ts FROM calendar", HOURLY, CALENDAR)

ORACLES["calendar_join"] = query(
    f"SELECT series, load_step, {text('ts')} AS ts, {rnd('price', 2)} AS price FROM stepped",
    HOURLY, CALENDAR, STEPPED)

ORACLES["prepared_calendar"] = query(
    f"SELECT series, load_step, {text('ts')} AS ts, {text('CAST(op_week AS TIMESTAMP)')} AS op_week,"
    f" {ISSUED} AS issue_date, {rnd('hourly', 2)} AS hourly, {rnd('weekly', 4)} AS weekly,"
    f" {rnd('diff', 4)} AS diff FROM diffs",
    HOURLY, CALENDAR, STEPPED, WEEKLY.replace("FROM classified", "FROM stepped"),
    ALIGNED.replace("FROM classified", "FROM stepped"), DIFFS)

MIXED = """mixed AS (
  SELECT series, TIMESTAMP '2024-01-01' + event_id * step AS ts, round(value, 2) AS price
  FROM events, (VALUES ('ms', INTERVAL 1 MILLISECOND), ('second', INTERVAL (-1) SECOND),
                       ('day', INTERVAL 1 DAY), ('week', INTERVAL (-7) DAY)) AS s(series, step))"""

ORACLES["lagged_mixed"] = query(
    f"""SELECT series, row_number() OVER w AS pos, {rnd('price', 2)} AS price,
  {rnd('lag(price, 1) OVER w', 2)} AS price_1, {rnd('lag(price, 3) OVER w', 2)} AS price_3
FROM mixed WINDOW w AS (PARTITION BY series ORDER BY ts)""", MIXED)

# however it was written
ORACLES["prepared_update"] = ORACLES["prepared_dataset"]

ORACLES["cc_returns"] = query(
    f"""SELECT series, {text('CAST(day AS TIMESTAMP)')} AS day, {rnd('ret')} AS ret FROM (
  SELECT *, CASE WHEN price > 0 AND prev > 0 THEN ln(price) - ln(prev) END AS ret FROM (
    SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS pos
    FROM daily WINDOW w AS (PARTITION BY series ORDER BY day)))
WHERE pos > 1""", DAILY_ORDERS)

ORACLES["series_tail"] = query(
    f"""SELECT series, CAST(pos - greatest(n - 10, 0) AS INTEGER) AS pos,
  {text('CAST(day AS TIMESTAMP)')} AS day, {rnd('price', 2)} AS x FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS pos,
         count(*) OVER (PARTITION BY series) AS n FROM daily)
WHERE pos > n - 10""", DAILY_SUPPLIERS)

NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos,
         count(*) OVER (PARTITION BY series) AS n, avg(price) OVER (PARTITION BY series) AS mu
  FROM hourly)"""

ORACLES["lagged"] = query(
    f"""SELECT series, pos, {text('ts')} AS ts, {rnd('price', 2)} AS price,
  {rnd('lag(price, 1) OVER w', 2)} AS price_1, {rnd('lag(price, 3) OVER w', 2)} AS price_3
FROM numbered WINDOW w AS (PARTITION BY series ORDER BY pos)""", HOURLY, NUMBERED)

ORACLES["train_holdout_split"] = query(
    f"""SELECT series, CASE WHEN pos > n - 3 THEN 'holdout' ELSE 'train' END AS sample,
  CASE WHEN pos > n - 3 THEN CAST(pos - n + 3 AS INTEGER) ELSE 0 END AS h,
  {text('ts')} AS ts, {rnd('price', 2)} AS x FROM numbered""", HOURLY, NUMBERED)


def frac_terms(d: float, lags: int) -> str:
    w, terms = 1.0, []
    for k in range(lags + 1):
        if k:
            w = -w * (d - k + 1) / k
        terms.append(f"({w!r}) * coalesce(lag(price, {k}) OVER w, 0)")
    return " + ".join(terms)


ORACLES["frac_diff"] = query(
    f"""SELECT series, {text('CAST(day AS TIMESTAMP)')} AS day, {rnd('fd', 4)} AS fd FROM (
  SELECT series, day, {frac_terms(0.00943, 50)} AS fd
  FROM daily WINDOW w AS (PARTITION BY series ORDER BY day))""", DAILY_ORDERS)

ORACLES["frac_diff_long"] = query(
    f"""SELECT series, {text('CAST(day AS TIMESTAMP)')} AS day, {rnd('fd', 4)} AS fd FROM (
  SELECT a.series, a.day, sum(w * b.price) AS fd
  FROM placed a JOIN placed b ON a.series = b.series AND b.pos BETWEEN a.pos - {MEMORY} AND a.pos
  JOIN weights ON k = a.pos - b.pos GROUP BY 1, 2)""", DAILY_ORDERS,
    "placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS pos FROM daily)",
    f"""weights AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w UNION ALL
  SELECT k + 1, w * (k - CAST({THIRD!r} AS DOUBLE)) / (k + 1) FROM weights WHERE k < {MEMORY})""")

ORACLES["sd_band"] = query(
    f"""SELECT series, count(*) AS n, {rnd('avg(price)', 4)} AS mean,
  {rnd('stddev_samp(price)', 4)} AS sd,
  {rnd('avg(price) - 3 * stddev_samp(price)', 4)} AS lower,
  {rnd('avg(price) + 3 * stddev_samp(price)', 4)} AS upper
FROM daily GROUP BY series""", DAILY_SUPPLIERS)


# ---- autocorrelation and histogram ------------------------------------------------

def centred(source: str, t: str, x: str) -> str:
    return f"""centred AS (
  SELECT series, {x} - avg({x}) OVER (PARTITION BY series) AS z,
         count(*) OVER (PARTITION BY series) AS n,
         row_number() OVER (PARTITION BY series ORDER BY {t}) AS pos
  FROM {source})"""


def rho(last: str) -> str:
    return f"""rho AS (
  SELECT a.series, k.lag, a.n,
         sum(a.z * b.z) / (SELECT nullif(sum(c.z * c.z), 0) FROM centred c
                           WHERE c.series = a.series) AS rho
  FROM centred a JOIN (SELECT CAST(unnest(range(1, 131)) AS INTEGER) AS lag) k ON k.lag <= {last}
  JOIN centred b ON b.series = a.series AND b.pos = a.pos - k.lag
  GROUP BY a.series, k.lag, a.n)"""


def acf_sql(last: str) -> str:
    return (f"SELECT series, lag, {rnd('rho')} AS rho, {rnd(f'{Z} / sqrt(n)')} AS limit"
            " FROM rho")


def ljung_sql(
    source_ctes: tuple[str, ...], source: str, t: str, x: str, df: int = 4,
) -> str:
    """Lag 10; 4 or 6 degrees of freedom have a closed form."""
    terms = "1 + q / 2" + (" + q * q / 8" if df == 6 else "")
    return query(
        f"""SELECT series, n, {df} AS df, {rnd('q')} AS q,
  {rnd(f'exp(-q / 2) * ({terms})')} AS p_value FROM (
  SELECT series, n, n * (n + 2) * sum(rho * rho / (n - lag)) AS q FROM rho
  GROUP BY series, n)""", *source_ctes, centred(source, t, x), rho("least(10, a.n - 1)"))


DEFAULT_LAGS = "least(floor(10 * log10(a.n)), a.n - 1)"

ORACLES["acf"] = query(acf_sql(DEFAULT_LAGS), HOURLY, centred("hourly", "ts", "price"),
                       rho(DEFAULT_LAGS))
ORACLES["ljung_box"] = ljung_sql((HOURLY,), "hourly", "ts", "price")
ORACLES["ljung_box_mixed"] = ljung_sql((MIXED,), "mixed", "ts", "price", 6)
ORACLES["ljung_box_suppliers"] = ljung_sql((DAILY_SUPPLIERS,), "daily", "day", "price", 6)


def histogram_sql(source: str, x: str, digits: int, *ctes: str) -> str:
    return query(
        f"""SELECT e.series, e.bin, CAST(coalesce(f.n, 0) AS BIGINT) AS n,
  {rnd('e.lo', digits)} AS lo, {rnd('e.hi', digits)} AS hi
FROM edges e LEFT JOIN filled f USING (series, bin)""", *ctes,
        f"""ends AS (
  SELECT series, count(*) AS n, min({x}) AS a, max({x}) AS b,
         quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr
  FROM {source} GROUP BY series)""",
        """plan AS (
  SELECT *, (b - a) / bins AS step FROM (
    SELECT *, CAST(CASE WHEN b = a THEN 1 WHEN iqr = 0 THEN ceil(log2(n) + 1)
      ELSE ceil((b - a) / (2 * iqr * pow(n, CAST(-1 AS DOUBLE) / 3))) END AS INTEGER) AS bins
    FROM ends))""",
        """edges AS (
  SELECT series, a, b, bins, step, bin, a + (bin - 1) * step AS lo,
         CASE WHEN bin = bins THEN b ELSE a + bin * step END AS hi
  FROM (SELECT *, CAST(unnest(range(1, bins + 1)) AS INTEGER) AS bin FROM plan))""",
        f"""filled AS (
  SELECT series, greatest(1, least(bins, CAST(ceil(({x} - a) / step) AS INTEGER))) AS bin,
         count(*) AS n
  FROM {source} JOIN plan USING (series) GROUP BY 1, 2)""")


ORACLES["fd_histogram"] = histogram_sql("hourly", "price", 6, HOURLY)

QUANTILES = ", ".join(
    f"{rnd(f'quantile_cont(diff, {p})')} AS {name}"
    for name, p in [("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)])

ORACLES["diff_distribution"] = query(
    f"""SELECT series, load_step, count(*) AS n, {rnd('avg(diff)')} AS mean,
  {rnd('stddev_samp(diff)')} AS sd,
  {rnd('avg(pow(dev, 3)) / pow(avg(dev * dev), 1.5)')} AS skewness,
  {rnd('avg(pow(dev, 4)) / pow(avg(dev * dev), 2) - 3')} AS kurtosis,
  {rnd('min(diff)', 4)} AS min, {rnd('max(diff)', 4)} AS max, {QUANTILES}
FROM (SELECT *, diff - avg(diff) OVER (PARTITION BY series, load_step) AS dev FROM diffs)
GROUP BY 1, 2""", *WEEK_CTES, DIFFS)

ORACLES["diff_ecdf"] = query(
    f"""SELECT series, load_step, n, CAST(cum AS BIGINT) AS cum, {rnd('value', 4)} AS value,
  {rnd('cum / total')} AS ecdf FROM (
  SELECT series, load_step, value, n,
    sum(n) OVER (PARTITION BY series, load_step ORDER BY value) AS cum,
    sum(n) OVER (PARTITION BY series, load_step) AS total
  FROM (SELECT series, load_step, round(diff, 4) AS value, count(*) AS n FROM diffs
        GROUP BY 1, 2, 3))""", *WEEK_CTES, DIFFS)


# ---- recursions: residuals of a given ARMA(3,1) --------------------------------------

P1, P2, P3 = MODEL.phi
T1, = MODEL.theta


def lagged_w(source: str, x: str, mu: str, t: str = "ts") -> str:
    """Centred values with three lags and positions."""
    return f"""lagged AS (
  SELECT series, {t} AS ts, {x} AS x, w, pos, n, mu, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2,
         lag(w, 3) OVER o AS w3
  FROM (SELECT *, {x} - {mu} AS w FROM numbered)
  WINDOW o AS (PARTITION BY series ORDER BY pos))"""


RECURSION = f"""walk AS (
  SELECT series, CAST(3 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS d1,
         CAST(0 AS DOUBLE) AS d2, CAST(0 AS DOUBLE) AS d3, CAST(0 AS DOUBLE) AS d4
  FROM (SELECT DISTINCT series FROM lagged)
  UNION ALL
  SELECT l.series, l.pos,
    l.w - ({P1}) * l.w1 - ({P2}) * l.w2 - ({P3}) * l.w3 - ({T1}) * k.e,
    -l.w1 - ({T1}) * k.d1, -l.w2 - ({T1}) * k.d2, -l.w3 - ({T1}) * k.d3, -k.e - ({T1}) * k.d4
  FROM walk k JOIN lagged l ON l.series = k.series AND l.pos = k.pos + 1)"""

RESID = """resids AS (
  SELECT l.series, l.ts, l.x, l.pos, l.n, CASE WHEN l.pos > 3 THEN k.e END AS resid
  FROM lagged l LEFT JOIN walk k USING (series, pos))"""

GIVEN = (HOURLY, NUMBERED, lagged_w("numbered", "price", "mu"), RECURSION, RESID)

ORACLES["arma_residuals"] = query(
    f"SELECT series, {text('ts')} AS ts, {rnd('x', 2)} AS x, {rnd('x - resid')} AS fitted,"
    f" {rnd('resid')} AS resid FROM resids", *GIVEN)

ORACLES["accuracy_measures"] = query(
    f"""SELECT series, {rnd('me')} AS me, {rnd('rmse')} AS rmse, {rnd('mae')} AS mae,
  {rnd('mpe', 4)} AS mpe, {rnd('mape', 4)} AS mape, {rnd('mae / scale')} AS mase,
  {rnd('num / den')} AS acf1 FROM (
  SELECT series, avg(resid) AS me, sqrt(avg(resid * resid)) AS rmse, avg(abs(resid)) AS mae,
    avg(100 * resid / nullif(x, 0)) AS mpe, avg(abs(100 * resid / nullif(x, 0))) AS mape,
    avg(abs(x - prev)) AS scale,
    sum((resid - m) * (before - m)) AS num, sum((resid - m) * (resid - m)) AS den
  FROM (SELECT *, lag(x) OVER o AS prev, lag(resid) OVER o AS before,
          avg(resid) OVER (PARTITION BY series) AS m
        FROM resids WINDOW o AS (PARTITION BY series ORDER BY pos))
  GROUP BY series)""", *GIVEN)

KNOWN = "known AS (SELECT series, ts, resid FROM resids WHERE resid IS NOT NULL)"
KNOWN_ROUND = ("known AS (SELECT series, ts, round(resid, 4) AS resid FROM resids"
               " WHERE resid IS NOT NULL)")

ORACLES["residual_ljung_box"] = ljung_sql((*GIVEN, KNOWN), "known", "ts", "resid")
ORACLES["residual_acf"] = query(acf_sql("10"), *GIVEN, KNOWN, centred("known", "ts", "resid"),
                                rho("least(10, a.n - 1)"))
ORACLES["residual_histogram"] = histogram_sql("known", "resid", 6, *GIVEN, KNOWN_ROUND)


# ---- elimination written out ----------------------------------------------------------

def eliminate(name: str, source: str, size: int, width: int, keep: str = "series") -> list[str]:
    """CTEs reducing ``a{i}_{j}`` of ``source``; the last is ``{name}``."""
    ctes, last = [], source
    for j in range(size):
        columns = []
        for i in range(size):
            for c in range(j + 1, width):
                lead = f"a{j}_{c} / a{j}_{j}"
                columns.append(f"{lead} AS a{j}_{c}" if i == j
                               else f"a{i}_{c} - a{i}_{j} * {lead} AS a{i}_{c}")
        step = name if j == size - 1 else f"{name}_{j}"
        ctes.append(f"{step} AS (SELECT {keep}, {', '.join(columns)} FROM {last})")
        last = step
    return ctes


D = ["d1", "d2", "d3", "d4"]
CROSS = f"""cross_sums AS (
  SELECT k.series, max(l.n) AS n, sum(k.e * k.e) AS sse,
    {', '.join(f'sum({D[i]} * {D[j]}) AS a{i}_{j}' for i in range(4) for j in range(4))},
    {', '.join(f'{1.0 if i == j else 0.0} AS a{i}_{4 + j}' for i in range(4) for j in range(4))}
  FROM walk k JOIN lagged l USING (series, pos) WHERE pos > 3 GROUP BY k.series)"""


def criteria(source: str) -> str:
    """Adds loglik, aic, aicc, bic to a table with used, sse and k."""
    return f"""scored AS (
  SELECT *, aic + 2 * k * (k + 1) / (used - k - 1) AS aicc FROM (
    SELECT *, -2 * loglik + 2 * k AS aic, -2 * loglik + k * ln(used) AS bic FROM (
      SELECT *, -CAST(used AS DOUBLE) / 2 * (ln(2 * pi() * sse / used) + 1) AS loglik
      FROM {source})))"""


ORACLES["arma_evaluate"] = query(
    f"""SELECT series, n, used AS n_used, {rnd('sse', 2)} AS sse,
  {rnd('sse / (used - 5)', 4)} AS sigma2, {rnd('loglik', 4)} AS loglik, {rnd('aic', 4)} AS aic,
  {rnd('aicc', 4)} AS aicc, {rnd('bic', 4)} AS bic FROM scored""",
    *GIVEN, CROSS,
    "counted AS (SELECT series, n, n - 3 AS used, sse, 6 AS k FROM cross_sums)",
    criteria("counted"))

EXPANSION = (
    f"({Z} + (pow({Z}, 3) + {Z}) / 4 / df"
    f" + (5 * pow({Z}, 5) + 16 * pow({Z}, 3) + 3 * {Z}) / 96 / pow(df, 2)"
    f" + (3 * pow({Z}, 7) + 19 * pow({Z}, 5) + 17 * pow({Z}, 3) - 15 * {Z}) / 384 / pow(df, 3)"
    f" + (79 * pow({Z}, 9) + 776 * pow({Z}, 7) + 1482 * pow({Z}, 5) - 1920 * pow({Z}, 3)"
    f" - 945 * {Z}) / 92160 / pow(df, 4))")

ORACLES["coef_table"] = query(
    f"""SELECT series, term, abs(estimate / se) > crit AS significant,
  {rnd('estimate')} AS estimate, {rnd('se')} AS std_err, {rnd('estimate / se', 4)} AS t_value,
  {rnd('crit')} AS critical FROM (
  SELECT *, {EXPANSION} AS crit FROM (
""" + "\n    UNION ALL ".join(
        f"SELECT series, '{term}' AS term, CAST({value} AS DOUBLE) AS estimate,"
        f" sqrt(a{i}_{4 + i} * sse / (n - 3 - 5)) AS se, CAST(n - 5 AS DOUBLE) AS df FROM inverse"
        for i, (term, value) in enumerate(
            [("AR1", P1), ("AR2", P2), ("AR3", P3), ("MA1", T1)])) + "))",
    *GIVEN, CROSS, *eliminate("inverse", "cross_sums", 4, 8, "series, n, sse"))


# ---- forecasts ------------------------------------------------------------------------

TRAIN = ("numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos,"
         " count(*) OVER (PARTITION BY series) AS n, 145.0 AS mu FROM hourly"
         " QUALIFY pos <= n - 3)")
PSI1 = P1 + T1
PSI2 = P1 * PSI1 + P2
AHEAD = f"""tail AS (
  SELECT l.series, l.w, l.w1, l.w2, k.e, s.s2
  FROM lagged l JOIN walk k USING (series, pos)
  JOIN (SELECT k.series, sum(k.e * k.e) / (count(*) - 4 - 1) AS s2
        FROM walk k WHERE k.pos > 3 GROUP BY k.series) s ON s.series = l.series
  WHERE l.pos = l.n - 3),
steps AS (
  SELECT *, ({P1}) * f2 + ({P2}) * f1 + ({P3}) * w AS f3 FROM (
    SELECT *, ({P1}) * f1 + ({P2}) * w + ({P3}) * w1 AS f2 FROM (
      SELECT *, ({P1}) * w + ({P2}) * w1 + ({P3}) * w2 + ({T1}) * e AS f1 FROM tail))),
ahead AS (
  SELECT series, 1 AS h, f1 + 145 AS mean, sqrt(s2) AS se FROM steps
  UNION ALL SELECT series, 2, f2 + 145, sqrt(s2 * {1 + PSI1**2!r}) FROM steps
  UNION ALL SELECT series, 3, f3 + 145, sqrt(s2 * {1 + PSI1**2 + PSI2**2!r}) FROM steps)"""
FORECAST = (HOURLY, TRAIN, lagged_w("numbered", "price", "mu"), RECURSION, AHEAD)
ACTUAL = """actuals AS (
  SELECT series, CAST(3 + 1 - back AS INTEGER) AS h, price AS actual FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS back FROM hourly)
  WHERE back <= 3)"""

ORACLES["arma_forecast"] = query(
    f"SELECT series, h, {rnd('mean', 5)} AS mean, {rnd('se', 5)} AS se,"
    f" {rnd(f'mean - {Z} * se', 5)} AS lower, {rnd(f'mean + {Z} * se', 5)} AS upper FROM ahead",
    *FORECAST)

ORACLES["forecast_vs_actual"] = query(
    f"SELECT series, h, {rnd('mean', 5)} AS pred, {rnd('actual', 2)} AS actual,"
    f" {rnd('actual - mean', 5)} AS err, {rnd('(actual - mean) * (actual - mean)', 3)} AS sq_err"
    " FROM ahead LEFT JOIN actuals USING (series, h)", *FORECAST, ACTUAL)

ORACLES["forecast_chart_frame"] = query(
    f"""SELECT series, pos, label, {rnd('value', 5)} AS value FROM (
  SELECT series, CAST(pos - (n - 3 - 10) AS INTEGER) AS pos, 'history' AS label, price AS value
  FROM numbered WHERE pos > n - 3 - 10
  UNION ALL SELECT series, h + 10, 'predicted', mean FROM ahead
  UNION ALL SELECT series, h + 10, 'lower', mean - {Z} * se FROM ahead
  UNION ALL SELECT series, h + 10, 'upper', mean + {Z} * se FROM ahead
  UNION ALL SELECT series, h + 10, 'actual', actual FROM actuals)""", *FORECAST, ACTUAL)


# ---- estimation ---------------------------------------------------------------------------

FILTERED = (HOURLY, NUMBERED, """shock AS (
  SELECT series, ts, pos, price - mu AS z, lag(price - mu) OVER (PARTITION BY series ORDER BY pos)
    AS z1 FROM numbered)""", """build AS (
  SELECT DISTINCT series, CAST(1 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS y1,
    CAST(0 AS DOUBLE) AS y2, CAST(0 AS DOUBLE) AS y3 FROM shock
  UNION ALL
  SELECT s.series, s.pos, s.z + 0.6 * s.z1 + 0.5 * b.y1 - 0.2 * b.y2 + 0.1 * b.y3, b.y1, b.y2
  FROM build b JOIN shock s ON s.series = b.series AND s.pos = b.pos + 1)""",
            "filtered AS (SELECT series, pos - 1 AS pos, y1 AS y FROM build WHERE pos > 1)")


def lags(name: str, source: str, x: str, depth: int, t: str = "pos", more: str = "") -> str:
    return f"""{name} AS (
  SELECT series, row_number() OVER o AS pos, {x} AS l0{more},
    {', '.join(f'lag({x}, {k}) OVER o AS l{k}' for k in range(1, depth + 1))}
  FROM {source} WINDOW o AS (PARTITION BY series ORDER BY {t}))"""


def normal(name: str, source: str, y: str, regressors: list[str], where: str,
           keep: str = "series") -> str:
    k = len(regressors)
    sums = [f"sum({regressors[i]} * {regressors[j]}) AS a{i}_{j}"
            for i in range(k) for j in range(k)]
    sums += [f"sum({regressors[i]} * {y}) AS a{i}_{k}" for i in range(k)]
    return f"{name} AS (SELECT {keep}, {', '.join(sums)} FROM {source} WHERE {where} GROUP BY {keep})"


LONG = [f"l{k}" for k in range(1, 11)]
ORACLES["arma_fit_hr"] = query(
    "\nUNION ALL ".join(
        f"SELECT series, '{term}' AS term, {rnd(f'a{i}_4', 4)} AS estimate FROM second_fit"
        for i, term in enumerate(["ar1", "ar2", "ar3", "ma1"])),
    *FILTERED, lags("wide", "filtered", "y", 11),
    normal("first_sums", "wide", "l0", LONG, "pos > 11"),
    *eliminate("first_fit", "first_sums", 10, 11),
    f"""shocks AS (
  SELECT w.*, w.l1 - {' - '.join(f'f.a{i}_10 * w.l{i + 2}' for i in range(10))} AS e1
  FROM wide w JOIN first_fit f USING (series))""",
    normal("second_sums", "shocks", "l0", ["l1", "l2", "l3", "e1"], "pos > 11"),
    *eliminate("second_fit", "second_sums", 4, 5))

ORACLES["ar_fit_suppliers"] = query(
    "\nUNION ALL ".join(
        f"SELECT series, '{term}' AS term, {rnd(f'a{i}_2', 4)} AS estimate FROM fit"
        for i, term in enumerate(["ar1", "ar2"])),
    DAILY_SUPPLIERS,
    "c AS (SELECT series, day, price - avg(price) OVER (PARTITION BY series) AS y,"
    " count(*) OVER (PARTITION BY series) AS n FROM daily)",
    lags("wide", "c", "y", 2, "day", ", n"),
    normal("sums", "wide", "l0", ["l1", "l2"], "pos > 5 AND n > 8"),
    *eliminate("fit", "sums", 2, 3))


def ar_board() -> list[str]:
    """All AR orders 0…5, with and without mean, as ``scored`` with a rank."""
    keep = "series, with_mean, n"
    ctes = [
        """both_means AS (
  SELECT series, pos, false AS with_mean, y, count(*) OVER (PARTITION BY series) AS n FROM filtered
  UNION ALL
  SELECT series, pos, true, y - avg(y) OVER (PARTITION BY series),
         count(*) OVER (PARTITION BY series) FROM filtered)""",
        f"""wide AS (
  SELECT series, with_mean, n, row_number() OVER o AS pos, y AS l0,
    {', '.join(f'lag(y, {k}) OVER o AS l{k}' for k in range(1, 6))}
  FROM both_means WINDOW o AS (PARTITION BY series, with_mean ORDER BY pos))""",
        f"base AS (SELECT {keep}, sum(l0 * l0) AS g FROM wide WHERE pos > 5 GROUP BY {keep})",
    ]
    parts = [f"SELECT {keep}, 0 AS p, g AS sse FROM base"]
    for p in range(1, 6):
        columns = [f"l{k}" for k in range(1, p + 1)]
        ctes.append(normal(f"sums{p}", "wide", "l0", columns, "pos > 5", keep))
        ctes += eliminate(f"fit{p}", f"sums{p}", p, p + 1, keep)
        explained = " + ".join(f"f.a{i}_{p} * s.a{i}_{p}" for i in range(p))
        parts.append(
            f"SELECT b.series, b.with_mean, b.n, {p}, b.g - ({explained}) FROM base b"
            f" JOIN fit{p} f USING (series, with_mean) JOIN sums{p} s USING (series, with_mean)")
    ctes.append("ar_orders AS (SELECT series, with_mean, n, p, 0 AS q, sse"
                f" FROM ({' UNION ALL '.join(parts)}))")
    return ctes


def ranked(source: str) -> list[str]:
    return [
        f"""orders_tried AS (
  SELECT *, n - 5 AS used, p + q + CAST(with_mean AS INTEGER) + 1 AS k FROM {source})""",
        criteria("orders_tried"),
        """ranked AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY series ORDER BY aicc, p, q, with_mean) AS INTEGER) AS rank FROM scored)"""]


def arma_board() -> list[str]:
    """The orders with MA terms: both regressions, then the residuals step by step."""
    keep = "series, with_mean, n"
    ctes = [f"""deep AS MATERIALIZED (
  SELECT series, with_mean, n, row_number() OVER o AS pos, y AS l0,
    {', '.join(f'lag(y, {k}) OVER o AS l{k}' for k in range(1, 16))}
  FROM both_means WINDOW o AS (PARTITION BY series, with_mean ORDER BY pos))"""]
    parts = []
    for q in range(1, 6):
        rows = f"pos > {10 + q}"
        ctes.append(normal(f"long_sums{q}", "deep", "l0", LONG, rows, keep))
        ctes += eliminate(f"long_fit{q}", f"long_sums{q}", 10, 11, keep)
        shocks = ", ".join(
            f"w.l{j} - " + " - ".join(f"f.a{i}_10 * w.l{j + i + 1}" for i in range(10)) + f" AS e{j}"
            for j in range(1, q + 1))
        ctes.append(f"""shocks{q} AS MATERIALIZED (
  SELECT w.*, {shocks} FROM deep w JOIN long_fit{q} f USING (series, with_mean) WHERE {rows})""")
        for p in range(6 - q):
            name, k = f"mixed{p}_{q}", p + q
            columns = [f"l{i}" for i in range(1, p + 1)] + [f"e{j}" for j in range(1, q + 1)]
            ctes.append(normal(f"{name}_sums", f"shocks{q}", "l0", columns, rows, keep))
            ctes += eliminate(name, f"{name}_sums", k, k + 1, keep)
            f = [f"a{i}_{k}" if i < p else "0" for i in range(5)]
            t = [f"a{p + j}_{k}" if j < q else "0" for j in range(5)]
            if k == q == 1:
                # the one estimate that can lie outside (-1, 1) here: times 0.95 until inside
                t[0] = ("CASE WHEN abs(a0_1) < 1 THEN a0_1 ELSE a0_1 * pow(0.95,"
                        " floor(ln(abs(a0_1)) / -ln(0.95)) + 1) END")
            parts.append(
                f"SELECT {keep}, {p} AS p, {q} AS q, "
                + ", ".join(f"CAST({c} AS DOUBLE) AS f{i + 1}" for i, c in enumerate(f)) + ", "
                + ", ".join(f"CAST({c} AS DOUBLE) AS t{i + 1}" for i, c in enumerate(t))
                + f" FROM {name}")
    ctes.append(f"candidates AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    ar = " - ".join(f"c.f{i} * d.l{i}" for i in range(1, 6))
    ma = " - ".join(f"c.t{i} * c.e{i}" for i in range(1, 6))
    fixed = ", ".join(["c.series", "c.with_mean", "c.n", "c.p", "c.q"]
                      + [f"c.f{i}" for i in range(1, 6)] + [f"c.t{i}" for i in range(1, 6)])
    ctes.append(f"""score AS (
  SELECT c.*, CAST(5 AS BIGINT) AS pos, {', '.join(f'CAST(0 AS DOUBLE) AS e{i}' for i in range(1, 6))},
    CAST(0 AS DOUBLE) AS sse FROM candidates c
  UNION ALL
  SELECT {fixed}, d.pos, d.l0 - {ar} - {ma}, c.e1, c.e2, c.e3, c.e4,
    c.sse + pow(d.l0 - {ar} - {ma}, 2)
  FROM score c JOIN deep d
    ON d.series = c.series AND d.with_mean = c.with_mean AND d.pos = c.pos + 1)""")
    ctes.append("all_orders AS (SELECT * FROM ar_orders UNION ALL"
                " SELECT series, with_mean, n, p, q, sse FROM score WHERE pos = n)")
    return ctes


BOARD = (f"SELECT series, p, q, with_mean, rank, {rnd('sse', 2)} AS sse, {rnd('aic', 4)} AS aic,"
         f" {rnd('aicc', 4)} AS aicc, {rnd('bic', 4)} AS bic FROM ranked")

ORACLES["order_leaderboard"] = query(BOARD, *FILTERED, *ar_board(), *ranked("ar_orders"))
ORACLES["order_search_ar"] = query(
    f"SELECT series, p, q, with_mean, {rnd('aicc', 4)} AS aicc FROM ranked WHERE rank = 1",
    *FILTERED, *ar_board(), *ranked("ar_orders"))
ORACLES["order_leaderboard_arma"] = query(
    BOARD, *FILTERED, *ar_board(), *arma_board(), *ranked("all_orders"))



def newton(start: str, rows: str, k: int, skip: int, keep: list[str], rounds: int) -> list[str]:
    """Gauss–Newton steps written out from the coefficients c1 … ck of ``start``, as CTEs.

    The first p are those of lags of the series, the next q those of lags of the
    residual, where p and q are columns; the rest stay 0.  Each round walks
    through every series at several shares of the last step, carrying residual,
    derivatives and their sums of products, keeps the share with the least sum
    of squares and solves the normal equations there.  The last CTE, ``newton``,
    has the coefficients, the ``sse`` at them and ``step``, the largest move
    that the next round would make.
    """
    each = range(1, k + 1)
    coef, slope = [f"c{i}" for i in each], {(i, j): f"d{i}_{j}" for i in each for j in each}
    cells = [(i, j) for i in each for j in each if i <= j]
    # coefficients by what they belong to
    split = ", ".join([f"CASE WHEN p >= {i} THEN c{i} ELSE 0 END AS f{i}" for i in each]
                      + [f"CASE WHEN q >= {j} THEN [{', '.join(coef)}][p + {j}] ELSE 0 END AS t{j}" for j in each])
    given = ", ".join(keep + coef)
    fixed = ", ".join([given] + [f"f{i}" for i in each] + [f"t{i}" for i in each])
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in [
        *[f"e{j}" for j in each], *slope.values(), *[f"s{i}_{j}" for i, j in cells], *[f"b{i}" for i in each], "sse"])
    on = " AND ".join(f"w.{c} = r.{c}" for c in keep if c in ("series", "with_mean"))
    residual = "r.l0" + "".join(f" - w.f{i} * coalesce(r.l{i}, 0) - w.t{i} * w.e{i}" for i in each)
    own = ", ".join(
        f"CASE WHEN p >= {i} THEN l{i} WHEN p + q >= {i} THEN [{', '.join(f'e{j}' for j in each)}][{i} - p] ELSE 0 END"
        f" + {' + '.join(f't{j} * {slope[i, j]}' for j in each)} AS g{i}" for i in each)
    shifted_past = ", ".join(["e AS e1"] + [f"e{j - 1} AS e{j}" for j in each if j > 1])
    shifted_slope = ", ".join(f"{f'-g{i}' if j == 1 else slope[i, j - 1]} AS {slope[i, j]}" for i, j in slope)
    sums = ", ".join([f"s{i}_{j} + g{i} * g{j}" for i, j in cells] + [f"b{i} + g{i} * e" for i in each])
    square = [f"s{min(i, j)}_{max(i, j)}" + (f" + CAST(p + q < {i} AS INTEGER)" if i == j else "")
              + f" AS a{i - 1}_{j - 1}" for i in each for j in each]
    ctes, last = [], start
    for r in range(rounds):
        ctes.append(f"""walk{r} AS (
  SELECT {fixed}, CAST({skip} AS BIGINT) AS pos, {zeros} FROM (SELECT *, {split} FROM {last})
  UNION ALL
  SELECT {fixed}, place, {shifted_past}, {shifted_slope}, {sums}, sse + e * e FROM (
    SELECT *, {own} FROM (
      SELECT w.*, r.pos AS place, {', '.join(f'r.l{i}' for i in each)}, {residual} AS e
      FROM walk{r} w JOIN {rows} r ON {on} AND r.pos = w.pos + 1)))""")
        ctes.append(f"""equations{r} AS (
  SELECT {given}, sse, {', '.join(square)}, {', '.join(f'b{i} AS a{i - 1}_{k}' for i in each)}
  FROM walk{r} WHERE pos = n QUALIFY row_number() OVER (PARTITION BY {', '.join(keep)} ORDER BY sse) = 1)""")
        ctes += eliminate(f"moves{r}", f"equations{r}", k, k + 1, f"{given}, sse")
        if r < rounds - 1:
            ctes.append(
                f"round{r} AS (SELECT {', '.join(keep)}, "
                + ", ".join(f"c{i} + share * a{i - 1}_{k} AS c{i}" for i in each)
                + f" FROM moves{r}, (SELECT unnest({SHARES}) AS share))")
        last = f"round{r}"
    ctes.append(f"newton AS (SELECT {given}, sse, greatest({', '.join(f'abs(a{i}_{k})' for i in range(k))}) AS step"
                f" FROM moves{rounds - 1})")
    return ctes


#: Shares of a step that are tried; the least sum of squares goes on.
SHARES = "[1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.0]"
ORACLES["arma_fit_css"] = query(
    f"SELECT series, p, q, n, used AS n_used, step <= 1e-6 AS converged, {rnd('c1', 4)} AS ar1,"
    f" {rnd('c2', 4)} AS ar2, {rnd('c3', 4)} AS ar3, {rnd('c4', 4)} AS ma1, {rnd('sse / (used - 4)', 4)} AS sigma2,"
    f" {rnd('aicc', 4)} AS aicc FROM scored",
    *FILTERED, lags("wide", "filtered", "y", 11),
    normal("first_sums", "wide", "l0", LONG, "pos > 11"),
    *eliminate("first_fit", "first_sums", 10, 11),
    f"""shocks AS (
  SELECT w.*, w.l1 - {' - '.join(f'f.a{i}_10 * w.l{i + 2}' for i in range(10))} AS e1
  FROM wide w JOIN first_fit f USING (series))""",
    normal("second_sums", "shocks", "l0", ["l1", "l2", "l3", "e1"], "pos > 11"),
    *eliminate("second_fit", "second_sums", 4, 5),
    """start AS (
  SELECT series, n, 3 AS p, 1 AS q, a0_4 AS c1, a1_4 AS c2, a2_4 AS c3, a3_4 AS c4
  FROM second_fit JOIN (SELECT series, count(*) AS n FROM filtered GROUP BY 1) USING (series))""",
    *newton("start", "wide", 4, 3, ["series", "n", "p", "q"], 30),
    "fitted AS (SELECT *, n - 3 AS used, 5 AS k FROM newton)", criteria("fitted"))


def search(top: int) -> str:
    """The ``top`` best candidates with MA terms or without, refined; the best of them."""
    coef = [f"f{i}" for i in range(1, 6)] + [f"t{i}" for i in range(1, 6)]
    # plain AR candidates start from their own estimates too, where the walk begins
    ar = " UNION ALL ".join(
        f"SELECT series, with_mean, {p} AS p, 0 AS q, " + ", ".join(
            f"CAST({f'a{i}_{p}' if i < p else '0'} AS DOUBLE) AS f{i + 1}" for i in range(5)) + ", "
        + ", ".join(f"CAST(0 AS DOUBLE) AS t{i}" for i in range(1, 6))
        + (f" FROM fit{p}" if p else " FROM base") for p in range(6))
    slots = ", ".join(
        f"CASE WHEN p >= {i} THEN f{i} WHEN p + q >= {i} THEN [t1, t2, t3, t4, t5][{i} - p] ELSE 0 END AS c{i}"
        for i in range(1, 6))
    start = f"""start AS (
  SELECT series, with_mean, n, p, q, {slots}
  FROM (SELECT * FROM ranked WHERE rank <= {top}) JOIN (
    {ar} UNION ALL SELECT series, with_mean, p, q, {', '.join(coef)} FROM candidates)
  USING (series, with_mean, p, q))"""
    refined = """refined AS (
  SELECT series, with_mean, n, p, q, step, sse, n - 5 AS used, p + q + CAST(with_mean AS INTEGER) + 1 AS k FROM newton)"""
    return query(
        f"""SELECT series, p, q, with_mean, n, step <= 1e-6 AS converged, {rnd('sse / (used - k + 1)', 4)} AS sigma2,
  {rnd('aicc', 4)} AS aicc FROM rescored
QUALIFY row_number() OVER (PARTITION BY series ORDER BY aicc, p, q, with_mean) = 1""",
        *FILTERED, *ar_board(), *arma_board(), *ranked("all_orders"), start,
        *newton("start", "deep", 5, 5, ["series", "with_mean", "n", "p", "q"], 15), refined,
        criteria("refined").replace("scored AS", "rescored AS", 1))


ORACLES["order_search"] = search(1)
ORACLES["order_search_top"] = search(3)

# the same results, reached from SQL
for _name in ("lagged", "acf", "ljung_box"):
    ORACLES[f"sql_{_name}"] = ORACLES[_name]

# the same results, whatever the number of blocks
for _name in ("lagged", "acf", "arma_residuals", "arma_fit_hr", "order_leaderboard", "arma_fit_css",
              "order_leaderboard_arma"):
    ORACLES[f"{_name}_blocks"] = ORACLES[_name]
