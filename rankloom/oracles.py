"""SQL for DuckDB that gives the rows of the registered queries.

Written apart from the DataFrame code, from the same definitions. Rounding is half to even on the scaled double in both
engines, with zero added so that no negative zero shows.
"""

from __future__ import annotations

from rankloom.config import DEFAULT_GATE, DEFAULT_WEIGHTS, HORIZONS

ORACLES: dict[str, str] = {}

PX = {
    "supplier": "SELECT 'S' || l_suppkey || '.NS' AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2",
    "part": "SELECT 'P' || l_partkey || '.NS' AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2",
    "nation": "SELECT 'N' || c_nationkey || '.NS' AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "user": "SELECT 'U' || user_id || '.NS' AS ticker, CAST(ts AS DATE) AS date, max(value) AS close FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
}
for name, sql in PX.items():
    ORACLES[f"price_panel_{name}"] = sql


def rnd(x: str, places: int = 2) -> str:
    scale = f"{10**places}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale} + 0.0)"


def returns_sql(px: str) -> str:
    """CTEs px, o and rets (ticker, data_points, cmp, ret_h)."""
    at = ", ".join(f"max(CASE WHEN rn = {h + 1} THEN close END) AS p{h}" for h in (0, *HORIZONS))
    rets = ", ".join(f"{rnd(f'(p0 / nullif(p{h}, 0) - 1.0) * 100.0')} AS ret_{h}" for h in HORIZONS)
    return f"""px AS ({px}),
o AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM px WHERE close IS NOT NULL),
pts AS (SELECT ticker, {at} FROM o GROUP BY ticker),
cnt AS (SELECT ticker, count(close) AS data_points FROM px GROUP BY ticker),
rets AS (SELECT cnt.ticker, data_points, {rnd("p0")} AS cmp, {rets} FROM cnt LEFT JOIN pts ON pts.ticker = cnt.ticker)"""


def score_expr(missing_as_zero: bool) -> str:
    total = repr(sum(DEFAULT_WEIGHTS.values())) + "::DOUBLE"
    parts = [f"{f'coalesce(ret_{h}, 0.0)' if missing_as_zero else f'ret_{h}'} * ({w!r}::DOUBLE / {total})" for h, w in DEFAULT_WEIGHTS.items()]
    return " + ".join(["0.0::DOUBLE", *parts])


GATE = " AND ".join(f"coalesce(ret_{h} > 0, false)" for h in DEFAULT_GATE)
for name in ("nation", "part"):
    ORACLES[f"trailing_returns_{name}"] = f"WITH {returns_sql(PX[name])} SELECT * FROM rets"
for name, key in (("supplier", "momentum_score"), ("nation", "momentum_score_nation")):
    ORACLES[key] = f'WITH {returns_sql(PX[name])} SELECT *, {rnd(score_expr(True))} AS score, true AS "pass" FROM rets WHERE {GATE}'
ORACLES["momentum_gate"] = f"WITH {returns_sql(PX['user'])} SELECT ticker, data_points, {rnd(score_expr(True))} AS score, {GATE} AS passes FROM rets"
ORACLES["topn_candidates"] = f"WITH {returns_sql(PX['supplier'])} SELECT ticker, {rnd(score_expr(True))} AS score FROM rets WHERE {GATE} ORDER BY score DESC, ticker LIMIT 100"

ORACLES["universe_normalize"] = """
WITH raw AS (
  SELECT p_partkey, p_name AS name,
         CASE WHEN p_partkey % 50 = 0 THEN ' ' WHEN p_partkey % 51 = 0 THEN 'nan' WHEN p_partkey % 53 = 0 THEN NULL
              ELSE '  ' || lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '.ns' ELSE '' END || chr(9) END AS t
  FROM part
), clean AS (
  SELECT p_partkey, name, upper(trim(t, ' ' || chr(9))) AS ticker FROM raw
), first AS (
  SELECT ticker, min_by(name, p_partkey) AS name FROM clean WHERE ticker IS NOT NULL AND ticker NOT IN ('', 'NAN') GROUP BY ticker
)
SELECT ticker, name, CASE WHEN ticker LIKE '%.NS' THEN ticker ELSE ticker || '.NS' END AS symbol,
       'https://pages.example.com/company/' || replace(ticker, '#', '%23') || '/consolidated/' AS page_url
FROM first
"""

SUPPLIERS = "SELECT 'S' || s_suppkey AS ticker, s_name AS name FROM supplier UNION ALL SELECT 'XS' || s_suppkey, s_name FROM supplier"
ORACLES["price_status"] = f"""
WITH {returns_sql("SELECT ticker, date, CASE WHEN ticker NOT LIKE '%7.NS' THEN close END AS close FROM (" + PX["supplier"] + ")")},
u AS (SELECT ticker, name, ticker || '.NS' AS symbol FROM ({SUPPLIERS}))
SELECT u.ticker, u.symbol, u.name, cmp, coalesce(data_points, 0) AS data_points,
       CASE WHEN rets.ticker IS NULL THEN 'Ticker missing from Yahoo Finance response' WHEN data_points = 0 THEN 'No price history from Yahoo Finance' ELSE '' END AS price_error,
       ret_5, ret_252
FROM u LEFT JOIN rets ON rets.ticker = u.symbol
"""
ORACLES["nulls_last_marketcap_all"] = """
SELECT c_name AS ticker, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS market_cap_cr FROM customer
ORDER BY market_cap_cr DESC NULLS LAST, ticker
"""
ORACLES["nulls_last_marketcap"] = ORACLES["nulls_last_marketcap_all"]


def filled_sql(px: str) -> str:
    return f"""px AS ({px}),
cal AS (SELECT DISTINCT date FROM px WHERE close IS NOT NULL),
dense AS (SELECT k.ticker, cal.date, px.close FROM (SELECT DISTINCT ticker FROM px) k CROSS JOIN cal LEFT JOIN px ON px.ticker = k.ticker AND px.date = cal.date),
f AS (SELECT ticker, date, close, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM dense)"""


def recent(px: str, months: int = 6) -> str:
    return f"SELECT x.* FROM ({px}) x, (SELECT max(date) AS last FROM ({px})) m WHERE x.date > m.last - INTERVAL {months + 9} MONTH"


def schedule_sql(months: int) -> str:
    """CTE per (pid, entry, exit, signal) over cal."""
    return f"""st AS (SELECT CAST(max(date) - INTERVAL {months} MONTH AS DATE) AS s FROM cal),
anchors AS (SELECT CAST(s + to_months(CAST(k AS INTEGER)) AS DATE) AS a FROM st, range(0, {months + 1}) r(k)),
ent AS (SELECT DISTINCT (SELECT min(date) FROM cal WHERE date >= a) AS entry FROM anchors),
per0 AS (SELECT CAST(row_number() OVER (ORDER BY entry) AS INTEGER) AS pid, entry, lead(entry) OVER (ORDER BY entry) AS exit FROM ent WHERE entry IS NOT NULL),
per AS (SELECT *, (SELECT max(date) FROM cal WHERE date < entry) AS signal FROM per0 WHERE exit IS NOT NULL)"""


def walk_sql(px: str, months: int = 6) -> str:
    """CTEs up to curve: f, per, sc, pk, g, cap."""
    lags = ", ".join(f"(filled / nullif(lag(filled, {h}) OVER w, 0) - 1.0) * 100.0 AS ret_{h}" for h in DEFAULT_WEIGHTS)
    return f"""{filled_sql(recent(px, months))},
{schedule_sql(months)},
r AS (SELECT ticker, date, row_number() OVER w AS n_obs, {lags} FROM f WHERE filled IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)),
sc AS (SELECT pid, signal, ticker, {rnd(score_expr(False))} AS score FROM r JOIN per ON r.date = per.signal WHERE n_obs > {max(DEFAULT_WEIGHTS)} AND {GATE} AND {score_expr(False)} IS NOT NULL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY pid ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM sc),
pk AS (
  SELECT *, CASE WHEN n <= 5 THEN 1.0::DOUBLE / n WHEN rank <= 5 THEN 0.7::DOUBLE / 5 ELSE 0.3::DOUBLE / (n - 5) END AS weight
  FROM (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM rk WHERE rank <= 10)
),
g AS (
  SELECT pid, date, sum(weight * filled / base) AS growth FROM (
    SELECT pk.pid, f.date, pk.weight, f.filled, first_value(f.filled) OVER (PARTITION BY pk.pid, pk.ticker ORDER BY f.date) AS base
    FROM pk JOIN per ON per.pid = pk.pid JOIN f ON f.ticker = pk.ticker AND f.date BETWEEN per.entry AND per.exit
  ) WHERE base <> 0 GROUP BY pid, date HAVING sum(weight * filled / base) > 0
),
cap AS (
  SELECT pid, 100000.0 * product(e) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
         coalesce(100000.0 * product(e) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0) AS before
  FROM (SELECT pid, max_by(growth, date) AS e FROM g GROUP BY pid)
),
curve AS (SELECT date, 'Strategy' AS series, max_by(before * growth, g.pid) AS value FROM g JOIN cap ON cap.pid = g.pid GROUP BY date)"""


ORACLES["forward_fill_panel"] = f"WITH {filled_sql(PX['user'])} SELECT ticker, date, close, filled FROM f"
ORACLES["rebalance_schedule"] = f"WITH px AS ({PX['nation']}), cal AS (SELECT DISTINCT date FROM px), {schedule_sql(6)} SELECT pid, entry, exit FROM per WHERE signal IS NOT NULL"
ORACLES["signal_date_asof"] = f"""
WITH px AS ({PX["supplier"]}), cal AS (SELECT DISTINCT date FROM px), {schedule_sql(12)}
SELECT pid, per.entry, c.date AS signal FROM per ASOF JOIN cal c ON per.entry > c.date
"""
ORACLES["score_at_dates"] = f"WITH {walk_sql(PX['supplier'])} SELECT pid, signal, ticker, score FROM sc"
ORACLES["top10_per_rebalance"] = f"WITH {walk_sql(PX['supplier'])} SELECT pid, ticker, score, rank FROM pk"
ORACLES["tier_weights"] = f"WITH {walk_sql(PX['nation'])} SELECT pid, ticker, rank, weight FROM pk"
ORACLES["period_growth"] = f"WITH {walk_sql(PX['supplier'])} SELECT pid, date, {rnd('growth', 4)} AS growth FROM g"
for name, key in (("supplier", "walk_forward_curve"), ("nation", "walk_forward_curve_nation")):
    ORACLES[key] = f"WITH {walk_sql(PX[name])} SELECT date, series, {rnd('value', 4)} AS value FROM curve"
ORACLES["normalized_curve"] = f"WITH {walk_sql(PX['nation'])} SELECT date, series, {rnd('value / 100000.0 * 100.0', 4)} AS value FROM curve"


def ledger_sql(px: str, names: str | None) -> str:
    name = "n.name" if names else "CAST(NULL AS VARCHAR)"
    join = f"LEFT JOIN ({names}) n ON n.ticker = pk.ticker" if names else ""
    return f"""WITH {walk_sql(px)},
lists AS (
  SELECT pid, string_agg(replace(pk.ticker, '.NS', ''), ', ' ORDER BY rank) AS selected_tickers,
         string_agg(replace(pk.ticker, '.NS', '') || CASE WHEN coalesce({name}, '') <> '' THEN ' (' || {name} || ')' ELSE '' END, ', ' ORDER BY rank) AS selected_names
  FROM pk {join} GROUP BY pid
)
SELECT per.pid, entry AS rebalance_date, signal AS signal_date, exit AS exit_date, selected_tickers, selected_names,
       {rnd("before")} AS starting_capital, {rnd("after")} AS ending_capital, {rnd("(after / before - 1.0) * 100.0")} AS return_pct
FROM per JOIN lists ON lists.pid = per.pid JOIN cap ON cap.pid = per.pid"""


ORACLES["walk_forward_ledger"] = ledger_sql(PX["supplier"], "SELECT 'S' || s_suppkey || '.NS' AS ticker, s_name AS name FROM supplier")
ORACLES["walk_forward_ledger_nation"] = ledger_sql(PX["nation"], None)
ORACLES["benchmark_overlay"] = f"""
WITH {walk_sql(PX["supplier"])}, q AS ({PX["nation"]}),
b AS (SELECT 'First nation' AS series, 'N1.NS' AS ticker UNION ALL SELECT 'Second', 'N2.NS'),
j AS (
  SELECT b.series, c.date, last_value(q.close IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM b CROSS JOIN (SELECT DISTINCT date FROM curve) c LEFT JOIN q ON q.ticker = b.ticker AND q.date = c.date
)
SELECT date, series, {rnd("filled / first_value(filled) OVER (PARTITION BY series ORDER BY date) * 100000.0", 4)} AS value FROM j WHERE filled IS NOT NULL
"""
ORACLES["first_available_benchmark"] = f"SELECT ticker, date, close FROM ({PX['nation']}) WHERE ticker = 'N3.NS'"


def performance_sql(curves: str, ctes: str = "") -> str:
    return f"""WITH {ctes} d AS (
  SELECT series, date, value, (value / max(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1.0) * 100.0 AS draw FROM ({curves})
)
SELECT series, min(date) AS start, max(date) AS "end", {rnd("min_by(value, date)")} AS start_value, {rnd("max_by(value, date)")} AS end_value,
       {rnd("(max_by(value, date) / nullif(min_by(value, date), 0) - 1.0) * 100.0")} AS return_pct, {rnd("min(draw)")} AS max_drawdown_pct
FROM d GROUP BY series"""


ORACLES["performance_summary"] = performance_sql(f"SELECT date, ticker AS series, close AS value FROM ({PX['nation']})")
ORACLES["walk_forward_performance"] = performance_sql("SELECT * FROM curve", walk_sql(PX["supplier"]) + ",")

MOMENTUM = f"""{returns_sql(PX["supplier"])},
m AS (SELECT u.ticker, u.ticker || '.NS' AS symbol, u.name, rets.* EXCLUDE (ticker), {rnd(score_expr(True))} AS score FROM ({SUPPLIERS}) u JOIN rets ON rets.ticker = u.ticker || '.NS' WHERE {GATE}),
ten0 AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM m),
ten AS (
  SELECT *, CASE WHEN n <= 5 THEN 1.0::DOUBLE / n WHEN rank <= 5 THEN 0.7::DOUBLE / 5 ELSE 0.3::DOUBLE / (n - 5) END AS weight
  FROM (SELECT *, count(*) OVER () AS n FROM ten0 WHERE rank <= 10)
)"""
ORACLES["current_allocation"] = f"""
WITH {MOMENTUM}
SELECT rank, ticker, symbol, name, {rnd("weight", 4)} AS weight, {rnd("CASE WHEN cmp > 0 THEN cmp END")} AS cmp, {rnd("weight * 100000.0")} AS amount,
       {rnd("weight * 100000.0 / CASE WHEN cmp > 0 THEN cmp END", 4)} AS shares
FROM ten
"""
HOLD = f"""WITH {MOMENTUM}, hp AS (SELECT q.* FROM ({PX["supplier"]}) q SEMI JOIN ten ON ten.symbol = q.ticker),
{filled_sql("SELECT * FROM hp").replace("px AS (", "px2 AS (").replace("FROM px", "FROM px2").replace("JOIN px ", "JOIN px2 ").replace("px.", "px2.")},
lots AS (SELECT ten.rank, ten.symbol AS ticker, weight, e.entry, 100000.0 * weight / nullif(e.entry, 0) AS lot FROM ten JOIN (SELECT ticker, min_by(filled, date) AS entry FROM f WHERE filled IS NOT NULL GROUP BY ticker) e ON e.ticker = ten.symbol)"""
ORACLES["buy_and_hold_curve"] = f"{HOLD} SELECT date, 'Strategy' AS series, {rnd('sum(filled * lot)', 4)} AS value FROM f JOIN lots ON lots.ticker = f.ticker WHERE filled IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(*) FROM lots)"
ORACLES["buy_and_hold_holdings"] = f"{HOLD} SELECT rank, ticker, weight, {rnd('weight * 100000.0')} AS allocation, {rnd('entry')} AS entry_price, {rnd('lot', 4)} AS shares FROM lots"

NUMBER = "TRY_CAST(nullif(regexp_extract(replace(replace(replace({0}, ',', ''), '%', ''), '₹', ''), '-?[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE)"
ORACLES["parse_number"] = f"""
SELECT raw, count(*) AS n, {NUMBER.format("raw")} AS number FROM (
  SELECT p_brand AS raw FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT props FROM events
  UNION ALL SELECT '₹ 1,' || CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) || ' Cr.%' FROM customer
) GROUP BY raw
"""
ORACLES["clean_label_match"] = """
SELECT trim(regexp_replace(replace(' ' || p_type || '  + ' || p_brand || ' ', '+', ''), '\\s+', ' ', 'g')) AS label, count(*) AS n,
       lower(p_type) LIKE 'standard%' OR lower(p_type) LIKE 'promo%' OR lower(p_type) LIKE 'economy%' AS matches
FROM part GROUP BY p_type, p_brand
"""
ORACLES["last_two_growth"] = f"""
WITH q AS (
  SELECT c_nationkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY period DESC) AS k FROM q)
SELECT 'N' || c_nationkey || '.NS' AS ticker, {rnd("(max(CASE WHEN k = 1 THEN v END) / nullif(max(CASE WHEN k = 2 THEN v END), 0) - 1.0) * 100.0")} AS growth_pct FROM r GROUP BY c_nationkey
"""
WEEKS = f"""
w AS (
  SELECT user_id, event_type, strftime(date_trunc('week', CAST(ts AS DATE)), '%Y-%m-%d') AS period, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS v
  FROM events WHERE event_type IN ('purchase', 'signup') AND user_id IS NOT NULL GROUP BY 1, 2, 3
), wk AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY period DESC) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM w WHERE v IS NOT NULL),
hc AS (
  SELECT user_id, event_type, max(CASE WHEN k = 2 THEN period END) AS pp, max(CASE WHEN k = 1 THEN period END) AS lp,
         max(CASE WHEN k = 2 THEN v END) AS pv, max(CASE WHEN k = 1 THEN v END) AS lv FROM wk WHERE n >= 2 GROUP BY 1, 2
), keys AS (SELECT DISTINCT user_id FROM w)"""
FIELDS = lambda a, p: f"{a}.pp AS {p}previous_period, {a}.lp AS {p}latest_period, {rnd(f'{a}.pv')} AS {p}previous_holding_pct, {rnd(f'{a}.lv')} AS {p}latest_holding_pct, {rnd(f'{a}.lv - {a}.pv')} AS {p}holding_change_pct"
ORACLES["holding_change"] = f"""
WITH {WEEKS.strip()}
SELECT 'U' || keys.user_id AS ticker, {FIELDS("a", "fii_")}, {FIELDS("b", "dii_")}
FROM keys LEFT JOIN hc a ON a.user_id = keys.user_id AND a.event_type = 'purchase' LEFT JOIN hc b ON b.user_id = keys.user_id AND b.event_type = 'signup'
"""
STAND = """
SELECT c_name AS ticker, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS market_cap_cr, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 40 AS DOUBLE) END AS quarterly_growth_pct,
       CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 60 AS DOUBLE) END AS annual_growth_pct, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 17 - 8 AS DOUBLE) END AS promoter_change_pct
FROM customer"""
PASSED = "market_cap_cr >= {0} AND quarterly_growth_pct >= {1} AND annual_growth_pct >= {2} AND coalesce(nullif(abs(promoter_change_pct), 0), 9999) <= {3}"
ORACLES["fundamental_filter"] = f"SELECT * FROM ({STAND}) WHERE {PASSED.format(1500, 10, 15, 5)}"


def note(x: str, sign: str, bound: int, label: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'missing {label}' WHEN NOT ({x} {sign} {bound}) THEN '{label} ' || printf('%.2f', CAST({x} AS DOUBLE)) || ' fails {sign} {bound}.00' END"


CHANGE = "coalesce(nullif(abs(promoter_change_pct), 0), 9999)"
ORACLES["fundamental_notes"] = f"""
WITH s AS ({STAND})
SELECT ticker, coalesce({PASSED.format(1500, 10, 15, 5)}, false) AS fundamental_pass,
       CASE WHEN coalesce({PASSED.format(1500, 10, 15, 5)}, false) THEN 'passed' ELSE concat_ws('; ', {note("market_cap_cr", ">=", 1500, "market cap")},
         {note("quarterly_growth_pct", ">=", 10, "quarterly revenue growth")}, {note("annual_growth_pct", ">=", 15, "annual revenue growth")}, {note(CHANGE, "<=", 5, "promoter holding change")}) END AS fundamental_notes
FROM s
"""
PAGE = f"""
SELECT 'S' || s_suppkey AS ticker, CAST(trunc(s_acctbal) AS DOUBLE) AS market_cap_cr,
       {rnd("((100.0 + s_suppkey % 31) / (100.0 + s_suppkey % 7) - 1.0) * 100.0")} AS quarterly_growth_pct,
       {rnd("((200.0 + s_suppkey % 97) / (200.0 + s_suppkey % 11) - 1.0) * 100.0")} AS annual_growth_pct,
       {rnd("CAST(CAST(50 + s_suppkey % 13 AS VARCHAR) || '.35' AS DOUBLE) - CAST(CAST(50 + s_suppkey % 5 AS VARCHAR) || '.10' AS DOUBLE)")} AS promoter_change_pct
FROM supplier"""
PAGE = PAGE.replace("100.0 + s_suppkey % 31", "CAST(100 + s_suppkey % 31 AS DOUBLE)").replace("100.0 + s_suppkey % 7", "CAST(100 + s_suppkey % 7 AS DOUBLE)")
PAGE = PAGE.replace("200.0 + s_suppkey % 97", "CAST(200 + s_suppkey % 97 AS DOUBLE)").replace("200.0 + s_suppkey % 11", "CAST(200 + s_suppkey % 11 AS DOUBLE)")
ORACLES["page_fundamentals"] = PAGE
ORACLES["final_list"] = f"""
WITH {MOMENTUM}, pg AS ({PAGE}), best AS (SELECT * FROM m ORDER BY score DESC, ticker LIMIT 100)
SELECT best.ticker, score, 'passed' AS fundamental_notes, market_cap_cr, quarterly_growth_pct, annual_growth_pct, promoter_change_pct
FROM best JOIN pg ON pg.ticker = best.ticker WHERE {PASSED.format(1000, 5, 10, 5)} ORDER BY score DESC, best.ticker LIMIT 100
"""
SCAN = f"""{WEEKS.strip()},
us AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL),
scan AS (
  SELECT 'U' || us.user_id AS ticker, {FIELDS("a", "")},
         CASE WHEN keys.user_id IS NULL OR us.user_id % 10 = 5 THEN 'Page fetch failed: no page' WHEN a.lv - a.pv IS NOT NULL THEN 'ok' ELSE 'missing FII row' END AS scan_notes,
         'https://pages.example.com/company/U' || us.user_id || CASE WHEN keys.user_id IS NULL OR us.user_id % 10 = 5 THEN '/consolidated/' ELSE '/' END AS page_url
  FROM us LEFT JOIN keys ON keys.user_id = us.user_id LEFT JOIN hc a ON a.user_id = us.user_id AND a.event_type = 'purchase' AND us.user_id % 10 <> 5
)"""
ORACLES["institutional_scan"] = f"WITH {SCAN} SELECT ticker, page_url, scan_notes, previous_period, latest_period, previous_holding_pct, latest_holding_pct, holding_change_pct FROM scan"
RISING = "SELECT ticker, holding_change_pct FROM scan WHERE holding_change_pct > 0 ORDER BY holding_change_pct DESC, ticker LIMIT {0}"
ORACLES["institutional_shortlist"] = f"WITH {SCAN} {RISING.format(50)}"
ORACLES["institutional_final"] = f"""
WITH {SCAN}, top AS ({RISING.format(500)}), {returns_sql(PX["user"])}
SELECT top.ticker, {rnd(score_expr(True))} AS score, holding_change_pct FROM top JOIN rets ON rets.ticker = top.ticker || '.NS' WHERE ret_5 > 0 ORDER BY score DESC, top.ticker LIMIT 3
"""
ORACLES["scan_metrics"] = f"WITH {SCAN} SELECT count(*) AS n_tickers, count(*) FILTER (holding_change_pct > 0) AS n_rising, max(holding_change_pct) AS max_change FROM scan"
ORACLES["marketcap_enrich"] = f"""
WITH x AS (
  SELECT 's' || s_suppkey || '.ns' AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * 1e6 WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN nullif(abs(s_acctbal) * 1e6, 0) END AS market_cap FROM supplier
)
SELECT symbol, market_cap, {rnd("market_cap / 10000000.0::DOUBLE")} AS market_cap_cr FROM x
"""
SAVED = """
saved AS (
  SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 10 < 4 THEN 2 ELSE 1 END AS go, s_suppkey,
         CASE WHEN s_suppkey % 10 < 4 THEN CASE WHEN s_suppkey % 6 = 0 THEN 'Page fetch failed: busy' ELSE 'missing FII row' END
              ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'Page fetch failed: timeout' ELSE 'ok' END END AS scan_notes
  FROM supplier WHERE s_suppkey % 10 < 8
), done AS (SELECT * FROM saved WHERE scan_notes NOT LIKE 'Page fetch failed%'),
pend AS (SELECT 'S' || s_suppkey AS ticker, s_name AS name FROM supplier WHERE 'S' || s_suppkey NOT IN (SELECT ticker FROM done))"""
ORACLES["resume_pending"] = f"WITH {SAVED.strip()} SELECT ticker, name FROM pend"
ORACLES["resume_union"] = f"""
WITH {SAVED.strip()}
SELECT ticker, scan_notes, CAST(s_suppkey AS DOUBLE) AS market_cap_cr, CASE WHEN go = 1 THEN 0.5::DOUBLE END AS holding_change_pct, CAST(NULL AS VARCHAR) AS name FROM done
UNION ALL SELECT ticker, 'ok', NULL, NULL, name FROM pend
"""
ORACLES["unpivot_curve_all"] = f"SELECT date, replace(ticker, '.NS', '') AS series, close AS value FROM ({PX['nation']})"
ORACLES["unpivot_curve"] = ORACLES["unpivot_curve_all"]
ORACLES["text_bool"] = "SELECT s_suppkey, s_suppkey % 8 < 3 AS passed FROM supplier"
ORACLES["coerce_numeric"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN CAST(p_size AS DOUBLE) END AS change_pct FROM part"
ORACLES["page_urls"] = "SELECT p_partkey, 'https://pages.example.com/company/' || replace(p_brand, '#', '%23') || '%26~%2A%20%2B' || p_size || '/consolidated/' AS page_url FROM part"
ORACLES["latest_prices"] = f"SELECT ticker, max(date) AS date, max_by(close, date) AS close FROM ({PX['part']}) GROUP BY ticker"

ORACLES["html_list_items"] = """
SELECT 'S' || s_suppkey AS ticker, 'P/E 20;Market Cap ₹ ' || CAST(trunc(s_acctbal) AS BIGINT) || ' Cr.' AS items,
       'quarters:Sales +=Dec 2023 ' || (100 + s_suppkey % 7) || '|Mar 2024 ' || (100 + s_suppkey % 31)
       || ';profit-loss:Revenue +=Mar 2023 ' || (200 + s_suppkey % 11) || '|Mar 2024 ' || (200 + s_suppkey % 97) || '|TTM 9,999'
       || ';shareholding:Promoters +=Dec 2023 ' || (50 + s_suppkey % 5) || '.10%|Mar 2024 ' || (50 + s_suppkey % 13) || '.35%' AS cells
FROM supplier
"""
ORACLES["provider_prices"] = """
SELECT 'N' || n_nationkey || '.NS' AS ticker, CAST(DATE '2023-01-01' + CAST(k AS INTEGER) AS DATE) AS date, 100.0::DOUBLE + (n_nationkey + 1) * k * 0.5::DOUBLE AS close
FROM nation, range(60) r(k)
"""
ORACLES["pushed_prices"] = f"SELECT * FROM ({PX['nation']}) WHERE ticker IN ('N3.NS', 'N7.NS', 'N11.NS') AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND close > 0"
ORACLES["streamed_prices"] = f"SELECT * FROM ({PX['nation']}) WHERE close IS NOT NULL AND date BETWEEN DATE '1990-01-01' AND DATE '2010-12-31'"
ORACLES["fetched_prices"] = f"SELECT * FROM ({PX['nation']}) WHERE close IS NOT NULL AND date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"
ORACLES["flat_ticker_prices"] = f"SELECT * FROM ({PX['nation']}) WHERE ticker = 'N5.NS'"
ORACLES["wide_prices"] = f"""
WITH px AS ({PX['nation']}), d AS (SELECT DISTINCT date FROM px), n AS (SELECT 'N' || k || '.NS' AS ticker FROM range(25) r(k))
SELECT n.ticker, d.date, close FROM n, d LEFT JOIN px ON px.ticker = n.ticker AND px.date = d.date
"""
ORACLES["fetched_pages"] = """
SELECT 'S' || s_suppkey AS ticker, 'https://pages.example.com/company/S' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '/' ELSE '/consolidated/' END AS page_url,
       CAST(NULL AS VARCHAR) AS error, s_suppkey + 1.5::DOUBLE AS market_cap_cr
FROM supplier
"""
ORACLES["retried_pages"] = """
WITH s AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 = 1 ELSE s_suppkey % 7 = 0 END AS once,
         CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 = 0 ELSE s_suppkey % 21 = 0 END AS again FROM supplier
)
SELECT 'S' || s_suppkey AS ticker, CASE WHEN once AND again THEN 'HTTP status 503' END AS error, CASE WHEN once THEN 2 ELSE 1 END AS tries,
       CASE WHEN NOT (once AND again) THEN s_suppkey + 1.5::DOUBLE END AS market_cap_cr
FROM s
"""
ORACLES["fetched_market_caps"] = f"""
WITH s AS (SELECT 's' || s_suppkey || '.ns' AS symbol, CASE WHEN s_suppkey % 4 <> 0 AND CAST(s_suppkey AS VARCHAR) NOT LIKE '1%' THEN s_suppkey * 1e7::DOUBLE END AS market_cap FROM supplier)
SELECT symbol, market_cap, {rnd("market_cap / 10000000.0::DOUBLE")} AS market_cap_cr FROM s
"""
ORACLES["universe_csv"] = """
WITH raw AS (SELECT p_partkey, p_name AS name, upper(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '.NS' ELSE '' END AS ticker FROM part),
first AS (SELECT ticker, min_by(name, p_partkey) AS name FROM raw GROUP BY ticker)
SELECT ticker, name, CASE WHEN ticker LIKE '%.NS' THEN ticker ELSE ticker || '.NS' END AS symbol,
       'https://pages.example.com/company/' || replace(ticker, '#', '%23') || '/consolidated/' AS page_url
FROM first
"""
ORACLES["saved_and_exported"] = f"SELECT ticker, data_points, cmp, score, ret_5, ret_252 FROM ({ORACLES['momentum_score_nation']})"
ORACLES["holdings_run"] = ORACLES["institutional_final"]
ORACLES["full_run_final"] = ORACLES["final_list"]
ORACLES["recovered_run"] = f"""
WITH fl AS ({ORACLES["final_list"]}), {MOMENTUM}, best AS (SELECT ticker, score FROM m ORDER BY score DESC, ticker LIMIT 100)
SELECT ticker, score FROM fl UNION ALL SELECT ticker, score FROM best WHERE NOT EXISTS (SELECT 1 FROM fl)
"""
ORACLES["exact_notes"] = f"""
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice / 8 AS market_cap_cr, l_quantity / 40 AS quarterly_growth_pct, l_tax * 12.5::DOUBLE AS annual_growth_pct, l_discount * 1000.125::DOUBLE AS promoter_change_pct FROM lineitem
)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce({PASSED.format(1000000, 10, 15, 5)}, false) THEN 'passed' ELSE concat_ws('; ', {note("market_cap_cr", ">=", 1000000, "market cap")},
         {note("quarterly_growth_pct", ">=", 10, "quarterly revenue growth")}, {note("annual_growth_pct", ">=", 15, "annual revenue growth")}, {note(CHANGE, "<=", 5, "promoter holding change")}) END AS fundamental_notes
FROM s
"""
OTHER_SCAN = SCAN.replace("'purchase' AND us.user_id", "'signup' AND us.user_id").replace("missing FII row", "missing DII row")
ORACLES["dii_holdings_run"] = f"""
WITH {OTHER_SCAN}, top AS ({RISING.format(500)}), {returns_sql(PX["user"])}
SELECT top.ticker, {rnd(score_expr(True))} AS score, holding_change_pct FROM top JOIN rets ON rets.ticker = top.ticker || '.NS' WHERE ret_5 > 0 ORDER BY score DESC, top.ticker LIMIT 3
"""
ORACLES["saved_scan_counts"] = f"WITH {SCAN} SELECT count(*) AS n_tickers, count(*) FILTER (holding_change_pct > 0) AS n_rising, count(*) FILTER (scan_notes LIKE 'Page fetch failed%') AS n_failed, max(holding_change_pct) AS max_change FROM scan"
ORACLES["saved_momentum_fallback"] = f"WITH {MOMENTUM} SELECT ticker, score FROM m ORDER BY score DESC, ticker LIMIT 40"
BEST = f"SELECT ticker || '.NS' AS ticker FROM ({ORACLES['saved_momentum_fallback'].replace('LIMIT 40', 'LIMIT 10')})"
ORACLES["bare_run_counts"] = f"""
WITH {walk_sql("SELECT * FROM (" + PX["supplier"] + ") WHERE ticker IN (" + BEST + ")", 36)}, mom AS ({ORACLES["momentum_score"]})
SELECT 'momentum' AS name, count(*) AS n FROM mom
UNION ALL SELECT 'fundamentals', 0 UNION ALL SELECT 'final', least(10, (SELECT count(*) FROM mom)) UNION ALL SELECT 'allocation', least(10, (SELECT count(*) FROM mom))
UNION ALL SELECT 'periods', (SELECT count(*) FROM per JOIN (SELECT DISTINCT pid FROM pk) USING (pid) JOIN cap USING (pid))
UNION ALL SELECT 'performance', (SELECT count(DISTINCT series) FROM curve)
"""
GATED = f"WITH {returns_sql(PX['supplier'])} SELECT ticker FROM rets WHERE {GATE}"
ORACLES["backtest_of_picks"] = f"""
WITH {walk_sql("SELECT * FROM (" + PX["supplier"] + ") WHERE ticker IN (" + GATED + ")")} SELECT date, series, {rnd("value", 4)} AS value FROM curve
"""

ORACLES["segmented_event_values"] = """
WITH e AS (
  SELECT CASE WHEN event_id % 10 < 9 THEN 'HOT.NS' ELSE 'U' || user_id || '.NS' END AS ticker, ts, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events
)
SELECT ticker, event_id, value, last_value(value IGNORE NULLS) OVER w AS filled, first_value(value IGNORE NULLS) OVER w AS base, max(value) OVER w AS top, count(value) OVER w AS n_known
FROM e WINDOW w AS (PARTITION BY ticker ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
ORACLES["asof_nation_prices"] = """
WITH d AS (
  SELECT s_nationkey AS nation, CAST(l_shipdate AS DATE) AS shipped, max(l_extendedprice / l_quantity) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), o AS (
  SELECT o_orderkey, c_nationkey AS nation, CAST(o_orderdate AS DATE) AS ordered FROM orders JOIN customer ON o_custkey = c_custkey
)
SELECT o.o_orderkey, o.nation, o.ordered, b.shipped, b.price, a.shipped AS next_shipped, a.price AS next_price
FROM o ASOF LEFT JOIN d b ON o.nation = b.nation AND o.ordered >= b.shipped ASOF LEFT JOIN d a ON o.nation = a.nation AND o.ordered < a.shipped
"""
ORACLES["period_prices"] = f"""
WITH px AS ({PX["supplier"]}), cal AS (SELECT DISTINCT date FROM px), {schedule_sql(12)}
SELECT pid, ticker, count(close) AS n, min(close) AS low, max(close) AS high FROM per JOIN px ON px.date BETWEEN per.entry AND per.exit WHERE signal IS NOT NULL GROUP BY pid, ticker
"""

#: The columns that are dates; results show them as ISO text.
DATES = {
    ("date",): ("price_panel_supplier", "price_panel_nation", "price_panel_part", "price_panel_user", "forward_fill_panel", "period_growth", "walk_forward_curve", "walk_forward_curve_nation",
                "benchmark_overlay", "first_available_benchmark", "normalized_curve", "buy_and_hold_curve", "unpivot_curve", "unpivot_curve_all", "latest_prices",
                "provider_prices", "wide_prices", "backtest_of_picks", "pushed_prices", "streamed_prices", "fetched_prices", "flat_ticker_prices"),
    ("ordered", "shipped", "next_shipped"): ("asof_nation_prices",),
    ("entry", "exit"): ("rebalance_schedule",),
    ("entry", "signal"): ("signal_date_asof",),
    ("signal",): ("score_at_dates",),
    ("rebalance_date", "signal_date", "exit_date"): ("walk_forward_ledger", "walk_forward_ledger_nation"),
    ("start", "end"): ("performance_summary", "walk_forward_performance"),
}
for columns, keys in DATES.items():
    for key in keys:
        shown = ", ".join(f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in columns)
        ORACLES[key] = f"SELECT * REPLACE ({shown}) FROM ({ORACLES[key]})"
