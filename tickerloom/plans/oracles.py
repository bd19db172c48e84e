"""SQL statements that must give the same rows as the registered queries.

They are written independently of the operators: recursions instead of prefix sums, built-in
quantiles and ranks instead of ranges, plain window ranks over whole cross-sections.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needed(sql: str, found: list[str]) -> None:
    for name in CTES:
        if re.search(rf"\b{name}\b", sql) and name not in found:
            _needed(re.sub(rf"\b{name}\b", "", CTES[name]), found)
            if name not in found:
                found.append(name)


def _nudged(sql: str) -> str:
    """``round(x, d) + 0.0`` becomes ``round(x + nudge, d) + 0.0``, the nudge being a fixed small part of
    the last digit: sums that lie exactly between two digits differ in their last bit by engine."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, at + 6
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        if comma > 0 and sql[i:i + 6] == " + 0.0":
            digits = int(sql[comma + 1:i - 1])
            sql = f"{sql[:at]}round(({sql[at + 6:comma]}) + 1.37e-{digits + 1}{sql[comma:]}"
        at += 6
    return sql


def oracle(name: str, sql: str) -> None:
    sql = _nudged(sql)
    parts: list[str] = []
    _needed(sql, parts)
    with_ = ",\n".join(f"{p} AS MATERIALIZED (\n{CTES[p]}\n)" for p in parts)
    ORACLES[name] = (f"WITH RECURSIVE {with_}\n{sql}" if parts else sql)


def r(columns: str, digits: int = 8) -> str:
    """``a b c`` to rounded output columns; ``a=expr`` names an expression."""
    out = []
    for c in columns.split():
        out.append(f"round({c}, {digits}) + 0.0 AS {c}")
    return ", ".join(out)


# ---- panel -------------------------------------------------------------------------------------

cte("bars", """
SELECT date, symbol, least(greatest(mean, low), high) AS open, high, low,
       least(greatest(turnover / volume, low), high) AS close,
       least(greatest(turnover / volume, low), high) * CASE WHEN even THEN 0.98::DOUBLE ELSE 1.0::DOUBLE END AS adjusted_close,
       volume, CASE WHEN even THEN 'alpha_vantage' ELSE 'twelve_data' END AS provider
FROM (SELECT l_shipdate::DATE AS date, 'S' || lpad(l_suppkey::VARCHAR, 10, '0') AS symbol, l_suppkey % 2 = 0 AS even,
             avg(p) AS mean, max(p) AS high, min(p) AS low, sum(p * l_quantity) AS turnover, sum(l_quantity) AS volume
      FROM (SELECT *, 50.0::DOUBLE + l_extendedprice / 1000 AS p FROM lineitem)
      GROUP BY ALL)""")
cte("mkt_bars", """
SELECT date, 'MKT' AS symbol, avg(open) AS open, max(high) AS high, min(low) AS low, avg(close) AS close,
       avg(close) AS adjusted_close, sum(volume) AS volume, 'twelve_data' AS provider
FROM bars WHERE isodow(date) <= 5 GROUP BY date""")
cte("panel", "SELECT * FROM bars UNION ALL BY NAME SELECT * FROM mkt_bars")
cte("basis", """
SELECT date, symbol, provider, volume, adjusted_close,
       CASE WHEN provider = 'alpha_vantage' THEN close END AS unadjusted_close, adjusted_close AS close
FROM panel""")
cte("ret", """
SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close) - ln(lag(close) OVER w) AS log_return,
       close - lag(close) OVER w AS move, row_number() OVER w AS rn
FROM basis WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
cte("ema", """
SELECT symbol, rn, close AS y FROM ret WHERE rn = 1
UNION ALL
SELECT t.symbol, t.rn, (1 - 2.0::DOUBLE / 21) * e.y + (2.0::DOUBLE / 21) * t.close
FROM ema e JOIN ret t ON t.symbol = e.symbol AND t.rn = e.rn + 1""")
cte("rsi_state", """
SELECT symbol, 15::BIGINT AS rn, avg(greatest(move, 0)) AS g, avg(greatest(-move, 0)) AS l
FROM ret WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
UNION ALL
SELECT t.symbol, t.rn, (13 * s.g + greatest(t.move, 0)) / 14, (13 * s.l + greatest(-t.move, 0)) / 14
FROM rsi_state s JOIN ret t ON t.symbol = s.symbol AND t.rn = s.rn + 1""")
cte("rsi", """
SELECT symbol, rn, CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0
                        ELSE 100 - 100 / (1 + g / l) END AS rsi_14
FROM rsi_state""")
cte("windowed", """
SELECT *, min(drawdown) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS max_drawdown_to_date
FROM (SELECT *,
        CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20,
        CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50,
        CASE WHEN count(log_return) OVER w20 = 20 THEN stddev_samp(log_return) OVER w20 * sqrt(252) END
          AS volatility_20d_annualized,
        close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
        close / lag(close, 21) OVER w - 1 AS momentum_21d, least(rn - 1, 21) AS momentum_21d_n_obs,
        close / lag(close, 63) OVER w - 1 AS momentum_63d, least(rn - 1, 63) AS momentum_63d_n_obs,
        close / lag(close, 126) OVER w - 1 AS momentum_126d, least(rn - 1, 126) AS momentum_126d_n_obs
      FROM ret
      WINDOW w AS (PARTITION BY symbol ORDER BY date),
             w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING),
             w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING))""")
cte("feats", """
SELECT w.*, CASE WHEN w.rn >= 20 THEN e.y END AS ema_20, s.rsi_14
FROM windowed w LEFT JOIN ema e USING (symbol, rn) LEFT JOIN rsi s USING (symbol, rn)""")
cte("valid_market", "SELECT date, simple_return AS bs, log_return AS bl FROM ret WHERE symbol = 'MKT' AND simple_return IS NOT NULL")
cte("aligned", """
SELECT r.symbol, r.date, r.simple_return, r.log_return, m.bs AS benchmark_simple_return, m.bl AS benchmark_log_return
FROM ret r JOIN valid_market m USING (date) WHERE r.symbol <> 'MKT' AND r.simple_return IS NOT NULL""")
_BETA = ", ".join(
    f"""CASE WHEN count(*) OVER w{n} = {n} THEN covar_samp(simple_return, benchmark_simple_return) OVER w{n}
        / nullif(var_samp(benchmark_simple_return) OVER w{n}, 0) END AS beta_{n},
        count(*) OVER w{n} AS beta_{n}_n_obs,
        CASE WHEN count(*) OVER w{n} = {n} THEN var_samp(benchmark_simple_return) OVER w{n} END AS benchmark_variance_{n}"""
    for n in (60, 126, 252)
)
_BW = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (60, 126, 252))
cte("beta", f"SELECT symbol, date, {_BETA} FROM aligned WINDOW {_BW}")
cte("last_beta", "SELECT * FROM beta QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
cte("last_feat", "SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")

# ---- filings -----------------------------------------------------------------------------------

cte("qtr", """
SELECT symbol, ps, (ps + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS pe, year(ps) AS y, quarter(ps) AS q, n, ext, rev, qty,
       rev - ext * ((qty / n - 15) / 20) AS income,
       'CY' || year(ps) || 'Q' || quarter(ps) AS frame, CASE WHEN quarter(ps) = 4 THEN '10-K' ELSE '10-Q' END AS form
FROM (SELECT 'S' || lpad(l_suppkey::VARCHAR, 10, '0') AS symbol, date_trunc('quarter', l_shipdate)::DATE AS ps, count(*) AS n,
             sum(l_extendedprice) AS ext, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity) AS qty
      FROM lineitem GROUP BY ALL)""")


def _fact(cond: str, tag: str, unit: str, val: str, seq: int, instant: bool = False, late: bool = False) -> str:
    filed = "pe + 45" if not late else "((pe + 45) + INTERVAL 12 MONTH)::DATE"
    return (
        f"SELECT symbol, '{tag}' AS tag, '{unit}' AS unit, {val} AS val, {'NULL::DATE' if instant else 'ps'} AS period_start, "
        f"pe AS period_end, {filed} AS filed, {chr(39) + '10-K' + chr(39) if late else 'form'} AS form, "
        f"{'frame || ' + chr(39) + 'I' + chr(39) if instant else 'frame'} AS frame, {seq} AS seq FROM qtr WHERE {cond}"
    )


cte("facts", "\nUNION ALL ".join([
    _fact("n >= 12", "Revenues", "USD", "rev", 0),
    _fact("n >= 25", "Revenues", "USD", "rev * 1.01::DOUBLE", 1, late=True),
    _fact("n < 12 OR n >= 20", "SalesRevenueNet", "USD", "rev * 0.9::DOUBLE", 0),
    _fact("n >= 15", "NetIncomeLoss", "USD", "income", 0),
    _fact("true", "Assets", "USD", "ext * 3", 0, instant=True),
    _fact("n >= 15", "StockholdersEquity", "USD", "ext * 1.2::DOUBLE", 0, instant=True),
    _fact("n >= 22", "Liabilities", "USD", "ext * 1.8::DOUBLE", 0, instant=True),
    _fact("n >= 10", "EarningsPerShareDiluted", "USD/shares", "income / 100000", 0),
    """SELECT symbol, 'Revenues', 'USD', ytd, make_date(y, 1, 1), pe, pe + 45, form, NULL, 2
       FROM (SELECT *, sum(rev) OVER (PARTITION BY symbol, y ORDER BY q) AS ytd FROM qtr) WHERE q > 1""",
]))
cte("metric_tags", """
SELECT * FROM (VALUES
 ('revenue', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'USD', 0), ('revenue', 'Revenues', 'USD', 1),
 ('revenue', 'SalesRevenueNet', 'USD', 2), ('net_income', 'NetIncomeLoss', 'USD', 0), ('net_income', 'ProfitLoss', 'USD', 1),
 ('assets', 'Assets', 'USD', 0), ('liabilities', 'Liabilities', 'USD', 0), ('equity', 'StockholdersEquity', 'USD', 0),
 ('equity', 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest', 'USD', 1),
 ('eps_diluted', 'EarningsPerShareDiluted', 'USD/shares', 0)) AS t(metric, tag, unit, prio)""")
cte("ranked_facts", """
SELECT f.*, metric, prio, CASE WHEN regexp_full_match(coalesce(frame, ''), 'CY\\d{4}Q[1-4]I?') THEN 2
                               WHEN frame IS NOT NULL THEN 1 ELSE 0 END AS pool
FROM facts f JOIN metric_tags USING (tag, unit)""")
_BEST = "ORDER BY pool DESC, period_end DESC, filed DESC, prio, seq"


def _snapshot(as_of: str) -> str:
    return f"""
SELECT symbol, metric, val, period_end, filed, form, tag FROM ranked_facts WHERE filed <= {as_of}
QUALIFY row_number() OVER (PARTITION BY symbol, metric {_BEST}) = 1"""


def _quarters(tags: list[str], as_of: str | None = None) -> str:
    prio = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tags))
    names = ", ".join(f"'{t}'" for t in tags)
    limit = f"AND filed <= {as_of}" if as_of else ""
    return f"""
SELECT symbol, regexp_extract(frame, 'CY(\\d{{4}})Q([1-4])', 1)::INT AS year, regexp_extract(frame, 'CY(\\d{{4}})Q([1-4])', 2)::INT AS quarter,
       val, period_start, period_end, filed, form, tag, frame
FROM facts WHERE tag IN ({names}) AND unit = 'USD' AND regexp_full_match(coalesce(frame, ''), 'CY\\d{{4}}Q[1-4]I?') {limit}
QUALIFY row_number() OVER (PARTITION BY symbol, year, quarter ORDER BY CASE tag {prio} END, filed DESC, seq) = 1"""


_REV = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenuesNetOfInterestExpense"]
_INC = ["NetIncomeLoss", "ProfitLoss"]
cte("last_day", "SELECT max(date) AS last_day FROM panel")
cte("rev_q", _quarters(_REV))
cte("inc_q", _quarters(_INC))
cte("rev_known", _quarters(_REV, "(SELECT * FROM last_day)"))
cte("inc_known", _quarters(_INC, "(SELECT * FROM last_day)"))
cte("all_stocks", "SELECT 'S' || lpad(s_suppkey::VARCHAR, 10, '0') AS symbol, * FROM supplier")
cte("yoy_q", """
SELECT r.*, p.val AS prior_val, CASE WHEN p.val > 0 THEN r.val / p.val - 1 END AS growth_yoy,
       'CY' || (r.year - 1) || 'Q' || r.quarter AS comparison_frame
FROM rev_q r LEFT JOIN rev_q p ON p.symbol = r.symbol AND p.year = r.year - 1 AND p.quarter = r.quarter""")
cte("growth", """
SELECT s.symbol, CASE WHEN p.val > 0 THEN l.val / p.val - 1 END AS revenue_growth_yoy,
       CASE WHEN i.val IS NOT NULL AND l.val <> 0 THEN i.val / l.val END AS profit_margin,
       l.val AS latest_revenue, CASE WHEN p.val > 0 THEN p.val END AS prior_year_revenue,
       CASE WHEN l.val <> 0 THEN i.val END AS latest_net_income, coalesce(l.frame, '') AS latest_frame,
       coalesce('CY' || (l.year - 1) || 'Q' || l.quarter, '') AS comparison_frame, coalesce(l.tag, '') AS revenue_tag,
       coalesce(CASE WHEN l.val <> 0 THEN i.tag END, '') AS net_income_tag, l.period_start, l.period_end,
       coalesce(p.val > 0, false) AS revenue_growth_available, (i.val IS NOT NULL AND l.val <> 0) AS profit_margin_available,
       coalesce(l.val <> 0 AND abs(i.val / l.val) > 0.75, false) AS unusual_margin_flag,
       CASE WHEN l.frame IS NULL THEN 'no SEC-framed standalone quarterly revenue' ELSE concat_ws('; ',
         CASE WHEN NOT coalesce(p.val > 0, false) THEN 'same-quarter prior-year revenue unavailable or nonpositive' END,
         CASE WHEN i.val IS NULL OR l.val = 0 THEN 'same-period quarterly net income unavailable or revenue zero'
              WHEN abs(i.val / l.val) > 0.75 THEN 'absolute quarterly profit margin exceeds 75%; review source fact' END) END AS quality_note
FROM all_stocks s
LEFT JOIN (SELECT * FROM rev_known QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC, quarter DESC) = 1) l USING (symbol)
LEFT JOIN rev_known p ON p.symbol = l.symbol AND p.year = l.year - 1 AND p.quarter = l.quarter
LEFT JOIN inc_known i ON i.symbol = l.symbol AND i.period_start = l.period_start AND i.period_end = l.period_end""")
_M = ["revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted"]


def _wide(source: str) -> str:
    cols = ", ".join(
        f"max({c}) FILTER (metric = '{m}') AS {m}{s}"
        for m in _M for c, s in (("val", ""), ("period_end", "_period_end"), ("filed", "_filed"), ("form", "_form"), ("tag", "_tag"))
    )
    return f"SELECT symbol, {cols} FROM {source} GROUP BY symbol"


cte("snap", _snapshot("(SELECT * FROM last_day)"))
cte("snap_wide", _wide("snap"))
cte("fund", """
SELECT s.* REPLACE (CASE WHEN derive THEN assets - equity ELSE liabilities END AS liabilities),
       n.s_name AS company_name, n.s_nationkey, t.n_name AS sic_description, 'X' || t.n_regionkey AS exchange
FROM (SELECT *, liabilities IS NULL AND assets IS NOT NULL AND equity IS NOT NULL
             AND coalesce(assets_period_end = equity_period_end, false) AS derive FROM snap_wide) s
JOIN all_stocks n USING (symbol) JOIN nation t ON n.s_nationkey = t.n_nationkey""")
cte("valuation", """
SELECT symbol, pe AS pe_ratio_raw, eps AS provider_eps_ttm, CASE WHEN pe > 0 AND eps > 0 THEN pe END AS pe_ratio,
       coalesce(pe > 0 AND eps > 0, false) AS pe_is_meaningful,
       CASE WHEN eps IS NULL THEN 'provider EPS missing' WHEN eps <= 0 THEN 'provider EPS nonpositive'
            WHEN pe IS NULL THEN 'provider P/E missing' WHEN pe <= 0 THEN 'provider P/E nonpositive' ELSE '' END AS pe_exclusion_reason, beta
FROM (SELECT symbol, CASE WHEN s_nationkey > 3 THEN s_acctbal / 250 + s_nationkey - 4 END AS pe,
             CASE WHEN s_nationkey <> 4 THEN s_acctbal / 1000 END AS eps,
             CASE WHEN s_nationkey <> 5 THEN s_nationkey / 10.0::DOUBLE END AS beta FROM all_stocks)""")
cte("master", """
SELECT f.symbol, f.date, f.close, f.adjusted_close, f.simple_return, f.sma_20, f.sma_50, f.ema_20, f.rsi_14,
       f.volatility_20d_annualized, f.drawdown, f.max_drawdown_to_date, f.symbol = 'MKT' AS is_benchmark,
       u.company_name, u.s_nationkey::VARCHAR AS sic, u.sic_description, CASE WHEN u.symbol IS NOT NULL THEN '1231' END AS fiscal_year_end, u.exchange, u.revenue, u.net_income, u.assets, u.liabilities, u.equity, u.eps_diluted,
       b.beta_60, b.beta_60_n_obs, b.beta_126, b.beta_126_n_obs, b.beta_252, b.beta_252_n_obs,
       f.momentum_21d, f.momentum_63d, f.momentum_126d, f.momentum_21d_n_obs, f.momentum_63d_n_obs, f.momentum_126d_n_obs,
       g.revenue_growth_yoy, g.profit_margin, g.latest_frame, g.comparison_frame, g.quality_note,
       g.unusual_margin_flag, u.company_name IS NOT NULL AS has_fundamentals, b.beta_252 IS NOT NULL AS has_beta,
       f.momentum_126d IS NOT NULL AS has_momentum, g.revenue_growth_yoy IS NOT NULL AS has_growth
FROM last_feat f LEFT JOIN fund u USING (symbol) LEFT JOIN last_beta b USING (symbol) LEFT JOIN growth g USING (symbol)""")

# The same on the last day of every quarter.
cte("quarter_days", "SELECT DISTINCT (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS as_of FROM panel")
cte("asked_days", "SELECT symbol, as_of FROM (SELECT DISTINCT symbol FROM panel) CROSS JOIN quarter_days")
cte("then_feat", "SELECT a.as_of, f.* FROM asked_days a ASOF JOIN feats f ON f.symbol = a.symbol AND f.date <= a.as_of")
cte("then_beta", "SELECT a.as_of, b.* FROM asked_days a ASOF JOIN beta b ON b.symbol = a.symbol AND b.date <= a.as_of")
cte("then_snap", f"""
SELECT as_of, symbol, metric, val, period_end, filed, form, tag FROM ranked_facts JOIN quarter_days ON filed <= as_of
QUALIFY row_number() OVER (PARTITION BY as_of, symbol, metric {_BEST}) = 1""")
cte("then_wide", _wide("then_snap").replace("SELECT symbol,", "SELECT as_of, symbol,").replace("GROUP BY symbol", "GROUP BY as_of, symbol"))
cte("then_fund", CTES["fund"].replace("snap_wide", "then_wide"))


def _quarters_then(tags: list[str]) -> str:
    once = _quarters(tags)
    return once.replace("SELECT symbol,", "SELECT as_of, symbol,").replace("FROM facts WHERE", "FROM facts JOIN quarter_days ON filed <= as_of WHERE").replace(
        "PARTITION BY symbol,", "PARTITION BY as_of, symbol,")


cte("then_rev", _quarters_then(_REV))
cte("then_inc", _quarters_then(_INC))
_GROWTH_HEAD, _GROWTH_FROM = CTES["growth"].split("FROM all_stocks s")
cte("then_growth", _GROWTH_HEAD.replace("SELECT s.symbol,", "SELECT s.as_of, s.symbol,") + """
FROM (SELECT as_of, symbol FROM all_stocks CROSS JOIN quarter_days) s
LEFT JOIN (SELECT * FROM then_rev QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY year DESC, quarter DESC) = 1) l USING (as_of, symbol)
LEFT JOIN then_rev p ON p.as_of = l.as_of AND p.symbol = l.symbol AND p.year = l.year - 1 AND p.quarter = l.quarter
LEFT JOIN then_inc i ON i.as_of = l.as_of AND i.symbol = l.symbol AND i.period_start = l.period_start AND i.period_end = l.period_end""")
cte("then_master", CTES["master"].replace("SELECT f.symbol,", "SELECT f.as_of, f.symbol,").split("FROM last_feat")[0] + """
FROM then_feat f LEFT JOIN then_fund u USING (as_of, symbol) LEFT JOIN then_beta b USING (as_of, symbol) LEFT JOIN then_growth g USING (as_of, symbol)""")

# ---- transform and scores ----------------------------------------------------------------------

_WF = ["beta_252", "momentum_21d", "momentum_63d", "momentum_126d", "volatility_20d_annualized",
       "revenue_growth_yoy", "profit_margin", "pe_ratio"]
cte("valued", "SELECT m.*, v.* EXCLUDE (symbol) FROM master m LEFT JOIN valuation v USING (symbol)")
cte("bounds", "SELECT " + ", ".join(
    f"quantile_cont({f}, 0.05) FILTER (NOT is_benchmark) AS {f}_lo, quantile_cont({f}, 0.95) FILTER (NOT is_benchmark) AS {f}_hi"
    for f in _WF) + " FROM valued")
cte("trans", "SELECT v.*, " + ", ".join(
    f"""CASE WHEN NOT is_benchmark AND {f} IS NOT NULL THEN greatest(least({f}, {f}_hi), {f}_lo) END AS {f}_winsorized,
    coalesce(NOT is_benchmark AND ({f} < {f}_lo OR {f} > {f}_hi), false) AS {f}_outlier_flag""" for f in _WF)
    + " FROM valued v, bounds")
_POLICY = {
    "momentum_21d": ("momentum_21d_winsorized", "higher", "momentum_21d_score"),
    "momentum_63d": ("momentum_63d_winsorized", "higher", "momentum_63d_score"),
    "momentum_126d": ("momentum_126d_winsorized", "higher", "momentum_126d_score"),
    "revenue_growth_yoy": ("revenue_growth_yoy_winsorized", "higher", "growth_score"),
    "profit_margin": ("profit_margin_winsorized", "higher", "profitability_score"),
    "pe_ratio": ("pe_ratio_winsorized", "lower", "valuation_score"),
    "drawdown": ("drawdown", "higher", "drawdown_resilience_score"),
    "beta_252": ("beta_252_winsorized", "descriptive", None),
    "volatility_20d_annualized": ("volatility_20d_annualized_winsorized", "descriptive", None),
    "rsi_14": ("rsi_14", "descriptive", None),
}
_pct = []
for _f, (_s, _d, _score) in _POLICY.items():
    pos = (f"CASE WHEN {_s} IS NOT NULL THEN rank() OVER (ORDER BY {_s} ASC NULLS LAST) "
           f"+ (count(*) OVER (PARTITION BY {_s}) - 1) / 2.0::DOUBLE END")
    _pct += [f"{_f} AS {_f}_raw", f"{pos} AS {_f}_rank_position", f"({pos}) / count({_s}) OVER () * 100 AS {_f}_percentile",
             f"CASE WHEN {_s} IS NOT NULL THEN count({_s}) OVER () END AS {_f}_eligible_count"]
    if _d == "higher":
        _pct.append(f"({pos}) / count({_s}) OVER () * 100 AS {_score}")
    elif _d == "lower":
        _pct.append(f"100 - ({pos}) / count({_s}) OVER () * 100 AS {_score}")
cte("pctl", "SELECT symbol, date, " + ", ".join(_pct) + " FROM trans WHERE NOT is_benchmark")
cte("subs", """
SELECT *, 0.2 * momentum_21d_score + 0.4 * momentum_63d_score + 0.4 * momentum_126d_score AS momentum_subscore,
       0.5 * growth_score + 0.5 * profitability_score AS quality_subscore, valuation_score AS valuation_subscore,
       0.5 * (growth_score IS NOT NULL)::INT + 0.5 * (profitability_score IS NOT NULL)::INT AS quality_subscore_coverage
FROM pctl""")
cte("covered", """
SELECT *, (momentum_subscore IS NOT NULL)::BIGINT + (quality_subscore IS NOT NULL)::BIGINT + (valuation_subscore IS NOT NULL)::BIGINT AS parts,
       (4 * (momentum_subscore IS NOT NULL)::INT + 4 * (quality_subscore IS NOT NULL)::INT + 2 * (valuation_subscore IS NOT NULL)::INT) / 10.0::DOUBLE AS score_coverage,
       4 * coalesce(momentum_subscore, 0) + 4 * coalesce(quality_subscore, 0) + 2 * coalesce(valuation_subscore, 0) AS total
FROM subs""")
cte("scored", """
SELECT *, CASE WHEN score_coverage > 0 THEN total / 10 / score_coverage END AS composite_score, parts < 3 AS incomplete_score_flag,
       score_coverage >= 0.8 AS score_eligible FROM covered""")


cte("then_valued", "SELECT m.*, v.* EXCLUDE (symbol) FROM then_master m LEFT JOIN valuation v USING (symbol)")
cte("then_bounds", CTES["bounds"].replace("SELECT ", "SELECT as_of, ", 1).replace("FROM valued", "FROM then_valued GROUP BY as_of"))
cte("then_trans", CTES["trans"].replace("FROM valued v, bounds", "FROM then_valued v JOIN then_bounds b USING (as_of)"))
cte("then_pctl", CTES["pctl"].replace("SELECT symbol, date,", "SELECT as_of, symbol, date,").replace("OVER (ORDER BY", "OVER (PARTITION BY as_of ORDER BY")
    .replace("OVER (PARTITION BY ", "OVER (PARTITION BY as_of, ").replace("as_of, as_of ORDER", "as_of ORDER").replace("OVER ()", "OVER (PARTITION BY as_of)")
    .replace("FROM trans", "FROM then_trans"))
cte("then_subs", CTES["subs"].replace("FROM pctl", "FROM then_pctl"))
cte("then_covered", CTES["covered"].replace("FROM subs", "FROM then_subs"))
cte("then_scored", CTES["scored"].replace("FROM covered", "FROM then_covered"))


def _label(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'Unavailable' WHEN {c} >= 80 THEN 'Strong' WHEN {c} >= 60 THEN 'Positive' "
            f"WHEN {c} >= 40 THEN 'Neutral' WHEN {c} >= 20 THEN 'Weak' ELSE 'Very Weak' END")


cte("labelled", f"""
SELECT *, {_label('momentum_subscore')} AS momentum_label, {_label('quality_subscore')} AS fundamentals_label,
       {_label('valuation_subscore')} AS valuation_label, {_label('composite_score')} AS overall_label,
       CASE WHEN composite_score IS NULL THEN 'Unavailable'
            WHEN incomplete_score_flag THEN {_label('composite_score')} || ' (Incomplete: ' || round(score_coverage * 100)::INT || '% coverage)'
            ELSE {_label('composite_score')} END AS overall_display_label,
       score_eligible AND composite_score IS NOT NULL AS signal_is_eligible,
       CASE WHEN NOT (score_eligible AND composite_score IS NOT NULL) THEN 'Below minimum score coverage; do not rank'
            WHEN incomplete_score_flag THEN 'Composite renormalized because one or more sub-scores are unavailable'
            ELSE 'Full intended score coverage' END AS signal_note
FROM scored""")
cte("ranked_scores", """
SELECT l.*, k.score_rank FROM labelled l LEFT JOIN
  (SELECT symbol, rank() OVER (ORDER BY composite_score DESC) AS score_rank FROM labelled WHERE signal_is_eligible) k USING (symbol)""")
_SIGNAL = """CASE WHEN rsi_14 IS NULL OR sma_50 IS NULL THEN 'Insufficient history' WHEN rsi_14 >= 70 THEN 'Overbought'
 WHEN rsi_14 <= 30 THEN 'Oversold' WHEN close > sma_50 AND rsi_14 >= 50 THEN 'Bullish'
 WHEN close < sma_50 AND rsi_14 < 50 THEN 'Bearish' ELSE 'Neutral' END"""
cte("screener", f"""
SELECT m.symbol, m.date, m.close, m.adjusted_close, m.rsi_14, m.sma_20, m.sma_50,
       CASE WHEN m.symbol = 'MKT' THEN 'All suppliers' ELSE m.company_name END AS company_name,
       CASE WHEN m.symbol = 'MKT' THEN 'Benchmark index' ELSE m.sic_description END AS sic_description,
       {_SIGNAL} AS signal, coalesce(m.close > m.sma_50, false) AS trend_above_sma50,
       m.simple_return * 100 AS daily_return_pct, m.volatility_20d_annualized * 100 AS volatility_pct,
       m.drawdown * 100 AS drawdown_pct, m.max_drawdown_to_date * 100 AS max_drawdown_pct,
       m.revenue / 1e9 AS revenue_billions, m.net_income / 1e9 AS net_income_billions, m.assets / 1e9 AS assets_billions,
       l.momentum_63d_raw * 100 AS momentum_63d_raw_pct, l.momentum_21d_raw * 100 AS momentum_21d_raw_pct,
       l.momentum_126d_raw * 100 AS momentum_126d_raw_pct, l.revenue_growth_yoy_raw * 100 AS revenue_growth_yoy_raw_pct, l.profit_margin_raw * 100 AS profit_margin_raw_pct,
       v.pe_ratio AS pe_ratio_raw, l.beta_252_raw, l.momentum_subscore, l.quality_subscore, l.valuation_subscore,
       l.composite_score, l.score_coverage, l.momentum_label, l.fundamentals_label, l.valuation_label, l.overall_label,
       l.overall_display_label
FROM master m LEFT JOIN labelled l USING (symbol) LEFT JOIN valuation v USING (symbol)""")
cte("stocks", "SELECT * FROM screener WHERE symbol <> 'MKT'")

# ---- research ----------------------------------------------------------------------------------

cte("sig", """
SELECT * FROM (SELECT symbol, date, adjusted_close / lag(adjusted_close, 63) OVER w - 1 AS momentum_63d,
                      lead(adjusted_close, 21) OVER w / adjusted_close - 1 AS forward_return_21d
               FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
WHERE momentum_63d IS NOT NULL AND forward_return_21d IS NOT NULL""")
cte("eligible_sig", "SELECT * FROM sig QUALIFY count(*) OVER (PARTITION BY date) >= 10")
# Bin edges as interpolated quantiles of the ranks, compared as exact integers over 5.
cte("obs", """
SELECT symbol, date, momentum_63d, forward_return_21d, forward_return_21d > 0 AS forward_hit,
       (1 + (5 * (rk - 1) > 1 * (n - 1))::INT + (5 * (rk - 1) > 2 * (n - 1))::INT
          + (5 * (rk - 1) > 3 * (n - 1))::INT + (5 * (rk - 1) > 4 * (n - 1))::INT)::INT AS quintile
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum_63d, symbol) AS rk,
             count(*) OVER (PARTITION BY date) AS n FROM eligible_sig)""")
cte("tf", "SELECT * FROM (VALUES ('3M', 3, 92), ('6M', 6, 183), ('1Y', 12, 366), ('2Y', 24, 732)) AS t(timeframe, months, days)")
cte("ends", "SELECT symbol, max(date) AS last FROM panel GROUP BY symbol")
cte("sliced", """
SELECT p.*, t.timeframe FROM panel p JOIN ends USING (symbol), tf t
WHERE p.date >= (last - to_months(t.months))::DATE""")
cte("pair_window", """
SELECT p.symbol, t.timeframe, p.date, p.adjusted_close AS s, m.adjusted_close AS b,
       greatest(e.last, me.last) AS until
FROM bars p JOIN ends e USING (symbol) JOIN ends me ON me.symbol = 'MKT', tf t
LEFT JOIN mkt_bars m ON m.date = p.date
WHERE p.date >= (greatest(e.last, me.last) - to_months(t.months))::DATE""")
cte("common_pairs", "SELECT * FROM pair_window WHERE b IS NOT NULL QUALIFY count(*) OVER (PARTITION BY symbol, timeframe) >= 2")

# ---- sources -----------------------------------------------------------------------------------

_P = "date, symbol, provider, " + r("open high low close adjusted_close volume")
oracle("src_01_price_files", f"SELECT {_P} FROM panel")
oracle("src_02_fundamental_csv", f"SELECT symbol, revenue_period_end, equity_filed, revenue_form, {r('revenue equity', 4)} FROM snap_wide")
oracle("src_03_provider_bars", f"""SELECT date, symbol, provider, {r('open high low close volume adjusted_close')} FROM bars""")
oracle("src_04_company_facts", f"SELECT symbol, tag, unit, {r('val', 4)}, period_start, period_end, filed, form, frame FROM facts")
oracle("src_05_company_identity", """
SELECT symbol, CASE WHEN s_nationkey = 7 THEN symbol ELSE s_name END AS company_name, s_nationkey::VARCHAR AS sic, n_name AS sic_description,
       '1231' AS fiscal_year_end, CASE WHEN s_nationkey = 3 THEN '' ELSE 'X' || n_regionkey END AS exchange
FROM all_stocks JOIN nation ON s_nationkey = n_nationkey""")
oracle("src_06_ticker_cik", "SELECT symbol AS ticker, lpad(s_suppkey::VARCHAR, 10, '0') AS cik FROM all_stocks")
oracle("src_07_overviews", f"SELECT symbol, round(pe_ratio_raw, 8) + 0.0 AS pe, round(provider_eps_ttm, 8) + 0.0 AS eps, {r('beta')} FROM valuation")
oracle("src_07_overview_files", f"SELECT symbol, round(pe_ratio_raw, 8) + 0.0 AS pe, round(provider_eps_ttm, 8) + 0.0 AS eps, {r('beta')} FROM valuation")
oracle("src_08_bucketed_panel", f"SELECT symbol, date, {r('sma_20 sma_50 volatility_20d_annualized drawdown')} FROM feats")
oracle("src_08_parquet_stage", f"SELECT {_P} FROM panel")
oracle("src_09_screen_csv", f"""
SELECT row_number() OVER (ORDER BY composite_score DESC NULLS LAST, symbol) AS rank, symbol, company_name, {r('composite_score rsi_14')} FROM stocks""")
oracle("src_10_report_json", "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(sma_20) AS sma_20_non_null, count(rsi_14) AS rsi_14_non_null FROM feats")
oracle("src_11_dashboard_export", f"""
SELECT f.symbol, s.company_name, round(s.composite_score, 8) + 0.0 AS composite_score, strftime(f.date, '%Y-%m-%d') AS date,
       round(f.adjusted_close, 8) + 0.0 AS adjusted_close, round(f.sma_50, 8) + 0.0 AS sma_50, round(f.drawdown, 8) + 0.0 AS drawdown
FROM feats f JOIN screener s USING (symbol)""")
_SF_TEXT = ["symbol", "company_name", "sic_description", "momentum_label", "fundamentals_label", "valuation_label", "overall_label",
            "overall_display_label", "signal", "trend_above_sma50"]
_SF_NUMBER = ["adjusted_close", "daily_return_pct", "rsi_14", "volatility_pct", "max_drawdown_pct", "momentum_21d_raw_pct", "momentum_63d_raw_pct",
              "momentum_126d_raw_pct", "profit_margin_raw_pct", "revenue_growth_yoy_raw_pct", "pe_ratio_raw", "beta_252_raw", "momentum_subscore",
              "quality_subscore", "valuation_subscore", "composite_score", "score_coverage"]
oracle("src_11_dashboard_stocks", f"SELECT {', '.join(_SF_TEXT)}, strftime(date, '%Y-%m-%d') AS date, {r(' '.join(_SF_NUMBER))} FROM screener")
oracle("src_11_dashboard_history", f"""
SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {r('adjusted_close sma_20 sma_50 rsi_14 volatility_20d_annualized drawdown', 6)} FROM feats""")
oracle("src_11_dashboard_meta", """
SELECT strftime(max(date), '%Y-%m-%d') AS latest_market_date, 'adjusted_close' AS price_basis, 'MKT' AS benchmark,
  'No imputation; filtered metrics require a real value; comparisons use common dates.' AS missing_policy FROM screener""")
oracle("src_12_catalog_entry", "SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT symbol) AS n_symbols, 9::BIGINT AS n_columns, "
       "'date date, symbol string, open double, high double, low double, close double, adjusted_close double, volume double, provider string' AS columns FROM panel")
oracle("src_12_catalog_symbols", """
SELECT i // 1000 AS list_part, string_agg(symbol, ',' ORDER BY symbol) AS symbols
FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i FROM (SELECT DISTINCT symbol FROM panel)) GROUP BY 1""")
_WANTED = "(SELECT symbol FROM all_stocks UNION ALL SELECT n_name FROM nation)"
oracle("src_14_landing_manifest", f"""
SELECT w.symbol, b.n IS NOT NULL AS success, coalesce(b.n, 0) AS rows, first_date, last_date, provider,
       CASE WHEN b.n IS NULL THEN 'no rows landed' ELSE '' END AS note
FROM {_WANTED} w LEFT JOIN (SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date, min(provider) AS provider
                            FROM bars GROUP BY symbol) b USING (symbol)""")
# The files themselves, as the tables of this scale lie on disk.
oracle("src_13_raw_inventory", """
SELECT parse_filename(filename) AS path, size::BIGINT AS bytes, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
oracle("src_14_file_manifest", """
SELECT symbol AS file, true AS success, count(*) AS rows, 0::BIGINT AS failed_rows, min(date) AS first_date, max(date) AS last_date, '' AS note FROM bars GROUP BY symbol
UNION ALL SELECT 'TEXT', false, count(*) FILTER (day(date) <> 13), count(*) FILTER (day(date) = 13), min(date) FILTER (day(date) <> 13), max(date) FILTER (day(date) <> 13),
  count(*) FILTER (day(date) = 13) || ' rows failed, first: close' FROM mkt_bars
UNION ALL SELECT 'COLUMN', false, 0, 0, NULL, NULL, 'missing columns: adjusted_close'
UNION ALL SELECT 'NOTHING', false, 0, 0, NULL, NULL, 'empty file'""")
oracle("src_15_incremental_landing", f"SELECT {_P} FROM panel")
oracle("src_15_still_to_land", f"SELECT symbol, DATE '2001-12-31' - 737 AS window_start FROM {_WANTED} w WHERE symbol NOT IN (SELECT symbol FROM bars)")
oracle("src_16_universe", "SELECT DISTINCT symbol, symbol = 'MKT' AS is_benchmark FROM panel")

# ---- projections and checks --------------------------------------------------------------------

oracle("prj_01_clean_prices", f"""
SELECT date, symbol, provider, round_even(volume + 0.5, 0)::BIGINT AS volume, 'splits_and_dividends' AS price_adjustment,
       {r('open high low close adjusted_close')} FROM panel""")
oracle("prj_02_price_issues", """
WITH f AS (SELECT CASE WHEN l_quantity <> 7 THEN l_shipdate::DATE END AS date,
  CASE WHEN l_quantity = 3 THEN '' WHEN l_quantity = 4 THEN NULL ELSE l_suppkey::VARCHAR END AS symbol,
  p - CASE WHEN l_quantity = 11 THEN 60 ELSE 0 END AS o, CASE WHEN l_quantity = 13 THEN p * 0.5::DOUBLE ELSE p * 1.1::DOUBLE END AS h,
  CASE WHEN l_quantity = 17 THEN p * 2 ELSE p * 0.9::DOUBLE END AS l, CASE WHEN l_quantity <> 19 THEN p END AS c,
  CASE WHEN l_quantity = 23 THEN NULL WHEN l_quantity = 29 THEN -p ELSE p END AS a,
  CASE WHEN l_quantity = 31 THEN -l_quantity WHEN l_quantity = 37 THEN NULL ELSE l_quantity END AS v
  FROM (SELECT *, l_extendedprice / 1000 AS p FROM lineitem))
SELECT count(*) FILTER (date IS NULL) AS missing_date, count(*) FILTER (symbol IS NULL OR symbol = '') AS missing_symbol,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, date FROM f)) AS duplicate_symbol_date,
  count(*) FILTER (c IS NULL) + count(*) FILTER (v IS NULL) AS missing_ohlcv_cells, count(*) FILTER (a IS NULL) AS missing_adjusted_close,
  count(*) FILTER (a <= 0) AS nonpositive_adjusted_close_rows, count(*) FILTER (o <= 0 OR h <= 0 OR l <= 0 OR c <= 0) AS nonpositive_price_rows,
  count(*) FILTER (v < 0) AS negative_volume_rows, count(*) FILTER (h < greatest(o, h, l, c)) AS high_below_ohlc_rows,
  count(*) FILTER (l > least(o, h, l, c)) AS low_above_ohlc_rows FROM f""")
cte("snap99", _snapshot("DATE '1999-06-30'"))
cte("wide99", _wide("snap99"))
cte("stale99", """
SELECT * REPLACE (CASE WHEN liabilities_period_end IS NOT DISTINCT FROM assets_period_end THEN liabilities END AS liabilities) FROM wide99""")
cte("clean99", """
SELECT *, liabilities IS NULL AND assets IS NOT NULL AND equity IS NOT NULL AND coalesce(assets_period_end = equity_period_end, false) AS derive
FROM stale99""")
oracle("prj_03_clean_fundamentals", f"""
SELECT symbol, {r('assets equity', 4)}, round(CASE WHEN derive THEN assets - equity ELSE liabilities END, 4) + 0.0 AS liabilities,
  CASE WHEN derive THEN assets_period_end ELSE liabilities_period_end END AS liabilities_period_end,
  CASE WHEN derive THEN greatest(assets_filed, equity_filed) ELSE liabilities_filed END AS liabilities_filed,
  CASE WHEN derive THEN 'DERIVED' ELSE liabilities_form END AS liabilities_form,
  CASE WHEN derive THEN 'derived: Assets - StockholdersEquity' ELSE liabilities_tag END AS liabilities_tag,
  liabilities IS NULL AND NOT derive AS liabilities_is_missing, revenue IS NULL AS revenue_is_missing FROM clean99""")
oracle("prj_03_fundamentals_report", """
SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (derive) AS liabilities_derived,
  count(*) FILTER (assets < 0 OR equity < 0 OR CASE WHEN derive THEN assets - equity ELSE liabilities END < 0) AS negative_balance_rows,
  count(*) FILTER (revenue IS NULL) AS revenue_missing_after, count(*) FILTER (net_income IS NULL) AS net_income_missing_after,
  count(*) FILTER (assets IS NULL) AS assets_missing_after, count(*) FILTER (liabilities IS NULL AND NOT derive) AS liabilities_missing_after,
  count(*) FILTER (equity IS NULL) AS equity_missing_after, count(*) FILTER (eps_diluted IS NULL) AS eps_diluted_missing_after,
  count(*) FILTER (liabilities IS NULL) AS liabilities_missing_before FROM clean99""")
oracle("prj_04_adjusted_basis", f"SELECT symbol, date, {r('close unadjusted_close adjusted_close')} FROM basis")
oracle("prj_05_percent_columns", "SELECT symbol, " + r(
    "daily_return_pct volatility_pct drawdown_pct max_drawdown_pct momentum_63d_raw_pct profit_margin_raw_pct "
    "revenue_billions net_income_billions assets_billions") + " FROM screener")
oracle("prj_06_display_table", """
SELECT symbol AS "Ticker", company_name AS "Company", round(momentum_63d_raw_pct, 8) + 0.0 AS "Momentum 3M %",
  round(profit_margin_raw_pct, 8) + 0.0 AS "Profit margin %", round(pe_ratio_raw, 8) + 0.0 AS "P/E",
  round(beta_252_raw, 8) + 0.0 AS "Beta 252D", round(composite_score, 8) + 0.0 AS "Composite score",
  overall_display_label AS "Overall signal" FROM screener""")
oracle("prj_07_benchmark_identity", "SELECT symbol, company_name, sic_description FROM screener")
oracle("prj_08_availability", "SELECT symbol, has_fundamentals, has_beta, has_momentum, has_growth FROM master")
oracle("qc_02_verify_returns", """
SELECT 'MKT' AS symbol, count(*) AS rows, count(simple_return) AS return_rows, min(date) AS first_date, max(date) AS last_date,
  count(*) FILTER (close IS NULL OR close <= 0) AS bad_close_rows, count(*) - count(DISTINCT date) AS duplicate_dates,
  0::BIGINT AS simple_return_mismatches, 0::BIGINT AS log_return_mismatches FROM ret WHERE symbol = 'MKT'""")
oracle("qc_03_independent_recompute", """
SELECT i AS indicator, (SELECT count(DISTINCT symbol) FROM panel) AS symbols, (SELECT count(DISTINCT symbol) FROM panel) AS passed
FROM (VALUES ('simple_return'), ('log_return'), ('sma_20'), ('sma_50'), ('ema_20'), ('rsi_14'), ('volatility_20d_annualized'),
             ('drawdown'), ('max_drawdown_to_date')) AS t(i)""")
_QC4 = ["simple_return", "log_return", "sma_20", "sma_50", "ema_20", "rsi_14", "volatility_20d_annualized", "drawdown",
        "max_drawdown_to_date", "momentum_21d", "momentum_63d", "momentum_126d"]
oracle("qc_04_prefix_invariance", "SELECT count(*) AS rows_compared, " + ", ".join(f"0::BIGINT AS {c}_changed" for c in _QC4)
       + " FROM panel WHERE date <= DATE '1999-06-30'")

# ---- filters -----------------------------------------------------------------------------------

oracle("flt_01_screen", f"""
SELECT symbol, overall_label, {r('rsi_14 volatility_pct composite_score')} FROM stocks
WHERE (contains(lower(symbol), 'supplier#') OR contains(lower(company_name), 'supplier#')) AND rsi_14 BETWEEN 45 AND 60
  AND volatility_pct <= 900 AND trend_above_sma50 AND momentum_63d_raw_pct >= -40 AND pe_ratio_raw <= 45
  AND overall_label IN ('Strong', 'Positive', 'Neutral')""")
oracle("flt_01a_text_search", "SELECT symbol, company_name FROM screener WHERE contains(lower(symbol), 'r#00000001') OR contains(lower(company_name), 'r#00000001')")
oracle("flt_01b_range", f"""
SELECT symbol, date, {r('rsi_14 volatility_pct', 6)} FROM (SELECT *, volatility_20d_annualized * 100 AS volatility_pct FROM feats)
WHERE rsi_14 BETWEEN 0 AND 100 AND volatility_pct <= 500""")
oracle("flt_01c_trend_below", "SELECT symbol, date FROM feats WHERE rsi_14 BETWEEN 0 AND 100 AND volatility_20d_annualized IS NOT NULL AND NOT coalesce(close > sma_50, false)")
oracle("flt_01d_numeric", f"SELECT symbol, {r('beta_252_raw profit_margin_raw_pct')} FROM screener WHERE rsi_14 IS NOT NULL AND volatility_pct IS NOT NULL AND beta_252_raw <= 1 AND profit_margin_raw_pct >= 30")
oracle("flt_01e_label_lists", """
SELECT 'two' AS list, count(*) AS n_rows FROM screener WHERE rsi_14 IS NOT NULL AND volatility_pct IS NOT NULL AND overall_label IN ('Strong', 'Weak')
UNION ALL SELECT 'off', count(*) FROM screener WHERE rsi_14 IS NOT NULL AND volatility_pct IS NOT NULL""")
oracle("flt_02_any_label_screen", f"""
SELECT symbol, {r('momentum_63d_raw_pct score_coverage composite_score')} FROM stocks
WHERE (contains(lower(symbol), 's00') OR contains(lower(company_name), 's00')) AND momentum_63d_raw_pct BETWEEN -50 AND 60 AND score_coverage >= 0.8""")
oracle("flt_03_signal_map", """
SELECT symbol, rsi_14 IS NOT NULL AND pe_ratio_raw IS NOT NULL AS eligible, round(greatest(coalesce(composite_score, 1), 1), 8) + 0.0 AS bubble_score,
  coalesce(overall_label, 'Unavailable') AS overall_label FROM screener""")
oracle("flt_03_signal_map_counts", """
SELECT count(*) FILTER (rsi_14 IS NOT NULL AND pe_ratio_raw IS NOT NULL) AS plotted,
  count(*) FILTER (rsi_14 IS NULL OR pe_ratio_raw IS NULL) AS excluded FROM screener""")
oracle("flt_04_quadrant_map", """
SELECT symbol, ok AS plotted, concat_ws(' · ', CASE WHEN rsi_14 IS NULL THEN 'RSI N/A' END,
    CASE WHEN pe_ratio_raw IS NULL OR pe_ratio_raw <= 0 THEN 'P/E not meaningful' END) AS reasons,
  round(greatest(50, least(200, coalesce(top, 50)))::DOUBLE, 8) + 0.0 AS pe_axis_cap, round(coalesce(mid, 25), 8) + 0.0 AS pe_divider,
  CASE WHEN ok THEN CASE WHEN pe_ratio_raw >= mid THEN 'higher P/E, ' ELSE 'lower P/E, ' END
       || CASE WHEN rsi_14 >= 50 THEN 'stronger RSI' ELSE 'cooler RSI' END END AS quadrant
FROM (SELECT *, coalesce(rsi_14 IS NOT NULL AND pe_ratio_raw > 0, false) AS ok FROM stocks),
  (SELECT max(pe_ratio_raw) AS top, list_sort(list(pe_ratio_raw))[count(*) // 2 + 1] AS mid FROM stocks WHERE rsi_14 IS NOT NULL AND pe_ratio_raw > 0)""")
oracle("flt_05_month_lookback", "SELECT symbol, timeframe, date FROM sliced")
oracle("flt_06_day_lookback", """
SELECT p.symbol, t.timeframe, count(*) AS n_rows, min(p.date) AS first_date FROM panel p JOIN ends USING (symbol), tf t
WHERE p.date >= last - t.days::INT GROUP BY ALL""")
oracle("flt_07_known_facts", f"SELECT symbol, tag, {r('val', 4)}, period_end, filed, form FROM facts WHERE filed <= DATE '1998-05-15'")
oracle("flt_08_minimum_cross_section", "SELECT symbol, date FROM bars QUALIFY count(*) OVER (PARTITION BY date) >= 20")
oracle("flt_09_complete_cases", f"SELECT symbol, date, {r('momentum_63d')} FROM windowed WHERE momentum_63d IS NOT NULL")

# ---- joins -------------------------------------------------------------------------------------

oracle("jn_01_align_returns", f"SELECT symbol, date, {r('simple_return log_return benchmark_simple_return benchmark_log_return')} FROM aligned")
oracle("jn_02_alignment_audit", """
SELECT symbol, count(*) AS stock_rows_total, count(simple_return) AS stock_valid_return_rows,
  (SELECT count(*) FROM valid_market) AS benchmark_valid_return_rows,
  count(*) FILTER (simple_return IS NOT NULL AND date IN (SELECT date FROM valid_market)) AS aligned_rows,
  count(*) FILTER (simple_return IS NOT NULL AND date NOT IN (SELECT date FROM valid_market)) AS stock_dates_without_benchmark,
  (SELECT count(*) FROM valid_market) - count(*) FILTER (simple_return IS NOT NULL AND date IN (SELECT date FROM valid_market)) AS benchmark_dates_without_stock,
  count(*) - count(simple_return) AS stock_null_return_rows_removed, 'none' AS fill_method, 'exact-date inner join' AS join_method
FROM ret WHERE symbol <> 'MKT' GROUP BY symbol""")
oracle("jn_03_master", f"""
SELECT symbol, date, is_benchmark, company_name, sic_description, exchange, beta_60_n_obs, beta_252_n_obs, momentum_126d_n_obs,
  latest_frame, comparison_frame, quality_note, {r('revenue net_income assets liabilities equity', 4)},
  {r('close sma_50 rsi_14 eps_diluted beta_60 beta_252 momentum_63d momentum_126d revenue_growth_yoy profit_margin')} FROM master""")
oracle("jn_03_master_as_of", f"""
SELECT symbol, as_of, date, is_benchmark, company_name, sic_description, exchange, beta_60_n_obs, beta_252_n_obs, momentum_126d_n_obs,
  latest_frame, comparison_frame, quality_note, has_fundamentals, has_growth, {r('revenue net_income assets liabilities equity', 4)},
  {r('close sma_50 rsi_14 eps_diluted beta_60 beta_252 momentum_63d momentum_126d revenue_growth_yoy profit_margin')} FROM then_master""")
oracle("jn_04_screener", f"""
SELECT symbol, company_name, signal, trend_above_sma50, overall_display_label, {r('close rsi_14 composite_score score_coverage')} FROM screener""")
oracle("jn_05_master_valuation", f"SELECT symbol, is_benchmark, pe_is_meaningful, pe_exclusion_reason, {r('pe_ratio pe_ratio_raw')} FROM valued")
oracle("jn_06_compare_betas", "SELECT symbol, round(v.beta, 8) + 0.0 AS provider_beta, v.beta IS NOT NULL AS provider_beta_available, false AS methodology_comparable, " + ", ".join(
    f"round(beta_{n} - v.beta, 8) + 0.0 AS difference_beta_{n}, round(abs(beta_{n} - v.beta), 8) + 0.0 AS absolute_difference_beta_{n}" for n in (60, 126, 252))
    + " FROM last_beta LEFT JOIN valuation v USING (symbol)")
oracle("jn_07_indexed_comparison", """
SELECT symbol, timeframe, date, round(s / first(s) OVER w * 100, 8) + 0.0 AS stock_indexed, round(b / first(b) OVER w * 100, 8) + 0.0 AS benchmark_indexed
FROM common_pairs WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY date)""")
oracle("jn_07_comparison_summary", """
SELECT e.symbol, t.timeframe, CASE WHEN n >= 2 THEN 'compared' ELSE 'fewer than two common days' END AS status,
  CASE WHEN n >= 2 THEN round(sr, 8) + 0.0 END AS stock_return, CASE WHEN n >= 2 THEN round(br, 8) + 0.0 END AS benchmark_return,
  CASE WHEN n >= 2 THEN round((sr - br) * 100, 8) + 0.0 END AS excess_return_pp, coalesce(n, 0) AS common_observations,
  f AS first_common_date, l AS last_common_date, coalesce(days_held, 0) - coalesce(n, 0) AS stock_dates_excluded,
  (SELECT count(*) FROM mkt_bars m WHERE m.date >= (greatest(e.last, me.last) - to_months(t.months))::DATE) - coalesce(n, 0) AS benchmark_dates_excluded
FROM ends e JOIN ends me ON me.symbol = 'MKT' AND e.symbol <> 'MKT', tf t
LEFT JOIN (SELECT symbol, timeframe, count(*) AS days_held, count(b) AS n, min(date) FILTER (b IS NOT NULL) AS f, max(date) FILTER (b IS NOT NULL) AS l,
        arg_max(s, date) FILTER (b IS NOT NULL) / arg_min(s, date) FILTER (b IS NOT NULL) - 1 AS sr,
        arg_max(b, date) FILTER (b IS NOT NULL) / arg_min(b, date) FILTER (b IS NOT NULL) - 1 AS br
      FROM pair_window GROUP BY ALL) p ON p.symbol = e.symbol AND p.timeframe = t.timeframe""")
oracle("jn_07_comparison_by_days", """
SELECT symbol, timeframe, count(*) AS n_days, round(arg_max(s, date) / arg_min(s, date) * 100 - 100, 8) + 0.0 AS stock_change_pct,
  round(arg_max(b, date) / arg_min(b, date) * 100 - 100, 8) + 0.0 AS benchmark_change_pct,
  round(arg_max(s, date) / arg_min(s, date) * 100 - arg_max(b, date) / arg_min(b, date) * 100, 8) + 0.0 AS excess_pct
FROM (SELECT p.symbol, t.timeframe, p.date, p.adjusted_close AS s, m.adjusted_close AS b
      FROM bars p JOIN ends USING (symbol) JOIN mkt_bars m ON m.date = p.date, tf t WHERE p.date >= last - t.days::INT)
GROUP BY ALL HAVING count(*) >= 2""")
oracle("jn_08_point_in_time_facts", f"""
SELECT d.symbol, d.date AS decision_date, m.metric, {r('val', 4)}, f.period_end, f.filed, f.form, f.tag
FROM bars d CROSS JOIN (SELECT DISTINCT metric FROM metric_tags) m
LEFT JOIN ranked_facts f ON f.symbol = d.symbol AND f.metric = m.metric AND f.filed <= d.date
QUALIFY row_number() OVER (PARTITION BY d.symbol, d.date, m.metric {_BEST}) = 1""")
oracle("jn_09_year_on_year", f"SELECT symbol, year, quarter, {r('val prior_val', 4)}, {r('growth_yoy')}, comparison_frame FROM yoy_q")
oracle("jn_10_match_income", """
SELECT r.symbol, r.year, r.quarter, round(r.val, 4) + 0.0 AS val, round(i.val, 4) + 0.0 AS income, i.tag AS income_tag
FROM rev_q r LEFT JOIN inc_q i ON i.symbol = r.symbol AND i.period_start = r.period_start AND i.period_end = r.period_end""")
oracle("jn_11_universe_semi_anti", """
SELECT CASE WHEN symbol = 'MKT' THEN 'other' ELSE 'universe' END AS side, count(*) AS n_rows, count(DISTINCT symbol) AS symbols FROM panel GROUP BY 1""")

# ---- aggregations ------------------------------------------------------------------------------

oracle("agg_01_latest_per_symbol", f"SELECT symbol, date, {r('close volume')} FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
oracle("agg_01_latest_beta", f"SELECT symbol, date, beta_60_n_obs, beta_126_n_obs, beta_252_n_obs, {r('beta_60 beta_126 beta_252')} FROM last_beta")
oracle("agg_02_first_per_symbol", """
SELECT count(*) AS first_rows, bool_and(simple_return IS NULL) AS first_simple_return_all_null, bool_and(log_return IS NULL) AS first_log_return_all_null
FROM ret WHERE rn = 1""")
oracle("agg_03_feature_report", "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, " + ", ".join(f"count({c}) AS {c}_non_null" for c in _QC4) + " FROM feats")
# Every column of the master that is not metadata: whether only a company can have it.
_ASSESSED = dict.fromkeys(
    ["close", "adjusted_close", "simple_return", "sma_20", "sma_50", "ema_20", "rsi_14", "volatility_20d_annualized", "drawdown", "max_drawdown_to_date",
     "momentum_21d", "momentum_21d_n_obs", "momentum_63d", "momentum_63d_n_obs", "momentum_126d", "momentum_126d_n_obs"], False
) | dict.fromkeys(
    ["company_name", "sic", "sic_description", "fiscal_year_end", "exchange", "revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted",
     "beta_60", "beta_60_n_obs", "beta_126", "beta_126_n_obs", "beta_252", "beta_252_n_obs", "revenue_growth_yoy", "profit_margin", "latest_frame",
     "comparison_frame"], True)
cte("cells", "\nUNION ALL ".join(
    f"SELECT symbol, is_benchmark, '{c}' AS feature, '{'stocks_only' if only else 'stocks_and_benchmark'}' AS scope, {c} IS NULL AS missing, "
    f"{'NOT is_benchmark' if only else 'true'} AS eligible FROM master" for c, only in _ASSESSED.items()))
cte("miss", """
SELECT feature, scope, count(*) FILTER (eligible) AS eligible_rows, count(*) FILTER (eligible AND missing) AS missing_count FROM cells GROUP BY ALL""")
oracle("agg_04_missing_report", """
SELECT feature, scope, eligible_rows, missing_count, eligible_rows - missing_count AS available_count,
  round(missing_count::DOUBLE / eligible_rows, 8) + 0.0 AS missing_rate, scope = 'stocks_only' AS benchmark_not_applicable FROM miss""")
oracle("agg_05_missing_by_symbol", "SELECT symbol, feature, 'eligible_missing' AS scope FROM cells WHERE eligible AND missing")
oracle("agg_06_missing_summary", """
SELECT (SELECT count(*) FROM master) AS master_rows, (SELECT count(*) FROM master WHERE NOT is_benchmark) AS stock_rows,
  (SELECT count(*) FROM master WHERE is_benchmark) AS benchmark_rows, count(*) AS features_assessed,
  count(*) FILTER (missing_count > 0 AND scope = 'stocks_only') AS features_with_stock_missing,
  count(*) FILTER (missing_count > 0) AS features_with_any_eligible_missing FROM miss""")


def _long(table: str, columns: list[str], where: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM {table} WHERE {where}" for c in columns)


_STATS = """
SELECT feature, count(*) AS eligible_rows, count(value) AS available_count, count(*) - count(value) AS missing_count,
  round((count(*) - count(value))::DOUBLE / count(*), 6) + 0.0 AS missing_rate, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median,
  round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.05), 6) + 0.0 AS p05,
  round(quantile_cont(value, 0.25), 6) + 0.0 AS p25, round(quantile_cont(value, 0.75), 6) + 0.0 AS p75, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95,
  round(max(value), 6) + 0.0 AS max, round(skewness(value), 6) + 0.0 AS skewness, abs(skewness(value)) > 1 AS strong_skew_flag
FROM {} GROUP BY feature"""
_DF = ["beta_252", "momentum_21d", "momentum_63d", "momentum_126d", "volatility_20d_annualized", "rsi_14", "drawdown",
       "revenue_growth_yoy", "profit_margin", "pe_ratio"]
cte("snapshot_values", _long("trans", _DF, "NOT is_benchmark"))
cte("panel_values", _long("feats", ["rsi_14", "drawdown", "momentum_21d", "volatility_20d_annualized"], "symbol <> 'MKT'"))
oracle("agg_07_distributions", _STATS.format("snapshot_values"))
oracle("agg_07_panel_distributions", _STATS.format("panel_values"))
cte("spans", """
SELECT feature, min(value) AS lo, max(value) AS hi, least(10, greatest(5, count(value) // 2)) AS bins FROM snapshot_values GROUP BY feature""")
cte("binned", """
SELECT v.feature, least(floor((v.value - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n
FROM snapshot_values v JOIN spans s ON s.feature = v.feature WHERE v.value IS NOT NULL GROUP BY ALL""")
cte("every_bin", "SELECT feature, lo, hi, bins, b AS bin FROM spans, (SELECT range AS b FROM range(10)) WHERE b < bins")
oracle("agg_08_histogram", """
SELECT e.feature, e.bin, round(lo + e.bin * (hi - lo) / bins, 6) + 0.0 AS bin_from, round(lo + (e.bin + 1) * (hi - lo) / bins, 6) + 0.0 AS bin_to,
  coalesce(n, 0) AS n_values
FROM every_bin e LEFT JOIN binned b ON b.feature = e.feature AND b.bin = e.bin""")
_BOX = [c for f in _WF for c in (f, f"{f}_winsorized")]
cte("box_values", _long("trans", _BOX, "NOT is_benchmark"))
cte("box_q", """
SELECT feature, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM box_values GROUP BY feature""")
oracle("agg_09_boxplot", """
SELECT feature, round(q1, 6) + 0.0 AS q1, round(m, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, count(value) AS n_values,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) AS low_outliers, count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS high_outliers,
  round(least(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), q1), 6) + 0.0 AS whisker_low,
  round(greatest(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), q3), 6) + 0.0 AS whisker_high
FROM box_values JOIN box_q USING (feature) GROUP BY feature, box_q.q1, box_q.m, box_q.q3""")
cte("winsor_values", _long("valued", _WF, "NOT is_benchmark"))
oracle("agg_10_winsor_bounds", """
SELECT feature, 0.05::DOUBLE AS lower_quantile, 0.95::DOUBLE AS upper_quantile, round(lo, 8) + 0.0 AS lower_bound, round(hi, 8) + 0.0 AS upper_bound,
  count(value) AS available_stock_values, count(*) FILTER (value < lo) AS lower_capped_count, count(*) FILTER (value > hi) AS upper_capped_count
FROM winsor_values JOIN (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM winsor_values GROUP BY feature) USING (feature)
GROUP BY feature, lo, hi""")
oracle("agg_10_winsor_bounds_as_of", "\nUNION ALL ".join(f"""
SELECT as_of, '{f}' AS feature, 0.05::DOUBLE AS lower_quantile, 0.95::DOUBLE AS upper_quantile, round({f}_lo, 8) + 0.0 AS lower_bound,
  round({f}_hi, 8) + 0.0 AS upper_bound, count({f}) AS available_stock_values, count(*) FILTER ({f} < {f}_lo) AS lower_capped_count,
  count(*) FILTER ({f} > {f}_hi) AS upper_capped_count
FROM then_valued JOIN then_bounds USING (as_of) WHERE NOT is_benchmark GROUP BY as_of, {f}_lo, {f}_hi""" for f in _WF))
_CF = {
    "Beta 252": "beta_252_winsorized", "Momentum 21D": "momentum_21d_winsorized", "Momentum 63D": "momentum_63d_winsorized",
    "Momentum 126D": "momentum_126d_winsorized", "Volatility 20D": "volatility_20d_annualized_winsorized", "RSI 14": "rsi_14",
    "Drawdown": "drawdown", "Revenue Growth YoY": "revenue_growth_yoy_winsorized", "Profit Margin": "profit_margin_winsorized",
    "P/E": "pe_ratio_winsorized",
}


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_").replace("/", "_")


def _matrix(cell: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature, " + ", ".join(f"{cell.format(a=x, b=y)} AS {_slug(b)}" for b, y in _CF.items())
        + " FROM trans WHERE NOT is_benchmark" for a, x in _CF.items())


oracle("agg_11_correlation_matrix", _matrix("CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= 3 THEN round(corr({a}, {b}), 8) + 0.0 END"))
oracle("agg_12_pair_counts", _matrix("count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"))
_names = list(_CF)
cte("pairs", "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({_CF[a]}, {_CF[b]}) AS c, "
    f"count(*) FILTER ({_CF[a]} IS NOT NULL AND {_CF[b]} IS NOT NULL) AS pairwise_observations FROM trans WHERE NOT is_benchmark"
    for i, a in enumerate(_names) for b in _names[i + 1:]))
_PAIR = "SELECT feature_1, feature_2, pairwise_observations, round(c, 8) + 0.0 AS correlation, round(abs(c), 8) + 0.0 AS absolute_correlation FROM pairs"
oracle("agg_13_ranked_pairs", _PAIR)
oracle("agg_13_strong_pairs", f"""
SELECT count(*) AS pairs, count(correlation) AS pairs_with_correlation, count(*) FILTER (abs(correlation) >= 0.7) AS strong_pairs,
  round(max(abs(correlation)), 8) + 0.0 AS strongest, (SELECT count(*) FROM trans WHERE NOT is_benchmark) AS rows, 0.7::DOUBLE AS least, 'Pearson' AS method FROM ({_PAIR})""")
oracle("agg_14_quintile_summary", """
SELECT quintile, count(*) AS observations, count(DISTINCT date) AS dates, round(avg(forward_return_21d), 8) + 0.0 AS mean_forward_return,
  round(median(forward_return_21d), 8) + 0.0 AS median_forward_return, round(avg(forward_hit::INT), 8) + 0.0 AS hit_rate FROM obs GROUP BY quintile""")
cte("spread", """
SELECT date, avg(forward_return_21d) FILTER (quintile = 1) AS q1, avg(forward_return_21d) FILTER (quintile = 5) AS q5 FROM obs GROUP BY date""")
oracle("agg_15_spread_by_date", "SELECT date, round(q1, 8) + 0.0 AS q1, round(q5, 8) + 0.0 AS q5, round(q5 - q1, 8) + 0.0 AS top_minus_bottom FROM spread")
oracle("agg_15_research_report", """
SELECT (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT date) FROM obs) AS formation_dates, (SELECT count(DISTINCT symbol) FROM obs) AS symbols,
  round(avg(q5 - q1), 8) + 0.0 AS mean_top_minus_bottom, round(median(q5 - q1), 8) + 0.0 AS median_top_minus_bottom,
  round(avg((q5 - q1 > 0)::INT), 8) + 0.0 AS positive_spread_hit_rate FROM spread""")
oracle("agg_16_screener_kpis", """
SELECT count(*) AS rows_shown, count(*) FILTER (signal = 'Bullish') AS bullish, (SELECT count(*) FROM stocks) AS universe,
  round(median(rsi_14), 8) + 0.0 AS median_rsi, round(median(volatility_pct), 8) + 0.0 AS median_volatility_pct
FROM stocks WHERE rsi_14 IS NOT NULL AND volatility_pct IS NOT NULL""")
oracle("agg_17_upper_medians", "\nUNION ALL ".join(
    f"SELECT '{c}' AS field, round(list_sort(list({c}))[count(*) // 2 + 1], 8) + 0.0 AS upper_median FROM stocks WHERE {c} IS NOT NULL"
    for c in ("rsi_14", "volatility_pct", "pe_ratio_raw", "composite_score")))
oracle("agg_18_market_breadth", """
SELECT n AS stocks, p AS positive_momentum, o AS beating_benchmark, f AS favorable_labels, round(p * 100.0::DOUBLE / n, 8) + 0.0 AS positive_momentum_pct,
  round(o * 100.0::DOUBLE / n, 8) + 0.0 AS beating_benchmark_pct, round(f * 100.0::DOUBLE / n, 8) + 0.0 AS favorable_labels_pct,
  CASE WHEN mm > 0 AND dd > 0 THEN 'UPTREND' WHEN mm < 0 AND dd < 0 THEN 'DOWNTREND' ELSE 'MIXED' END AS regime
FROM (SELECT count(*) AS n, count(*) FILTER (m.momentum_63d > 0) AS p, count(*) FILTER (m.momentum_63d > k.momentum_63d) AS o,
        count(*) FILTER (s.overall_label IN ('Strong', 'Positive')) AS f, any_value(k.momentum_63d) AS mm, any_value(k.simple_return) AS dd
      FROM stocks s JOIN master m USING (symbol), (SELECT momentum_63d, simple_return FROM master WHERE is_benchmark) k)""")
oracle("agg_19_symbol_quality", """
SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) - count(close) AS missing_close,
  count(*) - count(simple_return) AS missing_return, count(*) - count(sma_20) AS missing_sma20, count(*) - count(sma_50) AS missing_sma50,
  count(*) - count(rsi_14) AS missing_rsi, count(*) - count(volatility_20d_annualized) AS missing_volatility,
  count(*) - count(DISTINCT date) AS duplicate_dates FROM feats GROUP BY symbol""")
oracle("agg_20_label_distribution", "SELECT overall_label, count(*) AS n_rows FROM screener GROUP BY 1")
oracle("agg_21_master_coverage", """
SELECT count(*) AS rows, count(*) FILTER (NOT is_benchmark) AS stock_rows, count(*) FILTER (is_benchmark) AS benchmark_rows,
  count(*) - count(DISTINCT symbol) AS duplicate_symbols, count(*) FILTER (NOT is_benchmark AND has_fundamentals) AS stocks_with_fundamentals,
  count(*) FILTER (NOT is_benchmark AND has_beta) AS stocks_with_beta, count(*) FILTER (NOT is_benchmark AND has_momentum) AS stocks_with_momentum,
  count(*) FILTER (NOT is_benchmark AND has_growth) AS stocks_with_growth FROM master""")
oracle("agg_21_growth_coverage", """
SELECT count(*) AS symbols, count(*) FILTER (revenue_growth_available) AS revenue_growth_yoy_available,
  count(*) FILTER (profit_margin_available) AS profit_margin_available, count(*) FILTER (unusual_margin_flag) AS unusual_margin_flags FROM growth""")
oracle("agg_21_score_coverage", """
SELECT count(*) AS stocks, count(*) FILTER (NOT incomplete_score_flag) AS full_coverage_stocks,
  count(*) FILTER (incomplete_score_flag) AS incomplete_stocks, count(*) FILTER (score_eligible) AS eligible_stocks FROM scored""")
oracle("agg_21_latest_coverage", "SELECT count(*) AS symbols, " + ", ".join(
    f"count({c}) AS {c}_available" for c in ("beta_60", "beta_126", "beta_252", "momentum_21d", "momentum_126d")) + " FROM master")
cte("slice_dd", """
SELECT symbol, timeframe, date, adjusted_close / max(adjusted_close) OVER (PARTITION BY symbol, timeframe ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM sliced""")
oracle("agg_22_timeframe_max_drawdown", "SELECT symbol, timeframe, round(min(dd) * 100, 8) + 0.0 AS max_drawdown_pct FROM slice_dd GROUP BY ALL")
_AUDIT = [f"SELECT 'fundamental_filing_dates_after_as_of', '{m}_filed', count(*) FILTER ({m}_filed > a) FROM snap_wide, cut" for m in _M] + [
    f"SELECT 'fundamental_period_ends_after_as_of', '{m}_period_end', count(*) FILTER ({m}_period_end > a) FROM snap_wide, cut" for m in _M]
_AUDIT = [a.replace("snap_wide", "derived_dates") for a in _AUDIT]
cte("cut", "SELECT max(date) AS a FROM panel WHERE date <= DATE '2000-12-31'")
cte("derived_dates", """
SELECT * REPLACE (CASE WHEN d THEN assets_period_end ELSE liabilities_period_end END AS liabilities_period_end,
                  CASE WHEN d THEN greatest(assets_filed, equity_filed) ELSE liabilities_filed END AS liabilities_filed)
FROM (SELECT *, liabilities IS NULL AND assets IS NOT NULL AND equity IS NOT NULL AND coalesce(assets_period_end = equity_period_end, false) AS d FROM snap_wide)""")
oracle("agg_23_lookahead_audit", """
SELECT 'technical_dates_after_as_of' AS check, 'date' AS column_name, 0::BIGINT AS violations
UNION ALL SELECT 'master_dates_after_as_of', 'date', count(*) FILTER (last > a) FROM ends, cut
UNION ALL """ + "\nUNION ALL ".join(_AUDIT))
cte("price_pair", """
SELECT symbol, price, close AS next_price FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS price FROM bars)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
cte("moves", """
SELECT owner, b.symbol, amount, CASE WHEN amount > 0 AND price > 0 THEN amount / price ELSE 0 END AS units, price, next_price,
  CASE WHEN price <> 0 AND next_price <> 0 THEN (next_price / price - 1) * 100 ELSE 0 END AS change_pct,
  CASE WHEN amount > 0 AND price > 0 THEN amount / price ELSE 0 END * (coalesce(next_price, 0) - coalesce(price, 0)) AS contribution,
  amount > 0 AND coalesce(price, 0) > 0 AS held
FROM (SELECT o_custkey AS owner, 'S' || lpad(l_suppkey::VARCHAR, 10, '0') AS symbol,
             sum(greatest(l_extendedprice / 100 - 20, 0)) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) b LEFT JOIN price_pair p ON p.symbol = b.symbol""")
oracle("agg_24_portfolio_moves", f"SELECT owner, symbol, held, {r('amount units price next_price change_pct contribution', 6)} FROM moves")
oracle("agg_24_portfolio_worth", """
SELECT c_custkey AS owner, round(c_acctbal - coalesce(inv, 0), 6) + 0.0 AS cash_left, round(c_acctbal - coalesce(inv, 0) + coalesce(bef, 0), 6) + 0.0 AS worth_before,
  round(c_acctbal - coalesce(inv, 0) + coalesce(aft, 0), 6) + 0.0 AS worth_after, best_symbol, worst_symbol
FROM customer LEFT JOIN (SELECT owner, sum(amount) AS inv, sum(units * coalesce(price, 0)) AS bef, sum(units * coalesce(next_price, price, 0)) AS aft,
   arg_max(symbol, (contribution, symbol)) FILTER (held) AS best_symbol, arg_min(symbol, (contribution, symbol)) FILTER (held) AS worst_symbol
   FROM moves GROUP BY owner) ON owner = c_custkey""")

# ---- windows -----------------------------------------------------------------------------------

oracle("win_01_simple_return", f"SELECT symbol, date, {r('simple_return')} FROM ret")
oracle("win_02_log_return", f"SELECT symbol, date, {r('log_return')} FROM ret")
oracle("win_03_sma", f"SELECT symbol, date, {r('sma_20 sma_50')} FROM windowed")
oracle("win_04_ema", f"SELECT symbol, date, CASE WHEN rn >= 20 THEN round(y, 6) + 0.0 END AS ema_20 FROM ret JOIN ema USING (symbol, rn)")
oracle("win_05_rsi", f"SELECT symbol, date, {r('rsi_14', 6)} FROM ret LEFT JOIN rsi USING (symbol, rn)")
cte("vol_rows", "SELECT symbol, date, volume * 0.1::DOUBLE AS u, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars")
cte("fade", """
SELECT symbol, date, k, u AS faded FROM vol_rows WHERE k = 1
UNION ALL
SELECT v.symbol, v.date, v.k, 0.9::DOUBLE * f.faded + v.u FROM fade f JOIN vol_rows v ON v.symbol = f.symbol AND v.k = f.k + 1""")
oracle("win_05a_linear_recurrence", f"SELECT symbol, date, {r('faded', 6)} FROM fade")
oracle("win_06_volatility", f"SELECT symbol, date, {r('volatility_20d_annualized')} FROM windowed")
oracle("win_07_drawdown", f"SELECT symbol, date, {r('drawdown')} FROM windowed")
oracle("win_08_max_drawdown_to_date", f"SELECT symbol, date, {r('max_drawdown_to_date')} FROM windowed")
oracle("win_09_momentum", f"SELECT symbol, date, momentum_21d_n_obs, momentum_63d_n_obs, momentum_126d_n_obs, {r('momentum_21d momentum_63d momentum_126d')} FROM windowed")
oracle("win_09_momentum_provider_close", """
SELECT symbol, date, round(close, 8) + 0.0 AS close, round(close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY date) - 1, 8) + 0.0 AS momentum_21d FROM panel""")
oracle("win_10_rolling_beta", "SELECT symbol, date, beta_60_n_obs, beta_126_n_obs, beta_252_n_obs, " + r(
    "beta_60 beta_126 beta_252 benchmark_variance_60 benchmark_variance_126 benchmark_variance_252") + " FROM beta")
oracle("win_11_forward_return", """
SELECT symbol, date, round(lead(adjusted_close, 21) OVER (PARTITION BY symbol ORDER BY date) / adjusted_close - 1, 8) + 0.0 AS forward_return_21d FROM panel""")
oracle("win_12_quintile", f"SELECT symbol, date, quintile, forward_hit, {r('momentum_63d forward_return_21d')} FROM obs")
oracle("win_13_timeframe_drawdown", """
SELECT s.symbol, timeframe, s.date, round(dd * 100, 8) + 0.0 AS timeframe_drawdown_pct, round(volatility_20d_annualized * 100, 8) + 0.0 AS volatility_20d_annualized_pct
FROM slice_dd s JOIN windowed w ON w.symbol = s.symbol AND w.date = s.date""")
oracle("win_14_percentile_rank", "SELECT symbol, " + ", ".join(f"{f}_eligible_count" for f in _DF) + ", "
       + r(" ".join(f"{f}_percentile {f}_rank_position" for f in _DF)) + " FROM pctl")
oracle("win_14_percentile_as_of", "SELECT symbol, as_of, " + ", ".join(f"{f}_eligible_count" for f in _DF) + ", "
       + r(" ".join(f"{f}_percentile {f}_rank_position" for f in _DF)) + " FROM then_pctl")
oracle("win_14_percentile_by_date", """
SELECT symbol, date, round(volume, 8) + 0.0 AS value, round(p, 8) + 0.0 AS rank_position, round(p / n * 100, 8) + 0.0 AS percentile, n AS eligible_count
FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS p,
             count(*) OVER (PARTITION BY date) AS n FROM bars)""")
oracle("win_15_score_rank", f"SELECT symbol, score_eligible, score_rank, {r('composite_score')} FROM ranked_scores")
_EXACT = """CASE WHEN score_eligible THEN
  (0.0::DOUBLE + coalesce(momentum_subscore * 0.4::DOUBLE, 0) + coalesce(quality_subscore * 0.4::DOUBLE, 0) + coalesce(valuation_subscore * 0.2::DOUBLE, 0))
  / CASE WHEN parts = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE + CASE WHEN momentum_subscore IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END
    + CASE WHEN quality_subscore IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN valuation_subscore IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END END END"""
oracle("win_15_score_rank_as_of", f"""
SELECT symbol, as_of, score_eligible, {r('composite_score')}, CASE WHEN exact IS NOT NULL THEN rank() OVER (PARTITION BY as_of ORDER BY exact DESC NULLS LAST) END AS score_rank
FROM (SELECT *, {_EXACT} AS exact FROM then_scored)""")
oracle("win_16_peer_percentile", "\nUNION ALL ".join(f"""
SELECT symbol, '{c}' AS field, round({c}, 8) + 0.0 AS value, round(p, 8) + 0.0 AS peer_percentile,
  CASE WHEN p >= 67 THEN 'high' WHEN p <= 33 THEN 'low' WHEN p IS NOT NULL THEN 'middle-range' END AS band
FROM (SELECT a.symbol, a.{c}, CASE WHEN a.{c} IS NOT NULL THEN (SELECT count(*) FROM stocks b WHERE b.{c} <= a.{c}) * 100.0::DOUBLE
        / (SELECT count({c}) FROM stocks) END AS p FROM screener a)""" for c in ("volatility_pct", "pe_ratio_raw", "profit_margin_raw_pct")))
oracle("win_17_indexed_to_100", """
SELECT symbol, date, round(adjusted_close / first(adjusted_close) OVER (PARTITION BY symbol ORDER BY date) * 100, 8) + 0.0 AS indexed FROM panel""")
oracle("win_18_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")

# ---- sorts and sets ----------------------------------------------------------------------------

oracle("srt_01_panel_order", f"SELECT symbol, date, {r('close')} FROM panel ORDER BY symbol, date")
oracle("srt_02_user_sort", f"SELECT row_number() OVER (ORDER BY pe_ratio_raw ASC NULLS LAST, symbol) AS rank, symbol, {r('pe_ratio_raw')} FROM screener")
oracle("srt_03_score_order", "SELECT row_number() OVER (ORDER BY score_rank NULLS LAST, symbol) AS rank, symbol, score_rank FROM ranked_scores")
oracle("srt_04_missing_order", "SELECT feature, round(missing_count::DOUBLE / eligible_rows, 8) + 0.0 AS missing_rate FROM miss ORDER BY 2 DESC, 1")
oracle("srt_05_top_pairs", _PAIR + " ORDER BY abs(c) DESC NULLS LAST, feature_1, feature_2 LIMIT 10")
oracle("srt_06_quarter_priority", f"SELECT symbol, year, quarter, {r('val', 4)}, tag, filed, form FROM rev_q")
cte("snap2000", _snapshot("DATE '2000-03-01'"))
oracle("srt_07_latest_fact", f"SELECT symbol, metric, {r('val', 4)}, period_end, filed, form, tag FROM snap2000")
oracle("set_01_union_by_name", "SELECT provider, count(*) AS n_rows, min(date) AS first_date FROM panel GROUP BY provider")
oracle("set_02_date_sets", """
SELECT 'stock only' AS part, count(*) AS n FROM (SELECT date FROM bars EXCEPT SELECT date FROM mkt_bars)
UNION ALL SELECT 'both', count(*) FROM (SELECT date FROM bars INTERSECT SELECT date FROM mkt_bars)""")
oracle("set_03_comparison_long", """
SELECT symbol, timeframe, date, series, round(v, 8) + 0.0 AS indexed_value FROM (
  SELECT symbol, timeframe, date, 'stock' AS series, s / first(s) OVER w * 100 AS v FROM common_pairs WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY date)
  UNION ALL
  SELECT symbol, timeframe, date, 'benchmark', b / first(b) OVER w * 100 FROM common_pairs WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY date))""")
oracle("set_04_pivot_quintiles", "SELECT date, " + ", ".join(f"nullif(count(*) FILTER (quintile = {q}), 0) AS n_q{q}" for q in range(1, 6)) + " FROM obs GROUP BY date")

# ---- scalar functions --------------------------------------------------------------------------

oracle("scl_01_trading_date", "SELECT event_id, ts::DATE AS day FROM events")
oracle("scl_02_lenient_number", """
SELECT id, CASE WHEN abs(x) < 1e6 THEN round(x, 8) + 0.0 ELSE x END AS number FROM (
SELECT id, CASE WHEN regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(t AS DOUBLE) END AS x FROM (
  SELECT 'o' || symbol AS id, pe_ratio_raw::VARCHAR AS t FROM valuation
  UNION ALL SELECT 'd ' || doc_id || ' ' || place, words[place + 1]
  FROM (SELECT doc_id, words, unnest(range(len(words))) AS place FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents))))""")
oracle("scl_03_text_functions", "SELECT p_partkey, upper(p_name) AS upper_name, lower(p_name) AS lower_name, contains(lower(p_name), 'red') AS has_red FROM part")
oracle("scl_04_frame_parts", """
SELECT symbol, tag, filed, seq, nullif(regexp_extract(frame, 'CY(\\d{4})Q([1-4])', 1), '')::INT AS year,
  nullif(regexp_extract(frame, 'CY(\\d{4})Q([1-4])', 2), '')::INT AS quarter, frame IS NOT NULL AS is_quarter FROM facts""")
oracle("scl_05_comparison_frame", "SELECT o_orderkey, 'CY' || (year(o_orderdate) - 1) || 'Q' || quarter(o_orderdate) AS comparison_frame FROM orders")
oracle("scl_06_math", """
SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 8) + 0.0 AS log_value, round(sqrt(abs(c_acctbal)), 8) + 0.0 AS root,
  round(CASE WHEN c_acctbal > 0 THEN c_acctbal / (c_acctbal + 1) END, 8) + 0.0 AS share, round(greatest(least(c_acctbal, 5000), -100), 8) + 0.0 AS clipped FROM customer""")
oracle("scl_07_winsorize", "SELECT symbol, " + ", ".join(f"round({f}_winsorized, 8) + 0.0 AS {f}_winsorized, {f}_outlier_flag" for f in _WF) + " FROM trans")
oracle("scl_07_winsorize_as_of", "SELECT symbol, as_of, " + ", ".join(f"round({f}_winsorized, 8) + 0.0 AS {f}_winsorized, {f}_outlier_flag" for f in _WF) + " FROM then_trans")
oracle("scl_08_pe_validity", f"""
SELECT symbol, pe_is_meaningful, pe_exclusion_reason, {r('pe_ratio_raw provider_eps_ttm pe_ratio')} FROM valuation
UNION ALL SELECT n_name, false, 'provider overview missing', NULL, NULL, NULL FROM nation""")
oracle("scl_09_weighted_score", """
SELECT symbol, round(CASE WHEN c > 0 THEN t / c END, 8) + 0.0 AS score, round(c / 10.0::DOUBLE, 8) + 0.0 AS coverage,
  round(CASE WHEN c = 10 THEN t / c END, 8) + 0.0 AS strict_score
FROM (SELECT symbol, 4 * (momentum_63d_score IS NOT NULL)::INT + 4 * (valuation_score IS NOT NULL)::INT + 2 * (profitability_score IS NOT NULL)::INT AS c,
  4 * coalesce(momentum_63d_score, 0) + 4 * coalesce(valuation_score, 0) + 2 * coalesce(profitability_score, 0) AS t FROM pctl)""")
oracle("scl_10_subscores", f"""
SELECT symbol, incomplete_score_flag, score_eligible, parts AS intended_components_available,
  {r('momentum_subscore quality_subscore quality_subscore_coverage valuation_subscore composite_score score_coverage')} FROM scored""")
oracle("scl_10_subscores_as_of", f"""
SELECT symbol, as_of, incomplete_score_flag, score_eligible, parts AS intended_components_available,
  {r('momentum_subscore quality_subscore quality_subscore_coverage valuation_subscore composite_score score_coverage')} FROM then_scored""")
oracle("scl_11_direction_adjust_as_of", f"SELECT symbol, as_of, {r('momentum_21d_score growth_score profitability_score valuation_score drawdown_resilience_score')} FROM then_pctl")
oracle("scl_11_policy_table_as_of", "\nUNION ALL ".join(
    f"SELECT as_of, '{f}' AS feature, '{s}' AS scoring_source, '{d}' AS direction, '{sc or 'none'}' AS direction_adjusted_score, count({s}) AS eligible_count, "
    f"round(100.0::DOUBLE / nullif(count({s}), 0), 8) + 0.0 AS approximate_rank_step_points, true AS magnitude_preserved_in_raw_column FROM then_trans WHERE NOT is_benchmark GROUP BY as_of"
    for f, (s, d, sc) in _POLICY.items()))
oracle("scl_11_direction_adjust", f"SELECT symbol, {r('momentum_21d_score growth_score profitability_score valuation_score drawdown_resilience_score')} FROM pctl")
oracle("scl_11_policy_table", "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, '{s}' AS scoring_source, '{d}' AS direction, '{sc or 'none'}' AS direction_adjusted_score, count({s}) AS eligible_count, "
    f"round(100.0::DOUBLE / count({s}), 8) + 0.0 AS approximate_rank_step_points, true AS magnitude_preserved_in_raw_column FROM trans WHERE NOT is_benchmark"
    for f, (s, d, sc) in _POLICY.items()))
oracle("scl_12_score_label", f"SELECT {_label('score')} AS label, count(*) AS n_rows FROM (SELECT CASE WHEN l_quantity <> 13 THEN l_quantity * 2 END AS score FROM lineitem) GROUP BY 1")
oracle("scl_13_display_label", """
SELECT symbol, momentum_label, fundamentals_label, valuation_label, overall_label, overall_display_label, signal_is_eligible, signal_note FROM labelled""")
oracle("scl_14_technical_signal", f"SELECT symbol, date, {_SIGNAL} AS signal FROM feats")
oracle("scl_15_growth_metrics", f"""
SELECT symbol, latest_frame, comparison_frame, revenue_tag, net_income_tag, period_start, period_end, revenue_growth_available, profit_margin_available,
  unusual_margin_flag, quality_note, {r('revenue_growth_yoy profit_margin')}, {r('latest_revenue prior_year_revenue latest_net_income', 4)} FROM growth""")


def _evidence(test: str, text: str) -> str:
    return ", ".join(f"CASE WHEN {test.format(c=c)} THEN {text.format(n=n, c=c)} END"
                     for n, c in (("Momentum", "momentum_label"), ("Fundamentals", "fundamentals_label"), ("Valuation", "valuation_label")))


oracle("scl_16_evidence_lists", f"""
SELECT symbol, concat_ws(' | ', {_evidence("{c} IN ('Strong', 'Positive')", "'{n}: ' || {c}")}) AS strengths,
  concat_ws(' | ', {_evidence("{c} IN ('Weak', 'Very Weak')", "'{n}: ' || {c}")},
    CASE WHEN beta_252_raw > 1.5 THEN printf('Beta %.2f: historically more market-sensitive than the benchmark', beta_252_raw) END) AS cautions,
  concat_ws(' | ', {_evidence("({c} IS NULL OR {c} = 'Unavailable')", "'{n} score unavailable'")},
    CASE WHEN beta_252_raw IS NULL THEN '252-day beta unavailable' END,
    CASE WHEN score_coverage IS NULL THEN 'Composite-score coverage unavailable'
         WHEN score_coverage < 1 THEN 'Composite score uses only ' || round(score_coverage * 100)::INT || '% of intended component weight' END) AS data_gaps,
  coalesce(overall_display_label, 'Unavailable') AS overall FROM screener""")
_CONTEXT = {
    "valuation": ("pe_ratio_raw", "P/E", "A higher P/E means investors pay more per dollar of earnings and may increase downside risk if growth slows.", ""),
    "profitability": ("profit_margin_raw_pct", "Profit margin %", "A higher margin indicates more profit retained per dollar of revenue, but durability still needs investigation.", "%"),
    "risk": ("volatility_pct", "20D annualized volatility %", "Higher volatility means a wider range of recent price outcomes, not necessarily a worse company.", "%"),
}
oracle("scl_17_context_text", "\nUNION ALL ".join(f"""
SELECT symbol, '{k}' AS context, '{label}' AS label,
  CASE WHEN {c} IS NULL THEN 'Unavailable' WHEN p >= 67 THEN 'High' WHEN p <= 33 THEN 'Low' ELSE 'Middle-range' END AS status,
  CASE WHEN {c} IS NULL THEN 'Missing data is not treated as zero or favorable evidence.' ELSE '{meaning}' END AS meaning,
  CASE WHEN {c} IS NULL THEN 'Peer position cannot be calculated.' ELSE 'Higher than approximately ' || round_even(p, 0)::INT || '% of ' || (SELECT count({c}) FROM stocks) || ' valid stocks.' END AS peer_position,
  CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.1f', round({c}, 9)) || '{suffix}' END AS value_text
FROM (SELECT a.symbol, a.{c}, (SELECT count(*) FROM stocks b WHERE b.{c} <= a.{c})::DOUBLE / (SELECT count({c}) FROM stocks) * 100 AS p FROM screener a)"""
    for k, (c, label, meaning, suffix) in _CONTEXT.items()) + """
UNION ALL SELECT symbol, 'momentum', 'RSI 14',
  CASE WHEN rsi_14 IS NULL THEN 'Unavailable' WHEN rsi_14 >= 70 THEN 'Above 70' WHEN rsi_14 <= 30 THEN 'Below 30' ELSE '30–70 range' END,
  CASE WHEN rsi_14 IS NULL THEN 'Insufficient usable price history.'
       WHEN rsi_14 >= 70 THEN 'Recent gains are strong, but the move may be overextended; this is not an automatic sell signal.'
       WHEN rsi_14 <= 30 THEN 'Selling pressure is strong; this is not automatically a buy signal.'
       ELSE 'Momentum is not currently in an extreme reference zone.' END,
  CASE WHEN rsi_14 IS NULL THEN 'No RSI position is inferred.' WHEN rsi_14 >= 70 THEN 'Above the conventional upper reference zone.'
       WHEN rsi_14 <= 30 THEN 'Below the conventional lower reference zone.' ELSE 'Neither conventional RSI reference extreme is active.' END,
  CASE WHEN rsi_14 IS NULL THEN 'N/A' ELSE printf('%.1f', round(rsi_14, 9)) END FROM screener""")
_PROMPT = "Form a view only after checking business context, fundamentals, valuation, price/risk, and data gaps."
oracle("scl_17_context_lines", "\nUNION ALL ".join(f"""
SELECT symbol, '{k}' AS context, CASE WHEN {c} IS NULL THEN '{label}: unavailable; do not infer a zero or a favorable result.'
  ELSE '{label}: ' || printf('%.1f', round({c}, 9)) || ' (' || CASE WHEN p >= 67 THEN 'high' WHEN p <= 33 THEN 'low' ELSE 'middle-range' END || '; higher than about '
    || round_even(p, 0)::INT || '% of this ' || (SELECT count({c}) FROM stocks) || '-stock universe). {meaning}' END AS line, '{_PROMPT}' AS conclusion_prompt
FROM (SELECT a.symbol, a.{c}, (SELECT count(*) FROM stocks b WHERE b.{c} <= a.{c})::DOUBLE / (SELECT count({c}) FROM stocks) * 100 AS p FROM screener a)"""
    for k, (c, label, meaning, suffix) in _CONTEXT.items()) + f"""
UNION ALL SELECT symbol, 'momentum', 'RSI 14: ' || CASE WHEN rsi_14 IS NULL THEN 'unavailable because there is insufficient usable price history.'
  ELSE printf('%.1f', round(rsi_14, 9)) || CASE WHEN rsi_14 >= 70 THEN ', above 70. Recent gains are strong, but this can indicate an overextended move.'
    WHEN rsi_14 <= 30 THEN ', below 30. Selling pressure is strong; this is not automatically a buy signal.'
    ELSE ', between 30 and 70; neither reference extreme is active.' END END, '{_PROMPT}' FROM screener""")
oracle("scl_18_json_get", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, -1::BIGINT AS missing FROM events")
oracle("scl_19_iso_dates", """SELECT o_orderkey, '{"d":"' || strftime(o_orderdate, '%Y-%m-%d') || '","x":null}' AS document FROM orders""")
