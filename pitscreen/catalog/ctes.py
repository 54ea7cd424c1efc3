"""Shared sub-queries of the SQL counterparts."""
from __future__ import annotations

W = "PARTITION BY ticker ORDER BY date"


def roll(agg: str, col: str, n: int, w: str = W) -> str:
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {agg}({col}) {frame} END"


def ret(k: int) -> str:
    return f"close / nullif(lag(close, {k}) OVER ({W}), 0) - 1"


def ups(ks: list[int]) -> str:
    return "(" + " + ".join(f"CAST(coalesce(ret_{k} > 0, FALSE) AS INT)" for k in ks) + ")"


def asof(req: str, lag: int = 90) -> str:
    """Snapshot per (ticker, as_of) of a request table, straight from the definition."""
    return f"""
    SELECT r.ticker, r.as_of, b.statement_date, b.filed_date,
           CASE WHEN p.val > 0 THEN (b.revenue - p.val) / p.val END AS revenue_growth_yoy,
           CASE WHEN b.equity > 0 THEN b.lt_debt / b.equity END AS debt_to_equity,
           CASE WHEN b.equity > 0 THEN b.net_income / b.equity END AS roe,
           b.net_income / nullif(b.revenue, 0) AS net_margin
    FROM (SELECT DISTINCT ticker, as_of FROM {req}) r
    LEFT JOIN (
        SELECT ticker, as_of, max(CASE WHEN item = 'revenue' THEN period_end END) AS statement_date,
               max(CASE WHEN item = 'revenue' THEN filed END) AS filed_date,
               max(CASE WHEN item = 'revenue' THEN concept END) AS concept,
               max(CASE WHEN item = 'revenue' THEN val END) AS revenue,
               max(CASE WHEN item = 'net_income' THEN val END) AS net_income,
               max(CASE WHEN item = 'equity' THEN val END) AS equity,
               max(CASE WHEN item = 'lt_debt' THEN val END) AS lt_debt
        FROM (SELECT q.ticker, q.as_of, a.* EXCLUDE (ticker)
              FROM (SELECT DISTINCT ticker, as_of FROM {req}) q JOIN annual a
                ON a.ticker = q.ticker AND a.filed <= q.as_of - {lag}
              QUALIFY row_number() OVER (PARTITION BY q.ticker, q.as_of, item ORDER BY period_end DESC, pref, filed DESC) = 1)
        GROUP BY ticker, as_of HAVING revenue IS NOT NULL) b ON b.ticker = r.ticker AND b.as_of = r.as_of
    LEFT JOIN (
        SELECT q.ticker, q.as_of, a.concept, a.period_end, a.val
        FROM (SELECT DISTINCT ticker, as_of FROM {req}) q JOIN annual a
          ON a.ticker = q.ticker AND a.filed <= q.as_of - {lag} AND a.item = 'revenue'
        QUALIFY row_number() OVER (PARTITION BY q.ticker, q.as_of, a.concept, a.period_end ORDER BY a.filed DESC) = 1) p
      ON p.ticker = r.ticker AND p.as_of = r.as_of AND p.concept = b.concept
         AND date_diff('day', p.period_end, b.statement_date) BETWEEN 280 AND 420"""


def gate(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f"CASE WHEN {a}revenue_growth_yoy IS NULL OR {a}net_margin IS NULL THEN NULL "
            f"WHEN {a}debt_to_equity IS NULL THEN FALSE "
            f"ELSE {a}revenue_growth_yoy > 0 AND {a}debt_to_equity < 3 AND {a}net_margin > 0 END")


def shares(req: str, lag: int = 90) -> str:
    pick = ("SELECT q.ticker, q.as_of, arg_max(f.val, strftime(f.filed, '%Y-%m-%d') || coalesce(strftime(f.period_end, '%Y-%m-%d'), '')) AS v "
            "FROM (SELECT DISTINCT ticker, as_of FROM {req}) q JOIN facts f ON f.ticker = q.ticker AND f.filed <= q.as_of - {lag} "
            "WHERE f.taxonomy = '{tax}' AND f.concept = '{con}' AND f.unit = 'shares' AND f.form IN ('10-K', '10-Q') AND f.val <> 0 GROUP BY 1, 2")
    dei = pick.format(req=req, lag=lag, tax="dei", con="EntityCommonStockSharesOutstanding")
    gaap = pick.format(req=req, lag=lag, tax="us-gaap", con="CommonStockSharesOutstanding")
    return f"""
    SELECT r.ticker, r.as_of, coalesce(CASE WHEN a.v > 0 THEN a.v END, CASE WHEN b.v > 0 THEN b.v END) AS shares
    FROM (SELECT DISTINCT ticker, as_of FROM {req}) r
    LEFT JOIN ({dei}) a USING (ticker, as_of) LEFT JOIN ({gaap}) b USING (ticker, as_of)"""


def caps(req: str) -> str:
    return f"""
    SELECT s.ticker, s.as_of, c.close AS raw_close, s.shares,
           CASE WHEN c.close > 0 AND s.shares > 0 THEN c.close * s.shares END AS mcap
    FROM ({shares(req)}) s ASOF LEFT JOIN bars c ON c.ticker = s.ticker AND c.date <= s.as_of"""


DAY = "date_diff('day', DATE '1969-12-29', {0})"


def busday(a: str, b: str) -> str:
    one = lambda x: (f"(5 * CAST(floor({DAY.format(x)} / 7.0) AS BIGINT) + "  # noqa: E731
                     f"least(((({DAY.format(x)}) % 7) + 7) % 7, 5))")
    return f"({one(b)} - {one(a)})"


SAMPLED = "(CAST('0x' || substr(md5(ticker || '|' || strftime(date, '%Y-%m-%d') || '|42'), 1, 8) AS BIGINT) % 10 = 0)"

CTES = {
    "bars": """
    SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, seq) AS open, max(px) AS high,
           min(px) AS low, arg_max(px, seq) AS close, CAST(sum(qty) AS DOUBLE) AS volume
    FROM (SELECT *, 20 + (l_extendedprice % 8000) / 100 AS px, l_orderkey * 10 + l_linenumber AS seq,
                 CASE WHEN l_quantity >= 49 THEN 2000 ELSE l_quantity END AS qty FROM lineitem) GROUP BY 1, 2""",
    "bench": "SELECT date, avg(close) AS close FROM bars GROUP BY date",
    "stm": """
    SELECT CAST(y.suppkey AS VARCHAR) AS ticker, y.suppkey, y.year, make_date(y.year, 12, 31) AS statement_date,
           make_date(y.year, 12, 31) + CAST(30 + y.suppkey % 90 AS INTEGER) AS filed_date, revenue, net_income, lt_debt, s_acctbal * 100 AS equity
    FROM (SELECT l_suppkey AS suppkey, year(l_shipdate) AS year, sum(l_extendedprice * (1 - l_discount)) AS revenue,
                 sum(l_extendedprice * (CAST(0.05 AS DOUBLE) - l_discount)) AS net_income, sum(l_extendedprice * l_tax) AS lt_debt
          FROM lineitem GROUP BY 1, 2) y JOIN supplier ON s_suppkey = y.suppkey""",
    "facts": """
    SELECT ticker, 'us-gaap' AS taxonomy, CASE WHEN suppkey % 5 = 0 AND year >= 1998 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'Revenues' END AS concept,
           'USD' AS unit, '10-K' AS form, 'FY' AS fp, statement_date AS period_end, filed_date AS filed, revenue AS val FROM stm
    UNION ALL SELECT ticker, 'us-gaap', CASE WHEN suppkey % 5 = 0 AND year >= 1998 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'Revenues' END,
           'USD', '10-K', 'FY', statement_date, filed_date + 365, revenue * CAST(1.01 AS DOUBLE) FROM stm WHERE suppkey % 3 = 0
    UNION ALL SELECT ticker, 'us-gaap', 'NetIncomeLoss', 'USD', '10-K', 'FY', statement_date, filed_date, net_income FROM stm
    UNION ALL SELECT ticker, 'us-gaap', CASE WHEN suppkey % 7 = 0 THEN 'LongTermDebtNoncurrent' ELSE 'LongTermDebt' END, 'USD', '10-K', 'FY', statement_date, filed_date, lt_debt FROM stm WHERE suppkey % 11 <> 0
    UNION ALL SELECT ticker, 'us-gaap', 'StockholdersEquity', 'USD', '10-K', 'FY', statement_date, filed_date, equity FROM stm
    UNION ALL SELECT ticker, 'us-gaap', CASE WHEN suppkey % 5 = 0 AND year >= 1998 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'Revenues' END,
           'USD', '10-Q', 'Q2', make_date(year, 6, 30), make_date(year, 6, 30) + 45, revenue * CAST(0.5 AS DOUBLE) FROM stm
    UNION ALL SELECT ticker, 'us-gaap', 'Assets', 'USD', '10-K', 'FY', statement_date, filed_date, revenue * 3 FROM stm
    UNION ALL SELECT ticker, 'dei', 'EntityCommonStockSharesOutstanding', 'shares', '10-K', 'FY', statement_date, filed_date, CAST(1000000 * (1 + suppkey % 17) AS DOUBLE) FROM stm WHERE suppkey % 4 <> 0
    UNION ALL SELECT ticker, 'us-gaap', 'CommonStockSharesOutstanding', 'shares', '10-K', 'FY', statement_date, filed_date, CAST(1000000 * (1 + suppkey % 17) + 1 AS DOUBLE) FROM stm""",
    "annual": """
    SELECT ticker, concept, period_end, filed, max(val) AS val,
           CASE WHEN concept IN ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax') THEN 'revenue' WHEN concept = 'NetIncomeLoss' THEN 'net_income'
                WHEN concept = 'StockholdersEquity' THEN 'equity' ELSE 'lt_debt' END AS item,
           CASE WHEN concept IN ('RevenueFromContractWithCustomerExcludingAssessedTax', 'LongTermDebtNoncurrent') THEN 1 ELSE 0 END AS pref
    FROM facts WHERE taxonomy = 'us-gaap' AND unit = 'USD' AND form = '10-K' AND fp = 'FY' AND concept IN
      ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'NetIncomeLoss', 'StockholdersEquity', 'LongTermDebt', 'LongTermDebtNoncurrent')
    GROUP BY 1, 2, 3, 4""",
    "filings": """
    SELECT CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS ticker,
           CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'P' THEN '10-Q' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) AS filing_date,
           CASE o_orderpriority WHEN '1-URGENT' THEN ['2.02', '4.02'] WHEN '2-HIGH' THEN ['5.02'] WHEN '3-MEDIUM' THEN ['1.03'] ELSE CAST([] AS VARCHAR[]) END AS items,
           lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession, o_orderkey % (SELECT count(*) FROM documents) AS doc_id FROM orders""",
    "distress": """
    SELECT ticker, filing_date, accession, list_filter(items, lambda x: x IN ('1.03', '4.01', '4.02', '1.05'))[1] AS item FROM filings
    WHERE form = '8-K' AND len(list_filter(items, lambda x: x IN ('1.03', '4.01', '4.02', '1.05'))) > 0""",
    "rates": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount) AS rate FROM lineitem GROUP BY 1",
    "members": "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem",
    "splits": """
    SELECT ticker, filing_date AS split_date, max(CASE WHEN items[1] = '2.02' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END) AS ratio FROM filings
    WHERE form = '10-Q' AND items[1] IN ('2.02', '5.02') GROUP BY 1, 2""",
    "ind": f"""
    SELECT *, row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY ticker) AS n_bars,
           {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 200)} AS sma_200, {roll('max', 'close', 252)} AS high_52w,
           ({roll('avg', 'volume', 10)}) / nullif({roll('avg', 'volume', 90)}, 0) AS vol_ratio,
           greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS true_range,
           {', '.join(f'{ret(k)} AS ret_{k}' for k in (5, 10, 15, 20, 25, 30, 35, 40))} FROM bars""",
    "ind2": f"""
    SELECT *, {roll('avg', 'true_range', 14)} AS atr_14, greatest((high_52w - close) / high_52w, 0) AS dd0,
           CASE WHEN high_52w IS NOT NULL THEN greatest((high_52w - close) / high_52w, 0) END AS drawdown_52w,
           coalesce(lag(close) OVER ({W}) <= lag(sma_50) OVER ({W}) AND close > sma_50, FALSE) AS crossed_up,
           sma_200 > lag(sma_200, 20) OVER ({W}) AS sma_rising FROM ind""",
    "scored_all": f"""
    SELECT *, CAST(0.5 AS DOUBLE) * dip_score + CAST(0.3 AS DOUBLE) * momentum_score + CAST(0.2 AS DOUBLE) * volume_score AS composite_score FROM (
    SELECT *, CAST(CASE WHEN drawdown_52w < CAST(0.30 AS DOUBLE) THEN 0 WHEN drawdown_52w < CAST(0.40 AS DOUBLE) THEN 0.7 WHEN drawdown_52w <= CAST(0.60 AS DOUBLE) THEN 1
                   WHEN drawdown_52w <= CAST(0.70 AS DOUBLE) THEN 0.5 WHEN drawdown_52w > CAST(0.70 AS DOUBLE) THEN 0 END AS DOUBLE) AS dip_score,
           CAST(CASE WHEN ret_40 IS NULL THEN NULL WHEN {ups([25, 30, 35, 40])} <= 1 AND {ups([5, 10, 15, 20])} >= 3 THEN 1
                     WHEN {ups([25, 30, 35, 40])} <= 1 AND {ups([5, 10, 15, 20])} >= 2 THEN 0.6 ELSE 0 END AS DOUBLE) AS recovery_score,
           least(CAST(1 AS DOUBLE), {ups([5, 10, 15, 20])} / CAST(4 AS DOUBLE) + CAST(crossed_up AS INT) * CAST(0.15 AS DOUBLE)) AS momentum_score,
           CAST(CASE WHEN vol_ratio >= 2 THEN 1 WHEN vol_ratio >= CAST(1.5 AS DOUBLE) THEN 0.8 WHEN vol_ratio >= 1 THEN 0.5
                     WHEN vol_ratio >= CAST(0.8 AS DOUBLE) THEN 0.3 WHEN vol_ratio < CAST(0.8 AS DOUBLE) THEN 0.1 END AS DOUBLE) AS volume_score FROM ind2)""",
    "scored": "SELECT * FROM scored_all WHERE n_bars >= 252",
    "chg": f"SELECT ticker, date, pos, close - lag(close) OVER ({W}) AS c FROM ind",
    "ema_rows": """
    SELECT ticker, pos, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM chg WHERE pos = 1
    UNION ALL
    SELECT c.ticker, c.pos, CASE WHEN e.g IS NULL THEN greatest(c.c, 0) ELSE (1 - CAST(1 AS DOUBLE) / 14) * e.g + greatest(c.c, 0) / CAST(14 AS DOUBLE) END,
           CASE WHEN e.l IS NULL THEN greatest(-c.c, 0) ELSE (1 - CAST(1 AS DOUBLE) / 14) * e.l + greatest(-c.c, 0) / CAST(14 AS DOUBLE) END
    FROM ema_rows e JOIN chg c ON c.ticker = e.ticker AND c.pos = e.pos + 1""",
    "rsi_rows": """
    SELECT ticker, pos, CASE WHEN g = 0 AND l = 0 THEN 50 ELSE 100 - 100 / (1 + g / CASE WHEN l = 0 THEN CAST(1e-10 AS DOUBLE) ELSE l END) END AS rsi_14 FROM ema_rows""",
    "entry_all": """
    SELECT *, CAST(0.3 AS DOUBLE) * trend_score + CAST(0.3 AS DOUBLE) * momentum_score + CAST(0.2 AS DOUBLE) * volume_score + CAST(0.2 AS DOUBLE) * rsi_score AS composite_score FROM (
    SELECT s.* EXCLUDE (composite_score), r.rsi_14,
           CAST(CASE WHEN close <= sma_50 THEN 0 WHEN close > sma_50 AND close <= sma_200 THEN 0.4 WHEN close > sma_200 AND NOT sma_rising THEN 0.7
                     WHEN close > sma_200 AND sma_rising THEN 1 END AS DOUBLE) AS trend_score,
           CAST(CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 < 45 THEN 0.8 WHEN rsi_14 < 60 THEN 0.6 WHEN rsi_14 < 70 THEN 0.3 WHEN rsi_14 >= 70 THEN 0 END AS DOUBLE) AS rsi_score
    FROM scored_all s JOIN rsi_rows r USING (ticker, pos))""",
    "req_year": "SELECT DISTINCT ticker, year(date) AS year, make_date(year(date), 12, 31) AS as_of FROM bars",
    "snap_year": asof("req_year"),
    "gates": f"SELECT ticker, year(as_of) AS year, {gate()} AS gate FROM snap_year",
    "regimes": f"""
    SELECT date, close, above_ma, CASE WHEN sma > lag(sma, 20) OVER (ORDER BY date) THEN 'bull' ELSE 'bear' END AS regime
    FROM (SELECT *, {roll('avg', 'close', 200, 'ORDER BY date')} AS sma, coalesce(close >= {roll('avg', 'close', 200, 'ORDER BY date')}, FALSE) AS above_ma FROM bench)""",
    "fdd": f"""
    SELECT ticker, pos, min((c - top) / top) AS max_dd FROM (
      SELECT a.ticker, a.pos, b.close AS c, max(b.close) OVER (PARTITION BY a.ticker, a.pos ORDER BY b.pos) AS top
      FROM ind a JOIN ind b ON b.ticker = a.ticker AND b.pos BETWEEN a.pos AND a.pos + 62) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "outcomes": f"""
    SELECT s.*, g.gate, coalesce(r.regime, 'unknown') AS regime, {SAMPLED} AS sampled,
           lead(s.close, 21) OVER (PARTITION BY s.ticker ORDER BY s.date) / s.close - 1 AS fwd_21,
           lead(s.close, 63) OVER (PARTITION BY s.ticker ORDER BY s.date) / s.close - 1 AS fwd_63,
           min(s.close) OVER (PARTITION BY s.ticker ORDER BY s.date ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / s.close - 1 AS mae,
           count(*) OVER (PARTITION BY s.ticker ORDER BY s.date ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) AS ahead
    FROM scored s LEFT JOIN gates g ON g.ticker = s.ticker AND g.year = year(s.date) LEFT JOIN regimes r ON r.date = s.date"""
    .replace(SAMPLED, SAMPLED.replace("ticker", "s.ticker").replace("(date", "(s.date")),
    "study": "SELECT o.*, f.max_dd FROM outcomes o LEFT JOIN fdd f USING (ticker, pos)",
    "buckets": """
    SELECT 'HIGH' AS bucket, * FROM study WHERE gate AND composite_score >= CAST(0.6 AS DOUBLE)
    UNION ALL SELECT 'LOW', * FROM study WHERE gate AND composite_score < CAST(0.35 AS DOUBLE)
    UNION ALL SELECT 'RANDOM', * FROM study WHERE sampled""",
    "high": "SELECT * FROM outcomes WHERE gate AND composite_score >= CAST(0.6 AS DOUBLE)",
    "crossed": f"""
    SELECT * FROM (SELECT *, coalesce(lag(b) OVER ({W}), FALSE) AS was FROM (
      SELECT *, coalesce(composite_score >= CAST(0.6 AS DOUBLE), FALSE) AS b FROM scored)) WHERE b AND NOT was""",
    "gcrossed": f"""
    SELECT * FROM (SELECT *, coalesce(lag(b) OVER ({W}), FALSE) AS was FROM (
      SELECT *, coalesce(composite_score >= CAST(0.6 AS DOUBLE) AND gate, FALSE) AS b FROM outcomes)) WHERE b AND NOT was""",
    "trades": f"""
    SELECT *, coalesce(lead(close, 64) OVER ({W}), last_value(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit_price,
           coalesce(lead(date, 64) OVER ({W}), last_value(date) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit_date,
           CASE WHEN lead(close, 64) OVER ({W}) IS NOT NULL THEN 'CLOSED' ELSE 'OPEN' END AS status,
           CASE WHEN lead(open) OVER ({W}) > 0 THEN lead(open) OVER ({W}) END AS entry_price, lead(date) OVER ({W}) AS entry_date,
           least(n_bars - pos, 64) - 1 AS bars_held,
           coalesce(lead(close, 64) OVER ({W}), last_value(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) /
             CASE WHEN lead(open) OVER ({W}) > 0 THEN lead(open) OVER ({W}) END - 1 AS trade_return,
           coalesce(lead(close, 63) OVER ({W}), last_value(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / close - 1 AS same_close_return
    FROM outcomes""",
    "kept": """
    SELECT ticker, min(pos) AS pos FROM crossed GROUP BY ticker
    UNION ALL
    SELECT k.ticker, min(c.pos) AS pos FROM kept k JOIN crossed c ON c.ticker = k.ticker AND c.pos >= k.pos + 63 GROUP BY k.ticker""",
    "gkept": """
    SELECT ticker, min(pos) AS pos FROM gcrossed GROUP BY ticker
    UNION ALL
    SELECT k.ticker, min(c.pos) AS pos FROM gkept k JOIN gcrossed c ON c.ticker = k.ticker AND c.pos >= k.pos + 63 GROUP BY k.ticker""",
    "paths": """
    SELECT e.ticker, e.date AS entry_date, b.pos - e.pos AS day, b.date, b.close, b.close / e.close AS ratio, e.close AS entry_price, b.atr_14 AS atr, e.atr_14 AS entry_atr, b.composite_score,
           min(b.close / e.close) OVER (PARTITION BY e.ticker, e.date ORDER BY b.pos) AS run_min, max(b.close / e.close) OVER (PARTITION BY e.ticker, e.date ORDER BY b.pos) AS run_max
    FROM crossed e JOIN scored b ON b.ticker = e.ticker AND b.pos BETWEEN e.pos + 1 AND e.pos + 252 WHERE e.pos + 252 <= e.n_bars""",
    "month_first": "SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS as_of FROM bench GROUP BY 1",
    "month_universe": "SELECT m.month, m.as_of, u.ticker FROM month_first m JOIN members u ON u.date = (SELECT max(date) FROM members WHERE date <= m.as_of)",
    "caps_month": caps("month_universe"),
    "ranked": "SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mcap DESC, ticker) AS cap_rank FROM caps_month WHERE mcap > 0",
}


def _even(text: str, swaps: dict[str, str]) -> str:
    for old, new in swaps.items():
        if old not in text:
            raise ValueError(old)
        text = text.replace(old, new)
    return text


#: The same with `guards.above` stated: averages that differ by rounding alone, which depends on the order of a sum, are equal.
ABOVE = "{0} > {1} * (1 + CAST(1e-12 AS DOUBLE))"
CTES["even"] = _even(CTES["ind2"], {
    f"lag(close) OVER ({W}) <= lag(sma_50) OVER ({W}) AND close > sma_50": f"NOT ({ABOVE.format(f'lag(close) OVER ({W})', f'lag(sma_50) OVER ({W})')}) AND {ABOVE.format('close', 'sma_50')}",
    f"sma_200 > lag(sma_200, 20) OVER ({W})": ABOVE.format("sma_200", f"lag(sma_200, 20) OVER ({W})")})
CTES["even_scored"] = _even(CTES["scored_all"], {"FROM ind2)": "FROM even)"})
CTES["even_entry"] = _even(CTES["entry_all"], {
    "FROM scored_all s": "FROM even_scored s", "close <= sma_50": f"NOT ({ABOVE.format('close', 'sma_50')})",
    "close > sma_50 AND close <= sma_200": f"{ABOVE.format('close', 'sma_50')} AND NOT ({ABOVE.format('close', 'sma_200')})",
    "close > sma_200 AND": f"{ABOVE.format('close', 'sma_200')} AND"})
