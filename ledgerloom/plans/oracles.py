"""The registered queries in DuckDB SQL, put together from shared common table expressions."""

from __future__ import annotations

#: The last day of the tables.
LAST = "(SELECT max(d) FROM (SELECT CAST(max(l_shipdate) AS DATE) AS d FROM lineitem UNION ALL SELECT CAST(max(o_orderdate) AS DATE) FROM orders))"
UNITS = "CAST(floor(({}) * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def units(x: str) -> str:
    return UNITS.format(x)


FX = "CASE currency WHEN 'USD' THEN 9.34::DOUBLE WHEN 'EUR' THEN 10.87::DOUBLE ELSE 1.0::DOUBLE END"
CTES = {
    "instruments": f"""SELECT s_suppkey, 'XX' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS isin, upper(s_name) AS symbol, s_name AS name, currency, {FX} AS fx, sleeve_id
      FROM (SELECT s.*, CASE s_nationkey % 4 WHEN 0 THEN 'SEK' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS currency, CASE WHEN s_suppkey % 10 = 7 THEN NULL ELSE n_regionkey END AS sleeve_id FROM supplier s JOIN nation ON s_nationkey = n_nationkey)""",
    "sleeves": "SELECT r_regionkey AS id, r_name AS code, r_name AS name, [0.24, 0.11, 0.45, 0.10, 0.10][r_regionkey + 1]::DOUBLE AS target_weight, r_regionkey AS sort_order FROM region",
    "numbered": """SELECT l.*, i.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
      CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS kind, CAST(l_quantity AS DOUBLE) AS quantity, floor(l_extendedprice / (l_quantity * fx)) AS price FROM lineitem l JOIN instruments i ON l_suppkey = s_suppkey""",
    "trades": """SELECT l_suppkey * 10000000 + n AS id, CAST(l_shipdate AS DATE) AS date, isin, symbol, name, currency, fx, kind, quantity, price,
      CASE WHEN l_linestatus = 'F' THEN CASE WHEN kind = 'sell' THEN quantity * price * fx ELSE -(quantity * price * fx) END END AS amount_sek, quantity * price * l_tax AS fees_sek,
      CASE WHEN l_linenumber % 2 = 1 THEN 'avanza' ELSE 'manual' END AS source FROM numbered""",
    "flows": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'P' THEN -abs(o_totalprice) ELSE abs(o_totalprice) END AS amount_sek,
      CASE WHEN o_orderstatus = 'P' THEN 'withdrawal' ELSE 'deposit' END AS kind, CASE WHEN o_orderpriority = '1-URGENT' THEN 'manual' ELSE 'avanza' END AS source FROM orders""",
    "closes": "SELECT CAST(l_shipdate AS DATE) AS date, symbol AS ticker, max(price) AS close FROM numbered WHERE l_linestatus = 'F' AND l_suppkey % 10 <> 0 GROUP BY 1, 2",
    "steps": "SELECT *, row_number() OVER (PARTITION BY isin ORDER BY date, id) AS step FROM trades",
    "states": """SELECT isin, step, id, date, q, c, s FROM folded""",
    "last_states": "SELECT f.*, m.acquired_at, m.name, m.currency, m.fx FROM (SELECT * FROM folded QUALIFY step = max(step) OVER (PARTITION BY isin)) f JOIN (SELECT isin, min(CASE WHEN kind = 'buy' THEN date END) AS acquired_at, any_value(name) AS name, any_value(currency) AS currency, any_value(fx) AS fx FROM trades GROUP BY isin) m USING (isin)",
    "positions": "SELECT isin, q AS quantity, c / q AS avg_price, s AS cost_sek, acquired_at, name, currency, fx FROM last_states WHERE q > 0",
    "newest": "SELECT ticker AS symbol, max(date) AS last_price_date, arg_max(close, date) AS last_price FROM closes GROUP BY ticker",
    "holdings": """SELECT i.s_suppkey AS id, sleeve_id, symbol, i.isin, i.name, i.currency, i.fx, coalesce(p.quantity, 0.0) AS quantity, coalesce(p.avg_price, 0.0) AS avg_price, coalesce(p.cost_sek, 0.0) AS cost_basis_sek, p.acquired_at,
      last_price, last_price_date FROM instruments i LEFT JOIN positions p ON p.isin = i.isin LEFT JOIN newest USING (symbol)""",
    "valued": f"""SELECT *, market_value - cost_basis AS unrealized_pnl FROM (SELECT *, coalesce(last_price, avg_price) AS price, CASE WHEN last_price IS NULL THEN 'cost' ELSE 'minio' END AS price_label,
      {units("quantity * coalesce(last_price, avg_price) * fx")} AS market_value, {units("cost_basis_sek")} AS cost_basis FROM holdings)""",
    "moves": f"SELECT date, {units("coalesce(amount_sek, CASE WHEN kind = 'buy' THEN -(quantity * price * fx) - fees_sek ELSE quantity * price * fx - fees_sek END)")} AS units, 0::BIGINT AS flow_units FROM trades UNION ALL SELECT date, {units('amount_sek')}, {units('amount_sek')} FROM flows",
    "cash": "SELECT date, CAST(sum(sum(units)) OVER w AS BIGINT) AS cash, CAST(sum(sum(flow_units)) OVER w AS BIGINT) AS flows FROM moves GROUP BY date WINDOW w AS (ORDER BY date)",
    "eod": "SELECT f.isin, f.date, q, c, s, fx FROM (SELECT * FROM folded QUALIFY step = max(step) OVER (PARTITION BY isin, date)) f JOIN instruments USING (isin)",
    "calendar": f"SELECT DISTINCT date FROM (SELECT date FROM closes WHERE date BETWEEN (SELECT min(date) FROM trades) AND {LAST} UNION ALL SELECT min(date) FROM trades UNION ALL SELECT {LAST})",
    "dense": f"SELECT CAST(unnest(generate_series(greatest((SELECT min(date) FROM trades), {LAST} - 364), {LAST}, INTERVAL 1 DAY)) AS DATE) AS date",
}
#: What each expression is built on.
NEEDS = {
    "instruments": [], "sleeves": [], "numbered": ["instruments"], "trades": ["numbered"], "flows": [], "closes": ["numbered"], "steps": ["trades"], "states": ["folded"], "last_states": ["folded", "trades"], "positions": ["last_states"],
    "newest": ["closes"], "holdings": ["instruments", "positions", "newest"], "valued": ["holdings"], "moves": ["trades", "flows"], "cash": ["moves"], "eod": ["folded", "instruments"], "calendar": ["closes", "trades"], "dense": ["trades"],
}
#: The fold: one step of every instrument at a time.
FOLD = """SELECT isin, step, id, date, CASE WHEN kind = 'buy' THEN quantity ELSE -quantity END AS q, CASE WHEN kind = 'buy' THEN quantity * price ELSE 0.0 END AS c, CASE WHEN kind = 'buy' THEN coalesce(abs(amount_sek), quantity * price) ELSE 0.0 END AS s FROM steps WHERE step = 1
  UNION ALL SELECT t.isin, t.step, t.id, t.date,
    CASE WHEN t.kind = 'buy' THEN f.q + t.quantity WHEN f.q > 0 THEN f.q - least(t.quantity, f.q) ELSE f.q - t.quantity END,
    CASE WHEN t.kind = 'buy' THEN f.c + t.quantity * t.price WHEN f.q > 0 THEN f.c - f.c / f.q * least(t.quantity, f.q) ELSE f.c END,
    CASE WHEN t.kind = 'buy' THEN f.s + coalesce(abs(t.amount_sek), t.quantity * t.price) WHEN f.q > 0 THEN f.s - f.s / f.q * least(t.quantity, f.q) ELSE f.s END
  FROM folded f JOIN steps t ON t.isin = f.isin AND t.step = f.step + 1"""


def query(final: str, *uses: str, extra: dict[str, str] | None = None, recursive: dict[str, str] | None = None) -> str:
    """WITH RECURSIVE ... final, with the named expressions and all they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name == "folded":
            add("steps")
            done[name] = FOLD
            return
        for n in NEEDS[name]:
            add(n)
        done[name] = CTES[name]

    for u in uses:
        add(u)
    done |= extra or {}
    done |= recursive or {}
    # The fold is read several times and must be computed once.
    how = lambda n: " AS MATERIALIZED " if n in ("steps", "trades", "closes", "days", "series", "chained") else " AS "
    head = ", ".join(f"{n}{how(n)}({sql})" for n, sql in done.items())
    return f"WITH RECURSIVE {head} {final}" if head else final


def value_per_day(calendar: str, keep: str = "") -> str:
    """Value and cost of all positions on each day of a calendar, in units, by as-of joins."""
    value, cost = units("q * coalesce(p.close, c / q) * fx"), units("s")
    return f"""SELECT d.date, CAST(coalesce(sum(CASE WHEN q > 0 THEN {value} ELSE 0 END), 0) AS BIGINT) AS value, CAST(coalesce(sum(CASE WHEN q > 0 THEN {cost} ELSE 0 END), 0) AS BIGINT) AS cost
      FROM (SELECT date, isin, symbol FROM {calendar}, instruments {keep}) d ASOF LEFT JOIN eod e ON d.isin = e.isin AND d.date >= e.date ASOF LEFT JOIN closes p ON d.symbol = p.ticker AND d.date >= p.date GROUP BY d.date"""


DAYS = """SELECT v.date, value + greatest(coalesce(k.cash, 0)::BIGINT, 0::BIGINT) AS gross, cost, greatest(-(coalesce(k.cash, 0)::BIGINT), 0::BIGINT) AS loan, coalesce(k.flows, 0) AS flows FROM per_day v ASOF LEFT JOIN cash k ON v.date >= k.date"""
SERIES = """SELECT *, row_number() OVER (ORDER BY date) AS n FROM (SELECT date, (gross - loan)::DOUBLE / 10000.0::DOUBLE AS equity, (flows - coalesce(lag(flows) OVER (ORDER BY date), 0))::DOUBLE / 10000.0::DOUBLE AS net_contribution,
  gross::DOUBLE / 10000.0::DOUBLE AS gross_asset_value, cost::DOUBLE / 10000.0::DOUBLE AS cost_basis, loan::DOUBLE / 10000.0::DOUBLE AS loan_balance FROM days) WHERE equity > 0"""
CHAIN = """SELECT n, date, equity, NULL::DOUBLE AS twr_period, 1.0::DOUBLE AS nav_index, 1.0::DOUBLE AS peak_nav_index FROM series WHERE n = 1
  UNION ALL SELECT s.n, s.date, s.equity, (s.equity - c.equity - s.net_contribution) / c.equity, c.nav_index * (1.0::DOUBLE + (s.equity - c.equity - s.net_contribution) / c.equity),
    greatest(c.peak_nav_index, c.nav_index * (1.0::DOUBLE + (s.equity - c.equity - s.net_contribution) / c.equity)) FROM chained c JOIN series s ON s.n = c.n + 1"""
NAV_EXTRA = {"per_day": value_per_day("calendar"), "days": DAYS, "series": SERIES}
NAV_USES = ("calendar", "eod", "closes", "instruments", "cash")
STATE = "CASE WHEN drawdown <= -0.45 THEN 'full' WHEN drawdown <= -0.35 THEN 'half' ELSE 'normal' END"
NAV_ROWS = """SELECT s.date, s.equity, s.net_contribution, s.gross_asset_value, s.cost_basis, s.loan_balance, c.twr_period, c.nav_index, c.peak_nav_index, c.nav_index / c.peak_nav_index - 1.0::DOUBLE AS drawdown,
  s.gross_asset_value / s.equity AS effective_leverage, CASE WHEN s.gross_asset_value > 0 THEN s.loan_balance / s.gross_asset_value ELSE 0.0 END AS belaningsgrad FROM series s JOIN chained c USING (n)"""


def nav(final: str, *uses: str) -> str:
    return query(final, *NAV_USES, *uses, extra=NAV_EXTRA, recursive={"chained": CHAIN, "nav_rows": NAV_ROWS})


JOURNAL_KEEP = "WHERE sleeve_id IS NOT NULL"
JOURNAL = {
    "per_day": value_per_day("dense", JOURNAL_KEEP),
    "events": """SELECT date, concat_ws(' ', string_agg('+' || symbol, ' ' ORDER BY symbol) FILTER (kind = 'buy'), string_agg('−' || symbol, ' ' ORDER BY symbol) FILTER (kind = 'sell')) AS event
      FROM (SELECT DISTINCT date, symbol, kind FROM trades JOIN (SELECT isin FROM instruments WHERE sleeve_id IS NOT NULL) USING (isin)) GROUP BY date""",
    "series": "SELECT date, value, cost AS cost_basis, value - cost AS pnl, coalesce((value - cost) - lag(value - cost) OVER (ORDER BY date), 0) AS day_pnl, event IS NOT NULL AS has_event, event FROM per_day LEFT JOIN events USING (date)",
}


def journal(final: str) -> str:
    return query(final, "dense", "eod", "closes", "instruments", "trades", extra=JOURNAL)
