import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import cash, ledger, nav, valuation
from ledgerloom.operators.asof import asof_join
from ledgerloom.plans import history, risk
from ledgerloom.schemas import NAV_SNAPSHOTS, Config

from .conftest import day

CFG = Config(fx_usd_sek=10.0, fx_eur_sek=11.0)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("x")).first()["x"]


def test_fx(spark):
    got = [value(spark, X.fx_factor(F.col("c"), CFG), c=c) for c in ("usd", "EUR", "SEK", "GBP")]
    assert got == [10.0, 11.0, 1.0, 1.0]


def test_cash_positions(make):
    flows = make.flows((1, "2026-01-01", 100_000, "deposit"))
    buy = ledger.normalized(make.trades((1, "2026-01-02", "A", "buy", 400, 100)))
    one = rows(cash.account(cash.movements(buy, flows, CFG)))[0]
    assert X.UNITS * 60_000 == one["cash"] == one["cash_asset"] and one["loan"] == 0
    more = ledger.normalized(make.trades((1, "2026-01-02", "A", "buy", 1200, 100)))
    assert rows(cash.account(cash.movements(more, flows, CFG)))[0]["loan"] == 20_000 * X.UNITS
    assert rows(cash.account(cash.movements(more, flows, CFG), "2026-01-01"))[0]["cash"] == 100_000 * X.UNITS


def test_cash_fallback_uses_fx_and_fees(make):
    t = ledger.normalized(make.trades((1, "2026-01-02", "A", "buy", 10, 1, {"currency": "USD", "fees_sek": 5.0}), (2, "2026-01-03", "A", "sell", 10, 2, {"currency": "USD", "fees_sek": 5.0}), (3, "2026-01-04", "A", "buy", 1, 1, {"amount_sek": -7.0})))
    m = cash.movements(t, make.flows(), CFG)
    assert [r["units"] / X.UNITS for r in rows(m, "date")] == [-105.0, 195.0, -7.0]


def test_net_flow_is_half_open(make):
    f = make.flows((1, "2026-01-01", 10_000, "deposit"), (2, "2026-02-01", 25_000, "deposit"), (3, "2026-03-01", -1_000, "withdrawal"))
    assert rows(cash.net_flow(f, "2026-01-01", "2026-02-01"))[0]["net"] == 25_000 * X.UNITS
    assert rows(cash.net_flow(f, None, "2026-03-01"))[0]["net"] == 34_000 * X.UNITS
    assert rows(cash.net_flow(make.flows(), None, "2026-03-01"))[0]["net"] == 0


def test_glide_path_and_states(spark):
    at = lambda e: value(spark, X.glide_leverage(F.col("e"), CFG), e=float(e))
    assert [at(0), at(2_500_000), at(6_250_000), at(10_000_000)] == [1.3, 1.3, pytest.approx(1.15), 1.0]
    assert [value(spark, X.delever_state(F.col("d"), CFG), d=d) for d in (-0.34, -0.35, -0.45, -0.9)] == ["normal", "half", "full", "full"]
    assert value(spark, X.glide_leverage(F.lit(5e6), Config(glide_low_assets=1.0, glide_high_assets=1.0)), e=0) == 1.3


def test_valuation_and_pnl(spark, make):
    h = make.holdings({"id": 1, "currency": "USD", "quantity": 6.0, "avg_price": 80.0, "last_price": 100.0, "cost_basis_sek": 5000.0, "price_source": "minio", "sleeve_id": 1}, {"id": 2, "currency": "SEK", "quantity": 50.0, "avg_price": 100.0})
    v = {r["id"]: r for r in rows(valuation.value(h, CFG))}
    assert (v[1]["market_value"], v[1]["unrealized_pnl"], v[1]["price_label"]) == (6000 * X.UNITS, 1000 * X.UNITS, "minio")
    assert (v[2]["market_value"], v[2]["unrealized_pnl"], v[2]["price_label"]) == (5000 * X.UNITS, 0, "cost")
    p = rows(valuation.portfolio_pnl(valuation.value(h, CFG)))[0]
    assert (p["priced"], p["at_cost"], p["market_value"], p["return_pct"]) == (1, 1, 11_000 * X.UNITS, pytest.approx(0.1))
    assert rows(valuation.portfolio_pnl(valuation.value(h, CFG), sleeve_only=True))[0]["at_cost"] == 0
    assert rows(valuation.portfolio_pnl(valuation.value(make.holdings(), CFG)))[0]["return_pct"] is None


def test_allocation_drift_and_rebalance(spark, make):
    h = make.holdings({"id": 1, "sleeve_id": 1, "symbol": "B", "quantity": 30.0, "avg_price": 10_000.0}, {"id": 2, "sleeve_id": None, "symbol": "A", "quantity": 70.0, "avg_price": 10_000.0})
    sleeves = spark.createDataFrame([(1, "ONE", "One", "tilt", 0.24, 1), (2, "TWO", "Two", "other", 0.5, 2)], "id bigint, code string, name string, kind string, target_weight double, sort_order bigint")
    a = rows(valuation.allocation(valuation.value(h, CFG), sleeves))
    assert [r["code"] for r in a] == ["ONE", "TWO"]
    assert (a[0]["current_weight"], a[0]["drift"], a[0]["rebalance_delta"]) == (pytest.approx(0.3), pytest.approx(0.06), -60_000 * X.UNITS)
    assert (a[1]["current_value"], a[1]["n_holdings"], a[1]["rebalance_delta"]) == (0, 0, 500_000 * X.UNITS)
    nested = rows(valuation.allocation_report(valuation.value(h, CFG), sleeves))
    assert [(r["code"], len(r["holdings"])) for r in nested] == [("ONE", 1), ("TWO", 0), (None, 1)]
    assert sum(x["weight"] for r in nested for x in r["holdings"]) == pytest.approx(1)


def test_asof_join(make, spark):
    left = spark.createDataFrame([("A", day("2026-01-01"), 1), ("A", day("2026-01-05"), 2), ("B", day("2026-01-05"), 3)], "ticker string, date date, n int")
    right = make.closes(("2026-01-02", "A", 5), ("2026-01-05", "A", 6), ("2026-01-06", "A", 7))
    got = {(r["ticker"], r["n"]): r["close"] for r in rows(asof_join(left, right, by=["ticker"], on="date", values=["close"]))}
    assert got == {("A", 1): None, ("A", 2): 6.0, ("B", 3): None}


def book(make):
    t = ledger.normalized(make.trades((1, "2026-01-01", "A1", "buy", 100, 1000, {"symbol": "AAPL"})))
    h = make.holdings({"id": 1, "isin": "A1", "symbol": "AAPL", "sleeve_id": 1}, {"id": 2, "isin": "U1", "symbol": "UN"})
    return t, make.flows((1, "2026-01-01", 100_000, "deposit")), h


def test_reconstruct_rises_and_falls(make):
    t, f, h = book(make)
    closes = make.closes(("2026-01-01", "AAPL", 1000), ("2026-01-02", "AAPL", 1100), ("2026-01-03", "AAPL", 990))
    s = rows(history.reconstruct(t, f, h, closes, CFG, end="2026-01-03"), "date")
    assert [r["nav_index"] for r in s] == [1.0, pytest.approx(1.1), pytest.approx(0.99)]
    assert s[0]["twr_period"] is None and s[2]["drawdown"] == pytest.approx(0.99 / 1.1 - 1) and s[2]["equity"] == 99_000
    assert not rows(history.reconstruct(t, f, h, make.closes(), CFG, end="2026-01-03"))
    assert not rows(history.reconstruct(ledger.normalized(make.trades()), f, h, closes, CFG, end="2026-01-03"))
    assert not rows(history.reconstruct(t, f, h, closes, CFG, start="2026-02-01", end="2026-01-03"))


def test_days_without_equity_lose_their_flows(make):
    t, _, h = book(make)
    f = make.flows((1, "2026-01-02", 150_000, "deposit"), (2, "2026-01-03", 50_000, "deposit"))
    closes = make.closes(("2026-01-01", "AAPL", 900), ("2026-01-02", "AAPL", 1000), ("2026-01-03", "AAPL", 1000))
    s = rows(history.reconstruct(t, f, h, closes, CFG, end="2026-01-03"), "date")
    assert [str(r["date"]) for r in s] == ["2026-01-02", "2026-01-03"] and s[0]["nav_index"] == 1.0
    assert s[1]["net_contribution"] == 50_000 and s[1]["twr_period"] == pytest.approx(0)


def test_journal(make):
    t = ledger.normalized(make.trades((1, "2026-01-01", "A1", "buy", 100, 1000, {"symbol": "AAPL"}), (2, "2026-01-01", "U1", "buy", 10, 100, {"symbol": "UN"})))
    _, _, h = book(make)
    closes = make.closes(("2026-01-01", "AAPL", 1000), ("2026-01-02", "AAPL", 1100), ("2026-01-02", "UN", 50))
    j = rows(history.journal(t, h, closes, CFG, end="2026-01-03"), "date")
    assert [(r["value"] / X.UNITS, r["day_pnl"] / X.UNITS, r["event"]) for r in j] == [(100_000, 0, "+AAPL"), (110_000, 10_000, None), (110_000, 0, None)]
    everything = rows(history.journal(t, h, closes, CFG, end="2026-01-03", sleeve_only=False), "date")
    assert everything[1]["value"] == 110_500 * X.UNITS and everything[0]["event"] == "+AAPL +UN"
    at_cost = rows(history.journal(t, h, make.closes(), CFG, end="2026-01-02"), "date")
    assert [r["pnl"] for r in at_cost] == [0, 0]
    assert len(rows(history.journal(t, h, closes, CFG, days=2, end="2026-03-01"))) == 2


def test_holdings_on(make):
    t, _, h = book(make)
    closes = make.closes(("2026-01-02", "aapl", 1100))
    (r,) = rows(history.holdings_on(t, h, closes, CFG, "2026-01-02"))
    assert (r["value"], r["priced"], r["symbol"]) == (110_000 * X.UNITS, True, "AAPL")
    (r,) = rows(history.holdings_on(t, h, closes, CFG, "2026-01-01"))
    assert (r["value"], r["priced"], r["price"]) == (100_000 * X.UNITS, False, 1000.0)
    assert not rows(history.holdings_on(t, h, closes, CFG, "2025-01-01"))


def test_chain_strips_contributions_and_tracks_drawdown(spark):
    days = spark.createDataFrame([(day("2026-01-01"), 100.0, 0.0), (day("2026-01-02"), 160.0, 50.0), (day("2026-01-03"), 102.4, 0.0), (day("2026-01-04"), 80.0, 0.0)], "date date, equity double, net_contribution double")
    m = rows(nav.metrics(nav.chain(days.withColumns({"gross_asset_value": F.col("equity"), "loan_balance": F.lit(0.0)})), CFG), "date")
    assert m[1]["twr_period"] == pytest.approx(0.10) and m[2]["drawdown"] == pytest.approx(-0.36)
    assert [r["delever_status"] for r in m] == ["normal", "normal", "half", "full"]


def test_snapshots(spark, make):
    t, f, h = book(make)
    v = valuation.value(ledger.recompute_holdings(h, t), CFG)
    none = spark.createDataFrame([], NAV_SNAPSHOTS)
    first = risk.snapshot_row(v, t, f, none, CFG, "2026-01-01")
    r = first.first()
    assert (float(r["equity"]), float(r["nav_index"]), r["twr_period"], float(r["net_contribution"])) == (100_000, 1, None, 100_000)
    table = risk.add_snapshot(none, first)
    with pytest.raises(ValueError):
        risk.add_snapshot(table, first)
    with pytest.raises(ValueError):
        risk.snapshot_row(v, t, f, none, CFG, "2026-01-01", gross=10, loan=10)
    later = risk.snapshot_row(v, t, f, table, CFG, "2026-02-01", gross=160_000, contribution=50_000)
    assert float(later.first()["twr_period"]) == pytest.approx(0.10)
    both = risk.upsert_snapshot(risk.upsert_snapshot(table, later), later)
    assert both.count() == 2 and risk.latest_snapshot(both, "2026-02-01").first()["as_of"] == day("2026-01-01")
    live = risk.current_risk(v, t, f, both, CFG, "2026-03-01").first()
    assert live["twr_period"] == pytest.approx(100_000 / 160_000 - 1) and live["delever_status"] == "half" and live["nav_index_reliable"]
    empty = risk.current_risk(valuation.value(make.holdings(), CFG), ledger.normalized(make.trades()), make.flows(), none, CFG, "2026-03-01").first()
    assert empty["as_of"] is None and empty["target_leverage"] == 1.3 and empty["action"] == "no NAV snapshots yet"


def test_backfill_twice(make, spark):
    t, f, h = book(make)
    closes = make.closes(("2026-01-01", "AAPL", 1000), ("2026-01-02", "AAPL", 1100))
    series = history.reconstruct(t, f, h, closes, CFG, end="2026-01-02")
    once = risk.backfill(spark.createDataFrame([], NAV_SNAPSHOTS), series)
    assert risk.backfill(once, series).count() == 2 and {r["notes"] for r in rows(once)} == {"reconstructed"}
    assert risk.nav_series(spark.createDataFrame([], NAV_SNAPSHOTS), series).count() == 2


def test_account_drawdown_and_heatmap(spark):
    j = spark.createDataFrame([(day("2026-01-07"), 0, 0), (day("2026-01-08"), 200, 50), (day("2026-01-10"), 100, -100)], "date date, value bigint, day_pnl bigint")
    assert [r["drawdown"] for r in rows(history.account_drawdown(j), "date")] == [0.0, 0.0, -0.5]
    cells = rows(history.heatmap(j), "date")
    assert len(cells) == 6 and (cells[0]["weekday"], str(cells[0]["date"])) == (0, "2026-01-05") and cells[4]["day_pnl"] is None
    assert cells[5]["alpha"] == 1.0 and cells[2]["alpha"] is None
    assert history.max_drawdown(j).first()[0] == -0.5 and history.day_pnl_summary(j).first().asDict() == {"max_abs_day_pnl": 100, "net_pnl": -50}


def test_display(spark):
    assert value(spark, X.format_money(F.col("x")), x=1234567.4) == "1\u00a0234\u00a0567"
    assert value(spark, X.format_money_signed(F.col("x")), x=5.0) == "+5"
    assert value(spark, X.format_percent(F.col("x")), x=0.1234) == "12.3%"
    assert value(spark, X.format_money_short(F.col("x")), x=2_500_000.0) == "2.50M"
    assert value(spark, X.warns(F.col("x"), F.lit(1.3), F.lit(0.2)), x=1.33)
    assert value(spark, X.locale_number(F.col("x")).cast("double"), x="1 234,50") == 1234.5 and value(spark, X.locale_number(F.col("x")), x="n/a") is None


def test_rows_of_the_interface(spark, make):
    import json

    from ledgerloom.functions import serialize

    h = make.holdings({"id": 1, "symbol": "A", "sleeve_id": 1, "acquired_at": day("2026-01-02")})
    sleeves = spark.createDataFrame([(1, "ONE")], "id bigint, code string")
    r = json.loads(serialize.to_json(serialize.holding_rows(h, sleeves)).first()["json"])
    assert (r["sleeve_code"], r["acquired_at"], r["last_price"]) == ("ONE", "2026-01-02", None)
    assert serialize.holding_rows(h).first()["sleeve_code"] is None
    d = spark.sql("SELECT CAST(1.5 AS DECIMAL(20, 4)) AS x, TIMESTAMP '2026-01-02 03:04:05' AS t")
    assert json.loads(serialize.to_json(d).first()["json"]) == {"x": 1.5, "t": "2026-01-02T03:04:05"}
    assert value(spark, X.weight_input(F.col("x")), x=24.0) == 0.24 and value(spark, X.weights_balanced(F.col("x")), x=1.0)
