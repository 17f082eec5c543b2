"""Ledgers of doubles: the fold adds them up one trade after another, as the queries' SQL does; few tasks for many pieces."""

import datetime as dt
import os

import duckdb
import numpy as np
import pytest

from ledgerloom.operators import asof, ledger, nav, segments
from ledgerloom.plans import history, queries
from ledgerloom.schemas import Config

BIG = "/root/testdata/sf0.1"


def book(spark, n, isins, seed=5):
    r = np.random.default_rng(seed)
    kind, x, p = r.random(n) < 0.55, r.integers(1, 60, n), r.integers(100, 90_000, n)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(int(k // 9)) if k % 997 else None, f"I{k % isins}", "n" if k == 40 else None, "SEK" if k % 3 else "EUR", "buy" if kind[k] else "sell", float(x[k]) / 3, float(p[k]) / 7, None if k % 5 else float(x[k]) * 9.34, 0.0) for k in range(n)]
    return rows, ledger.normalized(spark.createDataFrame(rows, "id bigint, date date, isin string, name string, currency string, kind string, quantity double, price double, amount_sek double, fees_sek double"), exact=False)


def folded(rows):
    out, state = {}, {}
    for i, _, isin, _, _, kind, x, p, amount, _ in sorted(rows, key=lambda r: (r[1] or dt.date.min, r[0])):
        q, c, s = state.get(isin, (0.0, 0.0, 0.0))
        if kind == "buy":
            q, c, s = q + x, c + x * p, s + (x * p if amount is None else abs(amount))
        elif q > 0:
            r = min(x, q)
            q, c, s = q - r, c - c / q * r, s - s / q * r
        else:
            q -= x
        out[i] = state[isin] = (q, c, s)
    return out


@pytest.mark.parametrize("long", [ledger.LONG, 700, 8])
def test_doubles_are_added_up_one_trade_after_another(spark, monkeypatch, long):
    """Bit for bit, in pieces too, whose packed rows hold less than a piece, and with instruments joined as they are too many for a list."""
    monkeypatch.setattr(segments, "PACK", 50)
    monkeypatch.setattr(ledger, "FEW", 2 if long == 8 else 1000)
    rows, t = book(spark, 5000, 4)
    want = folded(rows)
    got = ledger.states(t, long=long).collect()
    assert {r["id"]: (r["quantity"], r["cost_ccy"], r["cost_sek"]) for r in got} == want
    for f in (ledger.states, ledger.end_of_day, ledger.positions):
        assert sorted(map(str, f(t, long=long).collect())) == sorted(map(str, f(t, long=10**9).collect()))


def test_many_pieces_in_few_tasks(spark, monkeypatch):
    """ledger_states_in_pieces had a task for every 50 trades: 72,000 of them for 3.6 million."""
    tasks = {}
    real = segments.written
    monkeypatch.setattr(segments, "written", lambda df, name: (tasks.setdefault(name, df.rdd.getNumPartitions()), real(df, name))[1])
    _, t = book(spark, 5000, 4)
    for rows in (t, t.withColumns({c: t[c].cast("decimal(24,8)") for c in ("quantity", "price", "amount_sek")})):
        assert segments.fold_in_pieces(rows.select("isin", *segments.TRADE), "each", 10).count() == 5000
        assert tasks.pop("fold-pieces") == 1
    _, t = book(spark, 300, 1)
    monkeypatch.setattr(segments, "TASK_ROWS", 100)
    assert segments.fold_in_pieces(t.select("isin", *segments.TRADE), "each", 10).count() == 300 and tasks["fold-pieces"] == 3


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
@pytest.mark.parametrize("name", ["ledger_states", "ledger_states_in_pieces", "sql_ledger_states"])
def test_states_of_long_histories_equal_the_sql(spark, tmp_path, name):
    """Two of the instruments whose costs in decimals fell on the other side of a half than the SQL's."""
    con = duckdb.connect()
    for t, which in (("supplier", "WHERE s_suppkey IN (381, 490)"), ("nation", ""), ("lineitem", "WHERE l_suppkey IN (381, 490)")):
        con.execute(f"COPY (SELECT * FROM '{BIG}/{t}.parquet' {which}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["backfill_snapshots", "latest_snapshot", "nav_series", "nav_series_rebuilt"])
def test_equity_beyond_what_doubles_count_in_units(spark, monkeypatch, name):
    """Snapshots keep decimals; whole units come from their doubles, as in the SQL."""
    equity = {dt.date(1999, 6, 1) + dt.timedelta(k): (2**53 + 4_000_000_000_001 * k) / 10_000.0 for k in range(14)}
    days = spark.createDataFrame([(d, e, 0.0, e, 0.0, 0.0) for d, e in equity.items()], "date date, equity double, net_contribution double, gross_asset_value double, cost_basis double, loan_balance double")
    monkeypatch.setattr(queries, "_series", lambda spark, d: nav.metrics(nav.chain(days), Config()))
    want = {d: int(np.floor(e * 10_000.0 + 0.5)) for d, e in equity.items()}
    got = {r["as_of"]: r["equity"] for r in queries.queries()[name](spark, "").collect()}
    assert got and all(want[d] == e for d, e in got.items())


def test_a_day_with_a_price_and_a_trade_is_not_brought_into_one_row(spark, make):
    """Daily values shuffle positions and prices once; they were aggregated by instrument and day first."""
    t = ledger.normalized(make.trades((1, "2026-01-02", "A", "buy", 10, 5, {"symbol": "AA"}), (2, "2026-01-03", "A", "sell", 4, 7, {"symbol": "AA"})), exact=False)
    changes = history._value_changes(t, make.holdings({"id": 1, "isin": "A", "symbol": "AA"}), make.closes(("2026-01-03", "AA", 6), ("2026-01-04", "AA", 8)), Config(), None)
    assert "first(s" not in changes._jdf.queryExecution().optimizedPlan().toString()
    days = asof.totals_by_day(changes, by="isin", on="date", then=["turn"], amounts=["value", "cost"]).orderBy("date").collect()
    assert [(str(r["date"]), r["value"], r["cost"]) for r in days] == [("2026-01-02", 500_000, 500_000), ("2026-01-03", 360_000, 300_000), ("2026-01-04", 480_000, 300_000)]


def test_trades_are_numbered_before_texts_are_joined(spark):
    from ledgerloom.sources import fixtures

    plan = fixtures.trades(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the window is below the join


def test_an_export_is_read_as_text_once(spark, monkeypatch, tmp_path):
    """The rows that an import parses are a stored table, not the text that each step would read again."""
    from ledgerloom import api
    from ledgerloom.store import Store

    (tmp_path / "export.csv").write_text("Datum;Typ av transaktion;Antal;Kurs;ISIN\n2026-01-10;Köp;1;50,00;A1\n")
    seen = []
    monkeypatch.setattr(api.Portfolio, "take", lambda self, parsed: seen.append(parsed) or {})
    api.Portfolio(Store(spark, str(tmp_path / "store"))).import_csv(str(tmp_path / "export.csv"))
    plan = seen[0].trades._jdf.queryExecution().executedPlan().toString().lower()
    assert "parquet" in plan and "csv" not in plan.replace("export.csv", "") and seen[0].trades.count() == 1


#: Trades in EUR whose costs are exact halves of a unit: kind, quantity, price, whether an amount is booked. Decimals put each on the other side than doubles.
HALVES = {
    10: [("buy", 39, 1164, True), ("buy", 41, 903, True), ("sell", 14, 2083, True), ("buy", 2, 3192, True)],
    20: [("buy", 45, 1512, True), ("buy", 11, 4450, True), ("buy", 24, 873, True), ("sell", 19, 4387, False)],
    30: [("buy", 23, 2116, True), ("buy", 15, 2533, True), ("buy", 42, 2414, False), ("sell", 2, 395, False)],
}


@pytest.fixture
def halves(tmp_path):
    """Tables of instruments without closes, which are valued at cost, and a connection with their views."""
    con = duckdb.connect()
    lines = [(k * 100 + n, k, n, float(x), (p + 0.5) * x * 10.87, "R" if kind == "sell" else "N", "F" if booked else "O", dt.datetime(2001, 3, 1 + 3 * n)) for k, trades in HALVES.items() for n, (kind, x, p, booked) in enumerate(trades)]
    con.execute("CREATE TABLE given (o BIGINT, k BIGINT, n INTEGER, x DOUBLE, p DOUBLE, r VARCHAR, s VARCHAR, d TIMESTAMP)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?, ?, ?)", lines)
    made = {
        "region": "SELECT i AS r_regionkey, 'R' || i AS r_name FROM range(5) t(i)",
        "nation": "SELECT i AS n_nationkey, 'N' || i AS n_name, i % 5 AS n_regionkey FROM range(25) t(i)",
        "supplier": "SELECT DISTINCT k AS s_suppkey, 'S' || k AS s_name, (k // 10 * 4 - 2)::INTEGER AS s_nationkey FROM given",
        "orders": "SELECT o AS o_orderkey, d AS o_orderdate, 'O' AS o_orderstatus, 10.0::DOUBLE AS o_totalprice, '5-LOW' AS o_orderpriority FROM given",
        "lineitem": "SELECT o AS l_orderkey, 1::BIGINT AS l_partkey, k AS l_suppkey, n AS l_linenumber, x AS l_quantity, p AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, r AS l_returnflag, s AS l_linestatus, d AS l_shipdate FROM given",
    }
    for t, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["daily_journal", "day_pnl_summary", "heatmap_weeks", "holding_valuation", "allocation_cube", "allocation_holdings", "holding_rows", "allocation_nested"])
def test_amounts_at_exact_halves_equal_the_sql(spark, halves, name):
    from tests.test_queries import canonical

    con, folder = halves
    got, want = queries.queries()[name](spark, folder).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert canonical(got) == canonical(want)


#: Trades in EUR: what decimals make of the average price falls on the other side of a half of its sixth place than doubles.
PRICED = {
    10: [("buy", 42, 1539, True), ("buy", 42, 1727, True), ("buy", 16, 1647, True), ("sell", 17, 1487, True), ("buy", 45, 1512, True)],
    20: [("buy", 38, 1882, True), ("buy", 37, 1786, True), ("buy", 5, 1896, True), ("sell", 7, 1452, True), ("buy", 7, 1588, True)],
    30: [("buy", 37, 2002, True), ("buy", 43, 1163, True), ("sell", 31, 1244, True), ("buy", 7, 1733, True), ("sell", 12, 1620, True)],
}


def test_a_preview_of_doubles_equals_the_sql(spark, monkeypatch, tmp_path, request):
    from tests.test_queries import canonical

    monkeypatch.setitem(globals(), "HALVES", PRICED)
    con, folder = request.getfixturevalue("halves")
    con.execute(f"COPY (SELECT * REPLACE (1 AS l_linenumber, l_linenumber AS l_partkey) FROM '{folder}/lineitem.parquet') TO '{tmp_path}/odd.parquet' (FORMAT parquet)")  # imported trades have odd numbers
    os.replace(f"{tmp_path}/odd.parquet", f"{folder}/lineitem.parquet")
    got, want = queries.queries()["preview_import"](spark, folder).toPandas(), con.execute(queries.oracle_sql()["preview_import"]).df()
    assert len(want) == 3 and canonical(got) == canonical(want)


def test_an_export_keeps_the_doubles_of_amounts(spark, monkeypatch):
    """A product of doubles is not the number with four decimals that it shows as."""
    from ledgerloom.sources import broker_csv, fixtures

    amounts = [-(39.0 * 1164.0 * 10.87), 0.1 + 0.2, 12345678901.25, None, 7.0]
    t = spark.createDataFrame([(k, dt.date(2026, 1, 1 + k), "A1", "n", "EUR", "buy", 1.0, 2.0, a, 0.0, "avanza") for k, a in enumerate(amounts)], "id long, date date, isin string, name string, currency string, kind string, quantity double, price double, amount_sek double, fees_sek double, source string")
    monkeypatch.setattr(fixtures, "trades", lambda spark, d: t)
    monkeypatch.setattr(fixtures, "flows", lambda spark, d: spark.createDataFrame([], "date date, amount_sek double, kind string, source string"))
    read = broker_csv.parse(fixtures.csv_rows(spark, ""), exact=False).trades.orderBy("date").collect()
    assert [r["amount_sek"] for r in read] == amounts
    odd = spark.createDataFrame([("2026-01-01", "Köp", x, "2", "A1") for x in ("1,5", "1 0", "NaN", "Infinity", "2d", "x", "")], "Datum string, `Typ av transaktion` string, Antal string, Kurs string, ISIN string")
    both = [[float(r["quantity"]) for r in broker_csv.parse(odd, exact=e).trades.collect()] for e in (True, False)]
    assert both == [[1.5, 10.0]] * 2


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_a_stream_of_doubles_ends_where_the_sql_does(spark, tmp_path):
    """An instrument whose cost in decimals falls on the other side of the point of rounding."""
    con = duckdb.connect()
    for t, which in (("supplier", "WHERE s_suppkey IN (381, 490)"), ("nation", ""), ("lineitem", "WHERE l_suppkey IN (381, 490)")):
        con.execute(f"COPY (SELECT * FROM '{BIG}/{t}.parquet' {which}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.queries()["stream_positions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.oracle_sql()["stream_positions"]).fetchall())


def test_an_import_parses_ranges_and_folds_once(spark, monkeypatch, tmp_path):
    """Each table's new rows were put in ranges twice, texts were parsed for each of some seven reads, and holdings were derived twice."""
    from ledgerloom import api
    from ledgerloom.store import Store

    lines = [f"2026-0{1 + k % 6}-{1 + k % 27:02d};{('Köp', 'Sälj', 'Insättning')[k % 3]};{k % 7 + 1};5{k % 10},50;{k}00,00;A{k % 4}" for k in range(60)]
    (tmp_path / "export.csv").write_text("\n".join(["Datum;Typ av transaktion;Antal;Kurs;Belopp;ISIN", *lines]))
    frame = type(spark.range(1))
    ranged, plans, real, put = [], {}, frame.repartitionByRange, Store._written
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: (ranged.append(a), real(self, *a))[1])
    monkeypatch.setattr(Store, "_written", lambda self, name, rows, *a, **k: (plans.setdefault(name, rows._jdf.queryExecution().optimizedPlan().toString()), put(self, name, rows, *a, **k))[1])
    port = api.Portfolio(Store(spark, str(tmp_path / "store")))
    assert (port.import_csv(str(tmp_path / "export.csv"))["n_trades"], len(ranged)) == (40, 2)
    assert plans["holdings"].count("MapInArrow") == 1 and "translate" not in plans["transactions"] and "regexp" not in plans["transactions"]
    for name in ("transactions", "cash_flows"):  # files hold ranges of dates one after the other, with ids of their own
        files = port.store.files(name)
        assert all(a["hi"] < b["lo"] and a["last"] < b["first"] for a, b in zip(files, files[1:], strict=False))
    assert port.transactions().select("id").distinct().count() == 40
    new = port.holdings().collect()
    assert len({r["id"] for r in new}) == len(new) and {(r["asset_class"], r["price_source"]) for r in new} == {("equity", "none")}
    port.upsert_holding(id=new[0]["id"], asset_class="etf", last_price=7)
    port.recompute()
    again = {r["id"]: r for r in port.holdings().collect()}
    assert set(again) == {r["id"] for r in new} and (again[new[0]["id"]]["asset_class"], again[new[0]["id"]]["price_source"]) == ("etf", "manual")


def test_decimals_fold_as_the_fold_of_one_trade_does(spark):
    _, t = book(spark, 3000, 4)
    t = ledger.normalized(t)
    want, folds = {}, {}
    for r in sorted(t.collect(), key=lambda r: (r["date"] or dt.date.min, r["id"])):
        f = folds.setdefault(r["isin"], ledger.Fold())
        f.take(r["date"], r["id"], r["kind"], r["quantity"], r["price"], r["amount_sek"], r["name"], r["currency"])
        want[r["id"]] = ledger._batch([(r["isin"], *f.state())]).to_pylist()[0]
    assert {r["id"]: r.asDict() for r in ledger.states(t).collect()} == want
