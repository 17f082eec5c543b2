import datetime as dt
from decimal import Decimal, localcontext

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import ledger, mutate

from .conftest import day


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def fold(trades):
    """Average cost, one trade at a time."""
    q = c = s = Decimal(0)
    for kind, x, p in trades:
        x, p = Decimal(str(x)), Decimal(str(p))
        if kind == "buy":
            q, c, s = q + x, c + x * p, s + x * p
        elif q > 0:
            r = min(x, q)
            c, s, q = c - c / q * r, s - s / q * r, q - r
        else:
            q -= x
    return q, c, s


def test_average_cost(make):
    t = make.trades((1, "2026-01-10", "A1", "buy", 100, 50), (2, "2026-02-10", "A1", "buy", 100, 70), (3, "2026-03-10", "A1", "sell", 50, 90))
    (p,) = rows(ledger.positions(ledger.normalized(t)))
    assert (p["quantity"], p["avg_price"], p["cost_sek"], p["acquired_at"]) == (150.0, 60.0, 9000.0, day("2026-01-10"))
    assert [r["running_qty"] for r in rows(ledger.position_history(ledger.normalized(t), " a1 "), "id")] == [100.0, 200.0, 150.0]


def test_late_trades_are_replayed_in_order_of_date(make):
    t = make.trades((9, "2026-01-01", "A1", "buy", 10, 5), (1, "2026-02-01", "A1", "sell", 4, 9), (5, "2025-12-01", "A1", "buy", 10, 7))
    (p,) = rows(ledger.positions(ledger.normalized(t)))
    assert p["quantity"] == 16 and p["avg_price"] == 6 and p["acquired_at"] == day("2025-12-01")


def test_oversell_is_clamped_and_sells_from_nothing_go_negative(make):
    t = make.trades((1, "2026-01-01", "A1", "buy", 10, 5), (2, "2026-01-02", "A1", "sell", 15, 5), (3, "2026-01-03", "A1", "sell", 3, 5), (4, "2026-01-04", "A1", "buy", 5, 8))
    s = rows(ledger.states(ledger.normalized(t)), "id")
    assert [x["quantity"] for x in s] == [10, 0, -3, 2] and s[-1]["cost_ccy"] == 40
    assert [r["running_qty"] for r in rows(ledger.position_history(ledger.normalized(t)), "id")] == [10, -5, -8, -3]


def test_blank_isin_name_and_currency(make):
    t = make.trades((1, "2026-01-01", " ", "buy", 1, 1), (2, "2026-01-02", "b2 ", "BUY", 1, 10, {"currency": "usd"}), (3, "2026-01-03", "B2", "buy", 1, 10, {"name": "Bee", "currency": None}))
    (p,) = rows(ledger.positions(ledger.normalized(t)))
    assert (p["isin"], p["name"], p["currency"], p["quantity"]) == ("B2", "Bee", "SEK", 2)


def test_empty_ledger(make):
    t = ledger.normalized(make.trades())
    assert not rows(ledger.positions(t)) and not rows(ledger.states(t)) and not rows(ledger.position_history(t))


trade = st.tuples(st.sampled_from(["buy", "sell"]), st.integers(1, 50).map(float), st.integers(1, 9).map(float))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(trade, min_size=1, max_size=30), min_size=1, max_size=4))
def test_fold_equals_one_trade_at_a_time(make, books):
    t = make.trades(*[(k, "2026-01-01", f"I{b}", *x) for b, book in enumerate(books) for k, x in enumerate(book)])
    got = {r["isin"]: r for r in rows(ledger._fold(ledger.normalized(t), "last", ledger.LONG))}
    for b, book in enumerate(books):
        with localcontext(prec=38):
            want = [x.quantize(Decimal("1e-16")) for x in fold28(book)]
        assert [got[f"I{b}"]["quantity"], got[f"I{b}"]["cost_ccy"], got[f"I{b}"]["cost_sek"]] == want


def fold28(book):
    with localcontext(prec=28):
        return fold(book)


def test_a_long_ledger_keeps_every_digit(spark):
    """100,000 trades of a tenth and a third of odd prices against decimals one at a time; doubles would drift."""
    import random

    r = random.Random(3)
    book = [("buy" if r.random() < 0.6 else "sell", f"{r.randint(1, 999)}.{r.randint(0, 99999999):08d}", f"{r.randint(0, 9)}.{r.randint(1, 99999999):08d}") for _ in range(100_000)]
    df = spark.createDataFrame([(k, "D1", kind, x, p) for k, (kind, x, p) in enumerate(book)], "id bigint, isin string, kind string, quantity string, price string")
    t = ledger.normalized(df.selectExpr("id", "date '2026-01-01' as date", "isin", "kind", "cast(quantity as decimal(24,8)) as quantity", "cast(price as decimal(20,8)) as price"))
    (p,) = rows(ledger._fold(t, "last", ledger.LONG))
    q, c, s = fold28(book)
    assert p["quantity"] == q and abs(p["cost_ccy"] - c) < Decimal("1e-15") and abs(p["cost_sek"] - s) < Decimal("1e-15")


def test_recompute_keeps_metadata_and_zeroes_closed(make):
    t = ledger.normalized(make.trades((1, "2026-01-01", "A1", "buy", 2, 5, {"name": "Aye"}), (2, "2026-01-01", "N1", "buy", 1, 3)))
    h = make.holdings({"id": 1, "isin": "a1", "symbol": "AAA", "sleeve_id": 4, "last_price": 9.0}, {"id": 2, "isin": "GONE", "symbol": "G", "quantity": 5.0, "avg_price": 7.0, "cost_basis_sek": 35.0}, {"id": 3, "isin": None, "symbol": "CASH", "quantity": 8.0})
    got = {r["symbol"]: r for r in rows(ledger.recompute_holdings(h, t))}
    assert got["AAA"]["quantity"] == 2 and got["AAA"]["sleeve_id"] == 4 and got["AAA"]["last_price"] == 9 and got["AAA"]["name"] == "Aye"
    assert got["G"]["quantity"] == 0 and got["G"]["cost_basis_sek"] == 0 and got["G"]["avg_price"] == 7
    assert got["CASH"]["quantity"] == 8 and got[""]["isin"] == "N1" and got[""]["id"] is None
    only = {r["symbol"]: r for r in rows(ledger.recompute_holdings(h, t, ["a1"]))}
    assert only["G"]["quantity"] == 5 and "" not in only


def test_replace_range_is_idempotent_and_spares_manual_rows(make):
    t = make.trades((1, "2026-01-01", "A1", "buy", 1, 1, {"source": "avanza"}), (2, "2026-01-05", "A1", "buy", 1, 1), (3, "2026-03-01", "A1", "buy", 1, 1, {"source": "avanza"}))
    new = make.trades((7, "2026-01-02", "A1", "buy", 4, 1))
    once = mutate.replace_range(t, new, "2026-01-01", "2026-01-31")
    twice = mutate.replace_range(once, new, "2026-01-01", "2026-01-31")
    assert sorted(r["id"] for r in rows(once)) == [2, 3, 7] == sorted(r["id"] for r in rows(twice))


def test_trade_and_flow_rows_are_checked(spark):
    import pytest

    r = mutate.trade_row(spark, 1, date="2026-01-01", isin=" x1", kind="Buy", quantity=-3, price="2.5").first()
    assert (r["isin"], r["quantity"], r["kind"], r["currency"], r["source"]) == ("X1", Decimal("3.00000000"), "buy", "SEK", "manual")
    for bad in ({"isin": "", "quantity": 1}, {"isin": "A", "quantity": 0}, {"isin": "A", "quantity": 1, "kind": "swap"}):
        with pytest.raises(ValueError):
            mutate.trade_row(spark, 1, **{"date": "2026-01-01", "kind": "buy", "price": 1} | bad)
    assert mutate.flow_row(spark, 1, date="2026-01-01", kind="withdrawal", amount_sek=5).first()["amount_sek"] == Decimal("-5.0000")
    with pytest.raises(ValueError):
        mutate.flow_row(spark, 1, date="2026-01-01", kind="deposit", amount_sek=0)


def _long_history(spark, n, seed, isins=1):
    import numpy as np

    r = np.random.default_rng(seed)
    kind, x, p = r.random(n) < 0.5, r.integers(1, 60, n), r.integers(100, 900, n)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(int(k // 9)) if k % 997 else None, f"I{k % isins}", "n" if k == 40 else None, "SEK" if k % 3 else "EUR", "buy" if kind[k] else "sell", float(x[k]) / 4, float(p[k]) / 7, None if k % 5 else float(x[k]), 0.0) for k in range(n)]
    return ledger.normalized(spark.createDataFrame(rows, "id bigint, date date, isin string, name string, currency string, kind string, quantity double, price double, amount_sek double, fees_sek double"))


@pytest.mark.parametrize(("n", "isins", "long"), [(6000, 3, 400), (300, 2, 8), (120_000, 1, 40_000)])
def test_a_long_history_in_pieces_equals_one_pass(spark, n, isins, long):
    """With short positions, clamped sells, missing dates and days that span pieces."""
    from ledgerloom.stored import written

    t = written(_long_history(spark, n, n, isins), "long")
    for f in (ledger.states, ledger.end_of_day, ledger.positions):
        a, b = ({tuple(str(r[c]) for c in r.__fields__ if c in ("isin", "id", "date")): r for r in f(t, long=k).collect()} for k in (long, 10**9))
        assert a.keys() == b.keys() and len(a) >= (isins if f is not ledger.positions else 0)
        for k in a:
            for c in a[k].__fields__:
                x, y = a[k][c], b[k][c]
                assert x == y or abs(x - y) <= 1e-9 * max(1, abs(y)), (f.__name__, k, c, x, y)


def test_pieces_spread_over_tasks(spark):
    from ledgerloom.operators import segments

    t = _long_history(spark, 5000, 1)
    out = segments.fold_in_pieces(t.select("isin", *segments.TRADE), "each", 300)
    assert out.count() == 5000
    m = segments.QuantityMap()
    for x in (5, -9, 3, -20, 7):
        (m.buy if x > 0 else m.sell)(abs(x))
    for q in range(-40, 40):
        want = q
        for x in (5, -9, 3, -20, 7):
            want = want + x if x > 0 else max(want + x, 0) if want > 0 else want + x
        assert segments.QuantityMap.load(m.dump())(q) == want == m(q)


def test_columns_as_python_objects():
    """The same objects as one scalar at a time, nulls and days at either end of the calendar too; no rows, only nulls."""
    some = [("a", None, ""), (dt.date(1, 1, 1), None, dt.date(9999, 12, 31)), (2**62 + 1, None, -1), (Decimal("0.00000001"), None, Decimal("-12345678901234567890.5"))]
    kinds = [pa.string(), pa.date32(), pa.int64(), pa.decimal128(28, 8)]
    full = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds, strict=True)], names=list("abcd"))
    for b in (full, full.slice(0, 0), full.slice(1, 1), full.slice(2, 1)):
        got, want = ledger.as_lists(b), [c.to_pylist() for c in b.columns]
        assert got == want and [list(map(type, c)) for c in got] == [list(map(type, c)) for c in want]
