import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.api import Portfolio
from ledgerloom.operators import ledger, mutate
from ledgerloom.schemas import SLEEVES, TABLES, Config
from ledgerloom.sources import broker_csv, price_lake, rates
from ledgerloom.store import ConcurrentChange, Store
from ledgerloom.streaming import ingest

HEAD = "Datum;Konto;Typ av transaktion;Värdepapper/beskrivning;Antal;Kurs;Belopp;Transaktionsvaluta;Courtage;Valutakurs;Instrumentvaluta;ISIN;Resultat\n"
BODY = """2026-03-01;1;Sälj;Alfa;-10;12,5;125,00;SEK;1,00;;SEK;SE0001;
2026-01-02;1;Köp;Alfa;30;10,00;-300,00;SEK;1,00;;SEK;se0001;
2026-01-03;1;Köp;Beta;5;1 000,00;-50 000,00;SEK;0;10,0;USD;US0002;
2026-01-04;1;Köp;Alfa;10;14;-140;SEK;0;;;SE0001;
2026-02-01;1;Sälj;Beta;1;1100;11000;SEK;0;10;USD;US0002;
2026-01-01;1;Insättning;Start;;;10 000,00;SEK;;;;;
2026-01-15;1;Insättning;;;;5000;SEK;;;;;
2026-01-16;1;Utdelning;Alfa;1;1;1;SEK;;;;SE0001;
2026-01-17;1;Köp;Sans;1;1;1;SEK;;;;;
2026-01-18;1;Uttag;;;;-2 000,00;SEK;;;;;
"""


def export(tmp_path, text=HEAD + BODY, name="x.csv"):
    p = tmp_path / name
    p.write_bytes(b"\xef\xbb\xbf" + text.encode())
    return str(p)


def test_parse(spark, tmp_path):
    p = broker_csv.parse(broker_csv.read(spark, export(tmp_path)))
    s = p.summary.first()
    assert (s["rows"], s["n_trades"], s["n_flows"], float(s["deposits_total"]), float(s["flow_net"])) == (10, 5, 3, 15_000, 13_000)
    assert (s["date_min"], s["date_max"]) == ("2026-01-01", "2026-03-01")
    t = {(r["isin"], str(r["date"])): r for r in p.trades.collect()}
    assert float(t["SE0001", "2026-03-01"]["quantity"]) == 10 and t["SE0001", "2026-03-01"]["kind"] == "sell"
    assert float(t["US0002", "2026-01-03"]["amount_sek"]) == -50_000 and t["SE0001", "2026-01-04"]["currency"] == "SEK"


def test_headers_of_any_case_and_english_types(spark):
    raw = spark.createDataFrame([("2026-01-01", "BUY ", "2", "3", "x1")], "` datum ` string, `TYP AV TRANSAKTION` string, antal string, KURS string, isin string")
    (r,) = broker_csv.parse(raw).trades.collect()
    assert (r["isin"], float(r["quantity"]), r["amount_sek"], float(r["fees_sek"])) == ("X1", 2, None, 0)


def test_import_twice_keeps_manual_rows(spark, tmp_path):
    port = Portfolio(Store(spark, str(tmp_path / "store")))
    port.add_cash_flow(date="2026-01-10", kind="deposit", amount_sek=1)
    path = export(tmp_path)
    for _ in range(2):
        got = port.import_csv(path)
    assert got["n_trades"] == 5 and port.transactions().count() == 5 and port.cash_flows().count() == 4 and got["open_holdings"] == 2
    alfa = port.holding_by_isin("se0001 ")
    assert float(alfa["quantity"]) == 30 and float(alfa["avg_price"]) == 11
    preview = port.preview_import(path)
    assert preview["positions"].count() == 2


def test_service(spark, tmp_path):
    closes = spark.createDataFrame([(dt.date(2026, 1, d), "AAA", 1000.0 + 100 * d) for d in (1, 2, 3)], "date date, ticker string, close double")
    port = Portfolio(Store(spark, str(tmp_path / "store")), closes=closes)
    assert port.seed_sleeves() == 5 and port.seed_sleeves() == 0 and port.sleeves().count() == 5
    port.add_cash_flow(date="2026-01-01", kind="deposit", amount_sek=500_000)
    port.add_transaction(date="2026-01-01", isin="x1", kind="buy", quantity=100, price=1100, symbol="AAA")
    h = port.holding_by_isin("X1")
    port.upsert_holding(id=h["id"], symbol="aaa", sleeve_code="RAW")
    assert port.holding_by_isin("X1")["sleeve_id"] == 3 and float(port.holding_by_isin("X1")["quantity"]) == 100
    assert port.refresh_prices(today="2026-01-03")["updated_minio"] == 1
    assert port.nav(end="2026-01-03").count() == 3 and port.backfill(end="2026-01-03") == 3 and port.backfill(end="2026-01-03") == 3
    assert port.journal(end="2026-01-03").count() == 3 and port.holdings_on("2026-01-02").count() == 1
    port.daily_job(fetch=lambda url: b"", today="2026-01-04")
    assert port.snapshots().count() == 4 and port.current_risk("2026-01-05").first()["equity"] == 520_000
    assert port.delete_transaction(port.transactions().first()["id"]) and not port.delete_transaction(999)
    assert float(port.holding_by_isin("X1")["quantity"]) == 0 and port.status()["ok"]
    assert port.update_config(leverage_target=1.2, unknown=3, fx_usd_sek=None).leverage_target == 1.2 == port.config().leverage_target
    assert port.delete_holding(h["id"]) and port.holdings().count() == 0


def test_unknown_sleeve_and_domains(spark, tmp_path):
    import pytest

    port = Portfolio(Store(spark, str(tmp_path / "store")))
    for bad in ({"sleeve_code": "NOPE"}, {"asset_class": "boat"}, {"price_source": "rumour"}):
        with pytest.raises(ValueError):
            port.upsert_holding(symbol="A", **bad)
    port.upsert_holding(symbol="a", last_price=5)
    assert port.holdings().first()["price_source"] == "manual"


def test_upsert_keeps_what_is_not_given(spark):
    t = mutate.upsert_sleeve(spark.createDataFrame([], SLEEVES), code="A", name="Aye", target_weight=0.2)
    t = mutate.upsert_sleeve(t, code="A", notes="n")
    r = t.first()
    assert (r["name"], float(r["target_weight"]), r["notes"], r["kind"], r["id"]) == ("Aye", 0.2, "n", "other", 1)


def test_price_lake(spark, tmp_path):
    closes = spark.createDataFrame([(dt.date(2026, 1, 1), "aaa", 1.0), (dt.date(2026, 1, 2), "AAA", 2.0), (dt.date(2026, 1, 2), "BBB", 3.0)], "date date, ticker string, close double")
    price_lake.write(closes, str(tmp_path))
    lake = price_lake.lake(spark, str(tmp_path))
    assert [(r["ticker"], r["close"]) for r in price_lake.latest_closes(lake, spark.createDataFrame([("aaa",)], "ticker string")).collect()] == [("AAA", 2.0)]
    wanted = spark.createDataFrame([("aaa",)], "ticker string")
    assert price_lake.closes_in_range(lake, wanted, "2026-01-01", "2026-01-02").count() == 2


def test_the_newest_day_is_read_from_its_folder_alone(spark, tmp_path):
    closes = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(k), "AAA", float(k)) for k in range(60)], "date date, ticker string, close double")
    price_lake.write(closes, str(tmp_path))
    closes.limit(1).select("ticker", "close").write.parquet(f"{tmp_path}/bars/tf=1day/date=latest")
    (tmp_path / "bars/tf=1day/date=2027-01-01").mkdir()  # a folder without files
    newest = price_lake.newest(spark, str(tmp_path))
    assert [str(x) for x in price_lake.days(spark, str(tmp_path))][-2:] == ["2026-03-01", "2027-01-01"]
    assert len(newest.inputFiles()) == 1 and "date=2026-03-01" in newest.inputFiles()[0]
    plan = price_lake.latest_closes(newest, closes.select("ticker"))._jdf.queryExecution().toString()
    scans = [x for x in plan.split("== Physical Plan ==")[1].split("FileScan parquet")[1:]]
    assert scans and all("(1 paths)" in x and "2026-03-01" in x[x.index("PartitionFilters: ") :].split("PushedFilters")[0] for x in scans)
    some = price_lake.lake(spark, str(tmp_path), since="2026-01-30", until="2026-02-02")
    assert some.count() == 4 == len(some.inputFiles())
    assert price_lake.lake(spark, str(tmp_path), since="2030-01-01").count() == 0 and price_lake.newest(spark, str(tmp_path / "none")).count() == 0
    port = Portfolio(Store(spark, str(tmp_path / "s")), lake_root=str(tmp_path))
    port.upsert_holding(symbol="aaa")
    assert port.refresh_prices(today="2026-03-02")["updated_minio"] == 1 and float(port.holdings().first()["last_price"]) == 59


def test_refresh_prices(spark, make):
    h = make.holdings({"id": 1, "symbol": "AAA"}, {"id": 2, "symbol": "EUF", "isin": "IE1", "currency": "SEK"}, {"id": 3, "symbol": "NO"}, {"id": 4})
    closes = spark.createDataFrame([("aaa", 7.0, dt.date(2026, 1, 1))], "ticker string, close double, date date")
    quotes = spark.createDataFrame([("IE1", 9.0, "eur"), ("NO", 0.0, "SEK")], "key string, price double, currency string")
    out = rates.refresh_prices(h, closes, quotes, "2026-01-02")
    got = {r["id"]: (r["last_price"], r["currency"], r["outcome"]) for r in out.collect()}
    assert got == {1: (7.0, "SEK", "minio"), 2: (9.0, "EUR", "yfinance"), 3: (None, "SEK", "skipped"), 4: (None, "SEK", None)}
    assert rates.refresh_counts(out).first()["skipped"] == ["NO"]


def test_rates():
    answer = {s: {"value": v, "date": "2026-01-02"} for s, v in zip(rates.SERIES.values(), (9.5, 11.5), strict=True)}
    cfg, report = rates.refresh_fx(Config(), lambda url: json.dumps(next(x for s, x in answer.items() if s in url)).encode())
    assert report["ok"] and (cfg.fx_usd_sek, cfg.fx_eur_sek, str(cfg.fx_as_of), cfg.fx_source) == (9.5, 11.5, "2026-01-02", "riksbank")
    xml = b'<e xmlns="u"><Cube><Cube time="2026-01-03"><Cube currency="USD" rate="1.1"/><Cube currency="SEK" rate="11"/></Cube></Cube></e>'
    cfg, report = rates.refresh_fx(Config(), lambda url: xml)
    assert report["source"] == "ecb" and round(cfg.fx_usd_sek, 9) == 10 and cfg.fx_eur_sek == 11

    def fail(url):
        raise OSError

    cfg, report = rates.refresh_fx(Config(), fail)
    assert not report["ok"] and cfg == Config()


def test_stream_of_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "in" / "a.csv").write_text(HEAD + BODY)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.into_store(ingest.export_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert store.read("transactions").count() == 5 and store.read("cash_flows").count() == 3
    assert ledger.positions(ledger.normalized(store.read("transactions"))).count() == 2


def test_windowed_cash(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 5), 10), (dt.datetime(2026, 1, 1, 9), 5), (dt.datetime(2026, 1, 2), 1)]
    spark.createDataFrame(rows, "ts timestamp, units bigint").write.parquet(str(tmp_path / "m"))
    s = spark.readStream.schema("ts timestamp, units bigint").parquet(str(tmp_path / "m"))
    q = ingest.windowed_cash(s).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["units"] for r in spark.table("wc").collect()) == [1, 15]


def test_a_change_that_fails_leaves_everything_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    port = Portfolio(store)
    (tmp_path / "a.csv").write_text(HEAD + BODY)
    port.import_csv(str(tmp_path / "a.csv"))
    before = [sorted(map(str, store.read(t).collect())) for t in ("transactions", "holdings", "cash_flows")]

    def state():
        fresh = Store(spark, store.root)
        return [sorted(map(str, fresh.read(t).collect())) for t in ("transactions", "holdings", "cash_flows")]

    def lost(*_):
        raise OSError("the driver is gone")

    # Before the commit of a single change, and between two tables of an import.
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(OSError):
            port.add_transaction(date="2026-03-15", isin="A1", kind="buy", quantity=1, price=1)
    assert state() == before
    (tmp_path / "b.csv").write_text(HEAD + BODY.replace("12,5", "13,5"))
    with monkeypatch.context() as m:
        real = port._replace
        m.setattr(port, "_replace", lambda name, *a: lost() if name == "cash_flows" else real(name, *a))
        with pytest.raises(OSError):
            port.import_csv(str(tmp_path / "b.csv"))
    assert state() == before
    port.import_csv(str(tmp_path / "a.csv"))
    assert [len(x) for x in state()] == [len(x) for x in before]


def test_no_writer_undoes_another(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with pytest.raises(ConcurrentChange), one.transaction():
        two.set_config(Config(notes="two"))
        one.set_config(Config(notes="one"))
    assert one.config().notes == two.config().notes == "two"
    one.set_config(Config(notes="one"))
    assert two.config().notes == "one" and len(list((tmp_path / "s" / "_commits").glob("0*.json"))) == 2


def _ledger_store(spark, tmp_path, days=360):
    """Twelve months of trades, one file a month."""
    store = Store(spark, str(tmp_path / "s"))
    rows = [(k + 1, dt.date(2025, 1, 1) + dt.timedelta(k), f"I{k % 5}", "buy", 2.0, 10.0, ["avanza", "manual"][k % 3 == 0]) for k in range(days)]
    t = spark.createDataFrame(rows, "id bigint, date date, isin string, kind string, quantity double, price double, source string").withColumn("currency", F.lit("SEK"))
    for m in range(1, 13):
        part = t.where(F.month("date") == m)
        store.append("transactions", part.select(*[(F.col(f.name) if f.name in t.columns else F.lit(None)).alias(f.name) for f in TABLES["transactions"]]))
    return store


def test_changes_write_only_the_files_they_touch(spark, tmp_path):
    store = _ledger_store(spark, tmp_path)
    port = Portfolio(store)
    paths = lambda: {f["path"] for f in store.files("transactions")}
    before, count = paths(), store.read("transactions").count()
    assert len(before) >= 12 and store.next_id("transactions") == 361
    # A month is replaced: the files of the other months stay.
    march = {f["path"] for f in store.files("transactions", since="2025-03-01", until="2025-03-31")}
    gone = store.read("transactions", since="2025-03-01", until="2025-03-31").where("source = 'avanza'").count()
    new = store.read("transactions", since="2025-03-01", until="2025-03-10").where("source = 'avanza'").drop("id", "source")
    with store.transaction():
        port._replace("transactions", new, "2025-03-01", "2025-03-31")
    assert before - march <= paths() and not march & paths()
    kept = store.read("transactions", since="2025-03-01", until="2025-03-10").where("source = 'avanza'").count()
    assert store.read("transactions").count() == count - gone + kept and kept > 0
    # A trade adds a file, a deletion rewrites the one file that holds the row, and readers open only a span's files.
    before = paths()
    port.add_transaction(date="2025-12-30", isin="I1", kind="buy", quantity=1, price=10)
    assert before < paths() and len(paths() - before) == 1
    before = paths()
    assert port.delete_transaction(200) and not port.delete_transaction(200)
    assert len(before - paths()) == 1 == len(paths() - before)
    plan = store.read("transactions", since="2025-06-01", until="2025-06-30")
    assert set(plan.inputFiles()) and all(any(f["path"] in x for f in store.files("transactions", since="2025-06-01", until="2025-06-30")) for x in plan.inputFiles()) and len(plan.inputFiles()) <= 2
    # Compaction keeps the rows.
    rows, files = sorted(map(str, store.read("transactions").collect())), len(paths())
    assert store.compact("transactions", small=200) == files - len(paths()) > 5 and sorted(map(str, store.read("transactions").collect())) == rows
    assert store.read("cash_flows").count() == 0 and store.next_id("cash_flows") == 1 and not store.delete("cash_flows", 1)


def test_recompute_folds_only_what_is_asked_for(spark, make):
    t = ledger.normalized(make.trades(*[(k, "2025-01-01", f"I{k}", "buy", 1, 1) for k in range(5)]))
    plan = ledger.recompute_holdings(make.holdings({"id": 1, "isin": "I1"}), t, ["i1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "I1" in plan[plan.index("MapInArrow") :]


def test_exports_of_a_stream_are_taken_one_by_one(spark, tmp_path):
    """Two exports of one span in one folder: the newer one counts, and holdings follow."""
    import os

    (tmp_path / "in").mkdir()
    for name, text, at in (("b.csv", BODY, 1_000_000), ("a.csv", BODY.replace("12,5", "13,5"), 2_000_000)):
        (tmp_path / "in" / name).write_text(HEAD + text)
        os.utime(tmp_path / "in" / name, (at, at))
    store, direct = Store(spark, str(tmp_path / "store")), Portfolio(Store(spark, str(tmp_path / "direct")))
    q = ingest.into_store(ingest.export_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    for name in ("b.csv", "a.csv"):
        direct.import_csv(str(tmp_path / "in" / name))
    for table in ("transactions", "cash_flows", "holdings"):
        got, want = (sorted(str(r.asDict() | {"id": 0}) for r in s.read(table).collect()) for s in (store, direct.store))
        assert got == want and got
