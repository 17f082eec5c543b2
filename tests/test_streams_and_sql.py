"""Streams, SQL functions and databases against their batch forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import sql
from ledgerloom.operators import asof, ledger
from ledgerloom.sources import database
from ledgerloom.streaming import positions, sessions


def _trades(spark, make):
    rows = [(k, f"2026-0{1 + k % 6}-{1 + k % 27:02d}", f"I{k % 3}", "sell" if k % 4 == 3 else "buy", 3 + k % 5, 10 + k) for k in range(120)]
    return ledger.normalized(make.trades(*rows, (500, None, "I0", "buy", 2, 5)))


def test_late_trades_are_replayed(spark, make, tmp_path):
    t = _trades(spark, make)
    for k in range(4):  # newest months first
        t.where(F.coalesce(F.month("date"), F.lit(1)) % 4 == (3 - k)).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    positions.keep_positions(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["isin"]: (r["quantity"], r["cost_ccy"], r["cost_sek"], r["acquired_at"], r["date"], r["id"], r["n_late"]) for r in positions.latest(spark, str(tmp_path / "out")).collect()}
    want = {r["isin"]: (r["quantity"], r["cost_ccy"], r["cost_sek"], r["acquired_at"], r["date"], r["id"], 0) for r in ledger._fold(t, "last", ledger.LONG).collect()}
    assert got == want and len(want) == 3


def test_what_comes_after_the_lateness_is_reported(spark, make, tmp_path):
    t = ledger.normalized(make.trades((1, "2026-01-05", "A", "buy", 10, 1), (2, "2026-05-05", "A", "buy", 10, 3), (3, "2026-01-20", "A", "sell", 5, 1), (4, "2026-05-01", "A", "sell", 5, 1)))
    for k, ids in enumerate(([1, 2], [3, 4])):
        t.where(F.col("id").isin(ids)).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        positions.keep_positions(spark.readStream.schema(t.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lateness_days=45)
    (r,) = positions.latest(spark, str(tmp_path / "out")).collect()
    assert (float(r["quantity"]), r["n_trades"], r["n_late"], float(r["cost_ccy"])) == (15, 3, 1, 35.0)


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(k, at + dt.timedelta(minutes=m), u, 1.0) for k, (u, m) in enumerate([(1, 0), (1, 20), (1, 55), (2, 5), (1, 300), (2, 34), (3, 2000)])]
    e = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double")
    e.write.parquet(str(tmp_path / "in"))
    want = {(r["user_id"], r["start"], r["n"]) for r in sessions.sessions(e).collect()}
    assert want == {(1, at, 2), (1, at + dt.timedelta(minutes=55), 1), (2, at + dt.timedelta(minutes=5), 2), (1, at + dt.timedelta(minutes=300), 1), (3, at + dt.timedelta(minutes=2000), 1)}
    s = sessions.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), lateness="10 minutes")
    s.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r["user_id"], r["start"], r["n"]) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {w for w in want if w[0] != 3}  # the newest may still grow


def test_sql_functions(spark, make):
    t = _trades(spark, make)
    sql.register(spark, trades_here=t)
    got = spark.sql("SELECT * FROM ledger_states(TABLE(trades_here) PARTITION BY isin ORDER BY (date, id))").collect()
    assert sorted(map(str, got)) == sorted(map(str, ledger.states(t).collect()))


def test_interval_join_equals_all_pairs(spark):
    states = spark.createDataFrame([(k, dt.date(2020, 1, 1) + dt.timedelta(k * 97 % 1500), k % 4) for k in range(60)], "x long, date date, key long").dropDuplicates(["key", "date"])
    points = spark.createDataFrame([(dt.date(2019, 6, 1) + dt.timedelta(k * 31), k) for k in range(80)] + [(None, 999)], "date date, p long")
    held = asof.intervals(states, by=["key"], on="date")
    got = {(r["key"], r["date"], r["x"], r["p"]) for r in asof.interval_join(held, points, on="date", width_days=50).collect()}
    rows = held.collect()
    want = {(r["key"], q["date"], r["x"], q["p"]) for r in rows for q in points.collect() if q["date"] and r["date"] <= q["date"] and (r["until"] is None or q["date"] < r["until"])}
    assert got == want and len(want) > 100
    assert asof.interval_join(held, points.limit(0), on="date").count() == 0


def test_a_ledger_goes_through_a_database(spark, make, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    t = _trades(spark, make).select("id", "date", "isin", "kind", "quantity", "price").repartition(3)
    types = "isin VARCHAR(20), kind VARCHAR(8)"
    for table in (t.limit(5), t):  # made, then replaced
        database.replace(table, url, "LEDGER", types=types, batch=50)
    back = database.read(spark, url, "LEDGER", split_by="id", parts=4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(str, back.collect())) == sorted(map(str, t.collect()))
    some = back.where("isin = 'I1' and date >= date'2026-03-01'").select("id")
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(isin), *IsNotNull(date), *EqualTo(isin,I1), *GreaterThanOrEqual(date" in plan and some.count() == t.where("isin = 'I1' and date >= date'2026-03-01'").count()
    # A writer that fails leaves the table as it was.
    with pytest.raises(Exception):  # noqa: B017
        database.replace(t.withColumn("price", F.raise_error(F.lit("lost")).cast("decimal(20,8)")), url, "LEDGER", types=types)
    assert database.read(spark, url, "LEDGER").count() == t.count()
    assert database.read(spark, url, "(SELECT * FROM LEDGER WHERE 1 = 0) AS nothing", split_by="id").count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_long_histories_in_pieces_end_where_the_batch_fold_does(spark, tmp_path, exact):
    """Histories of several pieces, in shuffled batches and days that span pieces; each batch's state is that of all trades so far."""
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 1000 != 7, F.expr("date_add(date'1969-01-01', int((id * 7919) % 9000 / 9))")).alias("date"), F.concat(F.lit("I"), F.col("id") % 3 % 2).alias("isin"),
        F.when(F.hash("id") % 9 < 4, "buy").otherwise("sell").alias("kind"), (F.abs(F.hash("id")) % 50 / 3 + 1).alias("quantity"), (F.abs(F.hash("id")) % 900 / 7).alias("price"), F.when(F.col("id") % 4 == 0, F.col("id") / 11).alias("amount_sek"),
    )
    t = ledger.normalized(rows, exact=exact)
    for k in range(3):
        t.where(F.pmod(F.hash("id"), F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        stream = spark.readStream.schema(t.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        positions.keep_positions(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        so_far = t.where(F.pmod(F.hash("id"), F.lit(3)) <= k)
        columns = ["isin", "date", "id", "quantity", "cost_ccy", "cost_sek", "acquired_at"]
        got, counts = positions.latest(spark, str(tmp_path / "out")), so_far.groupBy("isin").count().collect()
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, ledger._fold(so_far, "last", ledger.LONG).select(*columns).collect()))
        assert {(r["isin"], r["n_trades"], r["n_late"]) for r in got.collect()} == {(r["isin"], r["count"], 0) for r in counts}
    assert max(r["count"] for r in counts) > 2 * positions.PIECE


def test_the_state_of_a_key_is_read_and_written_in_one_call_each(spark):
    """Months were a state each: some 250 calls for seven years of trades, each a round trip to the JVM."""

    class Kept:
        def __init__(self, calls):
            self.calls, self.value = calls, None

        def __getattr__(self, name):
            def call(*given):
                self.calls.append(name)
                if name == "update":
                    self.value = given[0]
                return self.value if name == "get" else None

            return call

    calls, out = [], []
    replay = positions.Replay(None, False)
    replay.head, replay.pieces = Kept(calls), Kept(calls)
    for batch in range(2):
        rows = np.zeros(300, positions.PACKED[False])
        rows["day"], rows["id"], rows["flags"], rows["quantity"], rows["price"] = np.arange(300) * 9 - batch, np.arange(300) + 300 * batch, 1, 2.0, 3.0
        out += list(replay.handleInputRows(("A",), iter([{"trades": rows.tobytes()}]), None))
    assert calls == ["get", "update"] * 2 and [(r["n_trades"], r["quantity"], r["cost_ccy"]) for r in out] == [(300, 600.0, 1800.0), (600, 1200.0, 3600.0)]


def test_settled_pieces_are_not_kept(spark, tmp_path):
    rows = spark.range(6000).select("id", F.expr("date_add(date'2020-01-01', int(id / 20))").alias("date"), F.lit("A").alias("isin"), F.lit("buy").alias("kind"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("price"))
    t, late = ledger.normalized(rows, exact=False), ledger.normalized(rows.where("id in (5, 5990)").withColumn("id", F.col("id") + 10_000), exact=False)
    for k, part in enumerate((t, late)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        positions.keep_positions(spark.readStream.schema(t.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lateness_days=30)
    (r,) = positions.latest(spark, str(tmp_path / "out")).collect()
    assert (r["n_trades"], r["n_late"], r["quantity"], r["cost_sek"]) == (6001, 1, 6001.0, 12002.0)
    head = spark.read.format("statestore").option("stateVarName", "head").load(str(tmp_path / "cp")).where("value is not null").select("value.*").first()
    assert head["settled"] >= 3000 and head["first"] >= 3 and head["settled"] + 2 * positions.PIECE + 1000 >= 6001
