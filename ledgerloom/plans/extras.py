"""Registered queries of the stored ledger's changes, long histories, streams, SQL text and time intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import sql
from ledgerloom.api import Portfolio
from ledgerloom.operators import asof, ledger, valuation
from ledgerloom.plans.oracles import UNITS, query
from ledgerloom.plans.queries import _trades, _valued, cost, num, register, scost
from ledgerloom.sources import fixtures
from ledgerloom.store import Store
from ledgerloom.stored import folder, written
from ledgerloom.streaming import positions, sessions

ALL_STATES = query(f"SELECT isin, id, date, q AS quantity, {scost('c', 'cost_ccy')}, {scost('s', 'cost_sek')} FROM states", "states")
MONTH = "date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"
ENDS = "(SELECT DISTINCT last_day(date) AS date FROM trades)"


@register(query(f"""SELECT source, year, count(*) AS n, sum(quantity) AS quantity FROM (SELECT source, year(date) AS year, quantity FROM trades WHERE NOT (source = 'avanza' AND {MONTH}) AND id <> 30000001
  UNION ALL SELECT source, year(date), quantity FROM trades WHERE source = 'avanza' AND {MONTH} AND id % 2 = 0) GROUP BY ALL""", "trades"))
def store_replace_month(spark, d):
    """In the store: a month of imported trades is replaced, twice, and a trade deleted; the files of other months stay as they are."""
    store = Store(spark, folder(spark, "month"))
    store.write("transactions", fixtures.trades(spark, d))
    port = Portfolio(store)
    lo, hi = "1996-03-01", "1996-03-31"
    new = written(store.read("transactions", since=lo, until=hi).where("source = 'avanza' and id % 2 = 0").drop("id", "source"), "month-new")
    for _ in range(2):
        port._replace("transactions", new, lo, hi)
    store.delete("transactions", 30000001)
    return store.read("transactions").groupBy("source", F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity").cast("double")).alias("quantity"))


@register(ALL_STATES)
def ledger_states_in_pieces(spark, d):
    """The state after each trade, with every history of over 200 trades folded in pieces side by side."""
    s = ledger.states(written(_trades(spark, d), "trades"), long=200)
    return s.select("isin", "id", "date", *num("quantity"), cost("cost_ccy"), cost("cost_sek"))


@register(ALL_STATES)
def sql_ledger_states(spark, d):
    """The same from SQL text: a table function over a view."""
    sql.register(spark, trades=_trades(spark, d))
    s = spark.sql("SELECT isin, id, date, quantity, cost_ccy, cost_sek FROM ledger_states(TABLE(trades) PARTITION BY isin ORDER BY (date, id))")
    return s.select("isin", "id", "date", *num("quantity"), cost("cost_ccy"), cost("cost_sek"))


@register(query(f"SELECT d.symbol AS key, d.date AS at, close AS value FROM (SELECT symbol, e.date FROM instruments, {ENDS} e) d ASOF LEFT JOIN closes c ON c.ticker = d.symbol AND c.date <= d.date", "instruments", "trades", "closes"))
def sql_as_of(spark, d):
    """Closes as of each month's end from SQL text, by the table function as_of."""
    ends = _trades(spark, d).select(F.last_day("date").alias("at")).distinct()
    symbols = fixtures.instruments(spark, d).select(F.col("symbol").alias("key"))
    asked = symbols.join(ends, F.lit(True)).withColumns({"value": F.lit(None).cast("double"), "is_question": F.lit(True)})  # the question: all at every end
    known = fixtures.closes(spark, d).select(F.col("ticker").alias("key"), F.col("date").alias("at"), F.col("close").alias("value"), F.lit(False).alias("is_question"))
    sql.register(spark, points=asked.unionByName(known))
    return spark.sql("SELECT key, at, value FROM as_of(TABLE(points) PARTITION BY key ORDER BY (at, is_question))")


@register(query(f"SELECT isin, q AS quantity, {scost('c', 'cost_ccy')}, {scost('s', 'cost_sek')}, n AS n_trades, 0 AS n_late FROM last_states JOIN (SELECT isin, count(*) AS n FROM trades GROUP BY isin) USING (isin)", "last_states"))
def stream_positions(spark, d):
    """Trades streamed in shuffled files, so that most come late: the last states are those of the batch fold."""
    source, out, checkpoint = (folder(spark, f"stream-{x}") for x in ("trades", "states", "checkpoint"))
    t = _trades(spark, d)
    t.repartition(6, F.xxhash64("id")).write.parquet(source)
    positions.keep_positions(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 3).parquet(source), out, checkpoint)
    return positions.latest(spark, out).select("isin", *num("quantity"), cost("cost_ccy"), cost("cost_sek"), "n_trades", "n_late")


@register(query(f"""SELECT isin, d.date, q AS quantity, {scost('s', 'cost_sek')}, {UNITS.format('q * coalesce(p.close, c / q) * fx')} AS value FROM (SELECT isin, symbol, e.date FROM instruments, {ENDS} e) d ASOF JOIN eod USING (isin, date) ASOF LEFT JOIN closes p ON d.symbol = p.ticker AND d.date >= p.date WHERE q > 0""", "instruments", "trades", "eod", "closes"))
def positions_at_month_ends(spark, d):
    """What was held at the end of each month, and its value, by joining intervals of states with dates."""
    t = written(_trades(spark, d), "trades")
    ends = t.select(F.last_day("date").alias("date")).distinct()
    held = asof.interval_join(asof.intervals(ledger.end_of_day(t), by=["isin"], on="date"), ends, on="date").where("quantity > 0")
    names = fixtures.instruments(spark, d).select("isin", F.col("symbol").alias("ticker"), "fx")
    priced = asof.asof_join(held.join(names, "isin"), fixtures.closes(spark, d), by=["ticker"], on="date", values=["close"])
    price = F.coalesce("close", F.col("cost_ccy").cast("double") / F.col("quantity").cast("double"))
    value = F.floor(F.col("quantity").cast("double") * price * F.col("fx") * 10000.0 + 0.5).cast("bigint")
    return priced.select("isin", "date", *num("quantity"), cost("cost_sek"), value.alias("value"))


@register(query("SELECT sleeve_id, currency, price_label, GROUPING(sleeve_id, currency, price_label) AS summed, CAST(sum(market_value) AS BIGINT) AS market_value, CAST(sum(cost_basis) AS BIGINT) AS cost_basis, count(*) AS n_holdings FROM valued GROUP BY CUBE (sleeve_id, currency, price_label)", "valued"))
def allocation_cube(spark, d):
    """Value and cost by sleeve, currency and kind of price, with all subtotals."""
    return valuation.subtotals(_valued(spark, d), "sleeve_id", "currency", "price_label")


@register("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def event_sessions(spark, d):
    """Sessions of events with gaps of up to half an hour."""
    return sessions.sessions(fixtures.table(spark, d, "events")).select("user_id", "start", "end", "n", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@register("SELECT event_type, count(*) AS n, true AS users_close, true AS ranks_close FROM events GROUP BY event_type")
def event_sketches(spark, d):
    """Sketches stored by day and merged: numbers of users within 5 % and quantiles within 2 % of rank of the exact ones."""
    e = fixtures.table(spark, d, "events")
    stored = written(e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("user_id").alias("users"), F.kll_sketch_agg_double("value").alias("spread")), "sketches")
    told = sessions.merged(stored, "event_type")
    exact = e.join(F.broadcast(told.select("event_type", "p10", "p50", "p90")), "event_type")  # a row a type of event
    rank = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    exact = exact.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact_users"), rank("p10").alias("r10"), rank("p50").alias("r50"), rank("p90").alias("r90"))
    near = (F.abs(F.col("r10") - 0.1) < 0.02) & (F.abs(F.col("r50") - 0.5) < 0.02) & (F.abs(F.col("r90") - 0.9) < 0.02)
    return told.join(exact, "event_type").select("event_type", "n", (F.abs(F.col("users") - F.col("exact_users")) <= 0.05 * F.col("exact_users")).alias("users_close"), near.alias("ranks_close"))
