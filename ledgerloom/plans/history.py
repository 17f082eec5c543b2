"""Reports over time: daily net asset value, the journal, and what was held on a day.

The value of everything held changes only where a position or a price does. Per instrument those changes
are filled forward in date order, their differences are summed by date, and only the table of dates is
cumulated: the cost follows the number of changes, not days x instruments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import cash, ledger, nav
from ledgerloom.operators.asof import dense_days, on_calendar, totals_by_day
from ledgerloom.schemas import Config


def symbol_map(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """(isin, symbol): a holding's symbol first (the last by sleeve, symbol, id), else the first a trade has."""
    h = holdings.where("coalesce(isin, '') != '' and coalesce(symbol, '') != ''")
    order = F.struct(F.col("sleeve_id").isNull(), F.coalesce("sleeve_id", F.lit(0)), "symbol", "id")
    h = h.groupBy(F.upper("isin").alias("isin")).agg(F.max_by(F.upper("symbol"), order).alias("h_symbol"))
    t = trades.where("coalesce(symbol, '') != ''").groupBy("isin").agg(F.min_by(F.upper("symbol"), F.struct("date", "id")).alias("t_symbol"))
    return h.join(t, "isin", "full_outer").select("isin", F.coalesce("h_symbol", "t_symbol").alias("symbol"))


def sleeved(holdings: DataFrame) -> DataFrame:
    return holdings.where("sleeve_id is not null and coalesce(isin, '') != ''").select(F.upper("isin").alias("isin")).distinct()


def _value_changes(trades: DataFrame, holdings: DataFrame, closes: DataFrame, cfg: Config, keep: DataFrame | None) -> DataFrame:
    """(isin, date, turn, value, cost): an instrument's value and cost, in units, from each date on which either changes.

    A date on which both a price and a position change has a row for each (turn 0 and 1), the last of which counts: to bring them
    into one would take another shuffle, and what is wanted of them is differences, which add up to the same.
    """
    eod = ledger.end_of_day(trades)
    if keep is not None:
        eod = eod.join(keep, "isin", "left_semi")
    day_close = closes.groupBy("date", F.upper("ticker").alias("symbol")).agg(F.max("close").alias("close"))
    priced = day_close.join(symbol_map(holdings, trades), "symbol").select("isin", "date", "close")
    state = F.struct("quantity", "cost_ccy", "cost_sek", "currency")
    points = eod.select("isin", "date", F.lit(1).alias("turn"), state.alias("s"), F.lit(None).cast("double").alias("close"))
    points = points.unionByName(priced.select("isin", "date", F.lit(0).alias("turn"), F.lit(None).cast(points.schema["s"].dataType).alias("s"), "close"))
    w = W.partitionBy("isin").orderBy("date", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = points.select("isin", "date", "turn", F.last("s", ignorenulls=True).over(w).alias("s"), F.last("close", ignorenulls=True).over(w).alias("close")).where("s is not null")
    held = F.col("s.quantity") > 0
    price = F.coalesce("close", F.when(held, F.col("s.cost_ccy").cast("double") / F.col("s.quantity").cast("double")))
    value = F.when(held, X.to_units(F.col("s.quantity") * price * X.fx_factor(F.col("s.currency"), cfg))).otherwise(F.lit(0))
    return filled.select("isin", "date", "turn", value.alias("value"), F.when(held, X.to_units(F.col("s.cost_sek"))).otherwise(F.lit(0)).alias("cost"))


def _lookback(closes: DataFrame, start: Column, days: int | None) -> DataFrame:
    """Closes from the lake reach only so many days before the first day; given ones have no such limit."""
    return closes if days is None else closes.where(F.col("date") >= F.date_sub(start, days))


def reconstruct(trades: DataFrame, flows: DataFrame, holdings: DataFrame, closes: DataFrame, cfg: Config, *, start: str | None = None, end: str, lookback_days: int | None = None) -> DataFrame:
    """The daily NAV series over [start or first trade, end]: one row per day with a close, and for both ends.

    Days whose equity is not above zero are left out; the flows up to them count for no later day. Without
    trades, closes or a day in range there is no row. Amounts in SEK.
    """
    span = trades.agg(F.min("date").alias("first")).select((F.lit(start).cast("date") if start else F.col("first")).alias("lo"), F.lit(end).cast("date").alias("hi"))
    span = F.broadcast(span.where("lo <= hi"))  # one row
    usable = closes.crossJoin(span).where(F.col("date") <= F.col("hi"))
    usable = _lookback(usable, F.col("lo"), lookback_days).select("date", "ticker", "close")
    any_close = F.broadcast(usable.limit(1).select(F.lit(1).alias("_any")))
    in_range = usable.crossJoin(span).where(F.col("date") >= F.col("lo")).select("date")
    ends = span.select(F.explode(F.array("lo", "hi")).alias("date"))
    calendar = in_range.union(ends).distinct().crossJoin(any_close).select("date")

    totals = totals_by_day(_value_changes(trades, holdings, usable, cfg, None), by="isin", on="date", then=["turn"], amounts=["value", "cost"])
    valued = on_calendar(calendar, totals, on="date", amounts=["value", "cost"])
    moved = on_calendar(calendar, cash.by_day(cash.movements(trades, flows, cfg)), on="date", amounts=["cash", "flows"])
    days = valued.join(moved, "date")
    gross = F.col("value") + X.idle_cash(F.col("cash"))
    before = F.coalesce(F.lag("flows").over(W.orderBy("date")), F.lit(0))  # the series has a row a day
    days = days.select("date", gross.alias("gross"), "cost", X.loan(F.col("cash")).alias("loan"), (F.col("flows") - before).alias("contribution"), (gross - X.loan(F.col("cash"))).alias("equity_units"))
    sek = days.where("equity_units > 0").select("date", X.from_units(F.col("equity_units")).alias("equity"), X.from_units(F.col("contribution")).alias("net_contribution"), X.from_units(F.col("gross")).alias("gross_asset_value"), X.from_units(F.col("cost")).alias("cost_basis"), X.from_units(F.col("loan")).alias("loan_balance"))
    return nav.metrics(nav.chain(sek), cfg)


def journal(trades: DataFrame, holdings: DataFrame, closes: DataFrame, cfg: Config, *, days: int = 365, end: str, sleeve_only: bool = True, lookback_days: int | None = None) -> DataFrame:
    """A row for every calendar day from max(first trade, end - days + 1) to end: value, cost, P&L, its change, events.

    The first trade of all counts, sleeved or not. Amounts in units. event: '+' and '−' before the symbols
    bought and sold that day, sorted; without closes everything is valued at cost.
    """
    keep = sleeved(holdings) if sleeve_only else None
    last = F.lit(end).cast("date")
    span = F.broadcast(trades.agg(F.min("date").alias("first")).select(F.greatest("first", F.date_sub(last, days - 1)).alias("lo")).where(F.col("lo") <= last))
    calendar = span.select(dense_days(F.col("lo"), last).alias("date"))
    usable = _lookback(closes.crossJoin(span), F.col("lo"), lookback_days).select("date", "ticker", "close")
    totals = totals_by_day(_value_changes(trades, holdings, usable, cfg, keep), by="isin", on="date", then=["turn"], amounts=["value", "cost"])
    valued = on_calendar(calendar, totals, on="date", amounts=["value", "cost"]).withColumn("pnl", F.col("value") - F.col("cost"))
    kept = trades if keep is None else trades.join(keep, "isin", "left_semi")
    mark = F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.col("isin"))
    marks = kept.groupBy("date").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.concat(F.lit(sign), mark)))).alias(k) for k, sign in (("buy", "+"), ("sell", "−"))])
    events = marks.select("date", F.concat_ws(" ", F.concat("buy", "sell")).alias("event"))
    w = W.orderBy("date")  # one row a day
    out = valued.join(events, "date", "left")
    return out.select("date", "value", F.col("cost").alias("cost_basis"), "pnl", F.coalesce(F.col("pnl") - F.lag("pnl").over(w), F.lit(0)).alias("day_pnl"), F.col("event").isNotNull().alias("has_event"), "event")


def holdings_on(trades: DataFrame, holdings: DataFrame, closes: DataFrame, cfg: Config, on: str, *, sleeve_only: bool = True, lookback_days: int | None = None) -> DataFrame:
    """What was held at the end of a day, the most valuable first (ties by isin)."""
    day = F.lit(on).cast("date")
    past = trades.where(F.col("date") <= day)
    held = ledger.positions(past)
    if sleeve_only:
        held = held.join(sleeved(holdings), "isin", "left_semi")
    usable = _lookback(closes.where(F.col("date") <= day), day, lookback_days)
    latest = usable.groupBy(F.upper("ticker").alias("symbol")).agg(F.max(F.struct("date", "close")).alias("c")).select("symbol", F.col("c.close").alias("close"))
    names = holdings.where("coalesce(isin, '') != ''").groupBy(F.upper("isin").alias("isin")).agg(F.max_by("name", F.struct(F.col("sleeve_id").isNull(), F.coalesce("sleeve_id", F.lit(0)), "symbol", "id")).alias("h_name"))
    rows = held.join(symbol_map(holdings, past), "isin", "left").join(latest, "symbol", "left").join(names, "isin", "left")
    price = F.coalesce("close", "avg_price")
    value = X.to_units(F.col("quantity") * price * X.fx_factor(F.col("currency"), cfg))
    cost = X.to_units(F.col("cost_sek"))
    name = F.coalesce(F.when(F.col("h_name") != "", F.col("h_name")), F.col("name"))
    return rows.select("isin", "symbol", name.alias("name"), "currency", "quantity", price.alias("price"), F.col("close").isNotNull().alias("priced"), value.alias("value"), cost.alias("cost_basis"), (value - cost).alias("pnl")).orderBy(F.desc("value"), "isin")


# --- derived from the journal ------------------------------------------------------------------------


def account_drawdown(series: DataFrame) -> DataFrame:
    """Drawdown of the account value from its running peak, 0 while the peak is not above zero."""
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    peak = F.max("value").over(w)
    return series.select("date", "value", peak.alias("peak"), F.when(peak > 0, F.col("value") / peak - 1.0).otherwise(F.lit(0.0)).alias("drawdown"))


def max_drawdown(series: DataFrame) -> DataFrame:
    return account_drawdown(series).agg(F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"))


def heatmap(series: DataFrame) -> DataFrame:
    """Cells of a calendar of weeks from Monday on: week, weekday (0-6), date, and the day's P&L or null."""
    span = F.broadcast(series.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null"))
    days = span.select(dense_days(F.to_date(F.date_trunc("week", "lo")), F.col("hi")).alias("date"), F.to_date(F.date_trunc("week", "lo")).alias("monday"))
    n = F.datediff("date", "monday")
    peak = F.broadcast(series.agg(F.max(F.abs("day_pnl")).alias("largest")))
    cells = days.join(series.select("date", "day_pnl"), "date", "left").crossJoin(peak)
    return cells.select(F.floor(n / 7).cast("int").alias("week"), (n % 7).alias("weekday"), "date", "day_pnl", X.heat_alpha(F.col("day_pnl").cast("double"), F.col("largest").cast("double")).alias("alpha"))


def day_pnl_summary(series: DataFrame) -> DataFrame:
    return series.agg(F.max(F.abs("day_pnl")).alias("max_abs_day_pnl"), F.coalesce(F.sum("day_pnl"), F.lit(0)).alias("net_pnl"))
