"""Cash reconciliation over the two ledgers: amounts in whole units, see functions.exprs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.schemas import Config


def movements(trades: DataFrame, flows: DataFrame, cfg: Config) -> DataFrame:
    """(date, units, flow_units): every cash effect of trades and flows; flow_units is 0 for trades."""
    fx = X.fx_factor(F.col("currency"), cfg)
    traded = trades.select("date", X.to_units(X.trade_cash(F.col("kind"), F.col("quantity"), F.col("price"), F.col("amount_sek"), F.col("fees_sek"), fx)).alias("units"), F.lit(0).cast("bigint").alias("flow_units"))
    flowed = flows.select("date", X.to_units(F.col("amount_sek")).alias("units"), X.to_units(F.col("amount_sek")).alias("flow_units"))
    return traded.unionByName(flowed)


def by_day(moves: DataFrame) -> DataFrame:
    """Running cash and flows at the end of each day with a movement. Only the table of days is ordered."""
    days = moves.groupBy("date").agg(F.sum("units").alias("units"), F.sum("flow_units").alias("flow_units"))
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.select("date", F.sum("units").over(w).alias("cash"), F.sum("flow_units").over(w).alias("flows"))


def account(moves: DataFrame, through: str | None = None) -> DataFrame:
    """One row: cash, loan and cash_asset after all movements up to and including a date."""
    rows = moves if through is None else moves.where(F.col("date") <= F.lit(through).cast("date"))
    total = rows.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("cash"))
    return total.select("cash", X.loan(F.col("cash")).alias("loan"), X.idle_cash(F.col("cash")).alias("cash_asset"))


def net_flow(flows: DataFrame, after: str | None, through: str) -> DataFrame:
    """One row: the net of flows with after < date <= through (after None: since ever)."""
    rows = flows.where(F.col("date") <= F.lit(through).cast("date"))
    rows = rows if after is None else rows.where(F.col("date") > F.lit(after).cast("date"))
    return rows.agg(F.coalesce(F.sum(X.to_units(F.col("amount_sek"))), F.lit(0)).alias("net"))


def flow_by_period(days: DataFrame, points: DataFrame) -> DataFrame:
    """Net flow between consecutive points (exclusive, inclusive); the first takes all before it."""
    from ledgerloom.operators.asof import on_calendar

    at = on_calendar(points, days.select("date", "flows"), on="date", amounts=["flows"])
    return at.select("date", (F.col("flows") - F.coalesce(F.lag("flows").over(W.orderBy("date")), F.lit(0))).alias("net"))
