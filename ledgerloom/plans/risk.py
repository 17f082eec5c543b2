"""The live risk panel and snapshots of the NAV ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import cash, nav, valuation
from ledgerloom.schemas import NAV_SNAPSHOTS, Config


def gross_and_loan(valued: DataFrame, moves: DataFrame, as_of: str) -> DataFrame:
    """One row in units: gross (all holdings at current prices and idle cash) and loan as of a date."""
    account = cash.account(moves, as_of)
    one = valuation.total_gross(valued).crossJoin(F.broadcast(account))
    return one.select((F.col("gross") + F.col("cash_asset")).alias("gross"), "loan")


def latest_snapshot(snapshots: DataFrame, before: str) -> DataFrame:
    """At most one row: the newest snapshot strictly before a date."""
    return snapshots.where(F.col("as_of") < F.lit(before).cast("date")).orderBy(F.desc("as_of")).limit(1)


def period(now: DataFrame, snapshots: DataFrame, as_of: str, cfg: Config) -> DataFrame:
    """The period metrics of one row (gross, loan, contribution; SEK) against the snapshot before it."""
    prev = latest_snapshot(snapshots, as_of).where("equity > 0").select(*[F.col(c).cast("double").alias(f"p_{c}") for c in ("equity", "nav_index", "peak_nav_index")])
    one = now.withColumn("equity", F.col("gross") - F.col("loan")).join(F.broadcast(prev), F.lit(True), "left")
    twr = (F.col("equity") - F.col("p_equity") - F.col("contribution")) / F.col("p_equity")
    one = one.withColumn("twr_period", twr).withColumn("nav_index", F.coalesce(F.col("p_nav_index") * (1.0 + F.col("twr_period")), F.lit(1.0)))
    one = one.withColumn("peak_nav_index", F.greatest(F.coalesce("p_peak_nav_index", F.lit(1.0)), F.col("nav_index")))
    named = one.select(F.lit(as_of).cast("date").alias("as_of"), F.col("gross").alias("gross_asset_value"), F.col("loan").alias("loan_balance"), F.col("contribution").alias("net_contribution"), "equity", "twr_period", "nav_index", "peak_nav_index", *[c for c in now.columns if c not in ("gross", "loan", "contribution")])
    return nav.metrics(named, cfg)


def current_risk(valued: DataFrame, trades: DataFrame, flows: DataFrame, snapshots: DataFrame, cfg: Config, today: str) -> DataFrame:
    """One row: the risk picture of today, live against the last snapshot before it; nothing is stored.

    The period's contribution counts as zero. Where there is nothing to measure, the live columns are null,
    the state is normal and the target leverage that of a small portfolio.
    """
    moves = cash.movements(trades, flows, cfg)
    pnl = valuation.portfolio_pnl(valued, sleeve_only=True)
    reliable = nav.index_reliability(pnl, snapshots, cash.net_flow(flows, None, today))
    now = gross_and_loan(valued, moves, today).select(X.from_units(F.col("gross")).alias("gross"), X.from_units(F.col("loan")).alias("loan"), F.lit(0.0).alias("contribution"))
    live = period(now, snapshots, today, cfg)
    had = F.broadcast(latest_snapshot(snapshots, today).agg(F.count(F.lit(1)).alias("had")))
    live = live.crossJoin(had).withColumn("live", (F.col("equity") > 0) & ((F.col("gross_asset_value") > 0) | (F.col("had") > 0)))
    only = lambda c: F.when(F.col("live"), c)
    state = F.coalesce(only(F.col("delever_status")), F.lit("normal"))
    cols = [only(F.col(c)).alias(c) for c in ("as_of", "nav_index", "drawdown", "twr_period", "gross_asset_value", "loan_balance", "equity", "effective_leverage", "belaningsgrad")]
    room = [only(h).alias(n) for h, n in zip(X.headrooms(F.col("drawdown"), F.col("belaningsgrad"), cfg), ("headroom_to_half", "headroom_to_full", "headroom_to_forced_sale", "belaningsgrad_headroom"), strict=True)]
    panel = live.select(*cols, state.alias("delever_status"), *room, F.coalesce(only(X.glide_leverage(F.col("equity"), cfg)), F.lit(float(cfg.leverage_target))).alias("target_leverage"), F.when(F.col("live"), X.action(state)).otherwise("no NAV snapshots yet").alias("action"))
    money = pnl.select(*[F.col(c).alias(f"pnl_{c}") for c in pnl.columns])
    return panel.crossJoin(F.broadcast(money)).crossJoin(F.broadcast(reliable))


def snapshot_row(valued: DataFrame, trades: DataFrame, flows: DataFrame, snapshots: DataFrame, cfg: Config, as_of: str, *, gross: float | None = None, loan: float | None = None, contribution: float | None = None, notes: str | None = None) -> DataFrame:
    """One row of NAV_SNAPSHOTS for a date; gross, loan and contribution are derived where not given.

    ValueError if equity is not above zero.
    """
    moves = cash.movements(trades, flows, cfg)
    prev = latest_snapshot(snapshots, as_of).select("as_of").first()
    derived = gross_and_loan(valued, moves, as_of).crossJoin(F.broadcast(cash.net_flow(flows, str(prev["as_of"]) if prev else None, as_of))).crossJoin(F.broadcast(valuation.portfolio_pnl(valued).select("cost_basis")))
    given = lambda v, c: F.lit(float(v)) if v is not None else X.from_units(F.col(c))
    now = derived.select(given(gross, "gross").alias("gross"), given(loan, "loan").alias("loan"), given(contribution, "net").alias("contribution"), X.from_units(F.col("cost_basis")).alias("cost_basis"))
    out = period(now, snapshots, as_of, cfg).withColumn("notes", F.lit(notes).cast("string"))
    if out.select("equity").first()["equity"] <= 0:
        raise ValueError("equity (gross - loan) must be > 0")
    return as_snapshots(out)


def as_snapshots(rows: DataFrame) -> DataFrame:
    """Cast to the stored types, in their order."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NAV_SNAPSHOTS])


def add_snapshot(snapshots: DataFrame, row: DataFrame) -> DataFrame:
    """snapshots with a new row; a second one of a date is an error."""
    day = row.select("as_of").first()["as_of"]
    if snapshots.where(F.col("as_of") == F.lit(day)).limit(1).count():
        raise ValueError(f"a snapshot of {day} exists")
    return snapshots.unionByName(row)


def upsert_snapshot(snapshots: DataFrame, row: DataFrame) -> DataFrame:
    """snapshots with row instead of any of its date; later ones are not chained anew."""
    return snapshots.join(F.broadcast(row.select("as_of")), "as_of", "left_anti").select(*snapshots.columns).unionByName(row)


def backfill(snapshots: DataFrame, series: DataFrame) -> DataFrame:
    """snapshots with everything from the first to the last day of a reconstructed series replaced by it."""
    rows = as_snapshots(series.withColumnRenamed("date", "as_of").withColumn("notes", F.lit("reconstructed")))
    span = F.broadcast(series.agg(F.min("date").alias("lo"), F.max("date").alias("hi")))
    kept = snapshots.crossJoin(span).where("lo is null or as_of < lo or as_of > hi").drop("lo", "hi")
    return kept.unionByName(rows)


def nav_series(snapshots: DataFrame, series: DataFrame) -> DataFrame:
    """Stored snapshots; where there are fewer than two, the reconstructed series if it has two or more."""
    if snapshots.limit(2).count() >= 2:
        return snapshots.orderBy("as_of")
    rebuilt = as_snapshots(series.withColumnRenamed("date", "as_of"))
    return rebuilt.orderBy("as_of") if rebuilt.limit(2).count() >= 2 else snapshots.orderBy("as_of")


def today() -> str:
    return dt.datetime.now(dt.UTC).date().isoformat()
