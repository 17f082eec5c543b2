"""The chained time-weighted index over a series of days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.schemas import Config


def chain(days: DataFrame) -> DataFrame:
    """days with twr_period, nav_index and peak_nav_index.

    days: date, equity, net_contribution (double), only those with equity above zero. A day's return is
    (E - E_prev - C) / E_prev; the first has none, and index and peak 1. The index is an ordered product of
    possibly negative factors, folded in one task: a row a day, a few thousand in all.
    """
    names = [c for c in days.columns if c not in ("date", "equity", "net_contribution")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, index, peak = None, 1.0, 1.0
        for b in batches:
            out = []
            for e, c in zip(b.column("equity").to_pylist(), b.column("net_contribution").to_pylist(), strict=True):
                twr = None
                if prev is not None:
                    twr = (e - prev - c) / prev
                    index = index * (1.0 + twr)
                    peak = max(peak, index)
                prev = e
                out.append((twr, index, peak))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(x), pa.float64()) for x in cols)], names=[*b.schema.names, "twr_period", "nav_index", "peak_nav_index"])

    ordered = days.select("date", "equity", "net_contribution", *names).coalesce(1).sortWithinPartitions("date")
    schema = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes)
    return ordered.mapInArrow(run, f"{schema}, twr_period double, nav_index double, peak_nav_index double")


def metrics(chained: DataFrame, cfg: Config) -> DataFrame:
    """Adds drawdown, effective_leverage, belaningsgrad and delever_status to a chain with gross and loan."""
    drawdown = F.when(F.col("peak_nav_index") > 0, F.col("nav_index") / F.col("peak_nav_index") - 1.0).otherwise(F.lit(0.0))
    out = chained.withColumn("drawdown", drawdown)
    out = out.withColumn("effective_leverage", X.ratio(F.col("gross_asset_value"), F.col("equity"))).withColumn("belaningsgrad", X.ratio(F.col("loan_balance"), F.col("gross_asset_value"), F.lit(0.0)))
    return out.withColumn("delever_status", X.delever_state(F.col("drawdown"), cfg))


def index_reliability(pnl: DataFrame, snapshots: DataFrame, flows_net: DataFrame) -> DataFrame:
    """One row: reliable, note. pnl and flows_net are one-row tables (cost_basis and net, in units)."""
    n = snapshots.agg(F.count(F.lit(1)).alias("n"))
    one = pnl.select("cost_basis").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(flows_net.select("net")))  # three single rows
    note = F.concat_ws("; ", F.when(F.col("n") < 2, F.lit("history reconstructed from a short price window")), F.when((F.col("cost_basis") > 0) & (F.abs("net") * 2 < F.col("cost_basis")), F.lit("deposit history looks incomplete")))
    return one.select((note == "").alias("nav_index_reliable"), F.when(note != "", note).alias("nav_index_note"))
