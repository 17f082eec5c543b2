"""As-of joins and totals over time, without a calendar x instrument product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right at or before its time; null if there is none.

    Both sides are stacked and the last known values filled forward: one shuffle, no range join. Where left
    and right times are equal, right counts. Of right rows with equal keys and time, the largest values stand.
    """
    keys = [*by, on]
    r = right.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_r")).select(*keys, "_r", F.lit(0).alias("_side"), F.lit(None).alias("_l"))
    l_cols = [c for c in left.columns if c not in keys]
    kind = r.schema["_r"].dataType
    lf = left.select(*keys, F.lit(None).cast(kind).alias("_r"), F.lit(1).alias("_side"), F.struct(*(l_cols or [F.lit(0).alias("_none")])).alias("_l"))
    both = r.select(*keys, "_r", "_side", F.lit(None).cast(lf.schema["_l"].dataType).alias("_l")).unionByName(lf)
    w = W.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*keys, *[F.col(f"_l.`{c}`").alias(c) for c in l_cols], *[F.col(f"_r.`{v}`").alias(v) for v in values])


def totals_by_day(changes: DataFrame, *, by: str, on: str, amounts: list[str], then: list[str] | None = None) -> DataFrame:
    """Running totals over all keys at each date on which any of them changes.

    changes: (by, on, amounts...) with each key's new whole-number amounts. Differences per key are summed by
    date, and only the table of dates is summed up in order, so the cost is that of the changes. A key may change more than once a
    date if the columns `then` say in which order; the last amounts count.
    """
    w = W.partitionBy(by).orderBy(on, *(then or []))
    steps = changes.select(on, *[(F.col(a) - F.coalesce(F.lag(a).over(w), F.lit(0))).alias(a) for a in amounts])
    days = steps.groupBy(on).agg(*[F.sum(a).alias(a) for a in amounts])
    run = W.orderBy(on).rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.select(on, *[F.sum(a).over(run).alias(a) for a in amounts])


def on_calendar(calendar: DataFrame, totals: DataFrame, *, on: str, amounts: list[str]) -> DataFrame:
    """The totals in force on each day of a calendar (0 before the first); both are tables of dates."""
    both = totals.select(on, *amounts, F.lit(0).alias("_side")).unionByName(calendar.select(on, *[F.lit(None).cast("bigint").alias(a) for a in amounts], F.lit(1).alias("_side")))
    w = W.orderBy(on, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = both.select(on, "_side", *[F.coalesce(F.last(a, ignorenulls=True).over(w), F.lit(0)).alias(a) for a in amounts])
    return filled.where("_side = 1").drop("_side")


def dense_days(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def intervals(changes: DataFrame, *, by: list[str], on: str) -> DataFrame:
    """changes with `until`: the date of the key's next row, from which this one is no longer in force; null for the last."""
    return changes.withColumn("until", F.lead(on).over(W.partitionBy(*by).orderBy(on)))


def interval_join(states: DataFrame, points: DataFrame, *, on: str, by: list[str] | None = None, width_days: int = 366) -> DataFrame:
    """points with the columns of all states in force on their date: from `on` on, before `until` (null: still in force).

    by: columns that both have and that must be equal. Both sides meet by ranges of width_days: a state is there once
    for each range that it reaches into and that has points, so the work is that of the pairs in force and not of all pairs.
    """
    by = by or []
    spot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width_days).cast("int")
    dated = points.where(F.col(on).isNotNull()).withColumn("_spot", spot(F.col(on))).withColumnRenamed(on, "_at")
    span = points.agg(F.min(on).alias("lo"), F.max(on).alias("hi")).first()
    if span["lo"] is None:
        return states.join(points.select(F.col(on).alias("_at"), *by, *[c for c in points.columns if c not in by + [on]]).limit(0), F.lit(True)).limit(0).drop("_at", "until")
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    used = states.where((F.col(on) <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    last = F.least(hi, F.coalesce(F.date_sub("until", 1), hi))
    spread = used.withColumn("_spot", F.explode(F.sequence(spot(F.greatest(lo, F.col(on))), spot(last)))).withColumnRenamed(on, "_from")
    met = spread.join(dated, [*by, "_spot"]).where((F.col("_from") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    return met.withColumn(on, F.col("_at")).drop("_spot", "_at", "_from", "until")
