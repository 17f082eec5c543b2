"""Sessions of events and mergeable sketches of them, in batch and in a stream (beyond the ledger's own reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, *, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """(user_id, start, end, n, value): runs of a user's events with less than `gap` between them; end is `gap` after the last.

    lateness: of a stream, how far behind the newest event one may come; a session is given out once that has passed.
    """
    rows = events if lateness is None else events.withWatermark("ts", lateness)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", "w.start", "w.end", "n", "value")


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, n, users, spread): each day's number of events, a sketch of its distinct users and one of the distribution of its values."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("user_id").alias("users"), F.kll_sketch_agg_double("value").alias("spread"))


def merged(sketches: DataFrame, *keys, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Sketches of several days as one for each key: n, the estimated number of users, and the values at some ranks."""
    one = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"))
    kept = [c for c in one.columns if c not in ("users", "spread")]
    return one.select(*kept, F.hll_sketch_estimate("users").alias("users"), *[F.kll_sketch_get_quantile_double("spread", F.lit(p)).alias(f"p{round(100 * p)}") for p in at])
