"""Daily closes in a lake of Parquet files: <root>/bars/tf=<bar>/date=YYYY-MM-DD/*.parquet with ticker and close."""

from __future__ import annotations

import contextlib
import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS = "date date, ticker string, close double, file string"


def days(spark: SparkSession, root: str, tf: str = "1day") -> list[dt.date]:
    """The days that have a folder, ascending, from a listing; folders that are no dates are passed over."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bars/tf={tf}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for f in fs.listStatus(base) if fs.exists(base) else []:
        name = re.fullmatch(r"date=(\d{4}-\d\d-\d\d)", f.getPath().getName())
        if name:
            with contextlib.suppress(ValueError):
                found.append(dt.date.fromisoformat(name[1]))
    return sorted(found)


def _read(spark: SparkSession, root: str, tf: str, some: list[dt.date]) -> DataFrame:
    if not some:
        return spark.createDataFrame([], ROWS)
    base = f"{root}/bars/tf={tf}"
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/date={d}" for d in some])
    rows = rows.where(F.col("date").between(F.lit(some[0]), F.lit(some[-1])))
    return rows.select(F.col("date").cast("date").alias("date"), F.upper("ticker").alias("ticker"), F.col("close").cast("double").alias("close"), F.col("_metadata.file_path").alias("file")).where("ticker is not null and close is not null")


def lake(spark: SparkSession, root: str, tf: str = "1day", *, since: str | None = None, until: str | None = None) -> DataFrame:
    """(date, ticker, close, file) of the days in a span (both ends included); only their folders are listed and read."""
    return _read(spark, root, tf, [d for d in days(spark, root, tf) if (since is None or str(d) >= str(since)) and (until is None or str(d) <= str(until))])


def newest(spark: SparkSession, root: str, tf: str = "1day") -> DataFrame:
    """lake of the newest day alone: the last folder that holds a file."""
    for d in reversed(days(spark, root, tf)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bars/tf={tf}/date={d}")
        if any(f.isFile() and f.getPath().getName()[0] not in "._" for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)):
            return _read(spark, root, tf, [d])
    return _read(spark, root, tf, [])


def latest_closes(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, close, date) of the newest day in rows for the tickers of a table; if that day has several files, the first counts.

    Of a lake, give `newest`: this reads its rows three times.
    """
    last = F.broadcast(rows.agg(F.max("date").alias("date")))  # one row
    day = rows.join(last, "date", "left_semi")
    first = F.broadcast(day.agg(F.min("file").alias("file")))
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return day.join(first, "file", "left_semi").withColumn("ticker", F.upper("ticker")).join(wanted, "ticker", "left_semi").groupBy("ticker").agg(F.max("close").alias("close"), F.max("date").alias("date"))


def closes_in_range(rows: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """(date, ticker, close) in [start, end] for the tickers of a table; of several files of a day the last counts."""
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    rows = rows if "file" in rows.columns else rows.withColumn("file", F.lit(""))
    days = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("ticker", F.upper("ticker")).join(wanted, "ticker", "left_semi")
    return days.groupBy("date", "ticker").agg(F.max_by("close", F.struct("file", "close")).alias("close"))


def write(closes: DataFrame, root: str, tf: str = "1day") -> None:
    """closes (date, ticker, close) as a lake, one folder a day."""
    closes.repartition("date").write.mode("overwrite").partitionBy("date").parquet(f"{root}/bars/tf={tf}")
