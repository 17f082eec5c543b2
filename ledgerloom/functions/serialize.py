"""Rows in the form of the service's interface: decimals as numbers, dates as ISO text, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        return c.cast("double").alias(name)
    if isinstance(kind, T.DateType):
        return c.cast("string").alias(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
    return c.alias(name)


def plain_rows(df: DataFrame) -> DataFrame:
    """df with interface types; nested columns are left as they are."""
    return df.select(*[plain(f.name, f.dataType) for f in df.schema])


def to_json(df: DataFrame) -> DataFrame:
    """One column json: each row as an object with all its fields."""
    rows = plain_rows(df)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def holding_rows(holdings: DataFrame, sleeves: DataFrame | None = None) -> DataFrame:
    """Holdings with sleeve_code, which is null unless sleeves are given."""
    if sleeves is None:
        return plain_rows(holdings.withColumn("sleeve_code", F.lit(None).cast("string")))
    codes = sleeves.select(F.col("id").alias("sleeve_id"), F.col("code").alias("sleeve_code"))
    return plain_rows(holdings.join(codes, "sleeve_id", "left").select(*holdings.columns, "sleeve_code"))
