"""Changes of stored tables, each a function from a table to the table it becomes."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schemas import ASSET_CLASSES, CASH_FLOWS, FLOW_KINDS, HOLDINGS, LEDGER_SOURCES, PRICE_SOURCES, SLEEVE_KINDS, SLEEVES, TRADE_KINDS, TRANSACTIONS, member


def one_row(spark, schema: T.StructType, values: dict[str, Any]) -> DataFrame:
    """A row of a table from plain values: numbers and ISO dates are cast to the column's type."""
    cells = [F.lit(v.isoformat() if isinstance(v, dt.date) else str(v) if v is not None else None).cast(f.dataType).alias(f.name) for f, v in ((f, values.get(f.name)) for f in schema)]
    return spark.range(1).select(*cells)


def next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id").alias("m")).first()["m"] or 0) + 1


def with_ids(rows: DataFrame, after: int) -> DataFrame:
    """rows with fresh ids above `after`, rising in (date) order within partitions; gaps may occur."""
    return rows.repartitionByRange("date").sortWithinPartitions("date").withColumn("id", F.monotonically_increasing_id() + F.lit(after))


def without_range(table: DataFrame, date_min: str, date_max: str, *, source: str = "avanza") -> DataFrame:
    """table without the rows of `source` in [date_min, date_max]; rows without a date or source stay."""
    day = F.col("date").between(F.lit(date_min).cast("date"), F.lit(date_max).cast("date"))
    return table.where(~F.coalesce((F.col("source") == source) & day, F.lit(False)))


def replace_range(table: DataFrame, rows: DataFrame, date_min: str, date_max: str, *, source: str = "avanza") -> DataFrame:
    """table with the rows of `source` in [date_min, date_max] replaced by rows; other sources stay. Doing it twice changes nothing."""
    return without_range(table, date_min, date_max, source=source).unionByName(rows.withColumn("source", F.lit(source)).select(*table.columns))


def delete_by_id(table: DataFrame, row_id: int) -> tuple[DataFrame, bool]:
    """(table without the row, whether it was there)."""
    found = table.where(F.col("id") == row_id).limit(1).count() > 0
    return table.where((F.col("id") != row_id) | F.col("id").isNull()), found


def trade_row(spark, row_id: int, **t: Any) -> DataFrame:
    isin, quantity = str(t.get("isin") or "").strip().upper(), abs(float(t.get("quantity") or 0))
    if not isin:
        raise ValueError("isin is required")
    if quantity <= 0:
        raise ValueError("quantity must be > 0")
    values = {**t, "id": row_id, "isin": isin, "quantity": quantity, "currency": str(t.get("currency") or "SEK").upper(), "kind": member(t.get("kind"), TRADE_KINDS, "kind"), "fees_sek": t.get("fees_sek") or 0, "source": member(t.get("source") or "manual", LEDGER_SOURCES, "source"), "symbol": t.get("symbol") or None}
    return one_row(spark, TRANSACTIONS, values)


def flow_row(spark, row_id: int, **f: Any) -> DataFrame:
    kind, amount = member(f.get("kind"), FLOW_KINDS, "kind"), abs(float(f.get("amount_sek") or 0))
    if amount <= 0:
        raise ValueError("amount must be > 0")
    return one_row(spark, CASH_FLOWS, {**f, "id": row_id, "kind": kind, "amount_sek": amount if kind == "deposit" else -amount, "source": member(f.get("source") or "manual", LEDGER_SOURCES, "source")})


def upsert(table: DataFrame, rows: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """table with rows merged by key: a null in rows keeps the old value, unknown keys are added.

    keep_old: columns whose old value, where there is one, wins.
    """
    old, new = table.alias("o"), rows.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep_old or c == "id" else F.coalesce(f"n.{c}", f"o.{c}")
    return both.select(*[(pick(c) if c in rows.columns else F.col(f"o.{c}")).alias(c) for c in table.columns])


def upsert_sleeve(sleeves: DataFrame, *, code: str, **s: Any) -> DataFrame:
    """Only the settings given are changed; a new sleeve needs none but its code."""
    new = sleeves.where(F.col("code") == code).limit(1).count() == 0
    values = {**s, "code": code}
    if s.get("kind") is not None or new:
        values["kind"] = member(s.get("kind") or "other", SLEEVE_KINDS, "kind")
    if new:
        values = {"id": next_id(sleeves), "name": code, "target_weight": 0, "sort_order": 0} | {k: v for k, v in values.items() if v is not None}
    return upsert(sleeves, one_row(sleeves.sparkSession, SLEEVES, values), "code")


#: The sleeves that an empty store is seeded with (fixed values).
DEFAULT_SLEEVES = [
    {"code": "CNDX", "name": "iShares NASDAQ-100 UCITS (CNDX)", "kind": "beta_core", "target_weight": "0.24", "sort_order": 1},
    {"code": "VVSM", "name": "VanEck Semiconductors UCITS (VVSM)", "kind": "tilt", "target_weight": "0.11", "sort_order": 2},
    {"code": "RAW", "name": "RAW K=20 discretionary equity", "kind": "discretionary_equity", "target_weight": "0.45", "sort_order": 3},
    {"code": "CA", "name": "Cross-asset insurance", "kind": "cross_asset_insurance", "target_weight": "0.10", "sort_order": 4},
    {"code": "LOWVOL", "name": "Low-beta carve (BAB)", "kind": "low_vol_carve", "target_weight": "0.10", "sort_order": 5},
]


def seed_sleeves(sleeves: DataFrame, defaults: list[dict[str, Any]] = DEFAULT_SLEEVES) -> tuple[DataFrame, int]:
    """(sleeves with the defaults set, number of new ones). Notes that are there stay; doing it twice adds none."""
    spark, first = sleeves.sparkSession, next_id(sleeves)
    rows = None
    for k, d in enumerate(defaults):
        row = one_row(spark, SLEEVES, d | {"id": first + k})
        rows = row if rows is None else rows.unionByName(row)
    new = rows.join(sleeves, "code", "left_anti").count()
    return upsert(sleeves, rows, "code", keep_old=("notes",)), new


def upsert_holding(holdings: DataFrame, sleeves: DataFrame, *, id: int | None = None, sleeve_code: str | None = None, **h: Any) -> DataFrame:
    """A new holding, or the given settings of an old one; None keeps what is there, the sleeve too.

    A last price without a source is a manual one. ValueError for an unknown sleeve, asset class or source.
    """
    if h.get("sleeve_id") is None and sleeve_code is not None:
        found = sleeves.where(F.col("code") == sleeve_code).select("id").first()
        if found is None:
            raise ValueError(f"unknown sleeve {sleeve_code!r}")
        h["sleeve_id"] = found["id"]
    for c, domain in (("asset_class", ASSET_CLASSES), ("price_source", PRICE_SOURCES)):
        if h.get(c) is not None:
            h[c] = member(h[c], domain, c)
    if h.get("last_price") is not None and h.get("price_source") is None:
        h["price_source"] = "manual"
    for c in ("symbol", "isin", "currency"):
        if h.get(c) is not None:
            h[c] = str(h[c]).strip().upper()
    old = id is not None and holdings.where(F.col("id") == id).limit(1).count() > 0
    values = h if old else {"symbol": "", "asset_class": "equity", "currency": "SEK", "quantity": 0, "avg_price": 0, "price_source": "none"} | {k: v for k, v in h.items() if v is not None}
    return upsert(holdings, one_row(holdings.sparkSession, HOLDINGS, values | {"id": id if old else next_id(holdings)}), "id")
