"""The broker's CSV export: semicolons, decimal commas, headers and types in Swedish or English."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import locale_number

# Fixed values of the format: type texts and column headers, in lower case.
BUY = ("köp", "kop", "buy")
SELL = ("sälj", "salj", "sell")
DEPOSIT = ("insättning", "insattning", "deposit")
WITHDRAWAL = ("uttag", "withdrawal")
HEADERS = {"date": ["Datum"], "type": ["Typ av transaktion"], "label": ["Värdepapper/beskrivning", "Värdepapper"], "flow_label": ["Värdepapper/beskrivning"], "quantity": ["Antal"], "price": ["Kurs"], "amount": ["Belopp"], "fees": ["Courtage"], "fx_rate": ["Valutakurs"], "currency": ["Instrumentvaluta"], "isin": ["ISIN"]}


@dataclass(frozen=True)
class Parsed:
    trades: DataFrame
    flows: DataFrame
    summary: DataFrame  # one row: rows, date_min, date_max, deposits_total, flow_net, n_trades, n_flows


def read(spark: SparkSession, path: str, *, lines_in_cells: bool = True) -> DataFrame:
    """All columns as text; a byte-order mark is dropped and undecodable bytes are replaced.

    lines_in_cells: quoted cells may hold line ends, for which a file must be read in one task; without,
    large files are split.
    """
    return spark.read.csv(path, sep=";", header=True, encoding="UTF-8", multiLine=lines_in_cells, quote='"', escape='"')


def _column(raw: DataFrame, *names: str) -> Column:
    """The first of the named columns, whatever the case and blanks of its header; null if none is there."""
    by = {}
    for c in raw.columns:
        by.setdefault(c.strip().lstrip("﻿").lower(), c)
    found = [F.col(f"`{by[n.lower()]}`") for n in names if n.lower() in by]
    return found[0].cast("string") if found else F.lit(None).cast("string")


def parse(raw: DataFrame, *, exact: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> Parsed:
    """Rows by type. Trades need isin, quantity, price and date, flows a date and an amount; others are left out.

    exact: numbers are decimals, else the doubles nearest to what is written (the same texts count as numbers).
    keep: stores the rows, typed, before they are told apart; what is made of them reads what it returns.
    """
    text = lambda key: F.trim(F.coalesce(_column(raw, *HEADERS[key]), F.lit("")))
    decimal = lambda key: locale_number(_column(raw, *HEADERS[key]))
    number = decimal if exact else lambda key: F.when(decimal(key).isNotNull(), locale_number(_column(raw, *HEADERS[key]), "double"))
    filled = lambda c: F.when(c != "", c)
    day = filled(text("date"))
    rows = raw.select(
        day.alias("day"), day.try_cast("date").alias("date"), F.lower(text("type")).alias("type"), F.upper(text("isin")).alias("isin"), filled(text("label")).alias("name"), filled(text("flow_label")).alias("note"),
        F.coalesce(filled(F.upper(text("currency"))), F.lit("SEK")).alias("currency"), number("quantity").alias("quantity"), number("price").alias("price"), number("amount").alias("amount_sek"),
        F.coalesce(number("fees"), F.lit(0)).alias("fees_sek"), number("fx_rate").alias("fx_rate"),
    )
    kind = F.when(F.col("type").isin(*BUY), "buy").when(F.col("type").isin(*SELL), "sell").when(F.col("type").isin(*DEPOSIT), "deposit").when(F.col("type").isin(*WITHDRAWAL), "withdrawal")
    rows = rows.withColumn("kind", kind) if keep is None else keep(rows.withColumn("kind", kind))
    trades = rows.where("kind in ('buy', 'sell') and isin != '' and quantity is not null and price is not null and date is not null")
    trades = trades.select("date", "isin", "name", "currency", "kind", F.abs("quantity").alias("quantity"), "price", "amount_sek", "fees_sek", "fx_rate")
    flows = rows.where("kind in ('deposit', 'withdrawal') and amount_sek is not null and amount_sek != 0 and date is not null")
    flows = flows.select("date", F.when(F.col("kind") == "deposit", F.abs("amount_sek")).otherwise(-F.abs("amount_sek")).alias("amount_sek"), "kind", "note")
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("date_min"), F.max("day").alias("date_max"))
    money = flows.agg(F.coalesce(F.sum(F.when(F.col("kind") == "deposit", F.col("amount_sek"))), F.lit(0)).alias("deposits_total"), F.coalesce(F.sum("amount_sek"), F.lit(0)).alias("flow_net"), F.count(F.lit(1)).alias("n_flows"))
    summary = whole.crossJoin(F.broadcast(money)).crossJoin(F.broadcast(trades.agg(F.count(F.lit(1)).alias("n_trades"))))  # single rows
    return Parsed(trades, flows, summary)
