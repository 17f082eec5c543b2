"""Exchange rates and quotes: parsers of the public formats, and refreshes with injected providers."""

from __future__ import annotations

import json
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import Config

Fetch = Callable[[str], bytes]
#: Series of the central bank's JSON service, and the XML of the euro reference rates (fixed values).
SERIES = {"USD": "SEKUSDPMI", "EUR": "SEKEURPMI"}
JSON_URL = "https://api.riksbank.se/swea/v1/Observations/Latest/{series}"
XML_URL = "https://www.ecb.europa.eu/stats/eurofxref/eurofxref-daily.xml"


def http_get(url: str, timeout: float = 8.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def from_json(fetch: Fetch) -> dict[str, Any] | None:
    """Both rates from the JSON service; None on any failure."""
    try:
        got = {c: json.loads(fetch(JSON_URL.format(series=s))) for c, s in SERIES.items()}
        return {"rates": {c: float(x["value"]) for c, x in got.items()}, "date": next((x["date"] for x in reversed(got.values()) if x.get("date")), None), "source": "riksbank"}
    except Exception:  # any failure means the next source
        return None


def from_xml(fetch: Fetch) -> dict[str, Any] | None:
    """SEK for a euro, and for a dollar by way of dollars for a euro; None on any failure."""
    try:
        cubes = [e.attrib for e in ET.fromstring(fetch(XML_URL)).iter() if e.tag.rpartition("}")[2] == "Cube"]
        per_euro = {c["currency"]: float(c["rate"]) for c in cubes if "currency" in c}
        day = next((c["time"] for c in cubes if "time" in c), None)
        return {"rates": {"USD": per_euro["SEK"] / per_euro["USD"], "EUR": per_euro["SEK"]}, "date": day, "source": "ecb"}
    except Exception:  # any failure means no rates
        return None


def fetch_rates(fetch: Fetch = http_get) -> dict[str, Any] | None:
    return from_json(fetch) or from_xml(fetch)


def parsed_rates(json_usd: Column, json_eur: Column, xml: Column) -> Column:
    """struct(usd_sek, eur_sek, as_of, source) from one day's documents, as expressions: what fetch_rates gives for the same bodies.

    The JSON answers count if both have a value, else the XML if it has both rates; null if neither can be read. Malformed
    bodies are no error.
    """
    number = lambda c: c.try_cast("double")
    one = [F.from_json(c, "date string, value string") for c in (json_usd, json_eur)]
    day = F.coalesce(one[1]["date"], one[0]["date"])
    first = F.when(F.nvl2(number(one[0]["value"]), number(one[1]["value"]), F.lit(None)).isNotNull(), F.struct(number(one[0]["value"]).alias("usd_sek"), number(one[1]["value"]).alias("eur_sek"), day.alias("as_of"), F.lit("riksbank").alias("source")))
    cubes = F.from_xml(xml, "Cube struct<Cube: struct<_time: string, Cube: array<struct<_currency: string, _rate: string>>>>", {"ignoreNamespace": "true"})["Cube"]["Cube"]
    rate = lambda c: number(F.element_at(F.map_from_entries(F.filter(cubes["Cube"], lambda x: x["_currency"] == c)), F.lit(c)))
    usd, eur = rate("SEK") / rate("USD"), rate("SEK")
    second = F.when(usd.isNotNull(), F.struct(usd.alias("usd_sek"), eur.alias("eur_sek"), cubes["_time"].alias("as_of"), F.lit("ecb").alias("source")))
    return F.coalesce(first, second)


def refresh_fx(cfg: Config, fetch: Fetch = http_get) -> tuple[Config, dict[str, Any]]:
    """(config with the newest rates, report). On failure the rates stay, and the report says so; nothing is raised."""
    got = fetch_rates(fetch)
    report = lambda c, **x: {**x, "usd_sek": c.fx_usd_sek, "eur_sek": c.fx_eur_sek, "as_of": c.fx_as_of.isoformat() if c.fx_as_of else None, "source": c.fx_source}
    if got is None:
        return cfg, report(cfg, ok=False, error="no exchange-rate source could be read; the stored rates are kept")
    try:
        day = date.fromisoformat(got["date"])
    except (TypeError, ValueError):
        day = None
    new = cfg.updated(fx_usd_sek=got["rates"].get("USD"), fx_eur_sek=got["rates"].get("EUR"), fx_as_of=day, fx_source=got["source"])
    return new, report(new, ok=True)


def refresh_prices(holdings: DataFrame, closes: DataFrame | None, quotes: DataFrame | None, today: str) -> DataFrame:
    """holdings with the newest prices: the lake's close of their symbol, or else a quote for symbol or isin.

    closes: (ticker, close, date), of a newest day. quotes: (key, price, currency), keys being symbols or
    isins; prices not above zero are no hit, and a quote's currency becomes the holding's. Either may be
    None. A column outcome says 'minio', 'yfinance', 'skipped' or null (nothing to look up by).
    """
    spark = holdings.sparkSession
    closes = spark.createDataFrame([], "ticker string, close double, date date") if closes is None else closes
    quotes = spark.createDataFrame([], "key string, price double, currency string") if quotes is None else quotes
    hit = quotes.where("price > 0").groupBy(F.upper("key").alias("key")).agg(F.max(F.struct("price", F.upper("currency").alias("currency"))).alias("q"))
    kinds = dict(holdings.dtypes)
    rows = holdings.withColumn("_s", F.upper(F.coalesce("symbol", F.lit("")))).withColumn("_i", F.upper(F.coalesce("isin", F.lit(""))))
    c = closes.select(F.upper("ticker").alias("_s"), F.col("close").alias("_close"), F.col("date").alias("_date"))
    rows = rows.join(c, "_s", "left").join(hit.select(F.col("key").alias("_s"), F.col("q").alias("_qs")), "_s", "left").join(hit.select(F.col("key").alias("_i"), F.col("q").alias("_qi")), "_i", "left")
    quote = F.coalesce("_qs", "_qi")
    lake, quoted = F.col("_close").isNotNull(), F.col("_close").isNull() & quote.isNotNull()
    outcome = F.when(lake, "minio").when(quoted, "yfinance").when((F.col("_s") != "") | (F.col("_i") != ""), "skipped")
    new = {
        "last_price": F.when(lake, F.col("_close")).when(quoted, quote["price"]).otherwise(F.col("last_price").cast("double")),
        "last_price_date": F.when(lake, F.col("_date")).when(quoted, F.lit(today).cast("date")).otherwise(F.col("last_price_date")),
        "price_source": F.when(lake, "minio").when(quoted, "yfinance").otherwise(F.col("price_source")),
        "currency": F.when(quoted & quote["currency"].isNotNull(), quote["currency"]).otherwise(F.col("currency")),
    }
    return rows.select(*[(new[n].cast(kinds[n]) if n in new else F.col(n)).alias(n) for n in holdings.columns], outcome.alias("outcome"))


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    """One row: updated, updated_minio, updated_yfinance, skipped (number and sorted names), as_of of the lake."""
    name = F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.col("isin"))
    return refreshed.agg(
        F.count_if(F.col("outcome").isin("minio", "yfinance")).alias("updated"), F.count_if(F.col("outcome") == "minio").alias("updated_minio"), F.count_if(F.col("outcome") == "yfinance").alias("updated_yfinance"),
        F.count_if(F.col("outcome") == "skipped").alias("n_skipped"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "skipped", name))).alias("skipped"), F.max(F.when(F.col("outcome") == "minio", F.col("last_price_date"))).alias("as_of"),
    )
