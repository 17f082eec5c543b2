import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(text):
    return dt.date.fromisoformat(text)


TRADES = "id bigint, date date, isin string, symbol string, name string, currency string, kind string, quantity double, price double, amount_sek double, fees_sek double, source string"
HOLDINGS = "id bigint, sleeve_id bigint, symbol string, isin string, name string, asset_class string, currency string, quantity double, avg_price double, cost_basis_sek double, acquired_at date, last_price double, last_price_date date, price_source string, as_of date, notes string"
CLOSES = "date date, ticker string, close double"
FLOWS = "id bigint, date date, amount_sek double, kind string, source string, note string"


@pytest.fixture
def make(spark):
    """Small tables: make.trades((id, date, isin, kind, quantity, price, more...)) and so on."""

    class Make:
        def trades(self, *rows, **common):
            out = []
            for i, d, isin, kind, q, p, *more in rows:
                x = {"currency": "SEK", "amount_sek": None, "fees_sek": 0.0, "symbol": None, "name": None, "source": "manual"} | common | (more[0] if more else {})
                out.append((i, day(d) if d else None, isin, x["symbol"], x["name"], x["currency"], kind, float(q), float(p), x["amount_sek"], x["fees_sek"], x["source"]))
            return spark.createDataFrame(out, TRADES)

        def holdings(self, *rows):
            base = dict.fromkeys([c.split()[0] for c in HOLDINGS.split(", ")]) | {"symbol": "", "currency": "SEK", "asset_class": "equity", "quantity": 0.0, "avg_price": 0.0, "price_source": "none"}
            return spark.createDataFrame([tuple((base | r).values()) for r in rows], HOLDINGS)

        def closes(self, *rows):
            return spark.createDataFrame([(day(d), t, float(c)) for d, t, c in rows], CLOSES)

        def flows(self, *rows):
            return spark.createDataFrame([(i, day(d), float(a), k, "manual", None) for i, d, a, k in rows], FLOWS)

    return Make()
