"""Streams of the ledger: files of trades taken into the store, and windowed sums of events.

The batch operators remain the definition; a stream applies them to what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.api import Portfolio
from ledgerloom.sources import broker_csv
from ledgerloom.store import Store

HEADER = "Datum string, Konto string, `Typ av transaktion` string, `Värdepapper/beskrivning` string, Antal string, Kurs string, Belopp string, Transaktionsvaluta string, Courtage string, Valutakurs string, Instrumentvaluta string, ISIN string, Resultat string"


def export_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(HEADER).option("sep", ";").option("header", True).option("encoding", "UTF-8").option("maxFilesPerTrigger", 1).csv(folder)


def into_store(exports: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each export, one a micro-batch and the oldest first, is imported as the service does: trades, flows and what is derived
    in one commit. It replaces its span of dates, so a batch that is replayed changes nothing. Ends when all files are read."""
    service = Portfolio(store)

    def take(batch: DataFrame, _: int) -> None:
        service.take(broker_csv.parse(batch))

    return exports.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cash(moves: DataFrame, *, time_col: str = "ts", length: str = "1 day", lateness: str = "10 days") -> DataFrame:
    """Sums of a stream of (ts, units) by tumbling window; rows later than the watermark are left out."""
    return moves.withWatermark(time_col, lateness).groupBy(F.window(time_col, length).alias("w")).agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "units", "n")
