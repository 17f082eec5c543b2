"""Positions kept up to date by a stream of trades that may come in any order.

Each instrument's state is its trades, packed in pieces of its history, and the average-cost state at the start of every piece. New
trades go into their pieces; from the earliest piece they reach, the later ones are folded again, each from the end of the one before.
Trades that come in order so cost the newest piece alone, which is kept with the rest of the state and read and written in one
call each, and a late one what comes after it. The batch fold defines the result.

Trades are packed before they meet the state: buffers of them are sorted by instrument, so that Python handles runs of trades, not rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date as Date
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.ledger import Fold, is_exact
from ledgerloom.operators.segments import _dump, _fill
from ledgerloom.schemas import MONEY, PRICE, QTY

LIVE = "isin string, date date, id bigint, quantity decimal(28,8), cost_ccy decimal(38,16), cost_sek decimal(38,16), acquired_at date, n_trades bigint, n_late bigint"
#: The same over doubles.
LIVE_DOUBLES = "isin string, date date, id bigint, quantity double, cost_ccy double, cost_sek double, acquired_at date, n_trades bigint, n_late bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: A packed trade: its day since 1970 (NO_DAY without one, which comes first), whether it is a buy (1) and has an amount (2), and its numbers; decimals are whole units of 128 bits.
_ROW = [("day", "<i4"), ("id", "<i8"), ("flags", "i1")]
NUMBERS = ["quantity", "price", "amount_sek"]
PACKED = {True: np.dtype(_ROW + [(c, "V16") for c in NUMBERS]), False: np.dtype(_ROW + [(c, "<f8") for c in NUMBERS])}
#: The pieces before the newest: the first one's day and number of trades each.
INDEX = np.dtype([("day", "<i4"), ("n", "<i8")])
NO_DAY, EPOCH = -(2**31), Date(1970, 1, 1).toordinal()
#: Trades of a piece (the newest has up to twice as many); trades that are sorted and packed at a time.
PIECE, BUFFER = 1000, 500_000


def _packed(trades: DataFrame, exact: bool) -> DataFrame:
    """(isin, trades): runs of packed trades of an instrument, one a buffer. Names and currencies are no part of the live state."""
    kinds = (QTY, PRICE, MONEY) if exact else ("double",) * 3
    flags = F.when(F.col("kind") == "buy", 1).otherwise(0) + F.when(F.col("amount_sek").isNotNull(), 2).otherwise(0)
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    rows = trades.select("isin", F.coalesce(F.unix_date("date"), F.lit(NO_DAY)).alias("day"), zero("id", "bigint"), flags.cast("tinyint").alias("flags"), *[zero(c, kind) for c, kind in zip(NUMBERS, kinds, strict=True)])
    return rows.repartition("isin").mapInArrow(lambda batches: _runs(batches, exact), "isin string, trades binary")


def _runs(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BUFFER:
            yield _sorted_runs(held, n, exact)
            held, n = [], 0
    if n:
        yield _sorted_runs(held, n, exact)


def _sorted_runs(batches: list[pa.RecordBatch], n: int, exact: bool) -> pa.RecordBatch:
    rows, at = np.empty(n, PACKED[exact]), 0
    for b in batches:
        here = rows[at : at + b.num_rows]
        for c in rows.dtype.names:
            column = b.column(c)
            plain = not exact or c not in NUMBERS
            here[c] = column.to_numpy() if plain else np.frombuffer(column.buffers()[1], "V16", len(column), column.offset * 16)
        at += b.num_rows
    isins = pa.chunked_array([b.column("isin") for b in batches]).combine_chunks().dictionary_encode()
    code = isins.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    ends = np.append(starts, n) * rows.dtype.itemsize
    trades = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(rows[order].tobytes())])
    return pa.RecordBatch.from_arrays([isins.dictionary.take(pa.array(code[starts])), trades], names=["isin", "trades"])


def _follow(fold: Fold, rows: np.ndarray, exact: bool) -> None:
    """Fold.take of each packed trade."""
    if not len(rows):
        return
    buy, booked = (rows["flags"] & 1).astype(bool), (rows["flags"] & 2).astype(bool)
    if exact:
        x, price, amount = ([Decimal(int.from_bytes(v.tobytes(), "little", signed=True)).scaleb(-kind.scale) for v in rows[c]] for c, kind in zip(NUMBERS, (QTY, PRICE, MONEY), strict=True))
        cost = [a * b for a, b in zip(x, price, strict=True)]
        paid = [abs(a) if b else c for a, b, c in zip(amount, booked.tolist(), cost, strict=True)]
    else:
        x, cost = rows["quantity"].tolist(), rows["quantity"] * rows["price"]
        cost, paid = cost.tolist(), np.where(booked, np.abs(rows["amount_sek"]), cost).tolist()
    q, c, s = fold.q, fold.c, fold.s
    for is_buy, x_, cost_, paid_ in zip(buy.tolist(), x, cost, paid, strict=True):
        if is_buy:
            q += x_
            c += cost_
            s += paid_
        elif q > 0:
            r = min(x_, q)
            c -= c / q * r
            s -= s / q * r
            q -= r
        else:
            q -= x_
    date = lambda day: None if day == NO_DAY else Date.fromordinal(EPOCH + int(day))
    bought = rows["day"][buy & (rows["day"] != NO_DAY)]
    if len(bought):
        fold.since = min(d for d in (fold.since, date(bought.min())) if d is not None)
    fold.q, fold.c, fold.s, fold.date, fold.id = q, c, s, date(rows["day"][-1]), int(rows["id"][-1])


class Replay(StatefulProcessor):
    """State: the newest piece, the index of those before it and these by number; of each the fold's state at its start and its trades.

    settled: trades of pieces that can no longer change and are not kept; first: the number of the first piece kept.
    """

    def __init__(self, lateness_days: int | None, exact: bool = True):
        self.lateness, self.exact = lateness_days, exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "n_late long, newest int, settled long, first long, index binary, start string, trades binary")
        self.pieces = handle.getMapState("pieces", "piece long", "start string, trades binary")

    def _closed(self, newest: int) -> int:
        """The first day of the months that can still change."""
        if self.lateness is None or newest == NO_DAY:
            return NO_DAY
        return Date.fromordinal(EPOCH + newest - self.lateness).replace(day=1).toordinal() - EPOCH

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kind = PACKED[self.exact]
        unpacked = lambda b: np.frombuffer(b, kind)
        n_late, newest, settled, first, index, start, trades = self.head.get() or (0, NO_DAY, 0, 0, b"", "", b"")
        fresh = unpacked(b"".join(r["trades"] for r in rows))
        kept = fresh["day"] >= self._closed(newest)
        n_late, fresh = n_late + int((~kept).sum()), fresh[kept]
        newest = max(newest, int(fresh["day"].max(initial=NO_DAY)))
        index, parts = np.frombuffer(index, INDEX), [unpacked(trades)]
        k = old = len(index)
        if len(fresh) and old:  # the last piece that begins before the first new trade's day
            begin = np.append(index["day"], parts[0]["day"][0])
            k = max(int(np.searchsorted(begin, fresh["day"].min())) - 1, 0)
            earlier = [self.pieces.getValue((first + j,)) for j in range(k, old)]
            if earlier:
                start, parts = earlier[0][0], [unpacked(p[1]) for p in earlier] + parts
        all_ = np.concatenate([*parts, fresh])
        all_ = all_[np.lexsort((all_["id"], all_["day"]))]
        fold, at, made = _fill(Fold(), json.loads(start), float if not self.exact else Decimal) if start else Fold.empty(self.exact), 0, []
        while len(all_) - at > 2 * PIECE:
            piece = all_[at : at + PIECE]
            self.pieces.updateValue((first + k + len(made),), (_dump(fold), piece.tobytes()))
            made.append((piece["day"][0], PIECE))
            _follow(fold, piece, self.exact)
            at += PIECE
        start, last = _dump(fold), all_[at:]
        _follow(fold, last, self.exact)
        index = np.concatenate([index[:k], np.array(made, INDEX)])
        total = settled + int(index["n"].sum()) + len(last)
        # Pieces are settled if the one after them begins before the days that can still change.
        gone = int(np.searchsorted(np.append(index["day"], last["day"][:1])[1:], self._closed(newest)))
        for j in range(gone):
            self.pieces.removeKey((first + j,))
        self.head.update((n_late, newest, settled + int(index["n"][:gone].sum()), first + gone, index[gone:].tobytes(), start, last.tobytes()))
        q, c, s = fold.q, fold.c, fold.s
        if self.exact:
            places = [Decimal(1).scaleb(-8), Decimal(1).scaleb(-16), Decimal(1).scaleb(-16)]
            with localcontext(prec=38):
                q, c, s = (x.quantize(p) for x, p in zip((q, c, s), places, strict=True))
        yield Row(isin=key[0], date=fold.date, id=fold.id, quantity=q, cost_ccy=c, cost_sek=s, acquired_at=fold.since, n_trades=total, n_late=n_late)

    def close(self) -> None:
        pass


def live_positions(trades: DataFrame, *, lateness_days: int | None = None) -> DataFrame:
    """The state of each instrument after each micro-batch that has trades of it, from a stream of a normalized ledger.

    n_trades: the trades counted. lateness_days: trades of months wholly further back than so many days before the newest one are not
    counted but reported in n_late, and the state keeps only pieces that can still change; None counts every trade, however late.
    """
    exact = is_exact(trades)
    return _packed(trades, exact).groupBy("isin").transformWithState(Replay(lateness_days, exact), LIVE if exact else LIVE_DOUBLES, "Update", "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, on local disk with changes in the checkpoint, which this state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def keep_positions(trades: DataFrame, folder: str, checkpoint: str, *, lateness_days: int | None = None) -> None:
    """Run the stream over all that is there; each micro-batch's states are a folder of `folder`, so one that is run again replaces its own."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    with state_store(trades.sparkSession):
        live_positions(trades, lateness_days=lateness_days).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each instrument from keep_positions."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("isin").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("isin", "batch")]), "batch").alias("s")).select("isin", "s.*")
