"""The average-cost fold of one long history in pieces that are folded side by side.

What a piece of a history does to the quantity held at its start is a rising function of it: buys shift it, and sells shift it too
but for starts that they would take from above zero to below, which end at zero. Costs, once the quantity at the
piece's start is known, become a share of the costs at its start plus a constant. Both kinds of maps compose, so three passes
over the pieces do what one pass over the history would:

1. each piece's map of the quantity; along the pieces (one row each), the quantity at every start;
2. with it, each piece's map of the costs; along the pieces, the whole state at every start;
3. from its start, each piece's states. Without states to emit, the end of the last piece is the result.

The pieces are ranges of the sorted rows, written once. A piece's maps are a few numbers (a breakpoint for each sell that could
have met nothing left), so what runs along an instrument's pieces is small.

Doubles round off after each trade, which no map can tell before the start is known. There each piece is packed into what the
fold needs (some 30 bytes a trade) instead of passes 1 and 2, and one pass along an instrument's packed pieces finds their starts, bit for
bit; sorting, and the states from the starts, are done side by side as well.

How many pieces there are is settled by piece_rows, how many tasks by the rows alone: a task holds many small pieces.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date as Date
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import STATE, STATE_DOUBLES, Fold, _batch, as_lists, is_exact
from ledgerloom.stored import written

TRADE = ["date", "id", "kind", "quantity", "price", "amount_sek", "name", "currency"]
MAPPED = "isin string, piece bigint, map string"
#: Rows of a task that sorts them into pieces; trades in a packed row.
TASK_ROWS, PACK = 100_000, 512
_INF = float("inf")


class QuantityMap:
    """The quantity after some trades as a function of that before, in whole hundred-millionths.

    For starts up to till[k] (and above till[k - 1]) it is base[k] + shift, plus the start where moves[k].
    """

    def __init__(self):
        self.till, self.moves, self.base, self.shift = [_INF], [True], [0], 0

    def _at(self, k: int) -> float:
        """The value at the upper end of a range."""
        return (self.till[k] if self.moves[k] else 0) + self.base[k] + self.shift

    def _highest(self, value: int) -> float:
        """The highest start that ends at `value` or below."""
        low, high = 0, len(self.till) - 1  # the last range rises without end
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self._at(mid) > value else (mid + 1, high)
        below = self.till[low - 1] if low else -_INF
        return max(below, value - self.base[low] - self.shift) if self.moves[low] else below

    def _cut(self, start: float) -> int:
        """The number of ranges up to `start`, which becomes the end of one."""
        k = bisect_left(self.till, start)
        if self.till[k] != start:
            self.till.insert(k, start)
            self.moves.insert(k, self.moves[k])
            self.base.insert(k, self.base[k])
        return k + 1

    def buy(self, x: int) -> None:
        self.shift += x

    def sell(self, x: int) -> None:
        none, all_ = self._highest(0), self._highest(x)  # starts up to `none` hold nothing; up to `all_`, all is sold
        self.shift -= x
        if none < all_:
            first = self._cut(none) if none > -_INF else 0
            last = self._cut(all_)
            self.till[first:last], self.moves[first:last], self.base[first:last] = [all_], [False], [-self.shift]

    def __call__(self, start: int) -> int:
        k = bisect_left(self.till, start)
        return (start if self.moves[k] else 0) + self.base[k] + self.shift

    def dump(self) -> str:
        return json.dumps([self.till[:-1], self.moves, self.base, self.shift])

    @classmethod
    def load(cls, text: str) -> QuantityMap:
        out = cls()
        out.till, out.moves, out.base, out.shift = json.loads(text)
        out.till.append(_INF)
        return out


class CostMap(Fold):
    """The fold from a known quantity and no costs, with the share of the costs before that is left."""

    __slots__ = ("share",)

    def __init__(self, q: Decimal):
        super().__init__(q)
        self.share = Decimal(1)

    def take(self, date, row_id, kind, x, price, amount, name, currency) -> None:
        if kind != "buy" and self.q > 0:
            self.share *= 1 - min(x, self.q) / self.q
        super().take(date, row_id, kind, x, price, amount, name, currency)

    def after(self, f: Fold) -> Fold:
        """The state after this piece, from the one before it."""
        since = min((d for d in (f.since, self.since) if d is not None), default=None)
        out = Fold(self.q, self.share * f.c + self.c, self.share * f.s + self.s, since, f.name or self.name, self.currency or f.currency)
        out.date, out.id = self.date, self.id
        return out


def _dump(f: Fold, *more: str) -> str:
    return json.dumps([str(f.q), str(f.c), str(f.s), f.since and f.since.isoformat(), f.name, f.currency, f.date and f.date.isoformat(), f.id, *more])


def _fill(f: Fold, x: list, number: type = Decimal) -> Fold:
    f.q, f.c, f.s, f.since, f.name, f.currency = number(x[0]), number(x[1]), number(x[2]), x[3] and Date.fromisoformat(x[3]), x[4], x[5]
    f.date, f.id = x[6] and Date.fromisoformat(x[6]), x[7]
    return f


def _mapped(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["isin", "piece", "map"])


def _over_pieces(rows: DataFrame, starts: DataFrame | None, begin, take, end) -> DataFrame:
    """One row (isin, piece, map) a piece: begin(start) makes its map, take(map, trade) follows a trade, end(map) is its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, out = None, None, []
        for key, start, trade in _in_order(batches):
            if key != at:
                if at is not None:
                    out.append((*at, end(now)))
                at, now = key, begin(start)
            if trade is not None:
                take(now, trade)
        if at is not None:
            out.append((*at, end(now)))
        if out:
            yield _mapped(out)

    return _dealt(rows, starts).mapInArrow(run, MAPPED)


def _dealt(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Each piece's trades in order, after a row with its start if there are any."""
    both = rows.select("isin", "piece", F.lit(1).alias("turn"), *TRADE, F.lit(None).cast("string").alias("map"))
    if starts is not None:
        both = both.unionByName(starts.select("isin", "piece", F.lit(0).alias("turn"), *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in TRADE], "map"))
    return both.repartition("isin", "piece").sortWithinPartitions("isin", "piece", "turn", F.col("date").asc_nulls_first(), "id")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str | None, tuple | None]]:
    """(isin and piece, start, trade) of each row: the first of a piece has its start and no trade, if there are starts."""
    for b in batches:
        for isin, piece, turn, *trade, start in zip(*as_lists(b), strict=True):
            yield (isin, piece), start, trade if turn else None


def _along(maps: DataFrame, begin, follow) -> DataFrame:
    """(isin, piece, map): the start of each piece and, as piece -1, the end of the last; maps holds a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isin, now, out = None, None, []
        for b in batches:
            for i, piece, text in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                if i != isin:
                    if isin is not None:
                        out.append((isin, -1, now))
                    isin, now = i, begin
                out.append((i, piece, now))
                now = follow(now, text)
        if isin is not None:
            out.append((isin, -1, now))
        if out:
            yield _mapped(out)

    return maps.repartition("isin").sortWithinPartitions("isin", "piece").mapInArrow(run, MAPPED)


PACKED = "isin string, piece bigint, at bigint, n int, trades string, since date, name string, currency string, date date, id bigint"


def _packed(rows: DataFrame) -> DataFrame:
    """Up to PACK trades of a piece a row, in order: for each its quantity (sells below zero), price and amount."""
    number = np.dtype([("buy", "?"), ("x", "f8"), ("price", "f8"), ("paid", "f8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held = None, 0, []

        def row() -> tuple:
            day, _, kind, x, price, paid, name, currency = zip(*held, strict=True)
            buy = [k == "buy" for k in kind]
            a = np.empty(len(held), number)
            # No amount: the priced one, as the fold has it.
            a["buy"], a["x"], a["price"], a["paid"] = buy, x, price, [abs(m) if m is not None else q * p for q, p, m in zip(x, price, paid, strict=True)]
            since = min((d for d, b in zip(day, buy, strict=True) if b and d is not None), default=None)
            return (*at, n, len(held), base64.b64encode(a.tobytes()).decode(), since, next((c for c in name if c), None), next((c for c in reversed(currency) if c), None), held[-1][0], held[-1][1])

        for b in batches:
            out = []
            for key, _, trade in _in_order([b]):
                if key != at or len(held) == PACK:
                    if held:
                        out.append(row())
                    at, n, held = key, 0 if key != at else n + 1, []
                held.append(trade)
            if out:
                yield _packed_batch(out)
        if held:
            yield _packed_batch([row()])

    return _dealt(rows, None).mapInArrow(run, PACKED)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.date32(), pa.string(), pa.string(), pa.date32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _along_packed(packed: DataFrame) -> DataFrame:
    """What _along gives, from packed trades of doubles."""
    number = np.dtype([("buy", "?"), ("x", "f8"), ("price", "f8"), ("paid", "f8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isin, at, f = None, None, None
        for b in batches:
            out = []
            for i, piece, _, _, trades, since, name, currency, day, row_id in zip(*as_lists(b), strict=True):
                if i != isin:
                    if isin is not None:
                        out.append((isin, -1, _dump(f)))
                    isin, at, f = i, None, Fold.empty(False)
                if piece != at:
                    at = piece
                    out.append((i, piece, _dump(f)))
                q, c, s = f.q, f.c, f.s
                for buy, x, price, paid in np.frombuffer(base64.b64decode(trades), number).tolist():
                    if buy:
                        q += x
                        c += x * price
                        s += paid
                    elif q > 0:
                        r = min(x, q)
                        c -= c / q * r
                        s -= s / q * r
                        q -= r
                    else:
                        q -= x
                f.q, f.c, f.s, f.date, f.id = q, c, s, day, row_id
                f.since = since if f.since is None or (since is not None and since < f.since) else f.since
                f.name, f.currency = f.name or name, currency or f.currency
            if out:
                yield _mapped(out)
        if isin is not None:
            yield _mapped([(isin, -1, _dump(f))])

    return packed.repartition("isin").sortWithinPartitions("isin", "piece", "at").mapInArrow(run, MAPPED)


def _starts_of_doubles(rows: DataFrame) -> DataFrame:
    return _along_packed(_packed(rows))


def _starts_of_decimals(rows: DataFrame) -> DataFrame:
    def move(m: QuantityMap, trade) -> None:
        (m.buy if trade[2] == "buy" else m.sell)(_hundred_millionths(trade[3]))

    quantities = _over_pieces(rows, None, lambda _: QuantityMap(), move, lambda m: m.dump())
    held = written(_along(quantities, "0", lambda q, text: str(QuantityMap.load(text)(int(q)))), "fold-quantities").where("piece >= 0")
    costs = _over_pieces(rows, held, lambda q: CostMap(Decimal(int(q)).scaleb(-8)), lambda m, trade: m.take(*trade), lambda m: _dump(m, str(m.share)))

    def follow(start: str, text: str) -> str:
        x = json.loads(text)
        m = _fill(CostMap(Decimal(0)), x)
        m.share = Decimal(x[8])
        return _dump(m.after(_fill(Fold(), json.loads(start))))

    return _along(costs, _dump(Fold()), follow)


def _hundred_millionths(x: Decimal) -> int:
    return int(x.scaleb(8))


def fold_in_pieces(rows: DataFrame, emit: str, piece_rows: int) -> DataFrame:
    """What ledger._one_pass gives, for instruments of any length: of doubles bit for bit, of decimals costs agree to the last digits that 28 carry."""
    order, exact = [F.col("isin"), F.col("date").asc_nulls_first(), F.col("id")], is_exact(rows)
    parts = -(-rows.count() // TASK_ROWS) or 1
    place = F.monotonically_increasing_id()  # in the high bits the task, below them the row in it
    piece = F.shiftright(place, 33) * (1 << 33) + F.floor(place.bitwiseAND((1 << 33) - 1) / piece_rows)
    rows = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("piece", piece.cast("bigint")), "fold-pieces")
    starts = written(_starts_of_decimals(rows) if exact else _starts_of_doubles(rows), "fold-starts")
    number = Decimal if exact else float

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch([(i, *_fill(Fold(), json.loads(text), number).state()) for i, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], exact)

    if emit == "last":
        return starts.where("piece = -1").mapInArrow(ends, STATE if exact else STATE_DOUBLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, out = None, None, []
        for key, start, trade in _in_order(batches):
            if key != at:
                if at is not None and emit == "day":
                    out.append((at[0], *fold.state()))
                at, fold = key, _fill(Fold(), json.loads(start), number)
                fold.id = None  # no trade of this piece yet
            if trade is None:
                continue
            if emit == "day" and fold.id is not None and trade[0] != fold.date:
                out.append((at[0], *fold.state()))
            fold.take(*trade)
            if emit == "each":
                out.append((at[0], *fold.state()))
            if len(out) >= 10_000:
                yield _batch(out, exact)
                out = []
        if at is not None and emit == "day":
            out.append((at[0], *fold.state()))
        if out:
            yield _batch(out, exact)

    every = _dealt(rows, starts.where("piece >= 0")).mapInArrow(run, STATE if exact else STATE_DOUBLES)
    # A day that spans pieces has a state at the end of each; the last one counts.
    return every if emit == "each" else _last_of_day(every)


def _last_of_day(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c not in ("isin", "date", "id")]
    last = states.groupBy("isin", "date").agg(F.max(F.struct("id", *rest)).alias("s"))
    return last.select("isin", F.col("s.id").alias("id"), "date", *[F.col(f"s.{c}").alias(c) for c in rest])
