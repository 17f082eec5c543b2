"""The average-cost fold of a trade ledger, running quantities, and derived holdings.

The fold is a true ordered recurrence (sells are clamped at what is held, and a sell from nothing leaves a
negative quantity), so no window expresses it. It runs as one pass over rows that are dealt by isin and
sorted within partitions: the state of one instrument is carried along, so memory is one Arrow batch
however long an instrument's history is, and the sort spills to disk. An instrument of more than LONG trades is
folded in pieces side by side.

Numbers are decimals, in which sums are exact, unless the ledger is normalized with exact=False: then they are doubles, added up
one trade after another, bit for bit as SQL over tables of doubles does it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.schemas import MONEY, PRICE, QTY
from ledgerloom.stored import written

#: Quantities and costs are decimals throughout: sums are exact, and quotients have 28 digits.
STATE = "isin string, id bigint, date date, quantity decimal(28,8), cost_ccy decimal(38,16), cost_sek decimal(38,16), acquired_at date, name string, currency string"
#: The same over doubles.
STATE_DOUBLES = "isin string, id bigint, date date, quantity double, cost_ccy double, cost_sek double, acquired_at date, name string, currency string"
_NAMES = ["isin", "id", "date", "quantity", "cost_ccy", "cost_sek", "acquired_at", "name", "currency"]


def normalized(trades: DataFrame, *, exact: bool = True) -> DataFrame:
    """isin and currency upper-cased, kind lower-cased, missing numbers zero; rows without isin are dropped.

    Columns a ledger may lack (id, name, amount_sek, ...) are added as null. exact: quantities and amounts are decimals, else doubles.
    """
    qty, unit, money = (QTY, PRICE, MONEY) if exact else ("double",) * 3
    have = set(trades.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return trades.select(
        F.coalesce(col("id", "bigint"), F.lit(0)).alias("id"), col("date", "date").alias("date"), X.norm_isin(col("isin", "string")).alias("isin"), col("symbol", "string").alias("symbol"),
        col("name", "string").alias("name"), X.norm_currency(col("currency", "string")).alias("currency"), F.lower(col("kind", "string")).alias("kind"),
        F.coalesce(col("quantity", qty), F.lit(0)).cast(qty).alias("quantity"), F.coalesce(col("price", unit), F.lit(0)).cast(unit).alias("price"), col("amount_sek", money).alias("amount_sek"),
        F.coalesce(col("fees_sek", "double"), F.lit(0.0)).alias("fees_sek"), col("fx_rate", "double").alias("fx_rate"), col("source", "string").alias("source"), col("note", "string").alias("note"),
    ).where("isin != ''")


def is_exact(trades: DataFrame) -> bool:
    return dict(trades.dtypes)["quantity"] != "double"


def _fold(trades: DataFrame, emit: str, long: int) -> DataFrame:
    """States after each trade ('each'), each instrument's day ('day') or its last trade ('last'). Order: date (missing first), id.

    Instruments of more than `long` trades, of which there are few, are folded in pieces (operators.segments).
    """
    rows = trades.select("isin", "date", "id", "kind", "quantity", "price", "amount_sek", "name", "currency")
    counts = rows.groupBy("isin").count().where(F.col("count") > long).select("isin")
    hot = [r["isin"] for r in counts.limit(FEW + 1).collect()]
    if not hot:
        return _one_pass(rows, emit)
    from ledgerloom.operators.segments import fold_in_pieces

    if len(hot) > FEW:  # too many for a list in the plan
        counts = written(counts, "fold-hot")
        cold, warm = rows.join(counts, "isin", "left_anti"), rows.join(counts, "isin", "left_semi")
    else:
        is_hot = F.col("isin").isin(hot)
        cold, warm = rows.where(~is_hot), rows.where(is_hot)
    return _one_pass(cold, emit).unionByName(fold_in_pieces(warm, emit, max(1, long // 4)))


def _one_pass(rows: DataFrame, emit: str) -> DataFrame:
    dealt = rows.repartition("isin").sortWithinPartitions("isin", F.col("date").asc_nulls_first(), "id")
    exact = is_exact(rows)

    return dealt.mapInArrow(lambda batches: _run(batches, emit, exact), STATE if exact else STATE_DOUBLES)


def _run(batches: Iterator[pa.RecordBatch], emit: str, exact: bool) -> Iterator[pa.RecordBatch]:
    """Fold.take of each row, with the state in local variables, as Python calls cost more than the sums."""
    isin, zero = None, Decimal(0) if exact else 0.0
    for b in batches:
        out = []
        for i, date, row_id, kind, x, price, amount, n, cur in zip(*as_lists(b), strict=True):
            if i != isin:
                if isin is not None and emit != "each":
                    out.append((isin, at, day, q, c, s, since, name, currency))
                isin, q, c, s, since, name, currency = i, zero, zero, zero, None, None, None
            elif emit == "day" and date != day:
                out.append((i, at, day, q, c, s, since, name, currency))
            if kind == "buy":
                q += x
                c += x * price
                s += x * price if amount is None else abs(amount)
                if date is not None and (since is None or date < since):
                    since = date
            elif q > 0:
                if x < q:
                    c -= c / q * x
                    s -= s / q * x
                    q -= x
                else:
                    c -= c / q * q
                    s -= s / q * q
                    q = zero
            else:
                q -= x
            at, day, name, currency = row_id, date, name or n or None, cur or currency
            if emit == "each":
                out.append((i, at, day, q, c, s, since, name, currency))
        if out:
            yield _batch(out, exact)
    if isin is not None and emit != "each":
        yield _batch([(isin, at, day, q, c, s, since, name, currency)], exact)


class Fold:
    """One instrument's state: what is held, what it cost in its currency and in SEK, its first buy, first name and last currency."""

    __slots__ = ("id", "date", "q", "c", "s", "since", "name", "currency")

    def __init__(self, q: Decimal = Decimal(0), c: Decimal = Decimal(0), s: Decimal = Decimal(0), since=None, name=None, currency=None):
        self.id = self.date = None
        self.q, self.c, self.s, self.since, self.name, self.currency = q, c, s, since, name, currency

    @classmethod
    def empty(cls, exact: bool) -> Fold:
        return cls() if exact else cls(0.0, 0.0, 0.0)

    def take(self, date, row_id, kind, x, price, amount, name, currency) -> None:
        """A sell takes at most what is held, at average cost; a sell from nothing leaves a negative quantity."""
        q = self.q
        if kind == "buy":
            self.q = q + x
            self.c += x * price
            self.s += x * price if amount is None else abs(amount)
            if date is not None and (self.since is None or date < self.since):
                self.since = date
        elif q > 0:
            r = min(x, q)
            self.c -= self.c / q * r
            self.s -= self.s / q * r
            self.q = q - r
        else:
            self.q = q - x
        self.name, self.currency, self.date, self.id = self.name or name or None, currency or self.currency, date, row_id

    def state(self) -> tuple:
        return self.id, self.date, self.q, self.c, self.s, self.since, self.name, self.currency


def as_lists(batch: pa.RecordBatch) -> list[list]:
    """The columns as lists of Python objects, None where null; to_pylist makes them one scalar at a time, some eight times slower."""
    return [_as_list(c) for c in batch.columns]


def _as_list(c: pa.Array) -> list:
    if not c.null_count or not (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
        return c.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(c.type):  # numpy has no null integers
        return c.to_pylist()
    out = c.to_numpy(zero_copy_only=False).astype(object)  # nor null doubles: they would be NaN
    out[c.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def _batch(rows: list[tuple], exact: bool = True) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.date32(), pa.decimal128(28, 8), pa.decimal128(38, 16), pa.decimal128(38, 16), pa.date32(), pa.string(), pa.string()]
    if not exact:
        kinds[3:6] = [pa.float64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)
    places = {3: Decimal(1).scaleb(-8), 4: Decimal(1).scaleb(-16), 5: Decimal(1).scaleb(-16)}
    with localcontext(prec=38):
        cols = [[x.quantize(places[j]) for x in c] if j in places else list(c) for j, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_NAMES)


#: Trades of one instrument up to which its history is folded in one task.
LONG = 1_000_000
#: Instruments up to which those with long histories are listed in the plan; more are joined.
FEW = 1000


def states(trades: DataFrame, *, long: int = LONG) -> DataFrame:
    """One state per trade of a normalized ledger: quantity, cost in the instrument's currency and in SEK."""
    return _fold(trades, "each", long)


def positions(trades: DataFrame, *, through: str | None = None, long: int = LONG) -> DataFrame:
    """Open positions: isin, quantity, avg_price, cost_sek, acquired_at (the first buy ever), name, currency."""
    rows = trades if through is None else trades.where(F.col("date") <= F.lit(through).cast("date"))
    last = _fold(rows, "last", long).where("quantity > 0")
    cost, quantity = (F.col("cost_ccy").cast("decimal(32,14)"), F.col("quantity").cast("decimal(24,8)")) if is_exact(rows) else (F.col("cost_ccy"), F.col("quantity"))
    return last.select("isin", "quantity", (cost / quantity).alias("avg_price"), "cost_sek", "acquired_at", "name", "currency")


def end_of_day(trades: DataFrame, *, long: int = LONG) -> DataFrame:
    """(isin, date, quantity, cost_ccy, cost_sek, currency): the state after the last trade of each day of an instrument; the others never leave the fold."""
    return _fold(trades, "day", long).where("date is not null").select("isin", "date", "quantity", "cost_ccy", "cost_sek", "currency")


def position_history(trades: DataFrame, isin: str | None = None) -> DataFrame:
    """Trades with the running quantity, which is not clamped (and so may differ from the fold's)."""
    rows = trades if isin is None else trades.where(F.col("isin") == isin.strip().upper())
    w = W.partitionBy("isin").orderBy("date", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("running_qty", F.sum(X.signed(F.col("kind"), F.col("quantity"))).over(w))


def recompute_holdings(holdings: DataFrame, trades: DataFrame, isins: list[str] | None = None) -> DataFrame:
    """Holdings with quantity, average price, cost, currency and first buy taken from the ledger.

    Of several holdings with an isin, the first (by sleeve, symbol, id) is the derived one. Positions without
    a holding are added with an empty symbol; holdings without a position fall to zero, but keep price and date.
    isins: only these are touched.
    """
    names = holdings.columns
    scope = None if isins is None else [i.strip().upper() for i in isins]
    pos = positions(trades if scope is None else trades.where(F.col("isin").isin(scope)))
    # Holdings without an isin are never derived; they are not numbered, as they would all meet in one task.
    first = W.partitionBy("_key").orderBy(F.col("sleeve_id").asc_nulls_last(), "symbol", "id")
    keyed = holdings.withColumn("_key", F.upper(F.coalesce("isin", F.lit(""))))
    named = keyed.where("_key != ''").withColumn("_first", F.row_number().over(first) == 1)
    keyed = named.unionByName(keyed.where("_key = ''").withColumn("_first", F.lit(False)))
    p = pos.select(F.col("isin").alias("_key"), *[F.col(c).alias(f"p_{c}") for c in ("quantity", "avg_price", "cost_sek", "acquired_at", "name", "currency")])
    both = keyed.join(p, "_key", "full_outer")
    in_scope = (F.col("_key") != "") & (F.lit(True) if scope is None else F.col("_key").isin(scope))
    derived = F.col("p_quantity").isNotNull() & (F.col("_first") | F.col("_first").isNull())
    closed = in_scope & F.col("p_quantity").isNull()
    new = {
        "isin": F.when(F.col("_first").isNull(), F.col("_key")).otherwise(F.col("isin")),
        "symbol": F.when(F.col("_first").isNull(), F.lit("")).otherwise(F.col("symbol")),
        "name": F.when(derived & (F.coalesce("name", F.lit("")) == ""), F.col("p_name")).otherwise(F.col("name")),
        "currency": F.when(derived, F.col("p_currency")).otherwise(F.col("currency")),
        "quantity": F.when(derived, F.col("p_quantity")).when(closed, F.lit(0.0)).otherwise(F.col("quantity")),
        "avg_price": F.when(derived, F.col("p_avg_price")).otherwise(F.col("avg_price")),
        "cost_basis_sek": F.when(derived, F.col("p_cost_sek")).when(closed, F.lit(0.0)).otherwise(F.col("cost_basis_sek")),
        "acquired_at": F.when(derived, F.col("p_acquired_at")).otherwise(F.col("acquired_at")),
    }
    kinds = dict(holdings.dtypes)
    return both.select(*[(new[c].cast(kinds[c]) if c in new else F.col(c)).alias(c) for c in names])
