"""The ledger in SQL text: views of its tables, and table functions for what SQL has no operator for."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ledgerloom.operators.ledger import Fold

_PLACES = [Decimal(1).scaleb(-8), Decimal(1).scaleb(-16), Decimal(1).scaleb(-16)]


def _state(exact: bool) -> T.StructType:
    """operators.ledger.STATE or STATE_DOUBLES as a type; the process that analyzes a call has no session to parse them."""
    q, c = (T.DecimalType(28, 8), T.DecimalType(38, 16)) if exact else (T.DoubleType(),) * 2
    kinds = {"isin": T.StringType(), "id": T.LongType(), "date": T.DateType(), "quantity": q, "cost_ccy": c, "cost_sek": c, "acquired_at": T.DateType(), "name": T.StringType(), "currency": T.StringType()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


@udtf
class LedgerStates:
    """ledger_states(TABLE(trades) PARTITION BY isin ORDER BY (date, id)): the average-cost state after each trade, in decimals or, of doubles, doubles."""

    def __init__(self, told: AnalyzeResult):
        self.exact = told.schema["quantity"].dataType != T.DoubleType()
        self.fold = Fold.empty(self.exact)

    @staticmethod
    def analyze(t: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_state(t.dataType["quantity"].dataType != T.DoubleType()))

    def eval(self, t: Row):
        self.fold.take(t["date"], t["id"], t["kind"], t["quantity"], t["price"], t["amount_sek"], t["name"], t["currency"])
        row_id, day, q, c, s, since, name, currency = self.fold.state()
        if self.exact:
            with localcontext(prec=38):
                q, c, s = (x.quantize(p) for x, p in zip((q, c, s), _PLACES, strict=True))
        yield t["isin"], row_id, day, q, c, s, since, name, currency


@udtf(returnType="key string, at date, value double")
class AsOf:
    """as_of(TABLE(points) PARTITION BY key ORDER BY (at, is_question)): each question with the latest value at or before it, null if there is none.

    points: key, at, value, is_question; of equal times the values come first.
    """

    def __init__(self):
        self.value = None

    def eval(self, p: Row):
        if p["is_question"]:
            yield p["key"], p["at"], self.value
        else:
            self.value = p["value"]


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """The tables as views of their names (trades is a normalized ledger), and the functions ledger_states and as_of."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    spark.udtf.register("ledger_states", LedgerStates)
    spark.udtf.register("as_of", AsOf)
