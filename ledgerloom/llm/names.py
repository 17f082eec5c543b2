"""Names for keys: dense numbers, and joins with a table of one row a key that no hot key can stall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

#: A key with at least one in so many of all rows is hot; there are at most so many hot keys.
HOT = 1000


def dense(keys: DataFrame, tag: str) -> DataFrame:
    """keys, stored, with `name`: 0, 1, ... without gaps, in no particular order.

    A row's name is its number in its partition plus the sizes of the partitions before: the window and the
    broadcast hold one row a partition, whatever the number of keys.
    """
    rows = materialize(keys.withColumn("_row", F.monotonically_increasing_id()), tag).withColumn("_part", F.shiftright("_row", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.broadcast(sizes.select("_part", before.alias("_before")))
    return rows.join(at, "_part").withColumn("name", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_before")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of rows with a table of one row a key, however many rows share a key.

    count: the table's column with the number of rows of each key. As the counts add up to the number of rows, at most
    HOT keys have a HOT-th of them or more: those are broadcast, and the others meet in a join by key. A
    table of no more than HOT keys is broadcast whole. Both tables are read several times, so they should be stored ones.
    """
    values = [c for c in table.columns if c not in keys]
    size = table.agg(F.count(F.lit(1)).alias("keys"), F.sum(count).alias("rows")).first()
    if size["keys"] <= HOT:
        return rows.join(F.broadcast(table), keys).select(*rows.columns, *values)
    hot = F.col(count) * HOT >= F.lit(size["rows"])
    told = rows.join(F.broadcast(table.where(hot).withColumn("_hot", F.lit(True))), keys, "left")
    known = told.where("_hot").select(*rows.columns, *values)
    rest = told.where("_hot is null").select(*rows.columns).join(table.where(~hot), keys)
    return known.unionByName(rest.select(*rows.columns, *values))


def spread(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, count: str) -> DataFrame:
    """As attach, where the table's rows may be large: none of them is broadcast.

    counts: a stored table of keys and, in the column `count`, their rows. The rows of a hot key are dealt to as
    many pieces as it has HOT-ths of all rows, and its row of the table is copied to each. Only the hot keys and
    their numbers of pieces are broadcast (at most HOT rows); copies are at most HOT more than the keys.
    """
    total = counts.agg(F.sum(count)).first()[0]
    if not total:
        return rows.join(table, keys)
    pieces = F.least(F.ceil(F.col(count) * HOT / F.lit(total)), F.col(count)).cast("int")
    hot = F.broadcast(counts.where(F.col(count) * HOT > F.lit(total)).select(*keys, pieces.alias("_ld_pieces")))
    at = F.pmod(F.monotonically_increasing_id(), F.coalesce("_ld_pieces", F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_ld_piece", at).drop("_ld_pieces")
    copies = table.join(hot, keys, "left").withColumn("_ld_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_ld_pieces", F.lit(1)) - 1))).drop("_ld_pieces")
    return dealt.join(copies, [*keys, "_ld_piece"]).drop("_ld_piece")
