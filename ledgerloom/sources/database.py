"""Tables of a database over JDBC: read in parallel by ranges of a column, replaced in one transaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, url: str, table: str, *, split_by: str | None = None, parts: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table, or a query in parentheses with an alias; filters and column choices on it go to the database.

    split_by: a column of numbers or dates; its least and greatest value, asked for first, bound `parts` ranges that are read by a
    task each. Rows with a null there are read with the first range.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    if split_by is None:
        return reader.option("dbtable", table).load()
    lo, hi = reader.option("dbtable", table).load().agg(F.min(split_by).alias("lo"), F.max(split_by).alias("hi")).first()
    if lo is None:
        return reader.option("dbtable", table).load()
    return reader.option("dbtable", table).option("partitionColumn", split_by).option("lowerBound", str(lo)).option("upperBound", str(hi)).option("numPartitions", parts).load()


def replace(df: DataFrame, url: str, table: str, *, types: str | None = None, parts: int = 8, batch: int = 10_000, **options: str) -> None:
    """df as the rows of a table, which is made if it is not there; its readers see the old rows or the new ones.

    Tasks fill a table beside it, `batch` rows a round trip; when all are done, one transaction empties the table and
    copies them over within the database. A job that fails leaves the table as it was. types: column types where the defaults do not do.
    """
    beside = f"{table}_{uuid.uuid4().hex[:12]}"
    writer = df.coalesce(parts).write.format("jdbc").option("url", url).option("batchsize", batch).options(**options)
    writer = writer.option("createTableColumnTypes", types) if types else writer
    jvm = df.sparkSession._jvm
    names = ", ".join(f'"{c}"' for c in df.columns)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        writer.option("dbtable", beside).mode("errorifexists").save()
        if not connection.getMetaData().getTables(None, None, table.upper(), None).next():
            (df.limit(0).write.format("jdbc").option("url", url).options(**options).option("dbtable", table).options(**({"createTableColumnTypes": types} if types else {}))).save()
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            statement.executeUpdate(f"DELETE FROM {table}")
            statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {beside}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.setAutoCommit(True)
    finally:
        try:
            connection.createStatement().executeUpdate(f"DROP TABLE {beside}")
        except Exception:  # it was never made
            pass
        connection.close()
