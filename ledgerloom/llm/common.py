"""Helpers shared by the operators: table access, shared-folder tables, text and hash kernels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that bytes.split() cuts at; the contracts' word class is its complement.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows that a Python worker takes at a time.
BATCH = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, one of this machine if Spark runs in one process.

    On a cluster without the setting it raises: executors would write to disks that the others cannot read.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with these values, and afterwards as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df once as a table in the shared folder and read it back.

    Executors may be lost at any later time: the files outlive them, and what was nondeterministic
    (row order, generated keys) is fixed by the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    # Long texts and arrays: what a Python worker holds at a time is a batch.
    with settings(spark, {rows: str(min(now, BATCH) if now > 0 else BATCH)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() would also change other scripts."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salted_rank(df: DataFrame, group: list[str], order: list[Column], salts: int, out: str, salt_on: Column) -> DataFrame:
    """Gapless rank from 0 within each group, without ever holding a group in one task.

    Rows are dealt to `salts` pieces of their group by salt_on; a row's rank is its number in its piece
    plus the sizes of the pieces before. Only the table of piece sizes (groups x salts rows) is
    windowed by group.
    """
    from pyspark.sql import Window as W

    dealt = df.withColumn("_salt", F.pmod(salt_on, F.lit(salts)).cast("int"))
    sizes = dealt.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*group, "_salt").orderBy(*order)
    numbered = dealt.withColumn("_rn", F.row_number().over(within))
    return numbered.join(offsets, [*group, "_salt"]).withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_salt", "_rn", "_before")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def slices(batch, rows: int = 250):
    """An Arrow batch in pieces, so that only a piece of its texts is held as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
