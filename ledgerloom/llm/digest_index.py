"""Exact dedup against a persistent index of digests.

The index is a stored table of one row per distinct text, bucketed and sorted by SHA-256 of the text with its white space
normalised. New documents are reduced to their digests, pre-aggregated to one row a digest, dealt
into the index's buckets and sort-merged against it: the anti-join's rows are new and are appended to the same
buckets. The index side is neither shuffled nor read for other columns, and a session that opens the folder later goes on.

Scale: a digest is some 50 bytes whatever the text; a text of a third of all rows is pre-aggregated on the map side, and its
rows get their verdict through names.attach. What is already indexed is never written again; `compact` folds the
files of many additions into one a bucket, with as many buckets as the index needs by then.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.names import attach

SPACES = r"[ \t\n\x0B\f\r]+"
#: Digests that a bucket should hold.
PER_BUCKET = 2_000_000


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, digest), stored: the texts are read once and whole. A null text is the empty one; runs of white space count as one space.

    row: the column row_col, or else a number that tells the rows apart.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    text = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACES, " ")
    return materialize(docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "dedup-digests")


def firsts(rows: DataFrame) -> DataFrame:
    """One row a digest: its smallest id (null last), one of that id's rows, and the number of rows."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("f")
    return rows.groupBy("digest").agg(least, F.count(F.lit(1)).alias("n")).select("digest", F.col("f.doc_id").alias("doc_id"), F.col("f.row").alias("row"), "n")


class DigestIndex:
    """The index under a folder that all executors share; it is opened where it is, or made by the first addition.

    The data are in `<path>/v<number>-of-<buckets>`; the newest finished folder counts, so compaction that fails leaves the old one.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    def _found(self) -> tuple[int, int] | None:
        """(version, buckets) of the newest finished folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        named = [re.fullmatch(r"v(\d+)-of-(\d+)", f.getPath().getName()) for f in fs.listStatus(p)]
        done = [(int(m[1]), int(m[2])) for m in named if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m[0]}/_SUCCESS"))]
        return max(done, default=None)

    def _table(self, version: int, buckets: int) -> str:
        """The name under which the session knows a folder; made known if it is not yet."""
        folder = f"{self.path}/v{version}-of-{buckets}"
        name = f"digest_index_{hashlib.md5(folder.encode()).hexdigest()[:20]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, doc_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")
        return name

    def entries(self) -> DataFrame | None:
        """(digest, doc_id, batch) of every text known; None before the first addition."""
        found = self._found()
        if found is None:
            return None
        name = self._table(*found)
        self.spark.catalog.refreshTable(name)  # others may have added files
        return self.spark.table(name)

    def add(self, rows: DataFrame, batch: str | None = None) -> str:
        """Append what is new among rows (row, doc_id, digest); the batch's name. A batch that is added again adds nothing.

        A digest keeps the id it was indexed with; within a batch that is the smallest one.
        """
        batch = batch or uuid.uuid4().hex
        new = firsts(rows).select("digest", "doc_id", F.lit(batch).alias("batch"))
        found = self._found()
        version, buckets = found or (1, self._buckets or self._wanted(rows.count()))
        dealt = new.repartition(buckets, "digest")
        if found is not None:
            dealt = dealt.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._append(dealt, version, buckets)
        return batch

    def _append(self, rows: DataFrame, version: int, buckets: int) -> None:
        name = self._table(version, buckets)
        rows.write.format("parquet").mode("append").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/v{version}-of-{buckets}").saveAsTable(name)

    @staticmethod
    def _wanted(rows: int) -> int:
        return max(8, min(65536, -(-rows // PER_BUCKET)))

    def compact(self, buckets: int | None = None) -> None:
        """The index anew, one sorted file a bucket; buckets: by the number of digests if not given."""
        now = self.entries()
        if now is not None:
            buckets = buckets or self._wanted(now.count())
            self._append(now.repartition(buckets, "digest"), self._found()[0] + 1, buckets)

    def verdicts(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """rows with keep_id, group_size (rows with this text among these) and kept; batches: the ones that these rows were added as.

        A row is kept if it brought its text into the index: as one of these batches, or, if it is delivered anew, under the
        id that the text is indexed with. Of rows repeated with that id one is kept.
        """
        known = self.entries()
        buckets = self._found()[1]
        per = firsts(rows).withColumnRenamed("doc_id", "least").repartition(buckets, "digest").join(known.hint("merge"), "digest")
        # Null ids are told apart by the batch alone.
        mine = F.when(F.col("batch").isin(batches), F.col("least").eqNullSafe(F.col("doc_id"))).otherwise(F.coalesce(F.col("least") == F.col("doc_id"), F.lit(False)))
        per = materialize(per.select("digest", F.col("doc_id").alias("keep_id"), F.when(mine, F.col("row")).alias("keep_row"), F.col("n").alias("group_size")), "dedup-verdicts")
        out = attach(rows, per, ["digest"], "group_size")
        return out.select(*rows.columns, "keep_id", "group_size", (F.col("keep_row").isNotNull() & (F.col("keep_row") == F.col("row"))).alias("kept"))


def dedupe(docs: DataFrame, index: DigestIndex, batch: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text the index did not know, one of each; they are in the index afterwards.

    All columns of docs are kept, whatever their names but `_dedup_row`, which raises ValueError. An empty table adds nothing.
    """
    if "_dedup_row" in docs.columns:
        raise ValueError("a column is named _dedup_row")
    held = materialize(docs.withColumn("_dedup_row", F.monotonically_increasing_id()), "dedup-docs")
    rows = digests(held, id_col=id_col, text_col=text_col, row_col="_dedup_row")
    kept = index.verdicts(rows, [index.add(rows, batch)]).where("kept").select(F.col("row").alias("_dedup_row"))
    return held.join(kept, "_dedup_row", "left_semi").drop("_dedup_row")


def report(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, after all are added to the index.

    They arrive in two batches, the smaller half of the ids first, so that the smallest id of equal texts is the one indexed;
    null ids come last. Null texts are empty, repeated rows are rows of their own, of which one is kept. An empty table has no rows.
    """
    rows = digests(docs, id_col=id_col, text_col=text_col)
    half = rows.approxQuantile("doc_id", [0.5], 0.01)
    early = F.col("doc_id") <= F.lit(half[0] if half else 0).cast("long")
    batches = [index.add(rows.where(early)), index.add(rows.where(F.coalesce(~early, F.lit(True))))]
    out = index.verdicts(rows, batches)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
