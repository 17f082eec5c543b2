"""N-gram Jaccard join as a blocked, masked sparse product of the document by n-gram incidence.

For documents X (rows) and n-grams (columns), the product X Xt holds every overlap |x & y|. Which of its
cells can reach the threshold follows from set sizes alone, and only those are accumulated:

  size       |y| >= t |x|;
  prefix     in one order of the n-grams (rare first), a pair shares one of the first |x| - ceil(t|x|) + 1;
  place      at the first shared n-gram, at places p and q, min(|x| - p, |y| - q) >= t/(1+t) (|x| + |y|);
  count      the overlap of the two prefixes, and all that follows them, must reach t/(1+t) (|x| + |y|).

Equal sets are collapsed first. The cells are then taken in three turns, none of which lists the pairs of a
large group. The first takes, for each n-gram, the cells between its best-placed document and the others;
the second every admissible cell whose documents are still in different components (n-grams whose documents
are all in one need none); with these the components are exact. The third accumulates the product within
each component, where all links lie: its sets are dealt into blocks by size and hash, each two blocks of
sizes that can reach the threshold meet once, and their overlaps are summed up over the incidence matrix of
the n-grams that any two of them share. Only each document's number of links leaves a block.

The n-gram order comes from a fixed-size table of hashed counts over all documents; it decides how much
work the filters save, not what is found. n-grams are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, materialize, mix64, settings, slices, word_hashes
from ledgerloom.llm.graph import components

BUCKETS, CHUNK = 1 << 22, 1 << 14
BITS = 1 << 23
#: Sets and n-grams in a block of the product, on average; documents of an n-gram that meet in a piece.
BLOCK_SETS, BLOCK_GRAMS, HOT = 256, 1 << 20, 1000
#: Joins stay sort-merge joins, of which only the tables that are small to begin with are broadcast: each shuffled side that proved
#: small would pass through the driver, dozens of them in a run, and take its memory and a thread.
_JOINS = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, span: int) -> np.ndarray:
    """Hashes (uint64, with repeats) of all runs of `span` words of the text, A-Z lowered; a shorter text is one run."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    span_here = min(span, len(h))
    n = len(h) - span_here + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(span_here))
        for k in range(span_here):
            out = mix64(out * _STEPS[k % 4] + h[k : k + n])
    return out


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mix64(grams + np.uint64(0x14057B7EF767814F))) if len(grams) else np.uint64(0)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, in the same order: themselves below 16,384, then a thousand levels for each doubling."""
    far = np.floor(np.log2(np.maximum(counts, 1 << 14)) * 1000).astype(np.int64) - 14_000 + (1 << 14)
    return np.where(counts < 1 << 14, counts, far).astype("<u2")


def _sketch(docs: DataFrame, span: int) -> np.ndarray:
    """Levels of the counts of n-grams over the whole corpus, hashed into BUCKETS cells: 8 MB on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for b in (piece for whole in batches for piece in slices(whole)):
            for text in b.column(0).to_pylist():
                held.append(shingles(text, span))
                size += len(held[-1])
                if size > 1_000_000:
                    cells += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            cells += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        part = TaskContext.get().partitionId()
        parts = []
        for k in range(0, BUCKETS, CHUNK):
            some = cells[k : k + CHUNK]
            if some.any():
                kind = np.min_scalar_type(int(some.max()))
                parts.append((k // CHUNK, part % 64, kind.str, some.astype(kind).tobytes()))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["chunk", "part", "kind", "cells"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for b in batches:
            for kind, cells in zip(b.column("kind").to_pylist(), b.column("cells").to_pylist(), strict=True):
                total += np.frombuffer(cells, kind)
        total = total if len(key) > 1 else _levels(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.dtype.str]), pa.array([total.tobytes()], pa.binary())], names=["chunk", "part", "kind", "cells"])

    schema = "chunk int, part int, kind string, cells binary"
    parts = docs.mapInArrow(count, schema)
    some = parts.groupBy("chunk", "part").applyInArrow(add, schema)
    rows = some.groupBy("chunk").applyInArrow(add, schema).select("chunk", "cells").collect()  # BUCKETS numbers
    cells = np.zeros(BUCKETS, "<u2")
    for r in rows:
        cells[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], "<u2")
    return cells


def _signatures(rows: DataFrame, cells: np.ndarray, span: int, percent: int) -> DataFrame:
    """id, row, n, k1, k2 and the prefix of each row's set, in the order of rising counts."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in (piece for whole in batches for piece in slices(whole)):
            n, k1, k2, prefix = [], [], [], []
            for text in b.column(2).to_pylist():
                grams = np.unique(shingles(text, span))
                a, c = digest(grams)
                size = len(grams)
                keep = size - -(-percent * size // 100) + 1 if size else 0
                if keep:
                    rank = np.lexsort((grams, order[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:keep]
                    grams = grams[rank]
                n.append(size), k1.append(a), k2.append(c), prefix.append(grams[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "row", "n", "k1", "k2", "prefix"])

    return rows.mapInArrow(run, f"id {kind}, row bigint, n int, k1 bigint, k2 bigint, prefix array<bigint>")


def admissible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Size and place bounds of a pair that first meets at places pa_ and pb."""
    size = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    return size & (F.least(na - pa_, nb - pb) * (100 + percent) >= (na + nb) * percent)


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)) + 1


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """BITS bits, those at the places of the keys' column set: the same size for any number of keys."""
    cells = keys.select(_place(column).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in cells:
        at = (r["bucket"] - 1) * 4096  # bucket k holds the places from 32768 * (k - 1) + 1 on
        bitmap[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def _in_bitmap(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose place, the last column, is set."""
    p = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    return batch.take(pa.array(np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1)))


def _reachable(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs, a written table, that can still reach the threshold once the overlap of their prefixes is counted.

    Whichever prefix ends first in the order holds all the n-grams up to there that both have, so the overlap
    is at most that count and what follows the prefix: ceil(t|x|) - 1 of x, or the same of y. A bitmap keeps
    most prefixes that are in no pair out of the shuffle.
    """
    shared = short.sparkSession.sparkContext.broadcast(_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("sid")), "sid"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = _in_bitmap(b, shared.value)
            yield pa.RecordBatch.from_arrays(some.columns[:3], names=["sid", "n", "prefix"])

    few = short.select("sid", "n", "prefix", _place("sid").alias("p")).mapInArrow(thin, "sid bigint, n int, prefix array<bigint>")
    a = few.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    b = few.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    both = pairs.join(b, "b").join(a, "a")
    after = F.ceil(F.greatest("na", "nb") * percent / F.lit(100)) - 1
    most = F.size(F.array_intersect("pa", "pb")) + after
    return both.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _members(rows: DataFrame, sets: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(sid, grams) of the wanted sets, from the text of the row that stands for each.

    A bitmap of BITS hashed rows, the same size for any corpus, spares most other rows the way; those
    that pass it by chance fall out in the join.
    """
    keys = materialize(sets.join(wanted, "sid").select("sid", "row", "k1", "k2"), "ngram-keys")
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(keys, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole)):
            some = _in_bitmap(b, shared.value)
            grams = [np.unique(shingles(t, span)) for t in some.column(1).to_pylist()]
            marks = [digest(g) for g in grams]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))], names=["row", "k1", "k2", "grams"])

    found = rows.select("row", "text", _place("row").alias("p")).mapInArrow(run, "row bigint, k1 bigint, k2 bigint, grams array<bigint>")
    return found.join(keys, ["row", "k1", "k2"]).select("sid", "grams").dropDuplicates(["sid"])


def _accumulate(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the threshold: blocks of the product, masked to the pairs."""
    left = grams.select(F.col("sid").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("sid").alias("b"), F.col("grams").alias("gb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                a_ids, b_ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                ga, gb = b.column(2), b.column(3)
                na, nb = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ga, gb))
                heads, first, head_of = np.unique(a_ids, return_index=True, return_inverse=True)
                # Columns of the block: the n-grams of its distinct row documents.
                cols = np.concatenate([ga[int(i)].values.to_numpy(zero_copy_only=False) for i in first])
                owner = np.repeat(np.arange(len(heads)), na[first])
                rank = np.argsort(cols, kind="stable")
                cols, owner = cols[rank], owner[rank]
                mine = gb.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(nb)), nb)
                lo, hi = np.searchsorted(cols, mine, "left"), np.searchsorted(cols, mine, "right")
                hits = hi - lo
                rows_hit = np.repeat(row, hits)
                ends = np.cumsum(hits)
                at_col = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - hits), hits)
                mask = owner[at_col] == head_of[rows_hit]
                overlap = np.bincount(rows_hit[mask], minlength=len(nb))
                ok = overlap * 100 >= (na + nb - overlap) * percent
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[ok], pa.int64()), pa.array(b_ids[ok], pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint")


def _block_links(first: tuple, second: tuple | None, percent: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Links of the sets of one block, among themselves or with those of another, in rows of documents.

    A block: (sizes, rows of documents, n-grams of all its sets). Overlaps accumulate over pieces of the columns.
    """
    blocks = [first] if second is None else [first, second]
    sets = [len(x[0]) for x in blocks]
    column, seen = np.unique(np.concatenate([x[2] for x in blocks]), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(sum(sets)), np.concatenate([x[0] for x in blocks]))
    common = seen[column] > 1
    names = np.cumsum(seen > 1) - 1
    row, column = row[common], names[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((sets[0], sets[-1]), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        incidence = np.zeros((sum(sets), 4096), np.float32)
        incidence[row[lo:hi], column[lo:hi] - at] = 1
        overlap += (incidence[: sets[0]] @ incidence[-sets[-1] :].T).astype(np.int64)
    n, m = blocks[0][0], blocks[-1][0]
    linked = overlap * 100 >= (n[:, None] + m[None, :] - overlap) * percent
    if second is None:
        np.fill_diagonal(linked, False)
        return linked @ first[1], None
    return linked @ second[1], linked.T @ first[1]


def _link_counts(sets: DataFrame, roots: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(sid, links): rows of documents with other sets that each set of a component links with."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) if percent < 100 else 1.0)).cast("int")
    member = roots.select(F.col("node").alias("sid"), "root").join(sets.select("sid", "n", "rows"), "sid").withColumn("band", band)
    blocks = member.groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    blocks = materialize(blocks, "ngram-blocks")
    near = lambda step, name: blocks.select("root", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    placed = member.join(blocks, ["root", "band"]).join(near(1, "above"), ["root", "band"], "left").join(near(-1, "below"), ["root", "band"], "left")
    placed = placed.withColumn("h", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    to = lambda n: F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    met = lambda b1, h1, b2, h2: F.struct(b1.alias("b1"), h1.alias("h1"), b2.alias("b2"), h2.alias("h2"))
    b, h = F.col("band"), F.col("h")
    tasks = F.concat(
        F.transform(to(F.col("blocks")), lambda j: met(b, F.least(h, j), b, F.greatest(h, j))),
        F.transform(to(F.col("above")), lambda j: met(b, h, b + 1, j)), F.transform(to(F.col("below")), lambda j: met(b - 1, j, b, h)),
    )
    key = ["root", "b1", "h1", "b2", "h2"]
    dealt = placed.withColumn("t", tasks).join(grams, "sid").select("root", F.explode("t").alias("t"), b.alias("band"), h.alias("h"), "sid", "n", "rows", "grams")
    dealt = dealt.select("root", "t.*", "sid", "n", "rows", ((F.col("band") == F.col("t.b1")) & (F.col("h") == F.col("t.h1"))).alias("mine"), "grams")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        now, sids, links = None, [], []

        def close() -> None:
            sides = {k: (np.array([r[0] for r in v], np.int64), np.array([r[1] for r in v], np.int64), np.array([r[2] for r in v], np.int64), np.concatenate([r[3] for r in v])) for k, v in held.items() if v}
            held[True], held[False] = [], []
            alone = now[1:3] == now[3:5]
            if True in sides and (alone or False in sides):
                counts = _block_links(sides[True][1:], None if alone else sides[False][1:], percent)
                for side, found in zip((True, False), counts, strict=True):
                    if found is not None:
                        sids.append(sides[side][0]), links.append(found)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (sids, links)], names=["sid", "links"])
            sids.clear(), links.clear()
            return batch

        for b in batches:
            keys = list(zip(*(b.column(j).to_pylist() for j in range(5)), strict=True))
            sid, n, rows, mine = (b.column(j).to_pylist() for j in range(5, 9))
            for i, k in enumerate(keys):
                if k != now:
                    if now is not None:
                        close()
                    now = k
                held[mine[i]].append((sid[i], n[i], rows[i], b.column(9)[i].values.to_numpy(zero_copy_only=False).copy()))
            yield out()
        if now is not None:
            close()
        yield out()

    return dealt.mapInArrow(run, "sid bigint, links bigint").groupBy("sid").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, *, span: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """id, n_shingles, component_id and, with count_links, n_links for every row of docs.

    Two rows link when 100 * |x & y| >= percent * |x | y| for their sets of distinct `span`-word runs
    (A-Z lowered; a shorter text is one run). component_id: the smallest id reachable by links. n_links: rows
    that a row links with, those of equal sets included. Null and empty texts have the empty set, link with
    nothing and are their own component; repeated rows are equal sets; a null id takes part with its text, but
    is nobody's smallest, so a component of null ids alone has none. Extra columns are left out.
    """
    with settings(docs.sparkSession, _JOINS):
        return _classes(docs, span, percent, id_col, text_col, count_links)


def _classes(docs: DataFrame, span: int, percent: int, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("row"), "text")
    cells = _sketch(rows.select("text"), span)
    signed = materialize(_signatures(rows, cells, span, percent), "ngram-docs")
    # The row of its smallest id stands for a set: later stages take the set's n-grams from its text.
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row"))
    grouped = signed.where("n > 0").groupBy("n", "k1", "k2").agg(least.alias("least"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("rows"))
    grouped = grouped.select("n", "k1", "k2", F.col("least.id").alias("min_id"), F.col("least.row").alias("row"), "prefix", "rows")
    sets = materialize(grouped.withColumn("sid", F.monotonically_increasing_id()), "ngram-sets")
    # Narrow rows, as there is one for each n-gram of a prefix: size and place share a number.
    tokens = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "tok"))
    tokens = tokens.select("tok", "sid", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("np"))
    shared = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok")
    posting = tokens.join(shared, "tok", "left_semi")
    posting = materialize(posting.select("tok", "sid", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")), "ngram-postings")
    heads = posting.groupBy("tok").agg(F.min(F.struct("pos", "n", "sid")).alias("head"))

    short = sets.select("sid", "n", "prefix")
    star = posting.join(heads, "tok").where("sid != head.sid").where(admissible(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"), percent))
    first = materialize(star.select(F.col("head.sid").alias("a"), F.col("sid").alias("b")).distinct(), "ngram-pairs")
    links, grams = _links(rows, sets, materialize(_reachable(first, short, percent), "ngram-pairs"), span, percent)
    roots = components(links)

    held = posting.select("tok", "sid", "n", "pos").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    held = materialize(held, "ngram-held")
    mixed = held.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts")).where("lo != hi").select("tok", "salts")
    # The documents of a frequent n-gram meet in pieces: one side is dealt over them, the other is in each.
    open_ = materialize(held.join(mixed, "tok").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int")), "ngram-open")
    x, y = open_.alias("x"), open_.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    cross = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root")) & admissible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    rest = cross.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
    second = materialize(_reachable(rest, short, percent), "ngram-pairs")
    if second.limit(1).count():
        more, others = _links(rows, sets, second, span, percent)
        roots, grams = components(links.union(more)), grams.unionByName(others.join(grams, "sid", "left_anti"))

    named = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    of_set = named.join(smallest, "root").select("sid", "n", "k1", "k2", "component_id", (F.col("rows") - 1).alias("n_links"))
    if count_links:
        counts = materialize(_link_counts(sets, roots, grams, percent), "ngram-counts")
        of_set = of_set.join(counts, "sid", "left").withColumn("n_links", F.col("n_links") + F.coalesce("links", F.lit(0)))
    linked = signed.where("n > 0").select("id", "n", "k1", "k2").join(of_set, ["n", "k1", "k2"]).select("id", "n", "component_id", "n_links")
    alone = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", *(["n_links"] if count_links else []))


def _links(rows: DataFrame, sets: DataFrame, pairs: DataFrame, span: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that link, and the n-grams of all sets in pairs."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    grams = materialize(_members(rows, sets, wanted, span), "ngram-grams")
    return materialize(_accumulate(pairs, grams, percent), "ngram-links"), grams


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each component: the row of its smallest id.

    Of rows with equal id and text one stays. Rows with a null id, and of texts without words, all stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = classes(docs, count_links=False, **options)
    own = found.where((F.col(id_col) == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy(F.col(id_col).alias("_ld_id")).agg(F.count(F.lit(1)).alias("_ld_rows"))
    empty = found.where(F.col(id_col).isNotNull() & (F.col("n_shingles") == 0)).select(F.col(id_col).alias("_ld_id"), F.lit(0).cast("long").alias("_ld_rows"))
    kept = materialize(own.unionByName(empty).groupBy("_ld_id").agg(F.max("_ld_rows").alias("_ld_rows")), "ngram-kept")
    # Only documents whose id may be one that goes, or that has several rows, take their texts through a join.
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_ld_id"))
    doubt = materialize(gone.unionByName(kept.where("_ld_rows > 1").select("_ld_id")), "ngram-doubt")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(doubt, "_ld_id"))

    @F.arrow_udf("boolean")
    def in_doubt(place: pa.Array) -> pa.Array:
        p = place.to_numpy(zero_copy_only=False).astype(np.int64) - 1
        return pa.array(((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool))

    known = docs.where(F.col(id_col).isNotNull()).withColumn("_ld_doubt", in_doubt(_place(id_col)))
    sure = known.where("not _ld_doubt").drop("_ld_doubt")
    held = known.where("_ld_doubt").drop("_ld_doubt").join(kept, F.col(id_col) == F.col("_ld_id"))
    once = held.where("_ld_rows <= 1").drop("_ld_id", "_ld_rows")
    more = held.where("_ld_rows > 1").withColumn("_ld_text", F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).dropDuplicates(["_ld_id", "_ld_text"]).drop("_ld_id", "_ld_rows", "_ld_text")
    out = sure.unionByName(once)
    if kept.where("_ld_rows > 1").limit(1).count():
        out = out.unionByName(more)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
