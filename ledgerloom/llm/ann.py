"""Approximate nearest neighbours: inverted lists scanned by an adaptive number of dimensions.

Vectors are normalised and turned by one random rotation, so any leading block of columns is a fair
sample of a distance. Within each probed list the columns are read block by block; after each block a
hypothesis test drops the candidates whose partial distance already says, at the chosen significance,
that they lie beyond the query's current k-th. Survivors are scored exactly on the original vectors.

A query is not settled by its first lists. They are as many as the index measured, and more until they hold k others. With
its k-th score known, the query goes on to every list that may hold something nearer: none whose members' largest angle from
the centroid rules that out, and of the rest as many as it takes until those left hold fewer than `miss` nearer ones by
the lists' sizes and spreads. So a vector far from all others reads more lists than one in a cluster.

Scale: lists are cut into pieces of about `piece` candidates, so a list (or a group of equal vectors)
of any size spreads over tasks; equal vectors are one candidate that stands for the k+1 smallest ids,
which is all that the tie rule can return. There are about as many lists as the square root of the rows, up
to `most`, and as many of them are read as it takes to hold the wanted share of the true nearest, measured
for some of the vectors against all: vectors in clusters need few lists, vectors without many. The rotation
and the centroids are the only broadcasts: at most `most` x d and d x d numbers, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize


@dataclass(frozen=True)
class Index:
    """rotation d x d, centroids lists x d (turned, unit length) and the rows left out for lack of direction are gone."""

    rotation: np.ndarray
    centroids: np.ndarray
    vectors: DataFrame  # vec_hash, list_id, vector (original), ids: the smallest k+1 ids of each distinct vector
    keep: int
    probes: int  # lists that hold the wanted share of the nearest
    stats: np.ndarray  # lists x 3: ids that a list stands for, smallest and mean cosine with its centroid


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part: not null, not zero, all components finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & nonzero)


def fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Random rotation and spherical k-means centroids from a bounded sample."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = unit(sample) @ rotation
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centers = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centers)
    return rotation, centers


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of q with those of x, in double; equal pairs get equal scores wherever they stand."""
    q, x = q / np.abs(q).max(1, keepdims=True), x / np.abs(x).max(1, keepdims=True)
    return np.clip((x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1))), -1.0, 1.0)


def build(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, lists: int | None = None, most: int = 4096, sample_rows: int = 20_000, recall: float = 0.96, tuned_on: int = 100, seed: int = 7) -> Index | None:
    """Index every usable row; None if there is none.

    sample_rows bounds only the rows that the centroids are fitted on, tuned_on those whose true nearest (over
    all rows) choose the number of probes for `recall`. Repeated rows count once; an id with several vectors
    stands for each of them; other columns may have any name. Vectors of different lengths raise ValueError.
    """
    rows = usable(df, id_col, vector_col)
    width = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return None
    if rows.where(F.size("vector") != width["d"]).limit(1).count():
        raise ValueError(f"vectors of different lengths beside {width['d']}")
    hashed = rows.withColumn("vec_hash", F.unhex(F.md5(F.to_json("vector"))))
    # The k+1 smallest ids of each distinct vector: first within pieces of it, then over all.
    piece = W.partitionBy("vec_hash", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = W.partitionBy("vec_hash").orderBy("vec_id")
    fresh = ~F.col("vec_id").eqNullSafe(F.lag("vec_id").over(piece))
    least = hashed.withColumns({"_r": F.dense_rank().over(piece), "_new": fresh}).where(F.col("_new") & (F.col("_r") <= k + 1)).drop("_new").withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k + 1)
    distinct = least.groupBy("vec_hash").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    lists = lists or int(min(most, max(64, 2 ** np.ceil(np.log2(width["count"]) / 2))))
    share = min(1.0, 1.2 * sample_rows / max(1, width["count"]))
    drawn = rows.sample(share, seed=seed) if share < 1 else rows
    # By a hash, as a plain limit would take the first partitions.
    sample = np.stack(drawn.orderBy(F.xxhash64("vec_id", "vector")).select("vector").limit(sample_rows).toPandas()["vector"].to_numpy()).astype(np.float64)
    rotation, centers = fit(sample, lists, seed)
    both = df.sparkSession.sparkContext.broadcast((rotation, centers))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, mid = both.value
        for b in batches:
            if len(b):
                near = unit(np.stack(b["vector"].to_numpy())) @ turn @ mid.T
                yield b.assign(list_id=near.argmax(1).astype(np.int32), near=near.max(1))

    listed = distinct.mapInPandas(assign, "vec_hash binary, vector array<double>, ids array<bigint>, list_id int, near double")
    listed = materialize(listed, "ann-lists")
    told = listed.groupBy("list_id").agg(F.sum(F.size("ids")).alias("n"), F.min("near").alias("least"), F.avg("near").alias("mean")).toPandas()  # a row a list
    stats = np.tile([0.0, 1.0, 1.0], (len(centers), 1))
    stats[told["list_id"]] = told[["n", "least", "mean"]]
    return Index(rotation, centers, listed, k + 1, _probes(listed, rotation, centers, sample[:tuned_on], k, recall), stats)


def _probes(listed: DataFrame, rotation: np.ndarray, centers: np.ndarray, some: np.ndarray, k: int, recall: float) -> int:
    """Lists to read so that `recall` of the k + 1 nearest of some vectors, found among all, lie in them."""
    q = unit(some) @ rotation
    shared = listed.sparkSession.sparkContext.broadcast((rotation, q))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, asked = shared.value
        best = pd.DataFrame({"query": np.empty(0, np.int32), "score": np.empty(0), "list_id": np.empty(0, np.int32)})
        for b in batches:
            if len(b):
                score = asked @ (unit(np.stack(b["vector"].to_numpy()).astype(np.float64)) @ turn).T
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                row = np.repeat(np.arange(len(asked)), top.shape[1])
                new = pd.DataFrame({"query": row.astype(np.int32), "score": score[row, top.ravel()], "list_id": b["list_id"].to_numpy()[top.ravel()]})
                best = pd.concat([best, new]).sort_values(["query", "score"], ascending=[True, False], kind="stable").groupby("query").head(k + 1)
        yield best

    found = listed.select("list_id", "vector").mapInPandas(nearest, "query int, score double, list_id int")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "list_id"))).where(F.col("r") <= k + 1).select("query", "list_id").toPandas()  # tuned_on x (k + 1) rows
    place = np.empty((len(q), len(centers)), np.int64)
    np.put_along_axis(place, np.argsort(-(q @ centers.T), axis=1, kind="stable"), np.arange(len(centers))[None].repeat(len(q), 0), axis=1)
    needed = np.sort(place[top["query"].to_numpy(), top["list_id"].to_numpy()] + 1)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def more_lists(near: np.ndarray, kth: np.ndarray, stats: np.ndarray, width: int, miss: float) -> np.ndarray:
    """Which lists (queries x lists) may hold vectors whose cosine with a query is above its k-th so far.

    near: cosines of queries and centroids. A list is ruled out by its largest angle from the centroid; what the
    others hold is expected as if their members' cosines were normal around mean * near, with the spread of what
    the centroid does not explain over the other dimensions. Those that hold fewer than `miss` together are left.
    """
    n, least, mean = stats.T
    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(least, -1, 1)) - 1e-9))
    spread = np.sqrt(np.maximum(1 - mean**2, 1e-12) * np.maximum(1 - near**2, 1e-12) / max(1, width - 1))
    z = (kth[:, None] - mean * near) / spread
    tail = np.where(z > 0, 0.5 * np.exp(-0.717 * z - 0.416 * z * z), 1 - 0.5 * np.exp(0.717 * z - 0.416 * z * z))  # of the normal distribution, to 0.005 of it
    expected = np.where((bound >= kth[:, None]) & (n > 0), n * tail, 0.0)
    order = np.argsort(expected, axis=1, kind="stable")
    left = np.take_along_axis(expected, order, 1).cumsum(1) < miss
    out = np.empty_like(left)
    np.put_along_axis(out, order, ~left, 1)
    return out


def search(index: Index | None, queries: DataFrame, *, k: int = 5, probes: int | None = None, miss: float = 0.05, piece: int = 4096, block: int = 16, eps: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine, itself left out; ties to the smaller id.

    Every query gets k rows, or all candidates if there are fewer. probes: lists read for each query at first (None: as many
    as the index measured), more if they hold too few. miss: nearer vectors that the lists never read may hold, as expected;
    0 reads all that the angles do not rule out. A query given twice is answered once. block: columns between tests. eps: width
    of the test; larger abandons less. A null or zero vector, or one with null or non-finite components, takes no part.
    """
    spark = queries.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    probes, keep = probes or index.probes, k + 1
    wanted = usable(queries, id_col, vector_col).withColumn("vec_hash", F.unhex(F.md5(F.to_json("vector"))))
    both = spark.sparkContext.broadcast((index.rotation, index.centroids, index.stats))
    asked = wanted.groupBy("vec_hash").agg(F.first("vector").alias("vector"))
    dealt = "vec_hash binary, vector array<double>, list_id int, far double"

    def chosen(near: np.ndarray) -> np.ndarray:
        """The nearest lists, `probes` of them or as many more as hold `keep` ids."""
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.take_along_axis(np.broadcast_to(both.value[2][:, 0], near.shape), order, 1).cumsum(1)
        take = (np.arange(near.shape[1]) < probes) | (np.pad(before, ((0, 0), (1, 0)))[:, :-1] < keep)
        out = np.empty_like(take)
        np.put_along_axis(out, order, take, 1)
        return out

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, mid, _ = both.value
        for b in batches:
            if len(b):
                row, lists = np.nonzero(chosen(unit(np.stack(b["vector"].to_numpy())) @ turn @ mid.T))
                yield pd.DataFrame({"vec_hash": b["vec_hash"].to_numpy()[row], "vector": b["vector"].to_numpy()[row], "list_id": lists.astype(np.int32), "far": np.inf})

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, mid, stats = both.value
        for b in batches:
            if len(b):
                near, kth = unit(np.stack(b["vector"].to_numpy())) @ turn @ mid.T, b["kth"].to_numpy(np.float64)
                row, lists = np.nonzero(more_lists(near, kth, stats, len(turn), miss) & ~chosen(near))
                yield pd.DataFrame({"vec_hash": b["vec_hash"].to_numpy()[row], "vector": b["vector"].to_numpy()[row], "list_id": lists.astype(np.int32), "far": 2 - 2 * kth[row] + 1e-9})

    def best(hits: DataFrame) -> DataFrame:
        """Each query's `keep` nearest ids as an array."""
        top = hits.withColumn("r", F.row_number().over(W.partitionBy("vec_hash").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= keep)
        return top.groupBy("vec_hash").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))

    early = materialize(best(_scan(index, asked.mapInPandas(first, dealt), both, keep, piece, block, eps)), "ann-first")
    # Of equal scores the smaller id counts, so lists that may hold an equal one are read too.
    bar = F.when(F.size("near") >= keep, F.element_at("near", keep)["score"]).otherwise(-1.0)
    again = asked.join(early.select("vec_hash", bar.alias("kth")), "vec_hash").mapInPandas(further, dealt)
    late = _scan(index, again, both, keep, piece, block, eps)
    lists = best(early.select("vec_hash", F.explode("near").alias("h")).select("vec_hash", "h.vec_id", "h.score").unionByName(late))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answered = wanted.select("vec_hash", F.col("vec_id").alias("query_id")).distinct().join(lists, "vec_hash").select("query_id", F.posexplode(own).alias("pos", "hit"))
    return answered.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _scan(index: Index, probed: DataFrame, both, keep: int, piece: int, block: int, eps: float) -> DataFrame:
    """(vec_hash, vec_id, score): the nearest ids of probed (vec_hash, vector, list_id, far) in each piece of their lists; far: the squared distance to beat."""
    probed = materialize(probed, "ann-probed")
    # Pieces of a list by its size; a table of one row a list.
    pieces = index.vectors.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("pieces"))
    asked_of = probed.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("q_pieces"))
    cut = F.broadcast(pieces.join(asked_of, "list_id"))  # at most one row a list, and `lists` is a parameter
    stored = (
        index.vectors.join(cut, "list_id").withColumn("piece", F.pmod(F.xxhash64("vec_hash"), F.col("pieces")).cast("int"))
        .select("list_id", "piece", F.explode(F.sequence(F.lit(0), F.col("q_pieces") - 1)).alias("q_piece"), "vec_hash", "vector", "ids")
    )
    dealt = (
        probed.join(cut, "list_id").withColumn("q_piece", F.pmod(F.xxhash64("vec_hash"), F.col("q_pieces")).cast("int"))
        .select("list_id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "q_piece", "vec_hash", "vector", "far")
    )

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        turn = both.value[0]
        parts = []
        if len(left) and len(right):
            raw = np.stack(right["vector"].to_numpy()).astype(np.float64)
            turned, ids = unit(raw) @ turn, right["ids"].to_numpy()
            least = np.array([x[0] for x in ids])
            for at in range(0, len(left), 512):
                some = left.iloc[at : at + 512]
                q = np.stack(some["vector"].to_numpy()).astype(np.float64)
                row, col = adaptive(turned, unit(q) @ turn, keep, block, eps, some["far"].to_numpy(np.float64))
                score = cosine(q[row], raw[col])
                order = np.lexsort((least[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                near = np.arange(len(row)) - np.searchsorted(row, row) < keep  # each vector stands for one id at least
                parts.append(pd.DataFrame({"vec_hash": some["vec_hash"].to_numpy()[row[near]], "vec_id": ids[col[near]], "score": score[near]}).explode("vec_id"))
        out = pd.concat(parts) if parts else pd.DataFrame({"vec_hash": [], "vec_id": [], "score": []})
        return out.astype({"vec_id": np.int64})

    return dealt.groupBy("list_id", "piece", "q_piece").cogroup(stored.groupBy("list_id", "piece", "q_piece")).applyInPandas(scan, "vec_hash binary, vec_id bigint, score double")


def adaptive(turned: np.ndarray, q: np.ndarray, keep: int, block: int, eps: float, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) pairs that may be among a query's `keep` nearest; far: each query's k-th squared distance so far.

    Columns are read in blocks. A pair is abandoned once its partial squared distance exceeds what a
    candidate at the query's threshold would show, but for chance: (1 + eps / sqrt(columns read)).
    """
    n, d = turned.shape
    first = min(block, d)
    x, y = turned[:, :first], q[:, :first]
    partial = (y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (y @ x.T)
    # The threshold: the keep-th full distance among those that look nearest after the first block.
    m = min(n, 4 * keep)
    look = np.argpartition(partial, m - 1, axis=1)[:, :m]
    full = ((turned[look] - q[:, None, :]) ** 2).sum(2)
    limit = np.minimum(far, np.partition(full, min(keep, m) - 1, axis=1)[:, min(keep, m) - 1])
    slack = lambda read: (read / d) * (1 + eps / np.sqrt(read)) ** 2 if read < d else 1.0
    row, col = np.nonzero(partial <= limit[:, None] * slack(first) + 1e-9)
    partial = partial[row, col]
    for at in range(first, d, block):
        read = min(at + block, d)
        part = turned[col, at:read] - q[row, at:read]
        partial = partial + (part * part).sum(1)
        stay = partial <= limit[row] * slack(read) + 1e-9
        row, col, partial = row[stay], col[stay], partial[stay]
    return row, col
