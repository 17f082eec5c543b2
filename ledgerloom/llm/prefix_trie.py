"""Conversation prefix trie by prefix-doubling naming.

Every distinct turn gets a dense number. A block of two turns is named by the pair of their numbers, a block of four
by the pair of its halves' names, and so on: one join round a power of two, over aligned blocks only, so all rounds
together hold twice the turns. The first d turns of a conversation are the blocks of d's binary digits, longest first.
They are named from left to right, in as many rounds, by the smallest conversation that begins with them; prefixes of
one depth and name are one node. Sums over subtrees come from pointer doubling: in round k a node gets the sums of
those 2^k below it, whose ancestors are looked up among the prefix names.

Scale: no round gathers a conversation, a node or its members. Joins are by (conversation, position), which is unique, or
go through names.attach, which holds a first turn that a third of all conversations share. Conversations
are ordered over ranges of rows, so that one of any length spreads over tasks. Rounds grow with the
logarithm of the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.names import attach, dense

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Sequences:
    """turns (conv_id, pos from 0, name, size in bytes of the text) and convs (conv_id, length), turnless ones included."""

    turns: DataFrame
    convs: DataFrame


def sequences(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Sequences:
    """Conversations as sequences of named turns, in the order of turn (null first).

    Equal turn numbers are ordered by role and then by the SHA-256 of the text; repeated rows are turns of their own. Null roles
    and texts are empty. Rows without a conversation are left out, other columns are not read.
    Texts of any length are hashed where they are read; only the hash and the size go on.
    """
    c = lambda name: F.col(f"`{name}`")
    role, text = F.coalesce(c(role_col), F.lit("")), F.coalesce(c(text_col), F.lit(""))
    same = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    order = ["conv_id", "turn", "role", "same"]
    rows = conversations.select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).alias("turn"), role.alias("role"), same.alias("same"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")
    # Positions over ranges of the order: a row's number in its range, plus its conversation's rows in the ranges before.
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "same", "size", F.monotonically_increasing_id().alias("row")), "trie-ordered")
    ranged = ranged.withColumn("part", F.shiftright("row", 33))
    runs = ranged.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(runs.select("conv_id", "part", (before - F.col("first")).alias("shift")), ["conv_id", "part"])
    placed = materialize(placed.select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "same", "size"), "trie-placed")
    names = dense(placed.groupBy("same").agg(F.count(F.lit(1)).alias("n")), "trie-names")
    turns = attach(placed, names, ["same"], "n").select("conv_id", "pos", "name", "size")
    return Sequences(materialize(turns, "trie-turns"), materialize(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "trie-convs"))


def regrafted(seq: Sequences, *, group: int = 5, heads: int = 9) -> Sequences:
    """Each conversation c begun anew: the first h turns of conversation c - c % group (all if it has fewer, none if it
    is not there), then c's own turns after its first h, with h = crc32(decimal c) % heads.

    So groups of conversations share beginnings of several lengths, and some lose all their turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = seq.convs.withColumns({"base": base, "h": h})
    of_base = seq.convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("h", F.coalesce("base_length", F.lit(0)))
    grafts = materialize(convs.join(of_base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), "length"), "trie-grafts")
    first = seq.turns.where(F.col("pos") < heads - 1).select(F.col("conv_id").alias("base"), "pos", "name", "size")
    lent = grafts.where("conv_id != base").join(first, "base").where("pos < h").select("conv_id", "pos", "name", "size")
    late = seq.turns.withColumn("h", h).where((F.col("conv_id") != base) & (F.col("pos") >= F.col("h"))).drop("h")
    # A conversation of any length meets its one graft.
    own = attach(late, grafts.where("conv_id != base").select("conv_id", "h", "taken", "length"), ["conv_id"], "length")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "size")
    turns = seq.turns.where(F.col("conv_id") == base).unionByName(lent).unionByName(own)
    length = F.when(F.col("conv_id") == F.col("base"), F.col("length")).otherwise(F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))
    return Sequences(materialize(turns, "trie-rebuilt"), materialize(grafts.select("conv_id", length.alias("length")), "trie-lengths"))


def blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Tables (conv_id, i, name), at k of the aligned blocks [i 2^k, (i + 1) 2^k) of turns; equal blocks, equal names."""
    levels = [turns.select("conv_id", F.col("pos").alias("i"), "name")]
    while 2 ** len(levels) <= longest:
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("i", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null")
        pairs = materialize(pairs, "trie-pairs")
        names = dense(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "trie-names")
        levels.append(materialize(attach(pairs, names, ["a", "b"], "n").select("conv_id", F.col("j").alias("i"), "name"), "trie-blocks"))
    return levels


def prefixes(seq: Sequences, longest: int, root: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, node) for every prefix but the empty one, and the nodes (depth, node, n_convs).

    node: the smallest conversation that begins with the prefix. A depth is its binary digits: the prefix
    without the last of them has its name from an earlier round, and the rest is one block.
    """
    levels = blocks(seq.turns, longest)
    spark, done, nodes = seq.turns.sparkSession, None, []
    for k in reversed(range(len(levels))):
        last = levels[k].where("i % 2 = 0").select("conv_id", (F.col("i") * 2**k).alias("start"), ((F.col("i") + 1) * 2**k).alias("depth"), F.col("name").alias("block"))
        parts = last.where("start = 0").withColumn("front", F.lit(root).cast("long"))
        if done is not None:
            parts = parts.unionByName(last.where("start > 0").join(done.select("conv_id", F.col("depth").alias("start"), F.col("node").alias("front")), ["conv_id", "start"]))
        parts = materialize(parts.select("conv_id", "depth", "front", "block"), "trie-parts")
        named = materialize(parts.groupBy("depth", "front", "block").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
        nodes.append(named.select("depth", "node", "n_convs"))
        found = materialize(attach(parts, named, ["depth", "front", "block"], "n_convs").select("conv_id", "depth", "node"), "trie-prefixes")
        done = found if done is None else done.unionByName(found)
    if done is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, node bigint"), spark.createDataFrame([], "depth bigint, node bigint, n_convs bigint")
    return done, _all(nodes)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trie(seq: Sequences) -> DataFrame:
    """One row per node, the textless root (depth 0) included; no rows for no conversations.

    conv_id: the smallest member; n_convs: the conversations that begin with the node's turns; n_children; n_leaves:
    childless nodes in its subtree, itself included; saved_tokens: summed over its subtree, (n_convs - 1) times
    the bytes of the last turn's text; ends_sha256: of the members that end here, in ascending order, comma-joined.
    """
    spark = seq.convs.sparkSession
    whole = seq.convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("root"), F.max("length").alias("longest")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODE)
    root, longest = whole["root"], whole["longest"]
    member, named = prefixes(seq, longest, root)
    top = spark.range(1).select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), F.lit(whole["n"]).cast("long").alias("n_convs"))

    def above(rows: DataFrame, steps: int) -> DataFrame:
        """rows (depth, node, ...) of nodes that deep, with up: the node so many levels above."""
        near = rows.where(F.col("depth") == steps).withColumn("up", F.lit(root).cast("long"))
        far = rows.where(F.col("depth") > steps).withColumn("at", F.col("depth") - steps)
        far = far.join(member.select(F.col("conv_id").alias("node"), F.col("depth").alias("at"), F.col("node").alias("up")), ["node", "at"]).drop("at")
        return near.unionByName(far)

    size = seq.turns.select(F.col("conv_id").alias("node"), (F.col("pos") + 1).alias("depth"), "size")
    inner = above(named.join(size, ["node", "depth"]), 1)
    nodes = top.withColumns({"size": F.lit(0).cast("long"), "up": F.lit(None).cast("long")}).unionByName(inner)
    nodes = materialize(nodes, "trie-parents")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "trie-children")

    sums = nodes.select("depth", "node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    step = 1
    while step <= longest:
        gains = above(sums, step).groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = lambda c, g: (F.col(c) + F.coalesce(g, F.lit(0))).alias(c)
        sums = materialize(sums.join(gains, ["depth", "node"], "left").select("depth", "node", more("n_leaves", "l"), more("saved_tokens", "s")), "trie-sums")
        step *= 2

    ends = seq.convs.select("conv_id", F.col("length").alias("depth")).where("depth > 0").join(member, ["conv_id", "depth"])
    ends = ends.unionByName(seq.convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node")))
    out = nodes.join(sums, ["depth", "node"]).join(end_hashes(ends), ["depth", "node"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ends (conv_id, depth, node): SHA-256 of each node's ascending ids, comma-joined.

    Ranges of the sorted ids are joined to texts of a batch's length, wherever they are; as the hash can only be made in
    order, one pass then runs over a node's texts, one at a time.
    """
    order = ["depth", "node", "conv_id"]
    sorted_ids = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                depth, node, conv = (b.column(c).to_numpy() for c in range(3))
                cuts = np.flatnonzero((np.diff(depth) != 0) | (np.diff(node) != 0)) + 1
                starts = np.concatenate([[0], cuts])
                texts = [",".join(map(str, ids.tolist())) for ids in np.split(conv, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(node[starts]), pa.array(conv[starts]), pa.array(texts)], names=[*order, "ids"])

    pieces = sorted_ids.mapInArrow(joined, "depth bigint, node bigint, conv_id bigint, ids string")
    dealt = pieces.repartition("depth", "node").sortWithinPartitions(*order)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def row(keys: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(hashes, pa.string())], names=["depth", "node", "ends_sha256"])

        for b in batches:
            keys, hashes = [], []
            for depth, node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (depth, node) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    keys.append(at)
                    hashes.append(state.hexdigest())
                at, state = (depth, node), hashlib.sha256(ids.encode())
            if keys:
                yield row(keys, hashes)
        if at is not None:
            yield row([at], [state.hexdigest()])

    return dealt.mapInArrow(hashed, "depth bigint, node bigint, ends_sha256 string")
