"""Filter interaction audit: what each of five filters removes, in every order they may be applied in.

Arrow buffers are scanned as they come: a table of byte classes marks white space, capitals and symbols, prefix sums over
the marks give every document's counts at once, and words are hashed by differences of one running polynomial sum. A
document's word hashes are sorted; neighbours with equal hashes are compared byte by byte, and where two
different words share a hash the document's words are counted as a set. The verdicts are a mask of five bits, and a
document goes on as (id, part, mask, digest of the text) only. Masks are reduced to at most 32 counts a part, from which all
120 orders are read off.

Scale: texts never leave the scan. Copies meet by digest after being counted by (digest, part, mask, label), so a text of a
third of all rows is a few rows. A text is cut at white space into pieces of `PIECE` bytes for the running sums, so what a
worker holds beside a batch is some 20 bytes for each byte of a piece (or of a longer word) and for each word of the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

FILTERS = "ABCDE"
SPACE, CAPITAL, SYMBOL, CONTINUED = 1, 2, 4, 8
#: Bytes of texts that the running sums cover at a time.
PIECE = 1 << 20
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] |= SPACE
    kinds[ord("A") : ord("Z") + 1] |= CAPITAL
    kinds[[ord(c) for c in "#$%&*|"]] |= SYMBOL
    kinds[0x80:0xC0] |= CONTINUED
    return kinds


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def _powers(step: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubled: out[i + done] = out[i] * step^done
        more = min(done, n - done)
        np.multiply(out[:more], np.uint64(pow(step, done, 1 << 64)), out=out[done : done + more])
        done += more
    return out


@lru_cache(1)
def _piece_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, PIECE), _powers(pow(_STEP, -1, 1 << 64), PIECE)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each word: differences of one running sum of letter * step^place, moved to place 0."""
    up, down = _piece_powers() if len(data) <= PIECE else (_powers(_STEP, len(data)), _powers(pow(_STEP, -1, 1 << 64), len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * up[: len(data)], out=sums[1:])
    out = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return out ^ (out >> np.uint64(29))


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of equal size at a and b differ, eight bytes at a time; long ones as whole byte strings."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    out = np.zeros(len(a), bool)
    for k in np.flatnonzero(size > 256):
        out[k] = data[a[k] : a[k] + size[k]].tobytes() != data[b[k] : b[k] + size[k]].tobytes()
    left, at = np.flatnonzero(size <= 256), 0
    while len(left):
        x = view[a[left] + at] ^ view[b[left] + at]
        short = np.minimum(size[left] - at, 8).astype(np.uint64)
        out[left] |= (x << ((np.uint64(8) - short) * np.uint64(8))) != 0
        at += 8
        left = left[size[left] > at]
    return out


def measure(data: np.ndarray, offsets: np.ndarray, hashes=_hashes) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points (code points) and symbols of each text data[offsets[i]:offsets[i + 1]], UTF-8."""
    n = len(offsets) - 1
    kinds = _classes()[data]

    def count(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    word = (kinds & SPACE) == 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], ends[tails] = word[heads], word[tails]
    start, end, words = np.flatnonzero(begins), np.flatnonzero(ends) + 1, count(begins)
    # Pieces: runs of whole words of about PIECE bytes.
    key, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        till = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        low, high = start[at], end[till - 1]
        key[at:till] = hashes(data[low:high], start[at:till] - low, end[at:till] - low)
        at = till
    text = np.repeat(np.arange(n), words)
    order = np.lexsort((end - start, key, text))
    text, key, start, size = text[order], key[order], start[order], (end - start)[order]
    again = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (size[1:] == size[:-1])
    distinct = words - np.bincount(text[1:][again], minlength=n)
    pairs = np.flatnonzero(again)
    wrong = _differ(data, start[pairs], start[pairs + 1], size[pairs])
    for i in np.unique(text[pairs[wrong]]):  # different words under one hash
        mine = text == i
        distinct[i] = len({data[s : s + z].tobytes() for s, z in zip(start[mine], size[mine], strict=True)})
    return {"words": words, "distinct": distinct, "capitals": count(kinds & CAPITAL != 0), "points": count(kinds & CONTINUED == 0), "symbols": count(kinds & SYMBOL != 0)}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, digest): which of the filters A to D a text fails, as bits 1, 2, 4 and 8, and a hash of the text."""
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(c(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            offsets = np.frombuffer(texts.buffers()[1], width, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):  # texts of about PIECE bytes at a time, or one longer text
                till = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
                low, high = offsets[at], offsets[till]
                m = measure(data[low:high], offsets[at : till + 1] - low)
                mask = 1 * (m["words"] < 100) + 2 * (100 * m["distinct"] < 80 * m["words"]) + 4 * (100 * m["capitals"] > 10 * m["points"]) + 8 * (m["symbols"] > 0)
                digests = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(offsets[at:till], offsets[at + 1 : till + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, till - at), b.column(1).slice(at, till - at), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])
                at = till

    return rows.mapInArrow(run, "doc_id bigint, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters (E as bit 16), with those of quality 1 and those toxic.

    E fails for a text that a smaller id has too. A null id is larger than all others, and equal ids are not smaller: rows
    repeated with the smallest id all pass. Of several labels of an id any 1 counts; a null id has none.
    """
    scanned = materialize(scan(docs, id_col=id_col, text_col=text_col, part_col=part_col), "audit-masks")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    known = scanned.where("doc_id is not null").join(told, "doc_id", "left")
    rows = known.unionByName(scanned.where("doc_id is null").withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))
    rows = rows.withColumns({"good": F.coalesce("quality", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # The smallest id of each kind, with its rows; then the smallest of each text.
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(lead.alias("lead"), "n")).alias("first"))
    kinds = materialize(kinds, "audit-kinds")
    least = kinds.groupBy("digest").agg(F.min("first.lead").alias("least"))
    marked = kinds.join(least, "digest").withColumn("passing", F.when(F.col("first.lead") == F.col("least"), F.col("first.n")).when(F.col("least.none"), F.col("n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    cells = marked.select("part", "good", "toxic", split.alias("c")).where("c.n > 0")
    return cells.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the five filters and step; zeros included, no rows for no documents.

    A: under 100 words; B: fewer than 80 % of the words distinct; C: over 10 % capitals among the code points; D: any of
    #$%&*|; E: a copy of a smaller id's text. Null texts are empty, null parts the empty string; texts of any length are read whole.
    Of the part: kept (after the step), removed (by it), redundant (failing, but removed before), unique_fails (failing this
    filter alone), good_lost and toxic_lost (removed, by label), shapley (removed by this filter, over all orders).
    """
    cells = masks(docs, labels, **columns)
    steps = []  # a fixed table: 120 orders x 5 steps
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        steps += [{"filter_order": "".join(order), "step": k + 1, "bit": bits[k], "before": sum(bits[:k])} for k in range(len(bits))]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    # At most 32 cells a part come together, and meet the steps there.
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    per = whole.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")

    def total(of: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(when(c["mask"]), c[of]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    alive = lambda m: m.bitwiseAND(before) == 0
    goes = lambda m: fails(m) & alive(m)
    # Of the 120 orders, each failing filter comes first among the failing ones in an equal share.
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), c["n"] * F.floor(F.lit(120) / F.bit_count(c["mask"]))).otherwise(0))
    return per.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", goes).alias("removed"), total("n", lambda m: fails(m) & ~alive(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"), total("good", goes).alias("good_lost"), total("toxic", goes).alias("toxic_lost"), share.alias("shapley"),
    )
