"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to four bytes deep with counts of what follows each. A symbol
seen in the longest context is coded there; otherwise an escape (method C: distinct / (total + distinct))
leads to the next shorter context, where the symbols already offered are excluded; below the empty
context every byte and the end of text that is still open is equally likely.

What follows a context follows its suffix too. So what exclusion leaves of the suffix is its total less the
counts, there, of the longer context's symbols: one sum a context, kept with its total and number of symbols
(`out`). With these a symbol's probability is a chain of table look-ups, a step a level.

Counts come from all training documents, and every context of four bytes seen in them is in the model: tables
of counts that grow with the corpus, summed by context in the cluster. Of the levels of three and four bytes
the most frequent contexts with at most `entries` symbols each are broadcast, 40 MB in all at any corpus size; the levels
below are bounded by 65536 x 257 entries. Symbols after the other contexts meet their counts in a shuffled
join. Word counts (for the base score) have no bound either, so only the `frequent` most frequent words are
broadcast, and a document's other words meet their counts in a join likewise; the parts add up to exact sums.

Words are keyed by a 64-bit hash: with a billion distinct words, some pair collides with probability 0.03.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, materialize, slices, word_hashes

END = 256
SYMBOLS = 257
ORDER = 4
#: What stands before a text.
START = 0x0A
#: Hash that stands for the end token; words have 64-bit hashes, and none of them is known to have this one.
END_WORD = np.int64(-(1 << 63))
#: Words, and symbols in contexts, that a task sums up before it hands them on.
FLUSH, FLUSH_CODES = 400_000, 3_000_000
#: Symbols after broadcast contexts of a level, at most.
ENTRIES = 1_000_000


def codes_of(raw: bytes) -> np.ndarray:
    """(four bytes before, symbol) of every position and of the end, as context * 257 + symbol."""
    x = np.frombuffer(bytes((START,) * ORDER) + raw, np.uint8).astype(np.int64)
    context = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    return context * SYMBOLS + np.append(x[ORDER:], END)


def shorter(codes, order: int):
    """The same symbols after the last `order` bytes of their contexts."""
    return codes % ((1 << 8 * order) * SYMBOLS)


def chain(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """log10 probability of `size` symbols. levels, the longest context first: (count of the symbol, total, distinct, out).

    A context that was never seen has total 0 and is passed over.
    """
    log, open_ = np.zeros(size), np.ones(size, bool)
    kinds_before, out_before = np.zeros(size), np.zeros(size)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n, total, kinds, out in levels:
            rest, fresh = total - out_before, kinds - kinds_before
            escape = np.where(kinds < SYMBOLS, fresh, 0)  # nothing is left to escape to: no escape
            here = open_ & (rest > 0)
            hit = here & (n > 0)
            log += np.where(here, np.log10(np.where(hit, n, escape) / (rest + escape)), 0)
            open_ &= ~hit
            kinds_before, out_before = np.where(total > 0, kinds, kinds_before), np.where(total > 0, out, out_before)
        log -= np.where(open_, np.log10(SYMBOLS - kinds_before), 0)
    return log


@dataclass
class Level:
    """Counts of symbols after contexts of one length: sorted keys (context * 257 + symbol) and contexts."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    out: np.ndarray

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, at = np.zeros(len(codes)), self.find(self.keys, codes)
        n[at >= 0] = self.counts[at[at >= 0]]
        at = self.find(self.contexts, codes // SYMBOLS)
        rows = [np.where(at >= 0, x[at], 0).astype(float) if len(x) else np.zeros(len(codes)) for x in (self.total, self.kinds, self.out)]
        return n, *rows

    @staticmethod
    def find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted in a sorted table, -1 where they are not in it."""
        if not len(table):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, at, -1)


def level(keys: np.ndarray, counts: np.ndarray, order: int, below: Level | None) -> Level:
    """All counts after contexts of `order` bytes, from sorted keys and the level below."""
    contexts, first = np.unique(keys // SYMBOLS, return_index=True)
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)
    suffix = np.zeros(len(keys)) if below is None else below.look(shorter(keys, order - 1))[0]
    return Level(keys, counts, contexts, add(counts.astype(float)), add(np.ones(len(keys))), add(suffix))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Model:
    """levels: of four, three, two, one and no bytes; the two longest hold the most frequent contexts only."""

    levels: list[Level]

    def score(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each, whether its context of four bytes is here: else the number means nothing)."""
        top = self.levels[0].look(codes)
        known = top[1] > 0
        log, rest = np.zeros(len(codes)), np.flatnonzero(known & (top[0] == 0))
        direct = known & (top[0] > 0)
        n, total, kinds = (x[direct] for x in top[:3])
        log[direct] = np.log10(n / (total + np.where(kinds < SYMBOLS, kinds, 0)))
        some = codes[rest]
        log[rest] = chain([tuple(x[rest] for x in top), *(x.look(shorter(some, k)) for x, k in zip(self.levels[1:], (3, 2, 1, 0), strict=True))], len(some))
        return log, known


def adaptive_score(raw: bytes, prior: dict | None = None) -> float:
    """log10 probability of one text by a trie that starts empty (or from `prior`) and learns as it reads."""
    trie: dict[bytes, Counter] = {k: Counter(v) for k, v in (prior or {}).items()}
    past, total = bytes((START,) * ORDER), 0.0
    for s in (*raw, END):
        out, left, p = set(), 1.0, None
        for order in range(ORDER, -1, -1):
            seen = trie.get(past[ORDER - order :])
            if not seen:
                continue
            c = {k: v for k, v in seen.items() if k not in out}
            if not c:
                continue
            esc = len(c) if SYMBOLS - len(out) - len(c) > 0 else 0
            whole = sum(c.values()) + esc
            if s in c:
                p = left * c[s] / whole
                break
            left *= esc / whole
            out |= set(c)
        total += np.log10(left / (SYMBOLS - len(out)) if p is None else p)
        for order in range(ORDER + 1):
            trie.setdefault(past[ORDER - order :], Counter())[s] += 1
        past = past[1:] + bytes((s & 0xFF,))
    return float(total)


def held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    """Whether a document is kept from training: crc32 of its id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _counts(docs: DataFrame, is_held) -> DataFrame:
    """(kind, key, n) of the training documents: words by hash (kind 0) and codes_of (kind 1), summed over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes, sums = [], [(np.empty(0, np.int64), np.empty(0, np.int64))]
        held, docs_seen = 0, 0

        def add_codes():
            if codes:
                sums.append(np.unique(np.concatenate(codes), return_counts=True))
                codes.clear()
                sums[:] = [summed(*map(np.concatenate, zip(*sums, strict=True)))]

        def flush_codes():
            if len(sums[0][0]):
                yield _batch(1, *sums[0])
                sums[:] = [(np.empty(0, np.int64), np.empty(0, np.int64))]

        def flush_words():
            if words:
                keys = word_hashes(list(words)).view(np.int64)
                yield _batch(0, keys, np.fromiter(words.values(), np.int64, len(words)))
                words.clear()

        for b in (piece for whole in batches for piece in slices(whole)):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if is_held(doc_id):
                    continue
                raw = as_bytes(text).lower()
                words.update(raw.split())
                docs_seen += 1
                codes.append(codes_of(raw))
                held += len(raw) + 1
                if held > 2_000_000:
                    add_codes()
                    held = 0
                    if len(sums[0][0]) > FLUSH_CODES:
                        yield from flush_codes()
                if len(words) > FLUSH:
                    yield from flush_words()
        add_codes()
        yield from flush_codes()
        yield from flush_words()
        if docs_seen:
            yield _batch(0, np.array([END_WORD]), np.array([docs_seen]))

    parts = docs.mapInArrow(run, "kind int, key bigint, n bigint")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _batch(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])


def _cut(key: str, order: int) -> Column:
    """The keys' symbols after contexts of `order` bytes."""
    return F.expr(f"{key} % {(1 << 8 * order) * SYMBOLS}")


def _contexts(entries: DataFrame, order: int, below: DataFrame) -> DataFrame:
    """(context, total, kinds, out) of all entries (key, n) of a length; below: those of the next shorter."""
    rows = entries.withColumn("suffix", _cut("key", order - 1)).join(below.select(F.col("key").alias("suffix"), F.col("n").alias("n_suffix")), "suffix")
    return rows.groupBy(F.expr(f"key div {SYMBOLS}").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n_suffix").alias("out"))


def _step() -> Column:
    """Totals by twentieths of a doubling."""
    return F.floor(F.log2("total") * 20).cast("int")


def _least(steps: list[tuple[int, int]], most: int) -> int | None:
    """The least step such that it and all above hold at most `most`; None if the first is too many."""
    least, held = None, 0
    for at, count in sorted(steps, reverse=True):
        held += count
        if held > most:
            break
        least = at
    return least


def _head(entries: DataFrame, contexts: DataFrame, least: int | None) -> Level:
    """The entries of the contexts whose total reaches a step: a bounded number, see _least."""
    some = contexts.where(_step() >= F.lit(least) if least is not None else F.lit(False))
    c = some.toArrow()
    e = entries.join(some.select(F.col("context").alias("c")), F.expr(f"key div {SYMBOLS}") == F.col("c"), "left_semi").toArrow()
    order, rank = np.argsort(e["key"].to_numpy()), np.argsort(c["context"].to_numpy())
    return Level(e["key"].to_numpy()[order], e["n"].to_numpy()[order], *(c[x].to_numpy()[rank] for x in ("context", "total", "kinds", "out")))


def _tail_scores(asked: DataFrame, deep: list[tuple[DataFrame, DataFrame]], shared) -> DataFrame:
    """(key, log): log10 probability of the asked codes, whose counts of four and three bytes are met in joins."""
    rows = asked.select("key").distinct()
    for order, (entries, contexts) in zip((4, 3), deep, strict=True):
        rows = rows.withColumn("cut", _cut("key", order)).withColumn("context", F.expr(f"cut div {SYMBOLS}"))
        rows = rows.join(entries.select(F.col("key").alias("cut"), F.col("n").alias(f"n{order}")), "cut", "left").join(contexts.select("context", *[F.col(c).alias(f"{c}{order}") for c in ("total", "kinds", "out")]), "context", "left").drop("cut", "context")
    found = rows.select("key", *[F.coalesce(F.col(f"{c}{k}").cast("double"), F.lit(0.0)).alias(f"{c}{k}") for k in (4, 3) for c in ("n", "total", "kinds", "out")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value[0].levels[2:]
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            log = chain([tuple(cols[1:5]), tuple(cols[5:9]), *(x.look(shorter(cols[0], k)) for x, k in zip(low, (2, 1, 0), strict=True))], len(cols[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(log)], names=["key", "log"])

    return found.mapInArrow(run, "key bigint, log double")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", is_held=held_out, frequent: int = 200_000, entries: int = ENTRIES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    Training texts are those whose id is not held out by is_held. Null texts are empty: one end token.
    With nothing to train on, every count is 0 and the model is uniform. Repeated rows are scored each
    by itself. Extra columns are not carried along. frequent, entries: how much is broadcast; the scores
    are the same whatever they are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = materialize(_counts(rows, is_held), "ppm-counts")
    words = counts.where("kind = 0")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(sums["n"]), int(sums["v"])
    # The trie, level by level: what follows three bytes is what follows any four that end in them.
    four = counts.where("kind = 1").select("key", "n")
    three = materialize(four.groupBy(_cut("key", 3).alias("key")).agg(F.sum("n").alias("n")), "ppm-three")
    two = materialize(three.groupBy(_cut("key", 2).alias("key")).agg(F.sum("n").alias("n")), "ppm-two")
    small = two.toArrow()  # at most 65536 * 257 rows
    keys, n = summed(small["key"].to_numpy(), small["n"].to_numpy())
    low: list[Level] = []
    for order in (0, 1, 2):
        low.insert(0, level(*summed(shorter(keys, order), n), order, low[0] if low else None))
    contexts = [materialize(_contexts(four, 4, three), "ppm-contexts"), materialize(_contexts(three, 3, two), "ppm-contexts")]
    least4, least3 = (_least([(r["step"], r["n"]) for r in c.groupBy(_step().alias("step")).agg(F.sum("kinds").alias("n")).collect()], entries) for c in contexts)
    if least3 is None or least4 is None:
        least4 = None
    else:  # whatever context of four bytes is broadcast, its last three bytes are too
        least4 = max(least3, least4)
    model = Model([_head(four, contexts[0], least4), _head(three, contexts[1], least3), *low])
    step = F.floor(F.log2("n") * 20).cast("int")
    least = _least([(r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()], frequent)
    top = words.where(step >= F.lit(least) if least is not None else F.lit(False)).select("key", "n").toArrow()
    order = np.argsort(top["key"].to_numpy())
    word_keys, tops = top["key"].to_numpy()[order], top["n"].to_numpy()[order]
    shared = spark.sparkContext.broadcast((model, word_keys, np.log10(tops + 1.0)))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, keys, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in (piece for whole in batches for piece in slices(whole)):
            out, ids = [], b.column(0).to_pylist()
            texts = [as_bytes(t).lower() for t in b.column(1).to_pylist()]
            # The distinct symbols in contexts of each text, and how often: the text's number stands above the code.
            pairs, times = np.unique(np.concatenate([np.empty(0, np.int64), *(codes_of(t) | k << 48 for k, t in enumerate(texts))]), return_counts=True)
            of, codes = pairs >> 48, pairs & ((1 << 48) - 1)
            log, known = model.score(codes)
            total = np.bincount(of, np.where(known, log * times, 0.0), len(texts))
            of, codes, times = of[~known], codes[~known], times[~known].astype(np.int32)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            for k, (doc_id, raw) in enumerate(zip(ids, texts, strict=True)):
                tf = Counter(raw.split())
                h = np.append(word_hashes(list(tf)).view(np.int64), END_WORD)
                n = np.append(np.fromiter(tf.values(), np.int64, len(tf)), 1)
                at = Level.find(keys, h)
                hit = at >= 0
                tail = np.argsort(h[~hit])
                other = slice(ends[k], ends[k + 1])
                out.append((row, bool(is_held(doc_id)), int(n.sum()), int(n[hit].sum()), float((logs[at[hit]] * n[hit]).sum()), float(total[k]), h[~hit][tail], n[~hit][tail].astype(np.int32), codes[other], times[other]))
                row += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["id", "row", "held_out", "n_tokens", "n_known", "log_sum", "score", "tail", "tail_n", "other", "other_n"])

    scored = materialize(rows.mapInArrow(run, f"id {kind}, row bigint, held_out boolean, n_tokens bigint, n_known bigint, log_sum double, score double, tail array<bigint>, tail_n array<int>, other array<bigint>, other_n array<int>"), "ppm-rows")
    tails = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("key"), F.col("t.tail_n").alias("tf"))
    met = tails.join(words.select("key", "n"), "key")
    rare = met.groupBy("row").agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_log"))
    per_token = float(np.log10(n_all + 1.0 * (v_all + 1)))
    asked = scored.select("row", F.explode(F.arrays_zip("other", "other_n")).alias("t")).select("row", F.col("t.other").alias("key"), F.col("t.other_n").alias("tf"))
    deeper = asked.join(_tail_scores(asked, list(zip((four, three), contexts, strict=True)), shared), "key").groupBy("row").agg(F.sum(F.col("tf") * F.col("log")).alias("deeper"))
    out = scored.drop("tail", "tail_n", "other", "other_n").join(rare, "row", "left").join(deeper, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )
