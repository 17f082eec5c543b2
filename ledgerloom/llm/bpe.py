"""BPE encoding and decoding by a tokenization automaton.

States are tokens (the last one emitted) and an arc p -t-> t exists when t may follow p in a correct
tokenization. The automaton begins with single bytes, where every arc exists, and grows by one gadget for
each merge (a, b) -> w, in rank order: what follows a no longer begins with b, w takes over what may follow
its second part, and wherever its first part may stand, w may.

What a gadget closes is a rectangle. Let a token's right spine be itself, its second part, the second part
of that, and so on, and its left spine the same of first parts. The merge (a, b) of rank k closes all arcs
p -t-> with a in p's right spine and b in t's left spine, if neither was merged into the next of its spine
by then. Numbered in preorder of their spines' trees, with later-born children first, these p are one
interval and so are these t. The automaton compiled is thus, for every state, the sorted disjoint intervals
of tokens that may not follow it: flat arrays of a few megabytes, in which one search answers for an arc.
(When a = b, the leftmost pair merges first, so that t may also begin with w itself.)

Words are encoded from the left by table-driven transitions of the automaton over bytes. Its state holds
every place where the token that stands there may have begun: the node of the trie of labels, and which of
the labels below that node may follow the token before. At each byte exactly one token ends that follows
the one before it, the last token of that prefix; a word's tokens are read from these backwards. States
and transitions are determinised from the compiled automaton when first reached and kept in a table of
fixed size, which all words of a batch walk through together, one byte at a time. Few are ever reached: on
the test tables 420,000 distinct words need 154,000 transitions.

Decoding emits the labels of the arcs. A full table only costs work: the words that miss it are encoded from
the compiled automaton directly, and it is emptied before the next batch.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices

#: The byte-level scheme's pre-splitting pattern (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a token's number in the keys of arcs.
WIDE = 20
#: Labels below a node of the trie up to which a state says of each whether it may follow.
FEW = 32


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable ones stand for themselves, the others follow from code 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Forest:
    """Tokens under their second (or first) parts, numbered in preorder with later-born children first."""

    def __init__(self, part: list[int], born: list[int]):
        below: list[list[int]] = [[] for _ in part]
        for t in sorted((t for t, p in enumerate(part) if p >= 0), key=born.__getitem__, reverse=True):
            below[part[t]].append(t)
        self.place, self.end = [0] * len(part), [0] * len(part)
        self.below, self.born = below, born
        at, stack = 0, [t for t, p in enumerate(part) if p < 0]
        while stack:
            t = stack.pop()
            if t < 0:
                self.end[~t] = at
                continue
            self.place[t] = at
            at += 1
            stack.append(~t)
            stack.extend(reversed(below[t]))

    def until(self, t: int, rank: int) -> int:
        """End of the interval of t and all below it through children born after `rank`."""
        later = self.below[t]
        k = bisect_right(later, -rank - 1, key=lambda c: -self.born[c])
        return self.place[later[k]] if k < len(later) else self.end[t]


class Automaton:
    """The compiled tokenizer of a byte-level BPE file (tokenizers JSON): flat tables, made once and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is supported")
        symbols = byte_symbols()
        spell = lambda s: bytes(symbols[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        label: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            label[i] = spell(s)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or match whole words are not supported")
        for s, i in self.special.items():
            label[i] = s.encode()
        first, second, born = [-1] * self.size, [-1] * self.size, [-1] * self.size
        merges, closed = [], {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, w = vocab[a], vocab[b], vocab[a + b]
            if born[w] >= 0:
                raise ValueError(f"{path}: token {w} is made by two merges")
            first[w], second[w], born[w] = a, b, k
            merges.append((a, b))
            closed[a << WIDE | b] = k
        states, tokens = _Forest(second, born), _Forest(first, born)
        self.row, self.col = (np.array(f.place, np.int64) for f in (states, tokens))
        boxes = np.array([(states.place[a], states.until(a, k), tokens.place[b], tokens.until(b, k - (a == b))) for k, (a, b) in enumerate(merges)], np.int64).reshape(-1, 4)
        tall = boxes[:, 1] - boxes[:, 0]
        ends = np.cumsum(tall)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(boxes[:, 0] - (ends - tall), tall)
        start, stop = rows << WIDE | np.repeat(boxes[:, 2], tall), rows << WIDE | np.repeat(boxes[:, 3], tall)
        order = np.argsort(start)
        start, reach = start[order], np.maximum.accumulate(stop[order])
        fresh = np.append(True, start[1:] > reach[:-1]) if len(start) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, int)
        #: Intervals (state, token from) to (state, token below) of arcs that do not exist, in order.
        self.closed, self.until = start[fresh], reach[last]

        def meet(p: int, t: int, when: int) -> bool:
            """Whether p and t stand side by side when the gadget of rank `when` comes."""
            while closed.get(p << WIDE | t, when) >= when:
                if born[p] < 0 and born[t] < 0:
                    return True
                if born[t] >= born[p]:
                    if first[t] == second[t] == p:
                        return False
                    t, when = first[t], born[t]
                else:
                    p, when = second[p], born[p]
            return False

        real = [i for i in set(vocab.values()) if (len(label[i]) == 1 if born[i] < 0 else meet(first[i], second[i], born[i]))]
        #: Tokens that words are made of, in the order of their labels.
        self.order = np.array(sorted(real, key=label.__getitem__), np.int32)
        self.offsets = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(x) for x in label], out=self.offsets[1:])
        self.flat = np.frombuffer(b"".join(label), np.uint8)
        self.name = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()

    def open(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether states p have arcs t."""
        key = self.row[p] << WIDE | self.col[t]
        at = np.searchsorted(self.closed, key, "right") - 1
        return (at < 0) | (key >= self.until[np.maximum(at, 0)]) if len(self.closed) else np.ones(len(key), bool)


class _Places(dict):
    """Numbers of the words of a batch, in the order of their coming."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """An automaton and what of its determinisation over bytes was reached so far; one per Python worker."""

    MAX_STATES, MAX_ARCS, MAX_WORD, SLOTS = 120_000, 400_000, 256, 20

    def __init__(self, auto: Automaton):
        import regex

        self.auto, self.name = auto, auto.name
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(auto.special, key=len, reverse=True))) + ")").split if auto.special else None
        self.length = np.diff(auto.offsets)
        self.tokens = auto.order.tolist()
        self.row, self.col = auto.row.tolist(), auto.col.tolist()
        self.closed, self.until = memoryview(auto.closed), memoryview(auto.until)
        # The trie of labels: its nodes' tokens, and the range of labels below them (without their own) in order.
        self.child: dict[int, int] = {}
        self.final, self.low, self.high = [-1], [0], [len(self.tokens)]
        for rank, t in enumerate(self.tokens):
            node = 0
            for byte in auto.flat[auto.offsets[t] : auto.offsets[t + 1]].tobytes():
                key = node << 8 | byte
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.final)
                    self.final.append(-1), self.low.append(rank), self.high.append(rank)
                self.high[node] = rank + 1
            self.final[node] = t
            self.low[node] = rank + 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.to = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, np.int32)
        self.arcs, self.last, self.names, self.of, self.bits = 0, array("i"), [], {}, {}
        self._state(array("q", (0, -1)), -1)

    def _open(self, p: int, t: int) -> bool:
        key = self.row[p] << WIDE | self.col[t]
        at = bisect_right(self.closed, key)
        return not at or key >= self.until[at - 1]

    def _below(self, node: int, p: int) -> int:
        """A bit for each label below the node that may follow token p."""
        key = p << WIDE | node
        bits = self.bits.get(key)
        if bits is None:
            closed, until, row, bits = self.closed, self.until, self.row[p] << WIDE, 0
            for r, t in enumerate(self.tokens[self.low[node] : self.high[node]]):
                at = bisect_right(closed, row | self.col[t])
                if not at or row | self.col[t] >= until[at - 1]:
                    bits |= 1 << r
            self.bits[key] = bits
        return bits

    # A state is a row of (node, may): may is the token before if many labels lie below the node (-1: none
    # before), else -2 - bits, a bit for each label below that may follow the token before.

    def _state(self, parts: array, token: int) -> int:
        name = parts.tobytes()
        s = self.of.get(name)
        if s is None:
            s = self.of[name] = len(self.names)
            self.names.append(name), self.last.append(token)
        return s

    def _step(self, parts: array, byte: int) -> tuple[array, int]:
        """The parts after one more byte, and the token that ends there."""
        child, final, low, high = self.child, self.final, self.low, self.high
        out, token = array("q"), -1
        for k in range(0, len(parts), 2):
            node, may = parts[k], parts[k + 1]
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if token < 0 and (t := final[to]) >= 0 and (may == -1 or (self._open(may, t) if may >= 0 else (-2 - may) >> (low[to] - 1 - low[node]) & 1)):
                token = t
            below = high[to] - low[to]
            if not below:
                continue
            if may <= -2:
                may = -2 - ((-2 - may) >> (low[to] - low[node]) & ((1 << below) - 1))
            elif below <= FEW:
                may = -2 - ((1 << below) - 1 if may < 0 else self._below(to, may))
            if may != -2:
                out.append(to), out.append(may)
        out.append(0), out.append(token)
        return out, token

    def _alone(self, raw: bytes) -> list[int]:
        """The tokens of a word, without the tables of states."""
        parts, ends = array("q", (0, -1)), array("i")
        for byte in raw:
            parts, token = self._step(parts, byte)
            ends.append(token)
        out, at = [], len(raw)
        while at:
            out.append(ends[at - 1])
            at -= int(self.length[out[-1]])
        return out[::-1]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where keys stand in the table, or the empty places where they belong."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while True:
            have = self.keys[at]
            off = np.flatnonzero((have != keys) & (have != -1))
            if not len(off):
                return at
            at[off] = (at[off] + 1) & ((1 << self.SLOTS) - 1)

    def _next(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The states after one more byte each, -1 where the table has no room for one that was not reached before."""
        keys = states.astype(np.int64) << 8 | bytes_
        at = self._slots(keys)
        new = self.keys[at] == -1
        if new.any():
            for key in np.unique(keys[new]).tolist():
                if self.arcs < self.MAX_ARCS and len(self.names) < self.MAX_STATES:
                    to = self._state(*self._step(array("q", self.names[key >> 8]), key & 255))
                    place = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.SLOTS
                    while self.keys[place] != -1:
                        place = (place + 1) & ((1 << self.SLOTS) - 1)
                    self.keys[place], self.to[place] = key, to
                    self.arcs += 1
            at = self._slots(keys)
        return np.where(self.keys[at] == keys, self.to[at], -1)

    def words(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, how many each has)."""
        if self.arcs >= self.MAX_ARCS or len(self.names) >= self.MAX_STATES:
            self.clear()
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.full(len(flat), -1, np.int32)
        apart = size > self.MAX_WORD
        order = np.argsort(-np.where(apart, 0, size), kind="stable")
        left = np.where(apart, 0, size)[order]
        at, word = begin[order], order
        states, k = np.zeros(len(raws), np.int32), 0
        while True:
            m = int(np.searchsorted(-left, -k, "left"))  # words of more than k bytes
            if not m:
                break
            if m < len(at):
                at, word, left, states = at[:m], word[:m], left[:m], states[:m]
            states = self._next(states, flat[at + k])
            miss = states < 0
            if miss.any():
                apart[word[miss]] = True
                at, word, left, states = at[~miss], word[~miss], left[~miss], states[~miss]
            ends[at[: len(states)] + k] = np.frombuffer(self.last, np.int32)[states]
            k += 1
        # Backwards from the ends of the words, a token of each at a time.
        alone = {int(i): self._alone(raws[i]) for i in np.flatnonzero(apart)}
        who, back, rounds = np.flatnonzero(~apart & (size > 0)), None, []
        back = begin[who] + size[who]
        count = np.zeros(len(raws), np.int64)
        while len(who):
            t = ends[back - 1]
            rounds.append((who, t))
            count[who] += 1
            back = back - self.length[t]
            on = back > begin[who]
            who, back = who[on], back[on]
        for i, ids in alone.items():
            count[i] = len(ids)
        stop = np.cumsum(count)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for r, (who, t) in enumerate(rounds):
            out[stop[who] - 1 - r] = t
        for i, ids in alone.items():
            out[stop[i] - len(ids) : stop[i]] = ids
        return out, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each): distinct words are encoded once, all at a time."""
        place, refs = _Places(), []
        for text in texts:
            if self.cut and any(s in text for s in self.auto.special):
                parts = chain.from_iterable([(self.auto.special[x],)] if k % 2 else self.split(x) for k, x in enumerate(self.cut(text)))
            else:
                parts = self.split(text)
            refs.append(np.array(list(map(place.__getitem__, parts)), np.int32))
        ids, count = self.words([b"" if type(w) is tuple else w.encode("utf-8", "replace") for w in place])
        special = {k: w[0] for w, k in place.items() if type(w) is tuple}
        stop = np.cumsum(count)
        for k, t in special.items():  # a place of one token each
            ids = np.insert(ids, stop[k], t)
            count[k], stop = 1, np.cumsum(count + (np.arange(len(count)) == k))
        bounds = np.cumsum([0, *map(len, refs)])
        refs = np.concatenate([np.empty(0, np.int32), *refs])
        n = count[refs]
        ends = np.append(0, np.cumsum(n))
        at = np.arange(ends[-1]) + np.repeat((stop - count)[refs] - ends[:-1], n)
        return ids[at], ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The labels of the arcs, one after the other, as UTF-8 (broken sequences become U+FFFD); ids outside the vocabulary have none."""
        known = (ids >= 0) & (ids < self.auto.size)
        safe = np.where(known, ids, 0)
        start, n = self.auto.offsets[safe], np.where(known, self.length[safe], 0)
        ends = np.append(0, np.cumsum(n))
        at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)
        raw, cuts = self.auto.flat[at].tobytes(), ends[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_live: list[Encoder] = []


def _encoder(auto: Automaton) -> Encoder:
    """The worker's encoder: kept from task to task, given up for that of another vocabulary."""
    if not _live or _live[0].name != auto.name:
        _live[:] = [Encoder(auto)]
    return _live[0]


def _added(df: DataFrame, auto: Automaton, source: str, out: dict[str, str], fill) -> DataFrame:
    """df with columns (name: type) made from another, in small pieces of Arrow batches; columns of those names are replaced."""
    rest = [c for c in df.columns if c not in out]
    table = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{source}`").alias("_ld_source"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in table.dtypes[:-1]), *(f"`{n}` {t}" for n, t in out.items())])
    shared = df.sparkSession.sparkContext.broadcast(auto)  # a few megabytes: the vocabulary's, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value)
        for whole in batches:
            for b in slices(whole, 150):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *fill(coder, b.columns[-1])], names=[*rest, *out])

    return table.mapInArrow(run, schema)


def _plain(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", out: str = "ids", intact: str | None = None) -> DataFrame:
    """docs with `out`: token ids (array<int>) of each whole text; a null or empty text has none.

    intact: also add a column of this name, whether the ids decode to the text again (null counts as empty).
    A row for each row, repeated ones too; an empty table stays empty; of a column named as `out` or `intact`
    the new one stands. A text is held whole, with its words and ids; the file is read on the driver alone.
    """

    def fill(coder: Encoder, texts: pa.Array) -> list[pa.Array]:
        plain = _plain(texts)
        ids, bounds = coder.encode(plain)
        column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return [column] if intact is None else [column, pa.array([a == b for a, b in zip(coder.decode(ids, bounds), plain, strict=True)], pa.bool_())]

    return _added(docs, Automaton(path), text_col, {out: "array<int>"} | ({} if intact is None else {intact: "boolean"}), fill)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with `out`: the text of each row's ids; null ids make an empty text, null entries none."""

    def fill(coder: Encoder, column: pa.Array) -> list[pa.Array]:
        rows = [x.values.drop_null().to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32) for x in column]
        bounds = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int64)
        return [pa.array(coder.decode(np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64), bounds), pa.string())]

    return _added(tokens, Automaton(path), ids_col, {out: "string"}, fill)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids, in one pass over the texts.

    A row for each row, repeated ones and null ids too; a null text is empty; extra columns are left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    decimals: list[str] = []

    def fill(coder: Encoder, texts: pa.Array) -> list[pa.Array]:
        if not decimals:
            decimals.extend(map(str, range(coder.auto.size)))
        ids, bounds = coder.encode(_plain(texts))
        names, cuts = list(map(decimals.__getitem__, ids.tolist())), bounds.tolist()
        first = [sha(",".join(names[a:b])) for a, b in zip(cuts, cuts[1:])]
        return [pa.array(np.diff(bounds), pa.int64()), pa.array(first, pa.string()), pa.array(map(sha, coder.decode(ids, bounds)), pa.string())]

    return _added(rows, Automaton(path), "text", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, fill).drop("text").withColumnRenamed("doc_id", id_col)
