"""License scan: an exact containment join of text blocks with license templates.

A block begins at each line of a document: that line, and those after it until they have as many words as
the longest template, but no further than a line without words. A notice wrapped over lines thus lies whole
in the block of the line where it begins. Sets are blocks' distinct words. A block meets a template T when
it holds at least threshold * |T| of T's words. The join is exact by three filters over one global order, rare
words first, taken from document frequencies over the whole corpus:

  prefix    a block that meets T holds one of the |T| - need + 1 rarest words of T;
  length    it has at least `need` distinct words;
  position  after its first hit at T's place p, at most |T| - p of T's words can be in it.

Templates are a parameter of the library, a few dozen short texts, so they and the frequencies of their
words are the only things broadcast; documents are scanned twice and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes

#: Phrases whose places are counted, and their labels (fixed by the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices of well-known public licenses, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-name": "Released under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-3.0": "under the terms of the GNU General Public License, version 3",
    "lgpl": "under the terms of the GNU Lesser General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution License CC BY 4.0",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike License CC BY-SA",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "Copyright All rights reserved",
    "agpl": "under the terms of the GNU Affero General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0": "the author has waived all copyright and related or neighboring rights to this work",
    "odbl": "made available under the Open Database License",
}

#: Bytes outside words: all ASCII but letters and digits.
_GAPS = bytes(i for i in range(0x80) if not chr(i).isalnum())
_TO_SPACE = bytes.maketrans(_GAPS, b" " * len(_GAPS))


def license_words(raw: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return raw.lower().translate(_TO_SPACE).split()


class Templates:
    """Templates with words in global frequency order, and an index of their prefixes."""

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[bytes, int]):
        self.threshold = threshold
        self.label, self.order, self.need = [], [], []
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text in sorted(templates.items()):
            own = sorted(set(license_words(as_bytes(text))), key=lambda w: (frequency.get(w, 0), w))
            if not own:
                continue
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for p, w in enumerate(own[: len(own) - need + 1]):
                self.prefix[w].append((len(self.label), p))
            self.label.append(label)
            self.order.append(own)
            self.need.append(need)
        self.probes = frozenset(self.prefix)
        self.longest = longest(templates)

    def blocks(self, lines: list[list[bytes]]) -> Iterator[tuple[int, list[bytes]]]:
        """(number of its first line, words) of the blocks that hold a word of a prefix."""
        probed = [not self.probes.isdisjoint(x) for x in lines]
        for k, first in enumerate(lines):
            if not first:
                continue
            end, more = k + 1, 0
            while end < len(lines) and lines[end] and more < self.longest:
                more += len(lines[end])
                end += 1
            if any(probed[k:end]):
                yield k, first if end == k + 1 else [w for x in lines[k:end] for w in x]

    def match(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that a block of these words meets."""
        if len(words) < min(self.need, default=1 << 30) or self.probes.isdisjoint(words):
            return []
        have, first = set(words), {}
        for w in have & self.probes:
            for t, p in self.prefix[w]:
                first[t] = min(p, first.get(t, p))
        out = []
        for t, p in first.items():
            own, need = self.order[t], self.need[t]
            if len(have) >= need and len(own) - p >= need and (n := sum(w in have for w in own[p:])) >= need:
                out.append((self.label[t], n / len(own)))
        return sorted(out)


def longest(templates: dict[str, str]) -> int:
    """Words of the longest template."""
    return max((len(license_words(as_bytes(t))) for t in templates.values()), default=0)


def word_frequencies(docs: DataFrame, templates: dict[str, str], *, text_col: str = "text") -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the templates (as many rows as the templates have words)."""
    wanted = frozenset(w for t in templates.values() for w in license_words(as_bytes(t)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in b["text"]:
                if text:
                    seen.update(wanted.intersection(license_words(as_bytes(text))))
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    parts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, i, n = [], -1, len(phrase)
    while True:
        try:
            i = words.index(phrase[0], i + 1)
        except ValueError:
            return out
        if words[i : i + n] == phrase:
            out.append(i)


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks: (number of its first line, label, containment) of every block that meets a template; labels: those of the
    phrases and of the blocks; score: the largest containment, 1 where a phrase stands, else 0. Null and
    empty texts have no words; repeated rows each get their row; extra columns are not carried along.
    """
    frequency = word_frequencies(docs, templates, text_col=text_col)
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES.items()]
    hint = re.compile(b"|".join(re.escape(p[-1]) for p, _ in phrases)).search
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates, threshold, frequency)
        for b in batches:
            rows = []
            for text in b["text"]:
                lines = [license_words(x) for x in as_bytes(text).split(b"\n")]
                words = [w for x in lines for w in x]
                starts, base, blocks = [], set(), []
                if hint(as_bytes(text).lower()):
                    for phrase, label in phrases:
                        if found := places(words, phrase):
                            starts += found
                            base.add(label)
                for k, x in known.blocks(lines):
                    blocks += [{"line": k, "label": label, "containment": c} for label, c in known.match(x)]
                labels = base | {x["label"] for x in blocks}
                score = 1.0 if base else max((x["containment"] for x in blocks), default=0.0)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)
