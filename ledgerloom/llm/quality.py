"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean expression that is true for a document to reject. On a sample, every rule's cost
(seconds on the JVM's clock, read before and after the rule on each row) and selectivity (share it rejects) are measured in one job; rules then run in descending order of rejection
per cost, and a document that one rule rejects is not shown to the next. Costs are those given what is
computed in any case: where a count is a column of the result, its rule costs a comparison. The order
changes only the work, never the verdict: a document is kept if no rule rejects it.

Everything is row by row inside one scan: no shuffle, no Python, memory of one document at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, materialize


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column  # null counts as false


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


# --- features -------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Words of a text (maximal runs of characters other than ASCII white space); null or empty: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_chars(word_list: Column) -> Column:
    return F.length(F.array_join(word_list, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def word_lines(text: Column) -> Column:
    r"""\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    r"""\n-split lines that hold a word and equal an earlier line."""
    return bound(word_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once: an element variable holds it."""
    return F.transform(F.array(value), use)[0]


def n_repeat_words(word_list: Column, span: int = 5) -> Column:
    """Words that lie in a window of `span` words found twice or more in the text.

    Windows are first compared by a 64-bit hash; equal windows have equal hashes, so a text without
    equal hashes has none. Others are settled on the windows themselves: sorted with their places,
    those with an equal neighbour are repeats, and the words they cover are counted in order of place.
    """
    last = F.size(word_list) - span

    def settle(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: F.struct(F.array_join(F.slice(w, i + 1, span), " ").alias("w"), i.alias("i")))

        def places(s: Column) -> Column:
            twin = lambda x, k: ((k > 0) & (x["w"] == F.get(s, k - 1)["w"])) | ((k < F.size(s) - 1) & (x["w"] == F.get(s, k + 1)["w"]))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-span).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(span), i - a["at"])).cast("long").alias("n"), i.alias("at")), lambda a: a["n"])

        return bound(F.array_sort(windows), lambda s: bound(places(s), covered))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(span)]))

    def count(w: Column) -> Column:
        return bound(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(settle(w)))

    return F.when(last >= 1, bound(word_list, count)).otherwise(F.lit(0).cast("long"))


# --- the cascade ----------------------------------------------------------------------------------


#: A line that breaks off, and one of a list.
CUT, BULLET = r"(\.\.\.|…)[ \t\r]*$", r"^[ \t]*[-*•][ \t]"


def default_rules(text: Column, word_list: Column, repeat_words: Column | None = None) -> list[Rule]:
    """Rules for prose. Thresholds are wide: ordinary text stays well inside each.

    repeat_words: the n_repeat_words column where it is there already.
    """
    n = F.size(word_list)
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    repeats = n_repeat_words(word_list) if repeat_words is None else repeat_words
    return [
        Rule("few_words", n < 10),
        Rule("symbols", symbols * 10 > n * 3),
        Rule("shouting", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"!!")) * 5 > n),
        Rule("long_words", word_char_mean(word_list) > 20),
        Rule("digits", F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9]")) * 4 > F.length(F.array_join(word_list, "")) * 3),
        Rule("duplicate_lines", bound(word_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x) + 2)),
        Rule("cut_lines", bound(word_lines(text), lambda x: F.size(F.filter(x, lambda y: y.rlike(CUT))) * 2 > F.size(x) + 4)),
        Rule("bullets", bound(word_lines(text), lambda x: F.size(F.filter(x, lambda y: y.rlike(BULLET))) * 10 > F.size(x) * 9 + 40)),
        Rule("repeated_windows", repeats * 100 > n * 20),
    ]


def word_char_mean(word_list: Column) -> Column:
    return F.when(F.size(word_list) > 0, F.length(F.array_join(word_list, "")) / F.size(word_list))


def measure(docs: DataFrame, rules: list[Rule], *, sample_rows: int = 1000, seed: int = 11, prepare=None, times: int = 3) -> list[Measured]:
    """Each rule's cost and selectivity on a sample of about sample_rows rows drawn over the whole table.

    The bound sets only what the order of the rules is estimated from. prepare: adds the columns the rules read; they
    are stored with the sample, so making them is no rule's cost. One job evaluates every rule `times` times on each row between two
    readings of the JVM's clock and takes the least, which leaves out pauses; what the readings themselves take is
    subtracted. It runs twice, as the first run compiles.
    """
    rows = docs.count()
    if not rows:
        return [Measured(r.name, 0.0, 0.0) for r in rules]
    drawn = docs.sample(min(1.0, sample_rows / rows), seed=seed).repartition(min(16, docs.sparkSession.sparkContext.defaultParallelism))
    sample = materialize(prepare(drawn) if prepare else drawn, "quality-sample")
    clock = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")

    def timed(rejects: Column) -> Column:
        # An element at a time, in the order of the fields; nothing in a lambda is shared between rules or runs.
        return F.transform(F.sequence(F.lit(1), F.lit(times)), lambda _: F.struct(clock.alias("began"), F.coalesce(rejects, F.lit(False)).alias("rejects"), clock.alias("ended")))

    tried = sample.select(timed(F.lit(False)).alias("r0"), *[timed(r.rejects).alias(f"r{k}") for k, r in enumerate(rules, 1)])
    least = [F.sum(F.array_min(F.transform(f"r{k}", lambda t: t["ended"] - t["began"]))) for k in range(len(rules) + 1)]
    told = tried.agg(F.count(F.lit(1)), *least, *[F.sum(F.col(f"r{k}")[0]["rejects"].cast("int")) for k in range(1, len(rules) + 1)])
    told.first()
    n, bare, *rest = told.first()
    nanos, rejected = rest[: len(rules)], rest[len(rules) :]
    return [Measured(r.name, max(0, (t or 0) - (bare or 0)) / 1e9, (x or 0) / max(1, n)) for r, t, x in zip(rules, nanos, rejected, strict=True)]


def ordered(rules: list[Rule], measured: list[Measured]) -> list[Rule]:
    """Highest rejection per cost first; cheaper first among rules that reject nothing. What differs by less than a factor of about two is
    as good as equal and ordered by name, so that small changes of the clock do not change the order."""
    by, step = {m.name: m for m in measured}, lambda x: round(math.log2(max(x, 1e-9)))
    return sorted(rules, key=lambda r: (-step(by[r.name].gain), step(by[r.name].seconds), r.name))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null. CASE stops at its first true branch: the rest isn't evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects, F.lit(r.name)) if out is None else out.when(r.rejects, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def cascade(docs: DataFrame, *, text_col: str = "text", rules=default_rules, sample_rows: int = 1000) -> DataFrame:
    """docs with `rejected_by` (null: kept). Any extra columns stay; null and empty texts have no words.

    A column named rejected_by is replaced; columns beginning with _ld_ are the operator's own.
    """
    prepare = lambda df: df.withColumn("_ld_words", words(F.col(f"`{text_col}`")))
    all_rules = rules(F.col(f"`{text_col}`"), F.col("_ld_words"))
    best = ordered(all_rules, measure(docs.select(F.col(f"`{text_col}`")), all_rules, sample_rows=sample_rows, prepare=prepare))
    return prepare(docs).withColumn("rejected_by", verdict(best)).drop("_ld_words")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and rejected_by of the cascade.

    A row for each row, repeated ones and null ids too; null and empty texts have no words; extra columns are left
    out. The counts are wanted of every document, so n_repeat_words is made before the cascade and its rule is cheap.
    """
    text = F.col(f"`{text_col}`")
    prepare = lambda df: df.withColumn("_ld_words", words(F.col("text"))).withColumn("n_repeat_words", n_repeat_words(F.col("_ld_words")))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("text"))
    all_rules = default_rules(F.col("text"), F.col("_ld_words"), F.col("n_repeat_words"))
    best = ordered(all_rules, measure(rows.select("text"), all_rules, sample_rows=sample_rows, prepare=prepare))
    n = F.size("_ld_words").cast("long")
    return prepare(rows).select(
        id_col, n.alias("n_words"), word_chars(F.col("_ld_words")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"), "n_repeat_words",
        ((n < 10) | (F.col("n_repeat_words") * 100 > n * 20)).alias("base_failed"), verdict(best).alias("rejected_by"),
    )
