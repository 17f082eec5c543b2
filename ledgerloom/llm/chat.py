"""Chat formatting by quotation linking.

A message's lines are parsed by their level of quotation (leading '>' marks, blanks between them
allowed). Runs of lines of one level are passages; each is normalised (marks, case and runs of white
space fall away) and hashed. Passages at level 0 are original writing; quoted ones are looked up among
the originals, the outermost level of a message being what it replies to. Where no passage is found
whole, its paragraphs and lines are looked up among those of the originals, and the longest that is
found links. Messages that quote nothing found reply to the turn before them. Conversations are then ordered by reply and stripped of quotes.

Scale: lookups are two joins by hash against one row a passage or piece (the first message with it, in the
conversation and anywhere), so a passage or line that a third of all messages share matches once. Ordering needs
no table of whole conversations: roots are found by pointer doubling, and messages are ordered over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.quality import bound

#: Possessive, as a line of very many marks would otherwise take stack for each.
MARKS = r"^[ \t]{0,3}((?:>[ \t]?)++)"


def levels(text: Column) -> Column:
    """array<struct<level int, line string>>: each line with its quotation level, marks removed."""
    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(F.regexp_count(marks, F.lit(">")).cast("int").alias("level"), F.when(marks != "", F.regexp_replace(line, MARKS, "")).otherwise(line).alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), one)


def runs(lines: Column) -> Column:
    """array<struct<level int, body string>>: runs of lines of one level, each cut out once, so the work is that of the lines."""

    def of(all_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["level"] != F.get(all_, i - 1)["level"]))

        def cut(begins: Column) -> Column:
            return F.transform(begins, lambda i, k: F.struct(F.get(all_, i)["level"].alias("level"), F.array_join(F.transform(F.slice(all_, i + 1, F.coalesce(F.get(begins, k + 1), F.size(all_)) - i), lambda x: x["line"]), "\n").alias("body")))

        return bound(starts, cut)

    return bound(lines, of)


def pieces(runs: Column) -> Column:
    """array<struct<level int, part int, size int, body string>>: passages (part 0), and as part 1 all that may be quoted of them.

    These are the passage, its paragraphs and its lines. All are normalised; blank ones fall away.
    """
    def of(p: Column) -> Column:
        some = F.concat(F.array(p["body"]), F.split(p["body"], r"\n(?:[ \t\x0B\f\r]*\n)+"), F.split(p["body"], "\n"))
        parts = F.transform(some, lambda x: F.struct(p["level"].alias("level"), F.lit(1).alias("part"), F.length(normal(x)).alias("size"), normal(x).alias("body")))
        return F.concat(F.array(F.struct(p["level"].alias("level"), F.lit(0).alias("part"), F.length(normal(p["body"])).alias("size"), normal(p["body"]).alias("body"))), F.array_distinct(parts))

    return F.filter(F.flatten(F.transform(runs, of)), lambda p: p["body"] != "")


def normal(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, r"[ \t\n\x0B\f\r]+", " ")))


def stripped(text: Column) -> Column:
    """text without ASCII white space at its ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def format_chats(messages: DataFrame, *, far: int = 8, far_common: int = 32, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, parent_conv, parent_turn, linked, thread_conv, thread_turn, depth, position, text.

    linked: the parent was found by a quotation ('quote'), is the turn before ('turn') or is missing ('root').
    A parent is always an earlier turn of the conversation, or, for a quote not found there, the first
    message anywhere with that passage or piece if its (conv, turn) is smaller. Beyond the conversation a
    piece must tell whom it quotes: it has `far` characters or more and stands in one message alone, or
    `far_common` or more. thread_*: the message from which the
    replies start; depth: replies from it; position: gapless from 0 within the thread, by (depth, conv, turn).
    text: the level-0 lines, without white space at the ends. Messages without conv or turn are left out; null texts are empty;
    of repeated (conv, turn) rows the one with the smallest (role, text) stands; other columns are left out.
    """
    c = lambda name: F.col(f"`{name}`")
    base = messages.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"), c(role_col).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    one = base.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = one.withColumn("lines", levels(F.col("text"))).withColumn("runs", runs(F.col("lines"))).withColumn("passages", pieces(F.col("runs")))
    clean = stripped(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    parsed = materialize(parsed.select("conv_id", "turn", "role", clean.alias("text"), F.transform("passages", lambda p: F.struct(p["level"].alias("level"), p["part"].alias("part"), p["size"].alias("size"), F.unhex(F.md5(F.encode(F.concat(p["part"].cast("string"), p["body"]), "utf-8"))).alias("hash"))).alias("passages")), "chat-parsed")

    flat = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.part", "p.size", "p.hash")
    originals = flat.where("level = 0")
    quotes = flat.where("level > 0").groupBy("conv_id", "turn", "hash", "part", "size").agg(F.min("level").alias("level"))
    here = originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("own_turn"))
    told = (F.col("size") >= far_common) | ((F.col("size") >= far) & (F.min(F.struct("conv_id", "turn")) == F.max(F.struct("conv_id", "turn"))))
    anywhere = originals.groupBy("hash", "size").agg(F.min(F.struct("conv_id", "turn")).alias("first"), told.alias("told")).where("told").select("hash", "first")
    found = quotes.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    inside = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv_id"), F.col("own_turn").alias("turn")))
    outside = F.when(F.col("first") < F.struct("conv_id", "turn"), F.col("first"))
    found = found.withColumn("inside", inside).withColumn("outside", outside).where("inside is not null or outside is not null")
    # The outermost quotation that is found, whole or else its longest piece; inside the conversation first, then the latest message.
    rank = F.struct(F.col("level"), F.col("part"), -F.col("part") * F.col("size"), F.col("inside").isNull(), -F.coalesce("inside.turn", "outside.turn"))
    parent = found.groupBy("conv_id", "turn").agg(F.min_by(F.coalesce("inside", "outside"), rank).alias("quoted"))

    # The turn before: a lag over small pieces and the pieces' last turns, so that no conversation meets in one task.
    piece = F.floor(F.col("turn") / 4096)
    within = W.partitionBy("conv_id", "piece").orderBy("turn")
    lagged = parsed.select("conv_id", "turn", piece.alias("piece")).withColumn("before", F.lag("turn").over(within))
    ends = lagged.groupBy("conv_id", "piece").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("earlier", F.lag("end").over(W.partitionBy("conv_id").orderBy("piece"))).select("conv_id", "piece", "earlier")
    before = lagged.join(ends, ["conv_id", "piece"]).select("conv_id", "turn", F.coalesce("before", "earlier").alias("before"))

    links = before.join(parent, ["conv_id", "turn"], "left")
    previous = F.when(F.col("before").isNotNull(), F.struct(F.col("conv_id").alias("conv_id"), F.col("before").alias("turn")))
    links = links.select("conv_id", "turn", F.coalesce("quoted", previous).alias("parent"), F.when(F.col("quoted").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").otherwise("root").alias("linked"))
    links = materialize(links, "chat-links")
    rooted = _roots(links.select(F.struct("conv_id", "turn").alias("node"), "parent"))

    whole = parsed.drop("passages").join(links, ["conv_id", "turn"]).withColumn("node", F.struct("conv_id", "turn")).join(rooted, "node").drop("node")
    # Positions: rows are dealt by ranges of their order, so that a thread of any shape spreads over tasks. A row's
    # place is its number in its part, plus the sizes of its thread's parts before: a row a thread and part.
    order = ["root", "depth", "conv_id", "turn"]
    dealt = whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright("row", 33)), "chat-ordered")
    sizes = dealt.groupBy("root", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("root").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(sizes.select("root", "part", (before - F.col("first")).alias("offset")), ["root", "part"])
    return placed.select("conv_id", "turn", "role", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), "linked", F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.col("depth").cast("int").alias("depth"), (F.col("offset") + F.col("row")).cast("long").alias("position"), "text")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root, depth) of a forest of (node, parent) by pointer doubling: a round halves every way to the root.

    A node that has its root takes no part in later rounds but as a step for others.
    """
    start = links.select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done"))
    settled, active = start.where("done"), start.where("not done")
    while active.limit(1).count():
        above = settled.unionByName(active).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        moved = active.drop("done").join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"))
        moved = materialize(moved, "chat-roots")
        settled, active = settled.unionByName(moved.where("done")), moved.where("not done")
    return settled.select("node", F.col("up").alias("root"), "depth")
