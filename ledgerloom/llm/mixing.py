"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). The cells' weights are raked: scaled to each
marginal in turn until all are met. A document is then kept with a probability in proportion to its
cell's calibrated weight, by a keyed hash of its id, so a sample can be repeated. Probabilities end at 1:
the weight from which they are 1 is the one that `full` of all tokens lie at or below, so a rare cell
with an extreme weight does not thin out all the others; what such cells cannot supply is missing.

With targets, cells are bounded by them: a category without a target of its own falls under '*other*'. At most
(sources + 1) x (languages + 1) x (topics + 1) cells that hold documents come to the driver, whatever the corpus. Without, every
category has its own; where an axis has more than `most`, the cells are raked as a distributed table.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

OTHER = "*other*"
DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking, and how far off a marginal may be: the same for cells on the driver and for a table of them.
ROUNDS, TOLERANCE = 200, 1e-9


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text: tabular, symbolic, shouted, brief or prose."""
    t, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    return (
        F.when(F.regexp_count(t, F.lit(r" \| ")) * 30 > n, "tabular")
        .when(F.regexp_count(t, F.lit(r"[#*$%&<>]")) * 20 > n, "symbolic")
        .when(F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > n, "shouted")
        .when(n < 400, "brief")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words as a stand-in for tokens; at least 1, so that no document is without weight."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


def tempered(marginal: dict[str, float], power: float) -> dict[str, float]:
    """Shares raised to `power` (below 1: towards even) and scaled to 1."""
    raised = {k: v**power for k, v in marginal.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake_cells(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells, given as a code on each axis and tokens, with tokens * weights meeting every marginal.

    targets: shares by code. A target share of categories that hold no tokens cannot be met; it is dealt to the
    rest in proportion. Marginals that contradict each other (as some cells are missing) never meet: after
    `rounds` rounds the last fit stands, and a warning names how far it is off.
    """
    share = tokens / tokens.sum()
    fitted, wanted = share.copy(), []
    for axis, (code, t) in enumerate(zip(codes, targets, strict=True)):
        t = np.where(np.bincount(code, share, len(t)) > 0, t, 0.0)
        if t.sum() <= 0:
            raise ValueError(f"no category of axis {axis} has both tokens and a target")
        wanted.append(t / t.sum())
    for _ in range(rounds):
        worst = 0.0
        for code, t in zip(codes, wanted, strict=True):
            have = np.bincount(code, fitted, len(t))
            worst = max(worst, float(np.abs(have - t).max()))
            fitted = fitted * np.divide(t, have, out=np.zeros_like(t), where=have > 0)[code]
        if worst < tolerance:
            break
    else:
        warnings.warn(f"raking is still off by a share of {worst:.2g} after {rounds} rounds", stacklevel=2)
    return np.divide(fitted, share, out=np.zeros_like(fitted), where=share > 0)


def rake(cells: np.ndarray, targets: list[np.ndarray], **options) -> np.ndarray:
    """As rake_cells, for a table with an axis a dimension; weights of cells without tokens are 0."""
    codes = np.nonzero(cells)
    out = np.zeros(cells.shape)
    out[codes] = rake_cells(list(codes), cells[codes].astype(float), targets, **options)
    return out


def _known(column: Column, names: list[str]) -> Column:
    return F.when(column.isin(names), column).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def _rake_table(cells: DataFrame, keys: list[str], power: float, full: float, *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """As rake and the probabilities in calibrate, to tempered own marginals, on (keys, tokens) that need not fit the driver."""
    whole = float(cells.agg(F.sum("tokens")).first()[0])
    now = materialize(cells.withColumn("fitted", F.col("tokens") / whole), "mixing-raked")
    wanted = {}
    for k in keys:
        raised = materialize(now.groupBy(k).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("want")), "mixing-wanted")
        wanted[k] = raised.withColumn("want", F.col("want") / raised.agg(F.sum("want")).first()[0])
    step = lambda t, k: t.groupBy(k).agg(F.sum("fitted").alias("have")).join(wanted[k], k)
    for _ in range(rounds):
        off = [step(now, k).agg(F.max(F.abs(F.col("have") - F.col("want"))).alias("off")) for k in keys]
        if off[0].union(off[1]).union(off[2]).agg(F.max("off")).first()[0] < tolerance:
            break
        for k in keys:
            now = now.join(step(now, k), k).withColumn("fitted", F.col("fitted") * F.col("want") / F.col("have")).drop("want", "have")
        now = materialize(now, "mixing-raked")
    else:
        warnings.warn(f"raking has not met all marginals after {rounds} rounds", stacklevel=2)
    now = materialize(now.withColumn("weight", F.col("fitted") * whole / F.col("tokens")), "mixing-raked")
    # The least weight that `full` of all tokens lie at or below: ever finer pieces of the range that holds it.
    need, under, some = full * whole * (1 - 1e-12), 0.0, now
    low, high = some.agg(F.min("weight"), F.max("weight")).first()
    while low < high:
        at = F.least(F.floor((F.col("weight") - low) / F.lit((high - low) / 1000)), F.lit(999))
        for r in sorted(some.groupBy(at.alias("at")).agg(F.sum("tokens").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).collect(), key=lambda r: r["at"]):
            if under + r["n"] >= need:
                break
            under += r["n"]
        low, high = r["low"], r["high"]
        some = now.where(F.col("weight").between(low, high))
    return now.select(*keys, "weight", F.least(F.lit(1.0), F.col("weight") / F.lit(low)).alias("probability"))


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float]] | None, *, power: float = 0.8, full: float = 0.99, most: int = 1000) -> tuple[DataFrame, pd.DataFrame | DataFrame]:
    """(docs with _ld_source, _ld_lang, _ld_topic, _ld_tokens; the table of cells with weight and probability).

    docs must have source, lang and topic. targets: shares by dimension and category; where OTHER is not among
    them it keeps its share of the tokens. None: the corpus's own marginals, tempered by `power`; with more than
    `most` categories in a dimension the table of cells stays distributed.
    """
    # One pass over the texts: token sums of the categories as they are, from which all else follows.
    sums = materialize(docs.groupBy(*DIMENSIONS).agg(F.sum("_ld_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-cells")
    temper = targets is None
    if temper:
        targets = {}
        for d in DIMENSIONS:
            shares = sums.where(F.col(d).isNotNull()).groupBy(d).agg(F.sum("tokens").alias("n")).limit(most + 1)
            targets[d] = {r[d]: float(r["n"]) for r in shares.collect()}
        if any(len(t) > most for t in targets.values()):
            known = {f"_ld_{d}": F.coalesce(d, F.lit(OTHER)) for d in DIMENSIONS}
            return docs.withColumns(known), _rake_table(sums.withColumns(known).groupBy(*known).agg(F.sum("tokens").alias("tokens")), list(known), power, full)
    names = {d: sorted(k for k in targets[d] if k != OTHER) for d in DIMENSIONS}
    for d in DIMENSIONS:
        docs = docs.withColumn(f"_ld_{d}", _known(F.col(d), names[d]))
        sums = sums.withColumn(f"_ld_{d}", _known(F.col(d), names[d]))
    keys = [f"_ld_{d}" for d in DIMENSIONS]
    got = sums.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).toPandas()
    if not len(got):
        return docs, pd.DataFrame(columns=[*keys, "tokens", "docs", "weight", "probability"])
    axes = {d: [*names[d], OTHER] for d in DIMENSIONS}
    at = {d: {k: i for i, k in enumerate(v)} for d, v in axes.items()}
    codes = [got[k].map(at[d]).to_numpy(np.int64) for k, d in zip(keys, DIMENSIONS, strict=True)]
    held = got["tokens"].to_numpy(float)
    given = []
    for code, d in zip(codes, DIMENSIONS, strict=True):
        own = dict(targets[d])
        if temper or OTHER not in own:  # the unnamed keep their own share of all
            rest = float(held[code == at[d][OTHER]].sum())
            named = float(held.sum()) - rest
            own[OTHER] = rest if temper or not named else rest / named * sum(own.values())
        if temper and power != 1:
            own = tempered(own, power)
        given.append(np.array([own.get(k, 0.0) for k in axes[d]]))
    got["weight"] = rake_cells(codes, held, given)
    order = np.argsort(got["weight"].to_numpy(), kind="stable")
    held = np.cumsum(got["tokens"].to_numpy(float)[order])
    whole = got["weight"].to_numpy()[order][np.searchsorted(held, full * held[-1] * (1 - 1e-12))]
    got["probability"] = np.minimum(1.0, got["weight"] / whole)
    return docs, got.sort_values(keys).reset_index(drop=True)


def mix(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, power: float = 0.8, full: float = 0.99, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", topic_of=topic) -> DataFrame:
    """docs with weight (the cell's), probability and kept.

    Null sources, languages and topics count as OTHER. Equal ids draw alike; a null id draws by its text.
    full: see above. An existing topic column is used as it is; else topic_of(text). Columns beginning with _ld_ are the
    operator's own; weight, probability and kept are replaced where they exist. An empty table stays empty.
    """
    text = F.col(f"`{text_col}`")
    names = [c for c in docs.columns if c not in ("weight", "probability", "kept")]
    ready = docs.select(*(F.col(f"`{c}`") for c in names), tokens(text).alias("_ld_tokens"))
    ready = ready if "topic" in names else ready.withColumn("topic", topic_of(text))
    spark = docs.sparkSession
    ready, cells = calibrate(ready, targets, power=power, full=full)
    keys = [f"_ld_{d}" for d in DIMENSIONS]
    if isinstance(cells, DataFrame):
        met = ready.join(cells, keys, "left")
    else:  # at most one row a cell of the targets: small by construction
        table = spark.createDataFrame(cells[[*keys, "weight", "probability"]], f"{', '.join(f'{k} string' for k in keys)}, weight double, probability double")
        met = ready.join(F.broadcast(table), keys, "left")
    draw = F.conv(F.substring(F.sha2(F.encode(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256))), "utf-8"), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    out = met.withColumn("kept", draw < F.col("probability"))
    return out.drop(*keys, "_ld_tokens")
