"""Valuation, profit and loss, and allocation of holdings; amounts in whole units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.schemas import Config


def value(holdings: DataFrame, cfg: Config) -> DataFrame:
    """holdings with fx, price, price_label, market_value, cost_basis and unrealized_pnl."""
    d = lambda c: F.col(c).cast("double")
    fx = X.fx_factor(F.col("currency"), cfg)
    out = holdings.withColumn("fx", fx).withColumn("price", X.price_used(d("last_price"), d("avg_price"))).withColumn("price_label", X.price_label(F.col("last_price"), F.col("price_source")))
    out = out.withColumn("market_value", X.to_units(d("quantity") * F.col("price") * F.col("fx")))
    out = out.withColumn("cost_basis", X.to_units(F.coalesce(d("cost_basis_sek"), d("quantity") * d("avg_price") * F.col("fx"))))
    return out.withColumn("unrealized_pnl", F.col("market_value") - F.col("cost_basis"))


def total_gross(valued: DataFrame) -> DataFrame:
    return valued.agg(F.coalesce(F.sum("market_value"), F.lit(0)).alias("gross"))


def portfolio_pnl(valued: DataFrame, *, sleeve_only: bool = False) -> DataFrame:
    """One row: market_value, cost_basis, unrealized_pnl, return_pct, priced, at_cost."""
    rows = valued.where("sleeve_id is not null") if sleeve_only else valued
    zero = F.lit(0)
    one = rows.agg(F.coalesce(F.sum("market_value"), zero).alias("market_value"), F.coalesce(F.sum("cost_basis"), zero).alias("cost_basis"), F.count_if(F.col("price_label") != "cost").alias("priced"), F.count_if(F.col("price_label") == "cost").alias("at_cost"))
    pnl = F.col("market_value") - F.col("cost_basis")
    return one.select("market_value", "cost_basis", pnl.alias("unrealized_pnl"), X.ratio(pnl.cast("double"), F.col("cost_basis").cast("double")).alias("return_pct"), "priced", "at_cost")


def _weight(part, total):
    return X.ratio(part.cast("double"), total.cast("double"), F.lit(0.0))


def holding_weights(valued: DataFrame) -> DataFrame:
    """valued with weight: the share in the total of all holdings (0 if that is not above zero)."""
    total = F.broadcast(total_gross(valued))  # one row
    return valued.crossJoin(total).withColumn("weight", _weight(F.col("market_value"), F.col("gross"))).drop("gross")


def _by_sleeve(valued: DataFrame, *more: Column) -> DataFrame:
    """A row a sleeve, and one for holdings without: current_value, n_holdings, gross (of all) and more sums. One pass over the holdings."""
    sums = valued.groupBy("sleeve_id").agg(F.sum("market_value").alias("current_value"), F.count(F.lit(1)).alias("n_holdings"), *more)
    return sums.withColumn("gross", F.sum("current_value").over(W.partitionBy()))  # few rows: the sleeves


def _sleeve_rows(by_sleeve: DataFrame, sleeves: DataFrame, *more: str) -> DataFrame:
    # The total is needed for sleeves without holdings too: it stands in every row, so any has it.
    total = F.broadcast(by_sleeve.agg(F.coalesce(F.max("gross"), F.lit(0)).alias("gross")))
    rows = sleeves.join(by_sleeve.drop("gross").where("sleeve_id is not null"), sleeves["id"] == F.col("sleeve_id"), "left").crossJoin(total)  # one row
    current, target = F.coalesce("current_value", F.lit(0)), F.col("target_weight").cast("double")
    weight = _weight(current, F.col("gross"))
    delta = X.to_units(target * X.from_units(F.col("gross"))) - current
    return rows.select("id", "code", "name", "kind", target.alias("target_weight"), current.alias("current_value"), weight.alias("current_weight"), (weight - target).alias("drift"), delta.alias("rebalance_delta"), F.coalesce("n_holdings", F.lit(0)).alias("n_holdings"), "sort_order", *more)


def allocation(valued: DataFrame, sleeves: DataFrame) -> DataFrame:
    """A row per sleeve, in (sort_order, code): current value and weight, drift, and what to buy to reach target.

    Sleeves without holdings are kept.
    """
    return _sleeve_rows(_by_sleeve(valued), sleeves).orderBy("sort_order", "code")


def unassigned(valued: DataFrame) -> DataFrame:
    """One row: value, weight and number of holdings without a sleeve."""
    return _loose(_by_sleeve(valued))


def _loose(by_sleeve: DataFrame, *more: Column) -> DataFrame:
    none = F.col("sleeve_id").isNull()
    pick = lambda c: F.coalesce(F.max(F.when(none, F.col(c))), F.lit(0)).alias(c)
    one = by_sleeve.agg(pick("current_value"), F.max("gross").alias("gross"), pick("n_holdings"), *more)
    return one.select("current_value", _weight(F.col("current_value"), F.coalesce("gross", F.lit(0))).alias("current_weight"), "n_holdings", *one.columns[3:])


def allocation_report(valued: DataFrame, sleeves: DataFrame) -> DataFrame:
    """The nested form: each sleeve, and last the unassigned, with its holdings in order of symbol."""
    fields = ["symbol", "id", "name", "isin", "asset_class", "currency", "quantity", "avg_price", "last_price", "last_price_date", "price_label", "acquired_at", "market_value", "cost_basis", "unrealized_pnl"]
    by_sleeve = _by_sleeve(valued, F.array_sort(F.collect_list(F.struct(*fields))).alias("some"))
    weighed = F.transform("some", lambda h: F.struct(*[h[c].alias(c) for c in fields], _weight(h["market_value"], F.col("gross")).alias("weight")))
    by_sleeve = by_sleeve.withColumn("holdings", weighed).drop("some")
    none = F.array().cast(by_sleeve.schema["holdings"].dataType)
    report = _sleeve_rows(by_sleeve, sleeves, "holdings").withColumn("holdings", F.coalesce("holdings", none))
    loose = _loose(by_sleeve, F.coalesce(F.first(F.when(F.col("sleeve_id").isNull(), F.col("holdings")), ignorenulls=True), none).alias("holdings"))
    loose = loose.select(*[(F.col(c) if c in loose.columns else F.lit(None).cast(t)).alias(c) for c, t in report.dtypes])
    return report.orderBy("sort_order", "code").unionByName(loose)


def subtotals(valued: DataFrame, *dimensions: str) -> DataFrame:
    """Value, cost and number of holdings for every combination of the dimensions, in one pass.

    A dimension that is summed over is null and has its bit set in `summed` (the first dimension the highest), which tells it
    from holdings where the dimension is null.
    """
    sums = valued.cube(*dimensions).agg(F.grouping_id().alias("summed"), F.sum("market_value").alias("market_value"), F.sum("cost_basis").alias("cost_basis"), F.count(F.lit(1)).alias("n_holdings"))
    return sums.select(*dimensions, "summed", "market_value", "cost_basis", "n_holdings")
