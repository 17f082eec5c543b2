"""The operations of the portfolio service over a Store: reads return DataFrames or plain values, changes are stored."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, mutate, valuation
from ledgerloom.plans import history, risk
from ledgerloom.sources import broker_csv, price_lake, rates
from ledgerloom.schemas import TABLES
from ledgerloom.store import Store
from ledgerloom.stored import written


def listing(rows: DataFrame, order: list[str], limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """rows in order, or the other way round; a limit takes the first of them."""
    rows = rows.orderBy(*[F.desc(c) if newest_first else F.asc(c) for c in order])
    return rows if limit is None else rows.limit(limit)


class Portfolio:
    def __init__(self, store: Store, *, lake_root: str | None = None, closes: DataFrame | None = None):
        """lake_root: the price lake; closes: (date, ticker, close) to use instead of it."""
        self.store, self.spark, self._root, self._closes = store, store.spark, lake_root, closes

    # --- settings and listings ---

    def status(self) -> dict[str, Any]:
        """Whether the store answers, and which price sources there are."""
        try:
            return {"ok": True, "database": True, "sleeves": self.sleeves().count(), "prices": self._root is not None or self._closes is not None}
        except Exception as e:  # a status never raises
            return {"ok": False, "database": False, "error": str(e)[:200]}

    def config(self):
        return self.store.config()

    def update_config(self, **changes: Any):
        cfg = self.store.config().updated(**changes)
        self.store.set_config(cfg)
        return cfg

    def sleeves(self) -> DataFrame:
        return self.store.read("sleeves").orderBy("sort_order", "code")

    def holdings(self, sleeve_id: int | None = None) -> DataFrame:
        rows = self.store.read("holdings")
        return (rows if sleeve_id is None else rows.where(F.col("sleeve_id") == sleeve_id)).orderBy(F.col("sleeve_id").asc_nulls_last(), "symbol")

    def holding_by_isin(self, isin: str | None):
        key = (isin or "").strip().upper()
        return self.holdings().where(F.upper("isin") == key).first() if key else None

    def transactions(self, isin: str | None = None, limit: int | None = None, *, newest_first: bool = False) -> DataFrame:
        rows = self.store.read("transactions")
        return listing(rows if isin is None else rows.where(F.col("isin") == isin.strip().upper()), ["date", "id"], limit, newest_first)

    def cash_flows(self, limit: int | None = None, *, newest_first: bool = False) -> DataFrame:
        return listing(self.store.read("cash_flows"), ["date", "id"], limit, newest_first)

    def snapshots(self, limit: int | None = None, *, newest_first: bool = False) -> DataFrame:
        return listing(self.store.read("nav_snapshots"), ["as_of"], limit, newest_first)

    def tickers(self) -> DataFrame:
        """The ledger's distinct symbols, sorted."""
        return self._trades().where("coalesce(symbol, '') != ''").select(F.upper("symbol").alias("ticker")).distinct().orderBy("ticker")

    def trading_days(self) -> DataFrame:
        """The days of the ledger, sorted."""
        return self._trades().where("date is not null").select("date").distinct().orderBy("date")

    def position_history(self, isin: str) -> DataFrame:
        return ledger.position_history(self._trades(), isin).orderBy("date", "id")

    # --- changes ---

    def seed_sleeves(self) -> int:
        table, new = mutate.seed_sleeves(self.store.read("sleeves"))
        self.store.write("sleeves", table)
        return new

    def upsert_sleeve(self, code: str, **settings: Any) -> None:
        self.store.change("sleeves", lambda t: mutate.upsert_sleeve(t, code=code, **settings))

    def upsert_holding(self, **settings: Any) -> None:
        self.store.change("holdings", lambda t: mutate.upsert_holding(t, self.store.read("sleeves"), **settings))

    def delete_holding(self, row_id: int) -> bool:
        return self.store.delete("holdings", row_id)

    def add_transaction(self, **trade: Any) -> None:
        with self.store.transaction():
            row = mutate.trade_row(self.spark, self.store.next_id("transactions"), **trade)
            self.store.append("transactions", row)
            self.recompute([row.first()["isin"]])

    def delete_transaction(self, row_id: int) -> bool:
        row = self.store.read("transactions").where(F.col("id") == row_id).first()
        if row is None:
            return False
        with self.store.transaction():
            self.store.delete("transactions", row_id)
            self.recompute([row["isin"]])
        return True

    def add_cash_flow(self, **flow: Any) -> None:
        with self.store.transaction():
            self.store.append("cash_flows", mutate.flow_row(self.spark, self.store.next_id("cash_flows"), **flow))

    def delete_cash_flow(self, row_id: int) -> bool:
        return self.store.delete("cash_flows", row_id)

    def recompute(self, isins: list[str] | None = None) -> None:
        def derive(h: DataFrame) -> DataFrame:
            first = mutate.next_id(h)
            out = ledger.recompute_holdings(h, self._trades(), isins)
            of_new = lambda new, c: F.when(F.col("id").isNull(), new).otherwise(F.col(c))
            return out.withColumns({"id": of_new(F.monotonically_increasing_id() + F.lit(first), "id"), "asset_class": of_new(F.lit("equity"), "asset_class"), "price_source": of_new(F.lit("none"), "price_source")})

        self.store.change("holdings", derive)

    # --- import ---

    def preview_import(self, path: str, *, exact: bool = True) -> dict[str, Any]:
        """What an export holds and the positions it alone would make; nothing is stored. exact: positions are folded in decimals, else in doubles."""
        raw = broker_csv.read(self.spark, path)
        trades = ledger.normalized(broker_csv.parse(raw, exact=exact).trades, exact=exact)
        return {"summary": broker_csv.parse(raw).summary.first().asDict(), "positions": ledger.positions(trades)}

    def import_csv(self, path: str) -> dict[str, Any]:
        """Replace the imported rows in the export's span of dates by it, all tables at once; importing again changes nothing.

        The span is that of all rows of the file; trades are replaced only if it has any, flows likewise.
        """
        # Read and parsed once: what follows reads the rows some seven times.
        return self.take(broker_csv.parse(broker_csv.read(self.spark, path), keep=lambda rows: written(rows, "import-rows")))

    def take(self, parsed: broker_csv.Parsed) -> dict[str, Any]:
        """What import_csv does, with an export that is parsed."""
        s = parsed.summary.first()
        lo, hi = s["date_min"], s["date_max"]
        with self.store.transaction():
            if s["n_trades"]:
                self._replace("transactions", parsed.trades, lo, hi)
                self.recompute()
            if s["n_flows"]:
                self._replace("cash_flows", parsed.flows, lo, hi)
        open_ = self.store.read("holdings").where("quantity > 0").count()
        return s.asDict() | {"open_holdings": open_}

    def _replace(self, name: str, rows: DataFrame, lo: str, hi: str) -> None:
        """Only the files that reach into the span are written anew; the new rows are files of their own."""
        new = mutate.with_ids(rows.withColumn("source", F.lit("avanza")), self.store.next_id(name))
        new = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        with self.store.transaction():
            self.store.change(name, lambda t: mutate.without_range(t, lo, hi), since=lo, until=hi)
            self.store.append(name, new, ranged=True)

    # --- reports ---

    def _trades(self) -> DataFrame:
        return ledger.normalized(self.store.read("transactions"))

    def _flows(self) -> DataFrame:
        return self.store.read("cash_flows")

    def _prices(self) -> tuple[DataFrame, int | None]:
        """Closes and how far before a report's first day they reach (the lake is read ten days back)."""
        if self._closes is not None:
            return self._closes, None
        if self._root is not None:
            return price_lake.lake(self.spark, self._root).groupBy("date", "ticker").agg(F.max_by("close", "file").alias("close")), 10
        return self.spark.createDataFrame([], "date date, ticker string, close double"), None

    def _valued(self) -> DataFrame:
        return valuation.value(self.store.read("holdings"), self.config())

    def allocation(self) -> DataFrame:
        return valuation.allocation_report(self._valued(), self.store.read("sleeves"))

    def pnl(self, *, sleeve_only: bool = False) -> DataFrame:
        return valuation.portfolio_pnl(self._valued(), sleeve_only=sleeve_only)

    def reconstruct(self, *, start: str | None = None, end: str | None = None) -> DataFrame:
        closes, back = self._prices()
        return history.reconstruct(self._trades(), self._flows(), self.store.read("holdings"), closes, self.config(), start=start, end=end or risk.today(), lookback_days=back)

    def nav(self, end: str | None = None) -> DataFrame:
        return risk.nav_series(self.store.read("nav_snapshots"), self.reconstruct(end=end))

    def journal(self, *, days: int = 365, end: str | None = None, sleeve_only: bool = True) -> DataFrame:
        closes, back = self._prices()
        return history.journal(self._trades(), self.store.read("holdings"), closes, self.config(), days=days, end=end or risk.today(), sleeve_only=sleeve_only, lookback_days=back)

    def holdings_on(self, on: str, *, sleeve_only: bool = True) -> DataFrame:
        closes, back = self._prices()
        return history.holdings_on(self._trades(), self.store.read("holdings"), closes, self.config(), on, sleeve_only=sleeve_only, lookback_days=back)

    def current_risk(self, today: str | None = None) -> DataFrame:
        return risk.current_risk(self._valued(), self._trades(), self._flows(), self.store.read("nav_snapshots"), self.config(), today or risk.today())

    def add_snapshot(self, as_of: str, *, replace: bool = False, **given: Any) -> None:
        """Store an observation; replace: of a day that has one, it takes its place."""
        table = self.store.read("nav_snapshots")
        earlier = table.where(F.col("as_of") != F.lit(as_of).cast("date")) if replace else table
        row = risk.snapshot_row(self._valued(), self._trades(), self._flows(), earlier, self.config(), as_of, **given)
        self.store.write("nav_snapshots", risk.upsert_snapshot(table, row) if replace else risk.add_snapshot(table, row))

    def backfill(self, *, start: str | None = None, end: str | None = None) -> int:
        series = self.reconstruct(start=start, end=end)
        n = series.count()
        if n:
            self.store.change("nav_snapshots", lambda t: risk.backfill(t, series))
        return n

    # --- refreshes and the daily job ---

    def refresh_fx(self, fetch: rates.Fetch = rates.http_get) -> dict[str, Any]:
        cfg, report = rates.refresh_fx(self.config(), fetch)
        self.store.set_config(cfg)
        return report

    def refresh_prices(self, quotes: DataFrame | None = None, today: str | None = None) -> dict[str, Any]:
        """Newest prices into the holdings; ok is False only if there is neither lake nor quotes. Never raises on a lake that cannot be read."""
        table, closes, error = self.store.read("holdings"), None, None
        if self._closes is not None or self._root is not None:
            try:
                rows = self._closes.withColumn("file", F.lit("")) if self._closes is not None else price_lake.newest(self.spark, self._root)
                closes = price_lake.latest_closes(rows, table.where("symbol != ''").select(F.col("symbol").alias("ticker")))
                closes.count()
            except Exception as e:  # a lake out of reach leaves the quotes
                closes, error = None, f"{type(e).__name__}: {e}"[:300]
        out = rates.refresh_prices(table, closes, quotes, today or risk.today())
        counts = rates.refresh_counts(out).first().asDict()
        self.store.write("holdings", out.drop("outcome"))
        return counts | {"ok": closes is not None or quotes is not None, "lake_error": error}

    def daily_job(self, fetch: rates.Fetch = rates.http_get, quotes: DataFrame | None = None, today: str | None = None) -> dict[str, Any]:
        """Exchange rates, then prices (only where there is a lake), then the day's snapshot in place of any before; stored at once."""
        day = today or risk.today()
        with self.store.transaction():
            out: dict[str, Any] = {"fx": self.refresh_fx(fetch)}
            if self._root is not None or self._closes is not None:
                out["prices"] = self.refresh_prices(quotes, day)
            self.add_snapshot(day, replace=True)
        return out
