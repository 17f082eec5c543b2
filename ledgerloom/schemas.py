"""Table schemas, enumerated domains and the portfolio configuration."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

MONEY, RATIO, QTY, PRICE, INDEX = T.DecimalType(20, 4), T.DecimalType(12, 8), T.DecimalType(24, 8), T.DecimalType(20, 8), T.DecimalType(20, 10)

# The domains of the enumerated columns.
SLEEVE_KINDS = ("beta_core", "tilt", "discretionary_equity", "cross_asset_insurance", "low_vol_carve", "other")
ASSET_CLASSES = ("equity", "etf", "bond", "commodity", "cash", "other")
DELEVER_STATES = ("normal", "half", "full", "reentry")
PRICE_SOURCES = ("minio", "yfinance", "manual", "cost", "none")
TRADE_KINDS = ("buy", "sell")
LEDGER_SOURCES = ("avanza", "manual")
FLOW_KINDS = ("deposit", "withdrawal")


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _L, _D = T.StringType(), T.LongType(), T.DateType()
SLEEVES = _table(("id", _L), ("code", _S), ("name", _S), ("kind", _S), ("target_weight", RATIO), ("sort_order", _L), ("notes", _S))
HOLDINGS = _table(
    ("id", _L), ("sleeve_id", _L), ("symbol", _S), ("isin", _S), ("name", _S), ("asset_class", _S), ("currency", _S), ("quantity", QTY), ("avg_price", PRICE), ("cost_basis_sek", MONEY),
    ("acquired_at", _D), ("last_price", PRICE), ("last_price_date", _D), ("price_source", _S), ("as_of", _D), ("notes", _S),
)
TRANSACTIONS = _table(
    ("id", _L), ("date", _D), ("isin", _S), ("symbol", _S), ("name", _S), ("currency", _S), ("kind", _S), ("quantity", QTY), ("price", PRICE), ("amount_sek", MONEY), ("fees_sek", MONEY),
    ("fx_rate", RATIO), ("source", _S), ("note", _S),
)
CASH_FLOWS = _table(("id", _L), ("date", _D), ("amount_sek", MONEY), ("kind", _S), ("source", _S), ("note", _S))
NAV_SNAPSHOTS = _table(
    ("as_of", _D), ("gross_asset_value", MONEY), ("cost_basis", MONEY), ("loan_balance", MONEY), ("net_contribution", MONEY), ("equity", MONEY), ("twr_period", RATIO), ("nav_index", INDEX),
    ("peak_nav_index", INDEX), ("drawdown", RATIO), ("effective_leverage", RATIO), ("belaningsgrad", RATIO), ("delever_status", _S), ("notes", _S),
)
CLOSES = _table(("date", _D), ("ticker", _S), ("close", T.DoubleType()))
TABLES = {"sleeves": SLEEVES, "holdings": HOLDINGS, "transactions": TRANSACTIONS, "cash_flows": CASH_FLOWS, "nav_snapshots": NAV_SNAPSHOTS}


def member(value: Any, domain: tuple[str, ...], what: str) -> str:
    """value in lower case, if it is of the domain; else ValueError."""
    found = str(value).strip().lower()
    if found not in domain:
        raise ValueError(f"{what}: {value!r} is none of {', '.join(domain)}")
    return found


@dataclass(frozen=True)
class Config:
    """Risk and leverage parameters (fixed default values). Rates are SEK for one unit."""

    base_currency: str = "SEK"
    account_label: str = "Account"
    leverage_target: float = 1.30
    leverage_floor: float = 1.00
    glide_low_assets: float = 2_500_000.0
    glide_high_assets: float = 10_000_000.0
    blended_rate: float = 0.0234
    repriced_rate: float = 0.0359
    belaningsgrad_cliff: float = 0.25
    delever_half_dd: float = -0.35
    delever_full_dd: float = -0.45
    reentry_recovery: float = 0.20
    forced_sale_dd: float = -0.57
    external_reserve: float = 75_000.0
    planning_cagr_low: float = 0.10
    planning_cagr_high: float = 0.16
    fx_usd_sek: float = 9.34
    fx_eur_sek: float = 10.87
    fx_as_of: dt.date | None = None
    fx_source: str | None = None
    notes: str | None = None

    def updated(self, **changes: Any) -> Config:
        """With the given settings; None and unknown names are ignored."""
        known = {f.name for f in fields(self)}
        number = lambda v: float(v) if isinstance(v, Decimal) else v
        return replace(self, **{k: number(v) for k, v in changes.items() if k in known and v is not None})
