"""Row-level formulas as Column functions: all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import Config

#: Money is summed in whole ten-thousandths, so that sums do not depend on the order of partitions.
UNITS = 10_000.0


def to_units(amount: Column) -> Column:
    return F.floor(amount.cast("double") * UNITS + 0.5).cast("bigint")


def from_units(units: Column) -> Column:
    return units.cast("double") / UNITS


def norm_isin(isin: Column) -> Column:
    return F.upper(F.trim(F.coalesce(isin, F.lit(""))))


def norm_currency(currency: Column) -> Column:
    return F.upper(F.coalesce(currency, F.lit("SEK")))


def fx_factor(currency: Column, cfg: Config) -> Column:
    """SEK for one unit; no currency is SEK, and unknown ones count as SEK."""
    c = norm_currency(currency)
    return F.when(c == "USD", F.lit(float(cfg.fx_usd_sek))).when(c == "EUR", F.lit(float(cfg.fx_eur_sek))).otherwise(F.lit(1.0))


def signed(kind: Column, amount: Column) -> Column:
    return F.when(kind == "buy", amount).otherwise(-amount)


def trade_cash(kind: Column, quantity: Column, price: Column, amount_sek: Column, fees_sek: Column, fx: Column) -> Column:
    """Cash effect in SEK: the booked amount, or else the priced one less fees."""
    gross = quantity.cast("double") * price.cast("double") * fx
    fees = F.coalesce(fees_sek.cast("double"), F.lit(0.0))
    return F.coalesce(amount_sek.cast("double"), F.when(kind == "buy", -gross - fees).otherwise(gross - fees))


def flow_amount(kind: Column, amount: Column) -> Column:
    return F.when(kind == "deposit", F.abs(amount)).otherwise(-F.abs(amount))


def loan(net: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), -net)


def idle_cash(net: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), net)


def price_used(last_price: Column, avg_price: Column) -> Column:
    return F.coalesce(last_price, avg_price)


def price_label(last_price: Column, source: Column) -> Column:
    return F.when(last_price.isNull(), F.lit("cost")).otherwise(F.coalesce(source, F.lit("manual")))


def ratio(part: Column, whole: Column, otherwise: Column | None = None) -> Column:
    """part / whole where whole is above zero."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def delever_state(drawdown: Column, cfg: Config) -> Column:
    return F.when(drawdown <= cfg.delever_full_dd, "full").when(drawdown <= cfg.delever_half_dd, "half").otherwise("normal")


#: Fixed texts of the reports.
ACTIONS = {
    "normal": "none — within tolerance",
    "half": "repay HALF the loan within 3 trading days (-35% NAV-index DD breached)",
    "full": "repay the ENTIRE loan within 3 trading days (-45% NAV-index DD breached)",
    "reentry": "re-entering: re-lever in two halves across two monthly rebalances",
}


def action(state: Column) -> Column:
    out = F.lit("none")
    for name, text in ACTIONS.items():
        out = F.when(state == name, F.lit(text)).otherwise(out)
    return out


def glide_leverage(equity: Column, cfg: Config) -> Column:
    """Target leverage: linear between the two sizes of the glide path, flat outside."""
    e, lo, hi = F.coalesce(equity, F.lit(0.0)), float(cfg.glide_low_assets), float(cfg.glide_high_assets)
    small, large = float(cfg.leverage_target), float(cfg.leverage_floor)
    if hi <= lo:
        return F.lit(small)
    return F.when(e <= lo, F.lit(small)).when(e >= hi, F.lit(large)).otherwise(F.lit(small) + F.lit(large - small) * ((e - lo) / F.lit(hi - lo)))


def headrooms(drawdown: Column, belaningsgrad: Column, cfg: Config) -> list[Column]:
    return [
        (drawdown - float(cfg.delever_half_dd)).alias("headroom_to_half"),
        (drawdown - float(cfg.delever_full_dd)).alias("headroom_to_full"),
        (drawdown - float(cfg.forced_sale_dd)).alias("headroom_to_forced_sale"),
        (F.lit(float(cfg.belaningsgrad_cliff)) - belaningsgrad).alias("belaningsgrad_headroom"),
    ]


def locale_number(text: Column, kind: str = "decimal(38,10)") -> Column:
    """A number with decimal comma and blanks between digits; anything else is null."""
    return F.translate(text, ", \u00a0", ".").try_cast(kind)


# --- display -----------------------------------------------------------------------------------------


def format_money(amount: Column) -> Column:
    """Whole kronor with no-break spaces between thousands."""
    return F.translate(F.format_number(amount, 0), ",", "\u00a0")


def format_money_signed(amount: Column) -> Column:
    return F.concat(F.when(amount > 0, "+").otherwise(""), format_money(amount))


def format_money_short(amount: Column) -> Column:
    a = F.abs(amount)
    return F.when(a >= 1e6, F.concat(F.format_number(amount / 1e6, 2), F.lit("M"))).when(a >= 1e3, F.concat(F.format_number(amount / 1e3, 0), F.lit("k"))).otherwise(F.format_number(amount, 0))


def format_percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def sign_class(value: Column, eps: float = 1e-9) -> Column:
    return F.when(value > eps, "pos").when(value < -eps, "neg").otherwise("")


def heat_alpha(value: Column, largest: Column) -> Column:
    """Opacity of a heat-map cell; null for a blank one."""
    return F.when((value != 0) & (largest > 0), F.lit(0.18) + F.lit(0.82) * F.least(F.lit(1.0), F.abs(value) / largest))


def warns(leverage: Column, target: Column, headroom: Column) -> Column:
    return (leverage > target + 0.02) | (headroom < 0.05)


def weight_input(value: Column) -> Column:
    """A target weight as typed: above 1.5 it is read as a percentage."""
    return F.when(value > 1.5, value / 100.0).otherwise(value)


def weights_balanced(total: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(total - 1.0) <= tolerance
