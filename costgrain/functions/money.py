"""Exact money: micro-dollars in integers, rounded half up where the ledger rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import TOKENS

#: Rate column of each token column; without a reasoning rate the output rate counts.
RATES = dict(zip(TOKENS, ["input_rate", "cached_rate", "write_rate", "output_rate", "reasoning_rate"], strict=True))


def div(value: Column, by: int) -> Column:
    """Whole division of a bigint."""
    return F.call_function("div", value, F.lit(by))


def rate_to_micros(rate: Column) -> Column:
    """Micro-dollars of a decimal-string rate; null where it is no valid rate.

    Digits, and at most six more after a point; no sign, no empty whole part."""
    return F.when(rate.rlike(r"^[0-9]{1,20}(\.[0-9]{0,6})?$"), (F.rtrim(rate, F.lit(".")).cast("decimal(28,6)") * F.lit(1_000_000)).cast("decimal(38,0)"))


def cost_micros(prefix: str = "") -> Column:
    """Micro-dollars of a record's tokens at its rates (decimal micros per million).

    Every category is rounded on its own and then added. A category that holds
    tokens but has no rate leaves the whole record without a price."""
    terms, gaps = [], []
    for tokens, rate in RATES.items():
        n, r = F.col(prefix + tokens), F.col(rate)
        if rate == "reasoning_rate":
            r = F.coalesce(r, F.col("output_rate"))
        used = F.coalesce(n, F.lit(0)) > 0
        product = n.cast("decimal(19,0)") * r.cast("decimal(18,0)") + F.lit(500_000)
        terms.append(F.when(used, F.floor(product / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")))
        gaps.append(used & r.isNull())
    total, gap = terms[0], gaps[0]
    for t, g in zip(terms[1:], gaps[1:], strict=True):
        total, gap = total + t, gap | g
    return F.when(~gap, total.cast("long"))


def weighted(value: Column, basis_points: Column) -> Column:
    """Share of a value by weight, rounded half up; a split need not add up again."""
    product = value.cast("decimal(19,0)") * basis_points.cast("decimal(9,0)") + F.lit(5_000)
    return F.floor(product / F.lit(10_000).cast("decimal(5,0)")).cast("long")


def dollars(micros: Column, decimals: int) -> Column:
    """Micro-dollars as text with so many decimals (6 at most), rounded half up."""
    decimals = min(decimals, 6)
    unit = 10 ** (6 - decimals)
    rounded = div(micros + unit // 2, unit)
    if not decimals:
        return rounded.cast("string")
    scale = 10**decimals
    return F.concat(div(rounded, scale).cast("string"), F.lit("."), F.lpad(F.pmod(rounded, F.lit(scale)).cast("string"), decimals, "0"))


def dollar_text_to_micros(text: Column) -> Column:
    """Micro-dollars of a plain decimal text, half up at the seventh decimal; null where it is none."""
    whole = F.substring_index(text, ".", 1)
    fraction = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
    six = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    up = F.when(F.substring(fraction, 7, 1) >= "5", 1).otherwise(0)
    return F.when(text.rlike(r"^[0-9]{1,12}(\.[0-9]*)?$"), whole.cast("long") * 1_000_000 + six.cast("long") + up)


def float_dollars_to_micros(dollars_: Column) -> Column:
    """Micro-dollars of a number of dollars, to the nearest; negative and non-finite give 0."""
    fine = ~F.isnan(dollars_) & (dollars_ > 0) & (dollars_ < float("inf"))
    return F.when(dollars_.isNotNull(), F.when(fine, F.round(dollars_ * 1e6).cast("long")).otherwise(F.lit(0).cast("long")))


def thousandths(value: Column) -> Column:
    """Nano-dollars, ticks and nano-units to micros, cut off."""
    return div(value, 1000)
