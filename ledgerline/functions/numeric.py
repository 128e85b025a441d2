"""Null-honest arithmetic: missing stays missing, nothing throws."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,4)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_num(c: Column | str) -> Column:
    """A double, or NULL for text, NaN and infinities."""
    d = col(c).try_cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(d.isNotNull() & finite, d)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / b``; NULL when either is missing or the divisor is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def truthy(c: Column | str) -> Column:
    """The value, with zero counted as missing."""
    return F.nullif(col(c), F.lit(0.0))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def positive(c: Column | str) -> Column:
    """True only for a known value above zero."""
    return F.coalesce(col(c) > 0, F.lit(False))


def exact_sum(c: Column | str) -> Column:
    """Sum money as decimals, so the result does not depend on row order."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def exact_total(cols: Iterable[Column]) -> Column:
    """Row-wise sum of money columns as decimals; NULL if any is NULL."""
    cols = [c.cast(MONEY) for c in cols]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total.cast("double")


def exact_minus(a: Column | str, b: Column | str) -> Column:
    return (col(a).cast(MONEY) - col(b).cast(MONEY)).cast("double")


def round_half_up(c: Column, digits: int) -> Column:
    """Round through a decimal, where every engine rounds halves up."""
    return c.cast(f"decimal(28,{digits})").cast("double")


def growth(value: Column | str, prior: Column | str) -> Column:
    """Change over the absolute prior value."""
    return safe_div(col(value) - col(prior), F.abs(col(prior)))


def money_text(c: Column | str) -> Column:
    """``$1.23B`` style text; whole dollars below a million, N/A when missing."""
    v = col(c)
    size = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))

    def scaled(unit: float, suffix: str) -> Column:
        amount = (size / F.lit(unit)).cast("decimal(28,2)")
        return F.concat(sign, F.lit("$"), F.format_number(amount, 2), F.lit(suffix))

    return (
        F.when(v.isNull(), F.lit("N/A"))
        .when(size >= 1e12, scaled(1e12, "T"))
        .when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .otherwise(F.concat(sign, F.lit("$"), F.format_number(size.cast("decimal(28,0)"), 0)))
    )


def confidence_of(*parts: Column, factor: float = 1.0) -> Column:
    """Combine confidences: the weakest input, scaled."""
    weakest = F.least(*parts) if len(parts) > 1 else parts[0]
    return weakest * F.lit(factor)
