"""Exact money and rounding.

Amounts are summed as whole cents (bigint), which no order of addition can
change, and every rounded ratio is taken by integer division, half away from
zero.  A lost and re-run task therefore gives the same digits.  ANSI mode turns
an overflow of a single sum (92 quadrillion units of money) into an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(28,0)"


def cents(amount: Column | str) -> Column:
    """Amount of money to whole cents."""
    col = F.col(amount) if isinstance(amount, str) else amount
    return (col.cast("decimal(18,2)") * 100).cast("bigint")


def amount(whole_cents: Column) -> Column:
    """Whole cents to an amount as decimal(18,2)."""
    return (whole_cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def money(whole_cents: Column | str) -> Column:
    """Whole cents to an amount as double."""
    col = F.col(whole_cents) if isinstance(whole_cents, str) else whole_cents
    return col.cast("double") / F.lit(100.0)


def _wide(value: Column | int) -> Column:
    return F.lit(value).cast(WIDE) if isinstance(value, int) else value.cast(WIDE)


def ratio_units(num: Column, den: Column | int, digits: int = 0) -> Column:
    """round(num / den, digits) counted in units of the last digit; NULL when den is 0.

    ``num`` and ``den`` are whole numbers.
    """
    n, below = _wide(num), _wide(den)
    n = F.when(below < 0, -n).otherwise(n)
    d = F.nullif(F.abs(below), F.lit(Decimal(0)).cast(WIDE))
    twice = F.lit(Decimal(2 * 10**digits))
    size = F.call_function("div", F.abs(n) * twice + d, d * F.lit(Decimal(2)))
    return F.when(n < 0, -size).otherwise(size)


def ratio_round(num: Column, den: Column | int, digits: int = 0) -> Column:
    """round(num / den, digits) as double, half away from zero; NULL when den is 0."""
    units = ratio_units(num, den, digits).cast("double")
    return units / F.lit(float(10**digits)) if digits else units


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; NULL when one side is constant."""
    x, y = x.cast("double"), y.cast("double")
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
