"""Exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def money(value: str | Column) -> Column:
    """Fixed-point copy of an amount, so that sums do not depend on the order of the rows.

    An amount that has none (not a finite number, or 10^32 and more) fails the query instead of leaving the sums.
    """
    amount = F.col(value) if isinstance(value, str) else value
    exact = amount.try_cast(MONEY)
    lost = amount.isNotNull() & exact.isNull()
    return F.when(lost, F.raise_error(F.concat(F.lit("no amount of money: "), amount.cast("string"))).cast(MONEY)).otherwise(
        exact
    )


def money_sum(value: str | Column, where: Column | None = None) -> Column:
    amount = money(value)
    return F.sum(amount if where is None else F.when(where, amount))


def as_amount(total: Column) -> Column:
    """Two-decimal double, the form in which amounts are reported."""
    return F.round(total, 2).cast("double")
