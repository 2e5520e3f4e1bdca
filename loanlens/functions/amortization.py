"""Level-payment loan arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions.numeric import guarded, money


def monthly_rate(annual_percent: Column) -> Column:
    return annual_percent.cast("double") / 1200


def growth(annual_percent: Column, months: Column) -> Column:
    """What one unit grows to after so many months of interest."""
    return F.pow(monthly_rate(annual_percent) + 1, months.cast("double"))


def balance_from_growth(upb: Column, at_term: Column, at_age: Column) -> Column:
    """Scheduled balance from the growth factors at maturity and at the given age."""
    return F.try_divide(upb.cast("double") * (at_term - at_age), at_term - 1)


def scheduled_balance(upb: Column, rate: Column, term: Column, age: Column) -> Column:
    """Balance due after `age` payments; NULL for a zero rate."""
    return balance_from_growth(upb, growth(rate, term), growth(rate, age))


def monthly_payment(upb: Column, rate: Column, term: Column) -> Column:
    """Principal and interest, to the cent; NULL for a zero rate."""
    factor = growth(rate, term)
    return money(F.try_divide(upb.cast("double") * monthly_rate(rate) * factor, factor - 1))


def annual_income(payment: Column, dti: Column) -> Column:
    """Yearly income implied by the debt-to-income ratio (percent)."""
    income = F.try_divide(payment.cast("double") * 1200, dti.cast("double"))
    return guarded(money(income), dti)
