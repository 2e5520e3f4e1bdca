"""Per-month and terminal amounts of one loan.

The history table reports a zero balance in a loan's first months and no age in a foreclosure
month, so both are filled in from the note terms. Terminal amounts are read from columns of the
terminal record; callers null them outside the terminal month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions.numeric import guarded
from loanlens.functions.periods import month_index

c = F.col

# Codes of the terminal record and of the delinquency status.
PREPAID_CODE = 1
CREDIT_EVENT_CODES = ("02", "03", "09", "15")
DLQ_30 = "01"
DLQ_60 = "02"
DLQ_90 = "03"
DLQ_120 = "04"

COSTS = (
    "foreclosure_costs",
    "property_preservation_and_repair_costs",
    "asset_recovery_costs",
    "miscellaneous_holding_expenses_and_credits",
    "associated_taxes_for_holding_property",
)
PROCEEDS = (
    "net_sales_proceeds",
    "credit_enhancement_proceeds",
    "repurchases_make_whole_proceeds",
    "other_foreclosure_proceeds",
)


def filled_age() -> Column:
    """Reported age, else months from first payment to the reporting month, plus one."""
    elapsed = month_index(c("act_period")) - month_index(c("first_pay")) + 1
    return F.coalesce(c("loan_age"), elapsed)


def filled_balance(scheduled: Column) -> Column:
    """Reported balance; a masked zero becomes the scheduled balance."""
    masked = (c("current_upb") == 0) & c("loan_age").isNotNull()
    return F.when(masked, scheduled).otherwise(c("current_upb"))


def smm_base(scheduled: Column, last_upb: Column) -> Column:
    """Balance exposed to prepayment: as above, but a zero without age is the terminal balance."""
    zero = c("current_upb") == 0
    return (
        F.when(zero & c("loan_age").isNotNull(), scheduled)
        .when(zero, last_upb)
        .otherwise(c("current_upb"))
    )


def delinquent_balance(status: Column, scheduled: Column, needs_age: bool = True) -> Column:
    """Balance counted in a delinquency bucket, 0 when the month is not in it."""
    counted = status & c("loan_age").isNotNull() if needs_age else status
    balance = F.when(c("current_upb") > 0, c("current_upb")).otherwise(scheduled)
    return F.when(counted, balance).otherwise(F.lit(0).cast("decimal(18,2)"))


def is_30() -> Column:
    return c("dlq_status") == DLQ_30


def is_60() -> Column:
    return c("dlq_status") == DLQ_60


def is_90_plus() -> Column:
    """Text comparison on purpose: codes that start with a letter count as 90+."""
    return c("dlq_status") >= DLQ_90


def code_number() -> Column:
    return c("zero_bal_code").try_cast("int")


def is_default() -> Column:
    """Credit event with the property disposed of."""
    return c("zero_bal_code").isin(*CREDIT_EVENT_CODES) & c("disposition_date").isNotNull()


def defaulted_balance() -> Column:
    return F.when(is_default(), c("last_upb"))


def is_prepaid() -> Column:
    return F.coalesce(code_number() == PREPAID_CODE, F.lit(False))


def is_liquidated() -> Column:
    """Ended for another reason than a prepayment, so that the month has a loss."""
    return F.coalesce(code_number() > PREPAID_CODE, F.lit(False))


def _total(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [c(name) for name in names])


def _shortfall() -> Column:
    return c("last_upb") + _total(COSTS) - _total(PROCEEDS)


def net_loss() -> Column:
    """Loss on liquidation, never negative; NULL when any component is missing."""
    shortfall = _shortfall().cast("decimal(18,2)")
    return guarded(F.greatest(F.lit(0).cast("decimal(18,2)"), shortfall), shortfall)


def legacy_net_loss() -> Column:
    """Same amount with the opposite sign: a loss is negative, a gain is 0."""
    surplus = (-_shortfall()).cast("decimal(18,2)")
    return guarded(F.least(F.lit(0).cast("decimal(18,2)"), surplus), surplus)


def monthly_net_loss() -> Column:
    """Loss of a liquidated loan; NULL for the others."""
    return F.when(is_liquidated(), net_loss())


def cpr_from_smm(smm: Column) -> Column:
    """Annualised prepayment speed."""
    return 1 - F.pow(1 - smm, F.lit(12.0))


def horizon_cpr(actual: Column, scheduled: Column, months: int) -> Column:
    """Annual speed that takes the scheduled balance to the actual one over the horizon."""
    kept = F.try_divide(actual.cast("double"), scheduled.cast("double"))
    return 1 - F.pow(kept, F.lit(12.0 / months))
