"""Stage 3: loans beside their history.

The history is the large table. It is filtered and pruned in its scan, shuffled once on `loan_id`,
and reduced by a map-side aggregation right after the join. The terminal record is already part of
the universe row, so placing its amounts on one month is a comparison, not another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import amortization, performance
from loanlens.functions.numeric import MONEY, money
from loanlens.functions.periods import add_months
from loanlens.spec import CohortSpec

c = F.col

def usable_history(month: DataFrame) -> DataFrame:
    """Months with an age that is unknown or not negative."""
    return month.filter(c("loan_age").isNull() | (c("loan_age") >= 0))


def with_growth(loans: DataFrame) -> DataFrame:
    """Per-loan growth factor to maturity, so that months only raise the rate to their age."""
    return loans.withColumn("at_term", amortization.growth(c("orig_rate"), c("orig_term")))


def with_payment(loans: DataFrame) -> DataFrame:
    return loans.withColumn(
        "monthly_pi", amortization.monthly_payment(c("orig_upb"), c("orig_rate"), c("orig_term"))
    )


def with_terminal_amounts(loans: DataFrame) -> DataFrame:
    """Defaulted balance, net loss and kind of the terminal event, once per loan.

    Months then carry these few columns instead of every cost and proceeds field.
    """
    return loans.withColumns(
        {
            "default_bal": performance.defaulted_balance(),
            "net_loss": performance.net_loss(),
            "prepaid": performance.is_prepaid(),
            "liquidated": performance.is_liquidated(),
        }
    )


def scheduled_at(age: Column) -> Column:
    at_age = amortization.growth(c("orig_rate"), age)
    return money(amortization.balance_from_growth(c("orig_upb"), c("at_term"), at_age))


def month_columns(needs_age: bool = True, no_loss: Column | None = None) -> dict[str, Column]:
    """Amounts of one loan-month from history, note and terminal columns.

    Terminal amounts count in the terminal month only. `scheduled` must hold the scheduled balance
    wherever the reported one is not positive. `no_loss` is the loss of other months (NULL).
    """
    scheduled = c("scheduled")
    here = c("act_period") == c("term_period")
    paid_off = here & c("prepaid")
    loss = F.when(here & c("liquidated"), c("net_loss"))

    def bucket(status: Column) -> Column:
        return performance.delinquent_balance(status, scheduled, needs_age)

    return {
        "current_bal": performance.filled_balance(scheduled),
        "sched_bal": performance.smm_base(scheduled, F.when(here, c("last_upb"))),
        "unsched_prin": F.when(paid_off, c("last_upb")).otherwise(F.lit(0).cast(MONEY)),
        "unsched_cnt": F.when(paid_off, 1).otherwise(0),
        "dlq_30": bucket(performance.is_30()),
        "dlq_60": bucket(performance.is_60()),
        "dlq_90": bucket(performance.is_90_plus()),
        "defaulted_upb": F.when(here, c("default_bal")),
        "mo_net_loss": loss if no_loss is None else loss.otherwise(no_loss),
        "loan_age": performance.filled_age(),
    }


def with_scheduled(joined: DataFrame) -> DataFrame:
    """Scheduled balance, worked out only for months that do not report a positive balance."""
    reported = F.coalesce(c("current_upb") > 0, F.lit(False))
    return joined.withColumn("scheduled", F.when(~reported, scheduled_at(c("loan_age"))))


#: True on the row that stands for a loan itself, beside its months.
LOAN_ROW = "is_loan"


def _with_months(joined: DataFrame) -> DataFrame:
    """Amounts of each month from loans joined to their history."""
    here = c("act_period") == c("term_period")
    # The loan's whole default and loss count in its terminal month, as the month's amounts do.
    placed = {name: F.when(here, c(name)) for name in ("default_bal", "net_loss")}
    return with_scheduled(joined).withColumns({**month_columns(), **placed})


def loan_months(loans: DataFrame, month: DataFrame) -> DataFrame:
    """One row per loan and month with the amounts of that month.

    An inner join: a loan without history has no age and would be dropped by every age report. A
    loan has one history row per month, so no join key is heavy however large the history is.
    """
    prepared = with_growth(with_terminal_amounts(loans))
    return _with_months(usable_history(month).join(prepared, "loan_id"))


def loans_and_months(loans: DataFrame, month: DataFrame) -> DataFrame:
    """`loan_months`, and for each loan one row more that stands for the loan itself (`LOAN_ROW`).

    Both come from one join, so that a curve's cohort totals need no second pass over the loans: a
    loan enters the join twice, once to meet its months and once to meet nothing. The rows of the
    loans themselves have no age.
    """
    prepared = with_growth(with_terminal_amounts(loans))
    both = prepared.withColumn(LOAN_ROW, F.explode(F.array(F.lit(True), F.lit(False))))
    history = usable_history(month).withColumn("_of_loan", F.lit(False))
    history = history.withColumnRenamed("loan_id", "_loan_id")
    same = (c("loan_id") == c("_loan_id")) & (c(LOAN_ROW) == c("_of_loan"))
    joined = both.join(history, same, "left").where(c(LOAN_ROW) | c("_loan_id").isNotNull())
    rows = _with_months(joined.drop("_loan_id", "_of_loan"))
    # A loan's own row has no month, so its filled age would be unknown in any case.
    return rows.withColumn("loan_age", F.when(~c(LOAN_ROW), c("loan_age")))


def loan_flags(month: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row per loan that was ever 60+ days late or reached the horizon age.

    One pass over the history answers all existence questions and finds the horizon balance; the
    per-loan maximums are combined before the shuffle.
    """
    at_horizon = c("loan_age") == spec.prepay_horizon
    in_horizon = c("loan_age") <= spec.delinquency_horizon
    late_60 = c("dlq_status") >= performance.DLQ_60
    late_120 = c("dlq_status") >= performance.DLQ_120
    return (
        month.filter(at_horizon | late_60)
        .groupBy("loan_id")
        .agg(
            F.max(F.when(late_60 & in_horizon, 1)).alias("ever_60_horizon"),
            F.max(F.when(late_60, 1)).alias("ever_60"),
            F.max(F.when(late_120 & in_horizon, 1)).alias("ever_120_horizon"),
            F.max(F.when(at_horizon, c("act_period").cast("int"))).alias("horizon_period"),
            F.max(F.when(at_horizon, c("current_upb"))).alias("horizon_upb"),
        )
    )


def seasoned(loans_first_pay: Column, max_period: Column, spec: CohortSpec) -> Column:
    """Loan is old enough for the prepayment horizon.

    By default any loan that had started paying by the last period; `seasoned_only` asks for the
    full horizon.
    """
    if spec.seasoned_only:
        return loans_first_pay <= add_months(max_period, -(spec.prepay_horizon - 1))
    return loans_first_pay <= max_period


def with_horizon(
    loans: DataFrame, month: DataFrame, max_period: Column, spec: CohortSpec, filled: bool = True
) -> DataFrame:
    """Loans with delinquency flags and with actual and scheduled balance at the horizon age.

    With `filled`, a masked zero balance becomes the scheduled one.
    """
    joined = with_growth(loans).join(loan_flags(month, spec), "loan_id", "left")
    scheduled = scheduled_at(F.lit(spec.prepay_horizon))
    balance = c("horizon_upb")
    if filled:
        balance = F.when(balance == 0, scheduled).otherwise(balance)
    return joined.withColumns(
        {
            "horizon_bal": balance,
            "horizon_sched": F.when(seasoned(c("first_pay"), max_period, spec), scheduled),
        }
    )
