"""Explicit schemas of the three loan tables. Months are yyyyMM text."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(name, kind, False) for name, kind in required.items()]
    fields += [T.StructField(name, kind, True) for name, kind in optional.items()]
    return T.StructType(fields)


_text, _int = T.StringType(), T.IntegerType()

ORIG = _struct(
    {
        "loan_id": T.LongType(),
        "orig_date": _text,
        "first_pay": _text,
        "orig_term": _int,
        "orig_rate": T.DecimalType(5, 3),
        "orig_upb": _MONEY,
    },
    {
        "channel": _text,
        "high_balance_loan_indicator": _text,
        "first_flag": _text,
        "seller": _text,
        "servicer": _text,
        "state": _text,
        "dti": _int,
        "oltv": _int,
        "ocltv": _int,
        "cscore_b": _int,
        "cscore_c": _int,
        "no_units": _int,
        "num_bo": _int,
        "prop": _text,
        "occ_stat": _text,
        "purpose": _text,
        "mi_type": _int,
        "mi_pct": _int,
        "property_inspection_waiver_indicator": _text,
        "ppmt_flg": _text,
        "io": _text,
    },
)

MONTH = _struct(
    {"loan_id": T.LongType(), "act_period": _text},
    {"loan_age": _int, "current_upb": _MONEY, "dlq_status": _text},
)

TERM = _struct(
    {"loan_id": T.LongType(), "act_period": _text, "zb_dte": _text, "zero_bal_code": _text},
    {
        "last_upb": _MONEY,
        "foreclosure_date": _text,
        "disposition_date": _text,
        "foreclosure_costs": _MONEY,
        "property_preservation_and_repair_costs": _MONEY,
        "asset_recovery_costs": _MONEY,
        "miscellaneous_holding_expenses_and_credits": _MONEY,
        "associated_taxes_for_holding_property": _MONEY,
        "net_sales_proceeds": _MONEY,
        "credit_enhancement_proceeds": _MONEY,
        "repurchases_make_whole_proceeds": _MONEY,
        "other_foreclosure_proceeds": _MONEY,
    },
)

SCHEMAS = {"orig": ORIG, "month": MONTH, "term": TERM}
