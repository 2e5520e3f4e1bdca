"""Loan tables derived from the order/customer/lineitem star schema.

Every order is a loan, its order lines from the order date on are its history. Codes come from
the order key so that all branches of the cohort logic occur. Money is rounded down to whole
units, never to a tie, so that engines agree on it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.functions.numeric import MONEY, money
from loanlens.functions.periods import date_month_index, period_of_index

c = F.col

# Fixed values of the derivation.
# fmt: off
STATES = (
    "CA", "TX", "FL", "AZ", "CO", "WA", "GA", "NC", "VA", "NY", "UT", "NJ", "PA", "IL", "TN", "OR",
    "MD", "MI", "OH", "MN", "NV", "SC", "PR", "VI", "WY",
)
# fmt: on
DLQ_CODES = ("00", "01", "02", "03", "XX")


def _mapped(key: Column, table: Mapping[int, object], default: object) -> Column:
    result = F.lit(default)
    for value, mapped in reversed(table.items()):
        result = F.when(key == value, F.lit(mapped)).otherwise(result)
    return result


class StarSchema:
    """The parquet files of one folder; each is opened once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root = spark, root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._spark.read.parquet(f"{self._root}/{name}.parquet")
        return self._frames[name]


def _orders(source: StarSchema) -> DataFrame:
    k = c("o_orderkey")
    return source.table("orders").select(
        k.alias("loan_id"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        c("o_orderdate").cast("date").alias("order_day"),
        c("o_totalprice").alias("price"),
        money(c("o_totalprice")).alias("orig_upb"),
        (date_month_index(c("o_orderdate")) + 2).alias("first_pay_index"),
        _mapped(k % 10, {0: 120, 1: 180, 2: 200, 3: 240, 4: 480}, 360).alias("orig_term"),
    )


def _zero_balance_code(k: Column) -> Column:
    residue = k % 20
    return (
        F.when(residue <= 7, "01")
        .when(residue == 8, "02")
        .when(residue == 9, "03")
        .when(residue == 10, "09")
        .when(residue == 11, "15")
        .when(residue == 12, "06")
    )


def orig(source: StarSchema) -> DataFrame:
    customer = source.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = source.table("nation").select("n_nationkey", "n_regionkey")
    k = c("loan_id")
    odd_one = F.lit(None).cast("int")
    joined = (
        _orders(source)
        .join(customer, c("o_custkey") == c("c_custkey"))
        .join(nation, c("c_nationkey") == c("n_nationkey"))
        .withColumn("oltv", (c("o_custkey") % 58 + 40).cast("int"))
    )
    segment = c("c_mktsegment")
    return joined.select(
        k,
        period_of_index(c("first_pay_index") - 2).alias("orig_date"),
        period_of_index(c("first_pay_index")).alias("first_pay"),
        "orig_term",
        (F.lit(2).cast("decimal(5,3)") + (k % 33) * F.lit("0.125").cast("decimal(4,3)"))
        .cast("decimal(5,3)")
        .alias("orig_rate"),
        "orig_upb",
        F.when(c("o_orderstatus") == "P", "R")
        .when(c("o_orderstatus") == "F", "B")
        .otherwise("C")
        .alias("channel"),
        F.when(c("price") > 450000, "Y").otherwise("N").alias("high_balance_loan_indicator"),
        F.when(k % 101 == 0, F.lit(None).cast("string"))
        .when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Y")
        .otherwise("N")
        .alias("first_flag"),
        F.when(segment == "MACHINERY", F.lit(None).cast("string"))
        .when(segment == "HOUSEHOLD", "Other")
        .otherwise(segment)
        .alias("seller"),
        F.concat(F.lit("SVC_"), c("n_regionkey").cast("string")).alias("servicer"),
        F.get(F.array(*[F.lit(x) for x in STATES]), c("c_nationkey").cast("int")).alias("state"),
        F.when(k % 11 == 0, odd_one).otherwise(k % 41 + 10).cast("int").alias("dti"),
        "oltv",
        F.when(k % 4 == 0, odd_one).otherwise(c("oltv") + k % 8).cast("int").alias("ocltv"),
        F.when(k % 53 == 0, odd_one).otherwise(k * 7 % 221 + 600).cast("int").alias("cscore_b"),
        F.when(k % 2 == 0, odd_one).otherwise(k * 13 % 231 + 590).cast("int").alias("cscore_c"),
        F.when(k % 17 == 0, 2).otherwise(1).alias("no_units"),
        (k % 2 + 1).cast("int").alias("num_bo"),
        _mapped(k % 7, {4: "CO", 5: "MH", 3: "PU"}, "SF").alias("prop"),
        _mapped(k % 9, {3: "S", 6: "I"}, "P").alias("occ_stat"),
        _mapped(k % 3, {0: "P", 1: "C"}, "R").alias("purpose"),
        F.when(c("oltv") > 80, F.when(k % 3 == 0, 2).otherwise(1)).alias("mi_type"),
        F.when(c("oltv") > 80, 25).alias("mi_pct"),
        F.when(k % 12 == 0, "W")
        .when(k % 12 == 1, "P")
        .when(k % 12 == 2, F.lit(None).cast("string"))
        .otherwise("A")
        .alias("property_inspection_waiver_indicator"),
        *[
            F.when(k % divisor == 0, "Y")
            .when(k % 5 == 0, F.lit(None).cast("string"))
            .otherwise("N")
            .alias(flag)
            for flag, divisor in (("ppmt_flg", 97), ("io", 89))
        ],
    )


def _history_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines shipped on or after the order date, beside their order."""
    return lines.join(orders, c("l_orderkey") == c("loan_id")).filter(
        c("l_shipdate").cast("date") >= c("order_day")
    )


def _balance(age: Column) -> Column:
    left = F.greatest(c("orig_term") - age, F.lit(0)).cast("double")
    return F.floor(c("orig_upb").cast("double") * left / c("orig_term")).cast(MONEY)


def month(source: StarSchema) -> DataFrame:
    orders = _orders(source).select(
        "loan_id", "order_day", "orig_upb", "orig_term", "first_pay_index"
    )
    status = (
        F.when(c("l_quantity") == 50, 4)
        .when(c("l_linenumber").isin(5, 6, 7), c("l_linenumber") - 4)
        .otherwise(0)
    )
    grain = ("loan_id", "orig_upb", "orig_term", "first_pay_index", "period_index")
    lines = source.table("lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_linenumber"
    )
    rows = (
        _history_lines(lines, orders)
        .withColumn("period_index", date_month_index(c("l_shipdate")))
        .groupBy(*grain)
        .agg(F.max(status).alias("status"))
        .withColumn(
            "last_index", F.max("period_index").over(Window.partitionBy("loan_id"))
        )
        .withColumn("age", c("period_index") - c("first_pay_index") + 1)
        .withColumn(
            "code", F.when(c("period_index") == c("last_index"), _zero_balance_code(c("loan_id")))
        )
    )
    closed = c("code").isNotNull()
    return rows.select(
        "loan_id",
        period_of_index(c("period_index")).alias("act_period"),
        F.when(closed & (c("code") != "01"), F.lit(None).cast("int"))
        .otherwise(c("age"))
        .cast("int")
        .alias("loan_age"),
        F.when(closed | (c("age") < 6), F.lit(0).cast(MONEY))
        .otherwise(_balance(c("age")))
        .alias("current_upb"),
        F.element_at(F.array(*map(F.lit, DLQ_CODES)), c("status") + 1).alias("dlq_status"),
    )


def term(source: StarSchema) -> DataFrame:
    orders = (
        _orders(source)
        .withColumn("zero_bal_code", _zero_balance_code(c("loan_id")))
        .filter(c("zero_bal_code").isNotNull())
        .select(
            "loan_id", "order_day", "orig_upb", "orig_term", "first_pay_index", "zero_bal_code"
        )
    )
    # If any line of an order is in its history, the last one is, so that each order sends and joins
    # one line. Equal orders are one loan: one sort tells that and serves the joins on `loan_id`.
    lines = source.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    grain = ("loan_id", "orig_upb", "orig_term", "first_pay_index", "zero_bal_code")
    latest_first = Window.partitionBy(*grain).orderBy(c("period_index").desc())
    last_months = (
        _history_lines(lines, orders)
        .withColumn("period_index", date_month_index(c("l_shipdate")))
        .withColumn("_nth", F.row_number().over(latest_first))
        .filter(c("_nth") == 1)
        .select(*grain, "period_index")
    )
    k = c("loan_id")
    none = F.lit(0).cast(MONEY)
    unknown = F.lit(None)
    disposed = (c("zero_bal_code") != "01") & (k % 40 != 8)
    closed = last_months.select(
        k,
        period_of_index(c("period_index")).alias("act_period"),
        "zero_bal_code",
        _balance(c("period_index") - c("first_pay_index") + 1).alias("last_upb"),
    )
    balance = c("last_upb").cast("double")
    date = F.when(disposed, c("act_period"))
    return closed.select(
        k,
        "act_period",
        c("act_period").alias("zb_dte"),
        "zero_bal_code",
        "last_upb",
        date.alias("foreclosure_date"),
        date.alias("disposition_date"),
        F.when(k % 13 == 0, unknown.cast(MONEY))
        .otherwise(F.floor(balance * 0.02).cast(MONEY))
        .alias("foreclosure_costs"),
        none.alias("property_preservation_and_repair_costs"),
        none.alias("asset_recovery_costs"),
        none.alias("miscellaneous_holding_expenses_and_credits"),
        none.alias("associated_taxes_for_holding_property"),
        F.floor(balance * (k % 60 + 60).cast("double") / 100)
        .cast(MONEY)
        .alias("net_sales_proceeds"),
        none.alias("credit_enhancement_proceeds"),
        none.alias("repurchases_make_whole_proceeds"),
        none.alias("other_foreclosure_proceeds"),
    )


