"""Common table expressions shared by the SQL answers.

The SQL runs in DuckDB over the star-schema views. It works on plain rows: percentiles are window
functions, existence tests are EXISTS, cohort totals are subqueries. Nothing is pre-aggregated.
"""

from __future__ import annotations

# The state of each nation, in the order of the nations' keys.
# fmt: off
STATES = (
    "CA", "TX", "FL", "AZ", "CO", "WA", "GA", "NC", "VA", "NY", "UT", "NJ", "PA", "IL", "TN", "OR",
    "MD", "MI", "OH", "MN", "NV", "SC", "PR", "VI", "WY",
)
# fmt: on
STATE_LIST = ", ".join(f"'{state}'" for state in STATES)

# --- loan tables from the star schema -------------------------------------------------------------

TABLES = f"""
orig AS (
  SELECT o_orderkey AS loan_id,
    strftime(o_orderdate, '%Y%m') AS orig_date,
    strftime(o_orderdate + INTERVAL 2 MONTH, '%Y%m') AS first_pay,
    CASE o_orderkey % 10 WHEN 0 THEN 120 WHEN 1 THEN 180 WHEN 2 THEN 200 WHEN 3 THEN 240
      WHEN 4 THEN 480 ELSE 360 END AS orig_term,
    CAST(2.000 + 0.125 * (o_orderkey % 33) AS DECIMAL(5,3)) AS orig_rate,
    CAST(o_totalprice AS DECIMAL(18,2)) AS orig_upb,
    CASE o_orderstatus WHEN 'P' THEN 'R' WHEN 'F' THEN 'B' ELSE 'C' END AS channel,
    CASE WHEN o_totalprice > 450000 THEN 'Y' ELSE 'N' END AS high_balance_loan_indicator,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL
      WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS first_flag,
    CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN 'Other'
      ELSE c_mktsegment END AS seller,
    'SVC_' || n_regionkey AS servicer,
    ([{STATE_LIST}])[c_nationkey + 1] AS state,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 10 + o_orderkey % 41 END AS dti,
    40 + o_custkey % 58 AS oltv,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL
      ELSE 40 + o_custkey % 58 + o_orderkey % 8 END AS ocltv,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 600 + (7 * o_orderkey) % 221 END AS cscore_b,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 590 + (13 * o_orderkey) % 231 END AS cscore_c,
    CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS no_units,
    1 + o_orderkey % 2 AS num_bo,
    CASE o_orderkey % 7 WHEN 4 THEN 'CO' WHEN 5 THEN 'MH' WHEN 3 THEN 'PU' ELSE 'SF' END AS prop,
    CASE o_orderkey % 9 WHEN 3 THEN 'S' WHEN 6 THEN 'I' ELSE 'P' END AS occ_stat,
    CASE o_orderkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'R' END AS purpose,
    CASE WHEN 40 + o_custkey % 58 > 80
      THEN CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END END AS mi_type,
    CASE WHEN 40 + o_custkey % 58 > 80 THEN 25 END AS mi_pct,
    CASE o_orderkey % 12 WHEN 0 THEN 'W' WHEN 1 THEN 'P' WHEN 2 THEN NULL ELSE 'A'
      END AS property_inspection_waiver_indicator,
    CASE WHEN o_orderkey % 97 = 0 THEN 'Y' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'N'
      END AS ppmt_flg,
    CASE WHEN o_orderkey % 89 = 0 THEN 'Y' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'N' END AS io
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
grain AS (
  SELECT l_orderkey AS loan_id, strftime(l_shipdate, '%Y%m') AS act_period,
    max(CASE WHEN l_quantity = 50 THEN 'XX' WHEN l_linenumber = 5 THEN '01'
      WHEN l_linenumber = 6 THEN '02' WHEN l_linenumber = 7 THEN '03' ELSE '00' END) AS dlq_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate >= o_orderdate
  GROUP BY 1, 2
),
placed AS (
  SELECT g.*, o.orig_upb, o.orig_term,
    12 * (CAST(substr(act_period, 1, 4) AS INT) - CAST(substr(first_pay, 1, 4) AS INT))
      + CAST(substr(act_period, 5, 2) AS INT) - CAST(substr(first_pay, 5, 2) AS INT) + 1 AS age,
    CASE WHEN act_period = max(act_period) OVER (PARTITION BY loan_id) THEN
      CASE WHEN loan_id % 20 <= 7 THEN '01' WHEN loan_id % 20 = 8 THEN '02'
        WHEN loan_id % 20 = 9 THEN '03' WHEN loan_id % 20 = 10 THEN '09'
        WHEN loan_id % 20 = 11 THEN '15' WHEN loan_id % 20 = 12 THEN '06' END END AS code
  FROM grain g JOIN orig o USING (loan_id)
),
valued AS (
  SELECT *, CAST(floor(CAST(orig_upb AS DOUBLE) * greatest(orig_term - age, 0) / orig_term)
    AS DECIMAL(18,2)) AS bal
  FROM placed
),
month AS (
  SELECT loan_id, act_period,
    CASE WHEN code IS NOT NULL AND code <> '01' THEN NULL ELSE age END AS loan_age,
    CASE WHEN code IS NOT NULL OR age < 6 THEN CAST(0 AS DECIMAL(18,2)) ELSE bal END AS current_upb,
    dlq_status
  FROM valued
),
term AS (
  SELECT loan_id, act_period, act_period AS zb_dte, code AS zero_bal_code, bal AS last_upb,
    CASE WHEN code <> '01' AND loan_id % 40 <> 8 THEN act_period END AS foreclosure_date,
    CASE WHEN code <> '01' AND loan_id % 40 <> 8 THEN act_period END AS disposition_date,
    CASE WHEN loan_id % 13 = 0 THEN NULL
      ELSE CAST(floor(CAST(bal AS DOUBLE) * 0.02) AS DECIMAL(18,2)) END AS foreclosure_costs,
    CAST(0 AS DECIMAL(18,2)) AS property_preservation_and_repair_costs,
    CAST(0 AS DECIMAL(18,2)) AS asset_recovery_costs,
    CAST(0 AS DECIMAL(18,2)) AS miscellaneous_holding_expenses_and_credits,
    CAST(0 AS DECIMAL(18,2)) AS associated_taxes_for_holding_property,
    CAST(floor(CAST(bal AS DOUBLE) * (60 + loan_id % 60) / 100) AS DECIMAL(18,2))
      AS net_sales_proceeds,
    CAST(0 AS DECIMAL(18,2)) AS credit_enhancement_proceeds,
    CAST(0 AS DECIMAL(18,2)) AS repurchases_make_whole_proceeds,
    CAST(0 AS DECIMAL(18,2)) AS other_foreclosure_proceeds
  FROM valued WHERE code IS NOT NULL
)"""

# --- derived attributes ---------------------------------------------------------------------------


def amortized(age: str) -> str:
    rate = "(CAST(orig_rate AS DOUBLE) / 1200 + 1)"
    return (
        f"CAST(orig_upb AS DOUBLE) * (pow({rate}, orig_term) - pow({rate}, {age}))"
        f" / (pow({rate}, orig_term) - 1)"
    )


PAYMENT = (
    "CAST(CAST(orig_upb AS DOUBLE) * (CAST(orig_rate AS DOUBLE) / 1200)"
    " * pow(CAST(orig_rate AS DOUBLE) / 1200 + 1, orig_term)"
    " / (pow(CAST(orig_rate AS DOUBLE) / 1200 + 1, orig_term) - 1) AS DECIMAL(18,2))"
)

# Steps: fill the missing inputs; name the rule triggers; test the rules.
ATTRIBUTES = f"""
filled AS (
  SELECT *, substr(orig_date, 1, 4) AS vintage,
    CASE WHEN orig_term > 360 THEN 480 WHEN orig_term > 240 THEN 360 WHEN orig_term > 180 THEN 240
      ELSE 180 END AS loan_term,
    CASE WHEN orig_term > 240 THEN 360 WHEN orig_term > 180 THEN 240 ELSE 180 END AS legacy_term,
    CASE WHEN occ_stat = 'S' THEN 'Y' ELSE 'N' END AS second_home,
    CASE WHEN mi_type = 1 THEN 'Y' ELSE 'N' END AS mi_flag,
    CASE WHEN cscore_b IS NULL THEN NULL WHEN cscore_c < cscore_b THEN cscore_c
      ELSE cscore_b END AS qfico,
    coalesce(oltv, 100) AS ltv_in, coalesce(ocltv, oltv, 100) AS cltv_in,
    coalesce(dti, 100) AS dti_in, coalesce(property_inspection_waiver_indicator, 'A') AS appr_in,
    {PAYMENT} AS monthly_pi
  FROM orig
),
triggered AS (
  SELECT *, ltv_in > 65 AS t3,
    coalesce(purpose = 'C' AND cltv_in >= 80 AND orig_term >= 240, false)
      OR coalesce(prop = 'CO' AND ltv_in >= 80, false)
      OR coalesce(no_units >= 2 AND ltv_in >= 75, false)
      OR coalesce(ocltv < 90 AND oltv >= 70, false) AS t5,
    coalesce(ocltv >= 90 AND oltv >= 70, false) AS t6
  FROM filled
),
ruled AS (
  SELECT *,
    coalesce(occ_stat <> 'I' AND dti_in <= 45 AND cltv_in <= 95 AND qfico >= 640
      AND prop <> 'MH' AND state NOT IN ('PR', 'VI') AND appr_in = 'A', false)
      AND NOT (t3 AND NOT coalesce(qfico >= 660, false))
      AND NOT (t5 AND NOT coalesce(cscore_b >= 700 AND dti_in <= 45, false))
      AND NOT (t6 AND NOT coalesce(cscore_b >= 720 AND dti_in <= 43, false)) AS passes
  FROM triggered
),
attr AS (
  SELECT *,
    CASE WHEN passes THEN 'Y' ELSE 'N' END AS eligible,
    CASE WHEN passes AND coalesce(ppmt_flg, 'N') = 'N' AND coalesce(io, 'N') = 'N'
      THEN 'Y' ELSE 'N' END AS legacy_eligible,
    CASE WHEN t3 AND qfico < 660 THEN 'Y' ELSE 'N' END AS inel_b3,
    CASE WHEN t5 AND (cscore_b < 700 OR dti_in > 45) THEN 'Y' ELSE 'N' END AS inel_b5,
    CASE WHEN t6 AND (cscore_b < 720 OR dti_in > 43) THEN 'Y' ELSE 'N' END AS inel_b6,
    CASE WHEN qfico < 760 AND cltv_in >= 85 THEN 'Y' ELSE 'N' END AS sublimit_a,
    CASE WHEN qfico < 720 AND cltv_in BETWEEN 75 AND 84 THEN 'Y' ELSE 'N' END AS sublimit_b
  FROM ruled
),
loss AS (
  SELECT *, last_upb + foreclosure_costs + property_preservation_and_repair_costs
      + asset_recovery_costs + miscellaneous_holding_expenses_and_credits
      + associated_taxes_for_holding_property
      - (net_sales_proceeds + credit_enhancement_proceeds + repurchases_make_whole_proceeds
      + other_foreclosure_proceeds) AS gap
  FROM term
),
closed AS (
  SELECT loan_id, act_period AS term_period, zb_dte, zero_bal_code, last_upb, disposition_date,
    CASE WHEN gap IS NULL THEN NULL WHEN gap > 0 THEN gap ELSE 0 END AS net_loss,
    CASE WHEN zero_bal_code IN ('02', '03', '09', '15') AND disposition_date IS NOT NULL
      THEN last_upb END AS defaulted
  FROM loss
),
everyone AS (SELECT * FROM attr LEFT JOIN closed USING (loan_id)),
u AS (SELECT * FROM everyone WHERE zb_dte IS NULL OR zb_dte > first_pay)"""

PERCENTILES = """
ranked AS (
  SELECT *, percent_rank() OVER (PARTITION BY high_balance_loan_indicator, vintage
      ORDER BY orig_upb NULLS FIRST) AS any_pctile,
    percent_rank() OVER (PARTITION BY vintage ORDER BY orig_rate NULLS FIRST) AS orig_rate_pctile
  FROM u
),
p AS (
  SELECT *,
    CASE WHEN coalesce(high_balance_loan_indicator, 'N') = 'N' THEN any_pctile
      END AS orig_upb_pctile,
    CASE WHEN high_balance_loan_indicator = 'Y' THEN 'SUPER' WHEN any_pctile < 0.10 THEN 'VLOW'
      WHEN any_pctile < 0.40 THEN 'LOW' WHEN any_pctile < 0.80 THEN 'MED' ELSE 'HIGH'
      END AS pctile_seg,
    CASE WHEN high_balance_loan_indicator = 'Y' THEN 'SUPER' WHEN orig_upb > 300000 THEN 'HIGH'
      WHEN orig_upb > 150000 THEN 'MED' WHEN orig_upb > 80000 THEN 'LOW' ELSE 'VLOW' END AS cut_seg
  FROM ranked
)"""

STEP_SEGMENT = "CASE WHEN high_balance_loan_indicator = 'Y' THEN 'SUPER' " + " ".join(
    f"WHEN orig_upb <= {int(step)}000 THEN '{step}K'"
    for step in ("085", "110", "125", "150", "175", "200", "225", "250", "275", "500")
) + " ELSE 'CONF' END"

# --- loan-months ----------------------------------------------------------------------------------


def months(source: str = "u", name: str = "lm") -> str:
    """CTE `name`: loans of `source` with each month's amounts; terminal amounts on one month."""
    amort = f"CAST({amortized('h.loan_age')} AS DECIMAL(18,2))"
    here = "h.act_period = s.term_period"

    def bucket(status: str) -> str:
        return (
            f"CASE WHEN {status} AND h.loan_age IS NOT NULL THEN"
            f" CASE WHEN h.current_upb > 0 THEN h.current_upb ELSE {amort} END ELSE 0 END"
        )

    return f"""
{name} AS (
  SELECT s.*, h.act_period,
    coalesce(h.loan_age,
      12 * (CAST(substr(h.act_period, 1, 4) AS INT) - CAST(substr(first_pay, 1, 4) AS INT))
      + CAST(substr(h.act_period, 5, 2) AS INT) - CAST(substr(first_pay, 5, 2) AS INT) + 1
    ) AS loan_age,
    CASE WHEN h.current_upb = 0 AND h.loan_age IS NOT NULL THEN {amort}
      ELSE h.current_upb END AS current_bal,
    CASE WHEN h.current_upb = 0 AND h.loan_age IS NOT NULL THEN {amort}
      WHEN h.current_upb = 0 THEN CASE WHEN {here} THEN last_upb END
      ELSE h.current_upb END AS sched_bal,
    CASE WHEN {here} AND zero_bal_code = '01' THEN last_upb ELSE 0 END AS unsched_prin,
    CASE WHEN {here} AND zero_bal_code = '01' THEN 1 ELSE 0 END AS unsched_cnt,
    {bucket("h.dlq_status = '01'")} AS dlq_30,
    {bucket("h.dlq_status = '02'")} AS dlq_60,
    {bucket("h.dlq_status >= '03'")} AS dlq_90,
    CASE WHEN {here} THEN defaulted END AS defaulted_upb,
    CASE WHEN {here} AND zero_bal_code <> '01' THEN net_loss END AS mo_net_loss
  FROM {source} s JOIN month h ON s.loan_id = h.loan_id
    AND (h.loan_age IS NULL OR h.loan_age >= 0)
)"""


# --- fragments ------------------------------------------------------------------------------------


def r2(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 2)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def quotient(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0)"


def digits(x: str, places: int) -> str:
    return f"format('{{:,.{places}f}}', round(CAST({x} AS DOUBLE), {places}))"


def percent_text(x: str, places: int) -> str:
    return f"({digits(f'({x}) * 100', places)} || '%')"


def share(condition: str, zero: bool = False) -> str:
    value = quotient(f"sum(orig_upb) FILTER (WHERE {condition})", "sum(orig_upb)")
    return r6(f"coalesce({value}, 0)" if zero else value)


def average(x: str) -> str:
    return r6(quotient(f"sum(orig_upb * {x})", f"sum(orig_upb) FILTER (WHERE {x} IS NOT NULL)"))


WA_RATE = quotient("sum(orig_rate * orig_upb)", "sum(orig_upb)")

MEASURES = {
    "loans": "count(*)",
    "orig_upb": r2("sum(orig_upb)"),
    "als": r6(quotient("sum(orig_upb)", "count(*)")),
    "wa_rate_8ths": r6(f"round(8 * ({WA_RATE}), 0) / 8"),
    "rate_range": f"{digits('min(orig_rate)', 3)} || '-' || {digits('max(orig_rate)', 3)}",
    "wa_pi": r2(quotient("sum(monthly_pi * orig_upb)", "sum(orig_upb)")),
    "eligible": "min(eligible)",
    "vintages": "min(vintage) || '-' || max(vintage)",
    "size_range": f"{digits('min(orig_upb) / 1000', 0)} || 'k-' || "
    f"{digits('max(orig_upb) / 1000', 0)} || 'k'",
    "segment_range": f"{digits('min(orig_upb) / 1000', 0)} || 'k - ' || "
    f"{digits('max(orig_upb) / 1000', 0)} || 'k'",
    "segment_pctiles": f"{digits('min(orig_upb_pctile) * 100', 0)} || '-' || "
    f"{digits('max(orig_upb_pctile) * 100', 0)}",
    # shares
    "broker_pct": share("channel = 'B'"),
    "correspondent_pct": share("channel = 'C'"),
    "retail_pct": share("channel = 'R'"),
    "hbal_pct": share("high_balance_loan_indicator = 'Y'", True),
    "second_home_pct": share("occ_stat = 'S'", True),
    "insured_pct": share("mi_type = 1", True),
    "cashout_pct": share("purpose = 'C'", True),
    "first_buyer_pct": share("first_flag = 'Y'", True),
    "condo_pct": share("prop = 'CO'", True),
    "multi_unit_pct": share("no_units > 1", True),
    "multi_borrower_pct": share("num_bo > 1", True),
    "inel_pct": share("eligible = 'N'", True),
    "investor_pct": share("occ_stat = 'I'"),
    "score_lt_640_pct": share("qfico < 640"),
    "ltv_gt_95_pct": share("cltv_in > 95"),
    "dti_gt_45_pct": share("dti > 45"),
    "mh_pct": share("prop = 'MH'"),
    "pr_vi_pct": share("state IN ('PR', 'VI')"),
    "appr_not_full_pct": share("appr_in <> 'A'"),
    "appr_waiver_pct": share("appr_in = 'W'"),
    "inel_b3_pct": share("inel_b3 = 'Y'"),
    "inel_b5_pct": share("inel_b5 = 'Y'"),
    "inel_b6_pct": share("inel_b6 = 'Y'"),
    "sublimit_a_pct": share("sublimit_a = 'Y'", True),
    "sublimit_b_pct": share("sublimit_b = 'Y'", True),
    "io_pct": share("coalesce(io, 'N') = 'Y'"),
    # averages
    "wa_oltv": average("oltv"),
    "wa_ocltv": average("ocltv"),
    "wa_cscore_b": average("cscore_b"),
    "wa_cscore_c": average("cscore_c"),
    "wa_qfico": average("qfico"),
    "wa_dti": average("dti"),
    # to date
    "default_upb": r2("coalesce(sum(defaulted), 0)"),
    "default_cnt": "count(defaulted)",
    "default_pct": r6(quotient("coalesce(sum(defaulted), 0)", "sum(orig_upb)")),
    "net_loss": r2("sum(net_loss)"),
    "loss_cnt": "count(*) FILTER (WHERE net_loss > 0)",
    "loss_pct": r6(quotient("coalesce(sum(net_loss), 0)", "sum(orig_upb)")),
    "severity": r6(
        "CASE WHEN sum(defaulted) > 0 THEN "
        + quotient("coalesce(sum(net_loss), 0)", "sum(defaulted)")
        + " ELSE 0 END"
    ),
    # loan-months
    "current_bal": r2("sum(current_bal)"),
    "sched_bal": r2("sum(sched_bal)"),
    "unsched_prin": r2("sum(unsched_prin)"),
    "unsched_cnt": "CAST(sum(unsched_cnt) AS BIGINT)",
    "mo_default_upb": r2("coalesce(sum(defaulted_upb), 0)"),
    "mo_default_cnt": "count(defaulted_upb)",
    "mo_net_loss": r2("coalesce(sum(mo_net_loss), 0)"),
    "mo_loss_cnt": "count(*) FILTER (WHERE mo_net_loss > 0)",
}
MEASURES |= {
    f"state_{s.lower()}_pct": share(f"state = '{s}'")
    for s in ("CA", "AZ", "UT", "CO", "NV", "ID", "FL", "WY", "TX", "MI", "NY", "NJ")
}
MEASURES |= {
    f"bal_{s.lower()}_pct": share(f"bal_seg = '{s}'")
    for s in ("VLOW", "LOW", "MED", "HIGH", "SUPER")
}

# Raw (unrounded) monthly rates, for use inside other expressions.
SMM = (
    "CASE WHEN sum(sched_bal) > 0 THEN " + quotient("sum(unsched_prin)", "sum(sched_bal)") + " END"
)
RATES = {
    "wa_rate": WA_RATE,
    "smm": SMM,
    "cpr": f"1 - pow(1 - ({SMM}), 12)",
    "dlq_30_pct": "CASE WHEN sum(current_bal) > 0 THEN "
    + quotient("sum(dlq_30)", "sum(current_bal)")
    + " END",
    "dlq_60_pct": "CASE WHEN sum(current_bal) > 0 THEN "
    + quotient("sum(dlq_60)", "sum(current_bal)")
    + " END",
    "dlq_90_pct": "CASE WHEN sum(current_bal) > 0 THEN "
    + quotient("sum(dlq_90)", "sum(current_bal)")
    + " END",
    "fc_pct": "CASE WHEN sum(current_bal) > 0 THEN "
    + quotient("coalesce(sum(defaulted_upb), 0)", "sum(current_bal)")
    + " END",
}
MEASURES |= {name: r6(value) for name, value in RATES.items()}


def chosen(*names: str) -> str:
    return ", ".join(f"{MEASURES[name]} AS {name}" for name in names)


def statement(body: str, *extra: str) -> str:
    """The body with the table and attribute CTEs, and any extra ones, in front."""
    return "WITH " + ",".join([TABLES, ATTRIBUTES, *extra]) + "\n" + body
