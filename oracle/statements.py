"""One SQL statement per named query."""

from __future__ import annotations

from oracle.base import (
    MEASURES,
    PAYMENT,
    PERCENTILES,
    RATES,
    STEP_SEGMENT,
    amortized,
    chosen,
    digits,
    months,
    percent_text,
    quotient,
    r2,
    r6,
    statement,
)

STATEMENTS: dict[str, str] = {}

S = STATEMENTS

MONEY_COLUMNS = (
    "last_upb", "foreclosure_costs", "property_preservation_and_repair_costs",
    "asset_recovery_costs", "miscellaneous_holding_expenses_and_credits",
    "associated_taxes_for_holding_property", "net_sales_proceeds", "credit_enhancement_proceeds",
    "repurchases_make_whole_proceeds", "other_foreclosure_proceeds",
)


def _money(*names: str) -> str:
    return ", ".join(f"{r2(name)} AS {name}" for name in names)


# --- sources and stages ---------------------------------------------------------------------------

ORIG_INTS = (
    "orig_term", "dti", "oltv", "ocltv", "cscore_b", "cscore_c", "no_units", "num_bo", "mi_type",
    "mi_pct",
)
ORIG_TEXTS = (
    "orig_date", "first_pay", "channel", "high_balance_loan_indicator", "first_flag", "seller",
    "servicer", "state", "prop", "occ_stat", "purpose", "property_inspection_waiver_indicator",
    "ppmt_flg", "io",
)

S["scan_orig"] = statement(
    "SELECT loan_id, "
    + ", ".join(ORIG_TEXTS)
    + ", "
    + ", ".join(f"CAST({name} AS BIGINT) AS {name}" for name in ORIG_INTS)
    + f", {r6('orig_rate')} AS orig_rate, {r2('orig_upb')} AS orig_upb FROM orig"
)
S["scan_month"] = statement(
    "SELECT loan_id, act_period, CAST(loan_age AS BIGINT) AS loan_age, dlq_status, "
    f"{_money('current_upb')} FROM month"
)
S["scan_term"] = statement(
    "SELECT loan_id, act_period, zb_dte, zero_bal_code, foreclosure_date, disposition_date, "
    f"{_money(*MONEY_COLUMNS)} FROM term"
)
S["wide_history"] = statement(
    "SELECT m.loan_id, m.act_period, CAST(loan_age AS BIGINT) AS loan_age, dlq_status, zb_dte, "
    "zero_bal_code, foreclosure_date, disposition_date, "
    f"{_money('current_upb', *MONEY_COLUMNS)} "
    "FROM month m LEFT JOIN term t ON m.loan_id = t.loan_id AND m.act_period = t.act_period"
)
S["max_period"] = statement("SELECT max(act_period) AS max_period FROM month")

S["universe"] = statement(
    f"""SELECT loan_id, {r6('orig_rate')} AS orig_rate, channel,
  {r6('orig_rate_pctile')} AS orig_rate_pctile, {r2('orig_upb')} AS orig_upb,
  {r6('orig_upb_pctile')} AS orig_upb_pctile,
  CAST(loan_term AS BIGINT) AS loan_term, orig_date, first_flag, second_home, mi_flag, state,
  high_balance_loan_indicator, eligible, vintage, pctile_seg AS bal_seg
FROM p""",
    PERCENTILES,
)
S["upb_pctile"] = statement(
    f"SELECT loan_id, {r6('orig_upb_pctile')} AS orig_upb_pctile FROM p", PERCENTILES
)
S["rate_pctile"] = statement(
    f"SELECT loan_id, {r6('orig_rate_pctile')} AS orig_rate_pctile FROM p", PERCENTILES
)


def _summary(dimensions: list[str]) -> str:
    keys = ["loan_term", *dimensions]
    weighted = quotient("sum(orig_rate * orig_upb)", "sum(orig_upb)")
    return statement(
        "SELECT CAST(loan_term AS BIGINT) AS loan_term, "
        + "".join(f"{d}, " for d in dimensions)
        + ", ".join(f"CAST(grouping({k}) AS BIGINT) AS g_{k}" for k in keys)
        + f""", {r6(f'round(8 * ({weighted}), 0) / 8')} AS wa_note_rate,
  {r6(f'round({quotient("sum(orig_rate)", "count(*)")}, 3)')} AS avg_note_rate,
  {r2('max(orig_upb)')} AS max_bal, count(*) AS loan_cnt, {r2('sum(orig_upb)')} AS orig_upb
FROM u GROUP BY ROLLUP ({', '.join(keys)})"""
    )


S["cohort_summary"] = _summary(["channel", "vintage"])
S["rollup_summary"] = _summary(["channel", "vintage", "second_home"])

# --- loan attributes ------------------------------------------------------------------------------

TERM_BIGINT = "CAST(loan_term AS BIGINT) AS loan_term"

S["vintage_term"] = statement(f"SELECT loan_id, vintage, {TERM_BIGINT} FROM attr")
S["legacy_term"] = statement(
    "SELECT loan_id, CAST(legacy_term AS BIGINT) AS loan_term FROM attr"
)
S["flags"] = statement("SELECT loan_id, second_home, mi_flag FROM attr")
S["qfico"] = statement("SELECT loan_id, CAST(qfico AS BIGINT) AS qfico FROM attr")
S["eligibility"] = statement("SELECT loan_id, eligible FROM attr")
S["eligibility_legacy"] = statement("SELECT loan_id, legacy_eligible AS eligible FROM attr")
S["inel_reasons"] = statement("SELECT loan_id, inel_b3, inel_b5, inel_b6 FROM attr")
S["sublimits"] = statement("SELECT loan_id, sublimit_a, sublimit_b FROM attr")

NAMED_POSITION = (
    "CAST(coalesce(list_position(['VLOW', 'LOW', 'MED', 'HIGH', 'SUPER'], bal_seg) - 1, 5) "
    "AS BIGINT)"
)
STEP_NAMES = (
    "085K", "110K", "125K", "150K", "175K", "200K", "225K", "250K", "275K", "500K", "CONF",
    "SUPER",
)
STEP_POSITION = f"CAST(coalesce(list_position({list(STEP_NAMES)}, bal_seg) - 1, 12) AS BIGINT)"

S["bal_fixed"] = statement(
    f"""SELECT {TERM_BIGINT}, bal_seg, {NAMED_POSITION} AS seg_order,
  {chosen('loans', 'orig_upb', 'segment_range', 'segment_pctiles')}, count(*) AS cohort_loans
FROM (SELECT *, cut_seg AS bal_seg FROM p) GROUP BY loan_term, bal_seg""",
    PERCENTILES,
)
S["bal_steps"] = statement(
    f"""SELECT {TERM_BIGINT}, bal_seg, CAST(grouping(loan_term) AS BIGINT) AS g_loan_term,
  CAST(grouping(bal_seg) AS BIGINT) AS g_bal_seg, {STEP_POSITION} AS seg_order,
  count(*) AS loan_cnt, {r2('max(orig_upb)')} AS max_bal
FROM (SELECT *, {STEP_SEGMENT} AS bal_seg FROM u) GROUP BY ROLLUP (loan_term, bal_seg)"""
)
S["bal_pctile"] = statement("SELECT loan_id, pctile_seg AS bal_seg FROM p", PERCENTILES)
S["monthly_pi"] = statement(f"SELECT loan_id, {r2(PAYMENT)} AS monthly_pi FROM orig")

INCOME = "CAST(CAST(monthly_pi AS DOUBLE) * 1200 / dti AS DECIMAL(18,2))"
S["annual_income"] = statement(
    f"""SELECT {TERM_BIGINT}, vintage, {MEASURES['wa_pi']} AS wa_pi,
  {r2(quotient('sum(income * orig_upb)', 'sum(orig_upb)'))} AS wa_income,
  {digits('min(income)', 0)} || ' - ' || {digits('max(income)', 0)} AS income_range
FROM (SELECT *, {INCOME} AS income FROM u) GROUP BY loan_term, vintage"""
)
S["income_report"] = statement(
    f"""SELECT {TERM_BIGINT}, vintage, count(*) AS loans,
  {r2(quotient('sum(income * orig_upb)', 'sum(orig_upb)'))} AS wa_income,
  {digits('min(income)', 0)} || ' - ' || {digits('max(income)', 0)} AS income_range
FROM (SELECT *, {INCOME} AS income FROM u) GROUP BY loan_term, vintage"""
)
S["sched_balance"] = statement(
    f"""SELECT loan_id, abs({r2(amortized('0'))}) AS sched_0,
  abs({r2(amortized('12'))}) AS sched_12, abs({r2(amortized('24'))}) AS sched_24,
  abs({r2(amortized('orig_term'))}) AS sched_at_term
FROM orig"""
)

# --- loan-months ----------------------------------------------------------------------------------


def _months(columns: str) -> str:
    return statement(f"SELECT loan_id, act_period, {columns} FROM lm", months())


S["current_balance"] = _months(_money("current_bal"))
S["loan_age"] = _months("CAST(loan_age AS BIGINT) AS loan_age")
S["dlq_buckets"] = _months(_money("dlq_30", "dlq_60", "dlq_90"))
S["default_upb"] = _months(_money("defaulted_upb"))
S["prepay_fields"] = _months(
    _money("sched_bal", "unsched_prin") + ", CAST(unsched_cnt AS BIGINT) AS unsched_cnt"
)
S["net_loss"] = statement(
    f"""SELECT loan_id, {_money('net_loss')},
  CASE WHEN zero_bal_code <> '01' THEN {r2('net_loss')} END AS mo_net_loss FROM closed"""
)
S["net_loss_legacy"] = statement(
    "SELECT loan_id, CASE WHEN gap IS NULL THEN NULL WHEN gap > 0 THEN "
    f"{r2('-gap')} ELSE 0.0 END AS net_loss FROM loss"
)

# --- filters --------------------------------------------------------------------------------------

PICKED = (
    f"count(*) AS loans, {r2('sum(orig_upb)')} AS orig_upb, "
    "CAST(sum(loan_id) AS BIGINT) AS loan_id_sum"
)


def _filter(*extra: str, source: str = "u", **variants: str) -> str:
    parts = [
        f"SELECT vintage, {TERM_BIGINT}, {PICKED}, '{name}' AS variant FROM {source}"
        f" WHERE {predicate} GROUP BY vintage, loan_term"
        for name, predicate in variants.items()
    ]
    return statement("\nUNION ALL ".join(parts), *extra)


def _listed(states: tuple[str, ...]) -> str:
    return "state IN (" + ", ".join(f"'{s}'" for s in states) + ")"


S["filter_vintage"] = _filter(
    single="vintage = '1996'", range="vintage BETWEEN '1997' AND '1999'"
)
S["filter_origmo"] = _filter(months="orig_date IN ('199601', '199602', '199806')")
S["filter_term"] = _filter(
    t180="loan_term = 180",
    t240="loan_term = 240",
    t360="loan_term = 360",
    t480="loan_term = 480",
    only30="loan_term = 360",
)
S["filter_balance"] = _filter(
    thousands="orig_upb > 150000 AND orig_upb <= 200000",
    units="orig_upb > 150000 AND orig_upb <= 417000",
    below="orig_upb <= 250000",
)
S["filter_state"] = _filter(
    only="state = 'NY'", without="state <> 'NY'", listed=_listed(("CA", "UT", "PR"))
)
S["filter_rate"] = _filter(rate="orig_rate = 4.125")
S["filter_channel"] = _filter(R="channel = 'R'", B="channel = 'B'", C="channel = 'C'")
# States by loan volume.
TOP_12 = ("CA", "TX", "FL", "AZ", "CO", "WA", "GA", "NC", "VA", "NY", "UT", "NJ")
S["filter_topstates"] = _filter(
    top12=_listed(TOP_12),
    top17=_listed(
        ("CA", "TX", "FL", "MI", "WA", "CO", "AZ", "NY", "VA", "NJ", "IL", "NC", "MA", "GA", "PA", "MD", "UT")
    ),
    top25=_listed(
        (*TOP_12, "PA", "IL", "TN", "OR", "MD", "MI", "OH", "MN", "NV", "SC", "MA", "IN", "MO")
    ),
)
S["filter_seller"] = _filter(prefix="seller LIKE 'BUILD%'")
S["filter_purpose"] = _filter(purchase="purpose = 'P'", cashout="purpose = 'C'")
S["filter_units"] = _filter(one="no_units = 1", two="no_units = 2")
S["filter_ltv"] = _filter(
    least="coalesce(ocltv, 99) >= 80 AND oltv >= 80",
    most="coalesce(ocltv, 0) <= 70 AND oltv <= 70",
)
S["filter_custom"] = _filter(custom="num_bo >= 2 AND orig_upb > dti * 5000")

SELLERS = """
sellers AS (
  SELECT seller, row_number() OVER (ORDER BY sum(orig_upb) DESC, seller) AS seller_rank,
    sum(orig_upb) AS volume, min(substr(orig_date, 1, 4)) AS min_orig,
    max(substr(orig_date, 1, 4)) AS max_orig
  FROM orig WHERE seller IS NOT NULL AND seller <> 'Other' GROUP BY seller
),
ranked_sellers AS (SELECT u.*, seller_rank FROM u JOIN sellers USING (seller))"""
SERVICERS = """
numbered_servicers AS (
  SELECT coalesce(servicer, 'Other') AS servicer, sum(orig_upb) AS volume,
    row_number() OVER (ORDER BY sum(orig_upb) DESC, coalesce(servicer, 'Other')) AS position,
    min(substr(orig_date, 1, 4)) AS min_orig, max(substr(orig_date, 1, 4)) AS max_orig
  FROM orig GROUP BY 1
),
servicers AS (
  SELECT *, CASE WHEN servicer <> 'Other' THEN position END AS servicer_rank
  FROM numbered_servicers
),
ranked_servicers AS (
  SELECT u.*, servicer_rank FROM u JOIN servicers s ON coalesce(u.servicer, 'Other') = s.servicer
)"""

S["filter_seller_rank"] = _filter(
    SELLERS, source="ranked_sellers", ranks="seller_rank BETWEEN 1 AND 2"
)
S["filter_elig"] = _filter(eligible="eligible = 'Y'")
S["filter_ranges"] = _filter(
    score="qfico > 660 AND qfico <= 720",
    ltv="oltv > 60 AND oltv <= 80",
    cltv="cltv_in > 70 AND cltv_in <= 95",
    dti="dti > 20 AND dti <= 43",
)
S["filter_occupancy"] = _filter(primary="occ_stat = 'P'")
S["filter_appraisal"] = _filter(full="appr_in = 'A'")
S["filter_first"] = _filter(first="first_flag = 'Y'", repeat="first_flag = 'N'")
S["early_payoff"] = _filter(
    source="everyone", kept="zb_dte IS NULL OR zb_dte > first_pay", all="true"
)


def _coupon(keys: str) -> str:
    weighted = quotient("sum(s.orig_rate * s.orig_upb)", "sum(s.orig_upb)")
    same = " AND ".join(f"s.{key} = u.{key}" for key in keys.split())
    return (
        f"coalesce(orig_rate = (SELECT round(8 * ({weighted}), 0) / 8 FROM u s WHERE {same}), true)"
    )


S["avg_coupon"] = _filter(
    by_term=_coupon("loan_term"), by_channel=_coupon("loan_term channel vintage")
)
S["limit_loans"] = _filter(
    "\nfirst_loans AS (SELECT * FROM u ORDER BY loan_id LIMIT 1000)",
    source="first_loans",
    limited="true",
)

# --- groups and subtotals -------------------------------------------------------------------------


def _rolled(
    keys: list[str], columns: str, *extra: str, source: str = "u", having: str = ""
) -> str:
    """Rollup over (loan_term, keys) with grouping bits."""
    every = ["loan_term", *keys]
    ints = {"loan_term", "loan_age", "seller_rank", "servicer_rank"}
    shown = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in ints else k for k in every)
    marks = ", ".join(f"CAST(grouping({k}) AS BIGINT) AS g_{k}" for k in every)
    return statement(
        f"SELECT {shown}, {marks}, {columns} FROM {source}"
        f" GROUP BY ROLLUP ({', '.join(every)}) {having}",
        *extra,
    )


S["min_count"] = _rolled(
    ["channel", "state"], chosen("loans", "orig_upb"), having="HAVING count(*) >= 100"
)

GROUP_COLUMNS = (
    chosen("loans", "orig_upb", "als", "wa_rate", "wa_pi", "eligible", "vintages")
    + f", count(*) AS cohort_loans, {r2('sum(orig_upb)')} AS cohort_upb"
)


def _by(key: str, *extra: str, source: str = "u", named: str = "") -> str:
    return _rolled([key], named + GROUP_COLUMNS, *extra, source=source)


def _name(rank: str, party: str, column: str) -> str:
    return (
        f"CASE WHEN grouping({rank}) = 1 THEN 'Total' ELSE min(coalesce({party}, 'Other')) END"
        f" AS {column}, "
    )


S["by_vintage"] = _by("vintage")
S["by_state"] = _by("state")
S["by_hbal"] = _by("high_balance_loan_indicator")
S["by_first"] = _by("first_flag")
S["by_second_home"] = _by("second_home")
S["by_mi"] = _by(
    "mi_flag", "\ninsured AS (SELECT * FROM u WHERE coalesce(mi_type, 1) = 1)", source="insured"
)
S["by_channel"] = _by("channel")
S["by_balance"] = _by("bal_seg", PERCENTILES, source="(SELECT *, pctile_seg AS bal_seg FROM p)")
S["by_seller"] = _by(
    "seller_rank",
    SELLERS,
    source="ranked_sellers",
    named=_name("seller_rank", "seller", "originator"),
)
S["by_servicer"] = _by(
    "servicer_rank",
    SERVICERS,
    source="ranked_servicers",
    named=_name("servicer_rank", "servicer", "servicer_name"),
)
S["seller_rank"] = statement(
    f"""SELECT seller AS party, CAST(seller_rank AS BIGINT) AS rank, {r2('volume')} AS volume,
  CAST(min_orig AS BIGINT) AS min_orig, CAST(max_orig AS BIGINT) AS max_orig, 'seller' AS kind
FROM sellers
UNION ALL
SELECT servicer, CAST(servicer_rank AS BIGINT), {r2('volume')}, CAST(min_orig AS BIGINT),
  CAST(max_orig AS BIGINT), 'servicer' FROM servicers""",
    SELLERS,
    SERVICERS,
)

S["cohort_totals"] = statement(
    f"""SELECT CAST(g.loan_term AS BIGINT) AS loan_term, CAST(g.loan_age AS BIGINT) AS loan_age,
  g.channel, g.first_flag, CAST(0 AS BIGINT) AS g_loan_term, CAST(0 AS BIGINT) AS g_loan_age,
  g.g_channel, g.g_first_flag, g.loans, g.orig_upb, s.loans AS cohort_loans,
  s.orig_upb AS cohort_upb, {r6('s.raw_upb / s.loans')} AS cohort_als
FROM (SELECT loan_term, loan_age, channel, first_flag,
    CAST(grouping(channel) AS BIGINT) AS g_channel,
    CAST(grouping(first_flag) AS BIGINT) AS g_first_flag, {chosen('loans', 'orig_upb')}
  FROM lm
  GROUP BY GROUPING SETS ((loan_term, loan_age), (loan_term, loan_age, channel),
    (loan_term, loan_age, channel, first_flag))) g
LEFT JOIN (SELECT loan_term, channel, first_flag,
    CAST(grouping(channel) AS BIGINT) AS g_channel,
    CAST(grouping(first_flag) AS BIGINT) AS g_first_flag, CAST(sum(orig_upb) AS DOUBLE) AS raw_upb,
    {chosen('loans', 'orig_upb')}
  FROM u
  GROUP BY GROUPING SETS ((loan_term), (loan_term, channel), (loan_term, channel, first_flag))) s
ON g.loan_term = s.loan_term AND g.channel IS NOT DISTINCT FROM s.channel
  AND g.first_flag IS NOT DISTINCT FROM s.first_flag
  AND g.g_channel = s.g_channel AND g.g_first_flag = s.g_first_flag
WHERE g.loan_age IS NOT NULL""",
    months(),
)

S["report_rownum"] = statement(
    """SELECT row_number() OVER (ORDER BY loan_term DESC NULLS LAST, g_vintage,
    vintage NULLS LAST, g_channel, channel NULLS LAST) AS row_num, * FROM (
  SELECT CAST(loan_term AS BIGINT) AS loan_term, channel, vintage,
    CAST(grouping(loan_term) AS BIGINT) AS g_loan_term,
    CAST(grouping(channel) AS BIGINT) AS g_channel,
    CAST(grouping(vintage) AS BIGINT) AS g_vintage, count(*) AS loans
  FROM u GROUP BY ROLLUP (loan_term, channel, vintage))"""
)


def _label(key: str, total: str) -> str:
    return f"CASE WHEN grouping({key}) = 1 THEN '{total}' ELSE CAST({key} AS VARCHAR) END"


S["labels"] = statement(
    f"""SELECT {_label('loan_term', 'All Terms')} AS cohort_term,
  {_label('channel', 'All Orig. Channels')} AS cohort_channel,
  {_label('vintage', 'All')} AS cohort_vintage, {_label('state', 'US')} AS cohort_state,
  {_label('first_flag', 'Total')} AS cohort_first,
  CASE WHEN grouping(second_home) = 1 THEN 'All Occ.' WHEN second_home = 'Y' THEN 'Second Home'
    ELSE 'Primary Occ.' END AS cohort_second_home,
  min(vintage) || '-' || max(vintage) AS cohort_vintages, min(eligible) AS cohort_eligible,
  CAST(60 AS BIGINT) AS cohort_min_ltv, count(*) AS loans
FROM u WHERE eligible = 'Y' AND coalesce(ocltv, 99) >= 60 AND oltv >= 60
GROUP BY ROLLUP (loan_term, channel, vintage, state, first_flag, second_home)"""
)

# --- shares and averages --------------------------------------------------------------------------


def _measured(*names: str) -> str:
    return _rolled(["vintage"], chosen(*names))


CHARACTERISTICS = (
    "hbal_pct", "second_home_pct", "insured_pct", "cashout_pct", "first_buyer_pct", "condo_pct",
    "multi_unit_pct", "multi_borrower_pct",
)
CREDIT = ("wa_oltv", "wa_ocltv", "wa_cscore_b", "wa_cscore_c", "wa_qfico", "wa_dti")
BREAKDOWN = (
    "investor_pct", "score_lt_640_pct", "ltv_gt_95_pct", "dti_gt_45_pct", "mh_pct", "pr_vi_pct",
    "appr_not_full_pct", "appr_waiver_pct", "inel_b3_pct", "inel_b5_pct", "inel_b6_pct",
)
STATES_10 = [f"state_{s}_pct" for s in (
    "ca", "az", "ut", "co", "nv", "id", "fl", "wy", "tx", "mi",
)]
SUBLIMITS = ["sublimit_a_pct", "sublimit_b_pct"]
CHANNELS = ["broker_pct", "correspondent_pct", "retail_pct"]
TO_DATE = (
    "default_upb", "default_cnt", "default_pct", "net_loss", "loss_cnt", "loss_pct", "severity",
)

S["share_channel"] = _measured(*CHANNELS)
S["share_balance"] = _rolled(
    ["vintage"],
    chosen("bal_vlow_pct", "bal_low_pct", "bal_med_pct", "bal_high_pct", "bal_super_pct"),
    PERCENTILES,
    source="(SELECT *, pctile_seg AS bal_seg FROM p)",
)
S["share_state"] = _measured(*STATES_10, "state_ny_pct", "state_nj_pct")
S["share_char"] = _measured(*CHARACTERISTICS)
S["wavg_credit"] = _measured(*CREDIT)
S["share_elig"] = _measured("inel_pct", *BREAKDOWN)
S["share_sublimit"] = _measured(*SUBLIMITS)

OLDER = """
older AS (
  SELECT * EXCLUDE (loan_term, eligible), legacy_term AS loan_term, legacy_eligible AS eligible,
    eligible AS new_eligible
  FROM everyone
)"""
S["share_elig_legacy"] = _rolled(
    ["vintage"], chosen("inel_pct", "io_pct"), OLDER, source="older"
)
S["strats"] = _measured(
    *("loans", "orig_upb", "als", "size_range", "wa_rate", "wa_rate_8ths", "rate_range", "wa_pi"),
    "eligible",
    "vintages",
    *CHARACTERISTICS,
    *CREDIT,
    "inel_pct",
    *SUBLIMITS,
    "default_pct",
    "loss_pct",
    "severity",
)
S["default_to_date"] = _measured(*TO_DATE)

# --- performance ----------------------------------------------------------------------------------


def _curve_cte(dimensions: list[str], source: str, name: str, having: str = "") -> str:
    """CTE with unrounded cohort totals, monthly sums and running credit of one age curve."""
    keys = ["loan_term", *dimensions]
    matched = " AND ".join(f"c.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY loan_age)"
    sums = ", ".join(f"{MEASURES[x]} AS {x}" for x in PLAIN_CURVE)
    rates = ", ".join(f"{value} AS raw_{x}" for x, value in RATES.items())
    return f"""
{name} AS (
  SELECT *, sum(mo_default_upb) {over} AS running_default, sum(mo_net_loss) {over} AS running_loss
  FROM (
    SELECT g.*, c.cohort_loans, c.cohort_sum FROM (
      SELECT {', '.join(keys)}, loan_age, {sums}, {rates}
      FROM {source}_months GROUP BY {', '.join(keys)}, loan_age {having}) g
    LEFT JOIN (SELECT {', '.join(keys)}, count(*) AS cohort_loans,
        CAST(sum(orig_upb) AS DOUBLE) AS cohort_sum
      FROM {source} GROUP BY {', '.join(keys)}) c ON {matched}
    WHERE loan_age IS NOT NULL)
)"""


PLAIN_CURVE = (
    "loans", "orig_upb", "current_bal", "sched_bal", "unsched_prin", "unsched_cnt",
    "mo_default_upb", "mo_default_cnt", "mo_net_loss", "mo_loss_cnt", "wa_rate_8ths", "rate_range",
    "wa_pi", "eligible",
)

CURVE = {
    **{name: name for name in PLAIN_CURVE},
    **{name: r6(f"raw_{name}") for name in RATES},
    "cohort_loans": "cohort_loans",
    "cohort_upb": r2("cohort_sum"),
    "cohort_als": r6("cohort_sum / cohort_loans"),
    "cum_default_upb": r2("running_default"),
    "cum_net_loss": r2("running_loss"),
    "cum_default_pct": r6("running_default / cohort_sum"),
    "cum_loss_pct": r6("running_loss / cohort_sum"),
    "cum_lgd": r6("running_loss / nullif(running_default, 0)"),
}


def _from_curve(dimensions: list[str], columns: list[str], name: str = "curve") -> str:
    ints = {"seller_rank", "servicer_rank"}
    shown = "".join(f"CAST({d} AS BIGINT) AS {d}, " if d in ints else f"{d}, " for d in dimensions)
    return (
        f"SELECT {TERM_BIGINT}, CAST(loan_age AS BIGINT) AS loan_age, {shown}"
        + ", ".join(f"{CURVE[x]} AS {x}" for x in columns)
        + f" FROM {name}"
    )


def _cohort(where: str = "true", source: str = "u") -> str:
    return f"\nco AS (SELECT * FROM {source} WHERE {where})"


def _curve(dimensions: list[str], columns: list[str], *extra: str, **cohort: str) -> str:
    return statement(
        _from_curve(dimensions, columns),
        *extra,
        _cohort(**cohort),
        months("co", "co_months"),
        _curve_cte(dimensions, "co", "curve"),
    )


CURVE_COLUMNS = [
    *(
        "cohort_loans", "cohort_upb", "cohort_als", "cpr", "smm", "dlq_30_pct", "dlq_60_pct",
        "dlq_90_pct", "fc_pct",
    ),
    *(
        "cum_default_pct", "cum_loss_pct", "cum_lgd", "loans", "orig_upb", "current_bal",
        "sched_bal",
    ),
    *(
        "unsched_prin", "unsched_cnt", "mo_default_upb", "mo_default_cnt", "mo_net_loss",
        "mo_loss_cnt",
    ),
    *("cum_default_upb", "cum_net_loss", "wa_rate", "wa_rate_8ths", "rate_range", "wa_pi"),
]

S["age_curve"] = _curve([], CURVE_COLUMNS)
S["age_curve_1996"] = _curve([], CURVE_COLUMNS, where="vintage = '1996'")
S["age_curve_by_vintage"] = _curve(["vintage"], CURVE_COLUMNS)
S["dlq_curve"] = _curve(
    ["channel"], ["dlq_30_pct", "dlq_60_pct", "dlq_90_pct", "fc_pct", "current_bal"]
)
S["loss_curve"] = _curve(
    ["vintage"], ["mo_default_upb", "mo_default_cnt", "mo_net_loss", "mo_loss_cnt"]
)
S["cum_default"] = _curve(["vintage"], ["cum_default_upb", "cum_default_pct"])
S["cum_loss"] = _curve(["second_home"], ["cum_net_loss", "cum_loss_pct"])
S["cum_lgd"] = _curve(
    ["seller_rank"],
    ["cum_default_upb", "cum_net_loss", "cum_lgd"],
    SELLERS,
    source="ranked_sellers",
)


def _horizon(source: str, latest: str = "(SELECT max(act_period) FROM month)") -> str:
    """Each loan with its age-24 row, filled, and with EXISTS answers."""
    amort = f"CAST({amortized('24')} AS DECIMAL(18,2))"

    def ever(predicate: str) -> str:
        return (
            "CASE WHEN EXISTS (SELECT 1 FROM month d WHERE d.loan_id = s.loan_id"
            f" AND {predicate}) THEN s.orig_upb END"
        )

    return f"""
hz AS (
  SELECT s.*, h.current_upb AS reported,
    CASE WHEN h.current_upb = 0 THEN {amort} ELSE h.current_upb END AS horizon_bal,
    CASE WHEN first_pay <= {latest} THEN {amort} END AS horizon_sched,
    {ever("d.dlq_status >= '02' AND d.loan_age <= 48")} AS late_60_48,
    {ever("d.dlq_status >= '02'")} AS late_60,
    {ever("d.dlq_status >= '04' AND d.loan_age <= 48")} AS late_120_48
  FROM {source} s LEFT JOIN month h ON s.loan_id = h.loan_id AND h.loan_age = 24
)"""


def _speed(actual: str) -> str:
    return r6(f"1 - pow({quotient(actual, 'sum(horizon_sched)')}, 0.5)")


HORIZON_COLUMNS = (
    f"{r2('coalesce(sum(horizon_bal), 0)')} AS horizon_act, "
    f"{r2('sum(horizon_sched)')} AS horizon_sched, "
    f"{_speed('coalesce(sum(horizon_bal), 0)')} AS horizon_cpr"
)

# 23 months before the last period.
SEASONED = (
    "(SELECT strftime(strptime(max(act_period), '%Y%m') - INTERVAL 23 MONTH, '%Y%m') FROM month)"
)


def _by_vintage_at_horizon(variant: str, rows: str) -> str:
    return _rolled(["vintage"], f"'{variant}' AS variant, {HORIZON_COLUMNS}", rows, source="hz")


S["horizon_cpr"] = (
    _by_vintage_at_horizon("started", _horizon("u"))
    + "\nUNION ALL SELECT * FROM ("
    + _by_vintage_at_horizon("seasoned", _horizon("u", SEASONED))
    + ")"
)
S["ever_60"] = _rolled(
    ["vintage"],
    f"{r2('sum(late_60_48)')} AS ever_60_horizon_upb, {r2('sum(late_60)')} AS ever_60_upb, "
    f"{r6(quotient('coalesce(sum(late_60_48), 0)', 'sum(orig_upb)'))} AS ever_60_horizon_pct, "
    f"{r6(quotient('coalesce(sum(late_60), 0)', 'sum(orig_upb)'))} AS ever_60_pct",
    _horizon("u"),
    source="hz",
)
S["ever_120"] = _rolled(
    ["channel"],
    f"{r2('sum(late_120_48)')} AS ever_120_horizon_upb, "
    f"{r6(quotient('coalesce(sum(late_120_48), 0)', 'sum(orig_upb)'))} AS ever_120_horizon_pct",
    _horizon("u"),
    source="hz",
)

# --- sweeps ---------------------------------------------------------------------------------------

SWEEP_COLUMNS = ["cohort_loans", "cohort_upb", "loans", "cpr", "dlq_90_pct", "cum_loss_pct"]

S["horizon_echo"] = statement(
    """SELECT CAST(loan_term AS VARCHAR) AS cohort_term, bal_seg AS cohort_balance,
      '0.50 - 0.90' AS segment_criteria, CAST(12 AS BIGINT) AS prepay_horizon,
      CAST(36 AS BIGINT) AS delinquency_horizon, count(*) AS loans
    FROM (SELECT *, CASE WHEN high_balance_loan_indicator = 'Y' THEN 'SUPER'
        WHEN any_pctile < 0.2 THEN 'VLOW' WHEN any_pctile < 0.5 THEN 'LOW' WHEN any_pctile < 0.9 THEN 'MED'
        ELSE 'HIGH' END AS bal_seg FROM p)
    GROUP BY loan_term, bal_seg""",
    PERCENTILES,
)
S["strats_by_age"] = statement(
    f"""SELECT {TERM_BIGINT}, CAST(loan_age AS BIGINT) AS loan_age, vintage, loans,
      mo_default_upb AS default_upb, mo_default_cnt AS default_cnt,
      {r6('mo_default_upb / cohort_sum')} AS default_pct, {r2('placed')} AS net_loss,
      placed_cnt AS loss_cnt, {r6('placed / cohort_sum')} AS loss_pct,
      {r6('CASE WHEN mo_default_upb > 0 THEN placed / mo_default_upb ELSE 0 END')} AS severity
    FROM curve JOIN (
      SELECT loan_term, vintage, loan_age,
        CAST(coalesce(sum(net_loss) FILTER (WHERE act_period = term_period), 0) AS DOUBLE) AS placed,
        count(*) FILTER (WHERE act_period = term_period AND net_loss > 0) AS placed_cnt
      FROM co_months GROUP BY loan_term, vintage, loan_age) USING (loan_term, vintage, loan_age)""",
    _cohort(),
    months("co", "co_months"),
    _curve_cte(["vintage"], "co", "curve"),
)
S["sweep_strat"] = statement(
    f"""SELECT run_id, {TERM_BIGINT}, CAST(loan_age AS BIGINT) AS loan_age,
      CAST(seller_rank AS BIGINT) AS seller_rank, seller AS originator, loans,
      mo_default_upb AS default_upb, {r6('mo_default_upb / cohort_sum')} AS default_pct
    FROM curve JOIN sellers USING (seller_rank)""",
    SELLERS,
    "\nco AS (SELECT *, 'channel-' || channel AS run_id FROM ranked_sellers"
    " WHERE channel IN ('R', 'B', 'C'))",
    months("co", "co_months"),
    _curve_cte(["run_id", "seller_rank"], "co", "curve"),
)
S["sweep_channel"] = statement(
    "SELECT 'channel-' || channel AS run_id, * FROM ("
    + _from_curve(["channel"], SWEEP_COLUMNS)
    + ")",
    _cohort("loan_term = 360 AND eligible = 'Y' AND channel IN ('R', 'B', 'C')"),
    months("co", "co_months"),
    _curve_cte(["channel"], "co", "curve"),
)

_TOPS = (150, 200, 250, 500, 9999)
_BAND = (
    "CASE "
    + " ".join(
        f"WHEN orig_upb > {low}000 AND orig_upb <= {high}000 THEN '{low:04d}-{high:04d}K'"
        for low, high in zip((0, *_TOPS), _TOPS)
    )
    + " END"
)
S["sweep_loansize"] = statement(
    _from_curve(["run_id"], SWEEP_COLUMNS),
    f"\nco AS (SELECT *, {_BAND} AS run_id FROM u WHERE eligible = 'Y' AND no_units = 1"
    " AND loan_term IN (240, 360))",
    months("co", "co_months"),
    _curve_cte(["run_id"], "co", "curve"),
)


def _run(name: str, where: str, dimensions: list[str], having: str = "") -> tuple[list[str], str]:
    """CTEs and SELECT of one run of the spec sweep."""
    source = f"{name}_co"
    segment = f", {STEP_SEGMENT} AS bal_seg" if "bal_seg" in dimensions else ""
    ctes = [
        f"\n{source} AS (SELECT *{segment} FROM u WHERE {where})",
        months(source, f"{source}_months"),
        _curve_cte(dimensions, source, f"{name}_curve", having),
    ]
    keys = ", ".join(
        k if k in dimensions else f"CAST(NULL AS VARCHAR) AS {k}"
        for k in ("bal_seg", "channel", "second_home", "state")
    )
    select = (
        f"SELECT '{name}' AS run_id, {TERM_BIGINT}, CAST(loan_age AS BIGINT) AS loan_age, {keys}, "
        + ", ".join(f"{CURVE[x]} AS {x}" for x in SWEEP_COLUMNS)
        + f" FROM {name}_curve"
    )
    return ctes, select


_RUNS = [
    _run("steps", "loan_term = 360 AND eligible = 'Y'", ["bal_seg"]),
    _run("occupancy", "loan_term = 360 AND eligible = 'Y'", ["channel", "second_home"]),
    _run("months", "loan_term = 360 AND orig_date BETWEEN '199601' AND '199606'", ["second_home"]),
    _run("states", "loan_term = 180 AND eligible = 'Y'", ["state"], "HAVING count(*) >= 2"),
]
S["sweep_specs"] = statement(
    "\nUNION ALL ".join(select for _, select in _RUNS), *[cte for ctes, _ in _RUNS for cte in ctes]
)

S["batch_index"] = statement(
    f"""SELECT {TERM_BIGINT}, min(eligible) AS eligible, count(*) AS cohort_loans,
  'cohort' AS run_id
FROM co GROUP BY loan_term
UNION ALL
SELECT {TERM_BIGINT}, eligible, cohort_loans, 'channel-' || channel FROM curve
QUALIFY row_number() OVER (PARTITION BY channel ORDER BY loan_term DESC, loan_age) = 1""",
    _cohort("loan_term = 360 AND eligible = 'Y'"),
    months("co", "co_months"),
    _curve_cte(["channel"], "co", "curve"),
)

# --- presentation ---------------------------------------------------------------------------------

_TEXT_KEYS = "CAST(loan_term AS VARCHAR) AS term, CAST(loan_age AS VARCHAR) AS age"
_ALL_CURVE = (_cohort(), months("co", "co_months"), _curve_cte([], "co", "curve"))
_SUM_UPB = "orig_upb"
_ALS = "orig_upb / loans"

S["format_human"] = statement(
    f"""SELECT {_TEXT_KEYS}, {digits('loans', 0)} AS loans, {digits(_SUM_UPB, 0)} AS orig_upb,
  {digits(_ALS, 0)} AS als, {digits('raw_wa_rate', 3)} AS wa_rate,
  {percent_text('raw_cpr', 2)} AS cpr, {percent_text('raw_smm', 6)} AS smm,
  {percent_text('raw_dlq_30_pct', 2)} AS dlq_30_pct,
  {percent_text('running_loss / cohort_sum', 6)} AS cum_loss_pct
FROM curve""",
    *_ALL_CURVE,
)
S["format_plain"] = statement(
    f"""SELECT {_TEXT_KEYS}, loans, {r2(_SUM_UPB)} AS orig_upb, {r2(_ALS)} AS als,
  round(raw_wa_rate, 5) AS wa_rate, {r6('raw_cpr')} AS cpr, round(raw_smm, 10) AS smm,
  {r6('raw_dlq_30_pct')} AS dlq_30_pct, round(running_loss / cohort_sum, 10) AS cum_loss_pct
FROM curve""",
    *_ALL_CURVE,
)


def _flipped(condition: str, zero: bool = False) -> str:
    value = quotient(f"sum(orig_upb) FILTER (WHERE {condition})", "sum(orig_upb)")
    return r6(f"1 - coalesce({value}, 0)" if zero else f"1 - {value}")


S["sample_check"] = statement(
    f"""SELECT min(vintage) AS vintage, {_label('loan_term', 'All Terms')} AS term,
  count(*) AS cohort_loans, {r2('sum(orig_upb)')} AS cohort_upb,
  {MEASURES['rate_range']} AS rate_range,
  {chosen('als', 'wa_oltv', 'wa_ocltv', 'wa_qfico', 'wa_dti')},
  {chosen('state_ca_pct', 'state_tx_pct', 'state_ny_pct')},
  {_flipped("channel = 'R'")} AS tpo_pct,
  {chosen('second_home_pct', 'first_buyer_pct', 'insured_pct', 'condo_pct', 'multi_borrower_pct')},
  {chosen('multi_unit_pct', 'appr_not_full_pct')},
  {_flipped("eligible = 'N'", True)} AS eligible_pct
FROM u GROUP BY ROLLUP (loan_term, u.vintage)"""
)

_OCCUPANCY = (
    _cohort("loan_term = 360 AND eligible = 'Y'"),
    months("co", "co_months"),
    _curve_cte(["channel", "second_home"], "co", "curve"),
)
S["chart_frame"] = statement(
    f"""SELECT {TERM_BIGINT}, channel, second_home, CAST(loan_age AS BIGINT) AS loan_age,
  {r6('raw_cpr')} AS cpr,
  {r6('raw_dlq_30_pct + raw_dlq_60_pct + raw_dlq_90_pct')} AS total_dlq_pct
FROM curve""",
    *_OCCUPANCY,
)
S["perf_table"] = statement(
    f"""SELECT CAST(loan_age AS BIGINT) AS loan_age, CAST(loan_term AS VARCHAR) AS term,
  CASE second_home WHEN 'Y' THEN 'Second Home' ELSE 'Primary Occ.' END AS occ, eligible,
  {digits('cohort_loans', 0)} AS orig_loan_count, {digits('cohort_sum', 0)} AS orig_upb_text,
  {digits('cohort_sum / cohort_loans', 0)} AS orig_als_text,
  {percent_text('raw_cpr', 2)} AS cpr_text, {percent_text('raw_dlq_30_pct', 2)} AS d30_text,
  {percent_text('raw_dlq_60_pct', 2)} AS d60_text, {percent_text('raw_dlq_90_pct', 2)} AS d90_text,
  {digits('raw_wa_rate', 3)} AS rate_text
FROM curve""",
    *_OCCUPANCY,
)

# --- older reports --------------------------------------------------------------------------------

DEFAULTED = (
    f"{r2('sum(defaulted)')} AS default_upb, "
    f"{r6(quotient('sum(defaulted)', 'sum(orig_upb)'))} AS default_pct"
)


def _older_horizon(actual: str) -> str:
    return (
        f"{r2(f'sum({actual})')} AS horizon_act, {r2('sum(horizon_sched)')} AS horizon_sched, "
        f"{_speed(f'sum({actual})')} AS horizon_cpr"
    )


def _ever_share(column: str) -> str:
    return r6(quotient(f"sum({column})", "sum(orig_upb)"))


_A_KEYS = ("loan_term", "vintage", "channel")
S["legacy_report"] = statement(
    "SELECT "
    + ", ".join(f"{_label(k, 'Total')} AS {k}_label" for k in _A_KEYS)
    + ", "
    + ", ".join(f"CAST(grouping({k}) AS BIGINT) AS g_{k}" for k in _A_KEYS)
    + f""", {chosen('loans', 'orig_upb', 'als')},
  {r6(f'round({quotient("sum(orig_rate)", "count(*)")}, 3)')} AS avg_note_rate,
  {chosen(*CREDIT, *CHARACTERISTICS, 'appr_not_full_pct', 'inel_pct', 'vintages', *STATES_10)},
  {chosen(*[x for x in BREAKDOWN if x != 'appr_not_full_pct'], *SUBLIMITS)},
  {_older_horizon('reported')}, {DEFAULTED},
  {_ever_share('late_60_48')} AS ever_60_pct, {_ever_share('late_120_48')} AS ever_120_pct
FROM hz GROUP BY ROLLUP ({', '.join(_A_KEYS)})""",
    OLDER,
    "\nkept AS (SELECT * EXCLUDE (eligible), new_eligible AS eligible FROM older)",
    _horizon("kept"),
)
S["legacy_report_b"] = _rolled(
    ["vintage", "high_balance_loan_indicator"],
    chosen("loans", "orig_upb", "als", "vintages", *CHANNELS, *STATES_10, *CHARACTERISTICS)
    + ", "
    + chosen(*CREDIT, "inel_pct", *SUBLIMITS)
    + f", {DEFAULTED}, {r2('sum(net_loss)')} AS net_loss, "
    + f"{r6(quotient('sum(net_loss)', 'sum(orig_upb)'))} AS net_loss_pct, "
    + chosen(*BREAKDOWN, "io_pct")
    + f", {_older_horizon('horizon_bal')}, {_ever_share('late_60_48')} AS ever_60_pct, "
    + f"(SELECT {r2('sum(orig_upb)')} FROM older) AS total_orig_upb",
    OLDER,
    _horizon("older"),
    source="hz",
)
S["grand_total"] = _rolled(
    ["state"],
    chosen("loans", "orig_upb")
    + f", (SELECT {r2('sum(orig_upb)')} FROM older) AS total_orig_upb",
    OLDER,
    source="older",
)

_WIDE_AMORT = f"CAST({amortized('h.loan_age')} AS DECIMAL(18,2))"


def _wide_bucket(status: str) -> str:
    return (
        f"CASE WHEN {status} THEN CASE WHEN h.current_upb > 0 THEN h.current_upb"
        f" ELSE {_WIDE_AMORT} END ELSE 0 END"
    )


S["legacy_age_curve"] = _rolled(
    ["channel", "loan_age"],
    chosen("loans", "orig_upb", "als", "current_bal", "sched_bal", "unsched_prin", "smm", "cpr")
    + f", {r2('sum(mo_net_loss)')} AS mo_net_loss, "
    + chosen("dlq_30_pct", "dlq_60_pct", "dlq_90_pct"),
    OLDER,
    f"""
wide AS (
  SELECT m.*, t.zero_bal_code AS code, t.last_upb AS final_upb
  FROM month m LEFT JOIN term t ON m.loan_id = t.loan_id AND m.act_period = t.act_period
),
aged AS (
  SELECT s.*, coalesce(h.loan_age,
      12 * (CAST(substr(h.act_period, 1, 4) AS INT) - CAST(substr(first_pay, 1, 4) AS INT))
      + CAST(substr(h.act_period, 5, 2) AS INT) - CAST(substr(first_pay, 5, 2) AS INT) + 1
    ) AS loan_age,
    CASE WHEN h.current_upb = 0 AND h.loan_age IS NOT NULL THEN {_WIDE_AMORT}
      ELSE h.current_upb END AS current_bal,
    CASE WHEN h.current_upb = 0 AND h.loan_age IS NOT NULL THEN {_WIDE_AMORT}
      WHEN h.current_upb = 0 THEN final_upb ELSE h.current_upb END AS sched_bal,
    CASE WHEN code = '01' THEN final_upb ELSE 0 END AS unsched_prin,
    CASE WHEN code <> '01' THEN net_loss ELSE 0 END AS mo_net_loss,
    {_wide_bucket("dlq_status = '01'")} AS dlq_30, {_wide_bucket("dlq_status = '02'")} AS dlq_60,
    {_wide_bucket("dlq_status >= '03'")} AS dlq_90
  FROM older s LEFT JOIN wide h ON s.loan_id = h.loan_id
    AND (h.loan_age IS NULL OR h.loan_age >= 0)
)""",
    source="aged",
)


# --- report order, echoes and stored tables ---------------------------------------------------------

S["report_by_rank"] = statement(
    """SELECT row_number() OVER (ORDER BY loan_term DESC NULLS LAST, g_seller_rank,
    seller_rank NULLS LAST, g_channel, channel NULLS LAST) AS row_num, * FROM (
  SELECT CAST(loan_term AS BIGINT) AS loan_term, channel, CAST(seller_rank AS BIGINT) AS seller_rank,
    CAST(grouping(loan_term) AS BIGINT) AS g_loan_term,
    CAST(grouping(channel) AS BIGINT) AS g_channel,
    CAST(grouping(seller_rank) AS BIGINT) AS g_seller_rank, count(*) AS loans
  FROM ranked_sellers GROUP BY ROLLUP (loan_term, channel, seller_rank))""",
    SELLERS,
)
S["report_by_age"] = statement(
    """SELECT row_number() OVER (ORDER BY loan_term DESC, channel NULLS LAST, loan_age) AS row_num, *
FROM (SELECT CAST(loan_term AS BIGINT) AS loan_term, channel, CAST(loan_age AS BIGINT) AS loan_age,
    count(*) AS loans
  FROM lm WHERE loan_age IS NOT NULL GROUP BY ALL)""",
    months(),
)
S["originator_of_prefix"] = statement(
    """SELECT CAST(loan_term AS BIGINT) AS loan_term, channel, min(seller) AS originator,
  count(*) AS loans
FROM u WHERE seller LIKE 'BUILD%' GROUP BY loan_term, channel"""
)
S["filter_echo"] = statement(
    f"""SELECT {_label('loan_term', 'All Terms')} AS cohort_term,
  {_label('mi_flag', 'Total')} AS cohort_mi, 'P' AS cohort_purpose, CAST(1 AS BIGINT) AS cohort_units,
  CAST(90 AS BIGINT) AS cohort_max_ltv, 'Y' AS cohort_has_mi, count(*) AS loans,
  {r2('sum(orig_upb)')} AS orig_upb
FROM u WHERE purpose = 'P' AND no_units = 1 AND coalesce(ocltv, 0) <= 90 AND oltv <= 90
  AND coalesce(mi_type, 1) = 1
GROUP BY ROLLUP (loan_term, mi_flag)"""
)
S["stored_age_curve"] = statement(
    f"""SELECT CAST(g.loan_term AS BIGINT) AS loan_term, g.vintage,
  CAST(loan_age AS BIGINT) AS loan_age, loans, orig_upb, cohort_loans,
  CAST(NULL AS DOUBLE) AS horizon_act
FROM (SELECT loan_term, vintage, loan_age, {chosen('loans', 'orig_upb')} FROM lm
  WHERE loan_age IS NOT NULL GROUP BY ALL) g
JOIN (SELECT loan_term, vintage, count(*) AS cohort_loans FROM u GROUP BY ALL) s
  ON s.loan_term = g.loan_term AND s.vintage = g.vintage
WHERE g.vintage IN ('1996', '1997')
UNION ALL SELECT CAST(loan_term AS BIGINT), vintage, NULL, {chosen('loans', 'orig_upb')},
  count(*), {r2('coalesce(sum(horizon_bal), 0)')}
FROM hz WHERE vintage IN ('1996', '1997') GROUP BY loan_term, vintage""",
    months(),
    _horizon("u"),
)
