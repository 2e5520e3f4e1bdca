"""What a cohort run selects, how it groups, and what it shows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column

from loanlens.functions.segments import PERCENTILE_EDGES

# Group-by dimensions in key order. `age` always comes right after the term, so that subtotals
# are per age.
DIMENSIONS = (
    "balance",
    "channel",
    "vintage",
    "state",
    "hbal",
    "first",
    "second_home",
    "mi",
    "seller",
    "servicer",
)

# Column each dimension groups by.
DIMENSION_COLUMNS = {
    "age": "loan_age",
    "balance": "bal_seg",
    "channel": "channel",
    "vintage": "vintage",
    "state": "state",
    "hbal": "high_balance_loan_indicator",
    "first": "first_flag",
    "second_home": "second_home",
    "mi": "mi_flag",
    "seller": "seller_rank",
    "servicer": "servicer_rank",
}

# Display blocks of a report.
DISPLAYS = (
    "strat", "channel", "balance", "geo", "elig", "vintage", "history", "segment", "income"
)

# States with the most loan volume, most first.
# fmt: off
TOP_STATES_25 = (
    "CA", "TX", "FL", "AZ", "CO", "WA", "GA", "NC", "VA", "NY", "UT", "NJ", "PA",
    "IL", "TN", "OR", "MD", "MI", "OH", "MN", "NV", "SC", "MA", "IN", "MO",
)
TOP_STATES_12 = TOP_STATES_25[:12]
TOP_STATES_17 = (
    "CA", "TX", "FL", "MI", "WA", "CO", "AZ", "NY", "VA",
    "NJ", "IL", "NC", "MA", "GA", "PA", "MD", "UT",
)
# fmt: on
TOP_STATES = {12: TOP_STATES_12, 17: TOP_STATES_17, 25: TOP_STATES_25}


@dataclass(frozen=True)
class BalanceSegments:
    """One of: cutoffs in thousands, a list of steps in thousands, or percentiles."""

    low_k: int | None = None
    medium_k: int | None = None
    very_low_k: int | None = None
    steps: tuple[str, ...] = ()
    percentile: bool = False
    edges: tuple[float, float, float] = PERCENTILE_EDGES  # below: very low, low, medium

    def __post_init__(self) -> None:
        chosen = [self.low_k is not None, bool(self.steps), self.percentile]
        if sum(chosen) != 1:
            raise ValueError("choose exactly one of cutoffs, steps and percentile")
        if (self.low_k is None) != (self.medium_k is None):
            raise ValueError("cutoffs need both low_k and medium_k")
        if len(self.edges) != 3 or list(self.edges) != sorted(self.edges):
            raise ValueError("percentile edges are three ascending shares")


@dataclass(frozen=True)
class CohortSpec:
    """Filters, dimensions and displays of one run. Everything is optional; without a vintage bound
    that side is open."""

    first_vintage: int | None = None
    last_vintage: int | None = None

    # --- filters applied before the percentile windows
    orig_months: tuple[str, ...] = ()
    term: int | None = None
    min_balance_k: float | None = None  # exclusive
    max_balance_k: float | None = None  # inclusive
    min_balance: float | None = None  # exclusive, in units
    max_balance: float | None = None  # inclusive, in units
    state: str | None = None
    exclude_state: str | None = None
    states: tuple[str, ...] = ()
    top_states: int | None = None  # 12, 25 (before the windows) or 17 (after them)
    note_rate: str | None = None
    channel: str | None = None
    seller_prefix: str | None = None
    purpose: str | None = None
    units: int | None = None
    min_ltv: int | None = None
    max_ltv: int | None = None
    first_buyer: str | None = None
    where: Column | None = field(default=None, compare=False)
    drop_early_payoffs: bool = True
    limit: int | None = None

    # --- filters applied after the percentile windows
    seller_rank: tuple[int, int] | None = None
    eligible_only: bool = False
    only_30_year: bool = False
    scores: tuple[int | None, int | None] = (None, None)  # low < x <= high
    ltvs: tuple[int | None, int | None] = (None, None)
    cltvs: tuple[int | None, int | None] = (None, None)
    dtis: tuple[int | None, int | None] = (None, None)
    primary_only: bool = False
    full_appraisal_only: bool = False
    average_coupon_only: bool = False

    # --- grouping
    by: tuple[str, ...] = ()
    segments: BalanceSegments | None = None
    rollup: bool = False
    min_count: int | None = None

    # --- display and horizons
    display: tuple[str, ...] = ()
    prepay_horizon: int = 24
    delinquency_horizon: int = 48
    seasoned_only: bool = False
    legacy_terms: bool = False  # three-way term bucket
    legacy_eligibility: bool = False  # also bars penalty and interest-only loans

    def __post_init__(self) -> None:
        unknown = set(self.by) - set(DIMENSIONS) - {"age"}
        if unknown:
            raise ValueError(f"unknown dimensions: {sorted(unknown)}")
        unknown = set(self.display) - set(DISPLAYS)
        if unknown:
            raise ValueError(f"unknown displays: {sorted(unknown)}")
        if self.by_age and "history" in self.display:
            raise ValueError("grouping by age and the history display are incompatible")
        if self.top_states is not None and self.top_states not in TOP_STATES:
            raise ValueError(f"top_states must be one of {sorted(TOP_STATES)}")
        if {"balance"} & (set(self.by) | set(self.display)) and self.segments is None:
            raise ValueError("balance segments are not defined")
        bounded = self.first_vintage is not None and self.last_vintage is not None
        if bounded and self.first_vintage > self.last_vintage:
            raise ValueError("vintage range is empty")

    @staticmethod
    def vintage(year: int, **options: object) -> CohortSpec:
        return CohortSpec(year, year, **options)  # type: ignore[arg-type]

    def but(self, **changes: object) -> CohortSpec:
        return replace(self, **changes)  # type: ignore[arg-type]

    @property
    def by_age(self) -> bool:
        return "age" in self.by

    @property
    def dimensions(self) -> tuple[str, ...]:
        """Active dimensions except age, in key order."""
        return tuple(d for d in DIMENSIONS if d in self.by)

    @property
    def loan_keys(self) -> tuple[str, ...]:
        """Group columns of the loan-level summary."""
        return ("loan_term", *(DIMENSION_COLUMNS[d] for d in self.dimensions))

    @property
    def group_keys(self) -> tuple[str, ...]:
        """Group columns of the report."""
        age = ("loan_age",) if self.by_age else ()
        return ("loan_term", *age, *self.loan_keys[1:])

    @property
    def shows_segment_range(self) -> bool:
        """Loan-level reports by balance show each segment's range; age curves only if asked."""
        return "segment" in self.display or ("balance" in self.by and not self.by_age)

    @property
    def single_vintage(self) -> bool:
        return self.first_vintage is not None and self.first_vintage == self.last_vintage
