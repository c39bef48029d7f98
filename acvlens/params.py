"""Parameters of the analyses, with the reference's values as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's for right results:
# stage names, the default first year of the yearly tables, the
# service-line list of the purchase-cycle report, the gap cut-off, and the
# labels that appear as values or column names in the outputs.
WON = "6 - Closed Won"
LOST = "7 - Closed Lost"
DEFAULT_MIN_YEAR = 2018
DEFAULT_SERVICE_LINES = (
    "Cost Seg",
    "Energy",
    "GOAT.tax",
    "R&D",
    "SALT",
    "LIFO - IPIC / Internal",
    "LIFO - Auto",
)
DEFAULT_MAX_GAP_DAYS = 1000
HAS_REFERRAL = "Has Referral"
NO_REFERRAL = "No Referral"
WIN_WITH_REFERRAL = "Win % with Referral"
WIN_WITHOUT_REFERRAL = "Win % without Referral"
TOTAL_COUNT = "Total Count of Opps"
METRIC_LABEL = "Metric"
MISSING_TEXT = "-"
SUMMARY_LABELS = {
    "distinct_service_lines": "Distinct Service Lines",
    "sum_acv": "Total ACV (USD)",
    "avg_acv": "Average ACV (USD)",
    "median_acv": "Median ACV (USD)",
    "num_accounts": "# of Accounts",
}

# Referral columns in the order the reference binds them.
REFERRER_COLUMNS = ("Referring_CPA__c", "Referral_2_Account__c", "Referral_1_Account__c")
# Client-side columns in bind order: CPA contact first, end client second.
CLIENT_CPA_COLUMNS = ("CPA_Contact_Account__c", "AccountId")


@dataclass(frozen=True)
class Params:
    won: str = WON
    lost: str = LOST
    min_year: int = DEFAULT_MIN_YEAR
    # Explicit pivot columns, which also filter: rows of other years are left out.
    # None → one column per year in the data.
    years: tuple[int, ...] | None = None
    service_lines: tuple[str, ...] = field(default=DEFAULT_SERVICE_LINES)
    max_gap_days: int = DEFAULT_MAX_GAP_DAYS
    # opportunity.Id is the CRM primary key: per-row de-duplication of
    # referral edges is then exact and the opportunity fields ride along
    # with the edges without a self-join.
    unique_opportunity_id: bool = True
    # Opt-in: approximate (HyperLogLog++) counts for the distinct counts of
    # accounts and opportunities; the default is exact.
    approx_distinct: bool = False


# Parameters for the driver-derived fixture tables (FIXTURES.md).
FIXTURE_PARAMS = Params(
    min_year=1998,
    years=(1998, 1999, 2000, 2001),
    service_lines=("ECONOMY", "SMALL", "PROMO", "LARGE"),
)
