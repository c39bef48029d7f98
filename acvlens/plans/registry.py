"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query derives its inputs from the TPC-H-style parquet tables of one
scale-factor directory (``sources.fixtures``) and runs one plan of
``plans.*`` with the fixture parameters.  Doubles whose last bits depend
on summation order or interpolation formula are rounded here, to the same
places as in the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import FIXTURE_PARAMS as P
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import tables
from . import clients, cycles, penetration, referral

Query = Callable[[SparkSession, str], DataFrame]


def _opp(s: SparkSession, d: str, tcv: bool = False) -> DataFrame:
    return fx.opportunity(s, d, with_tcv=tcv)


def _acc(s: SparkSession, d: str) -> DataFrame:
    return fx.account(s, d)


def _rep(s: SparkSession, d: str) -> DataFrame:
    return fx.opp_report(s, d)


def _round(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places[c]).alias(c) if c in places else F.col(f"`{c}`")
                       for c in df.columns])


def _report_through_csv(s: SparkSession, d: str) -> DataFrame:
    """The report written as a CSV export to the shared folder and read back by header name."""
    path = f"{checkpoint_dir(s)}/export-{uuid.uuid4().hex}"
    tables.write_csv(_rep(s, d), path)
    return tables.read_opp_report_csv(s, path)


def _opp_by_year(s: SparkSession, d: str) -> DataFrame:
    """The opportunities landed by close year in the shared folder and read from there."""
    path = f"{checkpoint_dir(s)}/opportunity-{uuid.uuid4().hex}"
    tables.write_opportunity(_opp(s, d), path)
    return tables.read_opportunity(s, path)


# Without explicit pivot years: the years in the data.
P_ANY_YEAR = replace(P, years=None)

QUERIES: dict[str, Query] = {
    # referral attribution (opportunity, account)
    "q01_referral_edges": lambda s, d: referral.referral_edges(_opp(s, d), P),
    "q02_referral_merged": lambda s, d: referral.referral_merged(_opp(s, d, True), P),
    "q03_opp_referral_flag": lambda s, d: referral.opp_referral_flag(_opp(s, d, True), P),
    "q04_win_pct_by_year": lambda s, d: referral.win_pct_by_year(_opp(s, d), P),
    "q05_opp_count_by_year": lambda s, d: referral.opp_count_by_year(_opp(s, d), P),
    "q06_win_pct_summary": lambda s, d: referral.win_pct_summary(_opp(s, d), P),
    "q06d_win_pct_summary_any_year": lambda s, d: referral.win_pct_summary(_opp(s, d), P_ANY_YEAR),
    "q07_referral_summary": lambda s, d: referral.referral_summary(_opp(s, d, True), P),
    "q08_referral_summary_named": lambda s, d: referral.referral_summary_named(
        _opp(s, d, True), _acc(s, d), P),
    "q09_referral_ranked": lambda s, d: referral.referral_ranked(_opp(s, d, True), _acc(s, d), P),
    "q10_referral_yearly_unique": lambda s, d: referral.referral_yearly_unique(_opp(s, d), P),
    "q11_referral_yearly_credit": lambda s, d: referral.referral_yearly_credit(_opp(s, d), P),
    "q10d_referral_yearly_unique_any_year": lambda s, d: referral.referral_yearly_unique(_opp(s, d), P_ANY_YEAR),
    "q11d_referral_yearly_credit_any_year": lambda s, d: referral.referral_yearly_credit(_opp(s, d), P_ANY_YEAR),
    "q10p_referral_yearly_unique_by_year": lambda s, d: referral.referral_yearly_unique(_opp_by_year(s, d), P),
    "q11p_referral_yearly_credit_by_year": lambda s, d: referral.referral_yearly_credit(_opp_by_year(s, d), P),
    "q13p_referral_share_by_year": lambda s, d: referral.referral_share_by_year(_opp_by_year(s, d), P),
    "q10b_referrers_by_year_and_total": lambda s, d: referral.referrer_counts(referral.referrer_bitmaps(_opp(s, d), P)),
    "q12_referral_account_acv": lambda s, d: referral.referral_account_acv(_opp(s, d), P),
    "q13_referral_share_by_year": lambda s, d: referral.referral_share_by_year(_opp(s, d), P),
    "q14_referral_share_dual_axis": lambda s, d: referral.referral_share_dual_axis(_opp(s, d), P),
    # client / CPA side
    "q15_client_cpa_edges": lambda s, d: clients.client_cpa_edges(_opp(s, d), P),
    "q16_client_cpa_summary": lambda s, d: clients.client_cpa_summary(_opp(s, d, True), _acc(s, d), P),
    "q17_sales_referral_full": lambda s, d: clients.sales_referral_full(_opp(s, d, True), _acc(s, d), P),
    "q17b_sales_referral_left": lambda s, d: clients.sales_referral_left(_opp(s, d, True), _acc(s, d), P),
    "q18_cpa_client_pairs": lambda s, d: clients.cpa_client_pairs(_opp(s, d), P),
    "q19_cpa_client_summary": lambda s, d: clients.cpa_client_summary(_opp(s, d), P),
    "q20_cpa_client_avg": lambda s, d: clients.cpa_client_avg(_opp(s, d), P),
    "q21_cpa_client_summary_named": lambda s, d: clients.cpa_client_summary_named(
        _opp(s, d), _acc(s, d), P),
    # purchase cycles (opp_report)
    "q22_report_won": lambda s, d: cycles.report_won(_rep(s, d), P),
    "q22c_report_won_csv": lambda s, d: cycles.report_won(_report_through_csv(s, d), P),
    "q23_report_client_rows": lambda s, d: cycles.report_client_rows(_rep(s, d), P),
    "q24_report_cpa_rows": lambda s, d: cycles.report_cpa_rows(_rep(s, d), P),
    "q25_report_dedup": lambda s, d: cycles.report_dedup(_rep(s, d), P),
    "q25b_report_dedup_by_party": lambda s, d: cycles.report_dedup_by_party(_rep(s, d), P),
    "q25c_report_dedup_sorted": lambda s, d: cycles.report_dedup_sorted(_rep(s, d), P),
    "q26_service_line_counts": lambda s, d: cycles.service_line_counts(_rep(s, d), P),
    "q26b_accounts_by_line_and_total": lambda s, d: cycles.service_line_accounts(
        cycles.service_line_bitmaps(_rep(s, d), P)),
    "q27_purchase_gaps": lambda s, d: cycles.purchase_gaps(_rep(s, d), P),
    "q28_purchase_cycles": lambda s, d: _round(cycles.purchase_cycles(_rep(s, d), P),
                                               {"avg_cycle": 6, "median_cycle": 6}),
    "q29_cycle_boxplot": lambda s, d: _round(cycles.cycle_boxplot(_rep(s, d), P),
                                             {"q1": 6, "median": 6, "q3": 6,
                                              "lower_whisker": 6, "upper_whisker": 6}),
    "q29b_cycle_boxplot_outliers": lambda s, d: _round(cycles.cycle_boxplot_outliers(_rep(s, d), P),
                                                       {"avg_cycle": 6}),
    "q30_cycle_density": lambda s, d: _round(cycles.cycle_density(_rep(s, d), P),
                                             {"x": 6, "density": 12, "bw": 9}),
    # volume vs penetration vs sales (opp_report)
    "q31_acct_volume_lines": lambda s, d: penetration.acct_volume_lines(_rep(s, d), P),
    "q32_volume_lines_scatter": lambda s, d: penetration.volume_lines_scatter(_rep(s, d), P),
    "q33_lines_by_volume_boxplot": lambda s, d: _round(penetration.lines_by_volume_boxplot(_rep(s, d), P),
                                                       {"q1": 6, "median": 6, "q3": 6}),
    "q34a_acct_sales_won": lambda s, d: penetration.acct_sales(_rep(s, d), P, "won"),
    "q34b_acct_sales_all": lambda s, d: penetration.acct_sales(_rep(s, d), P, "all"),
    "q35_sales_correlation": lambda s, d: _round(penetration.sales_correlation(_rep(s, d), P),
                                                 {"correlation": 9}),
    "q36_sales_scatter": lambda s, d: penetration.sales_scatter(_rep(s, d), P, "won"),
    "q36b_sales_scatter_all": lambda s, d: penetration.sales_scatter(_rep(s, d), P, "all"),
    "q37_sales_fit": lambda s, d: _round(penetration.sales_fit(_rep(s, d), P),
                                         {"slope": 4, "intercept": 4, "r2": 9,
                                          "y_at_x_min": 4, "y_at_x_max": 4}),
    "q37b_sales_fit_line": lambda s, d: _round(penetration.sales_fit_line(_rep(s, d), P),
                                               {"x": 6, "fitted": 4}),
    "q38_acv_by_service_lines": lambda s, d: _round(penetration.acv_by_service_lines(_rep(s, d), P),
                                                    {"avg_acv": 6, "median_acv": 6}),
    "q39_acv_by_service_lines_fmt": lambda s, d: penetration.acv_by_service_lines_fmt(_rep(s, d), P),
    # display
    "q40_win_pct_display": lambda s, d: referral.win_pct_display(_opp(s, d), P),
}

FLAGSHIP = "q09_referral_ranked"
