"""Opportunity volume vs service-line penetration vs sales (Q31–Q39)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import corr0, currency, n, sum0
from ..operators.categories import by_category, category_totals, key_totals
from ..operators.stats import boxplot_stats, lm_fit, lm_fit_line, median_exact
from ..params import SUMMARY_LABELS, Params
from ..session import materialize

X_CHOICES = ("num_opportunities", "distinct_service_lines")


def _scope(report: DataFrame, p: Params, scope: str) -> DataFrame:
    if scope == "won":
        return report.filter(F.col("Stage") == p.won)
    if scope == "all":
        return report
    raise ValueError(f"scope must be 'won' or 'all', not {scope!r}")


def _of_scope(accounts: DataFrame, scope: str) -> DataFrame:
    """Q34a or Q34b from the written ``acct_sales_both``."""
    cols = ("num_opportunities", "distinct_service_lines", "total_acv")
    return (accounts.where(f"{scope}_num_opportunities IS NOT NULL")
            .select("Acct_Id", *[F.col(f"{scope}_{c}").alias(c) for c in cols]))


def acct_volume_lines(report: DataFrame, p: Params, accounts: DataFrame | None = None) -> DataFrame:
    """Q31: won rows per account: row count and distinct service lines.

    Here and below ``accounts`` is ``acct_sales_both`` if it is already written.
    """
    if accounts is not None:
        return _of_scope(accounts, "won").drop("total_acv")
    won = by_category(_scope(report, p, "won"), ["Acct_Id"], "Record_Type_Name", "distinct_service_lines",
                      {"num_opportunities": n()})
    return won.select("Acct_Id", "num_opportunities", "distinct_service_lines")


def volume_lines_scatter(report: DataFrame, p: Params, accounts: DataFrame | None = None) -> DataFrame:
    """Q32: scatter of Q31 as (x, y, accounts at that point)."""
    return acct_volume_lines(report, p, accounts).groupBy("num_opportunities", "distinct_service_lines") \
        .agg(n().alias("n_accounts"))


def lines_by_volume_boxplot(report: DataFrame, p: Params, accounts: DataFrame | None = None) -> DataFrame:
    """Q33: box-plot statistics of distinct service lines by opportunity count."""
    lines = acct_volume_lines(report, p, accounts)
    return boxplot_stats(lines if accounts is not None else materialize(lines), ["num_opportunities"],
                         "distinct_service_lines")


def acct_sales(report: DataFrame, p: Params, scope: str = "won", accounts: DataFrame | None = None) -> DataFrame:
    """Q34a (won) / Q34b (all stages): per account rows, distinct service lines, ACV."""
    if accounts is not None:
        return _of_scope(accounts, scope)
    return by_category(_scope(report, p, scope), ["Acct_Id"], "Record_Type_Name", "distinct_service_lines",
                       {"num_opportunities": n(), "total_acv": sum0("ACV_for_Quotas")}) \
        .select("Acct_Id", "num_opportunities", "distinct_service_lines", "total_acv")


def acct_line_totals(report: DataFrame, p: Params) -> DataFrame:
    """Rows and ACV per (account, service line), over all stages and won: additive, so parts of a report can be merged."""
    won = F.coalesce(F.col("Stage") == p.won, F.lit(False))
    return category_totals(report, ["Acct_Id"], "Record_Type_Name", {
        "all_num_opportunities": n(), "all_total_acv": sum0("ACV_for_Quotas"),
        "__won_n": F.count_if(won), "__won_acv": sum0(F.when(won, F.col("ACV_for_Quotas")))})


def acct_sales_of(totals: DataFrame) -> DataFrame:
    """Q34a and Q34b per account from its totals per service line (``acct_line_totals``)."""
    a = key_totals(totals, ["Acct_Id"], "all_distinct_service_lines", distinct_if={"__won_lines": "__won_n"})
    has_won = F.col("__won_n") > 0
    return a.select(
        "Acct_Id", "all_num_opportunities", "all_distinct_service_lines", "all_total_acv",
        F.when(has_won, F.col("__won_n")).alias("won_num_opportunities"),
        F.when(has_won, F.col("__won_lines")).alias("won_distinct_service_lines"),
        F.when(has_won, F.col("__won_acv")).alias("won_total_acv"))


def acct_sales_both(report: DataFrame, p: Params) -> DataFrame:
    """Q34a and Q34b in one pass: per account, the all-stage and the won-only figures.

    One scan and one shuffle instead of one per scope.  Accounts without a won
    row have NULL won figures (they are absent from the won scope).
    """
    return acct_sales_of(acct_line_totals(report, p))


def sales_correlation(report: DataFrame, p: Params, scopes=("won", "all"),
                      accounts: DataFrame | None = None) -> DataFrame:
    """Q35: corr(opportunities, ACV) and corr(service lines, ACV) per scope, as rows."""
    both = acct_sales_both(report, p) if accounts is None else accounts
    cols = []
    for scope in scopes:
        for x in X_CHOICES:
            cols.append(corr0(f"{scope}_{x}", f"{scope}_total_acv").alias(f"{scope}|{x}"))
    wide = both.agg(*cols)
    long = wide.unpivot([], [f"`{c}`" for c in wide.columns], "__k", "correlation")
    return long.select(F.split("__k", r"\|")[0].alias("scope"), F.split("__k", r"\|")[1].alias("x_var"),
                       "correlation")


def sales_scatter(report: DataFrame, p: Params, scope: str = "won", accounts: DataFrame | None = None) -> DataFrame:
    """Q36: scatter points (one per account) for both x choices against ACV."""
    s = acct_sales(report, p, scope, accounts)
    return s.select("Acct_Id", *[F.col(c).cast("long").alias(c) for c in X_CHOICES], "total_acv") \
            .unpivot(["Acct_Id", "total_acv"], list(X_CHOICES), "x_var", "x") \
            .select(F.lit(scope).alias("scope"), "Acct_Id", "x_var", "x", "total_acv")


def sales_fit(report: DataFrame, p: Params, scopes=("won", "all"), accounts: DataFrame | None = None) -> DataFrame:
    """Q37: least-squares line of ACV on each x choice, per scope (one pass over the rows)."""
    both = acct_sales_both(report, p) if accounts is None else accounts
    parts = [F.struct(F.lit(scope).alias("scope"), F.lit(x).alias("x_var"),
                      F.col(f"{scope}_{x}").cast("long").alias("x"),
                      F.col(f"{scope}_total_acv").alias("total_acv"))
             for scope in scopes for x in X_CHOICES]
    long = both.select(F.explode(F.array(*parts)).alias("__p")).select("__p.*") \
               .filter(F.col("total_acv").isNotNull())
    return lm_fit(long, "x", "total_acv", group_cols=["scope", "x_var"])


def sales_fit_line(report: DataFrame, p: Params, scopes=("won", "all"), n_points: int = 80,
                   accounts: DataFrame | None = None) -> DataFrame:
    """Q37 (line): the fitted lines as drawn, ``n_points`` per scope × x choice."""
    return lm_fit_line(sales_fit(report, p, scopes, accounts), ["scope", "x_var"], n_points)


def acv_by_service_lines(report: DataFrame, p: Params, accounts: DataFrame | None = None) -> DataFrame:
    """Q38: per number of distinct service lines: sum, mean and median account ACV, accounts."""
    a = acct_sales(report, p, "won", accounts)
    if accounts is None:
        a = materialize(a)   # read by the totals and the median passes
    totals = a.groupBy("distinct_service_lines").agg(
        F.sum("total_acv").cast("decimal(38,2)").alias("sum_acv"),
        (F.sum("total_acv").cast("double") / n().cast("double")).alias("avg_acv"),
        n().alias("num_accounts"))
    med = median_exact(a, ["distinct_service_lines"], "total_acv", "median_acv")
    return totals.join(med, "distinct_service_lines", "inner") \
                 .select("distinct_service_lines", "sum_acv", "avg_acv", "median_acv", "num_accounts")


def acv_by_service_lines_fmt(report: DataFrame, p: Params, accounts: DataFrame | None = None) -> DataFrame:
    """Q39: Q38 with money as ``$1,234.56`` text and display labels."""
    s = acv_by_service_lines(report, p, accounts)
    return s.select(
        F.col("distinct_service_lines").alias(SUMMARY_LABELS["distinct_service_lines"]),
        currency("sum_acv").alias(SUMMARY_LABELS["sum_acv"]),
        currency("avg_acv").alias(SUMMARY_LABELS["avg_acv"]),
        currency("median_acv").alias(SUMMARY_LABELS["median_acv"]),
        F.col("num_accounts").alias(SUMMARY_LABELS["num_accounts"]))
