"""Referral attribution, win rates, ranking and yearly referral tables (Q01–Q14, Q40)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (any_present, closed_since, dollar, dollar_auto, n, n_distinct, pct_text, safe_ratio,
                               sum0, year_of)
from ..operators.bitmaps import distinct_bitmaps, distinct_counts, numbered_ids
from ..operators.categories import by_category
from ..operators.edges import edges
from ..operators.joins import lookup
from ..operators.reshape import pivot_wider, transpose_metrics
from ..params import (HAS_REFERRAL, METRIC_LABEL, MISSING_TEXT, NO_REFERRAL, REFERRER_COLUMNS,
                      TOTAL_COUNT, WIN_WITH_REFERRAL, WIN_WITHOUT_REFERRAL, Params)
from ..session import materialize
from ..sources.schemas import ALL_OPP_FIELDS, OPP_FIELDS


def has_referral():
    return any_present(*REFERRER_COLUMNS)


def account_names(account: DataFrame) -> DataFrame:
    return account.select(F.col("Id").alias("Account_Id"), "Name", "Client_Type__c")


def pivot_years(p: Params, df: DataFrame, year_col: str = "year") -> tuple[DataFrame, list[int]]:
    """``df`` (year-level rows) and the years to make columns of.

    Explicit ``Params.years`` are taken as they are (rows of other years are
    left out).  Otherwise they are the years in the data: the year-level rows
    are written once, and both the list and the pivot read them there.
    """
    if p.years is not None:
        return df, list(p.years)
    df = materialize(df)
    return df, sorted(r[0] for r in df.select(year_col).distinct().collect() if r[0] is not None)


# --- Q01–Q03 --------------------------------------------------------------------

def referral_edges(opp: DataFrame, p: Params) -> DataFrame:
    """Q01: distinct (Id, Account_Id) over the three referrer columns."""
    return edges(opp, REFERRER_COLUMNS, unique_id=p.unique_opportunity_id)


def referral_merged(opp: DataFrame, p: Params) -> DataFrame:
    """Q02: referral edges with the opportunity's accessory fields."""
    return edges(opp, REFERRER_COLUMNS, carry=OPP_FIELDS, unique_id=p.unique_opportunity_id)


def opp_referral_flag(opp: DataFrame, p: Params) -> DataFrame:
    """Q03: every opportunity flagged "Has Referral" / "No Referral"."""
    cat = F.when(has_referral(), F.lit(HAS_REFERRAL)).otherwise(F.lit(NO_REFERRAL))
    return opp.select(*ALL_OPP_FIELDS, cat.alias("category"))


# --- Q04–Q06, Q40: win rate by year ---------------------------------------------

def _closed_since(opp: DataFrame, p: Params) -> DataFrame:
    return opp.filter(closed_since(opp, "CloseDate", p.min_year)
                      & F.col("StageName").isin(p.won, p.lost))


def win_pct_by_year(opp: DataFrame, p: Params) -> DataFrame:
    """Q04: win % of closed opportunities by (year, with / without referral)."""
    cat = F.when(has_referral(), F.lit(WIN_WITH_REFERRAL)).otherwise(F.lit(WIN_WITHOUT_REFERRAL))
    return (_closed_since(opp, p)
            .select(year_of("CloseDate").alias("year"), cat.alias("category"), "StageName")
            .groupBy("year", "category")
            .agg((F.count_if(F.col("StageName") == p.won).cast("double")
                  / n().cast("double") * F.lit(100.0)).alias("win_percentage")))


def opp_count_by_year(opp: DataFrame, p: Params) -> DataFrame:
    """Q05: closed opportunities per year, as the "Total Count of Opps" row set."""
    return (_closed_since(opp, p)
            .groupBy(year_of("CloseDate").alias("year"))
            .agg(n().alias("total_opps"))
            .select("year", F.lit(TOTAL_COUNT).alias("category"),
                    F.col("total_opps").cast("long").alias("win_percentage")))


def win_pct_summary(opp: DataFrame, p: Params) -> DataFrame:
    """Q06: Q04 ∪ Q05 as text (counts whole, rates "53.8%"), years as columns.

    One scan and one aggregate by year give all counts; the categories are
    rows made of the few year rows.
    """
    won, ref = F.col("StageName") == p.won, has_referral()
    y = (_closed_since(opp, p)
         .groupBy(year_of("CloseDate").alias("year"))
         .agg(n().alias("__n"), F.count_if(ref).alias("__n1"), F.count_if(ref & won).alias("__w1"),
              F.count_if(won).alias("__w")))
    y, years = pivot_years(p, y)

    def rate(won_rows: str, rows: str) -> Column:
        """Missing where the year has no such row."""
        share = F.try_divide(F.expr(won_rows).cast("double"), F.expr(rows).cast("double"))
        return pct_text(share * F.lit(100.0), 1)

    rows = F.array(F.struct(F.lit(WIN_WITH_REFERRAL).alias("category"), rate("__w1", "__n1").alias("win_percentage")),
                   F.struct(F.lit(WIN_WITHOUT_REFERRAL).alias("category"),
                            rate("__w - __w1", "__n - __n1").alias("win_percentage")),
                   F.struct(F.lit(TOTAL_COUNT).alias("category"), F.col("__n").cast("string").alias("win_percentage")))
    both = y.select("year", F.explode(rows).alias("__r")).select("year", "__r.*").where("win_percentage IS NOT NULL")
    return pivot_wider(both, ["category"], "year", "win_percentage", years)


def win_pct_display(opp: DataFrame, p: Params, summary: DataFrame | None = None) -> DataFrame:
    """Q40: Q06 as displayed: missing cells "-", first column labelled "Metric" (``summary``: Q06 if written)."""
    w = win_pct_summary(opp, p) if summary is None else summary
    return w.select(F.col("category").alias(METRIC_LABEL),
                    *[F.coalesce(F.col(f"`{c}`"), F.lit(MISSING_TEXT)).alias(c)
                      for c in w.columns if c != "category"])


# --- Q07–Q09: per-referrer totals and ranking -----------------------------------

def referral_summary(opp: DataFrame, p: Params) -> DataFrame:
    """Q07: won referral edges per referrer: ACV, TCV, rows, distinct record types."""
    won = referral_merged(opp, p).filter(F.col("StageName") == p.won)
    return by_category(won, ["Account_Id"], "Record_Type_Name__c", "referral_record_type_count",
                       {"R_total_acv": sum0("ACV_for_Quotas__c"), "R_total_tcv": sum0("TCV_Gross__c"),
                        "referral_opp_count": n()})


def referral_summary_named(opp: DataFrame, account: DataFrame, p: Params,
                           summary: DataFrame | None = None) -> DataFrame:
    """Q08: Q07 (``summary`` if already written) with the referrer's account name (lookup after the aggregation)."""
    s = referral_summary(opp, p) if summary is None else summary
    return lookup(s, account_names(account), "Account_Id", write_left=summary is None)


def referral_ranked(opp: DataFrame, account: DataFrame, p: Params,
                    top_k: int | None = None, sort: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """Q09 (flagship): referrers ranked by ACV, money as ``$1,234`` text.

    Sorted on the number before it is formatted; ties by account id.
    ``top_k`` turns the sort into a top-k (TakeOrderedAndProject).
    ``sort=False`` gives the same rows unordered, for use inside a join.
    """
    s = referral_summary_named(opp, account, p, summary)
    if sort or top_k is not None:
        s = s.orderBy(F.col("R_total_acv").desc_nulls_last(), F.col("Account_Id").asc_nulls_last())
    if top_k is not None:
        s = s.limit(top_k)
    return s.select("Name", dollar("R_total_acv").alias("R_total_acv"),
                    dollar("R_total_tcv").alias("R_total_tcv"),
                    "referral_opp_count", "referral_record_type_count")


# --- Q10–Q12: yearly referral tables ----------------------------------------------

def _won_referral_edges_since(opp: DataFrame, p: Params) -> DataFrame:
    """Edges of the won opportunities since the first year; both bounds reach the scan."""
    won = opp.filter((F.col("StageName") == p.won) & closed_since(opp, "CloseDate", p.min_year))
    return referral_merged(won, p).select("Id", "Account_Id", year_of("CloseDate").alias("year"),
                                          F.coalesce(F.col("ACV_for_Quotas__c"), F.lit(0)).alias("acv"))


def referral_yearly_unique(opp: DataFrame, p: Params) -> DataFrame:
    """Q10: per year distinct referred opportunities, their ACV counted once, and
    distinct referrers; metrics as rows, years as columns (all text)."""
    if p.unique_opportunity_id:
        # One scan: the first edge of each opportunity carries its figures, so
        # no de-duplication by Id (and no shuffle on Id) is needed.
        e = (edges(opp.filter((F.col("StageName") == p.won) & closed_since(opp, "CloseDate", p.min_year)),
                   REFERRER_COLUMNS, carry=("CloseDate", "ACV_for_Quotas__c"), first_flag="__first")
             .select("Account_Id", "__first", year_of("CloseDate").alias("year"),
                     F.coalesce(F.col("ACV_for_Quotas__c"), F.lit(0)).alias("acv")))
        y = e.groupBy("year").agg(
            F.count_if("__first").alias("opportunity_count"),
            F.sum(F.when(F.col("__first"), F.col("acv"))).alias("referral_acv"),
            n_distinct("Account_Id", p.approx_distinct).alias("distinct_referral_accounts"))
    else:
        e = _won_referral_edges_since(opp, p)
        per_opp = e.groupBy("year", "Id").agg(F.max("acv").alias("acv"))
        opps = per_opp.groupBy("year").agg(n().alias("opportunity_count"),
                                           F.sum("acv").alias("referral_acv"))
        accts = e.groupBy("year").agg(n_distinct("Account_Id", p.approx_distinct)
                                      .alias("distinct_referral_accounts"))
        y = opps.join(accts, "year", "inner")
    y = y.select(
        "year",
        dollar("referral_acv").alias("referral_acv"),
        F.col("opportunity_count").cast("string").alias("opportunity_count"),
        F.col("distinct_referral_accounts").cast("string").alias("distinct_referral_accounts"))
    y, years = pivot_years(p, y)
    return transpose_metrics(y, "year", ["referral_acv", "opportunity_count", "distinct_referral_accounts"], years)


def referral_yearly_credit(opp: DataFrame, p: Params) -> DataFrame:
    """Q11: per year ACV and rows with each referrer credited in full."""
    y = (_won_referral_edges_since(opp, p)
         .groupBy("year")
         .agg(F.sum("acv").alias("referral_acv"), n().alias("opportunity_count"))
         .select("year", dollar_auto("referral_acv").alias("referral_acv"),
                 F.col("opportunity_count").cast("string").alias("opportunity_count")))
    y, years = pivot_years(p, y)
    return transpose_metrics(y, "year", ["referral_acv", "opportunity_count"], years)


def referral_account_acv(opp: DataFrame, p: Params, summary: DataFrame | None = None) -> DataFrame:
    """Q12: won referral edges per referrer: ACV and row count (from Q07 if it is already written)."""
    if summary is not None:
        return summary.select("Account_Id", F.col("R_total_acv").alias("total_acv"),
                              F.col("referral_opp_count").alias("opportunity_count"))
    return (referral_merged(opp, p)
            .filter(F.col("StageName") == p.won)
            .groupBy("Account_Id")
            .agg(sum0("ACV_for_Quotas__c").alias("total_acv"), n().alias("opportunity_count")))


def referrer_bitmaps(opp: DataFrame, p: Params) -> DataFrame:
    """Referrers of the won opportunities per year as bitmaps: the table from which Q10's distinct counts merge."""
    e = materialize(_won_referral_edges_since(opp, p).select("year", "Account_Id").distinct())
    return distinct_bitmaps(e, ["year"], "Account_Id", materialize(numbered_ids(e, "Account_Id")))


def referrer_counts(bitmaps: DataFrame) -> DataFrame:
    """Distinct referrers per year, and over all years (year missing), from one table of bitmaps."""
    total = distinct_counts(bitmaps, [], "distinct_referral_accounts")
    return (distinct_counts(bitmaps, ["year"], "distinct_referral_accounts")
            .unionByName(total.withColumn("year", F.lit(None).cast("long"))))


# --- Q13–Q14: referral share of sales -------------------------------------------

def referral_share_by_year(opp: DataFrame, p: Params) -> DataFrame:
    """Q13: total won ACV, referral ACV and the referral share (%) per year."""
    won = opp.filter((F.col("StageName") == p.won) & closed_since(opp, "CloseDate", p.min_year))
    y = won.groupBy(year_of("CloseDate").alias("year")).agg(
        sum0("ACV_for_Quotas__c").alias("total_sales"),
        sum0(F.when(has_referral(), F.col("ACV_for_Quotas__c"))).alias("referral_sales"))
    return y.withColumn("referral_percentage",
                        safe_ratio(F.col("referral_sales"), F.col("total_sales")) * F.lit(100.0))


def referral_share_dual_axis(opp: DataFrame, p: Params) -> DataFrame:
    """Q14: Q13 plus the share rescaled onto the sales axis (× max sales / 100).

    The maximum is a window over the year-level rows: at most one row per
    year reaches that single partition.
    """
    y = referral_share_by_year(opp, p)
    all_years = Window.partitionBy()
    y = y.withColumn("max_total_sales", F.max("total_sales").over(all_years))
    return y.withColumn("referral_line",
                        F.col("referral_percentage") * F.col("max_total_sales").cast("double") / F.lit(100.0))
