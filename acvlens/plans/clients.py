"""End-client / CPA-contact side (Q15–Q21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dollar, n, n_distinct, present, sum0
from ..operators.categories import by_category
from ..operators.edges import edges, present_values
from ..operators.joins import full_join_null_safe, left_join_null_safe, lookup
from ..params import CLIENT_CPA_COLUMNS, REFERRER_COLUMNS, Params
from ..session import materialize
from .referral import account_names


def client_cpa_edges(opp: DataFrame, p: Params) -> DataFrame:
    """Q15: distinct (Id, Account_Id) over the CPA contact and the end client."""
    return edges(opp, CLIENT_CPA_COLUMNS, unique_id=p.unique_opportunity_id)


def client_cpa_summary(opp: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    """Q16: won opportunities per client-or-CPA account: ACV, TCV (``$`` text),
    distinct record types, then the account name and type."""
    e = edges(opp, CLIENT_CPA_COLUMNS,
              carry=("ACV_for_Quotas__c", "TCV_Gross__c", "Record_Type_Name__c", "StageName"),
              unique_id=p.unique_opportunity_id)
    s = by_category(e.filter(F.col("StageName") == p.won), ["Account_Id"], "Record_Type_Name__c", "record_type_count",
                    {"acv": sum0("ACV_for_Quotas__c"), "tcv": sum0("TCV_Gross__c")})
    s = s.select("Account_Id", dollar("acv").alias("D_total_acv"), dollar("tcv").alias("D_total_tcv"),
                 "record_type_count")
    # Clients and CPAs cover most of the account table: a plain left join
    # (no key-set reduction of the dimension, which pays off only for few keys).
    return lookup(s, account_names(account), "Account_Id", reduce_dim=False)


def _won_totals_by_side(opp: DataFrame, p: Params) -> DataFrame:
    """Won figures per referrer and per client/CPA account, from one scan.

    Each won opportunity yields its referrer edges (side ``ref``) and its
    client/CPA edges (side ``cc``), each de-duplicated within the row (the
    opportunity Id is the key); one aggregate keyed by (side, account)
    gives both summaries' sums, counts and record-type counts.
    """
    tag = lambda side: (lambda a: F.struct(F.lit(side).alias("side"), a.alias("Account_Id")))
    e = F.explode(F.concat(F.transform(present_values(REFERRER_COLUMNS), tag("ref")),
                           F.transform(present_values(CLIENT_CPA_COLUMNS), tag("cc"))))
    rows = (opp.filter(F.col("StageName") == p.won)
               .select(e.alias("__e"), "ACV_for_Quotas__c", "TCV_Gross__c", "Record_Type_Name__c")
               .select("__e.side", "__e.Account_Id", "ACV_for_Quotas__c", "TCV_Gross__c",
                       "Record_Type_Name__c"))
    return by_category(rows, ["side", "Account_Id"], "Record_Type_Name__c", "rtn",
                       {"acv": sum0("ACV_for_Quotas__c"), "tcv": sum0("TCV_Gross__c"), "cnt": n()})


def won_totals_by_side(opp: DataFrame, p: Params) -> DataFrame:
    """Won figures per (side, account): ``ref`` as a referrer, ``cc`` as a client or CPA."""
    if p.unique_opportunity_id:
        return _won_totals_by_side(opp, p)
    carry = ("ACV_for_Quotas__c", "TCV_Gross__c", "Record_Type_Name__c", "StageName")
    parts = [edges(opp, cols, carry=carry, unique_id=False).withColumn("side", F.lit(side))
             for side, cols in (("ref", REFERRER_COLUMNS), ("cc", CLIENT_CPA_COLUMNS))]
    rows = parts[0].unionByName(parts[1]).filter(F.col("StageName") == p.won)
    return by_category(rows, ["side", "Account_Id"], "Record_Type_Name__c", "rtn",
                       {"acv": sum0("ACV_for_Quotas__c"), "tcv": sum0("TCV_Gross__c"), "cnt": n()})


def ranked_side(totals: DataFrame, account: DataFrame) -> DataFrame:
    """Ranked referrers as Q09 gives them (unsorted), from the written ``won_totals_by_side``."""
    ref = totals.where("side = 'ref'").select(
        "Account_Id", F.col("acv").alias("R_total_acv"), F.col("tcv").alias("R_total_tcv"),
        F.col("cnt").alias("referral_opp_count"), F.col("rtn").alias("referral_record_type_count"))
    return lookup(ref, account_names(account), "Account_Id", write_left=False).select(
        "Name", dollar("R_total_acv").alias("R_total_acv"), dollar("R_total_tcv").alias("R_total_tcv"),
        "referral_opp_count", "referral_record_type_count")


def client_side(totals: DataFrame, account: DataFrame) -> DataFrame:
    """The client/CPA summary as Q16 gives it, from the written ``won_totals_by_side``."""
    cc = totals.where("side = 'cc'").select(
        "Account_Id", dollar("acv").alias("D_total_acv"), dollar("tcv").alias("D_total_tcv"),
        F.col("rtn").alias("record_type_count"))
    return lookup(cc, account_names(account), "Account_Id", reduce_dim=False)


Sides = tuple[DataFrame, DataFrame]


def _sides(opp: DataFrame, account: DataFrame, p: Params) -> Sides:
    """Both sides of Q17 from one scan of the opportunities, whose totals are written once."""
    totals = materialize(won_totals_by_side(opp, p))
    return ranked_side(totals, account), client_side(totals, account)


def sales_referral_full(opp: DataFrame, account: DataFrame, p: Params, sides: Sides | None = None) -> DataFrame:
    """Q17: ranked referrers ⟗ client/CPA summary on Name (NA matches NA, many-to-many).

    Each side is read by two branches (matched pairs, unmatched rows), so each
    is written once (``sides`` if they already are).
    """
    ranked, cc = sides or map(materialize, _sides(opp, account, p))
    return full_join_null_safe(ranked, cc, "Name")


def sales_referral_left(opp: DataFrame, account: DataFrame, p: Params, sides: Sides | None = None) -> DataFrame:
    """Q17b: the left-join form of Q17 (both sides from one scan)."""
    ranked, cc = sides or _sides(opp, account, p)
    return left_join_null_safe(ranked, cc, "Name")


def _cpa_pairs(opp: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    cpa, client = F.col("CPA_Contact_Account__c"), F.col("AccountId")
    return opp.select("Id", "CPA_Contact_Account__c", "AccountId", *carry) \
              .filter(present(cpa) & (client != cpa))


def cpa_client_pairs(opp: DataFrame, p: Params) -> DataFrame:
    """Q18: opportunities whose CPA contact differs from the end client."""
    return _cpa_pairs(opp)


def cpa_client_summary(opp: DataFrame, p: Params) -> DataFrame:
    """Q19: won pairs per CPA: distinct clients, opportunities, distinct record types."""
    carry = ("StageName", "Record_Type_Name__c")
    if p.unique_opportunity_id:
        pairs = _cpa_pairs(opp, carry)
    else:
        pairs = _cpa_pairs(opp).join(opp.select("Id", *carry), "Id", "left")
    return (pairs.filter(F.col("StageName") == p.won)
                 .groupBy("CPA_Contact_Account__c")
                 .agg(n_distinct("AccountId", p.approx_distinct).alias("distinct_accounts"),
                      n().alias("total_opportunities"),
                      n_distinct("Record_Type_Name__c").alias("distinct_record_types")))


def cpa_client_avg(opp: DataFrame, p: Params, summary: DataFrame | None = None) -> DataFrame:
    """Q20: means over Q19 (``summary`` if already written)."""
    return (cpa_client_summary(opp, p) if summary is None else summary).agg(
        F.avg("distinct_accounts").alias("avg_distinct_accounts"),
        F.avg("distinct_record_types").alias("avg_distinct_record_types"))


def cpa_client_summary_named(opp: DataFrame, account: DataFrame, p: Params,
                             summary: DataFrame | None = None) -> DataFrame:
    """Q21: Q19 (``summary`` if already written) with the CPA's account name."""
    names = account.select(F.col("Id").alias("Account_Id"), "Name")
    s = cpa_client_summary(opp, p) if summary is None else summary
    return lookup(s, names, "CPA_Contact_Account__c", "Account_Id", write_left=summary is None)
