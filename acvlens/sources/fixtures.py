"""The three inputs derived from the driver's TPC-H-style tables.

The rules (FIXTURES.md) use integer arithmetic, CASE and casts only, so
Spark and DuckDB produce the same rows.  Each derivation exists twice:
as a DataFrame plan (what the library runs) and as SQL text (what the
DuckDB oracle runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import LOST, WON
from .schemas import MONEY

# The fixture's third stage (neither won nor lost).
PROPOSAL = "3 - Proposal"


# Declared read schemas (the driver-table columns the derivations use): no
# inference job per read, and the scan reads only these columns.
SOURCE_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, "
                "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_type STRING",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def opportunity(spark: SparkSession, sf_dir: str, with_tcv: bool = True) -> DataFrame:
    """One row per ``orders`` row, CRM opportunity columns.

    ``TCV_Gross__c`` is a per-order total over ``lineitem``; it is pre-aggregated
    on the order key (partial aggregation map-side) before the join, so
    the join sees at most one row per order.  The columns are SQL expressions
    (one call each to the JVM; analysed and code-generated there).
    """
    o = _read(spark, sf_dir, "orders")
    if with_tcv:
        tcv = (_read(spark, sf_dir, "lineitem")
               .groupBy("l_orderkey")
               .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("TCV_Gross__c")))
        o = o.join(tcv, o.o_orderkey == tcv.l_orderkey, "left")
        tcv_expr = "TCV_Gross__c"
    else:
        tcv_expr = "CAST(NULL AS DECIMAL(18,2)) AS TCV_Gross__c"
    return o.selectExpr(
        "CAST(o_orderkey AS STRING) AS Id",
        "CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 50 = 1 THEN '' "
        "ELSE CAST(o_custkey AS STRING) END AS AccountId",
        f"CASE o_orderstatus WHEN 'F' THEN '{WON}' WHEN 'O' THEN '{LOST}' WHEN 'P' THEN '{PROPOSAL}' "
        "END AS StageName",
        "CASE WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS CloseDate",
        "CASE WHEN o_orderkey % 20 = 7 THEN CAST(NULL AS DECIMAL(18,2)) "
        "ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS ACV_for_Quotas__c",
        tcv_expr,
        "CASE WHEN o_orderkey % 40 = 3 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS Record_Type_Name__c",
        "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 60 AS STRING) WHEN o_orderkey % 6 = 1 THEN '' "
        "END AS Referring_CPA__c",
        "CASE WHEN o_orderkey % 8 = 0 THEN CAST((o_custkey * 3) % 60 AS STRING) WHEN o_orderkey % 8 = 1 THEN '' "
        "END AS Referral_1_Account__c",
        "CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_custkey % 11 = 0 THEN 'X' || CAST(o_custkey % 7 AS STRING) "
        "ELSE CAST((o_custkey * 7) % 60 AS STRING) END WHEN o_orderkey % 10 = 1 THEN '' END AS Referral_2_Account__c",
        "CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_custkey % 13 = 0 THEN 'X' || CAST(o_custkey % 5 AS STRING) "
        "ELSE CAST(o_custkey % 80 AS STRING) END WHEN o_orderkey % 4 = 1 THEN '' END AS CPA_Contact_Account__c",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Recurring' ELSE 'New' END AS shov_revenue_type__c",
        "CAST(o_orderkey % 100 AS STRING) AS OwnerId",
    )


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ``customer`` row."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS Id",
        "'Firm ' || CAST(c_custkey % 1000 AS STRING) AS Name",
        "c_mktsegment AS Client_Type__c",
    )


def opp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat opportunity export: one row per ``lineitem`` row.

    ``part`` and ``orders`` are joined on their keys; AQE picks broadcast or
    sort-merge at run time from the measured sizes.
    """
    li = _read(spark, sf_dir, "lineitem")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = _read(spark, sf_dir, "part")
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(p, li.l_partkey == p.p_partkey, "inner"))
    return j.selectExpr(
        "CAST(l_orderkey AS STRING) AS Opp_ID",
        "CASE WHEN l_orderkey % 101 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS Acct_Id",
        "CASE WHEN l_orderkey % 4 = 0 THEN CAST(o_custkey % 80 AS STRING) ELSE '' END AS CPA_Contact_Acct_ID",
        "p_type AS Record_Type_Name",
        "CASE WHEN l_orderkey % 89 = 0 THEN '' "
        "ELSE date_format(CAST(l_shipdate AS DATE), 'M/d/yyyy') END AS Close_Date",
        "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DECIMAL(18,2)) "
        "ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS ACV_for_Quotas",
        f"CASE l_returnflag WHEN 'A' THEN '{WON}' WHEN 'R' THEN '{LOST}' WHEN 'N' THEN '{PROPOSAL}' END AS Stage",
    )


# --- the same derivations as DuckDB SQL (common table expressions) ------------

OPPORTUNITY_SQL = f"""opportunity AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS Id,
    CASE WHEN o.o_orderkey % 50 = 0 THEN NULL WHEN o.o_orderkey % 50 = 1 THEN ''
         ELSE CAST(o.o_custkey AS VARCHAR) END AS AccountId,
    CASE o.o_orderstatus WHEN 'F' THEN '{WON}' WHEN 'O' THEN '{LOST}'
         WHEN 'P' THEN '3 - Proposal' END AS StageName,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS CloseDate,
    CASE WHEN o.o_orderkey % 20 = 7 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END
         AS ACV_for_Quotas__c,
    CAST(t.tcv AS DECIMAL(18,2)) AS TCV_Gross__c,
    CASE WHEN o.o_orderkey % 40 = 3 THEN NULL ELSE o.o_orderpriority END AS Record_Type_Name__c,
    CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(o.o_custkey % 60 AS VARCHAR)
         WHEN o.o_orderkey % 6 = 1 THEN '' END AS Referring_CPA__c,
    CASE WHEN o.o_orderkey % 8 = 0 THEN CAST((o.o_custkey * 3) % 60 AS VARCHAR)
         WHEN o.o_orderkey % 8 = 1 THEN '' END AS Referral_1_Account__c,
    CASE WHEN o.o_orderkey % 10 = 0 THEN
           CASE WHEN o.o_custkey % 11 = 0 THEN 'X' || CAST(o.o_custkey % 7 AS VARCHAR)
                ELSE CAST((o.o_custkey * 7) % 60 AS VARCHAR) END
         WHEN o.o_orderkey % 10 = 1 THEN '' END AS Referral_2_Account__c,
    CASE WHEN o.o_orderkey % 4 = 0 THEN
           CASE WHEN o.o_custkey % 13 = 0 THEN 'X' || CAST(o.o_custkey % 5 AS VARCHAR)
                ELSE CAST(o.o_custkey % 80 AS VARCHAR) END
         WHEN o.o_orderkey % 4 = 1 THEN '' END AS CPA_Contact_Account__c,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'Recurring' ELSE 'New' END AS shov_revenue_type__c,
    CAST(o.o_orderkey % 100 AS VARCHAR) AS OwnerId
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS tcv
             FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey
)"""

ACCOUNT_SQL = """account AS (
  SELECT CAST(c_custkey AS VARCHAR) AS Id,
    'Firm ' || CAST(c_custkey % 1000 AS VARCHAR) AS Name,
    c_mktsegment AS Client_Type__c
  FROM customer
)"""

OPP_REPORT_SQL = f"""opp_report AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS Opp_ID,
    CASE WHEN l.l_orderkey % 101 = 0 THEN '' ELSE CAST(o.o_custkey AS VARCHAR) END AS Acct_Id,
    CASE WHEN l.l_orderkey % 4 = 0 THEN CAST(o.o_custkey % 80 AS VARCHAR) ELSE '' END
         AS CPA_Contact_Acct_ID,
    p.p_type AS Record_Type_Name,
    CASE WHEN l.l_orderkey % 89 = 0 THEN ''
         ELSE strftime(CAST(l.l_shipdate AS DATE), '%-m/%-d/%Y') END AS Close_Date,
    CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END
         AS ACV_for_Quotas,
    CASE l.l_returnflag WHEN 'A' THEN '{WON}' WHEN 'R' THEN '{LOST}'
         WHEN 'N' THEN '3 - Proposal' END AS Stage
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
)"""


class FixtureTables:
    """Lazily derived inputs for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def opportunity(self, with_tcv: bool = True) -> DataFrame:
        return opportunity(self.spark, self.sf_dir, with_tcv=with_tcv)

    def account(self) -> DataFrame:
        return account(self.spark, self.sf_dir)

    def opp_report(self) -> DataFrame:
        return opp_report(self.spark, self.sf_dir)
