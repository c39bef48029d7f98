"""DuckDB SQL for every registered query, on the same driver tables.

The SQL follows the analyses literally — each referrer column projected
and bound, de-duplicated by DISTINCT, ``lag`` over the full rows,
``row_number`` for keep-first — so it checks the Spark plans' rewrites
(exploded arrays, per-day pre-aggregation, min-struct keep-first) instead
of repeating them.  Same parameters as ``registry.FIXTURE_PARAMS``.
"""

from __future__ import annotations

from ..params import FIXTURE_PARAMS as P
from ..params import (HAS_REFERRAL, NO_REFERRAL, REFERRER_COLUMNS, TOTAL_COUNT as TOTAL_LABEL,
                      WIN_WITH_REFERRAL, WIN_WITHOUT_REFERRAL)
from ..sources.fixtures import ACCOUNT_SQL, OPP_REPORT_SQL, OPPORTUNITY_SQL

WON = P.won
LOST = P.lost
YEARS = list(P.years)
LINES = ", ".join(f"'{s}'" for s in P.service_lines)
MIN_YEAR = P.min_year
MAX_GAP = P.max_gap_days


def present(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '')"


HAS_REF = "(" + " OR ".join(present(c) for c in REFERRER_COLUMNS) + ")"


def nd(c: str) -> str:
    """n_distinct with NULL counted as a value."""
    return (f"CAST(COUNT(DISTINCT {c}) + COALESCE(MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0)"
            f" AS BIGINT)")


def sum0(c: str) -> str:
    return f"CAST(COALESCE(SUM({c}), 0) AS DECIMAL(38,2))"


def dollar(x: str) -> str:
    r = f"round_even({x}, 0)"
    return (f"(CASE WHEN {r} < 0 THEN '-' ELSE '' END || '$' || "
            f"format('{{:,}}', CAST(abs({r}) AS BIGINT)))")


def dollar_auto(x: str) -> str:
    r2 = f"round_even({x}, 2)"
    return (f"(CASE WHEN abs({x}) <= 100000 AND {x} <> floor({x}) THEN "
            f"(CASE WHEN {r2} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({r2}))) "
            f"ELSE {dollar(x)} END)")


def currency(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({x})))"


def pivot_years(val: str) -> str:
    return ", ".join(f"MAX(CASE WHEN year = {y} THEN {val} END) AS \"{y}\"" for y in YEARS)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- shared CTEs ------------------------------------------------------------------

REF_EDGES = f"""ref_edges AS (
  SELECT DISTINCT Id, Account_Id FROM (
    SELECT Id, Referring_CPA__c AS Account_Id FROM opportunity WHERE {present('Referring_CPA__c')}
    UNION ALL
    SELECT Id, Referral_2_Account__c FROM opportunity WHERE {present('Referral_2_Account__c')}
    UNION ALL
    SELECT Id, Referral_1_Account__c FROM opportunity WHERE {present('Referral_1_Account__c')}) u
)"""

MERGED = """merged AS (
  SELECT e.Id, e.Account_Id, f.ACV_for_Quotas__c, f.Record_Type_Name__c, f.StageName,
         f.shov_revenue_type__c, f.CloseDate, f.TCV_Gross__c, f.OwnerId
  FROM ref_edges e LEFT JOIN opportunity f ON f.Id = e.Id
)"""

NAMES = "names AS (SELECT Id AS Account_Id, Name, Client_Type__c FROM account)"

WIN_PCT = f"""wp AS (
  SELECT year(CloseDate) AS year,
         CASE WHEN {HAS_REF} THEN '{WIN_WITH_REFERRAL}' ELSE '{WIN_WITHOUT_REFERRAL}' END AS category,
         CAST(SUM(CASE WHEN StageName = '{WON}' THEN 1 ELSE 0 END) AS DOUBLE)
           / CAST(COUNT(*) AS DOUBLE) * 100.0 AS win_percentage
  FROM opportunity
  WHERE year(CloseDate) >= {MIN_YEAR} AND StageName IN ('{WON}', '{LOST}')
  GROUP BY 1, 2
)"""

TOTAL_COUNT = f"""tc AS (
  SELECT year(CloseDate) AS year, '{TOTAL_LABEL}' AS category, COUNT(*) AS win_percentage
  FROM opportunity
  WHERE year(CloseDate) >= {MIN_YEAR} AND StageName IN ('{WON}', '{LOST}')
  GROUP BY 1
)"""

WIN_SUMMARY = f"""ws AS (
  SELECT category, {pivot_years('v')} FROM (
    SELECT year, category,
      CASE WHEN category = '{TOTAL_LABEL}'
           THEN CAST(CAST(round_even(win_percentage, 0) AS BIGINT) AS VARCHAR)
           ELSE regexp_replace(CAST(round_even(win_percentage, 1) AS VARCHAR), '\\.0$', '') || '%'
      END AS v
    FROM (SELECT year, category, win_percentage FROM wp
          UNION ALL SELECT year, category, CAST(win_percentage AS DOUBLE) FROM tc) u) f
  GROUP BY category
)"""

REF_SUMMARY = f"""rs AS (
  SELECT Account_Id, {sum0('ACV_for_Quotas__c')} AS R_total_acv, {sum0('TCV_Gross__c')} AS R_total_tcv,
         COUNT(*) AS referral_opp_count, {nd('Record_Type_Name__c')} AS referral_record_type_count
  FROM merged WHERE StageName = '{WON}' GROUP BY Account_Id
)"""

REF_NAMED = """rsn AS (
  SELECT rs.Account_Id, rs.R_total_acv, rs.R_total_tcv, rs.referral_opp_count,
         rs.referral_record_type_count, n.Name, n.Client_Type__c
  FROM rs LEFT JOIN names n ON n.Account_Id = rs.Account_Id
)"""

RANKED = f"""ranked AS (
  SELECT Name, {dollar('R_total_acv')} AS R_total_acv, {dollar('R_total_tcv')} AS R_total_tcv,
         referral_opp_count, referral_record_type_count
  FROM rsn
)"""

WON_EDGES_SINCE = f"""e2 AS (
  SELECT Id, Account_Id, year(CloseDate) AS year, COALESCE(ACV_for_Quotas__c, 0) AS acv
  FROM merged WHERE StageName = '{WON}' AND year(CloseDate) >= {MIN_YEAR}
)"""

CC_EDGES = f"""cc_edges AS (
  SELECT DISTINCT Id, Account_Id FROM (
    SELECT Id, CPA_Contact_Account__c AS Account_Id FROM opportunity WHERE {present('CPA_Contact_Account__c')}
    UNION ALL
    SELECT Id, AccountId FROM opportunity WHERE {present('AccountId')}) u
)"""

CC_SUMMARY = f"""ccs AS (
  SELECT s.Account_Id, s.D_total_acv, s.D_total_tcv, s.record_type_count, n.Name, n.Client_Type__c
  FROM (
    SELECT e.Account_Id, {dollar(sum0('o.ACV_for_Quotas__c'))} AS D_total_acv,
           {dollar(sum0('o.TCV_Gross__c'))} AS D_total_tcv,
           {nd('o.Record_Type_Name__c')} AS record_type_count
    FROM cc_edges e LEFT JOIN opportunity o ON o.Id = e.Id
    WHERE o.StageName = '{WON}'
    GROUP BY e.Account_Id) s
  LEFT JOIN names n ON n.Account_Id = s.Account_Id
)"""

CPA_PAIRS = f"""pairs AS (
  SELECT Id, CPA_Contact_Account__c, AccountId FROM opportunity
  WHERE {present('CPA_Contact_Account__c')} AND AccountId <> CPA_Contact_Account__c
)"""

CPA_SUMMARY = f"""cps AS (
  SELECT p.CPA_Contact_Account__c, {nd('p.AccountId')} AS distinct_accounts,
         COUNT(*) AS total_opportunities, {nd('o.Record_Type_Name__c')} AS distinct_record_types
  FROM pairs p LEFT JOIN opportunity o ON o.Id = p.Id
  WHERE o.StageName = '{WON}'
  GROUP BY p.CPA_Contact_Account__c
)"""

REPORT_WON = f"""won AS (
  SELECT * FROM opp_report WHERE Stage = '{WON}' AND Record_Type_Name IN ({LINES})
)"""

G1 = """g1 AS (SELECT DISTINCT Opp_ID, Acct_Id, Record_Type_Name, Close_Date, ACV_for_Quotas FROM won)"""
G2 = f"""g2 AS (
  SELECT DISTINCT Opp_ID, CPA_Contact_Acct_ID AS Acct_Id, Record_Type_Name, Close_Date, ACV_for_Quotas
  FROM won WHERE {present('CPA_Contact_Acct_ID')}
)"""

DEDUP = """dedup AS (
  SELECT Opp_ID, Acct_Id, Record_Type_Name, Close_Date, ACV_for_Quotas FROM (
    SELECT *, row_number() OVER (PARTITION BY Opp_ID, Close_Date, Record_Type_Name
                                 ORDER BY src, Acct_Id NULLS LAST, ACV_for_Quotas NULLS LAST) AS rn
    FROM (SELECT 1 AS src, * FROM g1 UNION ALL SELECT 2 AS src, * FROM g2) u) r
  WHERE rn = 1
)"""

GAPS = f"""gaps AS (
  SELECT * FROM (
    SELECT Opp_ID, Acct_Id, Record_Type_Name, dt AS Close_Date, ACV_for_Quotas,
           CAST(dt - lag(dt) OVER (PARTITION BY Acct_Id, Record_Type_Name
                                   ORDER BY dt NULLS LAST, Opp_ID) AS DOUBLE) AS cycle_days
    FROM (SELECT *, CAST(try_strptime(Close_Date, '%m/%d/%Y') AS DATE) AS dt FROM dedup) p) l
  WHERE cycle_days IS NOT NULL AND cycle_days <= {MAX_GAP}
)"""

CYCLES = """cyc AS (
  SELECT Acct_Id, Record_Type_Name, avg(cycle_days) AS avg_cycle, median(cycle_days) AS median_cycle,
         COUNT(*) + 1 AS num_opportunities, max(Close_Date) AS most_recent_purchase
  FROM gaps GROUP BY Acct_Id, Record_Type_Name
  HAVING COUNT(*) + 1 > 1
)"""


def boxplot(src: str, g: str, v: str) -> str:
    return f"""q AS (
  SELECT {g}, COUNT(*) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS med,
         quantile_cont({v}, 0.75) AS q3
  FROM {src} WHERE {v} IS NOT NULL GROUP BY {g}
),
f AS (
  SELECT s.{g}, CAST(s.{v} AS DOUBLE) AS v, q.n, q.q1, q.med, q.q3,
         q.q1 - 1.5 * (q.q3 - q.q1) AS lf, q.q3 + 1.5 * (q.q3 - q.q1) AS uf
  FROM {src} s JOIN q ON q.{g} = s.{g} WHERE s.{v} IS NOT NULL
),
box AS (
  SELECT {g}, n, q1, med AS median, q3,
         least(q1, MIN(CASE WHEN v >= lf AND v <= uf THEN v END)) AS lower_whisker,
         greatest(q3, MAX(CASE WHEN v >= lf AND v <= uf THEN v END)) AS upper_whisker,
         CAST(COUNT(*) FILTER (WHERE NOT (v >= lf AND v <= uf)) AS BIGINT) AS n_outliers
  FROM f GROUP BY {g}, n, q1, med, q3
)"""


def acct_sales(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT Acct_Id, COUNT(*) AS num_opportunities, {nd('Record_Type_Name')} AS distinct_service_lines,
         {sum0('ACV_for_Quotas')} AS total_acv
  FROM opp_report {where} GROUP BY Acct_Id
)"""


SALES_WON = acct_sales("sw", f"WHERE Stage = '{WON}'")
SALES_ALL = acct_sales("sa", "")


def long_xy(src: str, scope: str) -> str:
    return (f"SELECT '{scope}' AS scope, Acct_Id, 'num_opportunities' AS x_var, "
            f"CAST(num_opportunities AS BIGINT) AS x, total_acv FROM {src} "
            f"UNION ALL SELECT '{scope}', Acct_Id, 'distinct_service_lines', "
            f"CAST(distinct_service_lines AS BIGINT), total_acv FROM {src}")


def corr(x: str, y: str) -> str:
    xs, ys = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return f"round(covar_pop({xs}, {ys}) / NULLIF(stddev_pop({xs}) * stddev_pop({ys}), 0), 9)"


def nan_null(e: str) -> str:
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


OPP, ACC, REP = OPPORTUNITY_SQL, ACCOUNT_SQL, OPP_REPORT_SQL

ORACLE_SQL: dict[str, str] = {
    "q01_referral_edges": with_(OPP, REF_EDGES) + "SELECT Id, Account_Id FROM ref_edges",
    "q02_referral_merged": with_(OPP, REF_EDGES, MERGED) + "SELECT * FROM merged",
    "q03_opp_referral_flag": with_(OPP) + f"""SELECT Id, ACV_for_Quotas__c, Record_Type_Name__c, StageName,
  shov_revenue_type__c, CloseDate, TCV_Gross__c, CPA_Contact_Account__c, Referring_CPA__c,
  Referral_1_Account__c, Referral_2_Account__c,
  CASE WHEN {HAS_REF} THEN '{HAS_REFERRAL}' ELSE '{NO_REFERRAL}' END AS category
FROM opportunity""",
    "q04_win_pct_by_year": with_(OPP, WIN_PCT) + "SELECT year, category, win_percentage FROM wp",
    "q05_opp_count_by_year": with_(OPP, TOTAL_COUNT) + "SELECT year, category, win_percentage FROM tc",
    "q06_win_pct_summary": with_(OPP, WIN_PCT, TOTAL_COUNT, WIN_SUMMARY) + "SELECT * FROM ws",
    "q07_referral_summary": with_(OPP, REF_EDGES, MERGED, REF_SUMMARY) + "SELECT * FROM rs",
    "q08_referral_summary_named": with_(OPP, ACC, NAMES, REF_EDGES, MERGED, REF_SUMMARY, REF_NAMED)
    + "SELECT * FROM rsn",
    "q09_referral_ranked": with_(OPP, ACC, NAMES, REF_EDGES, MERGED, REF_SUMMARY, REF_NAMED, RANKED)
    + "SELECT * FROM ranked",
    "q10_referral_yearly_unique": with_(OPP, REF_EDGES, MERGED, WON_EDGES_SINCE, f"""t AS (
  SELECT c.year, {dollar('a.referral_acv')} AS referral_acv,
         CAST(c.opportunity_count AS VARCHAR) AS opportunity_count,
         CAST(c.distinct_referral_accounts AS VARCHAR) AS distinct_referral_accounts
  FROM (SELECT year, COUNT(DISTINCT Id) AS opportunity_count,
               COUNT(DISTINCT Account_Id) AS distinct_referral_accounts
        FROM e2 GROUP BY year) c
  JOIN (SELECT year, SUM(acv) AS referral_acv FROM (SELECT DISTINCT year, Id, acv FROM e2) d
        GROUP BY year) a ON a.year = c.year
)""", """l AS (
  SELECT year, 'referral_acv' AS metric, referral_acv AS value FROM t
  UNION ALL SELECT year, 'opportunity_count', opportunity_count FROM t
  UNION ALL SELECT year, 'distinct_referral_accounts', distinct_referral_accounts FROM t
)""") + f"SELECT metric, {pivot_years('value')} FROM l GROUP BY metric",
    "q10b_referrers_by_year_and_total": with_(OPP, REF_EDGES, MERGED, WON_EDGES_SINCE)
    + """SELECT year, COUNT(DISTINCT Account_Id) AS distinct_referral_accounts FROM e2 GROUP BY year
  UNION ALL SELECT NULL, COUNT(DISTINCT Account_Id) FROM e2""",
    "q11_referral_yearly_credit": with_(OPP, REF_EDGES, MERGED, WON_EDGES_SINCE, f"""t AS (
  SELECT year, {dollar_auto('SUM(acv)')} AS referral_acv, CAST(COUNT(*) AS VARCHAR) AS opportunity_count
  FROM e2 GROUP BY year
)""", """l AS (
  SELECT year, 'referral_acv' AS metric, referral_acv AS value FROM t
  UNION ALL SELECT year, 'opportunity_count', opportunity_count FROM t
)""") + f"SELECT metric, {pivot_years('value')} FROM l GROUP BY metric",
    "q12_referral_account_acv": with_(OPP, REF_EDGES, MERGED) + f"""SELECT Account_Id,
  {sum0('ACV_for_Quotas__c')} AS total_acv, COUNT(*) AS opportunity_count
FROM merged WHERE StageName = '{WON}' GROUP BY Account_Id""",
    "q13_referral_share_by_year": with_(OPP, f"""y AS (
  SELECT year(CloseDate) AS year, {sum0('ACV_for_Quotas__c')} AS total_sales,
         {sum0(f'CASE WHEN {HAS_REF} THEN ACV_for_Quotas__c END')} AS referral_sales
  FROM opportunity WHERE StageName = '{WON}' AND year(CloseDate) >= {MIN_YEAR} GROUP BY 1
)""") + """SELECT year, total_sales, referral_sales,
  CAST(referral_sales AS DOUBLE) / NULLIF(CAST(total_sales AS DOUBLE), 0) * 100.0 AS referral_percentage
FROM y""",
    "q14_referral_share_dual_axis": with_(OPP, f"""y AS (
  SELECT year(CloseDate) AS year, {sum0('ACV_for_Quotas__c')} AS total_sales,
         {sum0(f'CASE WHEN {HAS_REF} THEN ACV_for_Quotas__c END')} AS referral_sales
  FROM opportunity WHERE StageName = '{WON}' AND year(CloseDate) >= {MIN_YEAR} GROUP BY 1
)""", """z AS (
  SELECT year, total_sales, referral_sales,
    CAST(referral_sales AS DOUBLE) / NULLIF(CAST(total_sales AS DOUBLE), 0) * 100.0 AS referral_percentage,
    MAX(total_sales) OVER () AS max_total_sales
  FROM y
)""") + """SELECT year, total_sales, referral_sales, referral_percentage, max_total_sales,
  referral_percentage * CAST(max_total_sales AS DOUBLE) / 100.0 AS referral_line
FROM z""",
    "q15_client_cpa_edges": with_(OPP, CC_EDGES) + "SELECT Id, Account_Id FROM cc_edges",
    "q16_client_cpa_summary": with_(OPP, ACC, NAMES, CC_EDGES, CC_SUMMARY) + "SELECT * FROM ccs",
    "q17_sales_referral_full": with_(OPP, ACC, NAMES, REF_EDGES, MERGED, REF_SUMMARY, REF_NAMED, RANKED,
                                     CC_EDGES, CC_SUMMARY) + """SELECT COALESCE(a.Name, b.Name) AS Name,
  a.R_total_acv, a.R_total_tcv, a.referral_opp_count, a.referral_record_type_count,
  b.Account_Id, b.D_total_acv, b.D_total_tcv, b.record_type_count, b.Client_Type__c
FROM ranked a FULL OUTER JOIN ccs b ON a.Name IS NOT DISTINCT FROM b.Name""",
    "q17b_sales_referral_left": with_(OPP, ACC, NAMES, REF_EDGES, MERGED, REF_SUMMARY, REF_NAMED, RANKED,
                                      CC_EDGES, CC_SUMMARY) + """SELECT a.Name,
  a.R_total_acv, a.R_total_tcv, a.referral_opp_count, a.referral_record_type_count,
  b.Account_Id, b.D_total_acv, b.D_total_tcv, b.record_type_count, b.Client_Type__c
FROM ranked a LEFT JOIN ccs b ON a.Name IS NOT DISTINCT FROM b.Name""",
    "q18_cpa_client_pairs": with_(OPP, CPA_PAIRS) + "SELECT * FROM pairs",
    "q19_cpa_client_summary": with_(OPP, CPA_PAIRS, CPA_SUMMARY) + "SELECT * FROM cps",
    "q20_cpa_client_avg": with_(OPP, CPA_PAIRS, CPA_SUMMARY) + """SELECT
  avg(distinct_accounts) AS avg_distinct_accounts, avg(distinct_record_types) AS avg_distinct_record_types
FROM cps""",
    "q21_cpa_client_summary_named": with_(OPP, ACC, CPA_PAIRS, CPA_SUMMARY) + """SELECT
  c.CPA_Contact_Account__c, c.distinct_accounts, c.total_opportunities, c.distinct_record_types, a.Name
FROM cps c LEFT JOIN account a ON a.Id = c.CPA_Contact_Account__c""",
    "q22_report_won": with_(REP, REPORT_WON) + "SELECT * FROM won",
    "q23_report_client_rows": with_(REP, REPORT_WON, G1) + "SELECT * FROM g1",
    "q24_report_cpa_rows": with_(REP, REPORT_WON, G2) + "SELECT * FROM g2",
    "q25_report_dedup": with_(REP, REPORT_WON, G1, G2, DEDUP) + "SELECT * FROM dedup",
    "q25b_report_dedup_by_party": with_(REP, REPORT_WON, G1, G2) + """SELECT Opp_ID, Acct_Id,
  Record_Type_Name, Close_Date, ACV_for_Quotas FROM (
  SELECT *, row_number() OVER (PARTITION BY Opp_ID, Acct_Id, Close_Date, Record_Type_Name
                               ORDER BY src, ACV_for_Quotas NULLS LAST) AS rn
  FROM (SELECT 1 AS src, * FROM g1 UNION ALL SELECT 2 AS src, * FROM g2) u) r
WHERE rn = 1""",
    "q26_service_line_counts": with_(REP, REPORT_WON, G1, G2, DEDUP) + f"""SELECT Record_Type_Name,
  {nd('Acct_Id')} AS distinct_accts, COUNT(*) AS num_opps FROM dedup GROUP BY Record_Type_Name""",
    "q26b_accounts_by_line_and_total": with_(REP, REPORT_WON, G1, G2, DEDUP) + f"""SELECT Record_Type_Name,
  {nd('Acct_Id')} AS distinct_accts, false AS total FROM dedup GROUP BY Record_Type_Name
  UNION ALL SELECT NULL, {nd('Acct_Id')}, true FROM dedup""",
    "q27_purchase_gaps": with_(REP, REPORT_WON, G1, G2, DEDUP, GAPS) + "SELECT * FROM gaps",
    "q28_purchase_cycles": with_(REP, REPORT_WON, G1, G2, DEDUP, GAPS, CYCLES) + """SELECT Acct_Id,
  Record_Type_Name, round(avg_cycle, 6) AS avg_cycle, round(median_cycle, 6) AS median_cycle,
  num_opportunities, most_recent_purchase FROM cyc""",
    "q29_cycle_boxplot": with_(REP, REPORT_WON, G1, G2, DEDUP, GAPS, CYCLES,
                               boxplot("cyc", "Record_Type_Name", "avg_cycle")) + """SELECT Record_Type_Name,
  n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(lower_whisker, 6) AS lower_whisker, round(upper_whisker, 6) AS upper_whisker, n_outliers
FROM box""",
    "q29b_cycle_boxplot_outliers": with_(REP, REPORT_WON, G1, G2, DEDUP, GAPS, CYCLES,
                                         boxplot("cyc", "Record_Type_Name", "avg_cycle")) + """SELECT
  c.Record_Type_Name, c.Acct_Id, round(c.avg_cycle, 6) AS avg_cycle
FROM cyc c JOIN q ON q.Record_Type_Name = c.Record_Type_Name
WHERE c.avg_cycle < q.q1 - 1.5 * (q.q3 - q.q1) OR c.avg_cycle > q.q3 + 1.5 * (q.q3 - q.q1)""",
    "q30_cycle_density": with_(REP, REPORT_WON, G1, G2, DEDUP, GAPS, CYCLES, """st AS (
  SELECT Record_Type_Name, COUNT(*) AS n, stddev_samp(avg_cycle) AS sd,
         quantile_cont(avg_cycle, 0.25) AS q1, quantile_cont(avg_cycle, 0.75) AS q3,
         MIN(avg_cycle) AS xf, MAX(avg_cycle) AS xt
  FROM cyc GROUP BY Record_Type_Name HAVING COUNT(*) >= 2
)""", """st2 AS (
  SELECT Record_Type_Name, n, xf, (xt - xf) / 511.0 AS delta,
    0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                WHEN sd > 0 THEN sd WHEN abs(xf) > 0 THEN abs(xf) ELSE 1.0 END)
        * pow(CAST(n AS DOUBLE), -0.2) AS bw
  FROM st
)""", """b AS (
  SELECT c.Record_Type_Name, s.n, s.xf, s.delta, s.bw,
         CASE WHEN s.delta > 0 THEN (c.avg_cycle - s.xf) / s.delta ELSE 0.0 END AS t
  FROM cyc c JOIN st2 s ON s.Record_Type_Name = c.Record_Type_Name
)""", """b2 AS (
  SELECT Record_Type_Name, n, xf, delta, bw, CAST(least(floor(t), 511) AS BIGINT) AS lo, t - floor(t) AS f
  FROM b
)""", """bins AS (
  SELECT Record_Type_Name, n, xf, delta, bw, bin, SUM(w) AS w FROM (
    SELECT Record_Type_Name, n, xf, delta, bw, lo AS bin, 1.0 - f AS w FROM b2
    UNION ALL
    SELECT Record_Type_Name, n, xf, delta, bw, least(lo + 1, 511) AS bin, f AS w FROM b2) p
  WHERE w > 0
  GROUP BY Record_Type_Name, n, xf, delta, bw, bin
)""", """terms AS (
  SELECT Record_Type_Name, n, xf, delta, bw, j, w * exp(-0.5 * z * z) / (sqrt(2 * pi()) * bw * n) AS k
  FROM (SELECT Record_Type_Name, n, xf, delta, bw, g.j, w,
               ((xf + g.j * delta) - (xf + bin * delta)) / bw AS z
        FROM bins, (SELECT range AS j FROM range(0, 512)) g) zz
)""") + """SELECT Record_Type_Name, j AS grid_index, round(xf + j * delta, 6) AS x,
  round(SUM(k), 12) AS density, round(bw, 9) AS bw, n
FROM terms GROUP BY Record_Type_Name, j, n, xf, delta, bw""",
    "q31_acct_volume_lines": with_(REP) + f"""SELECT Acct_Id, COUNT(*) AS num_opportunities,
  {nd('Record_Type_Name')} AS distinct_service_lines
FROM opp_report WHERE Stage = '{WON}' GROUP BY Acct_Id""",
    "q32_volume_lines_scatter": with_(REP, f"""a AS (
  SELECT Acct_Id, COUNT(*) AS num_opportunities, {nd('Record_Type_Name')} AS distinct_service_lines
  FROM opp_report WHERE Stage = '{WON}' GROUP BY Acct_Id
)""") + """SELECT num_opportunities, distinct_service_lines, COUNT(*) AS n_accounts
FROM a GROUP BY num_opportunities, distinct_service_lines""",
    "q33_lines_by_volume_boxplot": with_(REP, f"""a AS (
  SELECT Acct_Id, COUNT(*) AS num_opportunities, {nd('Record_Type_Name')} AS distinct_service_lines
  FROM opp_report WHERE Stage = '{WON}' GROUP BY Acct_Id
)""", boxplot("a", "num_opportunities", "distinct_service_lines")) + """SELECT num_opportunities, n,
  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  lower_whisker, upper_whisker, n_outliers
FROM box""",
    "q34a_acct_sales_won": with_(REP, SALES_WON) + "SELECT * FROM sw",
    "q34b_acct_sales_all": with_(REP, SALES_ALL) + "SELECT * FROM sa",
    "q35_sales_correlation": with_(REP, SALES_WON, SALES_ALL) + f"""
SELECT 'won' AS scope, 'num_opportunities' AS x_var, {corr('num_opportunities', 'total_acv')} AS correlation FROM sw
UNION ALL SELECT 'won', 'distinct_service_lines', {corr('distinct_service_lines', 'total_acv')} FROM sw
UNION ALL SELECT 'all', 'num_opportunities', {corr('num_opportunities', 'total_acv')} FROM sa
UNION ALL SELECT 'all', 'distinct_service_lines', {corr('distinct_service_lines', 'total_acv')} FROM sa""",
    "q36_sales_scatter": with_(REP, SALES_WON) + long_xy("sw", "won"),
    "q37_sales_fit": with_(REP, SALES_WON, SALES_ALL,
                           f"lng AS ({long_xy('sw', 'won')} UNION ALL {long_xy('sa', 'all')})", f"""fit AS (
  SELECT scope, x_var, COUNT(*) AS n,
    {nan_null('regr_slope(CAST(total_acv AS DOUBLE), CAST(x AS DOUBLE))')} AS slope,
    {nan_null('regr_intercept(CAST(total_acv AS DOUBLE), CAST(x AS DOUBLE))')} AS intercept,
    {nan_null('regr_r2(CAST(total_acv AS DOUBLE), CAST(x AS DOUBLE))')} AS r2,
    CAST(MIN(x) AS DOUBLE) AS x_min, CAST(MAX(x) AS DOUBLE) AS x_max
  FROM lng GROUP BY scope, x_var
)""") + """SELECT scope, x_var, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept,
  round(r2, 9) AS r2, x_min, x_max,
  round(intercept + slope * x_min, 4) AS y_at_x_min, round(intercept + slope * x_max, 4) AS y_at_x_max
FROM fit""",
    "q37b_sales_fit_line": with_(REP, SALES_WON, SALES_ALL,
                                 f"lng AS ({long_xy('sw', 'won')} UNION ALL {long_xy('sa', 'all')})", f"""fit AS (
  SELECT scope, x_var,
    {nan_null('regr_slope(CAST(total_acv AS DOUBLE), CAST(x AS DOUBLE))')} AS slope,
    {nan_null('regr_intercept(CAST(total_acv AS DOUBLE), CAST(x AS DOUBLE))')} AS intercept,
    CAST(MIN(x) AS DOUBLE) AS x_min, CAST(MAX(x) AS DOUBLE) AS x_max
  FROM lng GROUP BY scope, x_var
)""") + """SELECT scope, x_var, g.point, round(x_min + g.point * ((x_max - x_min) / 79.0), 6) AS x,
  round(intercept + slope * (x_min + g.point * ((x_max - x_min) / 79.0)), 4) AS fitted
FROM fit, (SELECT range AS point FROM range(0, 80)) g
WHERE slope IS NOT NULL""",
    "q38_acv_by_service_lines": with_(REP, SALES_WON, """r AS (
  SELECT distinct_service_lines, CAST(total_acv AS DOUBLE) AS v,
         row_number() OVER (PARTITION BY distinct_service_lines ORDER BY CAST(total_acv AS DOUBLE)) AS rn,
         COUNT(*) OVER (PARTITION BY distinct_service_lines) AS cnt
  FROM sw
)""", """m AS (
  SELECT distinct_service_lines,
         (MIN(CASE WHEN rn = (cnt + 1) // 2 THEN v END) + MIN(CASE WHEN rn = cnt // 2 + 1 THEN v END)) / 2.0
           AS median_acv
  FROM r GROUP BY distinct_service_lines
)""", """s AS (
  SELECT sw.distinct_service_lines, CAST(SUM(total_acv) AS DECIMAL(38,2)) AS sum_acv,
         CAST(SUM(total_acv) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_acv,
         COUNT(*) AS num_accounts
  FROM sw GROUP BY sw.distinct_service_lines
)"""),
    "q39_acv_by_service_lines_fmt": None,  # filled below
    "q40_win_pct_display": with_(OPP, WIN_PCT, TOTAL_COUNT, WIN_SUMMARY)
    + "SELECT category AS Metric, "
    + ", ".join(f"COALESCE(\"{y}\", '-') AS \"{y}\"" for y in YEARS) + " FROM ws",
}

_Q38_BASE = ORACLE_SQL["q38_acv_by_service_lines"]
ORACLE_SQL["q38_acv_by_service_lines"] = _Q38_BASE + """SELECT s.distinct_service_lines, s.sum_acv,
  round(s.avg_acv, 6) AS avg_acv, round(m.median_acv, 6) AS median_acv, s.num_accounts
FROM s JOIN m ON m.distinct_service_lines = s.distinct_service_lines"""
ORACLE_SQL["q39_acv_by_service_lines_fmt"] = _Q38_BASE + f"""SELECT
  s.distinct_service_lines AS "Distinct Service Lines",
  {currency('s.sum_acv')} AS "Total ACV (USD)",
  {currency('s.avg_acv')} AS "Average ACV (USD)",
  {currency('m.median_acv')} AS "Median ACV (USD)",
  s.num_accounts AS "# of Accounts"
FROM s JOIN m ON m.distinct_service_lines = s.distinct_service_lines"""

# The same rows by another path: without explicit pivot years, through a CSV file, over all stages.
ORACLE_SQL |= {
    "q10p_referral_yearly_unique_by_year": ORACLE_SQL["q10_referral_yearly_unique"],
    "q11p_referral_yearly_credit_by_year": ORACLE_SQL["q11_referral_yearly_credit"],
    "q13p_referral_share_by_year": ORACLE_SQL["q13_referral_share_by_year"],
    "q06d_win_pct_summary_any_year": ORACLE_SQL["q06_win_pct_summary"],
    "q10d_referral_yearly_unique_any_year": ORACLE_SQL["q10_referral_yearly_unique"],
    "q11d_referral_yearly_credit_any_year": ORACLE_SQL["q11_referral_yearly_credit"],
    "q22c_report_won_csv": ORACLE_SQL["q22_report_won"],
    "q25c_report_dedup_sorted": with_(REP, REPORT_WON, G1, G2, DEDUP) + """SELECT *,
  CAST(try_strptime(Close_Date, '%m/%d/%Y') AS DATE) AS parsed_date FROM dedup""",
    "q36b_sales_scatter_all": with_(REP, SALES_ALL) + long_xy("sa", "all"),
}
