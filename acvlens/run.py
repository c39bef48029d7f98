"""Run the analyses on landed tables and write every result.

    python -m acvlens.run --opportunity PATH --account PATH --report PATH --out DIR

``--opportunity`` / ``--account`` are Parquet paths or catalog tables (the
landed CRM objects); ``--report`` is the flat export (CSV folder or file, or
with ``--report-format parquet`` a table landed by ``acvlens.streaming.landing``).  Each analysis is
written to ``DIR/<name>`` (Parquet by default, or CSV with a header and
``NA`` for missing).  Any of the three inputs may be omitted; the analyses
that need it are skipped.  Intermediates that several analyses share are
written once to ``DIR/_shared``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .params import Params
from .plans import clients, cycles, penetration, referral
from .session import get_session
from .sources import tables

OPP = "opportunity"
ACC = "account"
REP = "report"

# Intermediates that several analyses read: each is derived once per run and
# written to ``DIR/_shared``.  name -> (inputs needed, function of (tables, params))
Builder = Callable[[dict, Params], DataFrame]
SHARED: dict[str, tuple[tuple[str, ...], Builder]] = {
    "referrers": ((OPP,), lambda t, p: referral.referral_summary(t[OPP], p)),
    "totals": ((OPP,), lambda t, p: clients.won_totals_by_side(t[OPP], p)),
    "ranked_side": ((ACC, "totals"), lambda t, p: clients.ranked_side(t["totals"], t[ACC])),
    "client_side": ((ACC, "totals"), lambda t, p: clients.client_side(t["totals"], t[ACC])),
    "cpas": ((OPP,), lambda t, p: clients.cpa_client_summary(t[OPP], p)),
    "win_rates": ((OPP,), lambda t, p: referral.win_pct_summary(t[OPP], p)),
    "dedup": ((REP,), lambda t, p: cycles.report_dedup(t[REP], p)),
    "dates": ((REP, "dedup"), lambda t, p: cycles.dated(t["dedup"])),
    "cycles": ((REP, "dates"), lambda t, p: cycles.purchase_cycles(t[REP], p, dates=t["dates"])),
    "accounts": ((REP,), lambda t, p: penetration.acct_sales_both(t[REP], p)),
}

ANALYSES: dict[str, tuple[tuple[str, ...], Builder]] = {
    "referral_edges": ((OPP,), lambda t, p: referral.referral_edges(t[OPP], p)),
    "referral_merged": ((OPP,), lambda t, p: referral.referral_merged(t[OPP], p)),
    "opp_referral_flag": ((OPP,), lambda t, p: referral.opp_referral_flag(t[OPP], p)),
    "win_pct_by_year": ((OPP,), lambda t, p: referral.win_pct_by_year(t[OPP], p)),
    "opp_count_by_year": ((OPP,), lambda t, p: referral.opp_count_by_year(t[OPP], p)),
    "win_pct_summary": (("win_rates",), lambda t, p: t["win_rates"]),
    "win_pct_display": ((OPP, "win_rates"), lambda t, p: referral.win_pct_display(t[OPP], p, t["win_rates"])),
    "referral_summary": (("referrers",), lambda t, p: t["referrers"]),
    "referral_summary_named": ((OPP, ACC, "referrers"), lambda t, p: referral.referral_summary_named(
        t[OPP], t[ACC], p, t["referrers"])),
    "ranked_accounts_by_acv": ((OPP, ACC, "referrers"), lambda t, p: referral.referral_ranked(
        t[OPP], t[ACC], p, summary=t["referrers"])),
    "referral_yearly_unique": ((OPP,), lambda t, p: referral.referral_yearly_unique(t[OPP], p)),
    "referral_yearly_credit": ((OPP,), lambda t, p: referral.referral_yearly_credit(t[OPP], p)),
    "referral_account_acv": ((OPP, "referrers"), lambda t, p: referral.referral_account_acv(t[OPP], p, t["referrers"])),
    "referral_share_by_year": ((OPP,), lambda t, p: referral.referral_share_by_year(t[OPP], p)),
    "referral_share_dual_axis": ((OPP,), lambda t, p: referral.referral_share_dual_axis(t[OPP], p)),
    "client_cpa_edges": ((OPP,), lambda t, p: clients.client_cpa_edges(t[OPP], p)),
    "client_cpa_summary": (("client_side",), lambda t, p: t["client_side"]),
    "endclient_referral_summary": ((OPP, ACC, "ranked_side", "client_side"), lambda t, p: clients.sales_referral_full(
        t[OPP], t[ACC], p, (t["ranked_side"], t["client_side"]))),
    "ranked_accounts_with_client_summary": ((OPP, ACC, "ranked_side", "client_side"),
                                            lambda t, p: clients.sales_referral_left(
                                                t[OPP], t[ACC], p, (t["ranked_side"], t["client_side"]))),
    "cpa_client_pairs": ((OPP,), lambda t, p: clients.cpa_client_pairs(t[OPP], p)),
    "cpa_client_summary": (("cpas",), lambda t, p: t["cpas"]),
    "cpa_client_avg": ((OPP, "cpas"), lambda t, p: clients.cpa_client_avg(t[OPP], p, t["cpas"])),
    "cpa_client_summary_named": ((OPP, ACC, "cpas"), lambda t, p: clients.cpa_client_summary_named(
        t[OPP], t[ACC], p, t["cpas"])),
    "report_won": ((REP,), lambda t, p: cycles.report_won(t[REP], p)),
    "report_client_rows": ((REP,), lambda t, p: cycles.report_client_rows(t[REP], p)),
    "report_cpa_rows": ((REP,), lambda t, p: cycles.report_cpa_rows(t[REP], p)),
    "report_dedup": ((REP, "dedup"), lambda t, p: cycles.report_dedup_sorted(t[REP], p, t["dedup"]).drop("parsed_date")),
    "report_dedup_by_party": ((REP,), lambda t, p: cycles.report_dedup_by_party(t[REP], p)),
    "service_line_counts": ((REP, "dedup"), lambda t, p: cycles.service_line_counts(t[REP], p, t["dedup"])),
    "purchase_gaps": ((REP, "dates"), lambda t, p: cycles.purchase_gaps(t[REP], p, dates=t["dates"])),
    "purchase_cycles": (("cycles",), lambda t, p: t["cycles"]),
    "cycle_boxplot": ((REP, "cycles"), lambda t, p: cycles.cycle_boxplot(t[REP], p, t["cycles"])),
    "cycle_boxplot_outliers": ((REP, "cycles"), lambda t, p: cycles.cycle_boxplot_outliers(t[REP], p, t["cycles"])),
    "cycle_density": ((REP, "cycles"), lambda t, p: cycles.cycle_density(t[REP], p, cycles=t["cycles"])),
    **{name: ((REP, "accounts"), fn) for name, fn in {
        "acct_volume_lines": lambda t, p: penetration.acct_volume_lines(t[REP], p, t["accounts"]),
        "volume_lines_scatter": lambda t, p: penetration.volume_lines_scatter(t[REP], p, t["accounts"]),
        "lines_by_volume_boxplot": lambda t, p: penetration.lines_by_volume_boxplot(t[REP], p, t["accounts"]),
        "acct_sales_won": lambda t, p: penetration.acct_sales(t[REP], p, "won", t["accounts"]),
        "acct_sales_all": lambda t, p: penetration.acct_sales(t[REP], p, "all", t["accounts"]),
        "sales_correlation": lambda t, p: penetration.sales_correlation(t[REP], p, accounts=t["accounts"]),
        "sales_scatter": lambda t, p: penetration.sales_scatter(t[REP], p, "won", t["accounts"]),
        "sales_scatter_all": lambda t, p: penetration.sales_scatter(t[REP], p, "all", t["accounts"]),
        "sales_fit": lambda t, p: penetration.sales_fit(t[REP], p, accounts=t["accounts"]),
        "sales_fit_line": lambda t, p: penetration.sales_fit_line(t[REP], p, accounts=t["accounts"]),
        "acv_by_service_lines": lambda t, p: penetration.acv_by_service_lines(t[REP], p, t["accounts"]),
        "acv_by_service_lines_fmt": lambda t, p: penetration.acv_by_service_lines_fmt(t[REP], p, t["accounts"]),
    }.items()},
}


def load_inputs(spark: SparkSession, opportunity: str | None, account: str | None,
                report: str | None, report_format: str = "csv") -> dict[str, DataFrame]:
    """The three inputs; ``report_format`` says whether the report is a ``csv`` export or a ``parquet`` table."""
    if report_format not in ("csv", "parquet"):
        raise ValueError(f"report_format must be 'csv' or 'parquet', not {report_format!r}")
    t: dict[str, DataFrame] = {}
    if opportunity:
        t[OPP] = tables.read_opportunity(spark, opportunity)
    if account:
        t[ACC] = tables.read_account(spark, account)
    if report:
        t[REP] = (tables.read_opp_report_csv(spark, report) if report_format == "csv"
                  else tables.read_table(spark, report))
    return t


def _available(needs: tuple[str, ...], inputs: dict) -> bool:
    return all(_available(SHARED[k][0], inputs) if k in SHARED else k in inputs for k in needs)


def run_all(spark: SparkSession, inputs: dict[str, DataFrame], out_dir: str, p: Params = Params(),
            fmt: str = "parquet", only: list[str] | None = None) -> list[str]:
    """Write every analysis whose inputs are present; returns the names written."""
    out, t, done = out_dir.rstrip("/"), dict(inputs), []

    def provide(names: tuple[str, ...]) -> None:
        for k in names:
            if k not in t:
                needs, build = SHARED[k]
                provide(needs)
                df = build(t, p)
                df.write.mode("overwrite").parquet(f"{out}/_shared/{k}")
                t[k] = spark.read.schema(df.schema).parquet(f"{out}/_shared/{k}")

    for name, (needs, fn) in ANALYSES.items():
        if (only and name not in only) or not _available(needs, inputs):
            continue
        provide(needs)
        df = fn(t, p)
        if fmt == "csv":
            tables.write_csv(df, f"{out}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        done.append(name)
    return done


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--opportunity")
    ap.add_argument("--account")
    ap.add_argument("--report")
    ap.add_argument("--report-format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--min-year", type=int, default=Params().min_year)
    ap.add_argument("--service-lines", help="comma-separated; default: the report's list")
    ap.add_argument("--max-gap-days", type=int, default=Params().max_gap_days)
    ap.add_argument("--only", help="comma-separated analysis names")
    a = ap.parse_args(argv)
    p = Params(min_year=a.min_year, max_gap_days=a.max_gap_days,
               **({"service_lines": tuple(s.strip() for s in a.service_lines.split(","))}
                  if a.service_lines else {}))
    spark = get_session()
    inputs = load_inputs(spark, a.opportunity, a.account, a.report, a.report_format)
    names = run_all(spark, inputs, a.out, p, a.format, a.only.split(",") if a.only else None)
    print(f"wrote {len(names)} results to {a.out}")


if __name__ == "__main__":
    main()
