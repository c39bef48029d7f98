"""End-to-end runner on landed tables."""

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import clients, cycles, penetration, referral
from acvlens.run import ANALYSES, SHARED, load_inputs, run_all
from acvlens.sources import fixtures as fx
from acvlens.sources import tables

from conftest import SF_SMALL


def test_run_all_on_landed_inputs(spark, tmp_dir):
    fx.opportunity(spark, SF_SMALL).write.parquet(f"{tmp_dir}/opportunity")
    fx.account(spark, SF_SMALL).write.parquet(f"{tmp_dir}/account")
    tables.write_csv(fx.opp_report(spark, SF_SMALL), f"{tmp_dir}/exports")
    inputs = load_inputs(spark, f"{tmp_dir}/opportunity", f"{tmp_dir}/account", f"{tmp_dir}/exports")
    names = run_all(spark, inputs, f"{tmp_dir}/out", P)
    assert sorted(names) == sorted(ANALYSES) and {"sales_fit_line", "sales_scatter_all"} <= set(names)
    rep, opp, acc = inputs["report"], inputs["opportunity"], inputs["account"]
    direct = {  # the shared intermediates change no result
        "report_dedup": cycles.report_dedup(rep, P), "purchase_gaps": cycles.purchase_gaps(rep, P), "cycle_boxplot": cycles.cycle_boxplot(rep, P),
        "service_line_counts": cycles.service_line_counts(rep, P),
        "acct_volume_lines": penetration.acct_volume_lines(rep, P), "acct_sales_won": penetration.acct_sales(rep, P),
        "sales_scatter_all": penetration.sales_scatter(rep, P, "all"),
        "acv_by_service_lines_fmt": penetration.acv_by_service_lines_fmt(rep, P),
        "win_pct_display": referral.win_pct_display(opp, P),
        "ranked_accounts_by_acv": referral.referral_ranked(opp, acc, P),
        "client_cpa_summary": clients.client_cpa_summary(opp, acc, P),
        "endclient_referral_summary": clients.sales_referral_full(opp, acc, P),
        "referral_account_acv": referral.referral_account_acv(opp, P)}
    for name, want in direct.items():
        got = spark.read.parquet(f"{tmp_dir}/out/{name}")
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    for name in SHARED:
        assert spark.read.parquet(f"{tmp_dir}/out/_shared/{name}").count() > 0


def test_run_writes_csv(spark, tmp_dir):
    inputs = {"opportunity": fx.opportunity(spark, SF_SMALL), "account": fx.account(spark, SF_SMALL)}
    only = ["ranked_accounts_by_acv", "win_pct_display", "cycle_boxplot"]
    assert run_all(spark, inputs, f"{tmp_dir}/out", P, fmt="csv", only=only) == ["win_pct_display", "ranked_accounts_by_acv"]
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out/ranked_accounts_by_acv").count() == 60
