"""CSV export source and CSV sink."""

from decimal import Decimal

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import referral
from acvlens.sources import fixtures as fx
from acvlens.sources import tables

from conftest import SF_SMALL


def test_opp_report_csv_round_trip(spark, tmp_dir):
    rep = fx.opp_report(spark, SF_SMALL)
    tables.write_csv(rep, f"{tmp_dir}/report")
    back = tables.read_opp_report_csv(spark, f"{tmp_dir}/report")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in rep.schema]
    assert back.exceptAll(rep).count() == 0 and rep.exceptAll(back).count() == 0
    assert back.filter("ACV_for_Quotas IS NULL").count() == rep.filter("ACV_for_Quotas IS NULL").count() > 0
    assert back.filter("Close_Date = ''").count() > 0


def test_ranked_csv_keeps_order(spark, tmp_dir):
    ranked = referral.referral_ranked(fx.opportunity(spark, SF_SMALL), fx.account(spark, SF_SMALL), P)
    tables.write_csv(ranked, f"{tmp_dir}/ranked", single_file=True)
    import glob
    import csv
    (part,) = glob.glob(f"{tmp_dir}/ranked/part-*.csv")
    with open(part) as f:
        rows = list(csv.DictReader(f))
    assert [r["Name"] for r in rows] == [r.Name if r.Name is not None else "NA" for r in ranked.collect()]
    money = [int(r["R_total_acv"].replace("$", "").replace(",", "")) for r in rows]
    assert money == sorted(money, reverse=True)


def _export(folder, text):
    import os
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/export.csv", "w", newline="") as f:
        f.write(text)
    return folder


HEADER = "Stage,Owner,Opp_ID,Acct_Id,CPA_Contact_Acct_ID,Record_Type_Name,Close_Date,ACV_for_Quotas\n"


def test_csv_columns_by_header_name(spark, tmp_dir):
    path = _export(f"{tmp_dir}/e", HEADER + "6 - Closed Won,Bob,o1,a1,,R&D,1/5/2020,12.50\nx,y,o2,NA,c,,NA,NA\n")
    rows = {r.Opp_ID: r.asDict() for r in tables.read_opp_report_csv(spark, path).collect()}
    assert rows["o1"] == {"Opp_ID": "o1", "Acct_Id": "a1", "CPA_Contact_Acct_ID": "", "Record_Type_Name": "R&D",
                          "Close_Date": "1/5/2020", "ACV_for_Quotas": Decimal("12.50"), "Stage": "6 - Closed Won"}
    assert rows["o2"]["Acct_Id"] is None and rows["o2"]["Record_Type_Name"] == ""
    assert rows["o2"]["Close_Date"] is None and rows["o2"]["ACV_for_Quotas"] is None


def test_csv_quotes_and_line_breaks(spark, tmp_dir):
    path = _export(f"{tmp_dir}/e", HEADER + 'w,"A ""x"", b",o1,"line one\nline two",c,R&D,1/5/2020,1\n')
    (row,) = tables.read_opp_report_csv(spark, path).collect()
    assert row.Acct_Id == "line one\nline two" and row.Opp_ID == "o1" and row.ACV_for_Quotas == 1
    df = spark.createDataFrame([('Smith "Bob", LLC', "two\nlines", None)], "a string, b string, c string")
    tables.write_csv(df, f"{tmp_dir}/out", single_file=True)
    import csv
    import glob
    (part,) = glob.glob(f"{tmp_dir}/out/part-*.csv")
    with open(part, newline="") as f:
        assert list(csv.reader(f)) == [["a", "b", "c"], ['Smith "Bob", LLC', "two\nlines", "NA"]]


def test_csv_missing_column_and_other_header_are_errors(spark, tmp_dir):
    import pytest
    with pytest.raises(ValueError, match="lacks the columns Opp_ID"):
        tables.read_opp_report_csv(spark, _export(f"{tmp_dir}/a", HEADER.replace("Opp_ID", "Id") + "1,2,3,4,5,6,7,8\n"))
    folder = _export(f"{tmp_dir}/b", HEADER + "w,x,o1,a,c,R&D,1/5/2020,1\n")
    with open(f"{folder}/later.csv", "w") as f:
        f.write(HEADER.replace("Stage,Owner", "Owner,Stage") + "x,w,o2,a,c,R&D,1/5/2020,1\n")
    with pytest.raises(Exception):
        tables.read_opp_report_csv(spark, folder).collect()


def test_csv_rows_that_do_not_parse_are_shown(spark, tmp_dir):
    path = _export(f"{tmp_dir}/e", HEADER + "w,x,o1,a,c,R&D,1/5/2020,1\nw,x,o2,a,c,R&D,1/5/2020,much\nw,x,o3\n")
    assert {r.Opp_ID for r in tables.unparsed_rows(spark, path).collect()} == {"o2", "o3"}
    assert tables.read_opp_report_csv(spark, path).count() == 3


def test_dedup_display_order(spark):
    from acvlens.plans import cycles
    rows = cycles.report_dedup_sorted(fx.opp_report(spark, SF_SMALL), P).collect()
    key = [(r.Acct_Id is None, r.Acct_Id or "", r.parsed_date is None, str(r.parsed_date), r.Opp_ID) for r in rows]
    assert key == sorted(key) and len(rows) > 100
