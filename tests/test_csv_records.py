"""Records of CSV files read by many tasks a file, against Spark's reader of whole files."""

import os
import random

import pytest

from acvlens.sources import tables
from acvlens.sources.csv_records import assembled, line_index, multi_line_members, read_lines

NAMES = ["Stage", "Owner", "Opp_ID", "Acct_Id", "CPA_Contact_Acct_ID", "Record_Type_Name", "Close_Date", "ACV_for_Quotas"]


def write(folder, *texts):
    os.makedirs(folder, exist_ok=True)
    for k, text in enumerate(texts):
        with open(f"{folder}/export-{k}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return folder


def cell(rng, end):
    kind = rng.randrange(8)
    body = "".join(rng.choice(["a", "é", " ", "1", "-"]) for _ in range(rng.randrange(6)))
    if kind == 0:
        return ""
    if kind < 4:
        return body
    return '"' + "".join(rng.choice(["x", ",", '""', end, end + end, "é", "'"]) for _ in range(rng.randrange(7))) + '"'


def export(rng, rows, end="\n", last=True):
    lines = [",".join(NAMES)] + [",".join(cell(rng, end) for _ in NAMES) for _ in range(rows)]
    return end.join(lines) + (end if last else "")


def same(spark, path):
    whole, spread = (tables.read_opp_report_csv(spark, path, whole_files=w) for w in (True, False))
    assert spread.columns == whole.columns
    a, b = (sorted(map(tuple, d.collect()), key=repr) for d in (whole, spread))
    assert a == b
    return len(a)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_whole_file_reader(spark, tmp_dir, end):
    rng = random.Random(len(end))
    path = write(f"{tmp_dir}/e", *(export(rng, n, end, n % 2 > 0) for n in (150, 1, 0, 61)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("60", "333", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert same(spark, path) == 212
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_large_file_is_read_by_many_tasks(spark, tmp_dir):
    rng = random.Random(3)
    long = '"' + "line without quotes, with a comma\n" * 2000 + '"'
    text = export(rng, 4000) + ",".join([long, *["z"] * 7]) + "\n" + export(rng, 4000).split("\n", 1)[1]
    path = write(f"{tmp_dir}/e", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = read_lines(spark, [f"{path}/export-0.csv"])
        assert lines.rdd.getNumPartitions() > 10
        records = assembled(lines, multi_line_members(line_index(lines)))
        assert records.count() == 8002 and records.where("length(value) > 50000").count() == 1
        assert same(spark, path) == 8001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("row", [
    'a"b,c"d,e', '"closed"more,x,y', '"closed"more"",x', '"a""",b', '"""a",b', '""""', '"",""', 'a,"b\nc",d', ',"\n"",\n",,', '"x\n\n\ny"',
    "only one", 'a,b,c,d,e,f,g,h,i,j', ' "not a cell', '"open to the end'])
def test_odd_rows(spark, tmp_dir, row):
    same(spark, write(f"{tmp_dir}/e", ",".join(NAMES) + f"\nw,b,c,d,e,f,1/5/2020,1\n{row}\nw,b,\"c\",d,e,f,1/6/2020,2\n"))


def test_another_header_is_an_error(spark, tmp_dir):
    path = write(f"{tmp_dir}/e", export(random.Random(1), 3), ",".join(reversed(NAMES)) + "\n")
    with pytest.raises(Exception, match="header differs"):
        tables.read_opp_report_csv(spark, path).collect()


def test_a_header_over_two_lines_and_a_mark_before_it(spark, tmp_dir):
    names = [*NAMES[:-1], "ACV_for_Quotas", '"extra\ncolumn"']
    path = write(f"{tmp_dir}/e", "﻿" + ",".join(NAMES) + "\nw,b,o1,a,c,f,1/5/2020,1\n")
    assert [r.Opp_ID for r in tables.read_opp_report_csv(spark, path).collect()] == ["o1"]
    assert names[-1].startswith('"')
