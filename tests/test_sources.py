import re
import gzip
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retail_insight.functions.dates import COLUMN_LAYOUTS, elect_layout, parse_in_layout
from retail_insight.operators.ingest import standardize_transactions, with_invoice_numbers
from retail_insight.sources.files import read_records, read_transactions_csv, with_row_numbers

GOOD = [
    "id,when,amount,note",
    "1,2024-01-02,12.5,plain",
    '2,2024-01-03,7,"two\nlines, and a comma"',
    '3,2024-01-04,8,"a ""quoted"" word"',
    '"4","2024-01-05","9",""',
    "5,NA,null,None",
    "6,2024-01-06",
    "",
    '7,2024-01-07,1,"  spaces "',
    '8,2024-01-08,2,"crlf\r\ninside"',
    "9,2024-01-09,3,it's 5 o'clock",
]


def _as_pandas(path, **how):
    df = pd.read_csv(path, dtype=str, **how)
    return [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]


@pytest.mark.parametrize("packed", [False, True])
def test_records_as_pandas_reads_them(spark, tmp_path, packed):
    path = str(tmp_path / ("a.csv.gz" if packed else "a.csv"))
    with (gzip.open if packed else open)(path, "wb") as fh:
        fh.write("\n".join(GOOD).encode())
    records, bad = read_records(spark, path)
    assert records.columns == ["id", "when", "amount", "note"]
    assert sorted(map(tuple, records.collect())) == sorted(_as_pandas(path))
    assert bad.count() == 0


def test_bad_records_are_kept_apart(spark, tmp_path):
    path = tmp_path / "b.csv"
    lines = [*GOOD, "10,2024-01-10,4,one,too many", '11,2024-01-11,5,"two\nlines",and,more', "12,2024-01-12,6,end,"]
    path.write_text("\n".join(lines))
    records, bad = read_records(spark, str(path))
    assert bad.count() == 2
    found = bad.collect()
    assert sorted(r.record for r in found) == sorted(lines[-3:-1]) and all(r.file.endswith("b.csv") for r in found)
    want = _as_pandas(path, on_bad_lines="skip", engine="python")
    assert sorted(r.id for r in records.collect()) == sorted([r[0] for r in want if r[0] not in ("10", "11")] + (["12"] if "12" not in {r[0] for r in want} else []))
    assert read_transactions_csv(spark, str(path)).count() == records.count() == 10


def test_random_records_as_pandas_reads_them(spark, tmp_path):
    rng = random.Random(11)
    path = tmp_path / "c.csv"
    values = ["".join(rng.choice('ab ",\n\'é;') for _ in range(rng.randint(0, 9))) for _ in range(600)]
    pd.DataFrame({"k": range(200), "x": values[:200], "y": values[200:400], "z": values[400:]}).to_csv(path, index=False)
    records, bad = read_records(spark, str(path))
    assert bad.count() == 0
    assert sorted(map(repr, map(tuple, records.collect()))) == sorted(map(repr, _as_pandas(path)))


def test_split_reading_without_line_breaks(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("k,v\n" + "".join(f'{i},"x ""{i}"""\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        records, _ = read_records(spark, str(path), line_breaks=False)
        assert records.rdd.getNumPartitions() > 3
        assert records.where(F.col("v") != F.concat(F.lit('x "'), F.col("k"), F.lit('"'))).count() == 0 and records.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_follow_files_and_splits(spark, tmp_path):
    for name, start in (("b", 2000), ("a", 0), ("c", 5000)):
        n = {"a": 2000, "b": 3000, "c": 1}[name]
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{start + i},{'x' * 20}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scan = spark.read.option("header", True).csv(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 10
        rows = with_row_numbers(scan, "n").collect()
        assert len(rows) == 5001 and all(int(r.k) + 1 == r.n for r in rows)
        plan = with_row_numbers(scan, "n")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SinglePartition") == 1     # the counts of splits, not the rows
        lines = with_invoice_numbers(scan.select("k"))
        assert {r.k: r.InvoiceNo for r in lines.where("k in ('0', '4999')").collect()} == {"0": "INV-000001", "4999": "INV-005000"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("values, layout", [
    (["13/02/2024", "01/02/2024", None], "day/month/year"),
    (["02/13/2024", "01/02/2024 10:30"], "month/day/year"),
    (["01/02/2024", "03/04/2024"], "month/day/year"),
    (["2024-01-02T03:04:05", "2024-01-02", "01/02/2024"], "iso"),
    (["2024-01-02 03:04", "2024-1-2 00:00:00"], "iso"),
    (["2024/01/02", "x"], "year/month/day"),
    (["31.12.2024 23:59", "1.2.2024"], "day.month.year"),
    (["31-12-2024", "01-02-2024"], "day-month-year"),
    (["x", None], "iso"),
])
def test_a_column_elects_its_layout(spark, values, layout):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert elect_layout(df, "d") == layout and layout in COLUMN_LAYOUTS


def test_elected_layout_decides_each_date(spark):
    rows = [("a", "3/4/2024", "1"), ("b", "25/4/2024 10:00", "1"), ("c", "2024-04-03", "1"), ("d", None, "1")]
    raw = spark.createDataFrame(rows, "customer string, date string, sales string")
    got = {r.CustomerID: str(r.PurchaseDate) for r in standardize_transactions(raw, date_layout="elect").collect()}
    assert got == {"a": "2024-04-03 00:00:00", "b": "2024-04-25 10:00:00"}
    named = standardize_transactions(raw, date_layout="month/day/year").collect()
    assert [(r.CustomerID, str(r.PurchaseDate)) for r in named] == [("a", "2024-03-04 00:00:00")]
    assert standardize_transactions(raw).count() == 2     # value by value: 25/4 is no month/day date
    typed = raw.select("customer", F.lit("2024-01-01").cast("timestamp_ntz").alias("date"), "sales")
    assert elect_layout(typed, "date") is None and standardize_transactions(typed, date_layout="elect").count() == 4
    assert raw.select(parse_in_layout("date", "iso").alias("t")).where("t is not null").count() == 1


def test_a_value_is_handed_to_no_layout_that_cannot_read_it(spark):
    rows = ["13/02/2024", "02/13/2024", "1/2/2024 3:04", "1/2/2024 03:04:05", "1/2/2024 010:30", "0/1/2024", "31/2/2024", "1/2/20245"]
    df = spark.createDataFrame([(v,) for v in rows], "d string")
    got = df.select(*[parse_in_layout("d", f"{x}/year").cast("string").alias(x[:1]) for x in ("month/day", "day/month")]).collect()
    assert [(r.m, r.d) for r in got] == [
        (None, "2024-02-13 00:00:00"), ("2024-02-13 00:00:00", None), ("2024-01-02 03:04:00", "2024-02-01 03:04:00"),
        ("2024-01-02 03:04:05", "2024-02-01 03:04:05"), ("2024-01-02 10:30:00", "2024-02-01 10:30:00"), (None, None), (None, None), (None, None)]
    shapes = {name: re.compile(shape) for name, (shape, _) in COLUMN_LAYOUTS.items()}
    assert [bool(shapes["month/day/year"].match(v)) for v in rows[:2]] == [False, True]
    assert [bool(shapes["day/month/year"].match(v)) for v in rows[:2]] == [True, False]
