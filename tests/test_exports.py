import glob
import os

import pytest
from pyspark.sql import functions as F

from retail_insight.operators.ingest import retail_cleaning_profile
from retail_insight.plans import exports
from retail_insight.plans.catalog import _valued, online_retail_raw
from retail_insight.sources.sinks import MANIFEST, export_folder, read_export, write_csv, write_parquet
from tests.conftest import SF_SMALL

_read_back = read_export


def test_exports_round_trip(spark, tmp_path):
    valued = _valued(spark, SF_SMALL)
    out = str(tmp_path / "customers")
    exports.export_customers(valued, out)
    assert _read_back(spark, out).count() == 150
    wl = str(tmp_path / "watchlist")
    exports.export_watchlist(valued, wl)
    back = [float(r.Monetary) for r in _read_back(spark, wl).collect()]
    assert back == sorted(back, reverse=True)            # part files are in range order
    aud = str(tmp_path / "audience")
    exports.export_audience(valued, aud, "Champions")
    ids = [r.CustomerID for r in _read_back(spark, aud).collect()]
    assert ids == sorted(ids)
    clean = str(tmp_path / "retail")
    raw = online_retail_raw(spark, SF_SMALL)
    counts = exports.export_clean_retail(raw, clean)
    dates = [r.PurchaseDate for r in _read_back(spark, clean).collect()]
    assert dates == sorted(dates) and len(glob.glob(os.path.join(clean, "v-*", "part-*"))) >= 1
    assert counts == retail_cleaning_profile(raw).first().asDict() and counts["CleanRows"] == len(dates)


def test_a_failed_write_leaves_the_old_export(spark, tmp_path):
    out = str(tmp_path / "rows")
    write_csv(spark.range(3), out)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_csv(broken, out)
    assert sorted(r.id for r in read_export(spark, out).collect()) == ["0", "1", "2"]
    assert len(os.listdir(out)) - len([f for f in os.listdir(out) if "manifest" in f]) == 1     # nothing of the failed one is left


def test_exports_are_swapped_and_old_ones_go(spark, tmp_path):
    out = str(tmp_path / "rows")
    kept = []
    for n in (1, 2, 3):
        write_parquet(spark.range(n), out)
        kept.append(export_folder(spark, out))
        assert read_export(spark, out).count() == n
    assert [os.path.isdir(k.removeprefix("file:")) for k in kept] == [False, True, True]
    assert os.path.exists(os.path.join(out, MANIFEST))
    with pytest.raises(FileExistsError):
        write_parquet(spark.range(1), out, mode="error")
    with pytest.raises(ValueError):
        write_csv(spark.range(1), out, mode="append")
    with pytest.raises(FileNotFoundError):
        read_export(spark, str(tmp_path / "none"))


def test_text_with_quotes_and_line_breaks_comes_back(spark, tmp_path):
    out = str(tmp_path / "text")
    values = ['plain', 'a "quoted" word', 'two\nlines', 'x, y', '"', "é"]
    write_csv(spark.createDataFrame([(v, 1) for v in values], "t string, n int"), out)
    assert sorted(r.t for r in read_export(spark, out).collect()) == sorted(values)


def test_action_plan_export(spark, tmp_path):
    from retail_insight.operators.campaigns import ACTION_PLAN_COLUMNS
    from retail_insight.plans.pipeline import build_action_plan
    plan, _, variance = build_action_plan(_valued(spark, SF_SMALL), n_clusters=3, max_k=3)
    out = str(tmp_path / "plan")
    exports.export_action_plan(plan, out)
    back = _read_back(spark, out)
    assert tuple(back.columns) == ACTION_PLAN_COLUMNS and back.count() == 150 and len(variance) == 3
    spend = [float(r.Monetary) for r in back.collect()]
    assert spend == sorted(spend, reverse=True)
    assert {r.ML_Cluster for r in back.collect()} == {"Cluster 1", "Cluster 2", "Cluster 3"}
