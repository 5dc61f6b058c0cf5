"""Work within a task is cut into parts of a bounded size, with the same results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from retail_insight.llm import batches, quality
from tests.conftest import SF_SMALL


def _sizes(rows):
    def of(parts):
        for pdf in parts:
            yield pd.DataFrame({"n": [len(pdf)], "c": [int(pdf["text"].str.len().fillna(0).sum())]})

    return rows.mapInPandas(of, "n long, c long").collect()


def test_batches_go_by_bytes_and_lose_no_row(spark):
    before = spark.conf.get(batches._KEY) if batches._KEY in spark.conf.getAll else None
    try:
        spark.conf.unset(batches._KEY)
        batches.bounded_batches(spark, 20_000)
        assert spark.conf.get(batches._KEY) == "20000"
        rows = spark.range(400).select(F.when(F.col("id") % 50 == 0, F.repeat(F.lit("y"), 90_000)).when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 999))
                                       .alias("text")).coalesce(1)
        got = _sizes(rows)
        assert sum(r.n for r in got) == 400 and sum(r.c for r in got) == 8 * 90_000 + 999 * sum(i % 50 > 0 and i % 7 > 0 for i in range(400))
        # a batch ends with the row that reaches the bound, so it holds at most that row's bytes more
        assert len(got) > 20 and all(r.c <= 20_000 + 90_000 for r in got)
        batches.bounded_batches(spark, 5)
        assert spark.conf.get(batches._KEY) == "20000"
    finally:
        spark.conf.unset(batches._KEY)
        if before is not None:
            spark.conf.set(batches._KEY, before)


def test_quality_fitted_in_many_blocks(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = quality.known_documents(docs, labels)

    def kept():
        scorer = quality.train(docs, None, rounds=0, known=known)
        return {r.doc_id: r.keep for r in quality.score_known(docs, scorer, known).collect()}

    one = kept()
    monkeypatch.setattr(quality, "FIT_FEATURES", 300)
    many = kept()
    assert len(one) == len(many) == docs.count()
    assert sum(one[i] == many[i] for i in one) >= 0.95 * len(one)
