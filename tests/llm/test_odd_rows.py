"""Every operator on awkward rows and on empty tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retail_insight.llm import (
    decontaminate, fingerprints, jaccard_join, license_scan, line_dedup, lm_score, quality, secret_scan, source_mix, token_counts,
)
from tests.llm.conftest import LONG, ODD_ROWS, WORDS

N = len(ODD_ROWS)


def of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(odd, nothing):
    path = token_counts.default_vocabulary()
    got = token_counts.count_tokens(odd, path)
    rows = of(got)
    assert got.count() == N and token_counts.count_tokens(nothing, path).count() == 0
    assert (rows[2].n_bytes, rows[2].n_tokens, rows[2].over_limit) == (0, 0, False)
    assert rows[3].n_tokens == 0 and rows[5].n_bytes == len(LONG) and rows[5].over_limit


def test_line_dedup(odd, nothing):
    got = line_dedup.dedup_lines(odd)
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert got.count() == N and got.columns == [*odd.columns, "n_lines", "n_exact", "n_near"]
    rows = of(got)
    assert rows[1].text == WORDS and rows[6].text == "" and rows[6].n_exact == 1
    assert rows[2].text is None and rows[2].n_lines == 0
    assert rows[3].text == "" and rows[4].text == "   \n \t " and rows[None].n_exact == 0
    assert rows[9].text.endswith("MIT License.") and rows[9].n_exact == 1 and rows[9].gone == "z"


def test_quality(odd, nothing, labels):
    scorer = quality.train(odd, labels, rounds=1)
    got = quality.score_documents(odd, scorer)
    assert got.count() == N and quality.score_documents(nothing, scorer).count() == 0
    assert all(0 <= r.p_good <= 1 for r in got.collect())
    assert quality.keep_good(odd, scorer).columns == odd.columns
    known = quality.known_documents(odd, labels)
    again = {(r.doc_id, round(r.p_good, 9), r.keep) for r in quality.score_known(odd, scorer, known).collect()}
    assert again == {(r.doc_id, round(r.p_good, 9), r.keep) for r in got.collect()} and quality.score_known(odd, scorer, known).count() == N
    blank = quality.train(nothing, labels.where("1 = 0"))
    assert {r.p_good for r in quality.score_documents(odd, blank).collect()} == {0.5}
    assert quality.train(nothing, labels) is not None


def test_licenses(spark, odd, nothing):
    templates = license_scan.template_table(spark, license_scan.TEMPLATES)
    rows = license_scan.scan_licenses(odd, templates).collect()
    assert [(r.doc_id, r.license_id, r.n_units, r.best_dice) for r in rows] == [(9, "MIT-notice", 1, 1.0)]
    assert license_scan.scan_licenses(nothing, templates).count() == 0
    assert license_scan.scan_licenses(odd, templates.where("1 = 0")).count() == 0


def test_jaccard_join(odd, nothing):
    rows = of(jaccard_join.near_duplicates(odd, recall=0.9))
    assert set(rows) == {r[0] for r in ODD_ROWS if r[0] is not None}
    assert rows[6].copy_of == 1 == rows[6].class_id and rows[6].n_links == 0
    assert rows[2].class_id == 2 and rows[3].class_id == 3 and rows[4].class_id == 4
    assert jaccard_join.near_duplicates(nothing, recall=0.9).count() == 0


def test_mix(odd, nothing):
    sized, aims = source_mix.size_and_aim(odd)
    rows = source_mix.mix(sized, aims).collect()
    assert len(rows) == N and all(0 <= r.copies <= 2 for r in rows)
    assert {r.id: r.size for r in rows if r.id in (2, 3, 4, 7)} == {2: 0, 3: 0, 4: 0, 7: 1}
    assert all(r.copies == 0 for r in rows if r.size == 0)
    sized, aims = source_mix.size_and_aim(nothing)
    assert source_mix.mix(sized, aims).count() == 0


def test_fingerprints(spark, odd, nothing):
    got = fingerprints.fingerprint_documents(odd).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == N and fingerprints.fingerprint_documents(nothing).count() == 0
    assert rows[1].fingerprint == rows[6].fingerprint != rows[5].fingerprint
    assert rows[2].fingerprint == rows[3].fingerprint == "" and rows[2].near_next == 1.0 and rows[1].near_next == 0.0
    alone = fingerprints.fingerprint_documents(odd.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_decontamination(spark, odd, nothing):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, "one"), (5, WORDS), (5, WORDS)], "item_id long, text string")
    rows = decontaminate.find_passages(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (1, 4), (1, 5), (6, 1), (6, 4), (6, 5), (9, 1), (9, 4), (9, 5)}
    assert len(rows) == 12  # the repeated row gives its own
    assert decontaminate.find_passages(nothing, items).count() == 0
    assert decontaminate.find_passages(odd, items.where("1 = 0")).count() == 0


def test_secrets(odd, nothing):
    ledger = secret_scan.scan_unseen(odd, "doc_id", None, "text")
    found = secret_scan.findings(secret_scan.address(odd, "doc_id", None, "text"), ledger)
    rows = of(found.select("path", secret_scan.joined(found.spans).alias("s")), "path")
    assert found.count() == N and rows[2].s == "" and rows[6].s == ""
    assert rows[8].s == "assign:0:22,access:24:44,hex:47:71"
    assert secret_scan.scan_unseen(nothing, "doc_id", None, "text").count() == 0


def test_lm(odd, nothing):
    got = lm_score.score_documents(odd, rounds=2).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == N and rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1
    assert rows[1].n_tokens == 13 and rows[5].n_tokens == 200_001
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert lm_score.score_documents(nothing, rounds=1).count() == 0


def test_pipeline_stages(spark, odd, nothing, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.drop("copies")
    for table in (docs, nothing.drop("copies")):
        assert pipeline.line_stage(spark, table, "").columns == docs.columns
        assert pipeline.near_duplicate_stage(spark, table, "").columns == docs.columns
        assert pipeline.mix_stage(spark, table, "").columns == [*docs.columns, "copies", "taken"]
    kept = [r.doc_id for r in pipeline.line_stage(spark, docs, "").collect()]
    assert 6 not in kept and {1, 2, 3, 4, 5, None} <= set(kept)


def test_decontamination_stage_goes_by_row(spark, odd, nothing, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, WORDS), (None, "a row without an id but with some words in it")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    more = odd.where("doc_id = 1").withColumn("text", F.lit("some clean words that share their number with a copied passage"))
    rows = pipeline.decontamination_stage(spark, odd.union(more), str(tmp_path))
    assert rows.columns == odd.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in rows.collect()) == [(1, "some "), (2, ""), (3, ""), (4, "   \n "), (5, "lorem"), (7, "x"), (8, "passw")]
    assert pipeline.decontamination_stage(spark, nothing, str(tmp_path)).count() == 0


def test_quality_stage_and_run(spark, odd, nothing, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.drop("copies")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, WORDS)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert pipeline.quality_stage(spark, nothing.drop("copies"), str(tmp_path)).count() == 0
    mixed = pipeline.run(spark, str(tmp_path))
    assert mixed.columns == [*docs.columns, "copies", "taken"]
    assert not [r for r in mixed.collect() if r.text and WORDS in r.text]


def test_mix_stage_gives_every_row_its_own_share(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    rows = [(None if k % 3 == 0 else k // 4, " ".join(f"w{k}x{j}" for j in range(rng.choice([0, 3, 3, 3, 9, 40]))),
             rng.choice(["a", "a", "b", "c", None])) for k in range(400)]
    rows += [(None, "the same row again", "a")] * 60 + [(900, f"other {k} words", "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in pipeline.mix_stage(spark, docs, "").collect()]
    assert not Counter(r[:3] for r in got) - Counter(rows)  # no row comes twice
    assert all(taken == copies * len(text.split()) and copies in (1, 2) for _, text, _, copies, taken in got)
    assert any(r[0] is None for r in got)
    # the words that the mix charges to each source are in the result, up to one row of what was aimed at
    _, aims = source_mix.size_and_aim(docs)
    for aim in aims.collect():
        assert abs(sum(r[4] for r in got if r[2] == aim.source) - aim.target) <= 2 * 40
    again = pipeline.mix_stage(spark, docs.repartition(5, "text"), "").collect()
    assert Counter(map(tuple, again)) == Counter(got)


def test_mix_stage_deals_out_the_copies_of_a_group_that_is_cut(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, f"some words here {k}", "a") for k in range(5)] + [(None, "one two three four", "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in pipeline.mix_stage(spark, docs, "").collect()]
    copies = {s: sorted(r[3] for r in got if r[2] == s) for s in "ab"}
    # 60 words are aimed at: source a stops at its 40, b gets 20
    assert copies == {"a": [2] * 5, "b": [1] * 5}
    got = [tuple(r) for r in pipeline.mix_stage(spark, docs.where("source = 'a'"), "").collect()]
    assert sorted(r[3] for r in got) == [1, 1, 1, 2, 2] and len({r[1] for r in got}) == 5
