"""Token alignment, top-k search and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from retail_insight.llm import hard_negatives, token_align, topk_search, vectors
from tests.conftest import SF_SMALL


def aligned(texts):
    """Contract columns of each text, by plain loops over byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    from retail_insight.llm.token_counts import byte_letters

    path_a, path_b = token_align.default_tokenizers()
    a_tok = Tokenizer.from_file(path_a)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=path_b)
    value = {c: k for k, c in enumerate(byte_letters())}

    def a_bytes(k):
        return bytes(value[c] for c in a_tok.id_to_token(k))

    def b_bytes(k):
        piece = b_tok.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(k) else piece.replace("▁", " ").encode()

    out, linked = [], []
    for t in texts:
        groups = []
        if t:
            raw = b" " + t.encode()
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            if b"".join(map(a_bytes, a)) == raw and b"".join(map(b_bytes, b)) == raw:
                i = j = x = y = 0
                now = ([], [])
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        x += len(a_bytes(a[i]))
                        now[0].append(a[i])
                        i += 1
                    else:
                        y += len(b_bytes(b[j]))
                        now[1].append(b[j])
                        j += 1
                    if x == y:
                        groups.append(now)
                        now = ([], [])
        pairs = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        linked.append(pairs)
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append([sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(pairs.values()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""])
    count = Counter(p for pairs in linked for p in pairs)
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(*row[:4], sum(n for p, n in pairs.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in pairs.items()), row[4])
            for row, pairs in zip(out, linked, strict=True)]


AWKWARD = [None, "", " ", "  two  spaces ", "a", "<|endoftext|> and <s> and <0x41>", "tab\tand\r\nbreak", "▁ a lower block", "naïve café 東京タワー 🙂🙂",
           "=" * 700, "1234567890" * 30, "word " * 50, "word " * 50, "　wide gap", "\x00\x01 control"]


def columns(df):
    return sorted((tuple(r) for r in df.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))


def test_alignment_equals_plain_loops(spark, monkeypatch):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_SMALL}/documents.parquet'").fetchall()] + AWKWARD
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in enumerate(texts)], "doc_id long, text string, block long, n int, _key string")
    want = aligned(texts)
    got = token_align.align_tokens(docs.repartition(3), *token_align.default_tokenizers())
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(rows[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for k in range(len(texts))] == want
    # long texts in parts, small blocks, and every group by its distinct ids: the same
    monkeypatch.setattr(token_align, "PART_CHARS", 300)
    monkeypatch.setattr(token_align, "BLOCK_CHARS", 5000)
    monkeypatch.setattr(token_align, "WIDE", 0)
    assert columns(token_align.align_tokens(docs, *token_align.default_tokenizers())) == sorted(want)


def test_alignment_of_odd_rows(odd, nothing):
    paths = token_align.default_tokenizers()
    rows = token_align.align_tokens(odd, *paths).collect()
    assert len(rows) == odd.count() and token_align.align_tokens(nothing, *paths).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[2].n_a == by[3].n_b == 0 and by[2].groups_sha256 == "" and by[None].n_a > 0
    assert [r.n_links for r in rows if r.doc_id == 6] == [by[1].n_links] * 2


def test_intervals_coalesce():
    a, b = token_align.coalesce(*(np.array(x) for x in ([0, 2, 5, 9], [2, 5, 9, 10], [0, 3, 5, 6], [3, 5, 6, 10])))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]


def vector_rows(seed, n=300, d=6, labels=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * rng.choice([0.2, 1, 3], size=(n, 1))).astype(np.float32)
    x[: n // 3] = x[0]  # one vector holds a third of all rows
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(labels))) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * d, 1), (50, None, 1), (100, [1.0, None], 1), (150, [nan] * d, 2), (200, [inf] * d, 0), (250, [1.0, 2.0], 1),
             (50, rows[50][1], 0), (350, [], 1), (400, [0.0] * d, 2), (700, [2.0] * d, None), (701, [1e4] * d, 1)]
    return rows


def whole(v):
    return [int(np.floor(256 * float(x))) for x in v]


def valid(rows):
    return [(i, whole(v), label) for i, v, label in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, at int, id string, norm double")


@pytest.mark.parametrize("bucket, part", [(10_000, 10_000), (37, 3)])
def test_top_k_equals_all_products(spark, monkeypatch, bucket, part):
    monkeypatch.setattr(topk_search, "HELD", 200)
    rows = vector_rows(1)
    got = topk_search.top_k(table(spark, rows), "id % 50 = 0", 5, bucket_rows=bucket, part_rows=part).collect()
    want, known = [], valid(rows)
    for n, (q, v, _) in enumerate(known):
        if q % 50 == 0:
            best = sorted((-score(v, w), i, m) for m, (i, w, _) in enumerate(known) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i, _) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_rows(spark):
    assert topk_search.top_k(table(spark, []), "id % 50 = 0", 5).count() == 0
    assert topk_search.top_k(table(spark, [(50, [1.0], 0)]), "id % 50 = 0", 5).count() == 0
    rows = topk_search.top_k(table(spark, [(50, [1.0], 0), (1, [-2.0], 0)]), "id % 50 = 0", 5).collect()
    assert [tuple(r) for r in rows] == [(50, 1, 1, -131072)]


def test_buckets_prune_without_loss():
    """Clustered directions: high local thresholds, so coordinates are used."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    rows = middles[rng.integers(40, size=4000)] + 0.02 * rng.normal(size=(4000, 16))
    rows = np.round(1000 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    rows = rows[np.argsort(-np.linalg.norm(rows, axis=1), kind="stable")]
    length, key, q = np.linalg.norm(rows, axis=1), np.arange(4000), rows[::80]
    scores = vectors.products(q, rows)
    least = np.sort(scores, axis=1)[:, -6]
    bucket = topk_search.Bucket(rows, length)
    assert bucket.worth_from(q / np.linalg.norm(q, axis=1)[:, None]) <= 0.97
    assert len(bucket.by_coordinates(q[7] / np.linalg.norm(q[7]), 0.97)) < 800
    i, j, s = topk_search.search_bucket(rows, length, key, key, q, np.linalg.norm(q, axis=1), key[::80], least, 5)
    scores[np.arange(50), key[::80]] = vectors.LOW
    a, b, t = vectors.best(scores, key, 5)
    assert sorted(zip(i, j, s, strict=True)) == sorted(zip(a, b, t, strict=True))


def test_large_components():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, -1], [1 << 40, 1 << 40]])
    assert vectors.products(a, b).tolist() == [[(1 << 60) - 3, -vectors.LOW - 1]]


@pytest.mark.parametrize("block, part, depth", [(10_000, 10_000, 8), (41, 2, 1)])
def test_hard_negatives_equal_all_products(spark, monkeypatch, block, part, depth):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "DEPTH", depth)
    monkeypatch.setattr(hard_negatives, "HELD", 500)
    rows = vector_rows(2)
    got = hard_negatives.mine(table(spark, rows), "id % 10 = 0", F.col("label"), block_rows=block, part_rows=part).collect()
    known = [r for r in valid(rows) if r[2] is not None]
    want = []
    for n, (a, v, label) in enumerate(known):
        if a % 10:
            continue
        all_ = sorted((-score(v, w), i, m, other) for m, (i, w, other) in enumerate(known) if m != n)
        for s, p, *_ in [x for x in all_ if x[3] == label][:5]:
            far = [x for x in all_ if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            want += [(a, p, k + 1, i, -s, -t) for k, (t, i, *_) in enumerate(far)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_reading_stops_early():
    """Where one dimension tells all, lists need not be read to their end."""
    rng = np.random.default_rng(5)
    rows = np.column_stack([rng.permutation(4000) * 50, rng.integers(-3, 4, size=(4000, 3))])
    label = rng.integers(2, size=4000)
    ended = []
    read = hard_negatives.Lists.read
    hard_negatives.Lists.read = lambda self, anchors, depth: ended.append(depth) or read(self, anchors, depth)
    try:
        key = np.arange(4000)
        args = (rows, key, label, key, rows[:20], key[:20], label[:20])
        got = hard_negatives.search_block(*args, np.full((20, 1), vectors.LOW + 1), np.full((20, 1), hard_negatives.HIGH), True, 5)
    finally:
        hard_negatives.Lists.read = read
    assert 0 < max(ended) < 500
    scores = vectors.products(rows[:20], rows)
    scores[(label[None, :] != label[:20, None]) | (key[None, :] == key[:20, None])] = vectors.LOW
    a, b, s = vectors.best(scores, key, 5)
    assert sorted(zip(got[0], got[2], got[3], strict=True)) == sorted(zip(a, b, s, strict=True))


def test_no_anchor_or_positive(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(10, [1.0], 0)], [(10, [1.0], 0), (11, [1.0], 1)], [(11, [1.0], 0), (12, [1.0], 0)]):
        assert hard_negatives.mine(table(spark, rows), "id % 10 = 0", F.col("label")).count() == 0
