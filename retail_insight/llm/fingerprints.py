"""Document fingerprints: one-permutation MinHash of word shingles.

Every shingle is hashed once; the hash's top bits name a bin and each bin
keeps its least hash. An empty bin borrows from the first filled bin of its
own fixed random order (optimal densification), so equal sets borrow alike.
Only the low bits of each bin are stored, and a comparison takes out the
matches that chance alone gives to such short values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.textarrays import WordHasher, mix64, shingles

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 4
CHUNK_CHARS = 4_000_000
#: Bytes of text for each task.
PART_BYTES = 64 << 20
#: Accuracy of the sketch of ids, and the most borders taken from it.
SKETCH = 10_000
#: Sorting buckets per task; several even out a hash of buckets to tasks.
BUCKETS_PER_PARTITION = 4


class Fingerprinter:
    """Packs the low bits of the bins of a text's shingles, as a hex string."""

    def __init__(self, shingle: int = SHINGLE, bin_bits: int = BIN_BITS) -> None:
        self.shingle, self.bin_bits, self.bins = shingle, bin_bits, 1 << bin_bits
        self.hasher = WordHasher()
        order = mix64(np.arange(self.bins * self.bins, dtype=np.uint64) + np.uint64(0x51ED270B))
        self.lenders = np.argsort(order.reshape(self.bins, self.bins), axis=1).astype(np.int64)

    def of_shingles(self, s: np.ndarray) -> str:
        if not len(s):
            return ""
        s = np.sort(s)
        bins = (s >> np.uint64(64 - self.bin_bits)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        low = np.zeros(self.bins, dtype=np.uint8)
        filled = np.zeros(self.bins, dtype=bool)
        filled[bins[first]] = True
        low[bins[first]] = (s[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
        empty = np.flatnonzero(~filled)
        if len(empty):
            lenders = self.lenders[empty]
            low[empty] = low[lenders[np.arange(len(empty)), filled[lenders].argmax(axis=1)]]
        return ((low[0::2] << 4) | low[1::2]).tobytes().hex()

    def of_texts(self, texts) -> list[str]:
        out, at = [], 0
        while at < len(texts):
            stop, room = at + 1, len(texts[at])
            while stop < len(texts) and room + len(texts[stop]) <= CHUNK_CHARS:
                room += len(texts[stop])
                stop += 1
            flat, cut = self.hasher.many(texts[at:stop])
            out += [self.of_shingles(shingles(flat[a:b], self.shingle)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            at = stop
        return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints. Bins that differ in
    their sets still agree in their low bits by chance, 1 in 2**LOW_BITS; that
    share is taken out. Two empty fingerprints are alike, one is not."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=np.uint8) for v in (a, b))
    d = x ^ y
    same = (np.count_nonzero(d >> 4 == 0) + np.count_nonzero(d & 15 == 0)) / (2 * len(d))
    chance = 2.0 ** -LOW_BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def bucket_of(key: np.ndarray, mark: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many borders (keys, marks), in ascending order, are at most (key, mark), less one."""
    low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
    at = high - 1
    for k in np.unique(key[high > low]):
        rows = np.flatnonzero(key == k)
        a, b = low[rows[0]], high[rows[0]]
        at[rows] = a - 1 + np.searchsorted(marks[a:b], mark[rows], side="right")
    return at


def next_to_each(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tail, key, mark, doc_id, text) with the rows in ascending
    doc_id (null first), then by the hash of the text, within a bucket, and
    behind each bucket's rows the first row of the next one (tail = 1; behind
    the last bucket the first of all).

    Bucket borders come from a sketch of the id column. An id that the sketch
    names r times, such as null for a third of the rows, is cut into r ranges
    of the hash. A bucket is one range, so the texts are shuffled once.
    """
    keyed = (documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
             .withColumn("mark", F.xxhash64("text")))
    found = keyed.agg(F.min("key"), F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [0.5], SKETCH)).first()
    named, times = np.unique(np.array([found[0], *(found[1] or [])] if found[0] is not None else [0], dtype=np.int64), return_counts=True)
    cuts = [(int(k), -(1 << 63) + (j << 64) // int(r)) for k, r in zip(named, times, strict=True) for j in range(int(r))]

    def place(borders):
        keys, marks = (np.array([x[i] for x in borders], dtype=np.int64) for i in (0, 1))

        @F.pandas_udf("at long, border boolean")
        def placed(key: pd.Series, mark: pd.Series) -> pd.DataFrame:
            k, m = key.to_numpy(), mark.to_numpy()
            at = bucket_of(k, m, keys, marks)
            return pd.DataFrame({"at": at, "border": (keys[at] == k) & (marks[at] == m)})

        return placed("key", "mark")

    # the first row of each bucket that has rows: at most `buckets` of them
    firsts = keyed.select("key", "mark", place(cuts).alias("p")).groupBy("p.at").agg(F.min(F.struct("key", "mark")).alias("b")).select("b.*")
    borders = sorted((r["key"], r["mark"]) for r in firsts.collect()) or cuts
    n = len(borders)
    own = F.struct(F.col("p.at").alias("bucket"), F.lit(0).alias("tail"))
    before = F.struct(((F.col("p.at") + n - 1) % n).alias("bucket"), F.lit(1).alias("tail"))
    return (keyed.withColumn("p", place(borders))
            .select(F.explode(F.when(F.col("p.border"), F.array(own, before)).otherwise(F.array(own))).alias("q"), "key", "mark", "doc_id", "text")
            .select("q.bucket", "q.tail", "key", "mark", "doc_id", "text"))


def fingerprint_documents(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of documents (doc_id, text): n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last quarter (rounded down) of the code
    points by as many from the start of the next text in ascending doc_id (or
    all it has); after the last comes the first, so a single row is next to
    itself. A null text is empty; a text without words has the empty
    fingerprint. Texts of fewer than ``shingle`` words have one shingle. Rows
    of one doc_id follow each other by the hash of their text, then the text,
    each giving a row. An empty table gives an empty result.

    The number of tasks grows with the bytes of text, PART_BYTES each, up to
    the SKETCH borders that the sketch can tell apart; tasks stream their rows.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), SKETCH)
    rows = next_to_each(documents, min(parts * BUCKETS_PER_PARTITION, SKETCH))
    sorted_rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "key", "mark", "text")

    def per_task(batches):
        maker = Fingerprinter(shingle)
        held = None  # (bucket, doc_id, text, fingerprint) that waits for its next text
        for pdf in batches:
            texts = list(pdf["text"])
            prints = maker.of_texts(texts)
            pairs = []
            for bucket, tail, doc_id, text, mark in zip(pdf["bucket"], pdf["tail"], pdf["doc_id"], texts, prints, strict=True):
                if held is not None and held[0] == bucket:
                    pairs.append((*held[1:], text, mark))
                held = None if tail else (bucket, doc_id, text, mark)
            if not pairs:
                continue
            edited = []
            for _, text, _, follower, _ in pairs:
                k = len(text) // 4
                edited.append(text[: len(text) - k] + follower[:k])
            marks = maker.of_texts(edited)
            yield pd.DataFrame({
                "doc_id": pd.array([None if pd.isna(p[0]) else int(p[0]) for p in pairs], dtype="Int64"),
                "n_chars": [len(p[1]) for p in pairs],
                "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
                "fingerprint": [p[2] for p in pairs],
                "edited_fingerprint": marks,
                "near_edited": [likeness(p[2], m) for p, m in zip(pairs, marks, strict=True)],
                "near_next": [likeness(p[2], p[4]) for p in pairs],
            })

    return sorted_rows.mapInPandas(per_task, schema="doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and its edited text."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
