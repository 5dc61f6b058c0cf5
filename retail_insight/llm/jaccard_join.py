"""Similarity join of documents on word shingles: the chosen-path join.

1. Every text becomes a set of hashed shingles, every set a row of SLOTS
   MinHash values; rows with equal sets are one class.
2. In each run, all classes start in one bucket. A bucket is split on slots
   drawn by its path: a class joins one child for each drawn slot, namely the
   one that its own value in that slot names, so that classes meet again where
   they share tokens. A slot is drawn with chance 1 / (similarity * SLOTS).
   Buckets of up to ``bucket`` classes are searched by brute force on the
   MinHash values; larger ones are split again, and what is still large at
   the deepest level is searched in blocks. Runs repeat until the expected
   recall is reached.
3. Classes that are linked this way form groups, and within each group all
   shingle sets are compared exactly, in blocks. Counts and a spanning forest
   leave a block, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.components import components
from retail_insight.llm.textarrays import WordHasher, mix64, shingles
from retail_insight.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
SLOTS = 96
#: Standard errors of the MinHash estimate that a candidate may lie below the similarity.
SLACK = 3.0
BUCKET = 4096
DEPTH = 3
BLOCK_CHARS = 2_000_000
PART_CHARS = 4_000_000


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the similarity has met in one with chance
    ``recall``, if all its buckets had to be split ``depth`` times: the number
    of shared children is close to Poisson with mean 1 at the similarity, so
    the chance of losing a pair follows from that branching process."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


class MinHasher:
    def __init__(self, shingle: int) -> None:
        self.shingle, self.hasher = shingle, WordHasher()
        seeds = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factor = seeds | np.uint64(1)

    def rows(self, texts):
        """For each text: (two hashes of its shingle set, its size, its
        MinHash values as bytes), or None for a text without words."""
        flat, cut = self.hasher.many(texts)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = np.unique(shingles(flat[a:b], self.shingle))
            if not len(s):
                yield None
                continue
            least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(s), 4096):
                part = s[at : at + 4096, None] * self.factor
                np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
            one = np.bitwise_xor.reduce(mix64(s))
            two = mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
            yield int(one.view(np.int64)), int(two.view(np.int64)), len(s), (mix64(least) >> np.uint64(32)).astype(np.uint32).tobytes()


def _parts(pdf: pd.DataFrame):
    """Parts of a batch of about PART_CHARS characters of text, or one row."""
    size = pdf["text"].str.len().fillna(0).to_numpy(dtype=np.int64)
    group = (np.cumsum(size) - size) // PART_CHARS
    for g in np.unique(group):
        yield pdf[group == g]


def hash_documents(documents: DataFrame, shingle: int) -> DataFrame:
    """doc, set1, set2, size, slots of all texts that have words."""

    def per_batch(batches):
        hasher = MinHasher(shingle)
        for pdf in batches:
            for part in _parts(pdf):
                rows = [(d, *r) for d, r in zip(part["doc"].tolist(), hasher.rows(part["text"]), strict=True) if r]
                yield pd.DataFrame(rows, columns=["doc", "set1", "set2", "size", "slots"])

    return documents.mapInPandas(per_batch, schema="doc long, set1 long, set2 long, size long, slots binary")


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, rep): the children that each row (path, rep, slots) goes to."""
    chance = 1 / (similarity * SLOTS)

    def per_batch(batches):
        number = np.arange(SLOTS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        limit = np.uint64(min(chance, 1.0) * (2**64 - 1))
        for pdf in batches:
            if not len(pdf):
                continue
            path = pdf["path"].to_numpy(dtype=np.int64).view(np.uint64)
            slots = np.frombuffer(b"".join(pdf["slots"]), dtype=np.uint32).reshape(-1, SLOTS)
            which, slot = np.nonzero(mix64(path[:, None] + number[None, :]) <= limit)
            child = mix64(mix64(path[which] ^ number[slot]) + slots[which, slot].astype(np.uint64))
            yield pd.DataFrame({"path": child.view(np.int64), "rep": pdf["rep"].to_numpy()[which]})

    return rows.mapInPandas(per_batch, schema="path long, rep long")


def _attach(label: np.ndarray, i: int, hits: np.ndarray) -> np.ndarray:
    """One of ``hits`` for each component other than that of row i; those
    components become one with it. ``label`` names the component of each row."""
    other = label[hits]
    names, first = np.unique(other[other != label[i]], return_index=True)
    if not len(names):
        return names
    chosen = hits[other != label[i]][first]
    label[np.isin(label, names)] = label[i]
    return chosen


def _grouped(batches, keys: list[str]):
    """The groups of rows that agree in ``keys``, from batches sorted by them."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = pdf.iloc[a:b]
            if held and any(held[0][k].iloc[0] != piece[k].iloc[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _in_blocks(members: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """Give the members of each group their block pairs: columns x and y (x <=
    y) and side (0 in x, 1 in y). A group of total ``weight`` up to ``most`` is
    one block; a larger one is dealt out by id to enough blocks, and each
    member goes to every pair that its block is part of."""
    blocks = (members.groupBy(F.col(key).alias("_k")).agg(F.sum(weight).alias("_w"))
              .select("_k", F.greatest(F.ceil(F.col("_w") / most), F.lit(1)).cast("int").alias("_n")))
    own = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    dealt = members.join(blocks, F.col(key) == F.col("_k")).withColumn("_own", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(
        F.least(o, F.col("_own")).alias("x"), F.greatest(o, F.col("_own")).alias("y"), (o < F.col("_own")).cast("int").alias("side")))
    return dealt.withColumn("_p", F.explode(pair)).select(*members.columns, "_p.x", "_p.y", "_p.side")


def _search_buckets(buckets: DataFrame, similarity: float, slack: float) -> DataFrame:
    """(a, b): a spanning forest of each bucket's classes whose MinHash
    values agree in enough slots."""
    need = similarity - slack * math.sqrt(similarity * (1 - similarity) / SLOTS)

    def per_task(batches):
        for g in _grouped(batches, ["path", "x", "y"]):
            if len(g) < 2:
                continue
            g = g.sort_values("rep")
            slots = np.frombuffer(b"".join(g["slots"]), dtype=np.uint32).reshape(-1, SLOTS)
            side, cross = g["side"].to_numpy(), g["x"].iloc[0] != g["y"].iloc[0]
            label, kept = np.arange(len(g)), []
            for i in range(len(g) - 1):
                same = np.count_nonzero(slots[i + 1 :] == slots[i], axis=1) >= need * SLOTS
                if cross:
                    same &= side[i + 1 :] != side[i]
                kept += [(i, j) for j in _attach(label, i, np.flatnonzero(same) + i + 1).tolist()]
            if kept:
                rep = g["rep"].to_numpy()
                at = np.array(kept)
                yield pd.DataFrame({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    keys = ["path", "x", "y"]
    return (buckets.repartition(*keys).sortWithinPartitions(*keys)
            .mapInPandas(per_task, schema="a long, b long"))


def candidate_links(reps: DataFrame, similarity: float, recall: float, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(a, b): links that hold together the classes (rep, slots) whose
    MinHash values are near enough to be checked exactly."""
    runs = runs_needed(similarity, recall, depth)
    root = reps.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("path"), "rep", "slots")
    rows, links = _children(root, similarity), None
    for level in range(1, depth + 1):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = materialize(rows.join(counts, "path").join(reps, "rep").select("path", "rep", "slots", "n"))
        last = level == depth
        small = met if last else met.where(F.col("n") <= bucket)
        found = _search_buckets(_in_blocks(small.withColumn("one", F.lit(1)), "path", "one", bucket), similarity, SLACK)
        links = found if links is None else links.union(found)
        if last:
            break
        large = met.where(F.col("n") > bucket)
        if not large.take(1):
            break
        rows = _children(large, similarity)
    return links.distinct()


def exact_links(members: DataFrame, documents: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of members (rep, grp), all pairs within a group whose shingle sets have
    the Jaccard similarity: links counted by rep (rep, n_links), and a
    spanning forest (a, b)."""
    texts = (documents.join(members, F.col("doc") == F.col("rep"))
             .groupBy("rep", "grp").agg(F.min("text").alias("text")).withColumn("_w", F.length("text") + 1000))
    dealt = _in_blocks(texts, "grp", "_w", BLOCK_CHARS)

    def per_task(batches):
        hasher = WordHasher()
        for g in _grouped(batches, ["grp", "x", "y"]):
            if len(g) < 2:
                continue
            g = g.sort_values("rep")
            flat, cut = hasher.many(g["text"])
            sets = [np.unique(shingles(flat[a:b], shingle)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            known, ids = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(size)])
            side, cross = g["side"].to_numpy(), g["x"].iloc[0] != g["y"].iloc[0]
            mark = np.zeros(len(known), dtype=bool)
            count, label, links = np.zeros(len(g), dtype=np.int64), np.arange(len(g)), []
            for i in range(len(g) - 1):
                mark[ids[start[i] : start[i + 1]]] = True
                shared = np.add.reduceat(mark[ids[start[i + 1] :]].astype(np.int32), start[i + 1 : -1] - start[i + 1])
                mark[ids[start[i] : start[i + 1]]] = False
                near = shared >= similarity * (size[i + 1 :] + size[i] - shared) - 1e-9
                if cross:
                    near &= side[i + 1 :] != side[i]
                hit = np.flatnonzero(near) + i + 1
                count[i] += len(hit)
                count[hit] += 1
                links += [(i, j) for j in _attach(label, i, hit).tolist()]
            rep, some = g["rep"].to_numpy(), count > 0
            kept = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": np.concatenate([rep[some], rep[kept[:, 0]]]), "b": np.concatenate([np.zeros(some.sum(), dtype=np.int64), rep[kept[:, 1]]]),
                                "n": np.concatenate([count[some], np.full(len(kept), -1)])})

    keys = ["grp", "x", "y"]
    found = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys)
                        .mapInPandas(per_task, schema="a long, b long, n long"))
    counted = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    return counted, found.where("n < 0").select("a", "b")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                    recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """One row per doc_id of documents (doc_id, text): copy_of, n_links, class_id.

    copy_of is the least doc_id with the same shingle set, n_links the number
    of other such classes with Jaccard similarity of at least ``similarity``,
    class_id the least doc_id that links and copies lead to. Shingles are runs
    of ``shingle`` words (white space between them, A-Z in either case alike);
    a text of fewer words is one shingle. A null, empty or blank text has no
    shingle: it is in a class of its own without links. Rows that repeat a
    doc_id count as one, of the least text; rows without doc_id are left out.
    An empty table gives an empty result; other columns are ignored. Every
    link that is reported is exact; ``recall`` is the chance of a pair right
    at the similarity to be found by path, higher for nearer pairs.
    """
    docs = (documents.select(F.col("doc_id").alias("doc"), "text").where("doc is not null"))
    hashed = materialize(hash_documents(docs, shingle))
    reps = hashed.groupBy("set1", "set2").agg(F.min("doc").alias("rep"), F.first("slots").alias("slots"))
    classes = materialize(reps)
    links = candidate_links(classes.select("rep", "slots"), similarity, recall, bucket, depth)
    groups = components(links).select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    counted, forest = exact_links(groups, docs, similarity, shingle)
    found = components(forest).withColumnRenamed("id", "rep")
    per_class = (classes.select("set1", "set2", "rep").join(counted, "rep", "left").join(found, "rep", "left"))
    per_doc = (hashed.select("doc", "set1", "set2").join(per_class, ["set1", "set2"])
               .groupBy("doc").agg(F.min(F.struct("rep", F.coalesce("n_links", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("c"))).alias("v")))
    ids = docs.select(F.col("doc").alias("doc_id")).distinct()
    return ids.join(per_doc, F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", F.coalesce("v.rep", "doc_id").alias("copy_of"), F.coalesce("v.n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("v.c", "doc_id").alias("class_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
