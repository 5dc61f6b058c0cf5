"""Benchmark passages in documents.

Benchmark items are the queries, all documents the data: the items travel in
blocks of bounded size, and every document is read against each block. Windows
of an item's own length in words get a 64-bit SimHash of their word shingles,
each distinct one once, as the items do. Fingerprints within the Hamming radius
are found by cutting both into blocks of bits: of BLOCKS blocks at least one
differs in at most radius // BLOCKS bits.

What is found is compared exactly by weighted shingles. A shingle of an item
weighs SCALE // (items that hold it), counted over all items, so wording that
items share says little about any of them; each shingle of the window that the
item lacks weighs as much as the item's own do on average. All weights of one
item alike, this is Jaccard similarity. It depends on the item, the benchmark
and the window, not on how items are cut into blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.textarrays import WordHasher, mix64, shingles
from retail_insight.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
ITEMS_PER_BLOCK = 20_000
WORDS_PER_BLOCK = 2_000_000
SCALE = 1 << 20
#: Words of a text whose windows are fingerprinted at a time.
PIECE_WORDS = 1 << 16
#: Punctuation counts as space: a passage is found whatever its commas.
PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain_words(hasher: WordHasher, text) -> np.ndarray:
    return hasher.one(text.lower().encode("utf-8").translate(PLAIN)) if isinstance(text, str) and text else np.empty(0, dtype=np.uint64)


class ItemBlock:
    """Some items: their shingles and fingerprints with block tables."""

    def __init__(self, items: list[tuple], shingle: int, radius: int) -> None:
        """items: id, text and, in the order of the text's distinct shingles as
        signed numbers, how many items hold each (1 if left out)."""
        self.shingle, self.radius = shingle, radius
        self.hasher = WordHasher()
        words = [(x, w) for x in items if len(w := plain_words(self.hasher, x[1]))]
        self.ids = [x[0] for x, _ in words]
        self.length = np.array([len(w) for _, w in words], dtype=np.int64)
        self.sets = [np.unique(shingles(w, shingle)) for _, w in words]
        self.weights = [SCALE // held_by(s, x[2] if len(x) > 2 else None) for s, (x, _) in zip(self.sets, words, strict=True)]
        every = np.concatenate(self.sets) if self.sets else np.empty(0, dtype=np.uint64)
        self.known, df = np.unique(every, return_counts=True)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        order = np.argsort(every, kind="stable")
        self.owners, self.owner_at = owner[order], np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.sizes = sorted(set(np.minimum(self.length, shingle).tolist()))
        self.print = np.array([self.simhash(s) for s in self.sets], dtype=np.uint64)
        self.tables = self.block_tables()

    @staticmethod
    def signs(s: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.uint8).reshape(-1, 8), axis=1)
        return bits.astype(np.int32) * 2 - 1

    @classmethod
    def simhash(cls, s: np.ndarray) -> np.uint64:
        return cls.packed(cls.signs(s).sum(axis=0)[None, :])[0]

    @staticmethod
    def packed(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 0, axis=1).copy().view(np.uint64).ravel()

    @staticmethod
    def repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that came before, and where they last did."""
        order = np.argsort(s, kind="stable")
        same = s[order[1:]] == s[order[:-1]]
        return order[1:][same], order[:-1][same]

    @staticmethod
    def repeated(signed: np.ndarray, again: np.ndarray, before: np.ndarray, span: int) -> np.ndarray:
        """For each window of ``span`` shingles, by its first one, what its
        shingles add beyond their first time in it: the windows that begin at
        again - span + 1 to before hold both places."""
        out = np.zeros((len(signed) + 1, signed.shape[1]), dtype=signed.dtype)
        first = again - span + 1
        out[first[first > 0]] += signed[again[first > 0]]
        out[0] += signed[again[first <= 0]].sum(axis=0)
        out[before + 1] -= signed[again]
        return np.cumsum(out, axis=0, out=out)

    def block_tables(self) -> list[dict[int, np.ndarray]]:
        """For each block of bits, the items by every value near their own."""
        width, tables = 64 // BLOCKS, []
        flips = [sum(1 << b for b in bits) for k in range(self.radius // BLOCKS + 1)
                 for bits in itertools.combinations(range(width), k)]
        for b in range(BLOCKS):
            own = (self.print >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            table: dict[int, list[int]] = {}
            for item, value in enumerate(own.tolist()):
                for f in flips:
                    table.setdefault(value ^ f, []).append(item)
            tables.append({v: np.array(x) for v, x in table.items()})
        return tables

    def find(self, text, similarity: float):
        """(item id, first word, similarity) of the best window for each item."""
        if not self.ids:
            return []
        words, best = plain_words(self.hasher, text), {}
        n, step = len(words), PIECE_WORDS + int(self.length.max()) - 1
        for at in range(0, n, PIECE_WORDS):
            # windows that begin in the piece's first PIECE_WORDS words end in it; later ones begin again in the next
            self._find_in(words[at : at + step], at, n, similarity, best)
            if at + step >= n:
                break
        return [(self.ids[i], p, v) for i, (p, v) in sorted(best.items())]

    def similar(self, item: int, window: np.ndarray) -> float:
        """Weighted similarity of an item with a window's distinct shingles."""
        mine, weight = self.sets[item], self.weights[item]
        has = np.isin(mine, window, assume_unique=True)
        more = len(window) - int(has.sum())
        return float(weight[has].sum()) / float(weight.sum()) * (len(mine) / (len(mine) + more))

    def _find_in(self, words: np.ndarray, first: int, n: int, similarity: float, best: dict) -> None:
        """The best windows among ``words``, which begin at word ``first`` of a
        text of n words, go into ``best``."""
        by_size = {}
        for size in self.sizes:
            s = shingles(words, size)
            at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
            hit = self.known[at] == s
            if hit.any():
                near = {int(o) for k in np.unique(at[hit]) for o in self.owners[self.owner_at[k] : self.owner_at[k + 1]]}
                by_size[size] = (s, np.flatnonzero(hit), near)
        for size, (s, hit, near) in by_size.items():
            signed = self.signs(s)
            run = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signed, axis=0, dtype=np.int32)])
            again, before = self.repeats(s)
            for length in {int(self.length[i]) for i in near}:
                if min(length, self.shingle) != size:
                    continue
                span = max(min(length, n) - size + 1, 1)  # shingles in a window
                # a window without a shingle of some item has similarity 0 to all: it needs no fingerprint
                mark = np.zeros(len(s) + 1, dtype=np.int64)
                np.add.at(mark, np.maximum(hit - span + 1, 0), 1)
                np.add.at(mark, hit + 1, -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                start = start[start + span <= len(s)]
                if not len(start):
                    continue
                sums = run[start + span] - run[start]
                inside = again - before < span
                if inside.any():
                    sums -= self.repeated(signed, again[inside], before[inside], span)[start]
                prints = self.packed(sums)
                for k, item in self.within_radius(prints, length):
                    score = self.similar(item, np.unique(s[start[k] : start[k] + span]))
                    if score >= similarity - 1e-12 and score > best.get(item, (-1, 0))[1] + 1e-12:
                        best[item] = (first + int(start[k]), score)

    def within_radius(self, prints: np.ndarray, length: int):
        """All (window, item) with items of this length within the radius."""
        width = 64 // BLOCKS
        unique, back = np.unique(prints, return_inverse=True)
        found: dict[int, set[int]] = {}
        for b in range(BLOCKS):
            values = ((unique >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).tolist()
            for u, v in enumerate(values):
                if v in self.tables[b]:
                    found.setdefault(u, set()).update(self.tables[b][v].tolist())
        pairs = [(u, i) for u, items in found.items() for i in items if self.length[i] == length]
        if not pairs:
            return
        u, i = np.array(pairs).T
        near = np.bitwise_count(unique[u] ^ self.print[i]) <= self.radius
        of = {}
        for a, b in zip(u[near].tolist(), i[near].tolist(), strict=True):
            of.setdefault(a, []).append(b)
        for k, u_k in enumerate(back.tolist()):
            for item in of.get(u_k, ()):
                yield k, item


def held_by(s: np.ndarray, counts) -> np.ndarray:
    """How many items hold each of the sorted shingles s; counts is in their
    order as signed numbers, in which Spark has them."""
    out = np.ones(len(s), dtype=np.int64)
    if counts is not None:
        out[np.argsort(s.view(np.int64))] = counts
    return out


def item_table(benchmark: DataFrame, item: str, text: str, shingle: int) -> DataFrame:
    """i, t and held (array: how many items hold each of its shingles, in
    their order) of the distinct items that have words."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").dropDuplicates()
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()))

    def per_batch(batches):
        hasher = WordHasher()
        for pdf in batches:
            sets = [np.unique(shingles(plain_words(hasher, t), shingle)).view(np.int64) for t in pdf["t"]]
            yield pd.DataFrame({"n": np.repeat(pdf["n"].to_numpy(), [len(s) for s in sets]), "s": np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)})

    each = rows.mapInPandas(per_batch, schema="n long, s long")
    count = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    held = (each.join(count, "s").groupBy(F.col("n").alias("m")).agg(F.sort_array(F.collect_list(F.struct("s", "c"))).alias("x"))
            .select("m", F.col("x.c").alias("held")))
    return rows.join(held, F.col("n") == F.col("m")).select("i", "t", "held")


def item_blocks(items: DataFrame):
    """Lists of items, each of at most ITEMS_PER_BLOCK items and about
    WORDS_PER_BLOCK * 8 characters (or one item), read one after the other."""
    block, chars = [], 0
    for r in materialize(items).toLocalIterator():
        if block and (len(block) >= ITEMS_PER_BLOCK or chars + len(r.t) > WORDS_PER_BLOCK * 8):
            yield block
            block, chars = [], 0
        block.append((r.i, r.t, np.array(r.held, dtype=np.int64)))
        chars += len(r.t)
    if block:
        yield block


def find_passages(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
                  shingle: int = SHINGLE, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item of which it holds a passage: key,
    item_id, at_word (first word of the best window), similarity.

    Words are lower-cased runs of letters, digits and non-ASCII characters. The
    similarity is the part of the item's weight that the window has, times the
    part that the item's shingles are of both's. Items or documents of fewer than ``shingle`` words count as one
    shingle, null or empty ones match nothing; a document shorter than an item
    is one window. Of equally similar windows the first counts. A row
    that repeats a key gives its own rows. Empty tables give an empty result,
    other columns are ignored. An item without id counts like any other. The
    items are read in blocks of bounded size, each sent to the executors with
    one pass over the documents; a text of any length is read in pieces, so
    memory beyond its words does not grow with it.
    """
    rows = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = f"`{key}` {rows.schema['_key'].dataType.simpleString()}, item_id long, at_word long, similarity double"
    out = documents.sparkSession.createDataFrame([], schema)

    def search(block):
        def per_batch(batches):
            items = ItemBlock(block, shingle, radius)
            for pdf in batches:
                found = [(k, *f) for k, t in zip(pdf["_key"], pdf["_text"], strict=True) for f in items.find(t, similarity)]
                yield pd.DataFrame(found, columns=[key, "item_id", "at_word", "similarity"])

        return per_batch

    for block in item_blocks(item_table(benchmark, item, item_text, shingle)):
        out = out.unionByName(rows.mapInPandas(search(block), schema=schema))
    return out


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` items in all ``documents``."""
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
