"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both tokenizers' tokens are intervals of bytes. All intervals are sorted by
where they start, the ends seen so far are accumulated with a maximum, and a
group of tokens breaks where a start reaches that maximum. Inside a group
every token of one side is linked with every token of the other.

How often a pair of ids is linked is counted over the corpus. Texts are
worked on in blocks: a block's distinct pairs are numbered, only those numbers
are shuffled to be counted and looked up, and each text keeps its links as
numbers of its block.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retail_insight.llm.token_counts import byte_letters
from retail_insight.session import materialize

#: Characters that are tokenized at a time, and that share one numbering.
PART_CHARS = 1_000_000
BLOCK_CHARS = 8_000_000
#: Groups of more links than this are counted by their distinct ids.
WIDE = 256

#: Distinct words, and their characters, whose tokens a task keeps.
MEMO_WORDS = 400_000
MEMO_CHARS = 16_000_000

_GAP = re.compile(r"(?<=\S) (?=\S)")
_OTHER_GAP = re.compile(r"(?<!\S) | (?!\S)")


class Tokenizers:
    """Both tokenizers, and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = {c: k for k, c in enumerate(byte_letters())}
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else t.replace("▁", " ").encode() for k, t in enumerate(pieces)]
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # long texts are cut at single spaces between other characters if no piece spans such a place
        spec = json.loads(self.a.to_str())
        self.cuts = (not any(re.search("[^▁]▁", t) for t in pieces) and not spec["normalizer"]
                     and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True))
        n, m = len(names), len(pieces)
        self.b_bits = max(m - 1, 1).bit_length()
        self.pair_bits = self.b_bits + max(n - 1, 1).bit_length()
        texts = [f"{k}{end}" for ids, ends in ((n, ",|"), (m, ",;")) for end in ends for k in range(ids)]
        self.written = np.array([t.encode() for t in texts], dtype=object)
        self.written_from = (0, n, 2 * n, 2 * n + m)
        self._forget()

    def parts(self, text: str) -> list[str]:
        """The text in parts that the tokenizers treat alone as within it; a
        part but the first has lost the space that both put before a text."""
        if len(text) <= PART_CHARS or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > PART_CHARS:
            gap = _GAP.search(text, at + PART_CHARS // 2)
            if not gap:
                break
            out.append(text[at : gap.start()])
            at = gap.end()
        return [*out, text[at:]]

    def words(self, text: str) -> list[str]:
        """The runs between single spaces; both tokenizers treat each, behind
        a space, alone as within the text."""
        if not self.cuts:
            return [text]
        return _GAP.split(text) if _OTHER_GAP.search(text) else text.split(" ")

    def encode(self, texts: list[str]):
        """Tokens of A, how many each text has, the same of B, and whether both
        sides' bytes are those of a space and the text (if not: no tokens).
        Each distinct word is tokenized once and remembered."""
        words = [self.words(t) for t in texts]
        many = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for ws in words for w in ws]
        if len(self.memo) > MEMO_WORDS or self.memo_chars > MEMO_CHARS:
            self._forget()
        new = [w for w in dict.fromkeys(flat) if w not in self.memo]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.memo.__getitem__, flat), dtype=np.int64, count=len(flat))
        same = np.logical_and.reduceat(self.same[number], np.cumsum(many) - many)
        number = number[np.repeat(same, many)]
        text = np.repeat(np.arange(len(texts)), np.where(same, many, 0))
        out = []
        for ids, cut in ((self.a_ids, self.a_cut), (self.b_ids, self.b_cut)):
            size = cut[number + 1] - cut[number]
            out.append(ids[np.arange(size.sum()) + np.repeat(cut[number] - (np.cumsum(size) - size), size)])
            out.append(np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64))
        return *out, same

    def _forget(self) -> None:
        self.memo, self.memo_chars, self.same = {}, 0, np.empty(0, dtype=bool)
        self.a_ids = self.b_ids = np.empty(0, dtype=np.int64)
        self.a_cut = self.b_cut = np.zeros(1, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.memo_chars += sum(map(len, new))
        found, at = [(self.a_ids, self.a_cut, self.b_ids, self.b_cut, self.same)], 0
        while at < len(new):
            stop, room = at + 1, len(new[at])
            while stop < len(new) and room + len(new[stop]) < PART_CHARS // 4:
                room += len(new[stop]) + 1
                stop += 1
            found += self._together(new[at:stop])
            at = stop
        ids = [[f[k] for f in found] for k in (0, 2)]
        cuts = [[f[k][1:] + sum(map(len, some[:n])) for n, f in enumerate(found)] for k, some in zip((1, 3), ids, strict=True)]
        (self.a_ids, self.b_ids), (self.a_cut, self.b_cut) = map(np.concatenate, ids), (np.concatenate([[0], *c]) for c in cuts)
        self.same = np.concatenate([f[4] for f in found])

    def _together(self, words: list[str]) -> list:
        """Each word's tokens, from one text of all words; one by one where
        that text does not come back as its bytes with tokens that end at each
        word's end."""
        text = " ".join(words)
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode([text], num_threads=1)[0]
        raw = b" " + text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        cuts = []
        if same:
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            for size, ids in ((self.a_size, a), (self.b_size, b)):
                upto = np.cumsum(size[ids])
                at = np.searchsorted(upto, ends)
                same = same and bool((upto[at] == ends).all())
                cuts.append(np.concatenate([[0], at + 1]))
        if same or len(words) == 1:
            one = np.array([0, len(a)]), np.array([0, len(b)])
            return [(a, cuts[0], b, cuts[1], np.ones(len(words), dtype=bool)) if same else (a, one[0], b, one[1], np.zeros(1, dtype=bool))]
        half = len(words) // 2
        return self._together(words[:half]) + self._together(words[half:])


def coalesce(a_start, a_end, b_start, b_end):
    """The number of the group of each A and each B interval. A group ends
    where no interval of either side goes on."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_start)], group[len(a_start) :]


def _added_up(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their weights (1 if None)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_text: np.ndarray, tok: Tokenizers):
    """(text, pair of ids) as one key, and how many links of the text join
    that pair; sorted, distinct. Links of one group: all of its A with all of
    its B."""
    n = int(a_group[-1]) + 1 if len(a) else 0
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    wide = n_a * n_b > WIDE
    b_first = np.cumsum(n_b) - n_b
    at = np.flatnonzero(~wide[a_group]) if wide.any() else np.arange(len(a))
    times = n_b[a_group[at]]
    left = np.repeat(at, times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times - b_first[a_group[at]], times)
    keys, weights = _added_up((a_text[left] << tok.pair_bits) | (a[left] << tok.b_bits) | b[right], None)
    if wide.any():
        a_first = np.cumsum(n_a) - n_a
        found = [(keys, weights)]
        for g in np.flatnonzero(wide).tolist():
            x, nx = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
            found.append((((a_text[a_first[g]] << tok.pair_bits) | (x[:, None] << tok.b_bits) | y[None, :]).ravel(), np.outer(nx, ny).ravel()))
        keys, weights = _added_up(*(np.concatenate(v) for v in zip(*found, strict=True)))
    return keys, weights


class _Texts:
    """What is known of a block's texts."""

    def __init__(self, n: int) -> None:
        self.stats = np.zeros((n, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.hashes = [_Hash() for _ in range(n)]
        self.bad = np.zeros(n, dtype=bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, tok: Tokenizers, texts: list[str], owner: list[int]) -> None:
        """Align parts of texts; owner: the text of each, ascending."""
        a, a_many, b, b_many, same = tok.encode(texts)
        text = np.array(owner, dtype=np.int64)
        self.bad[text[~same]] = True
        if not len(a):
            return
        text, a_many, b_many = text[same], a_many[same], b_many[same]
        # parts whose bytes are those of their texts lie end to end on both sides
        a_end, b_end = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
        a_group, b_group = coalesce(a_end - tok.a_size[a], a_end, b_end - tok.b_size[b], b_end)
        n = int(a_group[-1]) + 1
        n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        a_text, a_cut = np.repeat(text, a_many), np.cumsum(a_many) - a_many
        part_of_group = np.searchsorted(a_group[a_cut], np.arange(n), side="right") - 1
        groups = np.bincount(part_of_group, minlength=len(text))
        joined = np.zeros(len(text), dtype=np.int64)
        np.add.at(joined, part_of_group, n_a * n_b)
        np.add.at(self.stats, text, np.column_stack([a_many, b_many, groups, joined]))
        # written out: each group's A ids, then its B ids
        a_place = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]
        b_place = np.arange(len(b)) + np.cumsum(n_a)[b_group]
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        index = np.empty(len(a) + len(b), dtype=np.int64)
        f = tok.written_from
        index[a_place] = a + np.where(a_last, f[1], f[0])
        index[b_place] = b + np.where(b_last, f[3], f[2])
        written, at = tok.written[index].tolist(), 0
        for k, many in zip(text.tolist(), (a_many + b_many).tolist(), strict=True):
            self.hashes[k].update(b"".join(written[at : at + many]))
            at += many
        self.found.append(links(a, b, a_group, b_group, a_text, tok))


class _Hash:
    """SHA-256 of what is written without the mark after the last group."""

    def __init__(self) -> None:
        self.hash, self.rest = hashlib.sha256(), b""

    def update(self, data: bytes) -> None:
        self.hash.update(self.rest + data[:-1])
        self.rest = data[-1:]


def align_block(tok: Tokenizers, texts: list[str]):
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256. Then of all
    its links: the block's distinct pairs, in how many texts each is linked,
    where each text's links begin, their numbers and how often each occurs."""
    seen = _Texts(len(texts))
    queue, owner, room = [], [], 0
    for k, t in enumerate(texts):
        for part in tok.parts(t) if t else []:
            if queue and room + len(part) > PART_CHARS:
                seen.add(tok, queue, owner)
                queue, owner, room = [], [], 0
            queue.append(part)
            owner.append(k)
            room += len(part)
    if queue:
        seen.add(tok, queue, owner)
    seen.stats[seen.bad] = 0
    shas = [h.hash.hexdigest() if n else "" for h, n in zip(seen.hashes, seen.stats[:, 0].tolist(), strict=True)]
    keys, weights = (np.concatenate([x[i] for x in seen.found]) if seen.found else np.empty(0, dtype=np.int64) for i in (0, 1))
    if len(keys) and (keys[1:] <= keys[:-1]).any():
        keys, weights = _added_up(keys, weights)
    if seen.bad.any():
        keep = ~seen.bad[keys >> tok.pair_bits]
        keys, weights = keys[keep], weights[keep]
    pairs, number, docs = np.unique(keys & ((1 << tok.pair_bits) - 1), return_inverse=True, return_counts=True)
    cut = np.searchsorted(keys >> tok.pair_bits, np.arange(len(texts) + 1))
    return seen.stats, shas, pairs, docs, cut, number, weights


def _pack(number: np.ndarray, weights: np.ndarray) -> bytes:
    return zlib.compress(np.diff(number, prepend=0).astype(np.int32).tobytes() + weights.astype(np.int64).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, dtype=np.int32, count=n), dtype=np.int64), np.frombuffer(raw, dtype=np.int64, offset=4 * n)


def align_tokens(documents: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum (long)
    and groups_sha256, as aligned from the byte-level BPE file ``path_a`` (over
    a space and the text) and the sentencepiece model ``path_b``.

    A null or empty text, or one that either tokenizer does not give back byte
    by byte, has no tokens: zeros and '' as hash, and its links count nowhere.
    Repeated rows, rows with the same key and rows without one are documents
    of their own; an empty table gives an empty result; further columns are
    ignored whatever their names. Both files must be readable by every
    executor.

    Memory: a task holds the tokens of PART_CHARS characters and the distinct
    links of one block (BLOCK_CHARS characters, or one text); longer texts are
    tokenized in parts cut where neither tokenizer looks across.
    """
    # a key travels as text, as pandas would turn whole numbers beside nulls into floats
    rows = documents.select(F.col(f"`{key}`").cast("string").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def encode(batches):
        from pyspark import TaskContext

        tok = Tokenizers(path_a, path_b)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        block, keys, texts, room = 0, [], [], 0

        def done():
            stats, shas, pairs, docs, cut, number, weights = align_block(tok, texts)
            n = len(texts)
            out = pd.DataFrame({"block": np.full(n, task + block), "_key": keys, **{c: stats[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                                "groups_sha256": shas, "links": [_pack(number[i:j], weights[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]})
            out["pairs"], out["docs"] = None, None
            yield out
            if len(pairs):
                pairs = ((pairs >> tok.b_bits) << 32) | (pairs & ((1 << tok.b_bits) - 1))
                yield pd.DataFrame({"block": [task + block], "_key": [None], "n_a": [0], "n_b": [0], "n_groups": [0], "n_links": [0],
                                    "groups_sha256": [None], "links": [None], "pairs": [pairs], "docs": [docs]})

        for pdf in batches:
            for k, t in zip(pdf["_key"].tolist(), pdf["_text"], strict=True):
                t = t if isinstance(t, str) else ""
                if texts and room + len(t) > BLOCK_CHARS:
                    yield from done()
                    block, keys, texts, room = block + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                room += len(t)
        if texts:
            yield from done()

    base = materialize(rows.mapInPandas(encode, schema="block long, _key string, n_a long, n_b long, n_groups long, n_links long, "
                                        "groups_sha256 string, links binary, pairs array<long>, docs array<long>"))
    numbered = base.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("number", "x")).select(
        "block", "number", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    of_a = W.partitionBy("a")  # an id has at most as many pairs as the other vocabulary has ids
    counts = (numbered.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
              .select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best")))
    looked = numbered.join(counts, "pair").select("block", "number", "n", "best")
    texts = base.where("pairs is null").select(*[F.col(c).alias(c) for c in base.columns if c not in ("pairs", "docs")])

    def finish(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        at = found["number"].to_numpy(dtype=np.int64)
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = found["n"].to_numpy(dtype=np.int64), found["best"].to_numpy(dtype=np.int64)
        sums = []
        for data in docs["links"]:
            number, weights = _unpack(data)
            sums.append((int((best[number] * weights).sum()), int((n[number] * weights).sum())))
        out = docs[["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        out["n_best"], out["count_sum"] = [x for x, _ in sums], [x for _, x in sums]
        return out

    result = texts.groupBy("block").cogroup(looked.groupBy("block")).applyInPandas(
        finish, schema="_key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return result.select(F.col("_key").cast(documents.schema[key].dataType).alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level BPE with a sentencepiece BPE over every whole
    text of ``documents``."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
