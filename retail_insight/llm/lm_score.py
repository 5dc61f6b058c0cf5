"""Log-probabilities of texts under a hashed maximum-entropy language model and
the counts of all pairs and triples of tokens.

The counts of every pair and triple of neighbouring tokens of the training
documents, in a table keyed by hash and dealt over partitions, pull a token's
probability from the maximum-entropy model's towards its share after the same
one and two tokens: (n + weight * lower) / (N + weight), for pairs over the model
and for triples over pairs. N is the count of what stands before, so that a
history's probabilities add up to 1 at any weight; the table grows with the
n-grams seen.

In the maximum-entropy model a token's probability is a product of softmaxes: its class given the words
before it, its place among the class's most frequent words given the same,
and for all other words of the class their share of the class's counts. The
softmaxes add up weights of n-gram and skip features of the history, hashed
into tables of fixed size. A word's class follows from its looks (its first and
last bytes and closing mark), by way of the language that such looks
have most often in the training documents. The weights are learnt in rounds, each over its own
part of the training documents: every task adds up the gradient of its texts,
the sums are added over tasks, and one step is taken.

Words are known by 64-bit hashes, n-grams by 32 bits within a bucket; buckets
grow in number with the input, so that about one unseen n-gram in a thousand
meets another's count. The most frequent words (a fixed number) travel to the
tasks for the model's sake. Texts are dealt into blocks; a block's distinct
words and n-grams go to their buckets, packed, and come back with their counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.textarrays import WordHasher, mix64
from retail_insight.session import materialize

# The contract's split and smoothing.
FOLDS, HELD_OUT = 7, 2

END, START = np.uint64(1), np.uint64(2)  # stand for the hashes of the end and of what is before a text

LANGUAGES = 8
LOOKS = 3
CLASSES = LOOKS * LANGUAGES
SLOTS = 12
FREQUENT = 1 << 18
WORD_ROWS, PAIR_ROWS, PLACE_ROWS = 1024, 512, 64
SKIPS = (2, 3, 4, 5)
ROUNDS = 5
STEP = 0.25
LEAST_LOG = np.log(1e-30)
PRIOR = 8.0
TOKENS_AT_ONCE = 8_000
PART_CHARS = 500_000
BLOCKS = 16
COUNTED_WORDS = 1_000_000
SLICE_ROWS = 20_000
PREFIX_BITS = 18
PAIR_WEIGHT, TRIPLE_WEIGHT = 1000.0, 3.0
BLOCK_CHARS, BLOCK_ROWS, BUCKET_CHARS = 2_000_000, 20_000, 12_000_000

_KINDS = CLASSES + 2  # the classes, the end, and what stands before a text
_OUT = CLASSES + 1
_START = CLASSES + 1
_HISTORY_CUTS = np.cumsum([1, WORD_ROWS, PAIR_ROWS, _KINDS * _KINDS, *[_KINDS] * len(SKIPS)])
_HISTORY_ROWS = int(_HISTORY_CUTS[-1])
_MEMBER_ROWS = 1 + PLACE_ROWS + _KINDS


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id is trained on."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _slices(frame: pd.DataFrame):
    """The rows in frames of a size that Arrow takes as one piece."""
    for a in range(0, len(frame), SLICE_ROWS):
        yield frame.iloc[a : a + SLICE_ROWS]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each distinct key begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), dtype=bool), ordered[1:] != ordered[:-1]]))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def word_counts(documents: DataFrame) -> DataFrame:
    """h, code, g, c: how often each token, by its hash, stands in the texts
    (the end once a text), the code of its looks (-1: the end), and the language
    (by number; LANGUAGES - 1 for all but the most frequent) that it is most in."""
    main = [r.lang for r in documents.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "lang").limit(LANGUAGES - 1).collect()]
    number = {g: k for k, g in enumerate(main)}

    def per_batch(batches):
        hasher = WordHasher()
        seen: dict[int, list] = {}

        def merged(found):
            h, code, c = (np.concatenate(x) for x in zip(*found, strict=True))
            order, starts = _grouped(h)
            return h[order[starts]], code[order[starts]], _sums(c[order], starts)

        def out():
            for g, found in seen.items():
                h, code, c = merged(found)
                yield from _slices(pd.DataFrame({"h": h.view(np.int64), "code": code, "g": g, "c": c}))
            seen.clear()

        for pdf in batches:
            for part in _parts(pdf):
                for g, some in part.groupby(part["lang"].map(number).fillna(LANGUAGES - 1).astype(int)):
                    flat, _, code = hasher.many_with_codes(some["text"].tolist())
                    found = seen.setdefault(g, [])
                    found.append(merged([(np.append(flat, END), np.append(code, -1), np.append(np.ones(len(flat), dtype=np.int64), len(some)))]))
                if sum(len(h) for found in seen.values() for h, _, _ in found) > COUNTED_WORDS:
                    yield from out()
        yield from out()

    rows = documents.select("text", "lang").mapInPandas(per_batch, schema="h long, code int, g int, c long")
    by = [F.coalesce(F.sum(F.when(F.col("g") == k, F.col("c"))), F.lit(0)) for k in range(LANGUAGES)]
    total = rows.groupBy("h").agg(F.first("code").alias("code"), F.array(*by).alias("by"))
    return total.select("h", "code", (F.array_position("by", F.array_max("by")) - 1).cast("int").alias("g"),
                        F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x).alias("c"))


class Vocabulary(NamedTuple):
    """The frequent words, by hash: counts, classes and slots (0: none of its
    own); slots and counts of the others by class; the language of each look; all
    training tokens, distinct ones and ends."""

    hashes: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    slots: np.ndarray
    members: np.ndarray
    rest: np.ndarray
    language: np.ndarray
    tokens: int
    distinct: int
    ends: int


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """The words of the highest counts, at most ``frequent`` of them, are the
    frequent ones. The driver holds these, a histogram of counts and one
    number for each code of looks (at most 3 * 65536), whatever the corpus."""
    n, v, ends = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("code") < 0, F.col("c")))).first()
    words = counts.where(F.col("code") >= 0)
    looks = words.groupBy((F.col("code") / LOOKS).cast("int").alias("l"), "g").agg(F.sum("c").alias("c")).toPandas()
    votes = np.zeros((1 << 16, LANGUAGES))
    votes[looks["l"].to_numpy(dtype=np.int64), looks["g"].to_numpy(dtype=np.int64)] = looks["c"]
    language = votes.argmax(axis=1)

    def kind_of(code: np.ndarray) -> np.ndarray:
        return language[code // LOOKS] * LOOKS + code % LOOKS

    # the border between frequent and rare words is a count, found from a histogram of counts on a fixed log scale
    level = F.floor(F.log("c") * 64).cast("int")
    steps = sorted(((r.level, r.n) for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    border, room = (steps[0][0] + 1 if steps else 0), frequent
    for at, found in steps:
        if found > room:
            break
        border, room = at, room - found
    top = words.where(level >= border).toPandas().sort_values(["c", "h"], ascending=[False, True])
    kinds = kind_of(top["code"].to_numpy(dtype=np.int64))
    place = top.assign(k=kinds).groupby("k").cumcount().to_numpy(dtype=np.int64) + 1
    slots = np.where(place < SLOTS, place, 0)
    members = np.zeros(_OUT, dtype=np.int64)
    np.maximum.at(members, kinds, slots)
    rest = np.ones(_OUT, dtype=np.float64)
    mass = words.groupBy("code").agg((F.sum("c") + F.count(F.lit(1))).alias("z")).toPandas()
    np.add.at(rest, kind_of(mass["code"].to_numpy(dtype=np.int64)), mass["z"].to_numpy(dtype=float))
    np.subtract.at(rest, kinds[slots > 0], top["c"].to_numpy(dtype=np.int64)[slots > 0] + 1)
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], top["c"].to_numpy(dtype=np.int64)[order], kinds[order], slots[order], members, rest, language,
                      int(n or 0), int(v), int(ends or 0))


class Tokens(NamedTuple):
    """The tokens of some texts, text after text, each with its end."""

    words: np.ndarray
    kind: np.ndarray
    known: np.ndarray
    slot: np.ndarray
    text: np.ndarray
    place: np.ndarray


class Reader:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.hasher = vocabulary, WordHasher()
        # where the hashes with the same first bits begin
        self.first = np.searchsorted(vocabulary.hashes >> np.uint64(64 - PREFIX_BITS), np.arange(1 << PREFIX_BITS, dtype=np.uint64))

    def _find(self, flat: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for words that it lacks."""
        hashes = self.vocabulary.hashes
        if not len(hashes):
            return np.full(len(flat), -1)
        last = len(hashes) - 1
        at = np.minimum(self.first[(flat >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)], last)
        left = np.flatnonzero(hashes[at] < flat)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            left = left[hashes[at[left]] < flat[left]]
        at = np.minimum(at, last)
        return np.where(hashes[at] == flat, at, -1)

    def read(self, texts) -> Tokens:
        """known: the place in the vocabulary, -1 for a rare word, -2 for the end."""
        flat, cut, code = self.hasher.many_with_codes(texts)
        v = self.vocabulary
        kind = v.language[code // LOOKS] * LOOKS + code % LOOKS
        known = self._find(flat)
        slot = np.where(known >= 0, v.slots[known], 0) if len(v.hashes) else np.zeros(len(flat), dtype=np.int64)
        ends = cut[1:]
        size = np.diff(cut) + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return Tokens(np.insert(flat, ends, END), np.insert(kind, ends, CLASSES), np.insert(known, ends, -2),
                      np.insert(slot, ends, 0), np.repeat(np.arange(len(size)), size), place)


class Model:
    """The weights of both softmaxes. Before training only the first row of
    each table, which every token has, is set: the model is then the count
    model, split by classes."""

    def __init__(self, known: Vocabulary) -> None:
        self.history = np.zeros((_HISTORY_ROWS, _OUT), dtype=np.float32)
        self.member = np.zeros((_MEMBER_ROWS * _OUT, SLOTS), dtype=np.float32)
        self.closed = np.where(np.arange(SLOTS)[None, :] > known.members[:, None], np.float32(-1e9), np.float32(0))
        mass = np.zeros((_OUT, SLOTS))
        mass[:, 0] = known.rest
        mass[known.kinds, known.slots] = np.where(known.slots > 0, known.counts + 1, mass[known.kinds, known.slots])
        mass[CLASSES, 0] = known.ends + 1
        self.history[0] = np.log(mass.sum(axis=1) / mass.sum())
        self.member[:_OUT] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum(axis=1, keepdims=True)), 0)

    @staticmethod
    def rows(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """By token, rows of the history table's parts (previous word, pair of
        words, kinds before at 1 and 2, at 3 and 4, and at 5) and of the member
        table's (previous word, kind before). Two kinds are one number."""

        def back(values: np.ndarray, d: int, before) -> np.ndarray:
            out = np.full(len(values), before, dtype=values.dtype)
            out[d:] = values[:-d]
            out[t.place < d] = before
            return out

        w1, w2 = back(t.words, 1, START), back(t.words, 2, START)
        k = {d: back(t.kind, d, _START) for d in (1, *SKIPS)}
        rows = [mix64(w1) % np.uint64(WORD_ROWS), mix64(w1 * np.uint64(3) + mix64(w2)) % np.uint64(PAIR_ROWS),
                k[1] * _KINDS + k[2], k[3] * _KINDS + k[4], k[5]]
        places = [(mix64(w1 + np.uint64(5)) % np.uint64(PLACE_ROWS)).astype(np.int64), k[1]]
        return np.array([r.astype(np.int64) for r in rows]), np.array([p * _OUT + t.kind for p in places])

    def parts(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The tables whose rows rows() gives: features that are the same for
        all tokens, for a class, or for one of two kinds are added up."""
        first, words, pairs, kinds, k2, k3, k4, k5 = np.split(self.history, _HISTORY_CUTS[:-1])
        of_class, place, kind = np.split(self.member.reshape(_MEMBER_ROWS, _OUT, SLOTS), [1, 1 + PLACE_ROWS])
        return ([words, pairs, kinds + np.tile(k2, (_KINDS, 1)) + first, np.repeat(k3, _KINDS, axis=0) + np.tile(k4, (_KINDS, 1)), k5],
                [place.reshape(-1, SLOTS), (kind + of_class + self.closed).reshape(-1, SLOTS)])

    def logits(self, rows: np.ndarray, places: np.ndarray, parts):
        """Of all classes and of all slots of the token's class, less the greatest."""
        for tables, index in zip(parts, (rows, places), strict=True):
            z = tables[0][index[0]]
            for table, r in zip(tables[1:], index[1:], strict=True):
                z += table[r]
            z -= z.max(axis=1, keepdims=True)
            yield z

    def shares(self, rows: np.ndarray, places: np.ndarray, kind: np.ndarray, parts=None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of all slots of the token's class."""
        out = []
        for z in self.logits(rows, places, parts or self.parts()):
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            out.append(z)
        return out[0], out[1]

    def gradient(self, t: Tokens, sums: list[np.ndarray]) -> None:
        """Add to ``sums``, for both tables, observed and expected counts."""
        every, places = self.rows(t)
        parts = self.parts()
        seen = [[np.bincount(r * p.shape[1] + target, minlength=p.size).reshape(p.shape).astype(float) for p, r in zip(tables, index, strict=True)]
                for tables, index, target in zip(parts, (every, places), (t.kind, t.slot), strict=True)]
        due = [[np.zeros(p.shape) for p in tables] for tables in parts]
        for a in range(0, len(t.words), TOKENS_AT_ONCE):
            b = slice(a, a + TOKENS_AT_ONCE)
            for share, tables, index in zip(self.shares(every[:, b], places[:, b], t.kind[b], parts), due, (every[:, b], places[:, b]), strict=True):
                for table, r in zip(tables, index, strict=True):
                    order = np.argsort(r.astype(np.uint16) if len(table) < 1 << 16 else r, kind="stable")
                    ordered = r[order]
                    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                    table[ordered[first]] += np.add.reduceat(share[order], first, axis=0)
        for (history, member), x, y in ((seen, 0, 2), (due, 1, 3)):
            words, pairs, k12, k34, k5 = history
            k12, k34 = k12.reshape(_KINDS, _KINDS, _OUT), k34.reshape(_KINDS, _KINDS, _OUT)
            sums[x] += np.concatenate([k5.sum(axis=0, keepdims=True), words, pairs, history[2], k12.sum(axis=0), k34.sum(axis=1), k34.sum(axis=0), k5])
            of_class = member[1].reshape(-1, _OUT, SLOTS).sum(axis=0)
            sums[y] += np.concatenate([of_class, *member])

    def step(self, sums: list[np.ndarray]) -> None:
        """One step up the gradient, observed less expected counts: each
        weight moves by the logarithm of their ratio, which for small
        differences is the gradient over its curvature and stays bounded for
        large ones. Every token adds up several features, so a step is a part
        of what each alone would need."""
        for table, seen, due in ((self.history, sums[0], sums[1]), (self.member, sums[2], sums[3])):
            table += STEP * np.log((np.maximum(seen, 0) + PRIOR) / (np.maximum(due, 0) + PRIOR))

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 of each token's class times slot probability."""
        out = np.empty(len(t.words))
        every, places = self.rows(t)
        parts = self.parts()
        for a in range(0, len(t.words), TOKENS_AT_ONCE):
            b = slice(a, a + TOKENS_AT_ONCE)
            n = np.arange(len(t.kind[b]))
            total = 0
            for z, chosen in zip(self.logits(every[:, b], places[:, b], parts), (t.kind[b], t.slot[b]), strict=True):
                own = z[n, chosen].astype(np.float64)
                np.exp(z, out=z)
                total = total + np.maximum(own - np.log(z.sum(axis=1)), LEAST_LOG)
            out[b] = total / np.log(10)
        return out


def _empty_sums() -> list[np.ndarray]:
    return [np.zeros(s) for s in ((_HISTORY_ROWS, _OUT), (_HISTORY_ROWS, _OUT), (_MEMBER_ROWS * _OUT, SLOTS), (_MEMBER_ROWS * _OUT, SLOTS))]


def _parts(pdf: pd.DataFrame):
    """Parts of a batch of about PART_CHARS characters of text, or one row."""
    texts = pdf["text"].fillna("")
    size = texts.str.len().to_numpy(dtype=np.int64)
    group = (np.cumsum(size) - size) // PART_CHARS
    for g in np.unique(group):
        yield pdf[group == g].assign(text=texts[group == g])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b, dtype=np.float32) for b in pdf["sums"]], axis=0, dtype=np.float64).astype(np.float32)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "sums": [total.tobytes()]})


def train(documents: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Learn from all training documents (doc_id, text), each in one round.
    Only sums of the weights' fixed size leave a task; they are added in two
    levels, by blocks, and the driver sees one set of sums a round."""
    model = Model(known)
    turn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(rounds))
    schema = "block int, salt int, sums binary"
    for r in range(rounds):
        now = model

        def per_batch(batches, now=now):
            reader, sums = Reader(known), _empty_sums()
            some = False
            for pdf in batches:
                for part in _parts(pdf):
                    now.gradient(reader.read(part["text"].tolist()), sums)
                    some = True
            if some:
                flat = np.concatenate([s.ravel() for s in sums]).astype(np.float32)
                salt = int(flat[:1000].astype(np.float64).sum()) % 64
                yield pd.DataFrame([(k, salt, p.tobytes()) for k, p in enumerate(np.array_split(flat, BLOCKS))], columns=["block", "salt", "sums"])

        parts = documents.where(turn == r).select("text").mapInPandas(per_batch, schema=schema)
        once = parts.groupBy("block", "salt").applyInPandas(_added, schema=schema)
        got = {x.block: np.frombuffer(x.sums, dtype=np.float32) for x in once.groupBy("block").applyInPandas(_added, schema=schema).collect()}
        if len(got) == BLOCKS:
            flat, sums = np.concatenate([got[k] for k in range(BLOCKS)]).astype(np.float64), _empty_sums()
            cuts = np.cumsum([s.size for s in sums])[:-1]
            model.step([p.reshape(s.shape) for p, s in zip(np.split(flat, cuts), sums, strict=True)])
    return model


def ngrams(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token with the one before it, and with the two before it
    (for those that are not the first of their text)."""
    before = np.concatenate([[START], t.words[:-1]])
    before[t.place == 0] = START
    pairs = mix64(mix64(before) * np.uint64(3) + t.words)
    later = np.flatnonzero(t.place > 0)
    return pairs, mix64(pairs[later - 1] * np.uint64(5) + t.words[later])


def smoothed(own: np.ndarray, t: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, ends: int) -> np.ndarray:
    """log10 of each token's probability: own (log10 of the model's), pulled to
    the shares among training pairs, and these to the shares among triples.
    words, pairs, triples: training counts of each token and of ngrams(t)."""
    before = np.concatenate([[0], words[:-1]])
    before[t.place == 0] = ends
    # counts of n-grams that share a key with others may be more than their history's
    p = (np.minimum(pairs, before) + PAIR_WEIGHT * 10.0**own) / (before + PAIR_WEIGHT)
    later = np.flatnonzero(t.place > 0)
    history = np.minimum(pairs, before)[later - 1]
    p[later] = (np.minimum(triples, history) + TRIPLE_WEIGHT * p[later]) / (history + TRIPLE_WEIGHT)
    return np.log10(p)


def _bucket_keys(t: Tokens, buckets: int) -> np.ndarray:
    """Keys of pairs and then triples: the bucket, and 32 bits of the hash."""
    h = np.concatenate(ngrams(t))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _word_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _packed(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones, so that high bytes, which
    are mostly zero, take little room once compressed."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _add_up(buckets: int):
    def per_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        key, count = (np.uint64, np.int64) if pdf["bucket"].iloc[0] >= buckets else (np.uint32, np.uint32)
        keys = [np.cumsum(_unpacked(b, key), dtype=key) for b in pdf["keys"]]
        times = np.concatenate([_unpacked(b, count) for b in pdf["times"]]).astype(np.int64)
        order, starts = _grouped(np.concatenate(keys))
        total = np.minimum(_sums(times[order], starts), np.iinfo(count).max).astype(count)
        found = np.empty(len(order), dtype=count)
        found[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
        cuts = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"],
                             "found": [_packed(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return per_bucket


def score(documents: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row of documents (doc_id, text), with the counts of all n-grams of
    those outside the held-out fold. Rows that agree in both are scored once
    and given back as often."""
    base = float(np.log10(known.tokens + known.distinct + 1))
    rest = np.log10(known.rest)
    end_count = known.ends
    chars, n_rows = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks, buckets = 1 + chars // BLOCK_CHARS + n_rows // BLOCK_ROWS, 1 + (chars + n_rows) // BUCKET_CHARS
    word_buckets = 1 + buckets // 4
    texts = (documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("string").alias("id"), "text")
             .repartition("block").groupBy("block", "id", "text").agg(F.count(F.lit(1)).alias("rows"))
             .select("block", "id", F.coalesce("text", F.lit("")).alias("text"), "rows", held_out("id").alias("held_out")))
    readers: list[Reader] = []

    def read(pdf: pd.DataFrame) -> Tokens:
        if not readers:
            readers.append(Reader(known))  # once a task
        return readers[0].read(pdf["text"].tolist())

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        t = read(pdf)
        weight = np.where(pdf["held_out"], 0, pdf["rows"])[t.text]
        out = []

        def send(keys, weights, at, first, dtype, count):
            order, starts = _grouped(keys)
            distinct, times = keys[order[starts]], _sums(weights[order], starts)
            cuts = np.flatnonzero(np.diff(at(distinct), prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((first + int(at(distinct[a : a + 1])[0]), int(pdf["block"].iloc[0]), _packed(np.diff(distinct[a:b].astype(dtype), prepend=dtype(0))),
                            _packed(np.minimum(times[a:b], np.iinfo(count).max).astype(count))))

        send(_bucket_keys(t, buckets), np.concatenate([weight, weight[t.place > 0]]),
             lambda k: (k >> np.uint64(32)).astype(np.int64), 0, np.uint32, np.uint32)
        rare = t.known == -1
        send(t.words[rare], weight[rare], lambda h: _word_buckets(h, word_buckets).astype(np.int64), buckets, np.uint64, np.int64)
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "times"])

    def per_scored(pdf: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        t = read(pdf)
        n = len(pdf)
        values = values.sort_values("bucket")

        def counts(some, keys, dtype):
            found = np.concatenate([np.empty(0, dtype=dtype), *[_unpacked(b, dtype) for b in some]]).astype(np.int64)
            order, starts = _grouped(keys)
            out = np.empty(len(keys), dtype=np.int64)
            out[order] = np.repeat(found, np.diff(np.append(starts, len(order))))
            return out

        c = np.where(t.known == -2, end_count, 0)
        own, rare = t.known >= 0, t.known == -1
        c[own] = known.counts[t.known[own]]
        c[rare] = counts(values["found"][values["bucket"] >= buckets], t.words[rare], np.int64)
        both = counts(values["found"][values["bucket"] < buckets], _bucket_keys(t, buckets), np.uint32)
        logc = np.log10(c + 1.0)
        ours = np.minimum(model.log10(t) + np.where((t.known == -2) | (t.slot > 0), 0.0, logc - rest[t.kind]), 0.0)
        ours = smoothed(ours, t, c, both[: len(c)], both[len(c) :], end_count)
        return pd.DataFrame({"id": pdf["id"], "rows": pdf["rows"], "held_out": pdf["held_out"], "n_tokens": np.bincount(t.text, minlength=n),
                             "n_known": np.bincount(t.text, weights=c > 0, minlength=n).astype(np.int64),
                             "base_score": np.bincount(t.text, weights=logc - base, minlength=n), "score": np.bincount(t.text, weights=ours, minlength=n)})

    keys = texts.groupBy("block").applyInPandas(per_block, schema="bucket long, block long, keys binary, times binary")
    values = keys.groupBy("bucket").applyInPandas(_add_up(buckets), schema="block long, bucket long, found binary")
    total = texts.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(
        per_scored, schema="id string, rows long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    each = total.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_copy"))
    return each.select(F.col("id").cast(documents.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known",
                       F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(documents: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Train on documents (doc_id, text, lang) outside the held-out fold,
    score all by their texts alone.

    Tokens are the lower-cased (A-Z) words and one end; a null text is empty
    and has the end alone. ``base_score`` is the add-one unigram score,
    ``score`` the model's log10 probability of the text, both in logarithms to
    base 10. Repeated rows each count and each give a row; other columns are
    ignored; an empty table gives an empty result.
    """
    docs = documents.select("doc_id", "text", "lang")
    taught = docs.where(~held_out("doc_id"))
    known = vocabulary(materialize(word_counts(taught)), frequent)
    return score(docs, known, train(taught, known, rounds))


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of all whole texts of ``documents``."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
