"""Token counts of whole texts under a byte-level BPE vocabulary file.

Texts are cut into pre-tokens, the distinct pre-tokens of a batch are held as
one ragged numpy array of symbols, and in each round every sequence applies
its lowest-rank pair at the same time until none is left; what survives is
counted.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.iinfo(np.int32).max
MEMO_WORDS = 400_000
BATCH_CHARS = 4_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: the
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    keep = set(own)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merge ranks as sorted arrays, looked up for many pairs at once."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("normalizers, prefix spaces and ignore_merges are not supported")
        vocab = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # the earliest rank that uses a symbol: a product used at an earlier rank must be merged one at a time
        used = np.full(int(max(left.max(), right.max(), self.product.max())) + 1, NONE, dtype=np.int64)
        np.minimum.at(used, left, np.arange(len(pairs)))
        np.minimum.at(used, right, np.arange(len(pairs)))
        self.one_at_a_time = used[self.product] < np.arange(len(pairs))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
            raise ValueError("added tokens that strip or need word borders are not supported")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def count_symbols(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols that are left of each piece (none empty) when no pair of it has
    a rank any more."""
    out = np.zeros(len(pieces), dtype=np.int64)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    which = np.arange(len(pieces))
    symbol = table.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    rank = np.full(len(symbol), NONE, dtype=np.int32)
    if len(symbol) > 1:
        rank[:-1] = table.rank(symbol[:-1], symbol[1:])
    while len(which):
        end = np.cumsum(size)
        start = end - size
        rank[end - 1] = NONE
        lowest = np.minimum.reduceat(rank, start)
        done = lowest == NONE
        if done.any():
            out[which[done]] = size[done]
            keep = np.repeat(~done, size)
            which, size, lowest = which[~done], size[~done], lowest[~done]
            symbol, rank = symbol[keep], rank[keep]
            if not len(which):
                break
            end = np.cumsum(size)
            start = end - size
        hit = np.flatnonzero(rank == np.repeat(lowest, size))
        owner = np.searchsorted(end, hit, side="right")
        # overlapping pairs of one symbol are taken from the left, every second one
        fresh = np.concatenate([[True], np.diff(hit) != 1])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        take = (np.arange(len(hit)) - run) % 2 == 0
        again = np.concatenate([[False], owner[1:] == owner[:-1]])
        take &= ~(again & table.one_at_a_time[lowest[owner]])
        hit, owner = hit[take], owner[take]
        symbol[hit] = table.product[lowest[owner]]
        stay = np.ones(len(symbol), dtype=bool)
        stay[hit + 1] = False
        at = (np.cumsum(stay) - 1)[hit]
        symbol, rank = symbol[stay], rank[stay]
        size = size - np.bincount(owner, minlength=len(size))
        touched = np.concatenate([at, at[at > 0] - 1])
        touched = touched[touched + 1 < len(symbol)]
        rank[at] = NONE
        rank[touched] = table.rank(symbol[touched], symbol[touched + 1])
    return out


def class_of_code_points() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 other."""
    import regex

    out = np.full(0x110000 + 1, 3, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            if lo < 0xD800 and hi > 0xDFFF:
                raise ValueError("a class spans the surrogates")
            out[lo : hi + 1] = kind
    return out


END = 4
CONTRACTIONS = {2: ("s", "t", "m", "d"), 3: ("re", "ve", "ll")}


def cut_texts(texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pre-tokens (PRE_TOKEN) of all texts, text after text, and how many
    each text has. A NUL after each text, of a class of its own, ends it."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer((joined + "\0\0\0").encode("utf-32-le"), dtype=np.uint32)
    kind = classes[code]
    n = len(joined)
    last = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[last] = END
    kind[n:] = END
    start = np.zeros(n + 4, dtype=bool)
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:n], kind[: n - 1], out=begins[1:])
    white = kind == 0
    spaced = np.zeros(n, dtype=bool)
    spaced[1:] = code[: n - 1] == 32
    # a run opens a token, but a single space before it belongs to it
    start[:n] = begins & (white[:n] | ~spaced | (kind[:n] == END))
    # the last of white characters before a word stands alone or with the word
    start[:n] |= white[:n] & ~white[1 : n + 1] & (kind[1 : n + 1] != END)
    start[last] = True
    mark = np.flatnonzero((code[:n] == 39) & begins & ~spaced & (kind[:n] != END))
    if len(mark):
        one, two = code[mark + 1], code[mark + 2]
        short = np.isin(one, [ord(c) for c in CONTRACTIONS[2]]) & (kind[mark + 1] == 1)
        long = np.zeros(len(mark), dtype=bool)
        for c in CONTRACTIONS[3]:
            long |= (one == ord(c[0])) & (two == ord(c[1])) & (kind[mark + 2] == 1)
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    at = np.flatnonzero(start[:n])
    stop = np.append(at[1:], n)
    real = kind[at] != END
    counts = np.diff(np.searchsorted(at[real], last), prepend=0)
    return [joined[a:b] for a, b in zip(at[real].tolist(), stop[real].tolist(), strict=True)], counts


def token_counter(path: str):
    """A function from a list of texts to their token counts."""
    import regex

    with open(path, encoding="utf-8") as f:
        table = MergeTable(json.load(f))
    classes = class_of_code_points()
    special = None
    if table.added:
        special = regex.compile("|".join(regex.escape(t) for t in sorted(table.added, key=len, reverse=True)))
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> np.ndarray:
        parts, owner = texts, np.arange(len(texts))
        if special is not None and any(t in x for x in texts for t in table.added):
            split = [special.split(t) for t in texts]
            parts = [p for ps in split for p in ps]
            owner = np.repeat(owner, [len(ps) for ps in split])
        words, n_words = cut_texts(parts, classes)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = [w for w in set(words) if w not in memo]
        if new:
            memo.update(zip(new, count_symbols([w.encode("utf-8") for w in new], table).tolist(), strict=True))
        each = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n_words)])]
        total = np.bincount(owner, weights=np.diff(upto), minlength=len(texts)).astype(np.int64)
        return total + np.bincount(owner, minlength=len(texts)) - 1

    return count


def count_tokens(documents: DataFrame, vocabulary_path: str, text: str = "text",
                 limit: int = 1024, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keys``, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No begin, end or added special tokens are counted on top of the text; the
    string of an added token inside a text counts as one token. A null or
    empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows
    stay, an empty table gives an empty result, further columns are ignored
    whatever their names. ``vocabulary_path`` must name a file that every
    executor can read. Nothing is shuffled; a task holds one Arrow batch and
    works on at most BATCH_CHARS characters (or one text) of it at a time.
    """
    rows = documents.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = list(keys)

    def per_batch(batches):
        count = token_counter(vocabulary_path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["_text"]]
            sizes, counts, at = [len(t.encode("utf-8")) for t in texts], [], 0
            while at < len(texts):
                stop, room = at + 1, len(texts[at])
                while stop < len(texts) and room + len(texts[stop]) <= BATCH_CHARS:
                    room += len(texts[stop])
                    stop += 1
                counts += count(texts[at:stop]).tolist()
                at = stop
            out = pdf[names].copy()
            out["n_bytes"] = np.array(sizes, dtype=np.int64)
            out["n_tokens"] = np.array(counts, dtype=np.int64)
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    return rows.mapInPandas(per_batch, schema=f"{fields}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of every whole text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
