"""Near-duplicate lines across documents, by deletion neighbourhoods.

Two lines are near duplicates if one word put in, taken out or exchanged makes
them equal. A line and all its variants with one word left out are hashed;
lines that meet in a variant are within the bound:

- the same word position left out of both, with equal rests: one exchange;
- one line equals the other with a word left out: one word put in.

Every line looks up the earliest line that it meets, the two are compared
word by word, and the later one goes. So a line stays if and only if no
earlier line equals it or lies within the bound.

Only lines that can have a partner emit variants: the one differing word lies
in the first or the second half, so partners agree in the other half.

Words are runs of anything but white space; each character of a script that is
written without spaces is a word of its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.textarrays import WordHasher, mix64, powers
from retail_insight.session import materialize

MIN_WORDS = 1
NEAR_WORDS = 8
PART_CHARS = 2_000_000
# a line that is more than 1/HOT_PART of all lines is hot: there are fewer than HOT_PART such lines
HOT_PART = 1000
# Thai, Lao, Myanmar, Khmer, kana, Han
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_STEP = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_STEP, -1, 1 << 64)


def spaced(line: str) -> str:
    """The line with spaces around the characters that are words by themselves."""
    if line.isascii():
        return line
    try:
        line.encode("latin-1")  # all such characters are beyond this set
        return line
    except UnicodeEncodeError:
        return _UNSPACED.sub(r" \1 ", line)


def _salted(x: np.ndarray, *parts) -> np.ndarray:
    for p in parts:
        x = mix64(x + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(p).astype(np.uint64) + np.uint64(1)))
    return x


class LineKeys:
    """Keys of all lines of a batch of texts at once, from running sums over
    the batch's word hashes: any range of words has its hash from two sums."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.down = powers(_INVERSE, 1)
        self.up = powers(_STEP, 1)

    def read(self, lines: list[str]) -> None:
        self.words, self.cut = self.hasher.many([spaced(x) for x in lines])
        n = len(self.words) + 2
        if n > len(self.up):
            self.up, self.down = powers(_STEP, n), powers(_INVERSE, n)
        self.total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.words * self.up[: n - 2], dtype=np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.down[a]

    def whole(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the content of lines k."""
        a, b = self.cut[k], self.cut[k + 1]
        again = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(self.words + np.uint64(7)) * self.up[: len(self.words)], dtype=np.uint64)])
        return _salted(self.hash(a, b), b - a, 1), _salted((again[b] - again[a]) * self.down[a], b - a, 2)

    def halves(self, k: np.ndarray) -> list[np.ndarray]:
        """Keys of the first and second half, once as the shorter or equal
        line (m = n words) and once as the longer one (m = n - 1)."""
        a, b = self.cut[k], self.cut[k + 1]
        keys = []
        for m in (b - a, b - a - 1):
            half = m // 2
            keys.append(_salted(self.hash(a, a + half), m, 11))
            keys.append(_salted(self.hash(b - (m - half), b), m, 12))
        return keys

    def variants(self, k: int, live: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and roles (0 exchange, 1 word left out, 2 the line itself) of
        line k for the positions that the live halves (bits in the order of
        halves()) leave open."""
        a, b = int(self.cut[k]), int(self.cut[k + 1])
        n, at = b - a, np.arange(b - a)
        total = self.total[a : b + 1]
        # the rest without word i: words before it, then the words after it moved one place down
        rest = (total[:-1] - total[0] + (total[-1] - total[1:]) * np.uint64(_INVERSE)) * self.down[a]
        half, short = n // 2, (n - 1) // 2
        same = (bool(live & 1) & (at >= half)) | (bool(live & 2) & (at < half))
        longer = (bool(live & 4) & (at >= short)) | (bool(live & 8) & (at <= short))
        keys = [_salted(rest[same], n, at[same], 21), np.unique(_salted(rest[longer], n - 1, 22))]
        roles = [np.zeros(len(keys[0]), dtype=np.int8), np.ones(len(keys[1]), dtype=np.int8)]
        if live & 3:
            keys.append(_salted(self.hash(np.array([a]), np.array([b])), n, 22))
            roles.append(np.full(1, 2, dtype=np.int8))
        return np.concatenate(keys), np.concatenate(roles)


def _settled(df: DataFrame) -> DataFrame:
    """materialize(), after which the shuffle files that made it go at once
    instead of when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialize(df.select("*"))
    finally:
        conf.set(name, before)


def _line_table(docs: DataFrame, least: int, near: int) -> DataFrame:
    """One row per line of at least ``least`` words: h1, h2, doc, line, crc,
    and the keys p0 to p3 of halves() for lines of at least ``near`` words."""

    def per_batch(batches):
        keys = LineKeys()
        for pdf in batches:
            for part in _parts(pdf):
                split = [t.split("\n") for t in part["text"]]
                lines = [x for ls in split for x in ls]
                count = np.array([len(ls) for ls in split], dtype=np.int64)
                keys.read(lines)
                size = np.diff(keys.cut)
                k = np.flatnonzero(size >= least)
                number = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
                h1, h2 = keys.whole(k)
                table = {"h1": h1.view(np.int64), "h2": h2.view(np.int64), "doc": np.repeat(part["doc"].to_numpy(), count)[k],
                         "line": number[k].astype(np.int32), "crc": np.array([zlib.crc32(lines[i].encode("utf-8")) for i in k.tolist()], dtype=np.int64)}
                short = size[k] < near
                for j, v in enumerate(keys.halves(k)):
                    table[f"p{j}"] = pd.arrays.IntegerArray(v.view(np.int64), short)
                yield pd.DataFrame(table)

    return docs.mapInPandas(per_batch, schema="h1 long, h2 long, doc long, line int, crc long, p0 long, p1 long, p2 long, p3 long")


def _parts(pdf: pd.DataFrame):
    """Parts of a batch of about PART_CHARS characters of text, or one row."""
    size = pdf["text"].str.len().to_numpy(dtype=np.int64)
    group = (np.cumsum(size) - size) // PART_CHARS
    for g in np.unique(group):
        yield pdf[group == g]


def _live_lines(docs: DataFrame, live: DataFrame) -> DataFrame:
    """doc, line, crc, bits, text of the lines that ``live`` (doc, live: array
    of (line, crc, bits)) names. The texts are packed for their shuffle."""

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: zlib.compress(t.encode("utf-8"), 1))

    def per_batch(batches):
        for pdf in batches:
            rows = []
            for d, z, named in zip(pdf["doc"], pdf["z"], pdf["live"], strict=True):
                lines = zlib.decompress(z).decode("utf-8").split("\n")
                for r in named:
                    k = r["line"]
                    if k < len(lines) and zlib.crc32(lines[k].encode("utf-8")) == r["crc"]:
                        rows.append((d, k, r["crc"], r["bits"], lines[k]))
            yield pd.DataFrame(rows, columns=["doc", "line", "crc", "bits", "text"])

    return (docs.select("doc", packed("text").alias("z")).join(live, "doc")
            .mapInPandas(per_batch, schema="doc long, line int, crc long, bits int, text string"))


def _variant_table(live: DataFrame) -> DataFrame:
    """key, role, doc, line, crc of the live lines (doc, line, crc, bits, text)."""

    def per_batch(batches):
        keys = LineKeys()
        for pdf in batches:
            for part in _parts(pdf):
                keys.read(part["text"].tolist())
                made = [keys.variants(k, bits) for k, bits in enumerate(part["bits"].tolist())]
                size = [len(key) for key, _ in made]
                yield pd.DataFrame({"key": np.concatenate([key for key, _ in made]).view(np.int64),
                                    "role": np.concatenate([role for _, role in made])}
                                   | {c: np.repeat(part[c].to_numpy(), size) for c in ("doc", "line", "crc")})

    return live.mapInPandas(per_batch, schema="key long, role byte, doc long, line int, crc long")


def one_edit(a: list, b: list) -> bool:
    """Whether at most one word put in, taken out or exchanged makes a and b equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _near(a: str, b: str):
    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one_edit(spaced(v).encode().lower().split(), spaced(w).encode().lower().split())
                          for v, w in zip(x, y, strict=True)], dtype=bool)

    return near(a, b)


def _without(text, gone):
    """text, n_exact, n_near: each text without the lines (line, crc, near)
    that ``gone`` names, in time linear in both. A null text stays null."""

    @F.pandas_udf("text string, n_exact long, n_near long")
    def without(texts: pd.Series, named: pd.Series) -> pd.DataFrame:
        rows = []
        for t, rs in zip(texts, named, strict=True):
            if t is None:
                rows.append((None, 0, 0))
                continue
            out = {(r["line"], r["crc"]): r["near"] for r in rs}
            left, lost = [], [0, 0]
            for k, x in enumerate(t.split("\n")):
                near = out.get((k, zlib.crc32(x.encode("utf-8"))))
                if near is None:
                    left.append(x)
                else:
                    lost[near] += 1
            rows.append(("\n".join(left), *lost))
        return pd.DataFrame(rows, columns=["text", "n_exact", "n_near"])

    return without(text, gone)


def _later_lines(documents: DataFrame, least: int, near: int) -> DataFrame:
    """duplicate_lines(), a line once for each row that repeats its document.

    Equal lines meet in a join by content; a line that is more than 1/HOT_PART
    of all lines meets its earliest copy in a broadcast of fewer than HOT_PART
    rows instead, so no task gathers its copies.
    """
    docs = documents.select(F.col("doc_id").alias("doc"), "text").where("doc is not null and text is not null")
    lines = materialize(_line_table(docs, least, near))
    place = F.struct("doc", "line", "crc")
    keys = [F.first(f"p{j}").alias(f"p{j}") for j in range(4)]
    distinct = _settled(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *keys))
    often = F.col("n") * HOT_PART > lines.count()
    hot, repeated = (distinct.where(c).select("h1", "h2", "first") for c in (often, (F.col("n") > 1) & ~often))
    places = lines.select("h1", "h2", "doc", "line", "crc")
    exact = (places.join(F.broadcast(hot.drop("first")), ["h1", "h2"], "left_anti").join(repeated, ["h1", "h2"])
             .unionByName(places.join(F.broadcast(hot), ["h1", "h2"]))
             .where(place != F.col("first")).select("doc", "line", "crc", F.lit(False).alias("near")))
    halves = distinct.where("p0 is not null").select("h1", "first", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("side", "half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half")
    live = (halves.join(shared, "half").groupBy("first")
            .agg(F.sum(F.expr("shiftleft(1, side)")).cast("int").alias("bits"))
            .groupBy(F.col("first.doc").alias("doc"))
            .agg(F.collect_list(F.struct("first.line", "first.crc", "bits")).alias("live")))
    live_lines = _settled(_live_lines(docs, live))
    variants = _variant_table(live_lines)
    met = (variants.groupBy("key").agg(F.min(F.when(F.col("role") < 2, place)).alias("other"),
                                       F.min(F.when(F.col("role") == 2, place)).alias("own"),
                                       F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # a line with a word left out meets the line that it then equals; all else meets the earliest of its key
    to = F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("other"))
    linked = (variants.join(met, "key").select("doc", "line", "crc", to.alias("to"))
              .where(F.col("to") < place).groupBy("doc", "line", "crc").agg(F.min("to").alias("early")))
    texts = live_lines.select(place.alias("place"), "text")
    both = (linked.select(place.alias("late"), "early")
            .join(texts.select(F.col("place").alias("late"), F.col("text").alias("a")), "late")
            .join(texts.select(F.col("place").alias("early"), F.col("text").alias("b")), "early"))
    verified = both.where(_near("a", "b")).select("late.doc", "late.line", "late.crc", F.lit(True).alias("near"))
    return exact.unionByName(verified)


def duplicate_lines(documents: DataFrame, least: int = MIN_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """doc, line, crc, near: the lines of documents (doc_id, text) that an
    earlier line equals (near = false) or lies within the bound of (true).

    Earlier means less by (doc_id, line number). Only lines of at least
    ``least`` words count, and near ones of at least ``near`` words, so that
    one word is a small part of a line. A-Z are alike in either case.
    """
    return _later_lines(documents, least, near).distinct()


def dedup_lines(documents: DataFrame, least: int = MIN_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """documents with ``text`` without its duplicate lines, and n_lines,
    n_exact, n_near: how many lines it had, and lost as equal or near ones.

    A line goes if and only if an earlier one, by (doc_id, line number), in
    this or another document equals it or lies within the bound (see
    duplicate_lines). Null texts and rows without doc_id stay as they are;
    lines without a word stay, and so do lines of fewer than ``least`` words. Rows that repeat a doc_id and text are
    one document: they keep the same lines. Any line length and any number of
    copies will do. An empty table gives an empty result. Columns of the
    names n_lines, n_exact and n_near are replaced, all others kept.
    """
    found = (_later_lines(documents, least, near).groupBy(F.col("doc").alias("id"))
             .agg(F.collect_set(F.struct("line", "crc", "near")).alias("gone")))
    kept = [c for c in documents.columns if c not in ("n_lines", "n_exact", "n_near")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    old = F.col("row.text")
    seen = rows.join(found, F.col("row.doc_id") == F.col("id"), "left").select("row", "gone")
    # only texts that lose lines are handed to Python
    done = seen.select("row", _without(F.when(F.col("gone").isNotNull(), old), F.col("gone")).alias("left"))
    return done.select(
        *[F.coalesce("left.text", old).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept],
        F.when(old.isNull(), F.lit(0)).otherwise(F.size(F.split(old, "\n"))).cast("long").alias("n_lines"),
        F.col("left.n_exact").alias("n_exact"), F.col("left.n_near").alias("n_near"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without its near-duplicate lines."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
