"""Quality of documents by co-training two classifiers.

The text view reads a document's words and marks, the metadata view its
source, language, length and layout. Both start from the labelled documents.
In each round each view labels the unlabelled documents that it is sure of,
and the other view is fitted on them too, as long as it does not itself lean
the other way. At the end each view's scores are calibrated on labelled
documents that no fit has seen, and the calibrated scores are combined to
score every document.

A fit is a logistic regression over all rows of the view, in Spark: counts of
each feature by class decide which features tell good from bad, then tasks
fit their own rows, in blocks of a bounded number of features, by gradient
steps from common weights and the results are averaged, some times over. Each distinct document counts once, however many
copies there are, and all pseudo-labels of a class together at most as much as
PSEUDO_SHARE of its labels. Only the telling features' weights reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.textarrays import WordHasher, mix64
from retail_insight.session import materialize

#: Labelled documents that the scores are calibrated on, at most.
CALIBRATION_ROWS = 20_000
CALIBRATION_SHARE = 5
ROUNDS = 2
SURE = 0.95
PSEUDO_SHARE = 0.1
KEEP = 0.5
#: A feature is fitted if so many training rows have it and its counts by
#: class differ so much (likelihood ratio, a chi-square of one degree) that
#: about so many of all features would by chance.
LEAST_ROWS = 2
BY_CHANCE = 10
#: How often the tasks' weights are averaged, and the steps between.
AVERAGES = 3
STEPS = 80
SUMS = 16
TEXT_BITS = 20
META_BITS = 12
DIMS = (1 << TEXT_BITS, 1 << META_BITS)
PART_CHARS = 1_000_000
PACKED_BYTES = 1_000_000
#: Features that a task fits at a time; a larger task fits several such blocks.
FIT_FEATURES = 2_000_000

_WORD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MARK = bytes(32 if chr(c).isalnum() or c >= 128 else c for c in range(256))


class Features:
    """Sparse 0/1 features of both views: positions, and where each row begins."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def text(self, texts) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.lower().encode("utf-8") for t in texts]
        words, w = self._hash([r.translate(_WORD) for r in raw])
        marks, m = self._hash([r.translate(_MARK) for r in raw])
        limit = np.uint64((1 << TEXT_BITS) - 1)
        found = [np.unique(np.concatenate([words[w[i] : w[i + 1]], mix64(marks[m[i] : m[i + 1]])]) & limit) for i in range(len(raw))]
        return _joined(found)

    def _hash(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = [self.hasher.one(p) for p in parts]
        return (np.concatenate(flat) if flat else np.empty(0, np.uint64)), np.cumsum([0, *map(len, flat)])

    def meta(self, texts, sources, langs) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for t, s, g in zip(texts, sources, langs, strict=True):
            raw = np.frombuffer(t.encode("utf-8"), dtype=np.uint8)
            n = max(len(raw), 1)
            spaces, breaks = int(np.count_nonzero(raw == 32)), int(np.count_nonzero(raw == 10))
            shares = (np.count_nonzero((raw >= 65) & (raw <= 90)), np.count_nonzero((raw >= 48) & (raw <= 57)),
                      np.count_nonzero(((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 128))),
                      spaces + breaks)
            words = t.split()
            distinct = len(set(words)) / max(len(words), 1)
            sizes = (len(raw), spaces + 1, breaks + 1, len(raw) // (breaks + 1))
            named = [f"source {s}", f"lang {g}", f"source {s} lang {g}"]
            named += [f"size {k} {int(2 * np.log2(v + 1))}" for k, v in enumerate(sizes)]
            named += [f"share {k} {int(np.sqrt(v / n) * 20)}" for k, v in enumerate(shares)]
            named.append(f"distinct {int(distinct * 20)}")
            h = self.hasher.one("\n".join(x.replace(" ", "_") for x in named).encode("utf-8"))
            found.append(np.unique(h & np.uint64((1 << META_BITS) - 1)))
        return _joined(found)


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)), np.cumsum([0, *map(len, found)])


class Model:
    """Weights of a view's telling features."""

    def __init__(self, dims: int, at: np.ndarray, weight: np.ndarray, bias: float) -> None:
        self.dims, self.at, self.weight, self.bias, self.dense = dims, at, weight, bias, None

    def __getstate__(self):
        return {**self.__dict__, "dense": None}

    def logits(self, flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(self.dims)
            self.dense[self.at] = self.weight
        run = np.concatenate([[0.0], np.cumsum(self.dense[flat])])
        return np.clip(run[cut[1:]] - run[cut[:-1]] + self.bias, -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(at: np.ndarray, cut: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float, steps: int,
        rate: float = 0.1, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weighted logistic regression of y on 0/1 features by full-batch steps
    with a step size of its own for each weight (Adam), so that rare words are
    learnt too, from the weights w and the bias b on."""
    size, n, total = np.diff(cut), len(w), max(weight.sum(), 1e-9)
    w = w.copy()
    first, second, fb, sb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        run = np.concatenate([[0.0], np.cumsum(w[at])])
        error = (_sigmoid(run[cut[1:]] - run[cut[:-1]] + b) - y) * weight / total
        g = np.bincount(at, weights=np.repeat(error, size), minlength=n) + decay * w / total
        gb = float(error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        fb, sb = 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (first / a) / (np.sqrt(second / c) + 1e-8)
        b -= rate * (fb / a) / (np.sqrt(sb / c) + 1e-8)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights (bias first) of a logistic regression of y on the columns of z,
    by Newton steps with a mild pull to 0."""
    x = np.column_stack([np.ones(len(z)), z])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta)), g)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Scorer:
    """Both views' fitted models and their calibrated combination."""

    def __init__(self, text: Model, meta: Model, text_scale, meta_scale, combine, prior: float = 0.0) -> None:
        self.models, self.scales, self.combine, self.prior = (text, meta), (text_scale, meta_scale), combine, prior

    def views(self, found) -> list[np.ndarray]:
        """Calibrated log odds of good by each view; found: its features."""
        return [s[0] + s[1] * m.logits(*f) for m, s, f in zip(self.models, self.scales, found, strict=True)]

    def __call__(self, features: Features, texts, sources, langs) -> np.ndarray:
        """Columns: probability of good by text, by metadata, by both."""
        z = self.views((features.text(texts), features.meta(texts, sources, langs)))
        return _sigmoid(np.column_stack([*z, self.combine[0] + self.combine[1] * z[0] + self.combine[2] * z[1]]))


def scores(scorer: Scorer):
    """A column of struct(p_text, p_meta, p_good) from text, source and lang."""

    @F.pandas_udf("p_text double, p_meta double, p_good double")
    def of(text: pd.Series, source: pd.Series, lang: pd.Series) -> pd.DataFrame:
        features = Features()
        texts = [t if isinstance(t, str) else "" for t in text]
        out, at = [np.empty((0, 3))], 0
        while at < len(texts):
            stop, room = at + 1, len(texts[at])
            while stop < len(texts) and room + len(texts[stop]) <= PART_CHARS:
                room += len(texts[stop])
                stop += 1
            out.append(scorer(features, texts[at:stop], source[at:stop], lang[at:stop]))
            at = stop
        return pd.DataFrame(np.concatenate(out), columns=["p_text", "p_meta", "p_good"])

    return of("text", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def _hashed(documents: DataFrame) -> DataFrame:
    """id, two hashes h and g of (text, source, lang),
    and these, null as empty."""
    key = [F.coalesce(c, F.lit("")) for c in ("text", "source", "lang")]
    return documents.select(F.col("doc_id").alias("id"), *[k.alias(n) for k, n in zip(key, ("text", "source", "lang"), strict=True)],
                            F.xxhash64(*key).alias("h"), F.xxhash64(F.lit(7), *key).alias("g"))


def known_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each distinct (text, source, lang): two hashes h and g, the
    label y (null if none), and the features a and b of both views (bytes)."""
    rows = _hashed(documents)
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)).alias("y"))
    marked = rows.select("id", "h", "g").join(marks, "id").groupBy("h", "g").agg(F.min("y").alias("y"))

    def per_batch(batches):
        f = Features()
        for pdf in batches:
            for part in _parts(pdf):
                texts = part["text"].tolist()
                (a, ac), (b, bc) = f.text(texts), f.meta(texts, part["source"], part["lang"])
                yield pd.DataFrame({"h": part["h"], "g": part["g"], "a": _packed(a, ac), "b": _packed(b, bc)})

    found = rows.select("h", "g", "text", "source", "lang").mapInPandas(per_batch, schema="h long, g long, a binary, b binary")
    # copies meet as partial aggregates, so a text that a third of the rows share is one row for each task
    distinct = found.groupBy("h", "g").agg(F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    return materialize(distinct.join(marked, ["h", "g"], "left"))


def _parts(pdf: pd.DataFrame):
    size = pdf["text"].str.len().to_numpy(dtype=np.int64)
    group = (np.cumsum(size) - size) // PART_CHARS
    for g in np.unique(group):
        yield pdf[group == g]


def _slices(batches, *columns):
    """The rows of the batches in slices of about PACKED_BYTES of packed
    features (or one row), so that unpacked ones stay few."""
    for pdf in batches:
        size = sum((pdf[c].str.len().to_numpy(dtype=np.int64) for c in columns), np.zeros(len(pdf), dtype=np.int64))
        group = (np.cumsum(size) - size) // PACKED_BYTES
        for g in np.unique(group):
            yield pdf[group == g]


def _packed(flat: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Each row's sorted features as the steps between them, compressed."""
    return [zlib.compress(np.diff(flat[i:j], prepend=0).astype(np.int32).tobytes(), 1) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    raw = [zlib.decompress(v) for v in column]
    cut = np.cumsum([0, *(len(r) // 4 for r in raw)])
    run = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(raw), dtype=np.int32), dtype=np.int64)])
    return run[1:] - np.repeat(run[cut[:-1]], np.diff(cut)), cut


class _Exchange:
    """Which rows each view learns from: labelled ones, and those that the
    other view is sure of and it does not itself lean against."""

    def __init__(self, scorer: Scorer | None, sure: float) -> None:
        self.scorer, self.sure = scorer, sure

    def rows(self, pdf: pd.DataFrame):
        """For each view the places of its rows in pdf, their y, whether that
        is a pseudo-label, whether they are kept for calibration, and their
        features (flat, and where each row's begin)."""
        label = pdf["y"].to_numpy(dtype=float)
        found = [_unpacked(pdf[c]) for c in ("a", "b")]
        z = self.scorer.views(found) if self.scorer else None
        for view, (flat, cut) in enumerate(found):
            y, pseudo = label, np.zeros(len(label), dtype=bool)
            if z:
                giver, own, border = z[1 - view], z[view], np.log(self.sure / (1 - self.sure))
                prior = self.scorer.prior   # a view leans one way if it moves a document off the common odds
                good, bad = (giver >= border) & (own >= prior), (giver <= -border) & (own <= prior)
                pseudo = np.isnan(label) & (good | bad)
                y = np.where(pseudo, good, label)
            which = np.flatnonzero(~np.isnan(y))
            size = np.diff(cut)[which]
            place = np.arange(size.sum()) + np.repeat(cut[which] - (np.cumsum(size) - size), size)
            held = held_out(pdf) & ~np.isnan(label)
            yield view, which, y[which], pseudo[which], held[which], flat[place], np.concatenate([[0], np.cumsum(size)])


def held_out(pdf: pd.DataFrame) -> np.ndarray:
    return mix64(pdf["h"].to_numpy().view(np.uint64) + np.uint64(17)) % np.uint64(CALIBRATION_SHARE) == 0


def _telling(table: DataFrame, exchange: _Exchange) -> list:
    """For each view: its telling features (those whose counts differ by class
    beyond chance), the weights of bad and good pseudo-labels, their numbers."""

    def count(batches):
        total = [np.zeros((4, d + 1)) for d in DIMS]     # labelled bad and good, pseudo-labelled bad and good; last: rows
        for pdf in _slices(batches, "a", "b"):
            for view, _, y, pseudo, held, flat, cut in exchange.rows(pdf):
                kind = np.where(held, -1, 2 * pseudo + y).astype(np.int64)
                of = np.repeat(kind, np.diff(cut))
                for k in range(4):
                    total[view][k, -1] += np.count_nonzero(kind == k)
                    total[view][k, :-1] += np.bincount(flat[of == k], minlength=DIMS[view])
        for view, t in enumerate(total):
            at = np.flatnonzero(t.any(axis=0))
            yield pd.DataFrame({"view": np.full(len(at), view), "at": at} | {f"n{k}": t[k, at] for k in range(4)})

    n = [F.col(f"n{k}") for k in range(4)]
    counts = materialize(table.mapInPandas(count, schema="view int, at int, n0 double, n1 double, n2 double, n3 double")
                         .groupBy("view", "at").agg(*[F.sum(c).alias(f"n{k}") for k, c in enumerate(n)]))
    rows = F.col("at") == F.when(F.col("view") == 0, DIMS[0]).otherwise(DIMS[1])
    sums = {r["view"]: r for r in counts.groupBy("view").agg(*[F.max(F.when(rows, c)).alias(f"n{k}") for k, c in enumerate(n)],
                                                             F.count_if(~rows & (n[0] + n[1] + n[2] + n[3] >= LEAST_ROWS)).alias("many")).collect()}
    out = []
    for view, dims in enumerate(DIMS):
        row = sums.get(view)
        if row is None or row["n0"] is None:
            out.append((np.empty(0, dtype=np.int64), (0.0, 0.0), (0, 0)))
            continue
        weight = tuple(min(1.0, PSEUDO_SHARE * max(row[f"n{k}"], 1.0) / row[f"n{k + 2}"]) if row[f"n{k + 2}"] else 0.0 for k in (0, 1))
        size = [row[f"n{k}"] + weight[k] * row[f"n{k + 2}"] for k in (0, 1)]
        have = [n[k] + F.lit(weight[k]) * n[k + 2] for k in (0, 1)]
        every, both = max(sum(size), 1e-9), have[0] + have[1]

        def part(seen, expected):
            return F.when((seen > 1e-9) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)

        ratio = sum((part(have[k], both * (size[k] / every)) + part(F.lit(size[k]) - have[k], (F.lit(every) - both) * (size[k] / every))
                     for k in (0, 1)), F.lit(0.0))
        least = max(float(np.log(row["many"] / BY_CHANCE)) if row["many"] else 0.0, 4.0)
        chosen = counts.where((F.col("view") == view) & (F.col("at") < dims) & (both >= LEAST_ROWS) & (ratio >= least)).select("at").toPandas()
        out.append((np.sort(chosen["at"].to_numpy(dtype=np.int64)), weight, (int(row["n2"]), int(row["n3"]))))
    return out


def _fitted(table: DataFrame, exchange: _Exchange) -> tuple[Scorer, list]:
    """Both views' models, calibrated, and how many pseudo-labels (bad, good)
    each view was handed."""
    telling = _telling(table, exchange)

    def narrowed(batches):
        places = [np.full(d, -1, dtype=np.int64) for d in DIMS]
        for place, (at, _, _) in zip(places, telling, strict=True):
            place[at] = np.arange(len(at))
        for pdf in _slices(batches, "a", "b"):
            for view, which, y, pseudo, held, flat, cut in exchange.rows(pdf):
                flat = places[view][flat]
                run = np.concatenate([[0], np.cumsum(flat >= 0)])
                weight = np.where(pseudo, np.where(y == 1, telling[view][1][1], telling[view][1][0]), 1.0)
                yield pd.DataFrame({"view": np.full(len(y), view), "h": pdf["h"].to_numpy()[which], "g": pdf["g"].to_numpy()[which], "y": y,
                                    "pseudo": pseudo, "held": held, "w": weight, "f": _packed(flat[flat >= 0], run[cut])})

    rows = materialize(table.mapInPandas(narrowed, schema="view int, h long, g long, y double, pseudo boolean, held boolean, w double, f binary"))
    learnt = [(np.zeros(len(at)), 0.0) for at, _, _ in telling]
    for _ in range(AVERAGES):

        def steps(batches, learnt=learnt):
            held, total = ([], []), [None, None]

            def add_block(view):
                y, each, flat, size = (np.concatenate([p[k] for p in held[view]]) for k in range(4))
                held[view].clear()
                own, bias = fit(flat, np.concatenate([[0], np.cumsum(size)]), y, each, *learnt[view], STEPS)
                # a block speaks for a feature by how often it saw it
                n = np.concatenate([[each.sum()], np.bincount(flat, weights=np.repeat(each, size), minlength=len(own))])
                v = np.stack([np.concatenate([[bias], own]) * n, n])
                total[view] = v if total[view] is None else total[view] + v

            for pdf in _slices(batches, "f"):
                for view in (0, 1):
                    some = pdf[pdf["view"] == view]
                    if len(some):
                        flat, cut = _unpacked(some["f"])
                        held[view].append((some["y"].to_numpy(), some["w"].to_numpy(), flat, np.diff(cut)))
                        if sum(len(p[2]) for p in held[view]) >= FIT_FEATURES:
                            add_block(view)
            for view in (0, 1):
                if held[view]:
                    add_block(view)
                if total[view] is not None:
                    yield pd.DataFrame({"view": [view], "v": [total[view].tobytes()]})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"view": pdf["view"][:1], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

        tasks = rows.where("not held").mapInPandas(steps, schema="view int, v binary")
        # two levels: a vector for each task, then SUMS of them for each view
        got = tasks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUMS))).groupBy("view", "part").applyInPandas(added, "view int, v binary").toPandas()
        learnt = list(learnt)
        for view, some in got.groupby("view"):
            v, n = sum(np.frombuffer(x) for x in some["v"]).reshape(2, -1)
            mean = v / np.maximum(n, 1e-9)
            learnt[view] = (mean[1:], float(mean[0]))
    models = [Model(d, at, *w) for d, (at, _, _), w in zip(DIMS, telling, learnt, strict=True)]
    return _calibrated(rows, models, learnt), [t[2] for t in telling]


def _calibrated(rows: DataFrame, models: list[Model], learnt: list) -> Scorer:
    """Both models with scales from labelled rows that were held out (from all
    labelled ones if those are not of both classes)."""

    def per_batch(batches):
        for pdf in _slices(batches, "f"):
            for view, (w, b) in enumerate(learnt):
                some = pdf[pdf["view"] == view]
                flat, cut = _unpacked(some["f"])
                run = np.concatenate([[0.0], np.cumsum(w[flat])])
                yield pd.DataFrame({"view": view, "h": some["h"], "g": some["g"], "y": some["y"], "held": some["held"],
                                    "z": np.clip(run[cut[1:]] - run[cut[:-1]] + b, -30, 30)})

    scored = rows.where("not pseudo").mapInPandas(per_batch, schema="view int, h long, g long, y double, held boolean, z double")
    got = (scored.groupBy("h", "g").agg(F.first("y").alias("y"), F.first("held").alias("held"), *[
        F.max(F.when(F.col("view") == k, F.col("z"))).alias(c) for k, c in enumerate("tm")])
        .orderBy(F.desc("held"), F.xxhash64("h"), "h", "g").limit(CALIBRATION_ROWS).toPandas())
    apart = got[got["held"]] if got.loc[got["held"].astype(bool), "y"].nunique() == 2 else got
    if not len(apart):
        return Scorer(*models, np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.zeros(3))
    y, z = apart["y"].to_numpy(), [apart[c].to_numpy() for c in ("t", "m")]
    scales = [calibrate(v[:, None], y) for v in z]
    both = calibrate(np.column_stack([s[0] + s[1] * v for s, v in zip(scales, z, strict=True)]), y)
    return Scorer(*models, *scales, both, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))


def train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, seen: list | None = None,
          known: DataFrame | None = None) -> Scorer:
    """Fit both views on documents (doc_id, text, source, lang) and labels
    (doc_id, quality, toxic).

    Good means quality 1 and not toxic; of several labels of one document, or
    of equal documents, the worst counts; null labels do not, and a row without
    doc_id has none. All labelled documents are fitted on but every
    CALIBRATION_SHARE-th, which is kept for calibration (CALIBRATION_ROWS of
    them at most). In each round a view takes on every unlabelled document that
    the other gives a probability of at least ``sure`` of either class and that
    it does not lean against. Without labels every document scores 0.5. Null
    texts are empty; repeated rows are one document; any text length will do.
    ``seen`` gets (round, view, bad, good): how many documents were handed on;
    ``known`` saves reading the documents if known_documents() was called.
    """
    table = known_documents(documents, labels) if known is None else known
    scorer = None
    for k in range(rounds + 1):
        scorer, handed = _fitted(table, _Exchange(scorer, sure))
        if seen is not None:
            seen += [(k, view, *n) for view, n in enumerate(handed)]
    return scorer


def score_documents(documents: DataFrame, scorer: Scorer, keep: float = KEEP) -> DataFrame:
    """doc_id, p_text, p_meta, p_good, keep (p_good of at least ``keep``) of
    every row. A null text is empty, a null source or language is a value of
    its own; repeated rows score alike; other columns are ignored."""
    return (documents.select("doc_id", scores(scorer).alias("p")).select("doc_id", "p.*")
            .withColumn("keep", F.col("p_good") >= keep))


def score_known(documents: DataFrame, scorer: Scorer, known: DataFrame, keep: float = KEEP) -> DataFrame:
    """The result of score_documents(), from the features that
    known_documents() has gathered of the same documents: each distinct
    document is scored once, and rows meet their scores by its hashes."""

    def per_batch(batches):
        for pdf in _slices(batches, "a", "b"):
            z = scorer.views([_unpacked(pdf[c]) for c in ("a", "b")])
            p = _sigmoid(np.column_stack([*z, scorer.combine[0] + scorer.combine[1] * z[0] + scorer.combine[2] * z[1]]))
            yield pd.DataFrame({"h": pdf["h"], "g": pdf["g"], "p_text": p[:, 0], "p_meta": p[:, 1], "p_good": p[:, 2]})

    scored = known.mapInPandas(per_batch, schema="h long, g long, p_text double, p_meta double, p_good double")
    return (_hashed(documents).select("id", "h", "g").join(scored, ["h", "g"])
            .select(F.col("id").alias("doc_id"), "p_text", "p_meta", "p_good", (F.col("p_good") >= keep).alias("keep")))


def keep_good(documents: DataFrame, scorer: Scorer, keep: float = KEEP) -> DataFrame:
    """The rows of documents that are not rejected, with all their columns."""
    return documents.where(scores(scorer)["p_good"] >= keep)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``, learnt from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = known_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_known(docs, train(docs, None, known=known), known)
