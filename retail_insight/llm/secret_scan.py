"""Secrets in versioned texts, found once per distinct content.

DataFrame functions only. Every version of every path is addressed by the
SHA-256 of its content. A ledger keeps, for each blob and rule version, the
spans found; only pairs that the ledger lacks are scanned, and the findings
are joined back to all paths and versions that hold the blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.session import materialize


class Rule(NamedTuple):
    """``pattern`` is matched leftmost and non-overlapping; a match whose
    ``group`` has fewer than ``least`` characters is dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The three base kinds.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

# Public formats of further credentials.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", 0, 39),
)
RULES = BASE + MORE

_SPAN = "array<struct<begin:int,place:int,kind:string,finish:int>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule as structs (begin, place, kind, finish), in code
    points. The parts between matches and the matches themselves alternate,
    so their running lengths are the positions."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    measured = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"),
                         found.alias("hit"), measured.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("begin"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"),
                        end.alias("finish"))
        kept = F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return (F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda acc: acc["out"]))
            .otherwise(F.array().cast(_SPAN)))


def address(versions: DataFrame, path: str, version: str | None, content: str) -> DataFrame:
    """path, version, blob: the SHA-256 of each version's content (null: empty)."""
    v = F.col(f"`{version}`") if version else F.lit(None).cast("string")
    return versions.select(F.col(f"`{path}`").alias("path"), v.alias("version"),
                           F.sha2(F.coalesce(F.col(f"`{content}`"), F.lit("")), 256).alias("blob"))


def scan_unseen(versions: DataFrame, path: str, version: str | None, content: str,
                rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, kind, rule_version, spans) for the pairs of blob and
    rule version that ``ledger`` (same columns) lacks; append them to it.

    Each unseen blob is scanned at one place, its least (path, version); rows
    that repeat path and version with the same content are the same place.
    Contents that are null count as empty. An empty table gives no rows.
    """
    if len({(r.kind, r.version) for r in rules}) < len(rules):
        raise ValueError("a kind and version is listed twice")
    named = versions.select(F.col(f"`{path}`").alias("path"),
                            (F.col(f"`{version}`") if version else F.lit(None).cast("string")).alias("version"),
                            F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("content"))
    blobs = (named.select("path", "version", F.sha2("content", 256).alias("blob"))
             .groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at")))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "rule_version")).alias("done"))
        todo = (blobs.join(done, "blob", "left")
                .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,rule_version:int>>"))))
                .where(F.size("todo") > 0))
    todo = todo.select("blob", F.col("at.path").alias("p"), F.col("at.version").alias("v"), "todo")
    placed = named.join(todo, F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v")))
    # a path and version may hold several contents: only the blob's own is scanned, and once
    own = placed.where(F.sha2("content", 256) == F.col("blob"))
    due = [F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"))) for r in rules]
    found = F.array(*[
        F.when(d, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"),
                           spans_of(F.col("content"), r, k).alias("spans")))
        for k, (r, d) in enumerate(zip(rules, due, strict=True))])
    rows = own.select("blob", F.filter(found, lambda x: x.isNotNull()).alias("found"))
    return rows.groupBy("blob").agg(F.first("found").alias("found")).select("blob", F.inline("found"))


def findings(addressed: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, version, blob, spans: for every version all spans that the ledger
    has for the current rules, by begin, then in the order of the rules."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    hits = (ledger.where((F.size("spans") > 0) & F.array_contains(current, F.struct("kind", "rule_version")))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return addressed.join(hits, "blob", "left").select(
        "path", "version", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")


def _placed(k: int):
    return lambda s: s["place"] == k


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``, each distinct text scanned
    once; a first run, so its ledger starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = materialize(scan_unseen(docs, "doc_id", None, "text"))
    rows = findings(address(docs, "doc_id", None, "text"), ledger)
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = [F.size(F.filter("spans", _placed(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return rows.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))
