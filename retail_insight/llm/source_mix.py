"""A mix of documents that gives each source its share of words.

Weighted fair queueing: each source's documents queue in a shuffled order, up
to ``repeats`` times over. A document's virtual finish time is the words of
its source up to and including it, divided by the source's target. All queues
are merged by finish time and cut where the total reaches the budget, so every
source is served at the pace of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.running import running_total
from retail_insight.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
# The contract's weights, share of all words and largest repeat.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 20


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the distinct sources the weights in turn, by code point, null last."""
    ordered = sources.select("source", F.col("source").isNull().cast("int").alias("_last"), F.lit(1).cast("long").alias("_one"))
    ranked = running_total(ordered, ["_last", "source"], "_one", "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranked.select("source", F.element_at(cycle, (((F.col("_rank") - 1) % len(weights)) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Add ``target`` to sources (source, source_size, weight).

    The budget, ``share`` of all words (at most ``repeats`` of them), is dealt
    out by weight; a target stops at ``repeats`` times the source's size and
    what it leaves is dealt out again by weight until none is above. Each
    round is one aggregate over the sources; the driver keeps three numbers.
    """
    cap = F.col("source_size") * repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, repeats) * total
    level, full = 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        n, used, left = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)),
                                    F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not left:
            if not left:
                level = float("inf")
            break
        full, level = n, (budget - (used or 0)) / left
    share_of = F.col("weight") * F.lit(level) if level != float("inf") else cap.cast("double")
    return sources.withColumn("target", F.least(share_of, cap.cast("double")))


def mix(sized: DataFrame, aims: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """How many copies of each row the mix takes.

    ``sized``: id (bigint), source, size (bigint, 0 and up; null counts as 0);
    ``aims``: one row per source with source_size and target. Returns
    id, source, size, source_size, target, copies (0 to ``repeats``). Rows that
    share an id each count on their own. Ties in the shuffled order are broken
    by id and size, so reruns agree however the rows are dealt out. Rows of
    size 0 are never taken. Whole documents are taken while the running total
    by finish time stays within the sum of the targets.
    """
    a = aims.select(F.col("source").alias("_source"), "source_size", "target")
    keyed = (sized.select("id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
             .withColumn("_h", F.xxhash64(F.lit(seed), "id", "size")))
    queued = running_total(keyed, ["_h", "id", "size"], "size", "_words", group="source")
    timed = queued.join(a, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    served = (timed.where((F.col("size") > 0) & (F.col("target") > 0))
              .select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(repeats)])).alias("_round"))
              .withColumn("_finish", (F.col("_round") * F.col("source_size") + F.col("_words")) / F.col("target"))
              .select("id", "source", "size", "_h", "_round", "_finish"))
    budget = aims.agg(F.sum("target")).first()[0] or 0.0
    merged = running_total(served, ["_finish", "source", "_h", "id", "_round"], "size", "_served")
    taken = (merged.where(F.col("_served") <= F.lit(budget + 1e-6))
             .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("_n")).select(
                 F.col("id").alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_n"))
    same = keyed.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("_rows"))
    out = (same.join(a, F.col("source").eqNullSafe(F.col("_source")))
           .join(taken, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s"))
                 & (F.col("size") == F.col("_z")), "left")
           .select("id", "source", "size", "source_size", "target", "_rows", F.coalesce("_n", F.lit(0)).alias("_n")))
    # rows that agree in everything share their copies, the first ones taking what is left over
    return out.select("id", "source", "size", "source_size", "target", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row"),
                      "_n", "_rows").select(
        "id", "source", "size", "source_size", "target",
        (F.floor(F.col("_n") / F.col("_rows")) + (F.col("_row") <= F.col("_n") % F.col("_rows")).cast("long")).alias("copies"))


def n_words(text: str) -> Column:
    """Words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_and_aim(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                 repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(id, source, size) of each document and (source, source_size, weight,
    target) of each source. Words are runs of anything but space and
    \\x09-\\x0D; a null text has none. A null source is a source of its own."""
    sized = materialize(documents.select(F.col("doc_id").alias("id"), "source", n_words("text").alias("size")))
    per_source = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weighted = cyclic_weights(per_source, weights).select(F.col("source").alias("_s"), "weight")
    sources = materialize(per_source.join(weighted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    return sized, targets(sources, share, repeats)


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix over all ``documents``; an empty table gives an empty result."""
    sized, aims = size_and_aim(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix(sized, aims).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))
