"""From raw documents to a training mix: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller
writes that and hands the rows read back to the next stage. All but the last
return the columns of ``documents``. Stages with Python tasks bound the bytes
of the session's Arrow batches where it has no bound.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retail_insight.llm import decontaminate, jaccard_join, line_dedup, quality, source_mix
from retail_insight.llm.batches import bounded_batches
from retail_insight.session import ensure_checkpoint_dir, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject, each row by
    its own text, source and language (nulls are values of their own). Where no
    label helps every row has 0.5 and stays; an empty table stays empty."""
    bounded_batches(spark)
    scorer = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, scorer)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has, or nearly has;
    n_chars follows. A document that loses all its words this way goes; one
    that had none before stays."""
    bounded_batches(spark)
    done = line_dedup.dedup_lines(docs)
    lost = F.col("n_exact") + F.col("n_near")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    return (done.where((lost == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
            .withColumn("n_chars", F.when(lost > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
            .select(*[F.col(f"`{c}`") for c in kept]))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id. Rows
    without doc_id stay."""
    bounded_batches(spark)
    found = jaccard_join.near_duplicates(docs)
    gone = found.where("class_id != doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of a benchmark item. Each row is judged by its
    own text, also one without doc_id or with another row's: rows go by a
    128-bit hash of all their columns. Null and empty texts stay, rows that
    agree in every column stay or go together, an empty table stays empty."""
    bounded_batches(spark)
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*every).alias("_row"), F.concat_ws(",", F.xxhash64(*every), F.xxhash64(F.lit(1), *every)).alias("_key"))
    texts = rows.select("_key", F.col("_row.text").alias("text"))
    found = decontaminate.find_passages(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_key")
    return rows.join(found.select("_key").distinct(), "_key", "left_anti").select("_row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each with its own ``copies``, how often,
    and ``taken``, the words that they give it. A row without doc_id takes
    part under a hash of its columns. Rows that agree in doc_id, source and
    words share their copies, those of the least hash taking what is left
    over."""
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copies", "taken")]).alias("_row"), every.alias("_hash"),
                       F.coalesce("doc_id", every).alias("_id"), F.col("source").alias("_source"), source_mix.n_words("text").alias("_size"))
    sized, aims = source_mix.size_and_aim(docs.select(F.coalesce("doc_id", every).alias("doc_id"), "source", "text"))
    groups = materialize(source_mix.mix(sized, aims).groupBy("id", "source", "size")
                         .agg(F.sum("copies").alias("_n"), F.count(F.lit(1)).alias("_rows")).where("_n > 0"))

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, (F.col("_id") == F.col("id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))

    def out(found: DataFrame, copies) -> DataFrame:
        return found.withColumn("copies", copies).where("copies > 0").select("_row.*", "copies", (F.col("copies") * F.col("_size")).alias("taken"))

    share = F.floor(F.col("_n") / F.col("_rows"))
    result = out(of(groups.where("_n % _rows = 0")), share)
    # only a group at which the mix is cut, at most one for each source and round, has copies left over
    uneven = groups.where("_n % _rows != 0")
    if not uneven.isEmpty():
        nth = F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy("_hash"))
        result = result.unionByName(out(of(uneven), share + (nth <= F.col("_n") % F.col("_rows")).cast("long")))
    return result


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mix", mix_stage),
]

#: A classifier is trained on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder
    and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
