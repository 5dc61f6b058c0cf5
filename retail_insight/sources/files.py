"""File readers for raw transaction exports.

CSV is read with every column as a string (no schema inference pass over
the data); the ingest operator coerces with ``try_cast`` so bad values turn
into nulls instead of failing the job under ANSI mode. Records follow the
usual quoting rules: a quoted value may hold separators, line breaks and
doubled quotes. gzip files and files with quoted line breaks are not
splittable, so the reader takes the number of partitions that such an input
should have after the read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts that stand for a missing value in a CSV file.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null")
_RECORD = "__record"


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists in the store it names (local, HDFS, object
    store), like choosing between a full dataset and a sample file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", sep: str = ",",
                 line_breaks: bool = True, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad) of CSV files with a header line (plain or ``.csv.gz``).

    ``records``: all columns as text, named by the header (or ``columns``);
    MISSING_TEXTS and the fields that a short record lacks are null. ``bad``
    (file, record): records with more fields than the header, or with a quote
    that is never closed, as they stand in the file; ``bad.count()`` counts
    them. A surplus field that is empty is no fault.

    With ``line_breaks`` a quoted value may go over several lines, and a file
    is one unit of reading; without, large plain files are split.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rules = {"header": "true", "encoding": encoding, "sep": sep, "quote": '"', "escape": '"', "multiLine": str(line_breaks).lower()}
    names = list(columns) if columns else spark.read.options(**rules).option("inferSchema", False).csv(paths).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, _RECORD]])
    raw = (spark.read.options(**rules).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD)
           .schema(schema).csv(paths))
    # a record of another number of fields comes with its text: short ones are filled up, long ones are not
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    record = F.col(_RECORD)
    surplus = F.from_csv(record, wide, {"sep": sep, "quote": '"', "escape": '"'}).getField(f"c{len(names)}")
    unclosed = (F.length(record) - F.length(F.translate(record, '"', ""))) % 2 == 1
    # Spark does not scan the record's text alone, so the test names a column, too
    some = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    is_bad = F.coalesce(record.isNotNull() & some & (surplus.isNotNull() | unclosed), F.lit(False))

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~c.isin(*MISSING_TEXTS), c).alias(name)

    bad = raw.where(is_bad).select(F.col("_metadata.file_path").alias("file"), record.alias("record"))
    return raw.where(~is_bad).select(*[value(n) for n in names]), bad


def read_transactions_csv(spark: SparkSession, path: str | Sequence[str],
                          encoding: str = "UTF-8", sep: str = ",",
                          num_partitions: int | None = None, line_breaks: bool = True) -> DataFrame:
    """The good records of header CSV (see :func:`read_records`; Latin-1 via
    ``encoding``). ``num_partitions`` deals the rows out anew, for one large
    file that cannot be split."""
    df, _bad = read_records(spark, path, encoding, sep, line_breaks)
    return df.repartition(num_partitions) if num_partitions else df


def read_transactions_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def with_row_numbers(scan: DataFrame, out: str) -> DataFrame:
    """Add ``out``: 1, 2, ... in the order of the files' paths and, within a
    file, of its rows.

    ``scan`` is a plain read of files. Only a count for each input split is
    gathered: splits are put in order by file and first byte, their counts are
    added up, and a row adds its place within its split. Rows are not moved or
    sorted; no task sees more than one row for each split.
    """
    from pyspark.sql import Window

    at = F.monotonically_increasing_id()  # ascending within a split, which one task reads in order
    placed = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), at.alias("__at"))
    splits = placed.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(F.col("__file").alias("__f"), F.col("__start").alias("__s"), "__first",
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = (F.col("__file") == F.col("__f")) & (F.col("__start") == F.col("__s"))
    return placed.join(offsets, own).select(*[F.col(f"`{c}`") for c in scan.columns],
                                            (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(out))
