"""Writers for exported tables.

A globally sorted export is written as ordered part files: ``orderBy``
range-partitions the rows, so part-00000 holds the first range, and no
single task has to hold the whole table (no ``coalesce(1)``).

An export is a folder of versions and a manifest that names the current one.
A write puts its files into a new version and swaps the manifest in last, so
readers of :func:`read_export` see the old export until the new one is whole,
and a write that fails leaves the old one as it was. The version before the
current one stays for readers that have begun with it; older ones go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

MANIFEST = "_manifest.json"


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """CSV holds scalars only; nested columns are written as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class _Store:
    """Files of one export folder, in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.gateway, self.jvm, self.root = spark.sparkContext._gateway, spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self) -> dict | None:
        at = self._path(MANIFEST)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap_in(self, manifest: dict) -> None:
        """The new manifest, written beside the old one, takes its name."""
        new = f"{MANIFEST}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(new))
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self._path(new)), self.fs.makeQualified(self._path(MANIFEST)), how)

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _commit(df: DataFrame, path: str, form: str, mode: str, write: Callable[[str], None]) -> None:
    """write(folder) a new version, then make it the current one."""
    if mode not in ("overwrite", "error", "errorifexists"):
        raise ValueError(f"mode {mode!r}: an export is replaced (overwrite) or must be new (error)")
    store = _Store(df.sparkSession, path)
    old = store.manifest()
    if old and mode != "overwrite":
        raise FileExistsError(f"there is an export at {path}")
    version = f"v-{uuid.uuid4().hex}"
    try:
        write(f"{store.root}/{version}")
    except BaseException:
        store.drop(version)
        raise
    store.swap_in({"version": version, "previous": old and old["version"], "format": form, "columns": df.columns})
    if old and old.get("previous"):
        store.drop(old["previous"])


def export_folder(spark: SparkSession, path: str) -> str:
    """The folder of the current version's files."""
    manifest = _Store(spark, path).manifest()
    if not manifest:
        raise FileNotFoundError(f"no export at {path}")
    return f"{path.rstrip('/')}/{manifest['version']}"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The current export at ``path``; CSV columns are text."""
    manifest = _Store(spark, path).manifest()
    if not manifest:
        raise FileNotFoundError(f"no export at {path}")
    folder = f"{path.rstrip('/')}/{manifest['version']}"
    if manifest["format"] == "parquet":
        return spark.read.parquet(folder)
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(folder)


def write_csv(df: DataFrame, path: str, order_by: Sequence[Column | str] | None = None,
              mode: str = "overwrite", compression: str | None = None) -> None:
    out = _flat_for_csv(df)
    if order_by:
        out = out.orderBy(*order_by)
    w = out.write.option("header", True).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    _commit(df, path, "csv", mode, w.csv)


def write_parquet(df: DataFrame, path: str, order_by: Sequence[Column | str] | None = None,
                  mode: str = "overwrite") -> None:
    out = df.orderBy(*order_by) if order_by else df
    _commit(df, path, "parquet", mode, out.write.parquet)
