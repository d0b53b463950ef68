"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``, read lazily."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``. Where that is unset, a local session makes one of its own, removed at its end; on a cluster it is an error."""
    context = spark.sparkContext
    setting = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not setting:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        setting = tempfile.mkdtemp(prefix="cairn-shared-")
        atexit.register(shutil.rmtree, setting, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(setting)
    return setting.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below :func:`shared_folder`."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which survives the loss of executors; unlike a checkpoint it computes ``df`` once."""
    return materialize(df, "cut")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back (columnar, prunable)."""
    folder = fresh_folder(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder) if not partition_by else df.sparkSession.read.parquet(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of its file system, as :func:`read_written` needs it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_written(folder: str, columns: list[str]) -> pa.Table:
    """A parquet table of the shared folder, read by a Python worker without Spark."""
    scheme, _, path = folder.partition(":")
    system, path = (fs.LocalFileSystem(), "/" + path.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(folder)
    return ds.dataset(path, filesystem=system, format="parquet").to_table(columns)


_kept: dict[tuple, tuple[str, object]] = {}


def _stamp(spark: SparkSession, folder: str, tables: Sequence[str]) -> tuple:
    """Names, sizes and times of change of the tables' files."""
    jvm = spark.sparkContext._jvm
    out = []
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(path)  # of a file: itself
        out.append(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)))
    return tuple(out)


def kept(spark: SparkSession, folder: str, tables: Sequence[str], label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries of a session use, such as the include graph: written once for each state of the tables it is made of, and again once its folder is gone."""
    key = (spark.sparkContext.applicationId, folder, label, _stamp(spark, folder, tables))
    if key in _kept:
        at, schema = _kept[key]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(at)
    df = build()
    at = fresh_folder(spark, label)
    df.write.parquet(at)
    _kept[key] = at, df.schema
    return spark.read.schema(df.schema).parquet(at)
