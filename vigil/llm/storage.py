"""Tables written to the folder that driver and executors share, to cut lineage and to read twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset and all runs in one process, as in tests, a local one is made."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = "file://" + tempfile.mkdtemp(prefix="vigil-")
    return _OWN[application]


def fresh_name(name: str) -> str:
    return f"{name.replace(' ', '-')}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder.  release() deletes all of them, and at the latest the driver's end does."""
    path = f"{shared_dir(spark)}/vigil/{fresh_name(name)}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    hadoop, files = _file_system(spark, path)
    files.mkdirs(hadoop.getParent())
    files.deleteOnExit(hadoop)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme, and host if any, of the store that Hadoop takes it to be in."""
    hadoop, files = _file_system(spark, path)
    return files.makeQualified(hadoop).toString()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet once and reads it back: later plans start from the files, which outlive executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


@contextmanager
def recording(spark: SparkSession) -> Iterator[list[str]]:
    """A list that afterwards has the paths given out within."""
    known = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    n, new = len(known), []
    yield new
    new += known[n:]


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these paths, or all that were given out; frames that read them must not be used any more."""
    known = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    for path in list(known if paths is None else paths):
        delete(spark, path)
        if path in known:
            known.remove(path)


def release_table(df: DataFrame) -> None:
    """Deletes one materialised table."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        for path in _WRITTEN.get(spark.sparkContext.applicationId, []):
            if path.split("/vigil/")[1] in file:
                delete(spark, path)
