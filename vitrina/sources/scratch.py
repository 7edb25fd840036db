"""Tables that a plan makes once and reads many times, in the folder all executors share.

They lie in a folder of the application, which goes when the application ends.  What is kept for some
inputs is made again when those have changed since, and the older table is deleted.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, tuple[str, object]] = {}
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it has a folder of its own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:///tmp/vitrina-checkpoints-{os.getuid()}"


def app_dir(spark: SparkSession) -> str:
    """The application's own folder in :func:`shared_dir`; the file system deletes it when the driver ends."""
    folder = f"{shared_dir(spark)}/vitrina-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as Hadoop's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: a lost executor costs no recomputation beyond it.  The path is in
    ``vitrina_path``."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.vitrina_path = path
    return out


def is_kept(df: DataFrame) -> bool:
    """Whether the table of :func:`kept` is still there."""
    files, path = _files(df.sparkSession, df.vitrina_path)
    return files.exists(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`kept` that no later plan reads."""
    for df in tables:
        files, path = _files(df.sparkSession, df.vitrina_path)
        files.delete(path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark reaches; ``None`` if there is none."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file; readers see the old one or the new one."""
    files, at = _files(spark, path)
    _, beside = _files(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not files.rename(beside, at):  # some file systems don't rename onto a file
        files.delete(at, False)
        files.rename(beside, at)


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and times of the files of some tables (three levels of folders deep)."""
    listed = []
    for path in paths:
        files, _ = _files(spark, path)
        for level in (path, f"{path}/*", f"{path}/*/*"):
            found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(level))
            listed.append(spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(found) if found else "")
    return hashlib.sha256("\n".join(listed).encode()).hexdigest()


def once(spark: SparkSession, key: tuple, of: str, make: Callable[[], object]) -> object:
    """What ``make`` returned for ``key`` in this application while the inputs' state was ``of``.  It is made again in
    another state (an older table is deleted then), or if its table was deleted since."""
    key = (spark.sparkContext.applicationId, *key)
    was, out = _made.get(key, (None, None))
    if was == of and (not hasattr(out, "vitrina_path") or is_kept(out)):
        return out
    _made[key] = of, make()
    if was is not None and was != of and hasattr(out, "vitrina_path"):
        drop(out)
    return _made[key][1]


def forget(spark: SparkSession) -> None:
    """Delete all that :func:`once` has kept."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        _, out = _made.pop(key)
        if hasattr(out, "vitrina_path"):
            drop(out)
