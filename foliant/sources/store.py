"""Stored tables in versions: catalogs and bodies that are changed, and can be put back.

A table is a folder of versions, each written whole by Spark, and a small file
that names the current one. A change writes a new version beside the old one
and then replaces that file in one rename. If the write fails, or executors or the driver are
lost, the old version stays current; readers that have started
keep the version they found. The first version is kept for good, as a backup made once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from foliant.operators import catalog

CURRENT, FIRST = "CURRENT", "FIRST"


class Changed(RuntimeError):
    """Someone else has changed the table since it was read."""


def _files(spark: SparkSession, path: str):
    """The JVM's gateway, the file context of a path and a maker of paths below it."""
    jvm = spark.sparkContext._jvm
    whole = jvm.org.apache.hadoop.fs.Path(path)
    qualified = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(whole)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, context, lambda name: jvm.org.apache.hadoop.fs.Path(qualified, name)


def _read(spark: SparkSession, path: str, name: str) -> str | None:
    """What a small file holds, None if there is none."""
    jvm, context, below = _files(spark, path)
    if not context.util().exists(below(name)):
        return None
    stream = context.open(below(name))
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, name: str, text: str, replace: bool) -> None:
    """Write a small file beside, then rename it to its name."""
    jvm, context, below = _files(spark, path)
    beside = below(f".{name}-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    stream = context.create(beside, flags, options)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    context.rename(beside, below(name), how)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, None if nothing has been stored."""
    return _read(spark, path, CURRENT)


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of a table, or the one named."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    return spark.read.parquet(f"{path}/{version}")


def save(df: DataFrame, path: str, seen: str | None = "any") -> str:
    """Store ``df`` as the new current version and return its name.

    ``df`` may read the table itself. ``seen`` is the version that the change started from (None: none):
    if another one is current once the rows are written, this one isn't made current
    and ``Changed`` is raised.
    """
    spark = df.sparkSession
    before = current(spark, path)
    number = int(before.split("-")[1]) + 1 if before else 0
    version = f"version-{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    if seen != "any" and current(spark, path) != seen:
        raise Changed(f"{path} is at {current(spark, path)}, not at {seen}")
    if _read(spark, path, FIRST) is None:
        _put(spark, path, FIRST, before or version, replace=False)
    _put(spark, path, CURRENT, version, replace=True)
    return version


def change(spark: SparkSession, path: str, f: Callable[[DataFrame], DataFrame]) -> str:
    """Store what ``f`` makes of the current version."""
    seen = current(spark, path)
    return save(f(load(spark, path, seen)), path, seen)


def restore(spark: SparkSession, path: str) -> str:
    """Make the first version current again, and return its name."""
    first = _read(spark, path, FIRST)
    if first is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    _put(spark, path, CURRENT, first, replace=True)
    return first


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of all versions, oldest first; also of those that a failed write has left incomplete."""
    _, context, below = _files(spark, path)
    found, names = context.listStatus(below(".")), []
    while found.hasNext():
        name = found.next().getPath().getName()
        if name.startswith("version-"):
            names.append(name)
    return sorted(names)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions but the first, the current and the ``keep`` newest, and return their names. No change may run meanwhile."""
    _, context, below = _files(spark, path)
    every = versions(spark, path)
    gone = [v for v in every[: max(0, len(every) - keep)] if v not in (current(spark, path), _read(spark, path, FIRST))]
    for name in gone:
        context.delete(below(name), True)
    return gone


def upsert_stored(spark: SparkSession, path: str, changes: DataFrame, key: str = "filename", pos: str = "pos") -> str:
    """Put rows into a stored catalog, see ``catalog.upsert``."""
    return change(spark, path, lambda rows: catalog.upsert(rows, changes, key, pos))


def delete_stored(spark: SparkSession, path: str, condition: Column, pos: str = "pos") -> str:
    """Delete the first row of a stored catalog that meets a condition."""
    return change(spark, path, lambda rows: catalog.delete_first(rows, condition, pos))
