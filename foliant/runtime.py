"""Session helpers: shared scratch space, written intermediates and checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local does this make a temporary folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return f"file://{_own_scratch[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/foliant-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The lineage is cut at files that outlive any executor, and what reads the
    result several times doesn't compute it several times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.__dict__["_foliant_path"] = path
    track(spark, path)
    return written


#: Input files that are numbered by a broadcast list; rows of more files are written with their numbers.
LISTED_FILES = 20_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """uid, row: a number that is the same each time it is read, and the row of ``df`` as a struct.

    A row of a Parquet file that is only scanned is known by the file's place
    in the list of files and its own place in the file, so that neither the
    cores nor the splits of a scan matter. Anything else is written with
    numbers first.
    """
    spark = df.sparkSession
    files = sorted(df.inputFiles()) if df._jdf.queryExecution().optimizedPlan().nodeName() == "LogicalRelation" and "_metadata" not in df.columns else []
    if not 0 < len(files) <= LISTED_FILES or not all(f.endswith(".parquet") for f in files):
        return materialize(df.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), name)
    known = spark.createDataFrame(list(enumerate(files)), "_number long, _file string")
    rows = df.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"), F.struct("*").alias("row"))
    plain = lambda path: F.regexp_replace(path, "^([a-z0-9+.-]+:)/+", "$1/")  # noqa: E731 - file:/// and file:/
    rows = rows.join(F.broadcast(known), plain("_path") == plain("_file"), "left")  # at most LISTED_FILES rows
    number = F.coalesce("_number", F.raise_error(F.concat(F.lit("not in the list of files: "), "_path")).cast("long"))
    return rows.select((F.shiftleft(number, 40) + F.col("_place")).alias("uid"), "row")


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table of sorted buckets by a column, as many as a shuffle has parts, and read it back.

    A join on ``by`` moves only its other side. Each bucket is one file if the
    tasks of ``df`` hold whole buckets, as after a join on ``by``.
    """
    spark = df.sparkSession
    number, title, path = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"foliant_{uuid.uuid4().hex}", scratch_path(spark, name)
    track(spark, path)
    df.write.bucketBy(number, by).sortBy(by).option("path", path).saveAsTable(title)
    written = spark.table(title)
    written.__dict__.update(_foliant_path=path, _foliant_table=title)
    return written


def settle(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more removed now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def track(spark: SparkSession, path: str) -> None:
    """Count a written path among the tables of the scopes that are open."""
    for tables in _scopes:
        tables.append((spark, path))


@contextmanager
def configured(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is planned meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[list[tuple[SparkSession, str]]]:
    """Collects the tables that ``materialize`` writes meanwhile and that aren't discarded by then; ``release`` deletes them."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def release(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete the tables of a scope, once what reads them has been written."""
    while tables:
        remove_path(*tables.pop())


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` or ``bucketed`` wrote for ``df``; call it only when no plan reads it any more."""
    path = df.__dict__["_foliant_path"]
    if title := df.__dict__.get("_foliant_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {title}")
    remove_path(df.sparkSession, path)
    for tables in _scopes:
        tables[:] = [t for t in tables if t[1] != path]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows; otherwise leave the join to Spark.

    ``df`` should be materialized, as this counts it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores over all cores, for costly Python stages.

    Such an input holds less than a few MB a core, so the shuffle is cheap; a
    larger one is left where it is read. ``df`` should be a scan, as a plan with
    exchanges would be run to count its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
