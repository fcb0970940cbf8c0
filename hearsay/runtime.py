"""Session helpers: tables, shared checkpoint folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a temporary one if driver and executors are
    one machine (tests); on a cluster that folder would not be shared, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="hearsay-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a read, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never broadcast. Spark takes what ``cut`` wrote for as large as its compressed files
    (6 000 000 nodes of the dependency graph: 24 MB, of two columns 7), so it would send rows by the million through the driver.
    Holds for what is selected, filtered and counted of ``df``, not beyond a join or union."""
    out = df.hint("merge")
    if path := getattr(df, "_cut_path", None):
        out._cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; nothing that is still to be read may depend on them."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with a running number from 1 in the order of ``by``: sorted by range over machines, counted in each range, and
    moved on by how many rows the ranges before have; no task sees all rows."""
    at = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = sorted((r[0], r[1]) for r in at.groupBy(part.alias("part")).count().collect())  # one row for each range
    before, upto = [], 0
    for k, n in sizes:
        before.append((k, upto))
        upto += n
    spark = df.sparkSession
    moved = spark.createDataFrame(before, "numbered_part bigint, numbered_before bigint")
    out = at.withColumn("numbered_part", part).join(F.broadcast(moved), "numbered_part")
    return out.withColumn(name, F.col("numbered_before") + F.expr(f"{name} & 8589934591") + 1).drop("numbered_part", "numbered_before")


_ONCE: dict[tuple, tuple[DataFrame, ...]] = {}


def once(spark: SparkSession, sf_dir: str, names: tuple[str, ...], build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """What ``build`` makes of tables ``names``, written once for a session and read by all queries that need it, as frames
    that are never broadcast. It is made again if a table has changed since, or if what was written is gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def status(path: str):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return fs.getFileStatus(p) if fs.exists(p) else None

    found = [status(f"{sf_dir}/{n}.parquet") for n in names]
    key = (spark.sparkContext.applicationId, build.__qualname__, sf_dir, *((x.getModificationTime(), x.getLen()) for x in found if x))
    if key not in _ONCE or not all(status(df._cut_path) for df in _ONCE[key]):
        _ONCE[key] = tuple(large(df if hasattr(df, "_cut_path") else cut(df)) for df in build())
    return _ONCE[key]
