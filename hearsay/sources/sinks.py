"""Writers: tables as parquet, day-partitioned event logs, the object store and the OpenAPI file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", by: list[str] | None = None) -> str:
    path = f"{root.rstrip('/')}/{name}"
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)
    return path


#: Parts of a merged table from which on the next batch rewrites it as one.
MOST_PARTS = 16
_PART = re.compile(r"^(add|all)-([0-9]{12})-(.+)$")


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int, str, str]]:
    """(kind, number, batch, folder) of the finished parts that a merged table consists of, in order: the last one of kind
    all, which stands for everything before it, and what was added since."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if (m := _PART.match(name)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
                found.append((m[1], int(m[2]), m[3], f"{path}/{name}"))
    found.sort(key=lambda p: p[1])
    whole = [k for k, p in enumerate(found) if p[0] == "all"]
    return found[whole[-1] :] if whole else found


def read_merged(spark: SparkSession, root: str, name: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that ``merge_table`` keeps."""
    parts = _parts(spark, f"{root.rstrip('/')}/{name}")
    if not parts:
        raise FileNotFoundError(f"{root}/{name} has no finished part")
    return merge(reduce(DataFrame.unionByName, [spark.read.parquet(p[3]) for p in parts]))


def merge_table(spark: SparkSession, root: str, name: str, new: DataFrame, merge: Callable[[DataFrame], DataFrame], batch: str) -> None:
    """Upsert of aggregates, each ``batch`` once: what it adds is one folder, whose name has the batch, and which counts from
    the moment that Spark marks it finished. A batch that is there already adds nothing; one that was cut short is written
    again. After MOST_PARTS parts the next batch writes the whole merged table instead, and what that stands for is
    deleted after it is finished."""
    path = f"{root.rstrip('/')}/{name}"
    parts = _parts(spark, path)
    if any(p[2] == batch for p in parts):
        return
    number = parts[-1][1] + 1 if parts else 0
    whole = len(parts) >= MOST_PARTS
    if whole:
        new = merge(reduce(DataFrame.unionByName, [*(spark.read.schema(new.schema).parquet(p[3]) for p in parts), new]))
    new.write.mode("overwrite").parquet(f"{path}/{'all' if whole else 'add'}-{number:012d}-{batch}")
    if whole:
        for p in parts:
            folder = spark._jvm.org.apache.hadoop.fs.Path(p[3])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_event_log(events: DataFrame, root: str) -> str:
    """JSON lines, a folder for each UTC day."""
    path = f"{root.rstrip('/')}/events_log"
    events.write.mode("append").partitionBy("day").json(path)
    return path


def write_objects(objects: DataFrame, root: str) -> str:
    """Content-addressed bodies; what is there already isn't written again."""
    path = f"{root.rstrip('/')}/objects"
    spark = objects.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = objects
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = objects.join(spark.read.parquet(path).select("path"), "path", "left_anti")
    new.select("path", "text", F.substring("path", 1, F.locate("-", F.col("path")) - 1).alias("kind")).write.mode("append").parquet(path)
    return path


def write_openapi(spec: dict, spark: SparkSession, path: str) -> None:
    """The document as one text file, through Spark's own file system."""
    spark.createDataFrame([(json.dumps(spec, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
