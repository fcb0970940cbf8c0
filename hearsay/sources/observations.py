"""Observation logs: adapters of driver tables and readers of files. Everything later is derived from such a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions import urls
from hearsay.runtime import table

#: One row for each response that was seen.
OBSERVATION = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("captured_at", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("method", "url", "path", "query_raw", "base_url", "request_headers", "request_body")]
    + [T.StructField("response_status", T.IntegerType()), T.StructField("response_headers", T.StringType()), T.StructField("response_body", T.StringType())]
    + [T.StructField("response_time_ms", T.LongType()), T.StructField("source", T.StringType()), T.StructField("trace_id", T.StringType())]
)

#: Event type -> method. Fixed values of the adapter.
METHODS = {"view": "GET", "click": "GET", "signup": "POST", "purchase": "PUT", "error": "DELETE"}


def from_events(events: DataFrame) -> DataFrame:
    """Events as an observation log: one session for each user, one endpoint family for each event type."""
    method = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    e = events.withColumn("k", F.get_json_object("props", "$.k"))
    path = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("s/"), F.col("k"))
    url = F.concat(F.lit("https://api.example.com"), path, F.lit("?page="), F.col("k"))
    null = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_at"),
        method[F.col("event_type")].alias("method"), url.alias("url"), path.alias("path"), F.concat(F.lit("?page="), F.col("k")).alias("query_raw"), F.lit("https://api.example.com").alias("base_url"),
        null.alias("request_headers"), null.alias("request_body"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response_status"), null.alias("response_headers"),
        F.col("props").alias("response_body"), F.floor(F.col("value")).cast("bigint").alias("response_time_ms"), F.lit("fetch").alias("source"), null.alias("trace_id"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def split_url(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add path, query_raw and base_url."""
    return rows.withColumn("path", urls.pathname(url)).withColumn("query_raw", urls.query(url)).withColumn("base_url", urls.base_url(url))


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A log that was written as parquet or JSON lines."""
    return spark.read.schema(OBSERVATION).format(fmt).load(path)


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(OBSERVATION).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """HTTP archives (one JSON document a file) as an observation log; entries keep their order as seq."""
    entry = (
        "array<struct<startedDateTime:string,time:double,_resourceType:string,request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,"
        "postData:struct<text:string>>,response:struct<status:int,headers:array<struct<name:string,value:string>>,content:struct<text:string>>>>"
    )
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"log struct<entries:{entry}>").alias("h"))
    rows = files.select("file", F.posexplode("h.log.entries").alias("seq", "e"))

    def headers(c: str):
        return F.to_json(F.map_from_entries(F.transform(F.col(c), lambda h: F.struct(F.lower(h["name"]), h["value"]))))

    out = rows.select(
        F.col("seq").cast("bigint").alias("seq"), F.substring(F.sha2("file", 256), 1, 32).alias("session_id"), F.unix_millis(F.try_to_timestamp("e.startedDateTime")).alias("captured_at"),
        F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), headers("e.request.headers").alias("request_headers"), F.col("e.request.postData.text").alias("request_body"),
        F.col("e.response.status").alias("response_status"), headers("e.response.headers").alias("response_headers"), F.col("e.response.content.text").alias("response_body"),
        F.round("e.time").cast("bigint").alias("response_time_ms"), F.coalesce("e._resourceType", F.lit("fetch")).alias("source"), F.lit(None).cast("string").alias("trace_id"),
    )
    return split_url(out).select(*OBSERVATION.names)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Script files as (file_name, source_code, is_source_map)."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), F.col("value").alias("source_code"))
    return t.withColumn("is_source_map", F.col("file_name").endswith(".map"))
