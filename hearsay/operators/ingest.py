"""From a log of observations to requests, endpoints and their side tables: upserts as aggregates, side effects as branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions import filters
from hearsay.functions.urls import fold_path

#: Columns of which the first observation counts, and those of which the last does.
FIRST = ("session_id", "method", "url", "path", "query_raw", "request_headers", "request_body", "source", "trace_id")
LAST = ("captured_at", "response_status", "response_headers", "response_body", "response_time_ms")


def request_id(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws(":", method, url, F.substring(F.sha2(F.coalesce(body, F.lit("")), 256), 1, 16)), 256)


def endpoint_id(method: Column, template: Column, base: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", method, template, base), 256), 1, 32)


def graphql_id(name: Column, document: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("gql:"), F.coalesce(name, F.lit("")), F.lit(":"), document), 256), 1, 32)


def with_ids(log: DataFrame) -> DataFrame:
    """Add request_id, path_template and endpoint_id."""
    out = log.withColumn("path_template", fold_path("path")).withColumn("request_id", request_id(F.col("method"), F.col("url"), F.col("request_body")))
    return out.withColumn("endpoint_id", endpoint_id(F.col("method"), F.col("path_template"), F.col("base_url")))


def of_session(rows: DataFrame, session: str | None) -> DataFrame:
    """Rows of one session; all rows where none is named. Every reader of the log takes what this gives."""
    return rows if session is None else rows.filter(F.col("session_id") == session)


def pair_requests(events: DataFrame, slices: int = 256) -> DataFrame:
    """Request and response events (kind, url, method, ts, seq, post_data, trace_id) to responses with the request that
    was waiting: the latest before it on the same url and method, unless another response has taken it.

    So a response has a request just if the event before it, of its url and method, is one. Events are looked at in slices
    of the log, each with the last event of its url and method before it, so a hot url is many tasks."""
    ends = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    part = F.floor((F.col("seq") - F.col("lo")) * slices / (F.col("hi") - F.col("lo") + 1)).alias("slice")
    e = events.crossJoin(F.broadcast(ends)).select("seq", "kind", "url", "method", "ts", "post_data", "trace_id", part)  # one row of ends
    event = F.struct("kind", "ts", "post_data", "trace_id")
    last = e.groupBy("url", "method", "slice").agg(F.max_by(event, "seq").alias("v"))
    before = last.withColumn("handed", F.lag("v").over(Window.partitionBy("url", "method").orderBy("slice"))).drop("v")  # a row for each slice
    first = e.groupBy("url", "method", "slice").agg(F.min("seq").alias("seq")).join(before, ["url", "method", "slice"]).select("url", "method", "seq", "handed")
    seen = e.withColumn("prev", F.lag(event).over(Window.partitionBy("url", "method", "slice").orderBy("seq")))
    seen = seen.join(first, ["url", "method", "seq"], "left").withColumn("prev", F.coalesce("prev", "handed"))
    own = F.col("prev.kind").eqNullSafe(F.lit("request"))
    return seen.filter("kind = 'response'").select(
        "seq", "url", "method", F.col("ts").alias("responded_at"), F.when(own, F.col("prev.ts")).alias("requested_at"),
        F.when(own, F.col("prev.post_data")).alias("post_data"), F.when(own, F.col("prev.trace_id")).alias("trace_id"), F.when(own, F.col("ts") - F.col("prev.ts")).alias("response_time_ms"),
    )


def outside_pauses(log: DataFrame, pauses: DataFrame) -> DataFrame:
    """Rows that no pause [paused_at, resumed_at) of their session covers; an open pause lasts."""
    p = pauses.select(F.col("session_id").alias("_s"), "paused_at", F.coalesce("resumed_at", F.lit(2**62)).alias("_end"))
    return log.join(p, (F.col("session_id") == F.col("_s")) & (F.col("captured_at") >= F.col("paused_at")) & (F.col("captured_at") < F.col("_end")), "left_anti")


def split_telemetry(log: DataFrame, url: str = "url", **options) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped rows with their reason)."""
    marked = log.withColumn("drop_reason", filters.telemetry_reason(url, **options))
    return marked.filter("drop_reason is null").drop("drop_reason"), marked.filter("drop_reason is not null")


def dedup_requests(log: DataFrame) -> DataFrame:
    """One row for each request id, over all sessions: what was asked stays as first seen, what was answered as last."""
    rows = log if "request_id" in log.columns else with_ids(log)
    first, last = [c for c in FIRST if c in rows.columns], [c for c in LAST if c in rows.columns]
    g = rows.groupBy("request_id").agg(F.min_by(F.struct(*first), "seq").alias("f"), F.max_by(F.struct(*last), "seq").alias("l"), F.min("seq").alias("seq"), F.max("seq").alias("last_seq"), F.count("*").alias("observations"))
    return g.select("request_id", *[F.col(f"f.{c}") for c in first], *[F.col(f"l.{c}") for c in last], "seq", "last_seq", "observations")


def merged_requests(both: DataFrame) -> DataFrame:
    """Partial results of ``dedup_requests`` as one, for upserts of the request table: rows need seq and last_seq."""
    first, last = [c for c in FIRST if c in both.columns], [c for c in LAST if c in both.columns]
    g = both.groupBy("request_id").agg(
        F.min_by(F.struct(*first), "seq").alias("f"), F.max_by(F.struct(*last), "last_seq").alias("l"), F.min("seq").alias("seq"), F.max("last_seq").alias("last_seq"), F.sum("observations").alias("observations")
    )
    return g.select("request_id", *[F.col(f"f.{c}") for c in first], *[F.col(f"l.{c}") for c in last], "seq", "last_seq", "observations")


def endpoints(log: DataFrame, provenance: Column | None = None) -> DataFrame:
    """Endpoint inventory: first and last seen, number of observations, provenance of the first."""
    rows = log if "endpoint_id" in log.columns else with_ids(log)
    rows = rows.withColumn("provenance", provenance if provenance is not None else (F.col("provenance") if "provenance" in rows.columns else F.lit("network")))
    return rows.groupBy("endpoint_id", "method", "path_template", "base_url").agg(
        F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"), F.count("*").alias("observation_count"),
        F.min_by("provenance", "seq").alias("provenance"), F.min("seq").alias("seq"),
    )


def request_endpoint_map(log: DataFrame) -> DataFrame:
    rows = log if "endpoint_id" in log.columns else with_ids(log)
    return rows.select("request_id", "endpoint_id").distinct()


def endpoints_with_stats(eps: DataFrame, links: DataFrame) -> DataFrame:
    """Endpoints with the number of distinct requests linked to each; counted before the join."""
    n = links.groupBy("endpoint_id").agg(F.count("request_id").alias("request_count"))
    return eps.join(n, "endpoint_id", "left").withColumn("request_count", F.coalesce("request_count", F.lit(0)))


def top_endpoints(eps: DataFrame, n: int = 10) -> DataFrame:
    return eps.orderBy(F.desc("observation_count"), "endpoint_id").limit(n)


def offload_bodies(rows: DataFrame, body: str, kind: str, limit: int = filters.OFFLOAD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows with <body>_path and <body>_size, and no body over the limit; objects by content: path, text)."""
    big = F.octet_length(body) > limit
    path = F.concat(F.lit(f"{kind}-"), F.sha2(body, 256), F.lit(".txt"))
    out = rows.withColumn(f"{body}_path", F.when(big, path)).withColumn(f"{body}_size", F.octet_length(body))
    objects = out.filter(F.col(f"{body}_path").isNotNull()).select(F.col(f"{body}_path").alias("path"), F.col(body).alias("text")).dropDuplicates(["path"])
    return out.withColumn(body, F.when(F.col(f"{body}_path").isNull(), F.col(body))), objects


def read_bodies(rows: DataFrame, objects: DataFrame, body: str) -> DataFrame:
    """Bodies again, from the row or from the object store."""
    return rows.join(objects.select(F.col("path").alias(f"{body}_path"), F.col("text").alias("_text")), f"{body}_path", "left").withColumn(body, F.coalesce(body, "_text")).drop("_text")


def parse_sse(rows: DataFrame, body: str = "response_body", keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Events of server-sent event texts: (keys, pos, event_type, data, event_id); blocks without data are none."""

    def last(lines: Column, prefix: str) -> Column:
        hit = F.filter(lines, lambda x: x.startswith(prefix))
        return F.when(F.size(hit) > 0, F.trim(F.substring(F.element_at(hit, -1), len(prefix) + 1, 1 << 30)))

    blocks = F.filter(F.transform(F.split(body, r"\n\n+"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    b = rows.select(*keys, F.posexplode(blocks).alias("block", "b")).withColumn("lines", F.split("b", "\n"))
    data = F.transform(F.filter("lines", lambda x: x.startswith("data:")), lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), r"^\s+", ""))
    out = b.select(*keys, "block", last(F.col("lines"), "event:").alias("event_type"), data.alias("d"), last(F.col("lines"), "id:").alias("event_id")).filter(F.size("d") > 0)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1
    return out.select(*keys, pos.alias("pos"), "event_type", F.array_join("d", "\n").alias("data"), "event_id")


def sse_streams(rows: DataFrame, events: DataFrame, body: str = "response_body", key: str = "stream_id") -> DataFrame:
    """Roll-up of streams: events, bytes, truncated (over the cap of bytes or of time)."""
    n = events.groupBy(key).agg(F.count("*").alias("event_count"))
    cap = F.octet_length(body) > filters.BODY_LIMIT
    late = (F.col("ended_at") - F.col("started_at") > 60_000) if {"ended_at", "started_at"} <= set(rows.columns) else F.lit(False)
    s = rows.select(key, F.least(F.octet_length(body), F.lit(filters.BODY_LIMIT)).cast("long").alias("byte_count"), F.coalesce(cap | late, F.lit(False)).alias("truncated"))
    return s.join(n, key, "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def ws_frames(frames: DataFrame, payload: str = "payload_text") -> DataFrame:
    """Add payload_size, is_json, message_type and is_subscription to frames."""
    p = F.col(payload)
    is_json = F.coalesce(filters.looks_json(p), F.lit(False))
    return frames.withColumns({
        "payload_size": F.coalesce(F.octet_length(p), F.lit(0)), "is_json": is_json,
        "message_type": F.when(is_json, F.coalesce(F.get_json_object(p, "$.type"), F.get_json_object(p, "$.event"))),
        "is_subscription": is_json & filters.is_graphql_subscription(p),
    })


def ws_sessions(events: DataFrame) -> DataFrame:
    """Lifecycle events (ws_session_id, session_id, url, kind in open, sent, received, close, captured_at) rolled up."""
    at = {k: F.when(F.col("kind") == k, F.col("captured_at")) for k in ("open", "close")}
    g = events.groupBy("ws_session_id").agg(
        F.first("session_id", ignorenulls=True).alias("session_id"), F.first("url", ignorenulls=True).alias("url"), F.min(at["open"]).alias("opened_at"), F.max(at["close"]).alias("closed_at"),
        F.count_if(F.col("kind").isin("sent", "received")).alias("frame_count"),
    )
    return g.withColumn("status", F.when(F.col("closed_at").isNull(), "open").otherwise("closed"))


def valid_sessions(sessions: DataFrame, now_ms: int, max_age_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Latest session of each label, if it can likely be used again."""
    latest = sessions.filter("label is not null").groupBy("label").agg(F.max_by(F.struct("id", "created_at", "cookies", "storage_state"), F.struct("created_at", "id")).alias("s")).select("label", "s.*")
    return latest.withColumn("valid", filters.session_valid("created_at", "cookies", "storage_state", now_ms, max_age_ms))


def delete_sessions(sessions: DataFrame, label: str) -> DataFrame:
    return sessions.filter(~F.col("label").eqNullSafe(F.lit(label)))


def set_endpoint_field(eps: DataFrame, ids: list[str], field: str, value: str) -> DataFrame:
    """Endpoints with a tag or status changed for some ids."""
    old = F.col(field) if field in eps.columns else F.lit(None).cast("string")
    return eps.withColumn(field, F.when(F.col("endpoint_id").isin(*ids), F.lit(value)).otherwise(old))
