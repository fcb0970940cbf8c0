"""The same expressions on streams: endpoint counts, request ids once within the watermark, request-response pairing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.ingest import endpoints, with_ids
from hearsay.sources.sinks import merge_table, read_merged

#: How late an observation may be: the widest bucket of temporal scores.
LATE = "2 minutes"


def merged(both: DataFrame) -> DataFrame:
    """Partial endpoint inventories as one."""
    return both.groupBy("endpoint_id", "method", "path_template", "base_url").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("observation_count").alias("observation_count"),
        F.min_by("provenance", "seq").alias("provenance"), F.min("seq").alias("seq"),
    )


def endpoint_stream(log: DataFrame, root: str, checkpoint: str, name: str = "endpoints", trigger: dict | None = None):
    """Keep an endpoint table in step with a stream (``read_endpoints`` reads it). Each batch is aggregated and added as one
    part that has the stream's and the batch's number in its name, so a batch that is replayed after a failure, at whatever
    point, counts once."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, number: int) -> None:
        merge_table(batch.sparkSession, root, name, endpoints(with_ids(batch)), merged, f"{stream}-{number}")

    w = log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_endpoints(spark: SparkSession, root: str, name: str = "endpoints") -> DataFrame:
    """The endpoint table that ``endpoint_stream`` keeps."""
    return read_merged(spark, root, name, merged)


def endpoint_counts(log: DataFrame) -> DataFrame:
    """Running counts for each endpoint, for any sink with complete or update mode."""
    rows = with_ids(log)
    return rows.groupBy("endpoint_id", "method", "path_template", "base_url").agg(F.count("*").alias("observation_count"), F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"))


def once(log: DataFrame, late: str = LATE) -> DataFrame:
    """Each request id once within the watermark."""
    return with_ids(log).withColumn("ts", F.timestamp_millis("captured_at")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def windowed_counts(log: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """Observations for each endpoint and time window; windows close with the watermark."""
    rows = with_ids(log).withColumn("ts", F.timestamp_millis("captured_at")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "endpoint_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "endpoint_id", "n")


PAIR = "url string, method string, responded_at bigint, requested_at bigint, post_data string, trace_id string, response_time_ms bigint"


def pair_stream(events: DataFrame, keep_ms: int = 120_000) -> DataFrame:
    """Responses with their waiting request, by state keyed on (url, method): a later request replaces an earlier one, a
    response takes it. A request is forgotten once the watermark is ``keep_ms`` past it."""
    state = "ts bigint, post_data string, trace_id string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        waiting = held.get if held.exists else None
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.ts, r.kind == "response", r.seq))
        out = []
        for r in rows:
            if r.kind == "request":
                waiting = (int(r.ts), r.post_data, r.trace_id)
                continue
            got = waiting or (None, None, None)
            out.append((key[0], key[1], int(r.ts), got[0], got[1], got[2], None if got[0] is None else int(r.ts) - got[0]))
            waiting = None
        if waiting:
            held.update(waiting)
            held.setTimeoutTimestamp(max(waiting[0] + keep_ms, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        if out:
            names = [c.split()[0] for c in PAIR.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("responded_at", "requested_at", "response_time_ms")})

    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", LATE)
    return timed.groupBy("url", "method").applyInPandasWithState(step, PAIR, state, "append", "EventTimeTimeout")
