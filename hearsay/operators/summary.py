"""Roll-ups: stats, metrics, provenance, families, and the summary of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.tokens import percent
from hearsay.functions.urls import first_segments


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table_name, n): rows of each table; 0 for one that isn't there."""
    out = None
    for name, df in tables.items():
        spark = next(t for t in tables.values() if t is not None).sparkSession
        one = df.agg(F.count("*").alias("n")) if df is not None else spark.range(1).select(F.lit(0).cast("long").alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def provenance_counts(eps: DataFrame) -> DataFrame:
    return eps.filter("provenance is not null").groupBy("provenance").agg(F.count("*").alias("n"))


def route_families(registry: DataFrame, path: str = "canonical_path", n: int = 5) -> DataFrame:
    """The n families (two segments) with the most endpoints, ties as first seen."""
    g = registry.groupBy(first_segments(path, 2).alias("route")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return g.orderBy(F.desc("n"), "seq", "route").limit(n).select("route", "n")


def registry_counts(registry: DataFrame, ws_sessions: int = 0) -> DataFrame:
    """One row: endpoints by protocol and by trust."""
    ws = ~F.col("is_graphql") & F.col("protocol").isin("ws", "wss")
    seen = F.col("trust_state").isin("observed", "discovered")
    return registry.agg(
        F.count_if(~F.col("is_graphql") & ~ws).alias("rest"), F.count_if("is_graphql").alias("graphql"), F.greatest(F.count_if(ws), F.lit(1 if ws_sessions else 0)).alias("websocket"),
        F.count_if(seen).alias("observed"), F.count_if(~seen).alias("inferred"),
    )


def metrics_row(requests: DataFrame, eps: DataFrame, drops: DataFrame, failures: DataFrame, operations: DataFrame, replays: DataFrame) -> DataFrame:
    """One row of counters; crossed tables have one row each."""
    one = requests.agg(F.count("*").alias("raw_requests"))
    one = one.crossJoin(eps.agg(F.count("*").alias("deduplicated_endpoints"), F.count_if(F.col("observation_count") < 3).alias("low")))
    one = one.crossJoin(failures.agg(F.count("*").alias("failed_body_parses"))).crossJoin(drops.agg(F.count("*").alias("filtered_telemetry_count")))
    one = one.crossJoin(operations.agg(F.count("*").alias("graphql_operations"))).crossJoin(replays.agg(F.count("*").alias("_t"), F.count_if(F.col("success") == 1).alias("_s")))
    return one.select(
        "raw_requests", "deduplicated_endpoints", percent(F.col("deduplicated_endpoints") - F.col("low"), F.col("deduplicated_endpoints")).alias("schema_confidence_percent"),
        "failed_body_parses", "filtered_telemetry_count", "graphql_operations", percent(F.col("_s"), F.col("_t")).alias("replay_success_rate_percent"),
    )


def replay_metrics(replays: DataFrame, jobs: DataFrame, dependencies: DataFrame) -> DataFrame:
    one = replays.agg(F.count("*").alias("total_events"), F.count_if(F.col("success") == 1).alias("successful_events"))
    one = one.crossJoin(jobs.agg(F.count("*").alias("total_jobs"))).crossJoin(dependencies.agg(F.count("*").alias("total_dependencies")))
    rate = F.when(F.col("total_events") > 0, F.col("successful_events") / F.col("total_events") * 100).otherwise(F.lit(0.0))
    return one.withColumn("success_rate", rate)


def summarize(requests: DataFrame, eps: DataFrame, operations: DataFrame, registry: DataFrame, flows: DataFrame, chains: DataFrame, ws_sessions: int = 0) -> DataFrame:
    """One row with everything, structs and short arrays as JSON."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(requests, "total_requests").crossJoin(n(eps, "total_endpoints")).crossJoin(n(operations, "graphql_operations")).crossJoin(n(flows, "workflows_discovered")).crossJoin(n(chains, "auth_chains"))
    one = one.crossJoin(registry_counts(registry, ws_sessions))

    def counted(name: str, n: str) -> Column:
        """[{name, count}] as JSON, the most frequent first."""
        rows = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("k"), F.col(name).alias("v"))))
        return F.to_json(F.transform(rows, lambda x: F.struct(x["v"].alias(name), (-x["k"]).alias("count"))))

    families = route_families(registry).agg(counted("route", "n").alias("top_route_families"))
    types = flows.groupBy("type").count().agg(counted("type", "count").alias("workflow_types"))
    via = {v: F.count_if(F.col("viability") == f"{v} replay" if " " not in v else F.col("viability") == v) for v in ("high-risk", "unresolved")}
    replay = flows.agg(
        F.count_if(F.col("viability") == "safely replayable").alias("safely_replayable"), F.count_if(F.col("viability") == "partially replayable").alias("partially_replayable"),
        (via["high-risk"] + via["unresolved"]).alias("dangerous"), F.count_if(F.col("critical_length") > 1).alias("critical_workflow_paths"),
    )
    counts = provenance_counts(eps).agg(*[F.coalesce(F.max(F.when(F.col("provenance") == p, F.col("n"))), F.lit(0)).alias(p) for p in ("runtime_capture", "network", "static_bundle", "persisted_query", "inferred_route")])
    counts = counts.withColumn("runtime_capture", F.when(F.col("runtime_capture") > 0, F.col("runtime_capture")).otherwise(F.col("network"))).drop("network")
    return one.crossJoin(families).crossJoin(types).crossJoin(replay).crossJoin(counts)


def as_json(one: DataFrame) -> DataFrame:
    """The row as one JSON text."""
    return one.select(F.to_json(F.struct(*one.columns)).alias("summary"))


def events_log(rows: DataFrame, event: str, ts: str = "captured_at") -> DataFrame:
    """Rows as log events with their UTC day, for ``write.partitionBy('day').json``."""
    return rows.select(F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd").alias("day"), F.col(ts).alias("ts"), F.lit(event).alias("event"), F.to_json(F.struct(*rows.columns)).alias("data"))
