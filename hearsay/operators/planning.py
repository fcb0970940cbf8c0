"""What to explore next, and in which order to replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.graph import Edge, Node, per_component
from hearsay.runtime import cut

TARGET = ("id", "type", "priority", "rationale", "safety", "n_prerequisites", "metadata", "seq")


def _failures(rows: DataFrame, key: Column, failures: DataFrame | None) -> DataFrame:
    if failures is None:
        return rows.withColumn("failures", F.lit(0).cast("long"))
    n = failures.groupBy(F.col("target_id").alias("_f")).agg(F.count("*").alias("failures"))
    return rows.join(n, key == F.col("_f"), "left").drop("_f").withColumn("failures", F.coalesce("failures", F.lit(0)))


def _target(rows: DataFrame, **cols: Column) -> DataFrame:
    kinds = {"priority": "int", "n_prerequisites": "bigint", "metadata": "string", "seq": "bigint"}
    return rows.select(*[cols[c].cast(kinds.get(c, "string")).alias(c) for c in TARGET])


def endpoint_targets(registry: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Endpoints that were never observed, by trust, protocol and risk of their method."""
    r = _failures(registry.filter(F.col("trust_state") != "observed"), F.col("canonical_id"), failures)
    r = r.filter((F.col("failures") <= 3) & ~((F.col("trust_state") == "discovered") & (F.col("confidence") < 0.6)))
    base = F.when(F.col("trust_state") == "unresolved", 40).when(F.col("trust_state") == "discovered", 30).otherwise(50)
    risky = F.col("canonical_method").isin("DELETE", "PUT", "PATCH")
    priority = base + F.when(F.col("is_graphql"), 20).otherwise(0) - F.when(risky, 20).when(F.col("canonical_method") == "POST", 5).otherwise(0) - F.col("failures") * 15
    why = (
        F.when(F.col("is_graphql"), "Unresolved GraphQL operation")
        .when(F.col("trust_state") == "unresolved", "Unresolved trust state endpoint")
        .when(F.col("trust_state") == "discovered", "High-confidence static endpoint requiring validation")
        .otherwise("Inferred endpoint needing confirmation")
    )
    return _target(
        r, id=F.col("canonical_id"), type=F.when(F.col("is_graphql"), "graphql_operation").otherwise("endpoint"), priority=priority, rationale=why,
        safety=F.when(risky, "dangerous").when(F.col("canonical_method") == "POST", "caution").otherwise("safe"), n_prerequisites=F.lit(0),
        metadata=F.to_json(F.struct(F.col("canonical_path").alias("path"), F.col("canonical_method").alias("method"))), seq=F.col("seq"),
    ).filter("priority > 0")


def workflow_targets(flows: DataFrame, roles: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Workflows (with id) that can't be replayed safely yet. Failures may be recorded under the workflow or its target.
    Their prerequisites, of which ``synthesize`` has the number, are rows of ``prerequisites``."""
    w = flows.filter(F.col("viability").isin("partially replayable", "unresolved replay"))
    if failures is not None:
        failures = failures.withColumn("target_id", F.regexp_replace("target_id", "^explore_wf_", ""))
    w = _failures(w, F.col("id"), failures).filter("failures <= 2")
    fan = F.col("n_optional") > F.col("critical_length") * 2
    return _target(
        w, id=F.concat(F.lit("explore_wf_"), F.col("id")), type=F.lit("workflow_branch"), priority=60 + F.when(fan, 10).otherwise(0) - F.col("failures") * 20,
        rationale=F.concat(F.lit("Partially replayable workflow requiring exploration"), F.when(fan, " with high fanout potential").otherwise("")),
        safety=F.when(F.col("viability") == "unresolved replay", "caution").otherwise("safe"), n_prerequisites=F.col("n_entrypoints") if roles is not None else F.lit(0),
        metadata=F.to_json(F.struct(F.col("type").alias("workflowType"), F.col("n_optional").alias("branches"))), seq=F.col("wf_order.group_order") + (1 << 42),
    ).filter("priority > 0")


def prerequisites(flows: DataFrame, roles: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(target_id, prerequisite): every entry point of the workflows that are targets, one row each; a pool may have any number."""
    chosen = workflow_targets(flows, None, failures).select(F.col("id").alias("target_id"))
    named = flows.select("group", F.concat(F.lit("explore_wf_"), F.col("id")).alias("target_id")).join(chosen, "target_id", "left_semi")
    return roles.filter("entrypoint").select("group", F.col("id").alias("prerequisite")).join(named, "group").select("target_id", "prerequisite")


def disconnected_target(nodes: DataFrame, comp: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """The first component without an observed node, if there are several components."""
    c = comp.join(nodes.select("id", "trust_state"), "id").groupBy("component").agg(
        F.min("first_seq").alias("first_seq"), F.count("*").alias("n"), F.bool_and(~F.col("trust_state").eqNullSafe(F.lit("observed"))).alias("dark")
    )
    top = c.agg(F.count("*").alias("all"), F.min_by(F.struct("component", "n"), F.when(F.col("dark"), F.struct("first_seq", "component"))).alias("c")).filter("`all` > 1 and c is not null")
    if failures is not None:
        failures = failures.withColumn("target_id", F.regexp_replace("target_id", "^explore_", ""))
    top = _failures(top, F.lit("disconnected_region"), failures).filter("failures <= 2")
    return _target(
        top, id=F.lit("explore_disconnected_region"), type=F.lit("disconnected_region"), priority=75 - F.col("failures") * 20, rationale=F.lit("Fragmented graph region requires exploration to bridge connectivity"),
        safety=F.lit("caution"), n_prerequisites=F.lit(0), metadata=F.to_json(F.struct(F.col("c.n").alias("nodesCount"))), seq=F.lit(1 << 43),
    )


def family_targets(registry: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Route families of several endpoints of which none was observed."""
    route = F.array_join(F.slice(F.split("canonical_path", "/"), 1, 3), "/")
    f = registry.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.bool_and(F.col("trust_state") != "observed").alias("dark"), F.min("seq").alias("seq")).filter("dark and n > 1")
    f = _failures(f, F.concat(F.lit("explore_route_family_"), F.col("route")), failures)
    return _target(
        f, id=F.concat(F.lit("explore_route_family_"), F.col("route")), type=F.lit("route_family"), priority=65 - F.col("failures") * 15, rationale=F.lit("Unexplored route family with multiple candidate endpoints"),
        safety=F.lit("safe"), n_prerequisites=F.lit(0), metadata=F.to_json(F.struct("route", F.col("n").alias("count"))), seq=F.col("seq") + (1 << 44),
    ).filter("priority > 0")


def exploration_plan(registry: DataFrame, nodes: DataFrame, comp: DataFrame, flows: DataFrame, roles: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """All targets, the most urgent first; ties in the order in which they were found."""
    parts = (endpoint_targets(registry, failures), workflow_targets(flows, roles, failures), disconnected_target(nodes, comp, failures), family_targets(registry, failures))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("priority"), "seq", "id")


# --- replay


def replay_order_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    """First in, first out over nodes whose sources are all done; nodes of a cycle follow in their own order."""
    ids = [n.id for n in nodes]
    waits = dict.fromkeys(ids, 0)
    out: dict[str, list[str]] = {i: [] for i in ids}
    for e in edges:
        if e.source in out and e.target in waits:
            out[e.source].append(e.target)
            waits[e.target] += 1
    queue = [i for i in ids if not waits[i]]
    for at in queue:  # grows while it is read
        for t in out[at]:
            waits[t] -= 1
            if not waits[t]:
                queue.append(t)
    done = set(queue)
    return [(i, k) for k, i in enumerate([*queue, *(i for i in ids if i not in done)])]


def replay_order(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, id, position): the order of replay of each component; components don't depend on each other."""
    walked = per_component(nodes, edges, comp, replay_order_of, "id string, position int", least_size=2)
    return walked.unionByName(comp.filter("size = 1").select("component", "id", F.lit(0).alias("position")))


def replay_levels(nodes: DataFrame, edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(id, level): requests that can be replayed side by side, by peeling; null for those on or behind a cycle."""
    left, e, out = cut(nodes.select("id")), edges.select("source", "target"), None
    for level in range(most_levels):
        ready = cut(left.join(e.select(F.col("target").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            tail = left.withColumn("level", F.lit(None).cast("int"))
            return tail if out is None else out.unionByName(tail)
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready, "id", "left_anti"))
        e = cut(e.join(ready.select(F.col("id").alias("source")), "source", "left_anti"))
    raise RuntimeError("more levels than most_levels")


def auth_propagation(edges: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(source, targets, n_targets, extraction rule): where tokens and cookies of a request go."""
    e = edges.filter(F.col("dependency_type").isin("token", "cookie"))
    if requests is not None:
        ids = requests.select("id")
        e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    g = e.groupBy("source").agg(F.count("*").alias("n_targets"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "target"))), lambda x: x["target"]), "|").alias("targets"))
    return g.withColumns({"source_field": F.lit("response.body.token"), "target_header": F.lit("Authorization")})


def replay_plan(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Order, authentication and group (one default group) of each request in one table."""
    auth = auth_propagation(edges).select(F.col("source").alias("id"), F.col("targets").alias("auth_targets"))
    return replay_order(nodes, edges, comp).join(auth, "id", "left").withColumn("replay_group", F.lit("default"))


def new_jobs(spark, ids: list[str], now_ms: int) -> DataFrame:
    return spark.createDataFrame([(i, "queued", now_ms, now_ms) for i in ids], "id string, status string, created_at bigint, updated_at bigint")


def update_job(jobs: DataFrame, job: str, status: str, now_ms: int) -> DataFrame:
    hit = F.col("id") == job
    return jobs.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_at"))})


def replay_events(outcomes: DataFrame, job: str, provenance: str, now_ms: int) -> DataFrame:
    """Events of a job, from outcomes (original_request_id, replay_request_id, status_code, success, latency_ms). The id is
    a hash of what the event says, so recording it again after a failure gives the same row."""
    who = F.sha2(F.concat_ws(":", F.lit(job), F.col("original_request_id"), F.coalesce("replay_request_id", F.lit("")), F.lit(str(now_ms))), 256)
    return outcomes.select(
        who.alias("id"), F.lit(job).alias("job_id"), "original_request_id", "replay_request_id", F.col("status_code").cast("int").alias("status_code"),
        F.coalesce(F.col("success"), F.lit(False)).cast("int").alias("success"), F.col("latency_ms").cast("bigint").alias("latency_ms"), F.lit(now_ms).cast("bigint").alias("captured_at"), F.lit(provenance).alias("provenance"),
    )


def replay_dependencies(found: DataFrame) -> DataFrame:
    """Stored form of dependencies (source_id, target_id, dependency_type, confidence, further columns): the further columns
    are the evidence, as JSON, null where there are none. The id is a hash of the first three; confidence is 1 if null."""
    own = ("source_id", "target_id", "dependency_type", "confidence")
    more = [c for c in found.columns if c not in own]
    evidence = F.to_json(F.struct(*more)) if more else F.lit(None).cast("string")
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in found.columns else F.lit(1.0)
    return found.select(
        F.sha2(F.concat_ws(":", "source_id", "target_id", "dependency_type"), 256).alias("id"), F.col("source_id").alias("source_request_id"), F.col("target_id").alias("target_request_id"),
        "dependency_type", confidence.alias("confidence"), evidence.alias("evidence"),
    )


def dependencies_of(edges: DataFrame, target: str) -> DataFrame:
    return edges.filter(F.col("target") == target)
