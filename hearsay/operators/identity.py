"""One trusted identity for endpoints that several sources have found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import urls

# Provenance by trust, strongest first.
OBSERVED = ("runtime_capture", "runtime_confirmed", "network")
DISCOVERED = ("static_bundle", "source_map", "persisted_query")
INFERRED = ("inferred_route", "inferred_operation")


def trust_rank(provenance: Column) -> Column:
    return F.when(provenance.isin(*OBSERVED), 3).when(provenance.isin(*DISCOVERED), 2).when(provenance.isin(*INFERRED), 1).otherwise(0)


def trust_state(rank: Column) -> Column:
    return F.when(rank == 3, "observed").when(rank == 2, "discovered").when(rank == 1, "inferred").otherwise("unresolved")


def canonical_columns(rows: DataFrame) -> DataFrame:
    """rows (seq, method, url, provenance, is_graphql, confidence) with canonical_id, canonical_path, canonical_method,
    origin, protocol and graphql."""
    protocol = urls.protocol_of("url")
    raw = F.when(F.col("url").rlike("^(?:http|ws)") & urls.is_absolute("url"), urls.pathname("url")).otherwise(F.col("url"))
    path = urls.normalize_path(raw)
    final = F.when(F.col("is_graphql") | path.endswith("/graphql"), "/graphql").otherwise(path)
    method = F.when(F.col("is_graphql"), "POST").otherwise(F.upper("method"))
    return rows.withColumns({
        "canonical_path": final, "canonical_method": method, "canonical_id": urls.canonical_id(method, final), "origin": urls.origin_of("url"), "protocol": protocol,
        "graphql": F.col("is_graphql") & ~protocol.isin("ws", "wss"),
    })


def resolve(rows: DataFrame) -> DataFrame:
    """The registry: one row for each canonical endpoint, merged in the order of seq. All merges combine before the
    shuffle, so an endpoint with a third of all observations is a few partial rows."""
    r = canonical_columns(rows)
    secure = F.max_by("protocol", F.when(F.col("protocol").isin("https", "wss"), F.col("seq")))
    known = F.min_by("protocol", F.when(F.col("protocol") != "unknown", F.col("seq")))
    merged = r.groupBy("canonical_id", "canonical_path", "canonical_method").agg(
        F.array_sort(F.collect_set("provenance")).alias("provenance_set"), F.max(trust_rank(F.col("provenance"))).alias("rank"), F.max("confidence").alias("confidence"),
        F.bool_or("graphql").alias("is_graphql"), F.coalesce(F.min_by("origin", F.when(F.col("origin") != "", F.col("seq"))), F.lit("")).alias("origin"),
        F.coalesce(secure, known, F.lit("unknown")).alias("protocol"), F.count("*").alias("merged"), F.min("seq").alias("seq"),
    )
    return merged.withColumn("trust_state", trust_state(F.col("rank"))).drop("rank")


def merged_metadata(rows: DataFrame) -> DataFrame:
    """(canonical_id, key, value): the last value of each metadata key of an endpoint; rows carry a map ``metadata``."""
    r = canonical_columns(rows).select("canonical_id", "seq", F.explode("metadata").alias("key", "value"))
    return r.groupBy("canonical_id", "key").agg(F.max_by("value", "seq").alias("value"))


def origin_conflicts(rows: DataFrame) -> DataFrame:
    """Endpoints that were seen under more than one origin."""
    r = canonical_columns(rows).filter("origin <> ''")
    return r.groupBy("canonical_id").agg(F.array_sort(F.collect_set("origin")).alias("origins")).filter(F.size("origins") > 1)


def _endpoint_nodes(nodes: DataFrame) -> DataFrame:
    kinds = F.col("type").isin("request", "graphql_operation", "websocket") & (F.coalesce(F.col("url"), F.lit("")) != "")
    return nodes.filter(kinds).select(
        "id", "seq", F.coalesce("method", F.lit("GET")).alias("method"), "url", F.coalesce("provenance", F.lit("runtime_capture")).alias("provenance"),
        (F.col("type") == "graphql_operation").alias("is_graphql"), F.lit(1.0).alias("confidence"),
    )


def merged_from(nodes: DataFrame) -> DataFrame:
    """(new_id, id, seq): which nodes ``unify_graph`` makes one, a row each."""
    return canonical_columns(_endpoint_nodes(nodes)).select(F.concat(F.lit("canonical_"), F.col("canonical_id")).alias("new_id"), "id", "seq")


def unify_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, url, method, provenance, seq) and edges with equal endpoints made one canonical node, with the number
    of nodes that it was made of (``merged``).

    Parallel edges stay, edges inside an endpoint become loops; the data of a merged node are kept also where the
    order of the steps would lose them.
    """
    seen, ids = _endpoint_nodes(nodes), merged_from(nodes).select("id", "new_id")
    made = resolve(seen).select(
        F.concat(F.lit("canonical_"), F.col("canonical_id")).alias("id"), F.when(F.col("is_graphql"), "graphql_operation").otherwise("request").alias("type"), F.col("canonical_path").alias("url"),
        F.col("canonical_method").alias("method"), "trust_state", F.array_join("provenance_set", ",").alias("provenance"), "seq", "merged",
    )
    rest = nodes.join(ids, "id", "left_anti")
    out_nodes = made.unionByName(rest, allowMissingColumns=True)
    a, b = ids.select(F.col("id").alias("source"), F.col("new_id").alias("_s")), ids.select(F.col("id").alias("target"), F.col("new_id").alias("_t"))
    out_edges = edges.join(a, "source", "left").join(b, "target", "left").withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t")
    return out_nodes, out_edges
