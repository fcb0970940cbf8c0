"""The dependency graph as two tables: nodes (id, type, url, path, method, trust_state, provenance, seq) and edges
(source, target, dependency_type, confidence, temporal_ms, seq). Traversals are joins of a frontier; what depends on the
order of a depth-first walk runs inside one connected component."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearsay.operators.components import connected_components
from hearsay.runtime import cut, large

AUTH_EDGES = ("token", "cookie", "session", "authorization")
NODE = "id string, type string, url string, path string, method string, trust_state string, provenance string, seq bigint"
EDGE = "source string, target string, dependency_type string, confidence double, temporal_ms bigint, seq bigint"


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id, the first of each."""
    both = nodes.unionByName(new, allowMissingColumns=True)
    cols = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.min_by(F.struct(*cols), "seq").alias("v")).select("id", *[F.col(f"v.{c}").alias(c) for c in cols])


def complete(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, with a node of type request for each end of an edge that has none."""
    ends = edges.select(F.col("source").alias("id"), "seq").unionByName(edges.select(F.col("target").alias("id"), "seq"))
    missing = ends.groupBy("id").agg((F.min("seq") + F.lit(1 << 40)).alias("seq")).join(nodes, "id", "left_anti")
    return nodes.unionByName(missing.withColumn("type", F.lit("request")), allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``gone`` (id) and without their edges."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = large(nodes.select("id"))
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def from_tables(requests: DataFrame, operations: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of requests (id, url, path, method, seq), GraphQL operations (id, endpoint_url) and dependencies."""
    ws = F.coalesce(F.col("url").rlike("^wss?://"), F.lit(False))
    nodes = requests.select("id", F.when(ws, "websocket").otherwise("request").alias("type"), "url", "path", "method", F.lit("observed").alias("trust_state"), F.lit("runtime_capture").alias("provenance"), "seq")
    if operations is not None:
        ops = operations.select(
            F.concat(F.lit("gql_"), F.col("id")).alias("id"), F.lit("graphql_operation").alias("type"), F.coalesce("endpoint_url", F.lit("/graphql")).alias("url"), F.lit(None).cast("string").alias("path"),
            F.lit("POST").alias("method"), F.lit("observed").alias("trust_state"), F.lit("runtime_capture").alias("provenance"), (F.xxhash64("id") % (1 << 30) + (1 << 41)).alias("seq"),
        )
        nodes = nodes.unionByName(ops)
    return nodes, known_edges(nodes, edges)


def turned(edges: DataFrame, direction: str) -> DataFrame:
    e = edges.select("source", "target", "seq")
    return e if direction == "downstream" else e.select(F.col("target").alias("source"), F.col("source").alias("target"), "seq")


def bfs(edges: DataFrame, start: str, direction: str = "downstream", most_levels: int = 10_000) -> DataFrame:
    """(node, level, position, parent): the order of a breadth-first walk, edges in their order. One join a level."""
    spark = edges.sparkSession
    e = turned(edges, direction)
    seen = spark.createDataFrame([(start, 0, 0, None)], "node string, level int, position bigint, parent string")
    frontier = seen
    for level in range(1, most_levels):
        step = frontier.select(F.col("node").alias("source"), F.col("position").alias("p")).join(e, "source")
        new = step.groupBy("target").agg(F.min(F.struct("p", "seq", "source")).alias("b")).join(seen.select(F.col("node").alias("target")), "target", "left_anti")
        ranked = new.select(F.col("target").alias("node"), F.lit(level).alias("level"), F.struct("b.p", "b.seq", "target").alias("o"), F.col("b.source").alias("parent"))
        frontier = cut(_positions(ranked))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier.withColumn("position", F.col("position") + seen.count())))
        frontier = seen.filter(F.col("level") == level)
    raise RuntimeError("the walk is deeper than most_levels")


def _positions(rows: DataFrame) -> DataFrame:
    # positions within one level of a walk from one node
    return rows.select("node", "level", (F.row_number().over(Window.partitionBy("level").orderBy("o")) - 1).cast("long").alias("position"), "parent")


def preorder_of(nodes: list[Node], edges: list[Edge], start: str | None = None, direction: str = "downstream") -> list[tuple]:
    """(id, position) of a depth-first walk, edges in their order, on a stack of its own; from the first node if no start is given."""
    out: dict[str, list[str]] = {}
    for e in edges:
        a, b = (e.source, e.target) if direction == "downstream" else (e.target, e.source)
        out.setdefault(a, []).append(b)
    todo, seen = [start if start is not None else nodes[0].id], {}
    while todo:
        at = todo.pop()
        if at not in seen:
            seen[at] = len(seen)
            todo += reversed(out.get(at, ()))
    return list(seen.items())


def dfs(nodes: DataFrame, edges: DataFrame, comp: DataFrame, start: str | None = None, direction: str = "downstream") -> DataFrame:
    """(component, id, position): depth-first walk in preorder from ``start``, or from the first node of every component."""
    if start is not None:
        comp = comp.join(comp.filter(F.col("id") == start).select("component"), "component", "left_semi")
    return per_component(nodes, edges, comp, lambda n, e: preorder_of(n, e, start, direction), "id string, position int")


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str] | None:
    """Node ids of a shortest path, along the earliest edges; None if there is none. The path, not the walk, is collected."""
    if source == target:
        return [source]
    walk = bfs(edges, source)
    out, at = [target], walk.filter(F.col("node") == target).select("parent").first()
    while at is not None and at[0] is not None:
        out.append(at[0])
        at = walk.filter(F.col("node") == at[0]).select("parent").first()
    return out[::-1] if out[-1] == source else None


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "downstream", most_rounds: int = 10_000) -> DataFrame:
    """(root, node): all that each start (id) reaches, itself included; one round for each step of the longest walk."""
    e = turned(edges, direction)
    pairs = cut(starts.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct())
    frontier = pairs
    for _ in range(most_rounds):
        step = frontier.join(e.select(F.col("source").alias("node"), "target").distinct(), "node").select("root", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(pairs, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return pairs
        pairs = cut(pairs.unionByName(frontier))
    raise RuntimeError("reachability has not settled")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the least (seq, id) order number of its nodes, so components sort as first seen."""
    found = connected_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")), broadcast=False).withColumnRenamed("node", "id")
    tagged = nodes.select("id", "seq").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = tagged.groupBy("component").agg(F.min("seq").alias("first_seq"), F.count("*").alias("size"))
    return tagged.join(large(first), "component").select("id", "component", "first_seq", "size")


class Node(NamedTuple):
    id: str
    type: str
    url: str | None
    path: str | None
    method: str | None
    trust_state: str | None


class Edge(NamedTuple):
    source: str
    target: str
    dependency_type: str
    temporal_ms: int


def per_component(nodes: DataFrame, edges: DataFrame, comp: DataFrame, fn: Callable[[list[Node], list[Edge]], list[tuple]], schema: str, least_size: int = 1) -> DataFrame:
    """Run ``fn(nodes, edges)`` of each component of ``least_size`` nodes or more, both in the order of seq. Only for what
    needs a walk in order. Components are told apart while sorted rows stream by, so a task holds one at a time."""
    import pyarrow as pa

    null = F.lit(None).cast("string")
    chosen = large(comp.filter(F.col("size") >= least_size).select("id", "component"))
    n = nodes.join(chosen, "id").select("component", F.lit(0).alias("_kind"), "seq", "id", "type", "url", "path", "method", "trust_state", null.alias("target"), null.alias("dependency_type"), F.lit(0).cast("long").alias("temporal_ms"))
    e = edges.join(chosen.withColumnRenamed("id", "source"), "source")
    e = e.select("component", F.lit(1).alias("_kind"), "seq", F.col("source").alias("id"), *[null.alias(c) for c in ("type", "url", "path", "method", "trust_state")], "target", "dependency_type", "temporal_ms")
    dealt = n.unionByName(e).repartition("component").sortWithinPartitions("component", "_kind", "seq", "id")
    full = T.StructType.fromDDL(f"component string, {schema}")
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    kinds = [arrow[f.dataType.simpleString()] for f in full.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, ns, es = None, [], [], []
        for b in batches:
            for component, kind, _, i, type_, url, path, method, trust, target, dep, ms in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if component != key:
                    if ns:
                        found += [(key, *r) for r in fn(ns, es)]
                    key, ns, es = component, [], []
                if kind == 0:
                    ns.append(Node(i, type_, url, path, method, trust))
                else:
                    es.append(Edge(i, target, dep, ms))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=full.names)
                found = []
        if ns and (found := [(key, *r) for r in fn(ns, es)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=full.names)

    return dealt.mapInArrow(run, full)


def _out(edges: list[Edge]) -> dict[str, list[Edge]]:
    out: dict[str, list[Edge]] = {}
    for e in edges:
        out.setdefault(e.source, []).append(e)
    return out


def auth_chains_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    follows = {k: v[0].target for k, v in _out([e for e in edges if e.dependency_type in AUTH_EDGES]).items()}
    auth = {n.id for n in nodes if n.type == "auth"}
    used: set[str] = set()
    chains = []
    for start in (n.id for n in nodes):
        if start in used or not (start in follows or start in auth):
            continue
        chain, at = [], start
        while at is not None and at not in used:
            used.add(at)
            chain.append(at)
            at = follows.get(at)
        if len(chain) > 1 or start in auth:
            chains.append((start, len(chain), "|".join(chain)))
    return chains


def auth_chains(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Chains of authentication edges, each node in one chain, the first edge of a node followed. A node without edges is
    a chain if it is of type auth."""
    walked = per_component(nodes, edges, comp, auth_chains_of, "start string, length int, chain string", least_size=2)
    alone = nodes.filter("type = 'auth'").select("id").join(comp.filter("size = 1"), "id")
    return walked.unionByName(alone.select("component", F.col("id").alias("start"), F.lit(1).alias("length"), F.col("id").alias("chain")))


def cycles_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    """One record for each back edge of a depth-first walk (kept on a stack of its own, so depth has no limit)."""
    out = _out(edges)
    kind = {n.id: n.type for n in nodes}
    done, place, found = set(), {}, []
    for root in kind:
        if root in done:
            continue
        path, todo = [root], [iter(out.get(root, ()))]
        done.add(root)
        place[root] = 0
        while todo:
            e = next(todo[-1], None)
            if e is None:
                todo.pop()
                del place[path.pop()]
            elif e.target not in done:
                done.add(e.target)
                place[e.target] = len(path)
                path.append(e.target)
                todo.append(iter(out.get(e.target, ())))
            elif e.target in place:
                loop = path[place[e.target] :]
                if kind.get(e.target) == "auth" or e.dependency_type == "token":
                    what = "auth_refresh"
                elif kind.get(e.target) == "websocket":
                    what = "websocket_stream"
                elif 0 <= e.temporal_ms < 15_000 and len(loop) <= 3:
                    what = "polling"
                else:
                    what = "unknown"
                found.append((what, len(loop), "|".join(loop)))
    return found


def cycles(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Cycles of all components with an edge."""
    linked = edges.select(F.col("source").alias("id")).distinct().join(comp, "id").select("component").distinct()
    return per_component(nodes, edges, comp.join(linked, "component", "left_semi"), cycles_of, "kind string, length int, path string")


def clusters_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    out = _out(edges)
    kind, path = {n.id: n.type for n in nodes}, {n.id: n.path for n in nodes}
    left, made = list(kind), []
    gql = [i for i in left if kind[i] == "graphql_operation"]
    if gql:
        made.append(("graphql_cluster", gql))
        left = [i for i in left if kind[i] != "graphql_operation"]
    auth = [i for i in left if kind[i] == "auth"]
    if auth:
        inside, group, queue = set(left), dict.fromkeys(auth), list(auth)
        while queue:
            for e in out.get(queue.pop(0), ()):
                if e.target not in group and e.target in kind:
                    group[e.target] = None
                    queue.append(e.target)
        group = [i for i in group if i in inside]
        made.append(("auth_boundary_cluster", group))
        left = [i for i in left if i not in set(group)]
    families: dict[str, list[str]] = {}
    rest = []
    for i in left:
        if path[i]:
            families.setdefault("/".join(path[i].split("/")[:3]), []).append(i)
        else:
            rest.append(i)
    for members in families.values():
        if len(members) > 1:
            made.append(("route_family_cluster", members))
        else:
            rest += members
    if rest:
        made.append(("temporal_cluster", rest))
    return [(k, n, len(m), "|".join(m)) for n, (k, m) in enumerate(made)]


def clusters(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Clusters of each component; number counts within it, and (first_seq of the component, number) orders all."""
    return per_component(nodes, edges, comp, clusters_of, "kind string, number int, size int, members string")


def metrics(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """One row: counts, density, mean number of nodes that a root reaches, chains, cycles and components."""
    roots = nodes.select("id").join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    depth = reachable(edges, roots).groupBy("root").count().agg(F.coalesce(F.avg("count"), F.lit(0.0)).alias("average_chain_depth"))
    one = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    one = one.crossJoin(depth).crossJoin(auth_chains(nodes, edges, comp).agg(F.count("*").alias("auth_chain_count"))).crossJoin(cycles(nodes, edges, comp).agg(F.count("*").alias("cycle_count")))
    one = one.crossJoin(comp.agg(F.countDistinct("component").alias("connected_components")))
    n = F.col("node_count").cast("double")
    return one.withColumn("graph_density", F.when(n > 1, F.col("edge_count") / (n * (n - 1))).otherwise(F.lit(0.0)))
