"""Workflows: components of the dependency graph, with single requests pooled by kind or path, described and rated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.graph import AUTH_EDGES, Edge, Node, cycles_of, per_component
from hearsay.runtime import cut, large
from hearsay.runtime import numbered as in_order

# Words of a url that make a request an authentication boundary.
AUTH_WORDS = ("login", "auth", "token", "logout")
#: Steps of the search for longest paths inside one strongly connected set of nodes. The problem is exponential there; what
#: ends at this bound is marked ``critical_path_stopped``. Everything outside such sets is exact without a search.
MOST_STEPS = 2_000_000


def members(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Nodes with rank and group: components of several nodes as they are; single nodes pooled as graphql, realtime or by
    the first segment of their path, misc without one."""
    n = nodes.join(comp, "id")
    family = F.concat(F.lit("/"), F.get(F.array_remove(F.split("path", "/"), ""), F.lit(0)))
    single = F.when(F.col("type") == "graphql_operation", F.lit("graphql")).when(F.col("type") == "websocket", F.lit("realtime")).otherwise(F.coalesce(family, F.lit("misc")))
    rank = F.when(F.col("size") > 1, 0).when(F.col("type") == "graphql_operation", 1).when(F.col("type") == "websocket", 2).otherwise(3)
    return n.select(*nodes.columns, rank.alias("rank"), F.when(F.col("size") > 1, F.concat(F.lit("c:"), F.col("component"))).otherwise(F.concat(F.lit("s:"), single)).alias("group"))


def critical_path_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    """The longest path from an entry point and its length; of equals the one along the earliest edges."""
    return [r[:2] for r in marked_path_of(nodes, edges)]


def strong_sets(ids: list[str], out: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected sets of nodes, each after all sets that it leads to (Tarjan's algorithm on a stack of its own)."""
    place: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    first_of: dict[str, int] = {}
    inside: set[str] = set()
    found: list[list[str]] = []
    for root in ids:
        if root in place:
            continue
        todo = [(root, 0)]
        while todo:
            at, k = todo.pop()
            if k == 0:
                place[at] = low[at] = len(place)
                first_of[at] = len(held)
                held.append(at)
                inside.add(at)
            for k in range(k, len(out[at])):  # noqa: B020
                t = out[at][k]
                if t not in place:
                    todo += [(at, k + 1), (t, 0)]
                    break
                if t in inside:
                    low[at] = min(low[at], place[t])
            else:
                if low[at] == place[at]:
                    cut = first_of[at]
                    found.append(held[cut:])
                    inside.difference_update(held[cut:])
                    del held[cut:]
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
    return found


def longest_inside(start: str, out: dict[str, list[str]], members: list[str], tail: dict[str, int], most_steps: int | None = None) -> tuple[int, list[str], str | None, bool]:
    """(length, path inside a strongly connected set, node outside that goes on, whether the search stopped) of the longest
    simple path from ``start``; ``tail`` has the longest lengths from nodes of other sets. Paths are walked in the order
    of edges, and left as soon as what can still be reached is no longer than what was found."""
    number = {m: k for k, m in enumerate(members)}
    near = [0] * len(members)
    exits = [0] * len(members)
    for m, k in number.items():
        for t in out[m]:
            if t in number:
                near[k] |= 1 << number[t]
            else:
                exits[k] = max(exits[k], tail[t])
    most_exit = max(exits)
    by_exit = sorted((x, k) for k, x in enumerate(exits) if x)

    def reach(at: int, seen: int) -> int:
        """No path that goes on from ``at`` past the nodes in ``seen`` has more further nodes than this."""
        got, new = 0, near[at] & ~seen
        while new:
            got |= new
            next_ = 0
            while new:
                bit = new & -new
                next_ |= near[bit.bit_length() - 1]
                new ^= bit
            new = next_ & ~seen & ~got
        last = exits[at]
        for x, k in reversed(by_exit):
            if got >> k & 1:
                last = max(last, x)
                break
        return got.bit_count() + last

    best, path, outside = 1, [start], None
    steps, walk, seen, todo = 0, [start], 1 << number[start], [iter(out[start])]
    while todo:
        t = next(todo[-1], None)
        if t is None:
            todo.pop()
            seen &= ~(1 << number[walk.pop()])
            continue
        if t not in number:
            if len(walk) + tail[t] > best:
                best, path, outside = len(walk) + tail[t], list(walk), t
            continue
        k = number[t]
        if seen >> k & 1:
            continue
        steps += 1
        if most_steps is not None and steps > most_steps:
            return best, path, outside, True
        with_t = seen | 1 << k
        if len(walk) + 1 > best:
            best, path, outside = len(walk) + 1, [*walk, t], None
        elif len(walk) + 1 + len(members) - with_t.bit_count() + most_exit <= best or len(walk) + 1 + reach(k, with_t) <= best:
            continue
        walk.append(t)
        seen = with_t
        todo.append(iter(out[t]))
    return best, path, outside, False


def marked_path_of(nodes: list[Node], edges: list[Edge], most_steps: int | None = MOST_STEPS) -> list[tuple]:
    """The longest path, its length, and 1 if a search stopped at ``most_steps`` (None: never), so that a longer one may exist.

    A path that leaves a strongly connected set never comes back, so longest paths are worked out set by set, those that
    others lead to first: along single nodes by the length and next node of the best way on, and by a search only inside
    sets of several nodes, from where they are entered. Memory is linear in the graph, but for the paths inside sets."""
    ids = [n.id for n in nodes]
    if not ids:
        return []
    inside = set(ids)
    out: dict[str, list[str]] = {i: [] for i in ids}
    fed = set()
    for e in edges:
        fed.add(e.target)
        if e.source in inside and e.target in inside:
            out[e.source].append(e.target)
    entries = [i for i in ids if i not in fed] or ids[:1]
    sets = strong_sets(ids, out)
    where = {m: k for k, members in enumerate(sets) for m in members}
    entered = {t for s in ids for t in out[s] if where[s] != where[t]} | set(entries)
    length: dict[str, int] = {}
    way: dict[str, tuple[list[str], str | None]] = {}
    stopped = False
    for members in sets:
        if len(members) == 1:
            at, best, on = members[0], 0, None
            for t in out[at]:
                if t != at and length[t] > best:
                    best, on = length[t], t
            length[at], way[at] = best + 1, ([at], on)
            continue
        for at in members:
            if at in entered:
                length[at], walked, on, short = longest_inside(at, out, members, length, most_steps)
                way[at], stopped = (walked, on), stopped or short
    first = max(entries, key=lambda e: length[e])  # the first of equals
    path: list[str] = []
    at: str | None = first
    while at is not None:
        walked, at = way[at]
        path += walked
    return [("|".join(path), len(path), int(stopped))]


def walked_of(nodes: list[Node], edges: list[Edge]) -> list[tuple]:
    """What ``marked_path_of`` gives, and 1 if the nodes have a cycle."""
    looped = int(bool(cycles_of(nodes, edges)))
    return [(*r, looped) for r in marked_path_of(nodes, edges)]


def synthesize(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workflows, roles of their nodes).

    Pools of single nodes are only counted and summed, so they may be of any size; a path is walked in components of
    several nodes alone. Roles are rows (workflow, id, entrypoint, auth, critical), not lists.

    Nodes with their group, walks and groups are written once each, so that what reads workflows or roles joins three tables
    and no plan holds another.
    """
    url, method = F.lower(F.coalesce("url", F.lit(""))), F.upper(F.coalesce("method", F.lit("")))

    def has(*words: str):
        out = F.lit(False)
        for w in words:
            out = out | url.contains(w)
        return out

    sent = edges.groupBy(F.col("source").alias("id")).agg(F.bool_or(F.col("dependency_type").isin(*AUTH_EDGES)).alias("auth_edge"), F.bool_or(F.col("source") == F.col("target")).alias("self"))
    inner = edges.select(F.col("target").alias("id")).distinct().withColumn("fed", F.lit(True))
    n = members(nodes, comp).join(sent, "id", "left").join(inner, "id", "left")
    words = has(*AUTH_WORDS) | (F.col("type") == "auth")
    label = (
        F.when(words, "authentication")
        .when(has("upload", "file", "attachment"), "upload")
        .when(has("admin", "dashboard"), "admin")
        .when((F.col("type") == "websocket") | url.startswith("ws") | url.contains("stream"), "realtime")
    )
    n = n.withColumns({
        "entrypoint": F.col("fed").isNull(), "auth": words | F.coalesce("auth_edge", F.lit(False)), "label": label, "method": method,
        "paged": has("limit=", "offset=", "page=", "cursor="), "unresolved": F.col("trust_state").eqNullSafe(F.lit("unresolved")),
    })
    # read four times below, and joined from tables as long as the log
    n = large(cut(n.select("id", "group", "rank", "seq", "method", "entrypoint", "auth", "auth_edge", "self", "label", "paged", "unresolved")))
    walked = per_component(nodes, edges, comp, walked_of, "path string, path_length int, path_stopped int, cyclic int", least_size=2)
    walked = large(cut(walked.select(F.concat(F.lit("c:"), F.col("component")).alias("group"), "path", "path_length", (F.col("path_stopped") == 1).alias("path_stopped"), (F.col("cyclic") == 1).alias("cyclic"))))
    g = n.groupBy("group", "rank").agg(
        F.min("seq").alias("group_order"), F.count("*").alias("n_nodes"), F.count_if("entrypoint").alias("entries"), F.count_if("auth").alias("n_auth"), F.bool_or(F.coalesce("auth_edge", F.lit(False))).alias("auth_edge"), F.bool_or(F.coalesce("self", F.lit(False))).alias("self"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.struct("seq", "id"))).alias("label"), F.bool_or("paged").alias("paged"), F.bool_or("unresolved").alias("unresolved"),
        *[F.bool_or(F.col("method") == x).alias(x.lower()) for x in ("GET", "POST", "DELETE", "PUT", "PATCH")],
        F.count_if(~F.col("auth")).alias("n_plain"),
    )
    g = g.join(_first(n, "head"), "group", "left").join(_first(n.filter(~F.col("auth")), "plain_head"), "group", "left")
    g = large(cut(g))
    # where every node is fed, the first one is the entry point
    only = g.filter("entries = 0").select("group", F.get("head", F.lit(0)).alias("id")).withColumn("only", F.lit(True))
    g = g.join(walked, "group", "left")
    put = F.col("put") | F.col("patch")
    crud = (F.col("get") & (F.col("post") | put)) | F.col("delete") | put
    g = g.withColumn("type", F.when(F.col("auth_edge"), "authentication").otherwise(F.coalesce("label", F.when(F.col("paged"), "pagination"), F.when(crud, "CRUD"), F.lit("unknown"))))
    fallback = F.when(F.col("n_plain") > 1, F.col("plain_head")).otherwise(F.col("head"))
    path = F.when(F.coalesce("path_length", F.lit(1)) > 1, F.split("path", r"\|")).when(F.col("n_nodes") > 1, fallback).otherwise(F.col("head"))
    cyclic = F.coalesce("cyclic", F.lit(False)) | F.col("self")
    g = g.withColumns({"critical_path": path, "n_entrypoints": F.greatest("entries", F.lit(1)), "cycle_participation": cyclic})
    one = (F.col("n_entrypoints") == 1) & (F.size("critical_path") > 1)
    score = F.lit(0.5)
    for when, x in ((one, 0.2), (F.col("n_auth") > 0, 0.1), (F.col("type") != "unknown", 0.1), (F.col("cycle_participation"), 0.05)):
        score = score + F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    g = g.withColumn("confidence", F.least(F.lit(1.0), score))
    risky = F.col("delete") | put
    g = g.withColumn(
        "viability",
        F.when(F.col("unresolved"), "unresolved replay").when(risky, "high-risk replay")
        .when((F.col("confidence") >= 0.8) & (F.col("n_entrypoints") <= 2) & (F.size("critical_path") > 1), "safely replayable")
        .when(F.col("confidence") >= 0.6, "partially replayable").otherwise("unresolved replay"),
    )
    g = g.withColumns({"n_optional": F.col("n_nodes") - F.size("critical_path"), "wf_order": F.struct("rank", "group_order", "group")})
    g = g.withColumns({
        "ambiguous_entrypoints": F.col("n_entrypoints") > 3, "excessive_fanout": F.col("n_optional") > F.size("critical_path") * 3,
        "fragmented": (F.size("critical_path") <= 1) & (F.col("n_optional") == 0),
    })
    flows = g.select(
        "group", "wf_order", "type", "n_nodes", "n_entrypoints", "n_auth", F.array_join("critical_path", "|").alias("critical_path"), F.size("critical_path").alias("critical_length"), "n_optional",
        "cycle_participation", "confidence", "viability", "ambiguous_entrypoints", "excessive_fanout", "fragmented",
        F.coalesce("path_stopped", F.lit(False)).alias("critical_path_stopped"),
    )
    on_path = flows.select("group", F.explode(F.split("critical_path", r"\|")).alias("id")).withColumn("critical", F.lit(True))
    roles = n.select("group", "id", "entrypoint", "auth", "unresolved").join(on_path, ["group", "id"], "left").join(only, ["group", "id"], "left")
    roles = roles.withColumns({"critical": F.coalesce("critical", F.lit(False)), "entrypoint": F.col("entrypoint") | F.coalesce("only", F.lit(False))}).drop("only")
    return flows, roles


def _first(rows: DataFrame, name: str, k: int = 5) -> DataFrame:
    """(group, name): ids of the first k nodes of each group; ranked in 64 parts of a group before the group itself, so
    no task holds a pool."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    near = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("group", "part").orderBy("seq", "id"))).filter(F.col("r") <= k)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("seq", "id"))).filter(F.col("r") <= k)
    return best.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias(name))


def numbered(flows: DataFrame) -> DataFrame:
    """Workflows with their running id wf_1, wf_2 and so on: components first, then the pools, as first seen."""
    return in_order(flows, ["wf_order"], "wf_number").withColumn("id", F.concat(F.lit("wf_"), F.col("wf_number"))).drop("wf_number")


def counts(flows: DataFrame) -> DataFrame:
    """(what, value, n): workflows by type and by viability, and those with a path of several steps."""
    by = flows.select(F.explode(F.array(F.struct(F.lit("type").alias("what"), F.col("type").alias("value")), F.struct(F.lit("viability").alias("what"), F.col("viability").alias("value")))).alias("x"))
    out = by.groupBy("x.what", "x.value").agg(F.count("*").alias("n"))
    return out.unionByName(flows.agg(F.lit("critical_paths").alias("what"), F.lit("").alias("value"), F.count_if(F.col("critical_length") > 1).alias("n")))
