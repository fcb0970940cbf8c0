"""Operators on small literal tables and random graphs, against plain restatements of their rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hearsay import runtime
from hearsay.functions import filters, tokens, urls
from hearsay.operators import bundles, dependencies, graph, graphql, identity, ingest, planning, schema, summary, workflows
from hearsay.operators.components import connected_components
from hearsay.plans import catalog
from hearsay.plans import vectors as V
from hearsay.sources import observations, sinks
from hearsay.streaming import endpoints as stream


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- functions


def test_url_corners(spark):
    u = F.lit("HTTPS://user:pw@Example.COM:443/a?b=1#c")
    r = one(spark, urls.base_url(u), urls.pathname(u), urls.query(u), urls.hostname(u), urls.base_url(F.lit("nope")), urls.pathname(F.lit("nope")), urls.query(F.lit("http://a/?")))
    assert list(r) == ["https://example.com", "/a", "?b=1", "example.com", "", "/", None]


def test_normalize_path_folds_every_other_number(spark):
    r = one(spark, urls.normalize_path(F.lit("/1/2/3")), urls.normalize_path(F.lit("x/9/?q=1")), urls.normalize_path(F.lit(f"/a/{V.UUID}")), urls.path_parameters(F.lit("/a/{x}/{y}")))
    assert list(r) == ["/:id/2/:id", "/x/:id", "/a/:id", ["x", "y"]]


def test_parameters(spark):
    got = one(spark, urls.query_parameters(F.lit("?a=1&a=2&b=x+y%20z&c&=e")))[0]
    assert [(p.name, p.value) for p in got] == [("a", "2"), ("b", "x y z"), ("c", ""), ("", "e")]
    cases = {("PAGE", "1"): "pagination", ("sortBy", ""): "sorting", ("q", ""): "filter", ("include", ""): "field_selection", ("z", V.UUID): "identifier", ("z", "2024-01-02"): "temporal", ("z", "true"): "boolean", ("z", "2024-99-99"): "unknown"}
    for (n, v), want in cases.items():
        assert one(spark, urls.parameter_class(F.lit(n), F.lit(v)))[0] == want


def test_string_formats(spark):
    cases = {V.UUID: "uuid", "2024-01-02": "date", "2024-01-02T03:04:05Z": "date-time", "a@b.co": "email", "HTTP://x": "uri", "1.2.3.4": "ipv4", "plain": None}
    for v, want in cases.items():
        assert one(spark, tokens.string_format(F.lit(v)))[0] == want


def test_scores(spark):
    t = [one(spark, tokens.temporal_score(F.lit(0), F.lit(x)))[0] for x in (5000, 5001, 30001, 120001)]
    f = [one(spark, tokens.frequency_score(F.lit(x)))[0] for x in (1, 5, 6, 21)]
    assert t == [0.1, 0.0, -0.1, -0.2] and f == [0.1, 0.0, -0.1, -0.3]
    assert one(spark, tokens.percent(F.lit(1), F.lit(3)), tokens.percent(F.lit(1), F.lit(0)))[:] == (33.3, None)


def test_telemetry_options(spark):
    d = spark.createDataFrame([("https://a.com/api/x", "https://a.com"), ("https://b.com/api/x", "https://a.com"), ("bad", "https://a.com"), ("https://a.com/other", "https://a.com")], "url string, origin string")
    got = [r[0] for r in d.select(filters.telemetry_reason("url", "origin", same_origin=True, path_prefixes=("/API",))).collect()]
    assert got == [None, "allow_same_origin", "allow_same_origin", "allow_path_prefix"]


def test_graphql_request(spark):
    cases = [("/x", '{"query":"{a}"}', True), ("/GraphQL", None, True), ("/x", "[]", False), ("/x", '[{"query":"{a}"},{"x":1}]', False), ("/x", '{"extensions":{"persistedQuery":{"a":1}}}', True), ("/x", None, False)]
    for p, b, want in cases:
        assert one(spark, filters.is_graphql_request(F.lit(p), F.lit(b).cast("string")))[0] is want


def test_body_cap(spark):
    assert one(spark, F.octet_length(filters.capped_body(F.lit("é" * 10), 6)))[0] == 6


# --- ingest


def test_bodies_round_trip(spark):
    d = spark.createDataFrame([(1, "x" * 50), (2, "x" * 50), (3, "y"), (4, None)], "id int, body string")
    rows, objects = ingest.offload_bodies(d, "body", "response", limit=10)
    assert objects.count() == 1 and rows.filter("body is not null").count() == 1
    assert {r.id: r.body for r in ingest.read_bodies(rows, objects, "body").collect()} == {1: "x" * 50, 2: "x" * 50, 3: "y", 4: None}


def test_sessions_and_fields(spark):
    s = spark.createDataFrame([("a", "x"), ("b", None)], "id string, label string")
    assert [r.id for r in ingest.delete_sessions(s, "x").collect()] == ["b"]
    e = spark.createDataFrame([("e1", None), ("e2", "old")], "endpoint_id string, tag string")
    assert {r.endpoint_id: r.tag for r in ingest.set_endpoint_field(e, ["e1"], "tag", "new").collect()} == {"e1": "new", "e2": "old"}


# --- graphs


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (900, 900)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


def random_graph(rng, n, m, acyclic):
    nodes = [graph.Node(f"n{i}", rng.choice(["request", "request", "auth", "websocket"]), None, f"/a/{i % 3}", "GET", None) for i in range(n)]
    edges = []
    for _ in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        if acyclic and a >= b:
            continue
        edges.append(graph.Edge(f"n{a}", f"n{b}", rng.choice(["token", "cookie", "path_param"]), rng.choice([10, 20_000])))
    return nodes, edges


@pytest.mark.parametrize("seed", range(20))
def test_walks_against_recursion(seed):
    rng = random.Random(seed)
    nodes, edges = random_graph(rng, 9, 16, acyclic=seed % 2 == 0)
    out = graph._out(edges)
    # cycles: back edges of a recursive walk
    seen, path, back = set(), [], []

    def visit(x):
        seen.add(x)
        path.append(x)
        for e in out.get(x, ()):
            if e.target not in seen:
                visit(e.target)
            elif e.target in path:
                back.append("|".join(path[path.index(e.target) :]))
        path.pop()

    for n in nodes:
        if n.id not in seen:
            visit(n.id)
    assert [c[2] for c in graph.cycles_of(nodes, edges)] == back
    # the critical path: the longest simple path, by trying all
    def longest(x, used):
        best = []
        for e in out.get(x, ()):
            if e.target not in used:
                p = longest(e.target, used | {e.target})
                if len(p) > len(best):
                    best = p
        return [x, *best]

    fed = {e.target for e in edges}
    best = []
    for n in [n.id for n in nodes if n.id not in fed] or [nodes[0].id]:
        p = longest(n, {n})
        if len(p) > len(best):
            best = p
    got, length = workflows.critical_path_of(nodes, edges)[0]
    assert length == len(best) and got.split("|") == best
    # replay: sources first
    order = {i: k for i, k in planning.replay_order_of(nodes, edges)}
    assert sorted(order) == sorted(n.id for n in nodes)
    if seed % 2 == 0:
        assert all(order[e.source] < order[e.target] for e in edges)


def test_graph_edits(spark):
    n, e = V.frame(spark, V.NODES, graph.NODE), V.frame(spark, V.EDGES, graph.EDGE)
    left_n, left_e = graph.remove_nodes(n, e, spark.createDataFrame([("poll",)], "id string"))
    assert left_n.count() == 7 and left_e.count() == 2
    assert graph.complete(left_n, e).filter("id = 'poll' and type = 'request'").count() == 1
    again = graph.add_nodes(n, n.withColumn("type", F.lit("other")).withColumn("seq", F.col("seq") + 100))
    assert again.filter("type = 'other'").count() == 0 and again.count() == 8
    assert [r.node for r in graph.bfs(e, "ws", "upstream").orderBy("position").collect()] == ["ws", "poll", "me", "login"]
    assert graph.shortest_path(e, "ws", "login") is None and graph.shortest_path(e, "me", "me") == ["me"]
    levels = {r.id: r.level for r in planning.replay_levels(n, e).collect()}
    assert levels["login"] == 0 and levels["del"] == 1 and levels["poll"] is None


def test_canonical_merge(spark):
    rows = [
        (1, "get", "http://a.com/api/users/1", "static_bundle", False, 0.5), (2, "GET", "https://a.com/api/users/22?x", "runtime_capture", False, 0.9), (3, "GET", "/api/users/3", "inferred_route", False, 0.2),
        (4, "GET", "/v1/graphql", "persisted_query", True, 0.8), (5, "POST", "https://b.com/graphql/", "other", False, 0.1), (6, "GET", "wss://a.com/live", "x", True, 0.3),
    ]
    r = {x.canonical_id: x for x in identity.resolve(spark.createDataFrame(rows, "seq long, method string, url string, provenance string, is_graphql boolean, confidence double")).collect()}
    users = r["GET#/api/users/:id"]
    assert (users.trust_state, users.protocol, users.origin, users.confidence, users.merged) == ("observed", "https", "http://a.com", 0.9, 3)
    assert r["POST#/graphql"].is_graphql and r["POST#/graphql"].provenance_set == ["other", "persisted_query", "x"] and r["POST#/graphql"].protocol == "wss"


def test_unify_graph(spark):
    nodes = [("r1", "request", "https://a.com/u/1", "/u/1", "GET", None, None, 1), ("r2", "request", "https://a.com/u/2", "/u/2", "GET", None, None, 2), ("r3", "request", "https://a.com/v", "/v", "GET", None, None, 3)]
    edges = [("r1", "r3", "token", 1.0, 0, 1), ("r2", "r3", "token", 1.0, 0, 2), ("r1", "r2", "token", 1.0, 0, 3)]
    n, e = identity.unify_graph(V.frame(spark, nodes, graph.NODE), V.frame(spark, edges, graph.EDGE))
    assert {r.id: r.merged for r in n.collect()} == {"canonical_GET#/u/:id": 2, "canonical_GET#/v": 1}
    assert sorted((r.new_id, r.id) for r in identity.merged_from(V.frame(spark, nodes, graph.NODE)).collect()) == [("canonical_GET#/u/:id", "r1"), ("canonical_GET#/u/:id", "r2"), ("canonical_GET#/v", "r3")]
    assert sorted((r.source[-3:], r.target[-3:]) for r in e.collect()) == [("/v"[-3:], "x")][:0] + sorted([(":id", "#/v"), (":id", "#/v"), (":id", ":id")])


# --- dependencies


def log(spark, rows):
    base = {"seq": 0, "session_id": "s", "captured_at": 0, "method": "GET", "url": "https://a.com/x", "path": "/x", "query_raw": None, "request_headers": None, "request_body": None, "response_status": 200, "response_headers": None, "response_body": None}
    full = [base | {"id": f"r{i}", "seq": i, "captured_at": i * 1000} | r for i, r in enumerate(rows)]
    ddl = "id string, seq long, session_id string, captured_at long, method string, url string, path string, query_raw string, request_headers string, request_body string, response_status int, response_headers string, response_body string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in full], ddl)


TOKEN = "abcdefghij-token-0001"
FLOWS = {
    "token": ({"response_body": json.dumps({"auth": {"access": TOKEN}})}, {"request_headers": json.dumps({"AUTHORIZATION": f"Bearer {TOKEN}"})}),
    "cookie": ({"response_headers": json.dumps({"Set-Cookie": f"sid={TOKEN}; Path=/"})}, {"request_headers": json.dumps({"cookie": f"a=b; sid={TOKEN}"})}),
    "csrf": ({"response_body": json.dumps([{"t": TOKEN}])}, {"request_headers": json.dumps({"X-CSRF-Token": TOKEN})}),
    "path_param": ({"response_body": json.dumps({"id": 1234567890123})}, {"path": "/items/1234567890123"}),
    "query_param": ({"response_body": json.dumps({"next": TOKEN})}, {"query_raw": f"?cursor={TOKEN}"}),
    "graphql_var": ({"response_body": json.dumps({"id": TOKEN})}, {"path": "/graphql", "request_body": json.dumps({"variables": {"in": {"id": TOKEN}}})}),
}


@pytest.mark.parametrize("kind", FLOWS)
def test_flows(spark, kind):
    got = dependencies.infer_dependencies(log(spark, FLOWS[kind])).collect()
    assert [(r.source_id, r.target_id, r.dependency_type) for r in got] == [("r0", "r1", kind)]


def test_no_flow_across_sessions_failures_or_time(spark):
    a, b = FLOWS["token"]
    for rows in ([a, b | {"session_id": "t"}], [b, a], [a | {"response_status": 500}, b], [a | {"captured_at": 5}, b | {"captured_at": 5}]):
        assert dependencies.infer_dependencies(log(spark, rows)).count() == 0


def test_reduction_ratio(spark):
    rows = [{"response_body": json.dumps({"n": f"unique-value-{i:04}"}), "path": "/x" if not i else f"/x/unique-value-{i - 1:04}"} for i in range(50)]
    g = log(spark, rows)
    m = dependencies.inference_metrics(g, dependencies.source_tokens(g), dependencies.target_tokens(g)).first()
    assert (m.lookups, m.hits, m.reduction_ratio, m.average_fanout) == (49, 49, 25.0, 1.0)


def test_walk():
    body = {"a": [{"b": "short"}, {"b": "long enough"}], "n": 123456789, "f": 1234567.25, "t": True, "z": None, "i": 1e9}
    assert dependencies.walk(body, "body") == [("body.a[1].b", "long enough"), ("body.n", "123456789"), ("body.f", "1234567.25"), ("body.i", "1000000000")]


# --- schemas


def test_schema_merge():
    rows = [{"id": 1, "email": "a@b.co", "active": True, "tags": ["x"]}, {"id": 2, "email": "c@d.co", "active": False, "tags": []}, {"id": "3", "email": None, "active": True}]
    a, b, c = map(schema.infer, rows)
    m = schema.merge(schema.merge(a, b), c)
    assert m["properties"]["id"] == {"oneOf": [{"type": "integer"}, {"type": "string"}]}
    assert m["required"] == ["id", "email", "active"] and m["properties"]["tags"] == {"type": "array", "items": {"type": "string"}}
    assert schema.merge({"nullable": True}, {"type": "string"}) == {"type": "string"}
    both = {"oneOf": [{"type": "string"}, {"type": "integer"}]}
    assert schema.merge(both, {"oneOf": [{"type": "boolean"}]}) == both
    assert schema.merge({"type": "string", "format": "uuid"}, {"type": "string", "format": "date"}) == {"type": "string"}


def test_response_schemas_keep_order(spark):
    rng = random.Random(9)
    bodies = [rng.choice(['{"a":1}', '{"a":"x"}', '{"a":1.5,"b":[]}', "[1]", '{"b":[{"c":null}]}', "not json", "3"]) for _ in range(200)]
    d = spark.createDataFrame([("e", 200, i, b) for i, b in enumerate(bodies)], "endpoint_id string, response_status int, seq long, response_body string")
    parts = []
    for b in bodies:
        try:
            x = json.loads(b)
        except ValueError:
            continue
        if isinstance(x, (dict, list)):
            parts.append(schema.infer(x))
    want = parts[0]
    for p in parts[1:]:
        want = schema.merge(want, p)
    got = schema.response_schemas(d).first()
    assert json.loads(got.fragment) == want and got.samples == len(parts)


def test_response_schemas_without_conflicts(spark):
    """Shapes are folded once each; the result is that of all rows in order, with empty objects and nulls too."""
    rng = random.Random(10)
    shapes = ['{"a":1}', '{"a":null,"c":{}}', '{"b":"2024-01-01","a":2}', '{"b":"x","c":{"d":[]}}', '{"c":{"d":[{"e":1}]}}', '{"c":{"d":[{"f":"z"},{"e":2}]}}', '{"c":{}}', "{}"]
    rows, wants = [], {}
    for e in range(40):
        bodies = [rng.choice(rng.sample(shapes, rng.randint(1, 4))) for _ in range(rng.randint(1, 12))]
        want = schema.infer(json.loads(bodies[0]))
        for b in bodies[1:]:
            want = schema.merge(want, schema.infer(json.loads(b)))
        wants[f"e{e}"] = (json.dumps(want), len(bodies))
        rows += [(f"e{e}", 200, i, b) for i, b in enumerate(bodies)]
    got = schema.response_schemas(spark.createDataFrame(rows, "endpoint_id string, response_status int, seq long, response_body string")).collect()
    assert {r.endpoint_id: (r.fragment, r.samples) for r in got} == wants


def test_deep_json(spark):
    deep = '{"token":"abcdefghijkl","x":' + "[" * 100_000 + "]" * 100_000 + "}"
    fine = '{"a":' * 150 + '"a value of some length"' + "}" * 150
    d = spark.createDataFrame([(1, deep), (2, fine), (3, "[" * 200_000), (4, '{"s":"' + "[{" * 500 + '"}')], "id int, body string")
    got = {r.id: r for r in d.select("id", schema.fragment_of("body").alias("f"), dependencies.json_tokens(F.col("body"), "b").alias("t"), graphql.extract("body").alias("g")).collect()}
    assert got[1].f is None and got[3].f is None and got[2].f is not None and json.loads(got[4].f)["properties"] == {"s": {"type": "string"}}
    assert [t.path for t in got[1].t] == ["b"] and got[2].t[0].value == "a value of some length" and got[1].g == []


def test_last_newlines(spark):
    for v in ("1.2.3.4\n", "2024-01-02\n", "a@b.co\n", f"{V.UUID}\n"):
        assert one(spark, tokens.string_format(F.lit(v)))[0] is None and schema.infer(v) == {"type": "string"}
    r = one(spark, urls.is_dynamic(F.lit("123\n")), tokens.charset(F.lit("123\n")), tokens.token_class(F.lit("507f1f77bcf86cd799439011\n"))["type"])
    assert r[0] is False and r[1] == "mixed" and r[2] != "mongo_object_id"


def test_pairing_against_a_loop(spark):
    rng = random.Random(13)
    rows, waiting, want = [], {}, {}
    for seq in range(800):
        at = ("hot" if rng.random() < 0.6 else f"u{rng.randint(0, 5)}", rng.choice(["GET", "POST"]))
        if rng.random() < 0.5:
            rows.append((seq, "request", *at, seq * 10, f"p{seq}", None))
            waiting[at] = seq
        else:
            rows.append((seq, "response", *at, seq * 10, None, None))
            got = waiting.pop(at, None)
            want[seq] = (None, None) if got is None else (f"p{got}", (seq - got) * 10)
    d = spark.createDataFrame(rows, "seq long, kind string, url string, method string, ts long, post_data string, trace_id string")
    for slices in (1, 16, 256):
        assert {r.seq: (r.post_data, r.response_time_ms) for r in ingest.pair_requests(d, slices).collect()} == want
    assert ingest.pair_requests(d.limit(0)).count() == 0


def test_openapi_document(spark):
    eps = spark.createDataFrame([("e1", "GET", "/users/{userId}", 5, "network", 1), ("e2", "POST", "/users", 1, None, 2)], "endpoint_id string, method string, path_template string, observation_count long, provenance string, seq long")
    schemas = spark.createDataFrame([("e1", 200, '{"type": "object", "properties": {"id": {}}}', 1), ("e1", 404, '{"type": "object"}', 1)], "endpoint_id string, status int, fragment string, samples long")
    doc = schema.openapi(schema.operations(eps, schemas), "https://a.com")
    assert schema.validate(doc) == []
    get = doc["paths"]["/users/{userId}"]["get"]
    assert list(get["responses"]) == ["200", "404"] and get["parameters"][0]["name"] == "userId" and "x-low-confidence" not in get
    post = doc["paths"]["/users"]["post"]
    assert post["responses"] == {"200": {"description": "Success"}} and post["x-low-confidence"] and post["x-source"] == "network"
    assert schema.validate({"openapi": "3", "info": {"title": "t", "version": "1"}, "paths": {"x": {"fetch": {}}}}) == ['Path "x" must start with /', 'Path "x" has invalid method "fetch"']


# --- GraphQL, bundles, pages


def test_documents():
    d = graphql.Document('query Q($a: [Int!]! = [1] @d) @x(y: {z: "s"}) { a: b(c: $a, d: """t""") { ...F ... on T @i { e } ... { f } } } fragment F on T { g } # end')
    assert d.operations == [("query", "Q")] and d.fragments == ["F"] and d.fields == 4 and d.spreads
    for bad in ("", "query", "{", "{ }", "{ a(b: ) }", "type T { a: Int }", "{ a } }", "fragment on on T { a }", "{ a ? }"):
        with pytest.raises(ValueError):
            graphql.Document(bad)


def test_graphql_tables(spark):
    ops, bad = graphql.graphql_operations(V.frame(spark, V.GRAPHQL, "seq int, request_body string"))
    assert [r.seq for r in bad.collect()] == [4]
    kept = graphql.upsert_operations(ops.unionByName(ops.withColumn("seq", F.col("seq") + 100)))
    assert kept.count() == ops.count() and kept.filter("seq >= 100").count() == 0
    assert graphql.breakdown(ops).first()[:] == ("query", 4)
    got, said = graphql.recover_persisted(V.frame(spark, V.PERSISTED, "id int, payload string"), V.frame(spark, V.KNOWN, "hash string, document string, seq int"))
    assert sorted(r.message for r in said.collect()) == ["collision: h1", "malformed_payload", "unresolved: h9", "unresolved: r1"]
    e = graphql.enrich(spark.createDataFrame([(1, None, ""), (2, "Own", "q")], "id int, operation_name string, document string"), got).collect()
    assert {(r.id, r.operation_name, r.document) for r in e} == {(1, "GetUser", "query GetUser { user { id } }"), (2, "Own", "q")}


def test_bundles(spark):
    b = V.frame(spark, V.BUNDLES + [("c.js", "fetch('/a/graphql');x.open('GET','/a/graphql')", False)], "file_name string, source_code string, is_source_map boolean")
    assert [(r.file_name, r.types) for r in bundles.type_conflicts(b).collect()] == [("c.js", "graphql,rest")]
    found = bundles.bundle_endpoints(b)
    r = identity.resolve(bundles.as_observations(found)).filter("canonical_id = 'GET#/api/users'").first()
    assert r.trust_state == "discovered" and r.merged == 2


def test_links_and_crawl(spark):
    html = lambda *h: "".join(f'<a class="x" href="{x}">t</a>' for x in h)
    pages = [("https://a.com/", html("/b", "c#top", "//a.com/d", "mailto:x@y", "https://z.com/", "/login", "https://s.a.com/q")), ("https://a.com/b", html("/e")), ("https://a.com/e", html("/f"))]
    links = bundles.page_links(spark.createDataFrame(pages, "url string, html string"))
    first = {r.target for r in links.filter("source = 'https://a.com/'").collect()}
    assert first == {"https://a.com/b", "https://a.com/c", "https://a.com/d", "https://z.com/", "https://a.com/login", "https://s.a.com/q"}
    got = [(r.url, r.depth) for r in bundles.crawl(links, "https://a.com/").orderBy("position").collect()]
    assert got == [("https://a.com/", 0), ("https://a.com/b", 1), ("https://a.com/c", 1), ("https://a.com/d", 1), ("https://a.com/e", 2)]
    assert bundles.crawl(links, "https://a.com/", most_pages=2).count() == 2 and bundles.crawl(links, "https://a.com/", subdomains=True).count() == 6


# --- plans


def registry(spark):
    rows = [("GET#/a/b/c", "/a/b/c", "GET", "discovered", 0.5, False), ("GET#/a/b/d", "/a/b/d", "GET", "inferred", 0.5, False), ("DELETE#/x", "/x", "DELETE", "unresolved", 1.0, False), ("POST#/graphql", "/graphql", "POST", "discovered", 0.9, True), ("GET#/y", "/y", "GET", "observed", 1.0, False)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "canonical_id string, canonical_path string, canonical_method string, trust_state string, confidence double, is_graphql boolean, seq long")


def test_exploration(spark):
    got = {r.id: (r.priority, r.safety) for r in planning.endpoint_targets(registry(spark)).collect()}
    assert got == {"GET#/a/b/d": (50, "safe"), "DELETE#/x": (20, "dangerous"), "POST#/graphql": (45, "caution")}
    fails = spark.createDataFrame([("GET#/a/b/d",)] * 2 + [("DELETE#/x",)] * 2 + [("POST#/graphql",)] * 4 + [("explore_route_family_/a/b",)], "target_id string")
    assert {r.id: r.priority for r in planning.endpoint_targets(registry(spark), fails).collect()} == {"GET#/a/b/d": 20}
    assert [r.priority for r in planning.family_targets(registry(spark), fails).collect()] == [50]
    n, e = V.frame(spark, V.NODES, graph.NODE), V.frame(spark, V.EDGES, graph.EDGE)
    comp = graph.components(n, e)
    flows, roles = workflows.synthesize(n, e, comp)
    plan = planning.exploration_plan(registry(spark), n, comp, workflows.numbered(flows), roles).collect()
    assert plan[0].id == "explore_disconnected_region" and plan[0].priority == 75
    assert [p.priority for p in plan] == sorted((p.priority for p in plan), reverse=True)
    jobs = planning.update_job(planning.new_jobs(spark, ["j1", "j2"], 5), "j1", "done", 9)
    assert {(r.id, r.status, r.updated_at) for r in jobs.collect()} == {("j1", "done", 9), ("j2", "queued", 5)}


def _longest(ids, pairs):
    """The longest path from an entry by plain recursion over all simple paths, the earliest edges first."""
    out = {}
    for x, y in pairs:
        out.setdefault(x, []).append(y)
    fed = {y for _, y in pairs}

    def go(at, seen):
        if at in seen:
            return []
        best = []
        for t in out.get(at, ()):
            if len(tail := go(t, seen | {at})) > len(best):
                best = tail
        return [at, *best]

    best = []
    for e in [i for i in ids if i not in fed] or ids[:1]:
        if len(path := go(e, frozenset())) > len(best):
            best = path
    return best


def _graph(ids, pairs):
    return [graph.Node(i, "request", None, None, "GET", None) for i in ids], [graph.Edge(x, y, "token", 1) for x, y in pairs]


def test_critical_paths_against_recursion():
    rng = random.Random(12)
    for _ in range(600):
        ids = [f"n{i}" for i in range(rng.randint(1, 8))]
        pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randint(0, 14))]
        want = _longest(ids, pairs)
        assert workflows.marked_path_of(*_graph(ids, pairs), None) == [("|".join(want), len(want), 0)]


def test_critical_paths_of_large_components():
    clique, tail = [f"c{i}" for i in range(13)], [f"t{i}" for i in range(60)]
    pairs = [("s", "c0"), *((x, y) for x in clique for y in clique if x != y), ("c3", "t0"), *zip(tail, tail[1:], strict=False)]
    path, length, stopped = workflows.marked_path_of(*_graph(["s", *clique, *tail], pairs))[0]
    assert length == 74 and not stopped and path.startswith("s|c0|") and path.endswith("|c3|" + "|".join(tail))
    assert workflows.marked_path_of(*_graph(["s", *clique, *tail], pairs), 5)[0][2] == 1  # a search that ends is marked
    chain = [f"x{i}" for i in range(20_000)]
    assert workflows.marked_path_of(*_graph(chain, list(zip(chain, chain[1:], strict=False))))[0][1:] == (20_000, 0)
    assert workflows.marked_path_of(*_graph(chain[:3000], [*zip(chain, chain[1:3000], strict=False), (chain[2999], chain[0])]))[0][1:] == (3000, 0)


def test_numbers_over_ranges(spark):
    d = spark.range(5000).select((F.xxhash64("id") % 1000).alias("v"), "id")
    got = runtime.numbered(d, ["v", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    assert runtime.numbered(d.limit(0), ["v"], "n").count() == 0


def test_dfs(spark):
    n = spark.createDataFrame([(i, "request", None, None, "GET", None, None, k) for k, i in enumerate("abcdef")], graph.NODE)
    pairs = ["ab", "ac", "bd", "da", "cd"]
    e = spark.createDataFrame([(s, t, "token", 0.9, 1, k) for k, (s, t) in enumerate(pairs)], graph.EDGE)
    comp = graph.components(n, e)

    def order(**kw):
        return [r.id for r in graph.dfs(n, e, comp, **kw).orderBy("position", "id").collect()]

    assert order() == ["a", "e", "f", "b", "d", "c"]
    assert order(start="c") == ["c", "d", "a", "b"] and order(start="d", direction="upstream") == ["d", "b", "a", "c"]


def test_graph_queries_read_tables():
    assert {"clusters", "graph_metrics", "graph_bfs_tables", "graph_dfs", "graph_shortest_path_tables"} <= set(catalog.QUERIES)


def test_exploration_prerequisites(spark):
    pool = [(f"p{i:03}", "request", None, "/x/y", "GET", "unresolved", None, i) for i in range(150)]
    loop = [(i, "request", None, "/z", "GET", "unresolved", None, 200 + k) for k, i in enumerate("ba")]
    n = spark.createDataFrame(pool + loop, graph.NODE)
    e = spark.createDataFrame([("a", "b", "token", 0.9, 1, 1), ("b", "a", "token", 0.9, 1, 2)], graph.EDGE)
    comp = graph.components(n, e)
    flows, roles = workflows.synthesize(n, e, comp)
    flows = workflows.numbered(flows)
    got = {(r.target_id, r.prerequisite) for r in planning.prerequisites(flows, roles).collect()}
    # all of a pool; of a loop the first node
    assert got == {("explore_wf_wf_1", "b")} | {("explore_wf_wf_2", f"p{i:03}") for i in range(150)}
    assert {r.id: r.n_prerequisites for r in planning.workflow_targets(flows, roles).collect()} == {"explore_wf_wf_1": 1, "explore_wf_wf_2": 150}


def test_replay_metrics(spark):
    replays = spark.createDataFrame([(1,), (0,), (1,), (1,)], "success int")
    m = summary.replay_metrics(replays, spark.range(2), spark.range(5)).first()
    assert (m.total_events, m.successful_events, m.success_rate, m.total_jobs, m.total_dependencies) == (4, 3, 75.0, 2, 5)


# --- files and streams


def test_sinks(spark, tmp_path):
    objects = spark.createDataFrame([("response-1.txt", "a")], "path string, text string")
    for _ in range(2):
        sinks.write_objects(objects, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/objects").count() == 1
    rows = spark.createDataFrame([(0, "x"), (86_400_000, "y")], "captured_at long, url string")
    sinks.write_event_log(summary.events_log(rows, "capture"), str(tmp_path))
    assert {str(r.day) for r in spark.read.json(f"{tmp_path}/events_log").select("day").collect()} == {"1970-01-01", "1970-01-02"}
    sinks.write_openapi({"openapi": "3.0.3"}, spark, f"{tmp_path}/spec")
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/spec").collect())) == {"openapi": "3.0.3"}


def test_merged_tables_count_each_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_PARTS", 3)
    merge = lambda both: both.groupBy("k").agg(F.sum("n").alias("n"))
    add = lambda k, n, batch: sinks.merge_table(spark, str(tmp_path), "t", spark.createDataFrame([(k, n)], "k string, n long"), merge, batch)
    read = lambda: {r.k: r.n for r in sinks.read_merged(spark, str(tmp_path), "t", merge).collect()}
    for k in range(8):
        add("a", 1, f"s-{k}")
        add("a", 1, f"s-{k}")  # played again after it was finished
        assert read() == {"a": k + 1}
    assert len(list((tmp_path / "t").iterdir())) <= 4
    # a batch that was cut short before Spark marked it finished doesn't count, and is written again
    broken = tmp_path / "t" / "add-000000000008-s-8"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert read() == {"a": 8}
    add("a", 5, "s-8")
    assert read() == {"a": 13}
    # so does a rewrite that was cut short: the parts that it would stand for are still there
    (tmp_path / "t" / "all-000000000009-s-9").mkdir()
    assert read() == {"a": 13}


def test_merged_requests(spark, sf_dir):
    log_ = ingest.with_ids(observations.observations(spark, sf_dir))
    whole = ingest.dedup_requests(log_)
    parts = [ingest.dedup_requests(log_.filter(F.col("seq") % 3 == k)) for k in range(3)]
    got = ingest.merged_requests(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert got.select(whole.columns).exceptAll(whole).count() == 0 == whole.exceptAll(got.select(whole.columns)).count()


def test_har(spark, tmp_path):
    e = {"startedDateTime": "2024-01-01T00:00:00Z", "time": 12.4, "request": {"method": "GET", "url": "https://a.com/u/1?x=1", "headers": [{"name": "Cookie", "value": "a=b"}]}, "response": {"status": 200, "headers": [], "content": {"text": "{}"}}}
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [e, e]}}))
    got = observations.read_har(spark, str(tmp_path / "a.har")).collect()
    assert [(r.seq, r.captured_at, r.path, r.query_raw, r.response_time_ms, r.request_headers) for r in got] == [(i, 1704067200000, "/u/1", "?x=1", 12, '{"cookie":"a=b"}') for i in (0, 1)]


def test_stream_equals_batch_over_several_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log_ = observations.from_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    stream.endpoint_stream(log_, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    cols = ["endpoint_id", "observation_count", "first_seen_at", "last_seen_at"]
    got = {tuple(r) for r in stream.read_endpoints(spark, f"{tmp_path}/out").select(*cols).collect()}
    assert got == {tuple(r) for r in ingest.endpoints(ingest.with_ids(observations.from_events(events))).select(*cols).collect()}


def test_stream_pairing(spark, tmp_path):
    ddl = "seq long, kind string, url string, method string, ts long, post_data string, trace_id string"
    spark.createDataFrame(V.PAIRS, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream.pair_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("paired").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    got = {(r.method, r.responded_at, r.requested_at, r.post_data, r.response_time_ms) for r in spark.table("paired").collect()}
    assert got == {r[1:] for r in V.PAIRS_OUT}
