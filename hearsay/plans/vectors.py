"""Literal rows for what the driver tables don't hold, once for Spark and once for SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql(rows: list[tuple], schema: str) -> str:
    """The same rows as a SELECT over VALUES, typed by the schema."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    cols = [c.split() for c in schema.split(", ")]

    def lit(x, kind: str) -> str:
        if x is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return f"CAST({x!r} AS {kind})"
        text = "'" + x.replace("'", "''") + "'"
        return text if "\n" not in x else "concat(" + ", chr(10), ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n")) + ")"

    body = ", ".join("(" + ", ".join(lit(x, kinds[k]) for x, (_, k) in zip(r, cols, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(c for c, _ in cols)})"


def gql_id(name: str | None, document: str) -> str:
    return hashlib.sha256(f"gql:{name or ''}:{document}".encode()).hexdigest()[:32]


UUID = "123e4567-e89b-12d3-a456-426614174000"
PATHS = [
    ("/users/123", "/users/{userId}"),
    ("/users/123/posts/abc123", "/users/{userId}/posts/abc123"),
    ("/teams/9d8c7b6a5f4e3d2c1b0a/roles/42", "/teams/{teamId}/roles/{roleId}"),
    ("/projects/alpha/tasks/987", "/projects/alpha/tasks/{taskId}"),
    (f"/orgs/acme/users/{UUID}", "/orgs/acme/users/{userId}"),
    ("/users/1/2", "/users/{userId}/{1Id}"),
    ("/users/1/users/2", "/users/{userId}/users/{userId2}"),
    ("/categories/7/boxes/8/classes/9", "/categories/{categoryId}/boxes/{boxeId}/classes/{classId}"),
    ("/12345", "/{id}"),
    ("//", "/"),
    ("/", "/"),
    ("", "/"),
    ("/a-very-long-article-slug-here", "/{id}"),
    ("/address/5", "/address/{addressId}"),
]
TOKENS = [
    ("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpM", "authorization", "jwt", "high", 0.2 + 0.1),
    ("www.example.com", "", "jwt", "medium", 0.2),
    (UUID, "", "uuid", "medium", 0.05),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAV", "", "ulid", "high", 0.05),
    ("507f1f77bcf86cd799439011", "", "mongo_object_id", "medium", 0.05),
    ("d41d8cd98f00b204e9800998ecf8427e", "", "hash", "medium", -0.1),
    ("1700000000", "", "timestamp", "low", -0.4 - 0.15),
    ("1700000000000", "", "timestamp", "low", -0.4 - 0.15),
    ("1234", "", "numeric_id", "low", -0.2 - 0.15),
    ("12345678901", "", "numeric_id", "medium", 0.0),
    ("abcdef-123", "x-csrf-token", "csrf_token", "medium", 0.1),
    ("s3ss10n-abc", "set-cookie", "session_cookie", "medium", 0.1),
    ("YXJyYXljb25uZWN0aW9uOjE=", "after", "graphql_cursor", "high", 0.05),
    ("xK9#mP2$vL5@nQ8!wR3^tY6&", "", "opaque_token", "high", 0.05),
    ("hello world", "", "unknown", "medium", -0.1),
    ("", "", "unknown", "low", -0.1 - 0.15),
]
TRAFFIC = [
    ("https://api.shop.com/v1/items", "xhr", "GET", "application/json", 200, None, True),
    ("https://api.shop.com/v1/items", "fetch", "OPTIONS", "application/json", 204, None, False),
    ("https://shop.com/app.js", "fetch", "GET", "text/javascript", 200, None, False),
    ("https://shop.com/app.js?v=1", "fetch", "GET", "text/javascript", 200, None, True),
    ("https://www.google-analytics.com/collect", "xhr", "POST", "text/plain", 200, "noise_domain", True),
    ("https://shop.com/api/Track/me", "xhr", "POST", "application/vnd.api+json", 500, "noise_path", True),
    ("https://shop.com/logo.PNG", "image", "GET", "image/png", 200, None, False),
    ("not a url/events", "xhr", "GET", None, 404, None, True),
]
BOUNDARIES = [
    (401, "https://a.com/x", "https://a.com/x", "", "http_401", 1.0),
    (403, "https://a.com/login", "https://a.com/x", "", "http_403", 0.9),
    (200, "https://a.com/Login?next=x", "https://a.com/x", "", "login_redirect", 0.95),
    (200, "https://a.com/login", "https://a.com/login", "<p>plain</p>", None, None),
    (200, "https://a.com/x", "https://a.com/x", "<script src='https://challenges.cloudflare.com/a.js'></script>", "captcha_cloudflare", 0.95),
    (200, "https://a.com/x", "https://a.com/x", "<div class='g-recaptcha'></div>", "captcha_recaptcha", 0.95),
    (200, "https://a.com/x", "https://a.com/x", "<div class='h-captcha'></div>", "captcha_hcaptcha", 0.95),
    (200, "https://a.com/x", "https://a.com/x", '<input class="p" type="password">', "login_form", 0.9),
    (200, "https://a.com/x", "https://a.com/x", "<p>Please <b>sign</b> in</p>", "auth_required_text", 0.7),
    (200, "https://a.com/x", "https://a.com/x", "<script>unauthorized()</script><p>fine</p>", None, None),
]
SSE = [("s1", "event: greet\ndata: hello\nid: 1\n\n: comment only\n\ndata: a\ndata:  b\n\n\nevent: none\n"), ("s2", "data: x\r\n\ndata: y"), ("s3", "")]
SSE_EVENTS = [("s1", 0, "greet", "hello", "1"), ("s1", 1, None, "a\nb", None)]
FRAMES = [
    (1, "w1", "open", None, 100), (2, "w1", "received", '{"type":"welcome","ts":1}', 110), (3, "w1", "sent", '{"type":"subscribe","payload":{"query":"subscription { a }"}}', 120),
    (4, "w1", "sent", "ping", 130), (5, "w1", "close", None, 140), (6, "w2", "open", None, 150), (7, "w2", "received", ' [1,2]', 160), (8, "w2", "received", '{"event":"tick"}', 170),
]
GRAPHQL = [
    (1, '{"query":"query Me { me { id name } }"}'),
    (2, '{"query":"mutation Up($a: Int = 1) { up(a: $a) @skip(if: false) { ok } }","operationName":"Up","variables":{"a":1}}'),
    (3, '[{"query":"{ a }"},{"query":"subscription S { s { ...F } } fragment F on T { x y: z }"}]'),
    (4, '{"query":"query {"}'),
    (5, '{"extensions":{"persistedQuery":{"version":1,"sha256Hash":"h1"}},"operationName":"P"}'),
    (6, '{"query":"   "}'),
    (7, '{"query":"query A { a } query B { b ... on T { c } }","operationName":"B"}'),
]
GRAPHQL_OUT = [
    (1, "query", "Me", 3, False, False, ""), (2, "mutation", "Up", 2, False, False, ""), (3, "query", None, 1, False, False, ""), (3, "subscription", "S", 3, True, False, "F"),
    (5, "query", "P", 0, False, True, ""), (7, "query", "B", 3, True, False, ""),
]
GRAPHQL_IDS = [
    (gql_id(None, "{ a }"), "query", 3), (gql_id("Me", "query Me { me { id name } }"), "query", 1), (gql_id("S", "subscription S { s { ...F } } fragment F on T { x y: z }"), "subscription", 3),
    (gql_id("Up", "mutation Up($a: Int = 1) { up(a: $a) @skip(if: false) { ok } }"), "mutation", 2), (gql_id("P", ""), "query", 5), (gql_id("B", "query A { a } query B { b ... on T { c } }"), "query", 7),
]
IS_GRAPHQL = [
    ("/GraphQL", None, True), ("/x", None, False), ("/x", '{"query":"{ a }"}', True), ("/x", '{"query":5}', False), ("/x", '{"query":{"a":1}}', False), ("/x", '{"query":""}', True), ("/x", "[]", False),
    ("/x", ' [{"query":"{ a }"}, {"extensions":{"persistedQuery":{"sha256Hash":"h"}}}]', True), ("/x", '[{"query":"{ a }"}, {"q":1}]', False), ("/x", "not json", False), ("/x", '{"query":null}', False),
]
SUBSCRIPTIONS = [
    (1, '{"type":"subscribe","id":"1","payload":{"query":"subscription S { a b }"}}'), (2, '{"type":"start","payload":{"query":"{ x }","operationName":"Q"}}'), (3, '{"type":"next","payload":{"data":{"a":1}}}'),
    (4, '{"type":"ping"}'), (5, '{"type":"subscribe","payload":{"query":"subscription {"}}'), (6, "plain"), (7, '{"type":"SUBSCRIBE","payload":[{"query":"query One { a }"},{"query":"mutation Two { b }"}]}'),
]
SUBSCRIPTIONS_OUT = [(1, "subscription", "S", 2), (2, "query", "Q", 1), (7, "query", "One", 1), (7, "mutation", "Two", 1)]
BATCHES = [(1, '[{"operationName":"A","extensions":{"persistedQuery":{"sha256Hash":"h1"}}},{"id":"r9","operationName":"B"},{"doc_id":"r2"},{"query":"{ a }"}]'), (2, ' {"id":"h1"}'), (3, "[]"), (4, "[broken")]
BATCHES_OUT = [(1, 0, "A", "h1", 1.0), (1, 1, "B", "r9", 0.8), (1, 2, None, "r2", 1.0), (2, 0, None, "h1", 1.0)]
PERSISTED = [
    (1, '{"operationName":"GetUser","extensions":{"persistedQuery":{"sha256Hash":"h1"}}}'), (2, '{"operationName":"Feed","id":"r1"}'), (3, '{"doc_id":"r2","variables":{"a":1}}'),
    (4, '{"extensions":{"persistedQuery":{"sha256Hash":"h9"}}}'), (5, '{"operationName":"Lost"}'), (6, '{"query":"{ a }"}'),
]
KNOWN = [("h1", "query Old { a }", 1), ("h1", "query GetUser { user { id } }", 2), ("r2", "query R { r }", 3)]
PERSISTED_OUT = [
    (1, "GetUser", "h1", "query GetUser { user { id } }", 1.0), (2, "Feed", "r1", None, 0.8), (3, None, "r2", "query R { r }", 1.0), (4, None, "h9", None, 0.4),
]
BUNDLES = [
    ("app.js", "const a = fetch('/api/users');\naxios.post(\"/api/login\", x);\nconst r = { path: '/settings/:id' };\nfetch(`/graphql`)\n", False),
    ("min.js", "x=1;" * 130 + 'y.open("PUT","/api/save");fetch("/api/users");new WebSocket("wss://a.com/s");', False),
    ("app.map", "fetch('/v2/a')\nfetch('/v2/a')\naxios('/never')\nroute: \"/home\"\n", True),
]
BUNDLE_OUT = [
    ("app.js", "GET", "/api/users", 10, "rest", 0.8, "static_bundle", "string_analysis"), ("app.js", "POST", "/api/login", 31, "rest", 0.8, "static_bundle", "string_analysis"),
    ("app.js", "GET", "/settings/:id", 72, "route", 0.7, "inferred_route", "string_analysis"), ("app.js", "GET", "/graphql", 97, "graphql", 0.8, "static_bundle", "string_analysis"),
    ("min.js", "PUT", "/api/save", 521, "rest", 0.6, "static_bundle", "regex"), ("min.js", "GET", "/api/users", 546, "rest", 0.6, "static_bundle", "regex"),
    ("min.js", "WS", "wss://a.com/s", 566, "websocket", 0.9, "static_bundle", "regex"),
    ("app.map", "GET", "/v2/a", 0, "rest", 0.8, "source_map", "source_map"), ("app.map", "GET", "/home", 46, "route", 0.7, "inferred_route", "source_map"),
]
PAIRS = [
    (1, "request", "u", "GET", 100, "a", "t1"), (2, "request", "u", "GET", 110, "b", "t2"), (3, "response", "u", "GET", 150, None, None), (4, "response", "u", "GET", 160, None, None),
    (5, "request", "u", "POST", 170, "c", "t3"), (6, "response", "u", "POST", 171, None, None),
]
PAIRS_OUT = [(3, "GET", 150, 110, "b", 40), (4, "GET", 160, None, None, None), (6, "POST", 171, 170, "c", 1)]
SESSIONS = [
    ("a", 1_000, "main", '[{"name":"sid"}]', None), ("b", 2_000, "main", None, None), ("c", 90_000_000, "new", None, "{}"), ("d", 3_600_000, "edge", "[]", None), ("e", 5, None, "[]", None),
]
SESSIONS_OUT = [("main", "b", False), ("new", "c", True), ("edge", "d", False)]
NODES = [
    ("login", "auth", "https://a.com/login", "/login", "POST", "observed", "network", 1), ("me", "request", "https://a.com/me", "/me", "GET", "observed", "network", 2),
    ("poll", "request", "https://a.com/poll", "/poll", "GET", "observed", "network", 3), ("ws", "websocket", "wss://a.com/s", "/s", "GET", "observed", "network", 4),
    ("list", "request", "https://a.com/items", "/api/items", "GET", "observed", "network", 5), ("del", "request", "https://a.com/items/1", "/api/items/1", "DELETE", "observed", "network", 6),
    ("lone", "request", "https://a.com/x/upload", "/x/upload", "POST", "unresolved", "other", 7), ("gql", "graphql_operation", "/graphql", None, "POST", "observed", "network", 8),
]
EDGES = [
    ("login", "me", "token", 0.9, 100, 1), ("me", "poll", "path_param", 0.8, 200, 2), ("poll", "me", "path_param", 0.8, 200, 3), ("poll", "ws", "cookie", 0.8, 10, 4),
    ("ws", "poll", "path_param", 0.7, 10, 5), ("list", "del", "path_param", 0.7, 5, 6),
]
