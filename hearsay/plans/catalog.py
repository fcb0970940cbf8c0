"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions import filters, tokens, urls
from hearsay.operators import bundles, dependencies, graph, graphql, identity, ingest, planning, schema, summary, workflows
from hearsay.plans import graph_sql as G
from hearsay.plans import vectors as V
from hearsay.runtime import cut, once, shared_dir, table
from hearsay.sources import sinks
from hearsay.sources.observations import observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- SQL of shared parts

EVENTS = """e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS captured_at, event_type, props, value, json_extract_string(props, '$.k') AS k FROM events),
obs AS (SELECT seq, session_id, captured_at, k, event_type, props, CAST(floor(value) AS BIGINT) AS response_time_ms,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method,
  '/api/' || event_type || 's/' || k AS path, 'https://api.example.com/api/' || event_type || 's/' || k || '?page=' || k AS url,
  '/api/' || event_type || 's/{' || CASE WHEN event_type || 's' LIKE '%ses' THEN left(event_type || 's', length(event_type) - 1) ELSE event_type END || 'Id}' AS path_template,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status FROM e),
ids AS (SELECT *, sha256(concat_ws(':', method, url, substr(sha256(''), 1, 16))) AS request_id, substr(sha256(concat_ws(':', method, path_template, 'https://api.example.com')), 1, 32) AS endpoint_id FROM obs)"""
INVENTORY = f"""WITH {EVENTS},
inv AS (SELECT endpoint_id, method, path_template, 'https://api.example.com' AS base_url, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at, count(*) AS observation_count FROM ids GROUP BY ALL)"""
PAGES = """p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)', 1) AS s, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)', 2)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS raw, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*([?][^#]*)?', 1) AS q FROM pages),
u AS (SELECT page_id, url, s AS protocol, s || '://' || host AS base_url, host, CASE WHEN raw = '' THEN '/' ELSE raw END AS path, CASE WHEN length(q) > 1 THEN q END AS query_raw FROM p)"""
_TRIM = "CASE WHEN starts_with(regexp_replace(path, '/$', ''), '/') THEN regexp_replace(path, '/$', '') ELSE '/' || regexp_replace(path, '/$', '') END"
NORMAL = f"regexp_replace(regexp_replace(regexp_replace({_TRIM}, '/[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '/:id', 'g'), '/[0-9]+$', '/:id'), '/[0-9]+/', '/:id/', 'g')"
FOUND_PARTS = f"""{PAGES},
found AS (SELECT seq, method, url, path, 'network' AS provenance, 1.0::DOUBLE AS confidence, 'https' AS protocol, 'https://api.example.com' AS origin FROM obs
  UNION ALL SELECT 1000000000 + page_id, 'GET', url, path, CASE page_id % 4 WHEN 0 THEN 'static_bundle' WHEN 1 THEN 'inferred_route' WHEN 2 THEN 'persisted_query' ELSE 'imported' END,
  CASE WHEN page_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END, protocol, base_url FROM u),
canon AS (SELECT *, CASE WHEN {NORMAL} LIKE '%/graphql' THEN '/graphql' ELSE {NORMAL} END AS canonical_path,
  CASE WHEN provenance IN ('network') THEN 3 WHEN provenance IN ('static_bundle', 'persisted_query') THEN 2 WHEN provenance = 'inferred_route' THEN 1 ELSE 0 END AS rank FROM found),
reg AS (SELECT method || '#' || canonical_path AS canonical_id, canonical_path, method AS canonical_method, array_to_string(list_sort(list_distinct(list(provenance))), ',') AS provenance_set, max(rank) AS r,
  max(confidence) AS confidence, coalesce(arg_max(protocol, seq) FILTER (protocol IN ('https', 'wss')), arg_min(protocol, seq) FILTER (protocol <> 'unknown'), 'unknown') AS protocol,
  arg_min(origin, seq) AS origin, count(*) AS merged, min(seq) AS seq FROM canon GROUP BY method, canonical_path),
registry AS (SELECT *, CASE r WHEN 3 THEN 'observed' WHEN 2 THEN 'discovered' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS trust_state FROM reg)"""
FOUND = f"WITH {EVENTS}, {FOUND_PARTS}"
DEPS = f"""WITH {EVENTS},
item AS (SELECT seq, session_id, captured_at // 10000 AS at, event_type, 'item_' || lpad(k, 5, '0') AS src, 'item_' || lpad(CAST(seq % 100 AS VARCHAR), 5, '0') AS tgt FROM obs WHERE response_status BETWEEN 200 AND 399),
freq AS (SELECT src, count(*) AS n FROM item GROUP BY src),
pair AS (SELECT s.seq AS a, t.seq AS b, s.at AS sa, t.at AS ta, CASE WHEN t.event_type = 'signup' THEN 'token' ELSE 'path_param' END AS dependency_type, s.src, n FROM item s JOIN item t ON s.session_id = t.session_id AND s.src = t.tgt AND s.at < t.at JOIN freq ON freq.src = s.src),
dep AS (SELECT CAST(a AS VARCHAR) AS source_id, CAST(b AS VARCHAR) AS target_id, dependency_type, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((CASE dependency_type WHEN 'token' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END + (-0.1)::DOUBLE)
  + CASE WHEN ta - sa <= 5000 THEN 0.1::DOUBLE WHEN ta - sa <= 30000 THEN 0.0::DOUBLE WHEN ta - sa <= 120000 THEN (-0.1)::DOUBLE ELSE (-0.2)::DOUBLE END)
  + CASE WHEN n = 1 THEN 0.1::DOUBLE WHEN n <= 5 THEN 0.0::DOUBLE WHEN n <= 20 THEN (-0.1)::DOUBLE ELSE (-0.3)::DOUBLE END)) AS confidence FROM pair)"""


# --- ingest


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.endpoints(ingest.with_ids(observations(spark, sf_dir)))


@query(f"{INVENTORY} SELECT endpoint_id, method, path_template, observation_count FROM inv ORDER BY observation_count DESC, endpoint_id LIMIT 10")
def top_endpoints(spark, sf_dir):
    return ingest.top_endpoints(inventory(spark, sf_dir)).select("endpoint_id", "method", "path_template", "observation_count")


@query(
    f"WITH {EVENTS} SELECT request_id, arg_min(session_id, seq) AS session_id, arg_min(method, seq) AS method, arg_min(url, seq) AS url, arg_max(captured_at, seq) AS captured_at, "
    "CAST(arg_max(response_status, seq) AS INTEGER) AS response_status, arg_max(props, seq) AS response_body, arg_max(response_time_ms, seq) AS response_time_ms, count(*) AS observations FROM ids GROUP BY request_id"
)
def request_dedup(spark, sf_dir):
    d = ingest.dedup_requests(ingest.with_ids(observations(spark, sf_dir)))
    return d.select("request_id", "session_id", "method", "url", "captured_at", "response_status", "response_body", "response_time_ms", "observations")


@query(f"{INVENTORY} SELECT *, 'network' AS provenance, observation_count < 3 AS low_confidence FROM inv")
def endpoint_inventory(spark, sf_dir):
    return inventory(spark, sf_dir).drop("seq").withColumn("low_confidence", filters.low_confidence("observation_count"))


@query(f"{INVENTORY} SELECT inv.endpoint_id, inv.observation_count, count(m.request_id) AS request_count FROM inv LEFT JOIN (SELECT DISTINCT request_id, endpoint_id FROM ids) m ON m.endpoint_id = inv.endpoint_id GROUP BY 1, 2")
def endpoints_with_stats(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    return ingest.endpoints_with_stats(ingest.endpoints(log), ingest.request_endpoint_map(log)).select("endpoint_id", "observation_count", "request_count")


@query(V.sql(V.PAIRS_OUT, "seq bigint, method string, responded_at bigint, requested_at bigint, post_data string, response_time_ms bigint"))
def request_pairing(spark, sf_dir):
    e = V.frame(spark, V.PAIRS, "seq bigint, kind string, url string, method string, ts bigint, post_data string, trace_id string")
    return ingest.pair_requests(e).select("seq", "method", "responded_at", "requested_at", "post_data", "response_time_ms")


@query(f"WITH {EVENTS} SELECT count(*) AS n FROM obs WHERE NOT (session_id = '1' AND captured_at >= (SELECT min(captured_at) FROM obs) + 1000000) AND NOT (session_id = '2' AND captured_at < 9000000000000000)")
def pause_gate(spark, sf_dir):
    log = observations(spark, sf_dir)
    lo = log.agg(F.min("captured_at").alias("lo"))
    pauses = lo.select(F.explode(F.array(F.struct(F.lit("1").alias("session_id"), (F.col("lo") + 1_000_000).alias("paused_at"), F.lit(None).cast("bigint").alias("resumed_at")), F.struct(F.lit("2").alias("session_id"), F.lit(0).cast("bigint").alias("paused_at"), F.lit(9_000_000_000_000_000).alias("resumed_at")))).alias("p")).select("p.*")
    return ingest.outside_pauses(log, pauses).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN strlen(html) > 1500 THEN 'response-' || sha256(html) || '.txt' END AS html_path, CAST(strlen(html) AS INTEGER) AS html_size, page_id, strlen(html) <= 1500 AS inline FROM pages")
def body_offload(spark, sf_dir):
    rows, _ = ingest.offload_bodies(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "response", limit=1500)
    return rows.select("page_id", "html_path", "html_size", F.col("html").isNotNull().alias("inline"))


@query(V.sql(V.SSE_EVENTS, "stream_id string, pos int, event_type string, data string, event_id string"))
def sse_events(spark, sf_dir):
    rows = V.frame(spark, [r for r in V.SSE if r[0] != "s2"], "stream_id string, response_body string")
    return ingest.parse_sse(rows)


@query("SELECT * FROM (VALUES ('w1', CAST(100 AS BIGINT), CAST(140 AS BIGINT), CAST(3 AS BIGINT), 'closed'), ('w2', 150, NULL, 2, 'open')) AS t(ws_session_id, opened_at, closed_at, frame_count, status)")
def ws_sessions(spark, sf_dir):
    f = V.frame(spark, V.FRAMES, "id int, ws_session_id string, kind string, payload_text string, captured_at bigint")
    return ingest.ws_sessions(f.withColumns({"session_id": F.lit("x"), "url": F.lit("wss://a.com/s")})).select("ws_session_id", "opened_at", "closed_at", "frame_count", "status")


@query(
    "SELECT * FROM (VALUES (2, 25, true, 'welcome', false), (3, 61, true, 'subscribe', true), (4, 4, false, NULL, false), (7, 6, true, NULL, false), (8, 16, true, 'tick', false)) AS t(id, payload_size, is_json, message_type, is_subscription)"
)
def ws_frames(spark, sf_dir):
    f = V.frame(spark, V.FRAMES, "id int, ws_session_id string, kind string, payload_text string, captured_at bigint").filter("payload_text is not null")
    return ingest.ws_frames(f).select("id", "payload_size", "is_json", "message_type", "is_subscription")


@query(V.sql(V.SESSIONS_OUT, "label string, id string, valid boolean"))
def session_validity(spark, sf_dir):
    s = V.frame(spark, V.SESSIONS, "id string, created_at bigint, label string, cookies string, storage_state string")
    return ingest.valid_sessions(s, now_ms=90_000_001).select("label", "id", "valid")


# --- urls and filters


@query(f"WITH {PAGES} SELECT page_id, path, query_raw, base_url, host FROM u")
def url_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", urls.pathname("url").alias("path"), urls.query("url").alias("query_raw"), urls.base_url("url").alias("base_url"), urls.hostname("url").alias("host"))


@query(f"WITH {PAGES} SELECT page_id, {NORMAL} AS normalized_path, 'GET#' || {NORMAL} AS canonical_id FROM u")
def normalize_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.normalize_path(urls.pathname("url")).alias("normalized_path"))
    return p.withColumn("canonical_id", urls.canonical_id(F.lit("get"), "normalized_path"))


@query(V.sql([(p, t) for p, t in V.PATHS], "path string, template string"))
def fold_path_vectors(spark, sf_dir):
    return V.frame(spark, [(p,) for p, _ in V.PATHS], "path string").select("path", urls.fold_path("path").alias("template"))


@query(V.sql([(u, r) for u, *_, r, _ in V.TRAFFIC], "url string, reason string") + f" UNION ALL SELECT * FROM (WITH {PAGES} SELECT url, CASE WHEN regexp_matches(lower(path), '/(analytics|telemetry|metrics|events|track|collect|monitoring|session-replay)') THEN 'noise_path' END FROM u)")
def telemetry_drop_reasons(spark, sf_dir):
    v = V.frame(spark, V.TRAFFIC, "url string, kind string, method string, type string, status int, r string, api boolean").select("url")
    rows = v.unionByName(table(spark, sf_dir, "pages").select("url"))
    return rows.select("url", filters.telemetry_reason("url").alias("reason"))


@query(V.sql([(u, k, m, api, s is not None and 200 <= s < 400, bool(t) and ("json" in t or "text/" in t)) for u, k, m, t, s, _, api in V.TRAFFIC], "url string, kind string, method string, is_api boolean, succeeded boolean, json_like boolean"))
def api_request_filter(spark, sf_dir):
    v = V.frame(spark, V.TRAFFIC, "url string, kind string, method string, type string, status int, r string, api boolean")
    return v.select("url", "kind", "method", (filters.is_api_request("url", "kind") & (F.col("method") != "OPTIONS")).alias("is_api"), filters.succeeded("status").alias("succeeded"), F.coalesce(filters.is_json_like("type"), F.lit(False)).alias("json_like"))


@query(
    f"WITH {PAGES} SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' AS in_scope, host = 'm.example.com' AS exact_scope, "
    "regexp_matches(lower(path), '/login|/signin|/sign-in|/logout|/signout|/register|/signup|/auth|/oauth|/sso|/challenge|/captcha') AS auth_route FROM u"
)
def scope_and_auth_routes(spark, sf_dir):
    p, h = table(spark, sf_dir, "pages"), urls.hostname("url")
    return p.select("page_id", urls.in_scope(h, F.lit("example.com"), True).alias("in_scope"), urls.in_scope(h, F.lit("m.example.com"), False).alias("exact_scope"), filters.is_auth_route("url").alias("auth_route"))


@query(V.sql([(i, k, c) for i, (*_, k, c) in enumerate(V.BOUNDARIES)], "id int, kind string, confidence double"))
def auth_boundaries(spark, sf_dir):
    rows = [(i, s, a, b, h) for i, (s, a, b, h, _, _) in enumerate(V.BOUNDARIES)]
    v = V.frame(spark, rows, "id int, status int, current string, original string, html string").withColumn("b", filters.auth_boundary("status", "current", "original", "html"))
    return v.select("id", F.col("b.type").alias("kind"), F.col("b.confidence").alias("confidence"))


@query(
    "WITH t AS (SELECT page_id, html FROM pages) SELECT page_id, CASE WHEN regexp_matches(html, 'challenges.cloudflare.com|cf-turnstile|cf-challenge|_cf_chl_opt') THEN 'captcha_cloudflare' "
    "WHEN regexp_matches(html, 'google.com/recaptcha|g-recaptcha|grecaptcha') THEN 'captcha_recaptcha' WHEN regexp_matches(html, 'hcaptcha.com|h-captcha') THEN 'captcha_hcaptcha' "
    "WHEN regexp_matches(html, '(?i)<input[^>]*type *= *.?password') THEN 'login_form' END AS kind, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))) AS INTEGER) AS links FROM t"
)
def page_boundary_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return p.select("page_id", F.coalesce(filters.captcha("html"), filters.login_form("html"))["type"].alias("kind"), F.size(F.array_distinct(hrefs)).alias("links"))


@query(
    f"WITH {PAGES}, k AS (SELECT page_id, unnest(string_split(substr(query_raw, 2), '&')) AS kv FROM u WHERE query_raw IS NOT NULL), n AS (SELECT page_id, split_part(kv, '=', 1) AS name, substr(kv, position('=' IN kv) + 1) AS value FROM k) "
    "SELECT page_id, name, value, CASE WHEN regexp_matches(name, '(?i)^(page|offset|skip|from|start|cursor|after|before|limit|per_page|pageSize|page_size|size|count|take|first|last)$') THEN 'pagination' "
    "WHEN regexp_matches(name, '(?i)^(sort|sort_by|order_by|order|sortBy|orderBy|direction|sort_order)$') THEN 'sorting' WHEN regexp_matches(name, '(?i)^(q|query|search|filter|keyword|keywords|where|find)$') THEN 'filter' "
    "WHEN regexp_matches(name, '(?i)^(fields|select|include|exclude|expand|embed|populate|projection)$') THEN 'field_selection' WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'unknown' END AS class FROM n"
)
def query_param_classes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(urls.query_parameters(urls.query("url"))).alias("q"))
    return p.select("page_id", F.col("q.name").alias("name"), F.col("q.value").alias("value"), urls.parameter_class("q.name", "q.value").alias("class"))


# --- tokens

_WORDS = r"w AS (SELECT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS v FROM documents)"
_CLASS = r"""CASE WHEN regexp_full_match(v, '[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*') THEN 'jwt' WHEN regexp_full_match(lower(v), '[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN 'uuid'
  WHEN regexp_full_match(upper(v), '[0123456789ABCDEFGHJKMNPQRSTVWXYZ]{26}') THEN 'ulid' WHEN regexp_full_match(lower(v), '[0-9a-f]{24}') THEN 'mongo_object_id' WHEN regexp_full_match(lower(v), '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') THEN 'hash'
  WHEN regexp_full_match(v, '[0-9]+') AND ((length(v) = 10 AND TRY_CAST(v AS BIGINT) > 946684800 AND TRY_CAST(v AS BIGINT) < 2524608000) OR (length(v) = 13 AND TRY_CAST(v AS BIGINT) > 946684800000 AND TRY_CAST(v AS BIGINT) < 2524608000000)) THEN 'timestamp'
  WHEN regexp_full_match(v, '[0-9]+') THEN 'numeric_id' WHEN e = 'high' THEN 'opaque_token' ELSE 'unknown' END"""


@query(
    rf"WITH {_WORDS}, f AS (SELECT CASE WHEN regexp_full_match(lower(v), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'uuid' WHEN regexp_full_match(v, '[^ \t\n\x0B\f\r@]+@[^ \t\n\x0B\f\r@]+\.[^ \t\n\x0B\f\r@]+') THEN 'email' "
    r"WHEN regexp_matches(v, '(?i)^https?://') THEN 'uri' WHEN regexp_full_match(v, '([0-9]{1,3}\.){3}[0-9]{1,3}') THEN 'ipv4' END AS format FROM w) SELECT format, count(*) AS n FROM f GROUP BY format"
)
def string_formats(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).alias("v"))
    return w.groupBy(tokens.string_format("v").alias("format")).agg(F.count("*").alias("n"))


@query(
    rf"WITH {_WORDS}, d AS (SELECT DISTINCT v FROM w), x AS (SELECT v, CASE WHEN length(v) < 8 OR len(list_distinct(string_split(v, ''))) < 5 OR (regexp_full_match(v, '[0-9]+') AND length(v) < 10) THEN 'low' WHEN len(list_distinct(string_split(v, ''))) >= 16 AND length(v) >= 20 THEN 'high' ELSE 'medium' END AS e, "
    r"CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(v, '[a-z]+') THEN 'alpha_lower' WHEN regexp_full_match(v, '[A-Z]+') THEN 'alpha_upper' WHEN regexp_full_match(v, '[A-Za-z]+') THEN 'alpha' "
    rf"WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(v, '[0-9a-zA-Z]+') THEN 'alphanumeric' ELSE 'mixed' END AS charset FROM d), c AS (SELECT {_CLASS} AS type, e AS entropy, charset FROM x) SELECT type, entropy, charset, count(*) AS n FROM c GROUP BY ALL"
)
def token_classes(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).alias("v")).distinct()
    c = tokens.token_class("v")
    return w.select(c.alias("c"), tokens.charset("v").alias("charset")).groupBy(F.col("c.type").alias("type"), F.col("c.entropy").alias("entropy"), "charset").agg(F.count("*").alias("n"))


@query(V.sql(V.TOKENS, "value string, hint string, type string, entropy string, modifier double"))
def token_vectors(spark, sf_dir):
    v = V.frame(spark, [t[:2] for t in V.TOKENS], "value string, hint string").withColumn("c", tokens.token_class("value", F.col("hint")))
    return v.select("value", "hint", F.col("c.type").alias("type"), F.col("c.entropy").alias("entropy"), F.col("c.confidence_modifier").alias("modifier"))


# --- dependencies


def dependency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests that hand items on: an answer names one, a later request asks for one by path or bearer."""
    o = observations(spark, sf_dir)
    kind, k = F.split("path", "/"), F.get_json_object("response_body", "$.k")
    item = F.concat(F.lit("item_"), F.lpad((F.col("seq") % 100).cast("string"), 5, "0"))
    signup = F.get(kind, F.lit(2)) == "signups"
    return o.withColumns({
        "id": F.col("seq").cast("string"), "captured_at": F.floor(F.col("captured_at") / 10000), "response_body": F.to_json(F.struct(F.concat(F.lit("item_"), F.lpad(k, 5, "0")).alias("token"))),
        "request_headers": F.when(signup, F.to_json(F.struct(F.concat(F.lit("Bearer "), item).alias("Authorization")))),
        "path": F.concat(F.lit("/api/"), F.get(kind, F.lit(2)), F.when(signup, "").otherwise(F.concat(F.lit("/"), item))), "query_raw": F.lit(None).cast("string"),
    })


def dependency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.infer_dependencies(dependency_log(spark, sf_dir))


@query(f"{DEPS} SELECT src AS value, n AS frequency, CASE WHEN n = 1 THEN 0.1::DOUBLE WHEN n <= 5 THEN 0.0::DOUBLE WHEN n <= 20 THEN (-0.1)::DOUBLE ELSE (-0.3)::DOUBLE END AS score FROM freq ORDER BY n DESC, src LIMIT 20")
def token_frequency_topk(spark, sf_dir):
    log = dependency_log(spark, sf_dir).filter(filters.succeeded("response_status"))
    f = dependencies.token_frequency(dependencies.source_tokens(log))
    return f.orderBy(F.desc("frequency"), "value").limit(20).withColumn("score", tokens.frequency_score(F.col("frequency")))


@query(f"{DEPS} SELECT source_id, target_id, dependency_type, confidence FROM dep")
def token_dependencies(spark, sf_dir):
    return dependency_table(spark, sf_dir).select("source_id", "target_id", "dependency_type", "confidence")


@query(f"{DEPS} SELECT dependency_type, confidence >= 0.5::DOUBLE AS kept, count(*) AS n FROM dep GROUP BY ALL")
def dependency_thresholds(spark, sf_dir):
    kept, low = dependencies.persisted(d := cut(dependency_table(spark, sf_dir)))
    del low
    k = kept.groupBy("dependency_type").agg(F.count("*").alias("n")).withColumn("kept", F.lit(True))
    no = d.filter("confidence < 0.5").groupBy("dependency_type").agg(F.count("*").alias("n")).withColumn("kept", F.lit(False))
    return k.unionByName(no).select("dependency_type", "kept", "n")


@query(
    f"{DEPS}, tok AS (SELECT session_id, tgt AS v FROM item UNION ALL SELECT session_id, 'purchases' FROM item WHERE event_type = 'purchase'), per AS (SELECT session_id, src, count(*) AS n FROM item GROUP BY ALL), "
    "h AS (SELECT count(*) AS lookups, count(n) AS hits, coalesce(sum(n), 0) AS fanout FROM tok LEFT JOIN per ON per.session_id = tok.session_id AND per.src = tok.v), c AS (SELECT count(*) AS requests FROM item), t AS (SELECT count(*) AS token_cardinality FROM per) "
    "SELECT requests, lookups, hits, token_cardinality, requests::DOUBLE * (requests::DOUBLE - 1) / 2 / lookups::DOUBLE AS reduction_ratio, fanout::DOUBLE / hits AS average_fanout, hits / lookups::DOUBLE AS hit_rate FROM h, c, t"
)
def inference_metrics(spark, sf_dir):
    log = dependency_log(spark, sf_dir).filter(filters.succeeded("response_status"))
    return dependencies.inference_metrics(log, dependencies.source_tokens(log), dependencies.target_tokens(log))


# --- identity and summaries


def found_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("seq", "method", "url", F.lit("network").alias("provenance"), F.lit(1.0).alias("confidence"))
    i = F.col("page_id") % 4
    p = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("seq"), F.lit("GET").alias("method"), "url", F.when(i == 0, "static_bundle").when(i == 1, "inferred_route").when(i == 2, "persisted_query").otherwise("imported").alias("provenance"),
        F.when(F.col("page_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.7)).alias("confidence"),
    )
    return o.unionByName(p).withColumn("is_graphql", F.lit(False))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build_registry() -> tuple[DataFrame]:
        return (identity.resolve(found_endpoints(spark, sf_dir)),)

    return once(spark, sf_dir, ("events", "pages"), build_registry)[0]


@query(f"{FOUND} SELECT canonical_id, canonical_path, canonical_method, provenance_set, confidence, protocol, origin, merged, trust_state FROM registry")
def canonical_registry(spark, sf_dir):
    r = registry(spark, sf_dir).withColumn("provenance_set", F.array_join("provenance_set", ","))
    return r.select("canonical_id", "canonical_path", "canonical_method", "provenance_set", "confidence", "protocol", "origin", "merged", "trust_state")


@query(f"{FOUND} SELECT count(*) AS rest, CAST(0 AS BIGINT) AS graphql, CAST(0 AS BIGINT) AS websocket, count(*) FILTER (trust_state IN ('observed', 'discovered')) AS observed, count(*) FILTER (trust_state NOT IN ('observed', 'discovered')) AS inferred FROM registry")
def trust_and_protocol_counts(spark, sf_dir):
    return summary.registry_counts(registry(spark, sf_dir))


@query(f"{FOUND}, f AS (SELECT '/' || array_to_string(list_filter(string_split(canonical_path, '/'), lambda x: x <> '')[1:2], '/') AS route, seq FROM registry) SELECT route, count(*) AS n FROM f GROUP BY route ORDER BY n DESC, min(seq), route LIMIT 5")
def route_families_top5(spark, sf_dir):
    return summary.route_families(registry(spark, sf_dir))


@query(f"{FOUND} SELECT provenance, count(*) AS n FROM (SELECT DISTINCT provenance, method, canonical_path FROM canon) GROUP BY provenance")
def provenance_counts(spark, sf_dir):
    c = identity.canonical_columns(found_endpoints(spark, sf_dir)).select("provenance", "canonical_method", "canonical_path").distinct()
    return summary.provenance_counts(c)


@query(f"{FOUND} SELECT canonical_id, array_to_string(list_sort(list_distinct(list(origin))), ',') AS origins FROM (SELECT method || '#' || canonical_path AS canonical_id, origin FROM canon WHERE origin <> '') GROUP BY 1 HAVING count(DISTINCT origin) > 1")
def origin_ambiguity(spark, sf_dir):
    return identity.origin_conflicts(found_endpoints(spark, sf_dir)).select("canonical_id", F.array_join("origins", ",").alias("origins"))


@query(
    f"{INVENTORY}, r AS (SELECT count(DISTINCT request_id) AS n FROM ids), i AS (SELECT count(*) AS n, count(*) FILTER (observation_count < 3) AS low FROM inv), d AS (SELECT count(*) AS n FROM (WITH {PAGES} SELECT * FROM u WHERE regexp_matches(lower(path), '/(analytics|telemetry|metrics|events|track|collect|monitoring|session-replay)'))), "
    "f AS (SELECT count(*) AS t, count(*) FILTER (event_type <> 'error') AS s FROM events) SELECT r.n AS raw_requests, i.n AS deduplicated_endpoints, round((i.n - low) / i.n * 1000) / 10 AS schema_confidence_percent, CAST(0 AS BIGINT) AS failed_body_parses, d.n AS filtered_telemetry_count, CAST(0 AS BIGINT) AS graphql_operations, round(s / t * 1000) / 10 AS replay_success_rate_percent FROM r, i, d, f"
)
def metrics_row(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    _, drops = ingest.split_telemetry(table(spark, sf_dir, "pages").select("url"))
    ops, failures = graphql.graphql_operations(log.filter(filters.is_graphql_request("path", "request_body")).select("seq", "request_body"))
    replays = log.select((F.col("response_status") < 400).cast("int").alias("success"))
    return summary.metrics_row(log.select("request_id").distinct(), ingest.endpoints(log), drops, failures, ops, replays)


@query(f"{INVENTORY} SELECT 'requests' AS table_name, count(DISTINCT request_id) AS n FROM ids UNION ALL SELECT 'endpoints', count(*) FROM inv UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'corrections', 0")
def stats_row(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    return summary.table_counts({"requests": log.select("request_id").distinct(), "endpoints": ingest.endpoints(log), "pages": table(spark, sf_dir, "pages"), "corrections": None})


# --- graph


def dependency_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, components) of the dependencies that are kept, written once and read by what follows. The threshold is
    LEAST here, as hardly any dependency of these tables reaches the default of 0.5: popular values score low."""

    def build_dependency_graph() -> tuple[DataFrame, DataFrame, DataFrame]:
        log = dependency_log(spark, sf_dir)
        edges = cut(dependencies.numbered_edges(dependencies.persisted(dependency_table(spark, sf_dir), LEAST)[0]))
        nodes, edges = graph.from_tables(log.select("id", "url", "path", "method", "seq"), None, edges)
        edges = cut(edges)
        return nodes, edges, graph.components(nodes, edges)

    return once(spark, sf_dir, ("events",), build_dependency_graph)


#: Confidence from which on a dependency of the tables is an edge.
LEAST = 0.2


EDGE_SQL = f"{DEPS.replace('WITH', 'WITH RECURSIVE', 1)}, edge AS (SELECT source_id AS s, target_id AS t, dependency_type FROM dep WHERE confidence >= 0.2::DOUBLE)"


@query(f"{EDGE_SQL}, both_ways AS (SELECT s, t FROM edge UNION SELECT t, s FROM edge), reach(a, b) AS (SELECT s, s FROM both_ways UNION SELECT reach.a, both_ways.t FROM reach JOIN both_ways ON reach.b = both_ways.s), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a) SELECT CAST(seq AS VARCHAR) AS id, coalesce(m, CAST(seq AS VARCHAR)) AS component FROM obs LEFT JOIN c ON c.a = CAST(seq AS VARCHAR)")
def graph_components(spark, sf_dir):
    return dependency_graph(spark, sf_dir)[2].select("id", "component")


@query(f"{EDGE_SQL}, root AS (SELECT DISTINCT s FROM edge WHERE s NOT IN (SELECT t FROM edge)), reach(a, b) AS (SELECT s, s FROM root UNION SELECT reach.a, edge.t FROM reach JOIN edge ON reach.b = edge.s) SELECT a AS root, count(*) AS n_reached FROM reach GROUP BY a")
def graph_reachability(spark, sf_dir):
    _, edges, _ = dependency_graph(spark, sf_dir)
    roots = edges.select(F.col("source").alias("id")).distinct().join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    return graph.reachable(edges, roots).groupBy("root").agg(F.count("*").alias("n_reached"))


GRAPH_SQL = f"{EDGE_SQL}, {G.NODES}"


def literal_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = V.frame(spark, V.NODES, graph.NODE), V.frame(spark, V.EDGES, graph.EDGE)
    return nodes, edges, cut(graph.components(nodes, edges))


@query("SELECT * FROM (VALUES ('login', 0, CAST(0 AS BIGINT)), ('me', 1, 1), ('poll', 2, 2), ('ws', 3, 3)) AS t(node, level, position)")
def graph_bfs(spark, sf_dir):
    return graph.bfs(V.frame(spark, V.EDGES, graph.EDGE), "login").select("node", "level", "position")


@query("SELECT 'login|me|poll|ws' AS path")
def graph_shortest_path(spark, sf_dir):
    return spark.createDataFrame([("|".join(graph.shortest_path(V.frame(spark, V.EDGES, graph.EDGE), "login", "ws") or []),)], "path string")


def walk_start(comp: DataFrame) -> str:
    """The first node of the largest component; ids of log rows are numbers in the order of the log."""
    top = comp.agg(F.max_by(F.struct("component", "first_seq"), F.struct("size", -F.col("first_seq"))).alias("c")).first()["c"]
    return str(top["first_seq"])


@query(f"{GRAPH_SQL}, {G.BFS} {G.BFS_ROWS}")
def graph_bfs_tables(spark, sf_dir):
    _, edges, comp = dependency_graph(spark, sf_dir)
    return graph.bfs(edges, walk_start(comp)).select("node", "level", "position")


@query(f"{GRAPH_SQL}, {G.DFS}")
def graph_dfs(spark, sf_dir):
    return graph.dfs(*dependency_graph(spark, sf_dir))


@query(f"{GRAPH_SQL}, {G.BFS}, {G.SHORTEST}")
def graph_shortest_path_tables(spark, sf_dir):
    _, edges, comp = dependency_graph(spark, sf_dir)
    start = walk_start(comp)
    last = graph.bfs(edges, start).agg(F.max_by("node", "position")).first()[0]
    return spark.createDataFrame([("|".join(graph.shortest_path(edges, start, last) or []),)], "path string")


@query(f"{GRAPH_SQL}, {G.CLUSTERS}")
def clusters(spark, sf_dir):
    return graph.clusters(*dependency_graph(spark, sf_dir))


@query(f"{GRAPH_SQL}, {G.CHAINS}, {G.METRICS}")
def graph_metrics(spark, sf_dir):
    return graph.metrics(*dependency_graph(spark, sf_dir))


@query("SELECT * FROM (VALUES ('login', 'login|me'), ('poll', 'poll|ws')) AS t(start, chain)")
def auth_chains_literal(spark, sf_dir):
    return graph.auth_chains(*literal_graph(spark)).select("start", "chain")


@query(f"{GRAPH_SQL}, {G.CHAINS} SELECT component, start, CAST(length AS INTEGER) AS length, chain FROM chains")
def auth_chains(spark, sf_dir):
    return graph.auth_chains(*dependency_graph(spark, sf_dir))


@query("SELECT * FROM (VALUES ('polling', 2, 'me|poll'), ('polling', 2, 'poll|ws')) AS t(kind, length, path)")
def cycles_literal(spark, sf_dir):
    return graph.cycles(*literal_graph(spark)).select("kind", "length", "path")


@query("SELECT * FROM (VALUES ('auth_boundary_cluster', 4, 'login|me|poll|ws'), ('route_family_cluster', 2, 'list|del'), ('temporal_cluster', 1, 'lone'), ('graphql_cluster', 1, 'gql')) AS t(kind, size, members)")
def clusters_literal(spark, sf_dir):
    return graph.clusters(*literal_graph(spark)).select("kind", "size", "members")


@query("SELECT CAST(8 AS BIGINT) AS node_count, CAST(6 AS BIGINT) AS edge_count, (4 + 2 + 1 + 1)::DOUBLE / 4 AS average_chain_depth, CAST(2 AS BIGINT) AS auth_chain_count, CAST(2 AS BIGINT) AS cycle_count, CAST(4 AS BIGINT) AS connected_components, 6::DOUBLE / (8::DOUBLE * 7) AS graph_density")
def graph_metrics_literal(spark, sf_dir):
    return graph.metrics(*literal_graph(spark))


@query(f"{EDGE_SQL} SELECT (SELECT count(*) FROM obs) AS node_count, (SELECT count(*) FROM edge) AS edge_count, (SELECT count(*) FROM edge)::DOUBLE / ((SELECT count(*) FROM obs)::DOUBLE * ((SELECT count(*) FROM obs)::DOUBLE - 1)) AS graph_density")
def graph_size(spark, sf_dir):
    nodes, edges, _ = dependency_graph(spark, sf_dir)
    one = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    n = F.col("node_count").cast("double")
    return one.withColumn("graph_density", F.col("edge_count") / (n * (n - 1)))


@query(f"{GRAPH_SQL}, {G.UNIFIED}".replace("@NORMAL@", NORMAL))
def unify_graph(spark, sf_dir):
    nodes, edges, _ = dependency_graph(spark, sf_dir)
    n, e = identity.unify_graph(nodes, edges)
    loads = e.groupBy("source").agg(F.count("*").alias("out_edges"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    return n.join(loads, n["id"] == loads["source"], "left").select("id", "type", "url", "method", "trust_state", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("loops", F.lit(0)).alias("loops"))


# --- workflows and plans


@query(f"{GRAPH_SQL}, {G.FLOWS} {G.FLOW_ROWS}")
def workflow_models(spark, sf_dir):
    flows, _ = workflows.synthesize(*dependency_graph(spark, sf_dir))
    return flows.drop("wf_order")


@query("SELECT * FROM (VALUES ('type', 'authentication', CAST(1 AS BIGINT)), ('type', 'CRUD', 1), ('type', 'upload', 1), ('type', 'unknown', 1), ('viability', 'safely replayable', 1), ('viability', 'high-risk replay', 1), ('viability', 'unresolved replay', 2), ('critical_paths', '', 2)) AS t(what, value, n)")
def workflow_counts_literal(spark, sf_dir):
    flows, _ = workflows.synthesize(*literal_graph(spark))
    return workflows.counts(flows)


@query(f"{GRAPH_SQL}, {G.FLOWS} {G.FLOW_COUNTS}")
def workflow_type_counts(spark, sf_dir):
    flows, _ = workflows.synthesize(*dependency_graph(spark, sf_dir))
    return workflows.counts(flows)


_X1 = """x AS (SELECT canonical_id AS id, CASE trust_state WHEN 'unresolved' THEN 40 WHEN 'discovered' THEN 30 ELSE 50 END - CASE WHEN canonical_method IN ('DELETE', 'PUT', 'PATCH') THEN 20 WHEN canonical_method = 'POST' THEN 5 ELSE 0 END AS priority, 'endpoint' AS type,
  CASE WHEN canonical_method IN ('DELETE', 'PUT', 'PATCH') THEN 'dangerous' WHEN canonical_method = 'POST' THEN 'caution' ELSE 'safe' END AS safety FROM registry WHERE trust_state <> 'observed' AND NOT (trust_state = 'discovered' AND confidence < 0.6)),
y AS (SELECT 'explore_route_family_' || array_to_string(string_split(canonical_path, '/')[1:3], '/') AS id, 65 AS priority, 'route_family' AS type, 'safe' AS safety FROM registry GROUP BY 1 HAVING count(*) > 1 AND bool_and(trust_state <> 'observed'))"""


@query(f"{FOUND}, {_X1} SELECT * FROM x WHERE priority > 0 UNION ALL SELECT * FROM y")
def exploration_targets(spark, sf_dir):
    r = registry(spark, sf_dir)
    both = planning.endpoint_targets(r).unionByName(planning.family_targets(r))
    return both.select("id", "priority", "type", "safety")


@query(f"{GRAPH_SQL}, {FOUND_PARTS}, {G.FLOWS} {G.PLAN}")
def exploration_plan(spark, sf_dir):
    nodes, edges, comp = dependency_graph(spark, sf_dir)
    flows, roles = workflows.synthesize(nodes, edges, comp)
    return planning.exploration_plan(registry(spark, sf_dir), nodes, comp, workflows.numbered(flows), roles)


@query(f"{GRAPH_SQL}, {G.FLOWS} {G.PREREQUISITES}")
def exploration_prerequisites(spark, sf_dir):
    flows, roles = workflows.synthesize(*dependency_graph(spark, sf_dir))
    return planning.prerequisites(workflows.numbered(flows), roles)


@query(f"{GRAPH_SQL}, {G.REPLAY} SELECT * FROM place")
def replay_order(spark, sf_dir):
    return planning.replay_order(*dependency_graph(spark, sf_dir))


@query(f"{EDGE_SQL} SELECT s AS source, count(*) AS n_targets, string_agg(t, '|' ORDER BY CAST(t AS BIGINT)) AS targets, 'response.body.token' AS source_field, 'Authorization' AS target_header FROM edge WHERE dependency_type = 'token' GROUP BY s")
def auth_propagation(spark, sf_dir):
    nodes, edges, _ = dependency_graph(spark, sf_dir)
    return planning.auth_propagation(edges, nodes)


# --- schemas, GraphQL, bundles, pages


@query(f"""WITH {EVENTS} SELECT endpoint_id, CAST(response_status AS INTEGER) AS status, '{{"type": "object", "properties": {{"k": {{"type": "integer"}}}}, "required": ["k"]}}' AS fragment, count(*) AS samples FROM ids GROUP BY ALL""")
def schema_inference(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    return schema.response_schemas(log.select("endpoint_id", "response_status", "response_body", "seq"))


@query(f"""{INVENTORY}, o AS (SELECT endpoint_id, CAST(response_status AS INTEGER) AS status FROM ids GROUP BY ALL),
a AS (SELECT endpoint_id, string_agg('"' || status || '": {{"description": "Response for status ' || status || '", "content": {{"application/json": {{"schema": {{"type": "object", "properties": {{"k": {{"type": "integer"}}}}, "required": ["k"]}}}}}}}}', ', ' ORDER BY status) AS r FROM o GROUP BY endpoint_id)
SELECT path_template, lower(method) AS method, '{{"responses": {{' || r || '}}, ' || CASE WHEN observation_count < 3 THEN '"x-low-confidence": true, "x-observations": ' || observation_count || ', ' ELSE '' END
  || '"x-source": "network", "parameters": [{{"name": "' || regexp_extract(path_template, '[{{]([^}}]*)', 1) || '", "in": "path", "required": true, "schema": {{"type": "string"}}}}]}}' AS operation FROM inv JOIN a USING (endpoint_id)""")
def openapi_operations(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    schemas = schema.response_schemas(log.select("endpoint_id", "response_status", "response_body", "seq"))
    return schema.operations(ingest.endpoints(log), schemas)


def shaped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with bodies of four shapes by turns: a plain one, one with a text, and two with a date or another text."""
    log = ingest.with_ids(observations(spark, sf_dir))
    k, turn = F.get_json_object("response_body", "$.k").cast("int"), F.col("seq") % 4
    text, plain = F.struct(k.alias("k"), F.lit("abc").alias("v")), F.struct(F.lit("plain").alias("t"), k.alias("k"))
    body = F.when(turn == 0, F.to_json(F.struct(k.alias("k")))).when(turn == 1, F.to_json(text)).when(turn == 2, F.to_json(F.struct(k.alias("k"), F.lit("2024-01-01").alias("t")))).otherwise(F.to_json(plain))
    # one method has dates alone
    return log.withColumn("response_body", F.when((F.col("method") == "PUT") & (turn == 3), F.to_json(F.struct(F.lit("2024-02-02").alias("t"), k.alias("k")))).otherwise(body))


@query(f"""WITH {EVENTS}, key AS (SELECT endpoint_id, method, response_status AS status, seq, unnest(CASE seq % 4 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'v'] WHEN 2 THEN ['k', 't'] ELSE ['t', 'k'] END) AS name, generate_subscripts(CASE seq % 4 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'v'] WHEN 2 THEN ['k', 't'] ELSE ['t', 'k'] END, 1) AS i FROM ids),
prop AS (SELECT endpoint_id, any_value(method) AS method, status, name, count(*) AS n, min(seq * 10 + i) AS first, count(DISTINCT seq % 4) AS kinds, min(seq % 4) AS turn FROM key GROUP BY endpoint_id, status, name),
said AS (SELECT *, CASE name WHEN 'k' THEN '{{"type": "integer"}}' WHEN 'v' THEN '{{"type": "string"}}' ELSE CASE WHEN method = 'PUT' OR (kinds = 1 AND turn = 2) THEN '{{"type": "string", "format": "date"}}' ELSE '{{"type": "string"}}' END END AS type FROM prop),
total AS (SELECT endpoint_id, response_status AS status, count(*) AS samples FROM ids GROUP BY ALL)
SELECT endpoint_id, CAST(status AS INTEGER) AS status, '{{"type": "object", "properties": {{' || string_agg('"' || name || '": ' || type, ', ' ORDER BY first) || '}}, "required": [' || string_agg('"' || name || '"', ', ' ORDER BY first) FILTER (n = samples) || ']}}' AS fragment, samples
FROM said JOIN total USING (endpoint_id, status) GROUP BY endpoint_id, status, samples""")
def schema_merging(spark, sf_dir):
    return schema.response_schemas(shaped_log(spark, sf_dir).select("endpoint_id", "response_status", "response_body", "seq"))


@query(f"{INVENTORY} SELECT path_template, lower(method) AS method FROM inv WHERE observation_count % 2 = 0")
def approved_operations(spark, sf_dir):
    eps = inventory(spark, sf_dir).withColumn("status", F.when(F.col("observation_count") % 2 == 0, "approved").otherwise("new"))
    log = ingest.with_ids(observations(spark, sf_dir))
    schemas = schema.response_schemas(log.select("endpoint_id", "response_status", "response_body", "seq"))
    return schema.operations(eps, schemas, only_approved=True).select("path_template", "method")


@query(V.sql(V.GRAPHQL_IDS, "gql_id string, operation_type string, seq int"))
def graphql_upserts(spark, sf_dir):
    ops, _ = graphql.graphql_operations(V.frame(spark, [*V.GRAPHQL, (8, V.GRAPHQL[0][1])], "seq int, request_body string"))
    return graphql.upsert_operations(ops).select("gql_id", "operation_type", "seq")


@query("SELECT * FROM (VALUES ('query', CAST(4 AS BIGINT)), ('mutation', 1), ('subscription', 1)) AS t(operation_type, n)")
def graphql_breakdown(spark, sf_dir):
    return graphql.breakdown(graphql.graphql_operations(V.frame(spark, V.GRAPHQL, "seq int, request_body string"))[0])


@query(V.sql(V.IS_GRAPHQL, "path string, body string, asks boolean"))
def graphql_requests(spark, sf_dir):
    v = V.frame(spark, [x[:2] for x in V.IS_GRAPHQL], "path string, body string")
    return v.select("path", "body", filters.is_graphql_request("path", "body").alias("asks"))


@query(V.sql(V.SUBSCRIPTIONS_OUT, "id int, operation_type string, operation_name string, complexity int"))
def ws_subscription_operations(spark, sf_dir):
    ops, _ = graphql.subscription_operations(V.frame(spark, V.SUBSCRIPTIONS, "id int, payload_text string"))
    return ops.select("id", "operation_type", "operation_name", "complexity")


@query(V.sql(V.BATCHES_OUT, "id int, pos int, operation_name string, query_hash string, confidence double"))
def persisted_batches(spark, sf_dir):
    got, _ = graphql.recover_persisted(V.frame(spark, V.BATCHES, "id int, payload string"), V.frame(spark, V.KNOWN, "hash string, document string, seq int"))
    return got.select("id", "pos", "operation_name", "query_hash", "confidence")


@query("SELECT 'static_' || substr(sha256(concat_ws(':', method, url, '')), 1, 32) AS id, type, url, method, provenance FROM (VALUES ('GET', '/api/users', 'request', 'static_bundle'), ('POST', '/api/login', 'request', 'static_bundle'), ('GET', '/graphql', 'graphql_operation', 'static_bundle'), ('PUT', '/api/save', 'request', 'static_bundle'), ('GET', '/v2/a', 'request', 'source_map')) AS t(method, url, type, provenance)")
def script_nodes(spark, sf_dir):
    found = bundles.bundle_endpoints(V.frame(spark, V.BUNDLES, "file_name string, source_code string, is_source_map boolean"))
    nodes = graph.add_nodes(V.frame(spark, [], graph.NODE), bundles.static_nodes(found))
    return nodes.select("id", "type", "url", "method", "provenance")


@query(f"WITH {EVENTS} SELECT sha256(concat_ws(':', 'job', CAST(seq AS VARCHAR), '', '1000')) AS id, 'job' AS job_id, CAST(seq AS VARCHAR) AS original_request_id, CAST(response_status AS INTEGER) AS status_code, CAST(response_status < 400 AS INTEGER) AS success, response_time_ms AS latency_ms, CAST(1000 AS BIGINT) AS captured_at, 'replay' AS provenance FROM obs")
def replay_event_rows(spark, sf_dir):
    o = observations(spark, sf_dir)
    done = o.select(F.col("seq").cast("string").alias("original_request_id"), F.lit(None).cast("string").alias("replay_request_id"), F.col("response_status").alias("status_code"), (F.col("response_status") < 400).alias("success"), F.col("response_time_ms").alias("latency_ms"))
    return planning.replay_events(done, "job", "replay", 1000).drop("replay_request_id")


@query(f"{DEPS} SELECT sha256(concat_ws(':', source_id, target_id, dependency_type)) AS id, source_id AS source_request_id, target_id AS target_request_id, dependency_type, confidence FROM dep")
def replay_dependency_rows(spark, sf_dir):
    return planning.replay_dependencies(dependency_table(spark, sf_dir)).drop("evidence")


@query(f"WITH {EVENTS}, o AS (SELECT count(*) AS n, count(*) FILTER (response_status < 400) AS s FROM obs) SELECT n AS total_events, s AS successful_events, CAST(2 AS BIGINT) AS total_jobs, n AS total_dependencies, s / n * 100 AS success_rate FROM o")
def replay_metrics_row(spark, sf_dir):
    o = observations(spark, sf_dir).select((F.col("response_status") < 400).cast("int").alias("success"))
    return summary.replay_metrics(o, planning.new_jobs(spark, ["a", "b"], 1), o)


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(DISTINCT request_id) AS requests FROM ids WHERE session_id = (SELECT min(session_id) FROM ids)")
def session_requests(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    one = ingest.of_session(log, log.agg(F.min("session_id")).first()[0])
    return one.agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"))


@query(
    "WITH s AS (SELECT conv_id, string_agg('event: ' || role || chr(10) || 'data: ' || regexp_replace(text, '[\\s]+', ' ', 'g'), chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS n FROM conversations WHERE text IS NOT NULL AND trim(regexp_replace(text, '[\\s]+', ' ', 'g')) <> '' AND role IS NOT NULL GROUP BY conv_id) "
    "SELECT conv_id AS stream_id, CAST(least(strlen(body), 1048576) AS BIGINT) AS byte_count, strlen(body) > 1048576 AS truncated, n AS event_count FROM s"
)
def sse_roll_up(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"\s+", " ")).filter("text is not null and trim(text) <> '' and role is not null")
    line = F.concat(F.lit("event: "), F.col("role"), F.lit("\ndata: "), F.col("text"))
    rows = c.groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("response_body"))
    return ingest.sse_streams(rows, ingest.parse_sse(rows))


@query("SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN 2000 ELSE strlen(text) END AS kept_bytes FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')")
def body_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"^[\x00-\x7F]*\z"))
    return d.select("doc_id", F.octet_length(filters.capped_body("text", 2000)).cast("long").alias("kept_bytes"))


@query(V.sql(V.GRAPHQL_OUT, "seq int, operation_type string, operation_name string, complexity int, has_fragments boolean, is_persisted_query boolean, fragments string"))
def graphql_operations(spark, sf_dir):
    ops, _ = graphql.graphql_operations(V.frame(spark, V.GRAPHQL, "seq int, request_body string"))
    return ops.select("seq", "operation_type", "operation_name", "complexity", "has_fragments", "is_persisted_query", F.array_join("fragments", ",").alias("fragments"))


@query(V.sql(V.PERSISTED_OUT, "id int, operation_name string, query_hash string, document string, confidence double"))
def persisted_recovery(spark, sf_dir):
    got, _ = graphql.recover_persisted(V.frame(spark, V.PERSISTED, "id int, payload string"), V.frame(spark, V.KNOWN, "hash string, document string, seq int"))
    return got.select("id", "operation_name", "query_hash", "document", "confidence")


@query(V.sql(V.BUNDLE_OUT, "file_name string, method string, url string, offset int, type string, confidence double, provenance string, extraction_method string").replace("url, offset,", 'url, "offset",'))
def bundle_endpoints(spark, sf_dir):
    found = bundles.bundle_endpoints(V.frame(spark, V.BUNDLES, "file_name string, source_code string, is_source_map boolean"))
    return found.select("file_name", "method", "url", "offset", "type", "confidence", "provenance", "extraction_method")


LINKS = (
    f"WITH {PAGES}, h AS (SELECT u.page_id, regexp_replace(u.url, '#.*$', '') AS source, base_url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))) AS href FROM u JOIN pages ON pages.page_id = u.page_id), "
    "links AS (SELECT DISTINCT source, CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN regexp_replace(href, '#.*$', '') ELSE base_url || regexp_replace(href, '#.*$', '') END AS target FROM h)"
)


@query(f"{LINKS} SELECT * FROM links")
def page_links(spark, sf_dir):
    return bundles.page_links(table(spark, sf_dir, "pages").select("url", "html"))


@query(f"""{LINKS}, ok AS (SELECT source, target, lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host, lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)) AS path FROM links),
st AS (SELECT min(source) AS url FROM links),
e AS (SELECT source, target FROM ok, st WHERE host = lower(regexp_extract(st.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AND NOT regexp_matches(path, '/login|/signin|/sign-in|/logout|/signout|/register|/signup|/auth|/oauth|/sso|/challenge|/captcha')),
one AS (SELECT url, row_number() OVER (ORDER BY url) AS position FROM (SELECT DISTINCT target AS url FROM e, st WHERE source = st.url AND target <> st.url) ORDER BY url LIMIT 49),
two AS (SELECT target AS url, min(position) AS p FROM e JOIN one ON one.url = e.source WHERE target NOT IN (SELECT url FROM one) AND target <> (SELECT url FROM st) GROUP BY target)
SELECT url, 0 AS depth, CAST(0 AS BIGINT) AS position FROM st UNION ALL SELECT url, 1, position FROM one
UNION ALL SELECT url, 2, position FROM (SELECT url, (SELECT count(*) FROM one) + row_number() OVER (ORDER BY p, url) AS position FROM two) WHERE position < 50""")
def crawl(spark, sf_dir):
    links = cut(bundles.page_links(table(spark, sf_dir, "pages").select("url", "html")))
    start = links.agg(F.min("source")).first()[0]
    return bundles.crawl(links, start)


@query(f"{GRAPH_SQL}, {FOUND_PARTS}, {G.FLOWS}, {G.CHAINS}, {G.SUMMARY}".replace("@GRAPHQL@", str(len(V.GRAPHQL_OUT))))
def summary_row(spark, sf_dir):
    log = ingest.with_ids(observations(spark, sf_dir))
    nodes, edges, comp = dependency_graph(spark, sf_dir)
    flows, _ = workflows.synthesize(nodes, edges, comp)
    ops, _ = graphql.graphql_operations(V.frame(spark, V.GRAPHQL, "seq int, request_body string"))
    eps = ingest.endpoints(log)
    return summary.as_json(summary.summarize(ingest.dedup_requests(log), eps, ops, registry(spark, sf_dir), cut(flows), graph.auth_chains(nodes, edges, comp)))


# --- stores and files


def _fresh_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    f"WITH {EVENTS} SELECT request_id, arg_min(method, seq) AS method, arg_max(captured_at, seq) AS captured_at, CAST(arg_max(response_status, seq) AS INTEGER) AS response_status, count(*) AS observations FROM ids GROUP BY request_id"
)
def request_upserts(spark, sf_dir):
    """The request table kept by upserts of four batches, one of them played twice."""
    log, root = ingest.with_ids(observations(spark, sf_dir)), _fresh_root(spark, "requests")
    for k in (0, 1, 1, 2, 3):
        sinks.merge_table(spark, root, "requests", ingest.dedup_requests(log.filter(F.col("seq") % 4 == k)), ingest.merged_requests, f"batch-{k}")
    return sinks.read_merged(spark, root, "requests", ingest.merged_requests).select("request_id", "method", "captured_at", "response_status", "observations")


@query("SELECT page_id, sha256(html) AS digest, strlen(html) > 1500 AS stored FROM pages")
def object_store(spark, sf_dir):
    rows, objects = ingest.offload_bodies(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "response", limit=1500)
    root = _fresh_root(spark, "objects")
    for _ in range(2):
        path = sinks.write_objects(objects, root)
    back = ingest.read_bodies(rows, spark.read.parquet(path), "html")
    return back.select("page_id", F.sha2("html", 256).alias("digest"), F.col("html_path").isNotNull().alias("stored"))


@query(f"WITH {EVENTS} SELECT strftime(to_timestamp(captured_at / 1000), '%Y-%m-%d') AS day, count(*) AS n FROM obs GROUP BY 1")
def event_log_days(spark, sf_dir):
    rows = observations(spark, sf_dir).select("captured_at", "url")
    path = sinks.write_event_log(summary.events_log(rows, "capture"), _fresh_root(spark, "log"))
    return spark.read.json(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"{INVENTORY} SELECT '3.0.3' AS openapi, CAST(count(DISTINCT path_template) AS INTEGER) AS paths, CAST(0 AS INTEGER) AS errors FROM inv")
def openapi_file(spark, sf_dir):
    log, path = ingest.with_ids(observations(spark, sf_dir)), _fresh_root(spark, "openapi")
    schemas = schema.response_schemas(log.select("endpoint_id", "response_status", "response_body", "seq"))
    spec = schema.openapi(schema.operations(ingest.endpoints(log), schemas), "https://api.example.com")
    sinks.write_openapi(spec, spark, path)
    text = spark.read.text(path, wholetext=True)
    found = F.size(F.json_object_keys(F.get_json_object("value", "$.paths")))
    return text.select(F.get_json_object("value", "$.openapi").alias("openapi"), found.alias("paths"), F.lit(len(schema.validate(spec))).alias("errors"))


# --- further parts of the graph and of plans


@query(f"{GRAPH_SQL}, kept AS (SELECT id FROM comp WHERE CAST(id AS BIGINT) % 3 <> 0), live AS (SELECT s, t FROM edge2 WHERE s IN (SELECT id FROM kept) AND t IN (SELECT id FROM kept)) SELECT (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM live) AS edges, (SELECT count(*) FROM (SELECT s FROM edge2 UNION SELECT t FROM edge2 UNION SELECT id FROM kept)) AS completed")
def graph_edits(spark, sf_dir):
    """Nodes are taken out with their edges, then edges bring back the nodes that they need, and the rest are put in again."""
    nodes, edges, _ = dependency_graph(spark, sf_dir)
    gone = nodes.filter(F.col("id").cast("long") % 3 == 0).select("id")
    left, live = graph.remove_nodes(nodes, edges, gone)
    whole = graph.complete(graph.add_nodes(left, left.limit(5)), edges)
    return left.agg(F.count("*").alias("nodes")).crossJoin(live.agg(F.count("*").alias("edges"))).crossJoin(whole.agg(F.count("*").alias("completed")))


@query(f"{GRAPH_SQL}, sink AS (SELECT DISTINCT t FROM edge2 WHERE t NOT IN (SELECT s FROM edge2)), up(a, b) AS (SELECT t, t FROM sink UNION SELECT up.a, edge2.s FROM up JOIN edge2 ON edge2.t = up.b) SELECT a AS root, count(*) AS n_reached FROM up GROUP BY a")
def graph_upstream(spark, sf_dir):
    _, edges, _ = dependency_graph(spark, sf_dir)
    sinks_ = edges.select(F.col("target").alias("id")).distinct().join(edges.select(F.col("source").alias("id")), "id", "left_anti")
    return graph.reachable(edges, sinks_, "upstream").groupBy("root").agg(F.count("*").alias("n_reached"))


@query(f"{GRAPH_SQL}, deep(id, n) AS (SELECT id, 0 FROM comp WHERE id NOT IN (SELECT t FROM edge2) UNION SELECT edge2.t, n + 1 FROM deep JOIN edge2 ON edge2.s = deep.id) SELECT id, CAST(max(n) AS INTEGER) AS level FROM deep GROUP BY id")
def replay_levels(spark, sf_dir):
    nodes, edges, _ = dependency_graph(spark, sf_dir)
    return planning.replay_levels(nodes, edges)


@query(f"{GRAPH_SQL}, {G.REPLAY}, auth AS (SELECT s, string_agg(t, '|' ORDER BY k) AS targets FROM edge2 WHERE dependency_type = 'token' GROUP BY s) SELECT component, id, position, targets AS auth_targets, 'default' AS replay_group FROM place LEFT JOIN auth ON auth.s = id")
def replay_plan(spark, sf_dir):
    return planning.replay_plan(*dependency_graph(spark, sf_dir)).select("component", "id", "position", "auth_targets", "replay_group")


@query("SELECT * FROM (VALUES ('explore_disconnected_region', 'disconnected_region', 75, '{\"nodesCount\":1}')) AS t(id, type, priority, metadata)")
def disconnected_region(spark, sf_dir):
    nodes, _, comp = literal_graph(spark)
    return planning.disconnected_target(nodes, comp).select("id", "type", "priority", "metadata")


@query(f"{FOUND}, z AS (SELECT canonical_id AS id, CASE trust_state WHEN 'unresolved' THEN 40 WHEN 'discovered' THEN 30 ELSE 50 END - CASE WHEN canonical_method IN ('DELETE', 'PUT', 'PATCH') THEN 20 WHEN canonical_method = 'POST' THEN 5 ELSE 0 END - 15 * (seq % 5) AS priority, seq % 5 AS failures FROM registry WHERE trust_state <> 'observed' AND NOT (trust_state = 'discovered' AND confidence < 0.6)) SELECT id, CAST(priority AS INTEGER) AS priority FROM z WHERE failures <= 3 AND priority > 0")
def exploration_after_failures(spark, sf_dir):
    r = registry(spark, sf_dir)
    failed = r.select(F.col("canonical_id").alias("target_id"), F.explode(F.sequence(F.lit(1), (F.col("seq") % 5).cast("int") + 1)).alias("i"), (F.col("seq") % 5).alias("n")).filter("i <= n")
    return planning.endpoint_targets(r, failed).select("id", "priority")


# --- further functions


@query(
    rf"WITH {_WORDS}, d AS (SELECT DISTINCT v FROM w), x AS (SELECT v, length(v) AS n, CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(v, '[a-z]+') THEN 'alpha_lower' WHEN regexp_full_match(v, '[A-Z]+') THEN 'alpha_upper' WHEN regexp_full_match(v, '[A-Za-z]+') THEN 'alpha' "
    r"WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(v, '[0-9a-zA-Z]+') THEN 'alphanumeric' ELSE 'mixed' END AS charset FROM d), "
    r"y AS (SELECT n, charset, array_to_string(list_sort(list_distinct(regexp_extract_all(v, '[-_.:|]'))), '') AS delimiters, CASE WHEN n >= 16 AND charset NOT IN ('numeric', 'hex') AND regexp_full_match(v, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') THEN 'base64;' ELSE '' END || "
    r"CASE WHEN regexp_full_match(v, '[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*') THEN 'base64url;' ELSE '' END AS hints FROM x) SELECT charset, delimiters, hints, count(*) AS n, CAST(sum(n) AS BIGINT) AS characters FROM y GROUP BY ALL"
)
def token_metadata(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).alias("v")).distinct()
    m = w.select(tokens.token_metadata("v").alias("m"))
    hints = F.array_join(F.transform("m.encoding_hints", lambda x: F.concat(x, F.lit(";"))), "")
    g = m.groupBy(F.col("m.charset").alias("charset"), F.array_join(F.array_sort("m.delimiters"), "").alias("delimiters"), hints.alias("hints"))
    return g.agg(F.count("*").alias("n"), F.sum("m.length").cast("long").alias("characters"))


@query(f"{INVENTORY} SELECT path_template, array_to_string(regexp_extract_all(path_template, '[{{]([^}}]+)[}}]', 1), ',') AS names FROM inv")
def template_parameters(spark, sf_dir):
    return inventory(spark, sf_dir).select("path_template", F.array_join(urls.path_parameters("path_template"), ",").alias("names"))


@query("SELECT * FROM (VALUES ('PHPSESSIONID', true), ('sid', false), ('x-Auth', true), ('jwt_', true), ('csrfToken', true), ('', false)) AS t(name, auth)")
def auth_cookies(spark, sf_dir):
    names = V.frame(spark, [("PHPSESSIONID",), ("sid",), ("x-Auth",), ("jwt_",), ("csrfToken",), ("",)], "name string")
    return names.select("name", filters.is_auth_cookie("name").alias("auth"))


@query("SELECT * FROM (VALUES ('c'), ('d'), ('e')) AS t(id)")
def deleted_sessions(spark, sf_dir):
    return ingest.delete_sessions(V.frame(spark, V.SESSIONS, "id string, created_at bigint, label string, cookies string, storage_state string"), "main").select("id")


@query("SELECT * FROM (VALUES (1, 'Named', 'query R { r }'), (2, 'Kept', 'query Kept { k }'), (3, NULL, '')) AS t(id, operation_name, document)")
def enriched_operations(spark, sf_dir):
    found = V.frame(spark, [(1, None, ""), (2, "Kept", "query Kept { k }"), (3, None, "")], "id int, operation_name string, document string")
    back = V.frame(spark, [(1, "Named", "query R { r }"), (3, None, None)], "id int, operation_name string, document string")
    return graphql.enrich(found, back).select("id", "operation_name", "document")


# --- streaming


@query(f"{INVENTORY} SELECT endpoint_id, method, path_template, observation_count, first_seen_at, last_seen_at FROM inv")
def streaming_endpoint_counts(spark, sf_dir):
    from hearsay.sources.observations import from_events
    from hearsay.streaming.endpoints import endpoint_stream, read_endpoints

    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    known = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(known).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    endpoint_stream(from_events(events), root, f"{root}/_checkpoint").awaitTermination()
    return read_endpoints(spark, root).select("endpoint_id", "method", "path_template", "observation_count", "first_seen_at", "last_seen_at")
