"""Predicates: what counts as API traffic, as noise, as a boundary of authentication. No UDF, so they push down."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.urls import base_url, col, is_absolute, pathname

ASSETS = r"(?i)\.(png|jpg|jpeg|gif|webp|css|woff2?|woff|ttf|eot|js|ico|svg|map)\z"
BODY_LIMIT, OFFLOAD_LIMIT = 1 << 20, 1 << 16

# Parts of urls of third-party telemetry, and of paths that telemetry uses.
NOISE_DOMAINS = (
    "google-analytics.com", "googletagmanager.com", "facebook.com/tr", "doubleclick.net", "hotjar.com", "segment.io", "sentry.io",
    "cdn.amplitude.com", "mixpanel.com", "logrocket", "lr-ingest", "datadoghq", "newrelic", "fullstory", "clarity.ms", "launchdarkly",
    "posthog", "intercom", "rudderstack", "bugsnag", "heapanalytics", "statsig", "snowplowanalytics", "fonts.googleapis.com",
    "fonts.gstatic.com", "cdnjs.cloudflare.com", "unpkg.com", "cdn.jsdelivr.net",
)
NOISE_PATHS = ("/analytics", "/telemetry", "/metrics", "/events", "/track", "/collect", "/monitoring", "/session-replay")
AUTH_PATHS = ("/login", "/signin", "/sign-in", "/logout", "/signout", "/register", "/signup", "/auth", "/oauth", "/sso", "/challenge", "/captcha")
LOGIN_PATHS = ("/login", "/signin", "/sign-in", "/auth", "/authenticate", "/sso", "/oauth", "/accounts/login", "/session/new")
CAPTCHAS = (
    ("captcha_cloudflare", ("challenges.cloudflare.com", "cf-turnstile", "cf-challenge", "_cf_chl_opt")),
    ("captcha_recaptcha", ("google.com/recaptcha", "g-recaptcha", "grecaptcha")),
    ("captcha_hcaptcha", ("hcaptcha.com", "h-captcha")),
)
AUTH_TEXTS = (
    r"please\s+(log|sign)\s*in", r"you\s+must\s+(log|sign)\s*in", r"authentication\s+required", r"access\s+denied", r"unauthorized",
    r"login\s+to\s+continue", r"sign\s+in\s+to\s+continue", r"session\s+expired", r"your\s+session\s+has\s+expired",
)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(p) for p in parts))


def is_api_request(url: str | Column, resource_type: str | Column) -> Column:
    return F.coalesce(col(resource_type).isin("xhr", "fetch"), F.lit(False)) & ~F.coalesce(col(url).rlike(ASSETS), F.lit(False))


def is_json_like(content_type: str | Column) -> Column:
    c = col(content_type)
    return contains_any(c, ("application/json", "application/graphql+json", "application/problem+json", "application/ld+json", "text/")) | c.rlike(r"(?i)\+json")


def capped_body(body: str | Column, limit: int = BODY_LIMIT) -> Column:
    """The body cut to ``limit`` bytes (a character that the cut splits is replaced)."""
    b = col(body)
    return F.when(F.octet_length(b) > limit, F.decode(F.substring(F.encode(b, "utf-8"), 1, limit), "utf-8")).otherwise(b)


def telemetry_reason(url: str | Column, origin: str | Column | None = None, same_origin: bool = False, path_prefixes: tuple[str, ...] = ()) -> Column:
    """Why a request is noise (noise_domain, noise_path, allow_same_origin, allow_path_prefix), null if it isn't."""
    u = col(url)
    path = F.when(is_absolute(u), F.lower(pathname(u)))
    reasons = [F.when(contains_any(u, NOISE_DOMAINS), "noise_domain"), F.when(contains_any(path, NOISE_PATHS), "noise_path")]
    if same_origin and origin is not None:
        o = col(origin)
        reasons.append(F.when((o != "") & ~(is_absolute(u) & is_absolute(o) & (base_url(u) == base_url(o))), "allow_same_origin"))
    if path_prefixes:
        allowed = reduce(or_, (path.startswith(p.lower()) for p in path_prefixes))
        reasons.append(F.when(~F.coalesce(allowed, F.lit(False)), "allow_path_prefix"))
    return F.coalesce(*reasons)


def is_auth_route(url: str | Column) -> Column:
    return F.coalesce(F.when(is_absolute(url), contains_any(F.lower(pathname(url)), AUTH_PATHS)), F.lit(False))


def _event(kind: Column | str, confidence: float, when: Column) -> Column:
    return F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(float(confidence)).alias("confidence")))


def http_auth_boundary(status: str | Column) -> Column:
    s = col(status)
    return F.coalesce(_event("http_401", 1.0, s == 401), _event("http_403", 0.9, s == 403))


def login_redirect(current: str | Column, original: str | Column) -> Column:
    now, before = F.lower(col(current)), F.lower(col(original))
    moved = reduce(or_, (now.contains(p) & ~before.contains(p) for p in LOGIN_PATHS))
    return _event("login_redirect", 0.95, (col(current) != col(original)) & moved)


def captcha(html: str | Column) -> Column:
    return F.coalesce(*(_event(kind, 0.95, contains_any(col(html), parts)) for kind, parts in CAPTCHAS))


def login_form(html: str | Column) -> Column:
    """A password field, else one of the texts that ask for a login in the first 5000 characters of visible text."""
    h = col(html)
    text = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    asks = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 5000).rlike("(?i)" + "|".join(AUTH_TEXTS))
    return F.coalesce(_event("login_form", 0.9, h.rlike(r"(?i)<input[^>]*\btype\s*=\s*[\"']?password\b")), _event("auth_required_text", 0.7, asks))


def auth_boundary(status: str | Column, current: str | Column, original: str | Column, html: str | Column) -> Column:
    """The first of: status, redirect, captcha, form. Later ones aren't looked at."""
    return F.coalesce(http_auth_boundary(status), login_redirect(current, original), captcha(html), login_form(html))


def is_auth_cookie(name: str | Column) -> Column:
    return col(name).rlike("(?i)session|token|auth|jwt")


def succeeded(status: str | Column) -> Column:
    return (col(status) >= 200) & (col(status) < 400)


def looks_json(text: str | Column) -> Column:
    return col(text).rlike(r"^\s*[\{\[]")


def session_valid(created_ms: str | Column, cookies: str | Column, storage_state: str | Column, now_ms: int | Column, max_age_ms: int = 24 * 3600 * 1000) -> Column:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.coalesce((col(cookies).isNotNull() | col(storage_state).isNotNull()) & (now - col(created_ms) < max_age_ms), F.lit(False))


def is_graphql_request(path: str | Column, body: str | Column) -> Column:
    """/graphql in the path, or a body whose every item has a query text or a persisted query."""
    b = F.btrim(col(body), F.lit(" \t\r\n"))
    items = F.when(b.startswith("["), F.from_json(b, "array<string>")).when(b.startswith("{"), F.array(b))

    def text(x: Column) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), "$.query", "variant")) == "STRING"

    asks = F.forall(items, lambda x: F.coalesce(F.get_json_object(x, "$.extensions.persistedQuery").isNotNull(), F.lit(False)) | F.coalesce(text(x), F.lit(False)))
    return col(path).rlike("(?i)/graphql") | F.coalesce((F.size(items) > 0) & asks, F.lit(False))


def is_graphql_subscription(frame: str | Column) -> Column:
    f = col(frame)
    kind = F.lower(F.get_json_object(f, "$.type"))
    return F.coalesce(kind.isin("subscribe", "start", "data", "next") & F.get_json_object(f, "$.payload").rlike(r"^\s*[\{\[]"), F.lit(False))


def low_confidence(observations: str | Column, least: int = 3) -> Column:
    return col(observations) < least
