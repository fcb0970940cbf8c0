"""Token expressions: string formats, semantic token classes, entropy, charsets, and the scores of a propagated value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.urls import UUID, col

# Shapes of tokens.
JWT = r"^[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*\z"
UUID_VERSIONED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
ULID = r"(?i)^[0123456789ABCDEFGHJKMNPQRSTVWXYZ]{26}\z"
OBJECT_ID = r"(?i)^[0-9a-f]{24}\z"
HASH = r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?\z"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
IPV4 = r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z"


def string_format(value: str | Column) -> Column:
    """uuid, date, date-time, email, uri, ipv4 or null."""
    v = col(value)
    return (
        F.when(v.rlike(rf"^{UUID}\z"), "uuid")
        .when(v.rlike(ISO_DATE) & F.try_to_timestamp(v).isNotNull(), F.when(v.contains("T"), "date-time").otherwise("date"))
        .when(v.rlike(EMAIL), "email")
        .when(v.rlike("(?i)^https?://"), "uri")
        .when(v.rlike(IPV4), "ipv4")
    )


def charset(value: str | Column) -> Column:
    v = col(value)
    return (
        F.when(v.rlike(r"^[0-9]+\z"), "numeric")
        .when(v.rlike(r"^[a-z]+\z"), "alpha_lower")
        .when(v.rlike(r"^[A-Z]+\z"), "alpha_upper")
        .when(v.rlike(r"^[A-Za-z]+\z"), "alpha")
        .when(v.rlike(r"(?i)^[0-9a-f]+\z"), "hex")
        .when(v.rlike(r"(?i)^[0-9a-z]+\z"), "alphanumeric")
        .otherwise("mixed")
    )


def distinct_characters(value: str | Column) -> Column:
    return F.size(F.array_distinct(F.array_remove(F.split(col(value), ""), "")))


def entropy(value: str | Column) -> Column:
    v = col(value)
    kinds, n = distinct_characters(v), F.length(v)
    return F.when((n < 8) | (kinds < 5) | (v.rlike(r"^[0-9]+\z") & (n < 10)), "low").when((kinds >= 16) & (n >= 20), "high").otherwise("medium")


def delimiters(value: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(value), F.lit(r"([-_.:|])"), F.lit(1)))


def encoding_hints(value: str | Column) -> Column:
    v = col(value)
    base64 = (F.length(v) >= 16) & ~charset(v).isin("numeric", "hex") & v.rlike(BASE64)
    return F.filter(F.array(F.when(base64, F.lit("base64")), F.when(v.rlike(JWT), F.lit("base64url"))), lambda x: x.isNotNull())


def _seconds(v: Column) -> Column:
    n = F.when(F.length(v).isin(10, 13), v.try_cast("bigint"))
    return ((F.length(v) == 10) & (n > 946684800) & (n < 2524608000)) | ((F.length(v) == 13) & (n > 946684800000) & (n < 2524608000000))


def token_class(value: str | Column, hint: str | Column = "") -> Column:
    """Struct (type, entropy, confidence_modifier): what a value is, and how far a match of it can be trusted."""
    v = F.coalesce(col(value), F.lit(""))
    h = F.lower(F.coalesce(hint if isinstance(hint, Column) else F.lit(hint), F.lit("")))
    e = entropy(v)

    def d(x: float) -> Column:
        return F.lit(float(x))

    base64 = F.array_contains(encoding_hints(v), "base64")
    numeric = v.rlike(r"^[0-9]+\z")
    cookie = h.contains("cookie") | h.contains("session")
    cursor = h.contains("cursor") | h.contains("after") | h.contains("before")
    def kind(name: str, modifier: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), modifier.alias("m"))

    found = (
        F.when(v.rlike(JWT), kind("jwt", F.when(h.contains("authorization"), d(0.2) + d(0.1)).otherwise(d(0.2))))
        .when(v.rlike(UUID_VERSIONED), kind("uuid", d(0.05)))
        .when(v.rlike(ULID), kind("ulid", d(0.05)))
        .when(v.rlike(OBJECT_ID), kind("mongo_object_id", d(0.05)))
        .when(v.rlike(HASH), kind("hash", d(-0.1)))
        .when(numeric & _seconds(v), kind("timestamp", d(-0.4)))
        .when(numeric, kind("numeric_id", F.when(F.length(v) < 5, d(-0.2)).otherwise(d(0))))
        .when(h.contains("csrf"), kind("csrf_token", d(0.1)))
        .when(cookie, kind("session_cookie", d(0.1)))
        .when(cursor, kind("graphql_cursor", F.when(base64, d(0.05)).otherwise(d(0))))
        .when(e == "high", kind("opaque_token", d(0.05)))
        .otherwise(kind("unknown", d(-0.1)))
    )
    m = found["m"] - F.when(e == "low", d(0.15)).otherwise(d(0))
    return F.struct(found["type"].alias("type"), e.alias("entropy"), m.alias("confidence_modifier"))


def token_metadata(value: str | Column) -> Column:
    v = col(value)
    return F.struct(F.length(v).alias("length"), charset(v).alias("charset"), encoding_hints(v).alias("encoding_hints"), delimiters(v).alias("delimiters"))


def base_confidence(kind: str | Column) -> Column:
    k = col(kind)
    known = (("token", 0.95), ("cookie", 0.9), ("csrf", 0.85), ("path_param", 0.7), ("query_param", 0.75), ("graphql_var", 0.85))
    out = F.lit(None).cast("double")
    for name, x in known:
        out = F.coalesce(out, F.when(k == name, F.lit(x)))
    return F.coalesce(out, F.lit(0.8))


def temporal_score(source_ms: Column, target_ms: Column) -> Column:
    gap = F.abs(target_ms - source_ms)
    return F.when(gap.isNull(), F.lit(0.0)).when(gap <= 5000, F.lit(0.1)).when(gap <= 30000, F.lit(0.0)).when(gap <= 120000, F.lit(-0.1)).otherwise(F.lit(-0.2))


def frequency_score(frequency: Column) -> Column:
    n = F.coalesce(frequency, F.lit(1))
    return F.when(n == 1, F.lit(0.1)).when(n <= 5, F.lit(0.0)).when(n <= 20, F.lit(-0.1)).otherwise(F.lit(-0.3))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null of nothing."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10)
