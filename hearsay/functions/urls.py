"""URL expressions: splitting, template folding, canonical paths, scopes and parameter classes. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: A path segment that stands for a value: uuid, object id, number, long hex, or any token of 20 characters or more.
DYNAMIC = rf"^(?:{UUID}|[0-9a-fA-F]{{24}}|[0-9]+|[0-9a-fA-F]{{12,}}|[A-Za-z0-9_-]{{20,}})\z"
#: scheme, authority, path, query of an absolute URL.
_ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def scheme(url: str | Column) -> Column:
    return F.lower(_empty_to_null(F.regexp_extract(col(url), _ABSOLUTE, 1)))


def authority(url: str | Column) -> Column:
    """Host with a port that isn't the scheme's own, lower case, without user names."""
    raw = F.lower(F.regexp_replace(_empty_to_null(F.regexp_extract(col(url), _ABSOLUTE, 2)), "^.*@", ""))
    own = F.when(scheme(url).isin("http", "ws"), r":80\z").when(scheme(url).isin("https", "wss"), r":443\z").otherwise("$^")
    return F.regexp_replace(raw, own, F.lit(""))


def hostname(url: str | Column) -> Column:
    return F.regexp_replace(authority(url), r":[0-9]+\z", "")


def is_absolute(url: str | Column) -> Column:
    return F.coalesce(col(url).rlike(_ABSOLUTE), F.lit(False))


def pathname(url: str | Column) -> Column:
    """Path, ``/`` where it is empty or the url can't be split."""
    return F.coalesce(_empty_to_null(F.regexp_extract(col(url), _ABSOLUTE, 3)), F.lit("/"))


def query(url: str | Column) -> Column:
    """Query with its question mark; null if there is none."""
    q = F.regexp_extract(col(url), _ABSOLUTE, 4)
    return F.when(F.length(q) > 1, q)


def base_url(url: str | Column) -> Column:
    """scheme://host[:port]; empty where the url can't be split."""
    return F.when(is_absolute(url), F.concat(scheme(url), F.lit("://"), authority(url))).otherwise("")


def is_dynamic(segment: str | Column) -> Column:
    return col(segment).rlike(DYNAMIC)


def parameter_name(previous: Column) -> Column:
    """Name of the value after a segment: singular of the segment and Id; ``id`` at the start."""
    n = F.length(previous)
    singular = (
        F.when(previous.endswith("ies"), F.concat(F.substring(previous, F.lit(1), n - 3), F.lit("y")))
        .when(previous.endswith("ses"), F.substring(previous, F.lit(1), n - 2))
        .when(previous.endswith("s") & ~previous.endswith("ss"), F.substring(previous, F.lit(1), n - 1))
        .otherwise(previous)
    )
    return F.when(previous.isNull(), "id").otherwise(F.concat(singular, F.lit("Id")))


def fold_path(path: str | Column) -> Column:
    """Path to template: each dynamic segment becomes {name}, named after the raw segment before it; a name that is
    taken gets 2, 3 and so on. Expressed as arrays, so it stays inside one projection."""
    parts = F.array_remove(F.split(F.coalesce(col(path), F.lit("")), "/"), "")
    named = F.transform(parts, lambda s, i: F.struct(s.alias("raw"), F.when(is_dynamic(s), parameter_name(F.get(parts, i - 1))).alias("name")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        # names in use are kept apart from the output, since a literal segment may look like a template
        again = F.size(F.filter(acc["used"], lambda u: u == x["name"]))
        shown = F.when(again == 0, x["name"]).otherwise(F.concat(x["name"], (again + 1).cast("string")))
        return F.when(
            x["name"].isNotNull(),
            F.struct(F.concat(acc["used"], F.array(x["name"])).alias("used"), F.concat(acc["out"], F.array(F.concat(F.lit("{"), shown, F.lit("}")))).alias("out")),
        ).otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["out"], F.array(x["raw"])).alias("out")))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(named, start, add, lambda acc: acc["out"]), "/"))


def path_parameters(template: str | Column) -> Column:
    return F.regexp_extract_all(col(template), F.lit(r"\{([^}]+)\}"), F.lit(1))


def origin_of(url: str | Column) -> Column:
    """scheme://host of http and ws urls, else empty."""
    u = F.trim(col(url))
    return F.when(u.rlike("^(?:http|ws)") & is_absolute(u), base_url(u)).otherwise("")


def protocol_of(url: str | Column) -> Column:
    u = F.trim(col(url))
    return F.when(u.rlike("^(?:http|ws)") & is_absolute(u), scheme(u)).otherwise("unknown")


def normalize_path(path: str | Column) -> Column:
    """Canonical path: no query, no trailing slash, ids as ``:id``. Neighbouring numbers fold every other time, as one
    replacement consumes the slash between them."""
    p = F.regexp_replace(col(path), r"(?s)\?.*$", "")
    p = F.regexp_replace(p, r"/\z", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, rf"(?i)/{UUID}", "/:id")
    p = F.regexp_replace(p, r"/[0-9]+\z", "/:id")
    return F.regexp_replace(p, r"/[0-9]+/", "/:id/")


def canonical_id(method: str | Column, path: str | Column) -> Column:
    return F.concat(F.upper(col(method)), F.lit("#"), col(path))


def first_segments(path: str | Column, n: int) -> Column:
    parts = F.array_remove(F.split(col(path), "/"), "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))


def in_scope(link_host: Column, target_host: Column, subdomains: bool | Column) -> Column:
    sub = subdomains if isinstance(subdomains, Column) else F.lit(subdomains)
    return (link_host == target_host) | (sub & link_host.endswith(F.concat(F.lit("."), target_host)))


# --- query parameters

#: Names by class; tested in this order, whole name, any case.
PARAMETER_NAMES = (
    ("pagination", r"^(page|offset|skip|from|start|cursor|after|before)\z"),
    ("pagination", r"^(limit|per_page|pageSize|page_size|size|count|take|first|last)\z"),
    ("sorting", r"^(sort|sort_by|order_by|order|sortBy|orderBy|direction|sort_order)\z"),
    ("filter", r"^(q|query|search|filter|keyword|keywords|where|find)\z"),
    ("field_selection", r"^(fields|select|include|exclude|expand|embed|populate|projection)\z"),
)


def parameter_class(name: str | Column, value: str | Column) -> Column:
    name, value = col(name), col(value)
    out = F.lit(None).cast("string")
    for kind, pattern in PARAMETER_NAMES:
        out = F.coalesce(out, F.when(name.rlike("(?i)" + pattern), kind))
    by_value = (
        F.when(value.rlike(rf"^(?:{UUID})\z"), "identifier")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(value).isNotNull(), "temporal")
        .when(value.isin("true", "false"), "boolean")
        .otherwise("unknown")
    )
    return F.coalesce(out, by_value)


def query_parameters(query_raw: str | Column) -> Column:
    """Array of (name, value, pos), decoded; the last of a repeated name stays."""
    raw = F.regexp_replace(col(query_raw), r"^\?", "")
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    out = F.transform(
        pairs,
        lambda p, i: F.struct(decode(F.substring_index(p, "=", 1)).alias("name"), F.when(p.contains("="), decode(F.substring(p, F.locate("=", p) + 1, F.length(p)))).otherwise("").alias("value"), i.alias("pos")),
    )
    return F.filter(out, lambda x: ~F.exists(out, lambda y: (y["name"] == x["name"]) & (y["pos"] > x["pos"])))
