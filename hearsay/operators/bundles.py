"""Endpoints named in script texts and links named in pages, found by patterns in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions import urls
from hearsay.functions.filters import is_auth_route
from hearsay.operators.ingest import endpoint_id

# What calls, sockets and routes look like.
CALL = r"(?i)(?:fetch|axios\.(get|post|put|delete|patch)?)\s*\(\s*[\"'`](/[a-zA-Z0-9\-/_]+)[\"'`]"
XHR = r"(?i)\.open\(\s*[\"'`](GET|POST|PUT|DELETE|PATCH)[\"'`]\s*,\s*[\"'`](/[a-zA-Z0-9\-/_]+)[\"'`]"
SOCKET = r"new\s+WebSocket\(\s*[\"'`]((?:ws|wss)://[^\"'`]+)[\"'`]\s*\)"
ROUTE = r"(?:path|route):\s*[\"'`](/[a-zA-Z0-9\-/_:*]+)[\"'`]"


def is_minified(code: str | Column) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    lines, n = F.size(F.split(c, "\n")), F.length(c)
    return ((lines < 5) & (n > 500)) | (n / lines > 150)


def _pairs(code: Column, pattern: str, method: int | None, url: int) -> Column:
    """Array of (method, url, offset): texts between matches give their places, so the offset needs no second language."""
    hits = F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    gaps = F.split(code, pattern)
    names = F.regexp_extract_all(code, F.lit(pattern), F.lit(method)) if method else None
    found = F.regexp_extract_all(code, F.lit(pattern), F.lit(url))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    places = F.aggregate(
        F.arrays_zip(gaps.alias("g"), hits.alias("h")), start,
        lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"), F.when(x["h"].isNotNull(), F.concat(a["out"], F.array(a["at"] + F.length(x["g"])))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    return F.transform(found, lambda u, i: F.struct((F.upper(F.get(names, i)) if method else F.lit("")).alias("method"), u.alias("url"), F.get(places, i).alias("offset")))


def candidates(bundles: DataFrame) -> DataFrame:
    """Every match in (file_name, source_code, is_source_map), in the order calls, XHR, sockets, routes."""
    b = bundles.withColumn("minified", ~F.col("is_source_map") & is_minified("source_code"))
    code = F.col("source_code")
    kinds = (("call", _pairs(code, CALL, 1, 2)), ("xhr", _pairs(code, XHR, 1, 2)), ("socket", _pairs(code, SOCKET, None, 1)), ("route", _pairs(code, ROUTE, None, 1)))

    def tagged(rank: int, kind: str, hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["method"].alias("method"), h["url"].alias("url"), h["offset"].alias("offset")))

    every = F.concat(*[tagged(n, k, x) for n, (k, x) in enumerate(kinds)])
    x = b.withColumn("m", F.explode(every)).select("file_name", "is_source_map", "minified", "m.*")
    call = F.col("kind") == "call"
    return x.select(
        "file_name", "rank", "offset", "url", "minified",
        F.when(F.col("kind") == "socket", "WS").when((F.col("kind") == "route") | (F.col("method") == ""), "GET").otherwise(F.col("method")).alias("method"),
        F.when(call & F.lower("url").contains("graphql"), "graphql").when(F.col("kind") == "socket", "websocket").when(F.col("kind") == "route", "route").otherwise("rest").alias("type"),
        F.when(F.col("kind") == "socket", F.lit(0.9)).when(F.col("kind") == "route", F.lit(0.7)).when(F.col("minified"), F.lit(0.6)).otherwise(F.lit(0.8)).alias("confidence"),
        F.when(F.col("kind") == "route", "inferred_route").when(F.col("is_source_map"), "source_map").otherwise("static_bundle").alias("provenance"),
        F.when(F.col("is_source_map"), "source_map").when(F.col("minified"), "regex").otherwise("string_analysis").alias("extraction_method"),
    )


def bundle_endpoints(bundles: DataFrame) -> DataFrame:
    """Candidates, one for each (file, method, url): the most confident, the first of equals."""
    c = candidates(bundles)
    cols = [x for x in c.columns if x not in ("file_name", "method", "url")]
    g = c.groupBy("file_name", "method", "url").agg(F.max_by(F.struct(*cols), F.struct("confidence", -F.col("rank"), -F.col("offset"))).alias("v"))
    return g.select("file_name", "method", "url", "v.*").drop("rank")


def type_conflicts(bundles: DataFrame) -> DataFrame:
    c = candidates(bundles).filter("type <> 'route'").groupBy("file_name", "method", "url").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return c.filter(F.col("types").contains(","))


def as_observations(found: DataFrame) -> DataFrame:
    """REST and GraphQL endpoints as rows for the registry and the endpoint inventory (base url empty)."""
    w = Window.partitionBy("file_name").orderBy("offset", "method", "url")
    return found.filter(F.col("type").isin("rest", "graphql")).select(
        F.row_number().over(w).cast("long").alias("seq"), "method", "url", "provenance", (F.col("type") == "graphql").alias("is_graphql"), "confidence", F.lit("").alias("base_url")
    )


def as_endpoints(found: DataFrame) -> DataFrame:
    """REST and GraphQL endpoints of scripts as rows of the endpoint inventory: the url is the template, the base url empty."""
    rows = as_observations(found).withColumn("endpoint_id", endpoint_id(F.col("method"), F.col("url"), F.lit("")))
    first = F.min_by(F.struct("provenance", "is_graphql"), F.struct("seq", "provenance")).alias("v")
    out = rows.groupBy("endpoint_id", "method", F.col("url").alias("path_template"), "base_url").agg(F.count("*").alias("observation_count"), first, F.min("seq").alias("seq"))
    return out.select("endpoint_id", "method", "path_template", "base_url", "observation_count", "v.*", "seq")


def static_nodes(found: DataFrame) -> DataFrame:
    """Graph nodes static_<endpoint id> of what scripts call; ``graph.add_nodes`` puts them with the others."""
    return as_endpoints(found).select(
        F.concat(F.lit("static_"), "endpoint_id").alias("id"), F.when(F.col("is_graphql"), "graphql_operation").otherwise("request").alias("type"), F.col("path_template").alias("url"),
        F.lit(None).cast("string").alias("path"), "method", F.lit(None).cast("string").alias("trust_state"), "provenance", (F.col("seq") + (1 << 42)).alias("seq"),
    )


# --- pages


def resolve_link(base: Column, href: Column) -> Column:
    """The absolute form of a link without its hash: absolute, //host, /path and relative links; else null."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    site, dir_ = urls.base_url(base), F.regexp_extract(urls.pathname(base), r"^(.*/)", 1)
    path = F.when(h.startswith("/"), h).otherwise(F.concat(dir_, h))
    return (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(site, path))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): distinct resolved links of pages."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    x = pages.select(F.regexp_replace(F.col(url), "#.*$", "").alias("source"), F.explode(F.array_distinct(hrefs)).alias("href"))
    return x.select("source", resolve_link(F.col("source"), F.col("href")).alias("target")).filter("target is not null").distinct()


def crawl(links: DataFrame, start: str, most_depth: int = 3, most_pages: int = 50, subdomains: bool = False) -> DataFrame:
    """(url, depth, position): a breadth-first crawl over known links, in scope, past no authentication route.

    ``most_pages`` is the crawl's own budget; the frontier of a level is a table, and only levels are looped over.
    """
    from hearsay.runtime import cut

    spark = links.sparkSession
    host = urls.hostname(F.lit(start))
    ok = urls.in_scope(urls.hostname("target"), host, subdomains) & ~is_auth_route("target")
    e = links.filter(ok)
    start = start.split("#")[0]
    seen = spark.createDataFrame([(start, 0, 0)], "url string, depth int, position bigint")
    frontier, n = seen, 1
    for depth in range(1, most_depth):
        if n >= most_pages:
            break
        step = frontier.select(F.col("url").alias("source"), F.col("position").alias("p")).join(e, "source")
        new = step.groupBy(F.col("target").alias("url")).agg(F.min("p").alias("p")).join(seen.select("url"), "url", "left_anti")
        top = new.orderBy("p", "url").limit(most_pages - n)
        w = Window.orderBy("p", "url")  # most_pages rows at most
        frontier = cut(top.select("url", F.lit(depth).alias("depth"), (F.row_number().over(w) + n - 1).cast("long").alias("position")))
        added = frontier.count()
        if not added:
            break
        n += added
        seen = seen.unionByName(frontier)
    return seen
