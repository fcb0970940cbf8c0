"""Which value of an answer feeds which later request: token extraction, an equi-join on (session, value), scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions import filters, tokens
from hearsay.functions.json_text import parsed
from hearsay.functions.urls import query_parameters

#: Shortest value that is a candidate is one longer than this.
SHORT = 8
TOKENS = "array<struct<path:string,value:string>>"


def _shown(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e21 else repr(x)


def walk(x, path: str) -> list[tuple[str, str]]:
    """(path, value) of each string or number of over SHORT characters, in the order of the document."""
    if isinstance(x, bool) or not x:
        return []
    if isinstance(x, str):
        return [(path, x)] if len(x) > SHORT else []
    if isinstance(x, (int, float)):
        return [(path, s)] if len(s := _shown(x)) > SHORT else []
    if isinstance(x, list):
        return [t for i, y in enumerate(x) for t in walk(y, f"{path}[{i}]")]
    return [t for k, y in x.items() for t in walk(y, f"{path}.{k}" if path else k)]


def json_tokens(body: Column, root: str) -> Column:
    """The walk over a JSON text; text that isn't JSON, or is nested deeper than ``parsed`` allows, is one string."""

    @F.pandas_udf(TOKENS)
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            try:
                x = parsed(text)
            except ValueError:
                x = text
            return [{"path": p, "value": v} for p, v in walk(x, root)]

        return s.map(one)

    return run(body)


def header(headers: str | Column, name: str) -> Column:
    """Value of the first header of that name in any case; headers are a JSON object."""
    h = F.from_json(F.col(headers) if isinstance(headers, str) else headers, "map<string,string>")
    return F.get(F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def source_tokens(rows: DataFrame) -> DataFrame:
    """(id, session_id, captured_at, seq, value, path, source_type): values of answers and the first set cookie."""
    first = F.split(F.substring_index(header("response_headers", "set-cookie"), ";", 1), "=")
    cookie = F.when(F.size(first) >= 2, F.array(F.struct(F.concat(F.lit("set-cookie:"), F.trim(F.get(first, F.lit(0)))).alias("path"), F.trim(F.get(first, F.lit(1))).alias("value"), F.lit("header").alias("source_type"))))
    body = F.transform(json_tokens(F.col("response_body"), "body"), lambda t: F.struct(t["path"].alias("path"), t["value"].alias("value"), F.lit("body").alias("source_type")))
    found = F.concat(body, F.coalesce(cookie, F.expr("cast(array() as array<struct<path:string,value:string,source_type:string>>)")))
    return rows.select("id", "session_id", "captured_at", "seq", F.posexplode(found).alias("pos", "t")).select("id", "session_id", "captured_at", "seq", "pos", "t.*")


def target_tokens(rows: DataFrame) -> DataFrame:
    """(id, session_id, captured_at, seq, value, type, path): bearer, cookies, csrf, path, query and variables."""
    empty = F.expr("cast(array() as array<struct<value:string,type:string,path:string>>)")

    def token(value: Column, kind: str, path: Column | str) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("type"), (F.lit(path) if isinstance(path, str) else path).alias("path"))

    def long(items: Column, least: int = SHORT + 1) -> Column:
        return F.coalesce(F.filter(items, lambda t: F.length(t["value"]) >= least), empty)

    auth = header("request_headers", "authorization")
    bearer = F.when(F.lower(auth).startswith("bearer "), F.array(token(F.trim(F.substring(auth, 8, 1 << 20)), "token", "Authorization")))
    pairs = F.filter(F.split(header("request_headers", "cookie"), ";"), lambda p: p.contains("="))
    cookies = F.transform(pairs, lambda p: token(F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p))), "cookie", F.concat(F.lit("cookie:"), F.trim(F.substring_index(p, "=", 1)))))
    csrf = F.coalesce(F.when(header("request_headers", "x-csrf-token") != "", header("request_headers", "x-csrf-token")), header("request_headers", "csrf-token"))
    csrf = F.when(csrf.isNotNull(), F.array(token(csrf, "csrf", "x-csrf-token")))
    path = F.transform(F.split("path", "/"), lambda s: token(s, "path_param", "path"))
    query = F.transform(query_parameters("query_raw"), lambda q: token(q["value"], "query_param", F.concat(F.lit("query:"), q["name"])))
    graphql = F.coalesce(F.col("url").contains("graphql"), F.lit(False)) | F.coalesce(F.col("path").contains("graphql"), F.lit(False))
    variables = F.transform(json_tokens(F.when(graphql, F.get_json_object("request_body", "$.variables")), "variables"), lambda t: token(t["value"], "graphql_var", t["path"]))
    found = F.concat(long(bearer, 10), long(cookies), long(csrf), long(path), long(query), F.coalesce(variables, empty))
    return rows.select("id", "session_id", "captured_at", "seq", F.posexplode(found).alias("pos", "t")).select("id", "session_id", "captured_at", "seq", "pos", "t.*")


def token_frequency(sources: DataFrame) -> DataFrame:
    """How often each value is in answers, over all sessions."""
    return sources.groupBy("value").agg(F.count("*").alias("frequency"))


def infer_from_tokens(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Scored dependencies, the most confident of each (source, target, type).

    A hot (session, value) is left to the adaptive skew join; values are counted before they are shuffled."""
    freq = token_frequency(sources)
    s = sources.select("session_id", "value", F.col("id").alias("source_id"), F.col("captured_at").alias("source_at"), F.col("path").alias("source_path"), "source_type", F.col("seq").alias("s_seq"), F.col("pos").alias("s_pos"))
    t = targets.select("session_id", "value", F.col("id").alias("target_id"), F.col("captured_at").alias("target_at"), F.col("path").alias("target_path"), F.col("type").alias("dependency_type"), F.col("seq").alias("t_seq"), F.col("pos").alias("t_pos"))
    later = F.coalesce(F.col("source_at") < F.col("target_at"), F.lit(True))
    j = s.join(t, ["session_id", "value"]).filter(later).join(freq, "value", "left")
    cls = tokens.token_class("value", F.col("dependency_type"))
    score = tokens.clamp(((tokens.base_confidence("dependency_type") + F.col("cls.confidence_modifier")) + tokens.temporal_score(F.col("source_at"), F.col("target_at"))) + tokens.frequency_score(F.col("frequency")))
    j = j.withColumn("cls", cls).withColumn("confidence", score)
    j = j.withColumn("match_type", F.concat(F.col("source_type"), F.lit("_to_"), F.col("dependency_type"))).withColumn("token_type", F.col("cls.type"))
    keep = ["source_path", "target_path", "match_type", "token_type", "value", "source_at", "target_at", "s_seq", "t_seq"]
    best = F.max_by(F.struct("confidence", *keep), F.struct("confidence", -F.col("t_seq"), -F.col("t_pos"), -F.col("s_seq"), -F.col("s_pos")))
    return j.groupBy("source_id", "target_id", "dependency_type").agg(best.alias("b")).select("source_id", "target_id", "dependency_type", "b.*")


def infer_dependencies(requests: DataFrame) -> DataFrame:
    """Dependencies between requests that succeeded (id, session_id, captured_at, seq and the columns of the log)."""
    good = requests.filter(filters.succeeded("response_status"))
    return infer_from_tokens(source_tokens(good), target_tokens(good))


def persisted(dependencies: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(dependencies that are kept, diagnostics of those that aren't)."""
    kept = dependencies.filter(F.col("confidence") >= least)
    low = dependencies.filter(F.col("confidence") < least)
    said = F.concat(F.lit("Skipped "), F.col("dependency_type"), F.lit(" dependency inference (confidence: "), F.col("confidence").cast("string"), F.lit(")"))
    return kept, low.select(F.lit("low_confidence_dependency").alias("kind"), F.col("target_id").alias("request_id"), said.alias("message"))


def inference_metrics(requests: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Lookups, hits, reduction against comparing all pairs, distinct values, mean fan-out and hit rate, as one row."""
    per_value = sources.groupBy("session_id", "value").agg(F.count("*").alias("n"))
    hits = targets.select("session_id", "value").join(per_value, ["session_id", "value"], "left")
    a = hits.agg(F.count("*").alias("lookups"), F.count("n").alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("fanout"))
    b = per_value.agg(F.count("*").alias("token_cardinality"))
    c = requests.agg(F.count("*").alias("requests"))
    one = a.crossJoin(b).crossJoin(c)  # three rows of one
    n, k = F.col("requests").cast("double"), F.col("lookups").cast("double")
    return one.select(
        "requests", "lookups", "hits", "token_cardinality", F.when(k > 0, n * (n - 1) / 2 / k).otherwise(F.lit(0.0)).alias("reduction_ratio"),
        F.when(F.col("hits") > 0, F.col("fanout") / F.col("hits")).otherwise(F.lit(0.0)).alias("average_fanout"), F.when(k > 0, F.col("hits") / k).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def numbered_edges(dependencies: DataFrame) -> DataFrame:
    """Dependencies as edges (source, target, dependency_type, confidence, temporal_ms, seq) in a stable order."""
    w = Window.partitionBy("source_id").orderBy("t_seq", "dependency_type")
    return dependencies.select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), "dependency_type", "confidence", F.coalesce(F.col("target_at") - F.col("source_at"), F.lit(0)).alias("temporal_ms"),
        F.row_number().over(w).cast("long").alias("seq"),
    )
