"""JSON schemas of observed bodies: inference of one value, the ordered merge, and the OpenAPI document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.json_text import parsed
from hearsay.functions.tokens import EMAIL, IPV4, ISO_DATE
from hearsay.functions.urls import UUID, path_parameters
from hearsay.runtime import cut



def _python(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern of column expressions for Python, which writes the end of a text otherwise."""
    return re.compile(pattern.replace(r"\z", r"\Z"), flags | re.ASCII)


_FORMATS = [(_python(rf"^{UUID}\z"), "uuid"), (_python(ISO_DATE), ""), (_python(EMAIL), "email"), (_python("^https?://", re.IGNORECASE), "uri"), (_python(IPV4), "ipv4")]


def _is_date(s: str) -> bool:
    try:
        datetime.fromisoformat(s.replace("Z", "+00:00"))
        return True
    except ValueError:
        return False


def infer(x) -> dict:
    """Fragment of one value; whole numbers are integers, all keys of an object are required, null is only nullable."""
    if x is None:
        return {"nullable": True}
    if isinstance(x, bool):
        return {"type": "boolean"}
    if isinstance(x, (int, float)):
        return {"type": "integer" if float(x).is_integer() else "number"}
    if isinstance(x, str):
        for pattern, name in _FORMATS:
            if pattern.search(x) and (name or _is_date(x)):
                return {"type": "string", "format": name or ("date-time" if "T" in x else "date")}
        return {"type": "string"}
    if isinstance(x, list):
        return {"type": "array", "items": reduce(merge, map(infer, x)) if x else {}}
    return {"type": "object", "properties": {k: infer(v) for k, v in x.items()}, "required": list(x)}


def merge(a: dict, b: dict) -> dict:
    """Ordered merge. It keeps what its users see today: a typed side replaces an untyped one (its nullability is lost),
    different types become oneOf, and of two oneOf the left stays. So neither order nor grouping may change."""
    for one, other in ((a, b), (b, a)):
        if "type" not in one and "oneOf" not in one:
            return dict(other)
    if a.get("type") != b.get("type"):
        return {"oneOf": [a, b]}
    if a.get("type") == "object" and "properties" in a and "properties" in b:
        left, right = a["properties"], b["properties"]
        names = [*left, *(k for k in right if k not in left)]
        both = [k for k in names if k in left and k in right]
        out = {"type": "object", "properties": {k: merge(left[k], right[k]) if k in left and k in right else left.get(k, right.get(k)) for k in names}}
        needed = [k for k in both if k in a.get("required", ()) and k in b.get("required", ())]
        return out | ({"required": needed} if needed else {})
    if a.get("type") == "array" and "items" in a and "items" in b:
        return {"type": "array", "items": merge(a["items"], b["items"])}
    return dict(a) if a.get("format") == b.get("format") else {"type": a["type"]}


def shown(fragment: dict) -> dict:
    """The fragment as a schema object: empty parts are left out."""
    out = {k: fragment[k] for k in ("type", "format", "nullable", "enum", "description") if fragment.get(k)}
    if "items" in fragment:
        out["items"] = shown(fragment["items"])
    if "properties" in fragment:
        out["properties"] = {k: shown(v) for k, v in fragment["properties"].items()}
    if fragment.get("required"):
        out["required"] = fragment["required"]
    if "oneOf" in fragment:
        out["oneOf"] = [shown(x) for x in fragment["oneOf"]]
    return out


def fragment_of(body: str | Column) -> Column:
    """Fragment of each JSON text that holds an object or an array, as JSON; else null, as for JSON that is nested deeper
    than ``parsed`` allows."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                x = parsed(text) if text is not None else None
            except ValueError:
                return None
            return json.dumps(infer(x)) if isinstance(x, (dict, list)) else None

        return s.map(one)

    return run(body)


def _fold(parts: list[tuple[str, int]]) -> dict | None:
    """Fragments, each merged so many times or until another merge changes nothing, in order."""
    acc = None
    for text, times in parts:
        x = json.loads(text)
        for _ in range(times):
            new = x if acc is None else merge(acc, x)
            if new == acc:
                break
            acc = new
    return acc


def _in_order(f: DataFrame, slices: int) -> DataFrame:
    """(endpoint_id, status, fragment) of rows (endpoint_id, status, seq, fragment), folded row by row: for endpoints
    whose types conflict, where every further row may change the result. What is folded are runs of equal fragments,
    found in slices of the log and then streamed in order, with their hashes for their texts."""
    from pyspark.sql.window import Window

    ends = f.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    part = F.floor((F.col("seq") - F.col("lo")) * slices / (F.col("hi") - F.col("lo") + 1))
    rows = f.crossJoin(F.broadcast(ends)).select("endpoint_id", "status", "seq", F.xxhash64("fragment").alias("x"), part.alias("slice"))  # one row of ends
    whole = Window.partitionBy("endpoint_id", "status", "slice")
    w = whole.orderBy("seq")
    s = rows.withColumns({"before": F.lag("x").over(w), "n": F.row_number().over(w), "all": F.count("*").over(whole)}).filter(~F.col("before").eqNullSafe(F.col("x")))
    runs = s.withColumn("times", F.coalesce(F.lead("n").over(w), F.col("all") + 1) - F.col("n")).select("endpoint_id", "status", "seq", "x", "times", F.lit(None).cast("string").alias("fragment"))
    texts = f.groupBy("endpoint_id", "status", "fragment").count().select("endpoint_id", "status", F.lit(-1).cast("long").alias("seq"), F.xxhash64("fragment").alias("x"), F.lit(0).cast("long").alias("times"), "fragment")
    dealt = runs.unionByName(texts).repartition("endpoint_id", "status").sortWithinPartitions("endpoint_id", "status", F.col("fragment").isNull(), "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, acc, known = None, None, {}
        out: list[tuple] = []
        for b in batches:
            for endpoint, status, _, x, times, text in b.itertuples(index=False):
                if (endpoint, status) != key:
                    if key is not None:
                        out.append((*key, json.dumps(acc)))
                    key, acc, known = (endpoint, status), None, {}
                if isinstance(text, str):
                    known[x] = json.loads(text)
                    continue
                for _ in range(times):
                    new = known[x] if acc is None else merge(acc, known[x])
                    if new == acc:
                        break
                    acc = new
            if out:
                yield pd.DataFrame(out, columns=["endpoint_id", "status", "fragment"])
                out = []
        if key is not None:
            yield pd.DataFrame([(*key, json.dumps(acc))], columns=["endpoint_id", "status", "fragment"])

    return dealt.mapInPandas(run, "endpoint_id string, status int, fragment string")


def response_schemas(rows: DataFrame, stored: DataFrame | None = None, slices: int = 256) -> DataFrame:
    """(endpoint_id, status, fragment, samples) of rows (endpoint_id, response_status, response_body, seq).

    The merge depends on order. Where no types conflict, it does so only by when each different fragment first came, and a
    fragment that came twice changes nothing any more; so different fragments are counted first, combined before the
    shuffle, and an endpoint with a third of all rows is a row for each shape that it has. Endpoints whose types
    conflict (oneOf in the result) are folded row by row. Stored merged schemas (endpoint_id, status, fragment) win.
    """
    f = rows.filter(F.coalesce(F.col("response_status"), F.lit(0)) != 0).select("endpoint_id", F.col("response_status").cast("int").alias("status"), "seq", fragment_of("response_body").alias("fragment"))
    f = f.filter(F.col("fragment").isNotNull())
    shapes = cut(f.groupBy("endpoint_id", "status", "fragment").agg(F.count("*").alias("n"), F.min("seq").alias("first")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = _fold([(text, min(n, 2)) for text, n in pdf.sort_values("first")[["fragment", "n"]].itertuples(index=False)])
        text = json.dumps(acc)
        return pd.DataFrame([(pdf.endpoint_id.iloc[0], pdf.status.iloc[0], text, has_choice(acc), pdf.n.sum())], columns=["endpoint_id", "status", "fragment", "conflict", "samples"])

    folded = cut(shapes.groupBy("endpoint_id", "status").applyInPandas(fold, "endpoint_id string, status int, fragment string, conflict boolean, samples long"))
    out = folded.filter("not conflict").select("endpoint_id", "status", "fragment", "samples")
    clash = folded.filter("conflict").select("endpoint_id", "status", "samples")
    if not clash.isEmpty():
        some = f.join(clash.select("endpoint_id", "status"), ["endpoint_id", "status"], "left_semi")
        out = out.unionByName(_in_order(some, slices).join(clash, ["endpoint_id", "status"]).select("endpoint_id", "status", "fragment", "samples"))
    if stored is None:
        return out
    own = stored.select("endpoint_id", "status", "fragment", F.lit(0).cast("long").alias("samples"))
    return out.join(own.select("endpoint_id").distinct(), "endpoint_id", "left_anti").unionByName(own)


def has_choice(fragment: dict) -> bool:
    """Whether a oneOf is anywhere in a fragment."""
    if "oneOf" in fragment:
        return True
    inner = [*fragment.get("properties", {}).values(), *([fragment["items"]] if "items" in fragment else [])]
    return any(map(has_choice, inner))


def operations(eps: DataFrame, schemas: DataFrame, only_approved: bool = False) -> DataFrame:
    """One row for each (path template, method): the operation as JSON. The last endpoint of a method stays; with
    ``only_approved`` endpoints count whose status is "approved" (none where they have no status)."""
    if only_approved:
        eps = eps.filter(F.col("status") == "approved") if "status" in eps.columns else eps.limit(0)
    last = eps.groupBy("path_template", F.lower("method").alias("method")).agg(F.max_by(F.struct("endpoint_id", "observation_count", "provenance", *[c for c in ("tag",) if c in eps.columns]), F.struct("seq", "endpoint_id")).alias("e"))
    by_status = schemas.groupBy("endpoint_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("status", "fragment")))).alias("answers"))
    rows = last.select("path_template", "method", "e.*", F.to_json(path_parameters("path_template")).alias("params")).join(by_status, "endpoint_id", "left")
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def build(params: pd.Series, answers: pd.Series, n: pd.Series, provenance: pd.Series, tag: pd.Series) -> pd.Series:
        def one(p, a, n, src, tag):
            op: dict = {"responses": {}}
            if tag:
                op["tags"] = [tag]
            if n < 3:
                op |= {"x-low-confidence": True, "x-observations": int(n)}
            op["x-source"] = src or "network"
            if p != "[]":
                op["parameters"] = [{"name": x, "in": "path", "required": True, "schema": {"type": "string"}} for x in json.loads(p)]
            for r in json.loads(a) if a else ():
                op["responses"][str(r["status"])] = {"description": f"Response for status {r['status']}", "content": {"application/json": {"schema": shown(json.loads(r["fragment"]))}}}
            if not op["responses"]:
                op["responses"]["200"] = {"description": "Success"}
            return json.dumps(op)

        return pd.Series([one(*x) for x in zip(params, answers, n, provenance, tag, strict=True)])

    return rows.select("path_template", "method", build("params", "answers", "observation_count", "provenance", "tag").alias("operation"))


def openapi(ops: DataFrame, base_url: str, title: str = "Auto-Discovered API", version: str = "1.0.0", description: str = "API specification inferred from traffic") -> dict:
    """The document. It is one JSON object by nature, and as large as the API, not as its traffic."""
    paths: dict[str, dict] = {}
    for r in ops.orderBy("path_template", "method").toLocalIterator():
        paths.setdefault(r.path_template, {})[r.method] = json.loads(r.operation)
    return {"openapi": "3.0.3", "info": {"title": title, "version": version, "description": description}, "servers": [{"url": base_url}], "paths": paths}


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def validate(spec: dict) -> list[str]:
    errors = [f'Missing "{k}"' for k in ("openapi", "info", "paths") if not spec.get(k)]
    errors += [f'Missing "info.{k}"' for k in ("title", "version") if not (spec.get("info") or {}).get(k)]
    for path, item in (spec.get("paths") or {}).items():
        if not path.startswith("/"):
            errors.append(f'Path "{path}" must start with /')
        errors += [f'Path "{path}" has invalid method "{k}"' for k in item if not k.startswith("x-") and k not in ("parameters", "summary", "description") and k not in METHODS]
    return errors
