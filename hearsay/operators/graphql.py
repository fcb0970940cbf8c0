"""GraphQL operations: a small reader of documents, extraction from bodies, and recovery of persisted queries."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import filters
from hearsay.functions.json_text import parsed
from hearsay.operators.ingest import graphql_id

_TOKEN = re.compile(r'[\s,﻿]+|#[^\n\r]*|(?P<block>"""(?:\\"""|[\s\S])*?""")|(?P<string>"(?:\\.|[^"\\\n\r])*")|(?P<spread>\.\.\.)|(?P<name>[_A-Za-z][_0-9A-Za-z]*)|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<sign>[!$&()\[\]{}:=@|])')


class Document:
    """Operations, fragments and the number of fields of a document; ValueError if it isn't one."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"Syntax Error: Unexpected character at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.fields, self.spreads = 0, 0, False
        self.operations: list[tuple[str, str | None]] = []
        self.fragments: list[str] = []
        if not self.tokens:
            raise ValueError("Syntax Error: Unexpected <EOF>")
        while self.at < len(self.tokens):
            self._definition()

    def _peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "<EOF>")

    def _take(self, kind: str, value: str | None = None) -> str:
        got = self._peek()
        if got[0] != kind or (value is not None and got[1] != value):
            raise ValueError(f"Syntax Error: Expected {value or kind}, found {got[1]}")
        self.at += 1
        return got[1]

    def _skip(self, sign: str) -> bool:
        if self._peek() == ("sign", sign):
            self.at += 1
            return True
        return False

    def _definition(self) -> None:
        if self._peek() == ("sign", "{"):
            self.operations.append(("query", None))
            return self._selections()
        word = self._take("name")
        if word in ("query", "mutation", "subscription"):
            self.operations.append((word, self._take("name") if self._peek()[0] == "name" else None))
            if self._skip("("):
                while not self._skip(")"):
                    self._variable()
        elif word == "fragment":
            name = self._take("name")
            if name == "on":
                raise ValueError("Syntax Error: Unexpected name on")
            self.fragments.append(name)
            self._take("name", "on")
            self._take("name")
        else:
            raise ValueError(f"Syntax Error: Unexpected name {word}")
        self._directives()
        self._selections()

    def _variable(self) -> None:
        self._take("sign", "$")
        self._take("name")
        self._take("sign", ":")
        self._type()
        if self._skip("="):
            self._value()
        self._directives()

    def _type(self) -> None:
        if self._skip("["):
            self._type()
            self._take("sign", "]")
        else:
            self._take("name")
        self._skip("!")

    def _value(self) -> None:
        kind, value = self._peek()
        if kind in ("string", "block", "number", "name"):
            self.at += 1
        elif self._skip("$"):
            self._take("name")
        elif self._skip("["):
            while not self._skip("]"):
                self._value()
        elif self._skip("{"):
            while not self._skip("}"):
                self._take("name")
                self._take("sign", ":")
                self._value()
        else:
            raise ValueError(f"Syntax Error: Unexpected {value}")

    def _arguments(self) -> None:
        if self._skip("("):
            while not self._skip(")"):
                self._take("name")
                self._take("sign", ":")
                self._value()

    def _directives(self) -> None:
        while self._skip("@"):
            self._take("name")
            self._arguments()

    def _selections(self) -> None:
        self._take("sign", "{")
        if self._peek() == ("sign", "}"):
            raise ValueError("Syntax Error: Expected name, found }")
        while not self._skip("}"):
            if self._peek()[0] == "spread":
                self.at += 1
                self.spreads = True
                if self._peek()[0] == "name" and self._peek()[1] != "on":
                    self.at += 1
                    self._directives()
                    continue
                if self._peek() == ("name", "on"):
                    self.at += 1
                    self._take("name")
                self._directives()
                self._selections()
                continue
            self._take("name")
            if self._skip(":"):
                self._take("name")
            self._arguments()
            self._directives()
            self.fields += 1
            if self._peek() == ("sign", "{"):
                self._selections()


OPERATION = "operation_type string, operation_name string, document string, variables string, complexity int, has_fragments boolean, is_persisted_query boolean, fragments array<string>, error string"


def operations_of(body) -> list[dict]:
    """Operations of a body (an object or a batch); one that can't be read gives a row with only its error."""
    out = []
    for x in body if isinstance(body, list) else [body]:
        if not isinstance(x, dict):
            continue
        text = x.get("query")
        ext = x.get("extensions")
        stored = bool(isinstance(ext, dict) and ext.get("persistedQuery"))
        blank = not isinstance(text, str) or not text.strip()
        if blank and not stored:
            continue
        name = x.get("operationName") or None
        row = {"operation_type": "query", "operation_name": name, "document": "" if blank else text, "variables": json.dumps(x["variables"]) if x.get("variables") is not None else None, "complexity": 0, "has_fragments": False, "is_persisted_query": stored, "fragments": [], "error": None}
        if not blank:
            try:
                d = Document(text)
            except (ValueError, RecursionError) as e:
                out.append(dict.fromkeys(row) | {"error": str(e) or "Syntax Error"})
                continue
            if name:
                kinds = [k for k, n in d.operations if n == name]
                row["operation_type"] = kinds[-1] if kinds else "query"
            elif d.operations:
                row["operation_type"] = d.operations[0][0]
                row["operation_name"] = d.operations[0][1]
            row |= {"complexity": d.fields, "has_fragments": d.spreads or bool(d.fragments), "fragments": d.fragments}
        out.append(row)
    return out


def extract(body: str | Column) -> Column:
    """Array of operations of a JSON body."""

    @F.pandas_udf("array<struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in OPERATION.split(", ")) + ">>")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                x = parsed(text) if text else None
            except ValueError:
                return []
            return operations_of(x) if isinstance(x, (dict, list)) else []

        return s.map(one)

    return run(body)


def graphql_operations(rows: DataFrame, body: str = "request_body") -> tuple[DataFrame, DataFrame]:
    """(operations with gql_id, diagnostics) of rows whose body is a GraphQL request."""
    x = rows.withColumn("_o", F.explode(extract(body))).select(*rows.columns, "_o.*")
    good = x.filter("error is null").drop("error")
    return good.withColumn("gql_id", graphql_id(F.col("operation_name"), F.col("document"))), x.filter("error is not null").select(*[c for c in rows.columns if c != body], F.lit("graphql").alias("kind"), F.col("error").alias("message"))


def subscription_operations(frames: DataFrame, payload: str = "payload_text") -> tuple[DataFrame, DataFrame]:
    """(operations with gql_id, diagnostics) in WebSocket frames that start or carry a subscription: what their payload asks."""
    text = F.col(payload)
    asks = frames.filter(F.coalesce(filters.looks_json(text), F.lit(False)) & filters.is_graphql_subscription(text))
    return graphql_operations(asks.withColumn(payload, F.get_json_object(text, "$.payload")), payload)


def upsert_operations(ops: DataFrame) -> DataFrame:
    """One row for each gql_id: the first."""
    cols = [c for c in ops.columns if c not in ("gql_id",)]
    return ops.groupBy("gql_id").agg(F.min_by(F.struct(*cols), "seq").alias("v")).select("gql_id", "v.*")


def breakdown(ops: DataFrame) -> DataFrame:
    return ops.groupBy("operation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operation_type")


def recover_persisted(payloads: DataFrame, known: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(recovered operations, diagnostics) of JSON payloads (id, payload), each an object or a batch of them; pos is the
    place in the batch. ``known`` has (hash, document, seq).

    The last registration of a hash counts. The join is left to Spark, which broadcasts known queries where they are small.
    """
    p = F.col(payload)
    batch = F.when(F.btrim(p, F.lit(" \t\r\n")).startswith("["), F.from_json(p, "array<string>")).otherwise(F.array(p))
    payloads = payloads.select(*[c for c in payloads.columns if c not in (payload, "pos")], F.posexplode(batch).alias("pos", payload))
    name = F.nullif(F.get_json_object(p, "$.operationName"), F.lit(""))
    apollo = F.nullif(F.get_json_object(p, "$.extensions.persistedQuery.sha256Hash"), F.lit(""))
    relay = F.coalesce(F.nullif(F.get_json_object(p, "$.id"), F.lit("")), F.nullif(F.get_json_object(p, "$.doc_id"), F.lit("")))
    x = payloads.withColumns({"operation_name": name, "query_hash": F.coalesce(apollo, relay), "variables": F.get_json_object(p, "$.variables"), "extensions": F.get_json_object(p, "$.extensions")})
    docs = known.groupBy(F.col("hash").alias("query_hash")).agg(F.max_by("document", "seq").alias("document"))
    hit = x.filter("query_hash is not null").join(docs, "query_hash", "left")
    hit = hit.withColumn("document", F.nullif("document", F.lit("")))
    confidence = F.when(F.col("document").isNotNull(), F.lit(1.0)).when(F.col("operation_name").isNotNull(), F.lit(0.8)).otherwise(F.lit(0.4))
    hit = hit.withColumns({"confidence": confidence, "provenance": F.lit("persisted_query")})
    bare = F.nullif(F.get_json_object(p, "$.query"), F.lit("")).isNull() & (F.col("operation_name").isNotNull() | F.col("variables").isNotNull() | F.col("extensions").isNotNull())
    who = F.col("id").cast("string").alias("id")
    bad = x.filter(F.col("query_hash").isNull() & bare).select(who, F.lit("malformed_payload").alias("message"))
    unknown = hit.filter("document is null").select(who, F.concat(F.lit("unresolved: "), F.col("query_hash")).alias("message"))
    clash = known.groupBy("hash").agg(F.countDistinct("document").alias("n")).filter("n > 1").select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("collision: "), F.col("hash")).alias("message"))
    return hit.drop(payload), bad.unionByName(unknown).unionByName(clash)


def enrich(detected: DataFrame, recovered: DataFrame) -> DataFrame:
    """Detected operations (id, operation_name, document) with what was recovered under their id."""
    r = recovered.select("id", F.col("operation_name").alias("_n"), F.col("document").alias("_d"))
    out = detected.join(r, "id", "left")
    return out.withColumns({
        "operation_name": F.coalesce("operation_name", "_n"), "document": F.coalesce("_d", F.nullif("document", F.lit("")), F.lit("")), "is_persisted_query": F.lit(True),
    }).drop("_n", "_d")
