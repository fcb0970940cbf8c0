"""URL filter: allow and block entries in a trie over reversed host labels and path segments; the longest match wins.

An entry is ``host/path``: it fits its host and all subdomains, where the url's path starts with the entry's path
(``com/fr/``, ``example.org/en/1``; the last piece of a path may end inside a segment). Deeper hosts beat shallower
ones, then longer paths beat shorter ones; of an allow and a block entry for the same place, block wins.

A trie that is broadcast has at most ``entries_per_pass`` entries; more entries take more passes over the urls, with one
trie each, and the longest match of all passes wins.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, so it gets the default
verdict; repeated rows are judged one by one; an empty table or an empty rule set is allowed; other columns pass through
(those named like an added column are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import fresh, own, without
from hearsay.runtime import cut

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class HostTrie:
    """Nodes are dicts: reversed host labels lead to a path trie of whole segments, with prefix ends at each node."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in entries:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("." + label, {})
            *whole, part = path.split("/")
            node = node.setdefault("/", {})
            for seg in whole:
                node = node.setdefault("/" + seg, {})
            ends = node.setdefault("ends", {})
            if ends.get(part, ("", ALLOW))[1] != BLOCK:
                ends[part] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        segments = path.split("/")
        labels = host.split(".")
        for i in range(len(labels) + 1):
            if "/" in node and (got := self._path(node["/"], segments)):
                best = got
            if i == len(labels) or (node := node.get("." + labels[-1 - i])) is None:
                break
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best, last = None, len(segments) - 1
        for k, seg in enumerate(segments):
            if ends := node.get("ends"):
                # the longest end that the current segment starts with; a whole-segment end is the empty string
                for n in range(min(len(seg), max(map(len, ends))), -1, -1):
                    if seg[:n] in ends:
                        best = ends[seg[:n]]
                        break
            if k == last or (node := node.get("/" + seg)) is None:
                break
        return best


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def url_filter(
    pages: DataFrame, allow: list[str], block: list[str], url: str = "url", default: str = ALLOW, entries_per_pass: int = 200_000
) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict to each row."""
    spark = pages.sparkSession
    pages = without(pages, ("host", "path", "rule", "verdict"), (url,))
    host_, path_, best_ = fresh(pages.columns, "host", "path", "best")
    entries = [(r, ALLOW) for r in allow] + [(r, BLOCK) for r in block]
    none = f"named_struct('rule', cast(null as string), 'verdict', '{default}', 'depth', cast(array(-1, -1, 0) as array<int>))"
    judged = pages.select(*map(own, pages.columns), host_of(own(url)).alias(host_), path_of(own(url)).alias(path_)).withColumn(best_, F.expr(none))
    last = None
    for i in range(0, len(entries), entries_per_pass):
        trie = spark.sparkContext.broadcast(HostTrie(entries[i : i + entries_per_pass]))
        found = look_up(trie, default)(host_, path_)
        if len(entries) <= entries_per_pass:
            judged = judged.withColumn(best_, found)
        else:
            # one trie at a time: what is best so far is written before the next one is sent out
            new = fresh(judged.columns, "new")[0]
            judged = judged.withColumn(new, found).withColumn(best_, F.when(F.col(new)["depth"] > F.col(best_)["depth"], F.col(new)).otherwise(F.col(best_))).drop(new)
            judged = cut(judged)
            if last is not None:
                last.unpersist()
            last = trie
    best = F.col(best_)
    return judged.select(*map(own, pages.columns), F.col(host_).alias("host"), F.col(path_).alias("path"), best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def look_up(trie: Broadcast, default: str):
    """A function of host and path columns: the entry that one trie finds, and its depth."""

    @F.pandas_udf("rule string, verdict string, depth array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in batches:
            got = [find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame([(*g, depth_of(*g)) if g else (None, default, [-1, -1, 0]) for g in got], columns=["rule", "verdict", "depth"])

    return run


def depth_of(rule: str, verdict: str) -> list[int]:
    """By what one fitting entry beats another: labels of the host, characters of the path, block."""
    host, path = split_rule(rule)
    return [len(host.split(".")) if host else 0, len(path), int(verdict == BLOCK)]


OP4_ALLOW, OP4_BLOCK = ["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]


def op4_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, OP4_ALLOW, OP4_BLOCK).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
