"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, where only oversized buckets split.

A row's key is a hash of its id and text (32 hexadecimal digits of md5, of which 60 bits are used). A bucket is a
prefix of the key; one whose rows exceed the byte limit splits on the next bit, and so on until it fits.

The split is found without reading rows twice: bytes are summed for every prefix of ``fine`` bits (a shuffle of sums
only, combined before it), each sum is rolled up to all shorter prefixes, and a bucket is a shard if it fits and its
parent doesn't. Prefixes that don't fit at ``fine`` bits go on, they alone, with more bits.

Defined results: a null or empty text weighs 0 bytes besides ``row_overhead``; equal rows have equal keys and stay
together; a bucket of rows with one key can't be split, so it is a shard of its own marked ``oversized``; an empty
table gives an empty directory. Other columns pass through (those named like an added column are replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import fresh, own, without
from hearsay.runtime import cut

BITS = 60


def keys_of(docs: DataFrame, key_columns: list[str], text: str, row_overhead: int = 0) -> tuple[Column, Column]:
    """(60-bit key, bytes) of a row."""
    parts = [F.coalesce(own(c).cast("string"), F.lit("")) for c in key_columns]
    hexed = F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15)
    return F.conv(hexed, 16, 10).cast("long"), F.octet_length(F.coalesce(own(text), F.lit(""))).cast("long") + row_overhead


def directory(sized: DataFrame, limit: int, fine: int = 16, step: int = 12) -> DataFrame:
    """The directory of rows (key, bytes): one row per shard with depth, prefix (long), bytes, docs, oversized."""
    found, first, depth = [], 0, min(fine, BITS)
    left = sized.select("key", "bytes")
    while True:
        # rows of one prefix meet as sums made before the shuffle, however many they are
        fine_sums = left.groupBy(F.shiftright("key", BITS - depth).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        levels = fine_sums.select("*", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth"))
        sums = levels.groupBy("depth", F.expr(f"shiftright(p, {depth} - depth)").alias("prefix")).agg(F.sum("b").alias("bytes"), F.sum("n").alias("docs"), (F.min("k0") == F.max("k1")).alias("one_key"))
        sums = cut(sums.withColumn("fits", (F.col("bytes") <= limit) | F.col("one_key") | (F.col("depth") == BITS)))
        parent = sums.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        shards = sums.filter("fits").withColumn("up", F.shiftright("prefix", 1))
        at_root = shards.filter(F.col("depth") == first) if first == 0 else shards.limit(0)
        found.append(shards.join(parent, ["depth", "up"], "left_semi").unionByName(at_root).select("depth", "prefix", "bytes", "docs", (F.col("bytes") > limit).alias("oversized")))
        over = sums.filter(~F.col("fits") & (F.col("depth") == depth)).select("prefix")
        if depth == BITS or over.isEmpty():
            break
        left = left.withColumn("prefix", F.shiftright("key", BITS - depth)).join(over, "prefix", "left_semi").select("key", "bytes")
        first, depth = depth, min(depth + step, BITS)
    return reduce(DataFrame.unionByName, found)


def extendible_shards(docs: DataFrame, limit: int = 64 << 20, text: str = "text", key_columns: list[str] | None = None, row_overhead: int = 0, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with shard (its bits as text), n_bytes and oversized; directory). Only keys and sizes are shuffled to find
    the directory; rows then look up their shard by equality of prefixes, of one for each depth that shards have."""
    docs = without(docs, ("shard", "n_bytes", "oversized"), (text, *(key_columns or ["doc_id"])))
    key, size = keys_of(docs, key_columns or ["doc_id", text], text, row_overhead)
    shards = cut(directory(docs.select(key.alias("key"), size.alias("bytes")), limit))
    depths = [r[0] for r in shards.select("depth").distinct().collect()] or [0]  # 61 at most
    kept = [c for c in docs.columns if with_text or c != text]
    key_, bytes_, tries_, depth_, prefix_ = fresh(docs.columns, "key", "bytes", "tries", "depth", "prefix")
    keyed = docs.select(*map(own, kept), key.alias(key_), size.alias(bytes_))
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright(key_, BITS - d).alias("prefix")) for d in sorted(depths)])
    leaf = keyed.withColumn(tries_, F.explode(tries)).select(*map(own, kept), bytes_, F.col(tries_)["depth"].alias(depth_), F.col(tries_)["prefix"].alias(prefix_))
    bits = F.expr("substring(lpad(conv(prefix, 10, 2), 64, '0'), 65 - depth, depth)")
    # the directory has an entry for each ``limit`` of bytes; Spark broadcasts it below its threshold, by its size
    marks = shards.select(F.col("depth").alias(depth_), F.col("prefix").alias(prefix_), "oversized", bits.alias("shard"))
    out = leaf.join(marks, [depth_, prefix_]).select(*map(own, kept), "shard", F.col(bytes_).alias("n_bytes"), "oversized")
    return out, shards


#: Bytes of text in a shard: small, so that the query splits several levels deep on tables of a few megabytes as well.
OP9_LIMIT = 256 << 10


def op9_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible_shards(docs, OP9_LIMIT, with_text=False)[0]


OP9_SQL = f"""
WITH k AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  CAST(concat('0x', substr(md5(concat(CAST(doc_id AS VARCHAR), chr(31), coalesce(text, ''))), 1, 15)) AS BIGINT) AS key FROM documents),
d AS (SELECT unnest(range(0, 61)) AS depth),
s AS (SELECT depth, key >> (60 - depth) AS prefix, sum(n_bytes) AS bytes, count(DISTINCT key) AS keys FROM k, d GROUP BY ALL),
f AS (SELECT *, bytes <= {OP9_LIMIT} OR keys = 1 OR depth = 60 AS fits FROM s),
leaf AS (SELECT a.depth, a.prefix, a.bytes FROM f a LEFT JOIN f b ON b.depth = a.depth - 1 AND b.prefix = a.prefix >> 1 WHERE a.fits AND (a.depth = 0 OR NOT b.fits))
SELECT k.doc_id, CASE WHEN leaf.depth = 0 THEN '' ELSE right(bin(leaf.prefix + (1::BIGINT << 61)), CAST(leaf.depth AS INT)) END AS shard, n_bytes, leaf.bytes > {OP9_LIMIT} AS oversized
FROM k JOIN leaf ON k.key >> (60 - leaf.depth) = leaf.prefix
"""
