"""N-gram Jaccard join by MinHash banding.

Texts become sets of shingles of five words (plain words, lower case; a shorter text is one shingle). Band and row
counts follow from the target recall at the threshold. Documents meet by the hash of a band, and what meets is verified
on the full shingle sets. No row is made for each pair of a group, and none of its links is lost:

1. Texts of equal word sequences are one node (its 64-bit hash), so exact copies cost one row.
2. Each bucket's members are compared with its least member, the pivot. Members within twice the threshold's distance (at
   Jaccard 0.6 for a threshold of 0.8) are settled there; the others form the bucket anew, without the pivot, until no
   bucket has two members.
3. Edges to pivots within three times the threshold's distance (0.4) tie nodes into groups. By the triangle inequality of
   the Jaccard distance two linked members of a bucket are in one group.
4. Groups are parted into rings of set sizes, which links can't skip, and rings into blocks by hash. Pairs of blocks of
   one ring or of two neighbours are verified exactly, each by one task in bounded memory; it returns each node's number
   of links and a forest of links, not the pairs.
5. Classes are the connected components of the links.

Defined results: texts without a word (null, empty) have no shingle, so no link, and are classes of their own; rows that
agree in words are copies, whatever their ids; the class id is the least document id in it (null if all are null); an
empty table gives an empty result. Columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import flat, mix, ngram_hashes, ngram_starts, own, slices, word_hashes
from hearsay.operators.components import connected_components
from hearsay.runtime import cut, forget

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5
BLOCK = 256
ROUNDS = 8


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes that find a pair at the threshold with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def shingles(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, one after another, and how many each row has."""
    starts, counts = ngram_starts(offsets, n)
    grams = ngram_hashes(values, n)
    out = grams[starts] if len(starts) else np.empty(0, np.uint64)
    lengths = np.diff(offsets)
    few = np.flatnonzero((lengths > 0) & (lengths < n))
    if not len(few):
        return out, counts
    # rows of fewer words are one shingle; they are few and short
    own = np.array([mix(np.array([hash(tuple(values[offsets[i] : offsets[i + 1]].tolist())) & (2**63 - 1)], np.uint64))[0] for i in few], np.uint64)
    at = np.cumsum(counts)[few]
    counts = counts.copy()
    counts[few] = 1
    return np.insert(out, at, own), counts


def signatures(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes of each row, shape rows x bands; shingles of each row). Rows without a word get zeros."""
    grams, counts = shingles(values, offsets, n)
    out = np.zeros((len(counts), bands), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out, counts
    x = (grams >> np.uint64(32)).astype(np.uint32)
    begin = (np.cumsum(counts) - counts)[some]
    rng = np.random.default_rng(20_11)
    a = rng.integers(0, 2**31, bands * rows, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)
    buf = np.empty_like(x)
    with np.errstate(over="ignore"):
        for band in range(bands):
            acc = np.full(len(some), band + 1, np.uint64)
            for r in range(band * rows, band * rows + rows):
                np.multiply(x, a[r], out=buf)
                np.add(buf, b[r], out=buf)
                np.bitwise_xor(buf, buf >> np.uint32(15), out=buf)
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(buf, begin))
            out[some, band] = acc
    return out, counts


def sketches(docs: DataFrame, text: str, key: str, bands: int, rows: int, n: int) -> DataFrame:
    """(id, t, c, bands): t is a hash of the text, c of its words (null without a word)."""
    fed = docs.select(own(key).alias("id"), F.xxhash64(own(text)).alias("t"), word_hashes(own(text)).alias("w"))
    fed = fed.withColumn("c", F.when(F.size("w") > 0, F.xxhash64("w")))
    schema = fed.selectExpr("id", "t", "c", "w as bands").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "w", budget=500_000):
            values, offsets = flat(x.column("w"))
            sig, _ = signatures(values, offsets, bands, rows, n)
            made = pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * bands, pa.array(sig.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("t"), x.column("c"), made], names=["id", "t", "c", "bands"])

    return fed.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """(c, s): the sorted shingle set of each node in ``nodes`` (t, id). Only the texts that are asked for are cut again,
    and of a text's copies only the row that stands for it is looked up, so copies are dealt by their ids."""
    asked = nodes.select(F.col("t").alias("asked_t"), F.col("id").alias("asked_id"))
    rows = docs.select(own(text).alias("x"), F.xxhash64(own(text)).alias("t"), own(key).alias("id"))
    picked = rows.join(asked, (F.col("t") == F.col("asked_t")) & F.col("id").eqNullSafe(F.col("asked_id")), "left_semi")
    fed = picked.dropDuplicates(["t"]).select(word_hashes("x").alias("w")).withColumn("c", F.xxhash64("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "w", budget=500_000):
            values, offsets = flat(x.column("w"))
            grams, counts = shingles(values, offsets, n)
            sets = [np.unique(g) for g in np.split(grams, np.cumsum(counts)[:-1])]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([x.column("c"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["c", "s"])

    return fed.mapInArrow(run, "c bigint, s array<bigint>")


def jaccard(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, pivot) pairs with their exact similarity j."""
    left, right = sets.select("c", F.col("s").alias("x")), sets.select(F.col("c").alias("pivot"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return edges.join(left, "c").join(right, "pivot").select("c", "pivot", (both / (F.size("x") + F.size("y") - both)).alias("j"))


def groups(sketch: DataFrame, docs: DataFrame, text: str, key: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """(node, component) of nodes that may have links, and their shingle sets; None if no two texts meet."""
    nodes = sketch.filter("c is not null").groupBy("c").agg(F.min("bands").alias("bands"))
    buckets = nodes.select("c", F.explode("bands").alias("k"))

    def pivoted(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("k").agg(F.min("c").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
        return cut(rows.join(least.drop("n"), "k"))

    met = pivoted(buckets)
    if met.isEmpty():
        return None
    stands = sketch.groupBy("c").agg(F.min(F.struct("t", "id")).alias("v")).join(met.select("c").distinct(), "c", "left_semi").select("v.t", "v.id")
    sets = cut(shingle_sets(docs, stands, text, key, n))
    ties, written = [], []
    settled, tied = (max(0.0, 1 - k * (1 - threshold) - 1e-9) for k in (2, 3))
    for turn in range(ROUNDS + 1):
        pairs = met.filter("c <> pivot").select("c", "pivot").distinct()
        if turn == ROUNDS:
            # what has not parted by now is left to the blocks, which compare all that is tied
            ties.append(pairs)
            break
        known = cut(jaccard(pairs, sets))
        written.append(known)
        ties.append(known.filter(F.col("j") >= tied).select("c", "pivot"))
        far = known.filter(F.col("j") < settled).select("c", "pivot")
        left = cut(met.join(far, ["c", "pivot"], "left_semi").select("c", "k"))
        forget(met)
        if left.isEmpty():
            break
        met = pivoted(left)
        forget(left)
        if met.isEmpty():
            break
    found = connected_components(reduce(DataFrame.unionByName, ties).select(F.col("c").alias("u"), F.col("pivot").alias("v")))
    forget(met, *written)
    return found, sets


def _verify(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float):
    """Links among the members of one pair of blocks: (documents linked to each member, forest edges)."""
    m = len(ids)
    n = np.array([len(s) for s in sets], np.int64)
    links, forest = np.zeros(m, np.int64), []
    if m < 2:
        return links, forest
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((m, m), np.int32)
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    ends = np.append(starts[1:], len(code))
    shared = ends - starts > 1
    starts, ends = starts[shared], ends[shared]
    # shingles that few members share are counted as pairs, those that many share as products of bit rows
    few = ends - starts <= 8
    for k in range(2, 9):
        at = starts[few & (ends - starts == k)]
        if len(at):
            block = owner[at[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(common, (block[:, i], block[:, j]), 1)
    many = np.flatnonzero(~few)
    for chunk in np.array_split(many, max(1, -(-len(many) // 4096))):
        if len(chunk):
            rows = np.zeros((m, len(chunk)), np.float32)
            for col, g in enumerate(chunk):
                rows[owner[starts[g] : ends[g]], col] = 1
            common += np.triu((rows @ rows.T).astype(np.int32), 1)
    common = common + common.T
    ok = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
    np.fill_diagonal(ok, False)
    if side is not None:
        ok &= side[:, None] != side[None, :]
    links = ok @ sizes
    # a forest: from each tree, breadth first
    seen = np.zeros(m, bool)
    for r in range(m):
        if seen[r] or not ok[r].any():
            continue
        seen[r], queue = True, [r]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(ok[u] & ~seen)
            seen[new] = True
            forest += [(int(ids[u]), int(ids[v])) for v in new]
            queue += new.tolist()
    return links, forest


def cells(member: DataFrame, threshold: float) -> DataFrame:
    """Rows (component, r1, b1, r2, b2, first, c, size, s): members dealt into pairs of blocks.

    Sets that are linked differ in size by the threshold at most, so members of a group are told apart by rings of sizes,
    one the threshold apart from the next, and only meet members of their own ring and of the two beside it. ``first``
    tells which of the two blocks a member is in.
    """
    ring = F.floor(F.log(F.size("s").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    m = member.withColumn("r", ring)
    blocks = m.groupBy("component", "r").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    beside = blocks.select("component", (F.col("r") - 1).alias("r"), F.col("nb").alias("up")), blocks.select("component", (F.col("r") + 1).alias("r"), F.col("nb").alias("down"))
    sizes = blocks.join(beside[0], ["component", "r"], "left").join(beside[1], ["component", "r"], "left")
    m = m.join(sizes, ["component", "r"]).withColumn("b", F.pmod(F.xxhash64(F.lit(11), "c"), F.col("nb").cast("long")).cast("int"))

    def pairs(n: str, r1: Column, b1, r2: Column, b2, first) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda o: F.struct(r1.alias("r1"), b1(o).alias("b1"), r2.alias("r2"), b2(o).alias("b2"), first(o).alias("first")))
        return F.when(F.col(n).isNotNull(), each).otherwise(F.expr("cast(array() as array<struct<r1:int,b1:int,r2:int,b2:int,first:boolean>>)"))

    r, b = F.col("r"), F.col("b")
    own_ring = pairs("nb", r, lambda o: F.least(b, o), r, lambda o: F.greatest(b, o), lambda o: b <= o)
    above = pairs("up", r, lambda o: b, r + 1, lambda o: o, lambda o: F.lit(True))
    below = pairs("down", r - 1, lambda o: o, r, lambda o: b, lambda o: F.lit(False))
    return m.select("component", "c", "size", "s", F.explode(F.concat(own_ring, above, below)).alias("x")).select("component", "x.*", "c", "size", "s")


def verified(member: DataFrame, threshold: float) -> DataFrame:
    """(c, links, other): a row with the links of each node in each pair of blocks, and rows with forest edges."""
    cell = ["component", "r1", "b1", "r2", "b2"]
    m = cells(member, threshold).withColumn("g", F.xxhash64(*cell)).select("g", *cell, "first", "c", "size", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> tuple[list, list, list]:
            ids = np.array([h[0] for h in held], np.int64)
            sizes = np.array([h[1] for h in held], np.int64)
            side = np.array([h[3] for h in held]) if key[2:4] != key[4:6] else None
            links, forest = _verify(ids, sizes, [h[2] for h in held], side, threshold)
            return ids.tolist() + [u for u, _ in forest], links.tolist() + [0] * len(forest), [None] * len(ids) + [v for _, v in forest]

        out: tuple[list, list, list] = ([], [], [])
        for x in batches:
            values, offsets = flat(x.column("s"))
            cols = [x.column(c).to_pylist() for c in ("g", *cell, "first", "c", "size")]
            for i, (*at, first, c, size) in enumerate(zip(*cols, strict=True)):
                if tuple(at) != key:
                    if held:
                        for a, part in zip(out, done(), strict=True):
                            a.extend(part)
                    held, key = [], tuple(at)
                held.append((c, size, values[offsets[i] : offsets[i + 1]].copy(), first))
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in out], names=["c", "links", "other"])
                out = ([], [], [])
        if held:
            for a, part in zip(out, done(), strict=True):
                a.extend(part)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in out], names=["c", "links", "other"])

    dealt = m.repartition("g").sortWithinPartitions("g", *cell)
    return dealt.mapInArrow(run, "c bigint, links bigint, other bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: id, t (hash of the text), class_id, class (a hash that only documents of the class share; null
    without a word), node (hash of its words), copies (other documents of the same words) and n_links (documents at the
    threshold or above, copies included)."""
    sketch = cut(sketches(docs, text, key, bands_for(threshold, rows, recall), rows, n))
    nodes = sketch.filter("c is not null").groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    found = groups(sketch, docs, text, key, n, threshold)
    base = sketch.select("id", "t", "c")
    if found is None:
        out = base.join(nodes, "c", "left").withColumns({"links": F.lit(0).cast("long"), "class_least": F.col("least"), "component": F.col("c")})
    else:
        comp, sets = found
        member = comp.withColumnRenamed("node", "c").join(nodes, "c").join(sets, "c").select("component", "c", "size", "s")
        checked = cut(verified(member, threshold))
        forget(sets)
        links = checked.groupBy("c").agg(F.sum("links").alias("links"))
        classes = connected_components(checked.filter("other is not null").select(F.col("c").alias("u"), F.col("other").alias("v")))
        # written once, as it is read twice: else the result's plan has all joins before it twice, and the driver holds that plan
        tagged = cut(nodes.join(classes.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").withColumn("component", F.coalesce("component", "c")))
        least = tagged.groupBy("component").agg(F.min("least").alias("class_least"))
        out = base.join(tagged.join(least, "component"), "c", "left")
    return out.select(
        "id", "t", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("class_least")).alias("class_id"), F.col("component").alias("class"), F.col("c").alias("node"),
        F.coalesce(F.col("size") - 1, F.lit(0)).alias("copies"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).alias("n_links"),
    )


def op5_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "copies", "n_links")
