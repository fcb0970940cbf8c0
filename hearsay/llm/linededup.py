"""Line dedup: repeated runs of whole lines of at least ``min_words`` words; later copies are deleted.

1. A line that occurs once is in no repeated run, so texts part there into segments of repeated lines. Of equal segments
   the first stays and the others are deleted whole. This is done twice, as a line may be left once after it.
2. A suffix array over what is left: lines are ranked by their 128-bit hashes, and prefix doubling ranks the first 2^k
   lines of every suffix by the pair of ranks of its halves, by a sort that is dealt over machines by range, until
   no class parts any more. Ranks of all levels are kept.
3. Longest common prefixes of neighbours: the highest level on which they agree is skipped in both, and so on below.
4. Intervals of common prefixes: for each suffix the longest prefix that it shares with a suffix at an earlier place. A
   stack goes over each range of the array; what reaches over the borders of ranges is handed on as a short list, the
   earliest place for each length of prefix. A suffix whose prefix has ``min_words`` words or more gives a run to delete.

The order of places is by id, then hash of the text, then line, so the first copy of every run stays. Overlapping and
adjoining runs of a text join to the maximal repeated runs.

Defined results: a null text has no lines and stays null, an empty one has one empty line; rows that agree in id and
text are one document and are cleaned alike; null ids sort first; other columns pass through (those named like an added
column are replaced); nothing is deleted from an empty table. A run may repeat inside one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.llm.text import flat, fresh, own, slices, without
from hearsay.runtime import cut

MIN_WORDS = 50
#: Rows of one key that a task of a join takes; where a key has more, the rows of the HOT most frequent keys are dealt
#: over SALTS parts each.
TASK_ROWS, HOT, SALTS = 4096, 1000, 64
#: Lines to ``min_words`` where a segment has fewer words from a line on.
NEVER = 2**31 - 1


def line_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row for each line: id, t (hash of the text), s (number of the line), two hashes and the word count."""
    lines = docs.select(own(key).alias("id"), F.xxhash64(own(text)).alias("t"), F.posexplode(F.split(own(text), "\n")).alias("s", "x"))
    return lines.select("id", "t", "s", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(0x5EED), "x").alias("b"), F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))


def meet(rows: DataFrame, keyed: DataFrame, keys: list[str], deal_by: list[str], most: int | None = None) -> DataFrame:
    """Inner join with a table of distinct ``keys`` and their counts n (``most`` of a key) in ``rows``; no task gets all
    rows of a hot key."""
    if (most if most is not None else _sizes(keyed)[1]) <= TASK_ROWS:
        return rows.join(keyed, keys)
    hot = keyed.orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.lit(True).alias("hot"))  # HOT rows
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*deal_by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = keyed.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*keys, "salt"]).drop("salt")


def _sizes(keyed: DataFrame) -> tuple[int, int]:
    """How many keys there are, and the greatest count of one."""
    n, most = keyed.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    return n, most


def segments(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, t, s, a, b, w): segments of lines that are in ``rows`` twice or more, of ``min_words`` words or more."""
    seen = cut(rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"))
    left = meet(rows, seen, ["a", "b"], ["id", "t", "s"]).drop("n")
    # a set, so that rows that repeat a document are one before they are shuffled
    lists = left.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("s", "a", "b", "w"))).alias("l")).select("id", "t", "l.s", "l.a", "l.b", "l.w")
    schema = lists.select("id", "t", F.lit(0).alias("s"), "a", "b", "w").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "s", budget=400_000):
            s, offsets = flat(x.column("s"))
            if not len(s):
                continue
            a, b, w = (flat(x.column(c))[0] for c in ("a", "b", "w"))
            row = np.repeat(np.arange(x.num_rows), np.diff(offsets))
            begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1))))
            lengths = np.diff(np.append(begin, len(s)))
            ok = np.add.reduceat(w, begin) >= min_words
            lines = np.repeat(ok, lengths)
            ends = np.concatenate(([0], np.cumsum(lengths[ok]))).astype(np.int32)
            at = pa.array(row[begin[ok]])
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[lines])) for v in (a, b, w)]
            yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("t").take(at), pa.array(s[begin[ok]].astype(np.int32)), *lists], names=["id", "t", "s", "a", "b", "w"])

    return lists.mapInArrow(run, schema)


def part(rows: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(spans (id, t, s, e) of segments that are copies of an earlier one, first ones of each segment)."""
    all_ = cut(segments(rows, min_words).withColumn("q", F.monotonically_increasing_id()))
    places = all_.select("q", "id", "t", "s", F.size("a").alias("m"), F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    classes = cut(places.groupBy("x", "y").agg(F.min(F.struct("id", "t", "s", "q")).alias("first"), F.count("*").alias("n")))
    copies = meet(places, classes.filter("n > 1"), ["x", "y"], ["q"]).filter("q <> first.q")
    first = all_.join(classes.select("first.q"), "q", "left_semi").drop("q")
    return copies.select("id", "t", "s", (F.col("s") + F.col("m") - 1).alias("e")), first


def as_rows(segs: DataFrame) -> DataFrame:
    lines = segs.select("id", "t", F.col("s").alias("s0"), F.posexplode(F.arrays_zip("a", "b", "w")).alias("i", "x"))
    return lines.select("id", "t", (F.col("s0") + F.col("i")).alias("s"), "x.a", "x.b", "x.w")


def suffixes(segs: DataFrame, min_words: int) -> DataFrame:
    """(g, i, a, b, rest, need) of segments (g, a, b, w): line i of segment g, how many lines are left from it on, and how
    many of them it takes to ``min_words`` words (NEVER if all of them don't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "w", budget=400_000):
            w, offsets = flat(x.column("w"))
            a, b = (flat(x.column(c))[0] for c in ("a", "b"))
            n = np.diff(offsets)
            row, i = np.repeat(np.arange(x.num_rows), n), np.arange(len(w))
            total = np.concatenate(([0], np.cumsum(w)))
            last = np.searchsorted(total, total[i] + min_words, "left")
            end = offsets[row + 1]
            need = np.where(last <= end, np.maximum(last - i, 1), NEVER)
            cols = [x.column("g").take(pa.array(row)), *(pa.array(v.astype(k)) for v, k in ((i - offsets[row], np.int32), (a, np.int64), (b, np.int64), (end - i, np.int32), (need, np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "i", "a", "b", "rest", "need"])

    return segs.select("g", "a", "b", "w").mapInArrow(run, "g long, i int, a long, b long, rest int, need int")


def ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """``keys`` with a number that grows in the order of ``by``: sorted by range over machines, then numbered in each."""
    return cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def doubled(lines: DataFrame) -> DataFrame:
    """(g, i, rest, need, r) of lines (g, i, a, b, rest, need): r[k] ranks the first 2^k lines from line i on, or all if
    fewer are left. Of the last level, equal ranks are equal suffixes."""
    names = ranked(lines.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "rank")
    classes, most = _sizes(names)
    state = cut(meet(lines, names, ["a", "b"], ["g", "i"], most).select("g", "i", "rest", "need", F.array("rank").alias("r")))
    longest = state.agg(F.max("rest")).first()[0] or 0
    half = 1
    while half < longest:
        # a segment's lines are at most a document's
        after = F.coalesce(F.lead(F.element_at("r", -1), half).over(Window.partitionBy("g").orderBy("i")), F.lit(-1))
        pairs = state.select("*", F.element_at("r", -1).alias("x"), after.alias("y"))
        names = ranked(pairs.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"], "rank")
        now, most = _sizes(names)
        if now == classes:
            break  # no class has parted, so none will
        state = cut(meet(pairs, names, ["x", "y"], ["g", "i"], most).select("g", "i", "rest", "need", F.concat("r", F.array("rank")).alias("r")))
        classes, half = now, 2 * half
    return state


def _agree(x: str, y: str) -> Column:
    """On how many levels, from the lowest on, two lists of ranks agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _skip(levels: str) -> Column:
    return F.when(F.col(levels) > 0, F.expr(f"shiftleft(1, {levels} - 1)")).otherwise(F.lit(0))


def suffix_array(state: DataFrame) -> DataFrame:
    """(part, m, g, i, need, lcp): suffixes in order of m, in ranges (part) of the order, with the lines in common with
    the suffix before; 0 where that is too little for the suffix's need."""
    by = [F.element_at("r", -1), "g", "i"]
    sa = cut(state.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)))
    before = F.struct("g", "i", "rest", "r")
    # the last suffix of a range goes with the first of the next; there is a row for each range
    ends = sa.groupBy("part").agg(F.min("m").alias("m"), F.max_by(before, "m").alias("last"))
    ends = ends.select("m", F.lag("last").over(Window.orderBy("part")).alias("last"))
    p = sa.withColumn("prev", F.lag(before).over(Window.partitionBy("part").orderBy("m"))).join(F.broadcast(ends), "m", "left").withColumn("prev", F.coalesce("prev", "last"))
    levels = F.size("r")
    p = p.withColumn("k", F.when(F.col("prev").isNull(), 0).otherwise(_agree("r", "prev.r")))
    p = p.withColumn("lcp", F.when(F.col("k") == levels, F.col("rest")).otherwise(F.least(_skip("k"), "rest", "prev.rest")))
    # agreeing on k levels and not on one more is fewer than 2^k lines
    over = (F.col("k") == levels) | (F.col("lcp") == F.col("rest")) | (F.col("lcp") == F.col("prev.rest")) | (F.col("k") <= 1)
    hopeless = (F.col("k") < levels) & (F.expr("shiftleft(1L, k)") <= F.col("need"))
    p = cut(p.select("part", "m", "g", "i", "need", "rest", F.when(hopeless, 0).otherwise(F.col("lcp")).alias("lcp"), (hopeless | over).alias("done"), F.col("prev.g").alias("g2"), F.col("prev.i").alias("i2"), F.col("prev.rest").alias("rest2")))
    left = p.filter("not done").select("m", "g", "i", "rest", "g2", "i2", "rest2", "lcp")
    ends_at = []
    one, two = (state.select(F.col("g").alias(f"g{x}"), F.col("i").alias(f"j{x}"), F.col("r").alias(f"r{x}")) for x in ("", "2"))
    while not left.isEmpty():
        moved = left.withColumns({"j": F.col("i") + F.col("lcp"), "j2": F.col("i2") + F.col("lcp")}).join(one, ["g", "j"]).join(two, ["g2", "j2"])
        moved = moved.withColumn("k", _agree("r", "r2")).withColumn("lcp", F.least(F.col("lcp") + _skip("k"), "rest", "rest2"))
        moved = cut(moved.select("m", "g", "i", "rest", "g2", "i2", "rest2", "lcp", ((F.col("k") <= 1) | (F.col("lcp") == F.least("rest", "rest2"))).alias("done")))
        ends_at.append(moved.filter("done").select("m", F.col("lcp").alias("far")))
        left = moved.filter("not done").drop("done")
    out = p.select("part", "m", "g", "i", "need", "lcp")
    if not ends_at:
        return out
    far = ends_at[0]
    for x in ends_at[1:]:
        far = far.unionByName(x)
    return cut(out.join(far, "m", "left").withColumn("lcp", F.coalesce("far", "lcp")).drop("far"))


Steps = list[tuple[int, int]]


def staircase(found: Steps) -> Steps:
    """Of (place, prefix), those that no earlier place with as long a prefix outdoes; by place, so prefixes grow too."""
    out: Steps = []
    for place, lcp in sorted(found, key=lambda f: (-f[1], f[0])):
        if lcp > 0 and (not out or place < out[-1][0]):
            out.append((place, lcp))
    return out[::-1]


def edge(places: list[int], lcps: list[int]) -> Steps:
    """What of a range reaches to its last suffix, as (place, prefix shared with that suffix)."""
    found, least, lcp = [], None, NEVER
    for place, x in zip(reversed(places), reversed(lcps), strict=True):
        if least is None or place < least:
            found.append((place, lcp))
            least = place
        lcp = min(lcp, x)
        if lcp <= 0:
            break
    return staircase(found)


def earlier(places: list[int], lcps: list[int], carried: Steps) -> list[int]:
    """For each suffix of a range the longest prefix that it shares with one before it in the order and at an earlier
    place; lcps[k] is shared with the suffix before, ``carried`` is what of earlier ranges reaches to the first's."""
    stack = [(place, carried[k - 1][1] if k else 0) for k, (place, _) in enumerate(carried)]
    gap = carried[-1][1] if carried else NEVER
    out = []
    for place, lcp in zip(places, lcps, strict=True):
        now, gap = min(lcp, gap), NEVER
        if lcp <= 0:
            stack.clear()
        while stack and stack[-1][0] > place:
            now = min(now, stack.pop()[1])
        now = now if stack else 0
        out.append(now)
        stack.append((place, now))
    return out


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(part, columns) of rows that are sorted by part; a part is a range of the array that one sorting task held."""
    key, held = None, None
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[0] != key:
                if held:
                    yield key, held
                key, held = x[0], [[] for _ in x[1:]]
            for col, v in zip(held, x[1:], strict=True):
                col.append(v)
    if held:
        yield key, held


def earlier_prefixes(sa: DataFrame) -> DataFrame:
    """(g, i, n): the first n lines of the suffix (g, i) are at an earlier place too, and no longer prefix is."""
    spark = sa.sparkSession
    dealt = sa.select("part", "m", "g", "i", "need", "lcp").repartition("part").sortWithinPartitions("part", "m")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, g, i, _, lcp) in _by_part(batches):
            places = [x << 32 | y for x, y in zip(g, i, strict=True)]
            for side, found in (("tail", edge(places, lcp)), ("head", edge(places[::-1], [*lcp[1:], 0][::-1]))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([side]), pa.array([lcp[0]], pa.int64()), pa.array([min(lcp)], pa.int64()), pa.array([[p >> 32 for p, _ in found]], pa.list_(pa.int64())),
                     pa.array([[p & 0xFFFFFFFF for p, _ in found]], pa.list_(pa.int64())), pa.array([[c for _, c in found]], pa.list_(pa.int64()))], names=["part", "side", "first", "low", "g", "i", "c"])

    # two rows for each range, each with at most as many steps as a document has lines
    rows = dealt.mapInArrow(ends, "part long, side string, first long, low long, g array<long>, i array<long>, c array<long>").collect()
    found: dict[int, dict] = {}
    for r in rows:
        found.setdefault(r.part, {"first": r["first"], "low": r.low})[r.side] = [(g << 32 | i, c) for g, i, c in zip(r.g, r.i, r.c, strict=True)]
    order = sorted(found)
    into: dict[int, tuple[Steps, Steps]] = {}
    carry: Steps = []
    for k in order:
        into[k] = (carry, [])
        carry = staircase([(p, min(c, found[k]["low"])) for p, c in carry] + found[k]["tail"])
    carry = []
    for k in reversed(order):
        into[k] = (into[k][0], carry)
        carry = staircase([(p, min(c, found[k]["low"])) for p, c in carry] + [(p, min(c, found[k]["first"])) for p, c in found[k]["head"]])
    shared = spark.sparkContext.broadcast(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, g, i, need, lcp) in _by_part(batches):
            places = [x << 32 | y for x, y in zip(g, i, strict=True)]
            before, behind = shared.value[key]
            up = earlier(places, lcp, before)
            down = earlier(places[::-1], [NEVER if behind else 0, *lcp[:0:-1]], behind)[::-1]
            best = [max(x, y) for x, y in zip(up, down, strict=True)]
            at = [k for k, x in enumerate(best) if x >= need[k]]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for k in at], pa.int64()), pa.array([i[k] for k in at], pa.int32()), pa.array([best[k] for k in at], pa.int32())], names=["g", "i", "n"])

    return dealt.mapInArrow(run, "g long, i int, n int")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, t, deleted, n_deleted) for documents that lose lines: spans of lines, first and last included."""
    spans, first = part(line_rows(docs, text, key), min_words)
    more, first = part(as_rows(first), min_words)
    segs = ranked(first, ["id", "t", "s"], "g")
    runs = earlier_prefixes(suffix_array(doubled(cut(suffixes(segs, min_words)))))
    runs = runs.join(segs.select("g", "id", "t", "s"), "g").select("id", "t", (F.col("s") + F.col("i")).alias("s"), (F.col("s") + F.col("i") + F.col("n") - 1).alias("e"))
    w = Window.partitionBy("id", "t").orderBy("s", "e")
    upto = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.unionByName(more).unionByName(runs).withColumn("new", F.coalesce((F.col("s") > upto + 1).cast("int"), F.lit(0)))
    whole = new.withColumn("k", F.sum("new").over(w)).groupBy("id", "t", "k").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    return whole.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("deleted"), F.sum(F.col("last") - F.col("first") + 1).alias("n_deleted"))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, with_text: bool = True) -> DataFrame:
    """Add n_lines, n_deleted, deleted (spans) and, in place of the text, what is left of it.

    ``with_text=False`` leaves the text out of the result; then no text is shuffled.
    """
    docs = without(docs, ("n_lines", "n_deleted", "deleted"), (text, key))
    id_, t_, spans_, gone_, hash_, n_, lines_ = fresh(docs.columns, "id", "t", "spans", "gone", "hash", "n", "lines")
    spans = repeated_spans(docs, text, key, min_words).select(F.col("id").alias(id_), F.col("t").alias(t_), F.col("deleted").alias(spans_), F.col("n_deleted").alias(gone_))
    kept = [c for c in docs.columns if with_text or c != text]
    left = docs.select(*map(own, kept), F.xxhash64(own(text)).alias(hash_), F.coalesce(F.size(F.split(own(text), "\n")), F.lit(0)).cast("long").alias(n_))
    out = left.join(spans, own(key).eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(t_)), "left")
    cols = {c: own(c) for c in kept}
    some = F.col(gone_) > 0
    if with_text:
        # what stays lies between the spans: slices of the lines, so the work is linear in the text
        bounds = F.transform(spans_, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(spans_, i - 1)["last"] + 1).alias("a"), x["first"].alias("z")))
        bounds = F.concat(bounds, F.array(F.struct((F.element_at(spans_, -1)["last"] + 1).alias("a"), F.col(n_).cast("int").alias("z"))))
        pieces = F.transform(F.filter(bounds, lambda x: x["z"] > x["a"]), lambda x: F.array_join(F.slice(F.col(lines_), x["a"] + 1, x["z"] - x["a"]), "\n"))
        out = out.withColumn(lines_, F.when(some, F.split(own(text), "\n")))
        cols[text] = F.when(some, F.array_join(pieces, "\n")).otherwise(own(text)).alias(text)
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return out.select(*cols.values(), F.col(n_).alias("n_lines"), F.coalesce(F.col(gone_), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.col(spans_), none).alias("deleted"))


def op7_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup(docs, with_text=False)
    return found.select("doc_id", "n_lines", "n_deleted", F.array_join(F.transform("deleted", lambda x: F.concat_ws("-", x["first"], x["last"])), ",").alias("deleted"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM d),
w AS (SELECT doc_id, i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l),
c AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
r AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.i),
k AS (SELECT r.doc_id, s, e, md5(array_to_string(ls[s + 1 : e + 1], chr(10))) AS h, e - s AS m FROM r JOIN d USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE nth > 1),
p AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
q AS (SELECT doc_id, min(i) AS a, max(i) AS z, count(*) AS n FROM p GROUP BY doc_id, island),
o AS (SELECT doc_id, sum(n) AS n_deleted, string_agg(a || '-' || z, ',' ORDER BY a) AS deleted FROM q GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(deleted, '') AS deleted
FROM documents LEFT JOIN o USING (doc_id)
"""
