"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Test items are cut into segments; segments are the indexed documents, training passages (windows of a text) the
queries. Impacts are BM25 scores, by statistics of all segments of all items, divided by the segment's score for itself, so
a threshold means the same share of any segment. A passage goes through three bounds, each of which only drops what
can't reach the threshold: the sum of its words' greatest impacts; the same by block, for blocks that have one of the
words without which it stays under the threshold; then block-max WAND over the posting lists of the blocks that are
left. Segments only retrieve: every item that is found is verified, its whole question and its whole answer, as word
n-grams, against the passage and as much around it as the item's other segments take.

An index of about ``words_per_pass`` words of items, some hundred bytes for each, is broadcast; more items take more passes
over the texts, one after another. Defined results: texts without a word have no passage; items without a word are never found; a question or answer without a word counts as
covered; of passages that score alike for an item the first one stands for it; repeated rows each get their findings; rows
with equal ids are judged one by one; empty tables give an empty result. Columns other than the id and the text play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import flat, fresh, ngram_hashes, own, slices, word_hashes
from hearsay.runtime import cut

STRIDE, SEGMENT, BLOCK, NGRAM = 32, 48, 4, 3
THRESHOLD, OVERLAP = 0.55, 0.6
K1, B = 1.2, 0.75

_ANSWER = regex.compile(r"(?is)^(.*?)\b(?:answer|a)\s*:\s*(.+)$")
_SENTENCES = regex.compile(r"(?s)[.!?]+\s+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): what follows "Answer:" or "A:" if it is there, else the last sentence; of a single sentence
    the last quarter of its words."""
    text = text.strip()
    if (m := _ANSWER.match(text)) and m[1].strip():
        return m[1], m[2]
    ends = [m.end() for m in _SENTENCES.finditer(text) if text[m.end() :].strip()]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 4))
    return " ".join(words[:cut]), " ".join(words[cut:])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


@dataclass(frozen=True)
class Statistics:
    """Of all segments of all items: how many there are, their mean length, and in how many of them a word is."""

    segments: int
    mean: float
    words: np.ndarray
    counts: np.ndarray

    def frequency(self, words: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.words, words)]


def segment_bounds(n: int, segment: int) -> list[tuple[int, int]]:
    """Places at which an item of n words is cut into parts of about equal length, of at most ``segment`` words."""
    parts = -(-n // segment)
    return [(k * n // parts, (k + 1) * n // parts) for k in range(parts)]


def statistics_of(items: list[tuple[int, list[int], int]], segment: int = SEGMENT) -> Statistics:
    """Statistics of items that are at hand."""
    cuts = [np.unique(words[lo:hi]) for _, words, _ in items for lo, hi in segment_bounds(len(words), segment)]
    words, counts = np.unique(np.concatenate(cuts), return_counts=True) if cuts else (np.empty(0, np.int64), np.empty(0, np.int64))
    return Statistics(len(cuts), sum(len(w) for _, w, _ in items) / max(len(cuts), 1), words, counts)


class Index:
    """Inverted index of segments with impacts, and for each word the blocks of segments it is in with its greatest impact
    there. All of it grows with the postings: of a word, only blocks that have it are kept."""

    def __init__(self, items: list[tuple[int, list[int], int]], of: Statistics | None = None, block: int = BLOCK, segment: int = SEGMENT, k1: float = K1, b: float = B):
        """items: (item, word hashes, number of words that belong to the question)."""
        of = of or statistics_of(items, segment)
        self.segments: list[tuple[int, np.ndarray, int]] = []
        #: by segment: the place of its item, and the item's words before and after the segment
        self.around: list[tuple[int, int, int]] = []
        cuts = []
        for k, (item, words, question) in enumerate(items):
            for lo, hi in segment_bounds(len(words), segment):
                cuts.append(((item, np.array(words[lo:hi], np.int64), min(max(question - lo, 0), hi - lo)), (k, lo, len(words) - hi)))
        cuts.sort(key=lambda s: (len(s[0][1]), s[0][0]))
        self.segments, self.around = [s for s, _ in cuts], [a for _, a in cuts]
        self.block = block
        tf = [np.unique(s[1], return_counts=True) for s in self.segments]
        count = len(tf)
        n = np.array([len(t[0]) for t in tf], np.int64)
        self.vocab, word = np.unique(np.concatenate([t[0] for t in tf]) if count else np.empty(0, np.int64), return_inverse=True)
        df = of.frequency(self.vocab) if count else np.empty(0, np.int64)
        idf = np.log1p((of.segments - df + 0.5) / (df + 0.5))
        owner, times = np.repeat(np.arange(count), n), np.concatenate([t[1] for t in tf]) if count else np.empty(0, np.int64)
        length = np.array([len(s[1]) for s in self.segments], np.int64)[owner] if count else owner
        raw = idf[word] * times * (k1 + 1) / (times + k1 * (1 - b + b * length / of.mean))
        impact = raw / np.bincount(owner, raw, count)[owner]
        # postings of all words, one word after another; each word's segments in order
        order = np.lexsort((owner, word))
        self.posting, self.impact = owner[order], impact[order]
        self.starts = np.searchsorted(word[order], np.arange(len(self.vocab) + 1))
        self.blocks = -(-count // block)
        # the same by block: word * blocks + block, and the greatest impact
        key = word[order].astype(np.int64) * max(self.blocks, 1) + self.posting // block
        self.block_key, first = np.unique(key, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, first) if len(key) else np.empty(0)
        self.block_of = self.block_key % max(self.blocks, 1)
        self.block_starts = np.searchsorted(self.block_key, np.arange(len(self.vocab) + 1) * max(self.blocks, 1))
        # the last one is for words that are in no item
        self.most = np.zeros(len(self.vocab) + 1)
        if len(key):
            self.most[:-1] = np.maximum.reduceat(self.impact, self.starts[:-1])
        self.low = np.zeros(1 << max(20, int(16 * len(self.vocab)).bit_length()), bool)
        self.low[self.vocab & (len(self.low) - 1)] = True
        #: by item: n-grams of the question, of the answer, and n. N-grams over the border belong to neither, but a part
        #: shorter than n has the one that begins, or ends, the item.
        self.parts = []
        for _, words, q in items:
            n = min(NGRAM, len(words))
            g = ngram_hashes(np.array(words, np.int64), n) if n else np.empty(0, np.uint64)
            question = g[: max(1, q - n + 1)] if q else g[:0]
            answer = g[min(q, len(g) - 1) :] if q < len(words) else g[:0]
            self.parts.append((np.unique(question), np.unique(answer), n))

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary; the number of words where it lacks them."""
        out = np.full(len(values), len(self.vocab), np.int32)
        if len(self.vocab):
            maybe = np.flatnonzero(self.low[values & (len(self.low) - 1)])
            at = np.minimum(np.searchsorted(self.vocab, values[maybe]), len(self.vocab) - 1)
            ok = self.vocab[at] == values[maybe]
            out[maybe[ok]] = at[ok]
        return out

    def bounds(self, words: np.ndarray, used: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of the blocks in which a query may reach the threshold, for rows of words (``used``: which count).

        Of a query's words, those of the smallest greatest impacts that together stay under half of the threshold are
        only counted by these; the others, which are the rarer words with short lists, are summed by block. What may
        reach the threshold so is bounded once more, by the block of all words.
        """
        most = np.where(used, self.most[words], 0.0)
        order = np.argsort(most, axis=1, kind="stable")
        rising = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1)
        summed = np.empty_like(used)
        np.put_along_axis(summed, order, rising >= threshold / 2, axis=1)
        summed &= used
        rest = np.where(summed, 0.0, most).sum(axis=1)
        found = []
        step = max(16, (1 << 22) // max(self.blocks, 1))  # queries at a time, so that sums take bounded memory
        for lo in range(0, len(words), step):
            q, col = np.nonzero(summed[lo : lo + step])
            w = words[lo : lo + step][q, col]
            n = self.block_starts[w + 1] - self.block_starts[w]
            at = ranges(self.block_starts[w], n)
            rows = min(step, len(words) - lo)
            sums = np.bincount(np.repeat(q, n) * self.blocks + self.block_of[at], self.block_max[at], rows * self.blocks)
            some = np.flatnonzero((sums > 0) & (sums + np.repeat(rest[lo : lo + rows], self.blocks) >= threshold - 1e-6))
            found.append(some + lo * self.blocks)
        pairs, keep = np.concatenate(found) if found else np.empty(0, np.int64), []
        for some in np.array_split(pairs, max(1, -(-len(pairs) // 65_536))):
            q, block = some // self.blocks, some % self.blocks
            key = words[q].astype(np.int64) * self.blocks + block[:, None]
            place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            reach = np.where(used[q] & (self.block_key[place] == key), self.block_max[place], 0.0).sum(axis=1)
            keep.append(some[reach >= threshold - 1e-6])
        kept = np.concatenate(keep)
        return kept // self.blocks, kept % self.blocks

    def search(self, words: np.ndarray, blocks: set[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all segments of the given blocks that score the threshold or more."""
        lists = [(self.posting[a:z], self.impact[a:z], float(self.most[w])) for w, a, z in zip(words.tolist(), self.starts[words].tolist(), self.starts[words + 1].tolist(), strict=True)]
        at = [0] * len(lists)
        end, size, found = self.blocks * self.block, self.block, []
        heads = [int(p[0][0]) for p in lists]

        def block_bound(which: list[int], block: int) -> float:
            key = words[which].astype(np.int64) * self.blocks + block
            place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            return float(np.where(self.block_key[place] == key, self.block_max[place], 0.0).sum())

        while True:
            order = sorted(range(len(lists)), key=heads.__getitem__)
            total, pivot = 0.0, -1
            for k, i in enumerate(order):
                if heads[i] >= end:
                    break
                total += lists[i][2]
                if total >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = heads[order[pivot]]
            while pivot + 1 < len(order) and heads[order[pivot + 1]] == doc:
                pivot += 1
            here = doc // size
            reach = block_bound(order[: pivot + 1], here) if here in blocks else 0.0
            if reach < threshold - 1e-6:
                # nothing in this block that these lists alone reach; on to the next block, or the next list's head
                after = (here + 1) * size
                if pivot + 1 < len(order):
                    after = min(after, max(heads[order[pivot + 1]], doc + 1))
                moved = order[: pivot + 1]
            elif heads[order[0]] == doc:
                hit = [i for i in order if heads[i] == doc]
                score = sum(float(lists[i][1][at[i]]) for i in hit)
                if score >= threshold:
                    found.append((doc, score))
                after, moved = doc + 1, hit
            else:
                after, moved = doc, [i for i in order[: pivot + 1] if heads[i] < doc]
            for i in moved:
                at[i] = int(np.searchsorted(lists[i][0], after))
                heads[i] = int(lists[i][0][at[i]]) if at[i] < len(lists[i][0]) else end

    def overlap(self, segment: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the n-grams of the whole question and answer of a segment's item that are in the passage (a part
        without a word counts as covered)."""
        question, answer, n = self.parts[self.around[segment][0]]
        there = ngram_hashes(passage, n)
        return tuple(float(np.isin(g, there).mean()) if len(g) else 1.0 for g in (question, answer))


def find_passages(values: np.ndarray, offsets: np.ndarray, index: Index, threshold: float, least_overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word) of what is found in rows of word hashes."""
    out: list[tuple] = []
    if not len(index.vocab) or not len(values):
        return out
    codes = index.codes(values)
    total = np.concatenate(([0.0], np.cumsum(index.most[codes], dtype=np.float64)))
    lengths = np.diff(offsets)
    # windows of two strides, one stride apart; the last one of a text ends with it
    windows = np.where(lengths > 0, np.maximum(-(-lengths // STRIDE) - 1, 1), 0)
    row = np.repeat(np.arange(len(lengths)), windows)
    first = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    last = np.minimum(first + 2 * STRIDE, offsets[row + 1])
    live = np.flatnonzero(total[last] - total[first] >= threshold - 1e-6)
    none = len(index.vocab)
    hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for part in np.array_split(live, max(1, -(-len(live) // 8192))):
        at = first[part][:, None] + np.arange(2 * STRIDE)
        words = np.where(at < last[part][:, None], codes[np.minimum(at, len(codes) - 1)], none)
        words.sort(axis=1)
        words[:, 1:][words[:, 1:] == words[:, :-1]] = none  # each word of a query once
        used = words != none
        passes = np.where(used, index.most[words], 0.0).sum(axis=1) >= threshold - 1e-6
        words, used, part = words[passes], used[passes], part[passes]
        if not len(part):
            continue
        query, block = index.bounds(words, used, threshold)
        begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else query
        for a, z in zip(begin.tolist(), [*begin.tolist()[1:], len(query)], strict=False):
            k = int(query[a])
            w = int(part[k])
            for segment, score in index.search(words[k][used[k]], set(block[a:z].tolist()), threshold):
                hits.setdefault((int(row[w]), index.segments[segment][0]), []).append((score, w, segment))
    for (r, item), found in hits.items():
        for score, w, segment in sorted(found, key=lambda h: -h[0]):
            # the rest of the item, a quarter longer for inserted words, and a stride for a segment half outside the window
            _, before, after = index.around[segment]
            lo = max(int(first[w]) - STRIDE - before - before // 4, int(offsets[r]))
            hi = min(int(last[w]) + STRIDE + after + after // 4, int(offsets[r + 1]))
            q, a = index.overlap(segment, values[lo:hi])
            if q >= least_overlap and a >= least_overlap:
                out.append((r, item, score, q, a, int(first[w] - offsets[r])))
                break
    return out


class Benchmark:
    """Test items, ready to be searched for: split into question and answer, with statistics of all of their segments, in
    passes of about ``words_per_pass`` words each, by a hash of the item."""

    def __init__(self, benchmark: DataFrame, item: str, item_text: str, words_per_pass: int):
        self.spark = benchmark.sparkSession

        @F.pandas_udf("question string, answer string")
        def split(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([split_item(x) for x in s], columns=["question", "answer"])

        texts = benchmark.filter(own(item_text).isNotNull() & own(item).isNotNull()).select(own(item).cast("long").alias("item"), split(own(item_text)).alias("p"))
        self.items = cut(texts.select("item", word_hashes("p.question").alias("q"), word_hashes("p.answer").alias("a")))
        n = F.size("w")
        parts = self.items.select(F.concat("q", "a").alias("w")).filter(n > 0).withColumn("m", F.ceil(n / SEGMENT).cast("int"))
        bounds = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.floor(k * n / F.col("m")).cast("int"))
        lists = F.transform(F.sequence(F.lit(1), F.col("m")), lambda k: F.slice("w", F.get(bounds, k - 1) + 1, F.floor(k * n / F.col("m")).cast("int") - F.get(bounds, k - 1)))
        self.segments = parts.select(F.explode(lists).alias("s"))
        self.count, self.words = self.segments.agg(F.count("*"), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
        self.frequency = cut(self.segments.select(F.explode(F.array_distinct("s")).alias("word")).groupBy("word").count())
        self.passes = max(1, -(-self.words // words_per_pass))

    def indexes(self) -> Iterator[Index]:
        mine = F.pmod(F.xxhash64("item"), F.lit(self.passes))
        for k in range(self.passes):
            rows = sorted(self.items.filter(mine == k).collect())  # about words_per_pass words
            words = self.frequency
            if self.passes > 1:
                here = self.items.filter(mine == k).select(F.explode(F.concat("q", "a")).alias("word")).distinct()
                words = words.join(here, "word", "left_semi")
            known = sorted(words.collect())
            of = Statistics(self.count, self.words / max(self.count, 1), np.array([r[0] for r in known], np.int64), np.array([r[1] for r in known], np.int64))
            yield Index([(r[0], [*r[1], *r[2]], len(r[1])) for r in rows], of)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least_overlap: float = OVERLAP, words_per_pass: int = 1_000_000) -> DataFrame:
    """Rows (id, t, item, score, question_overlap, answer_overlap, first_word): each text's verified test items.

    t is a hash of the text, to tell rows of one id apart; the best passage stands for an item.
    """
    fed = docs.select(own(key).alias("id"), F.xxhash64(own(text)).alias("t"), word_hashes(own(text)).alias("w"))
    schema = fed.selectExpr("id", "t", "cast(0 as bigint) item", "cast(0 as double) score", "cast(0 as double) question_overlap", "cast(0 as double) answer_overlap", "cast(0 as bigint) first_word").schema
    found = []
    for index in Benchmark(benchmark, item, item_text, words_per_pass).indexes():
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in slices(batches, "w", budget=1_000_000):
                values, offsets = flat(x.column("w"))
                got = find_passages(values, offsets, shared.value, threshold, least_overlap)
                if got:
                    at = pa.array([f[0] for f in got], pa.int64())
                    cols = [pa.array([f[k] for f in got], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("t").take(at), *cols], names=[f.name for f in schema.fields])

        found.append(fed.mapInArrow(run, schema))
        if len(found) > 1:
            found[-2] = cut(found[-2])  # each pass is done before the next index is sent out
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least_overlap: float = OVERLAP, words_per_pass: int = 1_000_000) -> DataFrame:
    """The rows whose text has no verified test item, as they are. Each row is judged where it is: nothing is shuffled."""
    (words_,) = fresh(docs.columns, "words")
    out, passes = docs, 0
    for index in Benchmark(benchmark, item, item_text, words_per_pass).indexes():
        if passes:
            out = cut(out)
        passes += 1
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in slices(batches, words_, budget=1_000_000):
                values, offsets = flat(x.column(words_))
                bad = {f[0] for f in find_passages(values, offsets, shared.value, threshold, least_overlap)}
                kept = x.select(list(range(x.num_columns - 1)))
                yield kept.take(pa.array([k for k in range(x.num_rows) if k not in bad], pa.int64())) if bad else kept

        out = out.select(*map(own, out.columns), word_hashes(own(text)).alias(words_)).mapInArrow(run, docs.schema)
    return out


def op3_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "question_overlap", "answer_overlap", "first_word")
