"""Word and hash expressions shared by the text operators; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the counting operators: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Words of the matching operators: runs of letters and digits, lower-cased.
NOT_WORD = r"[^\p{L}\p{N}]+"


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for internal columns that no column in ``taken`` has, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def own(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, added: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """``docs`` less the columns that are named, in any case, like one that is to be added; those in ``keep`` are read,
    so they must not be among them."""
    lower = {a.lower() for a in added}
    if bad := [k for k in keep if k.lower() in lower]:
        raise ValueError(f"columns {bad} are read and would be replaced by results; rename them")
    return docs.select(*[own(c) for c in docs.columns if c.lower() not in lower])


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def space_words(text: str | Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(as_column(text), F.lit("")), SPACE), "")


def plain_words(text: str | Column) -> Column:
    """Lower-cased words of letters and digits; none for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), NOT_WORD), "")


def word_hashes(text: str | Column) -> Column:
    """A 64-bit hash of each plain word, in order: what the vectorised operators get instead of strings."""
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of an Arrow list column of longs; null lists count as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return np.asarray(lists.flatten(), dtype=np.int64), offsets


MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums and products of hashes spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_B
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on, over all rows at once; the last n-1 of a row reach into the next."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    v = values.view(np.uint64) if values.dtype == np.int64 else values
    out = np.zeros(len(v) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * MIX_A + v[i : len(v) - n + 1 + i]
    return mix(out)


def ngram_starts(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of n-grams that stay inside their row, and how many each row has."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    total = int(counts.sum())
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + first, counts


def slices(batches: Iterator[pa.RecordBatch], weight: str | None = None, budget: int = 4_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``budget`` bytes or values of the column ``weight``; rows stay whole."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(weight if weight is not None else 0)
        if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
            size = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
        else:
            import pyarrow.compute as pc

            size = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
        start, acc = 0, 0
        for i, s in enumerate(size.tolist()):
            if i > start and (acc + s > budget or i - start >= rows):
                yield b.slice(start, i - start)
                start, acc = i, 0
            acc += s
        yield b.slice(start)


ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
