"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The frequent words of the corpus (counted over all of it) are compiled, with the ids each encodes to, into an
automaton in which words share prefixes and suffixes; walking a word adds up the counts on its arcs, which gives its
place in the sorted lexicon and so its ids. The automaton is a few arrays in one file, memory-mapped by each worker
and walked for all new words of a batch at once. Words that it lacks are merged exactly, by rank, and side by side too.

The result is that of the tokenizers library for the same file, without added special tokens; the file's special
token in a text is matched as such. Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded one by one; other columns pass through (those named like an added column are replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from hearsay.llm.text import fresh, own, without
from hearsay.runtime import cut

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of up to so many bytes merge side by side, with others of about their length (WIDTHS) and BESIDE of them at most.
SHORT, WIDTHS, BESIDE = 40, (2, 4, 6, 8, 12, 16, 24, 40), 16_384
#: The rank of a pair that doesn't merge.
NO_RANK = 2**31 - 1


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Exact BPE: the pair of lowest rank merges first, the leftmost of equals, until none is left."""

    def __init__(self, content: str):
        model = json.loads(content)
        letters = byte_letters()
        vocab: dict[str, int] = model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.special = special
        self.size = max([*vocab.values(), *special.values()], default=-1) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for word, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in word) if word not in special else word.encode()
        for word, i in special.items():
            self.token_bytes[i] = word.encode()
        one = {self.token_bytes[i]: i for i in vocab.values() if len(self.token_bytes[i]) == 1}
        self.byte_id = [one.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._arrays()

    def _arrays(self) -> None:
        """The pairs once more, as sorted keys with their ranks, the id that each rank makes, and the ranks of pairs of bytes."""
        found = sorted((a * self.size + b, rank, new) for (a, b), (rank, new) in self.pairs.items())
        self.keys, self.ranks = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        self.made = np.zeros(max((x[1] for x in found), default=-1) + 1, np.int64)
        self.made[self.ranks] = [x[2] for x in found]
        self.letter = np.array(self.byte_id, np.int64)
        self.first = self._ranks(np.repeat(self.letter, 256), np.tile(self.letter, 256))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NO_RANK, np.int64)
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def encode(self, piece: bytes) -> list[int]:
        ids = [i for b in piece if (i := self.byte_id[b]) >= 0]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """``encode`` of each piece, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(lengths) - lengths
        lacking = np.concatenate(([0], np.cumsum(self.letter[raw] < 0)))
        beside = (lengths > 0) & (lengths <= SHORT) & (lacking[begin + lengths] == lacking[begin])
        for i in np.flatnonzero(~beside).tolist():
            out[i] = np.array(self.encode(pieces[i]), "<u4").tobytes()
        least = 0
        for width in WIDTHS:
            which = np.flatnonzero(beside & (lengths > least) & (lengths <= width))
            least = width
            for k in range(0, len(which), BESIDE):
                rows = which[k : k + BESIDE]
                ids, n = self._side_by_side(raw, begin[rows], lengths[rows], width)
                flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
                for i, a, z in zip(rows.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:z]
        return out

    def _side_by_side(self, raw: np.ndarray, begin: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another; ids of each): in each turn the leftmost pair of lowest rank of every piece
        merges. A merged pair stays in its left column; ``after`` and ``before`` lead to the next columns in use."""
        cols = np.arange(width)
        there = cols < lengths[:, None]
        letters = raw[np.minimum(begin[:, None] + cols, len(raw) - 1)]
        ids = self.letter[letters]
        ranks = np.full(ids.shape, NO_RANK, np.int64)
        ranks[:, :-1] = np.where(there[:, 1:], self.first[letters[:, :-1] << 8 | letters[:, 1:]], NO_RANK)
        after, before = (np.tile(cols + x, (len(ids), 1)) for x in (1, -1))
        live = np.arange(len(ids))
        while len(live):
            now = ranks[live]
            i = now.argmin(1)
            best = now[np.arange(len(live)), i]
            some = best < NO_RANK
            live, i, best = live[some], i[some], best[some]
            j = after[live, i]
            k = after[live, j]
            new = self.made[best]
            ids[live, i], there[live, j], ranks[live, j], ranks[live, i], after[live, i] = new, False, NO_RANK, NO_RANK, k
            more = k < lengths[live]
            r, x, y = live[more], i[more], k[more]
            before[r, y] = x
            ranks[r, x] = self._ranks(new[more], ids[r, y])
            h = before[live, i]
            more = h >= 0
            r, x = live[more], h[more]
            ranks[r, x] = self._ranks(ids[r, x], new[more])
        return ids[there], there.sum(1)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r), default=None)
            if best is None:
                return ids
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]))
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]))

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with their ids, as one block of bytes to be mapped.

    Words come in sorted order; a state is closed when the next word leaves it, and then replaced by an equal state
    if there is one (equal: final alike, same arcs to same states), so suffixes are shared as well as prefixes.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
        return s

    path: list[tuple[bool, list[tuple[int, int]], int]] = []  # open states below the root: final, arcs, label that leads there
    root: list[tuple[int, int]] = []
    root_final, last = False, b""

    def fold(depth: int) -> None:
        while len(path) > depth:
            final, arcs, label = path.pop()
            (path[-1][1] if path else root).append((label, close(final, arcs)))

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        fold(common)
        for i in range(common, len(w)):
            path.append((i == len(w) - 1, [], w[i]))
        root_final |= not w
        last = w
    fold(0)
    start = close(root_final, root)
    # states close before those that lead to them, so the words below a state are counted in order
    below = []
    keys, targets, skips = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(n)
            n += below[t]
        below.append(n)
    ids = [entries[w] for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    order = np.argsort(np.array(keys, np.int64))
    arrays = [
        np.array([start, len(words), len(keys), len(states)], np.int64), np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(skips, np.int64)[order],
        np.array([f for f, _ in states], np.int64), offsets.astype(np.int64), np.array([i for x in ids for i in x], np.int64),
    ]
    head = np.array([len(a) for a in arrays], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped from a file that has no name any more and goes with the process."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 7)
        at, parts = 56, []
        for n in head.tolist():
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        (self.start, self.words, _, self.states), self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = parts[0].tolist(), *parts[1:]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the sorted lexicon, -1 where it isn't in it; all words walk at once."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(lengths) - lengths
        live, state, place, step = np.flatnonzero(lengths > 0), np.full(n, self.start, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            want = state[live] << 8 | raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            place[live] += self.skips[at]
            step += 1
            done = lengths[live] == step
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = place[ended]
            live = live[~done]
        return out


class Encoder:
    """Texts to ids, for one worker: pieces are looked up once in a memo of bounded size, then in the lexicon, then merged."""

    def __init__(self, merges: Merges, lexicon: bytes, memo: int = 300_000):
        self.merges, self.lexicon, self.most = merges, Lexicon(lexicon), memo
        self.known = self.lexicon.ids.astype("<u4").tobytes()
        self.memo: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.special = sorted(merges.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        if self.marks is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            # a special token is kept apart from a piece of the same letters by a leading NUL pair
            out += ["\0\0" + part] if k % 2 else self.split(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(pieces)
        raw = [p.encode() for p in new]
        where, lex, special = self.lexicon.places(raw), self.lexicon, self.merges.special
        starts, ends = lex.offsets[np.maximum(where, 0)], lex.offsets[np.maximum(where, 0) + 1] if lex.words else where
        left = []
        for k, (p, w, a, b) in enumerate(zip(new, where.tolist(), starts.tolist(), ends.tolist(), strict=True)):
            if w >= 0:
                self.memo[p] = self.known[4 * a : 4 * b]
            elif p.startswith("\0\0") and p[2:] in special:
                self.memo[p] = np.array([special[p[2:]]], "<u4").tobytes()
            else:
                left.append(k)
        self.memo.update(zip([new[k] for k in left], self.merges.encode_all([raw[k] for k in left]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 2_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.merges.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text: str = "text", most: int = 65_536, at_least: int = 3) -> list[str]:
    """The most frequent words of all texts, ``most`` at the most, as the split pattern would cut them (with and without a
    space). The count from which words are taken comes from a histogram of counts, so that only words that are taken
    reach the driver; words of the last, only partly fitting step of the histogram aren't taken."""
    words = docs.select(F.explode(F.split(F.coalesce(own(text), F.lit("")), r"\s+")).alias("w")).filter("w <> '' and length(w) <= 64")
    counted = cut(words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).withColumn("step", F.floor(F.log2("n") * 64).cast("int")))
    steps = sorted(((r[0], r[1]) for r in counted.groupBy("step").count().collect()), reverse=True)  # 64 steps for each doubling
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        least = step
    split, out = regex.compile(PATTERN).findall, set()
    if least is not None:
        for (w,) in counted.filter(F.col("step") >= least).select("w").collect():  # bounded by `most`
            out.update(split(" " + w))
            out.update(split(w))
    return sorted(out)


def make_lexicon(merges: Merges, words: list[str]) -> bytes:
    raw = [w.encode() for w in words if not w.startswith("\0")]
    return compile_lexicon({w: np.frombuffer(x, "<u4").tolist() for w, x in zip(raw, merges.encode_all(raw), strict=True)})


#: The encoder of a worker, by a digest of its tokenizer and lexicon.
_WORKER: dict[str, Encoder] = {}


def bpe_encode(docs: DataFrame, tokenizer_json: str, text: str = "text", lexicon_words: int = 65_536, emit: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode every whole text.

    ``emit`` names the columns that are added: ids (array<int>), n_tokens, decoded (the ids decoded again),
    ids_sha256 and decoded_sha256. The text column itself is dropped unless ``emit`` has "text".
    """
    spark = docs.sparkSession
    kinds = {"ids": "array<int>", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    wanted = [k for k in kinds if k in emit]
    docs = without(docs, wanted, (text,))
    with open(tokenizer_json, encoding="utf-8") as f:
        content = f.read()
    merges = Merges(content)
    lexicon = make_lexicon(merges, frequent_words(docs, text, lexicon_words))
    digest = hashlib.sha256(content.encode() + lexicon).hexdigest()
    shared = spark.sparkContext.broadcast((merges, lexicon))
    keep_text = "text" in emit
    kept = [c for c in docs.columns if c != text or keep_text]
    fed = docs.select(*map(own, kept), F.coalesce(own(text), F.lit("")).alias(fresh(docs.columns, "fed")[0]))
    schema = StructType([docs.schema[c] for c in kept])
    for k in wanted:
        schema = schema.add(k, _parse_datatype_string(kinds[k]))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _WORKER:
            _WORKER.clear()
            _WORKER[digest] = Encoder(*shared.value)
        coder = _WORKER[digest]
        for whole in batches:
            for b in by_bytes(whole):
                ids = coder.encode(b.column(b.num_columns - 1).to_pylist())
                decoded = [coder.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(wanted) else None
                made = {
                    "ids": lambda: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))),
                    "n_tokens": lambda: pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "decoded": lambda: pa.array(decoded, pa.string()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(made[k]() for k in wanted)], names=names)

    return fed.mapInArrow(run, schema)


def by_bytes(b: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in pieces of about ``most`` bytes of its last column; a longer text is a piece of its own."""
    import pyarrow.compute as pc

    size, start, acc = pc.binary_length(b.column(b.num_columns - 1)).to_pylist(), 0, 0
    for i, s in enumerate(size):
        if i > start and acc + s > most:
            yield b.slice(start, i - start)
            start, acc = i, 0
        acc += s
    if b.num_rows:
        yield b.slice(start)


def bpe_decode(rows: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; null ids give a null."""
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = rows.sparkSession.sparkContext.broadcast(Merges(f.read()).token_bytes)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for s in batches:
            yield pd.Series([None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in s])

    rows = without(rows, (out,), (ids,))
    return rows.withColumn(out, decode(own(ids)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, default_tokenizer(), emit=("n_tokens", "ids_sha256", "decoded_sha256"))
