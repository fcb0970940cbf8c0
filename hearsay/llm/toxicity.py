"""Toxicity by a weighted finite-state pattern grammar.

A lexicon of insults (seed words, and learned words and stems that are far likelier in toxic texts; a stem, written
``stem*``, stands for all words that begin with it, and is learned from texts that hold two different ones) joins seed
lists of threats, targets, negations and reported speech. A scanner finds the lexicon's words in a text, of several that
begin at one place the one of most evidence. Each clause with a hit is read once, from end to end however long it is, by
the composition of three weighted transducers: one turns hits shortly after a negation into negated ones, one turns hits
after a verb of reported speech or between quotation marks into reported ones, one turns insults into targeted ones if a
target is anywhere in the clause. What is scored are the matched clauses by class, against how many clauses the text
has; the weights of the classes are fitted on labelled rows.

Learning uses a bounded sample of labelled rows (``rows_per_label``), words of 3 to 40 letters, and at most
``lexicon_size`` entries. Defined results: null and empty texts have no clause and get the score of no evidence; rows with
a null label are never learned from; without labelled rows of both kinds the seeds and default weights are used; of
entries that begin at one place with equal evidence the one whose match ends first counts; repeated rows are scored one
by one; other columns pass through (those named like an added column are replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from hearsay.llm.sample import held_out, per_class
from hearsay.llm.text import own, without
from hearsay.runtime import cut, table

# Seeds of the grammar, lower case; threats, negations and reported speech in English, French, German, Spanish.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")
THREATS = (
    "kill you", "hurt you", "destroy you", "beat you", "find you", "make you pay", "burn you", "shoot you",
    "te tuer", "vous tuer", "te frapper", "vous frapper", "te détruire", "vous détruire", "te brûler", "te retrouver", "vous retrouver", "te faire payer",
    "dich töten", "euch töten", "dich umbringen", "euch umbringen", "dich schlagen", "dich vernichten", "dich verbrennen", "dich erschießen", "dich finden", "bringe dich um",
    "matarte", "te mataré", "te voy a matar", "golpearte", "te voy a golpear", "destruirte", "quemarte", "dispararte", "encontrarte", "hacerte daño", "te haré pagar",
)
TARGETS = ("you", "your", "you're", "he", "she", "they", "these", "those", "people", "tu", "vous", "du", "ihr", "usted", "ustedes")
NEGATIONS = (
    "not", "never", "isn't", "aren't", "don't", "no one", "nobody", "without",
    "pas", "jamais", "aucun", "aucune", "personne", "sans", "n'est", "n'es", "n'êtes", "n'était",
    "nicht", "nie", "niemals", "niemand", "kein", "keine", "keinen", "keiner", "ohne",
    "no", "nunca", "jamás", "nadie", "ningún", "ninguna", "tampoco", "sin",
)
REPORTED = (
    "said", "says", "wrote", "writes", "quoted", "according", "reported", "claimed", "called", "alleged",
    "dit", "disait", "écrit", "écrivait", "cité", "selon", "rapporté", "déclaré", "affirmé", "affirme", "appelé", "prétendu",
    "sagte", "sagt", "schrieb", "schreibt", "zitierte", "laut", "zufolge", "berichtete", "behauptete", "behauptet", "nannte", "angeblich",
    "dijo", "dice", "escribió", "escribe", "citó", "según", "informó", "afirmó", "afirma", "llamó", "supuestamente",
)
#: Classes of clauses, in the order of the weights; each feature is the logarithm of 1 plus the evidence of its clauses, in
#: texts of more than CLAUSES clauses that of CLAUSES of them on average.
CLASSES = ("insult", "targeted", "negated", "reported", "threat")
CLAUSES = 20
#: Constant and weights by class before any row is seen; fitting starts from them and keeps them where rows say nothing.
#: A lone insult without a pattern stays under REJECT by itself.
DEFAULT = (-4.0, 2.0, 5.0, 1.0, 1.0, 5.0)
#: Evidence (a logit) of seed words; learned words get that of the lower bound on their share of toxic texts, if it is at
#: least LEAST of the greatest that is learned.
SEED, LEAST = 3.0, 0.5

#: Lengths of the stems that are tried.
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)

ENDS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{ENDS}]")
CLAUSE = re.compile(rf"[^\s{ENDS}][^{ENDS}]*")
QUOTES = "\"“”«»„"
TOKEN = re.compile(rf"[^\W_]+(?:['’][^\W_]+)?|[{QUOTES}]")
#: Words after a negation that it still governs.
NEAR = 4

HITS = ("insult", "threat")
#: What a clause is read as: a mark before each hit, then words by what they are cues of.
SYMBOLS = (*HITS, "word", "target", "negation", "reported", "quote")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> [(next state, symbol written, cost)]; of all accepted readings the cheapest counts."""

    start: object
    final: set
    arcs: dict[tuple, list[tuple]]

    def over(self, then: Transducer) -> Transducer:
        """The composition: ``then`` reads what this one writes."""
        start = (self.start, then.start)
        arcs: dict[tuple, list[tuple]] = {}
        todo, seen = [start], {start}
        by_state: dict = {}
        for (state, symbol), steps in self.arcs.items():
            by_state.setdefault(state, []).append((symbol, steps))
        while todo:
            a, b = at = todo.pop()
            for symbol, steps in by_state.get(a, ()):
                made = [((a2, b2), out, c + d) for a2, mid, c in steps for b2, out, d in then.arcs.get((b, mid), ())]
                arcs[at, symbol] = made
                for to, _, _ in made:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return Transducer(start, {s for s in seen if s[0] in self.final and s[1] in then.final}, arcs)

    def numbered(self) -> Transducer:
        """The same with numbers for states."""
        number: dict = {self.start: 0}
        for state, _ in self.arcs:
            number.setdefault(state, len(number))
        return Transducer(0, {number[s] for s in self.final if s in number}, {(number[s], x): [(number[t], o, c) for t, o, c in steps] for (s, x), steps in self.arcs.items()})

    def read(self, symbols: list[str]) -> list[str]:
        """What the cheapest accepted reading writes at hits; readings that meet in a state go on as one."""
        live: dict = {self.start: (0, None)}
        for x in symbols:
            nexts: dict = {}
            for state, (cost, back) in live.items():
                for to, out, c in self.arcs.get((state, x), ()):
                    if to not in nexts or cost + c < nexts[to][0]:
                        nexts[to] = (cost + c, (out, back) if x in HITS else back)
            live = nexts
        back = min((v for s, v in live.items() if s in self.final), key=lambda v: v[0])[1]
        written = []
        while back is not None:
            written.append(back[0])
            back = back[1]
        return written[::-1]


def _negation() -> Transducer:
    """States: for how many words a negation still holds."""
    arcs = {}
    for k in range(NEAR + 1):
        for x in SYMBOLS:
            if x in HITS:
                arcs[k, x] = [(k, "negated" if k else x, 0)]
            else:
                arcs[k, x] = [(NEAR if x == "negation" else k if x == "quote" else max(k - 1, 0), x, 0)]
    return Transducer(0, set(range(NEAR + 1)), arcs)


def _reported() -> Transducer:
    """States: whether a verb was read; 0 no quotation mark was, 1 one was, 2 a hit was taken as quoted and a mark must follow."""
    arcs = {}
    for verb in (False, True):
        for q in (0, 1, 2):
            for x in (*SYMBOLS, "negated"):
                at = (verb, q)
                if x == "reported":
                    arcs[at, x] = [((True, q), x, 0)]
                elif x == "quote":
                    arcs[at, x] = [((verb, 1), x, 0)]
                elif x not in HITS:
                    arcs[at, x] = [(at, x, 0)]
                elif verb:
                    arcs[at, x] = [(at, "reported_hit", 0)]
                elif q:
                    arcs[at, x] = [((verb, 2), "reported_hit", 0), (at, x, 1)]
                else:
                    arcs[at, x] = [(at, x, 0)]
    return Transducer((False, 0), {(v, q) for v in (False, True) for q in (0, 1)}, arcs)


def _target() -> Transducer:
    """States: 0 no target was read, 1 one was, 2 an insult was taken as targeted and a target must follow."""
    arcs = {}
    for at in (0, 1, 2):
        for x in (*SYMBOLS, "negated", "reported_hit"):
            if x == "target":
                arcs[at, x] = [(1, x, 0)]
            elif x == "insult":
                arcs[at, x] = [(1, "targeted", 0)] if at == 1 else [(2, "targeted", 0), (at, x, 1)]
            else:
                arcs[at, x] = [(at, {"reported_hit": "reported"}.get(x, x), 0)]
    return Transducer(0, {0, 1}, arcs)


PATTERNS = _negation().over(_reported()).over(_target()).numbered()


@dataclass
class Grammar:
    """The lexicon (word or ``stem*`` -> evidence), the patterns built of it, and the fitted weights."""

    lexicon: dict[str, float]
    weights: tuple[float, ...] = DEFAULT
    _cues: dict[str, str] = field(default_factory=dict, repr=False)
    _scan: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "_cues": {}, "_scan": None}

    def ready(self) -> None:
        import ahocorasick

        for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("reported", REPORTED)):
            for w in words:
                self._cues.setdefault(w, kind)
        self._scan = ahocorasick.Automaton()
        for w in {w.removesuffix("*") for w in self.lexicon}:
            self._scan.add_word(w, (len(w), "insult", self.lexicon.get(w, 0.0), self.lexicon.get(f"{w}*", 0.0)))
        for w in THREATS:
            self._scan.add_word(w, (len(w), "threat", SEED, 0.0))
        if len(self._scan):
            self._scan.make_automaton()

    def clauses(self, text: str) -> list[tuple[str, float, int, int]]:
        """(class, weight, start, end) of each matched clause part; positions are in the lower-cased text."""
        if self._scan is None:
            self.ready()
        low, best = text.lower(), {}
        if not len(self._scan):
            return []
        for end, (n, kind, word, stem) in self._scan.iter(low):
            start = end - n + 1
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            goes_on = end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")
            weight = stem if goes_on else max(stem, word)
            if weight > best.get(start, ("", 0.0, 0))[1]:
                best[start] = kind, weight, end + 1
        out, hits, k = [], sorted((start, end, kind, weight) for start, (kind, weight, end) in best.items()), 0
        after = 0  # where the clause that was read last ends
        while k < len(hits):
            start, end = hits[k][:2]
            left = max(after, *(low.rfind(c, after, start) + 1 for c in ENDS))
            stop = CLAUSE_END.search(low, end)
            after = stop.start() if stop else len(low)
            first = k
            while k < len(hits) and hits[k][0] < after:
                k += 1
            kinds = PATTERNS.read(self._symbols(low, left, after, hits[first:k]))
            out += [(kind, weight, start, end) for kind, (start, end, _, weight) in zip(kinds, hits[first:k], strict=True)]
        return out

    def _symbols(self, low: str, left: int, right: int, hits: list[tuple]) -> list[str]:
        """The clause as the transducers read it; of a run of words without a cue, as many as a negation reaches over."""
        out, k, plain, last = [], 0, 0, ""
        for m in TOKEN.finditer(low, left, right):
            while k < len(hits) and hits[k][0] <= m.start():
                out.append(hits[k][2])
                k += 1
            w = m[0].replace("’", "'")
            x = "quote" if w in QUOTES else self._cues.get(w) or ("negation" if f"{last} {w}" in NEGATIONS else "word")
            plain = plain + 1 if x == "word" else 0
            if plain <= NEAR:
                out.append(x)
            last = w
        return out + [h[2] for h in hits[k:]]

    def features(self, text: str, clauses: list[tuple] | None = None) -> list[float]:
        by = dict.fromkeys(CLASSES, 0.0)
        found = self.clauses(text) if clauses is None else clauses
        for kind, weight, _, _ in found:
            by[kind] += weight
        share = CLAUSES / max(CLAUSES, len(CLAUSE.findall(text))) if found else 1.0
        return [1.0, *(math.log1p(by[c] * share) for c in CLASSES)]

    def score(self, text: str, clauses: list[tuple] | None = None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text, clauses), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _lexicon(table: DataFrame, bad: str, good: str, n_bad: int, n_good: int, size: int) -> dict[str, float]:
    """Words and stems that toxic texts have far oftener, with the logit of a lower bound (Wilson) on their share."""
    learned: dict[str, float] = {}
    share = (F.col(bad) / n_bad) / (F.col(bad) / n_bad + (F.col(good) + 0.5) / n_good)
    top = table.filter(F.col(bad) >= max(3, math.ceil(0.002 * n_bad))).select("w", F.col(bad).alias("b"), F.col(good).alias("g"), share.alias("p"))
    for r in top.filter("p >= 0.9").orderBy(F.desc("b"), "w").limit(size).collect():
        n, p = r.b + r.g, r.p
        low = (p + 1.92 / n - 1.96 * math.sqrt(p * (1 - p) / n + 0.96 / n / n)) / (1 + 3.84 / n)
        if low > 0.55:
            learned[r.w] = round(math.log(low / (1 - low)), 6)
    least = LEAST * max((x for w, x in learned.items() if w not in INSULTS), default=0.0)
    found = dict.fromkeys(INSULTS, SEED)
    return found | {w: max(x, found.get(w, 0.0)) for w, x in learned.items() if x >= least}


def _stems(words: DataFrame) -> DataFrame:
    """Rows (y, a, w) of the stems (``stem*``) that two or more different words of a text share, from its words."""
    cuts = F.filter(F.array(*(F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEM_LENGTHS)), lambda s: s.isNotNull())
    shared = words.select("id", "y", "a", F.explode(cuts).alias("s")).groupBy("id", "y", "a", "s").count().filter("count > 1")
    return shared.select("y", "a", F.concat("s", F.lit("*")).alias("w"))


def learn(rows: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows_per_label: int = 3000, lexicon_size: int = 2000) -> Grammar:
    """Fit a grammar on at most ``rows_per_label`` rows of each label (0 and 1).

    The weights are fitted on a third of the sample with a lexicon of the other two, so that words that are in the
    lexicon by chance don't count as evidence; the lexicon that is returned is of the whole sample.
    """
    good = rows.filter(own(label).isin(0, 1) & own(text).isNotNull()).select(own(key).alias("key"), own(label).cast("int").alias("y"), own(text).alias("text"))
    picked = cut(per_class(good, "y", "key", rows_per_label).select("y", "text", (F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(3)) > 0).alias("a")))
    totals = picked.agg(F.sum("y"), F.sum(1 - F.col("y")), F.sum(F.when(F.col("a"), F.col("y"))), F.sum(F.when(F.col("a"), 1 - F.col("y")))).first()
    if not all(totals):
        return Grammar(dict.fromkeys(INSULTS, SEED))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}']+")), lambda w: F.length(w).between(3, 40))
    each = picked.withColumn("id", F.monotonically_increasing_id()).select("id", "y", "a", F.explode(words).alias("w"))
    counts = each.select("y", "a", "w").unionByName(_stems(each))
    in_a = F.col("a").cast("int")
    table = cut(
        counts.groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"), F.sum(F.col("y") * in_a).alias("bad_a"), F.sum((1 - F.col("y")) * in_a).alias("good_a")).filter("bad > 2")
    )
    grammar = Grammar(_lexicon(table, "bad", "good", totals[0], totals[1], lexicon_size))
    shared = rows.sparkSession.sparkContext.broadcast(Grammar(_lexicon(table, "bad_a", "good_a", totals[2], totals[3], lexicon_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            x = [g.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = picked.filter("not a").select("y", "text").mapInArrow(run, "y int, x array<double>").groupBy("y", "x").count().collect()  # at most the sample's rows
    got = sorted((r[0], r[1], r[2]) for r in got)
    if got:
        grammar.weights = tuple(_fit(np.array([r[1] for r in got]), np.array([r[0] for r in got], float), np.array([r[2] for r in got], float)))
    return grammar


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Logistic regression by Newton's method, drawn to the default weights; weights of classes are not negative."""
    prior = np.array(DEFAULT)
    free = np.arange(len(prior))
    while True:
        w = np.where(np.isin(np.arange(len(prior)), free), prior, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - y)) + ridge * (w - prior)
            h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(prior))
            step = np.zeros_like(w)
            step[free] = np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -2, 2)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        below = [i for i in free if i and w[i] < 0]
        if not below:
            return w.tolist()
        free = np.array([i for i in free if i not in below])


def toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and clauses (array of class, start, end: the matched parts) to every row; whole texts are read."""
    docs = without(docs, ("score", "clauses"), (text,))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = StructType(list(docs.schema.fields)).add("score", "double").add("clauses", _parse_datatype_string("array<struct<kind:string,start:int,end:int>>"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            read = [g.clauses(t) for t in texts]
            scores = pa.array([g.score(t, c) for t, c in zip(texts, read, strict=True)], pa.float64())
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, _, s, e in c] for c in read], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, scores, found], names=[*b.schema.names, "score", "clauses"])

    return docs.mapInArrow(run, schema)


#: Documents from this score on are rejected.
REJECT = 0.7


def learn_from(spark, docs: DataFrame, sf_dir: str, rows_per_label: int = 3000) -> Grammar:
    """The grammar of the labelled rows that are not held out. Ids are sampled before texts are looked up, so what is
    joined, and broadcast, is twice ``rows_per_label`` ids at most, and no text is shuffled."""
    labels = table(spark, sf_dir, "labels").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = cut(per_class(labels, "toxic", "doc_id", rows_per_label))
    return learn(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), rows_per_label=rows_per_label)


def op6_query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learn_from(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))
