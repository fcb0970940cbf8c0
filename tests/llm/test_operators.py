"""Edge cases of every operator, and each held against brute force, a library or held-out labels on small tables."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hearsay.llm import bpe, decontaminate, langid, licenses, linededup, neardup, quality, sample, sharding, toxicity, urls
from tests.compare import duck, rows

ODD = [None, "", "   ", "\n\n", "x", "Ünï cödé 漢字 🎉", "a" * 300_000, "word " * 30_000, "one two three four five six", "one two three four five six"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null and a repeated id, and columns that clash with results."""
    out = [(i, t, 7.0, "mine") for i, t in enumerate(ODD)] + [(None, "no id", 1.0, "mine"), (3, "an id again", 1.0, "mine"), (8, ODD[8], 7.0, "mine")]
    return spark.createDataFrame(out, "doc_id bigint, text string, score double, host string")


def empty(df):
    return df.limit(0)


def test_quality_odd(odd):
    got = quality.quality_rules(odd.withColumn("kept", F.lit("clash"))).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept and by[0].clean_text == ""
    assert by[7].n_words == 30_000 and by[7].n_repeat_words == 30_000 and by[7].base_failed
    assert quality.quality_rules(empty(odd)).count() == 0


def test_quality_rules_by_line(spark):
    good = "\n".join(" ".join(f"line{k}word{i}" for i in range(12)) + "." for k in range(6))
    bad = {"navigation": "Home | News | Sport | Shop | About", "symbols": "### $$$ %%% a b", "capitals": "BUY NOW ALL OF THESE GREAT THINGS TODAY.", "boilerplate": "Please enable JavaScript to go on."}
    d = spark.createDataFrame([(i, f"{good}\n{x}") for i, x in enumerate(bad.values())] + [(9, good)], "doc_id int, text string")
    got = {r.doc_id: r for r in quality.quality_rules(d).collect()}
    for i, rule in enumerate(bad):
        assert got[i].failed_rules == [rule] and got[i].kept and got[i].clean_text == good
    assert got[9].n_failed_lines == 0 and got[9].kept


def test_quality_repeats_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    got = {r.doc_id: r for r in quality.base_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for k in range(len(w) - 2) if n[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))


@pytest.mark.parametrize("name", ["op4_url_filter", "op7_line_dedup", "op8_quality_rules", "op9_sharding"])
def test_queries_against_sql(spark, sf_dir, name):
    from hearsay.llm.queries import ORACLES, QUERIES

    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir).execute(ORACLES[name]).df())


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("http://A.Example.ORG/en/17?x", "a.example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en", "example.org", "/en", "org/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), ("http://x.com/deep", "x.com", "/deep", None, "allow"),
        ("http://org", "org", "", None, "allow"), ("ftp://u@b.org:1/#a/b", "u@b.org:1", "/", None, "allow"), ("a://b://c.com/fr/", "b:", "//c.com/fr/", None, "allow"), ("http:///com/fr/", "", "/com/fr/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id int, url string, rule string")
    for bound in (100, 2):  # through one trie, and through three, one after another
        got = {r.page_id: r for r in urls.url_filter(pages, urls.OP4_ALLOW, urls.OP4_BLOCK, entries_per_pass=bound).collect()}
        assert {i: tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in got} == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.url_filter(empty(pages), [], []).count() == 0


def test_trie_against_brute_force():
    rng = random.Random(1)
    names, segs = ["a", "b", "com", "x"], ["p", "pq", "q", ""]
    rules = {}
    for _ in range(60):
        h = ".".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
        rules[h + "/" + "/".join(rng.choice(segs) for _ in range(rng.randint(1, 3)))] = rng.choice(["allow", "block"])
    trie = urls.HostTrie(list(rules.items()))
    for _ in range(3000):
        host = ".".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
        path = "/" + "/".join(rng.choice(segs) for _ in range(rng.randint(1, 4)))
        fits = [(len(h.split(".")), len(p), r) for r in rules for h, _, p in [r.partition("/")] for p in ["/" + p] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (trie.find(host, path) or (None,))[0] == (max(fits)[2] if fits else None)


def test_sharding(spark, odd):
    d = spark.createDataFrame([(i, "t" * (i % 97)) for i in range(5000)] + [(7, "same" * 100)] * 40, "doc_id int, text string")
    out, shards = sharding.extendible_shards(d, limit=2000)
    got = out.toPandas()
    assert len(got) == 5040
    size = got.groupby("shard").n_bytes.sum()
    big = got[got.oversized].groupby("shard").text.nunique()
    assert (size[~size.index.isin(big.index)] <= 2000).all() and (big == 1).all()
    assert len(shards.collect()) == got.shard.nunique()
    assert sharding.extendible_shards(odd, limit=1000)[0].count() == odd.count()
    out, shards = sharding.extendible_shards(empty(odd), limit=1000)
    assert shards.count() == 0 and out.count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def merges():
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        return bpe.Merges(f.read())


def test_bpe_against_library(spark, odd, tokenizer):
    got = bpe.bpe_encode(odd.withColumn("n_tokens", F.lit("clash")), bpe.default_tokenizer(), emit=("text", "ids", "n_tokens", "decoded", "ids_sha256"))
    for r in got.collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (r.text or "") and r.score in (1.0, 7.0)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.bpe_encode(empty(odd), bpe.default_tokenizer()).count() == 0
    back = bpe.bpe_decode(got.select("ids", "text"), bpe.default_tokenizer()).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_bpe_merges_side_by_side(tokenizer, merges, monkeypatch):
    rng = random.Random(12)
    pieces = [bytes(rng.choices(b"abcdeinorst .\xc3\xa9\xff", k=rng.randint(0, 50))) for _ in range(3000)] + [b"a" * k for k in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.encode_all(pieces)] == [merges.encode(p) for p in pieces]
    # a letter that has no id is left out, and a file without merges has only letters
    few = bpe.Merges(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}))
    assert [np.frombuffer(x, "<u4").tolist() for x in few.encode_all([b"aab", b"xab", b"x", b"", b"a"])] == [[0, 2], [2], [], [], [0]]
    none = bpe.Merges(json.dumps({"model": {"vocab": {"a": 0}, "merges": []}}))
    assert [np.frombuffer(x, "<u4").tolist() for x in none.encode_all([b"aa", b"b"])] == [[0, 0], []]
    # words that the lexicon lacks aren't merged one by one
    coder = bpe.Encoder(merges, bpe.make_lexicon(merges, ["the"]))
    want = [coder.merges.encode(w) for w in (b"unheard", b" of", b" words")]
    monkeypatch.setattr(bpe.Merges, "encode", lambda *_: pytest.fail("merged alone"))
    assert np.frombuffer(coder.encode(["unheard of words"])[0], "<u4").tolist() == sum(want, [])


def test_bpe_fuzz(tokenizer, merges):
    rng = random.Random(2)
    coder = bpe.Encoder(merges, bpe.make_lexicon(merges, ["the", " the", "they", " cat", "s"]), memo=50)
    alphabet = [*"abc  \n\t\r\x1c\x85\xa0\u2003'sdté́漢12²½٣🎉\x00|<>", "<|endoftext|>", "'ll", "the", " the", " cat"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        want = tokenizer.encode(s, add_special_tokens=False).ids
        got = np.frombuffer(coder.encode([s])[0], "<u4")
        assert got.tolist() == want and coder.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "", "é"])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    ask = [*words, b"to", b"topsy", b"x"]
    for w, p in zip(ask, lex.places(ask).tolist(), strict=True):
        assert (lex.ids[lex.offsets[p] : lex.offsets[p + 1]].tolist() if p >= 0 else None) == (words.get(w) if w else None)
    assert lex.states < sum(len(w) for w in words)  # suffixes are shared


def test_language_id(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    d = langid.learn_dictionaries(docs.filter(~sample.held_out("doc_id")))
    assert set(d) == {"de", "en", "es", "fr"} and max(map(len, d.values())) <= 110_000
    got = langid.identify(docs.filter(sample.held_out("doc_id")).select("doc_id", "lang", "text"), d).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    odd_out = {r.doc_id: r for r in langid.identify(odd, d).collect()}
    assert [odd_out[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and 0 <= odd_out[6].score <= 1
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(empty(odd), d).count() == 0


def test_toxicity(spark, sf_dir, odd):
    root = sf_dir.rsplit("/", 1)[0] + "/sf0.1"
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    g = toxicity.learn_from(spark, docs, root)
    asked = spark.read.parquet(f"{root}/labels.parquet").filter(sample.held_out("doc_id")).join(docs, "doc_id")
    got = toxicity.toxicity(asked, g).select("toxic", "score").toPandas()
    hit = got.score >= toxicity.REJECT
    assert got.toxic[hit].mean() > 0.95 and hit[got.toxic == 1].mean() > 0.9
    assert toxicity.toxicity(odd, g).filter("score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(empty(odd), g).count() == 0
    assert toxicity.learn(odd.withColumn("toxic", F.lit(None).cast("int"))).weights == toxicity.DEFAULT


def test_grammar_classes():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, toxicity.SEED))
    kinds = lambda t: [k for k, *_ in g.clauses(t)]
    assert kinds("Pure trash here.") == ["insult"]
    assert kinds("You absolute idiot!") == ["targeted"]
    assert kinds("That is not stupid.") == ["negated"]
    assert kinds('He said "what a loser" then left.') == ["reported"]
    assert kinds("I will find you.") == ["threat"]
    assert kinds("idiotic trashcan") == []
    assert g.score("you idiot") > 0.7 > g.score("not an idiot") and g.score("") < 0.1


def test_grammar_long_clauses():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, toxicity.SEED))
    kinds = lambda t: [k for k, *_ in g.clauses(t)]
    far = "word " * 5000
    assert kinds(f"he said {far} idiot") == ["reported"]
    assert kinds(f"idiot {far} you") == kinds(f"you {far} idiot") == ["targeted"]
    assert kinds(f'"{far} idiot {far}"') == ["reported"]
    assert kinds(f'"{far} idiot {far}') == ["insult"] and kinds(f'"idiot" {far} moron') == ["reported", "insult"]
    assert kinds(f"not {far} idiot") == ["insult"] and kinds("not a b c idiot d moron") == ["negated", "insult"]
    assert kinds(f"you {far}. idiot {far}. he said {far}") == ["insult"]
    assert len(kinds("idiot " * 20_000 + "you")) == 20_000


def test_grammar_languages_and_lone_words():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, toxicity.SEED) | {"brut*": toxicity.SEED})
    kinds = lambda t: [k for k, *_ in g.clauses(t)]
    for t in ("Ce n'est pas un idiot", "Ce n’est vraiment un idiot", "Er ist kein idiot", "No es un idiot"):
        assert kinds(t) == ["negated"], t
    for t in ("Selon Paul un idiot", "Er sagte etwas über ein idiot", "Según Ana un idiot"):
        assert kinds(t) == ["reported"], t
    for t in ("Je vais te tuer", "Ich werde dich töten", "Te voy a matar", "Voy a matarte"):
        assert kinds(t) == ["threat"] and g.score(t) > toxicity.REJECT, t
    assert g.score("Pure trash here.") < toxicity.REJECT and g.score("trash") < toxicity.REJECT < g.score("you trash")
    assert kinds("they are brutish") == ["targeted"] and kinds("a brutish thing") == ["insult"]
    assert g.score("one brutish thing seen") < toxicity.REJECT
    assert max(g.score(f"{w} {'word ' * n}") for w in toxicity.INSULTS for n in (0, 1, 10, 1000)) < toxicity.REJECT


def _all_readings(parts, symbols):
    """(cost, what is written at hits) of every path through transducers, one after another, by enumeration."""
    def paths(t, state, k, given, out, cost):
        if k == len(given):
            if state in t.final:
                yield cost, tuple(out)
            return
        for to, x, c in t.arcs.get((state, given[k]), ()):
            yield from paths(t, to, k + 1, given, [*out, x], cost + c)

    level = [(0, tuple(symbols))]
    for t in parts:
        level = [(c + d, out) for c, given in level for d, out in paths(t, t.start, 0, given, [], 0)]
    hits = [k for k, x in enumerate(symbols) if x in toxicity.HITS]
    return [(c, [out[k] for k in hits]) for c, out in level]


def test_composition_against_all_paths():
    rng = random.Random(8)
    parts = [toxicity._negation(), toxicity._reported(), toxicity._target()]
    for _ in range(400):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(1, 7))]
        readings = _all_readings(parts, symbols)
        least = min(c for c, _ in readings)
        assert toxicity.PATTERNS.read(symbols) in [out for c, out in readings if c == least], symbols


def _plain_score(g, text):
    """The score by plain rules: each clause cut out, its words looked at one by one, no automaton and no transducer."""
    import math
    import re

    by = dict.fromkeys(toxicity.CLASSES, 0.0)
    low = text.lower()
    clauses = [c for c in re.split(r"[.!?;:\n]", low) if c.strip()]
    for clause in clauses:
        marks = list(re.finditer(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”«»„]", clause))
        words = [m[0].replace("’", "'") for m in marks]
        hits = []
        for m in re.finditer(r"(?<![\w])[^\W_]\w*", clause):
            word, best = m[0], ("", 0.0)
            for n in range(1, len(word) + 1):
                stem = g.lexicon.get(word[:n] + "*", 0.0)
                best = max(best, ("insult", max(stem, g.lexicon.get(word, 0.0) if n == len(word) else 0.0)), key=lambda b: b[1])
            for t in toxicity.THREATS:
                if clause.startswith(t, m.start()) and not clause[m.start() + len(t) : m.start() + len(t) + 1].isalnum() and toxicity.SEED > best[1]:
                    best = ("threat", toxicity.SEED)
            if best[1]:
                hits.append((m.start(), *best))
        for at, kind, weight in hits:
            before = [k for k, m in enumerate(marks) if m.start() < at]
            near = 0
            for k in before:
                negated = words[k] in toxicity.NEGATIONS or (k and f"{words[k - 1]} {words[k]}" in toxicity.NEGATIONS)
                cue = words[k] in toxicity.TARGETS or words[k] in toxicity.REPORTED
                near = toxicity.NEAR if negated and not cue else near if words[k] in toxicity.QUOTES else max(near - 1, 0)
            quoted = any(words[k] in toxicity.QUOTES for k in before) and any(m[0] in toxicity.QUOTES for m in marks if m.start() > at)
            if near:
                kind = "negated"
            elif quoted or any(words[k] in toxicity.REPORTED for k in before):
                kind = "reported"
            elif kind == "insult" and any(w in toxicity.TARGETS for w in words):
                kind = "targeted"
            by[kind] += weight
    share = toxicity.CLAUSES / max(toxicity.CLAUSES, len(clauses))
    z = g.weights[0] + sum(w * math.log1p(by[c] * share) for w, c in zip(g.weights[1:], toxicity.CLASSES, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_query_against_plain_rules(spark, sf_dir):
    root = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    g = toxicity.learn_from(spark, docs, root)
    got = {r.doc_id: r for r in toxicity.op6_query(spark, root).collect()}
    for r in docs.collect():
        want = _plain_score(g, r.text or "")
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.7), r.doc_id
    rng = random.Random(9)
    pool = [*toxicity.INSULTS, *toxicity.TARGETS, *toxicity.NEGATIONS, *toxicity.REPORTED, *toxicity.THREATS[:9], "«", "»", '"', ".", "!", "word", "other", "plain", "thing"]
    for _ in range(500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert abs(g.score(text) - _plain_score(g, text)) < 1e-9, text


def test_grammar_stems(spark):
    g = toxicity.Grammar({"brut*": 2.0, "brute": 3.0, "brutal*": 2.5})
    assert [c[:2] for c in g.clauses("brute brutish brutally abrute brut")] == [("insult", 3.0), ("insult", 2.0), ("insult", 2.5), ("insult", 2.0)]
    # matched clauses count against all clauses of a long text
    few = "They are brutish. " * 3
    assert g.score(few) > 0.7 > g.score(few + "A plain clause. " * 500)
    # any ending after the stem is bad; one word alone makes no stem
    bad = [(i, 1, f"here zorbi{chr(97 + i % 20)}{chr(97 + i % 17)}q and zorbi{chr(97 + i % 19)}{chr(97 + i % 13)}r with plimse") for i in range(60)]
    good = [(100 + i, 0, f"here are words {i} of a clean text") for i in range(60)]
    learned = toxicity.learn(spark.createDataFrame(bad + good, "doc_id int, toxic int, text string"))
    assert "zorbi*" in learned.lexicon and "plimse" in learned.lexicon and "plims*" not in learned.lexicon
    assert learned.score("a zorbixyz and zorbiabc") > 0.7 > max(learned.score("a plain text"), learned.score("a zorbixyz"))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 4, 9]))) for _ in range(12)] + [""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    least = 12
    got = {r.doc_id: r for r in linededup.line_dedup(spark.createDataFrame(docs, "doc_id int, text string"), min_words=least).collect()}
    seen, marks = {}, defaultdict(set)
    for i, t in docs:  # every run of lines, not only the shortest ones
        lines = t.split("\n")
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                run = tuple(lines[s : e + 1])
                if sum(len(x.split()) for x in run) >= least and seen.setdefault(run, (i, s)) != (i, s):
                    marks[i].update(range(s, e + 1))
    for i, t in docs:
        lines = t.split("\n")
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in marks[i]) and got[i].n_deleted == len(marks[i])


def _segments(spark, segs):
    """Segments of numbered lines as the table that the suffix array is made of."""
    return spark.createDataFrame([(g, list(s), list(s), [1] * len(s)) for g, s in enumerate(segs)], "g long, a array<long>, b array<long>, w array<long>")


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_array_against_brute_force(spark, parts):
    rng = random.Random(6)
    segs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    segs += [segs[0], segs[0][2:], segs[1] + segs[2], [5] * 20]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sa = linededup.suffix_array(linededup.doubled(linededup.suffixes(_segments(spark, segs), 1)))
        rows_ = sorted(sa.collect(), key=lambda r: r.m)
        found = {(r.g, r.i): r.n for r in linededup.earlier_prefixes(sa).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in rows_}) >= min(parts, 2)
    tail = lambda r: segs[r.g][r.i :]
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    # lines rank by hash numbers, which here are the lines themselves; equal suffixes stand by place
    assert [(r.g, r.i) for r in rows_] == [(g, i) for _, g, i in sorted((s[i:], g, i) for g, s in enumerate(segs) for i in range(len(s)))]
    for r, q in zip(rows_, rows_[1:], strict=False):
        assert q.lcp == common(tail(r), tail(q))
    for g, s in enumerate(segs):
        for i in range(len(s)):
            best = max((common(s[i:], t[j:]) for h, t in enumerate(segs) for j in range(len(t)) if (h, j) < (g, i)), default=0)
            assert found.get((g, i), 0) == best, (g, i)


def test_line_dedup_odd(odd):
    got = linededup.line_dedup(odd.withColumn("deleted", F.lit("clash"))).collect()
    assert len(got) == odd.count() and {r.n_lines for r in got if r.text is None and r.doc_id == 0} == {0}
    assert linededup.line_dedup(empty(odd)).count() == 0


def _links(texts, threshold=0.8):
    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    sets = []
    for t in texts:
        w = cut(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= threshold] for i, a in enumerate(sets)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:  # a chain of edits, several copies of each step, and a large group
        for _ in range(rng.randint(1, 8)):
            b = list(b)
            b[rng.randrange(len(b))] = rng.choice(vocab)
            texts += [" ".join(b)] * rng.randint(1, 3)
    for _ in range(40):
        b = list(base[20])
        b[rng.randrange(len(b))] = rng.choice(vocab)
        texts.append(" ".join(b))
    texts += ["", None, "Same, SAME words!", "same same words"]
    got = {r.id: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    links = _links(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, out in enumerate(links):
        for j in out:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    wrong = [i for i in range(len(texts)) if got[i].n_links != len(links[i]) or got[i].class_id != root(i)]
    assert len(wrong) <= 0.02 * len(texts)  # the target recall leaves room for a pair at the threshold


def test_near_duplicates_query_against_brute_force(spark, sf_dir):
    root = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = {r.doc_id: r for r in neardup.op5_query(spark, root).collect()}
    have = defaultdict(set)  # shingle -> documents
    sets = []
    for k, (_, t) in enumerate(docs):
        w = _plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for x in sets[-1]:
            have[x].add(k)
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root_of(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in set().union(*(have[x] for x in s)) - {a} if s else ():
            n = len(s & sets[b])
            if n >= 0.8 * (len(s) + len(sets[b]) - n):
                links[a] += 1
                x, y = sorted((root_of(a), root_of(b)), key=lambda k: docs[k][0])
                parent[y] = x
    for k, (i, _) in enumerate(docs):
        assert (got[i].n_links, got[i].class_id) == (links[k], docs[root_of(k)][0]), i


def test_block_verification_against_brute_force():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(40)]
    sets += [np.unique(np.append(sets[0], k)) for k in (100, 101, 102)]
    ids, sizes = np.arange(len(sets)), rng.integers(1, 4, len(sets))
    links, forest = neardup._verify(ids, sizes, sets, None, 0.5)
    for i, a in enumerate(sets):
        near = [j for j, b in enumerate(sets) if j != i and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5]
        assert links[i] == sizes[near].sum()
    assert len(forest) < len(sets)


def test_near_duplicates_odd(odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_links for r in got if r.node is None} == {0}
    same = [r for r in got if r.id in (8, 9)]
    assert {r.class_id for r in same} == {8} and {r.n_links for r in same} == {2}
    assert neardup.near_duplicates(empty(odd)).count() == 0


def _bm25(items, segment=decontaminate.SEGMENT, k1=decontaminate.K1, b=decontaminate.B):
    """A list of (item, its words before, segment, word -> share of the segment's score for itself), by the formula."""
    import math

    cuts = []
    for k, (_, words, _) in enumerate(items):
        n = -(-len(words) // segment)
        cuts += [(k, i * len(words) // n, words[i * len(words) // n : (i + 1) * len(words) // n]) for i in range(n)]
    df = Counter(w for _, _, s in cuts for w in set(s))
    mean = sum(len(s) for _, _, s in cuts) / max(len(cuts), 1)
    out = []
    for k, before, s in cuts:
        raw = {w: math.log1p((len(cuts) - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(s) / mean)) for w, n in Counter(s).items()}
        out.append((k, before, s, {w: x / sum(raw.values()) for w, x in raw.items()}))
    return out


def test_wand_against_brute_force():
    rng = np.random.default_rng(1)
    items = [(i, rng.integers(0, 80, rng.integers(4, 60)).tolist(), 3) for i in range(60)]
    index = decontaminate.Index(items, block=4)
    brute = {(items[k][0], before): shares for k, before, _, shares in _bm25(items)}
    for _ in range(60):
        words = np.unique(rng.integers(0, 90, 40))
        codes = np.unique(index.codes(words))
        codes = codes[codes < len(index.vocab)]
        for least in (0.3, 0.55):
            _, blocks = index.bounds(codes[None, :], np.ones((1, len(codes)), bool), least)
            got = {(index.segments[s][0], index.around[s][1]): x for s, x in index.search(codes, set(blocks.tolist()), least)}
            all_blocks = {(index.segments[s][0], index.around[s][1]): x for s, x in index.search(codes, set(range(index.blocks)), least)}
            want = {at: sum(shares.get(w, 0.0) for w in words.tolist()) for at, shares in brute.items()}
            want = {at: x for at, x in want.items() if x >= least}
            assert set(got) == set(all_blocks) == set(want)
            assert all(abs(x - want[at]) < 1e-9 for at, x in got.items())


def _plain_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


@pytest.mark.parametrize("case", ["lower", "upper"])
def test_columns_that_clash(spark, sf_dir, case):
    """Columns of any name that operators use inside, or add, in either case: they pass through or are replaced, and all
    results are those without them."""
    names = """id t s w a b h p ls judged bad share host path best new rule verdict words rank key label y score clauses lang_pred margin rejected ok fed
        ids n_tokens ids_sha256 decoded shard n_bytes oversized tries depth prefix bytes gone spans hash n lines deleted n_lines n_deleted n_words word_chars n_symbols n_dup_lines n_repeat_words failed_rules lost
        kept clean_text base_failed n_failed_lines class node c x q m g i item question answer _text _w _bad _got _key _bytes _t _id _o""".split()
    names = [x.upper() if case == "upper" else x for x in names]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60).cache()
    wide = docs.select("*", *[F.lit(f"mine {x}").alias(x) for x in names])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    wide_pages = pages.select("*", *[F.lit("mine").alias(x) for x in names])
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    known = docs.filter("lang is not null")
    d = langid.learn_dictionaries(known)
    assert langid.learn_dictionaries(known.select("*", *[F.lit("mine").alias(x) for x in names])) == d
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, toxicity.SEED))
    tok = bpe.default_tokenizer()
    runs = {
        "op1": (lambda x: licenses.license_scan(x), docs, wide), "op2": (lambda x: langid.identify(x, d), docs, wide), "op3": (lambda x: decontaminate.contaminated(x, items), docs, wide),
        "op3 in place": (lambda x: decontaminate.decontaminated(x, items), docs, wide), "op4": (lambda x: urls.url_filter(x, urls.OP4_ALLOW, urls.OP4_BLOCK, entries_per_pass=3), pages, wide_pages),
        "op5": (lambda x: neardup.near_duplicates(x), docs, wide), "op6": (lambda x: toxicity.toxicity(x, g), docs, wide), "op7": (lambda x: linededup.line_dedup(x, min_words=5), docs, wide),
        "op8": (lambda x: quality.quality_rules(x), docs, wide), "op9": (lambda x: sharding.extendible_shards(x, 5000)[0], docs, wide),
        "op10": (lambda x: bpe.bpe_encode(x, tok, emit=("text", "ids", "n_tokens", "decoded", "ids_sha256")), docs, wide),
    }
    for name, (run, plain, more) in runs.items():
        want, got = run(plain), run(more)
        lower = [c.lower() for c in got.columns]
        assert len(set(lower)) == len(lower), name
        left = [x for x in names if x in got.columns and x not in want.columns]
        assert got.select(want.columns).exceptAll(want).count() == 0 == want.exceptAll(got.select(want.columns)).count(), name
        if left:
            assert got.filter(" or ".join(f"`{x}` not like 'mine%'" for x in left)).count() == 0, name
        added = {c.lower() for c in want.columns} - {c.lower() for c in plain.columns}
        if name not in ("op1", "op3", "op5"):
            assert {x.lower() for x in names} - added == {x.lower() for x in left}, name


def test_ties(spark, odd):
    """Equal scores are decided as the docstrings say."""
    same = {"b": b"words that are alike", "a": b"words that are alike"}
    assert langid.identify(odd.filter("doc_id = 8"), same).first().lang_pred == "a"
    notes = {"z": "one two three four", "y": "one two three four"}
    found = licenses.license_scan(odd.filter("doc_id = 8"), templates=notes).collect()
    assert {r.license for r in found} == {"y"}
    item = spark.createDataFrame([(1, "the first question here is long. its answer is short")], "item_id int, text string")
    twice = spark.createDataFrame([(1, "the first question here is long. its answer is short " + "x " * 300 + "the first question here is long. its answer is short")], "doc_id int, text string")
    assert [r.first_word for r in decontaminate.contaminated(twice, item).collect()] == [0]
    g = toxicity.Grammar({"ab": 2.0, "ab*": 2.0})
    assert [c[:2] for c in g.clauses("ab")] == [("insult", 2.0)]


def test_encoder_of_another_tokenizer(spark, tmp_path):
    """A worker that has one tokenizer in its memory takes another one for another call."""
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        model = json.load(f)
    model["model"]["merges"] = model["model"]["merges"][:200]
    small = tmp_path / "small.json"
    small.write_text(json.dumps(model), encoding="utf-8")
    d = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog " * 3)], "doc_id int, text string")
    tokenizers = pytest.importorskip("tokenizers")
    for path in (bpe.default_tokenizer(), str(small), bpe.default_tokenizer()):
        want = tokenizers.Tokenizer.from_file(path).encode(d.first().text, add_special_tokens=False).ids
        assert bpe.bpe_encode(d, path).first().ids == want


def _brute_decontaminate(docs, items):
    """(doc, item) -> score, by comparing every window of every text with every segment."""
    given = []
    for i, t in items:
        q, a = decontaminate.split_item(t)
        given.append((i, [*_plain_words(q), *_plain_words(a)], len(_plain_words(q))))
    segments = _bm25(given)
    by_word = defaultdict(set)
    for s, (*_, shares) in enumerate(segments):
        for w in shares:
            by_word[w].add(s)
    out = {}
    for doc, text in docs:
        words = _plain_words(text)
        stride = decontaminate.STRIDE
        for k in range(max(-(-len(words) // stride) - 1, 1) if words else 0):
            lo, hi = k * stride, min(k * stride + 2 * stride, len(words))
            here = set(words[lo:hi])
            for s in set().union(*(by_word[w] for w in here if w in by_word)):
                item, before, seg, shares = segments[s]
                if (score := sum(x for w, x in shares.items() if w in here)) < decontaminate.THRESHOLD:
                    continue
                name, all_words, q = given[item]
                after = len(all_words) - before - len(seg)
                around = words[max(lo - stride - before - before // 4, 0) : hi + stride + after + after // 4]
                n = min(decontaminate.NGRAM, len(all_words))
                grams = lambda ws: {tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)}  # noqa: B023, E731
                whole = [tuple(all_words[j : j + n]) for j in range(len(all_words) - n + 1)]
                parts = (set(whole[: max(1, q - n + 1)]) if q else set(), set(whole[min(q, len(whole) - 1) :]) if q < len(all_words) else set())
                there = grams(around)
                if all(not p or len(p & there) / len(p) >= decontaminate.OVERLAP for p in parts):
                    out[doc, name] = max(out.get((doc, name), 0.0), score)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_decontamination_query_against_brute_force(spark, sf_dir, sf):
    root = f"{sf_dir.rsplit('/', 1)[0]}/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").filter("text is not null").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.op3_query(spark, root).collect()}
    want = _brute_decontaminate(docs, items)
    assert set(got) == set(want) and all(abs(x - want[k]) < 1e-9 for k, x in got.items())


def test_decontamination_in_several_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(decontaminate.contaminated(docs, items).collect())
    assert sorted(decontaminate.contaminated(docs, items, words_per_pass=700).collect()) == one
    for words in (700, 1_000_000):
        left = decontaminate.decontaminated(docs, items, words_per_pass=words)
        assert sorted(left.collect(), key=str) == sorted(docs.join(spark.createDataFrame(sorted({(r.id,) for r in one}), "doc_id bigint"), "doc_id", "left_anti").collect(), key=str)


def test_decontamination(spark, odd):
    items = [(1, "What is the tallest mountain on the whole of planet earth today? It is mount everest in nepal."), (2, None), (3, ""), (4, "Question: name the third planet from our bright sun. Answer: the earth of course")]
    noise = " ".join(f"n{i}" for i in range(300))
    docs = [(1, f"{noise} {items[0][1]} {noise}"), (2, noise), (3, items[3][1].upper()), (4, "What is the tallest mountain on the whole of planet earth today?"), (5, None)]
    b = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), b).collect()
    assert {(r.id, r["item"]) for r in got} == {(1, 1), (3, 4)}  # a question without its answer isn't a leak
    assert decontaminate.contaminated(odd, b).count() == 0
    assert decontaminate.contaminated(empty(odd), b).count() == 0 and decontaminate.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    words = {n: [f"q{n}x{i}" for i in range(n - 20)] + [f"a{n}x{i}" for i in range(20)] for n in (48, 49, 200)}
    items = [(n, " ".join(w[: n - 20]) + ". Answer: " + " ".join(w[n - 20 :])) for n, w in words.items()]
    noise = " ".join(f"n{i}" for i in range(300))
    docs = [(n, f"{noise} {t} {noise}") for n, t in items]
    # a question, or half of it, without the answer; an answer without its question; both, but far apart
    docs += [(1000 + n, f"{noise} {' '.join(w[: n - 20])} {noise}") for n, w in words.items()]
    docs += [(2000 + n, f"{noise} {' '.join(w[: n // 2])} {noise}") for n, w in words.items()]
    docs += [(3000 + n, f"{noise} {' '.join(w[n - 20 :])} {noise}") for n, w in words.items()]
    docs += [(4000 + n, f"{' '.join(w[: n - 20])} {noise} {' '.join(w[n - 20 :])}") for n, w in words.items()]
    b = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), b).collect()
    assert {(r.id, r["item"]) for r in got} == {(n, n) for n in words}
    assert all(r.question_overlap == r.answer_overlap == 1 for r in got)


def test_decontamination_whole_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.id, r["item"]) for r in decontaminate.contaminated(docs, items).collect()}
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in (d.text or "")}
    assert want <= got


def test_licenses(spark, odd):
    noise = " ".join(f"n{i}" for i in range(200))
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge, ", "").replace("sublicense", "relicense")
    docs = [(1, f"{noise} {mit} {noise}"), (2, f"{noise}\n{edited}"), (3, noise), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (5, None)]
    got = licenses.license_scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    found = {(r.id, r.license): r for r in got}
    assert set(found) == {(1, "MIT"), (2, "MIT"), (4, "MIT-short"), (4, "CC-BY-NC-4.0")}
    assert found[1, "MIT"].coverage == 1.0 and found[1, "MIT"].first_word == 200 and 0.9 < found[2, "MIT"].coverage < 1
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty(odd)).count() == 0


def _full_table(a, b):
    """The best local alignment by the whole table: (score, matched), +2 a match, -1 a gap or a substitution."""
    best = (0, 0)
    score = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            hit = a[i - 1] == b[j - 1]
            s, k = score[i - 1][j - 1]
            here = (s + (2 if hit else -1), k + hit)
            for s, k in (score[i - 1][j], score[i][j - 1]):
                if s - 1 > here[0]:
                    here = (s - 1, k)
            score[i][j] = here if here[0] > 0 else (0, 0)
            if score[i][j][0] > best[0]:
                best = score[i][j]
    return best


def test_alignment_against_full_table():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 20))
        score, matched, first, last = licenses.align(a, b, -len(a), len(b))
        assert (score, matched) == _full_table(a.tolist(), b.tolist())
        if score:  # the span alone gives as much
            assert licenses.align(a, b[first : last + 1], -len(a), len(b))[0] == score and 0 <= first <= last < len(b)
        # a band never finds more, and one that has the best path finds it
        narrow = licenses.align(a, b, -2, 3)
        assert narrow[0] <= score


def test_short_templates(spark):
    d = spark.createDataFrame([(1, "a BSD license here and a bsd LICENSE there"), (2, "bsd"), (3, "GPL"), (4, "a gpl")], "doc_id int, text string")
    got = licenses.license_scan(d, templates={"bsd": "BSD License", "gpl": "GPL", "none": "?!"}).collect()
    assert sorted((r.id, r.license, r.first_word) for r in got) == [(1, "bsd", 1), (1, "bsd", 6), (3, "gpl", 0), (4, "gpl", 1)]
    assert all(r.coverage == 1.0 for r in got)


def _brute_licenses(docs, least=0.7):
    """(doc, license, matched words) by alignment of every template with every whole text, without fingerprints or bands."""
    code = {}
    number = lambda text: np.array([code.setdefault(w, len(code)) for w in _plain_words(text)], np.int64)
    templates = {k: number(v) for k, v in licenses.TEMPLATES.items()}
    out = set()
    for doc, text in docs:
        words, spans = number(text), []
        for name, t in templates.items():
            todo = [(0, len(words))]
            while todo:  # the best place, then what is left on both sides
                a, z = todo.pop()
                if not np.isin(words[a:z], t).any():
                    continue
                _, matched, first, last = licenses.align(t, words[a:z], -len(t), z - a)
                if matched / len(t) >= least:
                    spans.append((-matched, name, a + first, a + last))
                    todo += [(a, a + first), (a + last + 1, z)]
        taken = []
        for matched, name, first, last in sorted(spans):
            if all(last < a or first > z for a, z in taken):
                taken.append((first, last))
                out.add((doc, name, -matched))
    return out


def test_license_query_against_full_alignment(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {(r.doc_id, r.license, r.matched) for r in licenses.op1_query(spark, sf_dir).collect()}
    assert got == _brute_licenses(docs) and got
    rng = random.Random(7)
    planted = []
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        for edits in (0, 2, 8):  # words left out, put in and put for others
            words = text.split()
            for _ in range(edits if len(words) > 40 else 0):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [f"new{rng.randint(0, 99)}"]])
            planted.append((100 * k + edits, f"some words before {k} " + " ".join(words) + " and after it, " + " ".join(f"f{i}" for i in range(40))))
    found = {(r.id, r.license, r.matched) for r in licenses.license_scan(spark.createDataFrame(planted, "doc_id int, text string")).collect()}
    assert found == _brute_licenses(planted) and len({f[1] for f in found}) == len(licenses.TEMPLATES)


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 200).astype(np.uint64)
    kept = set(licenses.winnow(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197))


def test_json_of_spans(spark):
    line = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"c\n{line}\n{line}\nd")], "doc_id int, text string")
    got = {r.doc_id: r for r in linededup.line_dedup(d).collect()}
    assert json.dumps([s.asDict() for s in got[2].deleted]) == '[{"first": 1, "last": 2}]' and got[2].text == "c\nd" and got[1].n_deleted == 0
