"""Quality rules, line first, in DataFrame functions only.

Every line is judged by itself: punctuation, navigation, boilerplate (a phrase of page furniture in a line of at most
``BOILERPLATE_LINE`` characters; a paragraph that has one stays), symbols, capitals, repetition. Failing lines go; a
document that loses more than ``max_lost`` of its characters, or fails the base rules, is rejected.

Defined results: a null or empty text has no words and no lines, so it fails the base rules (fewer than
``min_words``); blank lines never fail; of several rules that a line fails the first one is named; repeated rows are
judged one by one; other columns of the input pass through (a column of the same name as one that is added is
replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import fresh, own, space_words, without

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture in English, French, German and Spanish, lower case. Fixed values.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "accept cookies",
    "click here", "read more", "sign up for our newsletter", "subscribe to our", "share on facebook", "share on twitter", "lorem ipsum",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "accepter les cookies", "cliquez ici", "lire la suite", "abonnez-vous à",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "klicken sie hier", "weiterlesen", "newsletter abonnieren",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies", "haga clic aquí", "leer más", "suscríbete a",
)
#: Characters of a line from which on such a phrase is taken as part of a paragraph, which stays.
BOILERPLATE_LINE = 200


def _one_of(phrases: tuple[str, ...]) -> str:
    """A pattern of the phrases, by first letter, so that most places of a text are ruled out at once."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        by.setdefault(p[0], []).append(p[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ")"


def _count(text: Column, keep: str) -> Column:
    """Characters of ``text`` left when everything but the class ``keep`` goes."""
    return F.length(F.regexp_replace(text, f"[^{keep}]++", ""))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    docs = without(docs, BASE, (text,))
    w, ls, h, s, p = fresh((*docs.columns, *BASE), "w", "ls", "h", "s", "p")
    t = F.coalesce(own(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn(w, space_words(own(text))).withColumn(ls, lines)
    n = F.size(w)
    # 64 hash bits of each 3-word window; windows of one document only are compared, with their first words.
    d = d.withColumn(h, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    d = d.withColumn(s, F.when(twice, F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), F.get(w, i).alias("w"), i.alias("i"))))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))

    found = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    d = d.withColumn(p, F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(F.transform(p, lambda q, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - q, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return d.select(
        *map(own, docs.columns),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_fails(line: Column, words: Column) -> Column:
    """The rule that a line of ``words`` words fails, or null. Lines without a word pass.

    Spark interprets it once for each line, so what is cheap and rarely true comes first in each condition.
    """
    letters, capitals = _count(line, r"\p{L}"), _count(line, r"\p{Lu}")
    distinct = F.size(F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))))
    bars = _count(line, "|»›•·")
    return (
        F.when(words == 0, F.lit(None).cast("string"))
        .when((bars >= 3) & (bars * 4 >= words), "navigation")
        .when(_count(line, "#*$%&<>") * 2 > words, "symbols")
        .when((words >= 8) & ~line.rlike(r"[.!?,;:…。！？]"), "punctuation")
        .when((capitals > 12) & (letters >= 20) & (capitals * 10 > letters * 6), "capitals")  # 0.6 of 20 letters are 12
        .when((words >= 10) & (distinct * 4 < words), "repetition")
        .when((F.length(line) <= BOILERPLATE_LINE) & F.lower(line).rlike(_one_of(BOILERPLATE)), "boilerplate")
    )


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_lost: float = 0.3) -> DataFrame:
    """Judge and clean each document.

    Adds the base columns, n_lines, n_failed_lines, failed_rules (which rules hit), lost (share of characters in
    failed lines), base_failed, kept and clean_text. Nothing is shuffled: one pass, whole texts.
    """
    added = (*BASE, "n_lines", "n_failed_lines", "failed_rules", "lost", "base_failed", "kept", "clean_text")
    docs = without(docs, added, (text,))
    judged, bad, share = fresh((*docs.columns, *added), "judged", "bad", "share")
    d = base_columns(docs, text)
    t = F.coalesce(own(text), F.lit(""))
    counted = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    d = d.withColumn(judged, F.transform(counted, lambda x: F.struct(x["line"].alias("line"), line_fails(x["line"], x["n"]).alias("rule"))))
    d = d.withColumn(bad, F.filter(judged, lambda x: x["rule"].isNotNull()))
    d = d.withColumn(share, F.aggregate(bad, F.lit(0), lambda a, x: a + F.length(x["line"])) / F.greatest(F.length(t), F.lit(1)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"))
    return d.select(
        *map(own, docs.columns), *BASE,
        F.size(judged).cast("long").alias("n_lines"),
        F.size(bad).cast("long").alias("n_failed_lines"),
        F.array_sort(F.array_distinct(F.transform(bad, lambda x: x["rule"]))).alias("failed_rules"),
        F.col(share).alias("lost"),
        base.alias("base_failed"),
        (~base & (F.col(share) <= max_lost)).alias("kept"),
        F.array_join(F.transform(F.filter(judged, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )


def op8_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost", "kept"
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM v WHERE c IS NOT NULL),
q AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT doc_id, x, length(x) AS len, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw, len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS nd,
  length(regexp_replace(x, '[^|»›•·]+', '', 'g')) AS bars, length(regexp_replace(x, '[^#*$%&<>]+', '', 'g')) AS sym,
  length(regexp_replace(x, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(x, '\P{Lu}+', '', 'g')) AS caps FROM l),
f AS (SELECT *, CASE WHEN nw = 0 THEN false WHEN bars >= 3 AND bars * 4 >= nw THEN true WHEN sym * 2 > nw THEN true
  WHEN nw >= 8 AND NOT regexp_matches(x, '[.!?,;:…。！？]') THEN true WHEN letters >= 20 AND caps * 10 > letters * 6 THEN true
  WHEN nw >= 10 AND nd * 4 < nw THEN true WHEN len <= @LONG@ AND regexp_matches(lower(x), '@BOILER@') THEN true ELSE false END AS bad FROM m),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(len) FILTER (bad), 0) AS lost_chars,
  count(*) FILTER (nw > 0) - count(DISTINCT x) FILTER (nw > 0) AS n_dup_lines FROM f GROUP BY doc_id),
h AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS wc,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(g.n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(coalesce(q.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(g.n_lines AS BIGINT) AS n_lines, CAST(g.n_failed_lines AS BIGINT) AS n_failed_lines,
  CAST(g.lost_chars AS DOUBLE) / greatest(length(t), 1) AS lost FROM w JOIN g USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_lines, n_failed_lines, lost, (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3) AS kept FROM h
""".replace("@BOILER@", "|".join(b.replace("'", "''") for b in BOILERPLATE)).replace("@LONG@", str(BOILERPLATE_LINE))
