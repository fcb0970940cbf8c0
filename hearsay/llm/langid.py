"""Language identification by compression: the language whose zstandard raw-content dictionary encodes a text smallest.

A dictionary is made of whole lower-cased texts of one language, as many of a bounded sample of labelled rows as fit. Every whole text is encoded, in
blocks, once with each dictionary; the smallest sum of sizes wins. A narrow margin to the second is a rejection.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the label that sorts
first; repeated rows are judged one by one; with no labelled row every text is ``und``; other columns pass through
(those named like an added column are replaced); rows with a null label or without a letter are never learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearsay.llm.sample import held_out, per_class
from hearsay.llm.text import fresh, own, without

UND = "und"


def learn_dictionaries(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", texts_per_label: int = 150, sample_bytes: int = 8000, dictionary_bytes: int = 110_000) -> dict[str, bytes]:
    """Label -> dictionary content: whole texts of a bounded sample, as many as fit.

    The sample is at most ``texts_per_label`` texts of each label, those of up to ``sample_bytes`` bytes before longer
    ones, so that a dictionary has many texts in it. A label that has but texts beyond the dictionary's size gets the
    end of one.
    """
    size = F.octet_length(own(text))
    good = rows.filter(own(label).isNotNull() & own(text).rlike(r"\p{L}")).select(own(key).alias("key"), own(label).alias("label"), (size > sample_bytes).alias("long"), own(text).alias("text"))
    short = per_class(good.filter("not long"), "label", "key", texts_per_label)
    # labels of too few short texts also take long ones; none is collected beyond what a dictionary can hold
    long = per_class(good.filter("long"), "label", "key", max(1, texts_per_label // 10))
    picked = short.unionByName(long).select("label", "long", F.xxhash64("key").alias("h"), F.substring("text", -dictionary_bytes, dictionary_bytes).alias("t"))
    found: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.label, r.long, r.h, r.t)):  # bounded by the parameters
        t = r.t.lower().encode()
        left = room.setdefault(r.label, dictionary_bytes)
        if len(t) < left:
            found.setdefault(r.label, []).append(t)
            room[r.label] = left - len(t) - 1
        elif r.label not in found:
            found[r.label], room[r.label] = [t[-dictionary_bytes:]], 0
    # the end of a dictionary is cheapest to refer to
    return {lab: b"\n".join(parts) for lab, parts in found.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 9, block_bytes: int = 1 << 15, min_margin: float = 0.01) -> DataFrame:
    """Add lang_pred (best label), score (0 to 1), margin (by which the second is larger) and rejected."""
    spark = docs.sparkSession
    added = ("lang_pred", "score", "margin", "rejected")
    docs = without(docs, added, (text,))
    shared = spark.sparkContext.broadcast(dict(sorted(dictionaries.items())))
    keep = [c for c in docs.columns if c != text]
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    fed_ = fresh(docs.columns, "text", "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        coders = []
        for lab, content in shared.value.items():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append((lab, zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False).compress))
        for b in batches:
            out = [judge(t, coders) if ok else (UND, 0.0, 0.0, True) for t, ok in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True)]
            cols = [b.column(i) for i in range(b.num_columns - 2)]
            for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())):
                cols.append(pa.array([x[k] for x in out], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    def judge(t: str, coders: list) -> tuple[str, float, float, bool]:
        raw = t.lower().encode()
        blocks = [raw] if len(raw) <= block_bytes else [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
        sizes = [(sum(len(c(x)) for x in blocks), lab) for lab, c in coders]
        if not sizes:
            return UND, 0.0, 0.0, True
        best, lab = min(sizes)
        rest = [s for s, other in sizes if other != lab]
        margin = (min(rest) - best) / best if rest else 1.0
        score = 1 / (1 + sum(math.exp(-0.1 * (s - best)) for s in rest))
        return lab, score, margin, margin < min_margin

    fed = docs.select(*map(own, keep), F.coalesce(own(text), F.lit("")).alias(fed_[0]), F.coalesce(own(text).rlike(r"\p{L}"), F.lit(False)).alias(fed_[1]))
    return fed.mapInArrow(run, schema)


def op2_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.filter(~held_out("doc_id")))
    fed = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(fed, dictionaries).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
