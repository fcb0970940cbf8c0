"""The corpus pipeline: five stages, each calling one operator, written as Parquet and read again between stages.

Toxic documents go, repeated line runs are deleted, one document of each near-duplicate class stays, documents that
hold benchmark items go, and what is left is encoded with byte-level BPE. All but the last stage return the columns of
``documents``; further columns pass through them, whatever their names.

Defined results: null and empty texts pass every stage (they have no word to judge by) and are encoded as no ids; rows with
a null id are judged by their text like others; rows that agree in id and text are one document to line dedup, and one of
them stays in near duplicates; rows of one id with different texts are different documents; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import bpe, decontaminate, linededup, neardup, toxicity
from hearsay.llm.text import fresh, own
from hearsay.runtime import cut, shared_dir, table


def renamed(docs: DataFrame, *added: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with other names for columns that an operator would replace, and what gives the result their old names."""
    names = [fresh((*docs.columns, *added), c)[0] if c.lower() in added else c for c in docs.columns]
    return docs.toDF(*names), lambda out: out.select(*[own(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the rejection threshold; the grammar is learned from the labels of sf_dir."""
    grammar = toxicity.learn_from(spark, docs, sf_dir)
    docs, given = renamed(docs, "score", "clauses")
    return given(toxicity.toxicity(docs, grammar).filter(F.col("score") < toxicity.REJECT))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted and n_chars follows; a document of which nothing is left goes."""
    docs, given = renamed(docs, "n_lines", "n_deleted", "deleted")
    found = linededup.line_dedup(docs)
    some = F.col("n_deleted") > 0
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return given(found.filter(~(some & (F.col("n_deleted") == F.col("n_lines")))))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one document stays: the least id (null only if all are), of one id the least hash of the text, of equal
    texts of one id the row that comes first as JSON. Documents without words all stay."""
    classes = cut(neardup.near_duplicates(docs).filter("class is not null").select("id", "t", "class"))
    kept = classes.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("kept"))
    rows = classes.groupBy("id", "t", "class").agg(F.count("*").alias("n")).join(kept, "class")
    is_kept = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("t") == F.col("kept.t"))
    t, id_, t_, n_ = fresh(docs.columns, "t", "id", "other", "n")
    # of documents that stay and are alone in their (id, text) nothing need be known
    marks = rows.filter(~is_kept | (F.col("n") > 1)).select(F.col("id").alias(id_), F.col("t").alias(t_), F.when(is_kept, F.col("n")).otherwise(F.lit(0)).alias(n_))
    marked = docs.select(*map(own, docs.columns), F.xxhash64("text").alias(t)).join(marks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(t) == F.col(t_)), "left")
    row = F.struct(*map(own, docs.columns))
    alone = marked.filter(F.col(n_).isNull()).select(*map(own, docs.columns))
    again = marked.filter(F.col(n_) > 1).groupBy(id_, t).agg(F.min_by(row, F.to_json(row)).alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return alone.unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was verified."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of what is left."""
    return bpe.bpe_encode(docs.select("doc_id", "text"), bpe.default_tokenizer(), emit=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Grammar fitting, MinHash, BM25 and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
