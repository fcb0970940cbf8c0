"""Held-out split and bounded, reproducible samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.llm.text import fresh


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def per_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """Up to ``most`` rows of each label, those with the smallest hash of ``key``. Labels are counted first, so that
    about twice as many rows as are needed, not all of a frequent label, are ranked."""
    counts = rows.groupBy(label).count().collect()  # one row for each label
    mark = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    passes = F.lit(False)
    for value, n in counts:
        # the share that holds `most` rows with room for chance
        share = min(1.0, (2 * most + 50) / n)
        passes = passes | (F.col(label).eqNullSafe(F.lit(value)) & (mark < int(share * (1 << 30))))
    (rank,) = fresh(rows.columns, "rank")
    ranked = rows.filter(passes).withColumn(rank, F.row_number().over(Window.partitionBy(label).orderBy(mark, key)))
    return ranked.filter(F.col(rank) <= most).drop(rank)
