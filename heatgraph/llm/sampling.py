"""Bounded samples of distinct texts, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(rows: DataFrame, most: int | None, by: list[str] | None = None) -> DataFrame:
    """Distinct rows of ``rows(text, by...)``, about ``most`` for each value of ``by``, with ``times`` and ``place``.

    A text's place is a hash of it, and the texts with the lowest places are taken, so copies come in once, with their
    number in ``times``, however many rows they hold. The share follows an estimate of the distinct texts (within some
    hundredths); ``orderBy("place").limit(n)`` makes the bound exact. Equal texts with different ``by`` are different
    rows. Null texts are one text. Without ``most`` all distinct rows are taken.
    """
    by = by or []
    marked = rows.select("text", *by, F.xxhash64("text").alias("place"))
    if most is None:
        return marked.groupBy("place", *by).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    known = marked.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.approx_count_distinct("place", 0.01).alias("__n"))
    wide = float(1 << 30)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    if by:
        marked = marked.join(F.broadcast(known), same)  # one small row for each value of by
    else:
        marked = marked.withColumn("__n", F.lit(known.first()[0]))
    chosen = marked.filter(F.pmod("place", F.lit(1 << 30)) < F.greatest(F.lit(1.0), F.lit(float(most)) / F.greatest("__n", F.lit(1)) * wide))
    return chosen.groupBy("place", *by).agg(F.first("text").alias("text"), F.count("*").alias("times"))
