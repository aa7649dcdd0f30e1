"""Vector algebra and the hashing embedder, as columns."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarities are compared at this many digits, so that ties don't depend on the order of a sum.
DIGITS = 9


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision, in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    """The root of the sum of squares."""
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """A zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    n = l2_norm(v)
    # repeated, the norm is worked out once; named in a lambda it would be for every number
    return F.zip_with(v, F.array_repeat(F.when(n == 0, F.lit(1.0)).otherwise(n), F.size(v)), lambda x, m: x.cast("double") / m)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of unit vectors, cut to 0..1."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b))), DIGITS)


def words(text: Column | str) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def hash_embed(rows: DataFrame, key: str = "id", text: str = "text", dims: int = 64) -> DataFrame:
    """``key, vector`` for each key: unit counts of its words by MD5 modulo ``dims`` (a power of two up to 256).

    Words are counted where their text is, and only the counts are shuffled, after sums in each task. A text without words has
    a zero vector; rows that share a key are one text.
    """
    work = rows.select(F.col(key).alias("key"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            found = np.zeros((len(batch), dims), np.int64)
            for i, t in enumerate(batch.column("t")):
                buckets = []  # what is known may be forgotten within a text
                for w in (t.as_py() or "").lower().split():
                    b = known.get(w)
                    if b is None:
                        if len(known) > 500_000:
                            known.clear()
                        b = known[w] = md5(w.encode("utf-8", "surrogatepass")).digest()[-1] % dims
                    buckets.append(b)
                if buckets:
                    found[i] = np.bincount(buckets, minlength=dims)
            offsets = np.arange(0, dims * (len(batch) + 1), dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=["key", "n"])

    counted = work.mapInArrow(count, f"key {work.schema['key'].dataType.simpleString()}, n array<long>")
    sums = F.array(*(F.sum(F.get("n", F.lit(i))) for i in range(dims)))
    return counted.groupBy("key").agg(sums.alias("v")).select(F.col("key").alias(key), l2_normalize("v").alias("vector"))
