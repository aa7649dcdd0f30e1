"""Mixing sources to target weights: Poisson replication with hash-seeded draws, then a global shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources the rates are sent to every task; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Up to this rate the distribution is summed from zero; beyond, from far below the mean, as exp(-rate) leaves the doubles.
DIRECT_RATE = 256.0
#: ``epochs`` may not be higher. A bound on the argument alone: rates that follow from the data have none.
MOST_EPOCHS = 256.0
#: Copies that one row is exploded into at a time.
_BLOCK = 4096


def uniform(seed: int, what: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of ``seed|what|keys``."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), *keys)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability at mean ``rate`` exceeds ``u``: inverts the distribution.

    The k-th step folds one term into the sum; the number of steps covers the mean by more than 12 deviations, beyond
    what a 52-bit ``u`` can reach. A rate over DIRECT_RATE takes the same k from terms that begin 12 deviations below the
    mean, so its steps grow with the root of the rate.
    """
    return F.when(rate <= DIRECT_RATE, _from_zero(u, rate).cast("long")).otherwise(_from_below(u, rate))


def _from_zero(u: Column, rate: Column) -> Column:
    rate = F.least(rate, F.lit(DIRECT_RATE))
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int"))
    p0 = F.exp(-rate)
    zero = F.struct(p0.alias("p"), p0.alias("total"), F.when(u < p0, F.lit(0)).otherwise(F.lit(None).cast("int")).alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"), F.coalesce(s["k"], F.when(u < s["total"] + p, k)).alias("k"))

    return F.aggregate(steps, zero, step, lambda s: F.coalesce(s["k"], F.element_at(steps, -1)))


def _from_below(u: Column, rate: Column) -> Column:
    """Terms relative to the first one, which is 1: the largest is below 1e70. Their sum stands for the whole probability."""
    rate = F.greatest(rate, F.lit(DIRECT_RATE))
    wide = 12 * F.sqrt(rate) + 24
    low = F.floor(rate - wide).cast("long")
    steps = F.sequence(low + 1, F.ceil(rate + wide).cast("long"))
    one = F.lit(1.0)

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"))

    whole = F.aggregate(steps, F.struct(one.alias("p"), one.alias("total")), add, lambda s: s["total"])
    zero = F.struct(one.alias("p"), one.alias("total"), (u * whole).alias("goal"), F.lit(None).cast("long").alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"), s["goal"].alias("goal"), F.coalesce(s["k"], F.when(s["goal"] < s["total"] + p, k)).alias("k"))

    return F.aggregate(steps, zero, step, lambda s: F.coalesce(s["k"], F.element_at(steps, -1)))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, source: str = "source", size: Column | None = None) -> DataFrame:
    """``source, rate``: how often each document of a source is wanted on average.

    A source's share of all wanted size is its weight over the sum of the weights of the sources that occur; sources
    without a weight count 1 if no weights are given and 0 otherwise. All wanted size is ``epochs`` times the size of the
    input, by default in code points. A source whose rows are all empty is wanted ``epochs`` times.
    """
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        weight = F.coalesce(F.try_element_at(table, "source"), F.lit(0.0)) if weights else F.lit(0.0)
    totals = sizes.agg(F.sum("size").alias("all"), F.sum(weight).alias("w"))
    want = F.lit(float(epochs)) * F.col("all") * weight / F.when(F.col("w") > 0, F.col("w"))
    rate = F.when(F.col("size") > 0, want / F.col("size")).otherwise(F.lit(float(epochs)))
    return sizes.crossJoin(F.broadcast(totals)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 11, source: str = "source", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, in a random order over all partitions.

    Adds ``mix_copy`` (from 1), ``mix_rate`` and ``mix_order`` (sorted within partitions; the partition is a hash of it),
    replacing columns of these names. The draw depends on ``seed``, ``doc_id`` and the text, so repeated rows have the
    same count and a run can be repeated exactly. A null source is a source of its own; null and empty texts are drawn
    like others. However rare a source is, its rows are drawn at its whole rate; only ``epochs`` over MOST_EPOCHS is an error.

    Only (source, size) sums are shuffled before the draw; the rates are sent to every task after their number has been
    counted, and joined by a shuffle otherwise, which skew handling splits. Copies are dealt by a hash of their own, so a
    source with a third of all rows is spread evenly. A row wanted more than _BLOCK times is dealt in blocks of copies
    before they are exploded, so no task makes all copies of one row.
    """
    if epochs > MOST_EPOCHS:
        raise ValueError(f"all documents would be repeated {epochs:.0f} times; the most is {MOST_EPOCHS:.0f}")
    docs = docs.drop("mix_copy", "mix_rate", "mix_order")
    rates = source_rates(docs, weights, epochs, source).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    count, most = rates.agg(F.count("*"), F.max("__rate")).first()
    rates = F.broadcast(rates) if count <= BROADCAST_SOURCES else rates
    named = docs.join(rates, F.col(f"`{source}`").eqNullSafe(F.col("__source"))).drop("__source")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))))
    drawn = named.withColumn("__n", poisson(uniform(seed, "n", key), F.col("__rate")))
    drawn = drawn.filter("__n > 0")
    if most is not None and most > DIRECT_RATE:
        blocks = drawn.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), "__n", F.lit(_BLOCK).cast("long"))))
        large = blocks.filter(F.col("__n") > _BLOCK)
        large = large.repartition(partitions, F.xxhash64(key, "__from")) if partitions else large.repartition(F.xxhash64(key, "__from"))
        drawn = blocks.filter(F.col("__n") <= _BLOCK).unionByName(large).withColumn("__n", F.least("__n", F.col("__from") + (_BLOCK - 1)))
    else:
        drawn = drawn.withColumn("__from", F.lit(1).cast("long"))
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence("__from", "__n"))).withColumn("mix_copy", F.col("mix_copy").cast("int")).drop("__n", "__from")
    copies = copies.withColumn("mix_order", uniform(seed, "at", key, F.col("mix_copy").cast("string"))).withColumnRenamed("__rate", "mix_rate")
    place = F.xxhash64("mix_order")
    dealt = copies.repartition(partitions, place) if partitions else copies.repartition(place)
    return dealt.sortWithinPartitions("mix_order")


def mix_report(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """One row for each copy: ``doc_id, text, source, mix_copy, mix_rate, mix_order``, rates to 9 digits."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"), weights, epochs, seed)
    return mixed.withColumn("mix_rate", F.round("mix_rate", 9))


def mix_sql(epochs: float = 1.0, seed: int = 11) -> str:
    """The rows of ``mix_report`` with equal weights, for DuckDB."""
    u = lambda what, extra="": f"CAST(('0x' || substr(md5('{seed}|{what}|' || k{extra}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0"
    return f"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN {epochs}::DOUBLE * (SELECT sum(size) FROM sizes) * 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE / size ELSE {epochs}::DOUBLE END AS rate FROM sizes),
keyed AS (SELECT d.doc_id, d.text, d.source, r.rate, coalesce(d.doc_id::VARCHAR, '-') || ':' || md5(coalesce(d.text, '')) AS k
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (SELECT source, rate, 0 AS n, exp(-rate) AS p, exp(-rate) AS total FROM rates
  UNION ALL SELECT source, rate, n + 1, p * rate / (n + 1), total + p * rate / (n + 1) FROM terms WHERE n < ceil(rate + 12 * sqrt(rate) + 24)),
drawn AS (SELECT k.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM k.source AND t.total <= k.u) AS n
  FROM (SELECT *, {u("n")} AS u FROM keyed) k)
SELECT doc_id, text, source, copy::INTEGER AS mix_copy, round(rate, 9) AS mix_rate, {u("at", " || '|' || copy")} AS mix_order
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
"""
