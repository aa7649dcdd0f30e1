"""Quality rules with thresholds from mergeable quantile sketches for each language and source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heatgraph.checkpoints import cut
from heatgraph.llm.textops import IS_SPACE, Words, covered, flat, mix, slices, whole, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_stutters"]


def _sums(on: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(on)])[offsets])


def count_features(raw: np.ndarray, offsets: np.ndarray, width: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of a run of texts, as UTF-8 bytes: characters are code points, words the runs without ASCII white space.

    n_marks are ASCII punctuation, n_capitals A to Z, n_stutters the words equal to the one before. n_lines are the lines with a word, n_dup_lines those of them that equal an earlier one, n_repeat_words the words in
    windows of ``width`` words that occur at least twice in their text.
    """
    words = Words(raw, offsets)
    out = {"n_words": words.counts(), "word_chars": _sums(~IS_SPACE[raw] & (raw & 0xC0 != 0x80), offsets)}
    out |= {"n_symbols": _sums(_SYMBOL[raw], offsets), "n_marks": _sums(_MARK[raw], offsets), "n_capitals": _sums(_CAPITAL[raw], offsets)}
    lines, twice, data = [], [], raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines.append(len(own))
        twice.append(len(own) - len(set(own)))
    out |= {"n_lines": np.array(lines, np.int64), "n_dup_lines": np.array(twice, np.int64)}
    hashes, of = words.hashes(), words.text_of()
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out["n_stutters"] = np.diff(np.concatenate([[0], np.cumsum(again)])[words.first])
    key = windows(hashes, width)
    at = np.flatnonzero(whole(words, width))
    begins = np.zeros(len(words), bool)
    if len(at):
        key = key[at] ^ mix(of[at].astype(np.uint64), 5)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        begins[at[order[1:][same]]] = True
        begins[at[order[:-1][same]]] = True
    repeated = covered(begins, width) if len(words) else begins
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(repeated)])[words.first])
    return out


def with_counts(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and COUNTS of its texts; columns of those names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    work = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = count_features(*flat(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*keep, *COUNTS])

    return work.mapInArrow(run, StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS]))


@dataclass(frozen=True)
class Rules:
    """A document fails where a rate lies too far above the upper quartile of its language and source.

    Rates are compared by their logarithm, in buckets of ratio ``gamma`` (values within 1 % of the truth). The threshold
    is the group's upper quartile and ``reach`` distances between its quartiles (3: the usual outer fence); where a language or the whole corpus
    spreads more than the group, theirs is taken, so a group that is mostly copies of one text doesn't fail the rest of
    its rows. Groups with fewer than ``least_rows`` rows use the quartiles of their language, or of all rows if that has
    too few as well. No threshold is a constant: every one comes from the sketches.
    """

    reach: float = 3.0
    gamma: float = 1.02
    least_rows: int = 200


#: Rates as (name, count, what it is counted over). One is added to both, so that texts without any have a rate as well, which falls
#: with their length; that is what makes the quartiles of rare things differ from zero.
RATES = (
    ("symbols", "n_symbols", "n_words"),
    ("marks", "n_marks", "word_chars"),
    ("capitals", "n_capitals", "word_chars"),
    ("stutters", "n_stutters", "n_words"),
    ("long_words", "word_chars", "n_words"),
    ("short_words", "n_words", "word_chars"),
)


def rates() -> dict[str, Column]:
    """The rates of a row of COUNTS, all above zero."""
    return {k: (F.col(a) + 1).cast("double") / (F.col(b) + 1).cast("double") for k, a, b in RATES}


def _buckets(rules: Rules) -> dict[str, Column]:
    step = float(np.log(rules.gamma))
    return {k: F.ceil(F.ln(v) / step) for k, v in rates().items()}


def sketch(counted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``lang, source, rate, bucket, n``: how many rows of a group have a rate in a bucket.

    Adding the counts of two sketches gives the sketch of the union, in any order. Null languages and sources are groups
    of their own.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("bucket")) for k, v in _buckets(rules).items()))
    return counted.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets of both quartiles of each group of ``keys`` and rate, and its rows."""
    merged = counts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rate")
    run = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("rows", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    return run.groupBy(*keys, "rate").agg(F.max("rows").alias("rows"), at(0.25).alias("low"), at(0.75).alias("high"))


def thresholds(own: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``lang, source`` and the highest bucket allowed of each rate, from the ``sketch`` rows ``own``.

    The sketch is merged upwards; what it holds is bounded by groups, rates and buckets, not by rows.
    """
    levels = [_quartiles(own, keys) for keys in (["lang", "source"], ["lang"], [])]
    named = [q.select(*[F.col(k).alias(f"{k}{i}") for k in q.columns]) for i, q in enumerate(levels)]
    both = named[0].join(named[1], F.col("lang0").eqNullSafe(F.col("lang1")) & (F.col("rate0") == F.col("rate1"))).join(named[2], F.col("rate0") == F.col("rate2"))
    enough = [F.col(f"rows{n}") >= rules.least_rows for n in range(2)]
    high = F.when(enough[0], F.col("high0")).when(enough[1], F.col("high1")).otherwise(F.col("high2"))
    spread = [F.col(f"high{n}") - F.col(f"low{n}") for n in range(3)]
    wide = F.greatest(F.when(enough[0], spread[0]), F.when(enough[1], spread[1]), spread[2])
    flat = both.select(F.col("lang0").alias("lang"), F.col("source0").alias("source"), F.col("rate0").alias("rate"), (high + rules.reach * wide).alias("most"))
    return flat.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, F.col("most"))).alias(f"most_{k}") for k, *_ in RATES))


def judge(counted: DataFrame, rules: Rules = Rules(), most_groups: int = 20_000) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``: not failed, and no rate above its group's threshold.

    The sketch, small rows, is written once; it gives the thresholds and the number of groups. The thresholds are joined
    on language and source: sent to every task up to ``most_groups`` groups (some 100 bytes each); beyond, joined by a
    shuffle of the small rows, which skew handling splits.
    """
    own = cut(sketch(counted, rules))
    limits = thresholds(own, rules)
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in limits.columns if c.startswith("most_")])
    groups = own.select("lang", "source").distinct().count()
    limits = F.broadcast(limits) if groups <= most_groups else limits
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = ~failed
    for k, v in _buckets(rules).items():
        good = good & (v <= F.col(f"most_{k}"))
    return joined.withColumns({"base_failed": failed, "kept": good}).drop("__lang", "__source", *[f"most_{k}" for k, *_ in RATES])


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang, source)``; a null text counts as empty, and so fails.

    Texts are read once: their counts go to the shared checkpoint folder, and all else works on these small rows.
    """
    counted = cut(with_counts(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"]))
    return judge(counted, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")
