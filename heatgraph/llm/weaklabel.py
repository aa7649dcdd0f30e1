"""Quality classifier: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from heatgraph.llm.quality import COUNTS, count_features, with_counts
from heatgraph.llm.sampling import sample_texts
from heatgraph.llm.textops import flat, slices

#: Labellers over rates: more than the value votes for bad, otherwise they don't vote. Each knows one kind of bad text, so
#: its silence says little.
BANDS = {"symbols": 0.1, "marks": 0.15, "capitals": 0.3, "dup_lines": 0.5, "repeats": 0.3, "stutters": 0.2}
LABELLERS = [*BANDS, "length", "word_length"]
DIMS = 1024
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 11, 12, 13]] = 32


def shares() -> dict[str, Column]:
    """The shares that BANDS look at, of a row of COUNTS; 0 for an empty text."""
    # 40 characters at least, so that a full stop doesn't mark a word or two as noise
    words, chars, lines = (F.greatest(F.col(c), F.lit(n)).cast("double") for c, n in (("n_words", 1), ("word_chars", 40), ("n_lines", 1)))
    over = {"symbols": words, "marks": chars, "capitals": chars, "dup_lines": lines, "repeats": words, "stutters": words}
    return {k: F.col("n_repeat_words" if k == "repeats" else f"n_{k}") / over[k] for k in BANDS}


def votes() -> Column:
    """The labellers' votes on a row of COUNTS, in order: 1 good, -1 bad, 0 none."""
    found = shares()
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    banded = [vote(F.lit(False), found[k] > high) for k, high in BANDS.items()]
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return F.array(*banded, vote(F.col("n_words") >= 50, F.col("n_words") < 1), vote(length.between(3.5, 9), ~length.between(2, 16)))


@dataclass(frozen=True)
class Labellers:
    """P(good), and P(vote | bad or good) of each labeller, by vote -1, 0, 1."""

    prior: float
    table: np.ndarray  # (2, labellers, 3)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        at = patterns + 1
        logs = [np.log(p) + np.log(t)[np.arange(t.shape[0]), at].sum(1) for p, t in zip((1 - self.prior, self.prior), self.table, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller that votes is right."""
        p = np.array([1 - self.prior, self.prior])[:, None]
        right = p[0] * self.table[0, :, 0] + p[1] * self.table[1, :, 2]
        return dict(zip(LABELLERS, right / (p[:, :, None] * self.table[:, :, ::2]).sum((0, 2)), strict=True))


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 200) -> Labellers:
    """Expectation-maximisation over distinct vote patterns and how many rows have each.

    Starts with labellers that are right more often than not and a small count for every vote, so the classes keep their
    meaning; without rows these starting values are the result.
    """
    n = patterns.shape[1]
    table = np.tile(np.array([[0.3, 0.6, 0.1], [0.02, 0.68, 0.3]])[:, None, :], (1, n, 1))
    model = Labellers(0.8, table)
    hot = (patterns[:, :, None] + 1 == np.arange(3)).astype(np.float64)
    for _ in range(rounds if len(times) else 0):
        good = model.posterior(patterns)
        both = np.stack([(1 - good) * times, good * times])
        counts = np.einsum("cp,pnv->cnv", both, hot) + 1.0 * table
        new = Labellers(float((both[1].sum() + 0.8) / (times.sum() + 1)), counts / counts.sum(2, keepdims=True))
        moved = np.abs(new.table - model.table).max()
        model = new
        if moved < 1e-9:
            break
    return model


def fit_labellers(counted: DataFrame) -> Labellers:
    """Estimates over all rows: what is gathered is a count for each pattern, at most 3 ** 8 of them."""
    rows = counted.groupBy(votes().alias("v")).count().collect()
    rows.sort(key=lambda r: r["v"])
    return estimate(np.array([r["v"] for r in rows], np.int64).reshape(-1, len(LABELLERS)), np.array([r["count"] for r in rows], np.float64))


def features(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed shape n-grams (1 to 4 marks) of one text.

    The shape has one mark for each run of small letters, capitals or digits, and other ASCII characters as they are; a
    word equal to the one before has a mark of its own.
    """
    x = _SHAPE[raw]
    out = np.zeros(DIMS)
    if not len(x):
        return out
    edge = np.ones(len(x), bool)
    edge[1:] = (x[1:] != x[:-1]) | ~np.isin(x[1:], np.frombuffer(b"aA0", np.uint8))
    s = x[edge].astype(np.uint64)
    words = raw.tobytes().split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    key, total = s, 0
    for n in range(1, 5):
        if n > 1:
            key = key[:-1] << np.uint64(8) | s[n - 1 :]
        if not len(key):
            break
        h = (key + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)
        out += np.bincount(h.astype(np.int64), minlength=DIMS)
        total += len(key)
    out /= total
    out[0] += again / max(1, len(words))
    return np.sqrt(out)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float


def fit_scorer(docs: DataFrame, model: Labellers, most_rows: int = 20_000) -> Scorer:
    """A logistic fit of ``features`` to the posterior labels of ``docs(text)``.

    It takes distinct texts, each with the weight of its number of rows: all of them, or of more the ``most_rows`` with the
    lowest hash. That is the only bound, on rows for fitting (2 KB each on the driver), and it holds however many
    rows are copies, empty or null (an empty text). Steps are full-batch and in a fixed order of rows.
    """
    some = sample_texts(docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")), most_rows)
    some = with_counts(some, ["text", "times", "place"]).select("text", "times", "place", votes().alias("v")).orderBy("place").limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            found = [features(raw[a:b]).astype("<f2").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("v"), batch.column("times"), batch.column("place")], names=["x", "v", "times", "place"])

    got = some.mapInArrow(run, "x binary, v array<int>, times long, place long").toArrow().sort_by("place")
    if not len(got):
        return Scorer(np.zeros(DIMS), float(np.log(model.prior / (1 - model.prior))))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f2").reshape(-1, DIMS).astype(np.float32)
    y = model.posterior(np.array(got.column("v").to_pylist(), np.int64))
    return fit_logistic(x, y, got.column("times").to_numpy())


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 400) -> Scorer:
    """Weights that minimise the logistic loss of rows ``x`` to labels from 0 to 1, each counted ``times``."""
    share = times / times.sum()
    w, bias, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -50, 50)))
        g = (p - y) * share
        grad = np.append(x.T @ g.astype(np.float32) + 1e-6 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.3 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Scorer(w, float(bias))


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, COUNTS and ``quality_score`` (0 to 1) of each row, from one look at its text; null and empty texts get the bias."""
    work = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                raw, offsets = flat(part.column("__text"))
                counts = count_features(raw, offsets)
                z = np.array([features(raw[a:b]) @ scorer.weights for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.float64) + scorer.bias
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[*keep, *COUNTS, "quality_score"])

    return work.mapInArrow(run, StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS] + [StructField("quality_score", DoubleType())]))


def weak_label_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_votes, n_bad_votes, posterior, score, kept`` for each row of ``docs(doc_id, text)``.

    ``posterior`` is P(good) from the votes alone, ``score`` the scorer's; a row is kept at a score of 0.5 or more.
    Repeated rows get equal values. A null text is empty: its votes are those of an empty document. Texts are read three
    times: for the counts of vote patterns, for their hashes and the sample, and for votes and scores.
    """
    model = fit_labellers(with_counts(docs.select("text"), []))
    scorer = fit_scorer(docs, model)
    logs = np.log(model.table)
    weight = lambda c: F.aggregate(F.zip_with(F.col("v"), F.array(*(F.array(*map(F.lit, row.tolist())) for row in logs[c])), lambda v, row: F.get(row, v + 1)), F.lit(0.0), lambda a, b: a + b)
    odds = weight(1) - weight(0) + float(np.log(model.prior / (1 - model.prior)))
    found = score(docs, scorer, ["doc_id"]).select("doc_id", "quality_score", votes().alias("v"))
    counts = [F.size(F.filter("v", lambda x: x != 0)).alias("n_votes"), F.size(F.filter("v", lambda x: x < 0)).alias("n_bad_votes")]
    return found.select("doc_id", *counts, (1 / (1 + F.exp(-odds))).alias("posterior"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


__all__ = ["BANDS", "COUNTS", "LABELLERS", "Labellers", "Scorer", "estimate", "features", "fit_labellers", "fit_logistic", "fit_scorer", "score", "votes", "weak_label_report"]
