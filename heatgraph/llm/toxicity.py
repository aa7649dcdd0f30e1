"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from heatgraph.llm.langid import held_out
from heatgraph.llm.sampling import sample_texts

_TOP = 0x110000


@cache
def _inside() -> np.ndarray:
    """Whether each code point belongs to words: letters, digits and the marks set on letters."""
    return np.fromiter((chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(_TOP)), bool, _TOP)


@dataclass(frozen=True)
class Grams:
    """Character n-grams of ``least`` to ``most`` code points, hashed to 2**bits features."""

    least: int = 4
    most: int = 6
    bits: int = 18


def characters(text: str) -> np.ndarray:
    """The lower-cased code points of a text, with one blank (32) for each run of others and at both ends."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_inside()[x], x, np.uint32(32))
    return x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]


def present(text: str, grams: Grams, scratch: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """The distinct features of one text, without order. ``scratch`` has a place for each feature.

    A text of more than ``most`` characters is taken in parts that overlap by a gram, so what is held doesn't grow with it.
    """
    if len(text) > most:
        parts = [present(text[max(0, a - grams.most) : a + most], grams, scratch, 2 * most) for a in range(0, len(text), most)]
        return np.unique(np.concatenate(parts)).astype(np.int32)
    x = characters(text).astype(np.uint64)
    step, found = np.uint64(0x9E3779B97F4A7C15), []
    value = x.copy()
    for n in range(2, grams.most + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        value = value[:m] * step + x[n - 1 :]
        if n >= grams.least:
            h = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            found.append(((h * step) >> np.uint64(64 - grams.bits)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32)
    every = np.concatenate(found)
    at = np.arange(len(every), dtype=np.int32)
    scratch[every] = at  # the last writer stands for all
    return every[scratch[every] == at]


def packed(features: np.ndarray) -> bytes:
    """Distinct features in about a byte each: sorted, as gaps of 254 at most, with bytes 255 before a wider one."""
    gaps = np.diff(np.sort(features).astype(np.int64), prepend=-1)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The features of ``packed``, in order."""
    x = np.frombuffer(data, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255] - 1


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(name))


@dataclass(frozen=True)
class ToxicModel:
    grams: Grams
    weights: np.ndarray  # of all features, float32
    bias: float


def count_grams(rows: DataFrame, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Of all ``rows(text, toxic)``: how many have each feature, by label, and how many there are, by label.

    What comes to the driver is one row for each feature, at most 2**bits of them.
    """
    size = 1 << grams.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scratch, n = np.zeros((2, size), np.int64), np.zeros(size, np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for y, text in zip(batch.column("toxic").to_pylist(), _texts(batch, "text"), strict=True):
                total[int(y > 0), present(text, grams, scratch)] += 1
                n[int(y > 0)] += 1
        on = np.flatnonzero(total.any(0))
        feature, no, yes = np.append(on, -1), np.append(total[0, on], n[0]), np.append(total[1, on], n[1])
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(no), pa.array(yes)], names=["feature", "no", "yes"])

    counted = rows.mapInArrow(count, "feature long, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toArrow()
    f = counted.column("feature").to_numpy()
    found = np.zeros((2, size + 1), np.int64)
    found[0, f], found[1, f] = counted.column("no").to_numpy(), counted.column("yes").to_numpy()
    return found[:, :-1], found[:, -1]


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratios of features: log of (toxic count + smooth) over the others', each as a share of its sum."""
    p, q = counts[1] + smooth, counts[0] + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(train: DataFrame, grams: Grams = Grams(), most_rows: int = 8_000, most_features: int = 40_000_000, smooth: float = 1.0) -> ToxicModel:
    """Learns from ``train(text, toxic)``; rows with a null text or label are left out.

    Log-count ratios are counted over all rows. Logistic weights of all ratio-scaled features are fitted on distinct
    texts, each with the weight of its number of rows: on all of them, or on at most ``most_rows`` with about
    ``most_features`` features (a byte each on the driver), those with the lowest hash. These are the only bounds, and they are on what is gathered for
    fitting. Without rows of both labels the score is the share of label 1 (a half if there are none).
    """
    rows = train.filter("text is not null and toxic is not null").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    size = 1 << grams.bits
    counts, n = count_grams(rows, grams)
    if not n.all():
        share = 0.5 if not n.any() else float(n[1] / n.sum())
        return ToxicModel(grams, np.zeros(size, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ratio = np.where(counts.any(0), log_ratios(counts, smooth), 0.0)
    most = max(1, min(most_rows, int(most_features * n.sum() / max(1, counts.sum()))))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(size, np.int32)
        for batch in batches:
            sets = [packed(present(text, grams, scratch)) for text in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sets, pa.binary()), batch.column("times"), batch.column("place")], names=["toxic", "x", "times", "place"])

    some = sample_texts(rows, most, ["toxic"]).orderBy("place", "toxic").limit(most)
    got = some.select("text", "toxic", "times", "place").mapInArrow(sparse, "toxic int, x binary, times long, place long").toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")])
    w, bias = fit_logistic(got.column("x").to_pylist(), got.column("toxic").to_numpy().astype(np.float64), ratio, got.column("times").to_numpy())
    return ToxicModel(grams, (w * ratio).astype(np.float32), bias)


def fit_logistic(sets: list[bytes], y: np.ndarray, ratio: np.ndarray, times: np.ndarray, epochs: int = 16, penalty: float = 5e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic weights over the ratio-scaled presence of features, ``packed``, from batches in a fixed order; a row counts ``times``.

    Every feature takes part, with steps of its own size (the root of its squared gradients); an absolute penalty on the
    weights leaves those at 0 that tell nothing. The penalty makes scores shy, so they are stretched in the end.
    """
    share = times / times.mean()
    mean = float((y * share).sum() / share.sum())
    w, bias = np.zeros(len(ratio)), float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    squares, last = np.full(len(ratio), 1e-8), 1e-8
    order = np.random.default_rng(3)
    for epoch in range(epochs):
        rows = order.permutation(len(y))
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            own = [unpacked(sets[i]) for i in part]
            cols, of = np.concatenate(own), np.repeat(np.arange(len(part)), [len(x) for x in own])
            z = np.bincount(of, w[cols] * ratio[cols], len(part)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[part]) * share[part] / len(part)
            grad = np.bincount(cols, g[of], len(w)) * ratio
            squares += grad**2
            step = np.minimum(rate * (1 - epoch / epochs) / np.sqrt(squares), 300 * rate)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            last += g.sum() ** 2
            bias -= 0.1 * g.sum() / np.sqrt(last)
    scaled = w * ratio
    stretch, bias = _stretched(np.array([scaled[unpacked(s)].sum() for s in sets]), y, share, bias)
    return w * stretch, bias


def _stretched(z: np.ndarray, y: np.ndarray, share: np.ndarray, bias: float) -> tuple[float, float]:
    """The factor (1 to 10) and the bias with which sums ``z`` give the likeliest labels, by damped Newton steps."""
    a = 1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + bias, -50, 50)))
        g, h = (p - y) * share, (p * (1 - p) + 1e-9) * share
        mixed = (h * z).sum()
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, mixed], [mixed, h.sum() + 1e-3]]), np.array([(g * z).sum(), g.sum()]))
        a, bias = float(np.clip(a - 0.5 * step[0], 1, 10)), float(np.clip(bias - 0.5 * step[1], -30, 30))
    return a, bias


def score(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``toxic_score`` from 0 to 1; empty and null texts get the bias."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxic_score"]
    schema = StructType([docs.schema[c] for c in keep] + [StructField("toxic_score", DoubleType())])
    work = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scratch = np.zeros(1 << m.grams.bits, np.int32)
        for batch in batches:
            z = np.array([m.weights[present(x, m.grams, scratch)].sum(dtype=np.float64) for x in _texts(batch, "__text")], np.float64) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(p)], names=[*keep, "toxic_score"])

    return work.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000) -> DataFrame:
    """``text, toxic`` of the labelled rows of ``docs``: of more than ``most_labels`` labelled ids those with the lowest hash.

    That bound, of at most two labels for an id, is what lets the labels be sent to every task, so texts aren't shuffled to
    fit the model. Repeated labels count once; an id labelled both ways trains both.
    """
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # a few more than wanted by their share of the hashes, so that no task sorts more than the bound
    share = (most_labels + 6 * most_labels**0.5 + 64) / max(1, known.select("doc_id").distinct().count())
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    ids = known.groupBy("doc_id").agg(F.collect_set("toxic").alias("toxic")).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most_labels)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.explode("toxic").alias("toxic"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``; labels of held-out documents aren't used. A document labelled both ways trains twice."""
    model = fit(labelled(docs, labels.filter(~held_out(F.col("doc_id")))))
    found = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
