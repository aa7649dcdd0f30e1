"""Language ID by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from heatgraph.llm.names import free, quoted
from heatgraph.llm.sampling import sample_texts
from heatgraph.llm.textops import slices

UNKNOWN = "und"
#: Prototypes that documents are compared with at a time.
_LANGUAGES = 2_000
_TOP = 0x110000
#: Bytes and rows that are bundled together; with the step of n-grams they bound what a task holds.
_PIECE = (1 << 19, 512)
_SCALE = float(1 << 20)


@dataclass(frozen=True)
class Space:
    """Vectors of ``dims`` signs; one random vector for each letter, drawn from ``seed`` and its code point."""

    dims: int = 1024
    order: int = 3
    seed: int = 7


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_TOP)), bool, _TOP)


@cache
def _letter(space: Space, code: int) -> np.ndarray:
    return np.random.default_rng([space.seed, code]).integers(0, 2, space.dims, np.int8) * np.int8(2) - np.int8(1)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, one blank (32) for each run of others and at both ends; the text of each."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])  # the first of each run of others
    keep[:1] = True
    return np.where(letter, codes, 32)[keep], of[keep]


def _grams(codes: np.ndarray, of: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (as rows of code points), and for each occurrence which one it is and in which text."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros((0, order), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(_TOP, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    small = np.zeros(_TOP, np.int64)
    small[letters] = np.arange(len(letters))
    s, size = small[codes], len(letters)
    inside = np.flatnonzero(of[:n] == of[order - 1 :])
    if size**order < 1 << 62:
        key = np.zeros(n, np.int64)
        for k in range(order):
            key = key * size + s[k : k + n]
        key = key[inside]
    if size**order <= 1 << 22:  # few letters: a table of all n-grams instead of a sort
        there = np.zeros(size**order, bool)
        there[key] = True
        found = np.flatnonzero(there)
        place = np.zeros(size**order, np.int64)
        place[found] = np.arange(len(found))
        which = place[key]
    elif size**order < 1 << 62:
        found, which = np.unique(key, return_inverse=True)
    else:
        rows, which = np.unique(np.stack([codes[k : k + n][inside] for k in range(order)], 1), axis=0, return_inverse=True)
        return rows.astype(np.int64), which.ravel(), of[inside]
    digits = np.stack([found // size ** (order - 1 - k) % size for k in range(order)], 1)
    return letters[digits], which, of[inside]


def _bound(rows: np.ndarray, space: Space) -> np.ndarray:
    """The n-grams' vectors: each letter's vector is rotated by its distance from the end, and all are multiplied."""
    out = np.ones((len(rows), space.dims), np.int8)
    for k in range(rows.shape[1]):
        letters, which = np.unique(rows[:, k], return_inverse=True)
        if len(letters):
            out *= np.stack([np.roll(_letter(space, int(c)), rows.shape[1] - 1 - k) for c in letters])[which.ravel()]
    return out


def bundle(texts: list[str | None], space: Space, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The sum of all n-gram vectors of each text, and whether it has a letter.

    A text of more than ``most`` characters is bundled in parts, which share the letters that n-grams across their border
    need, so what is held doesn't grow with its length.
    """
    if len(texts) == 1 and len(texts[0] or "") > most:
        return _bundle_long(texts[0], space, most)
    codes, of = _symbols([t or "" for t in texts])
    has = np.bincount(of[codes != 32], minlength=len(texts)) > 0
    return _sums(codes, of, len(texts), space), has


def _sums(codes: np.ndarray, of: np.ndarray, n: int, space: Space) -> np.ndarray:
    rows, which, of = _grams(codes, of, space.order)
    out = np.zeros((n, space.dims), np.float32)
    step = 1 << 12  # so many n-grams' vectors at a time
    for a in range(0, len(rows), step):
        width = min(step, len(rows) - a)
        on = (which >= a) & (which < a + width) if len(rows) > step else slice(None)
        times = np.bincount(of[on] * width + which[on] - a, minlength=n * width)
        out += times.reshape(n, width).astype(np.float32) @ _bound(rows[a : a + width], space).astype(np.float32)
    return out


def _bundle_long(text: str, space: Space, most: int) -> tuple[np.ndarray, np.ndarray]:
    total, has, tail = np.zeros((1, space.dims), np.float64), False, np.full(1, 32, np.uint32)
    for a in range(0, len(text), most):
        part = text[a : a + most].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_is_letter()[codes], codes, 32).astype(np.uint32)
        has = has or bool((codes != 32).any())
        if a + most >= len(text):
            codes = np.append(codes, np.uint32(32))
        codes = np.concatenate([tail, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        total += _sums(codes, np.zeros(len(codes), np.int64), 1, space)
        tail = codes[max(0, len(codes) - space.order + 1) :]
    return total.astype(np.float32), np.array([has])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _known(train: DataFrame) -> DataFrame:
    return train.filter("lang is not null and text is not null").select("text", "lang")


def _chosen(train: DataFrame, per_language: int | None) -> DataFrame:
    """``text, lang`` of about ``per_language`` distinct texts of each language at most, or of all without it."""
    return sample_texts(_known(train), per_language, ["lang"]).select("text", "lang")


def fit_prototypes(train: DataFrame, space: Space = Space(), per_language: int | None = 4000) -> tuple[list[str], np.ndarray]:
    """Languages of ``train(text, lang)`` in order, and the normalised sum of their documents' vectors.

    Rows with a null language or text are left out, and copies count once. Of a language with more than ``per_language``
    distinct texts about that many are used, chosen by a hash of the text; the bound is on rows for fitting only, and None takes all. Each
    text counts the same, as a vector of whole numbers, so sums don't depend on their order. A language takes ``dims``
    numbers on the driver and in a task (4 KB), and there may be any number of them.
    """
    chosen = _chosen(train, per_language)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", *_PIECE):
                vectors, _ = bundle(part.column("text").to_pylist(), space)
                whole = np.rint(_unit(vectors) * _SCALE).astype(np.int64)
                for lang, v in zip(part.column("lang").to_pylist(), whole, strict=True):
                    total[lang] = total.get(lang, 0) + v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = chosen.select("text", "lang").mapInArrow(sums, "lang string, v array<long>")
    added = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = {r["lang"]: dict(r["v"]) for r in added.groupBy("lang").agg(F.collect_list(F.struct("i", "x")).alias("v")).collect()}
    langs = sorted(found)
    table = np.array([[found[k][i] for i in range(space.dims)] for k in langs], np.float64).reshape(len(langs), space.dims)
    return langs, _unit(table).astype(np.float32)


def nearest(vectors: np.ndarray, prototypes: np.ndarray, block: int = _LANGUAGES) -> tuple[np.ndarray, np.ndarray]:
    """The prototype with the highest cosine (cut to 0..1) for each vector, and that cosine; the first one of equals."""
    best, score = np.zeros(len(vectors), np.int64), np.full(len(vectors), -1.0)
    for a in range(0, len(prototypes), block):
        cosines = np.clip(vectors @ prototypes[a : a + block].T, 0, 1).astype(np.float64)
        i = cosines.argmax(1)
        value = cosines[np.arange(len(i)), i]
        higher = value > score
        best[higher], score[higher] = a + i[higher], value[higher]
    return best, np.maximum(score, 0.0)


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, space: Space = Space(), text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``lang_pred`` and ``lang_score``, the best cosine cut to 0..1.

    Ties go to the first language in order. A null or empty text, or one without a letter, is ``und`` with score 0; so is
    everything if there are no languages. Long texts are read whole. Columns of these names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    work = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", *_PIECE):
                vectors, has = bundle(part.column("__text").to_pylist(), space)
                best, scores = nearest(_unit(vectors), prototypes)
                on = has & bool(langs)
                found = [langs[b] if h else UNKNOWN for b, h in zip(best, on, strict=True)]
                scores = np.where(on, scores, 0.0)
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores)], names=[*keep, *names])

    return work.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: a fifth, by the CRC-32 of its id as text; null ids never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame, space: Space = Space(), per_language: int = 4000) -> DataFrame:
    """One row for each row of ``docs``; prototypes are learned from the rows that aren't held out."""
    langs, prototypes = fit_prototypes(docs.filter(~held_out(F.col("doc_id"))), space, per_language)
    found = predict_language(docs.select("doc_id", "text"), langs, prototypes, space, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def _letters(text: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[^\p{L}]+", "")).cast("double")


def fit_spread(train: DataFrame, langs: list[str], prototypes: np.ndarray, space: Space = Space()) -> DataFrame:
    """``lang, spread`` of each language: its documents of n letters score about sqrt(n / (n + spread)).

    The spread is the median over all distinct texts of ``train``, so junk among them hardly moves it (of a sketch of all
    of them, within 1 in 10,000 of their ranks). It stands for how many letters of the language are as much alike as not.
    """
    # equal texts have equal scores, so they are told apart by their hashes, and no text is shuffled
    rows = _known(train).select("text", "lang", F.xxhash64("text").alias("place"), _letters("text").alias("n"))
    found = predict_language(rows, langs, prototypes, space, keep=["place", "lang", "n"]).filter("lang_score > 0")
    n, s = F.col("n"), F.col("s")
    once = found.groupBy("place", "lang").agg(F.max("n").alias("n"), F.max("lang_score").alias("s"))
    rows = once.groupBy("lang").agg(F.percentile_approx(n * (1 / (s * s) - 1), 0.5, 10_000).alias("spread")).toArrow()
    return train.sparkSession.createDataFrame(rows)


def keep_known(docs: DataFrame, langs: list[str], prototypes: np.ndarray, spread: DataFrame, space: Space = Space(), share: float = 1 / 3) -> DataFrame:
    """The rows of ``docs`` whose text is like the language it is nearest to; all columns stay, whatever their names.

    The cosine must reach ``share`` of what documents of that language and as many letters score (``fit_spread``), and a
    level that at most 1 in 100 texts without any tie to the languages pass: one of them has cosines of deviation
    1 / sqrt(dims). Texts without letters are never kept.
    """
    name, value = (free(docs.columns, c) for c in ("__language", "__cosine"))
    found = predict_language(docs, langs, prototypes, space, names=(name, value))
    chance = float(np.sqrt(2 * np.log(100 * max(1, len(langs))) / space.dims))
    n = _letters("text")
    known, wide = (free(docs.columns, c) for c in ("__known", "__spread"))
    least = F.greatest(F.lit(chance), F.lit(share) * F.sqrt(n / (n + F.greatest(F.col(wide), F.lit(0.0)))))
    table = F.broadcast(spread.select(F.col("lang").alias(known), F.col("spread").alias(wide)))
    good = found.filter(F.col(name) != UNKNOWN).join(table, F.col(name) == F.col(known)).filter(F.col(value) >= least)
    return good.select(*[F.col(quoted(c)) for c in docs.columns])
