"""Substring dedup by level-wise doubling: only windows repeated at one length are tried at twice that length."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.textops import Words, covered, flat, mix, whole, windows

_LAST = np.iinfo(np.int64).max
#: Messages between units and buckets: hashes, then for the last level the smallest ids, as differences from ``base``.
_MESSAGE = "bucket long, unit long, hashes binary, ids binary, base long, wide boolean"
_NAMES = ["bucket", "unit", "hashes", "ids", "base", "wide"]
_TYPES = [pa.int64(), pa.int64(), pa.large_binary(), pa.large_binary(), pa.int64(), pa.bool_()]


def levels(window: int) -> list[int]:
    """The lengths that are tried: each is at most twice the one before, the last is ``window``, the first at most 4."""
    out = [window]
    while out[0] > 4 or len(out) < 2:
        out.insert(0, math.ceil(out[0] / 2))
    return out


def sizes(total: int, least: int = 2 << 20, most: int = 64 << 20, per_message: int = 64) -> tuple[int, int]:
    """How many units and buckets ``total`` bytes of text make.

    Their size grows with the root of the input, so that a message, what one unit has for one bucket, keeps about
    ``per_message`` hashes (six bytes of text each), until a unit is ``most`` bytes; from there on messages shrink, towards
    one row for a hash.
    """
    unit = min(most, max(least, int(math.sqrt(6 * per_message * total))))
    return max(1, math.ceil(total / unit)), max(1, math.ceil(total / (2 * unit)))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``data`` as one binary array; ``ends`` are their ends in bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _messages(bucket: np.ndarray, unit: np.ndarray, hashes: pa.Array, ids: pa.Array | None = None, base: np.ndarray | None = None, wide: np.ndarray | None = None) -> pa.Table:
    n = len(bucket)
    rest = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((base, pa.int64()), (wide, pa.bool_()))]
    table = pa.table([pa.array(bucket, pa.int64()), pa.array(unit, pa.int64()), hashes, pa.nulls(n, pa.large_binary()) if ids is None else ids, *rest], names=_NAMES)
    return table.cast(pa.schema(list(zip(_NAMES, [t if t != pa.large_binary() else pa.binary() for t in _TYPES], strict=True))))


_EMPTY = np.zeros(0, np.int64)


def _none() -> pa.Table:
    return _messages(_EMPTY, _EMPTY, _binary(np.zeros(0, np.uint8), _EMPTY))


_WIDE = (1 << 32) - 1


def _gaps(x: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that grow within each message, from its base on, as their differences in four bytes each; message i has n[i].

    A difference of more than four bytes is preceded by as many full ones as it takes. Also where each message ends, in bytes.
    """
    stops = np.cumsum(n)
    away = np.diff(x, prepend=x[:1])
    first = stops - n
    away[first] = x[first] - base
    ends = np.cumsum(away // np.uint64(_WIDE) + np.uint64(1)).astype(np.int64)
    out = np.full(int(ends[-1]) if len(ends) else 0, _WIDE, np.uint32)
    out[ends - 1] = away % np.uint64(_WIDE)
    return out, 4 * ends[stops - 1]


def _from_gaps(data: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of messages with one base, and how many each has."""
    x, first = data.view("<u4"), offsets[:-1] // 4
    sums = np.cumsum(x, dtype=np.uint64)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    ends = x != _WIDE
    n = np.add.reduceat(ends, first, dtype=np.int64)
    return sums[ends] - np.repeat(before, n) + np.uint64(base), n


def _marks(on: np.ndarray, n: np.ndarray) -> pa.Array:
    """One bit for each entry; every message begins a byte."""
    size = -(-n // 8)
    begin = 8 * (np.cumsum(size) - size)
    bits = np.zeros(8 * int(size.sum()), bool)
    bits[np.arange(len(on)) + np.repeat(begin - (np.cumsum(n) - n), n)] = on
    return _binary(np.packbits(bits), np.cumsum(size))


def _floor(bucket: int, bits: int, buckets: int) -> int:
    """The least hash of a bucket."""
    return -(-(bucket << bits) // buckets)


def _edges(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted values begins."""
    return np.searchsorted(x, np.array([_floor(b, bits, buckets) for b in range(buckets + 1)], np.uint64))


class _Unit:
    """The windows of one unit of documents, always in the same order, whatever the order in which its rows arrive."""

    def __init__(self, table: pa.Table) -> None:
        # rows without an id are last in the order: they never take words from others
        ids = [_LAST if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = [t or b"" for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.table = table.take(pa.array(order, pa.int64()))
        self.ids = np.array(ids, np.int64)[order]
        self.words = Words(*flat(self.table.column("text")))
        self.hashes = self.words.hashes()
        self.owner = self.ids[self.words.text_of()] if len(self.words) else self.ids[:0]

    def all_windows(self, length: int) -> np.ndarray:
        """Where windows of ``length`` begin."""
        return np.flatnonzero(whole(self.words, length))

    def keys(self, at: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, ...]:
        """The hashes of the windows at ``at``: 47 bits, for the last level 63 and 31 more."""
        if not len(at):
            return (np.zeros(0, np.uint64),) * (1 + last)
        one = windows(self.hashes, length, 2 * length)[at]
        if not last:
            return (mix(one, 9) >> np.uint64(17),)
        return one >> np.uint64(1), windows(self.hashes, length, 2 * length + 1)[at] >> np.uint64(33)

    def distinct(self, at: np.ndarray, length: int, last: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys in order, the smallest id of each, whether it has several, and the place of each window's key."""
        keys = self.keys(at, length, last)
        order = np.lexsort(keys[::-1]) if last else np.argsort(keys[0], kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        first, place = np.flatnonzero(new), np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(first):
            return keys, self.ids[:0], np.zeros(0, bool), place
        own = self.owner[at][order]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        return tuple(k[order[first]] for k in keys), low, low != high, place


def _note(unit: int, words: int, at: np.ndarray) -> pa.Table:
    """A unit's own note of its candidates; it goes past the buckets."""
    on = np.zeros(words, bool)
    on[at] = True
    bits = np.packbits(on)
    return _messages(np.array([-1 - unit]), np.array([unit]), _binary(bits, np.array([len(bits)])))


def _noted(answers: pa.Table, words: int) -> np.ndarray | None:
    """The candidates of the unit's note, or None if there is none."""
    place = np.flatnonzero(answers.column("bucket").to_numpy() < 0)
    if not len(place):
        return None
    return np.flatnonzero(np.unpackbits(np.frombuffer(answers.column("hashes")[int(place[0])].as_py(), np.uint8), count=words))


def _sent(unit: int, keys: tuple[np.ndarray, ...], low: np.ndarray, several: np.ndarray, buckets: int) -> pa.Table:
    """One message for each bucket that a unit has keys for; a key's lowest bit says that it has several ids here."""
    last = len(keys) == 2
    cuts = _edges(keys[0], 63 if last else 47, buckets)
    to = np.flatnonzero(np.diff(cuts))
    ends, flag = cuts[to + 1], several.astype(np.uint64)
    if not last:
        base = np.array([2 * _floor(b, 47, buckets) for b in to.tolist()], np.uint64)
        data, stops = _gaps(keys[0] << np.uint64(1) | flag, base, np.diff(cuts)[to])
        return _messages(to, np.full(len(to), unit), _binary(data.view(np.uint8), stops))
    both = np.empty(len(low), [("a", "<u8"), ("b", "<u4")])
    both["a"], both["b"] = keys[0], (keys[1] << np.uint64(1) | flag).astype(np.uint32)
    base, top = np.minimum.reduceat(low, cuts[to]), np.maximum.reduceat(low, cuts[to])
    away = (low.view(np.uint64) - np.repeat(base, np.diff(np.append(0, ends))).view(np.uint64))
    wide = top.view(np.uint64) - base.view(np.uint64) >> np.uint64(32) > 0
    tables = []
    for w in (False, True):  # differences take four bytes, or eight in a message that needs them
        on = np.flatnonzero(wide == w)
        rows = np.concatenate([np.arange(cuts[to[i]], ends[i]) for i in on]) if len(on) else _EMPTY
        n = np.cumsum(np.diff(np.append(0, ends))[on])
        tables.append(_messages(to[on], np.full(len(on), unit), _binary(both[rows].view(np.uint8), 12 * n), _binary(away[rows].astype("<u8" if w else "<u4").view(np.uint8), (8 if w else 4) * n), base[on], wide[on]))
    return pa.concat_tables(tables)


def _ids(table: pa.Table, n: np.ndarray) -> np.ndarray:
    """The smallest ids of all messages' keys, in order; message i has n[i]."""
    raw, offsets = flat(table.column("ids"))
    wide = table.column("wide").to_numpy(zero_copy_only=False).astype(bool)
    out = np.zeros(int(n.sum()), np.uint64)
    each = np.repeat(wide, n)
    inside = np.repeat(wide, np.diff(offsets))
    out[each], out[~each] = raw[inside].view("<u8"), raw[~inside].view("<u4")
    return (out + np.repeat(table.column("base").to_numpy().view(np.uint64), n)).view(np.int64)


def _matched(table: pa.Table, buckets: int) -> pa.Table:
    """Tells each unit which of its keys are repeated, one bit for each, and at the last level their smallest id."""
    if table.column("bucket")[0].as_py() < 0:
        return table  # a note
    last = table.column("base").null_count == 0
    raw, offsets = flat(table.column("hashes"))
    if last:
        n = np.diff(offsets) // 12
        both = raw.view([("a", "<u8"), ("b", "<u4")])
        flag, keys = both["b"] & 1, (both["a"], both["b"] >> np.uint32(1))
        order = np.lexsort(keys[::-1])
    else:
        value, n = _from_gaps(raw, offsets, 2 * _floor(table.column("bucket")[0].as_py(), 47, buckets))
        flag, keys = value & np.uint64(1), (value >> np.uint64(1),)
        order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    again = (np.diff(np.append(first, len(order))) > 1) | (np.add.reduceat(flag[order].astype(np.int64), first) > 0)
    hit = again[group]
    ends = np.cumsum(n)
    some = np.add.reduceat(hit, np.append(0, ends[:-1]), dtype=np.int64) > 0
    keep, rows = np.flatnonzero(some), np.repeat(some, n)
    if not len(keep):
        return _none()
    bucket, unit = (table.column(c).to_numpy()[keep] for c in ("bucket", "unit"))
    marks = _marks(hit[rows], n[keep])
    if not last:
        return _messages(bucket, unit, marks)
    low = np.minimum.reduceat(_ids(table, n)[order], first)[group]
    of = np.repeat(np.arange(len(n)), n)[hit]
    return _messages(bucket, unit, marks, _binary(low[hit].view(np.uint8), 8 * np.cumsum(np.bincount(of, minlength=len(n))[keep])), np.zeros(len(keep), np.int64), np.ones(len(keep), bool))


def _answered(keys: np.ndarray, bits: int, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted keys are repeated, and the smallest ids of these in order of the keys (at the last level)."""
    answers = answers.filter(pa.compute.greater_equal(answers.column("bucket"), 0)).sort_by("bucket")
    out, cuts = np.zeros(len(keys), bool), _edges(keys, bits, buckets)
    if not len(answers):
        return out, _EMPTY
    raw, offsets = flat(answers.column("hashes"))
    bucket = answers.column("bucket").to_numpy()
    n = np.diff(cuts)[bucket]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # places within each message
    out[np.repeat(cuts[bucket], n) + inside] = np.unpackbits(raw)[np.repeat(8 * offsets[:-1], n) + inside]
    return out, flat(answers.column("ids"))[0].view(np.int64)


def in_units(docs: DataFrame, units: int) -> DataFrame:
    """``docs`` with its ``unit``: rows that are all alike are in as many as they have partitions, which a retry doesn't change."""
    return docs.withColumn("unit", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.spark_partition_id()), F.lit(units)))


def dedup_substrings(docs: DataFrame, window: int = 13, unit_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """``doc_id, text, n_words, n_removed`` for each row of ``docs(doc_id, text)``; text is the kept words with single spaces.

    A word is removed if one of the windows of ``window`` words over it also starts in a row with a smaller ``doc_id``.
    Windows are judged on the input. Rows that share a ``doc_id`` don't take words from each other; rows with a null one
    are after all others; ids are whole numbers. A null or empty text has no words; a text shorter than the window keeps
    all. Rows come out one for one.

    ``levels``, for 13 words 4, 7 and 13: all windows of the first length are matched; a window is a candidate at the next
    length if both of its ends are windows that occur under two ids; where no candidate survives, nothing is sent and
    the unit is not looked at again until its rows are written. The last length is matched by 94 bits, others by 47,
    which may only let a candidate through. Longer repeats are unions of windows, so the doubling ends at ``window``.

    Documents are dealt into units by a hash of the id and the partition they come from, so neither repeated rows nor null
    ids crowd in one. A unit sends the distinct hashes of a level, packed, to hash buckets and gets back one bit for
    each: a passage in a third of all documents costs one entry a unit. ``sizes`` says how units and buckets grow. Nothing is
    gathered by passage or document, texts are shuffled once (the passes share that exchange), and every step is a
    pure function of its input, so lost executors only cost recomputation.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    lengths = levels(window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, buckets = sizes(total)
    units, buckets = (k if size is None else max(1, math.ceil(total / size)) for k, size in ((units, unit_bytes), (buckets, bucket_bytes)))
    dealt = in_units(docs, units)
    final = len(lengths) - 1

    def first(key: tuple, table: pa.Table) -> pa.Table:
        unit = _Unit(table)
        keys, low, several, _ = unit.distinct(unit.all_windows(lengths[0]), lengths[0], False)
        return _sent(key[0].as_py(), keys, low, several, buckets)

    def survivors(unit: _Unit, level: int, answers: pa.Table) -> np.ndarray | None:
        """The windows of a level's length whose ends are both repeated at the level before."""
        at = unit.all_windows(lengths[0]) if level == 1 else _noted(answers, len(unit.words))
        if at is None or not len(at):
            return None
        keys, _, _, place = unit.distinct(at, lengths[level - 1], False)
        again, _ = _answered(keys[0], 47, buckets, answers)
        on = np.zeros(len(unit.words) + window, bool)
        on[at] = again[place]
        step = lengths[level] - lengths[level - 1]
        every = unit.all_windows(lengths[level])
        return every[on[every] & on[every + step]]

    def next_level(level: int):
        def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return _none()
            unit, number = _Unit(left), key[0].as_py()
            at = survivors(unit, level, right)
            if at is None or not len(at):
                return _none()
            keys, low, several, _ = unit.distinct(at, lengths[level], level == final)
            return pa.concat_tables([_note(number, len(unit.words), at), _sent(number, keys, low, several, buckets)])

        return send

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        unit = _Unit(left)
        words = unit.words
        gone = np.zeros(len(words), bool)
        at = _noted(right, len(words)) if len(right) else None
        if at is not None and len(at):
            keys, _, _, place = unit.distinct(at, window, True)
            again, low = _answered(keys[0], 63, buckets, right)
            least = np.full(len(again), _LAST, np.int64)
            least[again] = low
            begins = np.zeros(len(words), bool)
            begins[at[least[place] < unit.owner[at]]] = True
            gone = covered(begins, window)
        texts, removed, counts = [], [], words.counts()
        raw = words.raw.tobytes()
        for i in range(len(unit.table)):
            f, t = words.first[i], words.first[i + 1]
            keep = np.flatnonzero(~gone[f:t]) + f
            removed.append(int(t - f - len(keep)))
            texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]))
        return pa.table([unit.table.column("doc_id"), pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    by_unit = dealt.groupBy("unit")
    match = lambda table: _matched(table, buckets)
    found = by_unit.applyInArrow(first, _MESSAGE).groupBy("bucket").applyInArrow(match, _MESSAGE)
    for level in range(1, len(lengths)):
        found = by_unit.cogroup(found.groupBy("unit")).applyInArrow(next_level(level), _MESSAGE).groupBy("bucket").applyInArrow(match, _MESSAGE)
    out = by_unit.cogroup(found.groupBy("unit")).applyInArrow(remove, "doc_id long, text binary, n_words long, n_removed long")
    return out.withColumn("text", F.col("text").cast("string"))


def substring_report(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row for each row of ``docs``: how many of its words went, and a digest of those that stay."""
    return dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
