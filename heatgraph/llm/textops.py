"""Words and rolling hashes of many texts at once, on flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes between words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CHUNK = 1 << 22
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's step and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for k, x in (("up", _STEP), ("down", _STEP_BACK)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024), x, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; another one for each salt."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(table: pa.Table | pa.RecordBatch, text: str, most: int = 1 << 21, rows: int = 1 << 14) -> Iterator[pa.Table | pa.RecordBatch]:
    """Consecutive pieces of about ``most`` bytes of ``text`` and at most ``rows`` rows; a longer text is a piece of its own."""
    sizes = np.diff(flat(table.column(text))[1])
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start == rows):
            yield table.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield table.slice(start, len(sizes) - start)


class Words:
    """The words of a run of texts: ``start`` and ``end`` in ``raw``; those of text i are first[i] to first[i + 1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        inside = np.zeros(len(raw) + 1, bool)
        np.logical_not(IS_SPACE[raw], out=inside[: len(raw)])
        begins, ends = inside.copy(), np.zeros(len(raw) + 1, bool)
        begins[1:] &= ~inside[:-1]
        ends[1:] = inside[:-1] & ~inside[1:]
        edge = offsets[1:-1]  # neighbouring texts must not run together
        edge = edge[(edge > 0) & (edge < len(raw))]
        joined = edge[inside[edge] & inside[edge - 1]]
        begins[joined] = True
        ends[joined] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        out, i, n = np.empty(len(self), np.uint64), 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _CHUNK, "right")))
            low, high = int(self.start[i]), int(self.end[j - 1])
            up, _ = _power(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[self.raw[low:high]] * up[:-1], out=sums[1:])
            a, b = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = mix((sums[b] - sums[a]) * _power(high - low + 1)[1][a], 1) + (b - a).astype(np.uint64)
            i = j
        return mix(out, 2)


def windows(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values, without regard to texts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, v, i = np.empty(n, np.uint64), mix(values, 2 * salt + 3), 0
    while i < n:
        j = min(n, i + _CHUNK)
        up, down = _power(j - i + width)
        sums = np.zeros(j - i + width, np.uint64)
        np.cumsum(v[i : j + width - 1] * up[:-1], out=sums[1:])
        out[i:j] = (sums[width:] - sums[:-width]) * down[: j - i]
        i = j
    return mix(out, 2 * salt + 4)


def whole(words: Words, width: int) -> np.ndarray:
    """Whether the window that starts at each word lies in one text, for the len(words) - width + 1 first words."""
    n = max(0, len(words) - width + 1)
    left = np.repeat(words.first[1:], words.counts())[:n] - np.arange(n)
    return left >= width


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Whether each position lies in a window of ``width`` that starts at a marked one; ``starts`` has all positions."""
    change = np.zeros(len(starts) + width + 1, np.int32)
    change[: len(starts)] += starts
    change[width : width + len(starts)] -= starts
    return np.cumsum(change)[: len(starts)] > 0
