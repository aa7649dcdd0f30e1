"""FLAC streams on flat arrays: all frames of many streams are coded and decoded side by side."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

BLOCK = 576
#: A seek point, and a PCM block, for each so many frames.
SEEK_FRAMES = 16
# The format's sync code, the codes of the header's block sizes and sample sizes, its polynomials.
_SYNC = (0xFF, 0xF8)
_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_CRC8, _CRC16 = 0x07, 0x8005
#: Order and bits of the linear predictors that the encoder tries, and frames that are coded or decoded at a time.
ORDER, PRECISION = 6, 9
_GROUP = 2048


class FlacError(ValueError):
    """A stream that isn't whole, or that this decoder doesn't know."""


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_T8, _T16 = _table(_CRC8, 8), _table(_CRC16, 16)
_ahead = _T16[None, :]


def _ahead_of(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 of a message, for each distance from its end and each byte."""
    global _ahead
    if len(_ahead) < n:
        rows = list(_ahead)
        while len(rows) < n + 64:
            rows.append((rows[-1] << np.uint16(8)) ^ _T16[rows[-1] >> np.uint16(8)])
        _ahead = np.array(rows, np.uint16)
    return _ahead


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-16 of each frame data[start:end]; frames are not empty and follow each other in order."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1])
    source = place + np.repeat(start - at[:-1], size)
    left = np.repeat(at[1:], size) - 1 - place
    table = _ahead_of(int(size.max()))
    return np.bitwise_xor.reduceat(table.ravel()[left * 256 + data[source]], at[:-1])


def _numbered(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's variable-length code: bytes by columns, and how many of them count."""
    size = 1 + sum((n >= (1 << b)).astype(np.int64) for b in (7, 11, 16, 21, 26))
    out = np.zeros((len(n), 6), np.uint8)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for j in range(6):
        on = j < size
        shift = 6 * np.maximum(size - 1 - j, 0)
        out[:, j] = np.where(on, (n >> shift) & 0x3F | 0x80 if j else np.where(size == 1, n, lead[size] | n >> shift), 0)
    return out, size


def _linear(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linear predictor of each block: whole-number weights, their shift, and the residuals after ``order`` samples.

    Weights solve the blocks' autocorrelation equations (Levinson and Durbin), scaled so that the largest takes
    PRECISION bits. A block they can't be found for has weights 0.
    """
    y = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : y.shape[1] - k], y[:, k:], dtype=np.float64) for k in range(order + 1)], 1)
    error, w = r[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), order))
    for k in range(order):
        step = (r[:, k + 1] - (w[:, :k] * r[:, k:0:-1]).sum(1)) / error
        w[:, :k] -= step[:, None] * w[:, :k][:, ::-1]
        w[:, k] = step
        error = np.maximum(error * (1 - step**2), 1e-9)
    largest = np.abs(w).max(1)
    top = (1 << PRECISION - 1) - 1
    fine = np.isfinite(largest) & (largest > 0)
    shift = np.where(fine, np.clip(np.floor(np.log2(top / np.where(fine, largest, 1))), 0, 15), 0).astype(np.int64)
    whole = np.clip(np.rint(np.where(fine[:, None], w, 0) * (1 << shift)[:, None]), -top - 1, top).astype(np.int32)
    z, n = x.astype(np.int32), x.shape[1]
    guess = np.zeros((len(x), n - order), np.int32)
    for k in range(order):
        guess += whole[:, k : k + 1] * z[:, order - 1 - k : n - 1 - k]
    return whole, shift, z[:, order:] - (guess >> shift[:, None].astype(np.int32))


def encode(samples: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """Streams of unsigned 8-bit samples; stream i has frames[i] blocks of BLOCK samples, and streams follow each other.

    Each frame has the predictor (fixed of order 0 to 2, or linear of order ORDER) and Rice parameter that take the
    fewest bits, or the value of a constant block, or the bare samples. Frames are coded _GROUP at a time.
    """
    blocks = samples.reshape(-1, BLOCK)
    number = np.arange(len(blocks)) - np.repeat(np.cumsum(frames) - frames, frames)
    parts = [_coded(blocks[g : g + _GROUP], number[g : g + _GROUP]) for g in range(0, len(blocks), _GROUP)]
    data, size = b"".join(p for p, _ in parts), np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
    result, at, first = [], 0, 0
    for f in frames.tolist():
        own = size[first : first + f]
        total = int(own.sum())
        result.append(_metadata((blocks[first : first + f] ^ np.uint8(128)).tobytes(), own) + data[at : at + total])
        at, first = at + total, first + f
    return result


def _coded(blocks: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of ``blocks`` one after another, and how many bytes each takes."""
    x = blocks.astype(np.int16) - np.int16(128)
    n = len(x)
    cost = np.full(n, 8 * BLOCK, np.int64)
    order, k = np.full(n, -1), np.zeros(n, np.int64)  # order -1: bare samples, -2: constant
    whole, shift, residual = _linear(x, ORDER)
    folded = []
    for o in (0, 1, 2, ORDER):
        e = residual if o == ORDER else np.diff(x, o) if o else x
        u = (e << 1) ^ (e >> (31 if o == ORDER else 15))
        u = np.minimum(u, 0xFFFF).astype(np.uint16) if o == ORDER else u.view(np.uint16)
        folded.append(u)
        more = 9 + PRECISION * ORDER if o == ORDER else 0
        guess = np.floor(np.log2(u.sum(1, dtype=np.int64) / u.shape[1] + 1)).astype(np.int64)
        for p in (np.clip(guess - 1, 0, 8), np.clip(guess, 0, 8)):
            c = (u >> p[:, None].astype(np.uint16)).sum(1, dtype=np.int64) + u.shape[1] * (p + 1) + 8 * o + 10 + more
            better = c < cost
            cost[better], order[better], k[better] = c[better], o, p[better]
    constant = (x == x[:, :1]).all(1)
    order[constant], k[constant], cost[constant] = -2, 0, 8
    # the fields after the warm-up samples: precision and shift, weights, the residual's head, then its codes
    first = ORDER + 2
    value, length = np.zeros((n, first + BLOCK), np.uint32), np.zeros((n, first + BLOCK), np.int64)
    linear = order == ORDER
    value[linear, 0], length[linear, 0] = (PRECISION - 1) << 5 | shift[linear], 9
    value[linear, 1 : 1 + ORDER], length[linear, 1 : 1 + ORDER] = whole[linear] & (1 << PRECISION) - 1, PRECISION
    coded = order >= 0
    value[coded, first - 1], length[coded, first - 1] = k[coded], 10
    for o, u in zip((0, 1, 2, ORDER), folded, strict=True):
        on = order == o
        u, p = u[on].astype(np.uint32), k[on][:, None].astype(np.uint32)
        value[on, first + o :] = (np.uint32(1) << p) | (u & ((np.uint32(1) << p) - np.uint32(1)))
        length[on, first + o :] = (u >> p) + p + 1
    bare = order == -1
    value[bare, first:], length[bare, first:] = (x[bare] & 255).astype(np.uint32), 8
    code, code_size = _numbered(number)
    head = code_size + 5
    warm = np.maximum(order, 0)
    size = head + 1 + warm + np.where(constant, 1, (length.sum(1) + 7) // 8) + 2
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + 4, np.uint8)
    check = np.zeros(n, np.uint8)
    fixed = [*_SYNC, 2 << 4 | 4, 1 << 1]  # 576 samples at 8 kHz; one channel of 8 bits
    for j in range(10):
        on = np.flatnonzero(j < head - 1)
        b = np.full(len(on), fixed[j], np.uint8) if j < 4 else code[on, j - 4]
        out[start[on] + j] = b
        check[on] = _T8[check[on] ^ b]
    out[start + head - 1] = check
    body = start + head
    out[body] = np.select([order == -2, order == -1, linear], [0x00, 0x02, 32 + ORDER - 1 << 1], 0x10 | warm << 1)
    out[body[constant] + 1] = x[constant, 0] & 255
    for o in range(ORDER):
        on = np.flatnonzero(warm > o)
        out[body[on] + 1 + o] = x[on, o] & 255
    length = np.cumsum(length, 1, out=length)
    last = (length + (8 * (body + 1 + warm) - 1)[:, None]).ravel()
    wide = value.ravel() << (7 - (last & 7)).astype(np.uint32)
    byte = last >> 3
    groups = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    for part, back in ((wide & np.uint32(255), 0), (wide >> np.uint32(8), 1)):
        out[byte[groups] - back] += np.add.reduceat(part, groups).astype(np.uint8)
    stop = start + size - 2
    sums = crc16(out, start, stop)
    out[stop], out[stop + 1] = sums >> 8, sums & 255
    return out[: int(size.sum())].tobytes(), size


def _metadata(signed: bytes, size: np.ndarray) -> bytes:
    """STREAMINFO and a SEEKTABLE."""
    info = BLOCK.to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
    info += (8000 << 44 | 0 << 41 | 7 << 36 | len(signed)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    at = np.cumsum(size) - size
    points = b"".join((BLOCK * i).to_bytes(8, "big") + int(at[i]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, len(size), SEEK_FRAMES))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


@cache
def _code_lengths() -> np.ndarray:
    """Bytes of a frame number's code by its first byte; 0 if none begins so."""
    return np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 5 if b < 0xFC else 6 if b < 0xFE else 0 for b in range(256)])


class _Reader:
    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        bits = np.unpackbits(padded)
        bits[-1] = 1  # unary codes end, at the latest here
        self.ones = np.flatnonzero(bits).astype(np.int32)
        self.rank = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits, dtype=np.int32, out=self.rank[1:])
        wide = padded.astype(np.uint64)
        self.window = sum(wide[i : len(wide) - 7 + i] << np.uint64(56 - 8 * i) for i in range(8))
        self.end = 8 * len(data)

    def bits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (at most 32) from each position."""
        word = self.window[at >> 3] << (at & 7).astype(np.uint64)
        n = np.asarray(n, np.uint64)
        return np.where(n > 0, word >> (np.uint64(64) - np.maximum(n, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = self.bits(at, n)
        return x - ((x >> np.maximum(n - 1, 0)) & 1) * (np.int64(1) << n)


def _frames(data: np.ndarray, begin: int, end: int, want: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where frames begin in a part of a stream, and their subframes: sync codes with a right header check, numbered from ``want``."""
    x = data[begin:end]
    at = np.flatnonzero((x[:-5] == _SYNC[0]) & (x[1:-4] == _SYNC[1])) if len(x) > 5 else np.zeros(0, np.int64)
    padded = np.concatenate([x, np.zeros(16, np.uint8)])
    length = _code_lengths()[padded[at + 4]]
    extra = np.where(x[at + 2] >> 4 == 6, 1, 0) + np.where(x[at + 2] >> 4 == 7, 2, 0)
    head = 4 + length + extra
    check = np.zeros(len(at), np.uint8)
    for j in range(12):
        check = np.where(j < head, _T8[check ^ padded[at + j]], check)
    good = (length > 0) & (check == padded[at + head])
    at, head, length = at[good], head[good], length[good]
    first = padded[at + 4].astype(np.int64)
    number = np.where(length == 1, first, first & ((1 << np.maximum(7 - length, 0)) - 1))
    for j in range(1, 6):
        number = np.where(j < length, number << 6 | padded[at + 4 + j] & 63, number)
    kept = []
    if np.array_equal(number, want + np.arange(len(at))):
        kept = slice(None)
    else:  # a sync code inside a frame is out of order
        for i, n in enumerate(number.tolist()):
            if n == want:
                kept.append(i)
                want += 1
        kept = np.array(kept, np.int64)
    return at[kept] + begin, at[kept] + begin + head[kept] + 1


def _head(s: bytes) -> dict:
    """What a stream says of itself: its bits, total, MD5, block size, the place of its first frame and its seek points."""
    if s[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, info, points, final = 4, None, np.zeros((0, 2), np.int64), False
    while not final and at + 4 <= len(s):
        final, kind, n = bool(s[at] & 128), s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        if kind == 0:
            info = s[at + 4 : at + 4 + n]
        elif kind == 3:
            raw = np.frombuffer(s, np.uint8, n // 18 * 18, at + 4).reshape(-1, 18)
            points = np.ascontiguousarray(raw[:, :16]).view(">u8").astype(np.int64)
            points = points[points[:, 0] >= 0]  # placeholders are all ones
        at += 4 + n
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    word = int.from_bytes(info[10:18], "big")
    out = {"bits": (word >> 36 & 31) + 1, "total": word & (1 << 36) - 1, "md5": info[18:34], "block": int.from_bytes(info[:2], "big"), "first": at, "points": points}
    if word >> 41 & 7 or out["bits"] > 16:
        raise FlacError("more than one channel or 16 bits")
    return out


def _samples(data: np.ndarray, start: np.ndarray, sub: np.ndarray, stop: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples of frames that lie in order in ``data``, and how many each has. Checks are verified; _GROUP frames at a time."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    if (stop - start < 8).any():
        raise FlacError("a frame is cut off")
    code = data[start + 2] >> 4
    size = np.array([_SIZES.get(c, 0) for c in range(16)])[code]
    for c, width in ((6, 1), (7, 2)):
        for i in np.flatnonzero(code == c):
            size[i] = int.from_bytes(data[sub[i] - 1 - width : sub[i] - 1].tobytes(), "big") + 1
    bits = bits.copy()
    for c, b in _BITS.items():
        bits[data[start + 3] >> 1 & 7 == c] = b
    out: list[np.ndarray] = []
    for g in range(0, len(start), _GROUP):
        own = slice(g, g + _GROUP)
        low, high = int(start[own][0]), int(stop[own][-1])
        part = data[low:high]
        if (crc16(part, start[own] - low, stop[own] - 2 - low) != (part[stop[own] - 2 - low].astype(np.uint16) << 8 | part[stop[own] - 1 - low])).any():
            raise FlacError("a frame's check is wrong")
        found, end = _subframes(_Reader(part), 8 * (sub[own] - low), size[own], bits[own])
        if ((end + 7) // 8 != stop[own] - 2 - low).any():
            raise FlacError("a frame's length is wrong")
        found = found.astype(np.int16)
        out += [found[i, :n] for i, n in enumerate(size[own].tolist())]
    return out, size


def decode(streams: list[bytes]) -> list[dict]:
    """Each stream's ``samples`` (signed), ``offsets`` of its frames in samples and ``at`` in bytes, ``bits`` of a sample.

    One channel of up to 16 bits. Constant, bare, fixed and linear-prediction subframes, any Rice partitions, escaped
    partitions and wasted bits are known. Header checks, frame checks, the number of samples and the MD5 of
    the samples are verified; a stream that fails raises FlacError. Beside the streams and their samples, what is held
    doesn't grow with their length.
    """
    if not streams:
        return []
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    infos = [_head(s) for s in streams]
    found = [_frames(data, b + i["first"], e) for i, b, e in zip(infos, base[:-1].tolist(), base[1:].tolist(), strict=True)]
    start, sub = (np.concatenate([f[k] for f in found]) for k in range(2))
    counts = np.array([len(f[0]) for f in found])
    of = np.repeat(np.arange(len(streams)), counts)
    stop = np.append(start[1:], len(data))
    ends = np.cumsum(counts) - 1
    stop[ends[counts > 0]] = base[1:][counts > 0]
    # the frames of a group lie side by side but for the heads of streams between them
    rows, size = _samples(data, start, sub, stop, np.array([i["bits"] for i in infos], np.int64)[of])
    out, first = [], 0
    for info, b, n in zip(infos, base.tolist(), counts.tolist(), strict=False):
        own = slice(first, first + n)
        whole = np.concatenate(rows[own]) if n else np.zeros(0, np.int16)
        if info["total"] not in (0, len(whole)) or info["md5"] not in (bytes(16), hashlib.md5(whole.astype("<i1" if info["bits"] <= 8 else "<i2").tobytes()).digest()):
            raise FlacError("the samples don't match the stream's total or MD5")
        out.append({"samples": whole, "offsets": np.cumsum(size[own]) - size[own], "at": start[own] - info["first"] - b, "bits": info["bits"]})
        first += n
    return out


def decode_at(stream: bytes, sample: int) -> dict | None:
    """The samples from the last seek point up to ``sample`` to the next point: ``offset``, ``at`` in bytes, ``samples``, ``bits``.

    Only the frames between the two points are read and checked. A stream without a seek table is one stretch. None if
    the stream ends before ``sample``.
    """
    info = _head(stream)
    if not 0 <= sample < info["total"]:
        return None
    points = info["points"] if len(info["points"]) and info["points"][0, 0] == 0 else np.zeros((1, 2), np.int64)
    i = int(np.searchsorted(points[:, 0], sample, "right")) - 1
    begin = info["first"] + int(points[i, 1])
    end = info["first"] + int(points[i + 1, 1]) if i + 1 < len(points) else len(stream)
    data = np.frombuffer(stream, np.uint8)
    start, sub = _frames(data, begin, end, int(points[i, 0]) // max(1, info["block"]))
    rows, _ = _samples(data, start, sub, np.append(start[1:], end), np.full(len(start), info["bits"], np.int64))
    return {"offset": int(points[i, 0]), "at": int(points[i, 1]), "samples": np.concatenate(rows) if rows else np.zeros(0, np.int16), "bits": info["bits"]}


def _subframes(r: _Reader, at: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of each subframe, padded to the longest, and the bit after it."""
    n, most = len(at), int(size.max()) if len(size) else 0
    x = np.zeros((n, most), np.int64)
    at = at.copy()
    if not n:
        return x, at
    head = r.bits(at, np.full(n, 8))
    kind, at = head >> 1 & 63, at + 8
    wasted = np.zeros(n, np.int64)
    some = np.flatnonzero(head & 1)
    if len(some):
        one = r.ones[r.rank[at[some]]].astype(np.int64)
        wasted[some] = one - at[some] + 1
        at[some] = one + 1
    if (head >> 7).any() or ((kind >= 2) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise FlacError("an unknown subframe")
    bits = bits - wasted
    constant, bare = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(constant):
        x[constant] = r.signed(at[constant], bits[constant])[:, None]
        at[constant] += bits[constant]
    for i in range(int(size[bare].max()) if len(bare) else 0):
        on = bare[size[bare] > i]
        x[on, i] = r.signed(at[on], bits[on])
        at[on] += bits[on]
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        order = np.where(kind >= 32, kind - 31, kind - 8)
        for i in range(int(order[coded].max())):
            on = coded[order[coded] > i]
            x[on, i] = r.signed(at[on], bits[on])
            at[on] += bits[on]
        linear = coded[kind[coded] >= 32]
        precision, shift, weights = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 32), np.int64)
        if len(linear):
            precision[linear] = r.bits(at[linear], np.full(len(linear), 4)) + 1
            shift[linear] = r.signed(at[linear] + 4, np.full(len(linear), 5))
            at[linear] += 9
            for j in range(int(order[linear].max())):
                on = linear[order[linear] > j]
                weights[on, j] = r.signed(at[on], precision[on])
                at[on] += precision[on]
        at[coded] = _residual(r, x, at[coded], coded, order[coded], size[coded])
        for o in range(1, 5):  # fixed predictors are differences: sum them up again
            on = np.flatnonzero(kind == 8 + o)
            for level in range(o, 0, -1):
                if len(on):
                    x[on, level - 1] = np.diff(x[on, :level], level - 1)[:, 0] if level > 1 else x[on, 0]
                    if level > 1:  # the lower warm-up samples are still needed
                        x[np.ix_(on, range(level - 1, most))] = np.cumsum(x[on, level - 1 :], 1)
                    else:
                        x[on] = np.cumsum(x[on], 1)
        for o in np.unique(order[linear]) if len(linear) else ():
            on = linear[order[linear] == o]
            w, y = weights[on, :o].T.copy(), x[on].T.copy()  # one row for each sample
            for i in range(int(o), most):
                guess = w[0] * y[i - 1]
                for j in range(1, o):
                    guess += w[j] * y[i - 1 - j]
                y[i] += guess >> shift[on]
            x[on] = y.T
    return x << wasted[:, None], at


def _residual(r: _Reader, x: np.ndarray, at: np.ndarray, rows: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Reads the Rice codes of ``rows`` into x behind their warm-up samples, one sample of all rows at a time."""
    n = len(rows)
    wide = r.bits(at, np.full(n, 2))
    if (wide > 1).any():
        raise FlacError("an unknown residual")
    wide = wide + 4  # bits of a parameter
    part = size >> r.bits(at + 2, np.full(n, 4))
    at = at + 6
    k, raw = np.zeros(n, np.int64), np.full(n, -1)

    def parameter(on: np.ndarray) -> None:
        k[on] = r.bits(at[on], wide[on])
        at[on] += wide[on]
        raw[on] = -1
        escaped = on[k[on] == (1 << wide[on]) - 1]
        if len(escaped):
            raw[escaped] = r.bits(at[escaped], np.full(len(escaped), 5))
            at[escaped] += 5

    parameter(np.arange(n))
    columns = np.zeros((int(size.max()), n), np.int64)
    first, least = int(order.max()), int(size.min())
    whole = bool((part == size).all())
    ones, rank, window = r.ones, r.rank, r.window
    for i in range(len(columns)):
        if i and not whole and len(new := np.flatnonzero((i % np.maximum(part, 1) == 0) & (i < size) & (i >= order))):
            parameter(new)
        if first <= i < least and (whole or not (raw >= 0).any()) and not (raw >= 0).any():
            one = ones[rank[at]].astype(np.int64)
            q = one - at
            one += 1
            low = (window[one >> 3] << (one & 7).astype(np.uint64)) >> np.uint64(32)
            u = q << k | low.astype(np.int64) >> (32 - k)
            at = one + k
            columns[i] = u >> 1 ^ -(u & 1)
            continue
        on = np.flatnonzero((i >= order) & (i < size))
        rice, plain = on[raw[on] < 0], on[raw[on] >= 0]
        one = ones[rank[at[rice]]].astype(np.int64)
        u = (one - at[rice]) << k[rice] | r.bits(one + 1, k[rice])
        at[rice] = one + 1 + k[rice]
        columns[i, rice] = u >> 1 ^ -(u & 1)
        columns[i, plain] = r.signed(at[plain], raw[plain])
        at[plain] += raw[plain]
        if (at > r.end + 64).any():
            raise FlacError("a frame runs past the stream's end")
    table = columns.T
    for o in np.unique(order):
        on = np.flatnonzero(order == o)
        x[rows[on], o : len(columns)] = table[on, o:]
    return at
