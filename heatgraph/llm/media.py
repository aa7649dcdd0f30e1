"""Media columns: texts or samples stored as FLAC, read back in PCM blocks with seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from heatgraph.llm import flac
from heatgraph.llm.textops import flat, slices

_BLOCKS = "array<struct<sample_offset:long,byte_offset:long,pcm:binary>>"
_SLICE = 1 << 20


def _schema(docs: DataFrame, keep: list[str], more: str) -> StructType:
    return StructType([docs.schema[c] for c in keep] + list(StructType.fromDDL(more)))


def store_media(docs: DataFrame, data: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but ``data`` by default) with ``n_bytes`` and ``media``.

    The bytes of ``data`` (UTF-8 of a string; null is empty), padded by bytes 255 to a positive multiple of 576, are the
    unsigned 8-bit samples of one FLAC stream with a seek table. Equal bytes give equal streams.
    """
    keep = [c for c in docs.columns if c not in (data, "n_bytes", "media")] if keep is None else keep
    work = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{data}`").cast("binary").alias("__data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__data", _SLICE):
                raw, offsets = flat(part.column("__data"))
                size = np.diff(offsets)
                frames = np.maximum(1, -(-size // flac.BLOCK))
                begin = np.concatenate([[0], np.cumsum(frames * flac.BLOCK)])
                padded = np.full(begin[-1], 255, np.uint8)
                padded[np.arange(len(raw)) + np.repeat(begin[:-1] - offsets[:-1], size)] = raw
                media = flac.encode(padded, frames)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return work.mapInArrow(run, _schema(work, keep, "n_bytes long, media binary"))


def _decoded(part: pa.RecordBatch, media: str) -> list[dict | None]:
    streams = part.column(media).to_pylist()
    found = iter(flac.decode([s for s in streams if s is not None]))
    return [None if s is None else next(found) for s in streams]


def _pcm(x: dict) -> bytes:
    """Samples of 8 bits as unsigned bytes, others as little-endian 16-bit numbers, as in WAV files."""
    return (x["samples"] + 128).astype(np.uint8).tobytes() if x["bits"] <= 8 else x["samples"].astype("<i2").tobytes()


def read_media(stored: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``stored`` (all others by default) with ``blocks``: decoded PCM in order.

    A block has the samples of a seek point's frames: ``sample_offset`` of its first sample, ``byte_offset`` of its first
    frame in the stream's frames, and ``pcm``. All checks of the stream are verified; a damaged stream fails the job. A null
    stream has null blocks.
    """
    keep = [c for c in stored.columns if c not in (media, "blocks")] if keep is None else keep
    work = stored.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))
        for batch in batches:
            for part in slices(batch, "__media", _SLICE):
                out = []
                for x in _decoded(part, "__media"):
                    if x is None:
                        out.append(None)
                        continue
                    pcm, width = _pcm(x), 1 if x["bits"] <= 8 else 2
                    first = x["offsets"][:: flac.SEEK_FRAMES].tolist()
                    stops = [*first[1:], len(x["samples"])]
                    out.append([{"sample_offset": a, "byte_offset": p, "pcm": pcm[a * width : b * width]} for a, b, p in zip(first, stops, x["at"][:: flac.SEEK_FRAMES].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(out, kind)], names=[*keep, "blocks"])

    return work.mapInArrow(run, _schema(work, keep, f"blocks {_BLOCKS}"))


def seek(stored: DataFrame, sample: int, media: str = "media") -> DataFrame:
    """The PCM block of each stream that holds ``sample``, as ``sample_offset``, ``byte_offset`` and ``pcm``.

    The stream's seek table says where the block begins and ends; only its frames are decoded and checked. The other
    columns of ``stored`` stay (those of these names are replaced). Null streams, and streams that end before the sample,
    give no row.
    """
    if sample < 0:
        raise ValueError("a sample's number is at least 0")
    names = ["sample_offset", "byte_offset", "pcm"]
    keep = [c for c in stored.columns if c not in (media, *names)]
    work = stored.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = (s.as_py() for s in batch.column("__media"))
            found = [None if s is None else flac.decode_at(s, sample) for s in streams]
            on = [i for i, x in enumerate(found) if x is not None]
            columns = [pa.array([found[i]["offset"] for i in on], pa.int64()), pa.array([found[i]["at"] for i in on], pa.int64()), pa.array([_pcm(found[i]) for i in on], pa.binary())]
            part = batch.take(pa.array(on, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], names=[*keep, *names])

    return work.mapInArrow(run, _schema(work, keep, "sample_offset long, byte_offset long, pcm binary"))


def _feature(pcm: np.ndarray) -> str:
    """Level, loudness and zero crossings around the middle, in whole numbers of thousandths."""
    x = pcm.astype(np.int64) - 128
    rms = int(np.sqrt(float((x * x).sum()) / len(x)) * 1000)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) * 1000 // max(1, len(x) - 1)
    steps = int(np.abs(np.diff(x)).sum()) * 1000 // max(1, len(x) - 1)
    return f"level={int(x.sum()) * 1000 // len(x)};rms={rms};crossings={crossings};steps={steps};peak={int(np.abs(x).max())}"


def media_digests(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and of the PCM in ``blocks``: bytes, SHA-256, CRC-32 of the last 32 bytes, and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in batch.column("blocks"):
                pcm = b"".join(b["pcm"].as_buffer() for b in one) if one.is_valid else b""
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), _feature(np.frombuffer(pcm, np.uint8)) if pcm else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return blocks.select(*keep, "blocks").mapInArrow(run, _schema(blocks, keep, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"))


def media_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: digests of what was stored and of what was read back."""
    stored = store_media(docs, "text", ["doc_id"])
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    found = media_digests(read_media(stored, "media", keep), keep)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
