"""Packing: vector bin packing with the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heatgraph.checkpoints import cut

_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
_LONG = 1 << 20


class _Known(dict):
    """The encoded runs seen so far, each with the blank before it; others are encoded on demand, and kept while there is room.

    A run of Latin letters is one piece, and marks after it are another, so these are looked up and encoded apart.
    """

    def __init__(self, encoding: tiktoken.Encoding, kind: str, most: int) -> None:
        self.encoding, self.code, self.most = encoding, {"<u2": "H", "<u4": "I"}[kind], most
        self.marks: dict[str, bytes] = {}

    def bare(self, text: str) -> bytes:
        return array(self.code, self.encoding.encode_ordinary(text)).tobytes()

    def __missing__(self, run: str) -> bytes:
        if m := _PLAIN.fullmatch(run):
            word, mark = m.groups()
            if mark:
                if mark not in self.marks:
                    if len(self.marks) >= 10_000:
                        self.marks.clear()
                    self.marks[mark] = self.bare(mark)
                found = self[word] + self.marks[mark]
            else:
                found = self.bare(" " + run)
        else:
            found = self.bare(" " + run)
        if len(self) < self.most and len(run) < 64:
            self[run] = found
        return found


class ByteTokens:
    """Ids of a byte-level BPE tokenizer file, the same as the tokenizers library gives without special tokens.

    In such a tokenizer a blank before other than white space always begins a new piece, so the runs between these
    blanks are encoded on their own and remembered, up to ``remember`` of them. Files of another kind, and texts with
    one of the file's added tokens, go through the tokenizers library.
    """

    def __init__(self, path: str, remember: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE" and not spec.get("normalizer")
        self.kind = "<u2" if max(model["vocab"].values()) < 1 << 16 else "<u4"
        self.known = _Known(self._pieces(model["vocab"], set(added)), self.kind, remember) if plain else None

    @staticmethod
    def _pieces(vocab: dict[str, int], added: set[str]) -> tiktoken.Encoding:
        # printable bytes stand for themselves in the file; the others, in order, for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in added}
        # fixed value: the pattern of byte-level pieces
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.known is None or self.added and self.added.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [], 0
        while at < len(text):
            stop = len(text)
            if stop - at > _LONG and (m := _CUT.search(text, at + _LONG)):
                stop = m.start()
            part = text[at:stop]
            runs = _CUT.split(part) if _ODD.search(part) else part.split(" ")
            if at:  # begins with the blank it was cut at
                runs = runs[1:]
            else:
                out.append(self.known.bare(runs[0]))
                runs = runs[1:]
            out.append(b"".join(map(self.known.__getitem__, runs)))
            at = stop
        return np.frombuffer(b"".join(out), self.kind).astype(np.uint32)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> ByteTokens:
    """The tokenizer of a file, read once a worker."""
    return ByteTokens(path)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass
class Piece:
    key: object  # what the example is known by
    start: int
    length: int
    loss: int


@dataclass
class Packer:
    """Places examples into at most ``width`` open sequences; full ones, and when asked the rest, go to ``done``.

    An example goes where it fits and the dot product of its demands with the room left, both as shares of the limits, is
    highest; ties go to the oldest. If it fits nowhere and ``cut`` is set, the part that fills the fullest sequence is
    cut off first; otherwise that sequence is closed and a new one opened.

    With ``cut``, a sequence that is closed before it is full, by the limit on segments or loss, gives away its longest
    prefix with a power of two of tokens and stays open with the rest, so no sequence needs padding.
    """

    limits: Limits
    width: int = 64
    cut: bool = True
    open: list[list[Piece]] = field(default_factory=list)
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        self.room = np.zeros((0, 3))

    def _close(self, i: int) -> None:
        seq, rest = self.open[i], []
        if self.cut:
            rest = self._shed(seq)
        else:
            self.done.append(seq)
        if rest:
            self.open[i] = rest
            self.room[i] = self.most - (sum(p.length for p in rest), len(rest), sum(p.loss for p in rest))
        else:
            self.open.pop(i)
            self.room = np.delete(self.room, i, 0)

    def _shed(self, seq: list[Piece]) -> list[Piece]:
        """Closes the longest prefix of a power of two tokens, and returns what is left of the sequence."""
        left, head = 1 << sum(p.length for p in seq).bit_length() - 1, []
        for i, p in enumerate(seq):
            if p.length > left:
                first, rest = self._split(p, left)
                self.done.append([*head, first] if left else head)
                return [rest, *seq[i + 1 :]]
            head.append(p)
            left -= p.length
        self.done.append(head)
        return []

    def _put(self, i: int, p: Piece) -> None:
        self.open[i].append(p)
        self.room[i] -= (p.length, 1, p.loss)
        if self.room[i, 0] == 0:
            self.done.append(self.open.pop(i))
            self.room = np.delete(self.room, i, 0)

    def _split(self, p: Piece, n: int) -> tuple[Piece, Piece]:
        """Loss-bearing tokens are the last ones of an example."""
        loss = max(0, min(n, n - (p.length - p.loss)))
        return Piece(p.key, p.start, n, loss), Piece(p.key, p.start + n, p.length - n, p.loss - loss)

    def add(self, p: Piece) -> None:
        t = self.limits
        while p.length and (p.length > t.tokens or p.loss > t.loss):
            if not self.cut:
                raise ValueError(f"an example of {p.length} tokens doesn't fit a sequence")
            n = min(p.length, t.tokens)
            head, rest = self._split(p, n)
            if head.loss > t.loss:
                head, rest = self._split(p, n - (head.loss - t.loss))
            p = rest
            self.open.append([])
            self.room = np.vstack([self.room, self.most])
            self._put(len(self.open) - 1, head)
        while p.length:
            need = np.array([p.length, 1, p.loss], np.float64)
            fits = (self.room >= need).all(1)
            if fits.any():
                value = np.where(fits, (self.room / self.most) @ (need / self.most), -1.0)
                return self._put(int(value.argmax()), p)
            if len(self.open) < self.width:
                self.open.append([])
                self.room = np.vstack([self.room, self.most])
                return self._put(len(self.open) - 1, p)
            i = int(self.room[:, 0].argmin())
            n = int(min(self.room[i, 0], p.length)) if self.cut and self.room[i, 1] >= 1 else 0
            if n and (head := self._split(p, n))[0].loss <= self.room[i, 2]:
                p = head[1]
                before = len(self.open)
                self._put(i, head[0])
                if len(self.open) < before:
                    continue
            self._close(i)
        return None

    def finish(self) -> None:
        """Closes all sequences. With ``cut``, what is left is dealt out anew: full sequences, then powers of two."""
        rest = deque(p for s in self.open for p in s)
        if not self.cut:
            self.done += self.open
            rest.clear()
        seq: list[Piece] = []
        while rest:
            p, room = rest.popleft(), self.limits.tokens - sum(x.length for x in seq)
            head, p = self._split(p, min(p.length, room))
            if p.length:
                rest.appendleft(p)
            if seq and (len(seq) == self.limits.segments or sum(x.loss for x in seq) + head.loss > self.limits.loss):
                rest.appendleft(head)
                seq = self._shed(seq)
                continue
            seq.append(head)
            if head.length == room:
                self.done.append(seq)
                seq = []
        while seq:
            seq = self._shed(seq)
        self.open, self.room = [], np.zeros((0, 3))

    def take(self) -> list[list[Piece]]:
        out, self.done = self.done, []
        return out


_PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), width: int = 64, text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row for each piece of a row of ``docs``.

    A document is its ids and ``end_id``; all of them bear loss. Every id lies in one piece, pieces of a sequence follow
    each other from 0, and a sequence has at most ``limits``. Null and empty texts are documents of one id; repeated rows
    are packed as often as they occur. Sequences shorter than the limit, the last of a partition and those that very
    short documents fill by their number, have a power of two of tokens, so nothing needs padding.

    Each partition is packed on its own, in one pass, as its batches arrive: no shuffle, at most ``width`` open
    sequences, and a partition that is lost is packed again with the same result. ``sequence_id`` has the partition in
    its upper bits. ``tokenizer`` must be a path that every executor has.
    """
    kind = docs.schema["doc_id"].dataType
    work = docs.select("doc_id", F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens_of(tokenizer), Packer(limits, width)
        number, first = TaskContext.get().partitionId() << 36, 0
        held: dict[int, list] = {}  # documents with ids in open sequences: id, ids, tokens still to come out

        def rows() -> pa.RecordBatch:
            nonlocal first
            out = []
            for seq in packer.take():
                at = 0
                for p in seq:
                    doc = held[p.key]
                    piece = doc[1][p.start : p.start + p.length].astype("<u4")
                    out.append((doc[0], p.start, p.length, zlib.crc32(piece.tobytes()), len(doc[1]), number + first, at))
                    at += p.length
                    doc[2] -= p.length
                    if not doc[2]:
                        del held[p.key]
                first += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], at_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", *_PIECES])

        n = 0
        at_type = None
        for batch in batches:
            at_type = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            for i, value in enumerate(batch.column("__text")):
                found = encoder.ids(value.as_py() or "")
                doc = np.append(found, np.uint32(end_id))
                held[n] = [ids[i], doc, len(doc)]
                packer.add(Piece(n, 0, len(doc), len(doc)))
                n += 1
                if len(packer.done) >= 4096:
                    yield rows()
            yield rows()
        packer.finish()
        if packer.done:
            yield rows()

    schema = StructType([StructField("doc_id", kind), *(StructField(c, LongType()) for c in _PIECES)])
    return work.mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits, key: str = "example_id", tokens: str = "tokens", loss: str = "loss_tokens", width: int = 64) -> DataFrame:
    """``example_id, sequence_id, offset`` of whole examples: none is cut, so sequences keep some room.

    ``tokens`` and ``loss`` are the columns with an example's tokens and how many of them bear loss; null counts as 0. An
    example without tokens, or of more than the limits, gets a null sequence and offset.
    """
    kind = examples.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, first = Packer(limits, width, cut=False), TaskContext.get().partitionId() << 36, 0
        for batch in (*batches, None):
            out = []
            if batch is None:
                packer.finish()
            else:
                for k, n, m in zip(*(batch.column(c).to_pylist() for c in ("key", "tokens", "loss")), strict=True):
                    n, m = n or 0, min(m or 0, n or 0)
                    if 0 < n <= limits.tokens and m <= limits.loss and limits.segments:
                        packer.add(Piece(k, 0, n, m))
                    else:
                        out.append((k, None, None))
            for seq in packer.take():
                at = 0
                for p in seq:
                    out.append((p.key, number + first, at))
                    at += p.length
                first += 1
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=[key, "sequence_id", "offset"])

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(kind)
    work = examples.select(F.col(f"`{key}`").alias("key"), F.col(f"`{tokens}`").cast("long").alias("tokens"), F.col(f"`{loss}`").cast("long").alias("loss"))
    return work.mapInArrow(run, StructType([StructField(key, kind), StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def count_turns(turns: DataFrame, tokenizer: str, key: str = "conv_id", role: str = "role", text: str = "text", answer: str = "assistant") -> DataFrame:
    """``key, tokens, loss_tokens`` of each conversation: the ids of all its turns, each with an end id, and of those by ``answer``.

    Turns are counted where they are, and only (key, tokens, loss) is shuffled, after sums in each task; so a
    conversation may have any number of turns. Null texts are empty turns; turns with a null key are one conversation.
    """
    work = turns.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{role}`") == answer, F.lit(False)).alias("own"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens_of(tokenizer)
        for batch in batches:
            n = [len(encoder.ids(t.as_py() or "")) + 1 for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("own"), pa.array(n, pa.int64())], names=["key", "own", "n"])

    counted = work.mapInArrow(run, StructType([work.schema["key"], work.schema["own"], StructField("n", LongType())]))
    return counted.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("loss_tokens"))


def pack_conversations(turns: DataFrame, tokenizer: str, limits: Limits = Limits(2048, 32, 512), key: str = "conv_id") -> DataFrame:
    """``conv_id, tokens, loss_tokens, sequence_id, offset``: whole conversations in sequences within all three limits.

    The answers bear loss. A conversation beyond the limits has a null sequence and offset.
    """
    counted = cut(count_turns(turns, tokenizer, key))
    named = counted.withColumn("example", F.struct(F.col(f"`{key}`").alias("id"), "tokens", "loss_tokens"))
    placed = pack_examples(named, limits, "example")
    return placed.select(F.col("example.id").alias(key), "example.tokens", "example.loss_tokens", "sequence_id", "offset")
