"""Packing: vector bin packing of examples into sequences with a dot-product heuristic.

An example has three sizes: tokens, segments (one a piece) and loss-bearing tokens. A sequence limits
all three. Each task streams its examples, keeps a bounded pool of pieces that still wait, and fills one
sequence at a time with the waiting piece that fits and whose size vector has the largest dot product
with what the sequence has left (both relative to the limits). If nothing fits, a piece is cut to fill
the gap, where cutting is allowed. A sequence that a limit closes early, and the last ones of a task, are
cut back to a power of two, which needs no padding.

Tasks pack on their own, so there is no shuffle and nothing is gathered: what a task adds is at most a
handful of short sequences. A task that runs again after a lost executor reads the same rows and numbers
its sequences alike.

What bears loss is told by example: a boolean, or spans of its text (as ``format_conversations`` gives them), of which a token is part
if it begins in one; the end id goes with the token before it. Without such a column all tokens bear loss, and that dimension says the same as
tokens: so it is for ``documents``.

Edge cases: a null or empty text is an example of the end id alone; an example longer than a sequence
is cut into full sequences; ties go to the piece that has waited longest; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import keeps, python_ready, tidy
from toxscan.llm.tokenizing import CACHE_SEGMENTS, LOOKUP_CHARS, encoder
from toxscan.llm.words import byte_slices

END_ID = 1
POOL = 2048


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Piece:
    """``length`` tokens of an example from ``start`` on. ``loss``: running count of loss-bearing tokens
    before each token of the example, or None if all bear loss."""

    example: object
    start: int
    length: int
    loss: object = None

    def n_loss(self, length: int | None = None) -> int:
        n = self.length if length is None else length
        return n if self.loss is None else int(self.loss[self.start + n] - self.loss[self.start])

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.example, self.start, n, self.loss),
                Piece(self.example, self.start + n, self.length - n, self.loss))


class VectorPacker:
    """Fills sequences from a stream of pieces. ``cutting``: pieces may be cut to fill a gap; without it
    only a piece larger than an empty sequence is cut, and sequences keep their length."""

    def __init__(self, limits: Limits = Limits(), cutting: bool = True, pool: int = POOL):
        import numpy as np

        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.np, self.limits, self.cutting, self.pool = np, limits, cutting, pool
        self.pieces: list[Piece | None] = [None] * (2 * pool + 8)
        self.size = np.zeros((2, 2 * pool + 8))  # tokens, loss-bearing tokens; 0 tokens: no piece
        self.free = list(range(2 * pool + 7, -1, -1))
        self.waiting = 0
        self.order = np.zeros(2 * pool + 8, dtype=np.int64)
        self.arrived = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        lim = self.limits
        if piece.loss is None and lim.loss >= lim.tokens:  # whole sequences need no search
            while piece.length >= lim.tokens:
                head, piece = piece.cut(lim.tokens)
                yield [head]
        else:
            while not self._fits_empty(piece):
                n = self._longest(piece, lim.tokens, lim.loss)
                head, piece = piece.cut(n)
                yield from self._put(head)
        if piece.length:
            yield from self._put(piece)

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield self._fill()

    def _fits_empty(self, p: Piece) -> bool:
        return p.length <= self.limits.tokens and p.n_loss() <= self.limits.loss

    def _longest(self, p: Piece, tokens: int, loss: int) -> int:
        """Most leading tokens of ``p`` within both bounds."""
        n = min(p.length, tokens)
        if p.n_loss(n) <= loss:
            return n
        if p.loss is None:
            return loss
        return int(self.np.searchsorted(p.loss[p.start:p.start + n + 1], p.loss[p.start] + loss, side="right")) - 1

    def _put(self, p: Piece) -> Iterator[list[Piece]]:
        self._store(p)
        while self.waiting >= self.pool:
            yield self._fill()

    def _store(self, p: Piece) -> None:
        k = self.free.pop()
        self.pieces[k] = p
        self.size[:, k] = (p.length, p.n_loss())
        self.order[k] = self.arrived
        self.arrived += 1
        self.waiting += 1

    def _take(self, k: int) -> Piece:
        p = self.pieces[k]
        self.pieces[k] = None
        self.size[:, k] = 0
        self.free.append(k)
        self.waiting -= 1
        return p

    def _fill(self) -> list[Piece]:
        """One sequence."""
        np, lim = self.np, self.limits
        left = [lim.tokens, lim.segments, lim.loss]
        bin_: list[Piece] = []
        while self.waiting and left[0] > 0 and left[1] > 0:
            tokens, loss = self.size
            score = tokens * (left[0] / lim.tokens**2) + loss * (left[2] / lim.loss**2)
            score += left[1] / lim.segments**2
            fits = (tokens > 0) & (tokens <= left[0]) & (loss <= left[2])
            if fits.any():
                p = self._take(self._best(np.where(fits, score, -1.0)))
            elif self.cutting:
                k = self._best(np.where(tokens > 0, score, -1.0))
                n = self._longest(self.pieces[k], left[0], left[2])
                if n < 1:
                    break
                p, rest = self._take(k).cut(n)
                if rest.length:
                    self._store(rest)
            else:
                break
            bin_.append(p)
            left[0] -= p.length
            left[1] -= 1
            left[2] -= p.n_loss()
        if self.cutting:
            self._cut_back(bin_, lim.tokens - left[0])
        return bin_

    def _best(self, score) -> int:
        top = self.np.flatnonzero(score == score.max())
        return int(top[self.np.argmin(self.order[top])])

    def _cut_back(self, bin_: list[Piece], held: int) -> None:
        """A sequence that is not full goes back to a power of two; the rest waits again."""
        if held == self.limits.tokens or held & (held - 1) == 0:
            return
        over = held - (1 << (held.bit_length() - 1))
        while over:
            p = bin_.pop()
            if p.length > over:
                keep, p = p.cut(p.length - over)
                bin_.append(keep)
            over -= p.length
            self._store(p)


def pack_ids(examples: Iterable[tuple[object, object]], limits: Limits = Limits(), cutting: bool = True
             ) -> Iterator[list[Piece]]:
    """Sequences of pieces for ``(example, running loss counts or None)``, where ``len(example)`` is the
    number of tokens. No Spark."""
    packer = VectorPacker(limits, cutting)
    for example, loss in examples:
        yield from packer.add(Piece(example, 0, len(example), loss))
    yield from packer.finish()


def running_loss(ids: bytes, text: str, spans: list[list[int]], lengths):
    """The number of loss-bearing tokens before each of ``ids`` (the end id last) and behind them; ``lengths`` gives the bytes of an id."""
    import numpy as np

    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each code point, in bytes
    sizes = lengths[np.frombuffer(ids, dtype="<u4")[:-1]]
    if sizes.sum() != len(raw):
        raise ValueError("spans need a tokenizer whose ids stand for the bytes of the text")
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    for a, b in spans:
        a, b = min(max(a, 0), len(starts) - 1), min(max(b, 0), len(starts) - 1)
        if a < b:
            edge[starts[a]] += 1
            edge[starts[b]] -= 1
    bears = (np.cumsum(edge) > 0)[np.cumsum(sizes) - sizes]
    bears = np.append(bears, bears[-1:] if len(bears) else False)
    return np.concatenate([[0], np.cumsum(bears)]).astype(np.int32)


class _Example:
    __slots__ = ("row_id", "ids")

    def __init__(self, row_id, ids: bytes):
        self.row_id, self.ids = row_id, ids

    def __len__(self) -> int:
        return len(self.ids) // 4


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, loss_col: str | None = None,
         tokenizer: str = "byte_bpe_50k.json", limits: Limits = Limits(), end_id: int = END_ID,
         cutting: bool = True, emit_ids: bool = False, cache_segments: int = CACHE_SEGMENTS, keep_segments: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, ``start`` (ids of the example before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in its sequence), ``n_loss`` and, with
    ``emit_ids``, ``ids`` (little-endian unsigned 32-bit).

    ``loss_col``: a boolean column (an example where it is false or null is context and bears no loss), or spans of code points of the
    text, ``array<struct<start, end>>`` (null: none; for byte-level files). ``keep_segments``: workers keep learned
    segments from task to task; without it they give them up at the end of each, for other stages to have the memory."""
    python_ready(df.sparkSession)
    spans = bool(loss_col) and isinstance(df.schema[loss_col].dataType, T.ArrayType)
    if spans:
        loss = F.transform(F.coalesce(F.col(loss_col), F.array().cast(df.schema[loss_col].dataType)),
                           lambda s: F.array(s["start"].cast("long"), s["end"].cast("long")))
    else:
        loss = F.coalesce(F.col(loss_col), F.lit(False)) if loss_col else F.lit(True)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       loss.alias("_loss"))
    long = T.LongType()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType)]
                          + [T.StructField(n, long) for n in names]
                          + ([T.StructField("ids", T.BinaryType())] if emit_ids else []))

    def sequences(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer, True, cache_segments)
        packer = VectorPacker(limits, cutting)
        end = int(end_id).to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 32
        id_type = None
        rows: list[tuple] = []

        def place(found: Iterable[list[Piece]]) -> None:
            nonlocal next_id
            for seq in found:
                at = 0
                for p in seq:
                    ids = p.example.ids[4 * p.start:4 * (p.start + p.length)]
                    rows.append((p.example.row_id, p.start, p.length, zlib.crc32(ids), len(p.example), next_id, at,
                                 p.n_loss(), *([ids] if emit_ids else [])))
                    at += p.length
                next_id += 1

        def out():
            columns = list(zip(*rows))
            rows.clear()
            arrays = [pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:8]]
            arrays += [pa.array(columns[8], pa.binary())] if emit_ids else []
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            for start, n in byte_slices(batch.column(1), LOOKUP_CHARS):
                row_ids, texts, bears = (batch.column(k).slice(start, n).to_pylist() for k in range(3))
                for k, ids in enumerate(encode.batch(texts)):
                    ids += end
                    if spans:
                        loss_before = running_loss(ids, texts[k] or "", bears[k], encode.byte_lengths())
                    else:
                        loss_before = None if bears[k] else np.zeros(len(ids) // 4 + 1, dtype=np.int32)
                    example = _Example(row_ids[k], ids)
                    place(packer.add(Piece(example, 0, len(example), loss_before)))
                if len(rows) > 20_000:
                    yield out()
        place(packer.finish())
        if rows:
            yield out()
        if not keep_segments:
            keeps("nothing")

    placed = picked.mapInArrow(sequences if keep_segments else tidy(sequences), schema)
    return placed.withColumnRenamed("_id", id_col)
