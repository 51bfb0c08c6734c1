"""Packing of token ids into sequences of a fixed length: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's ids are cut into full sequences and a rest; the
rest goes to the open window that it fills best. When none has room, the fullest window is topped up from the rest's
head and emitted. At the end what the open windows of many partitions hold is merged: their pieces are joined, cut
into full sequences, and the last ids of a merge go to sequences whose lengths are powers of two, so none is padded.

Nulls and ties: a null text is empty, so its document is the end id alone. Repeated rows are packed once each. A
document of any length is cut into as many pieces as it takes. Empty tables give no pieces. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, slices
from quarry.llm.tokens import END_ID, encoder

LENGTH = 1024
OPEN_WINDOWS = 64
#: Partitions whose leftovers meet in one merge: at most 64 * 64 windows of 1,024 ids.
MERGED_PARTS = 64
_END = np.array([END_ID], "<u2")
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """One partition's open windows. add() and close() give (sequence number or None, offset, piece); a piece: (doc, start, total, ids)."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self._length, self._windows = length, windows
        self._gaps: list[tuple[int, int]] = []  # (room, key), ascending: the fullest first
        self._open: dict[int, list[tuple]] = {}
        self._key = self._sequence = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield self._sequence, at, piece
            at += len(piece[3])
        self._sequence += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while total - at >= self._length:
            yield from self._emit([(doc, at, total, ids[at : at + self._length])])
            at += self._length
        while at < total:
            size = total - at
            k = bisect_left(self._gaps, (size, -1))
            if k < len(self._gaps):
                room, key = self._gaps.pop(k)
            elif len(self._gaps) < self._windows:
                room, key = self._length, self._key
                self._open[key] = []
                self._key += 1
            else:
                room, key = self._gaps.pop(0)
                size = room
            self._open[key].append((doc, at, total, ids[at : at + size]))
            at += size
            if room > size:
                insort(self._gaps, (room - size, key))
            else:
                yield from self._emit(self._open.pop(key))

    def close(self) -> Iterator[tuple]:
        for pieces in self._open.values():
            for piece in pieces:
                yield None, 0, piece


def merge(pieces: list[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """Joins pieces and cuts them into sequences: full ones, then powers of two. Yields as Packer does."""
    left = sum(len(p[3]) for p in pieces)
    sequence = at = 0
    target = length
    for doc, start, total, ids in pieces:
        while len(ids):
            if at == 0:
                target = length if left >= length else 1 << (left.bit_length() - 1)
            cut = ids[: target - at]
            yield sequence, at, (doc, start, total, cut)
            at, start, ids, left = at + len(cut), start + len(cut), ids[len(cut) :], left - len(cut)
            if at == target:
                sequence, at = sequence + 1, 0


def pack(documents: DataFrame, length: int = LENGTH, windows: int = OPEN_WINDOWS, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (16-bit) if kept."""
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"

    def row(part: int, found: tuple) -> tuple:
        sequence, at, (doc, start, total, ids) = found
        open_yet = sequence is None
        return doc, start, len(ids), 0 if open_yet else _crc(ids), total, None if open_yet else ((2 * part) << 32) + sequence, at, part, ids.tobytes() if keep_ids or open_yet else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, packer = encoder(vocabulary).encode, TaskContext.get().partitionId(), Packer(length, windows)
        id_type = pa.int64()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for cut in slices(batch):
                rows = []
                for doc, ids in zip(cut.column("doc_id").to_pylist(), encode(cut.column("text")), strict=True):
                    rows += [row(part, x) for x in packer.add(doc, np.append(ids, _END))]
                if rows:
                    yield batch_of(rows)
        if rows := [row(part, x) for x in packer.close()]:
            yield batch_of(rows)

    def join(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        held = [group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        pieces = [(d, s, t, np.frombuffer(i, "<u2")) for d, s, t, i in zip(*held, strict=True)]
        merged, first = key[0].as_py(), (2 * key[0].as_py() + 1) << 32
        rows = [(d, s, len(ids), _crc(ids), t, first + q, at, merged, ids.tobytes() if keep_ids else None) for q, at, (d, s, t, ids) in merge(pieces, length)]
        kinds = [group.schema.field("doc_id").type, *[pa.int64()] * 6, pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_COLUMNS)

    placed = materialize(map_arrow(docs, run, schema), "packed")
    left = placed.where("sequence_id is null").withColumn("merge", F.floor(F.col("part") / MERGED_PARTS))
    full = placed.where("sequence_id is not null").unionByName(left.groupBy("merge").applyInArrow(join, schema))
    return full.select(*_COLUMNS[:7], *["ids"] * keep_ids)
