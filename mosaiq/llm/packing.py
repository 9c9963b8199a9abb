"""Harmonic packing of documents' token ids into sequences of a fixed capacity C.

Class k holds the lengths in (C/(k+1), C/k], and each of its bins takes exactly k whole documents, so no bin
overflows and no lengths are compared. Each worker (input partition) fills the bins of its classes on its own,
with no shuffle. A full bin's gap, less than C/(k+1) + k ids, is filled with cut pieces, so a full sequence has no padding:
they come from documents that are cut anyway (what is left of one longer than C after its full sequences), from those
shorter than C/(classes+1), and, while the open gaps are over ``MOST_GAP`` sequences in all, from the next document. What
fillers leave without a gap makes sequences of its own. At a worker's end the open bins' documents fill the gaps, and
the rest is cut into full sequences and powers of two of ids, so every sequence is full or a power of two long. A
worker holds the ids of its open bins, gaps and fillers: about ``classes`` plus twice ``MOST_GAP`` sequences.

Null texts are empty; a document always holds its end id, so each has a piece. Null ids stay null, repeated
rows are packed each on their own (``row`` tells them apart), an empty table gives no rows, and only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.textutil import byte_bpe, default_vocabulary, documents, small_batches, texts

CAPACITY, CLASSES, END_ID, MOST_GAP = 1024, 31, 0, 8
COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"]


class HarmonicBins:
    """Bins of one worker. ``add`` and ``close`` return rows of (piece, sequence, offset); a piece is (document, start, length)."""

    def __init__(self, capacity: int, classes: int, first_sequence: int):
        if capacity < 1 or capacity & (capacity - 1) or not 1 <= classes < capacity:
            raise ValueError("capacity must be a power of two, classes fewer than it and at least one")
        self.capacity, self.least, self.next = capacity, capacity // (classes + 1), first_sequence
        self.open: dict[int, list] = {}
        self.gaps: deque = deque()  # [pieces, room] of bins that hold all their documents
        self.room = 0
        self.stock: deque = deque()  # pieces that wait for a gap
        self.stocked = 0

    def _emit(self, pieces: list) -> list:
        at, out = 0, []
        for piece in pieces:
            out.append((piece, self.next, at))
            at += piece[2]
        self.next += 1
        return out

    def _taken(self, n: int) -> list:
        """``n`` ids of the stock, the last piece cut if need be."""
        out = []
        while n:
            doc, start, length = self.stock.popleft()
            if length > n:
                self.stock.appendleft((doc, start + n, length - n))
                length = n
            out.append((doc, start, length))
            n -= length
            self.stocked -= length
        return out

    def _fill(self, piece: tuple) -> list:
        out = []
        self.stock.append(piece)
        self.stocked += piece[2]
        while self.gaps and self.stocked >= self.gaps[0][1]:
            pieces, room = self.gaps.popleft()
            self.room -= room
            out += self._emit(pieces + self._taken(room))
        while not self.gaps and self.stocked >= self.capacity:
            out += self._emit(self._taken(self.capacity))
        return out

    def add(self, doc, n: int) -> list:
        out, start = [], 0
        while n - start >= self.capacity:
            out += self._emit([(doc, start, self.capacity)])
            start += self.capacity
        n -= start
        if not n:
            return out
        if start or n <= self.least or self.room > MOST_GAP * self.capacity:
            return out + self._fill((doc, start, n))
        k = self.capacity // n
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, 0, n))
        if len(bin_) == k:
            del self.open[k]
            room = self.capacity - sum(p[2] for p in bin_)
            if room <= self.stocked:
                out += self._emit(bin_ + self._taken(room))
            else:
                self.gaps.append((bin_, room))
                self.room += room
        return out

    def close(self) -> list:
        out = []
        for bin_ in self.open.values():
            for piece in bin_:
                out += self._fill(piece)
        for pieces, _ in self.gaps:  # no filler is left for them
            self.stock += pieces
            self.stocked += sum(p[2] for p in pieces)
        while self.stocked:
            out += self._emit(self._taken(min(self.capacity, 1 << (self.stocked.bit_length() - 1))))
        self.open, self.gaps, self.room = {}, deque(), 0
        return out


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row`` of each piece, and with ``with_ids`` its ``ids``; ``row`` numbers the rows of ``df``."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    end = int(end_id).to_bytes(4, "little")
    names = COLUMNS + ["ids"] * with_ids
    schema = f"id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, row bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, id_arrow = None, None
        row = TaskContext.get().partitionId() << 40
        bins = HarmonicBins(capacity, classes, row)

        def rows(placed: list) -> pa.RecordBatch:
            docs = [p[0] for p, _, _ in placed]
            start, length = ([p[k] for p, _, _ in placed] for k in (1, 2))
            ids = [d[1][4 * s : 4 * (s + n)] for d, s, n in zip(docs, start, length)]
            cols = [pa.array([d[0] for d in docs], type=id_arrow), *(pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(x) for x in ids], [len(d[1]) // 4 for d in docs], [q for _, q, _ in placed], [o for _, _, o in placed], [d[2] for d in docs]))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            bpe, id_arrow = bpe or byte_bpe(vocabulary), batch.schema.field(0).type
            placed = []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = bpe.ids(text) + end
                placed += bins.add((key, ids, row), len(ids) // 4)
                row += 1
            if placed:
                yield rows(placed)
        if placed := bins.close():
            yield rows(placed)

    return source.mapInArrow(run, schema)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
