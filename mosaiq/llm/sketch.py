"""How often n-grams occur, in a count sketch of fixed size: an order of n-grams, rare first.

Every task counts all its n-grams in ``2**SKETCH_BITS`` slots; the tasks' counts are summed slot by slot, so the
result is the same however the rows are dealt to tasks. A slot's level is the power of two by which it stands
out of what chance puts into a slot. The order only decides how much work a search has: any order that all
documents agree on gives the same links.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.textutil import raw_texts

SKETCH_BITS = 22  # slots; a byte each on the driver and in the workers: 4 MB whatever the input's size
SLOT = np.uint64((1 << SKETCH_BITS) - 1)
PART = 4096  # slots in a row of counts
FINE = 4  # steps for each power of two


class SlotCounts:
    """Counts of a task."""

    def __init__(self):
        self.counts = np.zeros(1 << SKETCH_BITS, np.int32)

    def add(self, grams: np.ndarray) -> None:
        np.add.at(self.counts, grams & SLOT, 1)

    def parts(self) -> tuple[list[int], list[bytes]]:
        """The parts that hold a count, each as compressed 32-bit integers."""
        each = self.counts.reshape(-1, PART)
        at = np.flatnonzero(each.any(axis=1)).tolist()
        return at, [zlib.compress(each[k].astype("<i4").tobytes(), 1) for k in at]


def slot_counts(text: DataFrame, grams: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``part, counts`` of each task over the one text column of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            counts = counts or SlotCounts()
            for raw in raw_texts(batch.column(0)):
                counts.add(np.unique(grams(raw)))
        if counts:
            at, packed = counts.parts()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    return text.mapInArrow(run, "part int, counts binary")


def _summed(counts: DataFrame) -> DataFrame:
    """``part, total, fine``: the sum of a part, and a byte for each slot, the logarithm of its count in steps of ``1 / FINE``."""

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        fine = np.where(total > 0, 1 + np.floor(FINE * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([fine.tobytes()], pa.binary())], ["part", "total", "fine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != part:
                    if part is not None:
                        yield row(part, total)
                    part, total = k, np.zeros(PART, np.int64)
                total += np.frombuffer(zlib.decompress(packed), "<i4")
        if part is not None:
            yield row(part, total)

    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, total bigint, fine binary")


def levels(counts: DataFrame) -> np.ndarray:
    """For each slot the power of two of what it holds above the mean and three deviations, 0 for rare: ``2**SKETCH_BITS`` bytes on the driver."""
    fine, total = np.zeros(1 << SKETCH_BITS, np.uint8), 0
    for x in _summed(counts).collect():  # a row a part
        fine[x["part"] * PART : (x["part"] + 1) * PART] = np.frombuffer(bytes(x["fine"]), np.uint8)
        total += x["total"]
    mean = total / len(fine)
    count = np.exp2((np.arange(256) - 1) / FINE)
    above = np.maximum(count - mean - 3 * mean**0.5 - 3, 1)
    return np.minimum(np.floor(np.log2(above)), 62).astype(np.uint8)[fine]


def rare_first(values: np.ndarray, grams: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """64-bit ranks: the level of each n-gram, then ``values``."""
    return (rare[grams & SLOT].astype(np.uint64) << np.uint64(58)) | (values >> np.uint64(6))
