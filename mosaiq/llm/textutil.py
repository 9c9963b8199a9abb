"""Shared helpers of the corpus operators: shared folders, columns, cached word codes and token ids.

All caches are bounded: they are dropped when they reach ``CACHE_ENTRIES`` entries, so a worker's
memory does not grow with the corpus.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
WORD_AND_MARKS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]+)")
UNEVEN_SPACE = ("  ", " \n", "\n ", "\n\n", *map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local folder serves a local master; on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps: it does so when the driver's JVM collects."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that nothing lazy still reads, and the shuffle files of what led to them."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        free_shuffles(tables[0].sparkSession)


FILTER_BITS = 25


def bit_filter(values: DataFrame) -> bytes:
    """A set of the one bigint column of ``values`` as ``2**FILTER_BITS`` bits, 4 MB whatever the input's size. It may let others through, so an exact join follows it."""
    place = F.pmod(F.col(values.columns[0]), F.lit(1 << FILTER_BITS))
    parts = values.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.collect():  # 1024 rows of 4 kB at most
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def passes(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``values`` the filter lets through."""
    at = np.mod(values.astype(np.int64), 1 << FILTER_BITS)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that long texts do not fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def texts(column: pa.Array) -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _SEGMENT, _LONG_WORD = 0xD1342543DE82EF95, 1 << 18, 64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return sized_words(raw)[0]


def sized_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and their bytes. Long texts are taken in segments that end at white space."""
    if len(raw) <= _SEGMENT:
        return _hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + _SEGMENT
        if end < len(raw):
            tail = raw[end - 4096 : end]
            back = max(tail.rfind(b" "), tail.rfind(b"\n"))
            if back >= 0:
                end = end - 4096 + back
            else:
                stops = [x for x in (raw.find(c, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x >= 0]
                end = min(stops, default=len(raw))
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    a = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[a], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = end - start
    if int(size.max()) > _SEGMENT:  # a word without end: one at a time
        each = ((raw[s:e], int(e - s)) for s, e in zip(start.tolist(), end.tolist()))
        return np.array([xxhash.xxh3_64_intdigest(w) if n > _LONG_WORD else int(_hashes(w)[0][0]) for w, n in each], np.uint64), size
    up, down = _powers(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODES[a] * up[: len(a)], out=sums[1:])
    out = mix64((sums[end] - sums[start]) * down[start] + size.astype(np.uint64))
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return out, size


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words in order; fewer words than that: one hash of them all, none: none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : n - k + 1 + i]
        out ^= out >> np.uint64(29)
    return mix64(out)


class _Encoded(dict):
    """Text part -> its ids as bytes. Full, it becomes the older of two generations, whose entries return when they are met."""

    def __init__(self, encode, before: str, punctuation=None):
        super().__init__()
        self.encode, self.before, self.older, self.punctuation = encode, before, {}, punctuation

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        code = self.older.get(word)
        if code is None:
            if self.punctuation is not None and (m := WORD_AND_MARKS.fullmatch(word)):
                code = self[m[1]] + self.punctuation[m[2]]  # the pre-tokeniser cuts between them
            else:
                code = array("I", self.encode(self.before + word)).tobytes()
        if len(word) <= CACHED_LENGTH:
            self[word] = code
        return code


class ByteBpe:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, by the tokenizers library.

    The vocabulary's pre-tokeniser always cuts before a blank that stands between two characters that are
    not white space, so the parts between such places are encoded on their own and kept for words seen before.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def encode(s: str) -> list[int]:
            return t.encode(s, add_special_tokens=False).ids

        self.first = _Encoded(encode, "")
        self.later = _Encoded(encode, " ", self.first)
        self.newline = self.first["\n"]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        later = self.later.__getitem__
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNEVEN_SPACE):
            head, *rest = SAFE_CUT.split(text)
            return self.first[head] + b"".join([later(x[1:]) for x in rest])
        lines = []
        for line in text.split("\n"):  # single blanks and line ends only
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(later, rest)))
        return self.newline.join(lines)


_BPE: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    if path not in _BPE:
        _BPE[path] = ByteBpe(path)
    return _BPE[path]


def forget_tokens() -> None:
    """Drops a reused worker's token caches, for tasks that need its memory otherwise."""
    if _BPE:
        _BPE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def map_batches(df: DataFrame, make, schema) -> DataFrame:
    """``make(batch) -> RecordBatch`` over the Arrow batches of ``df``; the function is made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return df.mapInArrow(run, schema)
