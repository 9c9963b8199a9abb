"""Mixing sources to target weights by blocks of a fixed number of tokens.

Each source's documents stand in one stream, cut into blocks; a source of few
blocks has shorter ones, ``LEAST_BLOCKS`` or as many as it has words, so that it too comes near its target. Target weights give each source a share of all
tokens, at most ``max_epochs`` times its size, the excess shared anew by weight. Output shards have a fixed
number of slots; their source counts are drawn shard by shard from a multinomial whose chances follow what
each source still needs, so that the last shard ends at the targets. A source's slots are numbered through all
shards, slot j of epoch e takes block ``permutation_e(j mod blocks)``, and blocks are joined by index. In an
epoch a block is taken once at most, so no document exceeds ``max_epochs`` times its size.

Shards are drawn in two steps: the driver draws super-shards of equally many whole shards, the tasks draw the shards of
each. Positions in a stream come from two levels of sums (source and hash bucket, then inside a bucket), so a hot
source is dealt to many tasks. The driver holds one row for each source (``MAX_SOURCES`` at most, else an
error) and ``DRIVER_COUNTS`` counts at most, whatever the input's size.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``. Null texts have none; rows without words are kept with nothing
taken. A null source is a source of its own, the last one. Repeated rows are rows of their own; order in a
bucket is by id, size, then the text's hash. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.textutil import documents, map_batches, mix64, small_batches, stored

WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
BLOCK, SHARD_SLOTS, MAX_SUPER, MAX_SOURCES, MAX_EPOCHS = 128, 1024, 4096, 100_000, 3
DRIVER_COUNTS = 4_000_000  # counts of super-shards and sources that the driver draws
BUCKET_ROWS, LEAST_BLOCKS = 2_000, 32


def cycled_weights(n: int) -> list[float]:
    """1, 2, 3, repeating."""
    return [1.0 + k % 3 for k in range(n)]


def targets(sizes: list[int], weights: list[float], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``max_epochs`` times its size, the excess shared anew by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in sorted(free) if left * weights[k] / total > max_epochs * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(max_epochs * sizes[k])
            free.discard(k)
        left -= sum(out[k] for k in over)
    return out


def draws(need: np.ndarray, shard_slots: int, seed: list[int]) -> Iterator[np.ndarray]:
    """Slots of each source, shard by shard: multinomial draws by what each source still needs."""
    rng, left = np.random.default_rng(seed), need.astype(np.int64).copy()
    while (total := int(left.sum())) > 0:
        room, counts = min(shard_slots, total), np.zeros(len(left), np.int64)
        while room:
            open_ = left - counts
            drawn = np.minimum(rng.multinomial(room, open_ / open_.sum()), open_)
            counts += drawn
            room -= int(drawn.sum())
        left -= counts
        yield counts


def draw_counts(need: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """``draws`` as one row a shard and one column a source."""
    out = list(draws(need, shard_slots, [seed]))
    return np.array(out, np.int64).reshape(len(out), len(need))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size-1 for each key: a Feistel network over the next even power of two, walked until it falls inside."""
    half = np.array([max(1, -(-int(s - 1).bit_length() // 2)) for s in np.unique(size).tolist()], np.uint64)[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (left << h) | right
        todo &= out >= size.astype(np.uint64)
    return out.astype(np.int64)


@dataclass
class Mixture:
    """``rows``: row, id, source, size, sid, start. ``sources``: sid, source, source_size, target. ``slots``: shard, place, sid, epoch, block. ``pieces``: row, id, sid, start, size, block, at, length (the words of a row in a block; ``at`` counts from the row's start)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def mixed(self) -> DataFrame:
        """Every taken piece in its shard and place."""
        return self.slots.join(self.pieces.where("length > 0"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """``row, id, size, source_size, target, taken`` of every row."""
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
        each = self.pieces.join(times, ["sid", "block"], "left").groupBy("row").agg(F.coalesce(F.sum(F.col("length") * F.col("times")), F.lit(0)).cast("bigint").alias("taken"))
        return self.rows.join(each, "row", "left").join(F.broadcast(self.sources), "sid").select("row", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixture(df: DataFrame, weights=cycled_weights, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> Mixture:
    """``weights`` gives the weights of the sources in ascending order (by code point, null last) for their number. ``row_col`` names a column of distinct numbers of the rows; without one they are numbered here."""
    spark = df.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    sized = stored(df.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda x: (x["source"] is None, (x["source"] or "").encode()))
    sizes = [int(x["n"]) for x in found]
    goal = targets(sizes, weights(len(sizes)), max_epochs)
    widths = [max(1, min(block, n // LEAST_BLOCKS)) for n in sizes]
    blocks = [-(-n // w) for n, w in zip(sizes, widths)]
    need = np.array([min(max_epochs * b, round(g * b / n)) if n else 0 for n, b, g in zip(sizes, blocks, goal)], np.int64)
    # super-shards of whole shards are drawn here, the shards inside each of them in the tasks
    shards = max(1, -(-int(need.sum()) // shard_slots))
    per_super = -(-shards // max(1, min(MAX_SUPER, DRIVER_COUNTS // max(1, len(need)))))
    counts = draw_counts(need, shard_slots * per_super, seed)
    first = np.cumsum(counts, axis=0) - counts if len(counts) else counts
    sources = spark.createDataFrame([(k, x["source"], n, g) for k, (x, n, g) in enumerate(zip(found, sizes, goal))], "sid int, source string, source_size bigint, target double")
    held = [np.flatnonzero(c) for c in counts]
    ints = lambda rows, t: pa.array([r.tolist() for r in rows], pa.list_(t))
    plan = spark.createDataFrame(pa.table({"super": pa.array(range(len(counts)), pa.int64()), "sid": ints(held, pa.int32()), "first": ints([f[h] for f, h in zip(first, held)], pa.int64()), "n": ints([c[h] for c, h in zip(counts, held)], pa.int64()), "blocks": ints([np.array(blocks, np.int64)[h] for h in held], pa.int64())}))
    # positions: sums of buckets first, then inside each
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    names = spark.createDataFrame([(k, x["source"], w) for k, (x, w) in enumerate(zip(found, widths))], "sid int, named string, width bigint")
    named = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("bucket", F.pmod(F.xxhash64("id", "hash"), F.lit(buckets)))
    whole = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("id", "size", "hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["sid", "bucket"]).select("row", "id", "source", "size", "sid", (F.col("base") + F.col("inside")).alias("start"), "width")
    rows = placed.drop("width")
    end, width = F.col("start") + F.col("size"), F.col("width")
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))))
        .select("row", "id", "sid", "start", "size", "block", F.greatest(F.lit(0), F.col("block") * width - F.col("start")).alias("at"), (F.least(end, (F.col("block") + 1) * width) - F.greatest(F.col("start"), F.col("block") * width)).alias("length"))
    )

    def choose(sh: np.ndarray, s: np.ndarray, n: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        epoch = j // n
        key = mix64(np.uint64(seed) + s.astype(np.uint64) * np.uint64(0x100000001B3) + epoch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = permuted(j % n, n, key)
        place = mix64(sh.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + mix64(j.astype(np.uint64)) + s.astype(np.uint64)) >> np.uint64(1)
        return pa.RecordBatch.from_arrays([pa.array(sh), pa.array(place.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(epoch), pa.array(at)], ["shard", "place", "sid", "epoch", "block"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                top = batch.column(0)[k].as_py()
                sid, at, n, each = (batch.column(c)[k].values.to_numpy() for c in (1, 2, 3, 4))
                at = at.copy()
                for shard, drawn in enumerate(draws(n, shard_slots, [seed, top])):
                    j = np.arange(int(drawn.sum())) - np.repeat(np.cumsum(drawn) - drawn, drawn) + np.repeat(at, drawn)
                    at += drawn
                    yield choose(np.full(len(j), top * per_super + shard, np.int64), np.repeat(sid, drawn), np.repeat(each, drawn), j)

    slots = plan.repartition(max(1, min(len(counts), MAX_SUPER)), "super").select("super", "sid", "first", "n", "blocks").mapInArrow(spread, "shard bigint, place bigint, sid int, epoch bigint, block bigint")
    return Mixture(rows, sources, slots, pieces)


SLICES = "array<struct<at:bigint,length:bigint,times:bigint>>"


def cut_words(text: str, slices: list[tuple[int, int]]) -> str:
    """The words of the slices (first word, number) as they stand in the text, apart by line ends; slices that touch are one."""
    spans = [m.span() for m in WORDS.finditer(text)]
    merged: list[list[int]] = []
    for at, n in sorted(slices):
        if merged and merged[-1][1] == at:
            merged[-1][1] = at + n
        else:
            merged.append([at, at + n])
    if len(merged) == 1 and merged[0] == [0, len(spans)]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epoch_col: str | None = None, **options) -> DataFrame:
    """The mix as rows of ``df``: for a row one row for each epoch that takes words of it, with those words as its text, and the epoch's number in ``epoch_col`` if that is given.

    Rows are numbered once, in a stored copy, so rows that are equal in any or all columns stay apart; the text moves once, to its slices."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = stored(df.select(F.monotonically_increasing_id().alias("_number"), whole), "mix-rows")
    field = lambda c: F.col(f"_row.`{c}`")
    keyed = rows.select("_number", field(id_col).alias("_id"), field(text_col).cast("string").alias("_text"), field(source_col).alias("_source"))
    mix = mixture(keyed, id_col="_id", text_col="_text", source_col="_source", row_col="_number", **options)
    times = mix.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    each = mix.pieces.join(times, ["sid", "block"]).groupBy("row").agg(F.collect_list(F.struct("at", "length", "times")).alias("_slices"))
    small_batches(df.sparkSession)
    found = rows.join(each, F.col("_number") == F.col("row")).select("_row", field(text_col).cast("string").alias("_text"), F.col("_slices").cast(SLICES).alias("_slices"))
    at = rows.schema["_row"].dataType.fieldNames().index(text_col)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, epoch, out = [], [], []
        for k, (t, slices) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            for copy in range(max(x["times"] for x in slices)):
                place.append(k)
                epoch.append(copy)
                out.append(cut_words(t or "", [(x["at"], x["length"]) for x in slices if x["times"] > copy]))
        row = batch.column(0).take(pa.array(place, pa.int64()))
        return pa.RecordBatch.from_arrays([row, pa.array(epoch, pa.int64()), pa.array(out, pa.string())], ["_row", "_epoch", "_text"])

    # the row goes without its text, which stands beside it
    bare = F.col("_row").withField(f"`{text_col}`", F.lit(None).cast(rows.schema["_row"].dataType[at].dataType))
    out = map_batches(found.withColumn("_row", bare), cut, T.StructType([rows.schema["_row"], T.StructField("_epoch", T.LongType()), T.StructField("_text", T.StringType())]))
    epoch = [F.col("_epoch").alias(epoch_col)] if epoch_col else []
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns], *epoch)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixture(documents(spark, sf_dir)).taken()
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
