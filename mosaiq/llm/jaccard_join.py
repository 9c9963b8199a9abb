"""Exact Jaccard self-join of documents' word n-gram sets: size-aware, heavy and light.

Sets are ordered by an agreed order of n-grams, rarest first. Two sets that reach the threshold share at
least L n-grams among the first ``size - ceil(t * size) + L`` of each (the L-prefix). A small set (up to the
boundary) enumerates all subsets of L = 2 n-grams of its 2-prefix; the sets above the boundary are found by
scanning inverted lists of single n-grams of their 1-prefix. Sets so near above the boundary that a small one
can reach them do both. The boundary is the size at which the counted cost of all rows is least.

The order comes from a count sketch of fixed size, then from the n-grams' lengths; it decides cost only, never a
result, as any order that all sets agree on is exact. Equal sets meet as one node.

Lists stay short of pairs by an exact bound. Of two sets let A be the one whose prefix ends first in the order:
every n-gram of A's prefix that the other holds is in the other's prefix too, so it has a list of two sets or
more. A's n-grams without such a list are missing in the other, and what is left of A bounds the intersection
(its cap). Pairs whose cap is under the needed intersection are never made. In a list, members are first compared
with one pivot each, the member with the least missing; then only lists that hold sets of different components
that the bound lets through are compared further, by growing distance in the list, until each such pair was
compared. So no link between different sets is lost, and copies are not expanded into pairs. What can remain
are groups of many sets that are all just under the threshold with each other and in components of their own.
N-grams are 64-bit codes, sets 128-bit hashes.

Null and empty texts, and texts of white space, have an empty set, and link with nothing. Texts with fewer
words than n have one n-gram of all their words. Repeated rows are kept; a null id takes part in links but is
nobody's smallest id. An empty table gives no rows. Only the named columns are read. The threshold must be
over 50 percent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.graph import components
from mosaiq.llm.sketch import SlotCounts, levels, rare_first
from mosaiq.llm.textutil import bit_filter, discard, documents, forget_tokens, free_shuffles, passes, raw_texts, shingles, sized_words, small_batches, stored

LARGEST_SMALL = 256  # the boundary is looked for up to this size
LIST_SAMPLE = 4096  # one of so many n-grams is counted for the cost of scanning a list
FIRST_REACH, WIDER = 16, 8
PARITY_BITS, PRUNINGS = 1024, 1
MASKED = 62  # n-grams of a 2-prefix that a mask holds; sets with a longer one have no cap


def gram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct codes of the n-grams of a text, A-Z in lower case: a hash under 6 bits of the n-gram's length, so that long ones, which are rarely met by chance, come first."""
    words, sizes = sized_words(raw.lower())
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    k = min(n, len(words))
    length = np.uint64(63) - np.minimum((ends[k:] - ends[:-k]) // 2, 63).astype(np.uint64)
    return np.unique((length << np.uint64(58)) | (shingles(words, n) >> np.uint64(6)))


def parity(grams: np.ndarray) -> bytes:
    """For each of ``PARITY_BITS`` places whether an odd number of the codes falls there: two sets differ in as many codes as these bits differ, at least."""
    at = np.bincount(((grams >> np.uint64(20)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((at & 1).astype(np.uint8)).tobytes()


def needed(size, percent: int):
    """The least intersection of a set of ``size`` with a set that it links with."""
    return -(-size * percent // 100)


def reached(a, b, percent: int):
    """The least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-(a + b) * percent // (100 + percent))


def _profile(df: DataFrame, n: int) -> DataFrame:
    """One pass: rows ``row, id, size, s1, s2, bits`` of documents, and with null row the sketch's and the sample's counts."""
    import xxhash

    names = ["row", "id", "size", "s1", "s2", "bits", "part", "counts", "gram", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokens()
        sketch, sample, id_type = None, {}, None
        row = TaskContext.get().partitionId() << 36

        def others(part: list, counts: list, gram: list, count: list) -> pa.RecordBatch:
            none = pa.nulls(len(gram), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(gram), id_type), none, none, none, pa.nulls(len(gram), pa.binary()), pa.array(part, pa.int32()), pa.array(counts, pa.binary()), pa.array(gram, pa.int64()), pa.array(count, pa.int64())], names)

        for batch in batches:
            id_type, sketch = batch.schema.field(0).type, sketch or SlotCounts()
            sizes, sig, bits = [], [], []
            for raw in raw_texts(batch.column(1)):
                grams = gram_set(raw, n)
                sizes.append(len(grams))
                bits.append(parity(grams))
                d = xxhash.xxh3_128_digest(grams.tobytes())
                sig.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                sketch.add(grams)
                for g in grams[(grams >> np.uint64(30)) % np.uint64(LIST_SAMPLE) == 0].astype(np.int64).tolist():
                    sample[g] = sample.get(g, 0) + 1
            if len(sample) > 100_000:
                k = len(sample)
                yield others([None] * k, [None] * k, list(sample), list(sample.values()))
                sample = {}
            k = len(sizes)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), batch.column(0), pa.array(sizes, pa.int64()), pa.array([x[0] for x in sig], pa.int64()), pa.array([x[1] for x in sig], pa.int64()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), none, none], names)
            row += k
        if id_type is not None:
            at, packed = sketch.parts()
            yield others(at, packed, [None] * len(at), [None] * len(at))
            k = len(sample)
            yield others([None] * k, [None] * k, list(sample), list(sample.values()))

    id_type = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"row bigint, id {id_type}, size bigint, s1 bigint, s2 bigint, bits binary, part int, counts binary, gram bigint, count bigint")


def _boundary(profile: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs least, from the counts of sizes and the mean length of lists."""
    sizes = dict(profile.where("row is not null and size > 0").groupBy(F.least("size", F.lit(4 * LARGEST_SMALL)).alias("size")).count().collect())
    lists = profile.where("gram is not null").groupBy("gram").agg(F.sum("count").alias("n")).where("n <= 64").agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    scanned = lists[0] / lists[1] if lists[1] else 1.0
    best, cost = 0, None
    for b in range(0, LARGEST_SMALL + 1):
        small = sum(c * max(1, (k - needed(k, percent) + 2) * (k - needed(k, percent) + 1) // 2) for k, c in sizes.items() if k <= b * 100 // percent)
        large = sum(c * (k - needed(k, percent) + 1) * scanned for k, c in sizes.items() if k > b)
        if cost is None or small + large < cost:
            best, cost = b, small + large
    return best


POSTING = ["key", "s1", "s2", "last", "ij"]
POSTING_TYPES = "key bigint, s1 bigint, s2 bigint, last bigint, ij smallint"


def keys_of(grams: np.ndarray, rare: np.ndarray, percent: int, boundary: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(keys, rank of the prefix's last n-gram, places) of a set's subsets, odd keys with the places i * 64 + j of their n-grams in the 2-prefix (-1 where it is longer than ``MASKED``), and of its single n-grams, even keys."""
    size = len(grams)
    c = int(needed(size, percent))
    ranks = rare_first(grams, grams, rare)
    order = np.argsort(ranks, kind="stable")[: size - c + 2]
    first, out = grams[order], []
    last = lambda k: int(ranks[order[k]] >> np.uint64(1))
    if size * percent <= boundary * 100 and size > 1:
        i, j = np.array(list(combinations(range(len(first)), 2))).T
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        key = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        out.append((key, last(-1), (i * 64 + j if len(first) <= MASKED else np.full(len(i), -1)).astype(np.int16)))
    if size > boundary:
        k = size - c + 1
        out.append((first[:k] & ~np.uint64(1), last(min(k, len(order)) - 1), np.zeros(k, np.int16)))
    return out


def _postings(df: DataFrame, n: int, percent: int, boundary: int, order: np.ndarray) -> DataFrame:
    """``key, s1, s2, last, ij``: a set's subsets and single n-grams. A task gives each set once."""
    import xxhash

    shared = df.sparkSession.sparkContext.broadcast(order.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokens()
        rare, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            key, s1, s2, last, ij = [], [], [], [], []
            for raw in raw_texts(batch.column(0)):
                grams = gram_set(raw, n)
                d = xxhash.xxh3_128_digest(grams.tobytes())
                if not len(grams) or d in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(d)
                for k, end, places in keys_of(grams, rare, percent, boundary):
                    key.append(k)
                    s1.append(np.full(len(k), int.from_bytes(d[:8], "little", signed=True), np.int64))
                    s2.append(np.full(len(k), int.from_bytes(d[8:], "little", signed=True), np.int64))
                    last.append(np.full(len(k), end, np.int64))
                    ij.append(places)
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (s1, s2, last, ij))], POSTING)

    return df.select("text").mapInArrow(run, POSTING_TYPES)


def _shared_lists(postings: DataFrame) -> DataFrame:
    """The postings of the keys that different sets share, without repeats, by one scan of the sorted rows that holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)  # the last set of the open key
        told = False  # whether the open key was found shared, and its held row given
        for batch in batches:
            x = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            x = np.concatenate([held, x])
            new = np.ones(len(x), bool)
            new[1:] = (x[1:, :3] != x[:-1, :3]).any(axis=1)
            y = x[new]  # rows equal to the one before are repeats
            given_first = told and held.size > 0
            same_next = np.zeros(len(y), bool)
            same_next[:-1] = y[1:, 0] == y[:-1, 0]
            same_before = np.zeros(len(y), bool)
            same_before[1:] = same_next[:-1]
            out = same_next | same_before
            last_told = bool(out[-1]) or (given_first and len(y) == 1)
            if given_first:
                out[0] = False
            if out.any():
                z = y[out]
                yield pa.RecordBatch.from_arrays([*(pa.array(z[:, k].copy()) for k in range(4)), pa.array(z[:, 4].astype(np.int16))], POSTING)
            held, told = y[-1:], last_told

    return postings.repartition("key").sortWithinPartitions("key", "s1", "s2").mapInArrow(run, POSTING_TYPES)


def _capped(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (key, size, node, last, ij) and ``cap``: a set's n-grams less those of its prefix that have no list here, for its single n-grams and for its subsets apart."""
    odd = F.col("key") % 2 != 0
    bits = F.expr("shiftleft(1L, cast(shiftright(ij, 6) AS int)) | shiftleft(1L, cast(ij AS int) & 63)")
    caps = members.groupBy("node").agg(
        F.min("size").alias("size"), F.count_if(~odd).alias("singles"), F.bit_or(F.when(odd & (F.col("ij") >= 0), bits)).alias("mask"), F.coalesce(F.bool_or(odd & (F.col("ij") < 0)), F.lit(False)).alias("wide")
    )
    c = F.expr(f"(size * {percent} + 99) div 100")
    two = F.when(F.col("wide"), F.col("size")).otherwise(c - 2 + F.bit_count(F.coalesce("mask", F.lit(0).cast("bigint"))))
    caps = caps.select("node", (c - 1 + F.col("singles")).alias("one"), two.alias("two"))
    return members.drop("cap").join(caps, "node").withColumn("cap", F.when(odd, F.col("two")).otherwise(F.col("one")).cast("bigint")).drop("one", "two")


def _may_link(a: dict, b: dict, percent: int):
    """Whether a list's members (size, cap, last) pass the bounds of size and cap."""
    need = F.expr(f"(({a['size']} + {b['size']}) * {percent} + {99 + percent}) div {100 + percent}")
    cap = F.expr(f"CASE WHEN {a['last']} < {b['last']} THEN {a['cap']} WHEN {a['last']} > {b['last']} THEN {b['cap']} ELSE least({a['cap']}, {b['cap']}) END")
    return (F.expr(f"least({a['size']}, {b['size']})") >= need) & (cap >= need)


def _sets(df: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, grams`` of the given nodes (``rep, s1, s2, node``), from one document of each; texts do not move."""
    import xxhash

    shared = df.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(F.xxhash64("rep"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))
            grams = [gram_set(raw, n) for raw in raw_texts(batch.column(1))]
            d = [xxhash.xxh3_128_digest(g.tobytes()) for g in grams]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            values = pa.array(np.concatenate(grams).view(np.int64) if grams else np.empty(0, np.int64))
            sig = [pa.array([int.from_bytes(x[k : k + 8], "little", signed=True) for x in d], pa.int64()) for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([*sig, pa.ListArray.from_arrays(pa.array(offsets), values)], ["s1", "s2", "grams"])

    made = df.select(F.xxhash64("id").alias("h"), "text").mapInArrow(run, "s1 bigint, s2 bigint, grams array<bigint>")
    # the node follows from the signature, so rows stay where the join put them
    return made.join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).dropDuplicates(["s1", "s2", "node"]).select("node", "grams")


def _by_parity(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u, v``) whose sets' parities differ in no more places than those of linked sets can; sets of others need not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64) for k in (4, 5))
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            yield batch.select(["u", "v"]).filter(pa.array(differ <= m + n - 2 * reached(m, n, percent)))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}size"), F.col("bits").alias(f"{x}bits"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "usize", "vsize", "ubits", "vbits")
    return both.mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (``u, v``) whose sets reach the threshold, stored."""
    pairs = stored(pairs, "join-pairs")
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = stored(nodes.join(ends, "node", "left_semi"), "join-wanted")
    sets = stored(_sets(df, wanted, n), "join-sets")
    discard(wanted)
    a = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    links = stored(pairs.join(a, "u").join(b, "v").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v"), "join-links")
    discard(pairs, sets)
    return links


ROW = ["key", "size", "node", "label", "cap", "last"]


def _fitting(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows (as ``ROW``) of one list are of different components and pass the bounds of size and cap."""
    need = reached(x[:, 1], y[:, 1], percent)
    cap = np.where(x[:, 5] < y[:, 5], x[:, 4], np.where(x[:, 5] > y[:, 5], y[:, 4], np.minimum(x[:, 4], y[:, 4])))
    return (x[:, 0] == y[:, 0]) & (x[:, 3] != y[:, 3]) & (np.minimum(x[:, 1], y[:, 1]) >= need) & (cap >= need)


def _with_partner(members: DataFrame, least: int, reach: int, percent: int) -> DataFrame:
    """``ROW`` and ``place`` (in the list) of the members with a partner that fits them ``least`` up to less than ``reach`` places away; one scan of the sorted rows that holds ``reach`` rows twice."""
    names = [*ROW, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, key, n = np.empty((0, 7), np.int64), np.empty(0, bool), None, 0
        for batch in batches:
            new = np.column_stack([batch.column(k).to_numpy() for k in range(6)])
            begins = np.concatenate([[True], new[1:, 0] != new[:-1, 0]])
            at = np.arange(len(new))
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            if new[0, 0] == key:
                place[: int(begins[1:].argmax()) + 1 if begins[1:].any() else len(new)] += n
            key, n = new[-1, 0], place[-1] + 1
            old = len(held)
            x = np.concatenate([held, np.column_stack([new, place])])
            told = np.concatenate([told, np.zeros(len(new), bool)])
            for d in range(least, min(reach, len(x))):
                first = max(0, old - d)
                ok = first + np.flatnonzero(_fitting(x[first : len(x) - d], x[first + d :], percent))
                told[ok] = told[ok + d] = True
            keep = min(reach - 1, len(x))
            done = x[: len(x) - keep][told[: len(x) - keep]]
            if len(done):
                yield pa.RecordBatch.from_arrays([pa.array(done[:, k].copy()) for k in range(7)], names)
            held, told = x[len(x) - keep :], told[len(x) - keep :]
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(held[told, k].copy()) for k in range(7)], names)

    return members.repartition("key").sortWithinPartitions("key", "size", "node").select(*ROW).mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _near_pairs(members: DataFrame, bits: DataFrame, least: int, reach: int, percent: int) -> DataFrame:
    """Pairs (``u, v``) of a list's members that fit and whose places in the list are ``least`` up to less than ``reach`` apart, if their sets' parities (``node, bits``) differ in no more places than those of linked sets can; one scan of the sorted rows that holds ``reach`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parities = np.empty((0, 7), np.int64), np.empty((0, PARITY_BITS // 64), np.uint64)
        for batch in batches:
            old = len(held)
            x = np.concatenate([held, np.column_stack([batch.column(k).to_numpy() for k in range(7)])])
            parities = np.concatenate([parities, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(batch.num_rows, -1)])
            found = []
            for d in range(1, min(reach, len(x))):
                first = max(0, old - d)
                a, b = x[first : len(x) - d], x[first + d :]
                apart = b[:, 6] - a[:, 6]
                at = first + np.flatnonzero((apart >= least) & (apart < reach) & _fitting(a, b, percent))
                differ = np.bitwise_count(parities[at] ^ parities[at + d]).sum(axis=1, dtype=np.int64)
                at = at[differ <= x[at, 1] + x[at + d, 1] - 2 * reached(x[at, 1], x[at + d, 1], percent)]
                found.append(np.column_stack([x[at, 2], x[at + d, 2]]))
            pairs = np.unique(np.concatenate(found), axis=0) if found else held[:0, :2]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])
            keep = min(reach - 1, len(x))
            held, parities = x[len(x) - keep :], parities[len(x) - keep :]

    rows = _with_partner(members, least, reach, percent).join(bits, "node").select(*ROW, "place", "bits")
    return rows.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(run, "u bigint, v bigint").distinct()


def _open(labelled: DataFrame, percent: int, done: int) -> DataFrame:
    """The members of lists longer than ``done`` that still can link with a member of another component, with their list's ``length``.

    A member whose own cap allows a link with the list's smallest set, or the smallest that it can link with at all, is active; in every pair
    that the bounds let through the one whose prefix ends first is. So a member stays if it is active, or if its prefix ends after that of an
    active one of another component.
    """
    mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.min("size").alias("small")).where((F.col("least") != F.col("most")) & (F.col("n") > done))
    c = f"greatest(small, (size * {percent} + 99) div 100)"
    told = labelled.join(mixed.select("key", "small"), "key").withColumn("active", F.expr(f"cap >= ((size + {c}) * {percent} + {99 + percent}) div {100 + percent}"))
    by = told.groupBy("key").agg(*[f(F.when(F.col("active"), F.col(x))).alias(y) for f, x, y in ((F.min, "label", "lo"), (F.max, "label", "hi"), (F.min, "last", "from"))]).where("lo is not null")
    stay = told.join(by, "key").where(F.col("active") | ((F.col("last") >= F.col("from")) & ((F.col("lo") != F.col("hi")) | (F.col("label") != F.col("lo")))))
    stay = stay.select(*ROW, "ij")
    lists = stay.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("length")).where(F.col("least") != F.col("most"))
    return stay.join(lists.select("key", "length"), "key")


def jaccard_join(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, n_shingles, component_id`` of every row; ``row`` tells repeated ids apart."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, and 100 at most")
    spark = df.sparkSession
    small_batches(spark)
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(_profile(df, n), "join-profile")
    order, boundary = levels(profile.where("part is not null").select("part", "counts")), _boundary(profile, percent)
    rows = profile.where("row is not null").select("row", "id", "size", "s1", "s2", "bits")
    lists = stored(_shared_lists(_postings(df, n, percent, boundary, order)), "join-lists")
    free_shuffles(spark)
    nodes = rows.where("size > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.min("size").alias("size"), F.any_value("bits").alias("bits"))
    in_lists = stored(nodes.join(lists.select("s1", "s2").distinct(), ["s1", "s2"], "left_semi"), "join-nodes")
    bits = in_lists.select("node", "bits")
    members = stored(lists.join(in_lists, ["s1", "s2"]).select("key", "size", "node", "last", "ij"), "join-members")
    discard(lists)
    for _ in range(PRUNINGS):  # a list that loses a member may cap the others lower
        fewer = stored(_open(_capped(members, percent).withColumn("label", F.col("node")), percent, 0).drop("label", "length"), "join-members")
        discard(members)
        members = fewer
    # first, each member with one pivot: of the pivots of its lists that which it meets most often
    pivots = members.groupBy("key").agg(F.max(F.struct((F.col("cap") - F.col("size")).alias("free"), "last", (-F.col("node")).alias("to"), "size", "cap")).alias("p"))
    fits = _may_link({"size": "size", "cap": "cap", "last": "last"}, {"size": "p.size", "cap": "p.cap", "last": "p.last"}, percent)
    met = members.join(pivots, "key").where((F.col("node") != -F.col("p.to")) & fits).groupBy(F.col("node").alias("u"), (-F.col("p.to")).alias("v")).agg(F.count("*").alias("met"))
    best = met.groupBy("u").agg(F.max_by("v", F.struct("met", -F.col("v"))).alias("v"))
    links = _verified(_by_parity(best, in_lists, percent), in_lists, df, n, percent)
    labels = stored(components(links, "join-components"), "join-labels")
    reach, done = FIRST_REACH, 0
    while True:
        labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        part = stored(_open(labelled, percent, done), "join-open")
        longest = part.agg(F.max("length")).first()[0]
        if longest is None:
            discard(part)
            break
        more = _verified(_near_pairs(part, bits, max(done, 1), reach, percent), in_lists, df, n, percent)
        # a component's links so far are the stars of its label
        stars = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        joined = stored(components(stars.unionByName(more), "join-components"), "join-labels")
        discard(labels, more, members)
        labels, members = joined, part.drop("label", "length")
        members.scratch_path = part.scratch_path
        if longest <= reach:
            break
        reach, done = WIDER * reach, reach
    discard(members, in_lists)
    classes = nodes.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
    classed = rows.join(classes, ["s1", "s2"], "left").withColumn("label", F.when(F.col("size") > 0, F.col("label")).otherwise(F.col("row")))
    least = classed.groupBy("label").agg(F.min("id").alias("component_id"))
    return classed.join(least, "label").select("row", "id", F.col("size").alias("n_shingles"), "component_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP4_ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sets AS (SELECT DISTINCT doc_id, g FROM grams
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), edges AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked
), reached AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, b.v FROM reached r JOIN edges b ON b.u = r.v
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reached GROUP BY u) c USING (doc_id)
"""
