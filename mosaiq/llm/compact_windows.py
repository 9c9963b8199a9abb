"""Near-duplicate passages by compact windows of token min-hashes.

Tokens are word 5-grams. For each of four hash functions the Cartesian tree over a document's token ranks
groups its subsequences: a node at c whose subtree spans a..b stands for all subsequences [l, r] with
a <= l <= c <= r <= b, which share c's min-hash. Only nodes that span a passage's least length are made: they
are the minima of the sliding windows of that length, and their bounds the nearest smaller ones among them.

A candidate must share the min-hashes of ``ENOUGH`` = 2 functions over one subsequence. The functions stand in two
groups of two; in a document the windows of a group are joined as intervals, and a joint window, the overlap of
two that hold a subsequence of the least length, is keyed by both min-hashes. So joint windows of two documents
that meet by key are windows that overlap in both functions on both sides, and windows that agree in one function
alone, as many do by chance, never meet. A passage that two documents share exactly lies in such a pair in each
group; one of Jaccard similarity s meets in a group with a chance of s * s for each of its subsequences.

In a list of joint windows each is paired with the first document's. Pairs of two documents
are one request, of at most ``LONGEST`` tokens of each, and these tokens alone move for it. Passages are then
verified: blocks of equal tokens are followed from the shared token to both sides, and of the stretches from a block's
start to a block's end, of ``LEAST`` words or more, those with a Jaccard similarity of ``SIMILARITY`` or more are
passages, whatever lies between. Windows of lists of three documents or more that no passage covers then meet all
others of their list, those that matched too; and documents whose copies go on alike beyond the end of the first
document's meet by the least length of tokens that ends one beyond it. Tokens that stand out as frequent (by a sketch of fixed size, the same
for any dealing of rows) rank last, so common lines make no lists unless all of a window is common.

Exactly repeated passages are always found. Near copies are found with a
chance; README has the measured recall. Null and empty texts have no passages, nor have texts shorter than ``LEAST`` words. Rows of
equal text are one document (by the 64-bit hash of the text), repeated as a whole if it has ``LEAST`` words, and each
row gets the result. An empty table gives no rows. Only the named columns are read. The result does not depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.sketch import SLOT, levels, slot_counts
from mosaiq.llm.textutil import bit_filter, discard, documents, map_batches, mix64, passes, raw_texts, shingles, small_batches, stored, word_hashes

WIDTH, LEAST, SIMILARITY = 5, 50, 0.8
GROUPS, ENOUGH = 3, 2  # groups of hash functions, functions of a group
OFTEN = 5  # a token is frequent if it is met 2**5 times above what chance puts in its slot
LONGEST, AROUND = 4096, 256  # tokens of a request before it is cut; verified on either side of a shared token at a time, what is longer has more of them
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = "key bigint, doc bigint, a int, c int, b int"
PAIR = "key bigint, doc bigint, a int, c int, b int, pdoc bigint, pa int, pc int, pb int, more boolean"
REQUEST = "doc bigint, pdoc bigint, lo int, hi int, plo int, phi int, places array<int>, pplaces array<int>"


def tokens(raw: bytes) -> np.ndarray:
    """Hashes of a text's word 5-grams in order, A-Z in lower case; fewer words than that: none."""
    words = word_hashes(raw.lower())
    return shingles(words, WIDTH) if len(words) >= WIDTH else np.empty(0, np.uint64)


def _tree(ranks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of the nodes that span ``least`` or more, by place, and for each sliding window of that length its node."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    low, width = place, 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if least > width:
        low = np.minimum(low[: len(low) - (least - width)], low[least - width :])
    new = np.concatenate([[True], low[1:] != low[:-1]])
    node, low = np.cumsum(new) - 1, low[new]
    c = order[low].astype(np.int32)
    at, value = c.tolist(), low.tolist()
    a, b, stack = [0] * len(at), [n - 1] * len(at), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            b[stack.pop()] = at[k] - 1
        a[k] = at[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return np.array(a, np.int32), c, np.array(b, np.int32), node


def compact_windows(ranks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of the Cartesian tree's nodes that span ``least`` positions or more; of equal ranks the leftmost is the smallest."""
    return _tree(ranks, least)[:3] if len(ranks) >= least else (np.empty(0, np.int32),) * 3


def joint_windows(t: np.ndarray, often: np.ndarray, least: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, c, b) of the overlaps of a group's compact windows that hold a subsequence of ``least`` tokens; c is the first function's minimum."""
    trees, hashes = [], []
    for k in range(ENOUGH):
        h = t * np.uint64((2 * (group * ENOUGH + k) + 1) * 0x9E3779B97F4A7C15 % 2**64)  # tokens are mixed already
        h ^= h >> np.uint64(32)
        trees.append(_tree((often.astype(np.uint64) << np.uint64(63)) | (h >> np.uint64(1)), least))
        hashes.append(h)
    new = np.zeros(len(trees[0][3]), bool)
    new[0] = True
    for x in trees:
        new[1:] |= x[3][1:] != x[3][:-1]
    at = np.flatnonzero(new)
    key, a, b = np.full(len(at), np.uint64(group), np.uint64), np.zeros(len(at), np.int32), np.full(len(at), len(t) - 1, np.int32)
    for (low, c, high, node), h in zip(trees, hashes):
        key = mix64(key + h[c[node[at]]])
        a, b = np.maximum(a, low[node[at]]), np.minimum(b, high[node[at]])
    return key.view(np.int64), a, trees[0][1][trees[0][3][at]], b


def _windows(df: DataFrame, order: np.ndarray, least: int, groups: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((order >= OFTEN).tobytes())

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        frequent, out = np.frombuffer(shared.value, bool), []
        for doc, raw in zip(batch.column(0).to_numpy().tolist(), raw_texts(batch.column(1))):
            t = tokens(raw)
            if len(t) < least:
                continue
            often = frequent[t & SLOT]
            for group in range(groups):
                key, a, c, b = joint_windows(t, often, least, group)
                out.append((key, np.full(len(key), doc, np.int64), a, c, b))
        cols = [np.concatenate([x[k] for x in out]) for k in range(5)] if out else [np.empty(0, d) for d in (np.int64, np.int64, np.int32, np.int32, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "doc", "a", "c", "b"])

    return map_batches(df.select("doc", "text"), make, WINDOW)


def _pair_batch(z: np.ndarray) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 3]
    return pa.RecordBatch.from_arrays([*(pa.array(z[:, k].copy()).cast(t) for k, t in enumerate(types)), pa.array(z[:, 9] != 0)], ["key", "doc", "a", "c", "b", "pdoc", "pa", "pc", "pb", "more"])


def _paired(windows: DataFrame) -> DataFrame:
    """Each window of a list with the first window of its first document, if that is another document, and the first document's other windows with the second's first: one scan of the sorted rows that holds the open list's windows of one document. ``more``: whether a document before it in the list had met the first one; it is sure to be set for the third document on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, second = np.empty((0, 5), np.int64), None  # the first document's windows of the open key; its second document, once met
        for batch in batches:
            before = held[0, 0] if len(held) else None
            x = np.concatenate([held, np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])])
            new = np.ones(len(x), bool)
            new[1:] = x[1:, 0] != x[:-1, 0]
            at = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            first = x[at]
            other = x[:, 1] != first[:, 1]
            # the first row of another document, for each list
            starts, begins = np.unique(at[other], return_index=True)
            second_doc = np.zeros(len(x), np.int64)
            second_doc[starts] = x[np.flatnonzero(other)[begins], 1]
            if second is not None and before is not None:
                second_doc[0] = second
            more = other & (x[:, 1] != second_doc[at])
            z = [np.column_stack([x, first[:, 1:], more])[other]]
            for start in np.unique(at[~other & ~new]).tolist():  # lists whose first document has several windows
                if second is not None and start == 0 and x[0, 0] == before:
                    continue
                end = start + int(np.searchsorted(at[start:], start, side="right"))
                others = np.flatnonzero(other[start:end])
                if len(others):
                    mine, row = x[start + 1 : start + others[0]], x[start + others[0]]
                    z.append(np.column_stack([np.repeat(row[None], len(mine), axis=0), mine[:, 1:], np.zeros(len(mine), np.int64)]))
            z = np.concatenate(z)
            if len(z):
                yield _pair_batch(z)
            last = int(at[-1])
            if other[last:].any():
                second = int(second_doc[last])
            elif x[last, 0] != before:
                second = None
            held = x[last : last + 1] if second is not None else x[last:]

    return windows.repartition("key").sortWithinPartitions("key", "doc", "c", "a").mapInArrow(run, PAIR)


def _requests(pairs: DataFrame) -> DataFrame:
    """Pairs of windows of two documents as one row: the stretches of both, and the places of the shared tokens; ``LONGEST`` tokens at most on either side, then the next begins."""
    names = [x.split()[0] for x in REQUEST.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

        for batch in batches:
            found = []
            for doc, pdoc, c, pc, lo, hi in zip(*(x.to_pylist() for x in batch.columns)):
                plo, phi = lo - c + pc, hi - c + pc
                if now and now[0] == doc and now[1] == pdoc:
                    edges = min(lo, now[2]), max(hi, now[3]), min(plo, now[4]), max(phi, now[5])
                    if edges[1] - edges[0] < LONGEST and edges[3] - edges[2] < LONGEST:
                        now[2:6] = edges
                        if c != now[6][-1] or pc != now[7][-1]:
                            now[6].append(c)
                            now[7].append(pc)
                        continue
                if now:
                    found.append(now)
                now = [doc, pdoc, lo, hi, plo, phi, [c], [pc]]
            if found:
                yield rows(found)
        if now:
            yield rows([now])

    away, half = F.col("c") - F.col("pc"), LONGEST // 2 - 1  # the rest of a longer overlap lies in other windows
    lo, hi = F.greatest("a", F.col("pa") + away, F.col("c") - half), F.least("b", F.col("pb") + away, F.col("c") + half)
    ranges = pairs.select("doc", "pdoc", "c", "pc", lo.alias("lo"), hi.alias("hi"))
    return ranges.repartition("doc", "pdoc").sortWithinPartitions("doc", "pdoc", "c", "pc", "lo").mapInArrow(run, REQUEST)


def _ends(u: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """``i, j, matched`` at the ends of the blocks of equal tokens from the shared first token on, until more than ``most`` tokens are unmatched; the next block is the nearest."""
    out, i, j, matched = [], 0, 0, 0
    while True:
        step = 64
        while True:
            n = min(step, len(u) - i, len(v) - j)
            differ = u[i : i + n] != v[j : j + n]
            k = int(differ.argmax()) if differ.any() else n
            i, j, matched = i + k, j + k, matched + k
            if k < step:
                break
            step *= 2
        out.append((i - 1, j - 1, matched))
        left, g, gap = most - (i - matched) - (j - matched), 16, None
        near = u[i : i + WIDTH + 1] == v[j : j + WIDTH + 1] if min(len(u) - i, len(v) - j) > WIDTH else np.zeros(1, bool)
        if near.any():  # one word replaced
            k = int(near.argmax())
            if 2 * k > left:
                return np.array(out)
            i, j = i + k, j + k
            continue
        while left > 0 and i < len(u) and j < len(v):
            _, p, q = np.intersect1d(u[i : i + g], v[j : j + g], return_indices=True)
            if len(p) and ((p + q).min() < g or g > left):
                gap = int((p + q).argmin())
                break
            if g > left:
                break
            g *= 4
        if gap is None or p[gap] + q[gap] > left:
            return np.array(out)
        i, j = i + int(p[gap]), j + int(q[gap])


def verified(x: np.ndarray, y: np.ndarray, window: tuple[int, ...], least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(l, r) in x and in y, in tokens, ends inside, of the near-duplicate passages around a pair of windows (a, c, b) and (pa, pc, pb): the one that reaches farthest left and the one that reaches farthest right."""
    a, c, b, pa_, pc, pb = window
    if x[c] != y[pc]:
        return []
    left, right = min(c - a, pc - pa_), min(b - c, pb - pc)
    left, right = left + left // 4 + 8, right + right // 4 + 8  # words may be put in
    a, b, pa_, pb = max(a, c - left), min(b, c + right), max(pa_, pc - left), min(pb, pc + right)
    u, v = x[a : b + 1], y[pa_ : pb + 1]
    common = min(int(np.isin(u, v).sum()), int(np.isin(v, u).sum()))
    if common * (1 + similarity) < 2 * similarity * least:
        return []
    most = common * (1 - similarity) / similarity
    before, after = _ends(u[c - a :: -1], v[pc - pa_ :: -1], most), _ends(u[c - a :], v[pc - pa_ :], most)
    n, m, both = (before[:, None, k] + after[None, :, k] + (1, 1, -1)[k] for k in range(3))
    near = (np.minimum(n, m) >= least) & (both >= similarity * (n + m - both))

    distinct = len(np.unique(u)) == len(u) and len(np.unique(v)) == len(v)

    def similar(l: int, r: int) -> bool:
        if distinct or both[l, r] == n[l, r] == m[l, r]:
            return True
        p, q = (np.unique(z[k - before[l, i] : k + after[r, i] + 1]) for z, k, i in ((x, c, 0), (y, pc, 1)))
        shared = len(np.intersect1d(p, q, assume_unique=True))
        return shared >= similarity * (len(p) + len(q) - shared)

    # of the stretches that begin at one place the widest is tried, and the block of the shared token itself
    found = {}
    for lefts, near_, turn in ((near.any(axis=1), near, False), (near.any(axis=0), near.T, True)):
        for l in np.flatnonzero(lefts)[::-1].tolist():
            r = int(np.flatnonzero(near_[l])[-1])
            l_, r_ = (r, l) if turn else (l, r)
            if (l_, r_) in found or similar(l_, r_):
                found[l_, r_] = True
                break
    if not found and near[0, 0]:
        found[0, 0] = True
    return [(c - int(before[l, 0]), c + int(after[r, 0]), pc - int(before[l, 1]), pc + int(after[r, 1])) for l, r in found]


def _arrays(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, t`` of the given documents: 32 bits of each token, in order. Texts do not move."""
    shared = df.sparkSession.sparkContext.broadcast(bit_filter(docs))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))
        t = [(tokens(raw) >> np.uint64(32)).astype(np.uint32).view(np.int32) for raw in raw_texts(batch.column(1))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *t])))], ["doc", "t"])

    return map_batches(df.select("doc", "text"), make, "doc bigint, t array<int>").join(docs, "doc", "left_semi").dropDuplicates(["doc"])


def _verify(requests: DataFrame, arrays: DataFrame, least: int, similarity: float) -> DataFrame:
    """``doc, l, r, other`` of verified passages on both sides."""
    for x in ("lo", "plo"):
        requests = requests.withColumn(x, F.greatest(F.col(x) - least, F.lit(0)))
    mine = requests.join(arrays, "doc").withColumn("x", F.expr(f"slice(t, lo + 1, hi + {least} - lo + 1)")).drop("t", "hi")
    theirs = arrays.select(F.col("doc").alias("pdoc"), F.col("t").alias("pt"))
    both = mine.join(theirs, "pdoc").select("doc", "pdoc", "lo", "plo", "places", "pplaces", "x", F.expr(f"slice(pt, plo + 1, phi + {least} - plo + 1)").alias("y"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        doc, pdoc, lo, plo = (batch.column(k).to_numpy().tolist() for k in range(4))
        places, pplaces, xs, ys = (batch.column(k) for k in range(4, 8))
        for k in range(len(doc)):
            x, y = xs[k].values.to_numpy(), ys[k].values.to_numpy()
            found: list[tuple[int, int, int, int]] = []
            failed: dict[int, int] = {}  # by diagonal the last place without a passage: what is equal on from there has none either
            for c, pc in zip((places[k].values.to_numpy() - lo[k]).tolist(), (pplaces[k].values.to_numpy() - plo[k]).tolist()):
                if any(s[0] <= c <= s[1] for s in found) and any(s[2] <= pc <= s[3] for s in found):
                    continue
                at = failed.get(c - pc)
                if at is not None and np.array_equal(x[at : c + 1], y[at - c + pc : pc + 1]):
                    continue
                near = (max(0, c - AROUND), c, min(len(x) - 1, c + AROUND), max(0, pc - AROUND), pc, min(len(y) - 1, pc + AROUND))
                got = verified(x, y, near, least, similarity)
                found += got
                if not got:
                    failed[c - pc] = c
            spans += [(doc[k], s[0] + lo[k], s[1] + lo[k], pdoc[k]) for s in found] + [(pdoc[k], s[2] + plo[k], s[3] + plo[k], doc[k]) for s in found]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in spans], t) for k, t in enumerate(types)], ["doc", "l", "r", "other"])

    return map_batches(both, make, "doc bigint, l int, r int, other bigint").groupBy("doc", "l", "r").agg(F.min("other").alias("other"))


def _uncovered(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The windows (``key, doc, a, c, b``) of lists of three documents or more whose token ``c`` is in no passage: one scan by place that holds the farthest end."""
    sides = pairs.select("key", "doc", "a", "c", "b").unionByName(pairs.select("key", *[F.col(f"p{x}").alias(x) for x in ("doc", "a", "c", "b")]))
    longer = pairs.where("more").select("key").distinct()
    windows = sides.join(longer, "key", "left_semi").distinct()
    marks = windows.select("doc", F.col("c").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("r"), "key", "a", "b").unionByName(
        found.select("doc", F.col("l").alias("at"), F.lit(0).alias("kind"), "r", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, end = None, -1
        for batch in batches:
            out = []
            for d, at, kind, r, key, a, b in zip(*(x.to_pylist() for x in batch.columns)):
                if d != doc:
                    doc, end = d, -1
                if kind == 0:
                    end = max(end, r)
                elif end < at:
                    out.append((key, d, a, at, b))
            if out:
                types = [pa.int64(), pa.int64(), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["key", "doc", "a", "c", "b"])

    return marks.repartition("doc").sortWithinPartitions("doc", "at", "kind").mapInArrow(run, WINDOW)


def _others(failed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every window of ``failed`` with the first window of all other documents of its list, but for those that it has met; two failed ones meet once."""
    sides = pairs.select("key", "doc", "a", "c", "b").unionByName(pairs.select("key", *[F.col(f"p{x}").alias(x) for x in ("doc", "a", "c", "b")]))
    listed = sides.join(failed.select("key").distinct(), "key", "left_semi").groupBy("key", "doc").agg(F.min(F.struct("c", "a", "b")).alias("w")).select("key", "doc", "w.*")
    mine = failed.select("key", *[F.col(x).alias(f"f{x}") for x in ("doc", "a", "c", "b")])
    later = F.col("fdoc") > F.col("doc")
    side = lambda p, x: F.when(later, F.col(p)).otherwise(F.col(x))
    names = ("doc", "a", "c", "b")
    met = mine.join(listed, "key").where("fdoc <> doc")
    met = met.select("key", *[side(f"f{x}", x).alias(x) for x in names], *[side(x, f"f{x}").alias(f"p{x}") for x in names])
    return met.distinct().join(pairs.select("key", "doc", "c", "pdoc", "pc"), ["key", "doc", "c", "pdoc", "pc"], "left_anti").select("key", "doc", "a", "c", "b", "pdoc", "pa", "pc", "pb")


def _edges(found: DataFrame, arrays: DataFrame, least: int) -> DataFrame:
    """Windows (``key, doc, a, c, b``) of exactly ``least`` tokens that reach one token beyond a passage's end, keyed by all of their tokens: documents whose copies go on alike where the first document's ends meet by them."""
    right = found.select("doc", (F.col("r") + 2 - least).alias("a"), (F.col("r") + 1).alias("c"))
    left = found.select("doc", (F.col("l") - 1).alias("a"), (F.col("l") - 1).alias("c"))
    ends = right.unionByName(left).where("a >= 0").distinct().join(arrays, "doc").where(F.col("a") + least <= F.size("t"))
    return ends.select(F.xxhash64(F.slice("t", F.col("a") + 1, F.lit(least))).alias("key"), "doc", "a", "c", (F.col("a") + least - 1).alias("b"))


def passages(df: DataFrame, least_words: int = LEAST, groups: int = GROUPS, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """``doc, first, end, other``: passages (words, end exclusive) of documents that occur nearly the same in ``other``; ``doc`` is ``xxhash64(text)``, so equal texts are one document."""
    small_batches(df.sparkSession, 500)
    text = F.col(text_col).cast("string")
    keyed = df.select(F.xxhash64(text).alias("doc"), text.alias("text"))
    least = max(1, least_words - WIDTH + 1)
    order = levels(slot_counts(keyed.select("text"), tokens))
    pairs = stored(_paired(_windows(keyed, order, least, groups)), "windows")
    requests = stored(_requests(pairs), "window-requests")
    docs = stored(requests.select("doc").unionByName(requests.select(F.col("pdoc").alias("doc"))).distinct(), "window-docs")
    arrays = stored(_arrays(keyed, docs), "window-tokens")
    discard(docs)
    first = stored(_verify(requests, arrays, least, similarity), "window-verified")
    discard(requests)
    failed = stored(_uncovered(pairs, first), "window-failed")
    beyond = _paired(_edges(first, arrays, least)).drop("more")
    rest = stored(_verify(_requests(_others(failed, pairs).unionByName(beyond)), arrays, least, similarity), "window-verified")
    discard(arrays, failed, pairs)
    return first.unionByName(rest).select("doc", F.col("l").cast("bigint").alias("first"), (F.col("r") + WIDTH).cast("bigint").alias("end"), "other")


def duplicate_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_passages, n_dup_words, spans, partner`` of every row: the union of its passages as first:end words, and the id of a document that holds one of them too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ids = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("doc"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n"))
    found = passages(df, text_col=text_col, **options).select("doc", "first", "end", "other")
    partner = ids.groupBy("doc").agg(F.min("id").alias("partner"), F.max("n").alias("n"), F.count("*").alias("copies"))
    # a text that several rows have is a passage as a whole
    copies = partner.where(F.col("copies") > 1).where(F.col("n") >= options.get("least_words", LEAST)).select("doc", F.lit(0).cast("bigint").alias("first"), F.col("n").alias("end"), F.col("doc").alias("other"))
    by_doc = found.unionByName(copies).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"), F.min("other").alias("other"))
    union = F.aggregate(
        "s",
        F.array().cast("array<struct<first:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    merged = by_doc.select("doc", union.alias("u"), "other")
    merged = merged.join(partner.select(F.col("doc").alias("other"), "partner"), "other", "left")
    words = F.aggregate("u", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    written = F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["first"], x["end"])), ",")
    return ids.join(merged, "doc", "left").select("id", F.coalesce(F.size("u"), F.lit(0)).cast("bigint").alias("n_passages"), F.coalesce(words, F.lit(0)).cast("bigint").alias("n_dup_words"), F.coalesce(written, F.lit("")).alias("spans"), "partner")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_passages(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
