"""The corpus operators against brute force, exact round trips, and tables of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import compact_windows, fertility, graph, jaccard_join, licenses, mixing, ogg, packing, rule_ensemble, secrets, token_orc
from mosaiq.llm.textutil import bit_filter, byte_bpe, default_vocabulary, passes, shared_path, shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY, PIECES = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# shared helpers


def test_word_hashes_follow_words():
    rng = random.Random(1)
    seen = {}
    for n in (0, 1, 5, 300, 90_000):
        text = "".join(rng.choice("ab é\t\n\v\f\r x 日") for _ in range(n)) + "y" * (n * 4)
        found = word_hashes(text.encode())
        want = WORD.findall(text)
        assert len(found) == len(want)
        for w, h in zip(want, found.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingles(word_hashes(b"a b"), 4)) == 1 and len(shingles(word_hashes(b""), 4)) == 0


def test_cached_ids_equal_the_library():
    t, bpe, rng = tokenizer(), byte_bpe(VOCABULARY), random.Random(2)
    texts = ["", " ", "\n", "a  b\n\n c\t\td  ", "foo <|endoftext|> bar", "x<|endoftext|> y", "it's don't '' 12 ab12 ,, ..\n\n\nzz   y", "日本 語 x　y", "né!? naïve... don't!"]
    texts += ["".join(rng.choice("ab'sé.,!1 \n\t ²") for _ in range(rng.randrange(60))) for _ in range(600)]
    assert all(np.frombuffer(bpe.ids(x), "<u4").tolist() == ids_of(t, x) for x in texts)


@pytest.mark.parametrize("held", [graph.HELD, 0])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 1 secrets


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_texts():
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(b64) for _ in range(n))
    return [
        "token: secret: abcdefghijklmnop password=short API_KEY = 'abcdef123456' x", "é" * 9 + " AKIA" + "A" * 13 + " AKIA" + "B" * 14, "0123456789abcdef" * 2 + "g" + "0" * 15,
        "secret=" + "f" * 40, f"blob {key(40)} and {key(64)} end", "plain prose with thereisaverylongwordwithoutdigitsatall inside 1234567890123456", "AbCdEf" * 6 + " abcabcabc123123123abcabcabc123", "", None,
    ]


def test_secret_scan_base_spans_and_battery(spark):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = secrets.scan(df).cache()
    cut = secrets.cuts(scanned)
    got = {r["id"]: (r["b"], r["a"]) for r in scanned.select("id", secrets.written(F.col("base")).alias("b"), secrets.written(secrets.all_spans(cut)).alias("a")).collect()}
    for k, t in enumerate(texts):
        assert got[k][0] == spans_text(base_spans(t or "")), t
        assert set(x for x in got[k][0].split(",") if x) <= set(got[k][1].split(","))
    assert got[4][1].count("random") == 2
    assert "random" not in got[5][1] and "random" not in got[6][1]


def plain_runs(rng, n):
    """Identifiers, paths and slugs of 20 characters or more that mix classes."""
    words = "read write config server handler response request table index buffer stream value parser token cache worker event signal matrix vector graph table node edge user account order price".split()
    out = []
    while len(out) < n:
        w = [rng.choice(words) for _ in range(rng.randint(3, 8))]
        kind = rng.randrange(5)
        x = {
            0: "".join([w[0], *map(str.title, w[1:])]), 1: "/".join(w) + f"/v{rng.randrange(9)}", 2: "-".join(w) + f"-{rng.randrange(2030)}", 3: "_".join(w).upper() + f"_{rng.randrange(99)}",
            4: "".join(map(str.title, w)) + str(rng.randrange(1000)),
        }[kind]
        if len(x) >= 20:
            out.append(x)
    return out


def test_battery_has_power_and_holds_its_false_share(spark):
    rng = random.Random(11)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [upper + upper.lower() + "0123456789+/", upper + "234567", "0123456789ABCDEF", upper + upper.lower() + "0123456789"]
    keys = ["".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(20, 64))) for k in range(300)]
    rows = [(k, f"see {t} there") for k, t in enumerate(plain_runs(rng, 2700) + keys)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    scanned = secrets.scan(df).cache()
    found = {r["id"] for r in scanned.select("id", secrets.all_spans(secrets.cuts(scanned)).alias("s")).where("exists(s, x -> x.kind = 3)").collect()}
    candidates = {r["id"] for r in scanned.where("size(mixed) > 0").collect()}
    long = [2700 + k for k, x in enumerate(keys) if len(x) >= 32 and 2700 + k in candidates]
    assert len(candidates) > 2900 and sum(k in found for k in long) >= 0.9 * len(long)
    assert sum(k < 2700 for k in found) <= 0.01 * len(found) + 1


def test_outer_span_of_a_key_that_holds_hex(spark):
    key = "Zk3x0123456789abcdef99QpLmTT8sVb2WqXy"
    out = secrets.redact(spark.createDataFrame([(1, f"a {key} b"), (2, "0123456789abcdef0123")], "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "a [secret] b", 2: "[secret]"}


def test_secret_scan_of_odd_rows(spark, odd, odd_rows, empty):
    path = shared_path(spark, "secret-odd")
    odd.write.parquet(f"{path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.op1_secret_scan(spark, path).collect())
    want = Counter()
    for k, t, *_ in odd_rows:
        spans = base_spans(t or "")
        by = Counter(kind for _, kind, _ in spans)
        want[(k, by[0], by[1], by[2], hashlib.sha256(spans_text(spans).encode()).hexdigest())] += 1
    assert got == want and "PythonUDF" not in (plan := secrets.scan(odd)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).columns == empty.columns and secrets.redact(empty).count() == 0
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == len(odd_rows)


def test_redaction_by_brute_force(spark):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = secrets.scan(df)
    spans = {r["id"]: [(x["start"], x["end"]) for x in r["s"]] for r in scanned.select("id", secrets.all_spans(secrets.cuts(scanned)).alias("s")).collect()}
    for r in secrets.redact(df).collect():
        t, out, at = texts[r["doc_id"]], "", 0
        for a, b in spans[r["doc_id"]]:
            if a >= at and not (a < at):
                out, at = out + t[at:a] + "[secret]", b
            else:
                at = max(at, b)
        assert r["text"] == (None if t is None else out + t[at:])


# 2 ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_round_trip_and_damage():
    assert all(ogg.page_checksum(x) == slow_crc(x) for x in (b"", b"a", b"OggS123" * 9))
    for raw in (b"", b"q", b"x" * 200_000, b"y" * 576, b"z" * (255 * 576)):
        media = ogg.encode_text(raw)
        s = ogg.decode_media(media)
        assert s.payload[: len(raw)] == raw and set(s.payload[len(raw) :]) <= {255} and len(s.payload) % 576 == 0 and s.payload and s.n_bytes == len(raw)
        assert s.end_times == sorted(s.end_times) and s.end_times[-1] == len(s.payload) / ogg.RATE
    for k in range(0, len(media), 4999):
        bad = bytearray(media)
        bad[k] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode_media(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.decode_media(media[: len(media) // 2])


def test_ogg_packets_across_pages_and_granules():
    packets = [(b"h", 0), (b"a" * 255, 255), (b"b" * 70_000, 70_255), (b"", 70_255), (b"c" * 510, 70_765)]
    other = [(b"k", 0), (b"v" * 1000, 5)]
    streams = ogg.demux(ogg.mux([ogg.pages_of(1, packets), ogg.pages_of(2, other)]))
    assert streams[1].packets == [p for p, _ in packets] and streams[2].packets == [p for p, _ in other]
    assert ogg.times(streams[1].granules[1:], [255, 70_000, 0, 510], 1) == [255, 70_255, 70_255, 70_765]


def test_ogg_column_digests(odd, odd_rows, empty):
    got = ogg.decode_column(ogg.encode_column(odd)).collect()
    want = Counter()
    for k, t, *_ in odd_rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(k, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    spark = odd.sparkSession
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"OggS"))], "id int, media binary")
    assert {r["id"]: r["error"] for r in ogg.decode_column(bad).collect()} == {1: "null", 2: "stream", 3: "truncated"}
    assert ogg.decode_column(ogg.encode_column(empty)).count() == 0


# 3 rules


def test_rule_ensemble_learns_and_compiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 3] > 0.3) | (x[:, 5] < -1)).astype(float)
    model = rule_ensemble.fit(x, y)
    assert ((model.predict(x) >= 0.5) == (y > 0.5)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"_{n} double" for n in rule_ensemble.STATISTICS))
    assert np.allclose([r[0] for r in df.select(model.score()).collect()], model.predict(x[:50]))
    assert 0 < rule_ensemble.fit(x[:3], y[:3]).intercept + 9 and not rule_ensemble.fit(x, np.ones(600)).rules


def test_rule_ensemble_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = rule_ensemble.op3_rule_ensemble(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert tested and sum(r["predicted"] == labels[r["doc_id"]] for r in tested) / len(tested) >= 0.9


def test_rule_ensemble_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(k, k % 2 if k != 3 else None) for k in range(1, 17)] + [(None, 1)], "doc_id bigint, quality int")
    assert rule_ensemble.classify(odd, labels).count() == len(odd_rows)
    assert rule_ensemble.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert rule_ensemble.classify(empty, labels).count() == 0


# 4 join


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return [len(s) for s in sets], [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("reach", [32, 2])
def test_jaccard_join_by_brute_force(spark, monkeypatch, reach):
    monkeypatch.setattr(jaccard_join, "FIRST_REACH", reach)
    rng = random.Random(7)
    small, base, common = [f"a{i}" for i in range(5)], [f"x{i}" for i in range(220)], [f"c{i}" for i in range(45)]
    texts = []
    for i in range(260):
        if i % 4 == 0:
            t = [rng.choice(small) for _ in range(rng.randint(0, 30))]
        elif i % 4 == 1:
            t = base[: rng.randint(180, 220)]
            for _ in range(rng.randint(0, 7)):
                t[rng.randrange(len(t))] = f"Y{rng.randrange(30)}"
        elif i % 4 == 2:
            t = common + [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]
        else:
            t = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(4, 50))]
        texts.append(" ".join(t) if rng.random() > 0.03 else None)
    sizes, component = brute_components(texts, 4, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == {k: (sizes[k], component[k]) for k in range(len(texts))}


def test_jaccard_join_odd_rows(odd, odd_rows, empty):
    got = jaccard_join.jaccard_join(odd).collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in odd_rows)
    by = defaultdict(set)
    for r in got:
        by[r["id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == by[2] == by[3] and {c for _, c in by[1]} == {1}
    assert by[4] == {(0, 4)} and by[7] == {(1, 7)} and by[None] == {(1, 7), (0, None)}
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_shared_lists_across_batches(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(30), rng.randrange(4) + 1, rng.randrange(3), 0, 0) for _ in range(400)] + [(99, 1, 1, 1, 1)] * 20
    keep, old = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in rows:
        keep.setdefault(r[0], set()).add(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in jaccard_join._shared_lists(spark.createDataFrame(rows, jaccard_join.POSTING_TYPES)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(x for s in keep.values() if len(s) > 1 for x in s)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(1, len(a) + 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)]))
        p, q = (np.frombuffer(jaccard_join.parity(x), np.uint64) for x in (a, b))
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))


def test_jaccard_sets_move_once_and_only_for_pairs_that_parity_allows(spark):
    rng, sets = np.random.default_rng(3), []
    for k in range(60):
        x = rng.integers(0, 2**63, 200, np.int64).astype(np.uint64)
        sets += [np.unique(x), np.unique(np.concatenate([x[rng.integers(0, 40) :], rng.integers(0, 2**63, int(rng.integers(0, 40)), np.int64).astype(np.uint64)]))]
    nodes = spark.createDataFrame([(k, k, k, k, len(x), bytearray(jaccard_join.parity(x))) for k, x in enumerate(sets)], "node bigint, rep bigint, s1 bigint, s2 bigint, size bigint, bits binary")
    pairs = [(u, v) for u in range(0, 120, 2) for v in (u + 1, (u + 2) % 120)]
    kept = {tuple(r) for r in jaccard_join._by_parity(spark.createDataFrame(pairs, "u bigint, v bigint"), nodes, 85).collect()}
    linked = {(u, v) for u, v in pairs if 100 * (n := len(np.intersect1d(sets[u], sets[v]))) >= 85 * (len(sets[u]) + len(sets[v]) - n)}
    assert 20 < len(linked) and linked <= kept < set(pairs) and all(v == u + 1 for u, v in kept)
    made = jaccard_join._sets(spark.createDataFrame([("1", "a b")], "id string, text string"), nodes, 4)
    assert "hashpartitioning(node" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("percent, n", [(85, 4), (80, 5)])
def test_jaccard_join_of_a_group_of_near_copies(spark, percent, n):
    """A list longer than the first reach, of sets that mostly lie just under the threshold."""
    rng = random.Random(10)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(220):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 2)] = [f"e{rng.randrange(400)}"] * rng.randint(0, 2)
        texts.append(" ".join(t))
    sizes, component = brute_components(texts, n, percent)
    assert 1 < len(set(component)) < len(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, n, percent).collect()}
    assert got == {k: (sizes[k], component[k]) for k in range(len(texts))}


def test_bit_filter(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**62), 2**62, 5000)
    bits = bit_filter(spark.createDataFrame([(int(x),) for x in values], "h bigint"))
    assert passes(bits, values).all() and passes(bits, rng.integers(-(2**62), 2**62, 5000)).mean() < 0.01
    assert not passes(bit_filter(spark.createDataFrame([], "h bigint")), values).any()


# 5 packing


def check_packing(rows, documents, end, capacity=1024):
    """Every row of the documents is there once, each of its ids in one piece; sequences have no gaps and no padding."""
    t = tokenizer()
    want, got, sequences = Counter(), defaultdict(list), defaultdict(list)
    for k, text in documents:
        want[(k, tuple(ids_of(t, text) + [end]))] += 1
    for r in rows:
        got[(r["id"], r["row"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    of = defaultdict(list)
    for (k, ids), n in want.items():
        of[(k, len(ids))] += [ids] * n
    for (k, _, n), pieces in got.items():
        pieces.sort()
        assert [a for a, _, _ in pieces] == [0, *np.cumsum([b for _, b, _ in pieces])[:-1]] and sum(b for _, b, _ in pieces) == n
        found = [ids for ids in of[(k, n)] if all(c == crc(ids[a : a + b]) for a, b, c in pieces)]
        of[(k, n)].remove(found[0])
    assert not any(of.values())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0


def test_packing_round_trip(odd, odd_rows, empty):
    rows = packing.pack(odd, VOCABULARY, with_ids=True).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows], packing.END_ID)
    assert all(crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_bins_of_a_class_hold_a_fixed_number():
    bins, rng, placed = packing.HarmonicBins(64, 7, 0), random.Random(1), []
    n = [rng.randint(1, 90) if rng.random() < 0.3 else rng.randint(9, 64) for _ in range(3000)]
    for k, x in enumerate(n):
        placed += bins.add(k, x)
    end = bins.next
    placed += bins.close()
    by, pieces = defaultdict(list), Counter()
    for (doc, start, length), sequence, _ in placed:
        by[sequence].append((doc, start, length))
        pieces[doc] += 1
    for q, s in by.items():
        assert sum(x[2] for x in s) == 64 or q >= end
        lead = 64 // s[0][2]
        if q < end and s[0][2] == n[s[0][0]] and 8 < s[0][2]:  # a bin's k documents come first, all of one class
            assert all(64 // x[2] == lead and x[2] == n[x[0]] for x in s[:lead]) or pieces[s[lead - 1][0]] > 1
    short = [k for k, x in enumerate(n) if 8 < x <= 64]
    assert sum(pieces[k] == 1 for k in short) > 0.6 * len(short) and len(by) - end < 30
    assert Counter(d for s in by.values() for d, a, b in s for _ in range(b)) == Counter(dict(enumerate(n)))
    with pytest.raises(ValueError):
        packing.HarmonicBins(1000, 8, 0)


# 6 fertility


def test_quality_rules_by_brute_force(odd, odd_rows, empty):
    got = fertility.quality_rules(odd, VOCABULARY, PIECES).collect()
    want = Counter()
    for k, t, *_ in odd_rows:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = t.split("\n")
        dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        want[(k, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    assert Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert fertility.quality_rules(empty, VOCABULARY, PIECES).count() == 0


def test_fertility_measures_and_bands():
    known, bpe = fertility.known_characters(PIECES), byte_bpe(VOCABULARY)
    measure = lambda t: fertility.fertility(t, np.frombuffer(bpe.ids(t), "<u4"), len(t.encode()), known)
    prose = "The quick brown fox jumps over the lazy dog while many other animals watch it from the edge of the wood and wonder. " * 1
    assert fertility.within(fertility.BANDS["en"], 99, measure(prose))
    assert not fertility.within(fertility.BANDS["en"], 99, measure("\U0001f9ffἀꙮ" * 40))
    assert not fertility.within(fertility.BANDS["en"], 99, measure("same " * 200))
    assert fertility.within(fertility.BANDS["en"], 3, measure("ꙮ"))
    samples = {"latin": "plain words", "greek": "καλημέρα", "cyrillic": "привет мир", "arabic": "مرحبا", "devanagari": "नमस्त", "han": "日本語 ひらがな", "hangul": "안녕하세요"}
    assert {fertility.script(t): t for t in samples.values()} == samples and fertility.script("123") == "latin" and fertility.script("אבגד") == "other"
    assert set(samples) <= set(fertility.BANDS)


def test_each_measure_rejects_its_junk(spark):
    rng = random.Random(12)
    pool = "the house water people river small garden morning window letter bridge village evening doctor summer market".split()
    prose = lambda n: " ".join(rng.choice(pool) + rng.choice(["", "s", "."]) for _ in range(n))
    docs = [(k, prose(rng.randint(60, 90)), "en") for k in range(200)]
    docs.append((500, " ".join("".join(rng.choice("xqzjkvw&%$#") for _ in range(6)) for _ in range(70)), "en"))  # few characters a token
    docs.append((501, " ".join(rng.choice(pool) + rng.choice("ꙮꙭꙬꙫ") for _ in range(70)), "en"))  # bytes
    docs.append((502, " ".join(f"{a} {b}" for a in ("word",) for b in ("word",) for _ in range(40)) + " " + prose(300)[:60], "en"))  # few tokens, over and over
    got = {r["id"]: r for r in fertility.quality_rules(spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(3), VOCABULARY, PIECES).collect()}
    assert not any(got[k]["kept"] for k in (500, 501, 502)) and sum(got[k]["kept"] for k in range(200)) >= 190
    usual = [got[k] for k in range(200)]
    assert got[500]["chars_per_token"] < min(r["chars_per_token"] for r in usual) and got[501]["fallback_share"] > 0.05 and got[502]["token_entropy"] < min(r["token_entropy"] for r in usual)


def test_bands_come_from_the_texts(spark):
    rng = random.Random(8)
    lang = {"en": "the house water people river small garden morning window letter".split(), "de": "der Haus Wasser Leute Fluss kleine Garten Morgen Fenster Brief".split()}
    docs = [(2 * k + i, " ".join(rng.choice(w) + str(rng.randrange(99)) for _ in range(80)), x) for k in range(100) for i, (x, w) in enumerate(lang.items())]
    docs += [(1000 + k, " ".join(rng.choice(lang["en"])[:2] + rng.choice(["&&&", "***", "$|#"]) + str(rng.randrange(99)) for _ in range(80)), "en") for k in range(5)]
    docs += [(2000, docs[0][1], None), (2001, "a b", "en")]
    got = {r["id"]: r for r in fertility.quality_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3), VOCABULARY, PIECES).collect()}
    for x in lang:
        rows = [r for r in got.values() if r["band"] == x and not r["base_failed"] and r["n_tokens"] >= 32]
        for r in rows:
            want = True
            for m, fixed in (("chars_per_token", fertility.BANDS[x].chars_per_token), ("token_entropy", fertility.BANDS[x].entropy)):
                v = sorted(round(y[m] * 1000) / 1000 for y in rows)
                a, b = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
                want &= max(fixed[0], a - 3 * (b - a)) <= r[m] <= min(fixed[1], b + 3 * (b - a)) if a < b else fixed[0] <= r[m] <= fixed[1]
            assert r["kept"] == want
    assert not any(got[1000 + k]["kept"] or got[1000 + k]["base_failed"] for k in range(5)) and got[2000]["kept"] and not got[2001]["kept"]
    assert sum(got[k]["kept"] for k in range(200)) > 180


# 7 licences


def brute_licenses(text, scanner):
    words, out = licenses.normalised(text), {}
    for name, grams in scanner.templates.items():
        best = 0.0
        for a in range(len(words)):
            for b in range(a + 2, min(len(words), a + scanner.most[name] + 1) + 1):
                best = max(best, licenses.dice(set(zip(words[a : b - 1], words[a + 1 : b])), grams))
        if best >= scanner.threshold:
            out[name] = best
    return out


def test_licenses_by_brute_force():
    scanner = licenses.LicenseScanner({k: v for k, v in licenses.TEMPLATES.items() if len(v) < 120})
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(["the", "license", "mit", "version", "under", "foo", "apache", "work"]) for _ in range(n))
    texts = ["", "license", *[fill(12) + "\n" + t + " " + fill(6) for t in licenses.TEMPLATES.values() if len(t) < 120], "Released under MIT License.", fill(60)]
    for t in texts:
        got = {n: s for n, _, _, s in scanner.scan(t)}
        want = brute_licenses(t, scanner)
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in got)


def test_licenses_odd_rows(odd, odd_rows, empty):
    assert licenses.scan_licenses(odd).where("n_licenses = 0").count() == len(odd_rows)
    assert licenses.scan_licenses(empty).count() == 0
    text = licenses.TEMPLATES["MIT-text"]
    assert [x[0] for x in licenses.LicenseScanner().scan("Copyright me\n" + text.replace(",", " ,\n"))] == ["MIT-text"]


def test_all_passages_and_full_texts():
    scanner, rng = licenses.LicenseScanner(), random.Random(7)
    fill = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    header = licenses.TEMPLATES["GPL-3.0-header"]
    n = len(licenses.normalised(header))
    text = " ".join([fill(5), header, fill(40), header, header, fill(9)])
    assert [x[1:] for x in scanner.scan(text) if x[0] == "GPL-3.0-header"] == [(5 + k, 5 + k + n, 1.0) for k in (0, n + 40, 2 * n + 40)]
    full = licenses.full_texts()
    assert {f"{x}-full" for x in ("BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Unlicense")} <= full.keys()
    for name, whole in full.items():
        found = [x[1:] for x in scanner.scan(" ".join([fill(7), whole, fill(30)])) if x[0] == name]
        assert len(found) == 1 and found[0][0] == 7 and found[0][2] == 1.0, name  # it ends where no bigram is new
    for name in ("GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "EPL-2.0-header"):
        best = max(scanner.scan(fill(9) + " " + licenses.TEMPLATES[name]), key=lambda x: x[3])
        assert best[0] == name and best[3] == 1.0
    for name, other in (("GPL-2.0", "GPL-3.0"), ("GPL-3.0", "GPL-2.0"), ("CC-BY-SA-4.0", "CC-BY-4.0")):
        found = scanner.scan(fill(9) + " " + licenses.TEMPLATES[name])
        assert {name, other} <= {x[0] for x in found} and [x[0] for x in licenses.nearest(found, 0.8)] == [name]


# 8 passages


def test_compact_windows_by_recursion():
    rng = np.random.default_rng(1)
    for n, t in ((0, 3), (2, 3), (3, 3), (40, 7), (200, 9), (64, 1)):
        r = rng.integers(0, 30, n).astype(np.uint64)
        want = set()

        def split(lo, hi):
            if hi - lo + 1 >= t:
                m = min(range(lo, hi + 1), key=lambda i: (r[i], i))
                want.add((lo, m, hi))
                split(lo, m - 1)
                split(m + 1, hi)

        split(0, n - 1)
        assert set(zip(*(x.tolist() for x in compact_windows.compact_windows(r, t)))) == want


def passages_by_brute_force(documents, least=50):
    where = defaultdict(set)
    words = {k: WORD.findall((t or "").lower()) for k, t in documents}
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(k)
    out = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                out[k].update(range(i, i + least))
    return out


def covered(spans):
    return {i for x in spans.split(",") if x for i in range(*map(int, x.split(":")))}


def test_passages_cover_exact_repeats_and_near_ones(spark):
    rng = random.Random(3)
    w = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passages, line, docs = [w(n) for n in (50, 51, 80, 120)], w(8), []
    for k in range(120):
        parts = w(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(passages) + w(rng.randint(0, 20))
        docs.append((k, " ".join(parts + line * (k % 2))))
    changed = list(passages[3])
    changed[60] = "other"
    docs.append((120, " ".join(w(30) + changed + w(30))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["id"]: r for r in compact_windows.duplicate_passages(df).collect()}
    want = passages_by_brute_force(docs)
    for k, places in want.items():
        assert places <= covered(got[k]["spans"])
    assert set(range(30, 150)) - {90} <= covered(got[120]["spans"])
    clean = [k for k, t in docs if k not in want and k != 120]
    assert clean and not any(got[k]["spans"] for k in clean)


def test_passages_cover_staggered_excerpts(spark):
    rng, docs = random.Random(4), []
    for k in range(80):
        text = [f"s{rng.randrange(10**9)}" for _ in range(56)]
        for n, part in enumerate((text, text[:52], text[3:55])):
            docs.append((3 * k + n, " ".join([f"f{rng.randrange(10**9)}" for _ in range(rng.randint(0, 9))] + part)))
    got = {r["id"]: covered(r["spans"]) for r in compact_windows.duplicate_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    want = passages_by_brute_force(docs)
    assert len(want) == len(docs) and not [k for k, places in want.items() if not got[k]]


def test_verified_passages_by_brute_force():
    rng, seen = random.Random(5), []
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    tokens = lambda w: compact_windows.tokens(" ".join(w).encode())
    for _ in range(60):
        a = fresh(rng.randint(60, 220))
        b, at = list(a), rng.randint(5, 40)
        while at < len(a):
            b[at] = fresh(1)[0]
            at += rng.randint(30, 45)
        x, y = tokens(a), tokens(b)
        same = x == y
        c = int(rng.choice(np.flatnonzero(same).tolist()))
        total = np.concatenate([[0], np.cumsum(same)])
        # words are unique and only replaced, so passages are the same places of both; their ends are equal tokens
        want = [(l, r) for l in range(c + 1) if same[l] for r in range(max(c, l + 45), len(x)) if same[r] and (total[r + 1] - total[l]) >= 0.8 * (2 * (r - l + 1) - (total[r + 1] - total[l]))]
        got = compact_windows.verified(x, y, (0, c, len(x) - 1, 0, c, len(y) - 1), 46, 0.8)
        assert bool(got) == bool(want) and all(g[:2] == g[2:] and g[:2] in want for g in got)
        if want:
            assert min(g[0] for g in got) == min(l for l, _ in want) and max(g[1] for g in got) == max(r for _, r in want)
        seen.append(bool(want))
    assert sum(seen) > 20


def test_short_near_passages_are_found(spark):
    rng, docs = random.Random(6), []
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(300):
        a = fresh(rng.choice((55, 60)))
        b = list(a)
        b[rng.randrange(10, len(a) - 10)] = "other"
        docs += [(2 * k + n, " ".join(fresh(rng.randint(20, 300)) + x + fresh(rng.randint(20, 300)))) for n, x in enumerate((a, b))]
    got = {r["id"]: r["spans"] for r in compact_windows.duplicate_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert sum(bool(x) for x in got.values()) >= 0.99 * len(docs)


def near_passages(rng, changes, pairs=60, n=100):
    fresh = lambda k: [f"n{rng.randrange(10**9)}" for _ in range(k)]
    docs = []
    for k in range(pairs):
        a = fresh(n)
        b = list(a)
        for at in rng.sample(range(3, n - 3), changes):
            b[at] = fresh(1)[0]
        for m, x in enumerate((a, b)):
            before = rng.randint(20, 200)
            docs.append((2 * k + m, " ".join(fresh(before) + x + fresh(rng.randint(20, 200))), before))
    return docs


@pytest.mark.parametrize("changes, least", [(1, 0.95), (2, 0.9), (3, 0.9)])
def test_recall_of_near_passages(spark, changes, least):
    """Pairs of 100-word passages with changed words, among those where some 50 words or more are near enough by brute force; found if nine tenths of the best such stretch are covered on both sides."""
    docs = near_passages(random.Random(20 + changes), changes)
    got = {r["id"]: covered(r["spans"]) for r in compact_windows.duplicate_passages(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string").repartition(3)).collect()}
    hit, total = 0, 0
    for (k, x, at), (_, y, bt) in zip(docs[::2], docs[1::2]):
        a, b = (compact_windows.tokens(" ".join(t.split()[p : p + 100]).encode()) for t, p in ((x, at), (y, bt)))
        same = np.concatenate([[0], np.cumsum(a == b)])
        near = [(r - l + 1, l, r) for l in range(len(a)) for r in range(l + 45, len(a)) if same[r + 1] - same[l] >= 0.8 * (2 * (r - l + 1) - (same[r + 1] - same[l]))]
        if near:
            size, l, r = max(near)
            total += 1
            hit += all(len(got[k + m] & set(range(p + l, p + r + 5))) >= 0.9 * (size + 4) for m, p in ((0, at), (1, bt)))
    assert total > 20 and hit >= least * total


def test_passages_do_not_depend_on_the_dealing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    both = [sorted(tuple(r) for r in compact_windows.duplicate_passages(docs.repartition(k)).collect()) for k in (1, 7)]
    assert both[0] == both[1] and any(r[1] for r in both[0])


def test_passages_odd_rows(odd, odd_rows, empty):
    got = defaultdict(set)
    rows = compact_windows.duplicate_passages(odd).collect()
    for r in rows:
        got[r["id"]].add(r["spans"])
    assert len(rows) == len(odd_rows) and got[1] == {"0:120"} and got[3] == {"0:120"} and got[4] == {""} and got[10] == {""}
    assert set(range(40, 100)) <= covered(next(iter(got[8]))) and set(range(70, 130)) <= covered(next(iter(got[9])))
    assert compact_windows.duplicate_passages(empty).count() == 0


# 9 ORC


def test_token_orc_round_trip(odd, odd_rows, empty):
    spark, t = odd.sparkSession, tokenizer()
    path = shared_path(spark, "orc-test")
    token_orc.write_tokens(odd, path, VOCABULARY)
    order = sorted(((r[0], r[1]) for r in odd_rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got = sorted(token_orc.token_positions(token_orc.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == [k for k, _ in order]
    want, at = Counter(), 0
    for _, text in order:
        ids = ids_of(t, text) + [2]
        want[(len(ids), crc(ids))] += 1
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert sum(n for _, _, n, _ in token_orc.stripe_table(spark, path)) == len(odd_rows)
    found = token_orc.lookup(spark, path, [8, 9, 999])
    assert sorted(r["id"] for r in found.collect()) == [8, 9]
    assert "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString()
    path = shared_path(spark, "orc-empty")
    token_orc.write_tokens(empty, path, VOCABULARY)
    assert token_orc.token_positions(spark.read.schema("part int, id bigint, n_tokens bigint, ids array<int>").orc(path)).count() == 0


# 10 mixing


def test_targets_share_and_cap():
    assert mixing.targets([10, 10], [1, 3]) == [5.0, 15.0]
    out = mixing.targets([100, 1, 0, 50], [1, 2, 3, 1])
    assert out[1] == 3 and out[2] == 0 and abs(sum(out) - 151) < 1e-9 and out[0] == out[3] == 74
    assert mixing.targets([], []) == []


def test_permutations_are_bijective():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, 2):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))
    both = mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64))
    assert not np.array_equal(both, np.arange(1000))


def test_draws_end_at_the_need():
    need = np.array([5000, 20, 0, 777])
    counts = mixing.draw_counts(need, 256, 3)
    assert (counts.sum(axis=0) == need).all() and (counts.sum(axis=1)[:-1] == 256).all()
    assert (counts == mixing.draw_counts(need, 256, 3)).all() and len(mixing.draw_counts(np.zeros(2), 8, 1)) == 0


def test_mixture_by_brute_force(odd, odd_rows, empty):
    options = {"block": 16, "shard_slots": 64}
    mix = mixing.mixture(odd, **options)
    rows = mix.taken().collect()
    assert Counter((r["id"], r["size"]) for r in rows) == Counter((k, len(WORD.findall(t or ""))) for k, t, *_ in odd_rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sizes, times = Counter(), Counter()
    for k, t, _, s, *_ in odd_rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], mixing.cycled_weights(len(order)))))
    names = {r["sid"]: r["source"] for r in mix.sources.collect()}
    assert {names[r["sid"]]: (r["source_size"], r["target"]) for r in mix.sources.collect()} == {s: (sizes[s], goal[s]) for s in order}
    # blocks: every word of a source once, none longer than the block; taken counted piece by piece
    for r in mix.slots.collect():
        times[(r["sid"], r["block"])] += 1
    held, taken = Counter(), Counter()
    for p in mix.pieces.collect():
        held[(p["sid"], p["block"])] += p["length"]
        taken[p["row"]] += p["length"] * times[(p["sid"], p["block"])]
    assert all(0 < n <= 16 for n in held.values()) and max(times.values()) <= 3
    assert {r["row"]: r["taken"] for r in rows} == {r["row"]: taken[r["row"]] for r in rows}
    by = Counter()
    for key, n in times.items():
        by[names[key[0]]] += n * held[key]
    assert all(abs(by[s] - goal[s]) <= 32 for s in order)
    again = mixing.mixture(odd, **options).taken().collect()
    assert Counter((r["id"], r["size"], r["taken"]) for r in again) == Counter((r["id"], r["size"], r["taken"]) for r in rows)
    assert mixing.mixture(empty).taken().count() == 0


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 5000, "b": 100, "c": 129, "d": 20, "e": 700}
    docs = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes.items())]
    weights = lambda n: [5000.0, 40.0, 64.0, 8.0, 300.0]
    mix = mixing.mixture(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), weights=weights)
    for r in mix.taken().collect():
        assert abs(r["taken"] - r["target"]) <= max(2, 0.06 * r["size"]), (r["id"], r["size"], r["target"], r["taken"])


def test_mixed_documents_hold_the_taken_words(spark):
    rng = random.Random(6)
    docs = [(k, "\n".join(" ".join(f"d{k}n{i}" for i in range(j, j + 9)) for j in range(0, rng.randint(1, 90), 9)), "ab"[k % 5 == 0]) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    options = {"block": 8, "shard_slots": 32}
    out = mixing.mixed_documents(df, epoch_col="epoch", **options).collect()
    want = {r["id"]: r["taken"] for r in mixing.mixture(df, **options).taken().collect()}
    assert max(Counter((r["doc_id"], r["epoch"]) for r in out).values()) == 1
    got = Counter()
    for r in out:
        w = WORD.findall(r["text"])
        assert len(set(w)) == len(w) and set(w) <= set(WORD.findall(docs[r["doc_id"]][1]))
        got[r["doc_id"]] += len(w)
    assert got == Counter({k: n for k, n in want.items() if n})


def test_mixed_rows_that_differ_in_another_column_stay_apart(spark):
    docs = [(1, " ".join(f"w{i}" for i in range(200)), "a", k // 2) for k in range(8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, other int")
    out = mixing.mixed_documents(df, epoch_col="epoch", block=16, shard_slots=32).collect()
    whole = Counter((r["other"], r["epoch"]) for r in out for _ in WORD.findall(r["text"]))
    assert {k for k, _ in whole} == {0, 1, 2, 3} and sum(whole.values()) == 1600 and all(n <= 400 for n in whole.values())


def test_shards_of_super_shards(spark, monkeypatch):
    """Shards keep their size and the totals whatever the number of super-shards."""
    docs = [(k, " ".join(["w"] * 700), "ab"[k % 3 == 0]) for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MAX_SUPER", 3)
    mix = mixing.mixture(df, block=16, shard_slots=64)
    slots = mix.slots.collect()
    by = Counter(r["shard"] for r in slots)
    assert len(slots) == len({(r["sid"], r["epoch"], r["block"]) for r in slots}) and sum(n != 64 for n in by.values()) <= 3 and max(by.values()) == 64
    assert all(abs(x - y) <= 32 for x, y in ((sum(r["taken"] for r in mix.taken().collect()), 90 * 700),))
