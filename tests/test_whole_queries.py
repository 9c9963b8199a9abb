"""The queries that take whole texts and whole tables, against brute force."""

import math
import os
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from mosaiq.functions.sequence import codon_table
from mosaiq.plans import registry

SF = os.environ.get("MOSAIQ_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def letters(text):
    return "".join("ACGTN"["aento".index(x)] for x in text.lower() if x in "aento")


def column(spark, name, value):
    return {r["doc_id"]: r[value] for r in registry.QUERIES[name](spark, SF).collect()}


def test_whole_texts(spark, documents):
    s = {k: letters(t) for k, t in documents.items()}
    assert max(map(len, s.values())) > 300
    assert column(spark, "char_tokens", "n") == {k: len(t) for k, t in documents.items() if t}
    assert column(spark, "char_round_trip", "back") == {k: "".join(x if x in "acent" else "?" for x in t) for k, t in documents.items()}
    assert column(spark, "reverse_complement", "s") == {k: x[::-1].translate(str.maketrans("ACGT", "TGCA")) for k, x in s.items()}
    assert column(spark, "n_filter", "n") == {k: x.count("N") for k, x in s.items() if x.count("N") <= 40 and x.count("N") <= 0.2 * len(x)}
    code = codon_table()
    protein = {}
    for k, x in s.items():
        codons = [x[i : i + 3] for i in range(0, len(x) - 2, 3)]
        protein[k] = "".join("M" if i == 0 and c in ("TTG", "CTG", "ATG") else code.get(c, "-") for i, c in enumerate(codons))
    assert column(spark, "codons_translate", "protein") == protein
    slices = {k: x[(a := k * 7919 % max(len(x), 1)) : a + 70] for k, x in s.items()}
    assert column(spark, "chunked_slices", "slice") == {k: x for k, x in slices.items() if x}
    assert max(k * 7919 % max(len(x), 1) for k, x in s.items()) > 5 * 64
    assert all(len(x) >= len(documents[k]) // 2 for k, x in column(spark, "strip_evidence", "s").items())
    assert {r["check"]: r["n_failed"] for r in registry.QUERIES["check_rates"](spark, SF).collect()}["cds_multiple_of_three"] == sum(len(x) > 3 and len(x) % 3 > 0 for x in s.values())


def test_transitive_hops_over_all_orders(spark):
    rows = pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice"]).to_pylist()
    keys = {r["o_orderkey"]: [("a", r["o_custkey"]), ("b", math.floor(float(r["o_totalprice"]) / 50))] for r in rows}
    having = defaultdict(list)
    for k, found in keys.items():
        for key in found:
            having[key].append(k)
    hop = {k: 0 for k in keys if k % 100 == 1}
    front, used = list(hop), set()
    while front:
        fresh = {key for k in front for key in keys[k]} - used
        used |= fresh
        front = sorted({k for key in fresh for k in having[key] if k not in hop})
        hop |= {k: max(hop.values()) + 1 for k in front}
    want = Counter(hop.get(k, -1) for k in keys)
    assert max(want) > 3
    assert {r["hop"]: r["n_new"] for r in registry.QUERIES["leak_transitive_hops"](spark, SF).collect()} == want


def test_track_of_all_intervals(spark):
    from mosaiq.plans.set_queries import signal

    rows = signal(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["chrom"]].append(r)
    got = {r["event_id"]: r for r in registry.QUERIES["track_slice"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows[::37]:
        best = [max((x["value"] for x in by[r["chrom"]] if x["s"] <= p < x["e"]), default=None) for p in range(r["s"] - 10, r["s"] + 10)]
        there = [x for x in best if x is not None]
        assert (got[r["event_id"]]["n"], got[r["event_id"]]["covered"]) == (20, len(there))
        assert abs(got[r["event_id"]]["total"] - sum(there)) < 1e-3


def test_master_of_all_documents(spark, documents):
    rows = {r["doc_id"]: r for r in registry.QUERIES["master_full_outer"](spark, SF).collect()}
    assert all(rows[k]["text_length"] == len(t) for k, t in documents.items())
