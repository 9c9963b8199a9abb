"""Annotation functions, track slices position by position, whole feature tables of lines without ids, and balanced cohorts."""

import math
import random

from mosaiq.functions import annotation
from mosaiq.operators import intervals, splits
from mosaiq.sources import parsers


def test_track_slice_by_brute_force(spark):
    rng = random.Random(1)
    features = [(k, f"c{k % 2}", rng.randrange(-10, 80), rng.randrange(20), k % 3 == 0) for k in range(40)] + [(99, "none", 0, 5, False), (98, "c0", 7, 0, False)]
    features = [(k, c, a, a + n, minus, 75) for k, c, a, n, minus in features]
    track = [(f"c{rng.randrange(2)}", s := rng.randrange(70), s + rng.randrange(1, 9), float(rng.randrange(9))) for _ in range(25)]
    f = spark.createDataFrame(features, "k int, c string, a bigint, b bigint, minus boolean, size bigint")
    t = spark.createDataFrame(track, "c string, s bigint, e bigint, v double")
    for zero in (False, True):
        got = {r["k"]: r["track"] for r in intervals.track_slice(f, t, ["c"], "k", "a", "b", "s", "e", "v", 8, f["minus"], zero, "size").collect()}
        assert len(got) == len(features)
        for k, c, a, b, minus, size in features:
            best = [max((v for d, s, e, v in track if d == c and s <= p < e), default=None) for p in range(a, b)]
            there = any(x is not None for x in best)
            want = [x if x is not None else 0.0 if zero and there and 0 <= p < size else math.nan for p, x in zip(range(a, b), best)]
            assert [repr(x) for x in got[k]] == [repr(x) for x in (want[::-1] if minus else want)]


def most_rows(plan):
    """The most rows that an operator of an executed plan gave."""
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    below += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_track_slice_of_many_intervals_on_one_place_makes_no_pairs(spark):
    n = 2000
    f = spark.range(n).selectExpr("id AS k", "'c' AS c", "id % 3 AS a", "id % 3 + 4 AS b")
    t = spark.range(n).selectExpr("'c' AS c", "id % 2 AS s", "id % 2 + 5 AS e", "CAST(id AS DOUBLE) AS v")
    cut = intervals.track_slice(f, t, ["c"], "k", "a", "b", "s", "e", "v", 4)
    got = {r["k"]: r["track"] for r in cut.collect()}
    want = [n - 2.0] + [n - 1.0] * 5
    assert len(got) == n and all(got[k] == want[k % 3 : k % 3 + 4] for k in got)
    assert most_rows(cut._jdf.queryExecution().executedPlan()) <= 8 * n


def test_track_slice_of_odd_rows(spark):
    f = spark.createDataFrame([(1, "c", 2, 9), (1, "c", 2, 9), (1, "c", 2, 9), (2, None, 0, 2), (3, "c", None, 4), (4, "c", 5, 3), (5, "c", 3, 5), (6, "d", 0, 1)], "k int, c string, a int, b int")
    t = spark.createDataFrame([("c", 0, 4, None), (None, 0, 9, 7.0), ("c", 3, 5, math.nan), ("c", 4, 8, 2.0), ("c", None, 9, 8.0), ("d", 1, 0, 1.0)], "c string, s int, e int, v double")
    got = sorted((r["k"], repr(r["track"])) for r in intervals.track_slice(f, t, ["c"], "k", "a", "b", "s", "e", "v", 4, internal_zero=True).collect())
    one = (1, "[0.0, nan, nan, 2.0, 2.0, 2.0, 0.0]")
    assert got == [one, one, one, (2, "[nan, nan]"), (3, "[]"), (4, "[]"), (5, "[nan, nan]"), (6, "[nan]")]


def test_gff3_numbers_shared_ids_and_keeps_lines_without(spark):
    lines = ["# note"] + [f"s\tx\texon\t{k}\t{k + 5}\t.\t+\t.\tParent=m{k % 2}" for k in range(1, 6)] + [f"s\tx\tCDS\t{k}\t{k + 2}\t.\t+\t0\tID=cds;Parent=m1" for k in (30, 20)] + ["s\tx\tmRNA\t1\t9\t.\t+\t.\tID=m1"]
    got = parsers.gff3(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(got) == 8 and sum(r["id"] is None for r in got) == 5
    assert {(r["id"], r["start"]) for r in got if r["id"]} == {("cds_1", 20), ("cds_2", 30), ("m1", 1)}


def test_balanced_takes_equal_classes(spark):
    df = spark.createDataFrame([(k, k < 6 if k % 10 else None) for k in range(40)], "id int, flag boolean")
    got = splits.balanced(df, "flag", "id", 20).collect()
    assert sorted(r["flag"] for r in got) == [False] * 5 + [True] * 5
    assert splits.balanced(df, "flag", "id", 3).count() == 6 and splits.balanced(df.where("flag"), "flag", "id", 3).count() == 0


def test_annotation_functions_of_odd_values(spark):
    df = spark.createDataFrame([(None, None, 0.0, 0.0, float("nan")), ("a:b:c", "x.y/z.tar.gz", 2.0, 4.0, 9.0), ("none", "q.lifted.bed", -1.0, 5.0, -9.0)], "a string, f string, h double, g double, q double")
    got = df.select(annotation.after_colon("a").alias("a"), annotation.signal_name("f").alias("f"), annotation.shape_index("h", "g").alias("s"), annotation.scaled_charge("q").alias("q"), annotation.folded_to("a", ["x"]).alias("k"), annotation.joined_id("a", "f").alias("j")).collect()
    assert [(r["a"], r["f"], r["k"]) for r in got] == [(None, None, "Other"), ("b", "z.tar.bw", "Other"), (None, "q.lifted.bw", "Other")]
    assert math.isnan(got[0]["s"]) and got[1]["s"] == 1.0 and abs(got[2]["s"] + 1) < 1e-3
    assert math.isnan(got[0]["q"]) and (got[1]["q"], got[2]["q"]) == (1.0, -1.0) and got[0]["j"] is None


def test_records_of_ids_and_corpus_lines(spark, tmp_path):
    records = spark.createDataFrame([("p1|x y", "MA"), ("p2", "MC"), ("p3 z", "MD")], "header string, sequence string")
    assert {r["sequence"] for r in parsers.fasta_of_ids(records, spark.createDataFrame([("p1",), ("p3",), ("p9",)], "id string"), "id").collect()} == {"MA", "MD"}
    spark.createDataFrame([('{"text": "a", "url": 1}',), ('{"url": 2}',), ('{"text": "b"}',)], "value string").write.option("compression", "gzip").text(str(tmp_path / "c"))
    assert sorted(r["text"] for r in parsers.read_corpus(spark, str(tmp_path / "c")).collect()) == ["a", "b"]
