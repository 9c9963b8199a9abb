"""Each stage of the pipeline against a brute-force version, and the whole on odd rows."""

import random
import re
from collections import Counter

import corpus_pipeline as P
from mosaiq.llm import rule_ensemble
from mosaiq.llm.textutil import shared_path
from test_operators import brute_components, check_packing

SF = "/root/testdata/sf0.001"


def stored(df, spark):
    path = shared_path(spark, "stage-test")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_in_turn(spark):
    docs = P.documents(spark, SF)
    columns = docs.columns
    model = rule_ensemble.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    x = [rule_ensemble.text_statistics((r["text"] or "").encode()) for r in rows]
    import numpy as np

    kept = {r["doc_id"] for r, p in zip(rows, model.predict(np.array(x))) if p >= 0.5}
    one = stored(P.quality(spark, docs, SF), spark)
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == columns
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    _, component = brute_components([r["text"] for r in rows], 5, 80)
    two = stored(P.near_duplicates(spark, one, SF), spark)
    assert sorted(r["doc_id"] for r in two.collect()) == [r["doc_id"] for k, r in enumerate(rows) if component[k] == k] and two.columns == columns
    three = stored(P.secrets(spark, two, SF), spark)
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    for r in three.collect():
        assert r["n_chars"] == len(r["text"])
        if r["text"] != before[r["doc_id"]]:
            parts = r["text"].split("[secret]")
            assert len(parts) > 1 and re.fullmatch(".*?".join(map(re.escape, parts)), before[r["doc_id"]], re.S)
        assert not re.search("[0-9a-f]{16}", r["text"])
    assert three.count() == two.count() and three.columns == columns
    four = stored(P.mixing(spark, three, SF), spark)
    whole = {r["doc_id"]: Counter(r["text"].split()) for r in three.collect()}
    assert four.columns == columns and all(not Counter(r["text"].split()) - whole[r["doc_id"]] for r in four.collect())
    assert max(Counter(r["doc_id"] for r in four.collect()).values()) <= 3
    five = P.packing(spark, four, SF)
    check_packing(five.withColumnRenamed("doc_id", "id").collect(), [(r["doc_id"], r["text"]) for r in four.collect()], 0)


def test_pipeline_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in P.STAGES[1:]:
            docs = stored(stage(spark, docs, SF), spark)
        assert docs.columns[:2] == ["doc_id", "start"]
    labels_dir = shared_path(spark, "labels")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(f"{labels_dir}/labels.parquet")
    assert P.quality(spark, odd, labels_dir).columns == odd.columns
    assert P.quality(spark, empty, labels_dir).count() == 0


def test_stage_list_and_long_texts(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"] and P.ORACLE_SQL is None
    rng = random.Random(1)
    long = " ".join(str(rng.random()) for _ in range(3_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert P.secrets(spark, docs, SF).first()["n_chars"] > 0
