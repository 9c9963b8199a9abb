import math

from pyspark.sql import functions as F

from mosaiq.functions import checks, codecs
from mosaiq.functions import sequence as S
from mosaiq.operators import annotations, intervals, leakage, master, signatures, splits
from mosaiq.sources import parsers, shards


def one(spark, column, **values):
    return spark.range(1).select(*[(v if not isinstance(v, (str, int, float, list, type(None))) else F.lit(v)).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_char_codec_unknown(spark):
    codec = codecs.CharCodec("ACGT")
    assert one(spark, codec.encode(F.col("s")), s="ACGTO") == [0, 1, 2, 3, 6]
    assert one(spark, codec.decode(codec.encode(F.col("s"))), s="ACGTO") == "ACGTX"
    assert one(spark, codec.encode(F.col("s")), s="") == []


def test_bin_codec(spark):
    codec = codecs.BinCodec((0.0, 1.0, 2.0, 3.0, 4.0))
    x = F.array(*[F.lit(v) for v in (0.5, 1.5, 2.5, 3.5, 4.5, float("nan"))], F.lit(None).cast("double"))
    assert one(spark, codec.encode(x), a=1) == [0, 1, 2, 3, 6, 6, 5]
    back = one(spark, codec.decode(codec.encode(x)), a=1)
    assert back[:4] == [0.5, 1.5, 2.5, 3.5] and all(math.isnan(v) for v in back[4:6]) and back[6] is None
    for p, want in (([0.5, 0.5, 0, 0, 0, 0, 0], 1.0), ([0, 0, 1.0, 0, 0, 0, 0], 2.5), ([0, 0.25, 0.75, 0, 0, 0, 0], 2.25)):
        assert one(spark, codec.weighted_mean(F.array(*[F.lit(float(v)) for v in p])), a=1) == want
    surface = codecs.SurfaceCodec(codec)
    assert one(spark, surface.encode(x), a=1)[-2:] == [6, 6]


def test_bool_and_class_codecs(spark):
    assert [one(spark, codecs.BoolCodec().encode(F.lit(v)), a=1) for v in (True, False, 5)] == [1, 0, 4]
    c = codecs.ClassCodec(("hi", "bye"))
    assert [one(spark, c.decode(c.encode(F.lit(v))), a=1) for v in ("hi", "bye", "hello")] == ["hi", "bye", "Other"]


def test_votes_break_ties_by_token(spark):
    rows = spark.createDataFrame([(1, 3), (1, 2), (1, -1), (2, 5)], "k int, t int")
    assert {r["k"]: (r["token"], r["share"]) for r in codecs.hard_vote(rows, ["k"], "t").collect()} == {1: (2, 0.5), 2: (5, 1.0)}
    p = spark.createDataFrame([(1, [0.2, 0.4, 0.4]), (1, [0.2, 0.4, 0.4])], "k int, p array<double>")
    assert codecs.soft_vote(p, ["k"], "p").first()["token"] == 1


def test_padding(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [3]), (2, 1, [])], "b int, o int, t array<int>")
    got = {(r["b"], r["o"]): (r["t"], r["mask"]) for r in codecs.padded(rows, ["b"], "t", 9, "o").collect()}
    assert got == {(1, 1): ([1, 2], [1, 1]), (1, 2): ([3, 9], [1, 0]), (2, 1): ([], [])}


def junction(mask):
    before = [i - 1 for i in range(1, len(mask)) if mask[i] == "1" and mask[i - 1] == "0"]
    after = [i for i in range(1, len(mask)) if mask[i] == "0" and mask[i - 1] == "1"]
    out = ["0"] * len(mask)
    for i in before:
        out[i] = "1"
    for i in after:
        out[i] = "2"
    if before:
        out[before[0]] = "3"
    if after:
        out[after[-1]] = "4"
    return "".join(out)


def test_junctions_match_brute_force(spark):
    masks = [format(k, f"0{n}b") for n in range(1, 10) for k in range(2**n)] + ["0011100110"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(m,) for m in masks], "m string").select("m", S.junctions("m")).collect()}
    assert all(got[m] == junction(m) for m in masks)
    assert got["0011100110"] == "0300021004"


def test_sequences(spark):
    assert one(spark, S.reverse_complement("s"), s="ACgtN") == "NacGT"
    assert one(spark, S.translated("s"), s="TTGTTTTAAZZZAA") == "MF*-"
    assert one(spark, S.masked_letters("s", "m"), s="ACGT", m="1001") == "AT"
    assert one(spark, S.mask_or("s", "m"), s="0011", m="101") == "1011"
    assert one(spark, S.paint(F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(9).alias("start"), F.lit(8).alias("end"))), F.lit(0), F.lit(8)), a=1) == "00111000"
    assert one(spark, S.paint(F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"))), F.lit(0), F.lit(8), F.lit(True)), a=1) == "00011100"
    assert one(spark, S.codons("s"), s="ACGTA") == ["ACG", "TA"]
    assert one(spark, S.max_length("s", 3) & S.min_length("s", 3) & S.whole_codons("s") & S.starts_with_codon("s"), s="ATG") is True
    assert one(spark, S.caption_clean("s"), s="A {ECO:1}. b (PubMed:12) , c .") == "A  b, c."


def test_checks_by_presence(spark):
    df = spark.createDataFrame([("ATGTAA", "111111", "M", "H"), ("ATGTAA", "111110", "M", "HH"), (None, None, None, None)], "rna_seq string, cds string, aa_seq string, dssp string")
    got = {r["check"]: r["n_failed"] for r in checks.check_rates(df).collect()}
    assert got["aa_dssp_length"] == 2 and got["cds_multiple_of_three"] == 2 and got["cds_aa_length"] == 2 and got["cds_translation"] == 1 and got["cds_has_stop_codon"] == 2
    assert "aa_prot_struct_length" not in got and "rna_seq_lengths" not in got
    assert checks.check_rates(df.select("dssp"), []).count() == 0


def test_leakage_chain_and_purity(spark):
    rows = [(1, "train", "a", None), (2, "val", "a", "x"), (3, "val", None, "x"), (4, "test", None, "y"), (5, "val", None, None)]
    df = spark.createDataFrame(rows, "rid int, split string, k string, l string")
    assert {r["rid"]: r["hop"] for r in leakage.hops(df, "rid", ["k", "l"], F.col("split") == "train").collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["rid"]: r["pure_k"] for r in leakage.purity(df, ["k"]).collect()} == {1: False, 2: False, 3: False, 4: False, 5: False}
    assert {r["hop"]: r["n_new"] for r in leakage.hop_profile(df, "rid", ["k", "l"]).collect()} == {0: 1, 1: 1, 2: 1, -1: 2}


def test_signatures_and_assignment(spark):
    df = spark.createDataFrame([(True, True, False), (True, True, False), (True, None, False), (True, True, True), (False, False, False)], "a boolean, b boolean, c boolean")
    counts = signatures.signature_counts(df, ["a", "b", "c"], ["a", "b"])
    assert {r["signature"]: r["n"] for r in counts.collect()} == {"110": 2, "100": 1, "111": 1}
    assert {r["signature"]: r["coverage"] for r in signatures.superset_coverage(counts).collect()} == {"110": 3, "100": 4, "111": 1}
    assert {r["signature"]: r["picked"] for r in signatures.greedy_assignment(counts, [6], ["a", "b", "c"]).collect()} == {"100": None, "111": 6}
    assert signatures.subset_name(["b", "a"]) == "a+b"


def test_splits_and_representatives(spark):
    df = spark.createDataFrame([(i, i // 2 if i < 40 else None) for i in range(42)], "id int, c int")
    placed = splits.ntile_splits(df, F.col("c")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in placed} == {"train": 32, "val": 4, "test": 4}
    assert splits.representatives(df, "c", F.col("id") % 2, "id").where("id % 2 = 0").count() == 0
    assert splits.balanced(df.withColumn("f", F.col("id") < 3), "f", "id", 10).count() == 6


def test_master_nulls_and_prefixes(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    assert master.null_safe_anti(df, df.where("v < 3"), ["k", "v"]).collect()[0]["k"] == "b"
    folded = master.fold_rare(spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string"), "c", 2).collect()
    assert sorted(str(r[0]) for r in folded) == ["None", "other", "x", "x"]
    assert master.with_row_key(df, ["v"]).orderBy("v").select("__key__").collect() == [(0,), (1,), (2,)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5, 1.0), ("a", 5, 8, 3.0), ("a", 10, 12, 2.0), ("b", 1, 2, 9.0)], "c string, s bigint, e bigint, v double")
    got = {tuple(r) for r in intervals.interval_union(df, ["c"], "s", "e", "v").select("c", "s", "e", "v").collect()}
    assert got == {("a", 0, 8, 3.0), ("a", 10, 12, 2.0), ("b", 1, 2, 9.0)}
    f = spark.createDataFrame([(1, "a", 4, 11), (2, "z", 0, 2)], "k int, c string, x bigint, y bigint")
    cut = {r["k"]: r["track"] for r in intervals.track_slice(f, df, ["c"], "k", "x", "y", "s", "e", "v", 4).collect()}
    assert cut[1][:4] == [1.0, 3.0, 3.0, 3.0] and math.isnan(cut[1][4]) and cut[1][6] == 2.0 and all(map(math.isnan, cut[2]))
    plan = intervals.range_join(df, f.withColumnsRenamed({"x": "p", "y": "q"}), ["c"], "s", "e", "p", "q", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert {(r["g"], r["label"]) for r in intervals.quantile_labels(flat, ["g"], "v").collect()} == {("a", 5), ("b", 1), ("b", 10)}


def test_hierarchy(spark):
    rows = [("g", None), ("t", "g"), ("e", "t"), ("x", "gone"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame(rows, "id string, parent string")
    assert {tuple(r) for r in annotations.roots(df, "id", "parent").collect()} == {("g", "g", 0), ("t", "g", 1), ("e", "g", 2), ("x", "x", 0)}
    assert {r["id"] for r in annotations.isoforms(df, "id", "parent").collect()} == {"t"}


def test_exon_counts(spark):
    df = spark.sql("SELECT 'g' AS gene, array(named_struct('start', 1, 'end', 3)) AS c UNION ALL SELECT 'g', array(named_struct('start', 2, 'end', 2), named_struct('start', 5, 'end', 5))")
    assert {(r["position"], r["n"]) for r in annotations.exon_counts(df, "gene", "c").collect()} == {(1, 1), (2, 2), (3, 1), (5, 1)}


def test_parsers(spark, tmp_path):
    gff = spark.createDataFrame([("##gff",), ("c\tS\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a%20b",), ("c\tS\tCDS\t2\t3\t.\t+\t0\tID=x;Parent=g1",), ("c\tS\tCDS\t5\t6\t.\t+\t0\tID=x;Parent=g1",), ("bad",)], "value string")
    got = parsers.gff3(gff).orderBy("start").collect()
    assert [(r["id"], r["parent"]) for r in got] == [("g1", None), ("x_1", "g1"), ("x_2", "g1")]
    b = parsers.bed(spark.createDataFrame([("track x",), ("chr1\t1\t5\tn",), ("chr1 2",)], "value string")).collect()
    assert [(r["chrom"], r["start"], r["rest"]) for r in b] == [("chr1", 1, ["n"])]
    path = str(tmp_path / "fa")
    parsers.write_fasta(spark.createDataFrame([("a", "x", "ACGT"), ("b", "y", "GG"), ("c", "z", None)], "i string, j string, s string").coalesce(1), path, ["i", "j"], "s")
    assert {tuple(r) for r in parsers.read_fasta(spark, path).collect()} == {("a|x", "ACGT"), ("b|y", "GG")}
    nodes = parsers.taxonomy_nodes(spark.createDataFrame([("2\t|\t1\t|\tkingdom\t|\t\t|\t0\t|\t0\t|\t11\t|\t0\t|\t4\t|",), ("junk",)], "value string")).collect()
    assert [tuple(r) for r in nodes] == [(2, 1, "kingdom", 11, 4)]
    codes = parsers.genetic_codes('{ name "x" , id 1 , ncbieaa "' + S.STANDARD + '", sncbieaa "---M' + "-" * 60 + '" }')
    assert codes[1]["letters"] == S.STANDARD and codes[1]["starts"] == ("TTG",)
    caps = spark.sql("SELECT array(named_struct('tag','function','texts',array('a','b')), named_struct('tag','other','texts',array('z')), named_struct('tag','FUNCTION','texts',array('c'))) AS c, array(named_struct('tag','interpro','texts',array('d'))) AS r")
    assert caps.select(parsers.captions("c", "r")).first()[0] == "FUNCTION: a, c INTERPRO: d"


def test_buckets_and_tar(spark):
    df = spark.createDataFrame([(i, [float(i)] * i) for i in range(1, 12)], "id int, v array<double>")
    got = {r["id"]: r["bucket"] for r in shards.length_buckets(df, F.size("v"), [2, 4, 6], 0).collect()}
    assert got == {3: 0, 4: 0, **{i: 1 for i in range(5, 12)}}
    tars = shards.tar_shards(df, ["id"], ["v"], 4)
    assert tars.count() == 3
    assert {r["key"]: len(r["values"]) for r in shards.read_tar(tars).collect()} == {i: i + 1 for i in range(11)}


def test_incremental_index(spark, tmp_path):
    from mosaiq.streaming.ingest import append_index

    root, out, mark = tmp_path / "r", str(tmp_path / "o"), str(tmp_path / "c")
    schema = spark.createDataFrame([("g",)], "genome_feature_id string").schema
    for k in range(2):
        d = root / "s" / "train"
        d.mkdir(parents=True, exist_ok=True)
        spark.createDataFrame([(f"g{k}",)], schema).toPandas().to_parquet(d / f"data_{k}.parquet")
        append_index(spark, str(root), schema, out, mark).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r["subset"], r["split"], r["shard"], r["genome_feature_id"]) for r in got) == [("s", "train", "data_0.parquet", "g0"), ("s", "train", "data_1.parquet", "g1")]
