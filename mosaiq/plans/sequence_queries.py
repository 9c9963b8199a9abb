"""Codec, check, sequence, parser and shard queries on documents, parts, pages and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import annotation as A
from mosaiq.functions import checks, codecs
from mosaiq.functions import sequence as S
from mosaiq.plans.book import Book
from mosaiq.sources import parsers, shards
from mosaiq.sources.storage import table

BOOK = Book()
EDGES = (0.0, 10000.0, 20000.0, 35000.0, 60000.0, 90000.0)
BIN = "CASE WHEN x IS NULL THEN 6 WHEN isnan(x) OR x < -1e-6 OR x >= 90000 + 1e-6 THEN 7 ELSE CAST(x >= 10000 AS INT) + CAST(x >= 20000 AS INT) + CAST(x >= 35000 AS INT) + CAST(x >= 60000 AS INT) END"
VALUES = "v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice END AS x FROM lineitem)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 7, F.lit(float("nan"))).when(n != 6, F.col("l_extendedprice")).alias("x"))


@BOOK.add(f"WITH {VALUES} SELECT l_orderkey, l_linenumber, {BIN} AS token FROM v")
def digitize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("l_orderkey", "l_linenumber", codecs.BinCodec(EDGES).encode_value(F.col("x")).alias("token"))


@BOOK.add(
    f"""WITH {VALUES}, t AS (SELECT l_orderkey, l_linenumber, {BIN} AS token FROM v)
SELECT l_orderkey, l_linenumber, CASE token WHEN 0 THEN 5000.0 WHEN 1 THEN 15000.0 WHEN 2 THEN 27500.0 WHEN 3 THEN 47500.0 WHEN 4 THEN 75000.0 WHEN 6 THEN -1.0 ELSE -2.0 END AS centre FROM t"""
)
def detokenize_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.BinCodec(EDGES)
    t = values(spark, sf_dir).select("l_orderkey", "l_linenumber", F.get(codec.decode(codec.encode(F.array("x"))), 0).alias("c"))
    return t.select("l_orderkey", "l_linenumber", F.when(F.col("c").isNull(), -1.0).when(F.isnan("c"), -2.0).otherwise(F.col("c")).alias("centre"))


@BOOK.add("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.5 + CAST(embedding[2] AS DOUBLE) * 1.5 + CAST(embedding[3] AS DOUBLE) * 2.5 + CAST(embedding[4] AS DOUBLE) * 3.5, 5) AS mean FROM embeddings")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.BinCodec((0.0, 1.0, 2.0, 3.0, 4.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(codec.weighted_mean(F.col("embedding")), 5).alias("mean"))


@BOOK.add("SELECT doc_id, len(c) AS n, CAST(list_sum(list_transform(c, lambda x: CASE x WHEN 'a' THEN 0 WHEN 'c' THEN 1 WHEN 'e' THEN 2 WHEN 'n' THEN 3 WHEN 't' THEN 4 WHEN '#' THEN 5 WHEN '_' THEN 6 ELSE 7 END)) AS BIGINT) AS total FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0)")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", codecs.CharCodec("cante", "?").encode(F.col("text")).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@BOOK.add("SELECT doc_id, regexp_replace(text, '[^acent]', '?', 'g') AS back FROM documents")
def char_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.CharCodec("cante", "?", pad="\x01", mask="\x02")
    return table(spark, sf_dir, "documents").select("doc_id", codec.decode(codec.encode(F.col("text"))).alias("back"))


@BOOK.add("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#22' THEN 1 WHEN 'Brand#33' THEN 2 ELSE 5 END AS token FROM part")
def class_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codecs.ClassCodec(("Brand#11", "Brand#22", "Brand#33")).encode(F.col("p_brand")).alias("token"))


@BOOK.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 BETWEEN 0 AND 4 THEN l_linenumber - 1 ELSE 4 END AS token FROM lineitem")
def bool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codecs.BoolCodec().encode(F.col("l_linenumber") - 1).alias("token"))


def nucleotides(text: Column) -> Column:
    """Letters of a text as nucleotides: a, e, n, t and o are A, C, G, T and N; others go."""
    return F.translate(F.regexp_replace(F.lower(text), "[^aento]", ""), "aento", "ACGTN")


DNA = "d AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^aento]', '', 'g'), 'aento', 'ACGTN') AS s FROM documents)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", nucleotides(F.col("text")).alias("s"))


@BOOK.add(f"WITH {DNA} SELECT doc_id, reverse(translate(s, 'ACGT', 'TGCA')) AS s FROM d")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", S.reverse_complement("s").alias("s"))


_TABLE = ", ".join(f"'{k}': '{v}'" for k, v in S.codon_table().items())


@BOOK.add(
    f"""WITH {DNA}, c AS (SELECT doc_id, list_filter(regexp_extract_all(s, '.{{1,3}}'), lambda x: length(x) = 3) AS c FROM d)
SELECT doc_id, coalesce(array_to_string(list_transform(c, lambda x, i: CASE WHEN i = 1 AND x IN ('TTG', 'CTG', 'ATG') THEN 'M' ELSE coalesce(MAP {{{_TABLE}}}[x], '-') END), ''), '') AS protein FROM c"""
)
def codons_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", S.translated("s").alias("protein"))


@BOOK.add(f"WITH {DNA} SELECT doc_id, length(s) - length(replace(s, 'N', '')) AS n FROM d WHERE length(s) - length(replace(s, 'N', '')) <= 40 AND length(s) - length(replace(s, 'N', '')) <= 0.2 * length(s)")
def n_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where(S.enough_known("s", 40, 0.2)).select("doc_id", S.n_count("s").cast("bigint").alias("n"))


COORDS = "k AS (SELECT doc_id, doc_id % 7 + 3 AS a, doc_id % 7 + 9 AS b, doc_id % 5 + 20 AS c, doc_id % 5 + 26 AS d, 40 AS n, doc_id % 2 = 1 AS minus FROM documents)"
PAINT = "list_transform(range(0, n), lambda p: CASE WHEN (a - 1 - 2 <= p AND p < b - 2) OR (c - 1 - 2 <= p AND p < d - 2) THEN '1' ELSE '0' END)"


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    part = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    coords = F.array(part(k % 7 + 3, k % 7 + 9), part(k % 5 + 20, k % 5 + 26))
    return table(spark, sf_dir, "documents").select("doc_id", coords.alias("coords"), (k % 2 == 1).alias("minus")).select("doc_id", S.paint("coords", F.lit(2), F.lit(40), F.col("minus")).alias("mask"))


@BOOK.add(f"WITH {COORDS} SELECT doc_id, CASE WHEN minus THEN reverse(array_to_string({PAINT}, '')) ELSE array_to_string({PAINT}, '') END AS mask FROM k")
def mask_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir)


@BOOK.add(
    f"""WITH {COORDS}, m AS (SELECT doc_id, CASE WHEN minus THEN reverse(array_to_string({PAINT}, '')) ELSE array_to_string({PAINT}, '') END AS s FROM k),
p AS (SELECT doc_id, s, list_filter(range(1, 40), lambda i: s[i] = '0' AND s[i + 1] = '1') AS before, list_filter(range(2, 41), lambda i: s[i] = '0' AND s[i - 1] = '1') AS after FROM m)
SELECT doc_id, array_to_string(list_transform(range(1, 41), lambda i: CASE WHEN i = list_max(after) THEN '4' WHEN i = list_min(before) THEN '3' WHEN list_contains(after, i) THEN '2' WHEN list_contains(before, i) THEN '1' ELSE '0' END), '') AS marks FROM p"""
)
def junction_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir).select("doc_id", S.junctions("mask").alias("marks"))


@BOOK.add("SELECT doc_id, array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN md5(CAST(doc_id AS VARCHAR))[i] < '8' OR md5(lang || doc_id)[i] < '4' THEN '1' ELSE '0' END), '') AS mask FROM documents")
def mask_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda c, limit: F.array_join(F.transform(F.split(F.md5(c), ""), lambda x: F.when(x < limit, "1").otherwise("0")), "")
    k = F.col("doc_id").cast("string")
    t = table(spark, sf_dir, "documents").select("doc_id", bits(k, "8").alias("a"), bits(F.concat("lang", k), "4").alias("b"))
    return t.select("doc_id", S.mask_or("a", "b").alias("mask"))


@BOOK.add(
    f"""WITH {DNA}, r AS (SELECT doc_id, s AS rna_seq, repeat('1', length(s) - 1) || '0' AS splice_regions, CASE WHEN doc_id % 4 = 0 THEN s ELSE s || 'A' END AS dssp, s AS aa_seq, repeat('1', CAST(length(s) AS BIGINT)) AS cds FROM d WHERE length(s) > 3),
c AS (SELECT 'aa_dssp_length' AS "check", length(aa_seq) = length(dssp) AS ok FROM r UNION ALL SELECT 'rna_seq_lengths', length(rna_seq) = length(splice_regions) AND length(cds) = length(splice_regions) FROM r
 UNION ALL SELECT 'rna_seq_length_relations', length(rna_seq) >= length(splice_regions) AND length(splice_regions) >= length(cds) FROM r UNION ALL SELECT 'phylop_length', TRUE FROM r UNION ALL SELECT 'cds_multiple_of_three', length(cds) % 3 = 0 FROM r
 UNION ALL SELECT 'cds_aa_length', length(cds) = 3 * (length(aa_seq) + 1) FROM r UNION ALL SELECT 'cds_has_stop_codon', right(rna_seq, 3) IN ('TAA', 'TAG', 'TGA') FROM r UNION ALL SELECT 'cds_has_start_codon', rna_seq[1:3] IN ('TTG', 'CTG', 'ATG') FROM r UNION ALL SELECT 'cds_translation', FALSE FROM r)
SELECT "check", count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_failed, round(100 * count(*) FILTER (NOT ok) / count(*), 6) AS pct_failed, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'ok' WHEN 100 * count(*) FILTER (NOT ok) / count(*) < 5 THEN 'warning' ELSE 'error' END AS level FROM c GROUP BY 1"""
)
def check_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("s")
    t = dna(spark, sf_dir).where(n > 3)
    rows = t.select(F.col("s").alias("rna_seq"), F.concat(F.repeat(F.lit("1"), n - 1), F.lit("0")).alias("splice_regions"), F.when(F.col("doc_id") % 4 == 0, F.col("s")).otherwise(F.concat("s", F.lit("A"))).alias("dssp"), F.col("s").alias("aa_seq"), F.repeat(F.lit("1"), n).alias("cds"))
    return checks.check_rates(rows).withColumn("pct_failed", F.round("pct_failed", 6))


BUCKETS = [40, 200, 400, 800, 1600]


@BOOK.add("WITH b AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), k AS (SELECT doc_id, n, CASE WHEN n > 800 THEN 3 WHEN n > 400 THEN 2 WHEN n > 200 THEN 1 ELSE 0 END AS bucket FROM b WHERE n > 40) SELECT doc_id, n, bucket FROM k WHERE bucket IN (SELECT bucket FROM k GROUP BY bucket HAVING count(*) >= 100)")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ", -1)).cast("bigint").alias("n"))
    return shards.length_buckets(t, F.col("n"), BUCKETS, 100).select("doc_id", "n", "bucket")


@BOOK.add("WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':2'), doc_id) AS k FROM documents) SELECT doc_id, lang FROM b WHERE k <= 7")
def bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.bucket_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 7, "doc_id", 2)


@BOOK.add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def tar_shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through tar shards of 64 samples and back."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.array(F.col("vec_id").cast("double")).alias("k"))
    back = shards.read_tar(shards.tar_shards(t, ["vec_id"], ["v", "k"], 64))
    wide = back.groupBy("key").agg(F.max(F.when(F.col("column") == "v", F.col("values"))).alias("v"), F.max(F.when(F.col("column") == "k", F.col("values"))).alias("k"))
    return wide.select(F.get("k", 0).cast("bigint").alias("vec_id"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@BOOK.add("SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page, coalesce(json_extract_string(props, '$.k'), '-') AS k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", parsers.field("props", "$.page", "none").alias("page"), parsers.field("props", "$.k", "-").alias("k"))


URL = r"^(?<scheme>[a-z]+)://(?<host>[^/]+)/(?<path>.*)$"


@BOOK.add(r"SELECT page_id, nullif(regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 1), '') AS scheme, nullif(regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 2), '') AS host, nullif(regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 3), '') AS path FROM pages")
def regex_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in parsers.grammar("url", URL).items()])


@BOOK.add(
    r"""WITH t AS (SELECT doc_id, text || ' {ECO:0000269|x' || doc_id || '}. see (PubMed:' || doc_id || ') , end .' AS s FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(s, '\{ECO:.*?\}\.', '', 'g'), '\(PubMed:\d+\)|PubMed:\d+\)|\(PubMed:\d+', '', 'g'), '\s+([.,])', '\1', 'g'), ' ') AS s FROM t"""
)
def strip_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    s = F.concat(F.col("text"), F.lit(" {ECO:0000269|x"), k, F.lit("}. see (PubMed:"), k, F.lit(") , end ."))
    return table(spark, sf_dir, "documents").select("doc_id", S.caption_clean(s).alias("s"))


FEATURES = ["mRNA", "lnc_RNA", "tRNA", "gene", "pseudogenic_transcript", "TEC", "rRNA", "misc"]
BIOTYPES = ["protein_coding", "lncRNA", None, "tRNA", "transcribed_pseudogene", "V_segment", "segment", "snoRNA", "rRNA", "transcript"]


@BOOK.add(
    """WITH p AS (SELECT p_partkey, (['mRNA','lnc_RNA','tRNA','gene','pseudogenic_transcript','TEC','rRNA','misc'])[p_partkey % 8 + 1] AS f, (['protein_coding','lncRNA',NULL,'tRNA','transcribed_pseudogene','V_segment','segment','snoRNA','rRNA','transcript'])[(p_partkey // 8) % 10 + 1] AS b, CASE WHEN p_size % 2 = 0 THEN 'miscRNA' ELSE 'Gene' END AS g, CASE WHEN p_size % 5 = 0 THEN 'protein_coding' ELSE 'other' END AS r, CASE WHEN p_size % 3 = 0 THEN 'Homo sapiens' ELSE 'Danio rerio' END AS o FROM part)
SELECT p_partkey, CASE WHEN o = 'Homo sapiens' THEN
 CASE WHEN lower(f) LIKE '%pseudo%' THEN 'pseudogene' WHEN r LIKE '%protein_coding%' THEN f WHEN f LIKE '%gene%' THEN 'gene' WHEN lower(f) LIKE '%rna%' THEN CASE WHEN lower(f) LIKE '%lnc%' THEN 'lncRNA' WHEN f LIKE '%rRNA%' THEN 'rRNA' WHEN f LIKE '%tRNA%' THEN 'tRNA' ELSE 'miscRNA' END WHEN f LIKE '%TEC%' THEN 'TEC' ELSE 'other' END
ELSE CASE WHEN b IS NULL THEN CASE WHEN lower(f) LIKE '%rna%' THEN CASE WHEN lower(f) LIKE '%lnc%' THEN 'lncRNA' ELSE f END ELSE 'trans_splicing_suspected' END
 WHEN b = 'protein_coding' THEN CASE WHEN f IN ('gene', 'mRNA') THEN 'protein_coding' END WHEN lower(b) LIKE '%pseudo%' THEN 'pseudogene'
 WHEN b = 'tRNA' THEN CASE WHEN f = 'tRNA' THEN 'tRNA' ELSE 'miscRNA' END WHEN b = 'rRNA' THEN CASE WHEN f = 'rRNA' THEN 'rRNA' ELSE 'miscRNA' END WHEN b = 'lncRNA' THEN CASE WHEN f = 'lnc_RNA' THEN 'lncRNA' ELSE 'miscRNA' END
 WHEN b = 'transcript' AND g = 'miscRNA' THEN 'miscRNA' WHEN lower(b) LIKE '%rna%' THEN 'miscRNA' WHEN b LIKE '%V_segment%' THEN 'protein_coding' WHEN lower(g) LIKE '%rna%' THEN 'miscRNA' WHEN b = 'segment' THEN 'trans_splicing_suspected' ELSE 'other' END END AS kind FROM p"""
)
def feature_type_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.get(F.array(*map(F.lit, FEATURES)), (k % 8).cast("int")).alias("f"), F.get(F.array(*map(F.lit, BIOTYPES)), (F.floor(k / 8) % 10).cast("int")).alias("b"),
        F.when(size % 2 == 0, "miscRNA").otherwise("Gene").alias("g"), F.when(size % 5 == 0, "protein_coding").otherwise("other").alias("r"), F.when(size % 3 == 0, "Homo sapiens").otherwise("Danio rerio").alias("o"),
    )
    return rows.select("p_partkey", S.clean_feature_type("f", "r", "b", "g", "o").alias("kind"))


@BOOK.add(f"WITH {DNA}, f AS (SELECT doc_id, doc_id * 7919 % greatest(length(s), 1) AS a, s FROM d) SELECT doc_id, s[a + 1:a + 70] AS slice FROM f WHERE length(s[a + 1:a + 70]) > 0")
def chunked_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of sequences that are stored in chunks of 64 letters."""
    t = dna(spark, sf_dir)
    chunks = parsers.chunked(t, "doc_id", "s", 64)
    first = F.col("doc_id") * 7919 % F.greatest(F.length("s"), F.lit(1))
    wanted = t.select("doc_id", F.col("doc_id").alias("f"), first.alias("a"), (first + 70).alias("b"))
    return parsers.sequence_slices(wanted, chunks, "doc_id", "f", "a", "b", 64).where("length(slice) > 0").select(F.col("f").alias("doc_id"), "slice")


@BOOK.add("SELECT doc_id, CAST(('0x' || right(sha256(text), 4)) AS BIGINT) % 32768 AS h FROM documents")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_hash15("text").cast("bigint").alias("h"))


@BOOK.add("SELECT CAST(c_custkey AS VARCHAR) AS id, split_part(c_name || '|x', '|', 1) AS first, CASE WHEN c_mktsegment LIKE '%T%' THEN split_part('sp_' || c_custkey || '_HUMAN', '_', 2) ELSE c_mktsegment END AS second FROM customer")
def id_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    t = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat("c_name", F.lit("|x")).alias("a"), F.when(F.col("c_mktsegment").contains("T"), F.concat(F.lit("sp_"), k, F.lit("_HUMAN"))).otherwise(F.col("c_mktsegment")).alias("b"))
    return t.select("id", parsers.first_id("a").alias("first"), parsers.second_id("b").alias("second"))


@BOOK.add("SELECT c_custkey, regexp_full_match(a, '([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})') AS ok FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'P0' || c_custkey % 10 || 'AB' || c_custkey % 7 WHEN 1 THEN 'A' || c_custkey % 10 || 'BC' || c_custkey % 10 || '1' ELSE 'x' || c_custkey END AS a FROM customer)")
def accession_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    a = F.when(k % 3 == 0, F.concat(F.lit("P0"), s(k % 10), F.lit("AB"), s(k % 7))).when(k % 3 == 1, F.concat(F.lit("A"), s(k % 10), F.lit("BC"), s(k % 10), F.lit("1"))).otherwise(F.concat(F.lit("x"), s(k)))
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a")).select("c_custkey", parsers.valid_accession("a").alias("ok"))


@BOOK.add("SELECT p_partkey, split_part(p_name, ' ', 1) AS cut, 'x:' || p_brand AS id, substr(p_brand, 5) AS tail, nullif(p_brand, 'Brand#11') || '_' || p_type AS joined, CASE WHEN p_brand IN ('Brand#12', 'Brand#22') THEN p_brand ELSE 'Other' END AS class, p_brand AS second FROM part")
def id_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("x:"), "p_brand")).withColumn("known", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")))
    first = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("cut")
    return t.select("p_partkey", first, "id", A.without_first("p_brand").alias("tail"), A.joined_id("known", "p_type").alias("joined"), A.folded_to("p_brand", ["Brand#12", "Brand#22"]).alias("class"), A.after_colon("id").alias("second"))


@BOOK.add(
    """WITH p AS (SELECT page_id, (['f.bed', 'a.narrowPeak.gz', 'b.bed.gz', 'd/e.txt', 'c'])[page_id % 5 + 1] AS file, (['MSE', 'GLY', 'HSD', 'XYZ', 'UNK', 'PTR', 'CSO'])[page_id % 7 + 1] AS r FROM pages)
SELECT page_id, (['f.bw', 'a.bw', 'b.bw', 'e.bw', 'c.bw'])[page_id % 5 + 1] AS signal, coalesce(CASE r WHEN 'MSE' THEN 'MET' WHEN 'HSD' THEN 'HIS' WHEN 'PTR' THEN 'TYR' WHEN 'CSO' THEN 'CYS' WHEN 'XYZ' THEN NULL ELSE r END, '-') AS residue FROM p"""
)
def annotation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    t = table(spark, sf_dir, "pages").select("page_id", pick(["f.bed", "a.narrowPeak.gz", "b.bed.gz", "d/e.txt", "c"]).alias("file"), pick(["MSE", "GLY", "HSD", "XYZ", "UNK", "PTR", "CSO"]).alias("r"))
    return t.select("page_id", A.signal_name("file").alias("signal"), F.coalesce(A.standard_residue("r"), F.lit("-")).alias("residue"))


@BOOK.add(
    """WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS h, CAST(embedding[2] AS DOUBLE) AS g, CAST(embedding[3] AS DOUBLE) * 10 AS q FROM embeddings), d AS (SELECT *, sqrt(CASE WHEN h * h - g < 0 THEN 1e-8 ELSE h * h - g END) AS half FROM c)
SELECT vec_id, round(greatest(least(q, 3.0), -3.0) / 3.0, 6) AS charge, round(CASE WHEN half = 0 THEN sign(h) ELSE atan(h / half) * 2 / pi() END, 6) AS shape FROM d"""
)
def surface_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("embedding", k).cast("double")
    t = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("h"), at(1).alias("g"), (at(2) * 10).alias("q"))
    return t.select("vec_id", F.round(A.scaled_charge("q"), 6).alias("charge"), F.round(A.shape_index("h", "g"), 6).alias("shape"))
