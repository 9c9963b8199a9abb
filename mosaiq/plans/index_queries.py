"""Index, master-table, split, leakage and signature queries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import leakage, master, signatures, splits
from mosaiq.operators.index import Index, group_splits
from mosaiq.plans.book import Book
from mosaiq.sources.manifest import attach_lookup, published_names
from mosaiq.sources.storage import table

BOOK = Book()

LINE_INDEX = """lines AS (
  SELECT l_returnflag || '+' || l_linestatus AS subset,
    CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
    'data_' || l_linenumber || '.parquet' AS shard,
    CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS genome_feature_id,
    CASE WHEN l_orderkey % 14 <> 0 THEN 'P' || l_orderkey END AS uniprot_id,
    CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS rna_cluster_30, l_suppkey AS protein_cluster_30, l_linenumber AS line, l_quantity AS quantity
  FROM lineitem)"""


def line_index(spark: SparkSession, sf_dir: str) -> Index:
    """Line items as index rows: subset by flags, shard by line number, ids by order, clusters by part and supplier."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.lit("+"), "l_linestatus").alias("subset"),
        F.when(k % 10 < 8, "train").when(k % 10 == 8, "val").otherwise("test").alias("split"),
        F.concat(F.lit("data_"), F.col("l_linenumber").cast("string"), F.lit(".parquet")).alias("shard"),
        F.when(k % 7 != 0, k.cast("string")).alias("genome_feature_id"),
        F.when(k % 14 != 0, F.concat(F.lit("P"), k.cast("string"))).alias("uniprot_id"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("rna_cluster_30"),
        F.col("l_suppkey").alias("protein_cluster_30"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
    )
    counts = {r["subset"]: r["count"] for r in rows.groupBy("subset").count().collect()}  # a row a subset
    subsets = {n: {"modalities": n.split("+"), "columns": {m: m for m in n.split("+")}, "key": "genome_feature_id", "splits": {}, "rows": c} for n, c in counts.items()}
    return Index(rows, subsets)


@BOOK.add(f"WITH {LINE_INDEX} SELECT subset, split, count(*) AS n_rows, sum(quantity) AS quantity FROM lines WHERE subset IN ('A+F','N+F','R+F') AND line IN (1, 2, 5) AND protein_cluster_30 = 7 GROUP BY subset, split")
def index_select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = line_index(spark, sf_dir).select(["F"], line=[1, 2, 5], protein_cluster_30=7)
    return picked.rows.groupBy("subset", "split").agg(F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity"))


@BOOK.add(f"WITH {LINE_INDEX}, ids AS (SELECT coalesce(genome_feature_id, uniprot_id) AS id FROM lines WHERE list_contains(string_split(subset, '+'), 'O')) SELECT count(*) AS n_rows, count(DISTINCT id) + max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS n_unique FROM ids")
def index_counts_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index(spark, sf_dir).select(["O"]).counts()


@BOOK.add(f"WITH {LINE_INDEX} SELECT rna_cluster_30, count(rna_cluster_30) AS n FROM lines GROUP BY rna_cluster_30")
def index_counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index(spark, sf_dir).select().counts_by("rna_cluster_30")


@BOOK.add(
    f"""WITH {LINE_INDEX}, n AS (SELECT *, coalesce(genome_feature_id, uniprot_id) AS id,
  row_number() OVER (PARTITION BY coalesce(genome_feature_id, uniprot_id) ORDER BY subset, split, shard) AS k FROM lines)
SELECT coalesce(id, 'none') AS id, subset, shard, line FROM n WHERE k = 1 OR id IS NULL"""
)
def index_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = line_index(spark, sf_dir).select(deduplicate=True)
    return picked.rows.select(F.coalesce(picked.id, F.lit("none")).alias("id"), "subset", "shard", "line")


@BOOK.add(f"WITH {LINE_INDEX} SELECT DISTINCT subset, split, shard FROM lines WHERE protein_cluster_30 = 3")
def index_shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index(spark, sf_dir).select(protein_cluster_30=3).shard_plan()


@BOOK.add(f"WITH {LINE_INDEX} SELECT subset, split, shard, coalesce(genome_feature_id, uniprot_id, '') AS id, line FROM lines ORDER BY subset, split, shard, genome_feature_id NULLS LAST, uniprot_id NULLS LAST LIMIT 25")
def index_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = line_index(spark, sf_dir).select().head(25)
    return picked.rows.select("subset", "split", "shard", F.coalesce(picked.id, F.lit("")).alias("id"), "line")


@BOOK.add(f"WITH {LINE_INDEX}, s AS (SELECT subset, count(*) AS n FROM lines GROUP BY subset) SELECT m AS modality, count(*) AS n_subsets, CAST(sum(n) AS BIGINT) AS n_rows FROM s, unnest(string_split(subset, '+')) AS u(m) GROUP BY m")
def describe_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index(spark, sf_dir).describe()


@BOOK.add(f"WITH {LINE_INDEX} SELECT DISTINCT subset FROM lines WHERE list_contains(string_split(subset, '+'), 'F') AND list_contains(string_split(subset, '+'), 'R')")
def subsets_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = line_index(spark, sf_dir)
    return spark.createDataFrame([(s,) for s in index.subsets_with(["F", "R"])], "subset string")


@BOOK.add(
    """WITH picked AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey),
tiles AS (SELECT o_custkey, ntile(10) OVER (ORDER BY md5(o_custkey || ':0'), CAST(o_custkey AS VARCHAR)) AS t FROM picked)
SELECT CASE WHEN t <= 8 THEN 'train' WHEN t = 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n_groups, CAST(sum(o_custkey) AS BIGINT) AS keys FROM tiles GROUP BY 1"""
)
def cluster_splits_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two states, one a customer, and customers in ten hash-ordered tiles: 8 train, 1 val, 1 test."""
    picked = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F")).groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    return splits.ntile_splits(picked, F.col("o_custkey")).groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("o_custkey").alias("keys"))


@BOOK.add(
    """WITH g AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS g FROM orders), n AS (SELECT count(*) AS n FROM g),
r AS (SELECT g, row_number() OVER (ORDER BY md5(g || ':3'), g) AS k FROM g),
s AS (SELECT g, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM r, n)
SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN s ON s.g = CAST(o_custkey AS VARCHAR) GROUP BY split"""
)
def cluster_splits_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey").cast("string"))
    placed = orders.join(group_splits(orders, "g", (0.7, 0.2, 0.1), 3), "g")
    return placed.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"))


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def semi_join_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@BOOK.add(
    """WITH m AS (SELECT 'S' || l_suppkey AS genome_feature_id, CAST(l_partkey AS VARCHAR) AS uniprot_id, l_returnflag AS species FROM lineitem WHERE l_linenumber <= 2),
g AS (SELECT genome_feature_id, min(species) AS species FROM m WHERE genome_feature_id IS NOT NULL GROUP BY 1),
u AS (SELECT uniprot_id, min(species) AS species FROM m GROUP BY 1),
i AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'S' || (p_partkey % 200) END AS genome_feature_id, CAST(p_partkey AS VARCHAR) AS uniprot_id FROM part)
SELECT uniprot_id, coalesce(genome_feature_id, '') AS genome_feature_id, coalesce(coalesce(g.species, u.species), '') AS species FROM i LEFT JOIN g USING (genome_feature_id) LEFT JOIN u USING (uniprot_id)"""
)
def attach_lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("genome_feature_id"), F.col("l_partkey").cast("string").alias("uniprot_id"), F.col("l_returnflag").alias("species"))
    k = F.col("p_partkey")
    ids = table(spark, sf_dir, "part").select(F.when(k % 3 == 0, F.concat(F.lit("S"), (k % 200).cast("string"))).alias("genome_feature_id"), k.cast("string").alias("uniprot_id"))
    return attach_lookup(ids, m, columns=("species",)).select("uniprot_id", F.coalesce("genome_feature_id", F.lit("")).alias("genome_feature_id"), F.coalesce("species", F.lit("")).alias("species"))


@BOOK.add(
    """WITH e AS (SELECT DISTINCT user_id AS doc_id FROM events), t AS (SELECT doc_id, length(text) AS text_length FROM documents)
SELECT doc_id, CAST(text_length AS INTEGER) AS text_length, quality, e.doc_id IS NOT NULL AS has_events FROM t FULL JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id) FULL JOIN e USING (doc_id)"""
)
def master_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    base = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("int").alias("text_length"))
    return master.fold_outer(base, [(table(spark, sf_dir, "labels"), "doc_id", "quality", None, "quality"), (events, "doc_id", "doc_id", "exists", "events")])


@BOOK.add(
    """WITH a AS (SELECT doc_id, lang, TRUE AS has_quality, FALSE AS has_toxic FROM documents RIGHT JOIN (SELECT doc_id FROM labels WHERE quality = 0) q USING (doc_id)),
b AS (SELECT doc_id, lang, FALSE AS has_quality, TRUE AS has_toxic FROM documents RIGHT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, lang, has_quality, has_toxic FROM u UNION ALL SELECT doc_id, lang, FALSE, FALSE FROM documents d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id IS NOT DISTINCT FROM d.doc_id AND u.lang IS NOT DISTINCT FROM d.lang)"""
)
def exclusive_assay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    base = table(spark, sf_dir, "documents").select("doc_id", "lang")
    assays = {"quality": labels.where("quality = 0").select("doc_id"), "toxic": labels.where("toxic = 1").select("doc_id")}
    return master.exclusive_union(base, assays, "doc_id").select("doc_id", "lang", "has_quality", "has_toxic")


@BOOK.add(
    """WITH s AS (SELECT o_orderkey, o_custkey, 7 * CAST(o_orderstatus = 'P' AS INT) + 4 * CAST(o_orderpriority = '1-URGENT' AS INT) AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, md5(o_orderkey || ':1'), o_orderkey) AS k FROM s) SELECT o_custkey, o_orderkey FROM r WHERE k = 1"""
)
def representative_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("p", F.col("o_orderstatus") == "P").withColumn("u", F.col("o_orderpriority") == "1-URGENT")
    return splits.representatives(orders, "o_custkey", splits.priority({"p": 7, "u": 4}), "o_orderkey", 1).select("o_custkey", "o_orderkey")


@BOOK.add(
    """WITH t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':5'), doc_id) AS k FROM documents JOIN labels USING (doc_id)),
n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM t GROUP BY quality)) SELECT doc_id, quality FROM t, n WHERE k <= least(n, 20000)"""
)
def balanced_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")
    return splits.balanced(rows, "quality", "doc_id", 20_000, 5)


@BOOK.add("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':9'), o_orderkey LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey", 9)


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("rid"), F.col("l_orderkey").alias("root_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_returnflag") == "R").alias("returned"),
        F.when(k % 10 == 3, "val").when(k % 10 == 6, "test").otherwise("train").alias("split"),
    )


SPLIT_LINES = """s AS (SELECT l_orderkey || '-' || l_linenumber AS rid, l_orderkey AS root_id, l_partkey AS part, l_suppkey AS supp, l_returnflag = 'R' AS returned,
  CASE (l_orderkey * 7 + l_linenumber) % 10 WHEN 3 THEN 'val' WHEN 6 THEN 'test' ELSE 'train' END AS split FROM lineitem)"""


@BOOK.add(
    f"""WITH {SPLIT_LINES}, f AS (SELECT part, bool_or(split = 'train') AS t, bool_or(split = 'val') AS v, bool_or(split = 'test') AS e FROM s GROUP BY part),
x AS (SELECT s.*, f.t, f.v, f.e FROM s JOIN f USING (part)), c AS (SELECT 'all' AS cohort, * FROM x UNION ALL SELECT 'returned', * FROM x WHERE returned)
SELECT cohort, split, count(DISTINCT root_id) AS roots,
 count(DISTINCT CASE WHEN t AND NOT (CASE split WHEN 'val' THEN e ELSE v END) THEN root_id END) AS mixed_train_only,
 count(DISTINCT CASE WHEN NOT t AND (CASE split WHEN 'val' THEN e ELSE v END) THEN root_id END) AS mixed_other_only,
 count(DISTINCT CASE WHEN t AND (CASE split WHEN 'val' THEN e ELSE v END) THEN root_id END) AS mixed_both,
 count(DISTINCT CASE WHEN CAST(t AS INT) + CAST(v AS INT) + CAST(e AS INT) = 1 THEN root_id END) AS pure
FROM c WHERE split <> 'train' GROUP BY cohort, split"""
)
def leak_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.one_hop_report(split_lines(spark, sf_dir), "root_id", "part", {"all": F.lit(True), "returned": F.col("returned")})


@BOOK.add(
    f"""WITH {SPLIT_LINES}, o AS (SELECT root_id, split, part FROM s), tr AS (SELECT DISTINCT root_id FROM s WHERE split = 'train'), tp AS (SELECT DISTINCT part FROM s WHERE split = 'train')
SELECT o.root_id NOT IN (SELECT root_id FROM tr) AS pure_root_id, o.part NOT IN (SELECT part FROM tp) AS pure_part, count(*) AS n_rows FROM o WHERE split <> 'train' GROUP BY 1, 2"""
)
def leak_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.venn(split_lines(spark, sf_dir).select("root_id", "split", "part"), ["root_id", "part"])


@BOOK.add()  # the walk of all orders to its end is too slow as recursive SQL
def leak_transitive_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, as many hops as the operator takes."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("a"), F.floor(F.col("o_totalprice") / 50).alias("b"), F.when(F.col("o_orderkey") % 100 == 1, "train").otherwise("val").alias("split"))
    return leakage.hop_profile(rows, "rid", ["a", "b"]).select(F.col("hop").cast("int").alias("hop"), "n_new")


PRESENCE = """p AS (SELECT l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 45) AS n, bool_or(l_returnflag = 'R' AND l_discount > 0.08) AS r, bool_or(l_tax > 0.07 AND l_linenumber > 5) AS t FROM lineitem GROUP BY l_partkey),
g AS (SELECT CAST(a AS INT) || '' || CAST(n AS INT) || CAST(r AS INT) || CAST(t AS INT) AS signature, CAST(8 * CAST(a AS INT) + 4 * CAST(n AS INT) + 2 * CAST(r AS INT) + CAST(t AS INT) AS BIGINT) AS mask, count(*) AS n FROM p WHERE n OR r OR t GROUP BY 1, 2)"""
FLAGS = ["a", "n", "r", "t"]


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag = F.col, F.col("l_returnflag")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(flag == "A").alias("a"), F.bool_or((flag == "N") & (q("l_linestatus") == "O") & (q("l_quantity") > 45)).alias("n"), F.bool_or((flag == "R") & (q("l_discount") > 0.08)).alias("r"), F.bool_or((q("l_tax") > 0.07) & (q("l_linenumber") > 5)).alias("t"))
    return signatures.signature_counts(parts, FLAGS, ["n", "r", "t"])


@BOOK.add(f"WITH {PRESENCE} SELECT signature, mask, n FROM g")
def presence_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(spark, sf_dir)


@BOOK.add(f"WITH {PRESENCE} SELECT x.signature, x.mask, x.n, CAST(sum(y.n) AS BIGINT) AS coverage FROM g x JOIN g y ON (y.mask & x.mask) = x.mask GROUP BY 1, 2, 3")
def superset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.superset_coverage(presence(spark, sf_dir))


@BOOK.add(
    f"""WITH {PRESENCE}, k AS (SELECT * FROM (VALUES (8, 0), (4, 1), (10, 2), (12, 3)) v(picked, place)),
f AS (SELECT g.*, picked, row_number() OVER (PARTITION BY mask ORDER BY CAST((picked & 2) <> 0 AS INT) DESC, bit_count(picked) DESC, place) AS i FROM g LEFT JOIN k ON (picked & mask) = picked WHERE mask NOT IN (8, 4, 10, 12))
SELECT signature, mask, n, CAST(picked AS BIGINT) AS picked FROM f WHERE i = 1"""
)
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.greedy_assignment(presence(spark, sf_dir), [8, 4, 10, 12], FLAGS, ["r"])


@BOOK.add("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __key__, o_orderkey, o_custkey, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def merge_with_row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return master.merge_payload(orders, [lines], ["o_orderkey"]).select("__key__", "o_orderkey", "o_custkey", "n_lines")


@BOOK.add()
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return master.schema_diff(orders, orders.drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("float")).withColumn("tok_a", F.lit(1)))


@BOOK.add("SELECT p_partkey, CASE WHEN c >= 85 THEN p_type ELSE 'other' END AS p_type FROM part JOIN (SELECT p_type AS t, count(*) AS c FROM part GROUP BY 1) ON t = p_type")
def rare_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.fold_rare(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", 85)


@BOOK.add(
    """WITH d AS (SELECT doc_id, n_chars % 50 AS k, source, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS r FROM documents),
b AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY r, source) AS x FROM d) SELECT doc_id, k, source FROM b WHERE x = 1"""
)
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50).alias("k"), "source")
    return master.prefer_source(docs, "k", "source", ["src3", "src1"]).select("doc_id", "k", "source")


@BOOK.add("SELECT l_partkey, min(l_suppkey) AS first_supp FROM (SELECT l_partkey, l_suppkey, rank() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM lineitem) WHERE k = 1 GROUP BY l_partkey")
def id_map_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("first_supp"), "l_orderkey")
    return master.id_map(lines, "l_partkey", "first_supp", order="l_orderkey").select("l_partkey", "first_supp")


@BOOK.add(
    """WITH s AS (SELECT DISTINCT l_returnflag AS subset, CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'val' END AS split, 'shard_' || l_linenumber || '.parquet' AS shard, l_linenumber AS n FROM lineitem)
SELECT subset, split, shard, printf('data_%04d.parquet', row_number() OVER (PARTITION BY subset ORDER BY split, n, shard) - 1) AS published FROM s"""
)
def shard_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("subset"), F.when(F.col("l_linestatus") == "F", "train").otherwise("val").alias("split"), F.concat(F.lit("shard_"), F.col("l_linenumber").cast("string"), F.lit(".parquet")).alias("shard")).distinct()
    return published_names(shards)


@BOOK.add(
    """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS both_sides,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS either"""
)
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_sides"), F.count("*").alias("either"))


@BOOK.add("SELECT n_name, count(*) AS n, CAST(round(avg(c_acctbal), 4) AS DOUBLE) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY n_name")
def taxonomy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
