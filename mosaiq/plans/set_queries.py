"""Interval, track, statistics, hierarchy and vote queries on events, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import codecs
from mosaiq.operators import annotations, intervals
from mosaiq.plans.book import Book
from mosaiq.sources.storage import table

BOOK = Book()

#: Seconds from this instant are the coordinates of events.
EPOCH = "2024-01-01 00:00:00"
SIGNAL = f"""sig AS (SELECT event_id, event_type AS chrom, user_id, value, CAST(date_diff('second', TIMESTAMP '{EPOCH}', ts) AS BIGINT) AS s0 FROM events),
iv AS (SELECT event_id, chrom, user_id, value, s0 AS s, s0 + 1 + CAST(floor(value * 100) AS BIGINT) % 5000 AS e FROM sig)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of seconds on their type."""
    t = table(spark, sf_dir, "events")
    s = F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))
    return t.select("event_id", F.col("event_type").alias("chrom"), "user_id", "value", s.alias("s"), (s + 1 + F.floor(F.col("value") * 100) % 5000).alias("e"))


@BOOK.add(
    f"""WITH {SIGNAL}, r AS (SELECT *, max(e) OVER (PARTITION BY chrom, user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT chrom, user_id, min(s) AS s, max(e) AS e, max(value) AS value FROM i GROUP BY chrom, user_id, island"""
)
def interval_union_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_union(signal(spark, sf_dir), ["chrom", "user_id"], "s", "e", "value").select("chrom", "user_id", "s", "e", "value")


@BOOK.add(f"WITH {SIGNAL}, size AS (SELECT chrom, max(s) - 100000 AS size FROM iv WHERE chrom < 'p' GROUP BY chrom) SELECT event_id, greatest(s, 0) AS s, least(e, size) AS e FROM iv JOIN size USING (chrom) WHERE greatest(s, 0) < least(e, size)")
def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = signal(spark, sf_dir)
    sizes = iv.where("chrom < 'p'").groupBy("chrom").agg((F.max("s") - 100000).alias("size"))
    return intervals.clipped(iv, sizes, "chrom", "s", "e").select("event_id", "s", "e")


@BOOK.add(f"WITH {SIGNAL} SELECT a.event_id AS left_id, b.event_id AS right_id, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.event_id % 10 = 0 AND b.event_id % 10 <> 0")
def binned_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = signal(spark, sf_dir)
    a = iv.where("event_id % 10 = 0").select("chrom", F.col("event_id").alias("left_id"), F.col("s").alias("ls"), F.col("e").alias("le"))
    b = iv.where("event_id % 10 <> 0").select("chrom", F.col("event_id").alias("right_id"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.range_join(a, b, ["chrom"], "ls", "le", "rs", "re", 4096).select("left_id", "right_id", (F.least("le", "re") - F.greatest("ls", "rs")).alias("shared"))


@BOOK.add()  # a row for each position of each event is too much for SQL
def track_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature around each event's start, against all intervals."""
    iv = signal(spark, sf_dir)
    features = iv.select("event_id", "chrom", (F.col("s") - 10).alias("a"), (F.col("s") + 10).alias("b"))
    track = iv.select("chrom", "s", "e", "value")
    cut = intervals.track_slice(features, track, ["chrom"], "event_id", "a", "b", "s", "e", "value", 4096)
    real = F.filter("track", lambda x: ~F.isnan(x))
    return cut.select("event_id", F.size("track").cast("bigint").alias("n"), F.size(real).cast("bigint").alias("covered"), F.round(F.aggregate(real, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@BOOK.add(
    """WITH q AS (SELECT event_type, quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT event_id, CASE WHEN lo = hi THEN 5 ELSE least(10, 1 + len(list_filter(edges, lambda x: x < value))) END AS label FROM events JOIN q USING (event_type)"""
)
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.quantile_labels(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "label")


@BOOK.add("SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 25).alias("bin")).agg(F.count("*").alias("n"))


@BOOK.add(
    """WITH t AS (SELECT label, vec_id, unnest(embedding) AS x FROM embeddings), r AS (SELECT label, min(CAST(x AS DOUBLE)) AS lo, max(CAST(x AS DOUBLE)) AS hi FROM t GROUP BY label)
SELECT vec_id, round(sum((CAST(x AS DOUBLE) - lo) / (hi - lo)), 4) AS total FROM t JOIN r USING (label) GROUP BY vec_id"""
)
def context_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("track"))
    scaled = intervals.minmax_by_context(tracks, "label", "track")
    return scaled.select("vec_id", F.round(F.aggregate("track", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@BOOK.add("SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.1)) / len(embedding) AS share FROM embeddings WHERE len(list_filter(embedding, lambda x: x < -0.1)) / len(embedding) <= 0.3")
def nan_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under -0.1 stand for unmeasured ones."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x < F.lit(-0.1), F.lit(float("nan"))).otherwise(x.cast("double"))).alias("track"))
    return t.select("vec_id", intervals.nan_ratio("track").alias("share")).where("share <= 0.3")


@BOOK.add(
    f"""WITH {SIGNAL}, w AS (SELECT event_id, s, e, lag(e) OVER p AS pe, lead(s) OVER p AS ns, chrom FROM iv WINDOW p AS (PARTITION BY chrom, user_id ORDER BY event_id)),
a AS (SELECT *, CASE WHEN chrom < 'p' THEN 1000 ELSE 300 END AS up, CASE WHEN chrom < 'p' THEN 300 ELSE 1000 END AS down FROM w),
b AS (SELECT *, greatest(1, coalesce(greatest(s - up, pe + 1), s - up)) AS fs, coalesce(least(e + down, ns), e + down) AS fe FROM a)
SELECT event_id, CASE WHEN s - fs < 200 THEN greatest(1, s - 200) ELSE fs END AS flank_start, CASE WHEN fe - e < 200 THEN e + 200 ELSE fe END AS flank_end FROM b"""
)
def flank_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = signal(spark, sf_dir)
    near = F.col("chrom") < "p"
    out = intervals.flanks(iv, ["chrom", "user_id"], "event_id", "s", "e", F.when(near, 1000).otherwise(300), F.when(near, 300).otherwise(1000))
    return out.select("event_id", "flank_start", "flank_end")


@BOOK.add(
    f"""WITH {SIGNAL}, c AS (SELECT * FROM (VALUES ('click', 0, 2000000, 'q1', 500), ('click', 2000000, 9000000, 'q2', 0), ('view', 1000, 5000000, 'q3', 77)) v(chrom, t_start, t_end, q_chrom, q_start))
SELECT event_id, q_chrom AS chrom, s + q_start - t_start AS s, e + q_start - t_start AS e FROM iv JOIN c USING (chrom) WHERE s >= t_start AND e <= t_end"""
)
def liftover_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = spark.createDataFrame([("click", 0, 2000000, "q1", 500), ("click", 2000000, 9000000, "q2", 0), ("view", 1000, 5000000, "q3", 77)], "chrom string, t_start bigint, t_end bigint, q_chrom string, q_start bigint")
    return intervals.liftover(signal(spark, sf_dir), chain, "chrom", "s", "e", 1 << 20).select("event_id", "chrom", "s", "e")


@BOOK.add(
    """WITH RECURSIVE n AS (SELECT conv_id || ':' || turn AS node, conv_id || ':' || (turn - 1) AS parent FROM conversations),
w AS (SELECT node, node AS root, 0 AS depth FROM n WHERE parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, w.root, w.depth + 1 FROM w JOIN n ON n.parent = w.node)
SELECT node, root, depth FROM w"""
)
def hierarchy_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    nodes = t.select(F.concat_ws(":", "conv_id", "turn").alias("node"), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("parent"))
    return annotations.roots(nodes, "node", "parent")


@BOOK.add("SELECT 1000 + n_nationkey AS taxid, n_name AS nation, r_name AS region, 'world' AS root FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 100 + r_regionkey, NULL, r_name, 'world' FROM region UNION ALL SELECT 1, NULL, NULL, 'world'")
def lineage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    world = spark.createDataFrame([(1, 1, "root", "world")], "taxid int, parent int, rank string, name string")
    regions = r.select((F.col("r_regionkey") + 100).alias("taxid"), F.lit(1).alias("parent"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    nations = n.select((F.col("n_nationkey") + 1000).alias("taxid"), (F.col("n_regionkey") + 100).alias("parent"), F.lit("nation").alias("rank"), F.col("n_name").alias("name"))
    nodes = world.unionByName(regions).unionByName(nations)
    return annotations.lineage_ranks(nodes.drop("name"), nodes.select("taxid", "name"), ["nation", "region", "root"])


@BOOK.add("SELECT n.node AS node FROM (SELECT DISTINCT conv_id || ':' || turn AS node, conv_id, turn FROM conversations) n JOIN (SELECT conv_id, max(turn) - 1 AS t FROM conversations GROUP BY conv_id) m ON m.conv_id = n.conv_id AND m.t = n.turn")
def isoform_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    nodes = t.select(F.concat_ws(":", "conv_id", "turn").alias("node"), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("parent"))
    return annotations.isoforms(nodes, "node", "parent").select("node")


@BOOK.add(
    """WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS token, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), a AS (SELECT label, token, round(avg(x), 6) AS p FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, token) AS k FROM a) SELECT label, CAST(token AS INTEGER) AS token, p AS probability FROM r WHERE k = 1"""
)
def vote_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = codecs.soft_vote(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("p")), ["label"], "p")
    return voted.select("label", "token", F.round("probability", 6).alias("probability"))


@BOOK.add("WITH v AS (SELECT l_partkey, l_linenumber AS token, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, token) AS k FROM v) SELECT l_partkey, token, n / a AS share FROM r WHERE k = 1")
def vote_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.hard_vote(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linenumber", 7)


@BOOK.add(
    """WITH t AS (SELECT source, string_split(text, ' ') AS w FROM documents), n AS (SELECT source, len(w) AS n FROM t), u AS (SELECT source, count(DISTINCT x) AS vocabulary FROM (SELECT source, unnest(w) AS x FROM t) GROUP BY source)
SELECT source, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, round(quantile_cont(n, 0.95), 6) AS q95, round(quantile_cont(n, 0.99), 6) AS q99, CAST(sum(n) AS BIGINT) AS tokens, any_value(vocabulary) AS vocabulary FROM n JOIN u USING (source) GROUP BY source"""
)
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("source", F.split("text", " ", -1).alias("w"))
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 6).alias(f"q{int(p * 100)}")
    stats = t.select("source", F.size("w").cast("bigint").alias("n")).groupBy("source").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), *map(q, (0.25, 0.5, 0.75, 0.95, 0.99)), F.sum("n").alias("tokens"))
    words = t.select("source", F.explode("w").alias("x")).distinct().groupBy("source").agg(F.count("*").alias("vocabulary"))
    return stats.join(words, "source")


@BOOK.add("SELECT a, b, a = b OR (a || '>' || b) IN ('rna_seq>aa_seq', 'text>aa_seq') OR (track_a = track_b) AS supported FROM (VALUES ('rna_seq', 'nucleic'), ('cage', 'nucleic'), ('aa_seq', 'protein'), ('text', 'text')) x(a, track_a), (VALUES ('rna_seq', 'nucleic'), ('cage', 'nucleic'), ('aa_seq', 'protein'), ('text', 'text')) y(b, track_b)")
def pathway_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which input and target go together: on one track, or in the list of allowed pairs (a registry of a few names)."""
    track = {"rna_seq": "nucleic", "cage": "nucleic", "aa_seq": "protein", "text": "text"}
    allowed = {("rna_seq", "aa_seq"), ("text", "aa_seq")}
    return spark.createDataFrame([(a, b, track[a] == track[b] or (a, b) in allowed) for a in track for b in track], "a string, b string, supported boolean")


@BOOK.add(
    """WITH m AS (SELECT user_id, event_type, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM m)
SELECT user_id, event_type, n, v FROM r WHERE k = 1"""
)
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@BOOK.add(
    """WITH v AS (SELECT vec_id, embedding[1] * 10 AS x, embedding[2] * 10 AS y, embedding[3] * 10 AS z, label FROM embeddings), a AS (SELECT label % 3 AS key, vec_id AS residue, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM v WHERE vec_id % 4 = 0),
b AS (SELECT label % 3 AS key, vec_id AS vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM v WHERE vec_id % 4 <> 0)
SELECT a.key, a.residue, count(b.vid) AS n_vertices, coalesce(CAST(sum(b.vid) AS BIGINT), -1) AS total FROM a LEFT JOIN b ON a.key = b.key AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.5 * 0.5 GROUP BY 1, 2"""
)
def spatial_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = [(F.get("embedding", k) * F.lit(10).cast("float")).cast("double").alias(c) for k, c in enumerate("xyz")]
    points = e.select((F.col("label") % 3).alias("key"), "vec_id", *at)
    atoms, vertices = points.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "residue"), points.where("vec_id % 4 <> 0").withColumnRenamed("vec_id", "vid")
    out = intervals.nearest_vertices(atoms, vertices, "key", "residue", 0.5, {"total": F.sum("vid").cast("double")})
    return out.select("key", "residue", "n_vertices", F.when(F.isnan("total"), -1).otherwise(F.col("total")).cast("bigint").alias("total"))
