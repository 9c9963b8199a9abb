"""Secret scans by patterns and by a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans. The battery looks at runs of code characters of ``LEAST`` or more that
mix character classes. The encoding inferred from a run's characters gives its alphabet; then three tests ask how
often a text-like run (an identifier, a path, a slug) of that encoding and length looks so random:

* chi-squared alphabet uniformity: the pairs of equal characters, the statistic's only part that varies, against
  the chance ``repeat`` of written text in that encoding;
* runs: changes between character classes, after separators are left out and a capital before a small letter counts
  as one (so words, however joined, have next to no changes), against ``CHANGES`` of text;
* serial correlation of neighbouring characters' codes, against the spread ``SERIAL`` that text has.

Each gives a normal score with the mean and spread that identifiers and paths of public Python sources have (13,877
runs; the figures are the constants below). The scores are added with ``WEIGHTS``, and the sum's spread takes their
correlation into account, so the run's chance is that of a text-like run to reach the sum. Chances are then cut by
Benjamini-Hochberg at ``FALSE_SHARE`` in each class of lengths apart, as short runs have little power: counts
over all rows by class and step of -log10 of the chance, of which the driver sees one row a class.

A run that holds a hex or access span and more is a candidate as a whole, beside that span; one that is such a span
or meets an assignment is none. Spans are in code points, ends exclusive, and ordered by start, then kind as in
``KINDS``. A null text is empty. Repeated rows stay, an empty table gives no rows, and only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.textutil import documents, stored

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE, LEAST = 12, 20
CHUNK = 256
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Za-z0-9+/_-]*[a-z][A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
# (name, characters, chance that two characters of text are equal)
ENCODINGS = [
    ("digits", "[0-9]+", 0.20),
    ("hex", "[0-9a-f]+|[0-9A-F]+", 0.11),
    ("base32", "[A-Z2-7]+=*", 0.065),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", 0.065),
    ("base62", "[0-9A-Za-z]+", 0.048),
    ("base64", "[0-9A-Za-z+/_-]+=*", 0.048),
]
REPEAT_SPREAD = 2.0  # variance of the pairs of equal characters, as a multiple of their mean
CHANGES, CHANGE_BASE, CHANGE_SPREAD = 0.05, 0.3, 1.5  # of a character, of a run; variance as a multiple of the mean
SERIAL = 0.25
WEIGHTS, SCORE_CORRELATION = (1.0, 1.5, 0.3), 0.3  # of the tests; of the first two scores with each other
FALSE_SHARE = 0.01
STEPS = 20  # of -log10 of the chance, for each unit
LENGTHS = [32, 64]  # classes: under 32, under 64, and longer


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))


def _phi(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(-F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-600.0)), F.lit(600.0))))


def _with_starts(t: DataFrame, name: str, pattern: str) -> DataFrame:
    """Columns for the places of a pattern's matches: what lies between them, the lengths of each gap and match, and sums of ``CHUNK`` of them, so that a place costs a chunk and the chunks before, not all before."""
    t = t.withColumn(f"_{name}_between", F.when(F.size(f"_{name}") > 0, F.transform(F.split("_text", pattern, -1), F.length)))
    gaps = F.zip_with(F.slice(f"_{name}_between", 1, F.size(f"_{name}")), F.transform(f"_{name}", F.length), lambda a, b: a + b)
    t = t.withColumn(f"_{name}_gaps", gaps)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_{name}") - 1) / CHUNK).cast("int")), lambda k: _sum(F.slice(F.col(f"_{name}_gaps"), k * CHUNK + 1, F.lit(CHUNK))))
    return t.withColumn(f"_{name}_sums", F.when(F.size(f"_{name}") > 0, sums))


def _spans(name: str, kind: int) -> Column:
    """Structs (start, kind, end, text) of a pattern's matches."""

    def one(m: Column, i: Column) -> Column:
        k = F.floor(i / CHUNK).cast("int")
        start = _sum(F.slice(f"_{name}_sums", 1, k)) + _sum(F.slice(F.col(f"_{name}_gaps"), k * CHUNK + 1, i - k * CHUNK)) + F.get(f"_{name}_between", i)
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("text"))

    return F.transform(F.col(f"_{name}"), one)


def _chance(s: Column) -> Column:
    """The chance that a text-like run of its encoding and length looks as random, by the battery."""
    body = F.rtrim(s, F.lit("="))
    n = F.length(body).cast("double")
    repeat = F.coalesce(*[F.when(body.rlike(f"^(?:{e[1]})$"), F.lit(e[2])) for e in ENCODINGS], F.lit(ENCODINGS[-1][2]))
    chars = F.split(body, "")
    squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), 2)))
    expected = n * (n - 1) / 2 * repeat
    uniform = (expected - (squares - n) / 2) / F.sqrt(REPEAT_SPREAD * expected)
    joined = F.regexp_replace(F.regexp_replace(body, "[+/_-]", ""), "[A-Z](?=[a-z])", "a")
    classes = F.translate(joined, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "1" * 26 + "2" * 26)
    changes = F.greatest(F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")) - 1, F.lit(0))
    usual = CHANGES * F.greatest(F.length(joined) - 1, F.lit(0)) + CHANGE_BASE
    runs = (changes - usual) / F.sqrt(CHANGE_SPREAD * usual)
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    average = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(codes, lambda x: x - average)
    total = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    products = F.zip_with(F.slice(centred, 1, F.length(body) - 1), F.slice(centred, 2, F.length(body) - 1), lambda a, b: a * b)
    serial = F.when(total > 0, F.abs(F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / total)).otherwise(F.lit(1.0))
    steady = 1 - serial / SERIAL  # the mean and spread of a half-normal are near 0.8 and 0.6 of the whole's
    u, r, c = WEIGHTS
    spread = (u * u + r * r + c * c + 2 * SCORE_CORRELATION * u * r) ** 0.5
    return _phi(-(u * uniform + r * runs + c * steady) / spread)


def _length_class(n: Column) -> Column:
    return F.lit(0) + sum((n >= x).cast("int") for x in LENGTHS)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """``id, base, mixed`` (and ``_row``, the whole row): base spans, and the battery's candidates with their chance and length class."""
    keep = ["_row"] if row else []
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if row else []
    t = df.select(F.col(id_col).alias("id"), *whole, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("mixed", MIXED)):
        t = t.withColumn(f"_{name}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    t = t.withColumn("_value", F.when(F.size("_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("mixed", MIXED)):
        t = _with_starts(t, name, pattern)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,text:string>>")
    spans = {name: F.when(F.size(f"_{name}") > 0, _spans(name, k)).otherwise(none) for k, name in enumerate(("assign", "access", "hex", "mixed"))}
    long_value = F.filter(spans["assign"], lambda x, i: F.length(F.get(F.col("_value"), i)) >= LEAST_VALUE)
    t = t.select("id", *keep, F.array_sort(F.concat(long_value, spans["access"], spans["hex"])).alias("base"), long_value.alias("_assigned"), spans["mixed"].alias("_m"))
    # hex and access spans lie inside a candidate's text whole, which is one beside them if it is longer; assignments may begin before it
    longer = F.filter("_m", lambda x: ~x["text"].rlike(f"^(?:{HEX}|{ACCESS})$"))
    clear = F.filter(longer, lambda x: ~F.exists("_assigned", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    mixed = F.transform(clear, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _chance(x["text"]).alias("chance"), _length_class(x["end"] - x["start"]).alias("class")))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return t.select("id", *keep, bare.alias("base"), mixed.alias("mixed"))


def _step(chance: Column) -> Column:
    return F.floor(-F.log10(F.greatest(chance, F.lit(1e-300))) * STEPS).cast("int")


def cuts(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[int | None]:
    """For each length class the least step of the chance that Benjamini-Hochberg rejects at; None rejects nothing."""
    each = scanned.select(F.explode("mixed").alias("m")).groupBy(F.col("m.class").alias("class"), _step(F.col("m.chance")).alias("step")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("class")
    ranked = each.withColumn("rank", F.sum("n").over(by.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= false_share * F.col("rank") / F.col("all")).groupBy("class").agg(F.min("step").alias("step"))
    found = {r["class"]: r["step"] for r in passed.collect()}
    return [found.get(k) for k in range(len(LENGTHS) + 1)]


def all_spans(steps: list[int | None]) -> Column:
    """``start, kind, end`` of base spans and of the candidates that the cuts reject."""
    tests = [(F.lit(k), s) for k, s in enumerate(steps) if s is not None]
    random = F.filter("mixed", lambda x: F.coalesce(*[F.when(x["class"] == k, _step(x["chance"]) >= s) for k, s in tests], F.lit(False)))
    return F.array_sort(F.concat("base", F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with every span of the text replaced by ``mask``; spans that overlap are replaced once. Other columns stay."""
    names = df.columns
    whole = stored(scan(df, text_col, text_col, row=True).drop("id"), "secret-scan")  # scanned once; the cuts need all rows
    steps = cuts(whole)
    t = whole.select("_row", all_spans(steps).alias("s"))
    merged = F.aggregate(
        "s",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] < F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    t = t.withColumn("m", F.when(F.size("s") > 0, merged))
    text = F.col(f"_row.`{text_col}`")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("m", lambda x: x["end"]))
    ends = F.concat(F.transform("m", lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.size("s") > 0, F.array_join(parts, mask)).otherwise(text)
    return t.select(*[clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = stored(scan(documents(spark, sf_dir)), "op1")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    found = scanned.withColumn("found", all_spans(cuts(scanned)))
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
