"""Text formats as lazy DataFrames: delimited tables, GFF3, BED, FASTA, taxonomy dumps, genetic codes, nested JSON, file-name grammars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GFF_COLUMNS = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
#: Fixed value: the public form of protein accession numbers.
ACCESSION = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str | None = "#", header: bool = False, file_name: bool = False) -> DataFrame:
    """A delimited text table with a given schema, and the name of each row's file if asked."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)) if file_name else df


def attribute(name: str, column: str = "attributes") -> Column:
    """A GFF3 attribute's value, URL-decoded; null if absent."""
    found = F.regexp_extract(column, rf"(?:^|;)\s*{re.escape(name)}=([^;]*)", 1)
    return F.when(F.col(column).rlike(rf"(?:^|;)\s*{re.escape(name)}="), F.try_url_decode(found))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    return gff3(spark.read.text(path))


def gff3(lines: DataFrame) -> DataFrame:
    """Feature rows of lines in ``value``: nine columns, ``id`` and ``parent``; ids that several rows share get a number in the order of their places."""
    parts = F.split(F.col("value"), "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(parts) == 9)).select(*[F.get(parts, k).alias(c) for k, c in enumerate(GFF_COLUMNS)])
    rows = rows.withColumns({"start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")}).withColumns({"id": attribute("ID"), "parent": attribute("Parent")})
    w = Window.partitionBy("id")
    n = F.row_number().over(w.orderBy("seqid", "start", "end", "type", "attributes"))
    named = rows.where("id is not null").withColumn("_all", F.count("*").over(w)).withColumn("_n", n)
    named = named.withColumn("id", F.when(F.col("_all") > 1, F.concat_ws("_", "id", "_n")).otherwise(F.col("id"))).drop("_all", "_n")
    return named.unionByName(rows.where("id is null"))  # most rows have no id and need no number


def bed(lines: DataFrame) -> DataFrame:
    """``chrom, start, end`` and the rest as an array of lines in ``value`` with three fields or more; comments and browser lines go."""
    parts = F.split(F.trim("value"), r"\s+")
    kept = lines.where(~F.col("value").rlike("^(#|track|browser)") & (F.size(parts) >= 3))
    return kept.select(F.get(parts, 0).alias("chrom"), F.get(parts, 1).try_cast("bigint").alias("start"), F.get(parts, 2).try_cast("bigint").alias("end"), F.slice(parts, 4, 1000).alias("rest"))


def fasta_lines(df: DataFrame, header: list[str], sequence: str) -> DataFrame:
    """``value``: a record for each row, its header columns joined by a pipe; rows without a sequence go."""
    return df.where(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), F.concat_ws("|", *header), F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, header: list[str], sequence: str) -> None:
    fasta_lines(df, header, sequence).write.option("compression", "gzip").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header, sequence`` of records; records are split at ``>`` that begins a line, so any file size is read in parts."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where(F.length(F.trim("v")) > 0)
    return raw.select(F.trim(F.regexp_extract("v", r"^[^\n]*", 0)).alias("header"), F.regexp_replace(F.regexp_extract("v", r"(?s)\n(.*)$", 1), r"\s", "").alias("sequence"))


def chunked(sequences: DataFrame, key: str, sequence: str, size: int) -> DataFrame:
    """``key, chunk, part``: a long sequence as rows of ``size`` letters."""
    n = F.ceil(F.length(sequence) / size).cast("int")
    return sequences.where(F.length(sequence) > 0).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col(sequence), k * size + 1, F.lit(size)))).alias("chunk", "part"))


def sequence_slices(features: DataFrame, chunks: DataFrame, key: str, feature: str, start: str, end: str, size: int) -> DataFrame:
    """``feature, slice`` of [start, end) by joining the chunks that it spans; letters past the end of a sequence are not there."""
    wanted = features.where(F.col(start) < F.col(end)).withColumn("chunk", F.explode(F.sequence(F.floor(F.col(start) / size).cast("int"), F.floor((F.col(end) - 1) / size).cast("int"))))
    got = wanted.join(chunks, [key, "chunk"])
    first = F.greatest(F.lit(0), F.col(start) - F.col("chunk") * size).cast("int")
    last = F.least(F.lit(size), F.col(end) - F.col("chunk") * size).cast("int")
    cut = got.withColumn("_cut", F.substring("part", first + 1, last - first))
    return cut.groupBy(feature).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "_cut"))), lambda x: x["_cut"]), "").alias("slice"))


def taxonomy_nodes(lines: DataFrame) -> DataFrame:
    """``taxid, parent, rank, code, mitochondrial_code`` of a nodes dump in ``value``; malformed lines go."""
    p = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    rows = lines.select(F.get(p, 0).try_cast("bigint").alias("taxid"), F.get(p, 1).try_cast("bigint").alias("parent"), F.get(p, 2).alias("rank"), F.get(p, 6).try_cast("int").alias("code"), F.get(p, 8).try_cast("int").alias("mitochondrial_code"))
    return rows.where("taxid is not null and parent is not null")


def genetic_codes(text: str) -> dict[int, dict]:
    """Codes of a genetic-code file: id -> {letters, starts}; the driver reads a file of a few kilobytes."""
    out = {}
    for block in re.findall(r"\{(?:[^{}]*)\}", text):
        number, letters, starts = (re.search(p, block) for p in (r"\bid\s+(\d+)", r'ncbieaa\s+"([^"]+)"', r'sncbieaa\s+"([^"]+)"'))
        if number and letters:
            bases = "TCAG"
            codon = [a + b + c for a in bases for b in bases for c in bases]
            out[int(number[1])] = {"letters": letters[1], "starts": tuple(x for x, s in zip(codon, starts[1]) if s == "M") if starts else ()}
    return out


def nested_records(df: DataFrame, column: str, schema: str, at: str) -> DataFrame:
    """Elements of the array ``at`` of JSON documents in ``column``, one a row; documents that do not parse give none."""
    return df.withColumn("_j", F.from_json(column, schema)).withColumn("_x", F.explode(F.col(f"_j.{at}"))).drop("_j").select("*", "_x.*").drop("_x")


def field(column: str, path: str, default: str | None = None) -> Column:
    """A JSON field as a string, or a default."""
    got = F.get_json_object(column, path)
    return got if default is None else F.coalesce(got, F.lit(default))


def grammar(column: Column | str, pattern: str) -> dict[str, Column]:
    """The named groups (?<name>...) of a Java pattern as columns; empty groups are null."""
    col = F.col(column) if isinstance(column, str) else column
    names = re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)
    opened = [m for m in re.finditer(r"(?<!\\)\((?!\?(?!<[A-Za-z]))", pattern)]
    places = {re.match(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern[m.start() :])[1]: k + 1 for k, m in enumerate(opened) if pattern[m.start() :].startswith("(?<")}
    return {n: F.nullif(F.regexp_extract(col, pattern, places[n]), F.lit("")) for n in names}


def alternatives(words: list[str]) -> str:
    """A pattern of the words, the longest first, blanks as underscores."""
    return "|".join(re.escape(w.replace(" ", "_")) for w in sorted(words, key=lambda w: (-len(w), w)))


def missing_as(column: Column, words: tuple[str, ...] = ("none",), value: str = "N/A") -> Column:
    """``value`` for null and for ``words`` in any case."""
    return F.when(column.isNull() | F.lower(column).isin(*words), value).otherwise(column)


def valid_accession(column: str) -> Column:
    return F.col(column).rlike(ACCESSION)


def first_id(column: str) -> Column:
    """What stands before the first pipe."""
    return F.split_part(F.col(column), F.lit("|"), F.lit(1))


def second_id(column: str) -> Column:
    """The second part between underscores where there is one, else the whole."""
    return F.when(F.col(column).contains("_"), F.split_part(F.col(column), F.lit("_"), F.lit(2))).otherwise(F.col(column))


def captions(comments: str, references: str, tags: tuple[str, ...] = ("FUNCTION", "SIMILARITY", "INTERPRO")) -> Column:
    """``TAG: value, value TAG: ...``: the first text of each comment and the first property of each reference whose tag is wanted, in order of first appearance; empty without comments."""
    found = F.concat(
        F.transform(F.coalesce(F.col(comments), F.array()), lambda x: F.struct(F.upper(x["tag"]).alias("tag"), F.get(x["texts"], 0).alias("value"))),
        F.transform(F.coalesce(F.col(references), F.array()), lambda x: F.struct(F.upper(x["tag"]).alias("tag"), F.get(x["texts"], 0).alias("value"))),
    )
    kept = F.filter(found, lambda x: x["tag"].isin(*tags) & x["value"].isNotNull())
    order = F.array_distinct(F.transform(kept, lambda x: x["tag"]))
    text = F.array_join(F.transform(order, lambda t: F.concat(t, F.lit(": "), F.array_join(F.transform(F.filter(kept, lambda x: x["tag"] == t), lambda x: x["value"]), ", "))), " ")
    return F.when(F.col(comments).isNull() | (F.size(comments) == 0), "").otherwise(F.trim(text))


def fasta_of_ids(records: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The records (``header, sequence``) whose header's first field, up to a pipe or white space, is an id of ``ids``."""
    return records.withColumn("_id", F.regexp_extract("header", r"^[^|\s]*", 0)).join(ids.select(F.col(id_col).cast("string").alias("_id")), "_id", "left_semi").drop("_id")


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """The texts of JSON lines, compressed or not; other fields are not read, and lines without a text go."""
    return spark.read.schema(f"`{text}` string").json(path).where(F.col(text).isNotNull())


def write_by(df: DataFrame, path: str, by: list[str], fmt: str = "csv") -> None:
    """A folder for each value of ``by``."""
    df.write.partitionBy(*by).option("header", True).format(fmt).save(path)
