"""Quality classifier by a sparse rule ensemble over text statistics.

Shallow trees are boosted on the labelled rows; each path from a root to a node is a conjunctive rule, and a
lasso-penalised logistic fit leaves few of them with a weight. The model is compiled into one Spark column
expression over the statistics, so scoring needs neither the trees nor Python.

Statistics come from the text alone. The fit uses at most ``MAX_ROWS`` labelled rows, the first by a hash of
the id, and one row for each id (a documented bound: the driver holds that many rows of statistics); everything else runs over all rows.
Without rows of both labels the score is the smoothed share of label 1.

A null text is an empty one, and gets a score as every text does. A null label is no label. Repeated rows are
scored each; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.textutil import documents, map_batches, raw_texts, shingles, small_batches, word_hashes

MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 5
PENALTIES = (0.03, 0.01, 0.003, 0.001)
STATISTICS = [
    "log_chars", "log_words", "word_length", "upper", "digit", "mark", "symbol", "exclaim", "bar", "non_ascii",
    "line_words", "distinct_words", "repeated_windows", "duplicate_lines", "upper_words", "marked_words", "digit_words", "top_word", "sentence_words", "character_entropy",
]

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&<>@^~=+_\\{}[]"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _of(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_statistics(raw: bytes) -> tuple[float, ...]:
    """``STATISTICS`` of a text's UTF-8 bytes; all finite, 0 for an empty text."""
    size = len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return (float(np.log1p(size)),) + (0.0,) * (len(STATISTICS) - 1)
    hashes = word_hashes(raw)
    counts = np.unique(hashes, return_counts=True)[1]
    windows = shingles(hashes, 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper_words = sum(map(bytes.isupper, words))
    marked = len([1 for w in words if w[-1:] in _SYMBOL])
    sentences = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = share[share > 0] / size
    return (
        float(np.log1p(size)), float(np.log1p(n)), sum(map(len, words)) / n, _of(raw, _UPPER) / size, _of(raw, _DIGIT) / size,
        _of(raw, _MARK) / size, _of(raw, _SYMBOL) / size, raw.count(b"!") / n, raw.count(b"|") / n, (size - len(raw.translate(None, bytes(range(128, 256))))) / size,
        n / max(1, len(lines)), len(counts) / n, 1 - len(np.unique(windows)) / len(windows), 1 - len(set(lines)) / max(1, len(lines)), upper_words / n,
        marked / n, _digit_words(words) / n, float(counts.max()) / n, n / (1 + sentences), float(-(share * np.log2(share)).sum()),
    )


def _digit_words(words: list[bytes]) -> int:
    return sum(w[0] < 58 and w.isdigit() for w in words)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and one double column ``_<name>`` for each of ``STATISTICS``."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    names = [f"_{x}" for x in STATISTICS]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_statistics(x) for x in raw_texts(batch.column(at).cast(pa.string()))], np.float64).reshape(-1, len(STATISTICS))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, k].copy()) for k in range(len(STATISTICS)))], [*batch.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names)])
    return map_batches(df, measure, schema)


Condition = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [f"_{x}" for x in STATISTICS])

    def score(self) -> Column:
        """The chance of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, above, at in conditions:
                holds = holds & ((F.col(self.names[k]) > at) if above else (F.col(self.names[k]) <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            total += weight * holds(conditions, x)
        return 1 / (1 + np.exp(-total))


def holds(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in conditions:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple[Condition, ...]]:
    """Paths of boosted regression trees on quantile bins, in the order found, without repeats."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]  # bin b: at most edge b
    margin, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def split(rows: np.ndarray, path: tuple[Condition, ...], residual: np.ndarray, step: np.ndarray) -> None:
        best = (1e-9, -1, 0)
        if len(path) < depth and len(rows) >= 2 * LEAST_LEAF:
            r, total = residual[rows], residual[rows].sum()
            for k, b in enumerate(binned):
                if not len(edges[k]):
                    continue
                n = np.cumsum(np.bincount(b[rows], minlength=len(edges[k]) + 1))[:-1]
                s = np.cumsum(np.bincount(b[rows], weights=r, minlength=len(edges[k]) + 1))[:-1]
                m = len(rows) - n
                gain = np.where((n >= LEAST_LEAF) & (m >= LEAST_LEAF), s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -1.0) - total**2 / len(rows)
                if len(gain) and gain.max() > best[0] + 1e-12:
                    best = (float(gain.max()), k, int(gain.argmax()))
        if best[1] < 0:
            p = 1 / (1 + np.exp(-margin[rows]))
            step[rows] = residual[rows].sum() / max(1e-6, float((p * (1 - p)).sum()))
            return
        _, k, cut = best
        left = binned[k][rows] <= cut
        for part, above in ((rows[left], False), (rows[~left], True)):
            inner = (*path, (k, above, float(edges[k][cut])))
            found.setdefault(inner, None)
            split(part, inner, residual, step)

    for _ in range(trees):
        residual, step = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        split(np.arange(len(y)), (), residual, step)
        margin = margin + RATE * np.clip(step, -4, 4)
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal steps; the intercept is free."""
    n, m = r.shape
    a = np.column_stack([np.ones(n), r])
    rate = 4 * n / max(1e-9, float(np.linalg.norm(a, 2) ** 2))
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = z[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from trees, weights by lasso; the penalty with the least loss on every fourth row, fitted without them."""
    n, ones = len(y), float(y.sum()) if len(y) else 0.0
    base = np.log((ones + 1) / (n - ones + 1))
    if n < 4 * LEAST_LEAF or not 0 < ones < n:
        return RuleModel(float(base))
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(float(base))
    r = np.column_stack([holds(c, x) for c in rules]).astype(np.float64)
    test = np.arange(n) % 4 == 0
    best = None
    if 0 < y[~test].sum() < (~test).sum():
        for penalty in PENALTIES:
            b, w = lasso(r[~test], y[~test], penalty)
            p = np.clip(1 / (1 + np.exp(-(b + r[test] @ w))), 1e-6, 1 - 1e-6)
            loss = float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
            if best is None or loss < best[0] - 1e-9:
                best = (loss, penalty)
    b, w = lasso(r, y, best[1] if best else PENALTIES[1])
    return RuleModel(b, [(c, float(v)) for c, v in zip(rules, w) if abs(v) > 1e-6])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", max_rows: int = MAX_ROWS) -> RuleModel:
    """A model from the labelled rows that are not held out, at most ``max_rows`` labels by a hash of the id."""
    marks = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("_label")).where("id is not null and _label is not null").where(~held_out("id"))
    marks = marks.groupBy("id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id")  # max_rows ids at most
    names = [f"_{x}" for x in STATISTICS]
    # one row for each id, of repeated ids that of the smallest statistics: max_rows rows on the driver at most
    rows = with_statistics(found, "text").select("id", "_label", F.struct(*names).alias("s")).groupBy("id").agg(F.min("s").alias("s"), F.first("_label").alias("_label")).select("id", "_label", "s.*").toPandas()
    rows = rows.sort_values(["id", *names], kind="stable")
    return fit(rows[names].to_numpy(np.float64), (rows["_label"].to_numpy(np.float64) > 0.5).astype(np.float64))


def scored(df: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``row`` (the whole row of ``df``, whatever its columns are named) and ``score``, the chance of label 1."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return with_statistics(rows, "text").select("row", model.score().alias("score"))


def accepted(df: DataFrame, model: RuleModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score ``least`` or more."""
    return scored(df, model, text_col).where(F.col("score") >= least).select("row.*")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    score = scored(named, train(df, labels, id_col, text_col)).select(F.col("row.id").alias("id"), "score")
    return score.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
