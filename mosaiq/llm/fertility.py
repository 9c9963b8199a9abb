"""Quality rules by tokeniser fertility, with the plain text rules beside them.

A public byte-level vocabulary gives a text's characters per token and the entropy of its tokens; a public
piece vocabulary with byte fallback gives the share of the text's bytes that it can spell as bytes only. Each
language (else the text's script, else a default) has a band for each measure; a text outside a band is rejected.
Bands hold for texts of ``least`` tokens or more, as few tokens tell nothing of entropy or fertility. They come from
the table itself: of a band's texts that pass the base rules, the quartiles of each measure (in steps of 0.001) less and
plus ``FENCE`` times their distance, never wider than the fixed ``BANDS``. Fixed bands alone hold for fewer than
``LEAST_TEXTS`` such texts and for a measure whose quartiles are equal.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have none, and like empty texts fail the rule on words. Null
languages and those without a band take the script's. Repeated rows are kept; an empty table gives no rows. Only the named
columns are read, whole texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.textutil import byte_bpe, default_vocabulary, documents, map_batches, shingles, small_batches, stored, word_hashes

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20  # words, words, percent of the words
FENCE, LEAST_TEXTS = 3, 50  # Tukey's outer fence
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    fallback: float  # the largest share of bytes
    entropy: tuple[float, float]  # of the largest that the number of tokens allows
    least: int = 32


BANDS = {
    "en": Band((1.5, 7.0), 0.05, (0.3, 1.0)),
    "fr": Band((1.3, 6.5), 0.05, (0.3, 1.0)),
    "de": Band((1.3, 6.5), 0.05, (0.3, 1.0)),
    "es": Band((1.3, 6.5), 0.05, (0.3, 1.0)),
    "latin": Band((1.2, 7.0), 0.1, (0.25, 1.0)),
    "greek": Band((0.3, 4.0), 0.6, (0.25, 1.0)),
    "cyrillic": Band((0.3, 4.0), 0.3, (0.25, 1.0)),
    "arabic": Band((0.3, 4.0), 0.6, (0.25, 1.0)),
    "devanagari": Band((0.2, 4.0), 0.8, (0.25, 1.0)),
    "han": Band((0.2, 3.0), 0.9, (0.25, 1.0)),
    "hangul": Band((0.2, 3.0), 0.95, (0.25, 1.0)),
    "other": Band((0.2, 7.0), 1.0, (0.25, 1.0)),
}


def known_characters(vocabulary: str) -> set[str]:
    """The characters that a piece vocabulary spells without bytes."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return {c for k in range(p.get_piece_size()) if not p.is_byte(k) and not p.is_control(k) and not p.is_unknown(k) for c in p.id_to_piece(k)} | set(" \t\n\v\f\r")


_KNOWN: dict[str, set[str]] = {}


def fertility(text: str, ids: np.ndarray, raw_size: int, known: set[str]) -> tuple[float, float, float]:
    """(characters per token, share of bytes spelled as bytes, entropy as a share of the largest possible); 0 for no tokens."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    p = counts / n
    entropy = float(-(p * np.log2(p)).sum()) / np.log2(n) if n > 1 else 1.0
    strange = sum(text.count(c) * len(c.encode("utf-8", "replace")) for c in set(text) - known)
    return len(text) / n, strange / max(1, raw_size), min(1.0, entropy)


#: Code points of the scripts' letters, by Unicode block.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "han": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FA1F)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


def script(text: str) -> str:
    """The script of half of the letters or more, kana with ``han``; ``latin`` without letters, ``other`` where none has half."""
    counts, letters = dict.fromkeys(SCRIPTS, 0), 0
    for c in set(text):
        if c.isalpha():
            n, at = text.count(c), ord(c)
            letters += n
            for name, blocks in SCRIPTS.items():
                if any(lo <= at <= hi for lo, hi in blocks):
                    counts[name] += n
    return next((name for name, n in counts.items() if 2 * n >= letters), "other")


def within(band: Band, n: int, measured: tuple[float, float, float]) -> bool:
    if n < band.least:
        return True
    chars, fallback, entropy = measured
    return band.chars_per_token[0] <= chars <= band.chars_per_token[1] and fallback <= band.fallback and band.entropy[0] <= entropy <= band.entropy[1]


def quartiles(counts: list[tuple[float, int]]) -> tuple[float, float]:
    """The smallest values with a quarter and with three quarters of the counts up to them."""
    total, seen, out = sum(n for _, n in counts), 0, []
    for value, n in sorted(counts):
        seen += n
        while len(out) < 2 and 4 * seen >= (1, 3)[len(out)] * total:
            out.append(value)
    return out[0], out[1]


def derived_bands(measured: DataFrame, bands: dict[str, Band]) -> dict[str, Band]:
    """``bands`` narrowed to the fences of the measured texts; the driver gets a row for each step of a measure."""
    held = F.create_map(*[F.lit(x) for name, b in bands.items() for x in (name, b.least)])
    used = measured.where(~F.col("base_failed")).where(F.col("n_tokens") >= F.try_element_at(held, F.col("band")))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(m) * 1000).cast("int").alias("step")) for k, m in enumerate(MEASURES)]))
    found: dict[tuple[str, int], list[tuple[float, int]]] = {}
    for r in used.select("band", steps.alias("x")).groupBy("band", "x.k", "x.step").count().collect():
        found.setdefault((r["band"], r["k"]), []).append((r["step"] / 1000, r["count"]))
    out = dict(bands)
    for (name, k), counts in found.items():
        low, high = quartiles(counts)
        if low == high or sum(n for _, n in counts) < LEAST_TEXTS:
            continue
        low, high, b = low - FENCE * (high - low), high + FENCE * (high - low), out[name]
        if k == 1:
            out[name] = replace(b, fallback=min(b.fallback, high))
        else:
            field = ("chars_per_token", "", "entropy")[k]
            fixed = getattr(b, field)
            out[name] = replace(b, **{field: (max(fixed[0], low), min(fixed[1], high))})
    return out


def inside(bands: dict[str, Band]) -> Column:
    """``within`` over the measured columns."""
    ok = F.lit(False)
    for name, b in bands.items():
        fits = F.col("chars_per_token").between(*b.chars_per_token) & (F.col("fallback_share") <= b.fallback) & F.col("token_entropy").between(*b.entropy)
        ok = F.when(F.col("band") == name, (F.col("n_tokens") < b.least) | fits).otherwise(ok)
    return ok


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows that are found twice or more."""
    n = len(hashes)
    if n <= WINDOW:
        return 0
    w = shingles(hashes, WINDOW)
    ordered = np.sort(w)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found, inside = np.isin(w, twice), np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : k + len(w)] |= found
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def quality_rules(df: DataFrame, vocabulary: str, pieces: str, bands: dict[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, base verdict, fertility measures, band and verdict of every row; given ``bands`` hold as they are, else they are derived from the table."""
    given, bands = bands, bands or BANDS
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "band"]
    types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(vocabulary)
        if pieces not in _KNOWN:
            _KNOWN[pieces] = known_characters(pieces)
        known, rows = _KNOWN[pieces], []
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = text or ""
            raw = text.encode()
            hashes = word_hashes(raw)
            n, ids = len(hashes), np.frombuffer(bpe.ids(text), "<u4")
            repeat = repeated_words(hashes)
            failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n
            measured = fertility(text, ids, len(raw), known)
            name = lang if lang in bands else script(text)
            rows.append((n, len(text) - sum(text.count(c) for c in " \t\n\v\f\r"), sum(text.count(c) for c in SYMBOLS), duplicate_lines(raw), repeat, failed, len(ids), *measured, name))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    measured = map_batches(source, measure, f"id {source.schema['id'].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, band string")
    if given is None:
        measured = stored(measured, "fertility")
        bands = derived_bands(measured, bands)
    kept = (~F.col("base_failed") & inside(bands)).alias("kept")
    return measured.select(*names[:7], kept, *names[7:])


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")
