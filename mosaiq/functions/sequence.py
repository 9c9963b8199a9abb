"""Nucleotide and protein sequences, and masks over their positions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, bases in the order TCAG.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("TTG", "CTG", "ATG")
STOPS = ("TAA", "TAG", "TGA")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def codon_table(letters: str = STANDARD) -> dict[str, str]:
    """codon -> amino acid of a code given as 64 letters in TCAG order."""
    if len(letters) != 64:
        raise ValueError("a genetic code has 64 letters")
    return {a + b + d: letters[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, d in enumerate(BASES)}


def reverse_complement(s: Column | str) -> Column:
    """Case is kept; letters other than A, C, G, T stay."""
    return F.reverse(F.translate(c(s), "ACGTacgt", "TGCAtgca"))


def to_rna(s: Column | str) -> Column:
    return F.translate(F.upper(c(s)), "T", "U")


def codons(s: Column | str) -> Column:
    """Pieces of three letters; the last may be shorter."""
    return F.regexp_extract_all(c(s), F.lit("(?s).{1,3}"), F.lit(0))


def translated(s: Column | str, letters: str = STANDARD, starts: tuple[str, ...] = STARTS) -> Column:
    """Amino acids of whole codons: a first codon that may start is M, unknown codons are ``-``, a short tail is left out."""
    table = F.create_map(*[F.lit(x) for kv in codon_table(letters).items() for x in kv])
    whole = F.filter(codons(s), lambda x: F.length(x) == 3)
    one = lambda x, i: F.when((i == 0) & x.isin(*starts), "M").otherwise(F.coalesce(F.try_element_at(table, x), F.lit("-")))
    return F.array_join(F.transform(whole, one), "")


def n_count(s: Column | str) -> Column:
    return F.length(c(s)) - F.length(F.translate(c(s), "Nn", ""))


def enough_known(s: Column | str, most: int = 800, share: float = 0.4) -> Column:
    """At most ``most`` unknown letters and at most that share of the length."""
    return (n_count(s) <= most) & (n_count(s) <= share * F.length(c(s)))


def letters(s: Column | str) -> Column:
    return F.split(c(s), "")


def masked_letters(s: Column | str, mask: Column | str) -> Column:
    """The letters where the mask (a string of 0 and 1) is 1."""
    return F.array_join(F.transform(F.filter(F.arrays_zip(letters(s).alias("a"), letters(mask).alias("m")), lambda x: x["m"] == "1"), lambda x: x["a"]), "")


def mask_or(a: Column | str, b: Column | str) -> Column:
    """Positions that are 1 in either mask; the shorter one counts as 0 past its end."""
    return F.array_join(F.zip_with(letters(a), letters(b), lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0")), "")


def either_track(a: Column | str, b: Column | str) -> Column:
    """The two masks' union; where one is null the other."""
    return F.coalesce(mask_or(a, b), c(a), c(b))


def paint(coords: Column | str, start: Column | str, length: Column | str, minus: Column | None = None) -> Column:
    """A mask of ``length`` positions from ``start`` (0-based) that is 1 inside ``coords`` (structs of 1-based inclusive start, end); turned round where ``minus``."""
    at = F.transform(c(coords), lambda x: F.struct((x["start"] - 1 - c(start)).alias("s"), (x["end"] - c(start)).alias("e"), (x["start"] > x["end"]).alias("bad")))
    one = lambda p: F.when(F.exists(at, lambda x: ~x["bad"] & (x["s"] <= p) & (p < x["e"])), "1").otherwise("0")
    bits = F.when(c(length) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), c(length).cast("bigint") - 1), one)).otherwise(F.array().cast("array<string>"))
    return F.array_join(bits if minus is None else F.when(minus, F.reverse(bits)).otherwise(bits), "")


def junctions(mask: Column | str) -> Column:
    """Marks beside regions of 1: 1 before a region, 2 after one, 3 before the first that has a place before it, 4 after the last that has one after it; a mark after wins over one before, 3 over both, 4 over all.

    Each step marks places in the string itself, so the work grows with its length only.
    """
    x = F.regexp_replace(c(mask), "(?<=1)0", "d")
    x = F.regexp_replace(x, "0(?=1)", "a")
    x = F.regexp_replace(x, "^(.*)d", "$1e")
    x = F.regexp_replace(x, "^((?:(?!a|[de](?=1)).)*+)(?:a|d(?=1))", "$1s")
    return F.translate(x, "1adse", "01234")


def clean_feature_type(feature: str, root_type: str, biotype: str, gbkey: str, organism: str, annotated: tuple[str, ...] = ("Homo sapiens", "Mus musculus")) -> Column:
    """One of few feature types. Two trees of rules: one for organisms whose transcript types are curated, one for all others."""
    f, b = F.col(feature), F.col(biotype)
    low, blow, glow = F.lower(f), F.lower(b), F.lower(F.col(gbkey))
    curated = [
        (low.contains("pseudo"), F.lit("pseudogene")),
        (F.col(root_type).contains("protein_coding"), f),
        (f.contains("gene"), F.lit("gene")),
        (low.contains("lnc") & low.contains("rna"), F.lit("lncRNA")),
        (f.contains("rRNA"), F.lit("rRNA")),
        (f.contains("tRNA"), F.lit("tRNA")),
        (low.contains("rna"), F.lit("miscRNA")),
        (f.contains("TEC"), F.lit("TEC")),
    ]
    same = {"tRNA": "tRNA", "rRNA": "rRNA", "lncRNA": "lnc_RNA"}
    others = [
        (b.isNull() & low.contains("rna") & low.contains("lnc"), F.lit("lncRNA")),
        (b.isNull() & low.contains("rna"), f),
        (b.isNull(), F.lit("trans_splicing_suspected")),
        (b == "protein_coding", F.when(f.isin("gene", "mRNA"), "protein_coding")),
        (blow.contains("pseudo"), F.lit("pseudogene")),
        *[(b == k, F.when(f == v, k).otherwise("miscRNA")) for k, v in same.items()],
        ((b == "transcript") & (F.col(gbkey) == "miscRNA"), F.lit("miscRNA")),
        (blow.contains("rna"), F.lit("miscRNA")),
        (b.contains("V_segment") | b.contains("C_region"), F.lit("protein_coding")),
        (glow.contains("rna"), F.lit("miscRNA")),
        (b == "segment", F.lit("trans_splicing_suspected")),
    ]

    def tree(rules: list[tuple[Column, Column]]) -> Column:
        return reduce(lambda w, r: w.when(*r), rules[1:], F.when(*rules[0])).otherwise("other")

    return F.when(F.col(organism).isin(*annotated), tree(curated)).otherwise(tree(others))


def coordinate_window(start: str, end: str, padding: int = 0, flank_start: str | None = None, flank_end: str | None = None) -> tuple[Column, Column]:
    """(0-based start, end) of a feature with flanks where they are there, else with padding; the start is 0 at least."""
    s = F.greatest(F.lit(0), F.col(start) - padding - 1)
    e = F.col(end) + padding
    if flank_start:
        s, e = F.coalesce(F.greatest(F.lit(0), F.col(flank_start) - 1), s), F.coalesce(F.col(flank_end), e)
    return s, e


def not_short(s: Column | str, start: str, end: str) -> Column:
    """The sequence, or null if it is shorter than its feature's span."""
    return F.when(F.length(c(s)) >= F.col(end) - F.col(start), c(s))


def combined_masks(a: str, b: str) -> Column:
    """Both masks' union; null if either is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), mask_or(a, b))


def codon_modality(s: str, mask: str, is_coding: str, feature_type: str) -> Column:
    """Codons of the masked letters of coding, protein-coding rows whose number of letters is a multiple of three; else null."""
    inside = masked_letters(s, mask)
    return F.when(F.col(is_coding) & (F.col(feature_type) == "protein_coding") & (F.length(inside) % 3 == 0), codons(inside))


def is_coding(feature_type: str, cds: str) -> Column:
    """False for pseudogenes, else whether there are coding coordinates."""
    return F.when(F.lower(F.col(feature_type)).contains("pseudo"), False).otherwise(F.col(cds).isNotNull() & (F.size(cds) > 0))


#: How public protein entries write evidence tags and literature ids.
EVIDENCE, LITERATURE = r"\{ECO:.*?\}\.", r"\(PubMed:\d+\)|PubMed:\d+\)|\(PubMed:\d+"


def caption_clean(s: Column | str) -> Column:
    """Evidence tags and literature ids go, then blanks before stops and commas, then blanks at the ends."""
    t = F.regexp_replace(c(s), EVIDENCE, "")
    t = F.regexp_replace(t, LITERATURE, "")
    return F.trim(F.regexp_replace(t, r"\s+([.,])", "$1"))


def stable_hash15(s: Column | str) -> Column:
    """sha256 modulo 2**15."""
    return (F.conv(F.right(F.sha2(c(s), 256), F.lit(4)), 16, 10).cast("int") % 32768).cast("int")


# filters on sequences, to be joined with &
def min_length(s: str, n: int) -> Column:
    return F.length(s) >= n


def max_length(s: str, n: int) -> Column:
    return F.length(s) <= n


def whole_codons(s: str) -> Column:
    return F.length(s) % 3 == 0


def starts_with_codon(s: str, starts: tuple[str, ...] = ("ATG", "GTG", "TTG")) -> Column:
    return F.substring(s, 1, 3).isin(*starts)


def ends_with_codon(s: str, stops: tuple[str, ...] = STOPS) -> Column:
    return F.right(F.col(s), F.lit(3)).isin(*stops)


def mean_at_least(values: str, least: float) -> Column:
    """The mean of an array (as confidences of atoms); null for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0)) >= least
