"""Column functions on DNA words and sequences.

Words are upper-case strings over A, C, G, T. For words of one length, string
order is the order of their two-bit codes (A=0, C=1, G=2, T=3), so ranges and
minima need no numeric form.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
MAX_K = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters and the space, each standing for one base; everything else breaks a sequence.
TEXT_FROM = LETTERS + LETTERS.lower() + " "
TEXT_TO = "".join(BASES[i % 4] for i in range(26)) * 2 + "A"


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}, not {k}")
    return k


def text_to_bases(text: Column) -> Column:
    """Any text as a sequence: letters by their place in the alphabet modulo four, the space as A."""
    return F.translate(text, TEXT_FROM, TEXT_TO)


def ascii_upper(seq: Column) -> Column:
    """Upper case for ASCII letters only, so no other alphabet is folded into bases."""
    return F.translate(seq, LETTERS.lower(), LETTERS)


def complement(word: Column) -> Column:
    return F.translate(word, "ACGT", "TGCA")


def reverse_complement(word: Column) -> Column:
    """Of a word over ACGT."""
    return F.reverse(complement(word))


def reverse_complement_any(seq: Column) -> Column:
    """Of any text: upper-cased, what is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(ascii_upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(word: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(word, reverse_complement(word))


def is_canonical(word: Column) -> Column:
    return word <= reverse_complement(word)


def orientations(word: Column) -> Column:
    return F.struct(word.alias("forward"), reverse_complement(word).alias("reverse"))


def _digits(word: Column) -> Column:
    return F.translate(word, "ACGT", "0123")


def packed(word: Column) -> Column:
    """The two-bit code as a long, for words of up to 31 bases; null for longer or invalid words."""
    ok = F.length(word).between(1, 31) & word.rlike("^[ACGT]+$")
    return F.when(ok, F.conv(_digits(word), 4, 10).cast("long"))


def packed_wide(word: Column) -> Column:
    """The code of a word of up to 64 bases as (hi, lo): 64 high and 64 low bits, each an unsigned decimal string."""
    n = F.length(word)
    ok = n.between(1, 64) & word.rlike("^[ACGT]+$")
    cut = F.greatest(n - 32, F.lit(0))
    hi = F.when(cut > 0, F.conv(_digits(F.substring(word, F.lit(1), cut)), 4, 10)).otherwise(F.lit("0"))
    lo = F.conv(_digits(F.substring(word, cut + 1, F.lit(32))), 4, 10)
    return F.when(ok, F.struct(hi.alias("hi"), lo.alias("lo")))


def packed_auto(word: Column) -> Column:
    """The code of a word of up to 64 bases in the narrower form that holds it: bits (64 or 128), hi, lo; null for invalid words."""
    wide = packed_wide(word)
    return F.when(wide.isNotNull(), F.struct(F.when(F.length(word) <= 32, 64).otherwise(128).alias("bits"), wide["hi"].alias("hi"), wide["lo"].alias("lo")))


def unpacked(code: Column, k: int) -> Column:
    """The word of k bases with that code; the empty string where k is out of range."""
    if not 1 <= k <= 31:
        return F.lit("")
    # Four bases at a time by place in the list of all words of four; the first part has what is left.
    sizes = [4] * (k // 4) if k % 4 == 0 else [k % 4, *[4] * (k // 4)]
    parts, left = [], k
    for n in sizes:
        left -= n
        words = F.lit(["".join(w) for w in product(BASES, repeat=n)])
        parts.append(F.get(words, F.shiftright(code, 2 * left).bitwiseAND(F.lit(4**n - 1).cast("long")).cast("int")))
    return F.concat(*parts)


def unpacked_wide(code: Column, k: int) -> Column:
    """The inverse of packed_wide."""
    check_k(k)
    low = F.translate(F.lpad(F.conv(code["lo"], 10, 4), min(k, 32), "0"), "0123", "ACGT")
    if k <= 32:
        return low
    return F.concat(F.translate(F.lpad(F.conv(code["hi"], 10, 4), k - 32, "0"), "0123", "ACGT"), low)


def hexadecimal(word: Column) -> Column:
    """The code in lower-case hexadecimal, as exports of binary tables show it."""
    wide = packed_wide(word)
    low = F.lower(F.conv(wide["lo"], 10, 16))
    return F.when(wide["hi"] == "0", low).otherwise(F.concat(F.lower(F.conv(wide["hi"], 10, 16)), F.lpad(low, 16, "0")))


def is_valid(seq: Column) -> Column:
    """Only bases, in either case; the empty sequence is valid."""
    return seq.rlike("^[ACGTacgt]*$")


def has_ambiguous(seq: Column) -> Column:
    return ~is_valid(seq)


def usable(seq: Column, k: int) -> Column:
    """Long enough for a word and without ambiguous bases."""
    return (F.length(seq) >= k) & is_valid(seq)


def sequence_quality(seq: Column) -> Column:
    """length, valid, invalid, n_count, percent_valid."""
    n = F.length(seq)
    valid = F.length(F.regexp_replace(seq, "[^ACGTacgt]", ""))
    unknown = F.length(F.regexp_replace(seq, "[^Nn]", ""))
    share = F.when(n > 0, 100.0 * valid / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("length"), valid.alias("valid"), (n - valid).alias("invalid"), unknown.alias("n_count"), share.alias("percent_valid"))


def runs(seq: Column) -> Column:
    """The maximal stretches of bases of a sequence (either case), upper-cased."""
    return F.split(ascii_upper(seq), "[^ACGT]+")


def extractable(seq: Column, k: int) -> Column:
    """Windows of k bases without an ambiguous one, counted from run lengths alone."""
    return F.aggregate(runs(seq), F.lit(0).cast("long"), lambda n, r: n + F.greatest(F.length(r) - (k - 1), F.lit(0)))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null where the lengths do."""
    at = F.sequence(F.lit(1), F.length(a))
    count = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)), 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(count))


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether two words of one length differ in `distance` places at most; unequal lengths never do."""
    return F.coalesce(hamming(a, b) <= distance, F.lit(False))


def polymers(seq: Column) -> Column:
    """Stretches of one base repeated."""
    return F.regexp_count(seq, F.lit("AA+|CC+|GG+|TT+"))


def shorten_gaps(seq: Column, most: int = 11) -> Column:
    """Stretches of N cut to `most` characters."""
    return F.regexp_replace(seq, f"N{{{most},}}", "N" * most)


def gaps(seq: Column) -> Column:
    """Stretches of N as an array of (first, last), from 0, both inclusive."""
    parts = F.regexp_extract_all(seq, F.lit("(N+|[^N]+)"), F.lit(1))
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(p.startswith("N"), F.concat(s["found"], F.array(F.struct(s["at"].alias("first"), (s["at"] + F.length(p) - 1).alias("last"))))).otherwise(s["found"]).alias("found"),
        ),
    )
    return walked["found"]


def mean_quality(qual: Column) -> tuple[Column, Column]:
    """(sum, number) of the raw ASCII qualities of a read, for averages over many."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda n, c: n + c), F.length(qual)


def quality_at_least(qual: Column, least: int) -> Column:
    """Whether every quality byte, as raw ASCII, reaches the least; true for none."""
    return F.coalesce(F.array_min(F.transform(F.split(qual, ""), lambda c: F.when(c == "", F.lit(255)).otherwise(F.ascii(c)))) >= least, F.lit(True))
