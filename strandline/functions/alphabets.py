"""Alphabets, complements, ranks and q-grams as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol sets and complements of the nucleotide and amino acid codes (IUPAC).
DNA = "ACGTacgt"
DNA_N = "ACGTNacgtn"
DNA_IUPAC = "ACGTRYSWKMBDHVNZacgtryswkmbdhvnz"
RNA = "ACGUacgu"
RNA_N = "ACGUNacgun"
RNA_IUPAC = "ACGURYSWKMBDHVNZacguryswkmbdhvnz"
PROTEIN = "ARNDCEQGHILKMFPSTWYVarndceqghilkmfpstwyv"
PROTEIN_IUPAC = "ABCDEFGHIKLMNPQRSTVWXYZabcdefghiklmnpqrstvwxyz"
ENGLISH_LOWER = "abcdefghijklmnopqrstuvwxyz"
ENGLISH_UPPER = ENGLISH_LOWER.upper()
_DNA_PAIRS = ("AGCTYRWSKMDVHBN", "TCGARYWSMKHBDVN")
_RNA_PAIRS = ("AGCUYRWSKMDVHBNZ", "UCGARYWSMKHBDVNZ")


class Alphabet:
    """A set of symbols, ranked in ascending code order."""

    def __init__(self, symbols: str = ""):
        self.symbols = "".join(sorted(set(symbols)))

    def __len__(self) -> int:
        return len(self.symbols)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Alphabet) and self.symbols == other.symbols

    def __hash__(self) -> int:
        return hash(self.symbols)

    def is_empty(self) -> bool:
        return not self.symbols

    def insert(self, symbol: str) -> Alphabet:
        return Alphabet(self.symbols + symbol)

    def max_symbol(self) -> str | None:
        return self.symbols[-1] if self.symbols else None

    def intersection(self, other: Alphabet) -> Alphabet:
        return Alphabet("".join(set(self.symbols) & set(other.symbols)))

    def difference(self, other: Alphabet) -> Alphabet:
        return Alphabet("".join(set(self.symbols) - set(other.symbols)))

    def union(self, other: Alphabet) -> Alphabet:
        return Alphabet(self.symbols + other.symbols)

    def rank_width(self) -> int:
        """Bits that hold a rank."""
        return math.ceil(math.log2(len(self))) if len(self) > 1 else 0

    def rank(self, symbol: str) -> int:
        i = self.symbols.find(symbol)
        if i < 0:
            raise ValueError(f"symbol {symbol!r} is not in the alphabet")
        return i


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column | str, f) -> Column:
    """f of c, with c evaluated once: Catalyst inlines a projected expression into lambda bodies, once for each element."""
    return F.element_at(F.transform(F.array(_col(c)), f), 1)


def is_word(c: Column | str, symbols: str) -> Column:
    """Every symbol is in the alphabet; true for an empty text, null for null."""
    return F.translate(_col(c), symbols, "") == ""


def symbols_of(c: Column | str) -> Column:
    """The distinct symbols of a text in ascending order, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(_col(c), ""), lambda x: x != ""))), "")


def _complement(c: Column | str, pairs: tuple[str, str]) -> Column:
    a, b = pairs
    return F.translate(_col(c), a + a.lower(), b + b.lower())


def dna_complement(c: Column | str) -> Column:
    return _complement(c, _DNA_PAIRS)


def rna_complement(c: Column | str) -> Column:
    return _complement(c, _RNA_PAIRS)


def dna_revcomp(c: Column | str) -> Column:
    return F.reverse(dna_complement(c))


def rna_revcomp(c: Column | str) -> Column:
    return F.reverse(rna_complement(c))


def ranks(c: Column | str, alphabet: Alphabet) -> Column:
    """Array of ranks; a symbol outside the alphabet is an error."""
    return F.transform(chars(c), lambda x: _rank(x, alphabet))


def _rank(x: Column, alphabet: Alphabet) -> Column:
    at = F.position(x, F.lit(alphabet.symbols))
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("symbol outside the alphabet: "), x)).cast("int"))


def chars(c: Column | str) -> Column:
    """Array of single symbols; empty for an empty text."""
    c = _col(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def from_ranks(c: Column | str, alphabet: Alphabet) -> Column:
    return F.array_join(F.transform(_col(c), lambda r: F.substring(F.lit(alphabet.symbols), r + 1, F.lit(1))), "")


def qgrams(c: Column | str, q: int, alphabet: Alphabet) -> Column:
    """Codes of the q-grams from left to right: each is the last one shifted by a rank, within q ranks."""
    bits = alphabet.rank_width()
    if q < 1 or bits * q > 64:
        raise ValueError("q must be positive and q ranks must fit 64 bits")

    def codes(c: Column) -> Column:
        foreign = F.translate(c, alphabet.symbols, "")
        if 1 <= bits <= 5:  # ranks as digits of a base that is a power of two
            digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[: len(alphabet)]
            code = lambda g: F.conv(F.translate(g, alphabet.symbols, digits), 1 << bits, -10).cast("bigint")
        else:
            code = lambda g: F.aggregate(ranks(g, alphabet), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, bits).bitwiseOR(x.cast("bigint")))
        bad = F.raise_error(F.concat(F.lit("symbols outside the alphabet: "), foreign)).cast("array<bigint>")
        return F.when(foreign != "", bad).otherwise(F.transform(kmers(c, q), code))

    return bind(c, codes)


def rev_qgrams(c: Column | str, q: int, alphabet: Alphabet) -> Column:
    """The same codes from right to left."""
    return F.reverse(qgrams(c, q, alphabet))


def chunks(c: Column | str, size: int, overlap: int) -> Column:
    """Array of the pieces of ``size`` symbols, each with up to ``overlap`` symbols of what follows; empty for an empty text."""
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))


def kmers(c: Column | str, k: int) -> Column:
    """Array of the k-mers as text; empty where the text is shorter.

    One look-ahead pattern walks the text once; a substring for each place would count characters from its start anew.
    """
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def pack_bits(c: Column | str, width: int) -> Column:
    """Array of values of 1 to 8 bits packed into 32-bit blocks, the first value in the lowest bits."""
    if not 1 <= width <= 8:
        raise ValueError("width must be 1 to 8")
    c, per = _col(c), 32 // width
    block = lambda b: F.aggregate(F.slice(c, b * per + 1, F.lit(per)), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("s")), lambda a, x: F.struct((a["v"] + x.cast("bigint") * F.pow(F.lit(2), a["s"]).cast("bigint")).alias("v"), (a["s"] + width).alias("s")), lambda a: a["v"])
    blocks = F.ceil(F.size(c) / per).cast("int")
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), blocks - 1), block)).otherwise(F.array().cast("array<bigint>"))


def unpack_bits(c: Column | str, width: int, n: Column) -> Column:
    """The first n values of packed blocks."""
    per = 32 // width
    value = lambda i: F.pmod(F.floor(F.element_at(_col(c), (F.floor(i / per) + 1).cast("int")) / F.pow(F.lit(2), F.pmod(i, F.lit(per)) * width)), F.lit(1 << width)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<int>"))
