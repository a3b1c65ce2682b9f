"""Alphabets: symbols, codes, and residue-level Column functions.

A sequence is a string of an alphabet's symbols. Its code array has, per symbol, the place in
``symbols``: canonical residues first, then the gap, degenerate residues, the unknown residue, ``*``
and ``~``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Alphabet:
    name: str
    symbols: str
    k: int
    synonyms: tuple[str, str]
    degenerate: dict[str, str]
    complements: tuple[str, str] | None = None

    @property
    def kp(self) -> int:
        return len(self.symbols)

    @property
    def gap(self) -> str:
        return self.symbols[self.k]

    @property
    def unknown(self) -> str:
        return self.symbols[self.kp - 3]

    @cached_property
    def residues(self) -> str:
        return self.symbols[: self.k] + self.symbols[self.k + 1 : self.kp - 2]

    @cached_property
    def members(self) -> list[str]:
        """Canonical residues that each symbol may stand for."""
        canonical = self.symbols[: self.k]
        return [c if c in canonical else self.degenerate.get(c, "") for c in self.symbols]

    # Text

    def canonical(self, seq: Column | str) -> Column:
        """Upper case, synonyms replaced: each symbol then is the alphabet's own."""
        return F.translate(F.upper(col(seq)), *self.synonyms)

    def valid(self, seq: Column | str) -> Column:
        return F.length(F.translate(self.canonical(seq), self.symbols, "")) == 0

    def require(self, seq: Column | str) -> Column:
        """The canonical text; an error for a symbol outside the alphabet."""
        text = self.canonical(seq)
        return F.when(self.valid(seq) | col(seq).isNull(), text).otherwise(F.raise_error(F.concat(F.lit(f"not {self.name}: "), col(seq))))

    def digitize(self, seq: Column | str) -> Column:
        """Codes of the symbols, as array<int>."""
        text = self.require(seq)
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return F.transform(chars, lambda c: F.instr(F.lit(self.symbols), c) - 1)

    def textize(self, codes: Column | str) -> Column:
        return F.array_join(F.transform(col(codes), lambda c: F.substring(F.lit(self.symbols), c + 1, F.lit(1))), "")

    def reverse_complement(self, seq: Column | str) -> Column:
        if self.complements is None:
            raise ValueError(f"{self.name} has no complement")
        return F.reverse(F.translate(col(seq), *self.complements))

    def dealign(self, seq: Column | str) -> Column:
        """Residues only: gaps, ``*`` and ``~`` go."""
        return F.translate(col(seq), self.gap + "*~", "")

    def residue_count(self, seq: Column | str) -> Column:
        return F.length(self.dealign(seq))

    def degenerate_to_unknown(self, seq: Column | str) -> Column:
        codes = self.symbols[self.k + 1 : self.kp - 3]
        return F.translate(col(seq), codes, self.unknown * len(codes))

    def count_symbols(self, seq: Column | str, symbols: str) -> Column:
        """How many characters of ``seq`` are among ``symbols``."""
        return F.length(col(seq)) - F.length(F.translate(col(seq), symbols, ""))

    # Codes

    def is_residue(self, code: Column | str) -> Column:
        c = col(code)
        return (c < self.k) | ((c > self.k) & (c <= self.kp - 3))

    def is_canonical(self, code: Column | str) -> Column:
        return col(code) < self.k

    def is_gap(self, code: Column | str) -> Column:
        return col(code) == self.k

    def is_degenerate(self, code: Column | str) -> Column:
        return (col(code) > self.k) & (col(code) < self.kp - 3)

    def is_unknown(self, code: Column | str) -> Column:
        return col(code) == self.kp - 3

    def is_nonresidue(self, code: Column | str) -> Column:
        return col(code) == self.kp - 2

    def is_missing(self, code: Column | str) -> Column:
        return col(code) == self.kp - 1

    def encode(self, symbol: Column | str) -> Column:
        """Code of one symbol, null outside the alphabet."""
        at = F.instr(F.lit(self.symbols), self.canonical(symbol))
        return F.when((at > 0) & (F.length(col(symbol)) == 1), at - 1)

    def decode(self, code: Column | str) -> Column:
        return F.substring(F.lit(self.symbols), col(code) + 1, F.lit(1))

    # Scores

    def shares(self) -> list[list[float]]:
        """Kp x K: the share of each canonical residue in a symbol; the unknown residue is all of them."""
        canonical = self.symbols[: self.k]
        return [[(1.0 / len(m) if c in m else 0.0) for c in canonical] for m in self.members]

    def count_vector(self, seq: Column | str) -> Column:
        """array<double> of K residue counts; a degenerate residue counts for its members in equal
        shares, gaps, ``*`` and ``~`` for none."""
        text = col(seq)
        out = []
        for r in self.symbols[: self.k]:
            total = F.lit(0.0)
            for n in sorted({len(m) for m in self.members if r in m}):
                own = "".join(s for s, m in zip(self.symbols, self.members) if r in m and len(m) == n)
                total = total + self.count_symbols(text, own) / float(n)
            out.append(total)
        return F.array(*out)

    def average_score(self, code: Column | str, scores: Column | str) -> Column:
        """Mean score over a code's members, 0 for gap, ``*`` and ``~``; ``scores``: K numbers."""
        return self._weighted(code, scores, None)

    def expected_score(self, code: Column | str, scores: Column | str, p: Column | str) -> Column:
        """Mean score over a code's members, weighted by their frequencies ``p``."""
        return self._weighted(code, scores, col(p))

    def _mean(self, c: int, scores: Column, p: Column | None) -> Column:
        """Of one symbol's members, weighted by ``p`` or equally; 0 without any."""
        own = [self.symbols.index(x) for x in self.members[c]]
        w = [F.lit(1.0) if p is None else F.element_at(p, i + 1) for i in own]
        s = [F.element_at(scores, i + 1) for i in own]
        return sum((a * b for a, b in zip(w[1:], s[1:])), w[0] * s[0]) / sum(w[1:], w[0]) if own else F.lit(0.0)

    def _weighted(self, code, scores, p):
        cases = None
        for c in range(self.kp):
            value = self._mean(c, col(scores), p)
            cases = F.when(col(code) == c, value) if cases is None else cases.when(col(code) == c, value)
        return cases

    def fill_scores(self, scores: Column | str, p: Column | str | None = None) -> Column:
        """The Kp-vector of K scores: each degenerate code has its members' mean."""
        return F.array(*(self._mean(c, col(scores), None if p is None else col(p)) for c in range(self.kp)))

    def match_table(self, p: list[float] | None = None) -> list[list[float]]:
        """Kp x Kp: the probability that two symbols stand for the same residue."""
        p = p or [1.0 / self.k] * self.k
        canonical = self.symbols[: self.k]
        f = dict(zip(canonical, p))
        mass = [sum(f[c] for c in m) for m in self.members]
        return [[sum(f[c] ** 2 for c in a if c in b) / (sa * sb) if a and b else 0.0 for b, sb in zip(self.members, mass)] for a, sa in zip(self.members, mass)]

    def match(self, x: Column | str, y: Column | str, p: list[float] | None = None) -> Column:
        rows = F.array(*(F.array(*map(F.lit, r)) for r in self.match_table(p)))
        return F.element_at(F.element_at(rows, col(x) + 1), col(y) + 1)


#: The nucleotide degeneracy codes and their complements, and the amino acid ones.
_NUCLEOTIDES = {"R": "AG", "Y": "C{T}", "M": "AC", "K": "G{T}", "S": "CG", "W": "A{T}", "H": "AC{T}", "B": "CG{T}", "V": "ACG", "D": "AG{T}", "N": "ACG{T}"}
_AMINO = {"B": "DN", "J": "IL", "Z": "EQ", "O": "K", "U": "C", "X": "ACDEFGHIKLMNPQRSTVWY"}


def _nucleic(name: str, t: str, other: str) -> Alphabet:
    degenerate = {c: m.replace("{T}", t) for c, m in _NUCLEOTIDES.items()}
    return Alphabet(name, f"ACG{t}-RYMKSWHBVDN*~", 4, (f"{other}XI_.", f"{t}NA--"), degenerate, (f"ACG{t}RYMKHDBV", f"{t}GCAYRKMDHVB"))


DNA = _nucleic("dna", "T", "U")
RNA = _nucleic("rna", "U", "T")
AMINO = Alphabet("amino", "ACDEFGHIKLMNPQRSTVWY-BJZOUX*~", 20, ("_.", "--"), _AMINO)
ALPHABETS = {a.name: a for a in (DNA, RNA, AMINO)}


def guess_type(text: Column | str) -> Column:
    """``dna``, ``rna``, ``amino`` or null, from the letters of ``text``; null for 10 letters or fewer."""
    t = F.upper(col(text))
    count = lambda letters: F.length(t) - F.length(F.translate(t, letters, ""))
    seen = lambda letters: sum((F.when(F.instr(t, c) > 0, 1).otherwise(0) for c in letters), F.lit(0))
    n = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    only_amino, shared, both = count("EFIJLOPQZ"), count("ACG"), count("DHKMRSVWY")
    few = F.floor(n * 2 / 100)
    as_dna = (n - shared - count("TN") <= few) & (seen("ACGT") == 4)
    as_rna = (n - shared - count("UN") <= few) & (seen("ACGU") == 4)
    as_amino = (n - shared - both - count("NTX") <= few) & (both > shared) & (seen("ACGDHKMRSVWYNT") >= 15)
    return F.when(n <= 10, None).when((n > 2000) & (count("N") == n), "dna").when(only_amino > 0, "amino").when(as_dna, "dna").when(as_rna, "rna").when(as_amino, "amino")
