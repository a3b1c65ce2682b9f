"""Genetic codes, translation and open reading frames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabet import DNA, col

#: The standard code in the order T, C, A, G of each place.
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


@dataclass(frozen=True)
class GeneticCode:
    """``amino``: amino acid of each of the 64 codons, ``*`` for a stop; ``starts``: initiators."""

    id: int
    name: str
    amino: dict[str, str]
    starts: frozenset[str]

    def translate(self, codon: str) -> str | None:
        """Of a codon with degenerate symbols, the amino acid that all its readings share."""
        sets = [DNA.members[DNA.symbols.index(c)] if c in DNA.symbols else "" for c in codon]
        found = {self.amino["".join(x)] for x in itertools.product(*sets)}
        return found.pop() if len(found) == 1 else None

    def is_start(self, codon: str) -> bool:
        sets = [DNA.members[DNA.symbols.index(c)] if c in DNA.symbols else "" for c in codon]
        readings = ["".join(x) for x in itertools.product(*sets)]
        return bool(readings) and all(r in self.starts for r in readings)

    def any_start(self) -> GeneticCode:
        return replace(self, starts=frozenset(c for c, a in self.amino.items() if a != "*"))

    def only_atg(self) -> GeneticCode:
        return replace(self, starts=frozenset({"ATG"}))

    def table(self, spark) -> DataFrame:
        rows = [(self.id, c, a, c in self.starts) for c, a in sorted(self.amino.items())]
        return spark.createDataFrame(rows, "code_id int, codon string, aa string, is_start boolean")


def _code(id: int, name: str, starts: str, changes: str = "") -> GeneticCode:
    amino = dict(zip(map("".join, itertools.product("TCAG", repeat=3)), _STANDARD))
    amino |= dict(c.split("=") for c in changes.split())
    return GeneticCode(id, name, amino, frozenset(starts.split()))


#: The public numbered codes, by what differs from the standard one.
CODES = {
    c.id: c
    for c in (
        _code(1, "Standard", "ATG CTG TTG"),
        _code(2, "Vertebrate Mitochondrial", "ATA ATC ATG ATT GTG", "AGA=* AGG=* ATA=M TGA=W"),
        _code(3, "Yeast Mitochondrial", "ATA ATG", "ATA=M CTA=T CTC=T CTG=T CTT=T TGA=W"),
        _code(4, "Mold/Protozoan/Coelenterate Mitochondrial", "ATA ATC ATG ATT CTG GTG TTA TTG", "TGA=W"),
        _code(5, "Invertebrate Mitochondrial", "ATA ATC ATG ATT GTG TTG", "AGA=S AGG=S ATA=M TGA=W"),
        _code(6, "Ciliate/Dasycladacean/Hexamita Nuclear", "ATG", "TAA=Q TAG=Q"),
        _code(9, "Echinoderm/Flatworm Mitochondrial", "ATG GTG", "AAA=N AGA=S AGG=S TGA=W"),
        _code(10, "Euplotid Nuclear", "ATG", "TGA=C"),
        _code(11, "Bacterial/Archaeal/Plant Plastid", "ATA ATC ATG ATT CTG GTG TTG"),
        _code(12, "Alternative Yeast Nuclear", "ATG CTG", "CTG=S"),
        _code(13, "Ascidian Mitochondrial", "ATA ATG GTG TTG", "AGA=G AGG=G ATA=M TGA=W"),
        _code(14, "Alternative Flatworm Mitochondrial", "ATG", "AAA=N AGA=S AGG=S TAA=Y TGA=W"),
        _code(16, "Chlorophycean Mitochondrial", "ATG", "TAG=L"),
        _code(21, "Trematode Mitochondrial", "ATG GTG", "AAA=N AGA=S AGG=S ATA=M TGA=W"),
        _code(22, "Scenedesmus obliquus Mitochondrial", "ATG", "TAG=L TCA=*"),
        _code(23, "Thraustochytrium Mitochondrial", "ATG ATT GTG", "TTA=*"),
        _code(24, "Pterobranchia Mitochondrial", "ATG CTG GTG TTG", "AGA=S AGG=K TGA=W"),
        _code(25, "Candidate Division SR1 and Gracilibacteria", "ATG GTG TTG", "TGA=G"),
    )
}


def by_id(id: int) -> GeneticCode | None:
    return CODES.get(id)


def _lookup(code: GeneticCode, codon: Column) -> Column:
    """The amino acid of a codon of residue symbols by its place in the table of all of them."""
    table = F.split(F.lit(",".join(code.translate("".join(c)) or "X" for c in itertools.product(DNA.residues, repeat=3))), ",")
    n = len(DNA.residues)
    place = [F.instr(F.lit(DNA.residues), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    at = ((place[0] - 1) * n + place[1] - 1) * n + place[2]
    return F.when(F.least(*place) > 0, F.element_at(table, at)).otherwise(F.lit("X"))


def translate(seq: Column | str, code: GeneticCode = CODES[1], frame: int = 0) -> Column:
    """Amino acids of the codons from ``frame`` on: ``*`` for a stop, X where readings differ; a rest of
    one or two symbols is left out."""
    cut = F.split(F.regexp_replace(F.substring(col(seq), frame + 1, 1 << 30), "(.{3})", "$1,"), ",")
    whole = F.filter(cut, lambda c: F.length(c) == 3)
    return F.array_join(F.transform(whole, lambda c: _lookup(code, c)), "")


def three_frames(df: DataFrame, seq: str, code: GeneticCode = CODES[1]) -> DataFrame:
    """A row per sequence and frame."""
    frames = F.array(*(F.struct(F.lit(f).alias("frame"), translate(seq, code, f).alias("protein")) for f in range(3)))
    return df.withColumn("_f", F.explode(frames)).select("*", "_f.frame", "_f.protein").drop("_f")


def _orfs(seq: str, code: GeneticCode, amino: dict, starts: set, shortest: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, frame, protein) of one strand: from an initiator to a stop, which ``end`` includes, or
    to the end of the sequence."""
    for frame in range(3):
        begin, protein = -1, []
        for at in range(frame, len(seq) - 2, 3):
            codon = seq[at : at + 3]
            aa = amino.get(codon, "X")
            if aa == "*":
                if begin >= 0 and len(protein) >= shortest:
                    yield begin, at + 3, frame, "".join(protein)
                begin, protein = -1, []
            elif begin >= 0:
                protein.append(aa)
            elif codon in starts:
                begin, protein = at, ["M"]
        if begin >= 0 and len(protein) >= shortest:
            yield begin, len(seq), frame, "".join(protein)


def find_orfs(df: DataFrame, id_col: str, seq: str, code: GeneticCode = CODES[1], shortest: int = 20) -> DataFrame:
    """A row per open reading frame of both strands: (id, start, end, frame, strand, protein) with 0-based
    coordinates of the strand's own reading, and forward_start and forward_end on the given strand.
    Degenerate codons never start a frame."""
    amino = {c: a for c in map("".join, itertools.product(DNA.residues, repeat=3)) if (a := code.translate(c))}
    starts, pairs = set(code.starts), str.maketrans(*DNA.complements)
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text in zip(f[id_col], f[seq]):
                if text is None:
                    continue
                n = len(text)
                out += [(key, s, e, fr, "forward", p, s, e) for s, e, fr, p in _orfs(text, code, amino, starts, shortest)]
                out += [(key, s, e, fr, "reverse", p, n - e, n - s) for s, e, fr, p in _orfs(text.translate(pairs)[::-1], code, amino, starts, shortest)]
            yield pd.DataFrame(out, columns=[id_col, "start", "end", "frame", "strand", "protein", "forward_start", "forward_end"])

    return df.select(id_col, seq).mapInPandas(run, f"{id_col} {kind}, start int, end int, frame int, strand string, protein string, forward_start int, forward_end int")
