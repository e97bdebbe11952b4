"""Translation of codons as Spark expressions: the standard code, with IUPAC ambiguity."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: NCBI genetic code 1, codons in the order of TCAG.
BASES = "TCAG"
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Residues that share a code.
SHARED = {"DN": "B", "EQ": "Z", "IL": "J"}


@lru_cache
def codon_residues() -> dict[str, str]:
    """Every codon of IUPAC letters that resolves to something other than X."""
    plain = dict(zip(map("".join, product(BASES, repeat=3)), RESIDUES))
    out = {}
    for codon in map("".join, product(IUPAC, repeat=3)):
        meant = "".join(sorted({plain["".join(c)] for c in product(*(IUPAC[b] for b in codon))}))
        residue = meant if len(meant) == 1 else SHARED.get(meant)
        if residue:
            out[codon] = residue
    return out


def _map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(codon_residues().items())])


def translate_codon(codon: Column) -> Column:
    """One-letter residue; X for what can't be resolved, has another length or other letters."""
    return F.coalesce(F.try_element_at(_map(), F.translate(F.upper(codon), "U", "T")), F.lit("X"))


def translate(seq: Column) -> Column:
    """Residues of frame 0; a partial codon at the end is left out."""
    n = F.floor(F.length(seq) / 3).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(seq.isNotNull(), F.array_join(F.transform(steps, lambda k: translate_codon(F.substring(seq, k * 3 + 1, F.lit(3)))), ""))
