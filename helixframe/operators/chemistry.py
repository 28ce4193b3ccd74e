"""Chemistry of a library preparation."""

from __future__ import annotations

from dataclasses import dataclass

# Adapters and window constants of the protocols.
R1 = "CTACACGACGCTCTTCCGATCT"
TSO = "TTTCTTATATGGG"
TSO_THREE_PRIME = "CCCATGTACTCTGCGTTGATACCACTGCTT"
POLY_T = "TTTTTTTTTTTTT"
UMI = {5: 10, 3: 12}


@dataclass(frozen=True)
class Chemistry:
    """Capture at the 5' or 3' end, its adapters and the edits that are allowed: r1_edits and inner_edits at the ends of a read without annotation,
    3 * mismatches (R1) and mismatches (TSO, thrice for 3') in the free regions of an annotated one."""

    tech: int = 5
    r1: str = R1
    barcode: int = 16
    mismatches: int = 2
    r1_edits: int = 7
    inner_edits: int = 2
    margin: int = 6
    most_length: int = 100_000

    @property
    def inner(self) -> str:
        """What lies behind the UMI."""
        return TSO if self.tech == 5 else POLY_T

    @property
    def tso(self) -> str:
        return TSO if self.tech == 5 else TSO_THREE_PRIME

    @property
    def umi(self) -> int:
        return UMI[self.tech]

    @property
    def tso_edits(self) -> int:
        return self.mismatches if self.tech == 5 else 3 * self.mismatches


def reverse_complement(seq: str) -> str:
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
