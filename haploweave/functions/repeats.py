"""Repeat context of indels in a reference window."""
from __future__ import annotations

#: A run counts from so many copies of a unit of at most so many bases.
COPIES, LONGEST_UNIT = 3, 6


class Window:
    """A piece of reference: sequence and the coordinate of its first base. Beyond it all is N."""

    def __init__(self, seq: str, beg: int):
        self.seq, self.beg = seq.upper(), beg
        self.fin = beg + len(seq) - 1

    def base(self, pos: int) -> str:
        i = pos - self.beg
        c = self.seq[i] if 0 <= i < len(self.seq) else "N"
        return c if c in "ACGT" else "N"

    def run(self, pos: int, step: int) -> bool:
        """Whether copies of some short unit follow one another from pos on, to the right (1) or left (-1). N equals N."""
        bases = [self.base(pos + step * i) for i in range(LONGEST_UNIT * COPIES)]
        return any(bases[unit : COPIES * unit] == bases[: (COPIES - 1) * unit] for unit in range(1, LONGEST_UNIT + 1))


def is_homopolymer(kind: str, pos: int, ref_len: int, alt: str, window: Window, most: int) -> bool:
    """Whether a short unit repeats right of a site, or left of it."""
    if not window.seq:
        return False
    if kind == "SNP":
        left, right = pos - 1, pos + 1
    elif kind == "INS":
        if len(alt) > most:
            return False
        left, right = pos - 1, pos
    else:
        if ref_len > most:
            return False
        # The left run of a deletion starts at its last base.
        left, right = pos + ref_len - 1, pos
    return window.run(right, 1) or window.run(left, -1)


def is_tandem_repeat(kind: str, pos: int, ref_len: int, alt: str, window: Window, most: int) -> bool:
    """Whether three lengths of an indel look alike with and without it: the indel could as well stand elsewhere."""
    size = ref_len if kind == "DEL" else len(alt)
    if not window.seq or kind == "SNP" or size > most:
        return False
    span, shift = 3 * size, size if kind == "DEL" else 0
    if pos < window.beg or pos + shift + span > window.fin:
        return False
    at = pos - window.beg
    here = window.seq[at : at + span]
    if kind == "DEL":
        return here == window.seq[at + size : at + size + span]
    return here == (alt + here)[:span]


def is_repeat_indel(kind: str, pos: int, ref_len: int, alt: str, window: Window, most: int) -> bool:
    return kind != "SNP" and (is_homopolymer(kind, pos, ref_len, alt, window, most) or is_tandem_repeat(kind, pos, ref_len, alt, window, most))
