"""Index of a coordinate-sorted BAM file: bins with the stretches that hold their records, and the first record of each window.

Places in a file are virtual offsets: where a block begins, times 2^16, plus a
place in the inflated block. The index is read on the driver, where it says which
stretches of the file a range needs, and where a file may be cut between records.
"""
from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field

#: Fixed values of the format: bits of a window, and (bits of a bin, number of the first such bin) by level.
WINDOW = 14
LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
#: The bin that holds counts, no stretches.
COUNTS = 37450


def bin_of(beg: int, fin: int) -> int:
    """The smallest bin that holds a span (0-based, fin not included)."""
    for shift, first in reversed(LEVELS):
        if beg >> shift == (fin - 1) >> shift:
            return first + (beg >> shift)
    return 0


def bins_over(beg: int, fin: int) -> list[int]:
    """All bins that may hold records over a span."""
    return [0] + [b for shift, first in LEVELS for b in range(first + (beg >> shift), first + ((fin - 1) >> shift) + 1)]


@dataclass
class Contig:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: list[int] = field(default_factory=list)  # least offset of a record over each window, 0 where there is none


class Index:
    def __init__(self, contigs: int = 0):
        self.contigs = [Contig() for _ in range(contigs)]

    @classmethod
    def parse(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAM index")
        index, at = cls(struct.unpack_from("<i", data, 4)[0]), 8
        for contig in index.contigs:
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                pairs = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                at += 8 + 16 * chunks
                if number != COUNTS:
                    contig.bins[number] = list(zip(pairs[::2], pairs[1::2]))
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            contig.windows = list(struct.unpack_from(f"<{n}Q", data, at))
            at += 8 * n
        return index

    def bytes(self) -> bytes:
        out = [b"BAI\x01", struct.pack("<i", len(self.contigs))]
        for contig in self.contigs:
            out.append(struct.pack("<i", len(contig.bins)))
            for number, chunks in sorted(contig.bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(x for pair in chunks for x in pair)))
            filled, last = [], 0
            for x in contig.windows:  # a window without records takes the place of the one before
                last = x or last
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return b"".join(out)

    def add(self, tid: int, beg: int, fin: int, first: int, last: int) -> None:
        """Takes in a record over a span that lies from one virtual offset to another, in the file's order."""
        contig = self.contigs[tid]
        chunks = contig.bins.setdefault(bin_of(beg, fin), [])
        if chunks and chunks[-1][1] >= first:
            chunks[-1] = (chunks[-1][0], last)
        else:
            chunks.append((first, last))
        contig.windows += [0] * (((fin - 1) >> WINDOW) + 1 - len(contig.windows))
        for w in range(beg >> WINDOW, ((fin - 1) >> WINDOW) + 1):
            contig.windows[w] = contig.windows[w] or first

    def append(self, other: Index, by: int) -> None:
        """Takes in the index of what follows in the file, whose blocks begin ``by`` bytes later than it says."""
        shift = by << 16
        for mine, theirs in zip(self.contigs, other.contigs):
            for number, chunks in theirs.bins.items():
                mine.bins.setdefault(number, []).extend((a + shift, b + shift) for a, b in chunks)
            mine.windows += [0] * (len(theirs.windows) - len(mine.windows))
            for w, x in enumerate(theirs.windows):
                if x:
                    mine.windows[w] = mine.windows[w] or x + shift

    def stretches(self, tid: int, beg: int, fin: int) -> list[tuple[int, int]]:
        """Stretches of the file, in order and apart, that hold all records over a span."""
        if not 0 <= tid < len(self.contigs):
            return []
        contig = self.contigs[tid]
        known = contig.windows[beg >> WINDOW] if beg >> WINDOW < len(contig.windows) else contig.windows[-1] if contig.windows else 0
        found = sorted((max(a, known), b) for number in bins_over(beg, fin) for a, b in contig.bins.get(number, ()) if b > known)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a >> 16 <= out[-1][1] >> 16:  # in one block: reading it twice would not pay
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def cuts(self) -> list[int]:
        """Virtual offsets where records begin, in order."""
        return sorted({x for c in self.contigs for x in [*c.windows, *(a for chunks in c.bins.values() for a, _ in chunks)] if x})


def cut(stretch: tuple[int | None, int | None], cuts: list[int], size: int) -> list[tuple[int | None, int | None]]:
    """A stretch (None: from the first record, or to the file's end) in parts of at least about ``size`` bytes, between records."""
    first, last = stretch
    out, begin = [], first
    at = 0 if first is None else bisect_left(cuts, first + 1)
    while at < len(cuts) and (last is None or cuts[at] < last):
        if (cuts[at] >> 16) - ((begin or 0) >> 16) >= size:
            out.append((begin, cuts[at]))
            begin = cuts[at]
        at += 1
    return [*out, (begin, last)]
