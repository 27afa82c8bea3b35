"""Partial-order alignment: sequences of one place as a graph of bases, its consensus, and the two groups that its columns tell apart.

A column holds the bases that reads have in one place, each base a node; columns
stay in order as the graph grows, since a path goes through them from left to
right. A sequence is aligned to all paths at once with two-piece affine gaps. A
row of the dynamic program is one node's, a vector over the sequence within a
band about the lengths of the paths to the node. Whatever leaves the band of
half-width w has gaps of more than w bases both ways; if no alignment with such
gaps could score as much as what was found, the band has lost nothing, else it
is made wider. So the result is that of the full table.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..options import Options
from .align import NOWHERE, alike, gap_cost, one_sided

GAP = "-"
#: Alleles in the order in which equal counts are settled.
ALLELES = "ACGTN" + GAP


@dataclass
class Node:
    base: str
    column: int
    into: list[int] = field(default_factory=list)
    out: list[int] = field(default_factory=list)


class Graph:
    def __init__(self, o: Options = Options()):
        self.o = o
        self.nodes: list[Node] = []
        self.columns: list[list[int]] = []  # nodes of a column, by the column's number
        self.order: list[int] = []  # numbers of the columns from left to right
        self.paths: list[list[int]] = []  # nodes of each sequence
        self.reach: list[tuple[bool, bool]] = []  # whether it goes to the left and the right end
        self.given: dict[tuple, int] = {}  # sequences that were added, and where: a like one takes the same path

    # --- growing ---

    def add(self, seq: str, first: int = 0, last: int | None = None, left: bool = True, right: bool = True) -> list[int]:
        """Adds a sequence between two nodes of the first sequence (from, to excluded; all of it by default). Returns its nodes."""
        like = self.given.setdefault((seq, first, last, left, right), len(self.paths))
        if like < len(self.paths):
            path = list(self.paths[like])  # nothing scores better
        else:
            path = self._thread(seq, self._align(seq, first, last) if self.paths else [(-1, j) for j in range(len(seq))], first)
        self.paths.append(path)
        self.reach.append((left, right))
        return path

    def skip(self) -> None:
        """Counts a sequence that takes no part."""
        self.paths.append([])
        self.reach.append((False, False))

    def _thread(self, seq: str, pairs: list[tuple[int, int]], first: int) -> list[int]:
        """Makes a path of an alignment: shares nodes of like base, adds others to the column, or columns to the graph."""
        path: list[int] = []
        after: dict[int, list[int]] = {}  # new columns behind a column; -1 before all
        at = self.nodes[self.paths[0][first]].column if self.paths and first else None
        at = self._before(at) if at is not None else -1
        for v, j in pairs:
            if j < 0:
                continue
            if v >= 0:
                column = self.nodes[v].column
                new = next((u for u in self.columns[column] if self.nodes[u].base == seq[j]), None)
                at = column
            else:
                column, new = len(self.columns), None
                self.columns.append([])
                after.setdefault(at, []).append(column)
            if new is None:
                new = len(self.nodes)
                self.nodes.append(Node(seq[j], column))
                self.columns[column].append(new)
            if path and new not in self.nodes[path[-1]].out:
                self.nodes[path[-1]].out.append(new)
                self.nodes[new].into.append(path[-1])
            path.append(new)
        if after:
            self.order = after.get(-1, []) + [c for column in self.order for c in (column, *after.get(column, ()))]
        return path

    def _before(self, column: int) -> int:
        k = self.order.index(column)
        return self.order[k - 1] if k else -1

    # --- aligning ---

    def _span(self, first: int, last: int | None) -> list[int]:
        """Nodes between two nodes of the first sequence, from left to right."""
        begin = self.order.index(self.nodes[self.paths[0][first]].column) if first else 0
        if last is None or last == len(self.paths[0]):
            end = len(self.order)
        else:
            end = self.order.index(self.nodes[self.paths[0][last - 1]].column) + 1
        return [v for c in self.order[begin:end] for v in self.columns[c]]

    def _align(self, seq: str, first: int, last: int | None) -> list[tuple[int, int]]:
        """Pairs (node, place in seq), -1 for none, of the best alignment of all of seq to a path through the span."""
        span = self._span(first, last)
        inside = set(span)
        into = {v: [u for u in self.nodes[v].into if u in inside] for v in span}
        out = {v: [u for u in self.nodes[v].out if u in inside] for v in span}
        # Only ways from one end of the span to the other count: from nodes of the first sequence, or with which others reach an end.
        whole = last is None or last == len(self.paths[0])
        begins = {self.paths[0][first]} if first else {p[0] for p, (left, _) in zip(self.paths, self.reach) if p and left}
        ends = {p[-1] for p, (_, right) in zip(self.paths, self.reach) if p and right} if whole else {self.paths[0][last - 1]}
        low, high = {}, {}
        for v in span:
            ways = [(low[u] + 1, high[u] + 1) for u in into[v] if u in low] + [(1, 1)] * (v in begins)
            if ways:
                low[v], high[v] = min(w[0] for w in ways), max(w[1] for w in ways)
        rest_low, rest_high = {}, {}
        for v in reversed(span):
            ways = [(rest_low[u] + 1, rest_high[u] + 1) for u in out[v] if u in rest_low] + [(0, 0)] * (v in ends)
            if ways:
                rest_low[v], rest_high[v] = min(w[0] for w in ways), max(w[1] for w in ways)
        span = [v for v in span if v in low and v in rest_low]
        into = {v: [u for u in into[v] if u in low and u in rest_low] for v in span}
        m, width = len(seq), 32
        while True:
            bands = {v: (max(0, min(low[v], m - rest_high[v]) - width), min(m, max(high[v], m - rest_low[v]) + width)) for v in span}
            score, pairs = self._table(seq, span, into, begins, ends, bands)
            outside = self.o.match * (m - width - 1) - 2 * gap_cost(width + 1, self.o)
            if score > outside or all(b == (0, m) for b in bands.values()):
                return pairs
            width *= 4

    def _table(self, seq, span, into, begins, ends, bands) -> tuple[int, list[tuple[int, int]]]:
        o, m = self.o, len(seq)
        y = np.frombuffer(seq.encode("latin-1"), np.uint8)
        pieces = ((o.gap_open1, o.gap_ext1), (o.gap_open2, o.gap_ext2))
        at = np.arange(m + 1, dtype=np.int64)
        start = -np.minimum(o.gap_open1 + o.gap_ext1 * at, o.gap_open2 + o.gap_ext2 * at)
        start[0] = 0
        rows: dict[int, tuple[int, np.ndarray, list[np.ndarray]]] = {-1: (0, start, [np.full(m + 1, NOWHERE)] * 2)}
        before = {v: into[v] + [-1] * (v in begins) for v in span}

        def cut(u: int, lo: int, hi: int, which: int) -> np.ndarray:
            """Row of a node before (scores, or gaps of a piece) from lo to hi, both included."""
            first, scores, gaps = rows[u]
            row = scores if which < 0 else gaps[which]
            if first <= lo and first + len(row) > hi:
                return row[lo - first : hi + 1 - first]
            out = np.full(hi + 1 - lo, NOWHERE, np.int64)
            a, b = max(lo, first), min(hi + 1, first + len(row))
            if a < b:
                out[a - lo : b - lo] = row[a - first : b - first]
            return out

        for v in span:
            lo, hi = bands[v]
            best = np.full(hi + 1 - lo, NOWHERE, np.int64)
            gaps = [best.copy(), best.copy()]
            fits = np.where(y[max(lo, 1) - 1 : hi] == ord(self.nodes[v].base), o.match, -o.mismatch)
            for u in before[v]:
                np.maximum(best[lo == 0 :], cut(u, max(lo, 1) - 1, hi - 1, -1) + fits, out=best[lo == 0 :])
                h = cut(u, lo, hi, -1)
                for k, (opening, ext) in enumerate(pieces):
                    np.maximum(gaps[k], np.maximum(h - opening, cut(u, lo, hi, k)) - ext, out=gaps[k])
            for g in gaps:
                np.maximum(best, g, out=best)
            across = [np.maximum.accumulate(best + ext * at[lo : hi + 1])[:-1] - opening - ext * at[lo + 1 : hi + 1] for opening, ext in pieces]
            for run in across:
                np.maximum(best[1:], run, out=best[1:])
            rows[v] = lo, best, gaps

        def value(u: int, j: int, which: int = -1) -> int:
            first, scores, gaps = rows[u]
            row = scores if which < 0 else gaps[which]
            return int(row[j - first]) if first <= j < first + len(row) else NOWHERE

        v = max((u for u in span if u in ends), key=lambda u: value(u, m))
        score, j, kind, pairs = value(v, m), m, -1, []
        while v >= 0:
            here = value(v, j, kind)
            if kind >= 0:
                opening, ext = pieces[kind]
                pairs.append((v, -1))
                # A gap ends where it can, so that it is not longer than it need be.
                u = next((u for u in before[v] if value(u, j) - opening - ext == here), None)
                if u is None:
                    v = next(u for u in before[v] if value(u, j, kind) - ext == here)
                else:
                    v, kind = u, -1
                continue
            fit = (o.match if j and seq[j - 1] == self.nodes[v].base else -o.mismatch)
            u = next((u for u in before[v] if j and value(u, j - 1) + fit == here), None)
            if u is not None:
                pairs.append((v, j - 1))
                v, j = u, j - 1
                continue
            kind = next((k for k in (0, 1) if value(v, j, k) == here), -1)
            if kind < 0:
                size = next(k for k in range(1, j + 1) if value(v, j - k) - gap_cost(k, o) == here)
                pairs += [(-1, j - 1 - k) for k in range(size)]
                j -= size
        pairs += [(-1, k) for k in range(j - 1, -1, -1)]
        return score, pairs[::-1]

    # --- reading ---

    def rows(self) -> list[str]:
        """Each sequence over all columns, gaps where it has no base."""
        place = {c: k for k, c in enumerate(self.order)}
        out = []
        for path in self.paths:
            row = [GAP] * len(self.order)
            for v in path:
                row[place[self.nodes[v].column]] = self.nodes[v].base
            out.append("".join(row))
        return out

    def covered(self) -> np.ndarray:
        """By sequence and column, whether the sequence has a say: from its first base to its last, and to the ends it reaches."""
        place = {c: k for k, c in enumerate(self.order)}
        out = np.zeros((len(self.paths), len(self.order)), bool)
        for k, (path, (left, right)) in enumerate(zip(self.paths, self.reach)):
            if path:
                first, last = place[self.nodes[path[0]].column], place[self.nodes[path[-1]].column]
                out[k, 0 if left else first : len(self.order) if right else last + 1] = True
        return out

    def counts(self, which: list[int] | None = None) -> np.ndarray:
        """By column and allele, how many of the sequences show it."""
        which = list(range(len(self.paths)) if which is None else which)
        rows, covered = self.rows(), self.covered()
        shown = np.array([np.frombuffer(rows[k].encode(), np.uint8) for k in which]).reshape(len(which), -1)
        return np.stack([((shown == ord(c)) & covered[which]).sum(axis=0) for c in ALLELES], axis=1)

    def consensus(self, which: list[int] | None = None) -> str:
        """Row over all columns: the base most sequences show there, unless more show none."""
        n = self.counts(which)
        best = n[:, :-1].argmax(axis=1)
        return "".join(ALLELES[b] if n[c, b] and n[c, b] >= n[c, -1] else GAP for c, b in enumerate(best))

    def clusters(self, min_freq: float) -> list[list[int]]:
        """The sequences in two groups by the columns where two alleles or more are shown by enough of them, or in one.

        Columns on end that tell the same apart count once, as one insertion or deletion. The groups are those about the two
        sequences to which all are nearest in sum; each needs as many as an allele does."""
        all_ = [k for k, p in enumerate(self.paths) if p]
        need = max(2, min_freq * len(all_))
        told = np.flatnonzero((self.counts() >= need).sum(axis=1) > 1)
        if len(told) == 0 or len(all_) < 4:
            return [all_]
        rows, covered = self.rows(), self.covered()
        shown = np.array([np.frombuffer(rows[k].encode(), np.uint8)[told] for k in all_])
        shown = np.where(covered[all_][:, told], shown, 0)  # 0: no say
        parts = [np.unique(shown[:, c], return_inverse=True)[1] for c in range(len(told))]
        new = [c == 0 or told[c] != told[c - 1] + 1 or (parts[c] != parts[c - 1]).any() for c in range(len(told))]
        shown = shown[:, np.array(new)]
        far = np.stack([((shown != s) & (shown != 0) & (s != 0)).sum(axis=1) for s in shown])
        # Like sequences are one choice of a centre: the first of them.
        centres = np.unique(far, axis=0, return_index=True)[1]
        sums = [(np.minimum(far[a], far[centres]).sum(axis=1), a) for a in np.sort(centres)]
        _, a, b = min((int(s.min()), int(a), int(centres[s == s.min()].min())) for s, a in sums)
        second = far[b] < far[a]
        if min(second.sum(), (~second).sum()) < need:
            return [all_]
        groups = [[k for k, x in zip(all_, second) if not x], [k for k, x in zip(all_, second) if x]]
        return sorted(groups)


def joined(reads: list[tuple[str, bool, bool]], o: Options = Options(), sampling: bool = False) -> Graph:
    """Graph of reads (sequence, reaches the left end, reaches the right), the first of which reaches both.

    A read that reaches one end is aligned to the part of the graph that it has in common with the first read. Reads that
    differ from the first in more than a tenth take no part: those that reach one end, and in sampling mode all."""
    graph = Graph(o)
    for k, (seq, left, right) in enumerate(reads):
        if k == 0:
            graph.add(seq)
        elif left and right:
            if sampling and not alike(reads[0][0], seq):
                graph.skip()
            else:
                graph.add(seq)
        else:
            part = one_sided(reads[0][0], seq, left, o)
            if part is None:
                graph.skip()
            else:
                graph.add(seq[part[2] : part[3]], part[0], part[1], left, right)
    return graph


def trimmed(cons: str, read: str, left: bool, right: bool) -> tuple[str, str, int, int]:
    """Rows of a consensus and a read without columns that both lack, and the columns (from, to) in which the read counts.

    A read that reaches one end counts up to the last match on the other side; beyond, its row is gaps."""
    pairs = [(c, r) for c, r in zip(cons, read) if c != GAP or r != GAP]
    x, y = "".join(c for c, _ in pairs), "".join(r for _, r in pairs)
    n = len(pairs)
    if left and right:
        return x, y, 0, n
    same = [k for k, (c, r) in enumerate(pairs) if c == r]
    if left:
        last = same[-1] + 1 if same else 0
        return x, y[:last] + GAP * (n - last), 0, last
    first = same[0] if same else n
    return x, GAP * first + y[first:], first, n


def consensus(reads: list[str], o: Options = Options(), left: list[str] = (), right: list[str] = ()) -> str:
    """Consensus of reads over the same span, the longest first; reads of its left or right part have a say in what they cover."""
    whole = sorted((r for r in reads if r), key=len, reverse=True)
    if not whole:
        return ""
    parts = [(r, True, False) for r in left if r] + [(r, False, True) for r in right if r]
    return joined([(r, True, True) for r in whole] + parts, o).consensus().replace(GAP, "")
