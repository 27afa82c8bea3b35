"""SimHash near-duplicates by vantage-point trees.

Fingerprint: 64 bits over word shingles hashed with XXH64; a bit is set where
over half the shingles have it. Fingerprints link at ``radius`` or fewer
differing bits, components are the transitive closure.

Search. Two fingerprints within 3 bits are within 1 bit in one 32-bit half
(pigeonhole), so there is one vantage-point tree over each half, searched with
radius // 2. The upper part of each tree only places boundaries: its top is built
on the driver from a bounded sample of distinct fingerprints (``sample_rows``), and
where that is too small to part all shards, each of its leaves is split further by
a task from that leaf's own sample, so shards stay at about ``shard_rows`` however
large the table. What reaches the driver is the tree, 14 bytes a shard. Every
fingerprint descends it as a candidate to its own shard, and by the triangle bounds
as a query to all shards whose ball or shell it may touch. In a shard the tree goes
on, down to leaves that are compared exactly on all 64 bits; where all candidates
agree in the tree's half, by the other half with the full radius, and at last by balls
whose members need no comparison among themselves. A shard's links are
reduced to a spanning forest before they leave the task, so a group of n near copies
costs at most n edges a shard, never n^2. Only a shard that no boundary can part
(fingerprints alike in one half, ``block_rows`` of them and more) is cut into blocks
of queries by blocks of candidates; no candidate is ever dropped.

Longer fingerprints. ``length`` words of 64 bits (further ones from the same hashes,
mixed) tell similarities apart that 64 bits can't: ``bits_apart`` gives the radius for
a Jaccard similarity of the shingle sets. Every 32-bit half of every word then has its
tree, searched with ``reach`` 2: ``found_part`` tells what part of the pairs some half
brings together (0.98 at a similarity of 0.8 with 32 halves). In a shard a pair is told by
the first ``TOLD`` words, with a margin, and what a shard links is the spanning forest
of least distances, so that a copy is linked to what it is nearest to. Each linked pair
is then held against the radius on all bits. What can be lost are pairs that no half
brings together, and links that a forest replaces by shorter ones which then fail.

With a ``similarity`` documents are linked by the Jaccard similarity of their shingle sets:
linked pairs are held against it, so no link is below it, and ``overlap`` finds the pairs
that the fingerprints leave out, so none is missed, whatever the radius and the length.

Defined results: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle are one shingle; equal fingerprints are one
node with the smallest doc_id; rows that repeat a doc_id are one document, rows
without a doc_id take part but never name a component unless nothing else does.
"""
from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, checkpoint, maybe, pieces, sampled, small_batches, words_of
from .components import components
from .lm import mix
from .overlap import keyed, shingles_of, similar_components  # noqa: F401

LANES = 0x0101010101010101
CHUNK = 255 * 256  # shingles that are counted at once
TOLD = 8  # words of a fingerprint that go to the shards


def signature(raw: bytes | None, words: int = 3, seed: int = 42, length: int = 1) -> np.ndarray:
    """SimHash of a UTF-8 text: ``length`` unsigned 64-bit numbers, the first over the hashes as they are."""
    w = words_of(raw)
    n = max(1, len(w) - words + 1)
    counts = np.zeros((length, 8, 8), np.int64)  # of set bits, by word, bit within a byte, byte
    for first in range(0, n if w else 0, CHUNK):  # memory is bounded for texts of any length
        part = w[first : first + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        h = np.concatenate([h[None, :], mix(np.arange(1, length, dtype=np.uint64)[:, None], h[None, :])]) if length > 1 else h[None, :]
        starts = np.arange(0, h.shape[1], 255)
        for k in range(8):  # eight bits a pass: byte lanes count up to 255 hashes at once
            lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(LANES), starts, axis=1)
            counts[:, k] += lanes.astype("<u8").view(np.uint8).reshape(length, -1, 8).sum(axis=1, dtype=np.int64)
    bits = (2 * counts > n).transpose(0, 2, 1)
    return np.packbits(bits.reshape(length, 64), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(raw: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number."""
    return int(signature(raw, words, seed)[0])


def bits_apart(similarity: float, length: int, deviations: float = 0.5) -> int:
    """In how many bits fingerprints of shingle sets with a Jaccard similarity differ: what is expected of sets of one
    size, and some standard deviations more."""
    bits, part = 64 * length, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * part + math.sqrt(bits * part * (1 - part)) * deviations)


def found_part(apart: float, length: int, reach: int) -> float:
    """Part of the pairs that differ in that part of their bits that some half of a long fingerprint brings together."""
    within = sum(math.comb(32, k) * apart**k * (1 - apart) ** (32 - k) for k in range(reach + 1))
    return 1 - (1 - within) ** (2 * length)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, length: int = 1) -> DataFrame:
    """doc_id, node (a long: the 64 bits, or a hash of more), fp (array of the words as signed longs), key (hash of the text)."""

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            texts = as_binary(batch.column(1)).to_pylist()
            fps = np.array([signature(t, words, seed, length) for t in texts], np.uint64).reshape(-1, length)
            node = fps[:, 0] if length == 1 else np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in fps), np.uint64, len(fps))
            lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, length, dtype=np.int32), pa.array(fps.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(node.view(np.int64)), lists, batch.column(2)], ["doc_id", "node", "fp", "key"])

    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), text, F.xxhash64(F.coalesce(text, F.lit(""))))
    return rows.mapInArrow(run, "doc_id long, node long, fp array<long>, key long")


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    """The 32-bit half that a tree is built over."""
    return ((fps >> np.uint64(32)) if tree else (fps & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def vantage(points: np.ndarray, tries: int = 16) -> tuple[np.uint32, int, np.ndarray]:
    """The point of a few that spreads the distances most; the radius of its ball; the distances. Ball: up to the radius."""
    picks = np.unique(points[np.linspace(0, len(points) - 1, tries).astype(int)])
    dist = [np.bitwise_count(points ^ p).astype(np.int16) for p in picks]
    best = int(np.argmax([d.std() for d in dist]))
    d = dist[best]
    mid = int(np.median(d))
    radius = min((r for r in (mid - 1, mid) if (d <= r).any()), key=lambda r: abs(2 * int((d <= r).sum()) - len(d)), default=mid)
    return picks[best], radius, d


class Tree:
    """The upper part of a tree: vantage points, radii of their balls, and what is in the ball and beyond it: the number
    of a node, or -1 - shard."""

    def __init__(self, points: np.ndarray, depth: int, least: int = 32):
        point, radii, kids, todo = [], [], [], [(points, depth, -1, 0)]
        self.shards = 0
        while todo:
            points, depth, parent, side = todo.pop()
            here = -1 - self.shards
            if depth and len(points) >= least:
                p, radius, d = vantage(points)
                inside = d <= radius
                if not inside.all():
                    here = len(point)
                    point.append(p), radii.append(radius), kids.append([0, 0])
                    todo += [(points[~inside], depth - 1, here, 1), (points[inside], depth - 1, here, 0)]
            self.shards += here < 0
            if parent >= 0:
                kids[parent][side] = here
        self.point, self.radius, self.kids = np.array(point, np.uint32), np.array(radii, np.int16), np.array(kids, np.int32).reshape(-1, 2)

    def grafted(self, below: dict[int, Tree]) -> Tree:
        """The tree with trees in place of some shards."""
        out, trees = Tree(self.point[:0], 0), [below.get(s) for s in range(self.shards)]
        points, radii, leaf = [self.point], [self.radius], np.zeros(self.shards, np.int32)
        kids, nodes, out.shards = [], len(self.point), 0
        for s, t in enumerate(trees):
            if t is None or not len(t.point):
                leaf[s] = -1 - out.shards
                out.shards += 1
                continue
            leaf[s] = nodes
            points.append(t.point), radii.append(t.radius), kids.append(np.where(t.kids >= 0, t.kids + nodes, t.kids - out.shards))
            nodes, out.shards = nodes + len(t.point), out.shards + t.shards
        own = np.where(self.kids >= 0, self.kids, leaf[np.minimum(-1 - self.kids, self.shards - 1)])
        out.point, out.radius, out.kids = np.concatenate(points), np.concatenate(radii), np.concatenate([own, *kids]).astype(np.int32)
        return out

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is the row's home) for each shard that rows may find partners in, level by level."""
        row, home = np.arange(len(points)), np.ones(len(points), bool)
        node = np.zeros(len(points), np.int32) if len(self.point) else np.full(len(points), -1, np.int32)
        done = []
        while len(row):
            leaf = node < 0
            done.append((row[leaf], -1 - node[leaf], home[leaf]))
            row, node, home = row[~leaf], node[~leaf], home[~leaf]
            d, r = np.bitwise_count(points[row] ^ self.point[node]).astype(np.int16), self.radius[node]
            ball, shell = d <= r + reach, d + reach > r
            row, home, node = np.concatenate([row[ball], row[shell]]), np.concatenate([(home & (d <= r))[ball], (home & (d > r))[shell]]), np.concatenate([self.kids[node[ball], 0], self.kids[node[shell], 1]])
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (row, node, home)


class Forest:
    """Union-find whose unions come in blocks; ``pairs`` are those that joined two trees."""

    def __init__(self, n: int):
        self.root, self.pairs = np.arange(n), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def flat(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.broadcast_arrays(a, b)
        root = self.flat()
        apart = np.flatnonzero(root[a] != root[b])
        a, b = a[apart], b[apart]
        _, at = np.unique(root[a] * len(root) + root[b], return_index=True)
        for i, j in zip(a[at].tolist(), b[at].tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.pairs.append((i, j))


class Shortest(Forest):
    """Spanning forest of the least distances. Pairs come in blocks and are held until there are many, then only those of the
    forest stay: where a pair is given up, pairs of less distance each connect its ends. Once there is a forest, its trees
    at each level of distance (of LEVEL bits) tell of most pairs at once that they are not needed, so a large group of near
    copies leaves little to hold."""

    LEVEL = 8

    def __init__(self, n: int, most: int = 1 << 18):
        super().__init__(n)
        self.n, self.most, self.held, self.count, self.trees = n, most, [], 0, None

    def near(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        a, b = np.broadcast_arrays(a, b)
        new = a != b
        if self.trees is not None:
            level = np.minimum(d // self.LEVEL, len(self.trees) - 1)  # trees[k]: of pairs nearer than k levels
            new = new & (self.trees[level, a] != self.trees[level, b])
        self.held.append(np.stack([a[new], b[new], d[new].astype(np.int64)], 1))
        self.count += len(self.held[-1])
        if self.count > self.most + 2 * self.n:
            self.boiled()

    def boiled(self) -> np.ndarray:
        """Rows (a, b, distance) of the forest: round by round each tree takes its shortest pair."""
        rows = np.concatenate(self.held) if self.held else np.empty((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2]))]
        trees, taken, at = Forest(self.n), np.zeros(len(rows), bool), np.arange(len(rows))
        while True:
            root = trees.flat()
            at = at[root[rows[at, 0]] != root[rows[at, 1]]]
            if not len(at):
                break
            best = np.full(self.n, len(rows))
            for side in (0, 1):
                np.minimum.at(best, root[rows[at, side]], at)
            chosen = np.unique(best[best < len(rows)])
            taken[chosen] = True
            trees.join(rows[chosen, 0], rows[chosen, 1])
        rows = rows[taken]
        self.held, self.count = [rows], len(rows)
        level, trees, found = rows[:, 2] // self.LEVEL, Forest(self.n), []
        for k in range(int(level.max()) + 2 if len(rows) else 1):
            here = level == k - 1
            trees.join(rows[here, 0], rows[here, 1])
            found.append(trees.flat().astype(np.int32))
        self.trees = np.stack(found)
        return rows


class Nearness:
    """The test of two rows. One word: that it differs in radius bits at most. Of more words the first TOLD are there: that
    the tree's half is within reach, and that they differ in no more than four standard deviations above what the radius
    on all bits leaves them."""

    def __init__(self, words: np.ndarray, halves: np.ndarray, reach: int, radius: int, length: int):
        self.words, self.halves, self.reach = words, halves, None if length == 1 else reach
        part = radius / (64 * length)
        bits = 64 * words.shape[1]
        self.limit = radius if length == 1 else math.ceil(bits * part + 4 * math.sqrt(bits * part * (1 - part)))

    def apart(self, rows, others) -> np.ndarray:
        return sum(np.bitwise_count(w[rows] ^ w[others]).astype(np.int16) for w in self.words.T)

    def join(self, q: np.ndarray, c: np.ndarray, forest: Forest) -> None:
        """Joins the pairs of a query and a candidate that are near."""
        if self.reach is None:
            x, y = np.nonzero(self.apart(q[:, None], c[None, :]) <= self.limit)
            forest.join(q[x], c[y])
            return
        x, y = np.nonzero(np.bitwise_count(self.halves[q][:, None] ^ self.halves[c][None, :]) <= self.reach)
        d = self.apart(q[x], c[y])
        close = d <= self.limit
        forest.near(q[x[close]], c[y[close]], d[close])


def search(q: np.ndarray, c: np.ndarray, halves: np.ndarray, reach: int, forest: Forest, leaf_rows: int, near: Nearness, others: np.ndarray | None = None) -> None:
    """Joins in forest all pairs of a query and a candidate (indices into halves) that are near, or joins them through
    others, going down a tree over the candidates' halves, and over their other halves (if given) where these are all alike."""
    if not len(q) or not len(c):
        return
    if len(c) > leaf_rows:
        p, r, d = vantage(halves[c])
        if not (d <= r).all():
            dq = np.bitwise_count(halves[q] ^ p)
            search(q[dq <= r + reach], c[d <= r], halves, reach, forest, leaf_rows, near, others)
            search(q[dq + reach > r], c[d > r], halves, reach, forest, leaf_rows, near, others)
            return
        if others is not None:
            search(q, c, others, near.limit, forest, leaf_rows, near)
            return
        # All alike in the half, so that its distance to a query is one number. A ball of the limit around one of them: all in
        # it are joined with it. Pairs are left with one or both outside, and none across more than two limits.
        q, held = q[np.bitwise_count(halves[q] ^ halves[c[0]]) <= reach], 1.0
        while len(c) > leaf_rows and held > 1 / 64:
            v = c[len(c) // 2]
            dq, dc = near.apart(q, v), near.apart(c, v)
            q_in, c_in, q_close, c_close = dq <= near.limit, dc <= near.limit, dq <= 2 * near.limit, dc <= 2 * near.limit
            if near.reach is None:
                forest.join(np.concatenate([q[q_in], c[c_in]]), v)
            else:
                forest.near(np.concatenate([q[q_in], c[c_in]]), v, np.concatenate([dq[q_in], dc[c_in]]))
            compare(q[q_in], c[c_close & ~c_in], forest, near)
            compare(q[q_close & ~q_in], c[c_in], forest, near)
            held = c_in.mean()
            q, c = q[~q_in], c[~c_in]
    compare(q, c, forest, near)


def compare(q: np.ndarray, c: np.ndarray, forest: Forest, near: Nearness) -> None:
    """Joins all pairs that are near, by holding each query against each candidate, in blocks."""
    step = max(1, 1_000_000 // max(1, len(c)))
    for i in range(0, len(q) if len(c) else 0, step):
        near.join(q[i : i + step], c, forest)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Lists of length longs as rows of unsigned numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, length)


def trees_of(nodes: DataFrame, total: int, sample_rows: int, shard_rows: int, length: int = 1) -> list[Tree]:
    """The upper trees over all halves, with shards of about shard_rows."""
    depth, trees = max(0, int(np.ceil(np.log2(max(1, total / shard_rows))))), 2 * length
    sample = np.array([r[0] for r in sampled(nodes, total, sample_rows, "node").select("fp").collect()], np.int64).view(np.uint64).reshape(-1, length)
    top = max(0, min(depth, int(np.log2(max(1, len(sample) / 64)))))
    upper = [Tree(half(sample[:, t // 2], t % 2), top) for t in range(trees)]
    if top == depth:
        return upper
    # About 64 points a shard, in the tree's leaf that they lie in.
    part = nodes.select("fp").filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(1, shard_rows // 64))) == 0)

    def placed(batches):
        for batch in batches:
            fps = matrix(batch.column(0), length)
            for t, tree in enumerate(upper):
                halves = half(fps[:, t // 2], t % 2)
                row, shard, _ = tree.route(halves, 0)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64) * trees + t), pa.array(halves[row].astype(np.int64))], ["shard", "half"])

    def split(key, table):  # no hints: PySpark would try to read them
        tree = Tree(np.sort(table.column("half").to_numpy().astype(np.uint32)), depth - top)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "shards": pa.array([tree.shards], pa.int32()), "point": [tree.point.tobytes()], "radius": [tree.radius.tobytes()], "kids": [tree.kids.tobytes()]})

    below: list[dict[int, Tree]] = [{} for _ in upper]
    for r in part.mapInArrow(placed, "shard long, half long").groupBy("shard").applyInArrow(split, "shard long, shards int, point binary, radius binary, kids binary").collect():
        tree = Tree(np.zeros(0, np.uint32), 0)
        tree.shards, tree.point, tree.radius, tree.kids = r["shards"], np.frombuffer(r["point"], np.uint32), np.frombuffer(r["radius"], np.int16), np.frombuffer(r["kids"], np.int32).reshape(-1, 2)
        below[r["shard"] % trees][r["shard"] // trees] = tree
    return [tree.grafted(b) for tree, b in zip(upper, below)]


def links(nodes: DataFrame, radius: int = 3, length: int = 1, reach: int | None = None, sample_rows: int = 16_384, shard_rows: int = 8_192, block_rows: int = 65_536, leaf_rows: int = 384, most_cut: int = 10_000) -> DataFrame:
    """Spanning links (a, b) between nodes (distinct node and fp) within radius. Of one word none is missed; see above for more."""
    spark, reach, count = nodes.sparkSession, max(1, radius // 2) if length == 1 else reach or 2, 2 * length
    sent = spark.sparkContext.broadcast(trees_of(nodes, nodes.count(), sample_rows, shard_rows, length))
    first = [f"w{i}" for i in range(min(TOLD, length))]

    def route(batches):
        trees = sent.value
        for batch in batches:
            node, fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(batch.column(1), length)
            for t, tree in enumerate(trees):
                halves = half(fps[:, t // 2], t % 2)
                row, shard, home = tree.route(halves, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[row]), pa.array(halves[row].astype(np.int64) * 2 + home), *(pa.array(fps[row, i].view(np.int64)) for i in range(len(first))), pa.array(shard.astype(np.int64) * count + t)],
                    ["node", "spot", *first, "shard"],
                )

    routed = nodes.select("node", "fp").mapInArrow(route, f"node long, spot long, {', '.join(f'{w} long' for w in first)}, shard long")
    kept = ["node", "spot", *first, "shard"]  # spot: the half, and in the lowest bit whether the shard is home


    def counted(batches):
        """Rows and candidates by shard, of a task's fingerprints."""
        trees, q, c = sent.value, Counter(), Counter()
        for batch in batches:
            fps = matrix(batch.column(0), length)
            for t, tree in enumerate(trees):
                _, shard, home = tree.route(half(fps[:, t // 2], t % 2), reach)
                for counter, of in ((q, shard), (c, shard[home])):
                    found, n = np.unique(of, return_counts=True)
                    counter.update(dict(zip((found.astype(np.int64) * count + t).tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(q), pa.int64()), pa.array(list(q.values()), pa.int64()), pa.array([c[s] for s in q], pa.int64())], ["shard", "q", "c"])

    sizes = nodes.select("fp").mapInArrow(counted, "shard long, q long, c long").groupBy("shard").agg(F.sum("q").alias("q"), F.sum("c").alias("c")).filter((F.col("q") > block_rows) & (F.col("c") > 0))
    cut = sizes.select("shard", F.ceil(F.col("q") / block_rows).cast("int").alias("qb"), F.ceil(F.col("c") / block_rows).cast("int").alias("cb"))
    if large := cut.limit(most_cut + 1).collect():
        if len(large) <= most_cut:
            cut = F.broadcast(spark.createDataFrame(large, cut.schema))
        own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n).cast("long")).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        blocks = routed.join(cut, "shard")
        queries = blocks.select(*kept, own("qb", 1).alias("i"), F.explode(every("cb")).alias("j"), F.lit(True).alias("query"), F.lit(False).alias("candidate"))
        candidates = blocks.filter("spot & 1 = 1").select(*kept, F.explode(every("qb")).alias("i"), own("cb", 2).alias("j"), F.lit(False).alias("query"), F.lit(True).alias("candidate"))
        blocked = queries.unionByName(candidates)
        routed = routed.join(cut.select("shard"), "shard", "left_anti").select(kept)

    def linked(key, table):  # no hints: PySpark would try to read them
        tree = key[0].as_py() % count
        nodes, at, place = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        spot = table.column("spot").to_numpy()
        query, candidate = np.ones(len(spot), bool), spot & 1 == 1  # every row is a query, those at home are candidates too
        if "query" in table.column_names:  # of a block, either
            query, candidate = (table.column(c).to_numpy(zero_copy_only=False) for c in ("query", "candidate"))
        halves = (spot[at] >> 1).astype(np.uint32)
        words = np.stack([table.column(w).to_numpy()[at].view(np.uint64) for w in first], 1)
        forest = Forest(len(nodes)) if length == 1 else Shortest(len(nodes))
        others = half(words[:, 0], 1 - tree) if length == 1 else None
        search(np.unique(place[query]), np.unique(place[candidate]), halves, reach, forest, leaf_rows, Nearness(words, halves, reach, radius, length), others)
        pairs = np.array(forest.pairs, np.int64).reshape(-1, 2) if length == 1 else forest.boiled()
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    found = routed.groupBy("shard").applyInArrow(linked, "a long, b long")
    if large:
        found = found.unionByName(blocked.groupBy("shard", "i", "j").applyInArrow(linked, "a long, b long"))
    if length == 1:
        return found
    found = checkpoint(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"))
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return found.join(side("a"), "a").join(side("b"), "b").filter(apart <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42, length: int = 1, similarity: float | None = None, **sizes) -> DataFrame:
    """A row for each row of docs: doc_id, node, fp (array of signed longs), component_id. With a similarity, documents
    are linked by the Jaccard similarity of their shingle sets, all that have it."""
    fps = checkpoint(fingerprints(docs, id_col, text_col, words, seed, length))
    nodes = fps.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("first_key"))
    linked = links(nodes, radius, length, **sizes)
    if similarity is not None:
        key = lambda c: nodes.select(F.col("node").alias(c), F.col("first_key").alias(f"key_{c}"))
        known = linked.join(key("a"), "a").join(key("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        same = fps.join(nodes.select("node", "first_key"), "node").select(F.col("key").alias("a"), F.col("first_key").alias("b"))
        label = similar_components(keyed(docs, text_col), words, similarity, known.unionByName(same))
        rooted = fps.join(label.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "node", "fp", F.coalesce("root", "key").alias("root"))
        return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "node", "fp", "component_id")
    label = components(linked)
    rooted = nodes.select("node", "first_id").join(label, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "node", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of each component the document with the smallest doc_id, and rows without a doc_id.

    Only rows whose id may be among those that go are shuffled."""
    found = checkpoint(near_duplicates(docs, id_col, text_col, **options).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("NOT stays").select(F.col("doc_id").alias("id")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    tested = maybe(rows, found, "id")
    out = tested.filter("NOT maybe OR id IS NULL").select("row").unionByName(tested.filter("maybe AND id IS NOT NULL").join(found, "id", "left_anti").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
