"""Exact top-k by inner product: branch and bound over ball trees, between shards and in every shard.

Placing. The upper part of one ball tree is split (along the direction between two
far points) on a bounded sample of vectors, ``sample_rows``; every vector descends it
to its shard, whose ball gets the sample's centre and the radius that all of the
shard's vectors need. Shards hold about ``shard_rows`` vectors; one that holds more
(many vectors alike, or a table beyond what the sample can split) is dealt by hash
to parts, each a shard with the same ball.

Search. In a shard a ball tree goes on. Its nodes are taken best first by the upper
bound q.c + |q| r of the inner products in a ball, from a heap that starts with the
root: a popped leaf is scored, a popped inner node gives its two children, and the
search ends when the best bound left is below the query's current k-th score. That
score is shared between shards: every query first searches the shard that it lies in
itself, and carries the k-th score found there to the others. Before that, the
same bound cuts whole shards: a query is sent only to those whose ball may hold a
score as high.

Queries travel in blocks of a bounded number, so a task holds one part's vectors
and one block of queries; each gives at most k rows a query, and the rows of a query
are merged by a window over the few rows that are left.

Scores are integer inner products of floor(scale * x), exact: float products where
sums stay below 2^53, Python integers beyond; a score outside of 64 bits is held
at the nearest long. Placing uses whole numbers only, so a task that runs again, on
whatever machine, sends the same rows to the same shards.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; vectors of different lengths are as if padded
with zeros; rows that repeat an id are candidates each, and a query for each
distinct vector; a row is no candidate for queries of its own id; ties go to the
smaller id; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled

EXACT = 2**53


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of longs as rows, padded with zeros."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    out = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = rows.flatten().to_numpy()
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in 64 bits."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    top = max(d, 1) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0))
    if top < EXACT:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def wide(v: np.ndarray, d: int) -> np.ndarray:
    """Rows cut or padded with zeros to d columns."""
    return v[:, :d] if v.shape[1] >= d else np.pad(v, ((0, 0), (0, d - v.shape[1])))


def far_direction(rows: np.ndarray) -> np.ndarray:
    """From one far point of the rows to another."""
    away = np.linalg.norm(rows - rows.mean(axis=0), axis=1)
    p = rows[int(away.argmax())]
    return rows[int(np.linalg.norm(rows - p, axis=1).argmax())] - p


class BallTree:
    """Balls over the rows of points: centres, radii, and each node's rows as a slice of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = 128):
        floats = points.astype(float)
        self.order = np.arange(len(points))
        self.slices: list[tuple[int, int]] = []
        self.kids: list[int] = []  # number of the first child, the second is the next; 0 for a leaf
        self.centres, self.radii = [], []
        todo = [(0, len(points))]
        while len(self.slices) < len(todo):
            a, b = todo[len(self.slices)]
            rows = floats[self.order[a:b]]
            centre = rows.mean(axis=0)
            self.centres.append(centre), self.radii.append(float(np.linalg.norm(rows - centre, axis=1).max(initial=0)))
            self.slices.append((a, b)), self.kids.append(0)
            if b - a > leaf_rows and self.radii[-1] > 0:
                self.order[a:b] = self.order[a:b][np.argsort(rows @ far_direction(rows), kind="stable")]
                self.kids[-1] = len(todo)
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def bounds(self, q: np.ndarray, norm: float, nodes: slice) -> np.ndarray:
        """Upper bounds of a query's inner products with all that is in the balls; the slack covers rounding."""
        found = self.centres[nodes] @ q + norm * self.radii[nodes]
        return found + 1e-9 * np.abs(found) + 1e-6


def search(tree: BallTree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query's row, id, score) of the k best of a shard for each query, without scores below the query's floor; and how many leaves were scored."""
    d = vectors.shape[1]
    queries = wide(queries, d)
    rows, names = vectors[tree.order], ids[tree.order]
    exact = max(d, 1) * float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) < EXACT
    floats = rows.astype(float) if exact else rows
    found, opened = [], 0
    for row, q in enumerate(queries.astype(float)):
        floor, best, norm = int(floors[row]), [], float(np.linalg.norm(q))
        heap = [(-float(tree.bounds(q, norm, slice(0, 1))[0]), 0)]
        while heap:
            bound, node = heappop(heap)
            if -bound < floor:
                break
            if kid := tree.kids[node]:
                for i, b in enumerate(tree.bounds(q, norm, slice(kid, kid + 2)).tolist()):
                    b = max(bound, -b)  # a ball's bound holds for what is inside it
                    if -b >= floor:
                        heappush(heap, (b, kid + i))
                continue
            opened += 1
            a, b = tree.slices[node]
            scores = floats[a:b] @ q if exact else products(queries[row : row + 1], rows[a:b])[0]
            take = np.flatnonzero((scores >= floor) & (names[a:b] != query_ids[row]))
            if len(take):
                best += zip((-scores[take].astype(np.int64)).tolist() if exact else [-int(x) for x in scores[take]], names[a:b][take].tolist())
                best.sort()
                del best[k:]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        found += [(row, i, -s) for s, i in best]
    return found, opened


class Places:
    """The upper part of the tree: planes that part the sample, and the centres of its leaves, the shards."""

    def __init__(self, sample: np.ndarray, shards: int, least: int = 16):
        self.planes: list[tuple[np.ndarray, int, int, int]] = []  # direction, threshold, what is up to it, what is beyond it
        self.centres: list[np.ndarray] = []
        self.root = self._split(sample, max(0, int(np.ceil(np.log2(max(1, shards))))), least)

    def _split(self, rows: np.ndarray, depth: int, least: int) -> int:
        """Number of a plane, or -1 - shard."""
        if depth and len(rows) >= 2 * least:
            direction = far_direction(rows.astype(float)).astype(np.int64)
            along = rows @ direction
            values = np.unique(along)
            if len(values) > 1:
                i = min(int(np.searchsorted(values, np.sort(along)[(len(along) - 1) // 2])), len(values) - 2)
                at = values[i] + (values[i + 1] - values[i]) // 2
                here = len(self.planes)
                self.planes.append(None)
                kids = [self._split(rows[side], depth - 1, least) for side in (along <= at, along > at)]
                self.planes[here] = (direction, int(at), *kids)
                return here
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        return -len(self.centres)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Shard of each row."""
        rows = wide(rows, len(self.centres[0]))
        out, todo = np.zeros(len(rows), np.int32), [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            direction, threshold, near, beyond = self.planes[node]
            side = rows[at] @ direction <= threshold
            todo += [(near, at[side]), (beyond, at[~side])]
        return out

    def away(self, rows: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Distance of each row from its shard's centre."""
        d = max(rows.shape[1], len(self.centres[0]))
        return np.linalg.norm(wide(rows, d) - wide(np.array(self.centres), d)[shard], axis=1)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, sample_rows: int = 16_384, shard_rows: int = 16_384, block_rows: int = 4_096, leaf_rows: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark, x = vectors.sparkSession, F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    # Doubles beyond a long are held at its ends by the cast.
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale).cast("double"), F.lit(-9.2e18)), F.lit(9.2e18)).cast("long"))
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    n = rows.count()
    sample = [r["v"] for r in sampled(rows, n, sample_rows, "id", "v").select("v").collect()]
    d = max(map(len, sample), default=0)
    points = np.array([v + [0] * (d - len(v)) for v in sample], np.int64).reshape(len(sample), d)
    places = Places(points, -(-n // shard_rows))

    def placed(batches):
        for batch in batches:
            found = matrix(batch.column(1))
            shard = places.place(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(places.away(found, shard))], ["id", "v", "shard", "away"])

    rows = rows.mapInArrow(placed, "id long, v array<long>, shard int, away double")
    # A row a shard; the sample bounds their number.
    balls = {r["shard"]: (r["radius"], r["n"]) for r in rows.groupBy("shard").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    parts = {s: max(1, -(-m // shard_rows)) for s, (_, m) in balls.items()}
    sizes = F.broadcast(spark.createDataFrame([(s, m) for s, m in parts.items()], "shard int, parts int"))
    own = F.pmod(F.xxhash64("id", "v"), F.col("parts").cast("long")).cast("int")
    rows = rows.join(sizes, "shard").select("id", "v", "shard", own.alias("part"))
    asks = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("shard").alias("qshard"), F.col("part").alias("qpart")).distinct()
    schema = "id long, v array<bigint>, rank int, other long, score long"

    def searched(key, mine, asked):
        out = {"id": [], "v": [], "rank": [], "other": [], "score": []}
        if len(asked) and len(mine):
            ids, points, queries = mine.column("id").to_numpy(), matrix(mine.column("v")), matrix(asked.column("qv"))
            floors = asked.column("floor").fill_null(-(2**63)).to_numpy()
            query_ids, lists = asked.column("qid").to_numpy(), asked.column("qv").to_pylist()
            rank: dict[int, int] = {}
            for row, other, score in search(BallTree(points, leaf_rows), ids, points, query_ids, queries, floors, k)[0]:
                rank[row] = rank.get(row, 0) + 1
                out["id"].append(query_ids[row]), out["v"].append(lists[row])
                out["rank"].append(rank[row]), out["other"].append(other), out["score"].append(score)
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("rank", pa.int32()), ("other", pa.int64()), ("score", pa.int64())]))

    first = asks.withColumn("floor", F.lit(None).cast("long"))
    found = near = rows.groupBy("shard", "part").cogroup(first.groupBy("qshard", "qpart")).applyInArrow(searched, schema)
    if sum(parts.values()) > 1:
        numbers = np.array(sorted(balls))
        centres, radii = np.array([places.centres[s] for s in numbers]), np.array([balls[s][0] for s in numbers])

        def sent(batches):
            """A query, for each shard whose ball may hold a score as high as its floor."""
            for batch in batches:
                queries = matrix(batch.column(1))
                floors = batch.column(4).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                dim = max(queries.shape[1], centres.shape[1])
                q = wide(queries, dim).astype(float)
                bound = q @ wide(centres, dim).T + np.linalg.norm(q, axis=1)[:, None] * radii[None, :]
                at, to = np.nonzero(bound + 1e-9 * np.abs(bound) + 1e-6 >= floors[:, None].astype(float))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(numbers[to].astype(np.int32))], ["qid", "qv", "qshard", "qpart", "floor", "shard"])

        floors = near.filter(F.col("rank") == k).select(F.col("id").alias("fid"), F.col("v").alias("fv"), F.col("score").alias("floor"))
        told = asks.join(floors, (F.col("qid") == F.col("fid")) & (F.col("qv") == F.col("fv")), "left").select("qid", "qv", "qshard", "qpart", "floor")
        others = told.mapInArrow(sent, "qid long, qv array<long>, qshard int, qpart int, floor long, shard int").join(sizes, "shard")
        others = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("NOT (shard = qshard AND part = qpart)")
        # A row a part; as many as shards and tables of shard_rows rows.
        many = others.groupBy("shard", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        to = others.join(many, ["shard", "part"]).withColumn("block", F.pmod(F.xxhash64("qid", "qv", F.lit(1)), F.col("blocks").cast("long")).cast("int"))
        to = to.select("qid", "qv", "floor", F.col("shard").alias("toshard"), F.col("part").alias("topart"), F.col("block").alias("toblock"))
        spread = rows.join(many, ["shard", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        far = spread.select("id", "v", "shard", "part", "block").groupBy("shard", "part", "block").cogroup(to.groupBy("toshard", "topart", "toblock")).applyInArrow(searched, schema)
        found = near.unionByName(far)
    order = Window.partitionBy("id", "v").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")
