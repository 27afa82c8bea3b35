"""Prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns. Its key is a sum over its turns of
128-bit hashes of the turn (SHA-256 of role and text) and its place: sums can be
taken piece by piece, so a conversation of any length is cut into blocks of
``BLOCK`` turns whose sums are carried over, and no task needs one whole
conversation. Texts are read once, by the scan that hashes them.

1. Each partition combines its rows to a partial trie: a table of nodes with
   members, least member and the conversations that end there.
2. Partial tries are merged as a tree, by ``fan_in`` partitions at a time, keyed by
   the node's hash: members add up, ends are joined to sorted lists of bounded
   length (a node and ``SPAN`` ids a list). A node that all conversations share comes
   as one row from each partition, and never as more than ``fan_in`` to one task.
3. The rollup goes bottom-up along chains. Every conversation has a random rank,
   and a node belongs to the chain of its member of highest rank. A chain is a
   path that goes down to an end, as members only become fewer on the way down;
   a path from the root meets some log n of them, however deep the trie. Sums of
   whole chains are handed up from chain to chain, then each chain is summed from
   its end in blocks. So the rounds follow the logarithm of the conversations, not the depth.

Defined results: rows without an id belong to no conversation; a null role or text
is empty; turns are ordered by number, null first, turns of the same number by the
hash of role and text; repeated rows are turns of their own; a conversation's ends
are hashed as a stream of lists, so a node where very many end needs no more memory
than others; no rows give no nodes. Only the columns named are read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

BLOCK = 256
SPAN = 4096
LANES = ("s0", "s1", "s2", "s3")


def _running(rows: DataFrame, group: str, block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows and running sums (their own row included) within groups in the given order, in two levels. ``block`` must not
    fall along the order."""
    rows = rows.withColumn("block", block)
    totals = rows.groupBy(group, "block").agg(*[F.sum(c).alias(f"{n}_total") for n, c in sums.items()])
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("of"), F.col("block").alias("at"), *[F.coalesce(F.sum(f"{n}_total").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    within = Window.partitionBy(group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    joined = summed.join(totals, (F.col(group) == F.col("of")) & (F.col("block") == F.col("at")))
    return joined.select(*[c for c in rows.columns if c != "block"], *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums])


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (from 0), said (hash of role and text), n_bytes (of the text)."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("said"), F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter("conv IS NOT NULL")
    # A block holds a stretch of turn numbers; nulls are in the first, and first in it.
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**63)))
    counted = _running(rows, "conv", block, [F.col("turn").asc_nulls_first(), "said"], {"n": F.lit(1)})
    return counted.select("conv", (F.col("n") - 1).alias("place"), "said", "n_bytes")


def rebuilt(rows: DataFrame, families: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin alike: each takes its first h turns from the first of its family (the id less its remainder by
    ``families``), h being CRC-32 of the decimal id mod ``most``, and goes on with its own turns after its first h.
    rows as of ``turns``; returns conv, depth (from 1), said, n_bytes, ends (the last turn), and a row of depth 0 for each."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    own = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % families).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    first = sizes.filter(F.col("conv") % families == 0).select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    joined = own.join(first, F.col("base") == F.col("first"), "left")
    plan = joined.select("conv", "base", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    heads = rows.filter((F.col("conv") % families == 0) & (F.col("place") < most - 1)).select(F.col("conv").alias("of"), "place", "said", "n_bytes")
    lent = plan.join(heads, (F.col("base") == F.col("of")) & (F.col("place") < F.col("h"))).select("conv", (F.col("place") + 1).alias("depth"), "said", "n_bytes", (F.col("place") + 1 == F.col("taken") + F.col("own")).alias("ends"))
    told = plan.select(F.col("conv").alias("who"), "h", "taken", "own")
    kept = rows.join(told, (F.col("conv") == F.col("who")) & (F.col("place") >= F.col("h"))).select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "said", "n_bytes", (F.col("place") - F.col("h") + 1 == F.col("own")).alias("ends"))
    roots = plan.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("said"), F.lit(0).cast("long").alias("n_bytes"), (F.col("taken") + F.col("own") == 0).alias("ends"))
    return lent.unionByName(kept).unionByName(roots)


def whole(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``rebuilt``."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    kept = rows.join(sizes.select(F.col("conv").alias("who"), "n"), F.col("conv") == F.col("who")).select("conv", (F.col("place") + 1).alias("depth"), "said", "n_bytes", (F.col("place") + 1 == F.col("n")).alias("ends"))
    return kept.unionByName(sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("said"), F.lit(0).cast("long").alias("n_bytes"), F.lit(False).alias("ends")))


def _keyed(rows: DataFrame) -> DataFrame:
    """conv, depth, a and b (the node's key), up_a and up_b (its parent's), rank (of conv, no two alike), n_bytes, ends."""
    for k, h in enumerate((F.xxhash64("said", "depth"), F.xxhash64("depth", "said", F.lit(7)))):
        h = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(h)
        rows = rows.withColumn(f"h{2 * k}", h.bitwiseAND(0xFFFFFFFF)).withColumn(f"h{2 * k + 1}", F.shiftrightunsigned(h, 32))
    summed = _running(rows, "conv", F.floor(F.col("depth") / BLOCK), ["depth"], {s: F.col(f"h{i}") for i, s in enumerate(LANES)})
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)
    pack = lambda x, y: F.shiftleft(low(x), 32).bitwiseOR(low(y))
    s, before = [F.col(x) for x in LANES], [F.col(x) - F.col(f"h{i}") for i, x in enumerate(LANES)]
    return summed.select("conv", "depth", pack(s[0], s[1]).alias("a"), pack(s[2], s[3]).alias("b"), pack(before[0], before[1]).alias("up_a"), pack(before[2], before[3]).alias("up_b"), F.xxhash64("conv").alias("rank"), "n_bytes", "ends")


def _partial(batches, most_rows: int = 1 << 18):
    """Combines a partition's rows, so many at a time, to node tables; a node's ends come as lists of ids of one span each."""

    def combined(held):
        t = pa.Table.from_batches(held)
        g = t.group_by(["a", "b"]).aggregate([("conv", "count"), ("conv", "min"), ("rank", "max"), ("depth", "min"), ("up_a", "min"), ("up_b", "min"), ("n_bytes", "min")])
        ends: dict[tuple, list[int]] = {}
        for a, b, conv in zip(*[t.filter(t.column("ends")).column(c).to_pylist() for c in ("a", "b", "conv")]):
            ends.setdefault((a, b, conv // SPAN), []).append(conv)
        none = pa.nulls(len(g))
        yield pa.RecordBatch.from_arrays([*(g.column(c).combine_chunks() for c in ("a", "b", "conv_count", "conv_min", "rank_max", "depth_min", "up_a_min", "up_b_min", "n_bytes_min")), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], NAMES)
        if ends:
            keys = list(ends)
            fill = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *[fill] * 7, pa.array([k[2] for k in keys]), pa.array([sorted(x) for x in ends.values()], pa.list_(pa.int64()))], NAMES)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most_rows:
            yield from combined(held)
            held, n = [], 0
    if n:
        yield from combined(held)


NAMES = ["a", "b", "members", "conv", "rank", "depth", "up_a", "up_b", "n_bytes", "span", "ids"]
TABLE = "a long, b long, members long, conv long, rank long, depth long, up_a long, up_b long, n_bytes long, span long, ids array<long>"


def merged(rows: DataFrame, fan_in: int = 256) -> tuple[DataFrame, DataFrame]:
    """Node table and lists of ends of all partitions' partial tries."""
    parts = checkpoint(rows.mapInArrow(_partial, TABLE).withColumn("part", F.spark_partition_id()))
    n = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    nodes, ends = parts.filter("span IS NULL"), parts.filter("span IS NOT NULL")
    while True:
        n = -(-n // fan_in)
        group = F.floor(F.col("part") / fan_in).alias("part")
        nodes = nodes.groupBy("a", "b", group).agg(F.sum("members").alias("members"), F.min("conv").alias("conv"), F.max("rank").alias("rank"), *[F.min(c).alias(c) for c in ("depth", "up_a", "up_b", "n_bytes")])
        ends = ends.groupBy("a", "b", "span", group).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
        if n == 1:
            return nodes.drop("part"), ends.drop("part")


def _digests(batches):
    """SHA-256 of each node's ids, comma-joined, from lists that come sorted by node and span."""
    last, running = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "ids")]):
            text = ",".join(map(str, ids)).encode()
            if (a, b) == last:
                running.update(b"," + text)
                continue
            if last:
                out.append((*last, running.hexdigest()))
            last, running = (a, b), hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["end_a", "end_b", "ends_sha256"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([running.hexdigest()])], ["end_a", "end_b", "ends_sha256"])


def prefix_trie(rows: DataFrame, fan_in: int = 256) -> DataFrame:
    """rows as of ``rebuilt`` or ``whole``. A row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of turns that a cache of the trie saves: of each node of the subtree, its own included,
    members less one times bytes of its turn) and ends_sha256."""
    spark = rows.sparkSession
    nodes, lists = merged(_keyed(rows), fan_in)
    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("child_a"), F.col("up_b").alias("child_b")).agg(F.count("*").alias("n_children"))
    # Children meet their parent by an expression, so that both sides are exchanged for the join and a hot parent is split.
    node = F.struct("a", "b").alias("node")
    nodes = checkpoint(nodes.join(children, (F.col("a") == F.col("child_a")) & (F.col("b") == F.col("child_b")), "left").select(node, F.struct("up_a", "up_b").alias("up"), "depth", "conv", "rank", "members", "n_bytes", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))
    above = nodes.filter("n_children > 0").select(F.col("node").alias("above"), F.col("depth").alias("above_depth"), F.col("conv").alias("up_conv"), F.col("rank").alias("up_rank"))
    root = F.broadcast(above.filter("above_depth = 0"))  # one row
    tops = nodes.filter("depth = 1").join(root, F.col("up") == F.col("above")).drop("above", "above_depth")
    others = nodes.filter("depth > 1").join(above.filter("above_depth > 0"), F.col("up") == F.col("above")).drop("above", "above_depth")
    none = nodes.filter("depth = 0").withColumns({"up_conv": F.lit(None).cast("long"), "up_rank": F.lit(None).cast("long")})
    own = checkpoint(
        tops.unionByName(others).unionByName(none)
        .withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("members") - 1) * F.col("n_bytes")})
        .select("node", "depth", "conv", "up_conv", "rank", "up_rank", "members", "n_children", "leaf", "saved")
    )
    # Chains, and the place in another chain that each hangs from.
    hangs = checkpoint(own.filter("up_rank <> rank").select(F.col("rank").alias("chain"), F.col("up_rank").alias("at_chain"), (F.col("depth") - 1).alias("at_depth")))
    given = own.groupBy(F.col("rank").alias("to")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    handed = []
    while True:
        up = given.join(hangs, F.col("to") == F.col("chain")).groupBy("at_chain", "at_depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        up = checkpoint(up)
        if up.isEmpty():
            break
        handed.append(up)
        given = up.groupBy(F.col("at_chain").alias("to")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    zero = F.lit(0).cast("long")
    rolled = own
    if handed:
        more = handed[0]
        for up in handed[1:]:
            more = more.unionByName(up)
        more = more.groupBy("at_chain", "at_depth").agg(F.sum("leaf").alias("leaf_below"), F.sum("saved").alias("saved_below"))
        rolled = own.join(more, (F.col("rank") == F.col("at_chain")) & (F.col("depth") == F.col("at_depth")), "left")
        rolled = rolled.withColumns({"leaf": F.col("leaf") + F.coalesce("leaf_below", zero), "saved": F.col("saved") + F.coalesce("saved_below", zero)}).select(*own.columns)
    summed = _running(rolled, "rank", -F.floor(F.col("depth") / BLOCK), [F.col("depth").desc()], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    spread = lists.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "span")
    digests = spread.mapInArrow(_digests, "end_a long, end_b long, ends_sha256 string")
    told = summed.join(digests, (F.col("node.a") == F.col("end_a")) & (F.col("node.b") == F.col("end_b")), "left")
    return told.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

