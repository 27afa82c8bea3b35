"""Exact deduplication by progressive refinement.

Texts are equal when identical after lower-casing A-Z. Rows are grouped by byte
length, what shares a length by a hash of the text's beginning, and only the
texts of groups that survive both are read whole and hashed with SHA-256. Each
grouping is a partial aggregation of narrow rows, so a group that holds a third of
all rows reaches a task as one row for each map task.

Texts are hashed where they are scanned, they never move for it: which pairs of
length and prefix survived is told to all tasks by a bit map of fixed size
(``common.maybe``, broadcast). Its false hits, and a map that fills
up when there are very many pairs, cost hashing and nothing else: what counts as
equal is settled by the full hash alone. The same map, made of the groups that
have copies, lets ``exact_dedup`` pass all other rows on without a shuffle; the rows
in doubt move once, with their texts, to meet their group, in a join that adaptive
execution splits where a group is hot.

Defined results: a null text counts as empty; the row with the largest doc_id of
a group stays (null ids are smallest); of rows that repeat both doc_id and text,
``report`` marks each, ``exact_dedup`` keeps one. Very long texts are hashed in
place; no rows give no rows. The caller's columns travel inside one struct, so
their names can't clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, maybe

def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _sha(raw: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    # Never null, and said so: for a key that may be null Spark adds a filter to the scan that hashes every text.
    return F.coalesce(F.unhex(F.sha2(ascii_lower(raw).cast("binary"), 256)), F.lit(b""))


def _marked(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """row (struct of all columns), id, raw, len, prefix."""
    raw = _raw(text_col)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), raw.alias("raw"),
        F.octet_length(raw).alias("len"), F.xxhash64(ascii_lower(F.substring(raw, 1, prefix_chars))).alias("prefix"),
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """Groups of two or more equal texts: sha (32 bytes), len, prefix, keep_id, group_size, keep_rows (rows with keep_id)."""
    rows = _marked(docs, id_col, text_col, prefix_chars)
    narrow = rows.select("id", "len", "prefix")
    # Joined by an expression, so that both sides are exchanged for the join and a hot length can be split there.
    lengths = narrow.groupBy("len").count().filter("count > 1").select((F.col("len") * 2).alias("twice"))
    # One struct as key: so that a hot length is counted in every task that its rows are split over, not where the join put them.
    pair = F.struct("len", "prefix").alias("pair")
    prefixes = narrow.join(lengths, F.col("len") * 2 == F.col("twice"), "left_semi").select(pair).groupBy("pair").count().filter("count > 1").select("pair.len", "pair.prefix")
    whole = maybe(rows.select("id", "raw", "len", "prefix"), prefixes, "len", "prefix").filter("maybe").select("id", "len", "prefix", _sha(F.col("raw")).alias("sha"))
    by_id = whole.groupBy("sha", "id").agg(F.count("*").alias("n"), F.first("len").alias("len"), F.first("prefix").alias("prefix"))
    return (
        by_id.groupBy("sha")
        .agg(F.first("len").alias("len"), F.first("prefix").alias("prefix"), F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct(F.col("id"), F.col("n")))["n"].alias("keep_rows"))
        .filter("group_size > 1")
    )


def _apart(sha: Column) -> Column:
    """An expression of a digest to join by, so that both sides are exchanged for the join and a hot digest is split."""
    return F.concat(sha, F.lit(b"="))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (this column alone makes it hash every text)."""
    groups = duplicate_groups(docs, id_col, text_col).select(_apart(F.col("sha")).alias("key"), "keep_id", "group_size")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _sha(_raw(text_col)).alias("sha"))
    joined = rows.join(groups, _apart(F.col("sha")) == F.col("key"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    groups = checkpoint(duplicate_groups(docs, id_col, text_col, prefix_chars))
    tested = maybe(_marked(docs, id_col, text_col, prefix_chars), groups, "len", "prefix")
    alone = tested.filter("NOT maybe").select("row")
    doubtful = tested.filter("maybe").select("row", "id", _sha(F.col("raw")).alias("sha"))
    told = groups.select(_apart(F.col("sha")).alias("key"), "keep_id", "keep_rows")
    stays = doubtful.join(told, _apart(F.col("sha")) == F.col("key"), "left").filter(F.col("keep_rows").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    kept = [alone]
    if groups.filter("keep_rows > 1").isEmpty():
        kept.append(stays.select("row"))
    else:
        # Some kept document is there in several rows: one of them is enough.
        kept.append(stays.filter(F.coalesce("keep_rows", F.lit(1)) == 1).select("row"))
        kept.append(stays.filter("keep_rows > 1").groupBy("key").agg(F.first("row").alias("row")).select("row"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
