"""Queries opN_<name> over the driver's tables, and their SQL."""
from __future__ import annotations

import hashlib
import zlib
from array import array

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .common import checkpoint, read
from .exact_dedup import report
from .lm import score
from .mixing import CURRICULUM, inverse_sql, ordered
from .resampling import resample
from .rules import judge
from .runs import periodic_runs
from .sharding import shard
from .simhash import near_duplicates
from .topk import top_k
from .toxicity import classify
from .trie import prefix_trie, rebuilt, turns
from .warc import RECORD_COLUMNS, derive, responses


def op1_warc_derivatives(spark, sf_dir):
    return derive(responses(read(spark, sf_dir, "pages").select("page_id", "url", "html")), keep=["page"]).select("page.page_id", *RECORD_COLUMNS)


def op2_toxicity_chain(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("scores.low_quality").alias("p_low_quality"), F.col("scores.toxic").alias("p_toxic"), F.col("scores.is_toxic").alias("toxic"))


def op3_curriculum_mixing(spark, sf_dir):
    """Words taken of each document, how often it is read, and the training times of its first and last reading, in the order
    of the first."""
    planned = ordered(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return planned.select("row.doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("n_readings"), F.get("positions", F.lit(0)).alias("first_position"), F.get("positions", F.size("positions") - 1).alias("last_position"))


def op4_backoff_lm_scoring(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"))


def op5_minimax_sharding(spark, sf_dir):
    placed = shard(read(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_importance_resampling(spark, sf_dir):
    """As many rows are kept as the labels say are of good quality, drawn towards the text of good quality."""
    labels = read(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return resample(read(spark, sf_dir, "documents"), labels.filter("quality = 1"), share=share or 0.0)


class Digest:
    """Digests of a text's ids and of their decoding, piece by piece. Besides the joined tokens that the tokenizer file
    (without a decoder) gives, ids go through the byte-to-text machine."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.n, self.of_ids, self.of_text, self.of_bytes = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.machine = bpe.Decoder(vocabulary)

    def ids(self, raw: bytes) -> None:
        self.n += len(raw) // 4
        self.of_ids.update(raw)
        ids = array("I")
        ids.frombytes(raw)
        for at in range(0, len(ids), 8192):
            self.of_bytes.update(self.machine.feed(ids[at : at + 8192]).encode())

    def text(self, text: str) -> None:
        self.of_text.update(text.encode())

    def result(self):
        self.of_bytes.update(self.machine.finish().encode())
        return self.n, self.of_ids.hexdigest(), self.of_text.hexdigest(), self.of_bytes.hexdigest()


def op7_bpe_encode_decode(spark, sf_dir, path=None):
    """bytes_sha256: of the text that the byte-to-text machine makes of the ids, each word with a space after it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_sha256 string"
    return bpe.transcode(docs, path or public_tokenizers.path("word_bpe_49k.json"), Digest, columns, keep=["doc_id"], joined=True)


def op8_exact_dedup(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))


def op9_ball_tree_top_k(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def repeat_tail(words, doc_id):
    """Words of a document, of one in ten with a periodic tail (never of one without an id)."""
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or doc_id is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(read(spark, sf_dir, "documents"), keep=["doc_id"], rewrite=repeat_tail, rewrite_by="doc_id")
    # Of equal exponents the first: runs come by start, then period.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(rebuilt(checkpoint(turns(read(spark, sf_dir, "conversations")))))


def op13_quality_rules(spark, sf_dir):
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(read(spark, sf_dir, "documents"), measures=measures, keep=["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *measures, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_toxicity_chain, op3_curriculum_mixing, op4_backoff_lm_scoring, op5_minimax_sharding, op6_importance_resampling, op7_bpe_encode_decode, op8_exact_dedup, op9_ball_tree_top_k, op10_simhash_near_dedup, op11_periodic_runs, op12_conversation_trie, op13_quality_rules)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"[^\x20\x09-\x0D]+"


#: CRC-32 of a number's decimal text.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"


def _position(part: str) -> str:
    return "CASE i % 3 " + " ".join(f"WHEN {i} THEN {inverse_sql(s, part)}" for i, s in enumerate(CURRICULUM)) + " END"


ORACLE_SQL = {
    "op11_periodic_runs": f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n, {CRC.format("doc_id")} AS h
          FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents)),
        a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, (h // 10) % 8 AS e FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM a),
        t AS (SELECT r, doc_id, n, CASE WHEN a < n THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
        x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
        q AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q),
        s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        u AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
        l AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
        -- Each run's rank by length / period, in whole numbers.
        b AS (SELECT r, start, length, period, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM u),
        o AS (SELECT r, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM u GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
        FROM t LEFT JOIN l USING (r) LEFT JOIN o USING (r) LEFT JOIN b ON b.r = t.r AND b.k = 1""",
    "op12_conversation_trie": f"""
        WITH t AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL),
        z AS (SELECT c, count(*) AS n, {CRC.format("c")} % 9 AS h FROM t GROUP BY c),
        p AS (SELECT z.c, z.n, z.h, z.c - z.c % 5 AS base, least(z.h, coalesce(f.n, 0)) AS taken FROM z LEFT JOIN z f ON f.c = z.c - z.c % 5),
        r AS (
          SELECT p.c, i + 1 AS d, role, text FROM p JOIN t ON t.c = p.base AND i < p.h
          UNION ALL SELECT p.c, i - p.h + taken + 1, role, text FROM p JOIN t ON t.c = p.c AND i >= p.h
          UNION ALL SELECT c, 0, '', '' FROM p),
        m AS (
          SELECT c, d, strlen(text) AS bytes, string_agg(sha256(concat(strlen(role), ':', role, text)), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS raw, max(d) OVER (PARTITION BY c) AS last FROM r),
        k AS (SELECT c, d, bytes, last, sha256(raw) AS key, lag(sha256(raw)) OVER (PARTITION BY c ORDER BY d) AS up FROM m),
        n AS (
          SELECT key, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS members, any_value(bytes) AS bytes,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends
          FROM k GROUP BY key),
        x AS (SELECT n.*, u.c AS parent, (SELECT count(*) FROM n v WHERE v.up = n.key) AS children FROM n LEFT JOIN n u ON u.key = n.up),
        -- Each node is in the subtrees of the nodes on the way to it of its least member.
        s AS (
          SELECT k.key, CAST(sum(CAST(x.children = 0 AS BIGINT)) AS BIGINT) AS leaves, CAST(sum((x.members - 1) * x.bytes) AS BIGINT) AS saved
          FROM x JOIN k ON k.c = x.c AND k.d <= x.d GROUP BY k.key)
        SELECT x.c AS conv_id, x.d AS depth, x.parent AS parent_conv_id, x.members AS n_convs, x.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, x.ends AS ends_sha256
        FROM x JOIN s ON s.key = x.key""",
    "op13_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM d),
        m AS (
          SELECT r, doc_id, w, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols, len(l) AS lines, len(l) - len(list_distinct(l)) AS dups,
                 len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS lettered,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
                 len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS ellipses,
                 len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•‣▪◦–]'))) AS bullets
          FROM w),
        i AS (SELECT r, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c, unnest(range(len(w) - 2)) AS i FROM m WHERE n >= 3),
        g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM i),
        p AS (SELECT r, count(DISTINCT i + j) AS repeated FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY r),
        e AS (SELECT r, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM m WHERE n >= 2),
        f AS (SELECT r, max(k) AS top FROM (SELECT r, count(*) AS k FROM e GROUP BY r, a, b) GROUP BY r),
        q AS (SELECT m.*, coalesce(repeated, 0) AS repeated, coalesce(top, 0) AS top FROM m LEFT JOIN p USING (r) LEFT JOIN f USING (r))
        SELECT doc_id, n AS n_words, CAST(chars AS BIGINT) AS word_chars, symbols AS n_symbols, dups AS n_dup_lines, repeated AS n_repeat_words,
               n < 50 OR 100 * repeated > 50 * n AS base_failed,
               NOT (n < 50 OR 100 * repeated > 50 * n OR chars < 3 * n OR chars > 10 * n OR 10 * symbols > n OR 5 * lettered < 4 * n OR 10 * dups > 3 * lines
                    OR 2 * capitals > letters OR 10 * ellipses > 3 * lines OR 10 * bullets > 9 * lines OR 10 * top > n) AS kept
        FROM q""",
    "op3_curriculum_mixing": f"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS size,
                 CAST('0x' || substr(md5(concat_ws(chr(31), doc_id, text, lang, source, n_chars)), 1, 15) AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
        w AS (SELECT *, CAST(1 + i % 3 AS DOUBLE) AS w, 3e0 * n / (1 + i % 3) AS ratio FROM s),
        f AS (
          SELECT *, sum(3e0 * n) OVER o AS capped, sum(w) OVER () - sum(w) OVER o AS left_w, row_number() OVER o AS k, lead(ratio) OVER o AS next_ratio, sum(n) OVER () AS total, sum(w) OVER () AS all_w, min(ratio) OVER () AS least
          FROM w WINDOW o AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        -- The number of sources that stop at three times their size, and what a weight of one gets of the rest.
        c AS (
          SELECT k, (total - capped) / left_w AS per, next_ratio AS beyond FROM f WHERE left_w > 0
          UNION ALL SELECT 0, CAST(total AS DOUBLE) / all_w, least FROM f WHERE k = 1
          UNION ALL SELECT k, 0e0, NULL FROM f WHERE left_w <= 0),
        b AS (SELECT k, per FROM c WHERE beyond IS NULL OR beyond > per ORDER BY k LIMIT 1),
        t AS (SELECT source, n, i, CASE WHEN f.k <= b.k THEN 3e0 * n ELSE b.per * w END AS target FROM f, b),
        p AS (
          SELECT d.doc_id, d.size, t.n, t.i, t.target, CAST(round_even(t.target, 0) AS BIGINT) AS demand,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, CASE WHEN n > 0 THEN demand // n ELSE 0 END AS whole FROM p),
        r AS (SELECT *, greatest(least(demand - whole * n - start, size), 0) AS part FROM q),
        e AS (SELECT *, CAST(whole + CAST(part > 0 AS INT) AS INT) AS n_readings FROM r)
        SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(whole * size + part AS BIGINT) AS taken, n_readings,
               CASE WHEN n_readings > 0 THEN {_position("CAST(start AS DOUBLE) / demand")} END AS first_position,
               CASE WHEN n_readings > 0 THEN {_position("CAST((n_readings - 1) * n + start AS DOUBLE) / demand")} END AS last_position
        FROM e""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op9_ball_tree_top_k": """
        WITH e AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
