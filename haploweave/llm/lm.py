"""Language-model scoring with a weighted backoff automaton.

Model. n-grams of order 1..N over words and one end token a text. The unigram is
add-one over training tokens with one more slot for unseen words; higher orders
are smoothed by a prior on the next lower order that is worth K(h) observations,
    p(w|h) = (c(hw) + K(h) p(w|h')) / (c(h) + K(h)),  K(h) = prior + share r c(h),
so all probabilities of a history sum to one, whatever K. r is the part of the
order's n-grams in training that are new when they occur (distinct over all): where
histories are followed by ever new words it is near one and a frequent history does
not trust its own counts too much; as n-grams repeat, with more or more regular
text, it falls, and the counts get the weight.

As an automaton: each history seen in training is a state, each seen n-gram an arc
from its history's state with weight log10 p(w|h) to the state of its longest
suffix that is one, and a state's failure arc to its shortened history weighs
log10(K(h) / (c(h) + K(h))); a word without an arc takes failure arcs until it has
one (the root has one for every word). A text is read once from left to right,
carrying its state and adding up the weights.

Distribution. Texts are dealt to blocks by a hash of id and text. A block counts
its own n-grams once (64-bit keys, sorted, sent as differences), and sends each
slice of the key space to the shard that owns it as one packed row; a shard adds the
counts up and sends each block just the counts of the keys it asked for, in its
order; a block then builds, batch of texts by batch, the part of the automaton that
the batch can reach (states, arcs, failure arcs), and traverses it. Every n-gram of the whole corpus is counted,
none is capped or dropped, and no model has to fit into one machine: blocks and
shards are as many as the session has shuffle partitions, so a task's memory is
set by that number. A frequent n-gram costs one entry a block.

Keys of different n-grams could meet only by a collision of 64-bit hashes: 5e-20 a
pair, so for a billion distinct n-grams one in forty that any two meet.

Defined results: null texts are empty texts (the end token only); a null id is
hashed like an empty string; with no training rows N = V = 0 and all is uniform
on the one unseen slot; repeated rows are scored and counted each. Further
columns of the input are not used, whatever their names.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, even_labels, partitions, words_of

END, START = np.uint64(xxhash.xxh64_intdigest(b" end ", 1)), np.uint64(xxhash.xxh64_intdigest(b" start ", 1))


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram of a context's key and a word's key."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(n: np.ndarray) -> bytes:
    """Counts as a byte each, those of 255 and more apart, with their places; compressed."""
    large = np.flatnonzero(n >= 255)
    raw = np.int64(len(large)).tobytes() + large.astype(np.int64).tobytes() + n[large].astype(np.int64).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    n = np.frombuffer(raw, np.uint8, offset=8 + 16 * k).astype(np.int64)
    n[np.frombuffer(raw, np.int64, k, 8)] = np.frombuffer(raw, np.int64, k, 8 + 8 * k)
    return n


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys: the first, the width of the largest step in bytes, the steps byte by byte. The topmost bytes are small
    numbers and compressed; the others are noise."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return keys[:1].tobytes() + bytes([width]) + planes[:, : width - 1].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[:, width - 1].tobytes())


def unpack_keys(packed: bytes, n: int) -> np.ndarray:
    """The n keys that were packed."""
    if not n:
        return np.zeros(0, np.uint64)
    width, end = packed[8], 9 + (n - 1) * (packed[8] - 1)
    planes = np.zeros((n - 1, 8), np.uint8)
    planes[:, : width - 1] = np.frombuffer(packed, np.uint8, end - 9, 9).reshape(n - 1, width - 1)
    planes[:, width - 1] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[end:]), np.uint8)
    out = np.empty(n, np.uint64)
    out[0], out[1:] = np.frombuffer(packed, np.uint64, 1)[0], planes.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64)


class Words(dict):
    """Word to its 64-bit key, remembered while a block is read."""

    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxhash.xxh64_intdigest(word, 0)
        return key


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's words and then the end; where each text starts."""
    keys, parts, sizes = Words(), [], []
    for raw in texts:
        w = words_of(raw)
        sizes.append(len(w) + 1)
        parts.append(np.fromiter(map(keys.__getitem__, w), np.uint64, len(w)))
        parts.append(np.array([END]))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), starts.astype(np.int64)


def ngrams_of(tokens: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order k: the key of the k-gram that ends at each token, and whether there is one (its history reaches back to the start mark at most)."""
    at = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))  # place within the text
    yield tokens, np.ones(len(tokens), bool)
    # Key of the history of k - 1 tokens that precedes each token.
    context = np.where(at > 0, np.concatenate([[START], tokens[:-1]]), START) if len(tokens) else tokens
    for k in range(2, order + 1):
        grams = mix(context, tokens)
        yield grams, at >= k - 2
        # The history of k tokens is the k-gram that ends at the token before.
        context = np.concatenate([[np.uint64(0)], grams[:-1]]) if len(grams) else grams


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where in it each distinct key begins."""
    order = np.argsort(keys)
    rising = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]])) if len(keys) else order


class Automaton:
    """The part of the model that a batch of texts can reach: its states, and the arcs and failure arcs that lead on in some text.

    ``arcs`` gives the number of the arc of state * words + word, ``weight`` and ``target`` what is on the arc of a number;
    ``failures`` the number of a state's failure arc, ``failure`` and ``shorter`` its weight and target. State 0 is the
    root, 1 the start of a text; n-grams are known by their numbers in the block."""

    def __init__(self, numbers: list[np.ndarray], distinct: list[int], first: np.ndarray, counts: list[np.ndarray], weights: list[np.ndarray], ends: float, heavy: list):
        """numbers, counts, weights: by order, of the n-gram that ends at each token; distinct: how many a block has of
        each order; first: whether a token begins a text; heavy: by order, K(h) of a history's count."""
        order, n = len(counts), len(first)
        self.words = distinct[0]
        below = [2 + sum(distinct[:j]) for j in range(order)]  # numbers of states of shorter histories
        # By order, the state of the history that ends at each token, and of the one before the token (0 if it is none).
        state = [np.zeros(n, np.int64)] + [np.where(counts[j] > 0, numbers[j] + below[j], 0) for j in range(order - 1)]
        self.start = int(order > 1 and ends > 0)
        before = [np.where(first, self.start if j == 1 else 0, np.concatenate([[0], x[:-1]])) for j, x in enumerate(state)]
        # An arc of the longest history that has one; every longer history that is a state fails.
        longest = np.ones(n, np.int8)
        for k in range(2, order + 1):
            longest[counts[k - 1] > 0] = k
        keys, found, targets, fails, loss, to = [], [], [], [], [], []
        for k in range(1, order + 1):
            at = np.flatnonzero(longest == k)
            keys.append(before[k - 1][at] * self.words + numbers[0][at])
            found.append(weights[k - 1][at])
            targets.append(state[min(k, order - 1)][at])
            if k < order:
                at = np.flatnonzero((before[k] > 0) & (longest <= k))
                c = np.where(first[at], ends, counts[k - 1][at - 1])
                h = heavy[k](c)
                fails.append(before[k][at]), loss.append(np.log10(h / (c + h))), to.append(before[k - 1][at])
        keys = np.concatenate(keys).tolist()
        self.arcs = dict(zip(keys, range(n)))
        self.weight, self.target = memoryview(np.concatenate(found)), memoryview(np.concatenate(targets))
        fails = np.concatenate(fails).tolist() if fails else []
        self.failures = dict(zip(fails, range(len(fails))))
        self.failure, self.shorter = (memoryview(np.concatenate(x) if x else np.zeros(0)) for x in (loss, to))

    def traverse(self, words: list[int]) -> float:
        """Weight of the path of a text, read once from left to right."""
        arc, width, weight, target = self.arcs.get, self.words, self.weight, self.target
        state, total = self.start, 0.0
        for word in words:
            taken = arc(state * width + word)
            while taken is None:
                fails = self.failures[state]
                total += self.failure[fails]
                state = self.shorter[fails]
                taken = arc(state * width + word)
            total += weight[taken]
            state = target[taken]
        return total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, prior: float = 4.0, share: float = 2.0, modulus: int = 7, remainder: int = 2, at_once: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs. at_once: tokens of a batch
    of texts (a longer text is a batch of its own)."""
    blocks = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    labels = even_labels(docs.sparkSession, blocks)  # of blocks, and of shards
    number = F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)).cast("int")
    block = F.get(F.array(*[F.lit(x) for x in labels]), number) if labels != list(range(blocks)) else number
    rows = rows.withColumn("block", block).repartition(blocks, "block")

    def counted(key, table):
        """A block's distinct n-grams, by shard, with their training counts."""
        block = key[0].as_py()
        ids, texts = table.column("id").to_pylist(), as_binary(table.column("raw").combine_chunks()).to_pylist()
        tokens, starts = tokens_of(texts)
        del texts, table
        trained = np.repeat(np.array([not held_out(i, modulus, remainder) for i in ids], np.int64), np.diff(starts))
        found = {"block": [], "shard": [], "order": [], "size": [], "keys": [], "counts": []}
        edges = np.array([s * 2**64 // blocks for s in range(blocks)], np.uint64)
        for k, (grams, there) in enumerate(ngrams_of(tokens, starts, order), 1):
            grams = grams[there]
            by_key, begin = grouped(grams)
            keys = grams[by_key[begin]]
            n = np.add.reduceat(trained[there][by_key], begin)
            cut = [*np.searchsorted(keys, edges).tolist(), len(keys)]
            for s in range(blocks):
                found["block"].append(block), found["shard"].append(labels[s]), found["order"].append(k), found["size"].append(cut[s + 1] - cut[s])
                found["keys"].append(pack_keys(keys[cut[s] : cut[s + 1]])), found["counts"].append(pack(n[cut[s] : cut[s + 1]]))
        return pa.table(found, schema=asked)

    def summed(key, table):
        """A shard's totals, sent back to each block in the order of its keys; with them the shard's share of N and V of each order."""
        back = {"block": [], "shard": [], "order": [], "counts": [], "n": [], "v": []}
        sent = table.to_pydict()
        for k in range(1, order + 1):
            mine = [i for i, o in enumerate(sent["order"]) if o == k]
            by_key, begin = grouped(np.concatenate([unpack_keys(sent["keys"][i], sent["size"][i]) for i in mine]))
            counts = np.concatenate([unpack(sent["counts"][i]) for i in mine])
            total = np.add.reduceat(counts[by_key], begin) if len(begin) else counts
            each = np.empty(len(counts), np.int64)
            each[by_key] = np.repeat(total, np.diff(np.append(begin, len(counts))))
            at = 0
            for i in mine:
                back["block"].append(sent["block"][i]), back["shard"].append(sent["shard"][i]), back["order"].append(k)
                back["counts"].append(pack(each[at : at + sent["size"][i]]))
                at += sent["size"][i]
                back["n"].append(int(total.sum())), back["v"].append(int((total > 0).sum()))
        return pa.table(back, schema=answered)

    def scored(key, texts, answers):
        """Builds and traverses a block's part of the automaton."""
        ids, raws = texts.column("id").to_pylist(), as_binary(texts.column("raw").combine_chunks()).to_pylist()
        if not ids:
            return pa.table({f.name: pa.array([], f.type) for f in result}, schema=result)
        tokens, starts = tokens_of(raws)
        del raws, texts
        told = answers.to_pydict()
        place = {x: s for s, x in enumerate(labels)}
        told["slices"] = sorted(range(answers.num_rows), key=lambda i: (told["order"][i], place[told["shard"][i]]))
        total, distinct = ([sum(x for x, o in zip(told[c], told["order"]) if o == k) for k in range(1, order + 1)] for c in "nv")
        counts, numbers, kinds = [], [], []
        for k, (g, there) in enumerate(ngrams_of(tokens, starts, order), 1):
            by_key, begin = grouped(g[there])
            kinds.append(len(begin))
            known = np.concatenate([unpack(told["counts"][i]) for i in told["slices"] if told["order"][i] == k])
            kind = np.int32 if known.max(initial=0) < 2**31 else np.int64
            each = np.empty(len(by_key), kind)
            sizes = np.diff(np.append(begin, len(by_key)))
            each[by_key] = np.repeat(known.astype(kind), sizes)
            counts.append(np.zeros(len(g), kind))
            counts[-1][there] = each
            if k < max(2, order):  # of the longest no more than the count is needed
                place_of = np.empty(len(by_key), np.int32 if len(begin) < 2**31 else np.int64)
                place_of[by_key] = np.repeat(np.arange(len(begin)), sizes)
                numbers.append(np.zeros(len(g), place_of.dtype))
                numbers[-1][there] = place_of
        del told, answers, by_key, begin, each, sizes, place_of
        first = np.zeros(len(tokens), bool)
        first[starts[:-1]] = True
        # Each text has one end, so its count is that of training texts and of the start mark as a history.
        ends = float(counts[0][starts[1] - 1])
        heavy = [lambda h, r=share * v / max(n, 1): prior + r * h for n, v in zip(total, distinct)]
        uni, model, known = np.empty(len(ids)), np.empty(len(ids)), np.empty(len(ids), np.int64)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + at_once, "right")) - 1)
            part = slice(starts[a], starts[b])
            c, fresh, local = [x[part].astype(float) for x in counts], first[part], starts[a : b + 1] - starts[a]
            at = np.arange(len(fresh)) - np.repeat(local[:-1], np.diff(local))
            p = [(c[0] + 1.0) / (total[0] + distinct[0] + 1.0)]
            for k in range(2, order + 1):
                h = np.where(fresh, ends if k == 2 else 0.0, np.concatenate([[0.0], c[k - 2][:-1]]))
                h = np.where(at >= k - 2, h, 0.0)
                heap = heavy[k - 1](h)
                p.append((c[k - 1] + heap * p[-1]) / (h + heap))
            automaton = Automaton([x[part].astype(np.int64) for x in numbers], kinds, fresh, c, [np.log10(x) for x in p], ends, heavy)
            local = local.tolist()
            uni[a:b] = np.add.reduceat(np.log10(p[0]), local[:-1])
            known[a:b] = np.add.reduceat((c[0] > 0).astype(np.int64), local[:-1])
            path = numbers[0][part].tolist()
            for i in range(a, b):
                model[i] = automaton.traverse(path[local[i - a] : local[i - a + 1]])
            a = b
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": [held_out(i, modulus, remainder) for i in ids], "n_tokens": np.diff(starts), "n_known": known,
                "train_tokens": np.full(len(ids), total[0], np.int64), "base_score": uni, "score": model,
            },
            schema=result,
        )

    asked = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("order", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("order", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    for f in (counted, summed, scored):
        f.__annotations__ = {}
    questions = rows.groupBy("block").applyInArrow(counted, "block int, shard int, order int, size long, keys binary, counts binary")
    answers = questions.groupBy("shard").applyInArrow(summed, "block int, shard int, order int, counts binary, n long, v long")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
