"""BPE encoding as a bounded-lookahead streaming transducer, decoding as a state machine.

Lookahead. A merge list is proper when each operand is made before it is used;
then merging by least rank first equals applying the rules one after another.
Take a text t and any continuation tx, and let p be the last place up to which
both are cut alike. Rule r = (a, b) can move p only where a ends at p and b
starts there in just one of the two; p then falls by the length of a. The next
rule to move it has a higher rank, its left operand ends at the new p and a is on
the left spine of its right operand. So the longest chain of rules of rising rank
linked that way bounds how far the future reaches back; ``lookahead`` computes it
from the merge list, and tokens that end further from the end of what has been
read are final. Memory: one window of symbols, whatever the length of a word.

Texts are read in pieces, through three machines that each hold a bounded rest:
what may be the beginning of a special token or may still compose with the next
character (NFC; a run of combining marks is held whole), what may still become
another word of the split pattern, and the open word's own window. A word that
outgrows what is held is opened and goes on as long as its run does, whatever it
is made of. Every word, short or long, goes through the transducer; a bounded cache
remembers its output. Decoding feeds ids to a machine that holds at most one
incomplete UTF-8 sequence.

Defined results: null is the empty text: no ids. Special tokens are recognised in
the raw text, as the tokenizer file says. Rows are mapped one by one, so ties,
repeated rows, empty tables and further columns need no care: columns are passed
on by position under their own names.
"""
from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import small_batches

PIECE = 1 << 16
NONE = 1 << 30


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Letters that Unicode assigns after version 16, which the tokenizers library follows and the regex module is past.
LATER_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1
16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""


#: Numbers of the same kind.
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


#: Capitals (or ranges of them) that Python's Unicode version has no small letter for, and the first small letter.
LATER_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def later_small() -> dict[int, int]:
    small = {}
    for entry in LATER_CAPITALS.split():
        ends, first = entry.split(":")
        low, high = int(ends.split("-")[0], 16), int(ends.split("-")[-1], 16)
        small |= {c: int(first, 16) + c - low for c in range(low, high + 1)}
    return small


def any_of(ranges: str) -> str:
    """Class of the regex module for ranges of code points."""
    ends = [r.split("-") for r in ranges.split()]
    return "[" + "".join(f"\\U{int(e[0], 16):08x}-\\U{int(e[-1], 16):08x}" for e in ends) + "]"


#: What is held back of a text: more than any special token, and more than the split pattern looks ahead.
MARGIN = 64


class Vocabulary:
    """A tokenizer file: byte-level BPE with word ends. Loaded once a process."""

    loaded: dict = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(max(self.ids.values()), *self.special.values()))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain = regex.compile(pattern)
        letters, numbers = any_of(LATER_LETTERS), any_of(LATER_NUMBERS)
        self.rare = regex.compile(f"{letters}|{numbers}")
        wide = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{self.rare.pattern})").replace(r"[\p{L}]", rf"[\p{{L}}--{letters}]").replace(r"[\p{N}]", rf"[\p{{N}}--{numbers}]")
        self.wide = regex.compile(wide, regex.V1)
        characters = byte_characters()
        self.first = [self.ids[c] for c in characters]
        self.last = [self.ids[c + self.suffix] for c in characters]
        self.ending = dict(zip(self.first, self.last))
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(self.merges):
            self.rank[self.ids[a] << 20 | self.ids[b]] = r
            self.made.append(self.ids[a + b])
        self.lookahead = self._lookahead()
        back = {c: b for b, c in enumerate(characters)}
        self.bytes = [t.encode() if t in self.special else bytes(back[c] for c in t.removesuffix(self.suffix)) + b" " * t.endswith(self.suffix) for t in self.tokens]
        self.window = max(256, 4 * self.lookahead)

    def splitter(self, text: str) -> regex.Pattern:
        """The pattern of words for a normalised text."""
        try:
            text.encode("latin-1")  # quick, and most texts pass
            return self.plain
        except UnicodeEncodeError:
            return self.wide if self.rare.search(text) else self.plain

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _lookahead(self) -> int:
        """Symbols that must follow a token's end before nothing later can move it (see above)."""
        length = lambda t: len(t.removesuffix(self.suffix)) if t != self.suffix else 0
        parts: dict[str, tuple[str, int]] = {}  # left part of a token and the rank that made it
        ranks: dict[str, list[int]] = {}  # by left operand: ranks of its rules, and the longest chain up to each
        chains: dict[str, list[int]] = {}
        longest = 0
        for r, (a, b) in enumerate(self.merges):
            if any(len(x.removesuffix(self.suffix)) > 1 and x not in parts for x in (a, b)):
                raise ValueError(f"the merge list is not proper: rule {r} uses a token that is made later")
            most, c, limit = 0, b, r - 1
            while True:
                if c in ranks and (i := bisect_right(ranks[c], limit)):
                    most = max(most, chains[c][i - 1])
                if c not in parts:
                    break
                c, limit = parts[c]
            chain = length(a) + most
            ranks.setdefault(a, []).append(r)
            chains.setdefault(a, []).append(max(chain, chains[a][-1]) if a in chains and chains[a] else chain)
            longest = max(longest, chain)
            parts.setdefault(a + b, (a, r))
        return longest + 1  # the last symbol itself changes if the word ends there

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges to symbols, lowest rank first, leftmost first."""
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids


class Word:
    """The transducer for one word: bytes in, ids out once they are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, []

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        v = self.v
        for at in range(0, len(raw), v.window):
            self.held += [v.first[b] for b in raw[at : at + v.window]]
            while len(self.held) > v.window:
                now, rest = self.held[: v.window], self.held[v.window :]
                end = 0
                for token in v.merge(now[:]):
                    size = len(v.bytes[token])
                    if end + size > len(now) - v.lookahead:
                        break
                    out.append(token)
                    end += size
                self.held = now[end:] + rest
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, []
        if held:
            held[-1] = self.v.ending[held[-1]]
        return self.v.merge(held)


class Cache(dict):
    """Word to its ids as bytes. Two generations of bounded size: words in use stay, others go."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        super().__init__()
        self.v, self.most, self.old = vocabulary, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            w = Word(self.v)
            found = array("I", w.feed(word.encode()) + w.finish()).tobytes()
            if len(word) > 64:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


LATER_SMALL = later_small()
LATER_CAPITAL = regex.compile("[" + "".join(map(chr, LATER_SMALL)) + "]")


def normal(text: str) -> str:
    """NFC and lower case, character by character (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(LATER_SMALL) if LATER_CAPITAL.search(text) else text


def apart(text: str, at: int) -> bool:
    """Whether what comes before and after a place in a text is normalised apart."""
    if unicodedata.combining(text[at]):
        return False
    left, right = text[max(0, at - 32) : at], text[at : at + 32]
    return normal(left + right) == normal(left) + normal(right)


class Encoder:
    """Text in pieces, ids (bytes of little-endian unsigned 32-bit numbers) out."""

    def __init__(self, vocabulary: Vocabulary, cache: Cache | None = None):
        self.v = vocabulary
        self.cache = cache if cache is not None else Cache(vocabulary)
        self.text = ""  # as it came
        self.held = ""  # normalised, not yet split into words
        self.word, self.stem = None, ""  # a word that is open, and its last characters

    def feed(self, text: str) -> bytes:
        self.text += text
        return self._read(False) if len(self.text) > PIECE else b""

    def finish(self) -> bytes:
        return self._read(True)

    def _read(self, is_end: bool) -> bytes:
        """Parts the text at special tokens and normalises what is between."""
        v, out, text = self.v, [], self.text
        if any(s in text for s in v.special):
            *parts, text = v.split_special.split(text)
            for plain, special in zip(parts[::2], parts[1::2]):
                out += [self._split(normal(plain), True), array("I", [v.special[special]]).tobytes()]
        if is_end:
            at = len(text)
        else:
            at = max(0, len(text) - MARGIN)
            while at and not apart(text, at):
                at -= 1
        self.text = text[at:]
        out.append(self._split(normal(text[:at]), is_end))
        return b"".join(out)

    def _split(self, text: str, is_end: bool) -> bytes:
        """Words of the pattern, as far as what follows can't change them."""
        out: list[bytes] = []
        text = self.held + text if self.held else text
        pattern = self.v.splitter(text)
        settled = len(text) if is_end else len(text) - MARGIN
        at = 0
        if self.word is not None:
            run = pattern.match(self.stem + text)  # goes on as the word's run does
            at = min(run.end() - len(self.stem), max(0, settled))
            out.append(self._feed(text[:at]))
            if run.end() - len(self.stem) > settled:
                self.held = text[at:]
                return b"".join(out)
            out.append(self._close())
        if is_end:
            self.held = ""
            out += map(self.cache.__getitem__, pattern.findall(text, at))
            return b"".join(out)
        for m in pattern.finditer(text, at):
            if m.end() > settled:
                at = m.start()
                if settled - at > MARGIN:  # a long run: read it before its end is known
                    self.word = Word(self.v)
                    out.append(self._feed(text[at:settled]))
                    at = settled
                break
            out.append(self.cache[m.group()])
            at = m.end()
        else:
            at = max(at, settled)  # white space
        self.held = text[at:]
        return b"".join(out)

    def _feed(self, part: str) -> bytes:
        self.stem = (self.stem + part)[-8:]
        return array("I", self.word.feed(part.encode())).tobytes()

    def _close(self) -> bytes:
        word, self.word, self.stem = self.word, None, ""
        return array("I", word.finish()).tobytes()


def encode(text: str | None, vocabulary: Vocabulary, cache: Cache | None = None) -> bytes:
    """Ids of a whole text, as bytes of little-endian unsigned 32-bit numbers."""
    e = Encoder(vocabulary, cache)
    return e.feed(text or "") + e.finish()


class Decoder:
    """Ids in, text out. ``joined``: the tokens' own strings between spaces, as a tokenizer without a decoder gives
    them. Otherwise bytes to text: word ends become spaces; an incomplete UTF-8 sequence waits for its other bytes,
    broken ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary, joined: bool = False):
        self.v, self.joined, self.begun = vocabulary, joined, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if not self.joined:
            return self.utf8.decode(b"".join(map(self.v.bytes.__getitem__, ids)))
        text = " ".join(map(self.v.tokens.__getitem__, ids))
        text, self.begun = " " + text if self.begun and ids else text, self.begun or bool(ids)
        return text

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


def transcode(docs: DataFrame, path: str, emit, columns: str, text_col: str = "text", keep: list[str] | None = None, joined: bool = False, at_once: int = 8192) -> DataFrame:
    """Encodes each text and decodes it again.

    emit(vocabulary) makes an object for each text: ids(bytes) gets the ids and text(str) the decoded text, piece by piece;
    result() gives the values of columns (a DDL list). ``keep``: columns of docs that are passed on."""
    small_batches(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    made = [c.strip().split()[0] for c in columns.split(",")]
    schema = docs.select(*kept).schema
    more = StructType.fromDDL(columns)
    out, types = StructType([*schema.fields, *more.fields]), [to_arrow_type(f.dataType) for f in more]
    position = docs.columns.index(text_col)
    places = [docs.columns.index(c) for c in kept]

    def run(batches):
        v = Vocabulary.load(path)
        cache = Cache(v)
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch, rows = whole.slice(first, 128), []
                for text in batch.column(position).to_pylist():
                    encoder, decoder, to = Encoder(v, cache), Decoder(v, joined), emit(v)
                    text = text or ""
                    for at in range(0, len(text) + 1, PIECE):
                        raw = encoder.feed(text[at : at + PIECE])
                        if at + PIECE > len(text):
                            raw += encoder.finish()
                        to.ids(raw)
                        ids = array("I")
                        ids.frombytes(raw)
                        for i in range(0, len(ids), at_once):
                            to.text(decoder.feed(ids[i : i + at_once]))
                    to.text(decoder.finish())
                    rows.append(to.result())
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *arrays], [*kept, *made])

    return docs.mapInArrow(run, out)
