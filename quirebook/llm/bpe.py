"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine.

A merge list has a sufficient lookahead: a number L of symbols such that tokens that end L or more symbols before the
end of what has been read can't be changed by what is still to come. What is unknown acts on the known part only
through merges at its edge. A merge (x, y) that starts d symbols before the edge decides whether a later-ranked merge
(z, x) or (z, xy) can take place, whose start lies len(z) further left, and so on with strictly later ranks. L is thus
the weight of the longest such chain, found in one sweep over the merge list in rank order. The transducer buffers
twice that much, merges the buffer, and emits the tokens that are stable; the rest of a word then encodes on its own.
Words that fit into the buffer (nearly all) are encoded at once and remembered in a table of bounded size.

Decoding feeds token ids in pieces: as the tokenizer's own decode does when its file names no decoder (token
strings joined by spaces), or to text, through an incremental UTF-8 decoder that carries a character split over tokens
and replaces what is malformed.

Defined cases: a null text encodes like an empty one, to no tokens; the two control strings of the file become their
single tokens wherever they stand; nothing else about a row matters, so repeated rows and extra columns are harmless.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quirebook.llm.common import read

#: White space as the tokenizer file's patterns mean it. Python's own also takes U+001C to U+001F.
SPACE = "\t\n\x0b\f\r \x85\xa0  -     　"
_CHUNK = regex.compile(f"[^{SPACE}]+")
#: Fixed by the tokenizer file: how a chunk without white space falls into words.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_NONE = 1 << 60
#: Ids that a decoder is fed at once.
PIECE = 8192


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(shifted.get(b, b)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a byte-level tokenizer file, by token number."""

    def __init__(self, config: dict):
        model = config["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: t for t, i in (self.ids | self.special).items()}
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.final = [self.ids[s + self.end] for s in symbols]
        of, marks = {s: b for b, s in enumerate(symbols)}, set(self.special.values())
        #: The bytes that a token stands for, a space for a word's end; control tokens have none.
        self.bytes = {i: self._bytes(t, of) for i, t in self.strings.items() if i not in marks}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = dict(self.merges.values())
        self.lookahead = self._lookahead()

    def _bytes(self, token: str, of: dict[str, int]) -> bytes:
        ends = bool(self.end) and token.endswith(self.end)
        token = token[: -len(self.end)] if ends else token
        return bytes(map(of.__getitem__, token)) + b" " * ends

    def length(self, token: int) -> int:
        text = self.strings[token]
        return len(text) - (len(self.end) if self.end and text.endswith(self.end) and len(text) > len(self.end) else 0)

    def _lookahead(self) -> int | None:
        """Symbols after which a token is stable; None if some merge uses a token that a later merge makes, as then
        merges don't take place in rank order and a word has to be read whole."""
        made: dict[int, int] = {}
        for rank, token in self.merges.values():
            made[token] = max(rank, made.get(token, -1))
        reach: dict[int, int] = {}  # of the merges so far that start with, or make, a token: the heaviest chain
        longest = 1
        for (a, b), (rank, token) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                return None
            chain = max(self.length(token), self.length(a) + reach.get(b, 0))
            longest = max(longest, chain)
            for t in (a, token):
                reach[t] = max(reach.get(t, 0), chain)
        return longest

    def merged(self, symbols: list[int]) -> list[int]:
        """The merges of lowest rank first, the leftmost of equal ones."""
        get, made, tokens = self.ranks.get, self.made, list(symbols)
        ranks = list(map(get, zip(tokens, tokens[1:]), repeat(_NONE)))
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            tokens[i] = made[best]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((tokens[i - 1], tokens[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((tokens[i], tokens[i + 1]), _NONE)
        return tokens


class Transducer:
    """Symbols of one word in, stable tokens out. Holds at most 2 L + 2 symbols."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, []
        self.ahead = merges.lookahead
        self.room = 2 * self.ahead + 2 if self.ahead is not None else _NONE

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for s in symbols:
            self.held.append(s)
            if len(self.held) >= self.room:
                stable, at = len(self.held) - self.ahead, 0
                for token in self.merges.merged(self.held):
                    if at + self.merges.length(token) > stable:
                        break
                    at += self.merges.length(token)
                    yield token
                del self.held[:at]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merged(self.held)
        self.held = []


class Encoder(dict):
    """Encodes texts; as a dict, remembers the ids (little-endian, 32 bits) of up to `most` short chunks, and of as
    many words."""

    def __init__(self, merges: MergeList, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.merges, self.most, self.longest, self.room = merges, most, longest, Transducer(merges).room
        self.words: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")

    def word(self, word: str) -> bytes:
        raw, merges = word.encode("utf-8"), self.merges
        symbols = [*map(merges.inner.__getitem__, raw[:-1]), merges.final[raw[-1]]]
        if len(symbols) < self.room:
            ids = merges.merged(symbols)
            return struct.pack(f"<{len(ids)}I", *ids)
        transducer = Transducer(merges)
        return np.array([*transducer.feed(symbols), *transducer.finish()], "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        packed = []
        lower = plain.lower()
        for word in (lower,) if lower.isalpha() and lower.isascii() else _WORD.findall(lower):
            if (ids := self.words.get(word)) is None:
                ids = self.word(word)
                if len(word) <= self.longest:
                    if len(self.words) >= self.most:
                        self.words.clear()
                    self.words[word] = ids
            packed.append(ids)
        ids = b"".join(packed)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        text, parts, at = text or "", [], 0
        for control in self.special.finditer(text) if "<|" in text else ():
            parts += [self._plain(text[at : control.start()]), self.merges.special[control[0]].to_bytes(4, "little")]
            at = control.end()
        return b"".join([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        odd = not text.isascii() or not text.isprintable()
        chunks = _CHUNK.findall(text) if odd and any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.__getitem__, chunks))


class Decoder:
    """Token ids in, in pieces of any length, text out; what is held between pieces is at most an open character.
    pieces: as the tokenizer's own decode, the token strings joined by spaces. Otherwise text: bytes become characters
    as soon as they are complete, a word end becomes a space."""

    def __init__(self, merges: MergeList, pieces: bool = False):
        self.merges, self.pieces, self.first = merges, pieces, True
        self.bytes = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Sequence[int]) -> str:
        if self.pieces:
            text = " ".join(map(self.merges.strings.__getitem__, ids))
            text, self.first = (text if self.first or not len(ids) else " " + text), self.first and not len(ids)
            return text
        try:
            return self.bytes.decode(b"".join(map(self.merges.bytes.__getitem__, ids)))
        except KeyError:  # a control token is among them
            return "".join(map(self._text, ids))

    def _text(self, i: int) -> str:
        if i in self.merges.bytes:
            return self.bytes.decode(self.merges.bytes[i])
        text = self.bytes.decode(b"", True) + self.merges.strings[i]
        self.bytes.reset()
        return text

    def finish(self) -> str:
        return "" if self.pieces else self.bytes.decode(b"", True)


def decoded_digests(merges: MergeList, packed: bytes) -> tuple[str, str]:
    """Digests of what packed ids decode to, PIECE ids at a time: as the tokenizer's own decode, and as text."""
    ids, made = np.frombuffer(packed, "<u4"), []
    for pieces in (True, False):
        decoder, digest = Decoder(merges, pieces), hashlib.sha256()
        for at in range(0, len(ids), PIECE):
            digest.update(decoder.feed(ids[at : at + PIECE].tolist()).encode())
        digest.update(decoder.finish().encode())
        made.append(digest.hexdigest())
    return made[0], made[1]


#: The merge list and the encoder of the file that a worker saw last: the worker's next task finds them, with their words.
_KEPT: dict[str, tuple[MergeList, Encoder]] = {}


def _encoder(config: str) -> tuple[MergeList, Encoder]:
    if config not in _KEPT:
        _KEPT.clear()
        merges = MergeList(json.loads(config))
        _KEPT[config] = merges, Encoder(merges)
    return _KEPT[config]


def _loaded(df: DataFrame, path: str | None):
    """The tokenizer file's text, for all executors: a file of fixed size, read on the driver."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) for each row of docs, and with digests also ids_sha256, decoded_sha256 (of the
    text that the tokenizer's own decode gives) and text_sha256 (of the text that the byte-to-text decoder gives)."""
    config = _loaded(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encoder = _encoder(config.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [encoder.packed(t.as_py()) for t in part.column(1)]
                columns = {"doc_id": part.column(0), "n_tokens": pa.array([len(p) // 4 for p in found], pa.int64())}
                if ids:
                    flat = np.frombuffer(b"".join(found), "<i4")
                    ends = np.cumsum([0, *(len(p) // 4 for p in found)])
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                if digests:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in found])
                    both = [decoded_digests(merges, p) for p in found]
                    columns["decoded_sha256"], columns["text_sha256"] = (pa.array([b[i] for b in both], pa.string()) for i in (0, 1))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string, text_sha256 string" * digests
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pieces: bool = False) -> DataFrame:
    """(doc_id, text) for each row of encoded (doc_id, ids array<int>). A null list decodes like an empty one."""
    config = _loaded(encoded, path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = _encoder(config.value)
        for batch in batches:
            texts = []
            for row in batch.column(1):
                decoder = Decoder(merges, pieces)
                texts.append(decoder.feed(row.as_py() or ()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_bpe: see the README for its columns."""
    return encode(read(spark, sf_dir, "documents"), ids=False, digests=True)
