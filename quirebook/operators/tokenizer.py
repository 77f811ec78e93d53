"""Word-piece tokens for an embedding model."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 512
#: Ids of special tokens in vocabularies that lack them.
SPECIAL = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102}


def parse_vocabulary(text: str) -> dict[str, int]:
    """A token's id is its line; blank lines use up an id."""
    vocabulary = {line: i for i, line in enumerate(re.split(r"\r?\n", text)) if line}
    if not vocabulary:
        raise ValueError("the vocabulary is empty")
    return vocabulary


def vocabulary_table(text: Column) -> Column:
    """(id, token) of a vocabulary file's text, to explode."""
    lines = F.transform(F.split(text, r"\r?\n", -1), lambda x, i: F.struct(i.cast("long").alias("id"), x.alias("token")))
    return F.filter(lines, lambda x: x["token"] != "")


def basic_tokens(text: str) -> list[str]:
    """Accents are stripped, each CJK character is a token, and what is neither CJK nor an ASCII word character parts
    tokens; case stays."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    return re.findall("[㐀-䶿一-龥]|[A-Za-z0-9_]+", plain)


class Pieces:
    """A vocabulary as two tries, of the pieces that begin a word and of those that go on (##). Finding a word's pieces
    takes at most the longest piece's length a character."""

    def __init__(self, vocabulary: dict[str, int]):
        self.first: dict = {}
        self.later: dict = {}
        for token, number in vocabulary.items():
            self._add(self.first, token, number)
            if token.startswith("##"):
                self._add(self.later, token[2:], number)
        self.unknown = vocabulary.get("[UNK]", SPECIAL["[UNK]"])

    @staticmethod
    def _add(node: dict, token: str, number: int) -> None:
        for character in token:
            node = node.setdefault(character, {})
        node[""] = number

    def of(self, word: str) -> list[int]:
        """Greedy longest pieces; where none fits, one unknown token ends the word, after the pieces so far."""
        out, at = [], 0
        while at < len(word):
            node, found, end = self.later if at else self.first, None, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    found, end = node[""], i + 1
            if found is None:
                return [*out, self.unknown]
            out.append(found)
            at = end
        return out


def tokenize(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(key, ids) for texts (key, content)."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            ids = [[i for w in basic_tokens(t.as_py() or "") for i in pieces.of(w)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return texts.select("key", "content").mapInArrow(run, f"key {kind}, ids array<int>")


def encode(ids: Column, vocabulary: dict[str, int] | None = None, length: int = LENGTH) -> Column:
    """A struct (input_ids, attention_mask, token_type_ids), each padded to length, with start and end tokens."""
    of = SPECIAL | {k: v for k, v in (vocabulary or {}).items() if k in SPECIAL}
    body = F.concat(F.array(F.lit(of["[CLS]"])), F.slice(ids, 1, length - 2), F.array(F.lit(of["[SEP]"])))
    n = F.size(body)
    pad = lambda value: F.array_repeat(F.lit(value), F.lit(length) - n)
    return F.struct(F.concat(body, pad(of["[PAD]"])).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), pad(0)).alias("attention_mask"), F.array_repeat(F.lit(0), length).alias("token_type_ids"))


def embed(texts: DataFrame, model, dimension: int, batch: int = 16) -> DataFrame:
    """(key, vector) for texts (key, content): model takes a list of texts and returns as many lists of numbers. It is
    called with `batch` texts at a time, and a vector of another dimension is an error."""
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            content = rows.column(1).to_pylist()
            vectors = [v for i in range(0, len(content), batch) for v in model(content[i : i + batch])]
            if len(vectors) != len(content) or any(len(v) != dimension for v in vectors):
                raise ValueError(f"the model's vectors aren't {dimension} numbers each")
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["key", "vector"])

    return texts.select("key", "content").mapInArrow(run, f"key {kind}, vector array<float>")
