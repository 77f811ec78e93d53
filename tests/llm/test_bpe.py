import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirebook.llm import bpe


@pytest.fixture(scope="module")
def merges():
    with open(bpe.default_path()) as f:
        return bpe.MergeList(json.load(f))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(11)
    parts = [*"abethrnsi'' ", "é", "É", "Σ", "ς", "İ", "ß", "́", "\x1c", "\x85", "\xa0", "　", "​", "漢", "🎉", "<|endoftext|>", "<|startoftext|>", "<|", "\n", "'s", "'LL", "K", "\x00", "1", "½", "-", ".."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]


def test_ids_and_decoding_match_the_library(merges, library):
    encoder = bpe.Encoder(merges, most=200)  # small tables, so that they are emptied on the way
    long = ["".join(random.Random(i).choice("abcdethinrse") for _ in range(4000)) for i in range(3)] + ["a" * 3000, "é" * 900, "!" * 2000]
    for text in odd_texts() + long:
        want = library.encode(text, add_special_tokens=False).ids
        packed = encoder.packed(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want, text
        decoder = bpe.Decoder(merges, pieces=True)
        cut = len(want) // 3
        assert decoder.feed(want[:cut]) + decoder.feed(want[cut:]) + decoder.finish() == library.decode(want, skip_special_tokens=False)


def test_transducer_holds_a_bounded_buffer_and_emits_only_stable_tokens(merges):
    rng = random.Random(4)
    room = 2 * merges.lookahead + 2
    for alphabet in ("ab", "thein", "abcdefghijklmnopqrstuvwxyz", "ha"):
        raw = [merges.inner[ord(rng.choice(alphabet))] for _ in range(5 * room)]
        transducer, out = bpe.Transducer(merges), []
        for s in raw:
            out += transducer.feed([s])
            assert len(transducer.held) < room
        out += transducer.finish()
        assert out == merges.merged(raw)


def test_text_decoding_restores_words_and_characters_split_over_tokens(merges):
    encoder = bpe.Encoder(merges)
    text = "naïve 漢字 🎉 ünder"
    ids = [x for (x,) in struct.iter_unpack("<I", encoder.packed(text))]
    decoder = bpe.Decoder(merges)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "naïve 漢字 🎉 ünder "
    half = [merges.inner["é".encode()[0]]]
    decoder = bpe.Decoder(merges)
    assert decoder.feed(half) + decoder.finish() == "�"


def plain_text(ids, library):
    """What the ids stand for, all bytes at once."""
    of, out = {c: b for b, c in enumerate(bpe.byte_symbols())}, b""
    for token in map(library.id_to_token, ids):
        out += bytes(of[c] for c in token.removesuffix("</w>")) + b" " * token.endswith("</w>")
    return out.decode("utf-8", "replace")


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 40000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode(docs, digests=True)
    rows = got.collect()
    assert sorted(len(r.ids) for r in rows) == sorted(r.n_tokens for r in rows) == [0, 0, 1, 2, 2, 40000]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in rows if r.doc_id in (2, 3)} == {r.decoded_sha256 for r in rows if r.doc_id in (2, 3)} == {empty}
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert back[1] == "hello world " and back[2] == ""
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, sf, library):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), hashlib.sha256(plain_text(ids, library).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, sf).collect()} == want
