import hashlib
import random
import sys
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobtide.llm import queries
from jobtide.llm.bpe_codec import Codec, decode_ids, encode_texts, round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string, note string"


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def agree(codec, library, texts):
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = codec.encode(text)
        assert ids(packed) == encoded.ids, text[:80]
        assert codec.decode(np.frombuffer(packed, "<u4")).decode() == library.decode(
            encoded.ids, skip_special_tokens=False), text[:80]


@pytest.mark.parametrize("alphabet", [
    "ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!.-#*='", "éüßñ日本語ñ", "01 x'sSd\n　"])
def test_random_words(codec, library, alphabet):
    rng = random.Random(len(alphabet))
    agree(codec, library, ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(4000)])


def test_every_character(codec, library):
    form = "a%b % x%1 %'s"
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    # those of one kind in blocks are sampled
    points = [p for p in points if p < 0x3400 or 0xA000 <= p < 0xAC00 or 0xD7A0 <= p < 0x12400
              or 0x16000 <= p < 0x17000 or 0x18A00 <= p < 0x20000 or p % 97 == 0]
    texts = [form.replace("%", chr(p)) for p in points]
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(codec.encode(text)) == encoded.ids, ascii(text)


def test_special_strings_and_case(codec, library):
    agree(codec, library, [
        "", " ", "x<|endoftext|>Y <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> <|end", "ΑΣ ΣΑΣ. İstanbul ẞ",
        "é <|endoftext|>́", "it's we'll 'S 'RE ''s 12a3 don'T'm", "\x00\x1c\x85​﻿", "ﬁ Å ǅ"])


def test_long_words_take_linear_time(codec, library):
    agree(codec, library, ["a" * 3000, "ab" * 3000, "the" * 2000, "=-" * 2000, "日" * 2000])
    for unit in ("a", "ab", "in", "="):
        codec.encode(unit * 50_000)
        times = []
        for size in (100_000, 400_000):
            begun = time.process_time()
            codec.encode(unit * (size // len(unit)))
            times.append(time.process_time() - begun)
        assert times[1] < 12 * times[0] + 0.5


def test_forgotten_words_and_pairs_change_nothing(library, monkeypatch):
    monkeypatch.setattr("jobtide.llm.bpe_codec.KNOWN_WORDS", 3)
    monkeypatch.setattr("jobtide.llm.bpe_codec.KNOWN_PAIRS", 3)
    rng = random.Random(2)
    agree(Codec(PATH), library, [" ".join(rng.choices(["one", "zyx", "qrstu", "Übel", "abcab"], k=30)) for _ in range(50)])


def test_registered_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op13_bpe_codec(spark, folder).collect():
        wanted = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(wanted), hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(wanted, skip_special_tokens=False).encode()).hexdigest())


def test_odd_rows_and_columns(spark, library):
    rows = [(1, None, "old", "a"), (None, "Two words", "old", "b"), (3, "", None, None),
            (4, "word " * 200_000, "x", "y"), (1, "Two words", "old", "a"), (1, "Two words", "old", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    coded = encode_texts(docs, PATH)
    assert coded.columns == ["doc_id", "text", "note", "n_tokens", "ids_bytes"]
    seen = {(r.doc_id, r.text): (r.n_tokens, r.decoded) for r in decode_ids(coded, PATH).collect()}
    assert seen[(1, None)] == (0, "") == seen[(3, "")]
    assert seen[(None, "Two words")] == (2, "two</w> words</w>") == seen[(1, "Two words")]
    assert seen[(4, "word " * 200_000)][0] == 200_000
    assert round_trip(docs, PATH).count() == 6
    assert round_trip(docs.limit(0), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        Codec(public_tokenizers.path("byte_bpe_50k.json"))
