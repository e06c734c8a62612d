"""Byte-level BPE against the tokenizers library, which it must equal."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from orderlab.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def table():
    return bpe.load(bpe.default_file())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_file())


def texts():
    rnd = random.Random(5)
    out = [None, "", " ", "\n\n  a", "a  b \t\n c ", "it's we'll I'd they're  've 'S", "12 345x6 ½ Ⅳ", "aaaaaaaa aaa aaaaa",
           "héllo wörld ñandú straße", "日本語のテキスト 中文 ไทย", "x<|endoftext|>y <|endoftext|><|endoftext|>  <|endoftext|", "🙂🙃 é  　 z\x85\x1c\x1d",
           "꟎꟏1 a₏ Ᲊ \U00010940b", "<|endoftext|>"]
    alphabet = "abcdeéß 日\n\t'st09.,!?-_<|>🙂 ꟒"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (bpe.LONG, bpe.LONG + 1, 20000)]
    out += ["a" * 9999, "ab" * 5000, "=" * 7001, "the" * 4000 + " end", "é" * 3000]
    return out


def test_every_text_equals_the_library(table, library):
    split = bpe.Splitter(table)
    given = texts()
    got = bpe.encode_texts(given, table, split)
    for text, ids in zip(given, got, strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    back = bpe.decode_ids([x.tobytes() for x in got], table)
    assert back == [library.decode(x.tolist(), skip_special_tokens=False) for x in got]
    assert back == [t or "" for t in given]


def test_ids_that_are_no_text_decode_with_replacements(table, library):
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12).astype("<u4")
        assert bpe.decode_ids([ids.tobytes()], table) == [library.decode(ids.tolist(), skip_special_tokens=False)]


def test_long_way_equals_rounds(table):
    rnd = random.Random(1)
    for _ in range(30):
        word = "".join(rnd.choice("abthen") for _ in range(rnd.randint(1, 400))).encode()
        flat = table.byte_id[np.frombuffer(word, np.uint8)]
        rounds, _ = bpe.merge_words(flat.copy(), np.array([len(word)]), table)
        assert bpe.merge_long(flat, table).tolist() == rounds.tolist()


def test_query_columns_and_edge_rows(spark, library):
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(texts())] + [(None, "null id", "x", 7, "y"), (3, "again", "x", 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, decoded string")
    want = set()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    out = bpe.digests(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in out.collect()} == want
    assert bpe.digests(docs.limit(0)).collect() == []
    whole = bpe.decode(bpe.encode(docs))
    assert whole.columns == ["doc_id", "ids", "n_tokens", "decoded"]
