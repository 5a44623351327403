"""The streaming encoder against the public libraries, its lookahead, and exact round trips."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import tokenize
from loomline.llm.tokenize import BatchEncoder, PieceTransducer, StreamDecoder, StreamEncoder, Vocabulary, decode_documents, encode_documents

FOLDER = tokenize.TOKENIZERS
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")

ALPHABET = "ab'sreveltdm  \n\t  　x1²é́中日🙂👩‍💻.,!'’ｶ٣\x85 "


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def expected():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def cases(n=3000):
    rng = random.Random(1)
    return [
        *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)),
        "", " ", "\n", "a" * 30000, " " * 9000 + "x", "ab" * 9000, "!" * 20000, "\n" * 7000, "中" * 5000 + " " * 5000, "don't'll 've''s 's\n's", "<|endoftext|>", "x" * 5000 + "'s",
    ]


def test_batches_equal_the_library(vocabulary, expected):
    texts = cases()
    counts, ids = BatchEncoder(vocabulary, chunk=5000).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == expected(texts)


def test_streams_equal_the_library_however_they_are_cut(vocabulary, expected):
    rng, texts = random.Random(2), cases(600)
    for text, ids in zip(texts, expected(texts)):
        encoder, got, at = StreamEncoder(vocabulary, chunk=rng.choice([5, 50, 5000])), [], 0
        while at < len(text):
            step = rng.choice([1, 3, 10]) if len(text) < 100 else rng.choice([997, 4000])
            got += encoder.feed(text[at : at + step])
            at += step
        assert got + encoder.finish() == ids
        assert len(encoder.carry) == 0


def test_lookahead_is_sufficient_and_memory_constant(vocabulary):
    assert vocabulary.lookahead() < 256
    rng = random.Random(3)
    tokens = sorted(vocabulary.ranks)
    for _ in range(40):
        piece = b"".join(rng.choice(tokens) for _ in range(400))
        transducer, got, held = PieceTransducer(vocabulary, window=1), [], 0
        for i in range(0, len(piece), 7):
            got += transducer.feed(piece[i : i + 7])
            held = max(held, len(transducer.held))
        assert [vocabulary.tokens[t] for t in got + transducer.finish()] == vocabulary.merge(piece)
        assert held <= transducer.window + 7


def test_decoding_in_any_steps(vocabulary, expected):
    texts = cases(300)
    for text, ids in zip(texts, expected(texts)):
        decoder = StreamDecoder(vocabulary)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    cut = StreamDecoder(vocabulary)
    assert cut.feed(expected(["🙂"])[0][:1]) + cut.finish() == "�"


def test_tables(spark, expected):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world"), (None, "x"), (4, "y" * 40000 + "é")]
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, ids string")
    encoded = encode_documents(docs)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect())
    assert got == sorted((str(k), ids) for (k, _), ids in zip(rows, expected([t or "" for _, t in rows])))
    back = sorted((str(r[0]), r[1]) for r in decode_documents(encoded).collect())
    assert back == sorted((str(k), t or "") for k, t in rows)
    assert encode_documents(docs.limit(0)).count() == 0
