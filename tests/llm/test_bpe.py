import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_fixtures import docs_of, ranks  # noqa: F401

from tablelens.llm import bpe


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.rank_file(ranks)), special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(bpe.rank_file(ranks), bpe.code_classes(), bpe.automaton())


HARD = ["", "a", "'s", "  ", " 's", "x'sfoo", "'re've'll'd'm't'", "a  b", "a \n b", "\n\n'll", "a\n\nb ", "!'s", " !'ll", "1'2", "a" * 3000, " " * 500, "'ll" * 99, "<|endoftext|>", "\0", "é" * 300, "𝒳y你好"]


def test_ids_equal_the_librarys(codec, library):
    rng = random.Random(3)
    letters = "ab's t're ve'll'd'm  \n\t 　é1２!?-'’𝒳你好\x85\0"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(200)) for _ in range(50)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids, codec.offsets(ids)) == text.encode()


def test_scan_is_the_composition_of_all_before():
    m = bpe.automaton()
    f = np.random.default_rng(1).integers(0, len(m["then"]), 77).astype(np.uint8)
    expect = [0]
    for x in f[:-1]:
        expect.append(m["then"][expect[-1], x])
    assert bpe.exclusive_scan(m["then"], f).tolist() == expect


def test_frames(docs_of, ranks, library):
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (None, "x"), (1, "Hello world's end"), (4, "ab " * 5000)]
    docs = docs_of(rows)
    tokens = bpe.encode(docs, ranks)
    got = sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode(tokens, ranks).collect()), key=str)
    assert back == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    for r in bpe.digests(docs, ranks).filter("doc_id = 4").collect():
        ids = library.encode_ordinary(rows[-1][1])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[-1][1].encode()).hexdigest()
    assert bpe.digests(docs_of([]), ranks).count() == 0
