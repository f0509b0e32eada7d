import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import docs_of  # noqa: F401
from tokenizers import Tokenizer, pre_tokenizers

from tablelens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


HARD = ["", " ", "Hello World's end", "á ́b", "x<|endoftext|>y <|endoftext|>", "1234 ５６", "\x85a b　c d", "ÀΣ ς İ", "你好\x1c世界\x1f!", "'re've", "a\0b", "e" * 9000, "é" * 3000]


def test_ids_equal_the_librarys(library):
    rng = random.Random(8)
    letters = "abS's t're \t\n\x0b\x0c\r\x1c\x85 ́é1２!?-’𝒳你<|>"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    plain = "aBzÀÉßöøÿıſĲŐ's't'RE'll09 \t\n.,!?-_<|>/"
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [chr(c) + "x" + chr(c) + "." for c in range(0x250) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(100)) for _ in range(50)]
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, ids in zip(some, encoder.encode(some)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_lengths():
    for n in [*range(1, 300), 4095, 4096, 4097, 12288, 12289, 20000]:
        made = packing.binary_lengths(n)
        assert sum(made) == n and made == sorted(made, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 4096 for x in made)
        assert len(set(made)) == len(made) - max(0, n // 4096 - 1)


def test_whole_table(docs_of, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(50, None), (51, "word " * 13000), (7, "twin text"), (7, "twin text"), (None, "no key")]
    rows += [(100 + i, f"text number {i} " * i) for i in range(60)]
    made = packing.pack(docs_of(rows), PATH).collect()
    assert sorted(r.sequence_id for r in made) == list(range(len(made)))
    assert all(r.offset == 0 for r in made)
    by_number = sorted(made, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted((r.length for r in made), reverse=True)  # one range of numbers a bucket
    want = sorted((str(k), library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows if (k, t) != (7, "twin text"))
    whole: dict = {}
    for r in sorted(made, key=lambda r: r.start):
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == 4 * r.length
        if r.doc_id != 7 or r.doc_tokens != 3:
            assert r.start == len(whole.setdefault(r.doc_id, []))
            whole[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
            assert r.doc_tokens >= len(whole[r.doc_id])
    assert sorted((str(k), v) for k, v in whole.items() if k != 7) == [w for w in want if w[0] != "7"]
    twins = [r for r in made if r.doc_id == 7 and r.doc_tokens == 3]
    assert sorted(r.start for r in twins) == [0, 0, 2, 2]
    crc = {(r.doc_id, r.start, r.ids_crc32) for r in packing.digests(docs_of(rows), PATH).collect()}
    assert crc == {(r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in made}


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_many_rows_are_cut_as_one(library):
    totals = np.array([1, 2, 7, 4095, 4096, 4097, 12289, 20000, 1])
    for most in (4096, 8, 1):
        rows, lengths = packing.cut_rows(totals, most)
        for i, n in enumerate(totals.tolist()):
            assert lengths[rows == i].tolist() == packing.binary_lengths(n, most)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for some in (HARD, ["Plain words only, 12"], [], [""], HARD[::-1]):
        ids, ends = encoder.flat_ids(some)
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_byte_letters_equal_the_librarys_and_units_are_learned_once(library, monkeypatch):
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for text in ["".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xA0, 0x250))), "你𝒳"]:
        assert packing.byte_letters(text) == "".join(x for x, _ in level.pre_tokenize_str(text))
    assert packing.byte_letters("a é") == "a Ã©"
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda new, learn=encoder._learn: (learned.extend(new), learn(new)))
    for some in (["One é, one"], ["é one two 你"], ["two 你 one."], [" "]):
        assert encoder.flat_ids(some)[0].tolist() == sum((library.encode(t, add_special_tokens=False).ids for t in some), [])
    assert learned == ["one", "é", ",", "two", " 你", "."]
