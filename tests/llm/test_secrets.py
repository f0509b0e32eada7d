import base64
import hashlib
import itertools
import random
import string

import tiktoken
from llm_fixtures import docs_of, ranks  # noqa: F401

from tablelens.llm import secrets as S


def spans(spark_docs, ranks, **kw):
    return {r.doc_id: r for r in S.counted(S.find_secrets(spark_docs, ranks, **kw)).collect()}


def test_base_spans():
    find = lambda t: S.base_spans(t)
    assert find('PassWord: "abcdefgh"') == [("assign", 0, 19)]
    assert find("api_key=1234567") == []  # value too short
    assert find("password: token: abcdefghij") == []  # the first match takes 'token' as its value
    assert find("ſecret=abcdefghij") == [] and find("to\u212aen=abcdefghij") == []  # only ASCII letters have two cases
    assert find("AKIA" + "A" * 12) == [("access", 0, 16)] and find("AKIA" + "A" * 11) == []
    assert find("g" + "0af" * 11 + "G") == [("hex", 1, 34)] and find("a" * 31) == []


def test_random_strings(docs_of, ranks):
    rng = random.Random(1)
    key = base64.b64encode(rng.randbytes(30)).decode().rstrip("=")
    digest = hashlib.sha256(b"x").hexdigest().upper()
    rows = [
        (1, f"é see {key} there"), (2, f"digest {digest} and 123e4567-e89b-12d3-a456-426614174000 and 12345678901234567890"),
        (3, "a_very_long_function_name_here and someCamelCaseIdentifierOfJava"), (4, None), (5, ""), (6, "antidisestablishmentarianism"), (7, f"token={key}"),
    ]
    got = spans(docs_of(rows), ranks)
    assert got[1].spans == f"random:6:{6 + len(key)}" and got[1].n_random == 1 and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[i].spans == "" for i in (2, 3, 4, 5, 6))
    assert got[7].spans == f"assign:0:{6 + len(key)}" and got[7].n_assign == 1
    assert spans(docs_of(rows), ranks, digests=[key])[1].spans == ""


def test_order_and_redaction(docs_of, ranks):
    hexes = "0123456789abcdef" * 2
    text = f"ü secret={hexes} end"
    docs = docs_of([(1, text), (2, None), (3, "clean")])
    row = spans(docs, ranks)[1]
    assert row.spans == "assign:2:41,hex:9:41" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    made = {r.row.doc_id: (r.clean, r.n_found) for r in S.redact(docs, ranks).collect()}
    assert made == {1: ("ü [secret] end", 2), 2: (None, 0), 3: ("clean", 0)}


def naive_base(text):
    """Base spans by trying every start."""
    plain = string.ascii_letters + string.digits

    def fold(c):
        return c.lower() if c in string.ascii_uppercase else c

    def run(i, alphabet):
        j = i
        while j < len(text) and text[j] in alphabet:
            j += 1
        return j

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(map(fold, text[i : i + len(name)])) != name:
                continue
            j = i + len(name)
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            j = run(j, " ")
            if text[j : j + 1] not in (":", "=") or j == len(text):
                continue
            j = run(j + 1, " ")
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            end = run(j, plain + "+/_.=-")
            if end > j:
                return end, end - j >= 8
        return None

    def access(i):
        end = run(i + 4, string.ascii_uppercase + string.digits)
        return (end, end - i >= 16) if text[i : i + 4] == "AKIA" and end > i + 4 else None

    def hexes(i):
        end = run(i, "0123456789abcdef")
        return (end, end - i >= 32) if end > i else None

    out = []
    for kind, at in (("assign", assign), ("access", access), ("hex", hexes)):
        i = 0
        while i < len(text):
            hit = at(i)
            if hit and hit[1]:
                out.append((kind, i, hit[0]))
            i = hit[0] if hit else i + 1
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0]), s[2]))


def test_spans_by_definition(docs_of, ranks):
    """Every span of odd texts against the definition, tried at every start; the token test with the library's own counts."""
    rng = random.Random(5)
    glue = ["password", "Secret", "token", "api_key", "APIKEY", "passwd", ": ", "=", " = ", "'", '"', " ", "\n", "AKIA", "é", ".", "/", "-"]
    part = lambda: rng.choice([rng.choice(glue), rng.choice(glue), "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.choice([3, 13, 30]))), rng.randbytes(rng.choice([3, 14, 17])).hex(), base64.b64encode(rng.randbytes(rng.choice([4, 15, 24]))).decode(), "internationalWordsOfNames"])
    texts = ["".join(part() for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    library = tiktoken.Encoding("x", pat_str=S.PATTERN, mergeable_ranks=S.parse_ranks(S.rank_file(ranks)), special_tokens={})
    count = lambda s: len(library.encode_ordinary(s))
    keys = set(string.ascii_letters + string.digits + "+/_=-")
    got = spans(docs_of(list(enumerate(texts))), ranks)
    n_random = 0
    for i, t in enumerate(texts):
        expect = naive_base(t)
        covered = {k for _, a, b in expect for k in range(a, b)}
        # free stretches of a run of key characters; "run" tells runs apart
        marks, number = [], 0
        for k, c in enumerate(t):
            number += c not in keys
            marks.append((number, k in covered) if c in keys else None)
        runs = {}
        for k, mark in enumerate(marks):
            if mark:
                runs.setdefault(mark[0], []).append(k)
        for places in runs.values():
            if len(places) < 16:
                continue
            for is_covered, stretch in itertools.groupby(places, key=lambda k: k in covered):
                stretch = list(stretch)
                if is_covered:
                    continue
                a, b = stretch[0], stretch[-1] + 1
                if a - 1 in covered:
                    a = b - len(t[a:b].lstrip("+/_=-"))
                if b - a >= 16 and not S.known(t[a:b], frozenset()) and S.is_random(t[a:b], count):
                    expect.append(("random", a, b))
                    n_random += 1
        expect.sort(key=lambda s: (s[1], S.KINDS.index(s[0]), s[2]))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in expect), t
    assert n_random > 50


def test_token_test_comes_first(ranks):
    """Random strings of any alphabet are found, also beside a base span; names, numbers and long words are not."""
    rng = random.Random(2)
    tokens = S._counter(S.rank_file(ranks))
    found = lambda t: S.spans_of(t, tokens, frozenset())
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet, n, share in ((lower, 16, 0.7), (lower, 32, 0.85), (upper + "234567", 16, 0.95), (upper + "234567", 32, 0.97), (lower + digits, 32, 0.97), (lower + upper + digits + "+/", 40, 0.99)):
        hits = sum(found(f"see {draw(alphabet, n)} here") != [] for _ in range(400))
        assert hits >= share * 400, (alphabet, n, hits)
    secret = draw(lower + upper + digits, 40)
    assert found(f"AKIA{'Q7' * 6}/{secret}") == [("access", 0, 16), ("random", 17, 57)]
    for name in ("someCamelCaseIdentifierOfJava", "a_very_long_function_name_here", "MAX_CONNECTION_RETRY_COUNT", "Content-Security-Policy", "org/apache/spark/sql/catalyst", "20240131T100000Z", "=" * 20, "internationalization", "Rechtsschutzversicherungsgesellschaften", "2024-01-31-release-notes"):
        assert found(f"x {name} y") == [], name


def test_long_empty_and_repeated(docs_of, ranks):
    key = "k9XvQ2mZr7LpT4wYb8Nc"
    text = "words of a text " * 60_000 + key
    rows = [(1, text), (1, text), (2, f"see {key}"), (2, f"see {key}")]
    got = [(r.doc_id, r.spans) for r in S.counted(S.find_secrets(docs_of(rows), ranks)).collect()]
    at = 16 * 60_000
    assert sorted(got) == [(1, f"random:{at}:{at + 20}")] * 2 + [(2, "random:4:24")] * 2
    assert S.counted(S.find_secrets(docs_of([]), ranks)).count() == 0
