"""Secret scans: credential patterns and a token-efficiency test.

Patterns give the base spans: assignments to a credential name, access key
ids, and long hexadecimal strings.  The method adds spans of kind ``random``:
a long run of key characters, less what base spans cover, is cut into tokens of
a public vocabulary; common text needs few tokens, a random string many, so a
low number of characters per token exposes it.  Left out are known digests
(hexadecimal of a digest's length, or given), UUIDs, what has hardly a letter
(numbers, times, rules), and identifiers, told by the same evidence: their
parts in lower case are words, which need few tokens.  A single word has no
second sign against it, so it must be scarcer in characters per token.

Spans are [start, end) in code points of the text; a base span is the whole
match.  Defined results: a null or empty text has no spans; ties in start come
in the order assign, access, hex, random; repeated rows are scanned each.
"""

from __future__ import annotations

import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tablelens.llm.bpe import parse_ranks, rank_file
from tablelens.llm.frames import map_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: Runs that the token test looks at, and the characters per token from which they pass as text:
#: of the whole run, of a run that is one word of letters, and of the letter parts in lower case.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_RUN = 16
TEXT_RATIO, WORD_RATIO, PART_RATIO = 2.1, 1.8, 2.5
LEAST_LETTERS = 0.2  # share of letters below which a run is a number or a time
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def known(run: str, digests: frozenset[str]) -> bool:
    """Whether the run is a known digest, hexadecimal of a digest's length, or a UUID."""
    core = run.strip("+/_=-")
    if run in digests or core in digests or _UUID.fullmatch(core):
        return True
    return bool(_HEX_ONLY.fullmatch(core)) and len(core) in DIGEST_CHARS


def is_random(run: str, tokens) -> bool:
    """The token test. ``tokens``: number of a string's tokens."""
    parts = [p.lower() for p in _PARTS.findall(run) if p.isalpha()]
    letters = sum(map(len, parts))
    if letters < LEAST_LETTERS * len(run):
        return False
    if len(run) >= (WORD_RATIO if run.isalpha() and len(parts) == 1 else TEXT_RATIO) * tokens(run):
        return False
    return letters < PART_RATIO * sum(map(tokens, parts))


def merged(found: list[Span]) -> list[tuple[int, int]]:
    """Disjoint stretches that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s[1:] for s in found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def free_runs(text: str, covered: list[tuple[int, int]]):
    """[start, end) of what the covered stretches leave of each run, without the separators behind a stretch."""
    at = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        whole, k = True, at
        while k < len(covered) and covered[k][0] < b:
            if covered[k][0] > a:
                yield a, covered[k][0]
            a, whole, k = covered[k][1], False, k + 1
            while a < b and text[a] in "+/_=-":
                a += 1
        if whole or a < b:
            yield a, b


def spans_of(text: str, tokens, digests: frozenset[str]) -> list[Span]:
    """All spans in order. ``tokens``: number of a string's tokens."""
    found = base_spans(text)
    for a, b in free_runs(text, merged(found)):
        if b - a >= LEAST_RUN and not known(text[a:b], digests) and is_random(text[a:b], tokens):
            found.append(("random", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _counter(data: bytes):
    made: list = []

    def tokens(run: str) -> int:
        if not made:  # only tasks that meet a run need the vocabulary
            made.append(tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=parse_ranks(data), special_tokens={}))
        return len(made[0].encode_ordinary(run))

    return tokens


def _span_column(rows: list[list[Span]]) -> pa.Array:
    names = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(names))


def _scan(docs: DataFrame, ranks_path: str, out: StructType, make, carry, text: str, digests) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rank_file(ranks_path))
    some = frozenset(digests)

    def start():
        tokens = _counter(sent.value)
        return lambda column: make([t or "" for t in column.to_pylist()], column, lambda t: spans_of(t, tokens, some))

    return map_text(docs, text, out, start, carry)


_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))


def find_secrets(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", digests=()) -> DataFrame:
    """key, found array<struct<kind, start, end>>. ``digests``: known strings that are no secrets."""
    make = lambda texts, _, spans: [_span_column([spans(t) for t in texts])]
    return _scan(docs, ranks_path, StructType().add("found", _SPANS), make, (key,), text, digests)


def redact(docs: DataFrame, ranks_path: str, text: str = "text", mark: str = "[secret]", digests=()) -> DataFrame:
    """The other columns as one struct column ``row``, ``clean`` (the text with the mark for each merged span) and ``n_found``."""

    def make(texts, column, spans):
        cleaned, counts = [], []
        for t, given in zip(texts, column):
            found = spans(t)
            out, at = [], 0
            for _, a, b in sorted(found, key=lambda s: s[1:]):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            cleaned.append("".join(out) + t[at:] if given.is_valid else None)
            counts.append(len(found))
        return cleaned, counts

    out = StructType().add("clean", StringType()).add("n_found", LongType())
    return _scan(docs, ranks_path, out, make, (F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),), text, digests)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counted(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select(key, of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), of("random"))
