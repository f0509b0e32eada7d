"""Byte-level BPE encoding and decoding under a public rank file.

A text is cut into pieces without regular expressions.  Every code point has
a class (letter, number, white space, ...), held in one array over all code
points.  An automaton of eight states reads the classes.  Its transition
functions are elements of a small monoid, so the state before each character
comes from an associative scan: rows of characters are composed side by side,
the rows' functions are scanned, and each row is run again from its entry
state.  The pieces' tokens come from a cache of merged pieces; byte offsets of
all tokens are kept, and decoding places the token bytes at them.

Defined results: a null or empty text has no tokens and decodes to no bytes;
a null key is carried along; repeated rows are encoded each.  A lone piece of
any length is merged with a heap, so long texts stay near linear.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from tablelens.llm.frames import lists, map_text

LETTER, NUMBER, OTHER, SPACE, WHITE, SPACE_LAST, WHITE_LAST, SHORT, LONG, END = range(10)
# States: a piece must start, in a run of letters / numbers / others, after a
# space / other white space, two / one letters of a contraction still to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, TWO_MORE, ONE_MORE = range(8)
STOP = 0x110000  # between texts; not a code point
ROW = 64  # characters that a scan composes in one row
CACHED_PIECES, CACHED_CHARS = 250_000, 64


def rank_file(path: str) -> bytes:
    """The rank file as bytes (read on the driver; a vocabulary is a few MB at most)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def code_classes() -> np.ndarray:
    """Class of every code point, by the Unicode properties that the tiktoken library itself uses."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(STOP + 1, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for prop, kind in ((r"\s", WHITE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        ids = tiktoken.Encoding("class", pat_str=prop, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")], table[STOP] = SPACE, END
    return table


def _step(kind: int, state: int) -> int:
    if kind == LETTER:
        return {TWO_MORE: ONE_MORE, ONE_MORE: START}.get(state, IN_LETTERS)
    if kind in (SHORT, LONG):  # a contraction, unless its apostrophe joins the piece before
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE) else ONE_MORE if kind == SHORT else TWO_MORE
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: AFTER_SPACE, SPACE_LAST: AFTER_SPACE, END: START}.get(kind, AFTER_WHITE)


def _starts(kind: int, state: int) -> bool:
    if kind == LETTER:
        return state not in (IN_LETTERS, AFTER_SPACE, TWO_MORE, ONE_MORE)
    if kind == NUMBER:
        return state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, SHORT, LONG):
        return state not in (IN_OTHERS, AFTER_SPACE)
    return kind in (SPACE_LAST, WHITE_LAST, END) or state not in (AFTER_SPACE, AFTER_WHITE)


def automaton() -> dict[str, np.ndarray]:
    """Tables of the automaton and of its transition monoid (all functions that words of classes make)."""
    gens = [tuple(_step(k, s) for s in range(8)) for k in range(10)]
    found = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    then = np.zeros((len(found), len(found)), np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            then[i, j] = found[tuple(g[s] for s in f)]
    return {
        "step": np.array(gens, np.uint8).ravel(),
        "starts": np.array([[_starts(k, s) for s in range(8)] for k in range(10)], bool).ravel(),
        "of_class": np.array([found[g] for g in gens], np.uint8),
        "then": then,
        "from_start": np.array([f[START] for f in found], np.uint8),
    }


def exclusive_scan(then: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """Composition of all functions before each place (doubling over an associative table)."""
    out = np.concatenate([np.zeros(1, np.uint8), functions[:-1]])
    reach = 1
    while reach < len(out):
        out[reach:] = then[out[:-reach], out[reach:]]
        reach *= 2
    return out


def kinds_of(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of each character, with what follows it folded in: last of a run of white space, contractions."""
    kinds = classes[codes]
    white = (kinds == SPACE) | (kinds == WHITE)
    follows = np.append(kinds[1:], END)
    last = white & (follows != END) & ~np.append(white[1:], True)
    kinds[last] += 2
    quote = np.flatnonzero(codes == ord("'"))
    if len(quote):
        padded = np.append(codes, [STOP, STOP]).astype(np.uint32)
        a, b = padded[quote + 1], padded[quote + 2]
        kinds[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        kinds[quote[pair]] = LONG
    return kinds


def piece_starts(codes: np.ndarray, classes: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Places where a piece starts (the stops between texts count as pieces)."""
    n = len(codes)
    rows = -(-n // ROW)
    kinds = np.full(rows * ROW, END, np.uint8)
    kinds[:n] = kinds_of(codes, classes)
    columns = np.ascontiguousarray(kinds.reshape(rows, ROW).T)
    functions, flat, size = m["of_class"][columns], m["then"].ravel(), len(m["then"])
    whole = functions[0]
    for j in range(1, ROW):
        whole = flat.take(whole.astype(np.int32) * size + functions[j])
    state = m["from_start"][exclusive_scan(m["then"], whole)]
    starts = np.empty((ROW, rows), bool)
    for j in range(ROW):
        at = columns[j].astype(np.intp) * 8 + state
        starts[j] = m["starts"].take(at)
        state = m["step"].take(at)
    return np.flatnonzero(starts.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank (leftmost on ties) is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    get = ranks.get
    if len(piece) <= 200:
        cut = list(range(len(piece) + 1))
        pair = [get(piece[i : i + 2], STOP) for i in cut[:-2]]
        while pair and (best := min(pair)) != STOP:
            i = pair.index(best)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[cut[i] : cut[i + 2]], STOP)
            if i:
                pair[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], STOP)
        return [ranks[piece[x:y]] for x, y in zip(cut, cut[1:])]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end[i]: where the part that starts at i ends; 0 if gone
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class MergedPieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; long pieces are not kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes lists of texts; one in each task."""

    def __init__(self, data: bytes, classes: np.ndarray, machine: dict[str, np.ndarray]):
        ranks = parse_ranks(data)
        self.classes, self.machine, self.cache = classes, machine, MergedPieces(ranks)
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        words = [b""] * size
        for token, i in ranks.items():
            words[i], self.lengths[i] = token, len(token)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(words), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        joined = "\0".join([*texts, ""])
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        codes[stops] = STOP
        marks = piece_starts(codes, self.classes, self.machine)
        at = marks.tolist()
        found = self.cache
        encoded = [found[joined[a:b]] for a, b in zip(at, [*at[1:], len(joined)])]
        last = np.searchsorted(marks, stops).tolist()
        out, since = [], 0
        for k in last:
            out.append(np.frombuffer(b"".join(encoded[since:k]), "<u4"))
            since = k + 1
        if len(found) > CACHED_PIECES:
            found.clear()
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes start in the text, and at last where the text ends."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes: each token's are copied to its offset."""
        sizes = np.diff(offsets)
        return self.blob[np.arange(offsets[-1]) + np.repeat(self.first[ids] - offsets[:-1], sizes)].tobytes()


def _codec(df: DataFrame, path: str):
    """What makes a codec in a task; the vocabulary is read once, on the driver."""
    sent = df.sparkSession.sparkContext.broadcast((rank_file(path), code_classes(), automaton()))
    return lambda: Codec(*sent.value)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, ids array<int>, offsets array<int> (byte offsets of the tokens, and the end)."""
    codec = _codec(docs, ranks_path)
    out = StructType().add("ids", ArrayType(IntegerType(), False)).add("offsets", ArrayType(IntegerType(), False))

    def make():
        c = codec()

        def work(column: pa.Array):
            ids = c.encode(_texts(column))
            at = [c.offsets(x) for x in ids]
            return [lists(np.concatenate(xs).astype(np.int32), np.cumsum([len(x) for x in xs])) for xs in (ids, at)]

        return work

    return map_text(docs, text, out, make, (key, *carry))


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """key, decoded binary, from ids and offsets of :func:`encode`."""
    codec = _codec(tokens, ranks_path)

    def run(batches):
        c = codec()
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            made = [c.decode(np.array(i or [], np.int64), np.array(o or [0], np.int64)) for i, o in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[key, "decoded"])

    chosen = tokens.select(key, "ids", "offsets")
    return chosen.mapInArrow(run, StructType([chosen.schema[0]]).add("decoded", BinaryType()))


def digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: key, n_tokens, ids_sha256, decoded_sha256."""
    codec = _codec(docs, ranks_path)
    out = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def make():
        c = codec()

        def work(column: pa.Array):
            ids = c.encode(_texts(column))
            back = [hashlib.sha256(c.decode(x, c.offsets(x))).hexdigest() for x in ids]
            return [len(x) for x in ids], [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], back

        return work

    return map_text(docs, text, out, make, (key,))
