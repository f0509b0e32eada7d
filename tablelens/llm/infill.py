"""Fill-in-the-middle: texts cut at two token boundaries and put in another order.

A token is a run of other characters with the white space before it, or white
space at the end of a text; white space is U+0020 and U+0009 to U+000D.  The
boundaries of a piece of the table, many short texts or one long one, are kept
as one compressed set of byte places.  The set is split by the high bits of a
place into containers of 65,536 places; each is a sorted array, a bitmap or a
list of runs, whichever is smallest.  Containers know how many boundaries come
before them, so the place of the k-th boundary is found by a search over those
cumulative counts and a local select in one container.  All cuts of a piece
are looked up at once.

A text of n tokens is cut after ``low`` and ``high`` tokens, the smaller and
larger of two draws modulo n + 1.  Forms: ``plain``, the text as it is; ``psm``,
prefix, suffix, middle; ``spm``, suffix, prefix, middle, each after its mark.

Defined results: a null text counts as empty; an empty text, and one that holds
a mark, is plain; a text of white space only is one token; texts of any length
are cut whole.  Rows are independent, so repeated rows give equal results, and
a null key draws as an empty one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tablelens.llm.frames import map_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
SEED = 42
#: Percent of the texts that are transformed, and percent of those in the form spm.
RATE, SPM = 50, 80

SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
ARRAY, BITMAP, RUNS = 0, 1, 2


class Boundaries:
    """A set of places with ``select``: containers of arrays, bitmaps or runs, and their cumulative counts."""

    def __init__(self, places: np.ndarray):
        """``places``: distinct, ascending."""
        high = places >> SPAN_BITS
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(places) else np.zeros(0, np.int64)
        self.keys = high[starts]
        self.before = np.append(starts, len(places))
        self.containers = [container(places[a:b] & (SPAN - 1)) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Places of the boundaries with these ranks, which count from 0."""
        out = np.zeros(len(ranks), np.int64)
        at = np.searchsorted(self.before, ranks, side="right") - 1
        for c in np.unique(at):
            mine = at == c
            out[mine] = (int(self.keys[c]) << SPAN_BITS) + select_in(self.containers[c], ranks[mine] - self.before[c])
        return out


def container(low: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(kind, data, cumulative counts) of the smallest of the three kinds."""
    first = np.flatnonzero(np.append(True, np.diff(low) != 1))
    sizes = {ARRAY: 2 * len(low), BITMAP: SPAN // 8, RUNS: 4 * len(first)}
    kind = min(sizes, key=sizes.get)
    if kind == ARRAY:
        return kind, low.astype(np.uint16), np.zeros(0, np.int64)
    if kind == RUNS:
        return kind, low[first].astype(np.uint16), first
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    return kind, words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])


def select_in(box: tuple[int, np.ndarray, np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Low bits of the places with these ranks in a container."""
    kind, data, before = box
    if kind == ARRAY:
        return data[ranks].astype(np.int64)
    at = np.searchsorted(before, ranks, side="right") - 1
    if kind == RUNS:
        return data[at].astype(np.int64) + ranks - before[at]
    bits = np.unpackbits(data[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    nth = np.cumsum(bits, axis=1, dtype=np.int64) == (ranks - before[at] + 1)[:, None]
    return 64 * at + np.argmax(nth, axis=1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[Boundaries, np.ndarray]:
    """The set of token ends of texts laid end to end, and each text's number of tokens."""
    space = _SPACE[data]
    last = np.zeros(len(data), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    stop = last.copy()
    stop[:-1] |= ~space[:-1] & space[1:]
    places = np.flatnonzero(stop) + 1
    return Boundaries(places), np.diff(np.searchsorted(places, ends, side="right"), prepend=0)


def draws(key: bytes) -> list[int]:
    """Four unsigned 32-bit numbers that the seed and the key decide."""
    return np.frombuffer(hashlib.sha256(b"%d:%s" % (SEED, key)).digest()[:16], ">u4").tolist()


def transform(texts: list[bytes], drawn: np.ndarray) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text; ``drawn`` has four numbers a row."""
    blob = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = ends - np.diff(ends, prepend=0)
    tokens, n = boundaries(blob, ends)
    base = np.cumsum(n) - n
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    places = np.repeat(begins[:, None], 2, axis=1)
    inside = cuts > 0
    places[inside] = tokens.select((base[:, None] + cuts - 1)[inside])
    chars = np.concatenate([[0], np.cumsum((blob & 0xC0) != 0x80, dtype=np.int64)])
    low, high = (places - begins[:, None]).T.tolist()
    p_chars = (chars[places[:, 0]] - chars[begins]).tolist()
    m_chars = (chars[places[:, 1]] - chars[places[:, 0]]).tolist()
    out = []
    p, s, m = MARKS
    for i, t in enumerate(texts):
        if not t or any(x in t for x in MARKS) or drawn[i, 2] % 100 >= RATE:
            out.append((int(n[i]), "plain", None, None, t))
            continue
        prefix, middle, suffix = t[: low[i]], t[low[i] : high[i]], t[high[i] :]
        if drawn[i, 3] % 100 < SPM:
            out.append((int(n[i]), "spm", p_chars[i], m_chars[i], s + suffix + p + prefix + m + middle))
        else:
            out.append((int(n[i]), "psm", p_chars[i], m_chars[i], p + prefix + s + suffix + m + middle))
    return out


def restored_text(output: bytes, form: str) -> bytes:
    """The text that an output was made of.

    Parts hold no whole mark, and no mark ends with the start of one, so the first mark found is the one put there.
    """
    p, s, m = MARKS
    if form == "plain":
        return output
    left, middle = output.split(m, 1)
    if form == "psm":
        prefix, suffix = left[len(p) :].split(s, 1)
    else:
        suffix, prefix = left[len(s) :].split(p, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (tokens), form, prefix_chars, middle_chars, output."""
    out = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())
    # The key goes along with the text, parted by the first blank, so that a task draws for its own rows.
    joined = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))

    def make():
        def work(column: pa.Array):
            rows = [t.split(b" ", 1) for t in column.cast(pa.binary()).to_pylist()]
            made = transform([t for _, t in rows], np.array([draws(k) for k, _ in rows], np.int64).reshape(-1, 4))
            return [list(c) for c in zip(*made)]

        return work

    return map_text(docs.select(F.col(key).alias("key"), joined.alias("joined")), "joined", out, make, (F.col("key").alias(key),))


def restore(made: DataFrame, key: str = "doc_id", also: tuple[Column, ...] = ()) -> DataFrame:
    """key, the ``also`` columns, and text, rebuilt from output and form alone."""
    joined = F.concat("form", F.lit(" "), "output")

    def make():
        def work(column: pa.Array):
            rows = [t.split(b" ", 1) for t in column.cast(pa.binary()).to_pylist()]
            return [[restored_text(output, form.decode()) for form, output in rows]]

        return work

    chosen = made.select(F.col(key), *also, joined.alias("__joined"))
    return map_text(chosen, "__joined", StructType().add("text", StringType()), make, chosen.columns[:-1])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (of the text rebuilt)."""
    kept = ("n", "form", "prefix_chars", "middle_chars")
    made = fill_in_middle(docs, key, text)
    return restore(made, key, (*map(F.col, kept), F.sha2("output", 256).alias("output_sha256"))).select(
        key, *kept, "output_sha256", F.sha2("text", 256).alias("restored_sha256"))
