"""Packing by powers of two: documents cut into pieces of binary lengths, equal lengths in one bucket.

A document's token ids, with an end id behind them, are cut into pieces of the
full ``SEQUENCE`` length while they last and then into the powers of two of
which the rest is the sum, longest first.  Every piece is a sequence of its
own: none crosses documents and none needs padding.  Sequences of one length
form a bucket of consecutive numbers, longest bucket first, so that a training
job takes batches of one length by a range of numbers.

The tokenizer cuts a text into parts, which white space always separates, and
encodes each part alone.  So parts of plain text, and whole words of other
text, are encoded once and kept; a document's ids are those of its parts in a
row.

Numbers come from counts: each task numbers the pieces of each length that it
makes and writes them with its own number; sums over the small table of counts
give where each task's pieces of a length begin.  No piece is shuffled.

Defined results: a null or empty text has the end id alone, one piece of
length 1; repeated rows and a null key are packed like all others; an empty
table gives no sequence; other columns are not read.  Which piece has which
number follows the order of the input's partitions.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
from tokenizers import Tokenizer, pre_tokenizers

from tablelens.llm.frames import BROADCAST_KEYS, PIECE_BYTES, pieces, stored

#: Tokens of the longest sequence, a power of two.
SEQUENCE = 4096
END = 2
#: Units and characters of units that a task keeps the ids of.
CACHED_WORDS, CACHED_CHARS = 400_000, 32 << 20


#: Characters whose lower case and class are plain: ASCII, and Latin letters that normalisation leaves as they are.
_LATIN = "À-ÖØ-öø-įı-ſ"
PLAIN = re.compile(rf"[\t-\r\x20-\x7E{_LATIN}]*")
#: The tokenizer's own parts of lower-cased plain text, and the words of any text.
UNIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\t-\r\x20a-z0-9{_LATIN}]+")
WORD = re.compile(r"[^\t-\r\x20]+")
SPECIAL = "<|"


def _byte_letters() -> np.ndarray:
    """UTF-8 of the letter that stands for each byte in a byte-level vocabulary, filled up with 0; a blank stays."""
    shown = {0x20, *range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    letters = [chr(c if c in shown and c != 0x20 else next(others)) for c in range(0x100)]
    letters[0x20] = " "
    return np.array([list(x.encode().ljust(2, b"\0")) for x in letters], np.uint8)


_LETTERS = _byte_letters()


def byte_letters(text: str) -> str:
    """The letters of the text's UTF-8 bytes; blanks stay."""
    out = _LETTERS[np.frombuffer(text.encode(), np.uint8)].ravel()
    return out[out > 0].tobytes().decode()


class Encoder:
    """Ids of texts by those of their units; ``begins`` and ``sizes`` tell where a unit's ids are in ``flat``.

    A unit is a part of plain text, or, after a blank, a whole word of other text.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        self.definition = definition
        # parts of plain text are normal and apart already
        self.of_parts = Tokenizer.from_str(definition)
        self.of_parts.normalizer = None
        self.of_parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.of_parts.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_str(self.definition)

    def forget(self) -> None:
        #: A unit is numbered when it is met first.
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.size = 0
        self.flat = np.zeros(0, np.uint32)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return UNIT.findall(text.lower())
        out = []
        for word in WORD.findall(text):
            if PLAIN.fullmatch(word) and SPECIAL not in word:
                out += UNIT.findall(word.lower())
            else:
                out.append(" " + word)
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of the new units: those of plain text in one run, told apart by the tokens that close a part."""
        text = " ".join(new)
        self.size += len(text)
        whole = np.zeros(len(new), bool)
        others: list[str] = []
        if text[0] == " " or "  " in text:  # units of other text begin with a blank
            whole[:] = [u[0] == " " for u in new]
            others = [u for u in new if u[0] == " "]
            text = " ".join([u for u in new if u[0] != " "])
        ids = np.array(self.of_parts.encode_batch_fast([byte_letters(text)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(new) - len(others):
            raise ValueError("the tokenizer does not close each part of a text with one token")
        other = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        sizes = np.zeros(len(whole), np.int64)
        sizes[~whole], sizes[whole] = np.diff(ends, prepend=0), list(map(len, other))
        begins = np.zeros(len(whole), np.int64)
        for some in (~whole, whole):  # the ids of the plain units, then those of the others
            begins[some] = np.cumsum(sizes[some]) - sizes[some]
        begins[whole] += len(ids)
        self.begins = np.concatenate([self.begins, begins + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids, *(np.array(x, np.uint32) for x in other)])

    def flat_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text end."""
        if len(self.numbers) > CACHED_WORDS or self.size > CACHED_CHARS:
            self.forget()
        units = list(map(self.units, texts))
        ends = np.cumsum([0, *map(len, units)])
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(units)), np.int64, int(ends[-1]))
        if len(self.numbers) > len(self.sizes):
            self._learn([*islice(reversed(self.numbers), len(self.numbers) - len(self.sizes))][::-1])
        n = self.sizes[numbers]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.begins[numbers] - upto[:-1], n) + np.arange(upto[-1])], upto[ends[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.flat_ids(texts)
        return np.split(ids, ends)[:-1]


def binary_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Powers of two up to ``most`` that add up to n, longest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if n % most >> b & 1]


def cut_rows(totals: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and length of each piece of rows with so many tokens: ``binary_lengths`` of all rows at once."""
    powers = 1 << np.arange(most.bit_length() - 2, -1, -1)
    counts = np.column_stack([totals // most, (totals[:, None] % most & powers) > 0])
    lengths = np.repeat(np.tile([most, *powers], len(totals)), counts.ravel())
    return np.repeat(np.arange(len(totals)), counts.sum(axis=1)), lengths


def _cut(docs: DataFrame, tokenizer: str, key: str, text: str, end: int, most: int) -> DataFrame:
    """key, start, length, ids, doc_tokens, and part and nth: the task and the place among its pieces of that length."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()  # one vocabulary, a few MB
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    chosen = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    out = StructType([chosen.schema[0]]).add("start", LongType()).add("length", LongType()).add("ids", BinaryType()).add("doc_tokens", LongType()).add("part", IntegerType()).add("nth", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        part = TaskContext.get().partitionId()
        made_so_far: dict[int, int] = {}
        for batch in batches:
            for some in pieces(batch, 1, PIECE_BYTES):
                ids, ends = encoder.flat_ids([t or "" for t in some.column(1).to_pylist()])
                ids, totals = np.insert(ids, ends, np.uint32(end)).astype("<u4"), np.diff(ends, prepend=0) + 1
                rows, lengths = cut_rows(totals, most)
                after = np.cumsum(lengths)
                nths = np.empty(len(lengths), np.int64)
                for n in np.unique(lengths).tolist():
                    same = np.flatnonzero(lengths == n)
                    before = made_so_far.get(n, 0)
                    nths[same] = before + np.arange(len(same))
                    made_so_far[n] = before + len(same)
                starts = after - lengths - (np.cumsum(totals) - totals)[rows]
                places = np.concatenate([[0], 4 * after]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(places), pa.py_buffer(ids)])
                keys = some.column(0).take(pa.array(rows, pa.int64()))
                arrays = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), blobs, pa.array(totals[rows], pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(nths)]
                yield pa.RecordBatch.from_arrays([keys, *arrays], names=out.names)

    return chosen.mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, most: int = SEQUENCE) -> DataFrame:
    """key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    ``tokenizer``: path of the tokenizer's definition.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    cut = stored(_cut(docs, tokenizer, key, text, end, most))
    # At most a row for each task and power of two.
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = stored(counts.select("part", "length", "n", earlier.alias("begin")))
    base, first = 0, F.lit(0)
    for r in sorted(begins.groupBy("length").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.length):  # one row for each power of two
        first = F.when(F.col("length") == r.length, F.lit(base)).otherwise(first)
        base += r.n
    begins = begins.select("part", "length", (first + F.col("begin")).cast("long").alias("begin"))
    if begins.count() <= BROADCAST_KEYS:
        begins = F.broadcast(begins)
    numbered = cut.join(begins, ["part", "length"])
    return numbered.select(F.col(key), "start", "length", "ids", "doc_tokens", (F.col("begin") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, tokenizer, key, text).select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
