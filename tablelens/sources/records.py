"""CSV records that span lines, read in splits.

A large file is read in splits, and a split may begin inside a quoted field.
Whether it does depends on all splits before it, so each split first says how
it ends for either way it may begin: a function of two states, reported in one
small row.  Composed in order, these functions give the state that each split
begins in, and with it each task cuts its own lines into records.  Only a
record that crosses into another split leaves its task: its fragments are
joined by the split that it began in.

A quote opens a field at the field's start only; elsewhere outside it is text.
Inside, a doubled quote is text and a single one closes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A record of one split, and fragments of one that spans splits: its end, its middle (a whole split), its start.
WHOLE, END, MIDDLE, START = range(4)


def ends_inside(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a line ends inside a quoted field, if it begins inside one or at a record's start."""
    closed = False
    for i, part in enumerate(line.split(b'"')[:-1]):
        if inside:
            inside, closed = False, True
        else:
            inside = part.endswith(sep) or (not part and (i == 0 or closed))
            closed = False
    return inside


def line_ends(lines: pa.Array, sep: bytes = b",") -> np.ndarray:
    """For each line two booleans: whether it ends inside a field, if it begins outside or inside one.

    If each quote that should open a field stands at a field's start, quotes open
    and close in turn and their number tells; other lines are read quote by quote.
    """
    lines = lines.cast(pa.large_binary())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset: lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8) if lines.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero(data[offsets[0]: offsets[-1]] == 0x22) + offsets[0]
    line = np.searchsorted(offsets, at, side="right") - 1
    count = np.bincount(line, minlength=len(lines))
    nth = np.arange(len(at)) - (np.cumsum(count) - count)[line]
    # may open a field: at the line's start, after a quote, or after the mark between fields
    begin = offsets[line]
    opens = (at == begin) | ((at > begin) & (data[at - 1] == 0x22))
    marked = at - begin >= len(sep)
    for i, byte in enumerate(sep):
        marked &= data[at - len(sep) + i] == byte
    opens |= marked
    out = np.empty((len(lines), 2), bool)
    for k in (0, 1):
        out[:, k] = (count + k) % 2 == 1
        stray = np.unique(line[((nth + k) % 2 == 0) & ~opens])
        for i in stray:
            out[i, k] = ends_inside(lines[int(i)].as_py(), bool(k), sep)
    return out


def states_after(ends: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line, of a run of lines with these ``ends``, ends inside a field, if the first begins as told."""
    turns = np.cumsum(ends[:, 0] & ~ends[:, 1])
    fixed = np.maximum.accumulate(np.where(ends[:, 0] == ends[:, 1], np.arange(len(ends)), -1))
    known = np.where(fixed >= 0, ends[fixed, 0] + turns - turns[fixed], inside + turns)
    return known % 2 == 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((file, start), from, to) of the lines of one split that follow one another in a batch."""
    n = batch.num_rows
    if not n:
        return
    start = np.asarray(batch.column("start"))
    file = batch.column("file").dictionary_encode()
    code = np.asarray(file.indices)
    edges = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        yield (file.dictionary[int(code[a])].as_py(), int(start[a])), a, b


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def split_states(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """file, start, inside (the split begins inside a field), spans (one of its records goes on in another line), open (its last one is not closed)."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, list] = {}  # (file, start): end state from outside, from inside, whether a line ended inside
        for batch in batches:
            for key, a, b in _runs(batch):
                s = made.setdefault(key, [False, True, False, False])
                ends = line_ends(batch.column("value").slice(a, b - a), mark)
                for k in (0, 1):
                    after = states_after(ends, s[k])
                    s[k], s[2 + k] = bool(after[-1]), s[2 + k] or bool(after.any())
        rows = [(*k, *v) for k, v in made.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [[]] * 6, (pa.string(), pa.int64(), *[pa.bool_()] * 4))], names=names)

    names = ["file", "start", "f0", "f1", "spans0", "spans1"]
    # A line without quotes ends as it begins, so it never reaches Python.
    quoted = _lines(spark, path).filter(F.contains(F.col("value"), F.lit(bytearray(b'"'))))
    said = quoted.mapInArrow(run, "file string, start long, f0 boolean, f1 boolean, spans0 boolean, spans1 boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # The last split that ends alike whatever it begins in, and the turns since then.
    turn = (F.col("f0") & ~F.col("f1")).cast("int")
    turns = F.sum(turn).over(Window.partitionBy("file").orderBy("start"))
    counted = said.withColumn("turns", turns).withColumn("fixed", F.when(F.col("f0") == F.col("f1"), F.col("f0").cast("int") + F.col("turns")))
    at = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.last("turns").over(before), F.lit(0))
    state = counted.withColumn("inside", at % 2 == 1)
    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    return state.select("file", "start", "inside", pick("spans0", "spans1").alias("spans"), pick("f0", "f1").alias("open"))


class Unclosed(ValueError):
    """A quoted field is open at the end of a file."""


def spanning(spark: SparkSession, path: str | list[str], sep: str = ",") -> list[tuple] | None:
    """(file, start) of each split's state, in order, or None if every record is a line.

    The frame has a row for each split with a quote; its size is that of the list of splits.
    """
    states = split_states(spark, path, sep).orderBy("file", "start").collect()
    if not any(s.spans for s in states):
        return None
    last = {s.file: s.open for s in states}
    unclosed = sorted(f for f, o in last.items() if o)
    if unclosed:
        raise Unclosed(f"A quoted field is not closed at the end of {unclosed[0]}.")
    return [(s.file, s.start, s.open) for s in states]


def _cut(lines: DataFrame, states: list[tuple], sep: str) -> DataFrame:
    """file, start, kind, first, record: the records of each split that are not blank, and the fragments of others."""
    mark = sep.encode()
    sent = lines.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        known = sent.value
        at, parts = None, []  # the lines of the record that is not closed yet
        inside = begun_inside = first = False

        def closed(lists: pa.Array) -> pa.RecordBatch:
            """The records of one split whose lines are given, all closed in it; the first one may have begun before it."""
            nonlocal begun_inside, first
            text = pc.binary_join(lists, b"\n")
            kind = np.full(len(text), WHOLE, np.int32)
            if begun_inside:
                kind[0] = END
                begun_inside = False
            whole = pa.array(kind == WHOLE)
            text = pc.if_else(pc.and_(whole, pc.ends_with(text, b"\r")), pc.binary_slice(text, 0, -1), text)
            head = pa.array(np.zeros(len(text), bool))
            if first and kind[0] == WHOLE and text[0].as_py().startswith(b"\xef\xbb\xbf"):
                text = pa.concat_arrays([pa.array([text[0].as_py()[3:]], text.type), text.slice(1)])
            kept = pc.or_(pc.invert(whole), pc.invert(pc.match_substring_regex(text, r"\A[\t\n\x0b\f\r ]*\z")))
            if first and pc.any(kept).as_py():
                one = np.zeros(len(text), bool)
                one[int(np.argmax(np.asarray(kept)))] = True
                head, first = pa.array(one), False
            n = len(text)
            made = pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array(np.full(n, at[1], np.int64)), pa.array(kind), head, text], names=FIELDS)
            return made.filter(kept)

        def left() -> list[pa.RecordBatch]:
            """What the split that ends here leaves open."""
            if at is None or not parts:
                return []
            kind = MIDDLE if begun_inside else START
            text = b"\n".join(x for p in parts for x in p.to_pylist())
            return [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, kind, first and kind == START, text), KINDS)], names=FIELDS)]

        for batch in batches:
            for key, a, b in _runs(batch):
                if key != at:
                    yield from left()
                    at, parts = key, []
                    i = bisect_left(known, at) - 1  # the last split with quotes before this one
                    begun_inside = inside = i >= 0 and known[i][0] == key[0] and known[i][2]
                    first = key[1] == 0
                own = batch.column("value").slice(a, b - a).cast(pa.binary())
                after = states_after(line_ends(own, mark), inside)
                inside = bool(after[-1])
                ends = np.flatnonzero(~after)  # the last line of each record that is closed here
                if not len(ends):
                    parts.append(own)
                    continue
                before = sum(len(p) for p in parts)
                lines_of = pa.concat_arrays([*parts, own.slice(0, int(ends[-1]) + 1)])
                yield closed(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1 + before]).astype(np.int32)), lines_of))
                rest = own.slice(int(ends[-1]) + 1)
                parts = [rest] if len(rest) else []
        yield from left()

    return lines.mapInArrow(run, "file string, start long, kind int, first boolean, record binary")


FIELDS = ["file", "start", "kind", "first", "record"]
KINDS = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())


def first_record(spark: SparkSession, path: str | list[str], states: list[tuple], sep: str = ",") -> str | None:
    """The first record of the first file that has one; other splits reach Python only if it spans more than its own."""
    top = _cut(_lines(spark, path).filter("start = 0"), states, sep).filter("first").orderBy("file").limit(1).collect()
    if top and top[0]["kind"] == START:
        top = records(spark, path, states, sep).filter("first").orderBy("file").limit(1).collect()
        return top[0]["record"] if top else None
    return bytes(top[0]["record"]).decode("utf-8", "replace") if top else None


def records(spark: SparkSession, path: str | list[str], states: list[tuple], sep: str = ",") -> DataFrame:
    """file, first (a file's first record), record: every record that is not blank, with its line breaks."""
    cut = _cut(_lines(spark, path), states, sep)
    whole = cut.filter(F.col("kind") == WHOLE).select("file", "first", F.col("record").cast("string").alias("record"))
    if not any(o for _, _, o in states):
        return whole
    # Fragments in a file's order: an end before the start that the same split may hold too.
    order = Window.partitionBy("file").orderBy("start", "kind")
    parts = cut.filter(F.col("kind") != WHOLE).withColumn("begun", F.last(F.when(F.col("kind") == START, F.col("start")), ignorenulls=True).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.col("record").cast("string").alias("record")))), lambda x: x["record"]), "\n")
    joined = parts.groupBy("file", "begun").agg(F.bool_or("first").alias("first"), F.regexp_replace(text, "\r$", "").alias("record"))
    return whole.unionByName(joined.select("file", "first", "record"))
