"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: each row of the
index is one segment (about a MB of whole documents) with its term list, each
term's sorted positions and the documents' limits.  A search never reads the
texts again.  For each window of benchmark words it orders the terms from the
rarest in the corpus, takes the rarest one's positions less its offset in the
window as possible starts, and intersects them with the next terms' adjusted
positions until every word is confirmed.  Positions may differ by ``slack``
from their place in the window for proximity matches; 0 is the exact phrase.

Words: A-Z lower-cased, then runs of a-z, 0-9 and all code points from 0x80.

Defined results: a null or empty text has no words and no hits; benchmark
items without id or text, or without words, are left out; equal benchmark rows
count once; repeated document rows are reported each; an empty benchmark
leaves every document clean.  Windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tablelens.llm.frames import lists, pieces, release, stored

#: Words in a window; a shorter item is one window.
WINDOW = 10
#: Text bytes in an index segment (one document at least).
SEGMENT_BYTES = 1 << 20
#: Benchmark words that one search job broadcasts; a larger benchmark takes more jobs.
BLOCK_WORDS = 1_000_000
#: Possible starts that are checked at once.
STARTS = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: segment, keys, sizes (words of each document), terms, term_ends, positions.

    Documents in a segment are a position apart, so no phrase crosses them.
    """
    chosen = docs.select(key, F.col(text).cast("string").alias("__text"))
    kind = chosen.schema[0].dataType
    schema = StructType([StructField("segment", StringType()), StructField("keys", ArrayType(kind)), StructField("sizes", ArrayType(LongType(), False))] + [StructField(c, BinaryType()) for c in ("terms", "term_ends", "positions")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, 1, SEGMENT_BYTES):
                ids, found, sizes = _Ids(), [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    w = words(t) if t else []
                    found.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
                    sizes.append(len(w))
                tokens = np.concatenate(found)
                places = np.arange(len(tokens)) + np.repeat(np.arange(len(found)), sizes)
                positions = places[np.argsort(tokens, kind="stable")].astype("<i4")
                ends = np.cumsum(np.bincount(tokens, minlength=len(ids))).astype("<i4")
                row = [pa.array([f"{task}-{n}"]), lists_of(part.column(0)), lists(np.array(sizes, np.int64), np.array([len(sizes)]))]
                row += [pa.array([b], pa.binary()) for b in (b" ".join(ids), ends.tobytes(), positions.tobytes())]
                n += 1
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(row, arrow)], names=arrow.names)

    return stored(chosen.mapInArrow(run, schema))


def lists_of(values: pa.Array) -> pa.ListArray:
    """One row that lists all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def document_lengths(index: DataFrame) -> DataFrame:
    """segment, place, key and n_words of each indexed document row."""
    each = index.select("segment", F.posexplode(F.arrays_zip("keys", "sizes")).alias("place", "d"))
    return each.select("segment", "place", F.col("d.keys").alias("key"), F.col("d.sizes").alias("n_words"))


def windows(items: list[tuple[str, bytes]]) -> tuple[list[tuple[bytes, ...]], list[list[str]]]:
    """Distinct windows of the items' words, and for each the ids of its items."""
    owners: dict[tuple[bytes, ...], dict[str, None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + WINDOW]), {})[item] = None
    return list(owners), [list(x) for x in owners.values()]


def term_counts(index: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Corpus counts of the given terms (a bounded list), from the stored postings."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        wanted = {w: i for i, w in enumerate(sent.value)}
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = np.fromiter((wanted.get(w, -1) for w in terms.split()), np.int64)
                sizes = np.diff(np.frombuffer(ends, "<i4"), prepend=0)
                total[at[at >= 0]] += sizes[at >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    counted = index.select("terms", "term_ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.term]: r.n for r in counted}


def _plan(grams: list[tuple[bytes, ...]], counts: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Vocabulary, and for each window its terms and their offsets from the rarest on (-1: none)."""
    vocabulary = sorted({w for g in grams for w in g})
    number = {w: i for i, w in enumerate(vocabulary)}
    terms = np.full((len(grams), WINDOW), -1, np.int64)
    offsets = np.zeros((len(grams), WINDOW), np.int64)
    for i, g in enumerate(grams):
        order = sorted(range(len(g)), key=lambda j: (counts.get(g[j], 0), j))
        terms[i, : len(g)] = [number[g[j]] for j in order]
        offsets[i, : len(g)] = order
    return vocabulary, terms, offsets


def _starts(spot: np.ndarray, ends: np.ndarray, terms: np.ndarray, offsets: np.ndarray, slack: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and starts where they occur. ``spot``: term << 32 + position, sorted; ``ends``: each term's end in it."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = (ends - begins)[terms[:, 0]]
    present = (np.where(terms >= 0, (ends - begins)[terms], 1) > 0).all(axis=1)
    todo = np.flatnonzero(present)
    cut = np.searchsorted(np.cumsum(sizes[todo]), np.arange(STARTS, int(sizes[todo].sum()) + STARTS, STARTS))
    got_w, got_s = [], []
    for block in np.split(todo, np.unique(np.minimum(cut, len(todo)))):
        if not len(block):
            continue
        n = sizes[block]
        w = np.repeat(block, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[terms[w, 0]]
        s = (spot[at] & 0xFFFFFFFF) - offsets[w, 0]
        w, s = w[s >= 0], s[s >= 0]
        for r in range(1, WINDOW):
            t = terms[w, r]
            goal = (np.maximum(t, 0) << 32) + s + offsets[w, r]
            i = np.searchsorted(spot, goal - slack)
            near = spot[np.minimum(i, len(spot) - 1)]
            same = slack == 0 or np.searchsorted(limits, near & 0xFFFFFFFF, "right") == np.searchsorted(limits, s, "right")
            ok = (t < 0) | same & ((i < len(spot)) & (near >= goal - slack) & (near <= goal + slack))
            w, s = w[ok], s[ok]
        got_w.append(w)
        got_s.append(s)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *got_w]), np.concatenate([empty, *got_s])


def matches(index: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", slack: int = 0) -> DataFrame:
    """segment, place, items array<string>, froms, tos: for each document with matches the items and merged word spans.

    ``slack`` 0 finds exact phrases; else each word may be that far from its place (proximity).
    A large benchmark is searched in blocks; a document then has a row for each block.
    """
    chosen = items.select(F.col(item_key).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna().distinct()
    total = chosen.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    out = "segment string, place int, items array<string>, froms array<long>, tos array<long>"
    parts = []
    for k in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        grams, owners = windows([(r.item, r.text.encode()) for r in rows])
        counts = term_counts(index, sorted({w for g in grams for w in g}))
        parts.append(index.select("segment", "sizes", "terms", "term_ends", "positions").mapInArrow(_searcher(index, _plan(grams, counts), owners, slack), out))
    if not parts:
        return index.sparkSession.createDataFrame([], out)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _searcher(index: DataFrame, plan, owners: list[list[str]], slack: int):
    sent = index.sparkSession.sparkContext.broadcast((*plan, owners))

    def run(batches):
        release()
        vocabulary, terms, offsets, owners = sent.value
        number = {w: i for i, w in enumerate(vocabulary)}
        for b in batches:
            rows = []
            for segment, sizes, blob, ends, positions in zip(*(c.to_pylist() for c in b.columns)):
                found = segment_matches(sizes, blob, ends, positions, number, terms, offsets, slack)
                rows += [(segment, d, sorted({i for x in set(w) for i in owners[x]}), lo, hi) for d, w, lo, hi in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["segment", "place", "items", "froms", "tos"])

    return run


def segment_matches(sizes: list[int], blob: bytes, ends: bytes, positions: bytes, number: dict[bytes, int], terms: np.ndarray, offsets: np.ndarray, slack: int) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """Place of each document with matches, its windows, and its merged spans (words from the document's first)."""
    own = np.fromiter((number.get(w, -1) for w in blob.split()), np.int64)
    stops = np.frombuffer(ends, "<i4").astype(np.int64)
    places = np.frombuffer(positions, "<i4")
    n = np.diff(stops, prepend=0)
    of = np.repeat(own, n)
    keep = of >= 0
    spot = np.sort((of[keep] << 32) + places[keep])
    if not len(spot):
        return
    counts = np.zeros(len(number), np.int64)
    counts[own[own >= 0]] = n[own >= 0]
    limits = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])  # documents are a place apart
    w, s = _starts(spot, np.cumsum(counts), terms, offsets, slack, limits)
    if not len(w):
        return
    doc = np.searchsorted(limits, s, side="right") - 1
    length = (terms[w] >= 0).sum(axis=1)
    order = np.argsort(s, kind="stable")
    for d in np.unique(doc):
        mine = order[np.searchsorted(doc[order], d) : np.searchsorted(doc[order], d, side="right")]
        lo, hi = s[mine] - limits[d], np.minimum(s[mine] + length[mine], limits[d + 1] - 1) - limits[d]
        new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])
        yield int(d), w[mine].tolist(), lo[new].tolist(), np.maximum.reduceat(hi, np.flatnonzero(new)).tolist()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", slack: int = 0) -> DataFrame:
    """key, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    index = build_index(docs, key, text)
    by_doc = matches(index, items, item_key, slack=slack).groupBy("segment", "place").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("froms", "tos")))).alias("spans"),
    )
    # Words that spans cover: each adds what lies beyond all spans before it.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["tos"] - F.greatest(a["to"], x["froms"]))).alias("n"), F.greatest(a["to"], x["tos"]).alias("to")),
    )["n"]
    whole = document_lengths(index).join(by_doc, ["segment", "place"], "left")
    hit = F.coalesce(covered, F.lit(0).cast("long"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        F.col("key").alias(key), F.col("n_words").cast("long"), hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
