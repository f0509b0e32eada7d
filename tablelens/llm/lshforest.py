"""Near duplicates by an LSH forest over MinHash signatures.

Every tree orders the distinct texts by a sequence of MinHash values.  Rows
are range-partitioned and sorted by the whole sequence, so a large group of
near copies spreads over tasks.  Candidates are the neighbours with the
longest common prefixes: each row pairs with its ``NEIGHBOURS`` successors
while they share ``LEAST_DEPTH`` values, so the depth of a pair's prefix adapts
to its region: long in a dense one, short in a sparse one.  In a region each row
also pairs with the region's first row, which keeps large groups connected by
stars.

Those are the first candidates only.  Rows of a region (``LEAST_DEPTH`` equal
values in a tree) that are still in different components are all compared
then, however many they are: they are dealt to blocks, and each task compares
the parity bitmaps of its block.  An element that two sets do not share flips
one bit, so the bits in which two bitmaps differ are at most the elements in
which the sets do; a pair with too many cannot be linked, and no link is lost.
Only what passes leaves the task: first the closest row of each other
component, then all of what is still apart.

Texts with equal shingle sets form one class first, so copies cost nothing
more.  Candidates are confirmed on full sets, each row's best first; pairs
whose ends are connected by then need no confirmation, so a group of near
copies is never compared all with all.  Classes are connected by alternating large and
small stars (Kiveris et al. 2014) as Spark joins.

Links are between rows of the input, numbered once and stored; keys are only
reported.  Tables that cut lineage are deleted when nothing reads them any more.

Words: A-Z lower-cased, split at white space.  A set: the distinct shingles of
``size`` words; fewer words make one shingle of all.

Defined results: a null, empty or blank text has no set (``n_shingles`` 0), is
linked with nothing and kept; repeated rows and equal texts fall into one
component; extra columns are not read.  Keys are integers; rows with a null
key take part, but a component's id is its smallest non-null key.  Rows that
share a key but not their text are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from tablelens.llm.frames import ROW, discard, lists, map_text, stored, with_rows, without

TREES, DEPTH = 12, 8
LEAST_DEPTH, NEIGHBOURS = 3, 8
#: Percent of the union that linked sets share.
SIMILARITY = 80
#: Candidates of each row that are confirmed before the rest.
FIRST_PARTNERS = 3
#: Rows on a side of the blocks that a region is dealt to, and shingles in their sets, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 16_000_000
#: Rows of partitions' ends that one task takes.
BORDER_ROWS = 100_000
CACHED_WORDS = 400_000
#: Ids of candidates that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()


def shingle_set(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    x = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        x = _mixed(x) + h[i : len(h) - size + 1 + i]
    return np.unique(_mixed(x))


def minhash_functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the multiply-shift functions, from a fixed seed."""
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function over the set."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, ((x[i : i + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return best.astype(">u4")


def parity(x: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each element flips one bit. Its length, at least 8 bits an element, is a power of two."""
    bits = 64 << max(0, (len(x) - 1).bit_length() - 3)
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def signatures(docs: DataFrame, key: str, text: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, n (set size), class (128-bit digest of the set), sig (all trees' values), bits (parity bitmap)."""
    out = StructType().add("n", LongType()).add("class", BinaryType()).add("sig", BinaryType()).add("bits", BinaryType())

    def make():
        a, b = minhash_functions()
        hashes = _Hashes()

        def work(column: pa.Array):
            ns, classes, sigs, bits = [], [], [], []
            for t in column.cast(pa.binary()).to_pylist():
                x = shingle_set(t, size, hashes) if t else np.zeros(0, np.uint64)
                ns.append(len(x))
                classes.append(_digest(x) if len(x) else None)
                sigs.append(signature(x, a, b).tobytes() if len(x) else b"")
                bits.append(parity(x).tobytes() if len(x) else b"")
            hashes.trim()
            return ns, classes, sigs, bits

        return work

    return map_text(docs, text, out, make, (F.col(key).alias("id"), *carry))


def _digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def shingle_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """class, grams (the whole set)."""

    def make():
        hashes = _Hashes()

        def work(column: pa.Array):
            sets = [shingle_set(t or b"", size, hashes) for t in column.cast(pa.binary()).to_pylist()]
            hashes.trim()
            return [list(map(_digest, sets)), lists(np.concatenate(sets).view(np.int64), np.cumsum([len(x) for x in sets]))]

        return work

    return map_text(docs, text, StructType().add("class", BinaryType()).add("grams", ArrayType(LongType(), False)), make, ())


def neighbours(trees: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """a, b, score: pairs of rows (tree, sig, id, n) that stand near each other in trees' orders.

    The score sums the common prefixes over the trees.  Pairs whose sizes differ too much for a link are left out.
    The rows at partitions' ends go through the same pass again, in fewer and fewer partitions, until one holds all that is left.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the next batch must still see: the last rows, and the first row of the region they are in.
        t, s = np.zeros(0, np.int32), np.zeros((0, DEPTH), np.uint32)
        i, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        head = None
        first: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(i)
            t = np.concatenate([t, batch.column(0).to_numpy()])
            s = np.concatenate([s, np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)])
            i, n = np.concatenate([i, batch.column(2).to_numpy()]), np.concatenate([n, batch.column(3).to_numpy()])
            if not first:
                first = list(zip(t, s, i, n))[:NEIGHBOURS]
            same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])[:, None]
            lcp = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)  # of each row and its successor
            start = np.append(True, lcp < LEAST_DEPTH)
            lead = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            lead_i, lead_n = i[lead], n[lead]
            if head is not None:  # the region that began in an earlier batch
                lead_i[lead == 0], lead_n[lead == 0] = head
            at = np.arange(old, len(i))
            pairs = [(lead_i[at], i[at], np.full(len(at), LEAST_DEPTH), lead_n[at], n[at])]
            shared = lcp
            for j in range(1, min(NEIGHBOURS, len(i) - 1) + 1):
                if j > 1:
                    shared = np.minimum(shared[:-1], lcp[j - 1 :])
                at = np.flatnonzero(shared >= LEAST_DEPTH)
                at = at[at + j >= old]  # the others were made with the batch before
                pairs.append((i[at], i[at + j], shared[at], n[at], n[at + j]))
            head = lead_i[-NEIGHBOURS:][0], lead_n[-NEIGHBOURS:][0]
            t, s, i, n = t[-NEIGHBOURS:], s[-NEIGHBOURS:], i[-NEIGHBOURS:], n[-NEIGHBOURS:]
            a, b, d, x, y = (np.concatenate(c) for c in zip(*pairs))
            ok = (a != b) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            a, b, d = a[ok], b[ok], d[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d, pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=names)
        border = {int(x[2]) + (int(x[0]) << 64): x for x in [*first, *zip(t, s, i, n)]}.values()
        if border:  # for the pairs that two partitions share
            yield pa.RecordBatch.from_arrays([pa.array([int(x[2]) for x in border]), pa.nulls(len(border), pa.int64()), pa.array([int(x[3]) for x in border]), pa.array([int(x[0]) for x in border], pa.int32()), pa.array([x[1].astype(">u4").tobytes() for x in border], pa.binary())], names=names)

    names = ["a", "b", "depth", "tree", "sig"]
    out = "a long, b long, depth long, tree int, sig binary"
    order = ("tree", "sig", "id")
    tasks = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, passes = trees.select(*order, "n"), []
    while True:
        passes.append(stored(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, out)))
        if tasks == 1:
            break
        rows = passes[-1].filter("b is null").select("tree", "sig", F.col("a").alias("id"), F.col("depth").alias("n"))
        tasks = max(1, min(tasks // 2, -(-2 * NEIGHBOURS * tasks // BORDER_ROWS)))
    pairs = passes[0]
    for p in passes[1:]:
        pairs = pairs.unionByName(p)
    made = stored(pairs.filter("b is not null").groupBy("a", "b").agg(F.sum("depth").alias("score")))
    discard(*passes)
    return made


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) of a shorter length: halves laid over each other."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def close_pairs(strays: tuple, others: tuple, most: int | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, apart: strays and rows of other components that the bitmaps cannot tell to be unlinked.

    Either side is (ids, sizes, roots, bitmaps as bytes).  With ``most``, that many of each stray and component, the closest first.
    """
    ids, sizes, roots, blobs = others
    width = np.array([len(x) // 8 for x in blobs])
    groups = [(w, np.flatnonzero(width == w)) for w in np.unique(width)]
    stacks = {w: np.frombuffer(b"".join(blobs[i] for i in at), np.uint64).reshape(-1, w) for w, at in groups}
    made = []
    for i, n, root, blob in zip(*strays):
        own = np.frombuffer(blob, np.uint64)[None, :]
        for w, at in groups:
            ok = (roots[at] != root) & (100 * np.minimum(sizes[at], n) >= percent * np.maximum(sizes[at], n))
            if not ok.any():
                continue
            least = min(w, own.shape[1])
            apart = np.bitwise_count(_folded(stacks[w][ok], least) ^ _folded(own, least)).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (sizes[at[ok]] + n)
            made.append((np.full(near.sum(), i), at[ok][near], apart[near]))
    if not made:
        return (np.zeros(0, np.int64),) * 3
    a, at, apart = (np.concatenate(c) for c in zip(*made))
    if most is not None:
        order = np.lexsort((ids[at], apart, roots[at], a))
        a, at, apart = a[order], at[order], apart[order]
        new = np.append(True, (a[1:] != a[:-1]) | (roots[at][1:] != roots[at][:-1])) if len(a) else np.zeros(0, bool)
        nth = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        a, at, apart = a[nth < most], at[nth < most], apart[nth < most]
    return a, ids[at], apart


def region_candidates(trees: DataFrame, found: DataFrame, bitmaps: DataFrame, most: int | None, percent: int = SIMILARITY) -> DataFrame:
    """a, b: pairs of rows (tree, sig, id, n) of one region, in different components (id, root), that their bitmaps (id, bits) allow a link.

    A region's strays, its rows outside the component that has most of them, meet every row of the
    region, block by block; see ``close_pairs`` for ``most``.
    """
    region = F.xxhash64("tree", F.substring("sig", 1, 4 * LEAST_DEPTH)).alias("region")
    rows = stored(trees.select(region, "id", "n").join(found, "id", "left").select("region", "id", "n", F.coalesce("root", "id").alias("root")))
    counts = rows.groupBy("region", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK_ROWS, n / BLOCK_SHINGLES, F.lit(1)))
    main = F.max(F.struct("rows", "root", "n"))
    mixed = counts.groupBy("region").agg(main.alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1").select(
        "region", F.col("main.root").alias("main"), blocks(F.col("rows"), F.col("n")).alias("wide"), blocks(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("high"))
    some = stored(rows.join(mixed, "region"))
    known = bitmaps.join(few(some.select("id")), "id", "left_semi")
    whole = some.join(known, "id")
    dealt = lambda side, own, own_blocks, other, other_blocks: side.select(
        "region", F.pmod(F.xxhash64("id"), F.col(own_blocks)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1)).alias(other), F.lit(own == "y").alias("stray"), "id", "n", "root", "bits")
    both = dealt(whole.filter("root <> main"), "y", "high", "x", "wide").unionByName(dealt(whole, "x", "wide", "y", "high"))

    def compare(block: pa.Table) -> pa.Table:
        ids, n, root = (block.column(c).to_numpy() for c in ("id", "n", "root"))
        bits, stray = block.column("bits").to_pylist(), block.column("stray").to_numpy()
        side = lambda at: (ids[at], n[at], root[at], [bits[i] for i in at])
        a, b, apart = close_pairs(side(np.flatnonzero(stray)), side(np.flatnonzero(~stray)), most, percent)
        return pa.table({"a": a, "b": b, "apart": apart})

    pairs = both.groupBy("region", "x", "y").applyInArrow(compare, "a long, b long, apart long")
    if most is not None:  # the closest of all regions and blocks
        root_b = found.select(F.col("id").alias("b"), "root")
        nth = F.row_number().over(Window.partitionBy("a", F.coalesce("root", "b")).orderBy("apart", "b"))
        pairs = pairs.distinct().join(root_b, "b", "left").withColumn("nth", nth).filter(F.col("nth") <= most)
    out = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(rows, some)
    return out


def few(ids: DataFrame) -> DataFrame:
    """Distinct ids, to be broadcast if they are few; beyond that the join is shuffled."""
    some = stored(ids.distinct())
    return F.broadcast(some) if some.count() <= BROADCAST_IDS else some


def ends_of(pairs: DataFrame) -> DataFrame:
    """The ids in pairs, each at most twice."""
    return pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets share at least that percent of their union."""
    some = sets.join(few(ends_of(pairs)), "id", "left_semi")
    ends = pairs.select("a", "b").join(some.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(some.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return ends.filter(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, root: every linked id and the smallest id that it can reach."""
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # Large star: larger neighbours of a node move to its smallest neighbour.
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        made = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        after = stored(made.filter("u < v").distinct())
        same = after.join(edges, ["v", "u"], "left_anti").isEmpty() and edges.join(after, ["v", "u"], "left_anti").isEmpty()
        discard(edges)
        edges = after
        if same:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, row, n, best: the first row (keyless, id, row) of the row's component, null for rows without a set."""
    rows = stored(signatures(docs, key, text, size, carry).withColumn("row", F.monotonically_increasing_id()))
    # A class: rows of one set. The first by key stands for it.
    head = F.min(F.struct(F.col("id").isNull().alias("keyless"), "id", "row")).alias("head")
    classes = stored(rows.filter("class is not null").groupBy("class").agg(head, F.first("sig").alias("sig"), F.first("n").alias("n")))
    parts = [F.struct(F.lit(t).alias("tree"), F.substring("sig", 1 + 4 * DEPTH * t, 4 * DEPTH).alias("sig")) for t in range(TREES)]
    trees = classes.select(F.col("head.row").alias("id"), "n", F.explode(F.array(*parts)).alias("x")).select("x.tree", "x.sig", "id", "n")
    left = neighbours(trees, percent)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of the candidates alone, from their texts."""
        wanted = stored(classes.select("class", "head").join(few(ends_of(pairs)), F.col("head.row") == F.col("id"), "left_semi").select("class", F.col("head.id").alias("key"), F.col("head.row").alias("id")))
        hint = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
        texts = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(hint(wanted.select("key").distinct()), F.col("of").eqNullSafe(F.col("key")), "left_semi")
        made = shingle_sets(texts, "text", size).join(hint(wanted.select("class", "id")), "class").select("id", "grams")
        return stored(made.dropDuplicates(["id"]))

    sets = sets_of(left)
    # Each row's best partners first; then, of all the others, what joins different components.
    both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    best = both.withColumn("nth", nth).filter(F.col("nth") <= FIRST_PARTNERS)
    tried = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(confirmed(tried, sets, percent))
    found = stored(components(links))
    root = lambda c: found.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    others = left.join(tried, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = stored(others.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))
    links = stored(links.unionByName(confirmed(apart, sets, percent)))
    discard(sets, left)
    ends = stored(components(links))
    tried = tried.unionByName(apart)
    # What the windows left out: first the closest of each other component, then all that is still apart.
    for most in (1, None):
        near = region_candidates(trees, ends, rows.select(F.col("row").alias("id"), "bits"), most, percent)
        fresh = stored(near.join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            sets = sets_of(fresh)
            links = stored(links.unionByName(confirmed(fresh, sets, percent)))
            discard(sets)
            ends = stored(components(links))
            tried = tried.unionByName(fresh)
    heads = classes.select("class", "head")
    linked = heads.join(ends, F.col("head.row") == F.col("id")).select("class", "head", "root")
    merged = linked.join(linked.groupBy("root").agg(F.min("head").alias("best")), "root").select("class", "best")
    whole = heads.join(merged, "class", "left").select("class", F.coalesce("best", "head").alias("best"))
    out = stored(rows.select("id", *carry, "row", "n", "class").join(whole, "class", "left").drop("class"))
    discard(rows, classes)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """key, n_shingles, component_id (smallest key of the component), kept (key = component_id)."""
    group = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    out = _grouped(docs, key, text, size, percent)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("id") == group, group.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """The documents with one row of each component: that of its smallest key, or any where no row has one.

    Rows without words stay, but of those that share a key one does.
    """
    rows = with_rows(docs)
    found = _grouped(rows, key, text, size, percent, (ROW,))
    copies = found.filter(F.col("row") != F.col("best.row")).select(ROW)
    bare = found.filter("best is null and id is not null")
    first = bare.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    return without(rows, copies.unionByName(bare.join(first, "id").filter("row <> first").select(ROW)), ROW)
