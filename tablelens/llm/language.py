"""Language identification by cross-parsing entropy.

For each language a suffix automaton over labelled text finds, from any place
of a new text, the longest piece that occurs in the training text.  The text
is cut greedily into such phrases; few, long phrases mean a familiar language.
The number of phrases, times the bits that one phrase takes in that language's
training text, per byte, is the cross-entropy estimate of Ziv and Merhav
(1993); the language with the smallest one wins.

The automata become dense tables (state x byte class), so that numpy parses
thousands of text rows in step.  Long texts take several rows; every byte is
parsed.

Texts are folded: lower case, UTF-8 bytes, ASCII non-letters as one space.
Training takes a bounded sample: ``SAMPLE_ROWS`` rows a language in the order
of a hash of the key, and of each an excerpt of ``EXCERPT`` characters at a
hashed place.  Every text is classified whole.

Defined results: ``und`` with score 0 for a null text or one without a letter,
or where nothing could be learned; ties go to the alphabetically first
language; repeated rows are classified each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tablelens.llm.frames import map_text

SAMPLE_ROWS, EXCERPT = 80, 500
ROW = 128
#: Bytes beyond which a longer text gives no more certainty.
SURE_BYTES = 24

_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "ignore").translate(_FOLD).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states; from state 0 exactly the substrings of the text can be read."""
    edges: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # the strings of q up to that length end elsewhere too: they get a state of their own
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


def parse_table(text: bytes, classes: np.ndarray, width: int) -> np.ndarray:
    """Flat table: at state * width + class, 2 * (next state * width) + (1 if a phrase ends before the byte).

    The last class pads rows and changes nothing; the one before is for bytes never seen.
    """
    edges = suffix_automaton(text)
    alone = len(edges)  # after a byte that the text lacks, which is a phrase of its own
    table = np.full((alone + 1, width), -1, np.int64)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, classes[c]] = to
    ends = table < 0
    ends[0] = False  # a row starts its first phrase there
    afresh = np.where(table[0] < 0, alone, table[0])
    table = np.where(table < 0, afresh[None, :], table) * width * 2 + ends
    table[:, width - 1] = np.arange(alone + 1) * width * 2
    return table.astype(np.int32).ravel()


def train(rows: list[tuple[str, str]]) -> dict:
    """Model from (language, text) rows."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if piece := fold(text):
            texts.setdefault(lang, []).append(piece)
    whole = {lang: b"\n".join(texts[lang]) for lang in sorted(texts)}  # the folded bytes hold no line feed
    seen = sorted(set(b"".join(whole.values())))
    width = len(seen) + 2
    classes = np.full(256, width - 2, np.int64)
    classes[seen] = np.arange(len(seen))
    return {
        "langs": list(whole),
        "classes": classes.astype(np.uint8 if width < 256 else np.uint16),
        "width": width,
        "tables": [parse_table(t, classes, width) for t in whole.values()],
        "bits": np.array([np.log2(len(t) + 2) for t in whole.values()]),
    }


def phrases(model: dict, texts: list[bytes]) -> np.ndarray:
    """Number of phrases of each (non-empty) text in each language."""
    pad = model["width"] - 1
    counts = [-(-len(t) // ROW) for t in texts]
    cells = np.full(sum(counts) * ROW, pad, np.int32)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]]) * ROW
    sizes = np.array([len(t) for t in texts])
    at = np.arange(sizes.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    cells[at] = model["classes"][np.frombuffer(b"".join(texts), np.uint8)]
    columns = np.ascontiguousarray(cells.reshape(-1, ROW).T)
    out = []
    for table in model["tables"]:
        state = np.zeros(columns.shape[1], np.int32)
        ended = np.ones(columns.shape[1], np.int32)
        for c in columns:
            state += c
            step = table.take(state)
            ended += step & 1
            state = step >> 1
        out.append(np.add.reduceat(ended, begins // ROW))
    return np.stack(out, axis=1)


def classify(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model["langs"]:
        return langs, scores
    folded = {i: f for i, t in enumerate(texts) if t and any(map(str.isalpha, t)) and (f := fold(t))}
    if folded:
        sizes = np.array([len(f) for f in folded.values()])
        rate = phrases(model, list(folded.values())) * model["bits"] / sizes[:, None]
        best = rate.argmin(axis=1)
        odds = 2.0 ** ((rate.min(axis=1, keepdims=True) - rate) * np.minimum(sizes, SURE_BYTES)[:, None])
        sure = 1 / odds.sum(axis=1)
        for i, b, s in zip(folded, best, sure):
            langs[i], scores[i] = model["langs"][b], float(s)
    return langs, scores


def sample(docs: DataFrame, allowed: Column, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS, excerpt: int = EXCERPT) -> list[tuple[str, str]]:
    """The bounded training sample. Only keys and languages are ranked; texts are read for the chosen keys alone."""
    order = F.xxhash64(F.col(key).cast("string"))
    names = docs.filter(allowed & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"))
    ranked = names.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64(F.col("k").cast("string")), "k")))
    chosen = ranked.filter(F.col("r") <= rows).select("k").distinct()
    at = F.pmod(order, F.greatest(F.lit(1), F.length(text) - excerpt)).cast("int") + 1
    found = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = found.select(F.col(lang).alias("l"), F.col(text).substr(at, F.lit(excerpt)).alias("t"), F.col(key).alias("k"))
    got = found.join(F.broadcast(chosen), "k", "left_semi").orderBy("l", "k", "t").collect()
    return [(r.l, r.t) for r in got]


def languages(docs: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang_pred, score. ``allowed``: which rows may teach."""
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(docs, allowed, key, text, lang)))

    def make():
        return lambda column: classify(sent.value, column.to_pylist())

    return map_text(docs, text, StructType().add("lang_pred", StringType()).add("score", DoubleType()), make, (key,))


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the key as text leaves that remainder."""
    return F.crc32(F.col(key).cast("string")) % parts == part
