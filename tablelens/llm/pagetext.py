"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags,
with the path of open tags.  Each block is a vector of hashed path words,
hashed text words and a few counts.  A bidirectional LSTM in numpy reads the
whole sequence, so a block's label depends on the page's other blocks, and
says of each block whether it belongs to the article.

The labeller is trained on a bounded sample of pages (``SAMPLE_PAGES``, in the
order of a hash of the key).  Blocks are labelled by the pages' own semantic
tags, and the same blocks are laid out again in varied page frames (other
containers, side bars, notices, forms, comments) in which some paths are
hidden, so that words and neighbours count.  Extraction reads every page whole.

Defined results: a null or empty page, and one without an article block, gives
an empty text; unclosed or stray tags are tolerated; without any training page
the frames are filled with a few fixed words; repeated rows are read each.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tablelens.llm.frames import map_text

SAMPLE_PAGES = 150
PATH_DIMS, WORD_DIMS, COUNTS, HIDDEN = 96, 48, 9, 16

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>"""
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.I | re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Elements that stay inside a block, those not shown, and those without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
UNSHOWN = frozenset("noscript template svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags and words of their class, id and role, from the outermost
    linked: float  # share of the text inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with decoded references and single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = linked = 0
    at = 0
    dark: int | None = None  # place in the stack of the element that is not shown

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, tuple(w for _, words in stack for w in words), min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                links -= sum(n == "a" for n, _ in stack[i:])
                del stack[i:]
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece and dark is None:
            text.append(piece)
            if links:
                linked += len(piece)

    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:  # comments, declarations and elements without shown text
            continue
        ends = bool(m[2] or m[5])
        if dark is not None:
            if not ends:
                if name not in VOID:
                    stack.append((name, ()))
                    links += name == "a"
                continue
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is None:
                continue
            if i >= dark:
                close(name)
                dark = None if i == dark else dark
                continue
            dark = None  # never closed: it ends with its parent
        if name in UNSHOWN:
            if not ends and not m[0].endswith("/>"):
                dark = len(stack)
                stack.append((name, ()))
            continue
        if name == "head":  # what it holds is not shown, and its end may be left out
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name not in VOID:
                if ends:
                    close(name)
                else:
                    stack.append((name, _tokens(name, m[4] or m[7] or "")))
                    links += name == "a"
            continue
        flush()
        if ends:
            close(name)
            continue
        if any(n == "p" for n, _ in stack):  # a block element ends an open paragraph
            close("p")
        if name == "li" and stack and stack[-1][0] == "li":
            close("li")
        if name not in VOID:
            stack.append((name, _tokens(name, m[4] or m[7] or "")))
    add(page[at:])
    flush()
    return out


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (name,)
    return (name, *("." + w for m in _NAMES.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())))


class _Places(dict):
    """Word -> dimension by a hash."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        d = zlib.crc32(word.lower().encode("utf-8", "ignore")) % self.size
        if len(self) < 200_000:
            self[word] = d
        return d


def vectors(page: list[Block], places: tuple[_Places, _Places], hidden: bool = False) -> np.ndarray:
    """One row a block: path words, text words, counts."""
    x = np.zeros((len(page), PATH_DIMS + WORD_DIMS + COUNTS), np.float32)
    place = places[1].__getitem__
    for i, b in enumerate(page):
        if not hidden:
            x[i, list(map(places[0].__getitem__, b.path))] = 1
        words = b.text.split()
        found = np.bincount(np.fromiter(map(place, words), np.intp, len(words)), minlength=WORD_DIMS)
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(found / len(words))
        n = len(b.text)
        x[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked, b.text[-1] in ".!?:;\"”»", sum(map(b.text.count, ".,;")) / len(words),
            sum(map(str.isupper, words)) / len(words), i / len(page), np.log1p(len(page)) / 6, "©" in b.text or "(c)" in b.text,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = PATH_DIMS + WORD_DIMS + COUNTS
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN)).astype(np.float32)
        w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"c{d}"] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)  # forget gates start open
    w["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def read(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of one direction; masked steps keep the state."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    inputs = x @ w["x" + d] + w["c" + d]
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), [None] * steps
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = inputs[t] + h @ w["h" + d]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        fresh = f * c + i * g
        tape[t] = (i, f, o, g, c, np.tanh(fresh), h, m)
        h, c = m * (o * tape[t][5]) + (1 - m) * h, m * fresh + (1 - m) * c
        out[t] = h
    return out, tape


def learn_back(w: dict[str, np.ndarray], x: np.ndarray, d: str, tape: list, slopes: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction from those of its hidden states (back-propagation through time)."""
    steps, n, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    dw = np.zeros_like(w["h" + d])
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        i, f, o, g, c, tc, h, m = tape[t]
        dh = dh + slopes[t]
        dnew = m * dh
        dfresh = m * dc + dnew * o * (1 - tc * tc)
        dz[t] = np.concatenate([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), dnew * tc * o * (1 - o), dfresh * i * (1 - g * g)], axis=1)
        dw += h.T @ dz[t]
        dh, dc = (1 - m) * dh + dz[t] @ w["h" + d].T, (1 - m) * dc + dfresh * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return {"x" + d: x.reshape(len(flat), -1).T @ flat, "h" + d: dw, "c" + d: flat.sum(axis=0)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 8, batch: int = 32) -> dict[str, np.ndarray]:
    """Weights from (vectors, labels) of pages, by Adam on the cross-entropy of the blocks."""
    rng = np.random.default_rng(7)
    w = start_weights(rng)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
            x, mask = padded([pages[k][0] for k in some])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(some):
                y[: len(pages[k][1]), j] = pages[k][1]
            (hf, tf), (hb, tb) = (read(w, x, mask, d) for d in "fb")
            both = np.concatenate([hf, hb], axis=2)
            wrong = mask * (_sigmoid(both @ w["out"] + w["bias"]) - y) / mask.sum()
            slopes = wrong[:, :, None] * w["out"]
            grads = learn_back(w, x, "f", tf, slopes[:, :, :HIDDEN]) | learn_back(w, x, "b", tb, slopes[:, :, HIDDEN:])
            grads |= {"out": np.einsum("tn,tnh->h", wrong, both), "bias": wrong.sum(keepdims=True).ravel()}
            step += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] -= 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return w


def probabilities(w: dict[str, np.ndarray], pages: list[np.ndarray], cells: int = 8192) -> list[np.ndarray]:
    """Probability of each block; pages of like length are read together, each to its end."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    while order:
        n = max(1, min(len(order), cells // len(pages[order[-1]])))
        some, order = order[-n:], order[:-n]
        x, mask = padded([pages[i] for i in some])
        both = np.concatenate([read(w, x, mask, d)[0] for d in "fb"], axis=2)
        p = _sigmoid(both @ w["out"] + w["bias"])
        for j, i in enumerate(some):
            out[i] = p[: len(pages[i]), j]
    return out


#: Path words that mark an article, or what is not part of one, where a page uses them.
ARTICLE = frozenset(("article", "main", ".article", ".articlebody", ".post", ".entry", ".story"))
APART = frozenset("nav header footer aside form button menu dialog .ad .ads .advert .nav .menu .header .footer .sidebar .cookie .notice .banner .comment .comments .related .share .promo .breadcrumb .newsletter .subscribe".split())


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks inside the page's own article tag, else 0; None if it has no such tag."""
    y = np.array([bool(ARTICLE.intersection(b.path)) and not APART.intersection(b.path) for b in page], np.float32)
    return y if len(page) and 0 < y.sum() else None


def frames(rng: np.random.Generator, article: list[str], other: list[str]) -> str:
    """A page in a frame of varied containers around the given blocks."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda k: [other[j] for j in rng.integers(len(other), size=rng.integers(1, k + 1))]
    esc = entities.escape
    ps = lambda xs, tag="p": "".join(f"<{tag}>{esc(x)}</{tag}>" for x in xs)
    short = lambda k: [" ".join(x.split()[: rng.integers(1, 5)]) for x in some(k)]
    links = lambda k: "<ul>" + "".join(f'<li><a href="#">{esc(x)}</a></li>' for x in short(k)) + "</ul>"
    opening, closing = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<section class="post-body">', "</section>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"))
    before = [
        lambda: f"<nav>{links(8)}</nav>", lambda: f'<div class="menu">{links(8)}</div>', lambda: f"<header>{ps(short(2), pick('div', 'p', 'h2'))}{links(4)}</header>",
        lambda: f'<div class="{pick("ad", "advert", "ad-banner", "promo")}">{ps(some(1), pick("p", "div", "span"))}</div>', lambda: f'<div class="{pick("cookie-notice", "notice", "banner")}">{ps(some(2))}<button>OK</button></div>',
        lambda: f'<div class="breadcrumb">{links(4)}</div>', lambda: f'<aside class="sidebar">{ps(some(2))}{links(6)}</aside>', lambda: f'<form action="#"><label>{esc(short(1)[0])}</label><input><button>{esc(short(1)[0])}</button></form>',
    ]
    after = [
        lambda: f'<section class="{pick("comments", "comment-list", "responses")}"><h3>Comments</h3>' + "".join(f'<div class="comment"><b>{esc(short(1)[0])}</b><p>{esc(x)}</p></div>' for x in some(5)) + "</section>",
        lambda: f'<div class="related"><h4>{esc(short(1)[0])}</h4>{links(6)}</div>', lambda: f'<aside>{ps(some(3))}</aside>', lambda: f'<div class="{pick("sidebar", "widget", "share")}">{links(5)}{ps(some(1))}</div>',
        lambda: f'<form class="newsletter"><p>{esc(some(1)[0])}</p><input><button>{esc(short(1)[0])}</button></form>', lambda: f'<div class="ad">{esc(some(1)[0])}</div>',
    ]
    choose = lambda xs: "".join(xs[j]() for j in rng.permutation(len(xs))[: rng.integers(0, 4)])
    inner = "".join(("<h1>" if j == 0 else "<p>") + esc(x) + ("</h1>" if j == 0 else "</p>") + (f'<div class="ad">{esc(some(1)[0])}</div>' if rng.random() < 0.05 else "") for j, x in enumerate(article))
    foot = pick("<footer>&copy; {}</footer>", '<div class="footer"><p>{}</p></div>', '<div id="footer">&copy; {}</div>', "")
    return f"<html><body>{choose(before)}{opening}{inner}{closing}{choose(after)}{foot.format(esc(some(1)[0]))}</body></html>"


def train(pages: list[str]) -> dict[str, np.ndarray]:
    """Weights of the labeller from the sample."""
    rng = np.random.default_rng(11)
    places = (_Places(PATH_DIMS), _Places(WORD_DIMS))
    seen = [(b, y) for b in map(blocks, pages) if (y := weak_labels(b)) is not None]
    articles = [[b.text for b, k in zip(page, y) if k] for page, y in seen] or [["A first line.", "Some words of a text."]]
    other = [b.text for page, y in seen for b, k in zip(page, y) if not k] or ["Home", "All rights reserved."]
    rows = [(vectors(b, places, hidden), y) for b, y in seen for hidden in (False, rng.random() < 0.3)]
    pool = [t for a in articles for t in a]
    for a in articles * 3:
        a = a[:40]
        made = blocks(frames(rng, a, other + [pool[j] for j in rng.integers(len(pool), size=5)]))
        left = list(a)
        y = []
        for b in made:  # the article's blocks come in order; others may hold like text before and after it
            inside = bool(left) and b.text == left[0] and (len(left) < len(a) or b.path[-1] == "h1")
            y.append(float(inside))
            if inside:
                left.pop(0)
        rows.append((vectors(made, places, rng.random() < 0.15), np.array(y, np.float32)))
    return fit([(x[:80], y[:80]) for x, y in rows if len(x)])


def extract(w: dict[str, np.ndarray], pages: list[str | None], places: tuple[_Places, _Places]) -> list[str]:
    """Article text of each page."""
    cut = [blocks(p) if p else [] for p in pages]
    chances = probabilities(w, [vectors(b, places) for b in cut])
    return ["\n".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(cut, chances)]


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the carried columns, text, n_chars."""
    ids = pages.select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(SAMPLE_PAGES)
    known = pages.filter(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"))
    rows = known.join(F.broadcast(ids), "k", "left_semi").orderBy(F.xxhash64(F.col("k").cast("string")), "k", "h").limit(SAMPLE_PAGES).select("h").collect()
    sent = pages.sparkSession.sparkContext.broadcast(train([r[0] for r in rows]))

    def make():
        places = (_Places(PATH_DIMS), _Places(WORD_DIMS))

        def work(column: pa.Array) -> Iterator:
            texts = extract(sent.value, column.to_pylist(), places)
            return texts, [len(t) for t in texts]

        return work

    return map_text(pages, html, StructType().add("text", StringType()).add("n_chars", LongType()), make, (key, *carry))
