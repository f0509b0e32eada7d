import numpy as np
import pytest
from llm_fixtures import SF_SMALL  # noqa: F401

from pyspark.sql import functions as F

from tablelens.llm import pagetext as P


def test_blocks():
    page = '<html><head><title>T</title></head><body><script>var a="</p>";</script><nav><a href=x>Home</a></nav><!-- x --><div class="ad top">Buy</div><article><h1>A &amp;\n B</h1><p><b>one<br>two&nbsp; three<p>x</article> tail'
    found = P.blocks(page)
    assert [b.text for b in found] == ["Home", "Buy", "A & B", "one two three", "x", "tail"]
    assert found[0].linked == 1 and ".ad" in found[1].path and found[4].path[-2:] == ("article", "p")
    assert P.blocks("<p>a < b and <3 <p class='x>y'>z") and P.blocks("<<<>>>&#x0;") is not None


def test_elements_without_an_end():
    words = lambda page: [b.text for b in P.blocks(page)]
    assert words("<html><head><title>t</title><body><article><p>Hello there</p></article></body></html>") == ["Hello there"]
    assert words("<html><head><meta charset=x><title>t</title><p>First</p><p>Second") == ["First", "Second"]
    assert words("<div><p>One</p><noscript>Not shown<p>nor this</div><p>Two</p>") == ["One", "Two"]
    assert words("<p>A <svg><g><title>x</title><text>no</text></g></svg> line</p><svg/><p>Next</p>") == ["A line", "Next"]
    assert words("<p>Take <select><option>1<option>2</select> of them</p></select><template><p>no</p></template><p>End</p>") == ["Take of them", "End"]
    assert words("<div><a href=x>Go <svg><a>no</a></div><p>Free</p>") == ["Go", "Free"]
    assert P.blocks("<div><a href=x>Go <svg><a>no</a></div><p>Free</p>")[1].linked == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in P.start_weights(rng).items()}
    x, mask = P.padded([rng.normal(size=(n, P.PATH_DIMS + P.WORD_DIMS + P.COUNTS)) for n in (3, 5)])
    goal = rng.normal(size=(5, 2, P.HIDDEN))
    for d in "fb":
        loss = lambda: float((P.read(w, x, mask, d)[0] * goal).sum())
        _, tape = P.read(w, x, mask, d)
        grads = P.learn_back(w, x, d, tape, goal)
        for name in ("x", "h", "c"):
            k = name + d
            at = tuple(rng.integers(s) for s in w[k].shape)
            old = w[k][at]
            w[k][at] = old + 1e-2
            up = loss()
            w[k][at] = old - 1e-2
            down = loss()
            w[k][at] = old
            assert np.isclose((up - down) / 2e-2, grads[k][at], rtol=0.05, atol=0.02)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_SMALL}/pages.parquet")


def test_articles(spark, pages):
    got = {r.page_id: r for r in P.main_text(pages).collect()}
    right = 0
    for r in pages.collect():
        page = P.blocks(r.html)
        truth = "\n".join(b.text for b, y in zip(page, P.weak_labels(page)) if y)
        right += got[r.page_id].text == truth
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right >= 0.97 * len(got)


def test_other_frames_and_edges(spark, pages):
    rows = pages.collect()
    other = "Kind words. " * 12
    odd = [(900, "u", None), (901, "u", ""), (902, None, "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"), (None, "u", "plain"), (900, "u", None)]
    made = f'<html><body><div class="menu"><ul><li><a href="#">A</a></li></ul></div><div class="content"><h1>Title of it</h1><p>{other}</p><p>{other}</p></div><div class="comments"><h3>Comments</h3><div class="comment"><b>Jo</b><p>First</p></div></div><div class="footer"><p>&copy; we</p></div></body></html>'
    extra = spark.createDataFrame([*odd, (903, "u", made)], "page_id long, url string, html string")
    clashing = {c: F.lit("x") for c in ("k", "h", "l", "t", "y", "text", "row")}
    got = P.main_text(pages.select("page_id", "url", "html").unionByName(extra).withColumns(clashing)).collect()
    assert len(got) == len(rows) + 6
    by = {r.page_id: r.text for r in got}
    assert by[900] == by[901] == by[902] == ""
    assert other.strip() in by[903] and "First" not in by[903] and "we" not in by[903].split()
    assert P.main_text(extra.limit(0)).count() == 0
