import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import docs_of  # noqa: F401

from tablelens.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_definition(key, text):
    text = text or ""
    t = TOKEN.findall(text)
    assert "".join(t) == text
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(t), "plain", None, None, text
    if h4 % 100 < 80:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind", [infill.ARRAY, infill.BITMAP, infill.RUNS])
def test_select_in_each_kind_of_container(kind):
    rng = np.random.default_rng(kind)
    places = {
        infill.ARRAY: np.sort(rng.choice(infill.SPAN, 3000, replace=False)),
        infill.BITMAP: np.sort(rng.choice(infill.SPAN, 20000, replace=False)),
        infill.RUNS: np.concatenate([np.arange(5, 9000), np.arange(20000, 65536)]),
    }[kind]
    whole = np.concatenate([places, places + 3 * infill.SPAN, [10 * infill.SPAN]])
    made = infill.Boundaries(whole)
    assert made.containers[0][0] == made.containers[1][0] == kind
    assert len(made) == len(whole) and made.select(np.arange(len(whole))).tolist() == whole.tolist()
    assert made.select(np.zeros(0, np.int64)).tolist() == []


def test_empty_set():
    assert len(infill.Boundaries(np.zeros(0, np.int64))) == 0


ODD = [None, "", " ", "a", " a", "a ", "a <P> b", "x<S>", "<M", "<<S", "é  ü\tñ\n", "你好 \x85 　x\x0b", "  \n ", "<P <S <M " * 3, "b" * 70000, "w " * 50000, " " * 70000 + "x"]


def test_whole_table_by_definition(docs_of):
    rng = random.Random(4)
    rows = list(enumerate(ODD * 4)) + [(1000 + i, "".join(rng.choice("ab é<PSM> \t\n") for _ in range(rng.randint(0, 200)))) for i in range(400)]
    rows += [(None, "no key here at all"), (5, "same"), (5, "same"), (-7, "minus one two three")]
    docs = docs_of(rows)
    got = sorted(infill.fill_in_middle(docs).collect(), key=str)
    want = sorted(((k, *by_definition(k, t)) for k, t in rows), key=str)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(map(str, (tuple(r) for r in infill.digests(docs).collect())))
    assert digests == sorted(str((k, n, f, p, m, sha(o), sha(t or ""))) for (k, t), (n, f, p, m, o) in ((r, by_definition(*r)) for r in rows))


def test_empty_table(docs_of):
    assert infill.digests(docs_of([])).count() == 0
