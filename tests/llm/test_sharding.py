import zlib

import pytest
from llm_fixtures import docs_of  # noqa: F401

from tablelens.llm import sharding as H


@pytest.mark.parametrize("shards", [4, 7])
def test_law_rows_and_groups(docs_of, monkeypatch, shards):
    monkeypatch.setattr(H, "BUCKET_ROWS", 20)
    monkeypatch.setattr(H, "HOT_LINKS", 30)
    texts = [f"text {i}" for i in range(300)] + [f"pair {i // 2}" for i in range(100)] + ["hot"] * 220 + [None, "", None]
    got = H.shard_rows(docs_of(list(enumerate(texts))), shards).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    by = {}
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    shard = {r.doc_id: r.shard for r in got}
    together = sum(shard[i] == shard[i + 1] for i in range(300, 400, 2))
    assert together >= 35  # of 50 pairs; chance would give 50 / shards


def test_small_tables(docs_of):
    assert H.shard_rows(docs_of([])).count() == 0
    got = H.shard_rows(docs_of([(1, "a"), (1, "a"), (None, None)]), 24).collect()
    assert sorted((r.slot for r in got)) == [0, 0, 0] and len({r.shard for r in got}) == 3


def test_groups_that_fit_stay_whole(docs_of):
    texts = [f"text {i}" for i in range(1500)] + [f"pair {i // 2}" for i in range(100)] + [f"twenty {i // 20}" for i in range(200)] + ["hundred"] * 100
    got = {r.doc_id: r.shard for r in H.shard_rows(docs_of(list(enumerate(texts))), 4).collect()}
    shards = {}
    for i, t in enumerate(texts):
        shards.setdefault(t, set()).add(got[i])
    assert all(len(s) == 1 for s in shards.values())
