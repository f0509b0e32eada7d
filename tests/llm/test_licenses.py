
from llm_fixtures import docs_of  # noqa: F401

from tablelens.llm import licenses as C


def test_canonical_matches(docs_of):
    mit = dict(C.KNOWN[::-1])["MIT"] if False else C._MIT
    shuffled = "Copyright (c) 2020 Someone\n\n" + mit.replace("software", "SOFTWARE").replace('"', "“").replace(", ", " ,\n")
    rows = [
        (1, shuffled), (2, "A line.\n  * Released under the MIT Licence!\nLicensed under CC BY-NC 4.0\nreleased under the mit license"), (3, mit + "\nAnd one more word"),
        (4, None), (5, ""), (6, "© 2020 me\nAll rights reserved."), (7, "text " * 30000), (None, "SPDX-License-Identifier: MIT"),
    ]
    got = {r.doc_id: r for r in C.scan(docs_of(rows)).collect()}
    assert got[1].license == "MIT" and got[3].license == ""
    assert (got[2].license, got[2].notices, got[2].n_notices) == ("", "CC-BY-NC-4.0,MIT", 3)
    assert got[4].text_sha256 == got[5].text_sha256 == got[6].text_sha256 and got[4].license == ""
    assert got[None].license == "MIT" and got[None].notices == "MIT" and got[7].n_notices == 0


def test_repeated_and_empty(docs_of):
    assert C.scan(docs_of([(1, "a"), (1, "a")])).count() == 2
    assert C.scan(docs_of([])).count() == 0
