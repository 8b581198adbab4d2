"""Licences whose texts are alike up to their names, and whole licence texts in the headers of source files."""

import random

import pytest

from gramloom.llm import licences
from gramloom.llm.licence_forms import HEADERS, ISC, full_texts

FULL = full_texts()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def commented(text, mark="#", width=70):
    lines = []
    for paragraph in text.split("\n\n"):
        line = ""
        for w in paragraph.split():
            if len(line) + len(w) > width:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        lines += [line, ""]
    return "\n".join(f"{mark} {x}".rstrip() for x in lines)


def affero():
    return FULL["GPL-3.0"].replace("GENERAL PUBLIC LICENSE", "AFFERO GENERAL PUBLIC LICENSE").replace("GNU General", "GNU Affero General")


def found(spark, cases):
    files = [(p, t, i) for i, (p, t, _) in enumerate(cases)]
    rows = licences.scan(spark.createDataFrame(files, "path string, text string, id int")).collect()
    return [r.own_licence for r in sorted(rows, key=lambda r: r.id)]


def test_families_are_told_apart(spark):
    cases = [(f"h{i}.py", commented(HEADERS[k][0]) + "\n" + prose(i, 30), k) for i, k in enumerate(HEADERS) if k not in ("BSD-3-Clause",)]
    cases += [("a/LICENSE", affero(), None), ("b/LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3", "AGPL-3.0")]
    cases += [("c/LICENSE", FULL["GPL-3.0"], "GPL-3.0"), ("d/LICENSE", FULL["LGPL-3.0"], "LGPL-3.0"), ("e/LICENSE", FULL["GPL-2.0"], "GPL-2.0"), ("f/LICENSE", FULL["LGPL-2.1"], "LGPL-2.1")]
    cases += [("g.py", "# Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike International License.", None)]
    cases += [("h.py", "# SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"), ("i.py", "# SPDX-License-Identifier: ISC", "ISC")]
    got = found(spark, cases)
    for (path, _, want), own in zip(cases, got, strict=True):
        # The whole Affero text isn't among the templates; its title may tell it, but it's never the GPL.
        assert own == want or (path == "a/LICENSE" and own in (None, "AGPL-3.0")), (path, own, want)


@pytest.mark.parametrize("mark", ["#", " *", "//"])
def test_whole_texts_in_headers(spark, mark):
    texts = {"BSD-3-Clause": FULL["BSD-3-Clause"], "BSD-2-Clause": FULL["BSD-2-Clause"], "MIT": FULL["MIT"], "ISC": "ISC License\n\nCopyright (c) 2021 Someone\n\n" + ISC}
    cases = [(f"{k}.c", f"{prose(1, 8)}\n{commented(t, mark, w)}\n\n{prose(2, 60)}", k) for k, t in texts.items() for w in (50, 76)]
    assert found(spark, cases) == [k for _, _, k in cases]


def test_decisive_words_have_to_be_there(spark):
    header = HEADERS["Apache-2.0"][0].replace("Version 2.0", "Version 1.1").replace("LICENSE-2.0", "LICENSE-1.1")
    assert found(spark, [("a.c", commented(header), None)]) == [None]
