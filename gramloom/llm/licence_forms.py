"""Other forms in which files declare licences: titles, SPDX ids, standard headers, full texts. Fixed values.

The full texts in ``licence_texts`` are those of /usr/share/common-licenses (MIT, ISC: the usual text). Creative Commons BY and BY-NC, AGPL and EPL
have no full text there, so their files are known by their titles and headers.
"""

from __future__ import annotations

from pathlib import Path

TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"],
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License version 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
}

#: Words of other licences' names. A piece that has one of them in its head is none of this licence, however alike the rest is.
BARRED = {
    "GPL-2.0": ["affero", "lesser", "library"], "GPL-3.0": ["affero", "lesser", "library"],
    "LGPL-2.1": ["affero"], "LGPL-3.0": ["affero"], "CC-BY-4.0": ["noncommercial", "by-nc", "sharealike", "by-sa", "noderivatives", "by-nd"],
    "CC-BY-NC-4.0": ["sharealike", "by-nc-sa", "noderivatives", "by-nc-nd"], "MPL-2.0": ["eclipse"], "EPL-2.0": ["mozilla"],
    "BSD-2-Clause": ["3-clause", "4-clause", "neither"], "BSD-3-Clause": ["2-clause", "4-clause"],
}
#: Words that name a licence and its version. A header or full text of it has all of these, in the words of any of the alternatives.
DECISIVE = {
    "AGPL-3.0": ["affero", "3"], "Apache-2.0": ["apache", "2.0"], "BSD-3-Clause": ["redistributions", "neither"], "CC0-1.0": ["cc0", "1.0"],
    "GPL-2.0": ["general", "public", "2"], "GPL-3.0": ["general", "public", "3"], "LGPL-2.1": ["lesser", "2.1"], "LGPL-3.0": ["lesser", "3"],
    "MPL-2.0": ["mozilla", "2.0"], "CC-BY-4.0": ["attribution", "4.0"], "CC-BY-NC-4.0": ["attribution-noncommercial", "4.0"],
    "ISC": ["permission", "purpose", "fee", "warranties"], "MIT": ["permission", "charge", "software"], "BSD-2-Clause": ["redistributions"],
}

SPDX = {k: [k] for k in TITLES} | {
    f"{k}": [k, f"{k}-only", f"{k}-or-later", f"{k}+"] for k in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
}


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


#: The usual text of the ISC licence.
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

HEADERS = {
    "AGPL-3.0": [_gnu("Affero General", "3"), "This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ],
    "BSD-2-Clause": ["Use of this source code is governed by the BSD 2-Clause License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": [_gnu("General", "2"), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [_gnu("General", "3")],
    "LGPL-2.1": [_gnu("Lesser General", "2.1"), "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": [_gnu("Lesser General", "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
}


def _text(name: str) -> str:
    return (Path(__file__).parent / "licence_texts" / name).read_text()


def full_texts() -> dict[str, str]:
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MIT": "MIT", "MPL-2.0": "MPL-2.0"}
    bsd = _text("BSD")
    third, end = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE")  # the clause on endorsement
    return {k: _text(v) for k, v in names.items()} | {"ISC": ISC, "BSD-3-Clause": bsd, "BSD-2-Clause": bsd[:third] + bsd[end:]}


def paragraphs(text: str) -> list[str]:
    return [" ".join(p.split()) for p in text.split("\n\n") if p.strip()]


def forms(notices: dict[str, str]) -> list[tuple[str, str, str]]:
    """(licence, kind, text) of all templates."""
    full = full_texts()
    out = [(k, "notice", v) for k, v in notices.items()]
    out += [(k, "title", v) for k, vs in TITLES.items() for v in vs]
    out += [(k, "title", f"SPDX-License-Identifier: {v}") for k, vs in SPDX.items() for v in vs]
    out += [(k, "header", v) for k, vs in HEADERS.items() for v in vs]
    # Short licences stand whole in headers of source files, where their first paragraph tells them.
    out += [("MIT", "header", paragraphs(full["MIT"])[0])]
    return sorted(out + [(k, "full", v) for k, v in full.items()])
