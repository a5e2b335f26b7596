"""Texts of known licences and notices (publicly known wording), as (licence, text).

Entire texts: those below and the files of ``licence_files``.  Notices and SPDX lines are made from ``NAMES``.
"""

from pathlib import Path

_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so"""

MIT = f"""MIT License

{_GRANT_MIT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY_MIT}"""

ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_CLAUSE_1 = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_CLAUSE_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_CLAUSE_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""

BSD_2 = f"""{_GRANT_BSD}

1. {_CLAUSE_1}

2. {_CLAUSE_2}

{_WARRANTY_BSD}"""

BSD_3 = f"""{_GRANT_BSD}

1. {_CLAUSE_1}

2. {_CLAUSE_2}

3. {_CLAUSE_3}

{_WARRANTY_BSD}"""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

# Entire texts by file name; a text that goes on after its terms is also known without what follows them.
_FILES = sorted(Path(__file__).with_name("licence_files").glob("*.txt"))
_END = "END OF TERMS AND CONDITIONS"

_GNU = [(short, name, v) for short, name, versions in [
    ("GPL", "General Public License", ("1.0", "2.0", "3.0")),
    ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
    ("LGPL", "Library General Public License", ("2.0",)),
    ("AGPL", "Affero General Public License", ("3.0",)),
    ("GFDL", "Free Documentation License", ("1.1", "1.2", "1.3")),
] for v in versions]
_CC = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
_VERSIONED = [
    ("Apache", "Apache License", ("1.1", "2.0")), ("MPL", "Mozilla Public License", ("1.0", "1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")),
    ("EUPL", "European Union Public License", ("1.1", "1.2")), ("CDDL", "Common Development and Distribution License", ("1.0", "1.1")),
    ("BSL", "Boost Software License", ("1.0",)), ("Artistic", "Artistic License", ("1.0", "2.0")), ("AFL", "Academic Free License", ("3.0",)),
    ("OFL", "SIL Open Font License", ("1.0", "1.1")),
]


def _versions(name: str, v: str) -> list[str]:
    """Spellings of a licence name with its version."""
    short = [v, v[:-2]] if v.endswith(".0") else [v]
    return [f"{name} {how}{x}" for x in short for how in ("version ", "v", "")]


def _names() -> list[tuple[str, list[str]]]:
    """(SPDX id, names that a notice may use)."""
    out = [
        ("MIT", ["the MIT License", "MIT License", "MIT", "the MIT/X11 License"]),
        ("ISC", ["the ISC License", "ISC License"]),
        ("0BSD", ["the BSD Zero Clause License"]),
        ("BSD-2-Clause", ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"]),
        ("BSD-3-Clause", ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License"]),
        ("Zlib", ["the zlib License"]),
        ("Unlicense", ["the Unlicense"]),
        ("WTFPL", ["the WTFPL"]),
        ("CC0-1.0", ["CC0 1.0", "CC0", "CC0 1.0 Universal", "the Creative Commons Zero v1.0 Universal License"]),
    ]
    for short, name, versions in _VERSIONED:
        out += [(f"{short}-{v}", [*_versions(f"the {name}", v), *_versions(f"{short}", v), *_versions(f"the {short}", v)]) for v in versions]
    for short, name, v in _GNU:
        names = [x for the in ("the ", "") for n in (f"GNU {name}", f"GNU {short}", short) for x in _versions(the + n, v)]
        names += [the + n + "v" + x for the in ("the ", "") for n in (short, f"GNU {short}") for x in ([v, v[:-2]] if v.endswith(".0") else [v])]
        out.append((f"{short}-{v}", names))
        later = [f"{x}{tail}" for x in names for tail in (" or later", " or any later version")]
        out.append((f"{short}-{v}-or-later", later))
    for short, name in _CC:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            area = {"4.0": "International", "3.0": "Unported"}.get(v, "Generic")
            long = [f"Creative Commons {name} {v}", f"Creative Commons {name} {v} {area}"]
            names = [f"CC {short} {v}", *long, *(f"{a} {x} License" for x in long for a in ("the", "a"))]
            out.append((f"CC-{short}-{v}", names))
    return out


NAMES = _names()
_SENTENCES = [
    *(f"{how} under {{}}" for how in ("Licensed", "Released", "Distributed")),
    *(f"This {what} is licensed under {{}}" for what in ("work", "software", "project", "program", "file")),
]


def _lines(licence: str, names: list[str]) -> list[str]:
    """SPDX lines and notice sentences of a licence; of the GNU licences the plain id means this version only."""
    ids = [licence]
    if licence.split("-")[0] in {short for short, _, _ in _GNU} and not licence.endswith("-or-later"):
        ids.append(f"{licence}-only")
    return [f"SPDX-License-Identifier: {x}" for x in ids] + [s.format(n) for n in dict.fromkeys(names) for s in _SENTENCES]


def _entire() -> list[tuple[str, str]]:
    out = [("MIT", MIT), ("MIT", MIT.split("\n", 2)[2]), ("ISC", ISC), ("ISC", ISC.split("\n", 2)[2]), ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("Zlib", ZLIB)]
    for f in _FILES:
        text = f.read_text(encoding="utf-8")
        out.append((f.stem, text))
        if _END in text:
            out.append((f.stem, text[: text.index(_END)] + _END))
    return out


KNOWN = [*_entire(), ("Apache-2.0", APACHE_NOTICE), *((licence, line) for licence, names in NAMES for line in _lines(licence, names))]
