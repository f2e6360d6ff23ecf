"""Licence scans by sentence rules.

Sentences of a text are normalised (lower case, letters and digits only, white space as one space, "licence" as "license", copyright
holders and years away, named holders as those of the licence's own text) and mapped to the identifiers of known licence sentences. The identifiers, in order of the text, are
then matched against ordered rules, those of more sentences first: a rule matches where its sentences follow one another with at
most GAP other sentences between two of them, and takes those sentences up. What no rule takes stays known, without a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.runtime import columns, grouped, lean, texts

GAP = 2
GROUP_BYTES = 4_000_000

# fixed values: sentences of public licences and of the notices that name them
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-named": "Released under the MIT License",
    "mit-named-2": "Licensed under the MIT License",
    "mit-named-3": "This project is licensed under the MIT License",
    "mit-named-4": "This software is released under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "isc-named": "Licensed under the ISC License",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd2-named": "Licensed under the BSD 2-Clause License",
    "bsd3-named": "Licensed under the BSD 3-Clause License",
    "bsd2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-named": "Licensed under the Apache License, Version 2.0",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-may": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-2": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-named-2": "Licensed under the GNU General Public License, version 3",
    "gpl3-named-3": "Licensed under the GPLv3",
    "gpl2-named": "Licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-spdx-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "lgpl3-named": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl3-named": "Licensed under the GNU Affero General Public License, version 3",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-spdx": "SPDX-License-Identifier: MPL-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-named": "Licensed under CC BY 4.0",
    "cc-by-named-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-named": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-named-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-named": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-named-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-named": "Licensed under CC BY-ND 4.0",
    "cc0-named": "Released under CC0 1.0",
    "all-rights": "All rights reserved",
    "apache-text-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-text-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-text-license": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache-text-licensor": '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License',
    "apache-text-you": '"You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License',
    "apache-text-end": "END OF TERMS AND CONDITIONS",
    "gnu-text-copy": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl-text-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl3-text-date": "Version 3, 29 June 2007",
    "gpl2-text-date": "Version 2, June 1991",
    "gpl3-text-free": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl2-text-most": "The licenses for most software are designed to take away your freedom to share and change it",
    "lgpl-text-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "lgpl3-text-this": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "agpl-text-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "agpl3-text-date": "Version 3, 19 November 2007",
    "agpl3-text-free": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "mpl2-text-title": "Mozilla Public License Version 2.0",
    "mpl2-text-contributor": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',
    "mpl2-text-version": '"Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution',
    "cc-by-text-title": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-sa-text-title": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-nc-text-title": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "cc-by-text-accept": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License",
    "cc-by-sa-text-accept": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-nc-text-accept": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License",
}
# fixed values: licences and the sentences, in order, by which they are recognised
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-notice", "apache-may", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-may", "apache-copy-2", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-may"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("Apache-2.0", ["apache-text-terms", "apache-text-license", "apache-text-licensor"]),
    ("Apache-2.0", ["apache-text-license", "apache-text-licensor"]),
    ("GPL-3.0-only", ["gpl-text-title", "gpl3-text-date", "gnu-text-copy", "gpl3-text-free"]),
    ("GPL-3.0-only", ["gnu-text-copy", "gpl3-text-free"]),
    ("GPL-2.0-only", ["gpl-text-title", "gpl2-text-date", "gnu-text-copy", "gpl2-text-most"]),
    ("GPL-2.0-only", ["gnu-text-copy", "gpl2-text-most"]),
    ("LGPL-3.0-only", ["lgpl-text-title", "gpl3-text-date", "gnu-text-copy", "lgpl3-text-this"]),
    ("LGPL-3.0-only", ["gnu-text-copy", "lgpl3-text-this"]),
    ("AGPL-3.0-only", ["agpl-text-title", "agpl3-text-date", "gnu-text-copy", "agpl3-text-free"]),
    ("AGPL-3.0-only", ["gnu-text-copy", "agpl3-text-free"]),
    ("MPL-2.0", ["mpl2-text-contributor", "mpl2-text-version"]),
    ("CC-BY-4.0", ["cc-by-text-title", "cc-by-text-accept"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-text-title", "cc-by-sa-text-accept"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-text-title", "cc-by-nc-text-accept"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy-2"]),
    *((name, [s]) for name, own in (
        ("MIT", ("mit-named", "mit-named-2", "mit-named-3", "mit-named-4", "mit-title", "mit-title-2", "mit-spdx", "mit-grant")),
        ("ISC", ("isc-named", "isc-spdx", "isc-grant")),
        ("BSD-2-Clause", ("bsd2-named", "bsd2-spdx")),
        ("BSD-3-Clause", ("bsd3-named", "bsd3-spdx")),
        ("Apache-2.0", ("apache-named", "apache-notice", "apache-spdx")),
        ("GPL-3.0-only", ("gpl3-named", "gpl3-named-2", "gpl3-named-3", "gpl3-spdx")),
        ("GPL-3.0-or-later", ("gpl-free", "gpl3-spdx-later")),
        ("GPL-2.0-only", ("gpl2-named", "gpl2-spdx")),
        ("GPL-2.0-or-later", ("gpl2-free",)),
        ("LGPL-3.0-only", ("lgpl3-named",)),
        ("AGPL-3.0-only", ("agpl3-named",)),
        ("MPL-2.0", ("mpl2-form", "mpl2-spdx")),
        ("Unlicense", ("unlicense",)),
        ("CC-BY-4.0", ("cc-by-named", "cc-by-named-2")),
        ("CC-BY-SA-4.0", ("cc-by-sa-named", "cc-by-sa-named-2")),
        ("CC-BY-NC-4.0", ("cc-by-nc-named", "cc-by-nc-named-2")),
        ("CC-BY-ND-4.0", ("cc-by-nd-named",)),
        ("CC0-1.0", ("cc0-named",)),
    ) for s in own),
]

SCHEMA = "doc_id long, n_sentences long, sentence_ids array<string>, licenses array<string>, rule_sizes array<int>, starts array<int>"
# a sentence ends at a stop before white space, a colon or semicolon before white space, or an empty line; not at the stop of a
# holder's name ("Acme Inc. nor the names of ...")
AFTER_HOLDER = r"(?i:nor\W+the\W+names\W+of|(?:and|or)\W+(?:its\W+|the\W+|other\W+)?contributors|and\W+any\W+express|[\"'`\u201c]+as\W+is\b|disclaims?\W+all|be\W+liable\W+for)"
SHORT = "|".join(rf"(?<=\b{x}\.)" for x in ("inc", "ltd", "llc", "co", "corp", "jr"))
END = re.compile(rf"(?<=[.!?;:])(?<!(?i:identifier):)(?<![ (][vV]\.)(?!(?<=\.)[\s*#/]+{AFTER_HOLDER}|(?i:{SHORT})\s+(?:[\w&,]+\s+){{1,3}}{AFTER_HOLDER})\s+|\n\s*\n")
# a line that names holders ends a sentence, as does the line before it
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright\s+(?:\(c\)|\u00a9|\d{4})|\(c\)\s*\d{4}|\u00a9)[^\n]*$", re.I | re.M)
HOLDER = re.compile(r"^(?:copyright (?:c )?|c (?=\d{4} ))(?:\d{4} )*.*?(?=(?:\ball rights reserved)?$)")
# normalised sentences that name a holder, and what they become
NAMED = [(re.compile(rf"^{a} .+? {b}"), f"{a} {holder} {b}") for a, holder, b in (
    ("neither the name of", "the copyright holder", "nor the names of its contributors may"),
    ("this software is provided by", "the copyright holders and contributors", "as is and any express"),
    ("the software is provided as is and", "the author", "disclaims all warranties with regard"),
    ("in no event shall", "the authors or copyright holders", "be liable for any claim damages or other"),
    ("in no event shall", "the author", "be liable for any special direct indirect or consequential"),
)]

# a notice: what is licensed, and by which words; then the licence's name, which is one of NAMES
NOTICE = re.compile(r"^(?:(?:this|the|these|all|our|its)(?: \w+)*? (?:is|are|may be used|has been|have been) |(?:it|they|and) (?:is|are) )?(?:now |also |dual |free software )?(?:released|licensed|distributed|available|made available|provided|published|offered|shared|open sourced|covered|governed) (?:to you )?(?:under|by|according to|subject to) (?:the )?(?:terms (?:and conditions )?of )?")
HINT = re.compile(r"(?:licen[sc]ed|released|distributed|available|provided|published|offered|shared|sourced|covered|governed)\W+(?:to\W+you\W+)?(?:under|by|according|subject)\b", re.I)
VERBS = ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "offered", "shared", "sourced", "covered", "governed")
ARTICLE = re.compile(r"^(?:the |a |an )|(?: license)?(?: (?:agreement|for details|see license|see the license file))?$")
# fixed values: names of licences, normalised, and the one under which each is known
NAMES = {
    name: one
    for one, names in {
        "mit": ("mit", "expat", "x11 mit"),
        "isc": ("isc",),
        "bsd 2 clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"),
        "bsd 3 clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"),
        "apache 2 0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2", "apache v2", "apache version 2 0", "apache software license version 2 0", "apache license v2 0"),
        "gpl 2": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2", "gpl 2", "gpl 2 0", "gpl version 2"),
        "gpl 3": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3", "gpl 3", "gpl 3 0", "gpl version 3"),
        "lgpl 2 1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"),
        "lgpl 3": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgplv3", "lgpl v3", "lgpl 3", "lgpl 3 0"),
        "agpl 3": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agplv3", "agpl v3", "agpl 3", "agpl 3 0"),
        "mpl 2": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2", "mplv2"),
        "epl 2": ("eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"),
        "cc by 4": ("cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"),
        "cc by sa 4": ("cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"),
        "cc by nc 4": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"),
        "cc by nd 4": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0", "creative commons attribution noderivatives 4 0 international"),
        "cc0": ("cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
        "unlicense": ("unlicense",),
        "boost 1": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
        "zlib": ("zlib",),
        "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
    }.items()
    for name in names
}
NAMED_LICENSES = {
    "mit": "MIT", "isc": "ISC", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "apache 2 0": "Apache-2.0", "gpl 2": "GPL-2.0-only", "gpl 3": "GPL-3.0-only", "lgpl 2 1": "LGPL-2.1-only", "lgpl 3": "LGPL-3.0-only", "agpl 3": "AGPL-3.0-only", "mpl 2": "MPL-2.0",
    "epl 2": "EPL-2.0", "cc by 4": "CC-BY-4.0", "cc by sa 4": "CC-BY-SA-4.0", "cc by nc 4": "CC-BY-NC-4.0", "cc by nd 4": "CC-BY-ND-4.0", "cc0": "CC0-1.0", "unlicense": "Unlicense", "boost 1": "BSL-1.0", "zlib": "Zlib", "wtfpl": "WTFPL",
}
LATER = ("gpl 2", "gpl 3", "lgpl 2 1", "lgpl 3", "agpl 3")
NAMED_LICENSES |= {f"{one} or later": NAMED_LICENSES[one].replace("-only", "-or-later") for one in LATER}
SENTENCES |= {f"{one.replace(' ', '-')}-notice-of": f"Licensed under {one}" for one in NAMED_LICENSES}
RULES += [(name, [f"{one.replace(' ', '-')}-notice-of"]) for one, name in NAMED_LICENSES.items()]
NAMES |= {one: one for one in NAMED_LICENSES}
# identifiers of expressions, each a sentence of its own
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
_NAMED_IDS = {s.split(": ")[1].lower() for s in SENTENCES.values() if s.startswith("SPDX-License-Identifier: ")}
_OTHER_IDS = [x for x in NAMED_LICENSES.values() if x.lower() not in _NAMED_IDS]
SENTENCES |= {f"{x.lower()}-spdx-of": f"SPDX-License-Identifier: {x}" for x in _OTHER_IDS}
RULES += [(x, [f"{x.lower()}-spdx-of"]) for x in _OTHER_IDS]
IDS = _NAMED_IDS | {x.lower() for x in _OTHER_IDS}
# what may follow the last name of a notice
TAIL = re.compile(r"(?:$|(?:which|that|as|see|a copy|copies|you may|available|found|at|in the|for|text|included|with)\b)")
LIST = re.compile(r"^(?:either |both |any )?(?:of )?(?:the |a |an )?(?:terms of )?(?:the )?")


def identifiers(expression: str) -> list[tuple[int, str]]:
    """Places and sentences of the known identifiers of an SPDX expression; what follows WITH is an exception, not a licence. `+` and no ending are the older spellings of `-or-later` and `-only`."""
    out, skip = [], False
    for m in re.finditer(r"[\w.+-]+", expression):
        name = m[0].lower().rstrip(".-")
        if name in ("and", "or", "with"):
            skip = name == "with"
            continue
        spelled = next((x for x in (name, f"{name}-only", f"{name[:-1]}-or-later" if name.endswith("+") else "") if x in IDS), None)
        if spelled and not skip:
            out.append((m.start(), normalise(f"SPDX-License-Identifier: {spelled}")))
        skip = False
    return out


def named(rest: str) -> list[str]:
    """The licences that a notice names, in order: one, or several with and or or between; nothing if something else follows."""
    out, words = [], LIST.sub("", rest).split()
    while True:
        k = next((k for k in range(min(len(words), 12), 0, -1) if " ".join(words[:k]) in NAMES), 0)
        if not k:
            return []
        one, words = NAMES[" ".join(words[:k])], words[k:]
        words = words[1:] if words and words[0] in ("license", "licenses") else words
        after = " ".join(words)
        if m := re.match(r"(?:or (?:at your option )?(?:any )?later(?: versions?)?|or newer)\b ?", after):
            one, after = (f"{one} or later" if f"{one} or later" in NAMES else one), after[m.end() :]
        out.append(one)
        if m := re.match(r"(?:and|or)(?: at your option)? (?:the |a |an )?", after):
            words = after[m.end() :].split()
            if any(" ".join(words[:k]) in NAMES for k in range(1, 13)):
                continue
        return out if TAIL.match(after) else []


def plain(sentence: str) -> str:
    """Lower case, one spelling of licence, single spaces, no numbering, holders or years."""
    s = " ".join(re.sub(r"[^a-z0-9]+", " ", sentence.lower().replace("licence", "license")).split())
    s = HOLDER.sub("", re.sub(r"^(?:\d{1,2}|[abd-z]|c(?! \d{4} )) (?=\w{3})", "", s))
    for holder, usual in NAMED:
        s = holder.sub(usual, s)
    return s


def normalise(sentence: str) -> str:
    s = plain(sentence)
    if m := NOTICE.match(s):
        name = ARTICLE.sub("", s[m.end() :])
        s = "licensed under " + NAMES.get(name, name) if name in NAMES else s
    return s


def sentences_of(text: str) -> Iterator[tuple[int, str]]:
    """Places and texts of sentences."""
    low = text.lower()
    lines = [m.span() for m in COPYRIGHT.finditer(text)] if "copyright" in low or "(c)" in low or "\u00a9" in low else []
    begin = 0
    for start, stop in [*lines, (len(text) + 1, len(text) + 1)]:
        if start > begin:
            at = 0
            part = text[begin : start - 1]
            for piece in END.split(part):
                place = part.find(piece, at)
                at = place + len(piece)
                if piece or not lines:
                    yield begin + place, piece
        if stop <= len(text):
            yield start, text[start:stop]
        begin = stop + 1


class Rules:
    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]):
        self.known: dict[str, list[str]] = {}
        for name, s in sentences.items():
            for k, part in enumerate(x for x in END.split(s) if normalise(x)):
                self.known[normalise(part)] = [*self.known.get(normalise(part), []), f"{name}" if not k else f"{name}#{k + 1}"]
        parts = {n: [f"{n}" if not k else f"{n}#{k + 1}" for k in range(sum(bool(normalise(x)) for x in END.split(s)))] for n, s in sentences.items()}
        self.rules = sorted(((name, [p for i in ids for p in parts[i]]) for name, ids in rules), key=lambda r: -len(r[1]))
        self.starts = {k[:4] for k in self.known} | {"copy"}

    def units(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Number, place and normalised form of the text's sentences; one that names several licences: each; one over several lines that is not known: its lines, if one of them is known."""
        n, low = 0, text.lower()
        hint = any(v in low for v in VERBS) and bool(HINT.search(text))  # most texts have no notice, and their sentences need not be searched for one
        more = hint or "spdx-license-identifier" in low
        for place, piece in sentences_of(text):
            whole = self.key(piece, hint)
            if whole is None and more and (several := self.several(piece)):
                yield from ((n, place + at, s) for at, s in several)
                n += 1
                continue
            if whole is None and "\n" in piece:
                inner = place
                for line in piece.split("\n"):
                    yield n, inner, self.key(line, hint) or ""
                    inner += len(line) + 1
                    n += 1
            else:
                yield n, place, whole or ""
                n += 1

    def several(self, piece: str) -> list[tuple[int, str]]:
        """Places and normalised forms of the known sentences that an expression of identifiers, or a notice of several licences or with more words, stands for."""
        if m := SPDX.search(piece):
            return [(m.start(1) + at, s) for at, s in identifiers(m[1]) if s in self.known]
        if HINT.search(piece) and (m := NOTICE.match(s := plain(piece))):
            return [(0, k) for x in named(s[m.end() :]) if (k := f"licensed under {x}") in self.known]
        return []

    def key(self, piece: str, hint: bool) -> str | None:
        """The normalised form of a known sentence. hint: whether the text may have a notice."""
        head = piece.lstrip(" \t\r\n*#/\"'-(.0123456789)>")[:8].lower().replace("licence", "license")[:4]
        if not (head and re.sub(r"[^a-z0-9]+", " ", head) in self.starts or len(head) < 4 or not head.isalnum() or hint and HINT.search(piece)):
            return None
        s = normalise(piece)
        return s if s in self.known else None

    def match(self, text: str) -> tuple[int, list[str], list[tuple[int, str, int]]]:
        """Sentences; identifiers found, in order; place, licence and number of sentences of each rule that matches."""
        found, n = [], 0
        for i, place, s in self.units(text):
            n = i + 1
            if s:
                found.append((i, place, self.known[s]))
        taken, out = [False] * len(found), []
        for name, ids in self.rules if found else ():
            for first in range(len(found)):
                chain = []
                for k in range(first, len(found)):
                    if len(chain) == len(ids) or chain and found[k][0] - found[chain[-1]][0] > GAP + 1:
                        break
                    if not taken[k] and ids[len(chain)] in found[k][2]:
                        chain.append(k)
                    elif not chain:
                        break
                if len(chain) == len(ids):
                    for k in chain:
                        taken[k] = True
                    out.append((found[first][1], name, len(ids)))
        return n, [x[2][0] for x in found], sorted(out)


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """SCHEMA: a row per document; licenses, rule_sizes and starts (places in code points) are of the rules that match, in order of the text.

    Null and empty texts have no sentence and no licence; repeated rows get a row each; a licence named twice is listed twice;
    very long texts are read whole; an empty table gives no rows; other columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(sentences, rules)
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            n, known, hits = zip(*(table.match((b or b"").decode("utf-8", "replace")) if b else (0, [], []) for b in bodies), strict=True)
            lists = lambda i, t: pa.array([[h[i] for h in x] for x in hits], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.list_(pa.string())), lists(1, pa.string()), lists(2, pa.int32()), lists(0, pa.int32())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return texts(docs).mapInArrow(lean(work), SCHEMA)
