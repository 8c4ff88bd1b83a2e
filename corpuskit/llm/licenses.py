"""License of each code file and repository, by TF-IDF over word n-grams against templates.

Every template is one sparse row: each name alone, each name in each form of
statement, the texts and notices of the licenses, the names of other licenses
and sentences that only talk about licenses. A sentence, field or text is
multiplied against all rows; the best row of each license gives its cosine,
and a license is accepted by that cosine and its margin over the next one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.runtime import sized

#: The licenses, and the names and phrases by which texts call them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT license", "the MIT license", "Expat", "Expat license", "MIT/X11", "X11 license"),
    "Apache-2.0": (
        "Apache-2.0", "Apache 2", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License 2.0",
        "ASL 2.0", "Apache license v2",
    ),
    "BSD-3-Clause": (
        "BSD-3-Clause", "BSD 3-Clause", "BSD 3-Clause license", "3-clause BSD", "3-clause BSD license", "New BSD License", "Modified BSD License",
        "Revised BSD License", "bsd3", "BSD 3 Clause New or Revised License",
    ),
    "BSD-2-Clause": (
        "BSD-2-Clause", "BSD 2-Clause", "BSD 2-Clause license", "2-clause BSD", "2-clause BSD license", "Simplified BSD License", "FreeBSD License", "bsd2",
    ),
    "ISC": ("ISC", "ISC license", "the ISC license"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "MPL2", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"),
    "GPL-3.0": (
        "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL v3", "GPL 3", "GNU GPL v3", "GNU GPL 3", "GNU General Public License v3.0",
        "GNU General Public License, version 3", "GNU General Public License version 3", "GPLv3+",
    ),
    "LGPL-2.1": (
        "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL v2.1", "LGPLv2.1", "LGPL 2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1",
        "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2.1", "LGPLv2.1+",
    ),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
#: Sentences in which a file states its license; {} stands for a name.
STATEMENTS = (
    "SPDX-License-Identifier: {}",
    "License: {}",
    "Licence: {}",
    "@license {}",
    "Licensed under the {}",
    "Licensed under the terms of the {}",
    "Distributed under the {}",
    "Released under the {}",
    "This file is released under the {}",
    "This file is licensed under the {}",
    "Covered by the {}; the full terms sit in the project root",
    "This file is part of the project and covered by the {}",
    "Use of this source code is governed by the {}",
    "You may use, copy, share and change this file if you follow the terms of the {}",
    "You may redistribute it and/or modify it under the terms of the {}",
    "Subject to the terms of the {}",
    "Available under the {}",
    "This project is offered under the {}",
)
#: Openings of sentences that talk about licenses without granting one.
TALK = (
    "Looks for {} and {} notices in a file",
    "Skips {} files and keeps the rest",
    "Checks whether a file is under the {}",
    "Detects {} headers",
    "Parses {} license texts",
    "Compares the {} with the {}",
    "Files under the {} are ignored",
    "Finds and reports {} notices",
    "Replaces {} by {} in headers",
    "Removes {} headers from a file",
    "Counts how many files use the {}",
    "A list of {} packages",
    "Helpers for {} and {} texts",
)
#: Names of licenses that are not among those above; what is nearest to one of them names none of ours.
OTHER = (
    "GPL", "GNU GPL", "GNU General Public License", "GPL-2.0", "GPLv2", "GPL v2", "GNU General Public License v2.0", "GNU General Public License, version 2",
    "GNU General Public License version 2", "AGPL-3.0", "AGPLv3", "GNU Affero General Public License, version 3", "LGPL", "LGPL-2.0", "LGPL-3.0", "LGPLv3",
    "LGPL v3", "GNU LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "Apache", "Apache License", "Apache-1.1",
    "Apache License 1.1", "Apache Software License", "BSD", "BSD license", "BSD-4-Clause", "4-clause BSD license", "Original BSD License", "0BSD", "MPL", "MPL-1.1",
    "Mozilla Public License", "Mozilla Public License 1.1", "MIT-0", "CC0-1.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "EPL-2.0",
    "Eclipse Public License 2.0", "Zlib", "zlib license", "BSL-1.0", "Boost Software License 1.0", "WTFPL", "Artistic-2.0", "Artistic License 2.0",
    "PSF license", "Python Software Foundation License", "proprietary license", "commercial license",
)
_PERMISSION_AS_IS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_HOLDERS_DISCLAIM = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED"
    " TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
#: The texts of the short licenses; of the long ones their notices and the passages they begin with.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
        " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY"
        " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
        " WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY"
        " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
        " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (_REDISTRIBUTION + _PERMISSION_AS_IS + _HOLDERS_DISCLAIM,),
    "BSD-3-Clause": (
        _REDISTRIBUTION
        + _PERMISSION_AS_IS
        + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission."
        + _HOLDERS_DISCLAIM,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
        " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may"
        " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
        " You can obtain one at http://mozilla.org/MPL/2.0/.",
        "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that"
        " it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not,"
        " see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation, version 3 of the License.",
        "\"This License\" refers to version 3 of the GNU General Public License.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"
        " by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the"
        " hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
        " See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with"
        " this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"
        " by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other"
        " authorized party saying it may be distributed under the terms of this Lesser General Public License (also called \"this License\").",
    ),
}
#: Notices of other licenses that share most words with those above.
OTHER_TEXTS = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be"
    " useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
    " License for more details.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the"
    " Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the"
    " Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
)
CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
#: A sentence states a license if its cosine to that license's nearest template reaches ACCEPT, beats the next license by MARGIN and talk by TALK_MARGIN;
#: a field or title names one by ALONE, a passage is a license's text by BODY. All hold for the best license against the second best.
ACCEPT, MARGIN, TALK_MARGIN, ALONE, BODY = 0.5, 0.03, 0.02, 0.8, 0.7
#: Words outside all templates (names of projects and the like) weigh this share in statements, and fully in fields.
FREE = 0.35

_TERM = re.compile(r"[a-z]+|\d+")
_TALK, _OTHER = "talk", "other"


def _terms(text: str) -> list[str]:
    """Word unigrams, bigrams and trigrams; letters and digits are words of their own."""
    w = _TERM.findall(text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])] + [f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:])]


class Templates:
    """The sparse TF-IDF rows of all templates, stored by term."""

    def __init__(self) -> None:
        rows: list[tuple[str, str, str]] = []  # class, kind, text
        every = [(lic, n) for lic, names in NAMES.items() for n in names] + [(_OTHER, n) for n in OTHER]
        for lic, name in every:
            rows.append((lic, "name", name))
            rows += [(lic, "statement", s.format(name)) for s in STATEMENTS]
            rows += [(_TALK, "talk", s.replace("{}", name, 1).replace("{}", "BSD")) for s in TALK]
            rows += [(_TALK, "talk", s.replace("{}", "MIT", 1).replace("{}", name)) for s in TALK if s.count("{}") > 1]
        rows += [(lic, "text", t) for lic, ts in TEXTS.items() for t in ts] + [(_OTHER, "text", t) for t in OTHER_TEXTS]
        rows.sort(key=lambda r: (r[1], r[0]))
        self.classes = [*NAMES, _OTHER, _TALK]
        groups: dict[tuple[str, str], int] = {}
        for i, (lic, kind, _) in enumerate(rows):
            groups.setdefault((kind, lic), i)
        self.groups, self.starts = list(groups), np.array(list(groups.values()))
        terms = [_terms(t) for _, _, t in rows]
        seen: dict[str, int] = {}
        for ts in terms:
            for t in set(ts):
                seen[t] = seen.get(t, 0) + 1
        n = self.n = len(rows)
        self.idf = {t: float(np.log((1 + n) / (1 + c)) + 1) for t, c in seen.items()}
        self.unseen = float(np.log(1 + n) + 1)
        posted: dict[str, tuple[list[int], list[float]]] = {t: ([], []) for t in seen}
        for i, ts in enumerate(terms):
            counts: dict[str, int] = {}
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
            norm = np.sqrt(sum((c * self.idf[t]) ** 2 for t, c in counts.items()))
            for t, c in counts.items():
                posted[t][0].append(i)
                posted[t][1].append(c * self.idf[t] / norm)
        self.posted = {t: (np.array(i), np.array(w)) for t, (i, w) in posted.items()}
        #: Words of which a name of a license consists, but for versions and words of any sentence; without one of them no license is named.
        self.telling = {w for _, k, t in rows if k == "name" for w in _TERM.findall(t.lower()) if w.isalpha()}
        self.telling -= {"v", "version", "new", "only", "later", "software", "general", "public", *(w for s in (*STATEMENTS, *TALK) for w in _TERM.findall(s.lower()))}

    def cosines(self, text: str, free: float) -> dict[tuple[str, str], float]:
        """(kind, class): cosine of the text to its nearest template of that kind and class; words outside all templates weigh ``free``."""
        counts: dict[str, int] = {}
        for t in _terms(text):
            counts[t] = counts.get(t, 0) + 1
        total, rows, parts = 0.0, [], []
        for t, c in counts.items():
            hit = self.posted.get(t)
            if hit is None:
                total += (free * c * self.unseen) ** 2
                continue
            w = c * self.idf[t]
            total += w * w
            rows.append(hit[0])
            parts.append(hit[1] * w)
        if not rows:
            return {}
        product = np.bincount(np.concatenate(rows), np.concatenate(parts), self.n) / np.sqrt(total)
        return dict(zip(self.groups, np.maximum.reduceat(product, self.starts).tolist()))


_templates: Templates | None = None


def _cosines(text: str, free: float) -> dict[tuple[str, str], float]:
    global _templates
    _templates = _templates or Templates()
    return _templates.cosines(text, free)


def _best(found: dict[tuple[str, str], float], kinds: tuple[str, ...], accept: float) -> str | None:
    """The license whose nearest template of these kinds reaches ``accept`` and beats every other license by MARGIN, and talk."""
    scores: dict[str, float] = {}
    for (kind, lic), c in found.items():
        if kind in kinds:
            scores[lic] = max(scores.get(lic, 0.0), c)
    order = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    if not order or order[0][0] == _OTHER or order[0][1] < accept or (len(order) > 1 and order[0][1] < order[1][1] + MARGIN):
        return None
    if order[0][1] < found.get(("talk", _TALK), 0.0) + TALK_MARGIN and "statement" in kinds:
        return None
    return order[0][0]


_EITHER = re.compile(r"\s+(?:or|\|\|?)\s+|\s*/\s*", re.I)
_BOTH = re.compile(r"\s+and\s+", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:SPDX|@|Licen[cs]e\s*:|Copyright))")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _of_parts(text: str, kinds: tuple[str, ...], accept: float, free: float) -> set[str]:
    """The licenses of a phrase whose parts are joined by "and"; parts joined by "or" are one choice."""
    out: set[str] = set()
    for both in _BOTH.split(text):
        either = _EITHER.split(both)
        found = {x for p in either if (x := _best(_cosines(p, free), kinds, accept))} if len(either) > 1 else set()
        if len(found) > 1:
            out.add(" OR ".join(sorted(found)))
        elif x := _best(_cosines(both, free), kinds, accept):
            out.add(x)
        else:
            out |= found
    return out


_known: dict[str, frozenset[str]] = {}


def _sentence(s: str) -> frozenset[str]:
    """The licenses that a sentence states."""
    if s not in _known:
        if len(_known) > 50_000:
            _known.clear()
        words = set(_TERM.findall(s.lower()))
        _cosines("", 0.0)
        if not words & _templates.telling:
            return frozenset()
        kinds = ("statement", "name")
        found = _cosines(s, FREE)
        grant = max((c for (kind, lic), c in found.items() if kind in kinds), default=0.0)
        out: set[str] = set()
        if grant >= ACCEPT and grant >= found.get(("talk", _TALK), 0.0) + TALK_MARGIN:
            out = _of_parts(s, kinds, ACCEPT, FREE) if _EITHER.search(s) or _BOTH.search(s) else set()
            if not out and (x := _best(found, kinds, ACCEPT)):
                out = {x}
        _known[s] = frozenset(out)
    return _known[s]


def _bodies(text: str) -> set[str]:
    """The licenses whose text this is, or whose passages stand in it."""
    if len(text) < 50:
        return set()
    if x := _best(_cosines(text, FREE), ("text",), BODY):
        return {x}
    parts = [p for p in _PARAGRAPH.split(text) if len(p) >= 50]
    return {x for p in parts if (x := _best(_cosines(p, FREE), ("text",), BODY))}


_BODY_SIGN = re.compile(r"(?i)hereby\s+granted|redistribut|unencumbered|Source\s+Code\s+Form|Covered\s+Software|shall\s+mean|in\s+compliance\s+with|\"This\s+License|This\s+License\s+Agreement|Neither\s+the\s+name")


def stated(text: str | None) -> set[str]:
    """The licenses that a header states, by the text of a license or by a sentence; talk about licenses states none."""
    if not text:
        return set()
    if _BODY_SIGN.search(text) and (found := _bodies(text)):
        return found
    return {lic for s in _SENTENCE.split(text) for lic in _sentence(s.strip())}


def named(field: str | None) -> str | None:
    """The license that a short field names as a whole, a choice of two being one; none for null, blanks and fillers."""
    if not field or not field.strip():
        return None
    found = _of_parts(field.strip(), ("name",), ALONE, 1.0)
    return next(iter(found)) if len(found) == 1 else None


_CODING = re.compile(r"#.*?coding[:=]")
_QUOTED = re.compile(r"[rRuUbB]{0,2}(\"\"\"|'''|\"|')([\s\S]*?)(?<!\\)\1")
_FIELD = re.compile(r"(?m)^__license__\s*(?::\s*\w+\s*)?=\s*(?:\(\s*)?[rRuU]?([\"'])(.*?)\1")


def opening(text: str) -> str:
    """The comment or docstring that opens a file, after a #! or coding line."""
    lines = re.split(r"\r\n|\n|\r", text.removeprefix("﻿"))
    i = 0
    while i < len(lines) and (not lines[i].strip() or (i == 0 and lines[i].startswith("#!")) or (i < 3 and _CODING.match(lines[i]))):
        i += 1
    if i == len(lines):
        return ""
    first = lines[i].strip()
    for mark in ("#", "//"):
        if first.startswith(mark):
            out = []
            while i < len(lines) and lines[i].strip().startswith(mark):
                out.append(lines[i].strip().lstrip("#/!").strip())
                i += 1
            return "\n".join(out)
    rest = "\n".join(lines[i:]).lstrip()
    if first.startswith("/*"):
        end = rest.find("*/")
        body = rest[2 : end if end >= 0 else None]
        return "\n".join(x.strip().lstrip("*!").strip() for x in body.split("\n")).strip()
    m = _QUOTED.match(rest)
    return m[2].strip() if m else ""


def own_evidence(text: str | None, field: str | None) -> set[str]:
    """Licenses that the field, the opening statement and a __license__ value name."""
    out = set()
    if text:
        out |= stated(opening(text))
        if "__license__" in text:
            out |= {lic for m in _FIELD.finditer(text) if (lic := named(m[2]))}
    if lic := named(field):
        out.add(lic)
    return out


def license_file_names(text: str | None) -> set[str]:
    """The licenses that a license file names: by its title, and by its text or the statements in it."""
    if not text:
        return set()
    title = next((x.strip() for x in re.split(r"\r\n|\n|\r", text) if x.strip()), "")
    out = {lic} if (lic := named(title)) else set()
    return out | stated(re.sub(r"\r\n?", "\n", text))


def _is_license_file(path: Column) -> Column:
    return F.coalesce(F.regexp_replace(path, r"\\", "/").rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*\z"), F.lit(False))


def _at_root(path: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "").rlike(r"(?i)^(licen[sc]e|copying)[^/]*\z"), F.lit(False))


def repository_key(repo: Column) -> Column:
    """Trimmed and lower case; null for null and blank names."""
    key = F.lower(F.trim(repo))
    return F.when(key != "", key)


def evidence(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, per record, ``repo`` (trimmed, lower case), ``column_license``, ``names`` (sorted own evidence,
    or what a license file names), ``is_file`` and ``at_root``.

    Null texts, fields and paths are no evidence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, str | None] = {}
        for b in batches:
            names, column = [], []
            for text, field, is_file in zip(b["_text"], b["_field"], b["is_file"]):
                if field not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[field] = named(field)
                column.append(known[field])
                names.append(sorted(license_file_names(text) if is_file else own_evidence(text, field)))
            yield b.drop(columns=["_text", "_field"]).assign(column_license=column, names=names)

    kept = df.select(
        *[F.col(c) for c in keep],
        repository_key(F.col("repo_name")).alias("repo"),
        _is_license_file(F.col("path")).alias("is_file"),
        _at_root(F.col("path")).alias("at_root"),
        F.col("text").alias("_text"),
        F.col("license").alias("_field"),
    )
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name[0] != "_")
    return kept.mapInPandas(run, out + ", column_license string, names array<string>")


def repository_licenses(seen: DataFrame) -> DataFrame:
    """(repo, repo_verdict): the one license that the license files at the root name, or CONFLICT."""
    return (
        seen.filter("at_root and repo is not null")
        .select("repo", F.explode("names").alias("name"))
        .groupBy("repo")
        .agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"))
        .select("repo", F.when(F.col("n") > 1, CONFLICT).otherwise(F.col("name")).alias("repo_verdict"))
    )


def verdicts(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``repo``, ``column_license`` and ``verdict`` of each record that is no license file.

    Two or more licenses in a record's own evidence are a CONFLICT, one is the
    verdict; without any it is that of the repository's root license files,
    UNKNOWN if there is none, or no repository.
    """
    seen = evidence(df, keep)
    # Of this table only the license files at a root are read; it has at most one row a repository.
    repos, _ = sized(repository_licenses(evidence(df.filter(_at_root(F.col("path"))), [])))
    own = F.when(F.size("names") > 1, CONFLICT).when(F.size("names") == 1, F.col("names")[0])
    return (
        seen.filter("not is_file")
        .withColumn("own", own)
        .join(repos, "repo", "left")
        .select(*keep, "repo", "column_license", F.coalesce("own", "repo_verdict", F.lit(UNKNOWN)).alias("verdict"))
    )


def by_directory(df: DataFrame) -> DataFrame:
    """(repo, directory, files, conflicts, unknowns, licenses, mixed): verdicts rolled up to every directory above a file.

    ``directory`` is '' for the root; a file counts in its own directory and in
    all that hold it. ``mixed``: the files below have more than one license.
    """
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", "")
    v = verdicts(df, ["path"]).withColumn("_parts", F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/"))
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("_parts")[0] == "", 0).otherwise(F.size("_parts"))), lambda n: F.array_join(F.slice("_parts", 1, n), "/"))
    v = v.select("repo", "verdict", F.explode(F.coalesce(above, F.array(F.lit("")))).alias("directory"))
    named = F.array_sort(F.collect_set(F.when(~F.col("verdict").isin(CONFLICT, UNKNOWN), F.col("verdict"))))
    return v.groupBy("repo", "directory").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("verdict") == CONFLICT).alias("conflicts"),
        F.count_if(F.col("verdict") == UNKNOWN).alias("unknowns"),
        named.alias("licenses"),
        (F.size(named) > 1).alias("mixed"),
    )


def by_repository(df: DataFrame) -> DataFrame:
    """(repo, verdict, files, conflicts, unknowns, mixed): one license per repository.

    The verdict is that of the license files at the root; without any, the one
    license its files name, CONFLICT if they name several and UNKNOWN if none.
    ``mixed``: a file's license is another than the repository's. Rows without
    repository are one group with a null ``repo``.
    """
    seen = evidence(df, [])
    roots, _ = sized(repository_licenses(evidence(df.filter(_at_root(F.col("path"))), [])))
    own = F.when(F.size("names") > 1, CONFLICT).when(F.size("names") == 1, F.col("names")[0])
    each = seen.filter("not is_file").select("repo", own.alias("own"))
    per = each.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("own") == CONFLICT).alias("conflicts"),
        F.count_if(F.col("own").isNull()).alias("unknowns"),
        F.array_sort(F.collect_set("own")).alias("names"),
    )
    by_files = F.when(F.size("names") > 1, CONFLICT).otherwise(F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(UNKNOWN)))
    verdict = F.coalesce("repo_verdict", by_files)
    other = F.exists("names", lambda n: n != verdict)
    # A repository of license files only has a root verdict and no other files.
    return per.join(roots, "repo", "full").select(
        "repo",
        verdict.alias("verdict"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "conflicts", "unknowns")],
        F.coalesce(other, F.lit(False)).alias("mixed"),
    )
