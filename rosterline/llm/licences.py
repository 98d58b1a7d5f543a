"""Operator 3: licence recognition by sentence rules.

Text is cut into sentences, each is normalised and looked up among the known
licence sentences, and the sequence of their identifiers is matched against
ordered rules: a rule matches where its identifiers follow each other (unknown
sentences may stand between).  Longer rules are tried first and use up what they
match.

Licences come wrapped over lines as well as one statement a line, so sentences
are taken from both readings: every line by itself, and the text of a paragraph
joined over its lines.  A sentence found twice at one place counts once.

Defined cases: a null or empty text has no sentences; a licence repeated in a text
counts once in ``licences``; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_arrow, texts_of

__all__ = ["SENTENCES", "RULES", "scan_licences", "recognise"]

# --- fixed values: published licence sentences; * stands for any words -------------------
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-line": "Licensed under the GNU General Public License, version 3",
    "mit-line": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "apache2-line": "Licensed under the Apache License, Version 2.0",
    "apache2-head": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-head-comply": "Licensed under the Apache License, Version 2.0 (the \"License\"); "
                           "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at *",
    "ccbync4-line": "Licensed under CC BY-NC 4.0",
    "ccby4-line": "Licensed under CC BY 4.0",
    "ccbysa4-line": "Licensed under CC BY-SA 4.0",
    "cc0-line": "Released under CC0 1.0",
    "reserved": "All rights reserved",
    "copyright": "Copyright *",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND*",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                 "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                 "in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met: *",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of * nor the names of its contributors may be used to endorse or promote products "
                "derived from this software without specific prior written permission",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of "
                        "the GNU General Public License as published by the Free Software Foundation, either "
                        "version 3 of the License, or (at your option) any later version",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: (licence, kind, sentence identifiers in order)
RULES = [
    ("MIT", "permissive", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("MIT", "permissive", ("mit-line",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("ISC", "permissive", ("isc-grant", "as-is")),
    ("ISC", "permissive", ("isc-grant",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-binary")),
    ("Apache-2.0", "permissive", ("apache2-head", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", "permissive", ("apache2-head-comply", "apache2-copy")),
    ("Apache-2.0", "permissive", ("apache2-head-comply",)),
    ("Apache-2.0", "permissive", ("apache2-head",)),
    ("Apache-2.0", "permissive", ("apache2-line",)),
    ("GPL-3.0", "copyleft", ("gpl-redistribute",)),
    ("GPL-3.0", "copyleft", ("gpl3-work",)),
    ("GPL-3.0", "copyleft", ("gpl3-line",)),
    ("MPL-2.0", "copyleft", ("mpl2-subject",)),
    ("CC-BY-NC-4.0", "non-commercial", ("ccbync4-line",)),
    ("CC-BY-4.0", "permissive", ("ccby4-line",)),
    ("CC-BY-SA-4.0", "copyleft", ("ccbysa4-line",)),
    ("CC0-1.0", "permissive", ("cc0-line",)),
    ("all-rights-reserved", "proprietary", ("copyright", "reserved")),
    ("all-rights-reserved", "proprietary", ("reserved",)),
]
#: licence -> (kind, names by which one-line notices call it)
NAMES = {
    "MIT": ("permissive", ["MIT License", "MIT licence"]),
    "ISC": ("permissive", ["ISC License"]),
    "0BSD": ("permissive", ["BSD Zero Clause License", "Zero-Clause BSD License"]),
    "BSD-2-Clause": ("permissive", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    "BSD-3-Clause": ("permissive", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"]),
    "Apache-2.0": ("permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    "Zlib": ("permissive", ["zlib License"]),
    "BSL-1.0": ("permissive", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    "Unlicense": ("permissive", ["Unlicense"]),
    "CC0-1.0": ("permissive", ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License",
                               "Creative Commons Zero v1.0 Universal"]),
    "MPL-1.1": ("copyleft", ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"]),
    "MPL-2.0": ("copyleft", ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"]),
    "EPL-1.0": ("copyleft", ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0",
                             "Eclipse Public License - v 1.0"]),
    "EPL-2.0": ("copyleft", ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0",
                             "Eclipse Public License - v 2.0"]),
}
for _id, _name, _versions in (("GPL", "General Public License", ("2.0", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)),
                              ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("LGPL", "Library General Public License", ("2.0",))):
    for _v in _versions:
        _short = [_v, _v.removesuffix(".0")] if _v.endswith(".0") else [_v]
        NAMES[f"{_id}-{_v}"] = ("copyleft", [f"GNU {n}{by}{v}{end}" for n in (_name, _id) for v in _short
                                             for by in (" version ", ", version ", " v", " ")
                                             for end in ("", " or later", " or any later version", " only")])
        for _what in ("program", "library", "software", "file"):
            for _n in _short:
                _terms = f"This {_what} is free software; you can redistribute it and/or modify it under the terms of the GNU {_name}"
                for _i, _rest in enumerate((
                        f" as published by the Free Software Foundation; either version {_n} of the License, or (at your option) any later version",
                        f" as published by the Free Software Foundation; version {_n} of the License",
                        f" as published by the Free Software Foundation, version {_n}",
                        f" version {_n} as published by the Free Software Foundation")):
                    if _terms + _rest != SENTENCES["gpl-redistribute"].replace(":", ";").replace("Foundation, either", "Foundation; either"):
                        SENTENCES[f"{_id.lower()}{_n}-{_what}{_i}"] = _terms + _rest
                        RULES.append((f"{_id}-{_v}", "copyleft", (f"{_id.lower()}{_n}-{_what}{_i}",)))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _id, _name in _CC.items():
    for _v, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _spelt = {_name, _name.replace("NoDerivatives", "NoDerivs"), _name.replace("ShareAlike", "Share Alike")}
        NAMES[f"CC-{_id}-{_v}"] = (
            "non-commercial" if "NC" in _id else "no-derivatives" if "ND" in _id else "copyleft" if "SA" in _id else "permissive",
            [f"CC {_id} {_v}", f"CC-{_id}-{_v}"] + [f"Creative Commons {x} {_v}{port}{end}" for x in sorted(_spelt)
                                                    for port in ("", f" {_port}") for end in ("", " License")])
_SAID = ["Licensed under", "Released under", "Distributed under", "Available under"] + [
    f"This {x} is {y}" for x in ("work", "software", "program", "project", "file", "code")
    for y in ("licensed under", "released under", "distributed under")]
SENTENCES |= {
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 *",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 *",
    "epl2-v-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 *",
    "epl2-v2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 *",
    "bsl1-permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                       "and accompanying documentation covered by this license (the \"Software\") *",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
                       "alter it and redistribute it freely, subject to the following restrictions: *",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
RULES += [("Unlicense", "permissive", ("unlicense-domain",)), ("EPL-1.0", "copyleft", ("epl1-terms",)),
          *[("EPL-2.0", "copyleft", (x,)) for x in ("epl2-terms", "epl2-v-terms", "epl2-v2-terms")],
          ("BSL-1.0", "permissive", ("bsl1-permission",)), ("Zlib", "permissive", ("zlib-permission",)),
          ("0BSD", "permissive", ("0bsd-grant",))]
#: Identifiers of one-line notices and of SPDX lines, "line:" and "spdx:" before the licence.
RULES += [(licence, kind, (f"{how}:{licence}",)) for licence, (kind, _) in NAMES.items() for how in ("line", "spdx")]
# ---------------------------------------------------------------------------------------------

_NOT_WORD = re.compile(r"[^0-9a-z*]+")
#: The end of a sentence; "v. 2.0" is none.
_END = re.compile(r"(?<=[.!?])(?:(?<!\bv\.)(?<!\bver\.)|(?!\s+\d))\s+", re.I)
_PARAGRAPH = re.compile(r"\n\s*\n")
_SPDX = re.compile(r"SPDX-License-Identifier:([^\n]*)", re.I)
_COMMENT = re.compile(r"^[\s#/*;%-]+", re.M)


def normalise(sentence: str) -> str:
    """Lower-cased words of letters and digits with one space between."""
    return _NOT_WORD.sub(" ", sentence.lower().replace("*", " ")).strip()


def _known() -> tuple[dict[str, str], list[tuple[str, str, str]], int]:
    exact, open_ = {}, []
    for name, s in SENTENCES.items():
        head, star, tail = s.partition("*")
        if star:
            open_.append((normalise(head), normalise(tail), name))
        else:
            exact[normalise(s)] = name
    for licence, (_, names) in NAMES.items():
        for n in names:
            for said in _SAID:
                for the in (" ", " the ", " a "):
                    exact.setdefault(normalise(f"{said}{the}{n}"), f"line:{licence}")
    return exact, open_, max(len(k) for k in exact)


EXACT, OPEN, LONGEST = _known()
#: A known sentence starts with one of these words.
FIRST = frozenset(k.split(" ")[0] for k in [*EXACT, *(h for h, _, _ in OPEN)])
_FIRST = re.compile(r"[^0-9A-Za-z]*([0-9A-Za-z]+)")


def _hint() -> re.Pattern:
    """Finds one of a few words of which every known sentence has at least one."""
    left, words = [set(k.split(" ")) for k in [*EXACT, *(f"{h} {t}".strip() for h, t, _ in OPEN)]], []
    while left:
        count = Counter(w for k in left for w in k)
        words.append(max(count, key=lambda w: (count[w], len(w), w)))
        left = [k for k in left if words[-1] not in k]
    return re.compile("|".join(words), re.I)


_HINT = _hint()
#: SPDX identifiers, lower-cased; what follows the version does not change the licence.
SPDX = {f"{x}{end}".lower(): x for x in NAMES for end in ("", "+", "-only", "-or-later")}


def identify(sentence: str) -> str | None:
    """Identifier of a sentence, if it is known."""
    m = _FIRST.match(sentence)
    if not m or m[1].lower() not in FIRST:
        return None
    key = normalise(sentence)
    if key in EXACT:
        return EXACT[key]
    for head, tail, name in OPEN:
        if f"{key} ".startswith(f"{head} ") and f" {key}".endswith(f" {tail}" if tail else ""):
            return name
    return None


def identified(t: str) -> list[tuple[int, str]]:
    """(offset, identifier) of the known sentences of a text, in order."""
    found = set()
    for m in _SPDX.finditer(t):
        for x in re.finditer(r"[^\s()]+", m[1]):
            if x[0].lower() in SPDX:
                found.add((m.start(1) + x.start(), f"spdx:{SPDX[x[0].lower()]}"))
    at = 0
    for line in t.split("\n"):
        name = identify(line)
        if name:
            found.add((at + len(line) - len(line.lstrip()), name))
        pos = at
        for s in _END.split(line) if ". " in line or "! " in line or "? " in line else ():
            pos = t.find(s, pos)
            name = identify(s)
            if name:
                found.add((pos, name))
            pos += len(s)
        at += len(line) + 1
    at = 0
    for para in _PARAGRAPH.split(t):
        at = t.find(para, at)
        if "\n" in para and _HINT.search(para):
            first = at
            lines = {i for i, _ in found}
            for s in _END.split(_COMMENT.sub("", para).replace("\n", " ")):
                name = identify(s)
                # Its place is that of its first words in the text as it stands; a line found there counts once.
                place = t.find(s[:12], first)
                if name:
                    start = re.compile(r"[\s#/*;%-]+".join(map(re.escape, s.split()[:3]))).search(t, first)
                    place = start.start() if start else first
                first = max(first, place)
                if name and place not in lines:
                    found.add((place, name))
        at += len(para)
    return sorted(found)


BY_LENGTH = sorted(RULES, key=lambda r: -len(r[2]))


def recognise(names: list[str]) -> list[tuple[int, str, str]]:
    """(place, licence, kind) of the rules that match the identifier sequence, longest first, each identifier used once."""
    used, out = [False] * len(names), []
    for licence, kind, ids in BY_LENGTH:
        n = len(ids)
        for i in range(len(names) - n + 1):
            if tuple(names[i:i + n]) == ids and not any(used[i:i + n]):
                used[i:i + n] = [True] * n
                out.append((i, licence, kind))
    return sorted(out)


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentences, licences, kinds (comma-joined), places (offset:licence) of every document."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch):
        out = {c: [] for c in ("n_sentences", "sentences", "licences", "kinds", "places")}
        for t in texts_of(b.column("_text")):
            known = identified(t)
            rules = recognise([n for _, n in known])
            out["n_sentences"].append(len(known))
            out["sentences"].append(",".join(n for _, n in known))
            out["licences"].append(",".join(sorted({x for _, x, _ in rules})))
            out["kinds"].append(",".join(sorted({k for _, _, k in rules})))
            out["places"].append(",".join(f"{known[i][0]}:{x}" for i, x, _ in rules))
        yield out | {"doc_id": b.column("doc_id")}

    return map_arrow(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")], run,
                     f"doc_id {id_type}, n_sentences bigint, sentences string, licences string, kinds string, places string")
