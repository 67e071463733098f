"""License scan by conditional compression.

Blocks of lines around trigger words are compressed with each template as a
zstandard raw dictionary.  Templates are ranked by the bytes they spare and
confirmed in that order by exact wording differences: a wording holds that
differs too little to be another license.  The rank leaves no template out but
those of which more words are missing from a block than any confirmation
allows.  Of wordings that overlap, the one counts whose template spares most
of the stretch itself; then the one of fewest differences; then of best rank.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of licenses and notices, ``license/wording``.
_NO_WARRANTY = "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_BSD2 = f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS {_NO_WARRANTY}"
TEMPLATES = {
    "mit/release": "Released under the MIT License.",
    "mit/licensed": "Licensed under the MIT License.",
    "mit/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0/work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0/work": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0/work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0/work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-2-clause/text": _BSD2,
    "bsd-3-clause/text": _BSD2.replace(" THIS SOFTWARE IS", " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS"),
    "isc/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0/line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0/line": "Licensed under CC BY-ND 4.0.",
    "cc-by-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "unlicense/text": "This is free and unencumbered software released into the public domain.",
    "proprietary/line": "All rights reserved.",
}
#: Lines with one of these words open a block.
TRIGGER = re.compile(r"licen[sc]e|copyright|permission\W+(?:is|to)|redistribut|warrant|public\W+domain|rights\W+reserved|creative\W+commons|public\W+license|spdx|unencumbered", re.I)
#: Lengths of the longest template that a block reaches to either side of a trigger (prefixes and indents lengthen a
#: wording), and characters after which a line's end is no longer waited for; blocks that touch are one.
REACH, MARGIN = 2, 240
#: Words of a block that are compared at once; the parts of a longer one (a text full of triggers) have as many words
#: in common as the longest wording can have, so every wording is whole in one of them.
PART = 1_000
#: Share of the words that may be missing, and that may be foreign.
TOLERANCE = 0.08
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*", re.A | re.I)
LEVEL = 3


@dataclass
class Matcher:
    """Templates with their compressors; one for each task."""

    templates: dict[str, str]

    def __post_init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.reach = REACH * max(map(len, self.templates.values()), default=0)
        self.primed = {}
        self.words = {}
        for name, text in self.templates.items():
            raw = zstandard.ZstdCompressionDict(_folded(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.primed[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)
            self.words[name] = [w.lower() for w in WORD.findall(text)]
        self.vocabulary = {w for words in self.words.values() for w in words}
        #: Words of the longest wording with all foreign ones that it may have.
        self.longest = max((len(words) + int(TOLERANCE * len(words)) for words in self.words.values()), default=0)

    def gain(self, name: str, block: str) -> int:
        """Bytes that a template spares in compressing a block."""
        data = _folded(block).encode("utf-8", "surrogatepass")
        return len(self.plain.compress(data)) - len(self.primed[name].compress(data))

    def possible(self, name: str, where: dict[str, int]) -> bool:
        """Whether a block has enough of a template's words for any confirmation."""
        wanted = self.words[name]
        return bool(wanted) and sum(w not in where for w in wanted) <= int(TOLERANCE * len(wanted))

    def masks(self, words: list[str]) -> dict[str, int]:
        """The places (bits) of each word of the templates among ``words``."""
        bits: dict[str, bytearray] = {}
        for j, w in enumerate(words):
            if w in self.vocabulary:
                if w not in bits:
                    bits[w] = bytearray(len(words) // 8 + 1)
                bits[w][j >> 3] |= 1 << (j & 7)
        return {w: int.from_bytes(b, "little") for w, b in bits.items()}

    def confirm(self, name: str, where: dict[str, int], n_words: int) -> list[tuple[int, int, int, int]]:
        """Places of the template's wording among the words of ``where``: first word, end, missing and foreign words.

        None is overlooked: every alignment with at most the allowed missing
        and the allowed foreign words is followed; of places that overlap the
        one with the fewest of both counts.
        """
        wanted = self.words[name]
        allowed = int(TOLERANCE * len(wanted))
        ends = _ends([where.get(w, 0) for w in wanted], (1 << n_words + 1) - 1, allowed)
        out: list[tuple[int, int, int, int]] = []
        busy = 0
        for missing, foreign in sorted(ends, key=lambda k: (sum(k), k)):
            open_ends = ends[missing, foreign] & ~busy
            while open_ends:
                last = open_ends.bit_length() - 1
                first = last - (len(wanted) - missing + foreign)
                span = (1 << last + 1) - (1 << first + 1)
                if not busy & span:
                    out.append((first, last, missing, foreign))
                    busy |= span
                open_ends &= ~(1 << last) & ~busy
        return out

    def scan(self, text: str) -> list[dict]:
        """Licenses of a text: name, wording, place (code points), bytes spared, words missing and foreign."""
        found: list[tuple[dict, int]] = []
        for a, b in blocks(text, self.reach):
            places = [m.span() for m in WORD.finditer(text, a, b)]
            for lo in range(0, max(1, len(places) - self.longest), PART):
                part = places[lo : lo + PART + self.longest]
                where = self.masks([text[x:y].lower() for x, y in part])
                possible = [name for name in self.templates if self.possible(name, where)]
                block = text[part[0][0] : part[-1][1]] if possible else ""
                ranked = sorted(possible, key=lambda name: (-self.gain(name, block), name)) if len(possible) > 1 else possible
                for rank, name in enumerate(ranked):
                    license_id, wording = name.split("/")
                    for first, last, missing, foreign in self.confirm(name, where, len(part)):
                        x, y = part[first][0], part[last - 1][1]
                        found.append(({"license": license_id, "wording": wording, "start": x, "end": y, "gain": self.gain(name, text[x:y]), "missing": missing, "foreign": foreign}, rank))
        out: list[dict] = []  # in the order of their places
        for r, _ in sorted(found, key=lambda f: (-f[0]["gain"], f[0]["missing"] + f[0]["foreign"], f[1], f[0]["start"], f[0]["license"], f[0]["wording"])):
            i = bisect_left(out, r["end"], key=lambda o: o["start"])
            if not i or out[i - 1]["end"] <= r["start"]:
                out.insert(i, r)
        return out


def _ends(masks: list[int], everywhere: int, allowed: int) -> dict[tuple[int, int], int]:
    """Word boundaries (bits) where all of a template can end, by missing and foreign words.

    ``masks`` has, for each of its words, a bit for each equal word of the
    block.  A state holds the boundaries that its first words can reach.
    """
    states = {(0, 0): everywhere}
    for i, mask in enumerate(masks):
        after: dict[tuple[int, int], int] = {}
        for (missing, foreign), bits in states.items():
            if taken := (bits & mask) << 1:
                after[missing, foreign] = after.get((missing, foreign), 0) | taken
            if missing < allowed:
                after[missing + 1, foreign] = after.get((missing + 1, foreign), 0) | bits
        if i + 1 < len(masks):
            for foreign in range(allowed):
                for missing in range(allowed + 1):
                    if bits := after.get((missing, foreign), 0) << 1 & everywhere:
                        after[missing, foreign + 1] = after.get((missing, foreign + 1), 0) | bits
        states = after
        if not states:
            break
    return states


def _folded(text: str) -> str:
    """Lower case with single spaces, which is what is compressed."""
    return " ".join(text.lower().split())


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Stretches of ``reach`` characters to either side of triggers, then out to whole lines (``MARGIN`` characters at most)."""
    spans: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        start, stop = text.rfind("\n", max(0, a - MARGIN), a), text.find("\n", b, b + MARGIN)
        a, b = (start + 1 if start >= 0 else max(0, a - MARGIN)), (stop if stop >= 0 else min(len(text), b + MARGIN))
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def with_licenses(docs: DataFrame, name: str, templates: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Add the column ``name``: an array of the licenses that the whole text states.

    Elements have ``license, wording, start, end, gain, missing, foreign``, in
    the order of their places (code points, end exclusive).  Null, empty and
    license-free texts have an empty array.  Wordings that overlap count once,
    the one that spares most.  Other columns are carried along untouched.
    """
    chosen = templates or TEMPLATES
    fields = [("license", pa.string()), ("wording", pa.string())] + [(f, pa.int64()) for f in ("start", "end", "gain", "missing", "foreign")]
    kind = pa.list_(pa.struct(fields))

    @F.arrow_udf("array<struct<license:string,wording:string,start:long,end:long,gain:long,missing:long,foreign:long>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(chosen)
        for column in batches:
            yield pa.array([matcher.scan(t.as_py() or "") for t in column], kind)

    return docs.withColumn(name, scan(F.col(text_col).cast("string")))
