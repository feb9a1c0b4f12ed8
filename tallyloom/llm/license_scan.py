"""License scan by conditional compression against license wordings."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import bounded

# Public license notices and names, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
#: Besides, every license is named by its tag.
TAG = "SPDX-License-Identifier: {}"
#: Strings one of which a candidate block holds, in lower case.
ANCHORS = ("licens", "licenc", "permission", "redistribut", "public domain", "creative commons", "cc by", "cc-by", "cc0", "copyright", "spdx", "warrant")
ANCHOR = re.compile("|".join(map(re.escape, ANCHORS)))
#: A text without any of their first words has no block; an anchor's two words may stand on two lines.
HINT = re.compile("|".join(sorted({re.escape(a.split()[0]) for a in ANCHORS})))
WORDS = re.compile(r"[\w.+/:-]*\w")
#: Between the halves of a word that a line breaks at its hyphen, before a comment's mark.
BROKEN = re.compile(r"-[ \t]*\r?\n[\s#*/;%>]*")
#: Share of a wording's words that must stand in order in a block.
CONFIRM = 0.8
#: Words that tell one license from another: a wording that lacks one, or has another one within, is another license's.
NAME = re.compile(r"affero|lesser|attribution|noncommercial|sharealike|noderiv|(?:cc-)?by(?:-|$)|cc0|mit$|apache|mozilla|mpl|bsd|\d-clause|isc$|eclipse|epl|boost|neither|endorse")
DIGIT = re.compile(r"\d")
#: Right before a wording these deny it.
DENIAL = frozenset(("not", "never", "isn't", "cannot", "non"))


#: Words of the longest wording that a short candidate block serves: what a short wording saves would drown in a long block.
SHORT = 16


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.known = [(name, wording, [w.lower() for w in WORDS.findall(wording)]) for name, all_ in templates.items() for wording in (*all_, TAG.format(name))]
        # At this level bytes without a match are kept as they are, so what a wording saves is its matches and no change of an entropy code.
        self.plain = zstandard.ZstdCompressor(level=-1)
        # A raw dictionary holds at least eight bytes; blanks before it are never nearer than its words.
        self.given = []
        for _, _, want in self.known:
            words = zstandard.ZstdCompressionDict(" ".join(want).encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=-1)
            self.given.append(zstandard.ZstdCompressor(level=-1, dict_data=words))
        longest = max((len(want) for _, _, want in self.known), default=0)
        self.scale = [SHORT if len(want) <= SHORT else longest for _, _, want in self.known]
        # Where each wording's anchor words stand in it.
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for k, (_, wording, want) in enumerate(self.known):
            low = wording.lower()
            at = [(m.start(), m.end()) for m in WORDS.finditer(low)]
            held = [(m.start(), m.end()) for m in ANCHOR.finditer(low)]
            for i, (s, e) in enumerate(at):
                if any(x < e and s < y for x, y in held):
                    self.anchors.setdefault(want[i], []).append((k, i))
        self.compared: dict = {}

    def reductions(self, block: list[str]) -> list[tuple[int, int, float]]:
        """(bytes saved, wording, share of bytes saved) of every wording that saves bytes of a block, the largest first."""
        text = " ".join(block).encode()
        alone = len(self.plain.compress(text))
        saved = [alone - len(given.compress(text)) for given in self.given]
        return sorted(((n, k, n / alone) for k, n in enumerate(saved) if n > 0), key=lambda x: (-x[0], x[1]))

    def compare(self, k: int, own: tuple[str, ...]):
        """(share found, differing words, words of own that agree) of a window, or None."""
        want = self.known[k][2]
        held = set(own)
        if sum(w in held for w in want) < CONFIRM * len(want):
            return None
        codes = difflib.SequenceMatcher(None, want, own, False).get_opcodes()
        equal = [j for op, _, _, j1, j2 in codes if op == "equal" for j in range(j1, j2)]
        if len(equal) < CONFIRM * len(want) or not DENIAL.isdisjoint(own[max(0, equal[0] - 2) : equal[0]]):
            return None
        # A version or name that differs names another license, whatever the rest.
        lost = [w for op, i1, i2, _, _ in codes if op != "equal" for w in want[i1:i2]]
        added = [w for op, _, _, j1, j2 in codes if op != "equal" for w in own[max(j1, equal[0]) : min(j2, equal[-1])]]
        if any(NAME.match(w) or DIGIT.search(w) for w in lost) or any(map(NAME.match, added)):
            return None
        extra = equal[-1] + 1 - equal[0] - len(equal)
        return len(equal) / len(want), len(want) - len(equal) + extra, equal

    def blocks(self, words: list[str]) -> dict[tuple[int, int], dict[int, set[int]]]:
        """Candidate blocks (first word, words), each with the places from which its wordings are confirmed.

        Blocks start at every `scale` words and are three times as long, so every window of a wording, a fifth longer
        on either side and laid around an anchor word, lies within one. Only blocks with such a window are kept.
        """
        out: dict[tuple[int, int], dict[int, set[int]]] = {}
        for t, w in enumerate(words):
            for k, i in self.anchors.get(w, ()):
                n, size = len(self.known[k][2]), self.scale[k]
                first = t - i - n // 5 - 1
                out.setdefault((max(0, first) // size * size, 3 * size), {}).setdefault(k, set()).add(first)
        return out

    def scan(self, text: str):
        """(license, offset, share of bytes saved, share of wording found, words differing) of each confirmed block.

        Every candidate block of the whole text, across sentences, lines and paragraphs, is compressed with every
        wording; the reductions are ranked, and the wordings confirmed in that order. Among those confirmed the
        larger reduction names the license of the words that they share.
        """
        if not HINT.search(text.lower()):
            return []
        at: list[tuple[str, int]] = []
        end = 0
        for m in WORDS.finditer(text):
            if at and text[end : end + 1] == "-" and BROKEN.fullmatch(text, end, m.start()):
                at[-1] = at[-1][0] + "-" + m[0].lower(), at[-1][1]
            else:
                at.append((m[0].lower(), m.start()))
            end = m.end()
        words = [w for w, _ in at]
        hits = set()
        for (start, size), places in self.blocks(words).items():
            for saved, k, reduction in self.reductions(words[start : start + size]):
                n = len(self.known[k][2])
                for first in places.get(k, ()):
                    lo = max(0, first)
                    own = tuple(words[lo : first + 1 + n // 5 + n + n // 5 + 1])
                    if (k, own) not in self.compared:
                        if len(self.compared) > 20_000:
                            self.compared.clear()
                        self.compared[k, own] = self.compare(k, own)
                    if hit := self.compared[k, own]:
                        share, differ, equal = hit
                        hits.add((-saved, differ, -share, lo + equal[0], k, reduction, frozenset(lo + j for j in equal)))
        taken: list[tuple[str, frozenset]] = []
        out = []
        for _, differ, share, first, k, reduction, places in sorted(hits, key=lambda h: h[:6]):
            name = self.known[k][0]
            # Words that already stand for a wording of larger reduction do not name a second license; one place counts once a license.
            if any(places <= p or name == x and places & p for x, p in taken):
                continue
            taken.append((name, places))
            out.append((name, at[first][1], reduction, -share, differ))
        return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n_blocks, first_offset, reduction, wording, differences) of each license a document names.

    Candidate blocks are stretches of words around the license words of the whole text, whatever lines and
    sentences they cross. Each is compressed with every wording as raw dictionary; wordings that save bytes are
    ranked by how many and confirmed in that order: CONFIRM of the wording must stand in order, without a changed
    version. reduction is the share of its block's bytes that the wording saves. One row a document and license,
    of its best block (fewest differences, then first); a block may name several. Null and empty texts name none; repeated rows give repeated rows; a null doc_id stays
    null. Only doc_id and text are read. A map without shuffle.
    """

    def run(batches):
        scanner = Scanner()
        for b in batches:
            rows = []
            for row, text in enumerate(b.column(1)):
                best: dict[str, tuple] = {}
                for name, at, saved, share, differ in scanner.scan(text.as_py() or ""):
                    old = best.get(name)
                    new = (differ, at, saved, share)
                    best[name] = (min(old[0], new), old[1] + 1) if old else (new, 1)
                rows += [(row, name, n, v[1], v[2], v[3], v[0]) for name, (v, n) in sorted(best.items())]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), pa.array(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.float64()), pa.array(c[6], pa.int32())], names=["doc_id", "license", "n_blocks", "first_offset", "reduction", "wording", "differences"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, n_blocks int, first_offset long, reduction double, wording double, differences int")
