"""License scan: matching statistics of texts against a generalised suffix automaton of licence templates.

All templates go into one suffix automaton over word numbers. A text is streamed through it once: after each word the
automaton knows the longest suffix of what was read that occurs in some template, and in which templates. Where that
length stops growing a maximal match ends; maximal matches of a template that lie in order are chained, small gaps
allowed, into spans. The score is the largest share of a template that a chain covers, less where that is under SURE words;
a template whose chain covers COVERED of it gives its label. Phrases give base labels wherever their words stand consecutively.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Defined cases: null and empty texts have no words,
score 0 and empty labels; a text of any length is streamed whole; overlapping phrases all count; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices and paragraphs of public licences, and the labels they give.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("all-rights-reserved", "All rights reserved."),
]
#: Share of a template that a chain must cover; words of a match that counts; words between matches of one chain; words
#: covered from which on the share alone is the score (three words of a notice say less than a paragraph).
COVERED, LEAST, GAP, SURE = 0.8, 3, 8, 5

_SEPARATE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_SEPARATE).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences. Each state knows the sequences it occurs in, and an end in each."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                state = last
                while state > 0:  # every suffix ends here too; the first place is kept
                    if number in self.ends[state]:
                        break
                    self.ends[state][number] = at
                    state = self.link[state]

    def _new(self, length: int, to: dict[bytes, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, child: int) -> int:
        """A copy of child that stands for its suffixes of length[state] + 1 words and less."""
        copy = self._new(self.length[state] + 1, dict(self.next[child]), self.link[child], dict(self.ends[child]))
        self.link[child] = copy
        while state >= 0 and self.next[state].get(word) == child:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        child = self.next[last].get(word)
        if child is not None:  # another sequence had these words
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new, state = self._new(self.length[last] + 1, {}, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            child = self.next[state][word]
            self.link[new] = child if self.length[child] == self.length[state] + 1 else self._split(state, word, child)
        return new

    def matches(self, words: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches of at least `least` words; end is one past the last word."""
        state = length = 0
        step, link, size = self.next, self.link, self.length
        known = step[0]
        for at, word in enumerate(words):
            if word not in known:  # in no template: most words of most texts
                if length >= least:
                    yield at, length, state
                state = length = 0
                continue
            to = step[state].get(word)
            if to is None:
                if length >= least:
                    yield at, length, state
                while to is None:
                    state = link[state]
                    length = size[state]
                    to = step[state].get(word)
            state, length = to, length + 1
        if length >= least:
            yield len(words), length, state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None):
        self.templates = templates or TEMPLATES
        self.phrases = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]
        split = [words_of(t) for _, t in self.templates]
        self.sizes = [len(w) for w in split]
        self.automaton = SuffixAutomaton(split)

    def base(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, words, label) of each place of each phrase."""
        found, present = [], set(words)
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                rare, at, n = min(range(len(phrase)), key=lambda i: words.count(phrase[i])), -1, len(phrase)
                for _ in range(words.count(phrase[rare])):
                    at = words.index(phrase[rare], at + 1)
                    if at >= rare and words[at - rare : at - rare + n] == phrase:
                        found.append((at - rare, n, label))
        return found

    def chains(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, one past the last, words covered): the chain of each template that covers most.

        The best chain that ends with a match goes on from the best of the template's matches that end GAP words before it
        or later and earlier in the template; where both overlap, the words count once.
        """
        recent: dict[int, list[tuple[int, int, int, int]]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for end, length, state in self.automaton.matches(words, LEAST):
            begin = end - length
            for t, at in self.automaton.ends[state].items():
                place, covered, first, near = at - length + 1, length, begin, []
                for before in recent.get(t, ()):
                    e, following, c, f = before
                    if e < begin - GAP:
                        continue
                    near.append(before)
                    again = max(0, e - begin)  # words that both hold
                    if again < length and place + again >= following and c + length - again > covered:
                        covered, first = c + length - again, f
                near.append((end, at + 1, covered, first))
                recent[t] = near
                if covered > best.get(t, (0, 0, 0))[2]:
                    best[t] = (first, end, covered)
        return [(t, a, b, n) for t, (a, b, n) in best.items()]

    def scan(self, text: str | bytes | None) -> dict:
        words = words_of(text or b"")
        places = self.base(words)
        spans = [(t, a, b, min(1.0, n / self.sizes[t])) for t, a, b, n in self.chains(words)]
        hits = [s for s in spans if s[3] >= COVERED]
        base = {label for _, _, label in places}
        starts = [p[0] for p in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {self.templates[t][0] for t, *_ in hits})),
            "score": max([1.0 * bool(places), *(s[3] * min(1.0, s[3] * self.sizes[s[0]] / SURE) for s in spans)]),
            "spans": [{"label": self.templates[t][0], "begin": a, "end": b, "covered": c} for t, a, b, c in sorted(hits, key=lambda h: h[1:3])],
        }


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,begin:bigint,end:bigint,covered:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": spans}
    for batch in batches:
        found = [scanner().scan(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, labels, score and the covered template spans (in words)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(_scan, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")
