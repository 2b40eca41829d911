"""License scans: templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import ALNUM_BYTES, as_bytes

#: Base phrases and their labels. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

HOLDER = '<<var;name="holder";match=".{1,5000}">>'
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<holder>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<holder>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<holder>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
GNU_HEADER = """is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of <<license>> as published by the Free Software Foundation<<version>>
<<var;name="what";match="this program|this library|it">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See <<license>> for more details."""


def gnu(name: str, version: str) -> list[str]:
    """Headers of one GNU license: this version only, or this and any later one."""
    later = f", either version {version} of the License, or (at your option) any later version."
    out = []
    for words in (later, f", version {version}<<beginOptional>> of the License<<endOptional>>."):
        body = GNU_HEADER.replace("<<license>>", f"the GNU {name}").replace("<<version>>", words)
        out += [f"{what} {body}" for what in ("This program", "This library")]
    return out


#: Template markup by label; a label may have several. <<beginOptional>> ... <<endOptional>> may be missing (attributes are
#: allowed); <<var;name="x";original="y";match="expression">> stands for text that the expression matches as a whole, its
#: width counted in characters. All other words are mandatory.
TEMPLATES: dict[str, str | list[str]] = {
    "mit-notice": [f"{verb} under the <<beginOptional>>terms of the<<endOptional>> MIT license" for verb in ("released", "licensed", "distributed", "available")],
    "apache-2.0-notice": "licensed under the Apache License Version 2.0",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;name=\"version\";match=\"[0-9]\">> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or any later version<<endOptional>>",
    "cc-by-notice": [
        "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>> <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4.0",
        "licensed under a Creative Commons Attribution <<beginOptional>>NonCommercial<<endOptional>> <<beginOptional>>ShareAlike<<endOptional>> <<beginOptional>>NoDerivatives<<endOptional>> 4.0 International License",
    ],
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;name="scheme";match="https?">>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-2.0-header": gnu("General Public License", "2"),
    "gpl-3.0-header": gnu("General Public License", "3"),
    "lgpl-2.1-header": gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0-header": gnu("Lesser General Public License", "3"),
    "agpl-3.0-header": gnu("Affero General Public License", "3"),
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
<<var;name="scheme";match="https?">>://mozilla.org/MPL/2.0/.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. """ + MIT_WARRANTY.replace("<<holder>>", HOLDER),
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<holder>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<holder>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""".replace("<<holder>>", HOLDER),
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";match=".{1,5000}">> (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. """ + MIT_WARRANTY.replace("<<holder>>", HOLDER),
    "bsd-2-clause-text": f"{BSD_CONDITIONS} {BSD_WARRANTY}".replace("<<holder>>", HOLDER),
    "bsd-3-clause-text": f"""{BSD_CONDITIONS} <<beginOptional>>3.<<endOptional>> Neither the name of <<holder>> nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. {BSD_WARRANTY}""".replace("<<holder>>", HOLDER),
}


class Words:
    """A text's words, and what they are in the text: asked for only once a replaceable region is entered."""

    def __init__(self, text: bytes):
        self.text, self.folded = text, text.translate(ALNUM_BYTES)
        self.words = self.folded.split()
        self.spans: list[tuple[int, int]] | None = None

    def width(self, a: int, b: int) -> int:
        """Characters from the beginning of word a to the end of word b - 1."""
        if self.spans is None:
            self.spans = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", self.folded)]
            starts = (np.frombuffer(self.text, dtype=np.uint8) & 0xC0) != 0x80
            self.chars = np.concatenate([[0], np.cumsum(starts)])
        return int(self.chars[self.spans[b - 1][1]] - self.chars[self.spans[a][0]])

    def raw(self, a: int, b: int) -> str:
        self.width(a, b)
        return self.text[self.spans[a][0] : self.spans[b - 1][1]].decode("utf-8", "replace")


class Region:
    """A replaceable region's rule: an expression over the characters of its words, and the widths that it allows."""

    def __init__(self, expression: str):
        self.rx = re.compile(expression, re.S | re.I)
        self.least, self.most = re._parser.parse(expression, re.S | re.I).getwidth()
        self.any = re.fullmatch(r"\.(?:[*+?]|\{\d*,?\d*\})?", expression) is not None

    def accepts(self, words: Words, a: int, b: int) -> bool:
        if a == b:
            return self.least == 0 and (self.any or self.rx.fullmatch("") is not None)
        return self.least <= words.width(a, b) <= self.most and (self.any or self.rx.fullmatch(words.raw(a, b)) is not None)


@dataclass
class Automaton:
    """States are numbered. `moves` takes (state, word), `free` takes none; a state in `regions` takes any words as long as
    its rule may still accept them, and is left for `after` where it does."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    regions: dict[int, tuple[Region, int]] = field(default_factory=dict)
    end: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, live: dict[int, set[int]], words: Words, at: int) -> dict[int, set[int]]:
        """live: state -> word numbers at which it was entered (only told apart for regions)."""
        todo = [(s, e) for s, entered in live.items() for e in entered]

        def reach(s: int) -> None:
            e = at if s in self.regions else 0
            if e not in live.setdefault(s, set()):
                live[s].add(e)
                todo.append((s, e))

        while todo:
            s, entered = todo.pop()
            for nxt in self.free[s]:
                reach(nxt)
            if s in self.regions and self.regions[s][0].accepts(words, entered, at):
                reach(self.regions[s][1])
        return live

    def match(self, words: Words, at: int) -> int | None:
        """The end of the longest text from word `at` on that the automaton accepts."""
        live, found = self.closure({0: {0}}, words, at), None
        while True:
            if self.end in live:
                found = at
            if at >= len(words.words):
                return found
            word, nxt = words.words[at], {}
            for s, entered in live.items():
                if s in self.regions:
                    rule = self.regions[s][0]
                    left = {e for e in entered if words.width(e, at + 1) <= rule.most}
                    if left:
                        # of two ways into a region without a rule but its widths, the earlier one accepts all that the later does
                        nxt[s] = {min(left)} if rule.any and rule.least <= 1 and rule.most > len(words.text) else left
                elif (t := self.moves[s].get(word)) is not None:
                    nxt.setdefault(t, set()).add(at + 1 if t in self.regions else 0)
            if not nxt:
                return found
            at += 1
            live = self.closure(nxt, words, at)

    def first_words(self) -> dict[bytes, set[bytes] | None] | None:
        """Words a match can begin with, each with the words that can follow (None: any, or nothing need follow); None if
        a match can begin with any word."""
        none = Words(b"")
        live = self.closure({0: {0}}, none, 0)
        if any(s in self.regions for s in live):
            return None
        out: dict[bytes, set[bytes] | None] = {}
        for word in {w for s in live for w in self.moves[s]}:
            nxt = self.closure({self.moves[s][word]: {0} for s in live if word in self.moves[s]}, none, 0)
            out[word] = None if self.end in nxt or any(s in self.regions for s in nxt) else {w for s in nxt for w in self.moves[s]}
        return out


def compile_template(label: str, markup: str) -> Automaton:
    """Optional regions get a way around them, replaceable ones a state with a rule. Regions may stand inside each other."""
    a = Automaton(label)
    at, starts = a.state(), []
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        tag = part[2:-2].split(";")[0].strip() if part.startswith("<<") else None
        if tag == "beginOptional":
            starts.append(at)
            at = a.state()
            a.free[starts[-1]].append(at)
        elif tag == "endOptional":
            if not starts:
                raise ValueError(f"{label}: optional region closed twice")
            inside, at = at, a.state()
            a.free[inside].append(at)
            a.free[starts.pop()].append(at)
        elif tag == "var":
            rule = re.search(r'match="((?:[^"\\]|\\.)*)"', part)
            if not rule:
                raise ValueError(f"{label}: replaceable region without match")
            inside = a.state()
            a.free[at].append(inside)
            at = a.state()
            a.regions[inside] = (Region(rule[1]), at)
        elif tag is not None:
            raise ValueError(f"{label}: unknown tag {tag}")
        else:
            for word in part.encode().translate(ALNUM_BYTES).split():
                nxt = a.state()
                a.moves[at][word] = nxt
                at = nxt
    if starts:
        raise ValueError(f"{label}: optional region not closed")
    a.end = at
    return a


class Scanner:
    """All templates at once: an automaton is only started where its first two words can stand."""

    def __init__(self, base: dict[str, str], templates: dict[str, str | list[str]]):
        self.starts: dict[bytes, list[tuple[Automaton, bool, set[bytes] | None]]] = {}
        own = [(label, m, False) for label, markups in templates.items() for m in ([markups] if isinstance(markups, str) else markups)]
        for label, markup, is_base in [(v, k, True) for k, v in base.items()] + own:
            automaton = compile_template(label, markup)
            first = automaton.first_words()
            if not first:
                raise ValueError(f"{label}: no mandatory word at the start")
            for word, second in first.items():
                self.starts.setdefault(word, []).append((automaton, is_base, second))

    def scan(self, text: bytes) -> dict:
        words, starts = Words(text), self.starts
        base, labels, own, places = [], set(), set(), []
        for at in [i for i, w in enumerate(words.words) if w in starts]:
            after = words.words[at + 1] if at + 1 < len(words.words) else None
            for automaton, is_base, second in starts[words.words[at]]:
                end = automaton.match(words, at) if second is None or after in second else None
                if end is None:
                    continue
                if is_base:
                    base.append(at)
                    labels.add(automaton.label)
                else:
                    own.add(automaton.label)
                    if (automaton.label, at, end) not in places[bisect_left(places, at, key=lambda p: p[1]) :]:
                        places.append((automaton.label, at, end))
        return {
            "n_words": len(words.words),
            "n_base": len(base),
            "first_word": min(base, default=None),
            "last_word": max(base, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | own)),
            "score": 1.0 if own else 0.5 if labels else 0.0,
            "places": [f"{label}:{a}-{b}" for label, a, b in places],
        }


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, labels, the template matches as label:start-end, and a score.

    The score is 1 if a template accepts a stretch of the text (its mandatory wording matches word by word), 0.5 if only
    base phrases stand there, else 0. Several templates may accept the same stretch: all their labels are returned. From one
    place a template's longest match counts. Null and empty texts have no words and no labels (empty strings, score 0); very
    long texts are scanned whole; repeated rows are each scanned; an empty table gives an empty result; extra columns are
    ignored.
    """
    scanner = Scanner(BASE, TEMPLATES if templates is None else templates)

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner.scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = scan.asNondeterministic()(as_bytes(F.col(text_col)))  # never evaluated twice
    return docs.select(F.col(id_col).alias(id_col), found.alias("__found")).select(id_col, "__found.*")


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
