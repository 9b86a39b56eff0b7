"""License scans by template-markup matching.

Templates are license wordings with `[[ ... ]]` around optional regions and `{{min-max}}` for regions
that may be replaced by that many words. Each compiles into one token automaton (states are places
in the wording; an optional region adds an empty move past it, a replaceable region a run of
any-word moves). A text matches where mandatory wording stands exactly, in order, with only optional
words left out and only replaceable ones changed. Automata start at the places of their first word
pair, found by a search of the text, so texts without one cost a tokenisation.

Templates are whole license texts (those of the GNU, Mozilla and CC0 licenses in the folder licenses, as
words; of the Apache license its notice, with which its text ends, and its title) and notices that refer to them. Labels are those of
matched templates and of three fixed phrases (see PHRASES); score is the highest confidence among
them: whole texts 1.0, notices and the granting part of a text 0.9, names with a version 0.8, phrases 0.6, no label 0.

Defined cases: null and empty texts have no words, labels "" and score 0; null ids and repeated rows
are kept row by row; whole texts are scanned, whatever their length; an empty table gives an empty
result; other input columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import ship

#: A-Z to a-z; [\x00-\x2F\x3A-\x60\x7B-\x7F] to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_AS_IS = "is provided {{0-8}} as is {{0-1}} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software [[and to permit persons to whom the software is furnished to do so]] subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = _BSD_2 + " [[3]] neither the name of {{1-12}} nor the names of {{1-3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
_GNU = [(name, kind, v) for name, kind, versions in (("gpl", "general", "1 2 3"), ("lgpl", "lesser general", "2.1 3"), ("lgpl", "library general", "2"), ("agpl", "affero general", "3")) for v in versions.split()]
#: (label, confidence, wording)
TEMPLATES: list[tuple[str, float, str]] = [
    ("mit", 0.9, "[[this {{1-4}} is]] {{0-1}} under the mit license"),
    ("mit", 0.9, "[[spdx]] license identifier mit"),
    ("mit", 0.9, _MIT),
    ("mit", 1.0, _MIT + " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and [[noninfringement]] [[non infringement]] in no event shall {{1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", 0.9, _ISC),
    ("isc", 1.0, _ISC + " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2", 0.9, "licensed under [[the]] apache license [[version]] 2 [[0]]"),
    ("apache-2", 0.9, "[[spdx]] license identifier apache 2 0"),
    ("apache-2", 0.9, _APACHE),
    ("apache-2", 1.0, _APACHE + " {{3-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-2-clause", 0.9, "[[spdx]] license identifier bsd 2 clause"),
    ("bsd-3-clause", 0.9, "[[spdx]] license identifier bsd 3 clause"),
    ("bsd-2-clause", 0.9, _BSD_2 + " this software is provided by"),
    ("bsd-2-clause", 1.0, _BSD_2 + " this software " + _AS_IS),
    ("bsd-3-clause", 0.9, _BSD_3),
    ("bsd-3-clause", 1.0, _BSD_3 + " this software " + _AS_IS),
    *[(f"{name}-{v}", 0.9, f"under [[the]] [[terms of the]] [[the]] gnu {kind} public license [[as published by the free software foundation]] [[either]] version {v.replace('.', ' ')}") for name, kind, v in _GNU],
    *[(f"{name}-{v}", 0.8, f"gnu {kind} public license [[as published by the free software foundation]] [[either]] version {v.replace('.', ' ')}") for name, kind, v in _GNU],
    *[(f"{name}-{v}", 0.8, f"gnu {kind} public license {w}") for name, kind, v in _GNU for w in (f"v{v.replace('.', ' ')}", f"v {v.replace('.', ' ')}")],
    *[(f"{name}-{v}", 0.9, f"[[spdx]] license identifier {name} {v.replace('.', ' ')} {'' if '.' in v else '[[0]]'}") for name, _, v in _GNU],
    ("gpl-2", 0.9, "under [[the]] [[terms of the]] gplv2"),
    ("gpl-3", 0.9, "under [[the]] [[terms of the]] gplv3"),
    ("mpl-2", 0.9, "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", 0.9, "licensed under [[a]] [[creative commons]] cc by nc [[4 0]]"),
    ("cc-by-nc", 0.9, "licensed under [[a]] creative commons attribution noncommercial {{1-2}} [[international]] license"),
    ("cc-by-sa", 0.9, "licensed under [[a]] [[creative commons]] cc by sa [[4 0]]"),
    ("cc-by", 0.9, "licensed under [[a]] creative commons attribution {{1-2}} [[international]] license"),
    ("unlicense", 0.9, "this is free and unencumbered software released into the public domain"),
    *[(f.stem, 1.0, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))],
]
SEED_WORDS = 2


class TokenAutomaton:
    """Accepts the word sequences of one template; states are sets of places in its wording."""

    def __init__(self, wording: str):
        self.steps: list[tuple[str | None, list[int]]] = []  # (word, or None for any; places reached)
        self.free: dict[int, set[int]] = {}  # empty moves
        open_at: list[int] = []
        place = 0
        for x in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", wording):
            if x == "[[":
                open_at.append(place)
            elif x == "]]":
                self.free.setdefault(open_at.pop(), set()).add(place)
            elif x[0] == "{":
                low, high = map(int, x[2:-2].split("-"))
                for k in range(high):
                    if k >= low:
                        self.free.setdefault(place, set()).add(place + high - k)
                    self.steps.append((None, [place + 1]))
                    place += 1
            else:
                self.steps.append((x, [place + 1]))
                place += 1
        if open_at:
            raise ValueError(f"an optional region isn't closed: {wording}")
        self.end = place
        self.seed_place, self.seed = self._seed()
        self.seeds = frozenset({self.seed[0]})

    def _seed(self) -> tuple[int, tuple[str, ...]]:
        """The first place with SEED_WORDS mandatory words in a row, or the longest mandatory word: every match passes it."""
        skipped = {p for a, to in self.free.items() for b in to for p in range(a, b)}
        for p in range(len(self.steps) - SEED_WORDS + 1):
            if all(k not in skipped and self.steps[k][0] for k in range(p, p + SEED_WORDS)):
                return p, tuple(self.steps[k][0] for k in range(p, p + SEED_WORDS))
        one = max((p for p, (w, _) in enumerate(self.steps) if w and p not in skipped), key=lambda p: len(self.steps[p][0]), default=None)
        if one is None:
            raise ValueError("a template needs a mandatory word")
        return one, (self.steps[one][0],)

    def closure(self, places: set[int]) -> set[int]:
        todo, out = list(places), set(places)
        while todo:
            for b in self.free.get(todo.pop(), ()):
                if b not in out:
                    out.add(b), todo.append(b)
        return out

    def match(self, words: list[str], at: int) -> int | None:
        """End (exclusive) of the longest match whose seed stands at the word `at`, reading on from the
        seed; what stands before the seed is optional or replaceable and isn't needed, or mandatory
        words that are checked backwards."""
        if self.seed_place and not self._before(words, at):
            return None
        now, k, best = self.closure({self.seed_place}), at, None
        while now:
            if self.end in now:
                best = k
            if k >= len(words):
                break
            w = words[k]
            now = self.closure({to for p in now if p < self.end and self.steps[p][0] in (None, w) for to in self.steps[p][1]})
            k += 1
        return best

    def _before(self, words: list[str], at: int) -> bool:
        """Whether the places before the seed can be read off the words that end at it."""
        back: dict[int, set[int]] = {}
        for a, to in self.free.items():
            for b in to:
                back.setdefault(b, set()).add(a)

        def close(s: set[int]) -> set[int]:
            todo, out = list(s), set(s)
            while todo:
                for a in back.get(todo.pop(), ()):
                    if a not in out:
                        out.add(a), todo.append(a)
            return out

        now, k = close({self.seed_place}), at
        while now:
            if 0 in now:
                return True
            k -= 1
            if k < 0:
                return False
            now = close({p - 1 for p in now if p and self.steps[p - 1][0] in (None, words[k])})
        return False


_COMPILED: dict[tuple, list] = {}


def _compiled(templates: tuple) -> list[tuple[bytes, list[tuple[str, float, TokenAutomaton]]]]:
    """Automata by the words of their seed."""
    if templates not in _COMPILED:
        by: dict[bytes, list] = {}
        for label, confidence, wording in templates:
            a = TokenAutomaton(wording)
            by.setdefault((" " + " ".join(a.seed) + " ").encode(), []).append((label, confidence, a))
        _COMPILED[templates] = list(by.items())
    return _COMPILED[templates]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase (with a space on either side) stands in space-joined words."""
    out, i, word, last = [], joined.find(phrase), 0, 0
    while i >= 0:
        word += joined.count(b" ", last, i)
        out.append(word)
        last = i
        i = joined.find(phrase, i + 1)
    return out


def scan_text(text: bytes, compiled: list, phrases: list[tuple[bytes, str]]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    words = text.translate(TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" " + b" ".join(words) + b" "
    starts, base, all_labels, score, spans = [], set(), set(), 0.0, []
    for phrase, label in phrases:
        if phrase in joined:
            starts += places(joined, phrase)
            base.add(label), all_labels.add(label)
            score = max(score, 0.6)
    decoded: list[str] | None = None
    for seed, automata in compiled:
        if seed in joined:
            decoded = decoded or [w.decode("utf-8", "replace") for w in words]
            for at in places(joined, seed):
                for label, confidence, a in automata:
                    end = a.match(decoded, at)
                    if end is not None:
                        all_labels.add(label), spans.append((label, at, end))
                        score = max(score, confidence)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(all_labels)), score, spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, first word from the seed on, end) of the matched templates."""
    ship(docs.sparkSession)
    wordings = tuple(map(tuple, TEMPLATES if templates is None else templates))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(wordings)
        phrases = [((" " + p + " ").encode(), label) for p, label in PHRASES.items()]
        for b in batches:
            rows = [scan_text(t.as_py() or b"", compiled, phrases) for t in b.column(1).cast(pa.binary())]
            cols = list(zip(*rows)) or [()] * 8
            spans = pa.array([[dict(zip(("label", "first", "end"), s)) for s in x] for x in cols[7]], span)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)], spans], [id_col, *names, "spans"])

    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,end:bigint>>"
    return docs.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, schema)
