"""License scans by template-markup matching.

A template is the wording of a notice with markup: ``[ ... ]`` encloses an optional region (it may be nested)
and ``{n}`` stands for up to n replaceable words such as names, years or versions. Templates compile to token
automata; a document is accepted where a run of its words spells all mandatory wording, exactly and in order.
Phrases are searched beside it: each place where a phrase's words stand consecutively.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z.

Templates have three levels. A notice is the whole wording of a license text or header, with conditions and disclaimers; a
statement names a license; an opening is the first sentence of a notice. An opening gives the label of its family of licenses,
unless a whole notice of that family is there, which tells them apart (0BSD from ISC, BSD with 2, 3 and 4 clauses).

The score is 1 where a notice or statement is accepted, 0.75 where only an opening is (what follows it may differ from the
license), 0.5 where only a phrase is found, else 0.

Edge cases: null and empty texts have no words, labels "" and score 0; texts of any length are scanned whole; equal places of two phrases count once
for each phrase; repeated rows are scanned alike, one row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import rolling
from lexsieve.plans.scale import spread

# Phrases, and the wording of public notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
          "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
          "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
          "with the software or the use or other dealings in the software")
_MIT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so")
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
            "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
            "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
            "tortious action arising out of or in connection with the use or performance of this software")
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met [{1}] redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer [{1}] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution")
_BSD_ADVERTS = ("[{1}] all advertising materials mentioning features or use of this software must display the following acknowledgement this "
                "product includes software developed by {16}")
_BSD_NAMES = ("[{1}] neither the name of {12} nor the names of {4} contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission")
_BSD_END = ("this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties "
            "of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect "
            "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss "
            "of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
            "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of "
            "such damage")


def _gnu(name: str) -> str:
    return (f"{{6}} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free "
            "software foundation either version {1} of the license or at your option any later version {6} is distributed in the hope that it "
            "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
            f"see the gnu {name} for more details")


#: Whole notices: family, and all mandatory wording with its conditions and disclaimers.
NOTICES = {
    "mit": ("mit", f"{_MIT} subject to the following conditions the above copyright notice and this permission notice [including the next "
                   f"paragraph] shall be included in all copies or substantial portions of the software {_AS_IS}"),
    "mit-0": ("mit", f"{_MIT} {_AS_IS}"),
    "isc": ("isc", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    "0bsd": ("isc", f"{_ISC} {_ISC_END}"),
    "bsd-2-clause": ("bsd", f"{_BSD} {_BSD_END}"),
    "bsd-3-clause": ("bsd", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    "bsd-4-clause": ("bsd", f"{_BSD} {_BSD_ADVERTS} {_BSD_NAMES} {_BSD_END}"),
    "apache-2.0": ("apache", "licensed under the apache license version 2 0 the license you may not use this {4} except in compliance with the "
                   "license you may obtain a copy of the license at {2} apache org licenses license 2 0 unless required by applicable law or agreed "
                   "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
                   "any kind either express or implied see the license for the specific language governing permissions and limitations under "
                   "the license"),
    "gpl-notice": ("gpl", _gnu("general public license")),
    "lgpl-notice": ("gpl", _gnu("lesser general public license")),
    "agpl-notice": ("gpl", _gnu("affero general public license")),
    "mpl-2.0": ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
                "distributed with this file you can obtain one at {2} mozilla org mpl 2 0"),
}
#: Statements that name a license: nothing else belongs to them.
STATEMENTS = {
    "mit": ["released under the mit license", "licensed under the [terms of the] mit license"],
    "apache": ["licensed under the apache license version 2 0"],
    "gpl": ["licensed under the gnu [lesser] [affero] general public license [version {2}]"],
    "cc-by-nc": ["licensed under [the] [a] [creative commons] cc by nc [{2}]",
                 "licensed under [the] [a] creative commons attribution noncommercial {2} [international] license"],
    "cc-by": ["licensed under [the] [a] creative commons attribution {2} [international] license"],
    "bsd": ["licensed under the bsd [{2} clause] license"],
}
#: Openings of notices, by family: what follows may be cut off or altered.
OPENINGS = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this {8} to deal in the software "
            "without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the software"],
    "apache": ["licensed under the apache license version 2 0 the license you may not use this {4} except in compliance with the license"],
    "gpl": ["this {4} is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"],
    "isc": [_ISC],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
#: Every template with its label and level, strongest level first.
TEMPLATES = {label: [t for group in (STATEMENTS, OPENINGS) for t in group.get(label, [])] for label in (*STATEMENTS, *OPENINGS)}
NOTICE, STATEMENT, OPENING = range(3)

_ANY = None


@dataclass
class Automaton:
    """States 0..n; state i reads words[i] (None: any word) and moves to i + 1; skips[i] are free moves."""

    words: list[str | None]
    skips: dict[int, list[int]]

    def closed(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for to in self.skips.get(todo.pop(), ()):
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return found

    @property
    def first_words(self) -> set[str | None]:
        return {self.words[s] for s in self.closed({0}) if s < len(self.words)}

    def match(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted run from `at`, or None."""
        states, end = self.closed({0}), None
        for i in range(at, len(words) + 1):
            if len(self.words) in states:
                end = i
            if i == len(words):
                break
            states = self.closed({s + 1 for s in states if s < len(self.words) and self.words[s] in (_ANY, words[i])})
            if not states:
                break
        return end


def compiled(template: str) -> Automaton:
    """The automaton of a template's markup."""
    words: list[str | None] = []
    skips: dict[int, list[int]] = {}
    opened: list[int] = []
    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        if token == "[":
            opened.append(len(words))
        elif token == "]":
            skips.setdefault(opened.pop(), []).append(len(words))
        elif token.startswith("{"):
            n = int(token[1:-1])
            for k in range(n):
                skips.setdefault(len(words) + k, []).append(len(words) + n)
            words += [_ANY] * n
        else:
            words.append(token)
    if opened:
        raise ValueError(f"unclosed region in {template!r}")
    return Automaton(words, skips)


def anchor(template: str) -> tuple[str, str]:
    """Two neighbouring mandatory words, the longest of the template: only documents that hold them are matched."""
    depth, before, best = 0, None, ("", "")
    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        depth += (token == "[") - (token == "]")
        plain = token if depth == 0 and token[0] not in "[]{" else None
        if plain and before and len(plain) + len(before) > len("".join(best)):
            best = before, plain
        before = plain
    if not best[0]:
        raise ValueError(f"no two neighbouring mandatory words in {template!r}")
    return best


def template_pattern(template: str) -> str:
    """The same language as a regular expression over words that each end with a space (for the oracle)."""
    out = []
    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        out.append({"[": "(", "]": ")?"}.get(token) or (f"([^ ]+ ){{0,{token[1:-1]}}}" if token.startswith("{") else f"{token} "))
    return "".join(out)


def _hash_set(words: set[str]) -> np.ndarray:
    ordered = sorted(words)
    data = np.frombuffer("".join(ordered).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in ordered])
    return rolling.byte_hashes(data, np.concatenate(([0], ends[:-1])), ends)


class Scanner:
    """All phrases and automata, entered by the hash of a word."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[int, str, str]]) -> None:
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.phrase_hashes = [_hashes(words) for words, _ in self.phrases]
        self.automata = [(compiled(t), (level, label)) for level, label, t in templates]
        # a template that starts with replaceable words can start anywhere
        self.entries = [None if None in a.first_words else _hash_set(a.first_words) for a, _ in self.automata]
        self.anchors = [_hashes(list(anchor(t))) for _, _, t in templates]

    def places(self, words: rolling.Words) -> list[tuple[int, str]]:
        """(index of the first word, label) of each place of a phrase, verified on the text."""
        found = []
        for (parts, label), codes in zip(self.phrases, self.phrase_hashes, strict=True):
            n = len(words.hashes) - len(parts) + 1
            if n <= 0:
                continue
            hit = words.doc[:n] == words.doc[len(parts) - 1:]
            for k, code in enumerate(codes):
                hit &= words.hashes[k:k + n] == code
            found += [(int(i), label) for i in np.flatnonzero(hit)
                      if all(words.text(i + k) == part.encode() for k, part in enumerate(parts))]
        return found

    def accepted(self, words: rolling.Words) -> list[tuple[int, tuple[int, str]]]:
        """(document, (level, label)) of each accepted template."""
        found, first = [], words.first
        for (automaton, label), entries, (one, two) in zip(self.automata, self.entries, self.anchors, strict=True):
            held = np.flatnonzero((words.hashes[:-1] == one) & (words.hashes[1:] == two))
            if not len(held):
                continue
            if entries is None:  # near the anchor only
                start = np.zeros(len(words.hashes), bool)
                for h in held:
                    start[max(int(first[words.doc[h]]), int(h) - len(automaton.words)):h + 1] = True
            else:
                start = np.isin(words.hashes, entries) & np.isin(words.doc, words.doc[held])
            for i in np.flatnonzero(start):
                doc = int(words.doc[i])
                if (doc, label) in found[-1:]:
                    continue
                stop = min(int(first[doc + 1]), int(i) + len(automaton.words))
                run = [words.text(k).decode() for k in range(int(i), stop)]
                if automaton.match(run, 0) is not None:
                    found.append((doc, label))
        return found


def _hashes(words: list[str]) -> list[np.uint64]:
    return [_hash_set({w})[0] for w in words]


def labels_of(matched: set[tuple[int, str]]) -> set[str]:
    """Labels of the accepted templates; an opening says nothing beside a whole notice of its family."""
    whole = {NOTICES[label][0] for level, label in matched if level == NOTICE}
    return {label for level, label in matched if level != OPENING or label not in whole}


def _all_templates() -> list[tuple[int, str, str]]:
    return [*((NOTICE, label, t) for label, (_, t) in NOTICES.items()), *((STATEMENT, label, t) for label, group in STATEMENTS.items() for t in group),
            *((OPENING, label, t) for label, group in OPENINGS.items() for t in group)]


def scan_licenses(documents: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
                  templates: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, _all_templates() if templates is None else templates)
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words, n = rolling.cut_words(rolling.LOWER[data], offsets, rolling.LOWER_ALNUM), part.num_rows
                first = words.first
                base: list[set[str]] = [set() for _ in range(n)]
                matched: list[set[tuple[int, str]]] = [set() for _ in range(n)]
                starts: list[list[int]] = [[] for _ in range(n)]
                for i, label in scanner.places(words):
                    doc = int(words.doc[i])
                    base[doc].add(label)
                    starts[doc].append(i - int(first[doc]))
                for doc, label in scanner.accepted(words):
                    matched[doc].add(label)
                told = [labels_of(m) for m in matched]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(first)), pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()), pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b | m)) for b, m in zip(base, told, strict=True)]),
                    pa.array([1.0 if m and min(m)[0] < OPENING else 0.75 if m else 0.5 if b else 0.0 for b, m in zip(base, matched, strict=True)])],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(texts, "doc_id").mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
