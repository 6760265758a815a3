"""License scans by template-markup matching.

A template is wording with markup::

    words                      mandatory, must match exactly
    <<optional>> ... <</optional>>   may be left out as a whole (may be nested)
    <<any;N>>                  replaceable: up to N words of any kind
    <<one;a b|c>>              one of the given wordings

Templates compile into one automaton over words, made deterministic as it is
used, and a scan reads it from every word that can begin a template; the longest
match of each label counts.  Mandatory wording has no tolerance.

Bounds: a contributor's or holder's name of up to 12 words and an address of up to 9
(those of the BSD text and of the Apache and MPL headers), and expressions of up to
five SPDX identifiers.  Titles of whole texts count wherever they stand, a sentence
that only mentions one included.

Defined results: a null or empty text has no words; a text of any length is
scanned whole; overlapping matches of a label count from their first words;
repeated rows are rows of their own; an empty table gives no rows; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from famloom.llm.common import arrow_batches

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = "<<one;licensed|released|distributed|available|provided|published>> under <<optional>> the terms of <</optional>> <<optional>> the <</optional>> <<optional>> a <</optional>>"
_CC = "<<one;cc|creative commons>> <<optional>> license <</optional>>"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_HELD = "<<one;authors or copyright holders|author or copyright holders|copyright holders|copyright holders and contributors|copyright holder|copyright owner>>"
#: The header of the GNU licenses: name, labels by version.
_FREE = "free software you can redistribute it and or modify it under the terms of"
_ANY_LATER = "<<optional>> or at your option any later version <</optional>>"


def _gnu(name: str, version: str) -> str:
    """The header that a program's files carry, from the words behind the program's name, which is any."""
    return f"{_FREE} the gnu {name} as published by the free software foundation <<optional>> either <</optional>> version {version} of the license {_ANY_LATER}"


#: SPDX identifiers as words, by label (fixed values); those without a label here stand in expressions all the same.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit 0", "apache-2.0": "apache 2 0", "gpl-2.0": "gpl 2 0|gpl 2 0 only|gpl 2 0 or later", "gpl-3.0": "gpl 3 0|gpl 3 0 only|gpl 3 0 or later",
    "lgpl": "lgpl 2 1 only|lgpl 2 1 or later|lgpl 3 0 only|lgpl 3 0 or later|lgpl 2 0 only|lgpl 2 0 or later|lgpl 2 1|lgpl 3 0", "agpl-3.0": "agpl 3 0 only|agpl 3 0 or later|agpl 3 0",
    "mpl-2.0": "mpl 2 0", "epl-2.0": "epl 2 0", "bsd": "bsd 2 clause|bsd 3 clause", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "cc0": "cc0 1 0", "cc-by-4.0": "cc by 4 0", "cc-by-sa": "cc by sa 4 0",
    "cc-by-nc": "cc by nc 4 0|cc by nc sa 4 0|cc by nc nd 4 0", "boost": "bsl 1 0", "0bsd": "0bsd", "artistic-2.0": "artistic 2 0", "eupl": "eupl 1 1|eupl 1 2", "ms-pl": "ms pl", "wtfpl": "wtfpl", "odbl": "odbl 1 0", "psf": "psf 2 0|python 2 0",
}
#: Exceptions that stand behind ``with`` (fixed values).
EXCEPTIONS = "classpath exception 2 0|llvm exception|gcc exception 3 1|gcc exception 2 0|linux syscall note|autoconf exception 3 0|bison exception 2 2|font exception 2 0"
#: Identifiers before the one that a label is given for.
_BEFORE = 4


def _spdx(label: str) -> str:
    """A line whose expression has one of the label's identifiers, alone or behind up to _BEFORE others joined by ``and`` or ``or``; brackets are no words."""
    other = f"<<optional>> <<one;{'|'.join(IDENTIFIERS.values())}>> <<optional>> with <<one;{EXCEPTIONS}>> <</optional>> <<one;and|or>> <</optional>> "
    return f"spdx license identifier {other * _BEFORE}<<one;{IDENTIFIERS[label]}>>"


#: License notices and texts as publicly known (fixed values): (label, markup).
#: A label has a template for each wording that is in use: notices, SPDX lines, titles, headers, whole texts.
TEMPLATES = (
    # Notices
    ("mit", f"{_GRANT} mit license"),
    ("apache-2.0", f"{_GRANT} apache license <<optional>> version <</optional>> 2 0"),
    ("gpl-2.0", f"{_GRANT} gnu general public license <<optional>> as published by the free software foundation <<optional>> either <</optional>> <</optional>> <<one;version 2|v2>>"),
    ("gpl-3.0", f"{_GRANT} gnu general public license <<optional>> as published by the free software foundation <<optional>> either <</optional>> <</optional>> <<one;version 3|v3>>"),
    ("lgpl", f"{_GRANT} gnu <<one;lesser|library>> general public license"),
    ("agpl-3.0", f"{_GRANT} gnu affero general public license <<one;version 3|v3>>"),
    ("mpl-2.0", f"{_GRANT} mozilla public license <<optional>> <<one;version|v>> <</optional>> <<one;2 0|v2 0>>"),
    ("epl-2.0", f"{_GRANT} eclipse public license <<optional>> <<one;version|v>> <</optional>> <<one;2 0|v2 0>>"),
    ("bsd", f"{_GRANT} <<optional>> <<one;2 clause|3 clause|new|simplified|modified>> <</optional>> bsd <<optional>> <<one;style|2 clause|3 clause>> <</optional>> license"),
    ("cc-by-nc", f"{_GRANT} {_CC} <<one;by nc|attribution noncommercial|attribution non commercial>> <<optional>> <<any;1>> <<any;1>> <<optional>> international <</optional>> <<optional>> license <</optional>> <</optional>>"),
    ("cc-by-sa", f"{_GRANT} {_CC} <<one;by sa|attribution sharealike|attribution share alike>>"),
    ("cc-by-nd", f"{_GRANT} {_CC} <<one;by nd|attribution noderivatives|attribution noderivs|attribution no derivatives>>"),
    ("cc-by-4.0", f"{_GRANT} {_CC} <<one;by|attribution>> <<one;4 0|3 0>>"),
    ("cc0", f"{_GRANT} <<one;cc0|creative commons zero>> <<optional>> 1 0 <</optional>>"),
    # SPDX lines
    *((label, _spdx(label)) for label in IDENTIFIERS),
    # Titles of whole texts
    ("mit", "the mit license mit"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("lgpl", "gnu <<one;lesser|library>> general public license version <<one;2 1 february 1999|3 29 june 2007|2 june 1991>>"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("epl-2.0", "eclipse public license <<one;v 2 0|v2 0|version 2 0>>"),
    ("cc0", "creative commons legal code cc0 1 0 universal"),
    ("cc0", "cc0 1 0 universal <<optional>> cc0 1 0 <</optional>> public domain dedication"),
    ("cc-by-4.0", "<<one;creative commons attribution|attribution>> 4 0 international <<one;public license|cc by 4 0>>"),
    ("cc-by-sa", "<<one;creative commons attribution|attribution>> <<one;sharealike|share alike>> 4 0 international <<one;public license|cc by sa 4 0>>"),
    ("cc-by-nc", "<<one;creative commons attribution|attribution>> <<one;noncommercial|non commercial>> 4 0 international <<one;public license|cc by nc 4 0>>"),
    # Headers
    ("gpl-2.0", _gnu("general public license", "2")),
    ("gpl-3.0", _gnu("general public license", "3")),
    ("lgpl", _gnu("<<one;lesser|library>> general public license", "<<one;2|2 1|3>>")),
    ("agpl-3.0", _gnu("affero general public license", "3")),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any;9>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<any;9>>"),
    (
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license <<one;2 0|v 2 0|v2 0>> which <<one;is available at|accompanies this distribution>>",
    ),
    # Whole texts
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        f"subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <</optional>> shall be included in all copies or substantial portions of the software <<optional>> {_AS_IS} "
        f"<<optional>> in no event shall the {_HELD} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software <</optional>> <</optional>>",
    ),
    (
        "isc",
        "permission to use copy modify and <<optional>> or <</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "<<optional>> the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness <</optional>>",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any;2>> "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any;2>> "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<optional>> <<any;2>> neither the name of <<any;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <</optional>> "
        "<<optional>> this software is provided by <<any;12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed <</optional>>",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any;2>> "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any;2>> "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any;2>> "
        "this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(/?\w+)(?:;([^<>]*))?>>|([^<>\s]+)")
#: Steps of the deterministic automaton that are remembered.
_STEPS = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, A-Z lower-cased and anything outside ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Templates as one nondeterministic automaton over words; ``step`` goes from one set of states to the next."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.words: list[dict[bytes, set[int]]] = []
        self.any: list[set[int]] = []
        self.empty: list[set[int]] = []
        self.accepts: dict[int, str] = {}
        start = self._state()
        for label, markup in templates:
            begin = self._state()
            self.empty[start].add(begin)
            self.accepts[self._compile(markup, begin)] = label
        self.start = self._closed({start})
        self.first = {w for s in self.start for w in self.words[s]}
        if any(self.any[s] for s in self.start) or self.labels(self.start):
            raise ValueError("a template must begin with mandatory wording")
        self.alphabet = {w for x in self.words for w in x}
        self._known: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}

    def _state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.empty.append(set())
        return len(self.words) - 1

    def _compile(self, markup: str, at: int) -> int:
        opened: list[int] = []
        for mark, args, word in _MARK.findall(markup):
            if word:
                at = self._literal(word, at)
            elif mark == "optional":
                opened.append(at)
            elif mark == "/optional":
                after = self._state()
                self.empty[at].add(after)
                self.empty[opened.pop()].add(after)
                at = after
            elif mark == "any":
                after = self._state()
                self.empty[at].add(after)
                for _ in range(int(args)):
                    into = self._state()
                    self.any[at].add(into)
                    self.empty[into].add(after)
                    at = into
                at = after
            elif mark == "one":
                after = self._state()
                for way in args.split("|"):
                    end = at
                    for w in way.split():
                        end = self._literal(w, end)
                    self.empty[end].add(after)
                at = after
            else:
                raise ValueError(f"unknown markup {mark}")
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _literal(self, word: str, at: int) -> int:
        into = self._state()
        self.words[at].setdefault(word.encode(), set()).add(into)
        return into

    def _closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.alphabet else None)
        got = self._known.get(key)
        if got is None:
            if len(self._known) > _STEPS:
                self._known.clear()
            got = self._known[key] = self._closed({t for s in states for t in (*self.words[s].get(word, ()), *self.any[s])})
        return got

    def labels(self, states: frozenset[int]) -> set[str]:
        return {self.accepts[s] for s in states if s in self.accepts}

    def matches(self, words: list[bytes], at: int) -> dict[str, int]:
        """label -> end of its longest match that begins at word ``at``."""
        out: dict[str, int] = {}
        states = self.start
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            for label in self.labels(states):
                out[label] = i + 1
        return out


@lru_cache(maxsize=8)
def automaton(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
    return Automaton(templates)


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a whole text; score: share of words inside matches."""
    words, auto = words_of(text), automaton(templates)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
    first = auto.first | {p[0] for p, _ in phrases}
    base, spans = [], []
    for i in [i for i, w in enumerate(words) if w in first]:
        for p, label in phrases:
            if tuple(words[i : i + len(p)]) == p:
                base.append((i, i + len(p), label))
        if words[i] in auto.first:
            found = auto.matches(words, i)
            # ``mit`` in ``mit 0`` is no identifier.
            if found.get("mit-0") == found.get("mit", -1) + 1 and not any(words[k] == b"mit" and words[k + 1] != b"0" for k in range(i, found["mit"])):
                del found["mit"]
            spans += [(i, end, label) for label, end in found.items()]
    covered = reach = 0
    for i, end, _ in sorted(base + spans):
        covered, reach = covered + max(0, end - max(i, reach)), max(reach, end)
    labels = {x[2] for x in base}
    joined = lambda x: ",".join(sorted(x))
    return (
        len(words), len(base), base[0][0] if base else None, max(x[0] for x in base) if base else None,
        joined(labels), joined(labels | {x[2] for x in spans}), covered / len(words) if words else 0.0, sorted(spans),
    )


_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))


def scans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id with what ``scan`` finds; ``spans`` holds the template matches (first word, end, label)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*[scan(x.as_py(), templates) for x in b.column("text")], strict=True)) or [()] * len(_NAMES)
            got[-1] = [[dict(zip(("first", "end", "label"), s, strict=True)) for s in x] for x in got[-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(got, _TYPES, strict=True))], ["doc_id", *_NAMES])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string>>")
