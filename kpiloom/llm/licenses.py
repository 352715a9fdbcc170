"""License scans by template-markup matching.

A template is license wording in the markup of published license templates: words that must be
there, ``<<beginOptional>>..<<endOptional>>`` regions that may be missing, and
``<<var;..;most=N>>`` regions that stand for up to N words of any kind. It is compiled into an
automaton over word tokens and run from every place where it can start; it accepts the longest
run of words whose mandatory wording matches exactly. Case, punctuation and layout are not part
of words. A text is only walked for templates whose anchor, a rare mandatory word, it holds.

Rules for odd input: NULL, empty and wordless texts have no words and no matches; overlapping
matches of different templates all count, those of one template don't overlap (phrases of
``BASE`` count at every place); repeated rows keep their rows; an empty table gives no rows;
other columns pass through (as ``_row``). Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TAG = re.compile(r"<<(.*?)>>", re.S)
MATCHES = "array<struct<label:string,base:boolean,start:int,end:int>>"


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


#: Phrases and labels of the contract.
BASE = (
    Template("mit", "MIT License", True),
    Template("apache", "Apache License", True),
    Template("gpl", "General Public License", True),
)
# Wording of public license texts and notices.
_COPYRIGHT = "<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=holder;most=30>><<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>"
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY <<var;name=party;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD = (
    _COPYRIGHT + " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: <<var;name=bullet;most=1>> Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. <<var;name=bullet;most=1>> Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
TEMPLATES = (
    Template(
        "mit",
        "<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>>" + _COPYRIGHT + " Permission is hereby granted, free of charge, to any person obtaining a copy of "
        "<<var;name=software;most=4>> and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next "
        "paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "isc",
        _COPYRIGHT + " Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template("bsd-2-clause", _BSD + _AS_IS),
    Template(
        "bsd-3-clause",
        _BSD + "<<var;name=bullet;most=1>> Neither the name of <<var;name=holder;most=12>> nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at <<var;name=address;most=10>> Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    Template("apache-2.0", "<<beginOptional>>This work is<<endOptional>> Licensed under the Apache License, Version 2.0"),
    Template("mit", "<<beginOptional>>This work is<<endOptional>> Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    Template("mit", "Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    Template("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"),
    Template("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 2"),
    Template(
        "gpl",
        "is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> General Public "
        "License as published by the Free Software Foundation, either version <<var;name=version;most=2>> of the License, or (at your option) any later version",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.",
    ),
    Template("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<var;name=version;most=2>>"),
    Template("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-SA <<var;name=version;most=2>>"),
    Template("cc-by", "licensed under a Creative Commons Attribution <<var;name=version;most=2>> <<beginOptional>>International<<endOptional>> License"),
)


@dataclass
class Automaton:
    """States of one template: ``word[s]`` is the token that leads on from s (None: any token;
    b"": accepting), ``free[s]`` the states reached without reading."""

    label: str
    base: bool
    word: list[bytes | None] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    anchor: bytes = b""

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run from ``at``; -1 if there is none."""
        now, found, accept = self.begin, -1, len(self.word) - 1
        while now:
            if accept in now:
                found = at
            if at == len(words):
                break
            w = words[at]
            now = self.closure({s + 1 for s in now if s != accept and (self.word[s] is None or self.word[s] == w)})
            at += 1
        return found

    def __post_init__(self) -> None:
        self.begin: frozenset[int] = frozenset()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def compile_template(t: Template) -> Automaton:
    own = Automaton(t.label, t.base)
    opened: list[int] = []
    mandatory: list[bytes] = []

    def state(word: bytes | None) -> int:
        own.word.append(word)
        own.free.append(set())
        return len(own.word) - 1

    for i, piece in enumerate(_TAG.split(t.markup)):
        if i % 2 == 0:
            for w in words_of(piece.encode()):
                state(w)
                if not opened:
                    mandatory.append(w)
        elif piece == "beginOptional":
            opened.append(len(own.word))
            state(b"\x00")  # no word is equal: only its free moves lead on
            own.free[-1].add(len(own.word))
        elif piece == "endOptional":
            own.free[opened.pop()].add(len(own.word))
        elif piece.startswith("var;"):
            most = int(re.search(r"most=(\d+)", piece)[1])
            end = len(own.word) + most
            for _ in range(most):
                own.free[state(None)].add(end)
        else:
            raise ValueError(f"unknown tag <<{piece}>> in the template {t.label}")
    if opened or not mandatory:
        raise ValueError(f"an open region or no mandatory word in the template {t.label}")
    state(b"\x00")  # accepting
    own.anchor = max(mandatory, key=len)
    own.begin = own.closure({0})
    return own


def find(text: bytes | None, automata: list[Automaton]) -> tuple[int, list[tuple[str, bool, int, int]]]:
    """(number of words, matches as (label, base, start, end) in words)."""
    low = text.lower() if text else b""
    words = _WORD.findall(low)
    starts: dict[bytes, list[int]] = {}
    for i, a in enumerate(automata):
        if a.anchor in low:
            for s in a.begin:
                starts.setdefault(a.word[s], []).append(i)
    out = []
    if starts:
        upto = [0] * len(automata)
        for at, w in enumerate(words):
            for i in dict.fromkeys(starts.get(w, ())):
                a = automata[i]
                if at >= upto[i] and (end := a.longest(words, at)) > at:
                    out.append((a.label, a.base, at, end))
                    if not a.base:
                        upto[i] = end
    return len(words), out


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, text: str = "text") -> DataFrame:
    """(_row, n_words, matches) for every row of ``docs``."""
    automata = [compile_template(t) for t in templates]

    @F.pandas_udf(f"struct<n_words:long,matches:{MATCHES}>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [find(t, automata) for t in texts]
            yield pd.DataFrame({
                "n_words": [n for n, _ in found],
                "matches": [[{"label": a, "base": b, "start": s, "end": e} for a, b, s, e in m] for _, m in found],
            })

    return docs.select(F.struct("*").alias("_row"), of(F.col(text).cast("binary")).alias("_f")).select("_row", "_f.n_words", "_f.matches")
