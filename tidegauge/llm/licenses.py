"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

Both sides are sets of tokens: words and pairs of neighbouring words, so that order counts. Tokens are ordered by how
many documents hold them, rarest first. A block can hold enough of a template only if it has one of the template's
rarest tokens (prefix filter), has enough template tokens at all (length filter), and enough of both lists is left after
the first common token (positional filter). What passes is compared whole, so the join is exact.

Every template that a block holds to its threshold counts; none is left out afterwards. The threshold is a share of the
template's tokens, or more where a template of another label has as many of them: then one token more than that.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.texts import keyed_texts, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# The sentences by which a text is usually put under a license, and notices and bodies of licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this work is licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
     version."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
     later version."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
     liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
     any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
     publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
     purpose, commercial or non-commercial, and by any means."""),
)

_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
               for c in range(256))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters a-z and characters outside ASCII, after lowering A-Z."""
    return (text or "").encode().translate(_LOWER).translate(_TABLE).split()


Token = bytes | tuple[bytes, bytes]


def tokens_of(words: list[bytes]) -> set[Token]:
    """Words, and pairs of neighbouring words."""
    return {*words, *zip(words, words[1:])}


@dataclass(frozen=True)
class Scan:
    """Templates meet blocks of `block` words, doubled until a template is at most half a block long.

    Blocks start every half block, so a passage as long as the template lies whole in one. `threshold` is the share of
    a template's tokens that a block must hold.
    """

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    threshold: float = 0.85
    block: int = 40


class TemplateIndex:
    """Prefix index of the templates under a global token order, one for each length of blocks."""

    def __init__(self, scan: Scan, frequency: dict[Token, int]):
        self.scan = scan
        bodies = [words_of(body) for _, body in scan.templates]
        sets = [tokens_of(body) for body in bodies]
        # The order of tokens: by documents, then single words before pairs, then by their bytes.
        rarest = sorted(set().union(*sets), key=lambda t: (frequency.get(t, 0), isinstance(t, tuple), t))
        self.rank = {t: i for i, t in enumerate(rarest)}
        self.templates: list[tuple[str, list[int], int]] = []
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, ((label, _), body, tokens) in enumerate(zip(scan.templates, bodies, sets)):
            order = sorted(self.rank[t] for t in tokens)
            need = max(1, math.ceil(scan.threshold * len(order) - 1e-9))
            for (other, _), others in zip(scan.templates, sets):
                shared = len(tokens & others)
                if other != label and shared < len(tokens):
                    need = max(need, shared + 1)
            self.templates.append((label, order, need))
            if not order:
                continue
            block = scan.block
            while 2 * len(body) > block:
                block *= 2
            prefixes = self.prefixes.setdefault(block, {})
            for place, token in enumerate(order[:len(order) - need + 1]):
                prefixes.setdefault(token, []).append((number, place))
        self.triggers = {block: {t for t in rarest if self.rank[t] in prefixes} for block, prefixes in self.prefixes.items()}

    def met(self, words: list[bytes], block: int) -> Iterator[tuple[int, float]]:
        """Number, and share held, of each template for blocks of `block` words that the words hold to the threshold."""
        rank, prefixes = self.rank, self.prefixes[block]
        own = sorted({rank[t] for t in tokens_of(words) if t in rank})
        tried: set[int] = set()
        for at, token in enumerate(own):
            for number, place in prefixes.get(token, ()):
                if number in tried:
                    continue
                tried.add(number)
                _, order, need = self.templates[number]
                # Smaller tokens than this one are in one list only, or a prefix hit would have come earlier.
                if len(own) < need or 1 + min(len(order) - place - 1, len(own) - at - 1) < need:
                    continue
                held = len(set(order).intersection(own))
                if held >= need:
                    yield number, held / len(order)

    def joined(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """All (first word, words of the block, template, share held) of a text's blocks, as far as the threshold is met."""
        for block, triggers in self.triggers.items():
            half = block // 2
            starts = set()
            for i, pair in enumerate(zip(words, [*words[1:], None])):
                if pair[0] in triggers or pair in triggers:
                    starts.update((i // half * half, max(0, i // half - 1) * half))
            for start in sorted(starts):
                for number, share in self.met(words[start:start + block], block):
                    yield start, block, number, share

    def labels(self, words: list[bytes]) -> dict[str, float]:
        """Labels of all templates that a text's blocks hold, each with the largest share held."""
        found: dict[str, float] = {}
        for _, _, number, share in self.joined(words):
            label = self.templates[number][0]
            found[label] = max(found.get(label, 0.0), share)
        return found


def phrase_places(words: list[bytes], phrase: str) -> list[int]:
    """Indexes of words at which the phrase's words stand consecutively."""
    wanted = phrase.encode().split()
    joined, needle, found = b" " + b" ".join(words) + b" ", b" " + b" ".join(wanted) + b" ", []
    at, counted, count = joined.find(needle), 0, 0
    while at >= 0:
        count += joined.count(b" ", counted, at)
        counted = at
        found.append(count)
        at = joined.find(needle, at + 1)
    return found


def token_frequency(docs: DataFrame, scan: Scan) -> dict[Token, int]:
    """Documents that hold each template token, counted over all documents; one number per template token."""
    names = {t: b" ".join(t) if isinstance(t, tuple) else t for _, body in scan.templates for t in tokens_of(words_of(body))}
    single = {t for t in names if isinstance(t, bytes)}
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def make():
        def work(batch):
            counts: dict[Token, int] = {}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                for t in {w for w in words if w in single}.union(p for p in zip(words, words[1:]) if p in names):
                    counts[t] = counts.get(t, 0) + 1
            return {"token": [names[t] for t in counts], "n": list(counts.values())}

        return work

    seen = {bytes(r["token"]): r["n"] for r in
            map_batches(docs, schema, make).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return {t: seen.get(name, 0) for t, name in names.items()}


def license_scan(docs: DataFrame, scan: Scan = Scan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, phrase places, and labels by phrases and by templates.

    A null or empty text has no words, no labels, null places and the score 0. The score is 1 where a phrase
    stands, else the largest share of a template that a block holds, 0 where none reaches the threshold.
    Equal rows give equal rows.
    """
    texts = keyed_texts(docs, key, text)
    frequency = token_frequency(texts, scan)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                        ("labels", pa.string()), ("score", pa.float64())])

    def make():
        index = TemplateIndex(scan, frequency)

        def one(value):
            words = words_of(value)
            places, base = [], set()
            for phrase, label in scan.phrases:
                found = phrase_places(words, phrase)
                if found:
                    base.add(label)
                    places += found
            held = index.labels(words)
            score = 1.0 if places else max(held.values(), default=0.0)
            return (len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | set(held))), score)

        def work(batch):
            made = zip(*map(one, batch.column(1).to_pylist()))
            return dict(zip(schema.names, [batch.column(0), *map(list, made)]))

        return work

    return map_batches(texts, schema, make)
