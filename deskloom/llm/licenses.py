"""License scan: an exact set-similarity join of text blocks against license templates.

A block is a line, cut into overlapping pieces where it is longer than ``BLOCK`` words, or, since
notices are wrapped, a stretch of the whole word sequence: the template's own number of words over
the share, wherever it starts. Stretches that hold no more of a template than a line block they
overlap are not listed, and of stretches that overlap each other only the best is.

Tokens are ordered by their frequency in the whole corpus, rarest first. A template of t tokens
needs ``o = ceil(share * t)`` of them in a block, so one of its first t - o + 1 must be there
(prefix filter); blocks with fewer than o template tokens go (length filter); and from the first
common token on, both sides must have enough tokens left (positional filter). What remains is
counted exactly. All pairs at or above the share are found.

The first pass counts the templates' tokens over all texts, the second joins; only the template
index is broadcast, and templates above ``MOST_TEMPLATE_BYTES`` are refused.

Besides, the places of fixed phrases are listed. Null and wordless texts have none. Rows are
judged one by one, so repeated rows get equal results. Without templates only phrases count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import alnum_words, lists, map_texts

#: Words of a block and between the starts of two pieces of a longer line; least containment, which
#: tells apart names that differ in one token of up to nine.
BLOCK, STEP, SHARE = 128, 64, 0.9
MOST_TEMPLATE_BYTES = 16 << 20

# They decide results.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("reserved", "All rights reserved."),
)


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[int, ...]  # ranks, rarest first
    needed: int
    stretch: int  # words of a stretch


@dataclass(frozen=True)
class Index:
    ranks: dict[bytes, int]
    templates: list[Template]
    prefixes: dict[int, list[tuple[int, int]]]  # rank: (template, position)


def _vocabulary(templates: Sequence[tuple[str, str]]) -> list[frozenset[bytes]]:
    if sum(len(t) for _, t in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates exceed {MOST_TEMPLATE_BYTES} characters and can't be broadcast")
    return [frozenset(alnum_words(text.encode())) for _, text in templates]


def frequencies(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """Occurrences of the templates' tokens in all texts: at most one row per token reaches the driver."""
    known = frozenset().union(*_vocabulary(templates)) if templates else frozenset()
    one = docs.select(F.lit(1).alias("x"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            count = Counter()
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                if t:
                    count.update([w for w in alnum_words(t) if w in known])
            columns = [pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "n"])

    counted = one.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"].encode(): r["n"] for r in counted.collect()}
    return {w: found.get(w, 0) for w in known}


def build_index(templates: Sequence[tuple[str, str]], frequency: Mapping[bytes, int], share: float = SHARE) -> Index:
    ranks = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    built, prefixes = [], {}
    for (label, text), tokens in zip(templates, _vocabulary(templates)):
        if not tokens:
            continue
        ordered = tuple(sorted(ranks[w] for w in tokens))
        needed = math.ceil(share * len(ordered) - 1e-9)
        for position in range(len(ordered) - needed + 1):
            prefixes.setdefault(ordered[position], []).append((len(built), position))
        stretch = math.ceil(len(alnum_words(text.encode())) / share - 1e-9) if share > 0 else BLOCK
        built.append(Template(label, ordered, needed, stretch))
    return Index(ranks, built, prefixes)


def block_matches(index: Index, words: Sequence[bytes]) -> list[tuple[int, float]]:
    """(template, containment) of every template that the block holds."""
    ranks = index.ranks
    block = sorted({ranks[w] for w in words if w in ranks})
    bound: dict[int, int] = {}  # by template: most common tokens, from the first one on
    for j, rank in enumerate(block):
        for number, i in index.prefixes.get(rank, ()):
            if number not in bound:
                bound[number] = 1 + min(len(index.templates[number].tokens) - i - 1, len(block) - j - 1)
    held, out = set(block), []
    for number, most in bound.items():
        template = index.templates[number]
        if most >= template.needed and len(block) >= template.needed:
            common = len(held.intersection(template.tokens))
            if common >= template.needed:
                out.append((number, common / len(template.tokens)))
    return out


_LINES = bytes(
    10 if b == 10 else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def blocks(text: bytes):
    """(first word, words) of every block of a text."""
    at = 0
    for line in text.translate(_LINES).split(b"\n"):
        words = line.split()
        for begin in range(0, max(1, len(words) - STEP), STEP):
            yield at + begin, words[begin : begin + BLOCK]
        at += len(words)


def stretches(template: Template, at: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first word, last word, common tokens) of the stretches that hold enough of a template.

    ``at``: (place, rank) of the template's tokens in a text, in order. Every stretch that begins
    and ends with one is seen, in time linear in ``at``; of an overlapping run the best stays.
    """
    inside: Counter[int] = Counter()
    out: list[tuple[int, int, int]] = []
    begin = run_end = 0
    for place, rank in at:
        inside[rank] += 1
        while at[begin][0] <= place - template.stretch or inside[at[begin][1]] > 1:
            gone = at[begin][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            begin += 1
        if len(inside) < template.needed:
            continue
        found = (at[begin][0], place, len(inside))
        if out and found[0] <= run_end:
            if found[2] > out[-1][2]:
                out[-1] = found
        else:
            out.append(found)
        run_end = place
    return out


def text_matches(index: Index, text: bytes, words: Sequence[bytes]) -> list[tuple[int, int, float]]:
    """(first word, template, containment) of every line block and stretch at or above the share."""
    out, lined = [], {}
    for begin, block in blocks(text):
        if index.prefixes.keys().isdisjoint(map(index.ranks.get, block)):
            continue
        for number, share in block_matches(index, block):
            out.append((begin, number, share))
            lined.setdefault(number, []).append((begin, begin + len(block), share))
    spots: dict[int, list[int]] = {}  # places by rank
    for place, word in enumerate(words):
        if word in index.ranks:
            spots.setdefault(index.ranks[word], []).append(place)
    candidates = {number for rank in spots for number, _ in index.prefixes.get(rank, ())}
    for number in sorted(candidates):
        template = index.templates[number]
        held = [rank for rank in template.tokens if rank in spots]
        if len(held) < template.needed:
            continue
        at = sorted((place, rank) for rank in held for place in spots[rank])
        for first, last, common in stretches(template, at):
            share = common / len(template.tokens)
            if all(share > s or last < a or first >= b for a, b, s in lined.get(number, ())):
                out.append((first, number, share))
    return sorted(out)


def places(words: list[bytes], phrases: Mapping[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase + b" "
        at = line.find(wanted)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(wanted, at + 1)
    return sorted(found)


PLACE = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
FOUND = T.StructType(
    [
        T.StructField("word", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("template", T.IntegerType()),
        T.StructField("share", T.DoubleType()),
    ]
)


def _struct(rows: list[tuple], kind: T.StructType) -> pa.StructArray:
    types = {"long": pa.int64(), "string": pa.string(), "integer": pa.int32(), "double": pa.float64()}
    columns = list(zip(*rows)) or [()] * len(kind.fields)
    return pa.StructArray.from_arrays(
        [pa.array(c, types[f.dataType.typeName()]) for c, f in zip(columns, kind.fields)], names=kind.names
    )


def scan(
    docs: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    share: float = SHARE,
) -> DataFrame:
    """(row struct of ``keep``, n_words, places, found) of every row.

    places: (word, label) of the phrases; found: (word, label, template, share) of every pair of
    a block and a template at or above ``share``, ``word`` being the block's first word.
    """
    index = build_index(templates, frequencies(docs, text, templates), share)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    wanted = {" ".join(w.decode() for w in alnum_words(p.encode())).encode(): label for p, label in phrases.items()}

    def make():
        held = shared.value
        rare = frozenset(w for w, r in held.ranks.items() if r in held.prefixes)

        def apply(texts: list[bytes]) -> list[pa.Array]:
            sizes, place, place_at, found, found_at = [], [], [0], [], [0]
            for t in texts:
                words = alnum_words(t)
                sizes.append(len(words))
                place.extend(places(words, wanted))
                place_at.append(len(place))
                if not rare.isdisjoint(words):
                    found.extend((at, held.templates[k].label, k, s) for at, k, s in text_matches(held, t, words))
                found_at.append(len(found))
            return [
                pa.array(sizes, pa.int64()),
                lists(place_at, _struct(place, PLACE)),
                lists(found_at, _struct(found, FOUND)),
            ]

        return apply

    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(PLACE)),
        T.StructField("found", T.ArrayType(FOUND)),
    ]
    return map_texts(docs, text, keep, fields, make)
