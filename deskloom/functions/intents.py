"""Cue-based intent scoring. Cue tables are parameters: {intent: [cue, ...]}."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.rules import CUES, OTHER
from deskloom.functions.text import contains_any

Cues = Mapping[str, Sequence[str]]


def cue_hits(lowered: Column, words: Sequence[str]) -> Column:
    """How many of the cues occur in the lower-cased text."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def classify_by_cues(text: Column, cues: Cues = CUES, other: str = OTHER) -> Column:
    """Struct (intent, hits, confidence): most cues wins, earlier list entry on a tie."""
    lowered = F.lower(text)
    scored = [
        F.struct(
            cue_hits(lowered, words).alias("hits"),
            F.lit(-rank).alias("rank"),
            F.lit(intent).alias("intent"),
        )
        for rank, (intent, words) in enumerate(cues.items())
    ]
    best = F.array_max(F.array(*scored))  # one shared subexpression in generated code
    return F.struct(
        F.when(best["hits"] > 0, best["intent"]).otherwise(other).alias("intent"),
        best["hits"].alias("hits"),
        cue_confidence(best["hits"]).alias("confidence"),
    )


def cue_confidence(hits: Column) -> Column:
    """0.70 plus 0.10 per cue, at most 0.95; 0.40 without any cue."""
    return F.when(
        hits > 0, F.round(F.least(F.lit(0.95), F.lit(0.70) + hits * F.lit(0.10)), 2)
    ).otherwise(F.lit(0.40))


def first_cue_intent(text: Column, cues: Cues = CUES) -> Column:
    """First intent, in list order, with any cue in the text; NULL if none."""
    lowered = F.lower(text)
    branches = iter(cues.items())
    intent, words = next(branches)
    picked = F.when(contains_any(lowered, words), intent)
    for intent, words in branches:
        picked = picked.when(contains_any(lowered, words), intent)
    return picked


def matching_intents(text: Column, cues: Cues = CUES) -> Column:
    """Array of the positions (1-based, list order) of all intents with a cue in the text."""
    lowered = F.lower(text)
    flags = [
        F.when(contains_any(lowered, words), F.lit(rank))
        for rank, words in enumerate(cues.values(), start=1)
    ]
    return F.array_compact(F.array(*flags))


def taxonomy_map(labels: Sequence[str]) -> Column:
    """Literal map label -> id (position in the list)."""
    return F.create_map(*[F.lit(v) for i, name in enumerate(labels) for v in (name, i)])


def label_id(name: Column, labels: Sequence[str], other: str = OTHER) -> Column:
    """Label id of a name; an unlisted name gets the id of ``other``."""
    known = F.try_element_at(taxonomy_map(labels), F.upper(F.trim(name)))
    return F.coalesce(known, F.lit(list(labels).index(other)))


def label_name(position: Column, labels: Sequence[str], other: str = OTHER) -> Column:
    """Label name of an id; an id outside the list gets ``other``."""
    names = F.create_map(*[F.lit(v) for i, name in enumerate(labels) for v in (i, name)])
    return F.coalesce(F.try_element_at(names, position.cast("int")), F.lit(other))
