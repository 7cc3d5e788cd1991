"""Conversation repair: weighted CYK parsing of whole conversations.

The repaired roles have to be ``(s?(ua)+)?``: nothing, or an optional system turn and then user
and assistant in turn. The grammar is in Chomsky normal form. Its nonterminals are ``[p q]``,
"leads from state p to state q", over the states 0 nothing yet, 1 after system, 2 after user, 3
after assistant; the rules are ``[p q] -> [p r] [r q]`` and, for a single row, its edits:

- Keep, cost 0, where the role's initial leads from p to q,
- Rerole to user or assistant, cost 2,
- Delete, cost 3, the only edit of blank and repeated rows; an undeleted truncated row adds 1,
- Insert an empty user or assistant turn, cost 2. Insertions are closed over: the cell of a row
  holds the cheapest insertions before it as well, those at the very end are added to the root.

The cell of a span and nonterminal holds the least (cost, audit), the audit being the edits'
initials in order. All audits of one span end with an edit of its last row and hold as many such
edits as it has rows, so none begins another; the order of two joined audits is then that of
their parts, and a cell only needs the rank of its audit among the cells of its span.
Since [p q] of a span is the same whichever way the span is divided, one division into halves
is enough: spans are combined bottom-up by length, doubling it, and the edits are read off
top-down.

Distributed: rows are range-partitioned by (conversation, turn), so a conversation may lie in
many tasks. Blocks of at most ``BLOCK`` neighbouring rows are parsed to their cells; the cells
of a conversation's blocks are combined the same way (costs and ranks, 32 numbers a block), and
each block then takes the edits of its chosen cell. Only row positions and edits are joined to
the texts. A conversation's digest is the one thing that streams through one task, row by row.

Rows come by turn (nulls first), then role and text. Null roles and texts count as one space; a
null conversation id is a conversation. An empty role, or one whose initial is none of s, u, a,
can't be kept. Repeated rows are duplicates. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import written

#: Rows of a block, a power of two; costs of the edits.
BLOCK = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

STATES = 4
SYMBOLS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
#: (state, role's initial): next state.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Insertions that complete a repaired conversation, by its last state.
ENDINGS = ("", "ua", "a", "")
NEVER = 1 << 44
#: Letters of edits: u and a insert, U and A rerole, K keeps, D deletes.
_EDITS, _INITIALS = "uaUAKD", "IIRRKD"
_NAMES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def audit_of(edits: str) -> str:
    return edits.translate(str.maketrans(_EDITS, _INITIALS))


def insertions() -> list[list[str | None]]:
    """[p][q]: the fewest inserted turns that lead from p to q."""
    out: list[list[str | None]] = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        reached, todo = {p: ""}, [p]
        while todo:
            here = todo.pop(0)
            for sign in "ua":
                there = MOVES.get((here, sign))
                if there is not None and there not in reached:
                    reached[there] = reached[here] + sign
                    todo.append(there)
        for q, signs in reached.items():
            out[p][q] = signs
    return out


def row_cells(symbol: str, fault: str) -> list[list[tuple[int, str] | None]]:
    """[p][q]: least (cost, edits) of one row with the insertions before it."""
    more = TRUNCATED if fault == "truncated" else 0
    closure = insertions()
    cells: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]

    def offer(p: int, q: int, cost: int, edits: str) -> None:
        held = cells[p][q]
        if held is None or (cost, audit_of(edits)) < (held[0], audit_of(held[1])):
            cells[p][q] = (cost, edits)

    for p in range(STATES):
        for r, signs in enumerate(closure[p]):
            if signs is None:
                continue
            before = INSERT * len(signs)
            offer(p, r, before + DELETE, signs + "D")
            if fault in ("blank", "duplicate"):
                continue
            if (r, symbol) in MOVES:
                offer(p, MOVES[r, symbol], before + more, signs + "K")
            for role in "ua":
                if (r, role) in MOVES:
                    offer(p, MOVES[r, role], before + REROLE + more, signs + role.upper())
    return cells


def _tables() -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """By kind (symbol times fault): costs, ranks of the audits, edits of the 16 cells."""
    costs, ranks, edits = [], [], []
    for symbol in [*SYMBOLS, ""]:
        for fault in FAULTS:
            flat = [c for row in row_cells(symbol, fault) for c in row]
            audits = [audit_of(c[1]) if c else "~" for c in flat]
            costs.append([c[0] if c else NEVER for c in flat])
            ranks.append([sum(b < a for b in audits) for a in audits])
            edits.append([c[1] if c else "" for c in flat])
    shape = (len(costs), STATES, STATES)
    return np.array(costs, np.int64).reshape(shape), np.array(ranks, np.int64).reshape(shape), edits


KIND_COSTS, KIND_RANKS, KIND_EDITS = _tables()


class Parse:
    """Cells of many sequences of spans at once; sequence i has ``lengths[i]`` > 0 of them."""

    def __init__(self, costs: np.ndarray, ranks: np.ndarray, lengths: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (spans with a right half, splits)
        self.sizes: list[np.ndarray] = []
        lengths = np.asarray(lengths)
        while (lengths > 1).any():
            costs, ranks, lengths = self._halved(costs, ranks, lengths)
        self.costs, self.ranks = costs, ranks

    def _halved(self, costs: np.ndarray, ranks: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(costs)) - np.repeat(starts, lengths)
        left = np.flatnonzero(place % 2 == 0)
        paired = place[left] + 1 < np.repeat(lengths, lengths)[left]
        a, b = left[paired], left[paired] + 1
        # [p q] over r: least (cost, rank of the left audit, rank of the right one).
        cost = np.minimum(costs[a][:, :, :, None] + costs[b][:, None, :, :], NEVER)
        key = (cost << 16) + (ranks[a][:, :, :, None] << 8) + ranks[b][:, None, :, :]
        split = key.argmin(axis=2)
        best = np.take_along_axis(key, split[:, :, None, :], axis=2)[:, :, 0, :]
        order = np.where(best >> 16 < NEVER, best & 0xFFFF, 0xFFFF).reshape(-1, STATES * STATES)
        rank = (order[:, :, None] > order[:, None, :]).sum(axis=2)
        new_costs, new_ranks = costs[left], ranks[left]
        new_costs[paired] = best >> 16
        new_ranks[paired] = rank.reshape(-1, STATES, STATES)
        self.levels.append((paired, split))
        return new_costs, new_ranks, (lengths + 1) // 2

    def leaves(self, chosen: np.ndarray) -> np.ndarray:
        """Cells (4 p + q) of the first spans that make up the cells ``chosen`` of the last;
        one column per choice."""
        for paired, split in reversed(self.levels):
            p, q = chosen[paired] // STATES, chosen[paired] % STATES
            r = split[np.arange(len(split))[:, None], p, q]
            first, second = chosen.copy(), chosen.copy()
            first[paired] = STATES * p + r
            second[paired] = STATES * r + q
            both = np.stack([first, second], axis=1).reshape(-1, chosen.shape[1])
            chosen = both[np.stack([np.ones(len(paired), bool), paired], axis=1).ravel()]
        return chosen

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(cost with the insertions at the end, cell) of the best parse of every sequence."""
        ends = np.array([INSERT * len(e) for e in ENDINGS])
        cost = self.costs[:, 0, :] + ends
        q = ((cost << 8) + self.ranks[:, 0, :]).argmin(axis=1)
        return cost[np.arange(len(q)), q], q


def parse_kinds(kinds: Sequence[bytes]) -> tuple[Parse, np.ndarray]:
    """(parse, kinds of all rows) of sequences of kinds, a byte per row."""
    flat = np.frombuffer(b"".join(kinds), np.uint8)
    return Parse(KIND_COSTS[flat], KIND_RANKS[flat], np.array([len(k) for k in kinds], np.int64)), flat


@dataclass(frozen=True)
class Repair:
    """``conversations``: (conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit),
    one row per conversation with rows. ``turns``: the repaired turns (conv_id, at, nth, role,
    text, edit), ordered in a conversation by (at, nth); edit is Keep, Rerole or Insert."""

    conversations: DataFrame
    turns: DataFrame


def _kind(role: Column, fault: Column) -> Column:
    """Byte of a row: 4 * symbol + fault."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, SYMBOLS)), F.substring(role, 1, 1)), F.lit(0))
    symbol = F.when(at > 0, at - 1).otherwise(len(SYMBOLS))
    return (4 * symbol + F.array_position(F.array(*map(F.lit, FAULTS)), fault) - 1).cast("int")


def _cells(blocks: DataFrame) -> DataFrame:
    """``blocks`` (conv, block, first, kinds) with illegal, costs, ranks and the cells' edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [bytes(k) for k in batch.column(3).to_pylist()]
            if not kinds:
                continue
            parse, flat = parse_kinds(kinds)
            every = np.broadcast_to(np.arange(STATES**2), (len(kinds), STATES**2))
            leaves, at, edits = parse.leaves(every), 0, []
            for k in kinds:
                rows = range(at, at + len(k))
                held = [[KIND_EDITS[flat[i]][c] for i, c in zip(rows, leaves[at : at + len(k), cell])] for cell in range(16)]
                feasible = parse.costs[len(edits)].ravel() < NEVER
                edits.append(["".join(h) if f else None for h, f in zip(held, feasible)])
                at += len(k)
            symbol = flat // 4
            legal = np.isin(symbol[:-1] * 4 + symbol[1:], [1, 6, 9])  # su, ua, au
            ends = np.cumsum([len(k) for k in kinds])
            wrong = np.concatenate(([0], np.cumsum(~legal)))
            illegal = [int(wrong[b - 1] - wrong[b - len(k)]) for b, k in zip(ends, kinds)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(illegal, pa.int64()),
                    pa.array([k[0] // 4 for k in kinds], pa.int32()),
                    pa.array([k[-1] // 4 for k in kinds], pa.int32()),
                    pa.array(parse.costs.reshape(len(kinds), -1).tolist(), pa.list_(pa.int64())),
                    pa.array(parse.ranks.reshape(len(kinds), -1).tolist(), pa.list_(pa.int64())),
                    pa.array(edits, pa.list_(pa.string())),
                ],
                names=["conv", "block", "first", "illegal", "head", "tail", "costs", "ranks", "edits"],
            )

    schema = (
        "conv string, block long, first long, illegal long, head int, tail int, "
        "costs array<long>, ranks array<long>, edits array<string>"
    )
    return blocks.select("conv", "block", "first", "kinds").mapInArrow(run, schema)


def _chosen(cells: DataFrame) -> DataFrame:
    """(conv, cost, illegal, ending, path of (block, cell)) of every conversation."""
    parts = F.array_sort(F.collect_list(F.struct("block", "illegal", "head", "tail", "costs", "ranks"))).alias("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = batch.column(1), batch.num_rows
            if not size:
                continue
            lengths = np.diff(parts.offsets.to_numpy())
            part = parts.flatten()
            column = {name: part.field(name) for name in ("block", "illegal", "head", "tail")}
            column = {k: v.to_numpy() for k, v in column.items()}
            shape = (len(part), STATES, STATES)
            costs = part.field("costs").flatten().to_numpy().reshape(shape)
            parse = Parse(costs, part.field("ranks").flatten().to_numpy().reshape(shape), lengths)
            cost, root = parse.roots()
            cell = parse.leaves(root[:, None])[:, 0]
            owner = np.repeat(np.arange(size), lengths)
            seam = (owner[:-1] == owner[1:]) & ~np.isin(column["tail"][:-1] * 4 + column["head"][1:], [1, 6, 9])
            illegal = np.bincount(owner, column["illegal"], size) + np.bincount(owner[1:], seam, size)
            path = pa.StructArray.from_arrays(
                [pa.array(column["block"], pa.int64()), pa.array(cell, pa.int32())], names=["block", "cell"]
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cost, pa.int64()),
                    pa.array(illegal.astype(np.int64), pa.int64()),
                    pa.array([ENDINGS[q] for q in root], pa.string()),
                    pa.ListArray.from_arrays(offsets, path),
                ],
                names=["conv", "cost", "illegal", "ending", "path"],
            )

    schema = "conv string, cost long, illegal long, ending string, path array<struct<block: long, cell: int>>"
    return cells.groupBy("conv").agg(parts).mapInArrow(run, schema)


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> Repair:
    """Faults, cheapest edits and repaired turns of every conversation in ``rows``."""
    if block & (block - 1):
        raise ValueError("block must be a power of two")
    number = F.col(f"`{conv_id}`")
    plain = rows.select(
        number.alias("conv_id"),
        F.when(number.isNull(), "").otherwise(F.concat(F.lit("="), number.cast("string"))).alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )
    ranged = plain.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "text")
    # Increasing along the order, contiguous inside a partition.
    placed = written(
        ordered.withColumn("at", F.monotonically_increasing_id()).withColumn(
            "same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
        ),
        "turns",
    )
    first = placed.groupBy("conv", "same").agg(F.min("at").alias("earliest"))
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = placed.select("conv", "conv_id", "at", "turn", "same", F.substring("role", 1, 1).alias("role"), last.alias("last"))
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("at") > F.col("earliest"), "duplicate")
        .when(~F.col("last").rlike("[.!?]"), "truncated")
        .otherwise("none")
    )
    marked = slim.join(first, ["conv", "same"]).withColumn("fault", fault)
    marked = marked.withColumn("kind", _kind(F.col("role"), F.col("fault")))
    marked = written(marked.select("conv", "conv_id", "at", "turn", "fault", "kind"), "marked-turns")
    bits = block.bit_length() - 1
    kinds = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: F.lpad(F.hex(x["kind"]), 2, "0")), ""))
    blocks = marked.groupBy("conv", F.shiftright("at", bits).alias("block")).agg(F.min("at").alias("first"), kinds.alias("kinds"))
    cells = written(_cells(blocks), "cells")
    chosen = written(_chosen(cells), "parses")

    step = chosen.select("conv", F.explode("path").alias("step")).select("conv", "step.*")
    edited = written(
        cells.join(step, ["conv", "block"]).select(
            "conv", "block", "first", F.element_at("edits", F.col("cell") + 1).alias("edits")
        ),
        "edits",
    )
    audits = edited.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("edits")
    )
    present = F.countDistinct("turn")
    counted = marked.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - present, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS[1:]],
    )
    audit = F.translate(F.concat("edits", "ending"), _EDITS, _INITIALS).alias("audit")
    conversations = counted.join(chosen.drop("path"), "conv").join(audits, "conv")
    conversations = conversations.select("conv_id", "n_rows", "gaps", *FAULTS[1:], "illegal", "cost", audit)

    each = edited.select("first", F.posexplode(F.regexp_extract_all("edits", F.lit("([ua]*[UAKD])"), F.lit(1))).alias("i", "edits"))
    each = each.select((F.col("first") + F.col("i")).alias("at"), "edits")
    whose = placed.groupBy("conv").agg(F.max("at").alias("at"), F.first("conv_id").alias("conv_id"))
    ending = chosen.filter("ending != ''").join(whose, "conv").select("conv_id", "conv", "at", "ending")
    empty = F.lit(None).cast("string")
    turns = placed.select("conv_id", "conv", "at", "role", "text").join(each, "at")
    turns = turns.select("conv_id", "at", F.lit(0).alias("part"), "role", "text", "edits").unionByName(
        ending.select("conv_id", "at", F.lit(1).alias("part"), empty.alias("role"), empty.alias("text"), F.col("ending").alias("edits"))
    )
    letter = F.posexplode(F.split("edits", "")).alias("i", "letter")
    turns = turns.select("conv_id", "at", "part", "role", "text", letter).filter("letter NOT IN ('D', '')")
    named = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    turns = turns.select(
        "conv_id",
        "at",
        (F.col("part") * (1 << 20) + F.col("i")).alias("nth"),
        F.coalesce(F.get(F.map_values(F.map_filter(named, lambda k, v: k == F.col("letter"))), F.lit(0)), "role").alias("role"),
        F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("letter") == "K", "Keep").when(F.col("letter").isin("u", "a"), "Insert").otherwise("Rerole").alias("edit"),
    )
    return Repair(conversations, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of every conversation, streamed in order."""
    name = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    keyed = turns.select(name.alias("conv"), "at", "nth", "role", "text")
    ordered = keyed.repartition("conv").sortWithinPartitions("conv", "at", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            role, text = (batch.column(i).cast(pa.binary()).to_pylist() for i in (3, 4))
            for conv, r, t in zip(batch.column(0).to_pylist(), role, text):
                if conv != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(r + b":" + t)
            if done:
                yield _hashed(done)
        if last is not None:
            yield _hashed([(last, digest.hexdigest())])

    hashed = ordered.mapInArrow(run, "conv string, sha256 string")
    back = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(turns.schema["conv_id"].dataType)
    return hashed.select(back.alias("conv_id"), "sha256")


def _hashed(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["conv", "sha256"])


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties the
    text, 2 removes its full stops, 3 repeats the row, 4 makes it the user's; nulls: one space."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    name = F.concat(filled(conv_id), F.lit(":"), filled(turn))
    h = F.crc32(name.cast("binary")) % 20
    words = F.when(h == 1, "").when(h == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    made = rows.filter(h != 0).select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.when(h == 4, "user").otherwise(filled(role)).alias("role"),
        words.alias("text"),
        F.when(h == 3, 2).otherwise(1).alias("times"),
    )
    return made.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
