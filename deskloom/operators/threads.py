"""Message threads: closure over reply edges, adjacent question-answer turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.rules import BRAND
from deskloom.operators.ordering import with_next
from deskloom.session import materialize

MAX_ROUNDS = 64


def thread_roots(messages: DataFrame, id_col: str = "msg_id", parent_col: str = "parent_id") -> DataFrame:
    """(msg_id, root_id): the topmost ancestor of every message.

    Message ids are unique and each has at most one parent, so pointers are halved each
    round (``ptr := ptr of ptr``) and a chain of depth d is resolved in log2(d) rounds.
    A parent that is not in the table is a root of its own and still ties its children
    together. Resolved rows leave the working set. Parent cycles in bad data are detected
    when a round resolves nothing; each cycle takes its smallest id as root.
    """
    start = messages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(parent_col), F.col(id_col)).alias("ptr"),
        F.col(id_col).alias("low"),
        F.col(parent_col).isNull().alias("done"),
    )
    state = materialize(start, "thread-pointers")
    resolved = [state.filter("done")]
    active = state.filter("not done")
    left, remaining = None, 0
    for _ in range(MAX_ROUNDS):
        step = materialize(_follow(active, resolved, active), "thread-pointers")
        resolved.append(step.filter("done"))
        active = step.filter("not done")
        remaining = active.count()
        if remaining == 0 or remaining == left:
            break
        left = remaining
    else:
        raise RuntimeError(f"a chain is deeper than 2 ** {MAX_ROUNDS} messages")
    roots = [part.select("id", "ptr") for part in resolved]
    if remaining:
        roots.append(_cycle_roots(active, remaining))
    combined = roots[0]
    for part in roots[1:]:
        combined = combined.unionByName(part)
    return combined.select(F.col("id").alias(id_col), F.col("ptr").alias("root_id"))


def _follow(active: DataFrame, resolved: list[DataFrame], open_rows: DataFrame) -> DataFrame:
    """One halving round: replace each pointer by the pointer it leads to."""
    known = open_rows
    for part in resolved:
        known = known.unionByName(part)
    known = known.select(
        F.col("id").alias("k_id"),
        F.col("ptr").alias("k_ptr"),
        F.col("low").alias("k_low"),
        F.col("done").alias("k_done"),
    )
    return active.join(known, F.col("ptr") == F.col("k_id"), "left").select(
        "id",
        F.coalesce("k_ptr", "ptr").alias("ptr"),
        F.least("low", "k_low").alias("low"),
        F.coalesce("k_done", F.lit(True)).alias("done"),
    )


def _cycle_roots(active: DataFrame, size: int) -> DataFrame:
    """Roots for rows whose chain ends in a cycle: the smallest id of that cycle.

    After as many rounds as ``size`` has binary digits, every path has gone around its
    cycle: pointers sit on it, and the minimum seen from a row on the cycle is its own.
    """
    for _ in range(size.bit_length()):
        active = materialize(_follow(active, [], active).withColumn("done", F.lit(False)), "cycles")
    on_cycle = active.select(F.col("id").alias("c_id"), F.col("low").alias("c_low"))
    return active.join(on_cycle, F.col("ptr") == F.col("c_id")).select(
        "id", F.col("c_low").alias("ptr")
    )


def select_threads(
    messages: DataFrame,
    brand: str = BRAND.author,
    id_col: str = "msg_id",
    parent_col: str = "parent_id",
    author_col: str = "author_id",
) -> DataFrame:
    """Ids (with root) of all messages connected to any message of the brand."""
    roots = thread_roots(messages, id_col, parent_col)
    target = brand.lstrip("@").lower()
    branded = (
        messages.filter(F.lower(F.col(author_col)) == target)
        .select(id_col)
        .join(roots, id_col)
        .select("root_id")
        .distinct()
    )
    return roots.join(branded, "root_id", "left_semi").select(id_col, "root_id")


def multi_turn(turns: DataFrame, group: str = "conv_id") -> DataFrame:
    """Rows of conversations with at least two turns."""
    sizes = turns.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    return turns.join(sizes.select(group), group, "left_semi")


def first_adjacent_pair(
    turns: DataFrame,
    is_brand: Column,
    group: str = "conv_id",
    order: str = "turn",
    text: str = "text",
) -> DataFrame:
    """First customer turn directly answered by the brand, one row per conversation."""
    flagged = turns.select(group, order, F.col(text).alias("said"), is_brand.alias("brand"))
    answered = ~F.col("brand") & F.col("next_brand")
    paired = with_next(flagged, group, order, ["said", "brand"], keep=answered)
    first = paired.groupBy(group).agg(
        F.min_by(F.struct(order, "said", "next_said"), order).alias("_pair")
    )
    return first.select(
        group,
        F.col(f"_pair.{order}").alias(order),
        F.col("_pair.said").alias("customer_text"),
        F.col("_pair.next_said").alias("agent_text"),
    )


def first_pair_in_array(turns: Column, brand: str = BRAND.author) -> Column:
    """Struct (customer_text, agent_text) of the first answered turn of a turn array."""
    following = F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))
    pairs = F.zip_with(
        turns,
        following,
        lambda a, b: F.struct(
            a["text"].alias("customer_text"),
            b["text"].alias("agent_text"),
            (
                (F.lower(a["author_id"]) != brand) & (F.lower(b["author_id"]) == brand)
            ).alias("fits"),
        ),
    )
    return F.get(F.filter(pairs, lambda p: p["fits"]), F.lit(0))


def context_lines(turns: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """Context of each conversation, one ``- author: text`` line per row.

    All turns but the last, for conversations with more than one. The long form keeps a
    conversation of any length spread over tasks; array-shaped cases use
    ``functions.text.context_prompt``.
    """
    last = turns.groupBy(group).agg(F.max(order).alias("_last"))
    return (
        turns.join(last, group)
        .filter(F.col(order) < F.col("_last"))
        .select(
            group,
            order,
            F.concat(F.lit("- "), F.col("role"), F.lit(": "), F.col("text")).alias("line"),
        )
    )


def extend_roots(
    roots: DataFrame,
    appended: DataFrame,
    messages: DataFrame,
    id_col: str = "msg_id",
    parent_col: str = "parent_id",
) -> tuple[DataFrame, DataFrame]:
    """(rows of the appended messages, new rows of older messages whose root changed).

    ``roots`` is (msg_id, root_id) of ``messages``, as ``thread_roots`` gives it; ``appended`` has
    new ids. Each appended message points at its parent, or at the parent's known root, and only
    these pointers are followed. An older message changes if its root was a missing parent that
    has arrived now. Older rows are looked up by the few appended keys, not moved as long as
    these fit a broadcast. Where an appended message closes a cycle, its threads alone are
    resolved anew, so the rows are those of ``thread_roots`` over all messages.
    """
    new = materialize(appended.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")), "appended")
    known = roots.select(F.col(id_col).alias("k_id"), F.col("root_id").alias("k_root"))
    parents = known.join(new.select(F.col("parent").alias("k_id")).distinct(), "k_id", "left_semi")
    contracted = new.join(parents, F.col("parent") == F.col("k_id"), "left").select(
        "id", F.coalesce("k_root", "parent").alias("ptr")
    )
    found = materialize(thread_roots(contracted, "id", "ptr"), "appended-roots")
    arrived = found.select(F.col("id").alias("k_root"), F.col("root_id").alias("new_root"))
    moved = materialize(known.join(arrived, "k_root").select("k_id", "k_root", "new_root"), "moved")
    # Only in a cycle is a root a message with a parent.
    cyclic = found.join(new.filter("parent IS NOT NULL").select(F.col("id").alias("root_id")), "root_id", "left_semi")
    looped = materialize(cyclic, "looped")
    if not looped.isEmpty():
        found, moved = _unlooped(found, moved, looped, known, new, messages, id_col, parent_col)
    fresh = found.select(F.col("id").alias(id_col), "root_id")
    changed = moved.filter("k_root != new_root").select(F.col("k_id").alias(id_col), F.col("new_root").alias("root_id"))
    return fresh, changed


def _unlooped(found, moved, looped, known, new, messages, id_col, parent_col):
    """``found`` and ``moved`` with the threads of ``looped`` rows resolved from their messages."""
    whole = looped.select("root_id").distinct()
    # Older threads that the cycle runs through, or that hang on it.
    older = moved.join(whole.withColumnRenamed("root_id", "new_root"), "new_root", "left_semi").select("k_id", "k_root")
    touched = older.select(F.col("k_id").alias(id_col))
    again = messages.join(touched, id_col, "left_semi").select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    again = again.unionByName(new.join(looped.select("id"), "id", "left_semi"))
    solved = materialize(thread_roots(again, "id", "parent"), "unlooped")
    rest = found.join(whole, "root_id", "left_anti").select("id", "root_id")
    fresh = rest.unionByName(solved.join(looped.select("id"), "id", "left_semi").select("id", "root_id"))
    still = moved.join(whole.withColumnRenamed("root_id", "new_root"), "new_root", "left_anti")
    again_moved = older.join(solved.withColumnRenamed("root_id", "new_root"), F.col("k_id") == F.col("id")).drop("id")
    return fresh, still.select("k_id", "k_root", "new_root").unionByName(again_moved.select("k_id", "k_root", "new_root"))


def replace_roots(roots: DataFrame, fresh: DataFrame, changed: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """``roots`` after ``extend_roots``."""
    kept = roots.join(changed.select(id_col), id_col, "left_anti").select(id_col, "root_id")
    return kept.unionByName(changed).unionByName(fresh)
