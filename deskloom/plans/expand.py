"""Dataset expansion: mine, score, accept or verify, fill each label's quota."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.intents import Cues
from deskloom.functions.payloads import batch_label_items
from deskloom.functions.probabilities import triage
from deskloom.functions.rules import CUES, LIMITS, TAXONOMY
from deskloom.functions.text import strip
from deskloom.operators.matching import tagged_union, without_seen
from deskloom.operators.ordering import number_rows
from deskloom.operators.sampling import fill_quota, label_counts, mine_pools, seeded_hash
from deskloom.session import materialize

DISCARD = "DISCARD"


def candidate_texts(corpus: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Texts of candidate length that are not in the seen table."""
    band = F.length(F.col(text)).between(LIMITS.min_candidate_chars, LIMITS.max_candidate_chars)
    return without_seen(corpus.filter(band), seen, key=text)


def batch_labels(
    items: DataFrame, answers: DataFrame, keys: Sequence[str], labels: Sequence[str] = TAXONOMY
) -> DataFrame:
    """Label of every batch item from the batch's JSON answer; DISCARD where unusable.

    ``items`` has ``keys`` and ``item`` (1-based); ``answers`` has ``keys`` and ``response``.
    The last valid entry for an item counts. One id that is no number voids the whole
    answer; an entry without id labels nothing.
    """
    entries = batch_label_items(F.col("response"))
    broken = F.exists("_entries", lambda e: e["id"].isNotNull() & e["id"].try_cast("double").isNull())
    sound = answers.withColumn("_entries", entries).filter(~broken)
    parsed = sound.select(*keys, F.posexplode("_entries").alias("pos", "e"))
    intent = F.upper(strip(F.col("e.intent")))
    usable = parsed.select(
        *keys, F.col("e.id").try_cast("double").cast("int").alias("item"), "pos", intent.alias("intent")
    ).filter(F.col("intent").isin(*labels))
    last = usable.groupBy(*keys, "item").agg(F.max_by("intent", "pos").alias("_label"))
    return items.join(last, [*keys, "item"], "left").withColumn(
        "verified", F.coalesce("_label", F.lit(DISCARD))
    ).drop("_label")


def merge_verified(
    queued: DataFrame, needed: DataFrame, labels: Sequence[str] = TAXONOMY
) -> DataFrame:
    """Verified rows worth keeping: of each pool, the first 2 * needed, minus discarded.

    ``queued`` is (intent, rank, text, verified) with rank numbered per pool; ``needed`` is
    (intent, needed).
    """
    return (
        queued.join(needed, "intent")
        .filter((F.col("rank") <= 2 * F.col("needed")) & F.col("verified").isin(*labels))
        .drop("needed")
    )


def expand_dataset(
    golden: DataFrame,
    corpus: DataFrame,
    score: Callable[[Column], Column],
    verify: Callable[[Column], Column] | None = None,
    cues: Cues = CUES,
    pool_size: int = LIMITS.pool_size,
    quota: int = LIMITS.quota,
    order: str = "ord",
) -> DataFrame:
    """(text, intent, source): golden rows, then machine-labelled ones up to the quota.

    ``golden`` is (text, intent); ``corpus`` is (text, ``order``). ``score`` maps a text to
    a struct (intent, confidence). Confident texts are accepted as their predicted label in
    a fixed random order; those in the middle band are labelled by ``verify`` (text to
    label) and fill what is left. Of a pool at most twice its need before scoring is
    verified, and the pool of a label that ``golden`` already fills is left out.
    """
    pools = mine_pools(candidate_texts(corpus, golden), "text", order, cues, pool_size)
    have = label_counts(golden, "intent")
    full = have.filter(F.col("n") >= quota).select("intent")
    scored = materialize(
        pools.join(full, "intent", "left_anti").withColumn("_s", score(F.col("text"))).select(
            "text",
            F.col("intent").alias("pool"),
            F.col("_s.intent").alias("intent"),
            triage(F.col("_s.confidence")).alias("tier"),
            seeded_hash(F.col(order)).alias("_hash"),
        ),
        "scored-pools",
    )
    accepted = fill_quota(
        scored.filter("tier = 'ACCEPT'"), "intent", [F.col("_hash")], have, quota
    )
    parts = {"golden": golden, "gpu_high_conf": accepted}
    if verify is not None:
        counts = label_counts(
            golden.select("intent").unionByName(accepted.select("intent")), "intent"
        )
        needed = have.select("intent", (quota - F.col("n")).alias("needed"))
        all_pools = scored.select(F.col("pool").alias("intent")).distinct()
        needed = all_pools.join(needed, "intent", "left").select(
            "intent", F.coalesce("needed", F.lit(quota)).alias("needed")
        )
        ranked = number_rows(
            scored.filter("tier = 'QUEUE'").select("text", "_hash", F.col("pool").alias("intent")),
            ["_hash"],
            ["intent"],
            name="rank",
        )
        kept = merge_verified(ranked.withColumn("verified", verify(F.col("text"))), needed)
        verified = fill_quota(
            kept.select("text", F.col("verified").alias("intent"), "_hash"),
            "intent",
            [F.col("_hash")],
            counts,
            quota,
        )
        parts["llm_verified"] = verified
    return tagged_union(**parts)
