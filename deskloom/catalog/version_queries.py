"""Versioned store and appended messages against building everything at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog.base import query
from deskloom.catalog.join_queries import CLOSURE_SQL
from deskloom.catalog.rule_queries import _CASES_SQL, _cases
from deskloom.catalog.source_queries import messages
from deskloom.catalog.vector_queries import index_sql
from deskloom.operators import threads as TH
from deskloom.operators.store import PairStore
from deskloom.session import materialize, scratch_path


# Three appends, a removal of every seventh pair, and half of these added again.
@query(
    "store_index",
    f"WITH {_CASES_SQL}, items AS (SELECT case_id AS item, intent AS grp, customer_text AS text FROM cases "
    "WHERE case_id % 7 <> 0 OR case_id % 2 = 0), "
    + index_sql("items")
    + " SELECT grp, term, df, n, round(idf, 6) AS idf FROM idx_idf",
)
def store_index(spark, sf):
    pairs = materialize(_cases(spark, sf).select("case_id", "intent", "customer_text"), "pairs")
    store = PairStore(spark, scratch_path(spark, "store"), "case_id", "intent", "customer_text")
    for part in range(3):
        store.append(pairs.filter(F.pmod(F.xxhash64("case_id"), F.lit(3)) == part))
    seventh = pairs.filter("case_id % 7 = 0")
    store.remove(seventh.select("case_id"))
    store.append(seventh.filter("case_id % 2 = 0"))
    return store.index().idf.withColumn("idf", F.round("idf", 6))


# The later two thirds of each conversation arrive in two steps, the last messages first.
@query(
    "thread_append",
    f"""WITH RECURSIVE {CLOSURE_SQL},
    up AS (SELECT msg_id, msg_id AS pos FROM messages
           UNION ALL SELECT up.msg_id, m.parent_id FROM up JOIN messages m ON m.msg_id = up.pos
           WHERE m.parent_id IS NOT NULL)
    SELECT up.msg_id, up.pos AS root_id FROM up LEFT JOIN messages m ON m.msg_id = up.pos
    WHERE m.msg_id IS NULL OR m.parent_id IS NULL""",
)
def thread_append(spark, sf):
    rows = materialize(messages(spark, sf).select("msg_id", "parent_id"), "messages")
    step = F.pmod(F.xxhash64("msg_id"), F.lit(3))
    there = rows.filter(step == 0)
    roots = materialize(TH.thread_roots(there), "roots")
    for n in (1, 2):
        appended = rows.filter(step == n)
        fresh, changed = TH.extend_roots(roots, appended, there)
        roots = materialize(TH.replace_roots(roots, fresh, changed), "roots")
        there = there.unionByName(appended)
    return roots.select("msg_id", "root_id")
