"""DuckDB twins of the operator queries that SQL can express."""

from __future__ import annotations

from deskloom.llm import licenses
from deskloom.llm.common import alnum_words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM d"""

OP3 = rf"""WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
place AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY array_to_string(w[pos:pos + 34], ' ')) AS n FROM place),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM win WHERE n > 1),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.pos) AS text, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos WHERE gone.pos IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def op4() -> str:
    rows = [(label, alnum_words(text.encode())) for label, text in licenses.TEMPLATES]
    templates = ", ".join(
        f"({i}, {quote(label)}, [{', '.join(quote(w.decode()) for w in sorted(set(words)))}], {len(words)})"
        for i, (label, words) in enumerate(rows)
    )
    phrases = ", ".join(
        f"([{', '.join(quote(w) for w in phrase.split())}], {quote(label)})" for phrase, label in licenses.PHRASES.items()
    )
    line = _ALNUM.replace("text", "line")
    return rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
phrase(p, label) AS (VALUES {phrases}), template(k, label, tokens, n) AS (VALUES {templates}),
spot AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS pos
  FROM d, phrase WHERE len(w) >= len(p)),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word FROM spot GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
words AS (SELECT doc_id, {line} AS lw FROM line),
part AS (SELECT doc_id, lw, unnest(range(0, greatest(1, len(lw) - {licenses.STEP}), {licenses.STEP})) AS a FROM words),
block AS (SELECT doc_id, list_distinct(lw[a + 1:a + {licenses.BLOCK}]) AS tokens FROM part),
goal AS (SELECT *, ceil({licenses.SHARE} * len(tokens) - 1e-9) AS needed, ceil(n / {licenses.SHARE} - 1e-9)::BIGINT AS stretch FROM template),
near AS (SELECT doc_id, w, label, tokens, needed, stretch FROM d, goal WHERE len(list_intersect(list_distinct(w), tokens)) >= needed),
run AS (SELECT doc_id, label, tokens, needed, w[i:i + stretch - 1] AS words
  FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(tokens, w[i]))) AS i FROM near)),
pair AS (SELECT doc_id, label, len(list_intersect(b.tokens, t.tokens)) AS common, len(t.tokens) AS size, needed FROM block b, goal t
  UNION ALL SELECT doc_id, label, len(list_intersect(list_distinct(words), tokens)), len(tokens), needed FROM run),
found AS (SELECT doc_id, label, common::DOUBLE / size AS share FROM pair WHERE common >= needed),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
base_label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM spot GROUP BY doc_id),
any_label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM spot UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, (CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
LEFT JOIN base_label b USING (doc_id) LEFT JOIN any_label a USING (doc_id)"""


def op6(rules: list[tuple[str, str, str]]) -> str:
    """``rules``: (action, host, path); those with more host labels first, then longer paths."""
    ordered = sorted(rules, key=lambda r: (-len(r[1].split(".")), -len(r[2]), r[0] != "block"))

    def case(values: list[str], otherwise: str) -> str:
        fits = [
            f"(host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)})" for _, h, p in ordered
        ]
        return "CASE " + " ".join(f"WHEN {f} THEN {v}" for f, v in zip(fits, values)) + f" ELSE {otherwise} END"

    rule, action = case([quote(h + p) for _, h, p in ordered], "NULL"), case([quote(a) for a, _, _ in ordered], "'allow'")
    return rf"""WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, {action} AS verdict FROM u"""


OP10 = rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w, least(13, len(w)) AS size FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM b WHERE size > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, pos, size, item_id FROM dw JOIN bw USING (size, win)),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN item i USING (doc_id)"""


_DRAW = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
r AS (SELECT doc_id, t, n, {_DRAW} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


# Pairs that share a shingle of their prefix by name; links to components by least neighbours.
OP12 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM d),
c AS (SELECT s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
token AS (SELECT id, n, unnest(s) AS token FROM c),
often AS (SELECT token, count(*) AS df FROM token GROUP BY token),
ranked AS (SELECT id, n, token, df, row_number() OVER (PARTITION BY id ORDER BY df, token) AS place FROM token JOIN often USING (token)),
prefix AS (SELECT id, n, token FROM ranked WHERE df > 1 AND place <= n - (85 * n + 99) // 100 + 1),
pair AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b USING (token) WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM pair JOIN c a ON a.id = x JOIN c b ON b.id = y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 85 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT id AS x, id AS y FROM c UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
least AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN least USING (id)"""

_CRC_STEP = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"""xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda s: unicode(s)::BIGINT)),
  lambda c, b: {_CRC_STEP}), 4294967295)"""
_BLANKS = r"[\x20\x09-\x0D]"
# States, moves and insertions of the grammar; a row's edits are joined to the states before it.
OP13 = rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS h FROM c),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM rows_),
f AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier, left(role, 1) AS sign,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
  regexp_extract(text, '(?s)([^\x20\x09-\x0D]){_BLANKS}*$', 1) AS last FROM n),
g AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated'
  ELSE 'none' END AS fault FROM f),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND earlier || sign NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS size FROM g GROUP BY conv_id),
move(p, sign, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, cost, audit, made) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
  (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
op AS (SELECT conv_id, pos, p, q, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS audit, chr(10) || role || ':' || text AS made
    FROM g JOIN move USING (sign) WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT conv_id, pos, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R',
    chr(10) || CASE move.sign WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
    FROM g, move WHERE fault IN ('none', 'truncated') AND move.sign <> 's'
  UNION ALL SELECT conv_id, pos, p, p, 3, 'D', '' FROM g, range(4) AS s(p)),
cell AS (SELECT conv_id, pos, ins.p, op.q, min({{'cost': ins.cost + op.cost, 'audit': ins.audit || op.audit, 'made': ins.made || op.made}}) AS best
  FROM op JOIN ins ON ins.q = op.p GROUP BY ALL),
parse(conv_id, pos, q, best) AS (SELECT conv_id, 0, 0, {{'cost': 0, 'audit': '', 'made': ''}} FROM stats
  UNION ALL SELECT s.conv_id, s.pos + 1, c.q, min({{'cost': s.best.cost + c.best.cost, 'audit': s.best.audit || c.best.audit, 'made': s.best.made || c.best.made}})
    FROM parse s JOIN cell c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND c.pos = s.pos + 1 AND c.p = s.q GROUP BY s.conv_id, s.pos, c.q),
done AS (SELECT s.conv_id, min({{'cost': s.best.cost + e.cost, 'audit': s.best.audit || e.audit, 'made': s.best.made || e.made}}) AS best
  FROM parse s JOIN stats t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.pos = t.size
  JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'),
    (3, 0, '', '')) AS e(q, cost, audit, made) USING (q) GROUP BY s.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substring(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN stats ON ids.conv_id IS NOT DISTINCT FROM stats.conv_id
LEFT JOIN done ON ids.conv_id IS NOT DISTINCT FROM done.conv_id"""
