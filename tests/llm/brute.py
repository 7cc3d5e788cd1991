"""Plain re-computations of the contract results, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def archive(rows):
    """rows (page_id, html) -> page_id: (bytes, sha1, type, refers_to)"""
    bodies = {p: (h or "").encode() for p, h in rows}
    last: dict[bytes, int] = {}
    for p, b in bodies.items():
        last[b] = max(last.get(b, p), p)
    out = {}
    for p, b in bodies.items():
        revisit = len(b) >= 1000 and last[b] != p
        out[p] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None)
    return out


def base_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def substring_dedup(rows, width=35):
    """rows (key, text) -> key: (n_words, n_removed, sha256)"""
    docs = {k: SPACED.findall(t or "") for k, t in rows}
    count = Counter()
    for words in docs.values():
        count.update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = {}
    for k, words in docs.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if count[tuple(words[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[k] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_licenses(text):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    words = ALNUM.findall(ascii_lower(text or ""))
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (
        len(words),
        len(found),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in found})),
    )


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return ascii_lower(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_rule(url, rules):
    host, path = url_parts(url)
    best = None
    for action, entry in rules:
        h, slash, p = entry.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or ("", ""), (entry, action), key=lambda x: len(x[0]))
    return best


def simhash(text):
    words = SPACED.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, most=4):
    """prints {id: fingerprint} -> {id: least id reachable}"""
    parent = {p: p for p in set(prints.values())}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, p in prints.items():
        r = find(p)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(p)] for d, p in prints.items()}


def benchmark_hits(docs, items, width=13):
    """docs (id, text), items (id, text) -> id: (n_words, n_hit, n_items, sha256, contaminated)"""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = ALNUM.findall(ascii_lower(text or ""))
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        words = ALNUM.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def token_rows(docs, path, end_id):
    """docs (id, text) -> id: (start, n_tokens, crc32)"""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out[d] = (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    return out


def infill(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output sha256, restored sha256) of a text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    out, form = text, "plain"
    if text and not any(m in text for m in ("<P>", "<S>", "<M>")) and h3 % 100 < 90:
        form = "spm" if h4 % 100 < 20 else "psm"
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return n, form, *chars, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    """rows (conv_id, turn, role, text) after the damage of the contract."""
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h:
            role = "user" if h == 4 else role
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            yield from [(conv, turn, role, text)] * (2 if h == 3 else 1)


def turn_faults(turns):
    """Fault of every (role, text), in order."""
    seen, out = set(), []
    for role, text in turns:
        signs = SPACED.findall(text)
        if not signs:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if signs[-1][-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repaired(turns, faults):
    """Least (cost, audit) of all repairs, and its lines, by trying every edit of every turn."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}
    held = {}

    def best(i, state, inserted=0):
        if (i, state, inserted) in held:
            return held[i, state, inserted]
        options = []
        if i == len(turns):
            if state in (0, 3):
                options.append((0, "", []))
        else:
            role, text = turns[i]
            c, a, lines = best(i + 1, state)
            options.append((c + 3, "D" + a, lines))
            if faults[i] in ("none", "truncated"):
                more = faults[i] == "truncated"
                for to, cost, letter in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]:
                    if (state, to[:1]) in moves:
                        c, a, lines = best(i + 1, moves[state, to[:1]])
                        options.append((c + cost + more, letter + a, [f"{to}:{text}", *lines]))
        if inserted < 3:
            for sign, name in names.items():
                if (state, sign) in moves:
                    c, a, lines = best(i, moves[state, sign], inserted + 1)
                    options.append((c + 2, "I" + a, [f"{name}:", *lines]))
        held[i, state, inserted] = min(options, default=(10**9, "", []))
        return held[i, state, inserted]

    return best(0, 0)


def conversations(rows, all_ids):
    """rows (conv_id, turn, role, text), damaged -> conv_id: the columns of the contract."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv in all_ids:
        held = sorted(by.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[1:] for r in held]
        faults = turn_faults(turns)
        signs = [role[:1] for role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(signs, signs[1:]))
        known = [r[0] for r in held if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = repaired(turns, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def shingle_sets(rows, size=4):
    """rows (key, text) -> key: set of shingles"""
    out = {}
    for k, text in rows:
        words = SPACED.findall(ascii_lower(text or ""))
        out[k] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return out


def jaccard_components(sets, percent=85):
    """sets {key: set} -> {key: least key reachable}"""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if percent * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}
