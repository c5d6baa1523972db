"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}


def near_duplicates(rows, width, percent):
    """(doc_id, n_shingles, component_id, kept) for each (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        many = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        sets.append(many or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    found = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(ids) if ids else None
        found += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return found


def contamination(rows, items, size):
    """doc_id, n_words, n_hit, item ids for each (doc_id, text)."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if item_id is None else str(item_id))
    lengths = {len(w) for w in windows}
    found = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        found.append((doc_id, len(w), len(hit), tuple(sorted(ids))))
    return found


def dedup_lines(rows, min_words):
    """Kept text and number of removed lines by (doc_id, text), ids being distinct.

    By the definition: a line goes if it lies in a run of enough words that begins earlier too.
    """
    rows = sorted(rows, key=lambda r: r[0])
    first = {}
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    for doc, (_, lines) in enumerate(texts):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                first.setdefault(tuple(lines[s:e]), (doc, s))
    found = {}
    for doc, (doc_id, lines) in enumerate(texts):
        gone = set()
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = lines[s:e]
                if sum(len(x.split()) for x in run) >= min_words and first[tuple(run)] < (doc, s):
                    gone |= set(range(s, e))
        found[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return found
