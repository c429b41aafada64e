"""Plain versions of the operators, one document or pair at a time, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, key string, kept string, n_words string, h string, line string"


def documents(spark, texts):
    """A documents table from (id, text), with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefg") for i, t in texts], DOC_COLUMNS)


class Groups:
    def __init__(self, members):
        self.parent = {m: m for m in members}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingle_set(text, size):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_duplicates(rows, size, percent):
    """id -> (n_shingles, component) for rows with different ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    groups, holders = Groups(sets), defaultdict(list)
    for i, own in sorted(sets.items()):
        common = Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                groups.join(i, j)
        for s in own:
            holders[s].append(i)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def dedupe_lines(rows, most=2, least=32, near_from=None):
    """id -> text without repeated lines, for rows with different ids. With `near_from` every line that holds a word counts."""
    def counted(line):
        return len(line) >= least or near_from is not None and re.search(r"[^\W_]", line) is not None

    lines = {}
    for i, text in sorted(rows):
        for line in (text or "").split("\n"):
            if counted(line):
                lines.setdefault(line, i)
    groups, counts = Groups(lines), {line: Counter(line) for line in lines}
    by_size = defaultdict(list)
    for line in (x for x in lines if len(x) >= (near_from or 0)):
        for size in range(len(line) - most, len(line) + 1):
            for other in by_size[size]:
                a, b = counts[line], counts[other]
                if sum(((a - b) + (b - a)).values()) <= 2 * most and edits(line, other) <= most:
                    groups.join(line, other)
        by_size[len(line)].append(line)
        for size in range(len(line) + 1, len(line) + most + 1):
            for other in by_size[size]:
                a, b = counts[line], counts[other]
                if sum(((a - b) + (b - a)).values()) <= 2 * most and edits(line, other) <= most:
                    groups.join(line, other)
    first = {}
    for line, i in lines.items():
        root = groups.find(line)
        first[root] = min(first.get(root, i), i)
    out = {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        seen, kept = set(), []
        for line in text.split("\n"):
            root = groups.find(line) if counted(line) else None
            if root is not None and (first[root] != i or root in seen):
                continue
            seen.add(root)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def item_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def contamination(rows, items, window=13):
    """id -> (n_words, n_hit, sorted item ids, contaminated)."""
    wanted = defaultdict(set)
    for item, text in items:
        words = item_words(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            wanted[tuple(words[at:at + size])].add(item)
    sizes = {len(w) for w in wanted}
    out = {}
    for i, text in rows:
        words, hit, found = item_words(text), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                owners = wanted.get(tuple(words[at:at + size]))
                if owners:
                    hit.update(range(at, at + size))
                    found |= owners
        out[i] = (len(words), len(hit), sorted(str(x) for x in found if x is not None), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
