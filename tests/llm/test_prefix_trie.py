import hashlib
import random
import zlib

from pyspark.sql import functions as F

from topicmoments.llm import prefix_trie as module
from topicmoments.llm.prefix_trie import head_turns, prefix_trie

RNG = random.Random(12)
COLUMNS = "conv_id long, turn long, role string, text string, depth long, k1 long, conv long, n string, size string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows, family=5, heads=9):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(rest, [])[:h] + turns[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for seq, convs in members.items():
        below = [s for s in members if s[:len(seq)] == seq]
        leaf = [s for s in below if not any(len(t) == len(s) + 1 and t[:-1] == s for t in below)]
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == seq)))
        out.append((min(convs), len(seq), min(members[seq[:-1]]) if seq else None, len(convs),
                    sum(len(s) == len(seq) + 1 for s in below), len(leaf),
                    sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    frame = spark.createDataFrame([(*r, 7, 8, 9, "x", "y") for r in rows], COLUMNS)
    return sorted((tuple(r) for r in prefix_trie(frame).select(*NAMES).collect()), key=str)


def corpus():
    turns = [("user", f"question {i}") for i in range(6)] + [("assistant", f"réponse {i} 日本") for i in range(6)] + [("", ""), ("user", "")]
    rows = []
    for c in range(60):
        n = RNG.randrange(0, 14)
        rows += [(c, t, *RNG.choice(turns[:3 + t])) for t in range(n)]
    for c in range(100, 140):  # one conversation under many ids
        rows += [(c, t, *turns[t % 5]) for t in range(12)]
    rows += [(201, t, "user", f"long {t}") for t in range(60)]
    rows += [(-7, 1, "user", "minus"), (-5, 1, "user", "base"), (-5, 2, None, "more"), (301, None, None, None), (301, 3, "a", "b"), (301, 3, "a", "b"),
             (301, 3, "a", "a"), (None, 1, "user", "lost"), (10**15, 1, "user", "far")]
    RNG.shuffle(rows)
    return rows


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "LIST_BYTES", 20)
    rows = corpus()
    assert result(spark, rows) == brute_force(rows)


def test_an_empty_table_has_no_root_and_turnless_ones_end_there(spark):
    assert result(spark, [(1, 1, "u", "x")][:0]) == []
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 60)}
    c = next(c for c in h if c % 5 and h[c] > 0)
    got = result(spark, [(c, 1, "u", "x")])
    assert got == brute_force([(c, 1, "u", "x")]) and got[0][1] == 0 and got[0][5] == 1 and len(got) == 1


def test_heads_are_as_zlib_counts(spark):
    got = spark.range(-50, 50).select("id", head_turns(F.col("id")).alias("h")).collect()
    assert all(r["h"] == zlib.crc32(str(r["id"]).encode()) % 9 for r in got)


def test_a_very_long_turn_and_prefixes_of_each_other(spark):
    long = "x" * 2_000_000
    rows = [(5 * i, t, "u", long if t == 0 else f"{t}") for i in range(1, 6) for t in range(i)]
    assert result(spark, rows) == brute_force(rows)
