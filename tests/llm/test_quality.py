import os
import random
import re
from collections import Counter

import zstandard
from brute import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from topicmoments.llm.quality import BANDS, quality_rules, repeat_words


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if counts[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=40))
def test_repeated_windows(words):
    assert repeat_words([w.encode() for w in words]) == slow(" ".join(words))[4]


def test_as_brute_force(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice(("the", "ing", "é", "ou", "st", "ra", "mi", "an")) for _ in range(rng.randrange(1, 4))) for _ in range(160))
    rows = [(0, None), (1, ""), (2, prose), (3, prose + "\n" + prose), (4, "a b c " * 5000), (5, " \t\x1c\x85\xa0x 日本\r\n\n x"),
            (6, "same line\n" * 3 + "\n\n"), (7, " ".join(f"{i} again and again" for i in range(4000))),
            (8, " ".join(os.urandom(3000).hex()[i:i + 90] for i in range(0, 6000, 90))), (2, prose), (None, "# $ | " + prose)]
    got = quality_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == slow(text), r["doc_id"]
        data = text.encode()
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data) if data else 0.0
        assert r["ratio"] == ratio
        low, high = next((low, high) for longest, low, high in BANDS if len(data) <= longest)
        if r["base_failed"] or not low <= ratio <= high:
            assert not r["kept"]
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {2, None} <= kept and not kept & {0, 1, 3, 4, 6}
    assert quality_rules(documents(spark, rows).limit(0)).count() == 0
