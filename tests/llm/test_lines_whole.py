import random
import re

from brute import Groups, documents, edits

from topicmoments.llm.lines import EDITS, MIN_CHARS, NEAR_FROM, dedupe_lines
from topicmoments.llm.queries import op8_line_dedup

RNG = random.Random(23)


def counts(line):
    return len(line) >= MIN_CHARS or re.search(r"[^\W_]", line) is not None


def brute_force(rows, allowed):
    """id -> text without repeated lines, with edits by the shorter line's length; every pair of lines is looked at."""
    lines = {}
    for i, text in sorted(rows):
        for line in (text or "").split("\n"):
            if counts(line):
                lines.setdefault(line, i)
    groups, long = Groups(lines), sorted((x for x in lines if len(x) >= NEAR_FROM), key=len)
    for at, a in enumerate(long):
        for b in long[at + 1:]:
            if len(b) - len(a) > allowed(len(a)):
                break
            if groups.find(a) != groups.find(b) and edits(a, b) <= allowed(len(a)):
                groups.join(a, b)
    first = {}
    for line, i in lines.items():
        root = groups.find(line)
        first[root] = min(first.get(root, i), i)
    out = {}
    for i, text in rows:
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            root = groups.find(line) if line in lines else None
            if root is not None and (first[root] != i or root in seen):
                continue
            seen.add(root)
            kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def prose(n):
    return "".join(RNG.choice("abcdefgh é") for _ in range(n - 1)) + "z"


def test_short_lines_are_copies(spark, tmp_path):
    rows = [(1, "Share this page\n\n----\nOf.\nI am here\nShare this page"), (2, "Of.\n----\n\nShare thispage\nI am hers\né"),
            (3, "é\nOf.\n***\n7"), (4, "7\n***\nI am here"), (5, None), (6, "")]
    want = {1: "Share this page\n\n----\nOf.\nI am here", 2: "----\n\nI am hers\né", 3: "***\n7", 4: "***", 5: None, 6: ""}
    got = dedupe_lines(documents(spark, rows), near_from=NEAR_FROM).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want == brute_force(rows, lambda n: EDITS)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    dropped = {r["doc_id"]: r["n_dropped"] for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert dropped == {1: 1, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0}


def test_short_lines_as_brute_force(spark):
    base = [prose(RNG.randrange(2, 40)) for _ in range(50)]
    rows = [(i, "\n".join(line if RNG.random() < 0.5 else line[:-2] + RNG.choice("abz") for line in RNG.sample(base, 4))) for i in range(60)]
    got = dedupe_lines(documents(spark, rows), near_from=NEAR_FROM).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_force(rows, lambda n: EDITS)


def test_very_many_lines_in_one_text(spark):
    import time

    lines = [f"line {i} of a very long text" if i % 7 else "the same again and again" for i in range(50_000)]
    started = time.time()
    got = dedupe_lines(documents(spark, [(1, "\n".join(lines)), (2, "alone")]), edits=0, near_from=NEAR_FROM).filter("doc_id = 1").first()
    want = [line for i, line in enumerate(lines) if i % 7 or i == 0]
    assert got["text"] == "\n".join(want) and got["n_lines"] == 50_000 and got["n_dropped"] == 50_000 - len(want)
    assert time.time() - started < 60
