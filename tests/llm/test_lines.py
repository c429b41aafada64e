import random

from brute import dedupe_lines as brute_force
from brute import documents, edits
from pyspark.sql import functions as F

from topicmoments.llm.lines import dedupe_lines, line_table, segment_probes, within_edits

RNG = random.Random(11)


def edited(text, k, letters="abcdefgh é"):
    chars = list(text)
    for _ in range(k):
        kind, at = RNG.randrange(3), RNG.randrange(len(chars) + 1)
        if kind == 0:
            chars.insert(at, RNG.choice(letters))
        elif chars:
            at = min(at, len(chars) - 1)
            chars[at:at + 1] = [] if kind == 1 else [RNG.choice(letters)]
    return "".join(chars)


def line(n):
    return "".join(RNG.choice("abcdefgh é") for _ in range(n)).replace("\n", " ")


def test_banded_distance_as_the_full_one(spark):
    pairs = [(a, edited(a, RNG.randrange(5), "ab")) for a in ("".join(RNG.choice("ab") for _ in range(RNG.randrange(0, 14))) for _ in range(1500))]
    pairs += [(a, edited(a, RNG.randrange(5))) for a in (line(RNG.randrange(20, 90)) for _ in range(200))]
    for most in (1, 2, 3):
        for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", within_edits(F.col("a"), F.col("b"), most).alias("near")).collect():
            assert r["near"] == (edits(r["a"], r["b"]) <= most), r


def test_probes_find_a_segment_of_every_near_pair():
    def segments(n, parts):
        base, longer = divmod(n, parts)
        return [(i * base + max(0, i - (parts - longer)), base + (i >= parts - longer)) for i in range(parts)]

    for most in (1, 2, 3):
        for _ in range(1500):
            a = "".join(RNG.choice("ab") for _ in range(RNG.randrange(most + 1, 24)))
            b = edited(a, most, "ab")
            a, b = sorted((a, b), key=len)
            if len(a) > most and edits(a, b) <= most:
                cut = segments(len(a), most + 1)
                assert any(a[cut[i - 1][0]:sum(cut[i - 1])] == b[cut[i - 1][0] + s:sum(cut[i - 1]) + s]
                           for i, d, s in segment_probes(most) if d == len(b) - len(a)), (a, b)


def corpus():
    base = [line(RNG.randrange(20, 120)) for _ in range(60)]
    template = line(60)
    rows = []
    for i in range(120):
        own = [edited(RNG.choice(base), RNG.choice((0, 0, 1, 2, 4))) for _ in range(RNG.randrange(0, 6))]
        if i % 3 == 0:
            own.append(template + str(i))
        if i % 10 == 0:
            own += own[:2]
        rows.append((i, "\n".join(own)))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (503, base[0] * 400), (504, base[0] * 400 + "x")]


def test_as_brute_force(spark):
    rows = corpus()
    want = brute_force(rows)
    got = dedupe_lines(documents(spark, [*rows, rows[3], (None, rows[3][1])])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = dict(rows)[3] if r["doc_id"] is None else want[r["doc_id"]]
        assert r["text"] == text
        whole = dict(rows).get(r["doc_id"])
        if whole is not None:
            assert r["n_lines"] == len(whole.split("\n")) and (r["n_dropped"] > 0) == (text != whole) and r["n_near"] <= r["n_dropped"]
            assert all(i <= r["doc_id"] for i in r["kept_in"])
    assert dedupe_lines(documents(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dedupe_lines(documents(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_are_keyed_once_by_characters_not_bytes(spark):
    """The written table has every line's keys; a line within two edits shares one, whatever bytes its characters take."""
    table = [("é" * 5 + "𝄞" + line(20), line(12)) for _ in range(40)]
    rows = [(2 * i, a + b) for i, (a, b) in enumerate(table)] + [(2 * i + 1, edited(a + b, 2, "ab𝄞é")) for i, (a, b) in enumerate(table)]
    rows.append((900, "no key"))
    found = {r["id"]: r for r in line_table(documents(spark, rows), "doc_id", "text", 2, 32, 10).collect()}
    assert set(found) == {i for i, _ in rows} and found[900]["keys"] is None
    for i in range(len(table)):
        a, b = found[2 * i], found[2 * i + 1]
        assert len(a["keys"]) == len(segment_probes(2)) and set(a["keys"]) & set(b["keys"]), rows[2 * i]
