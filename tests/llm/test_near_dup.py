import random

import numpy as np
import pyarrow as pa
from brute import documents, near_duplicates as brute_force, shingle_set
from pyspark.sql import functions as F

from topicmoments.llm import common
from topicmoments.llm.common import join_salted
from topicmoments.llm.components import components
from topicmoments.llm.near_dup import bands_for, min_max, near_duplicates, shingle_sets
from topicmoments.llm.words import NOT_BLANK, WordReader

RNG = random.Random(9)


def text(n):
    return [f"w{RNG.randrange(400)}" for _ in range(n)]


def changed(words, k):
    words = list(words)
    for _ in range(k):
        words[RNG.randrange(len(words))] = f"n{RNG.randrange(10**6)}"
    return words


def corpus():
    rows, base = [], [text(RNG.randrange(40, 200)) for _ in range(40)]
    for words in base:
        rows.append(" ".join(words))
        for k in (1, 1, 2, 3, 5, 9):
            rows.append(" ".join(changed(words, k)).upper())
    hot = text(150)
    rows += [" ".join(changed(hot, RNG.randrange(0, 12))) for _ in range(150)]
    rows += [" ".join(hot)] * 40 + ["", " \t", None, "one", "One", "two words", "two words", "日本 語 テキスト です"]
    RNG.shuffle(rows)
    return list(enumerate(rows))


def test_as_brute_force(spark):
    rows = corpus()
    for size, percent in ((3, 85), (5, 80)):
        want = brute_force(rows, size, percent)
        got = near_duplicates(documents(spark, [*rows, rows[0], (None, rows[1][1])]), size=size, percent=percent).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_min_and_max_agree_as_often_as_sets_overlap():
    a, b = text(3000), None
    b = a[:2000] + text(1000)
    values, counts = shingle_sets(WordReader(NOT_BLANK), pa.array([" ".join(a), " ".join(b)]), 3)
    signatures = min_max(values, counts, 500)
    x, y = shingle_set(" ".join(a), 3), shingle_set(" ".join(b), 3)
    similar = len(x & y) / len(x | y)
    for side in (0, 1):
        assert abs(np.mean(signatures[0, side::2] == signatures[1, side::2]) - similar) < 0.09
    assert counts.tolist() == [len(x), len(y)]


def test_bands_leave_hardly_a_link_out():
    for percent in (50, 80, 85):
        assert (1 - (percent / 100) ** 5) ** bands_for(percent) <= 1e-8


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300), (None, 4)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["root"] for r in components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, **{i: 5 for i in range(200, 260)}, 300: 300, 301: 300}
    assert components(frame.limit(0)).count() == 0


def test_salted_join_equals_the_broadcast_one(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 30).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k != 7").withColumn("v", F.col("k") * 2)
    ways = [sorted(map(tuple, join_salted(rows, table, ["k"], "n", F.col("id"), 100, limit).select("id", "k", "v").collect()), key=str) for limit in (0, 1 << 20)]
    assert ways[0] == ways[1] and len(ways[0]) == 2000


def test_tasks_give_back_memory_after_each_batch(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(len(seen))

    seen = []

    def run(batches):
        for batch in batches:
            seen.append(batch)
            yield batch

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.giving_back(run)(iter([1, 2, 3]))) == [1, 2, 3]
    assert given == [1, 2, 3, 3]
    given.clear()
    closed = common.giving_back(run)(iter([1, 2]))
    next(closed)
    closed.close()  # as a task that is ended early
    assert given
