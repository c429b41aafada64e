import random

import numpy as np
import pytest
from brute import documents, near_duplicates as brute_force

from topicmoments.llm import ngram_join as module
from topicmoments.llm.ngram_join import extended_prefixes, links_of, ngram_join, ordered, spare, whole_sets

RNG = random.Random(13)


def words(n, of=500):
    return [f"w{RNG.randrange(of)}" for _ in range(n)]


def changed(text, k):
    text = list(text)
    for _ in range(k):
        text[RNG.randrange(len(text))] = f"n{RNG.randrange(10**6)}"
    return text


def corpus():
    rows = []
    for _ in range(30):
        base = words(RNG.randrange(30, 200))
        rows += [" ".join(changed(base, k)) for k in (0, 1, 1, 2, 4, 8)]
        rows.append(" ".join(base[:int(len(base) * 0.85)]))
    hot = words(150)
    rows += [" ".join(changed(hot, RNG.randrange(0, 9))) for _ in range(120)] + [" ".join(hot).upper()] * 40
    template = words(120)
    rows += [" ".join(template + words(14, 10**6)) for _ in range(60)]  # much in common, none linked
    rows += ["", " \t", None, "one", "One", "two words", "two words", "日本 語 テキスト です", "a a a a a a a a", "a a a a a a"]
    RNG.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hubs", [2, 128])
def test_as_brute_force(spark, monkeypatch, hubs):
    monkeypatch.setattr(module, "HUBS", hubs)
    rows = corpus()
    want = brute_force(rows, 5, 80)
    got = ngram_join(documents(spark, [*rows, rows[0], rows[0], (None, rows[1][1])])).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert r["component_id"] is None if r["doc_id"] is None else (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join(documents(spark, rows).limit(0)).count() == 0


def test_other_sizes_and_a_very_long_text(spark):
    base = words(30_000, 10**5)
    rows = list(enumerate([" ".join(base), " ".join(changed(base, 300)), " ".join(changed(base, 4000)), " ".join(base[5000:])]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(documents(spark, rows), size=3, percent=85).collect()}
    assert got == brute_force(rows, 3, 85)


def test_linked_sets_share_prefixes():
    rng = np.random.default_rng(3)
    values, counts = [], []
    for _ in range(200):
        n = int(rng.integers(1, 60))
        common = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        own = np.unique(rng.integers(0, 2**63, n // 8 + 1, dtype=np.uint64))
        for x in (common, np.union1d(common, own)):
            values.append(x)
            counts.append(len(x))
    counts = np.array(counts)
    found, lengths = extended_prefixes(np.concatenate(values), counts, 80)
    prefixes = np.split(found, np.cumsum(lengths)[:-1])
    for k in range(0, len(counts), 2):
        a, b = values[k], values[k + 1]
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            shared = len(np.intersect1d(prefixes[k], prefixes[k + 1]))
            assert shared >= max(lengths[i] - spare(counts[i], 80) for i in (k, k + 1)) > 0


def test_a_template_with_different_rests_is_not_paired(spark):
    template = words(120)
    texts = spark.createDataFrame([(i, " ".join(template + words(40, 10**6))) for i in range(400)], "id long, text string")
    found = whole_sets(texts, 5).selectExpr("id as cid", "cast(size(shingles) as long) as n", "shingles")
    assert ordered(found, 80).count() == 0  # each one's own words fill its prefix
    # with fewer words of their own the place of the first shingle in common already says that no set is similar enough
    near = spark.createDataFrame([(i, " ".join(template + words(8, 10**6))) for i in range(300)], "id long, text string")
    found = whole_sets(near, 5).selectExpr("id as cid", "cast(size(shingles) as long) as n", "shingles")
    assert links_of(ordered(found, 80), found, 80).count() == 299
