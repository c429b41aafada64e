import random

import pytest
from brute import contamination, documents

from topicmoments.llm.decontaminate import decontaminate

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x9"]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(words(n))) for i, n in enumerate([40, 13, 12, 5, 3, 1, 20, 20])]
ITEMS += [(8, ITEMS[0][1]), (9, None), (10, "..."), (11, ""), (None, " ".join(words(30))), (0, ITEMS[0][1])]
DOCS = [(0, None), (1, ""), (2, "-- !"), (3, ITEMS[0][1].upper()), (4, " ".join(words(300)) + ", " + ITEMS[1][1].replace(" ", " -- ") + "\n" + " ".join(words(10)))]
DOCS += [(5, " ".join(ITEMS[6][1].split()[:15])), (6, " ".join(words(200))), (7, " ".join(words(20000)) + ITEMS[7][1]), (8, ITEMS[12][1]), (9, " ".join(ITEMS[7][1].split()[:12]))]


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_as_brute_force(spark, block_bytes):
    docs = documents(spark, [*DOCS, DOCS[3], (None, ITEMS[0][1])])
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    want = contamination([*DOCS, (None, ITEMS[0][1])], ITEMS)
    rows = decontaminate(docs, items, block_bytes=block_bytes).collect()
    assert len(rows) == len(DOCS) + 2
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]
    by_id = {r["doc_id"]: r for r in rows}
    text = dict(DOCS)[4]
    if block_bytes > 400:
        assert any(text[s["start"]:s["end"]] == ITEMS[1][1].replace(" ", " -- ") for s in by_id[4]["spans"])


def test_empty_tables(spark):
    docs, items = documents(spark, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate(docs, items.limit(0)).collect())
    assert decontaminate(docs.limit(0), items).count() == 0
