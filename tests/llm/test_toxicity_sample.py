from brute import documents
from pyspark.sql import functions as F
from test_toxicity import LABELS, ROWS

from topicmoments.llm import toxicity
from topicmoments.llm.toxicity import fit, held_out, learn


def test_a_text_that_does_not_fit_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 300_000)
    labels = spark.createDataFrame(LABELS, "doc_id long, toxic int")
    first = labels.filter("toxic = 1").filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    rows = [(i, "é" * 160_000 if i == first else t) for i, t in ROWS]  # fewer characters than the bound, but more bytes
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary: seen.update(toxic=toxic, ordinary=ordinary))
    learn(documents(spark, rows), labels)
    known = {r["doc_id"] for r in labels.filter("toxic = 1").filter(~held_out(F.col("doc_id"))).collect()}
    assert sorted(seen["toxic"]) == sorted(t for i, t in ROWS if i in known and i != first)
    assert seen["ordinary"]


def test_ordinary_words_are_cut_at_random(monkeypatch):
    monkeypatch.setattr(toxicity, "PLAIN_WORDS", 300)
    given, train = [], toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda size, samples: given.append(list(samples)) or train(size, samples))
    labelled = dict(LABELS)
    fit([t for i, t in ROWS if labelled.get(i) == 1], [t for i, t in ROWS if labelled.get(i) == 0])
    words = sorted({w for i, t in ROWS if labelled.get(i) == 0 for w in t.split()})
    assert len(given[0]) == 300
    late = {toxicity.spelled(w.encode()) for w in words[len(words) // 2:]}
    assert sum(s in late for s in given[0]) > 60
