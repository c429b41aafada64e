import random
import zlib

from brute import documents

from topicmoments.llm import toxicity
from topicmoments.llm.toxicity import Scorer, fit, learn, score_toxicity, scores

RNG = random.Random(2)
WORDS = ["".join(RNG.choice(("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti")) for _ in range(RNG.randrange(1, 4))) for _ in range(400)]
BAD = ["zwyxgroff", "qvarkul", "wexxjip", "jofqumph"]


def text(toxic):
    words = [RNG.choice(WORDS) for _ in range(RNG.randrange(30, 80))]
    for _ in range(RNG.randrange(1, 4) if toxic else 0):
        words.insert(RNG.randrange(len(words)), RNG.choice(BAD))
    return " ".join(words)


ROWS = [(i, text(i % 7 == 0)) for i in range(1400)]
LABELS = [(i, int(i % 7 == 0)) for i, _ in ROWS if i % 5]


def test_held_out_rows_are_told_apart(spark):
    extra = [(5000, None), (5001, ""), (5002, BAD[0]), (None, BAD[1] + " " + text(True)), ROWS[7], (5003, text(False) * 300)]
    docs = documents(spark, [*ROWS, *extra])
    labels = spark.createDataFrame([*LABELS, (None, 1), (3, None), (4, 0), (9999, 1)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) + len(extra)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 5000]
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in own if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held)
    assert right >= 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5002]["predicted"] == 1 and not any(by_id[i]["predicted"] for i in (5000, 5001, 5003))
    assert by_id[5000]["score"] == by_id[5001]["score"]
    # the operator's scores are those of the model on one text at a time
    model = learn(docs, labels)
    scorer = Scorer(model.toxic, model.ordinary)
    for i, t in ROWS[:50]:
        assert abs(scores(scorer, model, [t])[0] - by_id[i]["score"]) < 1e-12


def test_held_out_labels_are_not_read(spark):
    docs = documents(spark, ROWS[:600])
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in LABELS]
    one, other = (score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (LABELS, turned))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_without_labels_or_rows(spark):
    docs, labels = documents(spark, ROWS[:20]), spark.createDataFrame(LABELS, "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert fit(["a b"], []) is None and fit([None, ""], ["a"]) is None


def test_repeated_words_are_one_object_among_the_samples(monkeypatch):
    """The driver holds a word that the dictionaries are trained on once, however often it counts."""
    seen, own = [], toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda size, samples: seen.append(samples) or own(size, samples))
    assert fit([t for i, t in ROWS[:700] if i % 7 == 0], [t for i, t in ROWS[:700] if i % 7]) is not None
    for samples in seen:
        assert len({id(s) for s in samples}) == len(set(samples)) < len(samples)
