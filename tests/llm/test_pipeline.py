import duckdb
import public_tokenizers
from brute import contamination, dedupe_lines, near_duplicates, sha
from tokenizers import Tokenizer

import corpus_pipeline
from topicmoments.llm.lines import NEAR_FROM
from topicmoments.llm.toxicity import Scorer, learn, scores

FOLDER = "/root/testdata/sf0.001"


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    if model is not None:
        scorer = Scorer(model.toxic, model.ordinary)
        rows = [(i, t) for i, t in rows if scores(scorer, model, [t])[0] < 0.3]
    texts = dedupe_lines(rows, near_from=NEAR_FROM)
    components = near_duplicates(list(texts.items()), 5, 80)
    rows = [(i, t) for i, t in texts.items() if components[i][1] == i]
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    judged = contamination(rows, items)
    rows = [(i, t) for i, t in rows if not judged[i][3]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["ids"] == want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == sha(dict(rows)[r["doc_id"]] or "")


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2), (1, "a b", "x", 2), (None, None, None, None), (3, "", "y", 0)], "doc_id long, text string, score string, n_words long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "tokens":
            assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
