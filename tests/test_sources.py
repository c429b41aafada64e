import glob
import json

import pytest

import twins
from topicmoments import JobConfig, run_job
from topicmoments.sources import doc_tables, models, stopwords, text


def test_libsvm_lines(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("# a comment\n\n  7.0 1:2 4:0.5 \n8 3:1  2:6\n   \n9\n#9 1:1\n")
    docs, vocab, size, n_docs = doc_tables.read_libsvm(spark, str(path))
    assert {(r["doc_id"], r["term_id"]): r["cnt"] for r in docs.collect()} == {
        (0, 0): 2.0, (0, 3): 0.5, (1, 2): 1.0, (1, 1): 6.0}
    assert [(r["doc_id"], r["label"], len(r["entries"])) for r in doc_tables.read_libsvm_lines(spark, str(path)).orderBy("doc_id").collect()] == [
        (0, 7.0, 2), (1, 8.0, 2), (2, 9.0, 0)]
    assert (size, n_docs) == (4, 3)
    assert [(r["term_id"], r["term"]) for r in vocab.orderBy("term_id").collect()] == [(t, str(t)) for t in range(4)]
    assert doc_tables.read_libsvm(spark, str(path), 10)[2] == 10
    with pytest.raises(ValueError, match="exceeds"):
        doc_tables.read_libsvm(spark, str(path), 2)


def test_docs_round_trips(spark, tmp_path):
    rows = [(5, 0, 1.0), (5, 9, 2.5), (6, 3, 4.0)]
    docs = spark.createDataFrame(rows, twins.SCHEMA)
    doc_tables.write_docs(docs, f"{tmp_path}/a.parquet")
    doc_tables.write_dok(docs, f"{tmp_path}/a.dok")
    doc_tables.write_libsvm(docs, f"{tmp_path}/a.libsvm")
    assert sorted(map(tuple, doc_tables.read_docs(spark, f"{tmp_path}/*.parquet").collect())) == rows
    assert sorted(map(tuple, doc_tables.read_dok(spark, f"{tmp_path}/a.dok").collect())) == rows
    assert sorted((int(r["label"]), e["term_id"], e["cnt"]) for r in doc_tables.read_libsvm_lines(spark, f"{tmp_path}/a.libsvm").collect()
                  for e in r["entries"]) == rows


def test_every_line_and_file_is_a_document(spark, tmp_path):
    (tmp_path / "a.libsvm").write_text("1 1:2\n0 2:1\n1 1:5\n0\n")
    (tmp_path / "b.libsvm").write_text("1 1:1\n")
    paths = [f"{tmp_path}/a.libsvm", f"{tmp_path}/b.libsvm", f"{tmp_path}/b.libsvm"]
    docs, _vocab, _size, n_docs = doc_tables.read_libsvm(spark, paths)
    assert n_docs == 6 and sorted(map(tuple, docs.collect())) == [(0, 0, 2.0), (1, 1, 1.0), (2, 0, 5.0), (4, 0, 1.0), (5, 0, 1.0)]
    (tmp_path / "texts").mkdir()
    for n in "ab":
        (tmp_path / "texts" / f"{n}.txt").write_text(n)
    rows = text.read_text_corpus(spark, [f"{tmp_path}/texts", f"{tmp_path}/texts/a.txt"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(0, "a"), (1, "a"), (2, "b")]


def test_documents_without_a_term_survive_saving(spark, tmp_path):
    ids = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    docs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (2, 0, 1.0)], twins.SCHEMA)
    doc_tables.write_docs(docs, f"{tmp_path}/d.parquet", ids)
    assert sorted(map(tuple, doc_tables.read_docs(spark, f"{tmp_path}/d.parquet").collect())) == [(0, 0, 1.0), (0, 1, 2.0), (2, 0, 1.0)]
    assert doc_tables.count_docs(spark, f"{tmp_path}/d.parquet") == 4
    doc_tables.write_libsvm(docs, f"{tmp_path}/d.libsvm", ids.selectExpr("doc_id", "doc_id % 2 as label"))
    assert doc_tables.read_libsvm(spark, f"{tmp_path}/d.libsvm")[3] == 4


def test_several_saved_tables_keep_all_their_documents(spark, tmp_path):
    one = spark.createDataFrame([(7, 0, 1.0), (-3, 1, 2.0), (9, 2, 3.0)], twins.SCHEMA)
    two = spark.createDataFrame([(9, 0, 4.0), (9, 5, 4.5), (2**62, 1, 5.0)], twins.SCHEMA)
    a, b = f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"
    doc_tables.write_docs(one, a, spark.createDataFrame([(8,), (9,)], "doc_id long"))
    doc_tables.write_docs(two, b)
    first = [(0, 1, 2.0), (1, 0, 1.0), (3, 2, 3.0)]
    second = [(0, 0, 4.0), (0, 5, 4.5), (1, 1, 5.0)]

    def moved(rows, by):
        return [(d + by, t, c) for d, t, c in rows]

    for paths, want, n in (([a, b], first + moved(second, 4), 6), (f"{b},{a}", second + moved(first, 2), 6), ([b, b], second + moved(second, 2), 4),
                           (f"{tmp_path}/*.parquet", first + moved(second, 4), 6)):
        assert sorted(map(tuple, doc_tables.read_docs(spark, paths).collect())) == sorted(want)
        assert doc_tables.count_docs(spark, paths) == n
    assert {r["doc_id"] for r in doc_tables.read_docs(spark, a).collect()} == {7, -3, 9}
    one.write.parquet(f"{tmp_path}/plain")
    with pytest.raises(Exception, match="_documents|manifest"):
        doc_tables.read_docs(spark, [a, f"{tmp_path}/plain"]).collect()
    assert "Exchange hashpartitioning" not in doc_tables.read_docs(spark, [a, b])._jdf.queryExecution().executedPlan().toString()
    doc_tables.write_docs(one.limit(0), f"{tmp_path}/none")
    assert doc_tables.count_docs(spark, [f"{tmp_path}/none", a]) == 4


def test_text_files_and_compaction(spark, tmp_path):
    for folder, names in (("one", "ba"), ("two", "c")):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.txt").write_text(f"{n} first line\nsecond line")
    paths = f"{tmp_path}/one,{tmp_path}/two"
    rows = text.read_text_corpus(spark, paths).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 1, 2]
    assert [r["text"][0] for r in rows] == ["a", "b", "c"] and rows[0]["text"].endswith("\nsecond line")
    text.compact_small_files(spark, paths, f"{tmp_path}/all.parquet", n_files=1)
    assert len(glob.glob(f"{tmp_path}/all.parquet/part-*")) == 1
    again = text.read_text_corpus(spark, f"{tmp_path}/*.parquet", compacted=True).orderBy("doc_id").collect()
    assert again == rows


def test_stopword_lists(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("the of\n   |and\tthe\n\nzu\n")
    assert {r["term"] for r in stopwords.read_stopwords(spark, str(path)).collect()} == {"the", "of", "and", "zu"}
    assert stopwords.read_stopwords(spark, "").count() == 0
    assert len(stopwords.ENGLISH) == len(set(stopwords.ENGLISH)) == 174


def test_model_files(spark, tmp_path):
    words = spark.createDataFrame([(0, 0, 0.75), (0, 1, 0.25), (1, 1, 1.0)], "topic int, term_id int, p double")
    models.write_model(words, [3.0, 1.0], 8.0, str(tmp_path))
    lines = [line for f in sorted(glob.glob(f"{tmp_path}/TD_beta_k2.txt/part-*")) for line in open(f).read().splitlines()]
    assert [list(map(float, line.split(" "))) for line in lines] == [[0.75, 0.0], [0.25, 1.0]]
    alpha = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/alpha_k2.txt/part-*"))
    assert [float(a) for a in alpha.split()] == [6.0, 2.0]
    assert models.read_topic_word(spark, f"{tmp_path}/topic_word_k2.parquet").count() == 3


@pytest.fixture
def text_files(tmp_path):
    import numpy as np

    folder = tmp_path / "texts"
    folder.mkdir()
    rng = np.random.default_rng(1)
    vocab = ["red", "green", "blue", "one", "two", "three"]
    for d in range(60):
        half = d % 2
        p = np.full(6, 0.05)
        p[3 * half:3 * half + 3] = 0.85 / 3
        (folder / f"{d:03d}.txt").write_text(" the ".join(rng.choice(vocab, 40, p=p / p.sum())))
    return str(folder)


def test_job_on_text_libsvm_and_tables(spark, text_files, tmp_path):
    out = str(tmp_path / "out")
    cfg = JobConfig(k=2, alpha0=0.5, inputs=(text_files,), output_dir=out, input_type="text", vocab_size=6, min_words=5)
    corpus, model = run_job(spark, cfg)
    assert corpus.vocab_size == 6 and "the" not in {r["term"] for r in corpus.vocab.collect()}
    assert sum(r["p"] for r in model.topic_word.collect()) == pytest.approx(2.0)
    top = {r["topic"]: set() for r in model.topic_word.collect()}
    names = {r["term_id"]: r["term"] for r in corpus.vocab.collect()}
    for r in model.topic_word.collect():
        if r["p"] > 0.15:
            top[r["topic"]].add(names[r["term_id"]])
    assert sorted(map(sorted, top.values())) == [["blue", "green", "red"], ["one", "three", "two"]]
    figures = json.loads("".join(open(f).read() for f in glob.glob(f"{out}/TD_runningTime_k2.json/part-*")))
    assert figures["n_docs"] == 60 and figures["total_seconds"] >= figures["fit_seconds"] > 0

    doc_tables.write_docs(corpus.docs, f"{out}/docs.parquet")
    doc_tables.write_libsvm(corpus.docs, f"{out}/docs.libsvm")
    for kind, path in (("docs", f"{out}/docs.parquet"), ("libsvm", f"{out}/docs.libsvm")):
        again = run_job(spark, JobConfig(k=2, alpha0=0.5, inputs=(path,), output_dir=f"{out}/{kind}", input_type=kind))[1]
        assert again.alpha == pytest.approx(model.alpha, rel=1e-6)


@pytest.mark.parametrize("bad", [{"inputs": ()}, {"output_dir": ""}, {"input_type": "obj"}, {"vocab_size": 0}, {"k": 0}])
def test_job_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        JobConfig(**{"k": 2, "alpha0": 1.0, "inputs": ("x",), "output_dir": "y", **bad})
