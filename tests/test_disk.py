import glob

import numpy as np
import pytest

import twins
from topicmoments.operators import moments
from topicmoments.plans import fit, job
from topicmoments.runtime import checkpoint_root, let_go


def tables(spark, name):
    return set(glob.glob(f"{checkpoint_root(spark).removeprefix('file://').removeprefix('file:')}/*/{name}/*.parquet"))


@pytest.fixture(scope="module")
def counted(spark):
    draw = np.random.default_rng(9)
    rows = []
    for doc in range(120):
        own = draw.choice(30, size=draw.integers(4, 12), replace=False)
        rows += [(doc, int(t), float(draw.integers(1, 5))) for t in own]
    return spark.createDataFrame(rows, "doc_id long, term_id int, cnt double").cache()


@pytest.fixture
def nothing_broadcast(spark):
    spark.conf.set("topicmoments.broadcast.maxBytes", "1")
    yield
    spark.conf.unset("topicmoments.broadcast.maxBytes")


def test_passes_leave_no_matrices_behind(spark, counted, nothing_broadcast):
    docs = fit.prepare(counted)
    valid = docs.filter("len >= 3")
    table = fit.with_layout(valid, fit.term_table(docs), 4)
    before = tables(spark, "topicmoments_*")
    vectors, values = moments.top_eigen(valid, table, 30, 2, 2.5)
    white = moments.whitening_matrix(vectors, values)
    moments.whitened_third_moment(valid, white, table, 2.5)
    assert tables(spark, "topicmoments_*") == before and not table.layout.passed
    # the documents by term are still there, and the vectors do not hang on what was deleted
    assert vectors.count() == 30 and moments.project_docs(valid, vectors, table).count() == 120
    docs.unpersist()


def test_closed_layouts_leave_no_documents_by_term_behind(spark, counted, nothing_broadcast):
    docs = fit.prepare(counted)
    before, common = tables(spark, "topicmoments_*"), tables(spark, "common-terms")
    table = fit.with_layout(docs, fit.term_table(docs), 4)
    assert tables(spark, "topicmoments_*") > before and tables(spark, "common-terms") > common
    table.layout.close()
    assert tables(spark, "topicmoments_*") == before and tables(spark, "common-terms") == common
    docs.unpersist()


def test_lanczos_steps_leave_no_basis_behind(spark):
    counts = np.random.default_rng(9).integers(1, 6, size=(40, 5)).astype(float)
    docs, table = twins.prepared(spark, counts)
    names = ("basis", "image", "moment")
    before = [tables(spark, n) for n in names]
    vectors, values = moments.top_eigen_exact(docs, table, 5, 2, 35.0)
    assert [tables(spark, n) for n in names] == before
    known = np.linalg.eigvalsh(twins.second_moment(counts, 35.0))[::-1][:2]
    assert vectors.count() == 5 and np.allclose(values, known, rtol=1e-8)


def test_counted_words_go_once_documents_are_written(spark, nothing_broadcast, monkeypatch):
    gone = []
    monkeypatch.setattr(job, "let_go", lambda *tables: (gone.extend(t.columns for t in tables), let_go(*tables)))
    texts = spark.createDataFrame([(i, f"alpha beta{chr(97 + i % 20)} gamma{chr(97 + i % 7)}") for i in range(40)], "doc_id long, text string")
    made = job.corpus_from_texts(texts)
    files = made.docs.inputFiles()
    assert gone == [["doc_id", "term", "cnt"]] and files and not any("rdd-" in f for f in files) and made.docs.count() == 120
