import random

import pytest
import regex
from pyspark.sql import functions as F

import twins
from topicmoments import runtime
from topicmoments.functions.words import PIECE, PIECE_FIRST, pieces, words
from topicmoments.operators import terms, weights
from topicmoments.plans import job
from topicmoments.plans.job import corpus_from_texts

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def jdk_words(spark, text):
    """The same words from the JDK's word breaker."""
    breaker = spark._jvm.java.text.BreakIterator.getWordInstance()
    breaker.setText(text)
    units = text.encode("utf-16-le")
    found, start, end = [], breaker.first(), breaker.next()
    while end != -1:
        word = units[2 * start:2 * end].decode("utf-16-le", "replace").lower()
        if regex.fullmatch(r"\p{L}*", word) and len(word.encode("utf-16-le")) // 2 >= 3:
            found.append(word)
        start, end = end, breaker.next()
    return found


def spark_words(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["w"] for r in frame.select("doc_id", words(F.col("text")).alias("w")).orderBy("doc_id").collect()]


@pytest.mark.parametrize("text, expect", [
    ("don't stop", ["stop"]), ("state-of-the-art", []), ("foo_bar baz", ["baz"]), ("1.abc def", ["abc", "def"]),
    ("abc1.def", ["def"]), ("1abc.def", []), ("foo-bar1-baz", ["baz"]), ("foo*bar", ["foo", "bar"]),
    ("foo–bar", []), ("ÉTÉ", ["été"]), ("'foo'", ["foo"]), ("www.foo.com", []), ("it’s here", ["here"]),
    ("", []), ("ab abc", ["abc"]), ("caf́e word", ["word"]), ("漢字仮 カタカナ", ["漢字仮", "カタカナ"]),
    ("𝐀𝐁 x", ["𝐀𝐁"])])
def test_words_of_a_text(spark, text, expect):
    assert spark_words(spark, [text]) == [expect]


def test_words_agree_with_the_jdk_on_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(DOCUMENTS).select("text").collect() if len(r["text"]) <= 8000]
    ours = spark_words(spark, texts)
    assert sum(map(len, ours)) > 10_000
    assert ours == [jdk_words(spark, t) for t in texts]


def test_words_agree_with_the_jdk_on_mixed_scripts(spark):
    rng = random.Random(5)
    alphabet = "abcdé" * 6 + "12٣__..''\"\"--–’­‿ \n,;$€%#" + "́⃝‍​漢字々かなカナー・한글ไทยहाः।عربⅧ²𝐀𠀀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 12))) for _ in range(1500)]
    ours = spark_words(spark, texts)
    assert [t for t, w in zip(texts, ours) if w != jdk_words(spark, t)] == []


def test_pieces_keep_joined_words_whole(spark):
    frame = spark.createDataFrame([("a-b c_d 1.5x",)], "text string").select(pieces(F.col("text")).alias("p"))
    assert frame.first()["p"] == ["a-b", "c_d", "1.5x"]


def test_vocabulary_breaks_ties_by_term_and_numbers_from_zero(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "term string, n bigint")
    for size in (-1, 3, 10):
        rows = [(r["term_id"], r["term"]) for r in terms.vocab_topk(counts, size).orderBy("term_id").collect()]
        assert rows == [(0, "c"), (1, "a"), (2, "b"), (3, "d")][:4 if size != 3 else 3]


def test_a_large_vocabulary_is_numbered_alike(spark, monkeypatch):
    counts = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"), (F.col("id") % 7).alias("n"))
    one = terms.vocab_topk(counts, 1000).orderBy("term_id").collect()
    monkeypatch.setattr(terms, "ONE_TASK_VOCAB", 0)
    assert terms.vocab_topk(counts, 1000).orderBy("term_id").collect() == one


def test_documents_are_numbered_in_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("key"), F.col("id").cast("string").alias("text"))
    rows = terms.assign_doc_ids(frame, ["key"]).orderBy("key").collect()
    assert [r["doc_id"] for r in rows] == list(range(1000))


def test_a_hot_key_joins_whole_when_it_is_split(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("k"))
    table = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("x"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = runtime.hot_keys(counts, "k", "n", 8)
    assert [(r["k"], r["copies"]) for r in hot.collect()] == [(0, 3)]
    joined = runtime.salted_join(rows, table, "k", F.col("id"), hot)
    assert sorted(map(tuple, joined.select("id", "k", "x").collect())) == sorted(
        map(tuple, rows.join(table, "k").select("id", "k", "x").collect()))


def test_counts_are_alike_without_broadcast(spark):
    texts = spark.read.parquet(DOCUMENTS)
    words_ = terms.tokenize(texts)
    vocab = terms.vocab_topk(terms.word_count(words_), 300)
    small = sorted(map(tuple, terms.doc_term(words_, vocab).collect()))
    spark.conf.set(runtime.BROADCAST_CONF, "0")
    try:
        assert sorted(map(tuple, terms.doc_term(words_, vocab).collect())) == small
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)


IDF_CORPUS = [(1000, 2, 7.0), (1001, 1, 3.0), (1001, 2, 5.0), (1002, 0, 1.0), (1002, 1, 3.0), (1002, 2, 0.5)]


def test_idf_is_the_plain_ratio(spark):
    docs = spark.createDataFrame(IDF_CORPUS, twins.SCHEMA)
    got = {r["term_id"]: r["idf"] for r in weights.idf(docs, 4).collect()}
    assert [got[t] for t in range(3)] == pytest.approx([3.0, 1.5, 1.0], abs=1e-8) and got[3] == float("inf")
    assert weights.idf(docs, 3, n_docs=6).orderBy("term_id").first()["idf"] == 6.0


def test_idf_filter_zeroes_frequent_terms(spark):
    docs = spark.createDataFrame(IDF_CORPUS, twins.SCHEMA)
    got = {(r["doc_id"], r["term_id"]): r["cnt"] for r in weights.filter_idf(docs, 3, 1.5).collect()}
    assert got == {(d, t): (0.0 if t == 2 else c) for d, t, c in IDF_CORPUS}
    assert weights.filter_idf(docs, 3, 1.0) is docs
    spark.conf.set(runtime.BROADCAST_CONF, "0")
    try:
        assert {(r["doc_id"], r["term_id"]): r["cnt"] for r in weights.filter_idf(docs, 3, 1.5).collect()} == got
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)


def test_stopwords_of_any_number(spark):
    frame = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (2, "aaa"), (2, "ccc")], "doc_id bigint, term string")
    stop = spark.createDataFrame([("aaa",), ("zzz",)], "term string")
    for limit in (10, 0):
        assert {r["term"] for r in terms.remove_stopwords(frame, stop, limit).collect()} == {"bbb", "ccc"}
    assert terms.remove_stopwords(frame, stop.limit(0)).count() == 4


def test_empty_texts_count_as_documents(spark):
    texts = spark.createDataFrame([(0, "alpha beta beta"), (1, ""), (2, "12 ab"), (3, "beta")], "doc_id bigint, text string")
    corpus = corpus_from_texts(texts)
    assert (corpus.n_docs, corpus.vocab_size) == (4, 2)
    assert {(r["doc_id"], r["term_id"]): r["cnt"] for r in corpus.docs.collect()} == {
        (0, 0): 2.0, (0, 1): 1.0, (3, 0): 1.0}
    kept = corpus.with_min_words(2)
    assert kept.n_docs is None and {r["doc_id"] for r in kept.docs.collect()} == {0}


def test_features_are_sparse_vectors(spark):
    docs = spark.createDataFrame([(1, 3, 2.0), (1, 0, 1.0), (2, 1, 4.0)], twins.SCHEMA)
    rows = {r["doc_id"]: r["features"] for r in terms.to_features(docs, 5).collect()}
    assert rows[1].size == 5 and list(rows[1].indices) == [0, 3] and list(rows[2].values) == [4.0]


def test_entries_of_vectors_are_never_written_out(spark):
    docs = spark.createDataFrame([(1, 3, 2.0), (1, 0, 1.0), (2, 2_000_000_000, 4.0)], twins.SCHEMA)
    found = terms.vector_entries(terms.to_features(docs, 2_000_000_001), "features")
    assert {r["doc_id"]: (r["size"], r["indices"], r["values"]) for r in found.collect()} == {
        1: (2_000_000_001, [0, 3], [1.0, 2.0]), 2: (2_000_000_001, [2_000_000_000], [4.0])}


def test_frequent_words_stay_with_their_documents_where_a_vocabulary_is_not_broadcast(spark):
    texts = spark.createDataFrame([(d, " ".join(["common", "usual"][: 1 + d % 2] + [f"rare{chr(97 + d % 26) * 3}"] * (1 + d % 3))) for d in range(60)]
                                  + [(None, "common lost")], "doc_id bigint, text string")
    whole = sorted(map(tuple, corpus_from_texts(texts).docs.collect()), key=str)
    spark.conf.set(runtime.BROADCAST_CONF, "700")
    try:
        docs = corpus_from_texts(texts).docs
        assert sorted(map(tuple, docs.collect()), key=str) == whole
        plan = terms.with_length(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert "Exchange" not in plan and "Join" not in plan  # numbered once, and placed by document


def test_texts_are_counted_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    texts = spark.createDataFrame([(d, "alpha beta gamma " * 10) for d in range(100)], "doc_id bigint, text string")
    monkeypatch.setattr(job, "PART_BYTES", 1000)
    corpus = corpus_from_texts(texts)
    assert corpus.docs.rdd.getNumPartitions() == 17 and corpus.n_docs == 100 and corpus.docs.count() == 300


def test_the_most_frequent_keys_by_number(spark):
    counts = spark.createDataFrame([(t, n) for t, n in enumerate([9, 5, 5, 2, 2, 2])], "term_id int, df bigint")
    found = lambda most: sorted(r["term_id"] for r in runtime.most_frequent(counts, "term_id", "df", most).collect())
    assert [found(m) for m in (0, 1, 2, 3, 5, 6)] == [[], [0], [0], [0, 1, 2], [0, 1, 2], [0, 1, 2, 3, 4, 5]]


def test_plain_words_first_give_the_pieces_of_the_whole_pattern(spark):
    """Letters before blanks and signs are cut without the long pattern, and as it cuts them, whatever stands beside them."""
    signs = ["a", "bé", "Zß", "×", "÷", " ", "\n", "\t", ",", ";", ".", "(", ")", "'", "-", "_", "7", "­", "‍", "́", "।", "・", "か", "語", "ж", "𝄞", "𐐀"]
    rng = random.Random(4)
    rows = [("".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))),) for _ in range(6000)] + [("",), (None,), ("abc",), ("abc.",), ("‍abc def",)]
    first, whole = pieces(F.col("text")), F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    found = spark.createDataFrame(rows, "text string").select("text", first.alias("first"), whole.alias("whole"), F.lit(PIECE_FIRST).alias("pattern"))
    assert found.filter(~F.col("first").eqNullSafe(F.col("whole"))).limit(3).collect() == []


def test_parts_of_a_corpus_are_not_joined_by_adaptive_execution(spark, monkeypatch):
    """More tasks than cores and fewer than shuffle partitions, which adaptive execution would join to parts of 64 MiB."""
    texts = spark.createDataFrame([(d, "alpha beta gamma " * 10) for d in range(100)], "doc_id bigint, text string")
    monkeypatch.setattr(job, "PART_BYTES", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = corpus_from_texts(texts).docs
        assert docs.rdd.getNumPartitions() == 17 and docs.count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_saved_counts_are_placed_in_parts_that_fit_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, 1.0) for d in range(60) for t in range(5)] + [(None, 1, 2.0), (3, 1, 1.0)], "doc_id bigint, term_id int, cnt double")
    assert job.placed(docs) is docs
    monkeypatch.setattr(job, "PART_ROWS", 10)
    found = job.placed(docs)
    assert found.rdd.getNumPartitions() == 31 and sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))
