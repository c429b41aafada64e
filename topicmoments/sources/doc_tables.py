"""Document-term tables `(doc_id, term_id, cnt)` in Parquet, libsvm lines and triples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicmoments.operators.terms import assign_doc_ids
from topicmoments.runtime import shuffle_partitions
from topicmoments.sources.text import _paths

DOCS_SCHEMA = "doc_id bigint, term_id int, cnt double"
# A saved table also says where each row's document stands: its range, and its place among the documents there.
SAVED_SCHEMA = f"{DOCS_SCHEMA}, range int, place bigint"
# The folder inside a saved table that lists its ranges with their numbers of documents; Spark's readers pass over it.
MANIFEST = "_documents"
MANIFEST_SCHEMA = "range int, n_docs bigint"


def write_docs(docs: DataFrame, path: str, doc_ids: DataFrame | None = None) -> None:
    """Write counts in the order of their documents, with a manifest of how many documents each range holds.

    Documents of `doc_ids` that have no count get a row without a term, so that they still count.
    """
    rows = docs.select("doc_id", "term_id", "cnt")
    if doc_ids is not None:
        bare = doc_ids.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = rows.unionByName(bare.select("doc_id", F.lit(None).cast("int").alias("term_id"), F.lit(0.0).alias("cnt")))
    spark = docs.sparkSession
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "term_id")
    sorted_rows.mapInArrow(_numbered, SAVED_SCHEMA).write.mode("errorifexists").parquet(path)
    ranges = spark.read.schema(SAVED_SCHEMA).parquet(path).groupBy("range").agg((F.max("place") + 1).alias("n_docs"))
    ranges.coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the documents of a task's sorted rows."""
    own, place, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        fresh = np.append(last is None or ids[0] != last, ids[1:] != ids[:-1])
        places = place + np.cumsum(fresh)
        place, last = int(places[-1]), ids[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), own, dtype=np.int32)), pa.array(places)],
                                         ["doc_id", "term_id", "cnt", "range", "place"])


def _table_of(file_path: Column, inner: str = "") -> Column:
    """The folder of a saved table, from the path of one of its files."""
    return F.regexp_extract(file_path, f"^(.*){inner}/[^/]+$", 1)


def saved_ranges(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The manifests of saved tables: `(input, saved, range, n_docs, before)`, `before` counting the documents of all
    tables and ranges that come first. A pattern may name several tables, and a table that is named twice is listed twice."""
    listed = [spark.read.schema(MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/{MANIFEST}")
              .select(F.lit(k).alias("input"), _table_of(F.col("_metadata.file_path"), f"/{MANIFEST}").alias("saved"), "range", "n_docs")
              for k, path in enumerate(_paths(paths))]
    # one row for each range of each table, so this window is small
    order = W.orderBy("input", "saved", "range").rowsBetween(W.unboundedPreceding, -1)
    return reduce(DataFrame.unionByName, listed).withColumn("before", F.coalesce(F.sum("n_docs").over(order), F.lit(0)))


def read_docs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The counts that `write_docs` wrote. A single table keeps its ids.

    Of several tables each document is one of its own, whatever its id: they are numbered from 0 in the order in which
    the tables are named, then by id. The manifests say how many come before each range, so rows only add two numbers.
    """
    listed = _paths(paths)
    ranges = saved_ranges(spark, listed)
    if len(listed) == 1 and ranges.select("saved").distinct().limit(2).count() <= 1:
        return spark.read.schema(DOCS_SCHEMA).parquet(*listed).filter("term_id is not null")
    rows = reduce(DataFrame.unionByName, [
        spark.read.schema(SAVED_SCHEMA).parquet(path)
        .select(F.lit(k).alias("input"), _table_of(F.col("_metadata.file_path")).alias("saved"), "range", "place", "term_id", "cnt")
        for k, path in enumerate(listed)]).filter("term_id is not null")
    # a row for each range, thousands at most
    placed = rows.join(F.broadcast(ranges.select("input", "saved", "range", "before")), ["input", "saved", "range"], "left")
    number = F.coalesce(F.col("before"), F.raise_error(F.lit("a saved table has no manifest")).cast("bigint")) + F.col("place")
    return placed.select(number.alias("doc_id"), "term_id", "cnt")


def count_docs(spark: SparkSession, paths: str | Sequence[str]) -> int:
    """The documents that `write_docs` wrote, those without a term included, as the manifests say."""
    return saved_ranges(spark, paths).agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]


def read_dok(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines `doc term count`, separated by spaces, numbered from 0."""
    return spark.read.schema(DOCS_SCHEMA).csv(_paths(paths), sep=" ")


def read_libsvm_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines `label index:value ...` as `(doc_id, label, entries)`, blank lines and `#` lines skipped.

    Every line is a document, whatever its label; documents are numbered from 0 by file and place in
    it. Indices count from 1 in the file and from 0 in the entries `(term_id, cnt)`, and need not be
    sorted.
    """
    line = F.trim(F.translate("value", "\t\r", "  "))
    is_data = (line != "") & ~F.startswith(line, F.lit("#"))
    # skipped lines have no items, so that nothing in them is ever read as a number
    parts = F.when(is_data, F.filter(F.split(line, " "), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    items = (spark.read.text(_paths(paths))
             .select(parts.alias("items"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
             .filter(F.size("items") > 0))
    entry = F.transform(F.slice("items", F.lit(2), F.size("items")),
                        lambda x: F.struct((F.split_part(x, F.lit(":"), F.lit(1)).cast("int") - 1).alias("term_id"),
                                           F.split_part(x, F.lit(":"), F.lit(2)).cast("double").alias("cnt")))
    lines = items.select("path", "block", F.get("items", F.lit(0)).cast("double").alias("label"), entry.alias("entries"))
    return assign_doc_ids(lines, ["path", "block"]).select("doc_id", "label", "entries")


def read_libsvm(spark: SparkSession, paths: str | Sequence[str],
                vocab_size: int = -1) -> tuple[DataFrame, DataFrame, int, int]:
    """A libsvm corpus: documents, vocabulary, number of terms and number of documents.

    The number of terms is the largest index, unless given. Terms are named by their number.
    """
    lines = read_libsvm_lines(spark, paths)
    stats = lines.agg(F.count("*").alias("n_docs"),
                      F.max(F.array_max(F.transform("entries", lambda e: e["term_id"]))).alias("top")).first()
    size = vocab_size if vocab_size > 0 else (stats["top"] if stats["top"] is not None else -1) + 1
    if stats["top"] is not None and stats["top"] >= size:
        raise ValueError(f"term index {stats['top'] + 1} exceeds the vocabulary of {size} terms")
    docs = lines.select("doc_id", F.inline("entries"))
    vocab = spark.range(size).select(F.col("id").cast("int").alias("term_id"), F.col("id").cast("string").alias("term"))
    return docs, vocab, size, stats["n_docs"]


def write_libsvm(docs: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Documents as libsvm lines, indices from 1 and sorted; a line has one entry per distinct term.

    The label is the document's id, or that of `labels` `(doc_id, label)`, whose documents are all
    written, also those without a term.
    """
    entry = F.concat_ws(":", (F.col("term_id") + 1).cast("string"), F.col("cnt").cast("string"))
    grouped = (docs.groupBy("doc_id")
               .agg(F.sort_array(F.collect_list(F.struct("term_id", entry.alias("entry")))).alias("entries")))
    if labels is None:
        grouped = grouped.withColumn("label", F.col("doc_id"))
    else:
        grouped = labels.select("doc_id", "label").join(grouped, "doc_id", "left")
    items = F.transform(F.coalesce("entries", F.array().cast(grouped.schema["entries"].dataType)), lambda e: e["entry"])
    lines = grouped.select(F.array_join(F.concat(F.array(F.col("label").cast("string")), items), " ").alias("value"))
    lines.write.mode("errorifexists").text(path)


def write_dok(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "term_id", "cnt").write.mode("errorifexists").csv(path, sep=" ")
