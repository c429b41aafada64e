"""Documents written once by term, for passes with matrices that are too large to broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicmoments.runtime import cut, hot_keys, let_go, lies_at, most_frequent, shuffle_partitions, stored, work_path

# Rows of a bucket of documents, some 64 MiB of Parquet.
BUCKET_ROWS = 8_000_000


def bucketed(rows: DataFrame, key: str, buckets: int, placed: bool = False) -> DataFrame:
    """The rows as a table of the session whose files are dealt by the hash of a key, one file for each part.

    Two such tables with as many parts join on the key without a shuffle of either. Rows that lie together by the key
    already (`placed`) are written from where they are.
    """
    spark = rows.sparkSession
    name = f"topicmoments_{uuid.uuid4().hex}"
    path = work_path(spark, name)
    ((rows if placed else rows.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(name))
    return lies_at(spark.table(name), path)


@dataclass(frozen=True)
class TermLayout:
    """Documents `(doc_id, term_id, cnt, len)`: rows of the terms that most documents have, spread as they
    came, and all others in buckets by term. `hot` lists the former terms, `passed` the matrices that passes wrote."""

    common: DataFrame
    others: DataFrame
    hot: DataFrame
    buckets: int
    passed: list[DataFrame] = field(default_factory=list, compare=False)

    def join(self, mat: DataFrame, cols: Sequence[str]) -> DataFrame:
        """Each row with the matrix row of its term. Only the matrix is shuffled, once, when it is written in buckets."""
        own = mat.select("term_id", *cols)
        # fewer terms than shuffle partitions, or as many as the layout was given room for
        head = self.common.join(F.broadcast(own.join(F.broadcast(self.hot), "term_id", "left_semi")), "term_id")
        rarer = bucketed(own.join(F.broadcast(self.hot), "term_id", "left_anti"), "term_id", self.buckets)
        self.passed.append(rarer)
        tail = self.others.join(rarer.hint("shuffle_hash"), "term_id")
        return tail.select("doc_id", "term_id", "cnt", "len", *cols).unionByName(head.select("doc_id", "term_id", "cnt", "len", *cols))

    def spent(self, since: int = 0) -> list[DataFrame]:
        """The matrices of passes that are done, but for the first `since`, to be let go; they are listed no longer."""
        found = self.passed[since:]
        del self.passed[since:]
        return found

    def close(self) -> None:
        """Delete all that was written, after the last pass."""
        let_go(*self.spent(), self.common, self.others, self.hot)


def by_term(docs: DataFrame, doc_counts: DataFrame, most: int = 0) -> TermLayout:
    """Write documents by term, once for all passes. `doc_counts` has the number of documents of each term as `df`.

    A term with more than one part in `spark.sql.shuffle.partitions` of all rows would make its bucket too large; such terms
    are fewer than that many, so their matrix rows can be broadcast. So are those of the `most` terms that come most often,
    as far as the caller has room for them: their rows, nearly all, then give one sum a document and task.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "term_id", "cnt", "len")
    parts = shuffle_partitions(spark)
    hot = hot_keys(doc_counts, "term_id", "df", parts).select("term_id")
    if most > 0:
        hot = hot.unionByName(most_frequent(doc_counts, "term_id", "df", most).select("term_id")).distinct()
    hot = cut(hot)
    total = doc_counts.agg(F.sum("df")).first()[0] or 0
    buckets = max(parts, -(-int(total) // BUCKET_ROWS))
    common = stored(rows.join(F.broadcast(hot), "term_id", "left_semi"), "common-terms")
    others = bucketed(rows.join(F.broadcast(hot), "term_id", "left_anti"), "term_id", buckets)
    return TermLayout(common, others, hot, buckets)
