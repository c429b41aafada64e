"""Whole texts in Arrow batches, and joins whose small side is measured first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topicmoments.runtime import checkpoint_root, shuffle_partitions, work_path

#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 24 << 20
#: Bytes of results that a task remembers, and what an entry takes besides its own bytes.
MEMORY_BYTES, ENTRY_BYTES = 32 << 20, 160


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches, giving memory of batches that are done back to the system.

    Arrow keeps what it freed, and a Python worker lives on after its task, so later stages would count it too.
    """
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    def giving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(freed(batches))
        finally:
            pa.default_memory_pool().release_unused()

    return giving


def scan_texts(docs: DataFrame, text_col: str, keep: Sequence[str], results: str,
               start: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Run a function over whole texts: a struct column `row` with the `keep` columns, then `results`.

    `start` is called once in each task and returns a function from an array of texts (null where
    the text is null) to one array for each column of the DDL string `results`. Input columns stay
    inside `row`, so that their names cannot clash with the results'. A text that is kept is not sent
    a second time.
    """
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    inside = list(keep).index(text_col) if text_col in keep and dict(docs.dtypes)[text_col] == "string" else None
    packed = docs.select(row) if inside is not None else docs.select(row, docs[text_col].cast("string").alias("text"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL(results).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if inside is not None:
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(inside)], ["row", "text"])
            for piece in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), *work(piece.column(1))], names)

    return packed.mapInArrow(giving_back(run), schema)


class Remembered(dict):
    """Results by key, all forgotten when keys and values would take more than `limit` bytes."""

    def __init__(self, limit: int = MEMORY_BYTES) -> None:
        self.limit, self.held = limit, 0

    def room(self, size: int) -> bool:
        """Make room for entries of so many bytes; whether anything was forgotten for them."""
        full = self.held + size > self.limit
        if full:
            self.clear()
            self.held = 0
        self.held += size
        return full


def flat(scanned: DataFrame) -> DataFrame:
    """Input columns and results side by side; a result replaces an input column of the same name."""
    results = [c for c in scanned.columns if c != "row"]
    taken = {c.lower() for c in results}
    inputs = [c for c in scanned.schema["row"].dataType.names if c.lower() not in taken]
    return scanned.select(*[F.col("row").getField(c).alias(c) for c in inputs], *results)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, one after the other, and where each begins; null is empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return flat_bytes[first:last], offsets.astype(np.int64) - first


def lists(values: np.ndarray | list, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from all values and the number of them in each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def written(frame: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared work folder, so that later steps read the same rows.

    With `group`, row groups take so many bytes and are read one column after the other, not at once through buffers
    outside the heap.
    """
    spark = frame.sparkSession
    path = work_path(spark, name)
    own = {} if group is None else {"parquet.block.size": str(group), "parquet.hadoop.vectored.io.enabled": "false"}
    frame.write.options(compression="zstd", **own).parquet(path)
    return spark.read.options(**own).schema(frame.schema).parquet(path)


def small_enough(frame: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, at `row_bytes` each in memory, fit a broadcast; counts them."""
    return frame.count() * row_bytes <= limit


def join_measured(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str, row_bytes: int,
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a table that is broadcast if its counted rows fit; else Spark shuffles both sides."""
    side = F.broadcast(table) if small_enough(table, row_bytes, limit) else table
    return rows.join(side, list(keys), how)


def join_salted(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, spread_by: Column,
                row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left join with a table that is unique on `keys` and says in `weight` how many rows each key meets.

    A table that fits is broadcast. Otherwise both sides are shuffled, and a key that meets more
    than its part of all rows is copied under several salts, among which its rows are dealt.
    Columns of the table other than the keys and the weight are added.
    """
    spark = rows.sparkSession
    if small_enough(table, row_bytes, limit):
        return rows.join(F.broadcast(table.drop(weight)), list(keys), "left")
    parts = shuffle_partitions(spark)
    total = table.agg(F.sum(weight)).first()[0] or 0
    share = max(1.0, float(total) / parts)
    # fewer than `parts` keys can hold more than one part each, so this list is small
    hot = (table.filter(F.col(weight) > share)
           .select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("_copies")))
    left = (rows.join(F.broadcast(hot), list(keys), "left")
            .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_copies", F.lit(1))).cast("int"))
            .drop("_copies"))
    right = (table.drop(weight).join(F.broadcast(hot), list(keys), "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
             .drop("_copies"))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def checkpointed(frame: DataFrame) -> DataFrame:
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)
