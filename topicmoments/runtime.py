"""Lineage cuts, size-checked joins and dense numbering shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BROADCAST_CONF = "topicmoments.broadcast.maxBytes"
BROADCAST_DEFAULT = 128 * 1024 * 1024

# Where the tables lie that `stored` and `bucketed` wrote.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and work tables: the one that spark.checkpoint.dir names.

    Only in local mode, where the setting is missing, as in a notebook, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not active:
            sc.setCheckpointDir(configured)
        return configured
    if active:
        return active
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="topicmoments-"))
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/topicmoments-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write a small table to the checkpoint folder, so that loops do not grow their lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet below the shared folder, to be read several times and in part."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return lies_at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def lies_at(table: DataFrame, path: str) -> DataFrame:
    """The table, whose files are its own and can be let go."""
    _folders[table] = path
    return table


def is_stored(table: DataFrame) -> bool:
    return table in _folders


def let_go(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut`, `stored` or `bucketed` wrote, once no step that is left reads them.

    Loops call it for what their last step wrote. Shuffled files of steps that are done go when the driver collects garbage.
    """
    for table in tables:
        spark, path = table.sparkSession, _folders.pop(table, None)
        if path is None:
            place = table._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            path = place.get() if place.isDefined() else None
        if path is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than there are cores.

    For input in a few large pieces; a scan with splits enough is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_DEFAULT)))


def fits_broadcast(spark: SparkSession, size: float) -> bool:
    return size <= broadcast_limit(spark)


def row_bytes(n_columns: int) -> int:
    """Upper estimate of one row of numbers inside a broadcast hash table."""
    return 64 + 8 * n_columns


def table_bytes(table: DataFrame) -> float:
    """Upper estimate of a table's size inside a broadcast hash table, from its actual values."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in table.dtypes),
                F.lit(96))
    return table.agg(F.sum(width)).first()[0] or 0


def hot_keys(counts: DataFrame, key: str, count_col: str, parts: int) -> DataFrame:
    """Keys that hold more than one part in `parts` of all rows, and the copies each needs.

    Fewer than `parts` keys can pass, so the result has a size bound.
    """
    total = counts.agg(F.sum(count_col).alias("total")).first()["total"] or 0
    target = max(float(total) / parts, 1.0)
    return (counts.filter(F.col(count_col) > target)
            .select(key, F.ceil(F.col(count_col) / target).cast("int").alias("copies")))


def most_frequent(counts: DataFrame, key: str, count_col: str, most: int) -> DataFrame:
    """The keys that come most often, `most` at the utmost; of keys that come equally often all or none.

    Equal counts are one row, so the window holds no more rows than the root of twice the sum of all counts.
    """
    sizes = counts.groupBy(count_col).agg(F.count("*").alias("_keys"))
    ahead = W.orderBy(F.desc(count_col)).rowsBetween(W.unboundedPreceding, W.currentRow)
    least = (sizes.withColumn("_ahead", F.sum("_keys").over(ahead)).filter(F.col("_ahead") <= most)
             .agg(F.min(count_col).alias("least")).first()["least"])
    return counts.filter(F.lit(False) if least is None else F.col(count_col) >= F.lit(least)).select(key, count_col)


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread_by: Column,
                hot: DataFrame) -> DataFrame:
    """Inner join on `key` in which the rows of a hot key go to several tasks.

    The hot key's table row is repeated once per copy, and each row on the big side picks one
    copy, so every match is found once.
    """
    hot = F.broadcast(hot)
    left = (rows.join(hot, key, "left")
            .withColumn("salt", F.when(F.col("copies").isNull(), F.lit(0))
                        .otherwise(F.pmod(F.xxhash64(spread_by), F.col("copies")).cast("int")))
            .drop("copies"))
    right = (table.join(hot, key, "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
             .drop("copies"))
    return left.join(right, [key, "salt"]).drop("salt")


def join_sized(rows: DataFrame, table: DataFrame, key: str, size: float, spread_by: str,
               counts: DataFrame, count_col: str) -> DataFrame:
    """Join a big side with a keyed table: broadcast when the table is proven small, else salted.

    `size` is an upper estimate of the table's bytes (see `row_bytes` and `table_bytes`). `counts` holds the number of big-side rows per key, and is only read on the second way.
    """
    spark = rows.sparkSession
    if fits_broadcast(spark, size):
        return rows.join(F.broadcast(table), key)
    hot = hot_keys(counts, key, count_col, shuffle_partitions(spark))
    return salted_join(rows, table, key, F.col(spread_by), hot)


def with_dense_ids(df: DataFrame, order: Sequence[Column], id_col: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order without gathering them in one task.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the
    rows of all partitions before it. The sorted rows are written first, so that both steps see
    the same partitions.
    """
    spark = df.sparkSession
    ranked = stored(df.repartitionByRange(shuffle_partitions(spark), *order)
                    .sortWithinPartitions(*order)
                    .select("*", F.spark_partition_id().alias("_part"),
                            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")), "ranked")
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition, so this window is small
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (ranked.join(F.broadcast(offsets), "_part")
            .withColumn(id_col, F.col("_offset") + F.col("_place"))
            .drop("_part", "_place", "_offset"))
