"""Prefix trie of conversations by collapsing whole sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicmoments.llm.common import join_salted, written
from topicmoments.runtime import shuffle_partitions

#: Conversations whose ids agree but for the rest by this number share a beginning.
FAMILY = 5
#: The shared beginning has fewer turns than this.
HEADS = 9
#: Places of a sequence that are summed in one group.
BLOCK = 1024
#: Bytes of listed ids that a task gathers before it sends them on.
LIST_BYTES = 1 << 20
NODE = ["depth", "k1", "k2"]


def head_turns(conv: Column, heads: int = HEADS) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string")) % heads).cast("int")


def running_sums(rows: DataFrame, group: str, place: Column, values: Sequence[str]) -> DataFrame:
    """Replace each value by its sum over the group's places up to and including its own.

    Places are summed in blocks, and blocks before them are added, so that a long group lies in many tasks.
    """
    rows = rows.withColumn("_at", place).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    blocks = rows.groupBy(group, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = (blocks.select(group, "_block", *[F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values])
              .filter("_block > 0"))  # a group of one block has nothing before it
    here = W.partitionBy(group, "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(before, [group, "_block"], "left")
    return joined.withColumns({v: F.sum(v).over(here) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(
        "_at", "_block", *[f"_{v}" for v in values])


def _numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, g, t1, t2, bytes): turns in order, numbered over the whole table, with hashes of role and text.

    Rows are dealt by ranges of (conversation, turn) and sorted there; sizes of the ranges say where each begins.
    """
    texts = conversations.select(
        conversations[id_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    order = ["conv", "turn", "role", "text"]
    hashes = [F.xxhash64(F.lit(salt), "role", "text").alias(name) for salt, name in ((17, "t1"), (71, "t2"))]
    sorted_ = (texts.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
               .select("conv", *hashes, F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sorted_ = written(sorted_, "turns")
    # one row for each range, so this window is small
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sorted_.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return sorted_.join(F.broadcast(offsets), "part").select("conv", (F.col("offset") + F.col("place")).alias("g"), "t1", "t2", "bytes")


def rebuilt_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, family: int,
                  heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv, place, size, t1, t2, bytes) of rebuilt conversations, places from 1, and (conv, size) of all of them."""
    turns = _numbered(conversations, id_col, turn_col, role_col, text_col)
    stats = written(turns.groupBy("conv").agg(F.min("g").alias("first"), F.count("*").alias("n")), "conversations")
    base = stats.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = (stats.withColumns({"h": head_turns(F.col("conv"), heads), "base": F.col("conv") - F.col("conv") % family})
             .join(base, "base", "left").withColumn("taken", F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0)))))
    convs = written(convs.select("conv", "base", "first", "n", "h", "taken",
                                 (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "rebuilt")
    placed = join_salted(turns, convs.select("conv", "first", "h", "taken", "size", "n"), ["conv"], "n", F.col("g"), 100)
    placed = written(placed.withColumn("place", F.col("g") - F.col("first") + 1).drop("g", "first"), "placed")
    parts = ["conv", "place", "size", "t1", "t2", "bytes"]
    own = placed.filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken")).select(parts)
    firsts = placed.filter(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "t1", "t2", "bytes")
    shared = convs.filter("taken > 0").select("conv", "base", "h", "size").join(firsts, "base").filter("place <= h").select(parts)
    return own.unionByName(shared), convs.select("conv", "size")


def _key(place: Column, s1: Column, s2: Column) -> list[Column]:
    """Two hashes that name the sequence of the first `place` turns by its sums; the empty one has zeros."""
    return [F.when(place == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), place, s1, s2)) for salt in (29, 92)]


def with_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, size, k1, k2, p1, p2, bytes): each beginning of a rebuilt conversation, its key and its parent's.

    A beginning is named by two sums over its turns of a hash of place, role and text.
    """
    own = {f"v{i}": F.xxhash64("place", f"t{i}").cast("decimal(20,0)") for i in (1, 2)}
    rows = turns.withColumns(own).withColumns({"s1": F.col("v1").cast("decimal(38,0)"), "s2": F.col("v2").cast("decimal(38,0)")})
    rows = running_sums(rows.drop("t1", "t2"), "conv", F.col("place"), ["s1", "s2"])
    before = [(F.col(f"s{i}") - F.col(f"v{i}")).cast("decimal(38,0)") for i in (1, 2)]
    s1, s2 = (F.col(f"s{i}").cast("decimal(38,0)") for i in (1, 2))
    k1, k2 = _key(F.col("place"), s1, s2)
    p1, p2 = _key(F.col("place") - 1, *before)
    return rows.select("conv", F.col("place").alias("depth"), "size", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest): SHA-256 of the ids of each key, ascending, joined by commas.

    Ids are sorted by ranges, and tasks join those of a key to one text; a second pass feeds these texts
    to the hash in order, one after the other, so that no task holds the ids of a key at once.
    """
    parts = shuffle_partitions(ends.sparkSession)
    placed = ends.select(*NODE, "conv").repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, rows = None, None, [], 0, []
        for batch in batches:
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if own != key or size > LIST_BYTES:
                    if ids:
                        rows.append((*key, first, ",".join(ids)))
                    key, first, ids, size = own, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield _rows(rows, [*NODE, "first", "ids"])
                rows = []
        if ids:
            yield _rows([(*key, first, ",".join(ids))], [*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, rows = None, None, []
        for batch in batches:
            for *own, ids in zip(*[batch.column(n).to_pylist() for n in (0, 1, 2, 4)]):
                if own != key:
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(("," + ids).encode())
            if rows:
                yield _rows(rows, [*NODE, "digest"])
                rows = []
        if key is not None:
            yield _rows([(*key, digest.hexdigest())], [*NODE, "digest"])

    schema = "depth long, k1 long, k2 long"
    texts = placed.mapInArrow(listed, f"{schema}, first long, ids string")
    return (texts.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(hashed, f"{schema}, digest string"))


def _rows(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("ids", "digest") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of rebuilt conversations, one row per node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, prefix_key.

    Turns are in the order of the turn number, null first, then role and text. Conversation c takes the
    first h turns of conversation c - c % family (h = crc32 of c as text, modulo `heads`), and its own
    turns after its first h. A node stands for the conversations that begin with the same `depth` turns
    (role and text); conv_id is the smallest of them. saved_tokens adds up, over the node and all below it, the
    bytes of the last turn's text for all conversations but one; ends_sha256 is of the ids that end at the
    node; prefix_key names the turns.

    Equal rebuilt conversations are one weighted sequence, and only these are unrolled into beginnings.
    A sequence that is no proper beginning of another one is a leaf (anti-join). A node's sums are those
    of the weighted sequences through it; what a node saves is added to the nodes above along the sequence
    of its smallest conversation. Turns are numbered, and added up along a sequence, by ranges and blocks, so
    neither one long conversation nor many equal ones meet in one task's memory.

    Null role or text is empty. Rows without a conversation id are left out. Repeated rows are turns of
    their own. Conversations left without a turn end at the root. An empty table has no nodes, not even
    a root. Other columns are not read.
    """
    turns, convs = rebuilt_turns(conversations, id_col, turn_col, role_col, text_col, family, heads)
    keyed = written(with_keys(turns), "beginnings")
    bare = convs.filter("size = 0").select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2")])
    ends = written(keyed.filter("depth = size").select("conv", *NODE).unionByName(bare), "ends")
    sequences = written(ends.groupBy(*NODE).agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "sequences")
    inner = keyed.filter("depth < size").select(*NODE).distinct()
    roots_inner = keyed.filter("depth = size").select(*[F.lit(0).cast("long").alias(c) for c in NODE]).distinct()
    leaves = sequences.join(inner.unionByName(roots_inner), NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    sequences = written(sequences.join(leaves, "rep", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long"))), "weighted")

    reps = sequences.filter("depth > 0").select(F.col("rep").alias("conv"), "n", "leaf", F.col("depth").alias("w"))
    steps = written(join_salted(keyed, reps, ["conv"], "w", F.col("depth"), 80).filter("n is not null"), "steps")
    nodes = steps.groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("leaf").alias("n_leaves"),
                                     F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    none = F.lit(None).cast("long")
    root = (sequences.agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.sum("leaf").alias("n_leaves")).filter("n_convs is not null")
            .select(*[F.lit(0).cast("long").alias(c) for c in NODE], "n_convs", "conv_id", "n_leaves", F.lit(0).cast("long").alias("bytes"),
                    none.alias("p1"), none.alias("p2")))
    nodes = written(nodes.unionByName(root), "nodes")

    own = nodes.filter("depth > 0 and n_convs > 1").select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    below = steps.select("conv", "size", *NODE).join(own, ["conv", "depth"], "left").withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
    below = running_sums(below, "conv", F.col("size") - F.col("depth"), ["saved"])
    saved = below.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"))
    saved = saved.unionByName(own.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens")).select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], "saved_tokens"))
    children = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count("*").alias("n_children")))
    whole = (nodes.join(saved, NODE, "left").join(children, NODE, "left").join(end_digests(ends), NODE, "left")
             .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    whole = written(whole, "trie")
    parents = whole.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                    F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = join_salted(whole.withColumnRenamed("n_children", "n_own"), parents, ["depth", "p1", "p2"], "n_children", F.col("k1"), 100)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_own").alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
                        F.concat_ws("-", F.hex("k1"), F.hex("k2")).alias("prefix_key"))
