"""Near-duplicates by min-max hashing, with links confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.buckets import bucket_links, fact, flag_count, flags, no_flags
from topicmoments.llm.common import giving_back, join_measured, join_salted, lists, pieces, text_bytes, written
from topicmoments.llm.components import components
from topicmoments.llm.words import NOT_BLANK, SEED, WordReader, mixed, run_hashes

#: Numbers in a band of a signature, and the share of links at the threshold that may meet in no band.
#: Each hash function gives two numbers, so a signature takes half as many functions as numbers.
ROWS, MISSED = 5, 1e-8
#: Numbers that are hashed at a time.
BLOCK = 1 << 15


def shingle_sets(reader: WordReader, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, one text after the other, and their counts.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    found = reader(*text_bytes(texts))
    counts = np.diff(found.firsts)
    runs = {n: run_hashes(found.hashes, n) for n in range(1, size + 1) if n == size or (counts == n).any()}
    sets = []
    for first, n in zip(found.firsts[:-1].tolist(), counts.tolist()):
        if n >= size:
            sets.append(np.unique(runs[size][first:first + n - size + 1]))
        else:
            sets.append(runs[n][first:first + 1] if n else np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], dtype=np.int64)


def min_max(values: np.ndarray, counts: np.ndarray, functions: int) -> np.ndarray:
    """Signatures: for each set and hash function the least and the greatest hash, side by side."""
    rng = np.random.default_rng(SEED + 2)
    factors = rng.integers(1, 2**62, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, functions, dtype=np.uint64)
    out = np.zeros((len(counts), 2 * functions), dtype=np.uint64)
    some = np.flatnonzero(counts)
    stops = np.cumsum(counts)[some]
    first = 0
    while first < len(some):  # blocks of whole sets that fit the processor's cache
        start = stops[first] - counts[some[first]]
        last = max(first + 1, int(np.searchsorted(stops, start + BLOCK, "right")))
        own, begins = values[start:stops[last - 1]], stops[first:last] - counts[some[first:last]] - start
        for f in range(functions):
            hashed = own * factors[f] + shifts[f]
            hashed ^= hashed >> np.uint64(32)
            out[some[first:last], 2 * f] = np.minimum.reduceat(hashed, begins)
            out[some[first:last], 2 * f + 1] = np.maximum.reduceat(hashed, begins)
        first = last
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each signature; the band's number is part of it."""
    out = np.empty((len(signatures), bands), dtype=np.uint64)
    odd = np.random.default_rng(SEED + 3).integers(1, 2**62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(bands):
        out[:, b] = mixed((mixed(signatures[:, b * rows:(b + 1) * rows]) * odd).sum(axis=1, dtype=np.uint64) + np.uint64(b + 1))
    return out


def prints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes for each set: equal for equal sets, and else hardly ever."""
    stops = np.cumsum(counts)
    out = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ salt), dtype=np.uint64)))
        out.append(sums[stops] - sums[stops - counts])
    return out[0], out[1]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, p1, p2, keys): the set's size, its prints and its band keys."""
    packed = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(NOT_BLANK)
        for batch in batches:
            for piece in pieces(batch, 1):
                values, counts = shingle_sets(reader, piece.column(1), size)
                p1, p2 = prints(values, counts)
                keys = band_keys(min_max(values, counts, -(-bands * rows // 2)), bands, rows)
                keys = lists(keys.ravel().view(np.int64), np.full(len(counts), bands), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), keys],
                                                 ["id", "n", "p1", "p2", "keys"])

    return packed.mapInArrow(giving_back(run), "id long, n long, p1 long, p2 long, keys array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, p1, p2, shingles): the whole shingle set of each document."""
    packed = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(NOT_BLANK)
        for batch in batches:
            for piece in pieces(batch, 1):
                values, counts = shingle_sets(reader, piece.column(1), size)
                p1, p2 = prints(values, counts)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)),
                                                  lists(values.view(np.int64), counts, pa.int64())], ["id", "p1", "p2", "shingles"])

    return packed.mapInArrow(giving_back(run), "id long, p1 long, p2 long, shingles array<long>")


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands after which hardly a link at the threshold has met in none."""
    return math.ceil(math.log(MISSED) / math.log1p(-min(percent / 100, 0.999) ** rows))


def may_link(percent: int, n1: Column, n2: Column, common: Column) -> Column:
    """Whether sets of n1 and n2 shingles with at most `common` in common can be similar enough."""
    common = F.least(common, n1, n2)
    return 100 * common >= percent * (n1 + n2 - common)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, from_a, from_b) of pairs of class ids, from their whole sets (see `seen`).

    A hub may be in very many pairs: its pairs are dealt among tasks, each with a copy of its set.
    """
    both = pairs
    for end, other in (("a", "b"), ("b", "a")):
        weights = pairs.groupBy(end).agg(F.count("*").alias("w"))
        own = weights.join(sets.select(F.col("cid").alias(end), F.col("shingles").alias(f"set_{end}")), end)
        both = join_salted(both, own, [end], "w", F.col(other), 10_000)
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"),
                       seen("set_a", "set_b").alias("from_a"), seen("set_b", "set_a").alias("from_b"))


def seen(own: str, other: str) -> Column:
    """What a set sees of another one: its size, what is common, and which of 128 parts lack something."""
    return F.struct(F.size(other).cast("long").alias("size"), F.col("common").alias("common"), flags(F.array_except(other, own)).alias("lacks"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
            rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and the classes of equal sets: (p1, p2, n, rep, copies, component).

    `rep` is the smallest id of the class and `component` the smallest id that its links reach.
    """
    bands = bands_for(percent, rows)
    sketched = written(sketches(docs, id_col, text_col, size, bands, rows), "sketches")
    # copies become one class before anything is paired; the class number is read back, so it stays
    grouped = (sketched.filter("n > 0 and id is not null").groupBy("p1", "p2", "n")
               .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    reps = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    exploded = reps.select("cid", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(join_measured(exploded, buckets, ["key"], "inner", 80).join(reps.select("cid", "n", "rep", "p1", "p2"), "cid"), "members")

    # whole sets of the classes that share a bucket at all
    wanted = members.select(F.col("rep").alias("id"), "p1", "p2", "cid").distinct()
    chosen = join_measured(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")),
                           wanted.select("id").distinct(), ["id"], "left_semi", 60)
    sets = written(sets_of(chosen, "id", "text", size).join(wanted, ["id", "p1", "p2"])
                   .select("cid", "shingles"), "sets")
    # a shingle of one class alone can be in no intersection
    alone = (sets.select("cid", F.explode("shingles").alias("h")).groupBy("h")
             .agg(F.min("cid").alias("cid"), F.max("cid").alias("other")).filter("cid = other")
             .groupBy("cid").agg(F.count("*").alias("alone")))
    able = (members.join(alone, "cid", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
            .filter(100 * F.col("s") >= percent * F.col("n")).select("key", "cid", "n", "s"))
    able = written(able.withColumnRenamed("cid", "id"), "able")
    best = F.struct(F.col("s") / F.col("n"), -F.col("id"))  # the class with the largest part of shared shingles

    def may(x: str, y: str) -> Column:
        """Two sets share of the hub at most what neither lacks, and of the rest what others have, too."""
        a, b = fact(x, "seen"), fact(y, "seen")
        lacks = F.greatest(a["size"] - a["common"], a["size"] - b["common"], flag_count(a["lacks"], b["lacks"], "bitwiseOR"))
        outside = F.least(fact(x, "s") - a["common"], fact(y, "s") - b["common"])
        return may_link(percent, fact(x, "n"), fact(y, "n"), a["size"] - lacks + outside)

    hub_seen = F.struct(F.col("n").alias("size"), F.col("n").alias("common"), no_flags().alias("lacks"))
    outside = F.col("s") - F.col("seen.common")
    most = F.col("seen.common") + F.least(outside, F.col("most_outside"))
    links = bucket_links(able, ["n", "s"], best, lambda pairs: compared(pairs, sets, percent), may, hub_seen=hub_seen,
                         bounds={"least_n": F.min("n"), "most_outside": F.max(outside)},
                         reach=may_link(percent, F.col("n"), F.greatest("least_n", most), most))
    roots = components(links)
    least = roots.join(reps.select(F.col("cid").alias("id"), "rep"), "id")
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("component")), "root").select(F.col("id").alias("cid"), "component")
    found = reps.drop("keys").join(least, "cid", "left").withColumn("component", F.coalesce("component", "rep")).drop("cid")
    return sketched, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    rows: int = ROWS) -> DataFrame:
    """The component of every document under links of similar shingle sets: id, n_shingles,
    component_id, kept.

    Words are parted by space and by tab to carriage return, A-Z lowered. Two documents are linked
    if `percent` of the union of their sets of `size`-word shingles is common to both. Documents with equal
    sets are one class. Candidates are classes that share a band of a min-max signature: each hash
    function gives the least and the greatest hash of a set, both unbiased, so half the functions are
    enough. In a bucket members meet its hub, and after that only members that links have not joined
    yet; sizes, what sets have in common with the hub, and the number of shingles that any other set has, too,
    bound what two sets can have in common. Links are confirmed on whole sets. component_id is the smallest id reachable;
    kept says whether the document has that id itself.

    Null and empty texts have no shingles and are linked with nothing. Equal rows stay as many; rows
    that share an id have the component of their text. A row without an id is linked with nothing,
    has no component_id and is kept. Other columns are not read.
    """
    sketched, found = classes(docs, id_col, text_col, size, percent, rows)
    grouped = found.filter("copies > 1 or component != rep").select("p1", "p2", "n", "copies", "component")
    rows_ = sketched.select("id", "n", "p1", "p2", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.lit(True)).alias("linked"))
    joined = join_salted(rows_, grouped, ["p1", "p2", "n"], "copies", F.col("id"), 120)
    component = F.when(F.col("linked"), F.coalesce("component", "id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
