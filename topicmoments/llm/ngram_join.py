"""Jaccard join of word n-grams: prefix filters under several orders of the shingles, and exact sets for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from topicmoments.llm.common import join_measured, join_salted, lists, pieces, written
from topicmoments.llm.components import components
from topicmoments.llm.near_dup import prints, shingle_sets
from topicmoments.llm.words import NOT_BLANK, WordReader

#: Members of a bucket that all its other members meet in one round.
HUBS = 128


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set a similar enough one may lack."""
    return n * (100 - percent) // 100


def extended_prefixes(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the order of their hashes, one set after the other, and their numbers.

    The first `spare` + 1 shingles in any order hold one of every similar enough set. Half as many more are taken:
    then all but `spare` of these must stand in another set.
    """
    lengths = np.minimum(counts, np.maximum(spare(counts, percent) + 1, counts * (100 - percent) * 3 // 200))
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return values[place < np.repeat(lengths, counts)], lengths


def _scan(docs: DataFrame, size: int, schema: str, result: Callable[[pa.Array, np.ndarray, np.ndarray], list]) -> DataFrame:
    """Run a function over ids, the shingles of texts (sorted hashes) and their numbers."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(NOT_BLANK)
        for batch in batches:
            for piece in pieces(batch, 1):
                columns = result(piece.column(0), *shingle_sets(reader, piece.column(1), size))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) if isinstance(c, np.ndarray) else c for c in columns], names)

    return docs.mapInArrow(run, schema)


def outlines(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, p1, p2): each text's number of shingles and prints of the set."""
    return _scan(texts, size, "id long, n long, p1 long, p2 long", lambda ids, values, counts: [ids, counts, *prints(values, counts)])


def first_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, own): shingles of the extended prefixes with a print of their set, one row for each."""
    def rows(ids: pa.Array, values: np.ndarray, counts: np.ndarray) -> list:
        found, lengths = extended_prefixes(values, counts, percent)
        return [found, np.repeat(prints(values, counts)[0], lengths)]

    return _scan(texts, size, "key long, own long", rows)


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, p1, p2, shingles): the whole set of each text, in the order of hashes."""
    return _scan(texts, size, "id long, p1 long, p2 long, shingles array<long>",
                 lambda ids, values, counts: [ids, *prints(values, counts), lists(values.view(np.int64), counts, pa.int64())])


def largest_partner(n: Column, before: Column, percent: int) -> Column:
    """The size of the largest set that can still be linked if the first shingle in common has `before` others before it."""
    return F.floor((100 + percent) * (n - before) / percent) - n


def sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def enough(common: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of n1 and n2 shingles with `common` of them in both are linked."""
    return (100 + percent) * common >= percent * (n1 + n2)


def may_lack(n: Column, percent: int) -> Column:
    """How many shingles of a set a similar enough one may lack."""
    return F.floor(n * (100 - percent) / 100)


def candidates(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Classes whose prefix in the order of hashes has enough shingles that stand in the prefix of another class, too.

    A shingle that only copies of one set have is found by equal prints, and is added up before every shuffle.
    """
    owners = first_shingles(texts, size, percent).groupBy("key").agg(F.min("own").alias("p1"), F.max("own").alias("other"))
    alone = written(owners.filter("p1 = other").groupBy("p1").agg(F.count("*").alias("alone")), "alone")
    found = join_measured(classes, alone, ["p1"], "left", 60)
    return found.filter(F.coalesce("alone", F.lit(0)) <= may_lack(F.col("n"), percent)).drop("alone")


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, s, starts, prefix): what each class has in the order of rarity, where shingles of one class alone come first.

    Those cannot be shared and only take up the prefix; `s` shingles are left. `starts` are the first of these in
    three orders: by hash, its reverse, and rarity.
    """
    each = sets.select("cid", "n", F.explode("shingles").alias("key"))
    common = written(each.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared-shingles")
    # as many rows as shared shingles: shuffled at any size, so that all sizes take one way
    ranked = join_salted(each, common.withColumn("w", F.col("df")), ["key"], "w", F.col("cid"), 60, limit=-1).filter("df is not null")
    own = ranked.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))
    own = own.select(F.col("cid").alias("id"), "n", F.transform("order", lambda x: x["key"]).alias("order"), F.size("order").cast("long").alias("s"))
    left = (may_lack(F.col("n"), percent) + 1 - (F.col("n") - F.col("s"))).cast("int")
    starts = F.array(F.array_min("order"), F.array_max("order"), F.get("order", F.lit(0)))
    return written(own.filter(left > 0).select("id", "n", "s", starts.alias("starts"), F.slice("order", F.lit(1), left).alias("prefix")), "ordered")


def members_of(order: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, most, s): the prefixes, one row for each shingle; `most` is the size of the largest set that a class can
    link to if this is the first shingle in common."""
    rows = order.select("id", "n", "s", F.posexplode("prefix").alias("place", "key"))
    return rows.select("key", "id", "n", largest_partner(F.col("n"), F.col("n") - F.col("s") + F.col("place"), percent).alias("most"), "s")


def mixed(members: DataFrame) -> DataFrame:
    """Members, with their component as `root`, of buckets that hold several, where these are small enough to meet."""
    buckets = (members.groupBy("key").agg(F.count("*").alias("w"), F.min("n").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
               .filter("low != high").select("key", "w", "least"))
    return join_salted(members, written(buckets, "mixed"), ["key"], "w", F.col("id"), 80).filter("least <= most").drop("least")


def with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select("id", "root")
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def attach(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the size and the set of both ends. A class in very many pairs is dealt among tasks, each with a copy of its set."""
    both = pairs
    for end, other in (("a", "b"), ("b", "a")):
        weights = written(pairs.groupBy(end).agg(F.count("*").alias("w")), "pair-counts")
        mean = weights.join(sets.select(F.col("cid").alias(end), "n"), end).agg(F.avg("n")).first()[0] or 0
        own = weights.join(sets.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("shingles").alias(f"set_{end}")), end)
        both = join_salted(both, own, [end], "w", F.col(other), int(100 + 10 * mean))
    return both


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, linked) of pairs whose prefixes share a shingle in the order of hashes and in its reverse, too."""
    both = attach(pairs, sets)

    def prefix(end: str, last: bool) -> Column:
        n, length = F.col(f"n_{end}"), may_lack(F.col(f"n_{end}"), percent) + 1
        return F.slice(f"set_{end}", (n - length + 1).cast("int") if last else F.lit(1), length.cast("int"))

    both = both.filter(F.arrays_overlap(prefix("a", False), prefix("b", False)) & F.arrays_overlap(prefix("a", True), prefix("b", True)))
    both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"))
    return both.select("a", "b", "common", enough(F.col("common"), F.col("n_a"), F.col("n_b"), percent).alias("linked"))


def may_link(h: Column, percent: int) -> Column:
    """Whether a member can be linked to a hub of its bucket, by sizes, places and what both have of the first hub."""
    n, seen = F.col("n"), F.col("seen")
    fits = (h["root"] != F.col("root")) & (h["n"] <= F.col("most")) & (n <= h["most"]) & sizes_fit(n, h["n"], percent)
    # of the first hub, and of the rest, both have no more than the lesser has; a hub not met bounds nothing
    common = F.when(seen.isNotNull() & h["seen"].isNotNull(), F.least(seen, h["seen"]) + F.least(F.col("s") - seen, h["s"] - h["seen"]))
    return fits & F.coalesce(enough(F.least(common, n, h["n"]), n, h["n"], percent) | common.isNull(), F.lit(True))


FACTS = ("id", "n", "most", "s", "root", "seen")


def star_hubs(members: DataFrame) -> DataFrame:
    """(key, hubs, over, w): the class with the largest part of shared shingles, often what others were copied from."""
    best = F.struct(F.col("s") / F.col("n"), -F.col("id"))
    return members.groupBy("key").agg(F.max_by(F.struct(*FACTS), best).alias("h"), F.count("*").alias("w")).select(
        "key", F.array("h").alias("hubs"), F.lit(True).alias("over"), "w")


def links_of(order: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between members of a bucket.

    First each class has three buckets only, those of its first shingle in each order, and meets their hubs: most copies of
    a text are one component then. After that only buckets of the whole prefixes that hold several components are looked
    at. Their members meet one hub, and what a member has in common with it bounds what it can have in common with
    anybody there: members that cannot reach any other are done. In each further round up to `HUBS` hubs are met, all
    that lie outside a bucket's largest component if they are no more; nobody ever meets all others.
    """
    unknown = F.lit(None).cast("long").alias("seen")
    tried, found = [], []

    def meet(members: DataFrame, chosen: DataFrame) -> DataFrame:
        met = join_salted(members, chosen.drop("over"), ["key"], "w", F.col("id"), 150 if not tried else 60 * HUBS).filter("hubs is not null")
        pairs = (met.select("id", F.explode(F.filter("hubs", lambda h: may_link(h, percent))).alias("h"))
                 .select(F.greatest("id", "h.id").alias("a"), F.least("id", "h.id").alias("b")).distinct())
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(written(pairs, "pairs"))
        seen = written(verified(tried[-1], sets, percent), "verified")
        found.append(written(seen.filter("linked").select("a", "b"), "links"))
        return seen

    def links() -> DataFrame:
        return reduce(DataFrame.unionByName, found)

    starts = order.select("id", "n", "s", F.posexplode("starts").alias("order", "first"))
    starts = written(starts.select(F.xxhash64("order", "first").alias("key"), "id", "n", F.lit(1 << 60).alias("most"), "s", F.col("id").alias("root"), unknown), "starts")
    meet(starts, written(star_hubs(starts).filter("w > 1"), "hubs"))

    still = written(mixed(with_roots(members_of(order, percent), links())).withColumn("seen", unknown), "members")
    first = True
    while not still.isEmpty():
        chosen = written(star_hubs(still) if first else round_hubs(still), "hubs")
        seen = meet(still, chosen)
        # hubs have met all others, and need not stay, nor do buckets whose hubs were all that was left outside
        done = chosen.select("key", F.explode("hubs.id").alias("id"))
        rest = still.join(done, ["key", "id"], "left_anti")
        if first:
            hub = chosen.select("key", F.get("hubs", F.lit(0))["id"].alias("hub"), "w")
            rest = join_salted(rest, hub, ["key"], "w", F.col("id"), 60).withColumns({"a": F.greatest("id", "hub"), "b": F.least("id", "hub")})
            common = seen.select("a", "b", F.col("common").alias("seen"))
            rest = rest.drop("seen", "hub").join(common, ["a", "b"], "left").drop("a", "b")
        else:
            open_ = chosen.filter("over").select("key", "w", F.lit(True).alias("open"))
            rest = join_salted(rest, open_, ["key"], "w", F.col("id"), 60).filter("open").drop("open")
        still = written(reachable(written(with_roots(rest.drop("root"), links()), "rest"), percent), "open")
        first = False
    return links()


def reachable(members: DataFrame, percent: int) -> DataFrame:
    """Members of buckets with several components that can have a link to somebody there."""
    outside = F.col("s") - F.col("seen")
    buckets = members.groupBy("key").agg(F.count("*").alias("w"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"),
                                         F.max(F.coalesce(outside, F.col("s"))).alias("out")).filter("low != high")
    found = join_salted(members, buckets, ["key"], "w", F.col("id"), 120).filter("low is not null and least <= most")
    common = F.least(F.coalesce(F.col("seen") + F.least(outside, F.col("out")), F.col("s")), F.col("n"))
    return found.filter(enough(common, F.col("n"), F.greatest(F.col("least"), common), percent)).drop("low", "high", "least", "out")


def round_hubs(members: DataFrame) -> DataFrame:
    """(key, hubs, over, w): up to `HUBS` members outside each bucket's largest component, and whether there are more."""
    parts = members.groupBy("key", "root").agg(F.count("*").alias("many"))
    buckets = parts.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.max("many").alias("largest"), F.sum("many").alias("w"))
    buckets = written(buckets.select("key", "main", "w", (F.col("w") - F.col("largest") > HUBS).alias("over")), "buckets")
    marked = join_salted(members, buckets, ["key"], "w", F.col("id"), 80).filter("root != main")
    order = W.partitionBy("key").orderBy(F.desc(F.col("s") / F.col("n")), "id")
    ranked = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS)
    chosen = ranked.groupBy("key").agg(F.collect_list(F.struct(*FACTS)).alias("hubs"), F.max("over").alias("over"))
    return chosen.join(buckets.select("key", "w"), "key")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The component of every document under links of similar shingle sets: id, n_shingles, component_id.

    Words are parted by space and by tab to carriage return, A-Z lowered; a set holds the different runs of `size` words,
    or the whole text if it has fewer. Two documents are linked if `percent` of the union of their sets is common to both.
    Documents with equal sets are one class. Linked sets must share a shingle of their prefixes under any order of all
    shingles, and enough of them of longer prefixes: classes are first filtered by the order of hashes, those left meet on
    prefixes in the order of rarity, with bounds by length and place, and pairs must share one in the order of hashes and
    in its reverse, too; only pairs that pass all filters are compared on whole sets.
    In a bucket members meet a few hubs in each round and never all others. component_id is the smallest id reachable.

    Null and empty texts have no shingles and are linked with nothing. Equal rows stay as many; rows that share an id
    have the component of their text. A row without an id is linked with nothing and has no component_id. An empty table
    gives no rows. Other columns are not read.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    outlined = written(outlines(texts, size), "outlines")
    classes = written(outlined.filter("n > 0 and id is not null").groupBy("p1", "p2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # the class number is read back, so it stays
    kept = written(candidates(classes, texts.filter("id is not null"), size, percent).withColumn("cid", F.monotonically_increasing_id()), "kept")
    wanted = kept.select("cid", "p1", "p2", "n", F.col("rep").alias("id"))
    chosen = join_measured(texts, wanted.select("id").distinct(), ["id"], "left_semi", 60)
    sets = written(join_measured(whole_sets(chosen, size), wanted, ["id", "p1", "p2"], "inner", 100).select("cid", "n", "shingles"), "sets")
    if sets.count() > kept.count():  # rows that repeat both id and text
        sets = written(sets.groupBy("cid", "n").agg(F.first("shingles").alias("shingles")), "single-sets")
    links = links_of(ordered(sets, percent), sets, percent)
    roots = components(links)
    least = roots.join(kept.select(F.col("cid").alias("id"), "rep"), "id")
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("component")), "root").select(F.col("id").alias("cid"), "component")
    linked = least.join(kept.select("cid", "p1", "p2", "n"), "cid").drop("cid")
    named = join_measured(classes, written(linked, "linked"), ["p1", "p2", "n"], "left", 100).withColumn("component", F.coalesce("component", "rep"))
    named = named.filter("copies > 1 or component != rep").select("p1", "p2", "n", "copies", "component")
    rows = outlined.select("id", "n", "p1", "p2", (F.col("id").isNotNull() & (F.col("n") > 0)).alias("some"))
    joined = join_salted(rows, named, ["p1", "p2", "n"], "copies", F.col("id"), 120)
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("some"), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
