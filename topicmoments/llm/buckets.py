"""Links between members of buckets, without pairing all members of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import join_measured, join_salted, written
from topicmoments.llm.components import components


def bucket_links(members: DataFrame, facts: Sequence[str], best: Column, measure: Callable[[DataFrame], DataFrame],
                 may: Callable[[str, str], Column], may_star: Callable[[str, str], Column] | None = None,
                 hub_seen: Column | None = None, bounds: Mapping[str, Column] | None = None,
                 reach: Column | None = None) -> DataFrame:
    """Links (a, b) that connect whatever links within buckets connect.

    `members` holds (key, id, *facts), a member once in a bucket, and is read several times.
    `measure` adds `linked` to pairs (a, b). First every member meets its bucket's hub, the member
    with the greatest `best`. Their links make components. Then only buckets that still hold several
    components are looked at: members outside a bucket's largest component meet the members of other
    components. Pairs within one component are connected already, so the components of the result are
    those of all links.

    Necessary conditions keep pairs out early, without losing a link: `may_star(x, y)` and `may(x, y)` on
    the facts of two aliases. If `hub_seen` is given, `measure` also adds `from_a` and `from_b`, structs
    that say what either end sees of the other; members then have the struct `seen` of their bucket's
    hub, and the hub has `hub_seen`. `reach`, on one member and the aggregates `bounds` of its bucket, says
    whether it can have any link there.
    """
    hubs = written(members.groupBy("key").agg(F.max_by(F.struct("id", *facts), best).alias("hub"), F.count("*").alias("size"))
                   .filter("size > 1"), "hubs")
    met = join_salted(members, hubs, ["key"], "size", F.col("id"), 200).filter("hub is not null")
    met = met.select("*", F.greatest("hub.id", "id").alias("a"), F.least("hub.id", "id").alias("b"))
    star = met.filter("a != b")
    if may_star is not None:
        star = star.filter(may_star("hub", ""))
    measured = written(measure(written(star.select("a", "b").distinct(), "star")), "measured")
    links = measured.filter("linked").select("a", "b")
    roots = components(links).select("id", "root")
    labelled = met.select("key", "id", "a", "b", *facts).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if hub_seen is not None:
        labelled = labelled.join(measured.select("a", "b", "from_a", "from_b"), ["a", "b"], "left").withColumn(
            "seen", F.when(F.col("a") == F.col("b"), hub_seen).when(F.col("id") == F.col("a"), F.col("from_a")).otherwise(F.col("from_b")))
    labelled = written(labelled.drop("a", "b", "from_a", "from_b"), "labelled")
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("many"))
    mixed = (parts.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count("*").alias("roots"))
             .filter("roots > 1").select("key", "main"))
    if bounds:
        mixed = mixed.join(labelled.groupBy("key").agg(*[c.alias(name) for name, c in bounds.items()]), "key")
    still = written(join_measured(labelled, written(mixed, "mixed"), ["key"], "inner", 120), "open")
    x, y = still.filter("root != main"), still.alias("y")
    x = (x if reach is None else x.filter(reach)).alias("x")
    rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & may("x", "y"))
            .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())
    more = measure(written(rest.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "rest"))
    return links.unionByName(written(more.filter("linked").select("a", "b"), "more-links"))


def fact(alias: str, name: str) -> Column:
    """A fact of a member by its alias (or of the row itself)."""
    return F.col(f"{alias}.{name}" if alias else name)


def flags(hashes: Column) -> Column:
    """128 flags, as two numbers, for the members of an array of hashes; one member more or less changes one at most."""
    def half(which: int) -> Column:
        own = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(1)) == which)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))

    return F.struct(half(0).alias("low"), half(1).alias("high"))


def no_flags() -> Column:
    return F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))


def flag_count(a: Column, b: Column, how: str) -> Column:
    """Flags that a or b has, or (`bitwiseXOR`) only one of them."""
    return F.bit_count(getattr(a["low"], how)(b["low"])) + F.bit_count(getattr(a["high"], how)(b["high"]))
