"""Connected components of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import checkpointed, join_salted

ROUNDS = 40


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (v, m) with m the least of u and its neighbours; a hub's rows are dealt among tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return join_salted(pairs, least, ["u"], "n", F.col("v"), 120).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every id that has a link, with the least id that it can reach.

    Each round ties all larger neighbours of an id, then all smaller ones, to the least neighbour;
    edges never grow in number beyond the links, and all ids of a component hang on its least id
    after few rounds. Each round's edges are written to the checkpoint folder; nothing but a count and a
    sum of hashes comes to the driver. Repeated links, both directions and loops are allowed; no
    links give no rows. A null end makes a link void.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = (edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
                .unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
        large = (_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = checkpointed(large)
        small = _to_least(large)
        edges = checkpointed(
            small.filter("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
