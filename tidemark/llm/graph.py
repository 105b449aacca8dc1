"""Connected components of links between 64-bit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import checkpointed, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each linked key one key of its component, the same for all of it.

    Each round every key takes the neighbour that comes first in a scrambled order, itself included, and then what that one took.
    Links are drawn between what was taken, and those within one key fall away; the rounds end when none is left. The order is
    scrambled so that no chain of keys is long in it, so each round leaves a fraction of the keys. A star is done in one.
    Every round's tables are written to the shared folder, and the round before is deleted.
    """
    # written first: made anew for each direction, links that depend on the order of rows would not be the same both times
    edges = checkpointed(_between(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    total = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("m"))
        took = checkpointed(first.select(F.col("u").alias("node"), F.when(F.xxhash64("u") < F.xxhash64("m"), F.col("u")).otherwise(F.col("m")).alias("root")))
        onward = took.select(F.col("node").alias("root"), F.col("root").alias("far"))
        hop = checkpointed(took.join(onward, "root").select("node", F.col("far").alias("root")))
        ends = [hop.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("u", "v")]
        left = checkpointed(_between(edges.join(ends[0], "u").join(ends[1], "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))))
        release(edges, took)
        if total is None:
            total = hop
        else:
            now = checkpointed(total.join(hop.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root")))
            release(total, hop)
            total = now
        if left.isEmpty():
            release(left)
            return total
        edges = left


def _between(links: DataFrame) -> DataFrame:
    """Links between two keys, each once."""
    return links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
