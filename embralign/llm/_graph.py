"""Connected components of an edge table, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch, gathered


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 1 << 62) -> DataFrame:
    """edges (a long, b long; about `most` rows if known) -> (id long, component long): each vertex of an edge with the smallest vertex it reaches.

    Rounds of hooking every vertex to its smallest neighbour, one pointer jump, and contraction
    of the edges. Minima are pre-aggregated before each shuffle, so a vertex with very many
    neighbours costs no more than its rows. Every round's tables are written, so lineage stays short,
    and have as many tasks as the edges left ask for. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    edges = scratch.table(gathered(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most), f"{name}_e0")
    own = edges.where("a = b").select(F.col("a").alias("id"))
    live = edges.where("a < b")
    n, labels, k = live.count(), None, 0
    while n:
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hook = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("p"))
        hook = scratch.table(gathered(hook, 2 * n), f"{name}_h{k}")
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = scratch.table(gathered(hook.join(up, "p").select("v", F.col("pp").alias("p")), 2 * n), f"{name}_p{k}")
        one = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        two = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = gathered(gathered(live.join(one, "a"), n).join(two, "b"), n).where("pa <> pb")
        nxt = scratch.table(gathered(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), n), f"{name}_e{k + 1}")
        if labels is None:
            labels, vertices = parent, 2 * n
        else:
            labels = labels.join(parent.select(F.col("v").alias("p"), F.col("p").alias("top")), "p", "left").select("v", F.coalesce("top", "p").alias("p"))
            labels = scratch.table(gathered(labels, vertices), f"{name}_l{k}")
        scratch.drop(f"{name}_h{k}", *[f"{name}_e{k}"] * (k > 0))
        live, k = nxt, k + 1
        n = live.count()
    if labels is None:
        return own.select("id", F.col("id").alias("component"))
    found = labels.select(F.col("v").alias("id"), F.col("p").alias("component"))
    return found.unionByName(own.join(found, "id", "left_anti").select("id", F.col("id").alias("component")))
