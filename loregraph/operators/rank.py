"""Personalised PageRank: where a walk that keeps coming back to its seeds spends its time.

A round moves each node's mass along its edges in proportion to their weights, sends the mass of
nodes without a way out, and the share of the restart, back to the seeds, and is written to the
shared folder; the round before it is deleted.  Only nodes that mass has reached have a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions.storage import discard, persisted


def transitions(edges: DataFrame, weights: dict[str, float] | None = None, both: bool = False) -> DataFrame:
    """(id, next, share): the chance of each step out of a node; ``both``: edges are walked backwards too.

    ``weights`` by edge type, 1 for others; an edge of no positive weight is no way, and parallel
    edges add up.  A node without a row has no way out.
    """
    weight = F.coalesce(*[F.when(F.col("edge_type") == t, F.lit(float(w))) for t, w in (weights or {}).items()], F.lit(1.0))
    ways = edges.select(F.col("from_node").alias("id"), F.col("to_node").alias("next"), weight.alias("w"))
    if both:
        ways = ways.unionByName(ways.select(F.col("next").alias("id"), F.col("id").alias("next"), "w"))
    ways = ways.where("w > 0").groupBy("id", "next").agg(F.sum("w").alias("w"))
    strength = ways.groupBy("id").agg(F.sum("w").alias("strength"))
    return ways.join(strength, "id").select("id", "next", (F.col("w") / F.col("strength")).alias("share"))


def personal_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100, weights: dict[str, float] | None = None, both: bool = False) -> tuple[DataFrame, int]:
    """((id, rank) of what is reached, rounds made) of ``seeds(id, weight)``.

    Ranks add up to 1.  Rounds end once the sum of all changes is at most ``tolerance``.  Seeds
    without an edge keep their share; repeated seeds add up, and those of no positive weight or
    a null id are none; without a seed there is no row.
    """
    ways = persisted(transitions(edges, weights, both), "ways")
    wanted = seeds.where("weight > 0 AND id IS NOT NULL").groupBy("id").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    whole = wanted.agg(F.sum("w").alias("all")).first()["all"]
    restart = persisted(wanted.select("id", (F.col("w") / F.lit(whole)).alias("rank")), "restart")
    rank, rounds = restart, 0
    while rounds < most_rounds and whole:
        rounds += 1
        moved = persisted(rank.join(ways, "id").groupBy(F.col("next").alias("id")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank")), "moved")
        back = 1 - (moved.agg(F.sum("rank")).first()[0] or 0.0)  # the restart's share and what found no way out
        spread = moved.unionByName(restart.select("id", (F.col("rank") * back).alias("rank")))
        now = persisted(spread.groupBy("id").agg(F.sum("rank").alias("rank")), "rank")
        change = rank.select("id", (-F.col("rank")).alias("rank")).unionByName(now).groupBy("id").agg(F.sum("rank").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        discard(moved, *([rank] if rank is not restart else []))
        rank = now
        if change <= tolerance:
            break
    discard(ways, *([restart] if rank is not restart else []))
    return rank, rounds
