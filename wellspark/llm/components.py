"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (two columns a, b, long, not null); equal roots, one component.

    In each round every node moves to the neighbour with the smallest random rank (or stays), and links
    between the new places remain. Ranks are drawn anew each round, so a path shrinks by a constant
    factor, and a star of any size is gone after two rounds. The minimum is pre-aggregated before
    the shuffle, so a hub costs no more than its rows. Every round is stored in the shared folder;
    the driver sees only whether links remain.
    """
    links = stored(_proper(links), "links")
    moves = []
    while not links.isEmpty():
        rank = F.xxhash64("to", F.lit(len(moves)))
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        best = ends.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "to")).alias("best"))
        own = F.xxhash64("node", F.lit(len(moves)))
        move = stored(
            best.select("node", F.when(F.col("best.rank") < own, F.col("best.to")).otherwise(F.col("node")).alias("root")),
            "moves",
        )
        moves.append(move)
        for end in ("a", "b"):
            links = links.join(move.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        links = stored(_proper(links), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        roots = roots.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root"))
    return stored(roots, "roots")


def _proper(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
