"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour; a component of any size
ends as a star around its smallest node after a number of steps logarithmic in its
width. No task holds a whole component; every round is cut off by a written table, and the table of the round before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import forget, written

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge and the smallest node of its component.

    Edges with a null end and loops are ignored (a node with loops only does not come out); repeated edges count once;
    no edges give no rows.
    """
    now = written(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        before, now = now, written(_small_star(_large_star(now)), "edges")
        forget(before)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
