"""Connected components of an edge table by alternating large and small stars (Kiveris and others, 2014).

Each round is two minima by node and two joins on narrow rows and is written to the shared folder; the number of rounds
grows with the logarithm of the longest chain. Minima are pre-aggregated. A node with more than 1 / HUBS of all edges
is a hub; hubs are broadcast, so a hub's edges stay in the tasks that read them.

Defined cases: edges with a null end and loops are no edges; repeated edges count once; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

def components(edges: DataFrame) -> DataFrame:
    """edges (u, v longs) to (node, label): label is the smallest node that can be reached. Only nodes with edges appear."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    e = common.stored(e, "edges")
    state = _state(e)
    while True:
        large = common.stored(_large(e, state[0]), "large-stars")
        stars = common.stored(_small(large, state[0]), "stars")
        common.release(large, e)
        e, new = stars, _state(stars)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
    return common.join_counted(both.filter("v > u"), low, ["u"], 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    moved = common.join_counted(e, low, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
