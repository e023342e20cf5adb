"""Connected components by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmint.storage import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round hooks every node to its smallest neighbour (an aggregation with map-side
    combine, so a hub costs a row per task), follows the hooks once more, and contracts the
    edges: those inside one tree vanish, parallel ones merge. At least half of the nodes left
    go in each round, so edges are joined a few times at most, and rounds are
    logarithmic on paths too. Rounds are cut by tables in the shared folder. A self edge makes its
    node a component; null endpoints are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    pairs = materialize(pairs.distinct(), "cc-edges")
    labels = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    labels = materialize(labels, "cc-labels")
    live = pairs.where("u <> v")
    while not live.isEmpty():
        ends = live.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o")), F.struct(F.col("v").alias("n"), F.col("u").alias("o")))))
        hooks = materialize(ends.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("p")), "cc-hooks")
        up = hooks.select(F.col("n").alias("p"), F.col("p").alias("q"))
        hooks = materialize(hooks.join(up, "p").select("n", F.col("q").alias("p")), "cc-hooks")
        moved = hooks.where("n <> p")
        labels = materialize(labels.join(moved, labels["component"] == moved["n"], "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        left = hooks.select(F.col("n").alias("u"), F.col("p").alias("pu"))
        right = hooks.select(F.col("n").alias("v"), F.col("p").alias("pv"))
        contracted = live.join(left, "u").join(right, "v").where("pu <> pv")
        live = materialize(contracted.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges")
    return labels
