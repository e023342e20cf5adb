"""Mixing sources to target weights by hash thresholds, without sorting documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmint.llm.common import WORD, table
from specmint.operators.ranking import ranked
from specmint.storage import materialize

LEVEL_BITS = 12
LEVELS = 3


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    Weights repeat over the sources in code point order, null last. Targets share
    `share` times all sizes by weight; none exceeds `most` times its source's size, and
    the excess is shared again by weight among the others until none is above. Sources
    stay a table: each round is one aggregation, and only its sums reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialize(ranked(sources, [F.col("source").isNull(), F.col("source")]).withColumn("weight", weight).withColumn("top", most * F.col("source_size")), "mix-sources")
    budget = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("top") if capped >= 0 else F.lit(False)
        r = rows.agg(F.sum(F.when(above, F.col("top"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == capped:
            break
        capped = r["n"]
        rate = max(0.0, budget - (r["fixed"] or 0.0)) / r["open"] if r["open"] else rate
    return rows.select("source", "source_size", F.least(F.col("weight") * F.lit(rate), F.col("top")).alias("target"))


def document_size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def document_place(doc_id: Column) -> Column:
    """A document's fixed place among all: the leading bits of a hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id.cast("string")), 64 - LEVEL_BITS * LEVELS)


def thresholds(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(s, source_size, target, whole, threshold) per source of rows (source, size, place)."""
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = materialize(state.withColumn("prefix", F.lit(0).cast("long")), "mix-state")
    for level in range(LEVELS):
        state = materialize(_refine(rows, state, level), "mix-state")
    return state.select(F.col("source").alias("s"), "source_size", "target", "whole", F.col("prefix").alias("threshold"))


def compact(docs: DataFrame) -> DataFrame:
    """What the mix needs of every row, written once so that texts are read once."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), document_size().alias("size"), document_place(F.col("doc_id")).alias("place")), "mix-rows")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per input row.

    Every document has a fixed hash of its doc_id. A source takes all its documents
    floor(target / size) times and, for the rest of its budget, those whose hash lies
    below a threshold: budgets are nested, so a larger target only adds documents. The
    threshold comes from histograms of words by (source, hash bucket); each level splits
    only the bucket in which the budget ends, and the last cell is taken when that comes
    nearer to the budget. No document is sorted or collected, and a hot source is
    summed by all tasks before its buckets meet.

    Size is the number of words (null: 0). Null is a source like any other. Rows that
    repeat a doc_id share a hash and are taken together; a null doc_id hashes too.
    Empty input, empty result; other columns are ignored.
    """
    rows = compact(docs)
    keep = thresholds(rows, weights, share, most)
    joined = rows.join(keep, rows["source"].eqNullSafe(keep["s"]))
    copies = F.col("whole") + (F.col("place") < F.col("threshold")).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _refine(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Move each source's boundary from a cell of this level's width to one of its children.

    `prefix` is the boundary cell's number at the level above; afterwards it counts cells of
    this level, and `left` is the budget that remains inside the cell. At the last level
    `prefix` becomes the exclusive threshold.
    """
    last = level == LEVELS - 1
    below = LEVEL_BITS * (LEVELS - 1 - level)
    s = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"), F.col("left").alias("budget"))
    cells = rows.join(s, rows["source"].eqNullSafe(F.col("s")) & (F.shiftright("place", below + LEVEL_BITS) == F.col("p")))
    cells = cells.groupBy("s", F.shiftright("place", below).alias("cell")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    running = F.sum("words").over(Window.partitionBy("s").orderBy("cell"))  # at most 2^LEVEL_BITS cells a source
    cells = cells.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("words"))
    taken: Column = F.col("budget") - F.col("before") >= (F.col("words") / 2 if last else F.col("words"))
    # The first cell that the budget doesn't cover; nothing follows when it covers them all.
    found = cells.groupBy("s").agg(F.min(F.when(~taken, F.struct("cell", "before"))).alias("at"), F.max("cell").alias("final"), F.max("upto").alias("all"))
    joined = state.join(found.withColumnRenamed("s", "fs"), state["source"].eqNullSafe(F.col("fs")), "left")
    empty = F.shiftleft(F.col("prefix"), LEVEL_BITS)
    after = F.when(F.col("fs").isNull() & F.col("final").isNull(), empty).otherwise(F.coalesce(F.col("at.cell"), F.col("final") + 1))
    spent = F.coalesce(F.col("at.before"), F.col("all"), F.lit(0))
    return joined.select("source", "source_size", "target", "whole", (F.col("left") - spent).alias("left"), after.cast("long").alias("prefix"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as many times as the mix takes it (0, 1 or 2).

    Rows meet their source's threshold, a table with a row per source, and decide for
    themselves; texts are moved only where that table is too large to broadcast.
    """
    keep = thresholds(compact(docs))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), document_place(F.col("doc_id")).alias("place"))
    copies = F.col("whole") + (F.col("place") < F.col("threshold")).cast("int")
    taken = rows.join(keep, F.col("source").eqNullSafe(F.col("s"))).where(copies > 0)
    return taken.select(F.inline(F.array_repeat("row", copies)))
