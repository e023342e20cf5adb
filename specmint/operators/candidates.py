"""Candidate pairs: blocks, block statistics, vectors and top-k inside blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GLOBAL = "__global__"


def blocks(prepared: DataFrame, keys: str = "block_keys", record: str = "record_id", least: int = 2) -> DataFrame:
    """(block, record_id): members of the blocks with `least` records; keyless records share a global block."""
    each = prepared.select(F.explode(F.when(F.size(keys) == 0, F.array(F.lit(GLOBAL))).otherwise(F.col(keys))).alias("block"), F.col(record).alias("record_id"))
    used = each.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return each.join(used.select("block"), "block", "left_semi")


def block_stats(prepared: DataFrame, keys: str = "block_keys", least: int = 2) -> DataFrame:
    """One row: used_blocks, keyed_records, global_records, largest_block, avg_keys_per_record (2 decimals)."""
    each = prepared.select(F.explode(F.when(F.size(keys) == 0, F.array(F.lit(GLOBAL))).otherwise(F.col(keys))).alias("block"))
    sizes = each.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    left = sizes.agg(F.count(F.lit(1)).alias("used_blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_block"))
    right = prepared.agg(
        F.count(F.when(F.size(keys) > 0, 1)).alias("keyed_records"),
        F.count(F.when(F.size(keys) == 0, 1)).alias("global_records"),
        F.round(F.sum(F.size(keys)) / F.greatest(F.lit(1), F.count(F.lit(1))), 2).alias("avg_keys_per_record"),
    )
    return left.crossJoin(right)  # one row each


def strict_relaxed_blocks(prepared: DataFrame, cat: str = "category", uom: str = "uom", bucket: str = "bucket", record: str = "record_id", least: int = 2) -> DataFrame:
    """(block, record_id) by category, unit and size; records of starved blocks meet by category; no category: C|global."""
    strict = F.when(F.coalesce(F.col(cat), F.lit("")) == "", F.lit("C|global")).otherwise(F.concat_ws("|", F.lit("A"), cat, uom, bucket))
    rows = prepared.select(strict.alias("strict"), F.col(cat).alias("cat"), F.col(record).alias("record_id"))
    sizes = rows.groupBy("strict").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "strict")
    final = F.when((F.col("n") >= least) | (F.col("strict") == "C|global"), F.col("strict")).otherwise(F.concat(F.lit("B|"), F.col("cat")))
    rows = rows.select(final.alias("block"), "record_id")
    used = rows.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    return rows.join(used.select("block"), "block", "left_semi")


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def reduction_ratio(candidates: Column, records: Column) -> Column:
    return F.when(records > 1, 1 - candidates / (records * (records - 1) / 2)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k_in_block(vectors: DataFrame, k: int = 20, block: str = "block", record: str = "record_id", vector: str = "vector", chunk: int = 2048) -> DataFrame:
    """(block, record_id, neighbour, cos, rank): the k nearest others of each record inside its block.

    Ties go to the smaller id. A block is cut into chunks of at most about `chunk` records by a
    hash, and every pair of chunks is one group, so a block that holds a third of all records
    is spread over many tasks, each with one matrix product; the k best of each chunk pair
    meet in a ranking by record.
    """
    sizes = vectors.groupBy(block).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    rows = vectors.select(F.col(block).alias("block"), F.col(record).cast("long").alias("record_id"), F.col(vector).alias("vector"))
    rows = rows.join(sizes.withColumnRenamed(block, "block").select("block", "parts"), "block").withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int"))
    queries = rows.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), F.col("part").alias("own"), "record_id", "vector", F.lit(True).alias("query"))
    targets = rows.select("block", F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), "record_id", "vector", F.lit(False).alias("query"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["query"]], pdf[~pdf["query"]]
        if len(q) and len(t):
            t = t.sort_values("record_id")
            own, ids = q["record_id"].to_numpy(), t["record_id"].to_numpy()
            sims = np.stack(q["vector"].to_numpy()).astype(np.float64) @ np.stack(t["vector"].to_numpy()).astype(np.float64).T
            sims[own[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                # The k-th best of each row cuts; all that equal it are in, so that ties go to the smaller id.
                cut = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                cut = np.full(len(own), -np.inf)
            row, col = np.nonzero((sims >= cut[:, None]) & np.isfinite(sims))
            best = np.lexsort((ids[col], -sims[row, col], row))
            row, col = row[best], col[best]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[near], col[near]
            return pd.DataFrame({"block": pdf["block"].iloc[0], "record_id": own[row], "neighbour": ids[col], "cos": sims[row, col]})
        return pd.DataFrame({"block": [], "record_id": [], "neighbour": [], "cos": []})

    found = queries.unionByName(targets).groupBy("block", "own", "other").applyInPandas(near, "block string, record_id long, neighbour long, cos double")
    order = Window.partitionBy("block", "record_id").orderBy(F.desc("cos"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b, cos), a < b: each pair once with its largest similarity over blocks and directions."""
    a, b = ordered(F.col("record_id"), F.col("neighbour"))
    return neighbours.groupBy(a.alias("a"), b.alias("b")).agg(F.max("cos").alias("cos"))


def char_grams(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Character n-grams inside blank-padded words; a padded word shorter than n is one gram."""
    words = F.transform(F.array_remove(F.split(F.lower(F.trim(text)), r"\s+"), ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w: Column, n: int) -> Column:
        size = F.char_length(w)
        every = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(size >= n, every).when(F.lit(n == shortest), F.array(w)).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*(sized(w, n) for n in range(shortest, longest + 1)))

    return F.flatten(F.transform(words, grams))


def tfidf(docs: DataFrame, text: str, record: str = "record_id", min_df: int = 1) -> DataFrame:
    """(record_id, gram, weight): sublinear tf, smooth idf, rows of unit length."""
    counts = docs.select(F.col(record).alias("record_id"), F.explode(char_grams(F.col(text))).alias("gram")).groupBy("record_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(idf, "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = weighed.groupBy("record_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "record_id").select("record_id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cos) of given pairs: gram lists meet as maps by record, one join a side."""
    vectors = weights.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("v"))
    left, right = vectors.select(F.col("record_id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("record_id").alias("b"), F.col("v").alias("vb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.map_filter("va", lambda k, _: F.map_contains_key("vb", k))
    cos = F.aggregate(F.map_entries(common), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at("vb", e["key"]))
    return joined.select("a", "b", cos.alias("cos"))


def difflib_ratios(texts: DataFrame) -> DataFrame:
    """(s, t, ratio) of distinct text pairs by longest matching blocks, 0..100; Arrow batches."""
    import difflib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ratio"] = [100.0 if s == t else difflib.SequenceMatcher(None, s, t, autojunk=False).ratio() * 100.0 for s, t in zip(pdf["s"], pdf["t"], strict=True)]
            yield pdf

    return texts.select("s", "t").distinct().mapInPandas(run, "s string, t string, ratio double")
