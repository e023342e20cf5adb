"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import bound_batches, map_batches, table
from specmint.llm.shingle_join import WIDTH, similar_texts
from specmint.operators.components import connected_components
from specmint.storage import materialize

#: Bits of each fingerprint segment, lowest first. Four differing bits in three
#: segments leave one segment with at most one, so a ball of radius 1 suffices.
SEGMENTS = (22, 21, 21)
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a whole text's word shingles (repeats count); no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    for at in range(0, n, _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long, text_hash long): one row per input row, in one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(1)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, fp long, text_hash long")


def links(fps: DataFrame, distance: int = 4, segments: Sequence[int] = SEGMENTS) -> DataFrame:
    """(a, b): distinct fingerprints at `distance` or fewer differing bits, a < b.

    The table holds every fingerprint once per segment. Each fingerprint probes
    it with the whole Hamming ball of radius distance // segments around each of
    its segments, so at least one probe meets any partner; complete distances
    are verified inside the join. Nothing is capped: a frequent segment value is
    an ordinary skewed join key, which adaptive execution splits.
    """
    radius = distance // len(segments)
    if radius > 1 or sum(segments) != 64:
        raise ValueError("segments must cover 64 bits and leave a radius of 0 or 1")
    table_keys, probe_keys, shift = [], [], 0
    for k, bits in enumerate(segments):
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(k << 40))
        table_keys.append(own)
        probe_keys += [own, *(own.bitwiseXOR(F.lit(1 << i)) for i in range(bits) if radius)]
        shift += bits
    side = fps.select("fp").distinct()
    probes = side.select(F.col("fp").alias("a"), F.explode(F.array(*probe_keys)).alias("key"))
    entries = side.select(F.col("fp").alias("b"), F.explode(F.array(*table_keys)).alias("key"))
    return probes.join(entries, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, text_hash, component_id, component) per input row.

    Exact copies share a fingerprint and so collapse before any link is sought;
    `component_id` is the smallest doc_id among all rows reachable over links,
    `component` the smallest fingerprint. Texts without words (null, empty, blanks)
    have fingerprint 0 and are linked like any other. Rows with a null doc_id take
    part; a component made of such rows alone has a null component_id. Repeated
    rows stay. Other columns of the input play no part. Empty input, empty result.
    """
    fps = materialize(fingerprints(docs, doc_id, text, width), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts = connected_components(links(nodes, distance))
    # Most fingerprints are alone: only the linked ones meet in an aggregation.
    linked = parts.withColumnRenamed("node", "fp").join(nodes, "fp")
    # Written, so that the join by component reads plain shuffles, of which Spark splits large parts.
    linked = materialize(linked, "simhash-linked")
    named = materialize(linked.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-named")
    linked = materialize(linked.join(named, "component").select("fp", "component", "component_id"), "simhash-components")
    alone = nodes.withColumnRenamed("least", "own")
    ids = alone.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "text_hash", "component_id", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def likely_copies(docs: DataFrame, width: int) -> DataFrame:
    """(a, b): text hashes of near fingerprints, one pair a fingerprint and one a text that shares its fingerprint."""
    fps = materialize(fingerprints(docs, width=width).select("fp", "text_hash").distinct(), "simhash")
    first = materialize(fps.groupBy("fp").agg(F.min("text_hash").alias("least")), "simhash-nodes")
    near = links(first).select(F.inline(F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("other")), F.struct(F.col("b").alias("fp"), F.col("a").alias("other")))))
    near = near.groupBy("fp").agg(F.min("other").alias("other"))
    other = first.select(F.col("fp").alias("other"), F.col("least").alias("b"))
    linked = near.join(first.withColumnRenamed("least", "a"), "fp").join(other, "other").select("a", "b")
    same = fps.join(first, "fp").where("text_hash <> least").select(F.col("least").alias("a"), F.col("text_hash").alias("b"))
    return materialize(linked.unionByName(same), "simhash-pairs")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of near copies stays.

    Multi-index hashing of the fingerprints of 5-word shingles finds likely copies; `similar_texts`
    verifies them by exact similarity and adds the copies whose fingerprints lie further apart. The row
    that stays has the smallest doc_id (nulls last); among rows that repeat that doc_id it is the one
    whose text hash is smallest, and one of identical rows.
    """
    bound_batches(spark)
    found = similar_texts(docs, likely=likely_copies(docs, WIDTH))
    found = materialize(found.select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("key")), "neardup")
    keys = found.groupBy("component", "key").agg(F.count(F.lit(1)).alias("n"))
    # Written, so that the join below reads plain shuffles, of which Spark splits large parts.
    chosen = materialize(found.groupBy("component").agg(F.min("key").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "neardup-chosen")
    judged = materialize(keys, "neardup-keys").join(chosen, "component").select(F.col("key.doc_id").alias("k_id"), F.col("key.text_hash").alias("k_hash"), "n", F.col("key").eqNullSafe(F.col("best")).alias("stays"))
    judged = materialize(judged.where(~F.col("stays") | (F.col("n") > 1)), "neardup-judged")
    same = docs["doc_id"].cast("long").eqNullSafe(judged["k_id"]) & (F.xxhash64(docs["text"]) == judged["k_hash"])
    kept = docs.join(judged, same, "left_anti")
    if judged.where("stays").isEmpty():
        return kept
    return kept.unionByName(docs.join(judged.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
