"""The exact check of near-duplicates: similarity of word shingles, made complete by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmint.llm.common import slices, sum_vectors
from specmint.operators.components import connected_components
from specmint.storage import materialize

WIDTH = 5
#: Two texts are near copies when their sets of shingles share TENTHS / 10 or more of their union.
TENTHS = 8
#: Buckets that shingles are counted in; the counts only order shingles, so a collision costs time and no pair.
BITS = 20
#: The first round compares with one text per shingle, each further one with HUBS times as many, the last with all:
#: that is due as soon as no more pairs than PAIRS_PER_ROW a row are left.
HUBS, PAIRS_PER_ROW = 8, 2
_CHUNK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; beyond `limit` words the cache takes no more."""

    def __init__(self, limit: int = 100_000) -> None:
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Words are lower-cased ASCII-wise; a text under WIDTH words is one shingle, one without words none."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for i, b in enumerate(got):
                if b is None:
                    b = got[i] = xxhash.xxh64_intdigest(words[i])
                    if len(known) < self.limit:
                        known[words[i]] = b
        ids = np.array(got, np.uint64)
        n = max(1, len(ids) - WIDTH + 1)
        h = np.full(n, min(len(ids), WIDTH), np.uint64)
        for j in range(min(len(ids), WIDTH)):
            h = (h ^ ids[j : j + n]) * _STEP
            h ^= h >> np.uint64(29)
        return np.unique(h)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BITS)).astype(np.int64)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each bucket; vectors of a fixed length meet in a tree of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        maker, counts = Shingler(), np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, _bucket(maker.shingles(text.as_py())), 1)
        part = TaskContext.get().partitionId()
        pieces = [(k, counts[i : i + _CHUNK]) for k, i in enumerate(range(0, len(counts), _CHUNK)) if counts[i : i + _CHUNK].any()]
        if pieces:
            yield pa.RecordBatch.from_pydict({"key": [f"{k:04d}" for k, _ in pieces], "part": pa.array([part] * len(pieces), pa.int32()), "vec": [v.astype("<f8").tobytes() for _, v in pieces]})

    counts = np.zeros(1 << BITS, np.uint32)
    parts = texts.mapInArrow(run, "key string, part int, vec binary")
    for r in sum_vectors(parts, texts.rdd.getNumPartitions()).collect():
        at = int(r["key"]) * _CHUNK
        counts[at : at + _CHUNK] = np.minimum(np.frombuffer(r["vec"], "<f8"), 2**32 - 1)
    return counts


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of the asked similarity share one.

    The order by (count, hash) is the same for all texts. Similar sets of n and m shingles share
    at least TENTHS / 10 of max(n, m), hence one within the first n - ceil(TENTHS n / 10) + 1 of n.
    """
    n = len(shingles)
    return shingles[np.lexsort((shingles, counts[_bucket(shingles)]))[: n - -(-TENTHS * n // 10) + 1]] if n else shingles


def similar(a: str, b: str, common: str) -> Column:
    """Whether sets of sizes a and b with `common` shared members are near copies."""
    return 10 * F.col(common) >= TENTHS * (F.col(a) + F.col(b) - F.col(common))


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) with their sets' sizes and the number of shared members."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def _likely(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs whose prefixes share enough for the whole sets to be near copies.

    Shared shingles up to the end of the prefix that ends first lie in both prefixes; the rest come
    after it in a set, where ceil(TENTHS n / 10) - 1 shingles are left. So this drops no near copies.
    """
    most = F.col("common") + F.ceil(F.lit(TENTHS) * F.col("larger") / 10) - 1
    return _common(pairs, outlines).where(10 * most >= TENTHS * (F.col("total") - most)).select("a", "b")


def early(n: Column, place: Column) -> Column:
    """Whether the smaller of two near copies can meet the other first at this place of its order.

    From there on it has n - place shingles, of which the pair shares at least
    TENTHS / (10 + TENTHS) of both sizes and so 2 TENTHS / (10 + TENTHS) of the smaller one's n.
    """
    return (10 + TENTHS) * (n - place) >= 2 * TENTHS * n


def _pairs_left(placed: DataFrame) -> tuple[int, int, int]:
    """(pairs of an early place and another component's place of the same shingle, rows, most early places of a shingle)."""
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("early"), 1)).alias("e"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum(F.col("n") * F.col("e")).alias("within"))
    r = sizes.agg(F.sum(F.col("n") * F.col("e") - F.col("within")).alias("pairs"), F.sum("n").alias("rows"), F.max("e").alias("most")).first()
    return r["pairs"] or 0, r["rows"] or 0, r["most"] or 0


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", likely: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, component) per input row; rows of a component are linked by near copies.

    Equal sets of shingles are one node. `likely` has pairs (a, b) of text hashes that some faster
    search has found; they are verified first. Nodes that are similar meet in a shingle of their
    prefixes, at an early place of the smaller one (see `early`), so no pair is missed. Shingle by
    shingle, nodes are compared with one early node, then with HUBS times as many a round, and at
    last with all; only nodes of different components are. Pairs within one component can't
    change the result and aren't formed, so a large group of near copies costs some rows per
    shingle and not its square, and texts that share a passage and not much else have no early
    place in it. Every pair that the places and the prefixes don't rule out is verified on the whole
    sets. Texts without words are one component.
    Repeated rows and null ids stay. Empty input, empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(shingle_counts(rows.select("text")))
    long_list = pa.list_(pa.int64())

    def signed(x: list[np.ndarray]) -> pa.Array:
        return pa.array([v.view(np.int64) for v in x], long_list)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, counts = Shingler(), shared.value
        for some in (x for batch in batches for x in slices(batch, 2)):
            sets = [maker.shingles(t.as_py()) for t in some.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), signed([prefix(s, counts) for s in sets])], ["doc_id", "text_hash", "node", "n", "keys"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingler()
        for some in (x for batch in batches for x in slices(batch, 1)):
            yield pa.RecordBatch.from_arrays([some.column(0), signed([maker.shingles(t.as_py()) for t in some.column(1)])], ["node", "shingles"])

    found = materialize(rows.mapInArrow(outline, "doc_id long, text_hash long, node long, n int, keys array<long>"), "shingle-prefixes")
    # Every row of a node has the same set, so that one row per node may be any.
    lone = found.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
    keyed = found.select("node", "n", F.posexplode("keys").alias("place", "key")).withColumn("early", early(F.col("n"), F.col("place")))
    often = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("early").alias("open")).where("low <> high").select("key", "open")
    common = materialize(keyed.join(often, "key").distinct(), "shingle-keys")
    outlines = materialize(common.groupBy("node").agg(F.collect_list("key").alias("shingles")), "shingle-outlines")
    posted = common.where("open").drop("open")

    def verified(pairs: DataFrame) -> DataFrame:
        near = materialize(_likely(pairs, outlines), "shingle-likely")
        needed = lone.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        texts = rows.select("text_hash", "text").join(needed, "text_hash").select("node", "text").dropDuplicates(["node"])
        sets = materialize(texts.mapInArrow(whole, "node long, shingles array<long>"), "shingle-sets")
        both = _common(near.select("a", "b"), sets)
        return materialize(both.where(similar("na", "nb", "common")).select("a", "b"), "shingle-edges")

    def side(of: DataFrame, mark: str) -> DataFrame:
        return of.select("key", F.col("node").alias(mark), F.col("n").alias(f"n{mark}"), F.col("place").alias(f"p{mark}"), F.col("component").alias(f"c{mark}"))

    def as_pairs(met: DataFrame) -> DataFrame:
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("total"), F.greatest("nx", "ny").alias("larger")).distinct()

    # Where a pair meets first, all it shares are that shingle and what comes after it in both orders.
    fits = (F.col("cx") != F.col("cy")) & (F.col("ny") <= F.col("nx")) & (10 * F.col("ny") >= TENTHS * F.col("nx"))
    fits &= (10 + TENTHS) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= TENTHS * (F.col("nx") + F.col("ny"))
    edges = tried = linked = None
    placed, hubs, last = posted.withColumn("component", F.col("node")), 1, False
    while not last:
        if likely is not None:
            of = found.select("text_hash", "node", "n").distinct()
            x, y = (of.select(F.col("text_hash").alias(h), F.col("node").alias(m), F.col("n").alias(f"n{m}")) for h, m in (("a", "x"), ("b", "y")))
            pairs, likely = as_pairs(likely.join(x, "a").join(y, "b").where("x <> y")), None
        else:
            left, size, most = _pairs_left(placed)
            last = left <= PAIRS_PER_ROW * size or hubs >= most
            first = placed.where("early")
            if not last:
                some = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(hubs)), "node"))
                first = first.withColumn("number", some).where(F.col("number") <= hubs)
                hubs *= HUBS
            other = side(first, "y").withColumnRenamed("key", "other")
            pairs = as_pairs(side(placed, "x").join(other, (F.col("key") == F.col("other")) & fits))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "shingle-pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        new = verified(pairs)
        edges = new if edges is None else edges.unionByName(new)
        linked = materialize(connected_components(edges), "shingle-components")
        if not last:
            placed = posted.join(linked, "node", "left").select("key", "node", "n", "place", "early", F.coalesce("component", "node").alias("component"))
            # A shingle whose texts are all in one component has no pair left.
            mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
            placed = materialize(placed.join(mixed, "key"), "shingle-keys")
    return found.join(linked, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
