"""Evidence from standards: designations, edges, effects on decisions, retrieved text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmint.functions.text import designations
from specmint.operators.candidates import dot

#: How restrictive a decision is, and which relationships and verifications count.
RANK = {"AUTO_SUGGEST": 0, "REVIEW": 1, "DISCARD": 2, "REJECTED_VETO": 3, "REJECTED_STANDARD": 3}
SUPPORTING = ("EQUIVALENT", "SUPERSET", "SUBSTITUTE")
SOURCED = ("VERIFIED", "SCOPED")
SIMILARITY_FLOOR = 0.35


def cited(texts: DataFrame, known: DataFrame, text: str = "description", record: str = "record_id") -> DataFrame:
    """(record_id, standard_id): standards whose designation a text names; known: (normalised, standard_id)."""
    each = texts.select(F.col(record).alias("record_id"), F.explode(designations(F.col(text))).alias("normalised"))
    return each.join(known, "normalised").select("record_id", "standard_id").distinct()


def edges_between(pairs: DataFrame, cites: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, edge columns): edges between the standards of a pair's records, in either direction.

    Two equi-joins in opposite orientations are united; an OR in a join would compare all with all.
    """
    left, right = cites.select(F.col("record_id").alias("a"), F.col("standard_id").alias("sa")), cites.select(F.col("record_id").alias("b"), F.col("standard_id").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    one = both.join(edges, (F.col("sa") == F.col("source_standard")) & (F.col("sb") == F.col("target_standard")))
    two = both.join(edges, (F.col("sb") == F.col("source_standard")) & (F.col("sa") == F.col("target_standard")))
    return one.unionByName(two).drop("sa", "sb").distinct()


def sourced() -> Column:
    return F.col("verification").isin(*SOURCED) & (F.coalesce("citation", F.lit("")) != "")


def covers(attributes: Column) -> Column:
    """Whether an edge may speak about the attributes in question; an unscoped one may about all."""
    scope = F.coalesce("scoped_attributes", F.array().cast("array<string>"))
    return (F.size(scope) == 0) | ((F.size(attributes) > 0) & (F.size(F.array_except(attributes, scope)) == 0))


def assess(pairs: DataFrame, found: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Pairs (a, b, attributes) with `effect` and `citations`: BLOCKS over SUPPORTS over INFORMS over NONE."""
    rows = pairs.select("a", "b", F.col(attributes).alias("attributes")).join(found, ["a", "b"], "left")
    supports = F.col("relationship").isin(*SUPPORTING) & sourced() & covers(F.col("attributes"))
    rank = F.when(F.col("relationship").isNull(), 0).when(F.col("relationship") == "CONFLICT", 3).when(supports, 2).otherwise(1)
    rows = rows.withColumn("rank", rank)
    top = rows.groupBy("a", "b").agg(F.max("rank").alias("top"), F.collect_set(F.struct("rank", "citation")).alias("all"))
    cites = F.array_sort(F.array_distinct(F.transform(F.filter("all", lambda r: (r["rank"] == F.col("top")) & r["citation"].isNotNull()), lambda r: r["citation"])))
    return top.select("a", "b", F.get(F.array(*(F.lit(e) for e in ("NONE", "INFORMS", "SUPPORTS", "BLOCKS"))), F.col("top")).alias("effect"), cites.alias("citations"))


def rank_of(decision: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for e in RANK.items() for x in e)), decision)


def fold(decision: Column, effect: Column) -> Column:
    """The decision under standards evidence, which never makes it less restrictive."""
    return F.when((effect == "BLOCKS") & (rank_of(decision) < RANK["REJECTED_STANDARD"]), "REJECTED_STANDARD").otherwise(decision)


def evidence(assessed: DataFrame, found: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(a, b, verdict, summary, provenance): a row per edge and per retrieved chunk, or one that says nothing was found.

    `retrieved`: a, b, standard_code, similarity, citation, text; its text is never a verdict.
    """
    one = found.join(assessed.select("a", "b", "effect"), ["a", "b"]).select("a", "b", F.col("effect").alias("verdict"), F.concat_ws("; ", F.concat_ws(" ", "source_standard", "relationship", "target_standard"), F.concat(F.lit("verification "), "verification"), F.coalesce(F.concat(F.lit("source: "), "citation"), F.lit("no source on file"))).alias("summary"), F.when(sourced(), "VERIFIED").otherwise("DERIVED").alias("provenance"))
    short = F.when(F.char_length("text") > 240, F.concat(F.rtrim(F.substring("text", 1, 237)), F.lit("..."))).otherwise(F.col("text"))
    two = retrieved.select("a", "b", F.lit("REQUIRES_REVIEW").alias("verdict"), F.concat(F.col("standard_code"), F.lit(": "), short).alias("summary"), F.when(F.col("citation").isNotNull(), "VERIFIED").otherwise("DERIVED").alias("provenance"))
    rows = one.unionByName(two)
    none = assessed.where("effect = 'NONE'").join(rows.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return rows.unionByName(none.select("a", "b", F.lit("INFORMS").alias("verdict"), F.lit("no standards were cited by both records, and none were retrieved").alias("summary"), F.lit("DERIVED").alias("provenance")))


def nearest_chunks(chunks: DataFrame, query: Column, k: int = 5, floor: float = SIMILARITY_FLOOR, vector: str = "vector", ident: str = "chunk_id") -> DataFrame:
    """The k chunks most similar to a query vector, those under the floor left out; ties by id."""
    scored = chunks.withColumn("similarity", dot(F.col(vector), query))
    return scored.orderBy(F.desc("similarity"), ident).limit(k).where(F.col("similarity") >= floor)


def describe(chunks: DataFrame) -> DataFrame:
    """One row on an index: chunks, citable (with a citation that isn't empty), uncitable."""
    citable = F.coalesce(F.col("citation") != "", F.lit(False))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(citable, 1)).alias("citable"), F.count(F.when(~citable, 1)).alias("uncitable"))
