"""Exact line deduplication over the corpus, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import ascii_lower, table
from specmint.storage import materialize

BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of
    `min_chars` code points that `min_docs` different doc_ids hold lose all their
    lines except in the largest doc_id holding them. Keys meet as two independent
    64-bit hashes. Counting goes by (key, doc_id) first, so a line that a third of
    all documents share is counted by many tasks and only its sums meet.

    A null or empty text is one empty line. Rows with a null doc_id are kept as
    they are and count for no key. Rows that repeat a doc_id count once and lose
    the same keys. Other columns play no part. Empty input, empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = keyed.select("doc_id", "text_hash", "pos", ascii_lower(F.col("line")).alias("key"))
    keyed = keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    per_doc = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last_doc")).where(F.col("docs") >= min_docs)
    common = materialize(common.select("h1", "h2", "last_doc"), "lines-common")
    dropped = keyed.join(common, ["h1", "h2"]).where("doc_id <> last_doc")
    dropped = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    dropped = materialize(dropped, "lines-dropped").select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "drop")
    joined = rows.join(dropped, (rows["doc_id"] == F.col("d_id")) & (F.xxhash64(rows["text"]) == F.col("d_hash")), "left")
    # A column of its own: an array that a lambda names would be split anew for each of its elements.
    joined = joined.select("doc_id", "text", "drop", lines_of(F.col("text")).alias("every"))
    every = F.col("every")
    # array_except hashes both sides, so a long text with many dropped lines stays linear.
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("drop")))
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    return joined.select("doc_id", F.size(every).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
t AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
k AS (SELECT doc_id, pos, line, translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, coalesce(c.last_doc <> k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
