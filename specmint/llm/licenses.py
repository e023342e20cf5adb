"""License scans by diagonal voting, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmint.llm.common import ascii_lower, table

GRAM = 3
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.8
#: Diagonals this near belong to one span: so many words may be put in or left out.
SLACK = 3
#: Template positions that one bit mask holds.
BITS = 62

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the contract, whose every place counts.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Wording of public license notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, -1), "")


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, places, labels, base_labels, spans, score) per input row.

    Every word position makes the hash of the GRAM words that begin there. A hash-join
    with the template positions (a fixed table of some hundred rows, hence broadcast)
    gives votes; each vote compares its words, so a hash collision casts none. Votes are
    gathered by (row, template, diagonal = position - template position) before anything is
    shuffled, as a bit per template position: what leaves a task is one row per document
    and diagonal that was hit. A phrase stands where one diagonal has all its positions. For a
    notice, each diagonal is merged with those at most SLACK after it. A span is verified if
    COVERAGE of the template's positions, each counted once however often its words are
    repeated, stand there word for word; it is at most SLACK words longer than the template,
    and of neighbouring spans the first is kept.

    `places` are the starts of the phrases in order; `spans` are structs (label, start,
    coverage), start being the first word that agrees; `score` is the best coverage (0 without a
    vote). A null, empty or wordless text has n_words 0, empty arrays and score 0. Each row is
    scanned for itself, so repeated rows and null ids stay as they are. Empty input, empty result;
    other columns play no part.
    """
    spark = docs.sparkSession
    kinds = [(label, words.split(), True) for label, words in phrases] + [(label, words.split(), False) for label, words in notices]
    grams = [(k, i, i // BITS, 1 << i % BITS, *words[i : i + GRAM]) for k, (_, words, _) in enumerate(kinds) for i in range(len(words) - GRAM + 1)]
    names = ["template", "at", "part", "bit", *(f"g{j}" for j in range(GRAM))]
    templates = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).cast("long" if n == "bit" else "string" if n[0] == "g" else "int").alias(n) for n, v in zip(names, g, strict=True))) for g in grams))))
    templates = templates.withColumn("h", F.xxhash64(*names[4:]))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    each = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "w0"))
    each = each.select("rid", "doc_id", "n_words", "pos", "w0", *(F.get("words", F.col("pos") + j).alias(f"w{j}") for j in range(1, GRAM)))
    each = each.withColumn("h", F.xxhash64(*(f"w{j}" for j in range(GRAM))))
    same = F.col("e.h") == F.col("t.h")
    for j in range(GRAM):
        same &= F.col(f"e.w{j}") == F.col(f"t.g{j}")
    votes = each.alias("e").join(F.broadcast(templates).alias("t"), same, "left")
    masks = [f"mask{j}" for j in range(1 + max(part for _, _, part, *_ in grams))]
    diagonals = votes.groupBy("e.rid", "e.doc_id", "e.n_words", "t.template", (F.col("e.pos") - F.col("t.at")).alias("diagonal")).agg(F.min("e.pos").alias("first"), *(F.bit_or(F.when(F.col("t.part") == j, F.col("t.bit"))).alias(m) for j, m in enumerate(masks)))

    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    diagonals = diagonals.withColumn("full", of([len(words) - GRAM + 1 for _, words, _ in kinds])).withColumn("label", of([label for label, _, _ in kinds])).withColumn("phrase", of([base for _, _, base in kinds]))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    near = order.rangeBetween(0, SLACK)
    count = lambda masked: sum((F.coalesce(F.bit_count(masked(m)), F.lit(0)) for m in masks), F.lit(0))
    own, merged = count(F.col), count(lambda m: F.bit_or(m).over(near))
    spans = diagonals.withColumn("coverage", F.when(F.col("phrase"), own).otherwise(merged) / F.col("full")).withColumn("start", F.when(F.col("phrase"), F.col("first")).otherwise(F.min("first").over(near)))
    enough = F.col("coverage") >= F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(COVERAGE))
    before = F.max(F.when(F.col("enough"), F.col("diagonal"))).over(order.rangeBetween(-SLACK, -1))
    spans = spans.withColumn("enough", enough).withColumn("hit", F.col("enough") & (F.col("phrase") | before.isNull()))

    place = F.col("phrase") & F.col("hit")
    out = spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(place, F.col("start").cast("long")))).alias("places"),
        F.array_sort(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("label", F.col("start").cast("long").alias("start"), "coverage")))).alias("spans"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), "places", "labels", "base_labels", "spans", "score")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _oracle() -> str:
    kinds = [(label, words.split(), True) for label, words in PHRASES] + [(label, words.split(), False) for label, words in NOTICES]
    text = lambda row: "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() for v in row) + ")"
    grams = ", ".join(text((k, i, *words[i : i + GRAM])) for k, (_, words, _) in enumerate(kinds) for i in range(len(words) - GRAM + 1))
    names = ", ".join(text((k, label, len(words) - GRAM + 1, base)) for k, (label, words, base) in enumerate(kinds))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS g0, unnest(ws[2:]) AS g1, unnest(ws[3:]) AS g2 FROM w),
t(template, off, g0, g1, g2) AS (VALUES {grams}),
k(template, label, whole, phrase) AS (VALUES {names}),
d AS (SELECT doc_id, template, pos - off AS diagonal, min(pos) AS first, bit_or(CAST(1 AS BIGINT) << off) AS mask FROM p JOIN t USING (g0, g1, g2) GROUP BY ALL),
m AS (SELECT d.*, label, phrase, CASE WHEN phrase THEN first ELSE min(first) OVER o END AS start, CAST(bit_count(CASE WHEN phrase THEN mask ELSE bit_or(mask) OVER o END) AS DOUBLE) / whole AS coverage
  FROM d JOIN k USING (template) WINDOW o AS (PARTITION BY doc_id, d.template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING)),
s AS (SELECT *, coverage >= CASE WHEN phrase THEN 1 ELSE {COVERAGE} END AS hit FROM m),
f AS (SELECT doc_id, count(CASE WHEN phrase AND hit THEN 1 END) AS n_base, min(CASE WHEN phrase AND hit THEN start END) AS first_word, max(CASE WHEN phrase AND hit THEN start END) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase AND hit))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE hit))), ',') AS labels, max(coverage) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM w LEFT JOIN f ON w.doc_id = f.doc_id
"""


OP1_SQL = _oracle()
