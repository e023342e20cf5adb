"""A labelled benchmark of material records, generated in parallel and reproducibly.

Every value is a function of the record's or item's number and a seed, so partitions and
retries don't matter. Each item is a class with drawn specifications; its records render
the description anew and corrupt it by a recipe. Split is by family, so no family is torn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Templates and what fills them; the last column names the slot whose neighbour makes a hard negative.
ITEMS = (
    ("hexagonal bolt {0} x {1} mm {2}", (("M8", "M10", "M12", "M16", "M20"), ("25", "40", "50", "65", "80"), ("stainless steel 316", "mild steel", "carbon steel")), "nos"),
    ("gate valve {0} inch class {1} {2}", (("1", "2", "3", "4", "6"), ("150", "300", "600"), ("carbon steel", "cast iron", "wcb")), "nos"),
    ("seamless pipe {0} inch sch{1} {2}", (("1", "2", "4", "6", "8"), ("40", "80", "160"), ("carbon steel", "mild steel")), "m"),
    ("xlpe armoured cable {0} core {1} sqmm {2} kv", (("2", "3", "4"), ("25", "50", "95", "185"), ("1.1", "6.6", "33")), "m"),
    ("ball bearing {0} {1}", (("6204", "6205", "6206", "6305"), ("2RS", "ZZ")), "nos"),
    ("induction motor {0} kw {1} rpm", (("5.5", "7.5", "11", "15"), ("960", "1440", "2900")), "nos"),
)
SITES = {"ALFA": ("North Refinery", "South Terminal"), "BETA": ("Harbour Depot", "Hill Station"), "GAMA": ("Delta Plant", "River Refinery")}
SHORT = (("hexagonal", "hex"), ("stainless steel", "ss"), ("carbon steel", "cs"), ("mild steel", "ms"), ("gate valve", "gt vlv"), ("seamless", "smls"), ("bearing", "brg"), ("motor", "mtr"), ("cable", "cbl"), ("bolt", "blt"))


def draw(number: Column, what: str, n: int | Column, seed: int) -> Column:
    """A fixed pseudo-random integer below n."""
    return F.pmod(F.xxhash64(number, F.lit(what), F.lit(seed)), F.lit(n) if isinstance(n, int) else n).cast("int")


def pick(number: Column, what: str, options: tuple[str, ...], seed: int) -> Column:
    return F.get(F.array(*(F.lit(o) for o in options)), draw(number, what, len(options), seed))


def _render(item: Column, seed: int) -> Column:
    out = F.lit(None).cast("string")
    for k, (template, slots, _) in enumerate(ITEMS):
        text = F.lit(template)
        for j, options in enumerate(slots):
            text = F.replace(text, F.lit(f"{{{j}}}"), pick(item, f"slot{j}", options, seed))
        out = F.when(F.pmod(item, F.lit(len(ITEMS))) == k, text).otherwise(out)
    return out


def _corrupt(text: Column, record: Column, seed: int) -> Column:
    recipe = draw(record, "recipe", 8, seed)
    short = text
    for long, brief in SHORT:
        short = F.replace(short, F.lit(long), F.lit(brief))
    at = draw(record, "typo", F.greatest(F.char_length(text) - 8, F.lit(1)), seed) + 5
    typo = F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.lit(200)))
    return (
        F.when(recipe == 0, F.upper(text))
        .when(recipe == 1, short)
        .when(recipe == 2, F.upper(short))
        .when(recipe == 3, F.regexp_replace(text, r"\s*x\s*", "X"))
        .when(recipe == 4, F.regexp_replace(text, r"(\d) mm\b", "$1MM"))
        .when(recipe == 5, F.concat(text, F.lit(" "), pick(record, "noise", ("store item", "as per drawing", "shutdown spare"), seed)))
        .when(recipe == 6, F.substring(text, 1, 46))
        .otherwise(typo)
    )


def records(spark: SparkSession, n: int, per_item: int = 4, seed: int = 20260908) -> DataFrame:
    """(record_id, cpse, plant, legacy_code, description, uom, qty, unit_value, cluster_id, family_id, split, recipe)."""
    r = spark.range(n).select(F.col("id").alias("record_id"))
    item = F.floor(F.col("record_id") / per_item).cast("long")
    r = r.withColumn("cluster_id", item).withColumn("family_id", F.floor(item / 2).cast("long"))
    part = draw(F.col("family_id"), "split", 20, seed)
    r = r.withColumn("split", F.when(part < 14, "dev").when(part < 17, "val").otherwise("test"))
    r = r.withColumn("cpse", pick(F.col("record_id"), "cpse", tuple(SITES), seed))
    plants = F.create_map(*(x for c, s in SITES.items() for x in (F.lit(c), F.array(*(F.lit(p) for p in s)))))
    r = r.withColumn("plant", F.get(F.element_at(plants, F.col("cpse")), (F.col("record_id") % 2).cast("int")))
    units = F.array(*(F.lit(u) for _, _, u in ITEMS))
    return r.select(
        "record_id",
        "cpse",
        "plant",
        (10000 + draw(F.col("record_id"), "legacy", 5000, seed)).cast("string").alias("legacy_code"),
        _corrupt(_render(F.col("cluster_id"), seed), F.col("record_id"), seed).alias("description"),
        F.get(units, F.pmod(F.col("cluster_id"), F.lit(len(ITEMS))).cast("int")).alias("uom"),
        draw(F.col("record_id"), "qty", 500, seed).cast("double").alias("qty"),
        (1 + draw(F.col("cluster_id"), "value", 9000, seed)).cast("double").alias("unit_value"),
        "cluster_id",
        "family_id",
        "split",
        draw(F.col("record_id"), "recipe", 8, seed).alias("recipe"),
    )


def true_pairs(generated: DataFrame) -> DataFrame:
    """(a, b, split): records of one item."""
    left, right = generated.select("cluster_id", "split", F.col("record_id").alias("a")), generated.select("cluster_id", F.col("record_id").alias("b"))
    return left.join(right, "cluster_id").where("a < b").select("a", "b", "split")


def sibling_pairs(generated: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, split): up to `most` hard negatives per family, one record of each of its two items."""
    first = generated.groupBy("family_id", "split", "cluster_id").agg(F.slice(F.array_sort(F.collect_list("record_id")), 1, most).alias("r"))
    left, right = first.select("family_id", "split", F.col("cluster_id").alias("c"), F.col("r").alias("x")), first.select("family_id", F.col("cluster_id").alias("d"), F.col("r").alias("y"))
    return left.join(right, "family_id").where("c < d").select("split", F.inline(F.arrays_zip("x", "y"))).where("x is not null and y is not null").select(F.col("x").alias("a"), F.col("y").alias("b"), "split")
