"""ERP tables: extract, rejects, export, write-back batches and their effect."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmint.functions import codes

#: ERP field lists, widths and client.
FIELDS = {
    "MARA": ("MANDT", "MATNR", "MTART", "MATKL", "MEINS", "ERSDA", "ERNAM", "ZZ_CPSE"),
    "MAKT": ("MANDT", "MATNR", "SPRAS", "MAKTX"),
    "MARC": ("MANDT", "MATNR", "WERKS", "ZZ_PLANT_NAME"),
    "MARD": ("MANDT", "MATNR", "WERKS", "LABST", "STPRS"),
    "Z_NMC_MAP": ("MANDT", "MATNR", "WERKS", "ZZNMC", "ZZNMC_CLASS", "ZZNMC_STATUS", "ZZNMC_CONF", "ZZ_UNCONFIRMED", "ZZ_VALID_FROM", "ZZ_SOURCE", "ZZ_APPROVER"),
}
TEXT_WIDTH, MATERIAL_WIDTH, PLANT_WIDTH, CLIENT = 40, 18, 4, "800"


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's CSV with its fields as strings; unknown columns are left out, absent ones are null."""
    found = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return found.select(*(F.col(f).cast("string").alias(f) if f in found.columns else F.lit(None).cast("string").alias(f) for f in FIELDS[table]))


def write_table(df: DataFrame, path: str, table: str) -> None:
    df.select(*FIELDS[table]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def preferred_text(makt: DataFrame) -> DataFrame:
    """(MATNR, MAKTX): the last English text of a material, else its first; `line` gives the order of rows."""
    english = F.col("SPRAS") == "EN"
    rank = F.struct(english.cast("int").alias("en"), F.when(english, F.col("line")).otherwise(-F.col("line")).alias("place"))
    return makt.groupBy("MATNR").agg(F.max_by("MAKTX", rank).alias("MAKTX"), F.count_distinct("MAKTX").alias("n_texts"))


def amount(value: Column) -> Column:
    """A number, 0 where it can't be read."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def joined_extract(mara: DataFrame, makt: DataFrame, marc: DataFrame, mard: DataFrame) -> DataFrame:
    """Every MARC row with its texts, stock and `reason`, null where the row is good.

    `matnr_collision` marks materials that several plants share: one text serves them all.
    """
    general = mara.groupBy("MATNR").agg(*(F.max(c).alias(c) for c in ("MTART", "MATKL", "MEINS", "ZZ_CPSE"))).withColumn("known", F.lit(True))
    stock = mard.groupBy("MATNR", "WERKS").agg(F.max("LABST").alias("LABST"), F.max("STPRS").alias("STPRS"))
    plants = marc.groupBy("MATNR").agg((F.count_distinct("WERKS") > 1).alias("matnr_collision"))
    out = marc.select("MATNR", "WERKS", "ZZ_PLANT_NAME").join(general, "MATNR", "left").join(preferred_text(makt), "MATNR", "left").join(stock, ["MATNR", "WERKS"], "left").join(plants, "MATNR", "left")
    blank = F.trim(F.coalesce("MAKTX", F.lit(""))) == ""
    return out.withColumn("reason", F.when(F.col("known").isNull(), "no MARA row").when(blank, "no MAKTX description"))


def extract(joined: DataFrame, cpse: str | None = None) -> DataFrame:
    """Records of the good rows of `joined_extract`."""
    good = joined.where("reason is null")
    return good.select(
        (F.lit(cpse) if cpse else F.coalesce("ZZ_CPSE", F.lit(""))).alias("cpse"),
        F.coalesce(F.nullif("ZZ_PLANT_NAME", F.lit("")), "WERKS").alias("plant"),
        F.col("MATNR").alias("legacy_code"),
        F.trim("MAKTX").alias("description"),
        F.lower(F.trim(F.coalesce("MEINS", F.lit("")))).alias("uom"),
        amount(F.col("LABST")).alias("qty"),
        amount(F.col("STPRS")).alias("unit_value"),
        F.col("MATNR").alias("matnr"),
        F.col("WERKS").alias("werks"),
        "matnr_collision",
    )


def rejects(joined: DataFrame) -> DataFrame:
    return joined.where("reason is not null").select(F.col("MATNR").alias("matnr"), F.col("WERKS").alias("werks"), "reason")


def text_pressure(descriptions: DataFrame, text: str = "description") -> DataFrame:
    """One row: n, over_limit, share_over_limit (4 decimals), mean_len (1), max_len, chars_lost."""
    n = F.char_length(text)
    over = F.count(F.when(n > TEXT_WIDTH, 1))
    return descriptions.agg(
        F.count(F.lit(1)).alias("n"),
        over.alias("over_limit"),
        F.coalesce(F.round(over / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("share_over_limit"),
        F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("mean_len"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_len"),
        F.coalesce(F.sum(F.greatest(n - TEXT_WIDTH, F.lit(0))), F.lit(0)).alias("chars_lost"),
    )


def plant_codes(plants: DataFrame) -> DataFrame:
    """(plant, werks): initials and a number per initials, in order of the name; never shared by two plants."""
    names = plants.select("plant").distinct()
    initials = F.array_join(F.transform(F.slice(F.split(F.trim("plant"), r"\s+"), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    rows = names.withColumn("base", F.rpad(F.when(initials == "", "PL").otherwise(initials), 2, "0"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("plant")) - 1
    return rows.select("plant", F.concat("base", F.lpad(place.cast("string"), 2, "0")).alias("werks"))


def plant_kind(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit("site")
    for word, kind in reversed((("refinery", "refinery"), ("terminal", "terminal"), ("depot", "depot"), ("petrochemical", "petrochemical"), ("plant", "plant"), ("station", "pipeline_station"))):
        out = F.when(low.contains(word), F.lit(kind)).otherwise(out)
    return out


def export(records: DataFrame, truncate: bool = True, created: str = "20180401") -> dict[str, DataFrame]:
    """Records (cpse, plant, werks, legacy_code, description, uom, qty, unit_value, category) as ERP tables."""
    r = records.withColumn("MATNR", F.substring(F.col("legacy_code").cast("string"), 1, MATERIAL_WIDTH)).withColumn("MANDT", F.lit(CLIENT))
    text = F.substring("description", 1, TEXT_WIDTH) if truncate else F.col("description")
    return {
        "MARA": r.select("MANDT", "MATNR", F.lit("ERSA").alias("MTART"), F.upper(F.substring("category", 1, 9)).alias("MATKL"), F.upper(F.substring("uom", 1, 3)).alias("MEINS"), F.lit(created).alias("ERSDA"), F.lit("LEGACY").alias("ERNAM"), F.col("cpse").alias("ZZ_CPSE")),
        "MAKT": r.select("MANDT", "MATNR", F.lit("EN").alias("SPRAS"), text.alias("MAKTX")),
        "MARC": r.select("MANDT", "MATNR", F.col("werks").alias("WERKS"), F.col("plant").alias("ZZ_PLANT_NAME")),
        "MARD": r.select("MANDT", "MATNR", F.col("werks").alias("WERKS"), F.col("qty").cast("string").alias("LABST"), F.col("unit_value").cast("string").alias("STPRS")),
    }


def payload(members: DataFrame, resolved: DataFrame, registry: DataFrame, now: Column, source: str, approver: str) -> DataFrame:
    """Rows of the mapping table for linked members (record_id, matnr, werks, code, link_status, unknown_keys)."""
    live = members.join(resolved, "code").join(registry.select(F.col("code").alias("live_code"), "class_code"), "live_code", "left")
    return live.select(
        F.lit(CLIENT).alias("MANDT"),
        F.col("matnr").alias("MATNR"),
        F.col("werks").alias("WERKS"),
        F.col("live_code").alias("ZZNMC"),
        F.coalesce("class_code", F.lit("")).alias("ZZNMC_CLASS"),
        F.when(F.col("hops") > 0, "S").otherwise("A").alias("ZZNMC_STATUS"),
        F.when(F.col("link_status") == "PROVISIONAL", "P").otherwise("C").alias("ZZNMC_CONF"),
        F.array_join(F.coalesce("unknown_keys", F.array().cast("array<string>")), ";").alias("ZZ_UNCONFIRMED"),
        F.date_format(now, "yyyyMMdd").alias("ZZ_VALID_FROM"),
        F.lit(source).alias("ZZ_SOURCE"),
        F.lit(approver).alias("ZZ_APPROVER"),
    )


def delta(new: DataFrame, effective: DataFrame) -> DataFrame:
    """Rows that are new or differ in code, status or confirmation from the accumulated effective state."""
    old = effective.select("MATNR", "WERKS", *(F.col(c).alias(f"old_{c}") for c in ("ZZNMC", "ZZNMC_STATUS", "ZZNMC_CONF")))
    same = F.col("ZZNMC").eqNullSafe(F.col("old_ZZNMC")) & F.col("ZZNMC_STATUS").eqNullSafe(F.col("old_ZZNMC_STATUS")) & F.col("ZZNMC_CONF").eqNullSafe(F.col("old_ZZNMC_CONF"))
    return new.join(old, ["MATNR", "WERKS"], "left").where(~same).select(*new.columns)


def effective_state(batches: DataFrame) -> DataFrame:
    """Per (MATNR, WERKS) the last row of all batches that weren't revoked (batch_no, revoked)."""
    live = batches.where("not revoked")
    last = live.groupBy("MATNR", "WERKS").agg(F.max_by(F.struct(*FIELDS["Z_NMC_MAP"][3:]), "batch_no").alias("r"))
    return last.select("MATNR", "WERKS", "r.*")


def digest(rows: DataFrame) -> DataFrame:
    """One row (rows, payload_sha256): a hash of the rows' own hashes in order, independent of partitions.

    Each row is hashed where it lies; hashes meet by prefix, and the prefixes' hashes by order.
    """
    line = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), 256)
    by_prefix = rows.select(line.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return by_prefix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda r: r["h"]), ""), 256).alias("payload_sha256"))


def emit_batch(rows: DataFrame, folder: str, batch_no: int, mode: str = "full", revoked: bool = False) -> dict:
    """Write a batch's rows and manifest; the id has a running number, so no two share a name."""
    spark = rows.sparkSession
    path = f"{folder}/batch={batch_no:08d}"
    rows.select(*FIELDS["Z_NMC_MAP"]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/payload")
    found = digest(read_table(spark, f"{path}/payload", "Z_NMC_MAP")).first()
    counts = rows.agg(F.count_distinct("ZZNMC").alias("codes"), F.count(F.when(F.col("ZZNMC_CONF") == "P", 1)).alias("provisional")).first()
    manifest = {"batch_no": batch_no, "mode": mode, "rows": found["rows"], "payload_sha256": found["payload_sha256"], "distinct_codes": counts["codes"], "rows_provisional": counts["provisional"], "revoked": revoked}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, folder: str, batch_no: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/batch={batch_no:08d}/manifest").first()[0])


def verify_batch(spark: SparkSession, folder: str, batch_no: int) -> bool:
    """Whether the payload still has the manifest's hash."""
    now = digest(read_table(spark, f"{folder}/batch={batch_no:08d}/payload", "Z_NMC_MAP")).first()
    return now["payload_sha256"] == read_manifest(spark, folder, batch_no)["payload_sha256"]


def revoke_batch(spark: SparkSession, folder: str, batch_no: int) -> dict:
    """Mark a batch revoked; its payload stays."""
    manifest = read_manifest(spark, folder, batch_no) | {"revoked": True}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/batch={batch_no:08d}/manifest")
    return manifest


def judged_batch(rows: DataFrame, marc: DataFrame) -> DataFrame:
    """Batch rows with `reason`, the first rule that a row breaks: client, key, check digit, length."""
    known = marc.select("MATNR", "WERKS").distinct().withColumn("there", F.lit(True))
    valid = F.coalesce(codes.parse(F.coalesce("ZZNMC", F.lit("")))["valid"], F.lit(False))
    reason = (
        F.when(~F.col("MANDT").eqNullSafe(F.lit(CLIENT)), "wrong client (MANDT)")
        .when(F.col("there").isNull(), "material/plant not in material master")
        .when(~valid, "national code fails its check digit")
        .when(F.char_length("MATNR") > MATERIAL_WIDTH, "MATNR too long")
    )
    return rows.join(known, ["MATNR", "WERKS"], "left").withColumn("reason", reason).drop("there")


def master_after(marc: DataFrame, makt: DataFrame, applied: DataFrame) -> DataFrame:
    """The material master with codes beside it; blanks where none was applied."""
    z = applied.select("MATNR", "WERKS", "ZZNMC", "ZZNMC_STATUS", "ZZNMC_CONF")
    out = marc.join(preferred_text(makt).select("MATNR", "MAKTX"), "MATNR", "left").join(z, ["MATNR", "WERKS"], "left")
    return out.select("MATNR", "WERKS", F.col("ZZ_PLANT_NAME").alias("PLANT"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("MAKTX", "ZZNMC", "ZZNMC_STATUS", "ZZNMC_CONF")))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent import: incoming rows replace current ones of the same natural key."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.dropDuplicates(keys))


def open_items(refusals: DataFrame, provisional: DataFrame) -> DataFrame:
    """(kind, detail, note, reference) of refused groups and unconfirmed links."""
    left = refusals.select(F.lit("refused").alias("kind"), F.col("reason").alias("detail"), F.col("detail").alias("note"), F.col("group_key").alias("reference"))
    right = provisional.select(F.lit("provisional").alias("kind"), F.concat_ws(" ", "cpse", "legacy_code").alias("detail"), F.concat(F.lit("could not confirm: "), F.array_join("unknown_keys", ";")).alias("note"), F.col("code").alias("reference"))
    return left.unionByName(right)
