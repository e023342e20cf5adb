"""Comparing, fusing, deciding and explaining record pairs, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmint import dictionaries as D
from specmint.functions.text import flat
from specmint.operators.ranking import cumulative


@dataclass(frozen=True)
class ScoringConfig:
    """Weights, bands and the coverage floor; a plan holds them as literals."""

    cos: float = D.WEIGHT_COS
    fuzzy: float = D.WEIGHT_FUZZY
    attr: float = D.WEIGHT_ATTR
    discard: float = D.DISCARD_BELOW
    auto: float = D.AUTO_FROM
    coverage: int = D.MIN_COVERAGE


def compare(a: Column, b: Column, keys: Sequence[str] = D.HARD_KEYS) -> Column:
    """array<struct(key, a, b, verdict)> for the keys known on a side at least: MATCH, MISMATCH or UNKNOWN."""
    rows = []
    for k in keys:
        x, y = F.try_element_at(a, F.lit(k)), F.try_element_at(b, F.lit(k))
        verdict = F.when(x.isNull() & y.isNull(), F.lit(None)).when(x.isNull() | y.isNull(), F.lit("UNKNOWN")).when(x == y, F.lit("MATCH")).otherwise(F.lit("MISMATCH"))
        rows.append(F.struct(F.lit(k).alias("key"), x.alias("a"), y.alias("b"), verdict.alias("verdict")))
    return F.filter(F.array(*rows), lambda r: r["verdict"].isNotNull())


def keys_with(verdicts: Column, verdict: str) -> Column:
    return F.transform(F.filter(verdicts, lambda r: r["verdict"] == verdict), lambda r: r["key"])


def fuse(pairs: DataFrame, config: ScoringConfig = ScoringConfig(), cos: str = "cos", fuzzy: str = "fuz", a: str = "attrs_a", b: str = "attrs_b", provisional: Column | None = None, keys: Sequence[str] = D.HARD_KEYS) -> DataFrame:
    """Add verdicts, conflicts, coverage, attr, score_noveto, score, vetoed, capped and decision.

    A specification known on both sides and different vetoes the pair (score 0). Without a
    shared specification its weight goes to the other signals. AUTO_SUGGEST needs `coverage`
    shared specifications, else REVIEW, capped. Keys in `provisional` (proposed, not read)
    can veto but don't count for that floor. `attr` is null when nothing is shared.
    """
    out = pairs.withColumn("verdicts", compare(F.col(a), F.col(b), keys))
    out = out.withColumn("conflicts", keys_with(F.col("verdicts"), "MISMATCH")).withColumn("agreeing", keys_with(F.col("verdicts"), "MATCH"))
    known = F.size("conflicts") + F.size("agreeing")
    sure = F.concat("conflicts", "agreeing") if provisional is None else F.array_except(F.concat("conflicts", "agreeing"), provisional)
    out = out.withColumn("coverage", known).withColumn("coverage_verified", F.size(sure))
    out = out.withColumn("attr", F.when(F.col("coverage") > 0, F.size("agreeing") / F.col("coverage")))
    x, f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(cos))), F.col(fuzzy)
    both = config.cos + config.fuzzy
    base = F.when(F.col("attr").isNull(), (config.cos * x + config.fuzzy * f) / both).otherwise(config.cos * x + config.fuzzy * f + config.attr * F.col("attr"))
    out = out.withColumn("score_noveto", base).withColumn("vetoed", F.size("conflicts") > 0)
    out = out.withColumn("score", F.when(F.col("vetoed"), F.lit(0.0)).otherwise(F.col("score_noveto")))
    out = out.withColumn("capped", ~F.col("vetoed") & (F.col("score") >= config.auto) & (F.col("coverage_verified") < config.coverage))
    decision = F.when(F.col("vetoed"), "REJECTED_VETO").when(F.col("score") < config.discard, "DISCARD").when((F.col("score") < config.auto) | F.col("capped"), "REVIEW").otherwise("AUTO_SUGGEST")
    return out.withColumn("decision", decision)


#: What follows each governed verdict.
NEXT_STEP = {
    "IDENTICAL": "Ready for governed mapping",
    "EQUIVALENT": "Steward approval",
    "CONDITIONAL": "Engineering / steward review",
    "DIFFERENT": "No mapping proposed",
    "CONFLICT": "Merge blocked",
    "UNRESOLVED": "More evidence required",
}


def verdict(pairs: DataFrame, config: ScoringConfig = ScoringConfig(), text_a: str = "description_a", text_b: str = "description_b") -> DataFrame:
    """Add the governed state of a fused pair and its next step."""
    unknown = F.size(keys_with(F.col("verdicts"), "UNKNOWN"))
    agree = F.size("agreeing")
    strong = F.col("score") >= config.auto
    state = (
        F.when(F.col("vetoed"), "CONFLICT")
        .when((F.col("coverage") == 0) | (unknown > agree), "UNRESOLVED")
        .when(F.col("score") < config.discard, "DIFFERENT")
        .when(strong & (F.col("coverage") >= config.coverage) & (unknown == 0), F.when(flat(F.col(text_a)) == flat(F.col(text_b)), "IDENTICAL").otherwise("EQUIVALENT"))
        .otherwise("CONDITIONAL")
    )
    steps = F.create_map(*(F.lit(x) for e in NEXT_STEP.items() for x in e))
    return pairs.withColumn("verdict", state).withColumn("next_step", F.element_at(steps, F.col("verdict")))


def explain(pairs: DataFrame, config: ScoringConfig = ScoringConfig(), cos: str = "cos", fuzzy: str = "fuz") -> DataFrame:
    """Add `signals` (weight * value by signal) and `explanation`, a one-line text."""
    parts = F.struct((config.cos * F.col(cos)).alias("embedding"), (config.fuzzy * F.col(fuzzy)).alias("fuzzy"), (config.attr * F.coalesce("attr", F.lit(0.0))).alias("attributes"))
    lines = F.transform("verdicts", lambda r: F.concat(r["key"], F.lit(" "), F.coalesce(r["a"], F.lit("?")), F.lit(" / "), F.coalesce(r["b"], F.lit("?")), F.lit(" "), r["verdict"]))
    text = F.concat(F.col("decision"), F.lit(" at "), F.round("score", 3).cast("string"), F.when(F.size(lines) > 0, F.concat(F.lit(": "), F.array_join(lines, "; "))).otherwise(F.lit("")))
    return pairs.withColumn("signals", parts).withColumn("explanation", text)


def priority(pairs: DataFrame, value: str = "value_at_stake", by_value: bool = True, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Add uncertainty, thinness, value_pct and priority of a review queue.

    The percentile of value is a cumulative distribution over the queue: counts by distinct
    value, range-partitioned and summed up, so that no task gets them all.
    """
    mid, half = (config.discard + config.auto) / 2, (config.auto - config.discard) / 2
    out = pairs.withColumn("uncertainty", F.greatest(F.lit(0.0), 1 - F.abs(F.col("score") - mid) / half)).withColumn("thinness", 1 / (1 + F.col("coverage")))
    if not by_value:
        return out.withColumn("priority", 0.40 * F.col("uncertainty") + 0.30 * F.col("thinness"))
    counts = pairs.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = cumulative(counts, "v").select("v", (F.col("upto") / F.col("all")).alias("value_pct"))
    out = out.join(upto, out[value].eqNullSafe(upto["v"]), "left").drop("v")
    return out.withColumn("priority", 0.40 * F.col("uncertainty") + 0.30 * F.col("thinness") + 0.30 * F.col("value_pct"))


def merge_proposals(rules: Column, proposed: Column, least: float = 0.5) -> tuple[Column, Column]:
    """(attributes, provisional keys): read specifications win over proposals (map key -> struct(value, confidence))."""
    fit = F.map_filter(proposed, lambda k, v: v["value"].isNotNull() & (v["confidence"] >= least) & ~F.map_contains_key(rules, k))
    return F.map_concat(rules, F.transform_values(fit, lambda _, v: v["value"])), F.map_keys(fit)


#: Keys whose proposals are checked against a list, and how sure a proposal of either kind is.
ENUMERATED = ("material_grade", "seal_type", "thread", "schedule")
SURE_OF_LISTED, SURE_OF_NUMBER = 0.75, 0.60


def proposal_confidence(key: Column) -> Column:
    return F.when(key.isin(*ENUMERATED), F.lit(SURE_OF_LISTED)).otherwise(F.lit(SURE_OF_NUMBER))
