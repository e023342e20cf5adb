"""National codes as set operations: issuing, supersession, links, catalogue, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmint.functions import codes
from specmint.operators.ranking import ranked
from specmint.storage import materialize


def plan_groups(groups: DataFrame, live: DataFrame, strict: bool = True) -> DataFrame:
    """Add class_code, spec_signature and status to groups (group_id, category, attrs, members array<long>).

    `live` has (record_id, code, issued). Status: refused_unclassified, refused_incomplete,
    reused (one live code among the members), consolidated (several: the oldest stays) or
    issued. `strict` asks for every defining specification, otherwise one is enough.
    """
    out = groups.withColumn("class_code", codes.class_of(F.col("category"))).withColumn("spec_signature", codes.signature(F.col("class_code"), F.col("attrs")))
    enough = codes.signature_complete(F.col("class_code"), F.col("attrs")) if strict else F.size("attrs") > 0
    held = groups.select("group_id", F.explode("members").alias("record_id")).join(live, "record_id").groupBy("group_id")
    held = held.agg(F.min_by("code", F.struct("issued", "code")).alias("keeps"), F.array_sort(F.collect_set("code")).alias("held"))
    out = out.join(held, "group_id", "left")
    status = (
        F.when(F.col("class_code") == "99.99.99", "refused_unclassified")
        .when(~enough, "refused_incomplete")
        .when(F.size(F.coalesce("held", F.array().cast("array<string>"))) > 1, "consolidated")
        .when(F.col("keeps").isNotNull(), "reused")
        .otherwise("issued")
    )
    return out.withColumn("status", status)


def issue(planned: DataFrame, last_serials: DataFrame) -> DataFrame:
    """Add serial and code to planned groups: per class, the next serials in order of group_id.

    Groups are ranked by (class, id) over range partitions, and a class starts at its smallest rank: classes
    are few, so numbering by class alone would be as many tasks, whatever the data.
    """
    new = ranked(planned.where(F.col("status") == "issued").select("class_code", "group_id"), [F.col("class_code"), F.col("group_id")])
    starts = new.groupBy("class_code").agg(F.min("rank").alias("start"))
    new = new.join(F.broadcast(starts), "class_code").withColumn("place", F.col("rank") - F.col("start") + 1)
    new = new.join(F.broadcast(last_serials.select("class_code", "last_serial")), "class_code", "left")
    new = new.withColumn("serial", (F.coalesce("last_serial", F.lit(0)) + F.col("place")).cast("long"))
    new = new.select("group_id", "serial", codes.mint(F.col("class_code"), F.col("serial")).alias("new_code"))
    return planned.join(new, "group_id", "left").withColumn("code", F.coalesce("new_code", F.when(F.col("status").isin("reused", "consolidated"), F.col("keeps")))).drop("new_code")


def supersede(planned: DataFrame) -> DataFrame:
    """(code, superseded_by) for the younger codes of consolidated groups."""
    return planned.where("status = 'consolidated'").select(F.explode("held").alias("code"), F.col("keeps").alias("superseded_by")).where("code <> superseded_by")


def resolve(registry: DataFrame) -> DataFrame:
    """(code, live_code, hops): supersession followed to its end, however long, by pointer doubling.

    Each round doubles the hops of every code whose end isn't known yet, and looks it up among those whose
    end is. It stops when all are known or when as many hops are made as there are codes: what then
    still moves is on a cycle or leads into one and has a null live_code, as has a chain that
    ends at an unknown code.
    """
    done = materialize(registry.where("superseded_by is null").select("code", F.col("code").alias("live_code"), F.lit(0).alias("hops")), "chains-done")
    moving = materialize(registry.where("superseded_by is not null").select("code", F.col("superseded_by").alias("at"), F.lit(1).alias("hops")), "chains")
    step, n = 1, registry.count()
    while not moving.isEmpty() and step <= 2 * n:
        known = done.select(F.col("code").alias("at"), "live_code", F.col("hops").alias("more"))
        found = moving.join(known, "at").select("code", "live_code", (F.col("hops") + F.col("more")).alias("hops"))
        ahead = moving.select(F.col("code").alias("at"), F.col("at").alias("further"), F.col("hops").alias("more"))
        left = moving.join(known.select("at"), "at", "left_anti").join(ahead, "at")
        done, moving = materialize(done.unionByName(found), "chains-done"), materialize(left.select("code", F.col("further").alias("at"), (F.col("hops") + F.col("more")).alias("hops")), "chains")
        step *= 2
    return registry.select("code").join(done, "code", "left").select("code", "live_code", "hops")


def grade_links(members: DataFrame) -> DataFrame:
    """Add `support` and `link_status` to (class_code, attrs, spec_signature): CONFIRMED, PROVISIONAL or HELD."""
    out = members.withColumn("support", codes.support(F.col("class_code"), F.col("attrs"), F.col("spec_signature")))
    return out.withColumn("link_status", F.when(F.col("support") == "confirmed", "CONFIRMED").when(F.col("support") == "provisional", "PROVISIONAL").otherwise("HELD"))


def confirm(members: DataFrame, record: Column) -> DataFrame:
    return members.withColumn("link_status", F.when(record & (F.col("link_status") == "PROVISIONAL"), "CONFIRMED").otherwise(F.col("link_status")))


def by_legacy(members: DataFrame, resolved: DataFrame, cpse: Column, legacy_code: Column) -> DataFrame:
    """Every live code that a company's legacy code leads to: legacy codes are not unique."""
    hit = members.where((F.col("cpse") == cpse) & (F.col("legacy_code") == legacy_code))
    return hit.join(resolved, "code").select("record_id", "cpse", "legacy_code", "live_code").distinct()


def catalogue(members: DataFrame, registry: DataFrame) -> DataFrame:
    """Per active code its members and the sorted companies and plants."""
    rows = members.join(registry.where("superseded_by is null").select("code", "class_code"), "code")
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return rows.groupBy("code", "class_code").agg(F.count(F.lit(1)).alias("n_members"), distinct("cpse").alias("cpses"), distinct("plant").alias("plants"))


def stats(registry: DataFrame, members: DataFrame, refusals: DataFrame) -> DataFrame:
    """One row: active, superseded, mapped, confirmed, provisional, refused."""
    one = registry.agg(F.count(F.when(F.col("superseded_by").isNull(), 1)).alias("active"), F.count("superseded_by").alias("superseded"))
    two = members.agg(F.count(F.lit(1)).alias("mapped"), F.count(F.when(F.col("link_status") == "CONFIRMED", 1)).alias("confirmed"), F.count(F.when(F.col("link_status") == "PROVISIONAL", 1)).alias("provisional"))
    return one.crossJoin(two).crossJoin(refusals.agg(F.count(F.lit(1)).alias("refused")))


def provisional_queue(members: DataFrame, registry: DataFrame, limit: int = 500) -> DataFrame:
    rows = members.where("link_status = 'PROVISIONAL'").join(registry.where("superseded_by is null").select("code", "class_code"), "code")
    return rows.orderBy("corroborated", "record_id").limit(limit)


def repoint(members: DataFrame, superseded: DataFrame) -> DataFrame:
    """Members of superseded codes (code, superseded_by) move to the code that stays; other columns are kept."""
    moved = superseded.select("code", F.col("superseded_by").alias("_to"))
    rows = members.join(moved, "code", "left").withColumn("code", F.coalesce("_to", "code"))
    return rows.select(*members.columns)


def group_key(members: Column) -> Column:
    """The sorted record ids of a group, comma-joined: the same group has the same key in any order."""
    return F.array_join(F.transform(F.array_sort(members), lambda i: i.cast("string")), ",")


def merge_refusals(refusals: DataFrame, planned: DataFrame, ts: Column) -> DataFrame:
    """(group_key, ts, reason) after a run: refused groups replace their row, groups that got a code lose theirs."""
    tried = planned.select(group_key(F.col("members")).alias("group_key"), F.when(F.col("status").startswith("refused_"), F.col("status")).alias("reason"))
    tried = tried.groupBy("group_key").agg(F.max("reason").alias("reason"))
    kept = refusals.select("group_key", "ts", "reason").join(tried.select("group_key"), "group_key", "left_anti")
    return kept.unionByName(tried.where("reason is not null").select("group_key", ts.alias("ts"), "reason"))


def transition(members: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, events) after requests (record_id, kind, actor, ts), one a record, kind `confirm` or `unlink`.

    A confirmed member is CONFIRMED and names its actor; an unlinked one goes, its code stays.
    Requests for records without a code do nothing. Events: kind, code, record_id, actor, ts.
    """
    asked = requests.select("record_id", "kind", "actor", "ts")
    events = members.select("record_id", "code").join(asked, "record_id")
    events = events.select(F.when(F.col("kind") == "confirm", "confirmed").otherwise("unlinked").alias("kind"), "code", "record_id", "actor", "ts")
    rows = members.join(asked.select("record_id", F.col("kind").alias("_kind"), F.col("actor").alias("_actor")), "record_id", "left")
    rows = rows.where(F.coalesce(F.col("_kind") != "unlink", F.lit(True)))
    confirmed = F.col("_kind") == "confirm"
    rows = rows.withColumn("link_status", F.when(confirmed, "CONFIRMED").otherwise(F.col("link_status"))).withColumn("linked_by", F.when(confirmed, F.col("_actor")).otherwise(F.col("linked_by")))
    return rows.select(*members.columns), events


def checked_change(kind: Column, code: Column, target: Column, reason: Column) -> Column:
    """Why a retirement (`supersede` by target, `revoke` for a reason) is refused; null if it may go ahead."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    superseding = F.when(blank(target), "no replacement named").when(target == code, "supersedes itself")
    return F.when(kind == "supersede", superseding).when(kind == "revoke", F.when(blank(reason), "no reason given")).otherwise("unknown change")


def by_class(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Per class: active and superseded codes and the members mapped to them."""
    mapped = members.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    live = F.col("superseded_by").isNull()
    rows = registry.join(mapped, "code", "left").groupBy("class_code")
    return rows.agg(F.count(F.when(live, 1)).alias("active"), F.count(F.when(~live, 1)).alias("superseded"), F.coalesce(F.sum("n"), F.lit(0)).alias("mapped"))


def consolidated(members: DataFrame) -> DataFrame:
    """Codes whose confirmed members lie in several plants: (code, n_members, n_plants)."""
    rows = members.where("link_status = 'CONFIRMED'").groupBy("code")
    return rows.agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct("plant").alias("n_plants")).where("n_plants > 1")


def class_completeness(records: DataFrame, floor: float = 0.35, least: int = 20) -> DataFrame:
    """Per class of `least` records or more the share with a complete signature, and whether it exceeds the floor."""
    rows = records.groupBy("class_code").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("complete").cast("int")).alias("rate")).where(F.col("n") >= least)
    return rows.withColumn("sufficient", F.col("rate") > floor)


def entries(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Registry rows with their members as a list of (record_id, cpse, link_status) in order of record_id."""
    held = members.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("record_id", "cpse", "link_status"))).alias("members"))
    return registry.join(held, "code", "left").withColumn("n_members", F.when(F.col("members").isNull(), 0).otherwise(F.size("members")))
