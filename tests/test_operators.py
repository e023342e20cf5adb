"""Scoring, grouping, codes, registry, ERP, evidence and streams on fixed rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from specmint import dictionaries as D
from specmint.functions import codes
from specmint.operators import candidates as C
from specmint.operators import grouping as G
from specmint.operators import scoring as S
from specmint.operators import standards as N
from specmint.plans import resolution
from specmint.sources import erp
from specmint.streaming import events as stream

BOLTS = [
    (1, "Hexagonal Bolt M12 x 50 mm Stainless Steel 316", "nos"),
    (2, "HEX BOLT M12X50MM SS316", "nos"),
    (3, "hexagonal bolt m12 x 50 mm stainless steel 316", "nos"),
    (4, "Hexagonal Bolt M16 x 50 mm Stainless Steel 316", "nos"),
]


@pytest.mark.parametrize("ratio", ["levenshtein", "difflib"])
def test_bolts_resolve(spark, ratio):
    rows = resolution.resolve(spark.createDataFrame(BOLTS, "record_id long, description string, uom string"), ratio=ratio).collect()
    got = {(r["a"], r["b"]): r for r in rows}
    assert len(got) == 6
    assert got[1, 2]["decision"] == "AUTO_SUGGEST" and got[1, 3]["verdict"] == "IDENTICAL" and got[1, 2]["verdict"] == "EQUIVALENT"
    for other in (1, 2, 3):
        pair = got[other, 4]
        assert pair["decision"] == "REJECTED_VETO" and pair["conflicts"] == ["thread"] and pair["verdict"] == "CONFLICT"


def test_provisional_keys_veto_but_do_not_cover(spark):
    same = {"thread": "M12", "length_mm": "50"}
    rows = spark.createDataFrame([(1.0, 1.0, same, same), (1.0, 1.0, same, {"thread": "M16", "length_mm": "50"})], "cos double, fuz double, attrs_a map<string,string>, attrs_b map<string,string>")
    got = S.fuse(rows, provisional=F.array(F.lit("thread"))).collect()
    assert [g["decision"] for g in got] == ["REVIEW", "REJECTED_VETO"]


def test_merge_proposals(spark):
    rows = spark.createDataFrame([({"thread": "M12"}, {"thread": ("M16", 0.9), "length_mm": ("50", 0.6), "rpm": ("1500", 0.4)})], "r map<string,string>, p map<string,struct<value:string,confidence:double>>")
    merged, provisional = S.merge_proposals(F.col("r"), F.col("p"))
    got = rows.select(merged.alias("m"), provisional.alias("p")).first()
    assert got["m"] == {"thread": "M12", "length_mm": "50"} and got["p"] == ["length_mm"]


def test_grouping_is_order_independent_and_consistent(spark):
    attrs = [(1, {"thread": "M12"}), (2, {"thread": "M16"}), (3, {}), (4, {"length_mm": "50"})]
    edges = [(1, 3, 0.95), (3, 2, 0.94), (3, 4, 0.93)]
    frame = spark.createDataFrame(attrs, "record_id long, attrs map<string,string>")
    seen = set()
    for order in itertools.islice(itertools.permutations(edges), 3):
        members, blocked = G.constrained_groups(spark.createDataFrame(list(order), "a long, b long, score double"), frame)
        assert G.inconsistencies(members, frame).count() == 0
        seen.add((tuple(sorted(tuple(r) for r in members.collect())), tuple((r["a"], r["b"]) for r in blocked.collect())))
    assert seen == {(((1, 1), (1, 3), (1, 4), (2, 2)), ((2, 3),))}


def test_damm_catches_every_single_error_and_transposition(spark):
    digits = ["0", "12345", "9999999999", "10301000042", "907"]
    rows = spark.createDataFrame([(d,) for d in digits], "d string").select("d", codes.damm(F.col("d")).alias("c")).collect()
    whole = [r["d"] + str(r["c"]) for r in rows]
    assert dict((r["d"], r["c"]) for r in rows)["10301000042"] == 3
    bad = {w[:i] + x + w[i + 1 :] for w in whole for i in range(len(w)) for x in "0123456789" if x != w[i]}
    bad |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in whole for i in range(len(w) - 1) if w[i] != w[i + 1]}
    check = lambda items: spark.createDataFrame([(b,) for b in items], "d string").where(codes.damm_valid(F.col("d"))).count()
    assert check(bad) == 0 and check(whole) == len(whole)
    assert len(D.DAMM) == 10 and all(sorted(row) == list(range(10)) for row in D.DAMM)


def test_mint_refuses_what_has_no_form(spark):
    rows = spark.createDataFrame([("10.30.10", 42), ("10.30", 1), ("10.30.10", 100000), ("10.30.10", -1)], "c string, s long")
    assert [r[0] for r in rows.select(codes.mint(F.col("c"), F.col("s"))).collect()] == ["NMC-10-30-10-00042-3", None, None, None]


def test_fold_never_relaxes(spark):
    rows = spark.createDataFrame([(d, e) for d in N.RANK for e in ("NONE", "INFORMS", "SUPPORTS", "BLOCKS")], "d string, e string")
    assert rows.where(N.rank_of(N.fold(F.col("d"), F.col("e"))) < N.rank_of(F.col("d"))).count() == 0


def test_text_pressure(spark):
    rows = spark.createDataFrame([("x" * 60,), ("y" * 10,)], "description string")
    got = erp.text_pressure(rows).first()
    assert (got["n"], got["over_limit"], got["chars_lost"], got["max_len"]) == (2, 1, 20, 60)
    assert erp.text_pressure(rows.limit(0)).first()["n"] == 0


def test_batches(spark, tmp_path):
    columns = ", ".join(f"{c} string" for c in erp.FIELDS["Z_NMC_MAP"])
    rows = [("800", "M1", "P1", "NMC-10-30-10-00042-3", "10.30.10", "A", "C", "", "20260101", "x", "y"), ("800", "M2", "P1", "NMC-10-30-10-00024-3", "10.30.10", "A", "P", "rpm", "20260101", "x", "y")]
    frame = spark.createDataFrame(rows, columns)
    manifest = erp.emit_batch(frame, str(tmp_path), 1)
    assert manifest["rows"] == 2 and manifest["rows_provisional"] == 1 and erp.verify_batch(spark, str(tmp_path), 1)
    assert erp.revoke_batch(spark, str(tmp_path), 1)["revoked"] and erp.verify_batch(spark, str(tmp_path), 1)
    assert erp.delta(frame, frame).count() == 0 and erp.delta(frame, frame.limit(0)).count() == 2
    marc = spark.createDataFrame([("M1", "P1"), ("M2", "P1")], "MATNR string, WERKS string")
    got = {r["MATNR"]: r["reason"] for r in erp.judged_batch(frame, marc).collect()}
    assert got == {"M1": None, "M2": "national code fails its check digit"}
    assert erp.digest(frame).first() == erp.digest(frame.orderBy(F.desc("MATNR")).repartition(3)).first()


def test_text_of_a_material(spark):
    makt = spark.createDataFrame([("M", "DE", "alt", 1), ("M", "EN", "old", 2), ("M", "EN", "new", 3), ("N", "DE", "erste", 4), ("N", "FR", "deux", 5)], "MATNR string, SPRAS string, MAKTX string, line long")
    assert {r["MATNR"]: r["MAKTX"] for r in erp.preferred_text(makt).collect()} == {"M": "new", "N": "erste"}


def test_top_k_equals_brute_force_across_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, "all", [float(x) for x in row]) for i, row in enumerate(v)], "record_id long, block string, vector array<double>")
    got = {(r["record_id"], r["rank"]): r["neighbour"] for r in C.top_k_in_block(frame, 3, chunk=16).collect()}
    sims = v @ v.T
    np.fill_diagonal(sims, -9)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(-sims[i], kind="stable")[:3])}


def test_streaming_matches_batch(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2026-01-01' + make_interval(0,0,0,0,0,cast(id*7 as int)) as ts, if(id%2=0,'a','b') as event_type, cast(id as double) as value from range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    live = stream.audit_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double")
    stream.append_log(live, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 300
    seen = []
    stream.each_batch(live, lambda df, _: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 300
    assert stream.tumbling(log, "1 hour").agg(F.sum("n")).first()[0] == 300
    query = stream.tumbling(live, "1 hour").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == 300
