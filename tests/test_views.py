import json

from pyspark.sql import functions as F

from specmint.functions import text as T
from specmint.operators import analytics as A
from specmint.operators import review as V
from specmint.operators.constraints import violations
from specmint.plans import resolution, views
from specmint.storage import materialize

RECORDS = [(1, "HEX BOLT M12X50MM SS316", "nos", "ALFA", "North Refinery", "10"), (2, "gate valve 2 inch", "nos", "BETA", "Harbour Depot", "10"), (3, "spare thing", "nos", "ALFA", "South Terminal", "33")]


def test_search_normalises_the_question(spark):
    rows = spark.createDataFrame(RECORDS, "record_id long, description string, uom string, cpse string, plant string, legacy_code string")
    seen = views.record_view(rows, resolution.prepare(rows.select("record_id", "description", "uom")))
    ids = lambda **k: sorted(r["record_id"] for r in views.search_records(seen, **k).collect())
    assert ids(text="stainless steel 316") == [1] and ids(text="SS316") == [1] and ids(text="33") == [3]
    assert ids(cpse="ALFA") == [1, 3] and ids(plant="depot") == [2] and ids(category="unclassified") == [3]
    first, total = views.page(seen, [F.col("record_id")], limit=1, offset=1)
    assert total == 3 and first.first()["record_id"] == 2


def test_broken_attributes_are_empty(spark):
    rows = spark.createDataFrame([('{"thread": "M12"}',), ("{oops",), (None,)], "j string")
    assert [r[0] for r in rows.select(views.attributes(F.col("j"))).collect()] == [{"thread": "M12"}, {}, {}]


def test_ledger_appends(spark, tmp_path):
    for k in range(3):
        views.append_ledger(spark, {"run": k}, str(tmp_path / "ledger"))
    assert sorted(json.loads(r[0])["run"] for r in spark.read.text(str(tmp_path / "ledger")).collect()) == [0, 1, 2]


def test_availability_order_of_signals(spark):
    demand = spark.createDataFrame([("x", "A", 10.0, True), ("y", "A", 10.0, True), ("z", "A", 10.0, False), ("w", "A", 0.0, True)], "item string, cpse string, required double, resolved boolean")
    stock = spark.createDataFrame([("x", "B", 1, 7.0, "CONFIRMED"), ("x", "C", 2, 7.0, "CONFIRMED"), ("x", "A", 3, 99.0, "CONFIRMED"), ("y", "B", 4, 5.0, "PROVISIONAL"), ("z", "B", 5, 50.0, "CONFIRMED"), ("w", "B", 6, 1.0, "CONFIRMED")], "item string, cpse string, record_id long, qty double, link_status string")
    got = {r["item"]: r for r in A.availability(demand, stock).collect()}
    assert got["x"]["signal"] == "CROSS_CPSE_STOCK_FOUND" and got["x"]["best_source"] == 1 and got["x"]["available"] == 14
    assert got["y"]["signal"] == "NO_CROSS_CPSE_STOCK" and got["y"]["provisional"] == 5
    assert got["z"]["signal"] == "UNRESOLVED_CASE" and got["w"]["coverage"] == 0 and got["w"]["signal"] == "OPPORTUNITY_DETECTED"


def test_roles_and_sessions(spark):
    rows = spark.createDataFrame([("viewer",), ("approver",), ("nobody",), (None,)], "role string")
    assert [r[0] for r in rows.select(V.may(F.col("role"), "steward")).collect()] == [False, True, False, False]


def test_violations_count_nulls(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert [tuple(r) for r in violations(rows, {"positive": F.col("x") > 0}).collect()] == [("positive", 2)]


def test_figures_need_a_basis(spark):
    rows = spark.createDataFrame([(1.0, "MEASURED", "counted"), (1.0, "MEASURED", " "), (1.0, "GUESSED", "x")], "v double, p string, b string")
    got = [r[0] for r in rows.select(A.figure(F.col("v"), F.col("p"), F.col("b"))).collect()]
    assert got[0]["quotable"] is True and got[1] is None and got[2] is None


def test_materialized_tables_keep_their_schema(spark):
    rows = spark.createDataFrame([], "a long, b string")
    assert materialize(rows).schema == rows.schema and materialize(rows).count() == 0


def test_flat(spark):
    assert spark.createDataFrame([("A-b 1",)], "x string").select(T.flat(F.col("x"))).first()[0] == "ab1"
