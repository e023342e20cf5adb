from pyspark.sql import functions as F

from specmint.plans import resolution
from specmint.sources import generate


def test_generated_benchmark_resolves(spark):
    rows = generate.records(spark, 240)
    again = generate.records(spark, 240).repartition(3)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    assert rows.groupBy("family_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    truth = generate.true_pairs(rows)
    assert truth.count() == 60 * 6 and generate.sibling_pairs(rows).count() > 0
    scored = resolution.resolve(rows.select("record_id", "description", "uom"))
    found = scored.where("decision in ('AUTO_SUGGEST', 'REVIEW')").select("a", "b")
    hits = found.join(truth, ["a", "b"], "left_semi").count()
    assert hits >= 0.3 * truth.count()
