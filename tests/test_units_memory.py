"""What p6 sends to the driver has a bound, whatever the number of tables and the length of their units."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import units
from gridloom.operators.units import converted, unit_rows


def _broadcasts(spark, since):
    """Rows of each broadcast of the queries that ran after the execution `since`, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    of = lambda x: [x.apply(i) for i in range(x.size())]
    ids = [e.executionId() for e in of(store.executionsList().toIndexedSeq())]
    out = []
    for k in (k for k in ids if k > since):
        values = store.executionMetrics(k)
        for node in of(store.planGraph(k).allNodes().toIndexedSeq()):
            for m in of(node.metrics().toIndexedSeq()) if node.name() == "BroadcastExchange" else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, max(ids, default=-1)


def test_listed_units_are_not_broadcast(spark):
    """5,000 tables that list units of 500 letters: none of them is broadcast, only the units known."""
    n = 5_000
    tables = spark.range(n).select("id", F.concat(F.lit("천명, "), F.repeat(F.lit("x"), 500)).alias("unit"))
    cells = spark.range(2 * n).select("id", F.floor(F.col("id") / 2).alias("table_id"), F.lit(1).alias("row_index"), (F.col("id") % 2 + 1).cast("int").alias("col_index"), F.when(F.col("id") % 2 == 0, "3").otherwise("2천명").alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(False).alias("is_header"))
    before = _broadcasts(spark, -1)[1]
    assert {(r.unit, r.common_value, r["count"]) for r in converted(spark, tables, cells).groupBy("unit", "common_value").count().collect()} == {("천명", 2000, n)}
    sizes, _ = _broadcasts(spark, before)
    assert sizes and max(sizes) <= len(unit_rows())


@pytest.mark.parametrize(("few", "hot"), [(0, 1_000_000), (0, 7)])
def test_more_columns_than_are_broadcast(spark, monkeypatch, few, hot):
    """Joined by shuffle, with and without columns that are spread, and a cell and a table delivered twice, the rows are those of a broadcast."""
    tables = spark.createDataFrame([(1, "백만원"), (2, "km2, m2, km, m"), (3, "개소"), (4, None)], "id long, unit string")
    rows = [(1, r, c, "7" if c < 3 else "2천명") for r in range(1, 60) for c in (1, 2, 3)] + [(1, 1, 1, "7")] + [(t, r, 1, "1.5") for t in (3, 4) for r in range(1, 9)]
    rows += [(2, r, c, str(v)) for r in range(1, 40) for c, v in ((1, 6 * r), (2, 2 * r), (3, 3000))]
    heads = [(1, 0, 2, "면적(천㎡)"), (2, 0, 2, "x(km)"), (2, 0, 3, "y(m)")]
    cells = spark.createDataFrame([(i if i != 180 else 1, *x, None, False) for i, x in enumerate(rows)] + [(10_000 + i, *x, None, True) for i, x in enumerate(heads)], "id long, table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean")
    run = lambda: sorted(map(repr, converted(spark, tables, cells).collect()))
    want = run()
    assert len(want) == 59 * 3 + 1 + 39 * 3
    monkeypatch.setattr(units, "FEW", few)
    monkeypatch.setattr(units, "HOT", hot)
    assert run() == want
