"""The core's training-data queries over empty tables and over rows that hold nothing."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def hollow(at, rows):
    """The test tables' schemas in a folder, each with so many rows of nulls."""
    for f in os.listdir(SF):
        schema = pq.read_schema(f"{SF}/{f}")
        pq.write_table(pa.table({c: pa.nulls(rows, schema.field(c).type) for c in schema.names}, schema=schema), f"{at}/{f}")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("rows", [0, 5])
def test_nothing_in_nothing_out(spark, tmp_path, rows):
    hollow(tmp_path, rows)
    assert {n: QUERIES[n](spark, str(tmp_path)).count() for n in ("p1_found", "p1_values", "p5_found", "p5_values", "p6_found", "p6_units")} == dict.fromkeys(("p1_found", "p1_values", "p5_found", "p5_values", "p6_found", "p6_units"), 0)
