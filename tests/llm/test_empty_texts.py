"""The text queries over empty tables and over rows that hold nothing: a row for each document where the query gives one, else none."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EACH = ("p7_ids", "p9_share", "p9_lines", "p9_host_lines")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("rows", [0, 5])
def test_nothing_in_nothing_out(spark, tmp_path, rows):
    for f in os.listdir(SF):
        schema = pq.read_schema(f"{SF}/{f}")
        pq.write_table(pa.table({c: pa.nulls(rows, schema.field(c).type) for c in schema.names}, schema=schema), f"{tmp_path}/{f}")
    assert {n: q(spark, str(tmp_path)).count() for n, q in QUERIES.items()} == {n: rows if n in EACH else 0 for n in QUERIES}
