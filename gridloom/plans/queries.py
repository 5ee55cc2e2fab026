"""The named queries of the core, each over the whole tables of a folder, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import packed, snapshots, units
from gridloom.plans import checks, documents, grids, inference, planted, registry, relational, review, scalars, texts  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **registry.QUERIES,
    "p1_found": snapshots.p1_found,
    "p1_values": snapshots.p1_values,
    "p5_found": packed.p5_found,
    "p5_values": packed.p5_values,
    "p6_found": units.p6_found,
    "p6_units": units.p6_units,
}
ORACLE: dict[str, str] = {**registry.ORACLE}
FLAGSHIP = "chk_row_sum"
