"""python -m gridloom [--sf FOLDER] [--out FOLDER] [QUERY...]: runs named queries of the core, or lists them if none is named."""

from __future__ import annotations

import argparse
import time


def main(args: list[str] | None = None) -> int:
    from gridloom.plans.queries import ORACLE, QUERIES

    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    p.add_argument("query", nargs="*")
    p.add_argument("--sf", default="/root/testdata/sf0.01", help="folder of the Parquet tables")
    p.add_argument("--out", help="folder for the results, one Parquet table a query; without it twenty rows are shown")
    given = p.parse_args(args)
    if not given.query:
        print("\n".join(f"{name}{' *' if name in ORACLE else ''}" for name in sorted(QUERIES)))
        return 0
    unknown = [q for q in given.query if q not in QUERIES]
    if unknown:
        p.error(f"no such query: {', '.join(unknown)}")
    from pyspark.sql import SparkSession

    from gridloom.session import ship

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    for name in given.query:
        began, df = time.time(), QUERIES[name](spark, given.sf)
        if given.out:
            df.write.mode("overwrite").parquet(f"{given.out.rstrip('/')}/{name}")
        else:
            df.show(truncate=80)
        print(f"{name}: {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
