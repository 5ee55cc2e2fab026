"""Session helpers: table reading, the shared folder, and materialised cut points."""

from __future__ import annotations

import math
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Catalyst prunes its columns and pushes its filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else its SparkContext's checkpoint folder.

    Where neither is set, a session in one process (local tests) gets a folder of its own; any other session is refused,
    as what its machines wrote into folders of their own would be lost without an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: {master} has more than one process")
    at = "file:///tmp/gridloom-shared-" + str(os.getuid())
    os.makedirs(at[len("file://"):], exist_ok=True)
    return at


def delete_on_exit(spark: SparkSession, at: str) -> None:
    """The files at a path go when the session ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared folder and read again: lineage ends, a lost executor loses nothing.

    The files go when the session ends (they are registered with Hadoop's delete-on-exit).
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    delete_on_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def parallel(spark: SparkSession) -> int:
    """Partitions for a shuffle that AQE must not shrink below the cluster's cores (Python stages)."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame, each: int = 8 << 20) -> int:
    """Partitions for a shuffle of what df scans, by its files' size (known to the planner, no job): `each` bytes of files in one, never fewer than the cores."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 62 else 0  # rows that come from no file have no size
    return max(parallel(df.sparkSession), math.ceil(known / each))


#: Rows of a few numbers and short texts that may be broadcast: some 100 MB.
FEW = 1_000_000


def lookup(df: DataFrame, small: DataFrame, on: list[str], spread: str, few: int = FEW, salts: int = 16) -> DataFrame:
    """df left joined to `small` (which was cut, so that counting it reads no data), whose keys may be those of a large part of df.

    Up to `few` rows are broadcast. More are joined by key and salt: df's rows of one key spread by the values of the
    column `spread`, and each row of `small` goes to every salt.
    """
    if small.count() <= few:
        return df.join(F.broadcast(small), on, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"], "left").drop("__salt")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the Python workers of all executors, once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import atexit
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="gridloom-"))  # on the driver only: Spark's file server hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "gridloom.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(folder / "gridloom.zip"))
    _SHIPPED.add(app)
