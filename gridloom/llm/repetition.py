"""Problem 9: repetition inside of a single document, and lines that many documents of a source share.

The share: all windows of 25 letters of a text are hashed at once, a window is repeated if its hash came earlier in the
same text, and each repeated window is compared letter by letter with the first of its hash. Texts are handled in
chunks within a task; nothing is shuffled.

Cross-document line frequency (host_lines) is the other operator: it hashes normalised lines, counts distinct documents
per host, takes out lines above the limits and rejects depleted documents. It can't tell what one document repeats
within itself, so the share doesn't use it.

Defined results: null, empty and letterless texts have no letters and share 0; texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.letters import chunks, letters, window_hash, window_owner
from gridloom.session import cut, lookup, table

RUN = 25


def _exact(points: np.ndarray, run: int) -> np.ndarray:
    """Starts of repeated windows by the windows themselves; only where a hash collision was seen."""
    seen: set[bytes] = set()
    out = []
    for i in range(len(points) - run + 1):
        w = points[i : i + run].tobytes()
        if w in seen:
            out.append(i)
        seen.add(w)
    return np.array(out, np.int64)


def repeated_letters(points: np.ndarray, offs: np.ndarray, run: int = RUN) -> np.ndarray:
    """Per text, how many of its letters lie in a run that also starts at an earlier letter of the text."""
    n = len(offs) - 1
    place, owner = window_owner(offs, run)
    if not len(place):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        key = window_hash(points, run)[place] ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(n, np.int64)
    some = np.flatnonzero(np.isin(key, np.unique(twice)))
    order = some[np.argsort(key[some], kind="stable")]
    first = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    again, head = order[~first], head[~first]
    steps = np.arange(run)
    same = np.ones(len(again), bool)
    for at in range(0, len(again), 100_000):
        a, b = place[again[at : at + 100_000], None] + steps, place[head[at : at + 100_000], None] + steps
        same[at : at + 100_000] = (points[a] == points[b]).all(axis=1)
    starts = place[again]
    if not same.all():
        odd = np.unique(owner[again[~same]])
        starts = np.concatenate([starts[~np.isin(owner[again], odd)], *(offs[o] + _exact(points[offs[o] : offs[o + 1]], run) for o in odd)])
    delta = np.zeros(len(points) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + run, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    return covered[offs[1:]] - covered[offs[:-1]]


def repetition(df: DataFrame, id_column: str, text_column: str, run: int = RUN) -> DataFrame:
    """id, letters, repeated: per text its letters and how many of them are repeated."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, texts in chunks(b):
                points, offs = letters(texts, digits=False)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(offs[1:] - offs[:-1]), pa.array(repeated_letters(points, offs, run))], names=["id", "letters", "repeated"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(kernel, "id long, letters long, repeated long")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.where("letters > 0 and 10 * repeated >= 3 * letters").select(F.col("id").alias("doc_id"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "letters", "repeated", F.coalesce(F.try_divide("repeated", "letters"), F.lit(0.0)).alias("share"))


def host_lines(df: DataFrame, id_column: str, host_column: str, text_column: str, most: int = 20, most_share: float = 0.05, least_left: float = 0.5) -> DataFrame:
    """id, lines, removed, chars, chars_left, rejected: each document without the lines too many documents of its host hold.

    A line goes if more than `most` distinct documents of the host and more than `most_share` of them hold it; a
    document is rejected if less than `least_left` of its characters are left. Lines are compared without case, digits
    and runs of blanks; empty lines don't count. Null hosts are one host; texts without lines are kept.
    """
    docs = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.col(text_column).cast("string").alias("text"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"[0-9]+", "0"), r"(?U)\s+", " "))
    lines = docs.select("id", "host", F.explode(F.split("text", "\n")).alias("line")).select("id", "host", F.length("line").alias("size"), plain.alias("plain")).where("plain <> ''")
    lines = lines.groupBy("id", "host", F.xxhash64("plain").alias("h")).agg(F.count("*").alias("lines"), F.sum("size").alias("chars"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > most)
    hosts = docs.groupBy("host").agg(F.count("*").alias("of"))
    gone = cut(often.join(hosts, "host").where(F.col("docs") > most_share * F.col("of")).select("host", "h", F.lit(True).alias("gone")))
    # A line that goes is one that a large part of a host has: no join on its hash alone.
    left = lookup(lines, gone, ["host", "h"], "id").groupBy("id").agg(
        F.sum("lines").alias("lines"), F.sum(F.when(F.col("gone"), F.col("lines")).otherwise(0)).alias("removed"),
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("gone"), 0).otherwise(F.col("chars"))).alias("chars_left"),
    )
    return docs.select("id").join(left, "id", "left").na.fill(0).withColumn("rejected", (F.col("chars") > 0) & (F.col("chars_left") < least_left * F.col("chars")))


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_lines(table(spark, sf_dir, "documents"), "doc_id", "source", "text").withColumnRenamed("id", "doc_id")


def p9_host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their share of the host's documents alone, alike for hosts of every size; three documents at least, as with fewer a share says little."""
    return host_lines(table(spark, sf_dir, "documents"), "doc_id", "source", "text", most=2, most_share=0.05).withColumnRenamed("id", "doc_id")
