"""Problem 2: one plain form for texts that look the same but differ in their characters.

Texts go through the vectorised kernel of plain forms (code-point arrays, lookup-table gathers with expansion offsets,
composition over the whole array; functions.plainpoints, which the core shares): this operator gives each row its plain
form and tells whether the row differed from it. Texts of plain ASCII don't leave the JVM.

Defined results: null stays null, the empty text stays empty, texts of any length are handled whole, repeated rows
each keep their row. A lone sign with a meaning of its own is plain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.plainpoints import pieces, plain_column


def with_plain(df: DataFrame, column: str, out: str = "plain", flag: str = "differs") -> DataFrame:
    """df with the plain form of a text column and a flag telling whether the text wasn't in it.

    All columns of df pass through; a clash of names with `out` or `flag` is an error.
    """
    if {out, flag} & set(df.columns):
        raise ValueError(f"{out!r} or {flag!r} is a column already")

    def kernel(batches):
        for whole in batches:
            k = whole.schema.get_field_index(column)
            for at, end in pieces(whole.column(k)):
                b = whole.slice(at, end - at)
                plain, differs = plain_column(b.column(k))
                yield pa.RecordBatch.from_arrays([*b.columns, plain.cast(pa.string()), pa.array(differs)], names=[*b.schema.names, out, flag])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(flag, T.BooleanType())])
    return df.mapInArrow(kernel, schema)


def not_plain(df: DataFrame, field_name: str, id_column: str, text_column: str) -> DataFrame:
    """field_name, row_id of every non-null text that isn't in plain form. Plain ASCII texts don't leave the JVM."""
    odd = df.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").rlike(r"[^\n -~]"))
    return with_plain(odd, "text").where("differs").select(F.lit(field_name).alias("field_name"), "row_id")
