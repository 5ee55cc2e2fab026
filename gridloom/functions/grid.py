"""Cells of published grids: plain texts, labels, header texts and numbers, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.plainpoints import plain_array


def plain_texts(df: DataFrame, *columns: str) -> DataFrame:
    """df with the named text columns in plain form; rows that hold nothing to do pass through."""

    def kernel(batches):
        for b in batches:
            for c in columns:
                k = b.schema.get_field_index(c)
                b = b.set_column(k, b.schema.field(k), plain_array(b.column(k)))
            yield b

    return df.mapInArrow(kernel, df.schema)


#: The number grammar: an optional sign, plain or exactly grouped digits, decimals; a percentage in brackets after it is a remark.
NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
REMARK = r"\s*\([^()]*%\s*\)$"


def number_of(text: Column) -> Column:
    """The number that a whole plain text is, as double; null if it is anything else. A bracketed percentage after it is ignored."""
    t = F.trim(F.when(text.contains("%"), F.regexp_replace(text, REMARK, "")).otherwise(text))
    return F.when(t.rlike(f"^{NUMBER}$"), F.replace(t, F.lit(","), F.lit("")).cast("double"))


def says_nothing(text: Column) -> Column:
    """Null, the empty text or a lone hyphen."""
    return text.isNull() | F.trim(text).isin("", "-")


def deduplicated(cells: DataFrame) -> DataFrame:
    """One row per place of a grid: of cells delivered more than once the smallest id stands."""
    rest = [c for c in cells.columns if c not in ("table_id", "row_index", "col_index", "id")]
    return (
        cells.groupBy("table_id", "row_index", "col_index")
        .agg(F.min(F.struct("id", *rest)).alias("cell"))
        .select("cell.id", "table_id", "row_index", "col_index", *[f"cell.{c}" for c in rest])
    )


