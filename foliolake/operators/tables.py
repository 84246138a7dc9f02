"""Row, column and cell operations on tables held as (table_index, row_index, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.operators.edits import renumber


def insert_row(rows: DataFrame, after: int) -> DataFrame:
    """A row of empty cells after row ``after`` of every table that has it."""
    here = F.struct(F.lit(0).alias("sub"), F.col("cells"))
    empty = F.struct(F.lit(1).alias("sub"), F.transform("cells", lambda c: F.lit("")).alias("cells"))
    # made beside the rows, so that they stay dealt by table as they are
    both = rows.select("table_index", "row_index", F.explode(F.when(F.col("row_index") == after, F.array(here, empty)).otherwise(F.array(here))).alias("r")).select("table_index", "row_index", "r.*")
    return renumber(both, ["table_index"], ["row_index", "sub"], "new_row").select("table_index", "new_row", "cells")


def delete_row(rows: DataFrame, row: int) -> DataFrame:
    return renumber(rows.filter(F.col("row_index") != row), ["table_index"], ["row_index"], "new_row").select("table_index", "new_row", "cells")


def insert_column(rows: DataFrame, after: int) -> DataFrame:
    """An empty cell after cell ``after`` of each row; tables with a shorter row are left as they are."""
    fits = rows.groupBy("table_index").agg(F.min(F.size("cells")).alias("least"))
    wider = F.concat(F.slice("cells", 1, after + 1), F.array(F.lit("")), F.slice("cells", after + 2, F.greatest(F.size("cells") - after - 1, F.lit(0))))
    return rows.join(fits, "table_index").select("table_index", "row_index", F.when(F.col("least") > after, wider).otherwise(F.col("cells")).alias("cells"))


def delete_column(rows: DataFrame, column: int) -> DataFrame:
    return rows.select("table_index", "row_index", F.filter("cells", lambda c, i: i != column).alias("cells"))


def merge_cells(rows: DataFrame, column: int, span: int, discard: Column | bool = False) -> DataFrame:
    """Merges ``span`` cells from ``column`` on: cells, grid_span, code; refused if text would be lost or the span is too wide."""
    dropped = F.slice("cells", column + 2, span - 1)
    loses = F.exists(dropped, lambda c: c != "")
    code = F.when(F.size("cells") < column + span, "span-out-of-range").when(loses & ~F.lit(discard), "merge-would-discard-content")
    merged = F.concat(F.slice("cells", 1, column + 1), F.slice("cells", column + span + 1, F.greatest(F.size("cells") - column - span, F.lit(0))))
    return rows.select("table_index", "row_index", F.when(code.isNull(), merged).otherwise(F.col("cells")).alias("cells"), F.when(code.isNull(), span).otherwise(1).alias("grid_span"), code.alias("code"))


def split_cell(rows: DataFrame, column: int, span: int) -> DataFrame:
    """One cell becomes ``span`` cells, the later ones empty; a column out of range leaves the row as it is."""
    wider = F.concat(F.slice("cells", 1, column + 1), F.array_repeat(F.lit(""), span - 1), F.slice("cells", column + 2, F.greatest(F.size("cells") - column - 1, F.lit(0))))
    return rows.select("table_index", "row_index", F.when(F.size("cells") > column, wider).otherwise(F.col("cells")).alias("cells"))
