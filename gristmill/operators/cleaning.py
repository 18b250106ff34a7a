"""Frame-level cleaning: whole tables in, whole tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import text
from gristmill.functions.frames import any_of, cell, cell_text, present, quoted, string_columns


def clean_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whitespace-clean the given columns (default: every string column) as strings."""
    targets = set(string_columns(df) if columns is None else present(df, columns))
    return df.select(*[
        (text.normalise_whitespace(cell_text(df, c)) if c in targets else quoted(c)).alias(c)
        for c in df.columns
    ])


def clean_frame(df: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Bring every string column to its clean form and drop empty rows.

    A cleaned string is never null, so by default a row only goes when the table has no
    string column at all.  ``drop_blank`` also drops rows in which every cell is empty.
    """
    texts = set(string_columns(df))
    cleaned = df.select(*[
        (text.clean_text(quoted(c)) if c in texts else cell(df, c)).alias(c) for c in df.columns
    ])
    if drop_blank:
        return cleaned.where(any_of([
            (quoted(c) != "") if c in texts else quoted(c).isNotNull() for c in df.columns
        ]))
    return cleaned if texts else cleaned.dropna(how="all")


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per column: non-null cells before and after, with the row totals."""
    columns = present(after, before.columns)

    def counts(df: DataFrame, label: str) -> DataFrame:
        measured = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(cell(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        )
        entries = [
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(f"{label}_non_null"))
            for i, c in enumerate(columns)
        ]
        return measured.select(
            F.col("rows").alias(f"{label}_rows"), F.inline(F.array(*entries))
        )

    joined = counts(before, "original").join(counts(after, "cleaned"), "column")
    return joined.select(
        "column", "original_non_null", "cleaned_non_null",
        (F.col("original_non_null") - F.col("cleaned_non_null")).alias("null_values_removed"),
        "original_rows", "cleaned_rows",
        (F.col("original_rows") - F.col("cleaned_rows")).alias("rows_removed"),
        F.lit(len(before.columns)).alias("columns_processed"),
    )


def is_guarded_column(name: str) -> bool:
    return name in config.GUARD_COLUMNS or any(w in name.lower() for w in config.GUARD_WORDS)


def guard_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Protect the cells of range, year and number columns from spreadsheet conversion."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[
        (text.guard_for_spreadsheet(cell_text(df, c))
         if c in chosen and (columns is not None or is_guarded_column(c)) else quoted(c)).alias(c)
        for c in df.columns
    ])


def standardise_by_table(
    df: DataFrame, column: str, aliases: DataFrame, output: str | None = None
) -> DataFrame:
    """Replace values by the ``standard`` of a large (``alias``, ``standard``) table.

    Several standards for one alias are settled by the smallest, so rows never multiply.
    """
    from gristmill.functions.frames import lookup_join

    output = output or column
    table = (
        aliases.groupBy(text.clean_text(F.col("alias")).alias("__alias"))
        .agg(F.min("standard").alias("__standard"))
    )
    keyed = df.withColumn("__alias", text.clean_text(quoted(column)))
    joined = lookup_join(keyed, table, ["__alias"], "left")
    value = F.coalesce(F.col("__standard"), F.col("__alias"))
    return joined.withColumn(output, value).drop("__alias", "__standard")


def serialise(df: DataFrame, output: str = "json", keep_nulls: bool = True) -> DataFrame:
    """Every row as one JSON document."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    cells = [cell(df, c).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cells), options).alias(output))
