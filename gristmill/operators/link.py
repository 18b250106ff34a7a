"""Exact comparison of two tables on the composite key crop + name."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.functions.frames import cell_text, lookup_join, percent, quoted, string_columns
from gristmill.operators.headers import column_for, map_headers

KEY = "__key"
MATCH_TYPE = "exact_crop_variety"
# Keys hold "||"; these do not.
NO_LEFT_NAME, NO_RIGHT_NAME = "unnamed left", "unnamed right"


def with_key(
    df: DataFrame, crop: str | None, variety: str | None, clean: bool, unnamed: str
) -> DataFrame:
    """The table, in clean form if asked for, with its composite key.

    A row without a name gets ``unnamed`` instead, which no key equals.  The key is thus
    never null, and the optimizer has no reason to repeat its expression in a null filter.
    """
    def part(column: str | None) -> Column:
        return F.lit("") if column is None else text.key_text(cell_text(df, column))

    texts = set(string_columns(df)) if clean else ()
    name = part(variety)
    staged = df.select(
        *[(text.clean_text(quoted(c)) if c in texts else quoted(c)).alias(c) for c in df.columns],
        name.alias("__name"), part(crop).alias("__crop"),
    )
    key = F.concat(F.col("__crop"), F.lit("||"), F.col("__name"))
    return staged.withColumn(
        KEY, F.coalesce(F.when(F.col("__name") != "", key), F.lit(unnamed))
    ).drop("__name", "__crop")


@dataclass(frozen=True)
class Comparison:
    """Two tables and the columns that hold their keys.

    Nothing is computed until one of the result tables is used.  Rows without a name are
    unique to the left; on the right they are left out unless ``include_blank`` is set.
    """

    left: DataFrame
    right: DataFrame
    left_keys: tuple[str | None, str | None]
    right_keys: tuple[str | None, str | None]
    include_blank: bool = False
    clean: bool = False  # bring every text column to its clean form

    @classmethod
    def by_headers(cls, left: DataFrame, right: DataFrame, **options) -> Comparison:
        """Find the key columns of both tables from their headers."""
        def keys(df: DataFrame) -> tuple[str | None, str | None]:
            mapping = map_headers(df.columns)
            return column_for(mapping, "crop"), column_for(mapping, "variety_release_name")

        return cls(left, right, keys(left), keys(right), **options)

    def including_blank(self) -> Comparison:
        return replace(self, include_blank=True)

    def _keyed(self, named_only: bool = False) -> tuple[DataFrame, DataFrame]:
        def named(df: DataFrame, name: str | None) -> DataFrame:
            # A cheap test of the raw cell; what is blank only after cleaning keeps its
            # place-holder key and matches nothing.
            if not named_only:
                return df
            return df.where(F.lit(False) if name is None else ~text.is_blank(cell_text(df, name)))

        left = named(self.left, self.left_keys[1])
        right = named(self.right, self.right_keys[1])
        return (
            with_key(left, *self.left_keys, self.clean, NO_LEFT_NAME),
            with_key(right, *self.right_keys, self.clean, NO_RIGHT_NAME),
        )

    def matches(self) -> DataFrame:
        """Every pair of rows with the same key, side by side.

        Both inputs are plain shuffles on the key, so a hot key is split on either side.
        """
        left, right = self._keyed(named_only=True)
        left = left.select(*[quoted(c).alias(f"File1_{c}") for c in self.left.columns], F.col(KEY))
        right = right.select(*[quoted(c).alias(f"File2_{c}") for c in self.right.columns], F.col(KEY))
        joined = left.join(right, KEY)
        return joined.select(
            *[quoted(c) for c in joined.columns if c != KEY],
            F.lit(1.0).alias("Match_Confidence"),
            F.lit(MATCH_TYPE).alias("Match_Type"),
            F.col(KEY).alias("Matched_Key"),
        )

    def match_groups(self) -> DataFrame:
        """One row per shared key with the row counts of both sides, instead of all pairs."""
        counts = self._key_counts()
        return counts.where(
            F.col("n_left").isNotNull() & F.col("n_right").isNotNull()
        ).select(
            F.col(KEY).alias("matched_key"), "n_left", "n_right",
            (F.col("n_left") * F.col("n_right")).alias("pairs"),
        )

    @staticmethod
    def _without_partner(rows: DataFrame, partners: DataFrame) -> DataFrame:
        return lookup_join(rows, partners, [KEY], "left_anti").drop(KEY)

    @staticmethod
    def _keyless(rows: DataFrame, unnamed: str) -> DataFrame:
        """Unnamed rows without a key at all, which spreads them over the join's tasks."""
        return rows.withColumn(KEY, F.when(F.col(KEY) != unnamed, F.col(KEY)))

    def unique_left(self) -> DataFrame:
        left, right = self._keyed()
        partners = right.select(KEY).distinct()
        return self._without_partner(self._keyless(left, NO_LEFT_NAME), partners)

    def unique_right(self) -> DataFrame:
        left, right = self._keyed(named_only=not self.include_blank)
        partners = left.select(KEY).distinct()
        if self.include_blank:
            return self._without_partner(self._keyless(right, NO_RIGHT_NAME), partners)
        # the place-holder counts as matched, so names that are only punctuation leave too
        unnamed = partners.sparkSession.range(1).select(F.lit(NO_RIGHT_NAME).alias(KEY))
        return self._without_partner(right, partners.union(unnamed))

    def _key_counts(self) -> DataFrame:
        left, right = self._keyed()
        n_left = left.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_left"))
        n_right = right.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_right"))
        return n_left.join(n_right, KEY, "full_outer")

    def stats(self) -> DataFrame:
        """Totals, matched pairs, unique rows and rates.

        Works on row counts per key, so the number of pairs is a sum of products and no
        pair is ever built.
        """
        n_left = F.coalesce(F.col("n_left"), F.lit(0))
        n_right = F.coalesce(F.col("n_right"), F.lit(0))
        counted_right = F.lit(True) if self.include_blank else F.col(KEY) != NO_RIGHT_NAME

        def summed(value: Column) -> Column:
            return F.coalesce(F.sum(value), F.lit(0)).cast("long")

        totals = self._key_counts().agg(
            summed(n_left).alias("total_file1"),
            summed(n_right).alias("total_file2"),
            summed(n_left * n_right).alias("matches_found"),
            summed(F.when(n_right == 0, n_left).otherwise(0)).alias("unique_to_file1"),
            summed(F.when((n_left == 0) & counted_right, n_right).otherwise(0))
            .alias("unique_to_file2"),
        )
        return totals.select(
            "*",
            percent(F.col("matches_found"), F.col("total_file1"), 2).alias("match_rate_file1"),
            percent(F.col("matches_found"), F.col("total_file2"), 2).alias("match_rate_file2"),
            F.lit("100%_exact_crop_variety").alias("matching_method"),
        )
