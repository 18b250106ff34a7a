"""The work of a whole request as one lazy plan: load, combine, match, compare, report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gristmill import config
from gristmill.operators import cleaning, combine, facets, fill, headers, link, profiling, traits


@dataclass(frozen=True)
class Combined:
    records: DataFrame
    quarantine: DataFrame
    source_stats: DataFrame
    duplicate_stats: DataFrame | None


def combine_and_deduplicate(
    sources: Sequence[combine.Source],
    deduplicate: bool = True,
    keys: Sequence[str] | str = config.KEY_COLUMNS,
    guard: bool = True,
) -> Combined:
    """Combine tables, keep the fullest record per key, sort, and protect range cells."""
    keys = combine.parse_columns(keys) if isinstance(keys, str) else keys
    records = combined = combine.combine(sources, keep_row_number=deduplicate)
    stats = None
    if deduplicate:
        records = combine.dedup_most_complete(
            combined, keys, ["source_index", "row_number"],
            [c for c in combined.columns if c != "row_number"],
        )
        records = combine.sort_result(records).drop("row_number")
        stats = combine.duplicate_stats(combined.drop("row_number"), keys)
    if guard:
        records = cleaning.guard_columns(records)
    return Combined(records, combine.quarantine(sources), combine.source_stats(sources), stats)


def match_and_fill(
    uploaded: DataFrame,
    catalogue: DataFrame,
    fields: Sequence[str],
    mapping: Mapping[str, str] | None = None,
    order: str | None = None,
    key_column: str | None = None,
) -> DataFrame:
    """Clean an uploaded table, find its key columns and fill it from the catalogue.

    Naming the ``key_column`` saves the look at the first rows that finding one may take.
    ``order`` names the column giving the row order; with it the table's own country, the
    first one in that order, is left out of lists of other countries.
    """
    cleaned = cleaning.clean_frame(uploaded)
    mapping = headers.merged_map(cleaned.columns) if mapping is None else mapping
    key_column = key_column or headers.find_key_column(uploaded, mapping)
    name = headers.extract_name(cleaned, key_column, mapping)
    country = headers.column_for(mapping, "country")
    own = None
    if order is not None and country in uploaded.columns:
        own = fill.first_value(cleaned, country, order)
    return fill.match_and_fill(
        cleaned, catalogue, fields, headers.column_for(mapping, "crop"), name, own
    )


def compare(left: DataFrame, right: DataFrame, **options) -> link.Comparison:
    """Clean both tables and compare them on the key columns their headers name."""
    return link.Comparison.by_headers(left, right, clean=True, **options)


def tag_traits(df: DataFrame, text_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tag the table's text column; returns the tagged table and its report."""
    column = headers.find_text_column(df.columns, wanted=text_column)
    tagged = traits.extract_traits(df, column)
    return tagged, traits.trait_report(tagged, column)


@dataclass(frozen=True)
class Dashboard:
    totals: DataFrame
    completeness: DataFrame
    overall: DataFrame
    lowest: DataFrame
    message: DataFrame
    crops: DataFrame
    countries: DataFrame
    years: DataFrame


def quality_dashboard(catalogue: DataFrame) -> Dashboard:
    completeness = profiling.field_completeness(catalogue)
    return Dashboard(
        totals=profiling.total_rows(catalogue),
        completeness=completeness,
        overall=profiling.overall_quality(completeness),
        lowest=profiling.lowest_fields(completeness),
        message=profiling.lowest_message(completeness),
        crops=profiling.with_relative_bar(profiling.distribution(catalogue, "crop")),
        countries=profiling.with_relative_bar(profiling.distribution(catalogue, "country")),
        years=profiling.with_relative_bar(
            profiling.distribution(catalogue, "year_of_release", by="value")),
    )


@dataclass(frozen=True)
class Faceted:
    """A filtered table and what can be chosen from it."""

    records: DataFrame
    mapping: dict[str, str]
    limit: int | None

    @property
    def values(self) -> DataFrame:
        return facets.facet_table(self.records, limit=self.limit)

    @property
    def view(self) -> DataFrame:
        return facets.facet_view(self.records, mapping=self.mapping, limit=self.limit)


def facet(df: DataFrame, choices: Mapping[str, Iterable] | None = None, limit: int | None = None) -> Faceted:
    """Clean an upload, read its headers, and keep the rows that the choices allow."""
    records = cleaning.clean_frame(df, drop_blank=True)
    return Faceted(facets.facet_filter(records, choices or {}), headers.map_headers(records.columns), limit)
