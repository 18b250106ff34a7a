"""Match rows against a catalogue and fill their missing fields from what matched.

The catalogue is reduced to one row per key *before* the join, with all copies of a value
counted on the map side.  The input rows are then joined once to that summary, so neither
a popular key in the input nor a heavily repeated entry in the catalogue multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import text
from gristmill.functions.frames import cell_text, lookup_join, percent, present, quoted

ROWS = "__rows"
DELIMITERS = "[;,|]"
#: The values of a name with more rows than this are counted apart, in many tasks.
OFTEN = 100_000


def merge_lists(values: Column) -> Column:
    """An array of members as one sorted ``a; b; c`` list; null when empty."""
    members = F.array_sort(F.array_distinct(values))
    return F.nullif(F.array_join(members, "; "), F.lit(""))


def is_own(value: Column, own: Column) -> Column:
    """Whether a list member is the table's own country, given in clean form; an empty one owns nothing."""
    return (own != "") & (text.clean_text(value) == own)


def looks_numeric(value: Column) -> Column:
    return F.translate(value, ".,", "").rlike(r"^[0-9]+\z")


def parsed_number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def first_value(df: DataFrame, column: str, order: str) -> Column:
    """The first non-null value in the given order, as a scalar subquery."""
    filled = df.where(quoted(column).isNotNull())
    return filled.agg(F.min_by(quoted(column).cast("string"), quoted(order))).scalar()


def catalogue_summary(
    catalogue: DataFrame,
    fields: Sequence[str],
    crop: str | None = "crop",
    name: str = "variety_release_name",
    country: str | None = "country",
    own_country: Column | str | None = None,
    merged: Sequence[str] = config.MERGED_LIST_FIELDS,
    largest: Sequence[str] = config.LARGEST_NUMBER_FIELDS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """One row per lookup with the best value per field.

    Lookups are ``K:crop||name``, ``N:name`` and, with the count alone, ``E:name``.  Only those
    in ``asked`` (a table with the column ``lookup``) are summed up: rows that nothing asks for
    leave before their fields are looked at.  Names are counted first, which answers ``E``.
    """
    fields = present(catalogue, fields)
    listed = [f for f in fields if f in merged]
    # every match adds its own country to the list
    home = [cell_text(catalogue, country)] if country is not None and country in catalogue.columns else []
    raw = {f: f"__raw_{i}" for i, f in enumerate(fields)}
    # Keys first, on their own: below the expansion they are computed once per row.
    keyed = catalogue.select(
        (F.lit("") if crop is None else text.key_text(cell_text(catalogue, crop))).alias("crop_key"),
        text.key_text(cell_text(catalogue, name)).alias("name_key"),
        *[cell_text(catalogue, f).alias(c) for f, c in raw.items()], *[c.alias("__home") for c in home])
    # A name of punctuation alone is no name; nobody asks for one.
    named = F.col("name_key") != "" if asked is None else F.lit(True)
    counts = keyed.where(named).groupBy("name_key").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") > OFTEN).agg(F.collect_list("name_key")).scalar()
    known = counts.select(F.concat(F.lit("E:"), "name_key").alias("lookup"), F.col("n").alias("match_count"))
    lookups = keyed.where(named).select(
        F.explode(F.array(
            F.concat(F.lit("K:"), "crop_key", F.lit("||"), "name_key"), F.concat(F.lit("N:"), "name_key"),
        )).alias("lookup"), F.array_contains(often, F.col("name_key")).alias("__often"),
        *raw.values(), *["__home" for _ in home])
    if asked is not None:
        wanted = asked.select("lookup").distinct()
        lookups = lookup_join(lookups, wanted, ["lookup"], "left_semi")
        known = lookup_join(known, wanted, ["lookup"], "inner")

    # What a row says of a field: a filled text, or a list whose members are parted at the end.
    said = {f: f"__said_{i}" for i, f in enumerate(fields)}
    rows = lookups.select("lookup", "__often", *[
        F.nullif(F.concat_ws(";", c, *["__home" for _ in home]) if f in listed else text.strip(c), F.lit("")).alias(said[f])
        for f, c in raw.items()])

    def packet(field: str | None, value: Column, wide: bool = False) -> Column:
        return F.struct(F.lit(field).cast("string").alias("field"), value.cast("string").alias("value"), *[
            (F.col(c) if wide else F.lit(None).cast("string")).alias(c) for c in said.values()])

    # A row is one packet with all its fields.  Those of a frequent name are taken apart, so that
    # however many values such a name has, they are counted in many tasks.
    packets = rows.select("lookup", F.inline_outer(F.when(F.col("__often"), F.array(
        packet(ROWS, F.lit(".")), *[packet(f, F.col(c)) for f, c in said.items()],
    )).otherwise(F.array(packet(None, F.lit(None), True)))))

    def gathered(field: str, i: int) -> list[Column]:
        value = F.col(said[field])
        if field in merged:
            return [F.collect_set(value).alias(f"__members_{i}")]
        found = [F.mode(value, True).alias(f"__mode_{i}")]
        if field in largest:
            number = F.when(looks_numeric(value), parsed_number(value))
            found += [F.max(number).alias(f"__top_{i}"),
                      F.count_if(looks_numeric(value) & number.isNull()).alias(f"__unreadable_{i}")]
        return found

    per_lookup = packets.groupBy("lookup", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), *[c for i, f in enumerate(fields) for c in gathered(f, i)])

    def best(field: str, i: int) -> Column:
        here = (F.col("field") == field) & F.col("value").isNotNull()
        if field in merged:
            return F.concat(F.flatten(F.collect_list(f"__members_{i}")), F.collect_list(F.when(here, F.col("value"))))
        # most frequent value, the smallest one on a tie
        counted = F.min(F.when(here, F.struct((-F.col("n")).alias("n"), F.col("value")))).getField("value")
        mode = F.coalesce(F.max(f"__mode_{i}"), counted)
        if field in largest:
            numeric = here & looks_numeric(F.col("value"))
            unreadable = F.sum(f"__unreadable_{i}") + F.count_if(numeric & parsed_number(F.col("value")).isNull())
            top = F.max(F.coalesce(F.col(f"__top_{i}"), F.when(numeric, parsed_number(F.col("value")))))
            return F.when((unreadable == 0) & top.isNotNull(), text.python_float_text(top)).otherwise(mode)
        return mode

    summed = per_lookup.groupBy("lookup").agg(
        F.sum(F.when(F.col("field").isNull() | (F.col("field") == ROWS), F.col("n"))).alias("match_count"),
        *[best(f, i).alias(f"best_{f}") for i, f in enumerate(fields)],
    )
    if listed:
        own = F.lit(own_country) if isinstance(own_country, str) or own_country is None else own_country
        summed = summed.withColumn("__own", text.clean_text(own))

    def parted(lists: Column) -> Column:
        members = F.array_distinct(F.transform(F.split(F.array_join(lists, ";"), DELIMITERS), text.strip))
        return merge_lists(F.filter(members, lambda v: (v != "") & ~is_own(v, F.col("__own"))))

    return summed.select("lookup", "match_count", *[
        (parted(quoted(f"best_{f}")) if f in listed else quoted(f"best_{f}")).alias(f"best_{f}") for f in fields
    ]).union(known.select("lookup", "match_count", *[F.lit(None).cast("string") for _ in fields]))


def match_and_fill(
    rows: DataFrame,
    catalogue: DataFrame,
    fields: Sequence[str],
    crop_column: str | None,
    name: Column | str,
    own_country: Column | str | None = None,
    catalogue_crop: str | None = "crop",
    catalogue_name: str = "variety_release_name",
    catalogue_country: str | None = "country",
    merged: Sequence[str] = config.MERGED_LIST_FIELDS,
    largest: Sequence[str] = config.LARGEST_NUMBER_FIELDS,
) -> DataFrame:
    """Fill ``fields`` of every row from the catalogue rows with the same key.

    A row without a crop is matched by name alone.  A matched value replaces what the row
    held; a field without one keeps its old value, or is empty when the column is new.
    Adds ``match_status``, ``match_type``, ``match_count`` and ``match_confidence``.

    The rows' distinct lookups are answered first, from one scan of the catalogue; the rows
    themselves are shuffled once, to their answers.
    """
    no_crop = F.lit(True) if crop_column is None else text.is_blank(cell_text(rows, crop_column))
    crop_key = F.lit("") if crop_column is None else text.key_text(cell_text(rows, crop_column))
    keyed = rows.withColumns({
        "__no_crop": no_crop,
        "__crop": crop_key,
        "__name": text.key_text(quoted(name).cast("string") if isinstance(name, str) else name),
    }).withColumn("__has_name", F.col("__name") != "")
    lookup = F.when(F.col("__no_crop"), F.concat(F.lit("N:"), F.col("__name"))).otherwise(
        F.concat(F.lit("K:"), F.col("__crop"), F.lit("||"), F.col("__name"))
    )
    keyed = keyed.withColumn("lookup", F.when(F.col("__has_name"), lookup))
    # Does the name exist under some other crop?  Only asked for rows with a crop.
    exists = F.when(~F.col("__no_crop"), F.concat(F.lit("E:"), F.col("__name")))
    questions = keyed.where("lookup is not null").select("lookup", exists.alias("__open")).distinct()
    asked = questions.select(F.explode(F.array_compact(F.array("lookup", "__open"))).alias("lookup"))
    summary = catalogue_summary(
        catalogue, fields, catalogue_crop, catalogue_name, catalogue_country,
        own_country, merged, largest, asked,
    )
    best = {f: f"best_{f}" for f in fields if f"best_{f}" in summary.columns}
    # Answers to both kinds of question, brought together by the name that is asked for.
    whole = F.struct(*[quoted(c) for c in summary.columns if c != "lookup"])
    answers = questions.select("lookup", F.explode(F.array_compact(F.array(
        F.struct(F.col("lookup").alias("q"), F.lit(False).alias("open")),
        F.when(F.col("__open").isNotNull(), F.struct(F.col("__open").alias("q"), F.lit(True).alias("open"))),
    ))).alias("asks")).select("lookup", "asks.*")
    answers = (
        lookup_join(answers, summary.select(F.col("lookup").alias("q"), whole.alias("answer")), ["q"], "inner")
        .groupBy("lookup").agg(
            F.max(F.col("open")).alias("__known"),
            F.first(F.when(~F.col("open"), F.col("answer")), ignorenulls=True).alias("answer"))
        .select("lookup", "__known", "answer.*")
    )
    joined = lookup_join(keyed.drop("__name", "__crop"), answers, ["lookup"], "left")
    found = F.col("match_count").isNotNull()

    any_filled = F.lit(False)
    for column in best.values():
        any_filled = any_filled | (F.coalesce(quoted(column), F.lit("")) != "")
    status = (
        F.when(~F.col("__has_name"), "empty_name")
        .when(found & any_filled, "success")
        .when(found, "no_fields_filled")
        .when(F.col("__no_crop"), "variety_not_found")
        .when(F.col("__known"), "crop_mismatch")
        .otherwise("no_match")
    )

    def filled(field: str) -> Column:
        old = cell_text(rows, field) if field in rows.columns else F.lit("")
        if field not in best:
            return old
        return F.coalesce(F.nullif(quoted(best[field]), F.lit("")), old)

    kept = [
        (filled(c) if c in fields else quoted(c)).alias(c) for c in rows.columns
    ] + [filled(f).alias(f) for f in fields if f not in rows.columns]
    return joined.select(
        *kept,
        status.alias("match_status"),
        F.when(found, F.when(F.col("__no_crop"), "name_only").otherwise("crop_and_variety"))
        .alias("match_type"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.when(found, 1.0).otherwise(0.0).alias("match_confidence"),
        (F.col("__has_name") & F.col("__no_crop")).alias("no_crop_provided"),
    )


def match_stats(result: DataFrame) -> DataFrame:
    """Counts per outcome of :func:`match_and_fill`, in one pass."""
    status = F.col("match_status")
    totals = result.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(status == "success").alias("successful_matches"),
        F.count_if(status != "success").alias("failed_matches"),
        F.count_if(status == "crop_mismatch").alias("crop_mismatches"),
        F.count_if(F.col("no_crop_provided")).alias("no_crop_provided"),
        F.count_if(F.coalesce(F.col("match_type") == "name_only", F.lit(False)))
        .alias("name_only_matches"),
    )
    return totals.withColumn(
        "success_rate", percent(F.col("successful_matches"), F.col("total_processed"), 2)
    )


def match_details(
    result: DataFrame, order: str, name: str, crop: str | None = None, limit: int = 20
) -> DataFrame:
    """The outcome of the first rows, for a report."""
    return result.orderBy(quoted(order)).limit(limit).select(
        quoted(order).alias("row"),
        F.substring(quoted(name).cast("string"), 1, 50).alias("variety_name"),
        (F.lit("NOT PROVIDED") if crop is None else F.coalesce(
            F.nullif(F.substring(quoted(crop).cast("string"), 1, 30), F.lit("")),
            F.lit("NOT PROVIDED"),
        )).alias("country_crop"),
        "match_type", "match_count",
        F.col("match_status").alias("status"),
        F.col("match_confidence").alias("confidence"),
    )
