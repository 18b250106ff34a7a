"""Rule-based tagging of free text: YES/NO traits with negation and context checks.

A text's words are looked up once in a table of the words that phrases begin with.  Only for
phrases that can occur is the text cut at the phrase, by a pattern that is the same for all rows;
a hit has up to 30 characters before it.  The rules are built-in functions over arrays.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions.frames import cell_text, lookup_join, percent, quoted
from gristmill.functions.text import is_blank, strip

Phrases = Mapping[str, Mapping[str, Sequence[str]]]

HITS = "array<struct<before:string,at:int>>"


def _any_word(words: Sequence[str]) -> str:
    return "|".join(f"\\Q{word}\\E" for word in words)


def _may_overlap(phrase: str) -> bool:
    """Whether two hits of a phrase can share words, as in "so and so and so"."""
    words = re.findall(r"\w+|[^\w]", phrase)
    return any(words[:k] == words[-k:] for k in range(1, len(words)))


def _last_line_end(text: Column) -> Column:
    """The characters right before the end of a text, on its last line."""
    return F.right(F.substring_index(text, "\n", -1), F.lit(config.CONTEXT_BEFORE))


def _scan(phrase: Column, pieces: Column) -> Column:
    """Hits of a whole phrase in a text that was cut at it: what stands before each one, and what follows.

    A hit sees up to 30 characters back on its line, but not beyond the previous hit; one that
    starts less than 30 characters after the start of the previous hit's view belongs to that
    hit and extends it.
    """
    def step(acc: Column, at: Column) -> Column:
        gap = F.element_at(pieces, at)
        reach = F.length(acc["before"]) + F.length(phrase) + F.length(gap)
        extends = F.coalesce(
            (reach <= config.CONTEXT_BEFORE) & ~F.contains(gap, F.lit("\n")), F.lit(False))
        done = F.when(extends | acc["before"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["before"].alias("before"), acc["at"].alias("at")))))
        before = F.when(extends, F.concat(acc["before"], phrase, gap)).otherwise(_last_line_end(gap))
        return F.struct(done.alias("done"), before.alias("before"), at.alias("at"))

    def finish(acc: Column) -> Column:
        last = F.struct(acc["before"].alias("before"), acc["at"].alias("at"))
        return F.concat(acc["done"], F.array(last))

    start = F.struct(
        F.array().cast(HITS).alias("done"),
        F.lit(None).cast("string").alias("before"), F.lit(0).alias("at"))
    found = F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), start, step, finish)

    def with_rest(hit: Column) -> Column:
        # every further piece adds at least one character
        rest = F.call_function(
            "array_join", F.slice(pieces, hit["at"] + 1, config.CONTEXT_AFTER + 1), phrase)
        return F.struct(hit["before"].alias("before"),
                        F.substring(rest, 1, config.CONTEXT_AFTER).alias("after"))

    found = F.when(F.size(pieces) > 1, found).otherwise(F.array().cast(HITS))
    return F.transform(found, with_rest)


def _first_word(phrase: str) -> str | None:
    """The ASCII word that a phrase begins with; none if it begins with something else.

    Where the phrase occurs, that word also stands by itself in the text's ASCII words.
    """
    found = re.match(r"\w+", phrase)
    return found[0] if found and found[0].isascii() else None


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _occurs(text: str, words: str, phrase: str) -> str:
    first = _first_word(phrase)
    held = f"contains({text}, {_text(phrase)})"
    return held if first is None else f"array_contains({words}, {_text(first)}) AND {held}"


def _all_hits(text: str, words: str, phrases: Sequence[str]) -> Column:
    """Hits of every phrase that occurs in the text at all; ``words`` are its words that begin phrases.

    Both are names of columns: so many expressions are quicker to read as one text.
    """
    none = F.array().cast("array<struct<before:string,after:string>>")

    def cut(phrase: str) -> str:
        whole = f"(?U)\\Q{phrase}\\E\\b(?<=\\b\\Q{phrase}\\E)"
        return (f"named_struct('phrase', {_text(phrase)}, 'pieces', CASE WHEN {_occurs(text, words, phrase)} "
                f"THEN split({text}, {_text(whole)}, -1) END)")

    def matched(phrase: str) -> Column:
        """Of hits that share words the last counts; only the pattern itself says which that is."""
        whole = (f"(?dU)(.{{0,{config.CONTEXT_BEFORE}}})\\b\\Q{phrase}\\E\\b"
                 f"(?=((?s:.{{0,{config.CONTEXT_AFTER}}})))")
        both = F.arrays_zip(*[
            F.regexp_extract_all(text, F.lit(whole), F.lit(group)).alias(name)
            for group, name in ((1, "before"), (2, "after"))])
        return F.when(F.expr(_occurs(text, words, phrase)), both).otherwise(none)

    plain = [cut(p) for p in phrases if not _may_overlap(p)]
    found = [matched(p) for p in phrases if _may_overlap(p)]
    if plain:
        occurring = F.filter(F.expr(f"array({', '.join(plain)})"), lambda entry: entry["pieces"].isNotNull())
        found.append(F.flatten(F.transform(occurring, lambda entry: _scan(entry["phrase"], entry["pieces"]))))
    return F.concat(none, *found)


def _evidence(
    text: str, words: str, phrases: Mapping[str, Sequence[str]], generic: Sequence[str], context: Sequence[str],
) -> dict[str, Column]:
    """Hits of one trait: specific and generic positives, explicit negatives."""
    needs_context = set(generic) if context else set()
    yes = phrases.get("YES", ())
    return {
        "specific": _all_hits(text, words, [p for p in yes if p not in needs_context]),
        "generic": _all_hits(text, words, [p for p in yes if p in needs_context]),
        "explicit": F.size(_all_hits(text, words, phrases.get("NO", ()))),
    }


def _resolve(yes: Column, negated: Column, explicit: Column) -> Column:
    enough = F.when(explicit > 0, yes >= explicit * 3).otherwise(yes >= negated * 2)
    return F.when((yes > 0) & enough, "YES").otherwise("NO")


def extract_traits(
    df: DataFrame,
    text_column: str = "special_attributes",
    phrases: Phrases = config.TRAIT_PHRASES,
    negation: Sequence[str] = config.NEGATION_WORDS,
    generic: Sequence[str] = config.GENERIC_PHRASES,
    generic_context: Mapping[str, Sequence[str]] = config.GENERIC_CONTEXT,
) -> DataFrame:
    """Add one YES/NO column per trait.

    A positive phrase is turned around by a negation word before it; a generic one counts
    only with a word of its trait after it.  Positives must outweigh explicit negatives
    three to one, turned ones two to one.  Missing text, or a missing column, gives NO.
    """
    if text_column not in df.columns:
        return df.withColumns({trait: F.lit("NO") for trait in phrases})
    kept = [c for c in df.columns if c not in phrases]
    prepared = df.select(*kept, F.lower(strip(F.coalesce(cell_text(df, text_column), F.lit(""))))
                         .alias("__text"))
    firsts = sorted({_first_word(p) or "" for listed in phrases.values() for kind in listed.values() for p in kind})
    prepared = prepared.withColumn("__words", F.array_intersect(
        F.split("__text", r"\W+"), F.array(*[F.lit(w) for w in firsts]).cast("array<string>")))
    text, words = "__text", "__words"
    negates = f"(?U)\\b(?:{_any_word(negation)})\\b"

    # Three steps, so that each scan of the text is planned once.
    found = prepared.withColumns({
        f"__{kind}_{trait}": hits
        for trait, listed in phrases.items()
        for kind, hits in _evidence(
            text, words, listed, generic, generic_context.get(trait, ())).items()
    })

    def counts(trait: str) -> dict[str, Column]:
        specific, both = F.col(f"__specific_{trait}"), F.col(f"__generic_{trait}")
        words = _any_word(generic_context.get(trait, ()))

        def negated(hit: Column) -> Column:
            return hit["before"].rlike(negates)

        return {
            f"__yes_{trait}": F.size(F.filter(specific, lambda h: ~negated(h)))
            + F.size(F.filter(both, lambda h: ~negated(h) & h["after"].rlike(words))),
            f"__negated_{trait}": F.size(F.filter(specific, negated)) + F.size(F.filter(both, negated)),
        }

    counted = found.withColumns({k: v for trait in phrases for k, v in counts(trait).items()})
    return counted.select(*kept, *[
        _resolve(F.col(f"__yes_{t}"), F.col(f"__negated_{t}"), F.col(f"__explicit_{t}")).alias(t)
        for t in phrases
    ])


def extract_traits_once(df: DataFrame, text_column: str = "special_attributes", **rules) -> DataFrame:
    """:func:`extract_traits` for tables whose texts repeat: each distinct text is scanned once.

    The rows meet their traits by a digest of the text, not by the text.
    """
    phrases = rules.get("phrases", config.TRAIT_PHRASES)
    if text_column not in df.columns:
        return extract_traits(df, text_column, **rules)
    text = cell_text(df, text_column)
    kept = [quoted(c) for c in df.columns if c not in phrases]
    keyed = df.select(*kept, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("__digest_of_text"))
    texts = keyed.groupBy("__digest_of_text").agg(F.any_value(quoted(text_column).cast("string")).alias(text_column))
    tagged = extract_traits(texts, text_column, **rules).drop(text_column)
    return lookup_join(keyed, tagged, ["__digest_of_text"], "left").drop("__digest_of_text")


def trait_report(
    df: DataFrame, text_column: str = "special_attributes",
    traits: Sequence[str] = config.TRAITS,
) -> DataFrame:
    """Per trait: YES and NO rows and the YES share, with the share of rows that have text."""
    has_text = F.lit(False)
    if text_column in df.columns:
        has_text = ~is_blank(cell_text(df, text_column))
    traits = [t for t in traits if t in df.columns]
    measured = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(has_text).alias("records_with_text"),
        *[F.count_if(F.coalesce(F.col(t) == "YES", F.lit(False))).alias(f"__{t}") for t in traits],
    )
    rows = measured.select(
        "total_records", "records_with_text",
        F.inline(F.array(*[
            F.struct(F.lit(t).alias("trait"), F.col(f"__{t}").alias("yes_count")) for t in traits
        ])),
    )
    total = F.col("total_records")
    return rows.select(
        "trait", "yes_count", (total - F.col("yes_count")).alias("no_count"),
        percent(F.col("yes_count"), total, 4).alias("yes_percentage"),
        "total_records", "records_with_text",
        percent(F.col("records_with_text"), total).alias("enrichment_rate"),
    )
