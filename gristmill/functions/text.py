"""Column expressions for cleaning, guarding and testing single values.

All of them are built-in Spark functions, so they stay inside the JVM and inside
whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import config

# Every character Python's ``str.isspace`` accepts; ``trim`` alone only knows the space.
SPACES = "".join(
    chr(code) for code in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_SPACE = r"[\s\x1c-\x1f]"  # under (?U)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_string(value: Column | str) -> Column:
    return as_column(value).cast("string")


def strip(value: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(as_string(value), F.lit(SPACES))


def squeeze(value: Column | str) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(as_string(value), f"(?U){_SPACE}+", " ")


@lru_cache(maxsize=1)
def _latin_letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Accented Latin letters and their ASCII spelling, derived from Unicode decomposition."""
    # fixed values: letters that Unicode does not decompose
    spelled = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
    single = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
              "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i"}
    for code in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = "".join(
            ch for ch in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(ch)
        )
        if letter in spelled or letter in single or not letter.isalnum():
            continue
        if plain.isascii() and plain.isalnum():
            (single if len(plain) == 1 else spelled)[letter] = plain
    return "".join(single), "".join(single.values()), tuple(spelled.items())


def transliterate(value: Column | str) -> Column:
    """Latin letters to ASCII.  Other scripts are left as they are."""
    text = as_string(value)
    letters, plain, spelled = _latin_letters()
    changed = F.translate(text, letters, plain)
    for letter, spelling in spelled:
        changed = F.replace(changed, F.lit(letter), F.lit(spelling))
    return changed


def _cleaned(value: Column | str, settle: bool) -> Column:
    """Clean a value by the cheapest of three ways.

    Values made of plain words only need upper case, and ASCII values no transliteration and no
    Unicode classes.  Each way mentions the value once, so nothing is computed twice.
    """
    source = as_string(value)

    def full(fold: bool) -> Column:
        if fold:
            kept = F.regexp_replace(squeeze(strip(source)), r"[^\p{L}\p{N}_ \-.()]", "")
            text = strip(F.upper(transliterate(kept)))
        else:  # no other character is space or letter here
            kept = F.regexp_replace(F.regexp_replace(source, r"[\t-\r\x1c-\x20]+", " "), r"[^A-Za-z0-9_ \-.()]", "")
            text = F.trim(F.upper(kept))
        return F.regexp_replace(text, "  +", " ") if settle else text

    # No repeated group: Java would recurse into it on long texts.  ``$`` would also match
    # before a last line break.
    words = source.rlike(r"^(?! )(?!.*  )[A-Za-z0-9_\-.() ]*+(?<! )\z")
    ascii_only = ~source.rlike(r"[^\x00-\x7F]")
    return (
        F.coalesce(F.when(words, F.upper(source)).when(ascii_only, full(False))
                   .otherwise(full(True)), F.lit(""))
    )


def clean_text(value: Column | str) -> Column:
    """Upper-case ASCII form used for keys; null becomes the empty string.

    White space is collapsed before punctuation goes, so ``Beans & Peas`` keeps two
    spaces.  :func:`key_text` is the form without that effect.
    """
    return _cleaned(value, settle=False)


def key_text(value: Column | str) -> Column:
    """:func:`clean_text` brought to a fixed point, so that keys are idempotent."""
    return _cleaned(value, settle=True)


def settled(cleaned: Column | str) -> Column:
    """The :func:`key_text` of a value that is already in clean form."""
    return F.regexp_replace(as_string(cleaned), "  +", " ")


def clean_numeric(value: Column | str) -> Column:
    """Keep digits, dot and minus and read the rest as a double, or null."""
    digits = F.regexp_replace(as_string(value), r"[^\d.\-]", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def standardise(value: Column | str, aliases: dict[str, str]) -> Column:
    """Clean a value and replace it by its standard spelling when it has one."""
    cleaned = clean_text(value)
    if not aliases:
        return cleaned
    table = F.create_map(*[F.lit(part) for pair in aliases.items() for part in pair])
    return F.coalesce(F.try_element_at(table, cleaned), cleaned)


def normalise_whitespace(value: Column | str) -> Column:
    """Trim and collapse white space; null and the literal words for it become empty."""
    text = as_string(value)
    missing = text.isNull() | text.isin("None", "nan", "NaN", "")
    return F.when(missing, F.lit("")).otherwise(strip(squeeze(strip(text))))


def is_blank(value: Column | str) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(strip(value) == "", F.lit(True))


def is_scored(value: Column | str) -> Column:
    """Counts towards a row's completeness: neither blank nor the word ``nan``."""
    return ~F.coalesce(strip(value).isin("", "nan"), F.lit(True))


def skip_reason(crop: Column | str, variety: Column | str) -> Column:
    """Why a row lacks a usable key, or null when it has one."""
    crop, variety = as_column(crop), as_column(variety)
    no_crop, no_variety = is_blank(crop), is_blank(variety)
    says = config.SKIP_REASONS
    return (
        F.when(no_crop & no_variety, says["both"])
        .when(no_crop & crop.isNull(), says["crop is null"])
        .when(no_crop, says["crop is empty"])
        .when(no_variety & variety.isNull(), says["variety is null"])
        .when(no_variety, says["variety is empty"])
    )


_TO_31 = "0*(?:[0-9]|[12][0-9]|3[01])"
_1_TO_31 = "0*(?:[1-9]|[12][0-9]|3[01])"
_1_TO_12 = "0*(?:[1-9]|1[0-2])"
_YEAR = "(?:19[0-9]{2}|20[0-9]{2}|2100)"
_AROUND = f"{_SPACE}*"
# Day and month pairs, year ranges, fractions, clock times of at most five characters.
_DATE_LIKE = "(?U)" + "|".join((
    f"^{_TO_31}{_AROUND}-{_AROUND}{_TO_31}\\z",
    f"^{_YEAR}{_AROUND}-{_AROUND}{_YEAR}\\z",
    f"^{_1_TO_12}{_AROUND}/{_AROUND}{_1_TO_31}\\z",
    r"^(?=.{3,5}\z)[0-9]+:[0-9]+\z",
))


def guard_for_spreadsheet(value: Column | str) -> Column:
    """Put ``'`` before a value that a spreadsheet would read as a date, year or time.

    Guarded are two numbers below 32 or two years with a dash between, a year, a whole
    number from 1 to 31, other numbers with a leading zero (but not four digits), a month
    and a day with a slash, and short clock times.
    """
    trimmed = strip(value)
    quote = trimmed.startswith("'") & (F.length(trimmed) > 1)
    # White space after a removed quote stays in the value but does not count.
    bare = F.when(quote, F.substr(trimmed, F.lit(2))).otherwise(trimmed)
    seen = strip(bare)
    plain = F.replace(bare, F.lit(","), F.lit(""))
    number = bare.rlike(r"^[.,]*[0-9][0-9.,]*\z") & (
        plain.rlike(rf"^{_YEAR}\z")
        | (
            ~plain.rlike(r"^[0-9]{4}\z")
            & (plain.rlike(rf"^{_1_TO_31}\z") | (bare.startswith("0") & (F.length(bare) > 1)))
        )
    )
    guarded = seen.rlike(_DATE_LIKE) | number
    return (
        F.when(~trimmed.rlike("[0-9]"), bare)
        .when(guarded, F.concat(F.lit("'"), bare))
        .otherwise(bare)
    )


def safe_sheet_name(value: Column | str, max_length: int = 31) -> Column:
    name = F.regexp_replace(as_string(value), r"[\\/*?\[\]:]", "")
    short = F.concat(F.substring(name, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(name) > max_length, short).otherwise(name)


def safe_file_name(value: Column | str) -> Column:
    name = F.regexp_replace(as_string(value), r'[<>:"/\\|?*]', "")
    return F.replace(name, F.lit(" "), F.lit("_"))


def composite_key(crop: Column | str | None, variety: Column | str) -> Column:
    """``CROP||VARIETY``; a missing part is empty."""
    left = F.lit("") if crop is None else key_text(crop)
    return F.concat(left, F.lit("||"), key_text(variety))


def python_float_text(value: Column) -> Column:
    """A double written the way Python's ``str`` writes it.

    Spark writes an exponent below 0.001 and from 1e7, Python below 0.0001 and from 1e16; the
    digits are the same, only the point moves.
    """
    written = value.cast("string")
    parts = F.split(written, "E")
    sign = F.when(written.startswith("-"), "-").otherwise("")
    # One digit before the point, and none behind the last that counts.
    digits = F.regexp_replace(F.translate(parts[0], "-.", ""), r"(?<=.)0+\z", "")
    exponent = F.try_element_at(parts, F.lit(2)).cast("int")
    size = F.length(digits)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.concat(sign, F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))
    split = F.concat(sign, F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    power = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0"))
    scientific = F.concat(
        sign, F.substr(digits, F.lit(1), F.lit(1)),
        F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
        F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), power)
    return (
        F.when(exponent.isNull(), written)
        .when(exponent.between(-4, -1), small)
        .when(exponent.between(0, 15), F.when(size <= exponent + 1, whole).otherwise(split))
        .otherwise(scientific)
    )


def literal_pattern(text: str, wildcards: bool) -> str:
    """A LIKE pattern for "contains"; ``%`` and ``_`` are plain unless asked for."""
    if not wildcards:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{text}%"


def contains_ci(value: Column | str, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment, null-safe."""
    column = as_string(value)
    if wildcards:
        hit = column.ilike(literal_pattern(text, True))
    else:
        hit = F.contains(F.lower(column), F.lower(F.lit(text)))
    return F.coalesce(hit, F.lit(False))
