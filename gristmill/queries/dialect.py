"""SQL text for the oracle's engine, used to build the twins of the registered queries."""

from __future__ import annotations

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(value: str) -> str:
    return f"regexp_replace({value}, '{SPACE}+', ' ', 'g')"


def clean(value: str) -> str:
    text = squeeze(strip(f"coalesce(cast({value} as varchar), '')"))
    text = rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}_ \-.()]', '', 'g')"
    for letters, spelling in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"),
                              ("Æ", "AE"), ("Œ", "OE"), ("Ø", "O")):
        text = f"replace({text}, '{letters}', '{spelling}')"
    return strip(f"upper(strip_accents({text}))")


def key(value: str) -> str:
    return f"regexp_replace({clean(value)}, ' +', ' ', 'g')"


def blank(value: str) -> str:
    return f"coalesce({strip(f'cast({value} as varchar)')} = '', true)"


def scored(value: str) -> str:
    return f"(not coalesce({strip(f'cast({value} as varchar)')} in ('', 'nan'), true))"


def normalised(value: str) -> str:
    return (f"case when {value} is null or {value} in ('None', 'nan', 'NaN', '') then '' "
            f"else {strip(squeeze(strip(value)))} end")


def guard(value: str) -> str:
    """The spreadsheet guard, written with list functions instead of patterns."""
    v = "v"
    def digits(x: str) -> str:
        return f"regexp_full_match({x}, '[0-9]+')"
    def num(x: str) -> str:
        return f"try_cast({x} as double)"
    return f"""(select case
        when v is null or v = '' then v
        when len(dash) = 2 and {digits('trim(dash[1])')} and {digits('trim(dash[2])')} and (
            ({num('dash[1]')} between 1 and 12 and {num('dash[2]')} between 1 and 31)
            or ({num('dash[1]')} between 1 and 31 and {num('dash[2]')} between 1 and 12)
            or (length(trim(dash[1])) = 4 and length(trim(dash[2])) = 4
                and {num('dash[1]')} between 1900 and 2100 and {num('dash[2]')} between 1900 and 2100)
            or ({num('dash[1]')} < 32 and {num('dash[2]')} < 32)) then '''' || v
        when {digits("translate(v, '.,', '')")} and (case
            when regexp_full_match(n, '[0-9]{{4}}') then {num('n')} between 1900 and 2100
            when {digits('n')} and {num('n')} between 1 and 31 then true
            else v like '0_%' end) then '''' || v
        when len(slash) = 2 and {digits('trim(slash[1])')} and {digits('trim(slash[2])')}
            and {num('slash[1]')} between 1 and 12 and {num('slash[2]')} between 1 and 31 then '''' || v
        when length(v) <= 5 and len(colon) = 2 and {digits('colon[1]')} and {digits('colon[2]')}
            then '''' || v
        else v end
      from (select v, replace(v, ',', '') n, string_split(v, '-') dash,
                   string_split(v, '/') slash, string_split(v, ':') colon
            from (select case when s like '''_%' then substr(s, 2) else s end v
                  from (select {strip(value)} s))))"""


def percent(part: str, whole: str, digits: int = 1) -> str:
    return f"coalesce(round(({part}) * 100.0e0 / nullif({whole}, 0), {digits}), 0.0e0)"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
