"""Queries over trait tagging and fuzzy name matching."""

from pyspark.sql import functions as F

from gristmill import config
from gristmill.operators import fuzzy, traits
from gristmill.queries import dialect as sql
from gristmill.queries.registry import Tables, query
from gristmill.sources import catalogue

# The given documents are invented words.  Each gets one of these notes before and one
# after its own text, so that every rule has something to decide.
NOTES = (
    "Resistant to maize streak virus.", "Not resistant to blight.",
    "Susceptible to rust but drought tolerant.", "Low yielding; suitable for highlands.",
    "Good storage, good taste, bitter.", "Popular, palatable, attractive color, bitter.",
    "Resistant to lodging.", "rust, rust", "Weevil resistant and keeps well", "",
    "Without drought tolerance; performs in the dry season and under water stress",
    "tolerant to thrips, never preferred. Fall armyworm and stem borer resistant",
    "pest susceptible; insect damage, post-harvest pest resistant",
)


def noted_documents(t: Tables):
    notes = F.array(*[F.lit(n) for n in NOTES])
    def note(expression):
        return F.element_at(notes, (expression + 1).cast("int"))

    text = F.concat(
        note(F.col("doc_id") % len(NOTES)), F.lit(" "), F.col("text"), F.lit(" "),
        note((F.col("doc_id") * 7 + 3) % len(NOTES)),
    )
    kept = F.when(F.col("doc_id") % 17 == 0, None).when(F.col("doc_id") % 19 == 0, "  ").otherwise(text)
    return t.documents.select("doc_id", kept.alias("special_attributes"))


_NOTES = sql.text_list(NOTES)
_NOTED = f"""(select doc_id, case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then '  '
    else {_NOTES}[doc_id % {len(NOTES)} + 1] || ' ' || text || ' '
      || {_NOTES}[(doc_id * 7 + 3) % {len(NOTES)} + 1] end as special_attributes from documents)"""
# Word boundaries are ASCII in the oracle: accented letters stand in as plain ones.
_TEXTS = rf"""(select doc_id, regexp_replace(lower({sql.strip("coalesce(special_attributes, '')")}),
    '[\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}]', 'x', 'g') as t
  from {_NOTED})"""
_NEGATED = r"regexp_matches({0}, '\b(?:" + "|".join(config.NEGATION_WORDS) + r")\b')"


def _hits(phrase: str) -> str:
    return rf"regexp_extract_all(t, '([^\n]{{0,30}})\b{phrase}\b', 1)"


def _counts(trait: str) -> str:
    """Positive, negated and explicit hits of one trait, phrase by phrase."""
    listed = config.TRAIT_PHRASES[trait]
    words = " or ".join(f"contains(a, '{w}')" for w in config.GENERIC_CONTEXT[trait])
    yes, negated, explicit = [], [], []
    for phrase in listed["YES"]:
        befores = f"case when contains(t, '{phrase}') then {_hits(phrase)} else [] end"
        negated.append(f"len([b for b in {befores} if {_NEGATED.format('b')}])")
        if phrase not in config.GENERIC_PHRASES:
            yes.append(f"len([b for b in {befores} if not {_NEGATED.format('b')}])")
            continue
        # Cut the text at the hits and put the phrase back to see what follows each.
        pieces = rf"string_split(regexp_replace(t, '([^\n]{{0,30}})\b{phrase}\b', '\1' || chr(1), 'g'), chr(1))"
        yes.append(f"""case when contains(t, '{phrase}') then len([1 for i in range(1, len({_hits(phrase)}) + 1)
            if not {_NEGATED.format(f'({_hits(phrase)})[i]')}
            and len([a for a in [substr(array_to_string(({pieces})[i + 1:], '{phrase}'), 1, 50)] if {words}]) > 0])
            else 0 end""")
    for phrase in listed["NO"]:
        explicit.append(f"case when contains(t, '{phrase}') then len({_hits(phrase)}) else 0 end")
    y, n, e = (" + ".join(x) for x in (yes, negated, explicit))
    return f"({y}) as y_{trait}, ({n}) as n_{trait}, ({e}) as e_{trait}"


def _verdict(trait: str) -> str:
    y, n, e = (f"{kind}_{trait}" for kind in "yne")
    return f"""case when {y} = 0 then 'NO' when {e} > 0 then case when {y} >= 3 * {e} then 'YES'
        else 'NO' end when {y} >= 2 * {n} then 'YES' else 'NO' end as {trait}"""


_TAGGED = f"""(select doc_id, {', '.join(_verdict(t) for t in config.TRAITS)}
  from (select doc_id, {', '.join(_counts(t) for t in config.TRAITS)} from {_TEXTS}))"""


@query(f"select * from {_TAGGED}")
def trait_tags(t: Tables):
    return traits.extract_traits(noted_documents(t)).drop("special_attributes")


@query(f"select * from {_TAGGED}")
def trait_tags_of_repeated(t: Tables):
    """The same traits, each distinct text scanned once."""
    return traits.extract_traits_once(noted_documents(t)).drop("special_attributes")


@query(f"""select cast(doc_id as varchar) as variety_release_name, {', '.join(config.TRAITS)},
    4.5e0 as data_quality_score, source as country from {_TAGGED} join documents using (doc_id)""")
def load_with_traits(t: Tables):
    """Documents loaded as catalogue entries, their traits taken from the text on the way."""
    rows = noted_documents(t).join(t.documents.select("doc_id", "source"), "doc_id")
    loaded = catalogue.catalogue_records(rows, {
        "doc_id": "variety_release_name", "source": "country", "special_attributes": "special_attributes",
    }, with_traits=True)
    return loaded.select("variety_release_name", *config.TRAITS, "data_quality_score", "country")


@query(f"""
with d as materialized (select * from {_TAGGED} join {_NOTED} using (doc_id))
select trait, yes as yes_count, n - yes as no_count, {sql.percent('yes', 'n', 4)} as yes_percentage,
  n as total_records, w as records_with_text, {sql.percent('w', 'n')} as enrichment_rate
from (select count(*) n, count(*) filter (not {sql.blank('special_attributes')}) w from d),
  ({' union all '.join(f"select '{t}' trait, count(*) filter ({t} = 'YES') yes from d" for t in config.TRAITS)})""")
def trait_report(t: Tables):
    return traits.trait_report(traits.extract_traits(noted_documents(t)))


# --- fuzzy matching: page titles, looked up under slightly different spellings --------


def titles(t: Tables):
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def misspelled(t: Tables):
    """Every title with its last word gone, two words swapped, or a letter missing."""
    title = F.col("title")
    kind = F.col("page_id") % 4
    words = F.split(title, " ")
    return titles(t).select(
        "page_id",
        F.when(kind == 0, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "))
        .when(kind == 1, F.array_join(F.reverse(words), " "))
        .when(kind == 2, F.concat(F.substring(title, 1, 4), F.substr(title, F.lit(6))))
        .otherwise(F.lower(title)).alias("asked"),
    )


_TITLES = "(select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)"
_ASKED = f"""(select page_id, case page_id % 4
    when 0 then array_to_string(w[1:greatest(len(w) - 1, 1)], ' ')
    when 1 then array_to_string(list_reverse(w), ' ')
    when 2 then substr(title, 1, 4) || substr(title, 6) else lower(title) end as asked
  from (select *, string_split(title, ' ') w from {_TITLES}))"""


def _gram_rows(source: str, value: str) -> str:
    return f"""(select c, g, count(*) as tf from (
        select c, unnest(flatten([[substr(w, i, n) for i in range(1, length(w) - n + 2)] for n in [2, 3, 4]])) g
        from (select c, ' ' || unnest(string_split(lower(c), ' ')) || ' ' as w from
              (select distinct {sql.clean(value)} as c from {source}))
        where w <> '  ') group by c, g)"""


# Unit vectors of the names and of the queries, and all cosines above zero.
_COSINES = f"""names as materialized (select c, arg_min(title, page_id) as name, min(page_id) as pos, count(*) as copies
    from (select *, {sql.clean('title')} as c from {_TITLES}) where length(c) >= 2 group by c),
ng as materialized (select * from {_gram_rows(_TITLES, 'title')} where length(c) >= 2),
idf as materialized (select g, ln((1.0e0 + (select sum(copies) from names)) / (1.0e0 + sum(copies))) + 1.0e0 as w
    from ng join names using (c) group by g),
nv as materialized (select c, g, tf * w / sqrt(sum((tf * w) * (tf * w)) over (partition by c)) as x from ng join idf using (g)),
qg as (select * from {_gram_rows(_ASKED, 'asked')} where length(c) >= 2),
qv as materialized (select c, g, tf * w / sqrt(sum((tf * w) * (tf * w)) over (partition by c)) as x from qg join idf using (g)),
s as materialized (select qv.c as q, nv.c as c, sum(qv.x * nv.x) as cosine from qv join nv using (g) group by 1, 2)"""


@query(f"""
with {_COSINES}
select q as query, cast(r as integer) as rank, name as matched_name, round(cosine, 6) as cosine
from (select *, row_number() over (partition by q order by round(cosine, 9) desc, pos) r
      from s join names using (c) where cosine >= 0.5e0) where r <= 2""")
def tfidf_topk(t: Tables):
    index = fuzzy.fit_names(titles(t), "title", "page_id")
    best = fuzzy.top_cosine(misspelled(t), "asked", index, at_least=0.5, top=2)
    return best.withColumn("cosine", F.round("cosine", 6))


def _ordered(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda t: t <> '')), ' ')"


def _common(masks: str, width: str) -> str:
    """Length of the longest common subsequence, from the places of each character in a text of ``width``."""
    full = f"((1::bigint << {width}) - 1)"
    step = f"((row + (row & m)) | (row - (row & m))) & {full}"
    return f"({width} - bit_count(list_reduce(list_prepend({full}, {masks}), lambda row, m: {step})))"


def _places(entry: str, text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda ch: coalesce({entry}[ch], 0::bigint))"


def _window_ratio(entry: str, short: str, long: str) -> str:
    """The best ratio of a text and any window of a longer one."""
    part = (f"list_slice({_places(entry, long)}, greatest(spot, 0) + 1, least(spot + length({short}), length({long})))")
    size = f"(least(spot + length({short}), length({long})) - greatest(spot, 0))"
    return (f"list_max(list_transform(range(1 - length({short}), length({long})), lambda spot: "
            f"2.0e0 * {_common(part, f'length({short})')} / (length({short}) + {size})))")


# Titles have at most 60 characters, so a bit for each fits a big integer.
_BEST = f"""
{_COSINES},
texts as (select q as t from s union select c from s union select {_ordered('q')} from s union select {_ordered('c')} from s),
chars as (select t, unnest(string_split(t, '')) as ch, unnest(range(length(t))) as spot from texts),
masks as materialized (select t, map(list(ch), list(mask)) as entry
    from (select t, ch, sum(1::bigint << spot)::bigint as mask from chars group by all) group by t),
whole as materialized (select q, c, cosine, entry, case when length(q) < 5 then 0.4e0 else 0.6e0 end as share,
    2.0e0 * {_common(_places('entry', 'c'), 'length(q)')} / (length(q) + length(c)) as ratio
  from s join masks on t = q),
near as materialized (select * from (select *, max(share * cosine + (1 - share) * ratio) over (partition by q) as least_best
    from whole) where share * cosine + (1 - share) >= least_best - 1e-9),
alike as (select q, c, cosine, share, greatest(ratio,
    2.0e0 * {_common(_places('o.entry', _ordered('c')), 'length(o.t)')} / (length(o.t) + length({_ordered('c')})),
    case when length(q) <= length(c) then {_window_ratio('near.entry', 'q', 'c')} else 0 end,
    case when length(c) <= length(q) then {_window_ratio('m.entry', 'c', 'q')} else 0 end) as similarity
  from near join masks m on m.t = c join masks o on o.t = {_ordered('q')}),
scored as (select *, round(share * cosine + (1 - share) * similarity, 12) as score from alike),
best as materialized (select q, arg_min(name, pos) as name, max(score) as score from (
    select *, max(round(score, 9)) over (partition by q) as top from scored join names using (c))
  where round(score, 9) = top group by q)"""


def _matched(threshold: float) -> str:
    return f"""(select page_id, asked, ci as cleaned_input, case when score >= {threshold} - 1e-9 then name end as matched_name,
    case when length(ci) < 2 then 0 else score end as confidence_score, coalesce(score >= {threshold} - 1e-9, false) as is_match
  from (select *, {sql.clean('asked')} as ci from {_ASKED}) left join best on q = ci)"""


def matched_titles(t: Tables, threshold: float):
    index = fuzzy.fit_names(titles(t), "title", "page_id")
    return fuzzy.fuzzy_match(misspelled(t), "asked", index, threshold)


@query(f"""with {_BEST} select page_id, asked, cleaned_input, matched_name, is_match,
  round(confidence_score, 6) as confidence_score from {_matched(0.8)}""")
def fuzzy_match(t: Tables):
    return matched_titles(t, 0.8).withColumn("confidence_score", F.round("confidence_score", 6))


@query(f"""with {_BEST} select count(*) as total_queries, count(*) filter (is_match) as matches_found,
  {sql.percent('count(*) filter (is_match)', 'count(*)', 4)} as match_rate,
  round(coalesce(avg(confidence_score) filter (is_match), 0.0e0), 6) as average_confidence from {_matched(0.3)}""")
def fuzzy_stats(t: Tables):
    """Also below the thresholds that edit similarity alone can reach."""
    return fuzzy.fuzzy_stats(matched_titles(t, 0.3))


# A handful of names given by hand: the titles of two pages, cut and turned around, and some others.
BY_HAND = ("Onor the of it", "thly on Toanensting", "no such title", "x", "")
_BY_HAND = "(select unnest([" + ", ".join(f"'{n}'" for n in BY_HAND) + "]) as asked, 0 as page_id)"


@query(f"""with {_BEST.replace(_ASKED, _BY_HAND)} select input, cleaned_input, matched_name, is_match,
  round(confidence_score, 6) as confidence_score
from (select asked as input, ci as cleaned_input, case when score >= 0.7e0 - 1e-9 then name end as matched_name,
    case when length(ci) < 2 then 0 else score end as confidence_score, coalesce(score >= 0.7e0 - 1e-9, false) as is_match
  from (select *, {sql.clean('asked')} as ci from {_BY_HAND}) left join best on q = ci)""")
def match_names(t: Tables):
    index = fuzzy.fit_names(titles(t), "title", "page_id")
    return fuzzy.match_names(t.pages.sparkSession, BY_HAND, index).withColumn(
        "confidence_score", F.round("confidence_score", 6))
