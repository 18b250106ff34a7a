"""Queries over search, lookups, pages, suggestions and facets."""

from pyspark.sql import functions as F

from gristmill.operators import facets, search
from gristmill.plans import flows
from gristmill.queries import dialect as sql
from gristmill.queries.registry import Tables, query


def part_catalogue(t: Tables):
    """Parts under catalogue names."""
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("variety_release_name"),
        F.col("p_type").alias("crop"),
        F.col("p_brand").alias("country"),
        F.col("p_size").cast("string").alias("year_of_release"),
        F.concat("p_type", F.lit(" "), "p_name").alias("botanical_name"),
    )


PARTS = """(select p_partkey as id, p_name as variety_release_name, p_type as crop,
    p_brand as country, cast(p_size as varchar) as year_of_release,
    p_type || ' ' || p_name as botanical_name from part)"""


def _cascade(word: str, extra: str = "true") -> str:
    w = word.lower()
    levels = ("contains(lower(variety_release_name), '{0}')", "contains(lower(crop), '{0}')",
              "contains(lower(country), '{0}')", "contains(lower(botanical_name), '{0}')")
    tests = [level.format(w) for level in levels]
    first = " ".join(f"when bool_or({test}) then {i}" for i, test in enumerate(tests))
    chosen = " or ".join(f"(l = {i} and {test})" for i, test in enumerate(tests))
    return (f"select id, variety_release_name, crop, country, year_of_release, botanical_name "
            f"from {PARTS}, (select case {first} end as l from {PARTS}) where ({chosen}) and {extra}")


@query(_cascade("BLUE"))
def search_cascading(t: Tables):
    return search.search(part_catalogue(t), "BLUE")


@query(_cascade("econ"))
def search_cascading_crop(t: Tables):
    return search.cascading_search(part_catalogue(t), "econ")


@query(_cascade("brand#1", "contains(year_of_release, '1')"))
def search_cascading_filtered(t: Tables):
    return search.cascading_search(part_catalogue(t), "brand#1", {"year_of_release": "1", "crop": ""})


@query(_cascade("small red"))
def search_cascading_other_fields(t: Tables):
    return search.cascading_search(part_catalogue(t), "small red")


@query("""select doc_id, lang, source from documents
    where contains(lower(text), 'ing of') or contains(lower(lang), 'ing of')
       or contains(lower(source), 'ing of')""")
def search_global(t: Tables):
    hits = search.global_search(t.documents, "ing OF", columns=["text", "lang", "source"])
    return hits.select("doc_id", "lang", "source")


@query("""select doc_id, lang from documents
    where lower(text) like '%th_t the%' and contains(source, 'src1')""")
def search_wildcards(t: Tables):
    hits = search.search(t.documents, "th_t the", {"source": "src1"}, mode="global",
                         columns=["text"], wildcards=True)
    return hits.select("doc_id", "lang")


@query("""select event_id, event_type, user_id from events
    where contains(event_type, 'c') and contains(cast(user_id as varchar), '7')""")
def search_filters(t: Tables):
    hits = search.field_filters(t.events, {"event_type": "C", "user_id": "7", "props": ""})
    return hits.select("event_id", "event_type", "user_id")


@query(f"""select id, crop from {PARTS} where contains(lower(variety_release_name), 'pro')
    or contains(lower(crop), 'pro')""")
def lookup_search(t: Tables):
    return search.lookup_search(part_catalogue(t), "pro").select("id", "crop")


@query(f"""select id, variety_release_name, crop, country, year_of_release, botanical_name
    from {PARTS} where id = 77""")
def record_by_id(t: Tables):
    return search.by_id(part_catalogue(t), 77)


@query("""select o_orderkey, o_orderstatus, o_totalprice, (select count(*) from orders) as total,
    cast(ceil((select count(*) from orders) / 50.0e0) as bigint) as pages, 3 as current_page
  from orders order by o_totalprice desc, o_orderkey limit 50 offset 100""")
def search_page(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return search.page(rows, [F.col("o_totalprice").desc(), "o_orderkey"], 3, 50)


@query("""select o_orderkey, o_orderstatus, o_custkey from orders
  where (o_custkey, o_orderkey) > (700, 0) order by o_custkey, o_orderkey limit 40""")
def search_after(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    return search.search_after(rows, ["o_custkey", "o_orderkey"], (700, 0), 40)


@query("""select n // 100 + 1 as page, o_custkey, o_orderkey, least(100, total - n) as rows
  from (select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as n,
               count(*) over () as total from orders) where n % 100 = 0""")
def page_index(t: Tables):
    return search.page_index(t.orders, ["o_custkey", "o_orderkey"], 100)


@query("""select o_orderkey, o_orderstatus, o_custkey from orders order by o_custkey, o_orderkey limit 100 offset 1100""")
def page_of_index(t: Tables):
    order = ["o_custkey", "o_orderkey"]
    index = search.page_index(t.orders, order, 100)
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    return search.page_of_index(rows, index, order, 12)


@query("""select count(*) as total, cast(ceil(count(*) / 20.0e0) as bigint) as pages,
    4 as current_page, 20 as per_page, cast(61 as bigint) as start_item,
    least(80, count(*)) as end_item from customer""")
def page_info(t: Tables):
    return search.page_info(t.customer, 4, 20)


@query(f"""select variety_release_name as suggestion from {PARTS}
    where contains(lower(variety_release_name), 'ol') group by 1 order by 1 limit 10""")
def suggest(t: Tables):
    return search.suggest(part_catalogue(t), "OL", "variety_release_name")


@query("select distinct year(o_orderdate) as value from orders")
def distinct_values(t: Tables):
    years = t.orders.select(F.year("o_orderdate").alias("y"))
    return search.distinct_values(years, "y", descending=True)


@query("select * from events order by ts desc, event_id limit 20")
def preview(t: Tables):
    return search.preview(t.events, [F.col("ts").desc(), "event_id"], 20)


# --- facets ---------------------------------------------------------------------------

ORDER_FACETS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "note"]


def faceted_orders(t: Tables):
    note = F.when(F.col("o_orderkey") % 2 == 0, "nan").when(F.col("o_orderkey") % 3 == 0, " ").otherwise(
        F.concat(F.lit("n"), F.col("o_custkey") % 300))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                           note.alias("note"))


_NOTE = """case when o_orderkey % 2 = 0 then 'nan' when o_orderkey % 3 = 0 then ' ' else 'n' || (o_custkey % 300) end"""
_FACETS = " union all ".join(
    f"""(select '{c}' as column_name, v as value, count(*) as record_count from
        (select cast({e} as varchar) v from orders)
        where v is not null and trim(v) not in ('', 'nan') and v <> 'NaN'
        group by v)"""
    for c, e in (*[(c, c) for c in ORDER_FACETS[:4]], ("note", """case when o_orderkey % 2 = 0
        then 'nan' when o_orderkey % 3 = 0 then ' ' else 'n' || (o_custkey % 300) end"""))
)


@query(_FACETS)
def facet_table(t: Tables):
    return facets.facet_table(faceted_orders(t))


@query(f"""select column_name, case column_name when 'o_orderstatus' then 'maintenance_status'
        else column_name end as friendly_name,
    string_agg(value, '|' order by value) filter (r <= 100) as facet_values,
    cast(count(*) as integer) as total_values, (select count(*) from orders) as total_records
  from (select *, row_number() over (partition by column_name order by value) r from ({_FACETS})) group by column_name""")
def facet_view(t: Tables):
    view = facets.facet_view(faceted_orders(t), mapping={"o_orderstatus": "maintenance_status"}, limit=100)
    return view.withColumn("facet_values", F.array_join("facet_values", "|"))


@query("""select * from orders where o_orderstatus in ('O', 'P')
    and o_custkey % 10 = 3 and o_custkey < 1000""")
def facet_filter(t: Tables):
    choices = {"o_orderstatus": ["O", "P"], "o_custkey": range(3, 1000, 10), "o_orderkey": []}
    return facets.facet_filter(t.orders, choices)


@query("select * from orders where o_custkey % 2 = 1 and o_custkey < 6000")
def facet_filter_long(t: Tables):
    return facets.facet_filter(t.orders, {"o_custkey": range(1, 6000, 2)})


@query("""select count(*) filter (event_type in ('click', 'view') and user_id in (1, 7, 42))
    as total_matching, count(*) as total_original, 2 as filters_applied from events""")
def facet_counts(t: Tables):
    return facets.facet_counts(
        t.events, {"event_type": ["click", "view"], "user_id": [1, 7, 42], "props": []})


_CLEAN_FACETS = " union all ".join(
    f"""(select '{c}' as column_name, v as value, count(*) as record_count from (select {sql.clean(e) if text
        else f'cast({e} as varchar)'} v from orders where o_orderstatus in ('O', 'P')) where v is not null and v <> ''
        group by v)"""
    for c, e, text in (("o_custkey", "o_custkey", False), ("o_orderstatus", "o_orderstatus", True),
                       ("o_orderpriority", "o_orderpriority", True), ("note", _NOTE, True))
)


@query(f"select * from {_CLEAN_FACETS}")
def facet_flow(t: Tables):
    """Facets of a table as it is uploaded: cleaned first, then filtered."""
    rows = faceted_orders(t).drop("o_orderkey").withColumn("o_orderstatus", F.lower("o_orderstatus"))
    return flows.facet(rows, {"o_orderstatus": ["O", "P"]}).values
