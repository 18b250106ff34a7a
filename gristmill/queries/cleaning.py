"""Queries over the cleaning functions."""

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import cleaning, headers
from gristmill.queries import dialect as sql
from gristmill.queries.registry import Tables, query

# Spellings of market segments, as an example of a small alias table.
SEGMENT_ALIASES = {"AUTOMOBILE": "VEHICLES", "MACHINERY": "INDUSTRY", "BUILDING": "INDUSTRY"}


# Line breaks at the end, as cells of uploads have them.
_BREAKS = "case doc_id % 4 when 1 then chr(10) when 2 then chr(13) || chr(10) when 3 then chr(8232) else '' end"


def with_break(value, key):
    kind = F.col(key) % 4
    ending = F.when(kind == 1, "\n").when(kind == 2, "\r\n").when(kind == 3, "\u2028").otherwise("")
    return F.concat(value, ending)


@query(f"""select doc_id, {sql.clean('text')} as cleaned, {sql.clean(f"source || {_BREAKS}")} as cleaned_source
from documents""")
def clean_text(t: Tables):
    return t.documents.select(
        "doc_id", text.clean_text("text").alias("cleaned"),
        text.clean_text(with_break(F.col("source"), "doc_id")).alias("cleaned_source"))


@query(r"""
select p_partkey,
       try_cast(nullif(regexp_replace(p_brand, '[^0-9.\-]', '', 'g'), '') as double) as brand_number,
       try_cast(nullif(regexp_replace(p_name || p_size || '-' || p_brand, '[^0-9.\-]', '', 'g'), '')
                as double) as not_a_number
from part""")
def clean_numeric(t: Tables):
    joined = F.concat("p_name", "p_size", F.lit("-"), "p_brand")
    return t.part.select(
        "p_partkey",
        text.clean_numeric("p_brand").alias("brand_number"),
        text.clean_numeric(joined).alias("not_a_number"),
    )


@query(f"""
select c_custkey, case {sql.clean('c_mktsegment')}
    when 'AUTOMOBILE' then 'VEHICLES' when 'MACHINERY' then 'INDUSTRY'
    when 'BUILDING' then 'INDUSTRY' else {sql.clean('c_mktsegment')} end as segment
from customer""")
def standardise_values(t: Tables):
    segment = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("! "))
    return t.customer.select(
        "c_custkey", text.standardise(segment, SEGMENT_ALIASES).alias("segment"))


@query("""
select c_custkey, coalesce(r_name, 'NATION_' || c_nationkey) as nation
from customer left join nation on n_nationkey = c_nationkey
left join region on r_regionkey = n_regionkey""")
def standardise_by_table(t: Tables):
    aliases = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("alias"), F.col("r_name").alias("standard"))
    customers = t.customer.select(
        "c_custkey", F.concat(F.lit("nation_"), "c_nationkey").alias("nation"))
    return cleaning.standardise_by_table(customers, "nation", aliases)


@query(f"select doc_id, {sql.normalised('text')} as text, {sql.normalised('lang')} as lang, "
       "n_chars from documents")
def normalise_whitespace(t: Tables):
    return cleaning.clean_text_columns(t.documents.select("doc_id", "text", "lang", "n_chars"))


# Customers with some cells blanked by key arithmetic: the given table holds no nulls.
GAPPY_CUSTOMER_SQL = """(select c_custkey,
    case when c_custkey % 7 = 0 then null else c_name end as c_name,
    case when c_custkey % 5 = 0 then null else c_nationkey end as c_nationkey,
    case when c_custkey % 11 = 0 then null else c_acctbal end as c_acctbal,
    case when c_custkey % 13 = 0 then ' ' else lower(c_mktsegment) || ' & co' end as c_mktsegment
  from customer)"""


def gappy_customer(t: Tables):
    def unless(divisor, value, other=None):
        return F.when(F.col("c_custkey") % divisor == 0, other).otherwise(value)

    return t.customer.select(
        "c_custkey",
        unless(7, F.col("c_name")).alias("c_name"),
        unless(5, F.col("c_nationkey")).alias("c_nationkey"),
        unless(11, F.col("c_acctbal")).alias("c_acctbal"),
        unless(13, F.concat(F.lower("c_mktsegment"), F.lit(" & co")), F.lit(" "))
        .alias("c_mktsegment"),
    )


@query(f"""select c_custkey, {sql.clean('c_name')} as c_name, c_nationkey, c_acctbal,
    {sql.clean('c_mktsegment')} as c_mktsegment from {GAPPY_CUSTOMER_SQL}""")
def clean_frame(t: Tables):
    return cleaning.clean_frame(gappy_customer(t))


@query(f"""
with b as (select * from {GAPPY_CUSTOMER_SQL}),
a as (select count(*) r, count(c_custkey) k, count(c_name) n, count(c_nationkey) x,
             count(c_acctbal) b, count(c_mktsegment) m from b)
select c as "column", o as original_non_null, z as cleaned_non_null, o - z as null_values_removed,
       r as original_rows, r as cleaned_rows, cast(0 as bigint) as rows_removed,
       5 as columns_processed
from (select 'c_custkey' c, k o, k z, r from a union all select 'c_name', n, r, r from a
      union all select 'c_nationkey', x, x, r from a union all select 'c_acctbal', b, b, r from a
      union all select 'c_mktsegment', m, r, r from a)""")
def clean_frame_report(t: Tables):
    before = gappy_customer(t)
    return cleaning.cleaning_report(before, cleaning.clean_frame(before))


_ORDER_YEAR = "cast(year(o_orderdate) as varchar)"
_ORDER_DAY = "month(o_orderdate) || '-' || (day(o_orderdate) * 3)"


@query(f"""select o_orderkey, {sql.guard(_ORDER_YEAR)} as year_of_release,
    {sql.guard(_ORDER_DAY)} as maturity_days,
    {sql.guard("cast(o_custkey as varchar)")} as altitude,
    {sql.guard("lpad(cast(o_custkey as varchar), 6, '0')")} as yield_code,
    o_orderpriority from orders""")
def excel_guard(t: Tables):
    day = F.concat(F.month("o_orderdate"), F.lit("-"), F.dayofmonth("o_orderdate") * 3)
    orders = t.orders.select(
        "o_orderkey",
        F.year("o_orderdate").alias("year_of_release"),
        day.alias("maturity_days"),
        F.col("o_custkey").alias("altitude"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("yield_code"),
        "o_orderpriority",
    )
    return cleaning.guard_columns(orders)


@query(f"""select event_id, {sql.guard("hour(ts) || ':' || minute(ts)")} as clock,
    {sql.guard("(1 + user_id % 15) || '/' || (event_id % 40)")} as fraction,
    {sql.guard("cast(value as varchar)")} as amount from events""")
def guard_times(t: Tables):
    clock = F.concat(F.hour("ts"), F.lit(":"), F.minute("ts"))
    fraction = F.concat(1 + F.col("user_id") % 15, F.lit("/"), F.col("event_id") % 40)
    return t.events.select(
        "event_id",
        text.guard_for_spreadsheet(clock).alias("clock"),
        text.guard_for_spreadsheet(fraction).alias("fraction"),
        text.guard_for_spreadsheet("value").alias("amount"),
    )


@query(r"""
select page_id,
       case when length(s) > 31 then substr(s, 1, 28) || '...' else s end as sheet_name,
       replace(regexp_replace(url || ' copy', '[<>:"/\\|?*]', '', 'g'), ' ', '_') as file_name
from (select *, regexp_replace(url, '[\\/*?\[\]:]', '', 'g') s from pages)""")
def safe_names(t: Tables):
    return t.pages.select(
        "page_id",
        text.safe_sheet_name("url").alias("sheet_name"),
        text.safe_file_name(F.concat("url", F.lit(" copy"))).alias("file_name"),
    )


@query(f"""select to_json(b) as json
    from (select c_custkey, c_name, c_nationkey, c_mktsegment from {GAPPY_CUSTOMER_SQL}) b""")
def serialise_rows(t: Tables):
    return cleaning.serialise(
        gappy_customer(t).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


# --- headers --------------------------------------------------------------------------


def foreign_part(t: Tables):
    """Parts under the headers of somebody else's catalogue."""
    return t.part.select(
        F.col("p_partkey").alias("Ref"),
        F.col("p_type").alias("CROP"),
        F.col("p_name").alias("VARIETY RELEASE NAME"),
        F.col("p_brand").alias("MAINTAINER (ORG)"),
        F.col("p_size").alias("YIELD (MT/HA) est."),
    )


@query("""select p_type as crop, p_name as variety_release_name, p_brand as maintainer,
    p_size as yield_mt_ha from part""")
def map_headers(t: Tables):
    table = foreign_part(t)
    return headers.apply_mapping(table, headers.map_headers(table.columns))


@query("""select p_name as variety_release_name, p_type as crop, p_brand as country,
    p_size as yield_mt_ha, p_partkey as year_of_release from part""")
def map_headers_by_alias(t: Tables):
    aliases = {
        name: headers.config.HEADER_ALIASES[name]
        for name in ("variety_release_name", "crop", "country", "yield_mt_ha", "year_of_release")
    }
    table = t.part.select(
        F.col("p_name").alias("Cultivar"), F.col("p_type").alias("Species"),
        F.col("p_brand").alias("Origin"), F.col("p_size").alias("Productivity"),
        F.col("p_partkey").alias("Release_Year"),
    )
    return headers.apply_mapping(table, headers.map_by_alias(table.columns, aliases))


@query(f"""select c_custkey, coalesce(nullif({sql.strip('c_name')}, ''),
    nullif({sql.strip('c_mktsegment')}, ''), null) as name
    from {GAPPY_CUSTOMER_SQL}""")
def row_names(t: Tables):
    table = gappy_customer(t)
    mapping = {"c_mktsegment": "crop"}
    key_column = headers.find_key_column(table, mapping)
    named = table.select(
        "c_custkey", "c_name", "c_mktsegment")
    return named.select(
        "c_custkey", headers.extract_name(named, key_column, mapping).alias("name"))


@query("""select p_name as variety_release_name, p_type as crop, p_size as yield_mt_ha,
    1990 + p_size as year_of_release from part""")
def detected_headers(t: Tables):
    """Headers that no list knows, told by the names they contain."""
    table = t.part.select(
        F.col("p_name").alias("variety"), F.col("p_type").alias("crop group"), F.col("p_size").alias("yield"),
        (F.lit(1990) + F.col("p_size")).alias("years"))
    return headers.apply_mapping(table, headers.detect_columns(table.columns))


@query("select doc_id, text as tagged from documents")
def tagged_column(t: Tables):
    """The free-text column, asked for under a slightly different name."""
    table = t.documents.select("doc_id", "lang", F.col("text").alias("special atributes"))
    column = headers.find_text_column(table.columns, wanted="special attributes")
    return table.select("doc_id", F.col(f"`{column}`").alias("tagged"))
