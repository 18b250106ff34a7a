"""Queries over comparing two tables and filling one from the other."""

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.functions.frames import quoted
from gristmill.operators import fill
from gristmill.operators.link import Comparison
from gristmill.plans import flows
from gristmill.queries import dialect as sql
from gristmill.queries.cleaning import with_break
from gristmill.queries.registry import Tables, query

# --- comparison: orders against line items, keyed by (status, order number) -----------
# A line item belongs to an order's key only if it has the order's status.  Some names are
# blanked and some are written differently, by key arithmetic.


def _orders(t: Tables):
    number = F.concat(F.lit(" ord. "), F.col("o_orderkey"), F.lit(", "))
    return t.orders.select(
        F.col("o_orderstatus").alias("CROP"),
        F.when(F.col("o_orderkey") % 19 != 0, number).alias("VARIETY RELEASE NAME"),
        "o_orderkey", "o_orderpriority",
    )


def _lines(t: Tables):
    number = F.concat(F.lit("Ord. "), F.col("l_orderkey"))
    return t.lineitem.select(
        F.lower("l_linestatus").alias("CROP"),
        F.when(F.col("l_partkey") % 23 != 0, number).alias("VARIETY RELEASE NAME"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


_LEFT = """(select o_orderstatus as crop,
    case when o_orderkey % 19 <> 0 then 'ORD. ' || o_orderkey end as name,
    o_orderkey, o_orderpriority from orders)"""
_RIGHT = """(select l_linestatus as crop,
    case when l_partkey % 23 <> 0 then 'ORD. ' || l_orderkey end as name,
    l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)"""


def comparison(t: Tables) -> Comparison:
    return flows.compare(_orders(t), _lines(t))


_LEFT_OUT = """a.crop as "{0}CROP", coalesce(a.name, '') as "{0}VARIETY RELEASE NAME",
    a.o_orderkey as "{0}o_orderkey", {1} as "{0}o_orderpriority" """
_RIGHT_OUT = """b.crop as "{0}CROP", coalesce(b.name, '') as "{0}VARIETY RELEASE NAME",
    b.l_orderkey as "{0}l_orderkey", b.l_linenumber as "{0}l_linenumber",
    b.l_partkey as "{0}l_partkey", b.l_suppkey as "{0}l_suppkey" """
_PRIORITY = sql.clean("a.o_orderpriority")


@query(f"""select {_LEFT_OUT.format('File1_', _PRIORITY)}, {_RIGHT_OUT.format('File2_')},
    1.0e0 as "Match_Confidence", 'exact_crop_variety' as "Match_Type",
    a.crop || '||' || a.name as "Matched_Key"
  from {_LEFT} a join {_RIGHT} b on a.crop = b.crop and a.name = b.name""")
def compare_matches(t: Tables):
    return comparison(t).matches()


@query(f"""select a.crop || '||' || a.name as matched_key, n_left, n_right,
    n_left * n_right as pairs
  from (select crop, name, count(*) n_left from {_LEFT} where name is not null group by all) a
  join (select crop, name, count(*) n_right from {_RIGHT} where name is not null group by all) b
    on a.crop = b.crop and a.name = b.name""")
def compare_groups(t: Tables):
    return comparison(t).match_groups()


@query(f"""select {_LEFT_OUT.format('', _PRIORITY)} from {_LEFT} a where not exists (
    select 1 from {_RIGHT} b where a.crop = b.crop and a.name = b.name)""")
def compare_unique_left(t: Tables):
    return comparison(t).unique_left()


@query(f"""select {_RIGHT_OUT.format('')} from {_RIGHT} b where b.name is not null and not exists (
    select 1 from {_LEFT} a where a.crop = b.crop and a.name = b.name)""")
def compare_unique_right(t: Tables):
    return comparison(t).unique_right()


@query(f"""select {_RIGHT_OUT.format('')} from {_RIGHT} b where not exists (
    select 1 from {_LEFT} a where a.crop = b.crop and a.name = b.name)""")
def compare_unique_right_all(t: Tables):
    return comparison(t).including_blank().unique_right()


@query(f"""
with l as (select crop, name, count(*) n from {_LEFT} group by all),
r as (select crop, name, count(*) n from {_RIGHT} group by all),
x as (select sum(l.n * r.n) m, sum(l.n) lm, sum(r.n) rm from l join r on l.crop = r.crop and l.name = r.name),
c as (select (select count(*) from {_LEFT}) nl, (select count(*) from {_RIGHT}) nr,
             (select count(*) from {_RIGHT} where name is not null) nn)
select nl as total_file1, nr as total_file2, cast(m as bigint) as matches_found,
  cast(nl - lm as bigint) as unique_to_file1, cast(nn - rm as bigint) as unique_to_file2,
  round(m * 100.0e0 / nl, 2) as match_rate_file1, round(m * 100.0e0 / nr, 2) as match_rate_file2,
  '100%_exact_crop_variety' as matching_method
from x, c""")
def compare_stats(t: Tables):
    left = _orders(t)
    broken = with_break(F.col("VARIETY RELEASE NAME"), "o_orderkey")
    return flows.compare(left.withColumn("VARIETY RELEASE NAME", broken), _lines(t)).stats()


@query(f"""select p_partkey, {sql.key('p_type')} || '||' || {sql.key("p_brand || ' & ' || p_name")}
    as key from part""")
def composite_keys(t: Tables):
    name = with_break(F.concat("p_brand", F.lit(" & "), "p_name"), "p_partkey")
    return t.part.select("p_partkey", text.composite_key("p_type", name).alias("key"))


# --- filling: orders from line items --------------------------------------------------
# The uploaded table: orders, some without status, some with one no line has, some unnamed.

_UPLOAD = """(select o_orderkey, 'Ord ' || o_orderkey as name0,
    case when o_orderkey % 41 = 0 then null
         when o_orderkey % 43 = 0 then 'Nowhere ' || o_orderkey
         else 'Ord ' || o_orderkey end as name,
    case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 'Z'
         when o_orderkey % 2 = 0 then 'O' else 'F' end as crop,
    case when o_orderkey % 13 = 0 then 'old' end as seed_type from orders)"""
_CATALOGUE = """(select l_linestatus as crop, 'ORD ' || l_orderkey as name,
    'S' || (l_suppkey % 9) as country, l_returnflag as seed_type,
    case when l_partkey % 17 = 0 then 'high' else cast(l_quantity as varchar) end as yield_mt_ha,
    cast(year(l_shipdate) as varchar) as maturity_days,
    'S' || (l_partkey % 9) || '; S' || (l_linenumber % 9) as others from lineitem)"""
FILLED = ("seed_type", "yield_mt_ha", "maturity_days", "other_countries_of_release")


def _upload(t: Tables):
    key = F.col("o_orderkey")
    named = F.concat(F.lit("Ord "), key)
    return t.orders.select(
        "o_orderkey",
        F.when(key % 41 == 0, None).when(key % 43 == 0, F.concat(F.lit("Nowhere "), key))
        .otherwise(named).alias("name"),
        F.when(key % 7 == 0, None).when(key % 11 == 0, "Z").when(key % 2 == 0, "O")
        .otherwise("F").alias("crop"),
        F.when(key % 13 == 0, "old").alias("seed_type"),
    )


def _line_catalogue(t: Tables):
    return t.lineitem.select(
        F.col("l_linestatus").alias("crop"),
        F.concat(F.lit("ord  "), "l_orderkey").alias("variety_release_name"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 9).alias("country"),
        F.col("l_returnflag").alias("seed_type"),
        F.when(F.col("l_partkey") % 17 == 0, "high")
        .otherwise(F.col("l_quantity").cast("string")).alias("yield_mt_ha"),
        F.year("l_shipdate").cast("string").alias("maturity_days"),
        F.concat(F.lit("S"), F.col("l_partkey") % 9, F.lit("; S"), F.col("l_linenumber") % 9)
        .alias("other_countries_of_release"),
    )


def filled_orders(t: Tables):
    return fill.match_and_fill(
        _upload(t), _line_catalogue(t), FILLED, "crop", "name", own_country="s3")


def _mode(field: str) -> str:
    return f"""(select lk, arg_min(v, (-n, v)) as v from
        (select lk, {field} as v, count(*) as n from m where {field} is not null group by all)
        group by lk)"""


# m holds every catalogue row once per lookup: by crop and name, and by name alone.
FILL_SQL = f"""(
with c as materialized (select * from {_CATALOGUE}),
m as materialized (select 'K:' || crop || '||' || name as lk, * from c
      union all select 'N:' || name, * from c),
rows_ as (select lk, count(*) as match_count from m group by lk),
seed as {_mode('seed_type')}, maturity as {_mode('maturity_days')}, modal as {_mode('yield_mt_ha')},
top as (select lk, max(try_cast(yield_mt_ha as double)) as v from m group by lk),
others as (select lk, string_agg(v, '; ' order by v) as v from (
    select distinct lk, trim(unnest(string_split(others, ';') || [country])) as v from m)
    where v <> 'S3' group by lk),
u as materialized (select *, upper(name) as n, case when name is null then null
        when crop is null then 'N:' || upper(name) else 'K:' || crop || '||' || upper(name) end as lk
      from {_UPLOAD}),
j as (select u.*, r.match_count, seed.v as a, coalesce(cast(top.v as varchar), modal.v) as b,
        maturity.v as d, others.v as e,
        exists (select 1 from c where c.name = u.n) as known
      from u left join rows_ r using (lk) left join seed using (lk) left join top using (lk)
      left join modal using (lk) left join maturity using (lk) left join others using (lk))
select o_orderkey, name, crop, coalesce(a, seed_type) as seed_type, coalesce(b, '') as yield_mt_ha,
  coalesce(d, '') as maturity_days, coalesce(e, '') as other_countries_of_release,
  case when name is null then 'empty_name' when match_count is not null then 'success'
       when crop is null then 'variety_not_found' when known then 'crop_mismatch'
       else 'no_match' end as match_status,
  case when match_count is not null then
    case when crop is null then 'name_only' else 'crop_and_variety' end end as match_type,
  coalesce(match_count, 0) as match_count,
  case when match_count is not null then 1.0e0 else 0.0e0 end as match_confidence,
  name is not null and crop is null as no_crop_provided
from j)"""


@query(f"select * from {FILL_SQL}")
def match_fill(t: Tables):
    return filled_orders(t)


@query(f"""select count(*) as total_processed,
    count(*) filter (match_status = 'success') as successful_matches,
    count(*) filter (match_status <> 'success') as failed_matches,
    count(*) filter (match_status = 'crop_mismatch') as crop_mismatches,
    count(*) filter (no_crop_provided) as no_crop_provided,
    count(*) filter (match_type = 'name_only') as name_only_matches,
    {sql.percent("count(*) filter (match_status = 'success')", 'count(*)', 2)} as success_rate
  from {FILL_SQL}""")
def match_stats(t: Tables):
    return fill.match_stats(filled_orders(t))


@query(f"""select o_orderkey as row, substr(name, 1, 50) as variety_name,
    coalesce(crop, 'NOT PROVIDED') as country_crop, match_type, match_count,
    match_status as status, match_confidence as confidence
  from {FILL_SQL} order by o_orderkey limit 20""")
def match_details(t: Tables):
    return fill.match_details(filled_orders(t), "o_orderkey", "name", "crop")


# --- filling by name alone: customers' nations from the supplier table ----------------


@query("""
with m as (select s_nationkey as n, count(*) as match_count, max(s_acctbal) as top,
    min(s_name) as company from supplier group by all)
select c_custkey, c_nationkey, coalesce(company, '') as commercialising_companies,
  case when company is null then 'variety_not_found' else 'success' end as match_status,
  coalesce(match_count, 0) as match_count
from customer left join m on n = c_nationkey""")
def match_name_only(t: Tables):
    suppliers = t.supplier.select(
        F.concat(F.lit("Nation "), "s_nationkey").alias("variety_release_name"),
        F.lit("any").alias("crop"), F.col("s_name").alias("commercialising_companies"),
    )
    customers = t.customer.select(
        "c_custkey", "c_nationkey", F.concat(F.lit("nation "), "c_nationkey").alias("name"))
    filled = fill.match_and_fill(
        customers, suppliers, ["commercialising_companies"], None, "name",
        catalogue_country=None)
    return filled.select(
        "c_custkey", "c_nationkey", "commercialising_companies", "match_status", "match_count")


# --- the whole flow: parts as upload and catalogue, headers found by name -------------


@query("""
with m as materialized (select p_type, upper(p_name) as n, cast(p_size as double) as s, p_brand from part),
best as (select p_type, n, max(s) as top, count(*) as match_count,
    array_to_string(list_sort(list_distinct(list(p_brand))), '; ') as brands
    from m group by all),
others as (select p_type, n, string_agg(distinct p_brand, '; ' order by p_brand) as o from m
    where upper(replace(p_brand, '#', '')) <> (
        select upper(replace(p_brand, '#', '')) from part order by p_partkey limit 1)
    group by all)
select upper(p.p_name) as "VARIETY RELEASE NAME", p.p_type as "CROP",
  upper(replace(p.p_brand, '#', '')) as "COUNTRY", p.p_partkey as ref,
  cast(top as varchar) as yield_mt_ha, coalesce(o, '') as other_countries_of_release,
  'success' as match_status, match_count
from part p join best b on b.p_type = p.p_type and b.n = upper(p.p_name)
left join others o on o.p_type = p.p_type and o.n = upper(p.p_name)""")
def match_and_fill_flow(t: Tables):
    upload = t.part.select(
        F.concat(F.lit(" "), F.col("p_name")).alias("VARIETY RELEASE NAME"),
        F.lower("p_type").alias("CROP"), F.col("p_brand").alias("COUNTRY"),
        F.col("p_partkey").alias("ref"),
    )
    master = t.part.select(
        F.col("p_type").alias("crop"), F.col("p_name").alias("variety_release_name"),
        F.col("p_brand").alias("country"), F.col("p_size").alias("yield_mt_ha"),
        F.lit(None).cast("string").alias("other_countries_of_release"),
    )
    filled = flows.match_and_fill(
        upload, master, ["yield_mt_ha", "other_countries_of_release"], order="ref")
    kept = [c for c in filled.columns if c not in
            ("match_type", "match_confidence", "no_crop_provided")]
    return filled.select(*[quoted(c) for c in kept])
