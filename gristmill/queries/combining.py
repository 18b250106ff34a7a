"""Queries over combining and deduplicating tables."""

from pyspark.sql import functions as F

from gristmill.operators import combine
from gristmill.plans import flows
from gristmill.queries import dialect as sql
from gristmill.queries.registry import Tables, query

# Two tables with different headers; some keys are blanked by key arithmetic.


def sources(t: Tables) -> list[combine.Source]:
    customers = t.customer.select(
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("CROP"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("  "))
        .when(F.col("c_custkey") % 13 != 0, F.concat(F.col("c_name"), F.lit("  x ")))
        .alias("VARIETY RELEASE NAME"),
        F.concat(F.lit("N"), "c_nationkey").alias("COUNTRY"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("YIELD (MT/HA)"),
        F.col("c_custkey").alias("ref"),
    )
    suppliers = t.supplier.select(
        F.col("s_name").alias("VARIETY RELEASE NAME:"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit(" ")).otherwise(F.lit("SUPPLIES")).alias("Crop species"),
        F.concat(F.lit("N"), "s_nationkey").alias("COUNTRY"),
        F.col("s_suppkey").alias("ref"),
    )
    return [
        combine.Source("customer", customers, position=F.col("ref")),
        combine.Source("supplier", suppliers, position=F.col("ref")),
    ]


_CUSTOMER = """select case when c_custkey % 7 <> 0 then c_mktsegment end as crop,
    case when c_custkey % 11 = 0 then '  ' when c_custkey % 13 <> 0 then c_name || '  x ' end as name,
    'N' || c_nationkey as country, case when c_custkey % 3 <> 0 then c_acctbal end as yield,
    c_custkey as ref, 'customer' as f, 1 as i from customer"""
_SUPPLIER = """select case when s_suppkey % 7 = 0 then ' ' else 'SUPPLIES' end as crop,
    s_name as name, 'N' || s_nationkey as country, cast(null as double) as yield,
    s_suppkey as ref, 'supplier' as f, 2 as i from supplier"""
_BOTH = f"({_CUSTOMER} union all {_SUPPLIER})"
_OK = f"not {sql.blank('crop')} and not {sql.blank('name')}"

COMBINED_SQL = f"""(select case when i = 1 then {sql.normalised('crop')} else '' end as crop,
    {sql.normalised('name')} as variety_release_name, {sql.normalised('country')} as country,
    cast(yield as varchar) as yield_mt_ha, f as source_file, i as source_index,
    ref + 2 as row_number from {_BOTH} where {_OK})"""


@query(f"""select crop, variety_release_name, country, yield_mt_ha, source_file, source_index
    from {COMBINED_SQL}""")
def combine_sources(t: Tables):
    return combine.combine(sources(t))


@query(f"""
select f as file_name, i as file_index, ref + 2 as row_number, crop as crop_value,
  name as variety_value,
  case when {sql.blank('crop')} and {sql.blank('name')} then 'Both crop and variety are missing or empty'
       when crop is null then 'Crop is missing (null/NaN)'
       when {sql.blank('crop')} then 'Crop is empty'
       when name is null then 'Variety is missing (null/NaN)' else 'Variety is empty' end as skip_reason,
  case when i = 1 then to_json({{'CROP': crop, 'VARIETY RELEASE NAME': name, 'COUNTRY': country,
                               'YIELD (MT/HA)': yield, 'ref': ref}})
       else to_json({{'VARIETY RELEASE NAME:': name, 'Crop species': crop, 'COUNTRY': country,
                     'ref': ref}}) end as original_data
from {_BOTH} where not ({_OK})""")
def quarantine(t: Tables):
    return combine.quarantine(sources(t))


_STATS = f"""select f as filename, i as source_index, count(*) as record_count,
    case when i = 1 then 5 else 4 end as columns_count,
    case when i = 1 then 'CROP' else 'Crop species' end as crop_column,
    case when i = 1 then 'VARIETY RELEASE NAME' else 'VARIETY RELEASE NAME:' end as variety_column,
    count(*) filter ({_OK}) as valid_records, count(*) filter (not ({_OK})) as skipped_records
  from {_BOTH} group by f, i"""


@query(_STATS)
def source_stats(t: Tables):
    return combine.source_stats(sources(t))


@query(f"""select count(*) as total_files, cast(sum(valid_records) as bigint) as total_valid_records,
    cast(sum(skipped_records) as bigint) as total_skipped_records from ({_STATS})""")
def combine_totals(t: Tables):
    return combine.combine_totals(combine.source_stats(sources(t)))


# Orders by customer and day: a table with duplicate keys whose rows differ in completeness.
_ORDER_CELLS = """(select
    case when o_orderkey % 97 = 0 then null else 'C' || o_custkey end as crop,
    o_orderpriority as variety_release_name,
    case when o_orderkey % 3 = 0 then null else o_orderstatus end as seed_type,
    case when o_orderkey % 5 = 0 then ' ' else strftime(o_orderdate, '%Y-%m-%d') end as year_of_release,
    case when o_orderkey % 4 = 0 then 'nan' else o_orderstatus end as maintainer,
    o_orderkey as ref from orders)"""
_ORDER_FILLED = " + ".join(
    f"cast({sql.scored(c)} as integer)"
    for c in ("crop", "variety_release_name", "seed_type", "year_of_release", "maintainer", "ref")
)


def order_cells(t: Tables):
    def unless(divisor, value, other=None):
        return F.when(F.col("o_orderkey") % divisor == 0, other).otherwise(value)

    return t.orders.select(
        unless(97, F.concat(F.lit("C"), "o_custkey")).alias("crop"),
        F.col("o_orderpriority").alias("variety_release_name"),
        unless(3, F.col("o_orderstatus")).alias("seed_type"),
        unless(5, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ")).alias("year_of_release"),
        unless(4, F.col("o_orderstatus"), F.lit("nan")).alias("maintainer"),
        F.col("o_orderkey").alias("ref"),
    )


@query(f"select *, round(({_ORDER_FILLED}) * 100.0e0 / 6, 4) as completeness from {_ORDER_CELLS}")
def row_completeness(t: Tables):
    scored = combine.with_completeness(order_cells(t))
    return scored.withColumn("completeness", F.round("completeness", 4))


@query(f"""select coalesce(crop, '') as crop, variety_release_name, seed_type, year_of_release,
    maintainer, ref from (select *, row_number() over (partition by crop, variety_release_name
        order by {_ORDER_FILLED} desc, ref) rn from {_ORDER_CELLS}) where rn = 1""")
def dedup_most_complete(t: Tables):
    return combine.sort_result(combine.dedup_most_complete(order_cells(t), order=["ref"]))


@query(f"""
with g as (select crop, variety_release_name v, count(*) n, sum({_ORDER_FILLED}) s,
                  max({_ORDER_FILLED}) m from {_ORDER_CELLS} group by all)
select cast(sum(n) as bigint) as original_count, count(*) as cleaned_count,
       cast(sum(n) - count(*) as bigint) as duplicates_removed,
       count(*) filter (n > 1 and crop is not null and v is not null) as duplicate_groups,
       round(sum(m) * 100.0e0 / (count(*) * 6) - sum(s) * 100.0e0 / (sum(n) * 6), 4)
         as completeness_improvement
from g""")
def dedup_stats(t: Tables):
    return combine.duplicate_stats(order_cells(t))


_SCORED_COMBINED = " + ".join(
    f"cast({sql.scored(c)} as integer)" for c in ("crop", "variety_release_name", "country", "yield_mt_ha")
)


@query(f"""select crop, variety_release_name, country, {sql.guard('yield_mt_ha')} as yield_mt_ha,
    source_file, source_index
  from (select *, row_number() over (partition by crop, country
            order by {_SCORED_COMBINED} desc, source_index, row_number) rn from {COMBINED_SQL})
  where rn = 1""")
def combine_and_deduplicate(t: Tables):
    return flows.combine_and_deduplicate(sources(t), keys="crop, country, unknown").records
