"""Queries over profiles, completeness, distributions, splits, loading and the run log."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import headers, profiling, split
from gristmill.plans import flows
from gristmill.queries import dialect as sql
from gristmill.queries.cleaning import GAPPY_CUSTOMER_SQL, gappy_customer
from gristmill.queries.registry import Tables, query
from gristmill.sources import catalogue

_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_FILLED = " + ".join(f"cast(not {sql.blank(c)} as integer)" for c in _COLUMNS)


@query(f"""select {sql.percent('f', 'n * 5')} as completion_rate, f as filled_fields,
    n * 5 as total_fields, n * 5 - f as empty_fields
  from (select cast(sum({_FILLED}) as bigint) f, count(*) n from {GAPPY_CUSTOMER_SQL})""")
def cell_quality(t: Tables):
    return profiling.cell_quality(gappy_customer(t))


_PROFILE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "clerk"]


def profiled_orders(t: Tables):
    clerk = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("K"), F.col("o_custkey") % 30))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                           clerk.alias("clerk"))


_CLERK = "case when o_orderkey % 5 <> 0 then 'K' || (o_custkey % 30) end"
_PROFILE = " union all ".join(
    f"""select '{c}' as "column", count(distinct {e}) as unique_values, count({e}) as non_null,
        count(*) as total_rows, {sql.percent(f'count({e})', 'count(*)')} as completeness,
        {i} as position from orders"""
    for i, (c, e) in enumerate((*[(c, c) for c in _PROFILE_COLUMNS[:4]], ("clerk", _CLERK)))
)


def _samples(n: int, distinct: bool) -> str:
    parts = []
    for c, e in (*[(c, c) for c in _PROFILE_COLUMNS[:4]], ("clerk", _CLERK)):
        rows = f"select cast({e} as varchar) v, o_orderkey k from orders where {e} is not null"
        if distinct:
            rows = f"select v, min(k) k from ({rows}) group by v"
        parts.append(f"""select '{c}' as "column", string_agg(v, '|' order by k, v) as sample_values
            from (select * from ({rows}) order by k, v limit {n})""")
    return " union all ".join(parts)


@query(f"""select p.*, sample_values from ({_PROFILE}) p join ({_samples(3, False)}) s
    on p."column" = s."column" """)
def column_profile(t: Tables):
    profile = profiling.column_profile(profiled_orders(t), order="o_orderkey")
    return profile.withColumn("sample_values", F.array_join("sample_values", "|"))


@query(f"""select p.*, sample_values from ({_PROFILE}) p join ({_samples(5, True)}) s
    on p."column" = s."column" where unique_values between 2 and 50""")
def split_suggestions(t: Tables):
    chosen = profiling.split_suggestions(profiled_orders(t), order="o_orderkey")
    return chosen.withColumn("sample_values", F.array_join("sample_values", "|"))


@query()
def approximate_profile(t: Tables):
    return profiling.approximate_profile(t.lineitem)


_STORED = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "note")


def _load(t: Tables, part: int):
    """A fourth of the line items, one of whose columns has gaps."""
    note = F.when(F.col("l_linenumber") > 2, F.col("l_linestatus"))
    return t.lineitem.where(F.col("l_orderkey") % 4 == part).withColumn("note", note).select(*_STORED)


@query(" union all ".join(f"""select '{c}' as "column", count({c}) as non_null, count(*) as total_rows,
    {sql.percent(f'count({c})', 'count(*)')} as completeness, true as within_error
  from (select *, case when l_linenumber > 2 then l_linestatus end as note from lineitem)""" for c in _STORED))
def stored_profile(t: Tables):
    """Four loads, each with a sketch of its own; the distinct counts are held against exact ones."""
    loads = [profiling.profile_sketches(_load(t, part), f"load {part}") for part in range(4)]
    merged = profiling.stored_profile(reduce(DataFrame.unionByName, loads))
    whole = reduce(DataFrame.unionByName, [_load(t, part) for part in range(4)])
    exact = profiling.column_profile(whole).select("column", F.col("unique_values").alias("exact"))
    off = F.abs(F.col("unique_values") - F.col("exact")) / F.greatest("exact", F.lit(1))
    return merged.join(exact, "column").select(
        "column", "non_null", "total_rows", "completeness", (off <= profiling.SKETCH_ERROR).alias("within_error"))


# --- dashboard ------------------------------------------------------------------------


def trait_catalogue(t: Tables):
    """Line items as catalogue entries with gaps and default NO values."""
    key = F.col("l_partkey")
    return t.lineitem.select(
        F.when(key % 3 != 0, F.concat(F.lit("P"), key)).alias("variety_release_name"),
        F.when(key % 10 < 4, F.col("l_returnflag")).when(key % 10 < 6, "").alias("crop"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("S"), F.col("l_suppkey") % 40)).alias("country"),
        F.when(F.col("l_quantity") > 5, F.year("l_shipdate").cast("string")).alias("year_of_release"),
        F.when(F.col("l_tax") > 0.04, "YES").otherwise("NO").alias("disease_tolerant"),
        F.when(F.col("l_discount") > 0.05, "YES").otherwise("NO").alias("drought_tolerant"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("seed_type"),
    )


_TRAIT_CATALOGUE = """(select
    case when l_partkey % 3 <> 0 then 'P' || l_partkey end as variety_release_name,
    case when l_partkey % 10 < 4 then l_returnflag when l_partkey % 10 < 6 then '' end as crop,
    case when l_suppkey % 4 <> 0 then 'S' || (l_suppkey % 40) end as country,
    case when l_quantity > 5 then cast(year(l_shipdate) as varchar) end as year_of_release,
    case when l_tax > 0.04e0 then 'YES' else 'NO' end as disease_tolerant,
    case when l_discount > 0.05e0 then 'YES' else 'NO' end as drought_tolerant,
    case when l_linenumber > 1 then l_linestatus end as seed_type from lineitem)"""
_FIELDS = ["variety_release_name", "crop", "country", "year_of_release", "seed_type",
           "disease_tolerant", "drought_tolerant"]
_COMPLETENESS = "(" + " union all ".join(
    f"""select '{f}' as field, {i} as position, count(*) filter ({f} is not null and {f} not in ('', 'NO'))
        as count, {sql.percent(f"count(*) filter ({f} is not null and {f} not in ('', 'NO'))", 'count(*)')}
        as percentage from {_TRAIT_CATALOGUE}""" for i, f in enumerate(_FIELDS)
) + ")"


@query(f"""select *, case when percentage >= 90 then 'good' when percentage >= 70 then 'mid'
    else 'low' end as grade from {_COMPLETENESS}""")
def field_completeness(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).completeness


@query(f"""select round(m, 1) as avg_completeness,
    case when m < 30 then 'critical' when m < 60 then 'warning' else 'success' end as level,
    case when m < 30 then 'Data completeness is critically low. Consider enriching your dataset.'
         when m < 60 then 'Data completeness can be improved. Focus on filling key fields.'
         else 'Good data quality! Continue maintaining your catalog.' end as message,
    case when round(m, 1) >= 70 then 'Excellent' when round(m, 1) >= 50 then 'Good'
         when round(m, 1) >= 30 then 'Fair' else 'Needs Work' end as health
  from (select avg(percentage) m from {_COMPLETENESS})""")
def overall_quality(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).overall


@query(f"""select *, case when percentage >= 90 then 'good' when percentage >= 70 then 'mid'
    else 'low' end as grade from (select * from {_COMPLETENESS} order by percentage, position limit 5)
  where percentage < 50""")
def lowest_fields(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).lowest


@query(f"""select 'info' as level, 'Low completeness in: ' ||
    string_agg(field, ', ' order by percentage, position) as message
  from (select * from (select * from {_COMPLETENESS} order by percentage, position limit 5)
        where percentage < 50 order by percentage, position limit 3) having count(*) > 0""")
def lowest_message(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).message


def _distribution(column: str, order: str) -> str:
    return f"""select value, count, {sql.percent('count', 'max(count) over ()')} as relative from (
        select {column} as value, count(*) as count from {_TRAIT_CATALOGUE}
        where {column} is not null and {column} <> '' group by 1 order by {order} limit 10)"""


@query(_distribution("country", "count desc, value"))
def distribution_top10(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).countries


@query(_distribution("year_of_release", "value desc"))
def distribution_latest(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).years


@query("select count(*) as total from lineitem")
def total_rows(t: Tables):
    return flows.quality_dashboard(trait_catalogue(t)).totals


# --- splits ---------------------------------------------------------------------------


def split_orders(t: Tables):
    priority = F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", priority.alias("priority"), status.alias("status"))


_SPLIT = """(select o_orderkey, case when o_custkey % 9 <> 0 then o_orderpriority end as priority,
    case when o_orderstatus <> 'P' then o_orderstatus end as status from orders)"""


@query(f"""select coalesce(priority, 'Unknown') as group_value, count(*) as record_count
    from {_SPLIT} group by 1 having count(*) >= 1500""")
def split_groups(t: Tables):
    return split.split_groups(split_orders(t), "priority", 1500)


@query(f"""select count(*) filter (n >= 1700) as total_groups, cast(sum(n) as bigint) as total_records
    from (select count(*) n from {_SPLIT} group by coalesce(priority, 'Unknown'))""")
def split_stats(t: Tables):
    return split.split_stats(split_orders(t), "priority", 1700)


@query(f"""select 'orders_' || g as group_name, n as record_count, n * 3 as total_cells,
    2 * n + s as filled_cells, {sql.percent('2 * n + s', 'n * 3')} as completeness,
    2 + cast(n = s as integer) as full_columns, 'priority' as split_column,
    'orders' as file_prefix
  from (select coalesce(priority, 'Unknown') g, count(*) n, count(status) s from {_SPLIT} group by 1)""")
def split_summary(t: Tables):
    return split.split_summary(split_orders(t), "priority", "orders")


@query(f"""select g as group_value, n as record_count, 'q_' || g as sheet_name,
    replace('q_' || g, ' ', '_') as file_name, false as renamed
  from (select coalesce(priority, 'Unknown') g, count(*) n from {_SPLIT} group by 1)""")
def split_manifest(t: Tables):
    return split.split_manifest(split_orders(t), "priority", "q")


@query(f"""select *, coalesce(priority, 'Unknown') as split_value from {_SPLIT}
    where coalesce(priority, 'Unknown') in (select coalesce(priority, 'Unknown') from {_SPLIT}
        group by 1 having count(*) >= 1700)""")
def split_rows(t: Tables):
    return split.splittable(split_orders(t), "priority", 1700)


# --- loading and the run log ----------------------------------------------------------

LOADED = datetime(2024, 1, 1)
_LOAD_MAPPING = {"name": "variety_release_name", "kind": "crop", "size": "yield_mt_ha"}


def upload(t: Tables):
    key = F.col("p_partkey")
    return t.part.select(
        F.when(key % 5 != 0, F.col("p_name")).alias("name"),
        F.when(key % 7 == 0, "").when(key % 4 != 0, F.col("p_type")).alias("kind"),
        F.when(key % 3 == 0, F.col("p_size").cast("double")).alias("size"),
        F.when(key % 2 == 0, F.col("p_brand")).alias("unmapped"),
    )


_UPLOAD = """(select case when p_partkey % 5 <> 0 then p_name end as name,
    case when p_partkey % 7 = 0 then '' when p_partkey % 4 <> 0 then p_type end as kind,
    case when p_partkey % 3 = 0 then cast(p_size as double) end as size from part)"""


@query(f"""select name as variety_release_name, kind as crop, cast(size as varchar) as yield_mt_ha,
    4.5e0 as data_quality_score, cast(null as timestamp) as last_verified,
    timestamp '2024-01-01' as created_at, timestamp '2024-01-01' as updated_at
  from {_UPLOAD} where coalesce(name, '') <> '' or coalesce(kind, '') <> ''""")
def master_load(t: Tables):
    return catalogue.catalogue_records(upload(t), _LOAD_MAPPING, loaded_at=LOADED)


@query(f"""select count(*) filter (coalesce(name, '') <> '' or coalesce(kind, '') <> '') as records_imported,
    count(*) filter (not (coalesce(name, '') <> '' or coalesce(kind, '') <> '')) as records_skipped
  from {_UPLOAD}""")
def load_stats(t: Tables):
    return catalogue.load_stats(upload(t), _LOAD_MAPPING)


def run_log(t: Tables):
    """The event stream read as a log of runs."""
    return t.events.select(
        F.concat(F.lit("file"), "event_id").alias("filename"),
        F.when(F.col("event_type") == "click", "master").otherwise("export").alias("file_type"),
        F.col("user_id").alias("record_count"),
        F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, F.col("value"))
        .alias("matching_accuracy"),
        F.col("ts").alias("uploaded_at"),
    )


_LOG = """(select 'file' || event_id as filename,
    case when event_type = 'click' then 'master' else 'export' end as file_type,
    user_id as record_count,
    case when event_id % 3 = 0 then 0e0 when event_id % 3 = 1 then value end as matching_accuracy,
    ts as uploaded_at from events)"""


@query(f"select * from {_LOG} where file_type = 'master' order by uploaded_at desc, filename limit 5")
def run_log_topn(t: Tables):
    return catalogue.recent_runs(run_log(t), 5, "master")


@query(f"""select round(avg(nullif(matching_accuracy, 0)), 4) as average_accuracy
    from (select * from {_LOG} order by uploaded_at desc, filename limit 10)""")
def run_log_accuracy(t: Tables):
    return catalogue.average_accuracy(run_log(t), 10)


_ACCURACY = "(case when event_id % 3 = 0 then 0e0 when event_id % 3 = 1 then value end)"


@query(f"""select 'file' || event_id as filename, {_ACCURACY} as matching_accuracy,
    case when {_ACCURACY} >= 90 then 'good' when {_ACCURACY} >= 75 then 'mid' else 'low' end as grade
  from events""")
def run_log_grades(t: Tables):
    """Every run with the grade of its accuracy."""
    log = run_log(t)
    return log.select("filename", "matching_accuracy", profiling.accuracy_grade(F.col("matching_accuracy")).alias("grade"))


@query("""select unnest(['variety_release_name', 'crop', 'country', 'year_of_release']) as "column",
    unnest(['name', 'kind', null, null]) as source, unnest([true, true, false, false]) as mapped,
    unnest([count(*) filter (p_partkey % 5 <> 0 and trim(p_name) <> ''),
            count(*) filter (p_partkey % 7 <> 0 and p_partkey % 4 <> 0), 0, 0]) as filled,
    unnest([count(*), count(*), count(*), count(*)]) as total_rows from part""")
def essentials_report(t: Tables):
    return headers.essentials_report(upload(t), _LOAD_MAPPING)
