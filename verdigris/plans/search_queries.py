"""Registered queries of the comparisons that search: digest trees, pairing, renamed columns, sketches, keys, times, streams, totals, JSON. With DuckDB SQL for each."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.session import shared_folder
from verdigris.operators import compare, digest_tree, discovery, pairing, sketches, temporal
from verdigris.operators.explain import explain_totals
from verdigris.operators.json_paths import json_diff
from verdigris.sources.tables import parquet_table
from verdigris.streaming.reconcile import catch_up, reconcile, stream_table

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
#: Orders with a few damaged rows, far apart: about ten at sf0.01.
FEW_DAMAGED = """
select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 1999 = 7 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate,
       case when o_orderkey % 2999 = 5 then cast(null as varchar(20)) else o_orderpriority end as o_orderpriority
from orders where o_orderkey % 4999 <> 11
union all
select o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 5999 = 13
"""
#: Lines with changed, deleted and doubled rows.
CHANGED_LINES = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_orderkey % 53 = 0 then l_quantity + 1 else l_quantity end as l_quantity,
       l_extendedprice, l_discount, l_tax, case when l_orderkey % 71 = 0 then null else l_returnflag end as l_returnflag, l_linestatus, l_shipdate
from lineitem where l_orderkey % 83 <> 0
union all
select * from lineitem where l_orderkey % 307 = 0
"""
#: Orders under other names and types, a part of them.
RENAMED_ORDERS = """
select o_orderkey, cast(o_custkey as integer) as customer, o_orderpriority as o_priority, o_orderstatus, o_totalprice, o_orderdate as placed, o_orderkey % 7 as o_shard
from orders where o_orderkey % 89 <> 0
"""
CUSTOMER_NATIONS = ["c_custkey", "c_nationkey", "n_name", "n_regionkey", "c_mktsegment", "c_acctbal"]
KEYED_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents"]
#: Foreign keys by the tables' definition: (dependent table, column, referenced table, column).
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]
#: Intervals of a customer: some empty, some open.
SPANS = """
select o_custkey, o_orderdate as valid_from, case when o_orderkey % 41 = 0 then cast(null as timestamp) when o_orderkey % 43 = 0 then o_orderdate
       else o_orderdate + cast(o_orderkey % 5 * 100 + 1 as integer) * interval '1' day end as valid_to
from orders
"""
#: Lines damaged in two slices.
SLICED_LINES = """
select l_orderkey, l_linenumber, l_returnflag, l_linestatus, case when l_returnflag = 'A' and l_linestatus = 'F' then l_quantity + 1 else l_quantity end as l_quantity
from lineitem where l_linenumber <> 3 or l_orderkey % 2 = 0
"""
#: Events whose properties were written anew.
REWRITTEN_EVENTS = """
select event_id, case when event_id % 31 = 0 then '{ "more": [1, {"x": null}], "k" : 5 }' when event_id % 37 = 0 then replace(replace(props, ': ', ': "'), '}', '"}')
       when event_id % 41 = 0 then '{"k": ' when event_id % 43 = 0 then cast(null as varchar(20)) else replace(props, ': ', ' :  ') end as props
from events where event_id % 47 <> 0
"""
#: Orders whose customers became text.
RETYPED_ORDERS = "select o_orderkey, cast(o_custkey as varchar(20)) as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 89 <> 0"


def _side(spark: SparkSession, folder: str, table: str, sql: str) -> tuple[DataFrame, DataFrame]:
    src = parquet_table(spark, folder, table)
    text = sql.replace("varchar(20)", "string").replace("{", "{{").replace("}", "}}").replace(f"from {table}", f"from {{{table}}}")
    return src, spark.sql(text, **{table: src})


def c3_key_diff_retyped(spark: SparkSession, folder: str) -> DataFrame:
    """A column that became text counts as changed in every row; nothing aborts."""
    src, tgt = _side(spark, folder, "orders", RETYPED_ORDERS)
    return compare.column_diff(src, tgt, ["o_orderkey"], ORDER_COLUMNS)


def c16_tree_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The differing keys of orders, found by descending into ranges whose digests differ."""
    return digest_tree.tree_diff_rows(*_side(spark, folder, "orders", FEW_DAMAGED), ["o_orderkey"], ORDER_COLUMNS)


def c16_range_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every node of the target's tree over 100 leaves; keys above them are in the last."""
    tgt = _side(spark, folder, "orders", FEW_DAMAGED)[1]
    grid = digest_tree.Grid(((0, 9999, 100),), 10)
    return digest_tree.tree(tgt, "o_orderkey", ORDER_COLUMNS, grid).select(F.col("level").cast("int").alias("level"), "node", "n")


def c17_paired_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Changed, missing and extra lines, without a key."""
    found = pairing.pair_changed(*_side(spark, folder, "lineitem", CHANGED_LINES))
    told = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("source", "target") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")]
    return found.select("status", F.col("n").cast("long").alias("n"), "changed", *told)


def c18_renamed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Renamed columns of orders, and whether the sketches share nine values in ten."""
    found = sketches.renamed_columns(*_side(spark, folder, "orders", RENAMED_ORDERS))
    return found.select("source_column", "target_column", "source_type", "target_type", (F.col("shared_values") > 0.9).alias("shared"))


def c19_sketch_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Sketch profiles of orders, merged from three parts: counts, how often the three most frequent values of columns that have few occur, and whether distinct counts and medians keep their bounds."""
    orders = _side(spark, folder, "orders", FEW_DAMAGED)[1]
    cols = ["o_orderkey", *ORDER_COLUMNS]
    parts = [sketches.sketches(orders.where(F.pmod("o_orderkey", F.lit(3)) == k), cols) for k in range(3)]
    rows = sketches.sketch_profile(sketches.merged(parts), [0.5], 3)
    exact = orders.agg(*(F.count_distinct(c).alias(c) for c in cols)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in cols))).alias("x")).select("x.*")
    few = ["o_orderstatus", "o_orderpriority"]
    top = F.when(F.col("column").isin(few), F.array_join(F.transform("top", lambda t: t["count"].cast("string")), ","))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.when(F.col("exact") <= 2**sketches.LOG_DISTINCT, 0).otherwise(sketches.DISTINCT_ERROR * F.col("exact"))
    median = rows.where(F.col("column") == "o_totalprice").select(F.get("quantiles", F.lit(0))).first()[0]
    below = orders.select(F.count(F.when(F.col("o_totalprice") < median, 1)) / F.count("o_totalprice")).first()[0]
    return rows.join(exact, "column").select("column", "n_rows", "n_null", top.alias("top"), near.alias("distinct_in_bound"), F.lit(abs(below - 0.5) <= sketches.RANK_ERROR).alias("median_in_bound"))


def c19_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Columns whose values moved between orders and its damaged copy, by their sketches alone."""
    src, tgt = _side(spark, folder, "orders", FEW_DAMAGED)
    moved = tgt.withColumn("o_totalprice", F.col("o_totalprice") + 100_000).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    found = sketches.drift(*(sketches.sketches(df, ORDER_COLUMNS) for df in (src, moved)))
    return found.select("column", "n_rows_source", "n_rows_target", (F.abs("null_gap") > 0.1).alias("nulls_moved"), (F.col("rank_gap") > 0.1).alias("ranks_moved"))


def c20_candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest sets of up to three columns that are keys of lineitem."""
    found = discovery.candidate_keys(parquet_table(spark, folder, "lineitem"), most=3)
    return spark.createDataFrame([(",".join(k), len(k)) for k in found], "columns string, size int")


def c20_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """What fixes what in customers joined with their nations."""
    customers, nations = (parquet_table(spark, folder, t) for t in ("customer", "nation"))
    joined = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(*CUSTOMER_NATIONS)
    return spark.createDataFrame([(",".join(x), a) for x, a in discovery.dependencies(joined, most=2)], "determinants string, dependent string")


def c21_foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys of ten tables, told by their values and names."""
    return discovery.foreign_keys({t: parquet_table(spark, folder, t) for t in KEYED_TABLES})


def c22_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the last order of its user up to then."""
    events, orders = parquet_table(spark, folder, "events"), parquet_table(spark, folder, "orders")
    events = events.select("event_id", "user_id", "ts")
    return temporal.as_of_join(events, orders, [("user_id", "o_custkey")], ("ts", "o_orderdate"), ["o_orderkey", "o_orderdate", "o_totalprice"], ["o_orderkey"])


def c22_interval_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps and overlaps of intervals that begin with a customer's orders and last some hundred days."""
    src, spans = _side(spark, folder, "orders", SPANS)
    return temporal.interval_faults(spans, ["o_custkey"], "valid_from", "valid_to")


def c23_stream_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Events written to two systems, reconciled as streams; told up to the last event less the delay, until when nothing may change."""
    path, events = f"{folder}/events.parque[t]", parquet_table(spark, folder, "events")  # a pattern may be one file or a folder
    source = stream_table(spark, path, events.schema).where("event_id % 17 <> 0")
    target = stream_table(spark, path, events.schema).where("event_id % 13 <> 0").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.col("value") + 1).otherwise(F.col("value")))
    place = shared_folder(spark, "reconcile")
    found = catch_up(reconcile(source, target, ["event_id"], ["user_id", "event_type", "value", "props"], "ts", "2 hours"), f"{place}/out", f"{place}/state")
    closed = events.select(F.max("ts") - F.expr("interval 2 hours 1 second")).first()[0]
    return found.where(F.col("ts") < F.lit(closed))


def c24_explain_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The slices of lineitem whose sums differ: one flag in one status, and one line number."""
    src, tgt = _side(spark, folder, "lineitem", SLICED_LINES)
    found = explain_totals(src, tgt, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")
    return found.select("slice", "n_dims", "n_source", "n_target", "total_source", "total_target")


def c25_json_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Differences by path in the properties of events, of which some were changed, retyped, extended or lost."""
    src, tgt = _side(spark, folder, "events", REWRITTEN_EVENTS)
    return json_diff(src, tgt, ["event_id"], "props")


QUERIES = {
    f.__name__: f
    for f in (
        c3_key_diff_retyped, c16_tree_diff, c16_range_counts, c17_paired_rows, c18_renamed_columns, c19_sketch_profile, c19_drift, c20_candidate_keys, c20_dependencies, c21_foreign_keys,
        c22_as_of, c22_interval_faults, c23_stream_reconcile, c24_explain_totals, c25_json_diff,
    )
}


_CHANGED = "concat_ws(',', " + ", ".join(f"case when d_{c} then '{c}' end" for c in ORDER_COLUMNS) + ")"
_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_APART = " + ".join(f"cast(a.{c} is distinct from b.{c} as integer)" for c in _LINES)
_TOLD = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


def _told(source: str | None, target: str | None) -> str:
    return ", ".join(f"{f'{alias}.{c}' if alias else f'(select {c} from lineitem limit 0)'} as {side}_{c}" for side, alias in (("source", source), ("target", target)) for c in _TOLD)


def _sets(columns: list[str], most: int) -> list[tuple[str, ...]]:
    return [s for k in range(1, most + 1) for s in combinations(columns, k)]


def _counted(columns: list[str], most: int, table: str) -> str:
    """SQL rows (s, n): how many distinct values each set of columns has."""
    return " union all ".join(f"select {list(s)} as s, (select count(*) from (select distinct {', '.join(s)} from {table})) as n" for s in _sets(columns, most))


ORACLE_SQL = {
    "c24_explain_totals": f"""with tgt as ({SLICED_LINES}), u as (
  select l_returnflag as f, l_linestatus as s, l_linenumber as n, l_quantity as q, 1 as side from lineitem union all select l_returnflag, l_linestatus, l_linenumber, l_quantity, 0 from tgt
), slices as (select 'l_returnflag=A,l_linestatus=F' as slice, 2 as n_dims, * from u where f = 'A' and s = 'F' union all select 'l_linenumber=3', 1, * from u where n = 3)
select slice, n_dims, count(*) filter (where side = 1) as n_source, count(*) filter (where side = 0) as n_target, cast(sum(cast(q as decimal(18,2))) filter (where side = 1) as decimal(38,2)) as total_source,
       cast(sum(cast(q as decimal(18,2))) filter (where side = 0) as decimal(38,2)) as total_target from slices group by slice, n_dims""",
    "c25_json_diff": f"""with tgt as ({REWRITTEN_EVENTS}), j as (select s.event_id, json_extract_string(s.props, '$.k') as k, t.event_id is null as gone from events s left join tgt t on s.event_id = t.event_id)
select event_id, '$.k' as path, 'missing' as status, 'number' as source_kind, k as source_value, cast(null as varchar) as target_kind, cast(null as varchar) as target_value from j
where gone or (event_id % 31 <> 0 and event_id % 37 <> 0 and (event_id % 41 = 0 or event_id % 43 = 0))
union all select event_id, '$.k', 'changed', 'number', k, 'number', '5' from j where not gone and event_id % 31 = 0 and k <> '5'
union all select event_id, '$.more[0]', 'extra', null, null, 'number', '1' from j where not gone and event_id % 31 = 0
union all select event_id, '$.more[1].x', 'extra', null, null, 'null', null from j where not gone and event_id % 31 = 0
union all select event_id, '$.k', 'retyped', 'number', k, 'string', k from j where not gone and event_id % 31 <> 0 and event_id % 37 = 0
union all select event_id, '$', 'extra', null, null, 'malformed', '{{"k": ' from j where not gone and event_id % 31 <> 0 and event_id % 37 <> 0 and event_id % 41 = 0""",
    "c22_as_of": """with o as (select * from orders qualify row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) = 1)
select event_id, user_id, ts, o_orderkey, o_orderdate, o_totalprice from events asof left join o on user_id = o_custkey and ts >= o_orderdate""",
    "c22_interval_faults": f"""with s as ({SPANS}), w as (
  select *, max(coalesce(valid_to, timestamp '9999-01-01')) over (partition by o_custkey order by valid_from, valid_to nulls last rows between unbounded preceding and 1 preceding) as before from s where valid_to is null or valid_to > valid_from
) select o_custkey, valid_from, valid_to, nullif(before, timestamp '9999-01-01') as previous_end, case when before > valid_from then 'overlap' else 'gap' end as fault from w where before <> valid_from
union all select o_custkey, valid_from, valid_to, null, 'empty' from s where valid_to <= valid_from""",
    "c23_stream_reconcile": """with s as (select * from events where event_id % 17 <> 0), t as (select * from events where event_id % 13 <> 0)
select coalesce(s.event_id, t.event_id) as event_id, coalesce(s.ts, t.ts) as ts, cast(s.event_id is not null as bigint) as n_source, cast(t.event_id is not null as bigint) as n_target,
       case when t.event_id is null then 'source_only' when s.event_id is null then 'target_only' else 'changed' end as status
from s full outer join t on s.event_id = t.event_id
where (s.event_id is null or t.event_id is null or s.event_id % 11 = 0) and coalesce(s.ts, t.ts) < (select max(ts) from events) - interval '2 hours 1 second'""",
    "c20_candidate_keys": f"""with d as ({_counted(_LINES, 3, "lineitem")}), k as (select s from d where n = (select count(*) from lineitem))
select array_to_string(s, ',') as columns, cast(len(s) as integer) as size from k where not exists (select 1 from k as x where len(x.s) < len(k.s) and list_has_all(k.s, x.s))""",
    "c20_dependencies": f"""with j as (select {", ".join(CUSTOMER_NATIONS)} from customer join nation on c_nationkey = n_nationkey), d as ({_counted(CUSTOMER_NATIONS, 3, "j")}),
f as (select x.s as x, a.c as a from d x, unnest({CUSTOMER_NATIONS}) as a(c), d y where len(x.s) <= 2 and not list_contains(x.s, a.c) and len(y.s) = len(x.s) + 1 and list_has_all(y.s, x.s) and list_contains(y.s, a.c) and y.n = x.n)
select array_to_string(x, ',') as determinants, a as dependent from f where not exists (select 1 from f as g where g.a = f.a and len(g.x) < len(f.x) and list_has_all(f.x, g.x))""",
    "c21_foreign_keys": " union all ".join(
        f"select '{t}.{c}' as dependent, '{u}.{k}' as referenced, count(distinct {c}) as n_values, cast(count(distinct {c}) filter (where {c} not in (select {k} from {u})) as bigint) as n_missing from {t}" for t, c, u, k in FOREIGN_KEYS
    ),
    "c3_key_diff_retyped": f"with tgt as ({RETYPED_ORDERS}) "
    + " union all ".join(f"""select '{c}' as "column", count(*) as n_compared, cast(count(*) filter (where {"true" if c == "o_custkey" else f"s.{c} is distinct from t.{c}"}) as bigint) as n_changed from orders s join tgt t on s.o_orderkey = t.o_orderkey""" for c in ORDER_COLUMNS),
    "c16_tree_diff": f"""with tgt as ({FEW_DAMAGED}), j as (
  select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey, s.o_orderkey is not null as a, t.o_orderkey is not null as b, {", ".join(f"s.{c} is distinct from t.{c} as d_{c}" for c in ORDER_COLUMNS)}
  from orders s full outer join tgt t on s.o_orderkey = t.o_orderkey
), r as (select o_orderkey, case when not b then 'missing' when not a then 'extra' when {_CHANGED} <> '' then 'changed' else 'match' end as status, case when a and b then {_CHANGED} else '' end as changed from j)
select * from r where status <> 'match'""",
    "c16_range_counts": f"""with tgt as ({FEW_DAMAGED}), leaves as (select least(o_orderkey, 9999) // 100 as leaf from tgt)
select cast(level as integer) as level, cast(leaf // cast(pow(10, level) as bigint) as bigint) as node, count(*) as n from leaves, unnest(range(3)) as u(level) group by all""",
    "c17_paired_rows": f"""with tgt as ({CHANGED_LINES}), u as (select *, 1 as s from lineitem union all select *, -1 from tgt),
bag as (select * exclude (s), cast(sum(s) as bigint) as s from u group by all having sum(s) <> 0), src as (select *, row_number() over () as id from bag where s > 0), dst as (select *, row_number() over () as id from bag where s < 0),
pairs as (select a.id as a, b.id as b from src a join dst b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey where {_APART} = 1)
select 'changed' as status, least(a.s, -b.s) as n, concat_ws(',', {", ".join(f"case when a.{c} is distinct from b.{c} then '{c}' end" for c in _LINES)}) as changed, {_told('a', 'b')} from pairs p join src a on p.a = a.id join dst b on p.b = b.id
union all select 'missing', s, '', {_told('a', None)} from src a where id not in (select a from pairs)
union all select 'extra', -s, '', {_told(None, 'b')} from dst b where id not in (select b from pairs)""",
    "c18_renamed_columns": f"""with tgt as ({RENAMED_ORDERS}), pairs(source_column, target_column, source_type, target_type, n_both, n_either) as (
  select 'o_custkey', 'customer', 'bigint', 'int', count(*) filter (where a and b), count(*) from (select v, bool_or(s) as a, bool_or(not s) as b from (select o_custkey as v, true as s from orders union all select customer, false from tgt) group by v)
  union all select 'o_orderpriority', 'o_priority', 'string', 'string', count(*) filter (where a and b), count(*) from (select v, bool_or(s) as a, bool_or(not s) as b from (select o_orderpriority as v, true as s from orders union all select o_priority, false from tgt) group by v)
  union all select 'o_orderdate', 'placed', 'timestamp_ntz', 'timestamp_ntz', count(*) filter (where a and b), count(*) from (select v, bool_or(s) as a, bool_or(not s) as b from (select o_orderdate as v, true as s from orders union all select placed, false from tgt) group by v)
) select source_column, target_column, source_type, target_type, n_both / n_either > 0.9 as shared from pairs""",
    "c19_sketch_profile": f"""with tgt as ({FEW_DAMAGED}), """
    + ", ".join(f"""t_{c} as (select string_agg(n, ',' order by n desc) as top from (select {c} as v, count(*) as n from tgt where {c} is not null group by {c} order by n desc limit 3))""" for c in ("o_orderstatus", "o_orderpriority"))
    + " "
    + " union all ".join(f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_null, {f"(select top from t_{c})" if c in ("o_orderstatus", "o_orderpriority") else "cast(null as varchar)"} as top, true as distinct_in_bound, true as median_in_bound from tgt""" for c in ["o_orderkey", *ORDER_COLUMNS]),
    "c19_drift": f"""with tgt as ({FEW_DAMAGED}), moved as (select o_custkey, o_orderstatus, o_totalprice + 100000 as o_totalprice, o_orderdate, case when o_orderkey % 2 = 0 then o_orderpriority end as o_orderpriority from tgt) """
    + " union all ".join(
        f"""select '{c}' as "column", (select count(*) from orders) as n_rows_source, (select count(*) from moved) as n_rows_target,
 abs((select avg(cast({c} is null as integer)) from orders) - (select avg(cast({c} is null as integer)) from moved)) > 0.1 as nulls_moved,
 {"cast(null as boolean)" if c in ("o_orderstatus", "o_orderpriority") else f"(with v as (select {c} as x, true as s from orders union all select {c}, false from moved), f as (select x, sum(count(*) filter (where s)) over (order by x) / sum(count(*) filter (where s)) over () as a, sum(count(*) filter (where not s)) over (order by x) / sum(count(*) filter (where not s)) over () as b from v group by x) select max(abs(a - b)) > 0.1 from f)"} as ranks_moved"""
        for c in ORDER_COLUMNS
    ),
}
