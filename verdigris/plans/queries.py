"""Registered queries of the migration checks, with DuckDB SQL for each.

The migrated side is derived from the tables by the SQL below, which both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.values import approx_equal
from verdigris.operators import compare, inspect
from verdigris.plans.report import compare_tables
from verdigris.sources.tables import parquet_table

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DAMAGED_ORDERS = """
select o_orderkey, o_custkey,
       case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end as o_orderstatus,
       case when o_orderkey % 101 = 0 then cast(null as double) else o_totalprice end as o_totalprice,
       o_orderdate, o_orderpriority
from orders where o_orderkey % 89 <> 0
union all
select o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from orders where o_orderkey % 211 = 0
"""
DAMAGED_LINES = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when l_orderkey % 53 = 0 then l_quantity + 1 else l_quantity end as l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
from lineitem where l_orderkey % 83 <> 0
union all
select * from lineitem where l_orderkey % 307 = 0
"""


#: Lines whose tax has a third decimal place, which tells values apart that round alike.
FINE_LINES = "select l_orderkey, l_tax + l_linenumber * 0.001::double as l_tax, l_shipdate from lineitem"
#: Orders with a column retyped, one renamed, one more, and keys that occur twice.
RESHAPED_ORDERS = """
select o_orderkey, cast(o_custkey as varchar(20)) as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority as o_priority, o_orderkey % 7 as o_shard
from orders where o_orderkey % 89 <> 0
union all
select o_orderkey, cast(o_custkey as varchar(20)), o_orderstatus, o_totalprice + 0.001, o_orderdate, o_orderpriority, 0 from orders where o_orderkey % 101 = 0
"""


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    src = parquet_table(spark, folder, "orders")
    return src, spark.sql(DAMAGED_ORDERS.replace("from orders", "from {orders}"), orders=src)


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    src = parquet_table(spark, folder, "lineitem")
    return src, spark.sql(DAMAGED_LINES.replace("from lineitem", "from {lineitem}"), lineitem=src)


def c1_row_count(spark: SparkSession, folder: str) -> DataFrame:
    return compare.row_count(*_orders(spark, folder))


def c3_key_diff(spark: SparkSession, folder: str) -> DataFrame:
    return compare.key_diff(*_orders(spark, folder), ["o_orderkey"], ORDER_COLUMNS)


def c3_key_diff_rows(spark: SparkSession, folder: str) -> DataFrame:
    return compare.key_diff_rows(*_orders(spark, folder), ["o_orderkey"], ORDER_COLUMNS)


def c3_key_diff_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return compare.key_diff(*_lines(spark, folder), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_returnflag"])


def c4_column_diff(spark: SparkSession, folder: str) -> DataFrame:
    return compare.column_diff(*_orders(spark, folder), ["o_orderkey"], ORDER_COLUMNS)


def c5_bag_diff(spark: SparkSession, folder: str) -> DataFrame:
    return compare.bag_diff(*_lines(spark, folder))


def c6_profile(spark: SparkSession, folder: str) -> DataFrame:
    return inspect.profile(_orders(spark, folder)[1], ORDER_COLUMNS, 2)


def c6_profile_fine(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.sql(FINE_LINES.replace("0.001::double", "0.001D").replace("from lineitem", "from {lineitem}"), lineitem=parquet_table(spark, folder, "lineitem"))
    return inspect.profile(lines, ["l_orderkey", "l_tax", "l_shipdate"], 3)


def c7_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return inspect.orphans(parquet_table(spark, folder, "lineitem"), _orders(spark, folder)[1], "l_orderkey", "o_orderkey")


def c8_duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return inspect.duplicate_keys(parquet_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def c9_group_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return compare.group_reconcile(*_orders(spark, folder), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


def c9_group_overflow(spark: SparkSession, folder: str) -> DataFrame:
    huge = lambda df: df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.lit(1e40)).otherwise(F.col("o_totalprice")))
    return compare.group_reconcile(*map(huge, _orders(spark, folder)), ["o_orderpriority"], ["o_totalprice"])


def c10_domain(spark: SparkSession, folder: str) -> DataFrame:
    return compare.domain_diff(*_orders(spark, folder), "o_orderstatus")


def c11_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return compare.fingerprint(_orders(spark, folder)[1], ["o_orderkey"], ["o_orderkey", *ORDER_COLUMNS], 6)


def c11_table_checksum(spark: SparkSession, folder: str) -> DataFrame:
    return compare.table_checksum(_orders(spark, folder)[1], ["o_orderkey", *ORDER_COLUMNS], scale=6)


def c12_approx_equal(spark: SparkSession, folder: str) -> DataFrame:
    src, tgt = _lines(spark, folder)
    moved = F.when(F.col("l_partkey") % 7 == 0, F.col("l_tax") + 0.004).when(F.col("l_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_tax"))
    near = approx_equal(F.col("l_tax"), moved, 0.005)
    return tgt.groupBy(near.alias("within"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def c13_diff_sample(spark: SparkSession, folder: str) -> DataFrame:
    return compare.diff_sample(c3_key_diff_rows(spark, folder), ["o_orderkey"], 50)


def c14_cast_failures(spark: SparkSession, folder: str) -> DataFrame:
    events = parquet_table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("code"))
    return inspect.cast_failures(events, ["event_id"], "code", "bigint")


def c15_report(spark: SparkSession, folder: str) -> DataFrame:
    customers = parquet_table(spark, folder, "customer").where("c_custkey % 37 <> 0")
    return compare_tables("orders", *_orders(spark, folder), ["o_orderkey"], ORDER_COLUMNS, scale=2, totals=(["o_orderstatus"], ["o_totalprice"]), parents=[("o_custkey", customers, "c_custkey")])


def c2_schema_report(spark: SparkSession, folder: str) -> DataFrame:
    src = parquet_table(spark, folder, "orders")
    tgt = spark.sql(RESHAPED_ORDERS.replace("from orders", "from {orders}").replace("varchar(20)", "string").replace("0.001", "0.001D"), orders=src)
    return compare_tables("orders", src, tgt, ["o_orderkey"], ORDER_COLUMNS, scale=3)


QUERIES = {
    f.__name__: f
    for f in (
        c1_row_count, c2_schema_report, c3_key_diff, c3_key_diff_duplicates, c3_key_diff_rows, c4_column_diff, c5_bag_diff, c6_profile, c6_profile_fine, c7_orphans, c8_duplicate_keys,
        c9_group_reconcile, c9_group_overflow, c10_domain, c11_fingerprint, c11_table_checksum, c12_approx_equal, c13_diff_sample, c14_cast_failures, c15_report,
    )
}

_WITH = f"with tgt as ({DAMAGED_ORDERS}), "
_SIDES = (
    _WITH
    + """j as (
  select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey, s.o_orderkey is not null as a, t.o_orderkey is not null as b,
"""
    + ",\n".join(f"         s.{c} is distinct from t.{c} as d_{c}" for c in ORDER_COLUMNS)
    + """
  from orders s full outer join tgt t on s.o_orderkey = t.o_orderkey
), """
)
_CHANGED = "concat_ws(',', " + ", ".join(f"case when d_{c} then '{c}' end" for c in ORDER_COLUMNS) + ")"
_ROWS = (
    _SIDES
    + f"""r as (
  select o_orderkey, case when not b then 'missing' when not a then 'extra' when {_CHANGED} <> '' then 'changed' else 'match' end as status,
         case when a and b then {_CHANGED} else '' end as changed from j
)
"""
)


DECIMALS = {"o_custkey", "o_totalprice", "l_orderkey", "l_tax"}


def _text(column: str, places: int = 2) -> str:
    """DuckDB SQL of ``canonical`` for a column, also inside an aggregate."""
    if "o_totalprice" in column or "l_tax" in column:
        return f"cast(cast({column} as decimal(38,{places})) as varchar)"
    if "date" in column:
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"cast({column} as varchar)"


def _profile(table: str, columns: list[str] = ORDER_COLUMNS, places: int = 2) -> str:
    """DuckDB SQL of ``profile`` of a relation; distinct values are counted as they are."""
    return "\nunion all\n".join(
        f"""select '{c}' as "column", count(*) as n_rows, cast(count(*) - count({c}) as bigint) as n_null, count(distinct {c}) as n_distinct,
 {_text(f'min({c})', places)} as least, {_text(f'max({c})', places)} as most,
 {f'cast(sum(cast({c} as decimal(28,{places}))) as decimal(38,{places}))' if c in DECIMALS else f'cast(null as decimal(38,{places}))'} as total from {table}"""
        for c in columns
    )


_DIGEST = "md5(concat(" + ", ".join(f"case when {c} is null then 'N;' else 'V' || length({_text(c, 6)}) || ':' || {_text(c, 6)} || ';' end" for c in ["o_orderkey", *ORDER_COLUMNS]) + "))"
#: The columns of orders that ``RESHAPED_ORDERS`` keeps as they are.
_KEPT = ["o_orderstatus", "o_totalprice", "o_orderdate"]


def _column_diff(columns: list[str]) -> str:
    """DuckDB SQL of ``column_diff`` over a relation j."""
    return "\nunion all\n".join(f"""select '{c}' as "column", count(*) as n_compared, cast(count(*) filter (where d_{c}) as bigint) as n_changed from j where a and b""" for c in columns)


_COLUMN_DIFF = _column_diff(ORDER_COLUMNS)
_PROFILE_FINDINGS = "\nunion all\n".join(
    f"""select 'orders' as table_name, 'profile_{x}' as check_name, a."column" as column_name, cast(a.{x} as varchar) as source_value, cast(b.{x} as varchar) as target_value,
 case when a.{x} is not distinct from b.{x} then 'pass' else 'fail' end as status from pa a join pb b on a."column" = b."column" """
    for x in ("n_null", "n_distinct", "least", "most", "total")
)

ORACLE_SQL = {
    "c1_row_count": _WITH + "n as (select (select count(*) from orders) as n_source, (select count(*) from tgt) as n_target) select n_source, n_target, n_target - n_source as difference from n",
    "c3_key_diff": _ROWS + "select status, count(*) as n from r group by status",
    "c3_key_diff_rows": _ROWS + "select * from r where status <> 'match'",
    "c3_key_diff_duplicates": f"""with tgt as ({DAMAGED_LINES}),
u as (select l_orderkey, l_linenumber, l_quantity, l_returnflag, 1 as a, 0 as b from lineitem union all select l_orderkey, l_linenumber, l_quantity, l_returnflag, 0, 1 from tgt),
g as (select sum(a) as a, sum(b) as b, max(case when a = 1 then l_quantity end) as sq, max(case when b = 1 then l_quantity end) as tq, max(case when a = 1 then l_returnflag end) as sr, max(case when b = 1 then l_returnflag end) as tr
  from u group by l_orderkey, l_linenumber)
select case when a > 1 or b > 1 then 'duplicate' when b = 0 then 'missing' when a = 0 then 'extra' when sq is distinct from tq or sr is distinct from tr then 'changed' else 'match' end as status, count(*) as n from g group by 1""",
    "c4_column_diff": _SIDES.rstrip(", ") + _COLUMN_DIFF,
    "c5_bag_diff": f"""with tgt as ({DAMAGED_LINES}), u as (select *, 1 as surplus from lineitem union all select *, -1 from tgt)
select * exclude (surplus), cast(sum(surplus) as bigint) as surplus from u group by all having sum(surplus) <> 0""",
    "c6_profile": _WITH.rstrip(", ") + _profile("tgt"),
    "c6_profile_fine": f"with f as ({FINE_LINES}) " + _profile("f", ["l_orderkey", "l_tax", "l_shipdate"], 3),
    "c7_orphans": _WITH.rstrip(", ") + "select l_orderkey as key, count(*) as n from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from tgt) group by l_orderkey",
    "c8_duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "c9_group_reconcile": _WITH
    + """s as (select o_orderstatus, o_orderpriority, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as v from orders group by all),
t as (select o_orderstatus, o_orderpriority, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as v from tgt group by all)
select coalesce(s.o_orderstatus, t.o_orderstatus) as o_orderstatus, coalesce(s.o_orderpriority, t.o_orderpriority) as o_orderpriority,
       s.n as n_source, t.n as n_target, s.v as o_totalprice_source, t.v as o_totalprice_target, cast(0 as bigint) as o_totalprice_overflow, s.n is not distinct from t.n and s.v is not distinct from t.v as agrees
from s full outer join t on s.o_orderstatus is not distinct from t.o_orderstatus and s.o_orderpriority is not distinct from t.o_orderpriority""",
    "c9_group_overflow": _WITH
    + """s as (select o_orderpriority, count(*) as n, cast(sum(case when o_orderkey % 97 <> 0 then cast(o_totalprice as decimal(18,2)) end) as decimal(38,2)) as v, count(*) filter (where o_orderkey % 97 = 0) as lost from orders group by all),
t as (select o_orderpriority, count(*) as n, cast(sum(case when o_orderkey % 97 <> 0 then cast(o_totalprice as decimal(18,2)) end) as decimal(38,2)) as v, count(*) filter (where o_orderkey % 97 = 0) as lost from tgt group by all)
select s.o_orderpriority, s.n as n_source, t.n as n_target, s.v as o_totalprice_source, t.v as o_totalprice_target, cast(s.lost + t.lost as bigint) as o_totalprice_overflow,
       s.n = t.n and s.v is not distinct from t.v and s.lost + t.lost = 0 as agrees
from s join t on s.o_orderpriority = t.o_orderpriority""",
    "c10_domain": _WITH
    + "u as (select o_orderstatus as value, 1 as s from orders union all select o_orderstatus, 0 from tgt) select value, cast(sum(s) as bigint) as n_source, cast(sum(1 - s) as bigint) as n_target from u group by value",
    "c11_fingerprint": _WITH.rstrip(", ") + f"select o_orderkey, {_DIGEST} as fingerprint from tgt",
    "c11_table_checksum": _WITH
    + f"d as (select {_DIGEST} as digest from tgt) select cast(('0x' || substr(digest, 31, 2))::bigint % 64 as bigint) as bucket, count(*) as n, cast(sum(('0x' || substr(digest, 1, 12))::bigint) as decimal(38,0)) as checksum from d group by 1",
    "c12_approx_equal": f"""with tgt as ({DAMAGED_LINES}), m as (
  select l_tax as a, case when l_partkey % 7 = 0 then l_tax + 0.004::double when l_partkey % 11 = 0 then null else l_tax end as b, l_returnflag from tgt)
select a is not distinct from b or coalesce(abs(a - b) <= 0.005::double, false) as "within", l_returnflag, count(*) as n from m group by all""",
    "c13_diff_sample": _ROWS + "select * from r where status <> 'match' order by o_orderkey limit 50",
    "c14_cast_failures": "with e as (select event_id, case when event_id % 13 = 0 then 'n/a' else cast(user_id as varchar) end as code from events) select event_id, code as value from e where code is not null and try_cast(code as bigint) is null",
    "c15_report": _ROWS.rstrip()
    + f""", cd as ({_COLUMN_DIFF}), pa as ({_profile("orders")}), pb as ({_profile("tgt")}), n as (select (select count(*) from orders) as a, (select count(*) from tgt) as b),
gs as (select o_orderstatus as g, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as v from orders group by 1), gt as (select o_orderstatus as g, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as v from tgt group by 1),
gd as (select count(*) as n, count(*) filter (where gs.n is distinct from gt.n or gs.v is distinct from gt.v) as bad from gs full outer join gt on gs.g = gt.g),
o as (select count(distinct o_custkey) as k, count(*) as n from tgt where o_custkey % 37 = 0)
select 'orders' as table_name, 'row_count' as check_name, cast(null as varchar) as column_name, cast(a as varchar) as source_value, cast(b as varchar) as target_value, case when a = b then 'pass' else 'fail' end as status from n
union all select 'orders', 'key_diff', status, cast(count(*) as varchar), null, 'fail' from r where status <> 'match' group by status
union all select 'orders', 'duplicate_keys', null, '0', null, 'pass'
union all select 'orders', 'column_diff', "column", cast(n_compared as varchar), cast(n_changed as varchar), case when n_changed = 0 then 'pass' else 'fail' end from cd
union all select 'orders', 'group_totals', 'o_orderstatus', cast(n as varchar), cast(bad as varchar), case when bad = 0 then 'pass' else 'fail' end from gd
union all select 'orders', 'orphans', 'o_custkey', cast(k as varchar), cast(n as varchar), case when n = 0 then 'pass' else 'fail' end from o
union all {_PROFILE_FINDINGS}""",
    "c2_schema_report": f"""with tgt as ({RESHAPED_ORDERS}), twice as (select o_orderkey as k from tgt group by o_orderkey having count(*) > 1),
s as (select * from orders where o_orderkey not in (select k from twice)), t as (select * from tgt where o_orderkey not in (select k from twice)),
j as (select s.o_orderkey is not null as a, t.o_orderkey is not null as b, {", ".join(f"s.{c} is distinct from t.{c} as d_{c}" for c in _KEPT)} from s full outer join t on s.o_orderkey = t.o_orderkey),
cd as ({_column_diff(_KEPT)}), pa as ({_profile("orders", _KEPT, 3)}), pb as ({_profile("tgt", _KEPT, 3)}), n as (select (select count(*) from orders) as a, (select count(*) from tgt) as b)
select 'orders' as table_name, 'row_count' as check_name, cast(null as varchar) as column_name, cast(a as varchar) as source_value, cast(b as varchar) as target_value, case when a = b then 'pass' else 'fail' end as status from n
union all select 'orders', 'schema', c, a, b, 'fail' from (values ('o_custkey', 'bigint', 'string'), ('o_orderpriority', 'string', null), ('o_priority', null, 'string'), ('o_shard', null, 'bigint')) as v(c, a, b)
union all select 'orders', 'key_diff', 'missing', cast(count(*) as varchar), null, 'fail' from j where not b having count(*) > 0
union all select 'orders', 'key_diff', 'extra', cast(count(*) as varchar), null, 'fail' from j where not a having count(*) > 0
union all select 'orders', 'key_diff', 'changed', cast(count(*) as varchar), null, 'fail' from j where a and b and ({" or ".join(f"d_{c}" for c in _KEPT)}) having count(*) > 0
union all select 'orders', 'duplicate_keys', null, cast(count(*) as varchar), null, case when count(*) = 0 then 'pass' else 'fail' end from twice
union all select 'orders', 'column_diff', "column", cast(n_compared as varchar), cast(n_changed as varchar), case when n_changed = 0 then 'pass' else 'fail' end from cd
union all {_PROFILE_FINDINGS}""",
}
