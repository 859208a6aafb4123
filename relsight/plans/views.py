"""Graph views of the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages", "part", "conversations"]

EDGES = """
select concat('user/', cast(user_id as string)) as s, event_type as p, props as o from events
union all select concat('cust/', cast(o_custkey as string)), concat('ORDER_', o_orderstatus), concat('order/', cast(o_orderkey as string)) from orders
union all select concat('order/', cast(l_orderkey as string)), concat('RET_', l_returnflag, l_linestatus), concat('part/', cast(l_partkey as string)) from lineitem
union all select concat('cust/', cast(c_custkey as string)), 'LIVES_IN', concat('nation/', cast(c_nationkey as string)) from customer
union all select concat('supp/', cast(s_suppkey as string)), 'BASED_IN', concat('nation/', cast(s_nationkey as string)) from supplier
union all select concat('nation/', cast(n_nationkey as string)), 'PART_OF', concat('region/', cast(n_regionkey as string)) from nation"""

NODES = """
select concat('cust/', cast(c_custkey as string)) as node_id, c_mktsegment as category from customer
union all select concat('part/', cast(p_partkey as string)), p_brand from part
union all select concat('nation/', cast(n_nationkey as string)), 'nation' from nation
union all select concat('cust/', cast(c_custkey as string)), 'AAA' from customer where c_custkey % 7 = 0"""

LINES = """
select concat('<http://ex.org/user/', cast(user_id as string), '> <http', case when event_id % 3 = 0 then 's' else '' end, '://ex.org/', event_type, '> "', cast(event_id % 50 as string), '"^^<http://www.w3.org/2001/XMLSchema#integer> .') as value from events
union all select concat('<http://ex.org/doc/', cast(doc_id as string), '> <http://purl.org/dc/terms/source> "', source, '"@', upper(lang), ' .') from documents
union all select concat('_:d', cast(doc_id as string), ' <http://purl.org/dc/terms/language> "', lang, '" .') from documents
union all select concat('<http://ex.org/page/', cast(page_id as string), '> <http://schema.org/url> <http://ex.org/host/', cast(page_id % 17 as string), '> .') from pages
union all select concat('<http://ex.org/page/', cast(page_id as string), '> <https://schema.org/url> _:p', cast(page_id as string), ' .') from pages where page_id % 5 = 0
union all select concat('# page ', cast(page_id as string)) from pages
union all select concat('broken ', cast(page_id as string)) from pages where page_id % 3 = 0"""

BRC = """
select * from (
select 'same_region' as rel, a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey
union all select 'precedes', a.n_nationkey, b.n_nationkey from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey
union all select 'next_order', o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) from orders
union all select 'next_turn', conv_id * 1000 + turn, conv_id * 1000 + turn + 1 from conversations where turn > 0
union all select 'trades', n_nationkey, (n_nationkey * 7 + 3) % 25 from nation
union all select 'trades', n_nationkey, n_nationkey from nation where n_nationkey % 6 = 0
union all select 'mutual', n_nationkey, 24 - n_nationkey from nation where n_nationkey <> 12) all_edges where dst is not null"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view's rows. Tables are bound as arguments, so no temporary view of the caller is replaced."""
    used = {name for _, name in re.findall(rf"\b(from|join) ({'|'.join(TABLES)})\b", sql)}
    bound = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(bound, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used})
