"""How named queries and their SQL are put together: common views, rounding, registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.bars import made_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BARS_DAILY = """bars as (select *, close * (1 - avg_disc / 200) as bid, close * (1 + avg_disc / 200) as ask from (
  select l_returnflag as instrument, l_shipdate as "timestamp", arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close,
    sum(l_quantity) as volume, sum(l_extendedprice) as dollar_volume, count(*) as deal_count,
    sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bid_size, sum(case when l_linestatus = 'F' then l_quantity else 0 end) as ask_size, avg(l_discount) as avg_disc
  from (select *, l_extendedprice / l_quantity as px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) as k from lineitem) group by 1, 2))"""
DEALS = """deals as (select event_type as instrument, ts as "timestamp", value as price, 1 + cast(json_extract(props, '$.k') as double) as size, event_id as sequence_id
  from events where value > 0)"""
BARS_15M = DEALS + """, bars as (select instrument, time_bucket(interval 15 minutes, "timestamp") as "timestamp", arg_min(price, k) as open, max(price) as high, min(price) as low,
  arg_max(price, k) as close, sum(size) as volume, sum(price * size) as dollar_volume, count(*) as deal_count
  from (select * exclude ("timestamp"), "timestamp", row("timestamp", sequence_id) as k from deals) group by 1, 2)"""


def rolled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null, minus zero as zero; times without zone. A tiny shift first, on both sides, takes values that lie
    just between two roundings (prices are cents over whole quantities) off the edge, where the last bit would decide."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(~F.isnan(c), c.cast("double")) + float(f"3.1e-{digits + 3}"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_of(body: str, doubles: str = "", views: str = BARS_DAILY, digits: int = 6) -> str:
    """SQL with common views, its double columns rounded as in rolled()."""
    replace = ", ".join(f'round(({c})::double + 3.1e-{digits + 3}, {digits}) + 0.0 as {c}' for c in doubles.split())
    star = f"* replace ({replace})" if replace else "*"
    head = f"with recursive {views}, q as ({body})" if views else f"with recursive q as ({body})"
    return f"{head} select {star} from q"


def query(key: str, sql: str | None = None, digits: int = 6):
    """Registers a function (spark, sf_dir) -> DataFrame under a key, with SQL where it can be expressed."""
    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with made_once():
                return rolled(fn(spark, sf_dir), digits)

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return fn

    return put


def over(n: int, extra: str = "") -> str:
    return f'over (partition by instrument order by "timestamp" rows between {n - 1} preceding and current row)'


def full(x: str, n: int, value: str) -> str:
    return f"case when count({x}) {over(n)} = {n} then {value} end"


ORDER = 'over (partition by instrument order by "timestamp")'


def z_sql(x: str, n: int, eps: str = "1e-12") -> str:
    return full(x, n, f"({x} - median({x}) {over(n)}) / (1.4826 * mad({x}) {over(n)} + {eps})")
