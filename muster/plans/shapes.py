"""Service-fleet shapes derived from the given tables, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster import fixed_values as fv
from muster.functions.common import spread
from muster.plans.registry import table

# SQL twins of the shared text helpers.
SQL_SPACE = fv.SPACE


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


# -- job listings ---------------------------------------------------------------------


def job_name() -> Column:
    kind = F.when(F.col("o_orderpriority") == "2-HIGH", "batch_").otherwise(fv.JOB_TOKEN)
    return F.concat(kind, F.col("o_custkey").cast("string"))


def job_node() -> Column:
    none = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return F.when(none, "").otherwise(F.concat(F.lit("node-"), F.left("o_orderpriority", F.lit(1))))


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text listing of all orders, with blank, short and long lines among them."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    short = F.concat_ws("|", key, job_name(), status)
    full = F.concat_ws("|", short, job_node())
    line = (
        F.when((status == "P") & (priority == "3-MEDIUM"), "   ")
        .when((status == "P") & (priority == "5-LOW"), short)
        .when((status == "F") & (priority == "1-URGENT"), F.concat(F.lit("  "), full, F.lit("|extra ")))
        .otherwise(full)
    )
    return table(spark, sf_dir, "orders").select(line.alias("value"))


SQL_JOB_COLUMNS = """
    cast(o_orderkey as varchar) as job_id,
    case when o_orderpriority = '2-HIGH' then 'batch_' else 'vllm_' end || cast(o_custkey as varchar) as name,
    o_orderstatus as state,
    case when o_orderpriority = '4-NOT SPECIFIED' then 'Unknown' else 'node-' || left(o_orderpriority, 1) end as node
"""

SQL_LISTED = f"""
listed as (
  select {SQL_JOB_COLUMNS}
  from orders
  where not (o_orderstatus = 'P' and o_orderpriority in ('3-MEDIUM', '5-LOW'))
)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as job rows."""
    node = F.coalesce(F.nullif(job_node(), F.lit("")), F.lit(fv.UNKNOWN))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        job_name().alias("name"),
        F.col("o_orderstatus").alias("state"),
        node.alias("node"),
    )


SQL_JOBS = f"jobs as (select {SQL_JOB_COLUMNS} from orders)"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as registered services; some have no job name, no stored job or no port."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("ord"),
        F.col("c_name").alias("server"),
        F.when(F.col("c_mktsegment") == "BUILDING", (key * 7).cast("string")).alias("job_id"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(fv.JOB_TOKEN), key.cast("string"))).alias("job_name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", 18000 + F.col("c_nationkey")).cast("int").alias("remote_port"),
    )


SQL_REGISTRY = """
registry as (
  select c_custkey as ord, c_name as server,
    case when c_mktsegment = 'BUILDING' then cast(c_custkey * 7 as varchar) end as job_id,
    case when c_acctbal >= 0 then 'vllm_' || cast(c_custkey as varchar) end as job_name,
    case when c_mktsegment <> 'MACHINERY' then 18000 + c_nationkey end as remote_port
  from customer
)
"""

# -- polls ----------------------------------------------------------------------------


def polls(events: DataFrame) -> DataFrame:
    """Events as health polls of the service ``user_id``."""
    kind, value = F.col("event_type"), F.col("value")
    node = F.when((kind == "purchase") & (value > 100), F.concat(F.lit("node-"), F.col("user_id").cast("string"), F.lit(",spare")))
    return events.select(
        "user_id",
        "ts",
        "event_id",
        kind.isin("view", "click", "purchase").alias("port_open"),
        ((kind == "click") & (value > 90)).alias("health"),
        ((kind == "purchase") & (value > 120)).alias("log_hit"),
        F.coalesce(node, F.when(kind == "error", fv.NO_NODE), F.lit("")).alias("nodes"),
    )


SQL_POLLS = """
polls as (
  select user_id, ts, event_id,
    event_type in ('view', 'click', 'purchase') as port_open,
    event_type = 'click' and value > 90 as health,
    event_type = 'purchase' and value > 120 as log_hit,
    case when event_type = 'purchase' and value > 100 then 'node-' || user_id || ',spare'
         when event_type = 'error' then 'NLIST' else '' end as nodes
  from events
)
"""

# -- phases ---------------------------------------------------------------------------


def edges(events: DataFrame) -> DataFrame:
    """Sign-ups and clicks start a phase, purchases and views stop it, an error is another edge; a phase is one day of one user."""
    kind = F.col("event_type")
    edge = F.when(kind.isin("signup", "click"), "start").when(kind.isin("purchase", "view"), "stop").otherwise("fail")
    return events.select(
        F.col("user_id").cast("string").alias("run"),
        F.date_format("ts", "yyyy-MM-dd").alias("phase"),
        edge.alias("edge"),
        "ts",
    )


SQL_SPANS = """
spans as (
  select cast(user_id as varchar) as run, strftime(ts, '%Y-%m-%d') as phase,
    min(ts) filter (where event_type in ('signup', 'click')) as started,
    max(ts) filter (where event_type in ('purchase', 'view')) as stopped
  from events
  group by all
),
timed as (
  select *, case when stopped >= started then (epoch_us(stopped) - epoch_us(started)) / 1000000.0 end as seconds
  from spans
)
"""

# -- state ----------------------------------------------------------------------------


def changes(events: DataFrame) -> DataFrame:
    """Purchases and errors stop the entry of the user's host, all other events start one."""
    op = F.when(F.col("event_type").isin("purchase", "error"), "stop").otherwise("start")
    return events.select(
        F.concat(F.lit("host"), F.col("user_id").cast("string"), F.lit(":8000")).alias("key"),
        op.alias("op"),
        F.col("event_id").alias("pid"),
        F.col("event_id").alias("seq"),
    )


SQL_CHANGES = """
changes as (
  select 'host' || user_id || ':8000' as key,
    case when event_type in ('purchase', 'error') then 'stop' else 'start' end as op, event_id as pid, event_id as seq
  from events
)
"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per customer, numbered like the users of the events table."""
    key = F.concat(F.lit("host"), F.col("c_custkey").cast("string"), F.lit(":8000"))
    return table(spark, sf_dir, "customer").select(key.alias("key"), F.col("c_custkey").alias("pid"))


SQL_STATE = "state as (select 'host' || c_custkey || ':8000' as key, c_custkey as pid from customer)"

# -- documents ------------------------------------------------------------------------


def service_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested configuration document per customer."""
    c = spread(table(spark, sf_dir, "customer"))
    server = F.struct(
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("host"),
        (8000 + F.col("c_nationkey")).alias("port"),
        F.col("c_mktsegment").alias("note.txt"),
    )
    ai = F.struct(
        F.struct(server.alias("main")).alias("server"),
        F.struct(F.struct(F.lit(3000).alias("port")).alias("web")).alias("client"),
        F.struct(F.lit("main").alias("server")).alias("default"),
        F.create_map().cast("map<string,string>").alias("limits"),
        F.array("c_mktsegment").alias("tags"),
    )
    user = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    return c.select("c_custkey", F.to_json(F.struct(F.struct(ai.alias("ai")).alias("fleet"), user.alias("user"))).alias("text"))


# -- records --------------------------------------------------------------------------


def text_map(**fields: Column) -> Column:
    """Map of the fields that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
