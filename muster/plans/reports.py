"""Queries for grouped reports, ordered operators and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions.text import first_node
from muster.operators import aggregates, matching, ordered
from muster.plans import shapes
from muster.plans.joins import SQL_FIRST_MATCH
from muster.plans.registry import query, table
from muster.plans.scans import _section_lines
from muster.sources import logs, sections

_PATTERNS = ("license", "opyright notice", "@")


def document_lines(spark, sf_dir):
    return logs.text_to_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query(
    "a1_log_ready",
    """
    select doc_id, bool_or(regexp_matches(line, 'license|opyright notice|@')) as ready
    from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id
    """,
)
def a1(spark, sf_dir):
    return aggregates.log_ready(document_lines(spark, sf_dir), ["doc_id"], "line", _PATTERNS)


def _spans(spark, sf_dir):
    return aggregates.phase_durations(shapes.edges(table(spark, sf_dir, "events")), ["run", "phase"])


@query("a2_phase_durations", f"with {shapes.SQL_SPANS} select run, phase, started, stopped, seconds from timed")
def a2(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(
    "a2_phase_report",
    f"""
    with {shapes.SQL_SPANS}
    select phase, count(seconds) as closed, count(*) - count(seconds) as open, min(seconds) as min_seconds, max(seconds) as max_seconds,
      cast(sum(epoch_us(stopped) - epoch_us(started)) filter (where stopped >= started) as double) / 1000000.0 / nullif(count(seconds), 0) as avg_seconds,
      quantile_disc(seconds, 0.5) as p50_seconds, quantile_disc(seconds, 0.95) as p95_seconds
    from timed group by phase
    """,
)
def a2_report(spark, sf_dir):
    return aggregates.phase_report(_spans(spark, sf_dir))


@query(
    "a3_match_counts",
    f"""
    with {shapes.SQL_JOBS}, {shapes.SQL_REGISTRY}, {SQL_FIRST_MATCH}
    select state, count(*) as listed, count(*) filter (where server <> 'Unknown') as matched from matched group by state
    """,
)
def a3(spark, sf_dir):
    matched = matching.match_jobs(shapes.jobs(spark, sf_dir), shapes.registry(spark, sf_dir))
    return aggregates.match_counts(matched, ["state"], F.col("server") != "Unknown")


@query(
    "a4_concat_names",
    """
    select n_name, 0 as part, coalesce(string_agg(case when s_acctbal < 3000 then s_name end, ', ' order by s_name), 'None') as names
    from nation left join supplier on s_nationkey = n_nationkey group by n_name
    """,
)
def a4(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    names = s.join(n, n["n_nationkey"] == s["s_nationkey"]).select("n_name", F.when(F.col("s_acctbal") < 3000, F.col("s_name")).alias("name"))
    return aggregates.concat_names(n, names, ["n_name"], "name")


@query(
    "a5_check_summary",
    """
    with checks as (
      select user_id, strftime(ts, '%Y-%m-%d') as day, ts, event_id,
        case event_type when 'click' then 'health' when 'view' then 'models' when 'purchase' then 'query' end as checked,
        case when value > 60 then 'FAIL (' || event_id || ')' else 'OK' end as result
      from events
    )
    select user_id, day,
      coalesce(arg_max(result, event_id) filter (where checked = 'health'), 'Not tested') as health,
      coalesce(arg_max(result, event_id) filter (where checked = 'models'), 'Not tested') as models,
      coalesce(arg_max(result, event_id) filter (where checked = 'query'), 'Not tested') as query
    from checks group by all
    """,
)
def a5(spark, sf_dir):
    kind = F.col("event_type")
    checks = table(spark, sf_dir, "events").select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "ts",
        "event_id",
        F.when(kind == "click", "health").when(kind == "view", "models").when(kind == "purchase", "query").alias("checked"),
        F.when(F.col("value") > 60, F.concat(F.lit("FAIL ("), F.col("event_id").cast("string"), F.lit(")"))).otherwise("OK").alias("result"),
    )
    return aggregates.check_summary(checks, ["user_id", "day"], "checked", "result", ["ts", "event_id"])


def sql_outcome(hit: str, good: str, bad: str) -> str:
    return f"""
    numbered as (select *, row_number() over (partition by user_id order by ts, event_id) as n from polls),
    first_polls as (select *, {hit} as hit from numbered where n <= 60),
    seen as (
      select user_id, cast(min(n) filter (where hit) as integer) as poll, max(n) as polls,
        arg_min(ts, n) filter (where hit) as ts, arg_min(event_id, n) filter (where hit) as event_id,
        arg_min(split_part(nodes, ',', 1), n) filter (where hit) as node
      from first_polls group by user_id
    ),
    outcome as (
      select *, case when poll is not null then '{good}' when polls >= 60 then '{bad}' else 'pending' end as status from seen
    )
    """


SQL_READY = sql_outcome("port_open and (health or log_hit)", "ready", "failed")
SQL_ALLOCATED = sql_outcome("nodes not in ('', 'NLIST')", "allocated", "timeout")


@query(
    "a6_time_to_ready",
    f"with {shapes.SQL_POLLS}, {SQL_READY} select user_id, poll, ts, event_id, status from outcome",
)
def a6(spark, sf_dir):
    polls = shapes.polls(table(spark, sf_dir, "events"))
    return aggregates.time_to_ready(polls, ["user_id"], ["ts", "event_id"], aggregates.is_ready())


@query(
    "w1_tail_per_key",
    """
    select user_id, event_id, event_type from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10
    """,
)
def w1(spark, sf_dir):
    tail = ordered.tail_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 10)
    return tail.select("user_id", "event_id", "event_type")


@query(
    "w1_tail_of_logs",
    """
    with lines as (
      select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents
    )
    select doc_id, line_no, line from lines qualify row_number() over (partition by doc_id order by line_no desc) <= 5
    """,
)
def w1_logs(spark, sf_dir):
    return ordered.tail_per_key(document_lines(spark, sf_dir), ["doc_id"], ["line_no"], 5)


@query(
    "w1_long_tail",
    """
    select l_returnflag, l_orderkey, l_linenumber from lineitem
    qualify row_number() over (partition by l_returnflag order by l_orderkey desc, l_linenumber desc) <= 5000
    """,
)
def w1_long(spark, sf_dir):
    """Five thousand rows of each of three keys that hold all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return ordered.tail_per_key(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 5000)


@query(
    "w1_service_logs",
    """
    with services as (select c_custkey, case when c_mktsegment <> 'BUILDING' then 'user' || c_nationkey when c_acctbal < 0 then '' end as log_file from customer),
    lines as (
      select 'user' || user_id as log_file, event_id as line_no, event_type as line from events
      qualify row_number() over (partition by user_id order by event_id desc) <= 3
    )
    select c_custkey, line_no, line from services join lines using (log_file)
    union all
    select c_custkey, null, 'No log file configured.' from services where coalesce(log_file, '') = ''
    """,
)
def w1_services(spark, sf_dir):
    segment, log = F.col("c_mktsegment"), F.concat(F.lit("user"), F.col("c_nationkey").cast("string"))
    services = table(spark, sf_dir, "customer").select("c_custkey", F.when(segment != "BUILDING", log).when(F.col("c_acctbal") < 0, "").alias("log_file"))
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("log_file"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))
    return ordered.tail_of_logs(services, lines, ["c_custkey"], "log_file", ["line_no"], "line", 3)


@query(
    "w2_first_match",
    """
    select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority
    from orders where o_orderstatus = 'F' group by o_custkey
    """,
)
def w2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    first = ordered.first_match(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F")
    return first.drop("o_orderstatus")


@query(
    "w3_fill_section",
    """
    with lines as (
      select source as file, doc_id * 1000000 + generate_subscripts(string_split('Host ' || lang || chr(10) || '# ' || source || chr(10) || chr(10) || text, chr(10)), 1) as line_no,
        unnest(string_split('Host ' || lang || chr(10) || '# ' || source || chr(10) || chr(10) || text, chr(10))) as line
      from documents
    )
    select file, line_no, line, last_value(case when starts_with(line, 'Host ') then substr(line, 6) end ignore nulls)
      over (partition by file order by line_no) as section
    from lines
    """,
)
def w3(spark, sf_dir):
    lines = _section_lines(spark, sf_dir)
    return ordered.fill_section(lines, sections.section_header("line"), ["file"])


@query(
    "w4_sample_every",
    """
    select user_id, event_id, ts from events
    qualify (row_number() over (partition by user_id order by ts, event_id) - 1) % 10 = 0
    """,
)
def w4(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordered.sample_every(e, ["user_id"], ["ts", "event_id"])


@query(
    "w5_first_allocated",
    f"""
    with {shapes.SQL_POLLS}
    select user_id, arg_min(split_part(nodes, ',', 1), event_id) filter (where nodes not in ('', 'NLIST')) as node,
      min(ts) filter (where nodes not in ('', 'NLIST')) as ts, min(event_id) filter (where nodes not in ('', 'NLIST')) as event_id
    from polls group by user_id
    """,
)
def w5(spark, sf_dir):
    polls = shapes.polls(table(spark, sf_dir, "events"))
    return ordered.first_allocated(polls, ["user_id"], ["ts", "event_id"], first_node("nodes"))


@query(
    "w5_time_to_allocation",
    f"with {shapes.SQL_POLLS}, {SQL_ALLOCATED} select user_id, poll, ts, event_id, node, status from outcome",
)
def w5_outcome(spark, sf_dir):
    polls = shapes.polls(table(spark, sf_dir, "events"))
    return aggregates.time_to_allocation(polls, ["user_id"], ["ts", "event_id"], first_node("nodes"))


@query("l1_sorted_listing", "select distinct n_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey order by all")
def l1(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return ordered.sorted_listing(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_name", "c_mktsegment")


@query(
    "l2_first_item",
    "select c_custkey, c_name, c_mktsegment from customer order by c_acctbal desc, c_custkey limit 1",
)
def l2(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("ord", F.struct(-F.col("c_acctbal"), "c_custkey"))
    return ordered.first_item(c, "ord").select("c_custkey", "c_name", "c_mktsegment")
