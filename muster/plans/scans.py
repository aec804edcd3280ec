"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions.common import spread
from muster.functions.text import first_listed_node
from muster.operators.leaves import flatten_leaves, leaf_name, parse_doc, scalar_text, set_path
from muster.plans import shapes
from muster.plans.registry import query, table
from muster.plans.shapes import sql_strip
from muster.session import shared_folder
from muster.sources import export, follow, keyed_state, layers, listings, logs, prompts, sections
from muster.streaming.runs import run_to_table


#: Objects around the innermost setting of a deep document.
_DEEP = 30


def _layer_rows(spark, sf_dir, as_yaml):
    """Leaves of every readable document, and one row with the name ``rejected`` for every other."""
    e = table(spark, sf_dir, "events")
    upper = F.col("event_type") == "view"
    deep = F.concat(F.lit('{"d":' * _DEEP), F.col("props"), F.lit("}" * _DEEP))
    text = (
        F.when(F.col("event_type") == "error", F.lit(" "))
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props")))
        .when(F.col("event_id") % 11 == 0, deep)
        .otherwise(F.col("props"))
    )
    if as_yaml:
        inner = F.regexp_replace("props", r'[{}"]', "")
        dated = F.concat(F.lit("top:\n  "), inner, F.lit("\n2024-01-02: .nan\n"))
        text = F.when(upper, F.when(F.col("event_id") % 7 == 0, F.lit("a: [")).otherwise(dated)).otherwise(text)
    docs = e.select("event_id", upper.cast("int").alias("layer"), text.alias("text"))
    parsed = layers.parse_documents(docs, "text", F.col("layer") == 1 if as_yaml else None)
    rows = flatten_leaves(layers.valid_documents(parsed, raising=False))
    bad = layers.rejected_documents(parsed).select("event_id", "layer", F.lit("rejected").alias("name"), F.lit(None).cast("string").alias("value"))
    return rows.select("event_id", "layer", leaf_name().alias("name"), scalar_text().alias("value")).unionByName(bad)


_SQL_LAYER_ROWS = f"""
    select event_id, cast(event_type = 'view' as integer) as layer,
      case when event_type = 'error' then '' when event_id % 7 = 0 then 'rejected'
        when event_id % 11 = 0 then repeat('d.', {_DEEP}) || 'k' else 'k' end as name,
      case when event_type = 'error' then '{{}}' when event_id % 7 = 0 then null else json_extract_string(props, '$.k') end as value
    from events"""


@query("s1_read_config_layers", _SQL_LAYER_ROWS)
def s1_layers(spark, sf_dir):
    return _layer_rows(spark, sf_dir, as_yaml=False)


@query(
    "s1_read_config_yaml",
    f"""
    {_SQL_LAYER_ROWS} where event_type <> 'view'
    union all
    select event_id, 1, case when event_id % 7 = 0 then 'rejected' else 'top.k' end,
      case when event_id % 7 <> 0 then json_extract_string(props, '$.k') end
    from events where event_type = 'view'
    union all
    select event_id, 1, '2024-01-02', 'nan' from events where event_type = 'view' and event_id % 7 <> 0
    """,
)
def s1_yaml(spark, sf_dir):
    return _layer_rows(spark, sf_dir, as_yaml=True)


@query("s2_read_job_listing_text", f"with {shapes.SQL_LISTED} select job_id, name, state, node from listed")
def s2(spark, sf_dir):
    folder = shared_folder(spark, "listing")
    shapes.listing_lines(spark, sf_dir).write.text(folder)
    read = listings.read_job_listing_text(spark, folder)
    return read.select("job_id", "name", "state", first_listed_node("nodes").alias("node"))


@query(
    "s3_read_job_listing_json",
    f"""
    with {shapes.SQL_JOBS}
    select job_id, name, state,
      case when split_part(o_orderpriority, '-', 1) = '3' then 'Unknown' else node end as node
    from jobs join orders on job_id = cast(o_orderkey as varchar)
    where o_orderpriority <> '5-LOW'
    """,
)
def s3(spark, sf_dir):
    name, node, p = shapes.job_name(), shapes.job_node(), F.col("o_orderpriority")
    base = [F.col("o_orderkey").cast("string").alias("job_id"), name.alias("name"), F.col("o_orderstatus").alias("state")]
    one = F.struct(*base, F.array(F.struct(node.alias("name"))).alias("nodes"))
    text = (
        F.when(p == "1-URGENT", F.to_json(F.array(one)))
        .when(p == "2-HIGH", F.to_json(F.struct(F.array(one).alias("jobs"))))
        .when(p == "3-MEDIUM", F.to_json(F.struct(*base)))
        .when(p == "4-NOT SPECIFIED", F.concat_ws("|", F.col("o_orderkey").cast("string"), name, F.col("o_orderstatus"), node))
        .otherwise(F.concat(F.lit('{"jobs":[{"job_id":'), F.col("o_orderkey").cast("string")))
    )
    folder = shared_folder(spark, "listing-json")
    table(spark, sf_dir, "orders").select(text.alias("value")).write.text(folder)
    read = listings.read_job_listing_json(spark, folder)
    return read.select("job_id", "name", "state", first_listed_node("nodes").alias("node"))


def _section_lines(spark, sf_dir):
    """Documents as section files: one file per source, one section per run of a language."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("Host "), F.col("lang"), F.lit("\n# "), F.col("source"), F.lit("\n\n"), F.col("text"))
    return logs.text_to_lines(d.select("source", "doc_id", text.alias("text")), ["source", "doc_id"], "text").select(
        F.col("source").alias("file"), (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no"), "line"
    )


SQL_SECTION_ENTRIES = f"""
lines as (
  select source as file, doc_id * 1000000 + pos as line_no, {sql_strip('line')} as line
  from (
    select source, doc_id, unnest(string_split('Host ' || lang || chr(10) || '# ' || source || chr(10) || chr(10) || text, chr(10))) as line,
      generate_subscripts(string_split('Host ' || lang || chr(10) || '# ' || source || chr(10) || chr(10) || text, chr(10)), 1) as pos
    from documents
  )
),
headed as (
  select *, nullif({sql_strip("regexp_extract(line, '(?i)^host[ \t\n\f\r\x0b]+(.+)$', 1)")}, '') as header from lines
),
filled as (
  select *, last_value(header ignore nulls) over (partition by file order by line_no) as section from headed
),
entries as (
  select file, lower(section) as section, lower(regexp_extract(line, '^([^=' || '{shapes.SQL_SPACE}' || ']*)[=' || '{shapes.SQL_SPACE}' || ']', 1)) as attr,
    {sql_strip("regexp_replace(line, '^[^=' || '" + shapes.SQL_SPACE + "' || ']*[=' || '" + shapes.SQL_SPACE + "' || ']+', '')")} as value,
    line_no
  from filled
  where line <> '' and not starts_with(line, '#') and header is null
    and regexp_matches(line, '[=' || '{shapes.SQL_SPACE}' || ']')
)
"""


@query(
    "s4_read_sections",
    f"with {SQL_SECTION_ENTRIES} select file, section, attr, arg_min(value, line_no) as value from entries group by all",
)
def s4(spark, sf_dir):
    return sections.first_entries(sections.section_entries(_section_lines(spark, sf_dir)))


@query(
    "s5_read_logs",
    """
    with lines as (
      select doc_id // 100 as log, doc_id, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) as pos
      from documents
    )
    select log, row_number() over (partition by log order by doc_id, pos) as line_no, line from lines
    """,
)
def s5(spark, sf_dir):
    """One log file per hundred documents, written and read back."""
    d = table(spark, sf_dir, "documents").withColumn("log", F.floor(F.col("doc_id") / 100))
    folder = shared_folder(spark, "logs")
    lines = logs.text_to_lines(d, ["log", "doc_id"], "text")
    ordered = lines.repartition("log").sortWithinPartitions("log", "doc_id", "line_no")
    ordered.select("log", F.col("line").alias("value")).write.partitionBy("log").text(folder, lineSep="\n")
    read = logs.read_logs(spark, folder, recursive=True)
    return read.select(F.regexp_extract("file", r"log=(\d+)", 1).cast("bigint").alias("log"), "line_no", "line")


@query(
    "s6_read_prompts",
    f"""
    select conv_id, turn,
      case role when 'user' then {sql_strip('text')} when 'assistant' then nullif(text, '') end as prompt,
      case when role = 'system' or (role = 'assistant' and text = '')
        then 'Please provide either a prompt text or a --file' end as error
    from conversations
    """,
)
def s6(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    given = c.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.col("text")).alias("file_text"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("inline"),
    )
    return prompts.choose_prompt(given, ["conv_id", "turn"], "file_text", "inline")


@query("s7_write_config", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def s7(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    folder = shared_folder(spark, "config")
    layers.write_config(c, folder)
    return spark.read.schema(c.schema).json(folder)


@query(
    "s7_write_documents",
    """
    select c_custkey, '{"fleet":{"ai":{"client":{"web":{"port":3000}},"default":{"server":"' || case when c_acctbal >= 0 then c_name else 'main' end
      || '"},"limits":{},"server":{"main":{"host":"nation' || c_nationkey || '","note.txt":"' || c_mktsegment || '","port":' || (8000 + c_nationkey)
      || '}},"tags":["' || c_mktsegment || '"]}}' || case when c_acctbal >= 0 then ',"user":"' || c_name || '"' else '' end || '}' as text
    from customer
    """,
)
def s7_documents(spark, sf_dir):
    """Documents flattened, changed, stored whole and read back."""
    folder = shared_folder(spark, "documents")
    layers.write_documents(_changed_documents(spark, sf_dir), ["c_custkey"], folder)
    read = layers.valid_documents(layers.read_documents(spark, folder, "c_custkey bigint"))
    return read.select("c_custkey", F.to_json("doc").alias("text"))


def _changed_documents(spark, sf_dir):
    tree = flatten_leaves(shapes.service_docs(spark, sf_dir).select("c_custkey", parse_doc("text").alias("doc")))
    c = spread(table(spark, sf_dir, "customer")).filter(F.col("c_acctbal") >= 0)
    at = F.array(*[F.lit(p) for p in ("fleet", "ai", "default", "server")])
    changes = c.select("c_custkey", at.alias("path"), F.concat(F.lit('"'), "c_name", F.lit('"')).alias("value"))
    return set_path(tree, changes, ["c_custkey"])


@query(
    "s8_state_table",
    """
    select 'host' || user_id || ':' || cast(json_extract_string(props, '$.k') as integer) as key, event_id as pid
    from events where event_type <> 'error'
    """,
)
def s8(spark, sf_dir):
    """State documents, some of them broken, stored as a table and read back."""
    key = F.concat(F.lit("host"), F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k"))
    good = F.concat(F.lit('{"'), key, F.lit('": '), F.col("event_id").cast("string"), F.lit("}"))
    text = F.when(F.col("event_type") == "error", F.left(good, F.lit(6))).otherwise(good)
    folder = shared_folder(spark, "state")
    docs = table(spark, sf_dir, "events").select(text.alias("value"))
    keyed_state.write_state(keyed_state.parse_state(docs), folder)
    return keyed_state.read_state(spark, folder)


@query(
    "s9_write_rendered",
    """
    select s_name as server, 'script' as kind, '#!/bin/bash' || chr(10) || 'run ' || s_name as value from supplier
    union all
    select s_name, 'config', 'nation: ' || s_nationkey from supplier where s_acctbal >= 0
    """,
)
def s9(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("server"),
        F.concat(F.lit("#!/bin/bash\nrun "), F.col("s_name")).alias("script"),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("nation: "), F.col("s_nationkey").cast("string"))).alias("config"),
    )
    folder = shared_folder(spark, "rendered")
    export.write_rendered(s, folder)
    return export.read_rendered(spark, folder)


@query(
    "s9_packed_export",
    """
    select c_name as server, 'script' as kind, '#!/bin/bash' || chr(10) || 'run ' || c_name as value from customer
    union all
    select c_name, 'config', 'nation: ' || c_nationkey from customer where c_acctbal >= 0
    """,
)
def s9_packed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("server"),
        F.concat(F.lit("#!/bin/bash\nrun "), F.col("c_name")).alias("script"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("nation: "), F.col("c_nationkey").cast("string"))).alias("config"),
    )
    folder = shared_folder(spark, "packed")
    export.write_packed(c, folder, buckets=16)
    return export.read_packed(spark, folder)


@query(
    "s10_follow_growing",
    """
    select doc_id % 7 as log, line, count(*) as seen
    from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by all
    """,
)
def s10_growing(spark, sf_dir):
    """Seven logs that grow between two runs of a stream: first the even documents, then all, each line once."""
    folder = shared_folder(spark, "growing")
    lines = logs.text_to_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    lines = lines.withColumns({"log": F.concat(F.lit("log-"), (F.col("doc_id") % 7).cast("string")), "late": F.col("doc_id") % 2})
    for written in (lines.filter("late = 0"), lines):
        logs.write_log_files(written, f"{folder}/logs", "log", ["late", "doc_id", "line_no"], "line")
        seen = run_to_table(follow.follow_files(spark, f"{folder}/logs"), folder)
    log = F.regexp_extract("file", r"log-(\d+)$", 1).cast("bigint")
    return seen.groupBy(log.alias("log"), "line").agg(F.count(F.lit(1)).alias("seen"))


@query(
    "s10_stream_lines",
    "select line, count(*) as seen from (select unnest(string_split(text, chr(10))) as line from documents) group by line",
)
def s10(spark, sf_dir):
    folder = shared_folder(spark, "follow")
    lines = logs.text_to_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    lines.select(F.col("line").alias("value")).write.text(f"{folder}/logs", lineSep="\n")
    seen = run_to_table(logs.stream_lines(spark, f"{folder}/logs").select("line"), folder)
    return seen.groupBy("line").agg(F.count(F.lit(1)).alias("seen"))
