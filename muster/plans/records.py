"""Queries for projections, filters, status rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import payloads, records, templates, text, urls
from muster.operators import leaves, predicates
from muster.plans import shapes
from muster.plans.registry import query, table
from muster.plans.shapes import sql_strip, text_map

# -- lookups in nested documents ------------------------------------------------------


@query(
    "p1_lookup_path",
    """
    select c_custkey, 'nation' || c_nationkey as host, c_mktsegment as note, 8000 + c_nationkey as port,
      case when c_acctbal >= 0 then c_name end as user, cast(null as varchar) as missing,
      cast(json_extract('{"k": ' || c_custkey || '}', '$.k') as bigint) as key
    from customer
    """,
)
def p1(spark, sf_dir):
    docs = shapes.service_docs(spark, sf_dir).withColumn("doc", leaves.parse_doc("text"))
    main = ["fleet", "ai", "server", "main"]
    number = leaves.parse_doc(F.concat(F.lit('{"k": '), F.col("c_custkey").cast("string"), F.lit("}")))
    return docs.select(
        "c_custkey",
        leaves.lookup_path("doc", "fleet.ai.server.main.host").alias("host"),
        leaves.lookup_path("doc", [*main, "note.txt"]).alias("note"),
        leaves.lookup_path("doc", [*main, "port"], "int").alias("port"),
        leaves.lookup_path("doc", "user").alias("user"),
        leaves.lookup_path("doc", "fleet.ai.server.other.port").alias("missing"),
        leaves.lookup_path(number, "k", "bigint").alias("key"),
    )


@query(
    "p1_lookup_event_props",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as other from events",
)
def p1_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", leaves.parse_doc("props"))
    return e.select("event_id", leaves.lookup_path("doc", "k", "bigint").alias("k"), leaves.lookup_path("doc", "other").alias("other"))


def _service_leaves(spark, sf_dir):
    docs = shapes.service_docs(spark, sf_dir).select("c_custkey", leaves.parse_doc("text").alias("doc"))
    return leaves.flatten_leaves(docs)


@query(
    "p2_smart_lookup",
    """
    select c_custkey, cast(8000 + c_nationkey as varchar) as port, '3000' as web_port, 'main' as chosen,
      case when c_acctbal >= 0 then c_name else 'nobody' end as user, '3000' as any_port,
      cast(null as varchar) as nothing
    from customer
    """,
)
def p2(spark, sf_dir):
    names = {
        "port": "main.port",
        "web_port": "client.web.port",
        "chosen": "fleet.ai.default.server",
        "user": "user",
        "any_port": "port",
        "nothing": "fleet.ai.nothing",
    }
    found = leaves.smart_lookup(
        _service_leaves(spark, sf_dir), ["c_custkey"], names, ["fleet.ai.server", "fleet.ai"], "fleet", {"user": "nobody"}
    )
    return found


@query(
    "p2_lookup_settings",
    """
    with asked as (
      select c_custkey, unnest(['main', 'main.port', 'limits', 'fleet.ai.default', 'web', 'user', 'tags']) as name,
        unnest(['{"host":"nation' || c_nationkey || '","note.txt":"' || c_mktsegment || '","port":' || (8000 + c_nationkey) || '}',
          cast(8000 + c_nationkey as varchar), '{}', '{"server":"main"}', '{"port":3000}',
          case when c_acctbal >= 0 then c_name end, '["' || c_mktsegment || '"]']) as value,
        unnest([true, false, true, true, true, false, false]) as is_section
      from customer
    )
    select * from asked where value is not null
    """,
)
def p2_settings(spark, sf_dir):
    """Settings and whole sections, for a table of names."""
    names = ["main", "main.port", "limits", "fleet.ai.default", "web", "user", "tags", "fleet.ai.nothing", "no.such"]
    asked = leaves.names_table(spark, names, "name")
    return leaves.lookup_settings(_service_leaves(spark, sf_dir), ["c_custkey"], asked, "name", ["fleet.ai.server", "fleet.ai"], "fleet")


@query(
    "f17_flatten_leaves",
    """
    select c_custkey, unnest(
      ['fleet.ai.server.main.host', 'fleet.ai.server.main.port', 'fleet.ai.server.main.note.txt', 'fleet.ai.client.web.port',
       'fleet.ai.default.server', 'fleet.ai.limits', 'fleet.ai.tags'] || case when c_acctbal >= 0 then ['user'] else [] end) as name,
      unnest(
      ['"nation' || c_nationkey || '"', cast(8000 + c_nationkey as varchar), '"' || c_mktsegment || '"', '3000',
       '"main"', '{}', '["' || c_mktsegment || '"]'] || case when c_acctbal >= 0 then ['"' || c_name || '"'] else [] end) as value
    from customer
    """,
)
def f17(spark, sf_dir):
    return _service_leaves(spark, sf_dir).select("c_custkey", leaves.leaf_name().alias("name"), "value")


@query(
    "f17_flatten_event_props",
    "select event_id, 'k' as name, json_extract_string(props, '$.k') as value from events",
)
def f17_events(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select("event_id", leaves.parse_doc("props").alias("doc"))
    return leaves.flatten_leaves(docs).select("event_id", leaves.leaf_name().alias("name"), "value")


@query(
    "p9_list_children",
    """
    select distinct 'server' as asked, n_name as child, cast(null as varchar) as value
    from customer join nation on n_nationkey = c_nationkey
    union all
    select distinct n_name, c_name, cast(null as varchar) from customer join nation on n_nationkey = c_nationkey
    union all
    select 'server.' || n_name, c_name || '.port', cast(8000 + c_custkey as varchar) from customer join nation on n_nationkey = c_nationkey
    union all
    select distinct 'version', cast(null as varchar), '2' from customer
    """,
)
def p9(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    at = F.array(F.lit("fleet"), F.lit("ai"), F.lit("server"), F.col("n_name"), F.col("c_name"), F.lit("port"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        at.alias("path"), (8000 + F.col("c_custkey")).cast("string").alias("value")
    )
    version = c.select(F.array(F.lit("fleet"), F.lit("ai"), F.lit("version")).alias("path"), F.lit("2").alias("value"))
    tree = rows.unionByName(version.distinct())
    asked = n.select(F.explode(F.array(F.lit("server"), F.lit("version"), "n_name", F.concat(F.lit("server."), "n_name"))).alias("asked"))
    return leaves.list_children_of(tree, [], asked, "asked", "fleet.ai", "server")


# -- projections, filters, validation ---------------------------------------------------


@query(
    "p3_project_with_defaults",
    """
    select c_name as name, coalesce(case when c_acctbal >= 0 then 'nation' || c_nationkey end, 'N/A') as host,
      c_mktsegment as model, 'N/A' as image, cast(c_nationkey as varchar) as tensor_parallel_size,
      cast(c_acctbal as varchar) as gpu_memory_utilization,
      coalesce(case when o_orderkey is not null then cast(o_orderkey as varchar) end, '8000') as port,
      coalesce(o_orderstatus, 'N/A') as account, coalesce(o_orderpriority, 'N/A') as partition,
      'N/A' as reservation, 'N/A' as gres, 'N/A' as cpus, 'N/A' as mem
    from customer left join orders on o_custkey = c_custkey
    """,
)
def p3(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nothing = F.lit(None).cast("string")
    joined = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    return predicates.service_table(
        joined.select(
            F.col("c_name").alias("name"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("host"),
            F.col("c_mktsegment").alias("model"),
            nothing.alias("image"),
            F.col("c_nationkey").alias("tensor_parallel_size"),
            F.col("c_acctbal").alias("gpu_memory_utilization"),
            F.col("o_orderkey").alias("port"),
            F.col("o_orderstatus").alias("account"),
            F.col("o_orderpriority").alias("partition"),
            *[nothing.alias(x) for x in ("reservation", "gres", "cpus", "mem")],
        )
    )


@query("p4_filter_name_contains", "select p_partkey, p_name from part where contains(p_name, 'ring')")
def p4(spark, sf_dir):
    return predicates.filter_name_contains(table(spark, sf_dir, "part"), "p_name", "ring").select("p_partkey", "p_name")


@query(
    "p5_filter_members",
    """
    select c_custkey, 'NATION_' || c_nationkey as name from customer
    where 'NATION_' || c_nationkey in (select n_name from nation join region on r_regionkey = n_regionkey where r_name <> 'ASIA')
      or 'NATION_' || c_nationkey in ('NATION_2', 'NATION_99')
    """,
)
def p5(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    names = c.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"))
    known = n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter(F.col("r_name") != "ASIA")
    return predicates.filter_members(names, "name", known, "n_name", ("NATION_2", "NATION_99")).select("c_custkey", "name")


def _partial_record():
    """Record with fields that are absent, and fields that are there but empty."""
    return text_map(
        account=F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")),
        partition=F.when(F.col("c_nationkey") < 20, F.when(F.col("c_nationkey") < 5, "").otherwise("gpu")),
        image=F.when(F.col("c_mktsegment") != "BUILDING", F.lit("img")),
        model=F.lit("m"),
    )


@query(
    "p6_missing_fields",
    """
    select c_custkey,
      concat_ws(',', case when c_acctbal < 0 then 'account' end, case when c_nationkey >= 20 then 'partition' end,
        case when c_mktsegment = 'BUILDING' then 'image' end) as absent,
      concat_ws(',', case when c_acctbal < 0 then 'account' end,
        case when c_nationkey >= 20 or c_nationkey < 5 then 'partition' end,
        case when c_mktsegment = 'BUILDING' then 'image' end) as unset
    from customer
    """,
)
def p6(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("record", _partial_record())
    return c.select(
        "c_custkey",
        F.array_join(predicates.absent_fields("record", fv.REQUIRED_UVA), ",").alias("absent"),
        F.array_join(predicates.unset_fields("record", fv.REQUIRED_UVA), ",").alias("unset"),
    )


@query(
    "p7_validate_range",
    """
    select l_orderkey, l_linenumber, l_partkey * 40 - 40 as port,
      case when l_partkey * 40 - 40 between 0 and 65535 then 'accepted' else 'rejected' end as outcome
    from lineitem
    """,
)
def p7(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 40 - 40).alias("port"))
    good, bad = predicates.split_range(li, "port")
    return good.withColumn("outcome", F.lit("accepted")).unionByName(bad.withColumn("outcome", F.lit("rejected")))


_SQL_HOST = "replace(replace(replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'blog', 'UVA-login'), 'www', 'Rivanna'), 'example.org', 'DGX1')"


def _host():
    host = urls.url_host("url")
    for a, b in (("blog", "UVA-login"), ("www", "Rivanna"), ("example.org", "DGX1")):
        host = F.replace(host, F.lit(a), F.lit(b))
    return host


@query(
    "p8_route",
    f"""
    with hosts as (select page_id, {_SQL_HOST} as host from pages)
    select page_id, host,
      case when contains(lower(host), 'uva') or contains(lower(host), 'rivanna') then 'UVA' else 'DGX' end as route,
      case when contains(lower(host), 'uva') then 'uva' when contains(lower(host), 'dgx') then 'dgx' else 'default' end as platform
    from hosts
    """,
)
def p8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", _host().alias("host"))
    return pages.select("page_id", "host", predicates.route("host").alias("route"), predicates.platform("host").alias("platform"))


_SQL_PROBE = """
probes as (
  select event_id, user_id, ts,
    case event_type when 'error' then null when 'view' then 503 else 200 end as health,
    case event_type when 'click' then 200 when 'signup' then 404 when 'view' then 200 end as models,
    case when value > 100 then false when value > 5 then true end as running
  from events
)
"""


def _probes(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", None).when(kind == "view", 503).otherwise(200).cast("int").alias("health"),
        F.when(kind.isin("click", "view"), 200).when(kind == "signup", 404).cast("int").alias("models"),
        F.when(F.col("value") > 100, False).when(F.col("value") > 5, True).alias("running"),
    )


@query(
    "p10_probe_status",
    f"""
    with {_SQL_PROBE}
    select event_id, case when health is null then 'OFFLINE' when health <> 200 then 'STARTING' when models is null then 'OFFLINE'
      when models <> 200 then 'STARTING' else 'READY' end as status from probes
    """,
)
def p10(spark, sf_dir):
    return _probes(spark, sf_dir).select("event_id", predicates.probe_status("health", "models").alias("status"))


@query(
    "p11_server_status",
    f"""
    with {_SQL_PROBE}
    select event_id, case when coalesce(running, false) = false then 'Stopped' when health = 200 then 'Running'
      else 'Starting/Unhealthy' end as status from probes
    """,
)
def p11(spark, sf_dir):
    return _probes(spark, sf_dir).select("event_id", predicates.server_status("running", "health").alias("status"))


@query(
    "p12_first_node",
    """
    select page_id,
      case when contains(url, 'example.org') then null when contains(url, 'www') then null
        else regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) end as node,
      case when contains(url, 'example.net') then 'Unknown' else regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) end as listed
    from pages
    """,
)
def p12(spark, sf_dir):
    url, host = F.col("url"), urls.url_host("url")
    nodes = (
        F.when(url.contains("example.org"), F.lit(f" {fv.NO_NODE} "))
        .when(url.contains("www"), F.lit("  "))
        .otherwise(F.concat(F.lit(" "), host, F.lit(","), host, F.lit("-2\n")))
    )
    listed = F.when(~url.contains("example.net"), F.array(F.struct(host.alias("name")), F.struct(F.lit("z").alias("name"))))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.first_node(nodes).alias("node"), text.first_listed_node(listed).alias("listed")
    )


@query(
    "p13_default_record",
    """
    with hosts as (
      select s_suppkey, case when s_nationkey < 8 then 'login.UVA' || s_nationkey when s_nationkey < 16 then 'dgx' || s_nationkey
        else 'box' || s_nationkey end as host from supplier
    ), kinds as (
      select *, case when contains(lower(host), 'uva') then 'uva' when contains(lower(host), 'dgx') then 'dgx' else 'default' end as platform from hosts
    )
    select s_suppkey, 'gemma-' || host as name, platform, host, '{~/.ssh/config:' || host || '.user}' as user,
      case platform when 'uva' then '/scratch' when 'dgx' then '/raid' else '/home' end || '/{user}/fleet/{port}' as dir,
      case platform when 'uva' then 18123 else 8000 end as local_port,
      case platform when 'uva' then 18123 else 8000 end as remote_port,
      'google/gemma-4-31B-it' as model
    from kinds
    """,
)
def p13(spark, sf_dir):
    n = F.col("s_nationkey")
    label = F.when(n < 8, "login.UVA").when(n < 16, "dgx").otherwise("box")
    s = table(spark, sf_dir, "supplier").withColumn("host", F.concat(label, n.cast("string")))
    return s.select("s_suppkey", predicates.default_record("host", "gemma", "fleet").alias("r")).select("s_suppkey", "r.*")


@query(
    "p14_describe_record",
    """
    select c_custkey, unnest(range(4)) as pos,
      unnest(['name: ' || c_name, 'nation: ' || c_nationkey, 'segment: ' || c_mktsegment,
        'balance: ' || coalesce(cast(case when c_acctbal >= 0 then c_acctbal end as varchar), 'None')]) as line
    from customer
    """,
)
def p14(spark, sf_dir):
    record = F.create_map(
        F.lit("name"), F.col("c_name"),
        F.lit("nation"), F.col("c_nationkey").cast("string"),
        F.lit("segment"), F.col("c_mktsegment"),
        F.lit("balance"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")),
    )
    lines = predicates.describe_record(table(spark, sf_dir, "customer"), ["c_custkey"], record)
    return lines.withColumn("pos", F.col("pos").cast("bigint"))


# -- templates ------------------------------------------------------------------------

_SCRIPT = "cd {dir}\nrun {model} --gpus {gpu} --port {port} ${port} {nothing}\n"


@query(
    "f1_render_once",
    r"""
    with r as (
      select c_custkey, c_name, '/scratch/' || c_nationkey as dir, c_mktsegment as model, cast(8000 + c_nationkey as varchar) as port,
        coalesce(case when c_nationkey > 12 then cast(c_nationkey as varchar) end, case when c_acctbal >= 0 then '4' end, '1') as gpu,
        case when c_mktsegment = 'BUILDING' then '/bin/zsh' else '/bin/bash' end as shell,
        case when c_mktsegment <> 'MACHINERY' then c_name end as image
      from customer
    )
    select c_custkey, case when port = '8005' then 'Configuration at ''server.' || c_name || ''' must contain a ''script'' field.' end as error,
      case when port <> '8005' then '#!' || shell || chr(10) || '# vLLM Launch Script for server.' || c_name || chr(10) || chr(10) || 'export PORT=8000' || chr(10) ||
      'export VLLM_IMAGE="' || coalesce(image, 'vllm/vllm-openai') || '"' || chr(10) || chr(10) ||
      'cd ' || dir || chr(10) || 'run ' || model || ' --gpus ' || gpu || ' --port ' || port || ' $' || port || ' {nothing}' || chr(10) end as script,
      '/home/' || c_name || '/job_' || port as path
    from r
    """,
)
def f1(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    port = (8000 + n).cast("string")
    record = text_map(
        script=F.when(n != 5, F.lit(_SCRIPT)),
        dir=F.concat(F.lit("/scratch/"), n.cast("string")),
        model=F.col("c_mktsegment"),
        port=port,
        tensor_parallel_size=F.when(n > 12, n),
        gpus=F.when(F.col("c_acctbal") >= 0, F.lit("4")),
        shell=F.when(F.col("c_mktsegment") == "BUILDING", F.lit("/bin/zsh")),
        image=F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name")),
    )
    place = F.concat(F.lit("server."), F.col("c_name"))
    return c.withColumn("record", record).select(
        "c_custkey",
        templates.launch_script("record", place).alias("script"),
        templates.launch_error("record", place).alias("error"),
        templates.fill_path(F.lit(""), F.lit("/home/{user}/job_{port}"), "c_name", port).alias("path"),
    )


_COMMAND = "mkdir {dir} && run {name} --cache {cache} -e T=${user} as {user} {unknown} {loop}"


@query(
    "f2_render_fixpoint",
    """
    with r as (
      select c_custkey, case when c_acctbal >= 0 then c_name else 'shared' end as u, 'vllm_' || c_mktsegment || '_' || (8000 + c_nationkey) as nm
      from customer
    )
    select c_custkey, 'mkdir /scratch/' || u || '/fleet/' || nm || ' && run ' || nm || ' --cache /scratch/' || u || '/fleet/' || nm ||
      '/cache/${name} -e T=${user} as ' || u || ' {unknown} ' || case when c_custkey > 100 then '{loop}' else 'x' end as command,
      c_custkey <= 100 as converged
    from r
    """,
)
def f2(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = text_map(
        name=F.lit("vllm_{segment}_{remote_port}"),
        segment=F.col("c_mktsegment"),
        remote_port=8000 + F.col("c_nationkey"),
        dir=F.lit("/scratch/{user}/fleet/{name}"),
        cache=F.lit("{dir}/cache/${name}"),
        user=F.when(F.col("c_acctbal") >= 0, F.col("c_name")),
        loop=F.when(F.col("c_custkey") > 100, F.lit("{loop}")).otherwise("x"),
    )
    shared = F.create_map(F.lit("user"), F.lit("shared"))
    closed = c.select("c_custkey", records.overlay(shared, own).alias("b")).select(
        "c_custkey", "b", templates.resolve_bindings("b").alias("closed")
    )
    done = closed.select("c_custkey", "b", templates.render_resolved(F.lit(_COMMAND), "closed").alias("command"))
    return done.select("c_custkey", "command", templates.is_converged("command", "b").alias("converged"))


@query(
    "f3_expand_user",
    """
    select s_suppkey, case when s_acctbal >= 0 then replace(t, '$USER', s_name) else t end as expanded,
      replace('/h/' || s_name || '/x/$HOME/y', '$HOME', '/h/' || s_name) as home
    from (select *, '/scratch/$USER/job_$USER_' || s_nationkey as t from supplier)
    """,
)
def f3(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/scratch/$USER/job_$USER_"), F.col("s_nationkey").cast("string"))
    user = F.when(F.col("s_acctbal") >= 0, F.col("s_name")).otherwise("")
    home = F.concat(F.lit("/h/"), F.col("s_name"))
    return s.select(
        "s_suppkey",
        text.expand_user(path, user).alias("expanded"),
        text.expand_home(F.lit("~/x/$HOME/y"), home).alias("home"),
    )


@query(
    "f4_override_port_flag",
    r"""
    select p_partkey, case when p_size = 1 then t else regexp_replace(t, '--port\s+\d+', '--port ' || (9000 + p_size), 'g') end as command
    from (select *, 'run ' || p_name || ' --port 80' || chr(10) || '--port  ' || p_partkey || ' --portal 3' as t from part)
    """,
)
def f4(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    command = F.concat(F.lit("run "), F.col("p_name"), F.lit(" --port 80\n--port  "), F.col("p_partkey").cast("string"), F.lit(" --portal 3"))
    port = F.when(F.col("p_size") > 1, 9000 + F.col("p_size"))
    return p.select("p_partkey", text.override_port_flag(command, port).alias("command"))


@query(
    "f5_override_name_suffix",
    r"""
    select c_custkey, case when c_nationkey = 0 then n else regexp_replace(n, '_\d+$', '_' || c_nationkey) end as name
    from (select *, case when c_acctbal >= 0 then 'vllm_7_' || c_custkey else c_name end as n from customer)
    """,
)
def f5(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("vllm_7_"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", text.override_name_suffix(name, "c_nationkey").alias("name"))


@query(
    "f6_normalise_shebang",
    r"""
    select doc_id, case when lang = 'en' then '#!/bin/bash' || chr(10) || text
      when lang = 'fr' then '#!/bin/bash -e' || chr(10) || text
      else '#!/bin/bash' || chr(10) || text end as script
    from documents
    """,
)
def f6(spark, sf_dir):
    first = F.when(F.col("lang") == "fr", "#!/bin/bash -e\n").when(F.col("lang") == "de", "#!/usr/bin/env zsh\n").otherwise("")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalise_shebang(F.concat(first, F.col("text"))).alias("script"))


@query(
    "f7_extract_job_id",
    """
    select o_orderkey, case when o_orderstatus = 'P' then null else cast(o_orderkey as varchar) end as job_id from orders
    """,
)
def f7(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    answer = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("sbatch: error "), key)).otherwise(
        F.concat(F.lit("note\nSubmitted batch job "), key, F.lit(" on cluster 1\n"))
    )
    return o.select("o_orderkey", text.extract_job_id(answer).alias("job_id"))


# -- images and addresses -----------------------------------------------------------------


@query(
    "f8_normalise_image",
    """
    select page_id, case when contains(url, 'www') then '/scratch/u' || page_id || '/vllm_gemma4.sif'
      when contains(url, 'blog') then '/img/' || page_id || '.sif'
      when starts_with(url, 'https') then 'docker://' || url
      else '/scratch/u' || page_id || '/' || replace(url, ':', '') end as image
    from pages
    """,
)
def f8(spark, sf_dir):
    url, key = F.col("url"), F.col("page_id").cast("string")
    image = (
        F.when(url.contains("www"), "")
        .when(url.contains("blog"), F.concat(F.lit("/img/"), key, F.lit(".sif")))
        .when(url.startswith("https"), url)
        .otherwise(F.replace(url, F.lit(":"), F.lit("")))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise_image(image, F.concat(F.lit("u"), key)).alias("image"))


@query(
    "f9_rewrite_host",
    r"""
    select page_id, case when contains(url, 'blog') then 'http://host.docker.internal:' || page_id || '/v1/' else url end as reachable,
      regexp_replace(regexp_replace(url || case when contains(url, '#') then '/v1//' else '/' end, '/+$', ''), '/v1$', '') as base
    from pages
    """,
)
def f9(spark, sf_dir):
    url = F.col("url")
    local = F.when(url.startswith("https"), "localhost").otherwise("127.0.0.1")
    address = F.concat(F.lit("http://"), local, F.lit(":"), F.col("page_id").cast("string"), F.lit("/v1/"))
    tail = F.when(url.contains("#"), "/v1//").otherwise("/")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.rewrite_host(F.when(url.contains("blog"), address).otherwise(url)).alias("reachable"),
        urls.strip_api_suffix(F.concat(url, tail)).alias("base"),
    )


@query(
    "f10_url_port",
    r"""
    with u as (
      select page_id, case when contains(url, 'blog') then regexp_replace(url, '^([a-z]+://)([^/]+)', '\1bob@\2:' || (page_id * 300)) else url end as url
      from pages
    )
    select page_id, case when try_cast(regexp_extract(url, '^[a-z]+://[^/?#]*:(\d+)([/?#]|$)', 1) as integer) between 1 and 65535
        then cast(regexp_extract(url, '^[a-z]+://[^/?#]*:(\d+)([/?#]|$)', 1) as integer) else 8001 end as port,
      'http://' || regexp_extract(url, '^[a-z]+://(bob@)?([^/?#:]*)', 2) || ':' || page_id || '/v1' as api,
      'http://' || regexp_extract(url, '^[a-z]+://(bob@)?([^/?#:]*)', 2) || ':' || page_id || '/health' as health,
      'http://' || regexp_extract(url, '^[a-z]+://(bob@)?([^/?#:]*)', 2) || ':' || page_id || '/v1/models' as models
    from u
    """,
)
def f10(spark, sf_dir):
    ported = F.regexp_replace(F.col("url"), F.lit("^([a-z]+://)([^/]+)"), F.concat(F.lit("$1bob@$2:"), (F.col("page_id") * 300).cast("string")))
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").contains("blog"), ported).otherwise(F.col("url")).alias("url"))
    host = urls.url_host("url")
    return p.select(
        "page_id",
        urls.url_port("url", 8001).alias("port"),
        urls.api_base(host, "page_id").alias("api"),
        urls.health_url(host, "page_id").alias("health"),
        urls.models_url(host, "page_id").alias("models"),
    )


# -- small text functions -----------------------------------------------------------------


@query(
    "f11_ensure_prefix",
    "select p_partkey, 'openai/' || p_name as model from part",
)
def f11(spark, sf_dir):
    name = F.when(F.col("p_size") > 25, F.concat(F.lit("openai/"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.ensure_prefix(name).alias("model"))


@query(
    "f12_mask",
    """
    select c_custkey, left(c_name, 4) || '...' || right(c_name, 4) as name,
      case when length(c_mktsegment) > 8 then left(c_mktsegment, 4) || '...' || right(c_mktsegment, 4) else '****' end as segment
    from customer
    """,
)
def f12(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask("c_name").alias("name"), text.mask("c_mktsegment").alias("segment"))


@query("f21_container_name", "select s_suppkey, 'vllm-dgx-' || s_name as container from supplier")
def f21(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.container_name("s_name").alias("container"))


@query(
    "f22_expand_var",
    """
    select c_custkey, case when c_acctbal >= 0 then c_name else c_mktsegment || '}' end as value,
      case when c_acctbal >= 0 then c_mktsegment end as key
    from customer
    """,
)
def f22(spark, sf_dir):
    raw = F.concat(F.when(F.col("c_acctbal") >= 0, "{").otherwise(""), F.col("c_mktsegment"), F.lit("}"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.expand_var(raw, "c_name").alias("value"), text.placeholder_key(raw).alias("key")
    )


@query("l3_text_preview", f"select doc_id, left({sql_strip('text')}, 50) as preview from documents")
def l3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


# -- rendered records -----------------------------------------------------------------------


def _start_record():
    return text_map(
        name=F.col("p_name"),
        model=F.col("p_type"),
        image=F.col("p_brand"),
        port=F.when(F.col("p_size") > 10, F.col("p_partkey")),
        max_model_len=F.when(F.col("p_size") > 20, F.col("p_size") * 1024),
        max_num_batched_tokens=F.when(F.col("p_size") > 30, F.when(F.col("p_size") > 40, F.col("p_size")).otherwise(0)),
        extra_args=F.when(F.col("p_size") > 5, F.concat(F.lit("  --a "), F.col("p_name"), F.lit("\n\n   \n--b 1 \n"))),
        cache_dir=F.when(F.col("p_size") > 15, F.concat(F.lit("/cache/"), F.col("p_brand"))),
        enable_prefix_caching=F.when(F.col("p_size") < 9, F.lit("false")),
        gpu_ids=F.when(F.col("p_size") > 45, F.lit("0,1")),
    )


def _part_platform():
    return F.when(F.col("p_type") == "ECONOMY", "uva").when(F.col("p_type") == "SMALL", "dgx").otherwise("default")


def _sql_flags(indent: str, end: str) -> str:
    def flag(expr, cond=None):
        text_ = f"'{indent}' || {expr} || '{end}'"
        return f"case when {cond} then {text_} end" if cond else text_

    common_tail = [
        flag("'--max-num-batched-tokens ' || p_size", "p_size > 40"),
        flag("'--a ' || p_name", "p_size > 5"),
        flag("'--b 1'", "p_size > 5"),
    ]
    length = "coalesce(case when p_size > 20 then cast(p_size * 1024 as varchar) end, '%s')"
    port = "coalesce(case when p_size > 10 then cast(p_partkey as varchar) end, '8000')"
    cache = "coalesce(case when p_size > 15 then '/cache/' || p_brand end, '/scratch/$USER/hf_cache')"

    def head(tp, gpu, max_len):
        out = [flag("'--model ' || p_type"), flag(f"'--tensor-parallel-size {tp}'"), flag(f"'--gpu-memory-utilization {gpu}'")]
        return out + ([flag(f"'--max-model-len ' || {length % max_len}")] if max_len else [])

    uva = head("1", "0.9", "16384") + common_tail + [flag(f"'--port ' || {port}"), flag(f"'--cache-dir ' || {cache}"), flag("'--key-dir $HOME/gemma'")]
    dgx = head("4", "0.95", "131072") + common_tail + [
        flag("'--enable-prefix-caching'", "p_size >= 9"),
        flag("'--load-format safetensors'"),
        flag("'--enable-auto-tool-choice'"),
        flag("'--tool-call-parser gemma4'"),
    ]
    other = head("1", "0.9", None) + common_tail + [flag(f"'--port ' || {port}")]

    def joined(parts):
        return f"concat_ws(chr(10), {', '.join(parts)})"

    return f"case p_type when 'ECONOMY' then {joined(uva)} when 'SMALL' then {joined(dgx)} else {joined(other)} end"


@query("f13_render_args", f"select p_partkey, {_sql_flags('', '')} as flags from part")
def f13(spark, sf_dir):
    flags = records.start_flags("record", _part_platform())
    parts = table(spark, sf_dir, "part").withColumn("record", _start_record())
    return parts.select("p_partkey", F.array_join(flags, "\n").alias("flags"))


@query(
    "f13_start_script",
    f"""
    with p as (
      select *, {_sql_flags('', ' \\')} as near, {_sql_flags('    ', ' \\')} as far,
        coalesce(case when p_size > 10 then cast(p_partkey as varchar) end, '8000') as port,
        coalesce(case when p_size > 15 then '/cache/' || p_brand end, '$HOME/.cache/huggingface') as cache,
        case when p_size > 45 then '0,1' else '0,1,2,3' end as gpus
      from part
    )
    select p_partkey, '#!/bin/bash' || chr(10) || case when p_type = 'SMALL' then
        '        mkdir -p ~/vllm_logs' || chr(10) || '        HF_TOKEN=$(cat $HOME/.config/fleet/keys/hugging.txt)' || chr(10) ||
        'VLLM_API_KEY=$(cat $HOME/.config/fleet/keys/server_master_key.txt)' || chr(10) ||
        'docker run -d --name vllm-dgx-' || p_name || ' --gpus all \\' || chr(10) || '    --shm-size 16gb \\' || chr(10) ||
        '    -v ' || cache || ':/root/.cache/huggingface \\' || chr(10) || '    -p 127.0.0.1:' || port || ':8000 \\' || chr(10) ||
        '    -e HF_TOKEN="${{HF_TOKEN}}" \\' || chr(10) || '    -e VLLM_API_KEY="${{VLLM_API_KEY}}" \\' || chr(10) ||
        '    -e NVIDIA_VISIBLE_DEVICES=' || gpus || ' \\' || chr(10) || '    ' || p_brand || ' \\' || chr(10) || far
      else '    mkdir -p ~/vllm_logs' || chr(10) || '    ' || case when p_type = 'ECONOMY' then 'apptainer run --nv ' || p_brand || ' \\'
        else 'python3 -m vllm.entrypoints.openai.api_server \\' end || chr(10) || near end
      || ' > ~/vllm_logs/' || p_name || '.log 2>&1' as script
    from p
    """,
)
def f13_script(spark, sf_dir):
    script = records.start_script("record", _part_platform())
    return table(spark, sf_dir, "part").withColumn("record", _start_record()).select("p_partkey", script.alias("script"))


@query(
    "f14_overlay",
    """
    select c_custkey, 'base' as kept, case when c_acctbal >= 0 then c_name else 'low' end as api_base,
      case when c_nationkey > 10 then cast(c_nationkey as varchar) else '3000' end as port
    from customer
    """,
)
def f14(spark, sf_dir):
    base = F.create_map(F.lit("kept"), F.lit("base"), F.lit("port"), F.lit("3000"), F.lit("api_base"), F.lit("low"))
    over = text_map(API_BASE=F.when(F.col("c_acctbal") >= 0, F.col("c_name")), port=F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")))
    c = table(spark, sf_dir, "customer").select("c_custkey", records.overlay(base, over).alias("m"))
    return c.select(
        "c_custkey", F.col("m")["kept"].alias("kept"), records.get_any_case("m", "api_base").alias("api_base"), F.col("m")["port"].alias("port")
    )


@query(
    "f15_render_batch_header",
    """
    select o_orderkey, '#!/bin/bash' || chr(10) || '#SBATCH --job-name=vllm-o' || o_orderkey || chr(10) ||
      '#SBATCH --output=/w/o' || o_orderkey || '_%j.out' || chr(10) || '#SBATCH --error=/w/o' || o_orderkey || '_%j.err' || chr(10) ||
      case when o_orderstatus <> 'P' then '#SBATCH --partition=' || o_orderstatus || chr(10) else '' end ||
      case when o_orderpriority = '5-LOW' then '#SBATCH --reservation=low' || chr(10) else '' end ||
      '#SBATCH --gres=gpu:gpu:1' || chr(10) || '#SBATCH --cpus-per-task=' || coalesce(case when o_orderpriority = '1-URGENT' then '8' end, '1') || chr(10) ||
      '#SBATCH --mem=16G' || chr(10) || '#SBATCH --time=24:00:00' || chr(10) || chr(10) || '/w/run.sh' || chr(10) as header
    from orders
    """,
)
def f15(spark, sf_dir):
    record = text_map(
        name=F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        partition=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""),
        reservation=F.when(F.col("o_orderpriority") == "5-LOW", F.lit("low")),
        cpus=F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("8")),
    )
    header = records.batch_header("record", F.lit("/w"), F.lit("/w/run.sh"))
    return table(spark, sf_dir, "orders").withColumn("record", record).select("o_orderkey", header.alias("header"))


@query(
    "f16_render_submit_command",
    """
    with o as (
      select o_orderkey, 'o' || o_orderkey as name, o_orderstatus,
        case when o_orderpriority = '1-URGENT' then 'sbatch' when o_orderpriority = '5-LOW' then 'other' else 'ijob' end as mode,
        case when o_orderpriority = '3-MEDIUM' then ' --reservation=mid' else '' end as reservation
      from orders
    )
    select o_orderkey,
      case when mode = 'sbatch' and o_orderstatus <> 'O' then 'sbatch /w/submit.sh'
        when mode = 'ijob' and o_orderstatus <> 'P' then 'ijob -p ' || o_orderstatus || reservation || ' /w/run.sh' end as command,
      case when mode = 'sbatch' and o_orderstatus = 'O' then 'batch file is required for sbatch mode'
        when mode = 'ijob' and o_orderstatus = 'P' then 'partition is required for interactive startup of ' || name
        when mode = 'other' then 'unsupported execution mode: other' end as error,
      case when o_orderstatus <> 'P' then 'ijob -c 1 -A lab -p ' || o_orderstatus || ' --time=1:00 --gres=gpu:1' || reservation end as interactive
    from o
    """,
)
def f16(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    record = text_map(
        name=F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        partition=F.when(status != "P", status),
        reservation=F.when(priority == "3-MEDIUM", F.lit("mid")),
        allocation=F.lit("lab"),
        time=F.lit("1:00"),
        gres=F.lit("gpu:1"),
    )
    mode = F.when(priority == "1-URGENT", "sbatch").when(priority == "5-LOW", "other").otherwise("ijob")
    submit = records.submit_command("record", mode, F.lit("/w/run.sh"), F.when(status != "O", "/w/submit.sh"))
    o = table(spark, sf_dir, "orders").withColumn("record", record)
    o = o.select("o_orderkey", submit.alias("s"), records.interactive_command("record").alias("interactive"))
    return o.select("o_orderkey", "s.command", "s.error", "interactive")


@query(
    "f23_render_kv",
    """
    select c_custkey, 'API_BASE=http://h:' || c_nationkey || '/v1' || chr(10) || 'API_KEY=' || case when c_acctbal >= 0 then c_name else '' end ||
      chr(10) || 'NAME=' || c_mktsegment as env
    from customer
    """,
)
def f23(spark, sf_dir):
    env = F.create_map(
        F.lit("API_BASE"), urls.api_base(F.lit("h"), "c_nationkey"),
        F.lit("API_KEY"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")),
        F.lit("NAME"), F.col("c_mktsegment"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", records.render_kv(env).alias("env"))


@query(
    "f24_serialise",
    """
    select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' ||
      case when c_acctbal >= 0 then ',"nation":' || c_nationkey else '' end || '}' as document
    from customer
    """,
)
def f24(spark, sf_dir):
    nation = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation")
    return table(spark, sf_dir, "customer").select("c_custkey", records.serialise("c_custkey", "c_name", nation).alias("document"))


# -- chat payloads --------------------------------------------------------------------------


@query(
    "f18_chat_payload",
    """
    select conv_id, turn, json_extract_string(p, '$.model') as model, json_extract_string(p, '$.messages[0].role') as role,
      json_extract_string(p, '$.messages[0].content') as content, cast(json_extract(p, '$.temperature') as double) as temperature
    from (select conv_id, turn, json_object('model', 'google/gemma-4-31B-it', 'messages', [json_object('role', 'user', 'content', text)],
      'temperature', 0.7) as p from conversations)
    """,
)
def f18(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", payloads.chat_payload("text").alias("p"))
    back = F.from_json("p", "struct<model:string,messages:array<struct<role:string,content:string>>,temperature:double>")
    return p.select("conv_id", "turn", back.alias("b")).select(
        "conv_id",
        "turn",
        "b.model",
        F.get("b.messages", F.lit(0))["role"].alias("role"),
        F.get("b.messages", F.lit(0))["content"].alias("content"),
        "b.temperature",
    )


@query(
    "f19_chat_content",
    """
    select conv_id, turn, case when role = 'system' then 'OK (but no content found in response)' else text end as content from conversations
    """,
)
def f19(spark, sf_dir):
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    full = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    answer = F.when(F.col("role") == "system", '{"choices":[]}').otherwise(full)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", payloads.chat_content(answer).alias("content"))


@query(
    "f20_model_ids",
    """
    select conv_id, turn,
      case role when 'user' then 'u' || conv_id || ',t' || turn when 'assistant' then 't' || turn else '' end as ids,
      case role when 'user' then 'u' || conv_id when 'assistant' then 't' || turn else 'google/gemma-4-31B-it' end as first,
      case role when 'user' then 'OK (2 models found: u' || conv_id || ', t' || turn || ')' when 'assistant' then 'OK (1 models found: t' || turn || ')'
        else 'OK (0 models found: None)' end as found
    from conversations
    """,
)
def f20(spark, sf_dir):
    user = F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("conv_id").cast("string"))).otherwise("")
    ids = F.array(user, F.concat(F.lit("t"), F.col("turn").cast("string")), F.lit(None).cast("string"))
    full = F.to_json(F.struct(F.transform(ids, lambda i: F.struct(i.alias("id"))).alias("data")))
    answer = F.when(F.col("role") == "system", '{"data": "none"').otherwise(full)
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.array_join(payloads.model_ids(answer), ",").alias("ids"),
        payloads.first_model(answer).alias("first"),
        payloads.models_found(answer).alias("found"),
    )
