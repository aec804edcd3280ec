"""Whole pipelines: running jobs, resolved services, listed settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster import fixed_values as fv
from muster.functions import records, templates, text
from muster.functions.common import first_set, spread
from muster.operators import leaves, matching, predicates, refs
from muster.plans import shapes
from muster.plans.registry import query, table
from muster.sources import listings


def running_jobs(lines: DataFrame, registry: DataFrame, token: str = fv.JOB_TOKEN) -> DataFrame:
    """Service jobs of a text listing with their server, port, node and state."""
    jobs = predicates.filter_name_contains(listings.parse_listing_text(lines), "name", token)
    jobs = jobs.select("job_id", "name", "state", text.first_listed_node("nodes").alias("node"))
    return matching.match_jobs(jobs, registry).select("server", "job_id", "node", "port", "state")


@query(
    "flow_running_jobs",
    f"""
    with {shapes.SQL_LISTED}, jobs as (select * from listed where contains(name, 'vllm_')), {shapes.SQL_REGISTRY},
    candidates as (
      select j.job_id, r.ord from jobs j join registry r on r.job_id = j.job_id
      union all
      select j.job_id, r.ord from jobs j join registry r on r.job_name = j.name
    ),
    best as (select job_id, min(ord) as ord from candidates group by job_id)
    select coalesce(r.server, 'Unknown') as server, j.job_id, j.node,
      case when r.ord is null then 'Unknown' else coalesce(cast(r.remote_port as varchar), '8000') end as port, j.state
    from jobs j left join best b on b.job_id = j.job_id left join registry r on r.ord = b.ord
    """,
)
def running_jobs_flow(spark, sf_dir):
    return running_jobs(shapes.listing_lines(spark, sf_dir), shapes.registry(spark, sf_dir))


def resolve_services(
    layered: DataFrame,
    keys: list[str],
    depth: int,
    fields: list[str],
    sections: DataFrame,
    port_override,
    fallback_user,
    default_dir: str,
) -> DataFrame:
    """Finished record and script of every service, from layered leaves to final text.

    Merge the layers; look up references of the user field; put in an allowed port override;
    take the fallback user; fill all placeholders; then ``$USER``, the port flag and the
    first line of the script. ``error`` names what makes a record unusable.
    """
    merged = leaves.merge_layers(layered, keys)
    table_ = leaves.leaves_to_record(merged, keys, depth, fields)
    table_ = table_.withColumn("user", F.col("record")["user"])
    table_ = refs.resolve_refs(table_, "user", sections)

    override = F.nullif(port_override, F.lit(0)).cast("int")
    in_range = predicates.in_range(port_override)
    port = F.when(in_range, override)
    name = text.override_name_suffix(F.col("record")["name"], port)
    changed = F.map_filter(
        F.create_map(
            F.lit("user"), first_set("user", fallback_user),
            F.lit("name"), name,
            F.lit("dir"), F.coalesce(F.col("record")["dir"], F.lit(default_dir)),
            F.lit("remote_port"), F.coalesce(port.cast("string"), F.col("record")["remote_port"]),
            F.lit("local_port"), F.coalesce(port.cast("string"), F.col("record")["local_port"]),
        ),
        lambda k, v: v.isNotNull(),
    )
    table_ = table_.select(*keys, records.overlay("record", changed).alias("record"), port.alias("_port"), in_range.alias("_ok"))
    table_ = table_.select(*keys, templates.resolve_bindings("record").alias("record"), "_port", "_ok")
    done = F.transform_values(
        "record", lambda k, v: text.override_port_flag(text.expand_user(v, F.col("record")["user"]), F.col("_port"))
    )
    table_ = table_.select(*keys, done.alias("record"), "_ok")
    error = F.when(~F.col("_ok"), F.lit("port out of range")).when(
        first_set(F.col("record")["host"]).isNull(), F.lit("host not specified")
    )
    return table_.select(
        *keys,
        *[F.col("record")[f].alias(f) for f in fields if f != "script"],
        text.normalise_shebang(F.col("record")["script"]).alias("script"),
        error.alias("error"),
    )


_FIELDS = ["host", "user", "name", "dir", "local_port", "remote_port", "model", "script"]


def _service_layers(spark, sf_dir):
    """Shipped defaults by nation, and each customer's own settings above them."""
    c = spread(table(spark, sf_dir, "customer"))
    segment = F.col("c_mktsegment")
    user = F.concat(F.lit("{~/.ssh/config:nation"), F.col("c_nationkey").cast("string"), F.lit(".User}"))

    def setting(layer, field, value):
        path = F.array(F.lit("server"), F.lit(field))
        return F.struct(F.lit(layer).alias("layer"), path.alias("path"), value.alias("value"))

    def quoted(s):
        return F.concat(F.lit('"'), F.lit(s) if isinstance(s, str) else s, F.lit('"'))

    rows = F.array(
        setting(0, "name", quoted("vllm_{model}_18123")),
        setting(0, "remote_port", F.lit("18123")),
        setting(0, "user", quoted(user)),
        setting(0, "host", quoted("default")),
        setting(0, "script", quoted("cd {dir}\\nrun {model} --port {remote_port} -u $USER ${model} {missing}\\n")),
        setting(1, "model", quoted(segment)),
        F.when(segment == "BUILDING", setting(1, "host", F.lit("null"))),
        F.when(segment == "MACHINERY", setting(1, "dir", quoted("/raid/{name}"))),
        F.when(segment == "FURNITURE", setting(1, "user", F.lit("null"))),
        F.when(segment == "HOUSEHOLD", setting(1, "script", quoted("#!/bin/sh\\nrun --port 1 as {user}"))),
    )
    override = F.when(F.col("c_acctbal") < 0, F.col("c_custkey") * 100)
    base = c.select("c_custkey", override.alias("override"), F.explode(F.array_compact(rows)).alias("r"))
    return base.select("c_custkey", "override", "r.layer", "r.path", "r.value")


@query(
    "flow_resolve_services",
    r"""
    with s as (
      select c_custkey, c_mktsegment as model, case when c_acctbal < 0 then c_custkey * 100 end as override,
        case c_mktsegment when 'FURNITURE' then 'nobody' else case when s.k is not null then 'u' || c_nationkey
          else '{~/.ssh/config:nation' || c_nationkey || '.User}' end end as user,
        case when c_mktsegment = 'BUILDING' then null else 'default' end as host
      from customer left join (select distinct s_nationkey as k from supplier where s_acctbal >= 2000) s on s.k = c_nationkey
    ), p as (
      select *, case when override between 1 and 65535 then cast(override as varchar) end as port, coalesce(override between 0 and 65535, true) as ok from s
    ), n as (
      select *, 'vllm_' || model || '_' || coalesce(port, '18123') as name, coalesce(port, '18123') as remote_port from p
    ), d as (
      select *, case when model = 'MACHINERY' then '/raid/' || name else '/scratch/' || user || '/fleet/' || name end as dir from n
    )
    select c_custkey, host, user, name, dir, port as local_port, remote_port, model,
      case when model = 'HOUSEHOLD' then '#!/bin/bash' || chr(10) || 'run --port ' || coalesce(port, '1') || ' as ' || user
      else '#!/bin/bash' || chr(10) || 'cd ' || dir || chr(10) || 'run ' || model || ' --port ' || remote_port || ' -u ' || user || ' ${model} {missing}' || chr(10) end as script,
      case when not ok then 'port out of range' when host is null then 'host not specified' end as error
    from d
    """,
)
def resolve_services_flow(spark, sf_dir):
    layered = _service_layers(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    sections = s.select(
        F.lit("~/.ssh/config").alias("file"),
        F.concat(F.lit("nation"), nation).alias("section"),
        F.when(F.col("s_acctbal") >= 2000, "user").otherwise("former_user").alias("attr"),
        F.concat(F.lit("u"), nation).alias("value"),
        F.col("s_suppkey").alias("line_no"),
    )
    keys = ["c_custkey", "override"]
    done = resolve_services(
        layered, keys, 1, _FIELDS, sections, F.col("override"), F.lit("nobody"), "/scratch/{user}/fleet/{name}"
    )
    return done.drop("override")


@query(
    "flow_list_config",
    """
    select c_custkey, unnest(['client.web.port', 'default.server', 'limits', 'server.main.host', 'server.main.note.txt', 'server.main.port', 'tags']) as name
    from customer
    """,
)
def list_config_flow(spark, sf_dir):
    """Sorted names of all settings below the root."""
    docs = shapes.service_docs(spark, sf_dir).select("c_custkey", leaves.parse_doc("text").alias("doc"))
    rows = leaves.flatten_leaves(docs).filter(F.slice("path", 1, 2) == F.array(F.lit("fleet"), F.lit("ai")))
    names = rows.select("c_custkey", leaves.leaf_name(F.slice("path", 3, F.greatest(F.size("path") - 2, F.lit(0)))).alias("name"))
    return names.orderBy("c_custkey", "name")
