"""Queries for matching, lookups, merging and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions.common import spread
from muster.operators import leaves, matching, refs, state
from muster.plans import shapes
from muster.plans.registry import query, table

SQL_FIRST_MATCH = """
candidates as (
  select j.job_id, r.ord, r.server, r.remote_port from jobs j join registry r on r.job_id = j.job_id
  union all
  select j.job_id, r.ord, r.server, r.remote_port from jobs j join registry r on r.job_name = j.name
),
best as (select job_id, min(ord) as ord from candidates group by job_id),
matched as (
  select j.job_id, j.name, j.state, j.node, coalesce(r.server, 'Unknown') as server,
    case when r.ord is null then 'Unknown' else coalesce(cast(r.remote_port as varchar), '8000') end as port
  from jobs j left join best b on b.job_id = j.job_id left join registry r on r.ord = b.ord
)
"""


@query(
    "j1_match_jobs",
    f"with {shapes.SQL_JOBS}, {shapes.SQL_REGISTRY}, {SQL_FIRST_MATCH} select * from matched",
)
def j1(spark, sf_dir):
    return matching.match_jobs(shapes.jobs(spark, sf_dir), shapes.registry(spark, sf_dir))


@query(
    "j2_match_jobs_by_pattern",
    """
    with jobs as (
      select cast(o_orderkey as varchar) as job_id, 'vllm_' || o_custkey || '_' || lower(o_orderstatus) as name from orders
    ),
    requests as (
      select c_custkey as req_id, case when c_mktsegment = 'BUILDING' then '_' || c_custkey || '_' end as pattern,
        case when c_mktsegment <> 'FURNITURE' then 'vllm_' || c_custkey end as job_name,
        case when c_acctbal < 0 then cast(c_custkey * 20 as varchar) end as stored_job_id
      from customer
    ),
    stored as (
      select r.req_id, j.job_id, j.name, 'stored' as rule from requests r join jobs j on j.job_id = r.stored_job_id
      where r.pattern is null
    ),
    searched as (select * from requests where req_id not in (select req_id from stored))
    select * from stored
    union all
    select r.req_id, j.job_id, j.name, case when contains(j.name, r.pattern) then 'pattern' else 'name' end
    from searched r join jobs j on contains(j.name, r.pattern) or contains(j.name, r.job_name)
    """,
)
def j2(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("vllm_"), key, F.lit("_"), F.lower("o_orderstatus")).alias("name")
    )
    c, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        F.when(segment == "BUILDING", F.concat(F.lit("_"), c, F.lit("_"))).alias("pattern"),
        F.when(segment != "FURNITURE", F.concat(F.lit("vllm_"), c)).alias("job_name"),
        F.when(F.col("c_acctbal") < 0, F.col("c_custkey") * 20).alias("stored_job_id"),
    )
    return matching.match_jobs_by_pattern(jobs, requests)


@query(
    "j3_resolve_refs",
    """
    with entries as (
      select 'Supplier#' || lpad(cast(s_suppkey as varchar), 9, '0') as section, case when s_acctbal >= 0 then 'u' || s_nationkey end as usr,
        22 + s_suppkey as port from supplier
    ),
    first_port as (select port from entries order by port limit 1)
    select l_orderkey, l_linenumber, l_partkey,
      'ssh ' || coalesce(usr, '{~/.ssh/config:' || s || '.User}') || '@' || l_partkey || ' -p ' || coalesce(cast(e.port as varchar), '{~/.ssh/config:' || s || '.port}') ||
      ' {~/.ssh/config:' || s || '.Nothing} {/other/file:a.b} {user} {x:y} ' || coalesce((select cast(port as varchar) from first_port), '{~/.ssh/config:Port}') as command
    from (select *, 'Supplier#' || lpad(cast(l_suppkey as varchar), 9, '0') as s from lineitem) l left join entries e on e.section = l.s
    """,
)
def j3(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.col("s_suppkey") * 10
    file = F.lit("~/.ssh/config")
    ports = s.select(file.alias("file"), F.col("s_name").alias("section"), F.lit("Port").alias("attr"), (22 + F.col("s_suppkey")).cast("string").alias("value"), line.alias("line_no"))
    attr = F.when(F.col("s_acctbal") >= 0, "user").otherwise("former_user")
    users = s.select(
        file.alias("file"), F.col("s_name").alias("section"), attr.alias("attr"), F.concat(F.lit("u"), F.col("s_nationkey").cast("string")).alias("value"), (line + 1).alias("line_no")
    )
    later = users.withColumn("value", F.lit("too late")).withColumn("line_no", F.col("line_no") + 5)
    sections = ports.unionByName(users).unionByName(later)
    host = F.concat(F.lit("{~/.ssh/config:Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    command = F.concat(
        F.lit("ssh "), host, F.lit(".User}@"), F.col("l_partkey").cast("string"), F.lit(" -p "), host, F.lit(".port} "),
        host, F.lit(".Nothing} {/other/file:a.b} {user} {x:y} {~/.ssh/config:Port}"),
    )
    commands = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", command.alias("command"))
    return refs.resolve_refs(commands, "command", sections)


SQL_LAYERS = """
layer_leaves as (
  select c_custkey, 0 as layer, unnest([['port'], ['limits', 'cpu'], ['limits', 'mem'], ['mode'], ['extra'], ['client', 'web', 'port']]) as path,
    unnest([cast(8000 + c_nationkey as varchar), cast(c_nationkey as varchar), '"16G"', '"shared"', '{}', '3000']) as value
  from customer
  union all select c_custkey, 1, ['port'], cast(c_custkey as varchar) from customer where c_acctbal >= 0
  union all select c_custkey, 1, ['limits'], 'null' from customer where c_mktsegment = 'BUILDING'
  union all select c_custkey, 1, ['limits'], '{}' from customer where c_mktsegment = 'FURNITURE'
  union all select c_custkey, 1, ['mode', 'kind'], '"own"' from customer where c_mktsegment = 'MACHINERY'
  union all select c_custkey, 1, ['extra', 'a'], '1' from customer where c_mktsegment = 'HOUSEHOLD'
  union all select c_custkey, 2, ['client'], '"none"' from customer where c_nationkey < 5
  union all select c_custkey, 2, ['limits', 'cpu'], '99' from customer where c_nationkey > 15
),
gone as (
  select distinct a.c_custkey, a.layer, a.path from layer_leaves a join layer_leaves b
    on b.c_custkey = a.c_custkey and b.layer > a.layer
    and (b.path = a.path
      or (b.value <> '{}' and len(b.path) < len(a.path) and list_slice(a.path, 1, len(b.path)) = b.path)
      or (a.value <> '{}' and len(b.path) > len(a.path) and list_slice(b.path, 1, len(a.path)) = a.path))
),
left_over as (
  select l.* from layer_leaves l anti join gone g on g.c_custkey = l.c_custkey and g.layer = l.layer and g.path = l.path
),
merged as (
  select a.c_custkey, array_to_string(a.path, '.') as name, a.value from left_over a
  where not (a.value = '{}' and exists (select 1 from left_over b where b.c_custkey = a.c_custkey
    and len(b.path) > len(a.path) and list_slice(b.path, 1, len(a.path)) = a.path))
)
"""


def layer_leaves(spark, sf_dir):
    """Three layers of settings for every customer."""
    c = spread(table(spark, sf_dir, "customer"))
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")

    def setting(layer, path, value, when=None):
        row = F.struct(F.lit(layer).alias("layer"), F.array(*[F.lit(p) for p in path]).alias("path"), value.alias("value"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        setting(0, ["port"], (8000 + nation).cast("string")),
        setting(0, ["limits", "cpu"], nation.cast("string")),
        setting(0, ["limits", "mem"], F.lit('"16G"')),
        setting(0, ["mode"], F.lit('"shared"')),
        setting(0, ["extra"], F.lit("{}")),
        setting(0, ["client", "web", "port"], F.lit("3000")),
        setting(1, ["port"], F.col("c_custkey").cast("string"), F.col("c_acctbal") >= 0),
        setting(1, ["limits"], F.lit("null"), segment == "BUILDING"),
        setting(1, ["limits"], F.lit("{}"), segment == "FURNITURE"),
        setting(1, ["mode", "kind"], F.lit('"own"'), segment == "MACHINERY"),
        setting(1, ["extra", "a"], F.lit("1"), segment == "HOUSEHOLD"),
        setting(2, ["client"], F.lit('"none"'), nation < 5),
        setting(2, ["limits", "cpu"], F.lit("99"), nation > 15),
    )
    return c.select("c_custkey", F.explode(F.array_compact(rows)).alias("r")).select("c_custkey", "r.*")


@query("j4_merge_layers", f"with {SQL_LAYERS} select * from merged")
def j4(spark, sf_dir):
    merged = leaves.merge_layers(layer_leaves(spark, sf_dir), ["c_custkey"])
    return merged.select("c_custkey", leaves.leaf_name().alias("name"), "value")


# Objects of the same parent become one text, from the deepest level up.
SQL_FOLDED_DOCS = """
deep as (select c_custkey, path, value from left_over a where not (value = '{}' and exists (
  select 1 from left_over b where b.c_custkey = a.c_custkey and len(b.path) > len(a.path) and list_slice(b.path, 1, len(a.path)) = a.path))),
two as (
  select c_custkey, path, value from deep where len(path) < 3
  union all select c_custkey, list_slice(path, 1, 2), '{' || string_agg('"' || path[3] || '":' || value, ',' order by path[3]) || '}'
  from deep where len(path) = 3 group by c_custkey, list_slice(path, 1, 2)
),
one as (
  select c_custkey, path, value from two where len(path) < 2
  union all select c_custkey, list_slice(path, 1, 1), '{' || string_agg('"' || path[2] || '":' || value, ',' order by path[2]) || '}'
  from two where len(path) = 2 group by c_custkey, list_slice(path, 1, 1)
),
folded as (select c_custkey, '{' || string_agg('"' || path[1] || '":' || value, ',' order by path[1]) || '}' as text from one group by c_custkey)
"""


@query("j4_merged_documents", f"with {SQL_LAYERS}, {SQL_FOLDED_DOCS} select * from folded")
def j4_documents(spark, sf_dir):
    """All layers of a customer, merged and written as one document."""
    return leaves.rebuild_documents(leaves.merge_layers(layer_leaves(spark, sf_dir), ["c_custkey"]), ["c_custkey"])


@query(
    "j5_keep_live",
    f"with {shapes.SQL_STATE} select key, pid from state where pid in (select user_id from events where event_type = 'click')",
)
def j5(spark, sf_dir):
    # Only a click shows a live process; the other events name none.
    live = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", F.col("user_id")).alias("pid"))
    return matching.keep_live(shapes.state(spark, sf_dir), live)


def _asked_keys(spark, sf_dir):
    """Errors ask for their host to be removed, all other events for one that is not there."""
    port = F.when(F.col("value") > 300, ":9000").otherwise(":8000")
    host = F.concat(F.lit("host"), F.col("user_id").cast("string"), port)
    return table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", host).otherwise("nobody").alias("key"))


_SQL_ASKED = """
asked as (
  select distinct case when event_type = 'error' then 'host' || user_id || case when value > 300 then ':9000' else ':8000' end else 'nobody' end as key from events
)
"""


@query("j6_delete_keys_state", f"with {shapes.SQL_STATE}, {_SQL_ASKED} select * from state where key not in (select key from asked)")
def j6_state(spark, sf_dir):
    return matching.delete_keys(shapes.state(spark, sf_dir), _asked_keys(spark, sf_dir))[0]


@query(
    "j6_delete_keys_outcome",
    f"""
    with {shapes.SQL_STATE}, {_SQL_ASKED}
    select a.key, s.key is not null as removed, coalesce(cast(s.pid as varchar), 'No active tunnel found for this host/port') as detail
    from asked a left join state s on s.key = a.key
    """,
)
def j6_outcome(spark, sf_dir):
    return matching.delete_keys(shapes.state(spark, sf_dir), _asked_keys(spark, sf_dir))[1]


@query(
    "j7_resolve_backend",
    """
    with servers as (
      select c_custkey as ord, c_name as server, case when c_mktsegment <> 'MACHINERY' then cast(18000 + c_nationkey as integer) end as local_port,
        case when c_acctbal > 500 then 'job' || c_custkey when c_acctbal > 0 then '' end as job_id from customer
    ),
    running as (select coalesce(local_port, 8000) as port from servers where job_id <> '' order by ord limit 1)
    select o_orderkey, coalesce(case when o_orderpriority = '1-URGENT' then nullif(cast(o_custkey as integer), 0) end,
      case when o_orderstatus = 'F' then case when o_orderpriority = '2-HIGH' then 8000 else coalesce(s.local_port, 8000) end end,
      (select port from running), 8000) as port
    from orders left join servers s on s.ord = o_custkey
    """,
)
def j7(spark, sf_dir):
    servers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("server"),
        F.when(F.col("c_mktsegment") != "MACHINERY", 18000 + F.col("c_nationkey")).cast("int").alias("local_port"),
        F.when(F.col("c_acctbal") > 500, F.concat(F.lit("job"), F.col("c_custkey").cast("string"))).when(F.col("c_acctbal") > 0, "").alias("job_id"),
    )
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    clients = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey").cast("int")).alias("override_port"),
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "2-HIGH", "gone").otherwise(name)).alias("default_server"),
    )
    return matching.resolve_backend(clients, servers).select("o_orderkey", "port")


@query(
    "j8_first_by_source",
    """
    select n_nationkey, coalesce(
      (select min(c_name) from customer where c_nationkey = n_nationkey and c_acctbal > 9900),
      (select min(s_name) from supplier where s_nationkey = n_nationkey and s_acctbal > 5000),
      n_name) as value
    from nation
    """,
)
def j8(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))

    def source(df, key, rank, name, ok):
        value = F.when(ok, F.col(name)).otherwise("")
        return df.select(F.col(key).alias("n_nationkey"), F.struct(F.lit(rank), F.col(name)).alias("rank"), value.alias("value"))

    every = [
        source(c, "c_nationkey", 0, "c_name", F.col("c_acctbal") > 9900),
        source(s, "s_nationkey", 1, "s_name", F.col("s_acctbal") > 5000),
        source(n, "n_nationkey", 2, "n_name", F.lit(True)),
    ]
    rows = [e.select("n_nationkey", F.struct(F.col("rank.col1").alias("source"), F.col(f"rank.{nm}").alias("name")).alias("rank"), "value") for e, nm in zip(every, ("c_name", "s_name", "n_name"))]
    return matching.first_by_source(rows[0].unionByName(rows[1]).unionByName(rows[2]), ["n_nationkey"])


@query(
    "j9_set_path",
    """
    select c_custkey, name, value from (
      select c_custkey, unnest(['default.server', 'job.id', 'job.node', 'port']) as name,
        unnest([case when c_acctbal >= 0 then '"' || c_name || '"' else '"main"' end, case when c_acctbal >= 0 then cast(c_custkey as varchar) end,
          case when c_acctbal >= 0 then '"n' || c_nationkey || '"' end, '8000']) as value from customer
      union all select c_custkey, 'job', 'null' from customer where c_acctbal < 0
    ) where value is not null
    """,
)
def j9(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer"))

    def rows(df, *settings):
        items = F.array(*[F.struct(F.array(*[F.lit(x) for x in p]).alias("path"), v.alias("value")) for p, v in settings])
        return df.select("c_custkey", F.explode(items).alias("r")).select("c_custkey", "r.*")

    def quoted(col):
        return F.concat(F.lit('"'), col, F.lit('"'))

    base = rows(c, (["default", "server"], F.lit('"main"')), (["job"], F.lit("null")), (["port"], F.lit("8000")))
    # Where nothing was allocated, what is there is set once more.
    allocated = F.col("c_acctbal") >= 0
    changes = rows(
        c,
        (["default", "server"], F.when(allocated, quoted(F.col("c_name"))).otherwise('"main"')),
        (["job", "id"], F.when(allocated, F.col("c_custkey").cast("string"))),
        (["job", "node"], F.when(allocated, quoted(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))),
        (["job"], F.when(~allocated, F.lit("null"))),
    ).filter(F.col("value").isNotNull())
    return leaves.set_path(base, changes, ["c_custkey"]).select("c_custkey", leaves.leaf_name().alias("name"), "value")


def _named(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), "c_nationkey", F.lit("/"), "c_mktsegment").alias("key"), F.lit("customer").alias("origin")).distinct()
    s = table(spark, sf_dir, "supplier")
    s = s.select(F.concat(F.lit("nation"), "s_nationkey", F.lit("/"), F.when(F.col("s_acctbal") >= 0, "BUILDING").otherwise("NEW")).alias("key"), F.lit("supplier").alias("origin")).distinct()
    return c, s


_SQL_NAMED = """
c as (select distinct 'nation' || c_nationkey || '/' || c_mktsegment as key, 'customer' as origin from customer),
s as (select distinct 'nation' || s_nationkey || '/' || case when s_acctbal >= 0 then 'BUILDING' else 'NEW' end as key, 'supplier' as origin from supplier)
"""


@query(
    "j10_insert_absent",
    f"with {_SQL_NAMED} select * from c union all select * from s where key not in (select key from c)",
)
def j10(spark, sf_dir):
    existing, new = _named(spark, sf_dir)
    return matching.insert_absent(existing, new, "key")


@query(
    "j10_insert_overwrite",
    f"with {_SQL_NAMED} select * from s union all select * from c where key not in (select key from s)",
)
def j10_overwrite(spark, sf_dir):
    existing, new = _named(spark, sf_dir)
    return matching.insert_absent(existing, new, "key", overwrite=True)


SQL_FOLDED = """
last_stop as (select key, max(seq) as stop from changes where op = 'stop' group by key),
first_start as (
  select c.key, arg_min(c.pid, c.seq) as pid from changes c left join last_stop l on l.key = c.key
  where c.op = 'start' and (l.stop is null or c.seq > l.stop) group by c.key
)
"""


@query(
    "j6_fold_changes",
    f"""
    with {shapes.SQL_STATE}, {shapes.SQL_CHANGES}, {SQL_FOLDED}
    select coalesce(s.key, f.key) as key, coalesce(s.pid, f.pid) as pid
    from (select * from state where key not in (select key from last_stop)) s full join first_start f on f.key = s.key
    """,
)
def fold(spark, sf_dir):
    return state.fold_changes(shapes.state(spark, sf_dir), shapes.changes(table(spark, sf_dir, "events")))


@query(
    "j10_start_outcomes",
    f"""
    with {shapes.SQL_STATE}, {shapes.SQL_CHANGES},
    walked as (select *, lag(op) over (partition by key order by seq) as before from changes),
    judged as (
      select w.key, w.seq, w.pid, case when before is null then s.key is not null else before = 'start' end as held
      from walked w left join state s on s.key = w.key where w.op = 'start'
    )
    select key, seq, not held as started, case when held then 'Tunnel already active' else cast(pid as varchar) end as detail
    from judged
    """,
)
def outcomes(spark, sf_dir):
    calm = shapes.changes(table(spark, sf_dir, "events"))
    return state.start_outcomes(shapes.state(spark, sf_dir), calm, fv.ALREADY_ACTIVE)


@query(
    "l2_default_host",
    """
    with servers as (
      select c_nationkey, c_custkey as ord, c_name as server, 'host' || c_custkey as host,
        case when n_regionkey = 0 then 'Customer#' || lpad(cast(n_nationkey as varchar), 9, '0')
          when n_regionkey < 3 then (select max(c_name) from customer i where i.c_nationkey = n_nationkey) else '' end as default_server
      from customer join nation on n_nationkey = c_nationkey
    )
    select c_nationkey, case when max(default_server) = '' then arg_min(host, ord) else arg_min(host, ord) filter (where server = default_server) end as host
    from servers group by c_nationkey
    """,
)
def l2_default(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    last = c.groupBy("c_nationkey").agg(F.max("c_name").alias("last"))
    guess = F.concat(F.lit("Customer#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0"))
    region = F.col("n_regionkey")
    default = F.when(region == 0, guess).when(region < 3, F.col("last")).otherwise("")
    servers = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(last, "c_nationkey")
    servers = servers.select(
        "c_nationkey",
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("server"),
        F.concat(F.lit("host"), F.col("c_custkey").cast("string")).alias("host"),
        default.alias("default_server"),
    )
    return matching.default_host(servers, ["c_nationkey"])
