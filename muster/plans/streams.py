"""Queries that run a stream over the given tables, and batch inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster.functions import payloads
from muster.functions.text import first_node
from muster.operators import aggregates, inference
from muster.plans import shapes
from muster.plans.registry import query, table
from muster.plans.reports import SQL_ALLOCATED, SQL_READY
from muster.plans.joins import SQL_FOLDED
from muster.session import shared_folder
from muster.sources import logs
from muster.streaming import lines, phases, polls, runs, state

# Longer than the events table, so that no timer cuts a key short.
_WHOLE = 400 * 24 * 3600.0


def stream_table(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream. A path pattern, unlike a plain path, may name one file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.[p]arquet")


@query(
    "t1_await_allocation",
    f"""
    with {shapes.SQL_POLLS}, {SQL_ALLOCATED}
    select cast(user_id as varchar) as key, status, poll, node, ts from outcome where status <> 'pending'
    """,
)
def t1(spark, sf_dir):
    rows = shapes.polls(stream_table(spark, sf_dir, "events"))
    found = polls.await_allocation(rows, "user_id", "ts", "event_id", first_node("nodes"), seconds=_WHOLE)
    out = runs.run_to_table(found, shared_folder(spark, "allocation"))
    return out.select("key", "status", "poll", F.col("payload").alias("node"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "t2_await_ready",
    f"""
    with {shapes.SQL_POLLS}, {SQL_READY}
    select cast(user_id as varchar) as key, status, poll, ts from outcome where status <> 'pending'
    """,
)
def t2(spark, sf_dir):
    rows = shapes.polls(stream_table(spark, sf_dir, "events"))
    found = polls.await_ready(rows, "user_id", "ts", "event_id", aggregates.is_ready(), seconds=_WHOLE)
    out = runs.run_to_table(found, shared_folder(spark, "ready"))
    return out.select("key", "status", "poll", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "t3_follow_matches",
    """
    select line, count(*) as seen from (select unnest(string_split(text, chr(10))) as line from documents)
    where regexp_matches(line, 'license|@') group by line
    """,
)
def t3(spark, sf_dir):
    folder = shared_folder(spark, "matches")
    text = logs.text_to_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    text.select(F.col("line").alias("value")).write.text(f"{folder}/logs", lineSep="\n")
    found = lines.follow_matches(logs.stream_lines(spark, f"{folder}/logs"), ("license", "@")).select("line")
    return runs.run_to_table(found, folder).groupBy("line").agg(F.count(F.lit(1)).alias("seen"))


@query("t4_upsert_state", f"with {shapes.SQL_CHANGES}, {SQL_FOLDED} select key, pid from first_start")
def t4(spark, sf_dir):
    folder = shared_folder(spark, "upsert")
    rows = shapes.changes(stream_table(spark, sf_dir, "events"))
    runs.finish(state.upsert_state(rows, f"{folder}/state", f"{folder}/checkpoint"))
    return state.current_state(spark, f"{folder}/state")


@query("t5_phase_stream", f"with {shapes.SQL_SPANS} select run, phase, started, stopped, seconds from timed where started is not null or stopped is not null")
def t5(spark, sf_dir):
    rows = shapes.edges(stream_table(spark, sf_dir, "events"))
    folder = shared_folder(spark, "phases")
    spans = phases.phase_stream(rows, "run", "phase", "edge", "ts")
    runs.finish(phases.store_changes(spans, f"{folder}/out", f"{folder}/checkpoint"))
    spans = phases.current_spans(spark, f"{folder}/out")
    return spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "stopped")})


_SQL_LATE = """
edges as (
  select event_id, cast(user_id as varchar) as run, strftime(ts, '%Y-%m-%d') as phase, ts,
    case when event_type in ('signup', 'click') then 'start' when event_type in ('purchase', 'view') then 'stop' end as edge
  from events
),
mark as (select max(ts) - interval 10 day as mark from edges where event_id % 3 <> 0 and edge is not null),
judged as (select *, event_id % 3 = 0 and ts < mark as late from edges, mark where edge is not null)
"""


def _two_batches(spark, sf_dir):
    """A third of the events comes in a second batch; the folder of the run."""
    folder = shared_folder(spark, "late-phases")
    events = table(spark, sf_dir, "events")
    second = F.col("event_id") % 3 == 0
    for mode, rows in (("errorifexists", events.filter(~second)), ("append", events.filter(second))):
        rows.write.mode(mode).parquet(f"{folder}/in")
        stream = shapes.edges(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
        runs.finish(phases.follow_phases(stream, "run", "phase", "edge", "ts", f"{folder}/out", f"{folder}/checkpoint", delay="10 days"))
    return f"{folder}/out"


@query("t5_late_edges", f"with {_SQL_LATE} select run, phase, edge, ts from judged where late")
def t5_late(spark, sf_dir):
    late = phases.late_edges(spark, _two_batches(spark, sf_dir))
    return late.select("run", "phase", "edge", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "t5_phases_on_time",
    f"""
    with {_SQL_LATE},
    spans as (select run, phase, min(ts) filter (where edge = 'start') as started, max(ts) filter (where edge = 'stop') as stopped
      from judged where not late group by run, phase)
    select run, phase, started, stopped, case when stopped >= started then (epoch_us(stopped) - epoch_us(started)) / 1000000.0 end as seconds from spans
    """,
)
def t5_on_time(spark, sf_dir):
    spans = phases.current_spans(spark, _two_batches(spark, sf_dir) + "/spans")
    return spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "stopped")})


@query(
    "f18_conversation_requests",
    """
    with placed as (
      select conv_id, turn, role, text,
        coalesce(sum(length(text) + 1) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as before
      from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)
    )
    select conv_id, cast(before // 1500 as bigint) as part, min(turn) as first_turn, max(turn) as last_turn, cast(count(*) as integer) as n_turns,
      '{"model":"google/gemma-4-31B-it","messages":[' || string_agg('{"role":' || cast(to_json(role) as varchar) || ',"content":' || cast(to_json(text) as varchar) || '}', ',' order by turn, role, text)
        || '],"temperature":0.7}' as request
    from placed group by conv_id, before // 1500
    """,
)
def f18_requests(spark, sf_dir):
    """Whole conversations as requests; long ones go on in further requests."""
    return inference.conversation_requests(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text", max_chars=1500)


def _stored_answers(spark, sf_dir) -> DataFrame:
    """The assistant's turns as answers to the turns before them; long ones took long, and late turns met a busy service."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    choice = F.struct(payloads.message("role", "text").alias("message"))
    return said.select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.when(F.col("turn") >= 7, 503).otherwise(200).alias("status"),
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("body"),
        (F.length("text") / 4).alias("seconds"),
    )


def _requests(spark, sf_dir) -> DataFrame:
    """A request for every turn that is not the assistant's."""
    asked = table(spark, sf_dir, "conversations").filter("role is distinct from 'assistant'")
    return asked.select("conv_id", "turn", payloads.chat_payload("text").alias("request"))


_SQL_ANSWERED = """
asked as (select conv_id, turn, text from conversations where role is distinct from 'assistant'),
said as (select conv_id, turn - 1 as turn, text as answer, case when turn >= 7 then 503 else 200 end as status, length(text) / 4.0 as seconds from conversations where role = 'assistant'),
answered as (
  select conv_id, turn, text, case when seconds <= 60 and status = 200 then answer end as content,
    case when seconds is null then 'no answer' when seconds > 60 then 'no answer within 60 seconds'
      when status <> 200 then 'HTTP ' || status when answer is null then 'no content found in response' end as error
  from asked left join said using (conv_id, turn)
)
"""


@query("u1_batch_prompt", f"with {_SQL_ANSWERED} select conv_id, turn, content, error from answered")
def u1(spark, sf_dir):
    return inference.read_answers(_requests(spark, sf_dir), _stored_answers(spark, sf_dir), ["conv_id", "turn"]).drop("request")


@query(
    "flow_prompts",
    f"""
    with {_SQL_ANSWERED}
    select error, cast(count(*) as bigint) as requests, cast(sum(length(content)) as bigint) as answered_chars,
      cast(sum(length('{{"model":"google/gemma-4-31B-it","messages":[{{"role":"user","content":' || cast(to_json(text) as varchar) || '}}],"temperature":0.7}}')) as bigint) as request_chars
    from answered group by error
    """,
)
def prompts_flow(spark, sf_dir):
    """Prompt, request, stored answer, text of the answer, and a report of what went wrong how often."""
    answered = inference.read_answers(_requests(spark, sf_dir), _stored_answers(spark, sf_dir), ["conv_id", "turn"])
    return answered.groupBy("error").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.length("content").cast("long")).alias("answered_chars"),
        F.sum(F.length("request").cast("long")).alias("request_chars"),
    )
