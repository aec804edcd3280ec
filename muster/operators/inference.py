"""Batch inference: requests, answers that a service left in a table, and a caller's own scorer."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster import fixed_values as fv
from muster.functions.common import lookup_join
from muster.functions.payloads import chat_content, conversation_payload
from muster.operators.ordered import running_total

Scorer = Callable[[list[str]], list[str]]


def in_time(scorer: Scorer, seconds: float | None) -> Scorer:
    """The scorer, given up after ``seconds``. A call that hangs is left behind in a thread of its own."""
    if seconds is None:
        return scorer

    def call(prompts):
        box = {}

        def work():
            try:
                box["answers"] = scorer(prompts)
            except Exception as e:
                box["error"] = e

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            raise TimeoutError(f"no answer within {seconds:g} seconds")
        if "error" in box:
            raise box["error"]
        return box["answers"]

    return call


def _score_one(scorer: Scorer, prompt: str):
    try:
        return scorer([prompt])[0], None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def _score_batch(scorer: Scorer, prompts: list[str]):
    """Answers and errors of one batch; a failing batch is asked again prompt by prompt."""
    try:
        answers = list(scorer(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
        return [(a, None) for a in answers]
    except Exception:
        return [_score_one(scorer, p) for p in prompts]


def batch_prompt(df: DataFrame, prompt: str, scorer: Scorer, batch: int = 64, seconds: float | None = 60.0) -> DataFrame:
    """Add ``content`` and ``error``. A prompt that fails is a row with an error, never a failed job.

    A call that takes longer than ``seconds`` counts as failed. Other columns pass through as
    Arrow data, so their types and values stay as they are.
    """
    keep = [c for c in df.columns if c not in (prompt, "content", "error")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = (fields + ", " if fields else "") + "content string, error string"
    limited = in_time(scorer, seconds)

    def score(batches):
        for rows in batches:
            texts = ["" if p is None else p for p in rows.column(prompt).to_pylist()]
            scored = []
            for at in range(0, len(texts), batch):
                scored += _score_batch(limited, texts[at : at + batch])
            added = [pa.array([pair[i] for pair in scored], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *added], names=[*keep, "content", "error"])

    return df.mapInArrow(score, schema)


def read_answers(requests: DataFrame, answers: DataFrame, keys: list[str], seconds: float = 60.0) -> DataFrame:
    """``requests`` with ``content`` and ``error``, from the answers that a service stored for them.

    ``answers`` has the ``keys`` and ``status``, ``body`` and ``seconds``: the HTTP status, the answer's
    JSON, and how long it took. Every request stays one row: with the text of its answer, or
    with the reason why there is none. A null status or time counts as no answer. Of several answers
    to one request, one with a text is taken before one without, then the quickest, then the
    smallest text, so retries do no harm. Columns of these names in ``requests`` are replaced;
    a null key is a key. Answers are reduced to one per key before they meet the requests, and
    a key with many requests is split.
    """
    text = chat_content("body", None)
    error = (
        F.when(F.col("status").isNull() | F.col("seconds").isNull(), F.lit("no answer"))
        .when(F.col("seconds") > seconds, F.lit(f"no answer within {seconds:g} seconds"))
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(text.isNull(), F.lit("no content found in response"))
    )
    judged = answers.select(*keys, "seconds", text.alias("_text"), error.alias("_error"))
    outcome = F.struct(F.col("_error").isNotNull().alias("failed"), "seconds", F.when(F.col("_error").isNull(), F.col("_text")).alias("content"), F.col("_error").alias("error"))
    best = judged.groupBy(*keys).agg(F.min(outcome).alias("_answer"))
    found = lookup_join(requests.drop("content", "error"), best, keys)
    missing = F.when(F.col("_answer").isNull(), F.lit("no answer"))
    return found.withColumns({"content": F.col("_answer.content"), "error": F.coalesce(missing, F.col("_answer.error"))}).drop("_answer")


def conversation_requests(turns: DataFrame, keys: list[str], turn: str, role: str, content: str, max_chars: int = 32_000, model: str = fv.DEFAULT_MODEL, temperature: float = fv.DEFAULT_TEMPERATURE, turns_per_bucket: int = 50_000) -> DataFrame:
    """``keys, part, first_turn, last_turn, n_turns, request``: chat requests with the turns of a conversation in order.

    A conversation is cut by its running length: a request holds the turns that begin within
    the same ``max_chars`` characters, so it is longer than that by at most its last turn, and the
    next one continues it. A turn counts as its text and one character more. ``part`` ascends
    from 0; a turn longer than ``max_chars`` leaves a gap behind it. Turns of the same number go by
    role and text; a null number comes first and a null role or text is an empty one. No turn is left out.

    ``turn`` is a whole number. Lengths are added up in buckets of ``turns_per_bucket`` numbers, so a
    conversation of any length is worked on by many tasks.
    """
    rows = turns.select(
        *keys,
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"),
    )
    bucket = F.coalesce(F.floor(F.col("_turn") / turns_per_bucket), F.lit(-(1 << 62)))
    placed = running_total(rows, keys, bucket, ["_turn", "role", "content"], F.length("content").cast("bigint") + 1, "_before")
    placed = placed.select(*keys, F.floor(F.col("_before") / max_chars).alias("part"), F.struct("_turn", "role", "content").alias("_said"))
    held = placed.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("_said")).alias("_said"))
    messages = F.transform("_said", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return held.select(
        *keys,
        "part",
        F.get("_said._turn", F.lit(0)).alias("first_turn"),
        F.element_at("_said._turn", -1).alias("last_turn"),
        F.size("_said").alias("n_turns"),
        conversation_payload(messages, model, temperature).alias("request"),
    )
