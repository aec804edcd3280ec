"""Ordered operators, reports and batch inference."""

import random

import pytest
from pyspark.sql import functions as F

from muster.functions.text import first_node
from muster.operators import aggregates, inference, ordered

POLL = "k string, ts int, id int, v string"


def sample(n=400, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", None]
    return [(rng.choice(keys), rng.randrange(40), i, rng.choice(["x", None, None])) for i in range(n)]


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_tail(spark, rows):
    data = sample()
    df = spark.createDataFrame(data, POLL)
    tail = ordered.tail_per_key(df, ["k"], ["ts", "id"], 7)
    assert rows(tail) == sorted([r for v in by_key(data).values() for r in v[-7:]], key=repr)
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()


def test_tail_longer_than_the_cut(spark, rows, settings):
    settings(spark__sql__optimizer__windowGroupLimitThreshold="5")
    data = sample(500, 9)
    tail = ordered.tail_per_key(spark.createDataFrame(data, POLL).repartition(6), ["k"], ["ts", "id"], 40)
    assert rows(tail) == sorted([r for v in by_key(data).values() for r in v[-40:]], key=repr)


@pytest.mark.parametrize("salts", [1, 7])
def test_five_thousand_of_a_hot_key(spark, monkeypatch, salts):
    monkeypatch.setattr(ordered, "SALTS", salts)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"), F.floor(F.col("id") / 7).alias("ts"), "id")
    tail = ordered.tail_per_key(df.repartition(9), ["k"], ["ts", "id"], 5000)
    assert tail.columns == ["k", "ts", "id"]
    assert sorted(r["id"] for r in tail.filter("k = 'hot'").collect()) == [i for i in range(20_000) if i % 3 == 0][-5000:]
    assert tail.count() == 5000 + 20_000 - 6667
    first = ordered.first_rows(df, ["k"], [F.col("id").asc()], 5000, "place").filter("k = 'hot'").agg(F.max("place"), F.max("id")).first()
    assert tuple(first) == (5000, 14997)


def test_a_long_tail_stores_nothing(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)
    assert ordered.tail_per_key(spark.range(10).withColumn("k", F.lit(1)), ["k"], ["id"], 100_000).count() == 10


def test_logs_of_services_without_a_file(spark, rows):
    services = spark.createDataFrame([("a", "f"), ("b", None), ("c", ""), ("d", "f"), ("e", "empty"), (None, None)], "server string, log_file string")
    lines = spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 6)] + [("other", 1, "x"), (None, 1, "y"), ("", 1, "z")], "log_file string, line_no int, line string")
    got = rows(ordered.tail_of_logs(services, lines, ["server"], "log_file", ["line_no"], "line", 2))
    said = "No log file configured."
    assert got == sorted([("a", 4, "line 4"), ("a", 5, "line 5"), ("d", 4, "line 4"), ("d", 5, "line 5"), ("b", None, said), ("c", None, said), (None, None, said)], key=repr)


def test_number_rows_with_a_hot_key_and_ties(spark, settings):
    settings(spark__sql__shuffle__partitions="7")
    data = sample(600, 2)
    df = spark.createDataFrame(data, POLL).repartition(5)
    got = {(r["k"], r["id"]): r["n"] for r in ordered.number_rows(df, ["k"], ["ts", "id"]).collect()}
    assert got == {(k, r[2]): i + 1 for k, v in by_key(data).items() for i, r in enumerate(v)}


def test_ranges_follow_the_order_and_are_even(spark, rows):
    """Every kind of column, nulls and empty texts included; the range is a constant expression of the row."""
    rng = random.Random(8)
    data = [(rng.choice([None, "", "a", "b" * 3000]), rng.choice([None, rng.random(), float("nan")]), rng.choice([None, b"", b"x\x00"]), i) for i in range(800)]
    df = spark.createDataFrame(data, "s string, d double, b binary, i int")
    df = df.withColumn("t", F.timestamp_micros(F.col("i") * 7919 % 1000)).withColumn("m", F.col("d").cast("decimal(12,3)"))
    for cols in (["s", "d", "b", "i"], ["t", "i"], ["m", "s", "t", "b", "i"], ["b"], ["i", "s"]):
        ranged = df.withColumn("r", ordered.range_of(df, cols, 10))
        assert "Exchange" not in ranged._jdf.queryExecution().optimizedPlan().toString()
        in_order = [r["r"] for r in ranged.orderBy(*cols).collect()]
        assert in_order == sorted(in_order) and max(in_order) < 10
        if "i" in cols:
            assert max(in_order.count(r) for r in set(in_order)) < 300
    assert rows(df.limit(0).select(ordered.range_of(df.limit(0), ["s"]))) == []
    assert rows(ordered.number_rows(df.limit(0), ["s"], ["i"])) == []


def test_numbering_stores_nothing(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)
    df = spark.createDataFrame(sample(200, 6), POLL)
    numbered = ordered.number_rows(df, ["k"], ["ts", "id"])
    assert numbered.count() == 200
    assert "RepartitionByExpression" not in numbered._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("per_part", [1, 7, 1000])
def test_equal_names_reach_over_many_parts(spark, per_part):
    rng = random.Random(per_part)
    data = [(rng.choice(["hot", "hot", "g", None]), rng.choice(["same", "same", "same", "", "z", None, f"n{rng.random()}"])) for _ in range(500)]
    groups = [("hot",), ("g",), (None,), ("empty",)]
    names = spark.createDataFrame(data, "g string, name string").repartition(5)
    out = aggregates.concat_names(spark.createDataFrame(groups, "g string"), names, ["g"], "name", names_per_part=per_part)
    want = {}
    for (g,) in groups:
        listed = sorted(n for k, n in data if k == g and n is not None)
        for at in range(0, max(len(listed), 1), per_part):
            want[g, at // per_part] = ", ".join(listed[at : at + per_part]) if listed else "None"
    assert {(r["g"], r["part"]): r["names"] for r in out.collect()} == want


def test_sample_every(spark):
    data = sample(300, 3)
    got = {r["id"] for r in ordered.sample_every(spark.createDataFrame(data, POLL), ["k"], ["ts", "id"], 10).collect()}
    assert got == {r[2] for v in by_key(data).values() for r in v[::10]}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_fill_forward(spark, size):
    data = [(k, None, i, v) for i, (k, _, _, v) in enumerate(sample(300, 4))]
    df = spark.createDataFrame(data, POLL)
    got = {r["id"]: r["f"] for r in ordered.fill_forward(df, ["k"], F.floor(F.col("id") / size), "id", F.concat("v", "id"), "f").collect()}
    want, last = {}, {}
    for k, _, i, v in data:
        last[k] = f"x{i}" if v else last.get(k)
        want[i] = last[k]
    assert got == want


@pytest.mark.parametrize("together", [1, 2, 5])
def test_carry_in_two_levels(spark, monkeypatch, together):
    """Few values far apart, so that most are carried over whole blocks of buckets without one."""
    monkeypatch.setattr(ordered, "BUCKETS_TOGETHER", together)
    rng = random.Random(together)
    data = [(rng.choice(["hot", "hot", None]), None, i, "x" if rng.random() < 0.02 else None) for i in range(600)]
    filled = ordered.fill_forward(spark.createDataFrame(data, POLL), ["k"], F.floor(F.col("id") / 3), "id", F.concat("v", "id"), "f")
    want, last = {}, {}
    for k, _, i, v in data:
        last[k] = f"x{i}" if v else last.get(k)
        want[i] = last[k]
    assert {r["id"]: r["f"] for r in filled.collect()} == want
    numbered = ordered.number_rows(spark.createDataFrame(data, POLL).repartition(5), ["k"], ["id"])
    places = {}
    for k, _, i, _ in data:
        places.setdefault(k, []).append(i)
    assert {r["id"]: r["n"] for r in numbered.collect()} == {i: n for v in places.values() for n, i in enumerate(v, 1)}


def test_no_task_scans_all_buckets_of_a_file(spark):
    lines = spark.range(10).select(F.lit("f").alias("file"), "id", F.lit(None).cast("string").alias("v"))
    plan = ordered.fill_forward(lines, ["file"], F.col("id"), "id", F.col("v"), "s")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3 and sum("_block" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in windows) == 2


def test_first_match_and_item(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", 5, "z")], "k string, ord int, v string")
    assert rows(ordered.first_match(df, ["k"], "ord", F.col("v") != "z")) == [("a", 1, "y")]
    assert rows(ordered.first_item(df, "ord")) == [("a", 0, "z")]


def test_first_allocated(spark, rows):
    data = [("j", 1, " "), ("j", 2, "NLIST"), ("j", 3, "n1,n2"), ("j", 4, "n3"), ("k", 1, "")]
    df = spark.createDataFrame(data, "job string, i int, nodes string")
    assert rows(ordered.first_allocated(df, ["job"], ["i"], first_node("nodes"))) == [("j", "n1", 3), ("k", None, None)]


def polls(spark, *flags):
    data = [(name, i, ok) for name, oks in flags for i, ok in enumerate(oks)]
    return spark.createDataFrame(data, "server string, i int, ok boolean")


def test_sixty_polls_and_not_one_more(spark, rows):
    no = [False]
    df = polls(spark, ("at5", no * 4 + [True]), ("at60", no * 59 + [True]), ("at61", no * 60 + [True]), ("never", no * 60), ("few", no * 3))
    got = {r["server"]: (r["status"], r["poll"]) for r in aggregates.time_to_ready(df, ["server"], ["i"], F.col("ok")).collect()}
    assert got == {"at5": ("ready", 5), "at60": ("ready", 60), "at61": ("failed", None), "never": ("failed", None), "few": ("pending", None)}


def test_readiness_needs_the_port(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, True), (False, True, True), (True, False, False)], "port_open boolean, health boolean, log_hit boolean")
    assert [r[0] for r in df.select(aggregates.is_ready()).collect()] == [True, True, False, False]


def test_log_ready(spark, rows):
    data = [("a", "x"), ("a", "INFO Application startup complete."), ("b", None), ("b", "vLLM is up and running on 0.0.0.0"), ("c", "no"), ("d", None)]
    df = spark.createDataFrame(data, "job string, line string")
    assert rows(aggregates.log_ready(df, ["job"])) == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_phases(spark, rows):
    data = [("r", "vpn", "start", 1.0), ("r", "vpn", "stop", 3.5), ("r", "launch", "start", 4.0), ("r", "late", "stop", 2.0)]
    df = spark.createDataFrame(data, "run string, phase string, edge string, t double").withColumn("ts", F.timestamp_seconds("t"))
    spans = aggregates.phase_durations(df, ["run", "phase"])
    assert rows(spans.select("phase", "seconds")) == [("late", None), ("launch", None), ("vpn", 2.5)]
    report = {r["phase"]: (r["closed"], r["open"], r["avg_seconds"]) for r in aggregates.phase_report(spans).collect()}
    assert report == {"vpn": (1, 0, 2.5), "launch": (0, 1, None), "late": (0, 1, None)}


def test_names_of_empty_groups(spark, rows):
    groups = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    names = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None), (None, "n")], "g string, name string")
    assert rows(aggregates.concat_names(groups, names, ["g"], "name")) == [("a", 0, "x, y"), ("b", 0, "None"), (None, 0, "n")]


def test_check_summary(spark, rows):
    data = [("s", "health", "FAIL (503)", 1), ("s", "health", "OK", 2), ("s", "query", "hi", 1), ("t", "other", "x", 1)]
    df = spark.createDataFrame(data, "server string, chk string, result string, i int")
    assert rows(aggregates.check_summary(df, ["server"], "chk", "result", ["i"])) == [("s", "OK", "Not tested", "hi"), ("t", "Not tested", "Not tested", "Not tested")]


def test_batch_prompt_keeps_failures_as_rows(spark, rows):
    def scorer(prompts):
        if "bad" in prompts:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "b"), (4, None)], "id int, prompt string").coalesce(1)
    for batch in (1, 2, 64):
        got = rows(inference.batch_prompt(df, "prompt", scorer, batch))
        assert got == [(1, "A", None), (2, None, "RuntimeError: no answer"), (3, "B", None), (4, "", None)]


def test_short_answers_are_not_misplaced(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string").coalesce(1)
    got = rows(inference.batch_prompt(df, "prompt", lambda p: p[:1], 2))
    assert got == [(1, "a", None), (2, "b", None)]


def test_batch_prompt_keeps_values_and_gives_up_in_time(spark):
    import time

    def slow(prompts):
        if "hang" in prompts:
            time.sleep(30)
        return list(prompts)

    big = 9007199254740993
    df = spark.createDataFrame([(big, "a"), (None, "hang"), (big + 2, None)], "id bigint, prompt string")
    start = time.time()
    got = inference.batch_prompt(df.coalesce(1), "prompt", slow, 1, seconds=0.5).collect()
    assert time.time() - start < 25
    assert [r["id"] for r in got] == [big, None, big + 2] and [r["content"] for r in got] == ["a", None, ""]
    assert got[1]["error"].startswith("TimeoutError")


def test_stored_answers(spark, rows):
    """Every request is one row, with its text or the reason; retries, repeated requests and null keys included."""
    def body(text):
        return '{"choices":[{"message":{"role":"assistant","content":"' + text + '"}}]}'

    answers = [
        (1, 503, "busy", 1.0), (1, 200, body("second"), 9.0), (1, 200, body("first"), 8.0), (1, 200, body("a tie"), 8.0),
        (2, 200, body("slow"), 60.5), (3, 200, body("just"), 60.0), (4, 500, "oops", 2.0), (5, 200, "{}", 2.0), (6, 200, "not json", 2.0),
        (7, None, None, None), (None, 200, body("null"), 1.0), (9, 200, body(""), 0.0), (10, 429, None, 3.0), (10, 500, None, 2.0), (99, 200, body("x"), 1.0),
    ]
    given = spark.createDataFrame(answers, "id int, status int, body string, seconds double")
    asked = spark.createDataFrame([(i, "old") for i in (1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)], "id int, content string").withColumn("status", F.lit("kept"))
    want = {
        1: ("a tie", None), 2: (None, "no answer within 60 seconds"), 3: ("just", None), 4: (None, "HTTP 500"), 5: (None, "no content found in response"),
        6: (None, "no content found in response"), 7: (None, "no answer"), 8: (None, "no answer"), None: ("null", None), 9: ("", None), 10: (None, "HTTP 500"),
    }
    got = inference.read_answers(asked, given, ["id"]).select("id", "content", "error", "status").collect()
    assert len(got) == 12 and {r["id"]: (r["content"], r["error"]) for r in got} == want and {r["status"] for r in got} == {"kept"}
    assert inference.read_answers(asked.limit(0), given, ["id"]).count() == 0
    assert {r["error"] for r in inference.read_answers(asked, given.limit(0), ["id"]).collect()} == {"no answer"}


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS_TOGETHER", 3)
    data = [(k, 0, i, None) for i, (k, _, _, _) in enumerate(sample(400, 6))]
    df = spark.createDataFrame(data, POLL).repartition(7)
    total = ordered.running_total(df, ["k"], F.floor(F.col("id") / 5), ["id"], F.col("id").cast("bigint"), "total")
    want, sums = {}, {}
    for k, _, i, _ in data:
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + i
    assert {r["id"]: r["total"] for r in total.collect()} == want


@pytest.mark.parametrize("bucket", [2, 1000])
def test_requests_hold_every_turn_once(spark, bucket):
    import json

    rng = random.Random(bucket)
    turns = [(c, i, rng.choice(["user", "assistant"]), "w" * rng.choice([0, 3, 9, 40, 200])) for c in range(8) for i in range(rng.randrange(0, 30))]
    turns += [(99, i, "user", None) for i in range(50)] + [(None, None, None, "x"), (None, 1, "user", 'q"\n'), (7, 5, "user", "same"), (7, 5, "user", "same")]
    df = spark.createDataFrame(turns, "conv int, turn int, role string, content string").withColumns({"part": F.lit("p"), "request": F.lit(1)})
    got = inference.conversation_requests(df.repartition(5), ["conv"], "turn", "role", "content", 50, turns_per_bucket=bucket).collect()
    by = {}
    for r in got:
        by.setdefault(r["conv"], []).append(r)
    for conv in {t[0] for t in turns}:
        want = sorted([(t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        parts = sorted(by.pop(conv), key=lambda r: r["part"])
        sent = [m for r in parts for m in json.loads(r["request"])["messages"]]
        assert [(m["role"], m["content"]) for m in sent] == [w[2:] for w in want]
        assert parts[0]["part"] == 0 and sum(r["n_turns"] for r in parts) == len(want)
        for r in parts:
            said = [len(m["content"]) + 1 for m in json.loads(r["request"])["messages"]]
            assert sum(said[:-1]) <= 50
    assert not by
