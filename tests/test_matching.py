"""Job matching, pattern search, references, keyed state and backends."""

import random

import pytest
from pyspark.sql import functions as F

from muster.operators import matching, refs, state
from muster.operators.predicates import absent_fields, filter_members, in_range, probe_status, route, platform, split_range, unset_fields

JOB = "job_id string, name string"
REG = "ord int, server string, job_id string, job_name string, remote_port int"


def test_first_registry_entry_wins(spark, rows):
    jobs = spark.createDataFrame([("123", "svc_a"), ("456", "other"), ("7", None), (None, "svc_a")], JOB)
    reg = spark.createDataFrame(
        [(2, "by_id", "123", None, 1), (1, "by_name", None, "svc_a", None), (3, "late", "123", "svc_a", 3), (4, "no_job", None, None, 4)], REG
    )
    assert rows(matching.match_jobs(jobs, reg)) == [
        ("123", "svc_a", "by_name", "8000"),
        ("456", "other", "Unknown", "Unknown"),
        ("7", None, "Unknown", "Unknown"),
        (None, "svc_a", "by_name", "8000"),
    ]


def test_empty_job_ids_do_not_match(spark, rows):
    jobs = spark.createDataFrame([("", "x")], JOB)
    reg = spark.createDataFrame([(1, "s", "", "", 1)], REG)
    assert rows(matching.match_jobs(jobs, reg)) == [("", "x", "Unknown", "Unknown")]


def test_match_has_no_nested_loop(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    jobs = spark.range(1000).select(F.col("id").cast("string").alias("job_id"), F.concat(F.lit("n"), "id").alias("name"))
    reg = spark.range(100).select(F.col("id").alias("ord"), F.lit("s").alias("server"), F.col("id").alias("job_id"), F.concat(F.lit("n"), "id").alias("job_name"), F.lit(1).alias("remote_port"))
    plan = matching.match_jobs(jobs, reg)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_pairs(names, needles):
    return sorted((a, b) for a in set(names) for b in set(needles) if b in a)


@pytest.mark.parametrize("seed", [1, 2])
def test_contains_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("ab_1é") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    needles = ["".join(rng.choice("ab_1é") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["zz", "a"]
    a = spark.createDataFrame([(x,) for x in sorted(set(names))], "name string")
    b = spark.createDataFrame([(x,) for x in sorted(set(needles))], "needle string")
    got = sorted(tuple(r) for r in matching.contains_pairs(a, b).collect())
    assert got == brute_pairs(names, needles)


def test_pattern_then_name_then_stored(spark, rows):
    jobs = spark.createDataFrame([("1", "svc_a_8000"), ("2", "svc_a_9000"), ("3", "x_svc_a"), ("4", "other"), ("5", "")], JOB)
    req = spark.createDataFrame(
        [
            (1, "9000", None, None),
            (2, None, "svc_a", None),
            (3, "9000", "svc_a", "4"),
            (4, None, "svc_a", "4"),
            (5, None, "svc_a", "77"),
            (6, "", "", ""),
        ],
        "req_id int, pattern string, job_name string, stored_job_id string",
    )
    got = [(r["req_id"], r["job_id"], r["rule"]) for r in matching.match_jobs_by_pattern(jobs, req).collect()]
    name = [("1", "name"), ("2", "name"), ("3", "name")]
    want = [(1, "2", "pattern")] + [(2, *x) for x in name]
    want += [(3, "1", "name"), (3, "2", "pattern"), (3, "3", "name"), (4, "4", "stored")] + [(5, *x) for x in name]
    assert sorted(got) == sorted(want)


SECTION = "file string, section string, attr string, value string, line_no int"


def test_references(spark):
    sections = spark.createDataFrame(
        [("~/c", "h", "User", "bob", 2), ("~/c", "h", "user", "late", 9), ("~/c", "g", "user", "$1\\x", 4), ("~/c", None, "port", "22", 1), ("~/c", "h", "port", "23", 3)],
        SECTION,
    )
    texts = ["{~/c:H.user}@{~/c:g.User} {~/c:h.none} {user} {a:b}", "{~/c:port} {~/c:h.port} {~/d:h.user}", "plain", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r["t"] for r in refs.resolve_refs(df, "t", sections).orderBy("id").collect()]
    assert got == ["bob@$1\\x {~/c:h.none} {user} {a:b}", "22 23 {~/d:h.user}", "plain", None, ""]


STATE = "key string, pid bigint"
CHANGE = "key string, op string, pid bigint, seq bigint"


def replay(entries, changes):
    state_ = dict(entries)
    for key, op, pid, _ in sorted(changes, key=lambda c: c[3]):
        if op == "start":
            state_.setdefault(key, pid)
        else:
            state_.pop(key, None)
    return sorted(state_.items())


def test_fold_changes_equals_replay(spark, rows):
    rng = random.Random(3)
    for _ in range(6):
        entries = [(f"h{i}", i) for i in range(8) if rng.random() < 0.5]
        changes = [(f"h{rng.randrange(10)}", rng.choice(["start", "stop"]), 100 + i, i) for i in range(25)]
        got = rows(state.fold_changes(spark.createDataFrame(entries, STATE), spark.createDataFrame(changes, CHANGE)))
        assert got == replay(entries, changes)


def test_delete_and_keep(spark, rows):
    entries = spark.createDataFrame([("a", 1), ("b", 2)], STATE)
    rest, outcome = matching.delete_keys(entries, spark.createDataFrame([("a",), ("z",), ("a",)], "key string"))
    assert rows(rest) == [("b", 2)]
    assert rows(outcome) == [("a", True, "1"), ("z", False, "No active tunnel found for this host/port")]
    assert rows(matching.keep_live(entries, spark.createDataFrame([(2,), (2,)], "pid bigint"))) == [("b", 2)]


def test_insert_absent(spark, rows):
    old = spark.createDataFrame([("a", 1)], STATE)
    new = spark.createDataFrame([("a", 9), ("b", 2)], STATE)
    assert rows(matching.insert_absent(old, new, "key")) == [("a", 1), ("b", 2)]
    assert rows(matching.insert_absent(old, new, "key", overwrite=True)) == [("a", 9), ("b", 2)]


def backend(spark, servers, **client):
    schema = "ord int, server string, local_port int, job_id string"
    clients = spark.createDataFrame([(client.get("port"), client.get("default"))], "override_port int, default_server string")
    return matching.resolve_backend(clients, spark.createDataFrame(servers, schema)).first()["port"]


def test_backend_rules(spark):
    servers = [(1, "a", 1001, ""), (2, "b", 1002, "j2"), (3, "c", 1003, "j3"), (4, "d", None, None)]
    assert backend(spark, servers, port=5, default="a") == 5
    assert backend(spark, servers, port=0, default="a") == 1001
    assert backend(spark, servers, default="d") == 8000
    assert backend(spark, servers, default="gone") == 8000
    assert backend(spark, servers) == 1002
    assert backend(spark, servers, default="") == 1002
    assert backend(spark, servers[:1]) == 8000
    assert backend(spark, [(1, "a", None, "j")]) == 8000


def test_first_source_skips_empty(spark, rows):
    df = spark.createDataFrame([("u", 0, ""), ("u", 1, None), ("u", 2, "x"), ("u", 3, "y"), ("v", 0, "")], "key string, rank int, value string")
    assert rows(matching.first_by_source(df, ["key"])) == [("u", "x"), ("v", None)]


def test_predicates(spark, rows):
    df = spark.createDataFrame([(-1,), (0,), (65535,), (65536,), (None,)], "port int")
    good, bad = split_range(df, "port")
    assert rows(good) == [(0,), (65535,), (None,)] and rows(bad) == [(-1,), (65536,)]
    assert df.filter(in_range("port")).count() == 3
    m = spark.createDataFrame([({"a": "", "b": None, "c": "x"},)], "m map<string,string>")
    row = m.select(absent_fields("m", ["a", "b", "c", "d"]).alias("x"), unset_fields("m", ["a", "b", "c", "d"]).alias("y")).first()
    assert row["x"] == ["d"] and row["y"] == ["a", "b", "d"]
    known = spark.createDataFrame([("k",), ("k",)], "n string")
    asked = spark.createDataFrame([("k",), ("webui",), ("zz",)], "name string")
    assert rows(filter_members(asked, "name", known, "n")) == [("k",), ("webui",)]
    hosts = spark.createDataFrame([("X-UVA",), ("rivanna1",), ("my-dgx",), ("box",)], "h string")
    got = [tuple(r) for r in hosts.select(route("h"), platform("h")).collect()]
    assert got == [("UVA", "uva"), ("UVA", "default"), ("DGX", "dgx"), ("DGX", "default")]


@pytest.mark.parametrize("health,models,want", [(None, None, "OFFLINE"), (503, None, "STARTING"), (200, 200, "READY"), (200, 404, "STARTING"), (200, None, "OFFLINE")])
def test_probe_status(spark, health, models, want):
    df = spark.createDataFrame([(health, models)], "health int, models int")
    assert df.select(probe_status("health", "models")).first()[0] == want


def test_all_rows_of_a_repeated_job_id_are_found(spark, rows):
    jobs = spark.createDataFrame([("7", "alpha"), ("7", "beta"), ("8", "gamma")], JOB)
    req = spark.createDataFrame([(1, None, None, "7")], "req_id int, pattern string, job_name string, stored_job_id string")
    assert rows(matching.match_jobs_by_pattern(jobs, req)) == [(1, "7", "alpha", "stored"), (1, "7", "beta", "stored")]


def test_start_outcomes_equal_a_walk(spark, rows):
    rng = random.Random(2)
    entries = [(k, i) for i, k in enumerate("abc")]
    changes = [(rng.choice("abcdef"), rng.choice(["start", "start", "stop"]), 100 + i, i) for i in range(80)] + [("k", "start", 1, 900), ("k", "stop", None, 901)]
    entries.append(("k", 9))
    active, want = {k for k, _ in entries}, []
    for key, op, pid, seq in sorted(changes, key=lambda c: c[3]):
        if op == "start":
            want.append((key, seq, key not in active, "on" if key in active else str(pid)))
            active.add(key)
        else:
            active.discard(key)
    got = state.start_outcomes(spark.createDataFrame(entries, STATE), spark.createDataFrame(changes, CHANGE), "on")
    assert rows(got) == sorted(want, key=repr)
    assert ("k", 900, False, "on") in want


def test_a_slot_inside_a_value_stays(spark):
    df = spark.createDataFrame([("{/f:x.a}-{/f:x.b}-{/f:x.c}{n}",)], "t string")
    sections = spark.createDataFrame([("/f", "x", "a", "{/f:x.b}", 1), ("/f", "x", "b", "B", 2)], "file string, section string, attr string, value string, line_no bigint")
    assert refs.resolve_refs(df, "t", sections).first()["t"] == "{/f:x.b}-B-{/f:x.c}{n}"
