"""Streams over several micro-batches, against their batch twins."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from muster.functions.text import first_node
from muster.operators import aggregates
from muster.sources import logs
from muster.sources import follow as growing
from muster.streaming import lines, phases, polls, runs, state

T0 = dt.datetime(2024, 1, 1)
POLL = "k string, ts timestamp, id bigint, ok boolean, nodes string"


def write_batches(spark, folder, batches, schema):
    """One file per batch, in order of their names and times."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next((folder / f"tmp{i}").glob("*.parquet"))
        (folder / "in").mkdir(exist_ok=True)
        target = folder / "in" / f"b{i:03}.parquet"
        target.write_bytes(part.read_bytes())
        stamp = 1_700_000_000 + i * 60
        os.utime(target, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_first_hit_over_batches(spark, tmp_path):
    """Polls are counted across batches, a key reports once, and the 61st poll comes too late."""
    def poll(k, i, ok=False):
        return (k, at(i), i, ok, "")

    batches = [
        [poll("early", 1, True), poll("early", 2, True)] + [poll("late", i) for i in range(40)] + [poll("edge", i) for i in range(59)],
        [poll("early", 100, True)] + [poll("late", i, i == 61) for i in range(40, 70)] + [poll("edge", 59, True)],
        [poll("few", 200)],
    ]
    stream = write_batches(spark, tmp_path, batches, POLL)
    out = runs.run_to_table(polls.await_ready(stream, "k", "ts", "id", F.col("ok"), seconds=10_000.0), str(tmp_path / "run"))
    got = sorted((r["key"], r["status"], r["poll"], r["ts"]) for r in out.collect())
    assert got == [("early", "ready", 1, at(1)), ("edge", "ready", 60, at(59)), ("late", "failed", None, None)]


@pytest.mark.parametrize("seed", [1, 3])
def test_many_keys_over_batches(spark, tmp_path, seed):
    """Random polls of many keys over three batches, against a plain count."""
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", at(i // 2), i, rng.random() < 0.03, f"n{i},x") for i in range(300)]
    stream = write_batches(spark, tmp_path, [rows[:90], rows[90:95], rows[95:]], POLL)
    node = F.when(F.col("ok"), first_node("nodes"))
    found = polls.await_allocation(stream, "k", "ts", "id", node, limit=20, seconds=10_000.0)
    got = sorted((r["key"], r["status"], r["poll"], r["payload"], r["ts"]) for r in runs.run_to_table(found, str(tmp_path / "run")).collect())
    want = []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key][:20]
        hit = next((i for i, r in enumerate(mine) if r[3]), None)
        if hit is not None:
            want.append((key, "allocated", hit + 1, f"n{mine[hit][2]}", mine[hit][1]))
        elif len(mine) == 20:
            want.append((key, "timeout", None, None, None))
    assert got == sorted(want)


def test_timer_reports_a_timeout_once(spark, tmp_path):
    batches = [
        [("lost", at(0), 1, False, "NLIST"), ("won", at(0), 2, False, "n1,n2")],
        [("clock", at(1000), 3, False, "")],
        [("clock", at(5000), 4, False, "")],
        [("clock", at(5001), 5, False, "")],
    ]
    stream = write_batches(spark, tmp_path, batches, POLL)
    found = polls.await_allocation(stream, "k", "ts", "id", first_node("nodes"), seconds=300.0)
    got = sorted((r["key"], r["status"], r["poll"], r["payload"]) for r in runs.run_to_table(found, str(tmp_path / "run")).collect())
    assert got == [("clock", "timeout", None, None), ("lost", "timeout", None, None), ("won", "allocated", 1, "n1")]


def test_late_polls_are_counted_or_reported(spark, tmp_path):
    """A poll behind the watermark counts while its key's time runs, and is reported as late after that."""
    batches = [
        [("held", at(0), 1, False, "a")],
        [("clock", at(200), 2, False, "b")],
        [("clock", at(201), 3, False, "b")],
        [("held", at(50), 4, True, "c"), ("new", at(10), 5, True, "d"), (None, at(20), 6, False, "e")],
        [("clock", at(1000), 7, False, "b")],
        [("clock", at(1001), 8, False, "b"), ("old", at(30), 9, True, "f"), ("old", at(31), 10, True, "f")],
        [("clock", at(1002), 11, False, "b")],
    ]
    stream = write_batches(spark, tmp_path, batches, POLL)
    out = runs.run_to_table(polls.await_ready(stream, "k", "ts", "id", F.col("ok"), seconds=300.0), str(tmp_path / "run"))
    got = sorted(((r["key"], r["status"], r["poll"], r["ts"]) for r in out.collect()), key=repr)
    want = [
        ("held", "ready", 2, at(50)),
        ("new", "ready", 1, at(10)),
        (None, "failed", None, None),
        ("clock", "failed", None, None),
        ("old", "late", None, at(30)),
        ("old", "late", None, at(31)),
    ]
    assert got == sorted(want, key=repr)


def test_times_do_not_depend_on_the_session_zone(spark, tmp_path, settings):
    settings(spark__sql__session__timeZone="America/New_York")
    stream = write_batches(spark, tmp_path, [[("a", at(0), 1, True, "")]], POLL)
    out = runs.run_to_table(polls.await_ready(stream, "k", "ts", "id", F.col("ok")), str(tmp_path / "run"))
    want = spark.createDataFrame([(at(0),)], "t timestamp").select(F.unix_micros("t")).first()[0]
    assert out.select(F.unix_micros("ts")).first()[0] == want


def test_late_polls_do_not_hide_later_ones(spark, tmp_path):
    """Many late polls of an unknown key are all reported, and one in time starts the count."""
    batches = [
        [("clock", at(10_000), 0, True, "")],
        [("clock", at(10_001), 1, True, "")],
        [("hot", at(i), i, True, "") for i in range(200)] + [("hot", at(9_900 + i), 500 - i, i == 7, "") for i in range(200)],
    ]
    stream = write_batches(spark, tmp_path, batches, POLL)
    out = runs.run_to_table(polls.await_ready(stream, "k", "ts", "id", F.col("ok"), seconds=300.0), str(tmp_path / "run"))
    got = [(r["status"], r["poll"], r["ts"]) for r in out.filter("key = 'hot'").collect()]
    assert sorted(t for s, _, t in got if s == polls.LATE) == [at(i) for i in range(200)]
    assert [r for r in got if r[0] != polls.LATE] == [("ready", 8, at(9_907))]


def test_polls_without_a_time_come_last(spark, tmp_path):
    batches = [[("a", None, 1, True, "x"), ("a", at(5), 2, False, "y"), ("b", None, None, True, "z")], [("b", at(6), 3, True, "")]]
    stream = write_batches(spark, tmp_path, batches, POLL)
    out = runs.run_to_table(polls.await_ready(stream, "k", "ts", "id", F.col("ok"), seconds=300.0), str(tmp_path / "run"))
    assert sorted((r["key"], r["status"], r["poll"], r["ts"]) for r in out.collect()) == [("a", "ready", 2, None), ("b", "ready", 1, None)]


def test_phases_over_batches(spark, tmp_path):
    schema = "run string, phase string, edge string, ts timestamp"
    batches = [
        [("r", "vpn", "start", at(0)), ("r", "launch", "start", at(10))],
        [("r", "vpn", "stop", at(5)), ("r", "long", "start", at(20))],
        [("r", "long", "stop", at(86400 * 9)), ("r", "vpn", "other", at(7))],
    ]
    stream = write_batches(spark, tmp_path, batches, schema)
    spans = phases.phase_stream(stream, "run", "phase", "edge", "ts", keep="2 days", delay="20 days")
    runs.finish(phases.store_changes(spans, str(tmp_path / "out"), str(tmp_path / "ck")))
    got = {r["phase"]: (r["started"], r["stopped"], r["seconds"]) for r in phases.current_spans(spark, str(tmp_path / "out")).collect()}
    assert got == {"vpn": (at(0), at(5), 5.0), "launch": (at(10), None, None), "long": (at(20), at(86400 * 9), 86400 * 9 - 20.0)}
    every = spark.createDataFrame([r for b in batches for r in b if r[2] != "other"], schema)
    twin = {r["phase"]: r["seconds"] for r in aggregates.phase_durations(every, ["run", "phase"]).collect()}
    assert twin == {k: v[2] for k, v in got.items()}
    assert phases.current_spans(spark, str(tmp_path / "nothing")).count() == 0


CHANGE = "key string, op string, pid bigint, seq bigint"


def test_state_over_batches(spark, tmp_path, rows):
    batches = [
        [("a", "start", 1, 1), ("b", "start", 2, 2), ("a", "start", 9, 3)],
        [("a", "stop", None, 4), ("a", "start", 5, 5), ("b", "start", 8, 6), ("c", "stop", None, 7)],
        [("a", "stop", None, 8), ("b", "stop", None, 9)],
    ]
    for upto, want in ((1, [("a", 1), ("b", 2)]), (2, [("a", 5), ("b", 2)]), (3, [])):
        folder = tmp_path / str(upto)
        folder.mkdir()
        stream = write_batches(spark, folder, batches[:upto], CHANGE)
        runs.finish(state.upsert_state(stream, str(folder / "state"), str(folder / "ck")))
        assert rows(state.current_state(spark, str(folder / "state"))) == want


def upsert(spark, folder, data, checkpoint):
    """The state after one more run over new rows, in files of their own."""
    spark.createDataFrame(data, CHANGE).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(CHANGE).parquet(str(folder / "in"))
    runs.finish(state.upsert_state(stream, str(folder / "state"), str(folder / checkpoint)))
    return sorted((tuple(r) for r in state.current_state(spark, str(folder / "state")).collect()), key=repr)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    assert state.current_state(spark, str(tmp_path / "state")).collect() == []
    assert upsert(spark, tmp_path, [("a", "start", 1, 1), (None, "start", 4, 2), ("b", "stop", None, 3)], "ck") == [("a", 1), (None, 4)]
    assert upsert(spark, tmp_path, [("a", "start", 2, 4), ("b", "start", 7, 5), ("b", "other", 8, 6)], "ck") == [("a", 1), ("b", 7), (None, 4)]
    assert upsert(spark, tmp_path, [("a", "stop", None, 9), ("a", "start", 5, 8), ("a", "start", 6, 10), ("a", "start", 3, 11)], "ck") == [("a", 6), ("b", 7), (None, 4)]
    assert upsert(spark, tmp_path, [], "ck") == [("a", 6), ("b", 7), (None, 4)]
    told = spark.read.parquet(str(tmp_path / "state" / "run-*")).filter("key = 'a'").orderBy("number").collect()
    assert [(r["pid"], r["here"], r["number"]) for r in told] == [(1, True, 1), (6, True, 2)]


def test_state_goes_on_with_a_new_checkpoint(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    assert upsert(spark, first, [("a", "start", 1, 1), ("b", "start", 2, 2), ("c", "stop", None, 3)], "ck") == [("a", 1), ("b", 2)]
    assert upsert(spark, first, [("b", "stop", None, 4)], "ck") == [("a", 1)]
    second.mkdir()
    (second / "state").symlink_to(first / "state")
    assert upsert(spark, second, [("a", "start", 9, 1), ("b", "start", 8, 2)], "ck") == [("a", 1), ("b", 8)]
    assert upsert(spark, second, [("a", "stop", None, 3)], "ck") == [("b", 8)]


def test_follow_lines(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.out").write_text("x\nApplication startup complete\n\ny")
    (tmp_path / "in" / "b.err").write_text("vLLM is up and running on 0.0.0.0")
    found = lines.follow_matches(logs.stream_lines(spark, str(tmp_path / "in"), files_per_batch=1))
    out = runs.run_to_table(found, str(tmp_path / "run"))
    got = sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in out.collect())
    assert got == [("a.out", "Application startup complete"), ("b.err", "vLLM is up and running on 0.0.0.0")]


def test_provider_setting_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(RuntimeError):
        with runs.rocksdb_state(spark):
            assert spark.conf.get(key) == polls.ROCKSDB
            raise RuntimeError
    assert spark.conf.get(key, None) == before


def grow(path, data):
    with open(path, "ab") as f:
        f.write(data)


def follow(spark, tmp_path, part_bytes=5):
    out = runs.run_to_table(growing.follow_files(spark, str(tmp_path / "in"), part_bytes), str(tmp_path))
    return sorted((r["file"].rsplit("/", 1)[1], r["position"], r["line"]) for r in out.collect())


def test_appended_lines_come_once(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    a, b, c = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log", tmp_path / "in" / "sub" / "c.log"
    grow(a, b"one\ntwo\nthr")
    grow(tmp_path / "in" / ".hidden", b"no\n")
    grow(tmp_path / "in" / "_no", b"no\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert follow(spark, tmp_path) == want
    # Nothing new, then the rest of a line, empty lines, new files and one without a line end.
    assert follow(spark, tmp_path) == want
    grow(a, "ee\n\n\nü".encode())
    grow(b, b"\xff\r\n")
    grow(c, b"no end")
    want += [("a.log", 8, "three"), ("a.log", 14, ""), ("a.log", 15, ""), ("b.log", 0, "�\r")]
    assert follow(spark, tmp_path) == sorted(want)
    grow(a, b"!\n")
    grow(c, b"\n")
    assert follow(spark, tmp_path) == sorted([*want, ("a.log", 16, "ü!"), ("c.log", 0, "no end")])


def test_a_file_begun_anew_is_read_from_its_start(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a = tmp_path / "in" / "a.log"
    a.write_bytes(b"long first line\nsecond\n")
    follow(spark, tmp_path)
    a.write_bytes(b"new\n")
    (tmp_path / "in" / "b.log").write_bytes(b"b\n")
    got = follow(spark, tmp_path)
    a.unlink()
    assert got == [("a.log", 0, "long first line"), ("a.log", 0, "new"), ("a.log", 16, "second"), ("b.log", 0, "b")]
    assert follow(spark, tmp_path) == got


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1 << 20])
def test_parts_of_a_file_hold_every_line_once(tmp_path, part_bytes, monkeypatch):
    monkeypatch.setattr(growing, "_BLOCK", 16)
    monkeypatch.setattr(growing, "_ROWS", 3)
    texts = [b"x" * (i * i % 90) for i in range(60)]
    (tmp_path / "f").write_bytes(b"".join(t + b"\n" for t in texts) + b"open")
    reader = growing.GrowingLinesReader(str(tmp_path), part_bytes)
    end = reader.latestOffset()
    assert list(end.values()) == [sum(len(t) + 1 for t in texts)]
    found = [line for p in reader.partitions({}, end) for batch in reader.read(p) for line in batch.column(2).to_pylist()]
    assert found == [t.decode() for t in texts]
    middle = {f: sum(len(t) + 1 for t in texts[:20]) for f in end}
    found = [line for p in reader.partitions(middle, end) for batch in reader.read(p) for line in batch.column(2).to_pylist()]
    assert found == [t.decode() for t in texts[20:]]
    assert reader.latestOffset() == end


def test_late_edges_are_listed(spark, tmp_path, rows):
    schema = "run string, phase string, edge string, ts timestamp"
    hour = 3600
    batches = [
        [("r", "vpn", "start", at(10 * hour)), ("r", "old", "start", at(0)), ("r", "x", "other", at(99 * hour))],
        [("r", "vpn", "stop", at(9 * hour)), ("r", "old", "stop", at(7 * hour)), ("r", "vpn", "stop", at(20 * hour)), (None, None, "start", None)],
        [("r", "vpn", "stop", at(17 * hour)), ("r", "vpn", "start", at(18 * hour))],
    ]
    stream = write_batches(spark, tmp_path, batches, schema)
    out = str(tmp_path / "out")
    runs.finish(phases.follow_phases(stream, "run", "phase", "edge", "ts", out, str(tmp_path / "ck"), delay="2 hours"))
    late = [(r["phase"], r["edge"], r["ts"], r["behind"], r["batch"]) for r in phases.late_edges(spark, out).orderBy("batch").collect()]
    assert late == [("old", "stop", at(7 * hour), at(8 * hour), 1), ("vpn", "stop", at(17 * hour), at(18 * hour), 2)]
    got = {r["phase"]: (r["started"], r["stopped"]) for r in phases.current_spans(spark, out + "/spans").collect()}
    assert got == {"vpn": (at(10 * hour), at(20 * hour)), "old": (at(0), None), None: (None, None)}
    assert phases.late_edges(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_done_again_changes_nothing(spark, tmp_path, rows):
    schema = "run string, phase string, edge string, ts timestamp"
    batches = [[("r", "a", "start", at(5000))], [("r", "a", "stop", at(10))], []]
    out = str(tmp_path / "out")
    for ck in ("ck", "again"):
        folder = tmp_path / ck
        folder.mkdir()
        stream = write_batches(spark, folder, batches[:2], schema)
        runs.finish(phases.follow_phases(stream, "run", "phase", "edge", "ts", out, str(folder / "ck"), delay="1 minute"))
        assert [(r["edge"], r["batch"]) for r in phases.late_edges(spark, out).collect()] == [("stop", 1)]
        assert [(r["started"], r["stopped"]) for r in phases.current_spans(spark, out + "/spans").collect()] == [(at(5000), None)]
