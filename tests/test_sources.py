"""Sources and sinks on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from muster.functions.text import first_listed_node
from muster.sources import export, keyed_state, layers, listings, logs, prompts, sections


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_listing_text(spark, tmp_path, rows):
    path = put(tmp_path, "q.txt", " 1|a|R|n1 \n\n2|b|R|\n3|c|R\n4|d|R|n4|more|x\n")
    got = listings.read_job_listing_text(spark, path)
    assert rows(got.select("job_id", "name", "state", first_listed_node("nodes"))) == [("1", "a", "R", "n1"), ("2", "b", "R", "Unknown"), ("4", "d", "R", "n4")]


@pytest.mark.parametrize(
    "text,want",
    [
        ('[{"job_id":"1","name":"a","nodes":[{"name":"n"}]},{"job_id":2}]', [("1", "a", "n"), ("2", None, "Unknown")]),
        ('{"jobs":[{"job_id":"1","name":"a","nodes":"n1"}]}', [("1", "a", "Unknown")]),
        ('{"job_id":"1","name":"a"}', [("1", "a", "Unknown")]),
        ("1|a|R|n\n2|b|R\n", [("1", "a", "n")]),
        ('[{"job_id":', []),
        ('{"error":"x"}', []),
        ("", []),
    ],
)
def test_listing_json(spark, tmp_path, rows, text, want):
    put(tmp_path, "q.json", text)
    got = listings.read_job_listing_json(spark, str(tmp_path / "q.json"), wholetext=True)
    assert rows(got.select("job_id", "name", first_listed_node("nodes"))) == want


def test_layers(spark, tmp_path, rows):
    pytest.importorskip("yaml")
    low = put(tmp_path, "a.yaml", "server:\n  port: 1\n  when: 2024-01-02\n  text: |\n    a\n    b\n")
    high = put(tmp_path, "b.json", '{"server":{"port":2}}')
    blank = put(tmp_path, "c.yml", "# nothing\n")
    empty = put(tmp_path, "e.yml", "")
    broken = put(tmp_path, "d.yaml", "a: [")
    docs = layers.read_config_layers(spark, [low, high, str(tmp_path / "missing.yaml"), blank, empty, broken])
    got = {r["layer"]: None if r["doc"] is None else r["doc"].toJson() for r in docs.select("layer", "doc").collect()}
    assert got == {0: '{"server":{"port":1,"text":"a\\nb\\n","when":"2024-01-02"}}', 1: '{"server":{"port":2}}', 3: "{}", 5: None}
    bad = [tuple(r) for r in layers.rejected_documents(docs).select("layer", F.substring_index("source", "/", -1), F.col("error").startswith("ParserError")).collect()]
    assert bad == [(5, "d.yaml", True)]
    with pytest.raises(Exception, match="can't be read: ParserError"):
        layers.valid_documents(docs).select(F.to_json("doc")).collect()
    assert layers.valid_documents(docs, raising=False).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        layers.read_config_layers(spark, [str(tmp_path / "missing.yaml")]).collect()


def test_yaml_values_without_json_form(spark, rows):
    """Odd keys and numbers become texts, a broken document is its own error, other columns keep their values."""
    pytest.importorskip("yaml")
    big = 2**53 + 1
    texts = [(big, "2024-01-02: .nan"), (None, "2: .inf\ntrue: x"), (3, "a: [b"), (4, "d: 2024-13-45"), (5, None)]
    docs = spark.createDataFrame(texts, "id bigint, t string").withColumn("n", F.struct("id", F.lit(1.5).cast("decimal(9,2)").alias("d")))
    got = layers.yaml_to_json(docs, "t")
    assert got.schema["n"].dataType == docs.schema["n"].dataType
    found = {r["id"]: (r["n"]["id"], r["json"], r["error"] is not None) for r in got.collect()}
    assert found == {
        big: (big, '{"2024-01-02": "nan"}', False),
        None: (None, '{"2": "inf", "true": "x"}', False),
        3: (3, None, True),
        4: (4, None, True),
        5: (5, "{}", False),
    }


def test_missing_yaml_package_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "yaml", None)
    with pytest.raises(ImportError):
        layers.read_config_layers(spark, [put(tmp_path, "a.yaml", "a: 1")])


def test_log_lines_over_many_splits(spark, tmp_path, settings):
    """Line numbers hold when a file is read in many pieces and files differ in size."""
    settings(spark__sql__files__maxPartitionBytes="1000", spark__sql__files__openCostInBytes="1")
    texts = {"a.out": [f"line {i} " + "x" * (i % 37) for i in range(3000)], "b.err": ["", "", "end"], "c.out": ["one"]}
    for name, lines in texts.items():
        put(tmp_path, name, "\n".join(lines))
    df = logs.read_logs(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {}
    for r in df.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line_no"]] = r["line"]
    assert {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()} == texts


SSH = """# comment
Port 22

Host alpha
  User bob
  HostName=alpha.example.org
Host beta
  User = eve smith
  Flag
  user late
host Alpha
  User second
  Extra 1
"""


def test_sections(spark, tmp_path, rows):
    path = put(tmp_path, "config", SSH)
    for size in (1, 2, 50_000):
        lines = logs.read_logs(spark, path)
        got = sections.first_entries(sections.section_entries(lines, size)).select("section", "attr", "value")
        assert rows(got) == sorted(
            [(None, "port", "22"), ("alpha", "user", "bob"), ("alpha", "hostname", "alpha.example.org"), ("alpha", "extra", "1"), ("beta", "user", "eve smith")],
            key=repr,
        )


def test_prompts(spark, tmp_path, rows):
    put(tmp_path, "p.txt", "\n  hello\nthere \n")
    assert [r["prompt"] for r in prompts.read_prompts(spark, str(tmp_path)).collect()] == ["hello\nthere"]
    df = spark.createDataFrame([(1, " f ", "i"), (2, None, " i "), (3, None, ""), (4, None, None)], "id int, f string, i string")
    got = rows(prompts.choose_prompt(df, ["id"], "f", "i"))
    assert got[:2] == [(1, "f", None), (2, " i ", None)]
    assert [r[1] for r in got[2:]] == [None, None] and all(r[2] for r in got[2:])


def test_state_files(spark, tmp_path, rows):
    good = put(tmp_path, "s.json", '{"h:1": 5,\n "g:2": 6}')
    bad = put(tmp_path, "t.json", '{"h:1": ')
    assert rows(keyed_state.import_state(spark, good)) == [("g:2", 6), ("h:1", 5)]
    assert rows(keyed_state.import_state(spark, bad)) == []
    assert rows(keyed_state.import_state(spark, str(tmp_path / "none.json"))) == []
    table = str(tmp_path / "table")
    assert rows(keyed_state.read_state(spark, table)) == []
    keyed_state.write_state(keyed_state.import_state(spark, good), table)
    assert rows(keyed_state.read_state(spark, table)) == [("g:2", 6), ("h:1", 5)]


def test_export(spark, tmp_path, rows):
    df = spark.createDataFrame([("a.b", "#!/bin/sh\nrun\n", "host: x"), ("c", None, "host: y")], "server string, script string, config string")
    export.write_rendered(df, str(tmp_path / "out"))
    assert rows(export.read_rendered(spark, str(tmp_path / "out"))) == [
        ("a.b", "config", "host: x"),
        ("a.b", "script", "#!/bin/sh\nrun\n"),
        ("c", "config", "host: y"),
    ]


ODD_NAMES = [None, "", " ", "a b", "x=y", "a/b", "100%", "q?#'\"", "t\tab", "[1]{2}^", "c:\\\\d", "\u00e9\u4e2d", "..", "_x", "twice", "twice", "tilde~&;<>|!$,()+@`"]


def test_export_has_the_layout_of_a_partitioned_table(spark, tmp_path, rows, monkeypatch):
    data = [(n, f"run {i}\n", None if i % 3 == 0 else f"host: {i}") for i, n in enumerate(ODD_NAMES)]
    df = spark.createDataFrame(data, "server string, script string, config string").coalesce(1)
    mine, theirs = str(tmp_path / "mine"), str(tmp_path / "theirs")
    export.write_rendered(df.limit(2), mine, tasks=1)
    export.write_rendered(df, f"file://{mine}", tasks=1)
    monkeypatch.setattr(export, "_mounted", lambda spark, path: None)
    export.write_rendered(df, theirs, tasks=1)

    def folders(top):
        return sorted(os.path.relpath(at, top) for at, _, files in os.walk(top) if any(f.startswith("part-") for f in files))

    assert folders(mine) == folders(theirs)
    assert rows(export.read_rendered(spark, mine)) == rows(export.read_rendered(spark, theirs))
    assert os.path.exists(f"{mine}/_SUCCESS") and sorted(os.listdir(tmp_path)) == ["mine", "theirs"]


def test_export_comes_back_with_its_names(spark, tmp_path, rows):
    names = [n for n in ODD_NAMES if n not in ("", "twice")] + ["007", "1e3", "2024-01-01"]
    df = spark.createDataFrame([(n, "run", None) for n in names], "server string, script string, config string")
    for i, some in enumerate((df, df.filter("server = '007'"))):
        export.write_rendered(some, str(tmp_path / f"a%b +c{i}"))
        got = export.read_rendered(spark, str(tmp_path / f"a%b +c{i}"))
        assert got.dtypes == [("server", "string"), ("kind", "string"), ("value", "string")]
        assert rows(got) == rows(some.selectExpr("server", "'script'", "script"))


def test_export_starts_no_process_for_a_file(spark, tmp_path):
    def started():
        with open("/proc/stat") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("processes "))

    df = spark.range(500).selectExpr("concat('s', id) as server", "concat('run ', id) as script", "concat('host: ', id) as config")
    export.write_rendered(df, str(tmp_path / "first"))
    before = started()
    export.write_rendered(df, str(tmp_path / "out"))
    assert started() - before < 500
    assert export.read_rendered(spark, str(tmp_path / "out")).count() == 1000


def test_write_config_replaces(spark, tmp_path):
    path = str(tmp_path / "c")
    layers.write_config(spark.range(5), path)
    layers.write_config(spark.range(2), path)
    assert spark.read.json(path).count() == 2


def test_shared_folder_needs_the_setting_on_a_cluster(spark, monkeypatch, settings):
    from muster import session

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster, "x")


def test_lines_of_texts(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, "")], "id int, t string")
    got = [(r["id"], r["line_no"], r["line"]) for r in logs.text_to_lines(df, ["id"], "t").orderBy("id", "line_no").collect()]
    assert got == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, "")]
    assert logs.text_to_lines(df, ["id"], "t").select(F.max("line_no")).first()[0] == 3


def packed(spark, tmp_path, n=500, **options):
    data = [(f"s{i % n}" if i else None, f"#!/bin/bash\nrun {i}\n\n", f"port: {i}" if i % 2 else None) for i in range(n + 1)]
    df = spark.createDataFrame(data, "server string, script string, config string").withColumn("bucket", F.lit("clash"))
    export.write_packed(df, str(tmp_path / "packed"), **options)
    want = [(s, k, v) for s, script, config in data for k, v in (("script", script), ("config", config)) if v is not None]
    return sorted(want, key=repr)


def test_packed_export_comes_back(spark, tmp_path, rows):
    want = packed(spark, tmp_path, buckets=7)
    assert rows(export.read_packed(spark, str(tmp_path / "packed"))) == want
    files = list((tmp_path / "packed" / "files").rglob("*.parquet"))
    assert len(files) == 7


def test_one_server_is_read_from_one_bucket(spark, tmp_path, rows):
    want = packed(spark, tmp_path, buckets=7)
    one = export.read_packed(spark, str(tmp_path / "packed"), ["s3", "nobody"])
    assert rows(one) == [w for w in want if w[0] == "s3"]
    scan = export.read_packed(spark, str(tmp_path / "packed"), ["s3"])
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "EqualTo(server,s3)" in plan
    export.unpack(spark, str(tmp_path / "packed"), ["s3"], str(tmp_path / "one"))
    assert rows(export.read_rendered(spark, str(tmp_path / "one"))) == [w for w in want if w[0] == "s3"]


def test_packing_no_servers(spark, tmp_path):
    empty = spark.createDataFrame([], "server string, script string, config string")
    export.write_packed(empty, str(tmp_path / "packed"))
    assert export.read_packed(spark, str(tmp_path / "packed")).count() == 0
    assert export.read_packed(spark, str(tmp_path / "packed"), ["a"]).count() == 0


def test_log_files_are_written_in_order(spark, tmp_path, rows):
    df = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("f"), (-F.col("id")).alias("o"), F.col("id").cast("string").alias("line"))
    logs.write_log_files(df.repartition(5), str(tmp_path / "logs"), "f", ["o"], "line")
    logs.write_log_files(df.repartition(5), str(tmp_path / "logs"), "f", ["o"], "line")
    for k in range(3):
        assert (tmp_path / "logs" / f"f{k}").read_text().split() == [str(i) for i in range(999, -1, -1) if i % 3 == k]


def test_stored_documents_come_back(spark, tmp_path):
    tree = spark.createDataFrame([(1, "a", ["x", "y"], "null"), (1, "a", ["e"], "{}"), (2, None, ["z.z"], '"\\n\u00fc"')], "id int, name string, path array<string>, value string")
    layers.write_documents(tree, ["id", "name"], str(tmp_path / "docs"))
    read = layers.valid_documents(layers.read_documents(spark, str(tmp_path / "docs"), "id int, name string"))
    got = {(r["id"], r["name"]): json.loads(r["t"]) for r in read.select("id", "name", F.to_json("doc").alias("t")).collect()}
    assert got == {(1, "a"): {"e": {}, "x": {"y": None}}, (2, None): {"z.z": "\n\u00fc"}}
    layers.write_documents(tree.filter("id = 1"), [], str(tmp_path / "one"))
    one = layers.valid_documents(layers.read_config_layers(spark, [str(tmp_path / "one")]))
    assert json.loads(one.select(F.to_json("doc")).first()[0]) == {"e": {}, "x": {"y": None}}
