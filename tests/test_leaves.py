"""Nested documents: flattening, lookups and deep merge, the last one also against a plain merge."""

import json
import random

import pytest
from pyspark.sql import functions as F

from muster.operators import leaves


def flat(spark, *docs, max_depth=None):
    df = spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "id int, t string")
    return leaves.flatten_leaves(df.select("id", leaves.parse_doc("t").alias("doc")), max_depth=max_depth)


def leaf_rows(spark, layers):
    out = []

    def walk(layer, path, v):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                walk(layer, path + [k], x)
        else:
            out.append((layer, path, json.dumps(v, separators=(",", ":"))))

    for i, doc in enumerate(layers):
        walk(i, [], doc)
    return out


def test_flatten_rules(spark):
    got = {".".join(r["path"]): r["value"] for r in flat(spark, {"a": {"b.c": 1, "e": {}, "l": [1, {"x": 2}], "n": None}, "s": "t"}).collect()}
    assert got == {"a.b.c": "1", "a.e": "{}", "a.l": '[1,{"x":2}]', "a.n": "null", "s": '"t"'}


def test_empty_and_broken_documents(spark):
    got = [(r["id"], r["path"], r["value"]) for r in flat(spark, " ", "{broken", "{}").collect()]
    assert sorted(got) == [(0, [], "{}"), (2, [], "{}")]


def test_too_deep_is_an_error_not_a_loss(spark):
    doc = {"a": {"b": {"c": {"d": 1}}}}
    assert flat(spark, doc, max_depth=4).count() == 1
    with pytest.raises(Exception, match="nested deeper"):
        flat(spark, doc, max_depth=3).collect()


def test_lookup_path(spark):
    df = spark.createDataFrame([('{"a":{"b.c":{"x":0},"it\'s":"y"}}',)], "t string").select(leaves.parse_doc("t").alias("d"))
    row = df.select(
        leaves.lookup_path("d", ["a", "b.c", "x"], "int").alias("v"),
        leaves.lookup_path("d", ["a", "it's"]).alias("q"),
        leaves.lookup_path("d", "a.b.c.x").alias("gone"),
    ).first()
    assert tuple(row) == (0, "y", None)


def test_smart_lookup_order(spark):
    doc = {"fleet": {"ai": {"server": {"x": {"port": 1}}, "x": {"port": 2}, "deep": {"er": {"only": 5}}}}, "only": {"z": {"only": 6}}}
    names = {"both": "x.port", "full": "fleet.ai.x.port", "only": "only", "none": "nothing"}
    got = leaves.smart_lookup(flat(spark, doc), ["id"], names, ["fleet.ai.server", "fleet.ai"], "fleet", {"none": "d"}).first()
    assert (got["both"], got["full"], got["only"], got["none"]) == ("1", "2", "6", "d")


def test_list_children(spark):
    doc = {"fleet": {"ai": {"server": {"b": {"port": 1}, "a": {"port": 2}}, "client": {"c": {"host": "h"}}, "version": 3}}}

    def ask(name):
        return sorted(tuple(r) for r in leaves.list_children(flat(spark, doc), ["id"], name, "fleet.ai", "server").select("child", "value").collect())

    assert ask("server") == [("a", None), ("b", None)]
    assert ask("a") == [("port", None)]
    assert ask("server.a") == [("port", "2")]
    assert ask("version") == [(None, "3")]
    assert ask("nothing") == []


MERGES = [
    [{"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}],
    [{"a": {"x": 1}}, {"a": 5}],
    [{"a": 5}, {"a": {"x": 1}}],
    [{"a": 1}, {"a": None}],
    [{"a": {"x": 1}}, {"a": {}}],
    [{"a": 1}, {"a": {}}],
    [{"a": {"b": 1}}, {"a": 5}, {"a": {"c": 2}}],
    [{"a": {"b": 1}}, {"a": 5}, {"a": {}}],
    [{"a": {}}, {"a": {"b": {"c": 1}}}, {"a": {"b": {}}}],
    [{}, {"a": 1}],
    [{"a": 1}, {}],
    [{"a": {"b": 1, "c": 2}}, {"a": 3}, {"a": {"b": 4}}],
]


def plain_merge(base, new):
    out = dict(base)
    for k, v in new.items():
        out[k] = plain_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def random_doc(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2, None, "s", {}])
    return {k: random_doc(rng, depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}


def test_merge_equals_plain_merge(spark):
    rng = random.Random(7)
    cases = list(MERGES)
    for _ in range(120):
        docs = [random_doc(rng) for _ in range(rng.randint(2, 4))]
        cases.append([d if isinstance(d, dict) else {"a": d} for d in docs])
    given, want = [], set()
    for i, docs in enumerate(cases):
        given += [(i, *row) for row in leaf_rows(spark, docs)]
        merged = docs[0]
        for d in docs[1:]:
            merged = plain_merge(merged, d)
        want |= {(i, tuple(p), v) for _, p, v in leaf_rows(spark, [merged])}
    df = spark.createDataFrame(given, "id int, layer int, path array<string>, value string")
    got = {(r["id"], tuple(r["path"]), r["value"]) for r in leaves.merge_layers(df, ["id"]).collect()}
    assert got == want


def test_merge_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 0, ["a"], "1"), (None, 1, ["a"], "2"), (1, 0, ["a"], "3")], "id int, layer int, path array<string>, value string")
    got = sorted([(r["id"], r["value"]) for r in leaves.merge_layers(df, ["id"]).collect()], key=repr)
    assert got == [(1, "3"), (None, "2")]
    assert leaves.merge_layers(df.drop("id").filter("value < 3"), []).count() == 1


def test_set_path_creates_parents(spark):
    base = spark.createDataFrame([(1, ["x"], "1")], "id int, path array<string>, value string")
    change = spark.createDataFrame([(1, ["default", "server"], '"s"'), (1, ["x"], "2")], base.schema)
    got = sorted((".".join(r["path"]), r["value"]) for r in leaves.set_path(base, change, ["id"]).collect())
    assert got == [("default.server", '"s"'), ("x", "2")]


def test_record_of_named_fields(spark):
    rows = [(1, ["s", "host"], '"h"'), (1, ["s", "port"], "80"), (1, ["s", "n"], "null"), (1, ["s", "deep", "host"], '"no"')]
    df = spark.createDataFrame(rows, "id int, path array<string>, value string")
    got = leaves.leaves_to_record(df, ["id"], 1, ["host", "port", "n", "gone"]).first()["record"]
    assert got == {"host": "h", "port": "80"}


def test_listing_is_sorted(spark):
    from muster.operators.ordered import sorted_listing

    df = flat(spark, {"b": 1, "a": {"z": 1, "y": 2}}).select(leaves.leaf_name().alias("name"))
    assert [r[0] for r in sorted_listing(df, "name").collect()] == ["a.y", "a.z", "b"]
    assert df.select(F.count("*")).first()[0] == 3


def test_depth_comes_from_the_documents(spark):
    deep = '{"a}{\\"":' * 30 + "1" + "}" * 30
    df = spark.createDataFrame([(1, deep), (2, '{"x":[{"y":{}}]}'), (3, ""), (4, "5"), (5, "broken{"), (6, None)], "id int, t string")
    doc = leaves.parse_doc("t")
    assert [r[0] for r in df.orderBy("id").select(leaves.nesting_depth(doc)).collect()] == [30, 3, 1, 0, None, None]
    got = leaves.flatten_leaves(df.select("id", doc.alias("doc"))).collect()
    assert sorted((r["id"], len(r["path"])) for r in got) == [(1, 30), (2, 1), (3, 0), (4, 0)]


def rebuilt(leaf_rows_df, keys=("id",), **options):
    return {r["id"]: r["text"] for r in leaves.rebuild_documents(leaf_rows_df, list(keys), **options).collect()}


def test_documents_come_back_from_their_leaves(spark):
    rng = random.Random(11)
    docs = [random_doc(rng, 5) for _ in range(150)]
    docs += [{}, {"a": {}}, {"a": None}, {"a": []}, {"a b": {'q"\\\n': "ü "}}, {"a": {"b": {"c": 1}, "b.c": 2}, "a.b": {"c": 3}}, {"": {"": 0}}, 5, None, "text", [1]]
    got = rebuilt(flat(spark, *[json.dumps(d) for d in docs]))
    assert {i: json.loads(t) for i, t in got.items()} == dict(enumerate(docs))
    for text in got.values():
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) or "\\u" in text or " " in text


def test_deep_and_wide_documents_come_back(spark):
    deep = current = {}
    for i in range(40):
        current["d"] = {}
        current["x"] = i
        current = current["d"]
    wide = {f"k{i:05}": {"a": i, "b": {"c": None}} for i in range(5000)}
    got = rebuilt(flat(spark, deep, wide))
    assert json.loads(got[0]) == deep and json.loads(got[1]) == wide


def test_sections_of_a_depth_come_back(spark):
    doc = {"s": {"a": {"port": 1, "x": {"y": 2}}, "b": {"port": 3}, "plain": 4}, "top": 5, "empty": {}}
    rows = leaves.rebuild_documents(flat(spark, doc), ["id"], depth=2).collect()
    got = {tuple(r["path"]): json.loads(r["text"]) for r in rows}
    assert got == {("s", "a"): doc["s"]["a"], ("s", "b"): doc["s"]["b"], ("s", "plain"): 4, ("top",): 5, ("empty",): {}}


def test_merged_layers_come_back_as_documents(spark):
    rng = random.Random(23)
    cases = [[d for d in (random_doc(rng, 4) for _ in range(3)) if isinstance(d, dict)] or [{}] for _ in range(100)]
    given, want = [], {}
    for i, docs in enumerate(cases):
        given += [(i, *row) for row in leaf_rows(spark, docs)]
        merged = docs[0]
        for d in docs[1:]:
            merged = plain_merge(merged, d)
        want[i] = merged
    df = spark.createDataFrame(given, "id int, layer int, path array<string>, value string")
    got = rebuilt(leaves.merge_layers(df, ["id"]))
    assert {i: json.loads(t) for i, t in got.items()} == want


def test_rebuild_edge_rows(spark):
    schema = "id int, path array<string>, value string"
    df = spark.createDataFrame([(None, ["a"], "1"), (None, ["b"], None), (2, ["a", "b"], "{}")], schema)
    assert rebuilt(df) == {None: '{"a":1,"b":null}', 2: '{"a":{"b":{}}}'}
    assert rebuilt(df.limit(0)) == {}
    assert leaves.rebuild_documents(df.drop("id").filter("value = '1'"), []).first()["text"] == '{"a":1}'
    for bad in ([(1, ["a"], "1"), (1, ["a", "b"], "2")], [(1, ["a"], "1"), (1, ["a"], "2")], [(1, [], "{}"), (1, ["a"], "2")]):
        with pytest.raises(Exception, match="a value and a setting below it"):
            rebuilt(spark.createDataFrame(bad, schema))


def test_a_rebuild_is_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 9).alias("id"), F.array(F.col("id").cast("string"), F.lit("x")).alias("path"), F.lit("1").alias("value"))
    assert leaves.rebuild_documents(df, ["id"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def settings_of(spark, doc_rows, names):
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    found = leaves.lookup_settings(doc_rows, ["id"], asked, "name", ["fleet.ai.server", "fleet.ai"], "fleet")
    return {(r["id"], r["name"]): (r["value"], r["is_section"]) for r in found.collect()}


def test_lookups_that_lead_to_sections(spark):
    doc = {"fleet": {"ai": {"server": {"x": {"port": 1, "s": "t"}}, "x": {"port": 2}, "deep": {"er": {"only": {"z": 5}}}, "none": None}}, "only": {"a": 6}, "er": 1}
    other = {"fleet": {"ai": {"x": {"port": 3}}}, "q": {"x": {"port": 4}}}
    names = ["x", "x.port", "fleet.ai.x", "fleet.ai", "only", "er.only", "x.s", "nothing", "fleet.x", "none", "x", None]
    got = settings_of(spark, flat(spark, doc, other), names)
    assert {k: v for k, v in got.items() if k[0] == 0} == {
        (0, "x"): ('{"port":1,"s":"t"}', True),
        (0, "x.port"): ("1", False),
        (0, "fleet.ai.x"): ('{"port":2}', True),
        (0, "fleet.ai"): (json.dumps(doc["fleet"]["ai"], sort_keys=True, separators=(",", ":")), True),
        (0, "only"): ('{"a":6}', True),
        (0, "er.only"): ('{"z":5}', True),
        (0, "x.s"): ("t", False),
        (0, "none"): (None, False),
    }
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {(1, "x"): '{"port":3}', (1, "x.port"): "3", (1, "fleet.ai.x"): '{"port":3}', (1, "fleet.ai"): '{"x":{"port":3}}'}


def test_empty_sections_and_odd_names(spark):
    doc = {"fleet": {"ai": {"e": {}, "l": [1], "t": "{not a section"}}, "a|b": {"c+": 1}}
    got = settings_of(spark, flat(spark, doc), ["e", "l", "t", "a|b", "a|b.c+"])
    assert got == {(0, "e"): ("{}", True), (0, "l"): ("[1]", False), (0, "t"): ("{not a section", False), (0, "a|b"): ('{"c+":1}', True), (0, "a|b.c+"): ("1", False)}


def test_many_asked_names_read_the_leaves_as_often_as_one(spark):
    doc = {"fleet": {"ai": {"server": {"b": {"port": 1}, "a": {"port": 2}}, "version": 3, "client": {"c": {"host": "h"}}}}}
    tree = flat(spark, doc)

    def children(names):
        asked = spark.createDataFrame([(n,) for n in names], "asked string")
        return leaves.list_children_of(tree, ["id"], asked, "asked", "fleet.ai", "server")

    names = ["server", "a", "server.a", "version", "nothing", "client.c"]
    got = sorted((r["asked"], r["child"], r["value"]) for r in children(names).select("asked", F.coalesce("child", F.lit("")).alias("child"), F.coalesce("value", F.lit("")).alias("value")).collect())
    assert got == [("a", "port", ""), ("client.c", "host", "h"), ("server", "a", ""), ("server", "b", ""), ("server.a", "port", "2"), ("version", "", "3")]
    scans = [children(n)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for n in (names[:1], names)]
    assert scans[0] == scans[1]


def test_flattening_runs_no_job_and_knows_no_common_depth(spark, rows):
    """Documents of very different depth in one table; planning reads none of them."""
    deep = json.dumps({"n0": 1})
    for i in range(1, 40):
        deep = '{"n%d":%s,"a":[{"x":{}}],"e":{}}' % (i, deep)
    docs = spark.createDataFrame([(1, deep), (2, '{"a":1}'), (3, "7"), (4, None), (5, '{"a.b":{"{":"}}"}}')], "id int, t string")
    broken = docs.select("id", leaves.parse_doc(F.when(F.col("id") > 0, F.raise_error(F.lit("read")))).alias("doc"))
    leaves.flatten_leaves(broken)
    got = rows(leaves.flatten_leaves(docs.select("id", leaves.parse_doc("t").alias("doc"))).filter("id > 1"))
    assert got == [(2, ["a"], "1"), (3, [], "7"), (5, ["a.b", "{"], '"}}"')]
    longest = leaves.flatten_leaves(docs.select("id", leaves.parse_doc("t").alias("doc"))).filter("id = 1").agg(F.max(F.size("path")), F.count("*")).first()
    assert tuple(longest) == (40, 1 + 2 * 39)
