"""Edge rules of the scalar functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import payloads, records, templates, text, urls


@pytest.fixture
def ev(spark):
    """Value of one expression over string columns a, b, ..."""

    def run(build, *values):
        names = "abcdef"[: len(values)]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(build(*[F.col(n) for n in names])).first()[0]

    return run


def test_strip_cuts_what_python_cuts(ev):
    for s in ["  a b \n", " x　", "\x1c\x0by\x85", "", "   ", "  é  "]:
        assert ev(text.strip, s) == s.strip()


def test_space_characters_agree_with_python():
    every = [chr(c) for c in range(0x3001)]
    assert {c for c in every if c.isspace()} == set(fv.SPACE_CHARS)


def test_expand_user(ev):
    assert ev(text.expand_user, "/s/$USER/$USER", "bob") == "/s/bob/bob"
    assert ev(text.expand_user, "/s/$USER", "") == "/s/$USER"
    assert ev(text.expand_user, "/s/$USER", None) == "/s/$USER"


def test_expand_home(ev):
    assert ev(text.expand_home, "~/a/$HOME", "/h/b") == "/h/b/a//h/b"
    assert ev(text.expand_home, "~bob/a", "/h/b") == "~bob/a"
    assert ev(text.expand_home, "~", "/h/b") == "/h/b"


@pytest.mark.parametrize("port,want", [(9000, "--port 9000 x --port 9000"), (0, "--port 1 x --port  22"), (None, "--port 1 x --port  22")])
def test_port_flag(ev, port, want):
    given = F.lit(port).cast("int")
    assert ev(lambda a: text.override_port_flag(a, given), "--port 1 x --port  22") == want


def test_name_suffix(ev):
    new = F.lit(9)
    assert ev(lambda a: text.override_name_suffix(a, new), "svc_1_22") == "svc_1_9"
    assert ev(lambda a: text.override_name_suffix(a, new), "svc_1x") == "svc_1x"


def test_shebang(ev):
    assert ev(text.normalise_shebang, "run") == "#!/bin/bash\nrun"
    assert ev(text.normalise_shebang, "#!/bin/zsh -e\nrun") == "#!/bin/bash\nrun"
    assert ev(text.normalise_shebang, "#!/bin/bash -e\nrun") == "#!/bin/bash -e\nrun"
    assert ev(text.normalise_shebang, "#!/bin/sh $x\nrun", "/bin/$y") == "#!/bin/$y\nrun"


def test_job_id(ev):
    assert ev(text.extract_job_id, "hello\nSubmitted batch job 123 on x") == "123"
    assert ev(text.extract_job_id, "Submitted batch job x") is None


def test_mask(ev):
    assert ev(text.mask, "123456789") == "1234...6789"
    assert ev(text.mask, "12345678") == "****"


def test_placeholders(ev):
    assert ev(text.expand_var, "{user}", "bob") == "bob"
    assert ev(text.expand_var, "x{user}", "bob") == "x{user}"
    assert ev(text.placeholder_key, "{KEY}") == "KEY"
    assert ev(text.placeholder_key, "{") is None


def test_first_node(ev):
    assert ev(text.first_node, " n1,n2\n") == "n1"
    assert ev(text.first_node, fv.NO_NODE) is None
    assert ev(text.first_node, " ") is None


def test_images(ev):
    assert ev(urls.normalise_image, "", "bob") == "/scratch/bob/vllm_gemma4.sif"
    assert ev(urls.normalise_image, "/a/b.sif", "bob") == "/a/b.sif"
    assert ev(urls.normalise_image, "docker://x", "bob") == "docker://x"
    assert ev(urls.normalise_image, "x/y:tag", "bob") == "docker://x/y:tag"
    assert ev(urls.normalise_image, "y.sif", "bob") == "/scratch/bob/y.sif"


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://h:8001/v1", 8001), ("http://h/v1", 8000), ("http://h:0/", 8000), ("http://h:99999", 8000),
        ("http://u:1@h:77", 77), ("h:80", 8000), ("http://[::1]:90/x", 90), ("http://h:x/", 8000), ("", 8000),
    ],
)
def test_url_port(ev, url, want):
    assert ev(urls.url_port, url) == want


@pytest.mark.parametrize("url,want", [("http://h/v1/", "http://h"), ("http://h//", "http://h"), ("http://h/v1/v1", "http://h/v1"), ("http://h/v1x", "http://h/v1x")])
def test_api_suffix(ev, url, want):
    assert ev(urls.strip_api_suffix, url) == want


def test_container_host(ev):
    assert ev(urls.rewrite_host, "http://localhost:1/127.0.0.1") == "http://host.docker.internal:1/host.docker.internal"


def with_map(spark, **fields):
    return spark.createDataFrame([(fields,)], "m map<string,string>")


def test_path_pattern(ev):
    assert ev(templates.fill_path, "/home/{user}/vllm_{port}", None, "alice", "9000") == "/home/alice/vllm_9000"
    assert ev(templates.fill_path, None, "/default/{user}", "alice", None) == "/default/alice"
    assert ev(templates.fill_path, None, None, "alice", None) == ""


def test_render_once_goes_in_key_order(spark):
    df = with_map(spark, a="{b}", b="x")
    assert df.select(templates.render_once(F.lit("{a} ${a} {c}"), "m")).first()[0] == "x $x {c}"


def test_render_once_writes_missing_values(spark):
    df = with_map(spark, a=None, b="x")
    assert df.select(templates.render_once(F.lit("{a} {b}"), "m")).first()[0] == "None x"


def test_launch_error(spark):
    assert with_map(spark, script="run").select(templates.launch_error("m", F.lit("s.a"))).first()[0] is None
    for fields in ({"script": ""}, {"script": None}, {"host": "h"}):
        error = with_map(spark, **fields).select(templates.launch_error("m", F.lit("s.a"))).first()[0]
        assert error == "Configuration at 's.a' must contain a 'script' field."


def test_launch_script_gpu_choices(spark):
    for fields, gpu in (({"tensor_parallel_size": "2", "gpus": "4"}, "2"), ({"gpus": "4"}, "4"), ({}, "1")):
        df = with_map(spark, script="run {gpu}", **fields)
        assert df.select(templates.launch_script("m", F.lit("s"))).first()[0].endswith("\nrun " + gpu)
    assert with_map(spark, host="h").select(templates.launch_script("m", F.lit("s"))).first()[0] is None


def test_fixpoint_is_deep_and_guards_shell_variables(spark):
    chain = {f"k{i}": "{k%d}" % (i + 1) for i in range(20)}
    df = with_map(spark, **chain, k20="end", shell="${k0} {k0} $HOME \\1")
    out = df.select(templates.resolve_bindings("m").alias("r")).first()["r"]
    assert out["k0"] == "end"
    assert out["shell"] == "${k0} end $HOME \\1"


def test_guard_holds_for_every_occurrence(spark):
    df = with_map(spark, a="1")
    got = df.select(templates.render_fixpoint(F.lit("{a} ${a} {a}$"), "m")).first()[0]
    assert got == "1 ${a} 1$"


def test_cycles_end_and_are_reported(spark):
    df = with_map(spark, a="x{b}{b}", b="{a}", c="ok")
    done = df.select(templates.render_fixpoint(F.lit("{a} {c}"), "m").alias("t"), "m")
    row = done.select("t", templates.is_converged("t", "m").alias("ok")).first()
    assert row["ok"] is False and row["t"].endswith(" ok") and len(row["t"]) < 500
    fine = with_map(spark, a="1").select(templates.is_converged(F.lit("{zz} ${a}"), "m")).first()[0]
    assert fine is True


def test_overlay_and_case(spark):
    df = with_map(spark, key="a", KEY="", other="b")
    over = F.create_map(F.lit("other"), F.lit("c"), F.lit("new"), F.lit("d"))
    got = df.select(records.overlay("m", over)).first()[0]
    assert got == {"key": "a", "KEY": "", "other": "c", "new": "d"}
    assert df.select(records.get_any_case("m", "Key")).first()[0] == "a"
    assert df.select(records.overlay(F.lit(None).cast("map<string,string>"), over)).first()[0] == {"other": "c", "new": "d"}


def test_extra_lines(ev):
    given = "  --a 1 \r\n\n \t\n--b\x0b--c  "
    want = [x.strip() for x in given.splitlines() if x.strip()]
    assert ev(records.extra_lines, given) == want


def test_start_flags(spark):
    flags = lambda platform, **f: with_map(spark, **f).select(records.start_flags("m", F.lit(platform))).first()[0]
    assert flags("other", model="m") == ["--model m", "--tensor-parallel-size 1", "--gpu-memory-utilization 0.9", "--port 8000"]
    got = flags("dgx", model="m", tensor_parallel_size="4", gpu_memory_utilization="0.95", max_model_len="131072", extra_args="--x\n\n --y")
    assert got[:6] == ["--model m", "--tensor-parallel-size 4", "--gpu-memory-utilization 0.95", "--max-model-len 131072", "--x", "--y"]
    assert got[6:] == ["--enable-prefix-caching", "--load-format safetensors", "--enable-auto-tool-choice", "--tool-call-parser gemma4"]
    assert "--max-num-batched-tokens 5" in flags("uva", max_num_batched_tokens="5")
    assert not any("batched" in f for f in flags("uva", max_num_batched_tokens="0"))


def test_start_script_shapes(spark):
    df = with_map(spark, name="s", model="m", image="i")
    uva = df.select(records.start_script("m", F.lit("uva"), background=True)).first()[0]
    assert uva.startswith("#!/bin/bash\n    mkdir -p ~/vllm_logs\n    nohup apptainer run --nv i \\\n--model m \\\n")
    assert uva.endswith("--key-dir $HOME/gemma \\ > ~/vllm_logs/s.log 2>&1 &")
    dgx = df.select(records.start_script("m", F.lit("dgx"))).first()[0]
    assert '\n    -e HF_TOKEN="${HF_TOKEN}" \\\n' in dgx and "--name vllm-dgx-s " in dgx


def test_commands(spark):
    def submit(mode, batch_file=None, **f):
        return tuple(with_map(spark, name="s", **f).select(records.submit_command("m", F.lit(mode), F.lit("run.sh"), F.lit(batch_file).cast("string")).alias("r")).first()["r"])

    assert submit("sbatch", "b.sh") == ("sbatch b.sh", None)
    assert submit("ijob", partition="p", reservation="r") == ("ijob -p p --reservation=r run.sh", None)
    assert submit("ijob")[0] is None and "partition" in submit("ijob")[1]
    assert submit("sbatch")[0] is None and submit("what", partition="p")[0] is None
    full = {"allocation": "a", "partition": "p", "time": "1", "gres": "g"}
    assert with_map(spark, **full).select(records.interactive_command("m")).first()[0] == "ijob -c 1 -A a -p p --time=1 --gres=g"
    assert with_map(spark, **{**full, "gres": ""}).select(records.interactive_command("m")).first()[0] is None


def test_chat(ev):
    sent = json.loads(ev(payloads.chat_payload, 'say "hi"\né'))
    assert sent == {"model": fv.DEFAULT_MODEL, "messages": [{"role": "user", "content": 'say "hi"\né'}], "temperature": 0.7}
    assert ev(payloads.chat_content, '{"choices":[{"message":{"content":"Hello"}}]}') == "Hello"
    assert ev(payloads.chat_content, '{"choices":[]}') == fv.NO_CONTENT
    assert ev(payloads.chat_content, "broken") == fv.NO_CONTENT


def test_models(ev):
    answer = '{"data":[{"id":""},{"x":1},{"id":"a"},{"id":"b"}]}'
    assert ev(payloads.model_ids, answer) == ["a", "b"]
    assert ev(payloads.first_model, answer) == "a"
    assert ev(payloads.first_model, '{"data":"x"}') == fv.DEFAULT_MODEL
    assert ev(payloads.models_found, '{"data":[]}') == "OK (0 models found: None)"


def test_patterns_are_plain():
    assert re.search("|".join(fv.READY_PATTERNS), "INFO: Application startup complete.")
