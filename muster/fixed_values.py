"""Words, defaults, markers and patterns that results must carry as they are."""

# Limits and defaults
POLL_LIMIT = 60
POLL_SECONDS = 5
STATUS_SAMPLE = 10
TAIL_LINES = 100
PREVIEW_CHARS = 50
DEFAULT_PORT = 8000
PORT_MIN, PORT_MAX = 0, 65535
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MODEL = "google/gemma-4-31B-it"

# Words shown for missing things
UNKNOWN = "Unknown"
NOT_AVAILABLE = "N/A"
NOT_TESTED = "Not tested"
NONE_LISTED = "None"
# What a missing value looks like inside a rendered script.
NULL_TEXT = "None"
NO_SCRIPT = "must contain a 'script' field."
NO_CONTENT = "OK (but no content found in response)"
NO_ENTRY = "No active tunnel found for this host/port"
ALREADY_ACTIVE = "Tunnel already active"
NO_LOG_FILE = "No log file configured."
NO_PROMPT = "Please provide either a prompt text or a --file"

# Characters that count as white space, as text and as a regex piece, and those that end a line
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Log text that means a service is up
READY_PATTERNS = ("vLLM is up and running on 0.0.0.0", "Application startup complete")

# A scheduler prints this instead of a node while nothing is allocated
NO_NODE = "NLIST"
JOB_TOKEN = "vllm_"
SUBMITTED = r"Submitted batch job (\d+)"

# Clients that are known without a record
BUILTIN_CLIENTS = ("aider", "webui", "claude")

# Host rules
ROUTE_RULE = (("uva", "UVA"), ("rivanna", "UVA"))
ROUTE_ELSE = "DGX"
PLATFORM_RULE = (("uva", "uva"), ("dgx", "dgx"))
PLATFORM_ELSE = "default"
PLATFORM_PORT = {"uva": 18123, "dgx": 8000, "default": 8000}
PLATFORM_ROOT = {"uva": "/scratch", "dgx": "/raid", "default": "/home"}

# Container addressing
LOCAL_HOSTS = ("localhost", "127.0.0.1")
CONTAINER_HOST = "host.docker.internal"
CONTAINER_PREFIX = "vllm-dgx-"
IMAGE_SCHEME = "docker://"
DEFAULT_IMAGE_FILE = "vllm_gemma4.sif"
MODEL_PREFIX = "openai/"

# Service table: field -> text when missing
SERVICE_FIELDS = {
    "host": "N/A",
    "model": "N/A",
    "image": "N/A",
    "tensor_parallel_size": "N/A",
    "gpu_memory_utilization": "N/A",
    "port": "8000",
    "account": "N/A",
    "partition": "N/A",
    "reservation": "N/A",
    "gres": "N/A",
    "cpus": "N/A",
    "mem": "N/A",
}

# Required fields
REQUIRED_UVA = ("account", "partition", "image", "model")
REQUIRED_DGX = ("image", "model")
REQUIRED_INTERACTIVE = ("allocation", "partition", "time", "gres")

# Start flags per platform, in order: (flag, field, value when missing).
# A None default drops the flag when the field is not set.
# "extra_args" stands for the record's own extra lines.
START_FLAGS = {
    "uva": (
        ("--model", "model", "None"),
        ("--tensor-parallel-size", "tensor_parallel_size", "1"),
        ("--gpu-memory-utilization", "gpu_memory_utilization", "0.9"),
        ("--max-model-len", "max_model_len", "16384"),
        ("--max-num-batched-tokens", "max_num_batched_tokens", None),
        ("", "extra_args", None),
        ("--port", "port", "8000"),
        ("--cache-dir", "cache_dir", "/scratch/$USER/hf_cache"),
        ("--key-dir", "key_dir", "$HOME/gemma"),
    ),
    "dgx": (
        ("--model", "model", "None"),
        ("--tensor-parallel-size", "tensor_parallel_size", "4"),
        ("--gpu-memory-utilization", "gpu_memory_utilization", "0.95"),
        ("--max-model-len", "max_model_len", "131072"),
        ("--max-num-batched-tokens", "max_num_batched_tokens", None),
        ("", "extra_args", None),
        ("--enable-prefix-caching", "enable_prefix_caching", "on"),
        ("--load-format", "load_format", "safetensors"),
        ("--enable-auto-tool-choice", "enable_auto_tool_choice", "on"),
        ("--tool-call-parser", "tool_call_parser", "gemma4"),
    ),
    "default": (
        ("--model", "model", "None"),
        ("--tensor-parallel-size", "tensor_parallel_size", "1"),
        ("--gpu-memory-utilization", "gpu_memory_utilization", "0.9"),
        ("--max-num-batched-tokens", "max_num_batched_tokens", None),
        ("", "extra_args", None),
        ("--port", "port", "8000"),
    ),
}
SWITCH_FLAGS = ("--enable-prefix-caching", "--enable-auto-tool-choice")
START_LOG_DIR = "~/vllm_logs"

# What comes before the flags, per platform; {field} is filled from the record.
START_COMMAND = {
    "uva": "apptainer run --nv {image} \\\n",
    "dgx": (
        "HF_TOKEN=$(cat {hf_token_path})\n"
        "VLLM_API_KEY=$(cat {api_key_path})\n"
        "docker run -d --name {container} --gpus all \\\n"
        "    --shm-size 16gb \\\n"
        "    -v {cache_dir}:/root/.cache/huggingface \\\n"
        "    -p 127.0.0.1:{port}:8000 \\\n"
        '    -e HF_TOKEN="${HF_TOKEN}" \\\n'
        '    -e VLLM_API_KEY="${VLLM_API_KEY}" \\\n'
        "    -e NVIDIA_VISIBLE_DEVICES={gpu_ids} \\\n"
        "    {image} \\\n"
    ),
    "default": "python3 -m vllm.entrypoints.openai.api_server \\\n",
}
START_COMMAND_DEFAULTS = {
    "image": "None",
    "port": "8000",
    "hf_token_path": "$HOME/.config/fleet/keys/hugging.txt",
    "api_key_path": "$HOME/.config/fleet/keys/server_master_key.txt",
    "cache_dir": "$HOME/.cache/huggingface",
    "gpu_ids": "0,1,2,3",
}
# (spaces before the second and third script lines, spaces before each flag)
START_INDENT = {"uva": (4, 0), "dgx": (8, 4), "default": (4, 0)}

# Batch header: (directive, field, value when missing)
BATCH_JOB_PREFIX = "vllm-"
BATCH_DEFAULTS = {"gres": "gpu:1", "cpus": "1", "mem": "16G", "time": "24:00:00"}

# Launch preamble
DEFAULT_SHELL = "/bin/bash"
DEFAULT_IMAGE = "vllm/vllm-openai"
LAUNCH_TITLE = "# vLLM Launch Script for "
LAUNCH_IMAGE_VAR = "VLLM_IMAGE"
