"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from muster.llm import alignment, chat, fertility, lexical, neighbours, packing, pieces, scoring, simhash, token_cache, toxicity, url_rules, warc
from muster.llm.batches import held_out, stored
from muster.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of the URL query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The conversation that goes along with the given ones: its texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def piece_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return piece_digests(packing.pack(table(spark, sf_dir, "documents"), path, length=4096, end_id=2))


@query("op4_pseudo_likelihood")
def op4_pseudo_likelihood(spark, sf_dir):
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def with_control_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


@query(
    "op5_chat",
    rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t.turn, t.role, '{CONTROL_TEXT}' from (values (0, 'user'), (1, 'assistant')) as t(turn, role)
),
sized as (
  select *,
    length(role) + len(regexp_extract_all(role, '{chat.CONTROL}'))
    + length(text) + len(regexp_extract_all(text, '{chat.CONTROL}')) + {sum(map(len, chat.MARKS))} as chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
""",
)
def op5_chat(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = with_control_conversation(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_turns(rows, path), path)


def piece_summary(coded: DataFrame, model_path: str) -> DataFrame:
    """Per chunk of a document, in order: its tokens, their score, the CRC of their ids and the SHA-256 of its decoded text."""
    n = (F.octet_length("ids") / 4).cast("long")
    return pieces.decode(coded, model_path).select(
        "doc_id",
        "chunk",
        "n_chunks",
        n.alias("n_tokens"),
        F.round("score", 3).alias("score"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op6_piece_encoding")
def op6_piece_encoding(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_summary(pieces.encode(table(spark, sf_dir, "documents"), path), path)


def url_rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, url_rules.RULE_SCHEMA)


@query(
    "op7_url_rules",
    rf"""
with rules(rule_host, rule_path, rule_verdict) as (values {", ".join(repr(r) for r in RULES)}),
parsed as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
)
select page_id, host, path,
  (select rule_host || rule_path from rules
   where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
   order by length(rule_host || rule_path) desc, length(rule_host) desc limit 1) as rule,
  coalesce((select rule_verdict from rules
   where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
   order by length(rule_host || rule_path) desc, length(rule_host) desc limit 1), 'allow') as verdict
from parsed
""",
)
def op7_url_rules(spark, sf_dir):
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op8_neighbours",
    """
with usable as (
  select distinct vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
scored as (
  select q.vec_id as query_id, c.vec_id, list_distance(q.v, c.v) as score
  from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
""",
)
def op8_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("id") % 100 == 0, k=10, factor=1.0)


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    # A cache of its own for every call, so that a call does all its work; a job would name a lasting folder.
    return token_cache.token_counts(table(spark, sf_dir, "documents"), shared_folder(spark, "token-cache"), path, limit=512)


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stored(fertility.measure(docs, path, keep=["doc_id", "lang"]), "quality")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return fertility.judge(measured).select(*base, "n_tokens", "chars_per_token", "byte_share", "token_entropy")


#: A term of the ranked search, and its capital letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_terms(column: str) -> str:
    return f"unnest(regexp_extract_all(translate({column}, '{CAPITALS}', '{SMALL}'), '{TERM}'))"


@query(
    "op11_ranked_search",
    f"""
with occurrences as (select doc_id, {sql_terms("text")} as term from documents),
tf as (select doc_id, term, count(*) as tf from occurrences group by doc_id, term),
size as (select doc_id, count(*) as n from occurrences group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from size),
damp as (select doc_id, 100 - 90 + (90 * n * docs) // terms as m from size, total),
asked as (select distinct item_id, {sql_terms("text")} as term from benchmark),
weight as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
  from tf, total where term in (select term from asked) group by term
),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weight using (term) join tf using (term) join damp using (doc_id) group by item_id, doc_id
),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from scored where score > 0
)
select * from ranked where rank <= 10
""",
)
def op11_ranked_search(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query(
    "op12_warc",
    """
with p as (select page_id, coalesce(html, '') as payload from pages),
shared as (select payload, max(page_id) as keeper from p where strlen(payload) >= 1000 group by payload)
select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest,
  case when page_id < keeper then 'revisit' else 'response' end as record_type,
  case when page_id < keeper then keeper end as refers_to
from p left join shared using (payload)
""",
)
def op12_warc(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.page_facts(warc.read_pages(spark, folder)).drop("error")


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.linked_counts(table(spark, sf_dir, "documents"), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
