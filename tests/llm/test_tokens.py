"""Packing, token counts, chat and pieces against the libraries, one text at a time."""

import hashlib
import random
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import chat, packing, pieces, queries, token_cache, units
from muster.session import shared_folder

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = st.lists(st.sampled_from([*"ab \n\t.'s1é<|>\x1c\x85\u3000中ß", "<|endoftext|>", "  ", "'ll", "Haor", "thered"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@hypothesis_settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_units_give_the_librarys_ids(texts):
    word = units.worker("w", lambda: packing.WordBpe(WORDS))
    for t, coded in zip(texts, word.encode(texts)):
        assert np.frombuffer(coded, word.kind).tolist() == word.tokenizer.encode(t, add_special_tokens=False).ids
    byte = units.worker("b", lambda: units.ByteLevel(BYTES, list, special=True))
    for t, values in zip(texts, byte.values(texts)):
        assert sum(values, []) == byte.tokenizer.encode(t, add_special_tokens=False).ids


def test_merge_list_gives_the_librarys_ids(documents, word_library):
    coder = packing.WordBpe(WORDS)
    assert coder.merges is not None
    words = sorted({w for r in documents.limit(40).collect() for w in r["text"].split()} | {"é", "ÀÖ", "a" * 70, "x"})
    plain = [w.lower() for w in words if coder._PLAIN.fullmatch(w)]
    got = coder.merges.ids([w.encode() for w in [w.rstrip(".,!?;:") for w in plain]], coder.kind)
    want = [e.ids for e in word_library.encode_batch([w.rstrip(".,!?;:") for w in plain], add_special_tokens=False)]
    assert len(plain) > 500 and [np.frombuffer(g, coder.kind).tolist() for g in got] == want


def test_memo_forgets_but_stays_right():
    calls = []
    memo = units.Memo(lambda us: calls.append(len(us)) or [len(u) for u in us], limit=3, longest=2)
    assert memo.values([["a", "bb", "ccc"], ["a"]]) == [[1, 2, 3], [1]]
    assert memo.values([["ccc", "a"], ["dd", "e", "f"]]) == [[3, 1], [2, 1, 1]]
    assert len(memo.known) <= 3


def check_pieces(rows, texts, library, length, end):
    """Every id of every document in one piece, sequences full and without gaps."""
    full = [library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]
    stream = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        stream.setdefault(r["sequence_id"], []).append((r["offset"], ids))
    at = 0
    for s in sorted(stream):
        assert s == at
        at += 1
        place = 0
        for offset, ids in stream[s]:
            assert offset == place
            place += len(ids)
        assert place == length or s == max(stream)
    joined, documents = [], sorted(map(tuple, full))
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0:
            joined.append([])
        assert len(joined[-1]) == r["start"]
        joined[-1] += np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted(map(tuple, joined)) == documents


@pytest.mark.parametrize("length", [4096, 64])
def test_packing(documents, word_library, length):
    docs = documents.repartition(5)
    rows = packing.pack(docs, WORDS, length=length).collect()
    check_pieces(rows, [r["text"] for r in docs.collect()], word_library, length, 2)


def test_packing_of_odd_rows(odd_documents, no_documents, word_library):
    rows = packing.pack(odd_documents, WORDS, length=32).collect()
    check_pieces(rows, [r["text"] for r in odd_documents.collect()], word_library, 32, 2)
    assert packing.pack(no_documents, WORDS).count() == 0


def test_packed_sequences_hold_their_pieces(odd_documents):
    found = packing.pack(odd_documents, WORDS, length=32)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(found).collect()}
    parts = {}
    for r in found.collect():
        parts.setdefault(r["sequence_id"], []).append((r["offset"], bytes(r["ids"])))
    assert whole == {s: b"".join(b for _, b in sorted(p)) for s, p in parts.items()}


def test_packing_digests(spark, documents, word_library):
    full = {r["doc_id"]: np.array(word_library.encode(r["text"], add_special_tokens=False).ids + [2], "<u4") for r in documents.collect()}
    for r in queries.QUERIES["op3_packing"](spark, "/root/testdata/sf0.01").collect():
        ids = full[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_token_counts(spark, documents, odd_documents, no_documents, byte_library, path):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    size = (lambda t: len(byte_library.encode(t, add_special_tokens=False).ids)) if path == BYTES else lambda t: len(model.encode(t))
    folder = shared_folder(spark, "cache")
    for docs in (documents.limit(60), odd_documents, no_documents):
        want = sorted([(r["doc_id"], len((r["text"] or "").encode()), size(r["text"] or "")) for r in docs.collect()], key=repr)
        got = token_cache.token_counts(docs, folder, path).collect()
        assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=repr) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_cache_is_used_and_grows_by_misses_only(spark, odd_documents):
    folder, more = shared_folder(spark, "cache"), odd_documents.withColumn("text", F.concat(F.col("text"), F.lit("!")))
    token_cache.fill_cache(odd_documents, folder, BYTES)
    one = spark.read.parquet(folder).count()
    assert one == odd_documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_cache.fill_cache(odd_documents, folder, BYTES)
    assert spark.read.parquet(folder).count() == one
    token_cache.fill_cache(odd_documents.unionByName(more), folder, BYTES)
    cache = spark.read.parquet(folder)
    assert cache.count() == cache.select("digest").distinct().count() == odd_documents.unionByName(more).select(F.coalesce("text", F.lit(""))).distinct().count()


TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "a \\ b <|turn|> </s>"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, None, "x"),
    (2, None, "tool<|end|>", "[INST]\\[INST] <<SYS>>"), (2, 0, "assistant", "é 中 😀"), (2, 0, "assistant", "é 中 😀"), (None, 1, "assistant", "n"), (None, 0, "user", "m"),
]


def plain_chat(rows):
    out = []
    key = lambda r: (r[0] is None, r[0] or 0)
    for conv, turns in groupby(sorted(rows, key=key), key):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for _, t, r, x in turns])
        said = "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(len(chat.escape(r)) + len(chat.escape(x)) + sum(map(len, chat.MARKS)) for _, r, x in turns)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        out.append((None if conv[0] else conv[1], len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), chars))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_chat(spark, settings, parts):
    settings(spark__sql__shuffle__partitions=parts, spark__sql__adaptive__coalescePartitions__enabled="false")
    long_one = [(3, i, random.Random(i).choice(["user", "assistant"]), f"turn {i} <s>") for i in range(300)]
    df = spark.createDataFrame(TURNS + long_one, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    formatted = chat.format_turns(df, BYTES)
    assert sorted(map(tuple, chat.read_back(formatted, BYTES).collect()), key=repr) == plain_chat(TURNS + long_one)
    places = [(r["conv_id"], r["offset"], r["n_ids"], r["mask_start"], r["mask_stop"]) for r in formatted.collect()]
    for _, turns in groupby(sorted(places, key=repr), lambda r: r[0]):
        at = 0
        for _, offset, n, lo, hi in sorted(turns, key=lambda r: r[1]):
            assert offset == at and (lo is None or offset < lo <= hi < offset + n)
            at += n
    assert chat.read_back(chat.format_turns(df.limit(0), BYTES), BYTES).count() == 0


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"\\<>|/s[]INSTa ", "<|end|>", "</s>", "[/INST]", "<<SYS>>"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(s in chat.escape(text) for s in (*chat.MARKS, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def plain_best(book, text):
    """Score and ids of the best path, place by place."""
    best = [(0.0, [])] + [None] * len(text)
    for at in range(len(text)):
        for n, x in book.edges(text, at):
            if best[at + n] is None or best[at][0] + x > best[at + n][0]:
                i = book.ids.get(text[at : at + n])
                ids = [i] if i is not None else [book.bytes[b] for b in text[at : at + n].encode()]
                best[at + n] = (best[at][0] + x, best[at][1] + ids)
    return best[-1]


def glued(spark):
    """Texts with few or no breaks, so that paths cross the ends of chunks."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(("the", "inter", "nation", "日本", "é", "\U0001f600", "x", "zz", "000", "\ue000", "<0x41>")) for _ in range(60)) for _ in range(6)]
    texts += ["x" * 200, "ab" * 90, " " * 90, "a" + " " * 70 + "b" * 50, "word " * 12 + "q" * 100 + " tail of words", "日" * 80]
    return spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def whole_texts(encoded):
    """Ids, decoded text and score of every row, put together from its chunks."""
    by_row = {}
    for r in sorted(pieces.decode(encoded, PIECES).collect(), key=lambda r: r["chunk"]):
        ids, text, score, n = by_row.get(r["row_id"], ([], "", 0.0, 0))
        assert r["chunk"] == n < r["n_chunks"]
        by_row[r["row_id"]] = (ids + np.frombuffer(r["ids"], "<u4").tolist(), text + r["text"], score + r["score"], n + 1)
    return list(by_row.values())


@pytest.mark.parametrize("chunk", [16_384, 50, 7])
def test_pieces_are_those_of_the_library(spark, documents, odd_documents, no_documents, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = odd_documents.select("doc_id", "text").unionByName(documents.select("doc_id", "text").limit(40)).unionByName(glued(spark))
    got = whole_texts(pieces.encode(docs, PIECES, chunk_chars=chunk))
    texts = [r["text"] or "" for r in docs.collect()]
    assert sorted(i for i, *_ in got) == sorted(model.encode(texts))
    assert sorted(t for _, t, *_ in got) == sorted(model.normalize(t)[1:].replace("▁", " ") if t else "" for t in texts)
    assert chunk == 16_384 or max(n for *_, n in got) > 5
    assert pieces.encode(no_documents, PIECES).count() == 0


def test_summary_of_chunks(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents.select("doc_id", "text").limit(30).unionByName(glued(spark))
    coded = pieces.encode(docs, PIECES, chunk_chars=100).cache()
    said = {(r["doc_id"], r["chunk"]): (r["n_tokens"], r["ids_crc32"], r["text_sha256"]) for r in queries.piece_summary(coded, PIECES).collect()}
    assert len(said) == coded.count()
    for r in docs.collect():
        ids = model.encode(r["text"])
        at = k = 0
        while (r["doc_id"], k) in said:
            n, crc, digest = said[r["doc_id"], k]
            own = ids[at : at + n]
            text = b"".join(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i in own for p in [model.id_to_piece(i)]).decode().replace("▁", " ")
            assert crc == zlib.crc32(np.array(own, "<u4").tobytes()) and digest == hashlib.sha256(text[k == 0 :].encode()).hexdigest()
            at, k = at + n, k + 1
        assert at == len(ids) and k
    coded.unpersist()


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_best_paths_of_scores(spark, odd_documents, chunk):
    book = pieces.Lattice(PIECES, merges=False)
    docs = odd_documents.select("doc_id", F.substring("text", 1, 300).alias("text")).unionByName(glued(spark))
    got = whole_texts(pieces.encode(docs, PIECES, chunk_chars=chunk, merges=False))
    marked = [book.model.normalize(r["text"]) if r["text"] else "" for r in docs.collect()]
    want = [plain_best(book, t) for t in marked]
    assert sorted(s for _, _, s, _ in got) == pytest.approx(sorted(s for s, _ in want))
    assert sorted(t for _, t, _, _ in got) == sorted(t[1:].replace("▁", " ") for t in marked)
    if chunk == 16_384:
        assert sorted(i for i, *_ in got) == sorted(i for _, i in want)


@pytest.mark.parametrize("merges", [True, False])
def test_transfer_matrices_are_associative(merges):
    book = pieces.Lattice(PIECES, merges)
    text = "▁the▁international▁organisation" * 3 + "x" * 40
    cuts = [0, 11, 30, 52, 80, len(text)]
    tables = [book.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])]
    left = pieces.product(pieces.product(pieces.product(pieces.product(*tables[:2]), tables[2]), tables[3]), tables[4])
    right = pieces.product(tables[0], pieces.product(tables[1], pieces.product(tables[2], pieces.product(*tables[3:]))))
    assert left.shape == (1, 1) and np.allclose(left, right)
    ids = book.encode_all([text])[0]
    assert left[0, 0] == pytest.approx(book.score(np.frombuffer(ids, "<u4")))
    assert merges or left[0, 0] == pytest.approx(plain_best(book, text)[0])


@hypothesis_settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abethn 日é\U0001f600\ue000x", "the", "  ", "tion", "000"]), min_size=1, max_size=40).map("".join), st.integers(1, 30))
def test_a_path_of_neighbours_is_what_the_merges_give(text, chars):
    book = merging_book()
    marked = book.model.normalize(text)
    cuts = book.cut(marked, chars)
    assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == len(marked)
    tables = [book.transfer(marked, a, b) for a, b, *_ in cuts]
    states = pieces.trace(tables, 0, 0)
    ends = [a + book.states(marked, a)[f][1] if i else 0 for i, ((a, *_), (f, _)) in enumerate(zip(cuts, states))] + [len(marked)]
    ids = b"".join(book.between(marked, a, b) for a, b in zip(ends, ends[1:]))
    assert np.frombuffer(ids, "<u4").tolist() == book.model.encode(text)


@lru_cache(1)
def merging_book():
    return pieces.Lattice(PIECES)


def test_words_together_and_one_by_one(documents):
    """Words that go through the lattice many at a time get the ids that each gets alone."""
    book = pieces.Lattice(PIECES, merges=False)
    rng = random.Random(7)
    words = ["".join(rng.choice("▁abcethn日本é\U0001f600ßя1 ") for _ in range(rng.randrange(70))) for _ in range(3000)]
    words += sorted({w for r in documents.collect() for w in book.words(book.model.normalize(r["text"] or ""))})
    assert book.code_many(words) == [book.code(w, book.best(w)) for w in words]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_under_any_file_gives_the_ids_of_the_library(spark, odd_documents, documents, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    some = odd_documents.select("doc_id", "text").unionByName(documents.limit(60).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    some = some.withColumn("doc_id", F.monotonically_increasing_id())
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in some.collect()}
    got = {}
    for r in packing.pack(some, path, length=512, end_id=2).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_a_worker_keeps_one_object():
    a = units.worker(("a",), list)
    assert units.worker(("a",), list) is a
    units.worker(("b",), dict)
    assert units.worker(("a",), list) is not a
    units.release()
    assert not units._WORKERS
