"""Alignment of two tokenizers against a walk over their tokens one by one."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from muster.llm import alignment, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: x for x, c in units.byte_alphabet().items()}

    def tokens(text):
        """Ids, byte strings and groups of one text; None without tokens."""
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return None
        ends = [[sum(map(len, r[: i + 1])) for i in range(len(r))] for r in raw] if len(text) < 3000 else [list(_sums(r)) for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = [[sum(c < e for c in cuts) for e in x] if len(text) < 3000 else _places(x, cuts) for x in ends]
        return ids, ends, cuts, group

    return tokens


def _sums(raw):
    at = 0
    for r in raw:
        at += len(r)
        yield at


def _places(ends, cuts):
    out, c = [], 0
    for e in ends:
        while cuts[c] < e:
            c += 1
        out.append(c)
    return out


def plain_rows(rows, tokens):
    df, kept = collections.Counter(), []
    for doc_id, text in rows:
        found = tokens(text)
        if found is None:
            kept.append((doc_id, None))
            continue
        ids, ends, cuts, group = found
        members = [([i for i, g in zip(ids[0], group[0]) if g == n], [i for i, g in zip(ids[1], group[1]) if g == n]) for n in range(len(cuts))] if len(text) < 3000 else _members(ids, group, len(cuts))
        links = collections.Counter()
        for x, y in members:
            cx, cy = collections.Counter(x), collections.Counter(y)
            for i in cx:
                for j in cy:
                    links[i, j] += cx[i] * cy[j]
        df.update(links.keys())
        kept.append((doc_id, (ids, members, links)))
    most = collections.defaultdict(int)
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found in kept:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids, members, links = found
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in members)
        best = sum(n for (x, y), n in links.items() if df[x, y] == most[x])
        out.append((doc_id, len(ids[0]), len(ids[1]), len(members), sum(links.values()), best, sum(n * df[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def _members(ids, group, n):
    out = [([], []) for _ in range(n)]
    for side in (0, 1):
        for i, g in zip(ids[side], group[side]):
            out[g][side].append(i)
    return out


def counted(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in alignment.linked_counts(df, A, B).select(*names).collect()], key=repr)


def random_texts(seed, n):
    rng = random.Random(seed)
    signs = ["a", "e", "th", "ing", " ", " ", "\n", "é", "中", "😀", ".", ",", "'s", "1", "  ", "\t", "́"]
    return [(i, "".join(rng.choices(signs, k=rng.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("limit", [200, 800_000])
def test_counts_equal_a_plain_walk(spark, plain, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", limit)
    rows = random_texts(5, 120)
    assert counted(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == plain_rows(rows, plain)


def test_odd_documents(spark, plain, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert counted(odd_documents) == plain_rows(rows, plain)
    assert counted(odd_documents.limit(0)) == []


def test_long_text_with_long_groups(spark, plain, monkeypatch):
    rng = random.Random(2)
    rows = [(1, "".join(rng.choices("ሀሁሂ中文字", k=30_000))), (2, "z" * 50_000), (3, "and the thing " * 5000)]
    want = plain_rows(rows, plain)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert counted(df) == want
    pair = alignment.Pair(A, B)
    batch = alignment.Batch([t for _, t in rows], pair)
    whole = batch.pairs()
    for long_group, pairs in ((0, 4_000_000), (0, 50), (1 << 40, 1000)):
        monkeypatch.setattr(alignment, "LONG_GROUP", long_group)
        monkeypatch.setattr(alignment, "PAIRS", pairs)
        assert all((x == y).all() for x, y in zip(whole, batch.pairs()))


def test_overlaps_and_group_ends(spark, plain):
    rows = random_texts(9, 60) + [(100, None), (None, ""), (7, "a ▁ b")]
    found = {}
    for r in alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        r = found[doc_id].pop(0) if doc_id != 7 else next(x for x in found[7] if bool(x["a_ids"]) == (plain(text) is not None))
        want = plain(text)
        if want is None:
            assert not any(r[c] for c in r.asDict() if c != "doc_id")
            continue
        ids, ends, cuts, _ = want
        assert (list(r["a_ids"]), list(r["b_ids"]), r["a_ends"], r["b_ends"], r["group_ends"]) == (ids[0], list(ids[1]), ends[0], ends[1], cuts)
        spans = [list(zip([0, *e], e)) for e in ends]
        shared = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b]
        assert list(zip(r["overlap_a"], r["overlap_b"])) == shared


def test_words_are_forgotten_in_time(plain, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 20)
    pair = alignment.Pair(A, B)
    for _, text in random_texts(3, 40):
        batch = alignment.Batch([text, "same words here"], pair)
        want = plain(text)
        n = len(want[0][0]) if want else 0
        assert batch.ids[0][:n].tolist() == (want[0][0] if want else [])
        assert len(pair.known) <= 20 + 60
