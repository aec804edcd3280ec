"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter
from heapq import nsmallest

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k):
    words = [TERM.findall((t or "").translate(FOLD)) for _, t in docs]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item_id, text in sorted(set(items), key=repr):
        hits = []
        for (doc_id, _), w in zip(docs, words):
            score = 0
            for term in set(TERM.findall((text or "").translate(FOLD))) & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                tf = w.count(term)
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n) // total)))
            if score > 0:
                hits.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=3, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "score": F.lit("x"), "rank": F.lit(2), "n": F.lit(3)})
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"doc_id": F.lit(1), "query_no": F.lit(0)})
    return sorted([tuple(r) for r in lexical.rank_documents(d.repartition(5), q, k, **options).collect()], key=repr)


def random_case(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(n_docs)]
    docs += [(i + n_docs, docs[rng.randrange(9)][1]) for i in range(n_docs // 3)]
    return docs, [(i, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for i in range(n_items)]


@pytest.mark.parametrize("seed, block", [(1, 7), (2, 1000), (3, 40)])
def test_equals_plain_scoring(spark, monkeypatch, seed, block):
    docs, items = random_case(seed, 240, 25)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 400)
    assert found(spark, docs, items) == plain_search(docs, items, 3)
    # The same rows in blocks of another size, without Spark.
    words = [lexical.terms_of(t.encode()) for _, t in docs]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in words for t in w}))}
    df = [sum(t in w for w in map(set, words)) for t in vocabulary]
    weights = np.array([lexical.weight(n, d) for d in df])
    for item_id, text in items:
        terms = sorted({vocabulary[t] for t in lexical.terms_of(text.encode()) if t in vocabulary}, key=lambda t: (df[t], t))
        best, created = [], 0
        for start in range(0, len(docs), block):
            part = range(start, min(start + block, len(docs)))
            counts = [Counter(vocabulary[t] for t in words[i]) for i in part]
            ids = np.array([t for c in counts for t in c], dtype=int)
            tfs = np.array([x for c in counts for x in c.values()], dtype=int)
            ends = np.cumsum([0, *map(len, counts)])
            b = lexical.Block([docs[i][0] for i in part], [len(words[i]) for i in part], ids, tfs, ends, weights, n, total)
            new = b.best(terms, 3, best[-1][0] if len(best) == 3 else 0)
            assert not b.open.any() and not b.score.any()
            best = nsmallest(3, best + new, key=lexical._rank)
            created += len(new)
        assert [(s, d) for s, d in best] == [(s, d) for _, _, d, s in sorted(plain_search(docs, [(item_id, text)], 3), key=lambda r: r[1])]


def test_accumulators_stop_before_common_terms():
    """A rare match leaves documents that hold only the common term without an accumulator."""
    n = 1000
    ids = np.array([0, 1] + [1] * (n - 1))
    ends = np.append([0, 2], np.arange(3, n + 2))
    weights = np.array([lexical.weight(n, 1), lexical.weight(n, n)])
    block = lexical.Block(list(range(n)), [2] + [1] * (n - 1), ids, np.ones(n + 1, int), ends, weights, n, n + 1)
    touched = []
    block.open = Spy(block.open, touched)
    assert [d for _, d in block.best([0, 1], 1, 0)] == [0]
    assert max(touched) < 5


class Spy:
    """Marks of documents that tells how many were set at once."""

    def __init__(self, marks, touched):
        self.marks, self.touched = marks, touched

    def __getitem__(self, at):
        return self.marks[at]

    def __setitem__(self, at, value):
        if value is True:
            self.touched.append(len(at))
        self.marks[at] = value


def test_odd_texts_ties_and_repeats(spark):
    texts = [None, "", " ", "İstanbul K É", "É é", "a" * 5000, "x.y_z", "tie word", "tie word", "TIE Word", "word " * 3000, "\x00a\x7fb"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "tie word"), (7, "tie word")]
    items = [(1, "tie WORD"), (1, "tie WORD"), (2, None), (3, "..."), (4, "é"), (5, "É"), (None, "x z"), (6, "a" * 5000), (7, "k"), (8, "nothing here"), (9, "a b")]
    got = found(spark, docs, items, 4)
    assert got == plain_search(docs, items, 4)
    assert [r[2] for r in got if r[0] == 1] == [7, 7, 8, 9]


def test_empty_tables(spark):
    docs, items = [(1, "a")], [(1, "a")]
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
