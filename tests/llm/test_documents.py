"""Toxicity, near duplicates, scores and quality rules against plain versions."""

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm import fertility, packing, queries, scoring, simhash, toxicity
from muster.llm.batches import stored
from muster.llm.components import components

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- near duplicates -----------------------------------------------------------------------


def plain_fingerprint(text, words=3):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(prints, distance=2):
    """Smallest index that each fingerprint reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, documents):
    docs = documents.select("doc_id", "text").limit(500)
    rows = sorted(docs.collect())
    prints = [plain_fingerprint(r["text"]) for r in rows]
    root = plain_classes(prints)
    want = {r["doc_id"]: (prints[i], rows[root[i]]["doc_id"]) for i, r in enumerate(rows)}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    rows = odd_documents.collect()
    found = simhash.near_duplicates(odd_documents).collect()
    assert len(found) == len(rows)
    assert sorted(r["fp"] % (1 << 64) for r in found) == sorted(plain_fingerprint(r["text"]) for r in rows)
    # Null, empty and blank texts are one class, with the smallest id.
    assert {r["component_id"] for r in found if r["fp"] == 0} == {0}
    kept = simhash.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == len(set(plain_classes([plain_fingerprint(r["text"]) for r in rows])))
    assert simhash.near_duplicates(no_documents).count() == 0 and simhash.drop_near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("node_rows", [4, 2048])
def test_trie_join_loses_no_link(spark, node_rows):
    random = np.random.default_rng(5)
    center = random.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in random.choice(64, k, replace=False))) for k in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(12)]
    values = sorted({int(c ^ f) for c in center for f in flips} | {int(x) for x in random.integers(0, 1 << 63, 300, dtype=np.uint64)} | {0, 1, 3, 7, 15, (1 << 64) - 1})
    root = plain_classes(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2, node_rows=node_rows)).collect()
    label = {r["node"]: r["root"] for r in found}
    got = [label.get(v, v) for v in signed]
    assert len(set(zip(got, root))) == len(set(got)) == len(set(root))


def test_walk_within_and_between_sets():
    random = np.random.default_rng(1)
    for _ in range(30):
        a = np.unique(random.integers(0, 1 << 7, 30, dtype=np.uint64))
        b = np.unique(random.integers(0, 1 << 7, 20, dtype=np.uint64))
        for x, y, same in ((a, a, True), (a, b, False)):
            every = np.union1d(x, y)
            parent = np.arange(len(every))
            for i in x:
                for j in y:
                    if int(i ^ j).bit_count() <= 1 and i != j:
                        parent = simhash.unite(parent, np.searchsorted(every, [i]), np.searchsorted(every, [j]))
            parent = simhash.roots(parent)
            low, high = simhash.walk(x, y, 1, same)
            assert dict(zip(high.tolist(), low.tolist())) == {int(every[k]): int(every[p]) for k, p in enumerate(parent) if p != k}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 - i, 1001 - i) for i in range(50)] + [(5000, 4999), (5000, 5000), (5000, 4999)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 951 for i in range(951, 1002)} | {4999: 4999, 5000: 4999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- toxicity ------------------------------------------------------------------------------


def labelled(spark, n=400):
    """Ordinary words, and in every fifth text one of a family of words that are told by their spelling only."""
    random = np.random.default_rng(3)
    plain = ["".join(random.choice(list("abcdefghilmnoprst"), random.integers(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = list(random.choice(plain, 60))
        toxic = int(i % 5 == 2)
        if toxic:
            words[20] = "zwu" + random.choice(plain)
            words[40] = "Zwu" + random.choice(plain) + "!"
        rows.append((i, " ".join(words)))
        if i % 9:
            labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_knows_unseen_forms(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i]["predicted"] == int(i % 5 == 2) for i in held]
    assert len(held) > 50 and sum(right) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark, 150)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.train(docs, x) for x in (labels, turned)]
    assert np.array_equal(models[0].curve, models[1].curve) and models[0].probs == models[1].probs


def test_probabilities_add_up():
    grams = Counter()
    for word, n in (("abca", 3), ("abd", 2), ("cab", 1)):
        for g in toxicity.grams_of(word, 3):
            grams[g] += n
    model = toxicity.build([(g, n, n // 2) for g, n in grams.items()], 0.75, 3, 3)
    signs = [g for g in model.probs if len(g) == 1]
    for context in [toxicity.START, "a", "b", toxicity.START + "a", "ab", "ca"]:
        for c in (0, 1):
            total = 0.0
            for s in signs:
                gram, weight = context + s, 1.0
                while gram not in model.probs and len(gram) > 1:
                    weight *= model.left.get(gram[:-1], (1.0, 1.0))[c]
                    gram = gram[1:]
                total += weight * model.probs[gram][c]
            assert total == pytest.approx(1, abs=0.02)


def test_the_curve_does_not_depend_on_the_scale_of_the_features():
    random = np.random.default_rng(8)
    y = np.repeat([0.0, 1.0], [40, 8])
    x = random.normal(0, 1, (48, 2)) + y[:, None]
    (small, loss), (large, same) = toxicity.fit_curve(y, x * 0.01), toxicity.fit_curve(y, x)
    assert small * [1, 0.01, 0.01] == pytest.approx(large, rel=1e-3, abs=1e-4) and loss == pytest.approx(same, rel=1e-4)


@pytest.mark.parametrize("per_class", [40, 10_000])
def test_scores_follow_the_true_share_whatever_the_cap(spark, per_class):
    # Labels that say nothing about the texts: the best score is the share of toxic labels, 10%.
    random = np.random.default_rng(11)
    plain = ["".join(random.choice(list("abcdefgh"), 4)) for _ in range(40)]
    rows = [(i, " ".join(random.choice(plain, 200))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(random.random() < 0.1)) for i in range(1500)], "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels, per_class=per_class)).filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    assert scored.agg(F.avg("score")).first()[0] == pytest.approx(0.1, abs=0.08)


def test_weights_undo_the_cut_of_a_class():
    random = np.random.default_rng(12)
    y = (random.random(20_000) < 0.1).astype(float)
    x = random.normal(0, 1, (20_000, 2)) + y[:, None]
    cut = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:2000]])
    weights = np.where(y[cut] == 1, 1.0, (y == 0).sum() / 2000)
    assert toxicity.fit_curve(y[cut], x[cut], weights)[0] == pytest.approx(toxicity.fit_curve(y, x)[0], abs=0.15)


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    docs, labels = labelled(spark, 150)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(odd_documents, model)
    assert scored.columns == [c for c in odd_documents.columns if c != "score"] + ["score", "predicted"]
    rows = scored.collect()
    assert len(rows) == odd_documents.count() and len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(no_documents, model).count() == 0
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 7), (4, 1, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    for few in (labels.limit(0), odd_labels, labels.filter("toxic = 0")):
        assert toxicity.score(odd_documents, toxicity.train(odd_documents, few)).count() == len(rows)
    assert toxicity.train(no_documents, labels).score(["x"]) == pytest.approx(0.5)


def test_one_long_text_takes_nothing_along(spark):
    """A labelled text beyond the bounds is passed over; the others are learned from as before."""
    docs, labels = labelled(spark, 300)
    model = toxicity.train(docs, labels, max_words=20_000)
    for text, bounds in (("long " * 20_001, {}), ("中" * 300_001, {"max_chars": 300_000}), ("word " * 19_000 + "end", {"max_words": 18_500})):
        more = docs.unionByName(spark.createDataFrame([(i, text) for i in range(1000, 1010)], docs.schema))
        told = labels.unionByName(spark.createDataFrame([(i, 1, i % 2) for i in range(1000, 1010)], labels.schema))
        again = toxicity.train(more, told, **{"max_words": 20_000, **bounds})
        assert len(again.probs) > 0.9 * len(model.probs) and not any("中" in g for g in again.probs)
        assert toxicity.score(docs, again).filter("predicted = 1").count() < 100
    assert toxicity.fitting_in([5, 20, 4, 1, 1], [9, 20, 9, 90, 1], 10, 30) == [True, False, True, False, True]


def test_nothing_is_toxic_without_evidence(spark):
    docs, labels = labelled(spark, 60)
    for few in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.withColumn("doc_id", F.col("doc_id") + 10_000)):
        scored = toxicity.score(docs, toxicity.train(docs, few))
        assert scored.filter("predicted = 0 and score < 0.5").count() == docs.count()


def test_repeated_rows_of_a_labelled_id_count_once_towards_the_bound(spark):
    docs, labels = labelled(spark, 150)
    twice = docs.unionByName(docs)
    a, b = toxicity.train(docs, labels, max_words=4000), toxicity.train(twice, labels, max_words=8000)
    assert a.probs == b.probs


# -- scores --------------------------------------------------------------------------------


def test_probabilities_of_the_network_add_up():
    random = np.random.default_rng(2)
    network = scoring.Network(23, 2, 5, random.normal(0, 1, len(scoring.Network(23, 2, 5).weights)))
    around = random.integers(0, 23, (7, 4))
    each = np.array([network.log_probs(around, np.full(7, w)) for w in range(23)])
    assert np.exp(each).sum(axis=0) == pytest.approx(np.ones(7), abs=1e-4)


def test_a_step_follows_the_gradient():
    random = np.random.default_rng(4)
    around, target = random.integers(0, 10, (50, 4)), random.integers(0, 10, 50)
    network = scoring.Network(10, 2, 4, random.normal(0, 0.5, len(scoring.Network(10, 2, 4).weights)))
    before, loss = network.weights.astype(np.float64).copy(), -network.log_probs(around, target).mean()
    network.learn(around, target, 1e-2)
    step = before - network.weights
    assert loss + network.log_probs(around, target).mean() == pytest.approx((step @ step) / 1e-2, rel=0.1)


def test_scores_are_those_of_every_word_alone(spark, documents, odd_documents, no_documents):
    docs = documents.select("doc_id", "text").limit(30).unionByName(odd_documents.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    words = scoring.vocabulary(docs, 300)
    counts = Counter(w for r in docs.collect() for w in (r["text"] or "").lower().encode().split())
    assert words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:298]]
    numbers = scoring.numbered(docs, words, "doc_id", "text")
    network = scoring.train(numbers, 300, rounds=1, every=4)
    index = {w: i + 2 for i, w in enumerate(words)}
    want = []
    for r in docs.collect():
        ids = [index.get(w, scoring.OTHER) for w in (r["text"] or "").lower().encode().split()]
        edged = [scoring.EDGE] * 2 + ids + [scoring.EDGE] * 2
        total = float(sum(network.log_probs(np.array([[edged[i], edged[i + 1], edged[i + 3], edged[i + 4]]]), np.array([ids[i]]))[0] for i in range(min(len(ids), 300))))
        want.append((r["doc_id"], len(ids), total))
    got = {(r["doc_id"], r["n_words"]): r for r in scoring.score(numbers, network).collect()}
    for doc, n, total in want:
        if n <= 300:
            assert got[doc, n]["log_prob"] == pytest.approx(total, abs=1e-2 + 1e-4 * abs(total))
            assert (got[doc, n]["mean_log_prob"] is None) == (n == 0)
    assert scoring.pseudo_likelihood(no_documents).count() == 0


def test_training_helps(documents):
    docs = documents.select("doc_id", "text").repartition(4)
    words = scoring.vocabulary(docs, 1000)
    numbers = scoring.numbered(docs, words, "doc_id", "text")
    untrained, trained = scoring.Network(len(words) + 2, 2, 16), scoring.train(numbers, len(words) + 2, every=4)
    mean = [scoring.score(numbers, n).agg(F.sum("log_prob") / F.sum("n_words")).first()[0] for n in (untrained, trained)]
    assert mean[1] > mean[0] + 0.5


@pytest.mark.parametrize("every", [1, 3])
def test_training_visits_every_place(spark, monkeypatch, tmp_path, every):
    seen = tmp_path / "seen"
    learn = scoring.Network.learn

    def noted(self, around, target, rate):
        with open(seen, "ab") as out:
            out.write(np.asarray(target, "<i8").tobytes())
        learn(self, around, target, rate)

    # Every word of the texts is a word of its own, so its number tells its place.
    texts = [" ".join(f"w{100 * d + i}" for i in range(97)) for d in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    words = scoring.vocabulary(docs, 1000)
    numbers = scoring.numbered(docs, words, "doc_id", "text")
    partitions = [[np.frombuffer(r["ids"], "<u2") for r in numbers.collect()]]
    monkeypatch.setattr(scoring.Network, "learn", noted)

    def in_process(df, fn, schema):
        rows = df.toArrow().to_batches()
        list(fn(iter(rows)))
        return None

    monkeypatch.setattr(scoring, "arrow_map", in_process)
    monkeypatch.setattr(scoring, "averaged", lambda sums, parts, before: before)
    scoring.train(numbers, len(words) + 2, rounds=2, every=every)
    visits = Counter(np.fromfile(seen, "<i8").tolist())
    assert visits == {i: 2 for i in np.concatenate(partitions[0]).tolist()}


def test_rare_words_have_probabilities_of_their_own(spark):
    usual = " ".join(["the cat sat on the mat"] * 40)
    rows = [(0, usual), (1, usual + " catmat"), (2, usual + " zq\u00e9xkw"), (3, usual + " catxq")]
    docs = spark.createDataFrame(rows * 3 + [(9, " ".join(f"xq{i}zk" for i in range(60)))], "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r for r in scoring.pseudo_likelihood(docs, words=7).collect()}
    assert len({got[i]["log_prob"] for i in (1, 2, 3)}) == 3 and got[2]["log_prob"] < got[1]["log_prob"]
    # A run of words that nothing else holds is less likely than usual words.
    assert got[9]["mean_log_prob"] < got[0]["mean_log_prob"] - 3


def test_spellings_add_up(spark):
    docs = spark.createDataFrame([(0, "abc abd abc xyz xab \u00e9t")], "doc_id bigint, text string")
    spelled = scoring.spelling(scoring.counted_words(docs), [b"xyz"])
    for context in (b"", b"a", b"ab", b"abd", b"xyz", b"zzz"):
        assert math.fsum(spelled.prob(context, s) for s in range(257)) == pytest.approx(1)
    assert spelled.counts[b""] == Counter([*b"abcabdabcxab\xc3\xa9t", *[256] * 5])


def test_words_are_spelled_together(spark, monkeypatch):
    texts = ["abc abd\x00 abc xyz xab \u00e9t", "", "the \u4e2d\u6587 abc " + "q" * 300, "xyz xyz", "a \x1f\x7f b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = [scoring.words_of(t) for t in texts]
    counts = Counter(w for own in words for w in own if w != b"xyz")
    want = {}
    for word, n in counts.items():
        for i, sign in enumerate([*word, 256]):
            for start in range(max(0, i - 2), i + 1):
                after = want.setdefault(word[start:i], {})
                after[sign] = after.get(sign, 0) + n
    spelled = scoring.spelling(scoring.counted_words(docs), [b"xyz"])
    assert spelled.counts == want
    # Also words of which the counts know nothing, and pieces that end inside a word.
    words += [[b"zzz", b"xyz"], [b"\xff\xfe"], [], [b"ab"]]
    plain = [math.fsum(math.log(spelled.prob(w[max(0, i - 2) : i], s)) for w in own for i, s in enumerate([*w, 256])) for own in words]
    for signs in (1 << 20, 7, 1):
        monkeypatch.setattr(scoring, "_SIGNS", signs)
        assert spelled.log_probs([w for own in words for w in own], [len(own) for own in words]) == pytest.approx(plain)


@pytest.mark.parametrize("size", [0.5, 60.0])
def test_a_step_is_that_of_plain_softmax(size):
    """Also with logits that no exp in 32 bits can hold."""
    random = np.random.default_rng(6)
    words, hidden, n, rate = 11, 3, 40, 0.1
    network = scoring.Network(words, 1, hidden, random.normal(0, size, len(scoring.Network(words, 1, hidden).weights)))
    around, target = random.integers(0, words, (n, 2)), random.integers(0, words, n)
    kinds, bias = network.kinds.astype(float), network.bias.astype(float)
    inner, inputs = network.flat.astype(float)[:words], network.inputs.astype(float)
    want, logs, steps = [], [], [np.zeros_like(x) for x in (kinds[:, :-1], inner[:, :-1], inputs, bias)]
    for (left, right), word in zip(around, target):
        h = np.tanh(inputs[0, left] + inputs[1, right] + bias)
        kind, back, log = word // network.per_class, np.zeros(hidden), 0.0
        own = np.arange(words) // network.per_class == kind
        for rows, step, at, among in ((kinds, steps[0], kind, np.full(len(kinds), True)), (inner, steps[1], word, own)):
            x = np.where(among, rows[:, :-2] @ h + rows[:, -2], -np.inf)
            log += x[at] - x.max() - np.log(np.exp(x - x.max()).sum())
            d = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            d[at] -= 1
            step -= rate / n * np.outer(d, [*h, 1])
            back += d @ rows[:, :-2]
        logs.append(log)
        back *= 1 - h * h
        for i, w in enumerate((left, right)):
            steps[2][i, w] -= rate / n * back
        steps[3] -= rate / n * back
    assert network.log_probs(around, target) == pytest.approx(logs, rel=1e-4, abs=1e-4)
    network.learn(around, target, rate)
    got = network.kinds[:, :-1] - kinds[:, :-1], network.flat[:words, :-1] - inner[:, :-1], network.inputs - inputs, network.bias - bias
    for a, b in zip(got, steps):
        assert a == pytest.approx(b, abs=2e-6 * size + 1e-6)


def test_words_are_those_of_each_text():
    texts = ["", " a  b ", "x", "\t\x0b\x0c\r\n", "a\x1cb \x85   C\x00d", " \u4e2d\u3000\u6587 ", "\u0130 \u03a3 A\u03a3 "]
    for some in (texts, texts[:1], texts[3:4], texts[2:3], []):
        words, starts = scoring.words_in(some)
        assert [words.to_pylist()[a:b] for a, b in zip(starts, starts[1:])] == [scoring.words_of(t) for t in some]


def test_words_are_counted_and_numbered_without_an_object_for_each(spark, monkeypatch):
    text = " ".join(f"w{i % 1000}" for i in range(200_000)) + " rare"
    docs = spark.createDataFrame([(0, text), (1, None)], "doc_id bigint, text string").coalesce(1)
    peaks, rows = [], []

    def in_process(df, fn, schema):
        batches = df.toArrow().to_batches()
        tracemalloc.start()
        rows.append(list(fn(iter(batches))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(scoring, "arrow_map", in_process)
    monkeypatch.setattr(scoring.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    words = [f"w{i}".encode() for i in range(1000)]
    scoring.numbered(docs, words, "doc_id", "text", scoring.Spelling({b"": {97: 1}}))
    (ids, part, coded, spelled), = rows[0]
    assert ids.to_pylist() == [0, 1] and part.to_pylist() == [3, 3] and list(coded[1]) == [] and spelled[0] < 0 == spelled[1]
    assert np.frombuffer(coded[0], "<u2").tolist() == [*[i % 1000 + 2 for i in range(200_000)], scoring.OTHER]
    scoring.counted_words(docs)
    (found, n), = rows[1]
    assert dict(zip([bytes(w) for w in found.to_pylist()], n.to_pylist())) == {b"rare": 1} | dict.fromkeys(words, 200)
    # An object for each of the 200,000 words would take 8 million bytes or more.
    assert max(peaks) < 6e6


def test_a_step_sorts_its_places_once(monkeypatch):
    random = np.random.default_rng(11)
    sorts, order_of = [], scoring.Network.order_of
    monkeypatch.setattr(scoring.Network, "order_of", lambda self, ids: sorts.append(len(ids)) or order_of(self, ids))
    scoring.Network(4096, 2, 16).learn(random.integers(0, 4096, (2048, 4)), random.integers(0, 4096, 2048), 2.0)
    assert sorts == [2048]


def test_rows_are_added_in_any_order():
    random = np.random.default_rng(12)
    ids = np.where(random.random(500) < 0.4, scoring.OTHER, random.integers(0, 30, 500))
    rows, got = random.normal(0, 1, (500, 3)).astype(np.float32), np.ones((30, 3), np.float32)
    scoring.add_rows(got, ids, rows)
    want = np.array([1 + rows[ids == i].astype(float).sum(axis=0) for i in range(30)])
    assert got == pytest.approx(want, abs=1e-4)


def test_weights_from_the_driver_are_of_numpys_own_type():
    """numpy adds ten times slower to arrays whose type came with them from another process."""
    weights = pickle.loads(pickle.dumps(scoring.Network(50, 2, 4).weights))
    assert scoring.Network(50, 2, 4, weights).inputs.dtype is np.dtype(np.float32)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_weights_are_averaged_by_the_places_seen(spark, parts):
    random = np.random.default_rng(9)
    weights = random.normal(0, 1, (parts, 10)).astype("<f4")
    seen = random.integers(1, 50, parts).astype(float)
    rows = [(p, b, float(seen[p]), bytearray(weights[p, b : b + 6].tobytes())) for p in range(parts) for b in (0, 6)]
    got = scoring.averaged(spark.createDataFrame(rows, "part int, block int, seen double, mean binary"), parts, np.zeros(10, np.float32))
    assert got == pytest.approx((weights.astype(float) * seen[:, None]).sum(axis=0) / seen.sum(), rel=1e-6)


def test_logits_of_few_places_are_held_at_a_time():
    random = np.random.default_rng(8)
    network = scoring.Network(4096, 2, 16)
    around, target = random.integers(0, 4096, (65_536, 4)), random.integers(0, 4096, 65_536)
    tracemalloc.start()
    network.log_probs(around, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The logits of all classes for all places would be 16.8 MB, and more than one such table was held.
    assert peak < 25e6


def test_the_vocabulary_grows_with_the_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in range(5)], "doc_id bigint, text string")
    sizes = []
    network = scoring.Network
    try:
        scoring.Network = lambda words, *rest: sizes.append(words) or network(words, *rest)
        scoring.pseudo_likelihood(docs, words=10, often=5)
    finally:
        scoring.Network = network
    assert sizes[0] == 42


# -- quality rules -------------------------------------------------------------------------


def plain_measures(text, model):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ids = model.encode(text) if text else []
    share = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in share.values()) if ids else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(ids), entropy


def test_quality_measures(documents, odd_documents, no_documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "token_entropy"]
    for docs in (documents.limit(400), odd_documents):
        for r in fertility.measure(docs, PIECES).collect():
            want = plain_measures(r["text"], model)
            assert [r[c] for c in names] == [*want[:6], pytest.approx(want[6], abs=1e-9) if want[6] is not None else None]
    assert fertility.judge(stored(fertility.measure(no_documents, PIECES), "none")).count() == 0


def test_quality_verdicts(documents, odd_documents):
    for docs in (documents, odd_documents):
        judged = fertility.judge(stored(fertility.measure(docs, PIECES), "q"), min_documents=20)
        assert set(docs.columns) <= set(judged.columns)
        rows = judged.collect()
        assert len(rows) == docs.count()
        for r in rows:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
    clean = [r for r in rows if not r["base_failed"]]
    assert all(r["kept"] for r in clean if (r["byte_share"] or 0) <= 0.3)


MEASURED = "doc_id int, lang string, script string, n_tokens long, chars_per_token double, token_entropy double, byte_share double, n_words long, n_repeat_words long"


def plain_verdicts(rows, least_documents):
    """Bands and verdicts one document at a time."""
    def tables(key):
        groups = {}
        for r in rows:
            if r[3] >= 64 and r[4] is not None:
                groups.setdefault(key(r), {}).setdefault(r[3].bit_length() - 1, set()).add((r[4], r[5]))
        found = {}
        for name, lengths in groups.items():
            for bits, points in lengths.items():
                if len(points) >= least_documents:
                    band = []
                    for i, most in ((0, 0.6), (1, 1.3)):
                        v = sorted(x[i] for x in points)
                        q1, q2, q3 = (v[math.ceil(p * len(v)) - 1] for p in (0.25, 0.5, 0.75))
                        half = min(most, max(0.4, 3 * (q3 - q1)))
                        band.append((q2 - half, q2 + half))
                    found.setdefault(name, {})[bits] = band
        return found

    by_language, by_script = tables(lambda r: r[1] or r[2] or ""), tables(lambda r: r[2] or "")
    kept = {}
    for r in rows:
        good = not (r[7] < 10 or 100 * r[8] > 20 * r[7] or (r[6] or 0) > 0.3)
        lengths = by_language.get(r[1] or r[2] or "") or by_script.get(r[2] or "")
        if good and r[3] >= 64 and lengths:
            bits = r[3].bit_length() - 1
            at = max((b for b in lengths if b <= bits), default=min(lengths))
            (low, high), (least, most) = lengths[at]
            if r[4] is not None:
                good = low <= r[4] <= high and least - max(0, at - bits) <= r[5] <= most + max(0, bits - at)
        kept[r[0]] = good
    return kept


def test_verdicts_against_plain_bands(spark):
    """Rare lengths, rare languages and a third of junk; small groups are held against their neighbours."""
    rng = random.Random(11)
    rows = []

    def add(n, lang, script, bits, per, entropy, spread=0.05):
        for _ in range(n):
            tokens = rng.randrange(1 << bits, 2 << bits)
            rows.append((len(rows), lang, script, tokens, rng.gauss(per, spread), rng.gauss(entropy, spread), rng.choice([0.0, 0.1, 0.31, None]), rng.choice([100, 100, 100, 9]), rng.choice([0, 20, 21])))

    for bits in (7, 8, 9):
        add(80, "en", "latin", bits, 2.2, bits - 1.0)
    add(40, "fr", "latin", 8, 1.9, 7.0)
    add(20, "fr", "latin", 8, 1.9, 4.0)
    odd = len(rows)
    add(3, "en", "latin", 15, 2.2, 8.5)
    add(3, "en", "latin", 15, 2.2, 5.0)
    add(3, "en", "latin", 6, 2.2, 5.5)
    add(3, "sv", "latin", 8, 2.2, 7.0)
    add(3, "sv", "latin", 8, 5.0, 7.0)
    add(3, "ja", "cjk", 8, 0.7, 9.0)
    add(3, None, "latin", 8, 2.2, 7.0)
    add(3, None, None, 8, 2.2, 7.0)
    add(3, "en", "latin", 3, 9.0, 1.0)
    rows.append((len(rows), "en", "latin", 0, None, None, None, 100, 0))
    measured = spark.createDataFrame(rows, MEASURED)
    judged = {r["doc_id"]: r["kept"] for r in fertility.judge(measured, min_documents=30).collect()}
    assert judged == plain_verdicts(rows, 30)
    fine = [r for r in rows if r[7] == 100 and r[8] <= 20 and (r[6] or 0) <= 0.3]
    # What low entropy or odd characters per token tell is told for rare lengths and languages, and for a third of junk, too.
    assert all(judged[r[0]] == (r[5] > 6 or r[3] < 256) for r in fine if r[0] < odd + 9)
    assert not any(judged[r[0]] for r in fine if r[1] == "sv" and r[4] > 4)
    assert fertility.judge(measured.limit(0)).count() == 0


def test_good_documents_are_kept(spark):
    judged = queries.QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.003 * found[1, True]
    assert found.get((0, False), 0) > 0.1 * (found.get((0, True), 0) + found.get((0, False), 0))


def test_scripts():
    assert [fertility.script_of(t) for t in ("ab", "привет a", "中文字 ab", "12 !", "ñé", "אב")] == ["latin", "cyrillic", "cjk", None, "latin", "hebrew"]


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.columns == documents.columns
        rows = stored(kept, "stage")
        assert 0 < rows.count() < docs.count() and rows.exceptAll(docs).isEmpty()
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"] for r in docs.collect() if model.score(toxicity.words_of(r["text"])) < 0.5}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in fertility.judge(stored(fertility.measure(docs, PIECES), "q")).filter("kept").collect()}
        else:
            plain = sorted(docs.collect())
            root = plain_classes([plain_fingerprint(r["text"]) for r in plain])
            want = {r["doc_id"] for i, r in enumerate(plain) if root[i] == i}
        assert {r["doc_id"] for r in rows.collect()} == want
        docs = rows
    last = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.agg(F.sum("length")).first()[0] == packing.pack(docs.repartition(3), public_tokenizers.path("word_bpe_49k.json")).agg(F.sum("length")).first()[0]


def test_pipeline_stages_take_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        whole = docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, whole, SF).count()


# -- digests of the registered queries -----------------------------------------------------


def test_query_columns(spark):
    want = {
        "op1_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
        "op2_simhash": ["doc_id bigint", "fingerprint string", "component_id bigint"],
        "op4_pseudo_likelihood": ["doc_id bigint", "n_words bigint", "log_prob double", "mean_log_prob double"],
        "op9_token_counts": ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"],
    }
    for name, columns in want.items():
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert [f"{a} {b}" for a, b in found.dtypes] == columns
        assert found.count() == 200
    rows = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
