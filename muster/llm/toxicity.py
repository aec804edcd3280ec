"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelled, by n-grams of characters, are counted from the toxic and the
ordinary training texts, so that they also know unseen forms of a toxic expression. A document
is scored by how much likelier, per word, it is under the first model than under the second: over
the whole text, and over its most suspicious passage of ``window`` words, since a few words
can make a long text toxic. A logistic curve over the two gives the score.

A word counts as often as it has different words before it, so copies of a text do not count
again. Each order discounts its counts by D and leaves the rest to the next lower one, whose
counts are numbers of different characters before the n-gram; the lowest order, which smooths
whatever is rare, is counted over both classes. D is chosen, and the curve fitted, on training
documents that were not counted.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from muster.llm import units
from muster.llm.batches import FOLDS, arrow_map, rows_of, stored, with_columns

_WORD = re.compile(r"\w+")
DISCOUNTS = (0.75, 2.0)
#: Signs for the start and the end of a word.
START, END = "\x02", "\x03"
_MEMO = 300_000
#: The most that a text scores where nothing could be learned.
NO_EVIDENCE = 0.4999999


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, order: int):
    """All n-grams that end at a character of the word or at its end."""
    marked = START + word + END
    for stop in range(2, len(marked) + 1):
        for start in range(max(0, stop - order), stop):
            yield marked[start:stop]


@dataclass
class Model:
    """Smoothed probabilities (toxic, ordinary) of the counted n-grams, and the weights left to lower orders."""

    order: int
    probs: dict[str, tuple[float, float]]
    left: dict[str, tuple[float, float]]
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    window: int = 3

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word_ratio(self, word: str) -> float:
        """Log-likelihood ratio of a word's spelling."""
        marked, total = START + word + END, 0.0
        for stop in range(2, len(marked) + 1):
            gram = marked[max(0, stop - self.order) : stop]
            toxic = ordinary = 1.0
            while gram not in self.probs and len(gram) > 1:
                a, b = self.left.get(gram[:-1], (1.0, 1.0))
                toxic, ordinary, gram = toxic * a, ordinary * b, gram[1:]
            # A character that was never seen says nothing of its own.
            a, b = self.probs.get(gram, (1.0, 1.0))
            total += math.log(toxic * a) - math.log(ordinary * b)
        return total

    def features(self, words: list[str]) -> tuple[float, float]:
        """Mean log-likelihood ratio per word: of the whole text, and of its most toxic window."""
        if not words:
            return 0.0, 0.0
        ratios = list(map(self.known.get, words))
        if None in ratios:
            new = {w: self.word_ratio(w) for w in {w for w, r in zip(words, ratios) if r is None}}
            ratios = [new[w] if r is None else r for w, r in zip(words, ratios)]
            if len(self.known) + len(new) > _MEMO:
                self.known.clear()
            if len(new) <= _MEMO:
                self.known.update(new)
        if len(ratios) <= self.window:
            mean = math.fsum(ratios) / len(ratios)
            return mean, mean
        total = np.concatenate([[0.0], np.cumsum(ratios)])
        return float(total[-1] / len(ratios)), float((total[self.window :] - total[: -self.window]).max() / self.window)

    def score(self, words: list[str]) -> float:
        a, b = self.features(words)
        return float(1 / (1 + np.exp(-np.clip(self.curve @ [1.0, a, b], -30, 30))))


def learnable_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``id, toxic, fold`` of every labelled id that may be learned from; never a held-out one."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"), (crc % FOLDS).cast("int").alias("fold"))
    return usable.filter("id is not null and toxic in (0, 1) and fold <> 0").groupBy("id").agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold"))


def chosen_labels(usable: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each class, the first by a hash of the id."""
    order = [F.xxhash64("id"), F.col("id")]
    parts = [usable.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 20_000,
    max_words: int = 12_000_000,
    max_chars: int = 120_000_000,
    order: int = 4,
    window: int = 3,
    discounts: tuple[float, ...] = DISCOUNTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Model from the labelled documents.

    Bounds: at most ``per_class`` training documents per class, and of those, in the order of a
    hash of their ids, all that fit into ``max_words`` words and ``max_chars`` characters of words
    together; one that does not fit is passed over, those behind it are not. What comes to the
    driver and is broadcast is the different n-grams of at most ``order`` characters in them, fewer
    than ``order`` times ``max_chars`` whatever the size of the tables. Remainder 4 of the ids' CRC fits D
    and the curve, remainders 1 to 3 are counted; where remainder 4 lacks a class, the curve is fitted
    on the counted documents. Where a class is cut, its fitting points weigh as much as all its
    labels, so that the curve is that of the true shares of the classes.

    An id with two labels is toxic. Rows that repeat a labelled id are all learned from, or none of them.
    Without labels of both classes to count there is no evidence: every text scores the share of
    toxic labels, but less than 0.5, so that nothing is predicted toxic.
    """
    usable = learnable_labels(labels, id_col, label_col)
    sample = chosen_labels(usable, per_class)
    # Labels of each class for one that is chosen: the sample's shares of the classes are not the true ones.
    stands_for = {0: 1.0, 1: 1.0} | {r["toxic"]: max(1.0, r["count"] / per_class) for r in usable.groupBy("toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample's size is bounded, so its ids may be broadcast; its texts are read once.
    rows = stored(texts.join(F.broadcast(sample), "id").select("id", "toxic", "fold", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")

    def sizes(batches):
        units.release()
        for batch in batches:
            for keys, part in rows_of(batch, "text", "id", "toxic", "fold"):
                words = [words_of(t) for t in part]
                yield [*keys, list(map(len, words)), [sum(map(len, w)) for w in words]]

    kind = docs.schema[id_col].dataType
    counted = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("toxic int, fold int, n bigint, chars bigint").fields])
    # One row per chosen id, whatever the number of its rows.
    size = arrow_map(rows, sizes, counted).groupBy("id", "toxic", "fold").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).toPandas()
    size["order"] = pd.util.hash_array(size["id"].to_numpy(), categorize=False) if len(size) else 0
    size = size.sort_values(["order", "id"])
    size = size.loc[np.array(fitting_in(size["n"].tolist(), size["chars"].tolist(), max_words, max_chars), bool)]
    toxic, ordinary = (stands_for[c] * float((size["toxic"] == c).sum()) for c in (1, 0))
    prior = min((toxic + 0.5) / (toxic + ordinary + 1.0), NO_EVIDENCE)
    unknown = Model(order, {}, {}, np.array([math.log(prior / (1 - prior)), 0.0, 0.0]), window)
    fitting, counting = size[size["fold"] == 4], size[size["fold"] != 4]
    if counting["toxic"].nunique() < 2:
        return unknown
    chosen = docs.sparkSession.createDataFrame(size[["id"]].drop_duplicates(), T.StructType([T.StructField("id", kind)]))
    rows = rows.join(F.broadcast(chosen), "id")
    grams = count_grams(rows.filter(F.col("fold") != 4), order)
    held = rows.filter(F.col("fold") == 4) if fitting["toxic"].nunique() == 2 else rows
    candidates = [build(grams, d, order, window) for d in discounts]
    points = fitting_points(held, candidates)
    weights = np.where(points[:, 0] == 1, stands_for[1], stands_for[0])
    fits = [fit_curve(points[:, 0], points[:, 1 + 2 * i : 3 + 2 * i], weights) for i in range(len(candidates))]
    best = min(range(len(fits)), key=lambda i: fits[i][1])
    candidates[best].curve = fits[best][0]
    return candidates[best]


def fitting_in(words: list[int], chars: list[int], max_words: int, max_chars: int) -> list[bool]:
    """Which texts are taken, in order: each that still fits."""
    taken = []
    for n, c in zip(words, chars):
        fits = n <= max_words and c <= max_chars
        taken.append(fits)
        if fits:
            max_words, max_chars = max_words - n, max_chars - c
    return taken


def count_grams(rows: DataFrame, order: int) -> list[tuple[str, float, float]]:
    """N-grams with their counts in the toxic and the ordinary words; each word counts once per different word before it."""

    def pairs(batches):
        for batch in batches:
            for (toxic,), part in rows_of(batch, "text", "toxic"):
                seen = set()
                for label, text in zip(toxic.to_pylist(), part):
                    words = words_of(text)
                    seen.update(zip(["", *words], words, [label] * len(words)))
                if seen:
                    before, words, label = zip(*seen)
                    yield [[xxhash.xxh64_intdigest(w) >> 1 for w in before], words, label]

    def spelled(batches):
        for batch in batches:
            counts: Counter[tuple[str, int]] = Counter()
            for word, label, n in zip(*[batch.column(c).to_pylist() for c in ("word", "toxic", "n")]):
                for gram in grams_of(word, order):
                    counts[gram, label] += n
            if counts:
                yield [[g for g, _ in counts], [c for _, c in counts], list(counts.values())]

    words = arrow_map(rows, pairs, "before bigint, word string, toxic int").distinct().groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"))
    grams = arrow_map(words, spelled, "gram string, toxic int, n bigint").groupBy("gram")
    per_class = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(name) for c, name in ((1, "t"), (0, "o"))]
    found = grams.agg(*per_class).toPandas()
    return list(zip(found["gram"].tolist(), found["t"].astype(float).tolist(), found["o"].astype(float).tolist()))


def build(grams: list[tuple[str, float, float]], d: float, order: int, window: int) -> Model:
    """Kneser-Ney probabilities of every counted n-gram in both classes."""
    raw = {g: (t, o) for g, t, o in grams}
    # Below the highest order an n-gram counts once per different character before it.
    kinds: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for g, n in raw.items():
        if len(g) > 1:
            for c in (0, 1):
                kinds[g[1:]][c] += n[c] > 0
    counts = {g: n if len(g) == order or g[0] == START else tuple(kinds[g]) for g, n in raw.items()}
    levels: list[list[str]] = [[] for _ in range(order + 1)]
    for g in counts:
        levels[len(g)].append(g)
    both = {g: counts[g][0] + counts[g][1] for g in levels[1]}
    everything = sum(both.values())
    probs = {g: (n / everything, n / everything) for g, n in both.items()}
    left: dict[str, tuple[float, float]] = {}
    for level in levels[2:]:
        total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
        for g in level:
            t, o = counts[g]
            sums = total[g[:-1]]
            sums[0] += t
            sums[1] += o
            sums[2] += max(t - d, 0.0)
            sums[3] += max(o - d, 0.0)
        left.update((c, (1 - s[2] / s[0] if s[0] else 1.0, 1 - s[3] / s[1] if s[1] else 1.0)) for c, s in total.items())
        for g in level:
            (t, o), s, rest, lower = counts[g], total[g[:-1]], left[g[:-1]], probs[g[1:]]
            probs[g] = (
                (max(t - d, 0.0) / s[0] if s[0] else 0.0) + rest[0] * lower[0],
                (max(o - d, 0.0) / s[1] if s[1] else 0.0) + rest[1] * lower[1],
            )
    return Model(order, probs, left, window=window)


def fitting_points(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """Label and every model's two features of the fitting documents; their number is bounded by the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for (toxic,), part in rows_of(batch, "text", "toxic"):
                words = [words_of(t) for t in part]
                yield [toxic, *zip(*[[v for m in shared.value for v in m.features(w)] for w in words])]

    columns = ", ".join(f"a{i} double, b{i} double" for i in range(len(models)))
    points = arrow_map(rows, run, f"toxic int, {columns}").toPandas().to_numpy(float)
    shared.unpersist()
    return points


def fit_curve(y: np.ndarray, features: np.ndarray, weights: np.ndarray | None = None, ridge: float = 0.02, steps: int = 100) -> tuple[np.ndarray, float]:
    """Logistic curve through the weighted points by damped Newton steps, with its mean loss; the ridge is in units of the features' spread."""
    weights = np.ones(len(y)) if weights is None else weights / weights.mean()
    mean = (weights[:, None] * features).mean(axis=0)
    spread = np.maximum(np.sqrt((weights[:, None] * (features - mean) ** 2).mean(axis=0)), 1e-6)
    x = np.column_stack([np.ones(len(y)), features / spread])
    keep = ridge * np.diag([0.0, 1.0, 1.0])
    w = np.zeros(3)

    def loss(w):
        z = x @ w
        return float((weights * (np.logaddexp(0, z) - y * z)).sum()), 0.5 * float(w @ keep @ w)

    now = sum(loss(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + keep + 1e-6 * np.eye(3), x.T @ (weights * (p - y)) + keep @ w)
        size = 1.0
        while sum(loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, before, now = w - size * step, now, sum(loss(w - size * step))
        if before - now < 1e-9:
            break
    return w / np.concatenate([[1.0], spread]), loss(w)[0] / len(y)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Only the text is read. Null and empty texts score as the curve's value at zero evidence.
    Null ids, repeated rows and extra columns pass through; columns called ``score`` or
    ``predicted`` are replaced. An empty table gives no rows. Without training texts of both
    classes every text scores the share of toxic labels, at most ``NO_EVIDENCE``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    key = ("toxicity", uuid.uuid4().hex)

    def run(texts):
        model = units.worker(key, lambda: shared.value)
        scores = [model.score(words_of(t)) for t in texts]
        return [scores, [int(s >= 0.5) for s in scores]]

    return with_columns(docs, text_col, run, "score double, predicted int", keep)
