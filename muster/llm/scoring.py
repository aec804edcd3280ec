"""Document scores by masked pseudo-likelihood.

Every word of a text is predicted from the words on both its sides by a small window network,
and a document's score is the sum of the log-probabilities of its words. The network has one
hidden layer over the embeddings of the ``2 * reach`` words around the masked place and an exact
softmax in two steps: the class of the word, then the word in its class.

The vocabulary is counted over all documents and grows with the words that they repeat often. Any
other word has the probability of a rare word at its place times that of its spelling, which comes
from the bytes of all rare words.

Training runs where the documents lie: each task takes all its places through numpy, and the
weights of all tasks are averaged, weighted by the places they saw, in groups of bounded size. A few
such rounds give the network, whose size depends on the vocabulary's alone; that is what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from muster.llm.batches import arrow_map, rows_of, slices
from muster.session import checkpointed

#: Ids of a word outside the vocabulary and of a place beyond the text's ends.
OTHER, EDGE = 0, 1
#: Places that are worked on at a time, and those of them that are scored at a time.
_PLACES, _SCORED = 65_536, 4_096
#: Weights per row while they are averaged, and rows that one group averages.
_BLOCK, _FAN = 16_384, 32
#: Words that the network can tell apart, as they are numbered in 16 bits.
_MOST_WORDS = 65_536
#: Places whose logits are held at a time, and the logit of a place in a class without a word.
_TOGETHER, _CLOSED = 512, -1e30
#: Bytes of a rare word before the one that is spelled, the weight of each shorter context, and the sign for a word's end.
_CONTEXT, _PRIOR, _END = 2, 4.0, 256
#: The byte that no word holds, and bytes of words that are counted and spelled at a time.
_SPACE, _SIGNS, _SPELLED = 32, 1 << 20, 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words without regard to case, parted by ASCII white space."""
    return text.lower().encode("utf-8").split()


def words_in(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts as ``words_of`` gives them, and where the words of each text start; the last number is their end."""
    split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    words, starts = split.flatten().cast(pa.large_binary()), split.offsets.to_numpy()
    # White space at a text's ends parts an empty word off.
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not some.all():
        words, starts = words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[starts]
    return words, starts


def counted_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of all documents."""

    def count(batches):
        for batch in batches:
            for _, texts in rows_of(batch, "text"):
                counts = pc.value_counts(words_in(texts)[0])
                if len(counts):
                    yield [counts.field("values"), counts.field("counts")]

    counted = arrow_map(docs.select(F.col(text_col).cast("string").alias("text")), count, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, size: int) -> list[bytes]:
    top = counted.orderBy(F.desc("n"), "word").limit(size - 2)
    return [bytes(r["word"]) for r in top.collect()]


def vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> list[bytes]:
    """The most frequent words of all documents; equal counts in the order of the words."""
    return most_frequent(counted_words(docs, text_col), size)


def neighbours_of(words: list[bytes], most: int):
    """Bytes of the words in a row, each word with a space behind it for its end, ``most`` at a time.

    Yields where they start and stop, and for each byte the two before it and itself. No word holds a
    space, so a space before a byte says that the word begins there.
    """
    signs = np.frombuffer(b"  " + b" ".join([*words, b""]), np.uint8)
    for start in range(0, len(signs) - 2, most):
        stop = min(start + most, len(signs) - 2)
        yield start, stop, [signs[start + i : stop + i].astype(np.int32) for i in range(_CONTEXT + 1)]


def owners(ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Numbers of the pieces, which end at ``ends``, for every place from ``start`` to ``stop``."""
    return np.repeat(np.arange(len(ends)), np.diff(np.clip(ends, start, stop), prepend=start))


class Spelling:
    """Log-probabilities of words by their bytes; those of all words add up to one.

    A byte's probability given the ``_CONTEXT`` bytes before it is its count there, smoothed by
    ``_PRIOR`` times its probability after one byte less; below the empty context all bytes are alike.
    """

    def __init__(self, counts: dict[bytes, dict[int, int]]):
        self.counts = counts
        self.totals = {context: sum(after.values()) for context, after in counts.items()}
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def prob(self, context: bytes, sign: int) -> float:
        p = 1 / (_END + 1)
        for start in range(len(context), -1, -1):
            total = self.totals.get(context[start:])
            if total is None:
                break
            p = (self.counts[context[start:]].get(sign, 0) + _PRIOR * p) / (total + _PRIOR)
        return p

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each pair of bytes, and in that row the log-probability of each byte behind them.

        A space stands for a word's end, and before a byte for its beginning.
        """
        row_of: dict[bytes, int] = {}
        probs = np.full((len(self.counts) + 1, _END + 1), 1 / (_END + 1))
        for context in sorted(self.counts, key=len):
            if context and context[1:] not in row_of:
                continue
            row = row_of[context] = len(row_of)
            after = np.zeros(_END + 1)
            after[list(self.counts[context])] = list(self.counts[context].values())
            before = probs[row_of[context[1:]]] if context else probs[row]
            probs[row] = (after + _PRIOR * before) / (self.totals[context] + _PRIOR)
        rows = np.full((256, 256), row_of.get(b"", 0), np.int32)
        for context, row in row_of.items():
            if len(context) == 1:
                rows[:, context[0]] = row
        for context, row in row_of.items():
            if len(context) == 2:
                rows[context[0], context[1]] = row
        probs[:, _SPACE] = probs[:, _END]
        return rows.reshape(-1), np.log(probs[:, :_END])

    def log_probs(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """Sums over the first so many words, the next so many, and so on."""
        if self.tables is None:
            self.tables = self._tables()
        rows, logs = self.tables
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])[np.cumsum(counts)]
        out = np.zeros(len(counts))
        for start, stop, (a, b, sign) in neighbours_of(words, min(_SIGNS, _SPELLED)):
            found = logs.reshape(-1).take(rows.take(a * 256 + b).astype(np.int64) * _END + sign)
            out += np.bincount(owners(ends, start, stop), found, minlength=len(counts))
        return out


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its values."""
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value, first)


def spelling(counted: DataFrame, words: list[bytes]) -> Spelling:
    """Spelling of all words outside the vocabulary, by how often the documents hold them."""
    shared = counted.sparkSession.sparkContext.broadcast(set(words))

    def count(rows):
        """Keys of a context's length, its bytes and the byte behind it, with their counts."""
        keys, values = [], []
        ends = np.cumsum([len(w) + 1 for w, _ in rows])
        for start, stop, (a, b, sign) in neighbours_of([w for w, _ in rows], _SIGNS):
            n = np.array([n for _, n in rows], np.int64)[owners(ends, start, stop)]
            inner = b != _SPACE
            for length, here, key in ((0, slice(None), sign), (1, inner, b * 256 + sign), (2, inner & (a != _SPACE), (a * 256 + b) * 256 + sign)):
                keys.append(key[here] + (length << 24))
                values.append(n[here])
        return summed(keys, values)

    def spell(batches):
        waiting = []
        for batch in batches:
            for part in slices(batch, "word", _SIGNS):
                rows = [(w, n) for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()) if w not in shared.value]
                if rows:
                    waiting.append(count(rows))
                if sum(len(k) for k, _ in waiting) > 4 * _SIGNS:
                    waiting = [summed(*zip(*waiting))]
                    if len(waiting[0][0]) > 2 * _SIGNS:
                        yield pairs_of(*waiting.pop())
        if waiting:
            yield pairs_of(*summed(*zip(*waiting)))

    def pairs_of(keys, values):
        contexts = [(k >> 8 & 0xFFFF).to_bytes(2, "big")[2 - (k >> 24) :] for k in keys.tolist()]
        signs = keys & 255
        return [contexts, np.where(signs == _SPACE, _END, signs), values]

    found: dict[bytes, dict[int, int]] = {}
    pairs = arrow_map(counted, spell, "context binary, sign int, n bigint").groupBy("context", "sign").agg(F.sum("n").alias("n"))
    # Collected as Arrow: at most 257 signs after each context of up to two bytes.
    table = pairs.toArrow()
    for context, sign, n in zip(*[table.column(c).to_pylist() for c in ("context", "sign", "n")]):
        found.setdefault(context, {})[sign] = n
    return Spelling(found)


class Network:
    """Window network. ``weights`` has all its numbers in one flat array.

    The rows of ``kinds`` and ``words`` hold a class's or word's weights, its bias, and a one, and those
    of the hidden layer a one and a zero behind them. So one product gives the logits, one the sums that
    softmax and the way back need, and one the step.
    """

    def __init__(self, words: int, reach: int, hidden: int, weights: np.ndarray | None = None, seed: int = 7):
        self.count, self.reach, self.hidden = words, reach, hidden
        self.per_class = int(np.ceil(np.sqrt(words)))
        self.classes = -(-words // self.per_class)
        shapes = [(2 * reach, words, hidden), (hidden,), (self.classes, hidden), (self.classes,), (self.classes, self.per_class, hidden), (self.classes, self.per_class)]
        sizes = [int(np.prod(s)) for s in shapes]
        if weights is None:
            weights = np.random.default_rng(seed).normal(0, 0.1, sum(sizes))
        # Not a copy that keeps the type object of pickled weights: numpy adds to such an array ten times slower.
        own = np.empty(sum(sizes), np.float32)
        own[:] = weights
        parts = np.split(own, np.cumsum(sizes)[:-1])
        self.inputs, self.bias, kinds, kind_bias, inner, inner_bias = [x.reshape(s) for x, s in zip(parts, shapes)]
        # The last class may have places without a word; they get no probability.
        inner_bias.reshape(-1)[words:] = _CLOSED
        self.kinds = np.concatenate([kinds, kind_bias[:, None], np.ones_like(kind_bias)[:, None]], axis=1)
        self.words = np.concatenate([inner, inner_bias[..., None], np.ones_like(inner_bias)[..., None]], axis=2)
        self.flat = self.words.reshape(-1, hidden + 2)
        self.rooms: dict[str, np.ndarray] = {}

    @property
    def weights(self) -> np.ndarray:
        inner_bias = self.words[..., -2].copy()
        inner_bias.reshape(-1)[self.count :] = 0
        return np.concatenate([x.reshape(-1) for x in (self.inputs, self.bias, self.kinds[:, :-2], self.kinds[:, -2], self.words[..., :-2], inner_bias)])

    def room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Memory that every step uses again; new pages for each one cost more than the sums in them."""
        if name not in self.rooms or len(self.rooms[name]) < rows:
            self.rooms[name] = np.empty((rows, columns), np.float32)
        return self.rooms[name][:rows]

    def order_of(self, ids: np.ndarray) -> np.ndarray:
        """Order of the ids; 16 bits are sorted by their digits."""
        return np.argsort(ids.astype(np.uint16) if self.count <= _MOST_WORDS else ids, kind="stable")

    def state(self, around: np.ndarray) -> np.ndarray:
        total, more = self.room("total", len(around), self.hidden), self.room("more", len(around), self.hidden)
        # With this mode the rows are written to their place at once; no number is out of range.
        self.inputs[0].take(around[:, 0], axis=0, out=total, mode="clip")
        for i in range(1, 2 * self.reach):
            total += self.inputs[i].take(around[:, i], axis=0, out=more, mode="clip")
        total += self.bias
        out = self.room("state", len(around), self.hidden + 2)
        out[:, :-2] = np.tanh(total, out=total)
        out[:, -2], out[:, -1] = 1, 0
        return out

    def _classes_of(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Classes of sorted words, and for each that there is where it starts and stops."""
        kind = target // self.per_class
        cuts = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()
        return kind, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each masked word given the words around it."""
        order, out = self.order_of(target), np.empty(len(target), np.float32)
        for start in range(0, len(order), _SCORED):
            some = order[start : start + _SCORED]
            out[some] = self._log_probs(around.take(some, axis=0), target.take(some))
        return out

    def _log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The same for words in ascending order."""
        h = self.state(around)
        kind, some = self._classes_of(target)
        found = np.zeros(len(h), np.float32)
        for right, steps in ((kind, [(self.kinds, 0, len(h))]), (target - kind * self.per_class, [(self.words[c], a, b) for c, a, b in some])):
            for rows, start, stop in steps:
                for a in range(start, stop, _TOGETHER):
                    b = min(a + _TOGETHER, stop)
                    found[a:b] += log_shares(h[a:b], rows, right[a:b], self.room(f"logits {len(rows)}", b - a, len(rows)))
        return found

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability."""
        n, step = len(target), np.float32(rate / len(target))
        order = self.order_of(target)
        around, target = around.take(order, axis=0), target.take(order)
        h = self.state(around)
        kind, some = self._classes_of(target)
        wanted = self.kinds.take(kind, axis=0, out=self.room("wanted", n, self.hidden + 2), mode="clip")
        wanted += self.flat.take(target, axis=0, out=self.room("wanted inside", n, self.hidden + 2), mode="clip")
        outer, inner = self.room("outer sums", n, self.hidden + 2), self.room("inner sums", n, self.hidden + 2)
        kinds = self.kinds.copy()
        descend(h, step, kind, outer, self.room("outer", n, self.classes), [(self.kinds, kinds, a, min(a + _TOGETHER, n)) for a in range(0, n, _TOGETHER)])
        descend(h, step, target - kind * self.per_class, inner, self.room("inner", n, self.per_class), [(self.words[c], self.words[c], a, b) for c, a, b in some])
        self.kinds = kinds
        back, more = self.room("total", n, self.hidden), self.room("more", n, self.hidden)
        np.divide(outer[:, :-2], outer[:, -1:], out=back)
        back += np.divide(inner[:, :-2], inner[:, -1:], out=more)
        back -= wanted[:, :-2]
        slope = np.square(h[:, :-2], out=more)
        slope -= 1
        slope *= step
        back *= slope
        self.bias += back.sum(axis=0)
        for i in range(2 * self.reach):
            add_rows(self.inputs[i], around[:, i], back)


def descend(h: np.ndarray, step: np.float32, right: np.ndarray, sums: np.ndarray, room: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, int, int]]) -> None:
    """Takes the step of softmax in what each part names second; ``right`` has each place's right row.

    A part's logits are those of the rows it names first, at the places from its start to its stop. ``sums``
    gets exp of the logits, up to a factor of each place, times these rows. About ``_TOGETHER`` places
    are worked on at a time, so that their logits stay in the processor's cache.
    """
    right = right + np.arange(len(h)) * room.shape[1]
    at = 0
    with np.errstate(over="ignore", invalid="ignore"):
        while at < len(parts):
            start, end = parts[at][2], at + 1
            while end < len(parts) and parts[end][3] - start <= _TOGETHER:
                end += 1
            some, stop = parts[at:end], parts[end - 1][3]
            e, total = room[: stop - start], sums[start:stop, -1]
            for rows, _, a, b in some:
                np.dot(h[a:b], rows.T, out=e[a - start : b - start])
            np.exp(e, out=e)
            for rows, _, a, b in some:
                np.dot(e[a - start : b - start], rows, out=sums[a:b])
            if not in_range(total):
                for rows, _, a, b in some:
                    x = h[a:b] @ rows.T
                    e[a - start : b - start] = np.exp(x - x.max(axis=1, keepdims=True))
                    sums[a:b] = e[a - start : b - start] @ rows
            # The pull of the right rows.
            e.reshape(-1)[right[start:stop] - start * room.shape[1]] -= total
            shared = h[start:stop] * (step / total)[:, None]
            for _, to, a, b in some:
                to -= np.dot(e[a - start : b - start].T, shared[a - start : b - start])
            at = end


def log_shares(h: np.ndarray, rows: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logarithm of softmax over each row of logits at its right place; ``x`` is room for them."""
    right = right + np.arange(len(h)) * len(rows)
    with np.errstate(over="ignore", invalid="ignore"):
        wanted = np.dot(h, rows.T, out=x).take(right)
        total = np.dot(np.exp(x, out=x), np.ones(len(rows), np.float32))
    if in_range(total):
        return wanted - np.log(total)
    x = h @ rows.T
    x -= x.max(axis=1, keepdims=True)
    return x.take(right) - np.log(np.exp(x).sum(axis=1))


def in_range(total: np.ndarray) -> bool:
    """True if no sum of exp is too large or too small for 32 bits to hold what it adds up (false for NaN)."""
    return bool(total.min() > 1e-25 and total.max() < 1e25)


def add_rows(to: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of its id; those of ``OTHER``, by far the most, are added up first."""
    to[OTHER] += np.dot((ids == OTHER).astype(np.float32), rows)
    rest, flat, across = np.flatnonzero(ids != OTHER), to.reshape(-1), np.arange(to.shape[1])
    for start in range(0, len(rest), _TOGETHER):
        some = rest[start : start + _TOGETHER]
        at = ids.take(some)[:, None] * len(across) + across
        np.add.at(flat, at.reshape(-1), rows.take(some, axis=0).reshape(-1))


def places(pieces: list[tuple[np.ndarray, int, int]], reach: int, first: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all places of the pieces of texts one in ``every`` from the ``first`` on: number of the piece, words around, word."""
    edge, padded = np.full(reach, EDGE, np.uint16), []
    for ids, start, stop in pieces:
        padded += [edge[: max(0, reach - start)], ids[max(0, start - reach) : stop + reach], edge[: max(0, stop + reach - len(ids))]]
    padded = np.concatenate(padded).astype(np.int64)
    which = np.repeat(np.arange(len(pieces)), [stop - start for _, start, stop in pieces])
    # Each piece has ``reach`` words or edges more on both sides.
    at = (np.arange(len(which)) + (2 * which + 1) * reach)[first::every]
    around = np.empty((len(at), 2 * reach), np.int64)
    for i, o in enumerate([*range(-reach, 0), *range(1, reach + 1)]):
        around[:, i] = padded.take(at + o)
    return which[first::every], around, padded.take(at)


def in_blocks(texts: list[np.ndarray], reach: int, first: int = 0, every: int = 1):
    """Places of many texts, of at most ``_PLACES`` at a time one in ``every``: number of the text, words around, word."""
    waiting, numbers, size = [], [], 0
    for i, ids in enumerate(texts):
        for start in range(0, len(ids), _PLACES):
            stop = min(len(ids), start + _PLACES)
            if size and size + stop - start > _PLACES:
                which, around, target = places(waiting, reach, first, every)
                yield np.array(numbers)[which], around, target
                waiting, numbers, size = [], [], 0
            waiting.append((ids, start, stop))
            numbers.append(i)
            size += stop - start
    if waiting:
        which, around, target = places(waiting, reach, first, every)
        yield np.array(numbers)[which], around, target


def numbered(docs: DataFrame, words: list[bytes], id_col: str, text_col: str, spelled: Spelling | None = None) -> DataFrame:
    """One stored row per document with the numbers of its words and the log-probability of its rare words' spelling."""
    shared = docs.sparkSession.sparkContext.broadcast((words, spelled))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("part int, ids binary, spelled double").fields])

    def run(batches):
        known, rare = pa.array(shared.value[0], pa.large_binary()), shared.value[1]
        part = TaskContext.get().partitionId()
        for batch in batches:
            for (ids,), texts in rows_of(batch, "text", "doc_id"):
                own, starts = words_in(texts)
                found = pc.index_in(own, value_set=known)
                coded = pc.fill_null(pc.add(found, 2), OTHER).to_numpy().astype("<u2").tobytes()
                ends = starts.tolist()
                coded = [coded[2 * a : 2 * b] for a, b in zip(ends, ends[1:])]
                extra = np.zeros(len(texts))
                if rare:
                    before = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])
                    extra = rare.log_probs(own.filter(found.is_null()).to_numpy(zero_copy_only=False).tolist(), np.diff(before[starts]).tolist())
                yield [ids, pa.array([part] * len(texts), pa.int32()), coded, extra]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return checkpointed(arrow_map(rows, run, schema))


def train(stored: DataFrame, words: int, reach: int = 2, hidden: int = 16, rounds: int = 2, every: int = 1, rate: float = 2.0, batch: int = 2048) -> Network:
    """Network trained on all places of all documents in each round.

    A round takes ``every`` turns: each goes through one place in ``every``, the next turn through
    those behind them, and after each turn the weights are averaged over the tasks.
    """
    network = Network(words, reach, hidden)
    total = len(network.weights)
    for turn in range(rounds * every):
        shared = stored.sparkSession.sparkContext.broadcast(network.weights)

        def run(batches, shared=shared, turn=turn):
            own = Network(words, reach, hidden, shared.value)
            seen, part = 0, None
            for rows in batches:
                part = rows.column("part")[0].as_py() if rows.num_rows and part is None else part
                texts = [np.frombuffer(x, "<u2") for x in rows.column("ids").to_pylist()]
                left = None
                for _, around, target in in_blocks(texts, reach, turn % every, every):
                    if left is not None:
                        around, target = np.concatenate([left[0], around]), np.concatenate([left[1], target])
                    full = len(target) // batch * batch
                    for i in range(0, full, batch):
                        own.learn(around[i : i + batch], target[i : i + batch], rate)
                    seen += full
                    left = around[full:], target[full:]
                if left is not None and len(left[1]):
                    own.learn(*left, rate * len(left[1]) / batch)
                    seen += len(left[1])
            if seen:
                weights = own.weights
                blocks = range(0, total, _BLOCK)
                yield [[part] * len(blocks), list(blocks), [float(seen)] * len(blocks), [weights[i : i + _BLOCK].tobytes() for i in blocks]]

        means = arrow_map(stored, run, "part int, block int, seen double, mean binary")
        network = Network(words, reach, hidden, averaged(means, (stored.agg(F.max("part")).first()[0] or 0) + 1, network.weights))
    return network


def averaged(means: DataFrame, parts: int, before: np.ndarray) -> np.ndarray:
    """Mean of the tasks' weights by the places they saw, in groups of ``_FAN`` rows until one is left per block.

    The weights cross the shuffle in the 32 bits that they have, means of some of the tasks in 64.
    """

    def of(kind: str, made: str):
        def mean(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            seen = group["seen"].to_numpy()
            total = np.sum([np.frombuffer(x, kind).astype(np.float64) * n for x, n in zip(group["mean"], seen)], axis=0)
            return pd.DataFrame({"part": group["part"].iloc[:1], "block": group["block"].iloc[:1], "seen": [seen.sum()], "mean": [(total / seen.sum()).astype(made).tobytes()]})

        return mean

    kind = "<f4"
    while parts > 1:
        parts = -(-parts // _FAN)
        made = "<f8" if parts > 1 else "<f4"
        groups = means.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("part", "block")
        means, kind = groups.applyInPandas(of(kind, made), "part int, block int, seen double, mean binary"), made
    out = before.astype(np.float32)
    for row in means.collect():
        found = np.frombuffer(bytes(row["mean"]), "<f4")
        out[row["block"] : row["block"] + len(found)] = found
    return out


def pseudo_likelihood(
    docs: DataFrame, words: int = 4096, reach: int = 2, hidden: int = 16, rounds: int = 1, every: int = 2, often: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every row.

    ``log_prob`` is the sum over all words of the whole text of their log-probability given the
    words around them; ``words`` (at most 65,536) is the size of the vocabulary, all other words
    count as one. Null texts and those without a word have ``n_words`` 0, ``log_prob`` 0 and a null
    mean. Null ids and repeated rows give their own rows; extra columns are ignored; an empty
    table gives no rows. The last digits vary with the partitions of the input.
    """
    counted = checkpointed(counted_words(docs, text_col))
    size = min(_MOST_WORDS, max(words, counted.filter(F.col("n") >= often).count() + 2))
    known = most_frequent(counted, size)
    stored = numbered(docs, known, id_col, text_col, spelling(counted, known))
    network = train(stored, len(known) + 2, reach, hidden, rounds, every)
    return score(stored, network)


def score(stored: DataFrame, network: Network) -> DataFrame:
    """Scores of numbered documents."""
    settings = (len(network.inputs[0]), network.reach, network.hidden)
    shared = stored.sparkSession.sparkContext.broadcast(network.weights)
    schema = T.StructType([stored.schema["doc_id"], *T.StructType.fromDDL("n_words bigint, log_prob double, mean_log_prob double").fields])

    def run(batches):
        own = Network(*settings, shared.value)
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
            total = np.array(batch.column("spelled").to_pylist(), float)
            for which, around, target in in_blocks(texts, own.reach):
                total += np.bincount(which, own.log_probs(around, target), minlength=len(texts))
            counts = [len(t) for t in texts]
            yield [batch.column("doc_id"), counts, total, [t / n if n else None for t, n in zip(total.tolist(), counts)]]

    return arrow_map(stored, run, schema)
