"""Encoding with a SentencePiece vocabulary by a max-plus parallel scan, and decoding.

An encoding is a path through the lattice of the pieces of a text. Unigram models take the path
with the largest sum of piece scores (the first of equal sums by the longest last piece). BPE models
join neighbours by rank; a path is theirs exactly if every two neighbouring pieces, joined and
encoded by themselves, come out as these two again. So a BPE lattice has the same sums, with minus
infinity for two neighbours that do not stand beside each other, and just one path is finite: the
one that the library gives. A character that no piece covers is written as its bytes.

Giant texts are cut into chunks, before a space mark where the chunk has one: if no piece holds a
space mark behind another character, every path breaks there. Where a chunk has none, a path crosses
its end in the middle of a piece, and the states of the boundary are the pieces that can cross it
(for unigram models just how far they hang over). For each chunk of such a run a task works out the
transfer matrix: the best score from every state at its start to every state at its end. Matrices are
multiplied in max-plus arithmetic, which is associative: in groups of chunks first, then over the
groups of a run. The best state at every boundary follows, and with it each chunk finds its own
pieces, independent of all others. A chunk that begins and ends at breaks needs no scan.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from muster.llm import units
from muster.llm.batches import arrow_map, rows_of, stored

SPACE = "▁"
#: Chunks whose matrices are multiplied together before the groups of a text are.
GROUP = 64
#: What an uncovered character costs beyond the worst piece, as in SentencePiece.
UNKNOWN_COST = 10.0
#: Words up to this length go through the lattice many at a time, if at least so many have one length.
LONG_WORD, FEW_WORDS = 64, 8
#: Places times piece lengths of the words that are worked on together; it bounds their memory.
LATTICE_CELLS = 4_000_000
#: Words, and pairs of pieces, that a Python worker remembers.
WORDS_KEPT, PAIRS_KEPT = 500_000, 200_000
#: A character of private use, which no public vocabulary covers: it never joins with its neighbours.
APART = "\ue000"


class Lattice:
    """Pieces and scores of a model, and paths through texts already normalised.

    ``merges`` says whether the model is of the BPE kind; if it is not given, whole scores tell:
    BPE files hold ranks there and unigram files logarithms. The model's normalisation must leave
    normalised text as it is.
    """

    def __init__(self, path: str, merges: bool | None = None):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = np.array([model.get_score(i) for i in range(model.vocab_size())])
        self.longest = max(map(len, self.ids))
        self.unknown = float(self.scores[plain].min()) - UNKNOWN_COST
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        first_bytes = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])
        self.weights = self.scores.copy()
        self.weights[self.bytes] = np.where(first_bytes, self.unknown, 0.0)
        self.spelled = [model.id_to_piece(i).encode("utf-8") for i in range(model.vocab_size())]
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        # Without pieces that hold a space mark behind another character, a path always breaks before one.
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.merges = bool(np.all(self.scores == np.round(self.scores))) if merges is None else merges
        if self.merges:
            if APART in self.ids:
                raise ValueError("the vocabulary has a piece for a character of private use")
            self.before = len(model.encode(APART))
            self.beside = lru_cache(PAIRS_KEPT)(self._beside)
        else:
            self._make_trie()
        self.memo = units.Memo(self.code_many, WORDS_KEPT)

    def joined(self, words: list[str]) -> list[bytes]:
        """Ids that the library's merges give each word by itself, without a mark put before it."""
        coded = self.model.encode([APART + w.replace(SPACE, " ") for w in words], num_threads=1)
        return [units.ids_bytes(ids[self.before :]) for ids in coded]

    def _beside(self, a: str, b: str) -> bool:
        """True if the merges leave these two pieces as they are when they are neighbours."""
        apart = b"".join(self.code(t, [len(t)]) for t in (a, b))
        return self.joined([a + b])[0] == apart

    def _make_trie(self) -> None:
        """All pieces as one trie: sorted (node, character) keys, the node behind each, the piece at each node."""
        known = sorted({ord(c) for p in self.ids for c in p})
        code = {c: i + 1 for i, c in enumerate(known)}
        self.characters, self.width = np.array(known), len(known) + 1
        children: dict[int, int] = {}
        pieces = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                key = node * self.width + code[ord(c)]
                if key not in children:
                    children[key] = len(pieces)
                    pieces.append(-1)
                node = children[key]
            pieces[node] = i
        self.branches = np.array(sorted(children))
        self.behind = np.array([children[k] for k in self.branches.tolist()])
        self.piece_at = np.array(pieces, np.int32)
        # Number -1, no piece, finds the last entry.
        self.score_or_none = np.append(self.scores, -np.inf)
        self.score_or_unknown = np.append(self.scores, self.unknown)

    def edges(self, text: str, at: int) -> list[tuple[int, float]]:
        """Lengths and scores of the pieces that start here; an uncovered character is one of its own."""
        found = [(n, self.scores[i]) for n in range(1, min(self.longest, len(text) - at) + 1) for i in [self.ids.get(text[at : at + n])] if i is not None]
        return found if found and found[0][0] == 1 else [(1, self.unknown), *found]

    def best(self, text: str, start: int = 0, stop: int | None = None) -> list[int]:
        """Ends of the pieces of the best path from ``start`` to ``stop``."""
        stop = len(text) if stop is None else stop
        size = stop - start
        score, back = [-np.inf] * (size + 1), [0] * (size + 1)
        score[0] = 0.0
        ids, scores, longest, unknown = self.ids, self.scores, self.longest, self.unknown
        for at in range(size):
            base = score[at]
            covered = False
            for end in range(at + 1, min(at + longest, size) + 1):
                i = ids.get(text[start + at : start + end])
                if i is not None:
                    covered = covered or end == at + 1
                    if base + scores[i] > score[end]:
                        score[end], back[end] = base + scores[i], at
            if not covered and base + unknown > score[at + 1]:
                score[at + 1], back[at + 1] = base + unknown, at
        ends = []
        while size:
            ends.append(start + size)
            size = back[size]
        return ends[::-1]

    def code_many(self, words: list[str]) -> list[bytes]:
        """Ids of the path of every word; in unigram models, words of one length go through the trie and the lattice together."""
        if self.merges:
            return self.joined(words)
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths[lengths > 0]).tolist():
            same = np.flatnonzero(lengths == size).tolist()
            # A word that is far longer than the pieces is a text of its own.
            step = LATTICE_CELLS // (size * min(size, self.longest))
            if size > LONG_WORD or len(same) < FEW_WORDS:
                for i in same:
                    out[i] = self.code(words[i], self.best(words[i]))
                continue
            for start in range(0, len(same), step):
                some = same[start : start + step]
                for i, ids in zip(some, self._code_equal([words[i] for i in some], size)):
                    out[i] = ids
        return out

    def _code_equal(self, words: list[str], size: int) -> list[bytes]:
        """As ``code_many`` for words of ``size`` characters."""
        n, steps = len(words), min(size, self.longest)
        raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).T.ravel()
        at = np.minimum(np.searchsorted(self.characters, raw), len(self.characters) - 1)
        codes = np.where(self.characters[at] == raw, at + 1, 0)

        # piece[d - 1, p, w]: the piece of d characters at place p of word w. Places lie in rows, so d places on is d * n on.
        piece = np.full((steps, size * n), -1, np.int32)
        here, node = np.arange(size * n), np.zeros(size * n, np.int64)
        for d in range(steps):
            inside = here < (size - d) * n
            here, node = here[inside], node[inside]
            key = node * self.width + codes[here + d * n]
            at = np.minimum(np.searchsorted(self.branches, key), len(self.branches) - 1)
            on = self.branches[at] == key
            here, node = here[on], self.behind[at[on]]
            piece[d, here] = self.piece_at[node]
        piece = piece.reshape(steps, size, n)

        row = np.arange(n)
        score, back = np.zeros((size + 1, n)), np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            most = min(steps, end)
            # The longest last piece comes first, so that it wins among equal sums.
            sums = [score[end - d] + self.score_or_none[piece[d - 1, end - d]] for d in range(most, 1, -1)]
            sums = np.stack([*sums, score[end - 1] + self.score_or_unknown[piece[0, end - 1]]])
            best = sums.argmax(axis=0)
            score[end], back[end] = sums[best, row], most - best

        ids, left, odd, place = np.zeros((n, size), "<u4"), np.full(n, size), np.zeros(n, bool), np.full(n, size)
        ends = np.zeros((n, size), np.int64)
        while len(row):
            d = back[place[row], row]
            left[row] -= 1
            ends[row, left[row]] = place[row]
            place[row] -= d
            found = piece[d - 1, place[row], row]
            odd[row] |= found < 0
            ids[row, left[row]] = np.maximum(found, 0)
            row = row[place[row] > 0]
        raw = ids.tobytes()
        out = [raw[4 * (i * size + a) : 4 * (i + 1) * size] for i, a in enumerate(left.tolist())]
        # An uncovered character on the path is written as its bytes.
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.code(words[i], ends[i, left[i] :].tolist())
        return out

    def code(self, text: str, ends: list[int], start: int = 0) -> bytes:
        """Ids of the pieces between these ends, as little-endian 32-bit numbers."""
        out = []
        for a, b in zip([start, *ends], ends):
            i = self.ids.get(text[a:b])
            out += [i] if i is not None else [self.bytes[x] for x in text[a:b].encode("utf-8")]
        return units.ids_bytes(out)

    def words(self, text: str) -> list[str]:
        """The text cut before each space mark that follows another character."""
        parts = text.split(SPACE)
        words, run = [parts[0]] if parts[0] else [], 1
        for i, p in enumerate(parts[1:], 1):
            if p or i == len(parts) - 1:
                words.append(SPACE * run + p)
                run = 1
            else:
                run += 1
        return words

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; words repeat, so each is worked out once."""
        cut = [self.words(t) if self.breaks else [t] if t else [] for t in texts]
        return [b"".join(v) for v in self.memo.values(cut)]

    def between(self, text: str, start: int, stop: int) -> bytes:
        """Ids of the path from one place to another of a text."""
        return self.encode_all([text[start:stop]])[0] if self.breaks or self.merges else self.code(text, self.best(text, start, stop), start)

    def score(self, ids: np.ndarray) -> float:
        """Sum of the scores of the pieces; an uncovered character counts once."""
        return float(self.weights[ids].sum())

    def is_break(self, text: str, at: int) -> bool:
        """True at both ends of a text and, if paths always break there, before its space marks behind other characters."""
        return at in (0, len(text)) or self.breaks and text[at] == SPACE and text[at - 1] != SPACE

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """How far the pieces that can hold the character before ``at`` begin before it and end behind it.

        At a break there is one state. Unigram paths do not ask where the crossing piece began, so
        that is 0 there.
        """
        if self.is_break(text, at):
            return [(0, 0)]
        found = [(at - a, a + n - at) for a in range(max(0, at - self.longest), at) for n, _ in self.edges(text, a) if a + n >= at]
        return sorted(set(found) if self.merges else {(0, n) for _, n in found})

    def transfer(self, text: str, start: int, stop: int) -> np.ndarray:
        """Best score from every state at ``start`` to every state at ``stop``.

        ``text`` goes on before and behind the chunk by the length of the longest piece, or to the
        ends of the whole text. Where paths break, all of them pass through the breaks, so only the
        stretches before the first and behind the last break are walked.
        """
        inner = [p for p in (text.find(SPACE, start + 1, stop), self._last_break(text, start, stop)) if p > start and self.is_break(text, p)]
        if len(inner) < 2:
            return self.walk(text, start, stop)
        first, last = inner
        middle = self.score(np.frombuffer(self.between(text, first, last), "<u4")) if last > first else 0.0
        return self.walk(text, start, first)[:, :1] + middle + self.walk(text, last, stop)[:1, :]

    def _last_break(self, text: str, start: int, stop: int) -> int:
        """The last break between two places, or ``start``."""
        at = text.rfind(SPACE, start + 1, stop) if self.breaks else -1
        while at > start and text[at - 1] == SPACE:
            at -= 1
        return max(at, start)

    def walk(self, text: str, start: int, stop: int) -> np.ndarray:
        """The transfer matrix, character by character."""
        begin, end = self.states(text, start), self.states(text, stop)
        # Behind every place, the pieces that end there by where they begin, each with its best score from every state.
        ending: dict[int, dict[int, np.ndarray]] = {}
        for s, (before, behind) in enumerate(begin):
            known = ending.setdefault(start + behind, {})
            known[start - before] = np.where(np.arange(len(begin)) == s, 0.0, known.get(start - before, -np.inf))
        at_break = self.is_break(text, start)
        for at in range(start, stop):
            here = ending.pop(at, None)
            if here is None:
                continue
            for n, x in self.edges(text, at):
                free = not self.merges or at == start and at_break
                scores = [v for a, v in here.items() if free or self.beside(text[a:at], text[at : at + n])]
                if scores:
                    there, key = ending.setdefault(at + n, {}), at if self.merges else 0
                    best = np.maximum.reduce(scores) + x
                    there[key] = np.maximum(there[key], best) if key in there else best
        table = np.full((len(begin), len(end)), -np.inf)
        for place, known in ending.items():
            for a, v in known.items():
                state = (0, 0) if end == [(0, 0)] else (stop - a if self.merges else 0, place - stop)
                if state in end:
                    table[:, end.index(state)] = np.maximum(table[:, end.index(state)], v)
        return table

    def cut(self, text: str, chars: int) -> list[tuple[int, int, int, int]]:
        """``start, stop, run, runs``: chunks of at most ``chars`` characters, the chunk in which their run began and its length.

        A run goes from one break to the next that ends a chunk.
        """
        stops, runs = [0], [0]
        while stops[-1] < len(text):
            start = stops[-1]
            stop = min(start + chars, len(text))
            if not self.is_break(text, stop):
                inner = self._last_break(text, start, stop)
                stop = inner if inner > start and self.is_break(text, inner) else stop
            stops.append(stop)
            runs.append(len(stops) - 1 if self.is_break(text, stop) else runs[-1])
        sizes = Counter(runs[:-1])
        return [(a, b, r, sizes[r]) for a, b, r in zip(stops, stops[1:], runs)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the pieces, space marks still in it."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def trace(matrices: list[np.ndarray], first: int, last: int) -> list[tuple[int, int]]:
    """State at the start and end of each matrix on the best path from ``first`` to ``last``."""
    ahead = list(accumulate(matrices, lambda v, m: (v[:, None] + m).max(axis=0), initial=np.where(np.arange(len(matrices[0])) == first, 0.0, -np.inf)))
    states = [last]
    for v, m in zip(ahead[-2::-1], matrices[::-1]):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    states.reverse()
    return list(zip(states, states[1:]))


def lattice(path: str, merges: bool | None = None) -> Lattice:
    return units.worker(("lattice", path, merges), lambda: Lattice(path, merges))


def encode(docs: DataFrame, model_path: str, chunk_chars: int = 16_384, id_col: str = "doc_id", text_col: str = "text", merges: bool | None = None) -> DataFrame:
    """``doc_id, row_id, chunk, n_chunks, ids, score``: the ids of every chunk of every text.

    ``row_id`` tells rows apart whose ids are null or repeated. The ids of a text are those of its
    chunks in order: for BPE models the library's own, for unigram models those of a best path. Null
    and empty texts have one chunk without ids. Repeated rows are texts of their own; other columns
    are ignored; an empty table gives no rows. ``ids`` are little-endian 32-bit numbers.
    ``merges`` is explained at ``Lattice``.
    """
    spark = docs.sparkSession
    fields = "row_id bigint, chunk bigint, n_chunks bigint, ids binary, score double"
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(fields).fields])
    cut_schema = T.StructType([*out.fields, *T.StructType.fromDDL("run bigint, runs bigint, before int, behind int, text string").fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        book, part, row = lattice(model_path, merges), TaskContext.get().partitionId(), 0
        for batch in batches:
            for (ids,), texts in rows_of(batch, "text", "doc_id"):
                marked = [book.model.normalize(t) if t else "" for t in texts]
                short = [t if len(t) <= chunk_chars else "" for t in marked]
                coded = book.encode_all(short)
                where, columns = [], []
                for i, (t, c) in enumerate(zip(marked, coded)):
                    number = (part << 40) + row
                    row += 1
                    if len(t) <= chunk_chars:
                        where.append(i)
                        columns.append((number, 0, 1, c, book.score(np.frombuffer(c, "<u4")), 0, 1, 0, 0, None))
                        continue
                    chunks = book.cut(t, chunk_chars)
                    for k, (start, stop, run, size) in enumerate(chunks):
                        # Only a chunk that a path may cross has to see what is around it.
                        a, b = (max(0, start - book.longest - 1), min(len(t), stop + book.longest + 1)) if size > 1 else (start, stop)
                        where.append(i)
                        columns.append((number, k, len(chunks), None, None, run, size, start - a, b - stop, t[a:b]))
                yield [ids.take(pa.array(where, pa.int64())), *zip(*columns)]

    # Stored, as the numbers of the rows must stay the same for all that follows.
    first = stored(arrow_map(rows, cut, cut_schema), "chunks")
    short = first.filter("n_chunks = 1").select(*out.names)
    # Chunks of one giant text lie together; they are spread over the tasks.
    chunks = first.filter("n_chunks > 1").select("doc_id", "row_id", "chunk", "n_chunks", "run", "runs", "before", "behind", "text")
    closed = chunks.filter("runs = 1").withColumns({"first": F.lit(0).cast("bigint"), "last": F.lit(0).cast("bigint")}).repartition("row_id", "chunk")
    crossed = chunks.filter("runs > 1").repartition("row_id", "chunk")

    def matrices(batches):
        book = lattice(model_path, merges)
        for batch in batches:
            for (row, chunk, run, before, behind), texts in rows_of(batch, "text", "row_id", "chunk", "run", "before", "behind"):
                places = [(t, a, len(t) - b) for t, a, b in zip(texts, before.to_pylist(), behind.to_pylist())]
                tables = [book.transfer(*p) for p in places]
                ends = [[n for _, n in book.states(t, stop)] for t, _, stop in places]
                yield [row, chunk, run, [len(t) for t in tables], [t.tobytes() for t in tables], ends]

    tables = stored(arrow_map(crossed, matrices, "row_id bigint, chunk bigint, run bigint, states int, matrix binary, ends array<int>"), "matrices")
    tables = tables.withColumn("part", F.floor((F.col("chunk") - F.col("run")) / GROUP))
    # A stated number of tasks: the matrices are small in bytes, not in work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def as_matrices(group):
        return [np.frombuffer(raw).reshape(n, -1) for raw, n in zip(group["matrix"], group["states"])]

    def multiply(group):
        group = group.sort_values("chunk")
        total = reduce(product, as_matrices(group))
        return group.iloc[:1].assign(matrix=total.tobytes())[["row_id", "run", "part", "states", "matrix"]]

    def over_parts(group):
        group = group.sort_values("part")
        # A run begins and ends at breaks, where there is one state.
        states = trace(as_matrices(group), 0, 0)
        return group.assign(first=[a for a, _ in states], last=[b for _, b in states])[["row_id", "run", "part", "first", "last"]]

    def over_chunks(group):
        group = group.sort_values("chunk")
        states = trace(as_matrices(group), int(group["first"].iloc[0]), int(group["last"].iloc[0]))
        return group.assign(first_state=[a for a, _ in states], last_state=[b for _, b in states])[["row_id", "chunk", "first_state", "last_state"]]

    keys = "row_id bigint, run bigint, part bigint"
    spread = tables.repartition(tasks, "row_id", "run", "part")
    parts = spread.groupBy("row_id", "run", "part").applyInPandas(multiply, f"{keys}, states int, matrix binary")
    ends = parts.repartition(tasks, "row_id", "run").groupBy("row_id", "run").applyInPandas(over_parts, f"{keys}, first bigint, last bigint")
    placed = spread.join(ends, ["row_id", "run", "part"]).groupBy("row_id", "run", "part")
    states = placed.applyInPandas(over_chunks, "row_id bigint, chunk bigint, first_state bigint, last_state bigint")
    # How far the piece of a boundary's state hangs over: from the list of the chunk that the boundary ends.
    hang = tables.select("row_id", "chunk", "run", "ends").join(states, ["row_id", "chunk"])
    hang = hang.select("row_id", "chunk", "run", F.get("ends", F.col("last_state")).cast("bigint").alias("last"))
    previous = hang.select("row_id", (F.col("chunk") + 1).alias("chunk"), "run", F.col("last").alias("first"))
    hang = hang.join(previous, ["row_id", "chunk", "run"], "left").select("row_id", "chunk", F.coalesce("first", F.lit(0)).cast("bigint").alias("first"), "last")
    opened = crossed.join(hang, ["row_id", "chunk"])

    def back(batches):
        book = lattice(model_path, merges)
        for batch in batches:
            for (doc, row, chunk, n, *columns), texts in rows_of(batch, "text", "doc_id", "row_id", "chunk", "n_chunks", "before", "behind", "first", "last"):
                before, behind, first_, last_ = (c.to_pylist() for c in columns)
                coded = [book.between(t, a + f, len(t) - b + s) for t, a, b, f, s in zip(texts, before, behind, first_, last_)]
                yield [doc, row, chunk, n, coded, [book.score(np.frombuffer(c, "<u4")) for c in coded]]

    return short.unionByName(arrow_map(closed, back, out)).unionByName(arrow_map(opened, back, out))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``text``: the normalised text of each chunk's ids, spaces for space marks.

    The mark that SentencePiece puts before a text is taken off the first chunk. The texts of a
    row's chunks in order are its normalised text.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        book = lattice(model_path)
        dummy = book.model.normalize("a").startswith(SPACE)
        for batch in batches:
            said = [book.decode(np.frombuffer(c, "<u4")).replace(SPACE, " ") for c in batch.column("ids").to_pylist()]
            texts = [t[1:] if k == 0 and dummy else t for k, t in zip(batch.column("chunk").to_pylist(), said)]
            yield [*batch.columns, texts]

    return arrow_map(encoded, run, schema)
