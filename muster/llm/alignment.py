"""Alignment of the tokens that two tokenizers cut from the same bytes.

The texts of a batch lie on one line of bytes, one after the other. Each token start looks up the
other side's token that covers it (``merge_asof``, keyed by document); both directions together are
all overlaps. Where tokens of both sides end at the same byte, a group ends.

For counts over all documents, a block of texts becomes one row: the distinct id pairs of the block
with the number of its documents that link them, and each document's pairs as positions in that
list. Only the blocks' distinct pairs are shuffled and added up; the sums come back to their block
as one list in the same order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from muster.functions.common import lookup_join
from muster.llm import units
from muster.llm.batches import arrow_map, slices, stored

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Bytes of text that are aligned together.
BLOCK_BYTES = 800_000
#: Pairs that are expanded at a time, and links of a group from which equal ids are counted first.
PAIRS, LONG_GROUP = 4_000_000, 1024
#: Different words that a task keeps the ids of.
WORDS = 300_000


class Side:
    """One tokenizer: ids of texts, and the bytes that stand for every id.

    Where it is certain that the tokenizer cuts before single spaces and line feeds, each
    different word is encoded once, checked against its bytes and kept in a table; the ids
    of a text are then gathered from that table. All other texts go to the library whole.
    """

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
            self.bytes = [self._piece(i, p) for i, p in enumerate(pieces)]
            inside = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
            self.by_words = not inside and self.model.normalize("a  ｂ") == f"{SPACE}a{SPACE}{SPACE}ｂ"
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.model.encode_special_tokens = True
            letters = {c: b for b, c in units.byte_alphabet().items()}
            pieces = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size())]
            self.bytes = [bytes(letters[c] for c in p) if p and all(c in letters for c in p) else (p or "").encode() for p in pieces]
            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            cutter = made.get("pre_tokenizer") or {}
            self.by_words = made.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        # What stands in front of an id in the text of the groups, by the sign.
        self.said = [f"{sign}{i}" for sign in (",", ";", "|", "") for i in range(len(pieces))]
        self.forget()

    def _piece(self, i: int, piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece) if self.model.is_byte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def forget(self) -> None:
        self.table, self.lens, self.good = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, bool)]

    def _encode(self, keys: list) -> tuple[list[list[int]], list[bytes]]:
        """Ids and bytes of words, and of whole texts given as tuples; a space stands before all but a line feed's word."""
        bare = [type(k) is str and k[0] == "\n" for k in keys]
        texts = [k if type(k) is str else k[0] for k in keys]
        full = [t if b else " " + t for t, b in zip(texts, bare)]
        raw = [t.encode("utf-8", "surrogatepass") for t in full]
        if not self.piece:
            return [e.ids for e in self.model.encode_batch_fast(full, add_special_tokens=False)], raw
        # The model puts the space in front itself, as a piece of its own before a line feed.
        return [ids[1:] if b else ids for ids, b in zip(self.model.encode(texts, num_threads=1), bare)], raw

    def learn(self, keys: list) -> None:
        """Append the ids of new words and texts to the tables, in their order."""
        for start in range(0, len(keys), 10_000):
            coded, raw = self._encode(keys[start : start + 10_000])
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.int32, lens.sum())
            sizes = np.bincount(np.repeat(np.arange(len(coded)), lens), self.sizes[ids], len(coded))
            good = sizes == np.fromiter(map(len, raw), np.int64, len(raw))
            if not good.all() or b"".join(map(self.bytes.__getitem__, ids.tolist())) != b"".join(raw):
                good = np.array([b"".join([self.bytes[t] for t in x]) == r for x, r in zip(coded, raw)], bool)
            self.table.append(ids)
            self.lens.append(lens)
            self.good.append(good)
        self.table, self.lens, self.good = ([np.concatenate(x)] for x in (self.table, self.lens, self.good))

    def gather(self, numbers: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``n`` texts in a row, how many each has, and whether they give its bytes back."""
        all_lens = self.lens[0]
        lens = all_lens[numbers]
        good = np.ones(n, bool)
        good[text[~self.good[0][numbers]]] = False
        shift = (np.cumsum(all_lens) - all_lens)[numbers] - (np.cumsum(lens) - lens)
        ids = self.table[0][np.repeat(shift, lens) + np.arange(lens.sum())]
        return ids, np.bincount(text, lens, n).astype(np.int64), good


class Pair:
    """Two sides with one numbering of the words that both of them cut alike."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = (Side(path_a), Side(path_b))
        self.by_words = all(side.by_words for side in self.sides)
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict = defaultdict()
        # An unknown word gets the next number as it is looked up.
        self.known.default_factory = self.known.__len__
        for side in self.sides:
            side.forget()

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``Side.gather`` of both sides."""
        if len(self.known) > WORDS or len(self.sides[0].table[0]) > 10 * WORDS:
            self._forget()
        before, number = len(self.known), self.known.__getitem__
        words = [t.replace("\n", " \n").split(" ") if self.by_words and units.plain_spaces(t) else [(t,)] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(number, chain.from_iterable(words)), np.int64, counts.sum())
        new = list(islice(self.known, before, None))
        text = np.repeat(np.arange(len(texts)), counts)
        for side in self.sides:
            side.learn(new)
        return [side.gather(numbers, text, len(texts)) for side in self.sides]


class Batch:
    """Tokens of a batch of texts under two tokenizers, on one line of bytes.

    ``doc``, ``ids``, ``starts`` and ``ends`` have one array per side. A document whose bytes a side does not
    give back has no tokens.
    """

    def __init__(self, texts: list[str | None], pair: Pair):
        some = [i for i, t in enumerate(texts) if t]
        coded = pair.read([texts[i] for i in some])
        same = coded[0][2] & coded[1][2]
        self.n, self.said = len(texts), [side.said for side in pair.sides]
        self.kept = np.array(some, np.int64)[same]
        self.ids, self.doc, self.starts, self.ends = [], [], [], []
        for side, (ids, counts, _) in zip(pair.sides, coded):
            ids = ids[np.repeat(same, counts)].astype(np.int64)
            sizes = side.sizes[ids]
            ends = np.cumsum(sizes)
            self.ids.append(ids)
            self.doc.append(np.repeat(np.arange(len(self.kept)), counts[same]))
            self.ends.append(ends)
            self.starts.append(ends - sizes)
        # Both sides give back the same bytes, so either tells where a document begins.
        self.base = self.starts[0][np.searchsorted(self.doc[0], np.arange(len(self.kept)))]
        # A group ends where tokens of both sides end.
        self.cuts = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        self.group = [np.searchsorted(self.cuts, e) for e in self.ends]
        self.cut_doc = np.searchsorted(self.base, self.cuts, side="left") - 1

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (a, b) of all tokens that share a byte: what covers each token's start, from both sides."""
        frames = [pd.DataFrame({"doc": d, "at": s, side: np.arange(len(s)), f"{side}_at": s}) for d, s, side in zip(self.doc, self.starts, "ab")]
        to_b = pd.merge_asof(frames[0][["doc", "at", "a"]], frames[1][["doc", "at", "b"]], on="at", by="doc")
        to_a = pd.merge_asof(frames[1][["doc", "at", "b"]], frames[0], on="at", by="doc")
        # Tokens that start together are found from both sides; they count once.
        to_a = to_a[to_a["at"] != to_a["a_at"]]
        return np.concatenate([to_b["a"], to_a["a"]]), np.concatenate([to_b["b"], to_a["b"]])

    def in_docs(self, values: np.ndarray) -> np.ndarray:
        """Counts per kept document, spread over all documents of the batch."""
        out = np.zeros(self.n, np.int64)
        out[self.kept] = values
        return out

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        if weights is None:
            return self.in_docs(np.bincount(doc, minlength=len(self.kept)))
        sums = np.zeros(len(self.kept), np.int64)
        np.add.at(sums, doc, weights)
        return self.in_docs(sums)

    def group_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(g, minlength=len(self.cuts)) for g in self.group)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every document; empty without tokens."""
        na, nb = self.group_sizes()
        first = [np.cumsum(na) - na, np.cumsum(nb) - nb]
        sign = [np.zeros(len(g), np.int64) for g in self.group]
        sign[0][first[0]], sign[1][first[1]] = 1, 2
        opening = np.ones(len(self.cuts), bool)
        opening[1:] = self.cut_doc[1:] != self.cut_doc[:-1]
        sign[0][first[0][opening]] = 3
        # Groups follow each other, each with its first side's tokens, then its second side's.
        words = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        for side, before in ((0, first[1][self.group[0]]), (1, (first[0] + na)[self.group[1]])):
            said = self.said[side]
            code = sign[side] * (len(said) // 4) + self.ids[side]
            words[np.arange(len(code)) + before] = list(map(said.__getitem__, code.tolist()))
        words = words.tolist()
        per = self.in_docs(np.bincount(self.doc[0], minlength=len(self.kept)) + np.bincount(self.doc[1], minlength=len(self.kept)))
        ends = np.cumsum(per)
        return ["".join(words[start:end]) for start, end in zip((ends - per).tolist(), ends.tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, key, times)`` of the distinct id pairs whose tokens share a group; key is ``a << 32 | b``.

        Ids that a long group holds several times count first, so it costs its distinct ids.
        """
        sides = [(g, i, np.ones(len(i), np.int64)) for g, i in zip(self.group, self.ids)]
        na, nb = self.group_sizes()
        if len(na) and (na * nb).max() > LONG_GROUP:
            sides = [self._distinct(g, i) for g, i in zip(self.group, self.ids)]
        (ga, ia, ca), (gb, ib, cb) = sides
        nb = np.bincount(gb, minlength=len(self.cuts))
        start_b, per_a = np.cumsum(nb) - nb, nb[ga]
        total, begin, out = np.cumsum(per_a), 0, []
        while begin < len(ga):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
            n = per_a[begin:end]
            a = np.repeat(np.arange(begin, end), n)
            b = start_b[ga[a]] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            out.append(self._summed(self.cut_doc[ga[a]], ia[a] << 32 | ib[b], ca[a] * cb[b]))
            begin = end
        if len(out) == 1:
            return out[0]
        return self._summed(*[np.concatenate(x) for x in zip(*out)]) if out else (np.empty(0, np.int64),) * 3

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(group << 32 | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    @staticmethod
    def _summed(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal pairs of a document added up; documents and keys ascending."""
        keys = np.unique(key)
        place = doc * len(keys) + np.searchsorted(keys, key)
        if (times == 1).all():
            place, times = np.unique(place, return_counts=True)
        elif len(place):
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(place[order]) != 0))
            place, times = place[order][first], np.add.reduceat(times[order], first)
        return place // max(len(keys), 1), keys[place % max(len(keys), 1)], times


def _pair(path_a: str, path_b: str) -> Pair:
    return units.worker(("align", path_a, path_b), lambda: Pair(path_a, path_b))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends, overlap_a, overlap_b, group_ends`` of every row.

    The tokens are those of a space and the text: a byte-level file (``.json``) gets the space in front, a
    SentencePiece model (``.model``) adds it itself. Special strings in a text are plain text. Ends are byte offsets
    behind tokens; ``overlap_a[i]`` and ``overlap_b[i]`` are the positions of two tokens that share a byte;
    ``group_ends`` are the offsets where tokens of both sides end.

    A null or empty text, and one whose bytes either side does not give back (some models
    normalise), has empty lists. Rows with null or repeated ids give a row each; other columns are ignored.
    """
    rows = _texts(docs, id_col, text_col)
    lists = "a_ids array<int>, b_ids array<int>, a_ends array<bigint>, b_ends array<bigint>, overlap_a array<int>, overlap_b array<int>, group_ends array<bigint>"
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(lists)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                tokens = Batch(part.column("text").to_pylist(), _pair(path_a, path_b))
                counts = [tokens.per_doc(d) for d in tokens.doc]
                ends = [e - tokens.base[d] for e, d in zip(tokens.ends, tokens.doc)]
                a, b = tokens.overlaps()
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = [np.searchsorted(d, np.arange(len(tokens.kept))) for d in tokens.doc]
                doc = tokens.doc[0][a]
                n_overlaps = tokens.per_doc(doc)
                yield [
                    part.column("doc_id"),
                    *[_lists(x, n, pa.int32()) for x, n in zip(tokens.ids, counts)],
                    *[_lists(x, n, pa.int64()) for x, n in zip(ends, counts)],
                    _lists(a - first[0][doc], n_overlaps, pa.int32()),
                    _lists(b - first[1][doc], n_overlaps, pa.int32()),
                    _lists(tokens.cuts - tokens.base[tokens.cut_doc], tokens.per_doc(tokens.cut_doc), pa.int64()),
                ]

    return arrow_map(rows, run, schema)


#: Columns of a document that need no other document.
_OWN = [T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_overlaps", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())]


def _blocks(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of texts: its documents, its distinct pairs, and every document's pairs in them."""
    own = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in [rows.schema["doc_id"], *_OWN]]
    schema = T.StructType([*own, *T.StructType.fromDDL("keys array<bigint>, docs array<bigint>, places binary, times binary, counts binary")])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                if not part.num_rows:
                    continue
                tokens = Batch(part.column("text").to_pylist(), _pair(path_a, path_b))
                na, nb = tokens.group_sizes()
                said = tokens.group_texts()
                doc, key, times = tokens.pairs()
                keys, places, docs = np.unique(key, return_inverse=True, return_counts=True)
                columns = [
                    part.column("doc_id"),
                    *[tokens.per_doc(d) for d in tokens.doc],
                    tokens.per_doc(tokens.doc[0][tokens.overlaps()[0]]),
                    tokens.per_doc(tokens.cut_doc),
                    tokens.per_doc(tokens.cut_doc, na * nb),
                    [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said],
                ]
                lists = [[c.to_pylist() if isinstance(c, pa.Array) else c] for c in columns]
                blobs = [places.astype("<u4"), times.astype("<u8"), tokens.per_doc(doc).astype("<u4")]
                yield [*lists, [keys], [docs], *[[x.tobytes()] for x in blobs]]

    return arrow_map(rows, run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``key, n, best``: documents that link a pair, and whether no pair with the same first id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("keys", "docs")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.docs").alias("n"))
    counts = stored(pairs, "aligned-pairs")
    most = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("_most"))
    found = lookup_join(counts.withColumn("a", F.shiftright("key", 32)), most, ["a"])
    return found.select("key", "n", (F.col("n") == F.col("_most")).alias("best"))


def linked_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_overlaps, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row.

    Tokens, overlaps and groups are those of ``align``. A link is a pair of tokens of both sides in one group.
    The count of an id pair is the number of rows that link it, over all rows; ``count_sum`` adds
    it over a row's links, and ``n_best`` counts links whose pair has the highest count of its
    first id, ties included. ``groups_sha256`` digests the groups as ``a1,a2|b1;a3|b2,b3``; without
    tokens it is empty and all numbers are 0. Edge cases are as in ``align``; repeated rows count each.
    """
    blocks = stored(_blocks(_texts(docs, id_col, text_col), path_a, path_b).withColumn("block", F.monotonically_increasing_id()), "aligned-blocks")
    asked = blocks.select("block", F.posexplode("keys").alias("at", "key"))
    counted = lookup_join(asked, pair_counts(blocks), ["key"])
    # At most as many as a block has tokens: a block is one long text or some megabytes of short ones.
    back = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("found"))
    rows = blocks.drop("keys", "docs").join(back.select("block", F.col("found.n").alias("n"), F.col("found.best").alias("best")), "block", "left")
    own = ["doc_id", *[f.name for f in _OWN]]
    out = T.StructType([T.StructField("doc_id", blocks.schema["doc_id"].dataType.elementType), *_OWN, *T.StructType.fromDDL("n_best bigint, count_sum bigint")])

    def finish(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                places, times, counts = [np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("places", "<u4"), ("times", "<u8"), ("counts", "<u4"))]
                n, best = [one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "best")]
                doc = np.repeat(np.arange(len(counts)), counts)
                sums = [np.zeros(len(counts), np.int64) for _ in range(2)]
                if len(places):
                    times = times.astype(np.int64)
                    np.add.at(sums[0], doc, np.where(best[places], times, 0))
                    np.add.at(sums[1], doc, times * n[places])
                yield [one.column(c).flatten() for c in own] + sums

    return arrow_map(rows.select(*own, "places", "times", "counts", "n", "best"), finish, out)
