"""Concatenate and cut: all documents in a row, cut into sequences of the same length.

Two passes. The first encodes every document once and stores its ids in the shared folder,
partition by partition. The token totals of the partitions (one number each) give, by a prefix
sum, the place at which every partition starts in the whole row of tokens. In the second pass
each task adds up its own documents from that place on and cuts them at every multiple of the
sequence length; a document that crosses such a boundary gives one record on either side.
Only the last sequence of all can be shorter than the others.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from muster.llm import units
from muster.llm.batches import rows_of
from muster.session import checkpointed

#: Ids of one output batch; bounds what a task holds besides its longest document.
BATCH_IDS = 2_000_000


#: Settings of a tokenizers file under which a run of letters is a pretoken of its own, in lower case.
_LETTERS_ALONE = {
    "version": "1.0",
    "truncation": None,
    "padding": None,
    "added_tokens": 0,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
    "model": 0,
}


class WordBpe:
    """Ids of whole texts under a tokenizers file, as 16- or 32-bit bytes.

    Under the settings ``_LETTERS_ALONE`` white space is dropped and nothing is joined across a space or
    a line feed, so words are the units. New words of plain letters, with or without a mark behind
    them, are merged many at a time by the file's own merge list; all others go to the library.
    Under any other settings every text goes to the library whole.
    """

    # Letters of Latin blocks, whose classes and lower case all versions of Unicode agree on.
    _PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,!?;:]?)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo = units.Memo(self._new)
        self.merges, self.marks = None, {}
        if json.loads(self.tokenizer.to_str()) | {"model": 0, "added_tokens": 0} == _LETTERS_ALONE:
            self.merges = units.Merges(json.loads(self.tokenizer.to_str())["model"], units.byte_alphabet())
            self.marks = dict(zip(["", *".,!?;:"], self._library(["", *".,!?;:"])))

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _library(self, words: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        found = [self.merges and self._PLAIN.fullmatch(w) for w in words]
        plain = [m[1].lower().encode("utf-8") for m in found if m]
        merged, other = iter(self.merges.ids(plain, self.kind) if plain else []), iter(self._library([w for w, m in zip(words, found) if not m]))
        return [next(merged) + self.marks[m[2]] if m else next(other) for m in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merges is None:
            return self._library(texts)
        whole = [any(s in t for s in self.added) for t in texts]
        words = [[] if w else t.replace("\n", " ").split(" ") for t, w in zip(texts, whole)]
        joined = map(b"".join, self.memo.values(words))
        return [self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) if w else b for t, w, b in zip(texts, whole, joined)]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One stored row per document: partition, id and the ids as bytes, the end id included."""
    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", key), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        coder = units.worker(("word", tokenizer_path), lambda: WordBpe(tokenizer_path))
        end = np.array([end_id], coder.kind).tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for (ids,), texts in rows_of(batch, "text", "id"):
                n = len(texts)
                coded = [b + end for b in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), ids, pa.array([coder.kind.itemsize] * n, pa.int32()), pa.array(coded, pa.binary())], schema=arrow)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return checkpointed(rows.mapInArrow(run, schema))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of ``length`` tokens.

    Returns ``doc_id`` (the id column's values), ``start`` (ids of the document before the
    piece), ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence) and
    ``ids``, the piece itself as little-endian unsigned 32-bit numbers. Every id of every
    document is in exactly one piece.

    A null text counts as empty and an empty text is its end id alone. Repeated rows and null
    ids are documents of their own. Other columns are ignored whatever their names. An empty
    table gives no pieces. The order of documents is that of the input's partitions.
    """
    stored = encoded(docs, tokenizer_path, end_id, id_col, text_col)
    totals = stored.groupBy("part").agg(F.sum(F.octet_length("ids") / F.col("width")).cast("long").alias("n")).collect()
    # One number per input partition.
    base, at = {}, 0
    for part, n in sorted(map(tuple, totals)):
        base[part] = at
        at += n
    starts = docs.sparkSession.sparkContext.broadcast(base)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def cut(batches):
        at: dict[int, int] = {}
        for batch in batches:
            parts, widths = batch.column("part").to_pylist(), batch.column("width").to_pylist()
            rows, taken, size = [], [], 0
            for i, coded in enumerate(batch.column("ids").to_pylist()):
                ids = np.frombuffer(coded, f"<u{widths[i]}").astype("<u4")
                n, first = len(ids), at.setdefault(parts[i], starts.value[parts[i]])
                at[parts[i]] = first + n
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    stop = min(n, start + length - offset)
                    rows.append((start, stop - start, n, sequence, offset, ids[start:stop].tobytes()))
                    taken.append(i)
                    start = stop
                size += n
                if size >= BATCH_IDS:
                    yield piece_batch(batch, rows, taken)
                    rows, taken, size = [], [], 0
            yield piece_batch(batch, rows, taken)

    def piece_batch(batch, rows, taken):
        keys = batch.column("id").take(pa.array(taken, pa.int64()))
        columns = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]], schema=arrow)

    return stored.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences with their ids in order; at most one sequence's pieces meet in a group."""
    piece = F.struct("offset", "ids", "doc_id")
    ordered = F.array_sort(F.collect_list(piece))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"])).alias("pieces"),
    )
