"""Chat formatting on the level of tokens.

A turn becomes the ids of its role and of its text, each encoded on its own, with three reserved
ids around them that no text can produce:

    <|turn|> role <|text|> text <|end|>

Control strings that occur inside a role or a text are escaped, so the rendered text can be read
back as well. Positions in a conversation are prefix sums of the turns' lengths; the loss mask is
the range of positions of each assistant text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from muster.functions.common import lookup_join
from muster.llm import units
from muster.llm.batches import arrow_map, rows_of
from muster.session import checkpointed

#: Strings of the template, each one reserved id behind the vocabulary.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: What is escaped inside texts: the escape sign itself and strings that chat templates use.
CONTROL = r"\\|<\|[A-Za-z_]+\|>|</?s>|<unk>|<pad>|\[/?INST\]|<</?SYS>>"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """A backslash is doubled; in a control string one is put behind the first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Coder:
    """Texts to ids and back, under a byte-level BPE file; special strings in texts are plain text."""

    def __init__(self, path: str):
        self.encoder = units.ByteLevel(path, units.ids_bytes, special=False)
        vocabulary, alphabet = self.encoder.tokenizer.get_vocab(), {c: b for b, c in units.byte_alphabet().items()}
        self.size = max(vocabulary.values()) + 1
        self.pieces = [b""] * self.size
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode("utf-8")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.encoder.values(texts)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8")


def format_turns(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, ids, offset, n_ids, mask_start, mask_stop``.

    ``ids`` are the turn's ids as little-endian 32-bit numbers, reserved ids included; ``offset``
    is their place in the conversation. ``mask_start`` to ``mask_stop`` (exclusive, places in the
    conversation) is the turn's loss mask: the ids of its text, if ``loss_role`` says it; else
    null. Turns are ordered by ``turn``, then role, then text; null turns come first.

    Null texts and roles count as empty. Repeated rows are turns of their own. Rows with a null
    conversation are one conversation. Extra columns are ignored; an empty table gives no rows.

    Turns are dealt out by ranges of (conversation, turn), so a conversation of any length is
    worked on by many tasks; its prefix sums are joined from one number per task.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # Equal turns of a conversation may be many: the text's hash parts them in the ranges too.
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text")

    def run(batches):
        coder = units.worker(("chat", tokenizer_path), lambda: Coder(tokenizer_path))
        marks = [np.array([coder.size + i], "<u4").tobytes() for i in range(len(MARKS))]
        part, current, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            for (convs, turns, roles), texts in rows_of(batch, "text", "conv_id", "turn", "role"):
                role_list = roles.to_pylist()
                coded = coder.encode([escape(t) for t in [*role_list, *texts]])
                out = []
                for conv, role, r, t in zip(convs.to_pylist(), role_list, coded, coded[len(texts) :]):
                    if conv != current:
                        current, at = conv, 0
                    ids = b"".join([marks[0], r, marks[1], t, marks[2]])
                    n, text_at = len(ids) // 4, at + 2 + len(r) // 4
                    out.append((part, ids, at, n, text_at if role == loss_role else None, text_at + len(t) // 4 if role == loss_role else None))
                    at += n
                yield [convs, turns, roles, *zip(*out)]

    schema = T.StructType([
        T.StructField("conv_id", conversations.schema[conv_col].dataType),
        T.StructField("turn", conversations.schema[turn_col].dataType),
        *T.StructType.fromDDL("role string, part int, ids binary, at bigint, n_ids bigint, mask_start bigint, mask_stop bigint").fields,
    ])
    stored = checkpointed(arrow_map(ordered, run, schema))
    # Where a conversation goes on from one task to the next, the ids of the earlier tasks come first.
    lengths = stored.groupBy("conv_id", "part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.withColumn("base", F.sum("n").over(earlier)).filter(F.col("base").isNotNull()).select("conv_id", "part", "base")
    base = F.coalesce("base", F.lit(0))
    moved = lookup_join(stored, bases, ["conv_id", "part"])
    return moved.select("conv_id", "turn", "role", "ids", (F.col("at") + base).alias("offset"), "n_ids", (F.col("mask_start") + base).alias("mask_start"), (F.col("mask_stop") + base).alias("mask_stop"))


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of whole conversations, from the ids and masks of ``format_turns`` alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: the first hash is
    over role, line feed, text and line feed of each turn, the second over the texts under the
    loss mask; ``formatted_chars`` counts the rendered text with its marks. A hash needs its
    input in order, so a conversation streams through one task, one turn in memory at a time.
    """
    ordered = formatted.select("conv_id", "offset", "ids", "mask_start", "mask_stop").repartition("conv_id").sortWithinPartitions("conv_id", "offset")

    def run(batches):
        coder = units.worker(("chat", tokenizer_path), lambda: Coder(tokenizer_path))
        turn, text, end = (coder.size + i for i in range(len(MARKS)))
        now = None

        def result(conv):
            return [[conv], [now["turns"]], [now["all"].hexdigest()], [now["loss_chars"]], [now["loss"].hexdigest()], [now["chars"]]]

        current, started = None, False
        for batch in batches:
            starts, stops = batch.column("mask_start").to_pylist(), batch.column("mask_stop").to_pylist()
            for conv, offset, coded, lo, hi in zip(batch.column("conv_id").to_pylist(), batch.column("offset").to_pylist(), batch.column("ids").to_pylist(), starts, stops):
                if not started or conv != current:
                    if started:
                        yield result(current)
                    current, started = conv, True
                    now = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                ids = np.frombuffer(coded, "<u4")
                begin, middle, finish = (int(np.flatnonzero(ids == mark)[0]) for mark in (turn, text, end))
                role, said = (coder.decode(ids[a + 1 : b]) for a, b in ((begin, middle), (middle, finish)))
                now["turns"] += 1
                now["chars"] += len(role) + len(said) + sum(map(len, MARKS))
                now["all"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                if lo is not None:
                    masked = unescape(coder.decode(ids[lo - offset : hi - offset]))
                    now["loss_chars"] += len(masked)
                    now["loss"].update(masked.encode("utf-8"))
        if started:
            yield result(current)

    schema = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType), *T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])
    return arrow_map(ordered, run, schema)
