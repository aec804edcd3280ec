"""Quality rules on words and on how a public vocabulary cuts a text (tokeniser fertility).

Base rules count words, symbols, repeated lines and repeated windows of five words. The method's
own rules look at characters per token, the share of byte-fallback tokens and the entropy of
the tokens. What is usual differs with the language and, for the entropy, with the length, so
each document is held against a band of its own group: documents of the same language (or of
the same script, where no language is given) whose token counts have the same number of bits.
A band is the median of the group's distinct measurements and ``width`` times their quartile
range to either side, but never narrower than ``least`` nor wider than ``most``, so that a source of
junk cannot widen it at will. A group with few distinct measurements has no band of its own. Its
documents are held against the band of the nearest shorter length of their language that has one,
else of the nearest longer one, and where the language has none, against those of their script in
the same way. Entropy does not fall with the length of ordinary text, and rises by at most a
bit when the text doubles; a band taken from another length is moved by that much on that side.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from muster.functions.common import lookup_join
from muster.llm import units
from muster.llm.batches import stored, with_columns

WHITE = " \t\n\v\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Half a band's width is at least and at most this much.
LEAST = {"chars_per_token": 0.4, "token_entropy": 0.4}
MOST = {"chars_per_token": 0.6, "token_entropy": 1.3}
#: Measures that rise with the length, by at most one for each doubling.
RISING = {"token_entropy"}

#: First code points of the blocks that tell scripts apart, and the script from there on.
SCRIPT_STARTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"),
    (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"),
    (0xFB00, "other"), (0x20000, "cjk"),
]
_STARTS = np.array([a for a, _ in SCRIPT_STARTS], np.uint32)
_NAMES = [b for _, b in SCRIPT_STARTS]

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, script string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"


def repeated_words(words: list, window: int = 5) -> int:
    """Words that lie in a window of this many words which the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict = {}
    key = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    one, size = key, len(numbers)
    for k in range(1, window):
        # The windows so far and the next word as one number; numbered anew before it gets too large.
        if size > (1 << 62) // (len(numbers) + 1):
            kinds, key = np.unique(key, return_inverse=True)
            size = len(kinds)
        key = key[: n - k] * len(numbers) + one[k:]
        size *= len(numbers)
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    if not len(again):
        return 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str | None:
    """Script of most letters; the first in the order of ``SCRIPT_STARTS`` wins a tie, no letters give null."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else None
    counts: dict[str, int] = {}
    hits = np.bincount(np.searchsorted(_STARTS, codes, "right") - 1, minlength=len(_STARTS))
    for name, n in zip(_NAMES, hits.tolist()):
        if name != "other" and n:
            counts[name] = counts.get(name, 0) + n
    return max(counts, key=counts.get) if counts else None


class PieceIds:
    """Ids of whole texts under a SentencePiece BPE model, by words.

    Pieces of such a model hold space marks only at their front, so a space that stands before
    something else always starts a new piece, and the ids of a text are those of its words.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.size = len(pieces)
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize("a  ｂ") == "▁a▁▁ｂ"
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.memo = units.Memo(lambda words: [np.array(ids, "<i4").tobytes() for ids in self.model.encode(words, num_threads=1)], limit=500_000)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        # The library puts a space mark before each text it is given, so a word is its own unit.
        plain = [bool(t) and self.by_words and t[0] != " " and t[-1] != " " and "  " not in t and "▁" not in t for t in texts]
        known = self.memo.values([t.split(" ") if p else [] for t, p in zip(texts, plain)])
        return [np.frombuffer(b"".join(v), "<i4") if p else np.array(self.model.encode(t), "<i4") for t, p, v in zip(texts, plain, known)]


def measure(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) and the ``MEASURES`` of each whole text (null counts as empty).

    ``byte_share`` leaves the line feed out, which many vocabularies only have as a byte. A text
    without tokens has null ``chars_per_token``, ``byte_share`` and ``token_entropy``.
    """

    def run(texts):
        pieces = units.worker(("pieces", tokenizer_path), lambda: PieceIds(tokenizer_path))
        line_feed = pieces.model.piece_to_id("<0x0A>")
        texts = [t or "" for t in texts]
        rows = []
        for text, ids in zip(texts, pieces.ids(texts)):
            # Bytes are split at exactly the six white spaces that part words here.
            words = text.encode("utf-8").split()
            chars, n = len(text) - sum(map(text.count, WHITE)), len(ids)
            per = share = entropy = None
            if n:
                counts = np.bincount(ids, minlength=pieces.size)
                share = int(counts[pieces.is_byte].sum() - counts[line_feed] * pieces.is_byte[line_feed]) / n
                used = counts[counts > 0]
                entropy = float(np.log2(n) - (used * np.log2(used)).sum() / n)
                per = chars / n
            rows.append((len(words), chars, len(_SYMBOLS.findall(text)), duplicate_lines(text), repeated_words(words), script_of(text), n, per, share, entropy))
        return list(zip(*rows)) if rows else [[]] * 10

    return with_columns(docs, text_col, run, MEASURES, keep)


def bands(measured: DataFrame, group: list[str], width: float, least: dict[str, float], most: dict[str, float], min_documents: int) -> DataFrame:
    """Lowest and highest usual value of each measure per group, over all documents.

    Equal measurements count once, so that a group full of copies does not narrow its band.
    """
    names = list(least)
    distinct = measured.select(*group, *names).dropna(subset=names).distinct()
    points = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in names]
    found = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *points).filter(F.col("_n") >= min_documents)

    def band(c):
        half = F.least(F.lit(most[c]), F.greatest(F.lit(least[c]), width * (F.col(c)[2] - F.col(c)[0])))
        return F.struct((F.col(c)[1] - half).alias("low"), (F.col(c)[1] + half).alias("high")).alias(c)

    return found.select(*group, *[band(c) for c in names])


def bands_by_length(measured: DataFrame, key: str, name: str, *limits) -> DataFrame:
    """``key`` and the array ``name`` with the bands of its lengths, shortest first; at most one for each number of bits."""
    found = bands(measured, [key, "_bits"], *limits)
    measures = [c for c in found.columns if c not in (key, "_bits")]
    return found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_bits", *measures))).alias(name))


def band_for(lengths, bits, rising: set[str], names: list[str]):
    """The band for texts of ``bits`` bits of tokens out of the bands by length; null where there is none."""
    shorter = F.element_at(F.filter(lengths, lambda x: x["_bits"] <= bits), -1)
    longer = F.get(F.filter(lengths, lambda x: x["_bits"] > bits), F.lit(0))

    def moved(band, down, up):
        change = {c: (down, up) if c in rising else (F.lit(0), F.lit(0)) for c in names}
        return F.struct(*[F.struct((band[c]["low"] - change[c][0]).alias("low"), (band[c]["high"] + change[c][1]).alias("high")).alias(c) for c in names])

    none = F.lit(0)
    return (
        F.when(F.exists(lengths, lambda x: x["_bits"] <= bits), moved(shorter, none, bits - shorter["_bits"]))
        .when(F.exists(lengths, lambda x: x["_bits"] > bits), moved(longer, longer["_bits"] - bits, none))
    )


def judge(
    measured: DataFrame,
    lang_col: str | None = "lang",
    width: float = 3.0,
    least: dict[str, float] | None = None,
    most: dict[str, float] | None = None,
    max_byte_share: float = 0.3,
    min_tokens: int = 64,
    min_documents: int = 50,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """``measured`` (best as a stored table, it is read twice) with ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than ``min_words`` words, or with more than
    ``max_repeat_percent`` of its words in repeated windows. The method rejects a document with
    a byte-fallback share above ``max_byte_share``, and one outside its group's bands (see the
    module's text). Texts of fewer than ``min_tokens`` tokens are too short to measure and are held
    against the byte share only, and so are those for whose language and script no length has a band. Null
    languages go by script; null scripts are a group too.
    """
    least = LEAST if least is None else least
    most = MOST if most is None else most
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col and lang_col in measured.columns else F.lit(None).cast("string")
    bits = F.when(F.col("n_tokens") >= min_tokens, F.floor(F.log2("n_tokens")).cast("int"))
    names = list(least)
    grouped = measured.withColumns({"_language": F.coalesce(lang, "script", F.lit("")), "_script": F.coalesce("script", F.lit("")), "_bits": bits})
    long_enough = grouped.filter(F.col("_bits").isNotNull())
    joined = grouped
    for key, name in (("_language", "_own"), ("_script", "_shared")):
        # A stored table has a known size; Spark broadcasts it only where that is small.
        joined = lookup_join(joined, stored(bands_by_length(long_enough, key, name, width, least, most, min_documents), "bands"), [key])
    band = F.coalesce(*[band_for(F.col(c), F.col("_bits"), RISING, names) for c in ("_own", "_shared")])
    joined = joined.withColumn("_band", F.when(F.col("_bits").isNotNull(), band))
    odd = F.col("byte_share") > max_byte_share
    for c in names:
        odd = odd | ~F.coalesce(F.col(c).between(F.col(f"_band.{c}.low"), F.col(f"_band.{c}.high")), F.lit(True))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(odd, F.lit(False))}).drop("_language", "_script", "_bits", "_own", "_shared", "_band")
