"""Ranked lexical search, one term at a time with a limited set of accumulators.

Documents become rows of (asked term, occurrences), stored once. A task then takes blocks of such
rows, turns each into postings per term and works through the terms of every query from the
rarest on. A document gets an accumulator while a document without one could still reach the
k-th best partial score; once the largest contributions that are left add up to less, only
documents that have an accumulator are updated, exactly. A block's k-th best score goes along to
the next block. A task hands on k rows per query, and a window keeps the k best of all tasks.

All numbers are 64-bit integers, so results do not depend on how documents are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from muster.llm.batches import arrow_map, slices, stored

#: Bytes that end a term become spaces, A-Z become a-z; all other bytes stay as they are.
_FOLD = bytes(
    ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b >= 0x80 or 0x30 <= b <= 0x39 else 0x20
    for b in range(256)
)

#: Text of queries that are searched together; their terms are sent to every task.
QUERY_BYTES = 4_000_000
#: Postings and documents that a task holds at a time.
BLOCK_POSTINGS = 4_000_000
BLOCK_DOCUMENTS = 200_000


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text given as UTF-8: runs of letters, digits and any non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def asked_occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, ids, tfs``: all terms of a document counted, and the asked ones among them with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n bigint, ids array<int>, tfs array<int>")])

    def read(batches):
        number = shared.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, ids, tfs, ends = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    words = terms_of(text)
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    sizes.append(len(words))
                    ids.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                yield [part.column("doc_id"), sizes] + [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (ids, tfs)]

    return arrow_map(rows, read, schema)


class Block:
    """Postings of some documents: for every term its documents and what it adds to their scores."""

    def __init__(self, doc_ids: list, sizes: list[int], ids: np.ndarray, tfs: np.ndarray, ends: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        # Whole numbers of any size: the product can pass 64 bits on large tables.
        length = np.array([100 - 90 + (90 * n * n_docs) // max(n_terms, 1) for n in sizes], np.int64)
        at = np.repeat(np.arange(len(doc_ids)), np.diff(ends))
        tfs = tfs.astype(np.int64)
        adds = weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * length[at]))
        order = np.argsort(ids, kind="stable")
        self.at, self.adds = at[order], adds[order]
        self.starts = np.searchsorted(ids[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.starts))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.adds, self.starts[there])
        self.score, self.open = np.zeros(len(doc_ids), np.int64), np.zeros(len(doc_ids), bool)

    def best(self, terms: list[int], k: int, floor: int) -> list[tuple]:
        """The up to ``k`` best ``(score, doc_id)`` for terms given from the rarest on.

        What cannot reach ``floor``, the k-th best score of other documents, may be left out.
        """
        left = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0).tolist()
        score, opened = self.score, self.open
        held = np.empty(0, np.int64)
        creating = left[0] >= max(floor, 1)
        if not creating:
            return []
        for i, term in enumerate(terms):
            at, adds = (x[self.starts[term] : self.starts[term + 1]] for x in (self.at, self.adds))
            if creating:
                score[at] += adds
                new = at[~opened[at]]
                opened[new] = True
                held = np.concatenate([held, new])
                reach = floor
                if len(held) >= k:
                    reach = max(floor, int(np.partition(score[held], len(held) - k)[len(held) - k]))
                # A document without an accumulator gets at most what is left; an equal score may still win by its id.
                if left[i + 1] < reach:
                    creating, held = False, np.sort(held)
            elif len(held) * 16 < len(at):
                place = np.searchsorted(at, held)
                hit = at[np.minimum(place, len(at) - 1)] == held
                score[held[hit]] += adds[place[hit]]
            else:
                known = opened[at]
                score[at[known]] += adds[known]
        totals = score[held]
        # Reset what was touched, for the next query.
        score[held], opened[held] = 0, False
        least = max(floor, 1)
        if len(held) > k:
            least = max(least, int(np.partition(totals, len(held) - k)[len(held) - k]))
        some = totals >= least
        return nsmallest(k, zip(totals[some].tolist(), [self.doc_ids[j] for j in held[some]]), key=_rank)


def _rank(found: tuple) -> tuple:
    score, doc_id = found
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def _blocks(batches):
    """Stored rows of several batches together, up to the limits of a block."""
    parts, documents, postings = [], 0, 0
    for batch in batches:
        # A batch may be large where documents are short, or hold many postings.
        step = max(1, min(batch.num_rows, 4096))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            parts.append(part)
            documents += part.num_rows
            postings += len(part.column("ids").flatten())
            if documents >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts, documents, postings = [], 0, 0
    if documents:
        yield pa.Table.from_batches(parts).combine_chunks()


def _search_block(docs: DataFrame, queries: list[tuple], k: int, id_col: str, text_col: str, item_type: T.DataType) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms_of(text)).keys() for _, text in queries]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*asked)))}
    index = stored(asked_occurrences(docs, vocabulary, id_col, text_col), "lexical-index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    # One row per asked term, so as many as the queries of this block have words.
    df = {r["term"]: r["df"] for r in index.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([weight(total["n_docs"], df[i]) if i in df else 0 for i in range(len(vocabulary))], np.int64)
    rarest_first = [sorted((vocabulary[t] for t in terms if vocabulary[t] in df), key=lambda t: (df[t], t)) for terms in asked]
    plan = spark.sparkContext.broadcast((weights, rarest_first, [item for item, _ in queries], total["n_docs"], total["n_terms"]))
    schema = T.StructType().add("query_no", T.IntegerType()).add("item_id", item_type).add("doc_id", index.schema["doc_id"].dataType).add("score", T.LongType())

    def search(batches):
        weights, rarest_first, items, n_docs, n_terms = plan.value
        best: list[list[tuple]] = [[] for _ in items]
        for rows in _blocks(batches):
            lists = rows.column("ids").combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
            tfs = rows.column("tfs").combine_chunks()
            tfs = tfs if isinstance(tfs, pa.Array) else tfs.chunk(0)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            block = Block(rows.column("doc_id").to_pylist(), rows.column("n").to_pylist(), ids, tfs.flatten().to_numpy(zero_copy_only=False), ends - ends[0], weights, n_docs, n_terms)
            for q, terms in enumerate(rarest_first):
                if terms:
                    floor = best[q][-1][0] if len(best[q]) == k else 0
                    new = block.best(terms, k, floor)
                    best[q] = nsmallest(k, best[q] + new, key=_rank) if new else best[q]
        found = [(q, items[q], doc_id, score) for q, hits in enumerate(best) for score, doc_id in hits]
        if found:
            yield list(zip(*found))

    hits = arrow_map(index, search, schema)
    order = W.partitionBy("query_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every query, exactly, best first.

    Terms are runs of bytes other than ASCII signs, spaces and control characters; only A-Z are
    folded. The score of a document sums, over the different terms of the query, the term's
    weight times its damped occurrences, all in whole numbers; documents that score 0 are not
    returned. Equal scores go by ascending ``doc_id``, null ids last.

    Queries are taken in blocks of about ``QUERY_BYTES`` of text; each block reads the documents
    once. Queries with the same id and text are one query; the same id with another text is
    another one. A null, empty or term-less text on either side matches nothing; such documents
    count neither in the number of documents nor in the average length. Rows that repeat a
    document's id are documents of their own. Other columns are ignored whatever their names. Empty
    tables give no rows.
    """
    asked = queries.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("text"))
    asked = asked.filter(F.octet_length("text") > 0).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_blocks = -(-size // QUERY_BYTES)
    item_type = asked.schema["item_id"].dataType
    out = None
    for b in range(n_blocks):
        block = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == b)
        rows = [(r["item_id"], bytes(r["text"])) for r in block.collect()]
        if rows:
            found = _search_block(docs, rows, k, id_col, text_col, item_type)
            out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType().add("item_id", item_type).add("rank", T.IntegerType()).add("doc_id", docs.schema[id_col].dataType).add("score", T.LongType())
        out = docs.sparkSession.createDataFrame([], schema)
    return out
