"""Approximate nearest neighbours by vantage-point trees, one per shard of the vectors.

A shard's tree parts its vectors by their distance from a vantage point, over and over. By the
triangle inequality a branch whose distances lie between ``low`` and ``high`` holds nothing
nearer to a query at distance d than max(low - d, d - high). A branch is left out once this bound,
times the factor, exceeds the distance of the query's worst hit so far. Factor 1 leaves out only
what cannot be a hit: the search is exact. A larger factor leaves out more and may miss hits.

The queries are a stated part of the rows. They are put together in blocks, each block is sent to
each shard of vectors of its length, and a task holds one tree and one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from muster.llm.batches import arrow_map

_LEAF = 64


class Tree:
    """Vantage-point tree over the rows of a matrix; ``order`` lists the rows so that each branch is a range."""

    def __init__(self, vectors: np.ndarray, leaf: int = _LEAF):
        self.vectors, self.leaf = vectors, leaf
        self.order = np.arange(len(vectors))
        self.nodes: dict[tuple[int, int], tuple] = {}
        todo = [(0, len(vectors))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                continue
            rows = self.order[lo:hi]
            # The vantage point is the row farthest from the branch's first row, first of equals.
            pivot = int(np.argmax(distances(vectors[rows], vectors[rows[0]])))
            rows[[0, pivot]] = rows[[pivot, 0]]
            d = distances(vectors[rows[1:]], vectors[rows[0]])
            by = np.argsort(d, kind="stable")
            rows[1:], d = rows[1:][by], d[by]
            half = len(d) // 2
            self.nodes[lo, hi] = (lo + 1 + half, d[0], d[half - 1], d[half], d[-1])
            todo += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]

    def search(self, queries: np.ndarray, hits: Hits, factor: float) -> None:
        """Offer every query the rows that the bounds leave over."""
        self._visit(0, len(self.vectors), queries, np.arange(len(queries)), hits, factor)

    def _visit(self, lo, hi, queries, asked, hits, factor):
        node = self.nodes.get((lo, hi))
        if node is None:
            rows = self.order[lo:hi]
            for i in range(0, len(asked), _LEAF):
                some = asked[i : i + _LEAF]
                d = np.sqrt(((queries[some][:, None, :] - self.vectors[rows][None]) ** 2).sum(axis=2))
                for j in np.flatnonzero(d.min(axis=1) <= hits.worst[some]):
                    hits.offer(some[j], rows, d[j])
            return
        middle, near_low, near_high, far_low, far_high = node
        point = self.order[lo]
        d = distances(queries[asked], self.vectors[point])
        for j in np.flatnonzero(d <= hits.worst[asked]):
            hits.offer(asked[j], self.order[lo : lo + 1], d[j : j + 1])
        near = (lo + 1, middle, near_low, near_high)
        far = (middle, hi, far_low, far_high)
        inside = d < (near_high + far_low) / 2
        # Every query goes down its own side first, so that its worst hit is small at the other.
        for side, first, second in ((inside, near, far), (~inside, far, near)):
            for a, b, low, high in (first, second):
                some, bound = asked[side], np.maximum(low - d[side], d[side] - high)
                go = np.maximum(bound, 0) * factor <= hits.worst[some]
                if go.any():
                    self._visit(a, b, queries, some[go], hits, factor)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


class Hits:
    """The k nearest rows of every query; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, k: int):
        self.ids, self.own, self.k = ids, own, k
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in own]
        self.worst = np.full(len(own), np.inf)

    def offer(self, q: int, rows: np.ndarray, d: np.ndarray) -> None:
        ids = self.ids[rows]
        ok = (d <= self.worst[q]) & (ids != self.own[q])
        if not ok.any():
            return
        d0, ids0 = self.best[q]
        d, ids = np.concatenate([d0, d[ok]]), np.concatenate([ids0, ids[ok]])
        keep = np.lexsort((ids, d))[: self.k]
        self.best[q] = (d[keep], ids[keep])
        if len(keep) == self.k:
            self.worst[q] = d[keep[-1]]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part, each different row once."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(whole & some).dropDuplicates()


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int = 8192,
    block_rows: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows by Euclidean distance.

    ``is_query`` is a condition on ``id``; all other rows and the other queries are candidates.
    A row's own id is never its hit. Vectors only meet vectors of the same length. ``factor``
    1 is exact; see the module's text. Scores are in double precision, on the vectors as given.

    Rows with a null id, and null, empty or all-zero vectors and vectors with a null or
    non-finite component, take no part. Repeated rows count once. Equal distances go to the
    smaller id. With fewer candidates than ``k`` all are returned; an empty table gives no rows.
    """
    vectors = usable(rows, id_col, vector_col).withColumn("width", F.size("vector"))
    counted = vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()
    # One row per length. W lengths need at least W * W / 2 stored numbers, so this table stays small.
    sizes = [(r["width"], -(-r["n"] // shard_rows), max(1, -(-r["q"] // block_rows))) for r in counted]
    partitions = max(1, -(-sum(r["n"] for r in counted) // shard_rows))
    dealt_to = F.broadcast(rows.sparkSession.createDataFrame(sizes, "width int, shards bigint, blocks bigint"))
    hashed = F.xxhash64("id", "vector")
    dealt_rows = vectors.join(dealt_to, "width")
    sharded = dealt_rows.withColumn("shard", F.pmod(hashed, F.col("shards")))
    asked = dealt_rows.filter(is_query).withColumn("block", F.pmod(hashed, F.col("blocks")))
    # Each shard holds rows of one length, which a task turns into a tree; each block goes to all shards of its length.
    blocks_of = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    both = sharded.select("width", "shard", F.lit(-1).cast("long").alias("block"), "id", "vector").unionByName(blocks_of.select("width", "shard", "block", "id", "vector"))
    dealt = both.repartition(partitions, "width", "shard").sortWithinPartitions("width", "shard", "block", "id")

    def run(batches):
        tree, ids, planted = None, None, None
        name, part_ids, part_vectors = None, [], []

        def finish():
            nonlocal tree, ids, planted
            matrix = np.concatenate(part_vectors)
            numbers = np.concatenate(part_ids)
            if name[2] < 0:
                tree, ids, planted = Tree(matrix), numbers, name[:2]
                return
            # A shard to which no row was dealt has no tree.
            if planted != name[:2]:
                return
            hits = Hits(ids, numbers, k)
            tree.search(matrix, hits, factor)
            for i in range(0, len(numbers), 1000):
                got = [(q, v, s) for q, (d, near) in zip(numbers[i : i + 1000], hits.best[i : i + 1000]) for s, v in zip(d, near)]
                if got:
                    yield list(zip(*got))

        for batch in batches:
            labels = list(zip(*[batch.column(c).to_pylist() for c in ("width", "shard", "block")]))
            numbers = batch.column("id").to_numpy()
            start = 0
            while start < len(labels):
                stop = start + 1
                while stop < len(labels) and labels[stop] == labels[start]:
                    stop += 1
                if labels[start] != name and name is not None:
                    yield from finish()
                    part_ids, part_vectors = [], []
                name = labels[start]
                part_ids.append(numbers[start:stop])
                part_vectors.append(batch.column("vector").slice(start, stop - start).flatten().to_numpy().reshape(stop - start, name[0]))
                start = stop
        if name is not None:
            yield from finish()

    found = arrow_map(dealt, run, "query_id bigint, vec_id bigint, score double")
    # A repeated id with several vectors is one candidate per vector; so is a query.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
