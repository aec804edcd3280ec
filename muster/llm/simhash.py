"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are numbers of 64 bits, read from the highest bit as paths of a binary trie. The
self-join walks pairs of trie nodes down together and adds up the bits in which their paths
differ; a pair with more differing bits than allowed is dropped with all that lies below it.

Spark holds the trie's upper part: distinct fingerprints are grouped by their first bits
(nodes), every node meets the nodes whose paths differ in at most the allowed number of bits,
and each such pair of nodes is a group of its own that numpy walks down further. Nodes that hold
far more fingerprints than others are cut at deeper levels. A task gives back only a spanning
forest of the links it finds, so large groups of near copies don't give all their pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from muster.functions.common import join_on, lookup_join
from muster.llm.batches import arrow_map, rows_of
from muster.llm.components import components
from muster.session import checkpointed

BITS = 64
#: Shingles whose bits are added up at a time.
_CHUNK = 16_384
#: Node pairs that a walk expands at a time.
_FRONT = 200_000
#: Bits by which a full node is cut further.
_STEP = 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in more than half of the hashes of the word shingles."""
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        stops = (ends[words - 1 :] - 1).tolist()
        starts = [0, *ends[: len(tokens) - words].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops)]
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` of every row; null texts count as empty. ``text_key`` tells texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))

    def run(batches):
        for batch in batches:
            for (ids, keys), texts in rows_of(batch, "text", "doc_id", "text_key"):
                prints = [fingerprint(t, words) for t in texts]
                yield [ids, keys, pa.array(np.array(prints, np.uint64).view(np.int64))]

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.BinaryType()), T.StructField("fp", T.LongType())])
    return arrow_map(rows, run, schema)


# -- the trie ------------------------------------------------------------------------------


def masks(depth: int, distance: int) -> list[int]:
    """All ways to change at most ``distance`` of the first ``depth`` bits, as right-aligned numbers."""
    return [sum(1 << b for b in bits) for k in range(distance + 1) for bits in combinations(range(depth), k)]


def _prefix(fp: Column, depth: Column | int) -> Column:
    """First ``depth`` bits as a right-aligned number."""
    keep = F.lit(BITS) - depth
    return F.call_function("shiftrightunsigned", fp, keep.cast("int"))


def _nodes(prints: DataFrame, node_rows: int, least_depth: int, most_depth: int) -> tuple[DataFrame, int]:
    """Every fingerprint with the depth of its node, and the depth that most nodes have."""
    total = prints.count()
    start = min(most_depth, max(least_depth, int(np.ceil(np.log2(max(total, 1) / node_rows + 1)))))
    most = max(node_rows, 4 * total >> start)
    nodes, depth = prints.withColumn("depth", F.lit(start)), start
    while depth + _STEP < BITS:
        sizes = nodes.filter(F.col("depth") == depth).groupBy(_prefix(F.col("fp"), depth).alias("path")).agg(F.count(F.lit(1)).alias("n"))
        full = sizes.filter(F.col("n") > most).select("path")
        if full.isEmpty():
            break
        at = nodes.withColumn("path", F.when(F.col("depth") == depth, _prefix(F.col("fp"), depth)))
        deeper = lookup_join(at, full.withColumn("_full", F.lit(True)), ["path"])
        depth += _STEP
        nodes = checkpointed(deeper.select("fp", F.when(F.col("_full"), depth).otherwise(F.col("depth")).cast("int").alias("depth")))
    return nodes, start


def links(prints: DataFrame, distance: int, node_rows: int = 2048, least_depth: int = 6, most_depth: int = 12) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints (column ``fp``) at most ``distance`` bits apart.

    The links of each pair of nodes are a spanning forest of all that this pair has: no
    connection is lost. ``node_rows`` is the number of fingerprints from which a node is cut
    further; beyond ``2 ** most_depth`` times that many in all, nodes grow instead, so that a
    fingerprint meets a bounded number of nodes.
    """
    nodes, start = _nodes(prints, node_rows, least_depth, most_depth)
    path = _prefix(F.col("fp"), F.col("depth"))
    placed = nodes.select("fp", "depth", path.alias("path"))
    kinds = placed.select("depth", "path").distinct()
    changes = F.array(*[F.lit(m).cast("long") for m in masks(start, distance)])
    top = F.call_function("shiftrightunsigned", F.col("path"), (F.col("depth") - start).cast("int"))
    left = kinds.select(F.col("depth").alias("depth_a"), F.col("path").alias("path_a"), F.explode(F.transform(changes, lambda m: top.bitwiseXOR(m))).alias("top"))
    right = kinds.select(F.col("depth").alias("depth_b"), F.col("path").alias("path_b"), top.alias("top"))
    shared = F.least("depth_a", "depth_b")
    differ = F.bit_count(
        F.call_function("shiftrightunsigned", F.col("path_a"), (F.col("depth_a") - shared).cast("int")).bitwiseXOR(
            F.call_function("shiftrightunsigned", F.col("path_b"), (F.col("depth_b") - shared).cast("int"))
        )
    )
    in_order = (F.col("path_a") < F.col("path_b")) | ((F.col("path_a") == F.col("path_b")) & (F.col("depth_a") <= F.col("depth_b")))
    pairs = left.join(right, "top").filter(in_order & (differ <= distance)).select("depth_a", "path_a", "depth_b", "path_b")
    key = F.struct("depth_a", "path_a", "depth_b", "path_b")
    sides = [
        join_on(placed, pairs.withColumnsRenamed({f"depth_{s}": "depth", f"path_{s}": "path"}).withColumns({f"depth_{s}": F.col("depth"), f"path_{s}": F.col("path")}), ["depth", "path"], "inner")
        .select(key.alias("pair"), F.lit(s == "b").alias("second"), "fp")
        for s in "ab"
    ]
    own = F.col("pair.depth_a").eqNullSafe(F.col("pair.depth_b")) & F.col("pair.path_a").eqNullSafe(F.col("pair.path_b"))
    members = sides[0].unionByName(sides[1].filter(~own))
    members = members.select(F.xxhash64("pair").alias("k"), "pair.depth_a", "pair.path_a", "pair.depth_b", "pair.path_b", "second", "fp")
    order = ["k", "depth_a", "path_a", "depth_b", "path_b"]
    # Whole node pairs come to a task one after the other; numpy holds one pair at a time.
    dealt = members.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)

    def run(batches):
        current, first, second = None, [], []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in order])
            prints_here = batch.column("fp").to_numpy().view(np.uint64)
            is_second = batch.column("second").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if lo == hi:
                    continue
                pair = tuple(keys[lo])
                if pair != current and current is not None:
                    yield forest(current, first, second)
                    first, second = [], []
                current = pair
                first.append(prints_here[lo:hi][~is_second[lo:hi]])
                second.append(prints_here[lo:hi][is_second[lo:hi]])
        if current is not None:
            yield forest(current, first, second)

    def forest(pair, first, second):
        same = pair[1:3] == pair[3:5]
        a = np.unique(np.concatenate(first))
        b = a if same else np.unique(np.concatenate(second))
        low, high = walk(a, b, distance, same)
        return [pa.array(low.view(np.int64)), pa.array(high.view(np.int64))]

    return arrow_map(dealt, run, "a bigint, b bigint")


def walk(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two sorted sets of fingerprints (or within one).

    Pairs of trie nodes wait on a stack; a node is a range of a sorted array and a depth. A
    part of the stack is taken at a time: each pair becomes the pairs of its children, with one
    more differing bit where they part, and pairs over the budget are dropped. Pairs of
    single fingerprints are compared at once.
    """
    values = a if same else np.union1d(a, b)
    parent = np.arange(len(values))
    stack = [(0, *[np.array([x]) for x in (0, len(a), 0, len(b), 0)], np.array([same]))]
    while stack:
        depth, a0, a1, b0, b1, errors, twin = stack.pop()
        if len(a0) > _FRONT:
            stack += [(depth, *[x[i : i + _FRONT] for x in (a0, a1, b0, b1, errors, twin)]) for i in range(0, len(a0), _FRONT)]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a[a0[single]], b[b0[single]]
            near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
            if near.any():
                parent = unite(parent, np.searchsorted(values, x[near]), np.searchsorted(values, y[near]))
            rest = ~single
            a0, a1, b0, b1, errors, twin = (v[rest] for v in (a0, a1, b0, b1, errors, twin))
        if not len(a0) or depth == BITS:
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        am, bm = split(a, a0, a1, bit), split(b, b0, b1, bit)
        children = [
            (a0, am, b0, bm, errors, twin),
            (am, a1, bm, b1, errors, twin),
            (a0, am, bm, b1, errors + 1, np.zeros_like(twin)),
            # Within one set the other mixed pair is the same pair.
            *[(am[o], a1[o], b0[o], bm[o], errors[o] + 1, twin[o]) for o in [~twin]],
        ]
        alive = [[v[ok] for v in c] for c in children for ok in [(c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= distance)]]
        merged = [np.concatenate(v) for v in zip(*alive)]
        # A twin node of one fingerprint holds no pair.
        keep = ~(merged[5] & (merged[1] - merged[0] == 1))
        stack.append((depth + 1, *[v[keep] for v in merged]))
    parent = roots(parent)
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return values[parent[linked]], values[linked]


def split(values: np.ndarray, start: np.ndarray, stop: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place in each range where the bit is set; above it all fingerprints of a range agree."""
    low = values[np.minimum(start, len(values) - 1)] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(values, low | bit), start, stop)


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the sets of all pairs; each set's root is its smallest member."""
    while True:
        parent = roots(parent)
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return parent
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))


# -- documents -----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp, component_id, keeper`` of every row.

    Documents whose fingerprints differ in at most ``distance`` bits are linked, and linked documents
    are one component, chains included. ``component_id`` is the smallest id in it (null ids
    count only where there is no other). ``keeper`` is true for one text of each component, the
    one with the smallest id and then the smallest ``text_key``; repeated rows of it all have it.

    Null and empty texts, and those of white space alone, have fingerprint zero and are linked
    like any other. Extra columns are ignored whatever their names; an empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, words, id_col, text_col))
    # Documents with the same fingerprint are one node, whatever their number.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(order).alias("first")))
    found = checkpointed(components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp"))
    # Only fingerprints with links need the root's smallest document.
    rooted = lookup_join(distinct, found, ["fp"])
    linked = rooted.filter(F.col("root").isNotNull())
    best = linked.groupBy("root").agg(F.min("first").alias("first"))
    shared = lookup_join(linked.select("fp", "root"), best, ["root"]).select("fp", "first")
    classes = shared.unionByName(rooted.filter(F.col("root").isNull()).select("fp", "first"))
    joined = lookup_join(prints, classes, ["fp"])
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return joined.select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), keeper.alias("keeper"))


def drop_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; see ``near_duplicates`` for which."""
    found = near_duplicates(docs, words, distance, id_col, text_col).filter("keeper").select(F.col("doc_id").alias("_keep_id"), F.col("text_key").alias("_keep_key")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"_keep_id": F.col(id_col), "_keep_key": F.unhex(F.sha2(text, 256))})
    kept = join_on(keyed, found, ["_keep_id", "_keep_key"], "left_semi")
    return kept.dropDuplicates(["_keep_id", "_keep_key"]).drop("_keep_id", "_keep_key")
