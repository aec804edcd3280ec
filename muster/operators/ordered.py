"""Ordered operators: last lines per key, first match, carried headers, every k-th row.

A key may hold a large part of all rows, so no operator here sorts a whole key in one
task. Either only a bounded number of rows per key leaves a task (``row_number() <= n``,
which Spark turns into a group limit before the shuffle), or the key is cut into ranges or
buckets along its order and only one row per bucket is looked at across the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from muster import fixed_values as fv
from muster.functions.common import as_col, join_on, lookup_join


_CUT_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Parts that a key is cut into where Spark doesn't cut it before the shuffle.
SALTS = 64
#: Buckets of a key that one task looks at together.
BUCKETS_TOGETHER = 1000
#: Ranges of an order for every shuffle partition, and values drawn to find the borders of one.
RANGES_PER_PARTITION = 4
SAMPLES_PER_RANGE = 20
#: Characters of a text that a border keeps.
BORDER_CHARS = 1000
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, out: str = "n") -> DataFrame:
    """First ``n`` rows of every key with their position, counted from 1, for any ``n``.

    Up to a limit of its own Spark cuts each key to ``n`` rows before the shuffle. For a larger
    ``n`` each key is dealt into ``SALTS`` parts by a hash of its order, and cut to ``n`` rows in
    every part first: what meets in one task is ``SALTS`` times ``n`` rows, however large the key.
    """
    if n > int(df.sparkSession.conf.get(_CUT_LIMIT, "1000")):
        salt = F.pmod(F.xxhash64(*_order_values(df, order)), F.lit(SALTS))
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_in_part", F.row_number().over(part))
        df = df.filter(F.col("_in_part") <= n).drop("_salt", "_in_part")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def _order_values(df: DataFrame, order: list) -> list:
    """The columns of an order that can be hashed; with none, all that can."""
    named = [c for c in order if isinstance(c, str)]
    return named or [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind] or [F.lit(0)]


def tail_per_key(df: DataFrame, keys: list[str], order: list[str], n: int = fv.TAIL_LINES) -> DataFrame:
    """Last ``n`` rows of every key."""
    down = [as_col(c).desc() for c in order]
    return first_rows(df, keys, down, n, "_from_end").drop("_from_end")


def tail_of_logs(services: DataFrame, lines: DataFrame, keys: list[str], log_file: str, order: list[str], line: str, n: int = fv.TAIL_LINES) -> DataFrame:
    """Last ``n`` log lines of every service, and a row that says so for one without a log file.

    ``services`` has ``keys`` and ``log_file``, ``lines`` has ``log_file``, ``order`` and ``line``.
    Several services may name the same file, whose lines are cut before they meet the services.
    A service whose file has no lines gives no row, as an empty file does.
    """
    named = F.nullif(F.col(log_file), F.lit("")).isNotNull()
    none = services.filter(~named).select(*keys, *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(fv.NO_LOG_FILE).alias(line))
    asked = services.filter(named).select(*keys, log_file)
    wanted = lookup_join(lines.select(log_file, *order, line), asked.select(log_file).distinct(), [log_file], "left_semi")
    tails = tail_per_key(wanted, [log_file], order, n)
    return asked.join(tails, log_file).select(*keys, *order, line).unionByName(none)


def first_match(df: DataFrame, keys: list[str], order, where=None) -> DataFrame:
    """First qualifying record in the stored order, by a sort-free aggregate."""
    if where is not None:
        df = df.filter(where)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), as_col(order)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.filter(F.col("_best").isNotNull()).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def _carry_over_buckets(per_bucket: DataFrame, keys: list[str], held: str, out: str, total: bool = False) -> DataFrame:
    """``keys, _bucket, out``: the last ``held`` of earlier buckets, or with ``total`` their sum.

    A scan in two levels: ``BUCKETS_TOGETHER`` buckets make a block, each block is scanned
    by itself, and one row per block is scanned across the key.
    """
    blocks = per_bucket.withColumn("_block", F.floor(F.col("_bucket") / BUCKETS_TOGETHER))
    value = F.sum(held) if total else F.last(held, ignorenulls=True)
    joined = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if total else F.coalesce
    whole = F.sum(held) if total else F.max_by(held, F.when(F.col(held).isNotNull(), F.col("_bucket")))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_block").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    per_block = blocks.groupBy(*keys, "_block").agg(whole.alias(held)).select(*keys, "_block", value.over(before).alias("_blocks"))
    scanned = blocks.select(*keys, "_block", "_bucket", value.over(inside).alias("_inside"))
    carried = join_on(scanned, per_block, [*keys, "_block"], "left")
    return carried.select(*keys, "_bucket", joined(F.col("_inside"), F.col("_blocks")).alias(out))


def _attach(rows: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(rows, per_bucket, [*keys, "_bucket"], "left")


def _at_most(row: Column, borders: Column, n: int) -> Column:
    """How many of ``n`` sorted ``borders`` are not above ``row``, by halving steps."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.reduce(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(borders, at + step - 1) <= row, at + step).otherwise(at),
    )


def _picked_borders(drawn: DataFrame, ranges: int) -> DataFrame:
    """``borders``: JSON text of evenly spaced ones among the distinct ``_row`` that were drawn.

    They are one row each before any is picked: inside a lambda all of them would be sorted again for each.
    """
    found = drawn.agg(F.sort_array(F.collect_set("_row")).alias("found"))
    each = found.select(F.size("found").alias("_size"), F.posexplode("found").alias("_at", "_row"))
    step = F.greatest(F.ceil(F.col("_size") / ranges), F.lit(1))
    picked = each.filter((F.col("_at") > 0) & (F.col("_at") % step == 0))
    return picked.agg(F.to_json(F.collect_list("_row"), _MICROS).alias("borders"))


def range_of(df: DataFrame, cols: list[str], ranges: int | None = None) -> Column:
    """Number of the range a row falls into along ``cols``; it never decreases in their order.

    The borders come from a mergeable sketch: the ``SAMPLES_PER_RANGE * ranges`` smallest hashes
    of the values, which every task cuts to that many before they meet. The borders are constants
    of the returned expression, so it gives a row the same range wherever and whenever it is
    worked out. They decide only how even the ranges are. A job runs to find them.

    ``ranges`` is four times the session's shuffle partitions unless told otherwise. Rows that
    are equal in ``cols``, texts cut to ``BORDER_CHARS``, share a range.
    """
    ranges = ranges or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*cols)
    # A border may be any value, so long texts need not come whole.
    short = F.struct(*[(F.left(c, F.lit(BORDER_CHARS)) if kind == "string" else F.col(c)).alias(c) for c, kind in df.select(*cols).dtypes])
    drawn = df.select(short.alias("_row"), F.xxhash64(*cols).alias("_hash")).orderBy("_hash").limit(SAMPLES_PER_RANGE * ranges)
    text = _picked_borders(drawn, ranges).first()[0]
    kind = df.select(F.array(row)).schema[0].dataType
    borders = F.sort_array(F.from_json(F.lit(text), kind, _MICROS))
    return _at_most(row, borders, ranges)


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Position of every row inside its key, counted from 1. ``keys`` and ``order`` name each row.

    Ranges of (keys, order) cut a large key into many pieces. A row's range is an expression of
    the row, so the ranges are counted in one pass and numbered in another with nothing stored.
    """
    before = running_total(df, keys, range_of(df, [*keys, *order]), order, F.lit(1), out)
    return before.withColumn(out, F.col(out) + 1)


def sample_every(df: DataFrame, keys: list[str], order: list[str], k: int = fv.STATUS_SAMPLE) -> DataFrame:
    """First row of every run of ``k`` rows per key."""
    return number_rows(df, keys, order, "_n").filter((F.col("_n") - 1) % k == 0).drop("_n")


def fill_forward(df: DataFrame, keys: list[str], bucket: Column, order: str, value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of its key.

    ``order`` tells the rows of a key apart, and ``bucket``, a whole number, must not decrease along
    it. Rows are sorted inside a bucket only, so the bucket decides how much one task has to sort;
    across buckets one row each is looked at, in blocks.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_own", value)
    held = F.when(F.col("_own").isNotNull(), F.col(order))
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.max_by("_own", held).alias("_held"))
    carried = _carry_over_buckets(per_bucket, keys, "_held", "_carried")
    inside = F.last("_own", ignorenulls=True).over(
        W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        _attach(rows, carried, keys)
        .withColumn(out, F.coalesce(inside, "_carried"))
        .drop("_bucket", "_own", "_carried")
    )


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each row's key, 0 for the first.

    ``bucket`` is as in ``fill_forward``: rows are sorted inside a bucket only, and nothing is stored.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_own", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_own").alias("_held"))
    carried = _carry_over_buckets(sums, keys, "_held", "_carried", total=True)
    inside = F.sum("_own").over(W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        _attach(rows.withColumn("_inside", inside), carried, keys)
        .withColumn(out, F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
        .drop("_bucket", "_own", "_inside", "_carried")
    )


def fill_section(lines: DataFrame, header: Column, keys: list[str], order: str = "line_no", lines_per_bucket: int = 50_000) -> DataFrame:
    """Give every line the header it stands under (``section``).

    Line numbers are unique in a file, so a bucket never has more than ``lines_per_bucket`` rows.
    """
    bucket = F.floor(F.col(order) / lines_per_bucket)
    return fill_forward(lines, keys, bucket, order, header, "section")


def first_allocated(polls: DataFrame, keys: list[str], order: list[str], node: Column) -> DataFrame:
    """First poll of every key that shows a usable node; keys without one get nulls."""
    hit = F.when(node.isNotNull(), F.struct(*order))
    return (
        polls.groupBy(*keys)
        .agg(F.min_by(F.struct(node.alias("node"), *order), hit).alias("_hit"))
        .select(*keys, F.col("_hit.node").alias("node"), *[F.col("_hit")[c].alias(c) for c in order])
    )


def first_item(df: DataFrame, order: str) -> DataFrame:
    """First record in the stored order."""
    return first_match(df, [], order)


def sorted_listing(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct listing in ascending order."""
    return df.select(*cols).distinct().orderBy(*cols)
