"""Small column helpers shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def set_or_null(c: ColumnOrName) -> Column:
    """The value as text; empty text counts as missing."""
    return F.nullif(as_col(c).cast("string"), F.lit(""))


def first_set(*cols: ColumnOrName) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[set_or_null(c) for c in cols])


#: Rows of a table that one task opens where each of them becomes many.
ROWS_OPENED_TOGETHER = 20_000


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt out evenly, for stored narrow rows of which each becomes many.

    A file of a few megabytes is read by one or two tasks, which would then open, hold and sort all
    that comes out of it. Here a task gets about ``ROWS_OPENED_TOGETHER`` rows however large the table
    is. A job counts the rows first, which for Parquet reads the footers only.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_OPENED_TOGETHER))
    return df.repartition(tasks)


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns where null equals null; the result has the left ones.

    The right ones get new names first, so both sides may come from the same table.
    """
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    cond = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_right_{c}")), cols, F.lit(True))
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_right_{c}" for c in cols])


def lookup_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """``join_on`` for a right side with one row per key, where the left may hold one key very often.

    The key is compared once more by its hash. That keeps Spark from reusing the partitioning
    of the aggregate that made the right side unique: both sides are then shuffled for this
    join alone, which is the form AQE needs to split a hot key over many tasks.
    """
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    cond = F.xxhash64(*cols) == F.xxhash64(*[f"_right_{c}" for c in cols])
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in cols])
