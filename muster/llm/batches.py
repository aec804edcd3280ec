"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from muster.session import shared_folder

#: Texts that are worked on together inside a task; it bounds what Python holds at a time.
GROUP_CHARS = 4_000_000

FOLDS = 5


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The same rows, written once as Parquet below the shared folder and read from there.

    Column names are replaced on the way, so any names are safe; sizes are known afterwards.
    """
    path = shared_folder(df.sparkSession, label)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


def held_out(doc_id):
    """True for the fifth of the documents whose labels are never learned from (null ids are)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for functions that yield lists of columns (in the order of ``schema``)."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for columns in fn(batches):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def with_columns(df: DataFrame, text: str, fn: Callable[[list[str | None]], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` untouched (default all), and those that ``fn`` makes of the texts of a batch.

    The row itself never becomes Python objects: only the text column does. New columns
    replace old ones of the same name.
    """
    added = T.StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *added.fields])
    # A text that is not kept as text goes along under a name of its own.
    source = text if text in kept and df.schema[text].dataType == T.StringType() else "_text_to_read"
    extra = [] if source == text else [F.col(f"`{text}`").cast("string").alias(source)]
    arrow = to_arrow_schema(added)

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                new = fn(part.column(source).to_pylist())
                arrays = [part.column(c) for c in kept] + [pa.array(v, type=f.type) for v, f in zip(new, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added.names])

    return df.select(*[F.col(f"`{c}`") for c in kept], *extra).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, limit: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; one long text is a piece of its own."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()] if batch.num_rows else []
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def rows_of(batch: pa.RecordBatch, text: str, *keys: str) -> Iterator[tuple[list, list[str]]]:
    """Key columns as they are and texts as strings (null as empty), piece by piece."""
    for part in slices(batch, text):
        yield [part.column(k) for k in keys], [t or "" for t in part.column(text).to_pylist()]
