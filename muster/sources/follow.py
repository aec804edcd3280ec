"""Files that grow, as a stream: every line that is appended comes once.

The offset of the stream is the number of bytes read of each file. A batch reads from the last
offset up to the last line end that is there, so a line that is still being written waits for
a later batch; after a restart the stream goes on where its checkpoint says. What is new in a file
is read by as many tasks as it has parts of ``part_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "file string, position bigint, line string"
_BLOCK = 1 << 20
_ROWS = 10_000


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or an address."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def open_for_writing(folder: str, name: str):
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path.rstrip('/')}/{name}")


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file; both are line starts of the batch, or cuts between them."""

    def __init__(self, file: str, start: int, end: int, first: int, last: int):
        self.file, self.start, self.end, self.first, self.last = file, start, end, first, last


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes = folder, part_bytes
        self.seen: dict[str, int] = {}

    def _files(self) -> dict[str, int]:
        fs, path = _store(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where whole lines end in every file that is there now."""
        fs, _ = _store(self.folder)
        now = {}
        for file, size in sorted(self._files().items()):
            known = self.seen.get(file, 0)
            # A file that has become smaller was begun anew.
            now[file] = known if size == known else _last_line_end(fs, file, known if size > known else 0, size)
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for file, last in end.items():
            first = start.get(file, 0)
            if last < first:
                first = 0
            out += [Part(file, at, min(at + self.part_bytes, last), first, last) for at in range(first, last, self.part_bytes)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Lines that start in the part; one that starts there is read to its end, wherever that is."""
        fs, _ = _store(self.folder)
        with fs.open_input_file(part.file) as f:
            at = part.start
            if at > part.first:
                # The line that holds the byte before belongs to the part before.
                at = _next_line(f, at - 1, part.last)
            rows: list[tuple] = []
            rest: list[bytes] = []
            f.seek(at)
            read = at
            while at < part.end:
                block = f.read(min(_BLOCK, part.last - read))
                if not block:
                    raise OSError(f"{part.file} has become shorter than {part.last} bytes while it was read")
                read += len(block)
                *lines, begun = block.split(b"\n")
                if lines:
                    lines[0] = b"".join([*rest, lines[0]])
                    rest = []
                rest.append(begun)
                for line in lines:
                    if at >= part.end:
                        break
                    rows.append((part.file, at, line.decode("utf-8", "replace")))
                    at += len(line) + 1
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    files, places, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "position", "line"])


def _last_line_end(fs: pafs.FileSystem, file: str, known: int, size: int) -> int:
    """Offset behind the last line feed between ``known`` and ``size``, looked for from the end."""
    with fs.open_input_file(file) as f:
        end = size
        while end > known:
            start = max(known, end - _BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


def _next_line(f, at: int, last: int) -> int:
    """Offset behind the first line feed at or after ``at``."""
    f.seek(at)
    while at < last:
        block = f.read(min(_BLOCK, last - at))
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return last


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options["path"], int(self.options.get("part_bytes", 64 << 20)))


def follow_files(spark: SparkSession, folder: str, part_bytes: int = 64 << 20) -> DataFrame:
    """Streaming ``file, position, line`` of all files below a folder, and of what is appended to them.

    ``position`` is the byte a line starts at, so the lines of a file can be put in order. Lines end with
    a line feed; bytes that are not UTF-8 become replacement characters. Files whose names start
    with a dot or an underscore are left out. A file that has become smaller is read again from its
    start; one that is renamed is a new file. ``folder`` must be one that all executors reach.
    The offset of every batch names all files, so rotate and remove them rather than keep millions.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(FORMAT).option("part_bytes", str(part_bytes)).load(folder)
