"""WARC archives: writing pages as records, reading records back, and putting segments together again.

An archive is text to Spark: its reader cuts files of any size at the version line that opens a
record, so a record belongs to the split it starts in and large files are read by many tasks. A
payload that quotes such a line would be cut too; a record that is shorter than its
``Content-Length`` is therefore joined with what follows until its length is met. Archives
written here never need that: a chunk of the transfer framing ends inside every such line.

A record too long for one segment goes on in ``continuation`` records. They are brought together by
the identifier of the record they continue, sorted by segment number, and checked against the total
length; only then is the transfer framing taken off.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from muster.functions.common import lookup_join
from muster.llm.batches import GROUP_CHARS, arrow_map, slices, stored

VERSION = "WARC/1.1"
_END = b"\r\n\r\n"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD_SCHEMA = "file string, headers map<string,string>, block binary, error string"
#: Header fields by their names in lower case.
TYPE, RECORD_ID, ORIGIN_ID, SEGMENT, TOTAL, DIGEST, DOCUMENT = (
    "warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-payload-digest", "x-document-id",
)


# -- writing ----------------------------------------------------------------------------


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunks of at most ``size`` bytes; no chunk holds a whole version line's start."""
    cuts = set(range(0, len(payload), size)) | {len(payload)}
    cuts |= {m.start() + 5 for m in re.finditer(VERSION.encode(), payload)}
    ends = sorted(cuts)
    out = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(ends, ends[1:])]
    return b"".join(out) + b"0" + _END


def header_uri(url: str) -> bytes:
    """The address as one line: control characters and spaces become percent codes, and so does a version line."""
    line = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace"))
    return line.replace(VERSION.encode(), b"%57" + VERSION.encode()[1:])


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION.encode(), *[name + b": " + value for name, value in fields], b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + _END + block


def page_records(doc_id, url: str | None, payload: bytes | None, digest: str, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """Records of one page, without the blank lines behind them; a null payload makes a revisit."""
    name = b"<urn:uuid:%b>" % str(uuid.uuid4()).encode()
    kind = b"revisit" if payload is None else b"response"
    first = [(b"WARC-Type", kind), (b"WARC-Record-ID", name), (b"WARC-Date", date.encode())]
    if url is not None:
        first.append((b"WARC-Target-URI", header_uri(url)))
    if doc_id is not None:
        first.append((b"X-Document-Id", quote(str(doc_id), safe="").encode()))
    first.append((b"WARC-Payload-Digest", b"sha256:" + digest.encode()))
    if payload is None:
        yield _record([*first, (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")
        return
    first.append((b"Content-Type", b"application/http; msgtype=response"))
    block = _HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*first, (b"WARC-Segment-Number", b"1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = b"<urn:uuid:%b>" % str(uuid.uuid4()).encode()
        fields = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", own), (b"WARC-Date", date.encode()), (b"WARC-Segment-Origin-ID", name), (b"WARC-Segment-Number", b"%d" % n)]
        if n == len(parts):
            fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(fields, part)


def write_pages(pages: DataFrame, folder: str, least: int = 1000, segment_bytes: int = 16_384, chunk_bytes: int = 8_192, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, compression: str = "none") -> None:
    """Write every row as a record into archives below ``folder``, which all executors must share.

    Rows with the same payload of at least ``least`` bytes keep it once: in the response of the
    largest id; the others are revisits that name its digest. Rows that repeat that id and
    payload are all responses, and where all ids are null nothing is a revisit. A null payload is
    an empty one; a null address or id gives no such field. Other columns are not written.
    """
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
    # Stored, so that its size is known and payloads cross a shuffle only where it is large.
    shared = stored(shared.filter("_n > 1 and _keeper is not null").drop("_n"), "warc-shared")
    again = F.col("_keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("_keeper")))
    rows = lookup_join(rows, shared, ["digest"]).select("id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest")

    def write(batches):
        for batch in batches:
            for part in slices(batch, "payload"):
                values = zip(*[part.column(c).to_pylist() for c in ("id", "url", "payload", "digest")])
                records = [r for row in values for r in page_records(*row, date, segment_bytes, chunk_bytes)]
                yield [pa.array(records, pa.binary())]

    out = arrow_map(rows, write, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", _END.decode()).option("compression", compression).text(folder)


# -- reading ----------------------------------------------------------------------------


def parse_headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that starts with white space goes on with the one before, repeated fields are joined."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name is not None:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def split_records(pieces: Iterable[tuple], mark: bytes) -> Iterator[tuple]:
    """``(file, headers, block, error)`` from what lies between version lines, given as ``(place, file, bytes)`` in order."""
    source, back = iter(pieces), deque()

    def following():
        return back.popleft() if back else next(source, None)

    while (piece := following()) is not None:
        place, file, raw = piece
        if not raw:
            continue  # before the first version line
        head, end, rest = raw.partition(_END)
        headers = parse_headers(head)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            yield file, headers, rest, "no length of the block"
            continue
        if not end or length < 0:
            yield file, headers, rest, "broken header"
            continue
        got, used = len(rest), []
        while got < length:
            more = following()
            if more is None:
                break
            if more[0] != place:
                back.appendleft(more)
                break
            used.append(more)
            got += len(mark) + len(more[2])
        # Two line ends belong behind a block; the last record of a file may lack them.
        if got == length or got == length + len(_END):
            yield file, headers, b"".join([rest, *[mark + u[2] for u in used]])[:length], None
        else:
            back.extendleft(reversed(used))
            yield file, headers, rest, f"block of {len(rest)} bytes, {length} expected"


def read_records(spark: SparkSession, paths, version: str = VERSION) -> DataFrame:
    """``file, headers, block, error`` of every record of the archives, plain or gzip, of any size.

    ``headers`` has lower-case names. A record that can't be read comes with the reason in
    ``error`` and what there is of its block. A record that quotes a version line exactly where a
    file is split into tasks is such a case; gzip archives are never split.
    """
    mark = f"{version}\r\n"
    raw = spark.read.option("lineSep", mark).text(paths)
    place = F.concat_ws("@", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    raw = raw.select(place.alias("place"), F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def read(batches):
        def pieces():
            for batch in batches:
                for part in slices(batch, "piece"):
                    yield from zip(*[part.column(c).to_pylist() for c in ("place", "file", "piece")])

        held, size = [], 0
        for record in split_records(pieces(), mark.encode()):
            held.append(record)
            size += len(record[2])
            if size > GROUP_CHARS or len(held) >= 10_000:
                yield _record_columns(held)
                held, size = [], 0
        if held:
            yield _record_columns(held)

    return arrow_map(raw, read, RECORD_SCHEMA)


def _record_columns(records: list[tuple]) -> list:
    files, headers, blocks, errors = zip(*records)
    maps = pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string()))
    return [list(files), maps, list(blocks), list(errors)]


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def join_segments(parts: list[tuple]) -> tuple:
    """``(file, headers, block, error)`` of one record from its ``(segment, file, headers, block, error)`` in order."""
    _, file, headers, _, _ = parts[0]
    blocks, expected, error, total = [], 1, None, None
    for n, _, fields, block, broken in parts:
        if broken:
            error = error or f"segment {n}: {broken}"
        elif n == expected:
            blocks.append(block)
            expected += 1
        elif n == expected - 1 and blocks and block == blocks[-1]:
            continue  # the same segment once more
        elif n < expected:
            error = error or f"segment {n} comes twice and differs"
        else:
            error = error or f"segment {expected} is missing"
            expected = n + 1
        total = fields.get(TOTAL, total)
    whole = b"".join(blocks)
    if error is None and (total is None or not total.isdigit()):
        error = "the last segment is missing"
    if error is None and int(total) != len(whole):
        error = f"segments of {len(whole)} bytes, {total} expected"
    return file, headers, whole, error


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their segments put together; same columns as ``read_records``.

    Segments meet by the identifier of the record they continue and are sorted by number, one
    record at a time. Missing, differing or too few bytes are named in ``error``; a segment that
    comes twice alike counts once. A continuation that names no record stays a row of its own
    with an error. Records without segments cross no shuffle.
    """
    number = F.try_to_number(header(SEGMENT), F.lit("999999999")).cast("int")
    origin = F.when(header(TYPE) == "continuation", header(ORIGIN_ID)).otherwise(header(RECORD_ID))
    loose = header(SEGMENT).isNull() & (F.coalesce(header(TYPE), F.lit("")) != "continuation")
    whole = records.filter(loose)
    parts = records.filter(~loose).select(origin.alias("origin"), number.alias("segment"), "file", "headers", "block", "error")
    lost = F.col("origin").isNull() | F.col("segment").isNull()
    nameless = parts.filter(lost).select("file", "headers", "block", F.coalesce("error", F.lit("segment without number or origin")).alias("error"))
    sorted_parts = parts.filter(~lost).repartition("origin").sortWithinPartitions("origin", "segment")

    def join(batches):
        now, held = None, []
        for batch in batches:
            for part in slices(batch, "block"):
                done = []
                for origin, *rest in zip(*[part.column(c).to_pylist() for c in ("origin", "segment", "file", "headers", "block", "error")]):
                    if origin != now and held:
                        done.append(join_segments(held))
                        held = []
                    now = origin
                    rest[2] = dict(rest[2])
                    held.append(tuple(rest))
                if done:
                    yield _record_columns(done)
        if held:
            yield _record_columns([join_segments(held)])

    return whole.unionByName(arrow_map(sorted_parts, join, RECORD_SCHEMA)).unionByName(nameless)


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing; ValueError where the framing breaks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
            raise ValueError(f"no chunk size at byte {at}")
        size = int(digits, 16)
        at = end + 2
        if size == 0:
            return b"".join(out)  # trailing fields, if any, are no payload
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk at byte {at} is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Body of an HTTP message without its transfer framing."""
    head, end, body = block.partition(_END)
    if not end:
        raise ValueError("no end of the HTTP header")
    framing = parse_headers(head).get("transfer-encoding", "")
    return unchunk(body) if framing.lower().split(",")[-1].strip() == "chunked" else body


def payloads(records: DataFrame) -> DataFrame:
    """``headers, payload, error`` of whole records: the body of an HTTP message, the block of any other.

    A revisit has a null payload. So has a record with an ``error``, here also where the framing breaks.
    """
    message = F.coalesce(header("content-type").startswith("application/http"), F.lit(False))
    rows = records.select("headers", "block", "error", message.alias("message"), (header(TYPE) == "revisit").alias("revisit"))

    def decode(batches):
        for batch in batches:
            for part in slices(batch, "block"):
                blocks, errors = part.column("block").to_pylist(), part.column("error").to_pylist()
                kinds = zip(part.column("message").to_pylist(), part.column("revisit").to_pylist())
                for i, (message, revisit) in enumerate(kinds):
                    if errors[i] is not None or revisit:
                        blocks[i] = None
                    elif message:
                        try:
                            blocks[i] = http_payload(blocks[i])
                        except ValueError as e:
                            blocks[i], errors[i] = None, str(e)
                yield [part.column("headers"), pa.array(blocks, pa.binary()), errors]

    return arrow_map(rows, decode, "headers map<string,string>, payload binary, error string")


def read_pages(spark: SparkSession, paths) -> DataFrame:
    """``headers, payload, error`` of all responses and revisits of archives, segments put together."""
    return payloads(reassemble(read_records(spark, paths)))


def page_facts(pages: DataFrame, id_type: str | T.DataType = "bigint") -> DataFrame:
    """``page_id, record_type, payload_bytes, payload_digest, refers_to, error`` of pages read back.

    ``payload_digest`` is the SHA-1 of the whole payload. A revisit gets size, digest and, as
    ``refers_to``, the id from the response whose payload has the digest it names (the largest id
    among repeated ones); without such a response they are null and ``error`` says so. A response
    whose payload has another digest than its record says has an ``error``.
    """
    text_id = F.udf(lambda v: None if v is None else unquote(v)) if id_type == "string" else lambda c: c
    own = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    wrong = F.when(F.col("payload").isNotNull() & (own != header(DIGEST)), F.lit("payload and digest differ"))
    facts = pages.select(
        text_id(header(DOCUMENT)).cast(id_type).alias("page_id"),
        header(TYPE).alias("record_type"),
        header(DIGEST).alias("digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.coalesce("error", wrong).alias("error"),
    )
    # Small rows, read twice below: archives are parsed once.
    facts = stored(facts, "warc-facts")
    kept = facts.filter("record_type = 'response' and error is null")
    kept = kept.groupBy("digest").agg(F.max("page_id").alias("_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_sha1"))
    again = lookup_join(facts.filter("record_type = 'revisit'"), kept, ["digest"])
    nothing = F.when(F.col("_bytes").isNull(), F.lit("no response has this digest"))
    again = again.select("page_id", "record_type", F.col("_bytes").alias("payload_bytes"), F.col("_sha1").alias("payload_digest"), F.col("_to").alias("refers_to"), F.coalesce("error", nothing).alias("error"))
    first = facts.filter(F.coalesce(F.col("record_type") != "revisit", F.lit(True)))
    return first.select("page_id", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast(facts.schema["page_id"].dataType).alias("refers_to"), "error").unionByName(again)
