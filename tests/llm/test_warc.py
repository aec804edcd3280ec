"""Archives: round trips, segments, framing and broken records."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from muster.llm import warc

PAGE = "page_id bigint, url string, html string"


def archive(spark, tmp_path, rows, name="w", **options):
    folder = str(tmp_path / name)
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, PAGE).withColumns({"digest": F.lit(1), "payload": F.lit(2), "id": F.lit(3), "_keeper": F.lit(4)})
    warc.write_pages(df.repartition(3), folder, **options)
    return folder


def facts(spark, folder):
    return sorted([tuple(r) for r in warc.page_facts(warc.read_pages(spark, folder)).collect()], key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    quoting = "See WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 30
    texts = [None, "", "a", "\r\n\r\n", "WARC/1.1", "WARC/1.1\r\n", quoting, "é中😀" * 400, "x" * 999, "y" * 1000, "y" * 1000, "long " * 40_000, "0\r\n\r\n"]
    rows = [(i, None if i == 2 else f"http://h/{i} a\r\nWARC/1.1\r\nX: y", t) for i, t in enumerate(texts)]
    rows += [(None, "http://n", "y" * 1000), (5, "u", "again"), (5, "u", "again"), (10, "v", "y" * 1000)]
    for name, options in [("a", {"segment_bytes": 300, "chunk_bytes": 7}), ("b", {}), ("c", {"compression": "gzip", "segment_bytes": 100})]:
        pages = warc.read_pages(spark, archive(spark, tmp_path, rows, name, **options)).collect()
        assert len(pages) == len(rows) and not any(p["error"] for p in pages)
        got = sorted((p["headers"].get(warc.DOCUMENT), bytes(p["payload"])) for p in pages if p["payload"] is not None and warc.DOCUMENT in p["headers"])
        want = sorted((str(i), (t or "").encode()) for i, _, t in rows if i is not None and not (t == "y" * 1000 and i < 10))
        assert got == want
        kinds = {r[0]: r[1] for r in facts(spark, str(tmp_path / name))}
        assert [kinds[9], kinds[10], kinds[8], kinds[None]] == ["revisit", "response", "response", "revisit"]
    revisits = [r for r in facts(spark, str(tmp_path / "a")) if r[1] == "revisit"]
    assert {(r[0], r[2], r[4], r[5]) for r in revisits} == {(9, 1000, 10, None), (None, 1000, 10, None)}


@pytest.mark.parametrize("size", ["997b", "4001b", "64m"])
def test_files_are_read_by_many_tasks(spark, tmp_path, settings, size):
    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choices("\r\nWARC/1. x", k=rng.randrange(0, 700)))) for i in range(300)]
    folder = archive(spark, tmp_path, spark.createDataFrame(rows, PAGE).coalesce(1), segment_bytes=256, chunk_bytes=64)
    settings(spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes="1")
    pages = warc.read_pages(spark, folder).collect()
    assert {(p["headers"][warc.DOCUMENT], bytes(p["payload"])) for p in pages} == {(str(i), t.encode()) for i, _, t in rows}
    assert not any(p["error"] for p in pages) and len(pages) == 300


def test_empty_table(spark, tmp_path):
    assert facts(spark, archive(spark, tmp_path, [])) == []


def raw_record(block, **fields):
    lines = ["WARC/1.1", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_raw(spark, tmp_path, raw, name="x.warc", zipped=False):
    (tmp_path / name).write_bytes(raw)
    return warc.read_records(spark, str(tmp_path / name))


def test_foreign_records(spark, tmp_path):
    quote = b"before WARC/1.1\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\nWARC/1.1\r\n behind"
    parts = [
        raw_record(b"info", WARC_Type="warcinfo", WARC_Record_ID="<i>"),
        raw_record(quote, warc_type="resource", WARC_RECORD_ID="<q>"),
        b"WARC/1.1\r\nWARC-Type: resource\r\n folded\r\nWARC-Type: twice\r\nContent-Length: 900\r\n\r\ncut short\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nno length\r\n\r\n",
        raw_record(b"\x00\xff\xfe raw \r\n", WARC_Type="resource", WARC_Record_ID="<z>"),
    ]
    members = b"".join(map(gzip.compress, parts))
    for raw, name in ((b"".join(parts), "x.warc"), (members, "x.warc.gz")):
        got = [(r["headers"].get("warc-type"), bytes(r["block"]), r["error"]) for r in read_raw(spark, tmp_path, raw, name).collect()]
        assert got[:2] == [("warcinfo", b"info", None), ("resource", quote, None)]
        assert got[2][0] == "resource folded, twice" and "900 expected" in got[2][2]
        assert got[3][2] == "no length of the block" and got[4][1:] == (b"\x00\xff\xfe raw \r\n", None)


def segment(n, block, origin="<o>", **more):
    kind = {"WARC_Type": "response", "WARC_Record_ID": origin} if n == 1 else {"WARC_Type": "continuation", "WARC_Record_ID": f"<{n}>", "WARC_Segment_Origin_ID": origin}
    return raw_record(block, **kind, WARC_Segment_Number=n, **more)


@pytest.mark.parametrize(
    "parts, block, error",
    [
        ([segment(3, b"c", WARC_Segment_Total_Length=3), segment(1, b"a"), segment(2, b"b")], b"abc", None),
        ([segment(1, b"a"), segment(1, b"a"), segment(2, b"b", WARC_Segment_Total_Length=2)], b"ab", None),
        ([segment(1, b"a"), segment(2, b"x"), segment(2, b"b"), segment(3, b"c", WARC_Segment_Total_Length=3)], None, "segment 2 comes twice and differs"),
        ([segment(1, b"a"), segment(3, b"c", WARC_Segment_Total_Length=3)], None, "segment 2 is missing"),
        ([segment(2, b"b", WARC_Segment_Total_Length=2)], None, "segment 1 is missing"),
        ([segment(1, b"a"), segment(2, b"b")], None, "the last segment is missing"),
        ([segment(1, b"a"), segment(2, b"b", WARC_Segment_Total_Length=9)], None, "segments of 2 bytes, 9 expected"),
        ([raw_record(b"b", WARC_Type="continuation", WARC_Segment_Number=2)], None, "segment without number or origin"),
    ],
)
def test_segments(spark, tmp_path, parts, block, error):
    other = [segment(2, b"2", "<p>", WARC_Segment_Total_Length=2), segment(1, b"1", "<p>")]
    got = warc.reassemble(read_raw(spark, tmp_path, b"".join(parts + other)).repartition(4)).collect()
    by_error = {r["error"]: bytes(r["block"]) for r in got if r["headers"].get(warc.RECORD_ID) != "<p>"}
    assert len(got) == 2 and list(by_error) == [error] and (block is None or by_error[error] == block)
    assert [bytes(r["block"]) for r in got if r["headers"].get(warc.RECORD_ID) == "<p>"] == [b"12"]


def test_transfer_framing():
    rng = random.Random(1)
    for _ in range(200):
        payload = bytes(rng.choices(b"\r\n0WARC/1.", k=rng.randrange(0, 200)))
        framed = warc.chunked(payload, rng.randrange(1, 50))
        assert warc.unchunk(framed) == payload and b"WARC/1.1" not in framed
    assert warc.unchunk(b"3;name=x\r\nabc\r\n00\r\nTrailer: t\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(broken)


def test_broken_payloads_and_lost_responses(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n"
    message = {"Content_Type": "application/http; msgtype=response", "WARC_Type": "response"}
    raw = raw_record(http + b"5\r\nab", **message, X_Document_Id=1)
    raw += raw_record(http + b"2\r\nab\r\n0\r\n\r\n", **message, X_Document_Id=2, WARC_Payload_Digest="sha256:00")
    raw += raw_record(b"HTTP/1.1 200 OK\r\n\r\nplain", **message, X_Document_Id=3)
    raw += raw_record(b"", WARC_Type="revisit", X_Document_Id=4, WARC_Payload_Digest="sha256:11")
    read_raw(spark, tmp_path, raw)
    got = {r[0]: (r[1], r[2], r[5]) for r in facts(spark, str(tmp_path / "x.warc"))}
    assert got[1] == ("response", None, "chunk at byte 3 is cut short")
    assert got[2] == ("response", 2, "payload and digest differ")
    assert got[3] == ("response", 5, None)
    assert got[4] == ("revisit", None, "no response has this digest")
