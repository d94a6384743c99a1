from __future__ import annotations

import struct

import pytest
import zstandard
from check_queries import connect, difference

from pairflow.llm import warc

SF = "/root/testdata/sf0.001"
LONG = "long enough to be stored once " * 5


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_query_equals_sql(spark):
    assert difference(warc.op3_warc(spark, SF).toPandas(), connect(SF).execute(warc.OP3_SQL).df()) is None


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [
        (5, "u", LONG), (3, "u\r\nX: y", LONG), (9, None, LONG), (None, "n", LONG), (3, "u\r\nX: y", LONG), (1, "a", "short"), (2, "b", "short"),
        (4, "c", None), (6, "d", ""), (7, "e", "é\U0001F600\r\n\r\n" * 60), (8, "f", "x" * 3_000_000), (None, None, None),
    ]
    folder = f"file://{tmp_path}/out"
    assert warc.write_archives(warc.with_revisits(pages(spark, rows)), folder, archive_bytes=100_000) == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    by = sorted((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_bytes"] == len(LONG))
    page = lambda i: f"urn:page:{i}"
    assert by == sorted(
        [(page(3), "response", None, 150), (page(3), "response", None, 150)] + [(page(i), "revisit", page(3), 150) for i in (5, 9, "")]
    )
    texts = {r["id"]: r["payload"].decode() for r in got if r["record_type"] == "response" and r["id"] != page("")}
    assert texts == {page(i): (h or "") for i, _, h in rows if i in (1, 2, 3, 4, 6, 7, 8)}


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    (tmp_path / "none").mkdir()
    assert warc.write_archives(warc.with_revisits(pages(spark, [])), folder) == 0
    assert warc.read_archives(spark, folder).count() == 0


def records(n=40):
    return [warc.record(i, f"http://x/{i}", (f"<p>{i}</p>" * 20).encode(), "", None) for i in range(n)]


def test_archive_has_its_dictionary_ahead():
    made = [r.replace(b"WARC-Payload-Digest: sha256:\r\n", b"") for r in records(200)]
    data = warc.archive(made)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE
    assert [m for m, _, _ in warc.frames(data)][1:] == [warc.FRAME] * 200
    assert [r for _, r, _ in warc.unpack(data)] == made
    held = data[8 : 8 + struct.unpack_from("<I", data, 4)[0]]
    packed = zstandard.compress(held)
    assert [r for _, r, _ in warc.unpack(struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + len(held) :])] == made
    assert [r for _, r, _ in warc.unpack(warc.archive(made[:3]))] == made[:3]


def test_broken_archives_and_records_are_told():
    data = warc.archive(records(3))
    assert [e is None for _, _, e in warc.unpack(data[:-5])] == [True, True, False]
    spoilt = bytearray(data)
    spoilt[20] ^= 0xFF
    assert any(e for _, _, e in warc.unpack(bytes(spoilt))) or [r for _, r, _ in warc.unpack(bytes(spoilt))] != records(3)
    good = warc.record(1, "u", b"payload", "239f59ed55e737c77147cf55ad0c1b030b6d7ee748a7426952f9b852d5a935e5", None)
    assert warc.parse(good)["payload"] == b"payload"
    for wrong in (
        good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Data"),
        good.replace(b"payload\r", b"paYload\r"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b"",
    ):
        with pytest.raises(ValueError):
            warc.parse(wrong)
