"""WARC archives in Zstandard, one frame per record, with the dictionary in a leading skippable frame.

Each task writes the records of its rows as archives of bounded size into a shared folder. A file
gets its final name only when it is whole, and the name depends on the rows' place alone, so a
retried or repeated task replaces its file by an equal one. The reader takes a folder through
Spark's binary file source, finds the frames by their own headers and checks every record.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, shared_path, table

LEAST = 100
"""Payload bytes from which equal payloads are stored once."""
SALTS = 64
ARCHIVE_BYTES = 16 * 1024 * 1024
"""Record bytes, before compression, after which a new archive begins."""
DICTIONARY_BYTES, SAMPLES = 16 * 1024, 256
"""Size of an archive's dictionary and how many of its first records it is made from; only a matter of size."""

# Fixed values of the formats.
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D
DIGEST = "sha256:"
ROOT = "urn:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
NEEDED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"


# --- records ---------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, size, digest, response_id): ``response_id`` is the row that a revisit points to, else null.

    Of equal payloads of at least ``least`` bytes the smallest id is the response; all rows with that
    id are (repeated rows), and rows with a null id point to it. The smallest id is taken in salted
    parts first, and the rows meet it by digest and salt, so that no payload's copies meet in one task.
    """
    value = F.coalesce(F.col(quoted(payload)), F.lit(""))
    rows = pages.select(
        F.col(quoted(id_)).alias("id"),
        F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        value.alias("payload"),
        F.octet_length(value).cast("bigint").alias("size"),
        F.sha2(value.cast("binary"), 256).alias("digest"),
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    parts = rows.where(F.col("size") >= least).groupBy("digest", "salt").agg(F.min("id").alias("id"))
    first = (
        parts.groupBy("digest").agg(F.min("id").alias("first"), F.collect_list("salt").alias("salts"))
        .select("digest", "first", F.explode("salts").alias("salt"))
    )
    return rows.join(first, ["digest", "salt"], "left").select(
        "id", "url", "payload", "size", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("response_id"),
    )


def record(id_: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    headers = {
        "WARC-Type": "response" if response_id is None else "revisit",
        "WARC-Record-ID": f"<{ROOT}{'' if id_ is None else id_}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or "about:blank"),
        "WARC-Payload-Digest": DIGEST + digest,
        "Content-Type": "application/http; msgtype=response",
    }
    if response_id is not None:
        headers["WARC-Refers-To"] = f"<{ROOT}{response_id}>"
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    block = HTTP.format(len(payload)).encode() + (payload if response_id is None else b"")
    headers["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; raises ValueError where a header or a length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in NEEDED:
        if name.lower() not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4:
        raise ValueError("Content-Length does not fit the record")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record does not end in two line ends")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return {"record_type": kind, "id": headers["warc-record-id"]}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    if not gap or not length:
        raise ValueError("no HTTP headers with a length")
    named = headers.get("warc-payload-digest", "")
    if kind == "response":
        if int(length[1]) != len(payload):
            raise ValueError("the HTTP length does not fit the payload")
        digest = hashlib.sha256(payload).hexdigest()
        if named and named != DIGEST + digest:
            raise ValueError("the payload does not have its digest")
    else:
        if payload or not named.startswith(DIGEST) or "warc-refers-to" not in headers:
            raise ValueError("not a revisit of an identical payload")
        digest = named.removeprefix(DIGEST)
    return {
        "record_type": kind,
        "id": headers["warc-record-id"],
        "url": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


# --- archives --------------------------------------------------------------------------------


def dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary from a few records; plain content where they are too few to train on."""
    if len(samples) >= 32:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b""


def archive(records: list[bytes]) -> bytes:
    """Records as an archive: the dictionary (if any) in a skippable frame, then a frame each."""
    data = dictionary(records[:SAMPLES])
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    lead = struct.pack("<II", SKIPPABLE, len(data)) + data if data else b""
    return lead + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic number, start, end) of each frame, from the frame and block headers alone."""
    at, n = 0, len(data)
    while at < n:
        start = at
        if n - at < 8:
            raise ValueError("the archive ends within a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == FRAME:
            flags = data[at + 4]
            single = flags >> 5 & 1
            content = (single, 2, 4, 8)[flags >> 6]
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
            last = False
            while not last:
                if at + 3 > n:
                    raise ValueError("the archive ends within a frame")
                block = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no frame at byte {start}")
        if at > n:
            raise ValueError("the archive ends within a frame")
        yield magic, start, at


def unpack(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each record frame of an archive."""
    view, reader, first = memoryview(data), zstandard.ZstdDecompressor(), True
    try:
        for magic, start, end in frames(data):
            if magic != FRAME:
                if first and magic == SKIPPABLE:
                    held = bytes(view[start + 8 : end])
                    if held[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be packed
                        held = reader.decompressobj().decompress(held)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                first = False
                continue
            first = False
            try:
                yield start, reader.decompressobj().decompress(view[start:end]), None
            except zstandard.ZstdError as error:
                yield start, None, str(error)
    except ValueError as error:
        yield -1, None, str(error)


# --- Spark -----------------------------------------------------------------------------------


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write ``rows`` (as of ``with_revisits``) below ``folder``; returns the number of records.

    ``folder`` is a URI that every executor can write (file on a shared mount, s3, gs, hdfs). The
    rows of a task are written in order of id, so its files are the same in every attempt.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        number, held, size, written = 0, [], 0, 0

        def flush() -> None:
            nonlocal number, held, size
            name = f"part-{part:06d}-{number:06d}.warc.zst"
            with store.open_output_stream(f"{path}/_{name}-{attempt}") as out:
                out.write(archive(held))
            store.move(f"{path}/_{name}-{attempt}", f"{path}/{name}")
            number, held, size = number + 1, [], 0

        for batch in batches:
            ids = batch["id"].tolist()
            targets = batch["response_id"].tolist()
            for id_, url, payload, digest, to in zip(ids, batch["url"], batch["payload"], batch["digest"], targets):
                known = lambda x: None if x is None or x != x else int(x)
                held.append(record(known(id_), url, payload.encode("utf-8", "replace"), digest, known(to)))
                size += len(held[-1])
                written += 1
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        yield pd.DataFrame({"n": [written]})

    ordered = rows.sortWithinPartitions("id", "url", "digest").select(
        F.col("id").cast("string"), "url", "payload", "digest", F.col("response_id").cast("string")
    )
    return ordered.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


RECORD = (
    "archive string, offset bigint, id string, url string, record_type string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary, error string"
)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the ``.warc.zst`` files below ``folder``, in the columns of ``RECORD``.

    A record that cannot be unpacked or has wrong headers or lengths is a row with ``error`` set; so
    is the place at which an archive breaks off. A folder without archives gives no rows.
    """
    names = [f.name for f in _fields()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                found, size = [], 0
                for offset, raw, error in unpack(data.as_py()):
                    row = {"archive": name, "offset": offset, "error": error}
                    if error is None:
                        try:
                            row |= parse(raw)
                            row["id"] = row["id"].strip("<>")
                            row["refers_to"] = (row.get("refers_to") or "").strip("<>") or None
                        except ValueError as wrong:
                            row["error"] = str(wrong)
                    if not payload:
                        row["payload"] = None
                    found.append(row)
                    size += len(row.get("payload") or b"")
                    if len(found) >= 2000 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(found, pa.schema(_fields()))
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema(_fields()))

    files = (
        spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    )
    return files.select("path", "content").mapInArrow(run, RECORD).select(*names)


def _fields() -> list[pa.Field]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in RECORD.split(", "))]


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into an archive and read back."""
    folder = shared_path(spark, "warc")
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    write_archives(with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), uri)
    back = read_archives(spark, folder, payload=False)
    number = F.nullif(F.substring("id", len(ROOT) + 1, 40), F.lit("")).cast("bigint")
    return back.select(
        number.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.substring("refers_to", len(ROOT) + 1, 40).cast("bigint").alias("refers_to"),
        "error",
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha256(html) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
  NULL::VARCHAR AS error
FROM f
"""
