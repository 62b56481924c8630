"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends in
the seekable format's table of frame sizes, and an index gives each record's
frame and its offset there. Bundles are rows of a table, so any store that
Spark writes can hold them; :func:`export` makes files of them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import map_arrow, materialise, shared_folder, slices

#: Bytes of records in a frame, and of frames in a bundle, before the next begins.
FRAME, BUNDLE = 256 << 10, 8 << 20
#: Fixed values of the seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "array<struct<record_id:string,frame:int,offset:long,length:long>>"
_SCHEMA = f"bundle string, content binary, index {_INDEX}"
_INDEX_TYPE = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    """The record's identifier; rows without an id share one."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(text: str | None) -> int | None:
    digits = text[len("<urn:page:") : -1] if text else ""
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header with the size of its payload, not the payload."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = _HTTP.format(size).encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer frame: compressed and plain size of every frame."""
    entries = b"".join(struct.pack("<II", *x) for x in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(content: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame of a bundle, from its footer."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", content, len(content) - 9 - 8 * (count - i))
        out.append((at, packed, plain))
        at += packed
    return out


class _Writer:
    """Collects records into frames and bundles."""

    def __init__(self) -> None:
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.reset()

    def reset(self) -> None:
        self.done, self.sizes, self.index, self.now, self.total = [], [], [], bytearray(), 0

    def add(self, key: str, data: bytes) -> pa.RecordBatch | None:
        self.index.append({"record_id": key, "frame": len(self.done), "offset": len(self.now), "length": len(data)})
        self.now += data
        if len(self.now) >= FRAME:
            self.close_frame()
        return self.close() if self.total >= BUNDLE else None

    def close_frame(self) -> None:
        packed = self.zstd.compress(bytes(self.now))
        self.done.append(packed)
        self.sizes.append((len(packed), len(self.now)))
        self.total += len(packed)
        self.now = bytearray()

    def close(self) -> pa.RecordBatch | None:
        if self.now:
            self.close_frame()
        if not self.done:
            return None
        content = b"".join(self.done) + seek_table(self.sizes)
        name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
        out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([self.index], _INDEX_TYPE)], names=["bundle", "content", "index"])
        self.reset()
        return out


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = _Writer()
    for batch in batches:
        for part in slices(batch, "payload"):
            for page, url, payload, size, sha1, refers_to, revisit in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "bytes", "sha1", "refers_to", "revisit")), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out = writer.add(record_id(page), record(page, url, payload, size, digest, refers_to, revisit))
                if out is not None:
                    yield out
    if (out := writer.close()) is not None:
        yield out


def bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(bundle, content, index) with one record per row of ``pages``.

    Of records with equal payloads of ``least`` bytes or more, those with the
    largest page id are responses and the others revisit it; smaller payloads
    are all responses. A null html is an empty payload. Rows without an id are
    responses if no row of their payload has one. Other columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    # written first: the join below stands between two plain exchanges, so a payload that many rows share can be split,
    # and it is the only time that payloads are shuffled
    winners = materialise(rows.groupBy("sha1").agg(F.max("page_id").alias("winner")))
    known = rows.join(winners.hint("merge"), "sha1").withColumn("revisit", (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("winner")))
    known = known.withColumn("refers_to", F.when(F.col("revisit"), F.col("winner"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    known = known.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    return known.select("page_id", "url", "payload", "bytes", "sha1", "refers_to", "revisit").mapInArrow(_bundle, _SCHEMA)


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """The bundles of ``pages`` as a table at ``path``."""
    bundles(pages, **columns).write.mode("overwrite").parquet(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _record_row(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
    return _id_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], _id_of(head.get("WARC-Refers-To")), payload if head["WARC-Type"] == "response" else None


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ROW_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_ROW_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _rows(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    n = 6 + payloads
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ROW_TYPES[i]) for i in range(n)], names=_ROW_NAMES[:n])


def read_archive(table: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the bundles, frame after frame; payload digests are checked."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for content in batch.column("content"):
            raw = content.as_py()
            for at, packed, plain in frames_of(raw):
                data = zstd.decompress(raw[at : at + packed], max_output_size=plain)
                yield _rows([_record_row(h, b) for h, b in parse(data)], payloads)

    return map_arrow(table.select("content"), run, _ROW + ", payload binary" * payloads)


def fetch(table: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of these pages with payloads: only the frames that hold them are decompressed."""
    wanted = {record_id(i) for i in page_ids}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for raw, hits in zip(batch.column("content").to_pylist(), batch.column("index").to_pylist(), strict=True):
            frames, open_frames, rows = frames_of(raw), {}, []
            for x in (h for h in hits if h["record_id"] in wanted):
                at, packed, plain = frames[x["frame"]]
                if x["frame"] not in open_frames:
                    open_frames[x["frame"]] = zstd.decompress(raw[at : at + packed], max_output_size=plain)
                data = open_frames[x["frame"]][x["offset"] : x["offset"] + x["length"]]
                rows += [_record_row(h, b) for h, b in parse(data)]
            if rows:
                yield _rows(rows, True)

    return map_arrow(table.where(F.exists("index", lambda x: x["record_id"].isin(sorted(wanted)))).select("content", "index"), run, _ROW + ", payload binary")


def export(table: DataFrame, folder: str) -> None:
    """A ``.warc.zst`` file per bundle in a folder that every executor reaches."""

    def run(rows) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{path}/{row['bundle']}", compression=None) as out:
                out.write(bytes(row["content"]))

    table.select("bundle", "content").foreachPartition(run)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as bundles to the shared folder and read every record back."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
