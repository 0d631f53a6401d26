"""WARC archives as a table of record chunks: oversized payloads pass through as rows, digests grow chunk by chunk."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.shared import new_path

CHUNK = 1 << 18
#: Bytes of chunks that a task holds before it passes them on.
HELD = 8 << 20
CHUNKS = "record long, chunk int, chunks int, data binary, digest binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def head_of(page: int | None, url: str | None, size: int, digest: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """WARC and HTTP headers of a record; a revisit ends with them, a response goes on with its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base32(digest)}",
        *([f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class Chunker:
    """Gathers chunk rows and hands them on in batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, bytes, bytes]] = []
        self.size = 0

    def add(self, record: int, pieces: list[memoryview | bytes]) -> Iterator[pa.RecordBatch]:
        """The pieces of a record, in order, as chunks; a chunk's digest is that of the record up to its end."""
        seen, chunk, held = hashlib.sha1(), 0, b""
        chunks = max(1, -(-sum(map(len, pieces)) // CHUNK))
        for piece in pieces:
            view = memoryview(piece)
            at = 0
            while at < len(view):
                take = min(CHUNK - len(held), len(view) - at)
                held += bytes(view[at : at + take])
                at += take
                if len(held) == CHUNK:
                    seen.update(held)
                    yield from self.push(record, chunk, chunks, held, seen.digest())
                    chunk, held = chunk + 1, b""
        if held or not chunk:
            seen.update(held)
            yield from self.push(record, chunk, chunks, held, seen.digest())

    def push(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += len(row[3])
        if self.size >= HELD:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 5
        self.rows, self.size = [], 0
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record", "chunk", "chunks", "data", "digest"])


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the record of every page to the chunk table at ``path``; a record's chunks in order are its bytes in a WARC file.

    Of equal payloads of at least ``least`` bytes, the one with the largest id is the response; the others refer to it and
    carry no payload. Equality is that of the SHA-1 digest and the size. The election works on digests alone.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.col(url_column).alias("url"), F.coalesce(F.col(payload_column), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    slim = rows.where(F.col("size") >= least).select("page", "digest", "size")
    chosen = slim.groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    revisits = slim.join(chosen, ["digest", "size"]).where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("__page"), F.col("digest").alias("__digest"), "first").distinct()
    ready = rows.join(revisits, F.col("page").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").select(F.monotonically_increasing_id().alias("record"), "page", "url", "payload", "digest", "size", "first")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in batches:
            columns = [batch[c] for c in ("record", "page", "url", "payload", "digest", "size", "first")]
            for i in range(batch.num_rows):
                record, page, url, payload, digest, size, first = (c[i] for c in columns)
                revisit = first.is_valid
                head = head_of(page.as_py(), url.as_py(), size.as_py(), digest.as_py(), first.as_py(), revisit, date)
                body = [] if revisit else [memoryview(payload.as_buffer())]
                yield from chunker.add(record.as_py(), [head, *body, b"\r\n\r\n"])
        yield chunker.flush()

    ready.mapInArrow(chunked, CHUNKS).write.option("compression", "zstd").parquet(path)


class RecordReader:
    """Reads one record from its chunks in order; holds its headers, never its payload."""

    def __init__(self, record: int) -> None:
        self.record, self.next, self.running = record, 0, hashlib.sha1()
        self.head, self.fields, self.left = b"", None, 0
        self.payload, self.size = hashlib.sha1(), 0

    def feed(self, chunk: int, data: bytes, digest: bytes) -> None:
        self.running.update(data)
        if chunk != self.next or self.running.digest() != digest:
            raise ValueError(f"record {self.record}: chunk {chunk} is out of place or damaged")
        self.next += 1
        if self.fields is None:
            self.head += data
            first = self.head.find(b"\r\n\r\n")
            second = self.head.find(b"\r\n\r\n", first + 4) if first >= 0 else -1
            if second < 0:
                return
            data, self.head = self.head[second + 4 :], self.head[: second + 4]
            split = lambda part: dict(line.split(": ", 1) for line in part.decode().split("\r\n")[1:] if ": " in line)
            self.fields, self.http = split(self.head[:first]), split(self.head[first + 4 : second])
            self.left = int(self.fields["Content-Length"]) - (second + 4 - first - 4)
        body = data[: self.left]
        self.left -= len(body)
        self.payload.update(body)
        self.size += len(body)

    def close(self) -> tuple:
        if self.fields is None or self.left:
            raise ValueError(f"record {self.record} is cut short")
        stated = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = self.fields["WARC-Type"]
        if kind == "response" and (base32(self.payload.digest()) != stated or self.size != int(self.http["Content-Length"])):
            raise ValueError(f"record {self.record}: its payload differs from its digest")
        refers = self.fields.get("WARC-Refers-To")
        return page_of(self.fields["WARC-Record-ID"]), int(self.http["Content-Length"]), stated, kind, page_of(refers) if refers else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record; a damaged or unfinished record raises an error.

    Records of one chunk are read where they lie; the chunks of longer ones are brought together and put in order first.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: RecordReader | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            done.clear()
            return out

        for batch in batches:
            record, chunk, data, digest = (batch[c] for c in ("record", "chunk", "data", "digest"))
            for i in range(batch.num_rows):
                number = record[i].as_py()
                if reader is None or reader.record != number:
                    if reader is not None:
                        done.append(reader.close())
                    reader = RecordReader(number)
                reader.feed(chunk[i].as_py(), data[i].as_py(), digest[i].as_py())
            if len(done) > 10_000:
                yield flush()
        if reader is not None:
            done.append(reader.close())
        yield flush()

    chunks = spark.read.schema(CHUNKS).parquet(path)
    result = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    whole = chunks.where("chunks = 1").mapInArrow(parse, result)
    return whole.unionByName(chunks.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(parse, result))


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0) -> DataFrame:
    """Writes all pages as archives in the shared folder and returns what reading them back gives, a row per page.

    Null payloads are empty ones. Null ids refer to others but are referred to only where no id is known, that is never.
    Rows that repeat an id with its payload are alike: all responses if the id is the one elected, else all revisits.
    """
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_column, url_column, payload_column, least)
    return read_archives(pages.sparkSession, path)
