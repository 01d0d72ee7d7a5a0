"""WARC archives: written by the executors, read back as a table of chunks.

A payload of any length becomes rows (record_id, chunk_no, ...) of at most
``chunk_bytes``; each row carries the digest of the payload up to its end, so
that no step holds a whole record that it reads. Archives are gzip members, one
a record, and the manifest cuts them into segments that tasks read on their own.

Defined cases: a null html is an empty payload; a null url is ``about:blank``;
a null page_id gives the record id ``urn:x-page:null``. Rows that share the
smallest page_id of equal payloads are all responses. An empty table gives an
empty manifest. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.work import new_path, written

MIN_REVISIT = 100
CHUNK = 1 << 20
SEGMENT = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, first_byte long, n_bytes long, n_records long"
CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, target_uri string, chunk_no int, "
    "chunk_bytes long, total_bytes long, digest_so_far string, is_last boolean, digest_ok boolean, data binary"
)


def classified(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload digest and length, and the page that a repeated payload refers to (else null)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    repeated = written(
        rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "warc-repeats"
    )  # Spark broadcasts it if its files are small, else both sides are dealt out by digest and hot digests split
    return rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", "n", F.when(F.col("page_id") != F.col("first_page"), F.col("first_page")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes an archive a task into ``folder`` (a URI; by default a new one in the shared folder); returns the manifest."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def line(value: str) -> str:
        return value.replace("\r", "%0D").replace("\n", "%0A")

    def write(batches):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        store, path = fs.FileSystem.from_uri(name)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        segments, at, begun, records = [], 0, 0, 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                ids, urls, htmls, digests, lengths, refers = (batch.column(i) for i in range(6))
                for i in range(batch.num_rows):
                    page, ref, n = ids[i].as_py(), refers[i].as_py(), lengths[i].as_py()
                    page = "null" if page is None else page
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                    head = [
                        "WARC/1.1", f"WARC-Type: {'response' if ref is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {date}",
                        f"WARC-Target-URI: {line(urls[i].as_py() or 'about:blank')}", f"WARC-Payload-Digest: sha256:{digests[i].as_py()}", "Content-Type: application/http; msgtype=response",
                    ]
                    if ref is not None:
                        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{ref}>"]
                    head.append(f"Content-Length: {len(http) + (n if ref is None else 0)}")
                    pack = zlib.compressobj(1, wbits=31)
                    at += out.write(pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))
                    if ref is None and n:
                        body = memoryview(htmls[i].as_buffer())
                        for k in range(0, n, CHUNK):
                            at += out.write(pack.compress(body[k : k + CHUNK]))
                    at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
                    if at - begun >= SEGMENT:
                        segments.append((name, begun, at - begun, records))
                        begun, records = at, 0
        if records:
            segments.append((name, begun, at - begun, records))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*segments), (pa.string(), pa.int64(), pa.int64(), pa.int64()))] if segments else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())], ["archive", "first_byte", "n_bytes", "n_records"])

    return written(classified(pages, min_bytes).mapInArrow(write, MANIFEST), "warc-manifest")  # of tasks that succeeded only


class _Stream:
    """The decompressed bytes of a segment, a piece at a time."""

    def __init__(self, file, left: int) -> None:
        self.file, self.left, self.unzip, self.buffer = file, left, zlib.decompressobj(31), b""

    def fill(self) -> bool:
        while True:
            if self.unzip.eof:
                rest = self.unzip.unused_data
                if not rest and not self.left:
                    return False
                self.unzip = zlib.decompressobj(31)
            else:
                rest = self.unzip.unconsumed_tail
            if not rest:
                if not self.left:
                    return False
                rest = self.file.read(min(1 << 16, self.left))
                self.left -= len(rest)
            if more := self.unzip.decompress(rest, 1 << 18):
                self.buffer += more
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        while (k := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most:
                raise ValueError("a record's header doesn't end")
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a record")
                return None
        head, self.buffer = self.buffer[:k], self.buffer[k + len(mark) :]
        return head

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self.fill():
            pass
        got, self.buffer = self.buffer[:most], self.buffer[most:]
        if not got and most:
            raise ValueError("an archive ends within a record")
        return got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK, data: bool = True, task_bytes: int = SEGMENT) -> DataFrame:
    """The archives' records as chunk rows, columns CHUNKS; without ``data`` that column is null.

    Segments are dealt to a task for each ``task_bytes`` of the archives, by their place.
    chunk_no counts from 0; an empty payload and a revisit have one chunk. total_bytes is the
    payload's whole length, for a revisit that of the response it refers to. digest_so_far is the
    SHA-256 of the payload up to the chunk's end; for a revisit, which has no payload of its own,
    the recorded digest. digest_ok compares the last chunk's with the recorded one.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CHUNKS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def read(batches):
        rows, held = [], 0
        for b in batches:
            for seg in b.to_pylist():
                store, path = fs.FileSystem.from_uri(seg["archive"])
                with store.open_input_file(path) as file:
                    file.seek(seg["first_byte"])
                    stream = _Stream(file, seg["n_bytes"])
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        f = _fields(head.lstrip(b"\r\n"))
                        http = stream.until(b"\r\n\r\n")
                        total = int(_fields(http)["content-length"])
                        left = int(f["content-length"]) - len(http) - 4
                        recorded = f["warc-payload-digest"].partition(":")[2]
                        common = (f["warc-record-id"].strip("<>"), _page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), f["warc-target-uri"])
                        digest, no = hashlib.sha256(), 0
                        while True:
                            piece = stream.take(min(left, chunk_bytes)) if left else b""
                            left -= len(piece)
                            digest.update(piece)
                            so_far = recorded if f["warc-type"] == "revisit" else digest.copy().hexdigest()
                            rows.append((*common, no, len(piece), total, so_far, not left, so_far == recorded if not left else None, piece if data else None))
                            held += len(piece) * data + 500
                            no += 1
                            if held > 4 << 20:
                                yield batch(rows)
                                rows, held = [], 0
                            if not left:
                                break
                        stream.until(b"\r\n\r\n")
        if rows:
            yield batch(rows)

    total = manifest.agg(F.sum("n_bytes"), F.count("*")).first()
    tasks = max(1, min(total[1], max(-(-(total[0] or 0) // task_bytes), manifest.sparkSession.sparkContext.defaultParallelism)))
    return manifest.repartitionByRange(tasks, "archive", "first_byte").mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk, whose digest covers the whole payload."""
    return chunks.filter("is_last").select(
        "page_id", F.col("total_bytes").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", F.col("digest_ok").alias("verified")
    )
