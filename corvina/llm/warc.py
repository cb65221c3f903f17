"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader takes one gzip member after another with incremental decompression, so that it holds a block of the file and
a record's head at most (and the payload, if asked for); it frames records by Content-Length and computes
block and payload digests as the bytes go by. Each task of the writer makes archives of bounded size in the shared
folder, under names of its own attempt; the list of archives is materialised, so archives of lost or
repeated attempts are never read.

Payloads are html in UTF-8 (null: empty). Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
least page_id is a response and the others revisit it; rows that repeat that page_id are responses too. Null ids count
as larger than any; if all are null, all are responses. Null urls become ``urn:page:ID``; control characters, blanks and
non-ASCII characters of a url are percent-encoded. Extra columns are left alone. Empty tables make no archive.

A damaged record gives one row whose ``status`` says what is wrong; the reader goes on with the next member, or where a member
can't be read to its end, with the next place where a member begins that is a record. Heads and payloads may have any
length. Ties (equal payloads) are settled by page_id as above.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut, shared_dir

#: Bytes that are read at a time; of an archive at which the next one begins; that show whether a member is a record;
#: archives that are read at the same time.
BLOCK, ARCHIVE, PROBE, READERS = 1 << 16, 64 << 20, 1024, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", date), *fields, ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    data = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "") or f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", record_id(f"page:{page_id}")), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32(hashlib.sha1(payload).digest()))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is None:
        return record("response", fields, http + payload, date)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"page:{refers_to}")), ("Refers-To-Page-ID", str(refers_to))], http, date)


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to). Payloads that occur once don't take part in the join's small side."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1(F.col("html").cast("binary")))
    twice = rows.filter(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null")
    out = rows.join(twice.select("key", "least"), "key", "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes the rows of :func:`revisits` as archives under ``folder``, a URI that pyarrow can write. Returns the
    materialised list (path, records, bytes)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        task, out, n, size, count = TaskContext.get(), None, 0, 0, 0
        made: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            made.append((f"{folder}/{name}", count, size))

        for b in batches:
            for i, u, h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", record_id(name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date)
                    out.write(info)
                    size, count, n = len(info), 1, n + 1
                data = page_record(i, u, h.as_buffer().to_pybytes(), r, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["path", "records", "bytes"])

    return cut(rows.select("page_id", "url", "html", "refers_to").mapInArrow(apply, "path string, records long, bytes long"))


class Damage(Exception):
    pass


class Members:
    """The bytes of a file of gzip members; one member at a time."""

    def __init__(self, f: BinaryIO):
        self.f, self.raw, self.at, self.z, self.buffer = f, b"", 0, None, b""

    def open(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.f.read(BLOCK)
        self.z, self.buffer, self.start = zlib.decompressobj(31), b"", self.at
        return bool(self.raw)

    def more(self) -> bytes:
        """Some more bytes of the member; nothing at its end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.f.read(BLOCK)
                if not self.raw:
                    raise Damage("truncated")
            try:
                data = self.z.decompress(self.raw, BLOCK)
            except zlib.error:
                raise Damage("not gzip") from None
            rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += len(self.raw) - len(rest)
            self.raw = rest
            if data:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark, however long that is."""
        buffer, seen = bytearray(self.buffer), 0
        while (i := buffer.find(mark, seen)) < 0:
            seen = max(0, len(buffer) - len(mark) + 1)
            if not (x := self.more()):
                raise Damage("bad head")
            buffer += x
        self.buffer = bytes(buffer[i + len(mark) :])
        return bytes(buffer[:i])

    def skip(self) -> None:
        """Behind the member, or where that can't be read, to the next place where a record begins."""
        try:
            while self.more():
                pass
        except Damage:
            self.resume()

    def resume(self) -> None:
        """From the damaged member's start on, as what was read of it may reach into the next ones; in a file that can't go back,
        from here on."""
        data, at = self.raw[1:], self.at + 1
        if self.f.seekable():
            self.f.seek(self.start + 1)
            data, at = b"", self.start + 1
        while True:
            if (i := data.find(b"\x1f\x8b\x08")) < 0:
                last, x = data[-2:], self.f.read(BLOCK)
                data, at = last + x, at + len(data) - len(last)
                if x:
                    continue
                self.raw, self.at = b"", at + len(last)
                return
            data, at = data[i:], at + i
            while len(data) < PROBE and (x := self.f.read(BLOCK)):
                data += x
            try:
                if zlib.decompressobj(31).decompress(data[:PROBE], 5) == b"WARC/":
                    self.raw, self.at = data, at
                    return
            except zlib.error:
                pass
            data, at = data[1:], at + 1

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            x = self.buffer or self.more()
            if not x:
                raise Damage("shorter than Content-Length")
            part, self.buffer = x[:n], x[n:]
            n -= len(part)
            yield part


def records(f: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """A dict for each record: offset, the head's ``fields`` (names in lower case), block_bytes, payload_bytes,
    payload_digest (of the bytes there), payload if asked for, and ``status`` (ok, or what is wrong)."""
    m = Members(f)
    while m.open():
        row = {"offset": m.start, "fields": {}, "block_bytes": None, "payload_bytes": None, "payload_digest": None, "payload": None, "status": "ok"}
        try:
            head = m.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise Damage("no WARC version")
            for line in head[1:]:
                k, _, v = line.partition(":")
                row["fields"][k.strip().lower()] = v.strip()
            size = row["fields"].get("content-length", "")
            if not re.fullmatch(r"\d+", size):
                raise Damage("no Content-Length")
            row["block_bytes"], http = int(size), "application/http" in row["fields"].get("content-type", "")
            block, payload, n, front, kept = hashlib.sha1(), hashlib.sha1(), 0, b"" if http else None, []
            for x in m.exactly(int(size)):
                block.update(x)
                if front is not None:
                    front += x
                    if (i := front.find(b"\r\n\r\n")) < 0:
                        continue
                    x, front = front[i + 4 :], None
                payload.update(x)
                n += len(x)
                if payloads:
                    kept.append(x)
            row |= {"payload_bytes": n, "payload_digest": base32(payload.digest()), "payload": b"".join(kept) if payloads else None}
            tail = m.buffer
            while x := m.more():
                tail += x
            if tail != b"\r\n\r\n":
                raise Damage("longer than Content-Length")
            said = row["fields"].get("warc-block-digest")
            if said and said != "sha1:" + base32(block.digest()):
                row["status"] = "block digest differs"
            said = row["fields"].get("warc-payload-digest")
            if said and row["fields"].get("warc-type") != "revisit" and said != "sha1:" + row["payload_digest"]:
                row["status"] = "payload digest differs"
            yield row
        except Damage as e:
            yield row | {"status": str(e)}
            m.skip()


SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, said_digest string, payload binary, status string"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of :data:`SCHEMA` from a frame with a column ``path`` (URIs that pyarrow opens), or with ``path`` and
    ``content`` (as Spark's binaryFile source gives them, for stores that only Spark opens)."""
    inline = "content" in archives.columns

    def rows(path: str, f: BinaryIO) -> Iterator[tuple]:
        for r in records(f, payloads):
            x = r["fields"]
            number = lambda k: int(x[k]) if re.fullmatch(r"-?\d+", x.get(k, "")) else None
            yield path, r["offset"], x.get("warc-type"), x.get("warc-record-id"), x.get("warc-target-uri"), number("page-id"), number("refers-to-page-id"), r["payload_bytes"], r["payload_digest"], x.get("warc-payload-digest", "").removeprefix("sha1:") or None, r["payload"], r["status"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = [pa.string(), pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 3, *[pa.string()] * 2, pa.binary(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)

        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                if inline:
                    f = pa.BufferReader(b.column(1)[i].as_buffer())
                else:
                    store, at = fs.FileSystem.from_uri(path)
                    f = store.open_input_file(at)
                with f:
                    for r in rows(path, f):
                        made.append(r)
                        if len(made) >= (64 if payloads else 4096):
                            yield flush()
                            made.clear()
        if made:
            yield flush()

    return archives.select("path", *["content"] * inline).mapInArrow(apply, SCHEMA)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Pages written to archives and read again: a row of :func:`read` for each page, with a revisit's ``payload_bytes``
    and ``payload_digest`` those of the record it refers to."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = re.sub(r"^(file:)?/+", "file:///", folder)
    archives = write(revisits(pages, page_id, url, html, min_bytes), folder)
    # a task for each archive, as the list itself is too short for a size to go by
    tasks = max(1, min(READERS, archives.count()))
    found = cut(read(archives.repartition(tasks)).filter("record_type in ('response', 'revisit') or status <> 'ok'").drop("payload"))
    sizes = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("said_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    again = found.filter("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("_page")) & (F.col("said_digest") == F.col("_digest")), "left")
    again = again.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")}).drop("_page", "_digest", "_bytes")
    return found.filter("record_type is null or record_type <> 'revisit'").unionByName(again)
