"""Zip archives read by entry: the directories at the archives' ends become rows, and tasks read the entries' bytes by range.

No task holds an archive: one that lists holds an archive's directory, one that reads an entry and a batch of up to BATCH bytes. Paths are
URIs that pyarrow opens (a path without a scheme is a local one)."""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.stored import stored

BATCH, PART, LARGEST, ARCHIVE = 32 << 20, 128 << 20, 1 << 30, 256 << 20
LISTED = "path string, at long, name string, method int, flags int, packed long, size long, crc long, error string"


def uri(path: str) -> str:
    return path if "://" in path else re.sub(r"^(file:)?/+", "file:///", path)


def opened(path: str) -> BinaryIO:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri(path))
    return store.open_input_file(at)


def arrow_types(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return [n for n, _ in fields], [kinds[k] for _, k in fields]


def as_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = arrow_types(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def entry_name(e: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag are read as UTF-8 if they are."""
    if not e.flag_bits & 0x800:
        try:
            return e.filename.encode("cp437").decode("utf-8")
        except UnicodeError:
            pass
    return e.filename


def listed(path: str) -> Iterator[tuple]:
    """Rows of LISTED for an archive's entries but for folders; one row with an error if its directory can't be read."""
    try:
        with opened(path) as f, zipfile.ZipFile(f) as z:
            for e in z.infolist():
                if not e.is_dir():
                    yield path, e.header_offset, entry_name(e), e.compress_type, e.flag_bits, e.compress_size, e.file_size, e.CRC, None
    except (zipfile.BadZipFile, FileNotFoundError, NotImplementedError, ValueError) as error:  # other faults of the store end the task, which is tried again
        yield path, None, None, None, None, None, None, None, str(error)


def listing(archives: DataFrame) -> DataFrame:
    """LISTED from (path), an archive a row; other columns are left out, null paths too."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                for rows in batched(listed(path), 4096):
                    yield as_batch(rows, LISTED)

    return archives.select("path").filter("path is not null").repartition(tasks(archives, 0), "path").mapInArrow(apply, LISTED)


def tasks(df: DataFrame, size: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART + 1)


def content(f: BinaryIO, at: int, method: int, flags: int, packed: int, size: int, crc: int) -> bytes:
    """An entry's bytes. The local head is passed over by the lengths of its name and its extra field; sizes are the directory's."""
    if flags & 1:
        raise ValueError("encrypted")
    f.seek(at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04" or len(head) < 30:
        raise ValueError("no entry here")
    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, size + 1)
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("size or checksum differs")
    return data


def entries(archives: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(path, name, content, error) of the entries of zip archives given as (path). A damaged entry, one of another method than stored or
    deflated, one over ``largest`` bytes (a row can't hold it) and an archive without a directory are a row with an error each; entries of
    one name are all there; no archives, no rows."""
    found = stored(listing(archives))
    total = found.agg(F.sum("packed")).first()[0] or 0
    out = "path string, name string, content binary, error string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f, rows, held = None, None, [], 0
        for b in batches:
            for path, offset, name, method, flags, packed, size, crc, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = None
                if error is None and max(size, packed) > largest:
                    error = f"{size} bytes"
                if error is None:
                    try:
                        if path != at:
                            if f:
                                f.close()
                            at, f = None, opened(path)
                            at = path
                        data = content(f, offset, method, flags, packed, size, crc)
                    except (ValueError, zlib.error) as e:
                        error = str(e)
                rows.append((path, name, data, error))
                held += len(data or b"") + 100
                if held >= BATCH:
                    yield as_batch(rows, out)
                    rows, held = [], 0
        if f:
            f.close()
        if rows:
            yield as_batch(rows, out)

    spread = found.repartition(tasks(archives, total), "path", "at").sortWithinPartitions("path", "at")
    return spread.mapInArrow(apply, out)


def write(rows: DataFrame, folder: str, name: str = "name", data: str = "content", limit: int = ARCHIVE) -> DataFrame:
    """(path, entries) of the archives that (name, content) rows are written to: each task writes its own, a new one when one has ``limit``
    bytes before packing, under another name until it is whole. Null contents are empty entries; rows without a name are left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri(folder))
        store.create_dir(base)
        part, made = TaskContext.get().partitionId(), []
        rows = ((n.as_py(), d.as_py() or b"") for b in batches for n, d in zip(b.column(0), b.column(1), strict=True))
        row = next(rows, None)
        while row:
            own, size, n = f"{base}/.{uuid.uuid4().hex}", 0, 0
            with store.open_output_stream(own) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                while row and size < limit:
                    z.writestr(zipfile.ZipInfo(row[0]), row[1], zipfile.ZIP_DEFLATED)
                    size, n = size + len(row[1]), n + 1
                    row = next(rows, None)
            last = f"part-{part:06d}-{len(made):06d}.zip"
            store.move(own, f"{base}/{last}")
            made.append((f"{uri(folder)}/{last}", n))
        if made:
            yield as_batch(made, "path string, entries long")

    named = rows.filter(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(data).cast("binary"))
    return stored(named.mapInArrow(apply, "path string, entries long"))
