"""Zip archives as tables: the directory of each archive first, then its entries by ranges of bytes.

1. The central directory of an archive is read from its end, in pieces; every entry is a row (archive, path, offset and so
   on), and an archive that is none is a row with a reason.  No entry is touched.
2. Entries are dealt out by (archive, range of ``RANGE_BYTES``), so one large archive is unpacked by many tasks.  A task
   opens an archive once and reads its entries in order of offset, each unpacked in portions of ``PORTION_BYTES`` and
   checked against its length and checksum.

What cannot be unpacked becomes a row with a reason and no content.  An entry of more than ``MAX_ENTRY_BYTES`` is such a
row, since a text must fit in a row.

Archives are opened through Arrow's file systems (local, HDFS, S3, GCS); ``ranged`` tells whether a path has one.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import cut_lineage

RANGE_BYTES = 32 << 20
PORTION_BYTES = 1 << 20
MAX_ENTRY_BYTES = 256 << 20
ARCHIVE_BYTES = 64 << 20
BATCH_ROWS = 4096

ENTRY = ("archive string, path string, at long, packed long, size long, crc long, method int, flags int, reason string")
CONTENT = "archive string, path string, content string, reason string"

# Fixed values of the zip format: signatures and records, little-endian.
_END = struct.Struct("<4s4H2LH")
_END64_PLACE = struct.Struct("<4sLQL")
_END64 = struct.Struct("<4sQ2H2L4Q")
_MEMBER = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_END_MARK, _END64_PLACE_MARK, _END64_MARK, _MEMBER_MARK, _LOCAL_MARK = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8
ENCRYPTED, UTF8 = 0x1, 0x800


def _uri(path: str) -> str:
    """Spark's spelling of a path, in which nothing is percent-encoded, as a URI that Arrow knows."""
    scheme, rest = re.match(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path).groups()
    if scheme in (None, "file"):
        return "file:///" + quote(os.path.abspath("/" + rest.lstrip("/") if scheme or rest.startswith("/") else rest).lstrip("/"))
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest)}"


def opened(path: str) -> BinaryIO:
    store, at = fs.FileSystem.from_uri(_uri(path))
    return store.open_input_file(at)


def children(folder: str) -> list[fs.FileInfo]:
    store, at = fs.FileSystem.from_uri(_uri(folder))
    return store.get_file_info(fs.FileSelector(at))


def is_folder(path: str) -> bool:
    store, at = fs.FileSystem.from_uri(_uri(path))
    return store.get_file_info(at).type == fs.FileType.Directory


def ranged(path: str) -> bool:
    """Whether tasks can read parts of files at this path."""
    try:
        fs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class BadArchive(ValueError):
    pass


def _directory(f: BinaryIO) -> tuple[int, int, int]:
    """Place, length and number of entries of the central directory."""
    end = f.seek(0, 2)
    tail_at = max(0, end - _END.size - 0xFFFF)
    f.seek(tail_at)
    tail = f.read(end - tail_at)
    at = tail.rfind(_END_MARK)
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(_END_MARK, 0, at)
    if at < 0:
        raise BadArchive("not a zip archive")
    _, _, _, _, number, length, place, _ = _END.unpack_from(tail, at)
    behind = tail_at + at
    if number == 0xFFFF or length == 0xFFFFFFFF or place == 0xFFFFFFFF:
        f.seek(max(0, behind - _END64_PLACE.size))
        raw = f.read(_END64_PLACE.size)
        if raw[:4] == _END64_PLACE_MARK:
            f.seek(_END64_PLACE.unpack(raw)[2])
            raw = f.read(_END64.size)
            if len(raw) != _END64.size or raw[:4] != _END64_MARK:
                raise BadArchive("directory is damaged")
            *_, number, length, place = _END64.unpack(raw)
            behind = _END64_PLACE.unpack(_read_at(f, behind - _END64_PLACE.size, _END64_PLACE.size))[2]
    if place + length > behind:
        raise BadArchive("directory is damaged")
    return place, length, number


def _read_at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """64-bit values of an entry, where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            body, k = extra[at + 4: at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF and k + 8 <= len(body):
                    values[i] = struct.unpack_from("<Q", body, k)[0]
                    k += 8
            break
        at += 4 + n
    return values


def members(f: BinaryIO) -> Iterator[tuple]:
    """(path, at, packed, size, crc, method, flags) of every entry that is no folder; the directory is read in pieces."""
    place, length, _ = _directory(f)
    # Something may stand before the archive proper; offsets count from the first entry then.
    held, at = b"", place
    stop = place + length
    while at < stop or held:
        while len(held) < _MEMBER.size + 3 * 0xFFFF and at < stop:
            piece = _read_at(f, at, min(PORTION_BYTES, stop - at))
            if not piece:
                break
            held, at = held + piece, at + len(piece)
        if len(held) < _MEMBER.size or held[:4] != _MEMBER_MARK:
            raise BadArchive("directory is damaged")
        done = 0
        while len(held) - done >= _MEMBER.size + 3 * 0xFFFF or (at >= stop and len(held) > done):
            if len(held) - done < _MEMBER.size or held[done: done + 4] != _MEMBER_MARK:
                raise BadArchive("directory is damaged")
            _, _, _, flags, method, _, _, crc, packed, size, n, m, k, _, _, _, first = _MEMBER.unpack_from(held, done)
            name = held[done + _MEMBER.size: done + _MEMBER.size + n]
            extra = held[done + _MEMBER.size + n: done + _MEMBER.size + n + m]
            size, packed, first = _wide(extra, [size, packed, first])
            done += _MEMBER.size + n + m + k
            path = name.decode("utf-8", "replace") if flags & UTF8 else name.decode("cp437")
            if not path.endswith("/"):
                yield path, first, packed, size, crc, method, flags
        held = held[done:]


def list_entries(spark: SparkSession, glob: str) -> DataFrame:
    """A row for every entry of every archive that ``glob`` names; ``reason`` says why an archive gives none."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    with opened(path) as f:
                        for e in members(f):
                            rows.append((path, *e, None))
                            if len(rows) == BATCH_ROWS:
                                yield _batch(rows, columns)
                                rows = []
                except (BadArchive, OSError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e) if isinstance(e, BadArchive) else "not read"))
                if rows:
                    yield _batch(rows, columns)

    archives = spark.read.format("binaryFile").load(glob).select("path")  # the content is never read
    return archives.repartition(max(spark.sparkContext.defaultParallelism, archives.rdd.getNumPartitions()), "path").mapInArrow(run, ENTRY)


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"at": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "crc": pa.int64(), "method": pa.int32(), "flags": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(columns, zip(*rows))], columns)


def unpacked(f: BinaryIO, at: int, packed: int, size: int, crc: int, method: int, flags: int, most: int = MAX_ENTRY_BYTES) -> bytes:
    """An entry's bytes; raises ``BadArchive`` with the reason where there are none."""
    if flags & ENCRYPTED:
        raise BadArchive("encrypted")
    if method not in (STORED, DEFLATED):
        raise BadArchive(f"method {method}")
    if size > most:
        raise BadArchive("too large")
    head = _read_at(f, at, _LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != _LOCAL_MARK:
        raise BadArchive("no entry at its place")
    *_, n, m = _LOCAL.unpack(head)
    f.seek(at + _LOCAL.size + n + m)
    inflate, out, total, left = zlib.decompressobj(-15), [], 0, packed
    while left:
        piece = f.read(min(PORTION_BYTES, left))
        if not piece:
            raise BadArchive("cut off")
        left -= len(piece)
        while piece:
            if method == DEFLATED:
                try:
                    part = inflate.decompress(piece, PORTION_BYTES)
                except zlib.error as e:
                    raise BadArchive("damaged") from e
                piece = inflate.unconsumed_tail
            else:
                part, piece = piece, b""
            total += len(part)
            # A wrong length in the directory must not fill the memory.
            if total > size:
                raise BadArchive("damaged")
            out.append(part)
    if method == DEFLATED:
        out.append(inflate.flush())
    data = b"".join(out)
    if len(data) != size or zlib.crc32(data) != crc:
        raise BadArchive("damaged")
    return data


def read_entries(entries: DataFrame, most: int = MAX_ENTRY_BYTES) -> DataFrame:
    """(archive, path, content, reason) of rows of :func:`list_entries`, unpacked by ranges of the archives' bytes."""
    spark = entries.sparkSession
    columns = [c.split()[0] for c in CONTENT.split(", ")]
    listed = cut_lineage(entries)
    ranges = listed.filter("reason is null").select("archive", F.floor(F.col("at") / RANGE_BYTES).alias("range")).distinct().count()
    spread = listed.repartition(max(1, min(ranges, 100_000), spark.sparkContext.defaultParallelism), "archive", F.floor(F.col("at") / RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        rows: list[tuple] = []
        held = 0
        try:
            for b in batches:
                for archive, path, at, packed, size, crc, method, flags, reason in zip(*(c.to_pylist() for c in b.columns)):
                    text = None
                    if reason is None:
                        try:
                            if archive != name:
                                if f is not None:
                                    f.close()
                                name, f = None, None
                                name, f = archive, opened(archive)
                            text = unpacked(f, at, packed, size, crc, method, flags, most).decode("utf-8", "replace")
                        except BadArchive as e:
                            reason = str(e)
                        except OSError:
                            reason = "not read"
                    rows.append((archive, path, text, reason))
                    held += len(text or "")
                    if held >= 8 * PORTION_BYTES or len(rows) == BATCH_ROWS:
                        yield _batch(rows, columns)
                        rows, held = [], 0
        finally:
            if f is not None:
                f.close()
        if rows:
            yield _batch(rows, columns)

    order = [c.split()[0] for c in ENTRY.split(", ")]
    return spread.sortWithinPartitions("archive", "at").select(order).mapInArrow(run, CONTENT)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Writes a file under a temporary name and renames it, so that a repeated task leaves it whole."""
    store, base = fs.FileSystem.from_uri(_uri(folder))
    at = f"{base}/{name}"
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, at)


def write_tree(files: DataFrame, folder: str) -> int:
    """Writes files(path, content) below ``folder``, each by the task that holds it; their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                put_file(folder, path, (text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(files: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> int:
    """Writes files(project_id, path, content) as archives ``<project>-<part>.zip`` of about ``most`` bytes at most, so
    that a project of any size is written by many tasks; the number of archives."""
    sizes = files.groupBy("project_id").agg(F.ceil(F.sum(F.octet_length("content")) / most).alias("parts"))
    part = F.pmod(F.xxhash64("path"), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)))
    dealt = files.select("project_id", "path", "content").join(sizes, "project_id").withColumn("part", part).drop("parts")

    def pack(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in sorted(zip(group.column("path").to_pylist(), group.column("content").to_pylist())):
                z.writestr(zipfile.ZipInfo(path), (text or "").encode(), zipfile.ZIP_DEFLATED)
        put_file(folder, f"{group.column('project_id')[0]}-{group.column('part')[0]}.zip", out.getvalue())
        return pa.table({"n": [group.num_rows]})

    return dealt.groupBy("project_id", "part").applyInArrow(pack, "n long").count()
