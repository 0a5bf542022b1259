"""Repositories kept as archives: an index of members first, then ranges of members.

Spark's file listing leaves out names that start with a dot or an underscore, so a tree is
kept as `root/<repo>.zip`, `.tar`, `.tar.gz` or `.tgz`, or in parts `root/<repo>/<part>.zip`.

Reading takes two steps. One task per archive reads the central directory of a zip, or the
headers of a tar, and leaves a short row per member: an index that filters like any
table, before a byte of content is read. Then members are dealt over tasks by archive and
place in it, `RANGE_BYTES` of one archive together, so a single large archive is read by
all cores and a task holds one batch. A compressed tar has no places to go to: one task
streams it, member by member.

A member that is encrypted, broken or packed in an unknown way becomes a row without
content, and the others are read. So does an archive that cannot be opened or ends too early,
under an empty name. Files of no bytes at all are not listed by Spark.
"""

from __future__ import annotations

import io
import lzma
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden.session import write_once

RAW = "repo string, rel string, length long, content binary"
INDEX = ("repo string, path string, rel string, kind string, method int, flags int, place long, "
         "packed long, length long, crc long")
SUFFIX = r"[.](zip|tar|tar[.]gz|tgz)$"
# Schemes that tasks open by themselves, at any place; others come whole through Spark.
DIRECT = ("file", "hdfs", "s3", "gs")

RANGE_BYTES = 32 << 20
BUFFER_BYTES = 64 << 10
MEMBERS_AT_ONCE = 200
BYTES_AT_ONCE = 32 << 20
CELL_BYTES = 1 << 30  # a longer member has no content
MOST_RANGES = 100_000  # tasks at most; beyond that a task takes several ranges

# What reading a bad archive or member raises.
BAD = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError,
       RuntimeError, NotImplementedError, ValueError, KeyError, UnicodeError)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(path.replace("?", "%3F").replace("#", "%23"))
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(path.split(parts.netloc, 1)[1])}")


class _Raw(io.RawIOBase):
    """A pyarrow file as Python's; a place before its start is an OSError, as elsewhere."""

    def __init__(self, held):
        self.held = held

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.held.readinto(buffer)

    def tell(self) -> int:
        return self.held.tell()

    def seek(self, place: int, whence: int = io.SEEK_SET) -> int:
        place += {io.SEEK_SET: 0, io.SEEK_CUR: self.held.tell(), io.SEEK_END: self.held.size()}[whence]
        if place < 0:
            raise OSError(f"no place {place}")
        return self.held.seek(place)

    def close(self) -> None:
        self.held.close()
        super().close()


def open_at(path: str) -> BinaryIO:
    """A file of any system that pyarrow knows, readable at any place."""
    system, name = _file_system(path)
    return io.BufferedReader(_Raw(system.open_input_file(name)), BUFFER_BYTES)


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, length, changed, content) of every archive below `root`."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    name = F.substring("path", len(base.rstrip("/")) + 2, 1 << 30)
    repo = F.substring_index(F.regexp_replace(name, SUFFIX, ""), "/", 1)
    return held.where(F.col("path").rlike(SUFFIX)).select(
        repo.alias("repo"), "path", "length", F.col("modificationTime").alias("changed"), "content")


def _whole(data: bytes, length: int) -> bytes:
    if len(data) != length:
        raise EOFError(f"{len(data)} bytes of {length}")
    return data


# ---- the index ------------------------------------------------------------------------

def _entries(held: BinaryIO) -> Iterator[tuple]:
    """(rel, kind, method, flags, place, packed, length, crc) of every regular file."""
    if zipfile.is_zipfile(held):
        with zipfile.ZipFile(held) as directory:
            for info in directory.infolist():
                if not info.is_dir():
                    yield (info.filename, "zip", info.compress_type, info.flag_bits, info.header_offset,
                           info.compress_size, info.file_size, info.CRC)
        return
    held.seek(0)
    try:
        headers = tarfile.open(fileobj=held, mode="r:")
    except tarfile.ReadError:
        # Not a plain tar: a compressed one opens as a stream, anything else fails here.
        held.seek(0)
        tarfile.open(fileobj=held, mode="r|*").close()
        held.seek(0, io.SEEK_END)
        yield "", "stream", 0, 0, 0, held.tell(), 0, 0
        return
    for info in headers:
        headers.members = []  # else every header is kept
        if info.isfile():
            kind = "sparse" if info.issparse() else "tar"
            place = info.offset if info.issparse() else info.offset_data
            yield info.name, kind, 0, 0, place, info.size, info.size, 0
    held.seek(headers.offset)
    _whole(held.read(tarfile.BLOCKSIZE), tarfile.BLOCKSIZE)  # the mark of the end


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in INDEX.split(", ")]
    for batch in batches:
        for repo, path, length in zip(batch["repo"], batch["path"], batch["length"]):
            rows = []
            try:
                with open_at(path) as held:
                    for rel, *rest in _entries(held):
                        rows.append((repo, path, rel.removeprefix("./"), *rest))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except BAD:
                rows.append((repo, path, "", "broken", 0, 0, 0, 0, length, 0))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def member_index(archives: DataFrame) -> DataFrame:
    """A row of `INDEX` per member of (repo, path, length); no content is read."""
    return archives.select("repo", "path", "length").mapInPandas(_indexed, INDEX)


def listing(index: DataFrame, archives: DataFrame) -> DataFrame:
    """(repo, rel, digest) of the members, from the index alone.

    In a zip the digest is the sum and the length kept with the member. A tar keeps no sums:
    there it is the place, the length and the time of the archive, so a new archive counts
    as changed throughout. Compressed tars and broken archives have no members to list.
    """
    times = archives.select("path", "changed")
    zipped = F.concat_ws("-", F.hex("crc"), "length")
    placed = F.concat_ws("-", F.unix_micros("changed"), "place", "length")
    return index.where("kind not in ('stream', 'broken')").join(times, "path").select(
        "repo", "rel", F.when(F.col("kind") == "zip", zipped).otherwise(placed).alias("digest"))


# ---- reading --------------------------------------------------------------------------

def _content(held: BinaryIO, row) -> bytes:
    """The bytes of a member of the index."""
    if row.kind == "tar":
        held.seek(row.place)
        return _whole(held.read(row.length), row.length)
    if row.kind == "sparse":
        held.seek(row.place)
        with tarfile.open(fileobj=held, mode="r:") as headers:
            return _whole(headers.extractfile(headers.next()).read(), row.length)
    if row.flags & 1:
        raise RuntimeError("encrypted")
    held.seek(row.place)
    header = held.read(30)
    if header[:4] != b"PK\x03\x04" or len(header) < 30:
        raise zipfile.BadZipFile("no member here")
    # Name and extra field stand between the header and the content.
    held.seek(row.place + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
    info = zipfile.ZipInfo(row.rel or "x")
    info.compress_type, info.flag_bits, info.CRC = int(row.method), int(row.flags), int(row.crc)
    info.compress_size, info.file_size = int(row.packed), int(row.length)
    with zipfile.ZipExtFile(held, "r", info) as member:
        return _whole(member.read(row.length + 1), row.length)


def _streamed(repo: str, held: BinaryIO, most: int) -> Iterator[tuple]:
    """Raw rows of a compressed tar, one member after the other."""
    total = 0
    try:
        with tarfile.open(fileobj=held, mode="r|*") as members:
            for info in members:
                members.members = []
                if info.isfile():
                    total += info.size
                    data = None
                    if info.size <= most:
                        data = _whole(members.extractfile(info).read(), info.size)
                    yield repo, info.name.removeprefix("./"), info.size, data
            if members.fileobj.tell() < members.offset + tarfile.BLOCKSIZE:
                raise EOFError("no mark of the end")
    except BAD:
        yield repo, "", total, None


def _batched(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or b"")
        if len(held) >= MEMBERS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield pd.DataFrame(held, columns=["repo", "rel", "length", "content"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["repo", "rel", "length", "content"])


def _read(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        path, held = None, None
        for batch in batches:
            for row in batch.itertuples():
                data = None
                try:
                    if row.kind != "broken" and path != row.path:
                        if path is not None:
                            held.close()
                        path, held = None, open_at(row.path)
                        path = row.path
                    if row.kind == "stream":
                        held.seek(0)
                        yield from _streamed(row.repo, held, most)
                        continue
                    if row.kind != "broken" and row.length <= most:
                        data = _content(held, row)
                except BAD:
                    pass
                yield row.repo, row.rel, row.length, data

    return _batched(rows())


def read_members(index: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Raw files of an index; members over `max_bytes` come without their content."""
    spark = index.sparkSession
    index = write_once(index)
    total = index.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    tasks = min(max(total // RANGE_BYTES, spark.sparkContext.defaultParallelism), MOST_RANGES)
    most = min(CELL_BYTES, CELL_BYTES if max_bytes is None else max_bytes)
    slot = F.floor(F.col("place") / RANGE_BYTES)
    return index.repartition(int(tasks), "path", slot).sortWithinPartitions("path", "place").mapInPandas(
        lambda batches: _read(batches, most), RAW)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw files of archives whose bytes are in the row."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for repo, content in zip(batch["repo"], batch["content"]):
                held = io.BytesIO(content)
                try:
                    for rel, kind, *rest in _entries(held):
                        if kind == "stream":
                            held.seek(0)
                            yield from _streamed(repo, held, CELL_BYTES)
                            continue
                        member = _Member(rel.removeprefix("./"), kind, *rest)
                        try:
                            data = _content(held, member)
                        except BAD:
                            data = None
                        yield repo, member.rel, member.length, data
                except BAD:
                    yield repo, "", len(content), None

    return _batched(rows())


class _Member:
    def __init__(self, rel, kind, method, flags, place, packed, length, crc):
        self.rel, self.kind, self.method, self.flags = rel, kind, method, flags
        self.place, self.packed, self.length, self.crc = place, packed, length, crc


def read_archives(spark: SparkSession, root: str, where: str = "true",
                  max_bytes: int | None = None) -> DataFrame:
    """Raw files (repo, rel, length, content) of the archives below `root`.

    `where` is a condition on (repo, rel, length); it holds back members before they are read.
    """
    archives = list_archives(spark, root)
    if urlsplit(spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(
            spark._jsc.hadoopConfiguration()).getUri().toString()).scheme in DIRECT:
        index = member_index(archives).where(f"kind in ('stream', 'broken') or ({where})")
        return read_members(index, max_bytes).where(f"content is null or ({where})")
    return archives.select("repo", "content").mapInPandas(_unpacked, RAW).where(f"content is null or ({where})")


# ---- writing --------------------------------------------------------------------------

def write_archives(files: DataFrame, root: str, part_bytes: int = 64 << 20) -> None:
    """(repo, rel, content) as zip archives `root/<repo>/<part>.zip` of about `part_bytes`.

    A task writes its share of every repository, so a large one lies in many parts. A part
    gets its name when it is whole; a task that runs again replaces its own parts.
    """
    run = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().attemptNumber()
        rows = (row for batch in batches for row in zip(batch["repo"], batch["rel"], batch["content"]))
        parts = 0
        for repo, members in groupby(rows, key=itemgetter(0)):
            system.create_dir(f"{base}/{repo}", recursive=True)
            members = iter(members)
            while first := next(members, None):
                name = f"{base}/{repo}/{run}-{task}-{parts}"
                with system.open_output_stream(f"{name}.try{attempt}") as out, zipfile.ZipFile(out, "w") as held:
                    for _, rel, content in chain([first], members):
                        held.writestr(zipfile.ZipInfo(rel), content, zipfile.ZIP_DEFLATED)
                        if out.tell() >= part_bytes:
                            break
                system.move(f"{name}.try{attempt}", f"{name}.zip")
                parts += 1
        yield pd.DataFrame({"parts": [parts]})

    files.select("repo", "rel", "content").sortWithinPartitions("repo", "rel").mapInPandas(
        write, "parts long").agg(F.sum("parts")).first()
