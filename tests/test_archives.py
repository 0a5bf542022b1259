"""Archives read by index and range; what cannot be read costs its own row only."""

import io
import random
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuswarden.sources import archives, tree

GOOD = {f"src/{k}.ts": f"const n = {k}\n".encode() * (k * 40) for k in range(30)} | {".env": b"A=1", "ü/é.md": b"x"}


def zipped(path, files, method=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as held:
        for name, data in files.items():
            held.writestr(name, data)
    return path


def patched(path, name, change):
    """The archive with the header and the directory entry of a member changed."""
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as held:
        info = held.getinfo(name)
    entry = raw.rfind(b"PK\x01\x02", 0, raw.rfind(name.encode()))
    change(raw, info.header_offset, entry, info)
    path.write_bytes(bytes(raw))


def content_place(raw, header):
    name, extra = struct.unpack("<HH", raw[header + 26:header + 30])
    return header + 30 + name + extra


def break_stream(raw, header, entry, info):
    raw[content_place(raw, header)] = 0xFF  # no deflate block begins so


def encrypt(raw, header, entry, info):
    raw[header + 6] |= 1
    raw[entry + 8] |= 1


def unknown_method(raw, header, entry, info):
    raw[header + 8:header + 10] = raw[entry + 10:entry + 12] = struct.pack("<H", 97)


def wrong_sum(raw, header, entry, info):
    raw[entry + 16:entry + 20] = struct.pack("<I", info.CRC ^ 1)


def wrong_size(raw, header, entry, info):
    raw[entry + 24:entry + 28] = struct.pack("<I", info.file_size + 5)


def no_header(raw, header, entry, info):
    raw[header:header + 4] = b"JUNK"


def contents(raw):
    return {(r.repo, r.rel): None if r.content is None else bytes(r.content) for r in raw.collect()}


@pytest.mark.parametrize("change", [break_stream, encrypt, unknown_method, wrong_sum, wrong_size, no_header])
def test_a_bad_member_costs_its_own_row(spark, tmp_path, change):
    patched(zipped(tmp_path / "a.zip", GOOD), "src/7.ts", change)
    zipped(tmp_path / "b.zip", GOOD)
    raw = archives.read_archives(spark, str(tmp_path))
    got = contents(raw)
    assert got == {(repo, rel): None if (repo, rel) == ("a", "src/7.ts") else data
                   for repo in "ab" for rel, data in GOOD.items()}
    assert [tuple(r) for r in tree.skipped_files(raw).collect()] == [("a", "src/7.ts", "not readable")]
    held = [(p.name.removesuffix(".zip"), bytearray(p.read_bytes())) for p in tmp_path.glob("*.zip")]
    whole = spark.createDataFrame(held, "repo string, content binary").mapInPandas(archives._unpacked, archives.RAW)
    assert contents(whole) == got


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_every_packing(spark, tmp_path, method):
    zipped(tmp_path / "a.zip", GOOD, method)
    assert contents(archives.read_archives(spark, str(tmp_path))) == {("a", k): v for k, v in GOOD.items()}


def test_tars(spark, tmp_path):
    def tarred(path, mode, format=tarfile.PAX_FORMAT):
        with tarfile.open(path, mode, format=format) as held:
            for name, data in (GOOD | {"deep/" * 60 + "x.ts": b"long name"}).items():
                info = tarfile.TarInfo("./" + name)
                info.size = len(data)
                held.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, ".env"
            held.addfile(link)

    tarred(tmp_path / "plain.tar", "w")
    tarred(tmp_path / "gnu.tar", "w", tarfile.GNU_FORMAT)
    tarred(tmp_path / "packed.tar.gz", "w:gz")
    tarred(tmp_path / "packed2.tgz", "w:bz2")
    expected = GOOD | {"deep/" * 60 + "x.ts": b"long name"}
    got = contents(archives.read_archives(spark, str(tmp_path)))
    assert got == {(repo, rel): data for repo in ("plain", "gnu", "packed", "packed2") for rel, data in expected.items()}


def test_archives_that_end_too_early(spark, tmp_path):
    def cut(name, mode):
        with tarfile.open(tmp_path / name, mode) as held:
            for k in range(40):
                data = random.Random(k).randbytes(3000)
                info = tarfile.TarInfo(f"f{k:02d}")
                info.size = len(data)
                held.addfile(info, io.BytesIO(data))
        raw = (tmp_path / name).read_bytes()
        (tmp_path / name).write_bytes(raw[:len(raw) // 2])

    cut("a.tar", "w")
    cut("b.tgz", "w:gz")
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04 no directory")
    (tmp_path / "d.tar").write_bytes(b"x")
    zipped(tmp_path / "e.zip", GOOD)
    raw = archives.read_archives(spark, str(tmp_path))
    got = contents(raw)
    for repo in "ab":
        rels = {rel for r, rel in got if r == repo}
        assert "" in rels and 15 <= len(rels) <= 24
        assert all(data == random.Random(int(rel[1:])).randbytes(3000) for (r, rel), data in got.items()
                   if r == repo and data is not None)
    assert got["c", ""] is None and got["d", ""] is None
    assert {rel for repo, rel in got if repo == "e"} == set(GOOD)
    assert {tuple(r)[::2] for r in tree.skipped_files(raw).where("rel = ''").collect()} == {
        (repo, "not readable") for repo in "abcd"}


def test_conditions_hold_before_content_is_read(spark, tmp_path):
    patched(zipped(tmp_path / "a.zip", GOOD | {"node_modules/x.js": b"y" * 99}), "node_modules/x.js", break_stream)
    kept = archives.read_archives(spark, str(tmp_path), where="not startswith(rel, 'node_modules/')", max_bytes=500)
    got = contents(kept)
    assert set(got) == {("a", rel) for rel in GOOD}  # the broken member was not looked at
    assert {rel for (_, rel), data in got.items() if data is None} == {
        rel for rel, data in GOOD.items() if len(data) > 500}
    assert {r.reason for r in tree.skipped_files(kept, 500).collect()} == {
        f"{len(data)} bytes exceed the limit" for data in GOOD.values() if len(data) > 500}


def test_one_archive_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "RANGE_BYTES", 1 << 16)
    files = {f"f{k:03d}": random.Random(k).randbytes(8 << 10) for k in range(200)}
    zipped(tmp_path / "a.zip", files, zipfile.ZIP_STORED)
    raw = archives.read_archives(spark, str(tmp_path))
    shares = [r.n for r in raw.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(shares) >= 8 and max(shares) <= 50
    assert contents(raw) == {("a", k): v for k, v in files.items()}


def test_round_trip_through_parts(spark, tmp_path):
    files = [(f"r{k % 3}", f"src/{k}.ts", bytearray(random.Random(k).randbytes(500))) for k in range(300)]
    table = spark.createDataFrame(files, "repo string, rel string, content binary").repartition(5)
    archives.write_archives(table, str(tmp_path / "out dir"), part_bytes=8_000)
    assert len(list((tmp_path / "out dir" / "r0").glob("*.zip"))) > 5
    assert not list((tmp_path / "out dir").glob("*/*.try*"))
    got = contents(archives.read_archives(spark, str(tmp_path / "out dir")))
    assert got == {(repo, rel): bytes(data) for repo, rel, data in files}


def test_no_archives(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    zipped(tmp_path / "empty.zip", {})
    assert archives.read_archives(spark, str(tmp_path)).collect() == []
