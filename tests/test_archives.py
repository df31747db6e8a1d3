"""Archives by ranges: ten thousand members, damaged and unsafe ones, TAR, and the structure report."""

import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import archives, files

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR"


def test_ten_thousand_members_in_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("root/", b"")
        for k in range(10_000):
            kind = zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED
            archive.writestr(zipfile.ZipInfo(f"root/s{k % 3}/é{k:05d}.png"), PNG + struct.pack(">II", k % 50 + 1, 7) + b"x" * (k % 300), kind)

    def closed(*_):
        raise AssertionError("a member was opened on the driver")

    monkeypatch.setattr(archives, "_body", closed)  # the tasks have modules of their own
    rows = archives.members(spark, path, content=True, per_task=700)
    assert rows.rdd.getNumPartitions() == 15
    found = rows.where("NOT is_dir").select("path", "bytes", "status", F.crc32("content").alias("crc"), F.length("content").alias("n")).collect()
    with zipfile.ZipFile(path) as archive:
        wanted = {i.filename: (i.file_size, i.CRC) for i in archive.infolist()}
    assert len(found) == 10_000 and {r["status"] for r in found} == {"ok"}
    assert all(wanted[r["path"]] == (r["bytes"], r["crc"]) and r["n"] == r["bytes"] for r in found)
    listing = files.archive_members(spark, path)
    assert listing.count() == 10_001 and listing.where("is_dir").count() == 1 and files.single_root(listing) == "root"
    sizes = files.archive_image_sizes(spark, path).groupBy("height").agg(F.count("*"), F.min("width"), F.max("width")).collect()
    assert [tuple(r) for r in sizes] == [(7, 10_000, 1, 50)]


def faulty(path):
    """A ZIP with a member of each status, behind bytes that aren't its own."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in ("good.txt", "altered.txt", "torn.txt", "../up.txt", "/abs.txt", "a/../../b.txt", "locked.txt", "folder/"):
            archive.writestr(name, b"" if name.endswith("/") else name.encode() * 50)
        archive.writestr(zipfile.ZipInfo("old.txt"), b"shrunk" * 40, zipfile.ZIP_BZIP2)
        archive.writestr(zipfile.ZipInfo("plain.txt"), b"stored", zipfile.ZIP_STORED)
    data = bytearray(packed.getvalue())
    with zipfile.ZipFile(packed) as archive:
        at = {i.filename: i.header_offset for i in archive.infolist()}
    start = lambda name: at[name] + 30 + len(name)
    data[start("plain.txt")] ^= 1  # another byte, the checksum stays
    data[start("torn.txt")] |= 7  # no such block type
    data[at["altered.txt"]] = 0  # no local header
    entry = data.rfind(b"locked.txt") - 46
    data[entry + 8] |= 1
    path.write_bytes(b"#!/bin/stub\n" + data)


def test_faulty_members_keep_their_rows(spark, tmp_path):
    path = tmp_path / "f.zip"
    faulty(path)
    found = {r["path"]: (r["status"], r["content"]) for r in archives.members(spark, str(path), content=True, per_task=3).collect()}
    assert {k: v[0] for k, v in found.items()} == {
        "good.txt": "ok", "altered.txt": "damaged", "torn.txt": "damaged", "../up.txt": "unsafe", "/abs.txt": "unsafe", "a/../../b.txt": "unsafe", "locked.txt": "encrypted", "folder/": "directory",
        "old.txt": "unsupported", "plain.txt": "bad_checksum",
    }
    assert bytes(found["good.txt"][1]) == b"good.txt" * 50 and all(c is None for s, c in found.values() if s != "ok")
    with pytest.raises(Exception, match="member:"):
        files.open_source(spark, str(path)).collect()


def test_large_members_heads_and_wide_fields(spark, tmp_path):
    path = str(tmp_path / "w.zip")
    body = bytes(range(256)) * 20_000  # more than one step, and it packs a thousandfold
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as member:
        member.write(body)
    whole = archives.members(spark, path, content=True).first()
    assert zlib.crc32(whole["content"]) == zlib.crc32(body) and whole["bytes"] == len(body)
    assert bytes(archives.members(spark, path, content=True, head=1000).first()["content"]) == body[:1000]
    with pytest.raises(Exception, match="not an archive"):
        (tmp_path / "x").write_bytes(b"nothing")
        archives.members(spark, str(tmp_path / "x")).collect()


def test_wide_end_records_and_cut_directories(tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for k in range(66_000):
            archive.writestr(f"{k}", b"")
    assert sum(1 for r in archives._ranges("a", packed, 1000)) == 66
    with pytest.raises(ValueError, match="damaged directory"):
        data = packed.getvalue().replace(b"PK\x01\x02", b"PK\x01\x03", 1)
        list(archives._ranges("a", io.BytesIO(data), 1000))


def test_tar_and_several_archives(spark, tmp_path):
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as archive:
            for member, body in (("d/x.txt", b"one"), ("../y.txt", b"two")):
                info = tarfile.TarInfo(member)
                info.size = len(body)
                archive.addfile(info, io.BytesIO(body))
            folder = tarfile.TarInfo("d")
            folder.type = tarfile.DIRTYPE
            archive.addfile(folder)
    paths = [str(tmp_path / n) for n in ("a.tar", "b.tar.gz")]
    found = sorted((r["archive"], r["path"], r["status"], r["content"] and bytes(r["content"])) for r in archives.members(spark, *paths, content=True).collect())
    assert found == [(p, *row) for p in paths for row in (("../y.txt", "unsafe", None), ("d", "directory", None), ("d/x.txt", "ok", b"one"))]
    assert archives.members(spark, "file://" + paths[0]).count() == 3


def test_structure_report(spark):
    names = ["r/img/a_noise.JPG", "r/img/b.jpg", "r/other/B.jpg", "r/640x480/c.png", "r/labels/x.txt", "r/notes.txt", "r/label.txt", "r/ann.json", "r/README", "__MACOSX/r/._b.jpg", "r/img/", "../up", "top.txt"]
    rows = spark.createDataFrame([(n, n.endswith("/")) for n in names], "path string, is_dir boolean")
    found = {(r["section"], r["key"]): r["n"] for r in archives.structure_report(rows).collect()}
    assert found["member", "directory"] == 1 and found["member", "file"] == 12 and found["image", ".jpg"] == 3 and found["extension", ".jpg"] == 4 and found["extension", "[none]"] == 2
    assert found["hint", "augmentation"] == 1 and found["hint", "resolution"] == 1 and found["hint", "annotation"] == 3 and found["hint", "reference"] == 1
    assert found["repeated", "image_names"] == 1 and found["unsafe", "path"] == 1 and found["folder", "[root]"] == 1 and found["folder", "r"] == 4 and found["top", "r"] == 9
    assert archives.structure_report(rows.where("path IS NULL")).collect() == []
