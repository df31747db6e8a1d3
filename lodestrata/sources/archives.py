"""Archives as partitioned tables: members are listed and read by tasks, by offset; nothing is unpacked.

A ZIP's central directory is cut into ranges of members on planning, by the lengths in its entries alone; each task parses its
range, and opens its members only if content is asked for. A TAR has no directory: one task walks its headers. Paths may be local, or
URIs that ``pyarrow.fs`` knows (hdfs, s3, gs); they have to be readable from executors. A member that can't be read keeps its row:
``status`` is ok, directory, encrypted, unsupported, truncated, bad_checksum, damaged, or unsafe (its name leaves the root; never read).
"""

from __future__ import annotations

import json
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.session import ship

SCHEMA = "archive string, path string, bytes long, compressed long, is_dir boolean, status string, content binary"
#: Members of a ZIP that one task lists and reads, and bytes that are decompressed at once.
RANGE, STEP = 1000, 1 << 20
# Fixed values of the ZIP format: signatures, lengths of the fixed parts, the place of a 64-bit extra field.
END, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, WIDE = 22, 20, 46, 30, 0x0001


def open_at(path: str):
    """A seekable stream of a local path or a URI."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


@dataclass
class Range(InputPartition):
    archive: str
    at: int = 0
    size: int = 0
    shift: int = 0
    tar: bool = False


def _directory(stream) -> tuple[int, int, int] | None:
    """(offset, size, shift of all offsets) of a ZIP's central directory; None if the stream is no ZIP."""
    whole = stream.seek(0, 2) or stream.tell()
    tail_at = max(0, whole - END_SIZE - (1 << 16))
    stream.seek(tail_at)
    tail = stream.read(whole - tail_at)
    at = tail.rfind(END)
    if at < 0 or len(tail) < at + END_SIZE:
        return None
    size, offset = struct.unpack("<II", tail[at + 12 : at + 20])
    ends = tail_at + at
    if offset == 0xFFFFFFFF or size == 0xFFFFFFFF or tail[at + 10 : at + 12] == b"\xff\xff":
        stream.seek(ends - LOCATOR_SIZE)
        (record,) = struct.unpack("<Q", stream.read(LOCATOR_SIZE)[8:16])
        stream.seek(record)
        found = stream.read(56)
        if found[:4] != END64:
            return None
        size, offset = struct.unpack("<QQ", found[40:56])
        ends = record
    return offset, size, ends - size - offset  # bytes put before an archive move everything


def _ranges(archive: str, stream, members: int) -> Iterator[Range]:
    """Ranges of ``members`` entries; only the lengths in the entries are looked at."""
    offset, size, shift = _directory(stream)
    at, end, first, n = offset + shift, offset + shift + size, offset + shift, 0
    stream.seek(at)
    held = b""
    while at < end:
        while len(held) < ENTRY_SIZE or len(held) < ENTRY_SIZE + sum(struct.unpack("<HHH", held[28:34])):
            more = stream.read(min(STEP, end - at - len(held)))
            if not more:
                raise ValueError(f"damaged directory: {archive}")
            held += more
        if held[:4] != ENTRY:
            raise ValueError(f"damaged directory: {archive}")
        long = ENTRY_SIZE + sum(struct.unpack("<HHH", held[28:34]))
        held, at, n = held[long:], at + long, n + 1
        if n == members:
            yield Range(archive, first, at - first, shift)
            first, n = at, 0
    if n:
        yield Range(archive, first, at - first, shift)


def _entries(data: bytes) -> Iterator[tuple]:
    """(name, flags, method, crc, compressed, bytes, offset) of each entry of a range."""
    at = 0
    while at < len(data):
        flags, method, crc, small, whole, n, m, k = struct.unpack("<8xHH4xIIIHHH", data[at : at + 34])
        (offset,) = struct.unpack("<I", data[at + 42 : at + ENTRY_SIZE])
        start = at + ENTRY_SIZE
        name, extra = data[start : start + n], data[start + n : start + n + m]
        while len(extra) >= 4:
            kind, long = struct.unpack("<HH", extra[:4])
            if kind == WIDE:
                numbers = iter(struct.unpack(f"<{long // 8}Q", extra[4 : 4 + long // 8 * 8]))
                whole = next(numbers) if whole == 0xFFFFFFFF else whole
                small = next(numbers) if small == 0xFFFFFFFF else small
                offset = next(numbers) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + long :]
        yield name.decode("utf-8" if flags & 0x800 else "cp437"), flags, method, crc, small, whole, offset
        at = start + n + m + k


def unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or name[1:3] in (":/", ":\\")


def _body(stream, entry: tuple, shift: int, head: int) -> tuple[str, bytes | None]:
    """(status, content) of one member; with ``head`` only so many bytes of it, unchecked."""
    _, flags, method, crc, small, whole, offset = entry
    if flags & 1:
        return "encrypted", None
    if method not in (0, 8):
        return "unsupported", None
    stream.seek(offset + shift)
    fixed = stream.read(LOCAL_SIZE)
    if len(fixed) < LOCAL_SIZE or fixed[:4] != LOCAL:
        return "damaged", None
    stream.seek(offset + shift + LOCAL_SIZE + sum(struct.unpack("<HH", fixed[26:30])))
    unpack = zlib.decompressobj(-15) if method == 8 else None
    out, left, wanted = [], small, min(head, whole) if head else whole
    have = 0
    try:
        while left and have < wanted:
            data = stream.read(min(STEP, left))
            if not data:
                return "truncated", None
            left -= len(data)
            data = unpack.decompress(data, wanted - have + 1) if unpack else data
            while data or unpack and unpack.unconsumed_tail and have <= wanted:
                out.append(data)
                have += len(data)
                data = unpack.decompress(unpack.unconsumed_tail, wanted - have + 1) if unpack and unpack.unconsumed_tail and have <= wanted else b""
    except zlib.error:
        return "damaged", None
    content = b"".join(out)
    if head and whole > head:
        return "ok", content[:head]
    if len(content) != whole:
        return "truncated" if len(content) < whole else "damaged", None
    return ("ok", content) if zlib.crc32(content) == crc else ("bad_checksum", None)


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.content, self.head, self.members = options.get("content") == "true", int(options.get("head", 0)), int(options.get("members", RANGE))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with open_at(path) as stream:
                if _directory(stream):
                    out += _ranges(path, stream, self.members)
                    continue
                stream.seek(0)
                try:
                    tarfile.open(fileobj=stream).close()
                except tarfile.TarError as error:
                    raise ValueError(f"not an archive: {path}") from error
                out.append(Range(path, tar=True))
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.archive:
            return
        with open_at(partition.archive) as stream:
            if partition.tar:
                yield from self._tar(partition.archive, stream)
                return
            stream.seek(partition.at)
            for entry in _entries(stream.read(partition.size)):
                name, _, _, _, small, whole, _ = entry
                status, content = "ok", None
                if name.endswith("/"):
                    status = "directory"
                elif unsafe(name):
                    status = "unsafe"
                elif self.content:
                    status, content = _body(stream, entry, partition.shift, self.head)
                yield partition.archive, name, whole, small, name.endswith("/"), status, content

    def _tar(self, archive: str, stream) -> Iterator[tuple]:
        with tarfile.open(fileobj=stream) as members:
            for m in members:
                status, content = "directory" if m.isdir() else "unsafe" if unsafe(m.name) else "ok" if m.isfile() else "unsupported", None
                if self.content and status == "ok":
                    content = members.extractfile(m).read(self.head or -1)
                yield archive, m.name, m.size, m.size, m.isdir(), status, content


class Members(DataSource):
    """``spark.read.format("archive_members")``: options paths (JSON list), content, head, members."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options)


def members(spark: SparkSession, *paths: str, content: bool = False, head: int = 0, per_task: int = RANGE) -> DataFrame:
    """Rows of ``SCHEMA`` for every member of the archives; content only if asked for, whole (checked) or its first ``head`` bytes."""
    ship(spark)
    spark.dataSource.register(Members)
    options = {"paths": json.dumps(paths), "content": str(content).lower(), "head": str(head), "members": str(per_task)}
    return spark.read.format("archive_members").options(**options).load()


# Word lists of the name hints.
AUGMENTATION_WORDS = "aug(?:mented|mentation)?|brightness|hsv|gamma|noise|gaussian|enhanced?|synthetic"
RESOLUTION_WORDS = "resized?|resolution|small|large|high[_-]?res|low[_-]?res"
ANNOTATION_WORDS = "ann(?:otation)?s?|labels?"
REFERENCE_WORDS = "readme|metadata|meta|classes?|license|dataset[_-]?info"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


#: Name of each hint, and its pattern. A text file is an annotation if its name or a folder says so.
HINTS = {
    "augmentation": rf"(?i)(?:^|[/_\-.])(?:{AUGMENTATION_WORDS})(?:[/_\-.]|$)",
    "resolution": rf"(?i)\d{{2,5}}[x×]\d{{2,5}}|(?:^|[/_\-.])(?:{RESOLUTION_WORDS})(?:[/_\-.]|$)",
    "reference": rf"(?i)(?:^|[/_\-.])(?:{REFERENCE_WORDS})(?:[/_\-.]|$)",
    "annotation": rf"(?i)\.(?:json|xml)$|^(?:.*[/_\-.])?(?:{ANNOTATION_WORDS})[/_\-.](?:.*\.)?txt$",
}


def structure_report(rows: DataFrame, top: int = 30) -> DataFrame:
    """(section, key, n) from names alone: members, extensions, top folders, the fullest folders, hints, repeated image names, unsafe paths.

    ``rows``: path, is_dir. Sidecars (``__MACOSX/`` and ``._`` names) count as members only. Every count is summed in the tasks first.
    """
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1))
    named = rows.select("path", F.col("is_dir"), base.alias("base"), F.when(suffix == "", "[none]").otherwise(suffix).alias("suffix"))
    file_, content = ~F.col("is_dir"), ~F.col("is_dir") & ~F.col("path").startswith("__MACOSX/") & ~F.col("base").startswith("._")
    image = content & F.col("suffix").isin(*IMAGE_SUFFIXES)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("[root]")
    cell = lambda section, key, when: F.when(when, F.struct(F.lit(section).alias("section"), key.alias("key")))
    cells = [
        cell("member", F.when(F.col("is_dir"), "directory").otherwise("file"), F.lit(True)), cell("extension", F.col("suffix"), file_), cell("image", F.col("suffix"), image),
        cell("top", F.substring_index("path", "/", 1), file_), cell("folder", folder, file_),
        *(cell("hint", F.lit(name), content & F.col("path").rlike(pattern)) for name, pattern in HINTS.items()),
        cell("unsafe", F.lit("path"), F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")),
    ]
    counts = named.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.section", "c.key").agg(F.count("*").alias("n"))
    fullest = counts.where("section = 'folder'").orderBy(F.desc("n"), "key").limit(top)
    repeated = named.where(image).groupBy(F.lower("base").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    again = repeated.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("repeated").alias("section"), F.lit("image_names").alias("key"), "n")
    return counts.where("section <> 'folder'").unionByName(fullest).unionByName(again)
