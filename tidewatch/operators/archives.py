"""Archives as tables of members: which may be unpacked, and why not. Archives are streamed, a piece of a member at a time."""

from __future__ import annotations

import io
import re
import tarfile
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from ..functions import paths

# Limits.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 10_000, 25_000_000, 250_000_000, 200
REASONS = ("too_many_members", "unsafe_path", "link", "special_file", "member_too_large", "total_too_large", "ratio_too_high", "duplicate_path")


@F.pandas_udf(StringType())
def composed(name: pd.Series) -> pd.Series:
    """NFC and case fold, for names beyond ASCII; the JVM has no normalisation function."""
    return name.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


def collision_key(name: Column, normalise: bool = True) -> Column:
    """Path with which two members collide."""
    clean = F.array_join(F.filter(paths.parts(name), lambda x: (x != "") & (x != ".")), "/")
    if not normalise:
        return F.lower(clean)
    plain = clean.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, F.lower(clean)).otherwise(composed(F.when(~plain, clean)))


def archive_audit(members: DataFrame, normalise: bool = True) -> DataFrame:
    """One row per archive: accepted, and the first reason against it in the order of REASONS.

    members: archive_id, name, size, compressed_size, is_dir, is_link, is_special. Compressed sizes of null mean that only
    the whole file is compressed (column `file_bytes`), as in tar. Duplicates are found by counting keys, not by joins.
    """
    size, packed = F.coalesce("size", F.lit(0)), F.col("compressed_size")
    bloated = F.when(packed.isNotNull() & (size > 0), (packed == 0) | (size / F.when(packed > 0, packed) > MAX_RATIO))
    flags = members.select(
        "archive_id", size.alias("size"), collision_key(F.col("name"), normalise).alias("key"), paths.unsafe_member_path(F.col("name")).alias("unsafe"), "is_link", "is_special",
        F.coalesce(bloated, F.lit(False)).alias("bloated"), packed.isNull().alias("whole"), (F.col("file_bytes") if "file_bytes" in members.columns else F.lit(None).cast("long")).alias("file_bytes"),
    )
    per_key = flags.groupBy("archive_id", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.bool_or("unsafe").alias("unsafe"), F.bool_or("is_link").alias("link"),
        F.bool_or("is_special").alias("special"), F.bool_or("bloated").alias("bloated"), F.bool_and("whole").alias("whole"), F.max("file_bytes").alias("file_bytes"),
    )
    agg = per_key.groupBy("archive_id").agg(
        F.sum("n").alias("n_members"), F.sum("total").alias("total_bytes"), F.max("largest").alias("largest"), F.bool_or("unsafe").alias("unsafe"), F.bool_or("link").alias("link"),
        F.bool_or("special").alias("special"), F.bool_or("bloated").alias("bloated"), F.max("n").alias("copies"), F.bool_and("whole").alias("whole"), F.max("file_bytes").alias("file_bytes"),
    )
    whole = F.col("whole") & F.col("file_bytes").isNotNull() & (F.col("total_bytes") > 0) & ((F.col("file_bytes") == 0) | (F.col("total_bytes") / F.when(F.col("file_bytes") > 0, F.col("file_bytes")) > MAX_RATIO))
    tests = (
        F.col("n_members") > MAX_MEMBERS, F.col("unsafe"), F.col("link"), F.col("special"), F.col("largest") > MAX_MEMBER_BYTES, F.col("total_bytes") > MAX_TOTAL_BYTES,
        F.col("bloated") | F.coalesce(whole, F.lit(False)), F.col("copies") > 1,
    )
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)])
    return agg.select("archive_id", "n_members", "total_bytes", reason.isNull().alias("accepted"), reason.alias("reason"))


MEMBERS = (
    "archive_id string, name string, size long, compressed_size long, is_dir boolean, is_link boolean, is_special boolean, piece int, content binary, file_bytes long, error string"
)
#: Bytes of content in a row, and of small archives that one task reads.
PIECE, GROUP = 4 << 20, 64 << 20
#: Bytes of an empty ZIP archive.
LEAST_ZIP = 22
SUFFIX = re.compile(r"\.(?:zip|tar|tar\.gz|tgz)\Z", re.IGNORECASE)
_COLUMNS = [c.split(" ")[0] for c in MEMBERS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in MEMBERS.split(", ")])
Header = tuple[str, int, int | None, bool, bool, bool]


def _zip_headers(z: zipfile.ZipFile) -> Iterator[tuple[Header, zipfile.ZipInfo | None]]:
    for i in z.infolist():
        link = (i.external_attr >> 16) & 0o170000 == 0o120000
        small = i.file_size <= MAX_RATIO * max(1, i.compress_size)
        yield (i.filename, i.file_size, i.compress_size, i.is_dir(), link, False), None if i.is_dir() or link or not small else i


def _tar_headers(t: tarfile.TarFile) -> Iterator[tuple[Header, tarfile.TarInfo | None]]:
    for m in t:
        t.members = []  # it would keep them all
        link = m.issym() or m.islnk()
        yield (m.name, m.size, None, m.isdir(), link, not (m.isfile() or m.isdir() or link)), m if m.isfile() else None


def _pieces(member: IO[bytes]) -> Iterator[bytes]:
    yield (piece := member.read(PIECE))
    while len(piece) == PIECE:
        piece = member.read(PIECE)
        if piece:
            yield piece


def member_rows(path: str, file: IO[bytes], file_bytes: int, content: bool = True) -> Iterator[tuple]:
    """Rows of one archive, a piece of a member at a time: first all headers are looked at, and only where they keep within the
    limits of number, sizes and ratio is any content read. An archive that can't be read has one row with `error`, the last."""

    def row(header: Header, piece: int, data: bytes | None) -> tuple:
        return (path, *header, piece, data, file_bytes, None)

    try:
        if zipped := file_bytes >= LEAST_ZIP and zipfile.is_zipfile(file):
            archive, headers = zipfile.ZipFile(file), _zip_headers
        else:
            file.seek(0)
            archive, headers = tarfile.open(fileobj=file), _tar_headers
        seen, total, fine = [], 0, content
        for header, _ in headers(archive):
            seen.append(header)
            total += header[1]
            if len(seen) > MAX_MEMBERS or total > MAX_TOTAL_BYTES or header[1] > MAX_MEMBER_BYTES or (not zipped and total > MAX_RATIO * max(1, file_bytes)):
                fine = False
            if len(seen) > MAX_MEMBERS or total > MAX_TOTAL_BYTES:
                break
        if not fine:
            yield from (row(header, 0, None) for header in seen)
            return
        if not zipped:
            file.seek(0)
            archive = tarfile.open(fileobj=file)
        for header, member in headers(archive):
            if member is None:
                yield row(header, 0, None)
                continue
            with archive.open(member) if zipped else archive.extractfile(member) as opened:
                for k, data in enumerate(_pieces(opened)):
                    yield row(header, k, data)
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, OSError, RuntimeError, ValueError, EOFError, NotImplementedError) as e:
        yield (path, None, None, None, None, None, None, 0, None, file_bytes, f"unreadable: {type(e).__name__}")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most some PIECE bytes of content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[8] or b"") + 200
        if size >= PIECE:
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, r)) for r in held], _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, r)) for r in held], _SCHEMA)


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


@dataclass
class _Archives(InputPartition):
    """Archives that one task reads: a large one, or small ones of GROUP bytes together."""

    files: list[tuple[str, int]]


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"], options.get("content", "true").lower() == "true"

    def partitions(self) -> list[_Archives]:
        store, root = store_of(self.path)
        info = store.get_file_info(root)
        every = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        parts, size = [], GROUP
        for f in sorted((f for f in every if f.is_file and SUFFIX.search(f.path)), key=lambda f: f.path):
            if size + f.size > GROUP:
                parts.append(_Archives([]))
                size = 0
            parts[-1].files.append((f.path, f.size))
            size += f.size
        return parts

    def read(self, partition: _Archives | None) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for path, size in partition.files if partition else ():
            with store.open_input_file(path) as file:
                yield from _batches(member_rows(path, file, size, self.content))


class ArchiveMembers(DataSource):
    """spark.read.format("archive-members").load(folder or file): a row per piece of every member of every ZIP and TAR archive.

    Archives are opened where they lie, in any store that Arrow's file systems reach from the executors, and streamed: neither
    an archive nor a member is ever held whole, and none is a row. Option content=false reads headers only.
    """

    @classmethod
    def name(cls) -> str:
        return "archive-members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> _ArchiveReader:
        return _ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The rows of all archives under path, see ArchiveMembers; nothing is unpacked to disk."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive-members").option("content", str(content).lower()).load(path)


def archive_members(files: DataFrame) -> DataFrame:
    """The same of archives that lie in a table (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = data.as_py() or b""
                yield from _batches(member_rows(path, io.BytesIO(raw), len(raw)))

    return files.select("path", "content").mapInArrow(run, MEMBERS)


def whole_members(pieces: DataFrame) -> DataFrame:
    """(archive_id, name, size, content) of the files among members; only members of several pieces are gathered, each by itself."""
    files = pieces.where("not is_dir and content is not null")
    several = files.where(F.col("size") > PIECE).groupBy("archive_id", "name", "size").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("ps"))
    joined = F.aggregate(F.transform("ps", lambda p: p["content"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return files.where(F.col("size") <= PIECE).select("archive_id", "name", "size", "content").unionByName(several.select("archive_id", "name", "size", joined.alias("content")))


def safe_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of accepted archives that are files, rejected archives with reason)."""
    broken = members.where("error is not null").select("archive_id", F.col("error").alias("reason"))
    audit = archive_audit(members.where("piece = 0").join(broken, "archive_id", "left_anti"))
    fine = audit.where("accepted").select("archive_id")
    files = whole_members(members.join(fine, "archive_id", "left_semi"))
    return files, broken.unionByName(audit.where("not accepted").select("archive_id", "reason"))
