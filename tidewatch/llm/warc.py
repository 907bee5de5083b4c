"""WARC transactions: archives written and read by Spark, request, response and metadata joined by concurrent-to ids.

Writing. Each capture gives three records (request, response or revisit, metadata) in one text row, and Spark's text
writer makes the files, so archives can lie in any store that Spark reaches. Each file holds at most `captures` captures.
Of captures with equal payloads of MIN_REVISIT bytes or more, that with the smallest page id is the response and the
others are revisits without payload, referring to it.

Reading. A file is unpacked in pieces and parsed record by record by Content-Length, so that of an unpacked archive a task holds
a piece and a record at a time; all gzip members of a file are read. A malformed record (a Content-Length that is no number of
1 to 18 ASCII digits among them), headers beyond MAX_HEADERS or a block beyond MAX_BLOCK bytes, a broken tail, a cut gzip member or gzip data that don't
unpack end their file: a row of type `unread` then gives the file as its target and, in its fields, the offset and number of the
unpacked bytes left over. The packed file is a row of Spark's binaryFile source, which takes files up to 2 GiB.

Assembly. Requests and metadata name the response in WARC-Concurrent-To; they are grouped by it (partial aggregation, the
smallest record id of each kind stays, so no list grows) and joined to the responses: one nested row per capture.
`with_originals` resolves the revisits of any archive by WARC-Refers-To. `unassembled` gives the records that no capture row
holds.

A null html is an empty payload, a null url an empty target. A row without page id is always a response and is nobody's
original. Rows that repeat an id and a payload are captures of their own, with equal record ids, types and partners (the
first request and metadata by record id, target and fields). Extra columns of pages are ignored. Empty tables give archives
without records, and reading a folder without archives gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

MIN_REVISIT = 100
CAPTURES_PER_FILE = 2_000
#: Up to so many revisits (some 100 bytes each) are broadcast to the pages.
FEW = 100_000
#: Bytes that are unpacked at once, and of the headers of a record at most.
UNPACK_BYTES, MAX_HEADERS = 1 << 16, 1 << 20
#: Bytes of a block at most: it is a value of a row.
MAX_BLOCK = 1 << 30
DATE = "2024-01-01T00:00:00Z"
RECORD = "rec_type string, record_id string, concurrent_to string, refers_to string, target_uri string, fields map<string,string>, payload_digest string, payload_bytes long, payload binary"


def _urn(kind: str, page_id: Column, digest: Column) -> Column:
    """A record id that follows from what the record is about."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text: headers, an empty line, the block, two line ends. Null header values are left out."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(*lines, size, block, F.lit("\r\n\r\n"))


def originals(pages: DataFrame) -> DataFrame:
    """(digest, original): of payloads that occur more than once and are large enough, the smallest page id."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.where(F.col("page_id").isNotNull()).select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    return keyed.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")


def write_archives(pages: DataFrame, path: str, captures: int = CAPTURES_PER_FILE) -> None:
    """Writes one capture per row of pages (page_id, url, html) into gzipped archives under path."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    # Revisits are found on short rows; only they are joined back. A list of counted size is broadcast and no html moves; a
    # longer one meets the pages by a shuffle. Pages without id are nobody's revisit and stay out of the join.
    light = pages.where("page_id is not null").select("page_id", F.sha2(payload, 256).alias("digest"))
    again = written(light.join(originals(pages), "digest").where("page_id > original").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "original").distinct(), "revisits")
    side = F.broadcast(again) if again.count() <= FEW else again.hint("shuffle_hash")
    known = rows.where("page_id is not null")
    known = known.join(side, (known["page_id"] == again["__id"]) & (known["digest"] == again["__digest"]), "left")
    rows = known.unionByName(rows.where("page_id is null"), allowMissingColumns=True)
    revisit = F.col("original").isNotNull()
    own = _urn("response", F.col("page_id"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", DATE)]
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", own),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("original"), F.col("digest")))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http,
    )
    asked = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], asked)
    known = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"),
    )
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], known)
    rows.select(F.concat(request, response, metadata).alias("value")).write.option("maxRecordsPerFile", captures).option("lineSep", "\r\n").option("compression", "gzip").text(path)


class Pieces:
    """The unpacked bytes of a file, read on demand: all its gzip members, or a file without gzip as it is."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.offset = raw, 0, bytearray(), 0
        self.member = None
        self.packed = raw.startswith(b"\x1f\x8b")
        #: Whether all that was read so far could be unpacked, and nothing else stood behind the last member.
        self.whole = True

    def _more(self) -> bool:
        """Unpacks one piece; false at the end."""
        if not self.packed:
            piece = self.raw[self.at : self.at + UNPACK_BYTES]
            self.at += len(piece)
            self.held += piece
            return bool(piece)
        if self.member is None:
            if not self.raw.startswith(b"\x1f\x8b", self.at):
                self.whole = self.whole and not self.raw[self.at :].strip(b"\0")
                return False
            self.member = zlib.decompressobj(47)
        # What a piece unpacks to is bounded as well; the rest of the piece is given again.
        piece = self.member.unconsumed_tail or self.raw[self.at : self.at + UNPACK_BYTES]
        self.at += 0 if self.member.unconsumed_tail else len(piece)
        if not piece:
            self.whole = False
            return False
        try:
            self.held += self.member.decompress(piece, 16 * UNPACK_BYTES)
        except zlib.error:
            self.whole, self.packed, self.at = False, False, len(self.raw)
            return False
        if self.member.eof:
            self.at -= len(self.member.unused_data)
            self.member = None
        return True

    def find(self, mark: bytes, most: int) -> int:
        """Where a mark begins in what is held, reading on for at most `most` bytes; -1 if it doesn't."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0 and len(self.held) < most:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return -1
        return at

    def fill(self, n: int) -> bool:
        """Holds n bytes, if there are as many."""
        while len(self.held) < n:
            if not self._more():
                return False
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += n
        return out

    def rest(self) -> int:
        """Number of the bytes that are left; they are let go."""
        n = len(self.held)
        self.held.clear()
        while self._more():
            n += len(self.held)
            self.held.clear()
        return n


def parse_records(data: Pieces) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every whole record; the data stand where reading ended."""
    while True:
        while data.fill(1) and data.held[:1] in (b"\r", b"\n"):
            data.take(1)
        end = data.find(b"\r\n\r\n", MAX_HEADERS)
        if end < 0 or not data.held.startswith(b"WARC/"):
            return
        headers = {}
        for line in bytes(data.held[:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = headers.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size) or int(size) > MAX_BLOCK or not data.fill(end + 4 + int(size)):
            return
        data.take(end + 4)
        yield headers, data.take(int(size))


def file_records(raw: bytes, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, and one of type unread if some of it could not be read."""
    data = Pieces(raw)
    yield from parse_records(data)
    at, left = data.offset, data.rest()
    if left or not data.whole:
        yield {"warc-type": "unread", "warc-target-uri": path}, b"offset: %d\r\nbytes: %d" % (at, left)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; payload is the body of an HTTP response. A task reads one archive at a time, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple] = []
                size = 0
                for headers, block in file_records(content.as_py(), file.as_py()):
                    kind = headers.get("warc-type", "")
                    fields, digest, payload = None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = hashlib.sha256(payload).hexdigest()
                    elif kind == "revisit":
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    elif kind in ("metadata", "unread"):
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
                    rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), fields, digest, None if payload is None else len(payload), payload if with_payload else None))
                    size += len(block)
                    if size > 1 << 22:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        text = pa.string()
        types = [text, text, text, text, text, pa.map_(text, text), text, pa.int64(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(9)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt*,warc,warc.gz}").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: record_id, response, request, metadata, n_requests, n_metadata."""
    main = records.where(F.col("rec_type").isin("response", "revisit"))
    response = main.select("record_id", F.struct("rec_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"))
    beside = records.where(F.col("rec_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())

    def first(kind: str) -> Column:
        entries = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\r\n")
        return F.min(F.when(F.col("rec_type") == kind, F.struct("record_id", "target_uri", entries.alias("fields"))))

    def number(kind: str) -> Column:
        return F.count(F.when(F.col("rec_type") == kind, 1))

    partners = beside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        first("request").alias("request"), first("metadata").alias("metadata"), number("request").alias("n_requests"), number("metadata").alias("n_metadata")
    )
    joined = response.join(partners, "record_id", "left")
    known = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id").alias("record_id"), F.col("metadata.target_uri").alias("target_uri"), F.str_to_map("metadata.fields", F.lit("\r\n"), F.lit(": ")).alias("fields")))
    return joined.select("record_id", "response", "request", known.alias("metadata"), F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def with_originals(captures: DataFrame) -> DataFrame:
    """Adds `original` to captures of assemble(): of a revisit the capture that its WARC-Refers-To names, as (record_id,
    target_uri, fields of its metadata); null for others, and for revisits of what is not there.

    Only revisits are joined, so records that refer to nothing are no hot key; of records that share an id one is taken.
    """
    named = F.struct("record_id", F.col("response.target_uri").alias("target_uri"), F.col("metadata.fields").alias("fields"))
    by_id = captures.groupBy(F.col("record_id").alias("__original")).agg(F.any_value(named).alias("original"))
    again = captures.where(F.col("response.refers_to").isNotNull())
    rest = captures.where(F.col("response.refers_to").isNull())
    return again.join(by_id, again["response.refers_to"] == by_id["__original"], "left").drop("__original").unionByName(rest, allowMissingColumns=True)


def unassembled(records: DataFrame, captures: DataFrame) -> DataFrame:
    """Records that are in no capture row: without a response, of another type, or beyond the first of their kind."""
    used = captures.select(F.explode(F.array("record_id", "request.record_id", "metadata.record_id")).alias("record_id")).where("record_id is not null").distinct()
    return records.join(used, "record_id", "left_anti")
