"""WARC archives as a Spark data source: one gzip member a record, read back in byte ranges.

Writing: each task writes one archive under a temporary name, which the commit moves to its place, so a lost task leaves nothing.
Of records with equal payloads the one with the smallest id is a response, the others are revisits that name it and carry no payload.

Reading: a file is cut into ranges of ``splitBytes``.  A task looks for the gzip magic in its range, decodes the member found and takes
it as a record if its checksum holds and its header block, its length and its end are those of a WARC record; the first one found in
a range must also be followed by the magic or by the file's end.  A record belongs to the range it begins in and is read to its end.
From a record the task goes on to where its member ends; where that is no record, it looks for the magic again, so damaged members
are passed over.  ``untiled`` names files whose records do not cover them (damage, or an archive inside a payload at a range's edge).

Defined results: a null or empty payload is the empty payload, which equals others of its kind; a null id comes last in a group and
is left out of the header, as is a null url; control characters in a url are percent-encoded; of repeated rows one is the response;
an empty table writes no file, and a folder without archives is an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from callbrook.session import written

MAGIC, SPLIT, READ, LEVEL = b"\x1f\x8b\x08", 64 << 20, 1 << 20, 6
RECORD = "file string, offset long, length long, version string, headers map<string,string>, http map<string,string>, payload binary"
WRITTEN = ("record_id", "type", "uri", "page_id", "payload", "payload_bytes", "digest", "refers_to", "refers_to_page")
_SUFFIX = re.compile(r"\.warc\.gz$")


# --- one record -----------------------------------------------------------------


def record_bytes(fields: dict, date: str) -> bytes:
    """A response or revisit record, not yet compressed."""
    body = fields["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % fields["payload_bytes"]
    block = http + (body if fields["type"] == "response" else b"")
    head = [("WARC-Type", fields["type"]), ("WARC-Record-ID", fields["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", fields["uri"]),
            ("WARC-Page-ID", fields["page_id"]), ("WARC-Payload-Digest", "sha1:" + fields["digest"])]
    if fields["type"] == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", fields["refers_to"]), ("WARC-Refers-To-Page-ID", fields["refers_to_page"])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {x}\r\n" for k, x in head if x is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            key = name.strip().lower()
            out[key] = f"{out[key]}, {value.strip()}" if key in out else value.strip()
    return out


def parsed(data: bytes) -> tuple[str, dict, dict, bytes] | None:
    """Version, headers, HTTP headers and payload of a record; none if it is not one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    version, _, lines = data[:end].partition(b"\r\n")
    headers = _fields(lines)
    size = headers.get("content-length", "")
    if not size.isdigit() or len(data) != end + 8 + int(size) or not data.endswith(b"\r\n\r\n"):
        return None
    block, http = data[end + 4:-4], {}
    if headers.get("content-type", "").startswith("application/http"):
        first, mark, rest = block.partition(b"\r\n\r\n")
        if mark:
            http, block = _fields(first.partition(b"\r\n")[2]), rest
    return version.decode("ascii", "replace"), headers, http, block


# --- byte ranges ----------------------------------------------------------------


class Ranged:
    """A file read by position in pieces of ``READ`` bytes, of which the last is kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.piece = file, size, 0, b""

    def take(self, pos: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``pos``; fewer at the end of a piece."""
        if not self.at <= pos < self.at + len(self.piece):
            self.file.seek(pos)
            self.at, self.piece = pos, self.file.read(min(max(n, READ), self.size - pos))
        return self.piece[pos - self.at:pos - self.at + n]

    def magic(self, pos: int, end: int) -> int | None:
        """The first place of the gzip magic from ``pos`` on and before ``end``."""
        while pos < end:
            piece = self.take(pos, READ)
            if len(piece) < 3 and pos + len(piece) < self.size:  # at a piece's edge
                self.piece = b""
                piece = self.take(pos, READ)
            k = piece.find(MAGIC)
            if k >= 0:
                return pos + k if pos + k < end else None
            if pos + len(piece) >= self.size:
                return None
            pos += max(1, len(piece) - 2)
        return None

    def member(self, pos: int) -> tuple[bytes, int] | None:
        """The decoded gzip member at ``pos`` and where it ends; none if it cannot be a whole record."""
        unpack, out, seen = zlib.decompressobj(31), [], 0
        at = pos
        try:
            while not unpack.eof:
                piece = self.take(at, 1 << 14) if at < self.size else b""
                if not piece:
                    return None
                at += len(piece)
                out.append(unpack.decompress(piece))
                if seen < 5:
                    seen = sum(map(len, out))
                    if not b"".join(out)[:5] == b"WARC/"[:min(seen, 5)]:
                        return None
        except zlib.error:
            return None
        return b"".join(out), at - len(unpack.unused_data)

    def record(self, pos: int):
        found = self.member(pos)
        record = found and parsed(found[0])
        return (pos, found[1] - pos, *record) if record else None

    def records(self, start: int, end: int) -> Iterator[tuple]:
        """``offset, length, version, headers, http, payload`` of the records that begin from ``start`` up to ``end``."""
        pos, known = start, start == 0  # whether a record may be taken without a look at the next
        while pos < end:
            found = self.record(pos) if known else None
            if not found:
                pos = self.magic(pos + known, end)
                if pos is None:
                    return
                found = self.record(pos)
                if not found or pos + found[1] < self.size and self.magic(pos + found[1], pos + found[1] + 1) is None:
                    pos, known = pos + 1, False
                    continue
            yield found
            pos, known = pos + found[1], True


def filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


class Range(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces  # file, size, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        from pyarrow import fs
        store, root = filesystem(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))
                       if f.type == fs.FileType.File and _SUFFIX.search(f.path))
        out, room = [[]], self.split
        for name, size in files:
            for start in range(0, size, self.split):
                piece = (name, size, start, min(size, start + self.split))
                if out[-1] and piece[3] - start > room:
                    out, room = [*out, []], self.split
                out[-1].append(piece)
                room -= piece[3] - start
        return [Range(pieces) for pieces in out]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        rows, held = [], 0
        for name, size, start, end in partition.pieces:
            with store.open_input_file(name) as file:
                for offset, length, version, headers, http, payload in Ranged(file, size).records(start, end):
                    rows.append((name, offset, length, version, [*headers.items()], [*http.items()], payload))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) == 1024:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        text, mapped = pa.string(), pa.map_(pa.string(), pa.string())
        kinds = (text, pa.int64(), pa.int64(), text, mapped, mapped, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          [x.split()[0] for x in RECORD.split(", ")])


class Archive(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, level: int):
        self.path, self.date, self.level = path, date, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        from pyspark import TaskContext
        store, root = filesystem(self.path)
        name, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for fields in batch.slice(at, 256).to_pylist():
                    if out is None:
                        store.create_dir(f"{root}/_temporary", recursive=True)
                        out = store.open_output_stream(f"{root}/_temporary/{name}", compression=None)
                    pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    out.write(pack.compress(record_bytes(fields, self.date)) + pack.flush())
        if out:
            out.close()
        return Archive(name if out else None)

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            if m and m.name:
                store.move(f"{root}/_temporary/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


class WarcSource(DataSource):
    """``format("warc")``; options ``path``, ``splitBytes``, ``date`` and ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("level", LEVEL)))


# --- jobs -----------------------------------------------------------------------


def base32(sha1_hex: Column) -> Column:
    """Five hexadecimal digits are four of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha1_hex, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_name(page_id: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id, row))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records_of(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows to write, with payloads of at least ``least`` bytes that equal another's as revisits."""
    url = F.col(url_col).cast("string")
    escaped = url
    for code in (*range(0x21), 0x7F):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.when(url.rlike("[\\x00-\\x20\\x7F]"), escaped).otherwise(url)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    t = pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    t = written(t.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("same"))
                .withColumn("row", F.monotonically_increasing_id()), "payloads")
    key = F.struct(F.col("page_id").isNull(), "page_id", "row")
    firsts = written(t.filter(F.col("payload_bytes") >= least).groupBy("same").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("same", "first.page_id", "first.row"), "firsts") \
        .select("same", F.col("page_id").alias("to_page"), F.col("row").alias("to_row"))
    # only rows of the second time and later; a table of its own, so that it is broadcast where it is small
    revisits = written(t.select("row", "same", "payload_bytes").join(firsts, "same").filter((F.col("row") != F.col("to_row")) & (F.col("payload_bytes") >= least))
                       .select("row", "to_page", "to_row"), "revisits")
    j = t.join(revisits, "row", "left")
    again = F.col("to_row").isNotNull()
    return j.select(
        record_name(F.col("page_id"), F.col("row")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("type"), "uri",
        F.col("page_id").cast("string").alias("page_id"), F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", base32(F.col("sha1")).alias("digest"),
        F.when(again, record_name(F.col("to_page"), F.col("to_row"))).alias("refers_to"), F.col("to_page").cast("string").alias("refers_to_page"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL, **columns: str) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    records_of(pages, least, **columns).select(*WRITTEN).write.format("warc").mode("append").option("date", date).option("level", str(level)).save(path)


def read_archives(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Every record of the archives in a folder."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", str(split)).load(path)


def pages_of(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: of a response from the payload read, of a revisit as stated."""
    h, response = F.col("headers"), F.col("headers")["warc-type"] == "response"
    return records.filter(h["warc-type"].isin("response", "revisit")).select(
        h["warc-page-id"].cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http")["content-length"]).cast("long").alias("payload_bytes"),
        F.when(response, base32(F.sha1("payload"))).otherwise(F.regexp_replace(h["warc-payload-digest"], "^sha1:", "")).alias("payload_digest"),
        h["warc-type"].alias("record_type"), h["warc-refers-to-page-id"].cast("long").alias("refers_to"))


def untiled(records: DataFrame, path: str) -> DataFrame:
    """``file, covered, bytes`` of the archives whose records do not cover them: sums per file, against the listing."""
    from pyarrow import fs
    store, root = filesystem(path)
    sizes = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if _SUFFIX.search(f.path)]
    listed = records.sparkSession.createDataFrame(sizes, "file string, bytes long")
    return listed.join(records.groupBy("file").agg(F.sum("length").alias("covered")), "file", "left") \
        .select("file", F.coalesce("covered", F.lit(0)).alias("covered"), "bytes").filter("covered <> bytes")
