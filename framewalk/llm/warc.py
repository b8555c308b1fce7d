"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Records are made in the tasks, each a gzip member of its own (or plain), and
written by Spark's text writer, whose commit keeps whole files of finished tasks only.  The
reader goes through an archive from record to record.  Where a check fails (header,
length, record end, member checksum, digest), it searches for the next place at
which a valid member or version line begins, goes on from there, and gives out
the bytes in between as a gap with the reason.  It holds one record at a time.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import ARROW_BYTES, ARROW_ROWS, Workspace, table

# Forms of the format.
VERSION, MEMBER, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes read, and inflated, at a time.
CHUNK, PIECE = 1 << 18, 1 << 13

FIELDS = "path string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"
SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (f.split() for f in FIELDS.split(", "))])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---- writing


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A record with its HTTP head as one block; a revisit has the head alone.  White space and control characters of a URI are escaped."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(sha1(block).digest())}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(records: DataFrame, path: str, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes records(record_id, record_type, target_uri, refers_to, payload binary) as archives below path, one a task.

    record_type is response or revisit; a null payload is empty.  Spark's text writer ends each row with a line end.  For plain
    records that is the record's own; for members it is the zero byte that a member of less than 16 MB ends
    with, while a longer one is followed by an empty member, which ends with it, too.
    """
    last = member(b"")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = r["payload"] or b""
                data = record(r["record_type"], r["record_id"], r["target_uri"], date, payload, base32(sha1(payload).digest()), r["refers_to"])
                if compress:
                    data = member(data)
                    out.append(data[:-1] if data[-1] == 0 else data + last[:-1])
                else:
                    out.append(data[: -len(END)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    Workspace(records.sparkSession, "warc")  # sets the session up
    rows = records.select("record_id", "record_type", "target_uri", "refers_to", F.col("payload").cast("binary").alias("payload")).mapInArrow(made, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0" if compress else END.decode()).option("compression", "none").text(path)


# ---- reading


class Bad(Exception):
    """A failed check; `end` is where the record ends all the same, if that is known."""

    def __init__(self, problem: str, end: int | None = None):
        self.problem, self.end = problem, end


class Archive:
    """The bytes of one archive, read in chunks as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""
        self.line = (0, -1)  # there is no line end from the first up to the second

    def hold(self, at: int, n: int) -> int:
        """Holds the n bytes from `at` on, if there are as many; where they begin in what is held."""
        if not (self.start <= at and min(at + n, self.size) <= self.start + len(self.held)):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, CHUNK))
        return at - self.start

    def read(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, fewer at the end."""
        k = self.hold(at, n)
        return self.held[k : k + n]

    def find(self, marks: re.Pattern, at: int, width: int) -> int:
        """Where the first match from `at` on begins, of a pattern at most `width` long; the size without one."""
        while at + width <= self.size:
            k = self.hold(at, width)
            if m := marks.search(self.held, k):
                return self.start + m.start()
            at = self.start + len(self.held) - width + 1
        return self.size

    def line_end(self, at: int) -> int:
        if not self.line[0] <= at <= self.line[1]:
            self.line = (at, self.find(_line_end, at, 2))
        return self.line[1]


_line_end = re.compile(rb"\r\n")
_begin = re.compile(b"%b|%b" % (re.escape(MEMBER), re.escape(VERSION)))
_field = re.compile(rb"([!-9;-~]+):[ \t]*([^\x00-\x08\x0a-\x1f\x7f]*)")


def _text(value: bytes) -> str:
    try:
        return value.strip().decode()
    except UnicodeDecodeError:
        raise Bad("bad header line") from None


def header(archive: Archive, at: int) -> tuple[dict[str, str], int]:
    """The fields of the record that begins at `at`, names in lower case, and where its block begins.

    Lines are checked one by one, so that what is no header is left at its first line.
    """
    end = archive.line_end(at)
    if not re.fullmatch(rb"WARC/1\.\d", archive.read(at, min(end - at, 16))):
        raise Bad("no version line")
    fields: dict[str, str] = {}
    name = None
    while True:
        at = end + 2
        end = archive.line_end(at)
        if end >= archive.size:
            raise Bad("header cut off")
        line = archive.read(at, end - at)
        if not line:
            return fields, end + 2
        if line[:1] in b" \t" and name:
            fields[name] += " " + _text(line)
        elif m := _field.fullmatch(line):
            name = m[1].decode().lower()
            fields[name] = _text(m[2])
        else:
            raise Bad("bad header line")


def _digest(value: str | None) -> bytes | None:
    """The bytes of a sha1 digest in base32 or hex; None where there is none that can be checked."""
    kind, _, text = (value or "").partition(":")
    try:
        if kind.lower() == "sha1":
            return bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError:
        return b""  # equal to none
    return None


def parsed(archive: Archive, at: int) -> tuple[dict, int]:
    """The plain record that begins at `at`, checked, and where it ends."""
    fields, begin = header(archive, at)
    if not re.fullmatch(r"\d{1,18}", size := fields.get("content-length", "")):
        raise Bad("no length")
    if not {"warc-type", "warc-record-id"} <= fields.keys():
        raise Bad("no type or id")
    stop = begin + int(size)
    if stop + len(END) > archive.size:
        raise Bad("record cut off")
    if archive.read(stop, len(END)) != END:
        raise Bad("no record end")
    block = archive.read(begin, int(size))
    end = stop + len(END)
    if (wanted := _digest(fields.get("warc-block-digest"))) is not None and wanted != sha1(block).digest():
        raise Bad("block digest", end)
    head, payload = b"", block
    if fields.get("content-type", "").lower().startswith("application/http"):
        cut = block.find(END)
        head, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (block, b"")
    kind = fields["warc-type"].lower()
    wanted = _digest(fields.get("warc-payload-digest"))
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if kind == "revisit":
        size = int(length[1]) if length else None
    else:
        size = len(payload)
        as_sent = not re.search(rb"(?im)^transfer-encoding:", head)  # of what, the digest of a chunked payload is, is not agreed on
        if wanted is not None and as_sent and wanted != sha1(payload).digest():
            raise Bad("payload digest", end)
    found = {
        "record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": base32(wanted) if wanted else base32(sha1(payload).digest()) if kind != "revisit" else None, "payload_bytes": size, "payload": payload if kind != "revisit" else None,
    }
    return found, end


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        return self.data[self.at : self.at + n]


def inflated(archive: Archive, at: int) -> tuple[bytes, int]:
    """The content of the member that begins at `at`, its checksum checked, and where it ends."""
    packed, out = zlib.decompressobj(31), []
    try:
        while not packed.eof:
            part = archive.read(at, PIECE)
            if not part:
                raise Bad("member cut off")
            out.append(packed.decompress(part))
            at += len(part)
    except zlib.error:
        raise Bad("bad member") from None
    return b"".join(out), at - len(packed.unused_data)


def records_at(archive: Archive, at: int) -> tuple[list[dict], int]:
    """The records that begin at `at`, one if plain, all of a member (none of an empty one), and where they end."""
    if archive.read(at, len(MEMBER)) == MEMBER:
        data, end = inflated(archive, at)
        inside, found, k = Archive(_Bytes(data), len(data)), [], 0
        while k < len(data):
            try:
                one, k = parsed(inside, k)
            except Bad as bad:
                raise Bad(bad.problem, end) from None  # the member itself is whole
            found.append(one)
        return found, end
    if archive.read(at, len(VERSION)) == VERSION:
        one, end = parsed(archive, at)
        return [one], end
    raise Bad("no member or version line")


def salvage(archive: Archive) -> Iterator[dict]:
    """All records that pass their checks, in order, with their places, and the gaps between them."""
    at, gap, why = 0, None, None
    while at < archive.size:
        try:
            found, end = records_at(archive, at)
        except Bad as bad:
            if gap is None:
                gap, why = at, bad.problem
            at = bad.end if bad.end is not None else archive.find(_begin, at + 1, max(len(MEMBER), len(VERSION)))
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "problem": why}
            gap = None
        for one in found:
            yield one | {"offset": at, "length": end - at}
        at = end
    if gap is not None:
        yield {"offset": gap, "length": archive.size - gap, "problem": why}


def opened(path: str):
    """A file that Spark has listed, to be read from any place."""
    if path.startswith("file:"):
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below path, plain or gzipped by record, and the gaps between them.

    (path, offset, length, record_type, record_id, target_uri, date, refers_to, payload_digest, payload_bytes, payload, problem): a
    gap has a problem, the reason of its first failed check, and nulls but for its place; a record has none.  offset and length are
    bytes of the archive.  payload_digest is bare base32 SHA-1; a revisit's payload is null, its bytes are those that its head tells.
    Without `payload` that column is null, and no content leaves the tasks.

    An archive is read by one task, a record at a time.  A record whose digest fails but whose end is where its length says is
    passed over as a whole: what its content may hold that looks like a record is not taken for one.  An empty archive has no rows.
    """
    Workspace(spark, "warc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                rows, held = [], 0
                with opened(name) as file:
                    for r in salvage(Archive(file, size)):
                        if not payload:
                            r.pop("payload", None)
                        rows.append(r | {"path": name})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= ARROW_ROWS or held >= ARROW_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").mapInArrow(read, FIELDS)


def records(archives: DataFrame) -> DataFrame:
    return archives.where("problem is null")


def gaps(archives: DataFrame) -> DataFrame:
    """(path, offset, length, problem): the bytes that are quarantined."""
    return archives.where("problem is not null").select("path", "offset", "length", "problem")


# ---- pages


def with_revisits(pages: DataFrame, id_col: str, payload: Column, work: Workspace, least: int = 0) -> DataFrame:
    """pages with columns _type and _of: of the rows with equal payloads of at least `least` bytes, that with the largest id is the
    response (all that have it, if it is repeated, or all if they have no id), the others revisit it."""
    rows = pages.withColumns({"_id": F.col(id_col), "_key": F.sha1(payload)})
    often = rows.where(F.octet_length(payload) >= least).groupBy("_key").agg(F.count("*").alias("_n"), F.max("_id").alias("_last")).where("_n > 1 and _last is not null")
    found = work.matched(rows, often, ["_key"], "_n", "payloads")
    again = F.col("_last").isNotNull() & (F.col("_id").isNull() | (F.col("_id") < F.col("_last")))
    return found.select(*pages.columns, F.when(again, "revisit").otherwise("response").alias("_type"), F.when(again, F.col("_last")).alias("_of"))


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, compress: bool = True) -> None:
    """Writes a record for each row of pages: its URL, and its html in UTF-8 as payload; equal payloads are written once.

    The record's id is urn:page: and the row's.  Null html is an empty payload; a null URL gives no target; a null id is written
    as none.  Repeated rows are a record each.
    """
    work = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = with_revisits(pages.select(id_col, url_col, html_col), id_col, payload, work, least)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    made = rows.select(name(id_col).alias("record_id"), F.col("_type").alias("record_type"), F.col(url_col).alias("target_uri"), F.when(F.col("_of").isNotNull(), name("_of")).alias("refers_to"), payload.alias("payload"))
    write_warc(made, path, compress)
    work.drop()


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "archives")
    archive_pages(table(spark, sf_dir, "pages"), f"{work.path}/pages")
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    found = records(read_warc(spark, f"{work.path}/pages", payload=False))
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || k[5 * i + 1 : 5 * i + 5])::BIGINT >> {0}) & 31 AS BIGINT) + 1, 1)"
_BASE32 = f"array_to_string(list_transform(range(8), lambda i: {' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}), '')"

OP11_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS k FROM pages),
last AS (SELECT k, max(page_id) AS last FROM p GROUP BY k)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, coalesce(page_id < last, last IS NOT NULL) AS again FROM p JOIN last USING (k))"""
