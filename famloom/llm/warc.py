"""WARC records in ZIP packages, read by ranges of files.

The writer puts records, each a gzip member, into archives of bounded size: ZIP
packages (files) whose members are stored, not compressed, so that a byte range
of the file is a byte range of the member.  The reader opens a package where it
lies and seeks: the end record, the ZIP64 records and the central directory from
its tail, then the index members (CDXJ or CDX lines, plain or gzip), and then each
record by its own range.  No member is extracted, and no package is held whole;
the ranges of one package are read by many tasks.

Files are reached through pyarrow's file systems by path or URI, so driver and
executors must share them; those that are found by ``found`` are listed by Spark.

Defined results: a null html is an empty payload; a page whose page_id is null
revisits an equal page that has one, and else is a response; rows repeated with
the page_id of the response are responses too; a very long html is one record;
other columns are left out, whatever their names; an empty table gives no
packages, an empty package or index no records.  Of foreign packages, records
that are no pages have no page_id, and revisits no payload_bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.llm.common import ARROW_BYTES, arrow_batches, materialise, partitions

#: Payloads from this size are told apart by digest; smaller ones are always responses.
LEAST = 100
#: Bytes of records after which a package is closed; bytes of an index read at once.
PACKAGE, BLOCK = 4 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages have no time of their own.
DATE = "2000-01-01T00:00:00Z"

# --- ZIP ------------------------------------------------------------------------

#: Signatures of the ZIP format (fixed values).
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ALL32, _ALL16 = 0xFFFFFFFF, 0xFFFF


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranges:
    """Byte ranges of a file, and how many bytes were asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.asked = file, size, 0

    @classmethod
    def of(cls, path: str) -> Ranges:
        system, at = file_system(path)
        file = system.open_input_file(at)
        return cls(file, file.size())

    def __call__(self, at: int, n: int) -> bytes:
        self.asked += n
        self.file.seek(at)
        return self.file.read(n)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


def directory(read: Ranges) -> dict[str, Member]:
    """Members by name, from the central directory (and its ZIP64 records) of a package."""
    size = read.size
    base = max(0, size - 22 - _ALL16)
    tail = read(base, size - base)
    at = len(tail) - 22
    while at >= 0:  # the record may be followed by a comment of the length it states
        at = tail.rfind(END, 0, at + 4)
        if at < 0 or len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    many, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = base + at
    if end >= 20 and (locator := read(end - 20, 20))[:4] == LOCATOR64:
        where = struct.unpack_from("<Q", locator, 8)[0]
        record = read(where, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        many, length, start = struct.unpack_from("<QQQ", record, 32)
        end = where
    shift = end - length - start  # bytes before the package, if any
    raw, at, out = read(start + shift, length), 0, {}
    for _ in range(many):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, whole, n, x, c = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, end_extra = at + 46 + n, at + 46 + n + x
        while extra + 4 <= end_extra:
            tag, m = struct.unpack_from("<HH", raw, extra)
            if tag == 1:  # ZIP64: only the fields that are all ones above, in this order
                p = extra + 4
                if whole == _ALL32:
                    whole, p = struct.unpack_from("<Q", raw, p)[0], p + 8
                if packed == _ALL32:
                    packed, p = struct.unpack_from("<Q", raw, p)[0], p + 8
                if header == _ALL32:
                    header = struct.unpack_from("<Q", raw, p)[0]
            extra += 4 + m
        out[name] = Member(name, method, packed, whole, header + shift)
        at += 46 + n + x + c
    return out


def data_start(read: Ranges, member: Member) -> int:
    """Where a stored member's bytes begin; its local header may have other extra fields than the directory."""
    head = read(member.header, 30)
    if head[:4] != LOCAL or member.method != 0:
        raise ValueError(f"{member.name} is not a stored member")
    n, x = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + x


# --- WARC -----------------------------------------------------------------------


def record(kind: str, page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, date: str = DATE) -> bytes:
    """One record as a gzip member.  A revisit has no payload; X-Payload-Length says how long it was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=3, mtime=0)


def _safe(url: str | None) -> str:
    return (url or "").encode("ascii", "backslashreplace").decode().replace("\r", "%0D").replace("\n", "%0A")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record, gzip or plain."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, body.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else body


def surt(url: str) -> str:
    """Key of an index line: the host's labels from the last to the first, then the path."""
    parts = urlsplit(url)
    return quote(",".join(reversed((parts.hostname or "").split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe=",)/?=&")


class Packer:
    """Collects records into packages of bounded size."""

    def __init__(self, limit: int = PACKAGE, zip64: bool = False):
        self.limit, self.zip64 = limit, zip64
        self._clear()

    def _clear(self) -> None:
        self.data, self.index, self.size = [], [], 0

    def add(self, entry: dict, raw: bytes) -> bytes | None:
        """Bytes of a package, if this record filled it."""
        self.index.append(entry | {"length": str(len(raw)), "offset": str(self.size), "filename": DATA.rpartition("/")[2]})
        self.data.append(raw)
        self.size += len(raw)
        return self.close() if self.size >= self.limit else None

    def close(self) -> bytes | None:
        if not self.data:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            stamp = "".join(x for x in DATE if x.isdigit())
            lines = "".join(sorted(f"{surt(x['url'])} {stamp} {json.dumps(x)}\n" for x in self.index))
            for name, parts in ((DATA, self.data), (INDEX, [lines.encode()])):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as f:
                    for part in parts:
                        f.write(part)
        self._clear()
        return out.getvalue()


def _lines(read: Ranges, start: int, size: int, packed: bool) -> Iterator[bytes]:
    """Lines of a stored member, read in blocks; ``packed``: it is one or more gzip members."""
    rest, unzip = b"", zlib.decompressobj(31) if packed else None
    for at in range(0, size, BLOCK):
        raw = read(start + at, min(BLOCK, size - at))
        if unzip is not None:
            parts = []
            while raw:
                parts.append(unzip.decompress(raw))
                raw = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
            raw = b"".join(parts)
        *whole, rest = (rest + raw).split(b"\n")
        yield from whole
    if rest:
        yield rest


def entries(read: Ranges) -> Iterator[tuple[str, int, int]]:
    """(url, place in the package, length) of each record in a package's indexes.

    Index members are those whose name says CDXJ or CDX.  CDXJ lines end in JSON;
    a CDX line's fields are named by the letters of the file's first line
    (a url, V offset, S length, g file).  A line's file is a member of its name, or
    of that name in some folder.
    """
    members = directory(read)
    by_name = {n.rpartition("/")[2]: m for n, m in members.items()} | members
    starts: dict[str, int] = {}
    for member in members.values():
        base = member.name.lower().removesuffix(".gz")
        if not base.endswith((".cdxj", ".cdx")) or not member.size:
            continue
        letters: list[str] = []
        for line in _lines(read, data_start(read, member), member.size, member.name.lower().endswith(".gz")):
            text = line.decode("utf-8").strip()
            if text.startswith("CDX "):
                letters = text.split()[1:]
                continue
            if not text or text.startswith("!"):
                continue
            if "{" in text:
                x = json.loads(text[text.index("{") :])
                url, name, at, n = x.get("url", ""), x["filename"], int(x["offset"]), int(x["length"])
            else:
                x = dict(zip(letters, text.split(), strict=False))
                if not {"V", "S", "g"} <= x.keys():
                    raise ValueError(f"{member.name}: a line of no known form")
                url, name, at, n = x.get("a", ""), x["g"], int(x["V"]), int(x["S"])
            if name not in starts:
                if (home := by_name.get(name) or by_name.get(name.rpartition("/")[2])) is None:
                    raise ValueError(f"{member.name}: no member {name}")
                starts[name] = data_start(read, home)
            yield url, starts[name] + at, n


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first: the smallest page_id with the same payload, for pages that revisit it.

    Ids and digests alone are grouped and joined to say which pages revisit; the
    html moves once, dealt by page and digest, so no digest is hot.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    keys = materialise(rows.where(F.octet_length("html") >= LEAST).select("page_id", digest.alias("digest")).distinct(), "digests")
    several = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    back = keys.join(several.hint("merge"), "digest").where("page_id is null or page_id != first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    rows = rows.withColumn("digest", digest)
    return rows.join(back.hint("merge"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "first")


def packages(pages: DataFrame, folder: str, limit: int = PACKAGE, zip64: bool = False) -> DataFrame:
    """Writes packages with a record for each page into ``folder``, which all share; (path, bytes) of each.

    A package is named by a digest of its content and put in place whole, so a
    task that runs twice leaves the same files.
    """
    arrow_batches(pages.sparkSession)
    rows = judged(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, (system, at) = Packer(limit, zip64), file_system(folder)
        system.create_dir(at, recursive=True)

        def put(content: bytes) -> pa.RecordBatch:
            name = f"{hashlib.sha256(content).hexdigest()[:32]}.wacz"
            part = f"{at}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(content)
            system.move(part, f"{at}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(content)], pa.int64())], ["path", "bytes"])

        for b in batches:
            for page, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                kind = "response" if first is None else "revisit"
                raw = record(kind, page, url, html.encode("utf-8", "surrogatepass"), digest, first)
                if full := packer.add({"url": _safe(url), "mime": "text/html", "status": "200", "digest": f"sha256:{digest}"}, raw):
                    yield put(full)
        if rest := packer.close():
            yield put(rest)

    return materialise(rows.mapInArrow(run, "path string, bytes long"), "packages")


def found(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the files of a pattern; Spark lists them, and reads none."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def indexed(files: DataFrame) -> DataFrame:
    """(path, at, length, url) of each record of the packages ``files`` (path)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                got = entries(Ranges.of(path))
                while rows := list(islice(got, 10_000)):
                    urls, at, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(urls, pa.string())], ["path", "at", "length", "url"])

    return files.select("path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, "path string, at long, length long, url string")


def _page(urn: str | None) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(got[1]) if got else None


def records(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of packages (path), read by its range: page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's digest is worked out from what was read, and compared with its header where that is a SHA-256.
    """
    spark = files.sparkSession
    arrow_batches(spark)
    # Ranges of one package are dealt to many tasks, neighbours to one.
    listed = materialise(indexed(files), "index").repartitionByRange(partitions(spark), "path", "at").sortWithinPartitions("path", "at")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for b in batches:
            rows, held = [], 0
            for path, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "at", "length")), strict=True):
                if path != last:
                    last, read = path, Ranges.of(path)
                headers, payload = parsed(read(at, n))
                kind, ident, stated = headers["warc-type"], headers.get("warc-record-id"), headers.get("warc-payload-digest", "")
                digest, size = stated.removeprefix("sha256:") or None, headers.get("x-payload-length")
                if kind != "revisit":
                    digest = hashlib.sha256(payload).hexdigest()
                    if re.fullmatch("sha256:[0-9a-f]{64}", stated) and stated != f"sha256:{digest}" or size is not None and int(size) != len(payload):
                        raise ValueError(f"the payload of {ident} is damaged")
                    size = len(payload)
                row = (_page(ident), ident, headers.get("warc-target-uri"), None if size is None else int(size), digest, kind, _page(headers.get("warc-refers-to")))
                rows.append(row + ((payload if kind != "revisit" else None),) * with_payload)
                held += len(payload) * with_payload
                if held > ARROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return listed.mapInArrow(run, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)
