"""WARC archives with revisit records, and a salvage reader for damaged ones.

The reader checks each gzip member and each record. Where a check fails it looks for the next place that reads as a
member or a version line, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, open_filesystem, staged, write_bytes

#: Fixed values of the two formats.
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record; with ``refers_to`` a revisit, which has no payload but the full one's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record that passed its checks, or a gap with the reason why its bytes are quarantined.

    Offsets are those of the archive; inside a gzip member ``inner`` is where the record or gap starts when unpacked.
    """

    kind: str
    start: int
    end: int
    inner: int = 0
    reason: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    size: int = 0  # bytes of the whole record or gap, unpacked


class DamagedMember(ValueError):
    """A member that fails; ``content`` is what could be unpacked before the fault."""

    def __init__(self, reason: str, content: bytes):
        super().__init__(reason)
        self.content = content


def unpack_member(data: bytes, at: int, most: int | None = None, step: int = 1 << 16) -> tuple[bytes, int]:
    """(content, end) of the gzip member there; with ``most`` only about so much of it, unchecked."""
    d, out, pos, size = zlib.decompressobj(31), [], at, 0
    while not d.eof:
        if pos >= len(data):
            raise DamagedMember("truncated member", b"".join(out))
        part = data[pos : pos + step]
        try:
            out.append(d.decompress(part))
        except zlib.error as e:
            # The step held good bytes before the bad one: take them in ever smaller steps.
            raise DamagedMember(str(e), b"".join([*out, _before_fault(data, at, pos, min(pos + step, len(data)), size)])) from None
        pos, size = pos + step, size + len(out[-1])
        if most is not None and size >= most:
            break
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def _before_fault(data: bytes, at: int, good: int, bad: int, size: int) -> bytes:
    """What unpacks behind the first ``size`` bytes, up to the byte that fails: found by bytes after a fresh start at ``good``."""
    d, out = zlib.decompressobj(31), []
    try:
        out.append(d.decompress(data[at:good])[size:])
        for k in range(good, bad):
            out.append(d.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, end) of the record there; ValueError says what check failed."""
    version = VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2)
    if head_end < 0:
        raise ValueError("header without an end")
    fields = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a name")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal():
        raise ValueError("no content length")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = data[begin:end]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise ValueError("block digest differs")
    return fields, block, end + 4


def next_member(data: bytes, at: int) -> int:
    """Where the next member starts that unpacks to a version line, or -1."""
    while (at := data.find(MEMBER, at)) >= 0:
        try:
            start = unpack_member(data, at, most=10, step=512)[0]
        except DamagedMember as e:
            start = e.content
        if VERSION.match(start):
            return at
        at += 1
    return -1


class _Next:
    """The next member and the next version line from any place on, each sought once however many gaps ask for it."""

    def __init__(self, data: bytes):
        self.data, self.members, self.lines = data, (0, -2), (0, -2)

    def member(self, at: int) -> int:
        since, found = self.members
        if found == -2 or at < since or 0 <= found < at:
            self.members = (at, next_member(self.data, at))
        return self.members[1]

    def line(self, at: int) -> int:
        since, found = self.lines
        if found == -2 or at < since or 0 <= found < at:
            m = VERSION.search(self.data, at)
            self.lines = (at, m.start() if m else -1)
        return self.lines[1]

    def either(self, at: int, packed: bool = True) -> int:
        return min(x for x in (self.line(at), self.member(at) if packed else -1, len(self.data)) if x >= 0)


def _plain(data: bytes, start: int, whole: bool, where: tuple[int, int] | None = None, later: _Next | None = None) -> Iterator[Found]:
    """Records and gaps of unpacked bytes. ``where``: the member that they come from."""
    at, later = start, later or _Next(data)
    while at < len(data):
        if not whole and data.startswith(MEMBER, at):
            return
        try:
            fields, block, end = parse_record(data, at)
            yield Found("record", *(where or (at, end)), at if where else 0, "", fields, block, end - at)
        except ValueError as e:
            end = later.either(at + 1, packed=not whole)
            yield Found("gap", *(where or (at, end)), at if where else 0, str(e), size=end - at)
        at = end


def salvage(data: bytes) -> Iterator[Found]:
    """Every record that can be read from an archive, packed by record, by several, or not at all, and every gap.

    Of a damaged member, what unpacks before the fault is searched too, and its records count if they have a digest that
    agrees; the rest of it, up to the next member or version line, is a gap. An archive is read whole, 2 GB at most.
    """
    at, later = 0, _Next(data)
    while at < len(data):
        if data.startswith(MEMBER, at):
            try:
                content, end = unpack_member(data, at)
                yield from _plain(content, 0, True, (at, end))
            except DamagedMember as e:
                end, rest = later.either(at + 1), len(e.content)
                for x in _plain(e.content, 0, True, (at, end)):
                    if x.kind == "record" and not x.fields.get("warc-block-digest", "").startswith("sha256:"):
                        x = Found("gap", at, end, x.inner, "no digest in a damaged member", size=x.size)
                    if x.kind == "gap" and x.inner + x.size == len(e.content):
                        rest = x.inner  # cut short by the fault
                    else:
                        yield x
                yield Found("gap", at, end, rest, f"damaged member: {e}")
            at = end
            continue
        end = at
        for x in _plain(data, at, False, later=later):
            yield x
            end = x.end
        at = max(end, at + 1)


ROW = "archive string, start long, end long, inner long, kind string, reason string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def describe(x: Found) -> dict:
    """A row of ROW. A response's payload is measured anew; one whose payload digest differs becomes a gap."""
    row = {"start": x.start, "end": x.end, "inner": x.inner, "kind": x.kind, "reason": x.reason}
    if x.kind == "gap":
        return row
    head, _, payload = x.block.partition(b"\r\n\r\n")
    row |= {"page_id": _page(x.fields.get("warc-record-id")), "url": x.fields.get("warc-target-uri"), "record_type": x.fields.get("warc-type"), "refers_to": _page(x.fields.get("warc-refers-to"))}
    stated = x.fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if row["record_type"] == "revisit":
        length = re.search(rb"(?im)^content-length: *(\d+)", head)
        return row | {"payload_digest": stated, "payload_bytes": int(length[1]) if length else None}
    measured = hashlib.sha256(payload).hexdigest()
    if stated and stated != measured:
        return row | {"kind": "gap", "reason": "payload digest differs"}
    return row | {"payload_digest": measured, "payload_bytes": len(payload), "payload": payload}


def _archive_rows(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, size, held, total = TaskContext.get().partitionId(), 0, 0, [], 0

        def close():
            nonlocal files, size, total
            if held:
                write_bytes(folder, f"pages-{part:05d}-{files:04d}.warc.gz", held)
                files, total, size = files + 1, total + size, 0
                held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64).to_pydict()
                for page_id, url, html, first in zip(rows["page_id"], rows["url"], rows["html"], rows["first_id"], strict=True):
                    refers_to = None if first is None or first == page_id else first
                    held.append(gzip.compress(record(page_id, url, html.encode("utf-8", "replace"), refers_to), 6, mtime=0))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_pydict({"files": [files], "bytes": [total]})

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = 16 << 20, most_bytes: int = 8 << 20) -> int:
    """Write one record for each page, each its own gzip member, and return the number of archives.

    Of equal payloads of at least ``least`` bytes, the page with the smallest page_id is a response and the others
    revisit it. A null html is empty; a null page_id is never the smallest, and its record has no number. Rows that
    repeat the smallest page_id are responses each. Extra columns are not read. Repeated payloads are broadcast by their
    digests if these take at most ``most_bytes``.
    """
    bounded_batches(pages.sparkSession)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    several = page.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = staged(several.where("n > 1").select("digest", "first_id"), "repeated-payloads")
    if first.count() * 100 <= most_bytes:  # then pages stay where they are; else both sides are dealt by digest
        first = F.broadcast(first)
    rows = page.join(first, "digest", "left").select("page_id", "url", "html", "first_id").sortWithinPartitions("page_id", "url")
    return sum(r.files for r in rows.mapInArrow(_archive_rows(folder, archive_bytes), "files long, bytes long").collect())


def _salvage_rows(with_payload: bool):
    names = [c.split()[0] for c in ROW.split(", ")] + ["payload"] * with_payload
    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in ROW.split(", ")] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for x in salvage(content.as_py()):
                    row = describe(x) | {"archive": path.rsplit("/", 1)[-1]}
                    if not with_payload:
                        row.pop("payload", None)
                    held.append(row)
                    size += len(row.get("payload", b"")) + 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, types, strict=True)], names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, pattern: str = "*.warc*") -> DataFrame:
    """A row for each record and each quarantined gap of the archives in a folder."""
    schema = ROW + ", payload binary" * with_payload
    filesystem, path = open_filesystem(folder)
    from pyarrow import fs

    info = filesystem.get_file_info([path])[0]
    if info.type != fs.FileType.Directory or not any(not f.base_name.startswith((".", "_")) for f in filesystem.get_file_info(fs.FileSelector(path))):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(_salvage_rows(with_payload), schema)
