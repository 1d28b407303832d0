"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer makes one gzip member per record and leaves committing files to Spark's text
sink: records are the rows, and the line separator is an empty gzip member, which readers
of member files skip. So a retried task never leaves half a file. Records of equal payloads
share one stored payload: the record with the largest id is the response, the others revisit.

The reader takes plain and compressed archives. A record is good if its member can be
unpacked, its header is well formed, its block has the stated length and the line ends
after it, and its payload has the stated digest. After a failed check it looks for the next
place that begins a good member or version line and goes on there; the bytes passed over
are logged as a gap with the reason. Inside a member of several records it does the same over
the unpacked bytes, also over those unpacked before the damage; such a gap has its member's
place in the file, and its own inside the member in ``inner_start`` and ``inner_end``. Records
of a member with errors must have their stated digest; their headers are not checked further.

One task reads one file and holds it, so the writer begins a new file after a stated number of
bytes: members are joined to stretches of a sixteenth of it, which are the rows of the sink, and
a file has at most sixteen of them. A single record is never divided, so only a stretch of one
record that is larger itself can exceed its share.

Defined results: a null payload is empty, a null address has no header line, a null id is
smaller than any other, and repeated rows are written each. An empty table makes no records.
A very long text is one record of its own stretch. Only the three named columns are read, so
others may have any names.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MIN_REVISIT = 1000
ARCHIVE_BYTES = 128 << 20
STRETCHES = 16  # in a file
# Fixed value: the profile a revisit of equal payloads must name.
SAME_PAYLOAD = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = ("path string, start long, end long, inner_start long, inner_end long, problem string, record_type string, record_id string, "
         "uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")
_ENTRY = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("problem", pa.string()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary())])


def plan_records(pages: DataFrame, record_id: str, uri: str, payload: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(record_id, uri, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    records = pages.select(
        F.col(record_id).alias("record_id"), F.col(uri).alias("uri"), body.alias("payload"),
        F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"))
    heads = (records.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
             .agg(F.max("record_id").alias("head"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    revisit = F.col("head").isNotNull() & (F.col("record_id").isNull() | (F.col("record_id") < F.col("head")))
    return (records.join(heads, "payload_digest", "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("head")))
            .withColumn("payload", F.when(~revisit, F.col("payload"))).drop("head"))


def format_record(record: dict, date: str) -> bytes:
    """One record, up to and with the line ends after its block."""
    block = record["payload"] or b""
    lines = [VERSION, b"WARC-Type: " + record["record_type"].encode(),
             b"WARC-Record-ID: <urn:record:%s>" % _text(record["record_id"]),
             b"WARC-Date: " + date.encode()]
    if record["uri"] is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b"%20", _text(record["uri"])))
    if record["record_type"] == "revisit":
        lines += [b"WARC-Refers-To: <urn:record:%s>" % _text(record["refers_to"]),
                  b"WARC-Profile: " + SAME_PAYLOAD]
    lines += [b"WARC-Payload-Digest: sha1:" + record["payload_digest"].encode(),
              b"WARC-Payload-Length: %d" % record["payload_bytes"],
              b"Content-Type: text/html", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _text(value) -> bytes:
    return b"" if value is None else str(value).encode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of ``plan_records`` as compressed archives of some ``archive_bytes``."""
    share = archive_bytes // STRETCHES

    def stretch(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["members"])

    def pack(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            names = batch.schema.names
            for row in zip(*batch.columns, strict=True):
                record = {n: v.as_py() for n, v in zip(names, row, strict=True)}
                member = _member(format_record(record, date))
                if held and size + len(member) > share:
                    yield stretch(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield stretch(held)

    (records.mapInArrow(pack, "members binary").select(F.col("members").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", STRETCHES).text(path))


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, problem) of the record that begins at ``at``."""
    if not VERSION_LINE.match(data, at):
        return None, at, "no version line"
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        return None, at, "header not closed"
    fields = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or b" " in name:
            return None, at, "bad header line"
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None, at, "no length"
    begin = close + 4
    end = begin + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    block = data[begin:end]
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    own = hashlib.sha1(block).hexdigest()
    if kind != "revisit" and digest and digest != own:
        return None, end + 4, "wrong digest"
    stated = fields.get(b"warc-payload-length", b"")
    size = int(stated) if kind == "revisit" and stated.isdigit() else len(block)

    def name(field):
        return fields[field].decode("utf-8", "replace") if field in fields else None

    def urn(field):
        value = name(field)
        return None if value is None else value.strip("<>").removeprefix("urn:record:")

    return {
        "record_type": kind, "record_id": urn(b"warc-record-id"), "uri": name(b"warc-target-uri"),
        "refers_to": urn(b"warc-refers-to"), "payload_bytes": size,
        "payload_digest": digest if kind == "revisit" else own,
        "payload": None if kind == "revisit" else block}, end + 4, ""


def _unpack(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The member at ``at`` and where it ends."""
    worker = zlib.decompressobj(31)
    out = []
    try:
        for place in range(at, len(data), 1 << 16):
            out.append(worker.decompress(data[place:place + (1 << 16)]))
            if worker.eof:
                return b"".join(out), min(place + (1 << 16), len(data)) - len(worker.unused_data)
    except zlib.error:
        pass
    return None, at


def _unpack_part(data: bytes, at: int) -> tuple[bytes, bool]:
    """What a broken member gives before its damage, and whether it is only cut."""
    worker = zlib.decompressobj(31)
    out = []
    for place in range(at, len(data), 1 << 16):
        part = data[place:place + (1 << 16)]
        before = worker.copy()
        try:
            out.append(worker.decompress(part))
        except zlib.error:
            # an error takes the output of its whole call with it: go up to it byte by byte
            try:
                for one in range(len(part)):
                    out.append(before.decompress(part[one:one + 1]))
            except zlib.error:
                pass
            return b"".join(out), False
    return b"".join(out), True


def _plain_entries(inner: bytes, checked: bool = False) -> Iterator[tuple[int, int, str, dict | None]]:
    """(start, end, problem, record) of unpacked bytes; ``checked`` asks for stated digests."""
    def parsed(at):
        record, end, problem = parse_record(inner, at)
        if record and checked and b"\r\nwarc-payload-digest:" not in inner[at:inner.find(b"\r\n\r\n", at)].lower():
            return None, end, "not checked"
        return record, end, problem

    at, size = 0, len(inner)
    while at < size:
        record, end, problem = parsed(at)
        start = at
        if problem and not (end > at and (end == size or not parsed(end)[2])):
            at += 1
            while (found := VERSION_LINE.search(inner, at)) and parsed(found.start())[2]:
                at = found.start() + 1
            end = found.start() if found else size
        at = end
        yield start, at, problem, record


def _salvaged(data: bytes, at: int) -> tuple[list[tuple[int, int, str, dict | None]], int | None]:
    """Records and gaps inside the member at ``at``, and where it ends, none if it is broken."""
    inner, end = _unpack(data, at)
    if inner is not None:
        return list(_plain_entries(inner)), end
    inner, cut = _unpack_part(data, at)
    found = list(_plain_entries(inner, checked=not cut))
    if found and found[-1][2] or not cut and len(found) == 1:
        # the damage is in this one, wherever its checks may still pass
        found.pop()
    return [*found, (found[-1][1] if found else 0, len(inner), "broken member", None)], None


def _is_good(data: bytes, at: int) -> bool:
    """Whether the member or plain record at ``at`` is good, or some record in the member is."""
    if not data.startswith(MAGIC, at):
        return not parse_record(data, at)[2]
    inside, end = _salvaged(data, at)
    return (end is not None and not inside) or any(not problem for _, _, problem, _ in inside)


def read_entries(data: bytes) -> Iterator[tuple[int, int, str, dict | None]]:
    """(start, end, problem, record) of all records and gaps of an archive, in file order.

    Places are those in the file. The record of a gap inside a member of which other records
    are good has its place there.
    """
    at, size = 0, len(data)
    while at < size:
        start = at
        if data.startswith(MAGIC, at):
            inside, end = _salvaged(data, at)
            at = end or _next_good(data, at + 1)
            some = any(not problem for _, _, problem, _ in inside)
            for first, last, problem, record in inside if some else inside[:1]:
                place = {"inner_start": first, "inner_end": last} if some else None
                yield start, at, problem, place if problem else record
            continue
        record, end, problem = parse_record(data, at)
        # a failed record of known end is passed over only if something good follows it
        if problem and not (end > at and (end == size or _is_good(data, end))):
            end = _next_good(data, at + 1)
        at = end
        yield start, at, problem, record


def _next_good(data: bytes, at: int) -> int:
    """The next place where a good member or record begins, or the end."""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    while True:
        found = starts.search(data, at)
        if not found:
            return len(data)
        if _is_good(data, found.start()):
            return found.start()
        at = found.start() + 1


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records (``problem`` empty) and gaps of all archives under ``path``."""
    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for start, end, problem, record in read_entries(content.as_py()):
                    row = {"path": name.as_py(), "start": start, "end": end, "problem": problem, **(record or {})}
                    held += len(row.get("payload") or b"")
                    if not keep_payload:
                        row["payload"] = None
                    rows.append(row)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ENTRY)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, ENTRY)
