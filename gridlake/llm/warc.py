"""WARC archives: writing whole-file gzip streams, normalising them to one member per record, reading by offset.

``write_archives`` writes one gzip stream per task (and per ``max_bytes`` of payload), the form in which many
crawls arrive: nothing in it can be read without inflating everything before it.  ``normalise`` inflates each
such stream once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets beside
it; records pass through in blocks, so memory does not depend on their size.  ``read_records`` reads members by
their offsets, any selection of them in any number of tasks, dealt by the bytes that they point at.

Archives of other writers are read, too: any record id, type and payload digest (SHA-256 as hex, SHA-1 as base 32;
others are not judged); what is not an HTTP response is given as it is.  Transfer and content encodings of a response are
left as they are.

A payload of ``least`` bytes or more that occurs again is written once: the row with the smallest page_id is the
response, the others are revisits without payload that name it.

Every task attempt writes files of its own name, and only files named by a finished task are read on, so lost
executors and repeated attempts leave nothing half-written in the result.

Defined cases: null html counts as empty; a null url leaves the target out; white space and control characters
of a url are percent-encoded; rows with the same page_id and payload are all responses; a null page_id never
stands for others and revisits a row with an equal payload if one has a page_id; an empty table gives no
archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import write_table
from gridlake.sources.tables import number_rows

BLOCK = 1 << 20
INDEX = ("archive string, offset long, length long, record_id string, record_type string, target_uri string, "
         "payload_digest string, error string")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it; names may hold blanks and any letters."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(parts.path)}")


def classify(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses).

    Only digests that occur more than once meet the rows again; the count is a partial aggregate, and the join
    can be split where one payload holds many rows."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= least).groupBy(F.col("payload_digest").alias("d"))
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return (rows.join(first, rows["payload_digest"] == first["d"], "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
            .select("page_id", "url", "payload", "payload_digest", "refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    """The page_id in an id of this writer; null for any other id."""
    own = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(own[1]) if own else None


def record_head(page_id, url, size: int, digest: str, refers_to) -> tuple[bytes, bytes]:
    """WARC and HTTP heads of a record; a revisit has the HTTP head of the full response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def write_archives(rows: DataFrame, folder: str, max_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Writes the rows of ``classify`` as whole-file gzip archives below ``folder``; returns (archive, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(folder)
        fs.create_dir(base, recursive=True)
        out, gz, name, held, count, done = None, None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, gz, held, count = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                head, http = record_head(page_id, url, len(payload), digest, refers_to)
                out.write(gz.compress(head + http))
                if refers_to is None:
                    out.write(gz.compress(payload))
                out.write(gz.compress(b"\r\n\r\n"))
                held, count = held + len(payload), count + 1
                if held >= max_bytes:
                    out.write(gz.flush())
                    out.close()
                    done.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         ["archive", "records"])

    return write_table(rows.mapInArrow(write, "archive string, records long"), "archives")


#: Longest record head, about, of an archive from elsewhere.
MOST_HEAD = 1 << 20


class _Inflated:
    """The bytes of a gzip file of one or more members, read forward in blocks."""

    def __init__(self, source):
        self.source, self.held, self.gz = source, bytearray(), zlib.decompressobj(31)
        self.raw, self.begun, self.ended = b"", False, False

    def _more(self) -> bool:
        """Inflates up to a block more; False at the end.  Input may be used up while output is still due."""
        while not self.ended:
            if not self.raw:
                self.raw = self.source.read(BLOCK)
            last = not self.raw
            if self.gz.eof and not last:
                self.gz, self.begun = zlib.decompressobj(31), False
            self.begun = self.begun or not last
            out = b"" if self.gz.eof else self.gz.decompress(self.raw, BLOCK)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if out:
                self.held += out
                return True
            if last:
                if self.begun and not self.gz.eof:
                    raise ValueError("the gzip stream ends early")
                self.ended = True
        return False

    def until(self, mark: bytes, most: int | None = MOST_HEAD) -> bytes | None:
        """Bytes up to and with ``mark``, at most about ``most`` (None: any number); None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if most is not None and seen > most:
                raise ValueError("a record head is too long")
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("the last record head is cut off")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def blocks(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in blocks."""
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            part = self.take(min(n, len(self.held)))
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(archives: DataFrame, folder: str, level: int = 6, most_head: int | None = MOST_HEAD) -> DataFrame:
    """Rewrites each file of the column ``archive`` with one gzip member per record and returns the offset index,
    a row per record.  The same rows are written as JSON lines beside each new file (``.idx``).  A gzip stream
    cannot be entered in the middle, so a file is one task's work; a file that cannot be read to its end keeps
    the records before the fault and gets an index row that holds the error.  So does one with a record head of more
    than about ``most_head`` bytes (None: no limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch["archive"].to_pylist():
                rows = []
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    try:
                        own_fs, own = open_path(path)
                        with own_fs.open_input_stream(own, compression=None) as source:
                            _rewrite(_Inflated(source), out, level, f"{folder}/{name}", rows, most_head)
                    except (ValueError, OSError, zlib.error) as e:
                        rows.append((f"{folder}/{name}", None, None, None, None, None, None, f"{path}: {e}"))
                names = [c.split()[0] for c in INDEX.split(", ")]
                with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as side:
                    for k in range(0, len(rows), 1000):
                        side.write("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows[k:k + 1000]).encode())
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return write_table(dealt(archives).mapInArrow(run, INDEX), "warc_index")


def dealt(archives: DataFrame) -> DataFrame:
    """The column ``archive``, one row per partition: the archives are numbered, and each number is a partition."""
    numbered = number_rows(archives.select("archive").distinct(), ["archive"])
    n = numbered.count()
    return numbered.repartitionById(max(n, 1), (F.col("row") - 1).cast("int")).select("archive")


def _rewrite(stream: _Inflated, out, level: int, archive: str, rows: list, most_head: int | None) -> None:
    offset = 0
    while True:
        head = stream.until(b"\r\n\r\n", most_head)
        if head is None:
            return
        head = head.lstrip(b"\r\n")
        fields = fields_of(head)
        gz = zlib.compressobj(level, wbits=31)
        length = out.write(gz.compress(head))
        for part in stream.blocks(int(fields["content-length"])):
            length += out.write(gz.compress(part))
        for _ in stream.blocks(4):  # the two line ends after a record
            pass
        length += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        rows.append((archive, offset, length, fields.get("warc-record-id"), fields.get("warc-type"),
                     fields.get("warc-target-uri"), fields.get("warc-payload-digest"), None))
        offset += length


RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "digest_ok boolean, record_id string, refers_to_id string, payload binary")
#: Bytes of members that a task reads, about.
PART_BYTES = 64 << 20


def _digest_ok(named: str | None, payload: bytes, sha256: str) -> bool | None:
    """Whether a head's digest is the payload's; null if there is none or of another kind."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() == "sha256":
        return value.lower() == sha256
    if kind.lower() == "sha1":
        return value.upper() == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return None


def parse_record(raw: bytes) -> tuple:
    """The columns of RECORDS from the bytes of one member.  Bytes and digest of a revisit are those that its
    heads name (null if they do not); those of a response are counted anew, and ``digest_ok`` says whether its head
    agrees.  Any other record's payload is its whole block, with its digest."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[:int(fields["content-length"])]
    uri, named, record_id = fields.get("warc-target-uri"), fields.get("warc-payload-digest"), fields.get("warc-record-id")
    url = uri if uri is None else unquote(uri)
    page_id, kind, refers = _page_id(record_id), fields.get("warc-type"), fields.get("warc-refers-to")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block.partition(b"\r\n\r\n")[0])
        known = named.removeprefix("sha256:") if named and named.startswith("sha256:") else None
        return page_id, url, kind, _page_id(refers), int(size[1]) if size else None, known, True if known else None, record_id, refers, None
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" and block.startswith(b"HTTP/") else block
    digest = hashlib.sha256(payload).hexdigest()
    return page_id, url, kind, None, len(payload), digest, _digest_ok(named, payload, digest), record_id, None, payload


def read_records(index: DataFrame, with_payload: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """The records that the rows of ``index`` point at, read by offset.  The rows are range-partitioned by archive and
    offset into as many parts as their members have ``part_bytes``, so that a task reads forward."""
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for archive, offset, length in zip(*(part[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                    if archive != path:
                        if source:
                            source.close()
                        fs, own = open_path(archive)
                        path, source = archive, fs.open_input_file(own)
                    source.seek(offset)
                    rows.append(parse_record(source.read(length)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)
        if source:
            source.close()

    found = index.where("error is null").select("archive", "offset", "length")
    parts = (found.agg(F.sum("length")).first()[0] or 0) // part_bytes + 1
    spread = found.repartitionByRange(max(parts, found.sparkSession.sparkContext.defaultParallelism), "archive", "offset")
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages as whole-file archives below ``folder``, normalises them, and returns the index.  A fault
    in one of the own archives is an error; their heads may be of any length, as the urls are."""
    archives = write_archives(classify(pages), f"{folder}/whole")
    index = normalise(archives, f"{folder}/members", most_head=None)
    fault = index.where("error is not null").select("error").head(1)
    if fault:
        raise OSError(fault[0]["error"])
    return index
