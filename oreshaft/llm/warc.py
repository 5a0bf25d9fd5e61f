"""WARC archives: a writer and a sequential, streaming reader.

Every record is a gzip member of its own, and a file is nothing but such members.
The reader takes an archive in blocks of READ_BYTES, inflates member after member
with one incremental zlib object each, at most STEP_BYTES at a time, frames each
block by its Content-Length and verifies block and payload digests as bytes pass;
without payloads it holds one step. A fault (truncated member, missing or wrong
length, wrong digest, no record) raises an error that names the archive and offset.

Archives of others are read too: record types other than response, revisit and
resource are passed over, a record id that is not of a page here has a null page_id
(record_id has it as it stands), a payload without a digest gets one, and a record
without an HTTP header is its payload. Only SHA-1 digests are verified.

Writing: each task writes its rows to archives of at most ROLL_BYTES in the
shared folder, under names of its own attempt. The manifest of finished archives
is itself a table written with Spark's commit protocol, so that archives of lost
or repeated attempts are never listed, and reading starts from the manifest. File
access goes through pyarrow's file systems, by the folder's URI.

Of records with equal payloads of at least `least` bytes the one with the largest
id is the response and the others are revisits of it, without payload; their HTTP
header still tells the payload's length. Nulls: a null payload is empty, a null
url has no target header, a null id is written as "null" and counts as the
smallest. Repeated rows of the id that is the response are responses all. An empty
table gives no archive. Other columns of pages are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, written

READ_BYTES = 1 << 16
STEP_BYTES = 1 << 18
HEAD_BYTES = 1 << 20
ROLL_BYTES = 64 << 20
LEVEL = 4
ID = "urn:oreshaft:page:"
TYPES = ("response", "revisit", "resource")
_DATE = b"2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; with refers_to it is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>".encode(), b"WARC-Date: " + _DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]").encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>".encode()]
    digest = _sha1(payload)
    if refers_to is None:
        block += payload
    head += [b"WARC-Payload-Digest: " + digest, b"WARC-Block-Digest: " + _sha1(block), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + _END + block + _END) + z.flush()


class Member:
    """One gzip member of a stream, inflated piece by piece."""

    def __init__(self, stream, pending: bytes, where: str):
        self.stream, self.pending, self.where = stream, pending, where
        self.z, self.used, self.held = zlib.decompressobj(31), 0, b""

    def piece(self) -> bytes:
        """Some more bytes, at most STEP_BYTES; none at the member's end."""
        while not self.z.eof:
            self.pending = self.pending or self.stream.read(READ_BYTES)
            try:
                out = self.z.decompress(self.pending, STEP_BYTES)  # at the stream's end, what zlib may still hold
            except zlib.error as e:
                raise ValueError(f"{self.where}: bad member: {e}") from e
            if not self.pending and not out and not self.z.eof:
                raise ValueError(f"{self.where}: truncated member")
            rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.used, self.pending = self.used + len(self.pending) - len(rest), rest
            if out:
                return out
        return b""

    def head(self) -> list[bytes]:
        """The lines up to an empty one."""
        while _END not in self.held:
            more = self.piece()
            if not more or len(self.held) > HEAD_BYTES:
                raise ValueError(f"{self.where}: no WARC record")
            self.held += more
        head, _, self.held = self.held.partition(_END)
        return head.split(b"\r\n")

    def take(self, size: int) -> Iterator[bytes]:
        """The next size bytes."""
        while size:
            got = self.held or self.piece()
            if not got:
                raise ValueError(f"{self.where}: content length doesn't frame the record, {size} bytes lack")
            yield got[:size]
            size, self.held = size - min(size, len(got)), got[size:]

    def rest(self) -> bytes:
        """What is left, as far as it can matter."""
        out = self.held
        while more := self.piece():
            out = (out + more)[:64]
        return out


def members(stream, name: str = "archive") -> Iterator[tuple[int, Member]]:
    """(offset, member) of each gzip member, read block by block; a member left early is passed over."""
    offset, pending = 0, b""
    while pending := pending or stream.read(READ_BYTES):
        m = Member(stream, pending, f"{name} at {offset}")
        yield offset, m
        while m.piece():
            pass
        offset, pending = offset + m.used, m.pending


def _named(lines: list[bytes]) -> dict[str, str]:
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}


def sha1_of(digest: str | None) -> str | None:
    """Lower-case hex of a SHA-1 digest header, in base 32 or hex; else null."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


def parsed(m: Member, types: tuple[str, ...] = TYPES, payloads: bool = True) -> tuple[dict[str, str], dict[str, str], int, str, bytes] | None:
    """(WARC headers, HTTP headers, payload bytes, payload SHA-1, payload) of a member's record, framed and verified; None for another type."""
    first, *fields = m.head()
    if not first.startswith(b"WARC/"):
        raise ValueError(f"{m.where}: no WARC record")
    warc = _named(fields)
    if warc.get("warc-type") not in types:
        return None
    length = warc.get("content-length", "")
    if not length.isdigit():
        raise ValueError(f"{m.where}: content length {length!r}")
    whole, own, size, kept, http = hashlib.sha1(), hashlib.sha1(), 0, [], {}
    head: bytes | None = b"" if warc.get("content-type", "").lower().startswith("application/http") else None
    for piece in m.take(int(length)):
        whole.update(piece)
        if head is not None:  # the HTTP header isn't over
            head += piece
            if _END not in head:
                if len(head) > HEAD_BYTES:
                    raise ValueError(f"{m.where}: HTTP header of over {HEAD_BYTES} bytes")
                continue
            lines, _, piece = head.partition(_END)
            http, head = _named(lines.split(b"\r\n")[1:]), None
        own.update(piece)
        size += len(piece)
        if payloads:
            kept.append(piece)
    if head is not None:
        http = _named(head.split(b"\r\n")[1:])
    if (rest := m.rest()) != _END:
        raise ValueError(f"{m.where}: content length {length} doesn't frame the record, {rest[:8]!r} follows")
    if (said := sha1_of(warc.get("warc-block-digest"))) and said != whole.hexdigest():
        raise ValueError(f"{m.where}: block digest differs")
    said = sha1_of(warc.get("warc-payload-digest"))
    if warc["warc-type"] == "revisit":
        return warc, http, int(http["content-length"]) if http.get("content-length", "").isdigit() else None, said, b"".join(kept)
    if said and said != own.hexdigest():
        raise ValueError(f"{m.where}: payload digest differs")
    return warc, http, size, own.hexdigest(), b"".join(kept)


def _write(folder: str):
    def run(batches):
        target, root = fs.FileSystem.from_uri(folder)
        out, path, n, size, name = None, None, 0, 0, uuid.uuid4().hex
        done = []
        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{root}/{name}-{len(done):05d}.warc.gz"
                    target.create_dir(root, recursive=True)
                    out, n, size = target.open_output_stream(path, compression=None), 0, 0  # else the name makes it one more gzip layer
                data = record(page, url, (html or "").encode(), refers)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    done, out = [*done, (path, n, size)], None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            names = [f"{folder}/{p.rpartition('/')[2]}" for p, _, _ in done]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["archive", "records", "bytes"])

    return run


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write page_id, url and html as records; the manifest: archive, records, bytes."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("size"))
    same = keyed.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "latest")
    rows = keyed.join(same, ["sha", "size"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to"))
    folder = _uri(Scratch(pages.sparkSession).path("warc", keep=True))
    return written(rows.mapInArrow(_write(folder), "archive string, records bigint, bytes bigint"), "manifest")


READ = "page_id bigint, record_id string, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _read(payloads: bool, types: tuple[str, ...]):
    def number(urn: str | None) -> int | None:
        value = (urn or "").strip("<>").removeprefix(ID)
        return int(value) if (urn or "").startswith(f"<{ID}") and value.lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                source, path = fs.FileSystem.from_uri(_uri(archive))
                rows, held = [], 0
                with source.open_input_stream(path, compression=None) as stream:
                    for _, member in members(stream, archive):
                        if (found := parsed(member, types, payloads)) is None:
                            continue
                        warc, _, size, digest, payload = found
                        row = (number(warc.get("warc-record-id")), warc.get("warc-record-id"), warc.get("warc-target-uri"), warc["warc-type"], number(warc.get("warc-refers-to")), size, digest)
                        rows.append((*row, payload) if payloads else row)
                        held += len(payload)
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return run


def _batch(rows: list, payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in (READ + ", payload binary" * payloads).split(", ")])


def read_archives(manifest: DataFrame, payloads: bool = True, types: tuple[str, ...] = TYPES) -> DataFrame:
    """The records of all archives of a manifest (or any table with a column archive), each archive read once from its start."""
    parts = max(1, min(manifest.count(), 16 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("archive").repartition(parts).mapInArrow(_read(payloads, types), READ + ", payload binary" * payloads)
