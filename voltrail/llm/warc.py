"""WARC archives in Zstandard frames: a dictionary in a leading skippable frame, then one frame per record.

The reader loads the dictionary, cuts the stream into frames by their block headers, decodes one frame per record and
checks the record's headers, lengths and digest; what doesn't hold raises ValueError with the archive's name and offset.

Defined cases: a null html counts as empty; pages without an id are responses; rows with the group's largest page_id are
responses, repeats included; null urls leave the target address out; an empty table gives no archives; other columns
are not read. Archives are cut at a size, so a reader's task has little to redo if its executor is lost.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import open_fs, pieces, shared_dir, stored

#: Marks the skippable frame that holds the dictionary, and any zstd frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload a page of a larger id has too.

    Only digests travel here. Copies are counted before the shuffle, and joined by a key that Spark can split.
    """
    narrow = pages.where(F.col("size") >= least_bytes).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    return narrow.join(groups, "digest").where("page_id < refers_to").distinct()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record (without the payload) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary_for(samples: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary trained on samples; where they are too few, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\r\n\r\n\r\n\r\n"


class ArchiveWriter:
    """Writes records to archives in a folder and begins a new archive beyond a size."""

    def __init__(self, folder: str, name: str, archive_mb: int):
        self.folder, self.name, self.limit = folder, name, archive_mb * 1_000_000
        self.out, self.done = None, []

    def write(self, records: list[bytes], samples: int = 128) -> None:
        for r in records:
            if self.out is None:
                self.path = f"{self.folder}/{self.name}-{len(self.done)}.warc.zst"
                fs, inner = open_fs(self.path)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                self.out, self.n = fs.open_output_stream(inner, compression=None), 0
                content = dictionary_for(records[:samples])
                self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)
                self.size = 8 + len(content)
                self.codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
            frame = self.codec.compress(r)
            self.out.write(frame)
            self.n += 1
            self.size += len(frame)
            if self.size > self.limit:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.n))
            self.out = None


def write_archives(pages: DataFrame, folder: str, archive_mb: int = 32) -> DataFrame:
    """Writes pages (page_id, url, payload, digest, refers_to); returns path and number of records of each archive.
    Only archives of tasks that succeeded are in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"pages-{task.partitionId()}-{task.taskAttemptId()}-{uuid4().hex}", archive_mb)
        for batch in pieces(batches, column="payload"):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))
            writer.write([record(*x) for x in zip(*columns)])
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in writer.done], pa.string()), pa.array([n for _, n in writer.done], pa.int64())], ["path", "records"])

    return stored(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"), "warc-manifest")


def frame_length(data: memoryview) -> int:
    """Bytes of the zstd frame at the beginning of data, 0 if data ends before it does."""
    if len(data) < 6:
        return 0
    if int.from_bytes(data[:4], "little") != FRAME_MAGIC:
        raise ValueError("no zstd frame")
    flags = data[4]
    single = flags >> 5 & 1
    at = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        if at + 3 > len(data):
            return 0
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            at += 4 * (flags >> 2 & 1)
            return at if at <= len(data) else 0


def frames(stream, chunk: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record of an archive, read in chunks."""
    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    content = stream.read(int.from_bytes(head[4:], "little"))
    end = 8 + len(content)
    if int.from_bytes(content[:4], "little") == FRAME_MAGIC:  # the dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    offset, data, at = end, b"", 0
    while True:
        size = frame_length(memoryview(data)[at:])
        if size == 0:
            more = stream.read(chunk)
            if not more:
                if at < len(data):
                    raise ValueError(f"cut off at {offset}")
                return
            data, at = data[at:] + more, 0
            continue
        yield offset, codec.decompressobj().decompress(data[at : at + size])
        at += size
        offset += size


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:40]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _sha1(digest: str | None) -> str | None:
    """The hex form of a sha1 digest in base32 or hex; None for none and for other kinds."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(content: bytes) -> dict:
    """A record's type, page_id, refers_to, payload size and payload digest, checked.

    Any record of WARC 1.0 or 1.1 is read. The payload is what follows the HTTP header of responses, requests and revisits, and the
    whole block of others; its size is that of the HTTP header's Content-Length where a revisit leaves it out. page_id and refers_to
    are null unless the ids are those of ``record``. A sha1 digest that the record gives must hold (not for revisits, whose payload
    is elsewhere); without one it is computed.
    """
    head, cut, rest = content.partition(b"\r\n\r\n")
    if not cut or head.split(b"\r\n", 1)[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields = _fields(head)
    missing = [n for n in ("warc-type", "warc-record-id", "content-length") if n not in fields]
    if missing or not fields["content-length"].isdigit():
        raise ValueError(f"no {', '.join(missing) or 'length'} in the header")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length is wrong")
    kind, block, said = fields["warc-type"].lower(), rest[:size], _sha1(fields.get("warc-payload-digest"))
    http = {}
    payload = block
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        top, cut, payload = block.partition(b"\r\n\r\n")
        if not cut:
            raise ValueError("no end of the HTTP header")
        http = _fields(top)
    stated = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    if kind == "revisit":
        if "warc-profile" not in fields:
            raise ValueError("a revisit without a profile")
        payload_bytes, digest = stated if not payload else len(payload), said
    else:
        payload_bytes, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if said not in (None, digest) or (kind == "response" and stated != payload_bytes and "transfer-encoding" not in http):
            raise ValueError("the payload is not what its headers say")
    block_digest = _sha1(fields.get("warc-block-digest"))
    if block_digest not in (None, hashlib.sha1(block).hexdigest()):
        raise ValueError("the block is not what its digest says")

    def number(v: str | None) -> int | None:
        own = (v or "").strip("<>")
        tail = own.removeprefix(PAGE_URN) if own.startswith(PAGE_URN) else ""
        return int(tail) if tail.lstrip("-").isdigit() else None

    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": payload_bytes, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to"))}


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record of the archives (path, records): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, inner = open_fs(path)
                got, found = 0, []
                with fs.open_input_stream(inner, compression=None) as stream:
                    for offset, content in frames(stream):
                        try:
                            found.append(parse(content))
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"{path}, offset {offset}: {e}") from e
                        got += 1
                        if len(found) >= 10_000:
                            yield pa.RecordBatch.from_pylist(found, fields)
                            found = []
                if got != expected:
                    raise ValueError(f"{path}: {got} records, not {expected}")
                yield pa.RecordBatch.from_pylist(found, fields)

    return manifest.repartition("path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """op8: archives of pages (page_id, url, html), read back."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    full = full.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # each page once per id and digest on the right side, so no row of the left side is lost or doubled
    linked = full.join(revisits(full), ["page_id", "digest"], "left")
    return read_archives(write_archives(linked, shared_dir(pages.sparkSession, "warc")))


#: DuckDB SQL for ``round_trip``.
ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n >= 1000) END AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM g"""
