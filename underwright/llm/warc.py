"""WARC archives: written as monolithic gzip streams, normalised to one member per record with an offset index, read back.

A monolithic archive is one gzip stream, so no record can be read without all before it. The normaliser inflates each file
once, record by record, rewrites every record as a gzip member of its own and writes a sidecar with the offset and
length of each. Readers then seek to single members.

Files go through ``pyarrow.fs`` to the shared folder under names that no other attempt uses; a file counts only if its name
is in the table that the finished task returned, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import join_groups, stored, text_or_empty
from underwright.session import scratch_path

#: A new archive begins after so many bytes of records.
FILE_BYTES = 128 << 20
CHUNK = 1 << 20
#: Revisits (id, digest and id: about 100 bytes each) that may be broadcast.
BROADCAST_REVISITS = 100_000
LEVEL = 2
GZIP = 31  # zlib's window bits for a gzip header
#: The pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
FILES = "file string, records long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(uri: str, mode: str):
    system, path = pafs.FileSystem.from_uri(uri)
    if mode == "read":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def delete(uri: str) -> None:
    """Remove a folder that has no reader left, where there is one."""
    system, path = pafs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type != pafs.FileType.NotFound:
        system.delete_dir(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload. The HTTP header tells the full length of the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines.decode().split("\r\n")[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            length = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < length:
                break
            yield bytes(held[:length])
            del held[:length]
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(file) -> Iterator[bytes]:
    inflate = zlib.decompressobj(GZIP)
    while data := file.read(CHUNK):
        while data:
            yield inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
    yield inflate.flush()


def parsed(data: bytes) -> tuple:
    """A row of the result from one record; a response's digest is computed from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    kind, number = own["warc-type"], lambda name: None if name.endswith(":null>") else int(name[len("<urn:page:") : -1])
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != own["warc-payload-digest"]:
            raise ValueError(f"digest of {own['warc-record-id']} doesn't match its payload")
        return number(own["warc-record-id"]), len(payload), digest, kind, None
    return number(own["warc-record-id"]), int(headers(http)["content-length"]), own["warc-payload-digest"][5:], kind, number(own["warc-refers-to"])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives of one gzip stream each; returns (file, records)."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, size, count, name = None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None:
                    name, deflate = f"{folder}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, wbits=GZIP)
                    sink, size, count = opened(name, "write"), 0, 0
                data = record(page_id, url, html.encode(), refers_to)
                sink.write(deflate.compress(data))
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    sink.write(deflate.flush())
                    sink.close()
                    sink = None
                    yield _rows([(name, count)], FILES)
        if sink is not None:
            sink.write(deflate.flush())
            sink.close()
            yield _rows([(name, count)], FILES)

    return rows.mapInArrow(written, FILES)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive as one gzip member per record, with a sidecar of one JSON line per member; returns (file, records)."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("file").to_pylist():
                name, offset, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with opened(source, "read") as file, opened(name, "write") as sink, opened(name + ".idx", "write") as index:
                    for data in records(inflated(file)):
                        deflate = zlib.compressobj(LEVEL, wbits=GZIP)
                        member = deflate.compress(data) + deflate.flush()
                        sink.write(member)
                        entry = {"offset": offset, "length": len(member), "id": headers(data[: data.index(b"\r\n\r\n")])["warc-record-id"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield _rows([(name, count)], FILES)

    return files.mapInArrow(rewritten, FILES)


def read_members(files: DataFrame) -> DataFrame:
    """Rows of the archives, each read at the offset that the sidecar gives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                with opened(name, "read") as file, opened(name + ".idx", "read") as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        out.append(parsed(zlib.decompress(file.read(entry["length"]), GZIP)))
                        if len(out) >= 5000:
                            yield _rows(out, SCHEMA)
                            out = []
                yield _rows(out, SCHEMA)

    return files.mapInArrow(read, SCHEMA)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, payload, first) of pages whose payload another page with a smaller id has."""
    narrow = stored(pages.select("page_id", "payload", F.octet_length("html").alias("bytes")), "warc-payloads")
    groups = narrow.where(F.col("bytes") >= min_bytes).groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("group_size"))
    joined = join_groups(narrow.select("page_id", "payload"), groups.where("group_size > 1"), ["payload"], narrow.count())
    return joined.where("first IS NOT NULL AND NOT (page_id <=> first)").select("page_id", "payload", "first").distinct()


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write all pages as normalised archives; returns (rows read back, archive files).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response, the others revisit it.
    Rows with the same id and payload have the same type. A null id is never the smallest; null html is an empty payload,
    a null url becomes ``urn:page:<id>``. Other columns aren't read, an empty table gives an empty result. Up to ``BROADCAST_REVISITS`` revisits
    meet the pages without a shuffle of html; more of them are joined by id and payload. The monolithic archives are deleted when the others are written.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html")).withColumn("payload", F.unhex(F.sha2("html", 256)))
    again = stored(revisits(pages, min_bytes), "warc-revisits").withColumnsRenamed({"page_id": "_id", "payload": "_payload"})
    again = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    rows = pages.join(again, pages["page_id"].eqNullSafe(again["_id"]) & (pages["payload"] == again["_payload"]), "left")
    folder = scratch_path(pages.sparkSession, "llm-warc")
    one_stream = stored(write_monolithic(rows.select("page_id", "url", "html", F.col("first").alias("refers_to")), f"{folder}/streams"), "warc-streams")
    members = stored(normalise(by_file(one_stream), f"{folder}/members"), "warc-members")
    delete(f"{folder}/streams")  # all that follows reads the members
    return read_members(by_file(members)), members


def by_file(files: DataFrame) -> DataFrame:
    """About one task for each archive."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
