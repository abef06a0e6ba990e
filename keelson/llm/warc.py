"""WARC records in ZIP packages, written and read by ranges.

A package is a ZIP file with stored members: gzip-per-record WARC files under
``archive/`` and one index of JSON lines under ``indexes/``. The reader parses
the end record, the ZIP64 end record and the central directory, finds where
the members' bytes begin, reads the index, and fetches single records by
range; nothing is ever extracted.

Of records with equal payloads of at least ``least`` bytes, the one with the
largest id is a response and the others are revisits that refer to it.

Every writing attempt makes a package of its own name, and only the packages
named in the committed manifest are read, so lost executors and repeated tasks
do no harm. Packages are written to the folder that all executors share.

Defined results: null html is an empty payload; a null URL has no target; rows
that repeat the largest id of a group are all responses; a null id counts as
smallest and is never referred to unless alone with null ids (then all are
responses); an empty table makes no package; a page of any length is one
record; columns beyond id, URL and html do not matter, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

INDEX = "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: ZIP signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the payload after the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class Package:
    """A ZIP file read by ranges."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (method, place of the local header, size)."""
        back = min(self.size, 65557)
        tail = self.read(self.size - back, back)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        where = self.size - back + at
        if where >= 20 and (locator := self.read(where - 20, 20))[:4] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record64 = self.read(end64, 56)
            if record64[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record64, 32)
        raw, at, members = self.read(start, length), 0, {}
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("bad central directory")
            method, packed, size, n_name, n_extra, n_comment = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20)
            (local,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = self._zip64(extra)
            if size == 0xFFFFFFFF:
                size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if packed == 0xFFFFFFFF:
                packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if local == 0xFFFFFFFF:
                local = struct.unpack_from("<Q", wide)[0]
            members[name] = (method, local, packed)
            at += 46 + n_name + n_extra + n_comment
        return members

    @staticmethod
    def _zip64(extra: bytes) -> bytes:
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                return extra[4 : 4 + n]
            extra = extra[4 + n :]
        return b""

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        method, local, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        header = self.read(local, 30)
        if header[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return local + 30 + n_name + n_extra, size


def write_package(stream, rows, member_bytes: int = 1 << 28) -> int:
    """Writes (page_id, url, payload, digest, refers_to) rows to a stream; returns their number."""
    index: list[bytes] = []
    rows = iter(rows)
    row = next(rows, None)
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as package:
        member = 0
        while row is not None:
            name, at = f"archive/data-{member:05d}.warc.gz", 0
            with package.open(name, "w", force_zip64=True) as out:
                while row is not None and at < member_bytes:
                    packed = gzip.compress(record(*row), 6, mtime=0)
                    out.write(packed)
                    index.append(json.dumps({"id": row[0], "member": name, "offset": at, "length": len(packed)}).encode() + b"\n")
                    at += len(packed)
                    row = next(rows, None)
            member += 1
        with package.open(INDEX, "w", force_zip64=True) as out:
            out.writelines(index)
    return len(index)


def plan_revisits(pages: DataFrame, space: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(id, url, html, digest, refers_to) of each page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.sha1("html")).withColumn("large", F.octet_length("html") >= least)
    # written, so that the join can split a digest that a third of all rows have
    last = space.keep(rows.filter("large").groupBy(F.col("digest").alias("_digest")).agg(F.max("id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "last")
    joined = rows.join(last, (F.col("digest") == F.col("_digest")) & F.col("large"), "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("id", "url", "html", "digest", refers.alias("refers_to"))


def write(planned: DataFrame, root: str) -> DataFrame:
    """Writes one package per partition below ``root``; returns (path, size, records)."""

    def run(batches):
        rows = ((i, u, h.encode("utf-8", "surrogatepass"), d, r) for b in batches for i, u, h, d, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        store, inner = open_fs(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner) as stream:
            n = write_package(stream, (x for part in ([first], rows) for x in part))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([store.get_file_info(inner).size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return planned.mapInArrow(run, "path string, size long, records long")


def read_index(manifest: DataFrame, chunk: int = 512) -> DataFrame:
    """(path, at, length) of runs of records, by the packages' own indexes."""

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = open_fs(path)
                with store.open_input_file(inner) as file:
                    package = Package(file, size)
                    begin, n = package.place(INDEX)
                    entries = [json.loads(x) for x in package.read(begin, n).splitlines()]
                    places = {m: package.place(m)[0] for m in {e["member"] for e in entries}}
                ats, lengths = [places[e["member"]] + e["offset"] for e in entries], [e["length"] for e in entries]
                cuts = range(0, len(ats), chunk)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cuts)), pa.array([ats[i : i + chunk] for i in cuts], pa.list_(pa.int64())), pa.array([lengths[i : i + chunk] for i in cuts], pa.list_(pa.int64()))], ["path", "at", "length"])

    return manifest.select("path", "size").mapInArrow(run, "path string, at array<long>, length array<long>")


def read_records(index: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record, fetched by its range; digests and sizes are those of the bytes read."""

    def run(batches):
        for batch in batches:
            for path, ats, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                store, inner = open_fs(path)
                with store.open_input_file(inner) as file:
                    for at, n in zip(ats, lengths, strict=True):
                        file.seek(at)
                        headers, payload = parse_record(gzip.decompress(file.read(n)))
                        response = headers["warc-type"] == "response"
                        rows.append((_page(headers["warc-record-id"]), headers["warc-type"], _page(headers.get("warc-refers-to")), len(payload) if response else None, hashlib.sha1(payload).hexdigest() if response else headers["warc-payload-digest"].removeprefix("sha1:")))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return index.mapInArrow(run, "id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def _page(uri: str | None) -> int | None:
    return int(x) if uri and (x := uri.removeprefix("<urn:page:").removesuffix(">")) != "None" else None


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Writes the pages to packages and reads all records back."""
    space = Workspace(pages.sparkSession, "warc")
    manifest = space.keep(write(plan_revisits(pages, space, id_col, url_col, html_col, least), f"{space.path}/packages"), "manifest")
    width = max(1, manifest.count()) * 2
    records = space.keep(read_records(read_index(manifest).repartition(width)), "records")
    # an id may have several payloads, so a revisit's is told by the digest as well
    whole = space.keep(records.filter("record_type = 'response' and id is not null").groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes")), "whole")
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").withColumn("payload_bytes", F.col("_bytes")).select(responses.columns)
    return responses.unionByName(revisits).select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
