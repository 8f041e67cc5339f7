"""WARC files as a Spark data source, reading and writing.

Reading plans partitions of whole files (small ones together), takes predicates on the
record's header columns, parses a record's headers first, and leaves the payload of a
record that doesn't pass undecoded: an uncompressed record is seeked over, a gzip member
that carries its length (the ``sl`` extra field, which the writer sets) too. A reader with
``payload = false`` never decodes payloads. Files are opened through pyarrow's file systems.

Writing makes files of about ``FILE_BYTES`` (option ``fileBytes``) under names of their own, so no archive of its
own becomes one huge task, and lists those of each write in a ``_committed-`` file of its own: a
reader takes the union of the lists, and files of lost or failed attempts are in none.
Overwriting names the lists it replaces, so readers see the old files or the new ones, then
removes these. A folder without lists is read whole. A file of other origin is one task. A
record that is cut off at the end of a file raises an error, it never ends the file in silence.

Null target URIs have no header and are read as null; null payloads write an empty block;
records with null types are ``resource``. Folders without files give no rows. Extra columns
of the written DataFrame are refused by Spark's own schema check only if names clash.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from newsline.plans.storage import scratch, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
REVISIT_FROM = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _member(record: bytes) -> bytes:
    """A gzip member of one record with the lengths of member and record in its extra field."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.gzip, self.date = options["path"], options.get("gzip", "true") == "true", options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite, self.file_bytes = overwrite, int(options.get("filebytes", FILE_BYTES))

    def _record(self, row: dict) -> bytes:
        kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row.get('record_id') or uuid.uuid4().urn}>"), ("WARC-Date", row.get("date") or self.date)]
        if row.get("target_uri") is not None:
            fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"])))
        if row.get("payload_digest") is not None:
            fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
        if kind == "revisit":
            fields += [("WARC-Refers-To", f"<{row.get('refers_to')}>"), ("WARC-Profile", _PROFILE)]
            payload = b""
        block = payload
        if kind in ("response", "revisit"):
            size = row.get("payload_bytes")
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size) + payload
            fields.append(("Content-Type", "application/http; msgtype=response"))
        fields.append(("Content-Length", str(len(block))))
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
        return head.encode() + block + b"\r\n\r\n"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        names, out = [], None
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                    out = store.open_output_stream(f"{root}/{names[-1]}", compression=None)
                record = self._record({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)})
                out.write(_member(record) if self.gzip else record)
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = _commits(store, root) if self.overwrite else {}
        loose = [n for n in _archives(store, root) if not any(n in x["files"] for x in old.values())] if self.overwrite else []
        names = sorted(n for m in messages if m is not None for n in m.names)
        with store.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as out:
            out.write(json.dumps({"files": names, "replaces": sorted(old)}).encode())
        for name in [*old, *(n for x in old.values() for n in x["files"]), *(n for n in loose if n not in names)]:
            if store.get_file_info(f"{root}/{name}").is_file:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for name in [n for m in messages if m is not None for n in m.names]:
            store.delete_file(f"{root}/{name}")


def _archives(store: pa.fs.FileSystem, root: str) -> dict[str, pa.fs.FileInfo]:
    """The archive files of a folder by name."""
    infos = store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
    return {i.base_name: i for i in infos if i.is_file and re.search(r"\.warc(\.gz)?$", i.base_name)}


def _commits(store: pa.fs.FileSystem, root: str) -> dict[str, dict]:
    """The lists of writes that no other list replaces."""
    found = {}
    for info in store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if info.is_file and info.base_name.startswith("_committed-"):
            with store.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    gone = {n for x in found.values() for n in x["replaces"]}
    return {n: x for n, x in found.items() if n not in gone}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name in _HEADERS and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name in _HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        infos, commits = _archives(store, root), _commits(store, root)
        if commits:
            infos = {n: infos[n] for x in commits.values() for n in x["files"]}
        out, size = [], 0
        for name, info in sorted(infos.items(), key=lambda x: (x[1].size, x[0])):
            if not out or size + info.size > PARTITION_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(f"{root}/{name}")
            size += info.size
        return out or [_Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            own = _clean(name, headers.get(_HEADERS[name]))
            if own is None or (own not in value if how == "in" else not own.startswith(value)):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in (x.split()[0] for x in SCHEMA.split(", "))])
        rows, size = [], 0
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for headers, block in (_gzip_records if path.endswith(".gz") else _plain_records)(f, self._wanted, self.payload):
                    rows.append(self._row(headers, block))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, headers: dict[str, str], block: bytes) -> dict:
        row = {c: _clean(c, headers.get(h)) for c, h in _HEADERS.items()}
        digest = headers.get("warc-payload-digest")
        row["payload_digest"] = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest and digest.startswith("sha1:") else digest
        payload, row["payload_bytes"] = block, int(headers["content-length"])
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            row["payload_bytes"] = int(found[1]) if found else int(headers["content-length"]) - len(head) - 4
        row["payload"] = payload if self.payload and row["record_type"] != "revisit" else None
        return row


def _clean(column: str, value: str | None) -> str | None:
    return value[1:-1] if value is not None and column in ("record_id", "refers_to") and value[:1] == "<" else value


def _parse(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def _has_head(headers: dict[str, str], block: bytes) -> bool:
    """Whether what was read of a block holds all that a row without payload needs: the HTTP headers, if it has any."""
    return not headers.get("content-type", "").startswith("application/http") or b"\r\n\r\n" in block


def _plain_records(f, wanted, payload: bool) -> Iterator[tuple[dict, bytes]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head.lstrip(b"\r\n"):
            more = f.read(4096)
            if not more:
                if head.strip():
                    raise ValueError("a record's headers are cut off")
                return
            head += more
        blank = len(head) - len(head.lstrip(b"\r\n"))
        head = head[: head.index(b"\r\n\r\n", blank)]
        headers = _parse(head[blank:])
        begin, length = at + len(head) + 4, int(headers["content-length"])
        if begin + length > size:
            raise ValueError("a record is cut off")
        if wanted(headers):
            f.seek(begin)
            block = f.read(length) if payload else b""
            while not payload and len(block) < length and not _has_head(headers, block):
                block += f.read(min(8192, length - len(block)))
            yield headers, block
        at = begin + length


class _Member:
    """The bytes of one gzip member, unpacked as they are asked for."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.unpack, self.held, self.used = f, zlib.decompressobj(31), bytearray(), 0

    def more(self) -> bool:
        """Unpack some more; False at the member's end."""
        if self.unpack.eof:
            return False
        raw = self.f.read(65536 if self.used else 16384)
        if not raw:
            raise ValueError("a record is cut off")
        self.used += len(raw)
        self.held += self.unpack.decompress(raw)
        return True

    def headers(self) -> dict[str, str] | None:
        """The next record's headers; None if there is no further record."""
        while True:
            del self.held[: len(self.held) - len(self.held.lstrip(b"\r\n"))]
            if self.held or not self.more():
                break
        if not self.held:
            return None
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record's headers are cut off")
        found = _parse(bytes(self.held[:end]))
        del self.held[: end + 4]
        if "content-length" not in found:
            raise ValueError("a record is cut off")
        return found

    def block(self, length: int, enough) -> bytes:
        """Pass over a record's block; what is given back goes on until ``enough`` says so, the rest is not kept."""
        kept = bytearray()
        while length:
            if not self.held and not self.more():
                raise ValueError("a record is cut off")
            part = self.held[:length]
            if not enough(kept):
                kept += part
            length -= len(part)
            del self.held[: len(part)]
        return bytes(kept)

    def end(self) -> int:
        """How long the packed member is, once it is read to its end."""
        return self.used - len(self.unpack.unused_data)


def _gzip_records(f, wanted, payload: bool) -> Iterator[tuple[dict, bytes]]:
    """Records of any number of members: own members hold one record and say how long they are, so unwanted payloads aren't unpacked; others are read through, whatever records they hold."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        front = f.read(20)
        known = struct.unpack("<I", front[16:20])[0] if front[3:4] == b"\x04" and front[12:14] == b"sl" else 0
        if at + known > size:
            raise ValueError("a record is cut off")
        member = _Member(f, at)
        while (headers := member.headers()) is not None:
            keep = wanted(headers)
            if known and not keep:
                break
            whole = lambda kept: not keep or (not payload and _has_head(headers, kept))  # noqa: B023, E731
            block = member.block(int(headers["content-length"]), whole)
            if keep:
                yield headers, block
            if known:
                break
        at += known or member.end()


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, smallest: int = REVISIT_FROM) -> DataFrame:
    """Records of (page_id, url, html): of equal payloads of ``smallest`` bytes or more only that of the largest page_id is kept whole.

    Payloads are equal if length, SHA-1 and SHA-256 are. Only ids and digests are grouped; the
    html moves once, by page_id. A null html is an empty payload; rows with a null page_id
    or repeated rows of one page are responses unless another page has the payload.
    """
    records = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    light = records.select("page_id", F.sha1("payload").alias("d"), F.sha2("payload", 256).alias("e"), F.octet_length("payload").alias("n")).where((F.col("n") >= smallest) & F.col("page_id").isNotNull())
    first = light.groupBy("d", "e", "n").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = light.join(first, ["d", "e", "n"]).where("page_id != original").select("page_id", "original").distinct()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return records.join(revisits.hint("shuffle_hash"), "page_id", "left").select(
        F.coalesce(urn("page_id"), F.lit("urn:page:")).alias("record_id"), F.when(F.col("original").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), F.sha1("payload").alias("payload_digest"), urn("original").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("original").isNull(), F.col("payload")).alias("payload"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, reads the archives, and reports each page from what was read."""
    register(spark)
    path = scratch(spark, "warc")
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return back.select(
        number("record_id").alias("page_id"), F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS original, count(*) AS copies FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN copies > 1 AND page_id != original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND page_id != original THEN original END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
