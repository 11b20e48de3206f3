"""WARC archives, index first.

Each archive starts with a warcinfo record. Writers lay records down one gzip member each, so a record can be read alone, and return an index row (file,
offset, length, URL, digest) per record. Readers sort the selected index rows by place, join neighbouring byte
ranges and read each range once. File names hold a token of the task attempt; only files that the committed
index names are read, so an attempt that was lost leaves nothing that counts.

Defined results: null html is an empty payload, null urls are written as urn:page, equal payloads below
MIN_BYTES are stored again, rows that repeat the smallest page_id of a payload are responses all, null
page_ids are never referred to unless no other holds the payload, an empty table gives an empty archive. A record's
id is made of page_id, digest and place, so it is unique; a revisit refers to page_id and digest.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MIN_BYTES = 100
FILE_BYTES = 64 << 20
#: Byte ranges this near are read in one go, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Capture time of all records: the pages have none, and reruns are to agree.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


#: Parts that the pages of one payload are dealt into where they meet its first page_id.
SALTS = 16


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for records that carry their payload.

    Pages meet the first page_id of their payload by digest and a part of SALTS, and only payloads that occur twice go
    into the join; what is joined back is keyed by page_id too. So a payload that a third of the pages share meets no single task.
    """
    html = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    slim = full.where(F.octet_length("html") >= MIN_BYTES).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = store.saved(firsts.drop("n"), "payloads")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = store.saved(again.select("page_id", "digest", F.col("first").alias("refers_to")), "revisits")
    keyed = again.withColumnsRenamed({"page_id": "p", "digest": "d"})
    return full.join(keyed, full["page_id"].eqNullSafe(keyed["p"]) & (full["digest"] == keyed["d"]), "left").drop("p", "d")


#: Schemes that Spark and pyarrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "file": "file", "s3": "s3"}


def store_of(directory: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a directory that Spark names."""
    scheme, found, rest = directory.partition(":")
    if scheme == "dbfs" and found:
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if found and scheme not in SCHEMES:
        raise ValueError(f"archives can't be written to {scheme}: none of {sorted([*SCHEMES, 'dbfs'])}")
    return fs.FileSystem.from_uri(SCHEMES[scheme] + found + rest if found else directory)


def info(name: str) -> bytes:
    """The warcinfo record that an archive starts with."""
    body = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, place: str) -> str:
    return f"<urn:page:{page_id}:{digest[:16]}:{place}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, place: str = "", size: int | None = None) -> bytes:
    """A WARC/1.1 response, or a revisit of the record with the id refers_to, of a payload of some size."""
    size = len(payload) if size is None else size
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    body = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, digest, payload_bytes, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of the wrong length: {fields['WARC-Record-ID']}")
    name = lambda x: None if x is None or x.split(":")[2] == "None" else int(x.split(":")[2])
    out = {"page_id": name(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": name(fields.get("WARC-Refers-To")), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    out["payload_bytes"] = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    out["payload"] = None if out["record_type"] == "revisit" else payload
    if out["payload"] is not None and (len(payload) != out["payload_bytes"] or hashlib.sha256(payload).hexdigest() != out["digest"]):
        raise ValueError(f"payload damaged: {fields['WARC-Record-ID']}")
    return out


def _place(file: str, offset: int) -> str:
    return f"{file[:16]}:{offset}"


def write_archives(pages: DataFrame, directory: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows of with_revisits() as archives into a shared directory and returns their index, saved: responses
    first, then revisits, which know by the index of those which record they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        where, base = store_of(directory)
        where.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = where.open_output_stream(f"{base}/{name}", compression=None)
                    head = gzip.compress(info(name), 3, mtime=0)
                    sink.write(head)
                    at = len(head)
                payload = (row.get("html") or "").encode()
                data = gzip.compress(record(row["page_id"], row["url"], payload, row["digest"], row.get("ref"), _place(name, at), row.get("size")), 3, mtime=0)
                sink.write(data)
                index.append((name, at, len(data), row["url"], row["digest"], row["page_id"], "revisit" if row.get("ref") else "response"))
                at += len(data)
            yield pa.RecordBatch.from_pylist([dict(zip(INDEX_SCHEMA.names, x)) for x in index], schema=INDEX_SCHEMA)
        if sink is not None:
            sink.close()

    first = store.saved(pages.where("refers_to is null").select("page_id", "url", "html", "digest").mapInArrow(run, INDEX), "warc-index")
    again = pages.where("refers_to is not null").select("page_id", "url", F.octet_length("html").alias("size"), "digest", "refers_to")
    wanted = store.saved(again.select("refers_to", "digest").distinct(), "warc-referred").withColumnsRenamed({"refers_to": "page_id"})
    places = first.select("page_id", "digest", "file", "offset").join(wanted, ["page_id", "digest"], "left_semi")
    places = places.groupBy("page_id", "digest").agg(F.min(F.struct("file", "offset")).alias("at"))
    ref = F.format_string("<urn:page:%d:%s:%s:%d>", "page_id", F.substring("digest", 1, 16), F.substring("at.file", 1, 16), "at.offset")
    places = places.select(F.col("page_id").alias("refers_to"), "digest", ref.alias("ref"))
    salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = again.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["refers_to", "digest", "salt"])
    second = store.saved(again.select("page_id", "url", "size", "digest", "ref").mapInArrow(run, INDEX), "warc-index")
    return first.unionAll(second)


INDEX_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, from, to, records) for records (file, offset, length) sorted by place: near ones are joined."""
    file, start, end, held = None, 0, 0, []
    for f, offset, length in rows:
        if f != file or offset - end > GAP_BYTES or offset + length - start > READ_BYTES:
            if held:
                yield file, start, end, held
            file, start, end, held = f, offset, offset, []
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, directory: str) -> DataFrame:
    """The records that index rows name, each parsed and its payload's digest verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store_of(directory)
        opened: dict = {}
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for file, start, end, held in ranges(places):
                if file not in opened:
                    for x in opened.values():
                        x.close()
                    opened = {file: where.open_input_file(f"{base}/{file}")}
                data = opened[file].read_at(end - start, start)
                found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in held]
                yield pa.RecordBatch.from_pylist(found, schema=RECORD_SCHEMA)

    span = F.floor(F.col("offset") / READ_BYTES)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartition(n, "file", span).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)
