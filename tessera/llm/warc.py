"""Web archives: a deterministic sharded WARC writer with revisit records, and the reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .frames import by_bucket, id_ranges, parts, range_of, settle
from .store import Atomic, opened

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
MANIFEST = "bucket long, file string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, position long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, url: str, payload_digest: str) -> str:
    """A record's name follows from its page: equal inputs give equal archives."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page} {url if page is None else ""} {payload_digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def clean(url: str | None) -> str:
    return " ".join((url or "").split())


def page_record(page: int | None, url: str | None, html: str | None, refers_to: int | None, date: str, level: int) -> bytes:
    payload = (html or "").encode()
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = clean(url)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, target, own)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", target)] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("X-Page-ID", str(page))] if page is not None else []),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, "", own)), ("X-Refers-To-Page-ID", str(refers_to))]
    return member([*headers, ("Content-Type", "application/http;msgtype=response")], block, level)


def written(batches: Iterator[pa.RecordBatch], folder: str, most: int, date: str, level: int) -> Iterator[pa.RecordBatch]:
    """Archives of rows (bucket, page_id, kind, key, refers_to, url, html) in order; the rows of kind 0 say which pages are revisits."""
    out, now, number, records, sha, done = None, None, 0, 0, hashlib.sha1(), []
    who: dict[str, int] = {}
    last_page: object = ()

    def close() -> None:
        nonlocal out
        if out is not None:
            done.append((now, out.commit(), records, out.size, sha.hexdigest()))
            out = None

    for batch in batches:
        for bucket, page, kind, key, refers_to, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != now:
                close()
                now, number = bucket, 0
            if page != last_page:
                who, last_page = {}, page
            if kind == 0:
                who[key] = refers_to
                continue
            target = who.get(hashlib.sha256((html or "").encode()).hexdigest()) if who else None
            data = page_record(page, url, html, target, date, level)
            if out is not None and out.size + len(data) > most:
                close()
            if out is None:
                name = f"pages-{bucket:06d}-{number:05d}.warc.gz"
                out, number, records, sha = Atomic(f"{folder}/{name}"), number + 1, 0, hashlib.sha1()
                info = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
                head = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE_ID, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, level)
                out.write(head)
                sha.update(head)
            out.write(data)
            sha.update(data)
            records += 1
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["bucket", "file", "records", "bytes", "sha1"])
            done.clear()
    close()
    if done:
        yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["bucket", "file", "records", "bytes", "sha1"])


def write_archive(pages: DataFrame, folder: str, least_revisit: int = 0, most: int = 1 << 28, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) to WARC files in `folder`; their manifest.

    Of records with equal payloads of at least `least_revisit` bytes that with the largest page_id is a response, the
    others are revisits of it. Records are in order of page_id: ranges of ids of nearly equal counts go to tasks, each
    range starts a file and rolls to the next before `most` compressed bytes. Headers and digests are made anew from
    the rows, each record is a gzip member, and equal tables and settings give equal files. Files get their names when
    whole; then manifest.json, renamed last, commits the archive. Payloads move once; which pages are revisits is found
    on digests, counted before they move, by a merge join that splits hot digests.

    Defined results: a null html is an empty payload; a very long one is one record, and a file of its own if it is
    larger than `most`; a null url has no target; pages without a page_id come first, in files of their own by a hash of
    the payload, and are responses only if no equal payload has an id; rows that agree in page_id and payload are of one
    type; an empty table makes an archive without files. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    light = settle(pages.select("page_id", F.sha2(html, 256).alias("key"), F.octet_length(html).alias("size")))
    groups = light.where(F.col("size") >= least_revisit).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    refs = light.join(groups.select("key", "refers_to").hint("merge"), "key")  # a merge join, in which hot keys are split
    refs = refs.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()
    total, known = light.agg(F.count(F.lit(1)), F.count("page_id")).first()
    most_rows = max(64, total // (2 * parts(spark)) + 1)
    bounds = id_ranges(light, "page_id", most_rows)
    loose = -(-(total - known) // most_rows)  # files of pages without an id, by a hash of the payload
    bucket = range_of("page_id", bounds) + loose if bounds else F.lit(0)
    if loose:
        bucket = F.when(F.col("page_id").isNull(), F.pmod(F.hash("key"), F.lit(loose))).otherwise(bucket)
    none = F.lit(None).cast("string")
    rows = refs.select(bucket.alias("bucket"), "page_id", F.lit(0).alias("kind"), "key", "refers_to", none.alias("url"), none.alias("html"))
    every = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("key")) if loose else pages.select("page_id", "url", "html")
    rows = rows.union(every.select(bucket, "page_id", F.lit(1), none, F.lit(None).cast("long"), "url", "html"))
    order = ["bucket", F.col("page_id").asc_nulls_first(), "kind", F.xxhash64("url", "html")]
    manifest = settle(by_bucket(rows).sortWithinPartitions(*order).mapInArrow(lambda it: written(it, folder, most, date, level), MANIFEST))
    final = Atomic(f"{folder}/manifest.json")
    for row in manifest.orderBy("file").toLocalIterator():  # a line for each file
        final.write((json.dumps(row.asDict()) + "\n").encode())
    final.commit()
    return manifest


def records_of(stream, file: str, block: int = 1 << 13) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header fields, block and place of every record of a file of gzip members.

    Bytes are handed to the decoder in small blocks: what is left of one behind a record is copied for the next.
    """
    rest, offset = b"", 0
    while True:
        unpack, data, start = zlib.decompressobj(wbits=31), [], offset
        while not unpack.eof:
            chunk = rest or stream.read(block)
            rest = b""
            if not chunk:
                if data:
                    raise ValueError(f"{file}: the record at {start} is cut off")
                return
            data.append(unpack.decompress(chunk))
            rest = unpack.unused_data
            offset += len(chunk) - len(rest)
        whole = b"".join(data)
        head, _, body = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])], start


def read_back(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, path = opened(folder)
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            with files.open_input_stream(f"{path}/{file}", compression=None, buffer_size=1 << 20) as stream:
                for fields, block, at in records_of(stream, file):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != own):
                        raise ValueError(f"{file}: the record at {at} does not have its digest")
                    numbers = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    rows.append((numbers[0], fields.get("WARC-Target-URI"), size, own, fields["WARC-Type"], numbers[1], file, at))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names=[x.split()[0] for x in RECORD.split(", ")])


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files, digests verified: RECORD's columns. Files are dealt evenly to tasks."""
    ship(manifest.sparkSession)
    return manifest.select("file").repartition(parts(manifest.sparkSession)).mapInArrow(lambda it: read_back(it, folder), RECORD)
