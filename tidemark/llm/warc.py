"""WARC archives, index first: records are found and read by an index of byte ranges.

Writing. Each task writes its pages into one archive in the shared folder and returns an index row per record: file, offset,
length, URL and digest. A record is a gzip member of its own, so that its byte range can be read without the others. Archives are written under another name and moved when whole. A task that runs again writes another file,
and only the index that is kept names files, so nothing is read twice or missed.

Equal payloads. Of records with equal payloads of at least ``least`` bytes the one with the largest page id is a response with the
payload; the others are revisit records that refer to it. The page table meets the (narrow) table of repeated payloads under a salt,
so that a payload shared by many pages does not land in one task. Payloads are equal if SHA-1 and length are.

Reading. Selected index rows are dealt by file and stretch of ``stretch`` bytes to as many tasks as their lengths have stretches, and
sorted by offset; neighbouring ranges with gaps of up to ``gap`` bytes are read as one, up to a stretch at a time. A response whose payload does not have its digest is an error.

Defined cases. A null html is an empty payload, a null URL an empty one; URLs are percent-encoded, so that no line break gets into
a header. A page without an id is always a response and nothing refers to it; rows that repeat the largest id are responses, all of
them. An empty table writes nothing and gives an empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, put_file, shared_folder, stored

LEAST = 1000
STRETCH = 4 << 20
GAP = 1 << 16
SALTS = 32
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"  # the page table has no time of capture
INDEX = "page_id bigint, url string, digest string, type string, file string, offset bigint, length bigint"
_SAFE = "%:/?#[]@!$&'()*+,;=-._~"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``, as bytes."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
        ]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")

    def page(value: str | None) -> int | None:
        name = (value or "none").rpartition(":")[2].rstrip(">")
        return None if name == "none" else int(name)

    return page(warc["warc-record-id"]), int(_headers(http)["content-length"]), digest, warc["warc-type"], page(warc.get("warc-refers-to")), payload


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to) of every page."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumns({"_size": F.octet_length("html"), "_digest": F.sha1("html"), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    repeated = (
        rows.where(F.col("_size") >= least).groupBy("_digest", "_size")
        .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _largest is not null").drop("_n")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    refers = F.when(F.col("page_id") != F.col("_largest"), F.col("_largest"))
    return rows.join(repeated, ["_digest", "_size", "_salt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the archives; the index of their records, kept in the shared folder."""

    def run(batches):
        target = posixpath.join(folder, f"{uuid.uuid4().hex}.warc.gz")
        rows: list[tuple] = []

        def fill(out):
            offset = 0
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode()
                    # without a time, equal records are equal bytes
                    data = gzip.compress(record(page_id, url, payload, refers_to), LEVEL, mtime=0)
                    out.write(data)
                    rows.append((page_id, url, hashlib.sha1(payload).hexdigest(), "response" if refers_to is None else "revisit", target, offset, len(data)))
                    offset += len(data)

        first = next(batches, None)
        if first is None:
            return
        kept, rest = [first], batches

        def chain():
            while kept:
                yield kept.pop()
            yield from rest

        batches = chain()
        put_file(target, fill)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["page_id", "url", "digest", "type", "file", "offset", "length"]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return stored(with_revisits(pages, least).select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, stretch: int = STRETCH) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, offset, length): sorted ranges joined into reads of up to about ``stretch`` bytes."""
    out, first = [], 0
    for i in range(1, len(ranges) + 1):
        end = ranges[i - 1][0] + ranges[i - 1][1]
        if i == len(ranges) or ranges[i][0] - end > gap or ranges[i][0] + ranges[i][1] - ranges[first][0] > stretch:
            out.append((first, i, ranges[first][0], end - ranges[first][0]))
            first = i
    return out


def read(index: DataFrame, stretch: int = STRETCH, gap: int = GAP, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``index``; with payloads on request."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + payloads]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payloads]

    def run(batches):
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            start = 0
            while start < len(files):
                end = start
                while end < len(files) and files[end] == files[start]:
                    end += 1
                store, path = filesystem(files[start])
                with store.open_input_file(path) as archive:
                    ranges = list(zip(offsets[start:end], lengths[start:end], strict=True))
                    for a, b, offset, length in coalesced(ranges, gap, stretch):
                        archive.seek(offset)
                        data = archive.read(length)
                        found = [parse(gzip.decompress(data[o - offset : o - offset + n]))[: 5 + payloads] for o, n in ranges[a:b]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                start = end

    # the index is tiny beside what its rows stand for, so its own size must not decide the number of tasks
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // stretch
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to the shared folder and read all records back."""
    return read(write(pages, shared_folder(pages.sparkSession, "warc"), least))
