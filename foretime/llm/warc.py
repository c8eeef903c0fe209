"""WARC archives written from pages and read back by their index.

The index comes first: writing a record notes its file, offset, length, URL and
digest, and every later read goes through these rows. Selected records are sorted
by file and offset, ranges that lie close together become one read of bounded
size, and each record is its own gzip member, so a range needs nothing before it.

Payloads of at least ``least`` bytes that are equal are stored once, as the response
of the largest page id; the other pages become revisit records that refer to it.

Cases: a null page is an empty payload, which is always a response; null ids count
below all others; rows equal in id and payload are stored alike; a null URL is an
empty one; line breaks in URLs are percent-encoded; an empty table gives no files.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import new_folder, open_folder, rows_of, stored, with_text, write_file

#: Bytes of compressed records per archive, per read, and skipped rather than read apart.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
#: Fixed texts of the format.
RESPONSE_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HTTP_TYPE = "application/http; msgtype=response"
FIXED_DATE = "1970-01-01T00:00:00Z"


def classified(pages: DataFrame, page_id: str, html: str, least: int) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest and ``home``, the page that holds an equal payload."""
    rows = pages.withColumn("payload_bytes", F.coalesce(F.octet_length(html), F.lit(0)).cast("long")).withColumn(
        "payload_digest", F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")))
    shared = (rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"))
              .agg(F.max(page_id).alias("home"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return rows.join(shared, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")), "left").drop("_d", "_b")


def record(kind: str, record_id: str, url: str, payload: bytes, n: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", f"Content-Type: {HTTP_TYPE}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {RESPONSE_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    text = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    return gzip.compress(text + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000,
                   date: str = FIXED_DATE) -> tuple[str, DataFrame]:
    """Write all pages; the folder and its stored index: (file, offset, length, id, url, digest, record_type)."""
    pages = with_text(with_text(pages, html), url).select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    folder = new_folder(pages.sparkSession, "warc")
    kind = pages.schema["id"].dataType.simpleString()
    rows = classified(pages, "id", "html", least).select(
        "id", F.col("id").cast("string").alias("name"), "url", "html", "payload_bytes", "payload_digest",
        F.when(~F.col("home").eqNullSafe(F.col("id")) & F.col("home").isNotNull(), F.col("home").cast("string")).alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        members: list[bytes] = []
        index: list[tuple] = []
        kept: list[pa.Array] = []

        def close() -> pa.RecordBatch:
            nonlocal n, size
            name = write_file(folder, f"pages-{part:05d}-{n:05d}.warc.gz", b"".join(members))
            ids = pa.concat_arrays(kept)
            files = pa.array([name] * len(index))
            out = pa.RecordBatch.from_arrays(
                [files, *[pa.array(c, t) for c, t in zip(zip(*[x[:2] for x in index]), (pa.int64(), pa.int64()))], ids,
                 *[pa.array(c, pa.string()) for c in zip(*[x[2:] for x in index])]], names=["file", "offset", "length", "id", "url", "digest", "record_type"])
            n, size = n + 1, 0
            members.clear(), index.clear(), kept.clear()
            return out

        for b in batches:
            first = 0
            for i, (name, link, page, length, digest, home) in enumerate(rows_of([b], "name", "url", "html", "payload_bytes", "payload_digest", "refers_to")):
                kind_ = "revisit" if home is not None else "response"
                link = (link or "").replace("\r", "%0D").replace("\n", "%0A")
                member = record(kind_, name or "", link, (page or "").encode("utf-8", "surrogatepass"), length, digest, home, date)
                index.append((size, len(member), link, digest, kind_))
                members.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    kept.append(b.column("id").slice(first, i + 1 - first))
                    first = i + 1
                    yield close()
            kept.append(b.column("id").slice(first))
        if index:
            yield close()

    index = stored(rows.mapInArrow(archives, f"file string, offset long, length long, id {kind}, url string, digest string, record_type string"), "warc-index")
    return folder, index


def ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (file, offset, length, ...) in order, as groups that one read serves."""
    group: list[tuple] = []
    for r in rows:
        if group and (r[0] != group[0][0] or r[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or r[1] + r[2] - group[0][1] > READ_BYTES):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def read_records(folder: str, selected: DataFrame) -> DataFrame:
    """Records that rows of the index select: (id, url, record_type, refers_to, payload,
    payload_bytes, payload_digest), where a revisit has no payload of its own.

    Each response's digest is taken from the bytes read and must be the one noted."""
    kind = selected.schema["id"].dataType.simpleString()
    parts = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = selected.select("file", "offset", "length", "id").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for b in batches:
            rows = [(*r, i) for i, r in enumerate(rows_of([b], "file", "offset", "length"))]
            for group in ranges(rows):
                with store.open_input_file(f"{path}/{group[0][0]}") as f:
                    first = group[0][1]
                    data = f.read_at(group[-1][1] + group[-1][2] - first, first)
                out = []
                for _, offset, length, _ in group:
                    fields, payload = parse(data[offset - first:offset - first + length])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{group[0][0]} at {offset}: payload and digest differ")
                    to = fields.get("WARC-Refers-To")
                    out.append((fields["WARC-Target-URI"], fields["WARC-Type"], to[len("<urn:page:"):-1] if to else None, payload if fields["WARC-Type"] == "response" else None,
                                int(fields["X-Payload-Length"]), digest))
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(group[0][3], len(group)), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]],
                    names=["id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])

    return ordered.mapInArrow(read, f"id {kind}, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")
