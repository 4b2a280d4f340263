"""WARC records as a table of chunks.

A record is a run of rows (record, chunk_no): its bytes, header first, are cut into chunks of bounded size, so that no
step after the source row holds a payload as a whole. Each chunk carries the SHA-1 of the payload up to its end, which
the reader follows chunk by chunk. Records of one chunk are read where they lie; only longer ones are dealt out by
record and put in chunk order before they are read. The chunks of all records, in order, are a WARC 1.1 file.

Of records with equal payloads of MIN_SHARED bytes or more, that with the largest page_id is a response, the others
revisit it and hold no payload; smaller ones are all responses.

Defined results: a null html is an empty payload, a null url an empty target; a null page_id makes a response of its
own; rows that repeat the largest page_id are all responses; other columns are not read. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checked, save, table

#: Most bytes of a chunk; from so many bytes on equal payloads are stored once; bytes of chunks passed on at a time.
CHUNK, MIN_SHARED, FLUSH = 64 << 10, 1000, 4 << 20

ARCHIVE = "record long, chunk_no int, n_chunks int, data binary, payload_sha1 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_END = b"\r\n\r\n"


def _header(page_id, url: str, size: int, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _chunks(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], ["record", "chunk_no", "n_chunks", "data", "payload_sha1"])

        for batch in batches:
            html = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            for i in range(batch.num_rows):
                page_id, url, digest, refers_to = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                payload = memoryview(html[i].as_buffer())  # no copy
                url = "".join(x for x in url or "" if x not in "\r\n")
                stream = (memoryview(_header(page_id, url, len(payload), digest, refers_to)), payload[: len(payload) if refers_to is None else 0], memoryview(_END))
                starts = (0, len(stream[0]), len(stream[0]) + len(stream[1]))
                total, so_far = starts[2] + len(_END), sha1()
                n = -(-total // chunk)
                for c in range(n):
                    parts = [x[max(0, c * chunk - at) : max(0, (c + 1) * chunk - at)] for x, at in zip(stream, starts, strict=True)]
                    so_far.update(parts[1])
                    rows.append(((task << 36) + k, c, n, b"".join(parts), so_far.hexdigest()))
                    held += len(rows[-1][3])
                    if held >= FLUSH:
                        yield flush()
                        rows, held = [], 0
                k += 1
        if rows:
            yield flush()

    return run


def to_archive(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the archive of pages (page_id, url, html)."""
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    pages = pages.select("page_id", "url", "html", digest.alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    shared = pages.where(size >= MIN_SHARED).groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("digest", "last")
    joined = pages.join(checked(save(shared, "shared")), "digest", "left")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))
    return joined.mapInArrow(_chunks(chunk), ARCHIVE)


class _Reader:
    """Follows one record chunk by chunk; holds its header and a digest, not its payload."""

    def __init__(self):
        self.head, self.fields, self.sha, self.seen, self.left, self.intact = b"", None, sha1(), 0, None, True

    def feed(self, data: memoryview, so_far: str) -> None:
        if self.fields is None:
            self.head += bytes(data)
            a = self.head.find(_END)
            b = self.head.find(_END, a + 4) if a >= 0 else -1
            if b < 0:
                return
            lines = self.head[:a].decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"]) - (b + 4 - (a + 4))
            data, self.head = memoryview(self.head)[b + 4 :], b""
        take = data[: self.left]
        self.sha.update(take)
        self.seen += len(take)
        self.left -= len(take)
        self.intact &= self.sha.hexdigest() == so_far

    def row(self) -> tuple:
        f = self.fields
        stated = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        page = f["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
        revisit, size = f["WARC-Type"] == "revisit", int(f["X-Payload-Length"])
        refers = int(f["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")) if revisit else None
        if revisit:
            return (int(page) if page else None, f["WARC-Target-URI"], size, stated, "revisit", refers, self.intact and self.left == 0 and self.seen == 0)
        return (int(page) if page else None, f["WARC-Target-URI"], self.seen, self.sha.hexdigest(), "response", None, self.intact and self.left == 0 and self.seen == size and self.sha.hexdigest() == stated)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, record = None, None
    for batch in batches:
        rows = []
        ids, number, of, so_far = (batch.column(c).to_pylist() for c in (0, 1, 2, 4))
        for i in range(batch.num_rows):
            if number[i] == 0:
                reader, record = _Reader(), ids[i]
            if record != ids[i]:
                raise ValueError(f"chunk {number[i]} of record {ids[i]} is not where it belongs")
            reader.feed(memoryview(batch.column(3)[i].as_buffer()), so_far[i])
            if number[i] == of[i] - 1:
                rows.append(reader.row())
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record of an archive's chunk table, digests taken anew.

    intact: all digests and lengths agree, and the response that a revisit names is there with the digest and length that the revisit states.
    """
    archive = archive.select("record", "chunk_no", "n_chunks", "data", "payload_sha1")
    short = archive.where("n_chunks = 1").mapInArrow(_read, RECORDS)
    long = archive.where("n_chunks > 1").repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(_read, RECORDS)
    records = save(short.unionByName(long), "records")  # without payloads
    named = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct().withColumn("__there", F.lit(True))
    revisits = records.where("record_type = 'revisit'").join(named, ["refers_to", "payload_digest", "payload_bytes"], "left").withColumn("intact", F.col("intact") & F.coalesce("__there", F.lit(False)))
    return records.where("record_type = 'response'").unionByName(revisits.select(records.columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = save(to_archive(table(spark, sf_dir, "pages")), "warc")
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to, true AS intact
FROM q
""",
}
