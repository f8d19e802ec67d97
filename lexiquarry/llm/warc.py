"""WARC archives: equal payloads become revisit records of one response.

Headers, not payloads, decide: digests are counted, each digest's response is chosen, and records are joined to it
by digest. Archives are written through Spark's committer (a lost executor leaves no half file): a record ends with
two line ends, which is the text writer's separator, and each file is one gzip stream of WARC/1.1 records. They are
read as a stream of the same parts, so that a task holds a record at a time, whatever the size of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup_join, scratch

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: Records in an archive file at most.
FILE_RECORDS = 4000
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1: 160 bits are four times 40, and 40 bits are eight digits."""
    digest = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0"), _DIGITS, _BASE32) for at in (1, 11, 21, 31)]
    return F.concat(*parts)


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Null html is an empty payload. Of equal payloads the largest page_id is the response, null ids come last; rows
    that repeat the response's page_id and payload are responses too. A revisit's payload is emptied here.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    headers = rows.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id")
    # only digests of several pages are needed further on
    by = cut(headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id")).filter("n > 1"))
    out = lookup_join(rows, by.withColumn("several", F.lit(True)), "payload_digest", "n")
    revisit = F.coalesce(F.col("several"), F.lit(False)) & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return out.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("response_id")),
        "payload": F.when(revisit, "").otherwise(F.col("payload")),
    }).drop("several", "response_id")


def record_id(page_id: Column) -> Column:
    """A name-based id, so that a rerun writes the same headers."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(resolved: DataFrame, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One WARC record as text for each row of resolve(), with headers made anew, without the two line ends that end it.

    A null page_id or URL has no header; line ends in a URL become spaces; rows that repeat are records each; an empty table gives none.
    """
    eol = F.lit("\r\n")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, eol), F.lit(""))
    one_line = F.regexp_replace(F.col("url"), "[\r\n]+", " ")
    revisit = F.col("record_type") == "revisit"
    return resolved.select(
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", one_line), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("X-Page-Id", F.col("page_id").cast("string")),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(""),
            line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length("payload").cast("string")), eol, F.col("payload"),
        ).alias("value")
    )


def write_archives(resolved: DataFrame, path: str, compression: str = "gzip", file_records: int = FILE_RECORDS) -> None:
    records(resolved).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


_END = b"\r\n\r\n"


class Records:
    """Records out of the parts of one archive between its double line ends, in their order."""

    def __init__(self, name: str):
        self.name, self.head, self.parts, self.size, self.want = name, None, [], 0, 0

    def part(self, data: bytes) -> list[tuple[dict[bytes, bytes], bytes]]:
        """Takes the next part in; the records that it completes. A block may hold double line ends itself, and one that ends with a line end shifts the parts after it."""
        self.parts.append(data + _END)
        self.size += len(data) + len(_END)
        out = []
        while True:
            if self.head is None and not self._open():
                return out
            if self.size < self.want:
                return out
            out.append(self._close())

    def _open(self) -> bool:
        text = b"".join(self.parts)
        end = text.find(_END)
        if end <= 0:
            return False
        lines = text[:end].split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record where one should start in {self.name}")
        self.head = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        rest = text[end + 4 :]
        self.parts, self.size, self.want = [rest], len(rest), int(self.head[b"content-length"]) + len(_END)
        return True

    def _close(self) -> tuple[dict[bytes, bytes], bytes]:
        data, n = b"".join(self.parts), self.want - len(_END)
        if data[n : self.want] != _END:
            raise ValueError(f"a record of {self.name} isn't ended by two line ends")
        rest, head = data[self.want :], self.head
        self.head, self.parts, self.size = None, [rest] if rest else [], len(rest)
        return head, data[:n]

    def end(self) -> None:
        """No part follows. What the last separator left over isn't data: it is only added between parts."""
        left = b"".join(self.parts)
        if self.head is not None or left.strip(b"\r\n"):
            raise ValueError(f"the last record of {self.name} has no end")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives at path: page_id, url, record_type, payload_digest, refers_to, block_bytes and payload (null unless asked for)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "block_bytes", "payload"]
        reader: Records | None = None
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            held = 0
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if reader is None or reader.name != name:
                    if reader is not None:
                        reader.end()
                    reader = Records(name)
                for h, block in reader.part(line.as_py().encode()):
                    number = lambda key: int(h[key]) if key in h else None  # noqa: B023, E731
                    url = h.get(b"warc-target-uri")
                    row = (number(b"x-page-id"), None if url is None else url.decode(), h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:"), number(b"x-refers-to-page-id"), len(block), block.decode() if payloads else None)
                    for column, value in zip(out, row):
                        column.append(value)
                    held += len(block) if payloads else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
        if reader is not None:
            reader.end()

    # a file's parts are read in order by one task: its rows are never split
    parts = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "part-*").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parts.mapInArrow(parse, "page_id long, url string, record_type string, payload_digest string, refers_to long, block_bytes long, payload string")


def resolved_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of the archives at path, revisits with the payload size of the response that they refer to."""
    rows = read_archives(spark, path, payloads=False).drop("payload", "url")
    rows = cut(rows)
    revisits = rows.filter("record_type = 'revisit'").groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("block_bytes").alias("payload_bytes"))
    by = cut(revisits.join(sizes, "payload_digest", "left"))
    out = lookup_join(rows.filter("record_type = 'revisit'"), by, "payload_digest", "n")
    return rows.filter("record_type = 'response'").withColumn("payload_bytes", F.col("block_bytes")).unionByName(out).drop("block_bytes")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: pages written as deduplicated archives in the shared folder, and the archives' records read back."""
    path = scratch(spark, "warc")
    write_archives(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), path)
    return resolved_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('{_BASE32}', ((x[{k // 4 + 1}] >> {15 - 5 * (k % 4)}) & 31) + 1, 1)" for k in range(32))
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, [CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) FOR i IN range(8)] AS x FROM p),
d AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS r FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> r THEN r END AS refers_to FROM m
"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": SQL}
