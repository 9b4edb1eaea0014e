"""WARC archives: writing page captures, reading archives back, and assembling transactions.

Writing: each page gives a request, a response (or a revisit, where an earlier page has the same payload) and a metadata
record. Spark's text writer puts them into ``.txt.gz`` parts in any Hadoop file system, with its commit protocol; its line
separator is the two line breaks that end a WARC record, so the files' bytes are plain WARC. Larger payloads go into files
of fewer records, in a folder of their own. Reading: Spark's binary file
source and a streaming parser in Python, which keeps one record in memory. Transactions: request and metadata records
name their capture in WARC-Concurrent-To; equi-joins on it give one nested row per capture.

Defined results: a null html is an empty payload; a null url becomes an empty target; rows equal in page id and payload
are told apart by a running number, and the first of them counts as the page; null page ids stay null, come last and are
no response for others while a page with an id has the payload; an empty table writes an empty archive and gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import scratch_path, tune, written

#: Payloads under so many bytes are always stored.
LEAST = 100
#: Records of one file for payloads up to so many bytes: an archive stays under the 2 GB that a reader takes at once.
FILE_RECORDS = ((256 << 10, 6000), (16 << 20, 96), (1 << 31, 3))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: str | Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without the two line breaks that end it; fields whose value is null are left out."""
    head = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\n"))]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(*head, F.lit(f"WARC-Date: {DATE}\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def records(pages: DataFrame) -> DataFrame:
    """``bytes`` of the payload and ``records``: the WARC records of ``page_id``, ``url``, ``html``, as texts without their end."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    n = pages.agg(F.count("*").alias("rows"), F.count_distinct("page_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        rows = rows.withColumn("again", F.lit(0))
    else:  # ids are missing or repeat
        rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy(F.xxhash64("url"))) - 1)
    digests = pages.select("page_id", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST)
    first = digests.groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    first = written(first, "first_captures")  # so that the join may split the pages of one payload
    rows = rows.join(first, rows["digest"] == first["_digest"], "left")
    revisit = F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("again") > 0))
    capture = _uuid(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("again"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\n\r\n"))
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    uri = ("WARC-Target-URI", F.when(target != "", target))
    response = _record("response", [("WARC-Record-ID", capture), uri, ("WARC-Payload-Digest", digest)], "application/http;msgtype=response", F.concat(http, F.col("html")))
    pointer = _record("revisit", [("WARC-Record-ID", capture), uri, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _uuid(F.lit("capture"), F.col("first"), F.col("digest"), F.lit(0)))], "application/http;msgtype=response", http)
    made = F.array(
        _record("request", [("WARC-Record-ID", _uuid(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("again"))), ("WARC-Concurrent-To", capture), uri], "application/http;msgtype=request", request),
        F.when(revisit, pointer).otherwise(response),
        _record("metadata", [("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("again"))), ("WARC-Concurrent-To", capture), uri], "application/warc-fields", about),
    )
    return rows.select("bytes", made.alias("records"))


def write_warc(pages: DataFrame, path: str, file_records: tuple[tuple[int, int], ...] = FILE_RECORDS) -> None:
    """Write the archives of ``pages`` into folders under ``path``."""
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    made, before = records(pages), -1
    for size, many in file_records:
        if before < 0 or before < longest:
            part = made.where((F.col("bytes") > before) & (F.col("bytes") <= size)).select(F.explode("records").alias("record"))
            part.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", many).text(f"{path}/to-{size}")
        before = size


def parse(portions: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by lower-case name; the type line under ``version``) and block of each record of a stream of WARC bytes."""
    buffer = bytearray()
    ended = False

    def more(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            try:
                buffer.extend(next(portions))
            except StopIteration:
                ended = True
        return len(buffer) >= n

    while more(1):
        while more(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        at = buffer.find(b"\r\n\r\n")
        while at < 0 and more(len(buffer) + 1):
            at = buffer.find(b"\r\n\r\n")
        if at < 0:
            if buffer.strip():
                raise ValueError("a WARC header does not end")
            return
        lines = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        fields["version"] = lines[0]
        size = int(fields["content-length"])
        if not more(at + 4 + size):
            raise ValueError("a WARC record is cut short")
        block = bytes(buffer[at + 4 : at + 4 + size])
        del buffer[: at + 4 + size]
        yield fields, block


def _inflated(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain one, in portions."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), step):
            yield bytes(content[at : at + step])
        return
    at, machine = 0, zlib.decompressobj(31)
    rest = b""
    while at < len(content) or rest:
        data = rest or bytes(content[at : at + step])
        at += 0 if rest else len(data)
        if out := machine.decompress(data, 4 * step):
            yield out
        rest = machine.unconsumed_tail
        if machine.eof:
            rest = machine.unused_data
            machine = zlib.decompressobj(31)


SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in the folder ``path``; ``payload_digest`` and ``payload_bytes`` are of the payload that the record
    itself holds. ``fields`` are those of a metadata record. ``payloads`` false leaves the payloads out."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(_inflated(memoryview(content.as_buffer()))):
                    kind, about, payload = fields["warc-type"], None, b""
                    if kind == "metadata":
                        about = [tuple(y.strip() for y in x.split(":", 1)) for x in block.decode().split("\r\n") if ":" in x]
                    elif kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, len(payload), hashlib.sha256(payload).hexdigest(), about, payload if payloads and kind == "response" else None))
                    size += len(payload)
                    if len(rows) >= 1000 or size >= 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, SCHEMA)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: its id, and ``capture``, ``request``, ``metadata`` (null where there is none)."""
    capture = found.where("record_type IN ('response', 'revisit')").select(F.col("record_id").alias("id"), F.struct("record_type", "refers_to", "target_uri", "declared_digest", "payload_bytes", "payload_digest", "payload").alias("capture"))
    request = found.where("record_type = 'request'").groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct("record_id", "target_uri")).alias("request"))
    about = found.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "fields").alias("metadata"))
    return capture.join(request, "id", "left").join(about, "id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder, read them back and tell what each page's capture holds."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    about = F.col("metadata.fields")
    page = F.when(about["pageId"] != "", about["pageId"]).cast(kind)
    parsed = written(read_warc(spark, path, payloads=False), "captures")  # parsed once, without the payloads
    found = written(transactions(parsed).select("id", page.alias("page_id"), F.when(F.col("capture.record_type") == "response", F.col("capture.payload_bytes")).otherwise(about["payloadBytes"].cast("long")).alias("payload_bytes"), F.when(F.col("capture.record_type") == "response", F.col("capture.payload_digest")).otherwise(F.col("capture.declared_digest")).alias("payload_digest"), F.col("capture.record_type").alias("record_type"), F.col("capture.refers_to").alias("target")), "transactions")
    named = found.where("record_type = 'response'").select(F.col("id").alias("target"), F.col("page_id").alias("refers_to"))
    return found.drop("id").join(named, "target", "left").drop("target")


def oracle(least: int = LEAST) -> str:
    """The same rows as DuckDB SQL."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {least} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND page_id <> first THEN first END AS refers_to FROM f"""
