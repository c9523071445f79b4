"""WARC archives with revisit records, written and read by Spark on any file system it knows.

Revisit resolution: the headers alone (id, address, payload digest, length) are shuffled by payload digest; of records
with equal payloads the one with the least id is the response, and the others become revisit records that refer to it
and hold no payload.  Only digests that occur more than once are joined back to the records.

A record is one string; Spark's text writer puts CR LF CR LF after each, which is how a WARC record ends, and commits
whole files, so lost tasks leave none behind.  Archives are gzip files of one member, of as many records as have about
`FILE_BYTES` on average.  Readers unpack them a piece at a time.  Fresh headers are made for every record written.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import join_few, work_dir, written

# The base32 alphabet, and the profile of a revisit to an identical payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
#: Unpacked bytes that an archive has about, and records that it has at most.
FILE_BYTES, FILE_RECORDS = 256 << 20, 20_000
#: Unpacked bytes that a reader asks for at once.
PIECE = 1 << 20


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: ten hex digits at a time are eight base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolved(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records (id, url, payload) with digest, n (payload bytes), type (response or revisit), first_id and first_url.

    Payloads under least_bytes are all responses.  Ids may be null or repeat: rows that repeat the least id of their
    payload are all responses, rows without id revisit any record that has one, and are responses where none has.
    """
    made = records.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("digest", payload_digest(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    heads = made.select("id", "url", "digest", "n").where(F.col("n") >= least_bytes)
    firsts = heads.groupBy("digest").agg(F.min("id").alias("first_id"), F.min_by("url", F.struct("id", "url")).alias("first_url"), F.count("*").alias("k"))
    firsts = written(firsts.where("k > 1").drop("k"))
    out = join_few(made, firsts, "digest", F.xxhash64("id", "url"))
    again = (F.col("n") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return out.withColumn("type", F.when(again, "revisit").otherwise("response"))


def _record_id(id_: str) -> Column:
    """The id of the record that revisits of its payload refer to."""
    h = F.md5(F.concat_ws(" ", F.lit("page"), F.col(id_).cast("string"), F.col("digest")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _own_id() -> Column:
    """A response's record has the id that others refer to it by; a revisit's, and one without a page id, any new one.
    Only rows that repeat both the page id and the payload of a response share one."""
    referred = (F.col("type") == "response") & F.col("id").isNotNull()
    return F.when(referred, _record_id("id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))


def _field(value: Column) -> Column:
    """A value that stays on its header line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_a_file: int | None = None) -> None:
    """Archives of resolved() records in a new folder `path`."""
    if records_a_file is None:
        size = records.agg(F.avg(F.when(F.col("type") == "response", F.col("n")).otherwise(0) + 600).alias("mean")).first()["mean"] or 600
        records_a_file = int(min(FILE_RECORDS, max(1, FILE_BYTES // size)))
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n"), F.lit(EOL + EOL))
    block = F.concat("http", F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(EOL))).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.col("type"), F.lit(EOL),
        line("WARC-Record-ID", _own_id()),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _field(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")))))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, _record_id("first_id"))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, _field(F.col("first_url")))),
        line("X-Page-Id", F.col("id").cast("string")),
        line("X-Refers-To-Page-Id", F.when(revisit, F.col("first_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response" + EOL),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(EOL),
    )
    whole = records.withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    whole.write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The pieces of all members of a gzip file, or of the data itself if it is none."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    rest = memoryview(data)
    while len(rest):
        one, fed = zlib.decompressobj(31), 0
        while not one.eof:
            more = one.unconsumed_tail or rest[fed : fed + PIECE]
            if not len(more):
                raise ValueError("an archive that ends too early")
            if not one.unconsumed_tail:
                fed += len(more)
            piece = one.decompress(more, PIECE)
            if piece:
                yield piece
        rest = rest[fed - len(one.unused_data) :]


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive that comes in pieces, of which no more are held
    than a record takes; a damaged record raises."""
    held, pieces = bytearray(), iter(pieces)

    def have(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while have(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not have(len(held) + 1):
                raise ValueError("a header that ends too early")
        lines = held[:end].decode().split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        to = end + 4 + int(head["content-length"])
        if not have(to + 4) or held[to : to + 4] != b"\r\n\r\n":
            raise ValueError("a record that ends too early")
        yield head, bytes(held[end + 4 : to])
        del held[: to + 4]


def _rows(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse(unpacked(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split(EOL)[1:])}
                    full = head["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    if full and digest != stated:
                        raise ValueError(f"a payload of {digest} under a header that says {stated}")
                    ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((ids[0], head["warc-target-uri"], len(payload) if full else int(named["content-length"]), stated, head["warc-type"], ids[1], *[payload.decode() if full else None] * with_payload))
                    size += len(payload) * with_payload
                    if len(rows) >= 4096 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("n", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("first_id", pa.int64()), *[("payload", pa.string())] * with_payload])
    return run


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """id, url, n, digest, type, first_id (of a revisit) and, if wanted, payload (null for a revisit) of the archives in
    a folder; each payload is held against its digest."""
    schema = "id long, url string, n long, digest string, type string, first_id long" + ", payload string" * with_payload
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows(with_payload), schema)


def rewrite(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """New archives of the records in old ones, deduplicated, with fresh headers.  Revisit records of the old archives get
    the payload of what they refer to first; those whose original is not in these archives are written as revisits still."""
    old = read(spark, source, with_payload=True)
    full = old.where("type = 'response'").select("id", "url", "payload")
    # Of responses that repeat an id, that of the revisit's own digest is the original.
    originals = old.where("type = 'response' AND id IS NOT NULL").select(F.col("id").alias("first_id"), "digest", F.col("payload").alias("__p")).dropDuplicates(["first_id", "digest"])
    back = written(old.where("type = 'revisit'").drop("payload").join(originals, ["first_id", "digest"], "left"))
    found = resolved(full.union(back.where("__p IS NOT NULL").select("id", "url", F.col("__p").alias("payload"))), least_bytes)
    lost = back.where("__p IS NULL").select("id", "url", F.lit(None).cast("string").alias("payload"), "digest", "n", "type", "first_id", F.lit(None).cast("string").alias("first_url"))
    write(found.select("id", "url", "payload", "digest", "n", "type", "first_id", "first_url").unionByName(lost), target)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record for each page to new archives in the shared folder, read them back, and return page_id,
    payload_bytes, payload_digest, record_type and refers_to (the response's page_id, for a revisit).

    A null payload is an empty one, and one of any length is written whole.  An empty table gives no rows.  Ids are
    integers; for null and repeated ids see resolved().  Other columns of pages, of whatever name, are not read.
    """
    records = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    path = work_dir(pages.sparkSession)
    write(resolved(records, least_bytes), path)
    back = read(pages.sparkSession, path)
    return back.select(F.col("id").alias(page_id), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first_id").alias("refers_to"))
