"""WARC archives with revisit records for payloads that were seen before."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, held

#: Payload bytes of an archive file, about; a larger page has a file of its own size.
FILE_BYTES = 16 << 20
#: Parts that the records of one digest are dealt into for joins.
SALTS = 16

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, refers_to string, payload_bytes long, digest_ok boolean, payload binary"


def base32(digest: Column) -> Column:
    """A SHA-1 of 40 hex digits in upper-case base32: 5 hex digits are 4 of base32."""
    parts = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _uuid(key: Column) -> Column:
    digest = F.md5(key)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a WARC record per page below path, in files of FILE_BYTES about.

    Headers (id, digest, length) are shuffled by payload digest.  Of records
    with equal payloads of least_bytes or more the one with the largest id is
    the response, the others become revisit records that refer to it and hold
    no payload; smaller ones are all responses.  Rows equal in id and payload
    are responses or revisits alike.  A null payload is empty; a null url or id
    leaves its header out; a record without id whose payload occurs with an id
    is a revisit, otherwise a response.  Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = held(rows.withColumn("bytes", F.octet_length("payload").cast("long")), "sha", F.sha1("payload"))
    rows = held(rows, "record_id", _uuid(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha")))
    every = durable(rows.select("page_id", "record_id", "sha", "bytes"))
    headers = every.where(F.col("bytes") >= least_bytes)
    groups = headers.groupBy("sha").agg(F.max_by("record_id", F.coalesce("page_id", F.lit(-(2**63)))).alias("original"), F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("sha", "original", "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = headers.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    revisits = dealt.join(groups, ["sha", "salt"]).where(F.col("record_id") != F.col("original")).select("record_id", "original").distinct()

    total = every.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, math.ceil(total / FILE_BYTES))
    joined = rows.repartition(files, "record_id").join(revisits, "record_id", "left")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    first = F.col("original").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.octet_length(http) + F.when(first, F.col("bytes")).otherwise(0)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        line("WARC-Profile", F.when(~first, _PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("original"), F.lit(">"))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(first, F.col("payload")).otherwise(""),
    )
    out = joined.select("page_id", record.alias("value")).sortWithinPartitions("page_id").select("value")
    out.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _records(data: bytes):
    """(headers, block) of each record of an archive's bytes."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4 : stop]
        at = stop


def _unzipped(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":  # one member per file or per record
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row per record: record_id, record_type, target_uri, page_id, payload_digest, refers_to, payload_bytes, digest_ok, payload.

    digest_ok compares a response's payload with its header.  A revisit has the
    payload_bytes of its HTTP head and no payload.  payloads=False leaves the
    payload column null.  Plain and gzipped files are read, each in one piece.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in _records(_unzipped(content.as_py())):
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    first = headers["warc-type"] == "response"
                    size = len(body) if first else next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    page = headers.get("x-page-id")
                    rows.append(
                        {
                            "record_id": headers["warc-record-id"].strip("<>"),
                            "record_type": headers["warc-type"],
                            "target_uri": headers.get("warc-target-uri"),
                            "page_id": None if page is None else int(page),
                            "payload_digest": digest,
                            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
                            "payload_bytes": size,
                            "digest_ok": base64.b32encode(hashlib.sha1(body).digest()).decode() == digest if first else None,
                            "payload": body if first and payloads else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


_ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())]
)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) for each record.

    Revisits take bytes and digest from the response that they refer to.  A
    response whose payload doesn't match its digest raises an error; a revisit
    without response keeps its own header's values and a null refers_to.
    """
    own = records.select("page_id", "payload_bytes", F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("record_id")))).alias("payload_digest"), "record_type", "record_id", "refers_to")
    responses = own.where("record_type = 'response'").drop("refers_to")
    revisits = own.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    targets = responses.join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi").dropDuplicates(["record_id"])
    targets = targets.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = revisits.join(targets, ["refers_to", "salt"], "left").select(
        "page_id", F.coalesce("to_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("to_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to")
    )
    return found.unionByName(responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")))
