"""WARC archives: written by Spark, read back with segments put together.

Writing gives one response record per row, or a revisit record where a row with
the same payload is the response. Payloads travel as HTTP messages in chunked
transfer framing; blocks longer than ``segment_bytes`` become several records.
Reading groups continuation records by the record they belong to, orders them by
segment number, verifies that none is missing and that the total length is right,
and removes the chunked framing. The files are gone through twice, once for the
records in one piece and once for the segments, which alone pass a shuffle; a
pass skips the blocks of the other's records.

Row ids travel percent-encoded in a field of their own, and so do URIs that a
header line cannot hold as they are (line ends, blanks around them); others, and
those of other writers, are taken as they stand.

Null payloads count as empty. Of rows with equal payloads the one with the
largest id is the response (null is smallest; of repeated rows an arbitrary but
fixed one); the others refer to it. Empty tables give an empty archive. Rows
must come from a stored table, as their place in it identifies their records.
"""

import base64
import hashlib
import re
import string
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.scratch import written

_END = b"\r\n\r\n"
_PRINTED = string.punctuation.replace("%", "")

RECORD_TYPE = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("origin", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload, size):
    """An HTTP body in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body):
    """The payload of a chunked body; raises on broken framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block):
    """Payload of an HTTP response message; an empty block has an empty one."""
    head, _, body = block.partition(_END)
    framed = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b""))
    return dechunked(body) if framed else body


def _encoded(value):
    return None if value is None else quote(value, safe=_PRINTED)


def _decoded(value):
    return None if value is None else unquote(value)


def _record(fields, block):
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b" % (lines.encode(), len(block), block)


def records_of(row, segment_bytes, chunk_bytes):
    """The records of one row, without the blank lines that end them."""
    key, row_id, uri, payload, first_key = row
    payload, revisit = payload or b"", first_key != key
    plain = uri is None or (uri == uri.strip() and "\r" not in uri and "\n" not in uri)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:row:{key}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri if plain else _encoded(uri)),
        ("X-Row-URI", None if plain else _encoded(uri)),
        ("X-Row-ID", _encoded(row_id)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:row:{first_key}>"),
        ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"Transfer-Encoding: chunked\r\n\r\n"
    block = head if revisit else head + chunked(payload, chunk_bytes)
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])]
    for n, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:row:{key}:{n}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", f"<urn:row:{key}>"),
            ("WARC-Segment-Number", n),
        ]
        if at + segment_bytes >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(more, block[at : at + segment_bytes]))
    return out


def write_warc(
    pages,
    path,
    row_id,
    uri,
    payload,
    min_revisit_bytes=0,
    segment_bytes=1 << 12,
    chunk_bytes=1 << 11,
    file_records=10_000,
):
    """Write ``pages`` as WARC files below ``path``, gzip-compressed.

    Payloads shorter than ``min_revisit_bytes`` are always responses. Payloads
    pass one shuffle, by their digest; a digest that many rows share travels in
    narrow rows first, and its join is one Spark can split. A file holds at most
    ``file_records`` times ``segment_bytes``, as readers take it whole.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(f"`{row_id}`").alias("row_id"),
        F.col(f"`{uri}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    often = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max(F.struct("row_id", "key")).alias("first"))
        .filter("n > 1")
        .select("sha1", F.col("first.key").alias("first_key"))
    )
    decided = rows.join(often, "sha1", "left").select(
        "key",
        F.col("row_id").cast("string"),
        "uri",
        "payload",
        F.coalesce("first_key", "key").alias("first_key"),
    )

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def records(k: pd.Series, i: pd.Series, u: pd.Series, p: pd.Series, f: pd.Series) -> pd.Series:
        each = zip(k, i, u, p, f)
        return pd.Series([records_of(r, segment_bytes, chunk_bytes) for r in each], dtype=object)

    made = records("key", "row_id", "uri", "payload", "first_key")
    # Spark's text writer puts the bytes down as they are; the separator ends a record.
    (
        decided.select(F.explode(made).alias("record"))
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", _END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", file_records)
        .text(path)
    )


def parsed(content, wanted=lambda fields: True):
    """Records of a file's bytes; several gzip members or none are fine as well."""
    plain, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        plain.append(member.decompress(rest) + member.flush())
        rest = member.unused_data
    data, at = b"".join(plain) if plain else content, 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != _END:
            raise ValueError(f"the record at byte {at} is cut off")
        if wanted(fields):
            yield fields, data[start : start + size]
        at = start + size + 4


def _row(fields, block):
    number = fields.get("warc-segment-number")
    total = fields.get("warc-segment-total-length")
    return (
        fields["warc-record-id"],
        _decoded(fields.get("x-row-id")),
        _decoded(fields.get("x-row-uri")) or fields.get("warc-target-uri"),
        fields["warc-type"],
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        fields.get("warc-refers-to"),
        int(number) if number else None,
        fields.get("warc-segment-origin-id", fields["warc-record-id"] if number else None),
        int(total) if total else None,
        block,
    )


def read_records(spark, path, segmented=None):
    """One row per record of the archives below ``path``, segments apart.

    ``segmented`` true or false: only records that are segments, or are not.
    """

    def wanted(fields):
        return segmented is None or ("warc-segment-number" in fields) == segmented

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                part, size = [], 0
                for fields, block in parsed(bytes(content), wanted):
                    part.append(_row(fields, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pd.DataFrame(part, columns=RECORD_TYPE.names).astype(object)
                        part, size = [], 0
                yield pd.DataFrame(part, columns=RECORD_TYPE.names).astype(object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(parse, RECORD_TYPE)


def reassembled(segments):
    """One row per segmented record, put together.

    Raises if a segment is missing or twice, or the total length is wrong.
    """
    rest = [n for n in RECORD_TYPE.names if n not in ("segment", "origin", "total", "block")]
    parts = (
        segments.groupBy("origin")
        .agg(
            *[F.min_by(n, "segment").alias(n) for n in rest],
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
    )
    numbers = F.transform("parts", lambda p: p.segment)

    @F.pandas_udf(T.BinaryType())
    def concatenated(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda parts: b"".join(map(bytes, parts)))

    joined = parts.withColumn("numbers", numbers).withColumn(
        "block", concatenated(F.transform("parts", lambda p: p.block))
    )
    fits = (F.col("numbers") == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))) & (
        F.octet_length("block") == F.col("total")
    )
    broken = F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), "record_id"))
    checked = joined.withColumn(
        "block", F.when(F.coalesce(fits, F.lit(False)), F.col("block")).otherwise(broken)
    )
    return checked.select(*rest, "block")


def read_warc(spark, path, payloads=True):
    """Whole records: record_id, row_id, uri, kind, payload, payload_bytes,
    payload_digest and refers_to (the row id of the response, for revisits).

    ``payload`` is null in revisits, and left out if not asked for; the other
    columns are of the full payload. Digests of responses are computed from what
    was read and compared with those stated. What was read is stored once, and
    revisits find their responses there.
    """

    @F.pandas_udf(T.BinaryType())
    def payload_of(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: http_payload(bytes(b)))

    @F.pandas_udf(T.StringType())
    def digest_of(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: None if p is None else digest(bytes(p)))

    whole = read_records(spark, path, segmented=False).drop("segment", "origin", "total")
    records = whole.unionByName(reassembled(read_records(spark, path, segmented=True)))
    response = F.col("kind") == "response"
    # framing only: a revisit's block has no body, so its payload is empty
    full = records.withColumn("payload", payload_of(F.when(response, F.col("block")).otherwise(b"")))
    found = digest_of(F.when(response, F.col("payload")))
    full = full.withColumn("found", found).drop("block")
    mismatch = F.raise_error(F.concat(F.lit("digest differs: "), "record_id"))
    same = ~response | F.col("payload_digest").isNull() | F.col("payload_digest").eqNullSafe(F.col("found"))
    full = full.withColumn(
        "payload_digest",
        F.when(same, F.coalesce("found", "payload_digest")).otherwise(mismatch),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = ["record_id", "row_id", "uri", "kind", "payload_digest", "refers_to", "payload_bytes"]
    stored = written(full.select(*kept, *["payload"] * payloads), "records")
    names = ["record_id", "row_id", "uri", "kind", *["payload"] * payloads]
    names += ["payload_bytes", "payload_digest", "refers_to"]
    named = stored.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"),
        F.col("row_id").alias("response_row"),
        F.col("payload_bytes").alias("response_bytes"),
    )
    revisits = (
        stored.filter("kind = 'revisit'")
        .join(named, "refers_to", "left")
        .withColumn("payload_bytes", F.col("response_bytes"))
        .withColumn("refers_to", F.col("response_row"))
    )
    if payloads:
        revisits = revisits.withColumn("payload", F.lit(None).cast("binary"))
    return stored.filter("kind = 'response'").select(names).unionByName(revisits.select(names))
