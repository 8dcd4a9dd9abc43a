"""WARC archives through Spark's own text files, read back as a chunked record table.

Writing. Every page is one WARC/1.1 record: a response, or a revisit of the page with the smallest id whose payload is equal. Digests come first, in rows without payloads; groups, joins and revisits
work on these alone. A payload is then cut in one forward pass over the bytes of its row, without a copy of the whole: chunks of at most ``chunk`` bytes, each with the SHA-1 of the payload up to its end, become
WARC segments (a response and its continuation records), so no written row grows with a payload. The text writer ends each record
with CRLF CRLF, which makes its part files (gzip) valid archives.

Which pages are revisits is told to the scan that writes by a bitmap of bounded size (:func:`~lacuna.llm.common.maybe_listed`); only responses that it takes for revisits by mistake are shuffled with their payloads.

Reading. The text reader splits archives at CRLF CRLF "WARC/1.1"; so that this string only ever starts a record, the writer cuts a payload inside each occurrence
of it: the segments of a payload never contain it. Every row is then one segment, cut to its Content-Length. The result is a chunked record table: (record, chunk
number, bytes, SHA-1 of the chunk, SHA-1 told for the payload so far). Records of several chunks are dealt out by record, sorted by chunk number and streamed through a running SHA-1 that is held against each
told one; no task ever holds a whole payload. Records of one chunk need no shuffle. A revisit is sound if the response that it names is there with the same size and digest.

Defined cases: a null payload is empty; equal payloads below ``least`` bytes stay responses; a null url is ``urn:none``; control characters of a url are escaped;
rows with a null page id, and rows that repeat an id, are records of their own, and a row whose id equals the smallest of its group is a response; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, cut, maybe_listed, read_table, scratch

CRLF = "\r\n"
END = CRLF + CRLF
VERSION = "WARC/1.1"
SENTINEL = END + VERSION
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """A SHA-1 in hex as bare upper-case base32: each 5 hex digits make 4 letters. ``hexed`` should be a column, as it is used often."""

    def letters(i: int) -> Column:
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[letters(i) for i in range(8)])


def cuts(payload: memoryview, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Start and end of a payload's chunks: at most ``chunk`` bytes (4 at least), cut between characters and inside each sentinel, none starting so that a header's end would complete one."""
    n, at, sentinel = len(payload), 0, SENTINEL.encode()
    if not n:
        yield 0, 0
    while at < n:
        end = min(n, at + chunk)
        while end < n and payload[end] & 0xC0 == 0x80 and end > at + chunk - 4:
            end -= 1
        part = bytes(payload[at:end])
        inside = part.find(sentinel)
        if inside >= 0:
            end = at + inside + len(sentinel) - 1
        for head in (VERSION.encode(), (CRLF + VERSION).encode()):
            if part.startswith(head):
                end = min(end, at + len(head) - 1)
        yield at, end
        at = end


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of strings as they lie in the batch; null is empty."""
    for x in column.cast(pa.binary()):
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, h, payload_bytes, payload_sha1) of (page_id, url, payload, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = list(_views(b.column("payload")))
            made = [pa.array([len(v) for v in views], pa.int64()), pa.array([hashlib.sha1(v).hexdigest() for v in views], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("h"), *made], names=["page_id", "url", "h", "payload_bytes", "payload_sha1"])

    return arrow_map(pages, run, "page_id long, url string, h long, payload_bytes long, payload_sha1 string")


def with_record_types(sized: DataFrame, least: int = 0) -> DataFrame:
    """Rows of :func:`digests` with record_type and refers_to."""
    same = ["payload_sha1", "payload_bytes"]
    groups = sized.where(F.col("payload_bytes") >= least).groupBy(*same).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    typed = sized.join(groups, same, "left")
    return typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def segments(page_id: int | None, url: str | None, payload: memoryview, size: int, digest: bytes, refers_to: int | None, chunk: int, date: str) -> Iterator[bytes]:
    """The WARC segments of one record, head and block; a record with ``refers_to`` is a revisit, and its payload is not written."""
    row = uuid.uuid4().hex
    own = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{row}>"
    uri = re.sub(r"[\x00-\x20\x7F]", "%20", url) if url is not None else "urn:none"
    told, revisit, running = b32encode(digest).decode(), refers_to is not None, hashlib.sha1()
    ends = cuts(memoryview(b"") if revisit else payload, chunk)
    here, number = next(ends), 0
    while here is not None:
        number, (a, b), here = number + 1, here, next(ends, None)
        first, several = number == 1, number > 1 or here is not None
        part = bytes(payload[a:b])
        running.update(part)
        block = HTTP.encode() + part if first else part
        fields = {
            "WARC-Type": ("revisit" if revisit else "response") if first else "continuation",
            "WARC-Record-ID": own if first else f"<urn:segment:{row}:{number - 1}>",
            "WARC-Date": date,
            "WARC-Target-URI": uri,
            "Content-Type": "application/http; msgtype=response" if first else None,
            "WARC-Payload-Digest": f"sha1:{told}",
            "WARC-Block-Digest": f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
            "WARC-Segment-Number": number if several else None,
            "WARC-Segment-Origin-ID": None if first else own,
            "WARC-Segment-Total-Length": size + len(HTTP) if several and here is None else None,
            "Page-ID": page_id,
            "Page-Refers-To": refers_to,
            "Row-ID": row,
            "Payload-Length": size,
            "Running-Digest": f"sha1:{b32encode(running.digest()).decode()}" if several else None,
            "Content-Length": len(block),
        }
        yield (VERSION + "".join(f"{CRLF}{k}: {v}" for k, v in fields.items() if v is not None) + END).encode() + block


def _text_rows(records: Iterator[bytes], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).view(pa.string())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).view(pa.string())], names=["value"])


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, chunk: int = CHUNK, date: str = "2026-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes one record per row below ``path``."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.xxhash64(payload).alias("h"))
    typed = cut(with_record_types(cut(digests(rows)), least))
    revisits, key = typed.where(F.col("refers_to").isNotNull()), ["page_id", "h"]
    listed = maybe_listed(rows, key, revisits.select(*key))
    # Responses that the bitmap takes for revisits: found without payloads, then by a bitmap of their own.
    mistaken = cut(maybe_listed(typed.where(F.col("refers_to").isNull()), key, revisits.select(*key)).where("__listed").select(*key, "payload_sha1").distinct())
    again = maybe_listed(listed.where("__listed").drop("__listed"), key, mistaken.select(*key)).where("__listed").drop("__listed")
    exact = again.join(mistaken.drop("h").withColumnRenamed("page_id", "__id"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(F.col("payload").cast("binary")) == F.col("payload_sha1")), "left_semi")

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for i, u, v in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), _views(b.column("payload")), strict=True):
                    yield from segments(i, u, v, len(v), hashlib.sha1(v).digest(), None, chunk, date)

        return _text_rows(records())

    def revisit_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "payload_bytes", "payload_sha1", "refers_to")
        return _text_rows(r for b in batches for i, u, n, d, to in zip(*(b.column(c).to_pylist() for c in names), strict=True) for r in segments(i, u, memoryview(b""), n, bytes.fromhex(d), to, chunk, date))

    written = [arrow_map(x.select("page_id", "url", "payload"), responses, "value string") for x in (listed.where("not __listed"), exact)]
    written.append(arrow_map(revisits.select("page_id", "url", "payload_bytes", "payload_sha1", "refers_to"), revisit_records, "value string"))
    written[0].unionByName(written[1]).unionByName(written[2]).write.option("lineSep", END).option("compression", compression).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``: one row per segment."""
    raw = spark.read.option("lineSep", SENTINEL).text(path)
    head = F.col("head")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    cut = raw.withColumn("head", F.substring_index("value", END, 1))
    cut = cut.withColumn("block", F.expr("substring(cast(value as binary), octet_length(head) + 5, " + r"cast(regexp_extract(head, '\r\nContent-Length: ([0-9]+)', 1) as int))"))
    kind = field("WARC-Type")
    skip = F.when(kind == "continuation", 0).otherwise(len(HTTP))
    cut = cut.withColumn("chunk", F.substring(F.col("block"), skip + 1, F.octet_length("block")))
    return cut.select(
        field("Row-ID").alias("record"),
        field("Page-ID").cast("long").alias("page_id"),
        kind.alias("kind"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        F.isnotnull(field("WARC-Segment-Number")).alias("segmented"),
        field("Page-Refers-To").cast("long").alias("refers_to"),
        field("Payload-Length").cast("long").alias("told_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("told_digest"),
        F.regexp_replace(field("Running-Digest"), "^sha1:", "").alias("told_so_far"),
        "chunk",
        F.sha1("chunk").alias("chunk_sha1"),
    )


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by record and number, into one row per record; a running SHA-1 is all that is kept."""
    now, state = None, None

    def done():
        page, size, digest, told_bytes, told_digest, sound = state
        d = b32encode(digest.digest()).decode()
        return pa.RecordBatch.from_pylist([{"page_id": page, "payload_bytes": size, "payload_digest": d, "record_type": "response", "refers_to": None, "sound": sound and (size, d) == (told_bytes, told_digest)}], schema=_ARROW)

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("record", "page_id", "told_bytes", "told_digest", "told_so_far")]
        for record, page, told_bytes, told_digest, so_far, chunk in zip(*columns, _views(b.column("chunk")), strict=True):
            if record != now:
                if now is not None:
                    yield done()
                now, state = record, [page, 0, hashlib.sha1(), told_bytes, told_digest, True]
            state[1] += len(chunk)
            state[2].update(chunk)
            state[5] &= b32encode(state[2].digest()).decode() == so_far
    if now is not None:
        yield done()


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("sound", pa.bool_())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with what its payload came to; ``sound``: as its header says, and a revisit (which has the figures of its header) as the response that it names."""
    chunks = read_chunks(spark, path)
    single = chunks.where("not segmented")
    digest = F.when(F.col("kind") == "revisit", F.col("told_digest")).otherwise(base32(F.col("chunk_sha1")))
    size = F.when(F.col("kind") == "revisit", F.col("told_bytes")).otherwise(F.octet_length("chunk").cast("long"))
    plain = single.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "told_bytes", "told_digest")
    plain = plain.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", ((F.col("payload_bytes") == F.col("told_bytes")) & (F.col("payload_digest") == F.col("told_digest"))).alias("sound"))
    several = chunks.where("segmented").select("record", "chunk_no", "page_id", "chunk", "told_bytes", "told_digest", "told_so_far")
    streamed = arrow_map(several.repartition("record").sortWithinPartitions("record", "chunk_no"), _streamed, RECORD)
    records = cut(plain.unionByName(streamed))
    named = records.where("record_type = 'response' and sound").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct().withColumn("__there", F.lit(True))
    revisits = records.where("record_type = 'revisit'").join(named, ["refers_to", "payload_digest", "payload_bytes"], "left")
    revisits = revisits.withColumn("sound", F.col("sound") & F.coalesce("__there", F.lit(False))).select(*records.columns)
    return records.where("record_type <> 'revisit'").unionByName(revisits)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    checked = F.when(F.col("sound"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return read_records(spark, path).select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
e AS (
  SELECT *, strlen(h)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('{BASE32}', (((('0x' || substr(x, 5 * i + 1, 5))::INT >> s) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM e
"""
