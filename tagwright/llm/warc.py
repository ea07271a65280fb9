"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

An archive is a row (archive string, content binary) of at most ``ARCHIVE_BYTES`` and one record more: a run of gzip
members, one for each record, or plain records. Spark writes such rows as a table and reads ``.warc`` and ``.warc.gz``
files of any origin as such rows (``archives_in``).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm.shared import shared_dir

LEAST_REVISIT = 100  # payload bytes; smaller ones are stored every time
ARCHIVE_BYTES = 4 << 20
GZIP_LEVEL = 3
FEED = 16 << 10  # bytes of a member that are inflated at a time
# The profile that marks a revisit of an equal payload, and the names of fields.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_DATE = "1970-01-01T00:00:00Z"  # of pages whose time of capture nobody knows
VERSION = re.compile(rb"(?:(?<=\n)|\A)WARC/\d\.\d\r\n")
MEMBER = b"\x1f\x8b\x08"
RECORDS = "archive string, at long, size long, gap string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, date: str = NO_DATE, copy: int = 0) -> bytes:
    """One record: a response with its payload, or (with ``refers_to``) a revisit without. ``copy`` tells records of one page apart."""
    block = HTTP + (payload if refers_to is None else b"")
    name = lambda p, k=0: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}' + f':{k}' * (k > 0))}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(length)),
        *([("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))] if refers_to is not None else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_first(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload (null html: empty), payload_bytes, payload_digest and refers_to.

    ``refers_to`` is the smallest page_id with an equal payload of at least LEAST_REVISIT bytes, null for that page itself,
    for smaller payloads and where no such page has an id. Rows repeated with the smallest id are all responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def archives(pages: DataFrame, compress: bool = True, date: str = NO_DATE) -> DataFrame:
    """Archives (archive, content) with one record for each row of ``pages``, about ARCHIVE_BYTES each.

    ``date`` is the capture's, as ``2026-01-31T12:00:00Z``. A page's record id is made of its page_id, so that revisits can
    refer to it; rows that repeat a page_id repeat it, and rows without one have ids by task and place.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, n, seen = TaskContext.get().partitionId(), 0, [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:06d}.warc{'.gz' * compress}"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, payload, length, digest, refers in zip(*batch.columns):
                seen += 1
                one = record(page_id.as_py(), url.as_py(), payload.as_py(), length.as_py(), digest.as_py(), refers.as_py(), date, 0 if page_id.is_valid else part << 32 | seen)
                if compress:
                    squeeze = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    one = squeeze.compress(one) + squeeze.flush()
                held.append(one)
                n += len(one)
                if n >= ARCHIVE_BYTES:
                    yield row()
                    k, held, n = k + 1, [], 0
        if held:
            yield row()

    slim = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload")  # a revisit needs none
    return with_first(pages).select("page_id", "url", slim, "payload_bytes", "payload_digest", "refers_to").mapInArrow(build, "archive string, content binary")


class Damaged(Exception):
    pass


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``; Damaged if a check fails."""
    line = VERSION.match(raw, at)
    end = raw.find(b"\r\n\r\n", at)
    if not line or end < 0:
        raise Damaged("no version line" if not line else "no end of fields")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[line.end() : end].decode("utf-8", "replace").split("\r\n"))}
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,15}", length):
        raise Damaged("no length")
    block = raw[end + 4 : (stop := end + 4 + int(length))]
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("no end of record")
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind in ("sha1", "sha256") and re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", digest) and hashlib.new(kind, block).hexdigest() != digest:
        raise Damaged("block digest")
    return fields, block, stop + 4


def member(raw: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``; of a damaged one what comes out before the damage, no end (-1) and the reason.

    The member is fed in bounded pieces, so that what follows it is never copied: reading takes time in proportion to the archive.
    """
    inflate, held, view, k = zlib.decompressobj(31), [], memoryview(raw), at
    try:
        while k < len(raw):
            before, k = k, min(len(raw), k + FEED)
            held.append(inflate.decompress(view[before:k]))
            if inflate.eof:
                return b"".join(held), k - len(inflate.unused_data), None
        return b"".join(held), -1, "gzip: cut off"
    except zlib.error as e:
        why = f"gzip: {e}"
    # an error takes all output of its call with it: again up to that piece, and the piece byte by byte
    inflate = zlib.decompressobj(31)
    held = [inflate.decompress(view[at:before])]
    try:
        for x in range(before, k):
            held.append(inflate.decompress(view[x : x + 1]))
    except zlib.error:
        pass
    return b"".join(held), -1, why


def inside(body: bytes) -> list[tuple[str | None, dict[str, str], bytes]]:
    """(gap's reason or None, fields, block) of all records in a member's content and of the gaps between them, in order."""
    found, at, why = [], 0, None
    while at < len(body):
        try:
            fields, block, at = parse(body, at)
        except Damaged as e:
            why = why or str(e)
            line = VERSION.search(body, at + 1)
            at = line.start() if line else len(body)
            continue
        if why:
            found.append((why, {}, b""))
            why = None
        found.append((None, fields, block))
    return [*found, (why, {}, b"")] if why else found


def salvage(raw: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(start, size, gap's reason or None, fields, block) of all records, and of the gaps between them, in order.

    After a failed check the next gzip member or version line whose record passes all checks is where reading goes on, in a
    member's content as well; of a member that is cut off or corrupt the records before the damage count. Every byte is in
    one record or one gap: a member's bytes are its first record's or gap's, the others in it have size 0, and those of a
    damaged member are the gap's that follows its records.
    """
    at, bad, why, given = 0, None, "", []
    while at < len(raw):
        end, reason = -1, None
        try:
            if raw.startswith(MEMBER, at):
                body, end, reason = member(raw, at)
                found = inside(body)
                if not any(gap is None for gap, _, _ in found):
                    raise Damaged(reason or (found[0][0] if found else "empty member"))
            else:
                fields, block, end = parse(raw, at)
                found = [(None, fields, block)]
                if found[0] in given:
                    raise Damaged("inside a damaged member")  # stored there without compression, and read with it
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = following(raw, at)
            continue
        if bad is not None:
            yield bad, at - bad, why, {}, b""
            bad = None
        if reason and found[-1][0]:
            found.pop()  # the record that the damage cut is in the gap that follows
        for k, (gap, fields, block) in enumerate(found):
            yield at, end - at if not k and not reason else 0, gap, fields, block
        if reason:
            bad, why, given, at = at, reason, found, following(raw, at)
        else:
            at, given = end, []
    if bad is not None:
        yield bad, len(raw) - bad, why, {}, b""


def following(raw: bytes, at: int) -> int:
    """Where the next gzip member or version line after ``at`` may begin."""
    line = VERSION.search(raw, at + 1)
    return min((x for x in (raw.find(MEMBER, at + 1), line.start() if line else -1) if x >= 0), default=len(raw))


def records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of ``archives`` (archive, content), see RECORDS. ``gap`` is the reason of a gap, else null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = []
                for at, size, gap, fields, block in salvage(content.as_py() or b""):
                    number = lambda k: int(v) if re.fullmatch(r"-?\d{1,18}", v := fields.get(k, "")) else None  # noqa: B023, E731
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    length = len(payload) if kind == "response" else number("x-payload-length")
                    rows.append((name.as_py(), at, size, gap, number("x-page-id"), fields.get("warc-target-uri"), kind, length, digest, number("x-refers-to-page"), payload if payloads else None))
                if rows:
                    schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive", "content").mapInArrow(read, RECORDS)


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """WARC files at a path or pattern as rows (archive, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read the records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tagwright/warc-{uuid.uuid4().hex}"
    archives(pages).write.option("compression", "none").parquet(path)
    return records(spark.read.schema("archive string, content binary").parquet(path), payloads=False)
