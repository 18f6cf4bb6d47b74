"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm.shared import bloom, filter_words, might_hold
from tapeflow.plans.tables import keep

#: Payloads up to so many bytes and the records of a file: no file outgrows 256 MB, unless one page alone does.
CLASSES = ((50 << 10, 5000), (5 << 20, 50), (None, 1))
#: Larger files are refused with a clear error; split them at member boundaries first.
MAX_FILE = 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: An empty gzip member: what stands between two members where Spark's writer ends a row.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by five hex digits to four letters."""
    digest = F.sha1(text.cast("binary"))

    def letters(i: int) -> list[Column]:
        five = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substr(F.lit(_ALPHABET), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[c for i in range(8) for c in letters(i)])


# --- writing -----------------------------------------------------------------------------

def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, is_revisit, refers): of equal payloads of at least
    ``least_bytes``, the largest page_id is the response. Only pages whose digest occurs
    again are shuffled with their html. Null html is an empty payload; a null page_id is
    smaller than all others; repeated rows of a response are responses all."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    long = F.octet_length("html") >= least_bytes
    again = keep(rows.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
                 .where("n > 1").select("digest", "last"))
    words = filter_words(again.count())
    key = F.when(long, F.xxhash64("digest"))
    rows = might_hold(rows, key, bloom(again, F.xxhash64("digest"), words), words, "_in")
    alone = rows.where("not _in").select("page_id", "url", "html", "digest", F.lit(False).alias("is_revisit"),
                                         F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers"))
    other = rows.where("_in").join(again, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return alone.union(other.select("page_id", "url", "html", "digest", revisit.alias("is_revisit"),
                                    F.when(revisit, F.col("last")).alias("refers")))


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _has_sha1(said: str, data: bytes) -> bool:
    """Whether a digest in base32 or hex, in either case, is that of ``data``."""
    try:
        return (bytes.fromhex(said) if len(said) == 40 else base64.b32decode(said, casefold=True)) == hashlib.sha1(data).digest()
    except ValueError:
        return False


def record(page_id, url: str | None, payload: bytes, digest: str, revisit: bool, refers) -> bytes:
    """One WARC record with its closing blank lines. Control characters in a URL are escaped."""
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_id(page_id)}>",
            f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if url:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_id(refers)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(value) -> str:
    return "" if value is None else str(value)


def write_archives(pages: DataFrame, folder: str, compress: bool = True, per_file: int | None = None, least_bytes: int = 0) -> None:
    """Archives in ``folder``, a gzip member a record, or plain records.

    Files are rolled by bytes: pages are written by size class, each with its own number of records a file
    (``per_file`` lowers it).

    Spark's own text writer commits the files, so lost or repeated tasks leave no halves. It
    ends every row with a separator: the closing blank lines of a plain record, or an empty
    gzip member, which readers of concatenated members pass over.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, html, digest, revisit, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page_id, url, html, digest, revisit, refers)
                rows.append(gzip.compress(raw, 6, mtime=0) if compress else raw[:-4])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    end = _EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    size, least = F.coalesce(F.octet_length("html"), F.lit(0)), -1
    longest = pages.agg(F.max(size)).first()[0] or 0
    plan = plan_records(pages, least_bytes)
    for most, records in CLASSES:
        if least < longest or least < 0:
            own = plan.where((size > least) & (size <= most) if most else size > least).withColumn("html", F.col("html").cast("binary"))
            (own.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
             .write.mode("append").option("lineSep", end).option("encoding", "ISO-8859-1")
             .option("maxRecordsPerFile", min(records, per_file or records)).text(folder))
        least = most


# --- reading -----------------------------------------------------------------------------

class Damaged(ValueError):
    pass


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """Contents of the gzip member at ``at`` and its end; its checksum and length must hold."""
    d, out, p = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            if p >= len(data):
                raise Damaged("member cut off")
            chunk = data[p : p + 65536]
            out.append(d.decompress(chunk))
            p += len(chunk)
    except zlib.error as e:
        raise Damaged("member fails its check") from e
    return b"".join(out), p - len(d.unused_data)


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; length and block digest must hold."""
    if not data.startswith(_VERSION, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers cut off")
    try:
        lines = data[at:stop].decode().split("\r\n")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(head["content-length"])
    except (ValueError, KeyError) as e:
        raise Damaged("bad headers") from e
    block = data[stop + 4 : stop + 4 + n]
    end = stop + 4 + n
    if n < 0 or len(block) < n or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block has another length")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and not _has_sha1(want[5:], block):
        raise Damaged("block fails its digest")
    return head, block, end + 4


def salvage(data: bytes, inside: bool = False) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None) in order.

    Members and plain records may alternate. After a failed check the reader looks for the
    next member or version line that passes all checks; the bytes in between are one gap.
    Records inside a damaged stretch are lost, those after it are not. Offsets of records in
    a member are the member's; a member's unreadable part is a gap over the whole member.
    """
    view, at, n, gap, why = memoryview(data), 0, len(data), None, ""
    while at < n:
        try:
            if data.startswith(_MAGIC, at) and not inside:
                body, end = _member(view, at)
                found = [(kind, at, end, x, y) for kind, _, _, x, y in salvage(body, True)]
            else:
                head, block, end = _plain(data, at)
                found = [("record", at, end, head, block)]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            nexts = [p for p in (data.find(_VERSION, at + 1), -1 if inside else data.find(_MAGIC, at + 1)) if p >= 0]
            at = min(nexts, default=n)
            continue
        if gap is not None:
            yield "gap", gap, at, why, None
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, n, why, None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records and quarantined gaps of the files in ``folder``.

    kind (record or gap), path, start, stop, reason; of records record_type, record_id, uri,
    refers_to, payload (null for a revisit), payload_bytes, payload_digest. Payload length and
    digest of a response are computed from what was read, those of a revisit are its headers'.
    An empty file gives no row.
    """
    types = pa.schema([("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                       ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
                       ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def row(path, kind, start, stop, head, block):
        if kind == "gap":
            return (kind, path, start, stop, head, *[None] * 7)
        revisit = head.get("warc-type") == "revisit"
        http = block.find(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else -4
        payload = None if revisit else block[http + 4 :] if http >= 0 or http == -4 else block
        size = int(head.get("warc-payload-length") or 0) if revisit else len(payload)
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else _digest(payload)
        return (kind, path, start, stop, None, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"),
                head.get("warc-refers-to"), payload, size, digest)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = (row(path.as_py(), *x) for x in salvage(content.as_py()))
                while some := list(itertools.islice(rows, 100)):
                    cols = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, types, strict=True)], schema=types)

    files = spark.read.format("binaryFile").load(folder)
    big = F.col("length") > MAX_FILE
    content = F.when(big, F.raise_error(F.concat(F.lit("archive too large: "), "path")).cast("binary")).otherwise(F.col("content"))
    ddl = ("kind string, path string, start long, stop long, reason string, record_type string, record_id string, uri string, "
           "refers_to string, payload binary, payload_bytes long, payload_digest string")
    return files.select("path", content.alias("content")).mapInArrow(run, ddl)
