"""WARC archives: written a gzip member per record, read back sequentially.

An archive is a sequence of byte chunks in shared storage, as rows (archive, part,
data), so that any store Spark can read will do. The reader goes through the chunks
of one archive in order, decompresses a member at a time and frames the record by its
Content-Length. It checks both digests. An archive is closed at ``archive_bytes``, so
the chunks one task reads in order are bounded however large the table is.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import stored

ARCHIVE_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
ID = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "archive string, part int, data binary"
RECORDS = (
    "archive string, record_id string, record_type string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)


def _sha1(*parts: bytes) -> str:
    digest = hashlib.sha1()
    for part in parts:
        digest.update(part)
    return base64.b32encode(digest.digest()).decode()


def _member(headers: list[tuple[str, str]], *block: bytes) -> bytes:
    """A whole record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {sum(map(len, block))}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [pack.compress(x) for x in (b"WARC/1.1\r\n", head.encode(), *block, b"\r\n\r\n")]
    return b"".join(parts) + pack.flush()


def page_record(record: str, uri: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit that keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [http] if refers_to is not None else [http, payload]
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{record}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + _sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + _sha1(*block)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return _member(headers, *block)


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each member; ValueError at the first damage."""
    unpack, raw, open_ = zlib.decompressobj(31), bytearray(), False
    for chunk in chunks:
        while chunk:
            open_ = True  # a member's first bytes give none of its content
            try:
                raw += unpack.decompress(chunk)
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from e
            chunk = unpack.unused_data
            if unpack.eof:
                yield _framed(bytes(raw))
                unpack, raw, open_ = zlib.decompressobj(31), bytearray(), False
            else:
                chunk = b""
    if open_:
        raise ValueError("the last member is cut off")


def _framed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("a member does not hold a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers.get("content-length", "-1"))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: the block is not {length} bytes")
    block = rest[:length]
    if (said := headers.get("warc-block-digest")) and said != "sha1:" + _sha1(block):
        raise ValueError(f"{headers.get('warc-record-id')}: the block has another digest")
    return headers, block


def _page(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, bytes]:
    """Bytes and digest of the whole payload, and the payload that is here.

    What a foreign record does not state is taken from a response's payload, and is null for
    a revisit, whose payload is elsewhere; only what is stated can be compared. A payload is
    what follows the HTTP headers, in whichever transfer coding it was stored.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    stated = fields.get("content-length")
    if stated is not None and not (stated.isascii() and stated.isdigit()):
        raise ValueError(f"{headers.get('warc-record-id')}: {stated!r} is no length")
    size, digest = None if stated is None else int(stated), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if headers["warc-type"] == "response":
        if (size is not None and len(payload) != size) or (digest is not None and ":" not in digest and _sha1(payload) != digest):
            raise ValueError(f"{headers.get('warc-record-id')}: the payload has another length or digest")
        return len(payload), digest or _sha1(payload), payload
    return size, digest, payload


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``record``, ``uri``, ``payload`` and ``refers_to`` of each row of page_id, url, html.

    Equality is length and SHA-1 of the payload in UTF-8. Only digests are grouped, with
    partial counts, so a payload that a third of all pages share is one row per task; the
    payloads that do repeat are stored, and joined by broadcast when Spark measures them
    small, else by a join it can split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id"), F.col("url"), payload.alias("payload"),
        F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"),
    )
    repeated = stored(
        rows.groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("size") >= min_bytes))
        .drop("n"),
        "warc-repeated",
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.join(repeated, ["digest", "size"], "left").select(
        F.col("page_id").cast("string").alias("record"),
        F.col("url").alias("uri"),
        "payload",
        F.when(later, F.col("first")).cast("string").alias("refers_to"),
    )


def write_warc(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows of ``pages`` (page_id, url, html), stored; one record per row.

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest
    page_id are responses and the others revisits of it. A null page_id counts as larger
    than any other. Null html is an empty payload; a null url is the record's own id; line
    breaks in a url are percent-encoded. Repeated rows of the smallest page_id are all
    responses. Other columns are not read. An empty table gives no records.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, part, size, held = TaskContext.get().partitionId(), 0, 0, 0, bytearray()

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"pages-{task:06d}-{number:05d}.warc.gz"]), pa.array([part], pa.int32()), pa.array([bytes(held)])],
                ["archive", "part", "data"],
            )

        for batch in batches:
            for record, uri, payload, refers_to in zip(*batch.columns, strict=True):
                record = record.as_py() or "null"
                uri = (uri.as_py() or f"{ID}{record}").replace("\r", "%0D").replace("\n", "%0A")
                held += page_record(record, uri, payload.as_py(), refers_to.as_py(), date)
                if len(held) >= CHUNK_BYTES:
                    yield chunk()
                    part, size = part + 1, size + len(held)
                    held.clear()
                    if size >= archive_bytes:
                        number, part, size = number + 1, 0, 0
        if held:
            yield chunk()

    return stored(mark_revisits(pages, min_bytes).mapInArrow(archives, CHUNKS), "warc", compression="none")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of ``.warc.gz`` files, each a chunk (Spark reads files of up to 2 GB so)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("archive"), F.lit(0).alias("part"), F.col("content").alias("data"))


def read_warc(chunks: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per response and revisit in the archives; other record types are passed over.

    ``payload`` is null for revisits, and for all where ``payloads`` is false. Damage in
    an archive fails the job with the archive's name.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in RECORDS.split(", ")])

        for name, data in _by_archive(batches):
            try:
                for headers, block in read_records(data):
                    if (kind := headers.get("warc-type")) in ("response", "revisit"):
                        size, digest, payload = _page(headers, block)
                        own, other = (headers.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to"))
                        kept = payload if payloads and kind == "response" else None
                        rows.append((name, own, kind, headers.get("warc-target-uri"), size, digest, other, kept))
                        held += len(kept or b"")
                        if len(rows) >= 5000 or held >= CHUNK_BYTES * 8:
                            yield batch()
                            rows, held = [], 0
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from e
        if rows:
            yield batch()

    return chunks.repartition("archive").sortWithinPartitions("archive", "part").mapInArrow(records, RECORDS)


def _by_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The chunks of one archive after another, of rows sorted by archive and part."""
    rows = ((a.as_py(), d) for b in batches for a, d in zip(b.column("archive"), b.column("data"), strict=True))
    row = next(rows, None)

    def chunks(name: str) -> Iterator[bytes]:
        nonlocal row
        while row is not None and row[0] == name:
            yield row[1].as_py()
            row = next(rows, None)

    while row is not None:
        yield row[0], (own := chunks(row[0]))
        for _ in own:
            pass
