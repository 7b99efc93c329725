"""WARC archives: writer, normaliser and reader.

Pages are written as records into archives that are one gzip stream each. The normaliser
inflates such a stream once, from beginning to end, writes every record as a gzip member
of its own and an offset index beside it; the reader then takes each record by its place
in the index, without what stands before it.

An archive is a row (name, bytes) of a table in the shared folder, of bounded size, so
executors need no common file system but Spark's; normalise() itself works on streams.

Of records with equal payloads the smallest page_id is the response and the others are
revisits without payload, which name it. Payloads below `min_bytes` are never revisits.

Defined cases: null html is an empty payload; null url leaves the target out; a null page_id
is never named by a revisit if its payload has another id, and is a response only where all
its group's ids are null; repeated rows of the naming id are responses each; an empty table
gives empty archives and no rows; other columns are ignored. A page of any length is one record; a task holds one record
and the archive it writes.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.batches import slices

from .common import discard, materialise, read

ARCHIVE_BYTES = 4_000_000  # of records, before compression
MIN_BYTES = 0
LEVEL = 1
_CHUNK = 1 << 16
_END = b"\r\n\r\n"


# -- records ----------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_urn(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("WARC: a record does not begin where it should")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


# -- the normaliser ---------------------------------------------------------------------


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members, piece by piece."""
    stream, fresh = zlib.decompressobj(31), True
    while data := source.read(_CHUNK):
        while data:
            if stream.eof:
                stream, fresh = zlib.decompressobj(31), True
            if piece := stream.decompress(data):
                yield piece
            fresh, data = False, stream.unused_data
    if not fresh and not stream.eof:
        raise ValueError("WARC: the gzip stream is cut off")


def normalise(source: BinaryIO, target: BinaryIO, level: int = LEVEL) -> list[tuple[int, int, str, str]]:
    """Rewrite the records of one gzip stream as members of their own; returns the index, a row
    (offset, length, type, record id) a record. Holds one record at a time."""
    index, held, offset = [], bytearray(), 0
    pieces = _inflated(source)

    def fill(n: int) -> bool:
        while len(held) < n:
            if (piece := next(pieces, None)) is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        while (end := held.find(_END)) < 0:
            if not fill(len(held) + 1):
                raise ValueError("WARC: a record's head is cut off")
        fields = parse_head(bytes(held[:end]))
        size = end + len(_END) + int(fields["content-length"]) + len(_END)
        if not fill(size):
            raise ValueError("WARC: a record is cut off")
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = packer.compress(bytes(held[:size])) + packer.flush()
        del held[:size]
        target.write(member)
        index.append((offset, len(member), fields["warc-type"], fields["warc-record-id"]))
        offset += len(member)
    return index


def read_record(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and block of the record at a place of the index."""
    raw = zlib.decompress(data[offset : offset + length], 31)
    end = raw.index(_END)
    fields = parse_head(raw[:end])
    return fields, raw[end + len(_END) : end + len(_END) + int(fields["content-length"])]


# -- tables -----------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, revisit, refers_to. Only payloads met more than once take part in a join,
    and their first ids are found by a partial aggregation, so one payload may hold any share of rows."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "key", F.unhex(F.sha1(F.encode("html", "utf-8")))
    )
    shared = (
        keyed.where(F.octet_length("html") >= min_bytes)
        .groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1")
        .select(F.col("key").alias("shared_key"), F.col("first"))
    )
    joined = keyed.join(shared, F.col("key") == F.col("shared_key"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip stream each: archive, data. A task packs its own rows."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        packer, packed, size = None, [], 0

        def close():
            nonlocal packer, packed, size, number
            data = b"".join([*packed, packer.flush()])
            name = f"pages-{task:06d}-{number:06d}.warc.gz"
            packer, packed, size, number = None, [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in (part for whole in batches for part in slices(whole, "html")):
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                page_id, url, html, revisit, refers_to = row
                raw = record(page_id, url, html.encode(), refers_to, revisit)
                packer = packer or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed.append(packer.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
        if packer:
            yield close()

    return records.mapInArrow(run, "archive string, data binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """archive, data (a member a record) and the side index of its records."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string())]))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "data")):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = io.BytesIO()
                index = normalise(io.BytesIO(data), target)
                rows = [dict(zip(("offset", "length", "type", "record_id"), entry)) for entry in index]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([target.getvalue()], pa.binary()), pa.array([rows], kind)], names=["archive", "data", "index"]
                )

    return archives.select("archive", "data").mapInArrow(
        run, "archive string, data binary, index array<struct<offset: long, length: long, type: string, record_id: string>>"
    )


_RECORD = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_PLACE = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]


def read_archives(normalised: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row a record, each taken by its place among the entries that its archive carries. Digest and size of a
    response come from the payload as read, and must be the head's; those of a revisit from its heads.

    With the side index, a record is found only if that lists it at this place under its id. Places are joined, which
    are small; archives do not move."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "data")):
            for name, data, entries in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for place in entries:
                    fields, block = read_record(data, place["offset"], place["length"])
                    head, _, payload = block.partition(_END)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if fields["warc-type"] == "response" and (digest(payload) != said or len(payload) != size):
                        raise ValueError(f"WARC: {fields['warc-record-id']} is not what its head says")
                    rows.append(
                        (_of_urn(fields["warc-record-id"]), size, said, fields["warc-type"], _of_urn(fields.get("warc-refers-to")), name, place["offset"], place["length"], fields["warc-record-id"])
                    )
                kinds = [*_RECORD, *_PLACE]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=[n for n, _ in kinds])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, record_id string"
    found = normalised.select("archive", "data", "index").mapInArrow(run, schema)
    places = [n for n, _ in _PLACE]
    if index is not None:
        found = found.join(index.select(*places).hint("merge"), places)
    return found.drop(*places)


def write_normalised(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """The normalised archives as a table in the shared folder, and the side index as another."""
    once = materialise(write_archives(plan_records(pages, min_bytes)), "warc-streams")
    normalised = materialise(normalise_archives(once), "warc-members")
    discard(once)
    index = materialise(normalised.select("archive", F.inline("index")), "warc-index")
    return normalised, index


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(*write_normalised(read(spark, sf_dir, "pages")))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT html, min(page_id) AS first FROM p GROUP BY html
), d AS (
  SELECT p.page_id, p.html, f.first,
    list_transform(range(0, 32), lambda i: list_reduce(list_prepend(0, list_transform(range(i * 5, i * 5 + 5), lambda b:
      ((strpos('0123456789abcdef', substr(sha1(p.html), (b // 4 + 1)::INT, 1)) - 1) >> (3 - b % 4)::INT) & 1)), lambda a, x: a * 2 + x)) AS quintets
  FROM p JOIN f ON p.html = f.html
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(quintets, lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
