"""Media columns: TIFF.

The reader walks the chain of image directories, inflates strips or tiles (raw, PackBits,
LZW or deflate), undoes the horizontal predictor and gives one page a directory. The
writer makes such files from bytes, so that media columns can be made and checked here
without an image library. Only 8-bit samples are read; what is not is an error.

Defined cases: a null or empty media value has no pages; a broken file raises ValueError
with what is wrong (or, with `on_error="null"`, gives one row with `tiff_error`); repeated
rows give repeated pages; columns of the input are carried along, and columns of the result
start with `tiff_`. A text of any length becomes one file of pages of PAGE_ROWS rows; a task holds one file and the
pixels of its pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.batches import slices

from .common import read

# Tags and compressions of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}

PAYLOAD_UNIT = 192
PAGE_ROWS = 512
STRIP_ROWS = 128
HELD_BYTES = 4 << 20


# -- codecs -----------------------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def pack_bits(data: bytes, width: int | None = None) -> bytes:
    """Runs of three and more are written as runs; what lies between as literals of up to 128 bytes. Each row of
    `width` bytes is packed by itself, as the format wants it."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    width = width or len(a)
    rows = np.arange(0, len(a) + 1, width)
    edges = np.union1d(np.flatnonzero(np.diff(a)) + 1, rows)
    long = np.flatnonzero(np.diff(edges) >= 3)
    runs, out, at = iter([*zip(edges[long].tolist(), edges[long + 1].tolist()), (len(a), len(a))]), [], 0

    def literal(end: int) -> None:
        nonlocal at
        while at < end:
            stop = min(end, at + 128)
            out.append(bytes((stop - at - 1,)) + data[at:stop])
            at = stop

    begin, end = next(runs)
    for stop in rows[1:].tolist():
        while begin < stop:
            literal(begin)
            while end - at >= 2:
                k = min(128, end - at)
                out.append(bytes((257 - k, data[at])))
                at += k
            literal(end)
            begin, end = next(runs)
        literal(stop)
    return b"".join(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; codes grow one entry early, as the format has it."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(base), 9, 0, 0, None, []
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("TIFF: LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table, size, width, prefix = {bytes((i,)): i for i in range(256)}, 258, 9, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        codes.append((table[prefix], width))
        table[longer] = size
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        prefix = data[i : i + 1]
    if prefix:
        codes.append((table[prefix], width))
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    codes.append((257, width))
    held = bits = 0
    out = bytearray()
    for code, width in codes:
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise ValueError(f"TIFF: deflate: {e}") from e


# Decoders by compression, and encoders of (bytes, row width).
DECODE = {RAW: bytes, PACKBITS: unpack_bits, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
ENCODE = {RAW: lambda data, _: data, PACKBITS: pack_bits, LZW: lambda data, _: lzw_encode(data), DEFLATE: lambda data, _: zlib.compress(data, 1)}


# -- reading ----------------------------------------------------------------------------


@dataclass
class Page:
    number: int
    pixels: np.ndarray  # rows x columns x samples
    compression: int
    tiled: bool


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directory chain."""
    if not data:
        return
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("TIFF: no header")
    order = "<" if data[:2] == b"II" else ">"
    at, number, seen = _unpack(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen:
            raise ValueError("TIFF: directories form a loop")
        seen.add(at)
        tags = {}
        count = _unpack(order + "H", data, at)[0]
        for i in range(count):
            tag, kind, n = _unpack(order + "HHI", data, at + 2 + 12 * i)
            if kind in _TYPES:
                form = f"{order}{n}{_TYPES[kind]}"
                where = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    where = _unpack(order + "I", data, where)[0]
                tags[tag] = _unpack(form, data, where)
        yield _page(data, tags, number)
        at, number = _unpack(order + "I", data, at + 2 + 12 * count)[0], number + 1


def _unpack(form: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from(form, data, at)
    except struct.error as e:
        raise ValueError(f"TIFF: cut off: {e}") from e


def _page(data: bytes, tags: dict, number: int) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if width is None or height is None:
        raise ValueError("TIFF: no size")
    if any(b != 8 for b in tags.get(BITS, (1,))) or (samples > 1 and one(PLANAR, 1) != 1):
        raise ValueError("TIFF: only 8-bit samples side by side are read")
    method, predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if method not in DECODE or predictor not in (1, 2):
        raise ValueError(f"TIFF: compression {method}, predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        cell_w, cell_h, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        cell_w, cell_h = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    across, down = -(-width // cell_w), -(-height // cell_h) if cell_h else 0
    if len(offsets) != across * down or len(counts) != len(offsets):
        raise ValueError("TIFF: strips or tiles are missing")
    pixels = np.empty((height, width, samples), np.uint8)
    for i, (offset, n) in enumerate(zip(offsets, counts)):
        top, left = i // across * cell_h, i % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - top)
        raw = DECODE[method](data[offset : offset + n])
        if len(raw) < rows * cell_w * samples:
            raise ValueError("TIFF: a strip or tile is short")
        cell = np.frombuffer(raw, np.uint8, rows * cell_w * samples).reshape(rows, cell_w, samples)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=np.uint8)
        part = pixels[top : top + rows, left : left + cell_w]
        part[:] = cell[: part.shape[0], : part.shape[1]]
    return Page(number, pixels, method, tiled)


# -- writing ----------------------------------------------------------------------------


def write_pages(pages: list[np.ndarray], method: int, predictor: int = 1, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit grey pages in strips, or in tiles of (width, height)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        cell_w, cell_h = tile or (width, min(STRIP_ROWS, height))
        offsets, counts = [], []
        for top in range(0, height, cell_h):
            for left in range(0, width, cell_w):
                cell = page[top : top + cell_h, left : left + cell_w]
                if tile and cell.shape != (cell_h, cell_w):
                    cell = np.pad(cell, ((0, cell_h - cell.shape[0]), (0, cell_w - cell.shape[1])))
                if predictor == 2:
                    cell = np.diff(cell, axis=1, prepend=np.uint8(0))
                packed = ENCODE[method](np.ascontiguousarray(cell).tobytes(), cell.shape[1])
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [method]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            entries += [(TILE_WIDTH, 4, [cell_w]), (TILE_LENGTH, 4, [cell_h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [cell_h]), (STRIP_COUNTS, 4, counts)]
        packed = []
        for tag, kind, values in sorted(entries):
            value = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, place = struct.pack("<I", len(out)), value
                out += place
            packed.append(struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + 12 * len(packed)
        out += struct.pack("<H", len(packed)) + b"".join(packed) + b"\0\0\0\0"
    return bytes(out)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes with spaces up to a positive multiple of PAYLOAD_UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b" ")


def encode_payload(payload: bytes) -> bytes:
    """The payload as pages of 192 columns. Layout and compression follow from the payload alone:
    by its CRC one in eight goes to LZW in strips, two to PackBits in tiles, the rest to deflate
    with predictor in strips or tiles."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_UNIT)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    choice = zlib.crc32(payload) % 8
    if choice == 0:
        return write_pages(pages, LZW)
    if choice <= 2:
        return write_pages(pages, PACKBITS, tile=(64, 64))
    return write_pages(pages, DEFLATE, predictor=2, tile=(96, 128) if choice == 3 else None)


def add_media(docs: DataFrame) -> DataFrame:
    """`docs` with `tiff_media`, each whole text stored as TIFF, and `tiff_n_bytes`."""
    docs = docs.drop("tiff_media", "tiff_n_bytes")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [padded(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([encode_payload(p) for _, p in texts], pa.binary()), pa.array([n for n, _ in texts], pa.int64())],
                names=[*batch.schema.names, "tiff_media", "tiff_n_bytes"],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("tiff_media", T.BinaryType()), T.StructField("tiff_n_bytes", T.LongType())]))


_PAGE_FIELDS = [
    T.StructField("tiff_page", T.IntegerType()),
    T.StructField("tiff_pages", T.IntegerType()),
    T.StructField("tiff_width", T.IntegerType()),
    T.StructField("tiff_height", T.IntegerType()),
    T.StructField("tiff_samples", T.IntegerType()),
    T.StructField("tiff_compression", T.IntegerType()),
    T.StructField("tiff_tiled", T.BooleanType()),
    T.StructField("tiff_pixels", T.BinaryType()),
    T.StructField("tiff_error", T.StringType()),
]


def explode_pages(media: DataFrame, column: str = "tiff_media", on_error: str = "raise") -> DataFrame:
    """One row a page, without the media column. Rows of a file stay together and in order, and results
    are handed on at HELD_BYTES of pixels, so memory is bounded by the largest file."""
    kept = [f for f in media.schema.fields if f.name != column and f.name not in {p.name for p in _PAGE_FIELDS}]
    schema = T.StructType([*kept, *_PAGE_FIELDS])

    def filled(batch, picked, rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        base = batch.select([f.name for f in kept]).take(pa.array(picked, pa.int64()))
        columns = list(zip(*rows)) or [()] * len(_PAGE_FIELDS)
        arrays = [pa.array(c, out.field(p.name).type) for c, p in zip(columns, _PAGE_FIELDS)]
        return pa.RecordBatch.from_arrays([*base.columns, *arrays], schema=out)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, column)):
            files = batch.column(batch.schema.get_field_index(column)).to_pylist()
            picked, rows, held = [], [], 0
            for i, data in enumerate(files):
                try:
                    pages = list(read_pages(data or b""))
                except ValueError as e:
                    if on_error != "null":
                        raise
                    rows.append((None,) * 8 + (str(e),))
                    picked.append(i)
                    continue
                for p in pages:
                    rows.append((p.number, len(pages), p.pixels.shape[1], p.pixels.shape[0], p.pixels.shape[2], p.compression, p.tiled, p.pixels.tobytes(), None))
                    picked.append(i)
                    held += p.pixels.size
                    if held > HELD_BYTES:
                        yield filled(batch, picked, rows)
                        picked, rows, held = [], [], 0
            yield filled(batch, picked, rows)

    return media.mapInArrow(run, schema)


def _features(counts: np.ndarray) -> str:
    """From how often each sample is: mean and deviation of the samples, and the share of each quarter of the range, in thousandths."""
    n, level = int(counts.sum()), np.arange(256)
    mean = int((counts * level).sum()) / n
    deviation = max(0.0, int((counts * level * level).sum()) / n - mean * mean) ** 0.5
    return ",".join([f"{mean:.3f}", f"{deviation:.3f}", *(str(int(q) * 1000 // n) for q in counts.reshape(4, 64).sum(axis=1))])


def file_digests(media: DataFrame) -> DataFrame:
    """A row a file: digests and features over the rows that `explode_pages` gives of it. They come
    together and in the order of pages, so they are summed up as they come and nothing is shuffled."""
    files = media.select("doc_id", "tiff_n_bytes", F.octet_length("tiff_media").cast("long").alias("media_bytes"), F.sha2("tiff_media", 256).alias("media_sha256"), "tiff_media")
    pages = explode_pages(files)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]

    def run(batches):
        due = 0  # the page that comes next
        for batch in (part for whole in batches for part in slices(whole, "tiff_pixels")):
            rows = []
            for doc, n, size, sha, page, of, pixels in zip(*(c.to_pylist() for c in batch.columns)):
                if page != due:
                    raise ValueError(f"TIFF: page {page} came where page {due} was due")
                if page == 0:
                    digest, length, tail, counts = hashlib.sha256(), 0, b"", np.zeros(256, np.int64)
                digest.update(pixels)
                length += len(pixels)
                tail = (tail + pixels[-16:])[-16:]
                counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                due = page + 1
                if due == of:
                    rows.append((doc, n, length, digest.hexdigest(), zlib.crc32(tail), size, sha, _features(counts), of))
                    due = 0
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if due:
            raise ValueError("TIFF: the last pages of a file did not come")

    doc = media.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "tiff_n_bytes", "media_bytes", "media_sha256", "tiff_page", "tiff_pages", "tiff_pixels").mapInArrow(
        run,
        f"doc_id {doc}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long",
    )


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_digests(add_media(read(spark, sf_dir, "documents").select("doc_id", "text")))
