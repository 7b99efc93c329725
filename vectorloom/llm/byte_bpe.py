"""Byte-level BPE encoding and decoding from a rank file.

A text is cut into pieces by the vocabulary's pattern. Within a piece a segment tree over
byte positions holds, for each live part, the rank of the pair that it forms with its
right neighbour; the root is the leftmost pair of least rank, and a merge updates three
leaves, so a piece of n bytes takes O(n log n) however long it is.

Pieces repeat, so their ids are remembered, in a store bounded by bytes.

Defined cases: null text is empty; empty text has no ids; special tokens' strings are
ordinary text; repeated rows are encoded alike; other columns are carried along; the
results are `bpe_ids` (32-bit little-endian) and `bpe_bytes`, which replace such columns.
"""

from __future__ import annotations

import base64
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.batches import slices

from .common import read

_NONE = 1 << 62
_FAN = 16
# What a worker remembers: two generations of pieces of up to _LONGEST_KEPT characters, 40 MB each.
_STORE_BYTES, _ENTRY_BYTES, _LONGEST_KEPT = 40 << 20, 220, 64
_LONG_TEXT = 1 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece by merging the leftmost pair of least rank until none has a rank.

    The tree's nodes have 16 children each, so the pieces of prose, of up to 16 bytes, are
    a single node, and one of n bytes has log16(n) levels to refresh after a merge.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    after = list(range(1, n + 2))  # where the part that begins here ends, and the next begins
    before = list(range(-1, n))
    leaves = [_NONE] * n
    for at in range(n - 1):
        # rank and position of a pair in one number: least rank first, then leftmost
        if (rank := rank_of(piece[at : at + 2])) is not None:
            leaves[at] = rank << 32 | at
    levels = [leaves]
    while len(levels[-1]) > _FAN:
        below = levels[-1]
        levels.append([min(below[i : i + _FAN]) for i in range(0, len(below), _FAN)])
    top, upper = levels[-1], levels[1:]
    while (least := min(top)) != _NONE:
        at = least & 0xFFFFFFFF
        gone = after[at]
        end = after[at] = after[gone]
        leaves[gone] = leaves[at] = _NONE
        if end < n:
            before[end] = at
            if (stop := after[end]) - at <= longest and (rank := rank_of(piece[at:stop])) is not None:
                leaves[at] = rank << 32 | at
        left = before[at]
        if left >= 0:
            rank = rank_of(piece[left:end]) if end - left <= longest else None
            leaves[left] = _NONE if rank is None else rank << 32 | left
        if upper:
            for changed in (left, at, gone):
                below, i = leaves, changed
                for level in upper if changed >= 0 else ():
                    i //= _FAN
                    level[i] = min(below[i * _FAN : i * _FAN + _FAN])
                    below = level
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Store(dict):
    """Ids of pieces, computed on first use. When it has about _STORE_BYTES it becomes the elder generation, whose
    pieces still in use are taken over. Long pieces are not kept."""

    def __init__(self, compute):
        self.compute, self.elder, self.room = compute, {}, _STORE_BYTES

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.elder.get(piece)) is None:
            ids = self.compute(piece)
            if len(piece) > _LONGEST_KEPT:
                return ids
        self.room -= _ENTRY_BYTES + 4 * len(piece) + len(ids)
        if self.room < 0:
            self.elder, self.room = dict(self), _STORE_BYTES
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern must not have groups: each match is a piece")
        self.piece_ids = _Store(lambda piece: b"".join(i.to_bytes(4, "little") for i in merge(piece.encode(), ranks, self.longest)))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit little-endian numbers. The pieces of a long text are taken some at a time."""
        ids_of = self.piece_ids.__getitem__
        if len(text) <= _LONG_TEXT:
            return b"".join(map(ids_of, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while some := b"".join(map(ids_of, islice(found, 100_000))):
            out.append(some)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker process, kept between its tasks."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `bpe_ids` and `bpe_bytes`, the latter decoded from the ids. The rank file is read
    on the driver and broadcast: some 50,000 entries, under 1 MB, whatever the corpus."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    docs = docs.drop("bpe_ids", "bpe_bytes")

    def run(batches):
        codec = _codec(shared.value, pattern)
        for batch in (part for whole in batches for part in slices(whole, text)):
            ids = [codec.encode(s or "") for s in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            back = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                names=[*batch.schema.names, "bpe_ids", "bpe_bytes"],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("bpe_ids", T.BinaryType()), T.StructField("bpe_bytes", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_decode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
