"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a token target by weight, the targets become whole numbers of
equal-token blocks by highest quotients, each source's blocks are apportioned over
its shards in the same way, and a shard takes its quota by a seeded permutation of
its own blocks. Nothing but per-source and per-shard counts ever meets in one task: a row a source in
one, and a row of six numbers a shard of one source, some 50 MB for a source of 10^9 documents.
A text of any length is counted and cut within its own row.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; an empty table gives an empty result; repeated rows are rows of their own, each
with its own place; columns of the input are carried along, working columns start with
`__mix_`, so other names cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK_TOKENS = 16
SHARD_DOCS = 1000
SEED = 20240611
_STEP = 2654435761  # a prime above any shard's number of blocks


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes/(2k+1), at most `caps` each; ties go to the earlier entry.

    All quotients of at least d/2 with d = sum/seats are granted at once, which is a prefix
    of the order by quotient; single seats are then added or taken back at its end.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    got = np.minimum(np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64), caps)
    excess = int(got.sum()) - seats
    if excess > 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in np.flatnonzero(got)]
        heapq.heapify(heap)
        for _ in range(excess):
            i = -heap[0][1]
            got[i] -= 1
            if got[i]:
                heapq.heapreplace(heap, (votes[i] / (2 * got[i] - 1), -i))
            else:
                heapq.heappop(heap)
    elif excess < 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero((votes > 0) & (got < caps))]
        heapq.heapify(heap)
        for _ in range(-excess):
            i = heap[0][1]
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
            else:
                heapq.heappop(heap)
    return got


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: `__mix_sid`, `__mix_source_size`, `__mix_docs`, `__mix_target`.

    Targets are the fixed point of "cap, reshare the excess by weight": sources in order of
    cap / weight are capped until the level that the rest would get is below their own cap.
    """
    by_name = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    by_level = Window.orderBy("__mix_level", "__mix_sid")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__mix_sid") % len(weights) + 1).cast("int"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.col("__mix_level") <= F.col("__mix_line")
    left = F.col("__mix_all") - F.sum(F.when(capped, F.col("__mix_cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(capped, 0.0).otherwise(F.col("__mix_weight"))).over(everything)
    return (
        sizes.groupBy("__mix_source")
        .agg(F.sum("__mix_size").alias("__mix_source_size"), F.count("*").alias("__mix_docs"))
        .withColumn("__mix_sid", F.row_number().over(by_name) - 1)
        .withColumn("__mix_weight", weight)
        .withColumn("__mix_cap", cap * F.col("__mix_source_size"))
        .withColumn("__mix_level", F.col("__mix_cap") / F.col("__mix_weight"))
        .withColumn("__mix_all", share * F.sum("__mix_source_size").over(everything))
        .withColumn(
            "__mix_line",
            (F.col("__mix_all") - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0))) / F.sum("__mix_weight").over(onward),
        )
        .withColumn(
            "__mix_target",
            F.when(capped, F.col("__mix_cap")).otherwise(F.col("__mix_weight") * left / open_weight),
        )
        .select("__mix_source", "__mix_sid", "__mix_source_size", "__mix_docs", "__mix_target")
    )


def _source_seats(block: int):
    def seats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__mix_sid")
        target = pdf["__mix_target"].to_numpy(float)
        caps = 2 * -(-pdf["__mix_source_size"].to_numpy(np.int64) // block)
        return pdf.assign(__mix_seats=sainte_lague(target, int(round(target.sum() / block)), caps))

    return seats


def _shard_seats(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__mix_shard")
    got = sainte_lague(pdf["__mix_shard_size"].to_numpy(float), int(pdf["__mix_seats"].iloc[0]), 2 * pdf["__mix_blocks"].to_numpy(np.int64))
    return pdf.assign(__mix_quota=got)


def _seeded(*cols: str, seed: int) -> Column:
    """A number below 2^60 from a digest, which other engines can repeat."""
    named = F.concat_ws("/", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def plan_mix(
    docs: DataFrame,
    size: Column,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK_TOKENS,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """`docs` with its place in the mix: size, source size, target, `__mix_full` whole copies,
    and of one more pass over the shard the blocks b with pmod(step*b + shift, blocks) < rest.

    The one shuffle that carries the rows is by (source, shard); a source of any size is
    cut into shards of about `shard_docs` rows, so a hot source spreads over many tasks.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("__mix_size", size)
    facts = materialise(
        sized.select(F.col("source").alias("__mix_source"), F.col("doc_id").alias("__mix_doc"), "__mix_size"), "mix-sizes"
    )
    targets = source_targets(facts, weights, share, cap)
    schema = targets.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    sources = materialise(
        targets.groupBy().applyInPandas(_source_seats(block), f"{schema}, __mix_seats long"), "mix-sources"
    )
    shards_of = F.ceil(F.col("__mix_docs") / shard_docs)
    shard = F.pmod(_seeded("__mix_doc", "__mix_size", seed=seed), F.greatest(shards_of, F.lit(1))).cast("int")
    named = sources.withColumnRenamed("__mix_source", "__mix_s")
    per_shard = (
        facts.join(named, F.col("__mix_source").eqNullSafe(F.col("__mix_s")))
        .withColumn("__mix_shard", shard)
        .groupBy("__mix_sid", "__mix_shard", "__mix_seats")
        .agg(F.sum("__mix_size").alias("__mix_shard_size"))
        .withColumn("__mix_blocks", F.ceil(F.col("__mix_shard_size") / block).cast("long"))
    )
    quotas = materialise(
        per_shard.groupBy("__mix_sid").applyInPandas(
            _shard_seats,
            "__mix_sid int, __mix_shard int, __mix_seats long, __mix_shard_size long, __mix_blocks long, __mix_quota long",
        ),
        "mix-quotas",
    ).drop("__mix_seats")
    placed = (
        sized.withColumn("__mix_doc", F.col("doc_id"))
        .join(named, F.col("source").eqNullSafe(F.col("__mix_s")))
        .withColumn("__mix_shard", shard)
        .drop("__mix_s", "__mix_docs", "__mix_seats")
    )
    order = Window.partitionBy("__mix_sid", "__mix_shard").orderBy(_seeded("__mix_shard", "__mix_doc", seed=seed), "__mix_doc", "__mix_size")
    blocks = F.greatest(F.col("__mix_blocks"), F.lit(1))
    return (
        placed.withColumn("__mix_start", F.coalesce(F.sum("__mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(quotas, ["__mix_sid", "__mix_shard"])
        .withColumn("__mix_full", F.floor(F.col("__mix_quota") / blocks).cast("int"))
        .withColumn("__mix_rest", F.col("__mix_quota") % blocks)
        .withColumn("__mix_shift", F.pmod(_seeded("__mix_sid", "__mix_shard", seed=seed), blocks))
        .drop("__mix_doc")
    )


def _taken(block: int) -> Column:
    """Words of one row in the mix, repeats counted."""
    start, size = F.col("__mix_start"), F.col("__mix_size")
    end = start + size
    chosen = lambda b: F.pmod(b * _STEP + F.col("__mix_shift"), F.col("__mix_blocks")) < F.col("__mix_rest")
    overlap = lambda b: F.least(end, (b + 1) * block) - F.greatest(start, b * block)
    partial = F.aggregate(
        F.sequence(F.floor(start / block).cast("long"), F.floor((end - 1) / block).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(chosen(b), overlap(b)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(size > 0, F.col("__mix_full") * size + F.when(F.col("__mix_rest") > 0, partial).otherwise(0)).otherwise(0).cast("long")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix_report(docs: DataFrame, block: int = BLOCK_TOKENS, **options) -> DataFrame:
    """One row a document: size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("__mix_size"))
    planned = plan_mix(materialise(sized, "mix-words"), F.col("__mix_size"), block=block, **options)
    return planned.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        _taken(block).alias("taken"),
        "source",
    )


def _pieces(block: int):
    import regex

    word = regex.compile(rb"[^\x20\x09-\x0D]+")

    def cut(text: str, start: int, size: int, full: int, blocks: int, rest: int, shift: int) -> list[str]:
        if not size:
            return []
        out = [text] * full
        if not rest:
            return out
        raw = text.encode()
        first, last = start // block, (start + size - 1) // block
        chosen = (np.arange(first, last + 1, dtype=np.int64) * _STEP + shift) % blocks < rest
        if chosen.all():
            return [*out, text]
        if not chosen.any():
            return out
        spans = [m.span() for m in word.finditer(raw)]
        runs, b = [], 0
        while b < len(chosen):
            if chosen[b]:
                e = b
                while e + 1 < len(chosen) and chosen[e + 1]:
                    e += 1
                lo, hi = max(start, (first + b) * block) - start, min(start + size, (first + e + 1) * block) - start
                runs.append(raw[spans[lo][0] : spans[hi - 1][1]].decode())
                b = e
            b += 1
        return [*out, "\n".join(runs)]

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series, start: pd.Series, size: pd.Series, full: pd.Series, blocks: pd.Series, rest: pd.Series, shift: pd.Series) -> pd.Series:
        return pd.Series([cut(*row) for row in zip(text, start, size, full, blocks, rest, shift)], dtype=object)

    return pieces


def mix_documents(docs: DataFrame, block: int = BLOCK_TOKENS, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each whole copy that is taken and one
    for the chosen blocks of a partial pass (runs of neighbouring blocks keep their own white
    space and are joined by a line feed). A document whose blocks are not chosen, or without words, gives no row."""
    planned = plan_mix(docs, word_count(F.col("text")), block=block, **options)
    parts = _pieces(block)("text", *(f"__mix_{c}" for c in ("start", "size", "full", "blocks", "rest", "shift")))
    mixed = planned.withColumn("__mix_text", F.explode(parts))
    new = {"text": F.col("__mix_text"), "n_chars": F.length("__mix_text").cast("long")}
    return mixed.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


# Quotients are listed and ranked, and blocks are walked one by one.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), c AS (
  SELECT *, [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][sid % 3 + 1] AS weight, 2::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole FROM w
), l AS (
  SELECT *, cap / weight <= (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM c
), t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE weight * (whole - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM l
), q AS (
  SELECT sid, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid) AS place
  FROM (SELECT sid, target, unnest(range(0, CAST(2 * ceil(source_size / 16) AS BIGINT))) AS k FROM t WHERE target > 0)
), s AS (
  SELECT sid, count(*) AS seats FROM q WHERE place <= (SELECT CAST(round_even(sum(target) / 16, 0) AS BIGINT) FROM t) GROUP BY sid
), p AS (
  SELECT d.*, t.sid, t.source_size, t.target, coalesce(s.seats, 0) AS seats,
    CAST('0x' || substr(md5('20240611/' || doc_id || '/' || size), 1, 15) AS BIGINT) % greatest(CAST(ceil(docs / 1000) AS BIGINT), 1) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN s ON s.sid = t.sid
), h AS (
  SELECT sid, shard, seats, sum(size) AS shard_size, CAST(ceil(sum(size) / 16) AS BIGINT) AS blocks FROM p GROUP BY sid, shard, seats
), z AS (
  SELECT sid, shard, seats, row_number() OVER (PARTITION BY sid ORDER BY shard_size / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT *, unnest(range(0, 2 * blocks)) AS k FROM h)
), u AS (
  SELECT h.sid, h.shard, greatest(blocks, 1) AS blocks, coalesce(n, 0) AS quota, CAST('0x' || substr(md5('20240611/' || h.sid || '/' || h.shard), 1, 15) AS BIGINT) % greatest(blocks, 1) AS shift
  FROM h LEFT JOIN (SELECT sid, shard, count(*) AS n FROM z WHERE place <= seats GROUP BY sid, shard) x ON x.sid = h.sid AND x.shard = h.shard
), o AS (
  SELECT p.*, u.blocks, u.quota // u.blocks AS whole_passes, u.quota % u.blocks AS rest, u.shift, CAST(sum(size) OVER (
    PARTITION BY p.sid, p.shard ORDER BY CAST('0x' || substr(md5('20240611/' || p.shard || '/' || doc_id), 1, 15) AS BIGINT), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS until
  FROM p JOIN u ON p.sid = u.sid AND p.shard = u.shard
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, source, CAST(whole_passes * size + coalesce(CASE WHEN size > 0 THEN list_sum(list_transform(range((until - size) // 16, (until - 1) // 16 + 1), lambda b:
  CASE WHEN (b * 2654435761 + shift) % blocks < rest THEN least(until, (b + 1) * 16) - greatest(until - size, b * 16) ELSE 0 END)) END, 0) AS BIGINT) AS taken
FROM o
"""
