"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is their hash order; it is cut into fragments, the overlap of a
pair is counted in each fragment separately, and the counts are summed per pair. Two
sets link when 100 * |intersection| >= percent * |union|.

Which pairs are counted follows from exact filters alone, so no link is lost:

1. Documents of equal sets, by a digest of 128 bits, are one set, with the least doc_id as representative.
2. A set that links cannot have more than (100 - percent) % n-grams found nowhere else. N-grams
   of the first quarter of the order are counted first; sets that fail on these alone are done.
3. Of the rest, which are numbered, each n-gram's number of sets is counted. A linked pair shares an
   n-gram among each one's rarest (prefix filter); sets that share one and are of like
   length follow the same leader.
4. A leader's group never pairs its members with each other. All are compared with one leader, and for
   two members x, y with deviations X, Y from the leader |x ^ y| = |X| + |Y| - 2 |X & Y|
   (^ is symmetric difference). So either |X| + |Y| is small enough that they link
   for certain, and then both also link with the member of least deviation, or they must
   share deviations, which are joined by prefix filter in turn. N-grams that the
   whole group has in common, however large it is, take no part in that.

Then links give components. Two n-grams of one pair of sets count as common if their 64-bit hashes are equal,
so overlaps are exact unless n-grams of these two sets collide.

A group may hold any share of the sets: comparisons with the leader are dealt by pairs, best members are found by
partial aggregation, and deviations are dealt by leader and n-gram, never by leader alone.

Defined cases: null or blank text has the empty set and links with nothing; fewer than `size`
words are one n-gram; repeated rows and equal texts share a component, and so do rows of one
doc_id with different texts as far as links go; sets of rows without doc_id are compared like others and link
them, and such rows have the component of their group, which is null where no row of it has a doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.batches import slices

from .common import discard, materialise, read
from .components import connected_components
from .shingles import shingle_sets

SIZE = 4
PERCENT = 85
FRAGMENTS = 4
_QUARTER = np.uint64(1 << 62)
_DIGEST = ["__join_s1", "__join_s2"]
_MISSING = 1 << 40  # deviations that are missing come after all that are added


def _set_id(hashes: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """A set's digest of 128 bits as two numbers; none for the empty set."""
    if not len(hashes):
        return None, None
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _texts(batches, column: int | str):
    """Batches of bounded texts, with the texts."""
    for whole in batches:
        for batch in slices(whole, column, rows=256, size=1 << 20):
            yield batch, batch.column(column).to_pylist()


def document_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n (set size), s1, s2 (the set's digest; null if empty), low (its hashes in the first quarter)."""
    doc = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in _texts(batches, "text"):
            sets = shingle_sets(texts, size)
            ids = [_set_id(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1)),
                    pa.array([s[s < _QUARTER].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "s1", "s2", "low"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, n long, s1 long, s2 long, low array<long>")


def _spare(n: Column, percent: int) -> Column:
    """How many n-grams of a set of n may be outside a set it links with."""
    return F.floor(n * (100 - percent) / 100)


def survivors(sets: DataFrame, percent: int) -> DataFrame:
    """s1, s2, n, rep, copies (rows of rep with this set) of the sets whose n-grams in the first quarter do not
    rule out every link."""
    named = sets.where("s1 is not null")
    rows = named.groupBy("s1", "s2", "n", "doc_id").agg(F.count("*").alias("k"))
    by_set = rows.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("k", "doc_id").alias("copies"))
    low = named.select("s1", "s2", F.explode("low").alias("h")).groupBy("h")
    alone = low.agg(*(f(c).alias(f"{m}{c}") for c in ("s1", "s2") for f, m in ((F.min, "a"), (F.max, "b")))).where("as1 = bs1 and as2 = bs2")
    alone = alone.groupBy(F.col("as1").alias("s1"), F.col("as2").alias("s2")).agg(F.count("*").alias("alone"))
    kept = by_set.join(alone, ["s1", "s2"], "left").where(F.coalesce("alone", F.lit(0)) <= _spare(F.col("n"), percent))
    return kept.select("s1", "s2", "n", "rep", "copies")


def numbered(sets: DataFrame, percent: int) -> DataFrame:
    """The survivors with `sid`, a number of their own, so what follows need not carry digests."""
    return materialise(survivors(sets, percent).withColumn("sid", F.monotonically_increasing_id()), "join-chosen")


def _whole_sets(docs: DataFrame, chosen: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """sid and hash of every n-gram of the chosen sets, from their representatives' texts; sets that only
    rows without doc_id have are found by their digest. Rows that repeat a set give it once. Second, the
    table that this reads, to be discarded with it."""
    names = chosen.select(F.col("rep").alias("doc_id"), "s1", "s2", "sid", (F.col("copies") > 1).alias("again"))
    texts = docs.select("doc_id", "text").join(names.where("doc_id is not null").hint("merge"), "doc_id")

    def run(batches):
        for batch, texts in _texts(batches, "text"):
            rows = zip(shingle_sets(texts, size), *(batch.column(c).to_pylist() for c in ("s1", "s2", "sid", "again")))
            found = [(s, sid, again) for s, s1, s2, sid, again in rows if _set_id(s) == (s1, s2)]
            if found:
                sizes = [len(s) for s, _, _ in found]
                columns = [np.repeat([f[1] for f in found], sizes), np.repeat([f[2] for f in found], sizes), np.concatenate([f[0] for f in found]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sid", "again", "h"])

    def all_of(batches):
        for _, texts in _texts(batches, "text"):
            for s in shingle_sets(texts, size):
                if len(s):
                    s1, s2 = _set_id(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), x), pa.int64()) for x in (s1, s2)] + [pa.array(s.astype(np.int64))], names=["s1", "s2", "h"])

    grams = materialise(texts.select("s1", "s2", "sid", "again", "text").mapInArrow(run, "sid long, again boolean, h long"), "join-grams")
    whole = grams.where("not again").select("sid", "h")
    if not chosen.where("copies > 1 and rep is not null").isEmpty():
        whole = whole.unionByName(grams.where("again").select("sid", "h").distinct())
    nameless = chosen.where("rep is null").select("s1", "s2", "sid")
    if not nameless.isEmpty():
        whole = whole.unionByName(docs.where("doc_id is null").select("text").mapInArrow(all_of, "s1 long, s2 long, h long").join(nameless, ["s1", "s2"]).select("sid", "h").distinct())
    return whole, grams


def _with_counts(grams: DataFrame) -> DataFrame:
    """sid, hs, dfs: each set's hashes and in how many sets each is. Counts of one, the most, are left to
    the outer join; the shuffled counts are combined in the tasks first, and a hot n-gram's rows
    may be split in the join."""
    counts = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    joined = grams.join(counts, "h", "left").select("sid", F.struct("h", F.coalesce("df", F.lit(1)).cast("int").alias("df")).alias("g"))
    packed = joined.groupBy("sid").agg(F.collect_list("g").alias("gs"))
    return packed.select("sid", F.col("gs.h").alias("hs"), F.col("gs.df").alias("dfs"))


def _segments(packed: DataFrame, percent: int) -> DataFrame:
    """A row a set and fragment: sid, f, n, alone, hs, dfs (little-endian, in hash order), and in fragment 0
    also rare, the set's prefix: its rarest n-grams that others have. Sets that cannot link are left out."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, rows=64)):
            rows = []
            for sid, hs, dfs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                h = hs.values.to_numpy().astype(np.uint64)
                order = np.argsort(h)
                h, df = h[order], dfs.values.to_numpy()[order]
                n, alone = len(h), int((df == 1).sum())
                spare = n * (100 - percent) // 100
                if alone > spare:
                    continue
                rare = h[np.lexsort((h, df))][alone : spare + 1]
                cuts = np.searchsorted(h, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
                for f, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
                    rows.append((sid, f, n, alone, h[a:b].tobytes(), df[a:b].astype(np.int32).tobytes(), rare.astype(np.int64) if f == 0 else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            names = ["sid", "f", "n", "alone", "hs", "dfs", "rare"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    return packed.mapInArrow(run, "sid long, f int, n long, alone long, hs binary, dfs binary, rare array<long>")


def _groups(segments: DataFrame, percent: int) -> DataFrame:
    """lead, sid, n, lead_n: the members of each leader's group, those of all its bands and n-grams together.

    A band holds lengths within the square of the ratio at which sets can still link, and bands
    overlap by half, so every linked pair shares a band. In it, sets that share a rare n-gram follow
    the one with the fewest n-grams of its own, so both have the same leader."""
    ratio = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n").cast("double")) / ratio)
    rare = (
        segments.where("f = 0")
        .select("sid", "n", F.floor(1000 * F.col("alone") / F.col("n")).alias("own"), F.explode("rare").alias("h"))
        .withColumn("band", F.explode(F.array(band, band - 1)))
    )
    leads = (
        rare.groupBy("band", "h").agg(F.min(F.struct("own", "sid", "n")).alias("l"), F.count("*").alias("k")).where("k > 1")
        .select("band", "h", F.col("l.sid").alias("lead"), F.col("l.n").alias("lead_n"))
    )
    return rare.join(leads, ["band", "h"]).where("sid <> lead").select("lead", "sid", "n", "lead_n").distinct()


def _partials(pairs: DataFrame, segments: DataFrame, left: str, right: str, keep: float = 0) -> DataFrame:
    """Overlap of each pair in each fragment: `common`, and if `keep` is not 0 the first deviations of
    `right` from `left` in the order (added by rising count, then missing by falling count), at most
    keep * n + 1 of them, which is as many as the whole prefix has, and `bits`, which has a bit set for the
    last six bits of each deviation's hash: two sets differ in at least as many n-grams as in bits."""
    side = lambda name, mark, *more: segments.select(F.col("sid").alias(name), "f", *(F.col(c).alias(f"seg_{mark}_{c}") for c in ("hs", "dfs", *more)))
    joined = pairs.join(side(left, "a"), left).join(side(right, "b", "n"), [right, "f"])
    names = [*pairs.columns, "f", "seg_b_n", "seg_a_hs", "seg_a_dfs", "seg_b_hs", "seg_b_dfs"]
    item = pa.list_(pa.struct([("k", pa.int64()), ("h", pa.int64())]))
    fields = pairs.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    kept = len(pairs.columns)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "seg_b_hs", rows=256)):
            common, items, bits = [], [], []
            for row in zip(*(batch.column(i).to_pylist() for i in range(kept + 1, len(names)))):
                n, ah, ad, bh, bd = row
                a, b = np.frombuffer(ah, np.uint64), np.frombuffer(bh, np.uint64)
                at = np.searchsorted(a, b)
                found = at < len(a)
                found[found] = a[at[found]] == b[found]
                common.append(int(found.sum()))
                if keep:
                    lost = np.ones(len(a), bool)
                    lost[at[found]] = False
                    key = np.concatenate((np.frombuffer(bd, np.int32)[~found].astype(np.int64), _MISSING - np.frombuffer(ad, np.int32)[lost].astype(np.int64)))
                    gram = np.concatenate((b[~found], a[lost])).astype(np.int64)
                    bits.append(int(np.bitwise_or.reduce(np.int64(1) << (gram & 63), initial=np.int64(0))))
                    first = np.lexsort((gram, key))[: int(keep * n) + 1]
                    items.append([{"k": k, "h": h} for k, h in zip(key[first].tolist(), gram[first].tolist())])
                else:
                    bits.append(None)
                    items.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: kept + 1], pa.array(common, pa.int64()), pa.array(bits, pa.int64()), pa.array(items, item)],
                names=[*names[: kept + 1], "common", "bits", "items"],
            )

    return joined.select(*names).mapInArrow(run, f"{fields}, f int, common long, bits long, items array<struct<k: long, h: long>>")


def links(segments: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between sets whose components are those of all links."""
    over, under = 100 - percent, 100 + percent  # linked: under * |x ^ y| <= over * (|x| + |y|)
    reach = over / under * (1 + 100 / percent)  # most deviation from a linked set, as a share of n
    groups = materialise(_groups(segments, percent), "join-groups")
    compared = (
        _partials(groups, segments, "lead", "sid", keep=reach)
        .groupBy("lead", "sid", "n", "lead_n")
        .agg(
            F.sum("common").alias("common"),
            F.sort_array(F.flatten(F.collect_list("items"))).alias("items"),
            *(F.coalesce(F.max(F.when(F.col("f") == f, F.col("bits"))), F.lit(0)).alias(f"bits{f}") for f in range(FRAGMENTS)),
        )
        .withColumn("dev", F.col("n") + F.col("lead_n") - 2 * F.col("common"))
        .withColumn("slack", over * F.col("n") - under * F.col("dev"))
        .withColumn("most", F.floor(reach * F.col("n")))
        .withColumn("items", F.expr("slice(items, 1, cast(most + 1 as int))"))
    )
    compared = materialise(compared, "join-compared")
    # the member of most slack stands for all that link with it for certain; the leader deviates by nothing
    best = compared.groupBy("lead").agg(F.max_by(F.struct("sid", "slack"), F.struct("slack", "sid")).alias("b"), F.max("lead_n").alias("m"))
    best = best.select("lead", F.when(F.col("b.slack") > over * F.col("m"), F.col("b")).otherwise(F.struct(F.col("lead").alias("sid"), (over * F.col("m")).alias("slack"))).alias("b"))
    # written down, so that what follows is dealt by its own keys and not by the leader alone, which may have any share of the rows
    member = materialise(compared.join(best, "lead").withColumn("certain", F.col("slack") + F.col("b.slack") >= 0), "join-members")
    sure = member.where("certain").select(F.col("sid").alias("u"), F.col("b.sid").alias("v"))
    led = member.where(under * F.col("dev") <= over * (F.col("n") + F.col("lead_n"))).select(F.col("sid").alias("u"), F.col("lead").alias("v"))
    anchored = best.select(F.col("lead").alias("u"), F.col("b.sid").alias("v"), (F.col("b.slack") + 0).alias("s")).where("s >= 0").select("u", "v")
    bits = [f"bits{f}" for f in range(FRAGMENTS)]
    member = member.select("lead", "sid", "n", "dev", "most", "certain", "items", *bits)
    shape = ["lead", F.col("item.h").alias("h")]
    index = member.select("*", F.posexplode(F.expr("slice(items, 1, cast(floor(most / 2) + 1 as int))")).alias("at", "item")).select(
        *shape, *(F.col(c).alias(f"y_{c}") for c in ("sid", "n", "dev", "certain", "at", *bits))
    )
    probe = member.select("*", F.posexplode("items").alias("at", "item")).select(*shape, *(F.col(c).alias(f"x_{c}") for c in ("sid", "n", "dev", "certain", "at", *bits)))
    # if this is the first deviation that two share, they share no more than what follows it on either side
    shared = F.least(F.col("x_dev") - F.col("x_at"), F.col("y_dev") - F.col("y_at"))
    differ = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    like = (
        (F.struct("y_dev", "y_sid") < F.struct("x_dev", "x_sid"))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & (under * (F.col("x_dev") - F.col("y_dev")) <= over * (F.col("x_n") + F.col("y_n")))
        & (under * (F.col("x_dev") + F.col("y_dev") - 2 * shared) <= over * (F.col("x_n") + F.col("y_n")))
        & (under * differ <= over * (F.col("x_n") + F.col("y_n")))
    )
    keys = ["lead", "h"]
    meet = lambda p, i: p.join(i, keys).where(like).select(F.col("x_sid").alias("x"), F.col("y_sid").alias("y"), "x_n", "y_n")
    # two that are certain are in one component already
    pairs = meet(probe.where("not x_certain"), index).unionByName(meet(probe.where("x_certain"), index.where("not y_certain"))).distinct()
    counted = _partials(materialise(pairs, "join-pairs"), segments, "x", "y").groupBy("x", "y", "x_n", "y_n").agg(F.sum("common").alias("common"))
    far = counted.where(100 * F.col("common") >= percent * (F.col("x_n") + F.col("y_n") - F.col("common"))).select(F.col("x").alias("u"), F.col("y").alias("v"))
    return sure.unionByName(led).unionByName(anchored).unionByName(far).where("u <> v").distinct()


def _groups_of_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, s1, s2 of every row; and s1, s2, component_id, first (it has the component's least node) of every set."""
    with_low = materialise(document_sets(docs, size), "join-low")
    chosen = numbered(with_low, percent)
    sets = materialise(with_low.select("doc_id", "n", "s1", "s2"), "join-sets")
    discard(with_low)
    grams, written = _whole_sets(docs, chosen, size)
    segments = materialise(_segments(_with_counts(grams), percent), "join-segments")
    discard(written)
    edges = materialise(links(segments, percent), "join-links")
    discard(segments)
    node, number = F.col("rep"), F.col("component")
    if not chosen.where("rep is null").isEmpty():
        # sets without a doc_id are nodes of their own, after all that have one
        node = F.struct(F.col("rep").isNull().alias("none"), "rep", *(F.when(F.col("rep").isNull(), F.col(c)).alias(c) for c in ("s1", "s2")))
        number = F.col("component.rep")
    name = chosen.select("sid", node.alias("node"))
    named = edges.join(name.select(F.col("sid").alias("u"), F.col("node").alias("ru")), "u").join(name.select(F.col("sid").alias("v"), F.col("node").alias("rv")), "v")
    found = connected_components(named.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    by_set = sets.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")).withColumn("own", node)
    of_set = by_set.join(found, by_set["own"] == found["node"], "left").select(
        "s1", "s2", F.coalesce(number, "rep").alias("component_id"), F.coalesce(F.col("own") == F.col("component"), F.lit(True)).alias("first")
    )
    return sets, of_set


def _components_of_rows(sets: DataFrame, of_set: DataFrame) -> DataFrame:
    return sets.join(of_set.select("s1", "s2", "component_id"), ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def join_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _components_of_rows(*_groups_of_sets(docs, size, percent))


def _with_digest(docs: DataFrame, size: int) -> DataFrame:
    """`docs` with __join_s1 and __join_s2, as `document_sets` has them."""

    def run(batches):
        for batch, texts in _texts(batches, "text"):
            ids = [_set_id(s) for s in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1))], names=[*batch.schema.names, *_DIGEST])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _DIGEST)]))


def keep_representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, the one with the least doc_id (rows that repeat its doc_id
    stay with it), or one row where none has a doc_id; rows of empty sets stay; columns of `docs`."""
    sets, of_set = _groups_of_sets(docs, size, percent)
    keep = _components_of_rows(sets, of_set).where("doc_id = component_id").select(F.col("doc_id").alias("__join_kept")).distinct()
    kept = docs.join(keep, F.col("doc_id") == F.col("__join_kept"), "left_semi")
    if sets.where("doc_id is null").isEmpty():
        return kept
    rest = _with_digest(docs.where("doc_id is null"), size)
    firsts = of_set.where("component_id is null and first").select(*(F.col(c).alias(d) for c, d in zip(("s1", "s2"), _DIGEST)))
    single = rest.join(firsts, _DIGEST, "left_semi").dropDuplicates(_DIGEST).select(*rest.columns)
    return kept.unionByName(rest.where("__join_s1 is null").unionByName(single).drop(*_DIGEST))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"))


# All pairs that share a shingle, counted; then what each document reaches by links.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS ss FROM d
), e AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION SELECT r.doc_id, p.v FROM r JOIN p ON r.reached = p.u
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
