"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_BYTES bytes, all of its text. Each passage is
encoded by a learnt layer over its byte classes and hashed byte pairs; gated attention,
learnt from document labels alone, weighs the passages; the weighted sum is scored.

Fitting takes a bounded sample of labelled documents, each whole: in the order of their hash at most
SAMPLE, and as many as have SAMPLE_PASSAGES passages together, the first one in any case. Their counts,
82 numbers of two bytes a passage, are what the driver holds (33 MB at most, and the first document). Scoring takes
every passage of every document. Rows with crc32(doc_id) mod 3 = 1 never enter fitting.

Defined cases: a text of any length is cut into passages within its own row; null or empty text is one empty passage and gets a score; a null doc_id is not
held out; null labels are ignored; without any label, or with one class only, every score is
the share of good labels with one good and one bad added; repeated rows score alike, and of the
rows that repeat a sampled doc_id one enters fitting; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.batches import slices

from .common import discard, materialise, read

PASSAGE_BYTES = 512
SAMPLE = 4000
SAMPLE_PASSAGES = 200_000
PAIRS = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 64, 0.01, 1e-4, 7
# The byte classes; bytes of multi-byte characters are the last two.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"|", b"#*$%&", b"<>{}[]()", b"\"'-/"]
WIDTH = len(CLASSES) + 3 + PAIRS


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for i, members in enumerate(CLASSES):
        table[list(members)] = i
    table[128:192], table[192:] = len(CLASSES) + 1, len(CLASSES) + 2
    return table


_CLASS = _class_table()


def passage_counts(text: str | None) -> np.ndarray:
    """A row a passage: counts of byte classes, then of byte pairs by hash. Pairs are of classes'
    bytes within the passage, so each row depends on its own bytes alone."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64)
    n = max(1, -(-len(raw) // PASSAGE_BYTES))
    at = np.arange(len(raw)) // PASSAGE_BYTES
    classes = len(CLASSES) + 3
    first = np.bincount(_CLASS[raw] + classes * at, minlength=classes * n).reshape(n, classes)
    if len(raw) < 2:
        return np.hstack([first, np.zeros((n, PAIRS), np.int64)])
    pair = (raw[:-1] * 31 + raw[1:] * 17) % PAIRS
    inside = at[:-1] == at[1:]
    second = np.bincount((pair + PAIRS * at[:-1])[inside], minlength=PAIRS * n).reshape(n, PAIRS)
    return np.hstack([first, second])


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rare marks count, long passages do not outweigh short ones."""
    counts = counts.astype(np.float64)
    total = np.maximum(1, counts[:, : WIDTH - PAIRS].sum(axis=1, keepdims=True))
    return np.sqrt(counts / total)


# -- the model --------------------------------------------------------------------------


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scaled = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    return {"W": scaled(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": scaled(HIDDEN, GATE), "U": scaled(HIDDEN, GATE), "w": scaled(GATE, 1)[:, 0], "c": scaled(HIDDEN, 1)[:, 0], "c0": np.zeros(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """x: passages of all bags one after another; starts: where each bag begins."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}


def _gradients(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, starts)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    d = (f["y"] - y) / len(y)
    dz = d[:, None] * p["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of bags of passage counts, the same at every run."""
    rng = np.random.default_rng(SEED)
    p = _start(rng)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return {k: np.zeros_like(v) for k, v in p.items()} | {"c0": np.array([np.log(share / (1 - share))])}
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = [len(bags[i]) for i in some]
            grad = _gradients(p, features(np.vstack([bags[i] for i in some])), np.cumsum([0, *sizes[:-1]]), labels[some])
            step += 1
            for k in p:
                grad[k] = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


# -- tables -----------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> dict[str, np.ndarray]:
    """The sample is taken from the labels, so the join is with at most `sample` rows; which of their documents
    `passages` has room for is known when they are counted."""
    order = F.xxhash64("mil_doc")
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("mil_doc"), F.col(label).cast("int").alias("mil_label"))
        .orderBy(order, "mil_doc", "mil_label")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("mil_doc")).select(order.alias("at"), "mil_doc", "mil_label", "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            counts = [passage_counts(t).astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()]
            sizes = [len(c) // (2 * WIDTH) for c in counts]
            digests = [hashlib.md5(c).hexdigest() for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(counts, pa.binary())],
                names=["at", "doc", "label", "size", "digest", "counts"],
            )

    counted = materialise(rows.mapInArrow(run, "at long, doc string, label int, size long, digest string, counts binary"), "mil-bags")
    known = counted.groupBy("at", "doc", "label").agg(F.min(F.struct("digest", "size")).alias("d")).select("at", "doc", "label", "d.digest", "d.size").collect()
    chosen, room = [], passages
    for r in sorted(known):
        room -= r["size"]
        if room < 0 and chosen:
            break
        chosen.append((r["doc"], r["label"], r["digest"]))
    names = docs.sparkSession.createDataFrame(chosen, "doc string, label int, digest string")
    found = counted.join(F.broadcast(names), ["doc", "label", "digest"], "left_semi").dropDuplicates(["doc", "label"]).select("at", "doc", "label", "counts")
    found = sorted(found.collect()) if chosen else []
    discard(counted)
    bags = [np.frombuffer(r["counts"], np.uint16).reshape(-1, WIDTH) for r in found]
    return fit(bags, np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score and n_passages of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", rows=256)):
            counts = [passage_counts(t) for t in batch.column(1).to_pylist()]
            sizes = [len(c) for c in counts]
            y = forward(shared.value, features(np.vstack(counts)), np.cumsum([0, *sizes[:-1]]))["y"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64()), pa.array(sizes, pa.int32())], names=["doc_id", "score", "n_passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, score double, n_passages int")


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages"
    )
