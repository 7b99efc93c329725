"""URL filters: rules by host and path first; other URLs are judged by a multinomial naive
Bayes model over the words of their host and path, where concatenated host names are
split into words by unigram Viterbi.

The unigram counts come from the words of all page texts, the naive Bayes counts from
all URLs that a rule decides. Neither a dictionary nor the URLs come to the driver: each distinct run of
letters in the URLs is joined with the counts of all words that it contains, split once, and joined with
the URLs that have it. Only 2 x BUCKETS token counts, summed before, are gathered and broadcast.

The prior of a class is its smoothed share of the decided URLs if `class_prior` is set, as the query sets it, and
else even.

Defined cases: a null url, or one without `://`, has empty host and path and no words, so its score is
the prior; without any URL that a rule decides all scores are 0 and the verdict is allow; repeated
rows are judged alike; an empty table gives no rows. A URL of any length is judged whole: a run of n letters has
up to MAX_WORD * n words to look up, and they are packed by run. Columns of the result start with `url_` and
replace such columns of the input; the column of texts is left out, all others are carried along.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.batches import slices

from .common import ascii_lower, discard, materialise, read

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
BUCKETS = 1 << 16
MAX_WORD = 20
_REMEMBERED = 50_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


# -- rules ------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """`pages` with url_host, url_path, url_rule (the longest that fits, or null) and url_decided (its verdict)."""
    host, path = F.col("url_host"), F.col("url_path")

    def fits(rule: str) -> Column:
        rule_host, slash, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, kind in reversed(ordered):
        name = F.when(fits(rule), rule).otherwise(name)
        verdict = F.when(fits(rule), kind).otherwise(verdict)
    placed = pages.withColumn("url_host", host_of(F.col("url"))).withColumn("url_path", path_of(F.col("url")))
    return placed.withColumn("url_rule", name).withColumn("url_decided", verdict)


# -- unigram segmentation ---------------------------------------------------------------


def word_counts(pages: DataFrame, column: str = "html") -> DataFrame:
    """w, n: how often each word (letters of any script, at most MAX_WORD) is in all texts, without markup."""
    text = F.regexp_replace(F.lower(F.col(column)), r"<[^>]*>", " ")
    word = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where(F.length("w").between(1, MAX_WORD))
    return word.groupBy("w").agg(F.count("*").alias("n"))


def unigram_counts(pages: DataFrame, column: str = "html") -> dict[str, int]:
    """The counts of all words as a dictionary, for tables of a few pages; judging does not gather them."""
    return {r["w"]: r["n"] for r in word_counts(pages, column).collect()}


class Segmenter:
    """Splits a run of letters at the least cost; a run that no word covers costs more the longer it is."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """`total`: of all words' counts, where `counts` has only those that the runs contain."""
        total = math.log(max(1, sum(counts.values()) if total is None else total))
        self.cost = {w: total - math.log(c) for w, c in counts.items()}
        self.unknown = total + math.log(10)
        self.done: dict[str, list[str]] = {}

    def split(self, run: str) -> list[str]:
        found = self.done.get(run)
        if found is None:
            if len(self.done) >= _REMEMBERED:
                self.done.clear()
            found = self.done[run] = self._viterbi(run)
        return found

    def _viterbi(self, run: str) -> list[str]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - MAX_WORD), end):
                word = run[begin:end]
                cost = self.cost.get(word)
                if cost is None:
                    cost = self.unknown + math.log(10) * len(word)
                if best[begin] + cost < best[end]:
                    best[end], back[end] = best[begin] + cost, begin
        words = []
        while n:
            words.append(run[back[n] : n])
            n = back[n]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Host words marked as such, path words, and numbers by their length alone."""
        return [mark + w for mark, run in runs_of(host, path) for w in ([run] if run[0] == "#" else self.split(run))]


def runs_of(host: str, path: str) -> list[tuple[str, str]]:
    """Mark and run of each run of letters, in order; a number is # and its length."""
    found = [(mark, run) for mark, part in (("h:", host), ("p:", path)) for run in _TOKEN.findall(part.lower())]
    return [(mark, f"#{len(run)}" if run[0].isdigit() else run) for mark, run in found]


def _run_key(run: str) -> str:
    """Stands for the run in tables that repeat it: a digest of a long one."""
    return run if len(run) <= 32 else "=" + hashlib.blake2b(run.encode(), digest_size=16).hexdigest()


def run_counts(urls: DataFrame) -> DataFrame:
    """run, key, and how often the run is in hosts and paths of allowed (h0, p0) and blocked (h1, p1) URLs, of every
    run in `urls` (url_host, url_path, url_decided, k)."""
    names = ["h0", "h1", "p0", "p1"]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "url_path", rows=8192)):
            counts: dict[str, list[int]] = {}
            for host, path, kind, k in zip(*(c.to_pylist() for c in batch.columns)):
                for mark, r in runs_of(host, path):
                    count = counts.setdefault(r, [0, 0, 0, 0])
                    if kind is not None:
                        count[2 * (mark == "p:") + (kind == "block")] += k
            columns = [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([_run_key(r) for r in counts], pa.string()), *columns], names=["run", "key", *names])

    found = urls.select("url_host", "url_path", "url_decided", "k").mapInArrow(run, "run string, key string, h0 long, h1 long, p0 long, p1 long")
    return found.groupBy("run", "key").agg(*(F.sum(c).alias(c) for c in names))


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """`runs` with `words`, the best split by the counts of all words."""
    total = counts.agg(F.sum("n")).first()[0] or 0

    def substrings(batches):
        for batch in (part for whole in batches for part in slices(whole, "run")):
            keys, inside = [], []
            for key, run in zip(*(c.to_pylist() for c in batch.columns)):
                found = {run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + MAX_WORD) + 1)}
                keys += [key] * len(found)
                inside += found
                if len(inside) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(inside, pa.string())], names=["key", "w"])
                    keys, inside = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(inside, pa.string())], names=["key", "w"])

    def split(batches):
        for batch in (part for whole in batches for part in slices(whole, "run")):
            runs, known, ns_of = (batch.column(c).to_pylist() for c in ("run", "ws", "ns"))
            words = [
                [r] if r[0] == "#" else Segmenter(dict(zip(ws or (), ns or ())), total).split(r)
                for r, ws, ns in zip(runs, known, ns_of)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "h0", "h1", "p0", "p1")), pa.array(words, pa.list_(pa.string()))], names=["run", "h0", "h1", "p0", "p1", "words"])

    parts = runs.where("run not like '#%'").select("key", "run").mapInArrow(substrings, "key string, w string")
    known = parts.join(counts, "w").groupBy("key").agg(F.collect_list(F.struct("w", "n")).alias("g")).select("key", F.col("g.w").alias("ws"), F.col("g.n").alias("ns"))
    return runs.join(known, "key", "left").select("run", "h0", "h1", "p0", "p1", "ws", "ns").mapInArrow(split, "run string, h0 long, h1 long, p0 long, p1 long, words array<string>")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


# -- naive Bayes ------------------------------------------------------------------------


def token_counts(split: DataFrame) -> DataFrame:
    """label, bucket, n over all URLs that a rule decides; label 1 is block."""

    def run(batches):
        for batch in batches:
            counts = Counter()
            for h0, h1, p0, p1, words in zip(*(batch.column(c).to_pylist() for c in ("h0", "h1", "p0", "p1", "words"))):
                for label, mark, k in ((0, "h:", h0), (1, "h:", h1), (0, "p:", p0), (1, "p:", p1)):
                    if k:
                        for w in words:
                            counts[label, bucket(mark + w)] += k
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
                names=["label", "bucket", "n"],
            )

    return split.mapInArrow(run, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def bayes_weights(counts: list[tuple[int, int, int]], class_prior: bool = False) -> tuple[float, np.ndarray] | None:
    """Prior and weight of each bucket as log odds of block, with one added to each count; None without URLs.
    The prior is that of the decided URLs' classes, or even."""
    rows, tokens = [0, 0], np.zeros((2, BUCKETS))
    for label, where, n in counts:
        if where < 0:
            rows[label] = n
        else:
            tokens[label, where] = n
    if not sum(rows):
        return None
    logs = np.log(tokens + 1) - np.log(tokens.sum(axis=1, keepdims=True) + BUCKETS)
    return math.log((rows[1] + 1) / (rows[0] + 1)) if class_prior else 0.0, logs[1] - logs[0]


def url_scores(urls: DataFrame, split: DataFrame, weights: tuple[float, np.ndarray]) -> DataFrame:
    """url_key, url_score of the URLs that no rule decides: the prior and the weights of their words.
    A URL's weights are summed in the order of its runs, so its score is the same at every run."""
    shared = urls.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches):
        _, weight = shared.value
        for batch in (part for whole in batches for part in slices(whole, "run", rows=8192)):
            words = batch.column("words").to_pylist()
            host, path = ([float(sum(weight[bucket(mark + w)] for w in ws)) for ws in words] for mark in ("h:", "p:"))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(host, pa.float64()), pa.array(path, pa.float64())], names=["run", "host", "path"])

    def runs(batches):
        for batch in (part for whole in batches for part in slices(whole, "url_path", rows=8192)):
            rows = [(key, run, n[0], n[1]) for key, h, p in zip(*(c.to_pylist() for c in batch.columns)) for run, n in _tally(runs_of(h, p)).items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["url_key", "run", "nh", "np"])

    weighed = split.select("run", "words").mapInArrow(weigh, "run string, host double, path double")
    parts = urls.where("url_decided is null").select("url_key", "url_host", "url_path").mapInArrow(runs, "url_key string, run string, nh long, np long")
    summed = parts.join(weighed, "run").select("url_key", F.struct("run", (F.col("nh") * F.col("host") + F.col("np") * F.col("path")).alias("x")).alias("g")).groupBy("url_key").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    return summed.select("url_key", F.aggregate("gs", F.lit(float(weights[0])), lambda total, g: total + g["x"]).alias("url_score"))


def _tally(runs: list[tuple[str, str]]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for mark, run in runs:
        found.setdefault(run, [0, 0])[mark == "p:"] += 1
    return found


def judge_urls(pages: DataFrame, rules=RULES, text: str = "html", class_prior: bool = False) -> DataFrame:
    """`pages` with url_host, url_path, url_rule, url_score (log odds of block; null where a rule decides) and url_verdict."""
    pages = pages.drop("url_host", "url_path", "url_rule", "url_decided", "url_score", "url_verdict")
    placed = with_rules(pages.drop(text), rules)
    key = F.md5(F.concat("url_host", F.lit("\0"), "url_path"))
    urls = placed.groupBy("url_host", "url_path", "url_decided").agg(F.count("*").alias("k")).withColumn("url_key", key)
    urls = materialise(urls, "url-distinct")
    decided = [(int(r["url_decided"] == "block"), -1, r["k"]) for r in urls.where("url_decided is not null").groupBy("url_decided").agg(F.sum("k").alias("k")).collect()]
    # rows that a rule decides are not scored: they take the other branch of the union
    ruled = placed.where("url_decided is not null").withColumn("url_score", F.lit(None).cast("double"))
    scored = placed.where("url_decided is null")
    if decided:
        runs, counts = materialise(run_counts(urls), "url-runs"), materialise(word_counts(pages, text), "url-words")
        split = materialise(split_runs(runs, counts), "url-split")
        discard(runs)
        discard(counts)
        weights = bayes_weights(decided + [(r["label"], r["bucket"], r["n"]) for r in token_counts(split).collect()], class_prior)
        scores = url_scores(urls, split, weights).withColumnRenamed("url_key", "__url_key")
        scored = scored.join(scores, key == F.col("__url_key"), "left").drop("__url_key")
        scored = scored.withColumn("url_score", F.coalesce("url_score", F.lit(float(weights[0]))))
    else:
        scored = scored.withColumn("url_score", F.lit(0.0))
    return (
        ruled.unionByName(scored)
        .withColumn("url_verdict", F.coalesce("url_decided", F.when(F.col("url_score") > 0, "block").otherwise("allow")))
        .drop("url_decided")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"), class_prior=True)
    return judged.select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
        F.col("url_score").alias("score"),
    )
